"""Encoding with a public byte-level BPE vocabulary by a tokenization automaton.

The merges are compiled one after another into a deterministic automaton over
tokens, as in the merge-gadget construction: a merge (u, v) born at rank r takes
the arc v away from the state that u leads to and adds the arc uv wherever u
could be taken and v could follow. Written out, its table has states times
tokens entries, 2.5 billion for 50,000 merges; but all states come from one by
taking arcs away, so it is held as the differences: per token the arcs barred
after it, with the rank from which on.

A pre-split word is encoded from left to right by table-driven transitions. A
second table over bytes (state and byte give a state) tells at each byte which
arcs end there, the longest first; the one whose label may follow the token at
whose end it begins is taken. Exactly one does, since the automaton's words are
the sequences that BPE makes and prefixes of such are such. Decoding emits the
arcs' labels.
"""

from __future__ import annotations

import json
import os

import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Fixed value: how byte-level vocabularies cut a text into words before merging.
PRE_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Where vocabulary files lie unless a path is given.
VOCABULARY_DIR = os.environ.get("EVALWEAVE_TOKENIZERS", "/opt/tokenizers")

#: Words whose ids a Python worker remembers; then it starts anew. Bounds memory only.
REMEMBERED_WORDS = 200_000
_LONGEST_REMEMBERED = 64
_FOREVER = 1 << 60


def _byte_of_letter() -> dict[str, int]:
    """Byte-level files write bytes without a printable sign as letters from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class Automaton:
    """The compiled tables: labels, births, parts, and per token what may not follow it."""

    def __init__(self, labels: list[bytes], merges: list[tuple[int, int, int]]) -> None:
        n = len(labels)
        self.labels = labels
        self.ids = {label: k for k, label in enumerate(labels) if label}
        self.left, self.right = list(range(n)), list(range(n))
        self.birth = [-1] * n
        self.barred: dict[int, dict[int, int]] = {}
        for rank, (u, v, uv) in enumerate(merges):
            if not self._free(u, v):  # v never follows u by now, so the merge never happens
                if self.birth[uv] < 0:
                    self.ids.pop(labels[uv], None)
                continue
            self.barred.setdefault(u, {})[v] = rank
            if self.birth[uv] < 0:
                self.left[uv], self.right[uv], self.birth[uv] = u, v, rank
                self.ids[labels[uv]] = uv
        self._follows: dict[tuple[int, int], bool] = {}
        self._more: dict[int, dict[int, int]] = {}
        self._sizes = list(map(len, labels))
        self._known: dict[str, list[int]] = {}
        self._split = regex.compile(PRE_SPLIT)
        # bytes that no file leaves out, but a cut-down vocabulary might
        if missing := [b for b in range(256) if bytes([b]) not in self.ids]:
            raise ValueError(f"the vocabulary lacks the bytes {missing[:5]}")
        self._compile_bytes()

    @classmethod
    def load(cls, path: str) -> Automaton:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters = _byte_of_letter()
        vocabulary: dict[str, int] = model["vocab"]
        labels = [b""] * (max(vocabulary.values()) + 1)
        for token, k in vocabulary.items():
            labels[k] = bytes(letters[c] for c in token) if all(c in letters for c in token) else b""
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        return cls(labels, [(vocabulary[a], vocabulary[b], vocabulary[a + b]) for a, b in pairs])

    def may_follow(self, a: int, b: int) -> bool:
        """Whether the state that token a leads to has the arc b.

        The state of a is that of its right part when a was born, with what a
        lost later; the arc b needs the arc of its left part at its birth.
        """
        key = (a, b)
        known = self._follows.get(key)
        if known is None:
            if len(self._follows) > 4 * REMEMBERED_WORDS:
                self._follows.clear()
            known = self._follows[key] = self._free(a, b)
        return known

    def _free(self, a: int, b: int) -> bool:
        until_a, x = _FOREVER, a
        while True:
            barred = self.barred.get(x)
            if barred:
                until, y = until_a, b
                while barred.get(y, _FOREVER) >= until:
                    if self.left[y] == y:
                        break
                    until = min(until, self.birth[y] + 1)  # of equal pairs, the left one merges first
                    y = self.left[y]
                else:
                    return False
            if self.right[x] == x:
                return True
            until_a = min(until_a, self.birth[x])
            x = self.right[x]

    def _compile_bytes(self) -> None:
        """The table over bytes: per state its transitions, the longest arc that ends there, and per arc the next shorter one.

        A state is what was read of the longest label that may still end here.
        Transitions that leave a label are filled in when they are first taken.
        """
        self._goto: list[dict[int, int]] = [{}]
        arc, parent = [-1], [(0, 0)]
        for label, t in self.ids.items():
            state = 0
            for byte in label:
                nxt = self._goto[state].get(byte)
                if nxt is None:
                    nxt = self._goto[state][byte] = len(self._goto)
                    self._goto.append({})
                    arc.append(-1)
                    parent.append((state, byte))
                state = nxt
            arc[state] = t
        self._fall, self.shorter = [0] * len(arc), [-1] * len(self.labels)
        level = list(self._goto[0].values())
        while level:  # shallow states first
            deeper = []
            for state in level:
                before, byte = parent[state]
                self._fall[state] = fall = self._step(self._fall[before], byte) if before else 0
                if arc[state] < 0:
                    arc[state] = arc[fall]
                else:
                    self.shorter[arc[state]] = arc[fall]
                deeper.extend(self._goto[state].values())
            level = deeper
        self._arc = arc

    def _step(self, state: int, byte: int) -> int:
        nxt = self._goto[state].get(byte)
        if nxt is None:
            nxt = self._step(self._fall[state], byte) if state else 0
            if state:
                if len(self._more) > REMEMBERED_WORDS:
                    self._more.clear()
                self._more.setdefault(state, {})[byte] = nxt
        return nxt

    def encode_word(self, word: bytes) -> list[int]:
        """The one path through the automaton whose labels make up the word."""
        n = len(word)
        last, goto, more, arc, shorter, size, follows, state = [-1] * (n + 1), self._goto, self._more, self._arc, self.shorter, self._sizes, self._follows, 0
        for i, byte in enumerate(word, 1):
            nxt = goto[state].get(byte)
            if nxt is None:
                nxt = more[state].get(byte) if state in more else None
                if nxt is None:
                    nxt = self._step(state, byte)
            state = nxt
            t = arc[state]
            while True:
                j = i - size[t]
                if not j:
                    break
                before = last[j]
                ok = follows.get((before, t))
                if self.may_follow(before, t) if ok is None else ok:
                    break
                t = shorter[t]
            last[i] = t
        out = []
        while n:
            out.append(last[n])
            n -= size[last[n]]
        return out[::-1]

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; null and empty texts have none."""
        if not text:
            return []
        out: list[int] = []
        known = self._known
        for word in self._split.findall(text):
            ids = known.get(word)
            if ids is None:
                ids = self.encode_word(word.encode("utf-8", "surrogatepass"))
                if len(word) <= _LONGEST_REMEMBERED:
                    if len(known) >= REMEMBERED_WORDS:
                        known.clear()
                    known[word] = ids
            out.extend(ids)
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.labels[k] for k in ids).decode("utf-8", "replace")


_loaded: dict[str, Automaton] = {}
_shipped: set[tuple[str, str]] = set()


def _ship(path: str) -> None:
    """Sends a vocabulary file along with the job, once a session, so it need only lie at the driver."""
    spark = SparkSession.active()
    if (spark.sparkContext.applicationId, path) not in _shipped and os.path.exists(path):
        spark.sparkContext.addFile(path)
        _shipped.add((spark.sparkContext.applicationId, path))


def automaton(path: str) -> Automaton:
    """The automaton of a file, compiled once per Python process."""
    if path not in _loaded:
        _loaded[path] = Automaton.load(path if os.path.exists(path) else SparkFiles.get(os.path.basename(path)))
    return _loaded[path]


def vocabulary(name: str = "byte_bpe_50k.json", folder: str | None = None) -> str:
    return os.path.join(folder or VOCABULARY_DIR, name)


def token_ids(text: Column, path: str | None = None) -> Column:
    """Token ids of a text column, without special tokens; null and empty give [].

    ``path``: a byte-level BPE file at the driver; it is sent along with the job. Whole texts are
    encoded; a text as long as memory allows is fine. The vocabulary bounds the
    tables (50,000 merges take some 60 MB a worker).
    """
    path = path or vocabulary()
    _ship(path)

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        encode = automaton(path).encode
        flat, offsets = [], [0]
        for t in texts:
            flat.extend(encode(t.as_py()))
            offsets.append(len(flat))
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))

    return ids.asNondeterministic()(text)  # or a filter on the ids would encode every text again


def token_count(text: Column, path: str | None = None) -> Column:
    """How many token ids a text has; 0 for null and empty ones."""
    path = path or vocabulary()
    _ship(path)

    @F.arrow_udf("int")
    def count(texts: pa.Array) -> pa.Array:
        encode = automaton(path).encode
        return pa.array([len(encode(t.as_py())) for t in texts], pa.int32())

    return count.asNondeterministic()(text)


def decoded(ids: Column, path: str | None = None) -> Column:
    """The text that token ids stand for; null gives null, [] the empty text."""
    path = path or vocabulary()
    _ship(path)

    @F.arrow_udf("string")
    def texts(column: pa.Array) -> pa.Array:
        decode = automaton(path).decode
        return pa.array([None if x is None else decode(x) for x in column.to_pylist()], pa.string())

    return texts(ids)
