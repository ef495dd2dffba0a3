"""Reading ground-truth JSON text.

Key order, repeated keys and value types must all survive, which neither
``from_json`` (types) nor VARIANT (order) keeps; so documents are read by the
C parser of Python inside Arrow batches, and only the fields asked for leave.
"""

from __future__ import annotations

import json
import re

#: A whole string literal, or a comma before a closing bracket outside one.
_STRAY = re.compile(r'"(?:[^"\\]|\\.)*"|,(?=\s*[}\]])', re.S)


def read_json(text: str | None):
    """The parsed value, trailing commas forgiven; None where it can't be parsed."""
    if not text:
        return None
    try:
        return json.loads(text)
    except (ValueError, RecursionError):
        pass
    try:
        return json.loads(_STRAY.sub(lambda m: "" if m[0] == "," else m[0], text))
    except (ValueError, RecursionError):
        return None


def isolates(doc) -> list[tuple[str | None, dict | None]]:
    """Name and body of each linked isolate in written order, from list or map."""
    linked = doc.get("isolates_with_linking") if isinstance(doc, dict) else None
    if isinstance(linked, dict):
        return [(k, v if isinstance(v, dict) else None) for k, v in linked.items()]
    if isinstance(linked, list):
        return [(name(v, "isolate_id"), v) if isinstance(v, dict) else (None, None) for v in linked]
    return []


def name(body: dict, key: str) -> str | None:
    """A name as written; numbers and booleans as JSON writes them, else None."""
    v = body.get(key)
    return v if isinstance(v, str) else None if v is None or isinstance(v, (dict, list)) else json.dumps(v)
