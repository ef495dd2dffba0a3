"""Template residue, filler, error pages and browser notices in place of content.

Method: one multi-pattern automaton holds the phrases of such texts in five
languages, written out and built from slots (what x state, action x thing), the
words that filler prose is made of, and the openings of placeholders. A passage
is excluded when its matches cover most of its letters and one of them is telling
by itself, so sentences that merely speak of such things stay; without such a
phrase, single words of such pages must cover nearly all of it. Passages are the
whole text, a sentence or line, two or more telling phrases in a row, and a
placeholder, which starts where the automaton finds its opening and is covered by
itself when a field's name and its closing follow.
"""

from __future__ import annotations

import bisect
import itertools
import re

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The part of a passage's letters and digits that phrases must cover.
COVERAGE = 0.5
#: The part that single words must cover where no phrase is telling by itself.
_NEARLY_ALL = 0.9

# Phrases in lower case, numbers written 0. Telling ones, by kind.
NOTICE = """
please enable javascript|enable javascript|javascript is disabled|javascript is required|javascript must be enabled|requires javascript|javascript is turned off
turn on javascript|turn on scripts|scripting turned on|scripts turned on|scripts and cookies|cookies switched on|cookies turned on|enable scripts|blocking scripts|scripts are disabled|scripts are blocked
your browser is out of date|your browser does not support|your browser doesn't support|unsupported browser|outdated browser|update your browser|upgrade your browser|adjust your browser|checking your browser|browser is blocking
cannot display this reader|before granting access|if nothing appears|loading supplementary viewer|click here if nothing happens|if you are not redirected|redirecting you to
we use cookies|this site uses cookies|this website uses cookies|accept all cookies|accept cookies|enable cookies|cookies are disabled|cookies must be enabled|accept all / reject|skip to main content|skip to content|manage cookie preferences
your session has expired|session has timed out|session timed out|log in again|please log in|please sign in|sign in to continue|log in to continue|sign in to read|log in to read|you must be logged in|you must log in|login required|you are not logged in|subscribe to read
verify that you are human|verify you are human|by ticking the box below|i am not a robot|complete the captcha|unusual traffic from your
activer javascript|activez javascript|veuillez activer|javascript est désactivé|votre navigateur|activer les cookies|nous utilisons des cookies|accepter les cookies|votre session a expiré|veuillez vous connecter|connectez-vous pour|se connecter pour lire|tout accepter
active javascript|activar javascript|habilite javascript|habilitar javascript|javascript está desactivado|su navegador|tu navegador|utilizamos cookies|usamos cookies|aceptar todas|aceptar cookies|su sesión ha caducado|su sesión ha expirado|inicie sesión para|debe iniciar sesión
aktivieren sie javascript|javascript aktivieren|javascript ist deaktiviert|ihr browser|in ihrem browser|cookies aktivieren|aktivieren sie cookies|wir verwenden cookies|alle akzeptieren|cookies akzeptieren|ihre sitzung ist abgelaufen|sitzung abgelaufen|bitte melden sie sich an|melden sie sich an, um
请启用javascript|启用javascript|请开启javascript|需要javascript|您的浏览器|浏览器不支持|浏览器版本过低|使用cookie|接受cookie|请登录|登录后|会话已过期|请重新登录|验证您是人类|请完成验证
"""
ERROR = """
page not found|page could not be found|page cannot be found|page you asked for|page you requested|page you are looking for|could not be found|no longer exists on this server|no such article|no such page|return to the home page|go back to the start page|back to the home page|check the address|check the url
0 not found|0 forbidden|0 unauthorized|0 bad request|0 bad gateway|bad gateway|gateway timeout|gateway time-out|internal server error|service unavailable|service temporarily unavailable|temporarily unavailable|http status 0|http error 0|status code 0|error code 0|error 0|0 error
has been moved or removed|has moved permanently|timed out while loading|unable to retrieve the|unable to load the|failed to retrieve|you requested is not available|requested is not available|no such document|no such file|no such record|no such table|no such supplement|on this server|too many requests for this|you are not permitted to|not permitted to view|we logged the problem|this problem has been logged|request id|incident id
upstream closed the connection|upstream timed out|while reading the response|connection timed out|connection refused|connection was reset|request timed out|download failed|checksum mismatch|failed to load
access denied|permission denied|you do not have permission|you don't have permission|not authorized to view|request was blocked|blocked by our security|our security rules|too many requests|rate limit exceeded|wait 0 seconds|content unavailable in your region|not available in your region|not available in your country
http 0|proxy error|loading...|loading…|please wait|just a moment|something went wrong|an error has occurred|an error occurred|unexpected error|please try again later|try again later|please retry|contact the administrator|contact your administrator|contact support
scheduled maintenance|down for maintenance|under maintenance|undergoing maintenance|maintenance mode|maintenance in progress|will be back in|will be back soon|we'll be back|be back shortly
cannot read property|of undefined at line|is not set on line|template variable|undefined variable|undefined index|traceback (most recent call last)|fatal error:|syntax error|stack trace|nullpointerexception|segmentation fault
[object object]|undefined undefined|null null|nan nan
page est introuvable|page introuvable|page non trouvée|cette page n'existe|retour à l'accueil|erreur 0|erreur interne|erreur du serveur|accès refusé|accès interdit|service momentanément indisponible|service indisponible|temporairement indisponible|momentanément indisponible|en maintenance|maintenance programmée|veuillez réessayer|réessayez plus tard|une erreur est survenue|une erreur s'est produite
página no encontrada|página no existe|no se encontró la página|artículo solicitado no existe|no existe o fue movido|volver al inicio|error interno del servidor|error del servidor|acceso denegado|acceso prohibido|servicio no disponible|temporalmente no disponible|en mantenimiento|mantenimiento programado|inténtelo más tarde|inténtelo de nuevo|intente más tarde|ha ocurrido un error|se ha producido un error
seite nicht gefunden|seite wurde nicht gefunden|seite existiert nicht|prüfen sie die adresse|zurück zur startseite|fehler 0|interner serverfehler|serverfehler|zugriff verweigert|zugriff nicht erlaubt|dienst nicht verfügbar|vorübergehend nicht verfügbar|wartungsarbeiten|wegen wartung|versuchen sie es später|später erneut|ein fehler ist aufgetreten|es ist ein fehler
页面未找到|页面不存在|找不到页面|找不到该页面|无法找到|返回首页|服务器错误|内部错误|访问被拒绝|拒绝访问|禁止访问|没有权限|服务不可用|暂时不可用|系统维护|正在维护|维护中|请稍后再试|请稍后重试|发生错误|出错了|请求过多|错误 0|错误代码
"""
FILLER = """
sample text|dummy text|placeholder text|text goes here|content goes here|your text here|type your text|add your text|replace with your|with your own content|replace this text|replace with the
abstract to follow|text to follow|details to follow|to be completed|to be added|to be written|to be determined|to be announced|to be confirmed|coming soon|under construction|intentionally left blank|draft - do not|this is a draft
insert results|insert text|insert title|insert abstract|insert figure|insert table|insert paragraph|paragraph here|sampling here|add abstract|add text here|add references|write here|describe here|todo: |todo(|fixme|tbd|to do: |lorem ipsum
résumé à venir|texte à venir|à compléter|à rédiger|à venir|texte ici|votre texte|texte d'exemple|insérer |en construction
resumen pendiente|texto pendiente|por completar|por definir|texto aquí|su texto|texto de ejemplo|texto de muestra|próximamente|en construcción|pendiente de redactar
text folgt|zusammenfassung folgt|wird ergänzt|wird nachgereicht|noch zu ergänzen|hier text|ihr text|beispieltext|blindtext|platzhalter|in bearbeitung|im aufbau
待补充|待完善|待定|示例文本|占位文本|在此处输入|此处插入|请在此|敬请期待|建设中
"""
# Words that only add to the coverage of a telling phrase.
MINOR = """
please|sorry|oops|warning|error|code 0|caption|status|http|http 0|0 error|the page|the article|the document|the file|the record|the table|the supplement|this page|this article|this document|this file|this record|this table|this supplement|to view|for this|no such|reload|reference|reference id|sign in|log in|login|share|reject|settings|accept all|menu|search|cookies|javascript|your browser|in your browser|browser|scripts|the site|this site|this site needs|the archive|about 0 minutes|0 minutes|0 seconds|this takes up to|update it to go on
to view this article|to view this page|to view this content|to read the full text|to read this article|read the full text|to see the rest of this section|in order to read|you must have|the full text of|the requested article is|the requested article|the requested page|the requested url|on this server|on our side|from your network|at line 0|on line 0|and reload|to the article|to continue|to go on
this section|this page|here|before submission|words|0-0 words|describe the|the ids found|the page|your|our|for
pour afficher ce contenu|pour continuer|pour lire|ce contenu|réf|cette page|plus tard|para continuar|para ver|en su navegador|este contenido|el artículo|más tarde|um den volltext zu lesen|um fortzufahren|den volltext|bitte|die adresse|es später|以查看|以继续|本页|内容
"""

# Slots that phrases are built from, each line one kind with the alternatives of its slots.
_SLOTS = """
error: page|article|document|file|record|supplement|site|website|server|service|content|resource|url|link|full text|image|video > not found|could not be found|cannot be found|can't be found|could not be located|does not exist|doesn't exist|no longer exists|no longer available|is not available|not available|is unavailable|unavailable|currently unavailable|is currently unavailable|temporarily unavailable|is temporarily unavailable|temporarily offline|is offline|is down|has expired|failed to load|could not be loaded|cannot be displayed|could not be displayed|could not be retrieved|could not be reached|is under maintenance|is being updated|took too long to respond|refused the connection|did not respond|is not responding|does not respond|encountered an error|returned an error|returned an empty response|can't be reached|cannot be reached|is temporarily offline|is overloaded|is currently overloaded|is busy
error: servers|services|systems > are overloaded|are currently overloaded|are busy|are down|are offline|are unavailable|are not responding
error: proxy|server|database|application|network|gateway|runtime|internal|unknown|fatal|unhandled|parse|render|script > error|exception|failure
error: come back|check back|try again|try once more|reload the page|refresh the page|retry > later|tomorrow|soon|shortly|in a few minutes|in a moment
error: bad|invalid|malformed|expired > request|token|link|url|address|session|certificate
error: page|article|document|ressource|fichier|contenu|site|service|serveur > introuvable|non trouvé|non trouvée|indisponible|est indisponible|n'existe pas|n'existe plus|n'est plus disponible|n'est pas disponible|a été déplacé|a été déplacée|a été supprimé|a été supprimée|en cours de maintenance
error: página|artículo|documento|archivo|recurso|contenido|sitio|servicio|servidor > no encontrada|no encontrado|no existe|ya no existe|no está disponible|ya no está disponible|no disponible|fue movido|fue eliminado|no responde|en mantenimiento
error: seite|artikel|dokument|datei|inhalt|dienst|server|website > nicht gefunden|wurde nicht gefunden|existiert nicht|existiert nicht mehr|ist nicht verfügbar|nicht verfügbar|nicht mehr verfügbar|nicht erreichbar|antwortet nicht|wurde verschoben|wurde gelöscht|wird gewartet
error: 页面|文章|文件|文档|内容|资源|网站|服务器|服务 > 未找到|找不到|不存在|已删除|已被删除|已移动|不可用|无法访问|无法显示|无响应|维护中
notice: enable|activate|turn on|switch on|allow|please allow|accept > javascript|scripts|scripting|cookies|your cookies|all cookies|cookies and javascript
notice: javascript|scripting|cookies|cookie support > required|is required|are required|is needed|are needed|must be enabled|must be turned on|must be switched on|is disabled|are disabled|is off|are off|is switched off|are switched off
notice: log in|login|sign in|subscribe|register|authenticate|create an account > to continue|to proceed|to view|to read|to see|to access|to download|to go on|required|is required|with your account|to your account
notice: requires|needs > javascript|cookies|an active login|an account|a subscription|a modern browser|a newer browser|scripting|you to log in|you to sign in|authentication
notice: browser > is not supported|not supported|is too old|too old|is outdated|does not support javascript|has javascript disabled|blocks scripts|has cookies disabled
notice: activez|veuillez activer|autorisez|acceptez > javascript|les scripts|les cookies
notice: connectez-vous|identifiez-vous|inscrivez-vous|abonnez-vous > pour continuer|pour lire|pour accéder|pour voir|pour afficher
notice: active|habilite|active las|acepte|permita > javascript|los scripts|las cookies|cookies
notice: inicie sesión|regístrese|suscríbase|identifíquese > para continuar|para leer|para ver|para acceder
notice: aktivieren sie|bitte aktivieren sie|erlauben sie|akzeptieren sie > javascript|skripte|cookies|die cookies
notice: melden sie sich an|loggen sie sich ein|registrieren sie sich > um fortzufahren|um weiterzulesen|um zu lesen
notice: activer|autoriser|accepter > javascript|les scripts|les cookies
notice: habilitar|activar|permitir|aceptar > javascript|los scripts|las cookies|cookies
notice: javascript|skripte|cookies > einschalten|aktivieren|erlauben|zulassen|akzeptieren
notice: complete|pass|finish > the security check|a security check|the verification|the human check
notice: 请登录|请先登录|登录后|请注册 > 继续|查看|阅读|访问
notice: 启用|开启|允许|接受 > javascript|脚本|cookie
filler: insert|enter|add|type|write|put|paste|describe|provide > text|title|name|caption|abstract|results|content|summary|description|author|authors|references|keywords|figure|table|your text|your title|your name|your caption|your abstract|the text|the title|the abstract|the caption|the results|text here|title here|name here|caption here|abstract here|figure here|table here|content here|description here
filler: abstract|text|figure|table|figure 0|table 0|caption|results|details|content|summary|discussion|methods|description|references|acknowledgements > to follow|to come|coming soon|to be added|to be completed|to be inserted|to be written|to be supplied|to be provided|goes here|about here|here|pending
filler: résumé|texte|figure|tableau|titre|contenu|légende > à venir|à compléter|à insérer|à ajouter|ici
filler: resumen|texto|figura|tabla|título|contenido > pendiente|por completar|por añadir|por insertar|aquí
filler: zusammenfassung|text|abbildung|tabelle|titel|inhalt > folgt|einfügen|hier einfügen|ergänzen|fehlt noch
filler: 摘要|文本|标题|图|表|内容 > 待补充|待定|待添加|在此|此处
"""


# Words of pages that stand in for content, by language; and words that only join them.
_CORE = """
page pages website site server servers request requests browser browsers cookie cookies javascript script scripts login log sign session sessions account password username subscribe subscription register url http error errors exception timeout unavailable unsupported disabled enabled expired redirect redirecting loading captcha reload refresh retry blocked forbidden unauthorized maintenance downtime technical difficulties domain homepage menu newsletter privacy settings download support desk administrator
article articles document file files content results limit free security check verification institution
navigateur serveur site cookies page erreur connexion connectez session compte requête maintenance javascript contenu rédaction télécharger
navegador servidor sitio cookies página error sesión cuenta solicitud mantenimiento javascript contenido descarga
browser server seite cookies fehler anmelden anmeldung sitzung konto anfrage wartung javascript inhalt datei website webseite
浏览器 服务器 网站 页面 错误 登录 会话 帐户 账户 请求 维护 脚本 本网站 cookie
"""
_GLUE = """
a an the this that these those your you we our us i it its to of in on at for from with by and or but not no is are was be been being has have had can cannot could will would may must should please sorry if then when again later now here there try go going continue see seem seems use uses using used read reading view viewing access full text more back out up about all some any because problem problems found reached reach call click sign 0 processed process failed fail status code need needed required help contact following requested request available country region yet soon home
ce cet cette ces le la les l de du des d un une et ou en est sont a à au aux pour par sur dans vous votre vos nous utilise utilisons veuillez plus tard cours n ne pas être
el la los las un una de del en y o es está son su sus usted para por con este esta estos utiliza utilizamos usa favor más tarde no se ha
der die das den dem ein eine einen und oder in im ist sind nicht sie ihr ihre ihren wir für mit auf zu um diese dieser dieses verwendet verwenden nutzt bitte später wurde werden
使用 请 您 您的 的 了 在 以 本 我们 稍后 再试 无法 需要 继续
"""


def _phrases() -> dict[str, set[str]]:
    """All phrases by kind: those written out, and those that the slots make."""
    words = {kind: {p for p in re.split(r"[|\n]", text) if p.strip()} for kind, text in (("notice", NOTICE), ("error", ERROR), ("filler", FILLER), ("minor", MINOR))}
    for line in filter(None, _SLOTS.split("\n")):
        kind, slots = line.split(": ", 1)
        parts = [slot.split("|") for slot in slots.split(" > ")]
        for way in itertools.product(*parts):
            words[kind] |= {" ".join(way), "".join(way)} if way[0] > "⺀" else {" ".join(way)}
    return words


# The words that filler prose is made of.
_LOREM = frozenset(
    """lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam
    quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu
    fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum nunc porta tortor
    erat vel vestibulum pellentesque vivamus mauris nullam aenean donec praesent phasellus""".split()
)
_KEYS = frozenset("asdf asdfgh asdfghjkl qwer qwerty qwertz azerty zxcv zxcvb hjkl jkl jklö sdfg dfgh fghj qwe asd zxc".split())

# How a placeholder opens and closes; then what its name is made of: any case, lower or upper case.
_PAIRS = """
{{ }} any
{% %} any
{ } lower
{ } upper
${ } any
#{ } any
<% %> any
<< >> any
< > lower
< > upper
&lt; &gt; lower
&lt; &gt; upper
[[ ]] any
[% %] any
[ ] upper
@@ @@ any
%% %% any
__ __ upper
%( )s any
%( )d any
% % upper
$ $ upper
"""
# Elements that texts with mark-up leave open; other tags are told by their end tag.
_ELEMENTS = frozenset("b br col dd dt em hr i img input li link meta ol option p strong sub sup td th tr tt u ul wbr".split())
# What a request in brackets begins with, in five languages.
_ASKS = "insert|enter|add|your|authors?|affiliations?|abstract|title|placeholder|to be|tbd|todo|insérer|ajouter|titre|insertar|añadir|título|einfügen|ergänzen|titel|插入|填写|输入"
_SHEET_ERRORS = ("#ref!", "#n/a", "#value!", "#div/0!", "#name?", "#null!", "#num!")

_WORDS = r"[\p{L}\p{M}]+\d*(?:[_\-. ]?[\p{L}\p{N}]+)*"
_NAMES = {
    "any": regex.compile(rf"[=\-]?\s*{_WORDS}(?:\s+(?:in|as|for|=)\s+{_WORDS})*\s*(?:\|[^{{}}\n]*)?"),
    "lower": regex.compile(r"\p{Ll}+\d*(?:[_\- ][\p{Ll}\d]+){1,2}|\p{Ll}{3,}|\p{Ll}+(?:_[\p{Ll}\d]+)+"),
    "upper": regex.compile(r"\p{Lu}+(?:[_\- ]\p{Lu}+)+|\p{Lu}{3,}|N"),
}
_LONGEST_NAME = 80
_ASKING = regex.compile(rf"\s*(?i:{_ASKS})(?!\p{{L}})[^\[\]\n]*\]|(?<=<)(?i:insert|enter|add|your|insérer|insertar|einfügen)\s[^<>\n]*>")
_LABEL = regex.compile(r"\p{L}\s*:\s*$")  # a label and a line to write on
_COMMAND = regex.compile(r"(?:\\\p{L}+\*?|[\^_])$")  # mark-up whose braces hold text
_PASSAGE = regex.compile(r"(?<=[.!?…])\s+|(?<=[。！？])|\n+")
_SPACED, _HAN = re.compile(r"[\W_]+"), re.compile("[\u2e80-\uffff]")
_TOKEN = regex.compile(r"[\p{L}\p{M}]+|\p{N}+")
_DIGITS, _BLANKS = re.compile(r"\d+"), re.compile(r"[^\S\n]+")


def _openings() -> dict[str, list[tuple[str, str]]]:
    out: dict[str, list[tuple[str, str]]] = {}
    for line in _PAIRS.split("\n"):
        if line:
            opening, closing, name = line.split()
            out.setdefault(opening, []).append((closing, name))
    return out


class Finder:
    """The compiled automata; ``residue`` tells the kind of a text's residue."""

    def __init__(self, coverage: float = COVERAGE) -> None:
        self.coverage, self._pairs = coverage, _openings()
        words = _phrases()
        telling = {p: k for k in ("filler", "error", "notice") for p in words[k]} | dict.fromkeys({w for w in _LOREM if len(w) > 3} | _KEYS | {"test test"}, "hint")
        telling |= dict.fromkeys(self._pairs, "opening") | dict.fromkeys(_SHEET_ERRORS, "sheet") | {"____": "line"} | {"x" * k: "xs" for k in range(3, 16)}
        self._telling = _automaton(telling)
        self._minor = _automaton(dict.fromkeys(words["minor"], "minor"))
        self._core_words = core = frozenset(_CORE.split())
        self._core, self._glue = _automaton(dict.fromkeys(core, "core")), _automaton(dict.fromkeys(set(_GLUE.split()) - core, "glue"))

    def _placeholder(self, text: str, kind: str, start: int, after: int) -> bool:
        """Whether a match of the automaton starts a placeholder: a field's name and the closing follow.

        ``text``: in its own case, numbers written 0.
        """
        opening, before = text[start:after], text[max(0, start - 80) : start]
        if kind != "opening":
            return kind == "sheet" or (kind == "xs" and opening.isupper()) or (kind == "line" and bool(_LABEL.search(before)))
        if opening in ("[", "<") and _ASKING.match(text, after):
            return True
        tight = len(opening) == 1 or opening in ("__", "&lt;")
        for closing, style in self._pairs[opening]:
            end = text.find(closing, after, after + _LONGEST_NAME)
            name = text[after : max(end, after)]
            if not _NAMES[style].fullmatch(name if tight else name.strip()) or (name == "N" and opening not in ("[", "__")):
                continue
            beside = text[start - 1 : start].isalnum() or text[end + len(closing) : end + len(closing) + 1].isalnum()
            if opening in ("__", "%", "$") and beside or opening == "{" and _COMMAND.search(before):
                continue
            if opening in ("<", "&lt;") and (name in _ELEMENTS or f"{opening}/{name}" in text):
                continue
            if opening != "[" or not _is_gloss(name, before):
                return True
        return False

    def _filler(self, passage: str) -> bool:
        """Whether a passage is made of filler words, x's or keys in a row."""
        words = _TOKEN.findall(passage)
        if len(words) < 2:
            return False
        lorem = sum(w in _LOREM for w in words)
        return (
            (all(set(w) == {"x"} for w in words) and max(map(len, words)) >= 3)
            or (len(words) >= 4 and lorem >= 0.75 * len(words) and len(set(words) & _LOREM) >= 3)
            or all(w in _KEYS for w in words)
            or (words.count("test") >= 2 and all(w == "test" or w.isdigit() for w in words))
        )

    def _run_on(self, passage: str, strong: list[tuple[int, int]], covered: bytearray) -> bool:
        """Whether telling phrases stand close together in a passage that goes on with something else."""
        for (i, _), (k, j) in zip(strong, strong[1:]):
            letters = [x for x in range(i, max(i, j)) if passage[x].isalnum()]
            if k > i and len(letters) >= 24 and sum(covered[x] for x in letters) >= 0.8 * len(letters):
                return True
        return False

    def _boilerplate(self, text: str, starts: list[int], ends: list[int]) -> bool:
        """Whether a passage holds hardly any words but those of pages in place of content, and two that name one."""
        by_passage: dict[int, list[tuple[int, int]]] = {}
        for i, j, _ in _matches(self._core, text):
            by_passage.setdefault(bisect.bisect_right(starts, i) - 1, []).append((i, j))
        for k, core in by_passage.items():
            if len({text[i:j] for i, j in core}) < 2:
                continue
            a, passage = starts[k], text[starts[k] : ends[k]]
            letters = [x for x, c in enumerate(passage) if c.isalnum()]
            covered = bytearray(len(passage))
            for i, j in (*((i - a, j - a) for i, j in core), *((i, j) for i, j, _ in _matches(self._glue, passage))):
                covered[i:j] = b"\1" * (j - i)
            if sum(covered[x] for x in letters) >= _NEARLY_ALL * len(letters):
                return True
        return False

    def residue(self, text: str | None) -> str | None:
        """``placeholder``, ``notice``, ``error`` or ``filler``; None for real content.

        Null, empty and blank texts give None.
        """
        if not text or text.isspace():
            return None
        shown = _BLANKS.sub(" ", _DIGITS.sub("0", text.replace("’", "'").replace("İ", "I")))
        plain = shown.lower()
        if len(plain) != len(shown):  # a letter whose lower case is longer
            shown = plain
        found = []
        for i, j, kind in _matches(self._telling, plain):
            if kind in ("opening", "sheet", "line", "xs") and self._placeholder(shown, kind, i, j):
                return "placeholder"
            if kind not in ("opening", "sheet", "line"):
                found.append((i, j, "hint" if kind == "xs" else kind))
        if not found and len(self._core_words.intersection(_SPACED.split(plain))) < 2 and not _HAN.search(plain):
            return None
        cuts = [0, *(x for m in _PASSAGE.finditer(plain) for x in m.span()), len(plain)]
        starts, ends = cuts[::2], cuts[1::2]
        by_passage: dict[int, list[tuple[int, int, str]]] = {}
        for i, j, kind in found:
            by_passage.setdefault(bisect.bisect_right(starts, i) - 1, []).append((i, j, kind))
        for k, inside in by_passage.items():
            a, b = starts[k], max(ends[k], max(j for _, j, _ in inside))
            passage = plain[a:b]
            if any(kind == "hint" for *_, kind in inside) and self._filler(passage):
                return "filler"
            strong = [kind for *_, kind in inside if kind != "hint"]
            if strong:
                covered = bytearray(b - a)
                for i, j, kind in inside:
                    if kind != "hint":
                        covered[i - a : j - a] = b"\1" * (j - i)
                for i, j, _ in _matches(self._minor, passage):
                    covered[i:j] = b"\1" * (j - i)
                letters = [x for x, c in enumerate(passage) if c.isalnum()]
                if letters and sum(covered[x] for x in letters) >= self.coverage * len(letters):
                    return strong[0]
                if self._run_on(passage, [(i - a, j - a) for i, j, kind in inside if kind != "hint"], covered):
                    return strong[0]
        return "notice" if self._boilerplate(plain, starts, ends) else None


def _is_gloss(code: str, before: str) -> bool:
    """Whether a code in brackets abbreviates one of the words before it (``ampicillin [AMP]``), or several by their initials."""
    code, words = code.lower(), re.findall(r"[^\W\d_]+", before.lower())
    if not code.isalpha() or len(code) < 2:
        return False
    for word in words[-3:]:
        letters = iter(word)
        if len(code) < len(word) and word[0] == code[0] and all(c in letters for c in code):
            return True
    return "".join(w[0] for w in words[-len(code) :]) == code


def _automaton(phrases: dict[str, str]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for phrase, kind in phrases.items():
        out.add_word(phrase, (len(phrase), kind))
    out.make_automaton()
    return out


def _matches(automaton: ahocorasick.Automaton, text: str) -> list[tuple[int, int, str]]:
    """Start, end and kind of each match that begins and ends with a word, except in scripts without blanks."""
    out, n = [], len(text)
    for end, (length, kind) in automaton.iter(text):
        i, j = end - length + 1, end + 1
        inside = (i and text[i].isalnum() and text[i] < "⺀" and text[i - 1].isalnum() and text[i - 1] < "⺀") or (j < n and text[end].isalnum() and text[end] < "⺀" and text[j].isalnum() and text[j] < "⺀")
        if not inside:
            out.append((i, j, kind))
    return out


_shared: dict[float, Finder] = {}


def residue_kind(text: Column, coverage: float = COVERAGE) -> Column:
    """The kind of residue that a text is or holds; null for real content.

    Whole texts are read in one pass of the automaton, row by row, so neither
    repeated texts nor a source with a third of all rows matter.
    """

    @F.arrow_udf("string")
    def kinds(texts: pa.Array) -> pa.Array:
        if coverage not in _shared:
            _shared[coverage] = Finder(coverage)
        find = _shared[coverage].residue
        return pa.array([find(t.as_py()) for t in texts], pa.string())

    return kinds.asNondeterministic()(text)  # or a filter on the kind would read every text again


def with_residue(documents: DataFrame, text_col: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """``documents`` with the column ``residue``; keep those where it is null."""
    return documents.withColumn("residue", residue_kind(F.col(text_col), coverage))
