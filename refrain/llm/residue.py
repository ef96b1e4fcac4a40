"""Template residue, filler, error pages and notices in place of content (problem 10).

Texts are cut into messages (lines, and sentences within lines). In each message numbers, codes,
dates, addresses, placeholders and quoted titles are masked, and so are runs of filler words and the subject of a
notice ("the player" in "the player failed to load"). Messages are grouped by the exact hash of what
is left, over all documents and sources. Phrase rules then classify the groups that recur in several
documents and sources. One message alone is judged by the syntax of templates and of programs only:
placeholders, bare error objects, mark-up skeletons.

Messages without any word that some rule asks for are left out before the grouping, as no rule could name their group.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refrain.io import cut, load
from refrain.skew import hot_keys, spread_join

#: Sources and documents in which a message must recur, and documents for a weak rule.
SOURCES, DOCUMENTS, WEAK_DOCUMENTS = 2, 2, 3

_NAME = r"[A-Za-z_][\w.]*(?: [\w.]+)?"
# The ways in which templates mark a value to be filled in.
_PLACEHOLDER = re.compile(
    rf"\{{\{{\s*{_NAME}\s*\}}\}}|\$\{{\s*{_NAME}\s*\}}|#\{{\s*{_NAME}\s*\}}|\{{%.*?%\}}|\{{\s*{_NAME}\s*\}}|<%=?\s*{_NAME}\s*%>|@@{_NAME}@@|__[A-Za-z][A-Za-z.]*(?:_[A-Za-z.]+)*__"
    rf"|%[A-Za-z][A-Za-z.]*(?:_[A-Za-z.]+)*%|\[\[\s*{_NAME}\s*\]\]|\[[A-Za-z][A-Za-z.]*(?:_[A-Za-z.]+)*\]|<(?!/?(?:{'|'.join(['h[1-6]', 'b', 'i', 'u', 'p', 'a', 'br', 'hr', 'em', 'li', 'ul', 'ol', 'div', 'span', 'strong', 'html', 'head', 'body', 'title', 'center', 'blockquote', 'code', 'pre', 'table', 'tr', 'td', 'th', 'img', 'small', 'sup', 'sub', 'font', 'q', 's', 'tt', 'cite', 'mark', 'section', 'article'])})\b)[A-Za-z][A-Za-z.]*(?:_[A-Za-z.]+)*>"
)
_FORUM = re.compile(r"\[/?(?:b|i|u|s|quote|url|img|code|list|HQ|size|color|spoiler)\b[^\]]{0,60}\]|\[(?:live|remix|acoustic|demo|HQ|edit|mono|stereo)\]", re.I)
_ADDRESS = re.compile(r"https?://\S+|www\.\S+|\S+@\S+\.\w+")
_DATE = re.compile(r"\b\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}\b|\b\d{1,2}:\d\d(?::\d\d)?\b")
_CODE = re.compile(r"\b[a-f]*\d[0-9a-f]{5,}\b", re.I)
_NUMBER, _DIGIT, _QUOTE, _LETTERS, _MASKED = re.compile(r"\d+"), re.compile(r"\d"), re.compile("[“«\"„]"), re.compile(r"[^\W\d_]+"), re.compile("⟨[a-z]+⟩")
_QUOTED = re.compile(r"“[^”]{1,80}”|«[^»]{1,80}»|\"[^\"\n]{1,80}\"|„[^“]{1,80}“")
_CUT = re.compile(r"(?<=[.!?…。])\s+(?=\S)")

# Words of filler text, by kind.
_LATIN = set(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud "
    "nunc ligula mollis sonare cantus quam ante vitae porta orbis velum fusce".split()
)
_NOISE = {"bla", "blah", "xx", "xxx", "xxxx", "text", "test", "testing", "asdf", "qwe", "qwer", "foo", "bar", "baz", "dummy", "loading"}

# Subjects of notices and what notices say of them, by language.
_NOTICES = (
    (r"(?:the|this|your|that) (?:\w+ ){0,2}\w+ ", r"(?:could not be loaded|timed out\b\W*(?:$|-)|failed to (?:render|load)|(?:is|are) (?:temporarily |currently )?unavailable|(?:is|are) blocked in your|requires? an? (?:signed-in|account|login)|ha(?:s|ve) been removed at the request|needs? scripts)"),
    (r"(?:der|die|das|diese[rs]?|ihre?) (?:\w+ ){0,2}[\w-]+ ", r"(?:konnten? nicht geladen werden|wurden? entfernt\W*(?:$|-)|(?:ist|sind) (?:zurzeit|derzeit) nicht (?:erreichbar|verfügbar)|(?:ist|sind) nur nach anmeldung|benötigt eingeschaltete|(?:ist )?in ihrem land nicht verfügbar)"),
    (r"(?:la|le|les|cette|cet|ce|votre|l') ?(?:[\w'’]+ ){0,4}[\w'’]+ ", r"(?:n['’]a pas pu être|n['’]ont pas pu être|a été supprimée?s?\W*(?:$|-)|(?:est|sont) réservée?s? aux membres|(?:est|sont) momentanément indisponibles?|exige(?:nt)? l['’]activation|n['’]est pas disponible dans votre)"),
    (r"(?:la|el|los|las|esta|este|tu) (?:\w+ ){0,4}\w+ ", r"(?:no se han? podido cargar|fue(?:ron)? eliminad[ao]s?\W*(?:$|-)|solo (?:es|son) visibles? para|no está(?:n)? disponibles? (?:por ahora|en tu)|necesitan? que actives)"),
)
# Rules on a masked message in lower case. These hold where a message begins ...
_BEGINS = (
    r"(?:error |erreur |fehler )?⟨n⟩\W{0,3}(?:not found|gone|forbidden|bad gateway|service (?:temporarily )?unavailable|internal server error|unauthori[sz]ed|page missing|gateway time-?out|bad request|too many requests|moved permanently|page not found)\W*$",
    r"(?:error|erreur|fehler) ⟨n⟩ ?[:–-] ",
    r"(?:please |you need to |kindly )?(?:enable|activate|turn on) javascript\b|javascript is (?:turned off|disabled|required)|(?:veuillez )?activer? javascript|activa javascript|bitte aktivieren sie javascript|(?:this|our|the) (?:site|page|player|app) (?:requires|needs|uses) (?:scripts|javascript|cookies)|habilita javascript|javascript (?:muss|must|doit|debe)",
    r"(?:we (?:use|value) |wir verwenden |nous utilisons |utilizamos |usamos |this (?:site|website) uses |we and our partners ).*(?:cookie|privacy|datos|données)|accept all (?:cookies )?\||alle akzeptieren|tout accepter|aceptar tod",
    r"(?:you (?:must|need to|have to) )?(?:please )?(?:log|sign) ?in (?:again )?(?:to|or)\b|you must be logged in|(?:bitte )?melden sie sich an|connectez-vous|inicia sesión|your session has expired|anmelden, um",
    r"diese seite wurde leider nicht gefunden|la página que buscas no existe|the page you (?:asked|are looking|requested|were looking)|(?:sorry, )?(?:this|the) page (?:could not be|cannot be|was not|can't be) found|page (?:not found|introuvable|missing)\W*$|seite nicht gefunden\W*$|página no encontrada",
    r"(?:this|the) (?:item|track|album|video|content|recording|page) is (?:not available|unavailable|currently unavailable)|not available in your (?:country|region)",
    r"(?:the )?(?:artist )?(?:profile|page|account|record|listing|entry) has been removed",
    r"access denied\W|you (?:do not|don't) have permission|zugriff verweigert|accès refusé|acceso denegado",
    r"too many requests|rate limit exceeded|slow down and come back",
    r"(?:we are|we're|the site is) (?:currently )?down for maintenance|wartungsarbeiten|site en maintenance|en mantenimiento",
    r"your browser is (?:out of date|not supported|no longer supported)|(?:turn off|disable) your (?:ad ?)?blocker",
    r"prove you are not a robot|checking (?:that you are human|your browser)|(?:please )?verify (?:that )?you are (?:a )?human|i am not a robot",
    r"oops! something went wrong|something went wrong on our|an (?:unexpected |internal )?error (?:has )?occurred",
    r"this is a test (?:review|post|entry|page|comment)|dies ist ein test|ceci est un test|esto es una prueba",
    r"your text here|sample text\W|texto de ejemplo|hier steht später der text|texte (?:d'exemple|à venir|de remplacement)|ici (?:viendra|bientôt) le texte|(?:text|inhalt) folgt\W*$|insert text here",
    r"no (?:biography|description|review|lyrics|text) (?:has|have) been added|sin (?:descripción|biografía|texto)\W*$|aucune? (?:biographie|description|texte) (?:pour le moment|disponible)|noch keine? (?:beschreibung|biografie|text|rezension)|(?:description|biography|lyrics|review|text|credits) (?:not yet available|not available yet|coming soon|to follow)|(?:lyrics|biography|description|content) (?:is|are) not available",
    r"(?:coming soon|loading|bientôt disponible|próximamente|demnächst)[\W]*(?:loading\W*)*$",
)
# ... and these anywhere in it.
_ANYWHERE = (
    r"placeholder paragraph|la page demandée n['’]existe plus",
)
_PHRASES = re.compile("(?:" + "|".join([*_BEGINS, *("⟨s⟩ " + said for _, said in _NOTICES)]) + ")|.*?(?:" + "|".join(_ANYWHERE) + ")")
_SUBJECT = re.compile("|".join(f"(?:{subject}(?={said}))" for subject, said in _NOTICES))
# The syntax of templates and programs, at the beginning of a message and anywhere; one message is enough.
_SYNTAX_BEGINS = (
    r"\[insert [^\]]+\]",
    r"(?:todo|tbd|fixme)\b ?:",
    r"\{ ?\"?(?:error|status|message|code)\"? ?:",
    r"traceback \(most recent call last\)|file (?:\"?[^ ]+\.py\"?|⟨t⟩), line|\w*error: '|(?:fatal error|warning|notice|parse error): .*(?:exception|mysql|undefined|\.php|no such)",
)
_SYNTAX_ANYWHERE = (
    r"\b(?:undefined|null|nan) by (?:undefined|null|nan)\b|\bnan-nan-nan\b|\[object object\]",
    r"<html>.*<title>",
)
_SYNTAX = re.compile("(?:" + "|".join(_SYNTAX_BEGINS) + ")|.*?(?:" + "|".join(_SYNTAX_ANYWHERE) + ")")
_TAIL, _END = re.compile(r"\s*[-–—|·(\[]\s*[\w ]{0,30}⟨n⟩[])]?[.!?…]*$"), re.compile(r"[.!?…,;:]+$")
# Strings of which a message must hold one to be residue by any rule here; a text without them is done.
TRIGGERS = (
    "{", "<%", "@@", "__", "%", "[", "<", "|", "undefined", "null", "nan-", "todo", "tbd", "fixme", "traceback", ", line", "error", "erreur",
    "fehler", "warning", "notice", "script", "skript", "cookie", "privacy", "datos", "données", "akzeptieren", "accept", "aceptar", "log in", "login",
    "logged", "sign in", "signed", "signin", "melde", "connectez", "sesión", "expired", "gefunden", "not found", "reload", "captcha", "try again", "members only", "sign up", "subscribe", "support", "page expired", "encontrada", "no existe", "existe plus",
    "the page", "page you", "missing", "introuvable", "gone", "forbidden", "gateway", "unavailable", "unauthor", "time-out", "timeout", "bad request",
    "requests", "moved", "not available", "available in your", "be loaded", "timed out", "failed to", "blocked", "require", "needs", "removed",
    "geladen", "entfernt", "nicht erreichbar", "nicht verfügbar", "anmeld", "benötigt", "pas pu", "supprim", "réserv", "indisponible", "activ",
    "pas disponible", "podido cargar", "eliminad", "solo es", "solo son", "no está", "necesita", "denied", "permission", "verweigert", "refusé",
    "denegado", "rate limit", "slow down", "maintenance", "wartung", "mantenimiento", "browser", "blocker", "robot", "human", "something went",
    "test", "prueba", "text here", "sample text", "texto de", "der text", "texte", "ici ", "folgt", "been added", "sin descripción", "sin biografía",
    "sin texto", "aucun", "noch kein", "coming soon", "to follow", "not yet", "loading", "bientôt", "próximamente", "demnächst", "placeholder",
    "lorem", "ipsum", "dolor", "amet", "fusce", "velum", "mollis", "ligula", "sonare", "cantus", "orbis", "consectetur", "bla ", "xx", "asdf", "qwe",
    "dummy", "foo bar", "be found", "nan by",
)
# Words of a notice, for messages that no rule names but that recur in several sources.
_WEAK = re.compile(r"\b(?:unavailable|try again|reload|not supported|members only|sign up|subscribe|page expired|maintenance|captcha|contact support|support ticket|permission)\b")
# What texts say that write about such marks, errors or notices.
_ABOUT = re.compile(
    r"\b(?:the words|samples?|named the|as (?:its|a) chorus|filler text on|i got error|expands? to|the mask|exporter|understands|as variables|notation|the script|type the|pattern box|check that|tag editor|"
    r"screenshot|poster|lyrics? of|joke|sentence you are|title of|refrain|in the manual|reads? the)\b"
)


@lru_cache(maxsize=1)
def _triggers() -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    for t in TRIGGERS:
        automaton.add_word(t)
    automaton.make_automaton()
    return automaton


def _may_hold(text: str) -> bool:
    """Whether any rule can hold in ``text``, given in lower case."""
    return next(_triggers().iter(text), None) is not None


def mask(message: str) -> str:
    """A message with its changing parts masked, lower case and single spaces."""
    text = message
    if "[" in text:
        text = _FORUM.sub(" ", text)
    if any(c in text for c in "{%<[@_"):
        text = _PLACEHOLDER.sub("⟨p⟩", text)
    if "//" in text or "www." in text or "@" in text:
        text = _ADDRESS.sub("⟨address⟩", text)
    if _DIGIT.search(text):
        text = _NUMBER.sub("⟨n⟩", _CODE.sub("⟨n⟩", _DATE.sub("⟨date⟩", text)))
    if "{" not in text[:2] and "<html" not in text[:8] and _QUOTE.search(text):
        text = _QUOTED.sub("⟨t⟩", text)
    return " ".join(text.lower().split())


def normal_form(message: str) -> str:
    """What is hashed of a masked message: without leading signs and a last code, filler as one mark, the subject of a notice masked."""
    text = message.lstrip("-–•*>#[]!|=~/⚠ ") or message
    words = _LETTERS.findall(_MASKED.sub(" ", text))
    if len(words) >= 3:
        latin = [w for w in words if w in _LATIN]
        if len(latin) >= 0.7 * len(words) and sum(len(w) > 3 for w in latin) >= 2:
            return "⟨filler⟩"
        if sum(w in _NOISE or set(w) == {"x"} for w in words) >= 0.8 * len(words):
            return "⟨filler⟩"
    if m := _SUBJECT.match(text):
        text = "⟨s⟩ " + text[m.end() :]
    return _END.sub("", _TAIL.sub("", _END.sub("", text))) or text


def by_syntax(message: str) -> bool:
    """Whether a masked message is residue by the syntax of templates and programs, however often it occurs."""
    if _ABOUT.search(message):
        return False
    bare = message.lstrip("-–•*>#[]!|=~/⚠ ") or message
    return "⟨p⟩" in message or bool(_SYNTAX.match(message) or _SYNTAX.match(bare))


def strength(form: str) -> int:
    """2 if a phrase rule names the normal form of a group, 1 if only a weak one does, 0 otherwise."""
    if _ABOUT.search(form):
        return 0
    if form == "⟨filler⟩" or _PHRASES.match(form):
        return 2
    return int(bool(_WEAK.search(form)))


def messages_of(text: str | None) -> list[tuple[str, bool]]:
    """(normal form, by syntax) of the messages of a text that some rule may hold for, each once: sentences of its lines, and lines with mark-up. Null gives none."""
    if not text or not _may_hold(text.lower()):
        return []
    out: dict[str, bool] = {}
    for line in text.split("\n"):
        line = line.strip()
        if not line or not _may_hold(line.lower()):
            continue
        pieces = _CUT.split(line)
        if len(pieces) > 1 and any(c in line for c in "{<["):
            pieces.append(line)
        for piece in pieces:
            if _may_hold(piece.lower()) and (masked := mask(piece)):
                form = normal_form(masked)
                out[form] = out.get(form, False) or by_syntax(masked)
    return list(out.items())


def messages(documents: DataFrame) -> DataFrame:
    """(doc_id, source, form, syntax) of all messages that some rule may hold for. Null and empty texts give no row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(d, s, m, n) for d, s, t in zip(b["doc_id"], b["source"], b["text"]) for m, n in messages_of(t)]
            yield pd.DataFrame(rows, columns=["doc_id", "source", "form", "syntax"])

    texts = documents.select("doc_id", "source", "text").where(F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    return texts.mapInPandas(run, "doc_id long, source string, form string, syntax boolean")


def groups(rows: DataFrame) -> DataFrame:
    """(hash, form, strength, n_documents, n_sources) of the groups of ``messages()`` by the exact hash of their form, classified where they recur.

    Strength is 0 for groups that don't recur in ``SOURCES`` and ``DOCUMENTS``. A document counts once, for its first source.
    """
    keyed = rows.withColumn("hash", F.xxhash64("form")).groupBy("hash", "doc_id").agg(F.min("form").alias("form"), F.min("source").alias("source"))
    per_source = keyed.groupBy("hash", "source").agg(F.min("form").alias("form"), F.count("*").alias("n"))
    grouped = per_source.groupBy("hash").agg(F.min("form").alias("form"), F.sum("n").alias("n_documents"), F.count("source").alias("n_sources"))

    @F.pandas_udf("int")
    def classify(form: pd.Series) -> pd.Series:
        return form.map(strength).astype("int32")

    recurring = grouped.where((F.col("n_sources") >= SOURCES) & (F.col("n_documents") >= DOCUMENTS))
    return recurring.withColumn("strength", classify("form"))


def residue_groups(rows: DataFrame) -> DataFrame:
    """Those of ``groups()`` that a phrase rule names, or a weak one if they recur in ``WEAK_DOCUMENTS``."""
    return groups(rows).where((F.col("strength") == 2) | ((F.col("strength") == 1) & (F.col("n_documents") >= WEAK_DOCUMENTS)))


def found(spark: SparkSession, folder: str) -> DataFrame:
    """p10_found: every document that holds residue."""
    rows = cut(messages(load(spark, folder, "documents")))
    hashed = rows.select("doc_id", F.xxhash64("form").alias("hash"))
    recurring = spread_join(hashed, residue_groups(rows).select("hash"), ["hash"], ["doc_id"], "left_semi", hot=hot_keys(hashed, ["hash"])).select("doc_id")
    return recurring.unionByName(rows.where("syntax").select("doc_id")).distinct()


def report(spark: SparkSession, folder: str) -> DataFrame:
    """p10_messages: the recurring groups of residue messages with their documents and sources."""
    return residue_groups(messages(load(spark, folder, "documents"))).select(F.col("form").alias("message"), "strength", "n_documents", "n_sources")
