"""Template residue and error-page text.

Every cue (or a whole text without cues) is a message. Equal messages are grouped over the corpus first, so a line that a
third of the files share is looked at once. Each distinct message is masked (addresses, dates, numbers), and the hashes of all masked
messages are grouped across documents and sources. Rules classify a message in three strengths: placeholder syntax and phrases that
nobody says decide alone; a bare status or word (`WEAK`) counts where its masked form recurs in two documents; and a message of any wording
counts as a notice of a machine if its masked form recurs across sources and it says, without naming a person, that something
of a machine (`THING`) fails (`FAILS`). The hashes of residue are joined back to the documents.

Rules cost little because a message is tried only by those rules one of whose required literals it holds. These literals are worked
out from the rules' own syntax trees (`required`), so no rule can be missed, and one automaton finds them all in a batch. A rule
without a required literal is tried on every message. Messages decoded with a wrong table are tried in their repaired form too.

Both groupings combine before their shuffle. Defined cases: null and empty texts hold no residue; a text without timings is
one message; a message counts once a document; null sources count as one source; texts of any length are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from re import _constants as K
from re import _parser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.subtitles import cues, unstyled
from siltstone.runtime import cut

_VAR = r"\.?[^\W\d][\w.\[\]-]*(?: \d+)?"
_FIELD = r"(?:[^\W\d_]\w*[_.\[\d][\w.\[\]]*|[^\W\d_]+ \d+|(?:captions?|subtitles?|dialogue|lyrics|speaker|line|cue|translation|title|name|text|episode|season|show|item)\b)"
#: Fixed forms of template languages.
PLACEHOLDERS = {
    "braces": rf"\{{\{{\s*{_VAR}\s*\}}\}}|\{{%-?\s*{_VAR}\s*-?%\}}|[$#]\{{\s*{_VAR}\s*\}}",
    "angle": rf"<%[=-]?\s*{_VAR}\s*-?%>|<<\s*{_VAR}\s*>>|<{_VAR}(?: goes)? here>",
    "percent": rf"%\({_VAR}\)[sdif]|%[^\W\d][\w.\[\]]*(?: \d+)?%|\[%\s*{_VAR}\s*%\]",
    "marks": rf"\$[^\W\d][\w.\[\]]*(?: \d+)?\$|@@\s*{_VAR}\s*@@|\*\|\s*{_VAR}\s*\|\*|__[^\W\d_][\w.\[\]]*?(?: \d+)?__",
    "brackets": rf"\[\[\s*{_FIELD}\s*\]\]|\[insert {_VAR}\]|\[your {_VAR} here\]",
    "todo": r"\b(?:todo|fixme|tbd): ?\S",
}
FILLER = (
    r"\blorem ipsum\b|(?:\basdf\b[ ,]*){2,}|^(?:blah\b[ ,]*){3,}[.!]?$|^x{2,}(?: x{2,})+$|(?:\btext goes here\b[ .,]*){2,}|^text goes here\.?$"
    r"|\bdummy (?:text|subtitle|line)|\bthis is (?:sample|placeholder) text\b|\breplace (?:it|this) before (?:release|publ)"
    r"|^(?:add|insert|enter|type) (?:your |the |a |some )?(?:(?:subtitle|caption|dialogue|title) )?(?:text|subtitle|caption|dialogue|title)(?: here)?[.!]?$"
    r"|\bhier (?:steht|kommt|folgt) (?:sp.{1,2}ter )?(?:der|ihr) text\b|\b(?:tu|tutaj) (?:b.{1,2}dzie|wstaw|wpisz) tekst|\bздесь (?:будет|должен быть) текст|\b(?:aqu.{1,2} va|ici viendra|ici le) (?:el )?texte?o?\b"
    r"|\btexto de relleno\b|\btexte (?:a|à|.{1,2}) remplacer\b|\b(?:platzhalter|blind)text\b|\btekst zast.{1,2}pczy\b|\bтекст[- ]заполнитель|\bзаполните(?:ль)?\b.*\bтекст"
)
_STATUS = (
    r"not found|page not found|forbidden|unauthorized|bad gateway|bad request|gateway time-?out|(?:service|server) (?:temporarily )?unavailable|internal server error|too many requests"
    r"|gone|moved permanently|internal error|interner (?:server-?)?fehler|erreur interne|error interno|внутренняя ошибка|wewn.{1,2}trzny b.{1,2}.?d|(?:die )?seite (?:wurde )?nicht gefunden|zugriff verweigert|dienst nicht verf.{1,2}gbar|page (?:introuvable|non trouv.{1,2}e)|acc.{1,2}s (?:refus.{1,2}|interdit)|passerelle incorrecte|service indisponible"
    r"|p.{1,2}gina no encontrada|servicio no disponible|acceso denegado|страница не найдена|сервис недоступен|доступ (?:запрещ.н|закрыт)|strona nie (?:istnieje|zosta.{1,2}a znaleziona)|nie znaleziono strony"
    r"|us.{1,2}uga niedost.{1,2}pna|brak dost.{1,2}pu|dost.{1,2}p zabroniony"
)
_WORD = r"error|http(?:/\d\.\d)?|status|fehler|erreur|ошибка|błąd|blad|code|fout"
_LOST = r"b[^\x00-\x7f]{1,4}d"  # a word whose letters were lost
ERRORS = (
    rf"^(?:(?:{_WORD})\b[ :]{{0,3}})?[45]\d\d(?: ?[-:.] ?| )(?:{_STATUS})\b|^(?:{_STATUS}) ?\((?:[^\W\d_]+ )?[45]\d\d\)|^(?:{_WORD}) ?:? ?[45]\d\d ?[.:]?$|^http/\d"
    rf"|^(?:{_WORD}) [45]\d\d ?: [^\W\d_]"
    rf"|^{_LOST} [45]\d\d(?: ?[-:.] ?| )(?:{_STATUS})\b|^{_LOST} [45]\d\d ?[.:]?$|^{_LOST} [45]\d\d ?: [^\W\d_]"
    r"|internal failure while|\bfatal error: |\bstack trace:|#\d+ main\(|\btraceback \(most recent|\b(?:file|url|page|resource) \S+ was not found on this server|database connection could not be"
    r"|<code>\w+</code>|\bnosuchkey\b|back end is over capacity|request timed out after \d|download limit reached|this (?:file|video|page) has been removed at the request|\bfile \S+ could not be opened"
    r"|you do not have permission to (?:open|access|view)|session has expired\. |your address has been blocked|something went wrong.{0,3}\s+we can.t find the page|nginx/\d|apache/\d"
)
SCRIPTS = (
    r"\bplease (?:enable|activate|turn on) (?:javascript|scripts|cookies)|enable (?:javascript|scripts) (?:to|in|and)\b|javascript (?:is (?:required|disabled|turned off)|must be)|checking (?:if )?your browser before"
    r"|works best with cookies and scripts|does(?: not|n.t) support (?:java)?scripts?\b|needs? to enable scripts|\bactiver? javascript (?:para|pour)|aktivieren sie javascript|javascript aktivieren"
    r"|включите (?:поддержку )?javascript|javascript.{0,20}(?:включ|отключ)|w.{1,2}.?cz(?:y.{1,2})? (?:obs.{1,2}ug.{1,2} )?javascript|javascript.{0,20}wy.{1,2}.?czon|verify(?:ing)? (?:that )?you are (?:a )?human"
)
#: A line that is nothing but a status of several words.
BARE = rf"^(?!(?:gone|forbidden|unauthorized|not found)\b)(?:{_STATUS})[.!]?$"
#: A status line of any kind with the lines that servers put below one.
TAILED = (
    rf"^(?:{_STATUS})[.!]?\n.*(?:try again later|reference [\w-]+\.|r.{{1,2}}essayer|bitte sp.{{1,2}}ter|keeps happening, contact|back to (?:the )?start|zur.{{1,2}}ck zur|vuelva al inicio|nginy?x?/\d|could not be opened|попробуйте позже|spr.{{1,2}}buj p.{{1,2}}niej)"
)
#: What a program prints for a missing value, as a whole message.
EMPTY = r"^(?:undefined|null|nan|\[object object\])$|^[^\W\d_]+ \d+: (?:null|none|undefined|nan)$"
#: These decide only for messages that recur or stand in page markup.
WEAK = rf"^none$|^(?:{_STATUS})[.!]?$"
#: Things of a machine, ways to say that one fails, and what tells that a person speaks or reports; for messages that recur across sources.
THING = (
    r"\b(?:servers?|services?|player|browser|page|file|clip|video|stream|media|content|connection|session|request|licen[cs]e|playback|download|link|url|database|subtitles?|captions?|track|host|website|cookies?|javascript|scripts?|network|gateway|proxy|account"
    r"|seite|datei|dienst|verbindung|sitzung|anfrage|wiedergabe|fichier|lecteur|serveur|connexion|requête|vidéo|página|archivo|servidor|servicio|conexión|sesión|solicitud|arquivo|serviço|conexão"
    r"|страниц\w*|файл\w*|сервер\w*|сервис\w*|соединени\w*|видео|stron[ay]|plik\w*|serwer\w*|usług\w*|połączeni\w*|sesj\w*|wideo)\b"
)
FAILS = (
    r"\b(?:(?:did|does|do|is|was|are|were|could|can|has|have|had) not|(?:did|does|is|was|are|could|has|have)n't|cannot|can't|unable to|unavailable|not available|no longer available|not found|failed|failure|denied|refused|expired|timed out|time-?out|too many|try again|is required|must be"
    r"|nicht|fehlgeschlagen|abgelaufen|ne (?:peut|répond|fonctionne)|introuvable|indisponible|échoué|expirée?|no (?:se puede|está|encontrad[ao]|disponible|responde|pudo|puede)|não|expiró|expirou"
    r"|недоступ\w*|не (?:найден\w*|отвечает|удалось|может|доступ\w*)|ист[её]к\w*|nie (?:znalezion\w*|odpowiada|można|istnieje|jest)|niedostępn\w*|wygasł\w*)(?!\w)"
)
PERSON = (
    r"\b(?:says?|said|reads|told|sagt|sagte|dit|dice|dijo|говорит|сказал\w*|mówi|powiedział\w*|diz|disse|i|i'm|i've|i'll|you|you're|he|she|we|they|me|him|her|us|them|my|his|our|ich|du|er|wir|mich|mir|dich|mein\w*|dein\w*|je|j|tu|il|elle|nous|vous|mon|ma|yo|él|ella|nosotros|mi|я|ты|он|она|мы|вы|мне|меня|тебя|мой|моя|ja|ty|on|ona|mnie|mój|moja|eu|ele|ela|nós)\b"
)
LONGEST_NOTICE = 200
_PAGE = re.compile(r"</?(?:html|body|head|h\d|p|div|noscript|center|title|br|hr)\b[^<>]*>")
_IN_PAGE = re.compile(r"<(?:html|body|noscript)\b")

#: (category, strength, pattern, flags, whether page tags are taken away first); the first strong one that holds names the category.
RULES = [
    *(("placeholder", "strong", p, 0, False) for p in PLACEHOLDERS.values()), ("placeholder", "strong", EMPTY, 0, True), ("filler", "strong", FILLER, 0, True),
    ("error", "strong", ERRORS, re.M, True), ("error", "strong", BARE, re.M, True), ("error", "strong", TAILED, re.S, True), ("script", "strong", SCRIPTS, 0, True),
    ("error", "weak", WEAK, re.M, True), ("error", "thing", THING, 0, True),
]
#: (the table a text was read with, the one it was written in).
MISREAD = [("cp1252", "utf-8"), ("latin-1", "utf-8"), ("cp1251", "utf-8"), ("cp1250", "utf-8"), ("cp1252", "cp1251"), ("latin-1", "cp1251"), ("cp1252", "cp1250"), ("latin-1", "iso8859-2")]

_DATE = r"\d{1,4}[-./]\d{1,2}[-./]\d{1,4}(?:[ t]\d{1,2}:\d{2}(?::\d{2})?)?"
_ADDRESS = r"(?:https?://|www\.)\S+|\S+@\S+\.\w+|\b[\w-]+(?:\.[\w-]+)*\.(?:example|invalid|com|org|net|srt|vtt|sub|php|html?)\b(?:/\S*)?"
_MASKS = [(re.compile(_ADDRESS), "<a>"), (re.compile(_DATE), "<d>"), (re.compile(r"\d+"), "0"), (re.compile(r"[^\S\n]+"), " ")]


def masked(low: str) -> str:
    """A lower-case message with dates, addresses and numbers masked and blanks unified; line breaks stay."""
    if "." in low or "/" in low or "@" in low or any(map(str.isdigit, low)):
        for p, sign in _MASKS[:3]:
            low = p.sub(sign, low)
    return _MASKS[3][0].sub(" ", low)


def required(pattern: str, flags: int = 0) -> set[str] | None:
    """Literals of which every match of the pattern holds at least one; None where there are none such."""
    return _required(_parser.parse(pattern, flags))


def _required(tree) -> set[str] | None:
    found, run = [], ""
    for op, arg in tree:
        if op is K.LITERAL:
            run += chr(arg)
            continue
        if op is K.MAX_REPEAT or op is K.MIN_REPEAT:
            least, _, body = arg
            if least and len(body) == 1 and body[0][0] is K.LITERAL:
                found.append({run + chr(body[0][1]) * least})
                run = ""
                continue
            inner = _required(body) if least else None
        elif op is K.SUBPATTERN:
            inner = _required(arg[3])
        elif op is K.BRANCH:
            each = [_required(b) for b in arg[1]]
            inner = set().union(*each) if all(each) else None
        elif op is K.IN and len(arg) <= 3 and all(x[0] is K.LITERAL for x in arg):
            inner = {run + chr(x[1]) for x in arg}
            found.append(inner)
            run = ""
            continue
        elif op is K.AT:
            continue
        else:
            inner = None
        if run:
            found.append({run})
            run = ""
        if inner:
            found.append(inner)
    if run:
        found.append({run})
    return max(found, key=lambda s: min(map(len, s)), default=None)


@cache
def _machine():
    """(automaton over the required literals of all rules, rules tried on every message, compiled rules)."""
    import ahocorasick

    by, always = {}, []
    for k, (_, _, p, flags, _) in enumerate(RULES):
        need = required(p, flags)
        if need is None:
            always.append(k)
        for word in need or ():
            by.setdefault(word, set()).add(k)
    found = ahocorasick.Automaton()
    for word, ks in by.items():
        found.add_word(word, tuple(ks))
    found.make_automaton()
    return found, always, [re.compile(p, flags) for _, _, p, flags, _ in RULES], re.compile(FAILS), re.compile(PERSON)


def repaired(low: str) -> list[str]:
    """A message's other readings, where it may have been decoded with a wrong table."""
    out = []
    if not low.isascii():
        for read, written in MISREAD:
            try:
                text = low.encode(read).decode(written).lower()
            except UnicodeError:
                continue
            if text != low and text not in out:
                out.append(text)
    return out


def strength(low: str, rules: set[int]) -> tuple[str | None, str | None, bool]:
    """(strong category, weak category, whether it reads like a machine's notice) of a lower-case message, by the rules to be tried."""
    _, _, compiled, fails, person = _machine()
    bare, strong, weak, notice = None, None, None, False
    for k in sorted(rules):
        category, kind, _, _, without_tags = RULES[k]
        if without_tags and bare is None:
            bare = _PAGE.sub("", low)
        if not compiled[k].search(bare if without_tags else low):
            continue
        if kind == "strong":
            return category, None, False
        if kind == "weak":
            weak = category
            if _IN_PAGE.search(low):
                strong = category
        else:
            notice = len(bare) <= LONGEST_NOTICE and bool(fails.search(bare)) and not person.search(bare)
    return strong, weak, notice


def _classified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds mask, strong, weak and notice to (message, low, n, s1, s2)."""
    machine, always, _, _, _ = _machine()
    for b in batches:
        lows = [t or "" for t in b.column(1).to_pylist()]
        texts, owner = list(lows), list(range(len(lows)))
        for k, low in enumerate(lows):
            for other in repaired(low):
                texts.append(other)
                owner.append(k)
        tried: dict[int, set[int]] = {k: set(always) for k in range(len(texts))} if always else {}
        at, ends = 0, []
        for t in texts:
            at += len(t) + 1
            ends.append(at)
        k = 0
        for end, rules in machine.iter("\x00".join(texts)):
            while end >= ends[k]:
                k += 1
            tried.setdefault(k, set()).update(rules)
        strong, weak, notice = [None] * len(lows), [None] * len(lows), [False] * len(lows)
        for k, rules in tried.items():
            s, w, m = strength(texts[k], rules)
            o = owner[k]
            strong[o], weak[o], notice[o] = strong[o] or s, weak[o] or w, notice[o] or m
        mask = pa.array([masked(t) for t in lows], pa.string())
        yield pa.RecordBatch.from_arrays(
            [b.column(0), mask, b.column(2), b.column(3), b.column(4), pa.array(strong, pa.string()), pa.array(weak, pa.string()), pa.array(notice)],
            names=["message", "mask", "n", "s1", "s2", "strong", "weak", "notice"],
        )


def messages(documents: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(key, source, message), each message once a document."""
    return documents.select(
        F.col(key).alias("k"), F.col(source).alias("s"), F.explode(F.array_distinct(cues(F.col(text)))).alias("message")
    )


def _print(message: str, names: tuple[str, str] = ("h1", "h2")) -> list[Column]:
    """128 bits of a message."""
    return [F.xxhash64(message).alias(names[0]), F.xxhash64(F.lit(7), message).alias(names[1])]


def residue_messages(documents: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", recur: int = 2) -> DataFrame:
    """(message, mask, category, documents, several_sources) of the raw messages that are residue."""
    named = F.xxhash64("s")  # null sources count as one; numbers keep the grouping hashed, where names would have it sorted
    raw = messages(documents, key, text, source).groupBy("message").agg(F.count("*").alias("n"), F.min(named).alias("s1"), F.max(named).alias("s2"))
    read = raw.select("message", F.lower(unstyled(F.col("message"))).alias("low"), "n", "s1", "s2").mapInArrow(
        _classified, "message string, mask string, n long, s1 long, s2 long, strong string, weak string, notice boolean"
    )
    hit = F.col("strong").isNotNull() | F.col("weak").isNotNull() | F.col("notice")
    one = lambda c: F.when(hit, F.col(c))
    every = cut(read.select(*_print("mask", ("m1", "m2")), "n", "s1", "s2", one("message").alias("message"), one("mask").alias("mask"), "strong", "weak", "notice"))
    groups = every.groupBy("m1", "m2").agg(F.sum("n").alias("documents"), (F.min("s1") < F.max("s2")).alias("several_sources"))
    again = F.col("documents") >= recur
    category = F.coalesce("strong", F.when(again, F.col("weak")), F.when(again & F.col("several_sources") & F.col("notice"), F.lit("notice")))
    return (
        every.filter("message is not null").select("m1", "m2", "message", "mask", "strong", "weak", "notice").join(groups, ["m1", "m2"])
        .withColumn("category", category).filter("category is not null")
        .select("message", "mask", "category", "documents", "several_sources")
    )


def residue_documents(documents: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Distinct keys of documents that hold residue."""
    bad = residue_messages(documents, key, text, source).select(*_print("message"))
    every = messages(documents, key, text, source).select("k", *_print("message"))
    return every.join(bad, ["h1", "h2"], "left_semi").select(F.col("k").alias(key)).distinct()


def without_residue(documents: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The documents without residue."""
    return documents.join(residue_documents(documents, key, text, source), key, "left_anti")
