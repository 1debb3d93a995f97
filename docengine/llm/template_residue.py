"""Template residue and error-page text (problem 9)."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from docengine.plans.staging import ship_with_tasks

ship_with_tasks(__name__)

#: A field name inside a placeholder: up to five words of letters, joined by blank, dot, underscore or hyphen.
NAME = r"[\p{L}][\p{L}\p{Nd}]*(?:[ ._-][\p{L}\p{Nd}]+){0,4}"
#: Grammars of unfilled places, one per delimiter.
PLACEHOLDERS = (
    r"\{\{\{?[-#/&]?\s*%(n)s(?:\s*\|[^{}\n]*)?\s*\}?\}\}",
    r"\{%%-?\s*[^{}%%\n]{1,60}-?%%\}",
    r"<%%[=-]?\s*[^<>%%\n]{1,60}-?%%>",
    r"[$#]\{\s*%(n)s(?::[^{}\n]*)?\s*\}",
    r"(?<![$#{\w])\{\s*%(n)s\s*\}(?!\})",
    r"(?<![$#{\w])\{\d{1,2}\}(?!\})",
    r"<<\s*%(n)s\s*>>",
    r"&lt;\s*%(n)s\s*&gt;",
    r"«\s*%(n)s\s*»(?=\s)",
    r"%%%%\s?%(n)s\s?%%%%",
    r"(?<![%%\w])%%[A-Za-z]\w*_?\w*%%(?![%%\w])",
    r"@@\s?%(n)s\s?@@",
    r"\$\$\s?%(n)s\s?\$\$",
    r"##\s?%(n)s\s?##",
    r"(?<![\w_])__[A-Za-z][A-Za-z0-9.]*(?:[_ ][A-Za-z0-9.]+)*__(?![\w_])",
    r"\[\[\s*%(n)s\s*\]\]",
    r"(?i:\[\s*(?:insert|enter|add|fill in|your|choose|select|name of|todo|tbd|tba|einfügen|eingeben|insérer|insertar|introducir)\b[^\[\]\n]{0,60}\])",
    r"(?i:\[[^\[\]\n]{1,40}\bhere\s*\])",
    r"(?i:<\s*(?:your|insert|enter|ihre?|votre|su)\s+[^<>\n]{1,40}>)",
    r"(?i:\bT[OB]D[OA]?:\s*(?:add|insert|fill)\b)",
)
PLACEHOLDER = "(?U)" + "|".join(f"(?:{p % {'n': NAME}})" for p in PLACEHOLDERS)
#: Code in fences, backticks or code tags, where a placeholder is quoted and not left over.
CODE = r"(?s)```.*?```|~~~.*?~~~|`[^`\n]*`|<(code|pre)\b.*?</\1>"
#: Speech that shows a placeholder instead of leaving it unfilled: what stands right before it, and what right after.
SHOWN_BEFORE = r"(?:placeholders?|merge fields?|template tags?|tags?|variables?|syntax|platzhalter|espaces? réservés?|marcador(?:es)? de posición|such as|for example|e\.g\.|written as|write|type|zum beispiel|par exemple|por ejemplo)(?: (?:is|like|called|named|as|wie|ist|comme|est|como|es))?\W{0,3}"
SHOWN_AFTER = r"\W{0,3}(?:(?:is|are|gets?|will be|wird|werden|est|sont|sera|se|es)\s+(?:then\s+)?(?:replaced|filled|rendered|substituted|expanded|ersetzt|remplacée?s?|sustituye|reemplaza)|stands? for|renders? as|steht für)\b"

#: Stand-in phrases: words that each needs one of, and the phrases, in lower case.
FILLER_WORDS = ("lorem", "text", "copy", "content", "filler", "relleno", "factice")
FILLER_PHRASES = (
    r"lorem ipsum|(?:sample|dummy|filler|placeholder|example|your|blind|test) (?:text|copy|content)(?: goes)?(?: here)?|this is (?:placeholder|dummy|sample|filler) (?:copy|text|content)|(?:text|content|copy) (?:goes|to come) here"
    r"|blindtext|platzhaltertext|texte? (?:d'exemple|factice|ici)|texto de (?:relleno|ejemplo|muestra)|faux texte|beispieltext|mustertext|hier (?:steht|folgt|kommt)(?: \p{L}+)? (?:ihr|der|ein|dein) text|ici (?:votre|le) texte|aquí (?:va|irá) (?:el|su) texto"
)

#: A status code where a sentence or line begins.
CODE_FIRST = r"(?m)(?:^|[.!?]\s)\W*(?:http(?:/\d\.\d)?[ :-]*)?[45]\d\d\b"
#: Sentences of failed requests: words of which each pattern's matches hold at least one, and the pattern, in lower case. No words: CODE_FIRST.
ERROR_CUES = (
    ((), r"^\W*(?:http(?:/\d\.\d)?[ :-]*)?(?:[45]\d\d)\b\s*[-:–.]?\s*(?:not found|forbidden|unauthori[sz]ed|bad (?:request|gateway)|internal server error|service|gateway|server|error|page|too many|request|gone|$)"),
    (("error", "fehler", "erreur", "statuscode"), r"^\W*(?:http\s*)?(?:error|fehler|erreur|error code|código de error|statuscode)\s*(?:code|http|nr\.?|n[o°]\.?)?\s*[:#]?\s*[45]\d\d\b|^\W*(?:error|fehler|erreur) (?:reference|id|code|nummer)\s*[:#]"),
    (("http",), r"^\W*http(?:/\d\.\d)?\s+(?:error\s+|status\s+)?[45]\d\d\b"),
    (("found", "gefunden", "encontrad", "trouvée", "introuvable", "exist", "available", "removed", "moved", "verfügbar"), r"\b(?:page|file|document|resource|url|seite|datei|página|archivo|fichier|recurso) (?:you (?:requested|are looking for|asked for|want) |requested |demandée? |solicitad[ao] )?(?:(?:was|were|could|can|cannot|has|does|is|be|not|been|or|moved|no longer|nicht|wurde|konnte|ist|no|non|n'a pas été|est|n'est|pas|fue|ha sido)\s+){0,6}(?:not found|be found|gefunden|encontrad[oa]|trouvée|introuvable|exists?\b|existe\b|existiert|available|verfügbar|removed|moved)"),
    (("server error", "gateway", "forbidden", "unavailable", "too many", "access", "permission", "zugriff", "accès", "acceso", "autorizado", "serverfehler", "interne du serveur", "interno del servidor", "no disponible", "service indisponible", "nicht verfügbar"), r"\b(?:internal server error|bad gateway|gateway time-?out|service (?:temporarily )?unavailable|temporarily unavailable|too many (?:requests|connections|clients)|access (?:to this resource )?(?:is )?denied|permission denied|403 forbidden|zugriff (?:verweigert|nicht gestattet)|accès (?:refusé|interdit)|acceso denegado|no autorizado|interner serverfehler|erreur interne du serveur|error interno del servidor|servicio no disponible|service indisponible|dienst (?:derzeit )?nicht verfügbar)\b"),
    (("wrong", "error", "fehler", "erreur"), r"\b(?:something went wrong|went wrong on our (?:side|end)|an? (?:unexpected|internal|fatal|unknown) error (?:has )?(?:occurred|happened)|ein (?:unerwarteter |interner )?fehler ist aufgetreten|une erreur (?:inattendue |interne )?(?:est survenue|s'est produite)|(?:ha ocurrido|se ha producido|se produjo) un error)\b"),
    (("exception", "error", "stack", "fault"), r"\b(?:[a-z]+\.)+[a-z]*(?:exception|error)\b|\bnullpointerexception\b|\bstack ?trace\b|segmentation fault"),
    (("traceback", "exception", "error"), r"^traceback \(most recent call last\)|^(?:unhandled |uncaught )?[a-z]*(?:exception|error) in thread|^[a-z]*(?:key|value|type|index|runtime|name|import|attribute|io|os|timeout|connection)error\b|^fatal error\b|^(?:php )?(?:fatal|parse|warning) error\b"),
    (("failed", "refused", "reset", "timed out", "error", "could not connect"), r"\b(?:database|db|upstream|server|connection)(?: connection)? (?:failed|refused|reset|timed out|error)\b|\bcould not connect\b|\bconnection (?:refused|reset|timed out)\b|\bsql(?:state|exception)?\b.*\berror\b"),
    (("erreur", "fehler", "error"), r"^(?:erreur|fehler|error)\s*(?:404|500)\b"),
    (("session", "sitzung", "sesión"), r"\b(?:session|sitzung|sesión)\b[^.\n]{0,20}\b(?:expired|timed out|ended|abgelaufen|expirée?|expirad[oa]|caducad[oa])\b"),
    (("failed to load", "could not be", "respond", "timed out", "try again", "verfügbar", "konnte nicht", "permission", "n'a pas pu", "no se pudo", "completar", "disponible", "authori"), r"\b(?:failed to load|could not be (?:located|loaded|displayed|opened)|did not respond|timed out|try again (?:in \d+|later)|derzeit nicht verfügbar|konnte nicht (?:geladen|gefunden|angezeigt) werden|permission to (?:view|access)|n'a pas pu|no se pudo|no pudo completar|n'est pas disponible|no está disponible|not authori[sz]ed to)\b"),
)
#: Demands for scripts, cookies or another browser, in the same form.
SCRIPT_CUES = (
    (("script", "js", "cookie"), r"\b(?:javascript|java script|js|scripts?|scripting|cookies)\b[^.\n]{0,60}\b(?:is|are|be|been|must be|needs? to be|to be|has been|have been|ist|sind|est|está|seems)?\s*(?:disabled|turned (?:on|off)|switched (?:on|off)|blocked|enabled|required|allowed|deaktiviert|ausgeschaltet|aktiviert|blockiert|erforderlich|désactivé\w*|activé\w*|requis|necesario|desactivado|deshabilitado|habilitado|activado)\b"),
    (("script", "js", "cookie", "skripte"), r"\b(?:enable|activate|allow|turn on|switch on|disable|aktivieren|einschalten|zulassen|activer|autoriser|active|activa|activar|habilite|habilita|habilitar|permita)\b[^.\n]{0,40}\b(?:javascript|js|scripts?|scripting|cookies|script blocker|skripte)\b"),
    (("script", "js", "browser", "cookie", "skripte"), r"\b(?:requires?|needs?|benötigt|erfordert|nécessite|requiere|necesita|without|ohne|sans|sin)\b[^.\n]{0,40}\b(?:javascript|js|client-side script(?:s|ing)|scripts? to|a (?:newer|modern|supported|current) browser|skripte|cookies)\b"),
    (("browser", "noscript", "navigateur", "navegador"), r"\bbrowser\b[^.\n]{0,60}\b(?:not support|unsupported|outdated|too old|not supported|nicht unterstützt|unterstützt|veraltet)\b|\bbrowser does not\b|\b(?:update|upgrade|adjust|change|check) (?:your|ihren) browser\b|\bchecking your browser\b|\bnoscript\b|\b(?:navigateur|navegador)\b[^.\n]{0,50}\b(?:obsolète|pas compatible|pas pris en charge|no es compatible|obsoleto|no admite|ne prend pas)\b"),
)
#: Speech about scripts and errors in real content: reports by somebody, and errors that are no failed requests.
REPORTED = r"\b(?:reports?|reported|said|says|wrote|writes|noted|notes? (?:that|down)|explains?|explained|confirmed|confirms|complained|complains|told|mentions?|mentioned|means? that|berichtet|sagte?|schrieb|bestätigt|erklärt|bedeutet|signale|dit que|a écrit|confirme|signifie|informa|dijo|escribió|confirma|significa)\b|\berror rate|fehlerquote|taux d'erreur|tasa de error|paper form|works? without|margin of error|in error\b|clerical error|error of\b"
#: Words of messages about sites, which say nothing of a subject.
SITE_WORDS = "page pages site website server system request requested requests document file resource address url link browser member area features feature required continue reload retry again later please check adjust settings view viewer shown show opening open read display reference error code time sign log back home contact support administrator moved start message seite adresse bitte prüfen sie vorgang später erneut serveur adresse veuillez afficher réessayer plus tard servidor solicitud dirección por favor inténtelo intente".split()

#: Function words of four languages: running text has one every few words, stand-in text has none.
FUNCTION_WORDS = (
    "the of and a in to is for that with on as by it be are at from or an this not can has was if under per no you your all any its when "
    "der die das und ein eine ist zu den dem des mit von für im auf nicht bei nach wird am oder sich als bis sie ihr ihre "
    "le la les de du des et un une est dans pour que qui sur avec par au aux en ne pas se ce ou il elle vous votre "
    "el los las y en un una es por con para del al se su que no lo como si o usted"
).split()

#: Stand-in text has at least so many words, and no function word or at most this share of different words, or so many sentences that
#: are each repeated as often.
MIN_WORDS, MAX_DISTINCT, REPEATS = 8, 0.12, 3
#: Cue text makes the body if it has at least this share of the words of cue and prose, and a sentence is a cue only if at most this
#: share of its words speaks of anything else.
CUE_SHARE, OTHER_SHARE = 0.3, 0.4


def _let(value: Column, body) -> Column:
    """body of the value, which is evaluated once however often the body names it."""
    return F.transform(F.array(value), body)[0]


_GATES = (*[words for words, _ in ERROR_CUES], *[words for words, _ in SCRIPT_CUES], FILLER_WORDS)
_CODE = re.compile(r"[45]\d\d(?!\d)")
_HOLE = re.compile(r"[{}<>\[%@$#«&]|__|tod|tbd")


@F.pandas_udf(IntegerType())
def _gates(text: pd.Series) -> pd.Series:
    """A bit for each cue (and the stand-in phrases, and placeholders) of which the lower-case text holds a word."""

    def bits(t: str | None) -> int:
        low, out = (t or "").lower(), 0
        for i, words in enumerate(_GATES):
            if any(w in low for w in words) if words else _CODE.search(low):
                out |= 1 << i
        return out | (1 << len(_GATES) if _HOLE.search(low) else 0)

    return pd.Series([bits(t) for t in text], dtype="int32")


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"((?U)[\p{L}\p{N}']+)"), 1)


def _possible(low: Column, bits: Column, words: tuple[str, ...], pattern: str) -> Column:
    """Whether a part of the text can match: by its words, then, unless the pattern asks where a part begins, by the whole text."""
    gate = bits.bitwiseAND(F.lit(1 << _GATES.index(words))) != 0
    if not words:
        return gate & low.rlike(CODE_FIRST)
    # without word boundaries the pattern is met in all the more texts, and faster
    return gate if "^" in pattern.replace("[^", "") else gate & low.rlike(pattern.replace(r"\b", ""))


def _cue_words(low: Column, bits: Column, parts: Column, cues: tuple[tuple[tuple[str, ...], str], ...]) -> Column:
    """Words of the parts that are cues: a pattern is met, nobody reports it, and little else is spoken of."""
    gate = F.lit(False)
    for words, p in cues:
        gate = gate | _possible(low, bits, words, p)
    pattern = "(?U)" + "|".join(f"(?:{p})" for _, p in cues)
    known = F.array(*[F.lit(w) for w in sorted({*FUNCTION_WORDS, *SITE_WORDS})])
    other = lambda s: F.size(F.filter(_words(F.regexp_replace(s, pattern, " ")), lambda w: ~F.array_contains(known, w) & w.rlike(r"(?U)^\p{L}{2,}")))
    is_cue = lambda s: s.rlike(pattern) & ~s.rlike("(?U)" + REPORTED) & (other(s) <= OTHER_SHARE * F.size(_words(s)))
    return F.when(gate, F.aggregate(F.filter(parts, is_cue), F.lit(0), lambda n, s: n + F.size(_words(s)))).otherwise(0)


def _unfilled(text: Column, bits: Column) -> Column:
    """Whether a place of a template is left outside code and outside speech that shows it."""
    plain = F.regexp_replace(text, CODE, " ")
    shown = "(?iU)" + f"(?:{SHOWN_BEFORE})(?:{PLACEHOLDER[4:]})|(?:{PLACEHOLDER[4:]})(?:{SHOWN_AFTER})"
    gate = bits.bitwiseAND(F.lit(1 << len(_GATES))) != 0
    return gate & plain.rlike(PLACEHOLDER) & F.regexp_replace(plain, shown, " ").rlike(PLACEHOLDER)


def _judge(text: Column, low: Column, bits: Column) -> Column:
    parts = F.filter(F.split(low, r"(?<=[.!?])\s+|\n"), lambda s: s.rlike(r"\S"))
    scripts, errors = _cue_words(low, bits, parts, SCRIPT_CUES), _cue_words(low, bits, parts, ERROR_CUES)
    stand_in = rf"(?U)\b(?:{FILLER_PHRASES})\b"
    phrases = F.when(_possible(low, bits, FILLER_WORDS, FILLER_PHRASES), F.aggregate(F.filter(parts, lambda s: s.rlike(stand_in)), F.lit(0), lambda n, s: n + F.size(_words(s)))).otherwise(0)
    # Full sentences of real content: a capital letter, six or more words, a full stop, and neither cue nor stand-in phrase.
    every = F.split(text, r"(?<=[.!?])\s+|\n")
    quiet = "(?U)" + "|".join(f"(?:{p})" for _, p in (*SCRIPT_CUES, *ERROR_CUES)) + rf"|\b(?:{FILLER_PHRASES})\b"
    real = lambda s: s.rlike(r"(?U)^\W*\p{Lu}(?:\S*\s+){5,}\S*[.!?]\W*$") & (~F.lower(s).rlike(quiet) | F.lower(s).rlike("(?U)" + REPORTED))
    prose = F.aggregate(F.filter(every, real), F.lit(0), lambda n, s: n + F.size(_words(s)))
    body = F.regexp_replace(low, r"(?m)^\W*\d+(?:\.\d+)+ .*$|^[^|\n]*+\|.*$", " ")
    sentences = lambda t: F.filter(F.split(t, r"(?<=[.!?])\s+|\n"), lambda s: s.contains(" ") & s.rlike(r"[.!?]$"))
    again = lambda t: _let(sentences(t), lambda x: (F.size(x) >= REPEATS) & (F.size(F.array_distinct(x)) * REPEATS <= F.size(x)))
    meaning = lambda t: t.rlike(r"(?U)\b(?:" + "|".join(sorted(set(FUNCTION_WORDS))) + r")\b")
    full = text.rlike(r"(?U)\p{Lu}(?:[^\s.!?]+\s+){5,}[^\s.!?]+[.!?]")
    few = lambda t: _let(_words(t), lambda w: (F.size(w) >= MIN_WORDS) & (~meaning(t) | (F.size(F.array_distinct(w)) <= MAX_DISTINCT * F.size(w))))
    salad = lambda t: F.when(meaning(t) & full, False).otherwise(few(t))
    kinds = F.struct(scripts.alias("scripts"), errors.alias("errors"), phrases.alias("phrases"))
    makes_body = lambda n, p: (n > 0) & (n >= CUE_SHARE * (n + p))
    dense = lambda k: F.when(k["scripts"] + k["errors"] + k["phrases"] > 0, _let(prose, lambda p: (
        F.when(makes_body(k["scripts"], p), "script_notice").when(makes_body(k["errors"], p), "error_page").when(makes_body(k["phrases"], p), "filler"))))
    named = F.coalesce(_let(kinds, dense), _let(body, lambda t: F.when(again(t) | salad(t), "filler")))
    return F.when(_unfilled(text, bits), "placeholder").otherwise(named)


def _defect(text: Column, bits: Column) -> Column:
    return F.when(text.rlike(r"\S"), _let(F.lower(text), lambda low: _judge(text, low, bits)))


def residue(documents: DataFrame) -> DataFrame:
    """doc_id, defect of every document that is left out.

    placeholder: a place of a template that was not filled, outside code and unless the words right beside it show it as an example.
    script_notice, error_page: their cues have at least CUE_SHARE of the words of cues and prose together. filler: stand-in phrases have
    that share, or a few sentences are said over and over, or words come without any function word, or a few words again and again. Null,
    empty and blank texts have no defect; a doc_id that comes twice with the same text gives one row.
    """
    # exploding the one-element array evaluates the defect once; a filter on it would be pushed down and evaluate it again
    gated = documents.select("doc_id", "text", _gates("text").alias("bits"))
    return gated.select("doc_id", F.explode(F.filter(F.array(_defect(F.col("text"), F.col("bits"))), lambda x: x.isNotNull())).alias("defect")).distinct()


def without_residue(documents: DataFrame) -> DataFrame:
    """The documents without a defect, with all their columns and rows; a filter, no join."""
    gated = documents.select("*", _gates("text").alias("_residue_gates"))
    return gated.filter(_defect(F.col("text"), F.col("_residue_gates")).isNull()).drop("_residue_gates")
