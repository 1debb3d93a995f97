"""Broken prompt and response pairs (problem 4): empty, truncated, refused, copied and other-language answers."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from docengine.plans.staging import ship_with_tasks, small_side, stage

ship_with_tasks(__name__)

#: What stands for no answer when it is all there is.
NO_ANSWER = "none null nil nan na n/a undefined unknown tbd todo empty blank void response answer output result reply a r antwort réponse respuesta keine kein aucune aucun ninguna ninguno vacío leer vide".split() + [
    "no answer", "no response", "no reply", "no data", "no content", "no result", "not available", "not applicable", "no answer available", "keine antwort", "keine angabe", "k a", "k.a", "sin respuesta",
    "sin datos", "aucune réponse", "sans réponse", "pas de réponse", "s/o", "n.a", "n.v", "nicht verfügbar", "no disponible", "non disponible", "the answer is", "here is the answer",
]

#: Sentences that decline, in the four languages of the requests.
REFUSALS = (
    "i am sorry but i can not help with that request",
    "i am sorry but i can not assist with that",
    "i am sorry i can not answer that question",
    "i can not help with this",
    "i can not provide that information",
    "i can not answer this question",
    "i am unable to answer this question",
    "i am unable to help with that request",
    "i am not able to answer questions of this kind",
    "i am not able to help with that",
    "i am not allowed to discuss this topic",
    "i am not in a position to comment on this",
    "unfortunately this is something i can not assist with",
    "unfortunately i can not help with this request",
    "sorry no answer can be given here",
    "sorry i can not do that",
    "as an automated assistant i must decline to give a view on this",
    "as an ai language model i can not answer that",
    "as an assistant i have to refuse to answer",
    "i must decline to answer",
    "i have to decline this request",
    "i would rather not respond to that",
    "i would prefer not to answer that",
    "i have to pass on this one the topic is off limits",
    "i have to pass on this one please ask a person",
    "this request can not be answered here",
    "i will not answer that question",
    "my guidelines do not allow me to discuss",
    "my instructions do not permit me to answer this",
    "it would not be appropriate for me to advise on",
    "it is not appropriate for me to comment on",
    "no comment on this question",
    "es tut mir leid dabei kann ich nicht helfen",
    "es tut mir leid aber ich kann diese frage nicht beantworten",
    "dazu kann ich leider keine auskunft geben",
    "leider kann ich diese frage nicht beantworten",
    "leider kann ich ihnen dabei nicht helfen",
    "als assistent muss ich die antwort ablehnen",
    "ich kann diese anfrage nicht bearbeiten",
    "ich darf dazu nichts sagen",
    "diese frage möchte ich nicht beantworten",
    "je suis désolé je ne peux pas répondre à cette demande",
    "je suis désolé mais je ne peux pas vous aider",
    "il m est impossible de traiter cette question",
    "en tant qu assistant je dois refuser de répondre",
    "je ne suis pas en mesure de répondre à cette question",
    "je préfère ne pas répondre à cette question",
    "malheureusement je ne peux pas vous aider",
    "lo siento no puedo ayudar con esa petición",
    "lo siento pero no puedo responder a esa pregunta",
    "como asistente debo negarme a responder",
    "no me es posible responder a esta pregunta",
    "no estoy en condiciones de responder a esta pregunta",
    "prefiero no responder a esa pregunta",
    "lamentablemente no puedo ayudarle con eso",
    "no me está permitido contestar esta pregunta",
)
#: A refusal in words of its own: a sentence with a word for the one who answers, one for denying and one for answering, by language.
SPEAKER = "i me my we our us assistant ai bot ich wir mir uns mein meine unser je j nous moi mes nos yo nosotros me nos mi mis asistente assistent".split()
DENIAL = "not cannot unable decline declining declined refuse refusing refrain rather prefer avoid off pass no nicht kein keine keinen ablehnen nichts unmöglich verboten ne impossible refuser refuse interdit négarme negarme imposible prohibido prefiero préfère leider comment".split()
ANSWERING = (
    "help assist answer answering respond responding reply comment discuss discussing provide share say tell advise advising speak talk view opinion request question topic beantworten antworten helfen auskunft sagen äußern mitteilen bearbeiten anfrage "
    "frage antwort répondre aider dire traiter commenter réponse demande question aborder responder contestar ayudar ayudarle decir comentar tratar respuesta petición pregunta hablar"
).split()
#: Words of courtesy beside a refusal, which are no answer either.
COURTESY = "thank thanks sorry please contact ask person human colleague else instead regret understand hope apologise apologize apologies danke bitte leider wenden verständnis bedaure merci désolé veuillez contacter adressez regrette gracias siento favor contacte lamento perdone disculpe".split()
#: Lead-ins that belong neither to a question nor to an answer.
LEADS = {"note", "you", "asked", "q", "a", "question", "answer", "query", "frage", "antwort", "sie", "fragten", "pregunta", "respuesta", "réponse", "vous", "demandiez", "usted", "preguntó", "your", "was", "the", "is", "user", "assistant", "response"}

#: Function words by language.
LANGUAGES = {
    "en": "the of and to is for that with on as by it be are at from this not has was if under per no you your all any its when after before which while will may can must does who what where how without against within have had and against once unless because although until than should would been under".split(),
    "de": "der die das und ein eine einen einem einer ist zu den dem des mit von für im auf nicht bei nach wird am oder sich als bis sie ihr ihre vor gegen ohne damit wenn über aber wie was wer wann etwas im nur zum zur kann sofern während jeder jeden".split(),
    "fr": "le la les de du des et un une est dans pour que qui sur avec par au aux en ne pas se ce ou il elle vous votre sans contre avant après lorsque pendant si afin mais à comme quand je nous son sa ses dès chaque même oui quel quelle l d s".split(),
    "es": "el la los las de y en un una es por con para del al se su que no lo como si o usted sin antes después hasta pero más cuando mientras qué quién cuándo dónde cada según aunque sobre sí a".split(),
}

_TERMINAL = r"[.!?。]['\"”’»)\]*_]*$"
_CITATION = r"\[[A-Za-z]?_?[0-9A-Za-z_, -]{1,40}\]|\((?:ref|see|source|siehe|vgl|voir|véase)\.?[^()]{0,30}\)"
_ITEM = r"^\s*(?:[-*•–]|\d{1,2}[.)])\s+"
_TOKEN = re.compile(r"[^\W_]+")
_SENTENCE = re.compile(r"(?<=[.!?;])\s+|\n")
_MARKS = {k: re.compile(v) for k, v in {"de": "[ßäöü]", "fr": "[çèêëîïôùûœ]|à", "es": "[ñ¿¡íóú]"}.items()}


def latest_pairs(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """request_id, query, answer: each request that has a response, with the answer of the latest responded_at."""
    asked = requests.filter("request_id is not null").groupBy("request_id").agg(F.max_by("query", F.struct("logged_at", "query")).alias("query"))
    last = responses.groupBy("request_id").agg(F.max_by(F.struct("synthesized_answer"), F.struct("responded_at", F.coalesce("synthesized_answer", F.lit("")))).alias("r"))
    return asked.join(last, "request_id").select("request_id", F.coalesce("query", F.lit("")).alias("query"), F.coalesce("r.synthesized_answer", F.lit("")).alias("answer"))


def _plain(text: Column) -> Column:
    """Without tags, invisible characters and citations, trimmed."""
    clean = F.regexp_replace(text, r"(?s)<!--.*?-->|</?[a-zA-Z][^<>]{0,80}>|&nbsp;|[\u200b-\u200f\u2060\ufeff\u00ad]", " ")
    return F.regexp_replace(F.regexp_replace(clean, _CITATION, " "), r"(?U)^\s+|\s+$", "")


def is_empty(plain: Column) -> Column:
    core = F.regexp_replace(F.lower(plain), r"(?U)^[\W_]+|[\W_]+$", "")
    return F.regexp_replace(core, r"(?U)\s+", " ").isin("", *NO_ANSWER)


def _lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence; a row of the table is the bits of one number."""
    at: dict[str, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    row = full = (1 << len(a)) - 1
    for y in b:
        met = row & at.get(y, 0)
        row = (row + met | row - met) & full
    return len(a) - row.bit_count()


def _tokens(text: str) -> list[str]:
    t = text.lower().replace("’", "'")
    if "'" in t:
        t = t.replace("can't", "can not").replace("won't", "will not").replace("n't", " not").replace("i'm", "i am").replace("i'd", "i would").replace("i'll", "i will").replace("i've", "i have")
    return ["can", "not"] if t == "cannot" else _TOKEN.findall(t.replace("cannot", "can not"))


def _same_words(answer: list[str], query: list[str]) -> list[str]:
    """The answer with each misspelt word replaced by the query's word that it is one letter away from."""
    near = {}
    for w in set(answer) - set(query):
        for q in query:
            if abs(len(w) - len(q)) <= 1 and len(q) > 3 and (w[:2] == q[:2] or w[-2:] == q[-2:]):
                i = next((k for k, (x, y) in enumerate(zip(w, q)) if x != y), min(len(w), len(q)))
                if w[i + 1 :] == q[i + 1 :] or w[i:] == q[i + 1 :] or w[i + 1 :] == q[i:]:
                    near[w] = q
    return [near.get(w, w) for w in answer]


def _copied(asked: list[str], said: list[str]) -> bool:
    """Whether the answer is the question again, once or several times: few shingles of its own, then nearly all of it aligned."""
    if not asked or not said:
        return False
    own, given = set(zip(said, said[1:])) or {(said[0],)}, set(zip(asked, asked[1:])) | {(w,) for w in asked}
    if len(own & given) < 0.3 * len(own):
        return False
    while said and said[0] in LEADS and said[: len(asked)] != asked and said[0] != asked[0]:
        said = said[1:]
    known = set(asked)
    body = _same_words([w for w in said if w not in LEADS or w in known], asked)
    return len(body) >= 0.5 * len(asked) and _lcs(asked * max(1, round(len(body) / len(asked))), body) >= 0.85 * len(body) > 0


_TEMPLATES = [t.split() for t in REFUSALS]
_LABELS = frozenset(("note", "hinweis", "nota", "remarque", "ref", "end"))
_SPEAKER, _DENIAL, _ANSWERING, _COURTESY = (frozenset(x) for x in (SPEAKER, DENIAL, ANSWERING, COURTESY))


def _fits_template(words: list[str]) -> bool:
    """Whether the words are aligned with a refusal template, or begin with a long one."""
    known = set(words)
    for t in _TEMPLATES:
        if len(known.intersection(t)) >= 0.6 * len(set(t)):
            if min(len(t), len(words)) >= 0.6 * max(len(t), len(words)) and _lcs(t, words) >= 0.75 * max(len(t), len(words)):
                return True
            if len(t) >= 6 and _lcs(t, words[: len(t) + 1]) >= 0.88 * len(t):
                return True
    return False


def _own_refusal(words: list[str]) -> bool:
    """Whether the one who answers denies answering: a word for each of the three close together."""
    for i, w in enumerate(words):
        if w in _DENIAL and not _SPEAKER.isdisjoint(words[max(0, i - 5) : i + 6]) and not _ANSWERING.isdisjoint(words[max(0, i - 4) : i] + words[i + 1 : i + 9]):
            return True
    return False


def _refused(said: list[str], answer: str) -> bool:
    """Whether the sentences that decline outweigh those that answer; sentences of courtesy count for neither."""
    if _DENIAL.isdisjoint(said):
        return False
    refusing = answering = 0
    for sentence in _SENTENCE.split(answer):
        words = [w for w in _tokens(sentence) if w not in _LABELS and not w.isdigit()]
        if len(words) > 2 and not _DENIAL.isdisjoint(words) and (_own_refusal(words) or _fits_template(words)):
            refusing += len(words)
        elif _COURTESY.isdisjoint(words):
            answering += len(words)
    if not refusing:  # the whole may be one refusal over several marks
        words = [w for w in said if w not in _LABELS and not w.isdigit()]
        return _fits_template(words)
    return refusing >= answering


_KNOWN = {k: frozenset(v) for k, v in LANGUAGES.items()}


def _language(words: list[str], text: str) -> dict[str, int]:
    """Function words, and letters with the language's marks."""
    return {k: sum(map(known.__contains__, words)) + (len(_MARKS[k].findall(text)) if k in _MARKS else 0) for k, known in _KNOWN.items()}


def _other_language(asked: list[str], query: str, said: list[str], answer: str) -> bool:
    q = _language(asked, query)
    own = max(q, key=q.get)
    if sum(n == q[own] for n in q.values()) > 1:
        return False
    a = _language(said, answer)
    best = max(n for k, n in a.items() if k != own)
    return best >= 3 and best >= 1.5 * a[own] + 1


@F.pandas_udf(StringType())
def _aligned(query: pd.Series, plain: pd.Series) -> pd.Series:
    """copied, refusal or other_language by the tokens of the two texts, else null."""

    def judge(q: str, a: str) -> str | None:
        asked, said = _tokens(q), _tokens(a)
        if _copied(asked, said):
            return "copied"
        if _refused(said, a):
            return "refusal"
        return "other_language" if _other_language(asked, q.lower(), said, a.lower()) else None

    return pd.Series([judge(q, a) for q, a in zip(query, plain)])


def _masked(text: Column) -> Column:
    t = F.regexp_replace(text, _CITATION, " ")
    t = F.regexp_replace(t, r"(?U)\b\p{Lu}+-\d+", "Nn")
    t = F.regexp_replace(t, r"\d+(?:[.,]\d+)*", "0")
    return F.regexp_replace(t, r"(?U)(?=\p{Lu})(?<=[\p{Ll}\d,'’] |['’])\p{Lu}(?:[\p{L}'’-]|\. \p{Lu})*(?:\.? \p{Lu}[\p{L}'’-]*)*", "nn")


def _parts(text: Column) -> Column:
    """Sentences and list items of the masked text, as arrays of words."""
    parts = F.filter(F.split(_masked(text), r"(?<=[.!?])\s+|\n"), lambda s: s.rlike(r"\w"))
    return F.transform(parts, lambda s: F.split(F.regexp_replace(F.lower(F.regexp_replace(s, _ITEM, "")), r"(?U)^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""), r"(?U)[\s,;:]+"))


def closing_rates(parts: DataFrame) -> DataFrame:
    """tail, rate: how often two masked words in a row end a sentence or list item, over all answers (column parts).

    The last part of each answer is left out, so that broken answers do not vouch for themselves.
    """
    words = parts.filter("size(parts) > 1").select(F.explode(F.expr("slice(parts, 1, size(parts) - 1)")).alias("words"))
    ends = F.expr("transform(sequence(1, size(words)), i -> struct(concat_ws(' ', get(words, i - 2), get(words, i - 1)) AS tail, int(i = size(words)) AS ended))")
    seen = words.filter("size(words) > 1").select(F.explode(ends).alias("e")).select("e.tail", "e.ended")
    return seen.groupBy("tail").agg(F.sum("ended").alias("ended"), F.count("*").alias("seen")).filter("ended > 0").select("tail", (F.col("ended") / F.col("seen")).alias("rate"))


def defects(requests: DataFrame, responses: DataFrame, min_rate: float = 0.05) -> DataFrame:
    """request_id, defect of every request whose latest response has one; at most one each, tried in the order
    empty, copied, refusal, other_language, truncated.

    truncated: the text breaks off with an ellipsis, an initial, an open bracket or citation, or a mark that goes on; or it ends without
    a full stop in prose of more than a few words; or its last list item ends with two words that seldom (min_rate) end one.
    A null answer is empty, a null query is an empty question, redelivered rows count once, empty tables give no rows.
    """
    query, answer, plain = F.col("query"), F.col("answer"), F.col("plain")
    pairs = stage(latest_pairs(requests, responses).withColumn("plain", F.regexp_replace(_plain(answer), r"[\s*_]+$", "")))
    empty = pairs.filter(is_empty(plain)).select("request_id", F.lit("empty").alias("defect"))
    last = F.element_at(F.split(plain, r"\n"), -1)
    raw_last = F.regexp_replace(answer, r"(?U)[\s\u200b]+$", "")
    read = pairs.filter(~is_empty(plain)).select(
        "request_id", _aligned(query, plain).alias("aligned"), _parts(plain).alias("parts"),
        plain.rlike(_TERMINAL).alias("closed"), last.rlike(_ITEM).alias("item"),
        (plain.rlike(r"(?:\.\.\.|…)$") | raw_last.rlike(r"\[[^\]\s]{0,12}$|\([^)]{0,30}$") | plain.rlike(r"[,;:(\[{&/–-]$") | plain.rlike(r"(?U)(?:^|\s)\p{Lu}\.$") | (F.regexp_count(answer, F.lit("```")) % 2 == 1)).alias("open"),
        (plain.rlike(r"(?U)^\W*[\d]") & ~plain.rlike(r"\d$") | plain.rlike(r"(?U)^(?:\p{Lu}[\p{L}'’-]*\s*){1,3}$")).alias("label"),
        F.size(F.split(plain, r"(?U)\s+")).alias("n_words"), (plain != F.regexp_replace(answer, r"(?U)^\s+|\s+$", "")).alias("cited"),
    )
    read = stage(read)
    end = F.element_at("parts", -1)
    tail = F.when(F.size("parts") > 0, F.concat_ws(" ", F.get(end, F.size(end) - 2), F.get(end, F.size(end) - 1)))
    judged = read.withColumn("tail", tail).join(small_side(closing_rates(read)), "tail", "left")
    rare = F.coalesce("rate", F.lit(0.0)) < min_rate
    broken = F.col("open") | (~F.col("closed") & F.when(F.col("item") | F.col("cited"), rare).otherwise(~(F.col("label") & (F.col("n_words") <= 3))))
    found = judged.select("request_id", F.coalesce("aligned", F.when(broken, "truncated")).alias("defect"))
    return found.filter("defect is not null").unionByName(empty)
