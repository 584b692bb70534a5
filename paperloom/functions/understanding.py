"""What a question asks for, by rules: intent, years, negations, claims, topic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom.functions.text import squeeze

# The cues, in order of precedence where order matters.
SPECIFIC = r"\b(the\s+paper|the\s+study|this\s+work|bib\.|arxiv\.org|titled|named)\b"
SURVEY = r"\b(surveys?|reviews?|overview|taxonomy|综述|回顾)\b"
RELATED = r"\b(related\s+work|prior\s+work|previous\s+work|相关工作|related\s+to)\b"
DATASET = r"\b(datasets?|benchmarks?|corpus|数据[集集]|基准)\b"
METHOD = r"\b(methods?|approaches?|techniques?|algorithms?|frameworks?|architectures?|方法|算法|框架|模型)\b"
BETWEEN = r"(?:between|from)\s*(20\d{2}|19\d{2})\s*(?:and|to|-|–)\s*(20\d{2}|19\d{2})"
RANGE = r"\b(20\d{2})\s*[-–]\s*(20\d{2})\b"
SINCE = r"(?:since|after|from|post)\s*(20\d{2}|19\d{2})"
BEFORE = r"(?:before|until|prior\s+to)\s*(20\d{2}|19\d{2})"
LAST_YEARS = r"(?:last|past)\s+(\d+)\s+years?"
IN_YEAR = r"(?:in|year)\s+(20\d{2})\b"
NEGATION = r"(?:not\s+(?:about|including|using)|excluding|except(?:\s+for)?|without|不要|不含|排除|而非)\s+([^,.;?!]+)"
METHOD_CUE = r"(?:using|via|based on|with)\s+([A-Za-z][\w\-]*(?:\s+[A-Za-z][\w\-]*){0,3})"
CLAIMS = (
    r"\b(better|worse|outperform|exceed|superior|inferior|comparative|compares?\s+to|compared\s+to)\b",
    r"\bwhich\s+(?:is|are|method|model|approach)?\s*(?:better|worse|faster|more\s+effective)",
    r"\bwhat\s+(?:cause|causes|caused|lead|leads|leads?\s+to|result|results?\s+in)\b",
    r"\b(cause|causes|caused|lead|leads|leading|results?\s+in|resulted?\s+in)\b",
    r"\b(affect|affects|affected|impact|impacts|influences?|influence)\b",
    r"\bhow\s+does\s+\w+\s+(affect|influence|impact|improve|help|enable|boost)\b",
    r"\b(does|do|can|should|will|would)\s+\w+\s+(help|improve|increase|decrease|reduce|enable|support)\b",
    r"\b(prove|show|demonstrate|indicate|suggest)\s+(that|whether)\b",
    r"\b(improve|improves|improving|enhance|enhances|enhancing|boost|boosts|boosting)\b",
    r"\b(impact|effect|influence|role)\s+of\b",
    r"\b(is|are)\s+(it|this|these)\s+(true|effective|useful|helpful|good|bad|valid)\b",
)
OPENER = r"(?i)^(?:could you|can you|please|what are|which|give me|list|find|tell me|i need|looking for|are there any|provide(?: me)?)\s+"
TIME_CLAUSE = r"(?i)(?:since|after|before|from|between|last|past)\s+[^,.]*"
FILLER = r"(?i)^(?:some|any|the|papers?|studies|works?|research|about|on|regarding|related to|that|which|me|with|for)$"


def _has(text: Column, cue: str) -> Column:
    return text.rlike("(?i)" + cue)


def _year(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, "(?i)" + pattern, group), F.lit("")).try_cast("int")


def _last_year(text: Column, pattern: str) -> Column:
    return F.try_element_at(F.regexp_extract_all(text, F.lit("(?i)" + pattern), F.lit(1)), F.lit(-1)).try_cast("int")


def intent(question: Column) -> Column:
    q = F.coalesce(question, F.lit(""))
    return (
        F.when(_has(q, SPECIFIC), "specific").when(_has(q, SURVEY), "survey").when(_has(q, RELATED), "related").when(_has(q, DATASET) & ~_has(q, METHOD), "dataset").when(_has(q, METHOD), "method").otherwise("broad")
    )


def years(question: Column, current_year: int = 2026) -> tuple[Column, Column]:
    """First and last year asked for, null where open. A span wins; else the last `since` (inclusive) and `before` (less one); `in` only without these."""
    q = F.coalesce(question, F.lit(""))
    a = F.coalesce(_year(q, BETWEEN), _year(q, RANGE))
    b = F.when(_year(q, BETWEEN).isNotNull(), _year(q, BETWEEN, 2)).otherwise(_year(q, RANGE, 2))
    ago = F.lit(current_year) - _year(q, LAST_YEARS)
    since, before = F.coalesce(ago, _last_year(q, SINCE)), _last_year(q, BEFORE) - 1
    only = F.when(since.isNull() & before.isNull(), _year(q, IN_YEAR))
    return F.when(a.isNotNull(), F.least(a, b)).otherwise(F.coalesce(since, only)), F.when(a.isNotNull(), F.greatest(a, b)).otherwise(F.coalesce(before, only))


def negations(question: Column) -> Column:
    """Phrases the question rules out, shorter than 80 characters."""
    found = F.regexp_extract_all(F.coalesce(question, F.lit("")), F.lit("(?i)" + NEGATION), F.lit(1))
    return F.filter(F.transform(found, lambda p: F.btrim(p, F.lit(" .;:"))), lambda p: (p != "") & (F.length(p) < 80))


def method_cue(question: Column) -> Column:
    """Up to four words after using, via, based on or with; null if there is no such cue."""
    return F.nullif(F.trim(F.regexp_extract(F.coalesce(question, F.lit("")), "(?i)" + METHOD_CUE, 1)), F.lit(""))


def claim(question: Column) -> Column:
    """The first claim pattern's match with 30 characters around it, null if none matches."""
    q = F.trim(F.coalesce(question, F.lit("")))

    def around(pattern: str) -> Column:
        at = F.regexp_instr(q, F.lit("(?i)" + pattern))
        size = F.length(F.regexp_substr(q, F.lit("(?i)" + pattern)))
        start = F.greatest(F.lit(1), at - 30)
        return F.when(at > 0, F.btrim(squeeze(F.substring(q, start, at + size + 30 - start)), F.lit(" ,.;:")))

    return F.coalesce(*[around(p) for p in CLAIMS])


def topic(question: Column) -> Column:
    """The question without opener, closing marks, time clauses, and fillers among its first words; the question itself if nothing is left."""
    q = F.trim(F.coalesce(question, F.lit("")))
    t = F.trim(F.regexp_replace(F.regexp_replace(q, OPENER, ""), r"[?？]+$", ""))
    words = F.filter(F.split(F.regexp_replace(t, TIME_CLAUSE, " "), r"\s+"), lambda w: w != "")
    # a filler is dropped until two words are kept
    kept = F.aggregate(words, F.array().cast("array<string>"), lambda acc, w: F.when(w.rlike(FILLER) & (F.size(acc) < 2), acc).otherwise(F.array_append(acc, w)))
    out = F.btrim(F.array_join(kept, " "), F.lit(" ,.-"))
    return F.when(out != "", out).otherwise(q)


def templates(kind: Column, subject: Column, question: Column, most: int = 3) -> Column:
    """Search texts for an intent: the topic, with the intent's words, and the question, once each, `most` at most."""
    q = F.regexp_replace(F.trim(F.coalesce(question, F.lit(""))), r"[?？]+$", "")
    t = F.coalesce(F.nullif(F.trim(subject), F.lit("")), F.trim(F.coalesce(question, F.lit(""))))

    def plus(*words: str) -> Column:
        return F.array(*[F.concat(t, F.lit(f" {w}")) for w in words])

    middle = (
        F.when(kind == "method", plus("method", "approach")).when(kind == "dataset", plus("dataset", "benchmark")).when(kind == "specific", F.array(q)).when(kind == "related", plus("related work")).otherwise(F.array().cast("array<string>"))
    )
    texts = F.transform(F.concat(F.array(t), middle, F.array(q)), lambda s: F.btrim(squeeze(s), F.lit(" ,")))
    texts = F.filter(texts, lambda s: s != "")
    seen = F.transform(texts, F.lower)
    return F.slice(F.filter(texts, lambda s, i: F.array_position(seen, F.lower(s)) == i + 1), 1, most)
