"""Text functions as Column expressions: everything stays inside generated code.

Patterns keep to what Java's and RE2's expressions share, so that SQL can check them.
Python's white space is written out, since \\s is ASCII only in both.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space in the sense of str.split().
SPACE = r"[\t-\r\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"

# Words that don't count as keywords.
STOP_WORDS = (
    "a an the and or of for to in on with about regarding by as at from since that this these those is are was were be been being "
    "have has had do does did will would could should may might can shall please you find papers paper provide list show search get "
    "what how any some me tell i we based using via techniques methods approaches"
).split()

# Words left out of requests to one provider; the other leaves out some more.
REQUEST_STOP_WORDS = "a an the and or of for to in on with about regarding please could you provide find papers paper that this from since".split()
REQUEST_STOP_WORDS_LONG = [*REQUEST_STOP_WORDS, *"what are is any some tell me".split()]


def squeeze(text: Column) -> Column:
    """White space runs as one space, none at the ends; '' for null."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE + "+", " "))


def strip(text: Column) -> Column:
    """Without white space at the ends; null stays null."""
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def normal(text: Column) -> Column:
    """squeeze() in lower case."""
    return squeeze(F.lower(text))


def tokens(text: Column) -> Column:
    """Distinct keywords: runs of a-z, 0-9 and inner hyphens, of two letters or more, no stop words."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[a-z0-9][a-z0-9\-]*"), F.lit(0))
    return F.array_distinct(F.filter(F.transform(found, lambda t: F.rtrim(t, F.lit("-"))), lambda t: (F.length(t) > 1) & ~t.isin(STOP_WORDS)))


def title_fingerprint(title: Column) -> Column:
    """Lower case, runs of other characters than a-z and 0-9 as one space, 200 characters at most."""
    return F.left(F.trim(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), r"[^a-z0-9]+", " ")), F.lit(200))


def letters(text: Column) -> Column:
    """Letters of any script, in lower case."""
    return F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}]", ""))


def keywordize(text: Column, stop_words: list[str] = REQUEST_STOP_WORDS) -> Column:
    """The first 12 words that aren't stop words, as typed, 200 characters at most; the text itself if there are none."""
    flat = squeeze(text)
    kept = F.filter(F.regexp_extract_all(flat, F.lit(r"[A-Za-z0-9\-]+"), F.lit(0)), lambda t: (F.length(t) > 1) & ~F.lower(t).isin(stop_words))
    return F.left(F.when(F.size(kept) > 0, F.array_join(F.slice(kept, 1, 12), " ")).otherwise(flat), F.lit(200))


def snippet(abstract: Column, most: int = 240) -> Column:
    """The abstract cut at the last sentence end within `most` characters, else at the last space of the second half, else hard; with an ellipsis if cut.

    most <= 0 cuts nothing.
    """
    text = squeeze(abstract)
    if most <= 0:
        return text
    window = F.left(text, F.lit(most))
    sentence = F.regexp_extract(window, r"^((?s:.*)(?:[。；;]|[.!?](?:\s|$)))", 1)
    spaced = F.regexp_extract(window, r"^((?s:.*)) ", 1)
    cut = F.when(sentence != "", F.rtrim(sentence)).when(F.length(spaced) >= max(1, most // 2), F.rtrim(spaced)).otherwise(F.rtrim(window))
    return F.when(F.length(text) <= most, text).otherwise(F.concat(cut, F.lit("…")))


def similar(a: Column, b: Column, least: float = 0.75) -> Column:
    """Whether two texts share so much of the larger token set; texts without tokens are similar only to equals."""
    x, y = F.array_distinct(F.split(normal(a), " ")), F.array_distinct(F.split(normal(b), " "))
    return F.size(F.array_intersect(x, y)) / F.greatest(F.size(x), F.size(y)) >= least


def dedupe_words(items: Column) -> Column:
    """Texts of an array without blanks and repeats, letter case aside, the first of each kept in order."""
    trimmed = F.filter(F.transform(items, squeeze), lambda t: t != "")
    seen = F.transform(trimmed, F.lower)
    return F.filter(trimmed, lambda t, i: F.array_position(seen, F.lower(t)) == i + 1)


# Openings of questions, taken off one after the other.
OPENINGS = (
    r"^(?:could you|can you|please|may i (?:have|ask)|would you)\s+",
    r"^(?:i (?:want|need|am looking for|i'm looking for|i'd like))\s+(?:to\s+)?(?:find|search\s+for|see|know\s+about|have|papers about|papers on|papers regarding)\s+",
    r"^(?:looking for|searching for)\s+",
    r"^(?:what are|what is|which (?:is|are)|who is|who are)\s+(?:the\s+)?",
    r"^(?:give me|find me|show me|list(?: me)?|provide me with|provide)\s+(?:me\s*)?(?:some\s+)?(?:papers? about |papers? on |papers? regarding |research on |studies on )?",
    r"^(?:find|get|provide|search for)\s+papers?\s+(?:about|on|regarding) ",
    r"^(?:list)\s+(?:papers? about |papers? on |papers? regarding )",
    r"^(?:are there|is there|do you know|do you have)\s+",
    r"^(?:papers?|articles?|studies?|publications?|works?)\s+(?:about|on|regarding|related to|using|with)\s+",
    r"^(?:papers?|articles?|studies?|publications?|works?)\s+(?:about|on|regarding|related to)\s+",
)
LEADING = r"^(?:with|for|of|in|on|at|by|from|to|via|using|a|an|the)\s+"


def rewrite(text: Column, most: int = 24, least: int = 2) -> Column:
    """A question as a search text: openings and closing marks off, at most so many words, lower case; null if fewer than `least` words are left."""
    t = squeeze(text)
    for opening in OPENINGS:
        t = F.trim(F.regexp_replace(t, "(?i)" + opening, ""))
    t = F.trim(F.regexp_replace(t, r"[?？!！.]+$", ""))
    words = F.split(t, " ")
    t = F.when(F.size(words) > most, F.trim(F.regexp_replace(F.array_join(F.slice(words, 1, most), " "), "(?i)" + LEADING, ""))).otherwise(t)
    return F.when((t != "") & (F.size(F.split(t, " ")) >= least), F.lower(t))


def looks_like_title(text: Column) -> Column:
    """No question mark, no order to search, three words or more, and at least max(3, half) of them capitalized."""
    t = squeeze(text)
    words = F.split(t, " ")
    capitals = F.size(F.filter(words, lambda w: w.rlike("^[A-Z]")))
    order = F.lower(t).rlike("^(list|find|show|papers|search|get|what|how) ")
    return (t != "") & ~t.contains("?") & ~order & (F.size(words) >= 3) & (capitals >= F.greatest(F.lit(3), F.floor((F.size(words) + 1) / 2)))


# Marks of a claim.
CLAIM_MARKS = (" better ", " than ", " versus ", " vs ", " outperform", " less ", " more ", " can produce ")


def looks_like_claim(text: Column) -> Column:
    padded = F.concat(F.lit(" "), F.lower(F.coalesce(text, F.lit(""))), F.lit(" "))
    out = F.lit(False)
    for mark in CLAIM_MARKS:
        out |= padded.contains(mark)
    return out


def strip_fence(text: Column) -> Column:
    """The inside of a first code fence, or the text itself."""
    inside = F.regexp_extract(text, r"(?s)```(?:json)?(.*?)(?:```|$)", 1)
    return strip(F.when(text.contains("```"), inside).otherwise(text))


def loose_json(text: Column, opening: str = "{", closing: str = "}") -> Column:
    """JSON text out of a model's reply: unfenced if that parses, else from the first opening to the last closing brace; null if neither parses."""
    body = strip_fence(F.coalesce(text, F.lit("")))
    braces = F.regexp_extract(body, rf"(?s)(\{opening}.*\{closing})", 1)
    return F.when(F.try_parse_json(body).isNotNull(), body).when(F.try_parse_json(braces).isNotNull(), braces)
