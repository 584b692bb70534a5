"""Which spellings of a term are worth searching for.

A verdict is the first of an ordered list of rules that applies, each rule a comparison of
forms of the two texts: squeezed, compact (letters and digits only), singular, stemmed. The
rules run in one vectorized function over arrays of terms and variants; vocabularies are
small beside the data.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType

from paperloom.functions.text import normal

# Heads that add nothing to a term, and heads too wide to be found in titles.
WEAK_HEADS = "task tasks model models method methods approach approaches system systems framework frameworks technique techniques architecture architectures network networks problem problems".split()
WIDE_HEADS = "techniques approaches methods architectures frameworks strategies mechanisms".split()
# Endings cut to a stem, the first that fits, and the letters each cuts.
STEM_ENDINGS = (("ating", 5), ("ation", 5), ("tting", 4), ("ting", 4), ("sion", 4), ("tion", 4), ("ing", 3), ("ied", 3), ("ed", 2), ("ly", 2))


# Plural endings, the least length of a word that has one, what each leaves of the ending.
PLURALS = (("ies", 5, "y"), ("ches", 6, "c"), ("shes", 6, "s"), ("sses", 6, "s"), ("xes", 5, "x"), ("zes", 5, "z"), ("ses", 5, "s"))


def _words(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


@lru_cache(maxsize=50_000)
def singular(word: str) -> str:
    """A word without its plural ending; words of three letters or fewer stay."""
    if len(word) > 3:
        for ending, least, left in PLURALS:
            if word.endswith(ending) and len(word) >= least:
                return word[: -len(ending)] + left
        if word.endswith("s") and not word.endswith("ss"):
            return word[:-1]
    return word


@lru_cache(maxsize=50_000)
def stem(word: str) -> str:
    """The singular without the first of STEM_ENDINGS that leaves more than two letters."""
    one = singular(word)
    return next((one[:-n] for ending, n in STEM_ENDINGS if one.endswith(ending) and len(one) > n + 2), one)


class _Pair:
    """The forms of a term and a variant that the rules compare."""

    def __init__(self, canon: str, variant: str) -> None:
        self.texts = [" ".join(t.split()) for t in (canon, variant)]
        self.low = [t.lower() for t in self.texts]
        self.words = [_words(t) for t in self.low]
        self.compact = ["".join(w) for w in self.words]
        self.sizes = [len(t.split()) for t in self.texts]
        self.short, self.long = sorted(self.texts, key=len)
        one_word = len(self.short.split()) == 1 and len(self.short) <= 6 and self.short.isalpha()
        self.acronym = one_word or (len(self.short.split()) <= 2 and len(self.short) <= 8 and self.short.isupper())
        sets = [set(w) for w in self.words]
        self.worded = all(sets)
        self.overlap = len(sets[0] & sets[1]) / max(1, min(map(len, sets)))
        self.inside = self.compact[0] in self.compact[1] or self.compact[1] in self.compact[0]
        self.brief = max(self.sizes) <= 3

    def only_head_added(self) -> bool:
        return any(long == f"{short} {h}" or long.startswith(f"{short} {h} ") for short, long in (self.low, self.low[::-1]) for h in WEAK_HEADS)

    def only_plural(self) -> bool:
        return self.words[0] != self.words[1] and [singular(w) for w in self.words[0]] == [singular(w) for w in self.words[1]]

    def only_head_swapped(self) -> bool:
        stripped = [w[:-1] for w in self.words if len(w) > 1 and w[-1] in WEAK_HEADS]
        return len(stripped) == 2 and stripped[0] == stripped[1]

    def only_form_changed(self) -> bool:
        stems = [sorted(map(stem, w)) for w in self.words]
        if self.worded and stems[0] == stems[1] and self.compact[0] != self.compact[1]:
            return True
        if [len(w) for w in self.words] != [1, 1]:
            return False
        (c,), (v,) = self.words
        return c.endswith("tion") and v.endswith("ting") and c[:-4] == v[:-4] or c.endswith("sion") and v.endswith("sing")

    def stands_for(self) -> bool:
        initials = "".join(w[0] for w in self.long.split())
        return self.acronym and (self.short.upper() in (initials.upper(), self.long.upper()) or self.short.isupper() and self.short.lower() in self.long.lower().replace(" ", ""))


#: Rules and verdicts, in order.
_RULES = (
    (lambda p: not all(p.texts) or p.low[0] == p.low[1], False),
    (_Pair.only_head_added, False),
    (_Pair.only_plural, False),
    (_Pair.only_head_swapped, False),
    (_Pair.only_form_changed, False),
    (lambda p: p.compact[0] == p.compact[1], True),
    (_Pair.stands_for, True),
    (lambda p: p.worded and p.overlap < 0.34 and not (p.acronym or p.inside or p.brief), False),
    (lambda p: p.worded and p.sizes[1] > p.sizes[0] + 2 and p.overlap < 0.6, False),
    (lambda p: p.worded and max(p.sizes) <= 4 and abs(p.sizes[0] - p.sizes[1]) <= 2 and not (p.overlap >= 0.34 or p.inside or p.brief), False),
)


def is_high_confidence(canon: str | None, variant: str | None) -> bool:
    """Whether a variant is another way to say the term: no plural, no added weak head, no other part of speech."""
    pair = _Pair(canon or "", variant or "")
    return next((verdict for rule, verdict in _RULES if rule(pair)), True)


def pick(canon: str | None, variants: list[str] | None, most: int = 2) -> list[str]:
    """The first high-confidence variants of a term, letter case aside, without the term itself."""
    out: dict[str, str] = {}
    for v in variants if variants is not None else ():
        v = " ".join((v or "").split())
        if len(out) < most and v and v.lower() not in out and is_high_confidence(canon, v):
            out[v.lower()] = v
    return list(out.values())


@F.pandas_udf(BooleanType())
def high_confidence(canon: pd.Series, variant: pd.Series) -> pd.Series:
    return pd.Series([is_high_confidence(c, v) for c, v in zip(canon, variant, strict=True)], dtype=bool)


@F.pandas_udf(ArrayType(StringType()))
def retrieval_variants(canon: pd.Series, variants: pd.Series) -> pd.Series:
    return pd.Series([pick(c, v) for c, v in zip(canon, variants, strict=True)])


@F.pandas_udf(ArrayType(ArrayType(StringType())))
def retrieval_variants_each(canons: pd.Series, variants: pd.Series) -> pd.Series:
    """retrieval_variants of each of a row's terms."""
    return pd.Series([[pick(c, v) for c, v in zip(cs if cs is not None else (), vs if vs is not None else (), strict=True)] for cs, vs in zip(canons, variants, strict=True)])


def gap_likely(core: Column) -> Column:
    """Whether a search text's words are too wide to be found as such."""
    return F.concat(F.lit(" "), normal(core)).rlike(" (" + "|".join(WIDE_HEADS) + ")")
