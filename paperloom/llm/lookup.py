"""Mapping freely typed values to a reference list (problem 4).

A symmetric-delete dictionary over the words of the reference list is built once and
broadcast: every word, its prefixes and its consonant skeletons (how people abbreviate) are
terms, and every string got by deleting up to EDITS letters of a term leads to it. A typed
word finds its candidates by its own deletions, so no two lists are ever compared; the
candidates are ranked by a weighted Damerau-Levenshtein distance (swapping two letters and
doubling one are cheaper than the other edits). Entries that share candidate words are then
aligned with the typed words in order, and the cheapest entry within BOUND wins; of equal
ones that with the more frequent words in the reference list, then the lower id. A short
name is only taken letter by letter: at four letters, one edit leads to another entry.

What finds no entry is reported with -1.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.operators.shred import parse_payload
from paperloom.session import materialize

#: Letters deleted on either side, and thus the largest edit distance.
EDITS = 2
#: Largest cost of an alignment, and the costs it is made of.
BOUND, FIRST_MISSING, MISSING, EXTRA, ABBREVIATED, SKELETON = 3.6, 1.5, 4.0, 4.0, 0.2, 0.5
#: Entries of a reference list that are broadcast at once; a longer list is looked up block by block.
MAX_ENTRIES = 200_000
#: Typed values a worker keeps with their results.
KEPT = 50_000

# Words that carry no meaning in a name, and words that announce or follow one.
STOP_WORDS = frozenset("a an and at for in of on the".split())
AROUND = ("proceedings", "procs", "proc", "volume", "vol", "number", "no", "issue", "pages", "pp", "edition", "ed")

_WORD = re.compile(r"[^\W_]+(?:['’][^\W\d_]+)?\.?")
_DOTTED = re.compile(r"\b(?:[^\W\d_]\.){2,}[^\W\d_]?\.?")
_YEAR = re.compile(r"[\s\-–'’`(,]*\(?'?\d{1,4}\)?[\s.]*$")
_PARENTHESIS = re.compile(r"\(([^()]*)\)")
_ORDINAL = re.compile(r"\d+(?:st|nd|rd|th)?$")
_SHORT_STOP_WORDS = tuple(w for w in sorted(STOP_WORDS) if len(w) > 1)


def distance(a: str, b: str, most: float) -> float:
    """Weighted Damerau-Levenshtein distance (adjacent swaps), or infinity above most."""
    if a == b:
        return 0.0
    if abs(len(a) - len(b)) > most / 0.6:
        return float("inf")
    before, row = None, [0.0]
    for j, y in enumerate(b):
        row.append(row[-1] + (0.6 if j and b[j - 1] == y else 1.0))
    for i, x in enumerate(a):
        drop = 0.6 if i and a[i - 1] == x else 1.0
        now = [row[0] + drop]
        for j, y in enumerate(b):
            cost = min(row[j] + (0.0 if x == y else 1.0), row[j + 1] + drop, now[j] + (0.6 if j and b[j - 1] == y else 1.0))
            if before is not None and i and j and x == b[j - 1] and a[i - 1] == y and x != y:
                cost = min(cost, before[j - 1] + 0.7)
            now.append(cost)
        if min(now) > most:
            return float("inf")
        before, row = row, now
    return row[-1] if row[-1] <= most else float("inf")


def deletions(term: str, edits: int) -> set[str]:
    """The term with up to so many letters deleted."""
    out = {term}
    for n in range(1, min(edits, len(term) - 1) + 1):
        out.update("".join(term[i] for i in keep) for keep in combinations(range(len(term)), len(term) - n))
    return out


def allowed(length: int) -> int:
    """Edits allowed in a term of that length."""
    return 0 if length < 4 else 1 if length < 6 else EDITS


def plain(text: str) -> str:
    """Typed text without HTML entities, case, compatibility forms, accents and underscores."""
    text = unicodedata.normalize("NFKD", html.unescape(html.unescape(text))).casefold()
    text = "".join(c for c in text if not unicodedata.combining(c))
    return re.sub(r"\s+", " ", text.replace("_", " ").replace("&", " and ").replace("+", " and ")).strip()


def words_of(text: str) -> list[str]:
    """Words of plain text, a full stop that ends one included, apostrophes dropped."""
    return [w.replace("'", "").replace("’", "") for w in _WORD.findall(text)]


class Dictionary:
    """The reference list: (id, name, short name, kind) of each entry.

    The first word of a name may be missing unless it is the kind: without it, a value
    would mean any entry on its topic.
    """

    def __init__(self, entries: Iterable[tuple[int, str | None, str | None, str | None]]) -> None:
        self.entries: list[tuple[int, tuple[str, ...], float]] = []
        self.short: dict[str, int] = {}
        self.frequency: dict[str, int] = {}
        self.holding: dict[str, list[int]] = {}
        for ident, name, short, kind in sorted((e for e in entries if e[0] is not None), key=lambda e: e[0]):
            words = tuple(w.rstrip(".") for w in words_of(plain(name or "")) if w.rstrip(".") not in STOP_WORDS)
            if short and (letters := "".join(words_of(plain(short)))):
                self.short.setdefault(letters.replace(".", ""), ident)
            if not words:
                continue
            for w in set(words):
                self.frequency[w] = self.frequency.get(w, 0) + 1
                self.holding.setdefault(w, []).append(len(self.entries))
            self.entries.append((ident, words, MISSING if words[0] == plain(kind or "") else FIRST_MISSING))
        self.terms: dict[str, dict[str, float]] = {}
        for w in self.frequency:
            self._term(w, w, 0.0)
            for n in range(1, len(w)):
                self._term(w[:n], w, ABBREVIATED)
            bones = (w[0] + re.sub("[aeiouy]", "", w[1:]))[:9]
            for n in range(2, len(bones)):
                for keep in combinations(bones[1:], n):
                    self._term(bones[0] + "".join(keep), w, SKELETON)
        for w in AROUND:
            self._term(w, "", 0.0)
        self.deleted: dict[str, set[str]] = {}
        for term in self.terms:
            for d in deletions(term, max(1, allowed(len(term)))):
                self.deleted.setdefault(d, set()).add(term)
        self.longest = max(map(len, self.terms), default=0)
        self._words: dict[str, dict[str, float]] = {}
        self._values: dict[str, tuple[int, float, int, int]] = {}

    def _term(self, term: str, word: str, cost: float) -> None:
        means = self.terms.setdefault(term, {})
        means[word] = min(cost, means.get(word, cost))

    def candidates(self, typed: str) -> dict[str, float]:
        """Words a typed word may stand for, with the cost of each; '' is a word that only announces or follows a name."""
        known = self._words.get(typed)
        if known is None:
            if len(self._words) >= KEPT:
                self._words.clear()
            known = self._words[typed] = self._candidates(typed)
        return known

    def _candidates(self, typed: str) -> dict[str, float]:
        stopped, typed = typed.endswith("."), typed.rstrip(".")
        out: dict[str, float] = {}
        if len(typed) > self.longest + EDITS:
            return out  # no term is within the distance
        for word, cost in self.terms.get(typed, {}).items():
            if cost == 0 or len(typed) >= 3 or stopped:
                out[word] = cost
        for d in deletions(typed, max(1, allowed(len(typed) + 1))):
            for term in self.deleted.get(d, ()):
                most = allowed(len(term)) or (0.7 if stopped and len(term) == 3 else 0)  # a swap in a three-letter abbreviation
                if not most or (far := distance(typed, term, most)) == float("inf"):
                    continue
                for word, cost in self.terms[term].items():
                    # of abbreviations only one edit, and only of those that look like one
                    if (cost == 0 or far <= 1 and (stopped or len(term) < len(word) - 1)) and far + cost < out.get(word, 9.0):
                        out[word] = far + cost
        if not out and 1 < len(typed) <= 3 and any(distance(typed, w, 1) <= 1 for w in _SHORT_STOP_WORDS):
            out[""] = 1.0
        return out

    def align(self, typed: list[dict[str, float]], words: tuple[str, ...], first_missing: float) -> float:
        """Cost of reading the typed words as an entry's words, in order.

        Unknown words between one that announces a name and the name (a count, a place) are free.
        """
        missing = [first_missing] + [MISSING] * (len(words) - 1)
        row = [0.0]
        for cost in missing:
            row.append(row[-1] + cost)
        announced = False
        for means in typed:
            skip = means[""] if "" in means else EXTRA
            announced |= "" in means
            now = [row[0] + (0.0 if announced and not means else skip)]
            for k, w in enumerate(words):
                cost = min(row[k + 1] + skip, now[k] + missing[k])
                if w in means:
                    cost = min(cost, row[k] + means[w])
                now.append(cost)
            row = now
        return row[-1]

    def means(self, text: str) -> list[dict[str, float]]:
        """Candidates of each word of a name, without stop words and numbers."""
        typed = [w for w in words_of(text) if w.rstrip(".") not in STOP_WORDS and not _ORDINAL.match(w.rstrip("."))]
        return [self.candidates(w) for w in typed]

    def by_name(self, text: str) -> tuple[float, int, int] | None:
        """Cost, frequency (negative) and id of the entry a name stands for."""
        means = self.means(text)
        if not means:
            return None
        votes: dict[int, int] = {}
        for m in means:
            for e in {e for w in m if w for e in self.holding[w]}:
                votes[e] = votes.get(e, 0) + 1
        best: tuple[float, int, int] | None = None
        for e, n in votes.items():
            ident, words, first_missing = self.entries[e]
            if n < len(words) - 1:  # at most the first word may be missing
                continue
            cost = self.align(means, words, first_missing)
            if cost <= BOUND:
                rank = (round(cost, 6), -sum(self.frequency[w] for w in words), ident)
                if best is None or rank < best:
                    best = rank
        return best

    def by_short_name(self, text: str) -> int | None:
        letters = _YEAR.sub("", text)
        return self.short.get(re.sub(r"[^\w]", "", letters))

    def lookup(self, value: str) -> int:
        """Id of the entry a typed value means, -1 if none."""
        return self.ranked(value)[3]

    def ranked(self, value: str) -> tuple[int, float, int, int]:
        """Step, cost, frequency (negative) and id of the entry a typed value means; the least of several dictionaries' is the best. (99, 0, 0, -1) if none."""
        known = self._values.get(value)
        if known is None:
            if len(self._values) >= KEPT:
                self._values.clear()
            known = self._values[value] = self._ranked(value)
        return known

    def _ranked(self, value: str) -> tuple[int, float, int, int]:
        text = plain(value)
        if (found := self.by_short_name(text)) is not None:
            return 0, 0.0, 0, found
        inside = _PARENTHESIS.findall(text)
        name = _PARENTHESIS.sub(" ", text)
        name = _DOTTED.sub(lambda m: m[0].replace(".", "") + " ", name)
        parts = [p.strip() for p in name.split(",")]
        readings = [parts[0]]
        if len(parts) > 1:
            turned = any(w and cost <= 2 for m in self.means(_YEAR.sub("", parts[1])) for w, cost in m.items())
            readings = [f"{parts[1]} {parts[0]}"] if turned else [parts[0], name]
        for step, reading in enumerate(readings):
            if (best := self.by_name(_YEAR.sub("", reading))) is not None:
                return step + 1, *best
        for part in (*inside, parts[0]):
            if (found := self.by_short_name(part.strip())) is not None:
                return 9, 0.0, 0, found
        return 99, 0.0, 0, -1


def load(reference: DataFrame, ident: str, name: str, short: str, kind: str) -> list[tuple[int, str | None, str | None, str | None]]:
    """The reference list's rows, for the broadcast; refused above MAX_ENTRIES."""
    rows = reference.select(ident, name, short, kind).limit(MAX_ENTRIES + 1).collect()
    if len(rows) > MAX_ENTRIES:
        raise ValueError(f"the reference list has more than {MAX_ENTRIES} entries")
    return [tuple(r) for r in rows]


_built: dict[int, tuple[object, Dictionary]] = {}


def _dictionary(shipped) -> Dictionary:
    """The dictionary of a broadcast list, built once per process."""
    known = _built.get(shipped.id if hasattr(shipped, "id") else id(shipped))
    entries = shipped.value
    if known is None or known[0] is not entries:
        _built.clear()
        known = _built[shipped.id if hasattr(shipped, "id") else id(shipped)] = (entries, Dictionary(entries))
    return known[1]


def map_values(df: DataFrame, key: str, value: str, entries: list[tuple[int, str | None, str | None, str | None]], member: str | None = None) -> DataFrame:
    """key, value string, entry int: the entry each typed value means, -1 for none.

    member: df[value] is a JSON payload, and the typed value its member of that name; rows
    whose payload can't be read are left out. Null, absent and blank values give no row.
    Values that aren't text are taken as their JSON text. Repeated rows give repeated rows,
    an empty reference list -1 everywhere. Other columns are not read.
    """
    return _ranked_values(df.select(F.col(key).alias("k"), F.col(value).cast("string").alias("v")), entries, member).select(F.col("k").alias(key), "value", "entry")


def map_to_list(df: DataFrame, key: str, value: str, reference: DataFrame, ident: str, name: str, short: str, kind: str, member: str | None = None) -> DataFrame:
    """As map_values, for a reference list of any length.

    A list of more than MAX_ENTRIES is broadcast block by block (each row's block is the hash of
    its id); every value is looked up in each block and the best of the blocks' entries is its own.
    """
    n = reference.count()
    if n <= MAX_ENTRIES:
        return map_values(df, key, value, load(reference, ident, name, short, kind), member)
    blocks = -(-2 * n // MAX_ENTRIES)  # half full on average, so that uneven hashes don't matter
    rows = materialize(df.select(F.col(key).alias("k"), F.col(value).cast("string").alias("v")).withColumn("row", F.monotonically_increasing_id()), "typed")
    found = []
    for b in range(blocks):
        entries = load(reference.where(F.pmod(F.xxhash64(ident), F.lit(blocks)) == b), ident, name, short, kind)
        found.append(_ranked_values(rows.select(F.struct("row", "k").alias("k"), "v"), entries, member))
    best = reduce(DataFrame.unionByName, found).groupBy("k.row").agg(F.min(F.struct("step", "cost", "rare", "entry")).alias("best"), F.first("k.k").alias("k"), F.first("value").alias("value"))
    return best.select(F.col("k").alias(key), "value", "best.entry")


def _ranked_values(rows: DataFrame, entries: list[tuple[int, str | None, str | None, str | None]], member: str | None) -> DataFrame:
    """k, value, entry, step, cost, rare of rows (k, v)."""
    rows = rows.where("v is not null")
    kind = rows.schema["k"].dataType.simpleString()
    shipped = rows.sparkSession.sparkContext.broadcast(entries)

    def typed_of(text: str) -> str | None:
        if member is None:
            return text
        payload = parse_payload(text)
        found = None if payload is None else payload.get(member)
        if found is None or isinstance(found, str):
            return found
        import json

        return json.dumps(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dictionary = _dictionary(shipped)
        for batch in batches:
            at, typed, found = [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                value = typed_of(text)
                if value is not None and value.strip():
                    at.append(i)
                    typed.append(value if value.isascii() else value.encode("utf-8", "replace").decode())
                    found.append(dictionary.ranked(value))
            step, cost, rare, entry = (pa.array([f[i] for f in found], t) for i, t in enumerate((pa.int32(), pa.float64(), pa.int64(), pa.int32())))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32())), pa.array(typed, pa.string()), entry, step, cost, rare], names=["k", "value", "entry", "step", "cost", "rare"])

    return rows.mapInArrow(run, f"k {kind}, value string, entry int, step int, cost double, rare bigint")


def misses(mapped: DataFrame) -> DataFrame:
    """value, n bigint: the values without entry, and how often each was typed."""
    return mapped.where("entry = -1").groupBy("value").agg(F.count("*").alias("n"))
