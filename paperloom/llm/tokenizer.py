"""Encoding with a public byte-level BPE by a tokenization automaton (problem 6).

The automaton is compiled from the merges by successive merge gadgets. It starts with one
state that loops on every byte; the states are S(t), "the last arc read was t". The gadget
of a merge (a, b) -> c changes it so that c is read wherever a then b was read before:
S(a) becomes a copy of itself without the arc b, every state with an arc a gets an arc c,
and c leads to where b led. After all merges exactly one path spells each byte string, and
its labels are the string's BPE encoding. The automaton is deterministic in its labels.

Written out, the arcs of 50,000 states would be 2.5 thousand million cells; the gadgets are
kept as tables instead (left part, right part, merged pair), from which whether S(t) has an
arc u follows by undoing the gadgets newest first, and is kept once known. A second table
moves byte by byte through the spellings of labels. Encoding a pre-split word follows these
tables: the longest label that S(last) has an arc for and from which the end can be
reached; positions from which it can't are marked, so the time is linear in the word's
length for a bounded label length. Decoding emits the arc labels of the path as ids.

Words are encoded once per Python worker: a bounded table keeps them. Nothing depends on
how texts are spread over partitions.
"""

from __future__ import annotations

import base64
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Folder of the vocabulary files; a parameter of every function below.
FOLDER = os.environ.get("PAPERLOOM_TOKENIZERS", "/opt/tokenizers")

# The pre-splitting pattern of the byte-level vocabularies, and the same for
# texts of ASCII alone. \s is written out as Unicode's White_Space.
_SPACE = r"\t-\r \x85\xa0" + "".join(map(chr, [0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_SPLIT = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
_SPLIT_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")

#: Words a worker keeps; beyond it the table is emptied and filled anew.
KEPT_WORDS = 150_000
#: Arcs a worker keeps, likewise.
KEPT_ARCS = 500_000
#: Longer words aren't kept.
KEPT_LENGTH = 64


def presplit(text: str) -> list[str]:
    """The words that are encoded one by one; joined they are the text."""
    return (_SPLIT_ASCII if text.isascii() else _SPLIT).findall(text)


def read_vocabulary(name: str, folder: str = FOLDER) -> list[bytes]:
    """The labels by id, of a .tiktoken file of ranks or a .json file of a byte-level BPE."""
    path = os.path.join(folder, name)
    if name.endswith(".json"):
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        # Bytes that print stand for themselves in this format; the others, in order, for U+0100 on.
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        hidden = [b for b in range(256) if b not in set(shown)]
        back = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        by_id = {i: bytes(back[c] for c in t) for t, i in vocab.items() if all(c in back for c in t)}
    else:
        with open(path, "rb") as f:
            by_id = {int(i): base64.b64decode(t) for t, i in (line.split() for line in f if line.strip())}
    labels = [by_id[i] for i in range(len(by_id)) if i in by_id]
    if len(labels) < len(by_id):  # special tokens leave no gap in these vocabularies
        raise ValueError(f"{name}: ids aren't consecutive")
    specials = [i for i, t in enumerate(labels) if t == b"<|endoftext|>" and i == len(labels) - 1]
    return labels[: specials[0]] if specials else labels


class Automaton:
    """Tables of the automaton over the given labels (ids in order of their merges, single bytes first)."""

    def __init__(self, labels: list[bytes]) -> None:
        self.labels = labels
        self.ids: dict[bytes, int] = {}
        self.left: list[int] = []
        self.right: list[int] = []
        self.merged: dict[int, int] = {}
        self.next: dict[int, int] = {}
        self.ends: list[int] = [-1]
        self.arcs: dict[int, bool] = {}
        for label in labels:
            self._gadget(label)
        self.words: dict[str, tuple[int, ...]] = {}

    def _gadget(self, label: bytes) -> None:
        """Add a label: for more than one byte, the gadget of its merge, whose parts are its path so far."""
        new = len(self.ids)
        if len(label) == 1:
            parts = (new, new)
        else:
            parts = tuple(self.path(label))
            if len(parts) != 2:
                raise ValueError(f"label {new} isn't the merge of two labels before it")
            self.merged[parts[0] << 20 | parts[1]] = new
        self.left.append(parts[0])
        self.right.append(parts[1])
        at = 0
        for byte in label:
            to = self.next.get(at << 8 | byte)
            if to is None:
                to = self.next[at << 8 | byte] = len(self.ends)
                self.ends.append(-1)
            at = to
        self.ends[at] = new
        self.ids[label] = new
        self.arcs.clear()  # the gadget changed the automaton

    def arc(self, t: int, u: int) -> bool:
        """Whether state S(t) has an arc u once all gadgets are in place."""
        key = t << 20 | u
        known = self.arcs.get(key)
        if known is None:
            if len(self.arcs) >= KEPT_ARCS:
                self.arcs.clear()
            known = self.arcs[key] = self._arc(t, u)
        return known

    def _arc(self, t: int, u: int) -> bool:
        """Undo the gadgets newest first: S(t) got u with u's gadget if it had left(u) just after, and inherited its arcs from S(right(t)) if t is newer."""
        left, right, merged, before = self.left, self.right, self.merged, 1 << 30
        while True:
            if merged.get(t << 20 | u, before) < before:  # this gadget took the arc away
                return False
            if t > u:
                if right[t] == t:
                    # t is a byte, so u < t is one too
                    return True
                before, t = t, right[t]
            else:
                if left[u] == u:
                    if right[t] == t:
                        return True
                    before, t = t, right[t]
                else:
                    before, u = u + 1, left[u]

    def starting(self, data: bytes, start: int) -> list[int]:
        """The labels that data has at start, the longest last."""
        at, found, get, ends = 0, [], self.next.get, self.ends
        for i in range(start, len(data)):
            to = get(at << 8 | data[i])
            if to is None:
                break
            at = to
            if ends[at] >= 0:
                found.append(ends[at])
        return found

    def path(self, data: bytes) -> list[int]:
        """Labels of the one path that spells data."""
        out: list[int] = []
        choices: list[list[int]] = []
        dead: set[int] = set()
        labels, arc, arcs = self.labels, self.arc, self.arcs
        pos, size = 0, len(data)
        options = self.starting(data, 0)
        while pos < size:
            last = out[-1] if out else -1
            while options:
                label = options.pop()
                end = pos + len(labels[label])
                if end in dead:
                    continue
                if last >= 0:
                    known = arcs.get(last << 20 | label)
                    if not (arc(last, label) if known is None else known):
                        continue
                out.append(label)
                choices.append(options)
                pos = end
                options = self.starting(data, pos)
                break
            else:  # no way on from here
                dead.add(pos)
                label = out.pop()
                options = choices.pop()
                pos -= len(labels[label])
        return out

    def word(self, word: str) -> tuple[int, ...]:
        """Ids of a pre-split word."""
        data = word.encode("utf-8", "surrogatepass")
        one = self.ids.get(data)
        got = (one,) if one is not None else tuple(self.path(data))
        if len(word) <= KEPT_LENGTH:
            if len(self.words) >= KEPT_WORDS:
                self.words.clear()
            self.words[word] = got
        return got

    def by_word(self, words: list[str]) -> list[tuple[int, ...]]:
        """Ids of each word."""
        get, encode = self.words.get, self.word
        return [get(w) or encode(w) for w in words]

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; none for null and empty texts."""
        if not text:
            return []
        get, encode = self.words.get, self.word
        return [i for w in presplit(text) for i in get(w) or encode(w)]

    def count(self, text: str | None) -> int:
        """Number of ids of a text."""
        if not text:
            return 0
        get, encode = self.words.get, self.word
        return sum([len(get(w) or encode(w)) for w in presplit(text)])

    def decode(self, ids: list[int]) -> bytes:
        """The labels of the arcs, one after the other."""
        return b"".join([self.labels[i] for i in ids])


@lru_cache(maxsize=4)
def _compiled(packed: bytes) -> Automaton:
    return Automaton([base64.b64decode(x) for x in packed.split(b"\n")])


def compiled(packed: bytes) -> Automaton:
    """The automaton of a packed vocabulary, compiled once per process."""
    return _compiled(packed)


def pack(name: str, folder: str = FOLDER) -> bytes:
    """A vocabulary as one value that travels to the executors (about 1 MB for 50,000 labels, whatever the data)."""
    return b"\n".join(base64.b64encode(x) for x in read_vocabulary(name, folder))


def encode_column(df: DataFrame, key: str, text: str, vocabulary: str = "byte_bpe_50k.json", folder: str = FOLDER) -> DataFrame:
    """key, ids array<int>: each text's ids, without special tokens.

    One row for each row of df, repeated and null keys included. Null and empty texts have an
    empty list of ids. Strings that look like special tokens are ordinary text. Whole texts
    are encoded, whatever their length. Other columns are not read.
    """
    from pyspark.sql import functions as F

    rows = df.select(F.col(key).alias("k"), F.col(text).alias("t"))
    kind = rows.schema["k"].dataType.simpleString()
    shipped = df.sparkSession.sparkContext.broadcast(pack(vocabulary, folder))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = compiled(shipped.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                ids = [np.array(automaton.encode(t), np.int32) for t in part.column(1).to_pylist()]
                offsets = np.zeros(len(ids) + 1, np.int32)
                np.cumsum([len(x) for x in ids], out=offsets[1:])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))], names=["k", "ids"])

    return rows.mapInArrow(run, f"k {kind}, ids array<int>").withColumnRenamed("k", key)


def token_counts(df: DataFrame, columns: list[str], text: str, vocabulary: str = "byte_bpe_50k.json", folder: str = FOLDER) -> DataFrame:
    """columns and n_tokens bigint, 0 for null and empty texts; one row for each row of df."""
    from pyspark.sql import functions as F

    rows = df.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)], F.col(text).alias("t"))
    kinds = [f"c{i} {rows.schema[f'c{i}'].dataType.simpleString()}" for i in range(len(columns))]
    shipped = df.sparkSession.sparkContext.broadcast(pack(vocabulary, folder))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = compiled(shipped.value)
        for batch in batches:
            counts = [automaton.count(t.as_py()) for t in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(counts, pa.int64())], names=[*batch.schema.names[:-1], "n_tokens"])

    out = rows.mapInArrow(run, ", ".join([*kinds, "n_tokens bigint"]))
    for i, c in enumerate(columns):
        out = out.withColumnRenamed(f"c{i}", c)
    return out
