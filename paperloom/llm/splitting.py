"""Splitting oversized texts at natural boundaries (problem 8).

Structure-tree packing. The text is parsed into a tree whose levels are sections by heading
depth, blocks, list items and lines, indented items and lines, sentences, clauses and words
of the tokenizer. Only a node too large for a piece is descended into; what is left are the
largest subtrees that fit, in order. These are merged bottom-up: neighbours are joined as long
as they fit, a small rest of one node with the beginning of its next sibling, and where a piece
must end it ends at the boundary highest in the tree that leaves it FILL full, never between a
heading and what follows if another place will do. A word that alone exceeds the limit is cut
between its tokens, at a character.

Each piece after the first repeats the last `overlap` tokens of the piece before (fewer only
where such a cut would fall inside a character, or change how the rest is pre-split). The
token counts are those of the pieces themselves, encoded on their own.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.tokenizer import FOLDER, Automaton, compiled, pack, presplit

# Levels of the tree; headings have 1 to 6.
BLOCK, LINE, INDENTED, SENTENCE, CLAUSE, WORD = 7, 8, 9, 10, 11, 12
#: Level of the place between a heading and what follows.
GLUED = 13
#: Share of a piece that must be filled before it may end at a boundary higher than the last possible one.
FILL = 0.8

_LINE = re.compile("[^\n\r\x0b\x0c\x85\u2028\u2029]*(?:\r\n|[\n\r\x0b\x0c\x85\u2028\u2029]|$)")
_MARKDOWN = re.compile(r"(#{1,6})[ \t]+\S")
_NUMBERED = re.compile(r"((?:\d{1,3}|[A-Z])(?:\.\d{1,3}){0,5})\.?[ \t]+[^\W\d_a-z][^.!?;,]{0,100}$")
_LATEX = re.compile(r"\\(part|chapter|section|subsection|subsubsection|paragraph)\*?\{")
_LATEX_DEPTH = {"part": 1, "chapter": 1, "section": 2, "subsection": 3, "subsubsection": 4, "paragraph": 5}
_UNDERLINE = re.compile(r"(=+|-{3,})[ \t]*$")
_ITEM = re.compile(r"(?:[-*+•‣◦–]|\(?\d{1,3}[.)]|\(?[a-z][.)]|\[\d+\])[ \t]+\S")
_TITLE = re.compile(r"[^\W\d_][^.!?;:,|]{0,78}$")
_TAG = re.compile(r"<(?:(h)([1-6])|(p|div|ul|ol|dl|table|section|article|blockquote|pre|body|head|main|aside|figure)|(li|br|tr|dt|dd|td|th))\b[^<>]{0,300}>", re.I)
# Abbreviations after which a full stop ends no sentence.
_ABBREVIATED = "".join(rf"(?<!\b{x})" for x in ("Dr", "Mr", "Ms", "Prof", "Fig", "Figs", "Sec", "Eq", "No", "vs", "cf", "al", r"e\.g", r"i\.e", r"[A-Z]"))
_SENTENCE = re.compile(_ABBREVIATED + r"[.!?…]+[\"'”’»)\]]*(?=\s+[^a-z\s])|[。！？｡]+[」』”’）]*|[।॥؟۔]+")
_CLAUSE = re.compile(r"[;:,—–](?=\s)|[，、；：،؛]")
_FENCE = re.compile(r"\s*(```|~~~)")


def structure(text: str) -> list[tuple[int, int]]:
    """(start, level) of the units the text is built of, headings to indented lines, in order of their starts."""
    units: list[tuple[int, int]] = []
    lines = [m.span() for m in _LINE.finditer(text) if m.end() > m.start()]
    fenced, blank, under_heading = False, True, False
    for k, (start, end) in enumerate(lines):
        body = text[start:end].rstrip()
        line = body.lstrip()
        if not line:
            blank = True
            if text[start:end].strip(" \t\r\n"):  # a form feed and the like
                units.append((start, BLOCK))
            continue
        fence = bool(_FENCE.match(line))
        depth = 0
        if not fenced and not fence:
            if m := _MARKDOWN.match(line):
                depth = len(m[1])
            elif m := _LATEX.match(line):
                depth = _LATEX_DEPTH[m[1]]
            elif len(line) <= 120:
                following = lines[k + 1] if k + 1 < len(lines) else None
                under = text[slice(*following)].strip() if following else ""
                if under and len(line) > 1 and (m := _UNDERLINE.match(under)):
                    depth = 1 if under[0] == "=" else 2
                elif blank and (m := _NUMBERED.match(line)):
                    depth = min(6, 2 + m[1].count("."))
                elif blank and under == "" and following and _TITLE.match(line) and line[:1].isupper():
                    depth = 2
                elif blank and _TITLE.match(line) and len(line) <= 40 and line[:1].isupper() and " " not in line:
                    depth = 2
        if depth:
            units.append((start, depth))
        elif blank and not fenced:
            units.append((start, BLOCK if not under_heading else LINE))
        else:
            item = _ITEM.match(line)
            units.append((start, INDENTED if body[:1] in " \t" or fenced and not item else LINE))
        under_heading, blank = bool(depth), False
        if fence:
            fenced = not fenced
    if "<" in text:
        for m in _TAG.finditer(text):
            units.append((m.start(), int(m[2]) if m[1] else BLOCK if m[3] else LINE))
        units.sort()
    return units


class _Tree:
    """The tree of one text over its words, opened as far as needed."""

    def __init__(self, text: str, words: list[str], counts: np.ndarray, automaton: Automaton, limit: int, overlap: int) -> None:
        self.text, self.words, self.automaton = text, words, automaton
        self.limit, self.overlap = limit, overlap
        self.tokens = np.concatenate([[0], np.cumsum(counts)])
        self.chars = np.concatenate([[0], np.cumsum([len(w) for w in words])])
        self.tokens_at = self.tokens.tolist()
        level = np.full(len(words) + 1, WORD, np.int8)
        units = structure(text)
        if units:
            at = np.searchsorted(self.chars, [u[0] for u in units])
            np.minimum.at(level, at, np.array([u[1] for u in units], np.int8))
            self.glued = {int(w) for u, v, w in zip(units, units[1:], at[1:].tolist(), strict=False) if u[1] <= 6 < v[1]}
        else:
            self.glued = set()
        self.level = level
        self.out: list[tuple[int, int]] = []

    def room(self, start: int) -> int:
        return self.limit - (self.overlap if start else 0)

    def children(self, i: int, j: int, depth: int) -> list[int]:
        """Starts of the children of the node of words i to j at a depth, i first, and j."""
        if depth in (SENTENCE, CLAUSE):
            a, b = int(self.chars[i]), int(self.chars[j])
            marks = [m.end() for m in (_SENTENCE if depth == SENTENCE else _CLAUSE).finditer(self.text, a, b)]
            inner = sorted({x for x in np.searchsorted(self.chars, marks).tolist() if i < x < j})
        elif depth == WORD:
            inner = list(range(i + 1, j))
        else:
            inner = (np.flatnonzero(self.level[i + 1 : j] <= depth) + i + 1).tolist()
        return [i, *inner, j]

    def subtrees(self, i: int, j: int) -> tuple[list[int], list[int]]:
        """Starts of the largest subtrees that fit into a piece, and j; the level of the boundary at each start."""
        t = self.tokens_at
        starts, levels = [], []
        todo = [(i, j, 1, 0)]
        while todo:
            i, j, depth, level = todo.pop()
            if t[j] - t[i] <= self.room(i) or j - i == 1:
                starts.append(i)
                levels.append(level)
                continue
            while depth < WORD and len(cuts := self.children(i, j, depth)) == 2:
                depth += 1
            if depth == WORD:  # words, a few together: nothing tells them apart
                cuts, step = [i], self.room(1) / 4
                for k in range(i + 1, j):
                    if t[k + 1] - t[cuts[-1]] > step:
                        cuts.append(k)
                cuts.append(j)
            todo.extend((cuts[k], cuts[k + 1], min(depth + 1, WORD), depth if k else level) for k in range(len(cuts) - 2, -1, -1))
        starts.append(j)
        glued = self.glued
        return starts, [GLUED if a in glued and k else b for k, (a, b) in enumerate(zip(starts, levels, strict=False))]

    def pack(self, i: int, j: int) -> None:
        """Append the pieces of words i to j."""
        starts, levels = self.subtrees(i, j)
        at = [self.tokens_at[w] for w in starts]
        k, last = 0, len(starts) - 1
        while k < last:
            room, base = self.room(starts[k]), at[k]
            end = max(k + 1, bisect_right(at, base + room, k + 1) - 1)
            if end < last:
                rest = at[last] - base
                if end > k + 1:
                    if rest <= room + self.room(1):  # two pieces: also mind what is left for the second
                        first = bisect_left(at, max(at[last] - self.room(1), base + room / 4), k + 1, end)
                        end = min(range(first, end + 1), key=lambda e: (levels[e], abs(at[last] + base - 2 * at[e])))
                    else:
                        first = bisect_left(at, base + FILL * room, k + 1, end)
                        end = min(range(first, end + 1), key=lambda e: (levels[e], -e))
            self.out.append((starts[k], starts[end]))
            k = end

    def end_run(self, i: int, j: int) -> int:
        """What the count of words i to j changes by when white space at their end is pre-split without what follows."""
        k = j
        while k > i and self.words[k - 1].isspace():
            k -= 1
        if j - k < 1:
            return 0
        run = "".join(self.words[k:j])
        return self.automaton.count(run) - (self.tokens_at[j] - self.tokens_at[k])


def _char_cuts(ids: tuple[int, ...], labels: list[bytes]) -> list[int]:
    """For each place between the tokens of a word, the number of characters before it, -1 inside a character."""
    out, data = [0], b"".join([labels[i] for i in ids])
    # characters begin at bytes that aren't continuation bytes
    starts = np.concatenate([[True], (np.frombuffer(data, np.uint8)[1:] & 0xC0) != 0x80, [True]])
    before = np.cumsum(starts) - 1
    at = 0
    for i in ids:
        at += len(labels[i])
        out.append(int(before[at]) if starts[at] else -1)
    return out


def split_text(text: str, automaton: Automaton, limit: int, overlap: int) -> list[tuple[int, int, int, int]] | None:
    """(start, end, overlapping characters, tokens) of the pieces of a text; None if it is within the limit."""
    if len(text) <= limit and len(text.encode("utf-8", "surrogatepass")) <= limit:
        return None  # a token has at least one byte
    words = presplit(text)
    encoded = automaton.by_word(words)
    counts = np.fromiter(map(len, encoded), np.int64, len(words))
    if int(counts.sum()) <= limit:
        return None
    tree = _Tree(text, words, counts, automaton, limit, overlap)
    tree.pack(0, len(words))
    # Spans of new text as (token, character) places; words above the limit are cut between tokens.
    labels, chars, t = automaton.labels, tree.chars.tolist(), tree.tokens_at
    spans: list[tuple[tuple[int, int], tuple[int, int]]] = []

    def whole_words(i: int, j: int) -> None:
        if j - i > 1 and t[j] - t[i] + tree.end_run(i, j) > tree.room(i):
            whole_words(i, (i + j) // 2)
            whole_words((i + j) // 2, j)
        else:
            spans.append(((t[i], chars[i]), (t[j], chars[j])))

    for i, j in tree.out:
        if t[j] - t[i] <= tree.room(i):
            whole_words(i, j)
            continue
        cuts = _char_cuts(encoded[i], labels)
        at = 0
        while at < len(cuts) - 1:
            to = min(len(cuts) - 1, at + max(1, tree.room(chars[i] + cuts[at])))
            while to > at + 1 and cuts[to] < 0:
                to -= 1
            while cuts[to] < 0:  # a character of more tokens than there is room for
                to += 1
            spans.append(((t[i] + at, chars[i] + cuts[at]), (t[i] + to, chars[i] + cuts[to])))
            at = to

    def place(token: int) -> tuple[int, int]:
        """Character at which a token begins, or the next that begins one, and the index of the word it lies in."""
        w = bisect_right(t, token) - 1
        if (k := token - t[w]) == 0:
            return chars[w], w
        cuts = _char_cuts(encoded[w], labels)
        while cuts[k] < 0:
            k += 1
        return chars[w] + cuts[k], w if k < len(cuts) - 1 else w + 1

    pieces: list[tuple[int, int, int, int]] = []
    for (token, start), (stop, end) in spans:
        begin, tokens = start, -1
        inside = bisect_left(chars, start), bisect_left(chars, end)
        on_words = chars[inside[0]] == start and chars[inside[1]] == end
        if pieces and overlap:
            begin, w = place(max(0, token - overlap))
            if chars[w] < begin:  # inside a word: what follows must be pre-split as before
                part = words[w][begin - chars[w] :]
                if presplit(part + "".join(words[w + 1 : w + 2])) != [part, *words[w + 1 : w + 2]]:
                    begin, w = chars[w + 1], w + 1
            begin = min(max(begin, pieces[-1][0]), start)
        if on_words:
            w = bisect_left(chars, begin)
            head = automaton.count(text[begin : chars[w]]) if chars[w] > begin else 0
            tokens = head + t[inside[1]] - t[w] + tree.end_run(w, inside[1])
        else:
            tokens = automaton.count(text[begin:end])
        if tokens > limit and begin < start:
            begin = start
            tokens = automaton.count(text[begin:end])
        pieces.append((begin, end, start - begin, tokens))
    return pieces


def split_column(df: DataFrame, key: str, text: str, limit: int = 512, overlap: int = 32, vocabulary: str = "byte_bpe_50k.json", folder: str = FOLDER) -> DataFrame:
    """key, piece int, start int, end int, overlap_chars int, n_tokens int, text: the pieces of every text above the limit.

    start and end are places in the text in code points; without their first overlap_chars,
    the pieces of a text joined are the text. n_tokens is what the piece measures on its own
    and is at most the limit; only a character that alone has more tokens than there is room
    for would exceed it. Texts within the limit, null and empty ones among them, give no rows;
    repeated rows give their pieces again. Other columns are not read.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be below the limit")
    rows = df.select(F.col(key).alias("k"), F.col(text).alias("t")).where("t is not null")
    kind = rows.schema["k"].dataType.simpleString()
    shipped = df.sparkSession.sparkContext.broadcast(pack(vocabulary, folder))
    names = ["k", "piece", "start", "end", "overlap_chars", "n_tokens", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = compiled(shipped.value)
        for batch in batches:
            columns: list[list] = [[] for _ in range(6)]
            at: list[int] = []
            size = 0
            for row in range(batch.num_rows):
                whole = batch.column(1)[row].as_py()
                for k, (begin, end, shared, tokens) in enumerate(split_text(whole, automaton, limit, overlap) or ()):
                    at.append(row)
                    for column, value in zip(columns, (k, begin, end, shared, tokens, whole[begin:end]), strict=True):
                        column.append(value)
                    size += end - begin
                if at and (size > 4_000_000 or row == batch.num_rows - 1):
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32())), *[pa.array(c, pa.int32()) for c in columns[:5]], pa.array(columns[5], pa.string())], names=names)
                    columns, at, size = [[] for _ in range(6)], [], 0

    return rows.mapInArrow(run, f"k {kind}, piece int, start int, end int, overlap_chars int, n_tokens int, text string").withColumnRenamed("k", key)
