import os
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paperloom.llm import packing as P
from paperloom.llm import splitting as S
from paperloom.llm import tokenizer as T


def check_packing(items, got, capacity):
    """items: (key, source, size); got: rows of pack()."""
    by_key, by_container = {}, {}
    for r in got:
        by_key.setdefault(r["key"], []).append(r)
        by_container.setdefault(r["container"], []).append(r)
    for key, src, size in items:
        pieces = sorted(by_key.pop(key), key=lambda r: r["piece"])
        assert [p["piece"] for p in pieces] == list(range(max(1, -(-(size or 0) // capacity))))
        assert [p["start"] for p in pieces] == [capacity * k for k in range(len(pieces))]
        assert sum(p["n_tokens"] for p in pieces) == (size or 0)
        assert all(p["n_tokens"] == capacity for p in pieces[:-1])
        assert all(p["source"] == (src or "") for p in pieces)
    assert not by_key
    for rows in by_container.values():
        end = 0
        for r in sorted(rows, key=lambda r: (r["offset"], r["n_tokens"])):
            assert r["offset"] == end
            end += r["n_tokens"]
        assert end <= capacity
    return len(by_container)


@pytest.mark.parametrize("targets", [None, {"a": 0.6, "b": 0.1}])
@pytest.mark.parametrize("bucket_rows", [20_000, 50])
def test_pack(spark, targets, bucket_rows, monkeypatch):
    monkeypatch.setattr(P, "BUCKET_ROWS", bucket_rows)
    rng = random.Random(1)
    items = [(i, rng.choice(["a", "a", "a", "b", "c", None]), rng.choice([0, 1, 5, 20, 60, 99, 100, 101, 350, None])) for i in range(900)]
    df = spark.createDataFrame(items, "key bigint, source string, size bigint").withColumn("win", F.lit("clash")).withColumn("n", F.lit(1)).repartition(7)
    got = [r.asDict() for r in P.pack(df, "key", "source", "size", 100, 8, targets).collect()]
    used = check_packing(items, got, 100)
    total = sum(s or 0 for _, _, s in items)
    assert total / (used * 100) > 0.85
    again = [r.asDict() for r in P.pack(df.repartition(3), "key", "source", "size", 100, 8, targets).collect()]
    assert sorted(map(str, got)) == sorted(map(str, again))
    mix = P.window_mixture(df, "key", "source", "size", 100, 8, targets).collect()
    assert all(-101 <= r.deficit for r in mix)
    last = {}
    for r in mix:
        last[r.source] = max(last.get(r.source, -1), r.win)
    assert all(r.deficit <= 101 for r in mix if r.win < last[r.source])


def test_pack_edges(spark):
    schema = "key bigint, source string, size bigint"
    assert P.pack(spark.createDataFrame([], schema), "key", "source", "size", 100).count() == 0
    rows = [(None, None, 250), (1, "s", 0), (1, "s", 0)]
    got = P.pack(spark.createDataFrame(rows, schema), "key", "source", "size", 100, 4).collect()
    assert sorted(r.n_tokens for r in got) == [0, 0, 50, 100, 100]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 50), min_size=1, max_size=60))
def test_best_fit(sizes):
    container, offset = P.best_fit(np.array(sizes), 50)
    total = {}
    for c, o, s in zip(container, offset, sizes, strict=True):
        total[c] = total.get(c, 0) + s
    assert max(total.values()) <= 50
    assert len(total) <= 2 * -(-sum(sizes) // 50) + 1


pytest_tok = pytest.mark.skipif(not os.path.isdir(T.FOLDER), reason="no vocabulary files")

SENTENCES = "This is a sentence about models. It has two parts, e.g. this one; and Fig. 3 shows more! "
TEXTS = [
    SENTENCES * 40,
    "# Head\n\nIntro para here.\n\n## One\n\n" + SENTENCES * 6 + "\n\n## Two\n\n- item one is here\n- item two\n  - nested item\n- item three\n\n" + SENTENCES * 9,
    "Title Words Here\n\nAbstract\n" + SENTENCES * 4 + "\n\n1 Introduction\n" + SENTENCES * 5 + "\n\n1.1 Related Work\n" + SENTENCES * 5,
    "<h1>A</h1><p>" + SENTENCES * 5 + "</p><ul><li>x</li><li>" + SENTENCES * 3 + "</li></ul>",
    "中文没有空格的文本测试" * 80, "x" * 3000, " " * 2000, "\n" * 2000, " \n\t" * 500, "🙂" * 300, "a\r\nb\r" * 300, "don't'll's" * 200, "!'s?'re.." * 150, "ab 'sc'd 'tree " * 120,
    "def f(x):\n    return x\n" * 60, "```\n# not a head\n" + "code line\n" * 100 + "```\n", "word\x00\x1c\x85" * 200, "Ключевые слова и текст. " * 80, "é" * 900 + " " + "ü" * 900,
]


@pytest.fixture(scope="module")
def automaton():
    return T.compiled(T.pack("byte_bpe_50k.json"))


def check_pieces(text, pieces, automaton, limit, overlap):
    assert "".join(text[b + o : e] for b, e, o, _ in pieces) == text
    for k, (b, e, o, n) in enumerate(pieces):
        assert n == automaton.count(text[b:e]) <= limit
        if k:
            assert b >= pieces[k - 1][0] and b + o == pieces[k - 1][1]
            assert automaton.count(text[b : b + o]) <= overlap + 1
        else:
            assert o == 0


@pytest_tok
@pytest.mark.parametrize(("limit", "overlap"), [(20, 0), (20, 5), (64, 8), (100, 30)])
def test_split(automaton, limit, overlap):
    for text in TEXTS:
        pieces = S.split_text(text, automaton, limit, overlap)
        assert (pieces is None) == (automaton.count(text) <= limit)
        if pieces:
            check_pieces(text, pieces, automaton, limit, overlap)


@pytest_tok
@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab'st \n.#-中é🙂1", max_size=300))
def test_split_random(automaton, text):
    if pieces := S.split_text(text, automaton, 16, 4):
        check_pieces(text, pieces, automaton, 16, 4)


@pytest_tok
def test_natural_cuts(automaton):
    pieces = S.split_text(TEXTS[0], automaton, 100, 0)
    assert all(TEXTS[0][:e].rstrip()[-1] in ".!" for _, e, _, _ in pieces)
    pieces = S.split_text(TEXTS[1], automaton, 160, 0)
    assert any(TEXTS[1][b:].startswith("## Two") for b, _, _, _ in pieces)
    pieces = S.split_text(TEXTS[0], automaton, 100, 20)
    assert all(automaton.count(TEXTS[0][b : b + o]) == 20 for b, _, o, _ in pieces[1:])


@pytest_tok
def test_structure_levels():
    text = "Top\n===\n\npara\nline\n\n# H1\n\n### H3\n- a\n  - b\n\n2.1 Numbered Head\nx\n"
    got = {text[at:].split("\n")[0].strip(): level for at, level in S.structure(text)}
    assert got["Top"] == 1 and got["# H1"] == 1 and got["### H3"] == 3 and got["2.1 Numbered Head"] == 3
    assert got["para"] == S.LINE or got["para"] == S.BLOCK
    assert got["- b"] == S.INDENTED


@pytest_tok
def test_column(spark, automaton):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(100, None), (101, ""), (None, SENTENCES * 60), (0, TEXTS[0])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as k", "2 as start")
    got = S.split_column(df, "doc_id", "text", 64, 8).collect()
    want = sorted((str(k), i, *p, t[p[0] : p[1]]) for k, t in rows if t for i, p in enumerate(S.split_text(t, automaton, 64, 8) or ()))
    assert sorted((str(r.doc_id), r.piece, r.start, r.end, r.overlap_chars, r.n_tokens, r.text) for r in got) == want
    assert S.split_column(df.limit(0), "doc_id", "text").count() == 0


@pytest_tok
def test_pack_documents(spark, automaton):
    rows = [(i, "s", t) for i, t in enumerate(TEXTS)] + [(100, None, None), (101, "", "")]
    got = [r.asDict() for r in P.pack_documents(spark.createDataFrame(rows, "key bigint, source string, text string"), "key", "source", "text", 256, 4).collect()]
    check_packing([(k, s, automaton.count(t)) for k, s, t in rows], got, 256)


def test_bottom_up(automaton):
    """Headed sections of any size: pieces are well filled, none ends with a heading, and joined they are the text."""
    rng = random.Random(8)
    words = "the model learns a sparse index of claims and papers from long noisy lists while readers wait".split()
    fill, small = [], 0
    for _ in range(60):
        text = ""
        for k in range(12):
            text += f"{'#' * rng.randint(1, 2)} Part {k}\n\n"
            for _ in range(rng.randint(1, 9)):
                text += " ".join(" ".join(rng.choices(words, k=rng.randint(5, 25))).capitalize() + "." for _ in range(rng.randint(1, 6))) + "\n\n"
        pieces = S.split_text(text, automaton, 512, 32)
        assert "".join(text[b + o : e] for b, e, o, _ in pieces) == text and all(n <= 512 for *_, n in pieces)
        assert not any(text[b:e].rstrip().splitlines()[-1].startswith("#") for b, e, _, _ in pieces)
        fill += [n / 512 for *_, n in pieces]
        small += sum(n < 128 for *_, n in pieces)
    assert sum(fill) / len(fill) >= 0.75 and small < 0.1 * len(fill)


def test_many_alike_spread_over_buckets(spark, monkeypatch):
    """A third of the rows is one row: each copy is packed, and windows stay within their tokens."""
    monkeypatch.setattr(P, "BUCKET_ROWS", 50)
    rows = [(None, "a", 7)] * 300 + [(i, "ab"[i % 2], 1 + i % 9) for i in range(600)]
    df = spark.createDataFrame(rows, "id int, src string, size int")
    items = P.queue_items(df, "id", "src", "size", 20, 4)
    per_window = {}
    for r in items.collect():
        per_window[r.win] = per_window.get(r.win, 0) + r.n
    assert sum(per_window.values()) == sum(r[2] for r in rows) and max(per_window.values()) <= 80 + 2 * 9
    got = P.pack(df, "id", "src", "size", 20, 4).collect()
    assert sorted((str(r["id"]), r["n_tokens"]) for r in got) == sorted((str(r[0]), r[2]) for r in rows)
