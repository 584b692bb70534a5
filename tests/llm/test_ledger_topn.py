import math
import unicodedata

import pytest
from pyspark.sql import functions as F

from paperloom.llm import ledger as L
from paperloom.llm.topn import top_n

PAPERS = [
    (5, "W-1", "Graph  Models!"), (2, "w1", "graph models"), (9, "W1", "GRAPH MODELS"), (1, "W1", "Graph Mödels"),
    (7, None, "x"), (8, "!!", "x"), (3, "a+b", "C"), (4, "ab", "C"), (6, "A+B", "c."), (10, "straße", "t"), (11, "STRASSE", "T"),
    (12, "", ""), (13, "q", None), (14, "ΣΑΣ ΑΣ", "y"), (15, "σασας", "y"), (16, "long" * 50000, "z"), (17, "LONG" * 50000, "z"),
]


def brute(rows):
    def canon(s):
        return "".join(c for c in s or "" if not c.isspace() and not unicodedata.category(c).startswith("P")).upper().lower()

    first, out = {}, set()
    for o, a, b in sorted(rows):
        key = (canon(a), canon(b))
        if all(key) and first.setdefault(key, o) != o:
            out.add((first[key], o))
    return out


@pytest.mark.parametrize("batches", [1, 3, 30])
def test_copies(spark, batches):
    df = spark.createDataFrame(PAPERS, "ord bigint, paper_id string, title string").withColumn("key", F.lit(1)).withColumn("n", F.lit("clash"))
    led = L.in_batches(L.Ledger(spark), df, ("paper_id", "title"), "ord", batches)
    got = [tuple(r) for r in L.copies(df, led, ("paper_id", "title"), "ord").collect()]
    assert set(got) == brute(PAPERS) and len(got) == len(set(got))
    assert sum(r.n for r in led.table().collect()) == 13


def test_hot_key(spark):
    df = spark.range(30000).selectExpr("id as ord", "if(id % 3 = 0, 'hot', concat('p', id)) as paper_id", "'t' as title")
    led = L.in_batches(L.Ledger(spark), df, ("paper_id", "title"), "ord", 2)
    old, L.HOT = L.HOT, 10**9
    try:
        want = set(map(tuple, L.copies(df, led, ("paper_id", "title"), "ord").collect()))
    finally:
        L.HOT = old
    got = set(map(tuple, L.copies(df, led, ("paper_id", "title"), "ord").collect()))
    assert got == want == {(0, i) for i in range(3, 30000, 3)}


def test_empty_ledger(spark):
    df = spark.createDataFrame([], "ord bigint, paper_id string, title string")
    led = L.in_batches(L.Ledger(spark), df, ("paper_id", "title"), "ord", 2)
    assert L.copies(df, led, ("paper_id", "title"), "ord").count() == 0


def brute_top(rows, n):
    groups, out = {}, set()
    for q, s, o in rows:
        if q is not None and s is not None and not math.isnan(s):
            groups.setdefault(q, []).append((-s, o))
    for q, xs in groups.items():
        out |= {(q, i + 1, o) for i, (_, o) in enumerate(sorted(xs)[:n])}
    return out


@pytest.mark.parametrize("n", [0, 1, 3, 10])
def test_top_n(spark, n):
    rows = [(f"q{i % 7}" if i % 3 else "hot", float(i * 37 % 11), i) for i in range(3000)]
    rows += [(None, 1.0, 9001), ("q1", None, 9002), ("q1", math.nan, 9003), ("tiny", -0.0, 9005), ("tiny", 0.0, 9004), ("", 5.0, 9006), ("x" * 100000, 1.0, 9007), ("inf", math.inf, 9008)]
    df = spark.createDataFrame(rows, "qid string, score double, ord bigint").withColumn("rnk", F.lit("clash")).withColumn("g", F.lit(1)).repartition(5)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for size in ("7", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        got = [tuple(r) for r in top_n(df, "qid", "score", "ord", n).collect()]
        assert set(got) == brute_top(rows, n) and len(got) == len(set(got))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert top_n(df.limit(0), "qid", "score", "ord", n).count() == 0


def test_small_batches_leave_the_ledger_alone(spark):
    """A small batch becomes a table of its own; counts and earliest rows are those of all rows, whatever the batches."""
    rows = [(f"p{i % 400}", f"Title {i % 400}", i) for i in range(2000)]
    df = spark.createDataFrame(rows, "paper_id string, title string, ord bigint")
    ledger = L.Ledger(spark, 4)
    ledger.update(df.where("ord >= 500"), ("paper_id", "title"), "ord")
    first = ledger.runs[0]
    for low in range(0, 500, 50):
        ledger.update(df.where(f"ord >= {low} and ord < {low + 50}"), ("paper_id", "title"), "ord")
        assert low or (ledger.runs[0] == first and len(ledger.runs) == 2)
    got = sorted((r.keep_ord, r.n) for r in ledger.table().collect())
    assert got == [(i, 5) for i in range(400)] and len(ledger.runs) <= 4
    runs = ledger.runs
    ledger.update(df.where("ord < 0"), ("paper_id", "title"), "ord")
    assert ledger.runs == runs
    ledger.drop()
    assert ledger.table().count() == 0
