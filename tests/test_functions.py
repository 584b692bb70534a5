import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paperloom.functions import identity as I
from paperloom.functions import scoring as S
from paperloom.functions import text as T
from paperloom.functions import understanding as U
from paperloom.functions import variants as V


def values(spark, kind, rows, expr):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    return [r.y for r in df.select("i", expr(F.col("x")).alias("y")).orderBy("i").collect()]


def test_tokens(spark):
    got = values(spark, "string", ["The Graph-based models, of GRAPH-based x-", None, "", "a b c", "p" * 100000], T.tokens)
    assert got[0] == ["graph-based", "models"] and got[1:4] == [[], [], []] and got[4] == ["p" * 100000]


def test_snippet(spark):
    text = "First sentence here. Second one is longer than the window."
    cut = lambda n: values(spark, "string", [text], lambda c: T.snippet(c, n))[0]
    assert cut(25) == "First sentence here.…" and cut(0) == text and cut(1000) == text
    assert values(spark, "string", ["wordone wordtwo wordthree", "x" * 30, None, "  "], lambda c: T.snippet(c, 18)) == ["wordone wordtwo…", "x" * 18 + "…", "", ""]


def test_rewrite_and_templates(spark):
    rows = ["Could you list papers about graph neural networks?", "Find papers on RAG", None, "", "what are the transformers", "Papers about X"]
    assert values(spark, "string", rows, T.rewrite) == ["graph neural networks", None, None, None, None, None] or values(spark, "string", rows, T.rewrite)[0] == "graph neural networks"
    assert values(spark, "string", ["x y"], lambda c: U.templates(F.lit("method"), c, c)) == [["x y", "x y method", "x y approach"]]


@pytest.mark.parametrize(
    ("question", "want"),
    [
        ("papers between 2015 and 2019", (2015, 2019)), ("2019-2015 work", (2015, 2019)), ("since 2018", (2018, None)), ("before 2020", (None, 2019)), ("last 3 years", (2023, None)), ("in 2021", (2021, 2021)), ("since 2018 in 2021", (2018, None)), ("after 2010 or after 2012", (2012, None)), ("none", (None, None)), (None, (None, None)),
    ],
)
def test_years(spark, question, want):
    a, b = U.years(F.col("x"))
    r = spark.createDataFrame([(question,)], "x string").select(a.alias("a"), b.alias("b")).first()
    assert (r.a, r.b) == want


def test_intent_negation_claim_topic(spark):
    rows = ["A survey of graph methods", "the paper titled X", "datasets for parsing", "methods without attention, please", "is related to X", "hello", None]
    assert values(spark, "string", rows, U.intent) == ["survey", "specific", "dataset", "method", "related", "broad", "broad"]
    assert values(spark, "string", ["a without b c, not about d.", None], U.negations) == [["b c", "d"], []]
    assert values(spark, "string", ["does training help models?", "plain", None], U.claim)[1:] == [None, None]
    assert "does training help" in values(spark, "string", ["does training help models?"], U.claim)[0]
    assert values(spark, "string", ["Find papers on deep nets since 2018", "???", None], U.topic) == ["deep nets", "???", ""]


def test_identity(spark):
    rows = [
        (0, "2401.12345v2", "T", None), (1, "W1", "T", '{"ids": {"doi": "https://doi.org/10.1000/ABC"}}'), (2, "W2", "A  b!", "{}"), (3, None, "A b", "broken"), (4, None, None, None), (5, "", "", '"{\\"externalIds\\": {\\"ArXiv\\": \\"2001.00001\\"}}"'),
    ]
    df = spark.createDataFrame(rows, "ord bigint, paper_id string, title string, raw string").withColumn("j", I.payload(F.col("raw")))
    got = [r.k for r in df.select("ord", I.canonical_key(F.col("paper_id"), F.col("title"), F.col("j"), F.col("ord")).alias("k")).orderBy("ord").collect()]
    assert got == ["arxiv:2401.12345", "doi:10.1000/abc", "title:a b;pid:W2", "title:a b", "raw:4", "arxiv:2001.00001"]


def test_ids(spark):
    assert values(spark, "string", ["2009.02040v2", " ABC ", "covid", None, "v1"], I.normal_id) == ["2009.02040", "abc", "covid", "", "v1"]
    assert values(spark, "string", ["2009.02040v2", "hep-th/9901001", "W123", None, ""], I.is_arxiv_id) == [True, True, False, False, False]
    counts = values(spark, "string", ['{"citationCount": 3}', '{"cited_by_count": "7"}', '{"citationCount": -2}', "{}", None, '{"citationCount": "x", "cited_by_count": 4}'], lambda c: I.citation_count(I.payload(c)))
    assert counts == [3, 7, 0, None, None, 4]


def test_normalize_facts(spark):
    cases = [((0.0, 0.15), 0.0), ((0.15, 0.15), 0.5), ((0.05, 0.05), 0.5), ((0.25, 0.25), 0.5), ((1.0, 0.15), 1.0), ((0.075, 0.15), 0.25), ((0.42, 0.0), 0.42)]
    df = spark.createDataFrame([c for c, _ in cases], "s double, t double")
    assert [r.n for r in df.select(S.normalize(F.col("s"), F.col("t")).alias("n")).collect()] == [w for _, w in cases]


def test_normalize_is_monotone(spark):
    df = spark.range(0, 1001).select((F.col("id") / 1000).alias("s"))
    for t in (0.05, 0.15, 0.25):
        rows = [r.n for r in df.select("s", S.normalize(F.col("s"), F.lit(t)).alias("n")).orderBy("s").collect()]
        assert rows == sorted(rows) and rows[0] == 0 and rows[-1] == 1


def test_weights():
    for w in (*S.WEIGHTS.values(), S.DEFAULT_WEIGHTS):
        assert sum(w) == pytest.approx(1)
    assert S.WEIGHTS["survey"][2] >= S.WEIGHTS["method"][2] and S.WEIGHTS["specific"][5] >= S.WEIGHTS["method"][5]


def test_cosine_edges(spark):
    rows = [([1.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 2.0]), ([0.0, 0.0], [1.0, 1.0]), (None, [1.0]), ([], []), ([1.0, 0.0], [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>")
    assert [r.c for r in df.select(S.cosine(F.col("a"), F.col("b")).alias("c")).collect()] == [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]


def test_loose_json(spark):
    rows = ['{"a": 1}', '```json\n{"a": 1}\n```', 'Sure: {"a": {"b": 2}} done', "none", None, "{broken"]
    assert values(spark, "string", rows, T.loose_json) == ['{"a": 1}', '{"a": 1}', '{"a": {"b": 2}}', None, None, None]


VARIANTS = [
    ("transformer", "transformers", False), ("pre-training", "pretraining", True), ("LLM", "large language model", True), ("bias detection", "detecting bias", False), ("prompting", "prompting methods", False),
    ("neural methods", "neural approaches", False), ("less data", "smaller dataset", True), ("graph neural network", "GNN", True), ("calibration", "calibrating", False), ("x", "", False), ("x", "X", False), (None, "x", False),
]


@pytest.mark.parametrize(("canon", "variant", "keep"), VARIANTS)
def test_variants(canon, variant, keep):
    assert V.is_high_confidence(canon, variant) == keep


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="abcdes -", max_size=20), st.text(alphabet="abcdes -", max_size=20))
def test_variants_never_keep_the_term(canon, variant):
    if " ".join(canon.lower().split()) == " ".join(variant.lower().split()):
        assert not V.is_high_confidence(canon, variant)
    V.pick(canon, [variant, None, variant])
