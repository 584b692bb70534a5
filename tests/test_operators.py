import json

import pytest
from pyspark.sql import functions as F

from paperloom.operators import dedup, evaluate, graph, hooks, organize, planning, pool, ranking
from paperloom.operators import retrieval as R

PAPERS = "ord bigint, paper_id string, title string, abstract string, year int, source string, citations int, raw string"


@pytest.fixture(scope="module")
def scored_frame(spark):
    papers = [
        (0, "2001.00001", "Graph networks for retrieval", "graph networks", 2020, "arxiv", 1, '{"citationCount": 100, "venue": "NeurIPS"}'),
        (1, "2001.00002", "Graph networks old", "retrieval", 2001, "arxiv", 1, "{}"),
        (2, "W3", "Organ networks", "gan graph", 2021, "openalex", 1, None),
        (3, "2001.00001", "copy of the first", "x", 1999, "arxiv", 1, None),
        (4, "W5", None, None, None, None, None, "cut {"),
        (5, "2001.00001v2", "Graph networks for retrieval again", "", 2020, "arxiv", 1, None),
        (6, None, "no id", "", 2020, "arxiv", 1, None),
    ]
    scored = [("q1", i, p) for i, p in enumerate(["2001.00001", "2001.00002", "W3", "W5", "2001.00001v2", "2001.00001", "unknown", None])] + [(None, 90, "W3"), ("q2", 91, "W3"), ("none", 92, "W3")]
    rows = [("q1", "graph networks retrieval since 2015 without gan"), ("q2", None), (None, "x"), ("q3", "no candidates")]
    s = spark.createDataFrame(scored, "qid string, ord bigint, paper_id string").withColumn("title", F.lit("clash")).withColumn("year", F.lit("clash"))
    q = spark.createDataFrame(rows, "qid string, question string")
    return ranking.filter_papers(pool.candidates(s, spark.createDataFrame(papers, PAPERS), q)).cache()


def test_hard_rules_and_dedup(scored_frame):
    got = {(r.qid, r.paper_id): r for r in scored_frame.collect()}
    assert set(got) == {("q1", "2001.00001"), ("q1", "2001.00002"), ("q1", "W3"), ("q1", "W5"), ("q2", "W3")}
    assert got["q1", "2001.00002"].reason == "year_mismatch" and got["q1", "2001.00002"].normalized == 0
    assert got["q1", "W3"].reason == "negation_hit"  # a substring, as in organ
    assert got["q1", "W5"].keyword_coverage == 0 and got["q1", "W5"].reason == "keyword_coverage"
    assert got["q2", "W3"].keyword_coverage == 0.5  # a question without words
    best = got["q1", "2001.00001"]
    assert best.passed and best.citation == 1.0 and best.venue_score == 1.0 and best.min_year == 2001
    assert all(0 <= r.normalized <= 1 and 0 <= r.blended <= 1 for r in got.values())


def test_selection_and_rank(scored_frame):
    assert {(r.qid, r.paper_id) for r in ranking.select(scored_frame).collect()} == {("q1", "2001.00001"), ("q2", "W3")}
    assert ranking.rank(scored_frame).where("qid = 'q1'").count() == 4  # rejected papers fill the room
    assert [r.paper_id for r in ranking.rank(scored_frame, 0.5, 20, True).collect()] == ["2001.00001"]
    assert ranking.rank(scored_frame, max_return=2).where("qid = 'q1'").count() == 2


def test_first_and_last_by_key(spark):
    rows = [("a", 2, "x"), ("a", 1, "y"), (None, 5, "z"), (None, 4, "w"), ("b", None, "v")]
    df = spark.createDataFrame(rows, "k string, o bigint, v string")
    assert {(r.k, r.v) for r in dedup.first_by_key(df, ["k"], "o").collect()} == {("a", "y"), (None, "w"), ("b", "v")}
    assert {(r.k, r.v) for r in dedup.first_by_key(df, ["k"], "o", last=True).collect()} == {("a", "x"), (None, "z"), ("b", "v")}
    once = dedup.first_by_key(df, ["k"], "o")
    assert sorted(map(str, dedup.first_by_key(once, ["k"], "o").collect())) == sorted(map(str, once.collect()))


def test_prf_by_hand(spark):
    q = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "qid string")
    pred = spark.createDataFrame([("a", "2001.00001v3"), ("a", "2001.00001"), ("a", "2001.00009"), ("b", "2001.00001"), ("d", "W1"), ("d", None), ("x", "2001.00001")], "qid string, paper_id string")
    gold = spark.createDataFrame([("a", "2001.00001"), ("a", "2001.00002"), ("a", None), ("c", "2001.00001"), ("d", "2001.00001"), ("a", "")], "qid string, gold string")
    got = {r.qid: r for r in evaluate.samples(q, pred, gold).collect()}
    assert set(got) == {"a", "b", "c", "d"}
    assert (got["a"].p, got["a"].r, got["a"].f1) == (0.5, 0.5, 0.5) and (got["a"].n_pred, got["a"].n_gold) == (3, 2)
    assert all(got[k].f1 == 0 and got[k].p == 0 for k in "bcd") and got["d"].n_pred_arxiv == 0 and got["d"].n_pred == 1
    m = evaluate.macro(evaluate.samples(q, pred, gold)).first()
    assert (m.n, m.macro_f1) == (4, 0.125)
    none = evaluate.macro(evaluate.samples(q.limit(0), pred, gold)).first()
    assert (none.n, none.macro_p) == (0, 0.0)


def test_statistics(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("b", 3.0), ("c", None), ("b", float("nan"))], "k string, v double")
    got = {r.k: r for r in evaluate.statistics(df, "v", "k").collect()}
    assert got["a"].stdev == 0 and got["b"].mean == 2 and got["b"].median == 2 and got["b"].stdev == pytest.approx(2**0.5)
    assert got["c"]["count"] == 0 and got["c"].mean == 0


def selection(spark):
    rows = [("q", f"P{i}", i, json.dumps({"paperId": f"s{i}", "ids": {"openalex": f"https://openalex.org/W{i}"}, "references": [{"paperId": "s2"}, {"paperId": "gone"}]} if i == 1 else {"paperId": f"s{i}", "ids": {"openalex": f"https://openalex.org/W{i}"}})) for i in range(1, 5)] + [("r", "P1", 1, None)]
    return pool.with_payload(spark.createDataFrame(rows, "qid string, paper_id string, sel_rank int, raw string"))


def test_graph(spark):
    edges = spark.createDataFrame(
        [("P1", "ref", "s2", "P2", True), ("P1", "cit", "s2", "w3", True), ("P1", "ref", "openalex", "https://openalex.org/W2", True), ("P1", "ref", "s2", "P1", True), ("P1", "ref", "s2", "out", True), ("P1", "ref", "s2", "P4", False), ("P2", "ref", "crossref", "P4", True), ("P1", "ref", "s2", "P3", None), (None, "ref", "s2", "P3", True), ("P1", "ref", "odd", "P3", True)] * 2,
        "seed_id string, direction string, via string, target_key string, ok boolean",
    )
    sel = selection(spark)
    got = {(r.qid, r.source, r.target, r.via) for r in graph.build(sel, edges).collect()}
    assert got == {("q", "P1", "P2", "openalex"), ("q", "P3", "P1", "s2")}  # crossref isn't asked once others answered
    assert ("q", "P2", "P4", "crossref") in {(r.qid, r.source, r.target, r.via) for r in graph.build(sel, edges, crossref_always=True).collect()}
    stats = {r.qid: r for r in graph.statistics(sel, edges, graph.build(sel, edges)).collect()}
    assert stats["q"].n_edges == 2 and stats["q"].n_nodes == 4 and stats["q"].sources_used == "openalex,s2"
    assert stats["r"].n_edges == 0 and stats["r"].reason == "all_sources_failed_or_empty"
    assert {(r.source, r.target) for r in graph.local_edges(sel).collect()} == {("P1", "P2")}
    assert graph.build(sel.limit(0), edges).count() == 0 and graph.build(sel, edges.limit(0)).count() == 0


def test_views(spark):
    v = lambda e, n, **k: spark.range(1).select(graph.view(F.lit(e), F.lit(n), **k)).first()[0]
    assert v(0, 5) == "list" and v(1, 5) == "graph" and v(1, 5, wanted="list") == "list" and v(1, 5, min_density=0.5) == "list"


def test_expansion_replays_the_budget(spark):
    seeds = spark.createDataFrame([("q", "S1", 1), ("q", "S2", 2)], "qid string, seed string, k_rank int")
    edges = spark.createDataFrame([("S1", "ref", "s2", f"r{i}", True) for i in range(9)] + [("S1", "cit", "s2", "r0", True), ("S1", "cit", "s2", "c1", True), ("S2", "ref", "s2", "z1", True), ("S2", "ref", "s2", "z2", True)], "seed_id string, direction string, via string, target_key string, ok boolean")
    known = spark.createDataFrame([("q", "r1")], "qid string, key string")
    run = lambda most: [r.key for r in graph.expand(seeds, edges, known, 5, 5, most).orderBy("place").collect()]
    assert run(30) == ["r0", "r2", "r3", "r4", "c1", "z1", "z2"]
    assert run(3) == ["r0", "r2", "c1"] and run(0) == []


def test_tiers_and_reasons(spark):
    rows = [("q", "a", 1, 0.9, {"relevance": 0.4, "citation": 0.9}, None, "method"), ("q", "b", 2, 0.9, {"llm": 0.8, "title": 0.5, "normalized": 1.0}, "llm:0.8;Good match;impact[cit=1]", "method"), ("q", "c", 3, 0.5, {}, "keyword", "method"), ("q", "d", 4, 0.9, None, None, None)]
    df = organize.with_tiers(spark.createDataFrame(rows, "qid string, paper_id string, sel_rank int, score double, features map<string,double>, reason string, intent string"))
    got = {r.paper_id: r for r in df.select("*", organize.model_reason(F.col("reason")).alias("said"), organize.top_features(F.col("features")).alias("top"), organize.selection_reason(F.col("reason"), F.col("features"), F.col("tier"), F.col("intent"), F.lit("t"), F.lit(None)).alias("why")).collect()}
    assert [got[k].tier[:4] for k in "abcd"] == ["part", "high", "part", "high"]
    assert got["b"].said == "Good match" and got["a"].said == "" and got["c"].said == ""
    assert got["b"].top == ["LLM 判定 80%", "标题命中 50%"] and got["d"].top == []
    assert got["b"].why.endswith("Good match") and "引用影响力突出" in got["a"].why
    groups = {r.tier: (r.n, r.paper_ids) for r in organize.groups(df).collect()}
    assert groups == {"highly_relevant": (2, "b,d"), "partially_relevant": (2, "a,c")}


READING = {
    "intent": "method",
    "topic": "retrieval augmented generation",
    "term_groups": [{"canonical": "retrieval augmented generation", "abbrev": "RAG", "variants": ["retrieval-augmented generation", "RAG models"], "role": "topic"}, {"canonical": "large language models", "variants": ["LLMs", "LLM"], "coverage_gap_likely": True, "instances": ["GPT", "Llama"]}, {"canonical": "Large Language Models"}, {"canonical": ""}],
    "query_skeleton": {"core_text": "retrieval augmented generation for large language models", "parts": [{"id": "p0", "text": "retrieval augmented generation", "replaceable": True}, {"id": "p1", "text": "large language models"}, {"id": "p2", "text": "language models"}, {"text": "absent part"}]},
}


def test_planning(spark):
    rows = [("a", "How do RAG methods work?", json.dumps(READING)), ("b", "deep nets using attention since 2020", None), ("c", None, "broken {"), ("d", "the paper Attention Is All You Need", "{}"), (None, "x", None), ("e", "x" * 20000, None)]
    u = planning.understand(spark.createDataFrame(rows, "qid string, question string, r string"), "r").cache()
    got = {r.qid: r for r in u.collect()}
    assert set(got) == {"a", "b", "c", "d", "e"}
    assert [t.text for t in got["a"].terms] == ["retrieval augmented generation", "large language models"]
    assert [p.id for p in got["a"].skeleton.parts] == ["p0", "p1"]  # the longer of two that overlap
    assert got["b"].method == "attention since" or got["b"].method.startswith("attention")
    weights = [c.weight for c in got["a"].criteria]
    assert sum(weights) == pytest.approx(1, abs=1e-3) and got["a"].criteria[-1].type == "intent"
    texts = {}
    for r in planning.sub_queries(u).orderBy("qid", "sq_ord").collect():
        texts.setdefault(r.qid, []).append((r.angle, r.text))
    assert texts["a"][0] == ("core", "retrieval augmented generation for large language models")
    assert [a for a, _ in texts["a"]].count("entity") == 1 and len(texts["a"]) == 5
    assert all(len({t.lower() for _, t in x}) == len(x) for x in texts.values())
    assert {(r.qid, r.slot): r.channel for r in planning.slot_usage(u).collect()}["b", "year_from"] == "api_filter"


def test_task_budget(spark):
    kinds = ["raw", "metadata", "synonym", "core"]
    tasks = F.array(*[F.struct(F.lit("lexical").alias("mode"), F.lit(k).alias("transform"), F.lit("").alias("source"), F.lit(f"text {k}").alias("text"), F.lit("").alias("part")) for k in kinds])
    take = lambda n: [t.transform for t in spark.range(1).select(planning.budget(tasks, n).alias("t")).first().t]
    assert take(2) == ["core", "synonym"] and take(9) == ["core", "synonym", "metadata", "raw"]


def sub_queries(spark):
    rows = [("q", "q0", 0, "raw text", "keyword", "raw", "lexical"), ("q", "q1", 1, "meta", "keyword", "metadata", "lexical"), ("q", "q2", 2, "syn", "keyword", "synonym", "lexical"), ("q", "q3", 3, "core", "keyword", "core", "lexical")]
    return spark.createDataFrame(rows, "qid string, sqid string, sq_ord int, text string, channel string, angle string, mode string")


def test_budget_and_trace(spark):
    sq = sub_queries(spark)
    pick = lambda n: {r.sqid for r in R.budgeted(sq, n).where("eligible").collect()}
    assert pick(2) == {"q2", "q3"} and pick(0) == set() and len(pick(9)) == 4
    always = sq.withColumn("mode", F.lit("semantic"))
    assert R.budgeted(always, 2).where("eligible").count() == 4
    dry = R.trace(sq, sources=("arxiv", "semantic", "odd"))
    assert {(r.sqid, r.source): r.status for r in dry.collect()}["q0", "semantic"] == "skipped" and dry.where("source = 'odd' and status = 'skipped'").count() == 4
    hits = spark.createDataFrame([("q", "q0", "arxiv", 1, "k1"), ("q", "q0", "arxiv", 2, "k2"), ("q", "q1", "arxiv", 1, "k1"), ("q", "q3", "semantic", 1, "k3"), ("q", "q0", "semantic", 1, "k9")], "qid string, sqid string, source string, hit_rank int, key string")
    got = R.retrieve(R.trace(sq, hits), hits).orderBy("cord").collect()
    assert [r.key for r in got] == ["k1", "k2", "k3"]
    stats = R.call_stats(R.trace(sq, hits)).first()
    assert (stats.n_calls, stats.n_hits) == (10, 4)


def test_requests(spark):
    df = spark.createDataFrame([("graph nets", None, 2020, 2020, None), ("nets using of", "attention", None, 2019, "ACL"), ("", None, None, None, "")], "t string, m string, a int, b int, v string")
    cols = [F.col(c) for c in "tmabv"]
    rows = df.select(R.openalex_request(*cols).alias("o"), R.arxiv_request(*cols[:4]).alias("x"), R.s2_request(*cols, limit=500).alias("s")).collect()
    assert rows[0].o["filter"] == "title_and_abstract.search:graph nets,publication_year:2020" and rows[0].x.query == "(all:graph AND all:nets) AND submittedDate:[20200101000000 TO 20201231235959]"
    assert rows[1].s["query"] == "nets using of attention" and rows[1].s.year == "-2019" and rows[1].s.limit == 100 and "publication_year:<2020" in rows[1].o["filter"]
    assert rows[2].x.query == "all:paper" and rows[2].s.year is None and rows[2].o["filter"] == ""


def test_refinement(spark):
    pool_rows = spark.createDataFrame([("few", "k1", 1), ("many", "m1", 1), ("many", "m2", 2), ("many", "m3", 3), ("fit", "f1", 1), ("fit", "f2", 2)], "qid string, key string, cord bigint")
    seen = []

    def refine(asked, k):
        seen.append({r.qid: r.direction for r in asked.collect()})
        return spark.createDataFrame([("few", f"n{k}", 9), ("few", "k1", 9), ("fit", "never", 9)], "qid string, key string, cord bigint")

    got, log = R.iterate(pool_rows, refine, spark.createDataFrame([("few",), ("many",), ("fit",), ("none",)], "qid string"), 2, 2, 3)
    assert seen[0] == {"few": "broaden", "many": "narrow", "none": "broaden"} and seen[1:] == [{}, {}]
    assert {(r.qid, r.key) for r in got.collect()} - {(r.qid, r.key) for r in pool_rows.collect()} == {("few", "n0")}
    assert {r.qid: r.n_added for r in log.collect()} == {"few": 1, "many": 0, "none": 0}


def test_new_queries(spark):
    schema = "qid string, place int, text string"
    proposed = spark.createDataFrame([("q", 0, "Old One"), ("q", 1, "new"), ("q", 2, "NEW "), ("q", 3, None), ("q", 4, "x"), ("q", 5, "y"), ("q", 6, "z")], schema)
    asked = spark.createDataFrame([("q", 0, "old one")], schema)
    assert [r.text for r in R.new_queries(proposed, asked).orderBy("place").collect()] == ["new", "x", "y"]


def test_abstracts(spark):
    df = spark.range(1).select(F.create_map(F.lit("b"), F.array(F.lit(1), F.lit(3)), F.lit("a"), F.array(F.lit(0)), F.lit("c"), F.array(F.lit(3))).alias("ix"))
    assert df.select(R.abstract_of(F.col("ix"))).first()[0] == "a b c"
    assert spark.range(1).select(R.abstract_of(F.create_map().cast("map<string,array<int>>"))).first()[0] == ""


def test_model_scores(spark):
    ids = ["a", "b", "c"]
    reply = 'ok ```json\n[{"paper_id": "a", "score": 2, "reason": " r "}, {"paper_id": "x", "score": 1}, {"paper_id": "b", "score": "no"}, {"paper_id": "c", "score": "0.25"}, {"paper_id": "a", "score": 0.5}]\n```'
    df = spark.createDataFrame([("q", 0, ids, reply), ("q", 1, ids, None), ("q", 2, ids, "garbage"), ("q", 3, ids, "[]")], "qid string, batch int, ids array<string>, reply string")
    assert {r.paper_id: r.llm for r in hooks.json_scores(df).collect()} == {"a": 0.5, "c": 0.25}


def test_judge_survives_failures(spark):
    rows = spark.createDataFrame([("q", "quest", f"p{i}", "t", 1.0 - i / 100, i) for i in range(20)] + [("q", "quest", "zero", "t", 0.0, 99)], "qid string, question string, paper_id string, title string, keyword_coverage double, cord bigint")

    def flaky(prompt):
        if '"p8"' in prompt:
            raise RuntimeError("429 too many requests")
        return hooks.stub_judge(prompt)

    got = {r.paper_id for r in hooks.judge(rows, flaky).collect()}
    assert got == {f"p{i}" for i in range(8)}
    assert hooks.first_reply(lambda p: None, lambda p: "", lambda p: "x")("p") == "x"
    assert hooks.encode(rows, "question").count() == 1
