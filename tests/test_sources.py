import json

from pyspark.sql import functions as F

from paperloom.sources import files, limiter, providers
from paperloom.streaming import monitor


def test_limiter_spaces_calls():
    now, slept = [0.0], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    r = limiter.RateLimiter(1.0, lambda: now[0], sleep)
    assert r.wait() == 0 and r.wait() == 1.0
    r.tighten()
    assert r.interval == 1.2
    for _ in range(50):
        r.tighten()
    assert r.interval == 8.0


def test_retries():
    replies = [(429, {"Retry-After": "3"}, "slow"), (200, {}, "body")]
    slept = []
    got = limiter.get(lambda: replies.pop(0), sleep=slept.append)
    assert got["body"] == "body" and got["retries"] == 1 and slept == [3.0]
    assert limiter.get(lambda: (404, {}, "gone"), sleep=slept.append)["error"].startswith("http_404")
    assert limiter.get(lambda: (500, {}, "x"), retries=1, sleep=slept.append)["retries"] == 1


def test_provider_source(spark, tmp_path):
    works = [{"arxiv_id": "1", "title": "a", "published": "2020-01-01"}, {"id": "W1", "title": "b", "publication_year": 2010}, {"id": "W2", "title": "c", "publication_year": None}, {"paperId": "s", "year": 2021}]
    (tmp_path / "w.jsonl").write_text("\n".join(map(json.dumps, works)) + "\nnot json\n[1]\n")
    providers.register(spark)
    df = spark.read.format("papers").option("path", str(tmp_path)).load()
    assert df.count() == 4
    assert {r.paper_id for r in df.where("provider = 'openalex'").collect()} == {"W1", "W2"}
    assert {r.paper_id for r in df.where("year >= 2015").collect()} == {"1", "s"}
    assert {r.paper_id for r in df.where("provider = 'openalex' and (year >= 2015 or year is null)").collect()} == {"W2"}
    assert spark.read.format("papers").option("path", str(tmp_path)).option("provider", "openalex").option("limit", 1).load().count() == 1
    assert df.where("provider = 'nobody'").count() == 0


def test_questions_from_lines(spark, tmp_path):
    lines = ['{"qid": "a", "question": "x", "answer_arxiv_id": ["1"]}', "", '{"question": "y"}', '{"qid": "", "question": "z"}']
    (tmp_path / "q.jsonl").write_text("\n".join(lines) + "\n")
    path = str(tmp_path / "q.jsonl")
    assert [r.qid for r in files.read_questions(spark, path).orderBy("line_no").collect()] == ["a", "row_2", "row_3"]
    assert [r.qid for r in files.read_questions(spark, path, limit=1, offset=1).collect()] == ["row_2"]


def test_id_cache(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"arxivId": "1", "v": 1}\nbroken\n{"v": 2}\n{"arxivId": "1", "v": 3}\n{"arxivId": "2", "v": 4}\n')
    cache = files.IdCache(spark)
    assert cache.count() == 0
    cache.load_lines(str(tmp_path / "c.jsonl"))
    assert cache.count() == 2 and json.loads(cache.get("1").first().data)["v"] == 3
    cache.upsert(spark.createDataFrame([("1", "new", 0), (None, "x", 1), ("", "y", 2)], "id string, data string, seq bigint"))
    assert cache.get("1").first().data == "new" and cache.count() == 2
    hit, miss = cache.lookup(spark.createDataFrame([("1",), ("9",)], "id string"))
    assert hit.count() == 1 and [r.id for r in miss.collect()] == ["9"]


def test_articles(spark, tmp_path):
    (tmp_path / "a.xml").write_text(
        "<Set><PubmedArticle><MedlineCitation><PMID>7</PMID><Article><ArticleTitle>T</ArticleTitle><Abstract><AbstractText>a</AbstractText><AbstractText>b</AbstractText></Abstract><Journal><JournalIssue><PubDate><Year>2020</Year><Month>Mar</Month></PubDate></JournalIssue></Journal></Article></MedlineCitation>"
        "<PubmedData><ReferenceList><Reference>r1</Reference><Reference>r2</Reference></ReferenceList></PubmedData></PubmedArticle><PubmedArticle><MedlineCitation><PMID>8</PMID></MedlineCitation></PubmedArticle></Set>"
    )
    got = {r.id: r for r in files.read_articles(spark, str(tmp_path / "a.xml")).collect()}
    assert (got["7"].abstract, got["7"].year, got["7"].month, got["7"].n_references) == ("a b", 2020, 3, 2)
    assert got["8"].month is None and got["8"].n_references == 0


def test_stream_equals_table(spark, tmp_path):
    base = spark.range(400).select(F.col("id").alias("event_id"), (F.timestamp_seconds(F.lit(1_600_000_000) + F.col("id") * 97)).alias("ts"), (F.col("id") % 7).alias("user_id"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("event_type"), F.col("id").cast("double").alias("value"))
    for k in range(4):
        base.where(F.col("event_id") % 4 == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = monitor.read_events(spark, str(tmp_path / "in"), "event_id bigint, ts timestamp, user_id bigint, event_type string, value double", per_batch=1)
    got = monitor.run_to_table(monitor.counts(stream))
    assert sorted(map(str, got.collect())) == sorted(map(str, monitor.counts(base).collect()))
    assert {r.user_id: r.n for r in monitor.run_to_table(monitor.running_counts(stream), "update").collect()}


def test_late_rows_are_dropped(spark, tmp_path):
    schema = "ts timestamp, event_type string, value double"
    for k, rows in enumerate([[("2020-01-01 10:00:00", "a", 1.0)], [("2020-01-01 15:00:00", "a", 1.0)], [("2020-01-01 10:30:00", "a", 1.0)], [("2020-01-02 10:00:00", "a", 1.0)]]):
        spark.createDataFrame(rows, "ts string, event_type string, value double").select(F.col("ts").cast("timestamp"), "event_type", "value").coalesce(1).write.parquet(str(tmp_path / f"p{k}"))
    import shutil

    (tmp_path / "in").mkdir()
    stream = monitor.counts(monitor.read_events(spark, str(tmp_path / "in"), schema, per_batch=1))
    query = stream.writeStream.outputMode("append").format("memory").queryName("late").option("checkpointLocation", str(tmp_path / "cp")).start()
    for k in range(4):
        for f in (tmp_path / f"p{k}").glob("*.parquet"):
            shutil.copy(f, tmp_path / "in" / f"{k}.parquet")
        query.processAllAvailable()
    query.stop()
    rows = {str(r.window_start): r.n for r in spark.table("late").collect()}
    assert rows.get("2020-01-01 10:00:00") == 1 and rows.get("2020-01-01 15:00:00") == 1


def test_provider_queries_read_all_payloads(spark, tmp_path):
    from paperloom.plans import streams

    work = lambda k, year: json.dumps({"id": k, "title": "a\nb", "publication_year": year})
    raw = [work("W1", 2020), work("W2", 1999), work("W3", None), json.dumps(work("W4", 2016)), " \n" + work("W5", 2017), "broken", None]
    spark.createDataFrame([(x,) for x in raw], "raw string").write.parquet(str(tmp_path / "papers.parquet"))
    got = {r.paper_id: r.year for r in streams.query.queries["src_openalex"](spark, str(tmp_path)).collect()}
    assert got == {"W1": 2020, "W2": 1999, "W3": None, "W4": 2016, "W5": 2017}


def test_only_long_reference_lists_are_cut(spark, tmp_path):
    from paperloom.plans import extras

    edges = [(seed, f"k{i:03}", "openalex", "ref", True) for seed, n in (("a", 25), ("b", 100), ("c", 101), ("d", 120)) for i in range(n)]
    spark.createDataFrame(edges, "seed_id string, target_key string, via string, direction string, ok boolean").write.parquet(str(tmp_path / "edges.parquet"))
    spark.createDataFrame([(f"k{i:03}",) for i in range(0, 120, 2)], "paper_id string").write.parquet(str(tmp_path / "papers.parquet"))
    rows = extras.query.queries["src_oa_refs_vendor"](spark, str(tmp_path)).groupBy("seed_id").count().collect()
    assert {r.seed_id: r["count"] for r in rows} == {"a": 13, "b": 50, "c": 20, "d": 20}
