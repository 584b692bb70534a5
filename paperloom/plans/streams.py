"""Queries of sources, sinks and streams: tables go out to the format and come back."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import functions as F

from paperloom.functions.scoring import round4
from paperloom.operators.shred import parse_payload
from paperloom.plans import sqltext as Q
from paperloom.plans.identity import PJ
from paperloom.plans.registry import Registry
from paperloom.session import shared_path, table
from paperloom.sources import files, providers
from paperloom.streaming import monitor

query = Registry()
_EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def _stream(spark, sf_dir):
    # a file source reads a pattern, and only this table's files match it
    return monitor.read_events(spark, f"{sf_dir}/event[s].parquet", _EVENTS)


@query("x01_monitor", "select date_trunc('hour', ts)::varchar as window_start, event_type, count(*) as n, floor(sum(value) * 100 + 0.5) / 100 as total from events group by 1, 2")
def x01_monitor(spark, sf_dir):
    out = monitor.run_to_table(monitor.counts(_stream(spark, sf_dir)))
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n", (F.floor(F.col("total") * 100 + 0.5).cast("double") / 100).alias("total"))


@query("x01_sessions", """with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minutes then 0 else 1 end as fresh from events where ts is not null), s as (select user_id, ts, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as k from g)
 select user_id, cast(min(ts) as varchar) as session_start, count(*) as n from s group by user_id, k""")
def x01_sessions(spark, sf_dir):
    out = monitor.sessions(table(spark, sf_dir, "events"))
    return out.select("user_id", F.regexp_replace(F.col("session_start").cast("string"), r"\.0+$", "").alias("session_start"), "n")


@query("src_jsonl", "select qid, question, len(answer_arxiv_id) as n_gold from eval_rows where qid is not null")
def src_jsonl(spark, sf_dir):
    path = shared_path(spark, "questions")
    files.write_questions(table(spark, sf_dir, "eval_rows").where("qid is not null"), path)
    return files.read_questions(spark, path).select("qid", "question", F.when(F.col("answer_arxiv_id").isNotNull(), F.size("answer_arxiv_id")).cast("bigint").alias("n_gold"))


@query("src_sqlite", "select paper_id as id, max(ord) as seq from papers where paper_id is not null and paper_id <> '' group by paper_id")
def src_sqlite(spark, sf_dir):
    """Papers loaded in two halves into the id cache: the last row of each id stays."""
    rows = table(spark, sf_dir, "papers").select(F.col("paper_id").alias("id"), F.coalesce("raw", F.lit("")).alias("data"), F.col("ord").alias("seq"))
    middle = (rows.agg(F.max("seq")).first()[0] or 0) // 2
    cache = files.IdCache(spark)
    cache.upsert(rows.where(F.col("seq") <= middle))
    cache.upsert(rows.where(F.col("seq") > middle))
    return cache.table().select("id", F.col("seq").bitwiseAND(2**40 - 1).alias("seq"))


@query("src_arxiv_batch", "select distinct id, id in (select paper_id from papers where paper_id is not null) as cached from (select unnest(answer_arxiv_id) as id from eval_rows) where id is not null")
def src_arxiv_batch(spark, sf_dir):
    """Ids of answers against a cache of the papers: hits, and misses left for a provider."""
    cache = files.IdCache(spark)
    cache.upsert(table(spark, sf_dir, "papers").select(F.col("paper_id").alias("id"), F.coalesce("raw", F.lit("")).alias("data"), F.col("ord").alias("seq")))
    wanted = table(spark, sf_dir, "eval_rows").select(F.explode("answer_arxiv_id").alias("id")).where("id is not null").distinct()
    hit, miss = cache.lookup(wanted)
    return hit.select("id", F.lit(True).alias("cached")).unionByName(miss.select("id", F.lit(False).alias("cached")))


def _lines(batches):
    """Each payload as one line, unwrapped; what holds no object is passed over."""
    for batch in batches:
        works = (parse_payload(x) for x in batch.column(0).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([json.dumps(w) for w in works if w is not None], pa.string())], names=["value"])


def _provider(name: str, provider: str):
    ident, title, year = (Q.member(k) for k in providers.NAMES[provider])
    text = lambda x: f"coalesce({x}, '')"
    sql = f"{PJ} select '{provider}' as provider, {text(ident)} as paper_id, {text(title)} as title, case when regexp_matches(left({year}, 4), '^[0-9]+$') then try_cast(left({year}, 4) as int) end as year from papers_j where json_exists(j, '$.{providers.NAMES[provider][0]}')"

    @query(name, sql)
    def read(spark, sf_dir):
        path = shared_path(spark, "works")
        table(spark, sf_dir, "papers").select("raw").mapInArrow(_lines, "value string").write.option("compression", "none").text(path)
        providers.register(spark)
        return spark.read.format("papers").option("path", path).option("provider", provider).load().select("provider", "paper_id", "title", "year")

    return read


for _name, _p in {"src_arxiv": "arxiv", "src_openalex": "openalex", "src_s2": "semantic"}.items():
    _provider(_name, _p)


@query("sink_eval")
def sink_eval(spark, sf_dir):
    from paperloom.operators.evaluate import macro
    from paperloom.plans.evaluation import samples

    base = shared_path(spark, "report")
    scores = samples(spark, sf_dir).join(table(spark, sf_dir, "eval_rows").select("qid", F.coalesce("source_meta.split", F.lit("none")).alias("split")), "qid")
    files.write_report(scores, macro(scores), base)
    return spark.read.json(f"{base}/samples").select("split", "qid", round4(F.col("f1")).alias("f1"))


@query("sink_log", "select 'papers' as stage, count(*) as n from papers union all select 'scored', count(*) from scored union all select 'edges', count(*) from edges")
def sink_log(spark, sf_dir):
    return files.stage_log({t: table(spark, sf_dir, t) for t in ("papers", "scored", "edges")})
