"""Queries of evaluation: predictions are the best-scored papers of `scored`, gold the answers of `eval_rows`."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperloom.functions.scoring import round4
from paperloom.operators import evaluate as E
from paperloom.plans import sqltext as Q
from paperloom.plans.registry import Registry
from paperloom.session import table

query = Registry()
R = Q.round4

_RANKED = f"""ranked as (select qid, nid, cast(row_number() over (partition by qid order by s desc, o) as int) as rnk from (select qid, {Q.normal_id('paper_id')} as nid, score as s, ord as o from scored
 where qid is not null and score is not null and not isnan(score) qualify row_number() over (partition by qid, nid order by score desc, ord) = 1) where nid <> '' qualify rnk <= 20)"""
_GOLD = "g0 as (select qid, unnest(answer_arxiv_id) as gold from eval_rows)"
_SETS = f"""p as (select distinct qid, nid from ranked where {Q.is_arxiv('nid')}), g as (select distinct qid, {Q.normal_id('gold')} as nid from g0 where gold is not null and {Q.normal_id('gold')} <> ''),
 c as (select e.qid, (select count(*) from p where p.qid = e.qid) as n_pred_set, (select count(*) from g where g.qid = e.qid) as n_gold_set, (select count(*) from p join g using (qid, nid) where qid = e.qid) as n_hit from (select distinct qid from eval_rows where qid is not null) e),
 s0 as (select *, case when n_pred_set > 0 and n_gold_set > 0 then n_hit / n_pred_set::double else 0.0::double end as p, case when n_pred_set > 0 and n_gold_set > 0 then n_hit / n_gold_set::double else 0.0::double end as r from c),
 s as (select *, case when n_hit > 0 then 2 * p * r / (p + r) else 0.0::double end as f1 from s0)"""
PRF = f"with {_RANKED}, {_GOLD}, {_SETS}"


def predictions(spark, sf_dir):
    return E.ranked_predictions(table(spark, sf_dir, "scored")).withColumnRenamed("nid", "paper_id")


def samples(spark, sf_dir):
    rows = table(spark, sf_dir, "eval_rows")
    return E.samples(rows, predictions(spark, sf_dir), E.gold(rows))


@query("win_spar_preds", f"with {_RANKED} select * from ranked")
def win_spar_preds(spark, sf_dir):
    return E.ranked_predictions(table(spark, sf_dir, "scored"))


@query("join_eval", f"{PRF} select qid, nid from p join g using (qid, nid)")
def join_eval(spark, sf_dir):
    rows = table(spark, sf_dir, "eval_rows")
    from paperloom.functions.identity import is_arxiv_id

    p = E.id_sets(predictions(spark, sf_dir).where(is_arxiv_id(F.col("paper_id"))), "paper_id")
    return p.join(E.id_sets(E.gold(rows), "gold"), ["qid", "nid"])


@query("agg_prf", f"{PRF} select qid, n_hit, n_pred_set, n_gold_set, {R('p')} as p, {R('r')} as r, {R('f1')} as f1 from s")
def agg_prf(spark, sf_dir):
    return samples(spark, sf_dir).select("qid", "n_hit", "n_pred_set", "n_gold_set", *[round4(F.col(c)).alias(c) for c in ("p", "r", "f1")])


@query("agg_sample", f"""{PRF} select s.qid, {R('f1')} as f1, coalesce(a.n_pred, 0) as n_pred, coalesce(a.n_pred_arxiv, 0) as n_pred_arxiv, coalesce(b.n_gold, 0) as n_gold from s
 left join (select qid, count(*) as n_pred, count(*) filter ({Q.is_arxiv('nid')}) as n_pred_arxiv from ranked group by qid) a on a.qid = s.qid left join (select qid, count(*) filter (gold is not null and gold <> '') as n_gold from g0 group by qid) b on b.qid = s.qid""")
def agg_sample(spark, sf_dir):
    return samples(spark, sf_dir).select("qid", round4(F.col("f1")).alias("f1"), "n_pred", "n_pred_arxiv", "n_gold")


@query("agg_macro", f"{PRF} select count(*) as n, {R('coalesce(avg(p), 0)')} as macro_p, {R('coalesce(avg(r), 0)')} as macro_r, {R('coalesce(avg(f1), 0)')} as macro_f1 from s")
def agg_macro(spark, sf_dir):
    return E.macro(samples(spark, sf_dir)).select("n", *[round4(F.col(c)).alias(c) for c in ("macro_p", "macro_r", "macro_f1")])


_TITLES = f"""with e as (select distinct qid from eval_rows where qid is not null), p as (select distinct s.qid, lower(regexp_replace(coalesce(f.title, ''), '[^\\p{{L}}]', '', 'g')) as nid from scored s join (select paper_id, title from papers where paper_id is not null qualify row_number() over (partition by paper_id order by ord) = 1) f using (paper_id) where s.qid is not null and f.title is not null),
 pp as (select * from p where nid <> ''), g as (select distinct qid, lower(regexp_replace(coalesce(t, ''), '[^\\p{{L}}]', '', 'g')) as nid from (select qid, unnest(answer) as t from eval_rows) where t is not null), gg as (select * from g where nid <> '')
 select e.qid, (select count(*) from pp where pp.qid = e.qid) as n_pred_set, (select count(*) from gg where gg.qid = e.qid) as n_gold_set, (select count(*) from pp join gg using (qid, nid) where qid = e.qid) as n_hit from e"""


@query("agg_prf_title", _TITLES)
def agg_prf_title(spark, sf_dir):
    from paperloom.operators.pool import first_papers

    rows = table(spark, sf_dir, "eval_rows")
    titles = table(spark, sf_dir, "scored").select("qid", "paper_id").join(first_papers(table(spark, sf_dir, "papers")).select("paper_id", "title"), "paper_id")
    return E.prf(rows, titles.select("qid", F.col("title").alias("paper_id")), E.gold(rows, "answer"), as_title=True).select("qid", "n_pred_set", "n_gold_set", "n_hit")


_MODES = f"""with {_GOLD}, base as (select qid, score, features, ord, {Q.normal_id('paper_id')} as nid from scored where qid is not null and score is not null and not isnan(score)),
 lanes as (select 'raw' as mode, qid, nid from base qualify row_number() over (partition by qid order by score desc, ord) <= 10 union all select 'model' as mode, qid, nid from base where element_at(features, 'llm')[1] is not null qualify row_number() over (partition by qid order by element_at(features, 'llm')[1] desc, ord) <= 10),
 g as (select distinct qid, {Q.normal_id('gold')} as nid from g0 where gold is not null and {Q.normal_id('gold')} <> ''), e as (select distinct qid, source_meta.split as split, m.mode from eval_rows cross join (values ('raw'), ('model')) m(mode) where qid is not null),
 ps as (select distinct mode, qid, nid from lanes where nid <> ''), c as (select e.*, (select count(*) from ps where ps.qid = e.qid and ps.mode = e.mode) as np, (select count(*) from g where g.qid = e.qid) as ng, (select count(*) from ps join g using (qid, nid) where qid = e.qid and ps.mode = e.mode) as nh from e)
 select split, mode, count(*) as n, {R('avg(case when nh > 0 then nh / np::double else 0.0::double end)')} as macro_p, {R('avg(case when nh > 0 then nh / ng::double else 0.0::double end)')} as macro_r from c group by split, mode"""


def top_rows(rows, score, most):
    """The best rows of each question by a score, of equal ones the earlier, with rnk."""
    order = Window.partitionBy("qid").orderBy(F.col(score).desc(), "ord")
    return rows.withColumn("rnk", F.row_number().over(order)).where(F.col("rnk") <= most)


def lanes(spark, sf_dir):
    """Two lanes of the ten best papers of each question: by score, and by the model's feature."""
    from paperloom.functions.identity import normal_id
    base = table(spark, sf_dir, "scored").where("qid is not null and score is not null and not isnan(score)").select("qid", "score", "ord", normal_id(F.col("paper_id")).alias("paper_id"), F.try_element_at("features", F.lit("llm")).alias("llm"))
    raw = top_rows(base, "score", 10).withColumn("mode", F.lit("raw"))
    return raw.unionByName(top_rows(base.where("llm is not null"), "llm", 10).withColumn("mode", F.lit("model")))


@query("agg_mode_macro", _MODES)
def agg_mode_macro(spark, sf_dir):
    rows = table(spark, sf_dir, "eval_rows")
    answers = E.gold(rows)
    # both modes at once: the mode is part of the question's key
    modes = F.explode(F.array(F.lit("raw"), F.lit("model"))).alias("mode")
    key = F.concat_ws("|", "mode", "qid").alias("qid")
    asked = rows.where("qid is not null").select("qid", F.col("source_meta.split").alias("split"), modes)
    predicted = lanes(spark, sf_dir).select(key, "paper_id")
    keyed = answers.select("qid", "gold", modes).select(key, "gold")
    scores = E.prf(asked.select(key), predicted, keyed)
    return E.macro(asked.select(key, "split", "mode").join(scores, "qid"), "split", "mode").select("split", "mode", "n", round4(F.col("macro_p")).alias("macro_p"), round4(F.col("macro_r")).alias("macro_r"))


@query("agg_stats", f"""with v as (select qid, score from scored where qid is not null and not isnan(score)), k as (select distinct qid from scored where qid is not null)
 select k.qid, count(score) as count, {R('coalesce(avg(score), 0)')} as mean, {R('coalesce(median(score), 0)')} as median, floor(coalesce(stddev_samp(score), 0) * 1000 + 0.5) / 1000 as stdev, coalesce(min(score), 0.0) as min, coalesce(max(score), 0.0) as max from k left join v using (qid) group by k.qid""")
def agg_stats(spark, sf_dir):
    out = E.statistics(table(spark, sf_dir, "scored").where("qid is not null"), "score", "qid")
    return out.select("qid", "count", round4(F.col("mean")).alias("mean"), round4(F.col("median")).alias("median"), (F.floor(F.col("stdev") * 1000 + 0.5).cast("double") / 1000).alias("stdev"), "min", "max")


@query("x02_rollup", f"""{PRF}, q as (select e.qid, e.source_meta.split as split, {Q.intent('e.question')} as intent from eval_rows e), j as (select q.split, q.intent, s.f1 from q join s using (qid))
 select split, intent, cast(grouping(split, intent) as int) as level, count(*) as n, {R('avg(f1)')} as macro_f1 from j group by rollup (split, intent)""")
def x02_rollup(spark, sf_dir):
    from paperloom.functions.understanding import intent

    asked = table(spark, sf_dir, "eval_rows").select("qid", F.col("source_meta.split").alias("split"), intent(F.col("question")).alias("intent"))
    return E.macro_report(samples(spark, sf_dir).join(asked, "qid"), "split", "intent").select("split", "intent", "level", "n", round4(F.col("macro_f1")).alias("macro_f1"))


@query("x03_fusion", f"""with base as (select qid, score, features, ord, {Q.normal_id('paper_id')} as paper_id from scored where qid is not null and score is not null and not isnan(score)),
 lanes as (select qid, paper_id, row_number() over (partition by qid order by score desc, ord) as rnk from base qualify rnk <= 10 union all select qid, paper_id, row_number() over (partition by qid order by element_at(features, 'llm')[1] desc, ord) as rnk from base where element_at(features, 'llm')[1] is not null qualify rnk <= 10),
 f as (select qid, paper_id, floor(sum(1.0::double / (60 + rnk)) * 1e8 + 0.5) / 1e8 as fused from lanes where paper_id <> '' group by 1, 2) select qid, paper_id, fused, cast(row_number() over (partition by qid order by fused desc, paper_id) as int) as rnk from f qualify rnk <= 20""")
def x03_fusion(spark, sf_dir):
    return E.fuse(lanes(spark, sf_dir).where("paper_id <> ''").select("qid", F.col("mode").alias("lane"), "paper_id", "rnk"))
