"""Set precision, recall and F1 against gold answers, and their averages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperloom.functions.identity import is_arxiv_id, normal_id
from paperloom.functions.text import letters


def id_sets(rows: DataFrame, ident: str, as_title: bool = False) -> DataFrame:
    """Distinct qid, nid of rows in normal form, without empty ones."""
    norm = letters(F.col(ident)) if as_title else normal_id(F.col(ident))
    return rows.where(F.col("qid").isNotNull() & F.col(ident).isNotNull()).select("qid", norm.alias("nid")).where("nid <> ''").distinct()


def gold(rows: DataFrame, answers: str = "answer_arxiv_id") -> DataFrame:
    """qid, gold: one row for each answer of each question."""
    return rows.select("qid", F.explode(answers).alias("gold"))


def prf(questions: DataFrame, predicted: DataFrame, answers: DataFrame, as_title: bool = False) -> DataFrame:
    """qid, n_hit, n_pred_set, n_gold_set, p, r, f1 for every question.

    predicted: qid, paper_id; answers: qid, gold. Sets are compared in normal form. A question
    whose prediction or gold is empty scores 0 and stays in.
    """
    p, g = id_sets(predicted, "paper_id", as_title), id_sets(answers, "gold", as_title)
    # one pass: an id of a question is predicted, gold, or both
    both = p.withColumn("p", F.lit(1)).join(g.withColumn("g", F.lit(1)), ["qid", "nid"], "full_outer")
    n = both.groupBy("qid").agg(F.count("p").alias("n_pred_set"), F.count("g").alias("n_gold_set"), F.count(F.when(F.col("p").isNotNull() & F.col("g").isNotNull(), 1)).alias("n_hit"))
    out = questions.where("qid is not null").select("qid").distinct().join(n, "qid", "left").fillna(0, ["n_pred_set", "n_gold_set", "n_hit"])
    share = lambda of: F.when((F.col("n_pred_set") > 0) & (F.col("n_gold_set") > 0), F.col("n_hit") / F.col(of)).otherwise(F.lit(0.0))
    out = out.withColumn("p", share("n_pred_set")).withColumn("r", share("n_gold_set"))
    return out.withColumn("f1", F.when(F.col("n_hit") > 0, 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))).otherwise(F.lit(0.0)))


def samples(questions: DataFrame, predicted: DataFrame, answers: DataFrame, arxiv_only: bool = True) -> DataFrame:
    """prf() with the plain numbers of predictions, gold answers and arXiv predictions; only these are scored if arxiv_only."""
    scored = predicted.where(is_arxiv_id(F.col("paper_id"))) if arxiv_only else predicted
    filled = lambda c: F.count(F.when(F.col(c).isNotNull() & (F.col(c) != ""), 1))
    n = predicted.groupBy("qid").agg(filled("paper_id").alias("n_pred"), F.count(F.when(is_arxiv_id(F.col("paper_id")), 1)).alias("n_pred_arxiv"))
    m = answers.groupBy("qid").agg(filled("gold").alias("n_gold"))
    return prf(questions, scored, answers).join(n, "qid", "left").join(m, "qid", "left").fillna(0, ["n_pred", "n_pred_arxiv", "n_gold"])


def macro(scores: DataFrame, *by: Column | str) -> DataFrame:
    """n and the unweighted means of p, r and f1, by group if given; zeros for no rows."""
    means = [F.coalesce(F.avg(c), F.lit(0.0)).alias(f"macro_{c}") for c in ("p", "r", "f1")]
    return (scores.groupBy(*by) if by else scores).agg(F.count("*").alias("n"), *means)


def macro_report(scores: DataFrame, *levels: str) -> DataFrame:
    """macro() over every prefix of the levels at once (rollup); null marks a level summed over."""
    means = [F.avg(c).alias(f"macro_{c}") for c in ("p", "r", "f1")]
    return scores.rollup(*levels).agg(F.grouping_id().cast("int").alias("level"), F.count("*").alias("n"), *means)


def statistics(df: DataFrame, value: str, *by: str) -> DataFrame:
    """count, mean, median, sample stdev, min and max; a stdev of one value, and everything of none, is 0."""
    v = F.when(~F.isnan(F.col(value).cast("double")), F.col(value).cast("double"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    out = [F.count(v).alias("count"), zero(F.avg(v)).alias("mean"), zero(F.percentile(v, 0.5)).alias("median"), zero(F.stddev_samp(v)).alias("stdev"), zero(F.min(v)).alias("min"), zero(F.max(v)).alias("max")]
    return (df.groupBy(*by) if by else df).agg(*out)


def ranked_predictions(scored: DataFrame, score: str = "score", most: int = 20) -> DataFrame:
    """qid, nid, rnk: ids in normal form by falling score, each once, `most` at most; null and NaN scores take no part."""
    rows = scored.where(F.col("qid").isNotNull() & F.col(score).isNotNull() & ~F.isnan(score)).select("qid", normal_id(F.col("paper_id")).alias("nid"), F.col(score).alias("s"), "ord").where("nid <> ''")
    best = rows.groupBy("qid", "nid").agg(F.max(F.struct(F.col("s"), (-F.col("ord")).alias("o"))).alias("b"))
    order = Window.partitionBy("qid").orderBy(F.col("b.s").desc(), F.col("b.o").desc())
    return best.withColumn("rnk", F.row_number().over(order)).where(F.col("rnk") <= most).select("qid", "nid", "rnk")


def fuse(lanes: DataFrame, k: int = 60, most: int = 20) -> DataFrame:
    """Reciprocal rank fusion of lanes (qid, lane, paper_id, rnk): qid, paper_id, fused, rnk by falling sum of 1 / (k + rank), ties by id."""
    total = lanes.groupBy("qid", "paper_id").agg(F.sum(F.lit(1.0) / (k + F.col("rnk"))).alias("raw"))
    total = total.select("qid", "paper_id", (F.floor(F.col("raw") * 1e8 + 0.5) / 1e8).alias("fused"))  # sums come in any order
    order = Window.partitionBy("qid").orderBy(F.col("fused").desc(), "paper_id")
    return total.withColumn("rnk", F.row_number().over(order)).where(F.col("rnk") <= most)

