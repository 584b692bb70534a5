"""The scoring core: hard rules, coverage, impact, blend, normalization, selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperloom.functions import identity, scoring


def year_ok(year: Column, first: Column, last: Column) -> Column:
    """Within the years asked for, both inclusive; unknown years pass."""
    return year.isNull() | ((first.isNull() | (year >= first)) & (last.isNull() | (year <= last)))


def negation_hit(ptext: Column, negation: Column) -> Column:
    """Whether a phrase ruled out occurs anywhere in the text (as a substring, not a word)."""
    from paperloom.functions.text import normal

    return F.exists(F.filter(F.transform(negation, normal), lambda n: n != ""), lambda n: F.contains(ptext, n))


def score_rules(candidates: DataFrame, rule_year: bool = True, rule_negation: bool = True) -> DataFrame:
    """candidates with keyword_coverage double and reason: 0 and the rule's name where a hard rule rejects."""
    cover = scoring.coverage(F.col("qtok"), F.col("ptok"), F.col("ttok"))
    late = F.lit(rule_year) & ~year_ok(F.col("year"), F.col("year_from"), F.col("year_to"))
    ruled = F.lit(rule_negation) & negation_hit(F.col("ptext"), F.col("negation"))
    reason = F.when(late, "year_mismatch").when(ruled, "negation_hit").otherwise("keyword_coverage")
    return candidates.withColumn("reason", reason).withColumn("keyword_coverage", F.when(F.col("reason") == "keyword_coverage", cover).otherwise(F.lit(0.0)))


def impact_stats(candidates: DataFrame) -> DataFrame:
    """qid, max_citations, min_year, max_year over all candidates, rejected ones too; 2000 and 2026 where no year is known."""
    return candidates.groupBy("qid").agg(F.max("cites").alias("max_citations"), F.coalesce(F.min("year"), F.lit(2000)).alias("min_year"), F.coalesce(F.max("year"), F.lit(2026)).alias("max_year"))


def impact(scored: DataFrame) -> DataFrame:
    """scored with its question's statistics and the features citation, recency, venue_score and title_density, rounded."""
    r = scoring.round4
    return scored.join(impact_stats(scored), "qid").withColumns(
        {
            "citation": r(scoring.citation_score(F.col("cites"), F.col("max_citations"))),
            "recency": r(scoring.recency_score(F.col("year"), F.col("min_year"), F.col("max_year"))),
            "venue_score": r(scoring.venue_score(F.col("venue"))),
            "title_density": r(scoring.title_density(F.col("qtok"), F.col("ttok"))),
        }
    )


def with_model_scores(scored: DataFrame, model: DataFrame | None) -> DataFrame:
    """scored with relevance: the model's score (qid, paper_id, llm, llm_reason) where it has one, else the coverage."""
    if model is None:
        return scored.withColumn("llm", F.lit(None).cast("double")).withColumn("relevance", F.col("keyword_coverage"))
    joined = scored.join(model, ["qid", "paper_id"], "left")
    return joined.withColumn("relevance", F.coalesce(scoring.round4(F.col("llm")), F.col("keyword_coverage")))


def filter_papers(candidates: DataFrame, model: DataFrame | None = None, embeddings: DataFrame | None = None, override: float | None = None, apply_impact: bool = True, rule_year: bool = True, rule_negation: bool = True) -> DataFrame:
    """The scoring core over all questions: candidates with relevance, features, blended, normalized and passed.

    A relevance of 0 (a rejection, or no coverage at all) skips the impact and stays 0.
    model: qid, paper_id, llm. embeddings: qid, paper_id, embedding; candidates without one give its weight to the relevance.
    """
    scored = with_model_scores(score_rules(candidates, rule_year, rule_negation), model)
    full = impact(scored)
    full = full.join(embeddings.select("qid", "paper_id", "embedding"), ["qid", "paper_id"], "left") if embeddings is not None else full.withColumn("embedding", F.lit(None).cast("double"))
    mixed = scoring.blend(F.col("relevance"), F.col("embedding"), F.col("citation"), F.col("recency"), F.col("venue_score"), F.col("title_density"), F.col("intent"))
    bar = scoring.threshold(F.col("intent"), None if override is None else F.lit(float(override)))
    alive = F.col("relevance") > 0
    return (
        full.withColumn("blended", F.when(alive, mixed if apply_impact else F.col("relevance")).otherwise(F.lit(0.0)))
        .withColumn("bar", bar)
        .withColumn("normalized", F.when(alive, scoring.normalize(F.col("blended"), F.col("bar"))).otherwise(F.lit(0.0)))
        .withColumn("passed", F.col("normalized") >= F.when(F.col("bar") > 0, F.lit(0.5)).otherwise(F.lit(0.0)))
    )


def _order() -> list[Column]:
    """The chain of stable sorts as one order."""
    return [F.col("normalized").desc(), F.col("blended").desc(), F.col("relevance").desc(), F.col("keyword_coverage").desc(), F.col("cord")]


def select(scored: DataFrame, max_return: int = 20, arxiv_only: bool = False) -> DataFrame:
    """The passed papers of each question, best first, max_return at most, with sel_rank."""
    kept = scored.where("passed")
    if arxiv_only:
        kept = kept.where(identity.is_arxiv_id(F.col("paper_id")))
    return kept.withColumn("sel_rank", F.row_number().over(Window.partitionBy("qid").orderBy(*_order()))).where(F.col("sel_rank") <= max_return)


def rank(scored: DataFrame, threshold: float = 0.0, max_return: int = 20, arxiv_only: bool = False) -> DataFrame:
    """All scored papers at or above the threshold, best first. The default keeps papers under the pass bar, even rejected ones, while there is room."""
    kept = scored.where(F.col("normalized") >= threshold)
    if arxiv_only:
        kept = kept.where(identity.is_arxiv_id(F.col("paper_id")))
    return kept.withColumn("sel_rank", F.row_number().over(Window.partitionBy("qid").orderBy(*_order()))).where(F.col("sel_rank") <= max_return)


def first_k(scored: DataFrame, score: str, k: int, least: float = 0.0, strict: bool = True) -> DataFrame:
    """The first k of each question with a score above least (or at least, if not strict), in order of score and arrival, with k_rank."""
    kept = scored.where(F.col(score) > least if strict else F.col(score) >= least)
    return kept.withColumn("k_rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.col(score).desc(), "cord"))).where(F.col("k_rank") <= k)
