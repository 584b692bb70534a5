"""Questions, candidates, and the relations every stage works on.

Where one question of the original design was a loop, here all questions are one relation
keyed by qid. Per-question statistics are aggregated and joined back instead of computed in
windows, so a question with a third of all candidates is combined before it is shuffled;
row numbers are only taken up to a bound, which prunes before the shuffle as well.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.functions import identity, text, understanding


def questions(rows: DataFrame) -> DataFrame:
    """qid, question, intent, year_from, year_to, negation, qtok: one row for each row with a qid; null questions ask for nothing."""
    q = F.col("question")
    first, last = understanding.years(q)
    return rows.where("qid is not null").select("qid", "question", understanding.intent(q).alias("intent"), first.alias("year_from"), last.alias("year_to"), understanding.negations(q).alias("negation"), text.tokens(q).alias("qtok"))


def with_payload(papers: DataFrame) -> DataFrame:
    """papers with the parsed payload in j."""
    return papers.withColumn("j", identity.payload(F.col("raw")))


def first_papers(papers: DataFrame) -> DataFrame:
    """The earliest row of each paper id, by ord; rows without id are left out."""
    cols = [c for c in papers.columns if c != "paper_id"]
    best = papers.where("paper_id is not null").groupBy("paper_id").agg(F.min_by(F.struct(*cols), "ord").alias("p"))
    return best.select("paper_id", "p.*")


def described(papers: DataFrame) -> DataFrame:
    """The columns scoring needs, computed once per paper id: tokens, text, key, count, venue."""
    j, title = F.col("j"), F.col("title")
    whole = F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce("abstract", F.lit("")))
    # payloads are read where they lie: they aren't shuffled to find each id's first row
    derived = with_payload(papers).select(
        "paper_id", "ord", "title", "abstract", "year", "source", F.col("ord").alias("paper_ord"), text.normal(whole).alias("ptext"), text.tokens(whole).alias("ptok"), text.tokens(title).alias("ttok"),
        identity.canonical_key(F.col("paper_id"), title, j, F.col("ord")).alias("ckey"), F.coalesce(identity.citation_count(j), F.lit(0)).alias("cites"), identity.venue(j).alias("venue"),
    )
    return first_papers(derived).drop("ord")


def candidates(scored: DataFrame, papers: DataFrame, rows: DataFrame) -> DataFrame:
    """Every question with its candidates, once per canonical key: the earliest by ord is kept.

    Candidates without question, id or known paper are left out.
    """
    pairs = scored.select("qid", F.col("ord").alias("cord"), "paper_id").where("qid is not null and paper_id is not null")
    known = described(papers)
    keyed = pairs.join(known.select("paper_id", "ckey"), "paper_id")
    once = keyed.groupBy("qid", "ckey").agg(F.min_by(F.struct("cord", "paper_id"), "cord").alias("c")).select("qid", "c.cord", "c.paper_id")
    return once.join(known, "paper_id").join(questions(rows), "qid")
