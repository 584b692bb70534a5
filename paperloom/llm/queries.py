"""Queries over the test tables, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.llm.ledger import Ledger, copies, in_batches
from paperloom.llm.linkage import link, link_classes
from paperloom.llm.lookup import map_to_list, misses
from paperloom.llm.packing import pack_documents, window_mixture
from paperloom.llm.splitting import split_column
from paperloom.llm.topn import top_n
from paperloom.llm.tokenizer import encode_column, token_counts
from paperloom.session import materialize, table

_RECORD = ("paper_id", "title")


def p2_found(spark, sf_dir):
    papers = table(spark, sf_dir, "papers")
    return copies(papers, in_batches(Ledger(spark), papers, _RECORD, "ord", 4), _RECORD, "ord")


def p2_ledger(spark, sf_dir):
    return in_batches(Ledger(spark), table(spark, sf_dir, "papers"), _RECORD, "ord", 4).table().select("keep_ord", "n")


def _listings(spark, sf_dir):
    arxiv, openalex, semantic = (table(spark, sf_dir, f"list_{x}") for x in ("arxiv", "openalex", "semantic"))
    return arxiv.unionByName(openalex).unionByName(semantic), "ord", "source", "title", "year", "authors"


def p3_found(spark, sf_dir):
    return link(*_listings(spark, sf_dir)).select("ord_a", "ord_b")


def p3_links(spark, sf_dir):
    return link_classes(*_listings(spark, sf_dir))


def p4_values(spark, sf_dir):
    return map_to_list(table(spark, sf_dir, "papers"), "ord", "raw", table(spark, sf_dir, "venues"), "venue_id", "name", "short_name", "kind", "venue")


def p4_found(spark, sf_dir):
    return p4_values(spark, sf_dir).selectExpr("ord", "entry as venue_id")


def p4_misses(spark, sf_dir):
    return misses(p4_values(spark, sf_dir))


def p5_found(spark, sf_dir):
    return top_n(table(spark, sf_dir, "scored"), "qid", "score", "ord", 10)


def p6_ids(spark, sf_dir):
    return encode_column(table(spark, sf_dir, "documents"), "doc_id", "text")


def p6_counts(spark, sf_dir):
    return token_counts(table(spark, sf_dir, "documents"), ["doc_id"], "text")


def p7_containers(spark, sf_dir):
    return pack_documents(table(spark, sf_dir, "documents"), "doc_id", "source", "text")


def p7_windows(spark, sf_dir):
    sizes = materialize(token_counts(table(spark, sf_dir, "documents"), ["doc_id", "source"], "text"), "sizes")
    return window_mixture(sizes, "doc_id", "source", "n_tokens")


def p7_mixture(spark, sf_dir):
    """Windows packed to target shares: the two largest sources weigh a quarter each, the others what they hold."""
    sizes = materialize(token_counts(table(spark, sf_dir, "documents"), ["doc_id", "source"], "text"), "sizes")
    named = [r[0] for r in sizes.where("source is not null").groupBy("source").agg(F.sum("n_tokens").alias("n")).orderBy(F.col("n").desc(), "source").limit(2).collect()]
    return window_mixture(sizes, "doc_id", "source", "n_tokens", targets=dict.fromkeys(named, 0.25))


def p8_pieces(spark, sf_dir):
    return split_column(table(spark, sf_dir, "documents"), "doc_id", "text")


_CANON = r"lower(upper(regexp_replace(coalesce({}, ''), '[\p{{P}}\s\p{{Z}}\x{{85}}\x{{1C}}-\x{{1F}}]', '', 'g')))"
_CANON_ROWS = f"select ord, {_CANON.format('paper_id')} a, {_CANON.format('title')} b from papers"

QUERIES = {"p2_found": p2_found, "p2_ledger": p2_ledger, "p3_found": p3_found, "p3_links": p3_links, "p4_found": p4_found, "p4_values": p4_values, "p4_misses": p4_misses, "p5_found": p5_found, "p6_ids": p6_ids, "p6_counts": p6_counts, "p7_containers": p7_containers, "p7_windows": p7_windows, "p7_mixture": p7_mixture, "p8_pieces": p8_pieces}
ORACLE = {
    "p2_found": f"select keep_ord, ord as copy_ord from (select ord, min(ord) over (partition by a, b) keep_ord from ({_CANON_ROWS}) where a <> '' and b <> '') where ord > keep_ord",
    "p2_ledger": f"select min(ord) keep_ord, count(*) n from ({_CANON_ROWS}) where a <> '' and b <> '' group by a, b",
    "p5_found": "select qid, cast(row_number() over (partition by qid order by score desc, ord) as int) rnk, ord from scored where qid is not null and score is not null and not isnan(score) qualify rnk <= 10",
}
