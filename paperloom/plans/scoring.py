"""Queries of the scoring core over all questions and their candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions import scoring as S
from paperloom.operators import pool, ranking
from paperloom.plans import sqltext as Q
from paperloom.plans.registry import Registry
from paperloom.session import table

query = Registry()

_WHOLE = "concat_ws(' ', coalesce(title, ''), coalesce(abstract, ''))"
DESCRIBED = f"""{Q.FIRST}, described as (select paper_id, title, abstract, year, source, {Q.normal(_WHOLE)} as ptext, {Q.tokens(_WHOLE)} as ptok, {Q.tokens('title')} as ttok,
 {Q.key()} as ckey, {Q.count_or_null()} as cites, {Q.venue()} as venue from fp)"""
CANDIDATES = f"""with {DESCRIBED}, {Q.QUESTION}, once as (select s.qid, s.ord as cord, s.paper_id from scored s join described d on d.paper_id = s.paper_id where s.qid is not null
 qualify row_number() over (partition by s.qid, d.ckey order by s.ord) = 1), cand as (select * from once join described using (paper_id) join questions using (qid))"""
_NEG = f"len(list_filter(list_transform(negation, lambda n: {Q.normal('n')}), lambda n: n <> '' and contains(ptext, n))) > 0"
RULES = f"""{CANDIDATES}, ruled as (select *, case when year is not null and (coalesce(year < year_from, false) or coalesce(year > year_to, false)) then 'year_mismatch' when {_NEG} then 'negation_hit' else 'keyword_coverage' end as reason from cand),
 r as (select *, case when reason = 'keyword_coverage' then {Q.coverage('qtok', 'ptok', 'ttok')} else 0.0::double end as keyword_coverage from ruled)"""
IMPACT = f"""{RULES}, stats as (select qid, max(cites) as max_citations, coalesce(min(year), 2000) as min_year, coalesce(max(year), 2026) as max_year from r group by qid),
 i as (select r.*, max_citations, min_year, max_year, {Q.round4(Q.citation('cites', 'max_citations'))} as citation, {Q.round4(Q.recency('year', 'min_year', 'max_year'))} as recency,
 {Q.round4(Q.venue_score('venue'))} as venue_score, {Q.round4(Q.title_density('qtok', 'ttok'))} as title_density from r join stats using (qid))"""


def _scored(embedding: str = "null::double", source: str = "i") -> str:
    mixed = Q.blend("keyword_coverage", embedding, "citation", "recency", "venue_score", "title_density", "intent")
    return f"""b as (select *, case when keyword_coverage > 0 then {mixed} else 0.0::double end as blended, {Q.threshold('intent')} as bar from {source}),
 n as (select *, case when keyword_coverage > 0 then {Q.normalize('blended', 'bar')} else 0.0::double end as normalized from b)"""


FILTERED = f"{IMPACT}, {_scored()}"
ORDER = "normalized desc, blended desc, keyword_coverage desc, cord"


def candidates(spark, sf_dir):
    return pool.candidates(table(spark, sf_dir, "scored"), table(spark, sf_dir, "papers"), table(spark, sf_dir, "eval_rows"))


def filtered(spark, sf_dir):
    return ranking.filter_papers(candidates(spark, sf_dir))


@query("join_cross_score", f"{CANDIDATES} select qid, paper_id, cord, cast(len(list_intersect(qtok, ptok)) as bigint) as n_matched from cand")
def join_cross_score(spark, sf_dir):
    return candidates(spark, sf_dir).select("qid", "paper_id", "cord", F.size(F.array_intersect("qtok", "ptok")).cast("bigint").alias("n_matched"))


@query("set_intersect", f"{CANDIDATES} select qid, cord, {Q.shown('list_intersect(qtok, ttok)')} as matched from cand")
def set_intersect(spark, sf_dir):
    return candidates(spark, sf_dir).select("qid", "cord", F.array_join(F.array_sort(F.array_intersect("qtok", "ttok")), " ").alias("matched"))


@query("fn_coverage", f"{CANDIDATES} select qid, cord, {Q.coverage('qtok', 'ptok', 'ttok')} as coverage from cand")
def fn_coverage(spark, sf_dir):
    return candidates(spark, sf_dir).select("qid", "cord", S.coverage(F.col("qtok"), F.col("ptok"), F.col("ttok")).alias("coverage"))


@query("fn_title_density", f"{CANDIDATES} select qid, cord, {Q.round4(Q.title_density('qtok', 'ttok'))} as density from cand")
def fn_title_density(spark, sf_dir):
    return candidates(spark, sf_dir).select("qid", "cord", S.round4(S.title_density(F.col("qtok"), F.col("ttok"))).alias("density"))


@query("flt_year", f"{CANDIDATES} select qid, cord from cand where year is null or ((year_from is null or year >= year_from) and (year_to is null or year <= year_to))")
def flt_year(spark, sf_dir):
    return candidates(spark, sf_dir).where(ranking.year_ok(F.col("year"), F.col("year_from"), F.col("year_to"))).select("qid", "cord")


@query("flt_negation", f"{CANDIDATES} select qid, cord from cand where {_NEG}")
def flt_negation(spark, sf_dir):
    return candidates(spark, sf_dir).where(ranking.negation_hit(F.col("ptext"), F.col("negation"))).select("qid", "cord")


@query("flt_hard", f"{RULES} select qid, cord, reason, keyword_coverage from r")
def flt_hard(spark, sf_dir):
    return ranking.score_rules(candidates(spark, sf_dir)).select("qid", "cord", "reason", "keyword_coverage")


@query("agg_impact_stats", f"{IMPACT} select qid, max_citations, min_year, max_year from stats")
def agg_impact_stats(spark, sf_dir):
    return ranking.impact_stats(candidates(spark, sf_dir))


for _name, _column in {"fn_citation": "citation", "fn_recency": "recency", "fn_venue": "venue_score"}.items():

    @query(_name, f"{IMPACT} select qid, cord, {_column} from i")
    def _feature(spark, sf_dir, column=_column):
        return ranking.impact(ranking.score_rules(candidates(spark, sf_dir))).select("qid", "cord", column)


@query("fn_impact", f"{IMPACT} select qid, cord, citation, recency, venue_score, title_density from i")
def fn_impact(spark, sf_dir):
    return ranking.impact(ranking.score_rules(candidates(spark, sf_dir))).select("qid", "cord", "citation", "recency", "venue_score", "title_density")


@query("fn_weights", f"with {Q.QUESTION} select qid, intent, " + ", ".join(f"{Q.weight('intent', p)} as w_{p}" for p in S.PARTS) + " from questions")
def fn_weights(spark, sf_dir):
    return pool.questions(table(spark, sf_dir, "eval_rows")).select("qid", "intent", *[S.weight(F.col("intent"), p).alias(f"w_{p}") for p in S.PARTS])


@query("fn_threshold", f"with {Q.QUESTION} select qid, {Q.threshold('intent')} as bar, {Q.tier_bar('intent')} as tier_bar from questions")
def fn_threshold(spark, sf_dir):
    return pool.questions(table(spark, sf_dir, "eval_rows")).select("qid", S.threshold(F.col("intent")).alias("bar"), S.tier_bar(F.col("intent")).alias("tier_bar"))


@query("fn_blend", f"{FILTERED} select qid, cord, blended from n")
def fn_blend(spark, sf_dir):
    return filtered(spark, sf_dir).select("qid", "cord", "blended")


@query("fn_normalize", f"select ord, {' , '.join(f'{Q.normalize(chr(115) + chr(99) + chr(111) + chr(114) + chr(101), str(t))} as n{k}' for k, t in enumerate((0.0, 0.05, 0.15, 0.25, 1.0)))} from scored where score is not null and not isnan(score)")
def fn_normalize(spark, sf_dir):
    rows = table(spark, sf_dir, "scored").where("score is not null and not isnan(score)")
    return rows.select("ord", *[S.normalize(F.col("score"), F.lit(t)).alias(f"n{k}") for k, t in enumerate((0.0, 0.05, 0.15, 0.25, 1.0))])


@query("op_filter", f"{FILTERED} select qid, cord, paper_id, reason, keyword_coverage, blended, normalized, normalized >= case when bar > 0 then 0.5 else 0.0 end as passed from n")
def op_filter(spark, sf_dir):
    return filtered(spark, sf_dir).select("qid", "cord", "paper_id", "reason", "keyword_coverage", "blended", "normalized", "passed")


@query("flt_pass", f"{FILTERED} select qid, paper_id, normalized, cast(row_number() over (partition by qid order by {ORDER}) as int) as sel_rank from n where normalized >= 0.5 qualify sel_rank <= 20")
def flt_pass(spark, sf_dir):
    return ranking.select(filtered(spark, sf_dir)).select("qid", "paper_id", "normalized", "sel_rank")


@query("flt_rank", f"{FILTERED} select qid, paper_id, normalized, cast(row_number() over (partition by qid order by {ORDER}) as int) as sel_rank from n where normalized >= 0 and {Q.is_arxiv('paper_id')} qualify sel_rank <= 20")
def flt_rank(spark, sf_dir):
    return ranking.rank(filtered(spark, sf_dir), arxiv_only=True).select("qid", "paper_id", "normalized", "sel_rank")


@query("win_rank", f"{FILTERED} select qid, paper_id, cast(row_number() over (partition by qid order by {ORDER}) as int) as sel_rank from n qualify sel_rank <= 20")
def win_rank(spark, sf_dir):
    return ranking.rank(filtered(spark, sf_dir)).select("qid", "paper_id", "sel_rank")


@query("win_llm_topk", f"{RULES} select qid, cord, cast(row_number() over (partition by qid order by keyword_coverage desc, cord) as int) as k_rank from r where keyword_coverage > 0 qualify k_rank <= 15")
def win_llm_topk(spark, sf_dir):
    return ranking.first_k(ranking.score_rules(candidates(spark, sf_dir)), "keyword_coverage", 15).select("qid", "cord", "k_rank")


@query("win_emb_topk", f"{RULES} select qid, cord, cast(row_number() over (partition by qid order by keyword_coverage desc, cord) as int) as k_rank from r where keyword_coverage > 0 qualify k_rank <= 100")
def win_emb_topk(spark, sf_dir):
    return ranking.first_k(ranking.score_rules(candidates(spark, sf_dir)), "keyword_coverage", 100).select("qid", "cord", "k_rank")


@query("win_seeds", f"{RULES} select qid, cord, paper_id, cast(row_number() over (partition by qid order by keyword_coverage desc, cord) as int) as k_rank from r where keyword_coverage >= 0.3 qualify k_rank <= 3")
def win_seeds(spark, sf_dir):
    return ranking.first_k(ranking.score_rules(candidates(spark, sf_dir)), "keyword_coverage", 3, 0.3, strict=False).select("qid", "cord", "paper_id", "k_rank")


# Vectors: the first vector of each label stands for that label's question, the vectors for papers by doc_id.
_LABELS = "q as (select label, embedding::double[] as a from embeddings qualify row_number() over (partition by label order by vec_id) = 1)"


def _fold(x: str) -> str:
    return f"list_reduce(list_prepend(0.0::double, {x}), lambda s, e: s + e)"


_DOT, _NA, _NB = _fold("list_transform(list_zip(a, b), lambda p: p[1] * p[2])"), _fold("list_transform(a, lambda p: p * p)"), _fold("list_transform(b, lambda p: p * p)")
_COSINE = f"case when len(a) > 0 and len(a) = len(b) and sqrt({_NA}) * sqrt({_NB}) > 0 then greatest(0.0::double, least(1.0::double, {_DOT} / (sqrt({_NA}) * sqrt({_NB})))) else 0.0::double end"


@query("fn_cosine", f"with {_LABELS} select vec_id, label, {Q.round4(_COSINE)} as similarity from (select vec_id, q.label, a, embedding::double[] as b from embeddings e join q on q.label = e.label)")
def fn_cosine(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    heads = vectors.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("a"))
    return vectors.join(heads, "label").select("vec_id", "label", S.round4(S.cosine(F.col("a"), F.col("embedding"))).alias("similarity"))


_VECTORS = f"""v as (select qid, cord, paper_id, {Q.round4(_COSINE)} as embedding from (select t.qid, t.cord, t.paper_id, x.embedding::double[] as a, y.embedding::double[] as b from
 (select qid, cord, paper_id, row_number() over (partition by qid order by keyword_coverage desc, cord) as k from i where keyword_coverage > 0 qualify k <= 100) t
 join embeddings x on x.vec_id = try_cast(right(t.qid, 8) as bigint) % 1000 join embeddings y on y.vec_id = t.cord % 1000))"""


def vector_scores(spark, sf_dir, scored):
    """Similarities of the first 100 candidates of each question: question and paper have the vector their numbers name, modulo 1000; many have none."""
    vectors = table(spark, sf_dir, "embeddings")
    top = ranking.first_k(scored, "keyword_coverage", 100).select("qid", "cord", "paper_id")
    a = vectors.select(F.col("vec_id").alias("va"), F.col("embedding").alias("a"))
    b = vectors.select(F.col("vec_id").alias("vb"), F.col("embedding").alias("b"))
    joined = top.join(a, F.right("qid", F.lit(8)).try_cast("bigint") % 1000 == F.col("va")).join(b, F.col("cord") % 1000 == F.col("vb"))
    return joined.select("qid", "cord", "paper_id", S.round4(S.cosine(F.col("a"), F.col("b"))).alias("embedding"))


@query("fn_embed", f"{IMPACT}, {_VECTORS}, e as (select i.*, v.embedding from i left join v using (qid, cord)), {_scored('embedding', 'e')} select qid, cord, embedding, blended, normalized from n")
def fn_embed(spark, sf_dir):
    rows = candidates(spark, sf_dir)
    return ranking.filter_papers(rows, embeddings=vector_scores(spark, sf_dir, ranking.score_rules(rows))).select("qid", "cord", "embedding", "blended", "normalized")


_SCHEDULE = "select ord, array_to_string(list_filter([32, 16, 8, 4, 1], lambda x: x <= ord % 40 or x = 1), ' ') as schedule from papers"


@query("fn_schedule", _SCHEDULE)
def fn_schedule(spark, sf_dir):
    return table(spark, sf_dir, "papers").select("ord", F.array_join(S.concurrency_schedule(F.col("ord") % 40).cast("array<string>"), " ").alias("schedule"))


@query("agg_query_tokens", f"with {Q.QUESTION} select qid, {Q.shown('qtok')} as tokens from questions")
def agg_query_tokens(spark, sf_dir):
    return pool.questions(table(spark, sf_dir, "eval_rows")).select("qid", F.array_join(F.array_sort("qtok"), " ").alias("tokens"))


# Tiers of the scores in `scored`, by the features stored with them.
_REL = "coalesce(" + ", ".join(f"element_at(features, '{k}')[1]" for k in ("relevance", "llm", "keyword_coverage", "filter")) + ", 1.0)"
TIERED = f"""with {Q.QUESTION}, tiered as (select s.ord, s.qid, s.paper_id, s.score, {Q.tier_bar('q.intent')} as bar, {_REL} as relevance, case when s.score >= {Q.tier_bar('q.intent')} and {_REL} >= 0.5 then 'highly_relevant' else 'partially_relevant' end as tier
 from scored s join questions q using (qid) where s.score is not null and not isnan(s.score))"""


def tiered(spark, sf_dir):
    rows = table(spark, sf_dir, "scored").where("qid is not null and score is not null and not isnan(score)")
    asked = pool.questions(table(spark, sf_dir, "eval_rows")).select("qid", "intent")
    bar, rel = S.tier_bar(F.col("intent")), S.relevance_of(F.col("features"))
    return rows.join(asked, "qid").withColumn("relevance", rel).withColumn("tier", S.tier(F.col("score"), F.col("relevance"), bar))


@query("fn_tier", f"{TIERED} select ord, relevance, tier from tiered")
def fn_tier(spark, sf_dir):
    return tiered(spark, sf_dir).select("ord", "relevance", "tier")


@query("fn_tier_cut", f"{TIERED} select tier, count(*) as n from tiered group by tier")
def fn_tier_cut(spark, sf_dir):
    return tiered(spark, sf_dir).groupBy("tier").agg(F.count("*").alias("n"))


