"""Queries of citation graphs and result lists: the selection is each question's 20 best-scored papers."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperloom.functions import identity, scoring, text, understanding
from paperloom.operators import graph as G
from paperloom.operators import organize as O
from paperloom.operators import pool
from paperloom.operators import retrieval as R
from paperloom.plans import sqltext as Q
from paperloom.plans.identity import ALIASES
from paperloom.plans.registry import Registry
from paperloom.session import table

query = Registry()


def selected(spark, sf_dir):
    """qid, paper_id, sel_rank, score, features, reason of the 20 best rows of each question with a known paper, and the paper."""
    rows = table(spark, sf_dir, "scored").where("qid is not null and score is not null and not isnan(score)").select("qid", "paper_id", "score", "ord", "features", "reason")
    known = pool.with_payload(pool.first_papers(table(spark, sf_dir, "papers"))).select("paper_id", "title", "abstract", "year", "source", "raw", "j")
    once = rows.join(known.select("paper_id"), "paper_id").groupBy("qid", "paper_id").agg(F.max_by(F.struct("score", "ord", "features", "reason"), F.struct(F.col("score"), -F.col("ord"))).alias("b")).select("qid", "paper_id", "b.*")
    order = Window.partitionBy("qid").orderBy(F.col("score").desc(), "ord")
    return once.withColumn("sel_rank", F.row_number().over(order)).where("sel_rank <= 20").join(known, "paper_id")


SELECTED = f"""with {Q.FIRST}, best as (select s.qid, s.paper_id, s.score, s.ord as sord, s.features, s.reason from scored s where qid is not null and score is not null and not isnan(score) and paper_id in (select paper_id from fp) qualify row_number() over (partition by qid, paper_id order by score desc, s.ord) = 1),
 sel0 as (select *, cast(row_number() over (partition by qid order by score desc, sord) as int) as sel_rank from best qualify sel_rank <= 20), sel as (select sel0.*, fp.title, fp.abstract, fp.year, fp.source, fp.j from sel0 join fp using (paper_id))"""
_FORMS = "list_distinct(list_filter([" + ", ".join([Q.normal("target_key"), *[f"case when starts_with(lower({Q.strip('target_key')}), {Q.quote(p)}) then {Q.normal(f'substr({Q.strip(chr(116) + chr(97) + chr(114) + chr(103) + chr(101) + chr(116) + chr(95) + chr(107) + chr(101) + chr(121))}, {len(p) + 1})')} end" for p in identity.PREFIXES]]) + "], lambda v: v is not null and v <> ''))"
INDEX = f"{SELECTED}, {ALIASES.replace('from papers_j', 'from fp')}, ix as (select qid, alias, arg_min(paper_id, sel_rank) as canon from (select s.qid, s.paper_id, s.sel_rank, unnest(a.al) as alias from sel0 s join aliased a using (paper_id)) group by qid, alias)"
_REPLIES = """e0 as (select seed_id as seed, direction, via, target_key, bool_or(coalesce(ok, false)) as ok, case via when 'local' then 0 when 'openalex' then 1 when 'crossref' then 2 when 's2' then 3 end as stage from edges where seed_id is not null group by 1, 2, 3, 4),
 e1 as (select * from e0 where stage is not null qualify via <> 's2' or row_number() over (partition by seed, direction, via order by target_key) <= case when direction = 'ref' then 100 else 50 end),
 rep as (select s.qid, e1.* from sel0 s join e1 on e1.seed = s.paper_id where e1.via = 'local' or s.sel_rank <= 8)"""
GRAPH = f"""{INDEX}, {_REPLIES}, found as (select qid, seed, direction, via, target_key, stage, arg_min(canon, priority) as canon from (select r.*, ix.canon, r.priority from (select *, unnest({_FORMS}) as alias, generate_subscripts({_FORMS}, 1) as priority from rep where ok and target_key is not null) r join ix using (qid, alias)) group by all),
 linked as (select * from (select qid, case when direction = 'ref' then seed else canon end as source, case when direction = 'ref' then canon else seed end as target, via, stage from found) where source <> target),
 built as (select qid, source, target, arg_min(via, stage) as via from linked l where stage <> 2 or not exists (select 1 from linked m where m.qid = l.qid and m.stage < 2) group by 1, 2, 3)"""


@query("join_select", f"{SELECTED} select qid, paper_id, sel_rank, score from sel")
def join_select(spark, sf_dir):
    return selected(spark, sf_dir).select("qid", "paper_id", "sel_rank", "score")


@query("join_alias_index", f"{INDEX} select * from ix")
def join_alias_index(spark, sf_dir):
    return G.alias_index(selected(spark, sf_dir))


@query("join_match", f"{GRAPH} select qid, seed, direction, via, target_key, canon from found")
def join_match(spark, sf_dir):
    sel = selected(spark, sf_dir)
    by = ["qid", "seed", "direction", "via", "target_key"]
    return G.resolve(G.replies(sel, table(spark, sf_dir, "edges")).where("ok and target_key is not null"), "target_key", G.alias_index(sel), by)


@query("join_graph", f"{GRAPH} select * from built")
def join_graph(spark, sf_dir):
    return G.build(selected(spark, sf_dir), table(spark, sf_dir, "edges"))


for _name, _via in {"join_edges_oa": "openalex", "join_edges_cr": "crossref", "join_edges_s2": "s2"}.items():

    @query(_name, f"{GRAPH} select distinct qid, source, target from linked where via = '{_via}'")
    def _edges(spark, sf_dir, via=_via):
        only = table(spark, sf_dir, "edges").where(F.col("via") == via)
        return G.build(selected(spark, sf_dir), only, crossref_always=True).select("qid", "source", "target")


@query("join_edges_local")
def join_edges_local(spark, sf_dir):
    return G.local_edges(selected(spark, sf_dir))


_STATS = f"""{GRAPH}, st as (select n.qid, n_nodes, coalesce(n_edges, 0) as n_edges, coalesce(n_calls, 0) as n_calls, coalesce(n_errors, 0) as n_errors, coalesce(sources_used, '') as sources_used from (select qid, count(distinct paper_id) as n_nodes from sel0 group by qid) n
 left join (select qid, count(*) as n_calls, count(*) filter (not ok) as n_errors from rep group by qid) a using (qid) left join (select qid, count(*) as n_edges, array_to_string(list_sort(list(distinct via)), ',') as sources_used from built group by qid) b using (qid))"""


@query("agg_graph_stats", f"{_STATS} select *, case when n_edges > 0 then '' when n_errors > 0 then 'all_sources_failed_or_empty' else 'no_in_set_edges' end as reason from st")
def agg_graph_stats(spark, sf_dir):
    sel, edges = selected(spark, sf_dir), table(spark, sf_dir, "edges")
    return G.statistics(sel, edges, G.build(sel, edges))


@query("flt_graph", f"{_STATS} select qid, n_nodes >= 2 as build, case when n_edges >= 1 then 'graph' else 'list' end as view from st")
def flt_graph(spark, sf_dir):
    stats = agg_graph_stats(spark, sf_dir)
    return stats.select("qid", (F.col("n_nodes") >= 2).alias("build"), G.view(F.col("n_edges"), F.col("n_nodes")).alias("view"))


for _name, _dir, _most in (("src_s2_refs", "ref", 100), ("src_s2_cits", "cit", 50)):

    @query(_name, f"select seed_id, target_key, cast(row_number() over (partition by seed_id order by target_key) as int) as place from (select distinct seed_id, target_key from edges where direction = '{_dir}' and via = 's2' and ok and seed_id is not null and target_key is not null) qualify place <= {_most}")
    def _lists(spark, sf_dir, direction=_dir, most=_most):
        return G.neighbours(table(spark, sf_dir, "edges"), direction, most=most)


_POOL = "select distinct qid, paper_id as key from scored where qid is not null and paper_id is not null"


@query("join_anti_expand", f"""{SELECTED}, seeds as (select qid, paper_id as seed from sel0 where sel_rank <= 3 and score >= 0.3), pool as ({_POOL})
 select distinct s.qid, e.target_key as key from seeds s join edges e on e.seed_id = s.seed where e.ok and e.target_key is not null and not exists (select 1 from pool p where p.qid = s.qid and p.key = e.target_key)""")
def join_anti_expand(spark, sf_dir):
    seeds = selected(spark, sf_dir).where("sel_rank <= 3 and score >= 0.3").select("qid", F.col("paper_id").alias("seed"))
    reached = seeds.join(table(spark, sf_dir, "edges").where("ok and target_key is not null"), F.col("seed") == F.col("seed_id")).select("qid", F.col("target_key").alias("key")).distinct()
    known = table(spark, sf_dir, "scored").where("qid is not null and paper_id is not null").select("qid", F.col("paper_id").alias("key"))
    return reached.join(known, ["qid", "key"], "left_anti")


_EXPANDED = f"""{SELECTED}, pool as ({_POOL}), lists as (select seed_id, direction, target_key as key, row_number() over (partition by seed_id, direction order by target_key) as rn from (select distinct seed_id, direction, target_key from edges where ok and seed_id is not null and target_key is not null and direction in ('ref', 'cit')) qualify rn <= 5),
 reached as (select s.qid, l.key, min(s.sel_rank * 1000 + case when l.direction = 'ref' then 0 else 500 end + l.rn) as o from sel0 s join lists l on l.seed_id = s.paper_id where s.sel_rank <= 3 and s.score >= 0.3 group by 1, 2), expanded as (select qid, key, cast(row_number() over (partition by qid order by o) - 1 as int) as place from reached anti join pool using (qid, key))"""


@query("join_anti_merge", f"{_EXPANDED} select qid, key from pool union all select qid, key from expanded")
def join_anti_merge(spark, sf_dir):
    """Each question's papers and those its best ones lead to."""
    known = table(spark, sf_dir, "scored").where("qid is not null and paper_id is not null").select("qid", F.col("paper_id").alias("key")).distinct()
    return R.merge(known, win_expand_budget(spark, sf_dir).select("qid", "key"))


@query("win_expand_budget", f"{_EXPANDED} select qid, place, key from expanded")
def win_expand_budget(spark, sf_dir):
    seeds = selected(spark, sf_dir).where("sel_rank <= 3 and score >= 0.3").select("qid", F.col("paper_id").alias("seed"), F.col("sel_rank").alias("k_rank"))
    known = table(spark, sf_dir, "scored").where("qid is not null and paper_id is not null").select("qid", F.col("paper_id").alias("key"))
    return G.expand(seeds, table(spark, sf_dir, "edges"), known)


@query("x04_typed_seeds", f"""{SELECTED}, cited as (select seed_id, count(distinct target_key) as n from edges where direction = 'cit' and ok group by seed_id), t as (select sel.qid, sel.paper_id, sel.score, sel.year, sel.sord, coalesce(cited.n, 0) as n_cited from sel left join cited on cited.seed_id = sel.paper_id)
 select qid, paper_id, 'relevant' as kind from t qualify row_number() over (partition by qid order by score desc, sord) <= 2 union all select qid, paper_id, 'cited' from t where n_cited > 0 qualify row_number() over (partition by qid order by n_cited desc, sord) <= 2 union all select qid, paper_id, 'recent' from t where year is not null qualify row_number() over (partition by qid order by year desc, sord) <= 2""")
def x04_typed_seeds(spark, sf_dir):
    cited = table(spark, sf_dir, "edges").where("direction = 'cit' and ok").groupBy("seed_id").agg(F.count_distinct("target_key").alias("n"))
    sel = selected(spark, sf_dir).join(cited, F.col("paper_id") == F.col("seed_id"), "left").withColumn("n_cited", F.coalesce("n", F.lit(0)))

    def best(rows, by, kind):
        order = Window.partitionBy("qid").orderBy(F.col(by).desc(), "ord")
        return rows.withColumn("k", F.row_number().over(order)).where("k <= 2").select("qid", "paper_id", F.lit(kind).alias("kind"))

    return best(sel, "score", "relevant").unionByName(best(sel.where("n_cited > 0"), "n_cited", "cited")).unionByName(best(sel.where("year is not null"), "year", "recent"))


def tiered(spark, sf_dir):
    asked = pool.questions(table(spark, sf_dir, "eval_rows")).select("qid", "intent", "question")
    return O.with_tiers(selected(spark, sf_dir).join(asked, "qid"))


_REL = "coalesce(" + ", ".join(f"element_at(features, '{k}')[1]" for k in ("relevance", "llm", "keyword_coverage", "filter")) + ", 1.0)"
TIERED = f"{SELECTED}, {Q.QUESTION}, tr as (select sel.*, q.intent, q.question, case when score >= {Q.tier_bar('q.intent')} and {_REL} >= 0.5 then 'highly_relevant' else 'partially_relevant' end as tier from sel join questions q using (qid))"


@query("agg_groups", f"""{TIERED} select e.qid, e.tier, coalesce(n, 0) as n, coalesce(ids, '') as paper_ids from (select distinct qid, t.tier from tr cross join (values ('highly_relevant'), ('partially_relevant')) t(tier)) e
 left join (select qid, tier, count(*) as n, string_agg(paper_id, ',' order by sel_rank) as ids from tr group by qid, tier) l using (qid, tier)""")
def agg_groups(spark, sf_dir):
    return O.groups(tiered(spark, sf_dir))


_FUNNEL = f"""{TIERED}, st as (select qid, 'retrieved' as s from scored where qid is not null union all select qid, 'filtered' from scored where qid is not null and score >= 0.5 and not isnan(score) union all select qid, 'ranked' from tr union all select qid, tier from tr),
 fn as (select qid, count(*) filter (s = 'retrieved') as n_retrieved, count(*) filter (s = 'filtered') as n_filtered, count(*) filter (s = 'ranked') as n_ranked, count(*) filter (s = 'highly_relevant') as n_highly_relevant, count(*) filter (s = 'partially_relevant') as n_partially_relevant from st group by qid)"""


def _funnel(spark, sf_dir):
    rows = table(spark, sf_dir, "scored").where("qid is not null")
    return O.funnel(rows, rows.where("score >= 0.5 and not isnan(score)"), tiered(spark, sf_dir))


@query("agg_funnel", f"{_FUNNEL} select * from fn")
def agg_funnel(spark, sf_dir):
    return _funnel(spark, sf_dir)


_LABEL = "case x.k " + " ".join(f"when '{k}' then '{v}'" for k, v in O.LABELS.items()) + " else x.k end"
_ENTRIES = "list_filter(list_transform(map_entries(coalesce(features, map([], []))), lambda e, i: {'neg': -e.value, 'i': i, 'k': e.key, 'v': e.value}), lambda x: x.k not in ('normalized', 'blended', 'impact_skipped') and not ends_with(x.k, '_skipped') and x.v > 0 and not isnan(x.v))"


@query("win_top_features", f"select ord, array_to_string(list_transform(list_sort({_ENTRIES})[1:3], lambda x: {_LABEL} || ' ' || cast(cast(floor(x.v * 100 + 0.5) as int) as varchar) || '%'), ' | ') as evidence from scored")
def win_top_features(spark, sf_dir):
    return table(spark, sf_dir, "scored").select("ord", F.array_join(O.top_features(F.col("features")), " | ").alias("evidence"))


@query("fn_reason")
def fn_reason(spark, sf_dir):
    q = F.col("question")
    return tiered(spark, sf_dir).select("qid", "paper_id", O.selection_reason(F.col("reason"), F.col("features"), F.col("tier"), F.col("intent"), understanding.topic(q), understanding.method_cue(q)).alias("selection_reason"))


@query("fn_summary")
def fn_summary(spark, sf_dir):
    rows = tiered(spark, sf_dir)
    top = rows.where("sel_rank = 1").select("qid", "intent", F.col("title").alias("top_title"))
    built = G.build(selected(spark, sf_dir), table(spark, sf_dir, "edges")).groupBy("qid").agg(F.count("*").alias("n_edges"))
    return O.summary(_funnel(spark, sf_dir).join(top, "qid").join(built, "qid", "left"))


@query("fn_query_view")
def fn_query_view(spark, sf_dir):
    q = F.col("question")
    first, last = understanding.years(q)
    return table(spark, sf_dir, "eval_rows").select("qid", F.to_json(F.struct(q.alias("raw_question"), understanding.intent(q).alias("intent"), understanding.topic(q).alias("topic"), F.struct(first.alias("year_from"), last.alias("year_to"), understanding.negations(q).alias("exclude")).alias("constraints"))).alias("view"))


@query("op_organize")
def op_organize(spark, sf_dir):
    """One row for each question: items, groups and funnel as JSON, the selection being bounded."""
    rows = tiered(spark, sf_dir)
    item = F.struct("sel_rank", "paper_id", "title", "year", identity.venue(F.col("j")).alias("venue"), identity.citation_count(F.col("j")).alias("citation_count"), "source", identity.url(F.col("paper_id"), F.col("j")).alias("url"), scoring.round4(F.col("score")).alias("score"), "tier", O.top_features(F.col("features")).alias("match_reasons"), text.snippet(F.col("abstract")).alias("abstract_snippet"))
    items = rows.groupBy("qid").agg(F.to_json(F.array_sort(F.collect_list(item))).alias("items"))
    lists = O.groups(rows).groupBy("qid").agg(F.to_json(F.array_sort(F.collect_list(F.struct("tier", "n", "paper_ids")))).alias("groups"))
    return items.join(lists, "qid").join(_funnel(spark, sf_dir), "qid")
