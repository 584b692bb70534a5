"""Queries of planning, requests, retrieval and model hooks.

Hits of a sub-query in a source are the question's rows of `scored` whose paper came from it,
ten at most, best first.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperloom.functions import identity, scoring, text, understanding, variants
from paperloom.operators import hooks, planning, pool, ranking
from paperloom.operators import retrieval as R
from paperloom.operators.dedup import first_by_key
from paperloom.plans import sqltext as Q
from paperloom.plans.identity import PJ, papers
from paperloom.plans.registry import Registry
from paperloom.plans.scoring import RULES, candidates
from paperloom.session import materialize, table

query = Registry()


def understood(spark, sf_dir):
    return planning.understand(table(spark, sf_dir, "eval_rows").select("qid", "question"))


def sub_queries(spark, sf_dir):
    return materialize(planning.sub_queries(understood(spark, sf_dir)), "subqueries")


def hits(spark, sf_dir, asked):
    known = pool.described(table(spark, sf_dir, "papers")).select("paper_id", "ckey", F.lower(F.trim("source")).alias("source"))
    rows = table(spark, sf_dir, "scored").where("qid is not null and score is not null and not isnan(score)").join(known, "paper_id").where("source is not null")
    order = Window.partitionBy("qid", "source").orderBy(F.col("score").desc(), "ord")
    top = rows.withColumn("hit_rank", F.row_number().over(order)).where("hit_rank <= 10").select("qid", "source", "hit_rank", F.col("ckey").alias("key"), "paper_id")
    return top.join(asked.select("qid", "sqid"), "qid").select("qid", "sqid", "source", "hit_rank", "key", "paper_id")


@query("op_understand")
def op_understand(spark, sf_dir):
    return sub_queries(spark, sf_dir)


@query("op_heuristic", f"with {Q.QUESTION} select qid, intent, year_from, year_to, array_to_string(negation, '|') as negation, {Q.topic('question')} as topic, {Q.method('question')} as method, {Q.claim('question')} as claim from questions")
def op_heuristic(spark, sf_dir):
    return understood(spark, sf_dir).select("qid", "intent", "year_from", "year_to", F.array_join("negation", "|").alias("negation"), "topic", "method", "claim")


@query("op_plan")
def op_plan(spark, sf_dir):
    return planning.slot_usage(understood(spark, sf_dir))


@query("op_tasks")
def op_tasks(spark, sf_dir):
    return understood(spark, sf_dir).select("qid", F.posexplode("tasks").alias("place", "t")).select("qid", "place", "t.*")


@query("op_assemble")
def op_assemble(spark, sf_dir):
    return sub_queries(spark, sf_dir).groupBy("qid").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sq_ord", "text"))), lambda x: x["text"]), " | ").alias("texts"))


@query("fn_criteria", f"with {Q.criteria()} select * from crit")
def fn_criteria(spark, sf_dir):
    return understood(spark, sf_dir).select("qid", F.posexplode("criteria").alias("place", "c")).select("qid", "place", "c.type", "c.text", "c.required", "c.weight")


@query("agg_weight_norm", f"with {Q.criteria()} select qid, count(*) as n, {Q.round4('sum(weight)')} as total from crit where type not in ('negation', 'intent') group by qid")
def agg_weight_norm(spark, sf_dir):
    rows = fn_criteria(spark, sf_dir).where("type not in ('negation', 'intent')")
    return rows.groupBy("qid").agg(F.count("*").alias("n"), scoring.round4(F.sum("weight")).alias("total"))


@query("flt_gap")
def flt_gap(spark, sf_dir):
    return understood(spark, sf_dir).select("qid", "gap")


@query("flt_decompose")
def flt_decompose(spark, sf_dir):
    u = understood(spark, sf_dir)
    return u.select("qid", planning.auto_decompose(F.col("intent"), F.col("skeleton"), F.col("terms")).alias("decompose"))


@query("flt_variant")
def flt_variant(spark, sf_dir):
    """Titles of a question's answers as variants of its topic: which are worth searching for."""
    rows = table(spark, sf_dir, "eval_rows").select("qid", understanding.topic(F.col("question")).alias("canon"), F.coalesce("answer", F.array().cast("array<string>")).alias("answer"))
    return rows.select("qid", F.array_join(variants.retrieval_variants("canon", "answer"), " | ").alias("variants"))


@query("fn_stem")
def fn_stem(spark, sf_dir):
    """Neighbouring title words as term and variant: high confidence or not."""
    words = table(spark, sf_dir, "papers").select("ord", F.split(text.title_fingerprint(F.col("title")), " ").alias("w"))
    pairs = words.select("ord", F.explode(F.filter(F.transform("w", lambda x, i: F.struct(x.alias("a"), F.get(F.col("w"), i + 1).alias("b"))), lambda p: p["b"].isNotNull())).alias("p")).select("p.a", "p.b").distinct()
    return pairs.select("a", "b", variants.high_confidence("a", "b").alias("ok"))


def _reading():
    return F.to_json(F.struct(F.struct(F.col("year").alias("year_from")).alias("filters"), F.array(F.struct(F.col("title").alias("canonical"), F.array(F.lower("title"), F.col("abstract")).alias("variants"))).alias("term_groups")))


@query("fn_slot_norm")
def fn_slot_norm(spark, sf_dir):
    """Papers as a model's reading of a question: terms in one form."""
    rows = table(spark, sf_dir, "papers").withColumn("reading", _reading())
    terms = planning.terms_of(F.get_json_object("reading", "$.term_groups"))
    return rows.select("ord", F.explode(terms).alias("t")).select("ord", "t.text", "t.required", "t.replaceable", F.size("t.synonyms").alias("n_synonyms"))


@query("fn_skel_norm")
def fn_skel_norm(spark, sf_dir):
    return understood(spark, sf_dir).select("qid", F.col("skeleton.core").alias("core"), F.size("skeleton.parts").alias("n_parts"))


@query("join_overlap")
def join_overlap(spark, sf_dir):
    """Word pairs and triples of titles as parts: those left when the longer of overlapping ones stay."""
    rows = table(spark, sf_dir, "papers").select("ord", text.title_fingerprint(F.col("title")).alias("core")).withColumn("w", F.split("core", " "))
    spans = F.flatten(F.transform("w", lambda x, i: F.array(F.array_join(F.slice("w", i + 1, 2), " "), F.array_join(F.slice("w", i + 1, 3), " "))))
    part = lambda t, i: F.struct(F.concat(F.lit("t"), i.cast("string")).alias("id"), t.alias("text"), F.lit(True).alias("required"), F.lit(False).alias("replaceable"), F.array().cast("array<string>").alias("variants"))
    rows = rows.withColumn("parts", F.transform(F.filter(spans, lambda t: t != ""), part))
    return rows.select("ord", F.array_join(F.transform(planning.without_overlaps(F.col("core"), F.col("parts")), lambda p: p["text"]), " | ").alias("parts"))


@query("fn_render", f"with r as (select qid, {Q.squeeze('question')} as q from eval_rows) select qid, case when instr(q, 'for') > 0 then left(q, instr(q, 'for') - 1) || 'FOR' || substr(q, instr(q, 'for') + 3) when instr(lower(q), 'for') > 0 then left(q, instr(lower(q), 'for') - 1) || 'FOR' || substr(q, instr(lower(q), 'for') + 3) else q end as rendered from r")
def fn_render(spark, sf_dir):
    return table(spark, sf_dir, "eval_rows").select("qid", planning.render(text.squeeze(F.col("question")), F.lit("for"), F.lit("FOR")).alias("rendered"))


_YF, _YT = Q.years("question")


@query("req_year_oa", f"with y as (select qid, {_YF} as a, {_YT} as b from eval_rows) select qid, case when a = b then 'publication_year:' || a else array_to_string(list_filter(['publication_year:>' || (a - 1), 'publication_year:<' || (b + 1)], lambda x: x is not null), ',') end as years from y")
def req_year_oa(spark, sf_dir):
    a, b = understanding.years(F.col("question"))
    return table(spark, sf_dir, "eval_rows").select("qid", F.array_join(R.openalex_years(a, b), ",").alias("years"))


@query("req_year_ax", f"with y as (select qid, {_YF} as a, {_YT} as b from eval_rows) select qid, case when a is null and b is null then '' else 'submittedDate:[' || coalesce(a || '0101000000', '19910701000000') || ' TO ' || coalesce(b || '1231235959', '20991231235959') || ']' end as years from y")
def req_year_ax(spark, sf_dir):
    a, b = understanding.years(F.col("question"))
    return table(spark, sf_dir, "eval_rows").select("qid", R.arxiv_years(a, b).alias("years"))


@query("req_year_s2", f"with y as (select qid, {_YF} as a, {_YT} as b from eval_rows) select qid, case when a is not null or b is not null then coalesce(cast(a as varchar), '') || '-' || coalesce(cast(b as varchar), '') end as years from y")
def req_year_s2(spark, sf_dir):
    a, b = understanding.years(F.col("question"))
    return table(spark, sf_dir, "eval_rows").select("qid", R.s2_years(a, b).alias("years"))


@query("req_text", f"""with r as (select qid, {Q.strip("coalesce(question, '')")} as q, nullif(trim(regexp_extract(coalesce(question, ''), {Q.quote(understanding.METHOD_CUE)}, 1, 'i')), '') as m from eval_rows)
 select qid, case when m is not null and not contains(lower(q), lower(m)) then q || ' ' || m else q end as request_text from r""")
def req_text(spark, sf_dir):
    q = F.col("question")
    return table(spark, sf_dir, "eval_rows").select("qid", R.request_text(q, understanding.method_cue(q)).alias("request_text"))


def _requests(make, name):
    @query(name)
    def request(spark, sf_dir):
        none = F.lit(None).cast("string")
        return sub_queries(spark, sf_dir).select("qid", "sqid", make(F.col("text"), none, F.col("year_from"), F.col("year_to"), none).alias("r")).select("qid", "sqid", "r.*")

    return request


_requests(R.openalex_request, "req_openalex")
_requests(lambda q, m, a, b, v: R.arxiv_request(q, m, a, b), "req_arxiv")
_requests(R.s2_request, "req_s2")


_IDENT = f"coalesce({Q.arxiv().replace('regexp_extract(paper_id', 'regexp_extract(null')}, nullif(regexp_extract(rtrim(coalesce({Q.member('id')}, ''), '/'), '([^/]*)$', 1), ''), {Q.member('paperId')}, {Q.member('arxivId')}, split_part(regexp_extract(coalesce({Q.member('entry_id')}, ''), '([^/]*)$', 1), 'v', 1))"
_YEAR_OF = "coalesce(" + ", ".join(f"case when regexp_matches({y}, '^[0-9]+$') then try_cast({y} as int) end" for y in (Q.member("publication_year"), Q.member("year"), f"left({Q.member('published')}, 4)")) + ")"
_TITLE_OF = Q.squeeze(f"coalesce({Q.member('title')}, {Q.member('display_name')})")
_PAPER = f"{PJ} select ord, {_IDENT} as paper_id, {_TITLE_OF} as title, {_YEAR_OF} as year from papers_j where ({_IDENT} <> '' or {_TITLE_OF} <> '')"


def _projected(name, source):
    @query(name, _PAPER + (f" and lower(trim(source)) = '{source}'" if source else ""))
    def project(spark, sf_dir):
        rows = papers(spark, sf_dir).where(F.lower(F.trim("source")) == source) if source else papers(spark, sf_dir)
        return rows.select("ord", R.paper_of(F.col("paper_id"), F.col("j")).alias("p")).where("p is not null").select("ord", "p.*")

    return project


for _name, _source in {"prj_oa": "openalex", "prj_ax": "arxiv", "prj_s2": "semantic", "prj_generic": None}.items():
    _projected(_name, _source)


_ADDRESSES = ", ".join(Q.member(k) for k in ("open_access.oa_url", "primary_location.landing_page_url", "primary_location.pdf_url"))
_LISTED = "coalesce(case when json_type(j, '$.locations') = 'ARRAY' then flatten(list_transform(from_json(json_extract(j, '$.locations'), '[\"JSON\"]'), lambda x: [json_extract_string(x, '$.landing_page_url'), json_extract_string(x, '$.pdf_url')])) end, [])"
_IDS = ", ".join(Q.member(f"ids.{k}") for k in ("openalex", "doi", "arxiv", "mag", "pmid"))
_FIRST_ARXIV = r"coalesce(nullif(regexp_extract(u, '(?:arxiv\.org/(?:abs|pdf)/|arxiv[:\s])(\d{4}\.\d{4,5})(?:v\d+)?', 1, 'i'), ''), nullif(regexp_extract(u, 'arxiv.*?/(\d{4}\.\d{4,5})(?:v[^/]*)?/?$', 1, 'i'), ''))"


@query("prj_oa_arxiv", f"{PJ} select ord, coalesce(list_filter(list_transform(list_concat([{_ADDRESSES}], {_LISTED}, [{_IDS}]), lambda u: {_FIRST_ARXIV}), lambda x: x is not null)[1], '') as arxiv from papers_j")
def prj_oa_arxiv(spark, sf_dir):
    return papers(spark, sf_dir).select("ord", R.arxiv_id_in_work(F.col("j")).alias("arxiv"))


@query("prj_oa_abstract", f"select ord, {Q.squeeze('abstract')} as abstract from papers")
def prj_oa_abstract(spark, sf_dir):
    """Abstracts through an inverted index and back."""
    rows = table(spark, sf_dir, "papers").select("ord", R.index_of(F.filter(F.split(text.squeeze(F.col("abstract")), " "), lambda w: w != "")).alias("ix"))
    return rows.select("ord", R.abstract_of(F.col("ix")).alias("abstract"))


@query("win_priority")
def win_priority(spark, sf_dir):
    return sub_queries(spark, sf_dir).select("qid", "sqid", R.priority(F.col("angle"), F.col("mode"), F.col("channel")).alias("priority"))


@query("win_budget")
def win_budget(spark, sf_dir):
    return R.budgeted(sub_queries(spark, sf_dir)).select("qid", "sqid", "eligible")


@query("win_task_budget")
def win_task_budget(spark, sf_dir):
    u = understood(spark, sf_dir)
    return u.select("qid", F.size(planning.budget(F.col("tasks"), 2)).alias("n"))


@query("win_round_robin")
def win_round_robin(spark, sf_dir):
    """Answers as variants of the topic, swapped in turn."""
    rows = table(spark, sf_dir, "eval_rows")
    reading = F.to_json(F.struct(F.array(F.struct(understanding.topic(F.col("question")).alias("canonical"), F.col("answer").alias("variants"))).alias("term_groups")))
    u = planning.understand(rows.select("qid", "question", reading.alias("reading")), "reading")
    return u.select("qid", F.posexplode(planning.swaps(F.col("skeleton"))).alias("place", "t")).select("qid", "place", "t.transform", "t.text", "t.part")


@query("join_term_part", "select e.qid, p.ord from eval_rows e join papers p on lower(list_extract(e.answer, 1)) = lower(p.title)")
def join_term_part(spark, sf_dir):
    """First answers that are a paper's title, letter case aside."""
    a = table(spark, sf_dir, "eval_rows").select("qid", F.lower(F.try_element_at("answer", F.lit(1))).alias("t"))
    return a.join(table(spark, sf_dir, "papers").select("ord", F.lower("title").alias("t")), "t").select("qid", "ord")


def calls_and_hits(spark, sf_dir):
    asked = sub_queries(spark, sf_dir)
    found = materialize(hits(spark, sf_dir, asked), "hits")
    return R.trace(asked, found), found


@query("src_run")
def src_run(spark, sf_dir):
    return R.trace(sub_queries(spark, sf_dir), sources=("arxiv", "openalex", "semantic", "unknown"))


@query("win_retrieve_order")
def win_retrieve_order(spark, sf_dir):
    return R.retrieve(*calls_and_hits(spark, sf_dir)).select("qid", "key", "paper_id", "source", "cord")


@query("set_union_sources", f"""with {Q.FIRST}, d as (select paper_id, {Q.key()} as ckey, lower(trim(source)) as src from fp), h as (select s.qid, d.src, d.ckey from scored s join d using (paper_id) where s.qid is not null and s.score is not null and not isnan(s.score) and d.src is not null
 qualify row_number() over (partition by s.qid, d.src order by s.score desc, s.ord) <= 10) select distinct qid, ckey as key from h where src in ('arxiv', 'openalex', 'semantic') and qid in (select qid from eval_rows)""")
def set_union_sources(spark, sf_dir):
    return R.retrieve(*calls_and_hits(spark, sf_dir)).select("qid", "key")


@query("agg_calls")
def agg_calls(spark, sf_dir):
    return R.call_stats(calls_and_hits(spark, sf_dir)[0])


@query("agg_trace_errors", "select seed_id, string_agg(distinct via, ',' order by via) as failed from edges where not coalesce(ok, false) and seed_id is not null group by seed_id")
def agg_trace_errors(spark, sf_dir):
    rows = table(spark, sf_dir, "edges").where("not coalesce(ok, false) and seed_id is not null")
    return rows.groupBy("seed_id").agg(F.array_join(F.array_sort(F.collect_set("via")), ",").alias("failed"))


@query("set_except_queries")
def set_except_queries(spark, sf_dir):
    proposed = table(spark, sf_dir, "eval_rows").select("qid", F.posexplode(understanding.templates(understanding.intent(F.col("question")), understanding.topic(F.col("question")), F.col("question"))).alias("place", "text"))
    return R.new_queries(proposed, sub_queries(spark, sf_dir).select("qid", "text"))


@query("win_refine_parse")
def win_refine_parse(spark, sf_dir):
    """Queries out of a model's fenced reply, those not asked before."""
    rows = table(spark, sf_dir, "eval_rows")
    reply = F.concat(F.lit("Sure:\n```json\n"), F.to_json(F.array("question", F.lower("question"), F.concat(F.col("question"), F.lit(" survey")))), F.lit("\n```"))
    proposed = rows.select("qid", F.posexplode(F.from_json(text.loose_json(reply, "[", "]"), "array<string>")).alias("place", "text"))
    return R.new_queries(proposed, rows.select("qid", F.col("question").alias("text")))


@query("win_iterate")
def win_iterate(spark, sf_dir):
    """Questions with few candidates gain those of their papers' neighbours in `edges`; the log of the rounds."""
    known = candidates(spark, sf_dir).select("qid", F.col("ckey").alias("key"), "cord", "paper_id")
    edges = table(spark, sf_dir, "edges").where("ok and target_key is not null")

    def refine(asked, k):
        near = known.join(asked, "qid").join(edges, F.col("paper_id") == F.col("seed_id"))
        return near.select("qid", F.col("target_key").alias("key"), "cord", F.col("target_key").alias("paper_id"))

    return R.iterate(known, refine, table(spark, sf_dir, "eval_rows").where("qid is not null"), rounds=2)[1]


_STUB = "('0x' || left(md5(coalesce(question, '') || paper_id), 4))::int / 65535::double"


@query("udf_judge", f"{RULES}, top as (select *, row_number() over (partition by qid order by keyword_coverage desc, cord) as k from r where keyword_coverage > 0 qualify k <= 15) select qid, paper_id, {Q.round4(_STUB)} as llm from top qualify row_number() over (partition by qid, paper_id order by k) = 1")
def udf_judge(spark, sf_dir):
    return hooks.judge(ranking.score_rules(candidates(spark, sf_dir))).select("qid", "paper_id", scoring.round4(F.col("llm")).alias("llm"))


@query("join_left_llm", f"""{RULES}, top as (select *, row_number() over (partition by qid order by keyword_coverage desc, cord) as k from r where keyword_coverage > 0 qualify k <= 15), j as (select qid, paper_id, {_STUB} as llm from top)
 select r.qid, r.cord, {Q.round4('coalesce(j.llm, r.keyword_coverage)')} as relevance from r left join j using (qid, paper_id)""")
def join_left_llm(spark, sf_dir):
    rows = ranking.score_rules(candidates(spark, sf_dir))
    return ranking.with_model_scores(rows, hooks.judge(rows)).select("qid", "cord", scoring.round4(F.col("relevance")).alias("relevance"))


@query("fn_json_scores", f"select qid, paper_id, {Q.round4(Q.clip('score * 2'))} as llm from scored where qid is not null and paper_id is not null and score is not null qualify row_number() over (partition by qid, paper_id order by ord desc) = 1")
def fn_json_scores(spark, sf_dir):
    """Replies with repeats, unknown ids, scores out of range and no numbers."""
    rows = table(spark, sf_dir, "scored").where("qid is not null and paper_id is not null")
    item = F.struct("paper_id", (F.col("score") * 2).cast("string").alias("score"), "reason")
    lists = rows.select("qid", "paper_id", "ord", item.alias("x")).withColumn("batch", F.floor(F.col("ord") / 8).cast("int")).groupBy("qid", "batch").agg(F.array_sort(F.collect_list(F.struct("ord", "x"))).alias("l"))
    replied = lists.select("qid", "batch", F.transform("l", lambda y: y["x"]["paper_id"]).alias("ids"), F.concat(F.lit("Scores: "), F.to_json(F.transform("l", lambda y: y["x"])), F.lit(" done")).alias("reply"))
    return hooks.json_scores(replied).select("qid", "paper_id", scoring.round4(F.col("llm")).alias("llm"))


@query("udf_embed", f"select count(distinct left({Q.squeeze('question')}, 1800)) as n from eval_rows where {Q.squeeze('question')} <> ''")
def udf_embed(spark, sf_dir):
    return hooks.encode(table(spark, sf_dir, "eval_rows"), "question").where("size(vector) = 16").agg(F.count("*").alias("n"))


@query("udf_llm_chain")
def udf_llm_chain(spark, sf_dir):
    """The judge behind backends that fail or say nothing."""

    def broken(prompt):
        raise RuntimeError("429")

    chain = hooks.first_reply(broken, lambda prompt: "", hooks.stub_judge)
    return hooks.judge(ranking.score_rules(candidates(spark, sf_dir)), chain, top_k=3).select("qid", "paper_id", scoring.round4(F.col("llm")).alias("llm"))


@query("src_arxiv_ids", f"with {Q.PAPERS}, a as (select distinct {Q.normal_id('x')} as nid from (select unnest(answer_arxiv_id) as x from eval_rows) where x is not null and {Q.is_arxiv('x')}) select a.nid, min(p.ord) as ord from a join (select ord, {Q.normal_id('paper_id')} as nid from papers_j where paper_id is not null) p using (nid) group by a.nid")
def src_arxiv_ids(spark, sf_dir):
    wanted = table(spark, sf_dir, "eval_rows").select(F.explode("answer_arxiv_id").alias("x")).where(identity.is_arxiv_id(F.col("x"))).select(identity.normal_id(F.col("x")).alias("nid")).distinct()
    have = first_by_key(table(spark, sf_dir, "papers").where("paper_id is not null").select("ord", identity.normal_id(F.col("paper_id")).alias("nid")), ["nid"], "ord")
    return wanted.join(have, "nid").select("nid", "ord")


@query("src_arxiv_title", "with t as (select qid, regexp_replace(lower(coalesce(list_extract(answer, 1), '')), '[^a-z0-9]', '', 'g') as k from eval_rows), p as (select regexp_replace(lower(coalesce(title, '')), '[^a-z0-9]', '', 'g') as k, min(ord) as ord from papers group by 1) select t.qid, p.ord from t join p using (k) where k <> ''")
def src_arxiv_title(spark, sf_dir):
    key = lambda c: F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]", "")
    wanted = table(spark, sf_dir, "eval_rows").select("qid", key(F.try_element_at("answer", F.lit(1))).alias("k")).where("k <> ''")
    have = table(spark, sf_dir, "papers").select("ord", key(F.col("title")).alias("k")).groupBy("k").agg(F.min("ord").alias("ord"))
    return wanted.join(have, "k").select("qid", "ord")


@query("src_s2_paper", f"{PJ} select {Q.member('paperId')} as s2, min(ord) as ord from papers_j where {Q.member('paperId')} is not null group by 1")
def src_s2_paper(spark, sf_dir):
    rows = papers(spark, sf_dir).select("ord", identity.member(F.col("j"), "paperId").alias("s2")).where("s2 is not null")
    return first_by_key(rows, ["s2"], "ord").select("s2", "ord")
