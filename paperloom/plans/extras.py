"""Queries of the smaller sources and hooks, and of whole runs."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperloom.functions import identity, text, understanding, variants
from paperloom.functions.scoring import round4
from paperloom.operators import evaluate, hooks, organize, planning, ranking
from paperloom.operators import retrieval as R
from paperloom.operators.shred import PAPER_ENTITIES, entities
from paperloom.plans import sqltext as Q
from paperloom.plans.identity import PJ, REWRITTEN, papers
from paperloom.plans.registry import Registry
from paperloom.plans.retrieval import sub_queries
from paperloom.plans.scoring import FILTERED, ORDER, candidates, filtered
from paperloom.session import shared_path, table
from paperloom.sources import files

query = Registry()
NEWEST = 2026
_M = identity.member


@query("src_oa_work", f"{PJ} select ord, coalesce({Q.openalex()}, 'https://doi.org/' || {Q.doi()}, 'arxiv:' || {Q.arxiv()}) as lookup_key, coalesce(json_array_length(j, '$.referenced_works'), 0)::bigint as n_refs from papers_j where coalesce({Q.openalex()}, {Q.doi()}, {Q.arxiv()}) is not null")
def src_oa_work(spark, sf_dir):
    rows = papers(spark, sf_dir).select("ord", identity.lookup_key(F.col("paper_id"), F.col("j")).alias("lookup_key"), F.from_json(F.try_variant_get("j", "$.referenced_works", "string"), "array<string>").alias("r"))
    return rows.where("lookup_key is not null").select("ord", "lookup_key", F.when(F.col("r").isNull(), 0).otherwise(F.size("r")).cast("bigint").alias("n_refs"))


@query("src_crossref", "select distinct seed_id, regexp_replace(lower(trim(target_key)), '^(https://doi.org/|http://doi.org/|doi:)', '') as doi from edges where via = 'crossref' and direction = 'ref' and ok and seed_id is not null and target_key is not null")
def src_crossref(spark, sf_dir):
    rows = table(spark, sf_dir, "edges").where("via = 'crossref' and direction = 'ref' and ok and seed_id is not null and target_key is not null")
    return rows.select("seed_id", F.regexp_replace(F.lower(F.trim("target_key")), "^(https://doi.org/|http://doi.org/|doi:)", "").alias("doi")).distinct()


_OPEN = "coalesce(try_cast(json_extract_string(j, '$.open_access.is_oa') as boolean), false)"


@query("src_oa_vendor", f"{PJ} select ord, cast(row_number() over (order by coalesce(citations, 0) desc, ord) as int) as place from papers_j where {_OPEN} and year between {NEWEST - 20} and {NEWEST} and {Q.squeeze('title')} <> '' and {Q.squeeze('abstract')} <> '' qualify place <= 200")
def src_oa_vendor(spark, sf_dir):
    """The first 200 open works of the last twenty years, the most cited first."""
    rows = papers(spark, sf_dir).where(F.coalesce(F.try_variant_get("j", "$.open_access.is_oa", "boolean"), F.lit(False)) & F.col("year").between(NEWEST - 20, NEWEST))
    top = rows.where((text.squeeze(F.col("title")) != "") & (text.squeeze(F.col("abstract")) != "")).select("ord", F.coalesce("citations", F.lit(0)).alias("c")).orderBy(F.col("c").desc(), "ord").limit(200)
    return top.select("ord", F.row_number().over(Window.orderBy(F.col("c").desc(), "ord")).alias("place"))


@query("src_oa_refs_vendor", "with d as (select distinct seed_id, target_key from edges where via = 'openalex' and direction = 'ref' and ok and seed_id is not null), n as (select seed_id, count(target_key) as n from d group by seed_id) select seed_id, target_key, cast(row_number() over (partition by seed_id order by target_key) as int) as place from d join n using (seed_id) where target_key in (select paper_id from papers) qualify n <= 100 or place <= 20")
def src_oa_refs_vendor(spark, sf_dir):
    """Known references of each seed; of a seed with more than 100 references, the first 20."""
    known = table(spark, sf_dir, "papers").where("paper_id is not null").select(F.col("paper_id").alias("target_key"))
    rows = table(spark, sf_dir, "edges").where("via = 'openalex' and direction = 'ref' and ok and seed_id is not null").select("seed_id", "target_key").distinct()
    sized = rows.join(rows.groupBy("seed_id").agg(F.count("target_key").alias("n")), "seed_id").join(known, "target_key", "left_semi")
    return sized.withColumn("place", F.row_number().over(Window.partitionBy("seed_id").orderBy("target_key"))).where("n <= 100 or place <= 20").select("seed_id", "target_key", "place")


@query("src_s2_vendor", f"{PJ} select ord, coalesce(array_to_string(from_json(json_extract(j, '$.fieldsOfStudy'), '[\"VARCHAR\"]'), ';'), '') as fields from papers_j where {Q.member('paperId')} is not null and year between {NEWEST - 20} and {NEWEST} and (json_type(j, '$.fieldsOfStudy') is null or json_type(j, '$.fieldsOfStudy') in ('ARRAY', 'NULL'))")
def src_s2_vendor(spark, sf_dir):
    fields = F.from_json(F.try_variant_get("j", "$.fieldsOfStudy", "string"), "array<string>")
    return papers(spark, sf_dir).where(_M(F.col("j"), "paperId").isNotNull() & F.col("year").between(NEWEST - 20, NEWEST)).select("ord", F.coalesce(F.array_join(fields, ";"), F.lit("")).alias("fields"))


_LINKS = [Q.member(k) for k in ("entry_id", "pdf_url", "open_access.oa_url")]


@query("src_serper", f"{PJ} select distinct regexp_extract(link, '(\\d{{4}}\\.\\d{{4,5}})', 1) as arxiv from (select unnest([{', '.join(_LINKS)}]) as link from papers_j) where regexp_extract(link, '(\\d{{4}}\\.\\d{{4,5}})', 1) <> ''")
def src_serper(spark, sf_dir):
    """arXiv ids in the addresses of the payloads, each once."""
    links = papers(spark, sf_dir).select(F.explode(F.array(*[_M(F.col("j"), k) for k in ("entry_id", "pdf_url", "open_access.oa_url")])).alias("link"))
    return links.select(F.regexp_extract("link", r"(\d{4}\.\d{4,5})", 1).alias("arxiv")).where("arxiv <> ''").distinct()


@query("src_s2_by_arxiv")
def src_s2_by_arxiv(spark, sf_dir):
    """Papers whose payload has their arXiv id, with ten authors at most and the number of references with an arXiv id."""
    rows = papers(spark, sf_dir).where(identity.is_arxiv_id(F.col("paper_id"))).select("ord", identity.normal_id(F.col("paper_id")).alias("arxiv"), "raw")
    parts = entities(rows, "ord", "raw", [e for e in PAPER_ENTITIES if e.kind in ("author", "reference")])
    lists = parts.groupBy("ord").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when((F.col("kind") == "author") & (F.col("pos") < 10), F.struct("pos", "item_text")))), lambda x: x["item_text"]), ";").alias("authors"), F.count_if((F.col("kind") == "reference") & identity.is_arxiv_id(F.col("item_text"))).alias("n_refs"))
    return rows.select("ord", "arxiv").join(lists, "ord", "left").fillna("", ["authors"]).fillna(0, ["n_refs"])


def _escaped(x):
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return F.regexp_replace(x, r"[^\x{20}-\x{D7FF}\x{E000}-\x{FFFD}\x{10000}-\x{10FFFF}]", " ")


@query("src_pubmed", "select cast(ord as varchar) as id, year, case when month(fetched_at) is not null then month(fetched_at)::int end as month from papers")
def src_pubmed(spark, sf_dir):
    """Papers written as XML records and read again."""
    path = shared_path(spark, "xml")
    record = F.concat(
        F.lit("<PubmedArticle><MedlineCitation><PMID>"), F.col("ord").cast("string"), F.lit("</PMID><Article><ArticleTitle>"), _escaped(F.coalesce("title", F.lit(""))), F.lit("</ArticleTitle><Journal><JournalIssue><PubDate>"),
        F.coalesce(F.concat(F.lit("<Year>"), F.col("year").cast("string"), F.lit("</Year>")), F.lit("")), F.coalesce(F.concat(F.lit("<Month>"), F.date_format("fetched_at", "MMM"), F.lit("</Month>")), F.lit("")),
        F.lit("</PubDate></JournalIssue></Journal></Article></MedlineCitation></PubmedArticle>"),
    )
    table(spark, sf_dir, "papers").select(record.alias("value")).write.text(path)
    return files.parse_articles(spark.read.text(path, lineSep="\n"), "value").select("id", "year", "month")


@query("sink_json", "select qid, question from eval_rows")
def sink_json(spark, sf_dir):
    base = shared_path(spark, "stages")
    files.write_stages({"00_questions": table(spark, sf_dir, "eval_rows").select("qid", "question")}, base)
    return spark.read.schema("qid string, question string").json(f"{base}/00_questions")


@query("flt_errclass", "select doc_id from documents where regexp_matches(lower(text), '429|rate_limit|too many requests')")
def flt_errclass(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(F.lower("text").rlike("429|rate_limit|too many requests")).select("doc_id")


@query("flt_variant_hc")
def flt_variant_hc(spark, sf_dir):
    """Each question's topic against its first answer."""
    rows = table(spark, sf_dir, "eval_rows").select("qid", understanding.topic(F.col("question")).alias("canon"), F.coalesce(F.try_element_at("answer", F.lit(1)), F.lit("")).alias("variant"))
    return rows.select("qid", variants.high_confidence("canon", "variant").alias("ok"))


@query("set_except_mod", f"select qid, cast(len({Q.dedupe("list_filter(coalesce(answer, []), lambda x: x is not null and lower(x) <> lower(answer[1]))")}) as int) as n from eval_rows")
def set_except_mod(spark, sf_dir):
    """Answers that aren't the first one, letter case aside."""
    rows = table(spark, sf_dir, "eval_rows").select("qid", F.coalesce("answer", F.array().cast("array<string>")).alias("a"))
    first = F.lower(F.try_element_at("a", F.lit(1)))
    return rows.select("qid", F.size(text.dedupe_words(F.filter(F.array_compact("a"), lambda x: F.lower(x) != first))).alias("n"))


@query("fn_rewrite_fb", f"select qid, case when len(string_split(c, ' ')) <= 2 and f <> '' then f else coalesce(c, question) end as search_text from (select qid, question, c.search_text as c, string_split({Q.templates('question')}, '|')[1] as f from eval_rows left join ({REWRITTEN}) c using (qid))")
def fn_rewrite_fb(spark, sf_dir):
    """Texts of two words or fewer fall back to the intent's template."""
    q = F.col("question")
    clean = text.rewrite(q)
    first = F.try_element_at(understanding.templates(understanding.intent(q), understanding.topic(q), q, 1), F.lit(1))
    return table(spark, sf_dir, "eval_rows").select("qid", F.when((F.size(F.split(clean, " ")) <= 2) & first.isNotNull(), first).otherwise(F.coalesce(clean, q)).alias("search_text"))


@query("fn_transform", "select venue_id, case when lower(name) = lower(short_name) then 'core' when (length(short_name) <= 6 and upper(short_name) = short_name and lower(short_name) <> short_name) or (length(name) <= 6 and upper(name) = name and lower(name) <> name and length(short_name) > length(name)) then 'abbrev' else 'synonym' end as kind from venues")
def fn_transform(spark, sf_dir):
    return table(spark, sf_dir, "venues").select("venue_id", planning.swap_kind(F.col("name"), F.col("short_name")).alias("kind"))


@query("fn_expand_norm", f"select qid, text, case when i = 1 then 'core' else 'conceptual' end as angle from (select qid, i, {Q.squeeze('answer[i]')} as text from (select qid, answer, unnest(generate_series(1, len(answer))) as i from eval_rows)) where text <> '' qualify row_number() over (partition by qid, lower(text) order by i) = 1")
def fn_expand_norm(spark, sf_dir):
    """Pairs of text and angle, the first of each text."""
    rows = table(spark, sf_dir, "eval_rows").select("qid", F.transform(F.coalesce("answer", F.array().cast("array<string>")), lambda t, i: F.struct(text.squeeze(t).alias("text"), F.when(i == 0, "core").otherwise("conceptual").alias("angle"))).alias("x"))
    return rows.select("qid", F.explode(planning.first_by_text(F.filter("x", lambda t: t["text"] != ""))).alias("t")).select("qid", "t.text", "t.angle")


def read_by_model(spark, sf_dir):
    """Questions with a model's reading."""
    rows = table(spark, sf_dir, "eval_rows").select("qid", "question")
    replies = hooks.ask(rows, "question", hooks.stub_reader).select(F.col("prompt").alias("question"), text.loose_json(F.col("reply")).alias("reading"))
    return rows.join(replies, "question", "left").select("qid", "question", "reading")


@query("udf_extract")
def udf_extract(spark, sf_dir):
    return planning.understand(read_by_model(spark, sf_dir), "reading").select("qid", "intent", "topic", F.size("terms").alias("n_terms"))


@query("fn_slots_r1")
def fn_slots_r1(spark, sf_dir):
    return planning.understand(read_by_model(spark, sf_dir), "reading").select("qid", F.explode("terms").alias("t")).select("qid", "t.text", "t.role", "t.required", "t.replaceable")


@query("fn_slots_legacy")
def fn_slots_legacy(spark, sf_dir):
    """Readings of the older form: terms with text instead of groups with canonical."""
    rows = table(spark, sf_dir, "eval_rows")
    old = F.to_json(F.struct(understanding.intent(F.col("question")).alias("intent"), F.array(F.struct(F.col("question").alias("text"), F.lit("topic").alias("role"), F.array(F.lower("question")).alias("synonyms"))).alias("terms")))
    return planning.understand(rows.select("qid", "question", old.alias("r")), "r").select("qid", "topic", F.size("terms").alias("n_terms"))


@query("udf_semantic")
def udf_semantic(spark, sf_dir):
    """Phrasings by a model that are neither asked already nor close to what is; two of a question at most."""
    rows = table(spark, sf_dir, "eval_rows").select("qid", "question")
    replies = hooks.ask(rows, "question", hooks.stub_rephraser)
    proposed = rows.join(replies, rows.question == replies.prompt).select("qid", "question", F.posexplode(F.from_json(text.loose_json(F.col("reply"), "[", "]"), "array<string>")).alias("place", "text"))
    far = proposed.where(~text.similar(F.col("question"), F.col("text")))
    return R.new_queries(far.select("qid", "place", "text"), sub_queries(spark, sf_dir).select("qid", "text"), 2)


@query("udf_expand")
def udf_expand(spark, sf_dir):
    """Free expansion by a model: all new phrasings, three of a question at most."""
    rows = table(spark, sf_dir, "eval_rows").select("qid", "question")
    replies = hooks.ask(rows, "question", hooks.stub_rephraser)
    proposed = rows.join(replies, rows.question == replies.prompt).select("qid", F.posexplode(F.from_json(text.loose_json(F.col("reply"), "[", "]"), "array<string>")).alias("place", "text"))
    return R.new_queries(proposed, rows.select("qid", F.col("question").alias("text")))


@query("udf_judge_expanded")
def udf_judge_expanded(spark, sf_dir):
    """The first ten candidates by arrival with a score above 0, judged."""
    rows = ranking.score_rules(candidates(spark, sf_dir)).where("keyword_coverage > 0")
    arrival = rows.withColumn("first", -F.col("cord").cast("double") + F.lit(1e15))
    return hooks.judge(arrival, top_k=10, score="first").select("qid", "paper_id", round4(F.col("llm")).alias("llm"))


_RANKED = f"{FILTERED}, top as (select qid, paper_id, normalized, cast(row_number() over (partition by qid order by {ORDER}) as int) as sel_rank from n where normalized >= 0 and {Q.is_arxiv('paper_id')} qualify sel_rank <= 20)"


@query("op_eval", f"""{_RANKED}, p as (select distinct qid, {Q.normal_id('paper_id')} as nid from top), g as (select distinct qid, {Q.normal_id('gold')} as nid from (select qid, unnest(answer_arxiv_id) as gold from eval_rows) where gold is not null and {Q.normal_id('gold')} <> ''),
 c as (select e.qid, (select count(*) from p where p.qid = e.qid) as np, (select count(*) from g where g.qid = e.qid) as ng, (select count(*) from p join g using (qid, nid) where qid = e.qid) as nh from (select distinct qid from eval_rows where qid is not null) e)
 select count(*) as n, {Q.round4('avg(case when nh > 0 then nh / np::double else 0.0::double end)')} as macro_p, {Q.round4('avg(case when nh > 0 then nh / ng::double else 0.0::double end)')} as macro_r from c""")
def op_eval(spark, sf_dir):
    """All questions in one job: filter, rank, compare with gold, average."""
    rows = table(spark, sf_dir, "eval_rows")
    predicted = ranking.rank(filtered(spark, sf_dir), arxiv_only=True).select("qid", "paper_id")
    scores = evaluate.samples(rows, predicted, evaluate.gold(rows))
    return evaluate.macro(scores).select("n", round4(F.col("macro_p")).alias("macro_p"), round4(F.col("macro_r")).alias("macro_r"))


@query("op_run")
def op_run(spark, sf_dir):
    """The whole run: one row per question with its tiers and its funnel."""
    full = filtered(spark, sf_dir)
    top = ranking.rank(full)
    features = F.create_map(*[x for k, c in (("relevance", "relevance"), ("citation", "citation"), ("recency", "recency"), ("venue", "venue_score"), ("title", "title_density")) for x in (F.lit(k), F.col(c))])
    tiered = organize.with_tiers(top.select("qid", "paper_id", "title", "intent", "sel_rank", F.col("normalized").alias("score"), features.alias("features")))
    lists = organize.groups(tiered).groupBy("qid").agg(F.to_json(F.array_sort(F.collect_list(F.struct("tier", "n", "paper_ids")))).alias("groups"))
    return lists.join(organize.funnel(full, full.where("passed"), tiered), "qid")

