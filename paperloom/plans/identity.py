"""Queries of identity and text functions over the whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions import identity as I
from paperloom.functions import text as T
from paperloom.functions import understanding as U
from paperloom.operators import dedup
from paperloom.operators.pool import with_payload
from paperloom.plans import sqltext as Q
from paperloom.plans.registry import Registry
from paperloom.session import table

query = Registry()
PJ = f"with {Q.PAPERS} "


def papers(spark, sf_dir):
    return with_payload(table(spark, sf_dir, "papers"))


def _shown(tokens):
    return F.array_join(F.array_sort(tokens), " ")


@query("fn_tokens", f"select ord, {Q.shown(Q.tokens('title'))} as title_tokens, len({Q.tokens('abstract')}) as n_abstract from papers")
def fn_tokens(spark, sf_dir):
    return table(spark, sf_dir, "papers").select("ord", _shown(T.tokens(F.col("title"))).alias("title_tokens"), F.size(T.tokens(F.col("abstract"))).cast("bigint").alias("n_abstract"))


@query("fn_norm_title", f"select ord, {Q.fingerprint('title')} as norm_title from papers")
def fn_norm_title(spark, sf_dir):
    return table(spark, sf_dir, "papers").select("ord", T.title_fingerprint(F.col("title")).alias("norm_title"))


@query("fn_letters", "select ord, lower(regexp_replace(coalesce(title, ''), '[^\\p{L}]', '', 'g')) as letters from papers")
def fn_letters(spark, sf_dir):
    return table(spark, sf_dir, "papers").select("ord", T.letters(F.col("title")).alias("letters"))


@query("fn_md5", "select doc_id, md5(text) as digest from documents")
def fn_md5(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("digest"))


@query("fn_key_arxiv", f"{PJ} select ord, {Q.arxiv()} as arxiv from papers_j")
def fn_key_arxiv(spark, sf_dir):
    return papers(spark, sf_dir).select("ord", I.arxiv_id(F.col("paper_id"), F.col("j")).alias("arxiv"))


@query("fn_key_doi", f"{PJ} select ord, {Q.doi()} as doi from papers_j")
def fn_key_doi(spark, sf_dir):
    return papers(spark, sf_dir).select("ord", I.doi(F.col("j")).alias("doi"))


@query("fn_key", f"{PJ} select ord, {Q.key()} as ckey from papers_j")
def fn_key(spark, sf_dir):
    return papers(spark, sf_dir).select("ord", I.canonical_key(F.col("paper_id"), F.col("title"), F.col("j"), F.col("ord")).alias("ckey"))


@query("win_dedup", f"{PJ} select ord, ckey from (select ord, {Q.key()} as ckey from papers_j) qualify row_number() over (partition by ckey order by ord) = 1")
def win_dedup(spark, sf_dir):
    return dedup.first_by_key(papers(spark, sf_dir).select("ord", I.canonical_key(F.col("paper_id"), F.col("title"), F.col("j"), F.col("ord")).alias("ckey")), ["ckey"], "ord")


@query("fn_norm_id", f"select ord, {Q.normal_id('paper_id')} as norm_id from papers")
def fn_norm_id(spark, sf_dir):
    return table(spark, sf_dir, "papers").select("ord", I.normal_id(F.col("paper_id")).alias("norm_id"))


@query("flt_arxiv", f"select ord, paper_id from papers where {Q.is_arxiv('paper_id')}")
def flt_arxiv(spark, sf_dir):
    return table(spark, sf_dir, "papers").where(I.is_arxiv_id(F.col("paper_id"))).select("ord", "paper_id")


@query("fn_oa_id", f"{PJ} select ord, {Q.openalex()} as oa_id, coalesce({Q.openalex()}, 'https://doi.org/' || {Q.doi()}, 'arxiv:' || {Q.arxiv()}) as lookup_key from papers_j")
def fn_oa_id(spark, sf_dir):
    return papers(spark, sf_dir).select("ord", I.openalex_id(F.col("paper_id"), F.col("j")).alias("oa_id"), I.lookup_key(F.col("paper_id"), F.col("j")).alias("lookup_key"))


_OUTER = f"nullif(split_part(regexp_extract(coalesce(nullif({Q.member('externalIds.ArXiv')}, ''), {Q.member('externalIds.arXiv')}), '([^/]*)$', 1), 'v', 1), '')"
_OWN = Q.strip(Q.member("paperId"))
_S2 = f"""coalesce(case when {_OWN} <> '' and not {Q.is_arxiv(_OWN)} and (length({_OWN}) >= 20 or regexp_matches({_OWN}, '^[\\p{{L}}\\p{{N}}]+$')) then {_OWN} end,
 'CorpusId:' || nullif({Q.strip(Q.member('externalIds.CorpusId'))}, ''), 'ARXIV:' || {_OUTER}, 'DOI:' || nullif({Q.strip(f"coalesce(nullif({Q.member('externalIds.DOI')}, ''), {Q.member('externalIds.doi')})")}, ''),
 'ARXIV:' || {Q.arxiv()}, 'DOI:' || {Q.doi()}, {Q.strip("coalesce(paper_id, '')")})"""


@query("fn_s2_id", f"{PJ} select ord, {_S2} as s2_id from papers_j")
def fn_s2_id(spark, sf_dir):
    return papers(spark, sf_dir).select("ord", I.s2_query_id(F.col("paper_id"), F.col("j")).alias("s2_id"))


_BASE = [
    "paper_id", "arxiv", "'arxiv:' || arxiv", "doi", "'doi:' || doi", "oa", "'https://openalex.org/' || oa", Q.member("paperId"), *[Q.member(f"externalIds.{k}") for k in ("CorpusId", "DOI", "ArXiv", "arXiv", "ACL", "PubMed")],
    f"'CorpusId:' || {Q.member('externalIds.CorpusId')}", *[Q.member(f"ids.{k}") for k in ("doi", "arxiv", "openalex", "mag")], f"upper({Q.first(I.OPENALEX, Q.member('ids.openalex'))})",
]
_FORMS = "[" + ", ".join([Q.normal("v"), *[f"case when starts_with(lower(v), {Q.quote(p)}) then {Q.normal(f'substr(v, {len(p) + 1})')} end" for p in I.PREFIXES]]) + "]"
ALIASES = f"""aliased as (select ord, paper_id, list_distinct(list_filter(flatten(list_transform(list_filter([{', '.join(_BASE)}], lambda v: v is not null), lambda w: list_transform([{Q.strip('w')}], lambda v: {_FORMS})[1])), lambda v: v is not null and v <> '')) as al
 from (select *, {Q.arxiv()} as arxiv, {Q.doi()} as doi, {Q.openalex()} as oa from papers_j))"""


@query("fn_alias", f"{PJ}, {ALIASES} select ord, {Q.shown('al')} as aliases from aliased")
def fn_alias(spark, sf_dir):
    return papers(spark, sf_dir).select("ord", _shown(I.aliases(F.col("paper_id"), F.col("j"))).alias("aliases"))


_WEB = [f"case when starts_with({m}, 'http') then {m} end" for k in ("url", "openAccessPdf", "landing_page_url", "doi_url") for m in (Q.member(k), Q.member(k + ".url"))]
_D = f"nullif({Q.strip(Q.member('doi'))}, '')"


@query("fn_url", f"{PJ} select ord, coalesce({', '.join(_WEB)}, case when starts_with({_D}, 'http') then {_D} else 'https://doi.org/' || {_D} end, case when {Q.is_arxiv('paper_id')} then 'https://arxiv.org/abs/' || paper_id end, '') as url from papers_j")
def fn_url(spark, sf_dir):
    return papers(spark, sf_dir).select("ord", I.url(F.col("paper_id"), F.col("j")).alias("url"))


@query("fn_cit_count", f"{PJ} select ord, case when n is null then null else greatest(n, 0) end as count_or_null, greatest(coalesce(n, 0), 0) as count from (select ord, coalesce({', '.join(f'''case when regexp_matches({Q.member(k)}, '^-?[0-9]+$') then try_cast({Q.member(k)} as bigint) end''' for k in I.COUNT_KEYS)}) as n from papers_j)")
def fn_cit_count(spark, sf_dir):
    n = I.citation_count(F.col("j"))
    return papers(spark, sf_dir).select("ord", n.alias("count_or_null"), F.coalesce(n, F.lit(0)).alias("count"))


@query("fn_venue_name", f"{PJ} select ord, {Q.venue()} as venue from papers_j")
def fn_venue_name(spark, sf_dir):
    return papers(spark, sf_dir).select("ord", I.venue(F.col("j")).alias("venue"))


_SENT = "regexp_extract(w, '(?s)^(.*([。；;]|[.!?](\\s|$)))', 1)"
_SPACED = "regexp_extract(w, '(?s)^(.*) ', 1)"


@query("fn_snippet", f"""with x as (select ord, {Q.squeeze('abstract')} as t from papers), y as (select ord, t, left(t, 240) as w from x)
 select ord, case when length(t) <= 240 then t else case when {_SENT} <> '' then rtrim({_SENT}) when length({_SPACED}) >= 120 then rtrim({_SPACED}) else rtrim(w) end || '…' end as snippet from y""")
def fn_snippet(spark, sf_dir):
    return table(spark, sf_dir, "papers").select("ord", T.snippet(F.col("abstract")).alias("snippet"))


_YF, _YT = Q.years("question")


@query("fn_years", f"select qid, {_YF} as year_from, {_YT} as year_to from eval_rows")
def fn_years(spark, sf_dir):
    first, last = U.years(F.col("question"))
    return table(spark, sf_dir, "eval_rows").select("qid", first.alias("year_from"), last.alias("year_to"))


@query("fn_intent", f"select qid, {Q.intent('question')} as intent from eval_rows")
def fn_intent(spark, sf_dir):
    return table(spark, sf_dir, "eval_rows").select("qid", U.intent(F.col("question")).alias("intent"))


@query("fn_negations", f"select qid, array_to_string({Q.negations('question')}, '|') as negations from eval_rows")
def fn_negations(spark, sf_dir):
    return table(spark, sf_dir, "eval_rows").select("qid", F.array_join(U.negations(F.col("question")), "|").alias("negations"))


_STEPS = [f"s0 as (select qid, {Q.squeeze('question')} as t from eval_rows)"] + [f"s{i + 1} as (select qid, trim(regexp_replace(t, {Q.quote(o)}, '', 'i')) as t from s{i})" for i, o in enumerate(T.OPENINGS)]
_N = len(T.OPENINGS)


REWRITTEN = f"""with {', '.join(_STEPS)}, a as (select qid, trim(regexp_replace(t, '[?？!！.]+$', '')) as t from s{_N}),
 b as (select qid, case when len(string_split(t, ' ')) > 24 then trim(regexp_replace(array_to_string(string_split(t, ' ')[1:24], ' '), {Q.quote(T.LEADING)}, '', 'i')) else t end as t from a)
 select qid, case when t <> '' and len(string_split(t, ' ')) >= 2 then lower(t) end as search_text from b"""


@query("fn_rewrite", REWRITTEN)
def fn_rewrite(spark, sf_dir):
    return table(spark, sf_dir, "eval_rows").select("qid", T.rewrite(F.col("question")).alias("search_text"))


def _keywordize(x: str, stop: list[str]) -> str:
    kept = f"list_filter(regexp_extract_all({Q.squeeze(x)}, '[A-Za-z0-9\\-]+'), lambda t: length(t) > 1 and lower(t) not in {Q.words(stop)})"
    return f"left(case when len({kept}) > 0 then array_to_string({kept}[1:12], ' ') else {Q.squeeze(x)} end, 200)"


@query("req_keywords_oa", f"select qid, {_keywordize('question', T.REQUEST_STOP_WORDS)} as keywords from eval_rows")
def req_keywords_oa(spark, sf_dir):
    return table(spark, sf_dir, "eval_rows").select("qid", T.keywordize(F.col("question")).alias("keywords"))


@query("req_keywords_ax", f"select qid, {_keywordize('question', T.REQUEST_STOP_WORDS_LONG)} as keywords from eval_rows")
def req_keywords_ax(spark, sf_dir):
    return table(spark, sf_dir, "eval_rows").select("qid", T.keywordize(F.col("question"), T.REQUEST_STOP_WORDS_LONG).alias("keywords"))


_TSQ = Q.squeeze("title")
_W = f"string_split({_TSQ}, ' ')"


@query("flt_title_like", f"""select ord from papers where {_TSQ} <> '' and not contains({_TSQ}, '?') and not regexp_matches(lower({_TSQ}), '^(list|find|show|papers|search|get|what|how) ') and len({_W}) >= 3
 and len(list_filter({_W}, lambda w: regexp_matches(w, '^[A-Z]'))) >= greatest(3, (len({_W}) + 1) // 2)""")
def flt_title_like(spark, sf_dir):
    return table(spark, sf_dir, "papers").where(T.looks_like_title(F.col("title"))).select("ord")


@query("flt_claim_like", "select doc_id from documents where " + " or ".join(f"contains(' ' || lower(coalesce(text, '')) || ' ', {Q.quote(m)})" for m in T.CLAIM_MARKS))
def flt_claim_like(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(T.looks_like_claim(F.col("text"))).select("doc_id")


_X, _Y = f"list_distinct(string_split({Q.normal('question')}, ' '))", f"list_distinct(string_split({Q.normal('answer[1]')}, ' '))"


@query("flt_similar", f"select qid, len(list_intersect({_X}, {_Y})) / greatest(len({_X}), len({_Y}))::double >= 0.25 as similar from eval_rows")
def flt_similar(spark, sf_dir):
    return table(spark, sf_dir, "eval_rows").select("qid", T.similar(F.col("question"), F.try_element_at("answer", F.lit(1)), 0.25).alias("similar"))


@query("set_dedupe_list", f"select qid, array_to_string({Q.dedupe('coalesce(answer_arxiv_id, [])')}, '|') as ids from eval_rows")
def set_dedupe_list(spark, sf_dir):
    return table(spark, sf_dir, "eval_rows").select("qid", F.array_join(T.dedupe_words(F.coalesce(F.col("answer_arxiv_id"), F.array())), "|").alias("ids"))


@query("fn_topic", f"select qid, {Q.topic('question')} as topic from eval_rows")
def fn_topic(spark, sf_dir):
    return table(spark, sf_dir, "eval_rows").select("qid", U.topic(F.col("question")).alias("topic"))


@query("fn_claim", f"select qid, {Q.claim('question')} as claim from eval_rows")
def fn_claim(spark, sf_dir):
    return table(spark, sf_dir, "eval_rows").select("qid", U.claim(F.col("question")).alias("claim"))


@query("fn_templates", f"select qid, {Q.templates('question')} as templates from eval_rows")
def fn_templates(spark, sf_dir):
    q = F.col("question")
    return table(spark, sf_dir, "eval_rows").select("qid", F.array_join(U.templates(U.intent(q), U.topic(q), q), "|").alias("templates"))


@query("fn_json_loose", """with r as (select ord, '```json' || chr(10) || coalesce(raw, '') || chr(10) || '```' as reply from papers), b as (select ord, trim(regexp_extract(reply, '(?s)```(?:json)?(.*?)(?:```|$)', 1), ' ') as body from r),
 c as (select ord, body, regexp_extract(body, '(?s)(\\{.*\\})', 1) as braces from b) select ord, coalesce(json_valid(body) and body <> '', false) or coalesce(json_valid(braces) and braces <> '', false) as parsed from c""")
def fn_json_loose(spark, sf_dir):
    reply = F.concat(F.lit("```json\n"), F.coalesce("raw", F.lit("")), F.lit("\n```"))
    return table(spark, sf_dir, "papers").select("ord", T.loose_json(reply).isNotNull().alias("parsed"))
