"""Requests to providers, candidates out of their hits, and the refinement loop."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperloom.functions import identity, text
from paperloom.operators.dedup import first_by_key
from paperloom.session import materialize

# Sources in their order; worth of a sub-query by angle, mode and channel.
SOURCES = ("arxiv", "openalex", "semantic")
ANGLES, OTHER_ANGLE = {"core": 100, "synonym": 80, "abbrev": 70, "entity": 60, "conceptual": 50, "metadata": 30, "raw": 10}, 40
MODES = {"semantic": 1000, "decomposition": 50}


def _filled(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


def request_text(query: Column, method: Column) -> Column:
    """The query with the method, unless it names it."""
    q, m = text.strip(_filled(query)), text.strip(_filled(method))
    return F.when((m != "") & ~F.contains(F.lower(q), F.lower(m)), F.concat(q, F.lit(" "), m)).otherwise(q)


def openalex_years(first: Column, last: Column) -> Column:
    s = lambda x: x.cast("string")
    low, high = F.concat(F.lit("publication_year:>"), s(first - 1)), F.concat(F.lit("publication_year:<"), s(last + 1))
    return F.when(first == last, F.array(F.concat(F.lit("publication_year:"), s(first)))).otherwise(F.array_compact(F.array(low, high)))


def arxiv_years(first: Column, last: Column) -> Column:
    """Closed range of submission times, '' if open on both sides."""
    start = F.coalesce(F.concat(first.cast("string"), F.lit("0101000000")), F.lit("19910701000000"))
    end = F.coalesce(F.concat(last.cast("string"), F.lit("1231235959")), F.lit("20991231235959"))
    return F.when(first.isNull() & last.isNull(), "").otherwise(F.concat(F.lit("submittedDate:["), start, F.lit(" TO "), end, F.lit("]")))


def s2_years(first: Column, last: Column) -> Column:
    """`a-b` with either side open, null if both are."""
    return F.when(first.isNotNull() | last.isNotNull(), F.concat(_filled(first.cast("string")), F.lit("-"), _filled(last.cast("string"))))


def openalex_request(query: Column, method: Column, first: Column, last: Column, venue: Column, limit: int = 10, open_access: bool = False) -> Column:
    words = text.keywordize(request_text(query, method))
    parts = F.array(F.when(words != "", F.concat(F.lit("title_and_abstract.search:"), words)), *[F.get(openalex_years(first, last), i) for i in (0, 1)], F.when(_filled(venue) != "", F.concat(F.lit("primary_location.source.display_name.search:"), venue)), F.lit("open_access.is_oa:true" if open_access else None).cast("string"))
    return F.struct(F.array_join(F.array_compact(parts), ",").alias("filter"), F.lit("cited_by_count:desc").alias("sort"), F.lit(max(1, min(limit, 50))).alias("per_page"), words.alias("text_used"))


def arxiv_request(query: Column, method: Column, first: Column, last: Column, limit: int = 10) -> Column:
    words = text.keywordize(request_text(query, method), text.REQUEST_STOP_WORDS_LONG)
    terms = F.slice(F.filter(F.split(words, " "), lambda w: w != ""), 1, 8)
    body = F.when(F.size(terms) > 0, F.array_join(F.transform(terms, lambda w: F.concat(F.lit("all:"), w)), " AND ")).otherwise("all:paper")
    years = arxiv_years(first, last)
    return F.struct(F.when(years != "", F.concat(F.lit("("), body, F.lit(") AND "), years)).otherwise(body).alias("query"), F.lit(max(1, min(limit, 50))).alias("max_results"), words.alias("text_used"))


def s2_request(query: Column, method: Column, first: Column, last: Column, venue: Column, limit: int = 10) -> Column:
    words = F.left(text.squeeze(request_text(query, method)), F.lit(300))
    return F.struct(words.alias("query"), F.lit(max(1, min(limit, 100))).alias("limit"), s2_years(first, last).alias("year"), F.nullif(venue, F.lit("")).alias("venue"))


def abstract_of(index: Column) -> Column:
    """An abstract out of its inverted index (map of word to places): words by place; of two words in one place the later stays."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    ordered = F.array_sort(F.filter(F.transform(pairs, lambda x, i: F.struct(x["p"].alias("p"), i.alias("i"), x["w"].alias("w"))), lambda x: x["p"] >= 0))
    last = F.filter(ordered, lambda x, i: F.coalesce(F.get(ordered, i + 1)["p"] != x["p"], F.lit(True)))
    return _filled(F.array_join(F.filter(F.transform(last, lambda x: x["w"]), lambda w: w != ""), " "))


def index_of(words: Column) -> Column:
    """The inverted index of an array of words."""
    return F.map_from_entries(F.transform(F.array_distinct(words), lambda w: F.struct(w, F.filter(F.transform(words, lambda x, i: F.when(x == w, i)), lambda i: i.isNotNull()))))


def paper_of(paper_id: Column, j: Column) -> Column:
    """A provider's payload as a paper: struct<paper_id, title, year>; null if id and title are both empty."""
    ident = F.coalesce(identity.arxiv_id(F.lit(None).cast("string"), j), F.nullif(F.regexp_extract(F.rtrim(_filled(identity.member(j, "id")), F.lit("/")), r"([^/]*)$", 1), F.lit("")), identity.member(j, "paperId"), identity.member(j, "arxivId"), F.split_part(F.regexp_extract(_filled(identity.member(j, "entry_id")), r"([^/]*)$", 1), F.lit("v"), F.lit(1)))
    title = text.squeeze(F.coalesce(identity.member(j, "title"), identity.member(j, "display_name")))
    years = [identity.member(j, k) for k in ("publication_year", "year")] + [F.left(identity.member(j, "published"), F.lit(4))]
    year = F.coalesce(*[F.when(y.rlike("^[0-9]+$"), y.try_cast("int")) for y in years])
    return F.when((_filled(ident) != "") | (title != ""), F.struct(_filled(ident).alias("paper_id"), title.alias("title"), year.alias("year")))


def arxiv_id_in_work(j: Column) -> Column:
    """The first arXiv id in a work's addresses: open access, locations in order, ids; '' if none."""
    pattern = r"(?i)(?:arxiv\.org/(?:abs|pdf)/|arxiv[:\s])(\d{4}\.\d{4,5})(?:v\d+)?"
    tail = r"(?i)arxiv.*?/(\d{4}\.\d{4,5})(?:v[^/]*)?/?$"
    locations = F.from_json(F.try_variant_get(j, "$.locations", "string"), "array<struct<landing_page_url:string,pdf_url:string>>")
    listed = F.flatten(F.transform(locations, lambda x: F.array(x["landing_page_url"], x["pdf_url"])))
    found = F.concat(F.array(identity.member(j, "open_access.oa_url"), identity.member(j, "primary_location.landing_page_url"), identity.member(j, "primary_location.pdf_url")), F.coalesce(listed, F.array().cast("array<string>")), F.array(*[identity.member(j, f"ids.{k}") for k in ("openalex", "doi", "arxiv", "mag", "pmid")]))
    ids = F.transform(F.array_compact(found), lambda u: F.coalesce(F.nullif(F.regexp_extract(u, pattern, 1), F.lit("")), F.nullif(F.regexp_extract(u, tail, 1), F.lit(""))))
    return _filled(F.try_element_at(F.array_compact(ids), F.lit(1)))


def priority(angle: Column, mode: Column, channel: Column) -> Column:
    """What a sub-query is worth to a source with a budget."""

    def of(x: Column, table: dict[str, int], default: int) -> Column:
        out = F.lit(default)
        for k, v in table.items():
            out = F.when(x == k, F.lit(v)).otherwise(out)
        return out

    return of(_filled(angle), ANGLES, OTHER_ANGLE) + of(_filled(mode), MODES, 0) + F.when(_filled(channel) == "semantic", 1000).otherwise(0)


def budgeted(sub_queries: DataFrame, most: int = 2) -> DataFrame:
    """sub_queries with eligible: those of semantic channel or mode always, even beyond the budget; the rest by priority, earlier ones first. None if most <= 0."""
    always = (_filled(F.col("channel")) == "semantic") | (_filled(F.col("mode")) == "semantic")
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(always.desc(), priority(F.col("angle"), F.col("mode"), F.col("channel")).desc(), "sq_ord"))
    return sub_queries.withColumn("always", always).withColumn("place", rank).withColumn("eligible", F.lit(most > 0) & (F.col("always") | (F.col("place") <= most))).drop("always", "place")


def trace(sub_queries: DataFrame, hits: DataFrame | None = None, sources: tuple[str, ...] = SOURCES, most: int = 2) -> DataFrame:
    """qid, sqid, sq_ord, source, src_ord, status, n_hits: one row for each sub-query and source.

    skipped: unknown source, or a semantic call outside the budget. dry_run without hits;
    else ok, or empty_or_error.
    """
    order = F.explode(F.array(*[F.struct(F.lit(s).alias("source"), F.lit(i).alias("src_ord")) for i, s in enumerate(sources)]))
    calls = budgeted(sub_queries, most).select("qid", "sqid", "sq_ord", "eligible", order.alias("s")).select("qid", "sqid", "sq_ord", "eligible", "s.source", "s.src_ord")
    skipped = ~F.col("source").isin(*SOURCES) | ((F.col("source") == "semantic") & ~F.col("eligible"))
    if hits is None:
        return calls.withColumn("status", F.when(skipped, "skipped").otherwise("dry_run")).withColumn("n_hits", F.lit(0).cast("bigint")).drop("eligible")
    n = hits.groupBy("qid", "sqid", "source").agg(F.count("*").alias("n"))
    out = calls.join(n, ["qid", "sqid", "source"], "left").withColumn("n_hits", F.when(skipped, 0).otherwise(F.coalesce("n", F.lit(0))).cast("bigint"))
    return out.withColumn("status", F.when(skipped, "skipped").when(F.col("n_hits") > 0, "ok").otherwise("empty_or_error")).drop("eligible", "n")


def retrieve(calls: DataFrame, hits: DataFrame) -> DataFrame:
    """qid, key, cord, …: candidates of each question in order of sub-query, source and hit, the first of each key.

    hits: qid, sqid, source, hit_rank, key and any other columns; calls: trace().
    """
    used = hits.join(calls.where("status = 'ok'").select("qid", "sqid", "source", "sq_ord", "src_ord"), ["qid", "sqid", "source"])
    # room for 10 ** 10 hits of a call and 100 sources
    place = (F.col("sq_ord").cast("bigint") * 100 + F.col("src_ord")) * 10**10 + F.col("hit_rank")
    return first_by_key(used.withColumn("cord", place.cast("bigint")).drop("sq_ord", "src_ord", "hit_rank", "sqid"), ["qid", "key"], "cord")


def call_stats(calls: DataFrame) -> DataFrame:
    """qid, n_calls, n_hits, n_errors: calls that were made, hits, and calls without any."""
    made = ~F.col("status").isin("skipped", "dry_run")
    return calls.groupBy("qid").agg(F.count_if(made).alias("n_calls"), F.sum("n_hits").alias("n_hits"), F.count_if(F.col("status") == "empty_or_error").alias("n_errors"))


def new_queries(proposed: DataFrame, previous: DataFrame, most: int = 3) -> DataFrame:
    """qid, place, text: proposed texts (qid, place, text) that weren't asked before, letter case aside, once each, `most` of a question."""
    fresh = proposed.withColumn("low", F.lower(text.squeeze(F.col("text")))).where("low <> ''").join(previous.select("qid", F.lower(text.squeeze(F.col("text"))).alias("low")).distinct(), ["qid", "low"], "left_anti")
    once = first_by_key(fresh, ["qid", "low"], "place")
    return once.withColumn("k", F.row_number().over(Window.partitionBy("qid").orderBy("place"))).where(F.col("k") <= most).select("qid", "place", "text")


def merge(pool: DataFrame, extra: DataFrame) -> DataFrame:
    """The pool and those of extra (qid, key, …, same columns) it doesn't hold."""
    return pool.unionByName(extra.join(pool.select("qid", "key").distinct(), ["qid", "key"], "left_anti"))


def iterate(pool: DataFrame, refine: Callable[[DataFrame, int], DataFrame], questions: DataFrame, least: int = 40, most: int = 200, rounds: int = 1) -> tuple[DataFrame, DataFrame]:
    """(pool, log): the refinement loop over all questions at once.

    Each round, questions with fewer than `least` candidates are to be broadened, those with
    more than `most` narrowed; refine(asked, round) gives their new candidates (qid, key, …
    as pool) for asked (qid, direction, n). A question stops when it is within bounds or
    gains nothing. Rounds are few and each is written to the shared folder, so neither the
    plan nor a lost executor costs more than one round. log: qid, round, direction, n_before, n_added.
    """
    log = None
    open_questions = questions.select("qid").distinct()
    for k in range(rounds):
        n = pool.groupBy("qid").agg(F.count("*").alias("n"))
        asked = open_questions.join(n, "qid", "left").fillna(0, ["n"]).withColumn("direction", F.when(F.col("n") < least, "broaden").when(F.col("n") > most, "narrow")).where("direction is not null")
        asked = materialize(asked.select("qid", "direction", "n"), "asked")
        gained = materialize(first_by_key(refine(asked, k).join(asked.select("qid"), "qid", "left_semi"), ["qid", "key"], "cord").join(pool.select("qid", "key"), ["qid", "key"], "left_anti").select(*pool.columns), "gained")
        pool = pool.unionByName(gained)
        added = asked.join(gained.groupBy("qid").agg(F.count("*").alias("n_added")), "qid", "left").fillna(0, ["n_added"])
        line = added.select("qid", F.lit(k + 1).alias("round"), "direction", F.col("n").alias("n_before"), "n_added")
        log = line if log is None else log.unionByName(line)
        open_questions = added.where("n_added > 0").select("qid")
    if log is None:
        log = questions.select("qid", F.lit(0).alias("round"), F.lit("").alias("direction"), F.lit(0).cast("bigint").alias("n_before"), F.lit(0).cast("bigint").alias("n_added")).where("false")
    return pool, log
