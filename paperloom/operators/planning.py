"""From a question, or a model's reading of it, to the search texts it is turned into.

Slots, terms, skeletons and tasks are structs and arrays of one row per question, folded by
higher-order functions: the arrays are short, so nothing is exploded before the sub-queries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions import text, understanding, variants
from paperloom.session import materialize

TERM = "struct<text:string,role:string,abbrev:string,synonyms:array<string>,instances:array<string>,gap:boolean,required:boolean,replaceable:boolean>"
PART = "struct<id:string,text:string,required:boolean,replaceable:boolean,variants:array<string>>"
TASK = "struct<mode:string,transform:string,source:string,text:string,part:string>"
_RAW_TERM = "array<struct<text:string,canonical:string,role:string,abbrev:string,synonyms:array<string>,variants:array<string>,instances:array<string>,coverage_gap_likely:string,required:string,replaceable:string>>"
_RAW_PART = "array<struct<id:string,text:string,required:string,replaceable:string,variants:array<string>>>"
# Roles of terms; weights and wordings of criteria; ranks of tasks.
ROLES = ("topic", "method", "dataset", "entity", "domain", "other")
CRITERIA = {"topic": (0.4, "Paper is about: "), "method": (0.35, "Involves method/technique: "), "entity": (0.25, "Involves entity/concept: "), "claim": (0.2, "Addresses claim/comparison: "), "negation": (0.0, "Must NOT be primarily about: ")}
TASK_ORDER = ("core", None, "conceptual", "metadata", "raw")


def _given(x: Column) -> Column:
    """A member of a model's reply: null for '' and 'null'."""
    t = text.squeeze(x)
    return F.when(x.isNotNull() & ~t.isin("", "null"), t)


def _listed(json: Column) -> Column:
    """JSON text of an array; a lone object counts as an array of one."""
    return F.when(json.startswith("{"), F.concat(F.lit("["), json, F.lit("]"))).otherwise(json)


def _none(kind: str = "array<string>") -> Column:
    return F.array().cast(kind)


def first_by_text(items: Column, of: str = "text") -> Column:
    """Items of an array of structs, the first of each text, letter case aside."""
    keys = F.transform(items, lambda t: F.lower(t[of]))
    return F.filter(items, lambda t, i: F.array_position(keys, F.lower(t[of])) == i + 1)


def terms_of(json: Column) -> Column:
    """Terms of a model's reply in one form: variants join the synonyms, absent flags get defaults, one term for each text. Null for no terms."""

    def term(t: Column) -> Column:
        name = F.coalesce(_given(t["text"]), _given(t["canonical"]), F.lit(""))
        others = F.concat(F.coalesce(t["synonyms"], _none()), F.filter(F.coalesce(t["variants"], _none()), lambda v: F.lower(text.squeeze(v)) != F.lower(name)))
        synonyms, role, abbrev = text.dedupe_words(F.array_compact(others)), F.lower(_given(t["role"])), _given(t["abbrev"])
        instances = text.dedupe_words(F.array_compact(F.coalesce(t["instances"], _none())))
        flag = lambda f: _given(t[f]).try_cast("boolean")
        varied = abbrev.isNotNull() | (F.size(synonyms) > 0) | (F.size(instances) > 0)
        return F.struct(
            name.alias("text"), F.when(role.isNotNull(), F.when(role.isin(*ROLES), role).otherwise("other")).alias("role"), abbrev.alias("abbrev"), synonyms.alias("synonyms"), instances.alias("instances"),
            flag("coverage_gap_likely").alias("gap"), F.coalesce(flag("required"), F.lit(True)).alias("required"), F.coalesce(flag("replaceable"), varied).alias("replaceable"),
        )

    found = F.transform(F.from_json(_listed(json), _RAW_TERM), term)
    kept = first_by_text(F.filter(found, lambda t: t["text"] != ""))
    return F.when(F.size(kept) > 0, kept)


def term_forms(t: Column) -> Column:
    """A term's text, abbreviation and synonyms."""
    return text.dedupe_words(F.concat(F.array_compact(F.array(t["text"], t["abbrev"])), F.coalesce(t["synonyms"], _none())))


def without_overlaps(core: Column, parts: Column) -> Column:
    """Parts that occur in the core text, once each, the longer first where two overlap; in their order."""
    low = F.lower(core)
    placed = F.transform(first_by_text(parts), lambda p, i: F.struct((-F.length(p["text"])).alias("size"), i.alias("i"), F.instr(low, F.lower(p["text"])).alias("at"), p.alias("p")))
    inside = F.array_sort(F.filter(placed, lambda x: (x["at"] > 0) | (core == "")))

    def keep(acc: Column, x: Column) -> Column:
        clash = F.exists(acc, lambda k: (x["at"] < k["at"] - k["size"]) & (k["at"] < x["at"] - x["size"]))
        return F.when((core != "") & clash, acc).otherwise(F.array_append(acc, x))

    kept = F.aggregate(inside, F.filter(inside, lambda x: F.lit(False)), keep)
    return F.transform(F.array_sort(F.transform(kept, lambda x: F.struct(x["i"].alias("i"), x["p"].alias("p")))), lambda x: x["p"])


def with_skeleton(df: DataFrame, json: Column) -> DataFrame:
    """df (terms, topic) with skeleton struct<core, parts>: the one in json, else the terms one after the other, else the topic.

    Parts get the retrieval variants of the term they match, and are replaceable if they have any.
    """

    def part(p: Column, i: Column) -> Column:
        flag = lambda f, d: F.coalesce(_given(p[f]).try_cast("boolean"), F.lit(d))
        return F.struct(F.coalesce(_given(p["id"]), F.concat(F.lit("t"), i.cast("string"))).alias("id"), F.coalesce(_given(p["text"]), F.lit("")).alias("text"), flag("required", True).alias("required"), flag("replaceable", False).alias("replaceable"), F.coalesce(p["variants"], _none()).alias("variants"))

    def from_term(t: Column, i: Column) -> Column:
        return F.struct(F.concat(F.lit("t"), i.cast("string")).alias("id"), t["text"].alias("text"), t["required"].alias("required"), t["replaceable"].alias("replaceable"), _none().alias("variants"))

    lone = F.array(F.struct(F.lit("t0").alias("id"), F.col("topic").alias("text"), F.lit(True).alias("required"), F.lit(False).alias("replaceable"), _none().alias("variants")))
    df = df.withColumns({"_raw": F.from_json(F.coalesce(F.get_json_object(json, "$.parts"), F.get_json_object(json, "$.replace_spans")), _RAW_PART), "_core": F.coalesce(_given(F.get_json_object(json, "$.core_text")), _given(F.get_json_object(json, "$.core_claim")))})
    df = df.withColumn("_given", F.coalesce(F.filter(F.transform("_raw", part), lambda p: p["text"] != ""), _none(f"array<{PART}>")))
    df = df.withColumn("_has", F.col("_core").isNotNull() | (F.size("_given") > 0))
    df = df.withColumn("_parts", F.when(F.col("_has"), F.col("_given")).when(F.size("terms") > 0, F.transform("terms", from_term)).otherwise(lone))
    df = df.withColumn("_whole", F.coalesce(F.when(F.col("_has"), F.col("_core")), text.squeeze(F.array_join(F.transform("_parts", lambda p: p["text"]), " "))))
    df = df.withColumn("_parts", without_overlaps(F.col("_whole"), F.col("_parts")))
    df = df.withColumn("_forms", F.transform(F.coalesce("terms", _none(f"array<{TERM}>")), lambda t: F.struct(term_forms(t).alias("forms"), t["required"].alias("required"), t["replaceable"].alias("replaceable"))))
    match = lambda p: F.try_element_at(F.filter("_forms", lambda t: F.exists(t["forms"], lambda f: F.lower(f) == F.lower(p["text"]))), F.lit(1))
    df = df.withColumn("_match", F.transform("_parts", match))
    df = df.withColumn("_cands", F.transform("_parts", lambda p, i: F.concat(p["variants"], F.coalesce(F.get(F.col("_match"), i)["forms"], _none()))))
    df = df.withColumn("_alts", variants.retrieval_variants_each(F.transform("_parts", lambda p: p["text"]), F.col("_cands")))

    def enrich(p: Column, i: Column) -> Column:
        m, alts = F.get(F.col("_match"), i), F.get(F.col("_alts"), i)
        swap = p["replaceable"] | (F.size(alts) > 0) | F.coalesce(m["replaceable"], F.lit(False))
        return F.struct(p["id"].alias("id"), p["text"].alias("text"), (p["required"] & F.coalesce(m["required"], F.lit(True))).alias("required"), swap.alias("replaceable"), alts.alias("variants"))

    df = df.withColumn("skeleton", F.struct(F.col("_whole").alias("core"), F.transform("_parts", enrich).alias("parts")))
    return df.drop("_raw", "_core", "_given", "_has", "_parts", "_whole", "_forms", "_match", "_cands", "_alts")


def render(core: Column, old: Column | None = None, new: Column | None = None, modifier: str | None = None) -> Column:
    """The core text with its first `old` replaced, in its own case if it occurs so, and a modifier if it lacks it."""
    out = core
    if old is not None:
        at = F.when(F.instr(core, old) > 0, F.instr(core, old)).otherwise(F.instr(F.lower(core), F.lower(old)))
        out = F.when(at > 0, F.concat(F.left(core, at - 1), new, F.substr(core, at + F.length(old)))).otherwise(core)
    if modifier:
        out = F.when(F.contains(F.lower(out), F.lit(modifier.lower())), out).otherwise(F.concat(out, F.lit(f" {modifier}")))
    return text.squeeze(out)


def _task(mode: str, transform: Column | str, source: Column, seed: Column, part: Column | None = None) -> Column:
    kind = F.lit(transform) if isinstance(transform, str) else transform
    return F.struct(F.lit(mode).alias("mode"), kind.alias("transform"), source.alias("source"), seed.alias("text"), F.coalesce(part, F.lit("")).alias("part") if part is not None else F.lit("").alias("part"))


def swap_kind(canon: Column, variant: Column) -> Column:
    """What a variant is to its term: core, abbrev or synonym."""
    brief = lambda x: (F.length(x) <= 6) & (F.upper(x) == x) & (F.lower(x) != x)
    return F.when(F.lower(canon) == F.lower(variant), "core").when(brief(variant) | (brief(canon) & (F.length(variant) > F.length(canon))), "abbrev").otherwise("synonym")


def swaps(skeleton: Column, most: int = 3) -> Column:
    """Tasks with one part swapped: the first variant of each part in turn, then the second, `most` at most. A swap that changes nothing isn't counted."""
    core = text.squeeze(skeleton["core"])
    rounds = F.flatten(
        F.transform(
            F.sequence(F.lit(0), F.lit(1)),
            lambda n: F.flatten(F.transform(F.filter(skeleton["parts"], lambda p: p["replaceable"]), lambda p: F.transform(F.filter(p["variants"], lambda v, i: i == n), lambda v: _task("lexical", swap_kind(p["text"], v), F.concat(F.lit("parts["), p["id"], F.lit("]")), render(skeleton["core"], p["text"], v), p["id"])))),
        )
    )
    return F.slice(F.filter(rounds, lambda t: F.lower(t["text"]) != F.lower(core)), 1, most)


def decomposition(skeleton: Column, terms: Column) -> Column:
    """Tasks that put each instance of a wide term in its place, or in the first replaceable part's."""
    wide = F.filter(F.coalesce(terms, _none(f"array<{TERM}>")), lambda t: F.coalesce(t["gap"], F.lit(False)) & (F.size(t["instances"]) > 0))

    def tasks(t: Column) -> Column:
        own = F.filter(skeleton["parts"], lambda p: (F.lower(p["text"]) == F.lower(t["text"])) | F.coalesce(F.lower(p["text"]) == F.lower(t["abbrev"]), F.lit(False)))
        target = F.coalesce(F.try_element_at(own, F.lit(1)), F.try_element_at(F.filter(skeleton["parts"], lambda p: p["replaceable"]), F.lit(1)), F.try_element_at(skeleton["parts"], F.lit(1)))
        return F.transform(t["instances"], lambda x: _task("decomposition", "entity", F.concat(F.lit("instances:"), x), F.coalesce(render(skeleton["core"], target["text"], x), text.squeeze(skeleton["core"])), target["id"]))

    return F.flatten(F.transform(wide, tasks))


def budget(tasks: Column, most: int = 5) -> Column:
    """Tasks in the order core, others, conceptual, metadata, raw; one for each text, `most` at most."""
    named = [k for k in TASK_ORDER if k]

    def of(kind: str | None) -> Column:
        return F.filter(tasks, lambda t: (t["transform"] == kind) if kind else ~t["transform"].isin(*named))

    return F.slice(first_by_text(F.filter(F.concat(*map(of, TASK_ORDER)), lambda t: text.squeeze(t["text"]) != "")), 1, most)


def all_tasks(question: Column, intent: Column, topic: Column, authors: Column, skeleton: Column, terms: Column, gap: Column, decompose: Column, most_swaps: int = 3) -> Column:
    """All tasks of a question, before the budget: navigation for a specific paper, the core, swaps, decomposition."""
    specific = intent == "specific"
    plain = F.regexp_replace(text.squeeze(question), r"[?？]+$", "")
    none = _none(f"array<{TASK}>")
    by_author = F.when(specific & (F.coalesce(authors, F.lit("")) != ""), F.array(_task("lexical", "metadata", F.lit("slots.authors"), authors)))
    by_title = F.when(specific & text.looks_like_title(topic), F.array(_task("lexical", "metadata", F.lit("slots.topic"), topic)))
    raw = F.when(specific & (plain != "") & ~gap & (F.lower(plain) != F.lower(topic)) & ~text.looks_like_title(plain), F.array(_task("lexical", "raw", F.lit("raw_question"), plain)))
    core = F.array(_task("lexical", "core", F.lit("slots.query_skeleton"), text.squeeze(skeleton["core"])))
    parts = [F.coalesce(x, none) for x in (by_author, by_title, raw, core, swaps(skeleton, most_swaps), F.when(decompose & ~specific, decomposition(skeleton, terms)))]
    return F.concat(*parts)


def auto_decompose(intent: Column, skeleton: Column, terms: Column, least_parts: int = 2) -> Column:
    """Never for a specific paper; else if a wide term has instances, or enough parts are required."""
    wide = F.exists(F.coalesce(terms, _none(f"array<{TERM}>")), lambda t: F.coalesce(t["gap"], F.lit(False)) & (F.size(t["instances"]) > 0))
    return (intent != "specific") & (wide | (F.size(F.filter(skeleton["parts"], lambda p: p["required"])) >= least_parts))


def criteria(question: Column, topic: Column, method: Column, claim: Column, negation: Column, terms: Column) -> Column:
    """What a relevant paper must be about: typed, described, with the type's weight; negations weigh nothing."""

    def row(kind: str | Column, content: Column) -> Column:
        kind_col = F.lit(kind) if isinstance(kind, str) else kind
        weight, wording = F.lit(0.2), F.lit("Relevant to: ")
        for k, (w, d) in CRITERIA.items():
            weight, wording = F.when(kind_col == k, F.lit(w)).otherwise(weight), F.when(kind_col == k, F.lit(d)).otherwise(wording)
        return F.struct(kind_col.alias("type"), content.alias("text"), F.lit(True).alias("required"), F.concat(wording, content).alias("description"), weight.alias("weight"))

    maybe = lambda kind, x: F.when(F.coalesce(x, F.lit("")) != "", F.array(row(kind, x)))
    none = F.filter(F.array(row("topic", F.lit(""))), lambda r: F.lit(False))
    of_terms = F.coalesce(F.transform(F.filter(terms, lambda t: t["required"]), lambda t: row(F.when(t["role"].isin("topic", "method", "entity"), t["role"]).otherwise("topic"), t["text"])), none)
    has_topic = F.exists(of_terms, lambda r: r["type"] == "topic")
    of_topic = F.when(~has_topic, F.array(row("topic", F.coalesce(F.nullif(topic, F.lit("")), text.squeeze(question)))))
    return F.concat(of_terms, F.coalesce(maybe("method", method), none), F.coalesce(of_topic, none), F.coalesce(maybe("claim", claim), none), F.coalesce(F.transform(negation, lambda n: row("negation", n)), none))


def weigh(rows: Column, intent: Column) -> Column:
    """Criteria once for each type and text, weights summing to 1, and the intent as the last."""
    keys = F.transform(rows, lambda r: F.concat_ws("\x00", r["type"], text.normal(r["text"])))
    once = F.filter(rows, lambda r, i: F.array_position(keys, F.concat_ws("\x00", r["type"], text.normal(r["text"]))) == i + 1)
    total = F.aggregate(once, F.lit(0.0), lambda s, r: s + r["weight"])
    weighted = F.transform(once, lambda r: F.struct(r["type"].alias("type"), r["text"].alias("text"), r["required"].alias("required"), r["description"].alias("description"), F.when(total > 0, F.floor(r["weight"] / total * 10000 + 0.5) / 10000).otherwise(r["weight"]).alias("weight")))
    last = F.struct(F.lit("intent").alias("type"), intent.alias("text"), F.lit(False).alias("required"), F.concat(F.lit("User intent="), intent).alias("description"), F.lit(0.0).alias("weight"))
    return F.array_append(weighted, last)


def understand(rows: DataFrame, reading: str | None = None, most: int = 5, decompose: bool | None = None) -> DataFrame:
    """One row per question (qid, question): intent, years, negation, topic, method, claim, terms, skeleton, gap, criteria, tasks.

    reading: a column with a model's reading as JSON (intent, topic, method, claim, terms or
    term_groups, query_skeleton, filters); what it lacks, and everything without it, comes
    from the rules. decompose: None decides by the slots.
    """
    q = F.coalesce("question", F.lit(""))
    read = F.col(reading) if reading else F.lit(None).cast("string")
    got = lambda path: _given(F.get_json_object(read, f"$.{path}"))
    since, until = understanding.years(q)
    topic0, method0 = understanding.topic(q), understanding.method_cue(q)
    out = rows.where("qid is not null").withColumns(
        {
            "intent": F.coalesce(F.lower(got("intent")), understanding.intent(q)),
            "year_from": F.coalesce(got("filters.year_from").try_cast("int"), since),
            "year_to": F.coalesce(got("filters.year_to").try_cast("int"), until),
            "negation": understanding.negations(q),
            "authors": got("filters.authors"),
            "claim": F.coalesce(got("claim"), understanding.claim(q)),
            "read_terms": terms_of(F.coalesce(F.get_json_object(read, "$.term_groups"), F.get_json_object(read, "$.terms"))),
        }
    )
    by_role = lambda r: F.try_element_at(F.filter("read_terms", lambda t: t["role"] == r), F.lit(1))["text"]
    out = out.withColumn("topic", F.coalesce(got("topic"), by_role("topic"), F.try_element_at(F.filter("read_terms", lambda t: t["required"]), F.lit(1))["text"], topic0)).withColumn("method", F.coalesce(got("method"), by_role("method"), method0))

    def plain_term(name: Column, role: str, gap: Column) -> Column:
        return F.struct(name.alias("text"), F.lit(role).alias("role"), F.lit(None).cast("string").alias("abbrev"), _none().alias("synonyms"), _none().alias("instances"), gap.alias("gap"), F.lit(True).alias("required"), F.lit(False).alias("replaceable"))

    short = F.size(F.split(F.col("topic"), " ")) <= 2
    own = F.array_compact(F.array(F.when(F.col("topic") != "", plain_term(F.col("topic"), "topic", F.when(short, True))), F.when(F.col("method").isNotNull() & ~F.contains(F.lower("topic"), F.lower("method")), plain_term(F.col("method"), "method", F.lit(None).cast("boolean")))))
    out = out.withColumn("terms", F.coalesce("read_terms", own)).drop("read_terms")
    # Each stage's expressions are large and used more than once; inlined into one another they
    # would grow without bound, so stages are cut by writing these small rows.
    out = materialize(with_skeleton(materialize(out, "terms"), F.get_json_object(read, "$.query_skeleton")), "skeletons")
    said = got("coverage_gap_likely").try_cast("boolean")
    out = out.withColumn("gap", F.coalesce(said, F.lit(False)) | F.col("claim").isNotNull() | F.exists("terms", lambda t: F.coalesce(t["gap"], F.lit(False))) | variants.gap_likely(F.col("skeleton.core")))
    split = auto_decompose(F.col("intent"), F.col("skeleton"), F.col("terms")) if decompose is None else F.lit(decompose)
    out = out.withColumn("_split", split)
    out = out.withColumn("_criteria", criteria(q, F.col("topic"), F.col("method"), F.col("claim"), F.col("negation"), F.col("terms")))
    out = out.withColumn("criteria", weigh(F.col("_criteria"), F.col("intent"))).drop("_criteria")
    out = out.withColumn("_tasks", all_tasks(q, F.col("intent"), F.col("topic"), F.col("authors"), F.col("skeleton"), F.col("terms"), F.col("gap"), F.col("_split")))
    return materialize(materialize(out, "tasks").withColumn("tasks", budget(F.col("_tasks"), most)).drop("_split", "_tasks"), "plans")


def sub_queries(understood: DataFrame, most: int = 5) -> DataFrame:
    """qid, sqid, sq_ord, text, channel, angle, mode, source, year_from, year_to: the search texts of every question.

    Task texts are rewritten for search; a text of two words or fewer falls back to the
    intent's template. Texts are kept once; sqid keeps the task's place, so it may have gaps.
    """

    def searched(t: Column) -> Column:
        clean = text.rewrite(t["text"])
        first = F.try_element_at(understanding.templates(F.col("intent"), F.col("topic"), F.col("question"), 1), F.lit(1))
        brief = F.size(F.split(clean, " ")) <= 2
        return F.btrim(text.squeeze(F.when(brief & first.isNotNull(), first).otherwise(F.coalesce(clean, t["text"]))), F.lit(" ,"))

    lines = F.transform("tasks", lambda t, i: F.struct(i.alias("i"), searched(t).alias("text"), t["transform"].alias("angle"), t["mode"].alias("mode"), t["source"].alias("source")))
    kept = F.slice(first_by_text(F.filter(lines, lambda t: t["text"] != "")), 1, most)
    out = understood.select("qid", "year_from", "year_to", F.posexplode(kept).alias("sq_ord", "t"))
    channel = F.when(F.col("t.angle") == "metadata", "metadata").otherwise("keyword")
    return out.select("qid", F.concat(F.lit("q"), F.col("t.i").cast("string")).alias("sqid"), "sq_ord", "t.text", channel.alias("channel"), "t.angle", "t.mode", "t.source", "year_from", "year_to")


def slot_usage(understood: DataFrame, recall: bool = True) -> DataFrame:
    """qid, slot, channel: where each filled slot takes effect: in the provider's filter, the search text, or the judging only."""
    lists = {"negation": "judge_only", "terms": "query_material"}
    scalars = {"year_from": "api_filter", "year_to": "api_filter", "authors": "api_filter", "method": "query_material" if recall else "api_filter", "topic": "query_material"}
    used = [F.when(F.size(c) > 0, F.struct(F.lit(c).alias("slot"), F.lit(ch).alias("channel"))) for c, ch in lists.items()]
    used += [F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", F.struct(F.lit(c).alias("slot"), F.lit(ch).alias("channel"))) for c, ch in scalars.items()]
    used.append(F.when(F.col("skeleton.core") != "", F.struct(F.lit("query_skeleton").alias("slot"), F.lit("query_material").alias("channel"))))
    return understood.select("qid", F.explode(F.array_compact(F.array(*used))).alias("u")).select("qid", "u.slot", "u.channel")
