"""SQL text shared by the oracles: the same functions spelled for DuckDB."""

from __future__ import annotations

from paperloom.functions import identity as I
from paperloom.functions import scoring as S
from paperloom.functions import text as T
from paperloom.functions import understanding as U

SPACE = T.SPACE


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def words(items: list[str]) -> str:
    return "(" + ", ".join(map(quote, items)) + ")"


def squeeze(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), {quote(SPACE + '+')}, ' ', 'g'))"


def strip(x: str) -> str:
    return f"regexp_replace({x}, {quote(f'^{SPACE}+|{SPACE}+$')}, '', 'g')"


def normal(x: str) -> str:
    return squeeze(f"lower({x})")


def tokens(x: str) -> str:
    found = f"regexp_extract_all(lower(coalesce({x}, '')), '[a-z0-9][a-z0-9\\-]*')"
    return f"list_distinct(list_filter(list_transform({found}, lambda t: rtrim(t, '-')), lambda t: length(t) > 1 and t not in {words(T.STOP_WORDS)}))"


def shown(x: str) -> str:
    """A list as sorted text."""
    return f"array_to_string(list_sort({x}), ' ')"


def fingerprint(x: str) -> str:
    return f"left(trim(regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9]+', ' ', 'g')), 200)"


def first(pattern: str, *texts: str) -> str:
    case = "i" if pattern.startswith("(?i)") else "c"
    pattern = pattern.removeprefix("(?i)")
    return "coalesce(" + ", ".join(f"nullif(regexp_extract({t}, {quote(pattern)}, 1, '{case}'), '')" for t in texts) + ")"


#: papers with the payload as JSON in j; first papers of each id.
PAPERS = "papers_j as (select *, case when json_valid(raw) then case when json_type(raw) = 'VARCHAR' then try_cast(json_extract_string(raw, '$') as json) else raw::json end end as j from papers)"
FIRST = f"{PAPERS}, fp as (select * from papers_j where paper_id is not null qualify row_number() over (partition by paper_id order by ord) = 1)"


def member(path: str, j: str = "j") -> str:
    return f"json_extract_string({j}, '$.{path}')"


def arxiv(j: str = "j") -> str:
    paths = [f"externalIds.{k}" for k in ("ArXiv", "arXiv", "arxiv", "ARXIV")] + [f"ids.{k}" for k in ("arxiv", "ArXiv", "ARXIV")] + ["arxiv_id", "arxivId", "arxiv"]
    return first(I.ARXIV, "paper_id", *[member(p, j) for p in paths])


def doi(j: str = "j") -> str:
    return "lower(" + first(I.DOI, *[member(f"{p}{n}", j) for p in ("ids.", "externalIds.", "") for n in ("doi", "DOI", "Doi")]) + ")"


def openalex(j: str = "j") -> str:
    return "upper(" + first(I.OPENALEX, member("id", j), "paper_id", member("ids.openalex", j)) + ")"


def key() -> str:
    t, pid = fingerprint("title"), strip("coalesce(paper_id, '')")
    return f"coalesce('arxiv:' || {arxiv()}, 'doi:' || {doi()}, case when {t} <> '' then 'title:' || {t} || case when {pid} <> '' then ';pid:' || {pid} else '' end end, 'raw:' || ord)"


def normal_id(x: str) -> str:
    return f"regexp_replace({strip(f"lower(coalesce({x}, ''))")}, '^([0-9.]*[0-9][0-9.]*)v.*$', '\\1')"


def is_arxiv(x: str) -> str:
    return f"regexp_matches({normal_id(x)}, {quote(I.ARXIV_ID)})"


def count() -> str:
    return "greatest(coalesce(" + ", ".join(f"case when regexp_matches({member(k)}, '^-?[0-9]+$') then try_cast({member(k)} as bigint) end" for k in I.COUNT_KEYS) + "), 0)"


def count_or_null() -> str:
    inner = "coalesce(" + ", ".join(f"case when regexp_matches({member(k)}, '^-?[0-9]+$') then try_cast({member(k)} as bigint) end" for k in I.COUNT_KEYS) + ")"
    return f"case when {inner} is null then 0 else greatest({inner}, 0) end"


def venue() -> str:
    return "coalesce(" + ", ".join(f"nullif(" + strip(f"case when json_type(j, '$.{k}') = 'OBJECT' then {member(k + '.name')} else {member(k)} end") + ", '')" for k in I.VENUE_KEYS) + ", '')"


def round4(x: str) -> str:
    return f"floor(({x}) * 10000 + 0.5) / 10000"


def clip(x: str) -> str:
    return f"greatest(0.0::double, least(1.0::double, ({x})::double))"


def by_intent(intent: str, table: dict[str, float], default: float) -> str:
    whens = " ".join(f"when {quote(k)} then {v}::double" for k, v in table.items())
    return f"(case lower(trim(coalesce({intent}, ''))) {whens} else {default}::double end)"


def weight(intent: str, part: str) -> str:
    k = S.PARTS.index(part)
    return by_intent(intent, {i: w[k] for i, w in S.WEIGHTS.items()}, S.DEFAULT_WEIGHTS[k])


def threshold(intent: str) -> str:
    return by_intent(intent, S.THRESHOLDS, S.DEFAULT_THRESHOLD)


def tier_bar(intent: str) -> str:
    return by_intent(intent, S.TIERS, S.DEFAULT_TIER)


def coverage(q: str, p: str, t: str) -> str:
    share = f"len(list_intersect({q}, {p})) / len({q})::double"
    bonus = f"len(list_intersect({q}, {t})) / len({q})::double * 0.15::double"
    return f"case when len({q}) = 0 then 0.5::double when len({p}) = 0 then 0.0::double else {round4(f'least(1.0::double, {share} + {bonus})')} end"


def title_density(q: str, t: str) -> str:
    return f"case when len({q}) = 0 or len({t}) = 0 then 0.0::double else len(list_intersect({q}, {t})) / len({q})::double end"


def citation(c: str, most: str) -> str:
    return f"case when {most} <= 0 then 0.0::double else ln(1 + coalesce({c}, 0)::double) / ln(1 + {most}::double) end"


def recency(y: str, lo: str, hi: str) -> str:
    return f"case when {y} is null or {hi} <= {lo} then 0.5::double else ({y} - {lo}) / ({hi} - {lo})::double end"


def venue_score(v: str) -> str:
    return f"case when regexp_matches(lower(coalesce({v}, '')), {quote('|'.join(S.TOP_VENUES))}) then 1.0::double else 0.0::double end"


def blend(rel: str, emb: str, cit: str, rec: str, ven: str, tit: str, intent: str) -> str:
    w = {p: weight(intent, p) for p in S.PARTS}
    r = clip(rel)
    head = f"case when {emb} is null then ({w['rel']} + {w['embedding']}) * {r} else {w['rel']} * {r} + {w['embedding']} * {emb} end"
    return round4(clip(f"({head}) + {w['citation']} * {cit} + {w['recency']} * {rec} + {w['venue']} * {ven} + {w['title']} * {tit}"))


def normalize(s: str, t: str) -> str:
    s, t = clip(s), clip(t)
    above = round4(f"0.5::double + 0.5::double * ({s} - {t}) / greatest(1e-9::double, 1.0::double - {t})")
    return f"case when {s} <= 0 then 0.0::double when {t} <= 0 then {round4(s)} when {s} >= {t} then {above} else {round4(f'0.5::double * {s} / {t}')} end"


def has(x: str, cue: str) -> str:
    return f"regexp_matches({x}, {quote(cue)}, 'i')"


def intent(q: str) -> str:
    q = f"coalesce({q}, '')"
    return (
        f"case when {has(q, U.SPECIFIC)} then 'specific' when {has(q, U.SURVEY)} then 'survey' when {has(q, U.RELATED)} then 'related' "
        f"when {has(q, U.DATASET)} and not {has(q, U.METHOD)} then 'dataset' when {has(q, U.METHOD)} then 'method' else 'broad' end"
    )


def _year(q: str, pattern: str, group: int = 1) -> str:
    return f"try_cast(nullif(regexp_extract({q}, {quote(pattern)}, {group}, 'i'), '') as int)"


def _last(q: str, pattern: str) -> str:
    return f"try_cast(list_extract(regexp_extract_all({q}, {quote('(?i)' + pattern)}, 1), -1) as int)"


def years(q: str) -> tuple[str, str]:
    q = f"coalesce({q}, '')"
    a = f"coalesce({_year(q, U.BETWEEN)}, {_year(q, U.RANGE)})"
    b = f"case when {_year(q, U.BETWEEN)} is not null then {_year(q, U.BETWEEN, 2)} else {_year(q, U.RANGE, 2)} end"
    since, before = f"coalesce(2026 - {_year(q, U.LAST_YEARS)}, {_last(q, U.SINCE)})", f"{_last(q, U.BEFORE)} - 1"
    only = f"case when {since} is null and {before} is null then {_year(q, U.IN_YEAR)} end"
    return f"cast(case when {a} is not null then least({a}, {b}) else coalesce({since}, {only}) end as int)", f"cast(case when {a} is not null then greatest({a}, {b}) else coalesce({before}, {only}) end as int)"


def negations(q: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all(coalesce({q}, ''), {quote('(?i)' + U.NEGATION)}, 1), lambda p: trim(p, ' .;:')), lambda p: p <> '' and length(p) < 80)"


def rewrite(x: str) -> str:
    t = squeeze(x)
    for opening in T.OPENINGS:
        t = f"trim(regexp_replace({t}, {quote(opening)}, '', 'i'))"
    t = f"trim(regexp_replace({t}, '[?？!！.]+$', ''))"
    return t


def topic(q: str) -> str:
    q = f"trim(coalesce({q}, ''))"
    bare = f"trim(regexp_replace(regexp_replace({q}, {quote(U.OPENER.removeprefix('(?i)'))}, '', 'i'), '[?？]+$', ''))"
    words = f"list_filter(regexp_split_to_array(regexp_replace({bare}, {quote(U.TIME_CLAUSE.removeprefix('(?i)'))}, ' ', 'gi'), '\\s+'), lambda w: w <> '')"
    filler = f"regexp_matches({{}}, {quote(U.FILLER.removeprefix('(?i)'))}, 'i')"
    kept = f"list_filter(ws, lambda w, i: not {filler.format('w')} or len(list_filter(ws[1:i - 1], lambda v: not {filler.format('v')})) >= 2)"
    found = f"(select trim(array_to_string({kept}, ' '), ' ,.-') from (select {words} as ws))"
    return f"coalesce(nullif({found}, ''), {q})"


def templates(q: str) -> str:
    """The list of search texts of a question, as text."""
    bare = f"regexp_replace(trim(coalesce({q}, '')), '[?？]+$', '')"
    plus = {"method": ("method", "approach"), "dataset": ("dataset", "benchmark"), "related": ("related work",)}
    middle = " ".join(f"when {quote(k)} then [" + ", ".join(f"t || ' {w}'" for w in v) + "]" for k, v in plus.items())
    texts = f"list_filter(list_transform(list_concat([t], case {intent(q)} {middle} when 'specific' then [{bare}] else [] end, [{bare}]), lambda s: trim({squeeze('s')}, ' ,')), lambda s: s <> '')"
    return f"(select array_to_string(list_filter(xs, lambda s, i: list_position(list_transform(xs, lambda v: lower(v)), lower(s)) = i)[1:3], '|') from (select {texts} as xs from (select {topic(q)} as t)))"


def dedupe(items: str) -> str:
    """A list without blanks and repeats, letter case aside."""
    texts = f"list_filter(list_transform({items}, lambda s: {squeeze('s')}), lambda s: s <> '')"
    return f"(select list_filter(xs, lambda s, i: list_position(list_transform(xs, lambda v: lower(v)), lower(s)) = i) from (select {texts} as xs))"


def method(q: str) -> str:
    return f"nullif(trim(regexp_extract(coalesce({q}, ''), {quote(U.METHOD_CUE)}, 1, 'i')), '')"


def claim(q: str) -> str:
    out = []
    for p in U.CLAIMS:
        at, size = f"length(regexp_extract(cq, {quote('(?is)^(.*?)' + p)}, 1)) + 1", f"length(regexp_extract(cq, {quote('(?is)^.*?(' + p.replace('(?:', '(').replace('(', '(?:') + ')')}, 1))"
        out.append(f"when regexp_matches(cq, {quote(p)}, 'i') then trim({squeeze(f'substr(cq, greatest(1, {at} - 30), {at} + {size} + 30 - greatest(1, {at} - 30))')}, ' ,.;:')")
    return f"(select case {' '.join(out)} end from (select trim(coalesce({q}, '')) as cq))"


def criteria() -> str:
    """place, type, text, required, weight of each question's criteria, as `crit`."""
    from paperloom.operators.planning import CRITERIA

    weigh = " ".join(f"when {quote(k)} then {w}::double" for k, (w, _) in CRITERIA.items())
    return f"""cu as (select qid, question, {intent('question')} as intent, {topic('question')} as topic, {method('question')} as method, {claim('question')} as claim, {negations('question')} as negation from eval_rows where qid is not null),
 c0 as (select qid, 0 as k, 0 as i, 'topic' as type, coalesce(nullif(topic, ''), {squeeze('question')}) as text from cu union all select qid, 1, 0, 'method', method from cu where method is not null union all select qid, 2, 0, 'claim', claim from cu where coalesce(claim, '') <> ''
  union all select qid, 3, i, 'negation', negation[i] from (select qid, negation, unnest(generate_series(1, len(negation))) as i from cu)),
 c1 as (select *, case type {weigh} end as w from c0 qualify row_number() over (partition by qid, type, {normal('text')} order by k, i) = 1),
 c2 as (select qid, k, i, type, text, true as required, case when sum(w) over (partition by qid) > 0 then {round4('w / sum(w) over (partition by qid)')} else w end as weight from c1 union all select qid, 9, 0, 'intent', intent, false, 0.0::double from cu),
 crit as (select qid, cast(row_number() over (partition by qid order by k, i) - 1 as int) as place, type, text, required, weight from c2)"""


QUESTION = f"""questions as (select qid, question, {intent('question')} as intent, {years('question')[0]} as year_from, {years('question')[1]} as year_to,
 {negations('question')} as negation, {tokens('question')} as qtok from eval_rows where qid is not null)"""
