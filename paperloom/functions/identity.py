"""Identity of papers across providers: Column expressions over the id, the title and the payload.

The payload is a VARIANT: parsed once, its hot members promoted to columns where they are
read, unreadable payloads null. `payload` also opens a payload that is wrapped in a JSON text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom.functions.text import normal, strip, title_fingerprint

# Patterns of public identifiers, and prefixes they are written with.
ARXIV = r"\b(\d{4}\.\d{4,5})(v\d+)?\b"
DOI = r"(?i)\b(10\.\d{4,9}/[^\s\"'<>]+)"
OPENALEX = r"(?i)\b(W\d+)\b"
ARXIV_ID = r"^(\d{4}\.\d{4,5}|[a-z\-]+/\d{7})(v\d+)?$"
PREFIXES = ("arxiv:", "doi:", "corpusid:", "https://doi.org/", "http://doi.org/", "https://openalex.org/", "http://openalex.org/", "openalex:")
COUNT_KEYS = ("citationCount", "citation_count", "cited_by_count", "num_cited_by")
VENUE_KEYS = ("venue", "journal", "publicationVenue")


def payload(raw: Column) -> Column:
    """The payload as a VARIANT."""
    once = F.try_parse_json(raw)
    wrapped = F.schema_of_variant(once) == "STRING"
    return F.when(wrapped, F.try_parse_json(F.try_variant_get(once, "$", "string"))).otherwise(once)


def member(j: Column, path: str) -> Column:
    """A member as text, null if absent or no scalar."""
    return F.try_variant_get(j, f"$.{path}", "string")


def _first(pattern: str, *texts: Column) -> Column:
    return F.coalesce(*[F.nullif(F.regexp_extract(t, pattern, 1), F.lit("")) for t in texts])


def arxiv_id(paper_id: Column, j: Column) -> Column:
    """The first arXiv id, without version, in the id, the external ids, the ids, or the payload itself."""
    paths = [f"externalIds.{k}" for k in ("ArXiv", "arXiv", "arxiv", "ARXIV")] + [f"ids.{k}" for k in ("arxiv", "ArXiv", "ARXIV")] + ["arxiv_id", "arxivId", "arxiv"]
    return _first(ARXIV, paper_id, *[member(j, p) for p in paths])


def doi(j: Column) -> Column:
    """The first DOI in the ids, the external ids, or the payload itself, in lower case."""
    names = ("doi", "DOI", "Doi")
    return F.lower(_first(DOI, *[member(j, f"{p}{n}") for p in ("ids.", "externalIds.", "") for n in names]))


def canonical_key(paper_id: Column, title: Column, j: Column, ordinal: Column) -> Column:
    """arxiv:…, else doi:…, else title:…;pid:…, else title:…, else raw:<ordinal>."""
    pid, name = strip(F.coalesce(paper_id, F.lit(""))), title_fingerprint(title)
    titled = F.when(name != "", F.when(pid != "", F.concat(F.lit("title:"), name, F.lit(";pid:"), pid)).otherwise(F.concat(F.lit("title:"), name)))
    return F.coalesce(F.concat(F.lit("arxiv:"), arxiv_id(paper_id, j)), F.concat(F.lit("doi:"), doi(j)), titled, F.concat(F.lit("raw:"), ordinal.cast("string")))


def normal_id(ident: Column) -> Column:
    """Trimmed, lower case, and without what follows a `v` after digits and dots."""
    return F.regexp_replace(F.lower(strip(F.coalesce(ident, F.lit("")))), r"^([0-9.]*[0-9][0-9.]*)v.*$", "$1")


def is_arxiv_id(ident: Column) -> Column:
    """Whether an id, in normal form, is an arXiv id, old or new."""
    return normal_id(ident).rlike(ARXIV_ID)


def openalex_id(paper_id: Column, j: Column) -> Column:
    return F.upper(_first(OPENALEX, member(j, "id"), paper_id, member(j, "ids.openalex")))


def lookup_key(paper_id: Column, j: Column) -> Column:
    """Key to fetch a work with: its W-id, else its DOI's address, else its arXiv id."""
    return F.coalesce(openalex_id(paper_id, j), F.concat(F.lit("https://doi.org/"), doi(j)), F.concat(F.lit("arxiv:"), arxiv_id(paper_id, j)))


def s2_query_id(paper_id: Column, j: Column) -> Column:
    """Provider's own id, else CorpusId, arXiv id, DOI, or the paper's id."""
    own = strip(member(j, "paperId"))
    own = F.when((own != "") & ~is_arxiv_id(own) & ((F.length(own) >= 20) | own.rlike(r"^[\p{L}\p{N}]+$")), own)
    corpus = F.nullif(strip(member(j, "externalIds.CorpusId")), F.lit(""))
    outer = F.coalesce(F.nullif(member(j, "externalIds.ArXiv"), F.lit("")), member(j, "externalIds.arXiv"))
    outer = F.nullif(F.split_part(F.regexp_extract(outer, r"([^/]*)$", 1), F.lit("v"), F.lit(1)), F.lit(""))
    ext_doi = F.nullif(strip(F.coalesce(F.nullif(member(j, "externalIds.DOI"), F.lit("")), member(j, "externalIds.doi"))), F.lit(""))
    return F.coalesce(
        own, F.concat(F.lit("CorpusId:"), corpus), F.concat(F.lit("ARXIV:"), outer), F.concat(F.lit("DOI:"), ext_doi), F.concat(F.lit("ARXIV:"), arxiv_id(paper_id, j)), F.concat(F.lit("DOI:"), doi(j)), strip(F.coalesce(paper_id, F.lit("")))
    )


def alias_forms(values: Column) -> Column:
    """Each id of an array in normal form, with and without the known prefixes, once."""

    def forms(v: Column) -> Column:
        v = strip(v)
        cut = [F.when(F.lower(v).startswith(p), normal(F.substring(v, len(p) + 1, 10_000))) for p in PREFIXES]
        return F.array(normal(v), *cut)

    return F.array_distinct(F.filter(F.flatten(F.transform(F.array_compact(values), forms)), lambda v: v.isNotNull() & (v != "")))


def aliases(paper_id: Column, j: Column) -> Column:
    """Every id a paper is known by."""
    arxiv, d, oa = arxiv_id(paper_id, j), doi(j), openalex_id(paper_id, j)
    external = [member(j, f"externalIds.{k}") for k in ("CorpusId", "DOI", "ArXiv", "arXiv", "ACL", "PubMed")]
    inner = [member(j, f"ids.{k}") for k in ("doi", "arxiv", "openalex", "mag")]
    return alias_forms(
        F.array(
            paper_id, arxiv, F.concat(F.lit("arxiv:"), arxiv), d, F.concat(F.lit("doi:"), d), oa, F.concat(F.lit("https://openalex.org/"), oa), member(j, "paperId"), *external, F.concat(F.lit("CorpusId:"), external[0]), *inner, F.upper(_first(OPENALEX, inner[2]))
        )
    )


def citation_count(j: Column) -> Column:
    """The first whole number, or text of digits, of four names, at least 0; null if none."""
    texts = [member(j, k) for k in COUNT_KEYS]
    n = F.coalesce(*[F.when(t.rlike("^-?[0-9]+$"), t.try_cast("bigint")) for t in texts])
    return F.when(n.isNotNull(), F.greatest(n, F.lit(0)))


def venue(j: Column) -> Column:
    """The first venue of three names that isn't blank, a text or the name of an object; '' if none."""
    found = [F.nullif(strip(F.coalesce(member(j, k), member(j, f"{k}.name"))), F.lit("")) for k in VENUE_KEYS]
    return F.coalesce(*found, F.lit(""))


def url(paper_id: Column, j: Column) -> Column:
    """The first web address of four names (a text or an object's url), the DOI's or arXiv's address, or ''."""
    web = [F.when(x.startswith("http"), x) for k in ("url", "openAccessPdf", "landing_page_url", "doi_url") for x in (member(j, k), member(j, f"{k}.url"))]
    d = F.nullif(strip(member(j, "doi")), F.lit(""))
    return F.coalesce(*web, F.when(d.startswith("http"), d).otherwise(F.concat(F.lit("https://doi.org/"), d)), F.when(is_arxiv_id(paper_id), F.concat(F.lit("https://arxiv.org/abs/"), paper_id)), F.lit(""))
