import json

from pyspark.sql import functions as F

from paperloom.operators.shred import entities, parse_payload, shred

CASES = [
    (0, None),
    (1, ""),
    (2, "{}"),
    (3, '{"authors": ["A", null, {"name": "B", "affiliations": ["X", null, "Y"]}, {"name": null}, {}]}'),
    (4, '{"authors": {"name": "Lone", "affiliations": "Z"}, "locations": {"landing_page_url": null}}'),
    (5, json.dumps(json.dumps({"referenced_works": ["W1", None, "W2"], "authors": "Text"}))),
    (6, '{"authors": ["A"], "venue": "cut o'),
    (7, '{"references": [null, {"paperId": "p", "authors": [{"name": "R"}, null, {"authorId": "1"}]}, {}]}'),
    (8, '{"authorships": [{"author": null}, null, {"author": {"display_name": "D"}, "institutions": {"display_name": "I"}}]}'),
    (9, "[1, 2]"),
    (10, '{"authors": []}'),
    (11, '{"authors": ["\\ud800x", "\\u0000"]}'),
    (12, "[" * 200000),
    (None, '{"authors": ["nokey"]}'),
]

EXPECTED = {
    (3, "author", 0, -1, "A"), (3, "author", 2, -1, "B"), (3, "author", 3, -1, ""), (3, "author", 4, -1, ""),
    (3, "affiliation", 2, 0, "X"), (3, "affiliation", 2, 2, "Y"),
    (4, "author", 0, -1, "Lone"), (4, "affiliation", 0, 0, "Z"), (4, "location", 0, -1, ""),
    (5, "reference", 0, -1, "W1"), (5, "reference", 2, -1, "W2"), (5, "author", 0, -1, "Text"),
    (7, "reference", 1, -1, "p"), (7, "reference", 2, -1, ""), (7, "ref_author", 1, 0, "R"), (7, "ref_author", 1, 2, ""),
    (8, "author", 0, -1, ""), (8, "author", 2, -1, "D"), (8, "affiliation", 2, 0, "I"),
    (11, "author", 0, -1, "?x"), (11, "author", 1, -1, "\0"),
    (None, "author", 0, -1, "nokey"),
}


def frame(spark, rows):
    return spark.createDataFrame(rows, "ord bigint, raw string").withColumn("node", F.lit("clash")).withColumn("rec", F.lit(1)).withColumn("payload", F.lit(2))


def test_entities(spark):
    got = [tuple(r) for r in entities(frame(spark, CASES), "ord", "raw").select("ord", "kind", "pos", "sub_pos", "item_text").collect()]
    assert len(got) == len(set(got))
    assert set(got) == EXPECTED


def test_empty_table_and_repeats(spark):
    assert entities(frame(spark, []), "ord", "raw").count() == 0
    assert shred(frame(spark, []), "ord", "raw").count() == 0
    assert entities(frame(spark, CASES + CASES), "ord", "raw").count() == 2 * len(EXPECTED)


def test_adjacency_rebuilds_payload(spark):
    payload = {"a": [1, {"b": "x", "c": ["y", {"d": True}]}], "e": {"f": {"g": "z"}}, "h": "i"}
    rows = shred(frame(spark, [(1, json.dumps(payload))]), "ord", "raw").collect()
    kids = {}
    for r in rows:
        kids.setdefault(r.parent, []).append(r)

    def build(r):
        if not r.is_object:
            return r.scalar
        out = {}
        for k in kids.get(r.node, []):
            out.setdefault(k.label, []).append((k.ordinal, build(k)))
        return {k: [x for _, x in sorted(v, key=lambda p: p[0])] for k, v in out.items()}

    assert build(kids[-1][0]) == {"a": ["1", {"b": ["x"], "c": ["y", {"d": ["true"]}]}], "e": [{"f": [{"g": ["z"]}]}], "h": ["i"]}


def test_parent_links(spark):
    rows = entities(frame(spark, CASES), "ord", "raw").collect()
    nodes = {(r.ord, r.node) for r in rows}
    assert all(r.parent == -1 if r.sub_pos == -1 else (r.ord, r.parent) in nodes for r in rows)


def test_parse_payload():
    assert parse_payload('"{}"') == {}
    assert parse_payload('"plain"') is None
    assert parse_payload("null") is None


def test_all_scalars(spark):
    payload = {"id": "W1", "authorships": [{"author_position": "first", "author": {"id": "A1", "display_name": "Ann"}, "institutions": [{"id": "I1", "lineage": ["I1", None, "I3"], "country_code": None}]}, "Bo"], "locations": {"landing_page_url": "u", "pdf_url": "v", "source": {"issn": ["1", "2"]}}, "referenced_works": ["W2"]}
    rows = entities(frame(spark, [(1, json.dumps(payload)), (2, "{}"), (3, None)]), "ord", "raw", scalars=True).collect()
    assert {(r["kind"], r["pos"], r["sub_pos"]): r["scalars"] for r in rows} == {
        ("author", 0, -1): {"author_position": "first", "author.id": "A1", "author.display_name": "Ann"}, ("author", 1, -1): {"": "Bo"}, ("affiliation", 0, 0): {"id": "I1", "lineage": "I1", "lineage[2]": "I3"},
        ("location", 0, -1): {"landing_page_url": "u", "pdf_url": "v", "source.issn": "1", "source.issn[1]": "2"}, ("reference", 0, -1): {"": "W2"},
    }
