import random

import pytest
from pyspark.sql import functions as F

from paperloom.llm import lookup as L

VENUES = [
    (1, "European Conference on Acoustic Learning Theory", "ECALT", "conference"), (2, "Journal of Granular Ontologies", "JGOX", "journal"),
    (3, "Transactions on Granular Ontologies", "TGOX", "transactions"), (4, "International Symposium on Cognitive Bibliometrics", "ISCB", "symposium"),
    (5, "Workshop on Archival Discovery and Search", "WADS", "workshop"), (6, "Annual Conference on Quantum Retrieval", "ACQR", "conference"),
    (7, None, None, None), (8, "", "", ""),
]

CASES = [
    ("European Conference on Acoustic Learning Theory", 1), ("  EUROPEAN\tCONFERENCE on Acoustic_Learning Theory, vol. 3, no. 5", 1),
    ("Eur. Conf. on Acoustic Learn. Theory 1996", 1), ("Proceedings of the 3rd European Confrence on Acoustic Laerning Theory", 1),
    ("Procs. of the twenty-third european conference on acoustic learning theory", 1), ("acoustic learning theory, european conference on", 1),
    ("conference on acoustic learning theory", 1), ("E.C.A.L.T.", 1), ("ecalt'19", 1), ("ECALT (2015)", 1), ("ECALT&#x27;2021.", 1),
    ("Journal of Granular Ontologies, Roundses, 2019", 2), ("J. of Granular Ontolgies", 2), ("Jrnl. of Granular Ontologies (JGOX)", 2), ("jrln of granular ontologies", 2),
    ("Granular Ontologies, Transactions on", 3), ("Trnas. on Granular Ontologies", 3), ("Symposium on Granular Ontologies", -1), ("Granular Ontologies, Symposium on", -1), ("Granular Ontologies", -1),
    ("Int'l Sympos. on Cognitive Bibliometrics", 4), ("Wkshp on Archival Disc. + Search", 5), ("workshop on archival discovery & serach 2017", 5),
    ("Annual Conference on Acoustic Learning Theory", -1), ("Preprint", -1), ("n/a", -1), ("?", -1), ("2021", -1), ("Annals of the Fiaki Guild", -1), ("x" * 50000, -1), ("word " * 5000, -1),
]


@pytest.mark.parametrize(("typed", "want"), CASES)
def test_cases(typed, want):
    assert L.Dictionary(VENUES).lookup(typed) == want


def test_candidates_equal_a_scan_of_all_words():
    """Brute force: the deletion index finds every word within the allowed distance."""
    rng = random.Random(5)
    d = L.Dictionary(VENUES)
    for _ in range(2000):
        word = rng.choice(sorted(d.frequency))
        typed = list(word)
        for _ in range(rng.randint(0, 2)):
            i = rng.randrange(len(typed))
            match rng.randrange(4):
                case 0:
                    typed[i] = rng.choice("aeinorst")
                case 1:
                    typed.insert(i, rng.choice("aeinorst"))
                case 2 if len(typed) > 1:
                    del typed[i]
                case 3 if i:
                    typed[i - 1], typed[i] = typed[i], typed[i - 1]
        typed = "".join(typed)
        got = d.candidates(typed)
        for w in d.frequency:
            if len(w) >= 4 and (far := L.distance(typed, w, L.allowed(len(w)))) != float("inf"):
                assert got[w] <= far


def test_distance():
    assert L.distance("abc", "abc", 2) == 0
    assert L.distance("abc", "acb", 2) == 0.7
    assert L.distance("abbc", "abc", 2) == pytest.approx(0.6)
    assert L.distance("abc", "abd", 2) == 1
    assert L.distance("abc", "xyz", 2) == float("inf")


def test_table(spark):
    rows = [(i, f'{{"venue": "{t}", "x": 1}}', ) for i, (t, _) in enumerate(CASES) if "\t" not in t]
    rows += [(100, None), (101, "{}"), (102, '{"venue": null}'), (103, '{"venue": " \\u00a0"}'), (104, '{"venue": "ECALT'), (105, '"{\\"venue\\": \\"ECALT\\"}"'), (106, '{"venue": 7}'), (None, '{"venue": "JGOX"}'), (107, '{"venue": "JGOX\\ud800"}')]
    df = spark.createDataFrame(rows, "ord bigint, raw string").withColumn("entry", F.lit("clash")).withColumn("k", F.lit(1))
    got = {r.ord: r.entry for r in L.map_values(df, "ord", "raw", VENUES, "venue").collect()}
    want = {i: w for i, (t, w) in enumerate(CASES) if "\t" not in t} | {105: 1, 106: -1, None: 2, 107: -1}
    assert got.keys() == want.keys()
    assert {k: v for k, v in got.items() if k != 107} == {k: v for k, v in want.items() if k != 107}
    assert L.map_values(df.limit(0), "ord", "raw", VENUES, "venue").count() == 0
    assert {r.entry for r in L.map_values(df, "ord", "raw", [], "venue").collect()} == {-1}
    missed = {r.value: r.n for r in L.misses(L.map_values(df.union(df), "ord", "raw", VENUES, "venue")).collect()}
    assert missed["Preprint"] == 2 and "ECALT" not in missed


def test_long_reference_list_is_refused(spark, monkeypatch):
    monkeypatch.setattr(L, "MAX_ENTRIES", 3)
    with pytest.raises(ValueError):
        L.load(spark.createDataFrame(VENUES, "venue_id int, name string, short_name string, kind string"), "venue_id", "name", "short_name", "kind")


def test_long_values_and_words():
    d = L.Dictionary([*VENUES, (9, "Symposium on " + "Pneumonoultramicroscopicsilicovolcanoconiosis", None, "symposium")])
    assert d.lookup("proceedings of the " + "forty second gathering held by many people in towns " * 6 + "European Conference on Acoustic Learning Theory") == 1
    assert d.lookup("Symposium on Pneumonoultramicroscopicsilicovolcanoconioss") == 9


def test_blocks_equal_one_dictionary(spark, monkeypatch):
    """A list longer than one broadcast gives what the whole list gives, repeated rows included."""
    rows = [(i % 40, t) for i, (t, _) in enumerate(CASES)] + [(None, "ECALT"), (3, "ECALT"), (3, "ECALT"), (4, None)]
    df = spark.createDataFrame(rows, "id int, typed string").withColumn("entry", F.lit("clash"))
    reference = spark.createDataFrame(VENUES, "venue_id int, name string, short_name string, kind string")
    want = sorted(L.map_values(df, "id", "typed", VENUES).collect(), key=str)
    monkeypatch.setattr(L, "MAX_ENTRIES", 6)
    assert sorted(L.map_to_list(df, "id", "typed", reference, "venue_id", "name", "short_name", "kind").collect(), key=str) == want
