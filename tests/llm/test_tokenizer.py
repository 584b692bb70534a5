import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from paperloom.llm import tokenizer as T

pytestmark = pytest.mark.skipif(not os.path.isdir(T.FOLDER), reason="no vocabulary files")

TEXTS = [
    "", " ", "  ", "a", "Hello  world\n\n  x", "it's we'll I'D", "<|endoftext|> x", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa",
    "naïve café ﬁne ﬀ", "中文没有空格的文本测试", "​ 　x", "tab\there\r\nand", "\x1c\x1d x\x85y", "🙂🙃👩‍👩‍👧", "12345 67.89 ½ ²", "־עברית العربية", "x" * 5000, "ab" * 3000, " " * 3000, "é" * 2000,
    "\x00\x01", "−=+*&^%$#@!~`", "CamelCaseAndSnake_case_words",
]


@pytest.fixture(scope="module")
def automaton():
    return T.compiled(T.pack("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def public():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(os.path.join(T.FOLDER, "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda x: t.encode(x, add_special_tokens=False).ids


def test_same_as_public_library(automaton, public):
    for text in TEXTS:
        assert automaton.encode(text) == public(text), text[:50]


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_random_texts(automaton, public, text):
    ids = automaton.encode(text)
    assert automaton.decode(ids) == text.encode()
    assert ids == public(text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abcdehilnorst ", max_size=80))
def test_random_words(automaton, public, text):
    assert automaton.encode(text) == public(text)


def test_every_label_is_its_own_path(automaton):
    assert all(automaton.path(label) == [i] for i, label in enumerate(automaton.labels))


def test_path_matches_merging_in_order():
    """Brute force: all strings over a small alphabet against merging the pairs one rank after the other."""
    import itertools

    labels = [b"a", b"b", b"c", b"ab", b"aa", b"bc", b"aab", b"abc", b"aaaa", b"cab"]
    small = T.Automaton(labels)

    def merge(word):
        parts = [bytes([x]) for x in word]
        for c in range(3, len(labels)):
            pair, i = (labels[small.left[c]], labels[small.right[c]]), 0
            while i + 1 < len(parts):
                if (parts[i], parts[i + 1]) == pair:
                    parts[i : i + 2] = [labels[c]]
                i += 1
        return [small.ids[p] for p in parts]

    for n in range(1, 9):
        for word in itertools.product(b"abc", repeat=n):
            assert small.path(bytes(word)) == merge(word)


def test_column(spark, public):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(100, None), (None, "x"), (0, "again"), (101, "word " * 60000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumnRenamed("z", "z").selectExpr("*", "1 as k", "'x' as t", "array(1) as ids")
    got = sorted((str(r.doc_id), r.ids) for r in T.encode_column(df, "doc_id", "text").collect())
    assert got == sorted((str(k), public(t) if t else []) for k, t in rows)
    assert T.encode_column(df.limit(0), "doc_id", "text").count() == 0
    counts = sorted((str(r.doc_id), r.n_tokens) for r in T.token_counts(df, ["doc_id"], "text").collect())
    assert counts == sorted((str(k), len(public(t)) if t else 0) for k, t in rows)


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def test_other_vocabularies(name):
    import tiktoken

    labels = T.read_vocabulary(name)
    enc = tiktoken.Encoding("own", pat_str=r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+", mergeable_ranks={x: i for i, x in enumerate(labels)}, special_tokens={})
    own = T.Automaton(labels)
    for text in TEXTS:
        assert own.encode(text) == enc.encode_ordinary(text)


def test_full_tables_are_emptied(automaton, public, monkeypatch):
    monkeypatch.setattr(T, "KEPT_WORDS", 3)
    monkeypatch.setattr(T, "KEPT_ARCS", 3)
    for text in TEXTS:
        assert automaton.encode(text) == public(text)
