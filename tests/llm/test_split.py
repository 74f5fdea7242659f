"""Pieces against the stated invariants, by brute force over words."""

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltstone.llm import q_split, split

WORD = re.compile("[^\t-\r \x85\xa0  -     　]+")


def cut(spark, texts, limit=20, overlap=5, **kw):
    rows = [(i, t, "clash", "clash") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id long, body string, t string, w string")
    out = {}
    for r in split.pieces(df, "id", F.col("body"), limit, [limit], overlap, **kw).collect():
        out.setdefault(r.item_id, []).append(r)
    return {k: sorted(v, key=lambda r: r.piece_no) for k, v in out.items()}


def check(pieces, text, limit, overlap):
    words = WORD.findall(text)
    if len(words) <= limit:
        assert [p.piece_text for p in pieces] == [text]
        return
    assert len(pieces) > 1
    at, whole = 0, ""
    for k, p in enumerate(pieces):
        own = WORD.findall(p.piece_text)
        back = len(own) - p.own_words
        assert len(own) == p.piece_words <= limit
        assert back == (0 if k == 0 else min(overlap, at))
        assert own == words[at - back : at + p.own_words]
        at += p.own_words
    assert at == len(words)


def test_cases(spark):
    para = "one two three four five six seven eight nine ten.\n\n"
    texts = ["", "   ", "short text", para * 8, "word " * 100, "\n".join(["a b c d"] * 30), " lead " + "x " * 40, "w　" * 30, "a​b " * 30, "x " * 20, "x " * 21, "long" * 1000]
    got = cut(spark, [*texts, None])
    assert len(texts) not in got
    for i, t in enumerate(texts):
        check(got[i], t, 20, 5)


def test_prefers_strong_boundaries(spark):
    text = ("a b c d e f g h i. " * 2 + "\n\n") * 5
    pieces = cut(spark, [text], limit=40, overlap=5)[0]
    assert all(p.piece_text.endswith("\n\n") for p in pieces)
    sentences = cut(spark, ["alpha beta gamma delta epsilon. " * 30], limit=20, overlap=4)[0]
    assert all(p.piece_text.rstrip().endswith(".") for p in sentences)


def test_overlong_words_are_cut_by_characters(spark):
    pieces = cut(spark, ["y" * 1000 + " z" * 25], limit=20, overlap=5, longest_word=100)[0]
    assert pieces[0].piece_text == "y" * 1000 + " " + "z " * 5
    assert all(p.piece_words <= 20 for p in pieces)


def test_one_word_of_a_hundred_thousand_characters(spark):
    long = "é" * 100_000
    pieces = cut(spark, [long], limit=20, overlap=5, longest_word=100)[0]
    assert len(pieces) == 67 and all(len(p.piece_text) <= 2000 and p.n_words == 1 for p in pieces)
    assert "".join([pieces[0].piece_text] + [p.piece_text[500:] for p in pieces[1:]]) == long
    df = spark.createDataFrame([(1, long), (2, "w " * 21), (3, "w " * 20)], "id long, body string")
    assert [r[0] for r in split.oversized(df, "id", F.col("body"), 20, [20], 5).collect()] == [2]  # over in words, not in characters


def test_word_counts(spark):
    texts = ["", " ", "a", " a", "a ", " a b ", "a\u3000b\u00a0c\n\n", "\u200bx y\u2028", "\x1c a"]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
    got = [r[0] for r in df.select(split.word_count(F.col("t"))).collect()]
    assert got == [len(WORD.findall(t)) for t in texts] + [None]


def test_copies_empty_and_bad_limits(spark):
    assert cut(spark, []) == {}
    df = spark.createDataFrame([(1, "a " * 50)] * 2, "id long, body string")
    assert split.oversized(df, "id", F.col("body"), 20, [20], 5).collect() == [(1,)]
    with pytest.raises(ValueError):
        split.pieces(df, "id", F.col("body"), 5, [5], 5)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab. \n\t 　!?", max_size=300), min_size=1, max_size=20))
def test_random_texts(spark, texts):
    got = cut(spark, texts, limit=12, overlap=3)
    for i, t in enumerate(texts):
        check(got[i], t, 12, 3)


def test_pieces_carry_the_heading(spark, tmp_path):
    sections = [(1, "Tides", "word " * 600), (2, None, "short"), (1, "Tides", "word " * 600)]
    spark.createDataFrame(sections, "section_id long, heading string, text string").write.parquet(f"{tmp_path}/canonical_section.parquet")
    points = [(1, (False, "a point"))]
    spark.createDataFrame(points, "chunk_id long, payload struct<is_parent: boolean, chunk_text: string>").write.parquet(f"{tmp_path}/qdrant_point.parquet")
    got = sorted((r.item_table, r.item_id, r.piece_no, r.heading or "") for r in q_split.p2_pieces(spark, str(tmp_path)).collect())
    assert got == [("canonical_section", 1, 1, "Tides"), ("canonical_section", 1, 2, "Tides"), ("canonical_section", 2, 1, ""), ("qdrant_point", 1, 1, "")]
