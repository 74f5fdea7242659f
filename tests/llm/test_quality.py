"""Quality statistics by hand, and the rules on clear cases and on labelled documents."""

import pytest
from pyspark.sql import functions as F

from siltstone.llm import quality

PROSE = "The river board met in May and agreed to measure the outflow. Several members said that the figures were late, but they will be published in June. "


def kinds(spark, rows):
    df = spark.createDataFrame([(*r, "clash", 0) for r in rows], "doc_id long, text string, lang string, n_words string, t int")
    return {r.doc_id: r for r in quality.with_kind(quality.statistics(df, "doc_id", F.col("text"), F.col("lang"))).collect()}


def test_statistics():
    s = dict(zip(("n_words", "n_lines", *quality.NAMES), quality.statistics_of("The cat sat.\r\nThe cat sat.\n\nTwo 22\n", "en")))
    assert (s["n_words"], s["n_lines"]) == (8, 3)
    assert s["mean_word_length"] == pytest.approx((3 + 3 + 4 + 3 + 3 + 4 + 3 + 2) / 8)
    assert s["symbol_ratio"] == pytest.approx(2 / 25) and s["digit_share"] == pytest.approx(2 / 25)
    assert s["punctuated_line_share"] == pytest.approx(2 / 3) and s["duplicate_line_share"] == pytest.approx(1 / 3)
    assert s["common_word_share"] == pytest.approx(2 / 8) and s["sentence_ends_per_word"] == pytest.approx(2 / 7)
    assert s["top_ngram_share"] == pytest.approx(2 * 10 / 25)


def test_top_ngram_share_by_brute_force():
    import random
    from collections import Counter

    rng = random.Random(5)
    for _ in range(200):
        words = [rng.choice(["a", "bb", "ccc"]) for _ in range(rng.randrange(0, 30))]
        got = quality._top_ngram_share(words, list(map(len, words)), max(1, sum(map(len, words))), 3)
        c = Counter(zip(words, words[1:], words[2:]))
        top = max(c.values(), default=0)
        want = 0.0 if top < 2 else min(1.0, top * max(sum(map(len, g)) for g, n in c.items() if n == top) / sum(map(len, words)))
        assert got == pytest.approx(want)


def test_clear_cases(spark):
    table = "\n".join(f"| site {i} | {i * 7} | {i}.5% |" for i in range(12))
    listed = "\n".join(f"{i}. item about the river" for i in range(1, 15))
    junk = "x{}=<>;@#$%" * 30
    rows = [(1, PROSE * 4, "en"), (2, table, "en"), (3, listed, "en"), (4, junk, "en"), (5, None, "en"), (6, " \n\t ", None), (7, PROSE * 3, "xx"), (8, PROSE * 400, None), (9, PROSE * 2 + "\n- one\n- two\n" + PROSE * 2, "en"), (1, PROSE * 4, "en")]
    got = kinds(spark, [(i, t if i in (5, 6) or t is None else t, g) for i, t, g in rows])
    assert {i: r.text_kind for i, r in got.items() if i not in (1, 7, 8)} == {2: "table", 3: "list", 4: "junk", 5: "junk", 6: "junk", 9: "prose"}
    assert len(got) == 9 and got[5].n_words == 0 and got[8].n_words == 400 * len(PROSE.split())


def test_empty(spark):
    assert kinds(spark, []) == {}


def test_trailing_blanks_and_closing_signs():
    at = quality.NAMES.index("punctuated_line_share") + 2
    for text, want in (("One sentence." + " " * 10 + "\nTwo more." + "\t" * 9, 1.0), ('He said "stop.")\nno end "', 0.5), ("]]]\n.", 0.5), ("a;)\n'", 0.5)):
        assert quality.statistics_of(text, "en")[at] == want, text


def test_repetition_decides(spark):
    verse = "The board met in May and agreed to measure the outflow of the river."
    rows = [(1, "\n".join([verse] * 8 + [PROSE] * 4), "en"), (2, "\n\n".join([PROSE, PROSE, PROSE]), "en"), (3, PROSE * 3, "en")]
    got = kinds(spark, rows)
    assert got[1].duplicate_line_share > 0.5 and got[2].duplicate_paragraph_share > 0.5
    assert {i: r.text_kind for i, r in got.items()} == {1: "junk", 2: "junk", 3: "prose"}


def test_copies_and_ids_of_several_texts(spark):
    df = spark.createDataFrame([(1, PROSE, "en"), (1, PROSE, "en"), (1, "x", "en")], "doc_id long, text string, lang string")
    assert sorted(r.n_words for r in quality.statistics(df, "doc_id", F.col("text"), F.col("lang")).collect()) == [1, len(PROSE.split())]


def _labelled(spark, sf_dir):
    folder = sf_dir.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stats = quality.statistics(docs, "doc_id", F.col("text"), F.col("lang"))
    return stats, *quality.labelled_sample(stats, spark.read.parquet(f"{folder}/text_label.parquet"))


def test_fitted_limits_on_held_out_labels(spark, sf_dir):
    """Fitted on half of the labels from a spoilt prior, the rules tell the other half; a prior without errors stays."""
    stats, rows, truth = _labelled(spark, sf_dir)
    assert len(rows) > 100 and (quality.kinds_of(rows, quality.LIMITS) == [r.text_kind for r in quality.with_kind(spark.createDataFrame(rows)).orderBy(F.xxhash64("doc_id"), "doc_id").collect()]).all()
    half = rows["doc_id"].to_numpy() % 2 == 0
    prose = lambda limits, at: ((quality.kinds_of(rows[at], limits) == "prose") == (truth[at] == "prose")).mean()
    assert prose(quality.fit_limits(rows[half], truth[half]), ~half) > 0.97
    spoilt = quality.LIMITS | {"digit_share": 0.055, "most_sentences": 0.055}
    fitted = quality.fit_limits(rows[half], truth[half], spoilt)
    assert prose(fitted, ~half) >= prose(spoilt, ~half) and prose(fitted, half) > 0.97
    assert quality.fit_limits(rows[:0], truth[:0]) == quality.LIMITS
