"""Chunking: nothing is lost, sizes hold, ids are stable."""

import random

from pyspark.sql import functions as F

from siltstone.operators import chunking as c

TEXT = "# Intro\n\nShort body.\n\n1.2 Methods used\n\n" + "The crew measured the river. It rose again in spring. " * 60 + "\n\n| a | b |\n| 1 | 2 |\n\n```\ncode line one\n\ncode line two\n```\n\nRESULTS AND LIMITS\n\n" + "x" * 9000


def lossless(text, rows):
    """Every line is a heading, or stands in the children's own texts read in order (a long line may span several)."""
    headings = {" ".join(x.split()) for r in rows for x in r[5].split("\n")}
    own = "".join("".join(r[8].split()) for r in rows if not r[3])
    for line in text.replace("\r", "").split("\n"):
        assert " ".join(line.split()) in headings or "".join(line.split()) in own, line[:80]


def test_document():
    rows = c.chunk_document(7, TEXT)
    lossless(TEXT, rows)
    assert all(r[6] <= 400 + 2 for r in rows if not r[3])
    assert rows == c.chunk_document(7, TEXT) and len({r[1] for r in rows}) == len(rows)
    parents = {r[1] for r in rows if r[3]}
    assert parents and {r[2] for r in rows if r[2]} == parents
    assert any("code line one\n\ncode line two" in r[8] for r in rows)
    assert "1.2 Methods used" in {r[5] for r in rows}


def test_random_documents_lose_nothing():
    rng = random.Random(6)
    for _ in range(60):
        lines = [rng.choice(["", "", "## Head", "2. Second Part", "A plain line of text. With two sentences.", "| r | s |", "word " * rng.randrange(1, 400), "ALL CAPS", "```"]) for _ in range(rng.randrange(0, 40))]
        text = "\n".join(lines)
        lossless(text, c.chunk_document(1, text))


def test_column(spark):
    df = spark.createDataFrame([(1, TEXT, "clash"), (2, None, "x"), (3, " \n ", "y"), (1, TEXT, "clash")], "id long, body string, chunk_text string")
    rows = c.chunk(df, "id", F.col("body")).collect()
    assert {r.id for r in rows} == {1} and len(rows) == 2 * len(c.chunk_document(1, TEXT))
    assert c.chunk(df.limit(0), "id", F.col("body")).count() == 0


def test_classifier():
    assert c.classify("\n".join(f"Chapter {i} ...... {i}" for i in range(6))) == "toc"
    assert c.classify("\n".join(f"[{i}] A. Author (2001)" for i in range(6))) == "references"
    assert c.classify("\n".join(f"term{i}: its meaning" for i in range(6))) == "glossary"
    assert c.classify("One line.\nTwo lines.\nThree.\nFour.") == "body"
