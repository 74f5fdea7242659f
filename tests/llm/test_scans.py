"""Noise planted in clean pages is found, and the repaired text is the clean text."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import scans

WORDS = "the board of water measured harbour modern reports under clear agreement with many stations and farmers recorded lower values during summer months when semi-arid regions required further careful evaluation".split()
HEADER = "Annual Report of the Harbour Board"


def make(seed=1, documents=40, pages=6):
    """Pages with known noise; misreadings are rare against their readings, as the operator supposes."""
    rng = random.Random(seed)
    rows, truth, clean = [], set(), {}
    item = 0
    for d in range(documents):
        words = [rng.choice(WORDS) for _ in range(pages * 60)]
        clean[f"d{d}"] = " ".join(words)
        stream, at = list(words), 0
        first = item
        pending = None
        for p in range(1, pages + 1):
            lines = []
            if p > 1:
                lines += [HEADER.upper() if p % 2 else HEADER, ""]
                truth.add((item, 1, "running"))
            for _ in range(10):
                take = stream[at : at + 6]
                at += 6
                body, kind = list(take), None
                if pending:
                    body.insert(0, pending)
                    pending = None
                spot = rng.random()
                if spot < 0.15 and rng.random() < 0.2 and len(body) > 3 and body[2] == "modern":
                    body[2], kind = "rnodern", "char"
                elif 0.15 <= spot < 0.3 and rng.random() < 0.15 and body[1] in ("clear", "with", "board"):
                    body[1], kind = {"clear": "c1ear", "with": "witb", "board": "boarcl"}[body[1]], "char"
                elif spot > 0.8 and body[-1] in ("measured", "agreement", "evaluation", "semi-arid") and not (p == pages and len(lines) >= 11):
                    word = body[-1]
                    if word == "semi-arid":
                        body[-1], pending = "semi-", "arid"
                    else:
                        body[-1], pending, kind = word[:4] + rng.choice("-¬\xad"), word[4:], "hyphen"
                lines.append(" ".join(body))
                if kind:
                    truth.add((item, len(lines), kind))
            if pending and p == pages:
                lines[-1] = lines[-1] + ""
            lines += ["", f"- {p + 3} -"]
            truth.add((item, len(lines), "page_number"))
            rows.append(("t", item, f"d{d}", p, ("\r\n" if d % 2 else "\n").join(lines)))
            item += 1
        if pending:  # the rest of a word broken at the very end never came
            truth = {x for x in truth if not (x[0] == item - 1 and x[2] == "hyphen" and x[1] == max(n for i, n, k in truth if i == item - 1 and k == "hyphen"))}
        assert first < item
    return rows, truth, clean


SCHEMA = "item_table string, item_id long, document string, page int, text string"


@pytest.fixture(scope="module")
def found(spark):
    rows, truth, clean = make()
    df = spark.createDataFrame(rows + rows[:4] + [("t", 9000, "d900", 1, None), ("t", 9001, "d901", 1, "  \n "), ("t", 9002, "d902", 1, "one line")], SCHEMA)
    noise, corrections, labels = scans.noisy_lines(df)
    return df, noise.cache(), corrections.cache(), labels, truth, clean


def test_planted_noise(found):
    _, noise, _, _, truth, _ = found
    got = {(r.item_id, r.line_no, r.noise_kind) for r in noise.collect()}
    for kind in ("running", "page_number", "hyphen", "char"):
        g, t = {x for x in got if x[2] == kind}, {x for x in truth if x[2] == kind}
        assert t and len(g & t) / len(t) > 0.95 and len(g & t) / max(1, len(g)) > 0.95, (kind, sorted(g ^ t)[:5])
    assert not any(i >= 9000 for i, _, _ in got)


def test_repaired_text(found):
    df, _, corrections, labels, _, clean = found
    texts = {r.document: r.text for r in scans.paragraphs(df, labels, corrections).collect()}
    wrong = {d: (texts[d], want) for d, want in clean.items() if " ".join(texts[d].split()) != want}
    assert not wrong, next(iter(wrong.values()))


def test_headers_of_many_lines(spark):
    """A header of five lines and a footer of three are found to the last line, and nothing of the body."""
    rng, rows = random.Random(4), []
    head = ["Harbour Board of the Northern Coast", "Annual Report on Tides", "Volume Twelve", "Part on Measurements", "Draft for Comment"]
    foot = ["Confidential until published", "Office of the Board"]
    for d in range(12):
        for p in range(1, 7):
            body = [" ".join(rng.choice(WORDS) for _ in range(8)) for _ in range(14)]
            rows.append(("t", d * 10 + p, f"d{d}", p, "\n".join([*head, "", *body, "", *foot, f"- {p} -"])))
    noise, _, labels = scans.noisy_lines(spark.createDataFrame(rows, SCHEMA))
    got = {(r.item_id, r.line_no, r.noise_kind) for r in noise.where("noise_kind IN ('running', 'page_number')").collect()}
    want = {(i, n, "running") for _, i, _, _, _ in rows for n in (1, 2, 3, 4, 5, 22, 23)} | {(i, 24, "page_number") for _, i, _, _, _ in rows}
    assert got == want


def test_training_covers_all_pages_alike(spark):
    """Each sequence with its number of pages trains as all pages one by one, and twice the pages train the same."""
    pages = ["0350", "1555", "3555", "5555", "555"]
    one = spark.createDataFrame([(p, n + 1) for n, p in enumerate(pages)], "symbols string, n long")
    each = spark.createDataFrame([(p, 1) for n, p in enumerate(pages) for _ in range(2 * (n + 1))], "symbols string, n long")
    for a, b in zip(scans.train(one), scans.train(each)):
        assert np.allclose(np.exp(a), np.exp(b))


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    noise, corrections, labels = scans.noisy_lines(df)
    assert noise.count() == 0 and scans.paragraphs(df, labels, corrections).count() == 0


def test_viterbi_against_brute_force():
    from itertools import product

    rng = np.random.default_rng(3)
    start, step, emit = rng.random(3), rng.random((3, 3)), rng.random((3, 4))
    sequences = [rng.integers(0, 4, n) for n in (1, 4, 2, 6)]
    for s, states in zip(sequences, scans.viterbi(sequences, np.log(start), np.log(step), np.log(emit))):
        score = lambda z: start[z[0]] * emit[z[0], s[0]] * np.prod([step[a, b] * emit[b, o] for a, b, o in zip(z, z[1:], s[1:])])  # noqa: B023, E731
        best = max(product(range(3), repeat=len(s)), key=score)
        assert tuple(states) == best


def test_fold_is_the_same_in_both_forms(spark):
    words = ["Modern", "rnodern", "c1ear", "dear", "Énergie", "wíth", "electrify", "clectrify", "turning", "turriing", "Al1iance", "", "123"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert [r[0] for r in df.select(scans.fold(F.col("w"))).collect()] == [scans._fold(w) for w in words]
