"""Repeated lines and sequences against counting by hand."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from siltstone.llm import boilerplate as b
from siltstone.llm import q_boilerplate

SCHEMA = "doc long, src string, body string, line string, lines string, group string"


def key(line):
    k = "".join(c for c in line if c.isalpha()).lower()
    return k or None


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash", "clash") for r in rows], SCHEMA)


def rows_of():
    rows = []
    for i in range(60):
        lines = [f"story number {chr(97 + i % 26)}{chr(97 + i // 26)}", "Share this!  Story", "12 34"]
        if i % 2:
            lines += ["", "SHARE THIS story", "Legal notice", "all rights."]
        if i < 4:
            lines.append("too rare")
        rows.append((i, "s1" if i < 40 else "s2", "\r\n".join(lines)))
    return rows + [(100, None, "Share this story"), (101, "s1", None), (102, "s1", ""), (103, "s3", "Share this story")] + rows[:3]


def by_hand(rows, least=5, share=0.03):
    docs, seen = defaultdict(set), defaultdict(set)
    for d, s, t in rows:
        if s is None:
            continue
        docs[s].add(d)
        for line in (t or "").split("\n"):
            if key(line):
                seen[s, key(line)].add(d)
    return {(d, n) for d, s, t in rows if s and t is not None for n, line in enumerate(t.split("\n"), 1) if key(line) and len(seen[s, key(line)]) >= max(least, share * len(docs[s]))}


def texts(df):
    return b.identified(df, "src", "doc", "doc", b.line_ids(F.col("body")))


def mined(df, **kw):
    t = texts(df)
    return b.Sequences(t, b.frequent_lines(t, share=kw.get("share", b.LEAST_SHARE)), **kw)


def test_marks(spark):
    rows = rows_of()
    assert {(r.item_id, r.line_no) for r in mined(frame(spark, rows)).marks().collect()} == by_hand(rows)


def contiguous(rows, frequent, least=5, share=0.03):
    """Supports of all runs over the frequent lines of each document, and the longest ones, by brute force."""
    docs, seen, at = defaultdict(set), defaultdict(set), []
    for d, s, t in rows:
        if s is None:
            continue
        docs[s].add(d)
        run = [key(x) for x in (t or "").split("\n") if (s, key(x)) in frequent]
        at.append((s, run))
        for i in range(len(run)):
            for j in range(i + 1, len(run) + 1):
                seen[s, tuple(run[i:j])].add(d)
    often = {k: len(v) for k, v in seen.items() if len(v) >= max(least, share * len(docs[k[0]]))}
    longest = set()
    for s, run in at:
        ends = [max((j for j in range(i + 1, len(run) + 1) if (s, tuple(run[i:j])) in often), default=i) for i in range(len(run))]
        longest |= {(s, tuple(run[i : ends[i]])) for i in range(len(run)) if ends[i] > i and (i == 0 or ends[i] > ends[i - 1])}
    return {k: often[k] for k in longest}


def many_templates(seed=3):
    rng, rows = random.Random(seed), []
    words = [chr(97 + i) + chr(97 + j) + "x" for i in range(12) for j in range(12)]
    head, foot = words[:12], words[20:27]  # a template of twelve lines and one of seven, cut short in some documents
    for d in range(60):
        own = [f"own{chr(97 + d // 26)}{chr(97 + d % 26)}{chr(97 + n)}" for n in range(rng.randrange(4))]
        lines = head[: 12 if d % 3 else 5] + own + (foot[2:] if d % 4 == 0 else foot) * (d % 2)
        rows.append((d, "s" if d < 45 else "t", "\n".join(lines)))
    return rows


def test_sequences_against_brute_force(spark):
    for rows in (rows_of(), many_templates()):
        df = frame(spark, rows)
        single = {(s, key(x)) for s, k in {(s, n) for d, s, t in rows if s for n in [t]} if k for x in k.split("\n") if key(x)}
        often = {k for k in single if len({d for d, s, t in rows if s == k[0] and k[1] in [key(x) for x in (t or "").split("\n")]}) >= max(5, 0.03 * len({d for d, s, _ in rows if s == k[0]}))}
        ids = {r.i: r.k for r in spark.createDataFrame([(k,) for _, k in single], "k string").select("k", b.line_id(F.col("k")).alias("i")).collect()}
        got = {(r.group, tuple(ids[x] for x in r.lines)): r.support for r in mined(df).sequences().collect()}
        assert got == contiguous(rows, often)
    assert max(len(k[1]) for k in got) >= 19  # head, skipped own lines, foot


def test_sequences_with_a_threshold_of_their_own(spark):
    rows = [(d, "s", "\n".join([f"own{chr(97 + d // 26)}{chr(97 + d % 26)}"] + (["rare one", "rare two"] if d < 6 else []) + (["lonely"] if 6 <= d < 12 else []) + ["common"] * (d % 2))) for d in range(100)]
    found = mined(frame(spark, rows), share=0.05)
    together = {(r.item_id, r.line_no) for r in found.marks(alone=0.2).collect()}
    assert {(d, n) for d in range(6) for n in (2, 3)} <= together and not any((d, 2) in together for d in range(6, 12) if d % 2 == 0)
    df = frame(spark, rows)
    clean = {r.doc: r.clean_text for r in b.remove_marked(df, "doc", "body", found.marks(alone=0.2)).collect()}
    assert clean[0] == "ownaa" and clean[6].split("\n")[1] == "lonely" and len(clean) == 100


def test_removal(spark):
    rows = rows_of()
    df = frame(spark, rows).dropDuplicates(["doc"])
    often = b.frequent_lines(texts(df), one_row_a_document=True)
    clean = {r.doc: r.clean_text for r in b.remove_lines(df, "src", "body", often).collect()}
    assert len(clean) == 64 and clean[100] == "Share this story" and clean[101] is None and clean[102] == "" and clean[103] == "Share this story"
    gone = by_hand(rows)
    for d, s, t in rows:
        if s and t:
            assert clean[d] == "\n".join(x for n, x in enumerate(t.split("\n"), 1) if (d, n) not in gone)


def test_empty(spark):
    df = frame(spark, [])
    found = mined(df)
    assert found.lines.count() == 0 and found.marks().count() == 0 and found.sequences().count() == 0
    assert b.remove_lines(df, "src", "body", found.lines).count() == 0


def test_queries_cover_sections(spark, tmp_path):
    share, own = "Share this page", "own words "
    docs = [(i, "s", f"{share}\n{own}{chr(97 + i)}") for i in range(6)]
    sections = [(i, f"d{i}", f"{own}{chr(97 + i)}\n{share} now") for i in range(6)]
    sections += [sections[0], (6, "d6", f"{share} now"), (7, "d0", None), (8, "unknown", f"{share} now")]
    catalog = [(f"d{i}", "b" if i < 6 else None) for i in range(7)]
    for name, rows, schema in (
        ("documents", docs, "doc_id long, source string, text string"),
        ("canonical_section", sections, "section_id long, document_id string, text string"),
        ("catalog_document", catalog + catalog[:2], "document_id string, bundle string"),
    ):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    clean = [tuple(r) for r in q_boilerplate.p3_clean(spark, str(tmp_path)).collect()]
    want = {("documents", i, "s", f"{own}{chr(97 + i)}") for i in range(6)} | {("canonical_section", i, "b", f"{own}{chr(97 + i)}") for i in range(6)}
    want |= {("canonical_section", 6, None, f"{share} now"), ("canonical_section", 7, "b", None), ("canonical_section", 8, None, f"{share} now")}
    assert len(clean) == len(want) and set(clean) == want
    found = q_boilerplate.p3_sequences(spark, str(tmp_path)).collect()
    assert {(r.item_table, r.group, r.length, r.support) for r in found} == {("documents", "s", 1, 6), ("canonical_section", "b", 1, 6)}
