"""Structure-aware chunking: text to blocks, sections, token windows with sentence overlap, parent and child passages.

A document is one row, cut in an Arrow batch on its own; nothing is shuffled. Tokens are estimated as a quarter of the
characters, rounded up. Every non-blank line of the source stands in a child passage or is a heading.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame

# Fixed patterns: lines that open a section, by form; level of numbered headings is the count of their parts.
_ATX = re.compile(r"^(#{1,6})\s+(\S.*)$")
_NUMBERED = re.compile(r"^(\d{1,2}(?:\.\d{1,2}){0,3})\.?\s+([A-Z].{0,80})$")
_LABELLED = re.compile(r"^(?:Chapter|Section|Annex|Appendix|Part)\s+[\dIVXA-Z]{1,4}\b.{0,80}$")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
_FENCE = re.compile(r"^\s*(```|~~~)")
_ROW = re.compile(r"\|.*\|")


@dataclass(frozen=True)
class Sizes:
    """Token sizes of child windows; a bundle may have its own."""

    target: int = 300
    most: int = 400
    least: int = 40
    overlap: int = 40


@dataclass
class Section:
    heading: str = ""
    level: int = 0
    blocks: list[str] = field(default_factory=list)


def tokens(text: str) -> int:
    return -(-len(text) // 4)


def heading_level(line: str, alone: bool) -> int:
    """0 for body; a line of capitals or a short title counts only where it stands alone between blank lines."""
    s = line.strip()
    if m := _ATX.match(s):
        return len(m[1])
    if (m := _NUMBERED.match(s)) and not s.endswith((".", ";", ",")):
        return m[1].count(".") + 1
    if _LABELLED.match(s) and not s.endswith((".", ";", ",")):
        return 1
    if alone and 3 < len(s) <= 80 and not s.endswith((".", ";", ",", ":")):
        words = re.findall(r"[^\W\d_]+", s)
        if words and s.isupper():
            return 2
        if 1 < len(words) <= 9 and sum(w[0].isupper() for w in words if len(w) > 3) == sum(len(w) > 3 for w in words) > 0:
            return 3
    return 0


def blocks_of(text: str) -> Iterator[tuple[str, int]]:
    """(block, heading level): fenced code and runs of table rows stay whole, other blocks are paragraphs."""
    lines = text.replace("\r", "").split("\n")
    held: list[str] = []
    fenced = False

    def flush():
        if held:
            yield "\n".join(held), 0
            held.clear()

    for i, line in enumerate(lines):
        if _FENCE.match(line):
            if not fenced:
                yield from flush()
            fenced = not fenced
            held.append(line)
            if not fenced:
                yield from flush()
        elif fenced:
            held.append(line)
        elif not line.strip():
            yield from flush()
        else:
            alone = (i == 0 or not lines[i - 1].strip()) and (i + 1 == len(lines) or not lines[i + 1].strip())
            level = heading_level(line, alone)
            if level:
                yield from flush()
                yield line.strip(), level
            else:
                if held and bool(_ROW.search(held[-1])) != bool(_ROW.search(line)):
                    yield from flush()
                held.append(line)
    yield from flush()


def sections_of(text: str, least: int) -> list[Section]:
    """Sections in order; a heading without a body folds into the next, a small section into the one before it."""
    found = [Section()]
    for block, level in blocks_of(text):
        if level:
            if found[-1].heading and not found[-1].blocks:
                found[-1].heading += "\n" + block
            else:
                found.append(Section(block, level))
        else:
            found[-1].blocks.append(block)
    found = [s for s in found if s.heading or s.blocks]
    merged: list[Section] = []
    for s in found:
        if merged and s.level >= merged[-1].level and sum(map(tokens, s.blocks)) < least:
            merged[-1].blocks += [s.heading, *s.blocks] if s.heading else s.blocks
        else:
            merged.append(s)
    return merged


def split_to(text: str, most: int) -> list[str]:
    """Pieces of at most ``most`` tokens: at lines, then sentences, then words, then characters."""
    if tokens(text) <= most:
        return [text]
    for cut, glue in ((re.compile(r"\n"), "\n"), (_SENTENCE, " "), (re.compile(r"\s+"), " ")):
        parts = [p for p in cut.split(text) if p]
        if len(parts) > 1:
            out: list[str] = []
            for p in (q for part in parts for q in split_to(part, most)):
                if out and tokens(out[-1] + glue + p) <= most:
                    out[-1] += glue + p
                else:
                    out.append(p)
            return out
    return [text[i : i + 4 * most] for i in range(0, len(text), 4 * most)]


def windows_of(blocks: list[str], sizes: Sizes) -> list[str]:
    """Consecutive blocks packed to the target; a last window that is too small joins the one before where both fit."""
    atoms = [p for b in blocks for p in split_to(b, sizes.most - sizes.overlap)]
    out: list[str] = []
    for a in atoms:
        if out and tokens(out[-1]) < sizes.target and tokens(out[-1] + "\n\n" + a) <= sizes.most - sizes.overlap:
            out[-1] += "\n\n" + a
        else:
            out.append(a)
    if len(out) > 1 and tokens(out[-1]) < sizes.least and tokens(out[-2] + "\n\n" + out[-1]) <= sizes.most - sizes.overlap:
        last = out.pop()
        out[-1] += "\n\n" + last
    return out


def carried(before: str, overlap: int) -> str:
    """Whole sentences from the end of the window before, within the overlap."""
    taken: list[str] = []
    for s in reversed(_SENTENCE.split(before)):
        if tokens(" ".join([s, *taken])) > overlap:
            break
        taken.insert(0, s)
    return " ".join(taken)


def chunk_document(doc_id, text: str | None, sizes: Sizes = Sizes()) -> list[tuple]:
    """Rows (doc_id, chunk_id, parent_chunk_id, is_parent, chunk_index, heading, n_tokens, chunk_text, owned_text).

    A section of several windows has a parent with its whole text. Ids follow from content, so a second run gives the same.
    """
    rows: list[tuple] = []
    seen: dict[str, int] = {}

    def new_id(kind: str, owned: str) -> str:
        digest = hashlib.sha256(owned.encode()).hexdigest()
        seen[kind + digest] = seen.get(kind + digest, -1) + 1
        return hashlib.sha256("\x1f".join((str(doc_id), kind, digest, str(seen[kind + digest]))).encode()).hexdigest()[:32]

    for s in sections_of(text or "", sizes.least):
        windows = windows_of(s.blocks, sizes) if s.blocks else [s.heading]
        parent = None
        if len(windows) > 1:
            whole = "\n\n".join(([s.heading] if s.heading else []) + s.blocks)
            parent = new_id("parent", whole)
            rows.append((doc_id, parent, None, True, len(rows), s.heading, tokens(whole), whole, whole))
        for k, w in enumerate(windows):
            carry = carried(windows[k - 1], sizes.overlap) if k else ""
            body = f"{carry}\n\n{w}" if carry else w
            rows.append((doc_id, new_id("child", w), parent, False, len(rows), s.heading, tokens(body), body, w))
    return rows


_FIELDS = "chunk_id string, parent_chunk_id string, is_parent boolean, chunk_index long, heading string, n_tokens long, chunk_text string, owned_text string"


def chunk(df: DataFrame, doc_id: str, text: Column, sizes: Sizes = Sizes()) -> DataFrame:
    """All passages of all documents; null and blank texts give none."""
    source = df.select(doc_id, text.alias("__text"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [doc_id, *(c.split()[0] for c in _FIELDS.split(", "))]
        for batch in batches:
            yield pd.DataFrame([r for d, t in zip(batch[doc_id], batch["__text"]) for r in chunk_document(d, t, sizes)], columns=names)

    return source.mapInPandas(cut, f"`{doc_id}` {source.schema[doc_id].dataType.simpleString()}, {_FIELDS}")


def classify(text: str) -> str:
    """toc, references, glossary or body, by the share of lines of each form."""
    lines = [x.strip() for x in text.split("\n") if x.strip()]
    if len(lines) < 4:
        return "body"
    share = lambda p: sum(bool(re.search(p, x)) for x in lines) / len(lines)
    if share(r"\.{3,}\s*\d+$|\s{3,}\d+$") >= 0.5:
        return "toc"
    if share(r"\((?:19|20)\d{2}[a-z]?\)|\bdoi\b|^\[\d+\]") >= 0.5:
        return "references"
    return "glossary" if share(r"^[^.:]{2,40}(?::| [-–] )\S?") >= 0.7 else "body"
