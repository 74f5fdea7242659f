"""Noise in the text of scanned pages: broken words, misread characters, running headers, page numbers.

1. Vocabulary. All words of all pages are counted. Words that a scanner may take for each other (fixed confusions such as
   rn/m, cl/d, 0/o, c/e) fold to one form; the commonest word of a form is its reading, much rarer others are misreadings.
2. Layout. The outermost lines of each page are compared inside their document: does the same folded line stand on other
   pages, does a number count up with the pages. Where all lines looked at mark a header or footer, the lines further in are
   looked at too, twice as many each time, until one at each end recurs nowhere. Each line of a page gets one symbol.
3. Labels. A hidden Markov model over the symbols of a page's lines (states break, number, running, body) is fitted by
   Viterbi training on all pages, each distinct sequence of symbols once with its number of pages, and decodes every page.
4. Words. In body lines, words that are misreadings are marked; a word broken at a line's end is joined with the opening of
   the document's next body line, on the next page if need be, and the vocabulary tells whether its hyphen is its own.

The text is read in two Arrow-batched passes and is never shuffled: the first counts words and describes the outermost
lines, the second looks up words and line ends. All that is joined or gathered between them is compact: per word, per outer
line, or per page a string with one letter for each line. Defined results: null and blank pages have no noisy line; a page of
null document is a document of its own; copies of a page count once; the last line of a document is never broken; empty tables
give empty results.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.plans.materialise import broadcast_if_small, cut

#: lines looked at from each end of a page at first
DEPTH = 2
#: all pages together weigh as much as so many against the prior of the model, at every size of the input
TRAIN_WEIGHT = 2000
TRAIN_ROUNDS = 4
#: commonest readings shipped to the decoding tasks; words outside are looked up by join, so the number changes no result
KNOWN_WORDS = 20_000
#: a misreading is at most this share of its reading's count (stricter where all its characters are plain letters)
ODD_SHARE, PLAIN_SHARE = 0.25, 0.04
LEAST_READING = 4
PAGE_BLOCK = 500

# Single characters and then groups that scanning confuses, applied in this order.
SINGLE_FROM = "áàâäãåéèêëíìîïóòôöõúùûüçñ@0519+ich"
SINGLE_TO = "aaaaaaeeeellllooooouuuuenaoslgtleb"
GROUPS = (("rl", "n"), ("ll", "u"), ("rn", "m"), ("el", "d"), ("vv", "w"))
# Fixed pattern: a word, its inner hyphens, points and apostrophes included.
WORD = r"[\p{L}\p{M}\p{N}@+]+(?:[-'’.][\p{L}\p{M}\p{N}@+]+)*"
_WORD = re.compile(r"[\w@+]+(?:[-'’.][\w@+]+)*")
_BREAK = re.compile(r"([\w@+]+(?:-[\w@+]+)*)[-‐¬\xad]\s*$")
_BREAK_MARKS = "-‐¬\xad"
_OPENING = re.compile(r"[\s\"'“‘(\[]*([\w@+]+(?:[-'’.][\w@+]+)*)")
_PUNCTUATION = ".,;:?!()[]\"'“”‘’"
# Fixed pattern: a printed page number alone in its line; scanning takes 1 for l or I and 0 for O.
NUMBER_LINE = re.compile(r"(?i)^[\s\-–—\[\](){}|.·•*_~]*(?:page|pag\.|p\.|seite|página)?[\s\-–—\[\](){}|.·•*_~:]*([0-9lIO]{1,4}|[ivxl]{1,7})(?:\s*(?:of|/|von|de|sur)\s*[0-9lIO]{1,4})?[\s\-–—\[\](){}|.·•*_~]*$")
DECORATED = re.compile(r"(?i)page|pag\.|p\.|seite|[\[\]|]|^\s*[-–—].*[-–—]\s*$")
TRAILING_NUMBER = r"[\s|·•–—\-:,/]*\b(?:page\s*)?[0-9lIO]{1,4}\s*$"
LEADING_NUMBER = r"^\s*[0-9lIO]{1,4}\b[\s|·•–—\-:,/]*"

# symbols of lines and states of the model; a line of text that nothing marks is body
BLANK, NUMBER, ODD_NUMBER, REPEATED, HEADLIKE, TEXT = range(6)
S_BREAK, S_NUMBER, S_RUNNING, S_BODY = range(4)
_LETTERS = "bprt"
_START = np.array([0.05, 0.1, 0.3, 0.55])
_STEP = np.array([[0.1, 0.1, 0.05, 0.75], [0.5, 0.01, 0.15, 0.34], [0.5, 0.02, 0.03, 0.45], [0.14, 0.03, 0.01, 0.82]])
_EMIT = np.array([
    [1.0, 0, 0, 0, 0, 0],
    [0, 0.98, 0.01, 0.005, 0.005, 0],
    [0, 0.002, 0.003, 0.82, 0.175, 0],
    [0, 0.001, 0.01, 0.001, 0.004, 0.984],
])
_PRIOR_WEIGHT = 400.0


def fold(text: Column) -> Column:
    """Letters of ``text`` with everything that scanning confuses made equal."""
    out = F.translate(F.lower(text), SINGLE_FROM, SINGLE_TO)
    out = F.regexp_replace(out, r"[^\p{L}]+", "")
    for a, b in GROUPS:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def letters_only(word: Column) -> Column:
    return F.regexp_replace(F.lower(word), r"[-'’.]", "")


class _Folded(dict):
    """Translation table of ``fold``: what scanning confuses made equal, all but letters dropped; filled as characters come."""

    def __missing__(self, code: int) -> int | None:
        c = chr(code).translate(_TABLE)
        self[code] = ord(c) if c.isalpha() else None
        return self[code]


_TABLE = str.maketrans(SINGLE_FROM, SINGLE_TO)
_FOLDED = _Folded()


def _fold(text: str) -> str:
    """``fold`` of one string."""
    out = text.lower().translate(_FOLDED)
    for a, b in GROUPS:
        out = out.replace(a, b)
    return out


_ROMAN = re.compile(r"(?i)(?:x{0,3})(?:l?)(?:x{0,3})(?:ix|iv|v?i{0,3})$")
_SEEN = (
    "what string, item_table string, item_id long, document string, page int, pattern string, line_no long, from_top int, from_bottom int, number int, roman boolean, decorated boolean, "
    "key string, ruled boolean, repeats boolean, word string, n long"
)
_DIGITS = frozenset("0123456789lLiIoO")


def _number(text: str) -> tuple[int | None, bool]:
    """Value of a printed page number, and whether it is Roman."""
    t = text.lower()
    if _ROMAN.match(t) and t.strip("l"):
        values = [{"i": 1, "v": 5, "x": 10, "l": 50}[c] for c in t]
        return sum(-v if any(w > v for w in values[i + 1 : i + 2]) else v for i, v in enumerate(values)), True
    digits = t.translate(str.maketrans("lio", "110"))
    return (int(digits) if digits.isdigit() else None), False


def _edge(line: str) -> tuple:
    """(number, roman, decorated, key, ruled) of an outermost line."""
    found = NUMBER_LINE.match(line)
    if found:
        return (*_number(found[1]), bool(DECORATED.search(line)), None, False)
    bare = line.strip()
    if bare[-1] in _DIGITS:
        bare = _TRAILING.sub("", bare)
    if bare[:1] in _DIGITS:
        bare = _LEADING.sub("", bare)
    key = _fold(bare)
    return None, False, False, key if len(key) >= 4 else None, bool(_RULED.search(line))


_TRAILING, _LEADING, _RULED = re.compile(TRAILING_NUMBER, re.I), re.compile(LEADING_NUMBER, re.I), re.compile(r"\s[|·•]\s")


def _arrow(schema: str, rows: dict[str, list], what: str) -> pa.RecordBatch:
    """Rows of one sort as an Arrow batch of ``schema``; columns not given are null."""
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    fields = [f.split(" ") for f in schema.split(", ")]
    size = len(next(iter(rows.values())))
    rows = rows | {"what": [what] * size}
    return pa.RecordBatch.from_arrays([pa.array(rows[n], kinds[k]) if n in rows else pa.nulls(size, kinds[k]) for n, k in fields], [n for n, _ in fields])


def _columns(names: tuple[str, ...], rows: list[tuple]) -> dict[str, list]:
    return dict(zip(names, zip(*rows))) if rows else {n: [] for n in names}


_PAGE = ("item_table", "item_id", "document", "page")


def first_pass(pages: DataFrame, depth: int = DEPTH, beyond: int = 0) -> DataFrame:
    """One reading of all texts: rows 'page' (a letter for each line), 'edge' (each of the outermost lines, from ``beyond`` to
    ``depth`` from either end) and 'word' (raw words and their counts in a batch). Only edges with ``beyond``."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter[str] = Counter()
            known: dict[str, tuple] = {}
            edges, patterns = [], []
            of_pages = list(zip(*(batch.column(c).to_pylist() for c in _PAGE)))
            for page, text in zip(of_pages, batch.column("text").to_pylist()):
                lines = _page_lines(text)
                full = [i for i, x in enumerate(lines) if x and not x.isspace()]
                if not beyond:
                    counts.update(text.lower().split())
                    pattern = ["b"] * len(lines)
                    for i in full:
                        pattern[i] = "t"
                    patterns.append("".join(pattern))
                n, keys = len(full), set()
                for k in range(n) if n <= 2 * depth else (*range(depth), *range(n - depth, n)):
                    line = lines[full[k]]
                    edge = known.get(line)
                    if edge is None:
                        edge = known[line] = _edge(line)
                    if min(k, n - 1 - k) >= beyond:
                        edges.append((*page, full[k] + 1, k + 1, n - k, *edge, edge[3] in keys))
                    keys.add(edge[3])
            yield _arrow(_SEEN, _columns((*_PAGE, "line_no", "from_top", "from_bottom", "number", "roman", "decorated", "key", "ruled", "repeats"), edges), "edge")
            if not beyond:
                yield _arrow(_SEEN, _columns(_PAGE, of_pages) | {"pattern": patterns}, "page")
                yield _arrow(_SEEN, {"word": list(counts), "n": list(counts.values())}, "word")

    return pages.select(*_PAGE, "text").mapInArrow(read, _SEEN)


def vocabulary(seen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(word, n, fold) of all words, and (fold, reading, n_reading): the commonest word of each folded form, if seen twice."""
    raw = seen.where("what = 'word'").groupBy(F.col("word").alias("raw")).agg(F.sum("n").alias("n"))
    words = raw.select("n", F.explode(F.regexp_extract_all("raw", F.lit(WORD), 0)).alias("word")).groupBy("word").agg(F.sum("n").alias("n"))
    words = words.where(F.col("word").rlike(r"\p{L}"))
    words = cut(words.withColumn("fold", fold(F.col("word"))).where("fold <> ''"))
    readings = words.where("n >= 2").groupBy("fold").agg(F.max(F.struct("n", "word")).alias("m")).select("fold", F.col("m.word").alias("reading"), F.col("m.n").alias("n_reading"))
    return words, cut(readings)


def misreadings(words: DataFrame, readings: DataFrame) -> DataFrame:
    """(word, reading) of the words that are misreadings of a commoner word."""
    odd = F.col("word").rlike(r"[@+áéíóú]|\p{L}[0-9]|[0-9]\p{L}")
    share = F.when(odd, ODD_SHARE).otherwise(PLAIN_SHARE)
    both = words.join(readings, "fold").where((F.col("n_reading") >= LEAST_READING) & (F.col("n") <= share * F.col("n_reading")) & (F.length("word") >= 3))
    # the hyphen, point or apostrophe of a word is no misread character, and a reading with more odd characters is none
    plain_reading = ~F.col("reading").rlike(r"[@+]|\p{L}[0159]\p{L}")
    return both.where(plain_reading & (letters_only(F.col("word")) != letters_only(F.col("reading")))).select("word", "reading")


def edge_symbols(edges: DataFrame, lengths: DataFrame, titles: DataFrame | None) -> DataFrame:
    """(item_table, item_id, document, line_no, from_top, from_bottom, symbol) of the outermost lines that are more than text.

    ``lengths``: document, pages; ``titles``: document, title; documents are hashed. Counts of a document are looked up from
    small sides: keys and numbers that recur, and titles. A repeated line outranks a headlike one.
    """
    keys = edges.where("key IS NOT NULL").groupBy("document", "key").agg(F.count_if(~F.col("repeats")).alias("same")).where("same >= 2")
    offsets = edges.where("number IS NOT NULL").groupBy("document", "roman", "offset").agg(F.count("*").alias("agreeing")).where("agreeing >= 2")
    rows = edges.join(broadcast_if_small(lengths), "document").join(broadcast_if_small(cut(keys)), ["document", "key"], "left").join(broadcast_if_small(cut(offsets)), ["document", "roman", "offset"], "left")
    headlike = F.col("ruled")
    if titles is not None:
        bare = F.regexp_replace(F.regexp_replace("title", "(?i)" + TRAILING_NUMBER, ""), "(?i)" + LEADING_NUMBER, "")
        wanted = titles.where("title IS NOT NULL").select(F.xxhash64("document").alias("document"), F.xxhash64(fold(bare)).alias("key"), F.lit(True).alias("titled")).distinct()
        rows = rows.join(broadcast_if_small(cut(wanted)), ["document", "key"], "left")
        headlike = headlike | F.coalesce("titled", F.lit(False))
    counted = F.col("agreeing").isNotNull() | F.col("decorated") | (F.col("pages") <= 2) | F.col("roman")
    inner = (F.col("page") > 1) & (F.col("pages") >= 3)
    symbol = (
        F.when(F.col("number").isNotNull(), F.when(counted, NUMBER).otherwise(ODD_NUMBER))
        .when(F.col("same") >= 0.3 * (F.col("pages") - 1), REPEATED)
        .when(inner & headlike, HEADLIKE)
    )
    return rows.select("item_table", "item_id", "document", "line_no", "from_top", "from_bottom", symbol.cast("long").alias("symbol")).where("symbol IS NOT NULL")


def _unbroken(depth: int) -> tuple[Column, Column]:
    """Of the marks of a page: how many lines from the top and from the bottom are marked without a gap, up to ``depth``."""
    upto = lambda side: F.aggregate(F.array_sort(F.transform("marks", lambda m: m[side])), F.lit(0), lambda n, r: F.when(r == n + 1, r).otherwise(n))
    return F.least(F.lit(depth), upto("from_top")), F.least(F.lit(depth), upto("from_bottom"))


def layout(pages: DataFrame, seen: DataFrame, titles: DataFrame | None, depth: int = DEPTH) -> DataFrame:
    """(item_table, item_id, document, page, pattern, marks): every page with line_no and symbol of its marked lines.

    ``seen`` is from ``first_pass``. While every line looked at from an end of some page is marked, those pages are read again,
    twice as far in.
    """
    item = ["item_table", "item_id"]

    def compact(rows: DataFrame) -> DataFrame:
        key = F.when(F.col("key").isNotNull(), F.xxhash64("key")).alias("key")
        names = ["page", "line_no", "from_top", "from_bottom", "number", "roman", "decorated"]
        rows = rows.where("what = 'edge' AND (number IS NOT NULL OR key IS NOT NULL)")
        return cut(rows.select(*item, F.xxhash64("document").alias("document"), *names, key, "ruled", "repeats", (F.col("number") - F.col("page")).alias("offset")))

    whole = seen.where("what = 'page'").select(*_PAGE, "pattern")
    lengths = cut(whole.groupBy(F.xxhash64("document").alias("document")).agg(F.count("*").alias("pages")))
    edges = compact(seen)
    marked = cut(edge_symbols(edges, lengths, titles))
    while True:
        each = marked.groupBy(*item).agg(F.first("document").alias("document"), F.collect_list(F.struct("line_no", "symbol", "from_top", "from_bottom")).alias("marks"))
        top, bottom = _unbroken(depth)
        marks = cut(each.withColumn("top", top).withColumn("bottom", bottom))
        open_pages = cut(marks.where(F.greatest("top", "bottom") >= depth).select(*item, "document"))
        if open_pages.isEmpty():
            break
        further = pages.join(broadcast_if_small(open_pages.drop("document")), item, "left_semi")
        more = compact(first_pass(further, 2 * depth, depth))
        if more.isEmpty():
            break
        # the lines further in are held against all lines of their documents
        edges, depth = edges.unionByName(more), 2 * depth
        own = edges.join(broadcast_if_small(open_pages.select("document").distinct()), "document", "left_semi")
        new = edge_symbols(own, lengths, titles).where(F.least("from_top", "from_bottom") > depth // 2)
        marked = cut(marked.unionByName(new))
    near = lambda m: (F.least(m["from_top"], m["from_bottom"]) <= DEPTH) | (m["from_top"] <= F.col("top")) | (m["from_bottom"] <= F.col("bottom"))
    kept = F.transform(F.filter("marks", near), lambda m: F.struct(m["line_no"].alias("line_no"), m["symbol"].alias("symbol")))
    return whole.join(broadcast_if_small(cut(marks.select(*item, kept.alias("marks")))), item, "left")


def with_symbols(pages: DataFrame) -> DataFrame:
    """Column symbols: the digit of each line's symbol, as one string."""
    plain = F.translate("pattern", "bt", f"{BLANK}{TEXT}")
    at = lambda m: m["line_no"].cast("int")
    put = lambda s, m: F.concat(F.substring(s, F.lit(1), at(m) - 1), m["symbol"].cast("string"), F.substring(s, at(m) + 1, F.length(s)))
    return pages.withColumn("symbols", F.aggregate(F.coalesce("marks", F.array().cast("array<struct<line_no: bigint, symbol: bigint>>")), plain, put)).drop("marks", "pattern")


def _sequence(symbols: str) -> np.ndarray:
    return np.frombuffer(symbols.encode(), np.uint8) - ord("0")


def viterbi(sequences: list[np.ndarray], start: np.ndarray, step: np.ndarray, emit: np.ndarray) -> list[np.ndarray]:
    """Most probable states of many sequences at once, all model arguments in logarithms."""
    lengths = np.array([len(s) for s in sequences])
    order = np.argsort(-lengths, kind="stable")
    longest = int(lengths.max(initial=0))
    n, k = len(sequences), len(start)
    symbols = np.zeros((n, longest), dtype=np.int64)
    for row, i in enumerate(order):
        symbols[row, : lengths[i]] = sequences[i]
    alive = [int(np.searchsorted(-lengths[order], -t, side="left")) for t in range(longest + 1)]  # sequences longer than t
    back = np.zeros((longest, n, k), dtype=np.int8)
    score = start + emit[:, symbols[:, 0]].T if longest else np.zeros((n, k))
    for t in range(1, longest):
        m = alive[t]
        through = score[:m, :, None] + step[None]
        back[t, :m] = through.argmax(axis=1)
        score[:m] = through.max(axis=1) + emit[:, symbols[:m, t]].T
    state = score.argmax(axis=1)
    out = np.zeros((n, longest), dtype=np.int8)
    for t in range(longest - 1, -1, -1):
        m = alive[t]
        out[:m, t] = state[:m]
        if t:
            state[:m] = back[t, np.arange(m), state[:m]]
    found: list[np.ndarray] = [None] * n  # type: ignore[list-item]
    for row, i in enumerate(order):
        found[i] = out[row, : lengths[i]]
    return found


def _logs(*tables: np.ndarray) -> tuple[np.ndarray, ...]:
    with np.errstate(divide="ignore"):
        return tuple(np.log(t / t.sum(axis=-1, keepdims=True)) for t in tables)


def train(distinct: DataFrame, rounds: int = TRAIN_ROUNDS, weight: float = TRAIN_WEIGHT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Viterbi training from the layout prior over all pages; returns logarithms of start, step and emission.

    ``distinct`` (symbols, n) has each sequence of symbols with its number of pages. A round adds up, over tasks, how often each
    start, step and emission was taken: one row of a few dozen numbers.
    """
    shapes = [_START.shape, _STEP.shape, _EMIT.shape]
    width = sum(int(np.prod(x)) for x in shapes)
    total = distinct.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    model = _logs(_START, _STEP, _EMIT)
    for _ in range(rounds if total else 0):

        def taken(batches: Iterator[pd.DataFrame], model: tuple = model) -> Iterator[pd.DataFrame]:
            counts = [np.zeros(x) for x in shapes]
            for batch in batches:
                sequences = [_sequence(x) for x in batch["symbols"]]
                for s, n, states in zip(sequences, batch["n"], viterbi(sequences, *model)):
                    counts[0][states[0]] += n
                    np.add.at(counts[1], (states[:-1], states[1:]), n)
                    np.add.at(counts[2], (states, s), n)
            yield pd.DataFrame([np.concatenate([c.ravel() for c in counts])], columns=[f"c{i}" for i in range(width)])

        sums = distinct.mapInPandas(taken, ", ".join(f"c{i} double" for i in range(width))).agg(*[F.sum(f"c{i}") for i in range(width)]).first()
        flat, at, tables = np.array(list(sums)) * (weight / total), 0, []
        for prior, shape in zip((_START, _STEP, _EMIT), shapes):
            size = int(np.prod(shape))
            tables.append(prior * _PRIOR_WEIGHT + flat[at : at + size].reshape(shape))
            at += size
        model = _logs(*tables)
    return model


def _page_lines(text: str) -> list[str]:
    return text.replace("\r", "").split("\n")


def label_pages(pages: DataFrame) -> DataFrame:
    """(item_table, item_id, document, page, states, noisy): a letter for each line, b(reak), p(age number), r(unning) or t(ext),
    and the numbers of the lines with p or r. ``pages`` is from ``layout``.
    """
    pages = cut(with_symbols(pages))
    model = train(cut(pages.where("symbols <> ''").groupBy("symbols").agg(F.count("*").alias("n"))))

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        letters = np.array(list(_LETTERS))
        for batch in batches:
            once = list(dict.fromkeys(batch["symbols"]))
            states = {x: "".join(letters[s]) for x, s in zip(once, viterbi([_sequence(x) for x in once], *model))}
            noisy = {x: [i for i, c in enumerate(y, 1) if c in "pr"] for x, y in states.items()}
            yield batch.drop(columns="symbols").assign(states=batch["symbols"].map(states), noisy=batch["symbols"].map(noisy))

    return cut(pages.select(*_PAGE, "symbols").mapInPandas(decode, "item_table string, item_id long, document string, page int, states string, noisy array<long>"))


_SECOND = "what string, item_table string, item_id long, line_no long, word string, rests array<struct<line_no: long, word: string>>"
_REST = pa.list_(pa.struct([("line_no", pa.int64()), ("word", pa.string())]))


def second_pass(pages: DataFrame, known: frozenset[str], ahead: int) -> DataFrame:
    """Second reading: rows 'word' and 'first' (a word not known, inside or at the opening of a line), 'broken' (the part of a
    word before a line's end and the openings of the next ``ahead`` lines) and 'top' (the openings of a page's first lines).
    """
    shipped = pages.sparkSession.sparkContext.broadcast(known)
    names = [f.split(" ")[0] for f in _SECOND.split(", ")[:5]] + ["rests"]

    def opening(line: str) -> str | None:
        found = _OPENING.match(line)
        return found[1] if found else None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shipped.value
        unknown: dict[str, tuple] = {}  # of each distinct raw word, the words in it that aren't known
        for batch in batches:
            if len(unknown) > 200_000:
                unknown.clear()
            rows: list[tuple] = []
            for table, item, text in zip(*(batch.column(c).to_pylist() for c in ("item_table", "item_id", "text"))):
                lines = _page_lines(text)
                full = [i for i, x in enumerate(lines) if x and not x.isspace()]
                rows.append(("top", table, item, full[0] + 1 if full else 1, None, [(i + 1, opening(lines[i])) for i in full[:ahead]]))
                for k, i in enumerate(full):
                    raw = lines[i].lower().split()
                    if raw[-1][-1] in _BREAK_MARKS:
                        broken = _BREAK.search(lines[i].split()[-1])
                        if broken:
                            rows.append(("broken", table, item, i + 1, broken[1], [(j + 1, opening(lines[j])) for j in full[k + 1 : k + 1 + ahead]]))
                            raw.pop()
                    for at, x in enumerate(raw):
                        if x in words:
                            continue
                        odd = unknown.get(x)
                        if odd is None:
                            odd = unknown[x] = () if x.strip(_PUNCTUATION) in words else tuple(w for w in _WORD.findall(x) if w not in words and not w.isdigit())
                        for w in odd:
                            rows.append(("word" if at else "first", table, item, i + 1, w, None))
            columns = list(zip(*rows)) if rows else [()] * 6
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), _REST)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return pages.select("item_table", "item_id", "text").mapInArrow(read, _SECOND)


def _furthest(labels: DataFrame) -> int:
    """The most lines of a page in a row, blank ones aside, that aren't body at its top or bottom."""
    count = lambda pattern: F.max(F.length(F.replace(F.regexp_extract("states", pattern, 0), F.lit("b"), F.lit(""))))
    return max(int(x or 0) for x in labels.agg(count("^[brp]*"), count("[brp]*$")).first())


def _next_openings(tops: DataFrame) -> DataFrame:
    """For each page with body lines: the opening of its document's next page that has any.

    ``tops``: item_table, item_id, document (hashed), page, own (line_no, word). A document of very many pages is cut into blocks of
    pages, and the blocks' first openings are followed in the same way.
    """
    opening = F.struct(F.col("item_table").alias("t"), F.col("item_id").alias("i"), F.col("own.line_no").alias("l"), F.col("own.word").alias("w"))
    pages = tops.select("item_table", "item_id", "document", "page", F.floor(F.col("page") / PAGE_BLOCK).alias("block"), opening.alias("own"))
    inside = Window.partitionBy("document", "block").orderBy("page", "item_id")
    heads = pages.groupBy("document", "block").agg(F.min_by("own", F.struct("page", "item_id")).alias("head"))
    heads = heads.withColumn("after_block", F.lead("head").over(Window.partitionBy("document").orderBy("block"))).drop("head")
    led = pages.withColumn("after", F.lead("own").over(inside)).join(heads, ["document", "block"])
    return led.select("item_table", "item_id", F.coalesce("after", "after_block").alias("next"))


def _is_body(line_no: Column) -> Column:
    return F.substring("states", line_no.cast("int"), F.lit(1)) == "t"


def _one_each(pages: DataFrame) -> DataFrame:
    """Each item once: of rows of one item the smallest. Texts are compared only where an item stands on several rows."""
    item = ["item_table", "item_id"]
    many = cut(pages.groupBy(*item).agg(F.count("*").alias("n")).where("n > 1").select(*item))
    if many.isEmpty():
        return pages
    small = broadcast_if_small(many)
    rest = [c for c in ("document", "page", "text") if c in pages.columns]
    one = pages.join(small, item, "left_semi").groupBy(*item).agg(F.min(F.struct(*rest)).alias("m")).select(*item, "m.*")
    return pages.select(*item, *rest).join(small, item, "left_anti").unionByName(one)


def noisy_lines(pages: DataFrame, titles: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Noise (item_table, item_id, line_no, noise_kind), corrections (…, what, word, rest, reading, rest_*), labelled pages.

    ``pages`` has item_table, item_id, document, page, text; ``titles`` (document, title) is optional.
    """
    pages = _one_each(pages.where(F.col("text").isNotNull() & F.col("text").rlike(r"\S")))
    seen = cut(first_pass(pages))
    words, readings = vocabulary(seen)
    wrong = cut(misreadings(words, readings))
    known_rows = readings.where(F.col("n_reading") >= LEAST_READING).orderBy(F.desc("n_reading"), "reading").limit(KNOWN_WORDS).collect()
    item = ["item_table", "item_id"]
    labels = label_pages(layout(pages, seen, titles))
    first_body = F.element_at(F.filter("rests", lambda r: _is_body(r["line_no"])), 1)
    some_body = F.exists("rests", lambda r: _is_body(r["line_no"]))
    found = second_pass(pages, frozenset(r["reading"] for r in known_rows), _furthest(labels) + 1).join(labels, item)
    found = found.where(F.when(F.col("what") == "top", some_body).otherwise(_is_body(F.col("line_no"))))
    found = cut(found.select(*item, "what", "line_no", "word", F.when(some_body, first_body).alias("ahead"), F.when(F.col("what") == "top", F.xxhash64("document")).alias("document"), F.when(F.col("what") == "top", F.col("page")).alias("page")))

    marked = labels.select(*item, "states", F.explode("noisy").alias("line_no"))
    fixed = marked.select(*item, "line_no", F.when(F.substring("states", F.col("line_no").cast("int"), F.lit(1)) == "r", "running").otherwise("page_number").alias("noise_kind"))

    tops = found.where("what = 'top'").withColumnRenamed("ahead", "own")
    ends = found.where("what = 'broken'")
    inside = ends.where("ahead IS NOT NULL").select(*item, "line_no", "word", F.col("ahead.word").alias("rest"), F.col("item_table").alias("rest_table"), F.col("item_id").alias("rest_item"), F.col("ahead.line_no").alias("rest_line"))
    over = ends.where("ahead IS NULL").join(_next_openings(tops), item)
    over = over.select(*item, "line_no", "word", F.col("next.w").alias("rest"), F.col("next.t").alias("rest_table"), F.col("next.i").alias("rest_item"), F.col("next.l").alias("rest_line"))
    broken = inside.unionByName(over).where("rest IS NOT NULL")
    joined = F.lower(F.concat("word", "rest"))
    broken = broken.withColumn("joined", joined).withColumn("fold", fold(joined))
    counts = broadcast_if_small(words.select(F.col("word").alias("joined"), F.col("n").alias("n_joined")))
    broken = broken.join(broadcast_if_small(readings), "fold", "left").join(counts, "joined", "left")
    trusted = F.coalesce(F.col("n_reading") >= 2, F.lit(False))
    own_hyphen = F.when(trusted, F.col("reading").contains("-")).otherwise(F.col("word").contains("-") | ~F.substring("rest", 1, 1).rlike(r"\p{Ll}|[0-9@+]"))
    broken = cut(broken.withColumn("own_hyphen", own_hyphen).withColumn("trusted", trusted))
    hyphens = broken.where("NOT own_hyphen").select(*item, "line_no", F.lit("hyphen").alias("noise_kind"))

    # a word at the opening of a line counts on its own only where it isn't the rest of a broken one
    rests = broken.select(F.col("rest_table").alias("item_table"), F.col("rest_item").alias("item_id"), F.col("rest_line").alias("line_no")).distinct()
    single = found.where("what = 'word'").unionByName(found.where("what = 'first'").join(rests, [*item, "line_no"], "left_anti"))
    misread = single.join(broadcast_if_small(wrong), "word").select(*item, "line_no", "word", "reading")

    # misread characters in a word in two lines: the line of the part that differs from its reading
    off = broken.where(F.col("trusted") & (letters_only(F.col("joined")) != letters_only(F.col("reading"))) & (F.coalesce("n_joined", F.lit(0)) <= ODD_SHARE * F.col("n_reading")))
    plain = letters_only(F.col("reading"))
    first_off = off.where(~F.startswith(plain, letters_only(F.col("word")))).select(*item, "line_no")
    second_off = off.where(~F.endswith(plain, letters_only(F.col("rest")))).select(F.col("rest_table").alias("item_table"), F.col("rest_item").alias("item_id"), F.col("rest_line").alias("line_no"))
    chars = misread.select(*item, "line_no").unionByName(first_off).unionByName(second_off).distinct().withColumn("noise_kind", F.lit("char"))
    noise = fixed.unionByName(chars).unionByName(hyphens)
    none = F.lit(None)
    corrections = misread.select(*item, "line_no", F.lit("word").alias("what"), "word", none.cast("string").alias("rest"), "reading", none.cast("string").alias("rest_table"), none.cast("long").alias("rest_item"), none.cast("long").alias("rest_line"))
    # a word of its own hyphen is put together too, with the hyphen, unless what follows is no rest of a word
    whole = F.when(F.col("trusted"), F.col("reading")).when(F.col("own_hyphen"), F.lower(F.concat("word", F.lit("-"), "rest"))).otherwise(F.col("joined"))
    joins = broken.where(~F.col("own_hyphen") | F.col("trusted") | F.substring("rest", 1, 1).rlike(r"\p{Ll}|[0-9]"))
    joins = joins.select(*item, "line_no", F.lit("broken").alias("what"), "word", "rest", whole.alias("reading"), "rest_table", "rest_item", "rest_line")
    return noise, corrections.unionByName(joins).distinct(), labels


def _cased(original: str, reading: str) -> str:
    """``reading`` in the case of ``original``."""
    if len(original) > 1 and original.isupper():
        return reading.upper()
    return reading[:1].upper() + reading[1:] if original[:1].isupper() else reading


def repair_page(text: str, states: str, fixes) -> str:
    """One page's paragraphs, separated by blank lines: body lines only, words whole and as read.

    A blank line next to a header, footer or page number, or at the page's edge, separates no paragraphs.
    """
    lines = _page_lines(text)
    words: dict[int, dict[str, str]] = {}
    ends: dict[int, tuple[str, str]] = {}
    eaten: dict[int, str] = {}
    for f in fixes if fixes is not None else ():
        if f["what"] == "word":
            words.setdefault(int(f["line_no"]), {})[f["word"]] = f["reading"]
        elif f["what"] == "broken":
            ends[int(f["line_no"])] = (f["word"], f["reading"])
        else:
            eaten[int(f["line_no"])] = f["word"]
    out: list[str] = []
    gap, solid = False, True  # solid: the last line that counts was body
    for i, (line, state) in enumerate(zip(lines, states), 1):
        if state != "t":
            gap, solid = gap or (state == "b" and solid and bool(out)), state == "b" and solid
            continue
        line = line.strip()
        if i in words:
            known = words[i]
            line = _WORD.sub(lambda m: _cased(m[0], known[m[0].lower()]) if m[0].lower() in known else m[0], line)
        if i in ends and ends[i][0] in line:
            line = line[: line.rindex(ends[i][0])] + _cased(ends[i][0], ends[i][1])
        if i in eaten:
            line = line[line.find(eaten[i]) + len(eaten[i]) :].strip() if eaten[i] in line else line
        if gap and solid and out:
            out.append("\n\n")
        elif out and line and line[0] not in ".,;:!?)":
            out.append(" ")
        out.append(line)
        gap, solid = False, True
    return "".join(out).strip()


def paragraphs(pages: DataFrame, labels: DataFrame, corrections: DataFrame) -> DataFrame:
    """(document, pages, text): each document's running text in its order, paragraphs separated by blank lines."""
    item = ["item_table", "item_id"]
    own = corrections.select(*item, "line_no", "what", "word", "reading")
    eaten = corrections.where("what = 'broken'").select(F.col("rest_table").alias("item_table"), F.col("rest_item").alias("item_id"), F.col("rest_line").alias("line_no"), F.lit("eaten").alias("what"), F.col("rest").alias("word"), F.lit(None).cast("string").alias("reading"))
    fixes = own.unionByName(eaten).groupBy(*item).agg(F.collect_list(F.struct("line_no", "what", "word", "reading")).alias("fixes"))
    texts = _one_each(pages.where(F.col("text").isNotNull())).select(*item, "text")
    joined = labels.join(fixes, item, "left").join(texts, item)

    def repair(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch[["item_table", "item_id", "document", "page"]].copy()
            out["text"] = [repair_page(t, s, f) for t, s, f in zip(batch["text"], batch["states"], batch["fixes"])]
            yield out

    fixed = joined.select(*item, "document", "page", "text", "states", "fixes").mapInPandas(repair, "item_table string, item_id long, document string, page int, text string")
    ordered = fixed.where("text <> ''").groupBy("document").agg(F.sort_array(F.collect_list(F.struct("page", "item_id", "text"))).alias("p"))

    def with_glue(p: Column, i: Column) -> Column:
        before = F.get("p", i - 1)["text"]
        glue = F.when(i == 0, "").when(before.rlike(r"[.!?:][\"'”’)]*$"), "\n\n").when(p["text"].rlike(r"^[.,;:!?)]"), "").otherwise(" ")
        return F.concat(glue, p["text"])

    return ordered.select("document", F.size("p").cast("long").alias("pages"), F.array_join(F.transform("p", with_glue), "").alias("text"))
