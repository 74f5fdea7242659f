"""Text quality statistics of each document, and combined rules that tell prose from lists, tables and junk.

The statistics are counted over the whole text in one Arrow-batched pass without a shuffle: string counts, shares of
characters by line form, repetition of lines, paragraphs and word n-grams. (The same statistics as JVM regular expressions
were measured first and took 2.2 CPU seconds a MB of text, ten times as much.) The rules are column expressions over the
statistics; their limits are fitted to a bounded sample of labelled documents.

Defined results: null text counts as blank; blank text has zero statistics and is junk; an unknown or null language is held
against the common words of all known languages; rows repeated in full give one row, an id with several texts gives one for
each; without labels the limits are the prior ones; other input columns are not used.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The commonest words of running text, by language.
COMMON_WORDS = {
    "en": "the of and to in a is that for it as was with be by on not he this are or his from at which but have an had they you were their one all we can her has there been if more when will would who so no out up into than them its could only other about these may then do any what some our should between after before how while under both over per also because where",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde wurden hatte kann gegen vom können wenn weil ob ohne sollen damit keine diese dieser",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec son ont été aux ses cette mais comme ou si leur y dont tout nous sa fait elle deux même ces entre sans ils peut après selon car être afin d l n s qu c",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy años hasta desde está mi porque qué sólo han yo hay puede todos así nos ni parte tiene según",
}
# Fixed patterns: the form of a line.
BULLET = re.compile(
    r"[ \t\xa0]*(?:[-*•·–—‣▪o>#+][ \t]|\[[ xX]?\][ \t]|\(?[a-z]\)[ \t]|\(?\d{1,3}[.)][ \t]|\(\d{1,3}\)[ \t]|\d+(?:\.\d+)+[ \t]|\(?[ivx]{1,4}\)[ \t]|https?://\S+$)"
)
LEADER = re.compile(r"\.{4,}[ \t]*\d+[ \t]*$")
_CELL = r"(?:-|n\.a\.|\d[\d.,]*%?)"
TABLE_ROW = re.compile(
    rf"\t.*\S|\|.*\||\S {{2,}}\S.* {{2,}}\S|;[^;\s]*\d[^;\s]*(?:;|$)|;[ \t]*{_CELL}[ \t]*(?:;|$)|: {_CELL} / |(?:\||[ \t]{{2,}})[ \t]*{_CELL}[ \t]*\|?$|^\|"
)
#: a line without any of these can't match TABLE_ROW
_TABLE_SIGNS = ("\t", "|", ";", "  ", " / ")
#: a line is punctuated if one of the first stands at its end, closing signs of the second aside
_STOPS, _CLOSERS = frozenset(".!?…;:"), "\"'”»)]"
SENTENCE_END = re.compile(r"[\w%)][.!?][\"”»)]?$")
_ENDS = frozenset(".!?\"”»)")
_EDGES = ".,;:!?…\"'()[]«»“”"
_PARAGRAPH = re.compile(r"\n[ \t]*\n")
#: limits of the rules before they are fitted to labels, see ``fit_limits``
LIMITS = {
    "table_share": 0.36, "list_share": 0.32, "leader_share": 0.2, "least_sentences": 0.02, "most_sentences": 0.1, "broken_share": 0.003,
    "code_share": 0.012, "symbol_ratio": 0.05, "digit_share": 0.095, "mean_word_length": 7.6, "single_share": 0.1, "least_words": 5, "repeated_ngram": 0.5,
    "repeated_lines": 0.5, "repeated_paragraphs": 0.5, "least_punctuated": 0.03,
}
NGRAM = 3
#: most labelled documents that limits are fitted to
LABELLED = 5000

NAMES = (
    "mean_word_length", "symbol_ratio", "digit_share", "punctuated_line_share", "common_word_share", "sentence_ends_per_word", "single_share", "code_share",
    "broken_share", "list_share", "leader_share", "table_share", "mean_line_length", "duplicate_line_share", "duplicate_paragraph_share", "top_ngram_share",
)
_COMMON = {lang: frozenset(words.split()) for lang, words in COMMON_WORDS.items()}
_KNOWN = frozenset().union(*_COMMON.values())


def _classes() -> np.ndarray:
    """Class of each code point: 1 letter, 2 digit, 3 code sign, 4 sign of broken encoding, 0 other."""
    table = np.zeros(0x110000, np.uint8)
    table[[i for i in range(0x110000) if chr(i).isalpha()]] = 1
    table[[i for i in range(0x110000) if chr(i).isdecimal()]] = 2
    table[[ord(c) for c in "{}=<>;"]] = 3
    table[0xFFFD] = 4
    return table


@lru_cache(maxsize=1)
def _table() -> np.ndarray:
    return _classes()


def _top_ngram_share(tokens: list[str], lengths: list[int], chars: int, n: int) -> float:
    """Characters covered by the commonest run of n words that occurs at least twice, as a share of all word characters."""
    if len(tokens) < n + 1:
        return 0.0
    h = np.fromiter(map(hash, tokens), np.int64, len(tokens)).astype(np.uint64)
    grams = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        grams *= np.uint64(0x9E3779B97F4A7C15)
        grams += h[k : len(h) - n + 1 + k]
    order = np.argsort(grams)
    ordered = grams[order]
    begins = np.concatenate(([0], np.flatnonzero(ordered[1:] != ordered[:-1]) + 1))
    runs = np.diff(np.concatenate((begins, [len(order)])))
    top = int(runs.max())
    if top < 2:
        return 0.0
    # among equally common runs the widest counts, so that the result doesn't hang on hash values
    upto = np.concatenate(([0], np.cumsum(lengths)))
    width = int((upto[n:] - upto[:-n])[order[begins[runs == top]]].max())
    return min(1.0, top * width / chars)


def statistics_of(text: str | None, lang: str | None, n: int = NGRAM) -> tuple:
    """(n_words, n_lines, *NAMES) of one text."""
    t = (text or "").replace("\r", "")
    tokens = t.split()
    n_words = len(tokens)
    if not n_words:
        return (0, 0, *[0.0] * len(NAMES))
    lengths = list(map(len, tokens))
    chars = sum(lengths)
    kinds = _table()[np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)]
    letter = kinds == 1
    letters, digits, code = int(np.count_nonzero(letter)), int(np.count_nonzero(kinds == 2)), int(np.count_nonzero(kinds == 3))
    letter_runs = max(1, int(np.count_nonzero(letter[1:] & ~letter[:-1])) + int(letter[0]))
    broken = int(np.count_nonzero(kinds == 4)) + sum(map(t.count, ("Ã", "â€", "ï¿", "Â")))
    ends = sum(1 for x in tokens if x[-1] in _ENDS and SENTENCE_END.search(x))
    listed = _COMMON.get(lang.lower() if lang else "", _KNOWN)
    common = sum(1 for x in t.lower().split() if x in listed or x.strip(_EDGES) in listed)
    lines = [x for x in t.split("\n") if x and not x.isspace()]
    line_chars = sum(map(len, lines))
    signs = [x for x in _TABLE_SIGNS if x in t]
    leads = "...." in t
    bullets = leaders = rows = punctuated = 0
    for x in lines:
        if BULLET.match(x):
            bullets += len(x)
        if leads and "...." in x and LEADER.search(x):
            leaders += len(x)
        for y in signs:
            if y in x:
                if TABLE_ROW.search(x):
                    rows += len(x)
                break
        y = x.rstrip()
        if y[-1] not in _STOPS:
            y = y.rstrip(_CLOSERS)
        if y and y[-1] in _STOPS:
            punctuated += 1
    n_lines = len(lines)
    paragraphs = [x for x in _PARAGRAPH.split(t) if x and not x.isspace()]
    return (
        n_words, n_lines, chars / n_words, max(0.0, (chars - letters - digits) / chars), digits / chars, punctuated / n_lines, common / n_words, ends / letter_runs,
        lengths.count(1) / n_words, code / chars, broken / chars,
        bullets / line_chars, leaders / line_chars, rows / line_chars, line_chars / n_lines, 1 - len(set(lines)) / n_lines, 1 - len(set(paragraphs)) / len(paragraphs),
        _top_ngram_share(tokens, lengths, chars, n),
    )


def statistics(df: DataFrame, doc_id: str, text: Column, lang: Column, ngram: int = NGRAM) -> DataFrame:
    """One row of statistics for each document id; shares are of characters, lines or words as their names say."""
    columns = ["n_words", "n_lines", *NAMES]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = pd.DataFrame([statistics_of(t, g, ngram) for t, g in zip(batch["t"], batch["g"])], columns=columns)
            out.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield out

    source = df.select(F.col(doc_id).alias("doc_id"), text.alias("t"), lang.alias("g"))
    schema = f"doc_id {source.schema['doc_id'].dataType.simpleString()}, n_words long, n_lines long, " + ", ".join(f"{c} double" for c in NAMES)
    return source.mapInPandas(count, schema).distinct()


def _rules(c, x, any_of, all_of, neither):
    """(condition, kind) in order, over columns or arrays alike; what meets none is junk. ``c`` gives a statistic, ``x`` a limit."""
    prose_like = all_of(c("sentence_ends_per_word") >= x("least_sentences"), c("sentence_ends_per_word") <= x("most_sentences"))
    plain = all_of(c("code_share") < x("code_share"), c("symbol_ratio") < x("symbol_ratio"), c("digit_share") < x("digit_share"))
    worded = all_of(c("mean_word_length") < x("mean_word_length"), c("single_share") < x("single_share"), c("n_words") >= x("least_words"))
    repeated = any_of(c("top_ngram_share") >= x("repeated_ngram"), all_of(c("n_lines") >= 5, c("duplicate_line_share") >= x("repeated_lines")), c("duplicate_paragraph_share") >= x("repeated_paragraphs"))
    boilerplate = all_of(repeated, c("n_words") > 20)
    loose = all_of(c("punctuated_line_share") < x("least_punctuated"), c("n_lines") >= 5)
    by_line = all_of(c("mean_line_length") < 110, c("n_lines") >= 5, c("common_word_share") < 0.35)
    table = c("table_share") >= x("table_share")
    listed = c("list_share") >= x("list_share")
    return (
        (c("n_words") == 0, "junk"),
        (any_of(c("broken_share") >= x("broken_share"), c("symbol_ratio") >= 0.6), "junk"),
        (all_of(c("single_share") >= 0.6, neither(table)), "junk"),
        (all_of(c("mean_word_length") >= 30, neither(listed)), "junk"),
        (all_of(table, c("code_share") < 0.15), "table"),
        (any_of(listed, c("leader_share") >= x("leader_share")), "list"),
        (all_of(prose_like, plain, worded, neither(boilerplate), neither(loose)), "prose"),
        (all_of(c("sentence_ends_per_word") > x("most_sentences"), c("symbol_ratio") < 0.3), "list"),
        (all_of(by_line, c("digit_share") >= 0.04, c("symbol_ratio") < 0.15), "list"),
    )


def with_kind(stats: DataFrame, limits: dict[str, float] = LIMITS) -> DataFrame:
    """Add text_kind: prose, list, table or junk, by rules over several statistics at once."""
    every = lambda *p: reduce(lambda a, b: a & b, p)
    some = lambda *p: reduce(lambda a, b: a | b, p)
    kind = F
    for condition, name in _rules(F.col, limits.__getitem__, some, every, lambda p: ~p):
        kind = kind.when(condition, name)
    return stats.withColumn("text_kind", kind.otherwise("junk"))


def kinds_of(stats: pd.DataFrame, limits: dict[str, float]) -> np.ndarray:
    """``with_kind`` of a small frame."""
    rules = _rules(lambda c: stats[c].to_numpy(), limits.__getitem__, lambda *p: np.logical_or.reduce(p), lambda *p: np.logical_and.reduce(p), np.logical_not)
    return np.select([c for c, _ in rules], [k for _, k in rules], "junk")


def _errors(stats: pd.DataFrame, truth: np.ndarray, limits: dict[str, float]) -> int:
    """Wrong kinds; prose taken for something else, or the reverse, counts ten times."""
    got = kinds_of(stats, limits)
    return int((got != truth).sum() + 9 * ((got == "prose") != (truth == "prose")).sum())


def fit_limits(stats: pd.DataFrame, truth: np.ndarray, prior: dict[str, float] = LIMITS, least_gain: float = 0.002, rounds: int = 3) -> dict[str, float]:
    """Limits fitted to labelled rows, one at a time from the ``prior``.

    A limit moves, to the middle of the best range between half and twice the prior, only where that spares at least 3
    errors and ``least_gain`` of the rows; so labels that the prior explains leave it as it is.
    """
    limits, needed = dict(prior), max(3.0, least_gain * len(truth))
    least = _errors(stats, truth, limits)
    for _ in range(rounds):
        moved = False
        for name, start in prior.items():
            if least < needed:
                return limits
            tried = np.geomspace(start / 2, start * 2, 25)
            errors = np.array([_errors(stats, truth, limits | {name: float(v)}) for v in tried])
            if least - errors.min() >= needed:
                at = np.flatnonzero(errors == errors.min())
                limits[name], least, moved = float(tried[at[len(at) // 2]]), int(errors.min()), True
        if not moved:
            break
    return limits


def labelled_sample(stats: DataFrame, labels: DataFrame, most: int = LABELLED) -> tuple[pd.DataFrame, np.ndarray]:
    """Statistics and kinds of at most ``most`` labelled documents, those of smallest hash; of two labels the later counts.

    ``labels``: doc_id, text_kind, labelled_at.
    """
    last = labels.where("text_kind IS NOT NULL").groupBy("doc_id").agg(F.max(F.struct("labelled_at", "text_kind"))["text_kind"].alias("truth"))
    one = stats.join(last, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).toPandas()
    return one.drop(columns="truth"), one["truth"].to_numpy()
