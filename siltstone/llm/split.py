"""Oversized texts cut into overlapping pieces at natural boundaries.

Whether a text is over its limit is decided first, by one bounded-quantifier pattern that stops at the first unit too many
and is not tried on texts too short to have so many. Only an oversized text becomes an array of units (words with their
trailing white space) and a code string with one letter a unit that says how strong a boundary follows it. A bounded
pattern over the code string, its alternatives ordered by boundary strength, takes as many units as fit up to the strongest
boundary in reach and falls back to a cut after any unit. Every repetition is possessive or over single characters, so
matching never recurses. Piece offsets are running sums of the matches; the overlap looks back from each offset with
``slice``. All steps are SQL string and array functions, and no step shuffles.

A unit is a word, or a run of at most ``longest_word`` characters of a longer one: so a text without white space is cut by
characters, however few words it has. Defined results: null text gives no piece; text of white space only, or of no more
units than the limit, gives itself as one piece; repeated rows give repeated pieces; columns of the input other than those
named are not used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Unicode white space, as a regular-expression class body
WHITE = r"\t-\r \x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: characters of one unit; a longer word is cut into several
LONGEST_WORD = 400

# printable ASCII is tried before the full classes, which are slow
_WORD = rf"(?:[!-~]++[^{WHITE}]*+|[^{WHITE}]++)"
_GAP = rf"(?: ++[{WHITE}]*+|[{WHITE}]++)"
_PLAIN = r"^[A-Za-z0-9,'()-]++ $"
_BREAK = r"[\n\x{2028}\x{2029}\x{0085}]"
_PARAGRAPH = rf"\n[{WHITE}]*\n|\x{{2029}}"
_SENTENCE = rf"[.!?\x{{2026}}\x{{3002}}\x{{FF01}}\x{{FF1F}}][\"')\]\x{{201D}}\x{{2019}}\x{{00BB}}]*[{WHITE}]*$"


def _unit(longest_word: int) -> str:
    """A unit: it ends where the word ends or at its ``longest_word``-th character."""
    return rf"(?:[!-~]{{1,{longest_word}}}+(?![^{WHITE}])|[^{WHITE}]{{1,{longest_word}}}+)"


def word_count(text: Column) -> Column:
    """Longest runs of characters that are not Unicode white space; no array of words is built."""
    marks = F.regexp_replace(text, rf"[{WHITE}]*+{_WORD}(?:[{WHITE}]++\z)?+", "x")
    return F.when(text.rlike(rf"[^{WHITE}]"), F.length(marks)).when(text.isNotNull(), 0)


def over_limit(text: Column, limit: Column, limits: list[int], longest_word: int = LONGEST_WORD) -> Column:
    """Whether a text has more units than its limit, which is one of ``limits``: it needs two bytes for each but the last."""
    tests = [F.when(limit == n, text.rlike(rf"^[{WHITE}]*+(?:{_unit(longest_word)}[{WHITE}]*+){{{n}}}+[^{WHITE}]")) for n in sorted(set(limits))]
    return (F.octet_length(text) > 2 * limit) & F.coalesce(*tests) if min(limits) > 0 and longest_word > 1 else F.coalesce(*tests)


def boundary_pattern(fresh: int) -> str:
    """Alternatives: the rest if it fits; the strongest of p(aragraph), l(ine), s(entence) in the far half of the reach; in the near half; any word."""
    half = max(1, fresh // 2)
    far = [f"[plsw]{{{half - 1},{fresh - 1}}}{c}" for c in ("p", "[pl]", "[pls]")]
    near = [f"[plsw]{{0,{half - 1}}}{c}" for c in ("p", "[pl]", "[pls]")]
    return "|".join([f"[plsw]{{1,{fresh}}}$", *far, *near, f"[plsw]{{1,{fresh}}}"])


def _blocks(n: Column) -> Column:
    """Array ``n`` in blocks of about the root of its length."""
    block = F.ceil(F.sqrt(F.size(n))).cast("int")
    return F.transform(F.sequence(F.lit(0), F.greatest(block - 1, F.lit(0))), lambda b: F.slice(n, b * block + 1, block))


def _total(n: Column) -> Column:
    return F.aggregate(n, F.lit(0), lambda acc, x: acc + x)


def _with_running_sums(df: DataFrame, n: str, to: str) -> DataFrame:
    """Sums of all elements before each one, first over blocks, then inside them, so that the work isn't quadratic."""
    df = df.withColumn("__blocks", _blocks(F.col(n)))
    df = df.withColumn("__sums", F.transform("__blocks", _total))
    df = df.withColumn("__bases", F.transform("__sums", lambda _, b: _total(F.slice("__sums", 1, b))))
    inside = F.transform("__blocks", lambda a, b: F.transform(a, lambda _, i: F.element_at("__bases", b + 1) + _total(F.slice(a, 1, i))))
    return df.withColumn(to, F.flatten(inside)).drop("__blocks", "__sums", "__bases")


def pieces(
    df: DataFrame, item_id: str, text: Column, limit: Column | int, limits: list[int], overlap: int = 60, longest_word: int = LONGEST_WORD, keep: tuple[str, ...] = (), only_cut: bool = False
) -> DataFrame:
    """Pieces (item_id, *keep, n_words, piece_no from 1, first_word, own_words, piece_words, piece_text) of every text.

    ``limit`` is the most units of a piece, one of ``limits`` for each row. Every piece but the first begins with the last
    ``overlap`` units before it, so at most limit - overlap units of a piece are its own. ``keep`` names columns that every
    piece carries; with ``only_cut`` texts within the limit are left out. Each text is looked at once.
    """
    if min(limits) <= overlap:
        raise ValueError("the limit must exceed the overlap")
    limit = F.lit(limit) if isinstance(limit, int) else limit
    base = df.select(F.col(item_id).alias("item_id"), *keep, text.alias("t"), limit.cast("int").alias("limit")).where(F.col("t").isNotNull())
    over = over_limit(F.col("t"), F.col("limit"), limits, longest_word)
    base = base.where(over).withColumn("over", F.lit(True)) if only_cut else base.withColumn("over", over)
    if_over = lambda c: F.when(F.col("over"), c)

    units = F.regexp_extract_all("t", F.lit(f"{_unit(longest_word)}[{WHITE}]*+"), 0)
    lead = F.regexp_extract(F.col("t"), f"^[{WHITE}]*", 0)
    cut = base.withColumn("n_words", word_count(F.col("t"))).withColumn("w", if_over(units)).withColumn("lead", if_over(lead))
    code = F.transform("w", lambda x: F.when(x.rlike(_PLAIN), "w").when(x.rlike(_BREAK), F.when(x.rlike(_PARAGRAPH), "p").otherwise("l")).when(x.rlike(_SENTENCE), "s").otherwise("w"))
    runs = F.coalesce(*[F.when(F.col("limit") == n, F.regexp_extract_all(F.array_join(code, ""), F.lit(boundary_pattern(n - overlap)), 0)) for n in sorted(set(limits))])
    cut = cut.withColumn("own", if_over(F.transform(runs, lambda r: F.length(r))))
    cut = _with_running_sums(cut, "own", "before")

    def piece(n: Column, k: Column) -> Column:
        before = F.element_at("before", k + 1)
        back = F.least(F.lit(overlap), before)
        own = F.array_join(F.slice("w", before - back + 1, n + back), "")
        return F.struct((before + 1).alias("first"), n.alias("n"), (n + back).alias("all"), F.concat(F.when(k == 0, F.col("lead")).otherwise(""), own).alias("text"))

    whole = F.array(F.struct(F.lit(1).alias("first"), F.col("n_words").alias("n"), F.col("n_words").alias("all"), F.col("t").alias("text")))
    found = F.transform("own", piece) if only_cut else F.when(F.col("over"), F.transform("own", piece)).otherwise(whole)
    cut = cut.select("item_id", *keep, "n_words", F.posexplode(found).alias("k", "p"))
    return cut.select(
        "item_id", *keep, "n_words", (F.col("k") + 1).cast("long").alias("piece_no"), F.col("p.first").cast("long").alias("first_word"), F.col("p.n").cast("long").alias("own_words"),
        F.col("p.all").cast("long").alias("piece_words"), F.col("p.text").alias("piece_text"),
    )


def oversized(df: DataFrame, item_id: str, text: Column, limit: Column | int, limits: list[int], overlap: int = 60) -> DataFrame:
    """Ids of the items of more words than their limit: those cut into pieces, checked by their number of words."""
    rows = df.withColumn("__limit", limit if isinstance(limit, Column) else F.lit(limit))
    many = pieces(rows, item_id, text, limit, limits, overlap, keep=("__limit",), only_cut=True)
    return many.where("piece_no = 2 AND n_words > __limit").select("item_id").distinct()
