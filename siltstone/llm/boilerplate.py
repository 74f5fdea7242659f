"""Lines repeated across the documents of one source, found as frequent sequences and removed.

Every line becomes an identifier: a hash of its letters, case ignored. The texts are read once, as arrays of identifiers.
Frequent sequences are mined by PrefixSpan for all groups at once: frequent single lines are counted first, the database is
reduced to them (what lies between two frequent lines is skipped, so a sequence has gaps where a document has its own text),
and the projection of a sequence is, in every document's array, the places where it begins. Sequences grow by doubling: runs
of 2^k identifiers are joined with the runs that follow them and counted, until a level has no frequent one. As parts of a
frequent sequence are at least as frequent, these runs bound what can be frequent at each place; the sequences within the
bounds are counted once, and each place takes the longest frequent one, of any length. A round is one narrow pass over the
arrays and one partially aggregated count; support counts distinct documents.

Single lines and sequences of two or more lines can have thresholds of their own: with a lower one for sequences, lines are
found that are rare alone but repeat together. Occurrences of both are marked or deleted.

Defined results: rows of null group or null text hold no repeated line and stay as they are; blank lines and lines without
letters are never repeated lines; copies of a row and a line repeated inside one document count once; ties need no order;
an empty table gives an empty result; other input columns are not used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.plans.materialise import broadcast_if_small, cut

LEAST_DOCUMENTS = 5
LEAST_SHARE = 0.03


def line_id(line: Column) -> Column:
    """64-bit identifier of the line's letters, case ignored; null where it has none."""
    letters = F.regexp_replace(line, r"[^\p{L}]+", "")
    return F.when(letters != "", F.xxhash64(F.lower(letters)))


def line_ids(text: Column) -> Column:
    """Identifier of every line of a text, null for lines without letters."""
    return F.transform(F.split(text, "\n"), line_id)


def identified(rows: DataFrame, group: str, document: str, item_id: str, ids: Column, keep: tuple[str, ...] = ()) -> DataFrame:
    """(*keep, group, document, item_id, ids) of the rows that count in a group: one short row for each text."""
    rows = rows.where(F.col(group).isNotNull() & F.col(document).isNotNull())
    return rows.select(*keep, F.col(group).alias("group"), F.xxhash64(document).alias("document"), F.col(item_id).alias("item_id"), ids.alias("ids"))


def _support(found: DataFrame, by: list[str], what: str, one_row_a_document: bool = False) -> DataFrame:
    """(*by, ``what``, support): number of documents whose arrays ``what`` hold each value."""
    each = found.select(*by, "document", F.explode(F.array_distinct(F.array_compact(what))).alias(what))
    return (each if one_row_a_document else each.distinct()).groupBy(*by, what).agg(F.count("*").alias("support"))


def frequent_lines(texts: DataFrame, by: tuple[str, ...] = ("group",), one_row_a_document: bool = False, least: int = LEAST_DOCUMENTS, share: float = LEAST_SHARE) -> DataFrame:
    """(*by, line, support, documents) of the lines frequent in their group; level one of the search.

    ``one_row_a_document`` spares the shuffle that makes documents distinct. A document without text counts in its group's size.
    """
    by = list(by)
    sizes = cut(texts.groupBy(*by).agg((F.count("*") if one_row_a_document else F.count_distinct("document")).alias("documents")))
    counts = _support(texts.withColumnRenamed("ids", "line"), by, "line", one_row_a_document).where(F.col("support") >= least)
    found = counts.join(broadcast_if_small(sizes), by).where(F.col("support") >= F.lit(share) * F.col("documents"))
    return cut(found.select(*by, "line", "support", "documents"))


def _known(frequent: DataFrame, by: list[str], value: str) -> DataFrame:
    """(*by, known): map of each group's frequent values to their support.

    A value in at least ``share`` of a group's documents leaves at most 1/share times the mean number of lines of a document,
    whatever the number of documents, so a map is bounded.
    """
    return cut(frequent.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct(value, "support"))).alias("known")))


class Sequences:
    """Frequent sequences of ``texts`` (see ``identified``), grown from ``lines`` (see ``frequent_lines``).

    ``places`` has a row for each text: arrays over its frequent lines with the number (line_no) and identifier (lines) of
    each line, and length and support of the longest frequent sequence that begins at it.
    """

    def __init__(self, texts: DataFrame, lines: DataFrame, by: tuple[str, ...] = ("group",), least: int = LEAST_DOCUMENTS, share: float = LEAST_SHARE):
        self.by, self.least, self.share, self.lines = list(by), least, share, lines
        self.limits = cut(lines.groupBy(*by).agg(F.max("documents").alias("documents")))
        rows = texts.where("ids IS NOT NULL").join(broadcast_if_small(_known(lines, self.by, "line")), self.by)
        at = F.filter(F.transform("ids", lambda x, i: F.struct((i + 1).alias("no"), x.alias("id"), F.element_at("known", x).alias("s"))), lambda p: p["s"].isNotNull())
        rows = rows.withColumn("at", at).where(F.size("at") > 0)
        each = lambda f: F.transform("at", lambda p: p[f].cast("long"))
        self.places = self._longest(cut(rows.select(*[c for c in texts.columns if c != "ids"], each("no").alias("line_no"), each("id").alias("lines"))))

    def _frequent(self, rows: DataFrame, run: str) -> DataFrame:
        """Map of each group's frequent values of array column ``run``."""
        found = _support(rows, self.by, run).where(F.col("support") >= self.least).join(broadcast_if_small(self.limits), self.by)
        return _known(found.where(F.col("support") >= F.lit(self.share) * F.col("documents")), self.by, run)

    def _longest(self, places: DataFrame) -> DataFrame:
        # r_k holds, for each place, the identifier of the frequent run of 2^k lines that begins there, or null
        state, k = places.withColumn("r0", F.col("lines")), 0
        while True:
            step, last, new = 1 << k, f"r{k}", f"r{k + 1}"
            joined = F.transform(last, lambda x, i: F.when(x.isNotNull() & F.get(last, i + step).isNotNull(), F.xxhash64(x, F.get(last, i + step))))  # noqa: B023
            grown = state.withColumn(new, joined)
            known = self._frequent(grown, new)
            if known.isEmpty():
                break
            grown = grown.join(broadcast_if_small(known), self.by, "left")
            state, k = cut(grown.withColumn(new, F.transform(new, lambda x: F.when(F.element_at("known", x).isNotNull(), x))).drop("known")), k + 1
        # then: count all sequences that the runs leave possible, and look up the longest frequent one at each place; any
        # beginning of a frequent sequence is frequent, so a binary search over its length finds it
        power = F.transform("r0", lambda x: F.lit(1))
        for j in range(1, k + 1):
            power = F.transform(power, lambda p, i: F.when(F.get(f"r{j}", i).isNotNull(), 1 << j).otherwise(p))  # noqa: B023
        state = state.withColumn("power", power)
        behind = lambda p, i: F.coalesce(2 * F.get("power", i + p) - 1, F.lit(0))
        most = F.transform("power", lambda p, i: F.least(2 * p - 1, F.size("lines") - i, p + behind(p, i)))
        state = cut(state.select(*places.columns, most.alias("most")))
        of = lambda i, m: F.xxhash64(F.slice("lines", i + 1, m))
        tried = F.flatten(F.transform("most", lambda u, i: F.when(u > 1, F.transform(F.sequence(F.lit(2), u), lambda m: of(i, m))).otherwise(F.array().cast("array<long>"))))
        known = self._frequent(state.where(F.array_max("most") > 1).withColumn("tried", tried), "tried")
        single = _known(self.lines, self.by, "line").withColumnRenamed("known", "single")
        found = state.join(broadcast_if_small(single), self.by).join(broadcast_if_small(known), self.by, "left")

        def longest(u: Column, i: Column) -> Column:
            try_more = lambda n, b: F.when((n + b <= u) & F.element_at("known", of(i, n + b)).isNotNull(), n + b).otherwise(n)
            return F.when(u > 1, F.aggregate(F.array(*[F.lit(1 << j) for j in range(k, -1, -1)]), F.lit(1), try_more)).otherwise(1)

        found = found.withColumn("length", F.transform("most", longest))
        support = F.transform("length", lambda n, i: F.when(n > 1, F.element_at("known", of(i, n))).otherwise(F.element_at("single", F.get("lines", i))))
        return cut(found.select(*places.columns, "length", support.alias("support")))

    def marks(self, alone: float | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
        """(*keep, *by, item_id, line_no, line) of every line in an occurrence of a frequent sequence.

        ``alone`` is the share that a sequence of one line needs, if it is more than that of longer ones. A tail of a frequent
        sequence is frequent, so a line lies in one of two or more lines if such a one begins at it or at the line before.
        """
        mark = F.transform("lines", lambda x, i: F.struct(F.get("line_no", i).alias("no"), x.alias("id"), ((F.get("length", i) > 1) | F.coalesce(F.get("length", i - 1) > 1, F.lit(False))).alias("together")))
        rows = self.places
        if alone is None or alone <= self.share:
            return rows.select(*keep, *self.by, "item_id", F.explode(mark).alias("m")).select(*keep, *self.by, "item_id", F.col("m.no").alias("line_no"), F.col("m.id").alias("line"))
        strong = cut(self.lines.where(F.col("support") >= alone * F.col("documents")).groupBy(*self.by).agg(F.collect_set("line").alias("alone")))
        rows = rows.join(broadcast_if_small(strong), self.by, "left")
        kept = F.filter(mark, lambda m: m["together"] | F.coalesce(F.array_contains("alone", m["id"]), F.lit(False)))
        return rows.select(*keep, *self.by, "item_id", F.explode(kept).alias("m")).select(*keep, *self.by, "item_id", F.col("m.no").alias("line_no"), F.col("m.id").alias("line"))

    def sequences(self) -> DataFrame:
        """(*by, lines, length, support, documents) of the longest frequent sequences: those that somewhere are no tail of another."""
        own = F.transform("length", lambda n, i: F.struct(i.alias("i"), n.alias("n"), F.get("support", i).alias("support"), (F.coalesce(F.get("length", i - 1), F.lit(0)) <= n).alias("own")))
        each = self.places.select(*self.by, "lines", F.explode(F.filter(own, lambda p: (p["n"] > 0) & p["own"])).alias("p"))
        each = each.select(*self.by, F.slice("lines", F.col("p.i") + 1, F.col("p.n")).alias("lines"), "p.support").distinct()
        return each.join(broadcast_if_small(self.limits), self.by).select(*self.by, "lines", F.size("lines").alias("length"), "support", "documents")


def sample_texts(rows: DataFrame, group: str, text: str, frequent: DataFrame) -> DataFrame:
    """A readable form of each frequent line: the smallest of its spellings."""
    lines = rows.where(F.col(group).isNotNull()).select(F.col(group).alias("group"), F.explode(F.split(text, "\n")).alias("spelling")).withColumn("line", line_id(F.col("spelling")))
    return lines.join(broadcast_if_small(frequent.select("group", "line")), ["group", "line"]).groupBy("group", "line").agg(F.min(F.trim("spelling")).alias("spelling"))


def remove_lines(rows: DataFrame, group: str, text: str, frequent: DataFrame, to: str = "clean_text") -> DataFrame:
    """``rows`` with column ``to``: the text without its group's frequent lines; nothing is shuffled but the small side.

    Where single lines and sequences have one threshold, a line in a frequent sequence is a frequent line, so this deletes all
    occurrences of both; where sequences have a lower one, ``remove_marked`` deletes what ``Sequences.marks`` found.
    """
    lists = frequent.groupBy(F.col("group").alias("__group")).agg(F.collect_set("line").alias("__lines"))
    joined = rows.join(broadcast_if_small(cut(lists)), F.col(group).eqNullSafe(F.col("__group")), "left")
    kept = F.filter(F.split(text, "\n"), lambda x: ~F.coalesce(F.array_contains("__lines", line_id(x)), F.lit(False)))
    return joined.withColumn(to, F.when(F.col("__lines").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))).drop("__group", "__lines")


def remove_marked(rows: DataFrame, item_id: str, text: str, marks: DataFrame, to: str = "clean_text") -> DataFrame:
    """``rows`` with column ``to``: the text without its marked lines, whose numbers are looked up by item."""
    gone = marks.groupBy(F.col("item_id").alias("__item")).agg(F.collect_set("line_no").alias("__gone"))
    joined = rows.join(broadcast_if_small(cut(gone)), F.col(item_id) == F.col("__item"), "left")
    kept = F.filter(F.transform(F.split(text, "\n"), lambda x, i: F.when(~F.array_contains("__gone", (i + 1).cast("long")), x)), lambda x: x.isNotNull())
    return joined.withColumn(to, F.when(F.col("__gone").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))).drop("__item", "__gone")
