"""Mixed timestamp notations, precisions and zones brought to one UTC instant or one dated period.

All notations are alternatives of one anchored regular expression with named groups. A single ``regexp_replace`` with
named references turns a value into its components, so the pattern runs once per value. Ranges are then checked, and
the instant is assembled from whole days since 1970 by integer arithmetic. Everything stays in JVM expressions.

Defined results: null, blank, unknown words, bare dates, impossible or placeholder values, local times without a known
zone, local times a zone skipped, and (without an offset) local times a zone passed twice give no instant. Extra columns
of the input are kept as they are; the new columns are written under the names asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.plans.materialise import cut

# Month names in English, German, French and Spanish, by month.
MONTH_NAMES = (
    ("january", "jan", "januar", "jänner", "janvier", "janv", "enero", "ene"),
    ("february", "feb", "februar", "février", "fevrier", "févr", "fevr", "febrero"),
    ("march", "mar", "märz", "maerz", "mrz", "mär", "mars", "marzo"),
    ("april", "apr", "avril", "avr", "abril", "abr"),
    ("may", "mai", "mayo"),
    ("june", "jun", "juni", "juin", "junio"),
    ("july", "jul", "juli", "juillet", "juil", "julio"),
    ("august", "aug", "août", "aout", "agosto", "ago"),
    ("september", "sep", "sept", "septembre", "septiembre", "setiembre"),
    ("october", "oct", "oktober", "okt", "octobre", "octubre"),
    ("november", "nov", "novembre", "noviembre"),
    ("december", "dec", "dezember", "dez", "décembre", "decembre", "déc", "diciembre", "dic"),
)

# Minutes east of UTC of the zone abbreviations that are understood.
ABBREVIATIONS = {
    "Z": 0, "UT": 0, "UTC": 0, "GMT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "MEZ": 60, "CEST": 120, "MESZ": 120,
    "EET": 120, "EEST": 180, "MSK": 180, "IST": 330, "NPT": 345, "JST": 540, "AEST": 600, "AEDT": 660,
    "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
}

_SPACE = r"[\s\x{00A0}\x{2009}\x{202F}]"
_MARK = "\u0001"
_PART = "|"


def _time(n: int) -> str:
    """Clock time, fraction, half-day mark and zone, for notation ``n``."""
    return (
        rf"(?<h{n}>\d{{1,2}}):(?<i{n}>\d{{2}})(?::(?<s{n}>\d{{2}})(?:[.,]\d{{1,9}})?)?"
        rf"(?:{_SPACE}*(?<p{n}>[ap])\.?m\.?(?![A-Za-z]))?"
        rf"(?:{_SPACE}*(?:(?<o{n}>[+-]\d{{2}}:?\d{{2}})|(?<z{n}>[A-Za-z]+(?:/[A-Za-z0-9_+-]+)+)|(?<a{n}>[A-Za-z]{{1,5}})))?"
        rf"(?:\[(?<b{n}>[A-Za-z0-9_/+-]+)\])?"
    )


_NOTATIONS = (
    r"(?<e0>\d{9,13})",
    r"(?<y1>\d{4})(?<m1>\d{2})(?<d1>\d{2})(?:T?(?<h1>\d{2})(?<i1>\d{2})(?<s1>\d{2})?(?:(?<a1>Z)|(?<o1>[+-]\d{2}:?\d{2}))?)?",
    r"D:(?<y2>\d{4})(?:(?<m2>\d{2})(?:(?<d2>\d{2})(?:(?<h2>\d{2})(?<i2>\d{2})(?<s2>\d{2})?"
    r"(?:(?<a2>Z)(?:00'?(?:00'?)?)?|(?<o2>[+-]\d{2}'?\d{2})'?)?)?)?)?",
    rf"(?<y3>\d{{4}})-(?<m3>\d{{1,2}})(?:-(?<d3>\d{{1,2}})(?:(?:T|{_SPACE}+){_time(3)})?)?",
    rf"(?<d4>\d{{1,2}})\.(?<m4>\d{{1,2}})\.(?<y4>\d{{4}})(?:,?{_SPACE}+{_time(4)})?",
    rf"(?<f5>\d{{1,2}})/(?<g5>\d{{1,2}})/(?<y5>\d{{4}})(?:,?{_SPACE}+{_time(5)})?",
    r"(?<m6>\d{1,2})/(?<y6>\d{4})",
    rf"(?:\p{{L}}{{2,10}}\.?,?{_SPACE}+)?(?<d7>\d{{1,2}})\.?{_SPACE}+(?<n7>\p{{L}}{{3,10}})\.?{_SPACE}+(?<y7>\d{{4}})"
    rf"(?:,?(?:{_SPACE}+(?:à|at|um|a las))?{_SPACE}+{_time(7)})?",
    rf"(?<n8>\p{{L}}{{3,10}})\.?{_SPACE}+(?:(?<d8>\d{{1,2}}),{_SPACE}*)?(?<y8>\d{{4}})(?:,?{_SPACE}+{_time(8)})?",
    r"(?<y9>\d{4})",
)

#: component letter -> notations that have it
_HAS = {c: [n for n, p in enumerate(_NOTATIONS) if f"(?<{c}{n}>" in p] for c in "eymdnfghispozab"}

PATTERN = rf"(?isu)^{_SPACE}*(?:" + "|".join(_NOTATIONS) + rf"){_SPACE}*$"
_REPLACEMENT = _MARK + _PART.join("".join(f"${{{c}{n}}}" for n in ns) for c, ns in _HAS.items())


def _int(c: Column) -> Column:
    return F.when(c != "", c).cast("long")


def components(value: Column) -> Column:
    """One struct of the value's written parts (strings, empty where absent); null where no notation fits."""
    joined = F.regexp_replace(value, PATTERN, _REPLACEMENT)
    ok = joined.startswith(_MARK) & ~value.startswith(_MARK)
    return F.when(ok, F.split(F.substring(joined, 2, 1 << 20), r"\|", -1))


def _part(parts: Column, letter: str) -> Column:
    return parts[list(_HAS).index(letter)]


def days_from_civil(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01 of a proleptic Gregorian date, by whole-number arithmetic only."""
    floor = lambda a, b: F.floor(a / F.lit(b)).cast("long")
    shifted = y - F.when(m <= 2, 1).otherwise(0)
    era = floor(shifted, 400)
    yoe = shifted - era * 400
    doy = floor((m + F.when(m > 2, -3).otherwise(9)) * 153 + 2, 5) + d - 1
    return era * 146097 + yoe * 365 + floor(yoe, 4) - floor(yoe, 100) + doy - 719468


def _days_in_month(y: Column, m: Column) -> Column:
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    return F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)


def _zone_offset(instant: Column, zone: Column) -> Column:
    """Seconds east of UTC of ``zone`` at the UTC second ``instant``."""
    return F.unix_micros(F.from_utc_timestamp(F.timestamp_seconds(instant), zone)) / 1_000_000 - instant


def parse(df: DataFrame, value: Column, home_zone: Column, day_order: Column, to: str) -> DataFrame:
    """Add struct column ``to``: epoch_s (UTC second or null), year, month, day (null as far as unstated or impossible).

    ``home_zone`` is the zone meant where the value has none, ``day_order`` (dmy or mdy) decides dates with slashes.
    """
    own = [F.col(f"`{c}`") for c in df.columns]
    tmp = lambda c: f"__{to}_{c}"
    col = lambda c: F.col(tmp(c))
    df = df.select(*own, components(value).alias(tmp("parts")), home_zone.alias(tmp("home")), F.lower(day_order).alias(tmp("order")))
    p = lambda c: _part(col("parts"), c)
    month_name = F.lower(p("n"))
    named = F.coalesce(*[F.when(month_name.isin(*names), F.lit(k + 1).cast("long")) for k, names in enumerate(MONTH_NAMES)])
    first, second = _int(p("f")), _int(p("g"))
    dmy, mdy = col("order") == "dmy", col("order") == "mdy"
    abbr = F.upper(p("a"))
    abbr_minutes = F.coalesce(*[F.when(abbr == k, F.lit(v).cast("long")) for k, v in ABBREVIATIONS.items()])
    digits = F.regexp_replace(p("o"), "[:']", "")
    sign = F.when(digits.startswith("-"), -1).otherwise(1)
    oh, om = _int(F.substring(digits, 2, 2)), _int(F.substring(digits, 4, 2))
    df = df.withColumns({
        tmp("y"): _int(p("y")),
        tmp("m"): F.coalesce(_int(p("m")), named, F.when(dmy, second).when(mdy, first)),
        tmp("d"): F.coalesce(_int(p("d")), F.when(dmy, first).when(mdy, second)),
        tmp("wants_m"): (p("m") != "") | (p("n") != "") | (p("f") != ""),
        tmp("wants_d"): (p("d") != "") | (p("f") != ""),
        tmp("h"): _int(p("h")), tmp("i"): _int(p("i")), tmp("s"): F.coalesce(_int(p("s")), F.lit(0).cast("long")), tmp("half"): F.lower(p("p")),
        tmp("offset"): F.when(p("o") != "", F.when((oh <= 15) & (om <= 59), sign * (oh * 60 + om))).when(p("a") != "", abbr_minutes),
        tmp("stated"): (p("o") != "") | (p("a") != ""),
        tmp("named"): F.coalesce(F.when(p("z") != "", p("z")), F.when(p("b") != "", p("b"))),
        tmp("epoch"): _int(p("e")), tmp("digits"): F.length(p("e")),
    })
    y, m, d, h, i, s = (col(c) for c in "ymdhis")
    # a year outside 1000..9998, or a month or day that can't be, makes the whole value name nothing
    valid = y.between(1000, 9998) & (~col("wants_m") | F.coalesce(m.between(1, 12), F.lit(False))) & (~col("wants_d") | F.coalesce(d.between(1, 31) & (d <= _days_in_month(y, m)), F.lit(False)))
    hour = F.when(col("half") == "", F.when(h <= 23, h)).otherwise(F.when(h.between(1, 12), h % 12 + F.when(col("half") == "p", 12).otherwise(0)))
    local = F.when(valid & col("wants_d") & (i <= 59) & (s <= 59), days_from_civil(y, m, d) * 86400 + hour * 3600 + i * 60 + s)
    zone = F.coalesce(col("named"), F.when(~col("stated"), col("home")))
    known = F.try_to_timestamp(F.concat(F.lit("2000-01-01 00:00:00 "), zone), F.lit("yyyy-MM-dd HH:mm:ss VV")).isNotNull()
    df = df.withColumns({
        tmp("valid"): F.coalesce(valid, F.lit(False)),
        tmp("local"): local,
        tmp("zone"): F.when(known, zone),
    })
    # the zone's offsets a day before and after bracket any change; a local time is real where one of them reproduces it
    safe = F.coalesce(col("zone"), F.lit("UTC"))
    local = col("local")
    df = df.withColumns({tmp("u1"): (local - _zone_offset(local - 86400, safe)).cast("long"), tmp("u2"): (local - _zone_offset(local + 86400, safe)).cast("long")})
    df = df.withColumns({tmp("ok1"): _zone_offset(col("u1"), safe) == local - col("u1"), tmp("ok2"): _zone_offset(col("u2"), safe) == local - col("u2")})
    skipped = ~col("ok1") & ~col("ok2")
    twice = col("ok1") & col("ok2") & (col("u1") != col("u2"))
    by_zone = F.when(col("zone").isNotNull() & ~skipped & ~twice, F.when(col("ok1"), col("u1")).otherwise(col("u2")))
    by_offset = F.when(col("named").isNull() | (col("zone").isNotNull() & ~skipped), local - col("offset") * 60)
    instant = F.when(col("epoch").isNotNull(), F.when(col("digits") >= 12, F.floor(col("epoch") / 1000).cast("long")).otherwise(col("epoch")))
    instant = F.coalesce(instant, F.when(col("stated"), by_offset).otherwise(by_zone))
    result = F.struct(
        # the zero of the clock is a placeholder, not a moment
        F.when(instant != 0, instant).cast("long").alias("epoch_s"),
        F.when(col("valid"), y).cast("int").alias("year"),
        F.when(col("valid"), m).cast("int").alias("month"),
        F.when(col("valid"), d).cast("int").alias("day"),
    )
    # a generator is a wall for the optimizer: a filter on the result isn't pushed, with all of the above written out, below it
    return df.select(*own, result.alias(tmp("out"))).select(*own, F.explode(F.array(tmp("out"))).alias(to))


def period_key(parsed: Column, precision: Column) -> Column:
    """'day 2020-07-04', 'month 2020-07' or 'year 2020' at the stated precision (null is day); null if not that precise."""
    p = F.coalesce(F.lower(F.trim(precision)), F.lit("day"))
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    y, m, d = (parsed[c] for c in ("year", "month", "day"))
    return (
        F.when(p == "day", F.concat(F.lit("day "), y.cast("string"), F.lit("-"), two(m), F.lit("-"), two(d)))
        .when(p == "month", F.concat(F.lit("month "), y.cast("string"), F.lit("-"), two(m)))
        .when(p == "year", F.concat(F.lit("year "), y.cast("string")))
    )


def stated_values(df: DataFrame, fields: list[tuple[str, Column, Column | None]], group: str, row_id: str, reader: str = "reader") -> DataFrame:
    """Long form (group_id, row_id, reader, field_name, stated, precision) of several stamp fields, one row for each non-null value.

    ``fields`` are (name, value, precision); precision None means the field names instants, else dated periods.
    """
    values = F.array(*[F.struct(F.lit(n).alias("n"), v.cast("string").alias("v"), (F.lit(None).cast("string") if p is None else F.coalesce(p, F.lit("day"))).alias("p")) for n, v, p in fields])
    long = df.select(F.col(group).alias("group_id"), F.col(row_id).alias("row_id"), F.col(reader).alias("reader"), F.explode(values).alias("f"))
    return long.where(F.col("f.v").isNotNull()).select("group_id", "row_id", "reader", F.col("f.n").alias("field_name"), F.col("f.v").alias("stated"), F.col("f.p").alias("precision"))


def normalise_stamps(values: DataFrame, readers: DataFrame) -> DataFrame:
    """Add key (equal for equal meanings within a field, null where nothing is named) and instant_utc to ``stated_values``.

    ``readers`` (reader, home_zone, day_order) is a dimension of one row per reader; it is joined, never collected.
    """
    dim = readers.groupBy("reader").agg(F.min("home_zone").alias("home_zone"), F.min("day_order").alias("day_order"))
    parsed = parse(values.join(dim, "reader", "left"), F.col("stated"), F.col("home_zone"), F.col("day_order"), "parsed")
    epoch = F.col("parsed.epoch_s")
    key = F.when(F.col("precision").isNull(), epoch.cast("string")).otherwise(period_key(F.col("parsed"), F.col("precision")))
    return parsed.select("group_id", "row_id", "field_name", "stated", key.alias("key"), F.when(F.col("precision").isNull(), F.timestamp_seconds(epoch)).alias("instant_utc"))


def same_meaning_pairs(stamps: DataFrame) -> DataFrame:
    """Pairs (field_name, id_low, id_high) of different rows of one group whose values of a field name the same thing.

    Rows of a null group are in no pair; copies of a row count once. The self-join is on group, field and key at once, so
    its work is the size of its result.
    """
    rows = stamps.where(F.col("key").isNotNull() & F.col("group_id").isNotNull()).select("group_id", "field_name", "key", "row_id").distinct()
    rows = cut(rows)
    low, high = rows.withColumnRenamed("row_id", "id_low"), rows.withColumnRenamed("row_id", "id_high")
    return low.join(high, ["group_id", "field_name", "key"]).where("id_low < id_high").select("field_name", "id_low", "id_high").distinct()
