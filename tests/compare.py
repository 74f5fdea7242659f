"""Order-insensitive comparison of Spark rows with DuckDB rows."""

import math


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    if type(v).__name__ == "Decimal":
        return f"{float(v):.6g}"
    if isinstance(v, (list, tuple)):
        return [norm(x) for x in v]
    if getattr(v, "tzinfo", None):
        v = v.replace(tzinfo=None)
    return str(v)


def same(df, rel):
    cols = sorted(rel.columns)
    assert sorted(df.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    ours = sorted(repr([norm(r[c]) for c in cols]) for r in df.collect())
    theirs = sorted(repr([norm(r[i]) for i in at]) for r in rel.fetchall())
    assert ours == theirs
