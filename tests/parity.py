"""Comparing a Spark result with a DuckDB result, row by row, whatever their order."""

import math


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    if isinstance(v, list | tuple):
        return repr([_plain(x) for x in v])
    return v.isoformat() if hasattr(v, "isoformat") else repr(v)


def assert_same(df, con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    want = sorted(tuple(_plain(r[names.index(c)]) for c in order) for r in cur.fetchall())
    have = sorted(tuple(_plain(r[c]) for c in order) for r in df.collect())
    assert have == want
