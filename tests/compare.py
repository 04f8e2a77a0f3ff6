"""Comparing a Spark result with SQL, order left aside."""

import math
from collections import Counter


def canon(v):
    if isinstance(v, (list, tuple)):
        return tuple(map(canon, v))
    if isinstance(v, dict):
        return tuple(map(canon, v.values()))
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return float(v) if hasattr(v, "as_tuple") else v


def same(df, con, sql):
    cols = sorted(df.columns)
    got = Counter(tuple(canon(r[c]) for c in cols) for r in df.collect())
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    want = Counter(tuple(canon(r[names.index(c)]) for c in cols) for r in found.fetchall())
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])
