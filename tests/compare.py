"""Rows of a Spark result and of a DuckDB result as comparable lists."""


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def same_rows(df, relation):
    columns = sorted(df.columns)
    assert columns == sorted(relation.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    at = [relation.columns.index(c) for c in columns]
    want = sorted((tuple(plain(r[i]) for i in at) for r in relation.fetchall()), key=repr)
    assert len(got) == len(want)
    assert got == want
