"""Helpers of the tests of this folder."""

import duckdb
from compare import normal

ODD = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    """A documents table with two columns whose names operators use inside."""
    return spark.createDataFrame([(k, t, "en", "s", None) for k, t in rows], ODD)


def same_as_sql(df, sql, **tables):
    con = duckdb.connect()
    for name, table in tables.items():
        con.register(name, table.toArrow())
    res = con.execute(sql)
    want = normal(res.fetchall(), [c[0] for c in res.description])
    got = normal([tuple(r) for r in df.collect()], df.columns)
    assert got == want


class Sets:
    """Union-find for brute force."""

    def __init__(self):
        self.parent = {}

    def top(self, x):
        self.parent.setdefault(x, x)
        while self.parent[x] != x:
            x = self.parent[x]
        return x

    def join(self, a, b):
        a, b = self.top(a), self.top(b)
        self.parent[max(a, b)] = min(a, b)
