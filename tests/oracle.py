"""Compares a query's rows with those of its SQL, in any order."""


def rows(frame):
    frame = frame[sorted(frame.columns)]

    def text(v):
        if hasattr(v, "tolist"):
            v = v.tolist()
        return repr(float(v)) if isinstance(v, float) else str(v)

    return sorted(tuple(map(text, r)) for r in frame.itertuples(index=False))


def same(spark, duck, sf, query, sql):
    got, want = query(spark, sf).toPandas(), duck.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
