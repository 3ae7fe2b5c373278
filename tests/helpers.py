"""Comparison of a Spark result with a DuckDB result, row order left aside."""

import pandas as pd


def _cell(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if not isinstance(v, list) and pd.isna(v):
        return None
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return round(float(v), 6)
    return str(v)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(_cell(v) for v in r) for r in frame.astype(object).itertuples(index=False)), key=repr)


def same(spark_df, duck_rel):
    a, b = spark_df.toPandas(), duck_rel.df()
    assert sorted(a.columns) == sorted(b.columns)
    assert rows(a) == rows(b)
    return len(a)
