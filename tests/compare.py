"""Order-free comparison of a Spark result with its SQL twin."""

from __future__ import annotations

import math
from collections import Counter


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        f = float(v)
        return int(f) if f == int(f) else float(repr(round(f, 9)))
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(_cell(r[i]) for i in order) for r in rows)


def differences(spark_df, duck_rel):
    a_cols, a = rows_of(spark_df.columns, spark_df.collect())
    b_cols, b = rows_of(list(duck_rel.columns), duck_rel.fetchall())
    if a_cols != b_cols:
        return f"columns differ: {a_cols} / {b_cols}"
    if a != b:
        only_a, only_b = list((a - b).elements()), list((b - a).elements())
        return (f"{a_cols}: {sum(a.values())} / {sum(b.values())} rows, {len(only_a)} only in Spark, {len(only_b)} only in SQL;"
                f" e.g. {str(sorted(map(str, only_a))[:2])[:700]} / {str(sorted(map(str, only_b))[:2])[:700]}")
    return None
