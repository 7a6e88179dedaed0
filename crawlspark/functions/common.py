"""Small helpers shared by the expression libraries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Unicode white space as Python's str.strip / \s see it; Java's plain \s and Spark's trim are ASCII-only.
# Written with \x{..} so that the same class is valid in Java and in RE2.
WS = (r"[\t\n\x0B\f\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
      r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")
# Runs of the same set, in the form java.util.regex tests fastest: the look-ahead rejects printable ASCII at once
# and passes over a lone space before it, which needs no replacing.
WS_RUN = r"(?U)(?![!-~]| [!-~])[\s\x1C-\x1F]+"
WS_CHARS = "".join(map(chr, (9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
                             0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def ascii_classes(pattern: str) -> str:
    """The pattern with ``\\b`` (behind a tag's name) and ``\\s`` as RE2 and HTML read them: ASCII, no vertical tab.

    java.util.regex counts any letter as part of a word up to Java 18, so that ``<p\\b`` would pass over ``<p\u4e2d``.
    """
    return pattern.replace(r"\b", "(?![0-9A-Za-z_])").replace(r"\s", r"[ \t\n\f\r]")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c: Column | str) -> Column:
    """Strip by character set: looks at the two ends only, where a regex would walk the whole text."""
    return F.btrim(col(c), F.lit(WS_CHARS))


def collapse_ws(c: Column | str) -> Column:
    return strip_ws(F.regexp_replace(col(c), WS_RUN, " "))


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def contains_any(c: Column | str, terms) -> Column:
    c = col(c)
    return any_of(c.contains(t) for t in terms)


def str_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def let(value: Column, body) -> Column:
    """Bind a computed value once and use it many times, also inside lambdas (where Spark would otherwise
    evaluate the expression again for every element)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def scan(items: Column, state: Column, out_type: str, step, size: int = 256) -> Column:
    """What a fold gives out at each element: ``step(state, element)`` is a struct of the next ``state`` and ``out``.

    An array that grows by one is copied each time, so the fold runs over stretches of ``size`` elements, and what each
    gives out is one element of the outer fold: the work grows with the array, not with its square.
    """
    none = F.array().cast(f"array<{out_type}>")

    def inner(acc: Column, x: Column) -> Column:
        return let(step(acc["state"], x), lambda r: F.struct(
            r["state"].alias("state"), F.concat(acc["outs"], F.array(r["out"])).alias("outs")))

    def outer(acc: Column, stretch: Column) -> Column:
        done = F.aggregate(stretch, F.struct(acc["state"].alias("state"), none.alias("outs")), inner)
        return let(done, lambda r: F.struct(r["state"].alias("state"), F.concat(acc["outs"], F.array(r["outs"])).alias("outs")))

    def cut(xs: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(xs) - 1, F.lit(0)), F.lit(size))
        return F.transform(starts, lambda i: F.slice(xs, i + 1, F.lit(size)))

    start = F.struct(state.alias("state"), F.array().cast(f"array<array<{out_type}>>").alias("outs"))
    return F.flatten(F.aggregate(let(items, cut), start, outer, lambda acc: acc["outs"]))


def exploded(df: DataFrame, array: Column, pos: str, item: str, *keep) -> DataFrame:
    """One row per element. The outer form with a filter above it: for a plain explode Spark would infer
    ``size(array) > 0`` below it and compute a costly array again just for that test."""
    rows = df.select(*keep, F.posexplode_outer(array).alias(pos, item))
    return rows.filter(F.col(pos).isNotNull())


def last_or_null(arr: Column) -> Column:
    return F.try_element_at(arr, F.lit(-1))
