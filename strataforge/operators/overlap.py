"""Value overlap of many column pairs in one job.

The distinct values of all columns in question form one catalogue (tbl, col, value). Grouped by
value, it gives for each value the list of columns that hold it, whose length the number of
columns bounds; pairs of such a list are counted. So every |A and B| comes from one shuffle by
value, a popular value costs no more than the square of the number of columns, and the values
themselves never meet in a join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataforge.operators.frequency import as_text, bottom_hash_values


def catalogue(tables: dict[str, DataFrame], columns: dict[str, list[str]], sample: int | None = None) -> DataFrame:
    """(col, value) distinct and not null; col is an index into `numbered(columns)`. One scan per table."""
    number = numbered(columns)
    parts = []
    for t, names in columns.items():
        if names:
            cells = [F.struct(F.lit(number[t, c]).alias("col"), as_text(c).alias("value")) for c in names]
            parts.append(tables[t].select(F.inline(F.array(*cells))))
    rows = reduce(DataFrame.unionByName, parts).where("value IS NOT NULL").distinct()
    return bottom_hash_values(rows, sample) if sample else rows


def numbered(columns: dict[str, list[str]]) -> dict[tuple[str, str], int]:
    return {tc: i for i, tc in enumerate((t, c) for t, names in columns.items() for c in names)}


def overlaps(values: DataFrame, pairs: list[tuple[int, int]] | None = None) -> DataFrame:
    """(a, b, n_a, n_b, n_both) for pairs a < b of columns with a value in common."""
    sets = values.groupBy("value").agg(F.sort_array(F.collect_set("col")).alias("cols"))
    held = sets.groupBy("cols").agg(F.count(F.lit(1)).alias("n"))  # few different sets of columns
    two = F.flatten(F.transform("cols", lambda x: F.transform(F.filter("cols", lambda y: y > x), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    both = held.select(F.explode(two).alias("p"), "n").groupBy("p.a", "p.b").agg(F.sum("n").alias("n_both"))
    size = held.select(F.explode("cols").alias("col"), "n").groupBy("col").agg(F.sum("n").alias("n"))
    if pairs is not None:
        wanted = values.sparkSession.createDataFrame(pairs, "a int, b int")
        both = both.join(F.broadcast(wanted), ["a", "b"])  # pairs of columns
    left, right = size.toDF("a", "n_a"), size.toDF("b", "n_b")
    return both.join(F.broadcast(left), "a").join(F.broadcast(right), "b").select("a", "b", "n_a", "n_b", "n_both")  # a row per column


def overlap_pairs(tables: dict[str, DataFrame], columns: dict[str, list[str]], sample: int | None = None, pairs=None) -> DataFrame:
    """(table_a, column_a, table_b, column_b, n_a, n_b, n_both, jaccard, a_in_b, b_in_a) across tables."""
    number = numbered(columns)
    names = next(iter(tables.values())).sparkSession.createDataFrame([(i, t, c) for (t, c), i in number.items()], "i int, t string, c string")
    wanted = None if pairs is None else [tuple(sorted((number[x], number[y]))) for x, y in pairs]
    o = overlaps(catalogue(tables, columns, sample), wanted)
    o = o.join(F.broadcast(names.toDF("a", "table_a", "column_a")), "a").join(F.broadcast(names.toDF("b", "table_b", "column_b")), "b").where("table_a <> table_b")
    return o.select(
        "table_a", "column_a", "table_b", "column_b", "n_a", "n_b", "n_both", F.round(F.col("n_both") / (F.col("n_a") + F.col("n_b") - F.col("n_both")), 4).alias("jaccard"),
        F.round(F.col("n_both") / F.col("n_a"), 4).alias("a_in_b"), F.round(F.col("n_both") / F.col("n_b"), 4).alias("b_in_a"),
    )


def overlap_map(tables: dict[str, DataFrame], pairs: list[tuple[tuple[str, str], tuple[str, str]]], sample: int | None = None) -> dict:
    """{((table, column), (table, column)): (n_a, n_b, n_both)} for the pairs given, either way round."""
    if not pairs:
        return {}
    columns: dict[str, list[str]] = {}
    for t, c in sorted({x for p in pairs for x in p}):
        columns.setdefault(t, []).append(c)
    number = numbered(columns)
    back = {i: tc for tc, i in number.items()}
    wanted = list({tuple(sorted((number[x], number[y]))) for x, y in pairs})
    out = {}
    for r in overlaps(catalogue(tables, columns, sample), wanted).collect():  # a row per pair of columns
        a, b = back[r["a"]], back[r["b"]]
        out[a, b] = (r["n_a"], r["n_b"], r["n_both"])
        out[b, a] = (r["n_b"], r["n_a"], r["n_both"])
    return out
