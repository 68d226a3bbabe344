"""The value-frequency core: one shuffle from which a table's statistics follow.

`frequencies` unpivots the columns, cast to string, into (ordinal, value) and counts. Map-side
combining bounds what is shuffled by the distinct values of each task. Null rates, exact
distinct counts, minima, lengths, pattern and type counts and top values are then aggregates
over distinct values, weighted by their counts, so expressions run once per distinct value.

`wide_statistics` without top values is one aggregation over the native columns with approximate
distinct counts, no unpivot, and a shuffle of one row per task, for tables whose row count or width makes
the unpivot dear. Top values are exact at every size, so where they are asked for the frequencies serve for all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataforge.functions.patterns import PATTERNS, pattern_hits, type_hits

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def is_numeric(kind: T.DataType) -> bool:
    return isinstance(kind, NUMERIC)


def is_string(kind: T.DataType) -> bool:
    return isinstance(kind, T.StringType)


def as_text(name: str) -> Column:
    return quoted(name).cast("string")


def frequencies(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(ordinal, text, value, cnt): how often each value, in string form, occurs in each column; null is a value.

    `text` tells string columns. As it is data and not part of later expressions, these have the
    same generated code for every table, which is then compiled once.
    """
    at = {f.name: (i, is_string(f.dataType)) for i, f in enumerate(df.schema.fields)}
    cells = [F.struct(F.lit(at[c][0]).alias("ordinal"), F.lit(at[c][1]).alias("text"), as_text(c).alias("value")) for c in (columns or df.columns)]
    if not cells:
        return df.sparkSession.createDataFrame([], "ordinal int, text boolean, value string, cnt long")
    return df.select(F.inline(F.array(*cells))).groupBy("ordinal", "text", "value").agg(F.count(F.lit(1)).alias("cnt"))


def _weighted(hit: Column) -> Column:
    return F.sum(F.when(hit, F.col("cnt")).otherwise(F.lit(0)))


def value_statistics(freq: DataFrame) -> DataFrame:
    """One row per ordinal: counts, distinct, extremes, lengths, and maps of pattern and type counts for strings."""
    v, text = F.col("value"), F.col("text")
    filled = text & (F.trim(v) != "")
    patterns = [x for name, hit in pattern_hits(v).items() for x in (F.lit(name), _weighted(text & hit))]
    types = [x for name, hit in type_hits(v).items() for x in (F.lit(name), _weighted(filled & hit))]
    return freq.groupBy("ordinal").agg(
        F.sum("cnt").alias("total_count"),
        _weighted(v.isNull()).alias("null_count"),
        F.count("value").alias("distinct_count"),
        F.min("value").alias("min_value"),
        F.max("value").alias("max_value"),
        F.when(F.max(text), F.sum(F.length(v) * F.col("cnt")) / F.sum(F.when(v.isNotNull(), F.col("cnt")))).alias("mean_length"),
        F.when(F.max(text), F.max(F.length(v)).cast("long")).alias("max_length"),
        _weighted(filled).alias("filled_count"),
        F.create_map(*patterns).alias("pattern_counts"),
        F.create_map(*types).alias("type_counts"),
    )


def top_values(freq: DataFrame, n: int) -> DataFrame:
    """(ordinal, top: array of (value, cnt)), by count descending and value ascending; null is left out.

    The rank filter becomes a group limit before the shuffle, so a task sends n rows per column.
    """
    rank = F.row_number().over(W.partitionBy("ordinal").orderBy(F.desc("cnt"), "value"))
    best = freq.where("value IS NOT NULL").withColumn("r", rank).where(F.col("r") <= n)
    return best.groupBy("ordinal").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "value", "cnt"))), lambda x: F.struct(x.value.alias("value"), x.cnt.alias("cnt"))).alias("top"))


def example_values(freq: DataFrame, n: int = 5) -> DataFrame:
    """(ordinal, examples): the first n non-blank values in order."""
    rank = F.row_number().over(W.partitionBy("ordinal").orderBy("value"))
    some = freq.where("trim(value) <> ''").withColumn("r", rank).where(F.col("r") <= n)
    return some.groupBy("ordinal").agg(F.sort_array(F.collect_list("value")).alias("examples"))


def wide_statistics(df: DataFrame, batch: int = 50, approx: bool = True, top: int = 0) -> DataFrame:
    """The same columns as value_statistics from native-typed aggregates, `batch` columns a pass.

    With top > 0 also `top` as top_values gives it. These are exact, so the frequencies are needed anyway, and
    all numbers come from their one shuffle: distinct counts are exact then, and no wide pass is made.
    """
    if top and df.columns:
        none = F.array().cast("array<struct<value:string,cnt:bigint>>")
        freq = frequencies(df)
        best = top_values(freq, top)
        text = F.col("ordinal").isin(*[i for i, f in enumerate(df.schema.fields) if is_string(f.dataType)])
        maps = {c: F.when(text, F.col(c)).otherwise(F.create_map().cast("map<string,bigint>")) for c in ("pattern_counts", "type_counts")}
        return value_statistics(freq).withColumns(maps).join(F.broadcast(best), "ordinal", "left").withColumn("top", F.coalesce("top", none))  # best: one row per column
    out = None
    for at in range(0, len(df.columns), batch):
        part = df.schema.fields[at : at + batch]
        aggs = [F.count(F.lit(1)).alias("total")]
        for i, f in enumerate(part):
            c, s = quoted(f.name), as_text(f.name)
            text = is_string(f.dataType)
            filled = F.trim(s) != ""
            distinct = F.approx_count_distinct(c) if approx and not isinstance(f.dataType, T.VariantType) else F.count_distinct(c)
            maps = lambda hits, ok: F.create_map(*[x for k, h in hits.items() for x in (F.lit(k), F.count_if(ok & h))])
            none = F.create_map().cast("map<string,bigint>")
            aggs.append(F.struct(
                F.lit(at + i).alias("ordinal"), F.count_if(c.isNull()).alias("null_count"), distinct.alias("distinct_count"), F.min(s).alias("min_value"), F.max(s).alias("max_value"),
                (F.avg(F.length(s)) if text else F.lit(None).cast("double")).alias("mean_length"), (F.max(F.length(s)).cast("long") if text else F.lit(None).cast("long")).alias("max_length"),
                (F.count_if(filled) if text else F.lit(0).cast("long")).alias("filled_count"),
                (maps(pattern_hits(s), F.lit(True)) if text else none).alias("pattern_counts"), (maps(type_hits(s), filled) if text else none).alias("type_counts"),
            ).alias(f"s{i}"))
        row = df.agg(*aggs).select("total", F.inline(F.array(*[F.col(f"s{i}") for i in range(len(part))])))
        row = row.select("ordinal", F.col("total").alias("total_count"), *[c for c in row.columns if c not in ("ordinal", "total")])
        out = row if out is None else out.unionByName(row)
    return out


def basic_statistics(df: DataFrame, approx: bool = False, batch: int = 50) -> DataFrame:
    """One row per column of df: the numbers of a column profile without patterns, types and top values."""
    spark = df.sparkSession
    fields = df.schema.fields
    columns = spark.createDataFrame([(i, f.name, str(f.dataType), is_numeric(f.dataType)) for i, f in enumerate(fields)], "ordinal int, column_name string, spark_type string, is_numeric boolean")
    stats = wide_statistics(df, batch, True) if approx else value_statistics(frequencies(df))
    filled = F.col("total_count") - F.col("null_count")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return columns.join(F.broadcast(stats), "ordinal", "left").select(  # stats: one row per column
        "ordinal", "column_name", "spark_type", zero(F.col("total_count")).alias("total_count"), zero(F.col("null_count")).alias("null_count"),
        F.when(F.col("total_count") > 0, F.round(F.col("null_count") / F.col("total_count"), 6)).otherwise(0.0).alias("null_rate"),
        zero(F.col("distinct_count")).alias("distinct_count"),
        F.when(filled > 0, F.round(F.least(F.col("distinct_count") / filled, F.lit(1.0)), 6)).otherwise(0.0).alias("uniqueness"),
        "min_value", "max_value", F.round("mean_length", 2).alias("mean_length"), "max_length", "is_numeric",
    )


def pattern_coverage(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, pattern, matches, non_null, coverage) for every pattern, over distinct values."""
    freq = frequencies(df, columns)
    stats = value_statistics(freq)
    names = df.sparkSession.createDataFrame([(df.columns.index(c), c) for c in columns], "ordinal int, column_name string")
    rows = stats.join(F.broadcast(names), "ordinal").select("column_name", (F.col("total_count") - F.col("null_count")).alias("non_null"), F.explode("pattern_counts").alias("pattern", "matches"))
    return rows.select("column_name", "pattern", "matches", "non_null", F.when(F.col("non_null") > 0, F.round(F.col("matches") / F.col("non_null"), 4)).otherwise(0.0).alias("coverage"))


def dominant_patterns(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, dominant_pattern, pattern_coverage): the best covered, the earlier of equals, or free text."""
    rows = pattern_coverage(df, columns)
    order = F.element_at(F.create_map(*[x for i, p in enumerate(PATTERNS) for x in (F.lit(p), F.lit(i))]), F.col("pattern"))
    best = rows.groupBy("column_name").agg(F.max("non_null").alias("n"), F.max_by(F.struct("pattern", "matches"), F.struct("matches", -order)).alias("b"))
    share = F.col("b.matches") / F.col("n")
    return best.select(
        "column_name",
        F.when(F.col("n") == 0, "unknown").when(share < 0.30, "free_text").otherwise(F.col("b.pattern")).alias("dominant_pattern"),
        F.when(F.col("n") == 0, 0.0).when(share < 0.30, F.round(1 - share, 4)).otherwise(F.round(share, 4)).alias("pattern_coverage"),
    )


def inferred_types(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, target_type, format, confidence) of string columns; null where no rung is reached."""
    from strataforge.functions.patterns import climb

    stats = value_statistics(frequencies(df, columns))
    rows = []
    for r in stats.collect():  # one row per column
        got = climb(r["type_counts"], r["filled_count"]) or (None, None, None)
        rows.append((df.columns[r["ordinal"]], *got))
    return df.sparkSession.createDataFrame(rows, "column_name string, target_type string, format string, confidence double")


def quantiles(df: DataFrame, columns: list[str], error: float = 0.0, probabilities=(0.25, 0.5, 0.75)) -> dict[str, tuple[float, ...] | None]:
    """Quantiles of numeric columns; None where a column has no value. error 0: exact, from counts of values."""
    if not columns:
        return {}
    if error <= 0:
        return _exact_quantiles(df, columns, probabilities)
    plain = df.select(*[quoted(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    found = plain.approxQuantile(plain.columns, list(probabilities), error)
    return {c: tuple(q) if q else None for c, q in zip(columns, found)}


#: Bins that exact quantiles look through a column by.
QUANTILE_BINS = 128


def _exact_quantiles(df: DataFrame, columns: list[str], probabilities) -> dict[str, tuple[float, ...] | None]:
    """The smallest value up to which a share p of the rows lies.

    Approximate quantiles cut every column into QUANTILE_BINS bins; counts per bin (so many rows a column) tell
    the bin of each rank, and only that bin's values, about one in QUANTILE_BINS, are put in order.
    """
    plain = df.select(*[quoted(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    grid = [k / QUANTILE_BINS for k in range(1, QUANTILE_BINS)]
    edges = [sorted(set(e)) for e in plain.approxQuantile(plain.columns, grid, 0.25 / QUANTILE_BINS)]
    bounds = F.array(*[F.array(*map(F.lit, e)).cast("array<double>") for e in edges])
    cells = plain.select(F.inline(F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).alias("v")) for i, c in enumerate(plain.columns)]))).where("v IS NOT NULL")
    counts = cells.groupBy("i", "v").agg(F.count(F.lit(1)).alias("n")).withColumn("bin", F.size(F.filter(bounds[F.col("i")], lambda b: b < F.col("v"))))
    with_base = counts.groupBy("i", "bin").agg(F.sum("n").alias("n"))
    upto = F.sum("n").over(W.partitionBy("i").orderBy("bin").rowsBetween(W.unboundedPreceding, 0))
    with_base = with_base.withColumns({"base": upto - F.col("n"), "upto": upto, "total": F.sum("n").over(W.partitionBy("i"))})
    ranks = with_base.select("*", F.posexplode(F.array(*[F.lit(float(p)) for p in probabilities])).alias("k", "p")).withColumn("rank", F.greatest(F.ceil(F.col("p") * F.col("total")), F.lit(1)))
    ranks = ranks.where("base < rank AND rank <= upto").select(F.col("i").alias("ri"), F.col("bin").alias("rbin"), "base", "k", "rank")
    inside = counts.join(F.broadcast(ranks), (F.col("i") == F.col("ri")) & (F.col("bin") == F.col("rbin")))  # ranks: a row a column and probability
    seen = F.col("base") + F.sum("n").over(W.partitionBy("i", "k").orderBy("v").rowsBetween(W.unboundedPreceding, 0))
    rows = inside.withColumn("seen", seen).where("seen >= rank").groupBy("i", "k").agg(F.min("v").alias("v")).collect()
    found: dict[int, dict[int, float]] = {}
    for r in rows:
        found.setdefault(r["i"], {})[r["k"]] = r["v"]
    return {c: tuple(found[i][k] for k in range(len(probabilities))) if i in found else None for i, c in enumerate(columns)}


def bottom_hash_values(values: DataFrame, n: int) -> DataFrame:
    """(col, value) -> the n values of each col with the smallest hashes: the same values wherever they occur."""
    rank = F.row_number().over(W.partitionBy("col").orderBy(F.xxhash64("value"), "value"))
    return values.withColumn("r", rank).where(F.col("r") <= n).drop("r")
