"""Mixing sources to target weights by Pareto order sampling.

Targets: sources in code point order, null last, take the weights in turn and share
`total_share` times all words; a target stops at `cap` times its source's size, and the
excess is shared again by weight. The fill level follows from running sums over the sources,
sorted by cap / weight (one row per source, not per document).

Copies: a source with target t and size s gives every document floor(t / s) certain whole
copies. For the rest, r = t - floor(t / s) * s words, a document of x words has the inclusion
probability p = min(1, l * x ** power): by default in proportion to its size, with l such that the
expected words are r (found on the counts of each size). Documents with p = 1 are certain once
more; the others are ranked by Q = (u / (1 - u)) / (p / (1 - p)), where u is a hash of the document's
id and text, and taken in this order up to the rank whose running word count is nearest to
what the certain ones leave of r.

The rank is never made by sorting a source in one task: words are summed per (source, bin of
Q / (1 + Q)), running sums over bins find the one bin in which the cut lies, and only that
bin's distinct values are ordered. What decides a document is its own Q and one row per
source, so the pipeline's stage needs no join on documents.

Defined cases: a null or empty text has size 0 and is taken 0 times over; a null source is a
source of its own, last in order; rows equal in id and text tie and are taken or left together
(the cut minimises the distance to r over such groups); an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strataforge.llm._common import Scratch, table

WEIGHTS = (3, 1, 2)
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, total_share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size) -> with target. sizes has one row per source."""
    n = len(weights)
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(rank, F.lit(n)) + 1).cast("int"))
    s = sizes.withColumn("w", w).withColumn("ceiling", F.lit(cap) * F.col("source_size")).withColumn("level", F.col("ceiling") / F.col("w"))
    before = W.orderBy("level", F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy()
    s = s.withColumns({
        "total": F.lit(total_share) * F.sum("source_size").over(every),
        "all_w": F.sum("w").over(every),
        "used": F.coalesce(F.sum("ceiling").over(before), F.lit(0.0)),
        "used_w": F.coalesce(F.sum("w").over(before), F.lit(0.0)),
    })
    s = s.withColumn("full", F.col("level") * (F.col("all_w") - F.col("used_w")) <= F.col("total") - F.col("used"))
    s = s.withColumns({
        "rest": F.col("total") - F.coalesce(F.sum(F.when(F.col("full"), F.col("ceiling"))).over(every), F.lit(0.0)),
        "rest_w": F.col("all_w") - F.coalesce(F.sum(F.when(F.col("full"), F.col("w"))).over(every), F.lit(0.0)),
    })
    return s.select("source", "source_size", F.when(F.col("full"), F.col("ceiling")).otherwise(F.col("rest") * F.col("w") / F.col("rest_w")).alias("target"))


def uniform(doc_id: Column, text: Column) -> Column:
    """In (0, 1), from 53 bits of a hash of id and text: the same on every run and partitioning."""
    h = F.xxhash64(F.lit(20240229), doc_id, text)
    return (F.shiftrightunsigned(h, 11).cast("double") + 0.5) / F.lit(float(1 << 53))


def plan_mix(docs: DataFrame, scratch: Scratch, weights=WEIGHTS, total_share: float = 1.5, cap: float = 2.0, power: float = 1.0) -> DataFrame:
    """docs(source, size, u) -> one row per source: source_size, target, whole, scale, cut.

    A document of the source is taken `whole` times, and once more if scale * size ** power >= 1 or its score() <= cut.
    """
    by_size = scratch.keep(docs.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "sizes", narrow=True)
    sizes = by_size.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n_docs"))
    few = sizes.select(F.col("source").alias("s2"), "n_docs")
    t = source_targets(sizes.select("source", "source_size"), weights, total_share, cap).join(few, F.col("source").eqNullSafe(F.col("s2"))).drop("s2")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    t = scratch.keep(t.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")), "targets", narrow=True)
    # the scale: sizes from the largest on are certain until the rest's largest is not
    need = t.select(F.col("source").alias("t_source"), "rest", "n_docs").where("rest > 0")
    down = W.partitionBy("source").orderBy(F.desc("size"))
    x = F.pow(F.col("size").cast("double"), F.lit(float(power)))
    steps = by_size.where("size > 0").join(need, F.col("source").eqNullSafe(F.col("t_source")))
    steps = steps.withColumn("words", F.col("size") * F.col("n")).withColumns({
        "sure": F.sum("words").over(down.rowsBetween(W.unboundedPreceding, 0)) - F.col("words"),
        "left": F.sum(x * F.col("words")).over(down.rowsBetween(0, W.unboundedFollowing)),
    })
    steps = steps.withColumn("scale", (F.col("rest") - F.col("sure")) / F.col("left")).where(F.col("scale") * x < 1)
    scales = steps.groupBy("source").agg(F.max_by(F.struct("scale", "sure", "n_docs", (F.col("rest") - F.col("sure")).alias("open")), "size").alias("x"))
    scales = scratch.keep(scales.select(F.col("source").alias("x_source"), "x.*"), "scales", narrow=True)
    j = docs.where("size > 0").join(scales, docs["source"].eqNullSafe(scales["x_source"]))
    n_bins = F.greatest(F.lit(64), F.least(F.lit(1 << 17), F.ceil(F.sqrt("n_docs")))).cast("long")
    p = inclusion(F.col("size"), F.col("scale"), power)
    j = j.where(p < 1).withColumns({"score": score(F.col("u"), p), "bins": n_bins})
    j = j.withColumn("bin", F.floor(F.col("score") * F.col("bins")).cast("long"))
    per_bin = j.groupBy("source", "bin").agg(F.sum("size").alias("words"), F.max("open").alias("open"))
    run = W.partitionBy("source").orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    edge = per_bin.withColumn("upto", F.sum("words").over(run)).where("upto > open and upto - words <= open").select(
        F.col("source").alias("e_source"), F.col("bin").alias("e_bin"), (F.col("upto") - F.col("words")).alias("base"))
    inside = j.join(scratch.keep(edge, "edge", narrow=True), F.col("source").eqNullSafe(F.col("e_source")) & (F.col("bin") == F.col("e_bin")))
    units = inside.groupBy("source", "score").agg(F.sum("size").alias("words"), F.max("base").alias("base"), F.max("open").alias("open"), F.max("bins").alias("bins"), F.max("bin").alias("bin"))
    upto = F.sum("words").over(W.partitionBy("source").orderBy("score").rowsBetween(W.unboundedPreceding, 0))
    cut = (
        units.withColumn("before", F.col("base") + upto - F.col("words"))
        .groupBy("source")
        .agg(F.max(F.when(F.col("before") + F.col("words") / 2 <= F.col("open"), F.col("score"))).alias("cut"), F.min(F.col("bin") / F.col("bins")).alias("low"))
        # none of the bin's documents is taken: the cut lies below the bin
        .select(F.col("source").alias("c_source"), F.coalesce("cut", F.col("low") - F.lit(1e-15)).alias("cut"))
    )
    t = t.join(scales.select("x_source", "scale"), F.col("source").eqNullSafe(F.col("x_source")), "left")
    return t.join(cut, F.col("source").eqNullSafe(F.col("c_source")), "left").select(
        "source", "source_size", "target", "whole", F.coalesce("scale", F.lit(0.0)).alias("scale"),
        # no bin crosses the rest: all of the source is taken (rest = 0 has whole copies only)
        F.coalesce("cut", F.when(F.col("rest") > 0, F.lit(2.0)).otherwise(F.lit(-1.0))).alias("cut"),
    )


def inclusion(size: Column, scale: Column, power: float) -> Column:
    """Probability of one more copy; from 1 on it is certain."""
    return scale * F.pow(size.cast("double"), F.lit(float(power)))


def score(u: Column, p: Column) -> Column:
    """Q / (1 + Q) for Q = odds(u) / odds(p); order-preserving and within (0, 1)."""
    q = (u / (1 - u)) / (p / (1 - p))
    return q / (1 + q)


def copies_of(u: Column, size: Column, power: float) -> Column:
    p = inclusion(size, F.col("scale"), power)
    once = F.when((p >= 1) | (F.col("cut") >= 1), 1).when((F.col("cut") > 0) & (p > 0) & (score(u, p) <= F.col("cut")), 1).otherwise(0)
    return F.when(size > 0, F.col("whole") + once).otherwise(F.lit(0)).cast("long")


def _slim(df: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), uniform(F.col(id_col), F.col(text_col)).alias("u"))


def mix_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", power: float = 1.0, **kw) -> DataFrame:
    """One row per row of df: id, source, size, source_size, target, copies, taken."""
    scratch = Scratch(df.sparkSession)
    slim = scratch.keep(_slim(df, id_col, text_col, source_col), "words")
    plan = scratch.keep(plan_mix(slim, scratch, power=power, **kw), "plan", narrow=True).withColumnRenamed("source", "p_source")
    scratch.drop("sizes", "targets", "scales", "edge")
    out = slim.join(plan, slim["source"].eqNullSafe(plan["p_source"])).withColumn("copies", copies_of(F.col("u"), F.col("size"), power))
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", power: float = 1.0, scratch: Scratch | None = None, **kw) -> DataFrame:
    """df's rows, each as often as the mix takes it. Texts are read twice but not shuffled."""
    names = df.columns
    scratch = scratch or Scratch(df.sparkSession)
    slim = scratch.keep(_slim(df, id_col, text_col, source_col).select("source", "size", "u"), "words")
    plan = scratch.keep(plan_mix(slim, scratch, power=power, **kw), "plan", narrow=True).withColumnRenamed("source", "p_source")
    scratch.drop("words", "sizes", "targets", "scales", "edge")
    at = {c: f"_c{i}" for i, c in enumerate(names)}
    plain = df.toDF(*at.values())
    plain = plain.withColumn("_size", word_count(F.col(at[text_col])))
    j = plain.join(plan, plain[at[source_col]].cast("string").eqNullSafe(plan["p_source"]))
    copies = copies_of(uniform(F.col(at[id_col]), F.col(at[text_col])), F.col("_size"), power)
    return j.withColumn("_n", copies.cast("int")).where("_n > 0").withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("_n")))).select(*at.values()).toDF(*names)


def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_counts(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
