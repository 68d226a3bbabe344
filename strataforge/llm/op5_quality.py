"""Quality rules with thresholds that adapt to each language and source.

1. `quality_metrics`: counts over whole texts (one Arrow pass).
2. `sketch`: for each (language, source) and metric a quantile sketch of logarithmic buckets:
   the bucket of x is ceil(log(1 + x / unit) / log(1 + accuracy)), and a sketch is the count
   in each bucket. Sketches merge by adding counts, so partial sums run before the shuffle and
   reruns and retried tasks give the same sketch; their size depends on the range of a metric only.
3. `thresholds`: quartiles read from the merged sketches. The fences of a metric lie `reach` spreads
   beyond its quartiles, the spread being the quartile distance and the chance error of a document of
   the group's lower-quartile length taken together (as roots of squares): a metric that is 0 nearly
   everywhere has no quartile distance, but documents of finite length still differ by chance.
   Small groups are shrunk smoothly: `prior_docs` documents of the language's distribution are added
   to a group's sketch, and as many of the whole corpus's to a language's.
4. `judge`: the thresholds joined to the metrics, followed by the filter.

Defined cases: a null text has no words and fails the base rule, as an empty one does; null
languages and sources are groups of their own; repeated rows are judged each by itself; an
empty table gives an empty table; only the id, text, language and source columns are read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataforge.llm._common import ASCII_SPACE, Scratch, arrow_rows, ship, table

SYMBOLS = "#*$%&|<>"
#: metric -> (unit of the sketch, what it is a share or mean of, words that one event makes count at least)
METRICS = {
    "symbol_ratio": (0.01, "n_words", 1),
    "dup_line_ratio": (0.01, "n_lines", 1),
    "repeat_ratio": (0.01, "n_words", 6),  # a 3-word window and its repetition
    "upper_ratio": (0.01, "word_chars", 1),
    "mean_word_chars": (0.1, "n_words", 1),
}
#: Metrics that are shares: their chance error is that of counts among trials. Others: of a mean of counts. These have a low fence too.
SHARES = frozenset(METRICS) - {"mean_word_chars"}
SIZES = ("n_words", "n_lines", "word_chars")
UNITS = {m: u for m, (u, _, _) in METRICS.items()} | {c: 1.0 for c in SIZES}
ACCURACY = 0.02
REACH = 6.0
PRIOR_DOCS = 50

_COUNTS = T.StructType([T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")])


def text_counts(text: str | None) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lines with a word, capitals."""
    if not text:
        return (0,) * 7
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    chars = len(text) - sum(text.count(c) for c in ASCII_SPACE)
    symbols = sum(text.count(c) for c in SYMBOLS)
    dup = lines = 0
    seen: set[bytes] = set()
    for line in raw.split(b"\n"):
        if line and not line.isspace():
            lines += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    repeat = 0
    if n >= 4:
        ids: dict[bytes, int] = {}
        w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), dtype=np.int64, count=n)
        if len(ids) < 1 << 21:
            keys = (w[:-2] << 42) | (w[1:-1] << 21) | w[2:]
        else:
            pair = np.unique((w[:-1] << 32) | w[1:], return_inverse=True)[1]
            keys = (pair[:-1].astype(np.int64) << 32) | w[2:]
        order = np.argsort(keys, kind="stable")
        s = keys[order]
        same = s[1:] == s[:-1]
        if same.any():
            twice = np.zeros(n - 2, dtype=bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            covered = np.zeros(n, dtype=bool)
            covered[:-2] |= twice
            covered[1:-1] |= twice
            covered[2:] |= twice
            repeat = int(covered.sum())
    return n, chars, symbols, dup, repeat, lines, _n_upper(text)


def _n_upper(text: str) -> int:
    """Code points that lower-casing changes."""
    lowered = text.lower()
    if len(text) != len(lowered):
        return sum(map(str.isupper, text))
    a = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    b = np.frombuffer(lowered.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return int((a != b).sum())


def quality_metrics(df: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """`keep` columns of df and a struct column `_counts`. The text goes to Python once, kept or not."""
    keep = keep or [c for c in df.columns]
    ship(df.sparkSession)
    own = text_col in keep and df.schema[text_col].dataType == T.StringType()
    src = df.select(*[F.col(c) for c in keep], *([] if own else [F.col(text_col).cast("string").alias("_text")]))
    at = keep.index(text_col) if own else len(keep)
    schema = T.StructType([*src.schema.fields[: len(keep)], T.StructField("_counts", _COUNTS)])

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [text_counts(t.as_py()) for t in batch.column(at)]
        cols = [pa.array(c, pa.int64()) for c in zip(*found)]
        counts = pa.StructArray.from_arrays(cols, names=_COUNTS.names)
        return pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], counts], names=schema.names)

    return src.mapInArrow(arrow_rows(count), schema)


def _ratios() -> dict:
    c = F.col("_counts")
    words, lines, chars = F.greatest(c.n_words, F.lit(1)), F.greatest(c.n_lines, F.lit(1)), F.greatest(c.word_chars, F.lit(1))
    return {
        "symbol_ratio": c.n_symbols / words,
        "dup_line_ratio": c.n_dup_lines / lines,
        "repeat_ratio": c.n_repeat_words / words,
        "upper_ratio": c.n_upper / chars,
        "mean_word_chars": c.word_chars / words,
    }


def sketch(metrics: DataFrame, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, metric, bucket) -> n over documents with words; additive, so mergeable. Sizes are sketched as the metrics are."""
    step = math.log(1 + ACCURACY)
    found = _ratios() | {c: F.col("_counts")[c] for c in SIZES}
    cells = [F.struct(F.lit(m).alias("metric"), F.ceil(F.log(1 + x / F.lit(UNITS[m])) / F.lit(step)).cast("int").alias("bucket")) for m, x in found.items()]
    return (
        metrics.where("_counts.n_words > 0")
        .select(F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), F.explode(F.array(*cells)).alias("cell"))
        .groupBy("lang", "source", "cell.metric", "cell.bucket")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _of_map(values: dict, key: Column) -> Column:
    return F.element_at(F.create_map(*[x for m, v in values.items() for x in (F.lit(m), F.lit(v))]), key)


def shrunk(cells: DataFrame, prior_docs: float = PRIOR_DOCS) -> DataFrame:
    """(lang, source, metric, bucket) -> weight: a group's counts and prior_docs documents of its language's distribution, itself so shrunk.

    Only sketches are joined, whose sizes a metric's range bounds.
    """
    total = lambda keys: F.sum("w").over(W.partitionBy(*keys))
    every = cells.groupBy("metric", "bucket").agg(F.sum("n").cast("double").alias("w")).withColumn("w", F.col("w") / total(["metric"]))
    own = cells.groupBy("lang", "metric", "bucket").agg(F.sum("n").cast("double").alias("w"))
    # every language has the corpus's buckets; its one key is the metric of the language's own cells
    prior = own.select(F.col("lang").alias("l"), F.col("metric").alias("m")).distinct().join(every, F.col("m") == F.col("metric"))
    langs = own.union(prior.select("l", "metric", "bucket", F.col("w") * prior_docs)).groupBy("lang", "metric", "bucket").agg(F.sum("w").alias("w"))
    langs = langs.withColumn("w", F.col("w") / total(["lang", "metric"])).toDF("l", "m", "b", "w")
    groups = cells.select("lang", "source", "metric").distinct()
    prior = groups.join(langs, F.col("lang").eqNullSafe(F.col("l")) & (F.col("metric") == F.col("m"))).select("lang", "source", "metric", "b", F.col("w") * prior_docs)
    return cells.select("lang", "source", "metric", "bucket", F.col("n").cast("double").alias("w")).union(prior).groupBy("lang", "source", "metric", "bucket").agg(F.sum("w").alias("w"))


def thresholds(cells: DataFrame, prior_docs: float = PRIOR_DOCS, reach: float = REACH) -> DataFrame:
    """One row per (lang, source): n_docs and a map metric -> (low, high)."""
    curve = shrunk(cells, prior_docs).groupBy("lang", "source", "metric").agg(F.sort_array(F.collect_list(F.struct("bucket", "w"))).alias("c"), F.sum("w").alias("total"))
    # the smallest bucket whose cumulated weight reaches q * total; a sketch has a bounded number of buckets
    at = lambda q: F.aggregate(
        F.col("c"),
        F.struct(F.lit(0.0).alias("seen"), F.lit(None).cast("int").alias("b")),
        lambda acc, x: F.struct((acc.seen + x.w).alias("seen"), F.coalesce(acc.b, F.when(acc.seen + x.w >= F.lit(q) * F.col("total") - 1e-9, x.bucket)).alias("b")),
        lambda acc: acc.b,
    )
    value = lambda b: (F.pow(F.lit(1 + ACCURACY), b) - 1) * _of_map(UNITS, F.col("metric"))
    quartiles = curve.withColumns({"q25": value(at(0.25)), "q75": value(at(0.75))})
    rows = quartiles.groupBy("lang", "source").agg(F.map_from_entries(F.collect_list(F.struct("metric", F.struct("q25", "q75")))).alias("q"))
    fences = []
    for m, (_, size, event) in METRICS.items():
        low, high = F.col("q")[m]["q25"], F.col("q")[m]["q75"]
        n = F.greatest(F.col("q")[size]["q25"], F.lit(1.0)) / event
        if m in SHARES:
            p = (high * n + 1) / (n + 2)
            p = F.least(p, F.lit(1.0))
            spread = F.sqrt(F.pow(high - low, 2) + p * (1 - p) / n)
            fences.append(F.struct(F.lit(m), F.struct(F.lit(None).cast("double").alias("low"), (F.greatest(high, p) + reach * spread).alias("high"))))
        else:
            spread = F.sqrt(F.pow(high - low, 2) + high / n)
            fences.append(F.struct(F.lit(m), F.struct((low - reach * spread).alias("low"), (high + reach * spread).alias("high"))))
    docs = cells.where("metric = 'n_words'").groupBy("lang", "source").agg(F.sum("n").alias("n_docs")).toDF("l", "s", "n_docs")
    rows = rows.join(docs, F.col("lang").eqNullSafe(F.col("l")) & F.col("source").eqNullSafe(F.col("s")))
    return rows.select("lang", "source", "n_docs", F.map_from_entries(F.array(*fences)).alias("fence"))


def judge(metrics: DataFrame, fences: DataFrame, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """metrics with base_failed, kept and reasons (names of the metrics beyond their fences)."""
    f = fences.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), F.col("fence").alias("_fence"))
    j = metrics.join(f, metrics[lang_col].eqNullSafe(f["_lang"]) & metrics[source_col].eqNullSafe(f["_source"]), "left")
    c = F.col("_counts")
    base = (c.n_words < 50) | (100 * c.n_repeat_words > 50 * c.n_words)
    over = []
    for m, x in _ratios().items():
        low, high = F.col("_fence")[m]["low"], F.col("_fence")[m]["high"]
        over.append(F.when(F.coalesce((x > high) | (x < low), x > high, F.lit(False)), F.lit(m)))
    reasons = F.array_compact(F.array(*over))
    return j.withColumns({"base_failed": base, "_reasons": reasons}).withColumn("kept", ~F.col("base_failed") & (F.size("_reasons") == 0)).drop("_lang", "_source", "_fence")


def fit_thresholds(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", metrics: DataFrame | None = None) -> DataFrame:
    """Thresholds from all rows of df, as a small table in the shared folder."""
    if metrics is None:
        metrics = quality_metrics(df.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source")), keep=["lang", "source"])
    return Scratch(df.sparkSession).keep(thresholds(sketch(metrics)), "fences", narrow=True)


def filter_quality(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", scratch: Scratch | None = None) -> DataFrame:
    """The rows of df that pass, with df's columns. Rows are written with their counts, so that texts go to Python once and are never shuffled."""
    scratch = scratch or Scratch(df.sparkSession)
    names = df.columns
    plain = df.toDF(*[f"_c{i}" for i in range(len(names))])
    at = lambda c: f"_c{names.index(c)}"
    m = quality_metrics(plain, at(text_col), plain.columns).withColumns({"_l": F.col(at(lang_col)).cast("string"), "_s": F.col(at(source_col)).cast("string")})
    m = scratch.keep(m, "counted")
    fences = scratch.keep(thresholds(sketch(m, "_l", "_s")), "fences", narrow=True)
    return judge(m, fences, "_l", "_s").where("kept").select(*plain.columns).toDF(*names)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    metrics = Scratch(spark).keep(quality_metrics(docs, keep=["doc_id", "lang", "source"]), "metrics")
    return judge(metrics, fit_thresholds(docs, metrics=metrics)).select(
        "doc_id", "_counts.n_words", "_counts.word_chars", "_counts.n_symbols", "_counts.n_dup_lines", "_counts.n_repeat_words",
        "base_failed", "kept", F.concat_ws(",", "_reasons").alias("reasons"),
    )
