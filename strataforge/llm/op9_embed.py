"""Near-duplicate embeddings by a pivot-permutation index.

1. Equal vectors become one row with a weight. Every dimension has an index of its own, all in one job.
2. Pivots: `per_root` * sqrt(n) reference points, within [64, max_pivots], chosen from a bounded
   sample of vectors by hash (4 for each pivot) so that no two are closer than `spread`; a crowded
   region thus has few pivots and its vectors agree on them. Tasks choose among parts of the sample,
   one task among what they found, and the driver gets the pivots alone, as bytes.
3. Every vector is described by its `prefix` nearest pivots in order. It is posted in the
   inverted lists of its first `posted` pivots; all vectors are indexed.
4. A list holds the vectors that share its pivot. Pairs in a list are candidates if they share
   at least `min_shared` pivots of their prefixes, and are then verified by the cosine in double
   precision. A pair that shares several lists counts in that of its smallest common posted
   pivot only. A long list is cut into blocks, and pairs of blocks are spread over tasks.
5. A list gives the number of links per vector and a spanning forest, not the pairs.

Pairs that share no posted pivot are missed: measured recall is in the README and in the tests. With
`exact=True` none is: by the triangle inequality of angles, y within the angle a of x is no farther
than its own nearest pivot's angle + 2a from x's nearest pivot, so y is posted in all such lists (few
where vectors are clustered, most where they are spread evenly), and lists compare all pairs.

Defined cases: a null vector, a zero one, and one with null or non-finite components link with
nothing and are groups of their own; vectors of different lengths do not link; repeated rows link
with each other; different vectors of one id, or without, are vectors of their own; a null id counts as
larger than any other; an empty table gives an empty table.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataforge.llm._common import Scratch, table
from strataforge.llm.components import connected_components

THRESHOLD = 0.9
NO_ID = (1 << 63) - 1
TILE = 1024


def choose_pivots(sample: np.ndarray, count: int, spread: float = 0.8) -> np.ndarray:
    """Up to `count` rows of the unit vectors in `sample`, in their order, none within `spread` of an earlier one."""
    kept = np.zeros((count, sample.shape[1] if sample.ndim == 2 else 0))
    n = 0
    for at in range(0, len(sample), 256):
        x = sample[at : at + 256]
        far = (x @ kept[:n].T).max(axis=1) < spread if n else np.ones(len(x), dtype=bool)
        x = x[far]
        own = x @ x.T
        free = np.ones(len(x), dtype=bool)
        for i in range(len(x)):
            if n == count:
                return kept
            if free[i]:
                kept[n] = x[i]
                n += 1
                free &= own[i] < spread
    return kept[:n]


def find_pivots(merged: DataFrame, counts: dict[int, int], spread: float) -> dict[int, np.ndarray]:
    """dim -> pivots, from merged(dim, h1, v): sampled by hash, chosen in tasks and then in one task a dimension."""
    share = F.create_map(*[F.lit(x) for d, (n, c) in counts.items() for x in (d, min(1.0, 4.0 * c / n))])
    place = (F.shiftrightunsigned("h1", 11).cast("double")) / F.lit(float(1 << 53))
    sample = merged.where(place < share[F.col("dim")]).select("dim", "h1", F.transform("v", lambda x: x.cast("double")).alias("v"))
    parts = F.create_map(*[F.lit(x) for d, (n, c) in counts.items() for x in (d, -(-min(n, 4 * c) // 4096))])

    def choose(limit):
        def run(batches):
            held: dict[int, list[np.ndarray]] = {}
            for batch in batches:
                dims = batch.column(0).to_numpy()
                for d in np.unique(dims).tolist():
                    held.setdefault(d, []).append(vectors_of(batch.column(2).filter(pa.array(dims == d)), d))
            for d, xs in held.items():
                for x in choose_pivots(np.concatenate(xs), limit(d), spread):
                    yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([0], pa.int64()), pa.array([x.tolist()])], names=["dim", "h1", "v"])

        return run

    count = {d: c for d, (_, c) in counts.items()}
    kind = "dim int, h1 long, v array<double>"
    some = sample.withColumn("part", F.pmod(F.col("h1"), parts[F.col("dim")])).repartition("dim", "part").sortWithinPartitions("dim", "h1").select("dim", "h1", "v").mapInArrow(choose(count.get), kind)
    best = some.repartition("dim").sortWithinPartitions("dim", F.xxhash64("v")).mapInArrow(choose(count.get), kind)
    rows = best.select("dim", F.transform("v", lambda x: x.cast("float")).alias("v")).toArrow()  # at most max_pivots a dimension
    found: dict[int, list] = {}
    dims = rows.column("dim").to_numpy()
    flat = rows.column("v").combine_chunks()
    for d in np.unique(dims).tolist():
        of = flat.filter(pa.array(dims == d))
        found[d] = unit(of.flatten().to_numpy(zero_copy_only=False).reshape(-1, d).astype(np.float64))
    return found


def nearest_pivots(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """[row, prefix] pivot numbers, nearest first."""
    sim = x @ pivots.T
    k = min(prefix, len(pivots))
    top = np.argpartition(-sim, k - 1, axis=1)[:, :k]
    return np.take_along_axis(top, np.argsort(-np.take_along_axis(sim, top, axis=1), axis=1, kind="stable"), axis=1).astype(np.int32)


def unit(x: np.ndarray) -> np.ndarray:
    # scaled first, so that neither tiny nor huge components over- or underflow
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def vectors_of(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return unit(flat.reshape(-1, dim))


def shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """[i, j]: number of pivots common to rows a[i] and b[j] (each row without repeats, -1 for none)."""
    names = np.unique(a[a >= 0])
    if not len(names):
        return np.zeros((len(a), len(b)), dtype=np.float32)

    def flags(rows: np.ndarray) -> np.ndarray:
        m = np.zeros((len(rows), len(names)), dtype=np.float32)
        at = np.minimum(np.searchsorted(names, rows), len(names) - 1)
        hit = (names[at] == rows) & (rows >= 0)
        m[np.nonzero(hit)[0], at[hit]] = 1.0
        return m

    return flags(a) @ flags(b).T


def labels(adj_rows: list[tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
    """Smallest reachable position for links given as (i, j) arrays."""
    lab = np.arange(n)
    if not adj_rows:
        return lab
    i, j = (np.concatenate(x) for x in zip(*adj_rows))
    while True:
        new = lab.copy()
        np.minimum.at(new, i, lab[j])
        np.minimum.at(new, j, lab[i])
        new = np.minimum(new, new[new])
        if (new == lab).all():
            return lab
        lab = new


def links_in_list(pivot: int, ids: np.ndarray, weights: np.ndarray, block: np.ndarray, cross: bool, x: np.ndarray, prefix: np.ndarray, posted: int, min_shared: int, threshold: float):
    """(weighted link counts per row, [(u, v)] spanning forest) for one list or pair of its blocks.

    min_shared 0: exact lists, where prefix has the nearest pivot alone and pairs need one row at home.
    """
    n = len(ids)
    counts = np.zeros(n, dtype=np.int64)
    found, held = [], 0
    post = np.where(prefix[:, :posted] < pivot, prefix[:, :posted], -1)  # posted pivots before this one
    home = prefix[:, 0] == pivot
    for lo in range(0, n, TILE):
        a = slice(lo, lo + TILE)
        for start in range(lo, n, TILE):
            b = slice(start, start + TILE)
            if min_shared:
                ok = (shared(prefix[a], prefix[b]) >= min_shared) & (shared(post[a], post[b]) == 0)
            else:
                ok = home[a][:, None] | home[b][None, :]
            if cross:
                ok &= block[a][:, None] != block[b][None, :]
            if start == lo:
                ok = np.triu(ok, 1)
            if not ok.any():
                continue
            ok &= x[a] @ x[b].T >= threshold
            i, j = np.nonzero(ok)
            i, j = i + lo, j + start
            np.add.at(counts, i, weights[j])
            np.add.at(counts, j, weights[i])
            found.append((i, j))
            held += len(i)
            if held > 4_000_000:
                lab = labels(found, n)
                found, held = [(np.arange(n), lab)], 0
    lab = labels(found, n)
    moved = np.flatnonzero(lab != np.arange(n))
    return counts, ids[moved], ids[lab[moved]]


class Index:
    """Pivots of every dimension, numbered through, and how vectors are described by them."""

    def __init__(self, pivots: dict[int, np.ndarray], prefix: int, posted: int, min_shared: int, angle: float | None = None):
        self.pivots, self.posted, self.angle = pivots, posted, angle
        self.base, at = {}, 0
        for d in sorted(pivots):
            self.base[d] = at
            at += len(pivots[d])
        self.size = at
        self.prefix = {d: min(prefix, max(posted, len(p) // 4), len(p)) for d, p in pivots.items()}
        self.need = {d: min(min_shared, self.prefix[d], max(1, len(p) // 8)) if angle is None else 0 for d, p in pivots.items()}

    def describe(self, d: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(nearest pivots [row, prefix], and the lists to post in: row, pivot) of unit vectors of one dimension."""
        if self.angle is None:
            near = nearest_pivots(x, self.pivots[d], self.prefix[d]) + self.base[d]
            lists = near[:, : self.posted]
            return near, np.repeat(np.arange(len(x)), lists.shape[1]), lists.reshape(-1).astype(np.int64)
        angles = np.arccos(np.clip(x @ self.pivots[d].T, -1.0, 1.0))
        near = angles.argmin(axis=1)
        # a pair is found in the list of the smaller of the two nearest pivots
        row, p = np.nonzero((angles <= angles.min(axis=1, keepdims=True) + 2 * self.angle + 1e-6) & (np.arange(angles.shape[1])[None, :] <= near[:, None]))
        return (near + self.base[d]).astype(np.int32)[:, None], row, p.astype(np.int64) + self.base[d]


def embedding_groups(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD, per_root: float = 4.0, max_pivots: int = 16_384,
                     prefix: int = 16, posted: int = 4, min_shared: int = 3, spread: float = 0.8, list_rows: int = 2048, exact: bool = False) -> DataFrame:
    """One row per row of df: id, n_links, component (smallest id reachable), kept (id = component). exact: every link, at a higher cost."""
    scratch = Scratch(df.sparkSession)
    vec = F.col(vec_col)
    fine = vec.isNotNull() & (F.size(vec) > 0) & ~F.exists(vec, lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == float("inf"))) & F.exists(vec, lambda v: v != 0)
    rows = df.select(F.col(id_col).alias("id"), vec.alias("v"), F.coalesce(fine, F.lit(False)).alias("fine"), F.size(vec).alias("dim"), F.xxhash64(vec).alias("h1"), F.xxhash64(F.lit(1), vec).alias("h2"))
    key = F.coalesce("id", F.lit(NO_ID)).cast("long")
    merged = rows.where("fine").groupBy("dim", "h1", "h2").agg(F.min(key).alias("low"), F.count(F.lit(1)).alias("w"), F.first("v").alias("v"))
    merged = scratch.keep(merged.withColumn("rep", F.monotonically_increasing_id()), "merged")  # numbers of its own: ids may be shared
    sizes = {r["dim"]: r["count"] for r in merged.groupBy("dim").count().collect()}  # a row a dimension
    if not sizes:
        scratch.drop("merged")
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"), F.lit(True).alias("kept"))
    wanted = {d: (n, int(min(max_pivots, max(64, math.ceil(per_root * math.sqrt(n)))))) for d, n in sizes.items()}
    if exact:  # vectors are posted in many lists, so there are fewer
        wanted = {d: (n, max(8, c // 8)) for d, (n, c) in wanted.items()}
    index = Index(find_pivots(merged, wanted, spread), prefix, posted, min_shared, math.acos(threshold) if exact else None)

    def described(batch: pa.RecordBatch, at: int):
        """(rows of the batch, vectors, nearest, list row, list pivot) for each dimension of a batch."""
        dims = batch.column(0).to_numpy()
        for d in np.unique(dims).tolist():
            who = np.flatnonzero(dims == d)
            x = vectors_of(batch.column(at).take(pa.array(who)), d)
            yield who, x, *index.describe(d, x)

    def count_lists(batches):
        total = np.zeros(index.size, dtype=np.int64)
        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                for *_, p in described(whole.slice(lo, 1000), 1):
                    total += np.bincount(p, minlength=index.size)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(index.size)), pa.array(total)], names=["p", "c"])

    # lengths of the lists: one number per pivot
    lengths = {r["p"]: r["c"] for r in merged.select("dim", "v").mapInArrow(count_lists, "p long, c long").groupBy("p").agg(F.sum("c").alias("c")).collect()}
    blocks = np.array([max(1, -(-lengths.get(p, 0) // list_rows)) for p in range(index.size)], dtype=np.int64)

    def post(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, 250 if exact else 1000):
                batch = whole.slice(lo, 250 if exact else 1000)
                for who, _, near, row, p in described(batch, 3):
                    rep = batch.column(1).to_numpy()[who]
                    g = blocks[p]
                    own = (rep[row].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % g
                    src = np.repeat(np.arange(len(p)), g)
                    other = np.arange(len(src)) - np.repeat(np.cumsum(g) - g, g)
                    p, own, row = p[src], own[src], row[src]
                    for at in range(0, len(p), 5000):
                        c = slice(at, at + 5000)
                        take = pa.array(who[row[c]])
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(p[c]), pa.array(np.minimum(own, other)[c]), pa.array(np.maximum(own, other)[c]), pa.array(own[c]), *(batch.column(k).take(take) for k in (0, 1, 2)),
                             pa.array(list(near[row[c]]), pa.list_(pa.int32())), batch.column(3).take(take)],
                            names=["p", "bi", "bj", "own", "dim", "rep", "w", "near", "v"],
                        )

    def verify(batches):
        held: list[pa.RecordBatch] = []  # of the last list
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            k = [batch.column(c).to_numpy() for c in (0, 1, 2)]
            if held and last != tuple(c[0] for c in k):
                yield from lists_of(held)
                held = []
            last = tuple(c[-1] for c in k)
            cut = int(np.argmax(np.logical_and.reduce([c == v for c, v in zip(k, last)])))
            if cut:
                yield from lists_of([*held, batch.slice(0, cut)])
                held = []
            held.append(batch.slice(cut))
        if held:
            yield from lists_of(held)

    def lists_of(batches):
        t = pa.Table.from_batches(batches).combine_chunks()
        p, bi, bj, own, dims, rep, w = (t.column(c).to_numpy() for c in ("p", "bi", "bj", "own", "dim", "rep", "w"))
        change = np.concatenate(([True], (p[1:] != p[:-1]) | (bi[1:] != bi[:-1]) | (bj[1:] != bj[:-1])))
        starts = np.append(np.flatnonzero(change), len(p))
        out = []
        for s, e in zip(starts[:-1], starts[1:]):
            if e - s < 2:
                continue
            d = int(dims[s])
            x = vectors_of(t.column("v").slice(s, e - s).combine_chunks(), d)
            near = t.column("near").slice(s, e - s).combine_chunks().flatten().to_numpy().reshape(e - s, -1)
            counts, u, v = links_in_list(int(p[s]), rep[s:e], w[s:e], own[s:e], bool(bi[s] != bj[s]), x, near, posted, index.need[d], threshold)
            hit = np.flatnonzero(counts)
            if len(hit):
                out.append((rep[s:e][hit], np.full(len(hit), -1), counts[hit]))
                out.append((u, v, np.zeros(len(u), dtype=np.int64)))
        if out:
            a, b, c = (np.concatenate(z) for z in zip(*out))
            for i in range(0, len(a), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(z[i : i + 50_000], pa.int64()) for z in (a, b, c)], names=["u", "v", "n"])

    kind = df.schema[vec_col].dataType.simpleString()
    posts = merged.select("dim", "rep", "w", "v").mapInArrow(post, f"p long, bi long, bj long, own long, dim int, rep long, w long, near array<int>, v {kind}")
    found = scratch.keep(posts.repartition("p", "bi", "bj").sortWithinPartitions("p", "bi", "bj").mapInArrow(verify, "u long, v long, n long"), "links")
    degree = found.where("v = -1").groupBy(F.col("u").alias("d_rep")).agg(F.sum("n").alias("n"))
    comp = connected_components(found.where("v <> -1").select("u", "v"), scratch)
    info = merged.select("h1", "h2", "rep", "low", "w").join(degree, F.col("rep") == F.col("d_rep"), "left").join(comp, F.col("rep") == F.col("node"), "left")
    info = scratch.keep(info.select("h1", "h2", "low", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("component", "rep").alias("c")), "members", narrow=True)
    lowest = info.groupBy("c").agg(F.min("low").alias("component"))
    info = scratch.keep(info.join(lowest, "c").select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), "n_links", "component"), "groups", narrow=True)
    scratch.drop("merged", "links", "members", *[n for n in scratch.paths if n.startswith("star")])
    out = rows.select("id", "h1", "h2", "fine").join(info, F.col("fine") & (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")), "left")
    component = F.coalesce("component", key)
    return out.select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(component != NO_ID, component).alias("component"), (component == key).alias("kept"),
    )


def op9_embedding_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_groups(table(spark, sf_dir, "embeddings")).withColumnRenamed("component", "component_id")
