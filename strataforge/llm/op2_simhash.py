"""SimHash fingerprints and near-duplicate groups by the generalised pigeonhole principle.

1. `fingerprints` (Arrow map over whole texts): XXH64 of every word shingle, bit majorities.
2. Equal fingerprints (where links are verified: equal word sequences) become one node, standing for
   the row of the least (id, content), so exact copies never meet each other again.
3. Partitions of bits: co-occurrence counts of the 64 bits of a word over all fingerprints (64 x 64
   numbers, whatever the corpus) give correlations; strongly correlated bits are grouped
   into the same partition, the partitions being of nearly equal width. For 64-bit fingerprints their
   number follows from the number of fingerprints by a cost estimate.
4. Thresholds: two fingerprints within `tau` bits agree in some partition i within t_i bits when
   the t_i >= -1 sum up to tau - m + 1. For every fingerprint a dynamic program chooses the
   t_i that minimise its probes and the candidates expected from histograms of the partitions'
   bytes; a partition whose value is frequent is then skipped (-1) or probed exactly, and others
   are probed wider.
5. Probe and verify: fingerprints and probes meet by (partition, value). What is sent on is a
   spanning forest of the links, the shortest first, in place of all pairs; where links are only
   candidates for verification, those left out are offered again in further rounds until none joins
   two groups. A value held by many fingerprints is dealt into blocks, and pairs of blocks go to
   different tasks, so that each pair of rows meets in one of them.
6. Connected components of the links; the row of the smallest (id, content) stands for the group.

Without verification links are exact: the thresholds cover every pair within tau bits, and each
candidate is compared. With it (`min_similarity`) the fingerprint is wider (WIDE_WORDS words of 64 bits, of
the set of shingles), so that many partitions of 16 bits take part and few probes find nearly all
pairs of the similarity asked for. A bound from the parities of the sets' hashes excludes candidates that can't be
that similar; of all others the texts are fetched and the shingle sets compared exactly.

Defined cases: a null or empty text, or one without words, has fingerprint zero and links as any
other; texts of fewer words than a shingle are hashed whole; repeated rows are one group, of which one
stays; rows that share an id, or have none, are told apart by their content; a null id counts as larger
than any other; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strataforge.llm._common import Scratch, arrow_rows, may_be_in, ship, table
from strataforge.llm.components import connected_components

SEED = 42
TAU = 4
NO_ID = (1 << 63) - 1
PROBE_COST, CANDIDATE_COST = 1.0, 0.005
#: Candidates for verification, in the first round: of texts with more links than this, those that a
#: shortest forest needs. What is left out is offered again in rounds, each with DEGREE_GROWTH times as many.
CANDIDATE_DEGREE, DEGREE_GROWTH = 16, 4
#: Rows of one value that are compared in one piece; hot values are dealt into blocks of so many. At most
#: HOT_VALUES hot values reach the driver: beyond 10^7 texts blocks grow, and more bits a partition are due.
BLOCK_ROWS, HOT_VALUES = 1 << 14, 1 << 16
#: Fingerprints for verified links: words of 64 bits (4 partitions of 16 bits each), the largest distance of
#: the word that is compared before texts are, and the largest threshold. Texts at a similarity of 0.8 differ in 15 %
#: of the bits, so two of them agree in one of 40 partitions in 95 of 100 cases (measured: README), and
#: differ in over 20 of 64 bits in one of 10,000.
WIDE_WORDS, WORD_REACH, MOST = 10, 20, 2
#: Bits of a shingle set's parity map, for an upper bound on the overlap of two sets; maps of more shingles have
#: a bit for each, and are folded to so many where rows carry them.
PARITY_BITS = 1024


def word_list(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_hashes(words: list[bytes], width: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of each shingle, repeats included; of the whole sequence where it is shorter; none without words."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    if not words:
        return np.zeros(0, dtype=np.uint64)
    line = b" ".join(words)
    if len(words) <= width:
        return np.array([digest(line, seed)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[: -width] + 1))
    return np.fromiter((digest(line[a:b], seed) for a, b in zip(starts.tolist(), ends[width - 1 :].tolist())), dtype=np.uint64, count=len(starts))


def majority(h: np.ndarray, n_words: int = 1) -> np.ndarray:
    """The fingerprint of hashes h as n_words numbers of 64 bits; beyond the first from hashes mixed anew."""
    counts = np.zeros(64 * n_words, dtype=np.int64)
    for at in range(0, len(h), 255):  # so many fit a byte's counter
        x = h[at : at + 255]
        if n_words > 1:
            x = np.stack([x, *[mixed(x, k) for k in range(1, n_words)]], axis=1)
        counts += np.add.reduce(np.unpackbits(x.view(np.uint8).reshape(len(x), -1), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return np.packbits(2 * counts > len(h), bitorder="little").view("<u8")


def mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th other hash of the same shingles."""
    x = h ^ np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def simhash(text: str | None, width: int = 4, seed: int = SEED) -> int:
    return int(majority(shingle_hashes(word_list(text), width, seed))[0])


def words_hash(words: list[bytes], seed: int = SEED) -> int:
    """Of all words in order, so equal for texts of equal shingles at any width."""
    import xxhash

    return xxhash.xxh64_intdigest(b" ".join(words), seed + 1)


def row_key(df: DataFrame, id_col: str) -> list[Column]:
    """id (null: NO_ID, the largest) and 128 bits of a row's content: rows of equal keys are equal.

    Columns with maps, which have no order, are left out of the content.
    """
    plain = [F.col(f"`{f.name}`") for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(F.lit(1), *plain).alias("h1"), F.xxhash64(F.lit(2), *plain).alias("h2")]


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, seed: int = SEED, n_words: int = 1) -> DataFrame:
    """id, h1, h2 (row_key), fp: a signed long, and beyond one word of 64 bits all words in `wide` (of different shingles), words (words_hash) and the map of the shingle set."""
    ship(df.sparkSession)
    schema = "id long, h1 long, h2 long, fp long" + ", wide binary, words long, map binary" * (n_words > 1)
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols: list[list] = [[] for _ in names[3:]]
        for t in batch.column(3):
            words = word_list(t.as_py())
            h = shingle_hashes(words, width, seed)
            if n_words > 1:
                f = majority(s := np.unique(h), n_words)
                cols[1].append(f.tobytes())
                cols[2].append(words_hash(words, seed))
                cols[3].append(parity_map(s, map_bits(len(s))))
            else:
                f = majority(h)
            cols[0].append(int(f[0]))
        longs = lambda c: pa.array(np.array(c, dtype=np.uint64).view(np.int64))
        return pa.RecordBatch.from_arrays([*batch.columns[:3], longs(cols[0]), *([pa.array(cols[1], pa.binary()), longs(cols[2]), pa.array(cols[3], pa.binary())] if n_words > 1 else [])], names=names)

    return df.select(*row_key(df, id_col), F.col(text_col).cast("string").alias("_text")).mapInArrow(arrow_rows(run), schema)


def words_of(column: pa.Array) -> np.ndarray:
    """[row, word] of a column of longs or of binaries of equal lengths."""
    if not pa.types.is_binary(column.type):
        return column.to_numpy().view(np.uint64).reshape(-1, 1)
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, dtype="<u8").reshape(len(column), -1)


# ---- partitions and thresholds ------------------------------------------------------------


def bits_of(fp: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(fp).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def bit_statistics(distinct: DataFrame, column: str = "fp") -> tuple[int, np.ndarray]:
    """(number of fingerprints, co-occurrence counts [word, 64, 64]); one row of sums per task, then one of all."""

    def run(batches):
        n, co = 0, None
        for batch in batches:
            f = words_of(batch.column(0))
            if co is None:
                co = np.zeros((f.shape[1], 64, 64))
            for k in range(f.shape[1]):
                x = bits_of(f[:, k]).astype(np.float32)
                co[k] += x.T @ x
            n += len(f)
        if co is not None:
            k = np.arange(co.size)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(k, -1)), pa.array(np.append(co.reshape(-1), n).astype(np.int64))], names=["k", "c"])

    rows = distinct.select(column).mapInArrow(run, "k long, c long").groupBy("k").agg(F.sum("c").alias("c")).collect()  # 4096 rows a word
    if not rows:
        return 0, np.zeros((1, 64, 64))
    co, n = np.zeros(len(rows) - 1), 0
    for r in rows:
        if r["k"] < 0:
            n = r["c"]
        else:
            co[r["k"]] = r["c"]
    return n, co.reshape(-1, 64, 64)


def ball(width: int, radius: int) -> int:
    return sum(math.comb(width, r) for r in range(radius + 1))


def choose_parts(n: int, tau: int = TAU, bits: int = 64) -> int:
    """Number of partitions with the least expected cost of a probe's fingerprint on evenly spread values."""

    def cost(m: int) -> float:
        base, extra = divmod(tau - m + 1, m)
        total = 0.0
        for i in range(m):
            w = bits // m + (i < bits % m)
            t = base + (i < extra)
            total += ball(w, t) * (PROBE_COST + CANDIDATE_COST * n / 2.0**w) + PROBE_COST
        return total

    return min(range(1, min(tau + 1, 8) + 1), key=cost)


def group_bits(n: int, co: np.ndarray, m: int) -> list[list[int]]:
    """m partitions of nearly equal width: each starts with the free bit of the strongest correlation and takes the free bits most correlated to it."""
    p = np.diag(co) / max(n, 1)
    cov = co / max(n, 1) - np.outer(p, p)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    r = np.round(np.abs(cov / np.outer(sd, sd)), 9)
    np.fill_diagonal(r, 0.0)
    free, parts = list(range(64)), []
    for i in range(m):
        width = 64 // m + (i < 64 % m)
        sub = r[np.ix_(free, free)]
        part = [free.pop(int(sub.max(axis=1).argmax()))]
        while len(part) < width:
            near = r[np.ix_(free, part)].sum(axis=1)
            part.append(free.pop(int(near.argmax())))
        parts.append(sorted(part))
    return parts


def part_values(fp: np.ndarray, parts: list[list[int]]) -> list[np.ndarray]:
    """The bits of each partition, packed into an integer; bit b is bit b % 64 of word b // 64."""
    u = fp.view(np.uint64).reshape(len(fp), -1)
    out = []
    for part in parts:
        v = np.zeros(len(u), dtype=np.uint64)
        for k, b in enumerate(part):
            v |= ((u[:, b // 64] >> np.uint64(b % 64)) & np.uint64(1)) << np.uint64(k)
        out.append(v)
    return out


def chunks_of(parts: list[list[int]]) -> list[tuple[int, int, int]]:
    """(partition, low bit, width) of pieces of at most 8 bits, for histograms."""
    return [(i, k, min(8, len(p) - k)) for i, p in enumerate(parts) for k in range(0, len(p), 8)]


def histograms(distinct: DataFrame, parts: list[list[int]], column: str = "fp") -> list[np.ndarray]:
    """For each chunk the number of fingerprints at each of its (at most 256) values."""
    chunks = chunks_of(parts)

    def run(batches):
        held = [np.zeros(256, dtype=np.int64) for _ in chunks]
        for batch in batches:
            values = part_values(words_of(batch.column(0)), parts)
            for h, (i, low, w) in zip(held, chunks):
                h += np.bincount(((values[i] >> np.uint64(low)) & np.uint64((1 << w) - 1)).astype(np.int64), minlength=256)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(256 * len(chunks))), pa.array(np.concatenate(held))], names=["k", "c"])

    out = np.zeros(256 * len(chunks), dtype=np.int64)
    for r in distinct.select(column).mapInArrow(run, "k long, c long").groupBy("k").agg(F.sum("c").alias("c")).collect():
        out[r["k"]] = r["c"]
    return list(out.reshape(-1, 256))


class Allocator:
    """Thresholds of each fingerprint by dynamic programming on estimated candidates; none is over `most`."""

    def __init__(self, n: int, parts: list[list[int]], hist: list[np.ndarray], tau: int = TAU, most: int | None = None):
        self.parts, self.tau, self.n = parts, tau, n
        self.most = tau if most is None else min(most, tau)
        if len(parts) * (self.most + 1) < tau + 1:
            raise ValueError("the partitions can't share out tau")
        distance = np.bitwise_count(np.arange(256)[:, None] ^ np.arange(256)[None, :])
        self.shares = []
        for (i, low, w), h in zip(chunks_of(parts), hist):
            near = np.stack([((distance == e) * h[None, :]).sum(axis=1) for e in range(self.most + 1)], axis=1) / max(n, 1)
            self.shares.append((i, low, w, near))  # near[value, e]: share of fingerprints at distance e

    def candidates(self, values: list[np.ndarray]) -> np.ndarray:
        """[row, partition, t]: expected fingerprints within t of the row's value, t = 0..most; chunks count as independent."""
        out = np.zeros((len(values[0]), len(self.parts), self.most + 1))
        out[:, :, 0] = 1.0
        for i, low, w, near in self.shares:
            v = ((values[i] >> np.uint64(low)) & np.uint64((1 << w) - 1)).astype(np.int64)
            d, old = near[v], out[:, i].copy()
            new = np.zeros_like(old)
            for e in range(self.most + 1):
                new[:, e:] += d[:, e : e + 1] * old[:, : self.most + 1 - e]
            out[:, i] = new
        return np.cumsum(out, axis=2) * self.n

    def allocate(self, values: list[np.ndarray]) -> np.ndarray:
        """[row, partition]: thresholds, each at least -1, with sum tau - m + 1."""
        m, rows = len(self.parts), len(values[0])
        found = self.candidates(values)
        cost = np.zeros((rows, m, self.most + 2))  # column t + 1
        for i, part in enumerate(self.parts):
            for t in range(self.most + 1):
                cost[:, i, t + 1] = PROBE_COST * ball(len(part), t) + CANDIDATE_COST * found[:, i, t]
        budget = self.tau + 1  # the shifted thresholds t + 1 >= 0 sum up to tau - m + 1 + m
        best = np.full((rows, budget + 1), np.inf)
        best[:, 0] = 0.0
        pick = np.zeros((m, rows, budget + 1), dtype=np.int8)
        for i in range(m):
            new = np.full_like(best, np.inf)
            for k in range(min(self.most + 1, budget) + 1):
                v = best[:, : budget + 1 - k] + cost[:, i, k : k + 1]
                better = v < new[:, k:]
                new[:, k:][better] = v[better]
                pick[i, :, k:][better] = k
            best = new
        out = np.zeros((rows, m), dtype=np.int64)
        s = np.full(rows, budget)
        at = np.arange(rows)
        for i in range(m - 1, -1, -1):
            k = pick[i, at, s].astype(np.int64)
            out[:, i] = k - 1
            s = s - k
        return out


def flips(width: int, radius: int) -> np.ndarray:
    """All masks of 1..radius bits."""
    masks = np.zeros(1, dtype=np.uint64)
    level = masks
    for _ in range(radius):
        level = np.unique((level[:, None] ^ (np.uint64(1) << np.arange(width, dtype=np.uint64))[None, :]).reshape(-1))
        masks = np.unique(np.concatenate((masks, level)))
    return masks[masks != 0]


# ---- probing ------------------------------------------------------------------------------


#: Rows of a bucket: index rows that look for others, index rows that are only found (threshold -1), probes.
SEEK, STAY, PROBE = 0, 1, 2


def _probe_rows(alloc: Allocator, hot: dict[int, int], more: tuple[str, ...] = ()):
    """(rep, fingerprint, *more) -> (key, cell, kind, block, rep, fp, *more): index rows in every partition, probes within its threshold.

    Of a fingerprint of several words the row carries one that the partition is not of. A value of
    many fingerprints has several blocks, among which its rows are dealt; each pair of blocks is a
    cell, where only rows of different blocks meet if it has two.
    """
    parts = alloc.parts
    masks = {(len(p), t): flips(len(p), t) for p in parts for t in range(1, alloc.most + 1) if ball(len(p), t) < 1 << 20}
    names = ["key", "cell", "kind", "block", "rep", "fp", *more]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 2048):
                yield from of(whole.slice(lo, 2048))

    def of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rep, fp = batch.column(0).to_numpy(), words_of(batch.column(1))
        values = part_values(fp, parts)
        limit = alloc.allocate(values)
        row = np.arange(len(fp))
        for i, v in enumerate(values):
            base = np.int64(i) << np.int64(56)
            # an index row serves as the exact probe too
            keys, rows, kinds = [v.astype(np.int64) | base], [row], [np.where(limit[:, i] < 0, STAY, SEEK).astype(np.int8)]
            for t in np.unique(limit[:, i]):
                if t >= 1:
                    who = row[limit[:, i] == t]
                    mask = masks.get((len(parts[i]), int(t)))
                    if mask is None:
                        mask = flips(len(parts[i]), int(t))
                    keys.append(((v[who][:, None] ^ mask[None, :]).reshape(-1)).astype(np.int64) | base)
                    rows.append(np.repeat(who, len(mask)))
                    kinds.append(np.full(len(who) * len(mask), PROBE, dtype=np.int8))
            k, r, kind = np.concatenate(keys), np.concatenate(rows), np.concatenate(kinds)
            check = fp[:, (parts[i][0] // 64 + 1) % fp.shape[1]].view(np.int64)
            block, cell = np.zeros(len(k), dtype=np.int32), np.zeros(len(k), dtype=np.int64)
            if hot:
                n = np.array([hot.get(x, 1) for x in k.tolist()], dtype=np.int64)
                if (n > 1).any():
                    own = ((mixed(rep[r].view(np.uint64), 1) >> np.uint64(11)) % n.astype(np.uint64)).astype(np.int64)
                    src = np.repeat(np.arange(len(k)), n)
                    other = np.arange(len(src)) - np.repeat(np.cumsum(n) - n, n)
                    own = own[src]
                    k, r, kind, block = k[src], r[src], kind[src], own.astype(np.int32)
                    cell = np.minimum(own, other) << np.int64(32) | np.maximum(own, other)
            for at in range(0, len(k), 50_000):
                cut = slice(at, at + 50_000)
                yield pa.RecordBatch.from_arrays([pa.array(x[cut]) for x in (k, cell, kind, block)] + [pa.array(rep[r[cut]]), pa.array(check[r[cut]]), *[batch.column(c).take(pa.array(r[cut])) for c in range(2, 2 + len(more))]], names=names)

    return run


def spanning_forest(f: np.ndarray, tau: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links (positions) that connect the different fingerprints f as all links within tau bits do.

    Breadth-first search against the rows not yet reached.
    """
    rest = np.arange(len(f))
    while len(rest) > 1:
        todo, rest = [rest[0]], rest[1:]
        while todo and len(rest):
            x = todo.pop()
            near = np.bitwise_count(f[rest] ^ f[x]) <= tau
            if near.any():
                found = rest[near]
                yield np.full(len(found), x), found
                todo.extend(found)
                rest = rest[~near]


def _lowest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Smallest position reachable by links (i, j), for n positions."""
    lab = np.arange(n)
    while True:
        new = lab.copy()
        np.minimum.at(new, i, lab[j])
        np.minimum.at(new, j, lab[i])
        new = new[new]
        if (new == lab).all():
            return lab
        lab = new


def thin_links(u: np.ndarray, v: np.ndarray, d: np.ndarray, degree: int | None) -> np.ndarray:
    """Which of the links (u, v) at distances d to keep so that they connect what all do, the shortest first.

    Links between nodes of at most `degree` links all stay; None: a forest only. Of equal
    links the first stays, so the order of the links decides.
    """
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    i, j = at[: len(u)], at[len(u) :]
    keep = np.zeros(len(u), dtype=bool)
    if degree is not None:
        n = np.bincount(at, minlength=len(nodes))
        keep = (n[i] <= degree) & (n[j] <= degree)
    lab = _lowest(i[keep], j[keep], len(nodes))
    for t in np.unique(d):
        while True:  # one link for each pair of parts at this distance, until no parts are left to join
            open_ = np.flatnonzero((d == t) & (lab[i] != lab[j]))
            if not len(open_):
                break
            a, b = lab[i[open_]], lab[j[open_]]
            _, first = np.unique(np.maximum(a, b), return_index=True)  # each part joins one of smaller label
            pick = open_[first]
            keep[pick] = True
            low = _lowest(lab[i[pick]], lab[j[pick]], len(nodes))
            lab = low[lab]
    return keep


PAIRS_AT_ONCE = 250_000
GROUP_PAIRS = 20_000_000
#: The same where a degree is given, and links are thinned as they come: each that is held takes some 100 bytes.
THINNED_PAIRS, HELD_PAIRS = 100_000, 250_000


class Known:
    """What later rounds know of the rows: their component, and size and parity map of their shingle sets."""

    def __init__(self, label: np.ndarray, sets: list[bytes], least: float):
        packed = np.frombuffer(b"".join(sets), dtype="<u8").reshape(len(label), 1 + PARITY_BITS // 64)
        self.label, self.size, self.parity, self.least = label, packed[:, 0].astype(np.float64), packed[:, 1:], least

    def open_pairs(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Which pairs of rows are of different components and not certainly below the similarity.

        Each differing parity needs a shingle that only one of the sets has.
        """
        ok = self.label[x] != self.label[y]
        at = np.flatnonzero(ok)
        for lo in range(0, len(at), 50_000):
            cut = at[lo : lo + 50_000]
            i, j = x[cut], y[cut]
            n = self.size[i] + self.size[j]
            both = (n - np.bitwise_count(self.parity[i] ^ self.parity[j]).sum(axis=1, dtype=np.int64)) / 2
            ok[cut] = both >= self.least * (n - both)
        return ok


def links_of_groups(group: np.ndarray, kind: np.ndarray, rep: np.ndarray, fp: np.ndarray, tau: int, degree: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The links of thinned_groups."""
    return thinned_groups(group, kind, rep, fp, tau, degree)[:2]


def thinned_groups(group: np.ndarray, kind: np.ndarray, rep: np.ndarray, fp: np.ndarray, tau: int, degree: int | None = None, known: Known | None = None, block: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links within groups, and the nodes of links left out. Rows are sorted by group, then by kind.

    Rows that SEEK meet all rows of the group, those that STAY meet probes, and probes do not meet;
    rows of one block meet only where the group has no other (block: None if no group has two). Of a
    group of over GROUP_PAIRS such pairs (THINNED_PAIRS with a degree) a forest comes from breadth-first search instead if
    no degree is given and all its rows seek; else it is compared in steps and thinned as they come. Links are
    thinned within their group, so the result depends on a group's rows and their order alone, not on
    what else is in the task.
    """
    n = len(group)
    starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    ends = np.append(starts[1:], n)
    size = ends - starts
    own = np.repeat(np.arange(len(starts)), size)
    probes = ends - np.add.reduceat((kind == PROBE).astype(np.int64), starts)  # where a group's probes start
    follows = np.where(kind == SEEK, np.arange(n) + 1, np.where(kind == STAY, probes[own], ends[own]))
    meets = ends[own] - follows
    wide = np.add.reduceat(meets, starts) > (GROUP_PAIRS if degree is None else min(GROUP_PAIRS, THINNED_PAIRS))
    two = np.zeros(len(starts), dtype=bool) if block is None else np.maximum.reduceat(block, starts) != np.minimum.reduceat(block, starts)
    if two.any():
        apart = two[own]

    def near_pairs(left: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """A row meets the rows that follow: (row, row, distance) within tau, PAIRS_AT_ONCE compared at a time."""
        many = meets[left]
        before = np.concatenate(([0], np.cumsum(many)))
        at = 0
        while at < len(left):
            to = max(at + 1, int(np.searchsorted(before, before[at] + PAIRS_AT_ONCE, side="right")) - 1)
            m = many[at:to]
            x = np.repeat(left[at:to], m)
            y = np.repeat(follows[left[at:to]], m) + np.arange(len(x)) - np.repeat(before[at:to] - before[at], m)
            d = np.bitwise_count(fp[x] ^ fp[y])
            at = to
            near = np.flatnonzero(d <= tau)
            x, y, d = x[near], y[near], d[near]
            near = rep[x] != rep[y]
            if two.any():
                near &= ~apart[x] | (block[x] != block[y])
            if known is not None:
                near[near] = known.open_pairs(x[near], y[near])
            yield x[near], y[near], d[near]

    def wide_pairs(s: int, e: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """near_pairs of one group less those that neither a shortest forest nor the degree keeps, thinned whenever HELD_PAIRS have come."""
        links, seen = np.zeros(e - s, dtype=np.int64), np.zeros(e - s, dtype=bool)
        held = [none, none, np.zeros(0, dtype=np.uint8)]
        new, count = [], 0

        def thin() -> None:
            nonlocal held, new, count
            x, y, d = held = [np.concatenate(z) for z in zip(held, *new)]
            few = (links[x - s] <= limit) & (links[y - s] <= limit)
            keep = few | thin_links(x, y, d, None)
            seen[x[~keep] - s] = seen[y[~keep] - s] = True
            held, new, count = [z[keep] for z in held], [], 0

        limit = 0 if degree is None else degree
        for part in near_pairs(s + np.flatnonzero(meets[s:e])):
            links += np.bincount(part[0] - s, minlength=e - s) + np.bincount(part[1] - s, minlength=e - s)
            new.append(part)
            count += len(part[0])
            if count > HELD_PAIRS:
                thin()
        thin()
        dropped.append(rep[s:e][seen])
        return tuple(held)

    none = np.zeros(0, dtype=np.int64)
    a, b, dist, of, dropped = [], [], [], [], []

    def put(x: np.ndarray, y: np.ndarray, d: np.ndarray) -> None:
        a.append(rep[x])
        b.append(rep[y])
        dist.append(d)
        of.append(own[x])

    for pairs in near_pairs(np.flatnonzero((meets > 0) & ~wide[own])):
        put(*pairs)
    for g, s, e in zip(np.flatnonzero(wide), starts[wide], ends[wide]):
        if degree is not None or two[g] or (kind[s:e] != SEEK).any():
            put(*wide_pairs(s, e))
            continue
        f, where = np.unique(fp[s:e], return_index=True)
        r = rep[s:e][where]
        for i, j in spanning_forest(f, tau):
            a.append(r[i])
            b.append(r[j])
            dist.append(np.bitwise_count(f[i] ^ f[j]))
            of.append(np.full(len(i), g))
    if not a:
        return none, none, none
    u, v, d, g = (np.concatenate(z) for z in (a, b, dist, of))
    if not len(u):
        return none, none, none
    names, code = np.unique(np.concatenate((u, v)), return_inverse=True)
    keep = thin_links(g * len(names) + code[: len(u)], g * len(names) + code[len(u) :], d, degree)
    return np.minimum(u, v)[keep], np.maximum(u, v)[keep], np.unique(np.concatenate((u[~keep], v[~keep], *dropped)))


def _verify(tau: int, degree: int | None = None, least: float | None = None):
    """Rows sorted by (key, cell, kind, fp) -> links, and (node, node, true) for nodes of links left out.

    A group may run over several batches. least: the rows have what Known needs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []  # batches of the last group
        for batch in batches:
            now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)]
            key, cell = now[0], now[1]
            if not len(key):
                continue
            if held and (held[-1][0][-1] != key[0] or held[-1][1][-1] != cell[0]):
                yield from emit(held)
                held = []
            cut = int(np.argmax((key == key[-1]) & (cell == cell[-1])))
            if cut:
                yield from emit([*held, [x[:cut] for x in now]])
                held = []
            held.append([x[cut:] for x in now])
        if held:
            yield from emit(held)

    def emit(batches):
        rows = [np.concatenate(x) for x in zip(*batches)]
        key, cell, kind, block, rep, fp = rows[:6]
        change = np.concatenate(([True], (key[1:] != key[:-1]) | (cell[1:] != cell[:-1])))
        known = None if least is None else Known(rows[6], rows[7].tolist(), least)
        a, b, out = thinned_groups(np.cumsum(change), kind, rep, fp.view(np.uint64), tau, degree, known, block)
        for x, y, cut in ((a, b, False), (out, out, True)):
            if cut and degree is None:
                break
            for i in range(0, len(x), 50_000):
                u, v = x[i : i + 50_000], y[i : i + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(np.full(len(u), cut))], names=["u", "v", "cut"])

    return run


def hamming_links(distinct: DataFrame, tau: int = TAU, hot_rows: int = BLOCK_ROWS, degree: int | None = None, parts: int | None = None) -> DataFrame:
    """distinct(rep long, fp long, one row per fp) -> links (u, v) that connect what lies within tau bits."""
    return candidate_links(distinct, tau, hot_rows, degree, parts).where("not cut").select("u", "v")


def candidate_links(distinct: DataFrame, tau: int, hot_rows: int = BLOCK_ROWS, degree: int | None = None, parts: int | None = None, least: float | None = None, column: str = "fp", reach: int | None = None, most: int | None = None) -> DataFrame:
    """Links (u, v, false) as hamming_links, and with a degree (node, node, true) for every node of a link left out.

    column: the fingerprints, longs or several words in a binary. reach: what the word that rows carry may
    differ by, where it is not tau itself (fingerprints of several words). parts: partitions of each word.
    least: distinct has the columns label and sets too, and only links that Known leaves open count.
    """
    more = () if least is None else ("label", "sets")
    n, co = bit_statistics(distinct, column)
    if not n:
        return distinct.select(F.col("rep").alias("u"), F.col("rep").alias("v"), F.lit(False).alias("cut"))
    parts = [[64 * w + b for b in p] for w in range(len(co)) for p in group_bits(n, co[w], parts or choose_parts(n, tau))]
    alloc = Allocator(n, parts, histograms(distinct, parts, column), tau, most)
    # a value's block; values of more fingerprints, at most HOT_VALUES of them, are dealt into several
    limit = max(hot_rows, math.ceil(n * len(parts) / HOT_VALUES))

    def own_keys(batches):
        for batch in batches:
            values = part_values(words_of(batch.column(0)), parts)
            for i, v in enumerate(values):
                yield pa.RecordBatch.from_arrays([pa.array(v.astype(np.int64) | (np.int64(i) << np.int64(56)))], names=["key"])

    counts = distinct.select(column).mapInArrow(own_keys, "key long").groupBy("key").count().where(F.col("count") > limit)
    hot = {r["key"]: -(-r["count"] // limit) for r in counts.collect()}
    rows = distinct.select("rep", column, *more).mapInArrow(_probe_rows(alloc, hot, more), "key long, cell long, kind byte, block int, rep long, fp long" + (", label long, sets binary" if more else ""))
    return rows.repartition("key", "cell").sortWithinPartitions("key", "cell", "kind", "fp", "rep").mapInArrow(_verify(tau if reach is None else reach, degree, least), "u long, v long, cut boolean")


def shingle_set(text: str | None, width: int, seed: int = SEED) -> np.ndarray:
    """Sorted hashes of the different shingles; texts of fewer words have one, texts without words none."""
    return np.unique(shingle_hashes(word_list(text), width, seed))


def node_texts(nodes: DataFrame, distinct: DataFrame, df: DataFrame, id_col: str, text_col: str, scratch: Scratch) -> DataFrame:
    """(node, text) of nodes(node long), by the key of the row that stands for each; equal rows repeat it.

    Texts of other rows stay where they are, but for the few that pass the filter.
    """
    keys = distinct.join(nodes.hint("shuffle_hash"), F.col("rep") == F.col("node"), "left_semi").select(F.col("rep").alias("node"), F.col("first.id").alias("k0"), F.col("first.h1").alias("k1"), F.col("first.h2").alias("k2"))
    keys = scratch.keep(keys, "keys", narrow=True)
    maybe = may_be_in(keys, ["k0", "k1", "k2"])
    rows = df.select(*row_key(df, id_col), F.col(text_col).cast("string").alias("text")).where(maybe("id", "h1", "h2"))
    return rows.join(keys.hint("shuffle_hash"), (F.col("id") == F.col("k0")) & (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2"))).select("node", "text")  # grows with the corpus: never broadcast


def similar_links(links: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Links whose texts' shingle sets (node, s) have a Jaccard similarity of at least `least`."""
    one, two = sets.toDF("u", "su"), sets.toDF("v", "sv")

    def compare(batch: pa.RecordBatch) -> pa.RecordBatch:
        ok = []
        for x, y in zip(batch.column(2), batch.column(3)):
            p, q = (np.frombuffer(b.as_py(), dtype=np.uint64) for b in (x, y))
            both = len(np.intersect1d(p, q, assume_unique=True))
            ok.append(both >= least * (len(p) + len(q) - both))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(ok))

    return links.join(one, "u").join(two, "v").select("u", "v", "su", "sv").mapInArrow(arrow_rows(compare), "u long, v long")


def sets_of(texts: DataFrame, width: int) -> DataFrame:
    """(node, s: its shingle set as bytes), one row a node."""

    def sets(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle_set(t.as_py(), width).tobytes() for t in batch.column(1)], pa.binary())], names=["node", "s"])

    return texts.mapInArrow(arrow_rows(sets), "node long, s binary").groupBy("node").agg(F.min("s").alias("s"))


def map_bits(n: int) -> int:
    """Bits of the parity map of n shingles: a power of 2, at least n."""
    return max(PARITY_BITS, 1 << (max(n, 1) - 1).bit_length())


def parity_map(s: np.ndarray, bits: int = PARITY_BITS) -> bytes:
    """Size of a set of hashes and the parities of its counts by their low bits."""
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return len(s).to_bytes(8, "little") + np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(m: bytes, bits: int = PARITY_BITS) -> bytes:
    """The parity map of fewer bits that the same set has."""
    return m[:8] + np.bitwise_xor.reduce(np.frombuffer(m, dtype=np.uint8, offset=8).reshape(-1, bits // 8), axis=0).tobytes()


def may_be_similar(p: bytes, q: bytes, least: float) -> bool:
    """False only if the sets of two maps certainly have a lower similarity.

    Each differing parity needs a shingle that only one of them has, and they share no more than the smaller one holds.
    """
    bits = 8 * (min(len(p), len(q)) - 8)
    x, y = (np.frombuffer(folded(m, bits), dtype="<u8") for m in (p, q))
    n = int(x[0]) + int(y[0])
    both = min(int(x[0]), int(y[0]), (n - int(np.bitwise_count(x[1:] ^ y[1:]).sum(dtype=np.int64))) / 2)
    return both >= least * (n - both)


def close_pairs(pairs: DataFrame, distinct: DataFrame, least: float) -> DataFrame:
    """The pairs (u, v) that the maps of distinct(rep, map) leave open, so that texts of others need not be fetched."""
    one, two = distinct.select("rep", "map").toDF("u", "mu"), distinct.select("rep", "map").toDF("v", "mv")

    def compare(batch: pa.RecordBatch) -> pa.RecordBatch:
        ok = [may_be_similar(x.as_py(), y.as_py(), least) for x, y in zip(batch.column(2), batch.column(3))]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(ok, pa.bool_()))

    return pairs.join(one.hint("shuffle_hash"), "u").join(two.hint("shuffle_hash"), "v").select("u", "v", "mu", "mv").mapInArrow(arrow_rows(compare), "u long, v long")


def maps_of(distinct: DataFrame) -> DataFrame:
    """distinct(rep, wide, map) -> (rep, wide, sets: parity_map)."""

    def maps(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([folded(m.as_py()) for m in batch.column(2)], pa.binary())], names=["rep", "wide", "sets"])

    return distinct.select("rep", "wide", "map").mapInArrow(arrow_rows(maps), "rep long, wide binary, sets binary")


def verified_links(distinct: DataFrame, df: DataFrame, id_col: str, text_col: str, width: int, least: float, scratch: Scratch, tau: int, parts: int | None, reach: int | None, most: int | None = None) -> DataFrame:
    """Links (u, v) of a Jaccard similarity of at least `least` that connect what all such links among the candidates do.

    A round verifies a thinned set of candidates, less those that the bound of their maps excludes: only texts that
    may have a partner are fetched and compared. The candidates left out come back in the next round, where pairs within a
    component, and pairs that the bound excludes, are no candidates any more and the degree is higher. The last round leaves out none.
    """
    part, links, sets, degree, k = distinct, None, None, CANDIDATE_DEGREE, 0
    while True:
        found = scratch.keep(candidate_links(part, tau, degree=degree, parts=parts, least=None if k == 0 else least, column="wide", reach=reach, most=most), f"candidates{k}")
        pairs = found.where("not cut").select("u", "v").distinct()
        pairs = scratch.keep(pairs if k else close_pairs(pairs, distinct, least), f"pairs{k}", narrow=True)
        cut = scratch.keep(found.where("cut").select(F.col("u").alias("node")).distinct(), f"cut{k}", narrow=True)
        if sets is None:
            # later rounds have only nodes of links left out in this one
            nodes = pairs.select(F.explode(F.array("u", "v")).alias("node")).union(cut).distinct()
            sets = scratch.keep(sets_of(node_texts(nodes, distinct, df, id_col, text_col, scratch), width), "sets")
            scratch.drop("keys")
        if links is None or not pairs.isEmpty():  # else the sets would be shuffled for nothing
            good = scratch.keep(similar_links(pairs, sets, least), f"links{k}")
            links = good if links is None else links.union(good)
        scratch.drop(f"candidates{k}", f"pairs{k}")
        if cut.isEmpty():
            scratch.drop("sets", f"part{k - 1}")
            return links
        labels = connected_components(links, scratch).select(F.col("node").alias("member"), "component")
        if k == 0:
            part = maps_of(distinct.join(cut.hint("shuffle_hash"), F.col("rep") == F.col("node"), "left_semi"))
        else:
            part = part.join(cut.hint("shuffle_hash"), F.col("rep") == F.col("node"), "left_semi").drop("label")
        part = part.join(labels.hint("shuffle_hash"), F.col("rep") == F.col("member"), "left")
        part = scratch.keep(part.select("rep", "wide", F.coalesce("component", "rep").alias("label"), "sets"), f"part{k}", narrow=True)
        scratch.drop(f"part{k - 1}")
        k, degree = k + 1, degree * DEGREE_GROWTH


def near_duplicates(df: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", width: int = 4, tau: int = TAU, min_similarity: float | None = None, n_words: int = WIDE_WORDS) -> tuple[DataFrame, DataFrame]:
    """(fingerprints of every row; groups: one row a node, with first, the least row_key of its rows, and low, that of its group).

    Without min_similarity a node is a fingerprint of 64 bits, and those within tau bits link. With it a node is
    a word sequence, fingerprints have n_words words with 4 partitions each, candidates come from a pigeonhole
    budget of one bit less than there are partitions, and those of texts whose `width`-word shingles
    have a lower Jaccard similarity are dropped; tau is not used.
    """
    wide = min_similarity is not None
    fps = scratch.keep(fingerprints(df, id_col, text_col, width, n_words=n_words if wide else 1), "fps")
    keys = ["fp", "words"] if wide else ["fp"]
    first = F.min(F.struct("id", "h1", "h2")).alias("first")
    # written with its numbers, so that they stay what they are
    distinct = scratch.keep(fps.groupBy(*keys).agg(first, *[F.min(c).alias(c) for c in ("wide", "map") if wide]).withColumn("rep", F.monotonically_increasing_id()), "distinct", narrow=True)
    if wide:
        links = verified_links(distinct, df, id_col, text_col, width, min_similarity, scratch, 4 * n_words - 1, 4, WORD_REACH, MOST)
    else:
        links = hamming_links(distinct, tau)
    found = connected_components(links, scratch)
    joined = distinct.join(found, F.col("rep") == F.col("node"), "left").select(*keys, "first", F.coalesce("component", "rep").alias("component"))
    joined = scratch.keep(joined, "members", narrow=True)
    low = joined.groupBy("component").agg(F.min("first").alias("low"))
    groups = scratch.keep(joined.join(low, "component").select(*keys, "first", "low"), "groups", narrow=True)
    scratch.drop("members", "distinct", *[n for n in scratch.paths if n.startswith(("links", "star", "cut", "part"))])
    return fps, groups


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None, **kw) -> DataFrame:
    """df's rows less near copies: of each group one row stays, that of the smallest (id, content); a null id is the largest.

    Rows are told apart by id and content (row_key), never by id alone: different texts of one id, or
    without ids, are documents of their own.
    """
    scratch = scratch or Scratch(df.sparkSession)
    fps, groups = near_duplicates(df, scratch, id_col, text_col, **kw)
    kept = scratch.keep(groups.select("low.*").distinct().toDF("_k0", "_k1", "_k2"), "kept", narrow=True)
    names = df.columns
    id_, h1, h2 = row_key(df, id_col)
    plain = df.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(names)], id_.alias("_id"), h1.alias("_h1"), h2.alias("_h2"))
    same = lambda a, b, c: (F.col(a) == F.col("_k0")) & (F.col(b) == F.col("_k1")) & (F.col(c) == F.col("_k2"))
    # only rows that go, or repeat, must be told from others by a shuffle; the rest stays where it is
    doubtful = fps.groupBy("id", "h1", "h2").count().join(kept.hint("shuffle_hash"), same("id", "h1", "h2"), "left").where("_k0 is null or count > 1")
    doubtful = scratch.keep(doubtful.select("id", "h1", "h2", F.col("_k0").isNotNull().alias("stays")), "doubtful", narrow=True)
    maybe = may_be_in(doubtful, ["id", "h1", "h2"])("_id", "_h1", "_h2")
    repeats = not doubtful.where("stays").isEmpty()
    scratch.drop("fps", "groups", "doubtful")
    told = plain.where(maybe).join(kept.hint("shuffle_hash"), same("_id", "_h1", "_h2"), "left_semi")  # grows with the corpus: never broadcast
    if repeats:  # rows equal in every column
        told = told.withColumn("_n", F.row_number().over(W.partitionBy("_id", "_h1", "_h2").orderBy("_h1"))).where("_n = 1").drop("_n")
    return plain.where(~maybe).union(told).select(*[f"_c{i}" for i in range(len(names))]).toDF(*names)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    fps, groups = near_duplicates(table(spark, sf_dir, "documents"), Scratch(spark))
    or_null = lambda c: F.when(c != NO_ID, c)
    return fps.join(groups.select("fp", F.col("low.id").alias("component")), "fp").select(
        or_null(F.col("id")).alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), or_null(F.col("component")).alias("component_id"))
