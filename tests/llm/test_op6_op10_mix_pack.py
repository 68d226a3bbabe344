import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataforge.llm import op6_mix as mx
from strataforge.llm import op10_pack as pk
from strataforge.llm._common import Scratch


def targets(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    """Water filling, round by round."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    rest, out, free = share * sum(sizes.values()), {}, set(order)
    while free:
        total = sum(w[s] for s in free)
        over = [s for s in free if rest * w[s] / total > cap * sizes[s]]
        if not over:
            return out | {s: rest * w[s] / total for s in free}
        for s in over:
            out[s] = cap * sizes[s]
            free.discard(s)
        rest = share * sum(sizes.values()) - sum(out.values())
    return out


def corpus(seed=1, n=3000):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        source = "s0" if rnd.random() < 0.4 else rnd.choice(["s1", "s2", "é", "z", None])
        rows.append((i, " ".join(["w"] * int(rnd.paretovariate(1.3) * 5)) if rnd.random() < 0.95 else rnd.choice([None, "", " \n"]), source))
    return rows


def test_mix(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, source string, size int, u string")
    got = mx.mix_counts(df.repartition(5)).collect()
    assert len(got) == len(rows)
    sizes = {}
    for i, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(re.findall(mx.WORD, t or ""))
    want = targets(sizes)
    text = {i: t for i, t, _ in rows}
    taken = {}
    for r in got:
        assert r["size"] == len(re.findall(mx.WORD, text[r["doc_id"]] or "")) and r["taken"] in (0, r["size"], 2 * r["size"]) and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    largest = max(r["size"] for r in got)
    assert all(abs(taken[s] - want[s]) <= largest / 2 + 1 for s in want)
    again = {r["doc_id"]: r["taken"] for r in mx.mix_counts(df.repartition(2)).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in got}
    out = mx.mix(df)
    assert out.columns == df.columns
    assert dict(out.groupBy("doc_id").count().collect()) == {r["doc_id"]: r["taken"] // r["size"] for r in got if r["taken"]}


def test_mix_of_odd_tables(spark):
    schema = "doc_id long, text string, source string"
    assert mx.mix_counts(spark.createDataFrame([], schema)).count() == 0 and mx.mix(spark.createDataFrame([], schema)).count() == 0
    none = spark.createDataFrame([(1, None, None), (None, "", "a")], schema)
    assert [r["taken"] for r in mx.mix_counts(none).collect()] == [0, 0] and mx.mix(none).count() == 0
    same = spark.createDataFrame([(1, "a b c", "s")] * 4 + [(2, "a b", None)], schema)
    got = mx.mix_counts(same).collect()
    assert len(got) == 5 and len({r["taken"] for r in got if r["source"]}) == 1


def pareto(docs, rest, power):
    """Which of docs (size, u) one more copy goes to: certain ones, then by rank, as near to rest words as ranks allow."""
    docs = sorted((d for d in docs if d[0]), key=lambda d: -d[0])
    sure = 0
    while True:  # largest first, until the largest that is left isn't certain
        left = docs[sure:]
        scale = (rest - sum(d[0] for d in docs[:sure])) / sum(d[0] * d[0] ** power for d in left)
        if scale * left[0][0] ** power < 1:
            break
        sure += 1
    odds = lambda p: p / (1 - p)
    ranked = sorted(left, key=lambda d: odds(d[1]) / odds(scale * d[0] ** power))
    gap, taken, words = rest - sum(d[0] for d in docs[:sure]), set(docs[:sure]), 0
    for d in ranked:
        if words + d[0] / 2 > gap:
            break
        taken.add(d)
        words += d[0]
    return taken, scale


@pytest.mark.parametrize("power", [1.0, 0.5, 0.0])
def test_selection_is_pareto_order_sampling(spark, power):
    rows = [r for r in corpus(4, 1500) if r[0] % 3]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    u = {r["doc_id"]: r["u"] for r in df.select("doc_id", mx.uniform(F.col("doc_id"), F.col("text")).alias("u")).collect()}
    got = mx.mix_counts(df, power=power).collect()
    by_source = {}
    for r in got:
        by_source.setdefault(r["source"], []).append(r)
    unequal = 0
    for rs in by_source.values():
        whole = int(rs[0]["target"] // rs[0]["source_size"])
        rest = rs[0]["target"] - whole * rs[0]["source_size"]
        taken, scale = pareto([(r["size"], u[r["doc_id"]]) for r in rs], rest, power) if rest > 1e-6 else (set(), 0)
        for r in rs:
            assert r["copies"] == (whole + ((r["size"], u[r["doc_id"]]) in taken) if r["size"] else 0)
        unequal += len({min(1.0, scale * r["size"] ** power) for r in rs if r["size"]} - {0}) > 1
    assert unequal if power else not unequal


def test_inclusion_follows_size(spark):
    """Documents of three times the words are taken three times as often, and the share of words is the remainder's."""
    df = spark.createDataFrame([(i, "w w w" if i % 2 else "w", "s") for i in range(6000)], "doc_id long, text string, source string")
    got = mx.mix_counts(df, total_share=0.3)
    words = got.select(F.sum("taken"), F.sum("size")).first()
    assert words[0] / words[1] == pytest.approx(0.3, abs=0.001)
    n = {r["size"]: r["n"] for r in got.groupBy("size").agg(F.sum("copies").alias("n")).collect()}
    assert n[3] / n[1] == pytest.approx(3, rel=0.15)
    n = {r["size"]: r["n"] for r in mx.mix_counts(df, total_share=0.3, power=0.0).groupBy("size").agg(F.sum("copies").alias("n")).collect()}
    assert n[3] / n[1] == pytest.approx(1, rel=0.15)


def test_targets_are_water_filling(spark):
    rnd = random.Random(2)
    for _ in range(6):
        sizes = {f"s{i:02d}": rnd.choice([1, 10, 1000, 50_000]) for i in range(rnd.randint(1, 12))}
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        assert {r["source"]: r["target"] for r in mx.source_targets(df).collect()} == pytest.approx(targets(sizes))


# ---- packing ------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(pk.tokenizer_path(pk.TOKENIZER))


def test_encoder_is_the_library(library):
    rnd = random.Random(3)
    encode = pk.encoder(pk.TOKENIZER)
    cases = ["", " ", "a  b", "  lead", "trail  ", "x\n\n y", "it's we'll", "日本語 é\u00a0z", "<|endoftext|> a", "\t\t\tend", "1234 5678", "a\r\nb", "👍🏽 ok", "\ufeffx"]
    cases += ["".join(rnd.choice("ab ’'é1\n\t .,") for _ in range(rnd.randint(0, 60))) for _ in range(400)]
    for t in cases:
        assert encode(t).tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


def test_chunks_do_not_change_ids(library):
    """Cut into chunks of a few characters, and at white space and added tokens, a text has the same ids."""
    rnd = random.Random(8)
    core = pk.encoder(pk.TOKENIZER)
    marks = ["a", "b1", "'s", " ", "  ", "\n", "\n\n ", "\u00a0", "\u3000 ", "\x1c", "é", "日本", ".", "!!", "\t", "<|endoftext|>", "don't"]
    for _ in range(500):
        t = "".join(rnd.choice(marks) for _ in range(rnd.randint(0, 40)))
        parts = list(pk.chunks(t, 3))
        assert "".join(parts) == t
        plain = t.replace("<|endoftext|>", "")
        parts = list(pk.chunks(plain, 3))
        assert [i for c in parts for i in library.encode(c, add_special_tokens=False).ids] == library.encode(plain, add_special_tokens=False).ids, repr(plain)
        assert core(t).tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)
    long = "word " * 200_000 + "x" * 5000 + "<|endoftext|>" * 3
    assert core(long).tolist() == library.encode(long, add_special_tokens=False).ids


def best_two_fit(lengths, length):
    """Bins one after another on a plain list of lengths."""
    left, bins = sorted(lengths, reverse=True), []
    while left:
        took, gap = [], length
        for x in list(left):
            if x <= gap:
                took.append(x)
                left.remove(x)
                gap -= x
        if gap and len(took) > 1:
            small = took[-1]
            pairs = [(a + b, max(a, b), min(a, b)) for i, a in enumerate(left) for b in left[i + 1 :] if small < a + b <= gap + small]
            # the small one goes back before the pair is chosen, but can't be in a pair that beats it alone
            if pairs:
                best = max(p[0] for p in pairs)
                took.pop()
                left.append(small)
                pick = max((p for p in pairs if p[0] == best), key=lambda p: p[1])
                took += pick[1:]
                left.remove(pick[1])
                left.remove(pick[2])
                left.sort(reverse=True)
        bins.append(sorted(took))
    return sorted(bins)


def test_plan_is_best_two_fit():
    rng = np.random.default_rng(9)
    for length in (8, 20, 50):
        for _ in range(60):
            lengths = rng.integers(1, length + 1, rng.integers(1, 40)).tolist()
            counts = np.bincount(lengths, minlength=length + 1)
            slots, bins = pk.plan_packing(counts, length), {}
            for item, a, b, seq in zip(*(slots[k].tolist() for k in ("item", "first", "last", "sequence"))):
                for r in range(b - a):
                    bins.setdefault(seq + r, []).append(item)
            assert sorted(map(sorted, bins.values())) == best_two_fit(lengths, length)


def check_plan(counts, length):
    slots = pk.plan_packing(counts, length)
    filled, seen = {}, {}
    for item, a, b, seq, off in zip(*(slots[k].tolist() for k in ("item", "first", "last", "sequence", "offset"))):
        for r in range(a, b):
            filled.setdefault(seq + r - a, []).append((off, item))
            seen.setdefault(item, []).append(r)
    assert {i: sorted(r) for i, r in seen.items()} == {i: list(range(c)) for i, c in enumerate(counts.tolist()) if c and i}
    for places in filled.values():
        at = 0
        for off, item in sorted(places):
            assert off == at
            at += item
        assert at <= length
    return len(filled)


def test_plan_holds_every_piece_once():
    rng = np.random.default_rng(5)
    for length in (10, 64, 256):
        for _ in range(15):
            counts = np.zeros(length + 1, dtype=np.int64)
            for item in rng.integers(1, length + 1, rng.integers(0, 300)):
                counts[item] += 1
            n = check_plan(counts, length)
            assert n <= 1.12 * -(-int((counts * np.arange(length + 1)).sum()) // length) + np.count_nonzero(counts[length // 2 + 1 :]) + counts[length // 2 + 1 :].sum() * 0.5 + 1


def test_two_fit_replaces_the_smallest():
    counts = np.zeros(101, dtype=np.int64)
    counts[[60, 30, 25, 14]] = 1
    slots = pk.plan_packing(counts, 100)
    first = sorted(slots["item"][slots["sequence"] == 0].tolist())
    assert first == [14, 25, 60]  # 60 + 30 leaves 10; 25 + 14 fill the gap of 40 to 1


def test_packing(spark, library):
    rnd = random.Random(7)
    rows = [(i, " ".join(rnd.choice(["alpha", "beta", "gamma"]) for _ in range(int(rnd.paretovariate(0.9) * 20) % 4000))) for i in range(300)]
    rows += [(900, None), (901, ""), (902, "x " * 30_000), (5, rows[5][1]), (None, "null id")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, length int").repartition(4)
    got = [r.asDict() for r in pk.pack_documents(df).collect()]
    want = []
    for i, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        first = len(ids) % 1024 or 1024
        for k, s in enumerate([0, *range(first, len(ids), 1024)]):
            n = first if k == 0 else 1024
            want.append((i, k, s, n, zlib.crc32(np.array(ids[s : s + n], dtype="<u4").tobytes())))
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted((tuple(g[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for g in got), key=key) == sorted(want, key=key)
    bins = {}
    for g in got:
        bins.setdefault(g["sequence_id"], []).append((g["offset"], g["length"]))
    for places in bins.values():
        at = 0
        for off, n in sorted(places):
            assert off == at
            at += n
        assert at <= 1024
    assert len(bins) <= -(-sum(w[3] for w in want) // 1024) + 2
    assert pk.pack_documents(df.limit(0)).count() == 0
    full = pk.pack_documents(df, with_ids=True).collect()
    assert len(full) == len(got) and all(len(r["ids"]) == r["length"] and zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes()) == r["ids_crc32"] for r in full)
    assert len({r["row_id"] for r in full if r["doc_id"] == 5}) == 2 and len({(r["sequence_id"], r["offset"]) for r in full}) == len(full)


def test_small_buckets_rank_alike(spark):
    pieces = spark.createDataFrame([(i, i, 0, 0, 1 + i % 7, i) for i in range(500)], "doc_id long, row_id long, piece int, start long, length long, ids_crc32 long")
    got = pk.pack(pieces, Scratch(spark), 16, bucket_rows=9).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in got}) == 500 and max(r["offset"] + r["length"] for r in got) <= 16


def test_full_pieces_are_placed_without_a_shuffle(spark, shuffled_bytes):
    """Pieces that fill a sequence have one of their own, no place is used twice, and their ids are not shuffled."""
    rnd = np.random.default_rng(4)
    lengths = [4096] * 60 + [2000, 2096, 1, 3000, 1500, 4095]
    ids = [rnd.integers(0, 50_000, n).tolist() for n in lengths]
    pieces = spark.createDataFrame([(i, i, 0, 0, n, i, x) for i, (n, x) in enumerate(zip(lengths, ids))], "doc_id long, row_id long, piece int, start long, length long, ids_crc32 long, ids array<int>").coalesce(3)
    before = shuffled_bytes()
    got = pk.pack(pieces, Scratch(spark), 4096).collect()
    assert shuffled_bytes() - before < 200_000
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert list(r["ids"]) == ids[r["doc_id"]]
    assert len(got) == len(lengths) and len(bins) == 60 + 4
    for places in bins.values():
        at = 0
        for off, n in sorted(places):
            assert off == at
            at += n
        assert at <= 4096
    empty = pk.pack(pieces.limit(0), Scratch(spark), 4096)
    assert empty.collect() == [] and empty.columns == [*pieces.columns[:-1], "sequence_id", "offset", "ids"]
    assert [r["offset"] for r in pk.pack(pieces.limit(2), Scratch(spark), 4096).collect()] == [0, 0]
