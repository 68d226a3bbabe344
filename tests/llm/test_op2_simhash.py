import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataforge.llm import op2_simhash as sim
from strataforge.llm._common import Scratch, may_be_in
from strataforge.llm.components import connected_components, forest


def brute_groups(rows, tau=sim.TAU):
    fp = [sim.simhash(t) for _, t in rows]
    u = sorted(set(fp))
    a = np.array(u, dtype=np.uint64)
    links = [(i, i + 1 + int(j)) for i in range(len(u)) for j in np.flatnonzero(np.bitwise_count(a[i + 1 :] ^ a[i]) <= tau)]
    root = forest(links)
    group = [root.get(u.index(x), u.index(x)) for x in fp]
    low = {}
    for (i, _), g in zip(rows, group):
        low[g] = min(low.get(g, i), i)
    return sorted((i, f"{x:016x}", low[g]) for (i, _), x, g in zip(rows, fp, group))


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(3)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(4)) for _ in range(2000)]
    big = [rnd.choice(words) for _ in range(300)]
    rows = []
    for i in range(400):  # a large group of near copies
        w = list(big)
        for _ in range(rnd.randint(0, 3)):
            w[rnd.randrange(len(w))] = rnd.choice(words)
        rows.append((2 * i + 1, " ".join(w)))
    rows += [(5000 + i, " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 40)))) for i in range(200)]
    rows += [(7000, None), (7001, ""), (7002, " \t\n"), (7003, "One"), (7004, "oNE"), (7005, "É x"), (7006, "é x"), (9000, rows[0][1]), (9001, rows[0][1]), (8000, "a b c d e " * 50_000)]
    return rows


def test_definition_of_the_fingerprint():
    import xxhash

    h = [xxhash.xxh64_intdigest(s, 42) for s in (b"a b c d", b"b c d e")]
    assert sim.simhash("A  b\tC d\ne") == h[0] & h[1] and sim.simhash("x y") == xxhash.xxh64_intdigest(b"x y", 42) and sim.simhash(None) == 0


def test_fast_majority_is_the_definition():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 5, 4096, 9001):
        h = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
        for k, word in enumerate(sim.majority(h, 3).tolist()):
            x = h if k == 0 else sim.mixed(h, k)
            assert word == sum(1 << b for b in range(64) if 2 * int(((x >> np.uint64(b)) & np.uint64(1)).sum()) > n)
        assert sim.majority(h).tolist() == sim.majority(h, 3).tolist()[:1]


def op2(df):
    fps, groups = sim.near_duplicates(df, Scratch(df.sparkSession))
    return sorted((r["id"], f"{r['fp'] & (1 << 64) - 1:016x}", r["low"]["id"]) for r in fps.join(groups, "fp").collect())


def test_groups_against_brute_force(spark, corpus):
    df = spark.createDataFrame([(*r, "x", 1) for r in corpus], "doc_id long, text string, fp string, rep int").repartition(5)
    assert op2(df) == brute_groups(corpus)


def test_empty_and_null_ids(spark):
    df = spark.createDataFrame([(None, "a b c d e"), (None, "a b c d e"), (4, "a b c d e"), (None, "z")], "doc_id long, text string")
    assert [c for *_, c in op2(df)] == [4, 4, 4, sim.NO_ID] or sorted(c for *_, c in op2(df)) == [4, 4, 4, sim.NO_ID]
    assert op2(df.limit(0)) == []
    kept = sim.drop_near_duplicates(df)
    assert sorted(map(str, (r["doc_id"] for r in kept.collect()))) == ["4", "None"]


def test_no_document_is_lost_by_its_id(spark):
    """Different texts with null ids or one shared id all stay, and reruns agree on which of the copies does."""
    rnd = random.Random(4)
    prose = lambda: " ".join(f"w{rnd.randrange(10**6)}" for _ in range(80))
    one, two = prose(), prose()
    rows = [(None, prose(), 1), (None, prose(), 2), (None, one, 3), (7, two, 4), (7, prose(), 5), (7, prose(), 6), (7, two, 7), (None, one, 8), (9, one.upper(), 9), (3, None, 10), (3, None, 10), (3, "", 11)]
    df = spark.createDataFrame(rows, "doc_id long, text string, first int")
    for kw in ({}, {"width": 5, "min_similarity": 0.8}):
        found = [sorted(map(str, sim.drop_near_duplicates(df.repartition(n), **kw).collect())) for n in (1, 4)]
        assert found[0] == found[1]
        kept = sim.drop_near_duplicates(df, **kw).collect()
        texts = [(r["text"] or "").lower() for r in kept]
        assert sorted(texts) == sorted({(t or "").lower() for _, t, _ in rows})
        assert [r["doc_id"] for r in kept if (r["text"] or "").lower() == one] == [9]
    assert sim.drop_near_duplicates(df.limit(0), width=5, min_similarity=0.8).count() == 0


def fingerprint_set(n, seed):
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 1 << 63, 20, dtype=np.uint64)
    out = set()
    for _ in range(n):
        x = int(centres[rng.integers(20)]) if rng.random() < 0.7 else int(rng.integers(0, 1 << 63))
        for b in rng.choice(64, rng.integers(0, 6), replace=False):
            x ^= 1 << int(b)
        out.add(x)
    return np.array(sorted(out), dtype=np.uint64)


@pytest.mark.parametrize("tau, hot", [(0, 4096), (1, 4096), (4, 4096), (4, 20), (7, 30)])
def test_links_join_what_all_pairs_join(spark, tau, hot):
    f = fingerprint_set(900, tau + 1)
    df = spark.createDataFrame([(i, int(x.astype(np.int64))) for i, x in enumerate(f)], "rep long, fp long")
    want = forest((i, j) for i in range(len(f)) for j in (np.flatnonzero(np.bitwise_count(f[i + 1 :] ^ f[i]) <= tau) + i + 1).tolist())
    for degree in (None, 16):
        got = [tuple(r) for r in sim.hamming_links(df, tau, hot_rows=hot, degree=degree).collect()]
        assert forest(got) == want
        assert all(int(f[a]) ^ int(f[b]) and (int(f[a]) ^ int(f[b])).bit_count() <= tau for a, b in got)


def test_wide_groups_and_thinning(monkeypatch):
    f = fingerprint_set(500, 9)
    rep = np.arange(len(f), dtype=np.int64)
    pairs = [(i, j) for i in range(len(f)) for j in range(i + 1, len(f)) if (int(f[i]) ^ int(f[j])).bit_count() <= 5]
    want = forest(pairs)
    group, probe = np.zeros(len(f), dtype=np.int64), np.full(len(f), sim.SEEK)
    for limit, degree in ((10**9, None), (10**9, 3), (10**9, 10**6), (10, None)):
        monkeypatch.setattr(sim, "GROUP_PAIRS", limit)
        u, v = sim.links_of_groups(group, probe, rep, f, 5, degree)
        assert forest(zip(u.tolist(), v.tolist())) == want
        if degree is None:
            assert len(u) == len(want) - len(set(want.values()))
        if degree == 10**6:
            assert sorted(zip(u.tolist(), v.tolist())) == pairs
    probe[250:] = sim.PROBE  # probes do not meet
    monkeypatch.setattr(sim, "GROUP_PAIRS", 10**9)
    u, v = sim.links_of_groups(group, probe, rep, f, 5, 10**6)
    assert sorted(zip(u.tolist(), v.tolist())) == [p for p in pairs if p[0] < 250]
    probe[100:250] = sim.STAY  # found by those that seek and by probes
    block = rep.astype(np.int32) % 3
    for blocks in (None, block):
        u, v = sim.links_of_groups(group, probe, rep, f, 5, 10**6) if blocks is None else sim.thinned_groups(group, probe, rep, f, 5, 10**6, block=blocks)[:2]
        assert sorted(zip(u.tolist(), v.tolist())) == [p for p in pairs if (p[0] < 100 or p[0] < 250 <= p[1]) and (blocks is None or block[p[0]] != block[p[1]])]


def test_links_do_not_depend_on_partitions(spark):
    f = fingerprint_set(600, 3)
    df = spark.createDataFrame([(i, int(x.astype(np.int64))) for i, x in enumerate(f)], "rep long, fp long")
    found = [sorted(set(map(tuple, sim.hamming_links(df.repartition(n), 8, degree=4, parts=5).collect()))) for n in (1, 5)]
    assert found[0] == found[1]


def test_thresholds_sum_up_and_cover():
    f = fingerprint_set(300, 5)
    x = sim.bits_of(f).astype(float)
    for m in (1, 2, 3, 4, 5):
        parts = sim.group_bits(len(f), x.T @ x, m)
        assert sorted(b for p in parts for b in p) == list(range(64))
        values = sim.part_values(f.view(np.int64), parts)
        hist = [np.bincount(((values[i] >> np.uint64(lo)) & np.uint64((1 << w) - 1)).astype(int), minlength=256) for i, lo, w in sim.chunks_of(parts)]
        t = sim.Allocator(len(f), parts, hist).allocate(values)
        assert (t.sum(axis=1) == sim.TAU - m + 1).all() and t.min() >= -1
        for i in range(40):  # each pair within tau agrees in a partition within its threshold
            for j in np.flatnonzero(np.bitwise_count(f ^ f[i]) <= sim.TAU):
                assert any(int(v[i] ^ v[j]).bit_count() <= t[i, k] for k, v in enumerate(values))


def test_allocation_avoids_a_frequent_value():
    f = np.array([(1 << 40) * k + 5 for k in range(1, 4000)], dtype=np.uint64)  # low bits all alike
    x = sim.bits_of(f).astype(float)
    parts = [list(range(0, 16)), list(range(16, 32)), list(range(32, 48)), list(range(48, 64))]
    values = sim.part_values(f.view(np.int64), parts)
    hist = [np.bincount(((values[i] >> np.uint64(lo)) & np.uint64((1 << w) - 1)).astype(int), minlength=256) for i, lo, w in sim.chunks_of(parts)]
    t = sim.Allocator(10**9, parts, [h * (10**9 // len(f)) for h in hist]).allocate(values)
    assert (t[:, :2] == -1).all() and x.shape[1] == 64


def test_components(spark):
    scratch = Scratch(spark)
    rnd = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(rnd.randrange(2000, 2200), rnd.randrange(2000, 2200)) for _ in range(150)] + [(5, 5)]
    want = forest(e for e in edges if e[0] != e[1])
    df = spark.createDataFrame(edges, "u long, v long").repartition(4)
    for limit in (0, 10**6):
        assert {r["node"]: r["component"] for r in connected_components(df, scratch, one_task=limit).collect()} == want
    assert connected_components(df.limit(0), scratch, one_task=-1).count() == 0


def test_verified_links(spark):
    base = [f"w{i}" for i in range(60)]
    near, far = list(base), list(base)
    near[30] = "x"
    far[::6] = ["y"] * 10
    df = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(far)), (4, " ".join(base).upper()), (5, None), (6, "")], "doc_id long, text string")
    sets = sim.sets_of(df.toDF("node", "text"), 5)
    links = spark.createDataFrame([(1, 2), (1, 3), (5, 6)], "u long, v long")
    assert sorted(tuple(r) for r in sim.similar_links(links, sets, 0.8).collect()) == [(1, 2), (5, 6)]
    kept = sim.drop_near_duplicates(df, width=5, min_similarity=0.8)
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 5] and kept.columns == df.columns
    assert kept.filter(F.col("text").isNull()).count() == 1


def star_of_copies(n, seed, copies):
    """A text of 200 words, and copies of it with some words changed: near to it, less so to each other."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(6))
    base = [word() for _ in range(n)]
    out = [" ".join(base)]
    for _ in range(copies):
        t = list(base)
        for at in rnd.sample(range(n), rnd.choice((3, 4))):
            t[at] = word()
        out.append(" ".join(t))
    rnd.shuffle(out)
    return out


def brute_force_components(texts, least, width=5):
    """By the Jaccard similarity of all pairs."""
    sets = [set(sim.shingle_set(t, width).tolist()) for t in texts]
    root = forest((i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]))
    return [root.get(i, i) for i in range(len(texts))]


def test_dense_near_copies_against_all_pairs(spark):
    texts = [t for k in range(2) for t in star_of_copies(200, k, 150)]
    want = [i for i, r in enumerate(brute_force_components(texts, 0.8)) if i == r]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = sorted(r["doc_id"] for r in sim.drop_near_duplicates(df, width=5, min_similarity=0.8).collect())
    assert set(want) <= set(kept) and len(kept) <= len(want) + 0.02 * len(texts)


def test_recall_of_lone_pairs_against_jaccard(spark):
    """Pairs of texts at similarities from 0.8 on: at least 90 of 100 are found, and none below 0.8."""
    rnd = random.Random(6)
    rows, true = [], []
    for k in range(300):
        n = rnd.randint(80, 300)
        a = [f"{k}x{rnd.randrange(10**7)}" for _ in range(n)]
        b = list(a)
        for at in rnd.sample(range(n), max(1, int(n * rnd.choice((0.01, 0.018, 0.022, 0.05))))):
            b[at] = "other"
        rows += [(2 * k, " ".join(a)), (2 * k + 1, " ".join(b))]
        x, y = (set(sim.shingle_set(t, 5).tolist()) for _, t in rows[-2:])
        true.append(len(x & y) >= 0.8 * len(x | y))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = {r["doc_id"] for r in sim.drop_near_duplicates(df, width=5, min_similarity=0.8).collect()}
    assert {2 * k for k in range(300)} <= kept and all(2 * k + 1 in kept for k, t in enumerate(true) if not t)
    found = [2 * k + 1 not in kept for k, t in enumerate(true) if t]
    assert len(found) > 80 and sum(found) >= 0.9 * len(found)


def test_bound_on_similarity_holds():
    sets = [sim.shingle_set(t, 5) for t in star_of_copies(200, 3, 40)] + [sim.shingle_set(None, 5), sim.shingle_set("a b", 5)]
    known = sim.Known(np.arange(len(sets)), list(map(sim.parity_map, sets)), 0.8)
    x, y = (np.array(z) for z in zip(*[(i, j) for i in range(len(sets)) for j in range(i)]))
    both = np.array([len(np.intersect1d(sets[i], sets[j])) for i, j in zip(x, y)])
    true = both >= 0.8 * (np.array([len(sets[i]) + len(sets[j]) for i, j in zip(x, y)]) - both)
    ok = known.open_pairs(x, y)
    assert true.any() and ok[true].all() and not ok.all()


def test_wide_groups_keep_candidates(monkeypatch):
    f = fingerprint_set(500, 9)
    rep = np.arange(len(f), dtype=np.int64) + 7
    group, probe = np.zeros(len(f), dtype=np.int64), np.where(np.arange(len(f)) >= 400, sim.PROBE, sim.SEEK)
    pairs = {(i + 7, j + 7) for i in range(400) for j in range(i + 1, len(f)) if (int(f[i]) ^ int(f[j])).bit_count() <= 5}
    for name, value in (("GROUP_PAIRS", 10), ("PAIRS_AT_ONCE", 3000), ("HELD_PAIRS", 200)):
        monkeypatch.setattr(sim, name, value)
    u, v, cut = sim.thinned_groups(group, probe, rep, f, 5, 10**6)
    assert set(zip(u.tolist(), v.tolist())) == pairs and not len(cut)
    u, v, cut = sim.thinned_groups(group, probe, rep, f, 5, 3)
    got, out = set(zip(u.tolist(), v.tolist())), set(cut.tolist())
    assert got < pairs and forest(got) == forest(pairs)
    assert all(i in out and j in out for i, j in pairs - got)  # what is left out comes back with both its ends
    links = {x: sum(x in p for p in pairs) for p in pairs for x in p}
    assert all(p in got for p in pairs if max(links[p[0]], links[p[1]]) <= 3)


def test_different_texts_of_equal_fingerprints(spark, monkeypatch):
    rnd = random.Random(2)
    base = [[f"{c}{rnd.randrange(10**6)}" for _ in range(60)] for c in "ab"]
    changed = list(base[1])
    changed[30] = "x"
    df = spark.createDataFrame([(1, " ".join(base[0])), (2, " ".join(base[1])), (3, " ".join(changed)), (4, " ".join(base[1]).upper())], "doc_id long, text string")
    monkeypatch.setattr(sim, "fingerprints", lambda *a, f=sim.fingerprints, **kw: f(*a, **kw).withColumns({"fp": F.lit(5).cast("long"), "wide": F.lit(bytes(8 * sim.WIDE_WORDS))}))
    kept = sim.drop_near_duplicates(df, width=5, min_similarity=0.8)
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2]


def test_texts_without_partners_are_not_shuffled(spark, shuffled_bytes, tmp_path):
    """Of 200 texts 3 have near or exact copies; all others stay where they are."""
    rnd = random.Random(12)
    texts = [" ".join(f"{rnd.randrange(10**9):x}" for _ in range(3000)) for _ in range(200)]
    rows = list(enumerate(texts)) + [(300, texts[5]), (301, texts[6].replace(texts[6].split()[40], "x")), (7, texts[7])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    before = shuffled_bytes()
    df.write.parquet(path := str(tmp_path / "docs"))
    own, before = shuffled_bytes() - before, shuffled_bytes()
    kept = sim.drop_near_duplicates(spark.read.parquet(path), width=5, min_similarity=0.8).collect()
    assert shuffled_bytes() - before < 0.5 * own
    assert sorted((r["doc_id"], r["text"]) for r in kept) == sorted(enumerate(texts))


def test_maps_of_any_size_never_exclude_similar_sets():
    rnd = random.Random(8)
    sets = [sim.shingle_set(None, 5), sim.shingle_set("a b", 5)]
    for n in (20, 900, 1100, 5000):
        words = [f"{n}w{rnd.randrange(10**8)}" for _ in range(n)]
        for share in (0, 0.005, 0.02, 0.03, 1):
            sets.append(sim.shingle_set(" ".join(w if rnd.random() >= share else f"x{rnd.randrange(10**8)}" for w in words), 5))
        sets.append(sim.shingle_set(" ".join(words[: int(n * 0.82)]), 5))
    maps = [sim.parity_map(s, sim.map_bits(len(s))) for s in sets]
    assert [sim.folded(m) for m in maps] == list(map(sim.parity_map, sets)) and len(maps[-1]) > len(maps[0])
    n_true = n_open = 0
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            true = both >= 0.8 * (len(sets[i]) + len(sets[j]) - both)
            ok = sim.may_be_similar(maps[i], maps[j], 0.8)
            assert ok or not true
            n_true, n_open = n_true + true, n_open + ok
    assert 10 < n_true <= n_open < 2 * n_true


def test_filter_passes_every_key(spark, monkeypatch):
    keys = spark.range(0, 6000, 3).select(F.col("id").alias("a"), (-F.col("id")).alias("b"))
    rows = spark.range(6000).select("id", (-F.col("id")).alias("minus"))
    passed = [r["id"] for r in rows.where(may_be_in(keys, ["a", "b"])("id", "minus")).collect()]
    assert set(range(0, 6000, 3)) <= set(passed) and len(passed) < 2200
    assert rows.where(may_be_in(keys.limit(0), ["a", "b"])("id", "minus")).count() == 0
    monkeypatch.setattr("strataforge.llm._common.MOST_FILTER_BITS", 4096)  # too few bits: more rows pass, none is lost
    assert set(range(0, 6000, 3)) <= {r["id"] for r in rows.where(may_be_in(keys, ["a", "b"])("id", "minus")).collect()}


def test_memory_of_a_group_of_near_copies():
    """All 4.5 million pairs of 3000 rows link: they are thinned as they come."""
    import tracemalloc

    f = np.uint64(12345) ^ np.unique(np.random.default_rng(3).choice(np.array([1 << a | 1 << b | 1 << c for a in range(30) for b in range(a) for c in range(b)], dtype=np.uint64), 3000, replace=False))
    tracemalloc.start()
    u, v, cut = sim.thinned_groups(np.zeros(len(f), dtype=np.int64), np.full(len(f), sim.SEEK), np.arange(len(f)), f, 20, 16)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(set(forest(zip(u.tolist(), v.tolist())).values())) == 1 and set(cut.tolist()) == set(range(len(f)))
    assert peak < 100 << 20
