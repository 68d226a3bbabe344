import base64
import hashlib
import struct

import numpy as np
import pytest

from strataforge.llm import op7_warc as warc
from strataforge.llm import op9_embed as emb
from strataforge.llm.components import forest


def pages():
    rows = [(i, f"http://h{i % 5}.test/{i}", f"<html>page {i} " + "lorem ipsum " * (i % 40) + "</html>") for i in range(120)]
    rows += [(900 + i, "http://dup.test/", "<p>the same</p>") for i in range(40)]
    return rows + [(500, None, None), (501, "u", ""), (502, "a\r\nb: c", "é\r\n\r\nWARC/1.1"), (503, "u", "x" * 3_000_000)]


def test_round_trip(spark, tmp_path):
    rows = pages()
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, sha string").repartition(3)
    manifest = warc.write_archives(df, f"file://{tmp_path}/w")
    (tmp_path / "w" / "lost-attempt.warc.zst").write_bytes(b"cut off")  # of a task that was lost: not in the manifest
    got = {r["page_id"]: r for r in warc.read_archives(spark, manifest, df.schema["page_id"].dataType).collect()}
    assert len(got) == len(rows) == sum(r["n_records"] for r in manifest.collect())
    first = {}
    for i, _, h in sorted(rows, key=lambda r: r[0]):
        first.setdefault(h or "", i)
    for i, u, h in rows:
        raw, r = (h or "").encode(), got[i]
        revisit = first[h or ""] != i
        assert (r["payload_bytes"], r["record_type"], r["refers_to"]) == (len(raw), "revisit" if revisit else "response", first[h or ""] if revisit else None)
        assert r["payload_digest"] == base64.b32encode(hashlib.sha1(raw).digest()).decode() and r["payload"] == (None if revisit else raw)
        assert r["url"] == (u or "").replace("\r", " ").replace("\n", " ")


def test_small_payloads_and_repeated_rows(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef"), (3, "u", "abcdef"), (None, "u", "abcdef")], "page_id long, url string, html string")
    m = warc.write_archives(df, f"file://{tmp_path}/w", least_bytes=5)
    got = sorted((str(r["page_id"]), r["record_type"], r["refers_to"]) for r in warc.read_archives(spark, m, df.schema["page_id"].dataType).collect())
    assert got == [("1", "response", None), ("2", "response", None), ("3", "response", None), ("3", "response", None), ("4", "revisit", 3), ("None", "revisit", 3)]
    m = warc.write_archives(df.limit(0), f"file://{tmp_path}/e")
    assert warc.read_archives(spark, m, df.schema["page_id"].dataType).count() == 0


def test_layout_of_an_archive():
    import zstandard

    records = [warc.record("response", i, "u", f"<p>{i}</p>".encode() * 20, "D", None) for i in range(50)]
    blob = warc.build_archive(records)
    magic, n = struct.unpack_from("<II", blob)
    assert magic == warc.DICT_MAGIC
    raw = zstandard.ZstdDecompressor().decompress(blob[8 : 8 + n])
    one = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw)).decompress(blob[8 + n :])  # the first frame alone
    assert one == records[0] and list(warc.read_archive(blob)) == records
    assert list(warc.read_archive(warc.build_archive(records[:1]))) == records[:1]
    with pytest.raises(ValueError):
        list(warc.read_archive(b"\0" * 20))


def brute(ids, x, threshold=emb.THRESHOLD):
    u = emb.unit(x.astype(np.float64))
    s = u @ u.T
    np.fill_diagonal(s, -1)
    near = s >= threshold
    root = forest((int(ids[i]), int(ids[j])) for i, j in zip(*np.nonzero(np.triu(near))))
    return {int(i): (int(n), root.get(int(i), int(i))) for i, n in zip(ids, near.sum(axis=1))}


def clusters(seed=0, n=1500, dim=24):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(40, dim))
    x = np.concatenate([rng.normal(size=(n // 2, dim)), centres[rng.integers(0, 40, n // 2)] + rng.normal(scale=0.12, size=(n // 2, dim)), centres[:1] + rng.normal(scale=0.02, size=(300, dim))])
    return np.arange(len(x)) * 3 + 1, (x * rng.uniform(0.1, 50, size=(len(x), 1))).astype(np.float32)


@pytest.mark.parametrize("list_rows", [4096, 100])
def test_groups_against_brute_force(spark, list_rows):
    ids, x = clusters()
    df = spark.createDataFrame([(int(i), v.tolist(), 0, "x") for i, v in zip(ids, x)], "vec_id long, embedding array<float>, label int, n_links string").repartition(4)
    got = {r["vec_id"]: (r["n_links"], r["component"]) for r in emb.embedding_groups(df, list_rows=list_rows).collect()}
    want = brute(ids, x)
    total = sum(n for n, _ in want.values())
    assert len(got) == len(want) and 0.97 * total <= sum(n for n, _ in got.values()) <= total
    assert all(n <= want[i][0] for i, (n, _) in got.items())
    assert sum(got[i][1] == want[i][1] for i in want) >= 0.97 * len(want)


@pytest.mark.parametrize("cosine, least", [(0.9, 0.9), (0.95, 0.97)])
def test_recall_at_the_threshold(spark, cosine, least):
    rng = np.random.default_rng(1)
    a = emb.unit(rng.normal(size=(1500, 64)))
    b = rng.normal(size=a.shape)
    b = emb.unit(b - (a * b).sum(axis=1, keepdims=True) * a)
    x = np.concatenate([a, (cosine + 1e-6) * a + np.sqrt(1 - (cosine + 1e-6) ** 2) * b]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    total = sum(n for n, _ in brute(np.arange(len(x)), x).values())
    assert sum(r["n_links"] for r in emb.embedding_groups(df).collect()) >= least * total


def test_exact_links_are_all_links(spark):
    rng = np.random.default_rng(3)
    for ids, x in (clusters(5, 600, 8), (np.arange(700), rng.normal(size=(700, 5)).astype(np.float32))):
        df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<float>").repartition(3)
        for list_rows in (2048, 60):
            got = {r["vec_id"]: (r["n_links"], r["component"]) for r in emb.embedding_groups(df, exact=True, list_rows=list_rows).collect()}
            assert got == brute(ids, x)


def test_every_dimension_is_indexed(spark):
    rng = np.random.default_rng(4)
    rows, want = [], {}
    for d, n in ((3, 200), (2, 90), (7, 2), (1, 5), (64, 1)):
        x = rng.normal(size=(n, d)).astype(np.float32)
        x[n // 2 :] = x[: n - n // 2] * 2  # a copy in direction of each
        ids = np.arange(n) + 1000 * d
        rows += [(int(i), v.tolist()) for i, v in zip(ids, x)]
        want |= brute(ids, x)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    assert {r["vec_id"]: (r["n_links"], r["component"]) for r in emb.embedding_groups(df, exact=True).collect()} == want
    got = {r["vec_id"]: r["n_links"] for r in emb.embedding_groups(df).collect()}
    assert all(got[i] <= n and (got[i] > 0) == (n > 0) for i, (n, _) in want.items()) and sum(got.values()) >= 0.9 * sum(n for n, _ in want.values())


def test_shared_and_null_ids(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (None, [-1.0, 0.0]), (None, [0.0, -1.0]), (4, [0.01, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((str(r["vec_id"]), r["n_links"], str(r["component"])) for r in emb.embedding_groups(df).collect())
    assert got == sorted([("1", 0, "1"), ("1", 1, "1"), ("4", 1, "1"), ("None", 0, "None"), ("None", 0, "None")])


def test_odd_vectors(spark):
    rows = [(1, None), (2, [0.0, 0.0]), (3, [1.0, None]), (4, [1.0, float("nan")]), (5, [1.0, 0.0]), (5, [1.0, 0.0]), (6, [1.0, 0.01]), (None, [3.0, 0.0]), (7, [1.0]), (8, []), (9, [float("inf"), 1.0]), (10, [-1.0, 0.0]), (11, [1e-30, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((str(r["vec_id"]), r["n_links"], r["component"], r["kept"]) for r in emb.embedding_groups(df).collect())
    alone = [(str(i), 0, i, True) for i in (1, 2, 3, 4, 7, 8, 9, 10)]
    assert got == sorted([*alone, ("5", 4, 5, True), ("5", 4, 5, True), ("6", 4, 5, False), ("None", 4, 5, False), ("11", 4, 5, False)])
    assert emb.embedding_groups(df.limit(0)).count() == 0 and emb.embedding_groups(df.where("vec_id < 3")).count() == 2
