import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strataforge.llm import op3_suffix as suf


def brute(rows, length):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, dtype=bool)
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            if w in seen:
                gone[s : s + length] = True
            seen.add(w)
        spans = int((gone[1:] < gone[:-1]).sum())
        out[i] = (len(b), int(gone.sum()), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    return out


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=30, max_size=300).map(lambda b: bytes(x % 3 + 97 for x in b)), st.integers(1, 5))
def test_deep_shallow_sort(data, shallow):
    data += data[:40] + b"ab" * 30
    starts = np.arange(len(data) - 20 + 1)
    order, group = suf.deep_shallow_sort(data, starts, 20, shallow_words=shallow)
    s = [data[i : i + 20] for i in starts[order]]
    assert s == sorted(s) and all((a == b) == (x == y) for a, b, x, y in zip(s, s[1:], group, group[1:]))


def test_blind_trie_orders_and_classes():
    rnd = random.Random(0)
    words = [bytes(rnd.choice(b"ab") for _ in range(9)) for _ in range(300)]
    trie = suf.BlindTrie(0, 9)
    for i, w in enumerate(words):
        trie.insert(w, i)
    classes = list(trie.ordered())
    assert [words[c[0]] for c in classes] == sorted(set(words)) and all(len({words[i] for i in c}) == 1 for c in classes)


def test_equal_windows_have_equal_anchors():
    rnd = random.Random(2)
    data = bytes(rnd.choice(b"abcd ") for _ in range(700))
    data += data[:300]
    first, last, place, ah, _ = suf.runs_of(np.frombuffer(data, dtype=np.uint8), np.array([400, len(data)]), 40, 12)
    anchor, windows = {}, set()
    for f, e, p, h in zip(first, last, place, ah):
        for s in range(f, e + 1):
            assert s + 40 <= 400 or s >= 400
            windows.add(s)
            assert anchor.setdefault(data[s : s + 40], (p - s, h)) == (p - s, h)
    assert windows == {s for s in range(len(data) - 39) if s + 40 <= 400 or s >= 400}


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(1)
    para = [" ".join("".join(rnd.choice("abcdefghé") for _ in range(rnd.randint(1, 8))) for _ in range(rnd.randint(1, 60))) for _ in range(60)]
    docs = [(rnd.randrange(10**6) * 1000 + i, " ".join(rnd.choice(para)[rnd.randint(0, 20) :] for _ in range(rnd.randint(0, 10)))) for i in range(120)]
    docs += [(5, None), (6, ""), (7, "a" * 99), (8, "a" * 100), (9, "a" * 1000), (10, "ab" * 400), (11, docs[0][1]), (12, docs[0][1])]
    docs.append((13, "x" * 3 + "".join(rnd.choice("abc") for _ in range(200_000)) + para[3] * 3))
    docs += [(2 * 10**9 + i, f"{i} start {para[5]} and {para[6]} end {i * 7}") for i in range(150)]  # one passage in many documents
    return docs


def test_against_brute_force(spark, rows):
    df = spark.createDataFrame([(*r, 0, "s") for r in rows], "doc_id long, text string, place int, raw string").repartition(3)
    got = {r["doc_id"]: tuple(r)[1:] for r in suf.remove_repeats(df).collect()}
    assert got == brute(rows, 100)


def test_rows_of_one_document_and_nulls(spark):
    t = "".join(hashlib.sha256(bytes([i])).hexdigest() for i in range(4))
    df = spark.createDataFrame([(1, t), (1, t), (None, t), (2, t + "x")], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["n_removed"]) for r in suf.remove_repeats(df).collect())
    assert got == [("1", 0), ("1", 0), ("2", len(t)), ("None", len(t))]
    assert suf.remove_repeats(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        suf.remove_repeats(df, length=500, gram=20)


@pytest.mark.parametrize("length, gram", [(20, 8), (33, 32)])
def test_other_lengths(spark, length, gram):
    rnd = random.Random(length)
    docs = [(i, "".join(rnd.choice("ab") for _ in range(rnd.randint(0, 120)))) for i in range(60)]
    got = {r["doc_id"]: tuple(r)[1:] for r in suf.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"), length=length, gram=gram).collect()}
    assert got == brute(docs, length)


def test_groups_of_different_depths():
    rnd = random.Random(7)
    data = "".join(rnd.choice("ab") for _ in range(3000)).encode() * 2
    starts = np.array([rnd.randrange(5800) for _ in range(900)])
    group = np.sort(np.array([rnd.randrange(30) for _ in range(900)]))
    depth = 10 + 4 * group  # one depth in each group
    order, classes = suf.deep_shallow_sort(data, starts, depth, group)
    assert (group[order] == group).all()
    s = [(int(g), data[i : i + d]) for g, i, d in zip(group, starts[order], depth)]
    assert s == sorted(s) and all((a == b) == (x == y) for a, b, x, y in zip(s, s[1:], classes, classes[1:]))


def test_equal_hashes_alone_remove_nothing(spark, monkeypatch):
    """Where all runs and anchors have one hash, bytes still decide."""
    rnd = random.Random(3)
    docs = [(i, "".join(rnd.choice("abcdef") for _ in range(rnd.randint(100, 400)))) for i in range(30)]
    docs += [(100 + i, docs[i][1][20:180]) for i in range(10)]

    def one_hash(ids, texts, length, gram, f=suf.batch_records):
        ah, ch, doc, place = f(ids, texts, length, gram)
        return ah * 0, ch * 0, doc, place

    rec = one_hash(np.array([d for d, _ in docs]), [t.encode() for _, t in docs], 60, 20)
    order, repeat, first = suf.settle(*rec)
    _, _, doc, place = (c[order] for c in rec)
    at, lead = np.flatnonzero(repeat), np.zeros(int(repeat.sum()), dtype=np.int64)
    texts = {d: t.encode() for d, t in docs}
    start, end = suf.ranges_of(place, 60)
    same = suf.same_bytes(texts, doc, place, at, lead, 60)
    assert same.tolist() == [texts[int(doc[i])][start[i] : end[i]] == texts[int(doc[0])][start[0] : end[0]] for i in at] and not same.all()
    size = end - start
    data = b"".join(texts[int(d)][s:e] for d, s, e in zip(doc, start, end))
    d, p = suf.settle_runs(np.zeros(len(doc), dtype=np.int64), doc, place, size, data, 60)
    covered = {i: np.zeros(len(t), dtype=bool) for i, t in docs}
    for i, s, e in zip(d.tolist(), *(x.tolist() for x in suf.ranges_of(p, 60))):
        covered[i][s:e] = True
    assert {i: int(c.sum()) for i, c in covered.items()} == {i: n for i, (_, n, _, _) in brute(docs, 60).items()}
