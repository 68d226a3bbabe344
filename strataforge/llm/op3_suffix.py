"""Exact removal of repeated byte strings: suffix sorting of the windows that can repeat.

A byte goes if it lies in a `length`-byte string (a window) that also starts earlier, in a
document of smaller id or in the same one.

1. Anchors: every window names its smallest hashed `gram`-byte gram (leftmost on ties), which
   depends on the window's bytes only, so equal windows have equal anchors. Runs of windows with
   one anchor are one record (anchor's hash, document, place): about one per (length - gram) / 2 bytes,
   each 24 bytes, sent in packed blocks. A run equal to an earlier one in its batch, byte for byte, is
   settled there: all its windows repeat.
2. By anchor: runs of anchors that occur once can't repeat; the bytes of all others are fetched.
3. Suffix sort: the runs of an anchor are sorted by deep-shallow sorting, multikey quicksort on 8-byte
   characters to a shallow depth, then a blind trie for each group of longer common prefix. Of equal runs
   all but the earliest repeat. The windows of the different runs are sorted in the same way: windows
   equal over `length` bytes come together, and all but the earliest are repeats.
4. Per document the repeats' ranges are merged and the rest is hashed.

Texts are shuffled twice (by document, for 3 and 4), never grouped. Hashes only bring together what may
be equal; bytes decide.

Defined cases: a null text is empty; a text shorter than `length` keeps all its bytes; rows of one id are
one document (equal rows do not repeat each other, ranges are shared); a null id counts as larger
than any other; an empty table gives an empty table.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataforge.llm._common import Scratch, slices, table

LENGTH = 100
GRAM = 36
NO_ID = (1 << 63) - 1
BLOCK = 1 << 18
#: Bytes of texts among which equal runs are settled before anything is sent.
BATCH_BYTES = 16 << 20
_BITS = np.uint64(20)
_LOW = np.uint64((1 << 20) - 1)
_BASE = 0x9E3779B97F4A7C15 | 1
SHALLOW_WORDS = 4


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Tables:
    """Powers of the base and of its inverse, up to a block's length."""

    cache: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        size = BLOCK + 1024 if n <= BLOCK + 1024 else n
        if size not in cls.cache:
            cls.cache = {size: (_powers(_BASE, size), _powers(pow(_BASE, -1, 1 << 64), size))}
        return cls.cache[size]


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def runs_of(data: np.ndarray, ends: np.ndarray, length: int, gram: int):
    """Runs of windows with one anchor over joined documents.

    data: bytes; ends: end of each document in data. Returns first window, last window, anchor's
    place, hash of its gram, hash of the run's bytes and shape; windows cross no document's end.
    """
    n = len(data)
    none = np.zeros(0, dtype=np.int64)
    if n < length:
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    power, inverse = _Tables.get(n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n], out=sums[1:])
    grams = _mix((sums[gram:] - sums[:-gram]) * inverse[: n - gram + 1])
    low = (grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64)
    width, step = length - gram + 1, 1
    while step * 2 <= width:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    rest = width - step
    if rest:
        low = np.minimum(low[:-rest], low[rest:])
    at = (low & _LOW).astype(np.int64)
    windows = n - length + 1
    end = ends[np.searchsorted(ends, np.arange(windows), side="right")]
    good = np.arange(windows) + length <= end
    first = good.copy()
    first[1:] &= ~good[:-1] | (at[1:] != at[:-1])
    first = np.flatnonzero(first)
    last = good.copy()
    last[:-1] &= ~good[1:] | (at[1:] != at[:-1])
    last = np.flatnonzero(last)
    place = at[first]
    body = (sums[last + length] - sums[first]) * inverse[first]
    shape = ((last - first) << 8 | (place - first)).astype(np.uint64)
    return first, last, place, grams[place], _mix(body ^ _mix(shape + np.uint64(1)))


def pack_place(start: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """First window of a run and number of windows, in one long."""
    return start << 8 | windows


def batch_records(ids: np.ndarray, texts: list[bytes], length: int, gram: int):
    """(ah, ch, id, place) of all runs of a batch, in order of (id, place)."""
    out = []
    order = np.argsort(ids, kind="stable")
    held: list[tuple[int, int, bytes]] = []
    size = 0

    def flush():
        data = np.frombuffer(b"".join(t for _, _, t in held), dtype=np.uint8)
        lens = np.array([len(t) for _, _, t in held])
        ends = np.cumsum(lens)
        first, last, _, ah, ch = runs_of(data, ends, length, gram)
        doc = np.searchsorted(ends, first, side="right")
        own = np.array([i for i, _, _ in held], dtype=np.int64)
        base = np.array([o for _, o, _ in held], dtype=np.int64)
        start = first - (ends - lens)[doc] + base[doc]
        out.append((ah.view(np.int64), ch.view(np.int64), own[doc], pack_place(start, last - first + 1)))

    for k in order.tolist():
        t = texts[k]
        for at in range(0, max(1, len(t) - length + 1), BLOCK // 2):  # a long text in pieces that share length - 1 bytes
            piece = t[at : at + BLOCK // 2 + length - 1]
            if len(piece) < length:
                continue
            if held and size + len(piece) > BLOCK:
                flush()
                held, size = [], 0
            held.append((int(ids[k]), at, piece))
            size += len(piece)
    if held:
        flush()
    if not out:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(4))
    return tuple(np.concatenate(c) for c in zip(*out))


def settle(ah: np.ndarray, ch: np.ndarray, doc: np.ndarray, place: np.ndarray):
    """For records of equal (ah, ch): (order, repeats, firsts). order sorts by (ah, ch, doc, place); the others flag positions in it.

    Equal hashes only propose: the caller compares bytes. A record that is the earliest itself (an equal row's) is neither.
    """
    order = np.lexsort((place, doc, ch, ah))
    a, c, d, p = ah[order], ch[order], doc[order], place[order]
    first = np.concatenate(([True], (a[1:] != a[:-1]) | (c[1:] != c[:-1]))) if len(a) else np.zeros(0, dtype=bool)
    lead = np.maximum.accumulate(np.where(first, np.arange(len(a)), 0)) if len(a) else np.zeros(0, dtype=np.int64)
    repeat = ~first & ((d != d[lead]) | (p != p[lead]))
    return order, repeat, first


def ranges_of(place: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    start = place >> 8
    return start, start + (place & 255) + length - 1


# ---- deep-shallow sorting -----------------------------------------------------------------


class BlindTrie:
    """Patricia trie over strings of `depth` bytes that share a prefix of `base` bytes.

    Inner nodes hold the byte position at which their strings differ. An insertion goes down
    blindly by single bytes to some leaf, compares the whole strings once, and branches at the
    first difference; strings without one are the same class.
    """

    __slots__ = ("root", "base", "depth")

    def __init__(self, base: int, depth: int):
        self.root, self.base, self.depth = None, base, depth

    def insert(self, s: bytes, item: int) -> None:
        if self.root is None:
            self.root = (s, [item])
            return
        node, path = self.root, []
        while type(node) is list:  # [position, {byte: child}]
            path.append(node)
            nxt = node[1].get(s[node[0]])
            node = nxt if nxt is not None else next(iter(node[1].values()))
        leaf, items = node
        if leaf == s:
            items.append(item)
            return
        x = int.from_bytes(leaf, "big") ^ int.from_bytes(s, "big")
        at = len(s) - (x.bit_length() + 7) // 8
        parent = None
        for p in path:
            if p[0] > at:
                break
            parent = p
        if parent is not None and parent[0] == at:
            parent[1][s[at]] = (s, [item])
            return
        old = self.root if parent is None else parent[1][s[parent[0]]]
        new = [at, {leaf[at]: old, s[at]: (s, [item])}]
        if parent is None:
            self.root = new
        else:
            parent[1][s[parent[0]]] = new

    def ordered(self) -> Iterator[list[int]]:
        """Classes of equal strings, in order."""
        stack = [] if self.root is None else [self.root]
        while stack:
            node = stack.pop()
            if type(node) is list:
                stack.extend(node[1][b] for b in sorted(node[1], reverse=True))
            else:
                yield node[1]


def multikey_quicksort(words: np.ndarray, starts: np.ndarray, order: np.ndarray, group: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """Sorts order[...] within the groups of equal numbers by the 8-byte characters words[start], words[start + 8], ..., levels[item] of them.

    Three-way partitioning of all open groups at once: each has a pivot, the median of the characters of its
    first, middle and last member; smaller and larger members stay at their character, equal ones
    go on to the next. Returns the new groups: position of each group's first member.
    """
    n = len(order)
    group = np.maximum.accumulate(np.where(np.concatenate(([True], group[1:] != group[:-1])), np.arange(n), 0))
    level = np.zeros(n, dtype=np.int64)  # by position
    todo = np.arange(n)
    while True:
        alike = group[todo][1:] == group[todo][:-1]
        several = np.concatenate((alike, [False])) | np.concatenate(([False], alike))
        todo = todo[several & (level[todo] < levels[order[todo]])]
        if not len(todo):
            return group
        at = np.flatnonzero(np.concatenate(([True], group[todo][1:] != group[todo][:-1])))
        size = np.diff(np.append(at, len(todo)))
        own = np.repeat(np.arange(len(at)), size)
        key = words[starts[order[todo]] + 8 * level[todo]]
        pivot = _middle(key[at], key[at + size // 2], key[at + size - 1])
        side = np.where(key < pivot[own], 0, np.where(key == pivot[own], 1, 2))
        rank = own * 3 + side
        s = np.argsort(rank, kind="stable")
        order[todo], level[todo], rank = order[todo][s], level[todo][s] + (side[s] == 1), rank[s]
        new = np.concatenate(([True], rank[1:] != rank[:-1]))
        group[todo] = np.maximum.accumulate(np.where(new, todo, 0))


def _middle(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c))


def deep_shallow_sort(data: bytes, starts: np.ndarray, depth: int | np.ndarray, group: np.ndarray | None = None, shallow_words: int = SHALLOW_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(order, classes): starts[order] are the suffixes of data sorted within groups by their first `depth` bytes, classes numbers equal ones.

    group: sorted numbers of groups that are apart anyway, of one depth each (None: one group). From the
    shallow depth on, a group whose members are all equal is done, and any other goes through a blind trie.
    """
    n = len(starts)
    order = np.arange(n)
    if not n:
        return order, order
    text = np.frombuffer(data + bytes(8), dtype=np.uint8)
    # big-endian words at every position
    words = np.zeros(len(text) - 7, dtype=np.uint64)
    for k in range(8):
        words = (words << np.uint64(8)) | text[k : len(text) - 7 + k]
    depth = np.broadcast_to(np.asarray(depth, dtype=np.int64), (n,))
    levels = np.minimum(shallow_words, depth // 8)
    group = multikey_quicksort(words, starts, order, np.zeros(n, dtype=np.int64) if group is None else group, levels)
    alike = group[1:] == group[:-1]
    todo = np.flatnonzero((np.concatenate((alike, [False])) | np.concatenate(([False], alike))) & (8 * levels[order] < depth[order]))
    if not len(todo):
        return order, group
    at = np.flatnonzero(np.concatenate(([True], group[todo][1:] != group[todo][:-1])))
    bounds = np.append(at, len(todo))
    # members against their group's first, by words that may overlap at the end
    lead = np.repeat(todo[at], np.diff(bounds))
    differs = np.zeros(len(todo), dtype=bool)
    last, one, two = depth[order[todo]] - 8, starts[order[todo]], starts[order[lead]]
    for off in range(8 * int(levels[order[todo]].min()), int(last.max()) + 8, 8):
        o = np.minimum(off, last)
        differs |= words[one + np.maximum(o, 0)] != words[two + np.maximum(o, 0)]
    mixed = np.add.reduceat(differs, at) > 0
    for b, e in zip(bounds[:-1][mixed], bounds[1:][mixed]):
        where = todo[b:e]
        done, end = 8 * int(levels[order[where[0]]]), int(depth[order[where[0]]])
        trie = BlindTrie(done, end)
        for item in order[where].tolist():
            s = int(starts[item])
            trie.insert(data[s + done : s + end], item)
        k = 0
        for items in trie.ordered():
            order[where[k] : where[k] + len(items)] = items
            group[where[k] : where[k] + len(items)] = where[k]
            k += len(items)
    return order, group


def not_earliest(order: np.ndarray, classes: np.ndarray, doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(flags of the items that are not the earliest (doc, place) of their class, items that stand for their class)."""
    flags = np.zeros(len(order), dtype=bool)
    if not len(order):
        return flags, order
    s = np.lexsort((place[order], doc[order], classes))
    g, d, p, o = classes[s], doc[order][s], place[order][s], order[s]
    first = np.concatenate(([True], g[1:] != g[:-1]))
    lead = np.maximum.accumulate(np.where(first, np.arange(len(g)), 0))
    flags[o] = ~first & ((d != d[lead]) | (p != p[lead]))  # an equal row's is neither
    return flags, o[first]


def repeated_windows(data: bytes, starts: np.ndarray, doc: np.ndarray, place: np.ndarray, length: int, group: np.ndarray | None = None) -> np.ndarray:
    """Flags of the windows that are not the earliest of their class."""
    return not_earliest(*deep_shallow_sort(data, starts, length, group), doc, place)[0]


# ---- stages -------------------------------------------------------------------------------


def same_bytes(texts: dict[int, bytes], doc: np.ndarray, place: np.ndarray, i: np.ndarray, j: np.ndarray, length: int) -> np.ndarray:
    """Whether runs i and j are equal byte for byte."""
    start, end = ranges_of(place, length)
    return np.fromiter(
        (texts[a][s:e] == texts[b][t:f] for a, s, e, b, t, f in zip(*(x.tolist() for x in (doc[i], start[i], end[i], doc[j], start[j], end[j])))), dtype=bool, count=len(i)
    )


def _emit_records(buckets: int, length: int, gram: int):
    shift = np.uint64(40)

    def run(batches):
        for whole in batches:
            for batch in slices(whole, BATCH_BYTES):
                yield from of(batch)

    def of(batch):
        ids = batch.column(0).to_numpy()
        texts = [t.as_py() or b"" for t in batch.column(1)]
        rec = batch_records(ids, texts, length, gram)
        if not len(rec[0]):
            return
        order, repeat, first = settle(*rec)
        ah, _, doc, place = [c[order] for c in rec]
        by_id = dict(zip(ids.tolist(), texts))
        if len(by_id) == len(texts):
            lead = np.maximum.accumulate(np.where(first, np.arange(len(ah)), 0))
            at = np.flatnonzero(repeat)
            repeat[at] = same_bytes(by_id, doc, place, at, lead[at], length)
        else:  # different rows of one id: theirs are left to the sort
            repeat[:] = False
        for kind, flag in ((0, repeat), (1, ~repeat)):
            part = [c[flag] for c in (ah, doc, place)]
            if kind == 0:
                b = (part[1].view(np.uint64) % np.uint64(buckets)).astype(np.int64)
            else:
                b = ((part[0].view(np.uint64) >> shift) % np.uint64(buckets)).astype(np.int64)
            o = np.argsort(b, kind="stable")
            b, part = b[o], [c[o] for c in part]
            at = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1]))) if len(b) else []
            bounds = np.append(at, len(b)).astype(np.int64)
            for i in range(0, len(bounds) - 1, 64):
                cut = bounds[i : i + 65]
                blobs = [np.stack([c[s:e] for c in part]).tobytes() for s, e in zip(cut[:-1], cut[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(b[cut[:-1]]), pa.array([kind] * len(blobs), pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "kind", "blob"])

    return run


def _by_bucket(batches, fn):
    """Call fn with the [(kind, blob)] of each bucket of rows sorted by bucket."""
    held, now = [], None
    for batch in batches:
        for b, k, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            if b != now and held:
                yield from fn(held)
                held = []
            now = b
            held.append((k, x.as_py()))
    if held:
        yield from fn(held)


def _rows(doc, kind, ah, place):
    for i in range(0, len(doc), 50_000):
        c = slice(i, i + 50_000)
        yield pa.RecordBatch.from_arrays([pa.array(doc[c]), pa.array(np.full(len(doc[c]), kind, dtype=np.int32)), pa.array(ah[c]), pa.array(place[c])], names=["doc", "kind", "ah", "place"])


def _settle_buckets(batches):
    def one(held):
        parts = {0: [], 1: []}
        for k, blob in held:
            parts[k].append(np.frombuffer(blob, dtype=np.int64).reshape(3, -1))
        for p in parts[0]:
            yield from _rows(p[1], 0, p[0], p[2])
        if not parts[1]:
            return
        rec = np.concatenate(parts[1], axis=1)
        # anchors that occur once can't repeat
        o = np.argsort(rec[0], kind="stable")
        a = rec[0][o]
        same = a[1:] == a[:-1]
        rec = rec[:, o[np.concatenate((same, [False])) | np.concatenate(([False], same))]]
        yield from _rows(rec[1], 1, rec[0], rec[2])

    return _by_bucket(batches, one)


def _fetch(buckets: int, length: int):
    """(doc, text, [(ah, place)]) -> blocks of runs, compressed: their number, their longs, and their bytes."""

    def run(batches):
        import zstandard

        pack = zstandard.ZstdCompressor(level=1).compress
        for whole in batches:
            for batch in slices(whole, BATCH_BYTES):
                docs, texts, needs = batch.column(0).to_numpy(), batch.column(1), batch.column(2)
                flat = needs.flatten()
                ah, place = (flat.field(i).to_numpy() for i in (0, 1))
                doc_at = np.repeat(np.arange(len(docs)), np.diff(needs.offsets.to_numpy()))
                bucket = (_mix(ah.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
                o = np.argsort(bucket, kind="stable")
                bounds = np.append(np.flatnonzero(np.concatenate(([True], bucket[o][1:] != bucket[o][:-1]))), len(o)) if len(o) else np.zeros(1, dtype=np.int64)
                raw = {i: texts[i].as_py() or b"" for i in np.unique(doc_at).tolist()}
                names, blobs = [], []
                for s, e in zip(bounds[:-1], bounds[1:]):
                    r = o[s:e]
                    body = [raw[i][p >> 8 : (p >> 8) + (p & 255) + length - 1] for i, p in zip(doc_at[r].tolist(), place[r].tolist())]
                    head = np.stack([ah[r], docs[doc_at[r]], place[r], np.fromiter(map(len, body), dtype=np.int64, count=len(body))])
                    names.append(int(bucket[r[0]]))
                    blobs.append(pack(len(r).to_bytes(8, "little") + head.tobytes() + b"".join(body)))
                    if len(blobs) == 64 or e == len(o):
                        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([1] * len(names), pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "kind", "blob"])
                        names, blobs = [], []

    return run


def settle_runs(ah: np.ndarray, doc: np.ndarray, place: np.ndarray, size: np.ndarray, data: bytes, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(doc, place) of the repeats among the runs whose bytes stand one after another in data: whole runs, and ranges of windows."""
    base = np.cumsum(size) - size
    fits = (place & 255) + length - 1 == size  # not so where different rows have one id
    ah, doc, place, size, base = (x[fits] for x in (ah, doc, place, size, base))
    o = np.lexsort((size, ah))
    ah, doc, place, size, base = (x[o] for x in (ah, doc, place, size, base))
    if not len(ah):
        return doc, place
    apart = np.concatenate(([True], (ah[1:] != ah[:-1]) | (size[1:] != size[:-1])))
    again, lead = not_earliest(*deep_shallow_sort(data, base, size, np.cumsum(apart)), doc, place)
    whole = doc[again], place[again]
    # the windows of anchors that have different runs
    lead = np.sort(lead)
    a = ah[lead]
    same = a[1:] == a[:-1]
    lead = lead[np.concatenate((same, [False])) | np.concatenate(([False], same))] if len(a) else lead
    count = place[lead] & 255
    rec = np.repeat(lead, count)
    off = np.arange(len(rec)) - np.repeat(np.cumsum(count) - count, count)
    start = (place[rec] >> 8) + off
    flags = repeated_windows(data, base[rec] + off, doc[rec], start, length, ah[rec])
    d, s = doc[rec][flags], start[flags]
    # windows next to each other become one range, of 255 windows at most
    new = np.concatenate(([True], (d[1:] != d[:-1]) | (s[1:] != s[:-1] + 1) | (rec[flags][1:] != rec[flags][:-1]))) if len(d) else np.zeros(0, dtype=bool)
    b = np.flatnonzero(new)
    n = np.diff(np.append(b, len(d)))
    return np.concatenate((whole[0], d[b])), np.concatenate((whole[1], pack_place(s[b], n)))


def _sort_buckets(length: int):
    def one(held):
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        heads, bodies = [], []
        for _, blob in held:
            blob = unpack(blob)
            n = int.from_bytes(blob[:8], "little")
            heads.append(np.frombuffer(blob, dtype=np.int64, count=4 * n, offset=8).reshape(4, n))
            bodies.append(blob[8 + 32 * n :])
        ah, doc, place, size = np.concatenate(heads, axis=1)
        d, p = settle_runs(ah, doc, place, size, b"".join(bodies), length)
        yield from _rows(d, 0, np.zeros(len(d), dtype=np.int64), p)

    return lambda batches: _by_bucket(batches, one)


def _finish(length: int, names: list[str]):
    def run(batches):
        for batch in batches:
            cols = [[] for _ in range(4)]
            for text, ranges in zip(batch.column(1), batch.column(2)):
                raw = text.as_py() or b""
                places = np.sort(np.array(ranges.as_py() or [], dtype=np.int64))
                kept, at, removed, spans = [], 0, 0, 0
                if len(places):
                    s, e = ranges_of(places, length)
                    e = np.minimum(e, len(raw))
                    far = np.maximum.accumulate(e)
                    new = np.concatenate(([True], s[1:] > far[:-1]))
                    for a, b in zip(s[new].tolist(), np.maximum.reduceat(e, np.flatnonzero(new)).tolist()):
                        if b > a:
                            kept.append(raw[at:a])
                            at, removed, spans = b, removed + b - a, spans + 1
                kept.append(raw[at:])
                h = hashlib.sha256()
                for k in kept:
                    h.update(k)
                for c, v in zip(cols, (len(raw), removed, spans, h.hexdigest())):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())], names=names)

    return run


def release(spark: SparkSession) -> None:
    """Shuffle files of plans that are done go once the driver's garbage is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def repeated_places(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> tuple[DataFrame, DataFrame, Scratch]:
    """(docs: doc, raw), (doc, place) of repeated runs of windows; place packs the first window's start and their number."""
    if length - gram + 1 > 255 or gram >= length:
        raise ValueError("a run must have under 256 windows")
    spark = df.sparkSession
    scratch = Scratch(spark)
    docs = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"), F.encode(F.col(text_col).cast("string"), "UTF-8").alias("raw"))
    total = docs.agg(F.sum(F.length("raw").cast("long"))).first()[0] or 0
    # buckets of about 1 MB of records, so that partitions get many of them; where partitions are few for the table, of up to 8 MB
    size = total * 2 * 24 // (length - gram)
    buckets = max(16, size >> 23, min(size >> 20, 16 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    records = docs.mapInArrow(_emit_records(buckets, length, gram), "bucket long, kind int, blob binary")
    found = scratch.keep(records.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_settle_buckets, "doc long, kind int, ah long, place long"), "found")
    release(spark)
    needs = found.where("kind = 1").groupBy("doc").agg(F.collect_list(F.struct("ah", "place")).alias("need"))  # bounded by a document's length
    fetched = docs.join(needs.hint("shuffle_hash"), "doc").select("doc", "raw", "need").mapInArrow(_fetch(buckets, length), "bucket long, kind int, blob binary")
    later = scratch.keep(fetched.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_sort_buckets(length), "doc long, kind int, ah long, place long"), "later")
    release(spark)
    return docs, found.where("kind = 0").select("doc", "place").union(later.select("doc", "place")), scratch


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    docs, places, _ = repeated_places(df, id_col, text_col, length, gram)
    by_doc = places.groupBy("doc").agg(F.collect_list("place").alias("places"))
    joined = docs.join(by_doc.hint("shuffle_hash"), "doc", "left").select("doc", "raw", "places")
    names = ["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    out = joined.mapInArrow(_finish(length, names), "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return out.withColumn("doc", F.when(F.col("doc") != NO_ID, F.col("doc"))).withColumnRenamed("doc", id_col)


def op3_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
