"""Best-two-fit packing of tokenized documents into sequences.

1. `tokenize` (Arrow map): ids of each whole text and an end id, cut into pieces of at most
   `length` tokens where a document is longer (the first piece takes the remainder), with a
   checksum of each piece's ids. Only these narrow rows go on.
2. `plan_packing`: lengths lie in 1..length, so the corpus is a histogram of at most `length`
   counts, whatever its size. Best-two-fit runs on the histogram: a bin is filled with the
   largest length that fits, again and again; then its smallest document is taken out, and if
   two unpacked documents fit the expanded gap more tightly they replace it. As the choice
   depends only on which lengths are left, a bin is repeated as often as its lengths last, so
   the number of steps is bounded by the histogram too. Nothing is sampled or capped.
3. `pack`: every piece gets its rank among the pieces of its length (ranks within hash buckets of
   about BUCKET_ROWS, plus the counts of the buckets before), and the plan turns (length, rank) into a
   sequence and an offset. No bin is built in one task; a length has one bucket per
   BUCKET_ROWS pieces (more pieces from some 10^9 on). Where rows carry their ids, pieces of `length`
   tokens, which fill a sequence, stay where they are.

Defined cases: a null text counts as empty, and gives one piece with the end id only; repeated
rows are packed each; ties are ordered by id and piece, and equal rows by nothing, as they are
the same; an empty table gives an empty table.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataforge.llm._common import Scratch, arrow_rows, give_back, ship, table

LENGTH = 1024
END_ID = 2
TOKENIZER = "byte_bpe_50k.json"
#: Characters that a vocabulary's core takes at a time, about.
CHUNK = 1 << 16
#: The white space of Unicode, as the pre-tokenizer's pattern has it. Fixed value.
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_WIDE_SPACE = re.compile(f"[{_SPACE}]{{2,}}(?=[^{_SPACE}])")
_LONE_BLANK = re.compile(f"(?<=[^{_SPACE}]) (?=[^{_SPACE}])")
#: The byte-level pre-tokenizer's pattern. Fixed value.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same for text that `chunks` has cut: the look-ahead is then never needed.
SPLIT_NARROW = SPLIT.replace(r"|\s+(?!\S)", "")


def tokenizer_path(name: str) -> str:
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 as itself, the rest from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


def parts_at_added(text: str, added: re.Pattern | None) -> Iterator[tuple[str, bool]]:
    """(part, whether it is an added token) in order."""
    at = 0
    for m in added.finditer(text) if added else ():
        yield text[at : m.start()], False
        yield m[0], True
        at = m.end()
    yield text[at:], False


def chunks(text: str, size: int = CHUNK) -> Iterator[str]:
    """The text cut where the pre-tokenizer cuts anyway, whatever stands around.

    That is before the last of several white space characters in front of another character, and,
    from `size` characters on, before a lone blank between two others; a text without such places is one chunk.
    """
    at = 0
    for m in _WIDE_SPACE.finditer(text):
        end = m.end() - 1
        yield from blank_cuts(text, at, end, size)
        at = end
    yield from blank_cuts(text, at, len(text), size)


def blank_cuts(text: str, at: int, end: int, size: int) -> Iterator[str]:
    while end - at > size:
        m = _LONE_BLANK.search(text, at + size, end)
        if not m:
            break
        yield text[at : m.start()]
        at = m.start()
    if end > at:
        yield text[at:end]


@lru_cache(maxsize=1)
def encoder(name: str):
    """text -> array of ids, as the tokenizers library gives for this file with add_special_tokens=False.

    A byte-level vocabulary whose merges are in the order of its ids is run by one core of tiktoken,
    which gives the same ids at about a third of the cost; added tokens are looked up between
    its parts, and long texts go through it in chunks. Any other file goes through the tokenizers library.
    """
    path = tokenizer_path(name)
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    tokens = spec.get("added_tokens", [])
    plain = not any(t.get(k) for t in tokens for k in ("single_word", "lstrip", "rstrip", "normalized"))
    added = {t["content"]: t["id"] for t in tokens}
    ranks = byte_ranks(spec, list(added)) if plain else None
    del spec
    try:
        import tiktoken
    except ImportError:
        ranks = None
    if ranks is None:
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        return lambda text: np.array(library.encode(text, add_special_tokens=False).ids, dtype="<u4")
    find = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
    core = tiktoken.Encoding(name, pat_str=SPLIT_NARROW, mergeable_ranks=ranks, special_tokens={})
    del ranks
    give_back()

    def encode(text: str) -> np.ndarray:
        out = []
        for part, special in parts_at_added(text, find):
            if special:
                out.append([added[part]])
            else:
                out += [np.array(core.encode_ordinary(c), dtype="<u4") for c in chunks(part)]
        return np.concatenate(out).astype("<u4") if out else np.zeros(0, dtype="<u4")

    return encode


def byte_ranks(spec: dict, added: list[str]) -> dict[bytes, int] | None:
    """token -> id of a byte-level vocabulary whose merges are in the order of its ids; None for any other."""
    pre = spec.get("pre_tokenizer") or {}
    if spec.get("normalizer") or spec["model"].get("type") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        return None
    alphabet = byte_alphabet()
    vocab = {k: v for k, v in spec["model"]["vocab"].items() if k not in added}
    merged = [vocab.get("".join(m.split(" ") if isinstance(m, str) else m), -1) for m in spec["model"]["merges"]]
    if any(c not in alphabet for k in vocab for c in k) or merged != sorted(merged) or -1 in merged:
        return None
    return {bytes(alphabet[c] for c in k): v for k, v in vocab.items()}


PIECE = [("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType())]


def cut(n: int, length: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces."""
    first = n % length or length
    return [(0, first), *((s, length) for s in range(first, n, length))]


def tokenize(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, end_id: int = END_ID, length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """One row per piece: id, row_id (tells rows of one id apart), piece, start, length, ids_crc32 and, on request, the ids."""
    fields = [T.StructField("doc_id", df.schema[id_col].dataType), T.StructField("row_id", T.LongType()), *(T.StructField(n, k) for n, k in PIECE)]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    schema = T.StructType(fields)
    ship(df.sparkSession)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        encode = encoder(tokenizer)
        at, cols, tokens = [], [[], [], [], []], []
        for i, t in enumerate(batch.column(2)):
            ids = np.append(encode(t.as_py() or ""), np.uint32(end_id)).astype("<u4")
            for k, (s, n) in enumerate(cut(len(ids), length)):
                at.append(i)
                for c, v in zip(cols, (k, s, n, zlib.crc32(ids[s : s + n].tobytes()))):
                    c.append(v)
                if with_ids:
                    tokens.append(ids[s : s + n].astype(np.int32))
        take = pa.array(at, pa.int64())
        arrays = [batch.column(0).take(take), batch.column(1).take(take), pa.array(cols[0], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[1:])]
        if with_ids:
            arrays.append(pa.array(tokens, pa.list_(pa.int32())))
        return pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return df.select(F.col(id_col), F.monotonically_increasing_id(), F.col(text_col).cast("string")).mapInArrow(arrow_rows(run), schema)


def plan_packing(counts: np.ndarray, length: int = LENGTH) -> dict[str, np.ndarray]:
    """counts[l]: pieces of length l. Slots (item, first, last, sequence, offset): the pieces of
    length item ranked first..last-1 go to sequence + rank - first, at offset."""
    left = counts.astype(np.int64).copy()
    left[0] = 0
    used = np.zeros_like(left)
    slots, sequence = [], 0

    def refresh(n: np.ndarray) -> np.ndarray:  # largest length left that is at most i; 0: none
        return np.maximum.accumulate(np.where(n > 0, np.arange(length + 1), 0))

    while True:
        below = refresh(left)
        if not below[length]:
            break
        have, gap, items = left.copy(), length, []
        under = below.copy()
        while gap and under[gap]:
            item = int(under[gap])
            n = min(gap // item, int(have[item]))
            items += [item] * n
            gap -= item * n
            have[item] -= n
            if not have[item]:
                under = refresh(have)
        if gap and len(items) > 1:
            small = items[-1]
            room = gap + small
            a = np.arange(1, room)
            b = under[room - a]
            b = np.where((b == a) & (have[a] < 2), under[np.maximum(a - 1, 0)], b)
            total = np.where((have[a] > 0) & (b > 0), a + b, 0)
            if len(total) and total.max() > small:
                k = int(total.argmax())
                items[-1:] = [int(max(a[k], b[k])), int(min(a[k], b[k]))]
        kinds, need = np.unique(items, return_counts=True)
        times = int((left[kinds] // need).min())
        offset = 0
        for item in items:
            slots.append((item, int(used[item]), int(used[item]) + times, sequence, offset))
            used[item] += times
            left[item] -= times
            offset += item
        sequence += times
    slots.sort()
    table_ = np.array(slots, dtype=np.int64).reshape(-1, 5)
    return {"item": table_[:, 0], "first": table_[:, 1], "last": table_[:, 2], "sequence": table_[:, 3], "offset": table_[:, 4]}


#: Pieces of a length that are ranked together, so many at least and more where there would be over CELLS buckets.
BUCKET_ROWS, CELLS = 1000, 1 << 22


def pack(pieces: DataFrame, scratch: Scratch, length: int = LENGTH, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """pieces (doc_id, row_id, piece, start, length, ids_crc32, maybe ids) with sequence_id and offset.

    Ids, where there are any, wait in the written table and are joined to the places at last, as the
    streamed side: only narrow rows are ranked. Then pieces that fill a sequence need no place among others: each gets a
    sequence number of its own beyond the plan's, from its row in the written table, and its ids are not shuffled.
    """
    names = pieces.columns
    with_ids = "ids" in names
    pieces = scratch.keep(pieces.withColumn("_at", F.monotonically_increasing_id()) if with_ids else pieces, "pieces")
    full = F.col("length") == length
    whole, pieces = pieces.where(full), pieces.where(~full) if with_ids else pieces
    counts = np.zeros(length + 1, dtype=np.int64)
    for row in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect():  # at most `length` rows
        counts[row["length"]] = row["n"]
    slots = plan_packing(counts, length)
    # a length has as many buckets as its own number of pieces asks for
    bucket_rows = max(bucket_rows, int(counts.sum()) // CELLS)
    buckets = F.array(*[F.lit(int(max(1, -(-n // bucket_rows)))) for n in counts])[F.col("length").cast("int")]
    narrow = ["doc_id", "row_id", *(x for x, _ in PIECE)]
    keyed = pieces.select(*narrow, F.pmod(F.xxhash64("doc_id", "row_id", "piece"), buckets).alias("_b"))
    cells = keyed.groupBy("length", "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.partitionBy("length").orderBy("_b").rowsBetween(W.unboundedPreceding, 0)) - F.col("_n")
    rank = F.row_number().over(W.partitionBy("length", "_b").orderBy("doc_id", "piece", "start", "ids_crc32", "row_id")) - 1
    ranked = keyed.withColumn("_r", rank).join(cells.withColumn("_before", before).drop("_n"), ["length", "_b"])
    ranked = ranked.select(*narrow, (F.col("_r") + F.col("_before")).alias("_r"))
    schema = T.StructType([*ranked.schema.fields[:-1], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    big = np.int64(1) << 42
    keys = slots["item"] * big + slots["first"]

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        item, r = batch.column("length").to_numpy(), batch.column("_r").to_numpy()
        k = np.searchsorted(keys, item * big + r, side="right") - 1
        return pa.RecordBatch.from_arrays(
            [*batch.columns[:-1], pa.array(slots["sequence"][k] + r - slots["first"][k]), pa.array(slots["offset"][k])], names=schema.names
        )

    placed = ranked.mapInArrow(arrow_rows(place), schema)
    if not with_ids:
        return placed
    beyond = int((slots["sequence"] + slots["last"] - slots["first"]).max(initial=0))
    whole = whole.select(*narrow, (F.col("_at") + beyond).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), "ids")
    places = placed.select(F.col("row_id").alias("_row"), F.col("piece").alias("_piece"), "sequence_id", "offset").hint("shuffle_hash")
    return whole.union(pieces.join(places, (F.col("row_id") == F.col("_row")) & (F.col("piece") == F.col("_piece"))).select(*narrow, "sequence_id", "offset", "ids"))


def pack_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, end_id: int = END_ID, length: int = LENGTH, with_ids: bool = False, scratch: Scratch | None = None) -> DataFrame:
    """Pieces with their places, on request with their ids, from which the sequences can be built."""
    return pack(tokenize(df, id_col, text_col, tokenizer, end_id, length, with_ids), scratch or Scratch(df.sparkSession), length)


def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents")).drop("row_id")
