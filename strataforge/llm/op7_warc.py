"""WARC archives of pages, in Zstandard with a dictionary per archive.

`write_archives` writes each partition's records into archive files of bounded size. An archive
holds its records' dictionary (built from the records themselves) in a leading skippable frame,
then each record compressed by itself with that dictionary, so any record can be read alone.
Records: equal payloads of at least `least_bytes` bytes have one response (the smallest id);
the others are revisits, which carry headers only. `read_archives` reads the files with
Spark's binary reader and parses them back.

Files are written under the shared folder by a name that is new for each attempt; a manifest
row per archive is the output of the writing stage, and only archives in the manifest are read,
so a lost executor or a second attempt leaves at most unread files.

Archives stay, as they are the output; whoever wrote them deletes them.

Defined cases: a null html is an empty payload; payloads under `least_bytes` are all responses;
a null url is written as an empty target; rows equal in id and payload are each a record, and
all with the smallest id are responses; a null id counts as larger than any other; an empty
table gives no archive and an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataforge.llm._common import Scratch, scratch_path, table

#: First magic number of Zstandard skippable frames that hold a dictionary. Fixed value.
DICT_MAGIC = 0x184D2A5D
ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"
LEVEL = 3
DICT_BYTES, SAMPLE_BYTES = 64 << 10, 16 << 10
#: Raw bytes of records in an archive, and records; a longer record has an archive of its own.
ARCHIVE_BYTES = 16 << 20
ARCHIVE_RECORDS = 20_000


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id, url: str, copy: int = 0) -> str:
    """Of a record: rows equal in id and url are told apart by their number in the archive."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}|{url}' + (f'|{copy}' if copy else ''))}>"


def record(kind: str, page_id, url: str, payload: bytes, digest: str, refers_to, date: str = "2024-01-01T00:00:00Z", copy: int = 0, refers_to_url: str | None = None) -> bytes:
    """One WARC/1.1 record. A revisit has no block; its payload's size and digest stand in its header, and what it refers to."""
    block = b"" if kind == "revisit" else payload
    name = lambda i: "" if i is None else str(i)
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {record_id(page_id, url, copy)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {url}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Page-ID: {name(page_id)}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, refers_to_url or '')}", f"WARC-Refers-To-Target-URI: {refers_to_url or ''}", f"WARC-Refers-To-Date: {date}", f"X-Refers-To-Page-ID: {name(refers_to)}"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}"]
    clean = [h.replace("\r", " ").replace("\n", " ") for h in head]
    return "\r\n".join(clean).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    n = int(fields["Content-Length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    return fields, rest[:n]


def build_archive(records: list[bytes], dict_bytes: int = DICT_BYTES, sample_bytes: int = SAMPLE_BYTES) -> bytes:
    """Skippable frame with the dictionary, then a frame for each record.

    The dictionary is trained on all bytes of the archive's records, long ones being several samples of
    `sample_bytes`; where the trainer finds them too few or too alike, it holds their beginnings as raw content.
    """
    import zstandard as zstd

    total = sum(map(len, records))
    size = max(256, min(dict_bytes, total // 20))
    samples = [r[i : i + sample_bytes] for r in records for i in range(0, len(r), sample_bytes)]
    try:
        raw = zstd.train_dictionary(size, samples, k=256, d=8, level=3).as_bytes()
    except zstd.ZstdError:
        raw = b"".join(r[: max(64, size // max(1, len(records)))] for r in records)[:size]
    data = zstd.ZstdCompressionDict(raw)
    packer = zstd.ZstdCompressor(level=LEVEL, dict_data=data, write_checksum=True, write_content_size=True)
    frame = zstd.ZstdCompressor(level=LEVEL).compress(raw)
    out = io.BytesIO()
    out.write(struct.pack("<II", DICT_MAGIC, len(frame)) + frame)
    for r in records:
        out.write(packer.compress(r))
    return out.getvalue()


def read_archive(blob: bytes) -> Iterator[bytes]:
    """The records of an archive, one frame after another."""
    import zstandard as zstd

    magic, n = struct.unpack_from("<II", blob)
    if magic != DICT_MAGIC:
        raise ValueError("the archive has no dictionary frame")
    raw = blob[8 : 8 + n]
    if raw.startswith(ZSTD_MAGIC):
        raw = zstd.ZstdDecompressor().decompress(raw)
    unpack = zstd.ZstdDecompressor(dict_data=zstd.ZstdCompressionDict(raw))
    view, at = memoryview(blob), 8 + n
    while at < len(blob):
        d = unpack.decompressobj()
        first = d.decompress(view[at : at + (1 << 16)])
        parts, fed = [first], min(len(blob), at + (1 << 16))
        while not d.eof:
            if fed >= len(blob):
                raise ValueError("the archive is cut off")
            parts.append(d.decompress(view[fed : fed + (1 << 20)]))
            fed = min(len(blob), fed + (1 << 20))
        at = fed - len(d.unused_data)
        yield b"".join(parts)


def _filesystem(uri: str):
    """(pyarrow file system, path): whatever store the shared folder is in."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def classify(df: DataFrame, id_col: str, url_col: str, html_col: str, least_bytes: int = 0) -> DataFrame:
    """id, url, payload (null for revisits), payload_bytes, digest, refers_to (the response's id), refers_to_url.

    The first of equal payloads is a minimum over narrow rows, summed up before the shuffle. Its table, of the
    digests that several pages share, is joined by digest alone: Spark broadcasts it where it is small, else
    a digest of very many pages is a skewed join with a one-row side per key, which Spark splits.
    """
    raw = F.coalesce(F.encode(F.col(html_col), "UTF-8"), F.lit(b""))
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    pages = df.select(F.col(id_col).alias("id"), url.alias("url"), raw.alias("payload"), F.length(raw).cast("long").alias("payload_bytes"), F.sha1(raw).alias("sha"))
    narrow = df.select(F.col(id_col).alias("id"), url.alias("url"), F.sha1(raw).alias("sha2"), F.length(raw).alias("n")).where(F.col("n") >= least_bytes)
    first = narrow.groupBy("sha2").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "url")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("sha2", F.col("first.id").alias("first"), F.col("first.url").alias("first_url"))
    j = pages.join(first, pages["sha"] == first["sha2"], "left")
    revisit = F.col("sha2").isNotNull() & ~F.col("first").eqNullSafe(F.col("id"))
    return j.select("id", "url", F.when(~revisit, F.col("payload")).alias("payload"), "payload_bytes", "sha", F.when(revisit, F.col("first")).alias("refers_to"), F.when(revisit, F.col("first_url")).alias("refers_to_url"))


def write_archives(df: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Writes the archives into folder and returns the manifest: path, n_records, raw_bytes, file_bytes."""
    scratch = Scratch(df.sparkSession)
    rows = classify(df, id_col, url_col, html_col, least_bytes)
    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("n_records", T.LongType()), T.StructField("raw_bytes", T.LongType()), T.StructField("file_bytes", T.LongType())])

    def write(batches):
        files, root = _filesystem(folder)
        files.create_dir(root, recursive=True)
        held: list[bytes] = []
        size, copies = 0, {}

        def flush():
            blob = build_archive(held)
            name = f"pages-{uuid.uuid4().hex}.warc.zst"
            with files.open_output_stream(f"{root}/{name}", compression=None) as f:
                f.write(blob)
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), *(pa.array([v], pa.int64()) for v in (len(held), size, len(blob)))], names=schema.names)

        for batch in batches:
            ids, urls, payloads, sizes, shas, refs, ref_urls = batch.columns
            for i in range(batch.num_rows):
                payload, page, ref = payloads[i].as_py(), ids[i].as_py(), refs[i].as_py()
                digest = base64.b32encode(bytes.fromhex(shas[i].as_py())).decode()
                url = urls[i].as_py()
                copy = copies[page, url] = copies.get((page, url), -1) + 1
                if payload is None:
                    r = record_header_only(page, url, sizes[i].as_py(), digest, ref, ref_urls[i].as_py(), copy)
                else:
                    r = record("response", page, url, payload, digest, None, copy=copy)
                if held and (size + len(r) > ARCHIVE_BYTES or len(held) >= ARCHIVE_RECORDS):
                    yield flush()
                    held, size, copies = [], 0, {}
                held.append(r)
                size += len(r)
        if held:
            yield flush()

    return scratch.keep(rows.mapInArrow(write, schema), "manifest")


def record_header_only(page_id, url: str, payload_bytes: int, digest: str, refers_to, refers_to_url: str | None = None, copy: int = 0) -> bytes:
    """A revisit record, from the payload's size."""
    r = record("revisit", page_id, url, b"", digest, refers_to, copy=copy, refers_to_url=refers_to_url)
    return r.replace(b"X-Payload-Length: 0\r\n", f"X-Payload-Length: {payload_bytes}\r\n".encode(), 1)


def read_archives(spark: SparkSession, manifest: DataFrame, id_type: T.DataType) -> DataFrame:
    """page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload of the archives in the manifest.

    The binary reader lists the manifest's folder; archives that no manifest row names (of lost
    attempts) are left out by a semi join on the file's name. Digests of responses are computed
    anew from the payloads.
    """
    one = manifest.limit(1).collect()
    schema = T.StructType([
        T.StructField("page_id", T.StringType()), T.StructField("url", T.StringType()), T.StructField("record_type", T.StringType()),
        T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()), T.StructField("refers_to", T.StringType()), T.StructField("payload", T.BinaryType()),
    ])
    if not one:
        found = spark.createDataFrame([], schema)
    else:
        root = one[0]["path"].rpartition("/")[0]
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(root)
        named = manifest.select(F.element_at(F.split("path", "/"), -1).alias("name"))
        files = files.withColumn("name", F.element_at(F.split("path", "/"), -1)).join(named, "name", "left_semi").select("content")

        def parse(batches):
            for batch in batches:
                for blob in batch.column(0):
                    cols: list[list] = [[] for _ in schema]
                    size = 0
                    for raw in read_archive(blob.as_py()):
                        f, payload = parse_record(raw)
                        response = f["WARC-Type"] == "response"
                        digest = digest32(payload) if response else f["WARC-Payload-Digest"].removeprefix("sha1:")
                        if response and (f["WARC-Payload-Digest"] != f"sha1:{digest}" or int(f["X-Payload-Length"]) != len(payload)):
                            raise ValueError("a record's payload is not what was archived")
                        row = (f["X-Page-ID"] or None, f["WARC-Target-URI"], f["WARC-Type"], int(f["X-Payload-Length"]), digest, f.get("X-Refers-To-Page-ID") or None, payload if response else None)
                        for c, v in zip(cols, row):
                            c.append(v)
                        size += len(raw)
                        if size > 8 << 20:
                            yield to_batch(cols)
                            cols, size = [[] for _ in schema], 0
                    if cols[0]:
                        yield to_batch(cols)

        kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]
        to_batch = lambda cols: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=schema.names)
        found = files.mapInArrow(parse, schema)
    return found.withColumns({"page_id": F.col("page_id").cast(id_type), "refers_to": F.col("refers_to").cast(id_type)})


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    manifest = write_archives(pages, scratch_path(spark, "warc"))
    back = read_archives(spark, manifest, pages.schema["page_id"].dataType)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
