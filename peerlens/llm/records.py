"""Token ids as length-delimited binary records with masked checksums and a separate offset index.

A shard is a pair of files. ``part-N.rec`` holds records, each: length of the payload (8 bytes), masked
checksum of those 8 bytes (4), payload, masked checksum of the payload (4); all little-endian. The
payload is a flag byte (1: no document id), the document id (8 bytes, signed), the bytes an id takes (1), and
the ids. ``part-N.idx`` holds for each record its place in the shard (8 bytes), so that records can be read in any
order without a scan. The checksum is CRC-32, masked by rotating right 15 bits and adding a
constant, so that a checksum of bytes that hold checksums stays sound.

Shards are written by the tasks to a shared folder, under a name of their own, and renamed when
complete: a lost executor or a second attempt leaves no half shard behind. Ids are in ascending
document order across shards and inside them (null document ids first, ties in input order)."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peerlens.llm.common import durable, table
from peerlens.llm.tokens import encoder, in_lots
from peerlens.session import shared_dir

END_ID = 1
HEAD = struct.Struct("<QI")
META = struct.Struct("<BqB")
#: Fixed value: added to a rotated checksum.
MASK_DELTA = 0xA282EAD8
READ_BYTES = 8 << 20
MANIFEST = "shard int, path string, records bigint, ids bigint, bytes bigint"


def masked(crc: int) -> int:
    return (((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return size + struct.pack("<I", masked(zlib.crc32(size))) + payload + struct.pack("<I", masked(zlib.crc32(payload)))


def unframe(data: bytes | memoryview, at: int = 0) -> tuple[memoryview, int]:
    """The payload of the record at ``at`` and the place of the next; ValueError if a checksum differs."""
    data = memoryview(data)
    length, check = HEAD.unpack_from(data, at)
    if masked(zlib.crc32(data[at : at + 8])) != check:
        raise ValueError("damaged length")
    end = at + HEAD.size + length
    payload = data[at + HEAD.size : end]
    if len(payload) < length or masked(zlib.crc32(payload)) != struct.unpack_from("<I", data, end)[0]:
        raise ValueError("damaged record")
    return payload, end + 4


def _open(folder: str) -> tuple[pafs.FileSystem, str]:
    """Any folder that Arrow's file systems reach (file, hdfs, s3, gs) or a plain path."""
    return pafs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


def _write(batches: Iterator[pa.RecordBatch], folder: str, path: str, end_id: int, special: bool) -> Iterator[pa.RecordBatch]:
    shard = TaskContext.get().partitionId()
    fs, root = _open(folder)
    enc = encoder(path, special)
    width, end = enc.dtype.itemsize, np.array([end_id], enc.dtype).tobytes()
    mine = f"{root}/.{shard:08d}-{uuid.uuid4().hex}"
    at, records, ids = 0, 0, 0
    with fs.open_output_stream(f"{mine}.rec") as data, fs.open_output_stream(f"{mine}.idx") as index:
        for b in batches:
            texts, names = b.column("text").to_pylist(), b.column("doc_id").to_pylist()
            for a, z in in_lots(texts):
                for name, packed in zip(names[a:z], enc.encode(texts[a:z])):
                    record = frame(META.pack(name is None, name or 0, width) + packed + end)
                    data.write(record)
                    index.write(struct.pack("<Q", at))
                    at += len(record)
                    records += 1
                    ids += len(packed) // width + 1
    final = f"part-{shard:08d}"
    for kind in ("idx", "rec"):
        fs.move(f"{mine}.{kind}", f"{root}/{final}.{kind}")
    yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [final], "records": [records], "ids": [ids], "bytes": [at]}, pa.schema([("shard", pa.int32()), ("path", pa.string()), ("records", pa.int64()), ("ids", pa.int64()), ("bytes", pa.int64())]))


def write_records(docs: DataFrame, folder: str, path: str, end_id: int = END_ID, special: bool = False) -> DataFrame:
    """Encode every text and write the shards; returns their manifest (one row per shard).

    ``docs`` needs doc_id (long) and text; a null text is empty. Rows are spread by ranges of
    doc_id; rows that share an id may be split over tasks, in input order."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("doc_id", "text").withColumn("__tie", F.monotonically_increasing_id())
    fs, root = _open(folder)
    fs.create_dir(root, recursive=True)
    ranged = rows.repartitionByRange(parts, F.asc_nulls_first("doc_id"), "__tie").sortWithinPartitions(F.asc_nulls_first("doc_id"), "__tie")
    return durable(ranged.mapInArrow(partial(_write, folder=folder, path=path, end_id=end_id, special=special), MANIFEST))


def records_of(data: Iterator[bytes]) -> Iterator[memoryview]:
    """Payloads from consecutive chunks of a shard."""
    held = b""
    for chunk in data:
        held = held + chunk if held else chunk
        at = 0
        while len(held) - at >= HEAD.size:
            length = HEAD.unpack_from(held, at)[0]
            if len(held) - at < HEAD.size + length + 4:
                break
            payload, at = unframe(held, at)
            yield payload
        held = held[at:]
    if held:
        raise ValueError("shard ends inside a record")


def _chunks(fs: pafs.FileSystem, path: str) -> Iterator[bytes]:
    with fs.open_input_stream(path) as f:
        while chunk := f.read(READ_BYTES):
            yield chunk


def decode(payload: memoryview) -> tuple[int | None, np.ndarray]:
    missing, name, width = META.unpack_from(payload)
    return None if missing else name, np.frombuffer(payload, f"<u{width}", offset=META.size)


def _read(batches: Iterator[pa.RecordBatch], folder: str, with_ids: bool) -> Iterator[pa.RecordBatch]:
    fs, root = _open(folder)
    for b in batches:
        for path, first in zip(b.column("path").to_pylist(), b.column("before").to_pylist()):
            out: dict[str, list] = {"doc_id": [], "start": [], "n_tokens": [], "ids_crc32": []} | ({"ids": []} if with_ids else {})
            held = 0
            for payload in records_of(_chunks(fs, f"{root}/{path}.rec")):
                name, ids = decode(payload)
                wide = ids.astype("<u4")
                for k, v in (("doc_id", name), ("start", first), ("n_tokens", len(wide)), ("ids_crc32", zlib.crc32(wide))):
                    out[k].append(v)
                if with_ids:
                    out["ids"].append(wide.view("<i4"))
                first += len(wide)
                held += len(wide) if with_ids else 64
                if held > 1 << 20:
                    yield _batch(out)
                    out, held = {k: [] for k in out}, 0
            yield _batch(out)


def _batch(out: dict[str, list]) -> pa.RecordBatch:
    kinds = {"ids": pa.list_(pa.int32())}
    return pa.RecordBatch.from_arrays([pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items()], list(out))


def read_records(manifest: DataFrame, folder: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked for, the ids.

    The ids before each shard come from the manifest, which has one row per shard; shards are read
    one per task, in chunks."""
    before, shards = 0, []
    for r in sorted(manifest.collect(), key=lambda r: r["shard"]):
        shards.append((r["path"], before))
        before += r["ids"]
    spark = manifest.sparkSession
    todo = spark.createDataFrame(shards, "path string, before bigint").repartition(max(1, len(shards)))
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + (", ids array<int>" if with_ids else "")
    return todo.mapInArrow(partial(_read, folder=folder, with_ids=with_ids), schema)


def read_at(folder: str, shard: str, places: list[int]) -> list[tuple[int | None, np.ndarray]]:
    """Single records of a shard by their number, through its index: what a shuffled reader does."""
    fs, root = _open(folder)
    got = []
    with fs.open_input_file(f"{root}/{shard}.idx") as index, fs.open_input_file(f"{root}/{shard}.rec") as data:
        for n in places:
            at = struct.unpack("<Q", index.read_at(8, 8 * n))[0]
            length = HEAD.unpack(data.read_at(HEAD.size, at))[0]
            got.append(decode(unframe(data.read_at(HEAD.size + length + 4, at))[0]))
    return got


def op1_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = f"{shared_dir(spark).rstrip('/')}/records-{uuid.uuid4().hex}"
    manifest = write_records(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"), special=True)
    return read_records(manifest, folder)
