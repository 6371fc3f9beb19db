"""Best-two-fit packing of token sequences, planned on lengths and carried out by joins.

A piece is at most ``capacity`` tokens long, so how often each length occurs is a table of at most
``capacity`` rows, whatever the corpus. The plan is made on those counts: fill a bin greedily with the longest
piece left that fits; then try to replace its smallest piece by two unpacked ones that fill the widened
gap more tightly; repeat that bin as often as the counts allow. Each step uses up a length
or what is left of it, so the plan is bounded by the capacity. Pieces get a number inside
their length (in hash buckets, so a length that a third of all pieces has is no hot group) and look
their bin up in the plan. No token is moved to place it."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peerlens.llm.common import durable, number_in_class, table
from peerlens.llm.tokens import encoder, in_lots

CAPACITY = 2048
END_ID = 0
PIECES = "doc_id {id}, piece int, start bigint, length bigint, ids_crc32 bigint"


def _pieces(batches: Iterator[pa.RecordBatch], path: str, end_id: int, capacity: int, with_ids: bool, special: bool) -> Iterator[pa.RecordBatch]:
    enc = encoder(path, special)
    width, end = enc.dtype.itemsize, np.array([end_id], enc.dtype).tobytes()
    for b in batches:
        texts = b.column(1).to_pylist()
        for a, z in in_lots(texts):
            row, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, packed in enumerate(enc.encode(texts[a:z])):
                packed += end
                n = len(packed) // width
                for k, s in enumerate(range(0, n, capacity)):
                    part = np.frombuffer(packed[s * width : (s + capacity) * width], enc.dtype).astype("<u4")
                    row.append(a + i)
                    piece.append(k)
                    start.append(s)
                    length.append(len(part))
                    crc.append(zlib.crc32(part))
                    ids.append(part.view("<i4") if with_ids else None)
            out = [b.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                out, names = [*out, pa.array(ids, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(out, names)


def token_pieces(docs: DataFrame, path: str, end_id: int = END_ID, capacity: int = CAPACITY, with_ids: bool = False, special: bool = False) -> DataFrame:
    """The pieces of every document: its ids and ``end_id``, cut only beyond ``capacity``. A null or empty text
    is the end id alone. ``with_ids`` adds the ids themselves."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = PIECES.format(id=kind) + (", ids array<int>" if with_ids else "")
    call = partial(_pieces, path=path, end_id=end_id, capacity=capacity, with_ids=with_ids, special=special)
    return docs.select("doc_id", "text").mapInArrow(call, schema)


def _fitting(left: np.ndarray) -> np.ndarray:
    """For every gap the longest length left that fits it (0: none)."""
    at = np.where(left > 0, np.arange(len(left)), 0)
    return np.maximum.accumulate(at)


def _tighter_two(left: np.ndarray, gap: int, smallest: int) -> tuple[int, int] | None:
    """Two unpacked lengths that together fill ``gap`` as far as possible, and beyond ``smallest``."""
    fit = _fitting(left)
    a = np.flatnonzero(left[: gap + 1] > 0)
    if not len(a):
        return None
    b = fit[gap - a]
    same = (b == a) & (left[a] < 2)
    if same.any():
        lower = left.copy()
        for i in np.flatnonzero(same):
            keep = lower[a[i]]
            lower[a[i]] = 0
            b[i] = _fitting(lower[: gap - a[i] + 1])[gap - a[i]]
            lower[a[i]] = keep
    total = np.where(b > 0, a + b, 0)
    best = int(total.argmax())
    return (int(a[best]), int(b[best])) if total[best] > smallest else None


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """[(lengths in one bin, number of such bins)] that use up ``counts`` (number of pieces by length)."""
    left = np.zeros(capacity + 1, np.int64)
    for n, c in counts.items():
        left[n] = c
    left[0] = 0
    plan = []
    while True:
        longest = int(_fitting(left)[capacity])
        if not longest:
            return plan
        bin_, gap = [], capacity
        while gap and (fits := int(_fitting(left[: gap + 1])[gap])):
            bin_.append(fits)
            left[fits] -= 1
            gap -= fits
        if gap and len(bin_) > 1:
            small = bin_[-1]
            if two := _tighter_two(left, gap + small, small):
                bin_[-1:] = two
                left[small] += 1
                left[two[0]] -= 1
                left[two[1]] -= 1
        used, uses = np.unique(bin_, return_counts=True)
        again = int((left[used] // uses).min())
        left[used] -= again * uses
        plan.append((bin_, again + 1))


def _plan_rows(plan: list[tuple[list[int], int]]) -> list[tuple[int, int, int, int, int, int, int]]:
    """(length, lowest number, number past the highest, first bin, uses in a bin, which use, offset)."""
    rows, used, first = [], {}, 0
    for bin_, times in plan:
        offset, seen = 0, {}
        for n in bin_:
            seen.setdefault(n, []).append(offset)
            offset += n
        for n, places in seen.items():
            low = used.get(n, 0)
            used[n] = low + times * len(places)
            rows += [(n, low, used[n], first, len(places), k, p) for k, p in enumerate(places)]
        first += times
    return rows


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with sequence_id and offset; offsets of a sequence leave no gap.

    Needs ``length`` (1 to ``capacity``) and columns doc_id, piece, start that tell rows apart; all others are carried along.
    Rows that agree in all three are told apart by their place in the numbering. The plan is joined by
    broadcast: its size is bounded by the capacity. An empty table gives no rows."""
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = spark.createDataFrame(
        _plan_rows(plan_bins(counts, capacity)), "length bigint, low bigint, high bigint, first bigint, uses int, use int, offset bigint"
    )
    numbered = number_in_class(pieces, ["length"], ["doc_id", "piece", "start"], "__no")
    at = F.col("__no") - F.col("low")
    fits = (numbered["length"] == plan["length"]) & (F.col("__no") >= F.col("low")) & (F.col("__no") < F.col("high")) & (at % F.col("uses") == F.col("use"))
    found = numbered.join(F.broadcast(plan), fits)
    return found.select(*[numbered[c] for c in pieces.columns], (F.col("first") + F.floor(at / F.col("uses"))).cast("long").alias("sequence_id"), "offset")


def packed_sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): whole sequences, from packed pieces that carry ``ids``."""
    return packed.groupBy("sequence_id").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda p: p["ids"])).alias("ids")
    )


def pack_documents(docs: DataFrame, path: str, end_id: int = END_ID, capacity: int = CAPACITY, special: bool = False) -> DataFrame:
    return pack(durable(token_pieces(docs, path, end_id, capacity, special=special)), capacity)


def op2_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), special=True)
