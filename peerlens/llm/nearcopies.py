"""Near copies by the Jaccard similarity of their word shingles: MinHash bands propose pairs, the shingle sets decide.

Texts whose band of five minima agrees share a bucket. In a bucket of a few rows all pairs are proposed; in a larger one
every row with the first, so a group of n rows never gives n squared pairs. A proposed pair is first compared by its
signatures (one byte a minimum), then by its whole shingle sets; only true pairs are linked. Rows of a large bucket that
these links leave apart from its first row are then held against the whole bucket: packs of shingle sets meet in
a task, which finds all similarities at once as a product of incidence matrices and emits a spanning forest. So
a bucket loses no link, and only rows that differ from the rest cost more than one comparison."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peerlens.llm.common import at_places, durable, raw_bytes
from peerlens.llm.components import components
from peerlens.llm.simhash import _forest, drop_near_duplicates, shingle_digests

#: A pair of similarity 0.8 misses every band with probability (1 - 0.8**5)**32, about 3 in a million.
BANDS, BAND_ROWS = 32, 5
ALL_PAIRS_ROWS = 8
#: Rows and bytes of shingle sets in a pack, on average.
PACK_ROWS, PACK_BYTES = 512, 4 << 20
#: Pairs whose signatures agree this much less than asked for are dropped unread: five deviations at 0.8.
SLACK = 0.16
_DRAWN = np.random.default_rng(20).integers(0, 1 << 63, (2, BANDS * BAND_ROWS), dtype=np.uint64)
_TIMES, _PLUS = _DRAWN[0] * np.uint64(2) + np.uint64(1), _DRAWN[1]


def shingle_hashes(text: bytes | None, shingle: int) -> np.ndarray:
    """64-bit hashes of the word shingles of a UTF-8 text; a text without words has one of its own."""
    return np.frombuffer(b"".join(shingle_digests(text, shingle) or [xxhash.xxh64_digest(b"", 42)]), ">u8").astype(np.uint64)


def minima(hashes: np.ndarray) -> np.ndarray:
    least = np.full(len(_TIMES), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 2048):
        np.minimum(least, (hashes[i : i + 2048, None] * _TIMES + _PLUS).min(axis=0), out=least)
    return least


def _signed(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sigs, keys = [], []
        for t in raw_bytes(b.column("text")):
            m = minima(shingle_hashes(t, shingle))
            sigs.append((m >> np.uint64(24)).astype(np.uint8).tobytes())
            bands = m.reshape(BANDS, BAND_ROWS)
            keys.append(np.array([xxhash.xxh64_intdigest(x.tobytes(), i) for i, x in enumerate(bands)], np.uint64).view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [b.column("row"), b.column("doc_id"), pa.array(sigs, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["row", "doc_id", "sig", "keys"]
        )


def _sets(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        held = [np.unique(shingle_hashes(t, shingle)).tobytes() for t in raw_bytes(b.column("text"))]
        yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(held, pa.binary())], ["row", "held"])


def _alike(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Pairs whose signatures agree in at least the share ``least``."""
    for b in batches:
        if b.num_rows:
            one, two = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(b.num_rows, -1) for c in ("a", "b"))
            keep = pa.array((one == two).mean(axis=1) >= least)
            yield b.select(["u", "v"]).filter(keep)


def _true(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Pairs whose sets have Jaccard similarity ``least`` or more."""
    for b in batches:
        keep = []
        for x, y in zip(b.column("a").to_pylist(), b.column("b").to_pylist()):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(x) + len(y)
            shared = 0 if min(len(x), len(y)) < least * max(len(x), len(y)) else len(np.intersect1d(x, y, assume_unique=True))
            keep.append(shared >= least * (both - shared))
        yield b.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))


def _with_both(pairs: DataFrame, of: DataFrame, col: str) -> DataFrame:
    first = pairs.join(of.select(F.col("row").alias("u"), F.col(col).alias("a")), "u")
    return first.join(of.select(F.col("row").alias("v"), F.col(col).alias("b")), "v").select("u", "v", "a", "b")


def proposed(signed: DataFrame) -> DataFrame:
    """Distinct pairs (u, v), u < v, of rows that share a bucket: all pairs of a small one, first and other of a large one."""
    dealt = signed.select("row", F.explode("keys").alias("key"))
    buckets = durable(dealt.groupBy("key").agg(F.count("*").alias("n"), F.min("row").alias("first")).where("n > 1"))
    rows = durable(dealt.join(buckets, "key"))
    stars = rows.where("row <> first").select(F.col("first").alias("u"), F.col("row").alias("v"))
    few = rows.where(F.col("n").between(3, ALL_PAIRS_ROWS))
    others = few.select("key", F.col("row").alias("u")).join(few.select("key", F.col("row").alias("v")), "key").where("u < v").select("u", "v")
    return stars.unionByName(others).distinct()


def similar(a: list[np.ndarray], b: list[np.ndarray], least: float) -> np.ndarray:
    """Which sets of ``a`` and of ``b`` (sorted, distinct hashes) have similarity ``least`` or more: a matrix.

    Shared hashes are counted as a product of incidence matrices over the hashes that two sets hold at least."""
    sizes = [np.array([len(x) for x in side], np.int64) for side in (a, b)]
    _, number, times = np.unique(np.concatenate([*a, *b]), return_inverse=True, return_counts=True)
    column = np.where(times > 1, np.cumsum(times > 1) - 1, -1)[number]
    width = int((times > 1).sum())
    row = np.repeat(np.arange(len(a) + len(b)), np.concatenate(sizes))
    row, column = row[column >= 0], column[column >= 0]
    shared = np.zeros((len(a), len(b)))
    for low in range(0, width, 4096):
        some = (column >= low) & (column < low + 4096)
        held = np.zeros((len(a) + len(b), min(4096, width - low)), np.float32)
        held[row[some], column[some] - low] = 1
        shared += held[: len(a)] @ held[len(a) :].T
    both = sizes[0][:, None] + sizes[1][None, :]
    return shared >= least * (both - shared)


def _met(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """A forest of the true links between the rows of two packs."""
    for batch in batches:
        for left, right in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            sets = [[np.frombuffer(x["held"], np.uint64) for x in side] for side in (left, right)]
            u, v = (np.array([x["row"] for x in side], np.int64) for side in (left, right))
            i, j = np.nonzero(similar(*sets, least))
            root, node = _forest(u[i], v[j])
            keep = root != node
            yield pa.RecordBatch.from_arrays([pa.array(root[keep], pa.int64()), pa.array(node[keep], pa.int64())], ["u", "v"])


def _packs(rows: DataFrame, name: str) -> DataFrame:
    """(key, name): the rows (key, row, held) of a bucket in packs of about ``PACK_ROWS`` rows and ``PACK_BYTES`` bytes."""
    sizes = rows.groupBy("key").agg(F.greatest(F.count("*") / PACK_ROWS, F.sum(F.octet_length("held")) / PACK_BYTES).alias("packs"))
    dealt = rows.join(sizes, "key").withColumn("pack", F.pmod(F.xxhash64("row", F.lit(3)), F.ceil("packs")))
    return dealt.groupBy("key", "pack").agg(F.collect_list(F.struct("row", "held")).alias(name)).drop("pack")


def strangers(signed: DataFrame, links: DataFrame) -> DataFrame:
    """(key, row) of rows of large buckets that ``links`` leave apart from the first row of their bucket."""
    roots = components(links)
    dealt = signed.select("row", F.explode("keys").alias("key"))
    large = dealt.groupBy("key").agg(F.count("*").alias("n"), F.min("row").alias("first")).where(F.col("n") > ALL_PAIRS_ROWS)
    rows = dealt.join(large, "key")
    own = roots.select(F.col("node").alias("row"), F.col("root").alias("own"))
    heads = roots.select(F.col("node").alias("first"), F.col("root").alias("head"))
    told = rows.join(own, "row", "left").join(heads, "first", "left")
    return told.where(F.coalesce("own", "row") != F.coalesce("head", "first")).select("key", "row")


def near_copy_links(texts: DataFrame, signed: DataFrame, shingle: int, least: float) -> DataFrame:
    """(u, v): links that connect all rows of a common bucket whose shingle sets have similarity ``least`` or more.

    ``texts``: (row, text). A pair that survives the signatures has sets of like size, so a huge text is moved to huge texts only."""

    def sets_of(rows: DataFrame) -> DataFrame:
        wanted = texts.join(rows.select("row").distinct(), "row", "left_semi").select("row", "text")
        return durable(wanted.mapInArrow(partial(_sets, shingle=shingle), "row bigint, held binary"))

    alike = durable(_with_both(proposed(signed), signed, "sig").mapInArrow(partial(_alike, least=least - SLACK), "u bigint, v bigint"))
    sets = sets_of(alike.select(F.col("u").alias("row")).unionByName(alike.select(F.col("v").alias("row"))))
    links = durable(_with_both(alike, sets, "held").mapInArrow(partial(_true, least=least), "u bigint, v bigint"))
    apart = durable(strangers(signed, links))
    if apart.isEmpty():
        return links
    bucket = durable(signed.select("row", F.explode("keys").alias("key")).join(apart.select("key").distinct(), "key", "left_semi"))
    held = bucket.join(sets_of(bucket), "row")
    packs = _packs(held.join(apart, ["key", "row"], "left_semi"), "a").join(_packs(held, "b"), "key").select("a", "b")
    return links.unionByName(packs.mapInArrow(partial(_met, least=least), "u bigint, v bigint"))


def drop_near_copies(docs: DataFrame, shingle: int = 5, least: float = 0.8) -> DataFrame:
    """Of each group linked by near copies the row of the smallest doc_id, then the first place, with all its columns.

    Rows are matched by their place, as in ``simhash.drop_near_duplicates``; texts without words are copies of each other."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    signed = durable(texts.mapInArrow(partial(_signed, shingle=shingle), f"row bigint, doc_id {kind}, sig binary, keys array<bigint>"))
    roots = durable(components(near_copy_links(texts, signed, shingle, least)))
    members = roots.select(F.col("node").alias("row"), "root").unionByName(roots.select(F.col("root").alias("row"), "root").distinct())
    members = durable(members.join(signed.select("row", "doc_id"), "row"))
    kept = members.groupBy("root").agg(F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "row")).alias("keep")).select(F.col("keep.row").alias("row"))
    return at_places(docs, durable(members.select("row").join(kept, "row", "left_anti")), "left_anti")


def drop_similar(docs: DataFrame, shingle: int = 5, least: float = 0.8) -> DataFrame:
    """The near-duplicate stage: ball hashing first, then the near copies that its ball does not reach.

    Two texts of similarity 0.8 differ in about ten of 64 SimHash bits, beyond any ball whose variants can be
    made; the README has figures. Of each group the row of the smallest doc_id stays."""
    return drop_near_copies(durable(drop_near_duplicates(docs, shingle)), shingle, least)
