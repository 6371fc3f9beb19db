"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Fingerprints at most r bits apart have a common variant at most r/2 bits from each. So every distinct
fingerprint stands for all its variants within r/2 flips; those that collide are linked. Two that
share a variant are at most r apart by the triangle inequality; each link is verified all the same.

Variants are not shuffled one by one. A fingerprint goes to every prefix that one of its variants
has (a few dozen rows instead of 2081), together with the flips it has left; the task of a prefix
makes the variants of that prefix, sorts them and links the fingerprints that meet. A prefix
with too many variants for one go is cut again by its next bits, so memory stays bounded. Per
prefix only a spanning forest leaves the task: a group of n fingerprints gives below n links."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peerlens.llm.common import at_places, durable, raw_bytes, table
from peerlens.llm.components import components

BITS = 64
VARIANTS_AT_ONCE = 1 << 20
SPLIT_BITS = 6


def shingle_digests(text: bytes | None, shingle: int) -> list[bytes]:
    """XXH64 of each word shingle of a UTF-8 text in order; none if it has no words, one if it has fewer than ``shingle``."""
    words = (text or b"").lower().split()
    joined = b" ".join(words)
    if not words:
        return []
    if len(words) <= shingle:
        return [xxhash.xxh64_digest(joined, 42)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist())
    return [xxhash.xxh64_digest(joined[a:b], 42) for a, b in spans]


def fingerprint(text: bytes | None, shingle: int = 4) -> int:
    """Signed 64-bit SimHash of the word shingles of a UTF-8 text; 0 if it has no words."""
    digests = shingle_digests(text, shingle)
    if not digests:
        return 0
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(digests), 1 << 16):
        block = np.frombuffer(b"".join(digests[i : i + (1 << 16)]), np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(digests)).tobytes(), "big", signed=True)


def _fingerprints(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        prints = [fingerprint(t, shingle) for t in raw_bytes(b.column("text"))]
        yield pa.RecordBatch.from_arrays([b.column("row"), b.column("doc_id"), pa.array(prints, pa.int64())], ["row", "doc_id", "fp"])


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, fp) of every row; a null text counts as empty. ``row`` is its place in ``docs``."""
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(partial(_fingerprints, shingle=shingle), f"row bigint, doc_id {kind}, fp bigint")


@lru_cache(64)
def _masks(bits: int, flips: int, low: int) -> tuple[np.ndarray, np.ndarray]:
    """All masks of at most ``flips`` ones over ``bits`` bits from bit ``low`` up, and their ones."""
    got = [(sum(1 << (low + i) for i in c), n) for n in range(flips + 1) for c in combinations(range(bits), n)]
    return np.array([m for m, _ in got], np.uint64), np.array([n for _, n in got], np.int8)


def _send(batches: Iterator[pa.RecordBatch], prefix: int, flips: int) -> Iterator[pa.RecordBatch]:
    """Deal every fingerprint to the prefixes of its variants, packed: one row per prefix and batch."""
    masks, _ = _masks(prefix, flips, 0)
    for b in batches:
        fps = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for i in range(0, len(fps), 1 << 14):
            part = fps[i : i + (1 << 14)]
            to = ((part >> np.uint64(BITS - prefix))[:, None] ^ masks[None, :]).ravel()
            order = np.argsort(to, kind="stable")
            to, held = to[order], np.repeat(part, len(masks))[order]
            cuts = np.flatnonzero(np.diff(to)) + 1
            starts = np.concatenate(([0], cuts))
            packed = [held[a:z].tobytes() for a, z in zip(starts, np.concatenate((cuts, [len(to)])))]
            yield pa.RecordBatch.from_arrays([pa.array(to[starts].astype(np.int64)), pa.array(packed, pa.binary())], ["prefix", "fps"])


def _meet(fps: np.ndarray, left: np.ndarray, low_bits: int, flips: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Star links (smallest, other) among fingerprints that share a variant of their low bits."""
    sizes = [len(_masks(low_bits, n, 0)[0]) for n in range(flips + 1)]
    total = sum(int((left == n).sum()) * sizes[n] for n in range(flips + 1))
    if len(fps) < 2:
        return
    if total > VARIANTS_AT_ONCE and low_bits > SPLIT_BITS:
        masks, ones = _masks(SPLIT_BITS, flips, 0)
        head = (fps >> np.uint64(low_bits - SPLIT_BITS)) & np.uint64((1 << SPLIT_BITS) - 1)
        for value in range(1 << SPLIT_BITS):
            spent = np.bitwise_count(head ^ np.uint64(value)).astype(np.int8)
            reach = spent <= left
            yield from _meet(fps[reach], (left - spent)[reach], low_bits - SPLIT_BITS, flips)
        return
    under = fps & np.uint64((1 << low_bits) - 1)
    made, owner = [], []
    for n in range(flips + 1):
        own = np.flatnonzero(left == n)
        made.append((under[own][:, None] ^ _masks(low_bits, n, 0)[0][None, :]).ravel())
        owner.append(np.repeat(own, sizes[n]))
    made, owner = np.concatenate(made), np.concatenate(owner)
    ranked = np.sort(made)
    twice = ranked[1:][ranked[1:] == ranked[:-1]]
    if not len(twice):
        return
    slot = lambda x: (x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)
    table_ = np.zeros(1 << 20, bool)
    table_[slot(twice)] = True
    near = np.flatnonzero(table_[slot(made)])
    made, held = made[near], fps[owner[near]]
    order = np.lexsort((held, made))
    made, held = made[order], held[order]
    first = np.concatenate(([True], made[1:] != made[:-1]))
    centre = held[np.flatnonzero(first)][np.cumsum(first) - 1]
    other = held != centre
    yield centre[other], held[other]


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star per connected group of the links: (root, node)."""
    nodes, ids = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = ids[: len(a)], ids[len(a) :]
    label = np.arange(len(nodes))
    while True:
        old = label.copy()
        least = np.minimum(label[x], label[y])
        np.minimum.at(label, label[x], least)
        np.minimum.at(label, label[y], least)
        label = label[label]
        if np.array_equal(old, label):
            return nodes[label], nodes


def _links(key: tuple, group: pa.Table, prefix: int, radius: int) -> pa.Table:
    flips = radius // 2
    fps = np.frombuffer(b"".join(group.column("fps").to_pylist()), np.uint64)
    spent = np.bitwise_count((fps >> np.uint64(BITS - prefix)) ^ np.uint64(key[0].as_py())).astype(np.int8)
    roots, nodes = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
    for a, b in _meet(fps, (flips - spent).astype(np.int8), BITS - prefix, flips):
        true = np.bitwise_count(a ^ b) <= radius
        r, n = _forest(a[true], b[true])
        roots.append(r)
        nodes.append(n)
    r, n = _forest(np.concatenate(roots), np.concatenate(nodes))
    keep = r != n
    return pa.table({"u": r[keep].view(np.int64), "v": n[keep].view(np.int64)})


def near_links(fps: DataFrame, radius: int = 4) -> DataFrame:
    """Links (u, v) between distinct fingerprints that span the graph of those ``radius`` or fewer bits
    apart (``radius`` even). ``fps``: one column of distinct fingerprints, written beforehand."""
    n, flips = fps.count(), radius // 2
    ball = len(_masks(BITS, flips, 0)[0])
    prefix = min(40, max(4, int(np.ceil(np.log2(max(1, n) * ball / VARIANTS_AT_ONCE + 1)))))
    sent = fps.mapInArrow(partial(_send, prefix=prefix, flips=flips), "prefix bigint, fps binary")
    return sent.groupBy("prefix").applyInArrow(lambda key, group: _links(key, group, prefix, radius), "u bigint, v bigint")


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id, kept, row.

    component_id is the smallest doc_id reachable over links. Texts without words (null, empty, blank)
    have fingerprint zero and are linked like any other. Repeated rows stay repeated; a component
    whose ids are all null has a null id. Of a component one row is ``kept``: of the smallest doc_id, then the
    first place. An empty table gives no rows."""
    prints = durable(fingerprints(docs, shingle, id_col, text_col))
    distinct = durable(prints.groupBy("fp").agg(F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "row")).alias("least")))
    links = durable(near_links(distinct.select("fp"), radius))
    roots = components(links)
    named = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = durable(named)
    lowest = durable(named.groupBy("root").agg(F.min("least").alias("keep")))
    of_print = durable(named.join(lowest, "root").select("fp", "keep"))
    return prints.join(of_print, "fp").select(
        prints["doc_id"], F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("keep.doc_id").alias("component_id"),
        (F.col("row") == F.col("keep.row")).alias("kept"), "row",
    )


def drop_near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4) -> DataFrame:
    """Of each component the kept row, with all its columns. Rows are matched by their place, so ``docs`` must
    be a table that gives its rows in the same order each time, such as files."""
    return at_places(docs, near_duplicates(docs, shingle, radius).where("kept").select("row"))


def op3_simhash_ball(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("row")
