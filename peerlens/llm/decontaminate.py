"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, scanned over all windows of the documents.

Test items become windows of ten words (a shorter item is one window). Distinct windows are broadcast as word numbers
with sorted hashes; a task numbers the words of its documents by the same vocabulary, hashes all windows of each
length at once, and verifies every hit word by word. The set is cut into sets of bounded size if it is too
large for one; each set then scans the documents once more, and the hits of a document are united."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peerlens.llm.common import durable, free_name, quoted, raw_bytes, table

WINDOW = 10
#: Bytes of words and item ids in one broadcast set.
SET_BYTES = 32 << 20
#: Words a task holds at once, and bytes of a text it cuts at once; a text is always scanned whole.
WORDS_AT_ONCE, CUT_BYTES = 1 << 20, 1 << 20
# A word is a run of characters other than ASCII controls, signs, capitals and DEL; in UTF-8 that is a run of these bytes.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
NO_WORD = re.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]")
_TIMES = np.random.default_rng(12).integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def cuts(text: bytes) -> Iterator[tuple[int, int]]:
    """Spans of about ``CUT_BYTES`` that together hold the text and end between words."""
    start = 0
    while start < len(text):
        gap = NO_WORD.search(text, start + CUT_BYTES)
        end = gap.start() if gap else len(text)
        yield start, end
        start = end


def words_of(text: bytes | None) -> Iterator[list[bytes]]:
    """The words of a UTF-8 text with A-Z lower-cased, a cut at a time."""
    text = (text or b"").lower()
    for a, z in cuts(text):
        yield WORD.findall(text, a, z)


def _windows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for item, text in zip(b.column("item").to_pylist(), raw_bytes(b.column("text"))):
            words = [w for cut in words_of(text) for w in cut]
            size = min(window, len(words))
            grams = sorted({b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)}) if words else []
            for i in range(0, len(grams), 1 << 14):
                some = grams[i : i + (1 << 14)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([item] * len(some), pa.string()), pa.array([g.decode() for g in some]), pa.array([size] * len(some), pa.int32())], ["item", "gram", "size"]
                )


def item_windows(items: DataFrame, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(gram, size, items): every distinct window of the items and the ids, as text, of the items that hold it.

    Repeated items and windows count once; an item without words has no window; a null id is the empty text."""
    texts = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).alias("text"))
    grams = texts.mapInArrow(lambda b: _windows(b, window), "item string, gram string, size int")
    return grams.groupBy("gram", "size").agg(F.array_sort(F.collect_set("item")).alias("items"))


class WindowSet:
    """Distinct windows as word numbers, sorted by hash inside each length, and the items of each."""

    def __init__(self, grams: Iterable[tuple[str, int, list[str]]]):
        self.number: dict[bytes, int] = {}
        by_size: dict[int, tuple[list[list[int]], list[list[str]]]] = {}
        for gram, size, items in grams:
            held, owners = by_size.setdefault(size, ([], []))
            held.append([self.number.setdefault(w, len(self.number) + 1) for w in gram.encode().split(b" ")])
            owners.append(items)
        self.sizes = {}
        for size, (held, owners) in by_size.items():
            words = np.array(held, np.uint32).reshape(-1, size)
            hashes = self.hashes(words.ravel(), size)[::size]
            order = np.argsort(hashes, kind="stable")
            hashes = hashes[order]
            seen = np.zeros(1 << 22, bool)
            seen[hashes >> np.uint64(42)] = True
            self.sizes[size] = (hashes, words[order], [owners[i] for i in order], np.packbits(seen))

    @staticmethod
    def hashes(numbers: np.ndarray, size: int) -> np.ndarray:
        """The hash of every run of ``size`` numbers."""
        n = len(numbers) - size + 1
        if n <= 0:
            return np.empty(0, np.uint64)
        out = np.zeros(n, np.uint64)
        for i in range(size):
            out += numbers[i : i + n].astype(np.uint64) * _TIMES[i % 64] * (np.uint64(2) * np.uint64(i // 64) + np.uint64(1))
        return (out ^ (out >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)

    def hits(self, numbers: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(size, starts, windows) of all runs of numbers that are windows of the set, checked word by word."""
        for size, (hashes, words, _, seen) in self.sizes.items():
            made = self.hashes(numbers, size)
            slot = (made >> np.uint64(42)).astype(np.int64)
            maybe = np.flatnonzero((seen[slot >> 3] >> (7 - (slot & 7))) & 1)
            at = np.searchsorted(hashes, made[maybe])
            while len(maybe):
                inside = at < len(hashes)
                maybe, at = maybe[inside], at[inside]
                same = hashes[at] == made[maybe]
                maybe, at = maybe[same], at[same]
                true = (numbers[maybe[:, None] + np.arange(size)] == words[at]).all(axis=1)
                yield size, maybe[true], at[true]
                maybe, at = maybe[~true], at[~true] + 1


def merged(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Spans that overlap or touch become one."""
    if not len(starts):
        return []
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    first = np.concatenate(([True], starts[1:] > ends[:-1]))
    last = np.concatenate((first[1:], [True]))
    return list(zip(starts[first].tolist(), ends[last].tolist()))


SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])


def _scan(batches: Iterator[pa.RecordBatch], held: Broadcast) -> Iterator[pa.RecordBatch]:
    grams: WindowSet = held.value
    get = grams.number.get
    for b in batches:
        texts = raw_bytes(b.column("text"))
        row = 0
        while row < len(texts):
            first, parts, ends, total = row, [], [], 0
            while row < len(texts) and (row == first or total < WORDS_AT_ONCE):
                for cut in words_of(texts[row]):
                    parts.append(np.fromiter((get(w, 0) for w in cut), np.uint32, len(cut)))
                    total += len(cut)
                ends.append(total)
                parts.append(np.zeros(1, np.uint32))  # no window reaches over the end of a document
                total += 1
                row += 1
            numbers = np.concatenate(parts)
            ends = np.array(ends)
            begins = np.concatenate(([0], ends[:-1] + 1))
            spans: list[list] = [[] for _ in ends]
            items: list[set] = [set() for _ in ends]
            found = [(s, a, w) for s, a, w in grams.hits(numbers) if len(a)]
            starts = np.concatenate([a for _, a, _ in found] or [np.empty(0, np.int64)])
            stops = np.concatenate([a + s for s, a, _ in found] or [np.empty(0, np.int64)])
            of = np.searchsorted(ends, starts)
            order = np.argsort(of, kind="stable")
            cut_at = np.flatnonzero(np.diff(of[order])) + 1
            for some in np.split(order, cut_at) if len(order) else []:
                doc = of[some[0]]
                spans[doc] = merged(starts[some] - begins[doc], stops[some] - begins[doc])
            for size, at, which in found:
                owners = grams.sizes[size][2]
                for doc, w in set(zip(np.searchsorted(ends, at).tolist(), which.tolist())):
                    items[doc].update(owners[w])
            part = b.slice(first, row - first)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("row"), part.column("id"), pa.array(ends - begins, pa.int64()),
                    pa.array([[{"start": x, "end": y} for x, y in s] for s in spans], pa.list_(SPAN)),
                    pa.array([sorted(i) for i in items], pa.list_(pa.string())),
                ],
                ["row", "id", "n_words", "spans", "items"],
            )


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        spans = [merged(np.array([s["start"] for s in x], np.int64), np.array([s["end"] for s in x], np.int64)) for x in b.column("spans").to_pylist()]
        told = pa.array([[{"start": x, "end": y} for x, y in s] for s in spans], pa.list_(SPAN))
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("row", "id", "n_words")), told, b.column("items")], ["row", "id", "n_words", "spans", "items"])


def scan(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id",
    item_text: str = "text", set_bytes: int = SET_BYTES,
) -> DataFrame:
    """One row per document: row (its place in ``docs``), id, n_words, spans (words hit, from 0, end excluded, apart from
    each other and in order), items (ids, as text, of the items with an occurring window, sorted as text).

    A null or empty text has no words and no hit. Repeated rows stay repeated; an empty table on either side gives no
    rows or no hits; other columns are ignored."""
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    windows = durable(item_windows(items, window, item_id, item_text))
    cost = F.octet_length("gram") + 16 * F.col("size") + F.aggregate("items", F.lit(64), lambda a, x: a + F.octet_length(x) + 8)
    total = windows.agg(F.sum(cost.cast("long"))).first()[0] or 0
    sets = max(1, -(-total // set_bytes))
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"row bigint, id {kind}, n_words bigint, spans array<struct<start: bigint, end: bigint>>, items array<string>"
    out = None
    for i in range(sets):  # each set is a stated part of the queries, of bounded size
        part = windows.where(F.pmod(F.xxhash64("gram"), F.lit(sets)) == i) if sets > 1 else windows
        held = spark.sparkContext.broadcast(WindowSet((r["gram"], r["size"], r["items"]) for r in part.collect()))
        hits = texts.mapInArrow(lambda b, held=held: _scan(b, held), schema)
        out = hits if out is None else out.unionByName(hits)
    if sets == 1:
        return out
    once = out.groupBy("row").agg(
        F.first("id").alias("id"), F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    return once.mapInArrow(_united, schema)


def without_spans(text: bytes, spans: list[dict]) -> bytes:
    """The text without the words of the spans and what stands between the words of one span."""
    lowered, kept, done, word, left = text.lower(), [], 0, 0, iter(spans)
    span = next(left, None)
    opened = 0
    for m in WORD.finditer(lowered):
        if span is None:
            break
        if word == span["start"]:
            opened = m.start()
        word += 1
        if word == span["end"]:
            kept.append(text[done:opened])
            done, span = m.end(), next(left, None)
    return b"".join([*kept, text[done:]])


def _cleaned(batches: Iterator[pa.RecordBatch], text: str, spans: str) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keep = [c for c in b.schema.names if c != spans]
        given = b.column(spans).to_pylist()
        clean = [without_spans(t, s).decode() if s else t and t.decode() for t, s in zip(raw_bytes(b.column(text)), given)]
        yield pa.RecordBatch.from_arrays([pa.array(clean, pa.string()) if c == text else b.column(c) for c in keep], keep)


def decontaminate(
    docs: DataFrame, items: DataFrame, remove: str = "documents", window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", **more
) -> DataFrame:
    """``docs`` without its hits: whole documents go (``remove="documents"``), or only the spans (``"spans"``).

    Rows are matched by their place, so ``docs`` must give its rows in the same order each time, as files do. Clean rows come
    back as they were, nulls included; columns of any name pass through."""
    if remove not in ("documents", "spans"):
        raise ValueError(f"unknown way {remove!r}")
    row, spans = free_name(docs, "row"), free_name(docs, "spans")
    marks = scan(docs, items, window, id_col, text_col, **more).where(F.size("spans") > 0)
    marks = durable(marks.select(F.col("row").alias(row), F.col("spans").alias(spans)))
    placed = docs.withColumn(row, F.monotonically_increasing_id())
    if remove == "documents":
        return placed.join(marks, row, "left_anti").select(*map(quoted, docs.columns))
    plain = [f"c{i}" for i in range(len(docs.columns))]
    joined = placed.join(marks, row, "left").select(*map(quoted, [*docs.columns, spans])).toDF(*plain, "spans")
    text = plain[docs.columns.index(text_col)]
    kinds = ", ".join(f"{c} {f.dataType.simpleString()}" for c, f in zip(plain, docs.schema.fields))
    return joined.mapInArrow(lambda b: _cleaned(b, text, "spans"), kinds).toDF(*docs.columns)


def op12_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        F.col("id").alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), bw AS (
  SELECT item, least(len(w), 10) AS size, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS k, w FROM b WHERE len(w) > 0
), grams AS (
  SELECT DISTINCT item, size, array_to_string(w[k:k + size - 1], ' ') AS gram FROM bw
), dw AS (
  SELECT id, size, unnest(range(1, len(w) - size + 2)) AS k, w FROM d, (SELECT DISTINCT size FROM grams) WHERE len(w) >= size
), hit AS (
  SELECT x.id, x.k, x.size, g.item FROM (SELECT id, k, size, array_to_string(w[k:k + size - 1], ' ') AS gram FROM dw) x JOIN grams g USING (size, gram)
), words AS (
  SELECT id, count(DISTINCT at_word) AS n_hit FROM (SELECT id, unnest(range(k, k + size)) AS at_word FROM hit) GROUP BY id
), items AS (
  SELECT id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT id, item FROM hit) GROUP BY id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (id) LEFT JOIN items USING (id)
"""
