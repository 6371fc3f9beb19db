"""Exact top-k by inner product with block-at-a-time pruning.

A vector is a document whose terms are its components. Vectors are laid out in an order that puts equal sign patterns
together and cut into ranges; a range is a page of small blocks. A page is the forward index of its
vectors and keeps, for every block, the largest and smallest value of each term. For a query, the sum over terms of the larger of
query * largest and query * smallest bounds every score in the block.

Summaries come as a tree: a shelf holds those of 64 pages, and bounds go from shelves to pages to blocks, each step only where
some query may still gain. First every shelf names its most promising page for a block of queries; the best of these is
scored and gives every query a k-th score to beat. Then the shelves are asked again with these floors, and only pages where a
query's bound reaches its floor are read; bounds themselves never leave a task. Inside a page, blocks are taken in descending order of bound, and a query stops when the bounds fall
below its k-th score. Ties are kept and bounds are rounded upwards, so the result is exact whatever they are worth.

Components are whole numbers held exactly: as 32-bit integers, or as doubles in pages with larger ones. Products are summed in doubles
where all sums fit into 53 bits, in 64-bit integers where they fit into those, and in Python's integers elsewhere.

Queries come in blocks too, and one page meets one block of queries at a time: no task holds all vectors."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from peerlens.llm.common import durable, table

K = 5
SCALE = 256
PAGE_VECTORS = 2048
BLOCK_VECTORS = 64
QUERY_VECTORS = 512
SIGNS = 16
SHELF_BITS = 6
#: Up to here sums of whole numbers are exact in double precision.
EXACT = float(1 << 53)
LONGEST = float(1 << 62)
#: Marks of scores that do not fit a long.
OVER, UNDER = (1 << 63) - 1, -(1 << 63) + 2


def integer_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, v): components floor(scale * x), x as double, as doubles without fraction. Vectors that are null or hold
    null or non-finite components, and rows without an id, take no part."""
    v = F.col("v")
    sound = F.col("vec_id").isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    raw = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where(sound)

    def whole(x: Column) -> Column:
        y = x * scale
        return F.when(F.abs(y) >= EXACT, y).otherwise(F.floor(y).cast("double"))  # beyond that doubles have no fraction

    return raw.select("vec_id", F.transform(v, whole).alias("v"))


def _sign_code(v: Column) -> Column:
    """The signs of the first components as one number: near copies and near relatives come to stand together."""
    return F.aggregate(F.slice(v, 1, SIGNS), F.lit(0), lambda code, x: code * 2 + (x > 0).cast("int"))


def _matrix(rows: list[list[float]], width: int) -> np.ndarray:
    m = np.zeros((len(rows), width), "<f8")
    for i, r in enumerate(rows):
        m[i, : len(r)] = r
    return m


def _pack(m: np.ndarray) -> bytes:
    """Whole numbers as 32-bit integers if all fit, else as doubles; the first byte tells which."""
    small = np.abs(m).max(initial=0) < 1 << 31
    return b"i" + m.astype("<i4").tobytes() if small else b"f" + m.astype("<f8").tobytes()


def _read(data: bytes, width: int) -> np.ndarray:
    """The numbers of ``_pack`` as doubles."""
    if not width:
        return np.zeros((0, 0))
    return np.frombuffer(data, "<i4" if data[:1] == b"i" else "<f8", offset=1).reshape(-1, width).astype("<f8")


def _pages(batches: Iterator[pa.RecordBatch], size: int, block: int) -> Iterator[pa.RecordBatch]:
    base, made = TaskContext.get().partitionId() << 32, 0
    ids: list[int] = []
    rows: list[list[float]] = []

    def page() -> pa.RecordBatch:
        width = max(map(len, rows), default=0)
        m = _matrix(rows, width)
        cuts = range(0, len(rows), block)
        high = np.array([m[a : a + block].max(0) for a in cuts]).reshape(len(cuts), width)
        low = np.array([m[a : a + block].min(0) for a in cuts]).reshape(len(cuts), width)
        return pa.RecordBatch.from_pydict({"page": [base + made], "width": [width], "ids": [np.array(ids, "<i8").tobytes()], "m": [_pack(m)], "high": [_pack(high)], "low": [_pack(low)], "most": [_pack(m.max(0, keepdims=True))], "least": [_pack(m.min(0, keepdims=True))]})

    for b in batches:
        for name, v in zip(b.column("vec_id").to_pylist(), b.column("v").to_pylist()):
            ids.append(name)
            rows.append(v)
            if len(ids) == size:
                yield page()
                made, ids, rows = made + 1, [], []
    if ids:
        yield page()


def pages(whole: DataFrame, size: int, block: int = BLOCK_VECTORS) -> DataFrame:
    """(page, width, ids, m, high, low, most, least): the vectors in ranges of sign code and id, the term maxima and minima of
    their blocks and of the page."""
    parts = int(whole.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    coded = whole.withColumn("code", _sign_code(F.col("v")))
    laid = coded.repartitionByRange(parts, "code", "vec_id").sortWithinPartitions("code", "vec_id").select("vec_id", "v")
    return laid.mapInArrow(partial(_pages, size=size, block=block), "page bigint, width bigint, ids binary, m binary, high binary, low binary, most binary, least binary")


def _common(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both cut to the shorter width: missing components count as zero."""
    w = min(a.shape[1], b.shape[1])
    return a[:, :w], b[:, :w]


def _exact_kind(q: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both of the same width and of a kind in which their products are exact."""
    q, m = _common(q, m)
    most = float(np.abs(q).max(initial=0)) * float(np.abs(m).max(initial=0)) * max(1, q.shape[1])
    if most < EXACT:
        return q.astype(np.float64), m.astype(np.float64)
    if most < LONGEST:
        return q.astype(np.int64), m.astype(np.int64)
    wide = lambda a: np.array([[int(x) for x in r] for r in a], object).reshape(a.shape)
    return wide(q), wide(m)


def products(q: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Exact integer inner products of all rows of q with all rows of m, both from ``_exact_kind``. What does not fit
    a long stands as ``OVER`` or ``UNDER``, which ``score_page`` refuses in a result."""
    if not q.shape[1]:
        return np.zeros((len(q), len(m)), np.int64)
    s = q @ m.T
    return np.clip(s, UNDER, OVER).astype(np.int64) if s.dtype == object else s.astype(np.int64)


def bounds(q: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """No score of a query in a block is above its bound: products with the term maxima and minima, in doubles and
    with more than their rounding error added."""
    if not q.shape[1] or not high.shape[1]:
        return np.zeros((len(q), len(high)))
    q, high = _common(q, high)
    low = low[:, : high.shape[1]]
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    size = up @ np.abs(high).T - down @ np.abs(low).T
    return up @ high.T + down @ low.T + size * (4 * (q.shape[1] + 2) * np.finfo(float).eps)


def reaches(bound: np.ndarray, floor: np.ndarray) -> np.ndarray:
    """Whether a score of the bound could be at the floor or above, both rounded in favour of yes."""
    need = floor.astype(float)
    return bound >= need - np.abs(need) * np.finfo(float).eps


def _shelf_bounds(q: np.ndarray, pages_: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(page numbers, term maxima, term minima) of a shelf, as matrices of one width."""
    width = max([p["width"] for p in pages_] + [0])
    high, low = np.zeros((len(pages_), width)), np.zeros((len(pages_), width))
    for i, p in enumerate(pages_):
        if p["width"]:
            high[i, : p["width"]] = _read(p["most"], p["width"])[0]
            low[i, : p["width"]] = _read(p["least"], p["width"])[0]
    return np.array([p["page"] for p in pages_], np.int64), high, low


def _seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The page of the highest bounds of a shelf for a block of queries."""
    for b in batches:
        out = []
        for r in b.to_pylist():
            q = _read(r["q"], r["q_width"])
            names, high, low = _shelf_bounds(q, r["summaries"])
            total = bounds(q, high, low).sum(0) if len(q) else np.zeros(len(names))
            best = int(total.argmax())
            out.append((r["qb"], int(names[best]), float(total[best])))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[], [], []], (pa.int64(), pa.int64(), pa.float64()))], ["qb", "page", "total"])


def _open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pages of a shelf that some query of a block may gain from: the shelf as a whole first, then its pages."""
    for b in batches:
        qbs, names_ = [], []
        for r in b.to_pylist():
            floor = np.array(r["floor"], np.int64)
            q = _read(r["q"], r["q_width"]) if r["q_width"] else np.zeros((len(floor), 0))
            names, high, low = _shelf_bounds(q, r["summaries"])
            live = reaches(bounds(q, high.max(0, keepdims=True), low.min(0, keepdims=True))[:, 0], floor)
            if not live.any():
                continue
            hit = names[reaches(bounds(q[live], high, low), floor[live][:, None]).any(0)]
            qbs += [r["qb"]] * len(hit)
            names_ += hit.tolist()
        yield pa.RecordBatch.from_arrays([pa.array(qbs, pa.int64()), pa.array(names_, pa.int64())], ["qb", "page"])


def score_page(q: np.ndarray, q_ids: np.ndarray, floor: np.ndarray, ids: np.ndarray, m: np.ndarray, high: np.ndarray, low: np.ndarray, k: int, block: int) -> list[tuple[int, int, int]]:
    """(query, vector, score): for each query the k best of the page, as far as they can reach ``floor``.

    Blocks in descending order of each query's bound; a query drops out when its next bound is below its k-th score."""
    n_blocks = -(-len(ids) // block)
    limit = bounds(q, high, low) if m.shape[1] and q.shape[1] else np.zeros((len(q), n_blocks))
    order = np.argsort(-limit, axis=1, kind="stable")
    best_s = np.full((len(q), k), np.iinfo(np.int64).min)
    best_i = np.full((len(q), k), np.iinfo(np.int64).max)
    need = floor.copy()
    q, m = _exact_kind(q, m)
    for step in range(n_blocks):
        live = np.flatnonzero(reaches(np.take_along_axis(limit, order[:, step : step + 1], 1)[:, 0], need))
        if not len(live):
            break
        at = order[live, step]
        for one in np.unique(at):
            who = live[at == one]
            span = slice(one * block, (one + 1) * block)
            s = products(q[who], m[span])
            near = np.flatnonzero((s >= need[who][:, None]).any(1))
            if not len(near):
                continue
            who, s = who[near], s[near]
            names = np.broadcast_to(ids[span], s.shape)
            own = names == q_ids[who][:, None]
            s = np.where(own, np.iinfo(np.int64).min, s)
            names = np.where(own, np.iinfo(np.int64).max, names)
            s, names = np.concatenate((best_s[who], s), 1), np.concatenate((best_i[who], names), 1)
            top = np.lexsort((names, -np.maximum(s, np.iinfo(np.int64).min + 1)), axis=1)[:, :k]
            best_s[who], best_i[who] = np.take_along_axis(s, top, 1), np.take_along_axis(names, top, 1)
            need[who] = np.maximum(need[who], best_s[who, k - 1])
    hit = (best_i < np.iinfo(np.int64).max) & (best_s >= floor[:, None])
    if ((best_s[hit] >= OVER) | (best_s[hit] <= UNDER)).any():
        raise OverflowError("a score among the highest does not fit a long")
    row, col = np.nonzero(hit)
    return list(zip(q_ids[row].tolist(), best_i[row, col].tolist(), best_s[row, col].tolist()))


def _score(batches: Iterator[pa.RecordBatch], k: int, block: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for r in b.to_pylist():
            q, m = _read(r["q"], r["q_width"]), _read(r["m"], r["width"])
            q_ids, ids = np.frombuffer(r["q_ids"], "<i8"), np.frombuffer(r["ids"], "<i8")
            q = q if r["q_width"] else np.zeros((len(q_ids), 0))
            m = m if r["width"] else np.zeros((len(ids), 0))
            floor = np.array(r["floor"], np.int64) if r["floor"] else np.full(len(q_ids), np.iinfo(np.int64).min)
            got = score_page(q, q_ids, floor, ids, m, _read(r["high"], r["width"]), _read(r["low"], r["width"]), k, block)
            if got:
                query, vec, score = map(list, zip(*got))
                yield pa.RecordBatch.from_pydict({"qb": [r["qb"]] * len(got), "query_id": query, "vec_id": vec, "score": score}, pa.schema([(c, pa.int64()) for c in ("qb", "query_id", "vec_id", "score")]))


def top_k(vectors: DataFrame, query_every: int = 50, k: int = K, page_vectors: int = PAGE_VECTORS, block_vectors: int = BLOCK_VECTORS, query_vectors: int = QUERY_VECTORS, scale: int = SCALE) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k highest inner products of each query.

    Queries are the rows whose id is divisible by ``query_every``; candidates all rows but those with the query's own id; ties
    go to the smaller id. Vectors of unequal length are compared as if filled with zeros; rows that repeat an
    id are candidates each, and a query id that repeats is asked over all its rows together. No sound vectors, no rows."""
    whole = durable(integer_vectors(vectors, scale=scale))
    index = durable(pages(whole, page_vectors, block_vectors))
    asked = pages(whole.where(F.col("vec_id") % query_every == 0), query_vectors, query_vectors)
    queries = durable(asked.select(F.col("page").alias("qb"), F.col("width").alias("q_width"), F.col("ids").alias("q_ids"), F.col("m").alias("q")))
    summary = F.struct("page", "width", "most", "least")
    shelves = index.groupBy(F.shiftright("page", SHELF_BITS).alias("shelf")).agg(F.collect_list(summary).alias("summaries"))
    # one number per block of queries; every block is held against every shelf, never against every page
    blocks = queries.groupBy(F.lit(1).alias("all")).agg(F.collect_list("qb").alias("blocks"))
    met = durable(shelves.withColumn("all", F.lit(1))).join(blocks, "all").select("summaries", F.explode("blocks").alias("qb"))

    def scored(pairs: DataFrame) -> DataFrame:
        rows = pairs.join(queries, "qb").join(index, "page").select("qb", "q_width", "q_ids", "q", "width", "ids", "m", "high", "low", "floor")
        return rows.mapInArrow(partial(_score, k=k, block=block_vectors), "qb bigint, query_id bigint, vec_id bigint, score bigint")

    none = F.lit(None).cast("array<bigint>")
    best = met.join(queries.select("qb", "q_width", "q"), "qb").mapInArrow(_seeds, "qb bigint, page bigint, total double")
    seed = best.groupBy("qb").agg(F.max_by("page", F.struct("total", "page")).alias("page")).withColumn("floor", none)
    by_query = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    first = scored(seed).groupBy("qb", "query_id").agg(F.min("score").alias("least"), F.count("*").alias("n"))
    known = first.select("qb", "query_id", F.when(F.col("n") == k, F.col("least")).otherwise(F.lit(-(2**63) + 1)).alias("least"))
    one = durable(known.groupBy("qb").agg(F.map_from_entries(F.collect_list(F.struct("query_id", "least"))).alias("of")))
    names = durable(queries.mapInArrow(_query_ids, "qb bigint, names array<bigint>"))
    floor = F.transform("names", lambda q: F.coalesce(F.element_at("of", q), F.lit(-(2**63) + 1)))
    floors = durable(names.join(one, "qb", "left").select("qb", floor.alias("floor")))
    asked = queries.select("qb", "q_width", "q").join(floors, "qb")
    rest = durable(met.join(asked, "qb").mapInArrow(_open, "qb bigint, page bigint").join(floors, "qb"))
    return (
        scored(rest)
        .withColumn("rank", F.row_number().over(by_query))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def _query_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        names = [np.frombuffer(x, "<i8").tolist() for x in b.column("q_ids").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("qb"), pa.array(names, pa.list_(pa.int64()))], ["qb", "names"])


def op9_block_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s
)
SELECT * FROM r WHERE rank <= 5
"""
