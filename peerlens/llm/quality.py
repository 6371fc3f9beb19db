"""Document quality by random-indexing word vectors and a small network.

Every token has a sparse random index vector, drawn by a hash of it. A token's context vector is the sum of the index
vectors of its neighbours over the whole corpus: one pass over all documents, summed by token with map-side partials. Tokens
are hashed into ``VOCAB`` codes, so the vectors are a matrix of fixed size. A document is the mean and the spread of
its tokens' vectors (context vector beside index vector). A two-layer numpy network is trained on the pooled vectors of a
documented bounded sample of labelled rows; a part of that sample is held back to fit the temperature that calibrates
its probabilities.

Tokens: a blank-separated piece is cut into runs of letters and digits and runs of other characters; letters are lower-cased, and a piece of
capitals gives a token for that; a token that comes again at once or after one other gives, when pooled, a token for that. Labels, language, source and id are no inputs."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from peerlens.llm.common import durable, free_name, quoted, table
from peerlens.llm.tokens import in_lots

VOCAB = 8192
DIM = 32
NONZERO = 2
WINDOW = 2
HIDDEN = 32
FIT_ROWS = 12_000
CALIBRATION = 0.2
THRESHOLD = 0.7
MEMO_PIECES = 400_000
_RUNS = re.compile(r"[^\W_]+|[\W_]+")


def _code(token: str) -> int:
    """Codes from 1; code 0 stands between documents."""
    return 1 + xxhash.xxh32_intdigest(token) % (VOCAB - 1)


def piece_codes(piece: str) -> list[int]:
    runs = _RUNS.findall(piece)
    codes = [_code(r.lower()) for r in runs]
    if len(piece) > 1 and piece.isupper():
        codes.append(_code("^capitals"))
    return codes


class Coder:
    """Codes of texts, packed as 16-bit integers, with a memo of pieces."""

    def __init__(self):
        self.memo: dict[str, bytes] = {"": b""}

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        if len(self.memo) > MEMO_PIECES:
            self.memo = {"": b""}
        split = [(t or "").replace("\n", " ").replace("\t", " ").split(" ") for t in texts]
        new: set[str] = set()
        for s in split:
            new.update(s)
        for p in new.difference(self.memo):
            self.memo[p] = np.array(piece_codes(p), np.uint16).tobytes()
        get = self.memo.__getitem__
        return [np.frombuffer(b"".join(map(get, s)), np.uint16) for s in split]


@lru_cache(1)
def coder() -> Coder:
    """One per worker process."""
    return Coder()


@lru_cache(1)
def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Place and sign of the nonzero entries of every code's index vector; code 0 has none."""
    rng = np.random.default_rng(7)
    place = np.argsort(rng.random((VOCAB, DIM)), axis=1)[:, :NONZERO]
    sign = rng.choice(np.array([-1.0, 1.0]), (VOCAB, NONZERO))
    sign[0] = 0
    return place, sign


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    place, sign = index_vectors()
    total = np.zeros(VOCAB * DIM)
    gap = np.zeros(WINDOW, np.uint16)
    for b in batches:
        texts = b.column("text").to_pylist()
        for a, z in in_lots(texts):
            codes = np.concatenate([x for c in coder().encode(texts[a:z]) for x in (c, gap)]).astype(np.int64)
            for start in range(0, len(codes), 1 << 20):
                part = codes[max(0, start - WINDOW) : start + (1 << 20)]
                skip = min(start, WINDOW)
                for off in range(1, WINDOW + 1):
                    # Pairs whose later token lies in this part: those before it were counted with the part before.
                    one, two = part[max(0, skip - off) : len(part) - off], part[max(skip, off) :]
                    for x, y in ((one, two), (two, one)):
                        for j in range(NONZERO):
                            total += np.bincount(x * DIM + place[y, j], weights=sign[y, j], minlength=len(total))
    m = total.reshape(VOCAB, DIM)
    m[0] = 0
    seen = np.flatnonzero(np.abs(m).sum(1))
    yield pa.RecordBatch.from_arrays([pa.array(seen), *[pa.array(m[seen, d]) for d in range(DIM)]], ["code", *[f"d{d}" for d in range(DIM)]])


def _index_matrix() -> np.ndarray:
    place, sign = index_vectors()
    r = np.zeros((VOCAB, DIM))
    np.put_along_axis(r, place, sign, 1)
    return r


def word_vectors(docs: DataFrame) -> np.ndarray:
    """VOCAB x 2 DIM: unit context vectors beside index vectors, from all rows of ``docs``.

    Each task sums its part into a matrix and sends at most VOCAB rows; the sums that reach the driver are VOCAB rows. Sums are of whole numbers, so
    they do not depend on the order in which they come."""
    columns = [f"d{d}" for d in range(DIM)]
    parts = docs.select("text").mapInArrow(_contexts, "code bigint, " + ", ".join(f"{c} double" for c in columns))
    sums = parts.groupBy("code").agg(*[F.sum(c).alias(c) for c in columns]).toPandas()
    m = np.zeros((VOCAB, DIM))
    m[sums["code"].to_numpy()] = sums[columns].to_numpy(float)
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    vectors = np.concatenate((np.divide(m, norm, out=np.zeros_like(m), where=norm > 0), _index_matrix()), axis=1)
    vectors[0] = 0
    return vectors.astype(np.float32)


def _pool_codes(codes: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Mean and spread of the vectors of the codes; zeros without codes."""
    if not len(codes):
        return np.zeros(2 * vectors.shape[1], np.float32)
    again = int((codes[1:] == codes[:-1]).sum()) + int((codes[2:] == codes[:-2]).sum())
    codes = np.concatenate((codes, np.full(again, _code("^again"), np.uint16)))
    if len(codes) > 512:
        n = np.bincount(codes, minlength=len(vectors))
        used = np.flatnonzero(n)
        w, v = n[used].astype(np.float32) / len(codes), vectors[used]
        mean, square = w @ v, w @ (v * v)
    else:
        v = vectors[codes]
        mean, square = v.mean(0), (v * v).mean(0)
    return np.concatenate((mean, np.sqrt(np.maximum(square - mean * mean, 0))))


def pooled(texts: list[str | None], vectors: np.ndarray) -> np.ndarray:
    """The pooled vector of each whole text."""
    rows = [_pool_codes(c, vectors) for c in coder().encode(texts)]
    return np.array(rows, np.float32).reshape(len(texts), 2 * vectors.shape[1])


def _snippet(codes: np.ndarray, name: object) -> np.ndarray:
    """A short run of the codes, placed by a hash of ``name``."""
    h = xxhash.xxh64_intdigest(f"snippet {name}")
    size = 4 + h % 29
    start = (h >> 8) % max(1, len(codes) - size)
    return codes[start : start + size]


def _pool(batches: Iterator[pa.RecordBatch], vectors: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Training rows: every document, and a short run of each good one, so that good short texts are known too."""
    for b in batches:
        texts, names, marks = (b.column(c).to_pylist() for c in ("text", "doc_id", "quality"))
        for a, z in in_lots(texts):
            ids, quality, x = [], [], []
            for name, mark, codes in zip(names[a:z], marks[a:z], coder().encode(texts[a:z])):
                for part in (codes, _snippet(codes, name)) if mark > 0 else (codes,):
                    ids.append(name)
                    quality.append(mark)
                    x.append(_pool_codes(part, vectors))
            kind = b.schema.field("doc_id").type
            yield pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(quality, pa.float64()), pa.array(x, pa.list_(pa.float32()))], ["doc_id", "quality", "x"])


@dataclass
class Network:
    """Two layers; probabilities are sigmoid(logit / temperature)."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        h = np.maximum(((x - self.mean) / self.scale) @ self.w1 + self.b1, 0)
        return h @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def train(x: np.ndarray, y: np.ndarray, held: np.ndarray, epochs: int = 40, batch: int = 256, rate: float = 3e-3, decay: float = 1e-4) -> Network:
    """Adam on the log loss of the rows not ``held``; the temperature minimises the log loss of those held.

    Without rows the network is constant at one half; with one class only it is close to that class."""
    rng = np.random.default_rng(11)
    x = x.astype(float)
    fit = ~held if (~held).any() else np.ones(len(y), bool)
    width = x.shape[1]
    mean = x[fit].mean(0) if len(y) else np.zeros(width)
    scale = x[fit].std(0) + 1e-3 if len(y) else np.ones(width)
    net = Network(mean, scale, rng.normal(0, np.sqrt(2 / width), (width, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), 0.0)
    if not len(y):
        return net
    net.w2 = rng.normal(0, np.sqrt(1 / HIDDEN), HIDDEN)
    z, t = (x[fit] - mean) / scale, y[fit].astype(float)
    params = [net.w1, net.b1, net.w2, np.zeros(1)]
    m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for epoch in range(epochs):
        order = rng.permutation(len(t))
        lr = rate * (1 - epoch / epochs)
        for s in range(0, len(t), batch):
            at = order[s : s + batch]
            zb = z[at]
            pre = zb @ params[0] + params[1]
            h = np.maximum(pre, 0)
            p = 1 / (1 + np.exp(-np.clip(h @ params[2] + params[3], -40, 40)))
            d = (p - t[at]) / len(at)
            dh = np.outer(d, params[2]) * (pre > 0)
            grads = [zb.T @ dh + decay * params[0], dh.sum(0), h.T @ d + decay * params[2], np.array([d.sum()])]
            step += 1
            for i, g in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                params[i] -= lr * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    net.b2 = float(params[3][0])
    check = held if held.any() else fit
    logit, truth = net.logits(x[check]), y[check].astype(float)
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 80))
    loss = [np.mean(np.logaddexp(0, logit / g) - truth * logit / g) for g in grid]
    net.temperature = float(grid[int(np.argmin(loss))])
    return net


def _training_ids(docs: DataFrame, labels: DataFrame, learn: Column, rows: int) -> DataFrame:
    """(doc_id, quality) of about ``rows`` labelled documents, all if there are fewer, by a hash of doc_id."""
    named = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & learn).groupBy("doc_id").agg(F.max("quality").cast("double").alias("quality"))
    n = named.count()
    return named.where(F.pmod(F.xxhash64(F.lit("fit"), "doc_id"), F.lit(1 << 30)) < F.lit(int((1 << 30) * min(1.0, rows / max(1, n)))))


def fit(docs: DataFrame, labels: DataFrame, learn: Column, rows: int = FIT_ROWS) -> tuple[np.ndarray, Network]:
    """Word vectors from all documents and a network from about ``rows`` labelled ones.

    ``learn`` is a condition on doc_id. What reaches the driver is the vectors and the pooled sample, both bounded by parameters."""
    vectors = word_vectors(docs)
    ids = durable(_training_ids(docs, labels, learn, rows))
    # The sample is bounded by ``rows``, so its ids may be broadcast; texts of other rows are not moved.
    sample = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    kind = docs.schema["doc_id"].dataType.simpleString()
    got = durable(sample.mapInArrow(partial(_pool, vectors=vectors), f"doc_id {kind}, quality double, x array<float>")).toPandas().sort_values("doc_id", kind="stable")
    x = np.array(got["x"].to_list(), np.float32).reshape(len(got), 2 * vectors.shape[1])
    held = np.array([xxhash.xxh32_intdigest(f"held {d}") % 1000 < 1000 * CALIBRATION for d in got["doc_id"]], bool)
    return vectors, train(x, got["quality"].to_numpy() > 0, held)


def _score(batches: Iterator[pa.RecordBatch], vectors: np.ndarray, net: Network, out: str) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column("text").to_pylist()
        for a, z in in_lots(texts):
            rest = b.slice(a, z - a)
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(net.scores(pooled(texts[a:z], vectors)), pa.float64())], [*rest.schema.names, out])


def scored(docs: DataFrame, vectors: np.ndarray, net: Network, out: str) -> DataFrame:
    """All columns of ``docs`` (one of them ``text``) and ``out``, 0 to 1; a null text counts as empty. One pass, no shuffle."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    plain = ["text" if c == "text" else f"c{i}" for i, c in enumerate(docs.columns)]
    fields = [StructField(n, f.dataType, True) for n, f in zip(plain, docs.schema.fields)]
    schema = StructType([*fields, StructField("score", DoubleType())])
    return docs.toDF(*plain).mapInArrow(partial(_score, vectors=vectors, net=net, out="score"), schema).toDF(*docs.columns, out)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def quality_scores(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted of every row.

    Labels of held-out ids are not learned from. Repeated rows stay; empty texts have the score of the zero vector; other columns are ignored. Without
    labels every score is one half."""
    vectors, net = fit(docs, labels, ~held_out(F.col("doc_id")), rows)
    return scored(docs.select("doc_id", "text"), vectors, net, "score").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts (score of ``THRESHOLD`` or more), with all their columns."""
    vectors, net = fit(docs, labels, ~held_out(F.col("doc_id")), rows)
    score = free_name(docs, "score")
    return scored(docs, vectors, net, score).where(quoted(score) >= THRESHOLD).select(*map(quoted, docs.columns))


def op7_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
