"""Language identification by language-bitmask n-gram filters.

One Bloom filter per language, bit-sliced: slot s of the table is a word whose bit l belongs to the filter of
language l, so one lookup and an AND over the hash slots return every language that has an n-gram. A text is
decided by the number of its n-grams in each language's filter, corrected for false positives: a filter of fill f and
h hashes takes in a foreign n-gram with probability f**h, so of n n-grams with c hits, (c - n f**h) / (1 - f**h) are true.

The filters are fitted on a documented bounded sample: about ``FIT_ROWS`` labelled rows of each language, chosen by a hash of
their id. An n-gram enters the filter of a language if it is among its ``GRAMS`` most frequent and its share
there is at least ``SHARE`` of its largest share in any language."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from peerlens.llm.common import durable, table

GRAM = 3
HASHES = 2
SLOT_BITS = 18
FIT_ROWS = 4000
GRAMS = 8000
SHARE = 0.25
UNKNOWN = "und"
WORD = 64
MAX_LANGS = 4096
CHARS_AT_ONCE = 1 << 20
#: Odd multipliers of the hash, one to mix an n-gram and one for each slot.
MIX = np.uint64(0x9E3779B97F4A7C15)
SLOT_MULTIPLIERS = (0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)


@lru_cache(1)
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def cuts(text: str) -> Iterator[tuple[str, int, int]]:
    """(cut, letters before it, letters after it): a text beyond ``CHARS_AT_ONCE`` in cuts that reach over their ends by half
    an n-gram, so that each n-gram is whole in the cut that holds its middle."""
    side = GRAM // 2
    for k in range(0, len(text), CHARS_AT_ONCE):
        left, right = min(side, k), min(side, max(0, len(text) - k - CHARS_AT_ONCE))
        yield text[k - left : k + CHARS_AT_ONCE + right], left, right


def grams(texts: list[str | None], around: list[tuple[int, int]] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of n-grams with a letter in the middle, the text each is from, whether each text has a letter).

    Texts are lower-cased; what is no letter counts as a blank. Texts are joined with blanks between, so no
    n-gram spans two of them. ``around`` names characters at both ends of each text that are no middles."""
    joined = (" " * GRAM).join((t or "").lower() for t in texts)
    codes = np.frombuffer((" " + joined + " " * GRAM).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[codes]
    codes = np.where(letter, codes, np.uint32(32)).astype(np.uint64)
    sizes = np.array([len((t or "").lower()) for t in texts], np.int64) + GRAM
    owner = np.repeat(np.arange(len(texts)), sizes)
    h = np.zeros(len(codes) - GRAM + 1, np.uint64)
    for i in range(GRAM):
        h = (h ^ codes[i : i + len(h)]) * MIX
        h ^= h >> np.uint64(29)
    middle = letter[GRAM // 2 : GRAM // 2 + len(h)]
    # The n-gram at place p has its middle at p + GRAM // 2, which is place p + GRAM // 2 - 1 of the joined texts.
    places = np.flatnonzero(middle)
    if around is not None:
        at, starts = places + GRAM // 2 - 1, np.cumsum(sizes) - sizes
        own = owner[at]
        left, right = (np.array([x[side] for x in around], np.int64) for side in (0, 1))
        places = places[(at - starts[own] >= left[own]) & (at - starts[own] < sizes[own] - GRAM - right[own])]
    of = owner[places + GRAM // 2 - 1]
    has = np.zeros(len(texts), bool)
    has[of] = True
    return h[places], of, has


def _lots(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    start, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t or "") + GRAM
        if held >= CHARS_AT_ONCE:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        langs = np.array(b.column("lang").to_pylist(), object)
        texts = b.column("text").to_pylist()
        for lang in np.unique(langs):
            mine = [texts[i] for i in np.flatnonzero(langs == lang)]
            for a, z in _lots(mine):
                h, n = np.unique(grams(mine[a:z])[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(h), pa.string()), pa.array(h.view(np.int64)), pa.array(n, pa.int64())], ["lang", "gram", "n"])


def per_language(counted: DataFrame) -> dict[str, int]:
    """{language: n} from (lang, n) rows; more than ``MAX_LANGS`` languages are an error, not a cut."""
    got = {r["lang"]: r["n"] for r in counted.select("lang", "n").limit(MAX_LANGS + 1).collect()}
    if len(got) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    return got


def _of_language(values: dict[str, float]):
    """A column: the value of the row's language."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), F.col("lang"))


def fit_rows(labelled: DataFrame, per: dict[str, int], rows: int = FIT_ROWS) -> DataFrame:
    """(lang, text): about ``rows`` labelled rows of each language, all if it has fewer, by a hash of doc_id."""
    place = F.pmod(F.xxhash64(F.lit("lang"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    return labelled.where(place < _of_language({k: rows / n for k, n in per.items()})).select("lang", "text")


class Filters:
    """The bit-sliced table, the fill of each language's filter and the languages; built from (language, hashes) pairs."""

    def __init__(self, by_lang: dict[str, np.ndarray], prior: str | None, slot_bits: int = SLOT_BITS, hashes: int = HASHES):
        self.langs = sorted(by_lang)
        self.prior = prior
        self.slot_bits, self.hashes = slot_bits, hashes
        words = max(1, -(-len(self.langs) // WORD))
        self.table = np.zeros((words, 1 << slot_bits), np.uint64)
        for i, lang in enumerate(self.langs):
            for s in self._slots(by_lang[lang]):
                self.table[i // WORD][s] |= np.uint64(1 << (i % WORD))
        fill = np.array([((self.table[i // WORD] >> np.uint64(i % WORD)) & np.uint64(1)).mean() for i in range(len(self.langs))])
        self.false = fill**hashes

    def _slots(self, h: np.ndarray) -> list[np.ndarray]:
        return [(h * np.uint64(m)) >> np.uint64(64 - self.slot_bits) for m in SLOT_MULTIPLIERS[: self.hashes]]

    def masks(self, h: np.ndarray) -> np.ndarray:
        """For every n-gram the languages that contain it, as words of bits: one AND over its slots."""
        slots = self._slots(h)
        out = self.table[:, slots[0]]
        for s in slots[1:]:
            out &= self.table[:, s]
        return out

    def decide(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """(language, score) of each text. A very long text is read in cuts; the result is that of the whole."""
        parts = [(i, cut, (left, right)) for i, t in enumerate(texts) for cut, left, right in cuts((t or "").lower())]
        n, has = np.zeros(len(texts)), np.zeros(len(texts), bool)
        hits = np.zeros((len(texts), max(1, len(self.langs))))
        for a, z in _lots([t for _, t, _ in parts]):
            rows = np.array([i for i, _, _ in parts[a:z]])
            h, of, some = grams([t for _, t, _ in parts[a:z]], [ends for _, _, ends in parts[a:z]])
            has[rows[some]] = True
            n += np.bincount(rows[of], minlength=len(texts))
            masks = self.masks(h)
            for i in range(len(self.langs)):
                hit = (masks[i // WORD] >> np.uint64(i % WORD)) & np.uint64(1)
                hits[:, i] += np.bincount(rows[of], weights=hit, minlength=len(texts))
        false = np.minimum(self.false, 0.999)
        got = np.maximum(0, (hits[:, : len(self.langs)] - np.outer(n, false)) / (1 - false)) if self.langs else hits
        best, whole = got.argmax(1), got.sum(1)
        lang, score = [], []
        for i in range(len(texts)):
            if not has[i] or not self.langs:
                lang.append(UNKNOWN)
                score.append(0.0)
            elif whole[i] <= 0:
                lang.append(self.prior or UNKNOWN)
                score.append(0.0)
            else:
                lang.append(self.langs[best[i]])
                score.append(float(min(1.0, got[i, best[i]] / whole[i])))
        return lang, score


def fit(docs: DataFrame, train, rows: int = FIT_ROWS, top: int = GRAMS, share: float = SHARE) -> Filters:
    """Count n-grams of the sample by language, choose those of each language and build the filters.

    What reaches the driver is bounded by the number of languages times ``top``."""
    labelled = docs.select("doc_id", "lang", "text").where(train & F.col("lang").isNotNull())
    per = per_language(labelled.groupBy("lang").agg(F.count("*").alias("n")))
    if not per:
        return Filters({}, None)
    sample = fit_rows(labelled, per, rows)
    counts = durable(sample.mapInArrow(_count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    totals = per_language(counts.groupBy("lang").agg(F.sum("n").alias("n")))
    if not totals:
        return Filters({}, None)
    shares = counts.withColumn("share", F.col("n") / _of_language(totals))
    most = F.max("share").over(Window.partitionBy("gram"))
    own = shares.withColumn("most", most).where(F.col("share") >= share * F.col("most"))
    ranked = own.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("rank") <= top)
    chosen = ranked.select("lang", "gram").toPandas()
    by_lang = {str(lang): g["gram"].to_numpy(np.int64).view(np.uint64) for lang, g in chosen.groupby("lang")}
    return Filters(by_lang, min(totals, key=lambda k: (-per[k], k)))


def _predict(batches: Iterator[pa.RecordBatch], filters: Filters) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column(1).to_pylist()
        lang, score = [], []
        for a, z in _lots(texts):
            got = filters.decide(texts[a:z])
            lang += got[0]
            score += got[1]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])


def predict(docs: DataFrame, filters: Filters) -> DataFrame:
    """doc_id, lang_pred, score of every row, whole texts, in one pass without a shuffle.

    ``und`` with score 0 if the text is null, has no letter, or no language was learned; if no n-gram is known,
    the most frequent language with score 0. Other columns are ignored."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(partial(_predict, filters=filters), f"doc_id {kind}, lang_pred string, score double")


def op10_language_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    filters = fit(docs, ~held_out)
    return predict(docs, filters).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
