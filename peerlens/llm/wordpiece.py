"""Token counts by greedy longest match, in one pass over each word and without building pieces.

The vocabulary is a trie. Every node has a failure link and the number of tokens popped on the way along it: if no
edge goes on from a node, the tokens that greedy longest match would emit for the longest settled part of what was
read are known by their number alone, and matching goes on from the node of the rest. Both are computed once per
vocabulary (its size bounds them). The vocabulary is that of a SentencePiece model file: a word starts with
its word mark; a character that no piece has counts as its UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache, partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peerlens.llm.common import raw_bytes, table

WORD_MARK = "▁"
MEMO_WORDS = 400_000


class Automaton:
    """Counts of greedy longest-match tokens. ``pieces``: the vocabulary."""

    def __init__(self, pieces: Iterable[str]):
        weight = {p: 1 for p in pieces if p}
        for c in {c for p in weight for c in p}:
            weight.setdefault(c, len(c.encode()))
        self.edges: list[dict[str, int]] = [{}]
        ends = {}
        for p, w in weight.items():
            node = 0
            for c in p:
                if c not in self.edges[node]:
                    self.edges[node][c] = len(self.edges)
                    self.edges.append({})
                node = self.edges[node][c]
            ends[node] = w
        # By breadth: a node that ends a token pops it and goes back to the root; another one goes where its parent's
        # failure leads on its character, popping what lies on that way.
        self.fail, self.popped = [0] * len(self.edges), [0] * len(self.edges)
        queue = [(0, c, v) for c, v in self.edges[0].items()]
        for parent, c, v in queue:
            if v in ends:
                self.fail[v], self.popped[v] = 0, ends[v]
            else:
                at, n = self.fail[parent], self.popped[parent]
                while c not in self.edges[at]:
                    n += self.popped[at]
                    at = self.fail[at]
                self.fail[v], self.popped[v] = self.edges[at][c], n
            queue += [(v, d, w) for d, w in self.edges[v].items()]
        self.memo: dict[bytes, int] = {}

    def count(self, word: str) -> int:
        edges, fail, popped = self.edges, self.fail, self.popped
        node, n = 0, 0
        for c in word:
            while (to := edges[node].get(c)) is None and node:
                n += popped[node]
                node = fail[node]
            if to is None:
                n += len(c.encode())
            else:
                node = to
        while node:
            n += popped[node]
            node = fail[node]
        return n

    def count_words(self, words: list[bytes]) -> int:
        memo = self.memo
        if len(memo) > MEMO_WORDS:
            memo.clear()
        for w in set(words).difference(memo):
            memo[w] = self.count(WORD_MARK + w.decode())
        return sum(map(memo.__getitem__, words))


@lru_cache(2)
def automaton(path: str) -> Automaton:
    """One per worker process and model file."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    special = {i for i in range(model.get_piece_size()) if model.is_control(i) or model.is_unknown(i) or model.is_byte(i)}
    return Automaton(model.id_to_piece(i) for i in range(model.get_piece_size()) if i not in special)


def _count(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    auto = automaton(path)
    for b in batches:
        n_words, n_tokens = [], []
        for t in raw_bytes(b.column(1)):
            words = (t or b"").split()
            n_words.append(len(words))
            n_tokens.append(sum(auto.count_words(words[i : i + 100_000]) for i in range(0, len(words), 100_000)))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())], ["doc_id", "n_words", "n_tokens"])


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words (runs of ``[^\\x20\\x09-\\x0D]``), n_tokens of every row, in one pass without a shuffle.

    Null and empty texts have none; repeated rows stay; other columns are ignored."""
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(partial(_count, path=path), f"doc_id {kind}, n_words bigint, n_tokens bigint")


def op5_wordpiece_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
