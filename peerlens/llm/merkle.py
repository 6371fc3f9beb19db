"""Merkle manifest of a dataset as a persistent tree that copies paths.

Leaves are numbered by one ranged sort and cut into aligned blocks of 256; each block is one row that holds
its part of the tree. The tops of the blocks are leaves of the next tier, which is built the same way, until one node
is left of each tree; the tops of all trees form one more tree. A changed leaf is a new version: inside its
block only the ancestors of the leaf are copied and all other nodes are shared, then the copy goes on through the
upper tiers along the path of its block. Tiers shrink 256-fold, so only the lowest moves much data."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial
from hashlib import sha256
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from peerlens.llm.common import durable, table

BLOCK_BITS = 8
#: The one tree above all trees.
TOP = "top"


def leaf_digest(values: Sequence[Column]) -> Column:
    """Binary SHA-256 of the values in order: ``-`` for null, else the count of UTF-8 bytes, ``:`` and the value."""
    texts = [v.cast("string") for v in values]
    return F.unhex(F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256))


def join_digests(left: bytes, right: bytes | None) -> bytes:
    """The parent of a run of one or two nodes, whose digests count as hex text."""
    return sha256((left.hex() + (right.hex() if right else "")).encode()).digest()


class PersistentTree:
    """A binary tree whose nodes are only ever added; a version is the number of its root."""

    def __init__(self, leaves: Sequence[bytes], levels: int):
        self.digest: list[bytes] = list(leaves)
        self.children: list[tuple[int, int | None] | None] = [None] * len(leaves)
        self.levels = levels
        row = list(range(len(leaves)))
        for _ in range(levels):
            row = [self._add(row[i], row[i + 1] if i + 1 < len(row) else None) for i in range(0, len(row), 2)]
        self.root = row[0]

    def _add(self, left: int, right: int | None) -> int:
        self.digest.append(join_digests(self.digest[left], None if right is None else self.digest[right]))
        self.children.append((left, right))
        return len(self.digest) - 1

    def _descend(self, root: int, place: int) -> list[tuple[int, int]]:
        """(node, side taken) from the root down to above the leaf."""
        steps, node = [], root
        for level in reversed(range(self.levels)):
            side = place >> level & 1
            steps.append((node, side))
            node = self.children[node][side]
        return steps

    def path(self, root: int, place: int) -> list[str]:
        """Siblings from the leaf upwards: ``R`` or ``L`` and the hex digest, or an empty string where there is none."""
        out = []
        for node, side in reversed(self._descend(root, place)):
            other = self.children[node][1 - side]
            out.append("" if other is None else "RL"[side] + self.digest[other].hex())
        return out

    def change(self, root: int, place: int, digest: bytes) -> int:
        """The root of a version with another leaf: ancestors are copied, everything else is shared."""
        self.digest.append(digest)
        self.children.append(None)
        new = len(self.digest) - 1
        for node, side in reversed(self._descend(root, place)):
            left, right = self.children[node]
            new = self._add(new, right) if side == 0 else self._add(left, new)
        return new


def fold(digest: bytes, path: Sequence[str]) -> bytes:
    """The root that a node and its siblings give."""
    for step in path:
        other = bytes.fromhex(step[1:]) if step else None
        digest = join_digests(other, digest) if step[:1] == "L" else join_digests(digest, other)
    return digest


def levels_of(nodes: int, bits: int) -> int:
    """Levels of a block inside a tree of ``nodes`` nodes: all of them if it is the only block."""
    return min(bits, max(0, nodes - 1).bit_length())


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add the partition and the running number inside (partition, tree); the rows come in order."""
    part, now, at = TaskContext.get().partitionId(), None, 0
    for b in batches:
        numbers = []
        for tree, run in groupby(b.column("tree").to_pylist()):
            at = at if tree == now else 0
            n = sum(1 for _ in run)
            numbers.extend(range(at, at + n))
            now, at = tree, at + n
        cols = [*b.columns, pa.array([part] * b.num_rows, pa.int32()), pa.array(numbers, pa.int64())]
        yield pa.RecordBatch.from_arrays(cols, [*b.schema.names, "part", "inside"])


def numbered(nodes: DataFrame, order: Sequence[str]) -> DataFrame:
    """Add ``pos`` (from 0, by ``order``) and ``n`` (nodes of the tree). One ranged sort deals out all trees at once, so a
    tree with most of the rows lies in many tasks; the counts of (partition, tree) shift the running numbers."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in nodes.schema.fields)
    ranged = nodes.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    base = durable(ranged.mapInArrow(_number, f"{schema}, part int, inside bigint"))
    counts = base.groupBy("part", "tree").agg(F.count("*").alias("c"))
    of_tree = Window.partitionBy("tree")  # a row for each partition the tree reaches into
    before = F.sum("c").over(of_tree.orderBy("part")) - F.col("c")
    shift = counts.select("part", "tree", before.alias("before"), F.sum("c").over(of_tree).alias("n"))
    return base.join(shift, ["part", "tree"]).withColumn("pos", F.col("before") + F.col("inside")).drop("part", "inside", "before")


def _tier(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """The top of every block and the paths of its nodes to it."""
    for b in batches:
        tops, paths = [], []
        for n, held in zip(b.column("n").to_pylist(), b.column("held").to_pylist()):
            tree = PersistentTree([h["digest"] for h in held], levels_of(n, bits))
            tops.append(tree.digest[tree.root])
            paths.append([tree.path(tree.root, i) for i in range(len(held))])
        cols = [b.column("tree"), b.column("block"), b.column("n"), pa.array(tops, pa.binary()), pa.array(paths, pa.list_(pa.list_(pa.string())))]
        yield pa.RecordBatch.from_arrays(cols, ["tree", "block", "n", "top", "paths"])


def in_blocks(nodes: DataFrame, bits: int, *cols: str) -> DataFrame:
    """One row per aligned block: tree, block, n, held (its nodes in order, at most ``2**bits``)."""
    return nodes.groupBy("tree", F.shiftright("pos", bits).alias("block")).agg(
        F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("pos", *cols))).alias("held")
    )


def _blocks(bits: int) -> Column:
    return F.shiftright(F.col("n") + ((1 << bits) - 1), bits)


def climb(nodes: DataFrame, bits: int = BLOCK_BITS) -> DataFrame:
    """(tree, pos, path, top): the path of every node to the top of its tree. ``nodes``: (tree, pos, n, digest), written."""
    most = nodes.agg(F.max("n")).first()[0] or 0
    if most <= 1:
        return nodes.select("tree", "pos", F.array().cast("array<string>").alias("path"), F.col("digest").alias("top"))
    built = durable(in_blocks(nodes, bits, "digest").mapInArrow(partial(_tier, bits=bits), "tree string, block bigint, n bigint, top binary, paths array<array<string>>"))
    upper = climb(built.select("tree", F.col("block").alias("pos"), _blocks(bits).alias("n"), F.col("top").alias("digest")), bits)
    upper = upper.select("tree", F.col("pos").alias("block"), F.col("path").alias("rest"), F.col("top"))
    own = built.select("tree", "block", F.posexplode("paths").alias("i", "path"))
    return durable(own.join(upper, ["tree", "block"]).select(
        "tree", (F.shiftleft("block", bits) + F.col("i")).alias("pos"), F.concat("path", "rest").alias("path"), "top"
    ))


def _plant(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """The top of every block of leaves."""
    for b in batches:
        tops = []
        for n, held in zip(b.column("n").to_pylist(), b.column("held").to_pylist()):
            tree = PersistentTree([h["leaf"] for h in held], levels_of(n, bits))
            tops.append(tree.digest[tree.root])
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(tops, pa.binary())], [*b.schema.names, "digest"])


def _proofs(batches: Iterator[pa.RecordBatch], id_type: pa.DataType, bits: int) -> Iterator[pa.RecordBatch]:
    """Per leaf its siblings up to the root, and the root of its version."""
    names = ["id", "leaf", "changed", "subroot", "root", "proof", "folded"]
    kinds = [id_type, pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.string()), pa.binary()]
    for b in batches:
        for row in b.to_pylist():
            held, rest = row["held"], row["path"]
            tree = PersistentTree([h["leaf"] for h in held], levels_of(row["n"], bits))
            out = []
            for i, h in enumerate(held):
                path = tree.path(tree.root, i)
                if h["changed"] is None:
                    folded = fold(fold(h["leaf"], path), rest)
                else:
                    folded = fold(tree.digest[tree.change(tree.root, i, h["changed"])], rest)
                out.append((h["id"], h["leaf"], h["changed"], row["subroot"], row["root"], path + rest, folded))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)


def manifest(docs: DataFrame, id_col: str, tree_col: str, columns: Sequence[str], changed: dict[str, Column], where: Column, bits: int = BLOCK_BITS) -> DataFrame:
    """One row per row of ``docs``: id, leaf, changed, subroot, root, proof, folded (digests as binary).

    Leaves digest ``columns``; trees go by ``tree_col`` (null first, then bytewise), leaves in a tree by id (null
    first), then digest. Where ``where`` holds, the leaf is also digested with the columns of ``changed`` put in
    place: ``changed`` is that leaf and ``folded`` the root of the version that has it instead of its own; elsewhere
    ``folded`` comes from the row's own leaf. ``proof`` lists the siblings from the leaf to the root, as in
    ``PersistentTree.path``. Repeated rows are leaves of their own, in any order, as they are alike; other columns are
    ignored. A tree of one leaf is that leaf. An empty table gives no rows."""
    kind = docs.schema[id_col].dataType.simpleString()
    leaves = durable(docs.select(
        F.coalesce(F.concat(F.lit("1"), F.col(tree_col).cast("string")), F.lit("0")).alias("tree"),
        F.col(id_col).alias("id"),
        leaf_digest([F.col(c) for c in columns]).alias("leaf"),
        F.when(where, leaf_digest([changed.get(c, F.col(c)) for c in columns])).alias("changed"),
        F.monotonically_increasing_id().alias("row"),
    ))
    held = f"array<struct<pos: bigint, id: {kind}, leaf: binary, changed: binary>>"
    blocks = in_blocks(numbered(leaves, ["id", "leaf", "row"]), bits, "id", "leaf", "changed")
    blocks = durable(blocks.mapInArrow(partial(_plant, bits=bits), f"tree string, block bigint, n bigint, held {held}, digest binary"))
    paths = climb(blocks.select("tree", F.col("block").alias("pos"), _blocks(bits).alias("n"), "digest"), bits)
    subroots = paths.where("pos = 0").select(F.lit(TOP).alias("tree"), F.col("tree").alias("of"), F.col("top").alias("digest"))
    placed = durable(numbered(subroots, ["of"]))
    tops = climb(placed.select("tree", "pos", "n", "digest"), bits).drop("tree").withColumnsRenamed({"path": "last", "top": "root"})
    tops = placed.select("pos", "of", F.col("digest").alias("subroot")).join(tops, "pos").select(F.col("of").alias("tree"), "subroot", "last", "root")
    upper = durable(paths.join(tops, "tree").select("tree", F.col("pos").alias("block"), F.concat("path", "last").alias("path"), "subroot", "root"))
    given = blocks.select("tree", "block", "n", "held").join(upper, ["tree", "block"]).select("n", "held", "path", "subroot", "root")
    id_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    return given.mapInArrow(partial(_proofs, id_type=id_type, bits=bits), f"id {kind}, leaf binary, changed binary, subroot binary, root binary, proof array<string>, folded binary")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    more = {"n_chars": F.col("n_chars").cast("decimal(20,0)") + 1}
    made = manifest(docs, "doc_id", "lang", ["doc_id", "source", "lang", "n_chars", "text"], more, F.coalesce(tampered, F.lit(False)))
    hexed = {c: F.lower(F.hex(c)) for c in ("leaf", "subroot", "root", "folded")}
    return made.select(
        F.col("id").alias("doc_id"), hexed["leaf"].alias("leaf"), hexed["subroot"].alias("subroot"), hexed["root"].alias("root"),
        F.sha2(F.concat_ws("", F.transform("proof", lambda s: F.substring(s, 2, 64))), 256).alias("proof_sha256"),
        hexed["folded"].alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"),
    )


#: CRC-32 by its rule: a table of 256 remainders, then one step for each byte of an ASCII text.
CRC_TABLE = """crc_table AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda a, x: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) AS c
    FROM range(256) r(i)))"""


def crc_sql(text: str) -> str:
    """SQL for the unsigned CRC-32 of an ASCII text; the row must also hold ``t`` of ``crc_table``."""
    codes = f"list_transform(range(1, length({text}) + 1), lambda k: CAST(ascii(substr({text}, k, 1)) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295, {codes}), lambda a, b: xor(a // 256, t[(xor(a, b) & 255) + 1])), 4294967295)"


def _value(c: str) -> str:
    return f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"


def _leaf(n_chars: str) -> str:
    return f"sha256({' || '.join(_value(c) for c in ('doc_id', 'source', 'lang', n_chars, 'text'))})"


SQL = f"""
WITH RECURSIVE {CRC_TABLE}, hashed AS (
  SELECT doc_id, CASE WHEN lang IS NULL THEN '0' ELSE '1' || lang END AS tree, {_leaf('n_chars')} AS leaf,
         CASE WHEN {crc_sql('CAST(doc_id AS VARCHAR)')} % 7 = 0 THEN {_leaf('n_chars + 1')} END AS changed
  FROM documents, crc_table
), leaves AS (
  SELECT *, row_number() OVER () AS id, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
         count(*) OVER (PARTITION BY tree) AS n
  FROM hashed
), low AS (
  SELECT tree, 0 AS lvl, pos, n, leaf AS h FROM leaves
  UNION ALL
  SELECT tree, lvl + 1, pos // 2, (max(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM low WHERE n > 1 GROUP BY tree, lvl, pos // 2
), subroots AS (
  SELECT tree, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM low WHERE n = 1
), high AS (
  SELECT 0 AS lvl, pos, n, subroot AS h FROM subroots
  UNION ALL
  SELECT lvl + 1, pos // 2, (max(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM high WHERE n > 1 GROUP BY lvl, pos // 2
), steps AS (
  SELECT l.id, a.lvl AS step, b.h AS sibling, b.pos < a.pos AS is_left
  FROM leaves l JOIN low a ON a.tree = l.tree AND a.n > 1 AND a.pos = l.pos // CAST(pow(2, a.lvl) AS BIGINT)
  LEFT JOIN low b ON b.tree = a.tree AND b.lvl = a.lvl AND b.pos = xor(a.pos, 1)
  UNION ALL
  SELECT l.id, 1000 + a.lvl, b.h, b.pos < a.pos
  FROM leaves l JOIN subroots s ON s.tree = l.tree JOIN high a ON a.n > 1 AND a.pos = s.pos // CAST(pow(2, a.lvl) AS BIGINT)
  LEFT JOIN high b ON b.lvl = a.lvl AND b.pos = xor(a.pos, 1)
), proofs AS (
  SELECT id, string_agg(coalesce(sibling, ''), '' ORDER BY step) AS proof,
         list({{'s': coalesce(sibling, ''), 'l': coalesce(is_left, FALSE)}} ORDER BY step) AS path
  FROM steps GROUP BY id
), walk AS (
  SELECT id, 1 AS nth, path, coalesce(changed, leaf) AS h FROM leaves LEFT JOIN proofs USING (id)
  UNION ALL
  SELECT id, nth + 1, path, sha256(CASE WHEN path[nth].l THEN path[nth].s || h ELSE h || path[nth].s END) FROM walk WHERE nth <= len(path)
)
SELECT l.doc_id, l.leaf, s.subroot, r.h AS root, sha256(coalesce(p.proof, '')) AS proof_sha256, w.h AS folded_root, w.h = r.h AS verified
FROM leaves l JOIN subroots s USING (tree) LEFT JOIN proofs p USING (id)
JOIN walk w ON w.id = l.id AND w.nth = coalesce(len(w.path), 0) + 1
JOIN high r ON r.n = 1
"""
