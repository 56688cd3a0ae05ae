"""Merkle manifest of a dataset: 8-ary hash trees per language in van Emde Boas blocks.

A leaf is the SHA-256 of a row's fields; the leaves of a language, ascending by doc_id, form a
tree in which every run of eight nodes becomes the hash of their hex digests. The roots of the
languages (null first, then by bytes) form one more tree, whose root names the whole dataset.

A tree is cut into aligned blocks of ``height`` levels of runs, 8**height leaves each. A block
stores its digests in van Emde Boas order: the nodes of its upper half of levels first, laid out
in the same way, then each subtree hanging below, one after the other. So every stretch of a path
lies close together, whatever the size of a cache line or page. Addresses are arithmetic
(``addresses``), there are no pointers; building a block and finding siblings both go by them.

1. Rows become leaves as column expressions; texts do not move. Leaves are range-sorted
   and numbered (``positions``), a large language over many partitions.
2. Each task builds whole blocks. The roots of the blocks of a tree with several are the leaves
   of its next round, until every tree has one block: log(rows) / log(8**height) rounds.
3. From the top down, each block gets the siblings above its root and hands them, with its own, to
   the blocks or rows below. A row moves twice, as digests.

A path is a list of (before, after): the hex digests of a run left and right of the node on the
way, from the leaf upwards.

Defined cases: a null field is ``-``. Rows without an id come before all others; rows with the
same id ascend by their leaf; equal rows are equal leaves, each with a place and a path of its
own. Empty texts are ``0:``. An empty table has no rows and no root. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordermill.llm.positions import positions
from ordermill.llm.words import lower_ascii
from ordermill.session import scratch_path

ARITY = 8
HEIGHT = 4
_WIDTH = 32


def nodes_in(levels: int) -> int:
    return (ARITY**levels - 1) // (ARITY - 1)


@lru_cache
def addresses(levels: int) -> list[np.ndarray]:
    """For each depth, root first, the place of every node in the layout of a tree of so many
    levels: the upper half of the levels, then the subtrees below them."""
    if levels == 1:
        return [np.zeros(1, np.int64)]
    upper = levels // 2
    begins = nodes_in(upper) + np.arange(ARITY**upper) * nodes_in(levels - upper)
    return addresses(upper) + [
        (begins[:, None] + inner).ravel() for inner in addresses(levels - upper)
    ]


def levels_for(leaves: int) -> int:
    """Levels of the lowest tree that holds so many leaves."""
    levels = 1
    while ARITY ** (levels - 1) < leaves:
        levels += 1
    return levels


def widths(leaves: int, levels: int) -> list[int]:
    """Nodes at each depth, root first."""
    found = [leaves]
    for _ in range(levels - 1):
        found.append(-(-found[-1] // ARITY))
    return found[::-1]


def lay_out(leaves: list[bytes], levels: int) -> bytes:
    """The block over these digests; places without a node are zero."""
    nodes = np.zeros((nodes_in(levels), _WIDTH), np.uint8)
    row = leaves
    for place in reversed(addresses(levels)):
        nodes[place[: len(row)]] = np.frombuffer(b"".join(row), np.uint8).reshape(-1, _WIDTH)
        row = [
            sha256(b"".join(row[i : i + ARITY]).hex().encode()).digest()
            for i in range(0, len(row), ARITY)
        ]
    return nodes.tobytes()


class Block:
    """Read access to a stored block."""

    def __init__(self, nodes: bytes, leaves: int) -> None:
        self.text = nodes.hex()
        self.levels = (len(nodes) // _WIDTH * (ARITY - 1) + 1).bit_length() // 3
        self.widths = widths(leaves, self.levels)

    def at(self, depth: int, i: int) -> str:
        begin = 2 * _WIDTH * int(addresses(self.levels)[depth][i])
        return self.text[begin : begin + 2 * _WIDTH]

    def paths(self, above: list[tuple[str, str]]) -> Iterator[tuple[str, list[tuple[str, str]]]]:
        """(leaf, path) of every leaf; ``above`` is the path of the block's own root."""
        step, ways = 2 * _WIDTH, [above]
        for depth in range(1, self.levels):
            below = []
            for parent, (begin, end) in enumerate(
                pairwise([*range(0, self.widths[depth], ARITY), self.widths[depth]])
            ):
                run = "".join(self.at(depth, i) for i in range(begin, end))
                below += [
                    [(run[:k], run[k + step :]), *ways[parent]] for k in range(0, len(run), step)
                ]
            ways = below
        for i, way in enumerate(ways):
            yield self.at(self.levels - 1, i), way


def fold(leaf: str, path: list[tuple[str, str]]) -> str:
    """The root that a leaf and its path lead to."""
    for before, after in path:
        leaf = sha256(f"{before}{leaf}{after}".encode()).hexdigest()
    return leaf


def proof_digest(path: list[tuple[str, str]]) -> str:
    return sha256("".join(before + after for before, after in path).encode()).hexdigest()


def leaf_digest(row: dict[str, Column]) -> Column:
    """H of the fields: ``-`` if null, else byte count, ``:``, value."""
    fields = [c.cast("string") for c in row.values()]
    parts = [
        F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
        for c in fields
    ]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def leaves(documents: DataFrame) -> DataFrame:
    """tree, digest, doc_id, tampered: the digest after tampering, null where there was none."""
    row = {c: F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")}
    touched = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return documents.select(
        # sorts as languages do, null first
        F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("")).alias("tree"),
        leaf_digest(row).alias("digest"),
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.when(touched, leaf_digest(row | {"text": lower_ascii(F.col("text"))})).alias("tampered"),
    )


def _build(height: int, load: list[str]):
    """Rows sorted by tree, block and place become one row per block."""
    full = ARITY**height

    def made(key: tuple[str, int], rows: list[tuple]) -> tuple:
        levels = height + 1 if key[1] else levels_for(len(rows))
        digests, *rest = zip(*rows, strict=True)
        nodes = lay_out(list(digests), levels)
        return (*key, len(rows), nodes[:_WIDTH], nodes, *map(list, rest))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        key, rows = None, []
        for batch in batches:
            if schema is None:
                at = batch.schema
                schema = pa.schema(
                    [
                        ("tree", pa.string()),
                        ("block", pa.int64()),
                        ("leaves", pa.int64()),
                        ("root", pa.binary()),
                        ("nodes", pa.binary()),
                        *((c, pa.list_(at.field(c).type)) for c in load),
                    ]
                )
            columns = [batch.column(c).to_pylist() for c in ("tree", "pos", "digest", *load)]
            for tree, pos, *row in zip(*columns, strict=True):
                if key != (tree, pos // full):
                    if rows:
                        yield _batch([made(key, rows)], schema)
                    key, rows = (tree, pos // full), []
                rows.append(tuple(row))
        if rows:
            yield _batch([made(key, rows)], schema)

    return run


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
    )


def _grow(placed: DataFrame, load: dict[str, str], height: int) -> tuple[list[DataFrame], DataFrame]:
    """(blocks of each round, written to the shared folder; root of each tree).

    ``placed``: tree, pos, digest and the columns of ``load``, which rest in the first round's
    blocks. A tree's only block in its last round has the flag ``top``.
    """
    spark = placed.sparkSession
    rounds, roots = [], None
    while True:
        arrays = "".join(f", {c} array<{kind}>" for c, kind in load.items())
        path = scratch_path(spark, f"merkle-{len(rounds)}")
        (
            placed.select("tree", "pos", "digest", *load)
            .withColumn("block", F.expr(f"pos DIV {ARITY**height}"))
            .repartition("tree", "block")
            .sortWithinPartitions("tree", "block", "pos")
            .drop("block")
            .mapInArrow(
                _build(height, list(load)),
                "tree string, block long, leaves long, root binary, nodes binary" + arrays,
            )
            .write.option("compression", "none")
            .parquet(path)
        )
        blocks = spark.read.parquet(path)
        rounds.append(blocks)
        several = blocks.filter("block = 1").select("tree")
        tops = blocks.join(several, "tree", "left_anti").select("tree", "root")
        roots = tops if roots is None else roots.union(tops)
        if several.isEmpty():
            return rounds, roots
        placed = blocks.join(several, "tree", "left_semi").select(
            "tree", F.col("block").alias("pos"), F.col("root").alias("digest")
        )
        load = {}


def _hand_down(load: list[str], schema: pa.Schema, give):
    """Blocks with the path above each become one row per leaf: give(block, number, leaf, path, load)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = {c: batch.column(c)[at].as_py() for c in batch.schema.names}
                above = list(zip(row["before"], row["after"], strict=True))
                paths = Block(row["nodes"], row["leaves"]).paths(above)
                out = []
                for i, (leaf, path) in enumerate(paths):
                    out.append(give(row, i, leaf, path, [row[c][i] for c in load]))
                    if len(out) == 512:
                        yield _batch(out, schema)
                        out = []
                if out:
                    yield _batch(out, schema)

    return run


_STRINGS = pa.list_(pa.string())
_ABOVE = "before array<string>, after array<string>, subroot string"
_ABOVE_FIELDS = [("before", _STRINGS), ("after", _STRINGS), ("subroot", pa.string())]
_BLOCK_SCHEMA = pa.schema([("tree", pa.string()), ("block", pa.int64()), *_ABOVE_FIELDS])
_TREE_SCHEMA = pa.schema([("tree", pa.string()), *_ABOVE_FIELDS])
_ROW_SCHEMA = pa.schema(
    [
        ("doc_id", pa.int64()),
        *((c, pa.string()) for c in ("leaf", "subroot", "proof_sha256", "folded_root")),
    ]
)


def _split(path: list[tuple[str, str]]) -> tuple[list[str], list[str]]:
    return [before for before, _ in path], [after for _, after in path]


def _block_below(height: int):
    """A block's leaf is the root of a block of the round before."""
    full = ARITY**height
    return lambda row, i, leaf, path, load: (
        row["tree"],
        row["block"] * full + i,
        *_split(path),
        row["subroot"],
    )


def _tree_below(row, i, leaf, path, load):
    """A leaf of the last tree is the root of the tree that its load names."""
    return (load[0], *_split(path), leaf)


def _document(row, i, leaf, path, load):
    doc_id, tampered = load
    folded = fold(leaf if tampered is None else tampered.hex(), path)
    return (doc_id, leaf, row["subroot"], proof_digest(path), folded)


def _blocks_with_paths(rounds: list[DataFrame], tops: DataFrame, height: int) -> DataFrame:
    """The first round's blocks with the paths above them. ``tops``: tree and its path."""
    above = None
    for level in range(len(rounds) - 1, -1, -1):
        blocks = rounds[level]
        several = blocks.filter("block = 1").select("tree")
        here = blocks.select("tree", "block").join(several, "tree", "left_anti").join(tops, "tree")
        # a tree that needed a further round gets its paths from there
        above = here if above is None else here.union(above)
        if level:
            above = blocks.join(above, ["tree", "block"]).mapInArrow(
                _hand_down([], _BLOCK_SCHEMA, _block_below(height)),
                f"tree string, block long, {_ABOVE}",
            )
    return rounds[0].join(above, ["tree", "block"])


def manifest(documents: DataFrame, height: int = HEIGHT) -> DataFrame:
    """Per row: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    All are of the untampered data but the last two: the root that the row leads to if it was
    tampered with (``leaves``), and whether that is the manifest's.
    """
    spark = documents.sparkSession
    path = scratch_path(spark, "leaves")
    leaves(documents).write.option("compression", "none").parquet(path)
    placed = positions(spark.read.parquet(path), "tree", ["doc_id", "digest"])
    load = {"doc_id": "bigint", "tampered": "binary"}
    rounds, subroots = _grow(placed, load, height)

    named = subroots.select(
        F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("root").alias("digest")
    )
    upper, last = _grow(positions(named, "tree", ["name"]), {"name": "string"}, height)
    none = F.array().cast("array<string>")
    start = last.select(
        "tree", none.alias("before"), none.alias("after"), F.lit("").alias("subroot")
    )
    tops = (
        _blocks_with_paths(upper, start, height)
        .mapInArrow(_hand_down(["name"], _TREE_SCHEMA, _tree_below), f"tree string, {_ABOVE}")
        .checkpoint()
    )
    rows = _blocks_with_paths(rounds, tops, height).mapInArrow(
        _hand_down(list(load), _ROW_SCHEMA, _document),
        "doc_id long, leaf string, subroot string, proof_sha256 string, folded_root string",
    )
    root = last.first()
    return rows.select(
        "doc_id",
        "leaf",
        "subroot",
        F.lit(root.root.hex() if root else None).cast("string").alias("root"),
        "proof_sha256",
        "folded_root",
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce('=' || lang, '') AS tree, coalesce(text, '') AS text, text IS NULL AS bare,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-')
      || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-')
      || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
    list_reduce(list_prepend(4294967295::BIGINT, list_transform(
        string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
      lambda c, x: list_reduce(list_prepend(xor(c, x), range(8)),
        lambda r, k: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END)) AS crc
  FROM documents
), l AS (
  SELECT doc_id, tree, sha256(head || CASE WHEN bare THEN '-' ELSE strlen(text) || ':' || text END) AS leaf,
    sha256(head || CASE WHEN bare THEN '-' ELSE strlen(text) || ':' || translate(text,
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END) AS touched,
    xor(crc, 4294967295) % 3 = 0 AS hit
  FROM d
), p AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM l
), up AS (
  SELECT tree, 0 AS level, pos, leaf AS digest, count(*) OVER (PARTITION BY tree) AS width FROM p
  UNION ALL
  SELECT tree, level + 1, pos // 8, sha256(string_agg(digest, '' ORDER BY pos)), (width + 7) // 8
  FROM up WHERE width > 1 GROUP BY tree, level, pos // 8, width
), subroots AS (
  SELECT tree, digest, row_number() OVER (ORDER BY tree) - 1 AS pos FROM up WHERE width = 1
), over AS (
  SELECT 0 AS level, pos, digest, count(*) OVER () AS width FROM subroots
  UNION ALL
  SELECT level + 1, pos // 8, sha256(string_agg(digest, '' ORDER BY pos)), (width + 7) // 8
  FROM over WHERE width > 1 GROUP BY level, pos // 8, width
), steps AS (
  SELECT a.tree, a.level, a.pos, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS before,
    coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS after
  FROM up a JOIN up b ON a.tree = b.tree AND a.level = b.level AND a.pos // 8 = b.pos // 8
  WHERE a.width > 1 GROUP BY 1, 2, 3
  UNION ALL
  SELECT NULL, a.level, a.pos, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos < a.pos), ''),
    coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '')
  FROM over a JOIN over b ON a.level = b.level AND a.pos // 8 = b.pos // 8
  WHERE a.width > 1 GROUP BY 1, 2, 3
), walk AS (
  SELECT tree, pos AS id, tree AS at, 0 AS level, pos, CASE WHEN hit THEN touched ELSE leaf END AS digest, '' AS proof
  FROM p
  UNION ALL
  SELECT w.tree, w.id, CASE WHEN s.level IS NULL THEN NULL ELSE w.at END,
    CASE WHEN s.level IS NULL THEN 0 ELSE w.level + 1 END,
    CASE WHEN s.level IS NULL THEN r.pos ELSE w.pos // 8 END,
    CASE WHEN s.level IS NULL THEN w.digest ELSE sha256(s.before || w.digest || s.after) END,
    CASE WHEN s.level IS NULL THEN w.proof ELSE w.proof || s.before || s.after END
  FROM walk w LEFT JOIN steps s ON s.tree IS NOT DISTINCT FROM w.at AND s.level = w.level AND s.pos = w.pos
  JOIN subroots r ON r.tree = w.tree
  WHERE s.level IS NOT NULL OR w.at IS NOT NULL
), done AS (
  SELECT w.tree, w.id, w.digest, w.proof FROM walk w
  LEFT JOIN steps s ON s.tree IS NULL AND s.level = w.level AND s.pos = w.pos
  WHERE w.at IS NULL AND s.level IS NULL
)
SELECT p.doc_id, p.leaf, r.digest AS subroot, o.digest AS root, sha256(done.proof) AS proof_sha256,
  done.digest AS folded_root, done.digest = o.digest AS verified
FROM p JOIN done ON done.tree = p.tree AND done.id = p.pos
JOIN subroots r ON r.tree = p.tree JOIN over o ON o.width = 1
"""
