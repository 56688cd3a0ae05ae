"""Similarity join of n-gram sets by PartEnum signatures, exact.

A document's set holds its distinct shingles of three words (fewer words: the whole sequence as
one). Sizes are cut into bands; a set of one band can only be linked with sets of the same or the
next one, so each set takes part in two instances, its own band's and the next one's. In an
instance with sets of at most r shingles, linked sets differ in at most k = 2r (1-t)/(1+t)
shingles, t being the threshold.

The domain of hashed shingles is cut into k/2 + 1 partitions, each of three parts. Linked sets
differ by at most one shingle in some partition, so they agree in two of its three parts. A set's
signatures enumerate, for every partition, the three pairs of parts: 1.5 (k + 1) hashes of what it
holds there. Two linked sets share one, always.

1. Equal sets form a class, represented by its smallest id; only representatives go on.
2. Representatives that share a signature fall into one pool and are compared (``pool_links`` says
   how large pools are kept from comparing all pairs). Parities of shingle counts in
   1,024 cells differ in no more cells than the sets in shingles: a bound without error that
   spares most comparisons of full sets.
3. Connected components over the confirmed links.

Defined cases: null, empty and blank texts have the empty set and are linked with nothing. Rows
with a null id are linked with nothing and have no component. Rows that share an id are one
document for linking; each gets its own output row. Other input columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordermill.llm.components import connected_components
from ordermill.llm.pool_links import pool_links
from ordermill.llm.rows import stored
from ordermill.llm.shingles import ODD, WordHashes, mix, shingle_set

SHINGLE = 3
THRESHOLD = 90
PARTS = 3
CELLS = 1024


def differ_at_most(sizes: int, threshold: int) -> int:
    """Largest symmetric difference of two linked sets whose sizes add up to ``sizes``."""
    return sizes * (100 - threshold) // (100 + threshold)


@lru_cache(maxsize=4096)
def band(n: int, threshold: int) -> tuple[int, int, int]:
    """(number of the band of size n, its largest size, the next band's largest size)."""
    number, largest = 0, 100 // threshold
    while largest < n:
        number, largest = number + 1, (largest + 1) * 100 // threshold
    return number, largest, (largest + 1) * 100 // threshold


def instance(shingles: np.ndarray, number: int, largest: int, threshold: int) -> np.ndarray:
    """The signatures of a set in one instance; none where only equal sets can be linked."""
    k = differ_at_most(2 * largest, threshold)
    if not k:
        return np.empty(0, np.uint64)
    partitions = k // 2 + 1
    low = np.uint64(32)
    own = mix(shingles + np.uint64((number + 1) * int(ODD) % 2**64))
    part = ((own >> low) * np.uint64(PARTS * partitions)) >> low
    held = np.zeros(PARTS * partitions, np.uint64)
    np.add.at(held, part.astype(np.int64), mix(own))
    held = held.reshape(partitions, PARTS)
    name = (np.arange(partitions, dtype=np.uint64) + np.uint64(number << 32)) * ODD
    pairs = [
        mix(mix(mix(name + np.uint64(without)) * ODD + held[:, a]) * ODD + held[:, b])
        for without, a, b in ((0, 1, 2), (1, 0, 2), (2, 0, 1))
    ]
    return np.concatenate(pairs)


def signatures(shingles: np.ndarray, threshold: int = THRESHOLD) -> np.ndarray:
    number, largest, next_largest = band(len(shingles), threshold)
    both = (
        instance(shingles, number, largest, threshold),
        instance(shingles, number + 1, next_largest, threshold),
    )
    return np.concatenate(both).view(np.int64)


class Parities:
    """Pairs told apart by the parities of how many of their shingles fall into each cell."""

    def __init__(self, threshold: int) -> None:
        self.threshold = threshold

    def sketch(self, shingles: np.ndarray) -> np.ndarray:
        cells = (mix(shingles) % np.uint64(CELLS)).astype(np.int64)
        return np.packbits(np.bincount(cells, minlength=CELLS).astype(np.uint8) & 1).view(np.uint64)

    def score(self, own: np.ndarray, n: int, others: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        least = np.bitwise_count(others ^ own).sum(1).astype(np.float64)
        most = (sizes + n) * (100 - self.threshold) // (100 + self.threshold)
        return np.where(least <= most, -least, np.nan)


def _sketch(threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                sizes, prints, keys = [], [], []
                for text in part.column(1):
                    found = shingle_set(text.as_py(), hashes, SHINGLE)
                    sizes.append(len(found))
                    prints.append(xxhash.xxh128_digest(found.tobytes()) if len(found) else None)
                    keys.append(signatures(found, threshold) if len(found) else None)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array(sizes, pa.int64()),
                        pa.array(prints, pa.binary()),
                        pa.array(keys, pa.list_(pa.int64())),
                    ],
                    ["doc_id", "n_shingles", "print", "keys"],
                )

    return run


def similar_documents(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD
) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest id reachable by links).

    Documents are linked where 100 * intersection >= threshold * union of their sets.
    """
    docs = documents.select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")
    )
    sketches = stored(
        docs.mapInArrow(
            _sketch(threshold), "doc_id long, n_shingles long, print binary, keys array<long>"
        ),
        "signatures",
    )
    known = sketches.filter("doc_id IS NOT NULL AND print IS NOT NULL")
    classes = known.groupBy("print").agg(F.min("doc_id").alias("rep"))
    # copies shrink to one row per task before they move
    first = F.min_by(F.struct("doc_id", "n_shingles", "keys"), "doc_id").alias("first")
    spread = known.groupBy("print").agg(first).select(
        F.col("first.doc_id").alias("node"),
        F.col("first.n_shingles").alias("n"),
        F.explode("first.keys").alias("key"),
    )
    texts = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL")
    links = pool_links(texts, spread, SHINGLE, threshold, Parities(threshold))
    # a document's own class is one more link, so that ids that occur twice stay one document
    joined = known.join(classes, "print").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    components = connected_components(links.union(joined))
    return sketches.join(
        components, sketches["doc_id"] == components["node"], "left"
    ).select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents
), s AS (
  SELECT doc_id, list_distinct(list_transform(range(1, greatest(len(words) - 2, 1) + 1),
      lambda i: array_to_string(words[i:i + 2], ' '))) AS shingles
  FROM w WHERE len(words) > 0
), e AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM s),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS c
  FROM e a JOIN e b ON a.shingle = b.shingle AND a.doc_id < b.doc_id
    AND 100 * a.n >= 90 * b.n AND 100 * b.n >= 90 * a.n
  GROUP BY 1, 2
), link AS (
  SELECT x, y FROM common WHERE 100 * c >= 90 * (n + m - c)
), way AS (
  SELECT x, y FROM link UNION ALL SELECT y, x FROM link
), reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT r.doc_id, way.y FROM reach r JOIN way ON r.other = way.x
)
SELECT d.doc_id, coalesce(len(s.shingles), 0) AS n_shingles, c.component_id
FROM documents d LEFT JOIN s USING (doc_id)
JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) c USING (doc_id)
"""
