"""Near-duplicates by HyperMinHash: compressed registers in bands, then exact confirmation.

A document's set holds its distinct shingles of five words (fewer words: the whole sequence as
one). Every shingle is hashed to 64 bits; the upper half picks one of REGISTERS buckets, the
lower half competes for the bucket's minimum. A register keeps the minimum's leading-zero count
and its next MANTISSA bits. An empty bucket borrows the register of the first filled one in an
order of its own, so short documents agree in a register as often as their sets do. ROWS
registers form a band: two sets of similarity 0.75 share none of the BANDS bands with
probability (1 - 0.75**6)**64 = 4e-6, at 0.8 with 4e-9.

1. Equal sets form a class, represented by its smallest id; only representatives go on.
2. Representatives that share a band fall into one pool. Within pools, register agreement
   corrected for chance collisions estimates the similarity; pairs that may reach the threshold
   are confirmed on the full sets (``pool_links`` says how large pools are kept from
   comparing all pairs).
3. Connected components over the confirmed links.

Defined cases: null, empty and blank texts have the empty set and are linked with nothing. Rows
with a null id are linked with nothing, have no component and are kept. Rows that share an id
are one document for linking; each gets its own output row. ``keep_one`` goes by rows instead.
Other input columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordermill.llm.components import connected_components
from ordermill.llm.pool_links import pool_links
from ordermill.llm.rows import numbered
from ordermill.llm.shingles import ODD, WordHashes, mix, shingle_set

SHINGLE = 5
ROWS = 6
BANDS = 64
REGISTERS = ROWS * BANDS
MANTISSA = 10
# Pairs whose estimate lies more than this below the threshold are not confirmed: seven
# standard deviations of the estimate over 384 registers at 0.75, with room for borrowed ones.
MARGIN = 0.25

def _borrow_order() -> np.ndarray:
    """rank[i, j]: how late bucket i, if empty, asks bucket j. The same in every process."""
    return np.random.default_rng(20).random((REGISTERS, REGISTERS)).argsort(1).argsort(1)


def registers(shingles: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """REGISTERS values of 16 bits: leading zeros, then mantissa. The set must not be empty."""
    low = np.uint64(32)
    bucket = ((shingles >> low) * np.uint64(REGISTERS)) >> low
    least = np.sort((bucket << low) | (shingles & np.uint64(0xFFFFFFFF)))
    bucket = (least >> low).astype(np.int64)
    first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    filled = bucket[first]
    fraction, length = np.frexp((least[first] & np.uint64(0xFFFFFFFF)).astype(np.float64))
    mantissa = np.where(fraction > 0, (fraction * 2 - 1) * (1 << MANTISSA), 0).astype(np.uint16)
    out = np.zeros(REGISTERS, np.uint16)
    out[filled] = ((32 - length).astype(np.uint16) << np.uint16(MANTISSA)) | mantissa
    empty = np.setdiff1d(np.arange(REGISTERS), filled, assume_unique=True)
    if len(empty):
        out[empty] = out[filled[rank[np.ix_(empty, filled)].argmin(1)]]
    return out


def band_keys(regs: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of ROWS registers, the band's number mixed in."""
    keys = np.arange(1, BANDS + 1, dtype=np.uint64) * ODD
    for row in regs.reshape(BANDS, ROWS).T.astype(np.uint64):
        keys = mix(keys * ODD + row)
    return keys.view(np.int64)


def estimate(same: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Similarity from numbers of equal registers, less the collisions expected by chance.

    A pair of unrelated minima agrees in leading zeros and mantissa with a probability of about
    0.17 / 2**MANTISSA, less so if the sizes n and m differ.
    """
    chance = REGISTERS * 0.169919 / (1 << MANTISSA) * 4 * n * m / (n + m) ** 2
    return (same - chance) / (REGISTERS - chance)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes, rank = WordHashes(), _borrow_order()
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            sizes, prints, keys = [], [], []
            for text in part.column(1):
                found = shingle_set(text.as_py(), hashes, SHINGLE)
                sizes.append(len(found))
                prints.append(xxhash.xxh128_digest(found.tobytes()) if len(found) else None)
                keys.append(band_keys(registers(found, rank)) if len(found) else None)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array(sizes, pa.int64()),
                    pa.array(prints, pa.binary()),
                    pa.array(keys, pa.list_(pa.int64())),
                ],
                ["doc_id", "n_shingles", "print", "bands"],
            )


class Registers:
    """Pairs told apart by the estimate of their similarity."""

    def __init__(self, threshold: int) -> None:
        self.least = threshold / 100 - MARGIN
        self.rank = _borrow_order()

    def sketch(self, shingles: np.ndarray) -> np.ndarray:
        return registers(shingles, self.rank)

    def score(self, own: np.ndarray, n: int, others: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        near = estimate((others == own).sum(1), sizes, float(n))
        return np.where(near >= self.least, near, np.nan)


def near_duplicates(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = 75
) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest id reachable), kept (doc_id is it).

    Documents are linked where 100 * intersection >= threshold * union of their sets.
    """
    docs = documents.select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")
    )
    sketches = docs.mapInArrow(
        _sketch, "doc_id long, n_shingles long, print binary, bands array<long>"
    ).checkpoint()
    known = sketches.filter("doc_id IS NOT NULL AND print IS NOT NULL")
    classes = known.groupBy("print").agg(F.min("doc_id").alias("rep"))
    # copies shrink to one row per task before they move
    first = F.min_by(F.struct("doc_id", "n_shingles", "bands"), "doc_id").alias("first")
    spread = known.groupBy("print").agg(first).select(
        F.col("first.doc_id").alias("node"),
        F.col("first.n_shingles").alias("n"),
        F.explode("first.bands").alias("key"),
    )
    texts = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL")
    links = pool_links(texts, spread, SHINGLE, threshold, Registers(threshold))
    # a document's own class is one more link, so that ids that occur twice stay one document
    joined = known.join(classes, "print").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    components = connected_components(links.union(joined))
    return sketches.join(
        components, sketches["doc_id"] == components["node"], "left"
    ).select(
        "doc_id",
        "n_shingles",
        F.coalesce("component", "doc_id").alias("component_id"),
        F.coalesce(F.col("component") == F.col("doc_id"), F.lit(True)).alias("kept"),
    )


def keep_one(documents: DataFrame) -> DataFrame:
    """One document of each group, all columns: the one of the smallest id, null ids last.

    Rows are linked by their own numbers, so a null or repeated id neither hides a copy nor
    takes another text along. Rows that repeat both id and text of the one that stays are that
    document again and stay with it.
    """
    rows, row = numbered(documents)
    found = near_duplicates(rows, row).select(F.col("doc_id").alias(row), "component_id")
    digest = F.sha2(F.col("text").cast("binary"), 256).alias("digest")
    members = rows.select(row, "doc_id", digest).join(found, row)
    # a group shrinks to one row per task before it moves
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", row, "digest"))
    groups = (
        members.groupBy("component_id")
        .agg(first.alias("first"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .select("component_id", "first")
    )
    again = (F.col("doc_id") == F.col("first.doc_id")) & (F.col("digest") == F.col("first.digest"))
    stays = (F.col(row) == F.col(f"first.{row}")) | F.coalesce(again, F.lit(False))
    gone = members.join(groups, "component_id").filter(~stays).select(row)
    return rows.join(gone, row, "left_anti").select(documents.columns)


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents
), s AS (
  SELECT doc_id, list_distinct(list_transform(range(1, greatest(len(words) - 4, 1) + 1),
      lambda i: array_to_string(words[i:i + 4], ' '))) AS shingles
  FROM w WHERE len(words) > 0
), e AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM s),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS c
  FROM e a JOIN e b ON a.shingle = b.shingle AND a.doc_id < b.doc_id
    AND 100 * a.n >= 75 * b.n AND 100 * b.n >= 75 * a.n
  GROUP BY 1, 2
), link AS (
  SELECT x, y FROM common WHERE 100 * c >= 75 * (n + m - c)
), way AS (
  SELECT x, y FROM link UNION ALL SELECT y, x FROM link
), reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT r.doc_id, way.y FROM reach r JOIN way ON r.other = way.x
)
SELECT d.doc_id, coalesce(len(s.shingles), 0) AS n_shingles, c.component_id,
  d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN s USING (doc_id)
JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) c USING (doc_id)
"""
