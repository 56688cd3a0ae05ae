"""Packing along a space-filling curve: neighbouring documents share sequences.

1. Every document is tokenised once. Its tokens are hashed into VECTOR signed buckets; fixed
   random projections turn the unit vector into DIMENSIONS coordinates, whose ranks among all
   documents' expected values are cells of a Hilbert curve. Token ids rest in the shared folder.
2. (key, length) of all documents are range-sorted by Hilbert key, ties by row, and summed up
   per partition: the document's place in one long token stream. Only one sum per partition is
   broadcast.
3. The stream is cut every SEQUENCE tokens, so all sequences but the last are full. A document
   knows its pieces from its place and length alone, so equal keys, hot documents and very
   long texts need no further grouping.

Defined cases: a null or empty text is its closing id alone, and its vector is zero. Rows that
repeat, share an id or have a null id are packed each on its own; pieces tell their document's
id. Other input columns are ignored. No documents give no pieces. The last sequence is shorter
than SEQUENCE unless the token count divides evenly.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from ordermill.session import scratch_path

SEQUENCE = 1024
END_ID = 0
VECTOR = 256
DIMENSIONS = 4
BITS = 12
# Whitespace runs from this length on go to the vocabulary's own library: the faster one
# backtracks over a run and gives up at some 750,000 characters
LONG_RUN = 100_000
# behind a look-back, so that every run is walked once
_long_run = re.compile(rf"(?<!\s)\s{{{LONG_RUN}}}")
# The split that byte-level BPE vocabularies of this family use before merging
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_of_sign() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for the 256 bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Token ids of whole texts, equal to the vocabulary's own library without added tokens.

    In vocabularies of this family the id of a token is its merge rank, so the faster of the
    installed libraries can apply the same merges from the same file. Texts with a whitespace run
    of LONG_RUN characters are left to the vocabulary's own library.
    """

    def __init__(self, path: str) -> None:
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte = _byte_of_sign()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {
            bytes(byte[c] for c in token): i
            for token, i in spec["model"]["vocab"].items()
            if token not in self.special
        }
        self.ordinary = tiktoken.Encoding(
            "own", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={}
        )
        self.size = 1 + max([*ranks.values(), *self.special.values()])
        longest_first = sorted(self.special, key=len, reverse=True)
        any_special = "|".join(map(regex.escape, longest_first))
        self.find = regex.compile(f"({any_special})") if any_special else None

    @functools.cached_property
    def library(self) -> Tokenizer:
        return Tokenizer.from_file(self.path)

    def _ids(self, text: str) -> np.ndarray:
        return self.ordinary.encode_to_numpy(text, disallowed_special=())

    def __call__(self, text: str) -> np.ndarray:
        if len(text) >= LONG_RUN and _long_run.search(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)
        if not self.find or not self.find.search(text):
            return self._ids(text)
        # every second part is a special token, which the library takes whole
        parts = [
            np.array([self.special[part]], np.uint32) if i % 2 else self._ids(part)
            for i, part in enumerate(self.find.split(text))
        ]
        return np.concatenate(parts)


@functools.lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    """One per Python worker."""
    return Encoder(path)


def document_vector(ids: np.ndarray) -> np.ndarray:
    """Token counts hashed into VECTOR buckets, each with a sign."""
    found = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
    counts = np.bincount((found % np.uint64(2 * VECTOR)).astype(np.int64), minlength=2 * VECTOR)
    return (counts[::2] - counts[1::2]).astype(np.float64)


def projections() -> np.ndarray:
    return np.random.default_rng(6).standard_normal((VECTOR, DIMENSIONS))


def cells(vector: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Cell numbers of BITS bits. A projection of a unit vector is about standard normal, so its
    logistic approximation of the normal distribution spreads documents over all cells."""
    length = np.linalg.norm(vector)
    place = vector @ matrix / length if length else np.zeros(DIMENSIONS)
    share = 1 / (1 + np.exp(-1.702 * place))
    return np.minimum((share * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)


def hilbert_key(point: np.ndarray) -> int:
    """Position of a cell on the Hilbert curve through DIMENSIONS x BITS bits (Skilling 2004)."""
    x = [int(v) for v in point]
    n = len(x)
    bit = 1 << (BITS - 1)
    while bit > 1:  # undo the rotations, from the highest bit down
        low = bit - 1
        for i in range(n):
            if x[i] & bit:
                x[0] ^= low
            else:
                swap = (x[0] ^ x[i]) & low
                x[0] ^= swap
                x[i] ^= swap
        bit >>= 1
    for i in range(1, n):  # Gray code
        x[i] ^= x[i - 1]
    flip, bit = 0, 1 << (BITS - 1)
    while bit > 1:
        if x[n - 1] & bit:
            flip ^= bit - 1
        bit >>= 1
    key = 0
    for level in range(BITS - 1, -1, -1):
        for i in range(n):
            key = key << 1 | ((x[i] ^ flip) >> level & 1)
    return key


def _tokenise(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, matrix = _encoder(path), projections()
        # ids rest and move as 16 bits where the vocabulary allows it
        width = "<u2" if encode.size <= 1 << 16 else "<u4"
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                keys, counts, ids = [], [], []
                for text in part.column(1):
                    own = encode(text.as_py() or "")
                    keys.append(hilbert_key(cells(document_vector(own), matrix)))
                    counts.append(len(own) + 1)
                    ids.append(np.append(own, END_ID).astype(width).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array(keys, pa.int64()),
                        pa.array(counts, pa.int64()),
                        pa.array(ids, pa.binary()),
                    ],
                    ["doc_id", "curve", "doc_tokens", "ids"],
                )

    return run


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to each row the tokens of the partition's rows before it."""
    total = 0
    for batch in batches:
        counts = batch.column(2).to_numpy()
        ends = np.cumsum(counts) + total
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), batch.column(2), pa.array(ends - counts)],
            ["part", "row", "doc_tokens", "before"],
        )
        total = int(ends[-1]) if len(ends) else total


def _cut(sequence: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in zip(*(batch.column(i) for i in range(4)), strict=True):
                doc, place, count, ids = (x.as_py() for x in row)
                ids = np.frombuffer(ids, f"<u{len(ids) // count}").astype("<u4").tobytes()
                start = 0
                while start < count:
                    at = place + start
                    length = min(sequence - at % sequence, count - start)
                    crc = zlib.crc32(ids[4 * start : 4 * (start + length)])
                    out.append((doc, start, length, crc, count, at // sequence, at % sequence))
                    start += length
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            columns = zip(*out, strict=True) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    return run


def tokenised(documents: DataFrame, tokenizer_path: str, id_col: str, text_col: str) -> DataFrame:
    """(row, doc_id, curve, doc_tokens, ids), written to the shared folder and read again."""
    spark = documents.sparkSession
    path = scratch_path(spark, "tokens")
    documents.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col)).mapInArrow(
        _tokenise(tokenizer_path), "doc_id long, curve long, doc_tokens long, ids binary"
    ).select(F.monotonically_increasing_id().alias("row"), "*").write.option(
        "compression", "zstd"
    ).parquet(path)
    return spark.read.parquet(path)


def places(tokens: DataFrame) -> DataFrame:
    """(row, place): tokens that stand before each document along the curve."""
    ordered = (
        tokens.select("curve", "row", "doc_tokens")
        .repartitionByRange("curve", "row")
        .sortWithinPartitions("curve", "row")
        .select(F.spark_partition_id().alias("part"), "row", "doc_tokens")
    )
    running = ordered.mapInArrow(
        _running, "part int, row long, doc_tokens long, before long"
    ).checkpoint()
    sums = running.groupBy("part").agg(F.sum("doc_tokens").alias("own"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition, in one task and to every task
    offsets = sums.select("part", F.coalesce(F.sum("own").over(earlier), F.lit(0)).alias("offset"))
    return running.join(F.broadcast(offsets), "part").select(
        "row", (F.col("offset") + F.col("before")).alias("place")
    )


def pack(
    documents: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    sequence: int = SEQUENCE,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    tokens = tokenised(documents, tokenizer_path, id_col, text_col)
    placed = tokens.select("row", "doc_id", "doc_tokens", "ids").join(places(tokens), "row")
    return placed.select("doc_id", "place", "doc_tokens", "ids").mapInArrow(
        _cut(sequence),
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
        "sequence_id long, offset long",
    )
