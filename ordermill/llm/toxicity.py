"""Toxicity by the nearest labelled examples: exact TF-IDF cosine on a block-max index.

1. Of the labelled documents that may be learnt from, at most EXAMPLES of each label are taken
   (the smallest hashes of the id): the index's stated bound. All else covers all data.
2. Terms are words and word beginnings, each once more for every level of LEVELS that its count
   reaches, as the cosine itself does not tell one mention from many. Every term of an example is
   indexed. Its weight is (1 + ln tf) * ln((1 + N) / (1 + df)), with df counted over all documents,
   times how clearly toxic examples hold it more often than others do: from FLOOR for a term that
   tells nothing up to 1. Vectors have length 1.
3. The inverted index keeps the postings of all but the most frequent terms; a document adds up
   its own. The FREQUENT ones are laid out by blocks of BLOCK examples with the largest weight of
   each block, which bounds what they can add there. A block is opened only for documents whose
   bound there reaches the NEIGHBOURS best of their postings; cosines in open blocks are exact.
4. Neighbours vote with the square of their cosine, times the number of labelled documents that
   an example stands for, beside PRIOR votes at the rate of toxic labels. That rate is the score of
   a document without any known term. Evidence: the nearest examples and cosines.

Defined cases: null and empty texts have no terms and score the prior. Rows with a null id are
scored, never learnt from. Labels that repeat count once; toxic wins. Rows that share a labelled
id are one example; all are scored, and count for df. Without labels every score is 0. Other input
columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from ordermill.llm.rows import stored

EXAMPLES = 1024
BEGINNINGS = (4, 6)
LEVELS = (1, 2, 3, 5)
FLOOR = 0.05
CLEAR_Z = 5.0
PRIOR = 0.5
NEIGHBOURS = 25
BLOCK = 64
FREQUENT = 1024
TOGETHER = 64
# frequent terms and sums are kept in single precision
ROUNDING = 1e-5
REMEMBERED = 100_000

_words = re.compile(r"\w+").findall


def terms_of(word: str) -> list[str]:
    """A word and its beginnings, which end with a sign that no word has."""
    return [word, *(word[:k] + "-" for k in BEGINNINGS if len(word) > k)]


def is_held_out(id_col: Column) -> Column:
    """Every fifth document by the checksum of its id."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled_examples(documents: DataFrame, labels: DataFrame) -> tuple[DataFrame, float]:
    """(doc_id, text, toxic, stands_for) of at most EXAMPLES of each label; the rate of toxic labels.

    They are chosen among the labels, so only their ids are broadcast to the documents. Of rows
    that share an id one is taken, by the largest hash of its text.
    """
    known = (
        labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
        .filter(~is_held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    totals = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = None
    for toxic in (0, 1):
        total = totals.get(toxic, 0)
        part = (
            known.filter(F.col("toxic") == toxic)
            .orderBy(F.xxhash64("doc_id"), "doc_id")
            .limit(EXAMPLES)
            .withColumn("stands_for", F.lit(total / max(1, min(total, EXAMPLES))))
        )
        chosen = part if chosen is None else chosen.union(part)
    rank = F.struct(F.col("text").isNotNull(), F.xxhash64("text"), "text")
    # a hot id has shrunk to one row per task before it moves
    examples = (
        documents.select("doc_id", "text")
        .join(F.broadcast(chosen), "doc_id")
        .groupBy("doc_id", "toxic", "stands_for")
        .agg(F.max_by("text", rank).alias("text"))
    )
    labelled = sum(totals.values())
    return stored(examples, "examples"), totals.get(1, 0) / labelled if labelled else 0.0


class Words(dict):
    """word -> numbers of its terms in a vocabulary, for a bounded number of words."""

    def __init__(self, vocabulary: list[dict[str, int]]) -> None:
        super().__init__()
        self.whole = vocabulary[0].get
        self.beginnings = [(k, part.get) for k, part in zip(BEGINNINGS, vocabulary[1:], strict=True)]

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= REMEMBERED:
            self.clear()
        number, size = self.whole(word), len(word)
        found = () if number is None else (number,)
        for k, get in self.beginnings:
            if size > k:
                number = get(word[:k])
                if number is not None:
                    found += (number,)
        self[word] = found
        return found

    def counts(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """The known terms of a text, ascending, and how often each occurs."""
        lists = filter(None, map(self.__getitem__, _words((text or "").lower())))
        found = np.fromiter(chain.from_iterable(lists), np.int32)
        return np.unique(found, return_counts=True)


def _by_length(terms: list[str]) -> list[dict[str, int]]:
    """term -> number: whole words, then beginnings of each length."""
    parts: list[dict[str, int]] = [{}, *({} for _ in BEGINNINGS)]
    for number, term in enumerate(terms):
        if term.endswith("-"):
            parts[1 + BEGINNINGS.index(len(term) - 1)][term[:-1]] = number
        else:
            parts[0][term] = number
    return parts


def _example_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, toxic, stands_for and, for the text, its terms and their counts."""
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            found = []
            for text in part.column(3):
                own: Counter = Counter()
                for word, n in Counter(_words((text.as_py() or "").lower())).items():
                    for term in terms_of(word):
                        own[term] += n
                found.append(own)
            yield pa.RecordBatch.from_arrays(
                [
                    *part.columns[:3],
                    pa.array([list(own) for own in found], pa.list_(pa.string())),
                    pa.array([list(own.values()) for own in found], pa.list_(pa.int32())),
                ],
                ["doc_id", "toxic", "stands_for", "terms", "counts"],
            )


def _terms(vocabulary, text_at: int, keep: list[int], names: tuple[str, str]):
    """Columns of the batches and two more, the known terms of each text and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(vocabulary.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = [words.counts(t.as_py()) for t in part.column(text_at)]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(part.column(i) for i in keep),
                        pa.array([t for t, _ in found], pa.list_(pa.int32())),
                        pa.array([n.astype(np.int32) for _, n in found], pa.list_(pa.int32())),
                    ],
                    [*(part.schema.names[i] for i in keep), *names],
                )

    return run


def _count_documents(size: int, terms_at: int):
    """(term, n): documents of the task in which a term reaches a level, terms by level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((len(LEVELS), size), np.int64)
        for batch in batches:
            terms, counts = (batch.column(terms_at + i).flatten().to_numpy() for i in (0, 1))
            for level, least in enumerate(LEVELS):
                totals[level] += np.bincount(terms[counts >= least], minlength=size)
        flat = totals.ravel()
        held = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(flat[held])], ["term", "n"])

    return run


@dataclass
class BlockMaxIndex:
    """Examples in blocks; a term at a level has a number, and a weight in all vectors.

    ``number[level, term]`` is -1 where no example reaches the level. Postings of number t are
    ``cuts[t]`` to ``cuts[t + 1]``; a frequent one has a place in ``slot`` instead, with its weights
    in ``dense[block, slot]`` and their maxima in ``most[slot, block]``.
    """

    number: np.ndarray
    weight: np.ndarray
    cuts: np.ndarray
    rows: np.ndarray
    weights: np.ndarray
    slot: np.ndarray
    dense: np.ndarray
    most: np.ndarray
    ids: np.ndarray
    toxic: np.ndarray
    votes: np.ndarray
    prior: float

    def vector(self, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and weights of a document, of length 1."""
        numbers, tf = [], []
        for level, least in enumerate(LEVELS):
            reached = counts >= least
            own = self.number[level, terms[reached]]
            numbers.append(own[own >= 0])
            tf.append(counts[reached][own >= 0])
        numbers = np.concatenate(numbers)
        weights = (1 + np.log(np.concatenate(tf))) * self.weight[numbers]
        held = weights > 0
        numbers, weights = numbers[held], weights[held]
        return numbers, weights / np.linalg.norm(weights) if len(weights) else weights

    def nearest(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each vector the k examples of highest cosine above zero, ties by index order, and
        their cosines. Vectors that reach a block are compared with it together."""
        blocks, slots = len(self.dense), self.most.shape[0]
        sums = np.zeros((len(vectors), blocks * BLOCK), np.float32)
        own = np.zeros((len(vectors), slots), np.float32)
        for i, (numbers, weights) in enumerate(vectors):
            slot = self.slot[numbers]
            own[i, slot[slot >= 0]] = weights[slot >= 0]
            rare = slot < 0
            begins = self.cuts[numbers[rare]]
            sizes = self.cuts[numbers[rare] + 1] - begins
            at = np.repeat(begins - np.cumsum(sizes) + sizes, sizes)
            at += np.arange(len(at))
            each = self.weights[at]
            each *= np.repeat(weights[rare], sizes)
            sums[i] = np.bincount(self.rows[at], each, blocks * BLOCK)
        # what the postings alone give bounds the last of the best from below; rounding may lift a
        # sum above its bound by a little
        k = min(k, sums.shape[1])
        least = np.partition(sums, sums.shape[1] - k, axis=1)[:, sums.shape[1] - k] if k else np.zeros(len(vectors))
        by_block = sums.reshape(len(vectors), blocks, BLOCK)
        bounds = by_block.max(2, initial=0) + own @ self.most
        in_reach = (bounds > 0) & (bounds >= least[:, None] - ROUNDING)
        for block in range(blocks):
            asking = np.flatnonzero(in_reach[:, block])
            if len(asking) == len(own):
                by_block[:, block] += own @ self.dense[block]
            elif len(asking):
                by_block[asking, block] += own[asking] @ self.dense[block]
        by_block[~in_reach] = 0
        out = []
        for row in sums:
            last = np.partition(row, len(row) - k)[len(row) - k] if k else 0
            hits = np.flatnonzero((row >= last) & (row > 0))
            hits = hits[np.lexsort((hits, -row[hits]))][:k]
            out.append((hits, row[hits]))
        return out

    def scores(self, documents: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[float, list, list]]:
        """(score, nearest examples, cosines) for the terms and counts of each document."""
        for at in range(0, len(documents), TOGETHER):
            vectors = [self.vector(*d) for d in documents[at : at + TOGETHER]]
            for rows, cosines in self.nearest(vectors, NEIGHBOURS):
                power = cosines**2 * self.votes[rows]
                score = (PRIOR * self.prior + power @ self.toxic[rows]) / (PRIOR + power.sum())
                yield float(min(max(score, 0.0), 1.0)), self.ids[rows].tolist(), cosines.tolist()


def clearness(bad: np.ndarray, good: np.ndarray, toxic: int, clean: int) -> np.ndarray:
    """From FLOOR to 1: how clearly toxic examples hold a term more often than clean ones."""
    if not toxic or not clean:
        return np.full(len(bad), FLOOR)
    rate = (bad + good) / (toxic + clean)
    error = np.sqrt(rate * (1 - rate) * (1 / toxic + 1 / clean))
    gap = np.maximum(bad / toxic - good / clean, 0)
    z = np.divide(gap, error, out=np.zeros(len(bad)), where=error > 0)
    return FLOOR + (1 - FLOOR) * (1 - np.exp(-((z / CLEAR_Z) ** 2)))


def build_index(
    ids: np.ndarray,
    toxic: np.ndarray,
    votes: np.ndarray,
    prior: float,
    entries: tuple[np.ndarray, np.ndarray, np.ndarray],
    documents: np.ndarray,
    total: int,
) -> BlockMaxIndex:
    """entries: example, term and count, side by side; documents[level, term]: how many of the
    ``total`` documents reach the level."""
    row, term, tf = entries
    size = documents.shape[1]
    numbers, total_numbers, parts = np.full((len(LEVELS), size), -1, np.int32), 0, []
    for level, least in enumerate(LEVELS):
        own = np.flatnonzero(tf >= least)
        present = np.flatnonzero(np.bincount(term[own], minlength=size))
        numbers[level, present] = total_numbers + np.arange(len(present))
        total_numbers += len(present)
        parts.append((row[own], numbers[level, term[own]], tf[own]))
    row, number, tf = (np.concatenate(x) for x in zip(*parts, strict=True))
    del parts, term

    often = np.bincount(number, minlength=total_numbers)
    bad = np.bincount(number, toxic[row], total_numbers)
    clear = clearness(bad, often - bad, int(toxic.sum()), int(len(toxic) - toxic.sum()))
    weight = np.empty(total_numbers)
    weight[numbers[numbers >= 0]] = np.log((1 + total) / (1 + documents[numbers >= 0]))
    weight *= clear
    w = (1 + np.log(tf)) * weight[number]
    norm = np.sqrt(np.bincount(row, w * w, len(ids)))
    norm[norm == 0] = 1
    w /= norm[row]

    # examples with the same strongest term share blocks, which keeps the block maxima telling
    strongest, best = np.full(len(ids), -1, np.int64), np.zeros(len(ids))
    np.maximum.at(best, row, w)
    top = np.flatnonzero(w == best[row])
    strongest[row[top]] = number[top]
    order = np.lexsort((ids, strongest))
    place = np.empty(len(ids), np.int32)
    place[order] = np.arange(len(ids), dtype=np.int32)
    row = place[row]

    blocks = -(-len(ids) // BLOCK)
    frequent = np.sort(np.argsort(-often, kind="stable")[:FREQUENT])
    slot = np.full(total_numbers, -1, np.int64)
    slot[frequent] = np.arange(len(frequent))
    dense = np.zeros((blocks, len(frequent), BLOCK), np.float32)
    own = slot[number] >= 0
    dense[row[own] // BLOCK, slot[number[own]], row[own] % BLOCK] = w[own]

    row, number, w = row[~own], number[~own], w[~own]
    rest = np.argsort(number.astype(np.int64) * len(ids) + row)
    return BlockMaxIndex(
        numbers,
        weight,
        np.append(0, np.cumsum(np.bincount(number, minlength=total_numbers))),
        row[rest].astype(np.int64),
        w[rest],
        slot,
        dense,
        np.ascontiguousarray(dense.max(2, initial=0).T),
        ids[order],
        toxic[order].astype(float),
        votes[order],
        prior,
    )


def fit(
    documents: DataFrame, labels: DataFrame, text_col: str, keep: list[str]
) -> tuple[object, DataFrame, tuple[str, str]]:
    """(broadcast index, columns of the documents with their terms and counts, these two's names).

    Texts are split into terms once; what the index knows of them rests in the shared folder.
    """
    sc = documents.sparkSession.sparkContext
    docs = documents.select("doc_id", F.col(text_col).alias("text"))
    examples, prior = labelled_examples(docs, labels)
    found = (
        examples.select(F.col("doc_id").cast("bigint"), F.col("toxic").cast("int"), "stands_for", "text")
        .mapInArrow(
            _example_terms,
            "doc_id long, toxic int, stands_for double, terms array<string>, counts array<int>",
        )
        .orderBy("doc_id")
        .toArrow()
        .combine_chunks()
    )
    terms, counts = (found[c].chunk(0) if len(found) else pa.array([], pa.list_(pa.string())) for c in ("terms", "counts"))
    row = np.repeat(
        np.arange(len(found), dtype=np.int32), terms.value_lengths().to_numpy(zero_copy_only=False)
    )
    tf = np.array(counts.flatten(), np.int32)
    coded = terms.flatten().dictionary_encode()
    heads = [found[c].to_numpy() for c in ("doc_id", "toxic", "stands_for")]
    del found, terms, counts
    names_of = coded.dictionary.to_pylist()
    size, term = len(names_of), coded.indices.to_numpy()
    vocabulary = sc.broadcast(_by_length(names_of))
    del coded, names_of

    names = ("terms", "counts")
    while set(names) & set(documents.columns):
        names = tuple(f"_{n}" for n in names)
    lists = [StructField(n, ArrayType(IntegerType())) for n in names]
    schema = StructType([*(documents.schema[c] for c in keep), *lists])
    at = documents.columns.index
    found = documents.mapInArrow(_terms(vocabulary, at(text_col), list(map(at, keep)), names), schema)
    split = stored(found, "terms", "zstd")
    held = (
        split.select(*names)
        .mapInArrow(_count_documents(size, 0), "term long, n long")
        .groupBy("term")
        .agg(F.sum("n").alias("n"))
        .toArrow()
    )
    seen = np.zeros(len(LEVELS) * size, np.int64)
    seen[held["term"].to_numpy()] = held["n"].to_numpy()
    del held
    index = build_index(*heads, prior, (row, term, tf), seen.reshape(len(LEVELS), size), split.count())
    return sc.broadcast(index), split, names


def _scores(batch: pa.RecordBatch, index: BlockMaxIndex, names: tuple[str, str]) -> Iterator[tuple]:
    lists = [batch.column(batch.schema.names.index(n)) for n in names]
    pairs = zip(*lists, strict=True)
    yield from index.scores([tuple(x.values.to_numpy() for x in pair) for pair in pairs])


def _score(model, names: tuple[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scored = list(_scores(batch, model.value, names))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([s for s, _, _ in scored], pa.float64()),
                    pa.array([int(s >= 0.5) for s, _, _ in scored], pa.int32()),
                    pa.array([ids for _, ids, _ in scored], pa.list_(pa.int64())),
                    pa.array([c for _, _, c in scored], pa.list_(pa.float64())),
                ],
                ["doc_id", "held_out", "score", "predicted", "nearest", "cosines"],
            )

    return run


def score(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, score, predicted, and the nearest examples with cosines.

    ``labels`` has doc_id and toxic (0 or 1).
    """
    number = F.col(id_col).cast("bigint").alias("doc_id")
    docs = documents.select(number, F.col(text_col).alias("text"))
    model, split, names = fit(docs, labels, "text", ["doc_id"])
    return split.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), *names).mapInArrow(
        _score(model, names),
        "doc_id long, held_out boolean, score double, predicted int, nearest array<long>, "
        "cosines array<double>",
    )


def _is_harmless(model) -> Callable:
    """Whether terms and counts score below the threshold; no other column leaves the JVM."""

    @F.arrow_udf("boolean")
    def harmless(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for terms, counts in batches:
            pairs = [
                (t.values.to_numpy(), n.values.to_numpy()) for t, n in zip(terms, counts, strict=True)
            ]
            yield pa.array([s < 0.5 for s, _, _ in model.value.scores(pairs)], pa.bool_())

    return harmless


def keep_harmless(documents: DataFrame, labels: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows not predicted toxic, all columns."""
    model, split, names = fit(documents, labels, text_col, documents.columns)
    return split.filter(_is_harmless(model)(*[F.col(f"`{n}`") for n in names])).drop(*names)
