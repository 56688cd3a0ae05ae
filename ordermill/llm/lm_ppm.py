"""Language-model scores by prediction by partial matching (PPM) over the bytes of whole texts.

A document is spelled as its words, lower-cased in A-Z and set apart by one blank each, and one end
sign; four end signs stand before it. Every byte is predicted from the ORDER bytes before it,
blanks included, so words are seen in their order. The trie of contexts is pretrained on the
training documents: a byte is predicted in the longest known context; where it is missing there,
the context's escape is paid (method C: distinct symbols over distinct symbols plus occurrences)
and the next shorter context is asked, without the symbols already ruled out. Below order 0
all remaining bytes are equally likely.

The trie is a Spark table of windows, ORDER bytes of context and the byte that follows, with
their counts; contexts are the true bytes and their number grows with the corpus. A window
that any document holds is rated once: windows that share their last three context bytes, 65,536 at
most, meet in a task, which has the orders 4 and 3 whole. The orders 2 to 0 have at most 16.8
million entries whatever the corpus, are known by far fewer in text, and are broadcast. A
document's score is the sum over its windows: ratings of the most frequent ones are broadcast, at
most HEAVY_WINDOWS, the others are joined, counted per document first. Words, for the
base score, go the same way.

Defined cases: null, empty and blank texts are the end sign alone. Rows are scored each on its
own, whatever their id; null ids count as training. Without training documents the model knows
nothing: bytes are equally likely and N is 0. Other input columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from math import log10

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordermill.llm.rows import stored

ORDER = 4
# at most so many words and windows are broadcast, the others joined
HEAVY = 1 << 17
HEAVY_BYTES = 64
HEAVY_WINDOWS = 1 << 19
SLOTS = (1 << 21, 1 << 19)
# symbols that are worked on at a time, and distinct keys that a task counts before it sends them
SLICE = 1 << 21
FLUSH = 1_500_000
BLANK, END = b" ", b"\n"
START = END * ORDER

_ODD = np.uint64(0x9E3779B97F4A7C15)


def is_held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def spelled(words: list[bytes]) -> bytes:
    return BLANK.join(words) + END


class Piece:
    """Windows of several texts, or of a part of a long one, side by side."""

    def __init__(self, owners: list[int], parts: list[bytes]) -> None:
        """Each part has ORDER bytes of context in front."""
        self.owners = np.array(owners)
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        self.begins = np.cumsum(lengths) - lengths
        n = int(lengths.sum()) - ORDER
        data = b"".join([*parts, bytes(3)])
        eight = np.ndarray((n,), ">u8", data, strides=(1,))
        self.windows = eight.astype(np.uint64) >> np.uint64(24)
        # the context in front of the next part is no text
        self.real = np.ones(n, bool)
        for k in range(ORDER):
            self.real[self.begins[1:] - ORDER + k] = False


def pieces(texts: Iterable[bytes]) -> Iterator[Piece]:
    """Texts, known by their number, in pieces of about SLICE symbols."""
    owners, parts, size = [], [], 0
    for owner, text in enumerate(texts):
        whole = START + text
        for at in range(0, len(text), SLICE):
            owners.append(owner)
            parts.append(whole[at : at + SLICE + ORDER])
            size += len(parts[-1])
            if size >= SLICE:
                yield Piece(owners, parts)
                owners, parts, size = [], [], 0
    if parts:
        yield Piece(owners, parts)


def window_keys(windows: np.ndarray) -> pa.Array:
    """A blank and the window's bytes: keys that no word can be."""
    data = np.ascontiguousarray(windows.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:])
    data[:, 0] = BLANK[0]
    offsets = np.arange(0, 6 * len(windows) + 1, 6, dtype=np.int32)
    buffers = [None, pa.py_buffer(offsets), pa.py_buffer(data)]
    return pa.Array.from_buffers(pa.binary(), len(windows), buffers)


def windows_of_keys(keys: pa.Array) -> np.ndarray:
    offsets = np.frombuffer(keys.buffers()[1], np.int32)[keys.offset :]
    data = np.frombuffer(keys.buffers()[2], np.uint8)[offsets[0] : offsets[0] + 6 * len(keys)]
    wide = np.zeros((len(keys), 8), np.uint8)
    wide[:, 3:] = data.reshape(-1, 6)[:, 1:]
    return wide.view(">u8").ravel().astype(np.uint64)


class WindowCounts:
    """Occurrences of windows in training documents and in all."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, texts: list[bytes], training: bool) -> None:
        for piece in pieces(texts):
            windows, n = np.unique(piece.windows[piece.real], return_counts=True)
            self.parts.append((windows, n if training else np.zeros_like(n), n))
            self.size += len(windows)
            if self.size > 2 * FLUSH:
                self._merge()

    def _merge(self) -> None:
        windows, train, total = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        windows, back = np.unique(windows, return_inverse=True)
        sums = [np.bincount(back, x, len(windows)).astype(np.int64) for x in (train, total)]
        self.parts, self.size = [(windows, *sums)], len(windows)

    def take(self, least: int) -> Iterator[pa.RecordBatch]:
        """What is counted, if it is at least so many keys."""
        if self.parts and self.size > least:
            self._merge()
            if self.size > least:
                windows, train, total = self.parts[0]
                yield pa.RecordBatch.from_arrays(
                    [window_keys(windows), pa.array(train), pa.array(total)], ["key", "c", "times"]
                )
                self.parts, self.size = [], 0


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, c, times): words and windows, in training documents and in all, a task's share."""

    def words_out(train: Counter, rest: Counter) -> pa.RecordBatch:
        words = list(train.keys() | rest.keys())
        c = [train[w] for w in words]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(words, pa.binary()),
                pa.array(c, pa.int64()),
                pa.array([n + rest[w] for n, w in zip(c, words, strict=True)], pa.int64()),
            ],
            ["key", "c", "times"],
        )

    train: Counter = Counter()
    rest: Counter = Counter()
    counts = WindowCounts()
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            texts: dict[bool, list[bytes]] = {False: [], True: []}
            for text, held_out in zip(part.column(0), part.column(1).to_pylist(), strict=True):
                words = words_of(text.as_py())
                texts[held_out].append(spelled(words))
                words.append(END)
                (rest if held_out else train).update(words)
                if len(train) + len(rest) > FLUSH // 5:
                    yield words_out(train, rest)
                    train, rest = Counter(), Counter()
            counts.add(texts[False], True)
            counts.add(texts[True], False)
            yield from counts.take(FLUSH)
    yield words_out(train, rest)
    yield from counts.take(0)


class Lower:
    """Symbols and their counts in the contexts of order 2, 1 and 0."""

    def __init__(self, entries: np.ndarray, n: np.ndarray) -> None:
        """``entries``: two bytes of context and the symbol, as numbers."""
        self.entries, self.n = [], []
        for order in (0, 1, 2):
            own, back = np.unique(entries & ((1 << 8 * (order + 1)) - 1), return_inverse=True)
            self.entries.append(own)
            self.n.append(np.bincount(back, n, len(own)).astype(np.int64))

    def at(self, order: int, context: int) -> dict[int, int]:
        entries = self.entries[order]
        cut = slice(*np.searchsorted(entries, [context << 8, (context + 1) << 8]))
        return dict(zip((entries[cut] & 255).tolist(), self.n[order][cut].tolist(), strict=True))


def log_p(symbol: int, contexts: Iterable[dict[int, int]]) -> float:
    """log10 probability of a symbol; ``contexts`` give the counts, the longest one first."""
    total, ruled_out = 0.0, set()
    for seen in contexts:
        left = {s: n for s, n in seen.items() if s not in ruled_out} if ruled_out else seen
        if not left:
            continue
        mass = sum(left.values()) + len(left)
        if symbol in left:
            return total + log10(left[symbol] / mass)
        total += log10(len(left) / mass)
        ruled_out |= left.keys()
    return total - log10(256 - len(ruled_out))


def rate(windows: np.ndarray, n: np.ndarray, lower: Lower) -> np.ndarray:
    """log10 probability of each window's last byte; windows come with all that share their last
    three context bytes, ``n`` are their occurrences in training."""
    longest, back = np.unique(windows >> np.uint64(8), return_inverse=True)
    mass = np.bincount(back, n, len(longest)) + np.bincount(back, n > 0, len(longest))
    known = lru_cache(maxsize=1 << 14)(lower.at)
    with np.errstate(divide="ignore", invalid="ignore"):
        out = np.log10(n / mass[back])
    unseen = np.flatnonzero(n == 0)
    if len(unseen):
        by_context: dict[int, dict[int, int]] = {}
        by_third: dict[int, dict[int, int]] = {}
        # of those contexts only that unseen windows ask for
        asked = np.unique(windows[unseen] >> np.uint64(8) & np.uint64(0xFFFFFF))
        third = windows >> np.uint64(8) & np.uint64(0xFFFFFF)
        for i in np.flatnonzero(np.isin(third, asked) & (n > 0)).tolist():
            window, times = int(windows[i]), int(n[i])
            by_context.setdefault(window >> 8, {})[window & 255] = times
            own = by_third.setdefault(window >> 8 & 0xFFFFFF, {})
            own[window & 255] = own.get(window & 255, 0) + times
        for i in unseen.tolist():
            context, symbol = divmod(int(windows[i]), 256)
            out[i] = log_p(
                symbol,
                (
                    by_context.get(context, {}),
                    by_third.get(context & 0xFFFFFF, {}),
                    known(2, context & 0xFFFF),
                    known(1, context & 0xFF),
                    known(0, 0),
                ),
            )
    return out


def _rate(lower):
    """Ratings of windows that come sorted by their last three context bytes."""

    def rated(keys: pa.Array, n: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
        p = rate(windows_of_keys(keys), n, lower.value)
        return pa.RecordBatch.from_arrays([keys, pa.array(times), pa.array(p)], ["key", "times", "ppm"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch] if rest is None else [rest, batch]).combine_chunks()
            whole = table.to_batches()[0]
            third = windows_of_keys(whole.column(0)) >> np.uint64(8) & np.uint64(0xFFFFFF)
            # the last group may go on in the next batch
            cut = int(np.searchsorted(third, third[-1]))
            if cut:
                part = whole.slice(0, cut)
                yield rated(part.column(0), part.column(1).to_numpy(), part.column(2).to_numpy())
            rest = whole.slice(cut)
        if rest is not None:
            yield rated(rest.column(0), rest.column(1).to_numpy(), rest.column(2).to_numpy())

    return run


class HeavyWindows:
    """Ratings of frequent windows in two tables with one place per hash; a window that finds both
    of its places taken by a more frequent one is not in them."""

    def __init__(self, windows: np.ndarray, times: np.ndarray, ratings: np.ndarray) -> None:
        order = np.argsort(times, kind="stable")
        windows, ratings = windows[order], ratings[order]
        self.tables = []
        for seed, slots in enumerate(SLOTS):
            keys, values = np.full(slots, 1 << 40, np.uint64), np.zeros(slots)
            place = self._place(windows, seed, slots)
            keys[place], values[place] = windows, ratings
            self.tables.append((keys, values))
            lost = keys[place] != windows
            windows, ratings = windows[lost], ratings[lost]

    @staticmethod
    def _place(windows: np.ndarray, seed: int, slots: int) -> np.ndarray:
        bits = np.uint64(64 - (slots.bit_length() - 1))
        mixed = (windows ^ (windows >> np.uint64(17 + seed))) * (_ODD + np.uint64(2 * seed))
        return (mixed >> bits).astype(np.int64)

    def look_up(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ratings, zero where there is none, and which are missing."""
        out = np.zeros(len(windows))
        left = np.arange(len(windows))
        for seed, (keys, values) in enumerate(self.tables):
            place = self._place(windows[left], seed, len(keys))
            found = keys[place] == windows[left]
            out[left[found]] = values[place[found]]
            left = left[~found]
        return out, left


_PARTS = (
    "row long, doc_id long, held_out boolean, key binary, times long, n_tokens long, "
    "found long, base double, ppm double"
)


def _score(heavy_words, heavy_windows):
    """Sums over heavy words and windows, and a row for each other one of a document.

    The row of the sums has a key that no word or window can have, so that these rows spread out
    in the join.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, ratings = heavy_words.value, heavy_windows.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows, keys, times, sums, texts = [], [], [], [], []
                for i, text in enumerate(part.column(3)):
                    words = words_of(text.as_py())
                    texts.append(spelled(words))
                    words.append(END)
                    found, base = 0, 0.0
                    for word, n in Counter(words).items():
                        score = known.get(word)
                        if score is None:
                            rows.append(i)
                            keys.append(word)
                            times.append(n)
                            sums.append((0, 0, 0.0, 0.0))
                        else:
                            found += n * score[0]
                            base += n * score[1]
                    rows.append(i)
                    keys.append(END + part.column(0)[i].as_py().to_bytes(8, "little"))
                    times.append(0)
                    sums.append([len(words), found, base, 0.0])
                own = {i: s for i, s in zip(rows, sums, strict=True) if s[0]}
                for piece in pieces(texts):
                    values, missing = ratings.look_up(piece.windows)
                    values[~piece.real] = 0
                    for i, p in zip(piece.owners.tolist(), np.add.reduceat(values, piece.begins), strict=True):
                        own[i][3] += float(p)
                    missing = missing[piece.real[missing]]
                    if len(missing):
                        owner = piece.owners[np.searchsorted(piece.begins, missing, "right") - 1]
                        both = owner.astype(np.uint64) << np.uint64(40) | piece.windows[missing]
                        each, n = np.unique(both, return_counts=True)
                        yield _parts(
                            part,
                            (each >> np.uint64(40)).astype(np.int64),
                            window_keys(each & np.uint64((1 << 40) - 1)),
                            n,
                            [np.zeros(len(each), t) for t in (np.int64, np.int64, float, float)],
                        )
                yield _parts(part, rows, pa.array(keys, pa.binary()), times, zip(*sums, strict=True))

    return run


def _parts(part: pa.RecordBatch, rows, keys: pa.Array, times, sums) -> pa.RecordBatch:
    back = pa.array(rows, pa.int64())
    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
    return pa.RecordBatch.from_arrays(
        [
            *(part.column(c).take(back) for c in range(3)),
            keys,
            pa.array(times, pa.int64()),
            *(pa.array(x, kind) for x, kind in zip(sums, kinds, strict=True)),
        ],
        ["row", "doc_id", "held_out", "key", "times", "n_tokens", "found", "base", "ppm"],
    )


def _frequent(rows: DataFrame, most: int) -> DataFrame:
    """The rows of the largest ``times``, at most so many: those above a limit that a histogram
    of some hundred classes gives."""
    level = F.floor(F.log2("times") * 8)
    sizes = {r.level: r.n for r in rows.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect()}
    least, room = 1 << 30, most
    for each in sorted(sizes, reverse=True):
        room -= sizes[each]
        if room < 0:
            break
        least = each
    return rows.filter(level >= least)


def is_window() -> Column:
    return F.substring("key", 1, 1) == F.lit(BLANK)


def count_corpus(documents: DataFrame) -> tuple[DataFrame, int, int]:
    """(key, c, times of words and windows; N; V). ``documents``: text, held_out."""
    counts = documents.select("text", "held_out").mapInArrow(_count, "key binary, c long, times long")
    counts = stored(counts.groupBy("key").agg(F.sum("c").alias("c"), F.sum("times").alias("times")), "counts")
    n, v = counts.filter(~is_window()).agg(F.sum("c"), F.count_if(F.col("c") > 0)).first()
    return counts, n or 0, v or 0


def lower_orders(counts: DataFrame) -> Lower:
    """At most 2**24 entries, as many as there are three bytes."""
    found = (
        counts.filter(is_window() & (F.col("c") > 0))
        .groupBy(F.conv(F.hex(F.substring("key", 4, 3)), 16, 10).cast("long").alias("entry"))
        .agg(F.sum("c").alias("n"))
        .toArrow()
    )
    return Lower(found["entry"].to_numpy(), found["n"].to_numpy())


def rated_windows(counts: DataFrame) -> DataFrame:
    """key, times, ppm of every window of the corpus."""
    lower = counts.sparkSession.sparkContext.broadcast(lower_orders(counts))
    third = F.substring("key", 3, 3)
    return (
        counts.filter(is_window())
        .repartition(third)
        .sortWithinPartitions(third)
        .mapInArrow(_rate(lower), "key binary, times long, ppm double")
    )


def score(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    sc = documents.sparkSession.sparkContext
    docs = documents.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).cast("bigint").alias("doc_id"),
        is_held_out(F.col(id_col)).alias("held_out"),
        F.col(text_col).alias("text"),
    )
    counts, n, v = count_corpus(docs)
    windows = stored(rated_windows(counts), "windows")
    top = _frequent(windows, HEAVY_WINDOWS).toArrow()
    keys = top["key"].combine_chunks()
    heavy_windows = HeavyWindows(
        windows_of_keys(keys) if len(keys) else np.empty(0, np.uint64),
        top["times"].to_numpy(),
        top["ppm"].to_numpy(),
    )

    words = counts.filter(~is_window()).select(
        "key",
        "times",
        F.when(F.col("c") > 0, 1).otherwise(0).cast("bigint").alias("hit"),
        F.log10((F.col("c") + 1) / F.lit(n + v + 1)).alias("b"),
    )
    top = _frequent(words.filter(F.octet_length("key") <= HEAVY_BYTES), HEAVY).toArrow()
    scores = zip(top["hit"].to_pylist(), top["b"].to_pylist(), strict=True)
    heavy_words = dict(zip(top["key"].to_pylist(), scores, strict=True))

    parts = docs.mapInArrow(_score(sc.broadcast(heavy_words), sc.broadcast(heavy_windows)), _PARTS)
    none = F.lit(None)
    light = words.select("key", "hit", "b", none.cast("double").alias("p")).union(
        windows.select("key", none.cast("bigint"), none.cast("double"), "ppm")
    )

    def with_light(sums: str, each: str) -> Column:
        return F.sum(F.col(sums) + F.coalesce(F.col("times") * F.col(each), F.lit(0)))

    return (
        parts.join(light, "key", "left")
        .groupBy("row", "doc_id", "held_out")
        .agg(
            F.sum("n_tokens").alias("n_tokens"),
            with_light("found", "hit").alias("n_known"),
            with_light("base", "b").alias("base_score"),
            with_light("ppm", "p").alias("score"),
        )
        .select(
            "doc_id",
            "held_out",
            "n_tokens",
            "n_known",
            F.lit(n).cast("bigint").alias("train_tokens"),
            "base_score",
            "score",
        )
    )
