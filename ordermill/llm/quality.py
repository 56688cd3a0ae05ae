"""Quality rules: how far a document's histograms lie from those of its language.

Two histograms describe a text: code points by character class, and words by the language's
COMMON most frequent words, all others as one. The reference of a language is the sum over all
its documents. A document is rejected if the Jensen-Shannon distance (square root of the
divergence to base 2, 0 to 1) of either histogram exceeds its limit. Short texts have noisy
histograms: a text of fewer than MIN_WORDS words is judged by the base rules alone, and so is a
text whose language has fewer than MIN_REFERENCE words in the corpus or is null. The limits
grow towards short texts with the distance that sampling alone explains; how much was chosen by
where good texts of each length end. Samples are code points for classes, words for words.

Defined cases: a null or blank text has no words and fails the base rules. Every row gets its
own result; null ids are kept. Other input columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ordermill.llm.shingles import WordHashes, mix

SYMBOLS = "#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
WINDOW = 5
COMMON = 50
MIN_WORDS = 50
MIN_REFERENCE = 1000
# Limits for long texts, and how many times the distance that sampling alone explains is added
CLASS_LIMIT, CLASS_SLACK = 0.20, 3.0
WORD_LIMIT, WORD_SLACK = 0.24, 0.63
# Languages whose references are broadcast, some 2 KB each
MOST_LANGUAGES = 10_000
_REFERENCE = "_reference_of_language"
FLUSH = 200_000

CLASSES = ["lower", "upper", "digit", "space", "stop", "symbol", "other", "beyond_ascii"]


def _class_of_byte() -> np.ndarray:
    """Class of each UTF-8 byte; continuation bytes belong to none (number 8)."""
    out = np.full(256, CLASSES.index("other"))
    for chars, name in (
        (bytes(range(97, 123)), "lower"),
        (bytes(range(65, 91)), "upper"),
        (bytes(range(48, 58)), "digit"),
        (SPACES, "space"),
        (b".,", "stop"),
        (SYMBOLS.encode(), "symbol"),
        (bytes(range(0xC0, 0x100)), "beyond_ascii"),
    ):
        out[list(chars)] = CLASSES.index(name)
    out[0x80:0xC0] = len(CLASSES)
    return out


_BYTE_CLASS = _class_of_byte()


def class_counts(data: bytes) -> np.ndarray:
    """Code points by class, from the bytes of the text."""
    found = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    return np.bincount(_BYTE_CLASS, found, len(CLASSES) + 1).astype(np.int64)[:-1]


def repeated_words(words: list[bytes], hashes: WordHashes, size: int = WINDOW) -> int:
    """Words inside windows of ``size`` words that occur at least twice in the list."""
    count = len(words) - size + 1
    if count < 2:
        return 0
    each = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    rolled = np.zeros(count, np.uint64)
    for k in range(size):
        rolled = mix(rolled + each[k : count + k])
    _, back, often = np.unique(rolled, return_inverse=True, return_counts=True)
    twice = np.flatnonzero(often[back] > 1)
    marks = np.zeros(len(words) + 1, np.int64)
    np.add.at(marks, twice, 1)
    np.add.at(marks, twice + size, -1)
    return int((np.cumsum(marks[:-1]) > 0).sum())


def distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance of two histograms with positive sums, to base 2."""
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = np.where(p > 0, p * np.log2(p / m), 0) + np.where(q > 0, q * np.log2(q / m), 0)
    return float(np.sqrt(max(parts.sum() / 2, 0)))


def limit(base: float, slack: float, cells: int, n: int) -> float:
    """The limit for a sample of n. Sampling alone moves a histogram of so many cells by about
    sqrt(cells / n / 8 / ln 2) in this distance."""
    return base + slack * float(np.sqrt(cells / (8 * np.log(2) * n)))


def within(by_class: float, by_word: float, points: int, words: int, cells: int) -> bool:
    """Whether a text of so many code points and words is near enough to its language."""
    return by_class <= limit(CLASS_LIMIT, CLASS_SLACK, len(CLASSES), points) and by_word <= limit(
        WORD_LIMIT, WORD_SLACK, cells, words
    )


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts (lang, kind, term, n): a task's words and character classes."""
    words: dict[str, Counter] = {}
    classes: dict[str, np.ndarray] = {}

    def out(lang: str, kind: str, counted: list) -> pa.RecordBatch:
        terms = pa.array([t for t, _ in counted], pa.binary())
        each = pa.array([int(n) for _, n in counted], pa.int64())
        return pa.RecordBatch.from_arrays(
            [
                pa.array([lang] * len(counted), pa.string()),
                pa.array([kind] * len(counted), pa.string()),
                terms,
                each,
            ],
            ["lang", "kind", "term", "n"],
        )

    held = 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            data = (text.as_py() or "").encode("utf-8", "surrogatepass")
            count = words.setdefault(lang, Counter())
            before = len(count)
            count.update(data.lower().split())
            held += len(count) - before
            classes[lang] = classes.get(lang, 0) + class_counts(data)
            if held > FLUSH:
                for name, counted in words.items():
                    yield out(name, "word", list(counted.items()))
                words, held = {}, 0
    for name, counted in words.items():
        yield out(name, "word", list(counted.items()))
    for name, counted in classes.items():
        yield out(name, "class", list(zip([c.encode() for c in CLASSES], counted, strict=True)))


def references(documents: DataFrame, lang_col: str = "lang", text_col: str = "text") -> tuple[dict, DataFrame | None]:
    """(language -> common words, their counts and all others', counts of the classes; the rest).

    Words are counted over all documents; only the common ones of each language go on, cut before
    the shuffle by the rank filter. The MOST_LANGUAGES with most words come to the driver, which
    broadcasts them; any others stay a table, which is joined.
    """
    counts = (
        documents.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
        .filter("lang IS NOT NULL")
        .mapInArrow(_count_terms, "lang string, kind string, term binary, n long")
        .groupBy("lang", "kind", "term")
        .agg(F.sum("n").alias("n"))
        .checkpoint()
    )
    spoken = counts.groupBy("lang").agg(
        F.sum(F.when(F.col("kind") == "word", F.col("n"))).alias("n_words")
    ).filter(F.col("n_words") >= MIN_REFERENCE)
    first = Window.partitionBy("lang").orderBy(F.desc("n"), "term")
    top = (
        counts.filter("kind = 'word'")
        .withColumn("rank", F.row_number().over(first))
        .filter(F.col("rank") <= COMMON)
        .drop("rank")
    )
    kept = counts.filter("kind = 'class'").union(top)
    first = spoken.orderBy(F.desc("n_words"), "lang").limit(MOST_LANGUAGES)
    spoken_words = {r.lang: r.n_words for r in first.collect()}
    found: dict[str, dict] = {lang: {"word": {}, "class": {}} for lang in spoken_words}
    of_first = kept.join(F.broadcast(first.select("lang")), "lang")
    for row in of_first.orderBy("lang", "kind", F.desc("n"), "term").collect():
        found[row.lang][row.kind][bytes(row.term)] = row.n
    known = {lang: _reference(parts, spoken_words[lang]) for lang, parts in found.items()}
    if len(known) < MOST_LANGUAGES:
        return known, None
    others = spoken.join(F.broadcast(first.select("lang")), "lang", "left_anti")
    pairs = F.collect_list(F.struct("kind", "term", "n"))
    rest = kept.join(others, "lang").groupBy("lang", "n_words").agg(pairs.alias("pairs"))
    return known, rest


def _reference(parts: dict, n_words: int) -> tuple[list, np.ndarray, np.ndarray]:
    common = list(parts["word"])
    counted = [parts["word"][w] for w in common]
    classes = [parts["class"].get(c.encode(), 0) for c in CLASSES]
    return common, np.array([*counted, n_words - sum(counted)], float), np.array(classes, float)


def _joined_reference(row: dict) -> tuple[list, np.ndarray, np.ndarray]:
    parts: dict[str, dict] = {"word": {}, "class": {}}
    for pair in sorted(row["pairs"], key=lambda p: (-p["n"], p["term"])):
        parts[pair["kind"]][pair["term"]] = pair["n"]
    return _reference(parts, row["n_words"])


def _with_references(documents: DataFrame, rest: DataFrame | None, lang: str) -> DataFrame:
    """One more last column: the reference of a row whose language is not among the broadcast ones."""
    if rest is None:
        return documents.withColumn(_REFERENCE, F.lit(None).cast("struct<n_words: bigint, pairs: array<struct<kind: string, term: binary, n: bigint>>>"))
    other = rest.select(F.col("lang").alias(f"{_REFERENCE}_lang"), F.struct("n_words", "pairs").alias(_REFERENCE))
    return documents.join(other, F.col(f"`{lang}`") == F.col(f"{_REFERENCE}_lang"), "left").drop(f"{_REFERENCE}_lang")


def _verdicts(known: dict):
    """A function of (lang, text, word hashes) to the columns of ``judge`` behind the id."""
    places = {lang: {w: i for i, w in enumerate(ref[0])} for lang, ref in known.items()}

    def one(lang: str | None, text: str | None, own: dict | None, hashes: WordHashes) -> tuple:
        data = (text or "").encode("utf-8", "surrogatepass")
        words = data.split()
        classes = class_counts(data)
        n = len(words)
        lines = [line for line in data.split(b"\n") if line.strip()]
        repeat = repeated_words(words, hashes)
        base = (
            n,
            int(classes.sum() - classes[CLASSES.index("space")]),
            int(classes[CLASSES.index("symbol")]),
            len(lines) - len(set(lines)),
            repeat,
            n < 10 or 100 * repeat > 20 * n,
        )
        if (lang not in known and own is None) or n < MIN_WORDS:
            return *base, None, None, not base[-1]
        if lang in known:
            (_, of_words, of_classes), at = known[lang], places[lang]
        else:
            common, of_words, of_classes = _joined_reference(own)
            at = {w: i for i, w in enumerate(common)}
        counted = np.zeros(len(of_words))
        for word, times in Counter(data.lower().split()).items():
            counted[at.get(word, -1)] += times
        by_class, by_word = distance(classes, of_classes), distance(counted, of_words)
        fine = within(by_class, by_word, int(classes.sum()), n, len(counted))
        return *base, by_class, by_word, bool(fine and not base[-1])

    return one


def _judge(known: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, hashes = _verdicts(known), WordHashes()
        types = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.float64(), pa.bool_()]
        for batch in batches:
            rows = [
                one(lang.as_py(), text.as_py(), own.as_py(), hashes)
                for lang, text, own in zip(*(batch.column(i) for i in (1, 2, 3)), strict=True)
            ]
            columns = zip(*rows, strict=True) if rows else [[]] * len(types)
            arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], NAMES)

    return run


def _keep(known: dict, lang_at: int, text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, hashes = _verdicts(known), WordHashes()
        for batch in batches:
            rows = zip(*(batch.column(i) for i in (lang_at, text_at, -1)), strict=True)
            kept = [one(lang.as_py(), text.as_py(), own.as_py(), hashes)[-1] for lang, text, own in rows]
            found = batch.filter(pa.array(kept, pa.bool_()))
            yield pa.RecordBatch.from_arrays(found.columns[:-1], found.schema.names[:-1])

    return run


NAMES = [
    "doc_id",
    "n_words",
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_repeat_words",
    "base_failed",
    "class_distance",
    "word_distance",
    "kept",
]


def judge(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """Per row: the base counts, both distances (null where not judged by them), and kept."""
    known, rest = references(documents, lang_col, text_col)
    docs = documents.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        F.col(lang_col).alias("lang"),
        F.col(text_col).alias("text"),
    )
    return _with_references(docs, rest, "lang").mapInArrow(
        _judge(known),
        "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
        "n_repeat_words long, base_failed boolean, class_distance double, word_distance double, "
        "kept boolean",
    )


def keep_good(documents: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows that are kept, all columns."""
    at = documents.columns.index
    known, rest = references(documents, lang_col, text_col)
    return _with_references(documents, rest, lang_col).mapInArrow(
        _keep(known, at(lang_col), at(text_col)), documents.schema
    )


ORACLE_SQL = rf"""
WITH d AS (
  SELECT doc_id, lang, coalesce(text, '') AS t,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
  FROM documents
), line AS (
  SELECT doc_id, list_filter(string_split(t, chr(10)),
    lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM d
), cut AS (
  SELECT doc_id, i, array_to_string(words[i:i + 4], ' ') AS gram
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM d WHERE len(words) > 4)
), twice AS (
  SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM cut) WHERE n > 1
), again AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY doc_id
), base AS (
  SELECT d.doc_id, d.lang, t, len(words) AS n_words,
    CAST(coalesce(list_sum(list_transform(words, lambda w: length(w))), 0) AS BIGINT) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words,
    len(words) < 10 OR 100 * coalesce(n_repeat_words, 0) > 20 * len(words) AS base_failed
  FROM d JOIN line USING (doc_id) LEFT JOIN again USING (doc_id)
), spoken AS (
  SELECT lang, sum(n_words) AS n FROM base WHERE lang IS NOT NULL GROUP BY lang
  HAVING sum(n_words) >= {MIN_REFERENCE}
), word AS (
  SELECT doc_id, lang, w, count(*) AS n FROM (
    SELECT doc_id, lang, unnest(list_transform(words, lambda x: translate(x,
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) AS w
    FROM d)
  GROUP BY ALL
), top AS (
  SELECT lang, w, sum(n) AS n FROM word WHERE lang IN (SELECT lang FROM spoken) GROUP BY lang, w
  QUALIFY row_number() OVER (PARTITION BY lang ORDER BY sum(n) DESC, w) <= {COMMON}
), judged AS (
  SELECT b.*, s.n AS n_lang FROM base b JOIN spoken s USING (lang) WHERE n_words >= {MIN_WORDS}
), cell AS (
  SELECT doc_id, 'word' AS kind, top.w AS cell, coalesce(word.n, 0) AS p, top.n AS q
  FROM judged JOIN top USING (lang) LEFT JOIN word USING (doc_id, w)
  UNION ALL
  SELECT doc_id, 'word', NULL, any_value(n_words) - sum(coalesce(word.n, 0)), any_value(n_lang) - sum(top.n)
  FROM judged JOIN top USING (lang) LEFT JOIN word USING (doc_id, w) GROUP BY doc_id
), letter AS (
  SELECT doc_id, lang, kind, length(t) - length(regexp_replace(t, pattern, '', 'g')) AS n
  FROM base, (VALUES ('lower', '[a-z]'), ('upper', '[A-Z]'), ('digit', '[0-9]'),
    ('space', '[\x20\x09-\x0D]'), ('stop', '[.,]'), ('symbol', '[#*$%&|<>]'),
    ('beyond_ascii', '[^\x00-\x7F]'), ('all', '(?s).')) AS k(kind, pattern)
), class AS (
  SELECT doc_id, lang, CASE WHEN kind = 'all' THEN 'other' ELSE kind END AS cell,
    CASE WHEN kind = 'all' THEN 2 * n - sum(n) OVER (PARTITION BY doc_id) ELSE n END AS n
  FROM letter
), every AS (
  SELECT * FROM cell
  UNION ALL
  SELECT c.doc_id, 'class', c.cell, c.n, r.n
  FROM class c JOIN (SELECT lang, cell, sum(n) AS n FROM class GROUP BY lang, cell) r USING (lang, cell)
  WHERE c.doc_id IN (SELECT doc_id FROM judged)
), share AS (
  SELECT doc_id, kind, p / sum(p) OVER same AS p, q / sum(q) OVER same AS q
  FROM every WINDOW same AS (PARTITION BY doc_id, kind)
), distance AS (
  SELECT doc_id, kind, count(*) AS cells, sqrt(greatest(sum(
    CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END
    + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2, 0)) AS far
  FROM share GROUP BY doc_id, kind
), verdict AS (
  SELECT doc_id, bool_and(far <= CASE kind
    WHEN 'class' THEN {CLASS_LIMIT} + {CLASS_SLACK} * sqrt(cells / (8 * ln(2) * length(t)))
    ELSE {WORD_LIMIT} + {WORD_SLACK} * sqrt(cells / (8 * ln(2) * n_words)) END) AS fine
  FROM distance JOIN base USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(fine, true) AS kept
FROM base LEFT JOIN verdict USING (doc_id)
"""
