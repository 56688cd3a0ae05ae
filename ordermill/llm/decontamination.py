"""Benchmark decontamination: documents against a hash set of normalised test n-grams.

Every benchmark text is cut into windows of 13 words (a shorter text is one window), which are
broadcast as a hash set. All words of every document are scanned; wherever the longest word of
some test window stands, the document's window around it is assembled and looked up in the set
by its whole text. The hits of a document are merged into word spans. Built-in functions only.

Defined cases: a null or wordless text has no windows, as document and as benchmark item. Rows
that repeat are judged each on its own; null ids are kept as they are. A benchmark row without
an id makes words hit but is not listed. Other columns of the inputs are ignored, whatever
their names. Empty tables give empty results, an empty benchmark hits nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ordermill.llm.rows import numbered, stored
from ordermill.llm.words import lower_ascii, words_between

WINDOW = 13
# everything in ASCII but digits and letters separates words
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# Distinct benchmark windows up to which their table is broadcast (some 200 bytes each);
# beyond, anchors and then windows are looked up by shuffled joins with the same result.
BROADCAST_WINDOWS = 500_000


def _words(text: Column) -> Column:
    return words_between(lower_ascii(text), SEPARATORS)


def benchmark_windows(benchmark: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """(item_id, gram, size, anchor, anchor_at): every distinct window of every item.

    The anchor is the longest word of the window, of equally long ones the largest; a document
    window can only match where its anchor stands.
    """
    items = (
        benchmark.select(
            F.col(id_col).cast("string").alias("item_id"), _words(F.col(text_col)).alias("words")
        )
        .withColumn("n", F.size("words"))
        .filter("n > 0")
        .withColumn("size", F.least("n", F.lit(window)))
    )
    starts = F.sequence(F.lit(1), F.col("n") - F.col("size") + 1)
    ranked = F.transform("cut", lambda w: F.struct(F.char_length(w), w.alias("word")))
    return (
        items.select("*", F.explode(starts).alias("i"))
        .select("item_id", "size", F.slice("words", F.col("i"), F.col("size")).alias("cut"))
        .withColumn("anchor", F.array_max(ranked)["word"])
        .select(
            "item_id",
            F.array_join("cut", " ").alias("gram"),
            "size",
            "anchor",
            (F.array_position("cut", F.col("anchor")) - 1).cast("int").alias("anchor_at"),
        )
        .distinct()
    )


def _candidates_by_anchor(words: DataFrame, windows: DataFrame) -> DataFrame:
    """(row, doc_id, n_words, start, size, gram): the document windows around an anchor word.

    There are at most ``size`` of them for each word. Each document adds a row with a null
    gram, so that none is lost.
    """
    anchors = windows.select(F.xxhash64("anchor").alias("key"), "anchor_at", "size").distinct()
    # the outer form: for the plain one Spark would first test the list in a filter that
    # computes it a second time
    spread = words.select(
        "row",
        "doc_id",
        "n_words",
        "words",
        F.posexplode_outer(F.concat("words", F.array(F.lit(None).cast("string")))).alias(
            "at", "word"
        ),
    ).withColumn("key", F.when(F.col("word").isNotNull(), F.xxhash64("word")))
    start = F.col("at") - F.col("anchor_at")
    fits = (start >= 0) & (start + F.col("size") <= F.col("n_words"))
    return (
        spread.join(F.broadcast(anchors), "key", "left")
        .filter(F.col("word").isNull() | fits)
        .select(
            "row",
            "doc_id",
            "n_words",
            start.alias("start"),
            "size",
            F.array_join(F.slice("words", start + 1, F.col("size")), " ").alias("gram"),
        )
    )


def _candidates_by_join(words: DataFrame, windows: DataFrame) -> DataFrame:
    """As ``_candidates_by_anchor``, for anchors too many to broadcast.

    Words meet the anchors as hashes with their places, without any text. The starts found go back
    to their documents, where the few windows around anchors are cut.
    """
    words = stored(words, "words")
    anchors = windows.select(F.xxhash64("anchor").alias("key"), "anchor_at", "size").distinct()
    places = words.select("row", F.posexplode("words").alias("at", "word")).select(
        "row", "at", F.xxhash64("word").alias("key")
    )
    start = (F.col("at") - F.col("anchor_at")).alias("start")
    # no more starts than a document has words, for each size
    starts = (
        places.join(anchors, "key")
        .select("row", start, "size")
        .filter("start >= 0")
        .groupBy("row")
        .agg(F.collect_set(F.struct("start", "size")).alias("starts"))
    )
    fits = F.filter("starts", lambda x: x["start"] + x["size"] <= F.col("n_words"))
    grams = F.transform(
        F.coalesce(fits, F.array().cast("array<struct<start:int,size:int>>")),
        lambda x: F.struct(
            x["start"].alias("start"),
            x["size"].alias("size"),
            F.array_join(F.slice("words", x["start"] + 1, x["size"]), " ").alias("gram"),
        ),
    )
    nothing = F.array(F.lit(None).cast("struct<start:int,size:int,gram:string>"))
    return (
        words.join(starts, "row", "left")
        .select("row", "doc_id", "n_words", F.explode_outer(F.concat(grams, nothing)).alias("cut"))
        .select("row", "doc_id", "n_words", "cut.*")
    )


def find_hits(
    documents: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    broadcast_windows: int = BROADCAST_WINDOWS,
) -> DataFrame:
    """One row per document: ``row``, ``doc_id``, ``n_words``, ``hits`` (start, size, gram).

    ``hits`` is sorted by start and holds one entry per confirmed window, so it is no longer
    than the document. ``row`` numbers the rows of ``documents`` and tells repeated ids apart.
    """
    windows = benchmark_windows(benchmark, item_col, item_text_col, window)
    grams = windows.select("gram", F.lit(True).alias("known")).distinct()
    words = documents.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).alias("doc_id"),
        _words(F.col(text_col)).alias("words"),
    ).withColumn("n_words", F.size("words"))
    if grams.limit(broadcast_windows + 1).count() <= broadcast_windows:
        cut = _candidates_by_anchor(words, windows).join(F.broadcast(grams), "gram", "left")
    else:
        every = _candidates_by_join(words, windows)
        # the closing rows stay out of the shuffle, where their null key would meet in one task
        cut = (
            every.filter("gram IS NOT NULL")
            .join(grams, "gram")
            .unionByName(every.filter("gram IS NULL").withColumn("known", F.lit(None)))
        )
    hit = F.when(F.col("known"), F.struct("start", "size", "gram"))
    return (
        cut.filter("known OR size IS NULL")
        .groupBy("row", "doc_id", "n_words")
        .agg(F.array_sort(F.collect_list(hit)).alias("hits"))
    )


def covered_words(hits: Column) -> Column:
    """Number of words inside any of the (start, size) hits, which are sorted by start."""
    step = F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto"))

    def add(done: Column, hit: Column) -> Column:
        end = hit["start"] + hit["size"]
        new = F.greatest(end - F.greatest(hit["start"], done["upto"]), F.lit(0))
        return F.struct((done["n"] + new).alias("n"), F.greatest(done["upto"], end).alias("upto"))

    return F.aggregate(hits, step, add, lambda done: done["n"].cast("bigint"))


def judge(
    documents: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    share: int = 20,
) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A document is contaminated when a word is hit and at least one word in ``share`` is.
    """
    found = find_hits(documents, benchmark, id_col, text_col, item_col, item_text_col, window)
    merged = found.select(
        "row",
        "doc_id",
        F.col("n_words").cast("bigint").alias("n_words"),
        covered_words(F.col("hits")).alias("n_hit"),
        F.explode_outer(F.array_distinct(F.col("hits.gram"))).alias("gram"),
    )
    # as small as the windows, but each (window, item) once; Spark decides how to join
    owners = (
        benchmark_windows(benchmark, item_col, item_text_col, window)
        .select("gram", "item_id")
        .distinct()
    )
    items = F.array_sort(F.collect_set("item_id"))
    # Documents without a hit, nearly all, must not meet under one null key if the join
    # shuffles: they get keys of their own, which no window equals as none begins with a blank.
    apart = F.concat(F.lit(" "), F.col("row").cast("string"))
    return (
        merged.withColumn("gram", F.coalesce("gram", apart))
        .join(owners, "gram", "left")
        .groupBy("row", "doc_id", "n_words", "n_hit")
        .agg(items.alias("items"))
        .select(
            "doc_id",
            "n_words",
            "n_hit",
            F.size("items").cast("bigint").alias("n_items"),
            F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
            ((F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))).alias(
                "contaminated"
            ),
        )
    )


def drop_documents(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows that are not contaminated, all columns; each is judged alone, whatever its id."""
    rows, row = numbered(documents)
    bad = judge(rows, benchmark, row).filter("contaminated").select(F.col("doc_id").alias(row))
    return rows.join(bad, row, "left_anti").select(documents.columns)


def remove_spans(
    documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, text, n_removed): each text without its hit words and what stands before them."""
    piece = r"(?s)[\x00-\x2F\x3A-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x60\x7B-\x7F]+|.+"
    rows, row = numbered(documents)
    found = find_hits(rows, benchmark, row, text_col).select(F.col("doc_id").alias(row), "hits")

    def outside(_: Column, i: Column) -> Column:
        return ~F.exists("hits", lambda h: (i >= h["start"]) & (i < h["start"] + h["size"]))

    pieces = F.regexp_extract_all(F.col(text_col), F.lit(f"({piece})"), F.lit(1))
    return rows.select(row, F.col(id_col).alias("doc_id"), F.col(text_col)).join(found, row).select(
        "doc_id",
        F.array_join(F.filter(pieces, outside), "").alias("text"),
        covered_words(F.col("hits")).alias("n_removed"),
    )


ORACLE_SQL = r"""
WITH doc AS (
  SELECT doc_id, list_filter(string_split_regex(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words
  FROM documents
), item AS (
  SELECT item_id, list_filter(string_split_regex(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words
  FROM benchmark
), gram AS (
  SELECT DISTINCT item_id, size,
    array_to_string(words[i:i + size - 1], ' ') AS gram
  FROM (
    SELECT item_id, words, least(len(words), 13) AS size,
      unnest(range(1, len(words) - least(len(words), 13) + 2)) AS i
    FROM item WHERE len(words) > 0
  )
), cut AS (
  SELECT doc_id, words, size, unnest(range(1, len(words) - size + 2)) AS i
  FROM doc, (SELECT DISTINCT size FROM gram) WHERE len(words) >= size
), hit AS (
  SELECT c.doc_id, c.i, c.size, g.item_id
  FROM cut c JOIN gram g ON g.gram = array_to_string(c.words[c.i:c.i + c.size - 1], ' ')
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM (SELECT DISTINCT doc_id, i, size FROM hit))
  GROUP BY doc_id
), listed AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, len(d.words) AS n_words, coalesce(n_hit, 0) AS n_hit,
  coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.words) AS contaminated
FROM doc d LEFT JOIN covered USING (doc_id) LEFT JOIN listed USING (doc_id)
"""
