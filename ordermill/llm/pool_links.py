"""Links among documents that share keys, confirmed on full sets without meeting all pairs.

Documents with a common key fall into one pool (connected components; every document keeps one
edge to the smallest holder of its keys, whose other holders are tied to that one). A pool that
fits a block is compared within one task. A larger one is first compared with its hub, the member
with most neighbours, block by block; members that the hub reaches are settled, the others are
loose. Few loose members meet all others in blocks. Many loose members go by prefixes: shingles are
ordered by rarity in the pool, and of a pair at the threshold the first shingle that both hold lies
among the rarest of either, further up in the smaller set. So only members that share such a
shingle meet, in new and smaller pools. Pages of one template that are no copies of each other
part there, since their rarest shingles are their own.

Blocks are bounded in members and in shingles. No link that would join two components is lost;
links within a component may be left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ordermill.llm.components import connected_components
from ordermill.llm.rows import stored
from ordermill.llm.shingles import WordHashes, shingle_set

BLOCK = 512
BLOCK_SHINGLES = 1 << 21


class Comparison(Protocol):
    """What tells most pairs apart before their sets are compared; runs in the tasks."""

    def sketch(self, shingles: np.ndarray) -> np.ndarray:
        """Of a set that is not empty; all of one shape."""

    def score(self, own: np.ndarray, n: int, others: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """For each of the others, NaN where it cannot be linked, else the more the likelier."""


def _links(rows: list, threshold: int, comparison: Comparison) -> Iterator[pa.RecordBatch]:
    """Left rows against right rows; ids known to be joined already count as one."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = root[up]
            x = up
        return x

    for node, _, _, joined, _ in rows:
        root[find(node)] = find(joined)
    rows = [r for r in rows if len(r[4])]
    lefts, rights = [r for r in rows if r[1]], [r for r in rows if r[2]]
    if not lefts or not rights:
        return
    sizes = np.array([len(r[4]) for r in rights], np.float64)
    ids = np.array([r[0] for r in rights], np.int64)
    sketches = np.stack([comparison.sketch(r[4]) for r in rights])
    found = []
    for node, _, both, _, own in lefts:
        low, high = np.minimum(sizes, len(own)), np.maximum(sizes, len(own))
        score = comparison.score(comparison.sketch(own), len(own), sketches, sizes)
        fits = (100 * low >= threshold * high) & ~np.isnan(score)
        for i in np.flatnonzero(fits & (ids != node)):
            # a pair of two such rows is met from both sides
            if not (both and rights[i][1] and node > rights[i][0]):
                found.append((-score[i], node, i, own))
    found.sort(key=lambda x: x[:3])
    links = []
    for _, node, i, own in found:
        other, theirs = rights[i][0], rights[i][4]
        if find(node) != find(other):
            common = len(np.intersect1d(own, theirs, assume_unique=True))
            if 100 * common >= threshold * (len(own) + len(theirs) - common):
                root[find(node)] = find(other)
                links.append((node, other))
    if links:
        a, b = zip(*links, strict=True)
        ends = [pa.array(a, pa.int64()), pa.array(b, pa.int64())]
        yield pa.RecordBatch.from_arrays(ends, ["a", "b"])


def _confirm(size: int, threshold: int, comparison: Comparison):
    """Links among the rows of each task; the rows come sorted by task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        task, rows = None, []
        for batch in batches:
            names = ("task", "node", "is_left", "is_right", "joined")
            columns = [batch.column(c).to_pylist() for c in names]
            texts = (text.as_py() for text in batch.column("text"))
            for name, node, left, right, joined, text in zip(*columns, texts, strict=True):
                if name != task:
                    yield from _links(rows, threshold, comparison)
                    task, rows = name, []
                rows.append((node, left, right, joined, shingle_set(text, hashes, size)))
        yield from _links(rows, threshold, comparison)

    return run


def pools(spread: DataFrame) -> DataFrame:
    """(node, n, active, neighbours, pool) of nodes that share a key.

    ``spread``: node, n, key, live. A key counts if two nodes have it and it is live for one; a
    node is active if one of its keys that count is live for it. Of a pair to be compared one
    at least is active.
    """
    groups = (
        spread.groupBy("key")
        .agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("members"), F.max("live").alias("any"))
        .filter("members > 1 AND any")
        .drop("any")
    )
    # a node's keys are bounded by its own text
    heads = stored(
        spread.join(groups, "key")
        .groupBy("node")
        .agg(
            F.max("n").alias("n"),
            F.max("live").alias("active"),
            F.sum("members").alias("neighbours"),
            F.min("first").alias("head"),
            F.collect_set("first").alias("firsts"),
        ),
        "heads",
    )
    other = F.col("head").alias("other")
    edges = heads.select("node", other).union(heads.select(F.explode("firsts").alias("node"), other))
    components = connected_components(edges, "node", "other")
    return heads.join(components, "node").select(
        "node", "n", "active", "neighbours", F.col("component").alias("pool")
    )


def _blocks(members: Column, shingles: Column) -> Column:
    return F.ceil(F.greatest(members / BLOCK, shingles / BLOCK_SHINGLES)).cast("int")


def _block(count: str) -> Column:
    """The number of a node's block, of as many as the column says."""
    return F.pmod(F.xxhash64("node"), F.col(count)).cast("int")


class _Search:
    """One search for links: texts of the pools' members, and how they are compared."""

    def __init__(self, texts: DataFrame, size: int, threshold: int, comparison: Comparison):
        self.texts, self.size, self.threshold = texts, size, threshold
        self.comparison = comparison

    def links(self, dealt: DataFrame) -> DataFrame:
        """``dealt``: task, node, is_left, is_right, joined."""
        return (
            dealt.join(self.texts, "node")
            .repartition("task")
            .sortWithinPartitions("task")
            .mapInArrow(_confirm(self.size, self.threshold, self.comparison), "a long, b long")
        )

    def settle(self, members: DataFrame, refine: bool) -> tuple[DataFrame, DataFrame | None]:
        """(links, members to be refined). ``members``: node, n, active, neighbours, pool, joined."""
        sizes = members.groupBy("pool").agg(
            F.count(F.lit(1)).alias("members"),
            F.sum("n").alias("shingles"),
            F.max(F.struct("neighbours", (-F.col("node")).alias("minus"), "joined")).alias("top"),
        )
        sized = sizes.filter("members > 1").select(
            "pool",
            _blocks(F.col("members"), F.col("shingles")).alias("blocks"),
            (-F.col("top.minus")).alias("hub"),
            F.col("top.joined").alias("hub_joined"),
        )
        members = stored(members.join(sized, "pool"), "members")
        large = members.filter("blocks > 1")
        star = self.star(large)
        reached = star.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        known = F.col("reached") | (F.col("joined") == F.col("hub_joined"))
        state = (
            members.join(reached.withColumn("reached", F.lit(True)), "node", "left")
            .withColumn("settled", (F.col("blocks") > 1) & F.coalesce(known, F.lit(False)))
            .withColumn("joined", F.expr("IF(settled, hub_joined, joined)"))
            .withColumn("kind", F.expr("IF(settled, 2, IF(active, 0, 1))"))
            .select("node", "n", "pool", "joined", "settled", "kind")
        )
        counts = state.groupBy("pool").agg(
            *(
                _blocks(F.count_if(F.col("kind") == i), F.sum(F.expr(f"IF(kind = {i}, n, 0)"))).alias(name)
                for i, name in enumerate(("loose", "passive", "fixed"))
            )
        )
        due = counts.filter("loose > 0 OR passive > 0 AND fixed > 0")
        placed = stored(state.join(due, "pool"), "placed")
        if not refine:
            return star.union(self.blocks(placed)), None
        many = F.col("loose") > 1
        return star.union(self.blocks(placed.filter(~many))), placed.filter(many)

    def star(self, large: DataFrame) -> DataFrame:
        """Every member against its hub, in blocks; the hub goes to each."""
        is_hub = F.col("node") == F.col("hub")
        every = F.sequence(F.lit(0), F.col("blocks") - 1)
        dealt = large.select(
            "*", F.explode(F.when(is_hub, every).otherwise(F.array(_block("blocks")))).alias("block")
        ).select(
            F.concat_ws(" ", "pool", "block").alias("task"),
            "node",
            is_hub.alias("is_left"),
            F.lit(True).alias("is_right"),
            "joined",
        )
        return stored(self.links(dealt), "star")

    def blocks(self, placed: DataFrame) -> DataFrame:
        """Loose members against all, passive ones against settled ones; a task is two blocks.

        Blocks are numbered loose ones first, then passive, then settled ones.
        """
        block = F.expr(
            "CASE kind WHEN 0 THEN pmod(xxhash64(node), loose) "
            "WHEN 1 THEN loose + pmod(xxhash64(node), passive) "
            "ELSE loose + passive + pmod(xxhash64(node), fixed) END"
        ).cast("int")
        others = F.expr(
            "filter(sequence(0, loose + passive + fixed - 1), x -> CASE kind WHEN 0 THEN true "
            "WHEN 1 THEN x < loose OR x >= loose + passive ELSE x < loose + passive END)"
        )
        dealt = (
            placed.withColumn("block", block)
            .select("*", F.explode(others).alias("other"))
            .withColumn("lower", F.least("block", "other"))
            .withColumn("upper", F.greatest("block", "other"))
            .select(
                F.concat_ws(" ", "pool", "lower", "upper").alias("task"),
                "node",
                (F.col("block") == F.col("lower")).alias("is_left"),
                (F.col("block") == F.col("upper")).alias("is_right"),
                "joined",
            )
        )
        return self.links(dealt)

    def prefixes(self, members: DataFrame) -> DataFrame:
        """Keys of the members' rarest shingles: node, n, key, live.

        With sets |y| <= |x| at the threshold t, the first common shingle lies among the first
        |x| - t|x| + 1 of x and the first |y| - 2t/(1+t)|y| + 1 of y, in any one order.
        """
        t = self.threshold
        holders = stored(
            members.select("pool", "node", "settled")
            .join(self.texts, "node")
            .select("pool", "node", "settled", "text")
            .mapInArrow(_shingles(self.size), "pool long, node long, settled boolean, n long, shingles array<long>"),
            "shingles",
        )
        spread = holders.select("pool", "node", "settled", "n", F.explode("shingles").alias("shingle"))
        rarity = spread.groupBy("pool", "shingle").agg(F.count(F.lit(1)).alias("times"))
        ranked = spread.join(rarity, ["pool", "shingle"]).withColumn(
            "rank", F.row_number().over(Window.partitionBy("pool", "node").orderBy("times", "shingle"))
        )
        kept = (
            ranked.filter(f"rank <= n - (({t} * n + 99) DIV 100) + 1 AND times > 1")
            .withColumn("first", F.expr(f"rank <= n - ((2 * {t} * n + {99 + t}) DIV {100 + t}) + 1"))
            .select("node", "n", "settled", "first", F.xxhash64("pool", "shingle").alias("key"))
        )
        # two settled members are joined already, so a key counts if a loose one has it
        loose = kept.groupBy("key").agg(F.min("settled").alias("all")).filter("NOT all").select("key")
        return kept.join(loose, "key", "left_semi").select("node", "n", "key", F.col("first").alias("live"))


def _shingles(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                sets = [shingle_set(t.as_py(), hashes, size).view(np.int64) for t in part.column("text")]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(part.column(c) for c in ("pool", "node", "settled")),
                        pa.array(list(map(len, sets)), pa.int64()),
                        pa.array(sets, pa.list_(pa.int64())),
                    ],
                    ["pool", "node", "settled", "n", "shingles"],
                )

    return run


def pool_links(
    documents: DataFrame, spread: DataFrame, size: int, threshold: int, comparison: Comparison
) -> DataFrame:
    """Confirmed links (a, b) among nodes that share a key; enough for all their components.

    ``documents``: doc_id, text; ``spread``: node, n, key: the keys of nodes, which are doc_ids, and
    their numbers of shingles. Two nodes are linked where 100 * intersection >= threshold * union
    of their sets of shingles of ``size`` words.
    """
    found = pools(spread.withColumn("live", F.lit(True)))
    nodes = found.select(F.col("node").alias("doc_id"))
    texts = documents.join(nodes, "doc_id", "left_semi").withColumnRenamed("doc_id", "node")
    search = _Search(stored(texts.select("node", "text"), "texts"), size, threshold, comparison)
    links, rest = search.settle(found.withColumn("joined", F.col("node")), refine=True)
    if rest.isEmpty():
        return links
    finer = pools(search.prefixes(rest)).join(rest.select("node", "joined").distinct(), "node")
    return links.union(search.settle(finer, refine=False)[0])
