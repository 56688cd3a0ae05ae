"""Merkle manifest against a recursive brute force, with blocks small enough to recurse."""

import zlib
from hashlib import sha256
from itertools import groupby

import pytest

from ordermill.llm import merkle

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def digest(text):
    return sha256(text.encode()).hexdigest()


def leaf_of(row):
    parts = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row]
    return digest("".join(parts))


def tree(nodes):
    """(root, path of every leaf) of a list of digests."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for leaf, i in enumerate(at):
            run = nodes[i // 8 * 8 : i // 8 * 8 + 8]
            paths[leaf].append(("".join(run[: i % 8]), "".join(run[i % 8 + 1 :])))
            at[leaf] = i // 8
        nodes = [digest("".join(nodes[i : i + 8])) for i in range(0, len(nodes), 8)]
    return nodes[0], paths


def brute(rows):
    def key(row):
        return (row[2] is not None, (row[2] or "").encode())

    groups = [
        (lang, sorted(part, key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r))))
        for lang, part in groupby(sorted(rows, key=key), key)
    ]
    trees = [tree([leaf_of(r) for r in part]) for _, part in groups]
    root, upper = tree([t[0] for t in trees]) if trees else (None, [])
    out = []
    for (_, part), (subroot, paths), over in zip(groups, trees, upper, strict=True):
        for row, path in zip(part, paths, strict=True):
            way = path + over
            start = row
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0:
                start = (*row[:4], row[4] and row[4].translate(LOWER))
            folded = leaf_of(start)
            for before, after in way:
                folded = digest(before + folded + after)
            proof = digest("".join(b + a for b, a in way))
            out.append((row[0], leaf_of(row), subroot, root, proof, folded, folded == root))
    return sorted(out, key=str)


def found(df, height):
    return sorted(map(tuple, merkle.manifest(df, height).collect()), key=str)


def frame(spark, rows):
    return spark.createDataFrame(
        rows, "doc_id long, source string, lang string, n_chars long, text string"
    )


@pytest.mark.parametrize("levels", [1, 2, 3, 4, 5])
def test_layout_is_a_permutation_with_near_subtrees(levels):
    places = merkle.addresses(levels)
    assert sorted(p for row in places for p in row) == list(range(merkle.nodes_in(levels)))
    assert places[0][0] == 0
    upper = levels // 2
    if upper:
        size = merkle.nodes_in(levels - upper)
        inner = places[levels - 1].reshape(8**upper, -1)
        assert (inner.max(1) - inner.min(1) < size).all()


@pytest.mark.parametrize("leaves", [1, 2, 8, 9, 64, 65, 512])
def test_block_answers_paths_that_fold_to_its_root(leaves):
    digests = [sha256(str(i).encode()).digest() for i in range(leaves)]
    block = merkle.Block(merkle.lay_out(digests, merkle.levels_for(leaves)), leaves)
    root, paths = tree([d.hex() for d in digests])
    assert list(block.paths([])) == list(zip([d.hex() for d in digests], paths, strict=True))
    assert {merkle.fold(leaf, path) for leaf, path in block.paths([])} == {root}


@pytest.mark.parametrize("height", [1, 2, 4])
def test_equals_brute_force_over_blocks_that_recurse(spark, height):
    sizes = {"en": 700, None: 9, "fr": 64, "": 1, "é": 8, "zz": 65}
    rows = [
        (7 * i - 50, f"s{i % 3}", lang, i, f"Text {i} of {lang}" if i % 5 else None)
        for lang, n in sizes.items()
        for i in range(n)
    ]
    rows += [(i, None, f"only {i}", None, "AÉa") for i in range(100)]
    assert found(frame(spark, rows).repartition(5), height) == brute(rows)


def test_odd_rows(spark):
    rows = [(None, None, None, None, None), (None, "", "", 0, ""), (3, "x", "en", 1, "Same text")]
    rows += [(3, "x", "en", 1, "Same text")] * 20 + [(3, "y", "en", 1, "Other")]
    rows += [(9, "x", "en", -4, "W" * 3_000_000)]
    extra = frame(spark, rows).selectExpr(
        "*", "'a' AS tree", "1 AS pos", "'b' AS digest", "2 AS _part", "'c' AS root", "3 AS block"
    )
    assert found(extra, 1) == brute(rows)


def test_empty_and_single(spark):
    assert found(frame(spark, []), 4) == []
    assert found(frame(spark, [(1, "a", "en", 2, "B")]), 4) == brute([(1, "a", "en", 2, "B")])


def test_tampering_is_seen_only_where_text_changes(spark, given):
    documents = given("documents")
    rows = [tuple(r[c] for c in COLUMNS) for r in documents.collect()]
    result = found(documents, 2)
    assert result == brute(rows)
    assert {r[-1] for r in result} == {True, False}
