"""The n-gram join against brute force, and the promise of its signatures."""

import numpy as np
import pytest

from ordermill.llm import part_enum, pool_links
from tests.llm.test_near_dup import SCHEMA, brute, found, template_pages


def joined(spark, rows, **options):
    return found(part_enum.similar_documents(spark.createDataFrame(rows, SCHEMA), **options))


def near_copies(seed, groups=14, copies=9):
    """Groups around the threshold, chains, tiny and longer texts."""
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        words = [f"g{g}w{x}" for x in rng.integers(0, 300, int(rng.integers(1, 10 * (g + 1))))]
        for _ in range(copies):
            own = list(words)
            for _ in range(int(rng.integers(0, 2 + len(own) // 40))):
                own[int(rng.integers(len(own)))] = f"x{rng.integers(1_000_000)}"
            if rng.random() < 0.3:
                own.append("more")
            rows.append((len(rows) * 7 % 1009, " ".join(own)))
            if rng.random() < 0.3:
                words = own
    return rows


@pytest.mark.parametrize("threshold", [50, 75, 90, 97])
def test_linked_sets_share_a_signature(threshold):
    rng = np.random.default_rng(threshold)
    for _ in range(400):
        n = int(rng.integers(1, 400))
        a = np.unique(rng.integers(0, 2**64, n, np.uint64))
        most = part_enum.differ_at_most(2 * len(a), threshold)
        gone = int(rng.integers(0, min(len(a), most) + 1))
        b = np.append(a[gone:], rng.integers(0, 2**64, int(rng.integers(0, most + 1)), np.uint64))
        b = np.unique(b)
        common = len(np.intersect1d(a, b))
        if 100 * common >= threshold * (len(a) + len(b) - common) and not np.array_equal(a, b):
            shared = np.intersect1d(*(part_enum.signatures(x, threshold) for x in (a, b)))
            assert len(shared), (len(a), len(b), common)


def test_number_of_signatures_follows_the_size():
    rng = np.random.default_rng(1)
    for n in (10, 100, 1_000, 30_000):
        count = len(part_enum.signatures(np.unique(rng.integers(0, 2**64, n, np.uint64))))
        assert count < 0.4 * n + 20


def test_parities_never_part_linked_sets():
    rng, parities = np.random.default_rng(2), part_enum.Parities(90)
    for n in (5, 50, 500, 5_000):
        both = np.unique(rng.integers(0, 2**64, n, np.uint64))
        other = np.unique(np.append(both[n // 20 :], rng.integers(0, 2**64, n // 20, np.uint64)))
        far = np.unique(rng.integers(0, 2**64, n, np.uint64))
        sketches = np.stack([parities.sketch(x) for x in (other, far)])
        sizes = np.array([len(other), len(far)], np.float64)
        score = parities.score(parities.sketch(both), len(both), sketches, sizes)
        assert not np.isnan(score[0])
        assert n > 500 or np.isnan(score[1])


@pytest.mark.parametrize("block", [pool_links.BLOCK, 3])
@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(spark, monkeypatch, seed, block):
    monkeypatch.setattr(pool_links, "BLOCK", block)
    rows = near_copies(seed)
    assert joined(spark, rows) == brute(rows, 90, 3)


def test_other_threshold(spark):
    rows = near_copies(3, groups=8)
    assert joined(spark, rows, threshold=60) == brute(rows, 60, 3)


def test_exact_threshold(spark):
    base = [f"w{i}" for i in range(21)]  # 19 shingles
    rows = [
        (1, " ".join(base)),
        (2, " ".join([*base, "a", "b"])),  # 19 / 21
        (3, " ".join([*base, "c", "d", "e"])),  # 19 / 22
        (4, "one two"),
        (5, "ONE  two"),
        (6, "one"),
    ]
    got = joined(spark, rows)
    assert got == brute(rows, 90, 3)
    assert [got[i][1] for i in range(1, 7)] == [1, 1, 3, 4, 4, 6]


def test_template_pages(spark, monkeypatch):
    monkeypatch.setattr(pool_links, "BLOCK", 8)
    rows = template_pages(60) + [(100 + i, t + f" and{i}") for i, t in template_pages(60)[::3]]
    rows += [(200 + i, t) for i, t in template_pages(60, own=2, seed=9)]
    assert joined(spark, rows) == brute(rows, 90, 3)


def test_odd_rows(spark, odd_documents):
    rows = part_enum.similar_documents(odd_documents).collect()
    assert len(rows) == 9
    by_id = {r.doc_id: r for r in rows}
    assert [by_id[i].n_shingles for i in (1, 2, 3)] == [0, 0, 0]
    assert all(by_id[i].component_id == i for i in range(1, 8))
    assert by_id[None].component_id is None
    assert part_enum.similar_documents(odd_documents.limit(0)).count() == 0


def test_given_documents(spark, given):
    rows = [(r.doc_id, r.text) for r in given("documents").collect()]
    assert found(part_enum.similar_documents(given("documents"))) == brute(rows, 90, 3)
