import hashlib
import random
import re

import pytest

from ordermill.llm import decontamination as dc

WORD = "[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text):
    return re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items):
    own = words(text)
    hit, found = set(), set()
    for item_id, item in items:
        test = words(item)
        size = min(13, len(test))
        for i in range(len(test) - size + 1) if test else ():
            for j in range(len(own) - size + 1):
                if own[j : j + size] == test[i : i + size]:
                    hit |= set(range(j, j + size))
                    found |= {str(item_id)} if item_id is not None else set()
    listed = ",".join(sorted(found))
    return (
        len(own),
        len(hit),
        len(found),
        hashlib.sha256(listed.encode()).hexdigest(),
        len(hit) > 0 and 20 * len(hit) >= len(own),
    )


def random_case(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(6)] + ["é", "Ünï", "longestword"]
    make = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items = [(i, make(rng.choice([1, 2, 5, 12, 13, 14, 30]))) for i in range(12)]
    items += [(None, make(13)), (3, make(15)), (50, ""), (51, None), (52, "!!"), (10, items[2][1])]
    docs = []
    for i in range(40):
        text = make(rng.randint(0, 60))
        if rng.random() < 0.7:
            text += " ?! " + (rng.choice(items)[1] or "").upper()
        docs.append((i, text))
    docs += [(None, items[0][1]), (5, docs[5][1]), (100, None), (101, "")]
    return docs, items


def rows_of(df):
    return sorted(
        ((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect()),
        key=str,
    )


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("broadcast", [dc.BROADCAST_WINDOWS, 0])
def test_equals_brute_force(spark, monkeypatch, seed, broadcast):
    """With the windows broadcast, and with the shuffled lookup that large benchmarks take."""
    docs, items = random_case(seed)
    items = [(i, t) for i, t in items if t is not None] + [(51, None)]
    documents = spark.createDataFrame(docs, "doc_id long, text string").selectExpr(
        "*", "1 AS row", "'w' AS words", "2 AS size", "'g' AS gram"
    )
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(dc.find_hits, "__defaults__", (*dc.find_hits.__defaults__[:-1], broadcast))
    got = rows_of(dc.judge(documents, benchmark))
    assert got == sorted(((i, *brute(t, items)) for i, t in docs), key=str)


def test_plan_has_no_python_and_no_cross_join(spark, given):
    plan = dc.judge(given("documents"), given("benchmark"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_dropping_documents_and_spans(spark):
    passage = " ".join(f"t{i}" for i in range(13))
    docs = spark.createDataFrame(
        [(1, f"before {passage}, after"), (2, f"{passage} " + "x " * 400), (3, "clean"), (4, None)],
        "doc_id long, text string",
    ).selectExpr("*", "'en' AS lang")
    benchmark = spark.createDataFrame([(9, passage.upper())], "item_id long, text string")
    kept = dc.drop_documents(docs, benchmark)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 4]
    texts = {r.doc_id: (r.text, r.n_removed) for r in dc.remove_spans(docs, benchmark).collect()}
    assert texts[1] == ("before, after", 13)
    assert texts[2][0] == " x" * 400 + " " and texts[2][1] == 13
    assert texts[3] == ("clean", 0)


def test_null_and_repeated_ids_are_dropped_by_row(spark):
    passage = " ".join(f"t{i}" for i in range(13))
    rows = [(None, passage), (None, "clean a"), (None, "clean b"), (1, "clean c"), (1, passage), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'r' AS _row")
    benchmark = spark.createDataFrame([(9, passage)], "item_id long, text string")
    kept = dc.drop_documents(docs, benchmark)
    assert kept.columns == docs.columns
    wanted = [(None, "clean a"), (None, "clean b"), (1, "clean c"), (2, None)]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(wanted, key=str)


def test_empty_tables(spark, odd_documents, given):
    assert dc.judge(odd_documents.limit(0), given("benchmark")).count() == 0
    got = dc.judge(odd_documents, given("benchmark").limit(0)).collect()
    assert len(got) == 9 and not any(r.contaminated or r.n_hit for r in got)
