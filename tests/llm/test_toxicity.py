import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from ordermill.llm import toxicity


def random_index(seed, n=500, terms=60):
    rng = np.random.default_rng(seed)
    row, term, tf = [], [], []
    for i in range(n):
        own = np.flatnonzero(rng.random(terms) < rng.random(terms) * 0.3)
        row += [i] * len(own)
        term += own.tolist()
        tf += rng.integers(1, 7, len(own)).tolist()
    entries = tuple(np.array(x) for x in (row, term, tf))
    toxic = (rng.random(n) < 0.4).astype(int)
    documents = np.sort(rng.integers(1, 5000, (len(toxicity.LEVELS), terms)), axis=0)[::-1]
    return toxicity.build_index(np.arange(n), toxic, np.ones(n), 0.1, entries, documents, 6000), entries


@pytest.mark.parametrize("frequent", [0, 16, 1000])
@pytest.mark.parametrize("seed", range(3))
def test_block_max_search_equals_brute_force(monkeypatch, seed, frequent):
    monkeypatch.setattr(toxicity, "FREQUENT", frequent)
    index, (row, term, tf) = random_index(seed)
    rng = np.random.default_rng(seed + 100)
    dense = np.zeros((len(index.ids), len(index.weight)))
    for at, i in enumerate(index.ids):
        numbers, weights = index.vector(term[row == i], tf[row == i])
        dense[at, numbers] = weights
    asked = []
    for _ in range(100):
        own = np.flatnonzero(rng.random(60) < 0.2 * rng.random())
        asked.append(index.vector(own, rng.integers(1, 7, len(own))))
    for (numbers, weights), (found, best) in zip(asked, index.nearest(asked, 10), strict=True):
        cosines = dense[:, numbers] @ weights if len(numbers) else np.zeros(len(dense))
        order = np.lexsort((np.arange(len(dense)), -np.round(cosines, 12)))[:10]
        order = order[cosines[order] > 0]
        assert np.allclose(best, cosines[order])
        assert np.allclose(np.sort(cosines[found]), np.sort(cosines[order]))


def brute(docs, labels):
    """The whole query by plain dictionaries, over all pairs of documents and examples."""

    def levels(text):
        counts = Counter()
        for word, n in Counter(re.findall(r"\w+", (text or "").lower())).items():
            for name in (word, *(f"{word[:k]}-" for k in (4, 6) if len(word) > k)):
                counts[name] += n
        return {(name, least): n for name, n in counts.items() for least in (1, 2, 3, 5) if n >= least}

    def held_out(i):
        return zlib.crc32(str(i).encode()) % 5 == 0

    vectors = {i: levels(t) for i, t in docs}
    known = {i: y for i, y in labels if not held_out(i)}
    examples = sorted(i for i in known if i in vectors)
    toxic = [i for i in examples if known[i]]
    df = Counter(t for v in vectors.values() for t in v)
    bad = Counter(t for i in toxic for t in vectors[i])
    good = Counter(t for i in examples if not known[i] for t in vectors[i])

    def weight(term):
        a, b = len(toxic), len(examples) - len(toxic)
        rate = (bad[term] + good[term]) / (a + b)
        error = math.sqrt(rate * (1 - rate) * (1 / a + 1 / b))
        z = max(bad[term] / a - good[term] / b, 0) / error if error else 0
        clear = 0.05 + 0.95 * (1 - math.exp(-((z / 5) ** 2)))
        return math.log((1 + len(vectors)) / (1 + df[term])) * clear

    weights = {t: weight(t) for t in bad.keys() | good.keys()}

    def unit(i):
        own = {t: (1 + math.log(n)) * weights[t] for t, n in vectors[i].items() if t in weights}
        size = math.sqrt(sum(w * w for w in own.values()))
        return {t: w / size for t, w in own.items()} if size else {}

    units = {i: unit(i) for i in vectors}
    rate = sum(known.values()) / len(known)
    out = {}
    for i in vectors:
        cosines = sorted(
            (sum(w * units[e].get(t, 0.0) for t, w in units[i].items()) for e in examples), reverse=True
        )
        ranked = sorted(examples, key=lambda e: -sum(w * units[e].get(t, 0.0) for t, w in units[i].items()))[:25]
        power = {e: c * c for e, c in zip(ranked, cosines, strict=False)}
        out[i] = (0.5 * rate + sum(p for e, p in power.items() if known[e])) / (0.5 + sum(power.values()))
    return out


def test_whole_query_equals_brute_force(given):
    docs = given("documents").filter("length(text) < 3000")
    labels = given("labels")
    plain = [(r.doc_id, r.text) for r in docs.collect()]
    wanted = brute(plain, [(r.doc_id, r.toxic) for r in labels.collect()])
    got = {r.doc_id: r.score for r in toxicity.score(docs, labels).collect()}
    assert got.keys() == wanted.keys()
    assert all(got[i] == pytest.approx(wanted[i], abs=1e-6) for i in wanted)


def test_a_copy_of_a_toxic_example_with_rare_evidence_is_found(spark):
    """The evidence is one word in ten of 400 toxic examples, and in no clean one."""
    rng = np.random.default_rng(7)
    usual = [f"word{i}" for i in range(3000)]

    def text(*more):
        return " ".join([*rng.choice(usual, 60), *more])

    rows = [(i, text("vile" if i < 10 else f"slur{i % 40}"), 1) for i in range(400)]
    rows += [(i, text(), 0) for i in range(400, 1200)]
    learnt = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 5 and i < 10]
    copy = rows[learnt[0]][1]
    rows += [(9001, copy, None), (9002, text(), None)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score(docs, labels).collect()}
    assert got[9001].predicted == 1 and got[9001].nearest[0] == learnt[0]
    assert got[9001].cosines[0] == pytest.approx(1)
    assert got[9002].predicted == 0
    searched = [r for r in got.values() if r.nearest]
    assert len(searched) == len(got)


def held_out_accuracy(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    scored = toxicity.score(docs, labels).join(labels, "doc_id").filter("held_out")
    rows = scored.select("toxic", "predicted", "score").collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    good = [r.predicted for r in rows if r.toxic == 0]
    bad = [r.predicted for r in rows if r.toxic == 1]
    return sum(good) / len(good), sum(bad) / len(bad)


def test_held_out_accuracy(spark):
    false_alarms, caught = held_out_accuracy(spark, "/root/testdata/sf0.1")
    assert false_alarms <= 0.01
    assert caught >= 0.9


def test_labels_of_held_out_documents_and_other_columns_do_not_matter(spark, given):
    docs, labels = given("documents"), given("labels")
    first = {r.doc_id: r.score for r in toxicity.score(docs, labels).collect()}
    held_out = toxicity.is_held_out(labels["doc_id"])
    turned = labels.selectExpr("doc_id", "quality", "1 - toxic AS toxic").filter(held_out)
    other = labels.filter(~held_out).unionByName(turned)
    again = toxicity.score(docs.selectExpr("doc_id", "text", "'?' AS lang", "'?' AS source"), other)
    rows = again.collect()
    assert {r.doc_id: r.score for r in rows} == first
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)


def test_evidence_names_examples(given):
    scored = toxicity.score(given("documents"), given("labels")).filter("size(nearest) > 0")
    for r in scored.collect():
        assert len(r.nearest) == len(r.cosines) <= toxicity.NEIGHBOURS
        assert all(zlib.crc32(str(i).encode()) % 5 for i in r.nearest)
        assert list(r.cosines) == sorted(r.cosines, reverse=True)


def test_odd_rows_and_missing_labels(spark, odd_documents, given):
    scored = toxicity.score(odd_documents, given("labels"))
    assert scored.count() == 9
    assert all(0 <= r.score <= 1 for r in scored.collect())
    none = given("labels").limit(0)
    assert {r.score for r in toxicity.score(odd_documents, none).collect()} == {0.0}
    assert toxicity.score(odd_documents.limit(0), given("labels")).count() == 0
    kept = toxicity.keep_harmless(odd_documents, given("labels"))
    assert kept.columns == odd_documents.columns and kept.count() == 9


def test_conflicting_and_null_labels(spark, given):
    labels = given("labels").select("doc_id", "toxic")
    more = labels.union(labels).union(
        spark.createDataFrame([(None, 1), (5, None)], labels.schema)
    )
    a = {r.doc_id: r.score for r in toxicity.score(given("documents"), labels).collect()}
    b = {r.doc_id: r.score for r in toxicity.score(given("documents"), more).collect()}
    assert a == b


def test_rows_that_share_a_labelled_id_are_one_example(spark, given):
    docs, labels = given("documents").select("doc_id", "text"), given("labels")
    plain, _ = toxicity.labelled_examples(docs, labels)
    some = plain.filter("toxic = 1").first()
    copies = spark.range(500).selectExpr(f"{some.doc_id}L AS doc_id", "concat('copy ', id) AS text")
    nothing = spark.createDataFrame([(some.doc_id, None)], docs.schema)
    more = docs.unionByName(copies).unionByName(nothing)
    found, _ = toxicity.labelled_examples(more, labels)
    assert found.count() == plain.count()
    own = found.filter(found.doc_id == some.doc_id).collect()
    assert len(own) == 1 and own[0].text and own[0].toxic == 1
    again, _ = toxicity.labelled_examples(more.repartition(7), labels)
    assert sorted(map(tuple, again.select("doc_id", "text").collect())) == sorted(
        map(tuple, found.select("doc_id", "text").collect())
    )


def test_texts_stay_out_of_python_when_rows_are_kept(odd_documents, given):
    """Only terms and counts are sent to the workers, whatever else a row holds."""
    kept = toxicity.keep_harmless(odd_documents, given("labels"))
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan and plan.count("ArrowEvalPython") == 1
    assert kept.columns == odd_documents.columns
