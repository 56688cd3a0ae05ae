import zlib
from collections import Counter, defaultdict
from math import log10

import numpy as np
import pytest

from ordermill.llm import lm_ppm


def brute(rows):
    """Scores by plain dictionaries."""

    def tokens(text):
        return [*(text or "").encode().lower().split(), b"\n"]

    def held_out(i):
        return i is not None and zlib.crc32(str(i).encode()) % 7 == 2

    train = Counter()
    for i, t in rows:
        if not held_out(i):
            train.update(tokens(t))
    n, v = sum(train.values()), len(train)
    seen = defaultdict(Counter)

    def spelled(text):
        return b" ".join(tokens(text)[:-1]) + b"\n"

    for i, t in rows:
        if not held_out(i):
            s = b"\n" * 4 + spelled(t)
            for at in range(4, len(s)):
                for k in range(5):
                    seen[s[at - k : at]][s[at]] += 1

    def log_p(s, at):
        total, out = 0.0, set()
        for k in range(4, -1, -1):
            own = {x: c for x, c in seen[s[at - k : at]].items() if x not in out}
            if own:
                mass = sum(own.values()) + len(own)
                if s[at] in own:
                    return total + log10(own[s[at]] / mass)
                total += log10(len(own) / mass)
                out |= own.keys()
        return total - log10(256 - len(out))

    result = []
    for i, t in rows:
        own = tokens(t)
        base = sum(log10((train[w] + 1) / (n + v + 1)) for w in own)
        s = b"\n" * 4 + spelled(t)
        score = sum(log_p(s, at) for at in range(4, len(s)))
        known = sum(train[w] > 0 for w in own)
        result.append((i, held_out(i), len(own), known, n, round(base, 6), round(score, 6)))
    return sorted(result, key=str)


def rows_of(df):
    return sorted(
        (
            (r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6))
            for r in df.collect()
        ),
        key=str,
    )


@pytest.mark.parametrize("heavy", [None, 20])
def test_scores_equal_brute_force(spark, given, odd_documents, monkeypatch, heavy):
    """With all words and windows broadcast, and with most of them joined, in small pieces."""
    if heavy:
        for name, value in (("HEAVY", 20), ("HEAVY_WINDOWS", 50), ("SLICE", 1000), ("FLUSH", 500)):
            monkeypatch.setattr(lm_ppm, name, value)
    docs = given("documents").select("doc_id", "text").filter("doc_id < 60").union(
        odd_documents.select("doc_id", "text")
    )
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got, wanted = rows_of(lm_ppm.score(docs)), brute(rows)
    assert [r[:5] for r in got] == [r[:5] for r in wanted]
    for a, b in zip(got, wanted, strict=True):
        assert a[5:] == pytest.approx(b[5:], abs=1e-5)


def test_probabilities_add_up_to_one(given):
    docs = given("documents").filter("doc_id < 100").selectExpr("text", "false AS held_out")
    counts, _, _ = lm_ppm.count_corpus(docs)
    table = counts.filter(lm_ppm.is_window()).toArrow()
    windows = lm_ppm.windows_of_keys(table["key"].combine_chunks())
    seen = dict(zip(windows.tolist(), table["c"].to_pylist(), strict=True))
    lower = lm_ppm.lower_orders(counts)
    for context in (b" the", b"\n\n\n\n", b"zzzz", b"\xc3\xa9 q", b"q\xff0a", b"ing "):
        third = int.from_bytes(context[1:], "big")
        own = {w for w in seen if w >> 8 & 0xFFFFFF == third}
        own |= {(int.from_bytes(context, "big") << 8) + s for s in range(256)}
        own = np.array(sorted(own), np.uint64)
        n = np.array([seen.get(w, 0) for w in own.tolist()])
        p = lm_ppm.rate(own, n, lower)
        mine = own >> np.uint64(8) == int.from_bytes(context, "big")
        # windows in the table were seen; the escapes to the others make up the rest
        assert (10 ** p[mine]).sum() == pytest.approx(1)


def test_the_order_of_words_changes_the_score(spark, given):
    texts = [r.text for r in given("documents").filter("length(text) > 400").limit(40).collect()]
    held_out = [i for i in range(3000) if zlib.crc32(str(i).encode()) % 7 == 2]
    rows = [(i, t) for i, t in enumerate(texts)]
    words = texts[0].split()
    rows += [(held_out[-1], " ".join(words)), (held_out[-2], " ".join(sorted(words)))]
    got = {r.doc_id: r for r in lm_ppm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    straight, mixed = got[held_out[-1]], got[held_out[-2]]
    assert straight.base_score == pytest.approx(mixed.base_score)
    assert straight.score > mixed.score + 5


def test_window_keys_round_trip():
    windows = np.array([0, 1, 2**40 - 1, 0x6162636465], np.uint64)
    keys = lm_ppm.window_keys(windows)
    assert keys.to_pylist()[3] == b" abcde"
    assert lm_ppm.windows_of_keys(keys).tolist() == windows.tolist()
    assert lm_ppm.windows_of_keys(keys.slice(2, 1)).tolist() == [2**40 - 1]


def test_text_like_the_corpus_scores_higher(spark, given):
    docs = given("documents").select("doc_id", "text").filter("doc_id < 150")
    strange, usual = [i for i in range(1000, 1100) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    odd = spark.createDataFrame(
        [(strange, "xq zjk vvw " * 20), (usual, "the and of " * 20)], docs.schema
    )
    got = {r.doc_id: r for r in lm_ppm.score(docs.union(odd)).collect()}
    assert got[strange].score < 2 * got[usual].score < 0


def test_without_training_documents(spark):
    held_out = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    docs = spark.createDataFrame([(held_out, "ab c")], "doc_id long, text string")
    row = lm_ppm.score(docs).first()
    assert (row.train_tokens, row.n_known, row.n_tokens, row.base_score) == (0, 0, 3, 0)
    assert row.score == pytest.approx(-5 * log10(256))
    assert lm_ppm.score(docs.limit(0)).count() == 0


def test_pieces_hold_every_window_once(monkeypatch):
    texts = [b"\n", b"abc\n", b"x" * 50 + b"\n", b"a long text in parts\n"]
    wanted = Counter()
    for i, t in enumerate(texts):
        whole = lm_ppm.START + t
        for at in range(len(t)):
            wanted[i, int.from_bytes(whole[at : at + 5], "big")] += 1
    for size in (7, 1 << 20):
        monkeypatch.setattr(lm_ppm, "SLICE", size)
        found = Counter()
        for piece in lm_ppm.pieces(texts):
            for at in np.flatnonzero(piece.real):
                owner = piece.owners[np.searchsorted(piece.begins, at, "right") - 1]
                found[int(owner), int(piece.windows[at])] += 1
        assert found == wanted
