import itertools
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from ordermill.llm import packing
from tests.llm.test_token_counts import PIECES


def pieces(df):
    return [r.asDict() for r in df.collect()]


def check(found, texts, library, sequence=1024):
    """texts: (doc_id, text) of every row."""
    streams = {}
    for p in found:
        streams.setdefault(p["sequence_id"], []).append(p)
    total = sum(p["length"] for p in found)
    assert sorted(streams) == list(range(-(-total // sequence)))
    for number, own in streams.items():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at and p["length"] > 0
            at += p["length"]
        assert at == (sequence if number < len(streams) - 1 else total - sequence * (len(streams) - 1))
    # every row's ids are cut into pieces once
    wanted = []
    for doc_id, text in texts:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        wanted.append((doc_id, np.array(ids, "<u4").tobytes()))
    held = {}
    for p in found:
        held.setdefault(p["doc_id"], []).append(p)
    for doc_id, data in wanted:
        at = 0
        while 4 * at < len(data):
            p = next(
                p
                for p in held[doc_id]
                if p["start"] == at
                and p["doc_tokens"] == len(data) // 4
                and p["ids_crc32"] == zlib.crc32(data[4 * at : 4 * (at + p["length"])])
            )
            held[doc_id].remove(p)
            at += p["length"]
    assert not any(held.values())


@pytest.fixture(scope="module")
def library(byte_bpe):
    return Tokenizer.from_file(byte_bpe)


def test_given_documents(given, byte_bpe, library):
    docs = given("documents")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    check(pieces(packing.pack(docs, byte_bpe)), rows, library)


def test_odd_rows(odd_documents, byte_bpe, library):
    rows = [(r.doc_id, r.text) for r in odd_documents.select("doc_id", "text").collect()]
    check(pieces(packing.pack(odd_documents, byte_bpe, sequence=64)), rows, library, 64)
    assert packing.pack(odd_documents.limit(0), byte_bpe).count() == 0


def test_ids_equal_the_library(byte_bpe, library):
    rng = random.Random(4)
    encode = packing.Encoder(byte_bpe)
    for _ in range(3000):
        text = "".join(rng.choices(PIECES, k=rng.randint(0, 25)))
        assert encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("run", [" ", "\n"])
def test_whitespace_runs_of_millions(byte_bpe, library, run):
    encode = packing.Encoder(byte_bpe)
    special = next(iter(encode.special), "")
    for text in (
        f"{special}a{run * 2_000_000} b{special}",
        run * packing.LONG_RUN,
        run * (packing.LONG_RUN - 1) + "é",
    ):
        assert encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_a_long_whitespace_run_is_packed(spark, byte_bpe, library):
    rows = [(1, "before" + "\n" * 1_500_000 + "after"), (2, "an ordinary text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check(pieces(packing.pack(docs, byte_bpe)), rows, library)


@pytest.mark.parametrize("dimensions", [2, 3])
def test_the_curve_visits_all_cells_step_by_step(monkeypatch, dimensions):
    monkeypatch.setattr(packing, "BITS", 3)
    cells = {
        packing.hilbert_key(np.array(c)): c for c in itertools.product(range(8), repeat=dimensions)
    }
    assert sorted(cells) == list(range(8**dimensions))
    for a, b in itertools.pairwise(cells[i] for i in sorted(cells)):
        assert sum(abs(x - y) for x, y in zip(a, b, strict=True)) == 1


def test_neighbours_share_sequences(given, byte_bpe):
    """Documents of one language lie closer along the curve than chance has it."""
    found = packing.pack(given("documents"), byte_bpe).filter("start = 0")
    langs = given("documents").select("doc_id", "lang")
    order = found.join(langs, "doc_id").orderBy("sequence_id", "offset").collect()
    same = sum(a.lang == b.lang for a, b in itertools.pairwise(order)) / (len(order) - 1)
    shares = np.unique([r.lang for r in order], return_counts=True)[1] / len(order)
    assert same > (shares**2).sum() + 0.1
