"""Every stage on its own input, against the operator's verdicts or brute force."""

import corpus_pipeline
from ordermill.llm import decontamination, near_dup, quality, toxicity
from tests.llm.conftest import DATA
from tests.llm.test_near_dup import brute
from tests.llm.test_packing import check, pieces


def test_stages_run_one_after_the_other(spark, tmp_path, byte_bpe):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    benchmark = spark.read.parquet(f"{DATA}/benchmark.parquet")
    verdicts = {
        "quality_rules": lambda d: quality.judge(d).filter("kept"),
        "toxicity": lambda d: toxicity.score(d, labels).filter("predicted = 0"),
        "near_duplicates": lambda d: near_dup.near_duplicates(d).filter("kept"),
        "decontamination": lambda d: decontamination.judge(d, benchmark).filter("NOT contaminated"),
    }
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == [*verdicts, "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        kept = {r.doc_id for r in verdicts[name](docs).collect()}
        stage(spark, docs, DATA).write.parquet(f"{tmp_path}/{name}")
        after = spark.read.parquet(f"{tmp_path}/{name}")
        assert after.columns == docs.columns
        assert {r.doc_id: r.text for r in after.collect()} == {i: before[i] for i in kept}
        if name == "near_duplicates":
            assert kept == {c for _, c in brute(before.items()).values()}
        assert 0 < len(kept) <= len(before)
        docs = after
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert len(rows) < spark.read.parquet(f"{DATA}/documents.parquet").count()
    found = pieces(corpus_pipeline.STAGES[-1][1](spark, docs, DATA))
    check(found, rows, Tokenizer.from_file(byte_bpe))
    assert sorted(map(str, found)) == sorted(map(str, pieces(corpus_pipeline.run(spark, DATA))))


def frame(spark, folder, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df = df.selectExpr("*", "'x' AS terms", "1 AS counts", "'r' AS _row", "array(2) AS bands")
    df.write.parquet(f"{folder}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{DATA}/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")


def test_odd_rows_through_a_whole_run(spark, tmp_path, byte_bpe):
    """Null, repeated and shared ids, empty and long texts, a contaminated row, further columns."""
    from tokenizers import Tokenizer

    good = [
        " ".join(f"{w}{g}{i % 37 if g % 2 else i}" for i, w in enumerate(["river", "stone", "cloud"] * 20))
        for g in range(8)
    ]
    item = spark.read.parquet(f"{DATA}/benchmark.parquet").first().text
    long = " ".join(f"word{i}" for i in range(60_000))
    rows = [
        (None, good[0]), (None, good[0]), (1, good[0]),  # one of them stays
        (2, good[1]), (2, good[2]),  # two texts share an id
        (3, good[3]), (3, good[3]),  # a row repeats
        (4, None), (5, ""), (6, " \n "),
        (7, item), (7, good[4]), (None, item), (None, good[5]),
        (8, long), (9, good[6] + " one more"), (10, good[6]),
    ]
    # without a language, so that the base rules alone judge them
    frame(spark, tmp_path, [(i, t, None, "s", len(t or "")) for i, t in rows])
    wanted = [
        (1, good[0]), (2, good[1]), (2, good[2]), (3, good[3]), (3, good[3]), (7, good[4]),
        (None, good[5]), (8, long), (9, good[6] + " one more"),
    ]
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns, name
    got = sorted(((r.doc_id, r.text) for r in docs.collect()), key=str)
    assert got == sorted(wanted, key=str)
    found = pieces(corpus_pipeline.run(spark, str(tmp_path)))
    assert sum(p["length"] for p in found) == sum(
        len(Tokenizer.from_file(byte_bpe).encode(t, add_special_tokens=False).ids) + 1 for _, t in wanted
    )


def test_an_empty_table(spark, tmp_path):
    frame(spark, tmp_path, [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
