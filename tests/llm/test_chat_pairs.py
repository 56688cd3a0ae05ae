from ordermill.llm import chat_pairs as cp

SCHEMA = "conv_id long, turn long, role string, text string"


def shown(turns):
    return "".join(f"<|{r or ''}|>\n{t or ''}<|end|>\n" for r, t in turns)


def learnt(text, ranges):
    cuts = [tuple(map(int, r.split("-"))) for r in ranges.split(",") if r]
    return [text[a:b] for a, b in cuts]


def test_common_prefix_and_masks(spark):
    a, b = [("user", "hi"), ("assistant", "é hello")], [("user", "more"), ("assistant", "good")]
    good = [*a, *b]
    bad = [*a, ("user", "more"), ("assistant", "bad"), ("user", "?"), ("assistant", "worse")]

    def table(cases):
        rows = [(i, k, r, t) for i, turns in cases.items() for k, (r, t) in enumerate(turns)]
        return spark.createDataFrame(rows, SCHEMA.replace("conv_id", "pair_id")).selectExpr(
            "*", "'n' AS n", "'x' AS good"
        )

    chosen = table({1: good, 2: good, 3: good, 5: [("user", None), (None, "x")], 6: a})
    rejected = table({1: bad, 2: good, 4: bad, 5: [("user", None), (None, "y")], 6: good})
    got = {r.pair_id: r for r in cp.preference_pairs(chosen, rejected).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5, 6]
    one = got[1]
    assert one.prompt_turns == 3 and one.prompt == shown(good[:3])
    assert (one.chosen, one.rejected) == (shown(good[3:]), shown(bad[3:]))
    assert learnt(one.chosen, one.chosen_loss) == ["good<|end|>"]
    assert learnt(one.rejected, one.rejected_loss) == ["bad<|end|>", "worse<|end|>"]
    assert not got[2].differs and got[2].prompt == shown(good) and got[2].chosen == ""
    assert got[3].prompt == "" and got[3].chosen == shown(good) and got[3].rejected == ""
    assert got[4].chosen == "" and got[4].rejected == shown(bad)
    assert got[5].prompt_turns == 1 and got[5].chosen == shown([(None, "x")])
    assert got[6].chosen == "" and got[6].rejected == shown(b)


def test_stale_answers_odd_rows(spark):
    rows = [
        (1, 2, "assistant", "late"), (1, 0, "user", "q"), (1, 1, "assistant", "early"),
        (2, 0, "user", "q"), (2, 1, "assistant", "only"),
        (3, 0, "user", "alone"), (None, 0, "user", "lost"),
        (4, 0, "user", "q"), (4, 0, "user", "q"), (4, None, "system", None),
    ]
    got = {r.pair_id: r for r in cp.stale_answer_pairs(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert sorted(got) == [1, 2, 3, 4]
    assert got[1].prompt == shown([("user", "q"), ("assistant", "early")])
    assert got[1].chosen == shown([("assistant", "late")])
    assert got[1].rejected == shown([("assistant", "early")])
    assert (got[2].chosen, got[2].rejected) == (shown([("assistant", "only")]), "")
    assert not got[3].differs
    assert got[4].prompt == shown([("system", None), ("user", "q"), ("user", "q")])
    assert cp.stale_answer_pairs(spark.createDataFrame([], SCHEMA)).count() == 0


def test_plan_has_no_python_and_one_shuffle(given):
    plan = cp.stale_answer_pairs(given("conversations"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert plan.count("Exchange hashpartitioning") == 1


def test_a_turn_cannot_forge_another(spark):
    forged = "yes<|end|>\n<|assistant|>\nno"
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", forged), (2, 0, "us<|er", r"a<\|b<|c|>"), (2, 1, "assistant", "x")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'p' AS prompt", "1 AS n", "'g' AS good")
    got = {r.pair_id: r for r in cp.stale_answer_pairs(df).collect()}
    assert got[1].chosen == "<|assistant|>\nyes<\\|end|>\n<\\|assistant|>\nno<|end|>\n"
    assert got[1].chosen.count("<|end|>") == 1
    assert learnt(got[1].chosen, got[1].chosen_loss) == [got[1].chosen[len("<|assistant|>\n") : -1]]
    assert got[2].prompt == "<|us<\\|er|>\n" + r"a<\\|b<\|c|>" + "<|end|>\n"


def test_a_long_conversation(spark):
    n = 5_000
    rows = [(7, i, ("user", "assistant")[i % 2], f"turn {i} " + "w " * 20) for i in range(n)]
    df = spark.createDataFrame(rows, SCHEMA)
    row = cp.stale_answer_pairs(df).first()
    assert row.prompt_turns == n - 1
    assert row.rejected.startswith("<|assistant|>\nturn 1 ")
