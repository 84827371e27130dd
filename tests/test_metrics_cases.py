"""Worked agreement-attraction cases (decision order of the metric)."""
from concord.operators import metrics as M

GOLD = "The student near the professors helps the dean ."
CASES = [
    # pred, gold, k, expected
    ("The student near the professors helps the dean .", GOLD, None, False),
    ("The student near the professors help the dean .", GOLD, None, True),
    ("The student near the professor help the dean .", "The student near the professor helps the dean .", None, None),
    ("The student helps the dean .", "The student helps the dean .", None, None),
    ("The students near the professor help the dean .", "The student near the professor helps the dean .", None, False),
    ("The student near the professors helped the dean .", GOLD, None, None),
    ("The student near the professors help banana .", GOLD, None, None),
    ("The student near the professors help banana .", GOLD, 5, True),
]


def _run(spark, rows, tense="pres", names=None):
    df = spark.createDataFrame([(i, p, g, k, tense) for i, (p, g, k, _) in enumerate(rows)],
                               "id long, pred string, gold string, k int, tense string")
    out = M.compute_metrics(df.withColumn("lang", df.tense.substr(0, 0)).drop("lang"), lang="en_RC_PP", k="k",
                            names=names)
    return {r.id: r for r in out.collect()}


def test_worked_cases(spark):
    got = _run(spark, CASES)
    for i, (_, _, _, exp) in enumerate(CASES):
        assert got[i]["agreement_attraction"] == exp, (i, CASES[i])


def test_past_tense_is_null(spark):
    got = _run(spark, CASES, tense="past")
    assert all(r["agreement_attraction"] is None for r in got.values())


def test_simple_metrics_and_null_first_word(spark):
    rows = [("A b .", "a b .", None, None), ("", "x", None, None), ("same", "same", None, None)]
    got = _run(spark, rows)
    assert got[0]["exact_match"] is False and got[0]["ignorecase_exact_match"] is True
    assert got[0]["first_word_identical"] is False and got[0]["ignorecase_first_word_identical"] is True
    assert got[1]["first_word_identical"] is None            # empty prediction: no first word
    assert got[2]["exact_match"] is True


def test_dormant_variants(spark):
    rows = [("The student near the professors help the dean .", GOLD, None, None),
            ("The students near the professor help the dean .", "x", None, None),
            ("The student that helped the deans helps the dean .", "x", None, None)]
    got = _run(spark, rows, names=list(M.DORMANT_METRICS))
    assert got[0]["agreement_attraction_closest"] is True      # final intervener pl, verb pl
    assert got[1]["main_verb_reinflected_correctly"] is True
    # the linearly first verb ('helped', inside the subject) is skipped; 'helps' is not past -> False
    assert got[2]["only_main_verb_reinflected"] is False


def test_summary_null_handling(spark):
    got = _run(spark, CASES)
    df = spark.createDataFrame([(r["agreement_attraction"],) for r in got.values()], "m boolean")
    doc = M.summarize(df, ["m"]).collect()[0]
    code = M.summarize(df, ["m"], nulls_as_false=True).collect()[0]
    assert (doc.total_points, doc.included_points, doc.omitted_points, doc.true_points) == (8, 4, 4, 2)
    assert (code.included_points, code.omitted_points, code.false_points) == (8, 0, 6)
    assert abs(doc.mean - 0.5) < 1e-9 and abs(code.mean - 0.25) < 1e-9
