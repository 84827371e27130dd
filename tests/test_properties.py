"""Properties of synthesis and annotation on the smallest driver tables."""
from pyspark.sql import functions as F

from concord.functions import lexicon as L
from concord.operators import annotate as A
from concord.operators import synth as S
from concord.plans import fixtures as FX
from conftest import SF_SMALL


def test_every_sentence_is_grammatical(spark):
    c = FX.synth_table(spark, SF_SMALL)
    a = A.annotate_text(c.select("id", "tgt"), "tgt", "en_RC_PP")
    assert a.agg(F.count_if(~F.col("ok"))).collect()[0][0] == 0
    assert c.filter(F.length("template") > L.MAX_SENTENCE_WORDS).count() == 0


def test_metadata_from_surface_equals_generation(spark):
    c = FX.corpus(spark, SF_SMALL)
    cols = ["subject_number", "object_number", "main_verb", "final_intervener_number", "n_distractors",
            "each_distractor_structure", "distractor_structures", "final_distractor_structure",
            "pos_sequence", "condition", "predict_identical_until_given_word_number"]
    gen = c.select("id", *cols)
    txt = A.add_features(A.annotate_text(c.select("id", "src"), "src", "en_RC_PP"), "ts", "ns", "tokens")
    txt = txt.select("id", *cols)
    assert gen.exceptAll(txt).count() == 0 and txt.exceptAll(gen).count() == 0
    assert c.filter(F.col("verb_pos") != F.col("predict_identical_until_given_word_number")).count() == 0


def test_harmonized_present_rows_have_no_distractors(spark):
    c = A.add_features(FX.synth_table(spark, SF_SMALL, harmonize=True), "template", "num_str", "src_words")
    r = c.agg(F.count_if((F.col("tense") == "pres") & (F.col("n_distractors") > 0)).alias("pres"),
              F.count_if((F.col("tense") == "past") & (F.col("n_distractors") > 0)).alias("past")).collect()[0]
    assert r["pres"] == 0 and r["past"] > 0


def test_balanced_sample_respects_quotas_and_unique_preambles(spark):
    c = A.add_features(FX.synth_table(spark, SF_SMALL, pres_p=1.0), "template", "num_str", "src_words")
    cand = c.select("id", "condition", S.preamble(F.col("src_words"), F.col("verb_pos")).alias("preamble"))
    quotas = S.scaled_quotas(1 / 64)
    out = S.balanced_sample(cand, quotas)
    per = {r["condition"]: r["count"] for r in out.groupBy("condition").count().collect()}
    there = {r["condition"]: r["n"] for r in cand.where("condition IS NOT NULL").groupBy("condition").agg(F.countDistinct("preamble").alias("n")).collect()}
    assert per == {k: min(q, there[k]) for k, q in quotas.items() if k in there}      # full wherever the keys suffice
    assert sum(per[k] == quotas[k] for k in per) >= 10
    assert out.select("preamble").distinct().count() == out.count()
    # sequential reference on the driver for this tiny fixture
    rows = sorted(cand.collect(), key=lambda r: r["id"])
    seen, counts, acc = set(), {}, set()
    for r in rows:
        cond = r["condition"]
        if cond is not None and counts.get(cond, 0) < quotas[cond] and r["preamble"] not in seen:
            acc.add(r["id"]); seen.add(r["preamble"]); counts[cond] = counts.get(cond, 0) + 1
    assert acc == {r["id"] for r in out.collect()}
    table = {r.condition: r for r in S.acceptance(cand.withColumn("n_words", F.lit(5)), quotas).collect()}
    assert sum(r.n_candidates for r in table.values()) == len(rows)
    for c in {r["condition"] for r in rows}:
        mine = [r for r in rows if r["condition"] == c]
        got = table[c or "NULL"]
        n = sum(r["id"] in acc for r in mine)
        assert (got.n_candidates, got.n_unique, got.n_accepted, got.n_skipped, got.n_too_long) == (
            len(mine), len({r["preamble"] for r in mine}), n, len(mine) - n, 0)


def test_configured_splits_are_exact_and_independent(spark):
    keys = FX.keys(spark, SF_SMALL)
    config = {"en_RC_PP": {"a": (1.0, {"train": 6000, "test": 900}, "pres_or_past"), "b": (1.0, {"train": 6000}, "pres_or_past")}}
    rows = S.config_corpus(keys, config).select("name", "split", "id", "src").collect()
    n = {}
    for r in rows:
        n.setdefault((r.name, r.split), []).append(r)
    assert {k: len(v) for k, v in n.items()} == {("en_RC_PP-a", "train"): 6000, ("en_RC_PP-a", "test"): 900, ("en_RC_PP-b", "train"): 6000}
    assert all(sorted(r.id for r in v) == list(range(len(v))) for v in n.values())
    a, t, b = ({r.id: r.src for r in v} for v in (n["en_RC_PP-a", "train"], n["en_RC_PP-a", "test"], n["en_RC_PP-b", "train"]))
    for x, y in ((a, t), (a, b)):
        same = sum(x[i] == y[i] for i in y if i in x)
        assert same < 0.02 * len(y)            # short sentences meet by chance
    k = spark.createDataFrame([(i,) for i in range(3000)], "id long")
    assert sum(r.p == "pres" for r in S.config_prefixes(k.select("id", F.col("id").alias("key"), F.lit("x").alias("salt"), F.lit(0.5).alias("pres_p"))).select(
        F.col("prefix").alias("p")).collect()) in range(1380, 1620)


def test_naive_harmonising_takes_an_s_away(spark):
    r = S.synthesize(FX.keys(spark, SF_SMALL).limit(0).union(spark.range(300).select("id")), pres_p=1.0, harmonize=True, naive=True)
    words = {w for x in r.select("src_words", "verb_pos").collect() for w in x.src_words[:x.verb_pos]}
    assert words <= {w for w in L.RC_PP_NOUNS_SG + L.RC_PP_NOUNS_PL + L.RC_PP_VERBS_PAST + L.RC_PP_PREPS + ["the", "that"]}


def test_exact_implies_ignorecase(spark):
    from concord.operators import metrics as M
    s = FX.scored_input(FX.corpus(spark, SF_SMALL))
    m = M.compute_metrics(s, k="verb_pos")
    # aggregate rather than filter: a predicate on a derived column would be
    # pushed down and re-expanded into every staged expression beneath it
    r = m.agg(F.count_if(F.col("exact_match") & ~F.col("ignorecase_exact_match")).alias("bad"),
              F.count_if(F.col("agreement_attraction")).alias("attr")).collect()[0]
    assert r["bad"] == 0 and r["attr"] > 0


def test_shape_frequencies_close_to_weights(spark):
    keys = spark.range(0, 200000)
    cnt = {r["shape_id"]: r["count"] for r in S.sample_shapes(keys).groupBy("shape_id").count().collect()}
    n = sum(cnt.values())
    for s in L.SHAPES:
        p = s.weight / L.SHAPE_TOTAL
        sd = (n * p * (1 - p)) ** 0.5
        assert abs(cnt.get(s.shape_id, 0) - n * p) <= 4 * sd + 1, s
