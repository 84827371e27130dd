"""Inputs derived by Spark from the driver tables: the sentence corpus (keys
from ``lineitem``) and a prediction table (deterministic corruptions of the
gold targets, spread over checkpoints)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import annotate as A
from ..operators import synth as S
from ..functions import draws as D
from ..functions.text import format_sentence, surface

ITERATION_STEP = 520          # 7812 updates / 15 checkpoints
N_CHECKPOINTS = 15
UNKNOWN_WORD = "banana"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.lineitem_keys(table(spark, sf_dir, "lineitem"))


def synth_table(spark: SparkSession, sf_dir: str, **kw) -> DataFrame:
    """The synthesised corpus over the line-item keys."""
    return S.synthesize(keys(spark, sf_dir), **kw)


def corpus(spark: SparkSession, sf_dir: str, **kw) -> DataFrame:
    """Sentence pairs with generation arrays and metadata (one row per key)."""
    return A.with_features(synth_table(spark, sf_dir, **kw))


def corrupt(c: DataFrame) -> DataFrame:
    """preds(id, iteration, pred): gold target corrupted by id % 10 —
    0-4 exact, 5 wrong verb number, 6 lower case, 7 unknown object word,
    8 unreinflected (past) verb, 9 first intervener's number flipped.
    One word of the target array is replaced."""
    idc, vp = F.col("id"), F.col("verb_pos")
    kind = (idc % 10).cast("int")
    subj = F.get(F.col("numbers"), 1)
    past = F.get(F.col("src_words"), vp)
    sub = F.instr(F.substring(F.col("template"), 3, vp - 2), "N")
    first_inter = F.when(sub > 0, sub + 1)
    sg, pl = S._lang_array(F.col("lang"), "nouns_sg"), S._lang_array(F.col("lang"), "nouns_pl")
    fi_idx = F.get(F.col("idx"), first_inter)
    flipped = F.when(F.get(F.col("numbers"), first_inter) == "sg", F.get(pl, fi_idx)).otherwise(F.get(sg, fi_idx))
    at = (F.when(kind.isin(5, 8), vp).when(kind == 7, vp + 2).when(kind == 9, first_inter))
    val = (F.when(kind == 5, S.inflect_col(past, S.flip_number(subj))).when(kind == 7, F.lit(UNKNOWN_WORD))
            .when(kind == 8, past).when(kind == 9, flipped))
    names = c.columns
    c = D.stage(c, {"_at": at})
    said = F.transform("tgt_words", lambda w, i: F.when(i == F.col("_at"), val).otherwise(w))
    c = D.stage(c, {"_said": surface(said)})
    pred = F.when(kind == 6, F.lower(F.col("tgt"))).otherwise(F.col("_said"))
    return c.select(*names, pred.alias("pred"), (F.lit(ITERATION_STEP) * (1 + idc % N_CHECKPOINTS)).cast("int").alias("iteration"))


def scored_input(c: DataFrame) -> DataFrame:
    """Formatted (pred, gold) with the scoring context columns."""
    p = corrupt(c)
    return p.select(
        "id", "iteration", "lang", "tense", "verb_pos",
        format_sentence(F.col("pred")).alias("pred"),
        format_sentence(F.col("tgt")).alias("gold"),
        *[x for x in ("subject_number", "main_verb", "final_intervener_number", "n_distractors",
                      "distractor_structures", "final_distractor_structure", "condition",
                      "object_number", "each_distractor_structure", "pos_sequence",
                      "predict_identical_until_given_word_number") if x in p.columns])


def preds_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prediction table (formatted pred + gold + scoring context and metadata)."""
    return scored_input(corpus(spark, sf_dir))
