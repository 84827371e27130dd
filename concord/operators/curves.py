"""Result assembly and learning curves (G1-G10) and incremental bookkeeping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_model_name
from .metrics import metric_counts, ratio


def natural_key(name) -> Column:
    """Trailing integer of a name/path ('checkpoint-1040' -> 1040), NULL if none."""
    c = F.col(name) if isinstance(name, str) else name
    digits = F.regexp_extract(F.regexp_replace(c, "/$", ""), "([0-9]*)$", 1)
    return F.when(digits != "", digits.cast("bigint"))


def assemble(metrics_df: DataFrame, metadata: DataFrame, metric_names: list, run: DataFrame, model_name: str,
             test_dataset: str, key: str = "id") -> DataFrame:
    """Metrics joined with metadata by key (metadata wins on equal names),
    iteration first, run constants, metric columns last.

    ``run`` is the one-row run-parameter table; it and the test-set size (one
    aggregate) are joined to every row."""
    meta_cols = [c for c in metadata.columns if c != key]
    base = metrics_df.select("iteration", key, *metric_names).join(metadata, key)
    n_test = metrics_df.agg(F.count("*").alias("n_test_examples"))
    out = base.crossJoin(F.broadcast(n_test)).crossJoin(F.broadcast(run))          # one row each
    return out.select("iteration", key, *meta_cols, clean_model_name(F.lit(model_name)).alias("model_name"), "train_dataset",
                      F.lit(test_dataset).alias("test_dataset"), "learning_rate", "num_train_epochs",
                      F.col("num_train_examples").alias("n_training_examples"), "n_test_examples", "n_params", *metric_names)


NOT_GROUPED = ("pos_seq", "history", "predict")        # parts of names that never group
NOT_GROUPING = ("tense", "each_distractor_structure", "object_number")


def grouping_vars(metadata_columns: list) -> list:
    """The metadata columns that curves are grouped by."""
    return [c for c in metadata_columns if not any(x in c for x in NOT_GROUPED) and c not in NOT_GROUPING]


def curve(scored: DataFrame, metrics: list) -> DataFrame:
    """Mean of every metric per (iteration, tense), NULL results dropped."""
    c = metric_counts(scored, ["iteration", "tense"], metrics).withColumn("n", F.col("n_true") + F.col("n_false"))
    return c.where("n > 0").select("iteration", "tense", "metric", ratio(F.col("n_true"), F.col("n")).alias("mean"), "n")


def group_counts(scored: DataFrame, metrics: list, variables: list) -> DataFrame:
    """(iteration, tense, metric, var, val, n_true, n_false) for every grouping variable.

    GROUPING SETS: each row stands once per variable and is combined map-side, so
    there are as many groups as the variables have values in sum; metrics are
    unpivoted after it."""
    base = ["iteration", "tense"]
    rows = scored.select(*base, *metrics, *[F.coalesce(F.col(v).cast("string"), F.lit("None")).alias(f"_v_{v}") for v in variables])
    counts = []
    for m in metrics:
        counts += [F.count_if(F.col(m)).alias(f"_t_{m}"), F.count_if(~F.col(m)).alias(f"_f_{m}")]
    own = [f"_v_{v}" for v in variables]
    sets = rows.groupingSets([[*base, c] for c in own], *base, *own).agg(*counts)       # the other variables are NULL in a set
    v = F.coalesce(*[F.when(F.col(c).isNotNull(), F.struct(F.lit(x).alias("var"), F.col(c).alias("val"))) for x, c in zip(variables, own)])
    m = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"_t_{m}").alias("n_true"), F.col(f"_f_{m}").alias("n_false")) for m in metrics]))
    return sets.select(*base, v.alias("_v"), m.alias("_m")).select(*base, "_m.metric", "_v.var", "_v.val", "_m.n_true", "_m.n_false")


def grouped_curve(counts: DataFrame) -> DataFrame:
    """Curves keyed 'tense + value' ('None' for NULL)."""
    c = counts.withColumn("n", F.col("n_true") + F.col("n_false")).where("n > 0")
    return c.select("iteration", "metric", "var", F.concat(F.col("tense"), F.lit(" + "), F.col("val")).alias("grp"),
                    ratio(F.col("n_true"), F.col("n")).alias("mean"), "n")


def legend(curves: DataFrame) -> DataFrame:
    """Group size at the latest checkpoint in which the group occurs."""
    return curves.groupBy("metric", "var", "grp").agg(F.max_by("n", "iteration").alias("n_latest"), F.max("iteration").alias("latest_iteration"))


def all_null(counts: DataFrame) -> DataFrame:
    """Results that are not NULL per metric and variable, groups of NULL
    ('None') included; nothing is drawn where there are none."""
    n = F.sum(F.col("n_true") + F.col("n_false"))
    return counts.groupBy("metric", "var").agg(n.alias("n_non_null"), (n == 0).alias("all_null"))


def missing_predictions(examples: DataFrame, iterations: list, done: DataFrame) -> DataFrame:
    """(id, iteration) pairs wanted but not yet predicted.

    The done checkpoints of an example are aggregated first (at most one per
    checkpoint); only what is missing is ever emitted."""
    had = done.groupBy("id").agg(F.collect_set("iteration").alias("_done"))
    wanted = F.array(*[F.lit(i) for i in iterations])
    left = F.array_except(wanted, F.coalesce("_done", F.array().cast("array<int>")))
    return examples.join(had, "id", "left").select("id", F.explode(left).alias("iteration"))
