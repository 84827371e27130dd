"""Prediction metrics: NULL-aware boolean columns, a registry, and the
proportion aggregate.

F1-F4 are plain column expressions.  The parse-based metrics (F5, F10) are
DataFrame operators: the prediction is tagged once per parse variant and
its positions are staged into columns, then every metric is one expression
over those columns — all metrics of a table are computed in one pass and
summarised by one partially aggregated ``groupBy``.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import draws as D
from ..functions import lexicon as L
from ..functions.text import first_word, format_sentence, words
from . import annotate as A

def _null_bool() -> Column:
    return F.lit(None).cast("boolean")


def _c(c):
    return F.col(c) if isinstance(c, str) else c


# ------------------------------------------------------------------ F1-F4
def exact_match(pred, gold) -> Column:
    return _c(pred) == _c(gold)


def ignorecase_exact_match(pred, gold) -> Column:
    return F.lower(_c(pred)) == F.lower(_c(gold))


def first_word_identical(pred, gold) -> Column:
    """NULL when either side has no word (the list-index error case)."""
    return first_word(_c(pred)) == first_word(_c(gold))


def ignorecase_first_word_identical(pred, gold) -> Column:
    return first_word(F.lower(_c(pred))) == first_word(F.lower(_c(gold)))


# ------------------------------------------------------------------ parse stages
def _agrees(subj: Column, verb: Column) -> Column:
    return ((subj == "sg") & verb.endswith("s")) | ((subj == "pl") & ~verb.endswith("s"))


def with_two_stage_parse(df: DataFrame, max_words: int | None = None) -> DataFrame:
    """E2 over columns _pred/_lang/_k[/_need]: stage 1 = the words (lower-cased,
    final punctuation dropped; the first ``max_words`` of them if given);
    stage 2 = first k+1 words + [EOS].  Rows with ``_need`` false are not parsed.
    Adds _stage (1/2/NULL) and the chosen parse as a_tokens/a_ts/a_ns + positions."""
    pred, lang, k = F.col("_pred"), F.col("_lang"), F.col("_k")
    need = F.col("_need") if "_need" in df.columns else F.lit(True)
    df = A.with_parse(df, F.when(need, A.tokens_for_parse(pred, max_words)), lang, "s1_")
    # the fallback is only parsed where stage 1 failed and k is known
    use1 = F.coalesce(F.col("s1_ok"), F.lit(False))
    df = A.with_parse(df, F.when(need & ~use1 & k.isNotNull(), A.eos_tokens(pred, k)), lang, "s2_")
    use2 = k.isNotNull() & F.coalesce(F.col("s2_ok"), F.lit(False))
    df = D.stage(df, {"_stage": F.when(use1, F.lit(1)).when(use2, F.lit(2))})
    one = F.col("_stage") == 1
    chosen = {f"a_{c}": F.when(one, F.col(f"s1_{c}")).when(F.col("_stage") == 2, F.col(f"s2_{c}")) for c in ("tokens", "ts", "ns")}
    df = D.stage(df, chosen)
    df = df.drop(*[f"{s}_{c}" for s in ("s1", "s2") for c in ("tokens", "ts", "ns", "ok")])
    return A.with_positions(df, "a_ts", "a_ns", "a_")


def with_plain_parse(df: DataFrame) -> DataFrame:
    """Parse used by the dormant metrics: strip only ' .'/' ?', no cap, no fallback."""
    df = A.with_parse(df, A.tokens_for_parse(F.col("_pred"), strip_pattern=r" [.?]$"),
                      F.col("_lang"), "b_")
    return A.with_positions(df, "b_ts", "b_ns", "b_")


def _view(p: str) -> dict:
    inter, subj_ch = F.col(p + "inter_nums"), F.col(p + "subj_ch")
    return {"subj": A.num_name(subj_ch), "verb": F.get(F.col(p + "tokens"), F.col(p + "v")),
            "has_dist": F.length(F.replace(inter, subj_ch, F.lit(""))) > 0,
            "final": A.num_name(F.substring(inter, -1, 1))}


# ------------------------------------------------------------------ F5
def agreement_attraction_col() -> Column:
    """F5 decision order over the staged two-stage parse:
    1 unsupported lang or past -> NULL; 2/3 no accepted stage -> NULL;
    4 no distractor -> NULL; 5 pred == gold (both truncated if stage 2) -> False;
    6 verb ends 'ed' -> NULL; 7 verb agrees with head -> False; 8 -> True."""
    sv = _view("a_")
    k = F.col("_k")
    trunc = lambda s: F.concat(F.array_join(F.filter(words(s), lambda w, i: i <= k), " "), F.lit(" [EOS]"))
    one = F.col("_stage") == 1
    pred_cmp = F.when(one, F.col("_pred")).otherwise(trunc(F.col("_pred")))
    gold_cmp = F.when(one, F.col("_gold")).otherwise(trunc(F.col("_gold")))
    supported = F.col("_lang").isin(*L.SUPPORTED_LANGS)
    return (F.when(~supported | (F.col("_tense") == "past"), _null_bool())
             .when(F.col("_stage").isNull(), _null_bool())
             .when(~sv["has_dist"], _null_bool())
             .when(pred_cmp == gold_cmp, F.lit(False))
             .when(sv["verb"].endswith("ed"), _null_bool())
             .when(_agrees(sv["subj"], sv["verb"]), F.lit(False))
             .otherwise(F.lit(True)))


# ------------------------------------------------------------------ F10 (dormant variants)
def main_verb_reinflected_correctly_col() -> Column:
    """True on exact match; else on the prediction's parse:
    (verb not -ed AND sg AND verb ends s) OR (pl AND verb does not end s)
    — the original precedence, under which a plural subject with an -ed verb counts."""
    sv = _view("b_")
    verb, subj = sv["verb"], sv["subj"]
    supported = F.col("_lang").isin(*L.SUPPORTED_LANGS)
    res = ((~verb.endswith("ed")) & (subj == "sg") & verb.endswith("s")) | ((subj == "pl") & ~verb.endswith("s"))
    return (F.when(supported & (F.col("_tense") == "past"), _null_bool())
             .when(F.col("_pred") == F.col("_gold"), F.lit(True))
             .when(~supported | ~F.coalesce(F.col("b_ok"), F.lit(False)), _null_bool())
             .otherwise(res))


def only_main_verb_reinflected_col() -> Column:
    """True on exact match; NULL unless the main verb is correctly reinflected;
    then over every verb but the linearly first: all still past -> True, else
    False; no such verb -> NULL."""
    sv = _view("b_")
    supported = F.col("_lang").isin(*L.SUPPORTED_LANGS)
    verbs = F.filter(F.zip_with(F.col("b_tokens"), F.split(F.col("b_ts"), ""), lambda w, t: F.when(t == "V", w)),
                     lambda x: x.isNotNull())
    others = F.slice(verbs, 2, F.greatest(F.size(verbs), F.lit(0)))
    return (F.when(supported & (F.col("_tense") == "past"), _null_bool())
             .when(F.col("_pred") == F.col("_gold"), F.lit(True))
             .when(~supported | ~F.coalesce(F.col("b_ok"), F.lit(False)), _null_bool())
             .when(sv["verb"].endswith("ed"), _null_bool())
             .when(~_agrees(sv["subj"], sv["verb"]), _null_bool())
             .when(F.size(others) == 0, _null_bool())
             .otherwise(F.forall(others, lambda w: w.endswith("ed"))))


def agreement_attraction_closest_col() -> Column:
    """Attraction to the final intervener: as F5 without the fallback, but a
    final intervener matching the head yields False."""
    sv = _view("b_")
    supported = F.col("_lang").isin(*L.SUPPORTED_LANGS)
    return (F.when(~supported | (F.col("_tense") == "past"), _null_bool())
             .when(~F.coalesce(F.col("b_ok"), F.lit(False)), _null_bool())
             .when(~sv["has_dist"], _null_bool())
             .when(F.col("_pred") == F.col("_gold"), F.lit(False))
             .when(sv["verb"].endswith("ed"), _null_bool())
             .when(_agrees(sv["subj"], sv["verb"]), F.lit(False))
             .when(sv["final"] == sv["subj"], F.lit(False))
             .otherwise(F.lit(True)))


# ------------------------------------------------------------------ registry
# name -> (kind, builder).  "simple" metrics take (pred, gold) only (arguments a
# metric does not declare are not passed); "two_stage"/"plain" need a parse.
METRICS = {
    "agreement_attraction": ("two_stage", agreement_attraction_col),
    "exact_match": ("simple", exact_match),
    "first_word_identical": ("simple", first_word_identical),
    "ignorecase_exact_match": ("simple", ignorecase_exact_match),
    "ignorecase_first_word_identical": ("simple", ignorecase_first_word_identical),
}
DORMANT_METRICS = {
    "main_verb_reinflected_correctly": ("plain", main_verb_reinflected_correctly_col),
    "only_main_verb_reinflected": ("plain", only_main_verb_reinflected_col),
    "agreement_attraction_closest": ("plain", agreement_attraction_closest_col),
}
ALL_METRICS = {**METRICS, **DORMANT_METRICS}


@dataclass(frozen=True)
class Metric:
    """A metric of the user's own: a nullable boolean per example."""

    name: str
    fn: Callable
    arguments: tuple               # names that the function declares
    optional: frozenset            # those with a default
    arrow: bool

    def column(self, given: dict) -> Column:
        """The metric's values for ``given``: columns, or scalars that are spread over the rows.

        Arguments that the function does not declare are left out; one that it
        needs and does not get is an error."""
        missing = [a for a in self.arguments if a not in given and a not in self.optional]
        if missing:
            raise TypeError(f"metric {self.name} needs {', '.join(missing)}")
        mine = {a: v if isinstance(v, Column) else F.lit(v) for a, v in given.items() if a in self.arguments}
        if not self.arrow:
            return self.fn(**mine).cast("boolean")
        return _arrow_column(self.name, self.fn, tuple(mine))(*mine.values())


def _arrow_column(name: str, fn: Callable, names: tuple):
    def run(*columns: pa.Array) -> pa.Array:
        out = fn(**dict(zip(names, columns)))
        if len(out) != len(columns[0]):
            raise ValueError(f"metric {name} gave {len(out)} values for {len(columns[0])} examples")
        return out if isinstance(out, pa.Array) else pa.array(out, pa.bool_())

    return F.arrow_udf(run, "boolean")


REGISTERED: dict[str, Metric] = {}


def register(fn: Callable | None = None, *, name: str | None = None, arrow: bool = False):
    """declare a metric, as a decorator or by a call.

    The function's parameters are the arguments that it is given by name: column
    expressions to a column expression, or, with ``arrow``, Arrow arrays of a batch to
    as many booleans (None: no result).  Built-in names cannot be taken."""
    if fn is None:
        return lambda f: register(f, name=name, arrow=arrow)
    name = name or fn.__name__
    if name in ALL_METRICS:
        raise ValueError(f"{name} is a built-in metric")
    parameters = inspect.signature(fn).parameters.values()
    if any(p.kind in (p.VAR_POSITIONAL, p.VAR_KEYWORD, p.POSITIONAL_ONLY) for p in parameters):
        raise TypeError(f"metric {name} must name its arguments")
    REGISTERED[name] = Metric(name, fn, tuple(p.name for p in parameters), frozenset(p.name for p in parameters if p.default is not p.empty), arrow)
    return fn


def evaluate(df: DataFrame, names: list, arguments: dict, keep=("id",)) -> DataFrame:
    """registered metrics side by side.  ``arguments``: by argument name, a
    column's name or expression, or a scalar in a one-tuple."""
    given = {a: v[0] if isinstance(v, tuple) else _c(v) for a, v in arguments.items()}
    return df.select(*keep, *[REGISTERED[n].column(given).alias(n) for n in names])


def aligned(parts: dict, key: str = "example_id") -> DataFrame:
    """arguments given as tables of their own (key, value), lined up by key; unequal lengths are an error."""
    sizes = {name: df.count() for name, df in parts.items()}
    if len(set(sizes.values())) > 1:
        raise ValueError("arguments are not of one length: " + ", ".join(f"{name} {n}" for name, n in sizes.items()))
    out = None
    for name, df in parts.items():
        value = next(c for c in df.columns if c != key)
        df = df.select(key, F.col(value).alias(name))
        out = df if out is None else out.join(df, key)
    return out


def compute_metrics(df: DataFrame, pred="pred", gold="gold", lang="lang", tense="tense", k=None,
                    names=None, keep=("id",), extra=None, parse_words: int | None = None) -> DataFrame:
    """F9 column form: one row per example, one nullable boolean per metric
    (registered metrics in name order).  ``parse_words``: parse only the first
    words of a prediction, as the original did.  ``lang``/``tense`` may be column
    names or literals; tense defaults to 'pres' when missing (NULL)."""
    names = sorted(names or METRICS)
    keep = [c for c in keep if c in df.columns]
    lang_c = F.col(lang) if lang in df.columns else F.lit(lang)
    tense_c = F.coalesce(F.col(tense), F.lit("pres")) if tense in df.columns else F.lit("pres")
    work = df.select(*keep, F.col(pred).alias("_pred"), F.col(gold).alias("_gold"), lang_c.alias("_lang"),
                     tense_c.alias("_tense"), (F.col(k).cast("int") if k else F.lit(None).cast("int")).alias("_k"))
    kinds = {ALL_METRICS[n][0] for n in names}
    if "two_stage" in kinds:
        # step 1 of the decision is NULL for these rows whatever the parse says
        work = work.withColumn("_need", F.col("_lang").isin(*L.SUPPORTED_LANGS) & (F.col("_tense") != "past"))
    if "two_stage" in kinds or (extra and "stage" in extra):
        work = with_two_stage_parse(work, parse_words)
    if "plain" in kinds:
        work = with_plain_parse(work)
    cols = {}
    for n in names:
        kind, fn = ALL_METRICS[n]
        cols[n] = fn(F.col("_pred"), F.col("_gold")) if kind == "simple" else fn()
    if extra and "stage" in extra:
        cols["stage"] = F.col("_stage")
    return work.select(*keep, *[v.alias(n) for n, v in cols.items()])


# ------------------------------------------------------------------ F9 over files
def score_files(spark, pred_path: str, gold_path: str, use_constraint: bool = False, names=None,
                parse_words: int | None = None, metadata_path: str | None = None) -> DataFrame:
    """metrics of a prediction file against a gold file (pairs as JSON, or
    tab-separated) and its companion metadata, all lined up by line; the language
    is the gold file's name up to the first '-'."""
    from ..sources import io as IO

    pred = IO.read_predictions(spark, pred_path).select("example_id", format_sentence("pred").alias("pred"))
    gold = IO.read_gold(spark, gold_path).select("example_id", format_sentence("gold").alias("gold"))
    meta = IO.read_metadata(spark, metadata_path or IO.metadata_path(gold_path), ["tense", IO.CONSTRAINTS[0]])
    n = [x.count() for x in (pred, gold, meta)]
    if len(set(n)) > 1:                            # F7: arguments of unequal length
        raise ValueError(f"predictions ({n[0]}), gold sentences ({n[1]}) and metadata ({n[2]}) are not of one length")
    lang = gold_path.rstrip("/").rsplit("/", 1)[-1].split("-", 1)[0]
    rows = pred.join(gold, "example_id").join(meta, "example_id")
    return compute_metrics(rows, lang=lang, k=IO.CONSTRAINTS[0] if use_constraint else None, names=names,
                           keep=("example_id", "tense"), parse_words=parse_words)


# ------------------------------------------------------------------ F6
def metric_counts(df: DataFrame, by: list, metrics: list) -> DataFrame:
    """(by..., metric, total, n_true, n_false): all metrics are counted side by
    side in one partially aggregated pass; only its small result is unpivoted."""
    counts = [F.count(F.lit(1)).alias("_total")]
    for m in metrics:
        counts += [F.count_if(F.col(m)).alias(f"_t_{m}"), F.count_if(~F.col(m)).alias(f"_f_{m}")]
    wide = df.groupBy(*by).agg(*counts)
    rows = [F.struct(F.lit(m).alias("metric"), F.col(f"_t_{m}").alias("n_true"), F.col(f"_f_{m}").alias("n_false")) for m in metrics]
    long = wide.select(*by, F.col("_total").alias("total"), F.explode(F.array(*rows)).alias("_m"))
    return long.select(*by, "_m.metric", "total", "_m.n_true", "_m.n_false")


def unpivot_metrics(df: DataFrame, by: list, metrics: list) -> DataFrame:
    """F8: wide metric columns -> (by..., metric, value) rows, one per example and metric."""
    u = df.select(*by, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"))
                                           for m in metrics])).alias("_m"))
    return u.select(*by, "_m.metric", F.col("_m.value").alias("value"))


def ratio(n: Column, of: Column) -> Column:
    """One IEEE division of counts; NULL of nothing."""
    return F.try_divide(n.cast("double"), of.cast("double"))


def summarize(wide_df: DataFrame, metrics: list, by=(), nulls_as_false: bool = False) -> DataFrame:
    """total / included / omitted / true / false / mean of each metric.

    Default: NULL results are omitted from the mean (the documented rule).
    ``nulls_as_false``: NULL counts as False and nothing is omitted (what the
    original wrapper computed)."""
    by = list(by)
    c = metric_counts(wide_df, by, metrics)
    true, total = F.col("n_true"), F.col("total")
    included = total if nulls_as_false else true + F.col("n_false")
    return c.select(*by, "metric", total.alias("total_points"), included.alias("included_points"),
                    (total - included).alias("omitted_points"), true.alias("true_points"),
                    (included - true).alias("false_points"), ratio(true, included).alias("mean"))
