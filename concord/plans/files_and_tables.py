"""Queries of the operators that take whole tables or folders of files as their
parameters: full quotas, the datasets' sink, grammars and lexicons as tables,
registered metrics, external tokenizers, job files."""

from __future__ import annotations

import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions.draws import draw_sql, pick_sql
from ..functions.text import format_sentence
from ..operators import annotate as A
from ..operators import jobs as J
from ..operators import metrics as M
from ..operators import prep as H
from ..operators import synth as S
from ..sources import datasets as DS
from ..sources import io as IO
from ..sources import tables as TB
from . import fixtures as FX
from . import oracle_ctes as O
from .queries import _BAL, _CONFIG_CTES, _INPUTS, _PREDS, _SCRIPT_SQL, _PREFIX_CTES, _inputs, _scored, _scripts, _summary_sql, _w, query

# ---- B11: quotas drawn until they are full ---------------------------------------------------------
ROUNDS_SQL = 10                    # rounds of fresh draws that the oracle looks at; at sf0.01, six fill all quotas
_FULL = ([O.keys_cte("k_"), "kk AS (SELECT id AS key, row_number() OVER (ORDER BY id) - 1 AS place, count(*) OVER () AS total FROM k_keys)",
          f"keys AS (SELECT r.i * total + place AS id, key, 'balanced/' || r.i AS salt FROM kk, range(0, {ROUNDS_SQL}) r(i))"]
         + O.corpus_ctes(pres_p=1.0, keys="keys") + _BAL[len(O.corpus_ctes(pres_p=1.0)):])


def _annotated_draws(draws: DataFrame) -> DataFrame:
    c = S.synthesize(draws, pres_p=1.0, key="key", salt=F.col("salt"))
    c = A.add_features(c, "template", "num_str", "src_words")
    return c.select("id", "key", "round", "condition", S.preamble(F.col("src_words"), F.col("verb_pos")).alias("preamble"))


@query("balanced_full", _w(_FULL, "SELECT a.id, k.key, k.id // kk.total AS round, a.condition, a.preamble FROM acc a JOIN keys k USING (id) JOIN kk ON kk.key = k.key"))
def balanced_full(spark, d):
    """All 42 quotas full, with as many rounds of draws over the keys as that takes."""
    return S.balanced_full(FX.keys(spark, d), _annotated_draws).select("id", "key", "round", "condition", "preamble")


# ---- B9/A7/A11: the configured datasets as files -----------------------------------------------------
_NAMES = [f"{lang}-{dn}" for lang, ds in L.DATASET_CONFIG.items() for dn in ds]
_FILE_META = ["subject_number", "object_number", "main_verb", "n_distractors", "final_intervener_number", "distractor_structures", "pos_sequence"]
_FILES_SQL = _CONFIG_CTES[:-1] + [c for k in range(len(_NAMES)) for c in O.meta_ctes(f"c{k}_")] + ["filed AS (" + " UNION ALL ".join(
    f"SELECT a.name, a.split, a.id AS line, c.src, c.prefix, c.tgt, c.tense, {', '.join('m.' + x for x in _FILE_META)} "
    f"FROM c{k}_corpus c JOIN c{k}_meta m USING (id) JOIN asg a ON a.uid = c.id AND a.name = {O.q(n)}" for k, n in enumerate(_NAMES)) + ")"]


def _dataset_rows(spark, d) -> DataFrame:
    return A.with_features(S.config_corpus(FX.keys(spark, d)))


def _sizes(spark) -> DataFrame:
    return S.config_table(spark).select("name", "split", "n")


@query("dataset_files", _w(_FILES_SQL, "SELECT * FROM filed"))
def dataset_files(spark, d):
    """Every configured split written in one job with its metadata, read back with line numbers per split."""
    base = TB.scratch_path(spark, "datasets")
    DS.write_splits(_dataset_rows(spark, d), _sizes(spark), base, lines_per_file=3000)
    return DS.read_splits(spark, base).select("name", "split", "line", "src", "prefix", "tgt", "tense", *_FILE_META)


_BROKEN = (_NAMES[0], "test")


@query("dataset_rerun", _w(_PREFIX_CTES[:4], f"""
SELECT a.name, a.split, CAST(CASE WHEN a.name = {O.q(_NAMES[0])} AND a.split <> 'test' THEN 1 ELSE 2 END AS INTEGER) AS written_in_run,
       CAST(count(*) AS BIGINT) AS n_lines, CAST(max(a.id) + 1 AS BIGINT) AS n_numbered
FROM asg a GROUP BY a.name, a.split"""))
def dataset_rerun(spark, d):
    """A first run writes one dataset, one of whose splits then breaks (rows of
    another run among its files, no end in the log); a second run writes what is
    missing or broken and leaves the rest; a third has nothing to do."""
    base = TB.scratch_path(spark, "rerun")
    rows = _dataset_rows(spark, d)
    sizes = _sizes(spark)
    DS.write_splits(rows, sizes.where(F.col("name") == _NAMES[0]), base)
    broken = sizes.where((F.col("name") == _BROKEN[0]) & (F.col("split") == _BROKEN[1]))
    half = rows.join(F.broadcast(broken.select("name", "split")), ["name", "split"]).where("id % 2 = 0")
    half.select("name", "split", F.struct("src", "prefix", "tgt").alias("translation")).write.mode("append").partitionBy("name", "split").option("compression", "gzip").json(f"{base}/pairs")
    DS.note(spark, base, [tuple(r) for r in broken.collect()], 2, "begun")
    second = DS.write_splits(rows, sizes, base)
    if DS.write_splits(rows, sizes, base):
        raise AssertionError("a third run found something to write")
    run = spark.createDataFrame(second, "name string, split string, n bigint").select("name", "split", F.lit(2).alias("run"))
    lines = DS.read_splits(spark, base).groupBy("name", "split").agg(F.count(F.lit(1)).alias("n_lines"), (F.max("line") + 1).alias("n_numbered"))
    return lines.join(F.broadcast(run), ["name", "split"], "left").select("name", "split", F.coalesce("run", F.lit(1)).alias("written_in_run"), "n_lines", "n_numbered")


# ---- B1/B2: a grammar given as a table -------------------------------------------------------------------
_RULE_ID, _RULE_WEIGHT = "p_partkey * 3 + k", "(p_partkey * 7919 + k * 104729) % 997"


@query("rule_sample", _w([O.keys_cte(), f"rules AS (SELECT {_RULE_ID} AS rule_id, p_name AS expansion, {_RULE_WEIGHT} AS weight FROM part, range(0, 3) t(k))",
    "bounds AS (SELECT *, coalesce(sum(weight) OVER (ORDER BY rule_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo, sum(weight) OVER () AS total FROM rules)",
    f"drawn AS (SELECT id, {pick_sql(draw_sql('key', '0', 'salt'), '(SELECT max(total) FROM bounds)')} AS u FROM keys)"], """
SELECT d.id, b.rule_id, b.expansion, CAST(b.weight AS BIGINT) AS weight FROM drawn d JOIN bounds b ON d.u >= b.lo AND d.u < b.lo + b.weight"""))
def rule_sample(spark, d):
    """B1/B2: weighted rules from a table (three for each part) drawn for every key."""
    parts = FX.table(spark, d, "part").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(2))))
    rules = parts.select(F.expr(_RULE_ID).alias("rule_id"), F.col("p_name").alias("expansion"), F.expr(_RULE_WEIGHT).alias("weight"))
    return S.sample_rules(FX.keys(spark, d), rules).select("id", "rule_id", "expansion", "weight")


# ---- C1: a lexicon given as a table ------------------------------------------------------------------------
def _lexicon(docs: DataFrame) -> DataFrame:
    """Words that come in two documents or more, coded by the language that uses them most."""
    words = docs.select("doc_id", "lang", F.explode_outer(F.array_distinct(A.tokens_for_parse(F.col("text")))).alias("word")).where(F.col("word").isNotNull())
    by = words.groupBy("word", F.coalesce("lang", F.lit("xx")).alias("lang")).agg(F.count(F.lit(1)).alias("n"))
    top = by.groupBy("word").agg(F.max(F.struct("n", "lang")).alias("top"), F.sum("n").alias("n"))
    return top.where("n > 1").select("word", F.concat(F.upper(F.substring("top.lang", 1, 1)), F.lit("-")).alias("code"))


@query("lexicon_table_tags", _w([
    f"toks AS (SELECT doc_id, coalesce(lang, 'xx') AS lang, unnest(t) AS word, generate_subscripts(t, 1) AS pos FROM (SELECT doc_id, lang, {O.split_words(r'''regexp_replace(lower(text), ' [.?!]$', '')''')} AS t FROM documents))",
    "uses AS (SELECT word, lang, count(DISTINCT doc_id) AS n FROM toks GROUP BY word, lang)",
    "lexi AS (SELECT word, upper(substr(max({'n': n, 'lang': lang}).lang, 1, 1)) || '-' AS code FROM uses GROUP BY word HAVING sum(n) > 1)"], """
SELECT d.doc_id, CAST(count(t.word) AS INTEGER) AS n_tokens, CAST(count(t.word) - count(l.code) AS INTEGER) AS n_unknown,
       md5(coalesce(string_agg(coalesce(l.code, '?-'), '' ORDER BY t.pos) FILTER (t.word IS NOT NULL), '')) AS codes_md5
FROM documents d LEFT JOIN toks t USING (doc_id) LEFT JOIN lexi l USING (word) GROUP BY d.doc_id"""))
def lexicon_table_tags(spark, d):
    """All words of whole documents tagged by a lexicon table that Spark derives from them."""
    docs = FX.table(spark, d, "documents").select("doc_id", "lang", "text")
    lexicon = TB.stored(_lexicon(docs), "lexicon")
    tagged = A.tag_words(docs.select("doc_id", A.tokens_for_parse(F.col("text")).alias("toks")), "doc_id", "toks", lexicon)
    unknown = F.size(F.filter("codes", lambda c: c == A.UNKNOWN)).cast("int")
    return tagged.select("doc_id", F.col("n_tokens").cast("int").alias("n_tokens"), unknown.alias("n_unknown"), F.md5(F.array_join("codes", "")).alias("codes_md5"))


# ---- F7: metrics of the user's own ---------------------------------------------------------------------------
@M.register
def keeps_most_words(pred, gold, at_least):
    """At least that share of the gold words is in the prediction; none for empty gold."""
    g = F.filter(F.split(gold, " "), lambda w: w != "")
    kept = F.size(F.filter(g, lambda w: F.array_contains(F.split(pred, " "), w)))
    return F.when(F.size(g) > 0, kept >= at_least * F.size(g))


@M.register(arrow=True)
def same_length(pred, gold):
    """As many characters."""
    return pc.equal(pc.utf8_length(pred), pc.utf8_length(gold))


@query("registered_metrics", _w(_PREDS + [f"""mine AS (SELECT id, tense, length(pred) = length(gold) AS same_length,
    CASE WHEN len({O.split_words('gold')}) > 0 THEN len(list_filter({O.split_words('gold')}, lambda w: list_contains({O.split_words('pred')}, w))) >= 0.9 * len({O.split_words('gold')}) END AS keeps_most_words
  FROM preds)""", "mlong AS (SELECT tense, 'same_length' AS metric, same_length AS value FROM mine UNION ALL SELECT tense, 'keeps_most_words', keeps_most_words FROM mine)"],
    _summary_sql("mlong", by="tense")))
def registered_metrics(spark, d):
    """two registered metrics, one native with a scalar argument, one on Arrow batches, summed up like the built-in ones."""
    s = _scored(spark, d).select("id", "tense", "pred", "gold")
    # ``lang`` is declared by neither and left out; the scalar is spread
    m = M.evaluate(s, ["keeps_most_words", "same_length"], {"pred": "pred", "gold": "gold", "at_least": (0.9,), "lang": ("en_RC_PP",)}, keep=("id", "tense"))
    return M.summarize(m, ["keeps_most_words", "same_length"], by=["tense"])


# ---- H3: an external tokenizer; H14: formats ------------------------------------------------------------------
@query("external_encode", _w(_INPUTS, "SELECT id, ids, CAST(n_ids AS INTEGER) AS n_ids FROM iids"))
def external_encode(spark, d):
    """H3: a tokenizer file, here of the inputs' own vocabulary, sent once and run on Arrow batches."""
    path = TB.scratch_path(spark, "tokenizer")
    words = _inputs(spark, d).select("id", F.array_join(H.tokens(F.col("input")), " ").alias("text"))
    vocab = H.vocabulary(words.select("id", F.split("text", " ").alias("toks")), "toks")
    spark.createDataFrame([(H.word_tokenizer(vocab),)], "value string").coalesce(1).write.text(path)
    e = H.encode_external(words, "text", path + "/*.txt", add_eos=True)
    return e.select("id", F.array_join("ids", " ").alias("ids"), F.size("ids").cast("int").alias("n_ids"))


@query("input_formats", """
SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'json' WHEN 1 THEN 'csv' WHEN 2 THEN 'json' END AS format,
       count(*) OVER (PARTITION BY page_id % 4 = 3) AS n_alike FROM pages""")
def input_formats(spark, d):
    """The input format of every page's file name; NULL where it is refused."""
    name = F.concat("url", F.element_at(F.array(*[F.lit(x) for x in (".json", ".csv.gz", ".json.gz", ".txt")]), (F.col("page_id") % 4 + 1).cast("int")))
    rows = FX.table(spark, d, "pages").select("page_id", IO.input_format_col(name).alias("format"))
    n = rows.groupBy(F.col("format").isNull().alias("refused")).agg(F.count(F.lit(1)).alias("n_alike"))
    return rows.join(F.broadcast(n), F.col("format").isNull() == F.col("refused")).select("page_id", "format", "n_alike")


# ---- I1/I2: job files as files -------------------------------------------------------------------------------
@query("job_files", _w([_SCRIPT_SQL], """
SELECT s.doc_id, s.signature, CAST(count(*) OVER (PARTITION BY s.signature) AS BIGINT) AS n_items,
       CAST(row_number() OVER (ORDER BY 'lang=' || coalesce(d.lang, 'none') || '/job=' || d.doc_id || '/') - 1 AS BIGINT) AS place
FROM sigs s JOIN documents d USING (doc_id)"""))
def job_files(spark, d):
    """A job script for every document written as a file, listed by overlapping globs, read whole, grouped by header."""
    base = TB.scratch_path(spark, "jobs")
    docs = FX.table(spark, d, "documents").select(F.col("doc_id").alias("job"), F.coalesce("lang", F.lit("none")).alias("lang"))
    scripts = _scripts(spark, d).withColumnRenamed("doc_id", "job").join(docs, "job")
    J.write_items(scripts, base, ["lang", "job"], "script")
    files = J.read_items(spark, [f"{base}/lang=*/job=*/*", f"{base}/lang=[a-m]*/*/part-*", f"{base}/*/job=1*/*.txt"], suffix=".txt")
    items = files.select(F.regexp_extract("path", "/job=([0-9]+)/", 1).cast("bigint").alias("doc_id"), "place", "text")
    groups = J.header_groups(items, "doc_id", J.header_signature(F.col("text")))
    return groups.join(items.select("doc_id", "place"), "doc_id").select("doc_id", "signature", "n_items", "place")
