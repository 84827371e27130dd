"""Corpus synthesis (weighted-grammar sampling, reinflection, harmonisation,
surface strings, splits, balanced quota sampling, experiment grid).

Design: a sentence is keyed by an integer taken from the input table and a salt
(dataset, split, round).  Every random choice is a pure function of (salt, key,
slot) (see ``draws``), so datasets are independent of each other, and a
sentence is generated inside one row with array expressions: no explode, no
per-sentence shuffle, and a lost task recomputes exactly the same rows.  The
grammar is flattened to a 33-row shape table (bounded by the grammar, not the
data) that is broadcast into a range join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import draws as D
from ..functions import lexicon as L
from ..functions.text import surface
from ..sources.tables import ranked, running_total, stored


# ---------------------------------------------------------------- lookups
def shape_table(spark: SparkSession, shapes=None) -> DataFrame:
    """(shape_id, subj_mods, obj_mods, weight, lo, hi, template, verb_pos)."""
    shapes = shapes or L.SHAPES
    rows = [(s.shape_id, s.subj_mods, s.obj_mods, s.weight, s.lo, s.hi, s.template, s.verb_pos) for s in shapes]
    return spark.createDataFrame(
        rows, "shape_id int, subj_mods string, obj_mods string, weight bigint, lo bigint, hi bigint, "
              "template string, verb_pos int")


def _lang_array(lang: Column, attr: str) -> Column:
    """Literal per-grammar word array selected by the row's grammar."""
    expr = None
    for name, g in L.SAMPLING_GRAMMARS.items():
        arr = F.array(*[F.lit(w) for w in getattr(g, attr)])
        expr = F.when(lang == name, arr) if expr is None else expr.when(lang == name, arr)
    return expr


def _flat_lexicon(lang: Column) -> Column:
    """[determiner, complementizer, nouns_sg, nouns_pl, verbs, preps] of the row's grammar."""
    expr = None
    for name, g in L.SAMPLING_GRAMMARS.items():
        words = [L.DETERMINER, L.COMPLEMENTIZER, *g.nouns_sg, *g.nouns_pl, *g.verbs, *g.preps]
        arr = F.array(*[F.lit(w) for w in words])
        expr = F.when(lang == name, arr) if expr is None else expr.when(lang == name, arr)
    return expr


def inflect_col(verb: Column, number: Column) -> Column:
    """Present form of a past verb for 'sg'/'pl'; non -ed words unchanged."""
    stem = F.substring(verb, F.lit(1), F.length(verb) - 2)
    e_final = verb.isin(*L.E_FINAL_VERBS)
    suffix = (F.when(number == "sg", F.when(e_final, "es").otherwise("s"))
              .otherwise(F.when(e_final, "e").otherwise("")))
    return F.when(verb.endswith("ed"), F.concat(stem, suffix)).otherwise(verb)


def flip_number(n: Column) -> Column:
    return F.when(n == "sg", "pl").when(n == "pl", "sg")


# ---------------------------------------------------------------- keys
def lineitem_keys(lineitem: DataFrame) -> DataFrame:
    """Sentence keys from line items: (orderkey*8 + linenumber) is not unique
    in the input, so it is de-duplicated, which reduces map-side first.

    Every 8-byte key expands into a full sentence pair, so partitions sized by
    the keys' bytes would be far too coarse for what follows: the distinct keys
    (and only they) are dealt once more over ``spark.sql.shuffle.partitions``, by a
    hash of their own: a repartition by the key itself is what the distinct already
    has, so Spark drops it and packs all keys into a task for each megabyte."""
    n = int(lineitem.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = lineitem.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("bigint").alias("id")).distinct()
    return keys.repartition(n, F.xxhash64("id"))


def ranked_keys(keys: DataFrame) -> DataFrame:
    """Keys with their 0-based place in key order (range partitions numbered
    inside and shifted by the counts before them; no global window)."""
    return ranked(keys, [F.col("id")], "place", "keys")


# ---------------------------------------------------------------- B1
def sample_shapes(keys: DataFrame, key: str = "id", salt="") -> DataFrame:
    """B1: draw a sentence shape per key with exact grammar probabilities.

    The shape table is fixed by the grammar (33 rows), so the range lookup
    ``lo <= u < hi`` is compiled into a CASE ladder over the cumulative
    bounds (a projection inside whole-stage codegen: no join, no exchange);
    the shape's attributes are read from literal arrays by index."""
    shapes = L.SHAPES
    u = D.pick(D.draw(F.col(key), D.SLOT_SHAPE, salt), L.SHAPE_TOTAL)
    df = D.stage(keys, {"_u": u})
    ladder = None
    for i, s in enumerate(shapes):
        cond = F.col("_u") < F.lit(s.hi)
        ladder = F.when(cond, F.lit(i)) if ladder is None else ladder.when(cond, F.lit(i))
    df = D.stage(df, {"_s": ladder})
    attr = lambda vals: F.get(F.array(*[F.lit(v) for v in vals]), F.col("_s"))
    df = D.stage(df, {"shape_id": attr([s.shape_id for s in shapes]),
                      "subj_mods": attr([s.subj_mods for s in shapes]),
                      "obj_mods": attr([s.obj_mods for s in shapes]),
                      "template": attr([s.template for s in shapes]),
                      "verb_pos": attr([s.verb_pos for s in shapes])})
    return df.drop("_u", "_s")


def sample_rules(keys: DataFrame, rules: DataFrame, weight: str = "weight", order: tuple = ("rule_id",), key: str = "id",
                 slot: int = D.SLOT_SHAPE, salt="") -> DataFrame:
    """B1/B2 with the grammar as a table: each key draws one of the weighted ``rules``.

    Rule r owns the draws from the sum of the weights before it (in ``order``) up
    to its own more.  The draws' range is cut into about as many buckets as there
    are rules; a rule is copied to the buckets that it reaches into (fewer than
    two a rule on average), and keys meet rules by bucket, an equi-join with
    evenly filled buckets, then by bounds.  Rules of weight 0 are never drawn; the
    weights are whole numbers with a sum below 2^31.  Columns: those of ``keys``
    and ``rules``."""
    with_lo = running_total(rules.where(F.col(weight) > 0), [F.col(c) for c in order], weight, "_lo", "rules")
    total, n = with_lo.agg(F.sum(weight), F.count(F.lit(1))).first()
    if not total:
        return keys.crossJoin(rules.where("false"))
    if total >= 1 << 31:
        raise ValueError(f"weights sum to {total}; the draws reach below 2^31")
    width = -(-int(total) // n)
    div = lambda a: F.call_function("div", a.cast("bigint"), F.lit(width).cast("bigint"))                  # noqa: E731
    hi = F.col("_lo") + F.col(weight)
    by_bucket = with_lo.withColumn("_hi", hi).withColumn("_bucket", F.explode(F.sequence(div(F.col("_lo")), div(hi - 1))))
    drawn = D.stage(keys, {"_u": D.pick(D.draw(F.col(key), slot, salt), int(total))})
    drawn = D.stage(drawn, {"_bucket": div(F.col("_u"))})
    out = drawn.join(by_bucket, "_bucket").where((F.col("_u") >= F.col("_lo")) & (F.col("_u") < F.col("_hi")))
    return out.drop("_bucket", "_u", "_lo", "_hi")


# ---------------------------------------------------------------- B3/B4/B6/B7
def synthesize(keys: DataFrame, lang="en_RC_PP", pres_p=0.5, harmonize=False, key: str = "id", salt="",
               naive: bool = False) -> DataFrame:
    """Sentence pairs + generation arrays for every key.

    ``lang``/``pres_p``/``harmonize``/``salt`` are literals or columns of ``keys``
    (config-driven corpora pass columns).  Harmonising gives every subject noun
    the head's number by the lexicon's other form (B6); ``naive`` adds or strips
    a final s instead, as the original does outside its own grammar (quirk Q9).
    Output columns: id, lang, shape_id, subj_mods, obj_mods, template, verb_pos, tense, tags,
    numbers, idx, src_words, tgt_words, src, prefix, tgt.
    """
    lang_c = lang if isinstance(lang, Column) else F.lit(lang)
    pres_c = pres_p if isinstance(pres_p, Column) else F.lit(pres_p)
    harm_c = harmonize if isinstance(harmonize, Column) else F.lit(bool(harmonize))

    df = sample_shapes(keys, key, salt).withColumn("lang", lang_c)
    vp, tmpl = F.col("verb_pos"), F.col("template")
    permille = F.round(pres_c * 1000).cast("bigint")
    # Stage 1: tense, the grammar's flat word list [the, that, nouns_sg...,
    # nouns_pl..., verbs..., preps...], one tag and one digest per word position.
    # A position's digest holds its word draw, then its number draw.
    places = F.sequence(F.lit(0), F.length(tmpl) - 1)
    df = D.stage(df, {"tense": F.when(D.pick(D.draw(F.col(key), D.SLOT_TENSE, salt), 1000) < permille, "pres").otherwise("past"),
                      "_harm": harm_c, "tags": F.split(tmpl, ""),
                      "_flat": _flat_lexicon(F.col("lang")), "_nn": F.size(_lang_array(F.col("lang"), "nouns_sg")),
                      "_nv": F.size(_lang_array(F.col("lang"), "verbs")), "_np": F.size(_lang_array(F.col("lang"), "preps")),
                      "_g": F.transform(places, lambda i: D.digest(F.col(key), i + D.word_slot(0) // 2, salt))})
    pres, tags, flat = F.col("tense") == "pres", F.col("tags"), F.col("_flat")
    nn, nv, np_ = F.col("_nn"), F.col("_nv"), F.col("_np")

    def own(g):                                    # the number drawn at a position
        return F.when(D.lower_half(g, D.number_slot(0)), "sg").otherwise("pl")

    # Stage 2: number and word index per position.
    # Harmonised 'pres' rows give every subject noun the head's number
    df = D.stage(df, {"_head": own(F.get(F.col("_g"), 1))})
    number = lambda g, i: F.when(F.get(tags, i) == "N", F.when(F.col("_harm") & pres & (i < vp), F.col("_head")).otherwise(own(g)))
    choices = lambda t: F.when(t == "N", nn).when(t == "V", nv).when(t == "P", np_)                        # noqa: E731
    index = lambda g, i: F.coalesce(D.pick(D.part(g, D.word_slot(0)), choices(F.get(tags, i))), F.lit(0)).cast("int")
    df = D.stage(df, {"numbers": F.transform("_g", number), "idx": F.transform("_g", index)})
    # Stage 3: one lookup per position into the flat word list.
    numbers = F.col("numbers")

    def word(idx, i):
        t, num = F.get(tags, i), F.get(numbers, i)
        noun = lambda plural: F.get(flat, 2 + F.when(plural, nn).otherwise(F.lit(0)) + idx)                # noqa: E731
        w = (F.when(t == "D", F.get(flat, 0)).when(t == "C", F.get(flat, 1)).when(t == "N", noun(num == "pl"))
              .when(t == "V", F.get(flat, 2 + 2 * nn + idx)).when(t == "P", F.get(flat, 2 + 2 * nn + nv + idx)))
        if not naive:
            return w
        drawn = own(F.get(F.col("_g"), i))         # the word of the drawn number, its s added or taken away
        base = noun(drawn == "pl")
        return F.when((t == "N") & (num != drawn), F.when(num == "pl", F.concat(base, F.lit("s"))).otherwise(F.regexp_replace(base, "s$", ""))).otherwise(w)

    letters = F.transform(numbers, lambda n: F.when(n == "sg", "s").when(n == "pl", "p").otherwise("-"))
    df = D.stage(df, {"src_words": F.transform("idx", word), "num_str": F.array_join(letters, "")})
    df = df.select(*[c for c in df.columns if not c.startswith("_") or c == "_head"])
    # The main verb of a 'pres' target agrees with the head noun (one splice)
    src = F.col("src_words")
    verb = F.get(src, vp)
    tgt = F.when(pres, F.concat(F.slice(src, 1, vp), F.array(inflect_col(verb, F.col("_head"))),
                                F.slice(src, vp + 2, F.size(src)))).otherwise(src)
    df = D.stage(df, {"tgt_words": tgt}).drop("_head")
    df = D.stage(df, {"src": surface(F.col("src_words")), "prefix": F.col("tense"), "tgt": surface(F.col("tgt_words"))})
    return df


def length_filter(df: DataFrame, max_words: int = L.MAX_SENTENCE_WORDS, col: str = "src") -> DataFrame:
    """Keep sentences of at most ``max_words`` whitespace words.

    On freshly synthesised rows the word count is the shape template's length,
    so the filter is applied to ``template`` (pushed down to the shape pick
    instead of being inlined into the word expressions)."""
    if "template" in df.columns and col == "src":
        return df.filter(F.length("template") <= max_words)
    return df.filter(F.size(F.split(F.col(col), " ")) <= max_words)


# ---------------------------------------------------------------- B9/B10
def config_table(spark: SparkSession, config=None) -> DataFrame:
    """Dataset config flattened to (lang, dataset, name, grammar, pres_p, generator, split, n).

    ``config`` is the mapping that ``sources.io.read_config`` returns (default: the experiment's)."""
    config = config or L.DATASET_CONFIG
    rows = [(lang, dname, f"{lang}-{dname}", L.DATASET_GRAMMAR.get(lang, lang), float(p), gen, split, int(n))
            for lang, dsets in config.items() for dname, (p, splits, gen) in dsets.items() for split, n in splits.items()]
    return spark.createDataFrame(rows, "lang string, dataset string, name string, grammar string, pres_p double, "
                                       "generator string, split string, n bigint")


def config_keys(keys: DataFrame, config=None) -> DataFrame:
    """Exactly n rows per configured split, numbered i = 0..n-1 as ``id``.

    Row i takes the (i mod K)-th of the K keys; ``round`` = i div K.  Dataset,
    split and round salt the draws, so no two splits share sentences but by
    chance, and splits larger than the key table go on with fresh draws."""
    spark = keys.sparkSession
    k = ranked_keys(keys).withColumnRenamed("id", "key")
    total = k.count()
    if not total:
        total = 1
    # bounded: one row per configured split; keys beyond a split's size are filtered at the join
    table = config_table(spark, config)
    most = table.agg(F.max("n")).first()[0] or 0              # no key beyond the largest split is joined at all
    kd = k.where(F.col("place") < most).join(F.broadcast(table), F.col("place") < F.col("n"))
    last = F.call_function("div", F.col("n") - 1 - F.col("place"), F.lit(total))
    kd = kd.withColumn("round", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    return kd.select("lang", "dataset", "name", "grammar", "pres_p", "generator", "split", "key",
                     (F.col("round") * total + F.col("place")).alias("id"),
                     F.concat_ws("/", "name", "split", F.col("round").cast("string")).alias("salt"))


def config_prefixes(kd: DataFrame) -> DataFrame:
    """The prefix (tense) of configured rows: one draw, no sentence is built."""
    x = D.pick(D.draw(F.col("key"), D.SLOT_TENSE, F.col("salt")), 1000)
    return kd.withColumn("prefix", F.when(x < F.round(F.col("pres_p") * 1000).cast("bigint"), "pres").otherwise("past"))


def config_corpus(keys: DataFrame, config=None) -> DataFrame:
    """The configured datasets' sentence pairs."""
    return synthesize(config_keys(keys, config), lang=F.col("grammar"), pres_p=F.col("pres_p"),
                      harmonize=F.col("generator") == "pres_or_past_no_pres_dist", key="key", salt=F.col("salt"))


def prefix_proportions(corpus: DataFrame, by=("split",)) -> DataFrame:
    """Share of each prefix within each split (window total, no second scan)."""
    by = list(by)
    c = corpus.groupBy(*by, "prefix").agg(F.count("*").alias("n"))
    w = Window.partitionBy(*by)
    return c.withColumn("prop", F.col("n") / F.sum("n").over(w))


# ---------------------------------------------------------------- B11/B12/B13
def preamble(words: Column, verb_pos: Column) -> Column:
    """Words up to and including the (source, past) main verb."""
    return F.array_join(F.slice(words, 1, verb_pos + 1), " ")


def acceptance(annotated: DataFrame, quotas: dict | None = None) -> DataFrame:
    """Candidates, unique preambles, accepted, skipped, too long and fill ratio per condition.

    A preamble has one condition, so the sequential rule accepts as many rows as
    there are distinct preambles, up to the quota: counts alone decide, combined
    map-side by preamble and then by condition."""
    one = annotated.groupBy("condition", "preamble").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("n_words") > L.MAX_SENTENCE_WORDS).alias("long"))
    c = one.groupBy("condition").agg(F.sum("n").alias("n_candidates"), F.count(F.lit(1)).alias("n_unique"), F.sum("long").alias("n_too_long"))
    c = c.join(F.broadcast(quota_table(annotated.sparkSession, quotas)), "condition", "left")
    c = c.withColumn("n_accepted", F.when(F.col("quota").isNotNull(), F.least("n_unique", F.col("quota").cast("bigint"))).otherwise(F.lit(0).cast("bigint")))
    return c.select(F.coalesce("condition", F.lit("NULL")).alias("condition"), "n_candidates", "n_unique", "n_accepted",
                    (F.col("n_candidates") - F.col("n_accepted")).alias("n_skipped"), "n_too_long", "quota",
                    (F.col("n_accepted") / F.col("quota")).alias("fill"))


def balanced_sample(annotated: DataFrame, quotas: dict | None = None) -> DataFrame:
    """The accepted rows.  The largest quota, taken from the quota list, is
    a literal bound on the rank, which lets Spark limit each window group before
    the exact quota join; the first row of a preamble is its smallest key, an
    aggregate with map-side combine."""
    quotas = quotas or L.BALANCED_QUOTAS
    ranked_ = _first_rows(annotated).withColumn("_rc", F.row_number().over(Window.partitionBy("condition").orderBy("id")))
    ranked_ = ranked_.filter((F.col("_rc") <= max(quotas.values())) & F.col("condition").isNotNull())
    return (ranked_.join(F.broadcast(quota_table(annotated.sparkSession, quotas)), "condition")
                   .filter(F.col("_rc") <= F.col("quota")).drop("_rc"))


FIRST_DRAWS = 50_000               # sentences drawn before the rates are known
IDLE_DRAWS = 50_000_000            # draws without a new sentence after which a category counts as impossible


def numbered_draws(placed: DataFrame, total: int, lo: int, hi: int, salt: str) -> DataFrame:
    """Draws lo..hi-1 (id, key, round, salt): draw i takes the (i mod total)-th key of ``placed`` (key, place) in round i div total."""
    div = lambda a, b: F.call_function("div", a, F.lit(b).cast("bigint"))                  # noqa: E731
    first = div(F.greatest(F.lit(lo).cast("bigint") - F.col("place") + (total - 1), F.lit(0).cast("bigint")), total)
    last = div(F.lit(hi - 1).cast("bigint") - F.col("place") + total, total) - 1
    rounds = placed.where(F.col("place") < hi).withColumn("round", F.explode(F.when(first <= last, F.sequence(first, last))))
    return rounds.select((F.col("round") * total + F.col("place")).alias("id"), "key", "round", F.concat(F.lit(f"{salt}/"), F.col("round").cast("string")).alias("salt"))


def balanced_full(keys: DataFrame, annotate, quotas: dict | None = None, salt: str = "balanced") -> DataFrame:
    """B11 until every quota is full: rows are drawn on and on, key by key and, when
    the keys end, again with fresh draws, as the sequential rule does; a row counts
    while its condition is under quota and its preamble is unseen.

    ``annotate`` turns draws (id, key, round, salt) into rows with condition and
    preamble.  Draws are taken in slices of the sequence; how many come next
    follows from the rate at which the slowest open category filled up to here,
    and only rows of open categories with unseen preambles go on.  Where a slice
    ends changes nothing, since preambles and ranks go by the draw's number.  A
    slice's accepted rows are stored; the quotas are all that is collected."""
    spark = keys.sparkSession
    quotas = dict(quotas or L.BALANCED_QUOTAS)
    placed = ranked_keys(keys).withColumnRenamed("id", "key")
    total = placed.count()
    taken, left, at, last_gain, size = None, quotas, 0, 0, FIRST_DRAWS
    while total and left:
        # aggregated first: filters on conditions stay above, and are not repeated in all that they are derived from
        rows = _first_rows(annotate(numbered_draws(placed, total, at, at + size, salt))).join(F.broadcast(quota_table(spark, left)), "condition")
        if taken is not None:
            rows = rows.join(taken.select("preamble"), "preamble", "left_anti")
        rank = F.row_number().over(Window.partitionBy("condition").orderBy("id"))
        new = rows.withColumn("_rc", rank).where(F.col("_rc") <= F.col("quota")).drop("_rc", "quota")
        new = stored(new, "balanced")
        taken = new if taken is None else stored(taken.unionByName(new), "balanced-taken")
        at += size
        had = {r.condition: r["count"] for r in taken.groupBy("condition").count().collect()}
        before, left = left, {c: q - had.get(c, 0) for c, q in quotas.items() if q > had.get(c, 0)}
        last_gain = at if left != before else last_gain
        if at - last_gain > IDLE_DRAWS:
            raise ValueError(f"no sentences for {sorted(left)} among {IDLE_DRAWS} draws")
        wanted = [n / max(had.get(c, 0), 1) * at for c, n in left.items()]
        size = int(min(max([FIRST_DRAWS, *[1.1 * w for w in wanted]]), 20 * at))
    return taken if taken is not None else stored(_first_rows(annotate(numbered_draws(placed, 1, 0, 0, salt))).where("false"), "balanced")


def _first_rows(rows: DataFrame) -> DataFrame:
    """The first row of each preamble, by id."""
    rest = [c for c in rows.columns if c not in ("preamble", "id")]
    return rows.groupBy("preamble").agg(F.min(F.struct("id", *rest)).alias("_f")).select("preamble", "_f.*")


def quota_table(spark: SparkSession, quotas: dict | None = None) -> DataFrame:
    return spark.createDataFrame(list((quotas or L.BALANCED_QUOTAS).items()), "condition string, quota int")


def scaled_quotas(scale: float) -> dict:
    return {k: max(1, int(v * scale)) for k, v in L.BALANCED_QUOTAS.items()}


# ---------------------------------------------------------------- B14
def experiment_grid(spark: SparkSession, available: DataFrame, models=None, pairs=None) -> DataFrame:
    """(train, test) dataset pairs x models, kept where the data exists.

    ``available`` has (name, split) rows for datasets present in the corpus.
    Self pairs need a train and a dev split (fine-tune job) and/or a test
    split (eval job); configured pairs need the train and the test split."""
    models = models or L.MODELS
    pairs = pairs or L.DATASET_PAIRS
    m = spark.createDataFrame([(x, x.split("/")[-1]) for x in models], "model string, model_short string")
    cfg_names = [f"{lang}-{d}" for lang, ds in L.DATASET_CONFIG.items() for d in ds]
    p = spark.createDataFrame([(n, n) for n in cfg_names] + list(pairs), "train string, test string")
    av = available.groupBy("name").agg(
        F.max(F.when(F.col("split") == "train", True)).alias("has_train"),
        F.max(F.when(F.col("split") == "dev", True)).alias("has_dev"),
        F.max(F.when(F.col("split") == "test", True)).alias("has_test"))
    tr = av.select(F.col("name").alias("train"), "has_train", "has_dev")
    te = av.select(F.col("name").alias("test"), "has_test")
    g = (p.join(F.broadcast(tr), "train").join(F.broadcast(te), "test", "left")
          .filter(F.col("has_train")))
    g = g.withColumn("finetune_job", (F.col("train") == F.col("test")) & F.coalesce(F.col("has_dev"), F.lit(False))) \
         .withColumn("eval_job", F.coalesce(F.col("has_test"), F.lit(False)))
    return g.crossJoin(F.broadcast(m)).select("train", "test", "model", "model_short", "finetune_job", "eval_job")


# ---------------------------------------------------------------- stimulus-style items
def _arr(words) -> Column:
    return F.array(*[F.lit(w) for w in words])


def _pick_word(words, key: Column, slot: int, salt: str) -> Column:
    return F.get(_arr(words), D.pick(D.draw(key, slot, salt), len(words)).cast("int"))


STIMULUS_WORDS = {      # lang -> (nouns sg, nouns pl, determiners, prepositions, adjectives)
    "en_FVN_02": (L.FVN_NOUNS_SG, L.FVN_NOUNS_PL, L.FVN_DETERMINERS, L.FVN_PREPS, L.FVN_ADJECTIVES),
    "en_VN_98": (L.VN_NOUNS_SG, L.VN_NOUNS_PL, [L.DETERMINER], L.VN_PREPS, L.VN_ADJECTIVES),
}


def stimulus_items(keys: DataFrame, lang: str) -> DataFrame:
    """Sentences in the style of the parse-only grammars, assembled from their
    lexicons with the same per-(key, slot) draws:
    en_FVN_02: 'D N P D N V A.' (the verb agrees with the head noun);
    en_VN_98:  'V D N P D N V A?' (auxiliary question).
    A quarter of the keys are made ungrammatical (kind 0: the verb is replaced
    by an unknown past form / the auxiliary is dropped; kind 1: the final
    adjective is dropped), so acceptance has both outcomes.
    Output: id, kind, item, pred (kind 3: with the other number's verb), gold (never broken)."""
    k = F.col("id")
    nouns_sg, nouns_pl, dets, preps, adjs = STIMULUS_WORDS[lang]
    sg1 = D.pick(D.draw(k, 3, lang), 2) == 0
    sg2 = D.pick(D.draw(k, 5, lang), 2) == 0
    n1 = F.when(sg1, _pick_word(nouns_sg, k, 4, lang)).otherwise(_pick_word(nouns_pl, k, 4, lang))
    n2 = F.when(sg2, _pick_word(nouns_sg, k, 6, lang)).otherwise(_pick_word(nouns_pl, k, 6, lang))
    kind = (k % 4).cast("int")
    adj = _pick_word(adjs, k, 8, lang)

    def sentence(verb, last):
        np = [_pick_word(dets, k, 2, lang), n1, _pick_word(preps, k, 7, lang), _pick_word(dets, k, 9, lang), n2]
        words, end = ([*np, verb, last], ".") if lang == "en_FVN_02" else ([verb, *np, F.lit("seem"), last], "?")
        item = F.concat(F.concat_ws(" ", *words), F.lit(end))
        return F.concat(F.upper(F.substring(item, 1, 1)), F.substr(item, F.lit(2)))

    sg, pl, broken = ("seems", "seem", F.lit("seemed")) if lang == "en_FVN_02" else ("does", "do", F.lit(None).cast("string"))
    right = F.when(sg1, sg).otherwise(pl)
    wrong = F.when(sg1, pl).otherwise(sg)
    item = sentence(F.when(kind == 0, broken).otherwise(right), F.when(kind != 1, adj))
    # a prediction of the whole item: kinds 2 and 3 have the right verb and the wrong one
    pred = sentence(F.when(kind == 0, broken).when(kind == 3, wrong).otherwise(right), F.when(kind != 1, adj))
    return keys.select("id", kind.alias("kind"), item.alias("item"), pred.alias("pred"), sentence(right, adj).alias("gold"))
