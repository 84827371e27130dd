"""Sentence annotation and grammaticality.

Tokens are tagged against a grammar's lexicon (a literal map: the lexicon is
bounded by the grammar).  Each token gets a two-letter code (tag letter +
number letter), the codes are joined into a tag string and a number string,
and every tree-derived feature is read off those strings with native string
functions: head noun = first N, main verb = first V not directly after
'that' (C), interveners = nouns between the head and the verb closing the
subject, an intervener's own structure = its nearest preceding P (PP) or C
(CP/RC).  Acceptance = a full-match pattern over the tag string (unknown
words are '?', so they never match).  No trees, no parser, no Python;
tagging is a look-up per token in an array function, which costs less than a
regular expression pass per lexicon class and leaves code that the JVM compiles;
everything is row-local.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions.text import format_sentence, words
from ..functions import draws as D
from .synth import inflect_col

TAG_NAMES = {"A": "ADJ", "K": "Comp", "E": "EOS"}
UNKNOWN = "?-"


def _lit_lang(lang):
    return lang if isinstance(lang, Column) else F.lit(lang)


# ------------------------------------------------------------------ tokens
split_words = words


def tokens_for_parse(text: Column, max_words: int | None = None, strip_pattern: str = r" [.?!]$") -> Column:
    """Lower-case, drop one final punctuation token, split.  ``max_words`` keeps the
    first words only (a guard of the original parser; patterns need none)."""
    toks = split_words(F.regexp_replace(F.lower(text), strip_pattern, ""))
    return F.slice(toks, 1, max_words) if max_words else toks


def eos_tokens(text: Column, k: Column) -> Column:
    """Fallback parse input: first k+1 words lower-cased, then '[EOS]'."""
    low = F.regexp_replace(F.lower(text), r"\[eos\]", "[EOS]")
    return F.concat(F.slice(split_words(low), 1, k + 1), F.array(F.lit(L.EOS)))


# ------------------------------------------------------------------ C1
def _per_lang(lang: Column, build) -> Column:
    expr = None
    for name in L.SUPPORTED_LANGS:
        v = build(name)
        expr = F.when(lang == name, v) if expr is None else expr.when(lang == name, v)
    return expr


def _code(entry: tuple) -> str:
    t, n = entry
    return t + {"sg": "s", "pl": "p"}.get(n, "-")


def token_codes(tokens: Column, lang) -> Column:
    """The two-letter code of every token ('?-' if unknown), looked up in the
    grammar's lexicon as a literal map."""
    def look_up(name):
        entries = [F.lit(x) for w, e in sorted(L.PARSE_LEXICONS[name].entries.items()) for x in (w, _code(e))]
        return F.transform(tokens, lambda w: F.coalesce(F.try_element_at(F.create_map(*entries), w), F.lit(UNKNOWN)))
    return _per_lang(_lit_lang(lang), look_up)


def _letters(codes: Column, at: int) -> Column:
    return F.array_join(F.transform(codes, lambda c: F.substring(c, at, 1)), "")


def code_string(tokens: Column, lang) -> Column:
    """The codes of all tokens, joined."""
    return F.array_join(token_codes(tokens, lang), "")


#: Words of the rows that meet in one block; a block's rows and its part of the lexicon are in memory together.
BLOCK_WORDS = 4_000_000


def _tag_block(rows: pa.Table, known: pa.Table) -> pa.Table:
    """Codes of the rows (_key, _toks as JSON) of one block by the (word, code) rows it asked for.
    Rows of one key have the words of all of them, place by place."""
    code = dict(zip(known["word"].to_pylist(), known["code"].to_pylist()))
    keys, found = rows["_key"].to_pylist(), [[code.get(w, UNKNOWN) for w in json.loads(t)] for t in rows["_toks"].to_pylist()]
    if len(set(keys)) < len(keys):
        same: dict = {}
        for k, c in zip(keys, found):
            same.setdefault(k, []).extend(enumerate(c))
        same = {k: [c for _, c in sorted(at)] for k, at in same.items()}
        found = [same[k] for k in keys]
    return pa.table({"_key": rows["_key"], "codes": pa.array(found, pa.list_(pa.string()))})


def tag_words(df: DataFrame, key: str, tokens: str, lexicon: DataFrame) -> DataFrame:
    """C1 with the lexicon as a table (word, code) of any size: (key, n_tokens, codes array<string>).

    Rows are dealt by key into blocks of about ``BLOCK_WORDS`` words.  A block asks the
    lexicon once for each word it has (an equi-join; a frequent word comes once per
    block), and its rows, sent once, are tagged where the answers are.  Words that the
    lexicon lacks are ``UNKNOWN``.  A word with several codes has the smallest.  Keys are
    unique; rows without words stay."""
    toks = F.coalesce(F.col(tokens), F.array().cast("array<string>"))
    total = df.agg(F.sum(F.size(toks))).first()[0] or 0
    block = F.pmod(F.xxhash64(F.col(key)), F.lit(1 + total // BLOCK_WORDS)).alias("_block")
    rows = df.where(F.col(key).isNotNull()).select(block, F.col(key).alias("_key"), F.to_json(toks).alias("_toks"))
    asked = df.where(F.col(key).isNotNull()).select(block, F.explode(F.array_distinct(toks)).alias("word")).distinct()
    codes = lexicon.where(F.col("word").isNotNull()).groupBy("word").agg(F.min("code").alias("code")).where(F.col("code").isNotNull())
    known = asked.join(codes, "word").select("_block", "word", "code")
    keyed = df.schema[key].dataType.simpleString()
    tagged = rows.groupBy("_block").cogroup(known.groupBy("_block")).applyInArrow(_tag_block, f"_key {keyed}, codes array<string>")
    none = df.where(F.col(key).isNull()).select(F.col(key).alias("_key"), F.array().cast("array<string>").alias("codes"))
    return tagged.unionByName(none).select(F.col("_key").alias(key), F.size("codes").alias("n_tokens"), "codes")


def lexicon_table(spark, lang: str) -> DataFrame:
    """A grammar's lexicon as (word, code) rows."""
    rows = [(w, _code(e)) for w, e in L.PARSE_LEXICONS[lang].entries.items()]
    return spark.createDataFrame(rows, "word string, code string")


def code_strings(cs: Column) -> tuple:
    """(tag string, number string) from a joined code string; unknown -> '?' / '-'."""
    return F.regexp_replace(cs, "(.).", "$1"), F.regexp_replace(cs, ".(.)", "$1")


def accepts_str(ts: Column, lang) -> Column:
    """E1 on a tag string; NULL for an unsupported language."""
    pat = _per_lang(_lit_lang(lang), lambda n: F.lit("^(" + L.TAG_PATTERNS[n] + ")$"))
    return F.when(pat.isNotNull(), F.coalesce(F.regexp_like(ts, pat), F.lit(False)))


# ------------------------------------------------------------------ C2/C5/C6/C8
def _idx0(pos1: Column) -> Column:
    """1-based instr result -> 0-based index, NULL when not found."""
    return F.when(pos1 > 0, pos1 - 1)


def num_name(ch: Column) -> Column:
    return F.when(ch == "s", "sg").when(ch == "p", "pl")


def with_parse(df: DataFrame, tokens: Column, lang, p: str) -> DataFrame:
    """Staged E1/C1: adds {p}tokens, {p}ts, {p}ns, {p}ok."""
    df = D.stage(df, {p + "tokens": tokens})
    df = D.stage(df, {p + "cs": token_codes(F.col(p + "tokens"), lang)})
    cs = F.col(p + "cs")
    df = D.stage(df, {p + "ts": _letters(cs, 1), p + "ns": _letters(cs, 2)})
    return D.stage(df, {p + "ok": accepts_str(F.col(p + "ts"), lang)}).drop(p + "cs")


def with_positions(df: DataFrame, ts: str, ns: str, p: str) -> DataFrame:
    """Staged head noun / main verb / subject end / interveners / introducers:
    adds {p}h {p}v {p}e {p}obj {p}inter_nums {p}intros {p}subj_ch."""
    T, N = F.col(ts), F.col(ns)
    df = D.stage(df, {p + "marked": F.regexp_replace(T, "CV", "Cv"),     # verbs right after 'that' are RC verbs
                      p + "h": _idx0(F.instr(T, "N"))})
    marked, h = F.col(p + "marked"), F.col(p + "h")
    df = D.stage(df, {p + "v": _idx0(F.instr(marked, "V")),
                      p + "after_h": F.instr(F.substr(marked, h + 2), "V")})
    v, after_h = F.col(p + "v"), F.col(p + "after_h")
    after_v = F.instr(F.substr(T, v + 2), "N")
    df = D.stage(df, {p + "e": F.when(after_h > 0, h + after_h).otherwise(F.length(T)),
                      p + "obj": F.when(after_v > 0, v + after_v)})
    e = F.col(p + "e")
    df = D.stage(df, {p + "region": F.substring(marked, h + 2, e - h - 1),
                      p + "inter_nums": F.coalesce(F.regexp_replace(F.substring(N, h + 2, e - h - 1), "[^sp]", ""),
                                                   F.lit("")),
                      p + "subj_ch": F.substring(N, h + 1, 1)})
    region = F.col(p + "region")
    intros = F.regexp_replace(F.regexp_replace(F.regexp_replace(region, "[^PCN]", ""), "[PC]*([PC])N", "$1"), "N", "")
    df = D.stage(df, {p + "intros": F.coalesce(intros, F.lit(""))})
    return df.drop(p + "marked", p + "after_h", p + "region")


POSITION_COLS = ["h", "v", "e", "obj", "inter_nums", "intros", "subj_ch"]


def structure_labels(intros: Column) -> dict:
    """C10/C11 from the introducer string (one P/C per intervener, in order):
    running labels PP/CP until both kinds are seen, then 'both'; own
    structure PP/RC per intervener."""
    n = F.length(intros)
    f = F.substring(intros, 1, 1)
    other = F.when(f == "P", "C").otherwise("P")
    k = F.instr(intros, other)
    pure = F.when(k == 0, n).otherwise(k - 1)
    flabel = F.when(f == "P", "PP").otherwise("CP")
    labels = F.concat(F.array_repeat(flabel, pure), F.array_repeat(F.lit("both"), n - pure))
    # an array function, as in pos_sequence
    own = F.array_join(F.transform(F.split(intros, ""), lambda c: F.when(c == "P", "PP").when(c == "C", "RC").otherwise(c)), "_")
    return {"each": F.array_join(labels, ","), "last": F.when(n > 0, F.when(k == 0, flabel).otherwise("both")),
            "own": own}


def pos_sequence(ts: Column) -> Column:
    """C4: '[D] [N] ...' (number suffixes are not part of the tags).

    An array function: Spark then compiles the whole projection as many small methods.
    As one method with all features, it was longer than what the JVM compiles."""
    def name(t):
        named = t
        for k, x in TAG_NAMES.items():
            named = F.when(t == k, x).otherwise(named)
        return named
    return F.concat(F.lit("["), F.array_join(F.transform(F.split(ts, ""), name), "] ["), F.lit("]"))


def feature_cols(p: str, ns: str, words_col: str) -> dict:
    """C3-C11/C13 metadata as expressions over the staged position columns."""
    inter_nums, subj_ch = F.col(p + "inter_nums"), F.col(p + "subj_ch")
    n_inter = F.length(inter_nums)
    n_dist = F.length(F.replace(inter_nums, subj_ch, F.lit("")))
    lab = structure_labels(F.col(p + "intros"))
    has_dist = n_dist > 0
    verb = F.get(F.col(words_col), F.col(p + "v"))
    letters = F.translate(F.concat(subj_ch, inter_nums), "sp", "SP")
    condition = F.when(n_inter <= 2, F.concat(letters, F.when(n_inter > 0, F.concat(F.lit("_"), lab["own"]))
                                                .otherwise(F.lit(""))))
    return {
        "subject_number": num_name(subj_ch),
        "predict_identical_until_given_word_number": F.col(p + "v").cast("int"),
        "object_number": num_name(F.substring(F.col(ns), F.col(p + "obj") + 1, 1)),
        "main_verb": verb,
        "predict_from_given_words_after_identical": F.array(inflect_col(verb, F.lit("sg")), inflect_col(verb, F.lit("pl"))),
        "final_intervener_number": num_name(F.substring(inter_nums, -1, 1)),
        "n_distractors": n_dist.cast("int"),
        "each_distractor_structure": F.when(has_dist, lab["each"]),
        "distractor_structures": F.when(has_dist, lab["last"]),
        "final_distractor_structure": F.when(has_dist, lab["last"]),
        "condition": condition,
        "n_interveners": n_inter.cast("int"),
    }


def add_features(df: DataFrame, ts: str, ns: str, words_col: str) -> DataFrame:
    """Metadata columns (positions staged, helpers dropped)."""
    p = "_f_"
    df = with_positions(df, ts, ns, p)
    cols = feature_cols(p, ns, words_col)
    cols["pos_sequence"] = pos_sequence(F.col(ts))
    df = D.stage(df, cols)
    return df.drop(*[p + c for c in POSITION_COLS])


def with_features(df: DataFrame, ts="template", ns="num_str", words_col="src_words") -> DataFrame:
    """Generated corpus + metadata (C13) from its generation strings."""
    return add_features(df, ts, ns, words_col)


def annotate_text(df: DataFrame, text: str, lang, prefix: str = "") -> DataFrame:
    """C1/E1 over arbitrary sentences: {prefix}tokens, ts, ns, ok (accepted)."""
    return with_parse(df, tokens_for_parse(format_sentence(F.col(text))), lang, prefix)


def unknown_word_rate(tokens: Column, lang) -> tuple:
    """(n_tokens, n_unknown) for a token array."""
    ts = F.regexp_replace(code_string(tokens, lang), "(.).", "$1")
    return F.size(tokens), F.length(ts) - F.length(F.replace(ts, F.lit("?"), F.lit("")))
