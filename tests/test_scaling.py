"""Work is dealt over all tasks, generated code is small enough for the JVM to compile, grammar-sized vocabularies need no shuffle."""
import re
import time

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from concord.functions import draws as D
from concord.functions import lexicon as L
from concord.functions import text as T
from concord.operators import annotate as A
from concord.operators import prep as H
from concord.operators import synth as S
from concord.plans import fixtures as FX
from concord.plans import queries as Q
from concord.plans.queries import METADATA_ORDER
from concord.sources import io as IO
from concord.sources import tables as TB
from conftest import SF_SMALL


def test_keys_are_dealt_over_all_tasks(spark):
    lines = spark.range(4000).select((F.col("id") % 1000).alias("l_orderkey"), F.lit(1).alias("l_linenumber"))
    keys = S.lineitem_keys(lines)
    assert keys.count() == 1000
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert keys.select(F.spark_partition_id().alias("p")).distinct().count() == n


@pytest.mark.parametrize("name", ["surface", "curve_overall", "two_stage_accept", "constraint_check"])
def test_generated_methods_are_compiled(spark, capsys, name):
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        E.queries()[name](spark, SF_SMALL).explain(mode="codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) <= 8000          # the JVM interprets longer methods


def method_sizes(spark, capsys, frame):
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        frame().explain(mode="codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    return [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]


def test_rows_of_written_files_are_compiled(spark, capsys):
    c = FX.corpus(spark, SF_SMALL)
    names = ["id", "src", "prefix", "tgt", *METADATA_ORDER]
    for frame in (lambda: c, lambda: c.select(names), lambda: FX.corrupt(c).select(*names, "pred"),
                  lambda: FX.scored_input(c).select("id", "iteration", "pred", "gold", "verb_pos", *Q._RESULT_META)):
        sizes = method_sizes(spark, capsys, frame)
        assert sizes and max(sizes) <= 8000


def test_results_are_computed_from_sentences_written_once(spark):
    once = Q._results(spark, SF_SMALL, once=True)
    plan = once._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan and "md5" not in plan
    plain = Q._results(spark, SF_SMALL)
    assert once.dtypes == plain.dtypes and once.count() == plain.count() > 0
    assert once.exceptAll(plain).count() == plain.exceptAll(once).count() == 0


def test_spaces_and_tags_of_odd_text(spark):
    odd = ["", " ", "a", "\t a  b\n", "a\x0bb \x0b c\f", "a\t\tb c", "\u00a0a\u2003 b \u00a0", "a.b ,c  !", "\r\n", None, "  don't\r", "a\x0b"]
    ws = r"[ \t\n\r\f\x0b]"
    strip = lambda x: re.sub(rf"\A{ws}+|{ws}+\Z", "", x)                       # noqa: E731
    said = lambda x: re.sub(f"{ws}+", " ", re.sub(r"([?.,!'])", r" \1", strip(x)))                # noqa: E731
    df = spark.createDataFrame([(k, x) for k, x in enumerate(odd)], "k int, x string")
    for r in df.select("x", T.strip_ws("x").alias("s"), T.format_sentence("x").alias("f"), T.words("x").alias("w")).collect():
        want = (None, None, None) if r.x is None else (strip(r.x), said(r.x), [w for w in re.split(f"{ws}+", r.x) if w])
        assert (r.s, r.f, r.w) == want
    tags = spark.createDataFrame([("DNPDNVDN",), ("DAKE?",), ("",), (None,)], "t string").select(A.pos_sequence(F.col("t")).alias("p"))
    assert [r.p for r in tags.collect()] == ["[D] [N] [P] [D] [N] [V] [D] [N]", "[D] [ADJ] [Comp] [EOS] [?]", "[]", None]
    for intros, own in (("", ""), ("P", "PP"), ("PCCP", "PP_RC_RC_PP"), (None, None)):
        labels = A.structure_labels(F.lit(intros).cast("string"))
        assert spark.range(1).select(labels["own"].alias("o")).first().o == own


def test_positions_draw_their_own_words_and_numbers(spark):
    keys = spark.range(0, 300)
    slots = {f"w{i}": D.word_slot(i) for i in range(5)} | {f"n{i}": D.number_slot(i) for i in range(5)}
    drawn = {r.id: r for r in D.with_draws(keys, "id", slots, "s").collect()}
    g = L.SAMPLING_GRAMMARS["en_RC_PP"]
    for r in S.synthesize(keys, salt="s").collect():
        assert len(r.numbers) == len(r.idx) == len(r.src_words) == len(r.num_str) == len(r.template)
        for i in range(5):
            if r.template[i] == "N":
                number = "sg" if drawn[r.id][f"n{i}"] < D.RANGE // 2 else "pl"
                words = g.nouns_sg if number == "sg" else g.nouns_pl
                assert (r.numbers[i], r.src_words[i]) == (number, words[drawn[r.id][f"w{i}"] * len(words) // D.RANGE])
            else:
                assert r.numbers[i] is None and r.num_str[i] == "-"


def test_codes_of_tokens(spark):
    rows = [(1, ["the", "student", "near", "the", "banana", L.EOS]), (2, []), (3, None), (4, ["N-", "xthe", "the."])]
    df = spark.createDataFrame(rows, "k int, t array<string>").select("k", A.code_string(F.col("t"), "en_RC_PP").alias("c"), A.code_string(F.col("t"), "xx").alias("x"))
    got = {r.k: (r.c, r.x) for r in df.collect()}
    assert got == {1: ("D-NsP-D-?-E-", None), 2: ("", None), 3: (None, None), 4: ("?-?-?-", None)}


def test_small_vocabulary_encodes_inside_the_row(spark):
    rows = [(1, ["a", "b", "a"]), (2, []), (3, None), (4, ["z", None, "b"]), (None, ["a"])]
    df = spark.createDataFrame(rows, "id int, toks array<string>")
    v = H.vocabulary(df.where("id = 1"), "toks")
    joined = {r.id: r.ids for r in H.encode(df, "id", "toks", v).collect()}
    inside = H.encode(df, "id", "toks", v, unique=True)
    assert {r.id: r.ids for r in inside.collect()} == joined == {1: [3, 4, 3, 1], 2: [1], 3: [1], 4: [2, 2, 4, 1], None: [3, 1]}
    assert "Exchange" not in inside._jdf.queryExecution().toString()
    many = spark.range(H.SMALL_VOCABULARY + 1).select("id", F.array(F.col("id").cast("string")).alias("toks"))
    large = H.vocabulary(many, "toks")
    assert H.small_vocabulary(large) is None and H.encode(many, "id", "toks", large, unique=True).count() == H.SMALL_VOCABULARY + 1


def test_small_vocabulary_places_inside_the_row(spark):
    rows = [(1, ["a"], [["b"], ["a", "q"], ["b", "c", "a"]]), (2, [], [["b"], ["b"]]), (3, ["c", "a"], []), (4, ["q"], [[], ["c", "b"]])]
    df = spark.createDataFrame(rows, "id int, p array<string>, a array<array<string>>")
    v = H.vocabulary(spark.createDataFrame([(["a", "b", "c", "a"],)], "toks array<string>"), "toks")
    got = [sorted(map(tuple, ((r.id, r.pos, tuple(r.allowed), r.opens_word, r.open_all) for r in H.allowed_by_position(df, "id", "p", "a", v, unique=u).collect())))
           for u in (False, True)]
    assert got[0] == got[1] and len(got[0]) == 10


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f for f in (files.apply(i).getName() for i in range(files.size())) if f.startswith("shuffle_")}


def test_ranks_shuffle_rows_once_and_drop_the_shuffle(spark, monkeypatch):
    plans, own = [], TB.stored
    monkeypatch.setattr(TB, "stored", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or own(df, name))
    rows = [(k % 50 if k % 9 else None, k) for k in range(3000)]
    got = TB.ranked(spark.createDataFrame(rows, "a int, b int").repartition(3), [F.desc("a"), F.asc("b")], "place", "test").collect()
    want = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    assert [(r.a, r.b) for r in sorted(got, key=lambda r: r.place)] == want and sorted(r.place for r in got) == list(range(3000))
    assert plans[0].count("rangepartitioning") == 1 and "hashpartitioning" not in plans[0]
    before = shuffle_files(spark)
    written = own(spark.range(1000).repartition(5).withColumnRenamed("id", "k"), "test")
    until = time.time() + 20                       # executors drop the files a little later
    while shuffle_files(spark) - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffle_files(spark) - before and written.count() == 1000
    assert spark.conf.get(TB.CLEANUP, None) is None


def test_datasets_move_only_what_they_write(spark, tmp_path, monkeypatch):
    stored, own = [], IO.stored
    monkeypatch.setattr(IO, "stored", lambda df, name: stored.append(df.columns) or own(df, name))
    cols = [F.concat(F.lit(x), F.col("id")).alias(x) for x in ("src", "prefix", "tgt", "main_verb", "other")]
    df = spark.range(900).select((F.col("id") * 7 % 900).alias("id"), *cols, F.sequence(F.lit(0), F.col("id")).alias("wide"))
    IO.write_dataset(df, str(tmp_path / "a.json"), ["id"], lines_per_file=200)
    assert stored == [["id", "src", "prefix", "tgt", "main_verb"]]
    pairs, meta = IO.read_pairs(spark, str(tmp_path / "a.json")), IO.read_metadata(spark, str(tmp_path / "a_metadata.json"))
    got = IO.pairs_with_metadata(pairs.drop(*IO.CONSTRAINTS), meta).orderBy("example_id").collect()
    want = df.orderBy("id").collect()
    assert [(r.src, r.tgt, r.main_verb) for r in got] == [(r.src, r.tgt, r.main_verb) for r in want]
    assert len(list((tmp_path / "a.json").glob("part-*"))) == 5
    IO.write_dataset(df, str(tmp_path / "b.json"), [F.desc("other"), F.col("id")])
    assert [r.src for r in IO.read_pairs(spark, str(tmp_path / "b.json")).orderBy("example_id").collect()] == [
        r.src for r in df.orderBy(F.desc("other")).collect()]


def test_counting_lines_needs_no_line_numbers(spark, tmp_path):
    spark.range(300).select(F.col("id").cast("string")).repartition(3).write.text(str(tmp_path / "p"))
    lines = IO.read_predictions(spark, str(tmp_path / "p"))
    counted = lines.groupBy().count()
    assert "Join" not in counted._jdf.queryExecution().optimizedPlan().toString() and counted.first()[0] == 300
    assert sorted(r.example_id for r in lines.collect()) == list(range(300))


def test_scored_rows_are_computed_before_they_are_sorted(spark, monkeypatch):
    plans, own = {}, TB.stored
    monkeypatch.setattr(TB, "stored", lambda df, name: plans.update({name: df._jdf.queryExecution().optimizedPlan().toString()}) or own(df, name))
    assert E.queries()["score_files"](spark, SF_SMALL).count() == 20
    assert {name for name, plan in plans.items() if "Sort" in plan} == {"score-sorted"}
    assert {name for name, plan in plans.items() if "md5" in plan} == {"score-rows"}
