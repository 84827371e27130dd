"""Written order, the datasets' log, full quotas, grammars and lexicons as tables,
registered metrics, external tokenizers, job files."""
import gzip
import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from concord.functions import lexicon as L
from concord.operators import annotate as A
from concord.operators import jobs as J
from concord.operators import metrics as M
from concord.operators import prep as H
from concord.operators import synth as S
from concord.plans import files_and_tables as FT
from concord.plans import fixtures as FX
from concord.sources import datasets as DS
from concord.sources import io as IO
from concord.sources import tables as TB

SF_SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("partitions,lines", [(4, 700), (16, 10_000), (200, 33)])
def test_written_files_keep_the_asked_order(spark, tmp_path, partitions, lines):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        # part files of very unequal size
        rows = spark.range(0, 2900).union(spark.range(2900, 2905)).union(spark.range(5000, 3999, -1)).select(
            F.col("id").alias("k"), F.concat(F.lit("s"), "id").alias("src"), F.lit("pres").alias("prefix"), F.repeat(F.lit("t"), (F.col("id") % 90).cast("int")).alias("tgt"),
            F.concat(F.lit("s"), "id").alias("main_verb"), F.lit("pres").alias("tense"))
        path = str(tmp_path / "set.json")
        IO.write_dataset(rows, path, [F.desc("k")], lines)
        got = IO.pairs_with_metadata(IO.read_pairs(spark, path).select("example_id", "src"), IO.read_metadata(spark, IO.metadata_path(path), ["main_verb"])).orderBy("example_id").collect()
        asked = [f"s{k}" for k in sorted([*range(2905), *range(4000, 5001)], reverse=True)]
        assert [r.src for r in got] == asked and [r.main_verb for r in got] == asked and [r.example_id for r in got] == list(range(len(asked)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_empty_dataset(spark, tmp_path):
    rows = spark.createDataFrame([], "id long, src string, prefix string, tgt string, tense string")
    IO.write_dataset(rows, str(tmp_path / "none.json"), ["id"])
    assert IO.read_pairs(spark, str(tmp_path / "none.json")).count() == 0


def _rows(spark, sizes, mark):
    out = None
    for name, split, n in sizes:
        r = spark.range(n).select(F.lit(name).alias("name"), F.lit(split).alias("split"), "id", F.concat(F.lit(mark + name + split), "id").alias("src"), F.lit("past").alias("prefix"),
                                  F.lit("t").alias("tgt"), F.concat(F.lit(mark), "id").alias("main_verb"))
        out = r if out is None else out.union(r)
    return out.repartition(5)


def test_broken_splits_are_rewritten_and_complete_ones_stay(spark, tmp_path):
    base, sizes = str(tmp_path), [("a", "dev", 40), ("a", "train", 500), ("b", "test", 1)]
    table = spark.createDataFrame(sizes, "name string, split string, n bigint")

    def src():
        return {(r.name, r.split, r.line): (r.src, r.main_verb) for r in DS.read_splits(spark, base).collect()}

    assert DS.write_splits(_rows(spark, sizes[:2], "x"), table.where("name = 'a'"), base, lines_per_file=70) == sizes[:2]
    first = src()
    assert first == {(n, s, k): (f"x{n}{s}{k}", f"x{k}") for n, s, c in sizes[:2] for k in range(c)}
    DS.note(spark, base, [("a", "dev", 40)], 2, "begun")                 # a run that never came to its end
    assert ("a", "dev", 0) not in src()
    assert DS.write_splits(_rows(spark, sizes, "y"), table, base, lines_per_file=70) == [sizes[0], sizes[2]]
    second = src()
    assert {k for k, v in second.items() if v[0][0] == "y"} == {("a", "dev", k) for k in range(40)} | {("b", "test", 0)}
    assert all(second[k] == v for k, v in first.items() if k[1] == "train")
    assert DS.write_splits(_rows(spark, sizes, "z"), table, base) == []
    assert DS.write_splits(_rows(spark, sizes, "z"), table, base, overwrite=True) == sizes
    assert len(src()) == 541 and all(v[0][0] == "z" for v in src().values())


def test_quotas_are_filled_like_one_sentence_after_the_other(spark, monkeypatch):
    keys, quotas = spark.range(5, 605).select((F.col("id") * 3).alias("id")), {"S": 90, "P": 12, "SS_PP": 30, "PP_RC": 25}
    monkeypatch.setattr(S, "FIRST_DRAWS", 250)
    got = S.balanced_full(keys, FT._annotated_draws, quotas).collect()
    drawn = FT._annotated_draws(S.numbered_draws(S.ranked_keys(keys).withColumnRenamed("id", "key"), 600, 0, 1 + max(r.id for r in got) + 600, "balanced")).collect()
    seen, left, want = set(), dict(quotas), []
    for r in sorted(drawn, key=lambda r: r.id):
        assert (r.key, r["round"]) == (15 + 3 * (r.id % 600), r.id // 600)
        if left.get(r.condition) and r.preamble not in seen:
            seen.add(r.preamble)
            left[r.condition] -= 1
            want.append((r.id, r.condition, r.preamble))
    assert not any(left.values()) and sorted((r.id, r.condition, r.preamble) for r in got) == want and max(r["round"] for r in got) > 0
    assert S.balanced_full(keys.limit(0), FT._annotated_draws, quotas).count() == 0
    monkeypatch.setattr(S, "IDLE_DRAWS", 2000)
    with pytest.raises(ValueError, match="no sentences"):
        S.balanced_full(keys, FT._annotated_draws, {"never": 1})


def test_the_grammar_as_a_table_draws_the_same_shapes(spark):
    keys = FX.keys(spark, SF_SMALL)
    rules = S.shape_table(spark).select("shape_id", "weight", "lo")
    got = {(r.id, r.shape_id) for r in S.sample_rules(keys, rules.drop("lo"), order=("shape_id",)).collect()}
    by_id = rules.orderBy("lo").collect()
    assert [r.shape_id for r in by_id] == sorted(r.shape_id for r in by_id)
    assert got == {(r.id, r.shape_id) for r in S.sample_shapes(keys).select("id", "shape_id").collect()}
    assert S.sample_rules(keys, rules.where("weight < 0"), order=("shape_id",)).count() == 0
    with pytest.raises(ValueError, match="2147483648|below"):
        S.sample_rules(keys, spark.createDataFrame([(1, 1 << 31)], "rule_id int, weight bigint"))


def test_a_lexicon_table_tags_like_the_grammar(spark):
    c = FX.synth_table(spark, SF_SMALL).limit(300).select("id", "src")
    c = c.union(spark.createDataFrame([(-1, ""), (-2, "Xyzzy the student the student plugh."), (-3, "the " * 500)], c.schema))
    a = A.annotate_text(c, "src", "en_RC_PP").select("id", "tokens", "ts", "ns")
    lexicon = A.lexicon_table(spark, "en_RC_PP")
    got = {r.id: r for r in A.tag_words(a, "id", "tokens", lexicon).collect()}
    for r in a.collect():
        assert "".join(x[0] for x in got[r.id].codes) == (r.ts or "") and "".join(x[1] for x in got[r.id].codes) == (r.ns or "")
        assert got[r.id].n_tokens == len(r.tokens)


def test_words_ask_the_lexicon_once_per_block(spark, monkeypatch):
    rows = [(k, [f"w{(k * i) % 13}" for i in range(k % 40)]) for k in range(400)] + [(1000, None), (1001, ["w1", None, 'q"\\ é\n']), (None, ["w1"]), (None, None), (7, ["w2", "x"]), (7, ["w2", "x"])]
    df = spark.createDataFrame(rows, "k int, t array<string>")
    lexicon = spark.createDataFrame([(f"w{i}", f"{i:x}-") for i in range(9)] + [("w3", "0-"), (None, "n-"), ("w8", None), ("w10", None), ("never", "z-")], "word string, code string")
    code = {f"w{i}": f"{i:x}-" for i in range(9)} | {"w3": "0-"}
    of = {}
    for k, t in rows:
        of.setdefault(k, []).extend(enumerate(code.get(w, A.UNKNOWN) for w in t or []))
    want = sorted(((k is None, k or 0), [c for _, c in sorted(of[k])] if k is not None else []) for k, _ in rows)
    for words in (A.BLOCK_WORDS, 100):
        monkeypatch.setattr(A, "BLOCK_WORDS", words)
        got = A.tag_words(df, "k", "t", lexicon)
        assert sorted(((r.k is None, r.k or 0), r.codes) for r in got.collect()) == want
        assert all(r.n_tokens == len(r.codes) for r in got.collect())
    many = spark.range(3000).select("id", F.array_repeat(F.lit("the"), 200).alias("t"))
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = A.tag_words(many, "id", "t", lexicon)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert "collect_list" not in plan and "posexplode" not in plan       # no row for each word of each row


def test_registered_metrics(spark):
    df = spark.createDataFrame([(1, "a b", "a b c"), (2, None, "x"), (3, "q", "q")], "id long, pred string, gold string")

    @M.register(name="t_has")
    def has(pred, gold, word, fold=False):
        return pred.contains(word) if not fold else F.lower(pred).contains(word)

    @M.register(name="t_short", arrow=True)
    def short(pred: pa.Array, most: pa.Array):
        return [None if p is None else len(p) <= m for p, m in zip(pred.to_pylist(), most.to_pylist())]

    @M.register(name="t_wrong", arrow=True)
    def wrong(pred):
        return [True]

    got = M.evaluate(df, ["t_has", "t_short"], {"pred": "pred", "gold": "gold", "word": ("a",), "most": (1,), "tense": ("pres",)}).collect()
    assert {r.id: (r.t_has, r.t_short) for r in got} == {1: (True, False), 2: (None, None), 3: (False, True)}
    s = {r.metric: (r.total_points, r.omitted_points, r.mean) for r in M.summarize(M.evaluate(df, ["t_has"], {"pred": "pred", "gold": "gold", "word": ("a",)}), ["t_has"]).collect()}
    assert s == {"t_has": (3, 1, 0.5)}
    with pytest.raises(TypeError, match="needs word"):
        M.evaluate(df, ["t_has"], {"pred": "pred", "gold": "gold"})
    with pytest.raises(TypeError, match="name its arguments"):
        M.register(lambda **given: None, name="t_any")
    with pytest.raises(ValueError, match="built-in"):
        M.register(has, name="exact_match")
    with pytest.raises(Exception, match="gave 1 values"):
        M.evaluate(df.coalesce(1), ["t_wrong"], {"pred": "pred"}).collect()
    parts = {"pred": df.select("id", "pred"), "gold": df.select("id", "gold")}
    assert M.aligned(parts, "id").count() == 3
    with pytest.raises(ValueError, match="pred 3, gold 2"):
        M.aligned({**parts, "gold": df.select("id", "gold").limit(2)}, "id")


def test_external_tokenizer(spark):
    path = "/opt/tokenizers/byte_bpe_50k.json"
    if not os.path.exists(path):
        pytest.skip("no tokenizer files")
    from tokenizers import Tokenizer

    rows = [(1, "The student helps the dean.", "x"), (2, None, "x"), (3, "", "x"), (4, "naïve café \U0001f600 " * 200, "x")]
    got = H.encode_external(spark.createDataFrame(rows, "id long, text string, other string"), "text", path, add_eos=True)
    own = Tokenizer.from_file(path)
    assert got.columns == ["id", "text", "other", "ids"]
    assert {r.id: r.ids for r in got.collect()} == {i: None if t is None else own.encode(t, add_special_tokens=False).ids + [H.EOS_ID] for i, t, _ in rows}
    with pytest.MonkeyPatch.context() as m:
        m.setattr(H, "TOKENIZER_BYTES", 10)
        with pytest.raises(ValueError, match="larger than"):
            H.encode_external(got.select("id", "text"), "text", path)


def test_job_files_are_read_once_in_order(spark, tmp_path):
    for folder, name, text in (("b", "2.sh", "#!/bin/sh\n#SBATCH --time=1\n"), ("a", "1.sh", "x\n\ny"), ("a", "3.txt", "no"), ("c", "9.sh", "")):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / name).write_text(text)
    got = J.read_items(spark, [f"{tmp_path}/*/*.sh", f"{tmp_path}/a/*", f"{tmp_path}/[ab]/?.*"], suffix=".sh").orderBy("place").collect()
    assert [(r.place, r.path.rsplit("/", 2)[1:], r.text) for r in got if r.text] == [(0, ["a", "1.sh"], "x\n\ny"), (1, ["b", "2.sh"], "#!/bin/sh\n#SBATCH --time=1\n")]


def test_items_are_written_by_the_tasks_and_listed_once(spark, tmp_path):
    rows = [("x y", k, f"#!/bin/sh\n{k}") for k in range(40)] + [("b", 7, None), ("b%c", 7, "twice"), ("b%c", 7, "twice")]
    df = spark.createDataFrame(rows, "lang string, job long, script string")
    odd = df.limit(1).select(F.explode(F.array(*map(F.lit, ["".join(map(chr, range(1, 128))), "", "é +~", None]))).alias("v"), "script")
    odd.write.partitionBy("v").text(str(tmp_path / "spark"))
    J.write_items(odd, str(tmp_path / "own"), ["v"], "script")
    assert {f.name for f in (tmp_path / "own").glob("v=*")} == {f.name for f in (tmp_path / "spark").glob("v=*")}
    assert sorted(r.text for r in J.read_items(spark, [f"{tmp_path}/own/v=é +*/*", f"{tmp_path}/own/v=_*"]).collect()) == ["#!/bin/sh\n0\n", "#!/bin/sh\n0\n" * 2]
    J.write_items(df, str(tmp_path / "jobs"), ["lang", "job"], "script")
    J.write_items(df, str(tmp_path / "jobs"), ["lang", "job"], "script")
    files = list((tmp_path / "jobs").rglob("part-*.txt"))
    assert len(files) == 42 and len({f.parent for f in files}) == 42 and not list((tmp_path / "jobs").rglob("*/.*.crc"))
    for folder, name in (("jobs/lang=b/job=7/_left", "part-0.txt"), ("jobs/lang=b", "other.txt"), ("else/where", "part-1.txt")):
        (tmp_path / folder).mkdir(parents=True, exist_ok=True)
        (tmp_path / folder / name).write_text("other")
    base = f"{tmp_path}/jobs"
    globs = [f"{base}/*/job=*/*", f"file://{base}/lang=x*/job=1?", f"{base}/lang={{b*,x y}}/job=[!1-6]/part-*", f"{base}/lang=b/job=99*"]
    got = J.read_items(spark, globs, suffix=".txt").orderBy("place").collect()
    assert [r.place for r in got] == list(range(42)) and [r.path for r in got] == sorted(r.path for r in got)
    assert sorted(r.text for r in got) == sorted([f"#!/bin/sh\n{k}\n" for k in range(40)] + ["\n", "twice\ntwice\n"])
    few = J.read_items(spark, [f"{base}/lang={{b*,x y}}/job=[!0-6]/p*"], regex=".*x%20y").collect()
    assert sorted(r.text for r in few) == [f"#!/bin/sh\n{k}\n" for k in (7, 8, 9)]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        J.read_items(spark, [f"{tmp_path}/missing/*"])


def test_items_are_listed_and_read_by_the_tasks(spark, tmp_path, monkeypatch):
    names = ["a b.txt", "p%20q.txt", "plus+.txt", "é\u00a0x.txt", "日本.txt", "q?#.txt", "b[1]{2}*.txt", "empty.txt", "_hid.txt", "_k=v.txt", ".dot.txt",
             "_metadata.txt", "x._COPYING_", "g[1].gz", "tilde~!'()&;@,$.txt", "ctl\x01.txt", "back\\s.txt", 'quo"t<e>|^`.txt']
    for d in ("d1", "d2/x=1/y z", "_h", ".h", "_metadata_d", "_p=1"):
        (tmp_path / d).mkdir(parents=True)
        for n in names:
            body = b"" if n == "empty.txt" else f"{d}\r\n{n}\n".encode() + b"\xff\xfe"
            (tmp_path / d / n).write_bytes(gzip.compress(body) if n.endswith("gz") else body)
    (tmp_path / "d1" / "gone.txt").symlink_to(tmp_path / "nowhere")
    scan = spark.read.option("recursiveFileLookup", "true").text(str(tmp_path), wholetext=True)
    want = sorted((r.path, r.t) for r in scan.select(F.col("_metadata.file_path").alias("path"), F.hex("value").alias("t")).collect())
    plans, own = [], J.stored
    monkeypatch.setattr(J, "stored", lambda df, name: plans.append((name, df._jdf.queryExecution().executedPlan().toString())) or own(df, name))
    got = J.read_items(spark, [f"{tmp_path}/d?/*", f"{tmp_path}/_*", f"{tmp_path}/*/x=1"]).select("place", "path", F.hex("text").alias("t")).collect()
    assert sorted((r.path, r.t) for r in got) == want and [r.path for r in sorted(got)] == [p for p, _ in want] and len(want) > 50
    # the driver has a list of the packed files alone
    assert {name for name, plan in plans if "FileScan text" in plan} == {"items-unpacked"}
    one = J.read_items(spark, [f"{tmp_path}/d1/a b.txt", f"{tmp_path}/d1/_hid.txt"]).collect()
    assert [(r.place, r.path.rsplit("/", 1)[1]) for r in one] == [(0, "a%20b.txt")]
    assert J.read_items(spark, [f"{tmp_path}/d2/*.sh"]).collect() == []


def test_items_of_a_folder_named_by_a_glob(spark, tmp_path):
    for folder in ("a/x", "a/y", "b"):
        (tmp_path / folder).mkdir(parents=True)
        (tmp_path / folder / "1.sh").write_text(folder)
    got = J.read_items(spark, [f"{tmp_path}/a*", f"{tmp_path}/b/1.sh", f"{tmp_path}/a/x"]).orderBy("place").collect()
    assert [(r.place, r.text) for r in got] == [(0, "a/x"), (1, "a/y"), (2, "b")]


def test_running_total(spark):
    rows = [(k, (k * 7) % 11) for k in range(500)]
    got = TB.running_total(spark.createDataFrame(rows, "k int, v long").repartition(7), [F.desc("k")], "v", "before", "test").collect()
    want, total = {}, 0
    for k, v in reversed(rows):
        want[k] = total
        total += v
    assert {r.k: r.before for r in got} == want


def test_quota_list_is_the_experiments(spark):
    assert sum(L.BALANCED_QUOTAS.values()) == 10_368
