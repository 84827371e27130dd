"""Readers, pairing by line over several files, preparation, grouping, streaming."""
import pytest
from pyspark.sql import functions as F

from concord.functions import lexicon as L
from concord.operators import curves as C
from concord.operators import jobs as J
from concord.operators import metrics as M
from concord.operators import prep as H
from concord.sources import io as IO


def write_parts(folder, parts):
    folder.mkdir(parents=True)
    for k, lines in enumerate(parts):
        (folder / f"part-{k:05d}.json").write_text("".join(x + "\n" for x in lines))


def test_files_of_unequal_size_line_up(spark, tmp_path):
    sizes = [5, 900, 1, 300]
    ids = iter(range(sum(sizes)))
    pairs, meta = [], []
    for n in sizes:
        block = [next(ids) for _ in range(n)]
        pairs.append([f'{{"translation": {{"src": "s{i}", "prefix": "pres", "tgt": "t{i}"}}}}' for i in block])
    flat = iter(range(sum(sizes)))
    for n in (300, 4, 901, 1):                     # the other table's files are cut elsewhere
        meta.append([f'{{"main_verb": "s{i}", "n_distractors": {i % 7}, "main": "{"x" * (i % 50)}"}}' for i in (next(flat) for _ in range(n))])
    write_parts(tmp_path / "a.json", pairs)
    write_parts(tmp_path / "a_metadata.json", meta)
    p = IO.read_pairs(spark, str(tmp_path / "a.json"))
    m = IO.read_metadata(spark, str(tmp_path / "a_metadata.json"))
    got = IO.pairs_with_metadata(p.select("example_id", "src"), m.select("example_id", "main_verb")).collect()
    assert len(got) == sum(sizes) and all(r.src == r.main_verb == f"s{r.example_id}" for r in got)
    with pytest.raises(ValueError):
        IO.pairs_with_metadata(p.limit(7), m)
    plain = IO.read_validation(spark, str(tmp_path / "a.json"))          # no metadata row has a constraint
    assert plain.columns == ["example_id", "src", "prefix", "tgt"] and plain.count() == sum(sizes)


def test_config_and_formats(spark, tmp_path):
    IO.write_config(spark, str(tmp_path / "config.json"), L.DATASET_CONFIG, L.DATASET_PAIRS, L.DATASET_GRAMMAR)
    assert IO.read_config(spark, str(tmp_path / "config.json")) == (L.DATASET_CONFIG, L.DATASET_PAIRS)
    assert [IO.input_format(x) for x in ("a.json", "b.csv.gz")] == ["json", "csv"]
    for bad in ("a.txt", "plain", "x.json.zip"):
        with pytest.raises(ValueError):
            IO.input_format(bad)
    col = spark.createDataFrame([("a.json.gz",), ("b.csv",), ("c.txt",)], "p string").select(IO.input_format_col("p").alias("f")).collect()
    assert [r.f for r in col] == ["json", "csv", None]


def test_scoring_needs_equal_lengths(spark, tmp_path):
    (tmp_path / "pred.txt").write_text("The student helps the dean.\n")
    (tmp_path / "en_RC_PP-t.json").write_text('{"translation": {"src": "a", "prefix": "pres", "tgt": "The student helps the dean."}}\n' * 2)
    (tmp_path / "en_RC_PP-t_metadata.json").write_text("{}\n" * 2)
    with pytest.raises(ValueError):
        M.score_files(spark, str(tmp_path / "pred.txt"), str(tmp_path / "en_RC_PP-t.json"))
    (tmp_path / "pred.txt").write_text("The student helps the dean.\nthe student helps the dean.\n")
    r = M.score_files(spark, str(tmp_path / "pred.txt"), str(tmp_path / "en_RC_PP-t.json"), names=["exact_match", "ignorecase_exact_match"])
    assert [(x.exact_match, x.ignorecase_exact_match) for x in r.orderBy("example_id").collect()] == [(True, True), (False, True)]


def test_preparation_columns(spark):
    df = spark.createDataFrame([(1, "a", None, None), (2, "b", 3, None)], f"id long, src string, {IO.CONSTRAINTS[0]} int, {IO.CONSTRAINTS[1]} array<string>")
    out = H.with_constraint_defaults(df)
    assert out.columns == ["id", "src", IO.CONSTRAINTS[0]] and [r[2] for r in out.orderBy("id").collect()] == [0, 3]
    assert H.prepared_columns(df.columns, True) == df.columns and H.prepared_columns(df.columns, False) == ["id", "src"]
    ids = spark.createDataFrame([(1, list(range(2000))), (2, [5, 1])], "id long, ids array<int>")
    r = {x.id: x for x in H.prepare(df, "id", ids, ids, training=False).collect()}
    assert (len(r[1].input_ids), r[1].input_ids[-1], len(r[1].labels), r[1].labels[-1]) == (1024, 1, 128, 1)
    assert H.split_fields(out.withColumn("x", F.array(F.lit(1))).schema)[0] == ["x"]


def test_allowed_tokens_with_alternatives_of_unequal_length(spark):
    vocab = spark.createDataFrame([("the", 3), ("dean", 4), ("helps", 5), ("help", 6)], "word string, token_id int")
    df = spark.createDataFrame([(1, ["the", "dean"], [["helps"], ["help", "the", "dean"]]), (2, [], [["helps"], ["odd"]])], "id long, p array<string>, a array<array<string>>")
    got = {(r.id, r.pos): (r.allowed, r.opens_word, r.open_all) for r in H.allowed_by_position(df, "id", "p", "a", vocab).collect()}
    assert got == {(1, 0): ([3], False, False), (1, 1): ([4], False, False), (1, 2): ([5, 6], False, False), (1, 3): ([3], True, False),
                   (1, 4): ([4], False, True), (2, 0): ([2, 5], False, False)}


def test_vocabulary_and_encode_keep_empty_rows(spark):
    df = spark.createDataFrame([(1, ["b", "a", "b"]), (2, []), (3, ["zz"])], "id long, toks array<string>")
    v = H.vocabulary(df.where("id < 3"), "toks")
    assert {(r.word, r.n, r.token_id) for r in v.collect()} == {("b", 2, 3), ("a", 1, 4)}
    assert {r.id: r.ids for r in H.encode(df, "id", "toks", v).collect()} == {1: [3, 4, 3, 1], 2: [1], 3: [2, 1]}


def test_header_options_and_globs(spark):
    script = "#!/bin/sh\n#SBATCH --job-name=a\n#SBATCH --mem=30GB\n#SBATCH --output=x\n#SBATCH --time=48:00:00\nrun --mem=1"
    df = spark.createDataFrame([(1, script), (2, script.replace("=a", "=b")), (3, "run")], "k long, t string")
    r = {x.k: (x.signature, x.n_items) for x in J.header_groups(df, "k", J.header_signature(F.col("t"))).collect()}
    assert r[1] == r[2] == ("mem=30GB\ntime=48:00:00", 2) and r[3] == ("", 1)
    paths = spark.createDataFrame([("scripts/a/x.sh",), ("scripts/y.sh",), ("scripts/a/b/z.txt",)], "p string")
    assert [x.p for x in J.select_items(paths, "p", ["scripts/**/*.sh"], ".sh").collect()] == ["scripts/a/x.sh", "scripts/y.sh"]
    assert [x.p for x in J.select_items(paths, "p", ["scripts/*"], regex="scripts/y").collect()] == ["scripts/y.sh"]


def test_curves_and_reports(spark):
    rows = [(520, "pres", None, True, None), (520, "pres", "x", False, None), (520, "past", "x", None, None), (1040, "pres", "x", True, None)]
    df = spark.createDataFrame(rows, "iteration int, tense string, v string, m boolean, dead boolean")
    counts = C.group_counts(df, ["m", "dead"], ["v"])
    got = {(r.iteration, r.metric, r.grp): (r["mean"], r.n) for r in C.grouped_curve(counts).collect()}
    assert got == {(520, "m", "pres + None"): (1.0, 1), (520, "m", "pres + x"): (0.0, 1), (1040, "m", "pres + x"): (1.0, 1)}
    assert {(r.metric, r.n_non_null, r.all_null) for r in C.all_null(counts).collect()} == {("m", 3, False), ("dead", 0, True)}
    assert C.grouping_vars(["pos_sequence", "tense", "main_verb", "predict_x", "condition"]) == ["main_verb", "condition"]


def test_cluster_without_shared_folder_is_an_error():
    from concord import session

    class Conf:
        def get(self, *_):
            return None

    class Fake:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://host:7077"})()

    with pytest.raises(RuntimeError):
        session.ensure_checkpoint_dir(Fake())
