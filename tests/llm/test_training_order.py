import numpy as np
import tiktoken

from concord.llm import training_order as T


def test_permutation():
    for n in (1, 2, 3, 5, 64, 1000, 1025):
        assert sorted(T.permute(np.arange(n), n).tolist()) == list(range(n))
    a, b = T.permute(np.arange(1000), 1000, 1), T.permute(np.arange(1000), 1000, 2)
    assert (a != b).any() and (a != np.arange(1000)).sum() > 900


def test_round_trip(spark, tmp_path):
    texts = [None, "", "one two", "é " * 700, "x" * 5000, "same", "same"] + [f"text {k} " * (k % 37) for k in range(150)]
    rows = [(k, t, "payload") for k, t in enumerate(texts)] + [(None, "no id", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, payload string").repartition(5)
    out = T.shards(docs, length=64, size=7)
    T.write(out, str(tmp_path / "shards"))
    shards = spark.read.parquet(str(tmp_path / "shards")).orderBy("shard").collect()
    n = sum(r.n_sequences for r in shards)
    assert [r.first_slot for r in shards] == list(range(0, n, 7)) and all(r.n_sequences == min(7, n - r.first_slot) for r in shards)
    assert all(len(r.payload) == r.n_sequences * r.stride == r.n_sequences * 128 for r in shards)
    # undo the permutation: the packed ids are the documents' ids
    ids = {r.slot: r.ids for r in T.read(spark, str(tmp_path / "shards"), 0, n).collect()}
    assert sorted(ids) == list(range(n))
    flat = [i for s in T.permute(np.arange(n), n).tolist() for i in ids[s]]
    vocabulary = T.ranks(T.TOKENIZER)
    enc = tiktoken.Encoding("given", pat_str=T.PATTERN, mergeable_ranks=vocabulary, special_tokens={})
    end = len(vocabulary)
    cuts = np.flatnonzero(np.array(flat) == end)
    got = sorted(tuple(flat[a:b]) for a, b in zip([0, *(cuts[:-1] + 1)], cuts))
    assert got == sorted(tuple(enc.encode_ordinary(t or "")) for _, t, _ in rows)
    named = [d for r in shards for d in r.doc_ids]
    assert {d for d in named} == {r[0] for r in rows} and all(sum(r.docs_per_sequence) == len(r.doc_ids) for r in shards)
    middle = T.read(spark, str(tmp_path / "shards"), 5, 11).collect()          # a resumed read
    assert {r.slot: r.ids for r in middle} == {s: ids[s] for s in range(5, 16)}
    assert T.shards(docs.limit(0)).count() == 0
