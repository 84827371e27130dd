import re

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline as P
from concord.llm import training_order as T

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(9000, None, None, None, 0), (None, "null id " * 3 + " ".join(f"u{i}" for i in range(90)), "en", "s", 1), (9001, "", "en", "s", 0)], docs.schema)
    out = [docs.union(odd).withColumn("size", F.lit("extra")).cache()]
    for _, stage in P.STAGES:
        out.append(stage(spark, out[-1], SF).cache())
    return out


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def rows(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_stages_take_effect(spark, stages):
    docs, good, single, clean, mixed, shards = stages
    for s in stages[1:-1]:
        assert s.columns == docs.columns
    n = [s.count() for s in stages]
    assert n[0] > n[1] > n[2] >= n[3] > 0
    # near copies: no two that are left link, every one that went has a link to one that is left or went
    sets = [shingles(t) for _, t in rows(single)]
    for i, a in enumerate(sets):
        for b in sets[:i]:
            both = len(a & b)
            assert not both or 100 * both < 80 * len(a | b)
    # benchmark windows are gone, other texts untouched
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = WORD.findall(lower(r.text))
        windows |= {tuple(w[i:i + 10]) for i in range(max(1, len(w) - 9))}

    def hit(t):
        w = WORD.findall(lower(t))
        return any(tuple(w[i:i + 10]) in windows for i in range(len(w)))
    before = dict(rows(single))
    after = dict(rows(clean))
    assert any(map(hit, before.values())) and not any(map(hit, after.values()))
    assert all(after[d] == t for d, t in before.items() if not hit(t))
    # the mix repeats whole documents, at most three times
    taken = {}
    for r in rows(mixed):
        taken[r] = taken.get(r, 0) + 1
    assert set(taken) <= set(rows(clean)) and max(taken.values()) <= 3


def test_last_stage_holds_the_mixed_texts(stages):
    mixed, shards = stages[-2:]
    vocabulary = T.ranks(T.TOKENIZER)
    enc = tiktoken.Encoding("given", pat_str=T.PATTERN, mergeable_ranks=vocabulary, special_tokens={})
    end = len(vocabulary)
    got = shards.orderBy("shard").collect()
    n = sum(r.n_sequences for r in got)
    ids = {}
    for r in got:
        for k in range(r.n_sequences):
            ids[r.first_slot + k] = np.frombuffer(r.payload, "<u2", r.n_tokens[k], k * r.stride).tolist()
    flat = [i for s in T.permute(np.arange(n), n).tolist() for i in ids[s]]
    cuts = np.flatnonzero(np.array(flat) == end)
    packed = sorted(tuple(flat[a:b]) for a, b in zip([0, *(cuts[:-1] + 1)], cuts))
    assert packed == sorted(tuple(enc.encode_ordinary(r.text or "")) for r in mixed.collect())
    assert {d for r in got for d in r.doc_ids} == {r.doc_id for r in mixed.collect()}


def test_empty_tables(spark, stages):
    for _, stage in P.STAGES:
        assert stage(spark, stages[0].limit(0), SF).count() == 0
