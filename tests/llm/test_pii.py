import hashlib
import random
import re
import time

import numpy as np
import pytest

from concord.llm import pii, queries
from concord.llm.char_tagger import Tagger, codes

SF = "/root/testdata/sf0.001"
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def naive(text):
    """The contract's patterns as they stand."""
    out = []
    for order, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            d = [int(c) for c in re.findall("[0-9]", m[0])]
            ok = True
            if kind == "ip":
                ok = all(int(p) <= 255 for p in m[0].split("."))
            elif kind == "card":
                doubled = [x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d))]
                ok = 14 <= len(d) <= 19 and sum(doubled) % 10 == 0
            elif kind == "phone":
                ok = 10 <= len(d) <= 15
            if ok:
                out.append((m.start(), order, m.end(), kind))
    return [(s, e, k) for s, _, e, k in sorted(out)]


@pytest.fixture(scope="module")
def tagger(spark):
    return pii.fit(spark.read.parquet(f"{SF}/documents.parquet"))


def test_base_spans_equal_the_patterns():
    rng = random.Random(2)
    for alphabet in ("1. ", "a@.-", "0123456789 -+().", "a1@.+-é", "12. 555+@x\n"):
        for _ in range(4000):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(60)))
            assert pii.base_spans(text) == naive(text), text
    text = "x a@b.c@d.e 4111 1111 1111 1111 +1 (555) 010-9999. 000255.1.1.256.7.8.9 \U0001f600 me@x.y"
    assert pii.base_spans(text) == naive(text) and len(naive(text)) == 3


def test_base_spans_take_linear_time():
    for piece in ("1", "a", "1.", "1.1.1.", "a@", "+1", "1-", "+1(", "a.b-", "@a.", "4 "):
        text = piece * (1_000_000 // len(piece))
        began = time.process_time()
        pii.base_spans(text)
        assert time.process_time() - began < 8, piece


def test_gradients():
    t = Tagger.fresh(pii.KINDS, 1)
    t.weights = {k: v.astype(np.float64) for k, v in t.weights.items()}
    x, y = codes(["ab@c.de 12", "+1 (555) é"], 12), np.zeros((2, 12), int)
    y[0, 0], y[0, 1:7] = 1, 2
    _, grads = t.gradients(x, y)
    rng = np.random.default_rng(0)
    for name, g in grads.items():
        places = [tuple(rng.integers(s) for s in g.shape) for _ in range(3)] + [np.unravel_index(np.abs(g).argmax(), g.shape)]
        for at in places:
            w, old = t.weights[name], t.weights[name][at]
            w[at] = old + 5e-3
            up, _ = t.gradients(x, y)
            w[at] = old - 5e-3
            down, _ = t.gradients(x, y)
            w[at] = old
            assert abs((up - down) / 1e-2 - g[at]) < 1e-3 + 1e-2 * abs(g[at]), name


def test_posteriors_and_best_path_against_all_paths():
    from itertools import product

    t = Tagger.fresh(("a",), 4)
    t.weights["move"] = np.random.default_rng(1).standard_normal((3, 3)).astype(np.float32)
    x = codes(["a1@x"], 4)
    scores, (move, start) = t.emissions(x)[0].astype(float), t.moves()
    paths = list(product(range(3), repeat=4))
    value = np.array([start[p[0]] + sum(scores[i, p[i]] for i in range(4)) + sum(move[p[i], p[i + 1]] for i in range(3)) for p in paths])
    share = np.exp(value - value.max())
    share /= share.sum()
    path, sure = t.decode(x)
    assert tuple(path[0]) == paths[value.argmax()]
    for i in range(4):
        assert abs(sum(s for p, s in zip(paths, share) if p[i] == path[0, i]) - sure[0, i]) < 1e-5


def test_held_out_spans(spark, tagger):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(400).collect()]
    test = pii.labelled([t[200:296] for t in texts if len(t) > 400], seed=99)
    hit = n = wrong = missed_by_base = 0
    for (text, spans), found in zip(test, pii.proposals(tagger, [t for t, _ in test])):
        want = {s for s in spans if pii.passes(s[2], text[s[0]:s[1]])}
        got = {f[:3] for f in found}
        hit, n, wrong = hit + len(want & got), n + len(want), wrong + len(got - want)
        missed_by_base += len((want & got) - set(pii.base_spans(text)))
    assert n > 200 and hit > 0.85 * n and wrong < 0.02 * n and missed_by_base > 0.3 * n


def test_windows_without_evidence_propose_nothing(spark, tagger):
    rng = random.Random(3)
    texts = [r.text[:4000] for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    gen = np.random.default_rng(4)
    for k in range(len(texts)):
        for _ in range(3):
            at = rng.randrange(len(texts[k]))
            texts[k] = texts[k][:at] + " " + pii.generate(gen, pii.KINDS[rng.randrange(4)]) + " " + texts[k][at:]
    every = [list(range(0, max(1, len(t) - pii.WINDOW + pii.STRIDE), pii.STRIDE)) for t in texts]
    assert sum(map(len, map(pii.windows_of, texts))) < sum(map(len, every))
    some = pii.proposals(tagger, texts)
    assert [set(f) for f in some] == [set(f) for f in pii.proposals(tagger, texts, every)] and any(some)


def test_spans_at_window_borders(tagger):
    found = tried = 0
    for form, kind in (("kowal7 (at) mail3.com", "email"), ("10[.]20[.]30[.]40", "ip"), ("4539.1488.0343.6467", "card"), ("0049 170 555 0123", "phone")):
        for at in range(0, 3 * pii.STRIDE, 5):
            text = "the rain fell and " * 30
            text = text[:at] + " " + form + " " + text[at:]
            got = {f[:3] for f in pii.proposals(tagger, [text])[0]}     # two windows may propose it
            assert len(got) <= 1
            tried, found = tried + 1, found + ((at + 1, at + 1 + len(form), kind) in got)
    assert found > 0.9 * tried


def test_reconcile_takes_the_heaviest_disjoint_set():
    rng = random.Random(6)
    for _ in range(300):
        spans = [(s := rng.randrange(30), s + rng.randrange(1, 9), rng.choice(pii.KINDS), rng.choice([0.5, 0.7, 1.0])) for _ in range(rng.randrange(9))]
        base = [(s := rng.randrange(30), s + rng.randrange(1, 4), "ip") for _ in range(rng.randrange(3))]
        free = [x for x in spans if not any(x[0] < e and s < x[1] for s, e, _ in base)]
        got = pii.reconcile(base, spans)
        assert all(a[1] <= b[0] for a, b in zip(got, got[1:]))
        weight = lambda chosen: sum(max(q * (e - s) for s, e, k, q in free if (s, e, k) == c) for c in chosen)      # noqa: E731, B023
        best = 0.0
        for mask in range(1 << len(free)):
            chosen = sorted({x[:3] for i, x in enumerate(free) if mask >> i & 1})
            if all(a[1] <= b[0] for a, b in zip(chosen, chosen[1:])):
                best = max(best, weight(chosen))
        assert abs(weight(got) - best) < 1e-9


def test_nulls_long_texts_and_clashing_columns(spark, tagger):
    long = "words without end " * 60_000 + "me@here.org and 10.0.0.1 " + "1" * 50_000 + " tail"
    rows = [(1, None, "a", 3), (2, "", "a", 3), (3, long, None, 3), (None, "call +49 30 1234567890 now", "a", 3), (3, "same +1 (222) 555-1234", "a", 3), (3, "same +1 (222) 555-1234", "a", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string, start int")
    got = pii.find(docs, tagger, docs.columns).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in got) == sorted((r[0] or 0, r[1] or "") for r in rows)
    for r in got:
        spans = [(s["start"], s["end"], s["kind"]) for s in r["__pii_spans"] if s["base"]]
        assert spans == naive(r.text) and r["__pii_redacted"] == pii.redact(r.text or "", [(s["start"], s["end"], s["kind"]) for s in r["__pii_spans"]])
    assert {r["__pii_redacted"] for r in got if r.doc_id is None} == {"call [PHONE] now"}
    empty = docs.where("doc_id = 99")
    assert pii.sample(empty) == [] and pii.find(empty, tagger, ["doc_id"]).collect() == []


def test_query_over_its_table(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.QUERIES["op13_pii"](spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        base = naive(docs[r.doc_id])
        joined = [f"{k}:{s}:{e}" for s, e, k in base]
        assert r.base_sha256 == hashlib.sha256(",".join(joined).encode()).hexdigest() and set(joined) <= set(r.spans.split(",")) | {""}
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for *_, k in base) for kind in pii.KINDS]
