"""Personal data: patterns with check rules, and a character BiLSTM-CRF for the forms they miss.

Base spans come from four patterns (email, ip, card, phone), each found leftmost
and without overlaps; a match that fails its check (octets, digits, Luhn) is
dropped.  The scans are linear in the text: an email is read outward from its
``@``, the digit patterns give nothing back.

The tagger (``char_tagger``) learns from labelled spans.  ``fit`` makes them from
a bounded sample of the documents: windows with what the patterns' shapes mark in
them, and the same windows with generated personal data written into them, in
the patterns' forms and in others (spelled-out ``at`` and ``dot``, bracketed dots,
other separators, no country code), and with look-alikes that are none (dates,
prices, versions, keys).

Texts are read in overlapping windows.  The best path of each window proposes spans;
those cut by a window's inner border are left to the next window, which holds them
whole.  A proposal must have a posterior of at least ``SURE`` at every character and
pass its kind's check after the spelling is normalised, so it holds a digit, an
``@`` or a bracketed ``at``.  Windows without any of these can propose nothing and are
not read, which changes no result.  All proposals of a text then are reconciled
globally: those that meet a base span go, and of the rest the disjoint set
with the highest total weight stays.

Defined cases: null text is empty and has no spans; offsets are code points, end
exclusive; repeated rows are judged alike; an empty table trains on generated
text alone; a sample without personal data does, too.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .char_tagger import Tagger, codes
from .common import map_batches

KINDS = ("email", "ip", "card", "phone")
WINDOW, STRIDE = 128, 64           # characters read at once; spans of up to WINDOW - STRIDE are whole in a window
SURE = 0.5                         # posterior of every tag of a span
READ = 256                         # windows decoded at once
FIT_WINDOWS = 1200                 # sampled windows at most, one per text
FIT_COPIES = 2                     # versions of each with generated spans
FIT_EPOCHS, FIT_WIDTH = 14, 96
PREFIX = "__pii_"

DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
EVIDENCE = re.compile(r"[0-9@]|[(\[{<] ?(?:at|AT) ?[)\]}>]")


def digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(number: str) -> bool:
    total = sum(map(int, number[-1::-2])) + sum(2 * d - 9 if d > 4 else 2 * d for d in map(int, number[-2::-2]))
    return total % 10 == 0


def octets(parts: list[str]) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in parts)


def _emails(text: str) -> Iterator[tuple[int, int]]:
    last = at = 0
    while (at := text.find("@", at)) >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at) if start < at else None
        at += 1
        if found:
            yield start, found.end()
            last = at = found.end()


def shapes(text: str) -> list[tuple[int, int, str, bool]]:
    """(start, end, kind, passes its check) of all matches of the patterns."""
    out = [(s, e, "email", True) for s, e in _emails(text)]
    out += [(m.start(), m.end(), "ip", octets(m[0].split("."))) for m in IP.finditer(text)]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            number = digits(m[0])
            out.append((m.start(), m.end(), "card", 14 <= len(number) <= 19 and luhn(number)))
    out += [(m.start(), m.end(), "phone", 10 <= len(digits(m[0])) <= 15) for m in PHONE.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    return [s[:3] for s in shapes(text) if s[3]]


# -- checks of the tagger's proposals ------------------------------------------------------------------

AT = re.compile(r" ?(?:@|[(\[{<] ?(?:at|AT) ?[)\]}>]) ?")
DOT = re.compile(r" ?(?:\.|[(\[{<] ?(?:dot|DOT|\.) ?[)\]}>]) ?")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
CARD_CHARS = re.compile(r"[0-9 ./_-]+")
PHONE_FORM = re.compile(r"(?:(?:\+|00)[0-9]{1,3}[ ./-]*)?(?:\([0-9]{2,5}\)|[0-9]{2,5})(?:[ ./-]{1,2}[0-9]{2,5}){2,4}|\([0-9]{2,5}\) ?[0-9]{3,4}[ ./-][0-9]{3,5}")


def passes(kind: str, span: str) -> bool:
    """Whether a proposed span is valid once its spelling is normalised."""
    if kind == "email":
        return EMAIL.fullmatch(DOT.sub(".", AT.sub("@", span))) is not None
    if kind == "ip":
        parts = DOT.sub(".", span).split(".")
        return len(parts) == 4 and all(p.isascii() and p.isdigit() for p in parts) and octets(parts)
    number = digits(span)
    if kind == "card":
        return CARD_CHARS.fullmatch(span) is not None and 14 <= len(number) <= 19 and luhn(number)
    return PHONE_FORM.fullmatch(span) is not None and 10 <= len(number) <= 15


def runs(tags: list[str], path: np.ndarray, sure: np.ndarray) -> Iterator[tuple[int, int, str, float]]:
    """(start, end, kind, least posterior) of a window's tagged spans."""
    k = 0
    marked = np.flatnonzero(path)
    while k < len(marked):
        start = int(marked[k])
        kind = tags[path[start]][2:]
        inside = tags.index(f"I-{kind}")
        end = start + 1
        while end < len(path) and path[end] == inside:
            end += 1
        yield start, end, kind, float(sure[start:end].min())
        k += end - start


def windows_of(text: str) -> list[int]:
    """Starts of the windows that hold evidence."""
    found = {m.start() // STRIDE for m in EVIDENCE.finditer(text)} | {(m.end() - 1) // STRIDE for m in EVIDENCE.finditer(text)}
    found |= {k - 1 for k in found if k}
    last = max(0, -(-(len(text) - WINDOW) // STRIDE))          # later windows would lie inside this one
    return [k * STRIDE for k in sorted({min(k, last) for k in found})]


def proposals(tagger: Tagger, texts: list[str], starts: list[list[int]] | None = None) -> list[list[tuple[int, int, str, float]]]:
    """Checked spans of each text by its windows (those with evidence)."""
    starts = [windows_of(t) for t in texts] if starts is None else starts
    asked = [(r, s) for r, own in enumerate(starts) for s in own]
    found: list[list[tuple[int, int, str, float]]] = [[] for _ in texts]
    for lo in range(0, len(asked), READ):
        some = asked[lo:lo + READ]
        path, sure = tagger.decode(codes([texts[r][s:s + WINDOW] for r, s in some], WINDOW))
        for (r, s), p, q in zip(some, path, sure):
            text = texts[r]
            for start, end, kind, least in runs(tagger.tags, p, q):
                cut = (start == 0 and s > 0) or (end == WINDOW and s + WINDOW < len(text))
                if not cut and least >= SURE and passes(kind, text[s + start:s + end]):
                    found[r].append((s + start, s + end, kind, round(float(least), 3)))     # last digits depend on which windows are read together
    return found


def reconcile(base: list[tuple[int, int, str]], proposed: list[tuple[int, int, str, float]]) -> list[tuple[int, int, str]]:
    """The disjoint proposals, clear of base spans, with the highest total weight."""
    best: dict[tuple[int, int, str], float] = {}
    base = sorted(base)
    tops = np.maximum.accumulate([e for _, e, _ in base]) if base else []
    for s, e, kind, sure in proposed:
        k = bisect_right(base, e - 1, key=lambda b: b[0])      # base spans that begin before e
        if not k or tops[k - 1] <= s:
            best[s, e, kind] = max(best.get((s, e, kind), 0.0), sure * (e - s))
    spans = sorted(best, key=lambda x: (x[1], x[0], KINDS.index(x[2])))
    ends = [x[1] for x in spans]
    total, take = [0.0], []
    for k, x in enumerate(spans):
        before = bisect_right(ends, x[0], 0, k)
        with_it = total[before] + best[x]
        take.append((with_it > total[-1], before))
        total.append(max(with_it, total[-1]))
    out, k = [], len(spans)
    while k:
        taken, before = take[k - 1]
        if taken:
            out.append(spans[k - 1])
        k = before if taken else k - 1
    return out[::-1]


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """``text`` with its spans (they may overlap) as ``[KIND]``."""
    out, last = [], 0
    for s, e, kind in sorted(spans):
        if s >= last:
            out += [text[last:s], f"[{kind.upper()}]"]
        last = max(last, e)
    return "".join([*out, text[last:]])


# -- labelled spans ------------------------------------------------------------------------------------

TOP_LEVEL = ("com", "org", "net", "de", "fr", "es", "example.com", "co.uk")
AT_FORMS = ("@", "@", "@", " (at) ", "(at)", " [at] ", "[at]", " @ ", " {at} ", " <at> ", " (AT) ", "[AT]")
DOT_FORMS = (" (dot) ", "(dot)", " [dot] ", "[dot]", ".", "[.]", " (DOT) ", "[DOT]")
IP_FORMS = (".", ".", "[.]", "(.)", " . ", ". ", " .", "[dot]", " [dot] ", "{.}")
CARD_FORMS = ("", " ", "-", ".", "/", "_", " - ", "  ", " / ")
PHONE_FORMS = ("+{c} ({a}) {b}-{d}", "+{c} {a} {b} {d}", "+{c}{a}{b}{d}", "({a}) {b}-{d}", "{a}-{b}-{d}", "{a}.{b}.{d}", "{a} {b} {d}", "{a}/{b}/{d}",
               "00{c} {a} {b} {d}", "00{c}-{a}-{b}-{d}", "+{c}/{a}/{b}/{d}", "({a}) {b} {d}", "+{c}.{a}.{b}.{d}", "00{c} ({a}) {b}-{d}")


def _letters(rng, lo: int, hi: int) -> str:
    return "".join(rng.choice(list("abcdefghijklmnoprstuvwz"), int(rng.integers(lo, hi))))


def _numerals(rng, n: int) -> str:
    return "".join(map(str, rng.integers(0, 10, n)))


def generate(rng: np.random.Generator, kind: str) -> str:
    """Invented personal data of a kind, in one of its forms."""
    if kind == "email":
        name = _letters(rng, 2, 12) + ("", ".", "_", "-")[rng.integers(4)] + (_numerals(rng, int(rng.integers(1, 4))), _letters(rng, 2, 8))[rng.integers(2)]
        at = AT_FORMS[rng.integers(len(AT_FORMS))]
        dot = "." if at == "@" or rng.integers(3) == 0 else DOT_FORMS[rng.integers(len(DOT_FORMS))]
        host = _letters(rng, 2, 10) + (_numerals(rng, 1) if rng.integers(2) else "") + "." + TOP_LEVEL[rng.integers(len(TOP_LEVEL))]
        return name + at + host.replace(".", dot)
    if kind == "ip":
        return IP_FORMS[rng.integers(len(IP_FORMS))].join(str(x) for x in rng.integers(0, 256, 4))
    if kind == "card":
        n = int(rng.choice([16, 16, 16, 15, 14, 19]))
        number, form = _numerals(rng, n), CARD_FORMS[rng.integers(len(CARD_FORMS))]
        cuts = [4, 10] if n in (14, 15) else list(range(4, n, 4))
        return form.join(number[a:b] for a, b in zip([0, *cuts], [*cuts, n]))
    form = PHONE_FORMS[rng.integers(len(PHONE_FORMS))]
    return form.format(c=rng.integers(1, 100), a=_numerals(rng, int(rng.integers(3, 5))), b=_numerals(rng, int(rng.integers(3, 4))), d=_numerals(rng, int(rng.integers(4, 6))))


def look_alike(rng: np.random.Generator) -> str:
    """Invented text with digits or signs that is no personal data."""
    n = lambda *x: int(rng.integers(*x))                       # noqa: E731
    return (lambda: f"{n(1900, 2040)}-{n(1, 13):02}-{n(1, 29):02}", lambda: f"{n(1, 29):02}.{n(1, 13):02}.{n(1900, 2040)}",
            lambda: f"${n(1, 999)},{n(0, 1000):03}.{n(0, 100):02}", lambda: f"v{n(0, 20)}.{n(0, 30)}.{n(0, 30)}", lambda: f"{n(0, 24)}:{n(0, 60):02}",
            lambda: f'token = "{"".join(rng.choice(list("0123456789abcdef"), 40))}"', lambda: str(n(0, 10 ** n(1, 10))), lambda: f"{n(1, 100)} %",
            lambda: f"{n(0, 10)}.{n(0, 10)}.", lambda: f"@{_letters(rng, 3, 9)}", lambda: f"{_letters(rng, 3, 8)} at {_letters(rng, 3, 8)}.",
            lambda: f"({n(1900, 2040)})", lambda: f"{n(1, 500)}-{n(500, 999)}", lambda: f"{n(1, 10)}/{n(1, 10)}", lambda: f"#{n(1, 99999)}",
            lambda: f"{n(1000, 9999)} {n(10, 99)}", lambda: f"{n(0, 99)}.{n(0, 9999)}")[rng.integers(17)]()


def labelled(samples: list[str], seed: int, copies: int = FIT_COPIES, width: int = FIT_WIDTH) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Labelled examples (text, spans) of at most ``width`` characters made of sampled windows."""
    rng = np.random.default_rng(seed)
    out = []
    for text in samples:
        text = text[:width]
        marked = [s[:3] for s in shapes(text) if s[1] < len(text) or len(text) < width]    # not those that the cut made shorter
        out.append((text, marked))
        plain = text if not marked else re.sub("[0-9@]", "x", text)
        for _ in range(copies):
            cuts = sorted({0, *(m.end() for m in re.finditer(r"\s", plain))})
            at = cuts[rng.integers(len(cuts))]
            kind = KINDS[rng.integers(4)] if rng.integers(4) else ""
            piece = generate(rng, kind) if kind else look_alike(rng)
            lead = ("", "", "", ": ", "(", '"', "| ", "\n")[rng.integers(8)]
            after = (" ", " ", " ", " ", ", ", ". ", "\n", "; ", ")")[rng.integers(9)]
            room = width - len(lead) - len(piece) - int(rng.integers(width // 3))
            if room < 0:
                continue
            example = plain[max(0, at - room):at] + lead
            spans = [(len(example), len(example) + len(piece), kind)] if kind else []
            out.append(((example + piece + after + plain[at:])[:width], spans))
    return out


def train(examples: list[tuple[str, list[tuple[int, int, str]]]], epochs: int = FIT_EPOCHS, width: int = FIT_WIDTH, seed: int = 13) -> Tagger:
    """A tagger from labelled examples (text, spans (start, end, kind)); of overlapping spans the first counts."""
    tagger = Tagger.fresh(KINDS, seed)
    x, y = codes([t[:width] for t, _ in examples], width), np.zeros((len(examples), width), np.int64)
    for k, (text, spans) in enumerate(examples):
        for s, e, kind in sorted(spans):
            if e <= min(width, len(text)) and not y[k, s:e].any():
                y[k, s:e] = tagger.tags.index(f"I-{kind}")
                y[k, s] -= 1
    tagger.train(x, y, epochs, seed=seed)
    return tagger


def sample(docs: DataFrame, most: int = FIT_WINDOWS) -> list[str]:
    """At most ``most`` windows, one each of so many distinct texts: around the first mark of the patterns, else at a place drawn by the text's hash."""
    n = docs.count()
    if not n:
        return []
    draw = F.pmod(F.xxhash64("text", F.lit(29)), F.lit(1 << 30))
    some = docs.select("text", draw.alias("draw")).where("text is not null and text <> ''").where(F.col("draw") < int(min(1.0, 8 * most / n) * (1 << 30)))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = []
            for text, d in zip(batch.column("text").to_pylist(), batch.column("draw").to_pylist()):
                marks = shapes(text)
                at = max(0, marks[d % len(marks)][0] - d % (FIT_WIDTH // 3)) if marks else d * 7919 % len(text)
                rows.append((text[at:at + FIT_WIDTH], d, not marks))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.bool_()))], names=["window", "draw", "plain"])

    held = map_batches(some, run, "window string, draw long, plain boolean").groupBy("window", "plain").agg(F.min("draw").alias("draw"))
    return [r.window for plain in (False, True) for r in held.where(F.col("plain") == plain).orderBy("draw", "window").limit(most // 2).collect()]


def fit(docs: DataFrame, seed: int = 13) -> Tagger:
    """A tagger for these documents, from a sample of ``FIT_WINDOWS`` windows."""
    samples = sample(docs)
    rng = np.random.default_rng(seed)
    while len(samples) < FIT_WINDOWS // 2:                     # small tables: generated text stands in
        samples.append(" ".join(_letters(rng, 1, 10) for _ in range(24)))
    return train(labelled(samples, seed), seed=seed)


def find(docs: DataFrame, tagger: Tagger, columns: list[str]) -> DataFrame:
    """``columns`` of docs, the spans (kind, start, end, base) by start and kind, and the redacted text, under prefixed names."""
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("base", T.BooleanType())])
    schema = T.StructType([*docs.select(*columns).schema, T.StructField(PREFIX + "spans", T.ArrayType(span)), T.StructField(PREFIX + "redacted", T.StringType())])
    spans_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))

    def run(batches):
        for batch in batches:
            for part in W.slices(batch, PREFIX + "text"):
                texts = [t or "" for t in part.column(PREFIX + "text").to_pylist()]
                hot = [r for r, t in enumerate(texts) if EVIDENCE.search(t)]
                every: list[list[dict]] = [[] for _ in texts]
                clean = list(texts)
                for r, proposed in zip(hot, proposals(tagger, [texts[r] for r in hot])):
                    base = base_spans(texts[r])
                    added = reconcile(base, proposed)
                    both = [(*s, True) for s in base] + [(*s, False) for s in added]
                    both.sort(key=lambda s: (s[0], KINDS.index(s[2])))
                    every[r] = [{"kind": k, "start": s, "end": e, "base": b} for s, e, k, b in both]
                    clean[r] = redact(texts[r], [s[:3] for s in both])
                arrays = [part.column(c) for c in columns] + [pa.array(every, spans_type), pa.array(clean, pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return map_batches(docs.select(*columns, F.col("text").alias(PREFIX + "text")), run, schema)
