"""Hard negatives, personal data and phrases against plain computations."""

import itertools
import math
import random
import re
import string
import time
import uuid
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from loomgraph.llm import decontaminate, html, negatives, personal, phrases, secrets

from . import cases

# 11 --------------------------------------------------------------------------------


def plain_negatives(rows, is_anchor, positives=5, negatives_=3, low=50, high=95):
    fine, seen = [], set()
    for i, x, label in rows:
        if i is None or label is None or x is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        v = tuple(math.floor(256.0 * float(np.float32(c))) for c in x)
        if (i, v, label) not in seen:
            seen.add((i, v, label))
            fine.append((i, v, label))
    dot = lambda a, b: sum(p * q for p, q in zip(a, b, strict=False))
    out = []
    for i, v, label in fine:
        if not is_anchor(i):
            continue
        scored = [(dot(v, w), j, m) for j, w, m in fine if j != i]
        pos = sorted(((-s, j) for s, j, m in scored if m == label))[:positives]
        for s, j in pos:
            neg = sorted((-t, k) for t, k, m in scored if m != label and low * -s <= 100 * t <= high * -s)[:negatives_]
            out += [(i, j, rank + 1, k, -s, -t) for rank, (t, k) in enumerate(neg)]
    return sorted(out)


def vectors(seed, n, width=12):
    rng = np.random.default_rng(seed)
    hot = rng.normal(0, 0.3, width)
    centres = rng.normal(0, 0.4, (5, width))
    rows = []
    for i in range(n):
        x = hot if i % 3 == 0 else centres[i % 5] + rng.normal(0, 0.1, width)
        rows.append((i, [float(np.float32(c)) for c in x], int(rng.integers(0, 4))))
    rows += [(n + 1, None, 1), (n + 2, [0.1] * width, None), (None, [0.2] * width, 1), (n + 3, [0.1, None] + [0.0] * (width - 2), 1), (n + 4, [float("nan")] * width, 2), (n + 5, [float("inf")] + [0.1] * (width - 1), 2)]
    rows += [(n + 6, [], 1), (n + 7, [0.3, 0.2], 2), (n + 8, [0.0] * width, 3), (n + 9, [0.5] * (width + 3), 2), (n + 10, [900.0] * width, 1), rows[7], rows[20], rows[20], (21, rows[25][1], 1), (40, rows[31][1], 2)]
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_hard_negatives(spark, monkeypatch, small):
    if small:  # many parts and groups
        monkeypatch.setattr(negatives, "PART", 16)
        monkeypatch.setattr(negatives, "GROUP", 4)
    rows = vectors(3, 260)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 AS score", "2 AS cell", "3 AS anchor").repartition(5)
    got = negatives.hard_negatives(df, "vec_id % 10 = 0")
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = plain_negatives(rows, lambda i: i % 10 == 0)
    assert len(want) > 100 and sorted(tuple(r) for r in got.collect()) == want
    none = negatives.hard_negatives(df.limit(0), "vec_id % 10 = 0")
    assert none.count() == 0 and none.schema == got.schema
    assert negatives.hard_negatives(df.where("vec_id > 270"), "true").columns == got.columns


def test_bounds_hold():
    """No vector that reaches a score lies outside of the distances told for its cell."""
    rng = np.random.default_rng(1)
    x = rng.integers(-90, 90, (400, 8)).astype(float) * rng.uniform(0.1, 2, (400, 1)).round(1)
    x = np.floor(x)
    c = negatives.Cells(x[:200].astype(np.int64), float((x * x).sum(1).max()), 9)
    d = c.distances(c.augmented(x))
    cell, away = d.argmin(1), d.min(1)
    s = x[:50] @ x.T
    least = np.sort(s, 1)[:, -6]
    low, high = c.bounds(x[:50], least)
    for a, b in zip(*np.nonzero(s >= least[:, None]), strict=True):
        assert low[a, cell[b]] <= away[b] <= high[a, cell[b]]
    outside = np.mean([(away < low[a, cell]) | (away > high[a, cell]) for a in range(50)])
    assert outside > 0.01  # the bounds are of use


def test_products_exact():
    a, b = np.array([[2**31 - 1, -(2**31) + 1], [1, 2]]), np.array([[2**31 - 1, 5], [3, 4], [-(2**31) + 1, 2**31 - 1]])
    want = [[max(-(2**63), min(2**63 - 1, sum(int(p) * int(q) for p, q in zip(x, y, strict=True)))) for y in b] for x in a]
    assert negatives.products(a, b).tolist() == want
    r = np.random.default_rng(0).integers(-200, 200, (7, 64))
    assert (negatives.products(r, r) == r @ r.T).all()


# 12 --------------------------------------------------------------------------------


def plain_base(text):
    luhn = lambda ds: sum(sum(divmod(int(d) * (1 + k % 2), 10)) for k, d in enumerate(reversed(ds))) % 10 == 0
    digits = lambda s: [c for c in s if c in "0123456789"]
    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(digits(s)) <= 19 and luhn(digits(s))), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(digits(s)) <= 15),
    ]
    return [(m.start(), m.end(), kind) for kind, p, ok in rules for m in re.finditer(p, text) if ok(m[0])]


PII = [
    "", "a@b.c", "a@b.c@d.e", "x.y+z@mail-1.example.com.", "a@b..c", "@a.b", "a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "256.1.1.1", "01.002.0003.255", "999.1.2.3.4", "4111 1111 1111 1111", "4111-1111-1111-1111x", "41111111111111111111",
    "4111  1111 1111 1111", "+1 (017) 555-7713.", "+1 (017) 555-7713 and +49 30 1234567", "+1", "++12345678", "+1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6", "é+4912345678é", "a@b.c-1.2.3.4", "😀 4111111111111111 a@b.co",
]


def test_base_spans():
    rng = random.Random(4)
    parts = ["a@b.c", "@", ".", " ", "-", "12", "1.2.3.4", "+4912345678", "4111111111111111", "4111 1111 1111 1111", "(", ")", "x", "é", "_", "%", "+", "0", "255.255", "\n"]
    texts = PII + ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 14))) for _ in range(4000)]
    for t in texts:
        assert personal.base_spans(t) == plain_base(t), t
    for t in ["a" * 300_000, "1" * 300_000, "1 " * 150_000, "a@" * 100_000, "1." * 100_000, "+1" * 100_000, "." * 200_000]:
        personal.base_spans(t)  # takes no quadratic time


def every(ends, at=0):
    """All segmentations, as lists of (segment, type)."""
    yield []
    for k, (a, b) in enumerate(ends):
        if a >= at:
            for y in range(len(personal.TYPES)):
                for rest in every([e if e[0] >= b else (-1, -1) for e in ends], b) if any(e[0] >= b for e in ends) else [[]]:
                    yield [(k, y), *rest]


def test_field_sums_and_best():
    rng = np.random.default_rng(2)
    f = personal.Field()
    f.t = rng.normal(0, 1, f.t.shape)
    for ends in ([(0, 2), (1, 3), (3, 5)], [(2, 4)], [(0, 1), (0, 3), (2, 3), (1, 4)]):
        s = rng.normal(0, 1.5, (len(ends), len(personal.TYPES)))
        ways = {tuple(w): sum(s[k, y] + f.t[(0 if n == 0 else w[n - 1][1] + 1), y] for n, (k, y) in enumerate(w)) for w in every(ends)}
        total, each, pairs = f.expected(ends, s)
        z = np.logaddexp.reduce(list(ways.values()))
        assert abs(total - z) < 1e-9
        want = np.zeros_like(s)
        for w, v in ways.items():
            for k, y in w:
                want[k, y] += math.exp(v - z)
        assert np.allclose(each, want) and np.isclose(pairs.sum(), want.sum())
        best = max(ways, key=ways.get)
        assert [(a, b, y) for a, b, y in f.best(ends, s)] == [(*ends[k], y) for k, y in best]


def test_field_held_out():
    found = Counter()
    for text, truth in personal.made(500, 77):
        base = personal.base_spans(text)
        got = {(a, b, k) for a, b, k in personal.spans_of(text, personal.field()) if k.startswith("model_")}
        want = {(a, b, f"model_{personal.TYPES[y]}") for a, b, y in truth if not any(x < b and a < z for x, z, _ in base)}
        found += Counter(hit=len(got & want), missed=len(want - got), false=len(got - want))
        assert not any(x < b and a < z for a, b, _ in got for x, z, _ in base)
    assert found["hit"] > 0.95 * (found["hit"] + found["missed"]) and found["false"] < 0.03 * found["hit"]


def test_field_leaves_other_texts_alone():
    f = personal.field()
    harmless = [cases.prose(5, 400), "Version 1.2.3 of 2024-05-06, ISBN 978-3-16-148410-0, 10:45:30 and 1,234,567.89 EUR", "commit 24be64439e3e49cf46b2d7c90f3602a3d0b907ff at line 120-145", "They met at noon. The rest is at home."]
    assert [personal.spans_of(t, f) for t in harmless] == [[]] * 4
    assert [k for _, _, k in personal.spans_of("Call me: 030/1234567, SSN 123-45-6789, born 04.05.1970", f)] == ["model_phone", "model_id", "model_birth"]


def test_pii_scan(spark):
    texts = [*cases.texts(), *PII, "Call (017) 555-7713\n" * 3000, "1 " * 40_000]
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(texts)] + [(3, "a@b.c", "y", 2), (None, "a@b.c", "y", 2)], "doc_id long, text string, pii_spans string, n_email int").repartition(3)
    scanned = personal.pii_scan(df)
    rows = {(r["doc_id"], r["text"]): r for r in scanned.collect()}
    assert len(rows) == len(texts) + 2 and scanned.columns == ["doc_id", "text", "n_email", "pii_spans", "masked_text"]
    got = {r["doc_id"]: r for r in personal.findings(scanned).where("doc_id IS NOT NULL AND doc_id <> 3").collect()}
    for k, t in enumerate(texts):
        if k == 3:
            continue
        base = plain_base(t or "")
        assert [got[k][f"n_{x}"] for x in personal.BASE] == [sum(s[2] == x for s in base) for x in personal.BASE]
        assert got[k]["base_sha256"] == personal.digest(base)
        assert [x for x in got[k]["spans"].split(",") if x and not x.startswith("model_")] == personal.named(base).split(",") * bool(base)
    assert rows[None, "a@b.c"]["masked_text"] == "[email]" and rows[0, None]["masked_text"] == ""
    assert personal.findings(personal.pii_scan(df.limit(0))).count() == 0


# 13 --------------------------------------------------------------------------------


def plain_counts(rows, longest):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = lang if lang is not None else "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(cases.LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    return f, n


def plain_collocations(rows, longest, least, top):
    f, n = plain_counts(rows, longest)
    f = {p: c for p, c in f.items() if c >= least}
    out = {}
    for (lang, w), a in f.items():
        if len(w) < 2 or any(m == lang and len(v) > len(w) and f[m, v] >= a and any(v[i : i + len(w)] == w for i in range(len(v) - len(w) + 1)) for m, v in f):
            continue
        score, _, l, r = min((math.floor(Fraction(1000 * a * n[lang], f[lang, w[:k]] * f[lang, w[k:]])), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))  # noqa: E741
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), l, r))
    return sorted((lang, k + 1, p.decode(), -a, l, r, n[lang], -s) for lang, found in out.items() for k, (s, a, p, l, r) in enumerate(sorted(found)[:top]))  # noqa: E741


def phrase_rows():
    rng = random.Random(9)
    words = ["the", "of", "New", "york", "city", "Été", "a", "b", "\x00", "x-1", "don't", "😀", *(f"w{k}" for k in range(60))]
    rows = []
    for k in range(300):
        line = " ".join(rng.choice(words[:12] if rng.random() < 0.6 else words) + rng.choice(["", "", "", ",", ".", "\t", "\n", "  "]) for _ in range(rng.randrange(0, 60)))
        rows.append((line + (" in new york city hall today" if k % 4 == 0 else ""), rng.choice(["en", "en", "de", None, "und", ""])))
    return rows + [(None, "en"), ("", None), ("new york " * 3000, "en"), ("a a a a a a a a a a.", "de"), rows[3], rows[3]]


def test_collocations(spark):
    rows = phrase_rows()
    df = spark.createDataFrame(rows, "text string, lang string").selectExpr("*", "1 AS score", "2 AS f", "'x' AS phrase").repartition(6)
    for longest, least, top in ((5, 6, 2000), (3, 4, 25), (2, 1, 40)):
        got = phrases.collocations(df, longest, least, top)
        assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        assert sorted(tuple(r) for r in got.collect()) == plain_collocations(rows, longest, least, top)
    assert phrases.collocations(df.limit(0)).count() == 0


def test_phrase_counts_with_a_full_bitmap(spark, monkeypatch):
    """Keys that share bits cost, but change nothing."""
    monkeypatch.setattr(phrases.Known, "add", lambda self, counted, key="key": self.bits.fill(np.uint64(2**64 - 1)))
    rows = phrase_rows()
    df = spark.createDataFrame(rows, "text string, lang string")
    f, n = plain_counts(rows, 4)
    want = {(lang, " ".join(w)): c for (lang, w), c in f.items() if c >= 7}
    got = {(r["lang"], r["phrase"]): r["f"] for r in phrases.phrase_counts(df, 4, 7).collect()}
    assert {k: v for k, v in got.items() if k[1] is not None} == want
    assert {k[0]: v for k, v in got.items() if k[1] is None} == {lang: n[lang] for lang in {x if x is not None else "und" for _, x in rows}}


def test_suffix_array():
    rng = np.random.default_rng(5)
    ids = rng.integers(1, 5, 300)
    ends = np.unique(np.append(rng.integers(0, 300, 40), 299))
    left = ends[np.searchsorted(ends, np.arange(300))] - np.arange(300) + 1
    order, common = phrases.suffix_array(ids, left, 5)
    suffix = [tuple(ids[i : i + min(left[i], 5)].tolist()) for i in order]
    assert suffix == sorted(suffix) and sorted(order.tolist()) == list(range(300))
    shared = lambda a, b: sum(1 for _ in itertools.takewhile(lambda p: p[0] == p[1], zip(a, b, strict=False)))
    assert common[1:].tolist() == [shared(a, b) for a, b in itertools.pairwise(suffix)]
    for n in range(1, 6):
        value = rng.integers(0, 1000, 300)
        at, count, least = phrases.intervals(order, common, left, n, value)
        want = Counter(tuple(ids[i : i + n].tolist()) for i in range(300) if left[i] >= n)
        grams = [tuple(ids[i : i + n].tolist()) for i in at]
        assert dict(zip(grams, count.tolist(), strict=True)) == want
        assert all(least[k] == min(value[i] for i in range(300) if left[i] >= n and tuple(ids[i : i + n].tolist()) == g) for k, g in enumerate(grams))


# 1, its scanner -------------------------------------------------------------------


def test_html_scanner():
    text = lambda page: [b.text for b in html.blocks_of(page)]
    assert text("<p>a<!-->b</p><p>c<!--->d<!-- x -- > y -->e<!-- z --!>f</p>") == ["ab", "cdef"]
    assert text("<p data-x=it's>one</p><p>two's</p>") == ["one", "two's"]
    assert text('<p class="x>Second</p>') == ["Second"] and text('<p class="a>b" title=\'<i>\'>c</p>') == ["c"]
    assert text("<p a = 'x>y' b==c d=\"\">z</p>") == ["z"] and text('<p"x>q</p></3>r</>s<?php x ?>t<!doctype html>u') == ["q", "rstu"]
    assert text("a < b and 1<2") == ["a < b and 1<2"] and text("x <b") == ["x <b"]
    for page in ("<p x='" * 350_000, "<a " * 700_000, "<!" * 1_000_000, "<!--" * 500_000, "<p x='\">" * 200_000, "</" * 1_000_000, "<p x=\"<" * 300_000 + ">", "<" * 2_000_000):
        began = time.monotonic()
        html.blocks_of(page)
        assert time.monotonic() - began < 20  # 2 MB, linear


# 10, on what its generator does not make -------------------------------------------


def test_secrets_outside_the_generator():
    """Identifiers of words not trained on, and keys of plain alphabets."""
    net, rng = secrets.network(), random.Random(5)
    words = "create delete fetch invoice shipment widget panel timeout retry policy engine matrix vector tensor kernel thread socket protocol header footer sidebar button".split()
    assert not set(words) & set(secrets.TERMS)

    def camel():
        some = [rng.choice(words) for _ in range(rng.randint(3, 7))]
        some[rng.randrange(len(some))] += str(rng.randint(1, 99))
        return some[0] + "".join(w.title() for w in some[1:])

    harmless = {
        "camel": camel, "uuid": lambda: str(uuid.UUID(int=rng.getrandbits(128))), "snake": lambda: "_".join(rng.choice(words) for _ in range(4)) + str(rng.randint(1, 99)),
        "constant": lambda: "_".join(rng.choice(words).upper() for _ in range(4)) + f"_{rng.randint(1, 99)}", "path": lambda: "/".join(rng.choice(words) for _ in range(4)) + f"/v{rng.randint(1, 9)}/a.html", "package": lambda: "org." + ".".join(rng.choice(words) for _ in range(3)) + f".{camel()}",
    }
    letters = string.ascii_letters + string.digits
    keys = {"letters": lambda: "".join(rng.choice(letters) for _ in range(32)), "base64": lambda: "".join(rng.choice(letters + "+/") for _ in range(40)) + "=", "hex": lambda: "".join(rng.choice("0123456789ABCDEF") for _ in range(32)), "prefixed": lambda: "ghp_" + "".join(rng.choice(letters) for _ in range(36))}
    share = lambda made, frame: np.mean([any(k == "model" for _, _, k in found) for found in secrets.spans_of([frame.format(made()) for _ in range(250)], net)])
    assert all(share(f, "We call {} when the page loads.") <= 0.02 for f in harmless.values())
    assert all(share(f, "Authorization: Bearer {} and more words.") >= 0.95 for f in keys.values())


# 5, in blocks ----------------------------------------------------------------------


def test_benchmark_in_blocks(spark, monkeypatch):
    """Several blocks, each a job of its own, and slices of pairs give what one block gives."""
    rng = random.Random(3)
    items = [" ".join(f"w{rng.randrange(500)}" for _ in range(rng.choice((4, 12, 25, 60)))) for _ in range(25)]
    texts = [" ".join([cases.prose(k, 30), items[k % 25], cases.prose(k + 50, 20), items[(k * 7) % 25] if k % 3 == 0 else ""]) for k in range(40)] + [None, "", cases.prose(1, 50)]
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, matches string").repartition(3)
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id int, text string")
    found = lambda: sorted((r["doc_id"], [(m["item_id"], m["edits"], m["first_word"]) for m in r["matches"]]) for r in decontaminate.find_items(docs, benchmark).collect())
    whole = found()
    assert sum(len(m) for _, m in whole) >= 45 and len(whole) == 43
    monkeypatch.setattr(decontaminate, "BLOCK", 7)
    assert found() == whole
    monkeypatch.setattr(decontaminate, "MOST_WALKS", 0)  # no LSH at all
    assert found() == whole
