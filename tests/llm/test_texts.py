"""Pieces, passages, mixtures and personal information on small cases."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimloom.functions.words import words
from claimloom.llm import mixing, pieces, pii, postings

# pieces


def test_range_maximum():
    rng = np.random.default_rng(0)
    v = rng.integers(0, 4, 300)
    t = pieces.RangeMaximum(v, 90)
    for _ in range(2000):
        lo = int(rng.integers(0, 300))
        hi = int(min(299, lo + rng.integers(0, 90)))
        best = max(range(lo, hi + 1), key=lambda i: (v[i], i))
        assert t.query(lo, hi) == best


TEXTS = ["", "x" * 1200, "x" * 1201, "x" * 5000, "word " * 900, "é́" * 1500, "A sentence here. " * 300, "p one\n\n" * 400, "a\r\n" * 900, "# H\ntext goes on, " * 200, "漢字、" * 900]


@pytest.mark.parametrize("k", range(len(TEXTS)))
@pytest.mark.parametrize("limit,overlap", [(1200, 120), (50, 49), (40, 0)])
def test_pieces_cover_the_text(k, limit, overlap):
    text = TEXTS[k]
    got = pieces.cut(text, limit, overlap)
    assert got[0][0] == 0 and got[-1][1] == len(text)
    for (a, b), (c, d) in zip(got, got[1:]):
        assert b - a <= limit and c == b - overlap and d > b
    assert got[-1][1] - got[-1][0] <= limit
    assert "".join(text[a if i == 0 else a + overlap : b] for i, (a, b) in enumerate(got)) == text


def test_cuts_are_the_strongest():
    text = "First part, with a comma. Second sentence is here.\n\nNew paragraph starts now. And it goes on for a while longer than that."
    (a, b), *_ = pieces.cut(text, 80, 5)
    assert text[a:b].endswith("\n\n")
    with pytest.raises(ValueError):
        pieces.cut("x", 5, 5)


def test_an_unbroken_string_stays_whole():
    text = "Some words here. " * 29 + "x" * 1000 + " And the end. " * 20
    got = pieces.cut(text)
    at = 17 * 29
    assert got[0] == (0, at) and got[1][0] == at - 120 and got[1][1] >= at + 1000
    assert pieces.cut("y" * 3000)[0] == (0, 1200)  # no boundary anywhere


def test_split_oversized(spark):
    long = "# One\n" + "Some words here. " * 60 + "\n## Two\n" + "Other words there. " * 60
    data = [("a", long, 10, ["Doc"], 1), ("a", long, 10, ["Doc"], 2), ("b", "short", 0, None, 1), ("c", None, 0, None, 1), (None, long, 0, None, 1), ("d", long, None, None, 1)]
    df = spark.createDataFrame(data, "chunk_id string, text string, start_char int, section_path array<string>, piece_index int")
    got = pieces.split_oversized(df).orderBy("chunk_id", "piece_index").collect()
    a = [r for r in got if r["chunk_id"] == "a"]
    assert {r["chunk_id"] for r in got} == {"a", "d"} and [r["piece_index"] for r in a] == list(range(len(a)))
    assert all(r["text"] == long[r["start_char"] - 10 : r["end_char"] - 10] and len(r["text"]) <= 1200 for r in a)
    assert all(y["text"].startswith(x["text"][-120:]) for x, y in zip(a, a[1:]))
    assert a[0]["section_path"] == ["One"] and a[-1]["section_path"] == ["One", "Two"]
    assert all(r["start_char"] is None for r in got if r["chunk_id"] == "d")
    assert pieces.split_oversized(df, keep_fitting=True).filter("chunk_id = 'b'").count() == 1
    assert pieces.split_oversized(df.filter("false")).count() == 0


# passages


def brute_exact(docs, items, n):
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(len(w) - n + 1):
            windows.setdefault(tuple(w[k : k + n]), set()).add(i)
    return {(d, i) for d, t in docs for w in [words(t)] for k in range(len(w) - n + 1) for i in windows.get(tuple(w[k : k + n]), ())}


def brute_near(docs, items, n, slop):
    out = set()
    for d, t in docs:
        w = words(t)
        spans = [set(w[k : k + n + slop]) for k in range(len(w))]
        for i, q in items:
            v = words(q)
            if any(set(v[k : k + n]) <= s for k in range(len(v) - n + 1) for s in spans):
                out.add((d, i))
    return out


@pytest.mark.parametrize("segment", [40, 100_000])
def test_passages(spark, segment):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(12)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.randint(2, 12)))) for i in range(15)] + [(90, None), (91, ""), (None, "w1 w2 w3 w4")]
    docs = [(d, " ".join(rng.choices(vocab, k=rng.randint(0, 30)))) for d in range(60)]
    docs += [(100 + k, f"x, {t.upper()}! y") for k, (_, t) in enumerate(items[:10])] + [(200, None), (None, "w1"), (3, docs[3][1])]
    index = postings.build_index(spark.createDataFrame([(*d, "t") for d in docs], "doc_id long, text string, terms string"), segment)
    q = spark.createDataFrame([(*i, 1) for i in items], "item_id long, item_text string, doc_id int")
    own = [(d, t) for d, t in docs if d is not None and t is not None]
    real = [(i, t) for i, t in items if i is not None and t]
    assert {tuple(r) for r in postings.find_passages(index, q, 4).collect()} == brute_exact(own, real, 4)
    assert {tuple(r) for r in postings.find_passages(index, q, 4, query_chars=60).collect()} == brute_exact(own, real, 4)  # in many blocks
    assert {tuple(r) for r in postings.find_passages(index, q, 4, slop=2).collect()} == brute_near(own, real, 4, 2)


def test_no_passages(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c")], "item_id long, item_text string")
    assert postings.find_passages(postings.build_index(docs), items, 2).count() == 0
    one = postings.build_index(spark.createDataFrame([(1, "..."), (2, "a b c")], "doc_id long, text string"))
    assert postings.find_passages(one, items.filter("false"), 2).count() == 0
    assert [tuple(r) for r in postings.find_passages(one, items, 3).collect()] == [(2, 1)]


# mixtures


def brute_temperature(tokens, limits, target, budget):
    total = sum(tokens.values())
    shares = {s: n / total for s, n in tokens.items()}

    def weights(e):
        raised = {s: x**e for s, x in shares.items()}
        return {s: x / sum(raised.values()) for s, x in raised.items()}

    def good(e):
        w = weights(e)
        return -sum(x * math.log(x) for x in w.values()) >= target, all(w[s] * budget <= limits[s] * tokens[s] * (1 + 1e-9) for s in w)

    grid = [i / 20000 for i in range(20001)]
    even = max((e for e in grid if good(e)[0]), default=0.0)
    return even if good(even)[1] else min((e for e in grid if good(e)[1]), default=1.0)


@pytest.mark.parametrize("target,limits,budget", [(1.0, (1, 9, 9), 1000), (1.0, (9, 9, 9), 1000), (1.09, (1, 2, 2), 1000), (0.1, (1, 1, 1), 1000), (2.0, (9, 9, 9), 1000), (2.0, (9, 9, 9), 1500), (1.0, (1, 1, 1), 5000)])
def test_temperature(spark, target, limits, budget):
    tokens = {"a": 700, "b": 200, "c": 100}
    df = spark.createDataFrame([(s, n, m) for (s, n), m in zip(tokens.items(), limits)] + [("none", 0, 3), ("never", 50, 0)], "source string, available_tokens long, max_repeats int")
    assert mixing.temperature(df, target, budget) == pytest.approx(brute_temperature(tokens, dict(zip(tokens, limits)), target, budget), abs=1e-4)
    assert mixing.temperature(df.filter("false"), target, budget) == 1.0


def test_tempered_mixture(spark):
    df = spark.createDataFrame([(i, "a" if i % 10 else "b", "word " * 10) for i in range(1000)], "doc_id long, source string, text string")
    targets = spark.createDataFrame([("a", None, 3), ("b", 0.5, 4)], "source string, target_share double, max_repeats int")
    mix, shares = mixing.mixture(df, targets, entropy=0.6)
    s = {r["source"]: r for r in shares.collect()}
    w = [s[x]["weight"] for x in "ab"]
    assert sum(w) == pytest.approx(1) and -sum(x * math.log(x) for x in w) == pytest.approx(0.6, abs=1e-3) and 0 < s["a"]["exponent"] < 1
    assert all(abs(s[x]["share_of_mixture"] - s[x]["weight"]) < 0.005 and s[x]["reached"] for x in "ab") and s["b"]["most_repeats"] <= 4


def test_mixture(spark):
    rng = random.Random(1)
    docs = [(i, "big" if i % 2 else rng.choice(["Small_x", "small-x ", " SMALL x"]), "word " * rng.randint(1, 30)) for i in range(400)]
    docs += [(1000, None, "a b c"), (1001, "elsewhere", "words here"), (1002, "big", None), (None, "big", "x"), (1, docs[1][1], docs[1][2])]
    df = spark.createDataFrame([(*d, 3) for d in docs], "doc_id long, source string, text string, block int")
    targets = spark.createDataFrame([("big", 0.2, 1), ("small-x", 0.75, 2), ("none", 0.05, 4)], "source string, target_share double, max_repeats int")
    mix, shares = mixing.mixture(df, targets)
    s = {r["source"]: r for r in shares.collect()}
    assert abs(s["big"]["share_of_budget"] - 0.2) < 0.01 and abs(s["small-x"]["share_of_budget"] - 0.75) < 0.01 and s["none"]["mixed_tokens"] == 0
    assert s["big"]["reached"] and s["small-x"]["reached"] and not s["none"]["reached"] and s["big"]["exponent"] is None
    times = {r["doc_id"]: r["n"] for r in mix.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    by = dict((d, src) for d, src, _ in docs if d is not None)
    assert all(n <= (1 if by[d] == "big" else 2) for d, n in times.items()) and not {1000, 1001, 1002} & set(times)
    again = mixing.mixture(df.repartition(7), targets)[0]
    assert sorted(map(tuple, mix.collect())) == sorted(map(tuple, again.collect()))


def test_empty_mixture(spark):
    df = spark.createDataFrame([], "doc_id long, source string, text string")
    targets = spark.createDataFrame([("a", 1.0, 2)], "source string, target_share double, max_repeats int")
    mix, shares = mixing.mixture(df, targets)
    assert mix.count() == 0 and shares.first()["share_of_budget"] == 0.0
    assert mixing.mixture(df, targets.filter("false"))[1].count() == 0


# personal information

GIVEN = ["Ada", "Bea", "Cid", "Dov", "Eli", "Fay", "Li", "Bo"]
FAMILY = ["Korvin", "Lumeth", "Mandor", "Norvath", "Orsel", "Pavlen", "Ng", "Šimek"]
HIDDEN = ["Quirin", "Rolvane"]
PHONES = ["+999 12 345 6789", "0999 / 123 45 67", "(555) 014 7294", "1-555-012-9173"]
IDS = ["930-32-3155", "QQ 56 26 40 B", "XQ1440303", "53643504-F"]


def corpus(n=240):
    rng = random.Random(7)
    docs, spans = [], {}
    for i in range(n):
        parts, at = [], set()

        def say(*pieces_):
            pos = sum(map(len, parts))
            for p in pieces_:
                if isinstance(p, tuple):
                    at.add((p[0], pos, pos + len(p[1])))
                    p = p[1]
                parts.append(p)
                pos += len(p)

        g, f = rng.choice(GIVEN + HIDDEN[:1]), rng.choice(FAMILY + HIDDEN[1:])
        name = ("name", rng.choice([f"{g} {f}", f"{f}, {g}", f"{g} T. {f}", f"{g} {f}".upper(), f"{f}, {g[0]}.", f"{f} {g[0]}. T.", f"{g[0]}. T. {f}"]))
        say("The rate was measured in open trials. ")
        say(rng.choice(["We thank ", "Signed by "]), name, " for help. ")
        say(rng.choice(["Tel: ", "phone "]), ("phone", rng.choice(PHONES)), " is given. ")
        say(rng.choice(["Call ", "Ring up "]), ("phone", rng.choice(PHONES)), " at night. ")
        say(rng.choice(["passport no. ", "tax ID "]), ("identity", rng.choice(IDS)), " was noted. ")
        say(rng.choice(["Document shown: ", "Card "]), ("identity", rng.choice(IDS)), " by hand. ")
        say("Specimen 945-98-9912 was dry. Grant 999-605-1204 paid. The Korvin index holds. ")
        say("Write to ", ("email", rng.choice([f"{g.lower()}@lab.example", f"{g.lower()} (at) lab (dot) test", f"{g.upper()}＠LAB.EXAMPLE"])), " or not. Accuracy is p@8 = 0.18 with corpus@6.11.0. ")
        place = rng.choice(["Ostmar", "Port Lunvow", "Velb"])
        say("It went to ", ("address", rng.choice([f"{rng.randint(1, 99)} Quell Lane, {place} {rng.randint(10000, 99999)}", f"Calle Dorn {rng.randint(1, 99)}, {rng.randint(10000, 99999)} {place}", f"P.O. Box 7, {place} {rng.randint(10000, 99999)}", f"Flat 2, 18 Dorn Lane, {place}", f"12B Dorn Rd.\n{place} {rng.randint(10000, 99999)}"])), ". Site Ostmar 87354 counts.")
        docs.append((i, "".join(parts)))
        spans[i] = at
    return docs, spans


def test_personal_information(spark):
    docs, spans = corpus()
    df = spark.createDataFrame([(*d, "x", 0) for d in docs] + [(900, None, "x", 0), (None, "Ada Korvin", "x", 0), (901, "", "x", 0)], "doc_id long, text string, pii_kind string, start int")
    known = spark.createDataFrame([(g, "given") for g in GIVEN] + [(f, "family") for f in FAMILY] + [(None, "given"), ("X", None)], "name_part string, name_kind string")
    found = pii.find_personal(df, known)
    got = {(r["doc_id"], r["pii_kind"], r["start_char"], r["end_char"]) for r in found.collect()}
    want = {(d, *s) for d, ss in spans.items() for s in ss}
    for kind in ("email", "phone", "identity", "address", "name"):
        g, w = {x for x in got if x[1] == kind}, {x for x in want if x[1] == kind}
        assert len(g & w) >= 0.97 * len(w) and len(g - w) <= 0.03 * len(w), (kind, sorted(g ^ w)[:5])
    out = {r["doc_id"]: r for r in pii.redact(df, found).collect()}
    assert set(out) == {*range(len(docs)), 901} and out[901]["n_replaced"] == 0
    assert "[EMAIL]" in out[0]["text"] and "[PHONE]" in out[0]["text"] and "@lab" not in out[0]["text"].lower()


def test_personal_information_of_nothing(spark):
    df = spark.createDataFrame([(1, "no one here"), (2, "x" * 100_000), (3, None)], "doc_id long, text string")
    known = spark.createDataFrame([], "name_part string, name_kind string")
    assert pii.find_personal(df, known).count() == 0
    assert pii.find_personal(df.filter("false"), known).count() == 0


@pytest.mark.parametrize("text,hit", [("a.b@c.example", "a.b@c.example"), ("mailto:x@y.test.", "x@y.test"), ("x [at] y.z.test!", "x [at] y.z.test"), ("p@8 = 0.1", None), ("Follow @handle now", None), ("x AT y DOT org", "x AT y DOT org"), ("u at v dot org", "u at v dot org"), ("meet at noon", None), ("we met at Bern on the dot today", None)])
def test_email_shapes(text, hit):
    found = [m[0] for p in pii.emails_in(text) for m in p.finditer(text)]
    assert found == ([hit] if hit else [])


@pytest.mark.parametrize("n,s", [("+44 1632 960158 ext. 14", "+99 9999 999999x"), ("QQ 56 26 40 B", "AA 99 99 99 A"), ("53643504-F", "99999999-A")])
def test_number_shapes(n, s):
    assert pii.NUMBER.fullmatch(n) and pii.shape(n) == s
