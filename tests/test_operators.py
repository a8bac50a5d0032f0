from __future__ import annotations

import datetime as dt
import difflib
import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from pyspark.sql import functions as F

from claimloom.functions.text import STOPWORDS
from claimloom.operators import graphs, ordering, similarity, vectors
from claimloom.operators.chunking import chunk_documents, chunks_of, packing, section_table
from claimloom.operators.providers import merge_outputs, replay_or_run
from claimloom.operators.references import orphan_references, pack_bits, unpack_bits
from claimloom.operators.skew import hot_keys, hot_of_counts, hot_values, lookup_join, spread_join
from claimloom.operators.tensors import encoded_texts, fitted_tokens


def T(day, hour=0):
    return dt.datetime(2024, 1, day, hour)


def test_orphans(spark, rows):
    r = [("r", "1", "k", "a", T(5)), ("r", "1", "k", "gone", T(6)), ("r", "2", "k", "nowhere", T(5)), ("r", "3", "k", "late", T(2)), ("r", "4", "k", "dead", T(9)), ("r", "5", "k", "dead", T(3)), ("r", "6", "k", None, T(1)), ("r", "7", "k", "nowhere", None), ("r", "8", "k", "late", None), ("r", "9", "k", "a ", T(5)), ("r", "2", "k", "nowhere", T(5)), ("s", "1", "m", "a", T(5))]
    p = [("k", "a", T(1)), ("k", "a", T(8)), ("k", "late", T(2, 5)), ("k", "dead", T(1)), ("k", "never", None)]
    w = [("k", "dead", T(9)), ("k", "dead", T(20)), ("k", "nowhere", T(1))]
    refs = spark.createDataFrame([(*x, 1) for x in r], "ref_table string, row_id string, kind string, key string, at timestamp, code int")
    got = rows(orphan_references(refs, spark.createDataFrame(p, "kind string, key string, at timestamp"), spark.createDataFrame(w, "kind string, key string, at timestamp")), "ref_table", "row_id", "key", "fault")
    assert got == sorted([("r", "2", "nowhere", "missing"), ("r", "3", "late", "late"), ("r", "4", "dead", "deleted"), ("r", "7", "nowhere", "missing"), ("r", "9", "a ", "missing"), ("s", "1", "a", "missing")], key=str)


def test_orphans_empty(spark):
    e = spark.createDataFrame([], "kind string, key string, at timestamp")
    refs = spark.createDataFrame([], "ref_table string, row_id string, kind string, key string, at timestamp")
    assert orphan_references(refs, e, e).count() == 0


def test_bitmaps():
    for n in (0, 3, 5000):
        bits = set(random.Random(n).sample(range(1 << 15), n))
        raw = bytearray(4096)
        for b in bits:
            raw[b >> 3] |= 1 << (b & 7)
        assert set(unpack_bits(pack_bits(bytes(raw))).nonzero()[0].tolist()) == bits


def test_lookup_join_with_hot_keys(spark, rows):
    left = spark.createDataFrame([("h", i) for i in range(300)] + [(k, 1) for k in "abc"] + [(None, 2)], "k string, v int")
    right = spark.createDataFrame([("h", 1), ("a", 2), ("z", 3)], "k string, w int")
    assert rows(hot_keys(left, ["k"], share=0.1, least=10), "k") == [("h",)]
    hot = hot_values(left, "k", share=0.1, least=10)
    assert hot == ["h"] == hot_of_counts(left.groupBy("k").count(), "k", "count", 0.1, 10) and hot_values(left, "k", least=1000) == []
    for how in ("left", "inner", "left_semi", "left_anti"):
        assert rows(lookup_join(left, right, "k", hot, how)) == rows(left.join(right, "k", how))


def test_spread_join(spark, rows):
    left = spark.createDataFrame([("h", i, None) for i in range(300)] + [(k, 1, "z") for k in "abc"] + [(None, 2, "")], "k string, v int, x string")
    right = spark.createDataFrame([("h", i) for i in range(7)] + [("a", 2), ("a", 3), (None, 3)], "k string, w int")
    hot = hot_keys(left, ["k"], share=0.1, least=10)
    assert rows(spread_join(left, right, ["k"], hot)) == rows(left.join(right, "k"))
    assert rows(spread_join(left, right, ["k"], hot.filter("false"))) == rows(left.join(right, "k"))


def test_positions(spark, rows):
    data = [(i * 7 % 101, i) for i in range(101)]
    df = spark.createDataFrame(data, "k int, v int").repartition(5)
    got = ordering.with_position(df, ["k"], "p", F.col("v"), "b").orderBy("p").collect()
    assert [r["p"] for r in got] == list(range(101)) and [r["k"] for r in got] == list(range(101))
    assert [r["b"] for r in got] == [0, *itertools.accumulate(r["v"] for r in got)][:-1]
    assert ordering.with_position(df.filter("k < 0"), ["k"]).count() == 0


def test_hash_split(spark):
    ids = spark.range(103).select(F.concat(F.lit("c"), "id").alias("k"))
    got = {r["k"]: r["split"] for r in ordering.hash_split(ids, "k", {"a": 0.5, "b": 0.25, "c": 0.25}, 3).collect()}
    order = sorted(sorted(got), key=lambda k: hashlib.sha256(f"3:{k}".encode()).hexdigest())
    counts = {"a": 51, "b": 25, "c": 25}
    for s in sorted(counts, key=lambda s: ({"a": 0.5, "b": 0.75, "c": 0.75}[s], s), reverse=True)[:2]:
        counts[s] += 1
    want = dict(zip(order, ["a"] * counts["a"] + ["b"] * counts["b"] + ["c"] * counts["c"]))
    assert got == want


def test_permutation_moves_all(spark):
    df = spark.createDataFrame([(i, f"p{i}") for i in range(20)], "i int, p string")
    got = ordering.permuted(df, ["i"], "p", 5, "p").orderBy("i").collect()
    assert sorted(r["p"] for r in got) == sorted(f"p{i}" for i in range(20)) and any(r["p"] != f"p{r['i']}" for r in got)
    again = ordering.permuted(df.repartition(3), ["i"], "p", 5, "p").orderBy("i").collect()
    assert got == again
    assert ordering.permuted(df.limit(1), ["i"], "p", 5, "p").first()["p"] == "p0"


def _print(text):
    return " ".join(w for w in re.findall("[a-z0-9]+", text.lower()) if w not in STOPWORDS)


def _sim(a, b):
    x, y = set(a.split()), set(b.split())
    return 0.7 * len(x & y) / len(x | y) + 0.3 * difflib.SequenceMatcher(None, a, b).ratio()


def test_families_equal_the_sequence(spark):
    rng = random.Random(4)
    base = [" ".join(rng.choices("alpha beta gamma delta rate decay yield loss enzyme probe cell wall heat flux".split(), k=9)) for _ in range(12)]
    texts = []
    for b in base:
        w = b.split()
        for _ in range(6):
            v = list(w)
            for _ in range(rng.randint(0, 3)):
                v[rng.randrange(len(v))] = rng.choice("alpha omega kappa flux test".split())
            texts.append(" ".join(v))
    texts += ["", "the of and", None]
    claims = spark.createDataFrame([(f"c{i}", x) for i, x in enumerate(texts)] + [("c0", texts[0])], "claim_id string, text string")
    got = {r["claim_id"]: r["leader"] for r in similarity.claim_families(claims).collect()}
    leaders, want = [], {}
    for fp in sorted({_print(x) for x in texts if x and _print(x)}):
        best = max(((_sim(fp, l), -i) for i, l in enumerate(leaders)), default=(0, 0))
        if best[0] >= 0.72:
            want[fp] = leaders[-best[1]]
        else:
            leaders.append(fp)
            want[fp] = fp
    assert got == {f"c{i}": want[_print(x)] for i, x in enumerate(texts) if x and _print(x)}


def test_jaccard_pairs_lose_nothing(spark, rows):
    rng = random.Random(1)
    sets = {f"i{i}": " ".join(sorted(rng.sample([f"w{k}" for k in range(14)], rng.randint(1, 7)))) for i in range(60)}
    df = spark.createDataFrame(list(sets.items()) + [("none", "the")], "id string, text string")
    for th in (0.2, 0.5, 0.8, 1.0):
        got = rows(similarity.jaccard_pairs(similarity.token_sets(df, "id", "text"), "id", th), "a", "b")
        want = sorted(((a, b) for a, b in itertools.combinations(sorted(sets), 2) for x, y in [(set(sets[a].split()), set(sets[b].split()))] if len(x & y) / len(x | y) >= th), key=str)
        assert got == want


def test_first_pairs_goes_on(spark, rows):
    left = spark.range(30).toDF("l")
    right = spark.range(30).toDF("r")
    pairs = lambda block: right.join(F.broadcast(block), (F.col("l") > 25) & (F.col("r") > F.col("l")))
    assert rows(similarity.first_pairs(left, pairs, "l", "r", most=3), "l", "r") == [(26, 27), (26, 28), (26, 29)]
    assert rows(similarity.first_pairs(left, pairs, "l", "r", most=100), "l", "r") == [(a, b) for a in range(26, 30) for b in range(a + 1, 30)]
    assert similarity.first_pairs(left.filter("false"), pairs, "l", "r", most=3).count() == 0


@pytest.mark.parametrize("most", [3, 200])
def test_pools_without_a_key(spark, rows, most):
    rng = random.Random(most)
    data = [(f"i{i:02d}", rng.choice([None, 1, 2, 3]), rng.choice([None, [], ["a"], ["a", "b"], ["c", None], ["b"]])) for i in range(20)]
    df = spark.createDataFrame(data, "k string, at int, s array<string>")
    want = sorted((a, b) for a, x, _ in data for b, y, _ in data if x and y and y > x)[:most]
    assert rows(similarity.later_pairs(df, "k", "at", "o", most)) == want
    want = sorted((a, b) for a, _, x in data for b, _, y in data if a != b and not ({*(x or ())} & {*(y or ())} - {None}))[:most]
    assert rows(similarity.disjoint_pairs(df, "k", "s", "o", most)) == want


def test_graphs(spark, rows):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("b", "a"), ("x", "x"), ("c", "d")], "src string, dst string")
    assert rows(graphs.triangles(e)) == [("a", "b", "c")]
    assert rows(graphs.two_cycles(e)) == [("a", "b")]
    assert ("a", 1, 2) in rows(graphs.degrees(e))
    h = spark.createDataFrame([("r", ["p", "q", "p", None]), ("s", ["p"]), ("t", None)], "k string, m array<string>")
    assert rows(graphs.expand_hyperedges(h, "k", "m")) == [("r", "p", "q"), ("r", "q", "p")]


DOC = "# Top\n\nfirst para line one\nline two.\n\n## Sub\n" + "A sentence here. " * 20 + "\n### Deep\nlast\n# Next\n" + "z" * 150


def test_chunks(spark):
    got = list(chunks_of("d", DOC, 120))
    assert got[0][3:] == ("first para line one\nline two.", 7, 37, ["Top"])
    assert all(len(g[3]) <= 120 for g in got) and [g[2] for g in got] == list(range(len(got)))
    assert got[1][6] == ["Top", "Sub"] and [g[3] for g in got if g[6] == ["Top", "Sub", "Deep"]] == ["last"]
    assert [g[3] for g in got if g[6] == ["Next"]] == ["z" * 120, "z" * 30]
    over = list(chunks_of("d", DOC, 120, overlap=10))
    assert over[2][3].endswith(got[2][3][-40:]) and len(over[2][3]) > len(got[2][3]) - 1
    df = spark.createDataFrame([("d", DOC), ("d", DOC), ("e", None), (None, "x"), ("f", " \n ")], "document_id string, text string")
    assert chunk_documents(df, 120).count() == len(got)
    assert chunk_documents(df.filter("false")).count() == 0


def test_section_table():
    assert section_table([1, 3, 3, 2, 1, 2], list("ABCDEF")) == [[], ["A"], ["A", "B"], ["A", "B", "C"], ["A", "D"], ["E"], ["E", "F"]]


@pytest.mark.parametrize("most", [10, 37])
def test_packing(most):
    rng = random.Random(most)
    for _ in range(200):
        sizes = np.array([rng.randint(1, 2 * most) for _ in range(rng.randint(0, 9))], np.int64)
        got = packing(sizes, most)
        assert [k for a, b in got for k in range(a, b)] == list(range(len(sizes)))
        fits = lambda a, b: sizes[a:b].sum() + b - a - 1 <= most
        assert all(b == a + 1 or fits(a, b) for a, b in got) and all(not fits(a, c) for (a, b), c in zip(got, [y[0] + 1 for y in got[1:]]))


def test_vectors(spark):
    rng = random.Random(0)
    data = [(i, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(50)] + [(90, None), (91, [0.0] * 4)]
    df = spark.createDataFrame(data, "id long, v array<float>")
    got = {(r["query"], r["rank"]): r["neighbour"] for r in vectors.nearest(df, df.filter("id < 3"), "id", "v", 3).collect()}

    def cos(a, b):
        n = lambda x: sum(y * y for y in x) ** 0.5
        return sum(x * y for x, y in zip(a, b)) / (n(a) * n(b))

    for q in range(3):
        best = sorted((-cos(data[q][1], v), i) for i, v in data[:50] if i != q)[:3]
        assert [got[q, k + 1] for k in range(3)] == [i for _, i in best]
    again = {(r["query"], r["rank"]): r["neighbour"] for r in vectors.nearest(df, df.filter("id < 3"), "id", "v", 3, at_once=1).collect()}
    assert again == got
    assert vectors.nearest(df, df.filter("false"), "id", "v", 3).count() == 0


def test_providers(spark, rows):
    p = spark.createDataFrame([("1", "x", 0.5, 1), ("2", "x", 0.5, 1), ("3", "x", None, 1), ("4", "x", 0.5, 2), ("5", "x", 0.5, 1)], "k string, output string, confidence double, n_keys int")
    s = spark.createDataFrame([("2", "x", 0.1, 1), ("3", "y", 0.1, 1), ("4", "y", 0.5, 1), ("5", "y", 0.5, 2)], "k string, output string, confidence double, n_keys int")
    assert rows(merge_outputs(p, s, "k"), "k", "decision") == [("1", "single_provider"), ("2", "provider_outputs_equivalent"), ("3", "selected_escalation"), ("4", "selected_primary"), ("5", "selected_escalation")]
    req = spark.createDataFrame([("a", "in a"), ("b", "in b"), ("b", "in b")], "request_hash string, input string")
    cache = spark.createDataFrame([("a", "old")], "request_hash string, output string")
    answers, fresh = replay_or_run(req, cache, lambda s: s.str.upper())
    assert rows(answers) == [("a", "old", True), ("b", "IN B", False)] and rows(fresh) == [("b", "IN B")]
    calls = spark.sparkContext.accumulator(0)

    def counted(texts):
        calls.add(len(texts))
        return texts.str.upper()

    answers, fresh = replay_or_run(req, cache.filter("false"), counted)
    assert answers.count() == fresh.count() == 2 and rows(fresh) == [("a", "IN A"), ("b", "IN B")] and calls.value == 2
    answers, fresh = replay_or_run(req, cache, lambda s: s.str.upper(), "cache_only")
    assert rows(answers, "request_hash", "output") == [("a", "old"), ("b", None)] and fresh.count() == 0


def test_tokenizer(spark, rows):
    df = spark.createDataFrame([(1, "B a"), (2, "a c B"), (3, ""), (4, None)], "i int, t string")
    v = fitted_tokens(df, "i", "t")
    assert rows(v) == [("a", 3), ("b", 2), ("c", 4)]
    got = {r["i"]: (r["ids"], r["attention"]) for r in encoded_texts(df, "i", "t", v, 3).collect()}
    assert got[1] == ([2, 3, 0], [1, 1, 0]) and got[2] == ([3, 4, 2], [1, 1, 1]) and got[3] == ([0, 0, 0], [0, 0, 0])
