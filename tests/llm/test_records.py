"""Splits, overlap, copies and groups on small cases: nulls, repeats, ties, empty tables, clashing columns."""

from __future__ import annotations

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from claimloom.llm import components, dedup, overlap, splits


# copies


def keyed(spark, rows, schema="record_set string, id string, key binary, first_id int, _salt int"):
    return spark.createDataFrame([(*r, 1, 2) for r in rows], schema)


def test_copies(spark, rows):
    data = [("a", "3", b"x"), ("a", "1", b"x"), ("a", "1", b"x"), ("b", "0", b"x"), ("a", "2", None), ("a", None, b"x"), ("a", "9", b"y")]
    assert rows(dedup.collapse_copies(keyed(spark, data)), "record_set", "id", "first_id") == [("a", "1", "1"), ("a", "3", "1"), ("a", "9", "9"), ("b", "0", "0")]
    assert rows(dedup.copy_counts(dedup.collapse_copies(keyed(spark, data)))) == [("a", "1", 2), ("a", "9", 1), ("b", "0", 1)]
    assert dedup.collapse_copies(keyed(spark, [])).count() == 0


def test_copies_of_a_hot_key(spark, rows):
    data = [("a", f"{i:04d}", b"hot" if i % 3 else bytes([i % 251])) for i in range(900)] + [("a", "0001", b"hot")]
    df = keyed(spark, data)
    assert rows(dedup.collapse_copies(df, share=0.1, least=50)) == rows(dedup.collapse_copies(df)) and dedup.collapse_copies(df, share=0.1, least=50).count() == 900


def test_text_keys(spark):
    same = ["The Rate  is 5.", "the rate is 5", "THE\trate-is ５!", "# The *rate* is 5"]
    other = ["the rate is -5", "the rate is 5.1", "rate the is 5", ""]
    df = spark.createDataFrame([(t,) for t in [*same, *other, None]], "t string").select(dedup.text_key("t").alias("k"))
    keys = [None if r[0] is None else bytes(r[0]) for r in df.collect()]
    assert len(set(keys[:4])) == 1 and len(set(keys)) == 6 and keys[-1] is None


@pytest.mark.parametrize("a,b,same", [
    ('{"a": 1, "b": "X y"}', '{"b":"x  Y!","a":1.0}', True), ('{"a": null, "b": 1}', '{"b": 1e0}', True), ('{"a": [1, 2]}', '{"a": [2, 1]}', False), ('{"a": {"c": 1, "d": null}}', '{"a": {"c": 1}}', True),
    ('{"a": "1"}', '{"a": 1}', False), ('{"a": true}', '{"a": 1}', False), ('{"A": 1}', '{"a": 1}', False), ('{"a": 0.30}', '{"a": 3e-1}', True), ('{"a": "caf\\u00e9"}', '{"a": "CAFÉ"}', True), ("[null]", "[]", False), ('{"a": -0.0}', '{"a": 0}', True),
])
def test_json_forms(a, b, same):
    assert (dedup.canonical_json(a) == dedup.canonical_json(b)) is same


@pytest.mark.parametrize("bad", ["", "{", "{a: 1}", '{"a": NaN}', "{'a': 1}", '{"a": 1} x', "[" * 100000])
def test_broken_json(bad):
    assert dedup.canonical_json(bad) is None


# groups


def brute_groups(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return sorted(((find(x), x) for x in parent), key=str)


def random_pairs(seed):
    rng = random.Random(seed)
    pairs = [(f"n{rng.randrange(60):03d}", f"n{rng.randrange(60):03d}") for _ in range(35)]
    pairs += [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(40)]  # a chain
    pairs += [("hub", f"l{i}") for i in range(50)]
    return pairs + [(None, "x"), ("x", None), ("self", "self"), pairs[0], pairs[0][::-1]]


def test_groups(spark, rows):
    pairs = random_pairs(2)
    df = spark.createDataFrame([(*p, 0) for p in pairs], "a string, b string, v int")
    assert rows(components.group_ids(df)) == brute_groups(pairs)
    jumped = components.linked_groups(df, "jump")
    least = jumped.groupBy("root").agg(F.min("name").alias("g")).join(jumped, "root")
    assert rows(least, "g", "name") == brute_groups(pairs)


def test_groups_empty(spark):
    df = spark.createDataFrame([], "a string, b string")
    assert components.group_ids(df).count() == 0
    assert components.group_ids(spark.createDataFrame([("a", "a"), (None, "b")], "a string, b string")).count() == 0


# splits


def batch(spark, records, authors=()):
    r = spark.createDataFrame([(*x, "clash") for x in records], "record_id string, family string, sources array<string>, key string")
    a = spark.createDataFrame(list(authors), "source_id string, author string")
    return splits.record_links(r, a)


def first(spark, records, authors=()):
    return splits.update_splits(splits.SplitState.empty(spark), batch(spark, records, authors))


def given(state):
    return {r["record_id"]: r["split"] for r in splits.record_splits(state).collect()}


def test_related_records(spark, rows):
    records = [("1", "f1", ["s2"]), ("2", "f1", None), ("3", "f2", ["s9", None]), ("4", "f3", ["s1"]), ("5", None, None), ("6", "f4", []), ("1", "f1", ["s2"]), ("7", None, ["s7"]), (None, "f1", ["s1"])]
    authors = [("s2", "Ann  Lee"), ("s1", "ann lee"), ("s9", "unknown"), ("s7", " Staff"), ("s9", ""), ("s7", None), (None, "ann lee"), ("s0", "ANN\tLEE ")]
    state = first(spark, records, authors)
    assert rows(splits.source_groups(state)) == [("s0", "1"), ("s0", "2"), ("s0", "4"), ("s7", "7"), ("s9", "3")]
    got = given(state)
    assert set(got) == set("1234567") and got["1"] == got["2"] == got["4"] and None not in got.values()


def test_no_records(spark):
    state = first(spark, [])
    assert state.keys.count() == state.components.count() == 0
    later = splits.update_splits(first(spark, [("1", "f", None)]), batch(spark, []))
    assert given(later) == {"1": "train"} and later.conflicts.count() == 0


def test_shares_are_reached(spark):
    state = first(spark, [(f"r{i}", f"f{i // 3}", [f"s{i // 2}"] if i % 5 else None) for i in range(3000)])
    n = {r["split"]: r["n"] for r in state.components.groupBy("split").agg(F.sum("n_records").alias("n")).collect()}
    assert sum(n.values()) == 3000
    for s, share in splits.SHARES:
        assert abs(n[s] / 3000 - share) < 0.02


def test_later_batches(spark, rows, tmp_path):
    state = first(spark, [(f"r{i}", f"f{i}", None) for i in range(200)])
    state.save(str(tmp_path / "state"))
    state = splits.SplitState.load(spark, str(tmp_path / "state"))
    before = given(state)
    in_train, in_test = [sorted(r for r in before if before[r] == s) for s in ("train", "test")]
    f = lambda r: "f" + r[1:]
    second = [("new1", f(in_train[0]), ["x1"]), ("new2", f(in_train[1]), ["x1"]), ("new3", f(in_train[2]), ["x2"]), ("new4", f(in_test[0]), ["x2"]), ("new5", "fresh", None)]
    state2 = splits.update_splits(state, batch(spark, second))
    after = given(state2)
    of = dict(rows(splits.record_components(state2), "record_id", "component_id"))
    assert len({of[r] for r in ("new1", "new2", in_train[0], in_train[1])}) == 1 and after["new1"] == after["new2"] == "train"
    assert after["new3"] == after["new4"] == splits.QUARANTINE and of["new3"] == of["new4"]
    assert all(after[r] == s for r, s in before.items())  # nothing that was given out is taken back
    assert rows(state2.conflicts, "component_id", "met_id", "met_split") == sorted([(of["new3"], of[in_train[2]], "train"), (of["new3"], of[in_test[0]], "test")])
    assert after["new5"] in dict(splits.SHARES) and state2.components.agg(F.sum("n_records")).first()[0] == 205
    # the same batch again changes nothing
    again = splits.update_splits(state2, batch(spark, second))
    assert given(again) == after and rows(again.components) == rows(state2.components) and rows(again.keys) == rows(state2.keys)


def brute_update(state, records):
    """state: (component of key, split of component, records of component) after a batch, splits of new components None; and the clashing pairs of components."""
    comp, split, n = [dict(x) for x in state]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    edges = {(("r:" + r), k) for r, fam, src in records for k in ([f"f:{fam}"] if fam else []) + [f"s:{s}" for s in src or []] or ["r:" + r]}
    fixed = lambda k: k in comp and n[comp[k]] > 0
    at = lambda k: ("old", comp[k]) if k in comp else ("new", k)
    keys = {k for e in edges for k in e}
    for a, b in edges:
        if not fixed(a) and not fixed(b):
            parent[find(at(a))] = find(at(b))
    touch = {}
    for a, b in edges:
        for x, y in ((a, b), (b, a)):
            if fixed(x) and not fixed(y):
                touch.setdefault(find(at(y)), set()).add(comp[x])
    bad = {r for r, t in touch.items() if len({split[c] for c in t}) > 1}
    return {k[2:] for k in keys if k.startswith("r:") and k not in comp and find(at(k)) in bad}, {k[2:]: {split[c] for c in touch.get(find(at(k)), ())} for k in keys if k.startswith("r:") and k not in comp}


@pytest.mark.parametrize("seed", [1, 2])
def test_batches_against_brute_force(spark, rows, seed):
    rng = random.Random(seed)
    state, seen = splits.SplitState.empty(spark), []
    for b in range(3):
        new = [(f"r{b}-{i}", f"f{rng.randrange(40)}" if rng.random() < 0.7 else None, [f"s{rng.randrange(60)}" for _ in range(rng.randrange(3))]) for i in range(45)]
        mine = new + [rng.choice(seen) for _ in range(10 if seen else 0)]
        before = given(state)
        comp = dict(rows(state.keys, "key", "component_id"))
        split, n = [{r["component_id"]: r[c] for r in state.components.collect()} for c in ("split", "n_records")]
        quarantined, met = brute_update((comp, split, n), mine)
        state = splits.update_splits(state, batch(spark, mine))
        after = given(state)
        assert set(after) == set(before) | {r for r, *_ in mine} and all(after[r] == s for r, s in before.items())
        for r, *_ in new:
            # one split met: that one; several: quarantined; none: any of the three
            want = {splits.QUARANTINE} if r in quarantined else met[r] or set(dict(splits.SHARES))
            assert after[r] in want
        seen += new
        assert state.components.agg(F.sum("n_records")).first()[0] == len(after)
    # records in a split share no key with records of another
    of_key = {}
    for r, fam, src in seen:
        for k in [fam, *src]:
            if k and after[r] != splits.QUARANTINE:
                of_key.setdefault(k, set()).add(after[r])
    assert all(len(s) == 1 for s in of_key.values())


def test_empty_components_bind_nothing(spark):
    authors = [(f"s{i}", f"author {i}") for i in range(200)]
    state = first(spark, [(f"r{i}", f"f{i}", None) for i in range(200)], authors)
    assert state.components.filter("n_records = 0").count() == 200 == state.components.filter("split is null").count()
    before = given(state)
    # each record's family is tied to a source that had no record; s100 and s101 to each other; two more stay empty
    second = [(f"n{i}", f"f{i}", [f"s{i}"]) for i in range(100)] + [("fresh", "g", ["s100", "s101"])]
    links2 = batch(spark, second, [("s102", "Author 103")])
    state2 = splits.update_splits(state, links2)
    after = given(state2)
    assert all(after[r] == s for r, s in before.items()) and all(after[f"n{i}"] == before[f"r{i}"] for i in range(100))
    assert after["fresh"] in dict(splits.SHARES) and state2.conflicts.count() == 0
    assert {r["split"] for r in state2.components.filter("n_records = 0").select("split").distinct().collect()} == {None}
    # a state saved when empty components still had splits
    old = splits.SplitState(state.keys, state.components.withColumn("split", F.coalesce("split", F.lit("test"))), state.conflicts)
    again = given(splits.update_splits(old, links2))
    assert {r: again[r] for r in before} == before


def test_a_hub_of_many_leaves(spark):
    """A third and more of all links on one vertex: no task sees them all, and the result is one group."""
    n = 200_000
    star = spark.range(n).select(F.lit("hub").alias("a"), F.concat(F.lit("leaf"), F.col("id").cast("string")).alias("b"))
    pairs = star.unionByName(spark.range(n).select(F.concat(F.lit("x"), (F.col("id") * 2).cast("string")).alias("a"), F.concat(F.lit("x"), (F.col("id") * 2 + 1).cast("string")).alias("b")))
    sizes = {r["count"]: r["k"] for r in components.group_ids(pairs).groupBy("group_id").count().groupBy("count").agg(F.count(F.lit(1)).alias("k")).collect()}
    assert sizes == {n + 1: 1, 2: n}


# overlap


def brute_distance(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return prev[-1]


def edited(rng, w, n):
    w = list(w)
    for _ in range(n):
        k = rng.randrange(len(w) + 1)
        what = rng.choice("idr")
        if what == "i" or not w:
            w.insert(k, rng.choice("pqrs"))
        elif k < len(w):
            w[k : k + 1] = [] if what == "d" else [rng.choice("pqrs")]
    return w


@pytest.mark.parametrize("sizes", [(0, 6), (10, 40), (60, 140)])
def test_near_pairs_lose_nothing(spark, rows, sizes):
    rng = random.Random(sizes[0])
    texts = [[rng.choice("abcdefgh") + str(rng.randrange(4)) for _ in range(rng.randint(*sizes))] for _ in range(12)]
    texts += [edited(rng, rng.choice(texts[:12]), rng.randint(0, 4)) for _ in range(60)]
    texts = sorted({" ".join(t) for t in texts})
    ev, tr = texts[::3], [t for i, t in enumerate(texts) if i % 3] + texts[:4]
    mk = lambda x: spark.createDataFrame([(t,) for t in sorted(set(x))], "text string")
    got = rows(overlap.near_pairs(mk(ev), mk(tr)), "eval_text", "train_text")
    want = sorted(((a, b) for a in set(ev) for b in set(tr) if brute_distance(a.split(), b.split()) <= 2), key=str)
    assert got == want


def test_cross_split_pairs(spark, rows):
    records = [("1", "f1", "a b c d e f g h"), ("2", "f2", "A b c, d e f g x!"), ("3", "f1", "z z z"), ("4", None, None), ("5", None, ""), ("6", "f9", "..."), ("7", "f7", "q w e r t y u"), ("1", "f1", "a b c d e f g h")]
    members = [("train", "1"), ("train", "4"), ("test", "2"), ("test", "3"), ("validation", "1"), ("validation", "4"), ("test", "5"), ("train", "6"), ("test", "nobody"), (None, "1"), ("test", "2"), ("holdout", "7")]
    r = spark.createDataFrame([(*x, 1) for x in records], "record_id string, family string, text string, split int")
    m = spark.createDataFrame(members, "split string, record_id string")
    assert rows(overlap.cross_split_pairs(r, m)) == [("test", "1", "2"), ("test", "1", "3"), ("test", "5", "6"), ("validation", "1", "1"), ("validation", "4", "4")]
    classes = overlap.cross_split(r, m)
    assert rows(classes.counts(), "split", "kind", "eval_class", "n_eval", "n_train") == [("test", "family", "f1", 1, 1), ("test", "text", "", 1, 1), ("test", "text", "a b c d e f g x", 1, 1), ("validation", "family", "f1", 1, 1), ("validation", "record", "1", 1, 1), ("validation", "record", "4", 1, 1), ("validation", "text", "a b c d e f g h", 1, 1)]
    assert overlap.cross_split_pairs(r, m.filter("split = 'train'")).count() == 0
    assert overlap.cross_split_pairs(r.filter("false"), m).count() == 0


def test_copies_are_not_expanded(spark):
    n = 400
    r = spark.range(2 * n).select(F.col("id").cast("string").alias("record_id"), F.lit("f").alias("family"), F.lit("one two three four five six").alias("text"))
    m = spark.range(2 * n).select(F.when(F.col("id") < n, "train").otherwise("test").alias("split"), F.col("id").cast("string").alias("record_id"))
    classes = overlap.cross_split(r, m)
    assert classes.links.count() == 2 and sorted(tuple(x) for x in classes.counts().select("kind", "n_eval", "n_train").collect()) == [("family", n, n), ("text", n, n)]
    assert classes.pairs().count() == n * n


def test_overlap_fractions(spark):
    long = " ".join(f"w{i}" for i in range(80))
    r = spark.createDataFrame([("1", long), ("2", long.upper() + "!"), ("3", "new " + long), ("4", "other words altogether here"), ("5", None), ("6", "")], "record_id string, text string")
    m = spark.createDataFrame([("train", "1")] + [("test", str(i)) for i in range(2, 7)], "split string, record_id string")
    got = {x["record_id"]: x["overlap"] for x in overlap.overlap_fractions(r, m).collect()}
    assert got["2"] == 1.0 and 0.8 < got["3"] < 1.0 and got["4"] == got["5"] == got["6"] == 0.0


def test_an_edit_changes_few_chunks():
    rng = random.Random(3)
    for bits, window in itertools.product((0, 1, 2), (1, 2, 3)):
        for _ in range(200):
            w = [f"w{rng.randrange(30)}" for _ in range(rng.randint(1, 60))]
            v = edited(rng, w, 1)
            counts = [len(overlap.chunk_ends(overlap.word_hashes(x), bits, 1)) for x in (w, v)]
            assert abs(counts[0] - counts[1]) <= 1
            a, b = [{d for d, _ in overlap.chunk_digests(overlap.word_hashes(x), bits, window)} for x in (w, v)]
            most = 1 if bits == 0 else window + 1
            assert len(a - b) <= most and len(b - a) <= most


def test_chunk_counts():
    h = overlap.word_hashes([f"w{i % 50}" for i in range(300)])
    assert all(overlap.chunk_counts(h[:n], w) == [len(overlap.chunk_ends(h[:n], b, w)) for b in range(overlap.LEVELS)] for n in (0, 1, 7, 300) for w in (1, 2))


def test_chunks_make_up_the_record():
    h = overlap.word_hashes([f"w{i % 7}" for i in range(100)])
    assert sum(n for _, n in overlap.chunk_digests(h, 2)) == 100 and overlap.chunk_digests(h[:0], 2) == []
    assert len({d for d, _ in overlap.chunk_digests(h, 0)}) == 100  # repeated words count as often as they stand there


def test_json_key_column(spark):
    df = spark.createDataFrame([(json.dumps({"a": 1}),), ("{",), (None,)], "p string").select(dedup.json_key("p").alias("k"))
    assert [r[0] is None for r in df.collect()] == [False, True, True]
