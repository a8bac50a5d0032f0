"""Records of evaluation splits that appear, exactly or almost, in the training split.

Records are normalised to words and cut into content-defined chunks: a hash that
rolls over the last words decides where a chunk ends, so that an edit changes
the chunks about it and no others. Chunk digests are joined across splits; the
lengths of shared chunks add up to each record's overlap fraction.

For records within a few word edits the join is made lossless. With a window of
one word an edit spoils at most two chunks of either record and changes their
number by at most one. A record is cut at the levels, chunks of 1, 2, 4 ... words
on average, at which a partner within reach may have enough chunks, and two such
records always have one level in common where each keeps a chunk that the other
has. If chunks are put in one order, rarest first, one of the first lost + 1 of
each is shared (prefix filtering; Chaudhuri et al. 2006), so only these are
joined. What meets is kept if the summed lengths of all its shared chunks leave
no more uncovered than so many edits can spoil, and then checked word by word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimloom.functions.words import words
from claimloom.operators.skew import hot_keys, hot_of_counts, hot_values, lookup_join, spread_join
from claimloom.session import scratch, scratch_scope

EDITS = 2
WINDOW = 2
#: Words that a join key of the lowest level, where every word is a chunk, is made of.
_KEY = 2
#: Levels: chunks of 2 ** level words on average.
LEVELS = 9
_MASKS = np.array([(1 << b) - 1 for b in range(LEVELS)], np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(tokens: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(t) for t in tokens), np.uint64, len(tokens))


def cut_bits(hashes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """For each word, the bits that the rolling hash of the last `window` words gives to decide on a cut after it."""
    n = len(hashes)
    rolling = np.zeros(n, np.uint64)
    power = np.uint64(1)
    with np.errstate(over="ignore"):
        for k in range(min(window, n)):  # h[i] + B h[i-1] + B^2 h[i-2] ...
            rolling[k:] += power * hashes[: n - k]
            power = power * _BASE
        rolling ^= rolling >> np.uint64(29)
        rolling *= _BASE
    return rolling >> np.uint64(40)


def chunk_ends(hashes: np.ndarray, mask_bits: int, window: int = WINDOW) -> np.ndarray:
    """Ends (exclusive) of the chunks: a chunk ends after each word where the rolling hash of the last `window` words has mask_bits zero bits, and at the end.

    With no mask bits every word ends a chunk; else a chunk has 2 ** mask_bits words on average.
    """
    if len(hashes) == 0:
        return np.zeros(0, np.int64)
    cut = cut_bits(hashes, window) & np.uint64((1 << mask_bits) - 1) == 0
    cut[-1] = True
    return np.flatnonzero(cut) + 1


def chunk_counts(hashes: np.ndarray, window: int = WINDOW) -> list[int]:
    """The number of chunks at each of the LEVELS."""
    if len(hashes) == 0:
        return [0] * LEVELS
    bits = cut_bits(hashes, window)
    cuts = (bits[:, None] & _MASKS) == 0
    cuts[-1] = True
    return cuts.sum(axis=0).tolist()


def chunk_digests(hashes: np.ndarray, mask_bits: int, window: int = WINDOW) -> list[tuple[int, int]]:
    """(digest, words) of each chunk; a chunk that occurs again in the record gets another digest for each time, so that shared chunks count as often as both have them."""
    if mask_bits == 0:  # a word each, whose hash is its digest
        chunks = [(h, 1) for h in hashes.tolist()]
    else:
        ends = chunk_ends(hashes, mask_bits, window).tolist()
        chunks = [(xxhash.xxh3_64_intdigest(hashes[a:b].tobytes(), mask_bits), b - a) for a, b in zip([0, *ends], ends)]
    if len({d for d, _ in chunks}) == len(chunks):
        return [(d - (1 << 63), n) for d, n in chunks]
    out, seen = [], {}
    for plain, n in chunks:
        times = seen.get(plain, 0)
        seen[plain] = times + 1
        out.append(((plain if times == 0 else xxhash.xxh3_64_intdigest(plain.to_bytes(8, "little"), times)) - (1 << 63), n))
    return out


def _at_most(a: list[str], b: list[str], most: int, i: int = 0, j: int = 0) -> bool:
    """Whether a[i:] becomes b[j:] by inserting, dropping or replacing at most so many words."""
    if abs((len(a) - i) - (len(b) - j)) > most:
        return False
    while i < len(a) and j < len(b) and a[i] == b[j]:
        i, j = i + 1, j + 1
    if i == len(a) or j == len(b):
        return max(len(a) - i, len(b) - j) <= most
    return most > 0 and (_at_most(a, b, most - 1, i + 1, j + 1) or _at_most(a, b, most - 1, i, j + 1) or _at_most(a, b, most - 1, i + 1, j))


def levels_for(counts: list[int], edits: int = EDITS) -> list[int]:
    """The levels a record is cut at, from its number of chunks at each level.

    Longer chunks pay where those that `edits` edits can spoil, two each, are few
    of them, so a level is taken from `need` chunks on, four times as many. Of a
    record and its partner take the highest level b at which the record has
    `edits` more than that. There the partner has need chunks, and one level
    higher fewer than need + 2 edits, and so has the record.
    """
    need = 8 * edits
    return [b for b in range(len(counts)) if (b == 0 or counts[b] >= need) and (b + 1 == len(counts) or counts[b + 1] < need + 2 * edits)]


_CUTS = "text_id long, text string, e boolean, t boolean, n_words int, bits int, digests array<long>, sizes array<int>"


def _cut(texts: DataFrame, edits: int) -> DataFrame:
    """texts(text_id, text, e, t) with, for each of their levels, the digests and lengths of the chunks."""

    def make(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = []
            for tid, text, e, t in zip(pdf["text_id"], pdf["text"], pdf["e"], pdf["t"]):
                h = word_hashes(text.split(" ") if text else [])
                for b in levels_for(chunk_counts(h, 1), edits):
                    c = chunk_digests(h, b, 1)
                    rows.append((tid, text, e, t, len(h), b, [d for d, _ in c], [n for _, n in c]))
            yield pd.DataFrame(rows, columns=["text_id", "text", "e", "t", "n_words", "bits", "digests", "sizes"]).astype({"n_words": "int32", "bits": "int32"})

    return texts.mapInPandas(make, _CUTS)


@F.pandas_udf(T.BooleanType())
def _within(a: pd.Series, b: pd.Series, most: pd.Series) -> pd.Series:
    return pd.Series([_at_most(x.split(" ") if x else [], y.split(" ") if y else [], int(m)) for x, y, m in zip(a, b, most)], dtype=bool)


@F.pandas_udf(T.StringType())
def _joined_words(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in it:
        yield s.map(lambda t: None if t is None else " ".join(words(t)))


def near_pairs(evaluation: DataFrame, training: DataFrame, edits: int = EDITS) -> DataFrame:
    """Pairs of different or equal texts across the two sides that become equal by at most so many word edits.

    evaluation(text) and training(text) hold normalised texts (words joined by
    blanks), repeated at will. Returns eval_text, train_text, overlap (the part
    of the evaluation text's words in shared chunks); no pair is lost.

    Scale: a text takes part with the 2 edits + 1 rarest chunks of each of its
    levels (at the lowest with pairs of its edits + 2 rarest words), so the join
    is on rare keys. Counts are combined before the shuffle; hot chunks are
    ranked without one, and a hot join key is split over several tasks. Texts
    of at most `edits` words are all within reach of each other: every such pair
    is a result, and they are joined as one hot key.
    """
    side = lambda df, e: df.select("text", F.lit(e).alias("e"), F.lit(not e).alias("t"))
    both = side(evaluation, True).unionByName(side(training, False)).filter("text is not null").groupBy("text").agg(F.max("e").alias("e"), F.max("t").alias("t"))
    cuts = scratch(_cut(both.withColumn("text_id", F.monotonically_increasing_id()), edits), "cuts")
    rows = cuts.select("text_id", "e", "t", "n_words", "bits", F.explode("digests").alias("digest"))
    # a chunk that only one side has can be no key, but takes its place in the order as the rarest
    counts = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max("e").alias("e"), F.max("t").alias("t")).filter("e and t").select("digest", "n")
    counts = scratch(counts, "counts")
    ranked = lookup_join(rows, counts, "digest", hot_of_counts(counts, "digest"))
    keep = F.when(F.col("bits") == 0, edits + _KEY).otherwise(2 * edits + 1)
    firsts = ranked.groupBy("text_id", "e", "t", "n_words", "bits").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "digest"))).alias("c"))  # the chunks of one text
    shared = F.filter(F.slice("c", 1, keep), lambda x: x["n"] > 0)
    firsts = firsts.select("text_id", "e", "t", "n_words", "bits", F.transform(shared, lambda x: x["digest"]).alias("c"))
    of_two = F.flatten(F.transform("c", lambda x, i: F.transform(F.slice("c", i + 2, F.size("c")), lambda y: F.xxhash64(x, y))))
    # texts of so few words need not have two in common and also meet under single ones
    singles = F.when(F.col("n_words") < edits + _KEY, F.transform("c", lambda x: F.xxhash64(F.lit("one"), x))).otherwise(F.array().cast("array<long>"))
    key = F.explode(F.when(F.col("bits") == 0, F.concat(of_two, singles)).otherwise(F.col("c"))).alias("key")
    keys = scratch(firsts.select("text_id", "e", "t", F.col("n_words").alias("n"), "bits", key), "keys")
    left = keys.filter("e").select(F.col("text_id").alias("ea"), F.col("n").alias("na"), "bits", "key")
    right = keys.filter("t").select(F.col("text_id").alias("tb"), F.col("n").alias("nb"), "bits", "key")
    met = spread_join(left, right, ["bits", "key"], hot_keys(left, ["bits", "key"])).filter(F.abs(F.col("na") - F.col("nb")) <= edits)
    met = met.groupBy("ea", "tb").agg(F.max("bits").alias("bits"))
    of = lambda i, x: cuts.select(F.col("text_id").alias(i), "bits", F.col("text").alias(f"text_{x}"), F.col("n_words").alias(f"n_{x}"), F.col("digests").alias(f"d_{x}"), F.col("sizes").alias(f"s_{x}")).hint("merge")
    held = met.join(of("ea", "a"), ["ea", "bits"]).join(of("tb", "b"), ["tb", "bits"])

    def covered(x: str, other: str) -> Column:
        """The summed lengths of the chunks of x that the other has too."""
        common = F.filter(F.arrays_zip(f"d_{x}", f"s_{x}"), lambda c: F.array_contains(F.col(f"d_{other}"), c[f"d_{x}"]))
        return F.aggregate(common, F.lit(0), lambda acc, c: acc + c[f"s_{x}"])

    def spoilt(x: str) -> Column:
        """The most words that so many edits can leave uncovered: those of the longest chunks."""
        longest = F.slice(F.sort_array(f"s_{x}", asc=False), 1, F.when(F.col("bits") == 0, edits).otherwise(2 * edits))
        return F.aggregate(longest, F.lit(0), lambda acc, n: acc + n)

    held = held.withColumns({"c_a": covered("a", "b"), "c_b": covered("b", "a")})
    enough = held.filter((F.col("n_a") - F.col("c_a") <= spoilt("a")) & (F.col("n_b") - F.col("c_b") <= spoilt("b")))
    near = enough.filter(_within("text_a", "text_b", F.lit(edits))).select(F.col("text_a").alias("eval_text"), F.col("text_b").alias("train_text"), (F.col("c_a") / F.col("n_a")).alias("overlap"))
    few = cuts.filter((F.col("bits") == 0) & (F.col("n_words") <= edits)).withColumn("key", F.lit(0))
    fe, ft = few.filter("e").select("key", F.col("text").alias("eval_text"), "digests"), few.filter("t").select("key", F.col("text").alias("train_text"), F.col("digests").alias("other"))
    short = spread_join(fe.select("key", "eval_text"), ft.select("key", "train_text"), ["key"], hot_keys(fe, ["key"]))
    longer = near.filter((F.size(F.split("eval_text", " ")) > edits) | (F.size(F.split("train_text", " ")) > edits))
    return longer.unionByName(short.select("eval_text", "train_text", F.when(F.col("eval_text") == F.col("train_text"), 1.0).otherwise(0.0).alias("overlap")))


@dataclass
class CrossSplit:
    """Classes of records and the links between them.

    members(split, is_eval, kind, class, record_id): a record is in the class of
    each family and each text it has, and in one of its own. links(kind,
    eval_class, train_class): a family's class and a record's own are linked
    with themselves, a text's with those within reach. Copies are in one class
    and are not expanded.
    """

    members: DataFrame
    links: DataFrame

    def counts(self) -> DataFrame:
        """split, kind, eval_class, train_class, n_eval, n_train of all links that have members on both sides."""
        n = scratch(self.members.groupBy("split", "is_eval", "kind", "class").agg(F.count(F.lit(1)).alias("n")), "sizes")
        e = n.filter("is_eval").select("split", "kind", F.col("class").alias("eval_class"), F.col("n").alias("n_eval"))
        t = n.filter("not is_eval").select("kind", F.col("class").alias("train_class"), F.col("n").alias("n_train"))
        return e.join(self.links.hint("merge"), ["kind", "eval_class"]).join(t.hint("merge"), ["kind", "train_class"])

    def pairs(self, evaluation: DataFrame | None = None, training: DataFrame | None = None) -> DataFrame:
        """split, a, b with a <= b, each once: the links expanded to records, or to those of (record_id) on either side."""
        e = self.members.filter("is_eval").select("split", "kind", F.col("class").alias("eval_class"), F.col("record_id").alias("a"))
        t = self.members.filter("not is_eval").select("kind", F.col("class").alias("train_class"), F.col("record_id").alias("b"))
        if evaluation is not None:
            e = e.join(evaluation.select(F.col("record_id").alias("a")).hint("merge"), "a", "left_semi")
        if training is not None:
            t = t.join(training.select(F.col("record_id").alias("b")).hint("merge"), "b", "left_semi")
        to = scratch(spread_join(e, self.links, ["kind", "eval_class"], hot_keys(e, ["kind", "eval_class"])).select("split", "kind", "train_class", "a"), "linked")
        every = spread_join(to, t, ["kind", "train_class"], hot_keys(to, ["kind", "train_class"]))
        return every.select("split", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    def pairs_by_group(self, groups: DataFrame) -> DataFrame:
        """split, grp, n_pairs: the pairs of which either record is in a group of groups(record_id, grp), counted from the classes.

        A pair counts once for each group of either record, under null if it has
        none. Pairs of plain records, those of one family and one text at most
        that are on one side only, are counted and not formed: as many as the
        family links give, and the text links, less those that are both. Pairs
        with any other record are formed.
        """
        groups = scratch(groups.filter("record_id is not null and grp is not null").select("record_id", "grp").distinct(), "groups")
        of = lambda kind: F.when(F.col("kind") == kind, F.col("class"))
        own = self.members.groupBy("record_id").agg(F.count_distinct(of("family")).alias("nf"), F.count_distinct(of("text")).alias("nt"), F.max("is_eval").alias("e"), F.min("is_eval").alias("all_e"))
        own = scratch(own.select("record_id", ((F.col("nf") <= 1) & (F.col("nt") <= 1) & (F.col("e") == F.col("all_e"))).alias("plain")), "plain")
        plain = self.members.join(own.filter("plain").select("record_id").hint("merge"), "record_id", "left_semi")
        plain = scratch(plain.groupBy("split", "is_eval", "record_id").agg(F.max(of("family")).alias("f"), F.max(of("text")).alias("x")), "plain")
        e, t = plain.filter("is_eval").select("split", "record_id", "f", "x"), plain.filter("not is_eval").select("record_id", "f", "x")
        near = self.links.filter("kind = 'text'").select(F.col("eval_class").alias("x"), F.col("train_class").alias("y"))
        to = spread_join(e.filter("x is not null"), near, ["x"], hot_keys(e, ["x"])).select("split", "record_id", "f", F.col("y").alias("x"))

        def keyed(fam: DataFrame, text: DataFrame, *cols: str) -> DataFrame:
            """The rows a side has under each link: of the family, of the text, and of both, which were counted twice."""
            none = F.lit(None).cast("string")
            row = lambda df, sign, f, x: df.select(*cols, F.lit(sign).alias("sign"), f.alias("f"), x.alias("x"))
            both = text.filter("f is not null and x is not null")
            return row(fam.filter("f is not null"), 1, F.col("f"), none).unionByName(row(text.filter("x is not null"), 1, none, F.col("x"))).unionByName(row(both, -1, F.col("f"), F.col("x")))

        def sized(rows: DataFrame, *cols: str) -> tuple[DataFrame, DataFrame]:
            """Numbers of rows under each link and group (null for those in none), and under each link."""
            rows = scratch(rows.withColumn("k", F.struct(F.col("sign"), F.coalesce("f", F.lit("")).alias("f"), F.coalesce("x", F.lit("")).alias("x"))).join(groups.hint("merge"), "record_id", "left"), "keyed")
            return scratch(rows.groupBy(*cols, "k", "grp").agg(F.count(F.lit(1)).alias("n")), "by"), scratch(rows.groupBy(*cols, "k").agg(F.count_distinct("record_id").alias("n")), "all")

        eg, ea = sized(keyed(e, to, "split", "record_id"), "split")
        tg, ta = sized(keyed(t, t, "record_id"))
        ren = lambda df, n: df.withColumnRenamed("n", n).hint("merge")
        with_e = eg.filter("grp is not null").join(ren(ta, "m"), "k").select("split", "k.sign", "grp", (F.col("n") * F.col("m")).alias("n"))
        with_t = tg.filter("grp is not null").join(ren(ea, "m"), "k").select("split", "k.sign", "grp", (F.col("n") * F.col("m")).alias("n"))
        with_both = eg.filter("grp is not null").join(ren(tg, "m"), ["k", "grp"]).select("split", "k.sign", "grp", (-F.col("n") * F.col("m")).alias("n"))
        with_none = eg.filter("grp is null").drop("grp").join(ren(tg.filter("grp is null").drop("grp"), "m"), "k").select("split", "k.sign", F.lit(None).cast("string").alias("grp"), (F.col("n") * F.col("m")).alias("n"))
        counted = with_e.unionByName(with_t).unionByName(with_both).unionByName(with_none).select("split", "grp", (F.col("sign") * F.col("n")).alias("n"))
        other, plainly = own.filter("not plain").select("record_id"), own.filter("plain").select("record_id")
        formed = scratch(self.pairs(evaluation=other).unionByName(self.pairs(evaluation=plainly, training=other)).distinct(), "formed")
        ends = formed.select("split", "a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("record_id")).join(groups.hint("merge"), "record_id", "left")
        any_group = ends.groupBy("split", "a", "b").agg(F.collect_set("grp").alias("s"))  # those of two records
        formed = any_group.select("split", F.explode_outer("s").alias("grp"), F.lit(1).alias("n"))
        return counted.unionByName(formed).groupBy("split", "grp").agg(F.sum("n").cast("long").alias("n_pairs")).filter("n_pairs > 0")


def cross_split(records: DataFrame, members: DataFrame, train: str = "train", edits: int = EDITS) -> CrossSplit:
    """Records listed in an evaluation split and records listed in train that are the same or nearly so, as linked classes.

    records(record_id, family, text), members(split, record_id). Two records are
    linked whose families are the same or whose texts are within `edits` word
    edits, and a record with itself when it is listed in both. Every list but
    `train` is an evaluation split; null splits and ids and listed ids without
    a record are passed over. A null family or text is like no other; a text
    without words is like those of at most `edits` words. Repeated rows of an
    id are one record, with all the families and texts they give. members and
    links are written tables; those made on the way are deleted.
    """
    with scratch_scope() as keep:
        found = _cross_split(records, members, train, edits)
        keep(found.members, found.links)
    return found


def _cross_split(records: DataFrame, members: DataFrame, train: str, edits: int) -> CrossSplit:
    listed = members.filter("split is not null and record_id is not null").select("split", "record_id").distinct()
    own = records.select("record_id", "family", _joined_words("text").alias("text")).join(listed.hint("merge"), "record_id").withColumn("is_eval", F.col("split") != train)
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("class")) for k, c in (("family", "family"), ("text", "text"), ("record", "record_id"))])
    classes = own.select("split", "is_eval", "record_id", F.explode(kinds).alias("k")).filter("k.class is not null").select("split", "is_eval", "k.kind", "k.class", "record_id").distinct()
    classes = scratch(classes, "classes")
    texts = classes.filter("kind = 'text'").select(F.col("class").alias("text"), "is_eval")
    near = near_pairs(texts.filter("is_eval").select("text"), texts.filter("not is_eval").select("text"), edits)
    same = classes.filter("kind <> 'text'").groupBy("kind", "class").agg(F.max("is_eval").alias("e"), F.min("is_eval").alias("t")).filter("e and not t")
    links = near.select(F.lit("text").alias("kind"), F.col("eval_text").alias("eval_class"), F.col("train_text").alias("train_class")).unionByName(same.select("kind", F.col("class").alias("eval_class"), F.col("class").alias("train_class")))
    return CrossSplit(classes, scratch(links, "links"))


def cross_split_pairs(records: DataFrame, members: DataFrame, train: str = "train", edits: int = EDITS) -> DataFrame:
    """split, a, b with a <= b: the pairs of records of cross_split, each once."""
    return cross_split(records, members, train, edits).pairs()


def overlap_fractions(records: DataFrame, members: DataFrame, train: str = "train", mask_bits: int = 2, window: int = WINDOW) -> DataFrame:
    """How much of each record of an evaluation split stands in chunks that the training split has too.

    Returns split, record_id, n_words, shared_words and overlap, the part of
    the words; records without words have overlap 0. A digest counts as shared
    once any training record has it, so the join is to a unique key and no
    pairs arise.
    """

    def cut(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = []
            for rid, text in zip(pdf["record_id"], pdf["text"]):
                w = words(text)
                c = chunk_digests(word_hashes(w), mask_bits, window)
                rows.append((rid, len(w), [d for d, _ in c], [n for _, n in c]))
            yield pd.DataFrame(rows, columns=["record_id", "n_words", "digests", "sizes"]).astype({"n_words": "int32"})

    listed = members.filter("split is not null and record_id is not null").select("split", "record_id").distinct()
    one = records.filter("record_id is not null").groupBy("record_id").agg(F.min("text").alias("text"))
    cuts = scratch(one.mapInPandas(cut, "record_id string, n_words int, digests array<long>, sizes array<int>"), "cuts")
    own = cuts.join(listed, "record_id")
    in_train = own.filter(F.col("split") == train).select(F.explode("digests").alias("digest")).distinct().withColumn("hit", F.lit(1))
    ev = own.filter(F.col("split") != train)
    chunks = ev.select("split", "record_id", "n_words", F.explode(F.arrays_zip("digests", "sizes")).alias("c")).select("split", "record_id", F.col("c.digests").alias("digest"), F.col("c.sizes").alias("size"))
    chunks = scratch(chunks, "chunks")
    hits = lookup_join(chunks, in_train, "digest", hot_values(chunks, "digest"), "inner").groupBy("split", "record_id").agg(F.sum("size").alias("shared"))
    return ev.select("split", "record_id", "n_words").join(hits, ["split", "record_id"], "left").select(
        "split", "record_id", "n_words", F.coalesce("shared", F.lit(0)).cast("int").alias("shared_words"), F.when(F.col("n_words") > 0, F.coalesce("shared", F.lit(0)) / F.col("n_words")).otherwise(0.0).alias("overlap")
    )
