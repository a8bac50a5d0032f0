"""Mixing sources to target weights.

Two ways to weights. By temperature: the sources' natural token shares are
raised to one exponent, found by bisection so that the normalised weights have a
target entropy, or as near to it as the repetition limits allow. By target
shares: each source is given its share of the budget itself, held to its limit;
one exponent for all sources cannot meet shares that are given source by source.
Either way the weights are realised as budgeted permutations: whole passes over
a source, and of one more pass the blocks, in a seeded order, that fill its
budget.

Scale: token counts are made once per document and written. Sources, plans and
blocks are tables, however many sources there are; the driver sees sums over
sources only. Documents of large sources find their plan without a shuffle, and
only the one block of a source that its budget ends in is ordered document by
document.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from claimloom.operators.skew import hot_of_counts, lookup_join
from claimloom.session import scratch, scratch_scope

TOKENIZER = os.environ.get("CLAIMLOOM_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: How the vocabulary's public tokenizer splits a text before its merges: a fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLOCKS = 4096

_encodings: dict[str, object] = {}


def _encoding(path: str):
    if path not in _encodings:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        _encodings[path] = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def count_tokens(text: Column | str, path: str = TOKENIZER) -> Column:
    """Tokens of a text by the tokenizer whose vocabulary is at path; 0 for a null text."""

    @F.pandas_udf("long")
    def count(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = _encoding(path).encode_ordinary
        for s in it:
            yield s.map(lambda t: len(encode(t)) if t else 0).astype("int64")

    return count(text)


def source_name(c: Column | str) -> Column:
    """Sources are the same when they differ only in case, outer blanks and separators."""
    return F.lower(F.regexp_replace(F.trim(F.regexp_replace(c, r"(?U)[\s_-]+", " ")), " ", "-"))


#: Exponents tried at once, and how often the interval is cut to one of their steps.
_STEPS, _ROUNDS = 32, 6


def temperature(sources: DataFrame, entropy: float, budget: float) -> float:
    """The exponent of temperature mixing for sources(available_tokens, max_repeats).

    It is the largest in 0..1 at which the normalised weights have at least the
    entropy, or, where a source would be repeated too often in so many tokens,
    the smallest above it at which none is; 1 (the natural shares) if no lower
    one will do. Sources without tokens take no part. Each round of the
    bisection is one aggregation over the sources.
    """
    own = sources.filter("available_tokens > 0 and max_repeats > 0")
    total = own.agg(F.sum("available_tokens")).first()[0]
    if not total or budget <= 0:
        return 1.0
    p = F.col("available_tokens") / F.lit(float(total))

    def measured(low: float, high: float) -> list[tuple[float, float, bool]]:
        """(exponent, entropy, within the limits) from low to high."""
        tried = sorted({low + (high - low) * i / _STEPS for i in range(_STEPS + 1)})
        at = own.withColumn("e", F.explode(F.array(*[F.lit(e) for e in tried])))
        raised = F.pow(p, "e")
        rows = at.groupBy("e").agg(F.sum(raised).alias("z"), F.sum(raised * F.log(p)).alias("s"), F.max(raised / p / F.col("max_repeats")).alias("m"), F.log(F.sum(raised)).alias("lz")).collect()
        return sorted((r["e"], r["lz"] - r["e"] * r["s"] / r["z"], r["m"] / r["z"] * budget <= total * (1 + 1e-12)) for r in rows)

    def bisected(holds) -> float:
        """Where holds, true from some exponent down, stops being so."""
        low, high = 0.0, 1.0
        for _ in range(_ROUNDS):
            good = [m[0] for m in measured(low, high) if holds(m)]
            if not good:
                return low
            if max(good) == high:
                return high
            low, high = max(good), max(good) + (high - low) / _STEPS
        return low

    even = bisected(lambda m: m[1] >= entropy)
    free = bisected(lambda m: not m[2])  # repetition only falls as the exponent rises
    return even if measured(even, even)[0][2] else min(1.0, free + _STEPS**-_ROUNDS)


def _counted(documents: DataFrame, targets: DataFrame, tokenizer: str) -> tuple[DataFrame, DataFrame, int]:
    """(docs: doc_id, source, n_tokens; sources: source, target_share, max_repeats, available_tokens, n_docs, largest; all tokens)."""
    one = documents.select(F.col("doc_id").cast("long").alias("doc_id"), source_name("source").alias("source"), "text").filter("doc_id is not null")
    counted = scratch(one.select("doc_id", "source", count_tokens("text", tokenizer).alias("n_tokens")), "tokens")
    docs = scratch(counted.groupBy("doc_id").agg(F.min(F.struct("source", "n_tokens")).alias("x")).select("doc_id", "x.*"), "docs")
    wanted = targets.select(source_name("source").alias("source"), "target_share", "max_repeats").filter("source is not null")
    wanted = wanted.groupBy("source").agg(F.max(F.struct("target_share", "max_repeats")).alias("x")).select("source", F.coalesce("x.target_share", F.lit(0.0)).alias("target_share"), F.coalesce("x.max_repeats", F.lit(0)).alias("max_repeats"))
    own = docs.filter("n_tokens > 0").groupBy("source").agg(F.sum("n_tokens").alias("available_tokens"), F.count(F.lit(1)).alias("n_docs"), F.max("n_tokens").alias("largest"))
    sources = scratch(wanted.join(own, "source", "left").fillna(0, ["available_tokens", "n_docs", "largest"]), "sources")
    return docs, sources, docs.agg(F.sum("n_tokens")).first()[0] or 0


def _realised(docs: DataFrame, wants: DataFrame, seed: int) -> DataFrame:
    """doc_id, source, n_tokens, times: documents of wants(source, max_repeats, available_tokens, n_docs, want) as often as fills the tokens wanted, written."""
    passes = F.when(F.col("available_tokens") > 0, F.least(F.floor(F.col("want") / F.col("available_tokens")), "max_repeats")).otherwise(0)
    plans = wants.withColumn("passes", passes.cast("int")).withColumn("rest", F.when(F.col("passes") < F.col("max_repeats"), F.col("want") - F.col("passes") * F.col("available_tokens")).otherwise(0))
    plans = scratch(plans.filter("available_tokens > 0"), "plans")
    placed = lookup_join(docs.filter("n_tokens > 0"), plans.select("source", "passes", "rest"), "source", hot_of_counts(plans, "source", "n_docs"), "inner")
    placed = placed.withColumn("h", F.xxhash64(F.lit(seed), "doc_id")).withColumn("block", F.pmod("h", F.lit(BLOCKS)))
    by_source = W.partitionBy("source").orderBy("bh", "block")
    blocks = (  # at most BLOCKS rows a source
        placed.groupBy("source", "block").agg(F.sum("n_tokens").alias("bn"), F.max("rest").alias("rest"))
        .withColumn("bh", F.xxhash64(F.lit(seed), "source", "block")).withColumn("before", F.sum("bn").over(by_source) - F.col("bn"))
        .select("source", "block", "before", (F.col("before") + F.col("bn") <= F.col("rest")).alias("whole"), ((F.col("before") < F.col("rest")) & (F.col("before") + F.col("bn") > F.col("rest"))).alias("last"))
    )
    with_block = placed.join(blocks.hint("merge"), ["source", "block"])
    inner = W.partitionBy("source", "block").orderBy("h", "doc_id")
    ending = with_block.filter("last").withColumn("upto", F.col("before") + F.sum("n_tokens").over(inner)).withColumn("extra", (F.col("upto") - F.col("n_tokens") / 2 <= F.col("rest")).cast("int"))
    others = with_block.filter("not last").withColumn("extra", F.col("whole").cast("int"))
    cols = ["doc_id", "source", "n_tokens", "passes", "extra"]
    chosen = ending.select(*cols).unionByName(others.select(*cols))
    return scratch(chosen.withColumn("times", F.col("passes") + F.col("extra")).filter("times > 0").select("doc_id", "source", "n_tokens", "times"), "mixture")


def mixture(documents: DataFrame, targets: DataFrame, seed: int = 11, tokenizer: str = TOKENIZER, budget: int | None = None, entropy: float | None = None) -> tuple[DataFrame, DataFrame]:
    """The mixture and its shares.

    documents(doc_id, source, text), targets(source, target_share,
    max_repeats), each source at most once after its name is evened out (of
    more, the one with the largest share counts). budget is the tokens the
    mixture is to have: by default all tokens of documents.text, of sources in
    targets or not. Each source gets its target_share of it, or as much as
    max_repeats allows. With an entropy, target_share is not used: the budget is
    by default what the sources have, and the weights are the natural shares by
    temperature. Rows with a null doc_id are passed over; documents without a
    source in targets (null ones too) or without tokens are in no mixture;
    repeated rows of a doc_id are one document, the row that is first by source
    and tokens. Empty tables give an empty mixture and shares of 0.

    Returns (mixture: doc_id, source, pass_no, n_tokens, one row for each time
    a document occurs), (shares: source, target_share, max_repeats,
    available_tokens, weight, exponent, mixed_tokens, share_of_budget,
    share_of_mixture, most_repeats, reached). weight is what the source was to
    have of the budget and exponent null without temperature; reached says
    whether the tokens mixed come, within one document, to the target (with an
    entropy, to the weight). The tables made on the way to both are deleted.
    """
    with scratch_scope() as keep:
        wants, times, budget, exponent, goal = _weighed(documents, targets, seed, tokenizer, budget, entropy)
        keep(wants, times)
    rows = times.select("doc_id", "source", F.explode(F.expr("sequence(1, times)")).alias("pass_no"), "n_tokens")
    mixed = times.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("times")).alias("mixed_tokens"), F.max("times").alias("most_repeats"))
    in_mix = mixed.agg(F.sum("mixed_tokens").alias("in_mix"))
    mixed_tokens = F.coalesce("mixed_tokens", F.lit(0))
    shares = wants.join(mixed, "source", "left").crossJoin(F.broadcast(in_mix)).select(  # one row
        "source", "target_share", "max_repeats", "available_tokens", "weight", exponent.alias("exponent"), mixed_tokens.alias("mixed_tokens"), F.coalesce(F.try_divide(mixed_tokens, F.lit(budget)), F.lit(0.0)).alias("share_of_budget"),
        F.when(F.col("in_mix") > 0, mixed_tokens / F.col("in_mix")).otherwise(0.0).alias("share_of_mixture"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"), (mixed_tokens + F.col("largest") >= goal * F.lit(budget)).alias("reached"),
    )
    return rows, shares


def _weighed(documents: DataFrame, targets: DataFrame, seed: int, tokenizer: str, budget: int | None, entropy: float | None) -> tuple[DataFrame, DataFrame, int, Column, Column]:
    """(sources with what they are to have, documents with how often they occur, budget, exponent, goal), the tables written."""
    docs, sources, total = _counted(documents, targets, tokenizer)
    exponent = F.lit(None).cast("double")
    most = F.col("max_repeats") * F.col("available_tokens")
    if entropy is None:
        budget = total if budget is None else budget
        sources = sources.withColumn("weight", F.least(F.col("target_share"), F.coalesce(F.try_divide(most, F.lit(budget)), F.lit(0.0))))
        goal = F.col("target_share")
    else:
        have = sources.filter("max_repeats > 0").agg(F.sum("available_tokens")).first()[0] or 0
        budget = have if budget is None else budget
        e = temperature(sources, entropy, budget)
        exponent = F.lit(e)
        raised = F.when((F.col("available_tokens") > 0) & (F.col("max_repeats") > 0), F.pow(F.col("available_tokens") / F.lit(float(max(have, 1))), F.lit(e))).otherwise(0.0)
        whole = sources.agg(F.sum(raised)).first()[0] or 1.0
        sources = sources.withColumn("weight", raised / F.lit(whole))
        goal = F.col("weight")
    wants = sources.withColumn("want", F.round(F.least(F.col("weight") * F.lit(budget), most.cast("double"))).cast("long"))
    wants = scratch(wants, "wants")
    times = _realised(docs, wants, seed)
    return wants, times, budget, exponent, goal
