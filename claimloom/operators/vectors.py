"""Nearest neighbours of a stated set of queries among all rows, exactly."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from claimloom.session import scratch

QUERIES_AT_ONCE = 4096


def _best_of(ids: np.ndarray, unit: np.ndarray, keys: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, key, similarity) of the k rows most similar to each query, of equals the smaller key, itself left out."""
    sims = unit @ rows.T
    sims[ids[:, None] == keys[None, :]] = -np.inf
    rounded = np.round(sims, 12)
    at = min(k, len(keys))
    edge = -np.partition(-rounded, at - 1, axis=1)[:, at - 1]  # the k-th similarity of each query; its equals are all kept
    q, j = np.nonzero((rounded >= edge[:, None]) & np.isfinite(rounded))
    order = np.lexsort((keys[j], -rounded[q, j], q))
    q, j = q[order], j[order]
    place = np.arange(len(q)) - np.searchsorted(q, q)
    return ids[q[place < k]], keys[j[place < k]], sims[q, j][place < k]


def nearest(rows: DataFrame, queries: DataFrame, key: str, vector: str, k: int, at_once: int = QUERIES_AT_ONCE) -> DataFrame:
    """query, neighbour, similarity, rank: the k rows most similar by cosine to each query, itself left out, of equals the smaller key.

    Queries, a stated set, go out in blocks of at most at_once vectors, each
    searched for by a job of its own whose results are written, so that the
    driver holds one block at a time. Each task keeps its own k best for each
    query, so the shuffle holds k rows for each query and task. Null and zero
    vectors are similar to nothing.
    """
    spark = rows.sparkSession
    own = queries.select(key, vector).filter(F.col(vector).isNotNull()).dropDuplicates([key])
    schema = "query long, neighbour long, similarity double"

    def search(sent):
        def best(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, unit = sent.value
            kept = None
            for pdf in it:
                pdf = pdf[pdf[vector].notna()]
                if not len(pdf):
                    continue
                x = np.stack(pdf[vector].to_numpy()).astype(np.float64)
                norm = np.linalg.norm(x, axis=1)
                x, keys = x[norm > 0] / norm[norm > 0, None], pdf[key].to_numpy()[norm > 0]
                if not len(keys):
                    continue
                new = pd.DataFrame(dict(zip(("query", "neighbour", "similarity"), _best_of(ids, unit, keys, x, k))))
                kept = new if kept is None else pd.concat([kept, new])
                kept = kept.sort_values(["query", "similarity", "neighbour"], ascending=[True, False, True]).groupby("query").head(k)
            if kept is not None:
                yield kept

        return best

    parts, block = [], []

    def flush() -> None:
        unit = np.array([c[1] for c in block], np.float64)
        unit /= np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-300)
        sent = spark.sparkContext.broadcast((np.array([c[0] for c in block]), unit))  # at_once vectors
        found = rows.select(key, vector).mapInPandas(search(sent), schema)
        w = W.partitionBy("query").orderBy(F.desc(F.round("similarity", 9)), "neighbour")  # k rows a task
        parts.append(scratch(found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k), "nearest"))
        sent.destroy()
        block.clear()

    for r in own.toLocalIterator():
        block.append((r[0], r[1]))
        if len(block) == at_once:
            flush()
    if block:
        flush()
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], f"{schema}, rank int")
