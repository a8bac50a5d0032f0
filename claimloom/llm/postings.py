"""A distributed positional inverted index, and passages found in it.

The index is split by document: each segment holds the posting lists of some
million words, term by term, as positions in the segment. Building it needs no
shuffle, and neither does a search, as every document lies whole in one
segment. A passage is found by intersecting offset-adjusted posting lists from
its rarest term on; the lists of a segment lie one after the other in one sorted
array, so that a step of the intersection is made for all passages at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.functions.words import words
from claimloom.session import scratch

PASSAGE = 12
SLOP = 3
#: words of a segment; a longer document makes its segment longer
SEGMENT_WORDS = 1_500_000
#: characters of query texts that are searched for at once
QUERY_CHARS = 16_000_000
#: passages handled in one step
_AT_ONCE = 1 << 16
_SCHEMA = "doc_ids binary, starts binary, terms string, counts binary, postings binary"


class _Segment:
    """A segment being filled."""

    def __init__(self) -> None:
        self.ids: dict[str, int] = {}
        self.doc_ids: list[int] = []
        self.starts: list[int] = []
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, doc_id: int, tokens: list[str]) -> None:
        ids = self.ids
        for t in tokens:
            if t not in ids:
                ids[t] = len(ids)
        self.doc_ids.append(doc_id)
        self.starts.append(self.size)
        self.parts.append(np.fromiter(map(ids.__getitem__, tokens), np.int32, len(tokens)))
        self.size += len(tokens) + 1  # a free place, so that no passage runs on into the next document

    def row(self) -> tuple[bytes, bytes, str, bytes, bytes]:
        at = np.concatenate([np.arange(s, s + len(p), dtype=np.int64) for s, p in zip(self.starts, self.parts)]) if self.parts else np.zeros(0, np.int64)
        term = np.concatenate(self.parts) if self.parts else np.zeros(0, np.int32)
        order = np.argsort(term, kind="stable")
        counts = np.bincount(term, minlength=len(self.ids)).astype("<u4")
        positions = at[order]
        gaps = np.diff(positions, prepend=0)  # within a list each position is kept as its distance from the one before
        firsts = np.cumsum(counts) - counts
        gaps[firsts] = positions[firsts]
        return np.array(self.doc_ids, "<i8").tobytes(), np.array(self.starts, "<u8").tobytes(), "\n".join(self.ids), counts.tobytes(), gaps.astype("<u4" if self.size < 2**32 else "<u8").tobytes()


def build_index(documents: DataFrame, segment_words: int = SEGMENT_WORDS) -> DataFrame:
    """The index of documents(doc_id, text), written to the shared folder.

    Every word of every text is in it. Rows with a null doc_id or text are
    passed over; a text without words has no postings; repeated rows are
    indexed again and found once. Other columns are ignored.
    """

    def segments(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seg = _Segment()
        for pdf in it:
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                seg.add(doc_id, words(text))
                if seg.size >= segment_words:
                    yield pd.DataFrame([seg.row()], columns=_COLUMNS)
                    seg = _Segment()
        if seg.doc_ids:
            yield pd.DataFrame([seg.row()], columns=_COLUMNS)

    own = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null and text is not null")
    return scratch(own.mapInPandas(segments, _SCHEMA), "index")


_COLUMNS = [c.split()[0] for c in _SCHEMA.split(", ")]


class _Opened:
    """A segment being read. keys holds every posting as term * stride + position, in order."""

    def __init__(self, doc_ids: bytes, starts: bytes, terms: str, counts: bytes, postings: bytes, margin: int) -> None:
        self.doc_ids, self.starts = np.frombuffer(doc_ids, "<i8"), np.frombuffer(starts, "<u8").astype(np.int64)
        self.counts = np.frombuffer(counts, "<u4").astype(np.int64)
        self.firsts = np.cumsum(self.counts) - self.counts
        self.ids = {t: i for i, t in enumerate(terms.split("\n"))} if len(self.counts) else {}
        gaps = np.frombuffer(postings, "<u4" if len(postings) == 4 * self.counts.sum() else "<u8").astype(np.int64)
        summed = np.cumsum(gaps)
        self.positions = summed - np.repeat(summed[self.firsts] - gaps[self.firsts], self.counts)
        self.stride = int(self.positions.max(initial=0)) + margin + 1  # wider than any place a passage can reach
        self.keys = np.repeat(np.arange(len(self.counts)), self.counts) * self.stride + self.positions

    def held(self, term: np.ndarray, position: np.ndarray) -> np.ndarray:
        """Whether each term's list has the position."""
        keys = term * self.stride + position
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        return self.keys[at] == keys

    def between(self, term: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The part of each term's list from low to before high."""
        return np.searchsorted(self.keys, term * self.stride + np.maximum(low, 0)), np.searchsorted(self.keys, term * self.stride + high)

    def place(self, positions: np.ndarray) -> np.ndarray:
        """The documents the positions are in, by their place in the segment."""
        return np.searchsorted(self.starts, positions, "right") - 1


@dataclass
class _Block:
    """Query texts: their vocabulary, the words of all of them as numbers of it, and the items and places of their passages of n words."""

    vocabulary: list[str]
    flat: np.ndarray
    items: np.ndarray
    windows: np.ndarray


def _block(texts: list[tuple[int, list[str]]], n: int) -> _Block:
    ids: dict[str, int] = {}
    flat, items, windows, size = [], [], [], 0
    for item_id, tokens in texts:
        if len(tokens) >= n:
            flat.append(np.fromiter((ids.setdefault(t, len(ids)) for t in tokens), np.int32, len(tokens)))
            windows.append(np.arange(size, size + len(tokens) - n + 1))
            items.append(np.full(len(tokens) - n + 1, item_id, np.int64))
            size += len(tokens)
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    return _Block(list(ids), join(flat, np.int32), join(items, np.int64), join(windows, np.int64))


def _meetings(seg: _Opened, block: _Block, n: int, slop: int | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Some passages at a time that the segment holds: (number of the passage, its terms from the rarest on, the rarest term's position).

    Without slop every term stands at its own distance from the rarest, so that
    the passage is there; with slop each stands near enough to it.
    """
    term_of = np.fromiter((seg.ids.get(t, -1) for t in block.vocabulary), np.int64, len(block.vocabulary))
    count_of = np.where(term_of >= 0, seg.counts[np.maximum(term_of, 0)], 0)
    known = count_of[block.flat]
    whole = np.flatnonzero(sliding_window_view(known, n)[block.windows].min(axis=1) > 0)  # passages whose terms the segment has, all of them
    for part in np.array_split(whole, max(1, len(whole) // _AT_ONCE)):
        terms = block.flat[block.windows[part][:, None] + np.arange(n)]
        order = np.argsort(count_of[terms], axis=1, kind="stable")
        terms = term_of[np.take_along_axis(terms, order, axis=1)]
        size = seg.counts[terms[:, 0]]
        ends = np.cumsum(size)
        cuts = np.searchsorted(ends, np.arange(_AT_ONCE * 16, ends[-1] if len(ends) else 0, _AT_ONCE * 16))
        for rows in np.split(np.arange(len(part)), cuts):
            if not len(rows):
                continue
            row = np.repeat(rows, size[rows])
            nth = np.arange(len(row)) - np.repeat(np.cumsum(size[rows]) - size[rows], size[rows])
            at = seg.positions[seg.firsts[terms[row, 0]] + nth]
            if slop is None:
                inside = at >= order[row, 0]
                row, at = row[inside], at[inside]
            for j in range(1, n):
                if slop is None:
                    ok = seg.held(terms[row, j], at - order[row, 0] + order[row, j])
                else:
                    lo, hi = seg.between(terms[row, j], at - n - slop + 1, at + n + slop)
                    ok = hi > lo
                row, at = row[ok], at[ok]
                if not len(row):
                    break
            if len(row):
                yield part[row], terms[row], at


def _close(seg: _Opened, terms: np.ndarray, at: int, span: int) -> bool:
    """Whether all the terms stand within span words that hold the position, in one document."""
    distinct = np.unique(terms)
    lo, hi = seg.between(distinct, np.full(len(distinct), at - span + 1), np.full(len(distinct), at + span))
    near = np.concatenate([np.stack([seg.positions[a:b], np.full(b - a, t)], axis=1) for a, b, t in zip(lo, hi, distinct)])
    near = near[seg.place(near[:, 0]) == seg.place(np.array([at]))[0]]
    return any(len(set(near[(near[:, 0] >= first) & (near[:, 0] < first + span), 1].tolist())) == len(distinct) for first in np.unique(near[:, 0]) if first <= at < first + span)


def find_passages(index: DataFrame, items: DataFrame, n: int = PASSAGE, slop: int | None = None, query_chars: int = QUERY_CHARS) -> DataFrame:
    """The documents of the index that hold n or more consecutive words of an item.

    items(item_id, item_text) are a stated set of queries. They are read in
    blocks of query_chars characters (and one text), each searched for in every
    segment by a job of its own whose results are written, so that the driver
    holds one block at a time, however many there are. Items of fewer than n
    words, with a null id or text, are found nowhere; a document and item come
    once. With slop, the words of some n in a row need only stand within n +
    slop words, in any order.

    Returns doc_id, item_id.
    """
    spark = index.sparkSession
    own = items.select(F.col("item_id").cast("long").alias("item_id"), "item_text").filter("item_id is not null and item_text is not null")
    parts = []
    for texts in _blocks(own, query_chars):
        sent = spark.sparkContext.broadcast(_block(texts, n))  # query_chars characters
        parts.append(scratch(index.mapInPandas(_searcher(sent, n, slop), "doc_id long, item_id long"), "passages"))
        sent.destroy()
    if not parts:
        return spark.createDataFrame([], "doc_id long, item_id long")
    return reduce(DataFrame.unionByName, parts).distinct()


def _blocks(items: DataFrame, chars: int) -> Iterator[list[tuple[int, list[str]]]]:
    block, size = [], 0
    for item_id, text in items.toLocalIterator():
        block.append((item_id, words(text)))
        size += len(text)
        if size >= chars:
            yield block
            block, size = [], 0
    if block:
        yield block


def _searcher(sent, n: int, slop: int | None):
    def search(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block = sent.value
        for pdf in it:
            for row in pdf[_COLUMNS].itertuples(index=False):
                seg = _Opened(*row, margin=2 * (n + (slop or 0)))
                if not seg.ids or not len(block.windows):
                    continue
                pairs = [np.zeros((0, 2), np.int64)]
                for passage, terms, at in _meetings(seg, block, n, slop):
                    if slop is not None:
                        kept = np.fromiter((_close(seg, t, a, n + slop) for t, a in zip(terms, at)), bool, len(at))
                        passage, at = passage[kept], at[kept]
                    pairs.append(np.stack([seg.doc_ids[seg.place(at)], block.items[passage]], axis=1))
                found = np.unique(np.concatenate(pairs), axis=0)
                yield pd.DataFrame({"doc_id": found[:, 0], "item_id": found[:, 1]})

    return search
