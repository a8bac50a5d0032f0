"""Splitting oversized texts at natural boundaries.

Each position of a text has a boundary strength. A sparse table answers which
position of a window is strongest, the rightmost of equals; the text is cut
there, and the next piece starts the overlap before the cut.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 1200, 120

_HEADING = re.compile(r"^[ \t]{0,3}(#{1,6})[ \t]+(.*?)[ \t#]*$", re.M)
#: strength and the places it holds at: the end of each match
_PLACES = (
    (1, re.compile(r"\s+")),
    (2, re.compile(r"[,;:|)\]}、，；：]\s*")),
    (3, re.compile(r"[.!?…。！？]+[\"'”»)\]]*\s+|[。！？]")),
    (4, re.compile(r"\r\n|\n|\r")),
    (5, re.compile(r"(?:\r\n|\n|\r)[ \t]*(?:\r\n|\n|\r)\s*")),
)
_BEFORE_HEADING = 6


def strengths(text: str) -> np.ndarray:
    """For each place 0..len(text), how natural a cut before that character is; -1 inside a character of several code points."""
    out = np.zeros(len(text) + 1, np.int8)
    for level, pattern in _PLACES:
        at = [m.end() for m in pattern.finditer(text)]
        out[at] = level
    out[[m.start() for m in _HEADING.finditer(text)]] = _BEFORE_HEADING
    if not text.isascii():
        out[[i for i, ch in enumerate(text) if ch > "˿" and unicodedata.combining(ch)]] = -1
    if "\r\n" in text:
        out[[m.start() + 1 for m in re.finditer("\r\n", text)]] = -1
    return out


class RangeMaximum:
    """A sparse table over values: the place of the largest value of a range, the rightmost of equals."""

    def __init__(self, values: np.ndarray, widest: int) -> None:
        self.values = values
        self.levels = [np.arange(len(values))]
        while 2 << (len(self.levels) - 1) <= min(widest, len(values)):
            last, half = self.levels[-1], 1 << (len(self.levels) - 1)
            a, b = last[:-half], last[half:]
            self.levels.append(np.where(values[b] >= values[a], b, a))

    def query(self, lo: int, hi: int) -> int:
        """The place within lo..hi, both included."""
        k = (hi - lo + 1).bit_length() - 1
        a, b = self.levels[k][lo], self.levels[k][hi - (1 << k) + 1]
        return int(b if self.values[b] >= self.values[a] else a)


def cut(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Pieces of text as (start, end), each at most limit long and starting overlap before the end of the one before."""
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be less than limit")
    if len(text) <= limit:
        return [(0, len(text))]
    least = max(overlap + 1, limit // 2)  # so that every piece goes on, and none is a scrap where a later boundary will do
    table = RangeMaximum(strengths(text), limit - overlap)
    out, start = [], 0
    while len(text) - start > limit:
        at = table.query(start + least, start + limit)
        if table.values[at] <= 0:  # no boundary: an earlier one keeps what is unbroken whole
            early = table.query(start + overlap + 1, start + limit)
            at = early if table.values[early] > 0 else at
        out.append((start, at))
        start = at - overlap
    out.append((start, len(text)))
    return out


def headings(text: str) -> list[tuple[int, int, str]]:
    """Place, level and title of each heading line."""
    return [(m.start(), len(m[1]), m[2].strip()) for m in _HEADING.finditer(text)]


def path_at(base: list[str], found: list[tuple[int, int, str]], place: int) -> list[str]:
    """The section path at a place: the text's own path with the headings before the place on it.

    A heading of level n replaces all from depth n on.
    """
    path = list(base)
    for at, level, title in found:
        if at > place:
            break
        path = [*path[: level - 1], title]
    return path


def split_oversized(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, keep_fitting: bool = False) -> DataFrame:
    """Pieces of the chunks longer than limit code points.

    chunks(chunk_id, text, start_char, section_path). Rows with a null
    chunk_id or text are passed over. Repeated rows of a chunk_id are one
    chunk, the row that is first by text and start_char. A null start_char
    leaves the pieces' offsets null; a null section_path counts as empty.
    Texts within the limit give one piece if keep_fitting, else none. Other
    columns are ignored. The section path of a piece takes up the headings
    inside the chunk that stand before the piece's new text.

    Returns chunk_id, piece_index, text, start_char, end_char, section_path.
    Only long texts reach Python; each is cut on its own, so nothing is
    gathered beyond one text.
    """
    own = chunks.select("chunk_id", "text", F.col("start_char").cast("long"), F.coalesce("section_path", F.array().cast("array<string>")).alias("section_path"))
    own = own.filter("chunk_id is not null and text is not null")
    if not keep_fitting:
        own = own.filter(F.length("text") > limit)
    one = own.groupBy("chunk_id").agg(F.min(F.struct("text", F.col("start_char"), "section_path")).alias("c")).select("chunk_id", "c.*")

    def pieces(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = []
            for cid, text, at, path in zip(pdf["chunk_id"], pdf["text"], pdf["start_char"], pdf["section_path"]):
                found = headings(text)
                base = [] if path is None else list(path)
                for i, (a, b) in enumerate(cut(text, limit, overlap)):
                    new = a if i == 0 else a + overlap
                    none = at is None or at != at
                    rows.append((cid, i, text[a:b], None if none else int(at) + a, None if none else int(at) + b, path_at(base, found, new)))
            out = pd.DataFrame(rows, columns=["chunk_id", "piece_index", "text", "start_char", "end_char", "section_path"])
            yield out.astype({"piece_index": "int32", "start_char": "Int64", "end_char": "Int64"})

    return one.mapInPandas(pieces, "chunk_id string, piece_index int, text string, start_char long, end_char long, section_path array<string>")
