"""Text functions as column expressions: ids, fingerprints, overlap, sentences.

All stay in the JVM but nfkc() and placed_sentences(), for which Spark has no
expression, or none that takes linear time. A null
argument gives a null result unless said otherwise.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words that fingerprints leave out.
STOPWORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "with")
# Fixed value: what ends a sentence; a line without an end mark counts only at the end of the text.
SENTENCE = r"[^.!?\n]+(?:[.!?]|(?=\n?\z))"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


@F.pandas_udf(T.StringType())
def nfkc(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in it:
        yield s.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


def normalize_text(text: Column | str, unicode_form: bool = False) -> Column:
    """Line ends to LF, runs of blanks and tabs to one blank, three or more line ends to two, outer white space off; with unicode_form after NFKC."""
    c = nfkc(_c(text)) if unicode_form else _c(text)
    c = F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    c = F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), r"\n{3,}", "\n\n")
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def squeeze(text: Column | str) -> Column:
    """All white space to single blanks, none at the ends."""
    return F.trim(F.regexp_replace(_c(text), r"(?U)\s+", " "))


def fold(text: Column | str) -> Column:
    return F.lower(F.replace(_c(text), F.lit("ß"), F.lit("ss")))


def fingerprint_tokens(text: Column | str) -> Column:
    """The runs of a-z and 0-9 of the folded text that are no stopwords, in order."""
    stop = F.array(*[F.lit(w) for w in STOPWORDS])
    return F.filter(F.regexp_extract_all(fold(text), F.lit("[a-z0-9]+"), F.lit(0)), lambda t: ~F.array_contains(stop, t))


def fingerprint(text: Column | str) -> Column:
    return F.array_join(fingerprint_tokens(text), " ")


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Overlap of two arrays as sets: shared over all; 1 if both are empty, 0 if one is."""
    a, b = _c(a), _c(b)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def stable_hash(*parts: Column | str, length: int = 24) -> Column:
    """Hex digits of the SHA-256 of the parts, joined by the unit separator."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *[_c(p).cast("string") for p in parts]), 256), 1, length)


def stable_id(prefix: str, *parts: Column | str, length: int = 24) -> Column:
    return F.concat(F.lit(prefix + "_"), stable_hash(*parts, length=length))


def stable_int64(*parts: Column | str) -> Column:
    """A positive 60-bit number from the same hash."""
    return F.conv(stable_hash(*parts, length=15), 16, 10).cast("bigint")


def safe_slug(text: Column | str, longest: int = 48) -> Column:
    """Letters a-z and digits joined by underscores, cut; `unknown` if none."""
    s = F.substring(F.array_join(F.regexp_extract_all(fold(text), F.lit("[a-z0-9]+"), F.lit(0)), "_"), 1, longest)
    return F.when(s == "", "unknown").otherwise(s)


def sentences(text: Column | str) -> Column:
    return F.regexp_extract_all(_c(text), F.lit(SENTENCE), F.lit(0))


_PLACED = re.compile(SENTENCE.replace(r"\z", r"\Z"))


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("i", T.IntegerType()), T.StructField("p", T.IntegerType()), T.StructField("raw", T.StringType())])))
def placed_sentences(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The sentences of a text with their number and the place they begin at, in one pass over it."""
    for s in it:
        yield s.map(lambda x: None if x is None else [{"i": i, "p": m.start(), "raw": m[0]} for i, m in enumerate(_PLACED.finditer(x))])


def iso_timestamp(text: Column | str) -> Column:
    """Instant of an ISO time with a zone; null for one without, or none."""
    c = _c(text)
    return F.when(c.rlike(r"(Z|[+-]\d\d:?\d\d)$"), F.try_to_timestamp(c))


def contains_any(text: Column, cues: tuple[str, ...]) -> Column:
    out = F.contains(text, F.lit(cues[0]))
    for cue in cues[1:]:
        out = out | F.contains(text, F.lit(cue))
    return out


def scaled(x: Column | str) -> Column:
    """sign(x) log(1 + |x|) / 32; nan counts as 0, infinities as +-1 before."""
    c = F.nanvl(_c(x).cast("double"), F.lit(0.0))
    c = F.when(c == float("inf"), 1.0).when(c == float("-inf"), -1.0).otherwise(c)
    return F.signum(c) * F.log1p(F.abs(c)) / 32


def mean_rounded(x: Column | str, digits_in: int, digits_out: int) -> Column:
    """Mean of numbers of so many decimals, rounded half up; summed as integers, so that the order of rows doesn't matter. Null without any."""
    c = _c(x)
    total = F.sum(F.round(c * 10**digits_in).cast("bigint"))
    n = F.count(c)
    return F.floor((total * (2 * 10 ** (digits_out - digits_in)) + n) / (n * 2)) / float(10**digits_out)
