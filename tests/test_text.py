from __future__ import annotations

import hashlib
import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from claimloom.functions import text as t
from claimloom.functions.words import words
from claimloom.operators.claims import extract_claims


def test_words():
    assert words("The -39.7 percent, Ｗｉｔｈ 10-20 3.5kg a.b 7. ﬁn") == ["the", "-39.7", "percent", "with", "10", "20", "3.5kg", "a", "b", "7", "fin"]
    assert words(None) == words("") == words(" -- ... ") == []
    assert words("Straße STRASSE") == ["strasse", "strasse"]
    assert words("x --5 .-6") == ["x", "-5", "-6"]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aB1 .-_,\nßé９", max_size=30))
def test_words_by_hand(s):
    s2 = unicodedata.normalize("NFKC", s).casefold()
    out, i = [], 0
    while i < len(s2):
        if s2[i].isalnum() or (s2[i] == "-" and s2[i + 1 : i + 2].isdigit() and not s2[i - 1 : i].isalnum()):
            j = i + 1
            while j < len(s2) and (s2[j].isalnum() or (s2[j] == "." and s2[j - 1].isdigit() and s2[j + 1 : j + 2].isdigit())):
                j += 1
            out.append(s2[i:j])
            i = j
        else:
            i += 1
    assert words(s) == out


def test_ids_and_fingerprints(spark):
    df = spark.createDataFrame([("d1", "The Rate, of 5 tests IS höher!"), ("d2", None)], "id string, text string")
    r = df.select(t.stable_id("doc", "id", F.lit("x")), t.stable_int64("id"), t.fingerprint("text"), t.safe_slug("text")).collect()
    h = hashlib.sha256(b"d1\x1fx").hexdigest()
    assert r[0][0] == "doc_" + h[:24]
    assert r[0][1] == int(hashlib.sha256(b"d1").hexdigest()[:15], 16)
    assert r[0][2] == "rate 5 tests h her" and r[0][3] == "the_rate_of_5_tests_is_h_her"
    assert r[1][2] is None


def test_normalize_and_squeeze(spark):
    df = spark.createDataFrame([("  a\t\tb\r\nc\r\r\n\n\n\nd  e ",), ("",), (None,)], "x string")
    r = [x[0] for x in df.select(t.normalize_text("x")).collect()]
    want = re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", "  a\t\tb\nc\n\n\n\n\nd  e ")).strip()
    assert r == [want, "", None]
    assert df.select(t.squeeze("x")).first()[0] == "a b c d e"
    assert spark.createDataFrame([("ﬁ Ａ",)], "x string").select(t.normalize_text("x", True)).first()[0] == "fi A"


def test_iso_timestamp(spark):
    df = spark.createDataFrame([("2024-01-02T03:04:05Z",), ("2024-01-02T03:04:05+02:00",), ("2024-01-02T03:04:05",), ("no",), (None,)], "x string")
    got = [None if r[0] is None else r[0].hour for r in df.select(t.iso_timestamp("x")).collect()]
    assert got[0] - got[1] == 2 and got[2:] == [None, None, None]


CASES = [
    ("x" * 31, 0), ("The new enzyme shows a clear effect on the rate. ", 1), ("Is the new enzyme really a good catalyst for all tests?", 0),
    ("Copyright notice: all of this is owned by nobody at all here.", 0), ("", 0), (None, 0), ("a" * 300 + " is " + "b" * 300 + ".", 0),
    ("A first line without an end mark is here\nThe second one is a clear statement too", 1),
]


@pytest.mark.parametrize("text,n", CASES)
def test_candidates(spark, text, n):
    df = spark.createDataFrame([("d", "c", text)], "document_id string, chunk_id string, text string")
    assert extract_claims(df, "document_id", "chunk_id", "text").count() == n


def test_claim_offsets(spark):
    text = "Intro?! The enzyme causes a strong decay of the sample.  Later the method was measured with care in 3.5 tests."
    df = spark.createDataFrame([("d", "c", text, 100)], "document_id string, chunk_id string, text string, start int")
    out = sorted(extract_claims(df, "document_id", "chunk_id", "text", "start").collect(), key=lambda r: r["source_start_char"])
    want = []
    for m in re.finditer(r"[^.!?\n]+(?:[.!?]|$)", text):
        s = " ".join(m[0].split())
        if 32 <= len(s) <= 480 and not s.endswith("?") and re.search(r" (is|was|causes) ", f" {s} "):
            want.append((100 + m.start(), 100 + m.start() + len(m[0].strip()), s))
    assert [(r["source_start_char"], r["source_end_char"], r["text"]) for r in out] == want and want
    assert out[0]["claim_type"] == "causal_claim" and out[0]["cue_category"] == "causal"
