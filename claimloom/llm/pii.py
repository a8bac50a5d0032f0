"""Personal information in free text, by bootstrapped contextual extraction.

One pass over the texts proposes candidates: e-mail shapes, number-like runs
with their shapes, runs with a street, and pairs of capitalised words, each
with the words beside it. Seed entities (known name parts, labels such as
`passport` or `tel`, street words) give the first scores; then patterns and
instances score each other in rounds over their aggregated graph: a pattern is
worth what it extracts and must extract several different instances, an
instance what extracts it. Confident patterns thus find name parts, number
shapes and places that no seed names.

Scale: the graph holds counts per pattern and instance, combined before the
shuffle. Verdicts are made on distinct contexts and instances, not occurrences,
and joined back to the occurrences on the whole context, where AQE splits what
is hot. Texts are read once.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimloom.session import scratch, scratch_scope

ROUNDS = 3
CONFIDENT = 0.5
#: A pattern counts when it was seen so often; else a shorter one stands in for it.
LEAST_SEEN = 3

# Labels that stand before numbers, and words of streets.
PHONE_LABELS = ("tel", "tél", "phone", "telephone", "telefon", "téléphone", "teléfono", "mobile", "fax")
IDENTITY_LABELS = ("passport", "passeport", "ssn", "dni", "identity", "identité", "ausweis", "id", "nie", "nif", "tin")
STREET_WORDS = ("street", "lane", "road", "rd", "avenue", "ave", "drive", "square", "rue", "calle", "avenida", "plaza", "via", "box")
STREET_ENDINGS = ("weg", "straat", "strasse", "straße", "gasse", "platz", "allee", "laan")


def _ranges(categories: tuple[str, ...]) -> str:
    """The characters of the Unicode categories as ranges of a pattern's class."""
    out: list[list[int]] = []
    for c in range(0x10000):
        if unicodedata.category(chr(c)) in categories:
            if out and out[-1][1] == c - 1:
                out[-1][1] = c
            else:
                out.append([c, c])
    return "".join(chr(a) if a == b else f"{chr(a)}-{chr(b)}" for a, b in out)


_UP = _ranges(("Lu", "Lt"))
_LETTERS = r"(?:[^\W\d_]|[’'])"
_CAP = rf"[{_UP}]{_LETTERS}+(?:-(?:[a-z]{{1,3}}-)?[{_UP}]{_LETTERS}+)*(?![\w])"
_AT = r"(?: ?[@＠] ?| ?(?:\[at\]|\(at\)|\{at\}) ?| AT )"
_DOT = r"(?:\.| ?(?:\[dot\]|\(dot\)|\{dot\}) ?| DOT )"
_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
EMAIL = re.compile(rf"(?<![\w.+%-])[A-Za-z0-9][\w.+%-]*{_AT}{_LABEL}(?:{_DOT}{_LABEL})*{_DOT}[A-Za-z]{{2,}}(?![\w-])")
EMAIL_IN_WORDS = re.compile(rf"(?<![\w.+%-])[A-Za-z0-9][\w.+%-]* at {_LABEL}(?: dot {_LABEL})* dot [A-Za-z]{{2,}}(?![\w-])")
_SIGNED = re.compile(r"[@＠]|[\[({]at[\])}]| AT ")
_SIGN = re.compile(rf"{_AT}| at ")
_POINT = re.compile(r" ?(?:\[dot\]|\(dot\)|\{dot\}) ?| DOT | dot ")
_LABELS = frozenset(PHONE_LABELS + IDENTITY_LABELS)
_APART = str.maketrans(dict.fromkeys(".:#|(\t\n", " "))
NUMBER = re.compile(
    r"(?<![\w@.+/,=&?#-])(?:"
    r"(?:\+|\(\+?)?\d+(?:(?:[ .-]|\) ?| ?/ ?| ?\()\d+)*(?:-[A-Z](?!\w))?(?: ?(?:ext|Ext|EXT|x)\.? ?\d+)?"
    r"|[A-Z]{1,3}\d{5,}[A-Z]?|[A-Z]{1,3}(?: \d{2,4}){2,5} [A-Z](?!\w)"
    r")(?![\w@/]|[.,-]\d)"
)
#: Numbers of fewer digits are proposed only where a label stands before them.
_LEAST_DIGITS = 4
_BLANK = r"[ \xa0]"
_INITIALS = rf"(?:[{_UP}]\.{_BLANK}?)+"
NAME = re.compile(rf"(?<![\w’'-])(?=({_CAP})(,?){_BLANK}(?:({_INITIALS}))?({_CAP})|({_INITIALS})({_CAP}))")
#: The initials may stand after the family name; the word after them, if any, may be the family name they belong to instead.
NAME_BEFORE_INITIALS = re.compile(rf"(?<![\w’'-])(?=({_CAP}),?{_BLANK}({_INITIALS})({_CAP})?)")
HAS_INITIAL = re.compile(rf"\.(?<=[{_UP}]\.)")
_PLACE = rf"{_CAP}(?: {_CAP}){{0,2}}"
ADDRESS = re.compile(
    rf"(?<![\w’'-])(?:(?:Flat|Apt\.?|Apartment|Unit|Suite|Room) \d+[A-Z]?, )?"
    rf"(?:(?P<box>P\.? ?O\.? ?Box) \d+|\d{{1,4}}[A-Za-z]?,? (?P<pre>(?:[a-zà-ÿ]+ )(?:(?:de|du|des|la|del) )*)?(?P<mid>{_CAP}(?: {_CAP}){{0,2}}\.?)|(?P<lead>{_CAP} )?(?P<word>{_CAP}) \d{{1,4}}[A-Za-z]?(?:-\d{{1,4}})?)"
    rf"(?:, ?|,?[ \t]*\r?\n[ \t]*)(?:(?P<code1>\d{{4,6}}) (?P<place1>{_PLACE})|(?P<place2>{_PLACE}?) (?P<code2>\d{{4,6}})(?!\w)|(?P<place3>{_PLACE}))"
)
_SIDE = re.compile(r"[^\W\d_]+|\d[\d .()/+-]*|[;|]|\n")
_SCHEMA = "doc_id long, kind string, start int, stop int, form string, a string, b string, l1 string, l2 string, r1 string, r2 string, label string, low_a boolean, low_b boolean"
_COLUMNS = [c.split()[0] for c in _SCHEMA.split(", ")]


def _norm(word: str) -> str:
    return word.casefold() if word.isascii() else unicodedata.normalize("NFKC", word).casefold()


def shape(number: str) -> str:
    """A number's shape: 9 for a digit, A for a capital; an extension is x."""
    number = re.sub(r" ?(?:ext|Ext|EXT|x)\.? ?\d+$", "x", number)
    return re.sub(r"[A-Z]", "A", re.sub(r"\d", "9", number))


def _sides(text: str, start: int, stop: int) -> tuple[str, str, str, str, list[str]]:
    left = ["#" if w[0].isdigit() else w for w in _SIDE.findall(_norm(text[max(0, start - 60) : start]))[-3:]]
    right = ["#" if w[0].isdigit() else w for w in _SIDE.findall(_norm(text[stop : stop + 40]))[:2]]
    l1, r1 = left[-1] if left else "^", right[0] if right else "$"
    l2 = " ".join(left[-2:]) if left else "^"
    return l1, l2, r1, " ".join(right) if right else "$", left


def _label(left: list[str]) -> str | None:
    for w in reversed(left):
        if w in PHONE_LABELS:
            return "phone"
        if w in IDENTITY_LABELS:
            return "identity"
        if w in "#;|\n":
            return None
    return None


def written_as(address: str) -> tuple[str, str]:
    """How an e-mail address is written out (what stands for the sign and for the points), and its domain in plain form."""
    m = _SIGN.search(address)
    domain = address[m.end() :]
    point = _POINT.search(domain)
    return m[0].replace("＠", "@") + (point[0] if point else "."), _norm(_POINT.sub(".", domain))


def street_type(m: re.Match) -> str:
    """The word that tells what kind of street a match has."""
    if m["box"]:
        return "box"
    if m["pre"]:
        return _norm(m["pre"].split()[0])
    if m["mid"]:
        return _norm(m["mid"].split()[-1].rstrip("."))
    if m["lead"] and _norm(m["lead"].strip()) in STREET_WORDS:
        return _norm(m["lead"].strip())
    word = _norm(m["word"])
    return next((e for e in STREET_ENDINGS if word.endswith(e)), "-" + word[-4:])


def emails_in(text: str) -> list[re.Pattern]:
    """The patterns of e-mail addresses that a text can have a match of at all."""
    return [EMAIL] * bool(_SIGNED.search(text)) + [EMAIL_IN_WORDS] * (" at " in text and " dot " in text)


def candidates(doc_id: int, text: str) -> Iterator[tuple]:
    """All candidates of a text, in the columns of _SCHEMA."""
    taken: list[tuple[int, int]] = []
    for pattern in emails_in(text):
        for m in pattern.finditer(text):
            if not any(m.start() < y and x < m.end() for x, y in taken):
                taken.append(m.span())
                form, domain = written_as(m[0])
                yield doc_id, "email", m.start(), m.end(), "", form, domain, "", "", "", "", None, False, False
    for m in NUMBER.finditer(text):
        a, b = m.span()
        if any(a < y and x < b for x, y in taken):
            continue
        few = b - a < _LEAST_DIGITS or sum(map(str.isdigit, m[0])) < _LEAST_DIGITS
        if few and _LABELS.isdisjoint(text[max(0, a - 24) : a].casefold().translate(_APART).split()):
            continue
        l1, l2, r1, r2, left = _sides(text, a, b)
        label = _label(left)
        if label or not few:
            yield doc_id, "number", a, b, "", shape(m[0]), "", l1, l2, r1, r2, label, False, False
    for m in ADDRESS.finditer(text):
        start = m.start()
        kind = street_type(m)
        if m["lead"] and kind not in STREET_WORDS:
            start = m.start("word")
        code = m["code1"] or m["code2"]
        place = m["place1"] or m["place2"] or m["place3"]
        at = m.start("place1") if m["place1"] else m.start("place2") if m["place2"] else m.start("place3")
        l1, l2, *_ = _sides(text, start, m.end())
        if m["place2"]:
            yield doc_id, "address", start, m.end(), "closed", kind, _norm(place), l1, l2, "", "", code, False, False
        else:
            parts = place.split(" ")
            for k in range(1, len(parts) + 1):  # how many of the capitalised words belong to the place is for the scores to tell
                p = " ".join(parts[:k])
                yield doc_id, "address", start, at + len(p), "coded" if code else "bare", kind, _norm(p), l1, l2, "", "", code, False, False
    for m in NAME.finditer(text):
        w1, comma, initials, w2, before, alone = m.groups()
        if before:
            stop, form, a, b = m.end(6), "if", "", alone
        else:
            stop = m.end(4)
            form, a, b = ("fg", w2, w1) if comma else ("gf", w1, w2)
        yield _name(doc_id, text, m.start(), stop, form, a, b, None)
    if HAS_INITIAL.search(text):
        for m in NAME_BEFORE_INITIALS.finditer(text):
            yield _name(doc_id, text, m.start(), m.start(2) + len(m[2].rstrip()), "fi", "", m[1], m[3])


def _name(doc_id: int, text: str, start: int, stop: int, form: str, a: str, b: str, after: str | None) -> tuple:
    l1, l2, r1, r2, _ = _sides(text, start, stop)
    a, b = _norm(a), _norm(b).split("-")[0]
    return doc_id, "name", start, stop, form, a, b, l1, l2, r1, r2, after and _norm(after).split("-")[0], bool(a) and f" {a} " in text, f" {b} " in text


def propose(documents: DataFrame) -> DataFrame:
    """The candidates of documents(doc_id, text), written. Whole texts are read; null ids and texts have none."""

    def make(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = [r for d, t in zip(pdf["doc_id"], pdf["text"]) for r in candidates(d, t)]
            yield pd.DataFrame(rows, columns=_COLUMNS).astype({"start": "int32", "stop": "int32", "doc_id": "int64"})

    own = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null and text is not null")
    return scratch(own.mapInPandas(make, _SCHEMA), "candidates")


# E-mail addresses


def _emails(found: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """E-mail addresses: ways of writing and domains score each other, from the sign itself and its bracketed stand-ins on.

    What only looks like one (`at` and `dot` as words) needs a domain that is
    known from elsewhere, or a way of writing that most often has such domains.
    """
    rows = found.filter("kind = 'email'").select("doc_id", "start", "stop", F.col("a").alias("form"), F.col("b").alias("domain"))
    edges = scratch(rows.groupBy("form", "domain").agg(F.count(F.lit(1)).cast("double").alias("n")), "edges")
    seeds = edges.select("form").distinct().filter(F.col("form").rlike(r"[@\[({]")).withColumn("score", F.lit(1.0))
    forms = domains = seeds
    for _ in range(rounds):
        domains = scratch(edges.join(forms.filter(F.col("score") >= CONFIDENT), "form").select("domain").distinct().withColumn("sure", F.lit(1.0)), "domains")
        seen = edges.join(domains, "domain", "left")
        learned = seen.groupBy("form").agg((F.sum(F.col("n") * F.coalesce("sure", F.lit(0.0))) / F.sum("n") * F.when(F.count("sure") >= 2, 1.0).otherwise(0.0)).alias("score"))
        forms = scratch(learned.unionByName(seeds).groupBy("form").agg(F.max("score").alias("score")), "forms")
    sure = edges.join(forms, "form").join(domains, "domain", "left").filter((F.col("score") >= CONFIDENT) | F.col("sure").isNotNull()).select("form", "domain")
    return rows.join(sure, ["form", "domain"], "left_semi").select("doc_id", F.lit("email").alias("pii_kind"), "start", "stop")


# Names


def _lone() -> Column:
    """Whether a candidate has initials in place of a given name."""
    return F.col("form").isin("if", "fi")


def score_names(found: DataFrame, known: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """word, role (given or family), score of name parts, from seeds known(word, role)."""
    names = found.filter("kind = 'name'")
    edges = scratch(
        names.groupBy("form", "a", "b", F.concat_ws(" ", "form", F.lit("l"), "l2").alias("lp"), F.concat_ws(" ", "form", F.lit("r"), "r2").alias("rp"))
        .agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(F.col("low_a").cast("double")).alias("na"), F.sum(F.col("low_b").cast("double")).alias("nb")),
        "edges",
    )
    seeds = scratch(known.groupBy("word", "role").agg(F.lit(1.0).alias("score")), "seeds")
    scores = seeds
    for _ in range(rounds):
        given = scores.filter("role = 'given'").select(F.col("word").alias("a"), F.col("score").alias("g"))
        family = scores.filter("role = 'family'").select(F.col("word").alias("b"), F.col("score").alias("f"))
        scored = edges.join(given.hint("merge"), "a", "left").join(family.hint("merge"), "b", "left").fillna(0.0, ["g", "f"])
        scored = scratch(scored.withColumn("c", F.when(_lone(), 0.0).otherwise(F.col("g") * F.col("f"))), "scored")
        # a pattern is worth the part of what it extracts that is confident, once that is more than one name
        sides = scored.select(F.explode(F.array("lp", "rp")).alias("p"), "a", "b", "n", "c")
        per_pair = sides.groupBy("p", "a", "b").agg(F.sum("n").alias("n"), F.max("c").alias("c"))
        patterns = per_pair.groupBy("p").agg((F.sum(F.col("n") * F.col("c")) / F.sum("n")).alias("w"), F.count(F.when(F.col("c") >= CONFIDENT, 1)).alias("k"), F.sum("n").alias("seen"))
        patterns = patterns.filter((F.col("k") >= 2) | ((F.col("k") == 0) & (F.col("seen") >= LEAST_SEEN)))
        patterns = scratch(patterns.select("p", F.when(F.col("k") >= 2, F.col("w")).otherwise(0.0).alias("w"), (F.col("k") == 0).cast("double").alias("against")), "patterns")
        side = lambda c, s: patterns.select(F.col("p").alias(c), F.col("w").alias(f"w{s}"), F.col("against").alias(f"x{s}"))
        both = scored.join(side("lp", "l").hint("merge"), "lp", "left").join(side("rp", "r").hint("merge"), "rp", "left").fillna(0.0, ["wl", "wr", "xl", "xr"])
        both = both.withColumns({"w": F.greatest("wl", "wr") * 0.6, "against": (F.greatest("xl", "xr") > 0) & (F.greatest("wl", "wr") < 0.3)})
        # a part is worth what extracts it: its partner, less where a pattern seen often never extracts a name (`The _ index`), or less surely the pattern alone; words also written small are no names
        def parts(word: str, other: str, small: str, role: str) -> DataFrame:
            ev = F.when(F.col("against"), F.col(other) * 0.4).otherwise(1 - (1 - F.col(other)) * (1 - F.col("w")))
            return both.filter(F.col(word) != "").select(F.col(word).alias("word"), F.lit(role).alias("role"), "n", (F.col("n") * ev).alias("x"), F.col(small).alias("s"), _lone().alias("lone"))

        worth = parts("a", "f", "na", "given").unionByName(parts("b", "g", "nb", "family").filter("not lone"))
        learned = worth.groupBy("word", "role").agg((F.sum("x") / F.sum("n") * (1 - F.sum("s") / F.sum("n"))).alias("score"))
        scores = scratch(learned.unionByName(seeds).groupBy("word", "role").agg(F.max("score").alias("score")).filter("score > 0.05"), "scores")
    return scores


def _names(found: DataFrame, scores: DataFrame) -> DataFrame:
    """Verdicts are made on the distinct names and joined back to their occurrences."""
    sure = scores.filter(F.col("score") >= CONFIDENT)
    names = found.filter("kind = 'name'").select("doc_id", "start", "stop", "form", "a", "b", F.coalesce("label", F.lit("")).alias("after"))
    family, given = sure.filter("role = 'family'").select(F.col("word").alias("b")), sure.filter("role = 'given'").select(F.col("word").alias("a"), F.lit(True).alias("is_given"))
    verdicts = names.select("form", "a", "b", "after").distinct().join(family.hint("merge"), "b", "left_semi").join(given.hint("merge"), "a", "left").filter(_lone() | F.col("is_given"))
    # initials before a family name belong to that one
    verdicts = verdicts.join(family.select(F.col("b").alias("after")), "after", "left_anti").select("form", "a", "b", "after")
    return names.join(verdicts.hint("merge"), ["form", "a", "b", "after"], "left_semi").select("doc_id", F.lit("name").alias("pii_kind"), "start", "stop")


# Numbers

_CONTEXT = ("shape", "label", "l1", "l2", "r1", "r2")


def _numbers(found: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Phone and identity numbers: shapes and contexts score each other, from labelled ones on."""
    rows = found.filter("kind = 'number'").select("doc_id", "start", "stop", F.col("a").alias("shape"), *[F.concat(F.lit(f"{c} "), c).alias(c) for c in ("l1", "l2", "r1", "r2")], F.coalesce("label", F.lit("")).alias("label"))
    edges = scratch(
        rows.groupBy(*_CONTEXT).agg(F.count(F.lit(1)).cast("double").alias("n")),
        "edges",
    )
    kinds = ("phone", "identity")
    patterns = None

    def valued(df: DataFrame) -> DataFrame:
        """df with, for each kind, the worth of its context: the longest pattern seen often enough on either side, or its label."""
        out = df
        for c in ("l1", "l2", "r1", "r2"):
            if patterns is None:
                out = out.withColumns({f"{c}_{k}": F.lit(None).cast("double") for k in kinds})
            else:
                p = patterns.select(F.col("p").alias(c), *[F.col(k).alias(f"{c}_{k}") for k in kinds])
                out = out.join(p.hint("merge"), c, "left")
        return out.withColumns({
            f"w_{k}": F.greatest(F.when(F.col("label") == k, 1.0).otherwise(0.0), *[F.coalesce(F.when(F.col("label").isin("", k), F.coalesce(f"{s}2_{k}", f"{s}1_{k}")), F.lit(0.0)) for s in "lr"])
            for k in kinds
        })

    shapes = None
    for _ in range(rounds):
        worth = valued(edges)
        shapes = scratch(
            worth.groupBy("shape").agg(*[F.sum(F.col("n") * F.col(f"w_{k}")).alias(f"x_{k}") for k in kinds], F.sum("n").alias("n"))
            .select("shape", *[F.when(F.col("x_phone") + F.col("x_identity") >= 0.1 * F.col("n"), F.col(f"x_{k}") / (F.col("x_phone") + F.col("x_identity"))).otherwise(0.0).alias(k) for k in kinds]),
            "shapes",
        )
        sides = edges.select("shape", F.explode(F.array("l1", "l2", "r1", "r2")).alias("p"), "n").groupBy("p", "shape").agg(F.sum("n").alias("n")).join(shapes, "shape")
        patterns = scratch(
            sides.groupBy("p").agg(
                F.sum("n").alias("n"), *[(F.sum(F.col("n") * F.col(k)) / F.sum("n") * F.when(F.count(F.when(F.col(k) >= CONFIDENT, 1)) >= 2, 1.0).otherwise(0.0)).alias(k) for k in kinds]
            ).filter(F.col("n") >= LEAST_SEEN).drop("n"),
            "patterns",
        )
    # the context says that it is personal, the shape which kind it is, unless a label does; said of each distinct context, then joined back
    personal = F.col("w_phone") + F.col("w_identity") >= CONFIDENT
    kind = F.coalesce(F.nullif("label", F.lit("")), F.when(F.col("phone") >= CONFIDENT, "phone").when(F.col("identity") >= CONFIDENT, "identity"))
    verdicts = scratch(valued(edges).join(shapes, "shape").filter(personal).withColumn("pii_kind", kind).filter("pii_kind is not null").select(*_CONTEXT, "pii_kind"), "verdicts")
    return rows.join(verdicts.hint("merge"), list(_CONTEXT)).select("doc_id", "pii_kind", "start", "stop")


# Addresses


def _addresses(found: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Addresses: street types and places score each other, from known street words on."""
    rows = found.filter("kind = 'address'").select("doc_id", "start", "stop", "form", F.col("a").alias("street"), F.col("b").alias("place"), F.col("label").alias("code"))
    spark = rows.sparkSession
    edges = scratch(rows.groupBy("form", "street", "place").agg(F.count(F.lit(1)).cast("double").alias("n"), F.count_distinct("code").alias("codes")), "edges")
    seeds = spark.createDataFrame([(w, 1.0) for w in STREET_WORDS + STREET_ENDINGS], "street string, score double")
    streets, places = seeds, None
    for _ in range(rounds):
        # a place is sure when a code follows it, which bounds it on both sides; after a code, when it comes with several codes
        worth = edges.join(streets, "street").filter(F.col("score") >= CONFIDENT).groupBy("place").agg(
            F.max((F.col("form") == "closed").cast("int")).alias("closed"), F.sum(F.when(F.col("form") == "coded", F.col("codes")).otherwise(0)).alias("codes")
        )
        places = scratch(worth.filter("closed = 1 or codes >= 2").select("place", F.lit(1.0).alias("sure")), "places")
        seen = edges.filter("form <> 'bare'").join(places, "place", "left")
        learned = seen.groupBy("street").agg((F.sum(F.col("n") * F.coalesce("sure", F.lit(0.0))) / F.sum("n") * F.when(F.count_distinct(F.when(F.col("sure").isNotNull(), F.col("place"))) >= 2, 1.0).otherwise(0.0)).alias("score"))
        streets = scratch(learned.unionByName(seeds).groupBy("street").agg(F.max("score").alias("score")), "streets")
    sure_streets = streets.filter(F.col("score") >= CONFIDENT).select("street", F.lit(True).alias("is_street"))
    judged = rows.join(sure_streets, "street").join(places, "place", "left")
    kept = judged.filter("sure is not null or form = 'closed' or (form = 'coded' and instr(place, ' ') = 0)")
    # of the readings of one place the longest that is sure
    best = kept.groupBy("doc_id", "start").agg(F.max(F.when(F.col("sure").isNotNull(), F.col("stop"))).alias("s"), F.max("stop").alias("any"))
    return best.select("doc_id", F.lit("address").alias("pii_kind"), "start", F.coalesce("s", "any").alias("stop"))


def find_personal(documents: DataFrame, known_names: DataFrame) -> DataFrame:
    """The places of personal information in documents(doc_id, text).

    known_names(name_part, name_kind) seeds the names; nulls and kinds other
    than given and family are passed over, and without any no names are found.
    Rows with a null doc_id or text have no findings; repeated rows of a
    doc_id are one document when their texts are the same. Other columns are
    ignored. Returns doc_id, pii_kind, start_char, end_char in code points from
    0, end exclusive, without overlaps: what starts first stays, the longer of
    two that start together. The result is a written table; those made on the
    way are deleted.
    """
    with scratch_scope() as keep:
        return keep(scratch(_found(documents, known_names), "personal"))


def _found(documents: DataFrame, known_names: DataFrame) -> DataFrame:
    found = propose(documents)
    known = known_names.filter("name_part is not null and name_kind in ('given', 'family')").select(F.lower("name_part").alias("word"), F.col("name_kind").alias("role"))
    every = _emails(found).unionByName(_numbers(found)).unionByName(_addresses(found)).unionByName(_names(found, score_names(found, known)))
    per_doc = every.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("start", (-F.col("stop")).alias("neg"), "pii_kind"))).alias("s"))  # of one text
    return per_doc.select("doc_id", F.explode(_without_overlaps("s")).alias("x")).select("doc_id", F.col("x.pii_kind").alias("pii_kind"), F.col("x.start_char").alias("start_char"), F.col("x.end_char").alias("end_char"))


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("pii_kind", T.StringType()), T.StructField("start_char", T.LongType()), T.StructField("end_char", T.LongType())])))
def _without_overlaps(spans: pd.Series) -> pd.Series:
    def one(s: list) -> list[dict]:
        out, at = [], -1
        for x in s:
            if x["start"] >= at:
                at = -x["neg"]
                out.append({"pii_kind": x["pii_kind"], "start_char": x["start"], "end_char": at})
        return out

    return spans.map(one)


@F.pandas_udf(T.StringType())
def _replaced(text: pd.Series, spans: pd.Series) -> pd.Series:
    def one(t: str, s: list) -> str:
        if s is None:
            return t
        out, at = [], 0
        for x in s:
            out += [t[at : x["start_char"]], f"[{x['pii_kind'].upper()}]"]
            at = x["end_char"]
        return "".join([*out, t[at:]])

    return pd.Series([one(t, s) for t, s in zip(text, spans)], dtype=object)


def redact(documents: DataFrame, personal: DataFrame) -> DataFrame:
    """doc_id, text with typed placeholders, n_replaced, for every document with a text; repeated rows of a doc_id come once each."""
    spans = personal.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start_char", "end_char", "pii_kind"))).alias("spans"))  # of one text
    own = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null and text is not null").join(spans.hint("merge"), "doc_id", "left")
    return own.select("doc_id", F.when(F.col("spans").isNull(), F.col("text")).otherwise(_replaced("text", "spans")).alias("text"), F.coalesce(F.size("spans"), F.lit(0)).alias("n_replaced"))
