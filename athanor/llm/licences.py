"""Licence scans by canonical digest lookup [native].

A text is normalised (A-Z lower-cased, lines of copyright statements and "all rights reserved" dropped, every run of other ASCII characters one
space, equivalent spellings unified) and its SHA-256 is hash-joined to the digests of known licences,
normalised by the same expression.  The lines of a text are looked up the same way in the one-line
notices.  Everything is one projection over the scan; the joined table is as large as the list of known
licences, so it is broadcast behind a check of its row count.

Cases: null text counts as empty and has the digest of the empty text, which is no licence; two known
texts with one digest must carry one identifier; extra columns pass by unless they have a result's name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .licence_texts import EQUAL_SPELLINGS, NOTICES, TEXTS

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MARKS = r"[ \t#*/;-]*"
#: Beginnings of lines of wrapped licence text that are no copyright statement, newlines doubled: by the word that follows
#: in licence texts, by punctuation, or "(c)" as the mark of a list's item.  Without look-ahead, which DuckDB lacks.
NO_STATEMENT = (
    r"\n" + MARKS + r"(copyright(?:[ \t]+(?:notices?|holders?|owners?|ownership|licen[cs]es?|laws?|lines?|interests?|statements?|disclaimers?|treaty"
    r"|doctrines?|permission|protection|patents?|and|or|on|if|is|are|also|those|resulting|of[ \t]+(?:the|this|these|an?|any)"
    r"|the[ \t]+(?:software|program|library|work))[^a-z0-9]|[ \t]+the[ \t\r]*\n|[ \t\r]*[\n.;)\"']|,[ \t\r]*[^0-9(© \t\r]"
    r"|(?:able|ed|s)[ \t\r]*[^0-9(© \t\r])|\(c\)[ \t]+(?:you|under|representations|the[ \t]+licen[cs]es?)[^a-z0-9]|\(c\)[ \t\r]*\n)"
)
COPYRIGHT_LINE = r"\n" + MARKS + r"(?:copyright|\(c\)|©)[^\n]*"
RIGHTS_LINE = r"\n" + MARKS + r"all rights reserved[ \t.!#*/;-]*\r?\n"
OTHER_ASCII = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: More known texts than this are joined by a shuffle instead of a broadcast.
BROADCAST_ROWS = 100_000
STEM = "licen"


def normalised(text: Column) -> Column:
    out = F.concat(F.lit("\n"), F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit("\n"))
    out = F.regexp_replace(F.replace(out, F.lit("\n"), F.lit("\n\n")), NO_STATEMENT, "\n\x01$1")
    out = F.regexp_replace(F.regexp_replace(out, COPYRIGHT_LINE, "\n"), RIGHTS_LINE, "\n")
    out = F.regexp_replace(out, OTHER_ASCII, " ")
    out = F.concat(F.trim(out), F.lit(" "))
    for a, b in EQUAL_SPELLINGS:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.trim(out)


def digest(text: Column) -> Column:
    return F.sha2(normalised(text), 256)


def known_digests(spark: SparkSession, texts: Sequence[tuple[str, str]] = TEXTS) -> DataFrame:
    """(license_id, digest) of the known texts; the list is a parameter of any length."""
    raw = spark.createDataFrame(list(texts), "license_id string, text string")
    return raw.select("license_id", digest(F.col("text")).alias("digest")).groupBy("digest").agg(F.min("license_id").alias("license_id"))


def scan_licences(df: DataFrame, text_col: str = "text", texts: Sequence[tuple[str, str]] = TEXTS, notices: Sequence[tuple[str, str]] = NOTICES) -> DataFrame:
    """`df` with text_digest, license_id (null: the entire text is no known licence) and notices, the
    sorted identifiers of known one-line notices among the text's lines."""
    spark = df.sparkSession
    names = [c for c in df.columns if c not in ("text_digest", "license_id", "notices")]
    lines = spark.createDataFrame(list(notices) or [("", STEM)], "license_id string, text string").select("license_id", "text", digest(F.col("text")).alias("digest")).collect()
    if any(STEM not in r["text"].lower() for r in lines):
        raise ValueError(f"a notice must contain {STEM!r}")
    by_digest = F.create_map(*(F.lit(x) for r in lines for x in (r["digest"], r["license_id"])))
    has_stem = lambda x: F.contains(F.translate(x, UPPER, LOWER), F.lit(STEM))
    found = F.transform(F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"), has_stem), lambda x: F.try_element_at(by_digest, digest(x)))
    known = known_digests(spark, texts)
    scanned = df.select(*names, digest(F.col(text_col)).alias("text_digest"), F.concat_ws(",", F.array_sort(F.array_distinct(F.array_compact(found)))).alias("notices"))
    right = known.withColumnRenamed("digest", "text_digest")
    return scanned.join(F.broadcast(right) if len(texts) <= BROADCAST_ROWS else right, "text_digest", "left").select(*names, "text_digest", "license_id", "notices")
