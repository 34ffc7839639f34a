"""Bytes to text in the encoding that damages it least.

Valid UTF-8 is never read as anything else and stays in the JVM. For other bytes the candidates are, in this order: the
encoding that the transport declares (Latin-1 and ASCII are defaults, so they come last), the one that the page declares
in its first 8192 bytes, UTF-8 and Windows-1251. The text of least damage wins, ties by this order. Nothing is guessed
from byte statistics. Null bytes give a null text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What is left of text that was read in a wrong encoding (fixed values).
MARKERS = "�ÐÑÃÂ"
LATIN = ("iso-8859-1", "latin-1", "ascii")
DECLARED = re.compile(rb"""<meta[^>]+charset=["']?([\w.-]+)""", re.IGNORECASE)
HEAD = 8192


def damage(text: Column) -> Column:
    """Markers of a wrong encoding, and four or more Latin-1 letters, which Cyrillic text has only by mistake."""
    letters = F.regexp_count(text, F.lit("[À-ÿ]"))
    return F.regexp_count(text, F.lit(f"[{MARKERS}]")) + F.when(letters >= 4, letters).otherwise(0)


#: Bytes (or characters) that are read into Python objects at a time; a single longer value is read alone.
PIECE = 1 << 20


def pieces(*columns: pd.Series) -> Iterator[list[tuple]]:
    """Rows of equally long columns in lists of at most PIECE bytes of the first, so that few results live at a time."""
    held, size = [], 0
    for row in zip(*columns, strict=True):
        n = 0 if row[0] is None else len(row[0])
        if held and size + n > PIECE:
            yield held
            held, size = [], 0
        held.append(row)
        size += n
    if held:
        yield held


def _readings(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    def of(raw: bytes, said: str | None) -> list[dict]:
        page = DECLARED.search(raw[:HEAD])
        late = said if said and said.lower() in LATIN else None
        names = [None if late else said, page and page[1].decode("ascii", "ignore"), "utf-8", "cp1251", late]
        out = []
        for name in names:
            try:
                if name:
                    out.append({"encoding": name.lower(), "text": raw.decode(name, "replace")})
            except LookupError:
                continue
        return out

    for columns in batches:
        for rows in pieces(*columns):
            yield pd.Series([of(bytes(raw), said) for raw, said in rows])


def decoded(df: DataFrame, content: str = "content", declared: Column | None = None) -> DataFrame:
    """df with text, encoding and damage in place of the column of bytes; ``declared`` is the transport's encoding."""
    said = (declared if declared is not None else F.lit(None)).cast("string")
    rest = [c for c in df.columns if c != content]
    df = df.withColumn("_said", said)
    valid = F.is_valid_utf8(F.col(content).cast("string"))
    plain = df.where(valid | F.col(content).isNull()).select(*rest, F.regexp_replace(F.col(content).cast("string"), "^﻿", "").alias("text"), F.when(F.col(content).isNotNull(), "utf-8").alias("encoding"))
    plain = plain.withColumn("damage", damage(F.col("text")))
    readings = F.pandas_udf(_readings, "array<struct<encoding:string,text:string>>")(F.col(content), F.col("_said"))
    tried = df.where(~valid).select(*rest, readings.alias("r"))
    scored = F.transform("r", lambda x, i: F.struct(damage(x["text"]).alias("damage"), i.alias("at"), x["encoding"].alias("encoding"), x["text"].alias("text")))
    best = tried.select(*rest, F.array_min(scored).alias("b"))
    return plain.unionByName(best.select(*rest, "b.text", "b.encoding", "b.damage"))


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, text, encoding, damage) of whole files, each below the limit of Spark's binary file source."""
    return decoded(spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content"))
