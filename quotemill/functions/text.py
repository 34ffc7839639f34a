"""Column functions for names, labels, texts and keyword classes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def squeezed(text: Column) -> Column:
    """White space runs as one space, none at the ends; null becomes empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def identity_key(text: Column) -> Column:
    """Upper case, dashes of all kinds as one, white space squeezed."""
    return squeezed(F.translate(F.upper(text), "–—‑", "---"))


def model_key(text: Column) -> Column:
    return F.translate(F.regexp_replace(F.upper(F.coalesce(text, F.lit(""))), r"(?U)\s+", ""), "Ё–—‑", "Е---")


def attribute_key(text: Column) -> Column:
    return F.rtrim(F.lower(F.translate(squeezed(text), "Ёё", "Ее")), F.lit(": "))


def latin_designation(text: Column) -> Column:
    """Cyrillic letters that look like Latin ones become those."""
    return F.translate(F.upper(text), "АВСЕКМНОРТХУ", "ABCEKMHOPTXY")


def shortened(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.rtrim(F.left(text, F.lit(most - 1))), F.lit("…"))).otherwise(text)


def first_sentences(text: Column, n: int, most: int) -> Column:
    """The first n sentences of a text, shortened."""
    parts = F.filter(F.split(squeezed(text), r"(?<=[.!?]) "), lambda s: F.length(s) > 0)
    return shortened(F.array_join(F.slice(parts, 1, n), " "), most)


def file_token(text: Column, most: int = 80) -> Column:
    return F.left(F.regexp_replace(text, r"[^A-Za-z0-9._-]+", "_"), F.lit(most))


def safe_cell(text: Column) -> Column:
    """A spreadsheet takes no formula from it."""
    return F.when(F.ltrim(text).rlike(r"^[=+\-@]"), F.concat(F.lit("'"), text)).otherwise(text)


def keyword_class(text: Column, keywords: Mapping[str, Sequence[str]], fallback: str) -> Column:
    """struct(category, hits, confidence): the class of most keywords found, ties by order of the classes."""
    low = F.lower(F.coalesce(text, F.lit("")))
    counted = F.array(*[F.struct(sum((F.when(low.contains(w), 1).otherwise(0) for w in words), F.lit(0)).alias("hits"), F.lit(-i).alias("rank"), F.lit(name).alias("category")) for i, (name, words) in enumerate(keywords.items())])
    best = F.array_max(counted)
    hit = best["hits"] > 0
    return F.struct(F.when(hit, best["category"]).otherwise(fallback).alias("category"), best["hits"].alias("hits"), F.when(hit, F.least(F.lit(0.95), F.round(0.45 + 0.12 * best["hits"], 2))).otherwise(0.2).alias("confidence"))


def protected_tokens(text: Column) -> Column:
    """Numbers and upper-case codes that a translation must keep, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"([A-Z]{2,}[0-9-]*|[0-9]+(?:[.,][0-9]+)?)"), F.lit(1))))


# What a translation must keep, and how its terms read in Russian.
MODELS = r"(?U)\b[A-ZА-Я]+[A-ZА-Я0-9-]*\d[A-ZА-Я0-9-]*\b|\b[A-Z]{2,}[A-Z0-9-]*\b"
AMOUNTS = r"\d+(?:[.,]\d+)?(?:\s*[%°])?"
UNITS = r"\b(?:mm|cm|MHz|kHz|GHz|MPa|kPa|mA|mV|kW|VDC|VAC)\b"
TERMS = (
    ("capacitive", "ёмкостн|емкостн"),
    ("inductive", "индуктивн"),
    ("photoelectric", "фотоэлектр|оптическ"),
    ("proximity", "приближен|бесконтакт"),
    ("power controller", "регулятор.{0,20}мощност|контроллер.{0,20}мощност"),
    ("encoder", "энкодер|преобразователь.{0,20}перемещен"),
)


def kept_tokens(text: Column) -> Column:
    """Models, numbers (with a decimal point and no spaces) and units of a text, sorted, each as often as it is there."""
    found = lambda pattern: F.coalesce(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.array().cast("array<string>"))
    amounts = F.transform(found(AMOUNTS), lambda x: F.regexp_replace(F.translate(x, ",", "."), r"(?U)\s", ""))
    return F.array_sort(F.concat(found(MODELS), amounts, found(UNITS)))


def translation_faults(original: Column, translated: Column) -> Column:
    """struct(lost, added, terms): tokens that the translation has too few or too many of (a token once for each that
    lacks or exceeds, sorted), and English terms of which the Russian reading is missing. A null text is an empty one."""

    def beyond(x: Column, y: Column) -> Column:
        times = lambda words, w: F.size(F.filter(words, lambda v: v == w))
        extra = F.transform(F.array_distinct(x), lambda w: F.array_repeat(w, F.greatest(times(x, w) - times(y, w), F.lit(0))))
        return F.flatten(extra)

    both = F.array(F.struct(kept_tokens(original).alias("one"), kept_tokens(translated).alias("two")))  # bound, so read once
    found = F.transform(both, lambda x: F.struct(beyond(x["one"], x["two"]).alias("lost"), beyond(x["two"], x["one"]).alias("added")))[0]
    low = F.lower(F.coalesce(original, F.lit("")))
    terms = F.array_compact(F.array(*[F.when(low.contains(term) & ~F.coalesce(translated, F.lit("")).rlike("(?Uiu)" + reading), term) for term, reading in TERMS]))
    return F.struct(found["lost"].alias("lost"), found["added"].alias("added"), terms.alias("terms"))
