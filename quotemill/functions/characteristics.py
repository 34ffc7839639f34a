"""Column functions that read typed characteristics of sensors out of attribute texts, in Russian and English.

What a text does not say outright, or says twice in different ways, stays null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from quotemill.functions import attributes as a
from quotemill.functions import text as t

Rules = Sequence[tuple[str, str]]

# Patterns over the lower-case key of a text, with the code they mean; the first that is found counts.
MOUNTING: Rules = (
    ("quasi|квази", "quasi-flush"),
    (r"^(non[- ]flush|unshielded)$|не\s*утапливаем|не\s*встраив|не\s?заподлицо", "non-flush"),
    ("^(flush|shielded)$|утапливаем|встраив|^заподлицо$", "flush"),
)
MATERIAL: Rules = (
    ("^(металл|metal|сплав|alloy)$", ""),
    ("brass", "brass"),
    (r"stainless|12[хx]18[нh]10[тt]|03[хx]17[нh]14[мm]3|\b(?:aisi|sus)\s*(?:303|304|316)\b|\b1\.(?:4301|4305|4404|4435)\b", "stainless"),
    ("латун", "brass"),
    (r"нержав|нерж\.", "stainless"),
    ("пласт|полимер|текаформ|полиамид|pbt|abs", "plastic"),
    ("алюмин|д16|дюрал", "aluminium"),
    ("сталь", "steel"),
)
BODY: Rules = ((r"резьб|\b[mм]\s*\d", "threaded"), ("гладк", "smooth"), ("прямоугол|кубич", "rectangular"), ("щелев", "slot"))
NORMALLY_OPEN = r"\b(?:no|но)\b|нормально разомкнут|(?<!ра)замыкающ"
NORMALLY_CLOSED = r"\b(?:nc|нз)\b|нормально замкнут|размыкающ"
PLUG = r"разъем|штек|connector|\b[mм](?:8|12|16|23)\b"
THREAD = r"(?U)(?<!\w)[MМmм]\s*(\d+(?:[.,]\d+)?)(?:\s*[xх×XХ*]\s*(\d+(?:[.,]\d+)?))?"
NOT_IMMERSIBLE = r"(?U)\b(?:не\s*(?:является\s+)?погружн\w*|(?:non[- ]|not\s+)(?:submersible|immersible))\b"
#: Special executions by what a purpose text says of them.
SPECIAL: Rules = (
    ("аналогов", "analog"),
    (r"взрывозащи|\bex\s*[miad]", "ex"),
    (r"\b(?:погружн\w*|submersible|immersible)\b", "immersible"),
    ("namur", "namur"),
    ("высокого давления|высокое давление", "pressure"),
    ("щелев", "slot"),
    ("контроля скорости|контроля минимальной скорости", "speed"),
)
PLACEHOLDERS = ("", "-", "—", "не указано", "нет данных", "н/д", "n/a")


def _has(key: Column, pattern: str) -> Column:
    return key.rlike("(?U)" + pattern)


def by_rules(key: Column, rules: Rules) -> Column:
    """The code of the first rule of which the pattern is in the key; null where none is."""
    return F.coalesce(*[F.when(_has(key, pattern), code) for pattern, code in rules], F.lit(None).cast("string"))


def _pair(one: Column, other: Column, both: str, first: str, second: str) -> Column:
    return F.when(one & other, both).when(one, first).when(other, second)


def output(text: Column) -> Column:
    """NPN, PNP or NAMUR, all that are named joined by a slash; else 2-wire or relay."""
    key = t.attribute_key(text)
    named = F.array_compact(F.array(*[F.when(_has(key, rf"\b{x.lower()}\b"), x) for x in ("NAMUR", "NPN", "PNP")]))
    two = _has(key, r"2\s*[-хx]*\s*(?:провод|пров\.)|^(?:ac|dc)")
    return F.when(F.size(named) > 0, F.array_join(named, "/")).when(two, "2-wire").when(_has(key, "реле|relay"), "relay")


def switching(text: Column) -> Column:
    """NO, NC, NO/NC or changeover."""
    key = t.attribute_key(text)
    return F.coalesce(_pair(_has(key, NORMALLY_OPEN), _has(key, NORMALLY_CLOSED), "NO/NC", "NO", "NC"), F.when(_has(key, "переключающ"), "changeover"))


def mounting(text: Column) -> Column:
    return by_rules(t.attribute_key(text), MOUNTING)


def material(text: Column) -> Column:
    """A known material, null for what says nothing (metal), else the text's own words."""
    key = t.attribute_key(text)
    return F.nullif(F.coalesce(by_rules(key, MATERIAL), key), F.lit(""))


def connection(text: Column) -> Column:
    key = F.translate(t.attribute_key(text), "ё", "е")
    return F.coalesce(_pair(_has(key, "кабел|провод|cable"), _has(key, PLUG), "cable+connector", "cable", "connector"), F.when(_has(key, "клем"), "terminals"))


def supply_type(text: Column) -> Column:
    key = t.attribute_key(text)
    return _pair(_has(key, "ac|переменн"), _has(key, "dc|постоянн"), "AC/DC", "AC", "DC")


def body_type(text: Column) -> Column:
    return by_rules(t.attribute_key(text), BODY)


def protection(text: Column) -> Column:
    """The different IP classes of a text, sorted and joined by a slash."""
    found = F.array_sort(F.array_distinct(F.regexp_extract_all(F.upper(text), F.lit(r"IP\s*(\d\d(?:K|[A-D])?)"), F.lit(1))))
    return F.nullif(F.array_join(found, "/"), F.lit(""))


def connector(text: Column) -> Column:
    """The key of a connector's name, M12 with a Latin letter."""
    return F.nullif(F.regexp_replace(t.attribute_key(text), r"^[мm](?=\d)", "m"), F.lit(""))


def thread_pitch(number: Column) -> Column:
    return F.when((number > 0) & (number <= 6), number)


def _decimal(text: Column) -> Column:
    return F.translate(text, ",", ".").try_cast("double")


def threads(text: Column) -> Column:
    """array<struct(diameter, pitch)> of the metric threads of a text, as M18x1; a second number over 6 is no pitch."""
    found = F.regexp_extract_all(text, F.lit(THREAD), F.lit(0))
    read = F.transform(found, lambda m: F.struct(_decimal(F.regexp_extract(m, THREAD, 1)).alias("diameter"), thread_pitch(_decimal(F.regexp_extract(m, THREAD, 2))).alias("pitch")))
    return F.filter(read, lambda x: x["diameter"] > 0)


def bounds(text: Column) -> Column:
    """struct(low, high) of a range; a dash between two numbers divides them, before a number alone it is a sign."""
    plain = F.translate(text, "−–—", "---")
    return a.interval(F.regexp_replace(plain, r"(?<=\d)\s*-\s*(?=\d)", " … "))


def load_milliamperes(name: Column, text: Column) -> Column:
    """The greatest load in mA; ampere where the name ends so or the text has it after a number."""
    low, both = a.single_number(text), bounds(text)
    number = F.coalesce(low, F.when(both["low"] >= 0, both["high"]))
    return F.when(name.endswith(", а") | text.rlike(r"\d\s*[АA](?![а-яa-z])"), number * 1000).otherwise(number)


def frequency_hertz(text: Column) -> Column:
    number = a.single_number(text)
    return F.when(_has(t.attribute_key(text), "кгц|khz"), number * 1000).otherwise(number)


def special_executions(text: Column) -> Column:
    """Sorted special executions that a purpose text names; a denied immersion is none."""
    key = F.regexp_replace(t.attribute_key(text), NOT_IMMERSIBLE, "")
    return F.array_compact(F.array(*[F.when(_has(key, pattern), flag) for pattern, flag in SPECIAL]))


def is_placeholder(text: Column) -> Column:
    return F.coalesce(t.attribute_key(text).isin(*PLACEHOLDERS), F.lit(True))
