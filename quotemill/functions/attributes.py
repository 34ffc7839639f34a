"""Column functions that read typed values out of attribute texts; what a text does not say outright stays null."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"[-+−]?\d+(?:[.,]\d+)?"


def numbers(text: Column) -> Column:
    """Every number of a text, as doubles."""
    return F.transform(F.regexp_extract_all(text, F.lit(f"({NUMBER})"), F.lit(1)), lambda x: F.translate(x, ",−", ".-").cast("double"))


def single_number(text: Column) -> Column:
    """The number of a text that has exactly one."""
    found = numbers(text)
    return F.when(F.size(found) == 1, F.element_at(found, 1))


def interval(text: Column) -> Column:
    """struct(low, high) of a text with exactly two numbers that ascend; dots between them are no decimal point."""
    found = numbers(F.regexp_replace(text, r"\.{2,}|…", " "))
    ok = (F.size(found) == 2) & (F.try_element_at(found, F.lit(1)) <= F.try_element_at(found, F.lit(2)))
    return F.when(ok, F.struct(found[0].alias("low"), found[1].alias("high")))


def positive(text: Column, most: float = 1e12) -> Column:
    """A positive finite number, not above most; null for anything else."""
    x = text.try_cast("double")
    return F.when(~F.isnan(x) & (x > 0) & (x <= most), x)


def milliamperes(text: Column) -> Column:
    """A current in mA; of a range the upper bound."""
    found = F.array_max(numbers(text))
    low = F.lower(text)
    return F.when(low.rlike(r"\d\s*(?:ma|ма)\b"), found).when(low.rlike(r"(?U)\d\s*(?:a|а)\b"), found * 1000)


def hertz(text: Column) -> Column:
    found = F.array_max(numbers(text))
    low = F.lower(text)
    return F.when(low.rlike(r"(?U)\d\s*(?:khz|кгц)\b"), found * 1000).when(low.rlike(r"(?U)\d\s*(?:hz|гц)\b"), found)


def one_of(text: Column, stems: Mapping[str, str]) -> Column:
    """The only code of which the pattern is in the text; null where none or several are."""
    low = F.lower(F.coalesce(text, F.lit("")))
    found = F.array_compact(F.array(*[F.when(low.rlike(pattern), code) for code, pattern in stems.items()]))
    return F.when(F.size(found) == 1, F.element_at(found, 1))


def first_of(text: Column, rules: Mapping[str, str]) -> Column:
    """The first code of which the pattern is in the text, in the order of the rules."""
    low, out = F.lower(text), F.when(F.lit(False), "")
    for code, pattern in rules.items():
        out = out.when(low.rlike(pattern), code)
    return out


def display_money(price: Column) -> Column:
    """1 234,50: a space between thousands, a comma before two decimals."""
    return F.translate(F.format_number(price.cast("decimal(18,2)"), 2), ",.", " ,")


def metric_label(key: Column, labels: Mapping[str, str]) -> Column:
    """A metric's label from the dictionary; else its camel case taken apart, in lower case but for the first letter."""
    split = F.lower(F.regexp_replace(key, "([a-z0-9])([A-Z])", "$1 $2"))
    known = F.try_element_at(F.create_map(*[F.lit(x) for pair in labels.items() for x in pair]), key)
    return F.coalesce(known, F.concat(F.upper(F.left(split, F.lit(1))), F.substr(split, F.lit(2))))


def label_of(code: Column, labels: Mapping[str, str]) -> Column:
    """The label of a code, or the code itself."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in labels.items() for x in pair]), code), code)


def corruption(text: Column) -> Column:
    """Pairs of characters that text in one encoding shows when it is read in another, and replacement characters."""
    return F.regexp_count(text, F.lit(r"[ÃÂÐÑ][\x{80}-\x{BF}]|\x{FFFD}"))


def whole_token(text: Column, token: str) -> Column:
    """Whether a token is in the text with neither letters, digits nor a dash around it."""
    return text.rlike(rf"(?U)(?<![\w-])\Q{token}\E(?![\w-])")
