"""Column functions for publisher dates, announced months and periods."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: First letters of month names, in order (fixed values).
RUSSIAN = ("янв", "фев", "мар", "апр", "ма", "июн", "июл", "авг", "сен", "окт", "ноя", "дек")
ENGLISH = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
#: Month names as in "5 января 2026" (fixed values).
GENITIVE = ("января", "февраля", "марта", "апреля", "мая", "июня", "июля", "августа", "сентября", "октября", "ноября", "декабря")
#: Month names as in "январь 2026" (fixed values).
NOMINATIVE = ("январь", "февраль", "март", "апрель", "май", "июнь", "июль", "август", "сентябрь", "октябрь", "ноябрь", "декабрь")


def month_of(word: Column) -> Column:
    """1 to 12 for the name of a month in Russian or English, else null."""
    low = F.lower(word)
    out = F.when(F.lit(False), F.lit(0))
    for i, (ru, en) in enumerate(zip(RUSSIAN, ENGLISH, strict=True), 1):
        out = out.when(low.rlike(f"^(?:{ru if ru != 'ма' else 'ма[йя]'}|{en})"), i)
    return out


def day_of(year: Column, month: Column, day: Column) -> Column:
    """The date, or null where there is no such day."""
    text = F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0"))
    return F.when(year.isNotNull() & month.isNotNull() & day.isNotNull(), F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date"))


def parse_date(text: Column) -> Column:
    """A date that a publisher wrote out: ISO, Y.M.D, D.M.Y, or with the name of a month. Nothing is guessed: the first
    form that the text has decides, and null is its answer where there is no such day."""

    def part(pattern: str, i: int) -> Column:
        return F.nullif(F.regexp_extract(text, pattern, i), F.lit(""))

    first = r"(?<!\d)(\d{4})[-./](\d{1,2})[-./](\d{1,2})(?!\d)"
    last = r"(?<!\d)(\d{1,2})[-./](\d{1,2})[-./](\d{4})(?!\d)"
    named = r"(?<!\d)(\d{1,2})\s+([A-Za-zА-Яа-яё]{3,9})\.?,?\s+(\d{4})(?!\d)"
    ahead = r"([A-Za-z]{3,9})\.?\s+(\d{1,2}),?\s+(\d{4})(?!\d)"
    return (
        F.when(text.rlike(first), day_of(part(first, 1), part(first, 2), part(first, 3)))
        .when(text.rlike(last), day_of(part(last, 3), part(last, 2), part(last, 1)))
        .when(text.rlike(named), day_of(part(named, 3), month_of(part(named, 2)), part(named, 1)))
        .when(text.rlike(ahead), day_of(part(ahead, 3), month_of(part(ahead, 1)), part(ahead, 2)))
    )


def announced_month(text: Column) -> Column:
    """The first day of the only month that a text names with its year; null where it names none or several."""
    pattern = F.lit(r"(?iu)([а-яё]{3,9})\s+(20\d{2})")
    years = F.regexp_extract_all(text, pattern, F.lit(2))
    named = F.transform(F.regexp_extract_all(text, pattern, F.lit(1)), lambda word, i: day_of(F.get(years, i), month_of(word), F.lit("1")))
    months = F.array_distinct(F.filter(named, lambda day: day.isNotNull()))
    return F.when(F.size(months) == 1, F.element_at(months, 1))


def month_key(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM")


def month_inside(date: Column, start: str, end: str) -> Column:
    """Whether the whole month of a date lies in a range of days."""
    return (F.trunc(date, "month") >= F.lit(start).cast("date")) & (F.last_day(date) <= F.lit(end).cast("date"))


def partial_date_error(precision: Column, value: Column, period: Column) -> Column:
    """'precision' where the value is not written as its precision says, 'date' where there is no such day, 'period'
    where it lies outside the month it is filed under; else null."""
    form = F.when(precision == "day", value.rlike(r"^\d{4}-\d{2}-\d{2}$")).when(precision == "month", value.rlike(r"^\d{4}-\d{2}$")).otherwise(value.rlike(r"^\d{4}$"))
    whole = F.concat(value, F.when(precision == "day", "").when(precision == "month", "-01").otherwise("-01-01"))
    size = F.when(precision == "year", 4).otherwise(7)
    return F.when(~form, "precision").when(F.try_to_timestamp(whole, F.lit("yyyy-MM-dd")).isNull(), "date").when(F.left(value, size) != F.left(period, size), "period")
