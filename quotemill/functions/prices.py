"""Column functions for prices: money text, tax terms, price views, comparability, deltas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_money(text: Column) -> Column:
    """A positive amount where the text is one amount with an optional currency; never joins two numbers."""
    found = F.regexp_extract(F.trim(text), r"^(?:RUB|USD|EUR|₽|\$|€)?\s*([0-9]{1,3}(?:[  ][0-9]{3})*|[0-9]+)(?:[.,]([0-9]{1,2}))?\s*(?:руб\.?|RUB|USD|EUR|₽|\$|€)?$", 1)
    cents = F.regexp_extract(F.trim(text), r"^(?:RUB|USD|EUR|₽|\$|€)?\s*(?:[0-9]{1,3}(?:[  ][0-9]{3})*|[0-9]+)(?:[.,]([0-9]{1,2}))?\s*(?:руб\.?|RUB|USD|EUR|₽|\$|€)?$", 1)
    amount = F.when(found != "", F.concat(F.regexp_replace(found, r"[  ]", ""), F.lit("."), F.rpad(cents, 2, "0")).try_cast("decimal(18,2)"))
    return F.when(amount > 0, amount)


def parse_terms(text: Column) -> Column:
    """struct(basis, rate, unit): basis and rate unknown where the text is silent or contradicts itself; pack beats piece.
    A percentage is a rate only beside the name of the tax."""
    low = F.lower(F.regexp_replace(text, r"(?U)\s+", " "))
    excluded = r"(?U)без (?:уч[её]та )?ндс|не включая ндс|ндс не включ[её]н|excl\w*\.? vat|net of vat"
    net, rest = low.rlike(excluded), F.regexp_replace(low, excluded, "")
    gross = rest.rlike(r"(?U)\bс (?:уч[её]том )?ндс|включая ндс|ндс (?:\d+(?:[.,]\d+)? ?% ?)?включ[её]н|в т\.? ?ч\.? ?ндс|incl\w*\.? vat|vat included|gross")
    named = [F.regexp_extract_all(low, F.lit(p), F.lit(1)) for p in (r"(?:ндс|vat) ?[:(]? ?([0-9]+(?:[.,][0-9]+)?) ?%", r"([0-9]+(?:[.,][0-9]+)?) ?% ?(?:ндс|vat)")]
    rates = F.array_distinct(F.transform(F.concat(*named), lambda x: F.replace(x, F.lit(","), F.lit(".")).cast("double")))
    return F.struct(
        F.when(net & ~gross, "net").when(gross & ~net, "gross").otherwise("unknown").alias("basis"),
        F.when((F.size(rates) == 1) & (F.try_element_at(rates, F.lit(1)) <= 100), rates[0]).alias("rate"),
        F.when(low.rlike(r"упак|pack"), "pack").when(low.rlike(r"шт|piece"), "piece").alias("unit"),
    )


def gross_price(price: Column, basis: Column, rate: Column) -> Column:
    return F.when(basis == "gross", price.cast("double")).when((basis == "net") & rate.isNotNull(), price.cast("double") * (1 + rate / 100))


def net_price(price: Column, basis: Column, rate: Column) -> Column:
    return F.when(basis == "net", price.cast("double")).when((basis == "gross") & rate.isNotNull(), price.cast("double") / (1 + rate / 100))


def with_tax(price: Column, rate: Column) -> Column:
    """Net to gross, rounded half up to cents."""
    return F.round(price.cast("decimal(18,2)") * (1 + rate.cast("decimal(5,2)") / 100), 2).cast("decimal(18,2)")


def comparable(a: str, b: str) -> Column:
    """Same known basis and unit, and the same rate where both are known."""
    def known(f: str) -> Column:
        return (F.col(f"{a}.{f}") == F.col(f"{b}.{f}")) & (F.col(f"{a}.{f}") != "unknown")

    return F.coalesce(known("unit") & known("basis") & (F.col(f"{a}.rate").isNull() | F.col(f"{b}.rate").isNull() | (F.col(f"{a}.rate") == F.col(f"{b}.rate"))), F.lit(False))


def delta(own: str, other: str) -> Column:
    """struct(delta, gap, note) of two quotes (structs of price, currency, unit, basis, rate) in their gross view, and
    in raw prices where a view is missing; the gap is relative to the own price."""
    def of(side: str, name: str) -> Column:
        return F.col(f"{side}.{name}")

    stop = F.when(of(own, "price").isNull() | of(other, "price").isNull(), "no price").when(~of(own, "currency").eqNullSafe(of(other, "currency")), "currency").when(of(own, "unit") != of(other, "unit"), "unit")
    views = [gross_price(of(s, "price"), of(s, "basis"), of(s, "rate")) for s in (own, other)]
    raw = [of(s, "price").cast("double") for s in (own, other)]
    aligned = views[0].isNotNull() & views[1].isNotNull()
    a, b = (F.when(aligned, v).otherwise(r) for v, r in zip(views, raw, strict=True))
    same_basis = (of(own, "basis") == of(other, "basis")) & (of(own, "basis") != "unknown")
    notes = F.concat_ws(" · ", stop, F.when(stop.isNull() & ~aligned & ~same_basis, "tax not aligned"), F.when(stop.isNull() & (of(own, "unit").isNull() | of(other, "unit").isNull()), "unit unknown"))
    return F.struct(F.when(stop.isNull(), F.round(b - a, 2)).alias("delta"), F.when(stop.isNull() & (a != 0), F.round((b - a) / a * 100, 4)).alias("gap"), notes.alias("note"))


def availability(text: Column) -> Column:
    """The first that applies of: discontinued, out of stock, on order, in stock; else unknown."""
    low = F.lower(text)
    return F.when(low.rlike("снят|discontinued"), "discontinued").when(low.rlike("нет в наличии|out of stock"), "out_of_stock").when(low.rlike("под заказ|on order"), "on_order").when(low.rlike("в наличии|in stock"), "in_stock").otherwise("unknown")
