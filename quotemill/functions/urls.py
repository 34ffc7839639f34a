"""Column functions for URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query parameters that only track visitors (fixed values).
TRACKING = r"(?i)^(utm_[^=]*|gclid|fbclid)="
#: Path endings of files that are no pages (fixed values).
ASSETS = r"\.(?:css|js|png|jpe?g|gif|svg|ico|woff2?|mp4|zip|pdf)$"


def canonical(url: Column) -> Column:
    """Scheme and host in lower case, no fragment, no tracking parameters, the others sorted, no slash at the end but
    that of the root."""
    bare = F.split_part(url, F.lit("#"), F.lit(1))
    path = F.split_part(bare, F.lit("?"), F.lit(1))
    inside = F.regexp_replace(F.regexp_replace(path, r"^[A-Za-z]+://[^/]*", ""), "/+$", "")
    place = F.concat(F.lower(F.regexp_extract(path, r"^([A-Za-z]+://[^/]*)", 1)), F.when(inside == "", "/").otherwise(inside))
    kept = F.array_sort(F.filter(F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.concat(place, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def dedupe_key(url: Column) -> Column:
    """Neither query nor fragment nor the slash at the end, in lower case."""
    return F.lower(F.regexp_replace(F.regexp_extract(url, r"^([^?#]*)", 1), "/+$", ""))


def identity(url: Column) -> Column:
    """struct(scheme, host, port, path, query): default ports filled in, fragment ignored."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z]+)://", 1))
    port = F.regexp_extract(url, r"^[A-Za-z]+://[^/?#:]+:([0-9]+)", 1)
    return F.struct(scheme.alias("scheme"), F.lower(F.regexp_extract(url, r"^[A-Za-z]+://([^/?#:]+)", 1)).alias("host"), F.when(port != "", port.cast("int")).when(scheme == "https", 443).otherwise(80).alias("port"), F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]+([^?#]*)", 1).alias("path"), F.regexp_extract(url, r"\?([^#]*)", 1).alias("query"))


def paged(url: Column) -> Column:
    """https, and of the query only a positive page number; null where the page is not one."""
    page = F.regexp_extract(url, r"[?&]page=([^&#]*)", 1)
    base = F.concat(F.lit("https://"), F.regexp_replace(F.regexp_extract(url, r"^([^?#]*)", 1), "^[A-Za-z]+://", ""))
    return F.when(page == "", base).when(page.rlike("^[1-9][0-9]*$"), F.concat(base, F.lit("?page="), page))


def expand(template: Column, article: Column) -> Column:
    return F.replace(template, F.lit("{article}"), F.replace(F.url_encode(article), F.lit("+"), F.lit("%20")))


def is_asset(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([^?#]*)", 1)).rlike(ASSETS)
