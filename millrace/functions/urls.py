"""URL expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Parameters that only track where a reader came from.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "ref", "source", "fbclid", "gclid", "msclkid", "dclid", "_ga", "_gl", "mc_eid", "mc_cid")


def resolve(url: Column, base: Column) -> Column:
    """An address relative to a base made absolute; absolute ones stay."""
    root = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^?#]*/)", 1)
    folder = F.when(folder == "", F.concat(root, F.lit("/"))).otherwise(folder)
    scheme = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1)
    return (
        F.when(base.isNull() | url.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), url)
        .when(url.startswith("//"), F.concat(scheme, url))
        .when(url.startswith("/"), F.concat(root, url))
        .when(url == "", base)
        .when(url.startswith("?") | url.startswith("#"), F.concat(F.regexp_extract(base, r"^([^?#]*)", 1), url))
        .otherwise(F.concat(folder, url))
    )


def _decoded(x: Column) -> Column:
    """A part of a query as plain text; one that isn't encoded properly stays as it is."""
    return F.coalesce(F.try_url_decode(x), x)


def _encoded(x: Column) -> Column:
    """Form encoding: a blank is a plus, all but letters, digits and _.-~ in hex."""
    return F.replace(F.replace(F.url_encode(x), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def clean_query(query: Column) -> Column:
    """The parameters of a query encoded anew, without tracking ones; a name that repeats has its values together, where it came first."""
    named = F.transform(F.filter(F.split(query, "&"), lambda p: p != ""), lambda p: F.struct(_decoded(F.regexp_extract(p, "^([^=]*)", 1)).alias("k"), _decoded(F.regexp_extract(p, "^[^=]*=(.*)$", 1)).alias("v")))
    tracking = F.array(*map(F.lit, TRACKING))
    kept = F.filter(named, lambda p: ~F.array_contains(tracking, F.lower(p["k"])))

    def ordered(all_: Column) -> Column:
        names = F.transform(all_, lambda p: p["k"])
        placed = F.transform(all_, lambda p, i: F.struct(F.array_position(names, p["k"]).alias("first"), i.alias("at"), F.concat(_encoded(p["k"]), F.lit("="), _encoded(p["v"])).alias("text")))
        return F.array_join(F.transform(F.array_sort(placed), lambda x: x["text"]), "&")

    return F.element_at(F.transform(F.array(kept), ordered), 1)  # bound once, not once for each parameter


def normalize(url: Column, base: Column | None = None) -> Column:
    """A canonical address: absolute, https, without tracking parameters and fragment, the query encoded anew; blank parameter values stay."""
    url = F.trim(url) if base is None else resolve(F.trim(url), base)
    url = F.regexp_replace(url, r"#.*$", "")
    url = F.regexp_replace(url, r"^(?i:https?)://", "https://")
    url = F.when(url.rlike(r"^//"), F.concat(F.lit("https:"), url)).otherwise(url)
    head, query = F.regexp_extract(url, r"^([^?]*)", 1), F.regexp_extract(url, r"\?(.*)$", 1)
    kept = clean_query(query)
    return F.when(kept == "", head).otherwise(F.concat(head, F.lit("?"), kept))


def dedupe_key(url: Column) -> Column:
    """What counts as one address: lower case, no www., no closing slash of the path, no fragment; scheme and query count."""
    url = F.regexp_replace(F.lower(F.trim(url)), r"#.*$", "")
    url = F.regexp_replace(url, r"^([a-z][a-z0-9+.-]*://)www\.", "$1")
    return F.regexp_replace(url, r"/+(\?|$)", "$1")


def domain(url: Column) -> Column:
    return F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:www\.)?([^/?#:]*)", 1)


def cache_key(url: Column) -> Column:
    return F.md5(url.cast("binary"))


#: What addresses of posts and pages look like.
POST_ADDRESS = r"(?:x\.com|twitter\.com)/\w+/status/(\d+)"
PAGE_ADDRESS = r"notion\.so/.*?([a-f0-9]{32})"


def post_id(url: Column) -> Column:
    """The id of a post in its address, or null."""
    return F.nullif(F.regexp_extract(url, POST_ADDRESS, 1), F.lit(""))


def page_uuid(url: Column) -> Column:
    """32 hex digits of a page's address as 8-4-4-4-12, or null."""
    raw = F.nullif(F.regexp_extract(url, PAGE_ADDRESS, 1), F.lit(""))
    return F.regexp_replace(raw, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def post_url(username: Column, post: Column) -> Column:
    return F.concat(F.lit("https://x.com/"), username, F.lit("/status/"), post)
