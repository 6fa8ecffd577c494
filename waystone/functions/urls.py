"""Column functions on URLs (URL-01 to URL-08)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hosts of the regional directories, a fixed value of the domain.
DIRECTORY_HOSTS = ("www.michi-no-eki.jp", "michi-no-eki.jp")
_URL = r"^(https?)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"


def part(url: Column, n: int) -> Column:
    """1 scheme, 2 authority, 3 path, 4 query, 5 fragment; empty if there is none or the URL is malformed."""
    return F.regexp_extract(F.trim(url), _URL, n)


def safe_official(url: Column, hosts: Column, path_pattern: Column) -> Column:
    """URL-01: https, the host in the allow-list, no user and no port, the whole path as the rule wants it."""
    host = F.lower(part(url, 2))
    path = part(url, 3)
    return F.coalesce((part(url, 1) == "https") & ~F.rlike(host, F.lit("[@:]")) & F.array_contains(hosts, host) & F.rlike(path, F.concat(F.lit("^(?:"), path_pattern, F.lit(")$"))), F.lit(False))


def url_key(url: Column) -> Column:
    """URL-02: https, lower host, path decoded and encoded again without last slashes ("/" stays), query, no fragment;
    empty if the URL is not https or names a user."""
    host = F.lower(part(url, 2))
    path = F.coalesce(F.try_url_decode(F.replace(part(url, 3), F.lit("+"), F.lit("%2B"))), part(url, 3))
    path = F.url_encode(F.regexp_replace(path, "/+$", ""))
    # form encoding writes a space as +, keeps * and encodes what may stay in a path
    for code, sign in (("+", "%20"), ("%2F", "/"), ("%7E", "~"), ("*", "%2A")):
        path = F.replace(path, F.lit(code), F.lit(sign))
    ok = (part(url, 1) == "https") & (F.regexp_replace(host, ":.*$", "") != "") & ~F.rlike(host, F.lit("@"))
    return F.when(ok, F.concat(F.lit("https://"), F.regexp_replace(host, ":[0-9]*$", ""), F.when(path == "", "/").otherwise(path), part(url, 4))).otherwise("")


def resolve(href: Column, base: Column) -> Column:
    """URL-03: an absolute https URL on the base's host, without fragment; null if it leads elsewhere."""
    link = F.regexp_replace(F.trim(href), "#.*$", "")
    host, path = F.lower(part(base, 2)), part(base, 3)
    root = F.concat(F.lit("https://"), host)
    folder = F.regexp_replace(F.when(path == "", "/").otherwise(path), "[^/]*$", "")
    full = (
        F.when(F.rlike(link, F.lit("^https?://")), link)
        .when(link.startswith("//"), F.concat(F.lit("https:"), link))
        .when(link.startswith("/"), F.concat(root, link))
        .when(link.startswith("?"), F.concat(root, path, link))
        .when(F.rlike(link, F.lit("^[a-zA-Z][a-zA-Z0-9+.-]*:")), None)
        .when(link == "", None)
        .otherwise(F.concat(root, folder, link))
    )
    return F.when((F.lower(part(full, 2)) == host) & (part(full, 1) == "https"), full)


def classify(url: Column) -> Column:
    """URL-04: invalid, regional_directory, municipal or station_or_partner."""
    host = F.lower(part(url, 2))
    return (
        F.when(F.coalesce(host, F.lit("")) == "", "invalid")
        .when(host.isin(*DIRECTORY_HOSTS), "regional_directory")
        .when(F.rlike(host, F.lit(r"\.(lg|go)\.jp$|^(city|town|vill|pref)\.|\.(city|town|vill|pref)\.")), "municipal")
        .otherwise("station_or_partner")
    )


def with_upgrade(url: Column) -> Column:
    """URL-05: (url, original) rows: the URL itself and, for http, its https form that points back at it."""
    own = F.struct(url.alias("url"), F.lit(None).cast("string").alias("upgraded_from"))
    more = F.struct(F.regexp_replace(url, "^http:", "https:").alias("url"), url.alias("upgraded_from"))
    return F.when(url.startswith("http:"), F.array(own, more)).otherwise(F.array(own))


def article_id(url: Column) -> Column:
    """URL-06: the digits of the `article` query key, or null."""
    return F.nullif(F.regexp_extract(part(url, 4), "[?&]article=([0-9]+)", 1), F.lit(""))


def pinned(url: Column, start: Column) -> Column:
    """URL-06: the article's URL with the event's start date; other URLs stay."""
    return F.when(article_id(url).isNotNull(), F.concat(F.regexp_replace(url, r"\?.*$", ""), F.lit("?article="), article_id(url), F.lit("&start="), start.cast("string"))).otherwise(url)


def websites(fields: list[Column], banned: list[str]) -> Column:
    """URL-07: the distinct safe URLs among several fields, sorted, without banned host suffixes."""
    bad = "(^|\\.)(" + "|".join(b.replace(".", "\\.") for b in banned) + ")$"
    good = lambda u: u.isNotNull() & F.rlike(F.coalesce(part(u, 1), F.lit("")), F.lit("^https?$")) & ~F.rlike(F.lower(part(u, 2)), F.lit(bad))
    return F.array_sort(F.array_distinct(F.filter(F.array(*[F.trim(f) for f in fields]), good)))


#: Patterns of coordinates in map URLs, a fixed value of the domain.
MAP_PATTERNS = (r"@(-?[0-9]+\.[0-9]+),(-?[0-9]+\.[0-9]+)", r"!3d(-?[0-9]+\.[0-9]+)!4d(-?[0-9]+\.[0-9]+)", r"[?&](?:q|query|ll|destination)=(-?[0-9]+\.[0-9]+),(-?[0-9]+\.[0-9]+)", r"(?:^|[^0-9.])(-?[0-9]{2}\.[0-9]+),\s*(-?[0-9]{3}\.[0-9]+)")


def map_coordinates(url: Column) -> Column:
    """URL-08: (lat, lng) from the raw or the decoded URL, inside the bounding box of Japan, else null."""
    both = [url, F.coalesce(F.try_url_decode(url), url)]
    pick = lambda n: F.coalesce(*[F.nullif(F.regexp_extract(u, p, n), F.lit("")) for u in both for p in MAP_PATTERNS]).cast("double")
    lat, lng = pick(1), pick(2)
    return F.when(lat.between(20, 46) & lng.between(122, 154), F.struct(lat.alias("lat"), lng.alias("lng")))
