"""URLs: resolution and canonical keys.

Exact serialisation (percent-encoding, dot segments, default ports) needs a URL
parser that Spark lacks, so these are Arrow pandas UDFs; hosts alone stay native.
"""

from __future__ import annotations

from urllib.parse import quote, urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hosts that serve one file namespace per site under several spellings; the first is canonical.
FLEET = (".wikidot.com", ".wdfiles.com")
_PORTS = {"http": 80, "https": 443}


def normalize(url: str, fragment: bool = False) -> str | None:
    """The URL as a browser writes it, or None if it is not absolute."""
    try:
        u = urlsplit(url.strip())
        port = u.port
    except ValueError:
        return None
    if not u.scheme or not (u.netloc or u.scheme not in ("http", "https", "ftp")):
        return None
    if not u.netloc:
        return url if fragment else url.split("#")[0]
    host = (u.hostname or "").encode("idna").decode() if not (u.hostname or "").isascii() else (u.hostname or "")
    if not host or any(c in host for c in ' <>[]|^%"'):
        return None
    if port is not None and port != _PORTS.get(u.scheme.lower()):
        host = f"{host}:{port}"
    path = quote(urlsplit(urljoin("http://h/", u.path or "/")).path or "/", safe="/%:@!$&'()*+,;=-._~|[]^\\")
    query = quote(u.query, safe="/%:@!$&()*+,;=-._~?|[]^\\`{}")
    return urlunsplit((u.scheme.lower(), host, path, query, quote(u.fragment, safe="/%:@!$&'()*+,;=-._~?") if fragment else ""))


def resolve(base: str, reference: str) -> str:
    """RFC 3986 merge; an absolute reference or data URL stays as it is."""
    if "://" in reference or reference.startswith("data:"):
        return reference
    merged = urljoin(base, reference)
    return normalize(merged, fragment=True) or merged


def fleet_key(site: str, url: str) -> str:
    """Canonical row key of a site in the fleet: every spelling of its host folds onto one."""
    clean = normalize(url)
    if clean is None:
        return url
    u = urlsplit(clean)
    host = (u.hostname or "").removeprefix("www.")
    for suffix in FLEET:
        if u.scheme in ("http", "https") and host.endswith(suffix) and len(host) > len(suffix):
            path = u.path.replace("%3A", ":").replace("%3a", ":")
            return f"http://{host.removesuffix(suffix)}{FLEET[0]}{path}" + (f"?{u.query}" if u.query else "")
    return clean


def own_key(host: str, url: str) -> str:
    """Canonical row key of a site with its own host: https and the configured spelling."""
    clean = normalize(url)
    if clean is None:
        return url
    u = urlsplit(clean)
    if u.scheme in ("http", "https") and (u.hostname or "").removeprefix("www.") == host.lower().removeprefix("www."):
        path = u.path.replace("%3A", ":").replace("%3a", ":")
        return f"https://{host.lower()}{path}" + (f"?{u.query}" if u.query else "")
    return clean


def _pairwise(function):
    @F.pandas_udf("string")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else function(x, y) for x, y in zip(a, b, strict=True)], dtype=object)

    return run


def resolve_url(base: Column, reference: Column) -> Column:
    return _pairwise(resolve)(base, reference)


def fleet_row_key(site: Column, url: Column) -> Column:
    return _pairwise(fleet_key)(site, url)


def own_row_key(host: Column, url: Column) -> Column:
    return _pairwise(own_key)(host, url)


def normalize_url(url: Column) -> Column:
    @F.pandas_udf("string")
    def run(a: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else (normalize(x) or x) for x in a], dtype=object)

    return run(url)


def folded_key(url: Column) -> Column:
    """Scheme, www and fragment folded natively: the cheap form of own_row_key for URLs that need no escaping."""
    return F.concat(F.lit("https://"), F.regexp_replace(F.regexp_replace(F.regexp_replace(url, "#.*$", ""), "^[A-Za-z]+://", ""), r"^www\.", ""))
