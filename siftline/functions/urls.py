"""URL columns: normalising, validation, parts, titles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def without_fragment(url: Column) -> Column:
    return F.regexp_replace(F.trim(url), "#.*$", "")


def netloc(url: Column) -> Column:
    return F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def path(url: Column) -> Column:
    return F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def is_valid(url: Column) -> Column:
    """http or https with a host part."""
    return F.coalesce(F.lower(F.regexp_extract(url, "^([A-Za-z][A-Za-z0-9+.-]*):", 1)).isin("http", "https") & (netloc(url) != ""), F.lit(False))


def domain(url: Column) -> Column:
    """Host without www. and port; the url itself where it has none."""
    host = F.lower(F.regexp_replace(F.regexp_replace(netloc(url), "^[^@]*@", ""), ":[0-9]*$", ""))
    return F.when(host == "", url).otherwise(F.regexp_replace(host, r"^www\.", ""))


def shown_path(url: Column) -> Column:
    return F.when(netloc(url) == "", "").otherwise(F.when(path(url) == "/", "").otherwise(path(url)))


def initial(of_domain: Column) -> Column:
    first = F.upper(F.substring(F.regexp_replace(of_domain, "[^a-zA-Z0-9]", ""), 1, 1))
    return F.when(first == "", "W").otherwise(first)


def favicon(url: Column) -> Column:
    return F.when(is_valid(url), F.concat(F.regexp_extract(url, "^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1), F.lit("/favicon.ico")))


def display_title(title: Column, url: Column) -> Column:
    """The title; else the path's last segment made readable; else the host; else a constant."""
    parts = F.filter(F.split(path(url), "/"), lambda p: p != "")
    last = F.try_url_decode(F.regexp_replace(F.element_at(parts, -1), r"\+", "%2B"))
    words = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(last, r"(?i)\.[a-z0-9]+$", ""), "[-_]+", " "), r"\s+", " "))
    # Only first letters rise; the others stay.
    risen = F.array_join(F.transform(F.split(words, " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))), " ")
    own = F.trim(F.coalesce(title, F.lit("")))
    segment = F.when(F.size(parts) > 0, F.when(words != "", risen))
    return F.when(own != "", own).when(is_valid(url), F.coalesce(segment, domain(url))).otherwise("Search result")


def session_key(url: Column, depth: int | None) -> Column:
    return F.sha2(F.concat(without_fragment(url), F.lit(f"|depth={'unlimited' if depth is None else depth}")), 256)
