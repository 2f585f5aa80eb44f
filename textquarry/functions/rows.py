"""Predicates and row rules: glob keys, expiry, progress, file manifests, paths, HTTP status."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Categories that papers may have.
CATEGORIES = (
    "cs.AI", "cs.CL", "cs.CV", "cs.LG", "cs.NE", "stat.ML", "cs.CR", "cs.DC", "cs.DS", "cs.DB", "cs.GL", "cs.GR",
    "cs.AR", "cs.CC", "cs.CE", "cs.IT", "cs.LO", "cs.MA", "cs.MM", "cs.MS", "cs.NA", "cs.NI", "cs.OH", "cs.OS",
    "cs.PF", "cs.PL", "cs.RO", "cs.SC", "cs.SD", "cs.SE",
)


def known_category(category: Column) -> Column:
    return category.isin(*CATEGORIES)


def matches_glob(key: Column, pattern: str) -> Column:
    """Whether a key matches a pattern of * and ?."""
    return key.rlike("^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + "$")


def expired(stored: Column, ttl_seconds: Column, as_of: Column) -> Column:
    """Whether an entry is older than its time to live; without one it never is."""
    age = F.unix_timestamp(as_of.cast("timestamp")) - F.unix_timestamp(stored.cast("timestamp"))
    return F.coalesce(age > ttl_seconds, F.lit(False))


def progress(done: Column, total: Column, elapsed: Column) -> Column:
    """Percentage done and seconds left at the rate so far (null before the first)."""
    return F.struct(
        F.when(total > 0, F.round(100.0 * done / total, 4)).otherwise(F.lit(0.0)).alias("percent"),
        F.when((done > 0) & (elapsed > 0), F.round((total - done) / (done / elapsed), 4)).alias("seconds_left"),
    )


def file_problems(name: Column, size: Column, extensions: tuple[str, ...] = ("pdf", "txt", "md", "html"), most: int = 10 << 20) -> Column:
    """Reasons against a file of a manifest."""
    rules = {
        "extension": ~F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1)).isin(*extensions),
        "size": size > most,
        "empty": size == 0,
        "traversal": F.contains(name, F.lit("..")),
        "name": ~name.rlike(r"^[A-Za-z0-9._ /-]+$"),
    }
    return F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in rules.items())))


def excluded_path(path: Column, exact: tuple[str, ...] = ("/health", "/metrics"), prefixes: tuple[str, ...] = ("/static/", "/docs")) -> Column:
    out = path.isin(*exact)
    for p in prefixes:
        out |= F.startswith(path, F.lit(p))
    return out


def succeeded(status: Column) -> Column:
    """HTTP status from 200 up to but not 400."""
    return (status >= 200) & (status < 400)
