"""Project paths: candidates from clients, and prefixes of a host mapped to those of a container, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_mappings(text: str) -> list[tuple[str, str]]:
    """host=container pairs, separated by commas, the longest host first; entries without both sides are left out."""
    pairs = [(a.strip(), b.strip()) for a, sep, b in (e.partition("=") for e in text.split(",")) if sep]
    return sorted(((a.rstrip("/") or "/", b.rstrip("/") or "/") for a, b in pairs if a and b), key=lambda p: -len(p[0]))


def from_uri(value: Column) -> Column:
    """The path of a file: URI, decoded, with a host other than localhost before it and without the slash before a drive; other schemes give null, plain paths stay."""
    v = F.trim(value)
    scheme = F.lower(F.regexp_extract(v, r"^([A-Za-z][A-Za-z0-9+.-]+):", 1))
    rest = F.regexp_replace(F.regexp_extract(v, r"^[A-Za-z]+:([^?#]*)", 1), r"\+", "%2B")
    host = F.lower(F.regexp_extract(rest, r"^//([^/]*)", 1))
    raw = F.url_decode(F.regexp_replace(rest, r"^//[^/]*", ""))
    path = F.when((host != "") & (host != "localhost"), F.concat(F.lit("//"), host, raw)).otherwise(F.regexp_replace(raw, r"^/([A-Za-z]:)", "$1"))
    return F.nullif(F.when(scheme == "", v).when(scheme == "file", path), F.lit(""))


def normal(path: Column) -> Column:
    """An absolute path without empty parts, `.` and `..`."""
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    up = lambda acc, p: F.when(p != "..", F.concat(acc, F.array(p))).when(F.size(acc) > 0, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(acc)
    return F.concat(F.lit("/"), F.array_join(F.aggregate(parts, F.array().cast("array<string>"), up), "/"))


def candidates(values: Column) -> Column:
    """Normal paths of an array of paths and URIs, each once, in order."""
    paths = F.filter(F.transform(values, from_uri), lambda p: p.isNotNull())
    return F.array_distinct(F.transform(paths, normal))


def mapped(path: Column, mappings: list[tuple[str, str]]) -> Column:
    """The path with the longest host prefix replaced; as it is without one."""
    out = F
    for host, container in mappings:
        rest = F.substr(path, F.lit(len(host.rstrip("/")) + 1))
        out = out.when((path == host) | F.startswith(path, F.lit(host.rstrip("/") + "/")), F.concat(F.lit(container.rstrip("/")), rest))
    return out.otherwise(path) if mappings else path
