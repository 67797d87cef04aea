"""Scalar functions over names, signatures, paths and ratings."""

from __future__ import annotations


from pyspark.sql import Column
from pyspark.sql import functions as F

# Ranks, weights and mappings of ratings.
SEVERITY_RANK = {"low": 0, "medium": 1, "high": 2, "critical": 3}
SEVERITY_WEIGHT = {"critical": 10, "high": 6, "medium": 3, "low": 1}
CONFIDENCE_WEIGHT = {"high": 10, "medium": 6, "low": 3}
SARIF_LEVEL = {"critical": "error", "high": "error", "medium": "warning", "low": "note"}
SARIF_SCORE = {"critical": "9.5", "high": "7.5", "medium": "5.0", "low": "2.0"}


def mapped(column: Column, values: dict, otherwise: Column | None = None) -> Column:
    out = F
    for k, v in values.items():
        out = out.when(column == k, F.lit(v))
    return out if otherwise is None else out.otherwise(otherwise)


def escalated(severity: Column) -> Column:
    """One level higher, for a write."""
    return mapped(severity, {"low": "medium", "medium": "high", "high": "critical", "critical": "critical"})


def comment_sign(language: Column) -> Column:
    return F.when(F.lower(language).isin("python", "ruby", "shell", "bash", "yaml", "yml"), "#").otherwise("//")


def one_line(signature: Column) -> Column:
    """A signature with its white space collapsed; null if nothing is left."""
    return F.nullif(F.trim(F.regexp_replace(signature, r"\s+", " ")), F.lit(""))


def first_line(doc: Column) -> Column:
    """The first line of a comment that says something, without its signs."""
    lines = F.transform(F.split(doc, r"\r?\n"), lambda x: F.trim(F.regexp_replace(F.trim(x), r"^(///?!?|//!|/\*\*?|\*/|\*|#+|\"\"\"|''')\s?", "")))
    return F.get(F.filter(lines, lambda x: x != ""), F.lit(0))


def normal_path(path: Column) -> Column:
    """A path without . and .. steps."""
    parts = F.filter(F.split(path, "/"), lambda x: ~x.isin("", "."))
    empty = F.array().cast("array<string>")
    steps = F.aggregate(parts, empty, lambda a, x: F.when((x == "..") & (F.size(a) > 0) & (F.element_at(a, -1) != ".."), F.slice(a, 1, F.size(a) - 1)).otherwise(F.concat(a, F.array(x))))
    return F.concat(F.when(path.startswith("/"), "/").otherwise(""), F.array_join(steps, "/"))


def internal_reference(path: Column) -> Column:
    """A module reference as a path: separators to slashes, without crate, self and super in front."""
    path = F.regexp_replace(F.replace(path, F.lit("::"), F.lit("/")), r"(?<![./])\.(?![./])", "/")
    return F.regexp_replace(path, r"^((crate|self|super)/)+", "")


def import_kind(path: Column, language: Column) -> Column:
    """internal for relative paths and the own crate, else external."""
    rust = (language == "rust") & F.regexp_like(path, F.lit(r"^(crate|self|super)(::|$)"))
    return F.when(F.regexp_like(path, F.lit(r"^\.{1,2}")) | rust, "internal").otherwise("external")


def namespace(path: Column) -> Column:
    """The first segment of an external name."""
    return F.regexp_extract(path, r"^(@[^/]+/[^/]+|[^./:]+)", 1)


def context_of(path: Column, detectors: tuple[str, ...] = ()) -> Column:
    """fixture, detector_definition, test or production, in that order of precedence."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    detector = p.endswith(".md")
    for d in detectors:
        detector = detector | p.contains(d)
    test = p.startswith("tests/") | p.contains("/tests/") | p.contains("_test.") | p.contains("/test_") | p.endswith("/tests.rs")
    return F.when(p.contains("tests/fixtures/"), "fixture").when(detector, "detector_definition").when(test, "test").otherwise("production")


def backoff_ms(failures: Column) -> Column:
    """Delay after that many failures: none before the third, then doubling from 250 up to 2000."""
    return F.when(failures < 3, F.lit(0)).otherwise(F.least(F.lit(2000), (F.lit(250) * F.pow(F.lit(2), F.least(F.lit(4), failures - 3))).cast("int")))


def under(path: Column, root: Column) -> Column:
    """Whether a path, its . and .. steps taken, is a root or lies below it."""
    p, r = normal_path(path), F.regexp_replace(normal_path(root), "(?<=.)/+$", "")
    return (p == r) | p.startswith(F.concat(F.when(r == "/", F.lit("")).otherwise(r), F.lit("/")))


def uri_path(uri: Column) -> Column:
    """The path of a file URI, or of what begins with a slash; null for others and for broken escapes."""
    rest = F.regexp_replace(uri, "^file://(localhost)?", "")
    broken = F.regexp_like(rest, F.lit("%(?![0-9A-Fa-f]{2})"))
    path = F.when(~broken, F.try_url_decode(F.replace(rest, F.lit("+"), F.lit("%2B"))))
    path = F.regexp_replace(path, "^/([A-Za-z]:)", "$1")
    return F.when(uri.startswith("file://"), path).when(uri.startswith("/"), uri)


def token_digest(token: Column) -> Column:
    """A digest of fixed length of a token, by which tokens are compared."""
    return F.sha2(token.cast("binary"), 256)


def utilisation(entries: Column, most: Column) -> Column:
    """Entries as a percentage of the most there may be; 0 where that is 0."""
    return F.when(most == 0, F.lit(0.0)).otherwise(entries * 100.0 / most)


def sorted_json(values: Column) -> Column:
    """A map as compact JSON with its keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(values))))


def canonical_json(text: Column) -> Column:
    """JSON text of any depth, compact and with the keys of each object in order; null where it is no JSON, or has a key twice in an object."""
    return F.to_json(F.try_parse_json(text))
