"""Elements of HTML and rules of CSS as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names with a hyphen that are no custom elements.
KNOWN_HYPHENS = ("accept-charset", "annotation-xml", "color-profile", "font-face", "font-face-src", "font-face-uri", "font-face-format", "font-face-name", "missing-glyph")
_OPEN = r"""<([a-zA-Z][a-zA-Z0-9-]*)((?:\s+[^\s=<>"'/]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'<>]+))?)*)\s*/?>"""
_NO_MARKUP = r"(?s)<!--.*?-->|(<script\b[^>]*>).*?</script>|(<style\b[^>]*>).*?</style>"


def _bare(html: Column) -> Column:
    """html with comments out and the contents of scripts and styles emptied; line breaks stay where they were not inside."""
    return F.regexp_replace(html, _NO_MARKUP, "$1$2")


def elements(pages: DataFrame, html: str, *keep: str) -> DataFrame:
    """keep, pos, tag_name, class_names, inputs, outputs and is_component of every start tag, in order.

    [x] binds an input, [class.y] a class, (e) an output; a component's name has a hyphen and is none of KNOWN_HYPHENS.
    """
    tags = F.regexp_extract_all(_bare(F.col(html)), F.lit(_OPEN), F.lit(0))
    each = pages.select(*keep, F.posexplode(tags).alias("pos", "tag"))
    each = each.withColumn("tag_name", F.regexp_extract("tag", r"^<([a-zA-Z][a-zA-Z0-9-]*)", 1))
    names = F.regexp_extract_all("tag", F.lit(r"""\s([^\s=<>"'/]+)(?=[\s=>/])(?=(?:[^"']|"[^"]*"|'[^']*')*$)"""), F.lit(1))
    classes = F.filter(F.split(F.coalesce(F.nullif(F.regexp_extract("tag", r"""\sclass\s*=\s*"([^"]*)\"""", 1), F.lit("")), F.regexp_extract("tag", r"""\sclass\s*=\s*'([^']*)'""", 1)), r"\s+"), lambda x: x != "")
    inner = lambda x: F.regexp_replace(x, r"^[\[(]|[\])]$", "")
    bound = F.filter(names, lambda x: F.regexp_like(x, F.lit(r"^\[.*\]$")))
    inputs = F.transform(F.filter(bound, lambda x: ~x.startswith("[class.")), inner)
    more = F.transform(F.filter(bound, lambda x: x.startswith("[class.")), lambda x: F.regexp_replace(inner(x), r"^class\.", ""))
    outputs = F.transform(F.filter(names, lambda x: F.regexp_like(x, F.lit(r"^\(.*\)$"))), inner)
    component = F.col("tag_name").contains("-") & ~F.col("tag_name").isin(*KNOWN_HYPHENS)
    return each.select(*keep, "pos", "tag_name", F.concat(classes, more).alias("class_names"), inputs.alias("inputs"), outputs.alias("outputs"), component.alias("is_component"))


def css_rules(sheets: DataFrame, css: str, *keep: str) -> DataFrame:
    """keep, pos, selector, properties and media_query of every rule set.

    Rules inside an @media block have its condition; the blocks are taken first and what is left has none.
    """
    text = F.regexp_replace(F.col(css), r"(?s)/\*.*?\*/", "")
    media = r"@media([^{]*)\{((?:[^{}]*\{[^{}]*\})*[^{}]*)\}"
    inside = sheets.select(*keep, F.explode(F.regexp_extract_all(text, F.lit(media), F.lit(0))).alias("block"))
    inside = inside.select(*keep, F.trim(F.regexp_extract("block", media, 1)).alias("media_query"), F.regexp_extract("block", media, 2).alias("body"))
    outside = sheets.select(*keep, F.lit(None).cast("string").alias("media_query"), F.regexp_replace(text, media, "").alias("body"))
    rules = outside.unionByName(inside).select(*keep, "media_query", F.posexplode(F.regexp_extract_all("body", F.lit(r"[^{}]+\{[^{}]*\}"), F.lit(0))).alias("pos", "rule"))
    properties = F.transform(F.filter(F.split(F.regexp_extract("rule", r"\{([^{}]*)\}", 1), ";"), lambda x: x.contains(":")), lambda x: F.trim(F.substring_index(x, ":", 1)))
    return rules.select(*keep, "pos", F.trim(F.regexp_extract("rule", r"^([^{}]+)\{", 1)).alias("selector"), properties.alias("properties"), "media_query")


def inline_css(pages: DataFrame, html: str, *keep: str) -> DataFrame:
    """css_rules of all style elements of pages."""
    styles = pages.select(*keep, F.explode(F.regexp_extract_all(F.col(html), F.lit(r"(?s)<style\b[^>]*>(.*?)</style>"), F.lit(1))).alias("_css"))
    return css_rules(styles, "_css", *keep)
