"""Trees as tables of nodes, and nested patterns over them as joins on containment.

A node has the place where it begins (pre) and the place after it (post), so that one lies in another if it begins
between its two places. Patterns name kinds and tests of nodes, patterns for nodes inside them, and captures.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.markup import _bare
from quern.plans import flowrules
from quern.sources.store import spread

# Elements without an end tag.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
_TAG = r"""<(/?)([a-zA-Z][a-zA-Z0-9-]*)((?:\s+[^\s=<>"'/]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'<>]+))?)*)\s*/?>"""


def html_nodes(pages: DataFrame, html: str, *keys: str) -> DataFrame:
    """keys, pre, post, level, kind (the element's name) and text (its start tag) of every element.

    An end tag belongs to the start tag of its name at whose depth, among those of that name, it stands; one without a
    start tag counts for nothing. An element that is never closed ends with its page, a void one where it begins. level
    is the number of elements that are open where it begins.
    """
    tags = pages.select(*keys, F.posexplode(F.regexp_extract_all(_bare(F.col(html)), F.lit(_TAG), F.lit(0))).alias("pre", "text"))
    tags = tags.withColumn("kind", F.lower(F.regexp_extract("text", _TAG, 2))).withColumn("step", F.when(F.col("text").startswith("</"), -1).when(F.col("kind").isin(*VOID), 0).otherwise(1))
    named = Window.partitionBy(*keys, "kind").orderBy("pre")
    depth = F.sum("step").over(named.rowsBetween(Window.unboundedPreceding, 0))
    low = F.least(F.lit(0), F.min("depth").over(named.rowsBetween(Window.unboundedPreceding, 0)))  # end tags too many so far
    tags = tags.withColumn("depth", depth).withColumn("depth", F.col("depth") - low).withColumn("at", F.when(F.col("step") == -1, F.col("depth") + 1).otherwise(F.col("depth")))
    same = Window.partitionBy(*keys, "kind", "at").orderBy("pre").rowsBetween(1, Window.unboundedFollowing)
    end = F.min(F.when(F.col("step") == -1, F.col("pre"))).over(same)
    last = F.max("pre").over(Window.partitionBy(*keys)) + 1
    found = tags.withColumn("end", end).withColumn("last", last).filter("step >= 0").withColumn("post", F.when(F.col("step") == 0, F.col("pre")).otherwise(F.coalesce("end", "last")))
    ends = found.filter("step = 1").select(*keys, F.col("pre").alias("p"), F.lit(1).alias("d")).unionByName(found.filter("step = 1").select(*keys, F.col("post").alias("p"), F.lit(-1).alias("d")))
    sums = ends.groupBy(*keys, "p").agg(F.sum("d").alias("d"), F.sum(F.when(F.col("d") > 0, 1).otherwise(0)).alias("own"))
    level = sums.withColumn("level", F.sum("d").over(Window.partitionBy(*keys).orderBy("p")) - F.col("own")).select(*keys, F.col("p").alias("pre"), "level")
    return found.join(level, [*keys, "pre"], "left").select(*keys, "pre", "post", F.coalesce("level", F.lit(0)).cast("int").alias("level"), "kind", "text")


CODE = "rel_path string, pre int, post int, kind string, text string, line int"


def code_nodes(files: DataFrame) -> DataFrame:
    """rel_path, pre, post, kind, text and line of functions, types, branches, calls, bindings, strings and comments of files (rel_path, language, content).

    text is the name of a function or type, what is called or bound, or the text itself.
    """
    from quern.operators import dataflow, source

    def nodes(text: str, language: str) -> list[tuple]:
        f = dataflow.File(text, language)
        code, line = f.code, f.at.line
        out = [(*x["span"], "function", x["name"], x["start_line"]) for x in f.functions]
        out += [(*x["span"], "type", x["name"], x["start_line"]) for x in f.types]
        out += [(a, b, "branch", text[a:b].split(None, 1)[0], line(a)) for a, b in source._branches(f.at, code, language, f.pairs)]
        for k, t in enumerate(code):
            if t.kind == "string":
                out.append((t.start, t.end, "string", t.text, t.line))
            elif t.text == "(" and t.kind == "op" and k and code[k - 1].kind == "name" and code[k - 1].text not in source._WORDS_BEFORE_PAREN and (code[k - 1].line, code[k - 1].text) not in f.heads:
                out.append((code[k - 1].start, code[min(f.pairs.get(k, k), len(code) - 1)].end, "call", code[k - 1].text, t.line))
        out += [(t.start, t.end, "comment", t.text, t.line) for t in source.tokens(text, language) if t.kind == "comment"]
        out += [(text.rfind("\n", 0, s["at"]) + 1 if s["line"] == 1 else f.at.breaks[s["line"] - 2] + 1, s["at"], "binding", s["target"], s["line"]) for s in f.sites if s["kind"] == "def" and s["target"][:1] != "("]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = [(p, *n) for p, lang, t in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns)) for n in nodes(t or "", lang)]
                kinds = (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32())
                yield pa.RecordBatch.from_pydict({c.split()[0]: pa.array([r[k] for r in rows], kind) for k, (c, kind) in enumerate(zip(CODE.split(", "), kinds))})

    known = files.filter(F.col("language").isin(*flowrules.FAMILY))
    return spread(known.select("rel_path", "language", "content")).mapInArrow(run, CODE)


@dataclass(frozen=True)
class Pattern:
    """A node of a kind (or any) that a test in SQL holds for, with nodes inside it, or without them; capture names its place."""

    kind: str | None = None
    where: str | None = None
    capture: str | None = None
    inside: tuple["Pattern", ...] = ()
    lacks: tuple["Pattern", ...] = ()


#: Bits of a place: trees have fewer nodes, and files fewer characters, than that many bits can tell apart.
BITS = 31


def _cover(lo: Column, hi: Column) -> Column:
    """The blocks of lo <= place < hi: (bits, number) of at most two blocks of each power of two, which together are the range."""
    state = F.struct(lo.cast("int").alias("l"), hi.cast("int").alias("r"), F.array().cast("array<struct<k:int,b:int>>").alias("out"))

    def step(s: Column, k: Column) -> Column:
        on, left, right = s["l"] < s["r"], s["l"] % 2 == 1, s["r"] % 2 == 1
        one = lambda b: F.array(F.struct(k.cast("int").alias("k"), b.cast("int").alias("b")))
        out = F.when(on & left, F.concat(s["out"], one(s["l"]))).otherwise(s["out"])
        l = F.when(left, s["l"] + 1).otherwise(s["l"])
        out = F.when(on & right & (l < s["r"]), F.concat(out, one(s["r"] - 1))).otherwise(out)
        r = F.when(right, s["r"] - 1).otherwise(s["r"])
        return F.struct(F.shiftright(l, 1).alias("l"), F.shiftright(r, 1).alias("r"), out.alias("out"))

    bits = F.length(F.bin(F.greatest(hi.cast("int"), F.lit(0))))  # beyond them the range is empty
    return F.aggregate(F.sequence(F.lit(0), bits - 1), state, step)["out"]


def contained(outer: DataFrame, inner: DataFrame, *keys: str, how: str = "inner") -> DataFrame:
    """outer (keys, pre, post, ..) with the rows of inner (keys, in_pre, ..) that begin inside it.

    A range is dealt to a few blocks of places and a place to the blocks that hold it, one of each size that ranges of
    its keys have; they meet on keys and block on equality, each pair once, so neither a long file nor a wide node makes
    a task compare all with all. Nodes come of parsing, whose size Spark takes for that of the table that texts were
    built from, so the joins are told not to broadcast a side.
    """
    ranges = outer.withColumn("_c", F.explode(_cover(F.col("pre") + 1, F.col("post")))).withColumn("_k", F.col("_c.k")).withColumn("_b", F.col("_c.b")).drop("_c")
    sizes = ranges.groupBy(*keys).agg(F.collect_set("_k").alias("_ks"))  # BITS at most
    points = inner.join(sizes.hint("merge"), list(keys)).withColumn("_k", F.explode("_ks")).withColumn("_b", F.expr("shiftright(in_pre, _k)")).drop("_ks")
    if how == "inner":
        return ranges.join(points.hint("merge"), [*keys, "_k", "_b"]).drop("_k", "_b")
    met = ranges.join(points.hint("merge"), [*keys, "_k", "_b"], "left_semi").select(*keys, "pre").distinct()
    return outer.join(met.hint("merge"), [*keys, "pre"], how)


def matches(nodes: DataFrame, pattern: Pattern, *keys: str) -> DataFrame:
    """keys, and the place of every captured node, of each way in which the pattern fits."""
    return _matches(nodes, pattern, *keys).drop("pre", "post").distinct()


def _matches(nodes: DataFrame, p: Pattern, *keys: str) -> DataFrame:
    rows = nodes.filter(F.col("kind") == p.kind) if p.kind else nodes
    rows = rows.filter(p.where) if p.where else rows
    rows = rows.select(*keys, "pre", "post", *([F.col("pre").alias(p.capture)] if p.capture else []))
    for q in p.inside:
        found = _matches(nodes, q, *keys).drop("post").withColumnRenamed("pre", "in_pre")
        held = [c for c in found.columns if c not in keys and c != "in_pre"]
        rows = contained(rows, found.distinct(), *keys).drop("in_pre").distinct() if held else contained(rows, found.distinct(), *keys, how="left_semi")
    for q in p.lacks:
        rows = contained(rows, _matches(nodes, q, *keys).select(*keys, F.col("pre").alias("in_pre")).distinct(), *keys, how="left_anti")
    return rows
