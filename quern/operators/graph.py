"""Dependency graphs as edge tables (src, dst, kind)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import import_kind, internal_reference, namespace, normal_path
from quern.operators.scans import running
from quern.sources.store import kept

MAX_DEPTH, MAX_NODES, MAX_EDGES = 5, 200, 100
KINDS_REVERSED = ("internal", "restricted")


def reversed_edges(edges: DataFrame) -> DataFrame:
    """dst depends on src: edges to files of the tree, turned around."""
    return edges.filter(F.col("kind").isin(*KINDS_REVERSED)).select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit("dependent").alias("kind"))


def merged(edges: DataFrame) -> DataFrame:
    """Edges and their reverse."""
    return edges.unionByName(reversed_edges(edges))


def fan(edges: DataFrame) -> DataFrame:
    """name, fan_out and fan_in of every node."""
    each = edges.select(F.col("src").alias("name"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("dst").alias("name"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return each.groupBy("name").agg(F.sum("o").alias("fan_out"), F.sum("i").alias("fan_in"))


def hotspots(edges: DataFrame, k: int, by: str = "fan_out") -> DataFrame:
    other = "fan_in" if by == "fan_out" else "fan_out"
    return fan(edges).orderBy(F.desc(by), F.desc(other), "name").limit(k)


def within(edges: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """name and depth of the nodes that roots (name) reach in up to depth steps (5 at most), at their least depth.

    One join a step, each with the nodes first met in the step before.
    """
    seen = roots.select("name").distinct().withColumn("depth", F.lit(0))
    front, steps = seen, edges.select("src", "dst").distinct()
    for d in range(1, min(depth, MAX_DEPTH) + 1):
        new = front.join(steps, F.col("name") == F.col("src")).select(F.col("dst").alias("name")).distinct().join(seen, "name", "left_anti").withColumn("depth", F.lit(d))
        seen, front = seen.unionByName(new), new
    return seen


def cycles(edges: DataFrame) -> DataFrame:
    """members (sorted) of each strongly connected component of two nodes or more, and of each node with an edge to itself.

    Nodes without an edge in or out among the rest are peeled off first. Then each node takes the largest name that
    reaches it as its colour; the nodes of a colour that lead back to the node of that name are its component, and the
    rest goes another round. Rows never exceed edges and nodes, and lineage is cut at each step.
    """
    kind = edges.schema["src"].dataType.simpleString()
    loops = edges.filter("src = dst").select(F.col("src").alias("name")).distinct()
    left = kept(edges.filter("src != dst").select("src", "dst").distinct())
    found = left.sparkSession.createDataFrame([], f"root {kind}, name {kind}")
    while True:
        size = -1
        while (now := left.count()) != size:  # peel
            size = now
            left = kept(left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
        if not size:
            break
        colour = left.select(F.col("src").alias("name")).distinct().withColumn("colour", F.col("name"))
        while True:
            reached = left.join(colour, F.col("src") == F.col("name")).select(F.col("dst").alias("name"), F.col("colour").alias("by"))
            new = kept(colour.join(reached.groupBy("name").agg(F.max("by").alias("by")), "name", "left").select("name", F.greatest("colour", F.coalesce("by", "colour")).alias("colour"), (F.col("by") > F.col("colour")).alias("more")))
            colour = new.select("name", "colour")
            if not new.filter("more").limit(1).count():
                break
        inside = left.join(colour.withColumnRenamed("name", "src").withColumnRenamed("colour", "root"), "src").join(colour.withColumnRenamed("name", "dst").withColumnRenamed("colour", "other"), "dst").filter("root = other").select("root", "src", "dst")
        member = front = kept(colour.filter("name = colour").select(F.col("colour").alias("root"), "name"))
        while front.limit(1).count():
            front = kept(inside.join(front.withColumnRenamed("name", "dst"), ["root", "dst"]).select("root", F.col("src").alias("name")).distinct().join(member, ["root", "name"], "left_anti"))
            member = member.unionByName(front)
        member = kept(member)
        found = found.unionByName(member)
        gone = member.select("name")
        left = kept(left.join(gone.withColumnRenamed("name", "src"), "src", "left_anti").join(gone.withColumnRenamed("name", "dst"), "dst", "left_anti").select("src", "dst"))
    groups = found.groupBy("root").agg(F.array_sort(F.collect_list("name")).alias("members")).filter(F.size("members") > 1)
    single = loops.join(groups.select(F.explode("members").alias("name")), "name", "left_anti").select(F.array("name").alias("members"))
    return groups.select("members").unionByName(single)


def coverage(imports: DataFrame) -> DataFrame:
    """Totals of imports (src, dst, kind), distinct libraries and the share of internal ones that were resolved."""
    resolved, open_ = F.count_if(F.col("kind").isin("internal", "restricted")), F.count_if(F.col("kind") == "unresolved")
    return imports.agg(F.count("src").alias("imports_total"), resolved.alias("resolved"), open_.alias("unresolved"), F.countDistinct(F.when(F.col("kind") == "external", F.col("dst"))).alias("libraries"), F.when(resolved + open_ == 0, F.lit(1.0)).otherwise(resolved / (resolved + open_)).alias("coverage"))


def capped(edges: DataFrame, k: int) -> DataFrame:
    """The first k edges of each node, by destination."""
    w = Window.partitionBy("src").orderBy("dst", "kind")
    return edges.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= min(k, MAX_EDGES)).drop("_n")


def within_budget(rows: DataFrame, size: str, limit: int, *order: str, by: tuple[str, ...] = ()) -> DataFrame:
    """The rows whose running sum of size, in order (within by), stays within limit; order must tell the rows of a key apart."""
    return running(rows, by, order, size, "used").filter(F.col("used") <= limit)


def typed(edges: DataFrame, external: bool = False, unresolved: bool = False) -> DataFrame:
    """The edges without those to libraries and without open ones, unless they are asked for."""
    out = [k for k, on in (("external", external), ("unresolved", unresolved)) if not on]
    return edges.filter(~F.col("kind").isin(*out)) if out else edges


def dependency_lists(edges: DataFrame) -> DataFrame:
    """src, imports_total, resolved_internal, unresolved_actionable, and the sorted distinct internal, restricted, external and unresolved names of each file."""
    names = lambda kind: F.array_sort(F.collect_set(F.when(F.col("kind") == kind, F.col("dst")))).alias(kind)
    n = lambda *kinds: F.count_if(F.col("kind").isin(*kinds))
    return edges.groupBy("src").agg(F.count("kind").alias("imports_total"), n("internal", "restricted").alias("resolved_internal"), n("unresolved").alias("unresolved_actionable"), *[names(k) for k in ("internal", "restricted", "external", "unresolved")])


def rendered(edges: DataFrame, compact: bool = True) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, kind) and edges (src, dst, label), each once and in order; external names as their first segment if compact."""
    dst = F.when(F.col("kind") == "external", namespace(F.col("dst"))).otherwise(F.col("dst")) if compact else F.col("dst")
    each = edges.select("src", dst.alias("dst"), F.col("kind").alias("label")).distinct()
    ends = each.select(F.col("src").alias("id"), F.lit("file").alias("kind")).unionByName(each.select(F.col("dst").alias("id"), F.when(F.col("label").isin("external", "unresolved"), F.col("label")).otherwise("file").alias("kind")))
    nodes = ends.groupBy("id").agg(F.max_by("kind", F.col("kind") == "file").alias("kind")).orderBy("id")
    return nodes, each.orderBy("src", "dst", "label")


def bounded(asked: dict, name: str, default: int, most: int) -> tuple[int, list[str]]:
    """A limit as it was asked for, the default where it is not there or no number, at most so large; and what was adjusted."""
    if name not in asked:
        return default, []
    value = asked[name]
    if isinstance(value, bool) or not isinstance(value, int) or value < 0:
        return default, [f"{name}: invalid value; using default {default}"]
    if value >= 1 << 64:
        return default, [f"{name}: overflow; using default {default}"]
    return (most, [f"{name}: clamped from {value} to {most}"]) if value > most else (value, [])


def trimmed(nodes: DataFrame, edges: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges whose JSON stays within limit bytes: edges go first, from the last one, then nodes. Meant for graphs of up to MAX_NODES nodes."""
    size = F.octet_length(F.to_json(F.struct("*"))) + 1
    nodes, edges = nodes.withColumn("_size", size), edges.withColumn("_size", size)
    used = nodes.agg(F.coalesce(F.sum("_size"), F.lit(0))).first()[0]
    first = within_budget(nodes, "_size", limit, "id").drop("used", "_size")
    return first, within_budget(edges, "_size", max(-1, limit - used), "src", "dst", "label").drop("used", "_size")


def owning_project(paths: DataFrame, projects: DataFrame) -> DataFrame:
    """paths (path) with project: of the projects (project, root) whose root the path lies below, the deepest one, or null.

    A path is dealt to the folders above it, which meet the roots on equality.
    """
    up = paths.select("path", F.split("path", "/").alias("p")).distinct()
    each = up.select("path", F.explode(F.sequence(F.lit(1), F.size("p"))).alias("n"), "p").select("path", "n", F.array_join(F.slice("p", F.lit(1), F.col("n")), "/").alias("root"))
    hit = each.join(projects.select("project", F.regexp_replace("root", "(?<=.)/+$", "").alias("root")), "root").groupBy("path").agg(F.max_by("project", F.struct("n", "project")).alias("project"))
    return paths.join(hit, "path", "left")


SCRIPTS, SUFFIXES = ("javascript", "typescript", "tsx"), ("ts", "tsx", "js", "jsx", "mjs", "cjs")


def aliased(imports: DataFrame, aliases: DataFrame, files: DataFrame) -> DataFrame:
    """src, path and dst (a file) of the imports of scripts that path aliases resolve, and hit: whether an alias or the direct path led to a file.

    Only names that begin with @ or src/ are looked at. A pattern is its text around one star; an import is dealt to the
    prefixes of its segments, and meets the patterns by the whole segments of the text before their star, on equality. A target may stand for a file, a file without its ending, or a folder's
    index; the deepest configuration comes first, then the pattern, the target's place, the ending; last the name as a
    path next to the importing file.
    """
    i = imports.filter(F.col("language").isin(*SCRIPTS) & (F.col("path").startswith("@") | F.col("path").startswith("src/"))).select("src", "path").distinct()
    star = F.instr("pattern", "*") > 0
    a = aliases.select("config_dir", "depth", "base_url", "pattern", "pos", "target", F.when(star, F.substring_index("pattern", "*", 1)).otherwise(F.col("pattern")).alias("front"), F.when(star, F.expr("substring(pattern, instr(pattern, '*') + 1)")).alias("back"))
    a = a.withColumn("stem", F.when(F.col("back").isNull(), F.concat(F.lit("="), F.col("pattern"))).otherwise(F.regexp_extract("front", "^(.*/)", 1)))
    parts = F.split("path", "/")
    stems = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.concat(F.slice(parts, F.lit(1), k - 1), F.array(F.lit(""))), "/"))
    dealt = i.select("src", "path", F.explode(F.concat(stems, F.array(F.concat(F.lit("="), F.col("path"))))).alias("stem"))
    fits = F.col("back").isNull() | (F.col("path").startswith(F.col("front")) & F.col("path").endswith(F.col("back")) & (F.length("path") >= F.length("front") + F.length("back")))
    both = dealt.join(a, "stem").filter(fits)
    wild = F.when(F.col("back").isNull(), F.lit("")).otherwise(F.expr("substring(path, length(front) + 1, length(path) - length(front) - length(back))"))
    target = F.when(F.instr("target", "*") > 0, F.concat(F.substring_index("target", "*", 1), wild, F.expr("substring(target, instr(target, '*') + 1)"))).otherwise(F.col("target"))
    base = normal_path(F.concat_ws("/", F.nullif("config_dir", F.lit("")), "base_url", target))
    named = both.select("src", "path", F.struct((-F.col("depth")).alias("depth"), "config_dir", "pattern", "pos").alias("order"), base.alias("base"))
    folder = F.regexp_extract("src", r"^(.*)/[^/]*$", 1)
    direct = i.select("src", "path", F.struct(F.lit(1 << 30).alias("depth"), F.lit("").alias("config_dir"), F.lit("").alias("pattern"), F.lit(0).alias("pos")).alias("order"), normal_path(F.concat_ws("/", F.nullif(folder, F.lit("")), "path")).alias("base"))
    ends = ["", *[f".{x}" for x in SUFFIXES], *[f"/index.{x}" for x in SUFFIXES]]
    dotted = F.regexp_like("base", F.lit(r"\.[^/.]+$"))
    tries = F.explode(F.array(*[F.struct(F.lit(k).alias("rank"), F.lit(e).alias("end")) for k, e in enumerate(ends)])).alias("t")
    each = named.unionByName(direct).select("src", "path", "order", "base", tries).filter(~dotted | (F.col("t.rank") == 0))
    hit = each.withColumn("rel_path", F.concat("base", "t.end")).join(files.select("rel_path", "restricted"), "rel_path")
    return hit.groupBy("src", "path").agg(F.min_by(F.struct("rel_path", "restricted"), F.struct("order", "t.rank")).alias("hit"))


def dependency_edges(imports: DataFrame, files: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """src, path, line, dst, kind and reason of every import (rel_path, language, path, line) of a tree.

    First aliases of scripts; then libraries, by the look of the name; then paths next to the importing file, with the
    endings that sources have; then names of modules, as the end of a file's path. files has rel_path and restricted;
    files that are not restricted come first. All joins are on equality: a file is dealt to the ends of its path.
    """
    i = imports.select(F.col("rel_path").alias("src"), "language", "path", "line")
    if aliases is not None:
        i = i.join(aliased(i, aliases, files), ["src", "path"], "left")
    else:
        i = i.withColumn("hit", F.lit(None).cast("struct<rel_path:string,restricted:boolean>"))
    i = i.withColumn("look", F.when(F.col("hit").isNotNull(), "alias").otherwise(import_kind(F.col("path"), F.col("language"))))
    rest = i.filter("look = 'internal'").select("src", "path").distinct()
    near = F.col("path").startswith("./") | F.col("path").startswith("../")
    folder = F.regexp_extract("src", r"^(.*)/[^/]*$", 1)
    relative = rest.filter(near).select("src", "path", normal_path(F.concat_ws("/", F.nullif(folder, F.lit("")), "path")).alias("candidate"))
    bare = relative.withColumn("candidate", F.when(F.regexp_like("candidate", F.lit(r"\.[^/.]+$")), F.regexp_replace("candidate", r"\.[^/.]+$", "")).otherwise(F.col("candidate")))
    exact = relative.join(files.withColumnRenamed("rel_path", "candidate"), "candidate").select("src", "path", F.struct(F.col("candidate").alias("rel_path"), "restricted").alias("found"))
    ended = resolved_imports(bare, files, (".rs", ".ts", ".tsx", ".js", ".py", ".java")).join(files.select(F.col("rel_path").alias("dst"), "restricted"), "dst").select("src", "path", F.struct(F.col("dst").alias("rel_path"), "restricted").alias("found"))
    here = exact.withColumn("o", F.lit(0)).unionByName(ended.withColumn("o", F.lit(1))).groupBy("src", "path").agg(F.min_by("found", "o").alias("found"))
    stem = F.regexp_replace("rel_path", r"\.(rs|py|java|tsx|ts|js)$", "")
    ends = files.select("rel_path", "restricted", F.split(stem, "/").alias("p")).select("rel_path", "restricted", F.explode(F.transform(F.sequence(F.lit(1), F.size("p")), lambda n: F.array_join(F.slice("p", F.size("p") - n + 1, n), "/"))).alias("module"))
    module = F.regexp_replace(internal_reference(F.col("path")), "^/+|/+$", "")
    named = rest.filter(~near).select("src", "path", module.alias("module")).join(ends, "module").groupBy("src", "path").agg(F.min_by(F.struct("rel_path", "restricted"), F.struct("restricted", "rel_path")).alias("found"))
    out = i.join(here.unionByName(named), ["src", "path"], "left").withColumn("hit", F.coalesce("hit", "found"))
    kind = F.when((F.col("look") == "external") & F.col("hit").isNull(), "external").when(F.col("hit").isNull(), "unresolved").when(F.col("hit.restricted"), "restricted").otherwise("internal")
    out = out.withColumn("kind", kind)
    reason = F.when(F.col("kind") == "unresolved", F.when(F.trim("path") == "", "unsupported_syntax").otherwise("destination_not_found"))
    return out.select("src", "path", "line", F.coalesce("hit.rel_path", "path").alias("dst"), "kind", reason.alias("reason"))


def resolved_imports(imports: DataFrame, files: DataFrame, extensions: tuple[str, ...] = ("", ".rs", ".ts", ".tsx", ".js", ".py", ".java")) -> DataFrame:
    """imports (src, path, candidate: a path without its extension) with dst and kind.

    Each candidate is dealt to the files that it could be, with a priority; the join is on equality and the best one
    stays. files has rel_path and restricted; files that are not restricted come first. Sizes are not known where texts
    were built and parsed, so neither join may broadcast a side.
    """
    tries = F.array(*[F.struct(F.lit(k).alias("rank"), F.concat("candidate", F.lit(e)).alias("rel_path")) for k, e in enumerate(extensions)])
    each = imports.select("src", "path", F.explode(tries).alias("t")).select("src", "path", "t.rank", "t.rel_path")
    hit = each.join(files.select("rel_path", "restricted").hint("merge"), "rel_path").groupBy("src", "path").agg(F.min_by(F.struct("rel_path", "restricted"), F.struct("restricted", "rank")).alias("hit"))
    out = imports.join(hit.hint("merge"), ["src", "path"], "left")
    kind = F.when(F.col("hit").isNull(), "unresolved").when(F.col("hit.restricted"), "restricted").otherwise("internal")
    return out.select(*imports.columns, F.col("hit.rel_path").alias("dst"), kind.alias("kind"), F.when(F.col("hit").isNull(), F.when(F.trim("path") == "", "unsupported_syntax").otherwise("destination_not_found")).alias("reason"))
