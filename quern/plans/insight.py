"""What a tree of sources is about: outlines, design patterns, entry points, use cases, structure, documents."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import first_line, normal_path
from quern.operators import source

# Prefixes of function names with what they do, in order.
VERBS: tuple[tuple[str, str], ...] = (
    ("create_", "Creating"), ("new_", "Creating"), ("build_", "Building"), ("generate_", "Generating"), ("parse_", "Parsing"), ("read_", "Reading"), ("load_", "Loading"), ("write_", "Writing"), ("save_", "Saving"), ("export_", "Exporting"), ("import_", "Importing"),
    ("validate_", "Validating"), ("check_", "Checking"), ("verify_", "Verifying"), ("search_", "Searching"), ("find_", "Finding"), ("query_", "Querying"), ("get_", "Retrieving"), ("fetch_", "Fetching"), ("send_", "Sending"), ("process_", "Processing"), ("handle_", "Handling"),
    ("convert_", "Converting"), ("transform_", "Transforming"), ("analyze_", "Analyzing"), ("audit_", "Auditing"), ("inspect_", "Inspecting"), ("refresh_", "Refreshing"), ("update_", "Updating"), ("delete_", "Deleting"), ("remove_", "Removing"),
)
# Libraries that tell of command lines and of HTTP servers, in order.
CLI = (("clap", "clap"), ("structopt", "structopt"), ("argparse", "argparse"), ("click", "click"), ("typer", "typer"), ("commander", "commander"), ("yargs", "yargs"), ("picocli", "picocli"), ("commons-cli", "commons-cli"))
HTTP = (
    ("actix_web", "actix-web"), ("actix-web", "actix-web"), ("axum", "axum"), ("warp", "warp"), ("rocket", "rocket"), ("fastapi", "fastapi"), ("flask", "flask"), ("django", "django"), ("express", "express"), ("fastify", "fastify"), ("springframework", "spring-boot"), ("spring-boot", "spring-boot"), ("quarkus", "quarkus"), ("hyper", "hyper"),
)
# Phrases of comments that tell what something is for, in order.
PHRASES = ("use this", "useful for", "allows", "enables", "use when", "use it to", "can be used", "is used to", "provides", "supports")
# Names that design patterns are told by.
SINGLE, BUILT = ("instance", "get_instance", "singleton", "getInstance"), ("build", "finish")
WATCHED, TOLD, KEPT, DROPPED = ("subscribe", "register"), ("notify", "emit", "publish", "dispatch"), ("save", "insert", "persist"), ("delete", "remove")
MOST_USE_CASES = 8
#: Most files and matches of a search for patterns, and most matches of its summary.
MOST_FILES, MOST_MATCHES, MOST_SHOWN = 500, 2000, 100


def patterns(found: DataFrame) -> DataFrame:
    """pattern, file, line of the design patterns that names in analysed files tell of: counts and flags by file."""
    names = lambda *x: F.exists("functions", lambda f: f["name"].isin(*x))
    count = lambda test: F.size(F.filter("functions", lambda f: test(f["name"])))
    line = lambda test: F.coalesce(F.get(F.filter("functions", lambda f: test(f["name"])), F.lit(0))["start_line"], F.lit(0))
    typed = lambda word: F.exists("types", lambda t: F.lower(t["name"]).contains(word))
    single = lambda n: n.isin(*SINGLE)
    maker = lambda n: n.startswith("create_") | n.startswith("make_") | n.startswith("new_")
    finder = lambda n: n.startswith("find_") | n.startswith("get_by")
    none = F.lit(0)
    rules: list[tuple[str, Column, Column]] = [
        ("Singleton", count(single) > 0, line(single)),
        ("Builder", (count(lambda n: n.startswith("with_")) >= 2) & names(*BUILT), line(lambda n: n.startswith("with_"))),
        ("Factory", typed("factory") | (count(maker) >= 2), none),
        ("Observer", names(*WATCHED) & names(*TOLD), none),
        ("Repository", (count(finder) >= 1) & names(*KEPT) & names(*DROPPED), none),
        ("Strategy", typed("strategy"), F.coalesce(F.get(F.filter("types", lambda t: F.lower(t["name"]).contains("strategy")), none)["start_line"], none)),
    ]
    each = F.array_compact(F.array(*[F.when(test, F.struct(F.lit(k).alias("pattern"), at.cast("int").alias("line"))) for k, test, at in rules]))
    return found.select("rel_path", F.explode(each).alias("p")).select(F.col("p.pattern").alias("pattern"), F.col("rel_path").alias("file"), F.col("p.line").alias("line"))


def sorted_patterns(matches: DataFrame, by: str = "pattern", most: int = MOST_MATCHES, summary: bool = False) -> DataFrame:
    """The first matches by pattern, file or line, then by the others; most of them at most, and fewer in a summary."""
    order = {"pattern": ("pattern", "file", "line"), "file": ("file", "line", "pattern"), "line": ("line", "file", "pattern")}[by]
    return matches.orderBy(*order).limit(min(most, MOST_MATCHES, MOST_SHOWN if summary else MOST_MATCHES))


def pattern_counts(matches: DataFrame) -> tuple[DataFrame, DataFrame]:
    return matches.groupBy("pattern").count(), matches.groupBy("file").count()


def entrypoints(found: DataFrame) -> DataFrame:
    """kind, file, symbol and signature: main functions, the first command-line and HTTP library in order of files, else the library itself."""
    main = source.exploded(found, "functions").filter("name = 'main'").groupBy("rel_path").agg(F.min_by("signature", "start_line").alias("signature"))
    out = main.select(F.lit("main_function").alias("kind"), F.col("rel_path").alias("file"), F.lit("main").alias("symbol"), "signature")
    guard = source.exploded(found, "strings").filter("language = 'python'").filter(F.regexp_replace("value", "[\"']", "") == "__main__").select("rel_path").distinct()
    out = out.unionByName(guard.select(F.lit("main_function").alias("kind"), F.col("rel_path").alias("file"), F.lit("__main__").alias("symbol"), F.lit(None).cast("string").alias("signature")))
    imports = source.exploded(found, "imports").withColumn("low", F.lower("path"))
    for kind, marks in (("cli_framework", CLI), ("http_framework", HTTP)):
        name = F.coalesce(*[F.when(F.col("low").contains(m), F.lit(n)) for m, n in marks])
        hit = imports.withColumn("name", name).filter("name is not null").agg(F.min(F.struct("rel_path", "line", "name")).alias("x")).filter("x is not null")
        out = out.unionByName(hit.select(F.concat_ws(":", F.lit(kind), "x.name").alias("kind"), F.col("x.rel_path").alias("file"), F.lit(None).cast("string").alias("symbol"), F.lit(None).cast("string").alias("signature")))
    if out.limit(1).count() == 0 and found.filter(F.exists("functions", lambda f: f["is_public"]) | F.exists("types", lambda t: t["is_public"])).limit(1).count():
        out = found.sparkSession.createDataFrame([("library", "", None, None)], out.schema)
    return out


def verb_groups(functions: DataFrame, name: str, prefixes: tuple[str, ...], *order: str, least: int = 2) -> DataFrame:
    """place (of the first prefix that a name begins with) and names, in order, of the groups of two or more."""
    place = F.coalesce(*[F.when(F.col(name).startswith(p), F.lit(k)) for k, p in enumerate(prefixes)])
    each = functions.withColumn("place", place).filter("place is not null")
    names = F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(name).alias("_name")))), lambda x: x["_name"])
    return each.groupBy("place").agg(names.alias("names")).filter(F.size("names") >= least)


def use_cases(found: DataFrame) -> DataFrame:
    """title, description, functions and confidence: what comments say that public functions are for (high), then groups of two or more that begin with the same verb (medium)."""
    f = source.exploded(found, "functions").filter("is_public")
    line = F.array_compact(F.transform(F.split("doc", "\n"), lambda x: F.when(F.regexp_like(x, F.lit("(?i)" + "|".join(PHRASES))), x)))
    said = F.trim(F.regexp_replace(F.trim(F.get(line, F.lit(0))), r"^(?:///|//|#)+", ""))
    high = f.withColumn("description", said).filter(F.octet_length("description") > 10)
    high = high.groupBy("name").agg(F.min_by("description", F.struct("rel_path", "start_line")).alias("description"), F.min(F.struct("rel_path", "start_line")).alias("first"))
    out = high.select(F.lit(0).alias("rank"), "first", F.lit(0).alias("place"), F.concat(F.lit("Using `"), "name", F.lit("`")).alias("title"), "description", F.array("name").alias("functions"), F.lit("high").alias("confidence"))
    label = F.element_at(F.array(*[F.lit(v) for _, v in VERBS]), F.col("place") + 1)
    by = verb_groups(f, "name", tuple(p for p, _ in VERBS), "rel_path", "start_line")
    nothing = F.lit(None).cast("struct<rel_path:string,start_line:int>").alias("first")
    out = out.unionByName(by.select(F.lit(1).alias("rank"), nothing, "place", F.concat(label, F.lit(" data")).alias("title"), F.concat(label, F.lit(" data through "), F.size("names").cast("string"), F.lit(" functions")).alias("description"), F.col("names").alias("functions"), F.lit("medium").alias("confidence")))
    return out.orderBy("rank", "first", "place").limit(MOST_USE_CASES).select("title", "description", "functions", "confidence")


def outline(found: DataFrame, rel_path: str, public_only: bool = False) -> DataFrame:
    """kind, name, line and text of the types, functions and imports of a file, in order."""
    one = found.filter(F.col("rel_path") == rel_path)
    types = source.exploded(one, "types").select(F.col("kind"), F.col("name"), F.col("start_line").alias("line"), F.coalesce(first_line(F.col("doc")), F.lit("")).alias("text"), "is_public")
    functions = source.exploded(one, "functions").select(F.lit("function").alias("kind"), F.col("qualified_name").alias("name"), F.col("start_line").alias("line"), F.col("signature").alias("text"), "is_public")
    imports = source.exploded(one, "imports").select(F.lit("import").alias("kind"), F.col("path").alias("name"), "line", F.col("raw").alias("text"), F.lit(True).alias("is_public"))
    out = types.unionByName(functions).unionByName(imports)
    return (out.filter("is_public") if public_only else out).orderBy("line", "kind", "name")


def structure(files: DataFrame, depth: int = 2, most: int = 8) -> DataFrame:
    """folder, files, folders, restricted and more: counts of everything below each folder, the first most of each level."""
    p = files.withColumn("p", F.split("rel_path", "/"))
    each = p.select(F.explode(F.sequence(F.lit(0), F.size("p") - 1)).alias("d"), "p", "restricted").select(F.array_join(F.slice("p", F.lit(1), F.col("d")), "/").alias("folder"), "d", F.array_join(F.slice("p", F.lit(1), F.size("p") - 1), "/").alias("own"), "restricted")
    by = each.groupBy("folder", "d").agg(F.count("own").alias("files"), (F.countDistinct("own") - F.max((F.col("own") == F.col("folder")).cast("int"))).alias("folders"), F.count_if("restricted").alias("restricted"))
    parent = F.when(F.col("d") <= 1, "").otherwise(F.regexp_replace("folder", "/[^/]*$", ""))
    w = Window.partitionBy("parent", "d").orderBy("folder")
    by = by.withColumn("parent", parent).withColumn("n", F.row_number().over(w)).withColumn("more", F.greatest(F.lit(0), F.count("folder").over(Window.partitionBy("parent", "d")) - most))
    return by.filter((F.col("d") <= depth) & (F.col("n") <= most)).select("folder", F.col("d").alias("depth"), "files", "folders", "restricted", "more").orderBy("folder")


def tool_counts(calls: DataFrame, tool: str) -> DataFrame:
    """tool and calls, the most called first."""
    return calls.groupBy(F.col(tool).alias("tool")).agg(F.count(F.lit(1)).alias("calls")).orderBy(F.desc("calls"), "tool")


def folder_counts(paths: DataFrame, path: str) -> DataFrame:
    """prefix and files: how many paths lie below each folder, at any depth."""
    p = paths.select(F.split(path, "/").alias("p")).filter(F.size("p") > 1)
    each = p.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("p") - 1), lambda k: F.array_join(F.slice("p", F.lit(1), k), "/"))).alias("prefix"))
    return each.groupBy("prefix").agg(F.count("prefix").alias("files"))


def page(files: DataFrame, offset: int, limit: int) -> DataFrame:
    """A page of files, shallow ones first, and whether more follow."""
    rows = files.withColumn("depth", F.size(F.split("rel_path", "/"))).orderBy("depth", "rel_path").offset(offset).limit(limit + 1)
    w = Window.partitionBy(F.lit(0)).orderBy("depth", "rel_path")
    return rows.withColumn("n", F.row_number().over(w)).withColumn("has_next", F.count("n").over(Window.partitionBy(F.lit(0))) > limit).filter(F.col("n") <= limit).drop("n")


def languages(found: DataFrame) -> DataFrame:
    """language, files, public functions and types, and documented functions."""
    size = lambda c, test: F.sum(F.size(F.filter(c, test)))
    return found.groupBy("language").agg(F.count("rel_path").alias("files"), size("functions", lambda f: f["is_public"]).alias("public_functions"), size("types", lambda t: t["is_public"]).alias("public_types"), size("functions", lambda f: f["doc"].isNotNull()).alias("documented"))


LABELS = {
    "en": {"title": "Project documentation", "languages": "Languages", "entry": "Entry points", "uses": "Use cases", "api": "Public interface", "usage": "Usage", "main_function": "Run the program", "cli_framework": "Call it from the command line", "http_framework": "Start the server", "library": "Use it as a library"},
    "es": {"title": "Documentación del proyecto", "languages": "Lenguajes", "entry": "Puntos de entrada", "uses": "Casos de uso", "api": "Interfaz pública", "usage": "Uso", "main_function": "Ejecutar el programa", "cli_framework": "Usarlo desde la línea de órdenes", "http_framework": "Iniciar el servidor", "library": "Usarlo como biblioteca"},
    "ca": {"title": "Documentació del projecte", "languages": "Llenguatges", "entry": "Punts d'entrada", "uses": "Casos d'ús", "api": "Interfície pública", "usage": "Ús", "main_function": "Executar el programa", "cli_framework": "Fer-lo servir des de la línia d'ordres", "http_framework": "Iniciar el servidor", "library": "Fer-lo servir com a biblioteca"},
}
API_ENTRIES, MOST_BYTES = 30, 2 * 1024 * 1024


def usage(found: DataFrame) -> DataFrame:
    """kind and entries (file or library, in order) of each kind of entry point."""
    kind = F.substring_index("kind", ":", 1)
    what = F.when(F.col("kind").contains(":"), F.substring_index("kind", ":", -1)).otherwise(F.col("file"))
    return entrypoints(found).select(kind.alias("kind"), what.alias("entry")).groupBy("kind").agg(F.array_sort(F.collect_set("entry")).alias("entries")).orderBy("kind")


def documents(found: DataFrame, language: str = "en") -> str:
    """Documentation of a tree as Markdown, in one of three languages; the interface is listed up to API_ENTRIES."""
    t = LABELS.get(language, LABELS["en"])
    out = [f"# {t['title']}", "", f"## {t['languages']}", ""]
    out += [f"- {r['language']}: {r['files']} ({r['public_functions']} / {r['public_types']})" for r in languages(found).orderBy(F.desc("files"), "language").collect()]
    out += ["", f"## {t['entry']}", ""] + [f"- {r['kind']} `{r['file']}` {r['signature'] or ''}".rstrip() for r in entrypoints(found).orderBy("kind", "file").collect()]
    out += ["", f"## {t['usage']}", ""]
    for r in usage(found).collect():  # a row for each kind of entry
        out += [f"### {t.get(r['kind'], r['kind'])}", "", *[f"- `{x}`" for x in r["entries"]], ""]
    out += ["", f"## {t['uses']}", ""] + [f"- {r['title']} ({r['confidence']}): {r['description']}: `{'`, `'.join(r['functions'][:3])}`" for r in use_cases(found).collect()]
    api = source.exploded(found, "functions").filter("is_public").orderBy("rel_path", "start_line").limit(API_ENTRIES)
    out += ["", f"## {t['api']}", ""] + [f"- `{r['signature']}` — `{r['rel_path']}:{r['start_line']}`" for r in api.select("signature", "rel_path", "start_line").collect()]
    return ("\n".join(out) + "\n").encode()[:MOST_BYTES].decode(errors="ignore")


def component_triads(files: DataFrame) -> DataFrame:
    """ts_file, selector, template and styles of decorated components, their paths resolved next to the file."""
    body = r"(?:[^(){}\"'`]|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|`(?:\\.|[^`\\])*`|%s)*+"
    nested = r"[({](?:[^(){}\"'`]|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|`(?:\\.|[^`\\])*`)*+[)}]"
    for _ in range(3):  # brackets within brackets, four deep
        nested = r"[({]" + body % nested + r"[)}]"
    c = files.filter(F.col("rel_path").endswith(".ts") & F.col("content").contains("@Component")).withColumn("d", F.regexp_extract("content", r"(?s)@Component\s*\((" + body % nested + r")\)", 1))
    folder = F.regexp_extract("rel_path", r"^(.*/)?[^/]*$", 1)
    next_to = lambda p: normal_path(F.concat(folder, p))
    template = F.nullif(F.regexp_extract("d", r"templateUrl\s*:\s*['\"`]([^'\"`]+)['\"`]", 1), F.lit(""))
    block = F.concat(F.regexp_extract("d", r"(?s)styleUrls\s*:\s*\[([^\]]*)\]", 1), F.regexp_extract("d", r"styleUrl\s*:\s*(['\"`][^'\"`]+['\"`])", 1))
    styles = F.regexp_extract_all(block, F.lit(r"['\"`]([^'\"`]+)['\"`]"), F.lit(1))
    return c.select(F.col("rel_path").alias("ts_file"), F.nullif(F.regexp_extract("d", r"selector\s*:\s*['\"`]([^'\"`]+)['\"`]", 1), F.lit("")).alias("selector"), next_to(template).alias("template_file"), F.transform(styles, next_to).alias("style_files"))


_QUERY = re.compile(r"^\(\s*(\w+)\s*(?:(\w+)\s*:\s*\(\s*\w+\s*\)\s*@(\w+)\s*)?\)?\s*(?:@(\w+))?\s*(?:\(#(not-match|match|not-eq|eq)\?\s*@(\w+)\s*\"((?:[^\"\\]|\\.)*)\"\s*\))?\s*\)?$")
_KINDS = {"function_definition": ("functions", "name"), "function_item": ("functions", "name"), "class_definition": ("types", "name"), "call": ("calls", "callee"), "call_expression": ("calls", "callee"), "string": ("strings", "value"), "import_statement": ("imports", "path"), "assignment": ("assigns", "target"), "comment": ("comments", "text")}


def query(found: DataFrame, expression: str) -> DataFrame:
    """rel_path, capture, text and line of what a query finds.

    The subset: (kind), with a field: (..) @name or @name behind it, and one of #eq? #not-eq? #match? #not-match?.
    """
    m = _QUERY.match(expression.strip())
    if m is None or m[1] not in _KINDS:
        raise ValueError("not in the supported subset: (kind [field: (_) @name] [@name] [(#match? @name \"..\")])")
    nested, column = _KINDS[m[1]]
    rows = source.exploded(found, nested)
    line = "start_line" if "start_line" in rows.columns else "line"
    out = rows.select("rel_path", F.lit(m[3] or m[4] or "match").alias("capture"), F.col(column).alias("text"), F.col(line).alias("line"))
    if m[5]:
        value = m[7].replace('\\"', '"').replace("\\\\", "\\")
        test = F.regexp_like("text", F.lit(value)) if "match" in m[5] else F.col("text") == value
        out = out.filter(~test if m[5].startswith("not") else test)
    return out.orderBy("rel_path", "line", "text")
