"""Project trees as tables: scan, languages, restriction globs, lines, configuration, baselines."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest files that are read, and that take part in flows across files.
MAX_BYTES, MAX_FLOW_BYTES = 10 * 1024 * 1024, 1024 * 1024

# Languages by file extension, first match.
EXTENSIONS: dict[str, str] = {
    "c": "c", "h": "c", "cs": "csharp", "css": "css", "scss": "scss", "sass": "scss", "go": "go", "html": "html", "htm": "html", "java": "java", "js": "javascript", "jsx": "javascript", "mjs": "javascript",
    "cjs": "javascript", "kt": "kotlin", "kts": "kotlin", "py": "python", "rs": "rust", "tsx": "tsx", "ts": "typescript",
}


def glob_regex(glob: str) -> str:
    """A regular expression for a glob: ** over folders, * and ? within one."""
    out, k = "", 0
    while k < len(glob):
        if glob.startswith("**/", k):
            out, k = out + "(?:.*/)?", k + 3
        elif glob.startswith("**", k):
            out, k = out + ".*", k + 2
        elif glob[k] == "*":
            out, k = out + "[^/]*", k + 1
        elif glob[k] == "?":
            out, k = out + "[^/]", k + 1
        elif glob[k] == "[" and "]" in glob[k + 1 :]:
            end = glob.index("]", k + 1)
            out, k = out + "[" + glob[k + 1 : end].replace("!", "^", 1) + "]", end + 1
        else:
            out, k = out + re.escape(glob[k]), k + 1
    return f"^{out}$"


def restriction(lines: list[str]) -> str | None:
    """One expression for the lines of a restriction file: /p stands for p below the root, any other for p anywhere."""
    out = []
    for line in map(str.strip, lines):
        if not line or line.startswith("#"):
            continue
        if line.startswith("/"):
            p = line.strip("/")
            globs = [p, f"{p}/**"]
        else:
            p = line.rstrip("/")
            globs = [p, f"**/{p}", f"{p}/**", f"**/{p}/**"]
        out += [glob_regex(g)[1:-1] for g in globs]
    return "^(?:" + "|".join(out) + ")$" if out else None


def in_scope(path: Column, scope: str | None) -> Column:
    """Whether a path holds the text of a scope; all do if there is none."""
    return F.lit(True) if not scope else path.contains(scope)


def restricted(rel_path: Column, lines: list[str]) -> Column:
    pattern = restriction(lines)
    return F.lit(False) if pattern is None else F.regexp_like(rel_path, F.lit(pattern))


def language_of(rel_path: Column) -> Column:
    """The language of a file by its extension (case matters), or null."""
    ext = F.nullif(F.regexp_extract(rel_path, r"\.([^./]+)$", 1), F.lit(""))
    return F.element_at(F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv]), ext)


def is_config(rel_path: Column) -> Column:
    name = F.regexp_extract(rel_path, r"([^/]*)$", 1)
    return F.regexp_like(name, F.lit(r"(?i)\.(properties|ya?ml|toml|env)$")) | (name == ".env") | name.startswith(".env.")


def infra_target(rel_path: Column) -> Column:
    """dockerfile, yaml, properties or shell, or null."""
    name = F.lower(F.regexp_extract(rel_path, r"([^/]*)$", 1))
    docker = name.isin("dockerfile", "containerfile") | name.startswith("dockerfile.") | name.endswith(".dockerfile")
    return F.when(docker, "dockerfile").when(F.regexp_like(rel_path, F.lit(r"\.ya?ml$")), "yaml").when(rel_path.endswith(".properties"), "properties").when(F.regexp_like(rel_path, F.lit(r"\.(sh|bash)$")), "shell")


def ignore_rules(path: str, text: str) -> list[tuple[str, int, str, bool, bool]]:
    """folder, order, expression, negated and folders_only of the lines of an ignore file: paths are below its folder."""
    folder, out = path.rpartition("/")[0], []
    for k, line in enumerate(text.splitlines()):
        line = line.rstrip()
        if not line or line.startswith("#"):
            continue
        negated, line = line.startswith("!"), line.removeprefix("!").removeprefix("\\")
        only, glob = line.endswith("/"), line.strip("/")
        if "/" not in line.rstrip("/"):  # a name without a slash may stand at any depth
            glob = f"**/{glob}"
        if glob:
            out.append((folder, k, glob_regex(glob), negated, only))
    return out


def ignored(files: DataFrame, ignore_files: DataFrame) -> DataFrame:
    """rel_path of the files that ignore files (rel_path, content) leave out: for each path the last fitting line of the deepest file decides.

    A file whose folder is left out cannot come back. Every path is dealt to the folders above it and meets the lines
    of their ignore files by folder.
    """
    rules = ignore_files.select("rel_path", "content")

    def run(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            rows = [r for p, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for r in ignore_rules(p, t or "")]
            kinds = (pa.string(), pa.int32(), pa.string(), pa.bool_(), pa.bool_())
            yield pa.RecordBatch.from_pydict({n: pa.array([r[k] for r in rows], kind) for k, (n, kind) in enumerate(zip(("folder", "line", "pattern", "negated", "folders_only"), kinds))})

    lines_ = rules.mapInArrow(run, "folder string, line int, pattern string, negated boolean, folders_only boolean")
    p = files.select("rel_path", F.split("rel_path", "/").alias("p"))
    prefix = p.select("rel_path", "p", F.explode(F.sequence(F.lit(1), F.size("p"))).alias("n"))  # the path itself and the folders above it
    each = prefix.select("rel_path", "p", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("d"))
    each = each.select("rel_path", "n", F.size("p").alias("size"), "d", F.array_join(F.slice("p", F.lit(1), F.col("d")), "/").alias("folder"), F.array_join(F.slice("p", F.col("d") + 1, F.col("n") - F.col("d")), "/").alias("rest"))
    hit = each.join(lines_, "folder").filter(F.regexp_like("rest", F.col("pattern")) & (~F.col("folders_only") | (F.col("n") < F.col("size"))))
    last = hit.groupBy("rel_path", "n").agg(F.max_by("negated", F.struct("d", "line")).alias("negated"))
    return last.filter("not negated").select("rel_path").distinct()


def scan(spark: SparkSession, root: str, restrict: list[str] = (), ignore: list[str] = (), ignore_files: DataFrame | None = None) -> DataFrame:  # type: ignore[assignment]
    """rel_path, language, size_bytes, depth, restricted and content (text of files up to MAX_BYTES) of a tree.

    Folders target and .git, what ignore files (ignore_files: rel_path, content) leave out, and paths that ignore
    (lines for the whole tree) matches are left out, as are hidden and empty files, which Spark's listing passes over.
    The size limit is a filter on a column of the listing, so larger files aren't read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/")
    rel = F.regexp_replace(F.regexp_replace("path", r"^file:/+", "/"), "^" + re.escape(re.sub(r"^file:/+", "/", base)) + "/", "")
    files = files.withColumn("rel_path", rel).filter(~F.regexp_like("rel_path", F.lit(r"^(target|\.git)/")))
    files = files.filter(~restricted(F.col("rel_path"), list(ignore)))
    if ignore_files is not None:
        files = files.join(ignored(files.select("rel_path"), ignore_files), "rel_path", "left_anti")
    text = F.when(F.col("length") <= MAX_BYTES, F.col("content").cast("string"))
    return files.select("rel_path", language_of(F.col("rel_path")).alias("language"), F.col("length").alias("size_bytes"), (F.size(F.split("rel_path", "/")) - 1).alias("depth"), restricted(F.col("rel_path"), list(restrict)).alias("restricted"), text.alias("content"))


def lines(df: DataFrame, text: str = "content", *keep: str) -> DataFrame:
    """keep, line_no (from 1) and line of every line; a last line break opens no line."""
    body = F.regexp_replace(F.col(text), r"\r?\n$", "")
    cut = F.posexplode(F.split(body, r"\r?\n")).alias("_pos", "line")
    return df.filter(F.length(text) > 0).select(*keep, cut).select(*keep, (F.col("_pos") + 1).alias("line_no"), "line")


def baseline(spark: SparkSession, text: str | None) -> tuple[str, DataFrame]:
    """absent, invalid or loaded, and the ids of a baseline given as JSON text."""
    import json

    ids, state = [], "absent"
    if text is not None:
        try:
            found = json.loads(text)["findings"]
            state, ids = ("loaded", found) if isinstance(found, list) and all(isinstance(x, str) for x in found) else ("invalid", [])
        except (ValueError, KeyError, TypeError):
            state = "invalid"
    return state, spark.createDataFrame([(x,) for x in ids], "stable_id string")


def aliases(configs: DataFrame) -> DataFrame:
    """config_dir, depth, base_url, pattern and target of the path aliases in tsconfig/jsconfig texts, deepest first."""
    schema = "compilerOptions struct<baseUrl:string,paths:map<string,array<string>>>"
    c = configs.filter(F.regexp_like("rel_path", F.lit(r"(^|/)(ts|js)config[^/]*\.json$"))).withColumn("c", F.from_json(F.regexp_replace("content", r"(?m)^\s*//.*$", ""), schema))
    c = c.withColumn("config_dir", F.regexp_replace("rel_path", r"/?[^/]*$", "")).withColumn("depth", F.size(F.split("rel_path", "/")) - 1)
    each = c.select("config_dir", "depth", F.col("c.compilerOptions.baseUrl").alias("base_url"), F.explode("c.compilerOptions.paths").alias("pattern", "targets"))
    return each.select("config_dir", "depth", "base_url", "pattern", F.posexplode("targets").alias("pos", "target")).orderBy(F.desc("depth"), "config_dir", "pattern", "pos")
