"""Evaluation of the rule catalogue over analysed source files, and data flows from inputs to sinks."""

from __future__ import annotations

import re
from collections.abc import Iterator
from re import _parser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.text import context_of, escalated, mapped
from quern.operators import findings as fd
from quern.operators import source
from quern.plans import catalogue, flows
from quern.sources.files import EXTENSIONS, MAX_FLOW_BYTES, lines
from quern.sources.store import kept, spread

DEVELOPMENT = "IsDevelopment"
COLUMNS = ("callee", "receiver", "is_new", "args", "args2", "arg0", "arg1", "arg2", "any_arg", "whole", "path", "target", "value", "text", "block")


def catalogue_table(spark: SparkSession, rules: tuple = catalogue.RULES) -> DataFrame:
    """rule_no, rule, language, table, gate, an expression and its sense for each of COLUMNS: a bounded dimension. A rule for all languages has a row for each."""
    rows = []
    for no, (rule, languages, table, exprs, gate) in enumerate(rules):
        for language in sorted(set(EXTENSIONS.values())) if languages == "*" else languages.split(","):
            cells = []
            for c in COLUMNS:
                e = exprs.get(c)
                cells += [None if e is None else e.removeprefix("!"), e is None or not e.startswith("!")]
            rows.append((no, rule, language, table, gate, *cells))
    schema = "rule_no int, rule string, language string, table string, gate string, " + ", ".join(f"p_{c} string, s_{c} boolean" for c in COLUMNS)
    return spark.createDataFrame(rows, schema)


#: Texts that a part of an expression may stand for, at most, for its words to be listed.
MOST_TEXTS = 256


def _texts(items: list) -> set[str] | None:
    """All texts that parsed items of an expression stand for; None where they are not few."""
    out = {""}
    for op, value in items:
        name = str(op)
        if name == "LITERAL":
            found = {chr(value)}
        elif name == "IN" and all(str(o) == "LITERAL" for o, _ in value):
            found = {chr(v) for _, v in value}
        elif name == "SUBPATTERN":
            found = _texts(list(value[3]))
        elif name == "BRANCH":
            parts = [_texts(list(x)) for x in value[1]]
            found = None if None in parts else set().union(*parts)
        elif name == "MAX_REPEAT" and value[1] == 1:
            found = _texts(list(value[2]))
            found = None if found is None else found | {""}
        else:
            found = None
        if found is None or len(out) * len(found) > MOST_TEXTS:
            return None
        out = {a + b for a in out for b in found}
    return out


def _bounded(items: list, k: int, step: int) -> bool:
    """Whether what stands at place k, or beyond it in steps, cannot go on a word: an end, a boundary, a sign, or space."""
    while 0 <= k < len(items):
        name, value = str(items[k][0]), items[k][1]
        if name == "AT":
            return True
        if name == "LITERAL":
            return not re.match(r"\w", chr(value))
        if name == "IN":
            return all(str(o) == "LITERAL" and not re.match(r"\w", chr(v)) for o, v in value)
        inner = value[2][0] if name == "MAX_REPEAT" else (None, None)
        if str(inner[0]) != "IN" or [str(x[1]) for x in inner[1]] != ["CATEGORY_SPACE"]:
            return False
        if value[0]:
            return True
        k += step
    return False


def required_words(expression: str) -> frozenset[str] | None:
    """Words of which a text must hold one, as a whole word and in lower case, for the expression to fit; None where none is sure.

    Stretches of an expression that stand for few texts are taken between boundaries (an end, a word boundary, a sign).
    """
    items = [(op, value) for op, value in _parser.parse(expression)]
    best, k = None, 0
    while k < len(items):
        j, found = k, None
        while j < len(items) and (more := _texts(items[k : j + 1])) is not None:
            j, found = j + 1, more
        if found is not None:
            left, right = _bounded(items, k - 1, -1), _bounded(items, j, 1)
            words = set()
            for text in found:
                whole = [m[0].lower() for m in re.finditer(r"[A-Za-z0-9_]+", text) if (m.start() or left) and (m.end() < len(text) or right)]
                if not whole:
                    break
                words.add(max(whole, key=len))
            else:
                if best is None or len(words) < len(best):
                    best = frozenset(words)
        k = max(j, k + 1)
    return best


def required_parts(expression: str) -> frozenset[str] | None:
    """Texts in lower case of which a text in lower case must hold one, anywhere, for the expression to fit; None where none is sure. Those whose shortest is longest are taken."""
    return _parts([(op, value) for op, value in _parser.parse(expression)])


def _parts(items: list) -> frozenset[str] | None:
    best, k = None, 0

    def better(found: frozenset[str] | None) -> frozenset[str] | None:
        held = found and min(map(len, found))
        return found if held and (best is None or held > min(map(len, best))) else best

    while k < len(items):
        j, found = k, None
        while j < len(items) and (more := _texts(items[k : j + 1])) is not None:
            j, found = j + 1, more
        if found is not None:
            best = better(frozenset(x.lower() for x in found))
        else:
            name, value = str(items[k][0]), items[k][1]
            if name == "BRANCH":
                ways = [_parts(list(x)) for x in value[1]]
                best = better(None if None in ways else frozenset().union(*ways))
            elif name in ("ASSERT", "SUBPATTERN") or name == "MAX_REPEAT" and value[0]:
                best = better(_parts(list(value[-1])))
        k = max(j, k + 1)
    return best


def literal_index(rules: tuple = catalogue.RULES) -> tuple[list[tuple[int, str, str]], set[int]]:
    """(rule_no, column, word) of the rules that need a word, and the numbers of the others: the fewest words decide the column."""
    rows, rest = [], set()
    for no, (_, _, _, exprs, _) in enumerate(rules):
        found = [(len(w), c, w) for c, e in exprs.items() if not e.startswith("!") and c in COLUMNS and (w := required_words(e))]
        if found:
            _, column, words = min(found, key=lambda x: x[:2])
            rows += [(no, column, w) for w in sorted(words)]
        else:
            rest.add(no)
    return rows, rest


def candidates(f: DataFrame, rules: tuple = catalogue.RULES) -> DataFrame:
    """Facts with the rules whose expressions they might fit: those of their language and table that need a word which they hold.

    The words of each fact that the index has at all are rows, which meet it on equality; only rules without a sure word
    meet all facts of their table.
    """
    rows, rest = literal_index(rules)
    spark = f.sparkSession
    table = catalogue_table(spark, rules)
    index = table.join(spark.createDataFrame(rows, "rule_no int, _column string, _word string"), "rule_no")

    def held(c: str) -> Column:
        known = sorted({r[2] for r in rows if r[1] == c})
        words = F.array_distinct(F.filter(F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9_]+)"), F.lit(1)), lambda w: w.isin(*known)))
        none = F.array().cast("array<struct<_column:string,_word:string>>")
        return F.when(F.col(c).isNotNull(), F.transform(words, lambda w: F.struct(F.lit(c).alias("_column"), w.alias("_word")))).otherwise(none)

    words = f.withColumn("_w", F.explode(F.concat(*[held(c) for c in sorted({r[1] for r in rows})]))).withColumn("_column", F.col("_w._column")).withColumn("_word", F.col("_w._word")).drop("_w")
    met = words.join(F.broadcast(index), ["language", "table", "_column", "_word"]).drop("_column", "_word")
    left = f.join(F.broadcast(table.filter(F.col("rule_no").isin(*rest))), ["language", "table"])
    return met.unionByName(left)


def _fits(column: Column, c: str) -> Column:
    """Whether a column fits the rule's expression for it, if it has one."""
    p = F.col(f"p_{c}")
    return p.isNull() | F.coalesce(F.regexp_like(column, F.coalesce(p, F.lit("^"))) == F.col(f"s_{c}"), F.lit(False))


def catches(text: str, language: str) -> list[tuple[int, str]]:
    """(line, body) of the handlers of a file."""
    out = []
    if language == "python":
        rows = text.split("\n")
        for k, row in enumerate(rows):
            if m := re.match(r"(\s*)except\b[^\n]*:\s*(.*)$", row):
                body, n = [m[2]] if m[2] else [], k + 1
                while n < len(rows) and (not rows[n].strip() or len(rows[n]) - len(rows[n].lstrip()) > len(m[1])):
                    body.append(rows[n])
                    n += 1
                out.append((k + 1, "\n".join(b for b in body if b.strip() and not b.strip().startswith("#"))))
    else:
        at = source.Text(text)
        for m in re.finditer(r"\bcatch\s*(?:\([^)]*\))?\s*(?:when\s*\([^)]*\)\s*)?\{", text):
            depth, end = 0, len(text)
            for k in range(m.end() - 1, len(text)):
                depth += (text[k] == "{") - (text[k] == "}")
                if depth == 0:
                    end = k + 1
                    break
            out.append((at.line(m.start()), text[m.end() - 1 : end]))
    return out


def facts(files: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """One row for each call, assignment, comment, handler, function and line of code, in the columns that rules name.

    found has the analysis of the files, if it is there already; each of its tables is read from it.
    """
    found = source.analysis(files) if found is None else found
    base = ["rel_path", "language"]
    null = F.lit(None).cast("string")

    def shaped(df: DataFrame, table: str, line: str, function: Column, within: Column, **own: Column) -> DataFrame:
        return df.select(*base, F.lit(table).alias("table"), F.col(line).cast("int").alias("line"), function.alias("function"), within.cast("int").alias("within"), *[own.get(c, null).alias(c) for c in COLUMNS])

    calls = source.exploded(found, "calls")
    args = F.array_join("args", ", ")
    at = lambda k: F.get("args", F.lit(k))
    path = F.when(F.col("receiver") == "", F.col("callee")).otherwise(F.concat_ws("::", "receiver", "callee"))
    out = shaped(calls, "call", "line", F.col("function"), F.col("within"), callee=F.col("callee"), receiver=F.col("receiver"), is_new=F.col("is_new").cast("string"), args=args, args2=args, arg0=at(0), arg1=at(1), arg2=at(2), any_arg=F.array_join("args", "\n"), whole=F.concat_ws(" ", "receiver", args), path=path)
    assigns = source.exploded(found, "assigns")
    out = out.unionByName(shaped(assigns, "assign", "line", F.col("function"), F.col("within"), target=F.col("target"), value=F.col("value")))
    comments = source.exploded(found, "comments")
    out = out.unionByName(shaped(comments, "comment", "line", null, null, text=F.col("text"), block=F.col("text")))
    functions = source.exploded(found, "functions")
    out = out.unionByName(shaped(functions, "function", "start_line", F.col("name"), F.col("start_line"), text=F.col("body")))

    def handlers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(p, lang, n, b) for p, lang, t in zip(*[batch.column(k).to_pylist() for k in range(3)]) for n, b in catches(t or "", lang or "")]
            yield pa.RecordBatch.from_pydict({k: pa.array([r[i] for r in rows], kind) for i, (k, kind) in enumerate((("rel_path", pa.string()), ("language", pa.string()), ("line", pa.int32()), ("body", pa.string())))})

    caught = spread(files.select(*base, "content")).mapInArrow(handlers, "rel_path string, language string, line int, body string")
    held = functions.select("rel_path", "name", "start_line", "end_line")
    caught = fd.enclosing(caught, held, "rel_path")
    out = out.unionByName(shaped(caught, "catch", "line", F.col("name"), F.col("within"), text=F.col("body")))
    code = lines(files, "content", *base).filter(~F.regexp_like(F.ltrim("line"), F.lit(r"^(//|\*|/\*)")))
    code = fd.enclosing(code.withColumnRenamed("line_no", "at").withColumnRenamed("line", "text").withColumnRenamed("at", "line"), held, "rel_path")
    return out.unionByName(shaped(code, "code", "line", F.col("name"), F.col("within"), text=F.col("text")))


_WORD = re.compile(r"[a-z0-9_]+")
_BREAK, _LAST_BREAK = re.compile(r"\r?\n"), re.compile(r"\r?\n(?=(?:\r\n|[\n\r\u0085\u2028\u2029])?\Z)")  # as lines() cuts a text


class _Index:
    """Rules by language and table: for each column those whose words, or parts of a text, it may hold; and those that need neither."""

    def __init__(self, rules: tuple = catalogue.RULES) -> None:
        rows, rest = literal_index(rules)
        self.gates = [r[4] for r in rules]
        need: dict[int, tuple[str, set[str]]] = {}
        for no, c, w in rows:
            need.setdefault(no, (c, set()))[1].add(w)
        by: dict[str, dict[str, tuple[dict, dict, list[int]]]] = {}
        for no, (_, languages, table, exprs, _) in enumerate(rules):
            parts = next(((c, p) for c, e in exprs.items() if no in rest and not e.startswith("!") and c in COLUMNS and (p := required_parts(e))), None)
            for language in set(EXTENSIONS.values()) if languages == "*" else languages.split(","):
                words, some, every = by.setdefault(language, {}).setdefault(table, ({}, {}, []))
                if no in need:
                    for w in need[no][1]:
                        words.setdefault(need[no][0], {}).setdefault(w, []).append(no)
                elif parts:
                    some.setdefault(parts[0], []).append((no, parts[1]))
                else:
                    every.append(no)
        one = lambda some: re.compile("|".join(sorted({re.escape(p) for _, parts in some for p in parts}))) if some else None
        self.by = {lang: {t: (every, [(c, words.get(c, {}), one(some.get(c)), some.get(c, ())) for c in sorted({*words, *some})]) for t, (words, some, every) in tables.items()} for lang, tables in by.items()}

    def met(self, language: str, table: str, fact: dict[str, str | None]) -> list[int]:
        """Rules whose words or parts a fact holds."""
        every, columns = self.by[language][table]
        out = list(every)
        for c, known, any_part, some in columns:
            if text := fact.get(c):
                low = text.lower()
                if known and not known.keys().isdisjoint(words := _WORD.findall(low)):
                    out += [no for w in set(words) for no in known.get(w, ())]
                if some and any_part.search(low):
                    out += [no for no, parts in some if any(p in low for p in parts)]
        return sorted(set(out)) if len(out) > 1 else out


def _facts_of(text: str, language: str, tables: frozenset[str], unit: source.Unit) -> Iterator[tuple[str, int, str | None, int | None, dict[str, str | None]]]:
    """Table, line, function around, its first line, and columns of the facts of a file in these tables, as facts() has them."""
    if "call" in tables:
        for c in unit.calls:
            args, joined = c["args"], ", ".join(c["args"])
            one = {"callee": c["callee"], "receiver": c["receiver"], "is_new": "true" if c["is_new"] else "false", "args": joined, "args2": joined, "any_arg": "\n".join(args), "whole": f"{c['receiver']} {joined}"}
            one |= {f"arg{k}": a for k, a in enumerate(args[:3])} | {"path": f"{c['receiver']}::{c['callee']}" if c["receiver"] else c["callee"]}
            yield "call", c["line"], c["function"], c["within"], one
    if "assign" in tables:
        for a in unit.assigns:
            yield "assign", a["line"], a["function"], a["within"], {"target": a["target"], "value": a["value"]}
    if "comment" in tables:
        for c in unit.comments:
            yield "comment", c["line"], None, None, {"text": c["text"], "block": c["text"]}
    if "function" in tables:
        for f in unit.functions:
            yield "function", f["start_line"], f["name"], f["start_line"], {"text": f["body"]}
    if not tables & {"catch", "code"}:
        return
    last = text.count("\n") + 1
    around: list[tuple[str | None, int | None]] = [(None, None)] * (last + 1)
    for f in sorted(unit.functions, key=lambda f: (f["start_line"], f["name"])):  # the one that starts last is the innermost
        for k in range(f["start_line"], min(f["end_line"], last) + 1):
            around[k] = f["name"], f["start_line"]
    if "catch" in tables:
        for line, body in catches(text, language):
            yield "catch", line, *around[line], {"text": body}
    if "code" in tables and text:
        for k, row in enumerate(_BREAK.split(_LAST_BREAK.sub("", text)), 1):
            if not row.lstrip(" ").startswith(("//", "*", "/*")):
                yield "code", k, *around[k], {"text": row}


_MET = "rel_path string, language string, line int, function string, within int, " + ", ".join(f"{c} string" for c in COLUMNS) + ", rules array<int>, names string, body string"


def met(files: DataFrame, rules: tuple = catalogue.RULES, dealt: bool = False) -> DataFrame:
    """Facts that hold the words of some rules, with the numbers of these, worked out in one pass over the files.

    Where a gate of its rules looks at the names assigned on its line, or at the body of the function around, a fact has
    the words of the gate that these hold, so that nothing of a file has to be kept, or to meet the rest of it in a join.
    dealt says that the files lie in many tasks already (store.spread); else they are dealt by their path.
    """
    index = _Index(rules)
    kinds = ("rel_path", "language", "line", "function", "within", *COLUMNS, "rules", "names", "body")
    types = [pa.int32() if k in ("line", "within") else pa.list_(pa.int32()) if k == "rules" else pa.string() for k in kinds]

    def rows(path: str, language: str, text: str) -> Iterator[tuple]:
        tables = frozenset(index.by.get(language, ()))
        if not tables:
            return
        unit = source.analysed(text, language, tables=("functions", "calls", "assigns", "comments"))
        bodies: dict[tuple[str | None, int | None], str] = {}
        targets: dict[int, list[str]] = {}
        held: dict[object, str] = {}  # by place, worked out when first asked for
        for f in unit.functions:
            bodies[f["name"], f["start_line"]] = max(f["body"] or "", bodies.get((f["name"], f["start_line"]), ""))
        for a in unit.assigns:
            targets.setdefault(a["line"], []).append(a["target"])

        def of(place: object, text: str, words: tuple[str, ...]) -> str:
            if place not in held:
                low = text.lower()
                held[place] = " ".join(w for w in words if (w in text if w == DEVELOPMENT else w.lower() in low))
            return held[place]

        for table, line, function, within, fact in _facts_of(text, language, tables, unit):
            if found := index.met(language, table, fact):
                gates = {index.gates[no] for no in found}
                named = of(line, " ".join(targets.get(line, ())), catalogue.SECURITY_NAMES + catalogue.AUTH_NAMES) if gates & {"security", "auth"} else None
                body = of((function, within), bodies.get((function, within), ""), (*catalogue.HARDENING, DEVELOPMENT)) if gates & {"hardening", "development"} else None
                yield path, language, line, function, within, *map(fact.get, COLUMNS), found, named, body

    def batched(got: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip(zip(*got), types)], names=list(kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, got = batch.slice(at, 256), []
                for p, lang, text in zip(*[part.column(k).to_pylist() for k in ("rel_path", "language", "content")]):
                    for row in rows(p, lang or "", text or ""):
                        got.append(row)
                        if len(got) == 4096:
                            yield batched(got)
                            got = []
                if got:
                    yield batched(got)

    files = files.select("rel_path", "language", "content")
    return (files if dealt else spread(files)).mapInArrow(run, _MET)


def parsed(files: DataFrame) -> DataFrame:
    """What rules need of the analysis of the files, worked out once: written, and read column by column by all that follow."""
    return kept(source.analysis(files.filter("language is not null"), tables=("functions", "calls", "assigns", "comments", "tests")))


def structural(files: DataFrame, found: DataFrame | None = None, more: tuple = (), dealt: bool = False) -> DataFrame:
    """The findings of the catalogue in files (rel_path, language, content), whose analysis found has if it is there.

    Facts meet the rules of their language and table whose words they hold, and each expression then decides: in one pass
    over the files (met), or by joins of the tables of an analysis (candidates). Gates look at the function around: its
    name, the names assigned on the line, or words in its body. more are further rules: (id, languages, table,
    expressions, gate, (weakness, category, severity, confidence, tier)). dealt: the files lie in many tasks already.
    """
    files = files.filter("language is not null")
    every = (*catalogue.RULES, *(r[:5] for r in more))
    if found is None:
        table = catalogue_table(files.sparkSession, every)
        both = met(files, every, dealt).withColumn("rule_no", F.explode("rules")).join(F.broadcast(table), ["rule_no", "language"])
    else:
        both = candidates(kept(facts(files, found)), every)  # read twice
    for c in COLUMNS:
        if c == "any_arg":
            both = both.filter(F.col("p_any_arg").isNull() | F.exists(F.split("any_arg", "\n"), lambda x: F.regexp_like(F.trim(x), F.col("p_any_arg"))))
        else:
            both = both.filter(_fits(F.col(c), c))
    if found is None:
        hit = both.select("rel_path", "rule", "gate", "line", "function", "names", "body")
    else:
        hit = both.select("rel_path", "rule", "gate", "line", "function", "within")
        bodies = source.exploded(found, "functions").groupBy("rel_path", F.col("name").alias("function"), F.col("start_line").alias("within")).agg(F.max("body").alias("body"))
        names = source.exploded(found, "assigns").groupBy("rel_path", "line").agg(F.concat_ws(" ", F.collect_set("target")).alias("names"))
        hit = hit.join(bodies, ["rel_path", "function", "within"], "left").join(names, ["rel_path", "line"], "left")
    around = F.lower(F.concat_ws(" ", "function", "names"))
    holds = lambda words, col: F.exists(F.array(*[F.lit(w.lower()) for w in words]), lambda w: col.contains(w))
    gate = F.when(F.col("gate") == "security", holds(catalogue.SECURITY_NAMES, around)).when(F.col("gate") == "auth", holds(catalogue.AUTH_NAMES, around))
    gate = gate.when(F.col("gate") == "hardening", ~holds(catalogue.HARDENING, F.lower(F.coalesce("body", F.lit(""))))).when(F.col("gate") == "development", ~F.coalesce("body", F.lit("")).contains(DEVELOPMENT)).otherwise(True)
    return _shaped(hit.filter(gate).select("rel_path", "rule", "line", "function").distinct(), {**{r[0]: catalogue.meta(r[0]) for r in catalogue.RULES}, **{r[0]: r[5] for r in more}})


def _shaped(hit: DataFrame, metas: dict[str, tuple]) -> DataFrame:
    spark = hit.sparkSession
    dim = spark.createDataFrame([(k, *v) for k, v in metas.items()], "rule string, cwe string, category string, severity string, confidence string, tier string")
    out = hit.join(F.broadcast(dim), "rule")
    flow = F.col("flow") if "flow" in hit.columns else F.lit(None).cast("struct<source_line:int,sink_line:int>")
    text = F.col("description") if "description" in hit.columns else F.replace(F.col("rule"), F.lit("-"), F.lit(" "))
    severity = F.when(F.col("write"), escalated(F.col("severity"))).otherwise(F.col("severity")) if "write" in hit.columns else F.col("severity")
    return out.select("rule", "cwe", "category", "tier", severity.alias("severity"), "confidence", context_of(F.col("rel_path")).alias("context"), F.col("rel_path").alias("file"), F.col("line").cast("int").alias("line"), "function", text.alias("description"), flow.alias("flow"))


# Flows: kinds of sinks with weakness, category, severity, confidence.
SINKS = {"sql": ("CWE-89", "sql_injection", "high", "high"), "cmd": ("CWE-78", "command_injection", "critical", "high"), "path": ("CWE-22", "path_traversal", "high", "high"), "ssrf": ("CWE-918", "ssrf", "high", "medium"), "redirect": ("CWE-601", "open_redirect", "medium", "medium"), "ssti": ("CWE-1336", "ssti", "high", "high"), "log": ("CWE-117", "log_injection", "medium", "medium")}
KEY_NAMES = {"sql": "sql-injection-taint", "cmd": "command-injection-taint", "path": "path-traversal-taint", "ssrf": "ssrf-taint", "redirect": "open-redirect-taint", "ssti": "ssti-taint", "log": "log-injection-taint"}
FAMILY = {"python": "py", "javascript": "js", "typescript": "js", "tsx": "js", "java": "java", "kotlin": "kotlin", "go": "go", "csharp": "cs", "rust": "rust"}
LACKING = {("kotlin", "ssti"), ("rust", "path"), ("rust", "ssti"), ("rust", "log")}

# Inputs by family: expressions over the text of a value.
SOURCES = {
    "py": r"\brequest\.(args|form|values|json|data|files|cookies|headers|GET|POST|query_params|get_json)\b|\binput\s*\(|\bsys\.argv\b|\bos\.environ\b",
    "js": r"\b(req|request|ctx)\.(query|params|body|cookies|headers)\b|\blocation\.(search|hash|href)\b|\bprocess\.argv\b|\bsearchParams\.get\(",
    "java": r"\.(getParameter|getParameterValues|getHeader|getQueryString|getCookies|getInputStream|getReader)\s*\(",
    "kotlin": r"\.(getParameter|getHeader|getQueryString)\s*\(|\bcall\.(parameters|receiveText|receive)\b|\breadLine\s*\(",
    "go": r"\.(FormValue|PostFormValue|URL\.Query\(\)\.Get|Query\(\)\.Get|PathValue|Header\.Get|Param|QueryParam|Query)\s*\(|\bos\.Args\b",
    "cs": r"\bRequest\.(Query|Form|Headers|Cookies|Params|QueryString|Body|RouteValues)\b|\bConsole\.ReadLine\s*\(",
    "rust": r"\b(env::args|stdin\(\)|query_string\(\)|req\.(query|body|param|headers))|\.match_info\(\)|\bQuery\(|\bPath\(|\bForm\(",
}
PARAM_SOURCES = {"java": r"@(RequestParam|PathVariable|RequestBody|RequestHeader)\b", "cs": r"\[From(Query|Body|Route|Header|Form)\]", "kotlin": r"@(RequestParam|PathVariable|RequestBody)\b"}
# Sinks by family and kind: callee, receiver, argument that counts (-1: any), whether it writes.
CALLS: dict[str, list[tuple[str, str, str, int, bool]]] = {
    "py": [("sql", r"^(execute|executemany|executescript|raw)$", r".", 0, False), ("cmd", r"^(system|popen|getoutput|run|call|check_output|check_call|Popen)$", r"^(os|subprocess|commands)$", 0, False), ("path", r"^open$", r"^(|io|codecs)$", 0, False), ("path", r"^(remove|unlink|rename|rmtree|copy|copyfile|move|makedirs)$", r"^(os|shutil)$", 0, True), ("path", r"^(send_file|send_from_directory|FileResponse)$", r"", -1, False), ("ssrf", r"^(get|post|put|delete|head|patch|request|urlopen)$", r"^(requests|httpx|urllib\.request|urllib|session)$", -1, False), ("redirect", r"^(redirect|RedirectResponse|HttpResponseRedirect)$", r"", 0, False), ("ssti", r"^(render_template_string|from_string|Template)$", r"", 0, False), ("log", r"^(debug|info|warning|error|critical|exception|log)$", r"(?i)(log|logger|logging)$", -1, False)],
    "js": [("sql", r"^(query|execute|raw)$", r".", 0, False), ("cmd", r"^(exec|execSync|spawn|spawnSync|execFile)$", r"", 0, False), ("path", r"^(readFile|readFileSync|createReadStream|sendFile)$", r"", 0, False), ("path", r"^(writeFile|writeFileSync|createWriteStream|unlink|unlinkSync|rm|rmSync)$", r"", 0, True), ("ssrf", r"^(fetch|get|post|request|axios)$", r"^(|axios|http|https|got|needle)$", 0, False), ("redirect", r"^redirect$", r"(res|response|ctx)$", -1, False), ("ssti", r"^(compile|render|renderString)$", r"(?i)(handlebars|ejs|pug|nunjucks|_)$", 0, False), ("log", r"^(log|info|warn|error|debug)$", r"(?i)(console|logger|log)$", -1, False)],
    "java": [("sql", r"^(executeQuery|executeUpdate|execute|prepareStatement|createQuery|createNativeQuery|queryForObject|queryForList|query|update)$", r".", 0, False), ("cmd", r"^(exec|ProcessBuilder|command)$", r"", -1, False), ("path", r"^(File|FileInputStream|FileReader|RandomAccessFile)$", r"", -1, False), ("path", r"^(FileOutputStream|FileWriter|PrintWriter)$", r"", -1, True), ("path", r"^(get|of|readAllBytes|readString|newInputStream|lines)$", r"^(Paths|Path|Files)$", -1, False), ("path", r"^(write|writeString|delete|copy|move|newOutputStream)$", r"^Files$", 0, True), ("ssrf", r"^(URL|openConnection|getForObject|getForEntity|exchange|create)$", r"^(|URI|restTemplate|new URL.*)$", 0, False), ("redirect", r"^(sendRedirect|RedirectView)$", r"", 0, False), ("ssti", r"^(evaluate|process|parseExpression|mergeTemplate)$", r"", -1, False), ("log", r"^(trace|debug|info|warn|error)$", r"(?i)(log|logger)$", -1, False)],
    "kotlin": [("sql", r"^(executeQuery|executeUpdate|execute|prepareStatement|rawQuery|execSQL|createNativeQuery)$", r".", 0, False), ("cmd", r"^(exec|ProcessBuilder)$", r"", -1, False), ("path", r"^(File|FileInputStream)$", r"", -1, False), ("path", r"^(FileOutputStream|FileWriter|writeText|writeBytes)$", r"", -1, True), ("ssrf", r"^(URL|URI)$", r"", 0, False), ("redirect", r"^(sendRedirect|respondRedirect)$", r"", 0, False), ("log", r"^(trace|debug|info|warn|error)$", r"(?i)(log|logger)$", -1, False)],
    "go": [("sql", r"^(Query|QueryRow|Exec|Prepare)$", r".", 0, False), ("sql", r"^(QueryContext|QueryRowContext|ExecContext)$", r".", 1, False), ("cmd", r"^(Command|CommandContext)$", r"^exec$", -1, False), ("path", r"^(Open|ReadFile|OpenFile|Stat)$", r"^(os|ioutil)$", 0, False), ("path", r"^(WriteFile|Create|Remove|RemoveAll|Mkdir|MkdirAll)$", r"^(os|ioutil)$", 0, True), ("path", r"^ServeFile$", r"^http$", 2, False), ("ssrf", r"^(Get|Post|Head|PostForm|NewRequest)$", r"^http$", -1, False), ("redirect", r"^Redirect$", r"", -1, False), ("ssti", r"^Parse$", r"[Tt]emplate", 0, False), ("log", r"^(Print|Printf|Println|Fatal|Fatalf)$", r"^log$", -1, False)],
    "cs": [("sql", r"^(SqlCommand|NpgsqlCommand|MySqlCommand|SqliteCommand|FromSqlRaw|ExecuteSqlRaw|ExecuteSqlRawAsync|Query|Execute)$", r"", 0, False), ("cmd", r"^(Start|ProcessStartInfo)$", r"^(|Process)$", -1, False), ("path", r"^(ReadAllText|ReadAllBytes|OpenRead|Open|FileStream|StreamReader|PhysicalFile)$", r"^(|File|System\.IO\.File)$", 0, False), ("path", r"^(WriteAllText|WriteAllBytes|Delete|Move|Copy|AppendAllText|Create)$", r"^(File|Directory|System\.IO\.File)$", 0, True), ("ssrf", r"^(GetAsync|GetStringAsync|PostAsync|GetStreamAsync|DownloadString|Create)$", r"(?i)(client|http|WebRequest)", 0, False), ("redirect", r"^(Redirect|RedirectPermanent)$", r"", 0, False), ("ssti", r"^(Parse|Compile|RunCompile)$", r"(?i)(template|razor|engine)", 0, False), ("log", r"^Log(Trace|Debug|Information|Warning|Error|Critical)$", r"", -1, False)],
    "rust": [("sql", r"^(query|query_as|sql_query|prepare|query_row|batch_execute)$", r"", 0, False), ("sql", r"^execute$", r".", 0, True), ("cmd", r"^(arg|args)$", r"Command::new", -1, False), ("cmd", r"^new$", r"Command$", 0, False), ("ssrf", r"^(get|post|put|delete)$", r"^(reqwest|reqwest::blocking|client)$", 0, False), ("redirect", r"^(to|temporary|permanent)$", r"Redirect$", 0, False)],
}
SANITIZERS = {"": r"\b(Integer\.parseInt|Long\.parseLong|strconv\.Atoi|strconv\.ParseInt|int\.Parse|Guid\.Parse|UUID\.fromString|int|float|Number|parseInt|parseFloat|toInt|parse::<)\b", "cmd": r"\b(shlex\.quote|quote|escapeshellarg|shellescape)\b", "path": r"\b(secure_filename|basename|path\.basename|filepath\.Base|Path\.GetFileName|getFileName|FilenameUtils\.getName)\b", "log": r"\b(replace|replaceAll|encode|strip|escape\w*)\s*\(", "redirect": r"\b(url_for|is_safe_url|url_has_allowed_host_and_scheme)\b", "ssrf": r"\bvalidate_url\b", "sql": r"\b(escape|quote_ident|mysql_real_escape_string)\b", "ssti": r"\bescape\b"}
GUARDS = {"path": r"(startswith|startsWith|StartsWith|HasPrefix|starts_with|is_relative_to)\s*\("}
def unambiguous(table: DataFrame, *keys: str) -> DataFrame:
    """The rows of a table whose keys stand in no other row."""
    rest = [c for c in table.columns if c not in keys]
    one = table.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct(*rest)).alias("_r")).filter("_n = 1")
    return one.select(*keys, "_r.*")


def taint(files: DataFrame) -> DataFrame:
    """Findings of flows from inputs to sinks in files, through functions of the whole tree (plans/flows.py)."""
    found = flows.hits(files.filter(F.col("language").isin(*FAMILY) & (F.length("content") <= MAX_FLOW_BYTES)))
    one = found.groupBy("rel_path", "rule", "line").agg(F.bool_or("write").alias("write"), F.min_by("function", "source_line").alias("function"), F.min("source_line").alias("source_line"), F.min("via").alias("via"))
    one = one.withColumn("flow", F.struct("source_line", F.col("line").alias("sink_line"))).withColumn("description", F.concat(F.replace(F.col("rule"), F.lit("-"), F.lit(" ")), F.coalesce(F.concat(F.lit(" (via "), "via", F.lit("())")), F.lit(""))))
    metas = {f"{fam}-{KEY_NAMES[k]}": (*v, "taint") for fam in CALLS for k, v in SINKS.items() if (fam, k) not in LACKING}
    return _shaped(one, metas)


def audit(files: DataFrame) -> DataFrame:
    """All findings in files (rel_path, language, content): text rules, structure without its twins among the flows, flows."""
    from quern.plans import report

    flow, found = kept(taint(files)), parsed(files)
    structure = structural(files, found)
    covered = flow.select("file", "line", "category").distinct()
    rest = structure.join(covered, ["file", "line", "category"], "left_anti")
    tests = source.exploded(found, "tests").select(F.col("rel_path").alias("file"), "start_line", "end_line")
    return fd.reclassified(report.text_findings(files).unionByName(rest.select(*flow.columns)).unionByName(flow), tests).select(*flow.columns)


def rule_rank(severity: Column) -> Column:
    return mapped(severity, {"low": 0, "medium": 1, "high": 2, "critical": 3})
