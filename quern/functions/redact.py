"""Redaction of secrets as Column expressions: ordered rewrites, detection, configuration lines, JSON-like maps."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import comment_sign

MARK = "[REDACTED]"

# Labels and patterns of secrets, in the order in which they are applied.
SECRETS: tuple[tuple[str, str], ...] = (
    ("OPENAI_KEY", r"sk-[a-zA-Z0-9]{32,}"),
    ("AWS_ACCESS_KEY", r"\bAKIA[0-9A-Z]{16}\b"),
    ("JWT_TOKEN", r"\beyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\b"),
    ("DB_CONNECTION_URI", r"""(?i)(postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|mssql|mariadb|sqlite)://[^\s"'`\r\n]+"""),
    ("PRIVATE_IP", r"\b(10\.\d{1,3}\.\d{1,3}\.\d{1,3}|172\.(1[6-9]|2\d|3[01])\.\d{1,3}\.\d{1,3}|192\.168\.\d{1,3}\.\d{1,3})\b"),
    ("GITHUB_TOKEN", r"\bgh[pousr]_[A-Za-z0-9_]{8,}\b"),
    ("GENERIC_SECRET", r"""(?i)(password|passwd|pwd|secret|api_key|apikey|auth_token|access_token|private_key)\s*[=:]\s*("[^"\r\n]{8,}"|'[^'\r\n]{8,}'|[A-Za-z0-9!@#$%^&*()\-_+=\[\]{};:|,.<>/?]{8,})"""),
    ("PEM_PRIVATE_KEY", r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----"),
    ("INTERNAL_HOSTNAME", r"\b[\w-]+\.(internal|corp|local|lan|intranet)\b"),
)
# Configuration files and remarks that tell of people.
CONFIG_IPV4 = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"
CONFIG_KEY = r"(?i)(password|passwd|pwd|secret|token|api[-_.]?key|apikey|auth|credential|private[-_.]?key|keystore|dsn|connection[-_.]?string|access[-_.]?key|client[-_.]?secret)"
CONFIG_LINE = r"^(\s*)([^:=#!\s][^:=]*?)(\s*[:=]\s*)(.*)$"
REMARK = r"(?im)//[^\n]*(confidential|classified|do\s+not\s+share|employee\s+id|salary|ssn|social\s+security|do\s+not\s+commit)"
SENSITIVE_KEYS = ("api_key", "password", "token", "secret", "authorization", "private_key")
REMARK_TEXT = "// [REDACTED COMMENT]"


def _to(mark: str) -> Column:
    return F.lit(mark.replace("\\", "\\\\").replace("$", "\\$"))


def secrets(custom: Iterable[str] = ()) -> list[tuple[str, str]]:
    """The patterns with the valid ones of custom after them, labelled CUSTOM_PATTERN:<pattern>."""
    out = list(SECRETS)
    for p in custom:
        try:
            re.compile(p)
        except re.error:
            continue
        out.append((f"CUSTOM_PATTERN:{p}", p))
    return out


def redacted(text: Column, custom: Iterable[str] = (), mark: str = MARK) -> Column:
    """text with every pattern replaced in turn, each on what the one before it left."""
    for _, p in secrets(custom):
        text = F.regexp_replace(text, F.lit(p), _to(mark))
    return text


def _bound(value: Column, to: Callable[[Column], Column]) -> Column:
    """to(value), value worked out once for a row, however often to names it."""
    return F.transform(F.array(value), to)[0]


def fired(text: Column, custom: Iterable[str] = (), mark: str = MARK) -> Column:
    """The labels that replace something, in order, each tested on what the one before it left."""
    at = F.struct(text.alias("text"), F.array().cast("array<string>").alias("labels"))
    for label, p in secrets(custom):
        hit = lambda x: F.struct(F.regexp_replace(x["text"], F.lit(p), _to(mark)).alias("text"), F.concat(x["labels"], F.array(F.lit(label))).alias("labels"))  # noqa: B023, E731
        at = _bound(at, lambda x: F.when(F.regexp_like(x["text"], F.lit(p)), hit(x)).otherwise(x))  # noqa: B023
    return at["labels"]


def detected(text: Column, custom: Iterable[str] = ()) -> Column:
    """An array of (label, value) of all matches of each pattern in the text as it is."""
    def matches(label: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda v: F.struct(F.lit(label).alias("label"), v.alias("value")))

    each = [matches(label, p) for label, p in secrets(custom)]
    return F.concat(*each)


def config_value(value: Column, mark: str = MARK) -> Column:
    """A configuration value: patterns, then every IPv4 address except loopback and 0.0.0.0."""
    value = redacted(value, mark=mark)
    keep = {"127.0.0.1": "\u0001", "0.0.0.0": "\u0002"}
    for ip, sign in keep.items():
        value = F.regexp_replace(value, F.lit(rf"\b{re.escape(ip)}\b"), F.lit(sign))
    value = F.regexp_replace(value, F.lit(CONFIG_IPV4), _to(mark))
    for ip, sign in keep.items():
        value = F.replace(value, F.lit(sign), F.lit(ip))
    return value


def addresses(value: Column) -> Column:
    """The IPv4 addresses in a text, but for loopback and 0.0.0.0."""
    return F.filter(F.regexp_extract_all(value, F.lit(CONFIG_IPV4), F.lit(0)), lambda x: ~x.isin("127.0.0.1", "0.0.0.0"))


#: Characters or words without which no pattern of a value fits.
_MAY = r"(?i)[0-9]|://|-----|sk-|gh[pousr]_|eyj|akia|passw|pwd|secret|api_?key|auth_token|access_token|private_key|\.(internal|corp|local|lan|intranet)"


def config_line(line: Column, mark: str = MARK) -> Column:
    """A line of a configuration file: comments and empty values stay, sensitive keys lose their value, the rest is searched.

    Key and value are cut off by one search each; the patterns run only over values that may hold what they look for.
    """
    start = F.substring(F.ltrim(line), 1, 1)
    split = F.regexp_instr(line, F.lit("[:=]"))
    key = F.substring(line, F.lit(1), split - 1)
    keyed = (split > 1) & F.regexp_like(key, F.lit(r"\S"))
    head = F.regexp_extract(F.substring(line, split, F.length(line)), r"^([:=]\s*)", 1)
    value = F.substring(line, split + F.length(head), F.length(line))
    searched = lambda v: F.when(F.regexp_like(v, F.lit(_MAY)), config_value(v, mark)).otherwise(v)
    return (
        F.when((F.trim(line) == "") | start.isin("#", "!"), line)
        .when(~keyed, searched(line))
        .when(F.trim(value) == "", line)
        .when(F.regexp_like(key, F.lit(CONFIG_KEY)), F.concat(key, head, F.lit(mark)))
        .otherwise(F.concat(key, head, searched(value)))
    )


def config_text(text: Column, mark: str = MARK) -> Column:
    """A configuration text, line by line; its last line break goes."""
    lines = F.split(F.regexp_replace(text, r"\r?\n$", ""), r"\r?\n")
    return F.array_join(F.transform(lines, lambda x: config_line(x, mark)), "\n")


def without_remarks(text: Column, to: str = REMARK_TEXT) -> Column:
    """text without line comments up to a word that tells of people or confidence."""
    return F.regexp_replace(text, F.lit(REMARK), _to(to))


PLACEHOLDER = "Body left out"


def stripped_body(body: Column, start: Column, end: Column, language: Column, placeholder: str = PLACEHOLDER) -> Column:
    """A function's text with its body, the bytes from start to end, replaced by a remark; as it is where the range does not fit.

    Python bodies become a comment and pass at the body's own indentation; what stands between braces, or after a sign,
    becomes a comment one level deeper than the line before it.
    """
    raw = F.encode(body, "UTF-8")
    fits = start.isNotNull() & (start >= 0) & (start <= end) & (end <= F.octet_length(body))
    piece = lambda a, n: F.decode(F.substring(raw, a, n), "UTF-8")
    before, inside, after = piece(F.lit(1), start), piece(start + 1, end - start), piece(end + 1, F.octet_length(body) - end)
    indent = F.regexp_extract(inside, r"(?m)^([ \t]*)\S", 1)
    deeper = F.concat(F.regexp_extract(F.regexp_extract(F.rtrim(before), r"([^\n]*)$", 1), r"^([ \t]*)", 1), F.lit("    "))
    python = F.concat(before, F.when(indent == "", deeper).otherwise(indent), F.lit(f"# [{placeholder}]\n"), F.when(indent == "", deeper).otherwise(indent), F.lit("pass"), after)
    braces = F.concat(before, F.lit("\n"), deeper, F.lit(f"/* {placeholder} */\n"), after)
    other = F.concat(before, F.lit("\n"), deeper, comment_sign(language), F.lit(f" [{placeholder}]\n"), after)
    return F.when(~F.coalesce(fits, F.lit(False)), body).when(language == "python", python).when(F.rtrim(before).endswith("{"), braces).otherwise(other)


def function_source(text: Column, custom: Iterable[str] = (), mark: str = MARK) -> Column:
    """The body of a function: remarks, then secrets."""
    return redacted(without_remarks(text), custom, mark)


def shown_functions(functions: DataFrame, custom: Iterable[str] = (), placeholder: str = PLACEHOLDER, mark: str = MARK) -> DataFrame:
    """functions (of an analysis) with body as it may be shown: left out where that is asked for, else without remarks, then without secrets."""
    bare = F.when(F.col("is_stripped"), stripped_body(F.col("body"), F.col("body_start"), F.col("body_end"), F.col("language"), placeholder)).otherwise(F.col("body"))
    return functions.withColumn("body", function_source(bare, custom, mark))


def redacted_map(values: Column, mark: str = MARK) -> Column:
    """A map of strings: values of sensitive keys are replaced, others are searched."""
    return F.transform_values(values, lambda k, v: F.when(F.lower(k).isin(*SENSITIVE_KEYS), F.lit(mark)).otherwise(redacted(v, mark=mark)))


_JSON = r'"(?:\\.|[^"\\])*"|[{}\[\],:]|[^\s{}\[\],:"]+'


def redacted_json(df: DataFrame, column: str, custom: Iterable[str] = (), mark: str = MARK) -> DataFrame:
    """df with JSON text of any depth redacted: values of sensitive keys are replaced, other strings are searched; null where it is no JSON.

    Each text is worked on in its row, in time linear in its tokens: a fold over them finds the stretches that are values
    of sensitive keys, and what is between those is put together again, without space. Texts with a key twice in an object
    are no JSON.
    """
    custom = tuple(custom)
    valid = F.try_parse_json(F.col(column)).isNotNull()
    tokens = F.regexp_extract_all(column, F.lit(_JSON), F.lit(0))
    return df.withColumn(column, F.when(valid, _bound(tokens, lambda t: _redacted_tokens(t, custom, mark))))


def _redacted_tokens(tokens: Column, custom: tuple[str, ...], mark: str) -> Column:
    """The tokens of a JSON text put together, redacted."""
    said = lambda x: F.get_json_object(F.concat(F.lit("["), x, F.lit("]")), "$[0]")
    inner = lambda x: F.substring(x, F.lit(2), F.length(x) - 2)
    escaped = lambda x: x.contains("\\")
    quoted = lambda x: inner(F.to_json(F.array(x)))
    text = lambda x: F.when(escaped(x), said(x)).otherwise(inner(x))

    def kind(x: Column, k: Column) -> Column:
        """8 times the place, and 1 for what opens, 2 for what closes, 4 for the first token of a sensitive value."""
        key = F.get(tokens, k - 2)
        named = F.when((F.get(tokens, k - 1) == ":") & key.startswith('"'), F.lower(text(key)).isin(*SENSITIVE_KEYS))
        return k * 8 + F.when(x.isin("{", "["), 1).when(x.isin("}", "]"), 2).otherwise(0) + F.when(named, 4).otherwise(0)

    def step(a: Column, x: Column) -> Column:
        """How deep in a sensitive value (0: in none), and the places where such values begin and end."""
        state = lambda depth, begin, end: F.struct(depth.alias("depth"), begin.alias("begin"), end.alias("end"))
        more = lambda places: F.concat(places, F.array(F.shiftright(x, 3)))
        depth = a["depth"] + F.when(x % 4 == 1, 1).when(x % 4 == 2, -1).otherwise(0)
        inside = F.when((a["depth"] == 1) & (x % 4 == 2), state(F.lit(0), a["begin"], more(a["end"]))).otherwise(state(depth, a["begin"], a["end"]))
        begins = F.when(x % 4 == 1, state(F.lit(1), more(a["begin"]), a["end"])).otherwise(state(F.lit(0), more(a["begin"]), more(a["end"])))
        return F.when(a["depth"] > 0, inside).when(x % 8 < 4, a).otherwise(begins)

    def shown(x: Column, k: Column) -> Column:
        """A token that stays; k is its place."""
        searched = F.lit(True) if custom else F.regexp_like(x, F.lit(_MAY))
        key = F.get(tokens, k + 1) == ":"
        return F.when(~x.startswith('"'), x).when(key, F.when(escaped(x), quoted(said(x))).otherwise(x)).when(escaped(x) | searched, quoted(redacted(text(x), custom, mark))).otherwise(x)

    none = F.array().cast("array<int>")
    start = F.struct(F.lit(0).alias("depth"), none.alias("begin"), none.alias("end"))

    def whole(a: Column) -> Column:
        n = F.size(a["begin"])

        def piece(k: Column) -> Column:
            """The tokens before the k-th sensitive value, or after the last, and the mark that stands for it."""
            first = F.coalesce(F.get(a["end"], k - 1) + 1, F.lit(0))
            kept = F.slice(tokens, first + 1, F.coalesce(F.get(a["begin"], k), F.size(tokens)) - first)
            return F.concat(F.array_join(F.transform(kept, lambda x, i: shown(x, first + i)), ""), F.when(k < n, quoted(F.lit(mark))).otherwise(F.lit("")))

        return F.array_join(F.transform(F.sequence(F.lit(0), n), piece), "")

    return _bound(F.aggregate(F.filter(F.transform(tokens, kind), lambda x: x % 8 > 0), start, step), whole)


def redacted_edges(edges: DataFrame, custom: Iterable[str] = (), on: bool = True) -> DataFrame:
    """A dependency graph with both ends of its edges, and their labels if there are any, redacted."""
    return redacted_columns(edges, *[c for c in ("src", "dst", "label") if c in edges.columns], custom=custom, on=on)


def redacted_columns(df: DataFrame, *columns: str, custom: Iterable[str] = (), on: bool = True) -> DataFrame:
    """df with the columns redacted, or as it is if the policy is off."""
    return df.withColumns({c: redacted(F.col(c), custom) for c in columns}) if on else df
