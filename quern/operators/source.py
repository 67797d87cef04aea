"""Source code as tables: tokens, functions, types, imports, strings, calls, assignments, comments.

One table-driven lexer serves all languages; a light structural pass over its tokens finds definitions, calls and
assignments. It runs in Arrow batches, a file at a time, and each file's rows depend on that file alone.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.sources.store import spread

BRACES = ("rust", "go", "java", "javascript", "typescript", "tsx", "kotlin", "csharp", "c")
_HASH = ("python",)
_WORDS_BEFORE_PAREN = frozenset((
    "if", "for", "while", "switch", "catch", "return", "match", "when", "else", "do", "try", "with", "elif", "and", "or", "not", "in", "sizeof", "typeof", "new", "await", "yield",
    "throw", "using", "lock", "synchronized", "fn", "func", "fun", "function", "defer", "select", "case", "assert", "import", "async",
))
_TYPE_WORDS = {
    "rust": ("struct", "enum", "trait", "union", "type", "impl"), "go": ("type",), "java": ("class", "interface", "enum", "record", "@interface"), "javascript": ("class",), "typescript": ("class", "interface", "enum", "type"),
    "tsx": ("class", "interface", "enum", "type"), "kotlin": ("class", "interface", "object"), "csharp": ("class", "interface", "struct", "enum", "record"), "python": ("class",), "c": ("struct", "union", "enum"),
}
#: Words that open a block which may not run.
_BRANCH_WORDS = frozenset(("if", "else", "elif", "for", "foreach", "while", "switch", "case", "match", "when", "catch", "try", "except", "finally", "loop", "select", "do"))
#: The comment that asks for a function's body to be left out of what is shown.
STRIP = "@quern-strip"
_SCRIPTS = ("javascript", "typescript", "tsx")
_FN_WORDS = {"rust": "fn", "go": "func", "kotlin": "fun", "javascript": "function", "typescript": "function", "tsx": "function", "python": "def"}
_REST = (
    r'(?P<string>"""(?:.*?)(?:"""|$)|\'\'\'(?:.*?)(?:\'\'\'|$)|[rbfuRBFU$@]{0,2}"(?:\\.|[^"\\\n])*(?:"|(?=\n)|$)|[rbfuRBFU]{0,2}\'(?:\\.|[^\'\\\n])*(?:\'|(?=\n)|$)|`(?:\\.|[^`\\])*(?:`|$))'
    r"|(?P<number>[0-9][0-9A-Za-z_.]*)|(?P<name>[^\W\d]\w*)|(?P<op>=>|->|::|:=|==|!=|<=|>=|&&|\|\||\+=|[^\s\w])"
)
#: By whether # opens a comment, and not // and /*.
_TOKEN = {True: re.compile(r"(?P<comment>#[^\n]*)|" + _REST, re.S), False: re.compile(r"(?P<comment>//[^\n]*|/\*.*?(?:\*/|$))|" + _REST, re.S)}


@dataclass(slots=True)
class Token:
    kind: str
    text: str
    start: int
    end: int
    line: int


@dataclass
class Unit:
    """What a file holds."""

    functions: list[dict] = field(default_factory=list)
    types: list[dict] = field(default_factory=list)
    imports: list[dict] = field(default_factory=list)
    strings: list[dict] = field(default_factory=list)
    calls: list[dict] = field(default_factory=list)
    assigns: list[dict] = field(default_factory=list)
    comments: list[dict] = field(default_factory=list)
    tests: list[dict] = field(default_factory=list)
    module_doc: str | None = None


def _lifetime(s: str) -> bool:
    """Whether what looks like a text of Rust begins with the sign of a lifetime."""
    return s[0] == "'" and (len(s) < 3 or s[-1] != "'" or re.match(r"'\w+'?\w", s) is not None and "'" not in s[1:3] and s[1] != "\\")


def tokens(text: str, language: str) -> list[Token]:
    """The tokens of a text; # opens a comment in Python only, // and /* in the others."""
    out, line, pos, pattern, lifetimes = [], 1, 0, _TOKEN[language in _HASH], language == "rust"
    brk = text.find("\n")
    while pos is not None:
        at, pos = pos, None
        for m in pattern.finditer(text, at):
            start, end = m.span()
            kind, s = m.lastgroup, m[0]
            while -1 < brk < start:
                line, brk = line + 1, text.find("\n", brk + 1)
            if lifetimes and kind == "string" and _lifetime(s):
                out.append(Token("op", "'", start, start + 1, line))
                pos = start + 1
                break
            out.append(Token(kind, s, start, end, line))
    return out


class Text:
    """A text with the places of its line breaks, and its lines."""

    def __init__(self, text: str):
        self.text, self.rows = text, text.split("\n")
        self.breaks = [m.start() for m in re.finditer("\n", text)]

    def line(self, at: int) -> int:
        """The number of the line (from 1) that the place is in."""
        return bisect_right(self.breaks, at - 1) + 1


_CLOSING = {"(": ")", "[": "]", "{": "}"}


def _brackets(toks: list[Token]) -> dict[int, int]:
    """For each bracket the place of its partner; one that is never closed ends at the last token. Kinds are matched one by one."""
    out: dict[int, int] = {}
    for open_, close in _CLOSING.items():
        held: list[int] = []
        for k, t in enumerate(toks):
            if t.kind == "op" and t.text == open_:
                held.append(k)
            elif t.kind == "op" and t.text == close and held:
                j = held.pop()
                out[j], out[k] = k, j
        out.update((j, len(toks) - 1) for j in held)
    return out


def is_public(language: str, name: str, before: str) -> bool:
    if language == "python":
        return not name.startswith("_")
    if language == "go":
        return name[:1].isupper()
    if language == "rust":
        return bool(re.search(r"\bpub\b", before))
    if language in ("javascript", "typescript", "tsx"):
        return bool(re.search(r"\bexport\b", before))
    if language == "kotlin":
        return not re.search(r"\b(private|internal|protected)\b", before)
    if language in ("java", "csharp"):
        return bool(re.search(r"\bpublic\b", before))
    return not re.search(r"\bstatic\b", before)


_IMPORTS = {
    "python": re.compile(r"^\s*(?:from\s+([\w.]+)\s+import\b.*|import\s+([\w.]+).*)$", re.M), "rust": re.compile(r"^\s*(?:pub\s+)?use\s+([\w:]+)[^;]*;", re.M), "java": re.compile(r"^\s*import\s+(?:static\s+)?([\w.*]+)\s*;", re.M),
    "kotlin": re.compile(r"^\s*import\s+([\w.*]+)", re.M), "csharp": re.compile(r"^\s*using\s+(?:static\s+)?([\w.]+)\s*;", re.M), "c": re.compile(r"^\s*#\s*include\s*[<\"]([^>\"]+)[>\"]", re.M),
    "go": re.compile(r"^\s*(?:import\s+)?(?:[\w.]+\s+)?\"([^\"\n]+)\"\s*$", re.M), "javascript": re.compile(r"(?:import\s+(?:[^'\";]*?from\s+)?|require\(\s*|export\s+[^'\";]*?from\s+)['\"]([^'\"]+)['\"]"),
}
_IMPORTS["typescript"] = _IMPORTS["tsx"] = _IMPORTS["javascript"]


def imports(text: str, language: str, at: Text | None = None) -> list[dict]:
    pattern, at = _IMPORTS.get(language), at or Text(text)
    out = []
    open_ = [m.span() for m in re.finditer(r"(?m)^\s*import\s*\([^)]*", text)] if language == "go" else []
    for m in pattern.finditer(text) if pattern else ():
        if language == "go" and "import" not in m[0] and not any(a <= m.start() < b for a, b in open_):
            continue
        path = next(g for g in m.groups() if g)
        out.append({"raw": m[0].strip(), "path": path, "line": at.line(m.start(1) if m[1] else m.start())})
    return out


def _doc(at: Text, line: int, language: str) -> str | None:
    """The comment lines right above a line."""
    rows, out, k = at.rows, [], line - 2
    sign = ("#", "@") if language == "python" else ("//", "/*", "*", "*/", "#[", "@", "[")
    while k >= 0 and rows[k].strip().startswith(sign):
        if not rows[k].strip().startswith(("#[", "@", "[")):
            out.append(rows[k].strip())
        k -= 1
    return "\n".join(reversed(out)) or None


def module_doc(at: Text, language: str) -> str | None:
    """The comment at the head of a file: inner doc lines of Rust, a Python docstring, a block comment of Java and scripts."""
    first = next((k for k, r in enumerate(at.rows) if r.strip()), None)
    if first is None:
        return None
    head = at.rows[first].strip()
    if language == "rust":
        run = []
        for r in at.rows:
            if r.strip() and not r.strip().startswith("//!"):
                break
            run += [r] if r.strip() else []
        return "\n".join(run) or None
    mark = {"python": ('"""', "'''"), "java": ("/*",), "javascript": ("/*",), "typescript": ("/*",), "tsx": ("/*",)}.get(language, ())
    opened = next((m for m in mark if head.startswith(m)), None)
    if opened is None:
        return None
    close, out = "*/" if opened == "/*" else opened, []
    for k in range(first, len(at.rows)):
        out.append(at.rows[k])
        if close in (head[len(opened) :] if k == first else at.rows[k]):
            break
    return "\n".join(out)


def test_ranges(toks: list[Token], pairs: dict[int, int]) -> list[dict]:
    """start_line and end_line of the modules and functions of Rust that carry a test attribute; those inside are not listed."""
    out, marked, k = [], False, 0
    while k < len(toks):
        t = toks[k]
        if t.text == "#" and k + 1 < len(toks) and toks[k + 1].text == "[":
            end = pairs.get(k + 1, k + 1)
            words = "".join(x.text for x in toks[k + 2 : end])
            marked |= "cfg(test)" in words or words.startswith("test") or "::test" in words
            k = end + 1
            continue
        if t.text in ("pub", "async", "unsafe", "const", "extern") or t.kind == "string" or t.text == "(" and toks[k - 1].text == "pub":
            k = pairs.get(k, k) + 1
            continue
        if marked and t.text in ("mod", "fn"):
            body = next((j for j in range(k, len(toks)) if toks[j].text in ("{", ";")), len(toks) - 1)
            end = pairs.get(body, body)
            start = k
            while start and toks[start - 1].text in ("pub", "async", "unsafe", "const", "extern"):
                start -= 1
            out.append({"start_line": toks[start].line, "end_line": toks[end].line})
            k = end
        marked = False
        k += 1
    return out


def _stripped(rows: list[str], line: int, body: int, marker: str) -> bool:
    """Whether the comment right above a function's line, or one before the first statement of its body, holds the marker."""
    above = rows[line - 2].strip() if line > 1 else ""
    if marker in above and above.startswith(("//", "#", "/*", "*")):
        return True
    for row in rows[body:]:
        row = row.strip()
        if row and not row.startswith(("//", "#", "/*", "*")):
            return False
        if marker in row:
            return True
    return False


def _size(text: str) -> int:
    return len(text.encode())


def _python(at: Text, unit: Unit, marker: str) -> None:
    text, rows = at.text, at.rows
    heads = re.compile(r"^([ \t]*)(?:async\s+)?(def|class)\s+(\w+)", re.M)
    stack: list[tuple[int, str, str]] = []
    for m in heads.finditer(text):
        indent, line = len(m[1].expandtabs()), at.line(m.start(2))
        stack = [x for x in stack if x[0] < indent]
        end, depth = line, 0
        open_to = m.end()
        for k in range(open_to, len(text)):
            depth += (text[k] in "([{") - (text[k] in ")]}")
            if text[k] == ":" and depth == 0:
                open_to = k
                break
        first = at.line(open_to)
        for n in range(first, len(rows)):
            if rows[n].strip() and len(rows[n].expandtabs()) - len(rows[n].expandtabs().lstrip()) <= indent:
                break
            if rows[n].strip():
                end = n + 1
        end = max(end, first)
        owner = ".".join(x[1] for x in stack if x[2] == "class") or None
        if m[2] == "def":
            sig = " ".join(text[m.start(2) : open_to].split())
            body = "\n".join(rows[line - 1 : end])
            head = _size("\n".join(rows[line - 1 : first])) + 1
            params = [p.strip().lstrip("*").split(":")[0].split("=")[0].strip() for p in re.split(r",(?![^\[(]*[\])])", sig[sig.find("(") + 1 : sig.rfind(")")]) if p.strip()]
            unit.functions.append({"name": m[3], "qualified_name": f"{owner}.{m[3]}" if owner else m[3], "owner": owner, "signature": sig, "start_line": line, "end_line": end, "body": body, "doc": _doc(at, line, "python"), "is_public": not m[3].startswith("_"), "params": params, "body_start": head if end > first else None, "body_end": _size(body) if end > first else None, "is_stripped": _stripped(rows, line, first, marker), "span": (m.start(2), at.breaks[end - 1] if end <= len(at.breaks) else len(text)), "inside": at.breaks[first - 1] if first <= len(at.breaks) else len(text)})
        else:
            unit.types.append({"name": m[3], "kind": "class", "start_line": line, "end_line": end, "doc": _doc(at, line, "python"), "is_public": not m[3].startswith("_"), "span": (m.start(2), at.breaks[end - 1] if end <= len(at.breaks) else len(text))})
        stack.append((indent, m[3], m[2]))


def _bound(toks: list[Token], k: int, pairs: dict[int, int]) -> int | None:
    """The place of the name that the arrow or nameless function at k is bound to, as a variable, key or target."""
    j = k - 1
    if toks[k].text == "=>":
        j = pairs.get(j, j) - 1 if toks[j].text == ")" else j - 1
    if j >= 0 and toks[j].text == "async":
        j -= 1
    return j - 1 if j >= 1 and toks[j].text in ("=", ":") and toks[j - 1].kind == "name" else None


def _braces(at: Text, toks: list[Token], language: str, unit: Unit, pairs: dict[int, int], marker: str) -> None:
    text, kinds, words = at.text, frozenset(_TYPE_WORDS.get(language, ())), _FN_WORDS.get(language)
    owners: list[tuple[int, str]] = []
    n = len(toks)

    def function(name: Token, owner: list[str], head: str, body: int, end: int, params: list[Token]) -> None:
        start = text.rfind("\n", 0, name.start) + 1
        sep = "::" if language == "rust" else "."
        names = [[x.text for x in part if x.kind == "name"] for part in _split(params)]
        last = language in ("java", "csharp", "c")
        inside = (_size(text[start : toks[body].end]), _size(text[start : toks[end].start])) if toks[body].text == "{" and toks[end].text == "}" else (_size(text[start : toks[body].end]), _size(text[start : toks[end].end]))
        unit.functions.append({"name": name.text, "qualified_name": sep.join([*owner, name.text]), "owner": sep.join(owner) or None, "signature": " ".join(head.split()), "start_line": name.line, "end_line": toks[end].line, "body": text[start : toks[end].end], "doc": _doc(at, name.line, language), "is_public": is_public(language, name.text, head), "params": [p[-1] if last else next((x for x in p if x not in ("mut", "self", "val", "var")), p[0]) for p in names if p], "body_start": inside[0], "body_end": inside[1], "is_stripped": _stripped(at.rows, name.line, toks[body].line, marker), "span": (name.start, toks[end].end), "inside": toks[body].start})

    for k, t in enumerate(toks):
        owners = [o for o in owners if o[0] > k]
        if t.kind == "name" and t.text in kinds and k + 1 < n and toks[k + 1].kind == "name":
            name = toks[k + 1].text
            open_ = next((j for j in range(k + 2, min(n, k + 60)) if toks[j].kind == "op" and toks[j].text in "{;"), None)
            if t.text == "impl" and open_ is not None:
                names = [x.text for x in toks[k + 1 : open_] if x.kind == "name"]
                name = names[names.index("for") + 1] if "for" in names and names.index("for") + 1 < len(names) else names[0]
            kind = t.text
            if language == "go" and open_ is not None and toks[k + 2].text in ("struct", "interface"):
                kind = toks[k + 2].text
            end = pairs[open_] if open_ is not None and toks[open_].text == "{" else k + 1
            before = text[text.rfind("\n", 0, t.start) + 1 : t.start]
            unit.types.append({"name": name, "kind": kind, "start_line": t.line, "end_line": toks[end].line, "doc": _doc(at, t.line, language), "is_public": is_public(language, name, before), "span": (t.start, toks[end].end)})
            if end > k + 1:
                owners.append((end, name))
        if language in _SCRIPTS and t.text in ("=>", "function") and k + 1 < n and (bound := _bound(toks, k, pairs)) is not None:
            given = toks[k - 1].text == ")" and t.text == "=>"
            params = toks[pairs[k - 1] + 1 : k - 1] if given else toks[k - 1 : k] if t.text == "=>" else toks[k + 2 : pairs.get(k + 1, k + 1)]
            body = k + 1 if t.text == "=>" else pairs.get(k + 1, k + 1) + 1
            if body < n and toks[body].text == "{":
                function(toks[bound], [o[1] for o in owners], text[text.rfind("\n", 0, toks[bound].start) + 1 : toks[body].start], body, pairs[body], params)
            elif body < n:
                end = next((j for j in range(body, n) if toks[j].text == ";" or toks[j].line > toks[body].line), n - 1)
                function(toks[bound], [o[1] for o in owners], text[text.rfind("\n", 0, toks[bound].start) + 1 : t.end], body, max(body, end - 1), params)
            continue
        if t.kind != "op" or t.text != "(" or not k:
            continue
        name_at = k - 1
        if toks[name_at].text == ">":  # type parameters
            depth = 0
            while name_at > 0:
                depth += (toks[name_at].text == ">") - (toks[name_at].text == "<")
                name_at -= 1
                if depth == 0:
                    break
        name = toks[name_at]
        if name.kind != "name" or name.text in _WORDS_BEFORE_PAREN:
            continue
        close = pairs[k]
        keyword = words and name_at and (toks[name_at - 1].text == words or language == "go" and toks[name_at - 1].text == ")" and any(x.text == "func" for x in toks[max(0, name_at - 12) : name_at]))
        if words and not keyword and not (language in ("javascript", "typescript", "tsx") and owners):
            continue
        if not words and not (toks[name_at - 1].kind == "name" and toks[name_at - 1].text not in ("new", "return", "else", "throw") or toks[name_at - 1].text in (">", "*", "]")):
            continue
        body = None
        for j in range(close + 1, min(n, close + 40)):
            if toks[j].text in (";", "}", ")") or toks[j].text == "=" and language != "kotlin":
                break
            if toks[j].text == "{" or toks[j].text == "=" and language == "kotlin":
                body = j
                break
            if not keyword and toks[j].kind == "op" and toks[j].text not in "->:<>,[]?*&.":
                break
        if body is None:
            continue
        end = pairs[body] if toks[body].text == "{" else next((j for j in range(body, n) if toks[j].line > toks[body].line), n) - 1
        head = text[text.rfind("\n", 0, name.start) + 1 : toks[body].start]
        owner = [o[1] for o in owners]
        if language == "go" and keyword and toks[name_at - 1].text == ")":
            receiver = [x.text for x in toks[max(0, name_at - 6) : name_at - 1] if x.kind == "name"]
            owner = [receiver[-1]] if receiver else owner
        function(name, owner, head, body, end, toks[k + 1 : close])


def _split(toks: list[Token]) -> list[list[Token]]:
    """Tokens between commas outside brackets."""
    out: list[list[Token]] = [[]]
    depth = 0
    for t in toks:
        if t.kind == "op":
            depth += (t.text in ("(", "[", "{")) - (t.text in (")", "]", "}"))
            if t.text == "," and depth == 0:
                out.append([])
                continue
        out[-1].append(t)
    return [p for p in out if p]


def _around(unit: Unit, lines: int) -> list[tuple[str | None, int | None]]:
    """For each line (from 1) the name and first line of the function around it that starts last."""
    out: list[tuple[str | None, int | None]] = [(None, None)] * (lines + 2)
    for f in sorted(unit.functions, key=lambda f: f["start_line"]):
        out[f["start_line"] : f["end_line"] + 1] = [(f["name"], f["start_line"])] * (f["end_line"] + 1 - f["start_line"])
    return out


def _branches(at: Text, code: list[Token], language: str, pairs: dict[int, int]) -> list[tuple[int, int]]:
    """Places (from, to) of the blocks and statements that may not run."""
    out = []
    if language == "python":
        head = re.compile(r"([ \t]*)(?:if|elif|else|for|while|try|except|finally|match|case)\b")
        starts = [0, *(b + 1 for b in at.breaks), len(at.text) + 1]
        held: list[tuple[int, int]] = []  # indentation, start of the block
        for k, row in enumerate(at.rows):
            if not row.strip():
                continue
            indent = len(row.expandtabs()) - len(row.expandtabs().lstrip())
            while held and held[-1][0] >= indent:
                out.append((held.pop()[1], starts[k]))
            if head.match(row):
                held.append((indent, starts[k]))
        return out + [(a, len(at.text)) for _, a in held]
    for k, t in enumerate(code):
        if t.kind == "name" and t.text in _BRANCH_WORDS:
            j = k + 1
            if j < len(code) and code[j].text == "(":
                j = pairs[j] + 1
            while j < len(code) and code[j].text not in ("{", ";", "}") and code[j].line == t.line and code[j].text != "=":
                j += 1
            to = pairs[j] if j < len(code) and code[j].text == "{" else next((x for x in range(j, len(code)) if code[x].text in (";", "}")), len(code) - 1)
            out.append((t.start, code[to].end))
    return out


def _uses(at: Text, code: list[Token], language: str, unit: Unit, pairs: dict[int, int], assigns: bool = True) -> None:
    """Calls with their receiver and arguments, and (if asked for) assignments, with whether they stand in a block that may not run."""
    text, around, opened, open_to = at.text, _around(unit, len(at.rows)), sorted(_branches(at, code, language, pairs)) if assigns else [], -1
    heads, branch = {(f["start_line"], f["name"]) for f in unit.functions}, 0
    for k, t in enumerate(code):
        if t.text == "(" and t.kind == "op" and k and code[k - 1].kind == "name" and (code[k - 1].text not in _WORDS_BEFORE_PAREN or k > 1 and code[k - 2].text in (".", "::")) and (code[k - 1].line, code[k - 1].text) not in heads and not (k > 1 and code[k - 2].text in ("class", "def")):
            name, j = code[k - 1], k - 2
            bang = False
            close = pairs[k]
            while j >= 1 and code[j].text in (".", "::", "?") or j >= 1 and code[j].text == "!":
                bang |= code[j].text == "!"
                j -= 1
                if code[j].text == ")":
                    j = pairs.get(j, 1) - 1
                if code[j].kind in ("name", "string") or code[j].text == "]":
                    j -= 1
            receiver = text[code[j + 1].start : name.start].rstrip(".:? ") if j + 1 < k - 1 else ""
            new = j >= 0 and code[j].text == "new"
            args = [text[p[0].start : p[-1].end] for p in _split(code[k + 1 : close])]
            unit.calls.append({"callee": name.text, "receiver": receiver, "is_new": new, "args": args, "line": name.line, "pos": name.start, "function": around[name.line][0], "within": around[name.line][1]})
        elif t.text == "!" and k and code[k - 1].kind == "name" and k + 1 < len(code) and code[k + 1].text in ("(", "[", "{") and t.start == code[k - 1].end:  # a macro
            close = pairs[k + 1]
            unit.calls.append({"callee": code[k - 1].text + "!", "receiver": "", "is_new": False, "args": [text[p[0].start : p[-1].end] for p in _split(code[k + 2 : close])], "line": t.line, "pos": t.start, "function": around[t.line][0], "within": around[t.line][1]})
        elif assigns and t.kind == "op" and t.text in ("=", ":=", "+=") and k and (code[k - 1].kind == "name" or code[k - 1].text in ("]", "?")) and (k + 1 >= len(code) or code[k + 1].text != "="):
            depth, end = 0, k
            while end + 1 < len(code) and (depth > 0 or code[end + 1].line == code[end].line or code[end].kind == "op" and code[end].text not in (")", "]", "}")):
                if code[end + 1].text in (";",) or depth == 0 and code[end + 1].text in (",", ")", "]", "}"):
                    break
                end += 1
                depth += (code[end].text in ("(", "[", "{")) - (code[end].text in (")", "]", "}"))
            j = k - 1
            while j >= 1 and code[j - 1].line == t.line and (code[j - 1].text in (".", "[", "]", "::") or code[j].text in (".", "]", "[")):
                j -= 1
            target = text[code[j].start : code[k - 1].end]
            while branch < len(opened) and opened[branch][0] <= t.start:
                open_to, branch = max(open_to, opened[branch][1]), branch + 1
            unit.assigns.append({"target": target, "value": text[code[k + 1].start : code[end].end] if end > k else "", "op": t.text, "line": t.line, "pos": t.start, "function": around[t.line][0], "within": around[t.line][1], "branch": t.start < open_to})


#: Tables of a file, and those that its calls, assignments and definitions are found with.
TABLES = ("functions", "types", "imports", "strings", "calls", "assigns", "comments", "tests", "module_doc")
_STRUCTURE = frozenset(("functions", "types", "calls", "assigns"))


def analysed(text: str, language: str, marker: str = STRIP, tables: Iterable[str] = TABLES) -> Unit:
    """The tables of one file, all or those named; others may be empty."""
    unit, at, asked = Unit(), Text(text), frozenset(tables)
    toks = tokens(text, language) if asked - {"imports", "module_doc"} else []
    if asked & _STRUCTURE or "tests" in asked and language == "rust":
        code = [t for t in toks if t.kind != "comment"]
        pairs = _brackets(code)
        unit.tests = test_ranges(code, pairs) if language == "rust" and "tests" in asked else []
    if asked & _STRUCTURE:
        if language == "python":
            _python(at, unit, marker)
        elif language in BRACES:
            _braces(at, code, language, unit, pairs, marker)
        if asked & {"calls", "assigns"}:
            _uses(at, code, language, unit, pairs, "assigns" in asked)
    if "imports" in asked:
        unit.imports = imports(text, language, at)
    if "strings" in asked:
        unit.strings = [{"value": t.text, "line": t.line} for t in toks if t.kind == "string"]
    if "comments" in asked:
        unit.comments = [{"text": t.text, "line": t.line} for t in toks if t.kind == "comment"]
    if "module_doc" in asked:
        unit.module_doc = module_doc(at, language)
    return unit


_COLUMNS = {
    "functions": "array<struct<name:string,qualified_name:string,owner:string,signature:string,start_line:int,end_line:int,body:string,doc:string,is_public:boolean,params:array<string>,body_start:int,body_end:int,is_stripped:boolean>>", "types": "array<struct<name:string,kind:string,start_line:int,end_line:int,doc:string,is_public:boolean>>",
    "imports": "array<struct<raw:string,path:string,line:int>>", "strings": "array<struct<value:string,line:int>>", "calls": "array<struct<callee:string,receiver:string,is_new:boolean,args:array<string>,line:int,pos:int,function:string,within:int>>",
    "assigns": "array<struct<target:string,value:string,op:string,line:int,pos:int,function:string,within:int,branch:boolean>>", "comments": "array<struct<text:string,line:int>>", "tests": "array<struct<start_line:int,end_line:int>>", "module_doc": "string",
}


def analysis(files: DataFrame, marker: str = STRIP, tables: Iterable[str] = TABLES) -> DataFrame:
    """One row for each file (rel_path, language, content) with nested tables, all or those named; files without text or language have empty ones."""
    asked = tuple(t for t in TABLES if t in set(tables))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                units = [analysed(c or "", lang or "", marker, asked) for c, lang in zip(part.column("content").to_pylist(), part.column("language").to_pylist())]
                cols = {"rel_path": part.column("rel_path"), "language": part.column("language")}
                for name in asked:
                    cols[name] = pa.array([getattr(u, name) for u in units], _ARROW[name])
                yield pa.RecordBatch.from_pydict(cols)

    schema = ", ".join(["rel_path string", "language string", *(f"{c} {_COLUMNS[c]}" for c in asked)])
    return spread(files.select("rel_path", "language", "content")).mapInArrow(run, schema)


def _list(**fields: pa.DataType) -> pa.DataType:
    return pa.list_(pa.struct(list(fields.items())))


_S, _I, _B = pa.string(), pa.int32(), pa.bool_()
_ARROW = {
    "functions": _list(name=_S, qualified_name=_S, owner=_S, signature=_S, start_line=_I, end_line=_I, body=_S, doc=_S, is_public=_B, params=pa.list_(_S), body_start=_I, body_end=_I, is_stripped=_B), "types": _list(name=_S, kind=_S, start_line=_I, end_line=_I, doc=_S, is_public=_B), "imports": _list(raw=_S, path=_S, line=_I),
    "strings": _list(value=_S, line=_I), "calls": _list(callee=_S, receiver=_S, is_new=_B, args=pa.list_(_S), line=_I, pos=_I, function=_S, within=_I), "assigns": _list(target=_S, value=_S, op=_S, line=_I, pos=_I, function=_S, within=_I, branch=_B), "comments": _list(text=_S, line=_I), "tests": _list(start_line=_I, end_line=_I), "module_doc": _S,
}


def exploded(found: DataFrame, table: str) -> DataFrame:
    """rel_path, language and the columns of one nested table."""
    return found.select("rel_path", "language", F.explode(table).alias("_r")).select("rel_path", "language", "_r.*")


def symbols(functions: DataFrame, name: str, mode: str = "auto", hint: str | None = None) -> DataFrame:
    """Functions by simple or qualified name; auto takes qualified for names with a separator, else simple and, if there is none, qualified."""
    if mode == "auto":
        mode = "qualified" if "." in name or "::" in name else "simple"
        if mode == "simple" and functions.filter(F.col("name") == name).limit(1).count() == 0:
            mode = "qualified"
    out = functions.filter(F.col("qualified_name" if mode == "qualified" else "name") == name)
    return out if hint is None else out.filter(F.lower("signature").contains(hint.lower()))
