"""What moves values in source code, as rows: definitions, arguments of calls and returns, with the names that they use.

Tokens of a file become sites. A site is a place that a value goes to: a name that is bound (a definition, or a call that
puts its arguments into what it is called on), an argument of a call, or what a function returns. With each site stand
the names that its value uses, the calls that each of these passes through on its way, and the kinds of sinks for which
it survives, as bits: a sanitizer around it takes bits away. A name in a scope has a version for each definition that
binds it as a whole and surely runs, in the order of the text; names that the file does not bind are left out. Nothing is
decided here; plans/flows.py joins the rows.

Each file is read once, in time linear in its tokens. A value that is nested in more than DEEP calls goes on under a
name made for the call at that depth, so that no token is read more than DEEP times.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from quern.operators import source
from quern.operators.source import Token
from quern.plans import flowrules
from quern.sources.store import spread

KINDS = tuple(flowrules.SINKS)
EVERY = (1 << len(KINDS)) - 1
DEEP = 6
LAST = (1 << 31) - 1
_WORDS = frozenset((
    "if", "elif", "else", "for", "foreach", "while", "return", "new", "await", "yield", "not", "and", "or", "in", "is", "of", "as", "lambda", "try", "match", "when", "case", "switch", "throw", "raise", "const", "let", "var", "val", "mut",
    "final", "static", "public", "private", "protected", "readonly", "async", "typeof", "instanceof", "range", "move", "ref", "unsafe", "None", "True", "False", "null", "true", "false", "nil", "def", "function", "func", "fn", "fun",
))
_INTERPOLATED = re.compile(r"\$?\{+\s*([^{}]*)|\$(\w+)")
_SEMICOLONS = ("java", "csharp", "rust", "c")


@dataclass
class Spec:
    """The tables of one family, compiled."""

    sources: re.Pattern
    params: re.Pattern | None
    sinks: list[tuple[int, re.Pattern, re.Pattern, int, bool]]
    sanitizers: list[tuple[int, re.Pattern]]
    guards: list[tuple[int, re.Pattern]]
    mutators: re.Pattern
    kinds: int


_SPECS: dict[str, Spec] = {}


def spec(family: str) -> Spec:
    if family not in _SPECS:
        bit = {k: 1 << n for n, k in enumerate(KINDS)}
        kinds = sum(b for k, b in bit.items() if (family, k) not in flowrules.LACKING)
        sinks = [(n, re.compile(c), re.compile(r), a, w) for k, c, r, a, w in flowrules.CALLS[family] for n in [KINDS.index(k)] if kinds >> n & 1]
        clean = [(bit.get(k, EVERY), re.compile(p)) for k, p in flowrules.SANITIZERS.items()]
        params = flowrules.PARAM_SOURCES.get(family)
        _SPECS[family] = Spec(re.compile(flowrules.SOURCES[family]), re.compile(params) if params else None, sinks, clean, [(bit[k], re.compile(p)) for k, p in flowrules.GUARDS.items()], re.compile(flowrules.MUTATORS[family]), kinds)
    return _SPECS[family]


@dataclass
class Value:
    """What a value uses: names with their place, bits and calls on the way; bits of inputs in it; calls whose result may be one."""

    uses: list[dict] = field(default_factory=list)
    source: int = 0
    calls: list[dict] = field(default_factory=list)


class File:
    """The sites and functions of one file."""

    def __init__(self, text: str, language: str):
        self.text, self.language, self.family = text, language, flowrules.FAMILY[language]
        self.spec = spec(self.family)
        self.at = source.Text(text)
        toks = source.tokens(text, language)
        self.code = [t for t in toks if t.kind != "comment"]
        self.pairs = source._brackets(self.code)
        unit = source.Unit()
        if language == "python":
            source._python(self.at, unit, source.STRIP)
        else:
            source._braces(self.at, self.code, language, unit, self.pairs, source.STRIP)
        self.types = unit.types
        self.functions = sorted(unit.functions, key=lambda f: (f["span"][0], -f["span"][1]))
        self.sites: list[dict] = []
        self.called: dict[str, int] = {}
        self.deep: set[int] = set()
        self._scopes()
        self._statements()
        self._fields()

    def _no(self, name: str) -> int:
        """The number of a name that is called in the file."""
        return self.called.setdefault(name, len(self.called))

    # ---- scopes

    def _scopes(self) -> None:
        """scope[k]: the innermost function (from 1; 0 is the file) that token k is in; parent and next token of each function."""
        n, open_ = len(self.code), [0]
        self.scope, self.parent, self.after = [0] * n, [0] * (len(self.functions) + 1), [n] * (len(self.functions) + 1)
        starts = [t.start for t in self.code]
        nxt = 0
        for k, t in enumerate(self.code):
            while len(open_) > 1 and self.functions[open_[-1] - 1]["span"][1] <= t.start:
                open_.pop()
            while nxt < len(self.functions) and self.functions[nxt]["span"][0] <= t.start:
                nxt += 1
                self.parent[nxt] = open_[-1]
                self.after[nxt] = bisect_left(starts, self.functions[nxt - 1]["span"][1])
                open_.append(nxt)
            self.scope[k] = open_[-1]

    def _inner(self, k: int, scope: int) -> int | None:
        """The token after the function that token k is in, if it is one inside scope."""
        s = self.scope[k]
        return None if s == scope else self.after[s]

    # ---- values

    def value(self, lo: int, hi: int, scope: int, path: tuple[str, ...] = (), mask: int = EVERY) -> Value:
        """What the tokens from lo to hi use."""
        out, work = Value(), [(lo, hi, path, mask)]
        while work:
            k, end, path, mask = work.pop()
            while k < end:
                t = self.code[k]
                if (to := self._inner(k, scope)) is not None:
                    k = max(to, k + 1)
                elif t.kind == "string" and not (k + 1 < end and self.code[k + 1].text == "."):
                    self._interpolated(t, path, mask, out)
                    k += 1
                elif t.kind in ("name", "string") and (t.kind == "string" or t.text not in _WORDS or k + 1 < end and self.code[k + 1].text in (".", "::")):
                    k = self._chain(k, end, path, mask, out, work)
                elif t.text == "{" and k and self.language != "python" and self.code[k - 1].text in ("=>", ")"):
                    k = self.pairs.get(k, k) + 1  # statements, which have sites of their own
                else:
                    k += 1
        return out

    def _input(self, t: Token, path: tuple[str, ...], mask: int, out: Value) -> None:
        """An input in the value; one that is an argument of a call counts as something that comes out of a call."""
        if path:
            out.calls.append({"called": -1, "line": t.line, "mask": mask, "path": list(path)})
        else:
            out.source |= mask

    def _interpolated(self, t: Token, path: tuple[str, ...], mask: int, out: Value) -> None:
        """Names and inputs in text that is put together from values."""
        s, lang = t.text, self.language
        if lang == "python" and not re.match(r"[rR]?[fF]", s) or lang in source._SCRIPTS and s[0] != "`" or lang == "csharp" and s[0] not in "$@" or lang in ("java", "go"):
            return
        for m in _INTERPOLATED.finditer(s):
            inner = m[1] or m[2] or ""
            if lang != "rust" and self.spec.sources.search(inner):
                self._input(t, path, mask, out)
            for n in re.findall(r"(?<![\w.\"'])[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*", re.sub(r"\"[^\"]*\"|'[^']*'", "", inner)):
                parts = n.split(".")
                out.uses += [{"name": ".".join(parts[: k + 1]), "pos": t.start, "mask": mask, "path": list(path)} for k in range(len(parts))]

    def _chain(self, k: int, end: int, path: tuple[str, ...], mask: int, out: Value, work: list) -> int:
        """A name with its members, calls and places; returns the token after it."""
        code, head = self.code, self.code[k]
        if head.kind == "string":
            self._interpolated(head, path, mask, out)
        text = '""' if head.kind == "string" else head.text
        names, plain, found, last = [text] if head.kind == "name" else [], head.kind == "name", False, head.text
        inner: list[tuple[int, int, tuple[str, ...]]] = []
        receiver, k = "", k + 1
        while k < end:
            t, after = code[k], code[k + 1].text if k + 1 < end else ""
            if t.text in (".", "::") and k + 1 < end and (code[k + 1].kind == "name" or after == "<"):
                if after == "<":  # type arguments before a call
                    to = k + 1
                    while to < end and code[to].text != "(":
                        to += 1
                    text, k = text + "".join(x.text for x in code[k:to]), to
                    continue
                receiver, last = text, after
                text += t.text + after
                names += [text] if plain else []
                k += 2
            elif t.text in ("?", "!") and after in (".", "!", "(") and (t.text == "?" and after == "." or t.text == "!" and (after != "(" or t.start == code[k - 1].end)):
                if after == "(":
                    last, text = last + "!", text + "!"
                k += 1
            elif t.text == "(" and code[k - 1].kind == "name" or t.text == "(" and text.endswith((">", "!")):
                close, found_here = min(self.pairs.get(k, end), end), self.spec.sources.search(text + "(")
                found |= bool(found_here)
                names = names[:-1] if plain and names else names
                for bits, p in self.spec.sanitizers:
                    if p.search(".".join(re.split(r"\.(?![^(]*\))", text)[-2:]) + "("):
                        mask &= ~bits
                plain, call = False, len(path) < DEEP
                if not call:
                    self.deep.add(k)
                    out.uses.append({"name": f"({code[k].start})", "pos": head.start, "mask": mask, "path": list(path)})
                for n, (a, b, key) in enumerate(self._arguments(k, close)):
                    if call:
                        inner.append((a, b, (*path, f"{self._no(last)}\t{n}\t{key}\t{int(bool(receiver) and text != last)}")))
                out.calls.append({"called": self._no(last), "line": code[k].line, "mask": mask, "path": list(path)})
                text, k = text + "()", close + 1
                receiver = text
            elif t.text == "[":
                close = min(self.pairs.get(k, end), end)
                inner.append((k + 1, close, path))
                text, k, plain = text + "[]", close + 1, False
                found |= bool(self.spec.sources.search(text))
            else:
                break
            found |= bool(self.spec.sources.search(text))
        if found or self.spec.sources.search(text):
            self._input(head, path, mask, out)
        else:
            out.uses += [{"name": n, "pos": head.start, "mask": mask, "path": list(path)} for n in names]
        work += [(a, b, p, mask) for a, b, p in inner]
        return k

    def _arguments(self, open_: int, close: int) -> list[tuple[int, int, str]]:
        """From, to and keyword of the arguments between two brackets."""
        out, k, at = [], open_ + 1, open_ + 1
        while k <= close and k <= len(self.code):
            if k == close or self.code[k].text == ",":
                if k > at:
                    named = k > at + 2 and self.code[at].kind == "name" and self.code[at + 1].text in ("=", ":") and self.language in ("python", "kotlin", "csharp")
                    out.append((at + 2, k, self.code[at].text) if named else (at, k, ""))
                at, k = k + 1, k + 1
            else:
                k = (self.pairs.get(k, k) if self.code[k].text in ("(", "[", "{") else k) + 1
        return out

    def _fields(self) -> None:
        """Scopes of names. A field that one method of a type sets is known, in no order, to the methods that do not set it."""
        owners = {o: -1 - n for n, o in enumerate(sorted({f["owner"] for f in self.functions if f["owner"]}))}
        home = [0, *(owners.get(f["owner"], 0) for f in self.functions)]
        own = {(s["scope"], s["target"]) for s in self.sites if s["target"]}
        field = re.compile(r"(self|this)\.")
        for s in list(self.sites):
            for u in list(s["uses"]):
                u["scope"] = s["scope"]
                if home[s["scope"]] and field.match(u["name"]) and (s["scope"], u["name"]) not in own:
                    s["uses"].append({**u, "scope": home[s["scope"]], "pos": LAST})
            s["home"] = s["scope"]
            if s["kind"] == "def" and home[s["scope"]] and field.match(s["target"]):
                self.sites.append({**s, "site": len(self.sites), "home": home[s["scope"]], "at": 0, "strong": False})

    def numbered(self) -> None:
        """Versions of the definitions; epochs, the versions that are there, of the uses of names that the file binds."""
        strong: dict[tuple[int, str], list[int]] = {(s, p): [] for s, f in enumerate(self.functions, 1) for p in f["params"]}
        for s in sorted((s for s in self.sites if s["kind"] == "def"), key=lambda s: (s["at"], s["site"])):
            places = strong.setdefault((s["home"], s["target"]), [])
            places += [s["at"]] if s["strong"] else []
            s["version"] = len(places)
        for s in self.sites:
            s["uses"] = [{**u, "epoch": bisect_right(strong[u["scope"], u["name"]], u["pos"])} for u in s["uses"] if (u["scope"], u["name"]) in strong]

    # ---- statements

    def _end(self, k: int, commas: bool) -> int:
        """The token after the value that begins at k."""
        code = self.code
        first = k
        while k < len(code):
            t = code[k]
            if t.text in (";", ")", "]", "}") or t.text == "," and not commas:
                break
            if k > first and t.line > code[k - 1].line and self.language not in _SEMICOLONS:
                before = code[k - 1]
                if not (t.text in (".", "?", "+", "||", "&&", "|") or before.kind == "op" and before.text not in (")", "]", "}", "?", "!")):
                    break
            k = (max(self.pairs.get(k, k), k) if t.text in ("(", "[", "{") else k) + 1
        return min(k, len(code))

    def _targets(self, lo: int, hi: int) -> list[tuple[str, bool]]:
        """(name, whether it is bound as a whole) of the targets between two tokens."""
        code, depth, cut = self.code, 0, hi
        for k in range(lo, hi):
            if code[k].text == ":" and depth == 0 and k > lo and self.language in ("python", "typescript", "tsx", "kotlin", "rust"):
                cut = k
                break
            depth += (code[k].text in ("(", "[", "{")) - (code[k].text in (")", "]", "}"))
        out = []
        for part in source._split([t for t in code[lo:cut] if t.text not in _WORDS and t.text not in ("*", "&")]):
            if part[0].text in ("(", "[", "{"):
                out += [(t.text, True) for t in part if t.kind == "name"]
                continue
            k = len(part) - 1
            weak = part[k].text == "]"
            if weak:  # a place in something: back to what it is in
                depth = 0
                while k >= 0:
                    depth += (part[k].text == "]") - (part[k].text == "[")
                    k -= 1
                    if depth == 0 and (k < 0 or part[k].text != "]"):
                        break
            name = []
            while k >= 0 and part[k].kind == "name":
                name.append(part[k].text)
                if k < 2 or part[k - 1].text not in (".", "::"):
                    break
                k -= 2
            if name:
                out.append((".".join(reversed(name)), not weak))
        return out

    def _site(self, kind: str, k: int, scope: int, v: Value, at: int, **own: object) -> None:
        uses = [u for u in v.uses if u["mask"] & self.spec.kinds]
        empty = {"target": None, "strong": False, "called": -1, "slot": -1, "keyword": None, "on": False, "sinks": []}
        self.sites.append({"site": len(self.sites), "kind": kind, "scope": scope, "at": at, "line": self.code[k].line, "source": v.source & self.spec.kinds, "uses": uses, "calls": [c for c in v.calls if c["mask"] & self.spec.kinds], **empty, **own})

    def _bind(self, k: int, scope: int, targets: list[tuple[str, bool]], ranges: list[tuple[int, int]], update: bool) -> None:
        branch = self._under_branch(k, scope)
        values = [self.value(a, b, scope) for a, b in ranges]
        for n, (name, whole) in enumerate(targets):
            v = values[n] if len(values) == len(targets) else Value([u for x in values for u in x.uses], 0, [c for x in values for c in x.calls])
            if len(values) != len(targets):
                for x in values:
                    v.source |= x.source
            last = ranges[-1][1] - 1
            self._site("def", k, scope, v, self.code[max(last, k)].end, target=name, strong=whole and not update and not branch)

    def _under_branch(self, k: int, scope: int) -> bool:
        return self.innermost[k] > (self.functions[scope - 1]["span"][0] if scope else -1)

    def _sweeps(self) -> None:
        """innermost[k]: where the last branch around token k began, or -1; tested[k]: whether it stands in a condition; around[k]: its bracket."""
        code, n = self.code, len(self.code)
        self.innermost, self.tested, self.around = [-1] * n, [False] * n, [""] * n
        branches = sorted(source._branches(self.at, code, self.language, self.pairs))
        open_: list[tuple[int, int]] = []
        nxt, brackets, until = 0, [], -1
        for k, t in enumerate(code):
            while nxt < len(branches) and branches[nxt][0] <= t.start:
                open_.append(branches[nxt])
                nxt += 1
            while open_ and open_[-1][1] <= t.start:
                open_.pop()
            self.innermost[k] = open_[-1][0] if open_ else -1
            if t.text in (")", "]", "}") and brackets:
                brackets.pop()
            self.around[k] = brackets[-1] if brackets else ""
            if t.kind == "op" and t.text in ("(", "[", "{"):
                brackets.append(t.text + (" loop" if k and code[k - 1].text in ("for", "foreach", "if", "while", "using", "with", "catch", "switch") else ""))
            if t.kind == "name" and t.text in ("if", "elif", "while", "unless", "when", "assert"):
                j = k + 1
                if j < n and code[j].text == "(" and self.language != "python":
                    j = self.pairs.get(j, j)
                else:
                    while j < n and code[j].text not in ("{", ":", ";") and (code[j].line == t.line or self.around[k] != ""):
                        j = (max(self.pairs.get(j, j), j) if code[j].text in ("(", "[") else j) + 1
                until = max(until, j)
            self.tested[k] = k < until

    def _statements(self) -> None:
        code, n = self.code, len(self.code)
        self._sweeps()
        self.heads = heads = {(f["start_line"], f["name"]) for f in self.functions}
        start = 0  # of the statement
        for k, t in enumerate(code):
            scope = self.scope[k]
            if k and (t.line > code[k - 1].line and self.around[k] in ("", "{") or code[k - 1].text in (";", "{", "}") and code[k - 1].kind == "op" or code[k - 1].text == "(" and self.around[k].endswith("loop")):
                start = k
            if t.kind == "op" and t.text in ("=", ":=", "+=") and k and (k + 1 >= n or code[k + 1].text != "=") and (self.around[k] != "(" and self.around[k] != "[") and code[k - 1].text not in ("=", "!", "<", ">"):
                opened = self.pairs.get(k - 1, k) if code[k - 1].text in ("}", "]") else start
                targets = self._targets(opened if code[k - 1].text == "}" or opened and self.language in source._SCRIPTS and code[opened - 1].text in ("const", "let", "var") else start, k)
                if targets:
                    several = len(targets) > 1 and self.language in ("python", "go")
                    end = self._end(k + 1, several)
                    ranges = [(k + 1, end)]
                    if several and len(split := self._arguments(k, end)) == len(targets):
                        ranges = [(a, b) for a, b, _ in split]
                    self._bind(k, scope, targets, ranges, t.text == "+=")
            elif t.kind == "name" and t.text in ("for", "foreach") and k + 1 < n:
                self._loop(k, scope)
            elif t.kind == "name" and t.text == "return":
                end = self._end(k + 1, self.language in ("python", "go")) if k + 1 < n and (code[k + 1].line == t.line or self.language in _SEMICOLONS) else k + 1
                self._site("ret", k, scope, self.value(k + 1, end, scope), t.end)
            elif t.text == "(" and t.kind == "op" and k:
                self._call(k, scope, heads)
        for s, f in enumerate(self.functions, 1):
            self._tail(s, f)

    def _loop(self, k: int, scope: int) -> None:
        """for x in xs, in its forms: the names before the word or sign are bound to what follows."""
        code, n = self.code, len(self.code)
        bracket = code[k + 1].text == "("
        j = lo = k + 2 if bracket else k + 1
        stop = self.pairs.get(k + 1, n) if bracket else n
        while j < stop and code[j].text not in ("in", "of", ":", "{", ";", "=", ":="):
            j += 1
        if j >= stop or code[j].text in ("{", ";", "=", ":="):
            return
        end = stop if bracket else j + 1
        while not bracket and end < n and code[end].text not in ("{", ":"):
            end = (max(self.pairs.get(end, end), end) if code[end].text in ("(", "[") else end) + 1
        if targets := self._targets(lo, j):
            v = self.value(j + 1, end, scope)
            for name, _ in targets:
                self._site("def", k, scope, v, code[end - 1].end, target=name)

    def _call(self, k: int, scope: int, heads: set) -> None:
        """The sites of a call: its arguments, what it is called on if they go there, and the name that it guards."""
        code, name_at = self.code, k - 1
        macro = code[name_at].text == "!" and name_at and code[name_at - 1].kind == "name" and code[name_at].start == code[name_at - 1].end
        name_at -= macro
        if code[name_at].text == ">" and name_at:  # type arguments
            depth = 0
            while name_at > 0:
                depth += (code[name_at].text == ">") - (code[name_at].text == "<")
                name_at -= 1
                if depth == 0:
                    break
            name_at -= code[name_at].text == "::"
        t = code[name_at]
        before = code[name_at - 1].text if name_at else ""
        if t.kind != "name" or t.text in source._WORDS_BEFORE_PAREN and before not in (".", "::") or (t.line, t.text) in heads or before in ("def", "class", "fn", "func", "function", "fun"):
            return
        j = name_at - 1
        while j >= 1 and code[j].text in (".", "::", "?", "!"):
            j -= 1
            if code[j].text in (")", "]"):
                j = self.pairs.get(j, 1) - 1
            if j >= 0 and (code[j].kind in ("name", "string") and (code[j].text not in _WORDS or j and code[j - 1].text in (".", "::")) or code[j].text in ("]", ">")):
                j -= 1
        receiver = self.text[code[j + 1].start : t.start].rstrip(".:? !") if j + 1 < name_at else ""
        callee, close = t.text + ("!" if macro else ""), min(self.pairs.get(k, len(code) - 1), len(code) - 1)
        sinks = [s for s in self.spec.sinks if s[1].search(callee) and s[2].search(receiver)]
        args = self._arguments(k, close)
        values = [self.value(a, b, scope) for a, b, _ in args]
        for n, ((a, _, key), v) in enumerate(zip(args, values)):
            own = [{"kind": s[0], "write": s[4]} for s in sinks if s[3] in (-1, n)]
            if v.uses or v.source or v.calls:
                self._site("arg", k, scope, v, code[a].start, called=self._no(callee), slot=n, keyword=key or None, on=bool(receiver), sinks=own)
        if k in self.deep:
            for n, (a, b, key) in enumerate(args):
                self._site("def", k, scope, self.value(a, b, scope, (f"{self._no(callee)}\t{n}\t{key}\t{int(bool(receiver))}",)), 0, target=f"({code[k].start})")
        plain = re.fullmatch(r"[A-Za-z_]\w*(?:(?:\.|::)[A-Za-z_]\w*)*", receiver)
        if plain and self.spec.mutators.search(callee):
            for v in values:
                self._site("def", k, scope, v, code[close].end, target=receiver.replace("::", "."))
        for bits, p in self.spec.guards:
            if self.tested[k] and p.search(callee):
                subjects = {receiver} if plain else set()
                subjects |= {u["name"] for v in values for u in v.uses}
                for name in sorted(subjects):  # safe from here on for these kinds, as it was for the others
                    use = {"name": name, "pos": t.start, "mask": EVERY & ~bits, "path": []}
                    self._site("def", k, scope, Value([use]), code[close].end, target=name, strong=True)

    def _tail(self, scope: int, f: dict) -> None:
        """The value that a function has without the word: after = or =>, or the last expression of a block of Rust."""
        code = self.code
        k = bisect_left([t.start for t in code], f["inside"]) if self.language in ("rust", "kotlin", "javascript", "typescript", "tsx") else len(code)
        if k >= len(code):
            return
        if self.language == "rust" and code[k].text == "{":
            close, at = self.pairs.get(k, k), k + 1
            j = at
            while j < close:
                if code[j].text == ";":
                    at = j + 1
                j = (max(self.pairs.get(j, j), j) if code[j].text in ("(", "[", "{") else j) + 1
            if at < close and code[at].text not in ("return", "let", "fn", "mod", "use"):
                self._site("ret", at, scope, self.value(at, close, scope), code[close].start)
        elif self.language == "kotlin" and code[k].text == "=" or self.language in source._SCRIPTS and code[k].text != "{":
            at = k + (self.language == "kotlin")
            if at < len(code):
                self._site("ret", at, scope, self.value(at, min(self._end(at, False), self.after[scope]), scope), code[at].start)


def found(text: str, language: str) -> dict:
    """functions, sites and the names called of a file."""
    f = File(text, language)
    f.numbered()
    functions = []
    for s, x in enumerate(f.functions, 1):
        bound = [bool(f.spec.params and re.search(f.spec.params.pattern + r"[^,)]*\b" + re.escape(p) + r"\b", x["signature"])) for p in x["params"]]
        functions.append({"scope": s, "parent": f.parent[s], "name": x["name"], "owner": x["owner"], "params": x["params"], "inputs": bound, "line": x["start_line"], "pre": x["span"][0], "post": x["span"][1]})
    return {"functions": functions, "sites": f.sites, "called": list(f.called)}


SCHEMA = (
    "rel_path string, family string, called array<string>, functions array<struct<scope:int,parent:int,name:string,owner:string,params:array<string>,inputs:array<boolean>,line:int,pre:int,post:int>>, "
    "sites array<struct<site:int,kind:string,scope:int,home:int,at:int,line:int,source:int,uses:array<struct<name:string,scope:int,epoch:int,pos:int,mask:int,path:array<string>>>,calls:array<struct<called:int,line:int,mask:int,path:array<string>>>,target:string,version:int,called:int,slot:int,keyword:string,on:boolean,sinks:array<struct<kind:int,write:boolean>>>>"
)
_S, _I, _B = pa.string(), pa.int32(), pa.bool_()
_LIST = source._list
_FUNCTIONS = _LIST(scope=_I, parent=_I, name=_S, owner=_S, params=pa.list_(_S), inputs=pa.list_(_B), line=_I, pre=_I, post=_I)
_SITES = _LIST(
    site=_I, kind=_S, scope=_I, home=_I, at=_I, line=_I, source=_I, uses=_LIST(name=_S, scope=_I, epoch=_I, pos=_I, mask=_I, path=pa.list_(_S)), calls=_LIST(called=_I, line=_I, mask=_I, path=pa.list_(_S)), target=_S, version=_I, called=_I, slot=_I, keyword=_S, on=_B, sinks=_LIST(kind=_I, write=_B)
)


def sites(files: DataFrame) -> DataFrame:
    """rel_path, family, called, functions and sites of files (rel_path, language, content) of the languages that have flow rules."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 16):
                part = batch.slice(at, 16)
                langs = part.column("language").to_pylist()
                got = [found(t or "", lang) for t, lang in zip(part.column("content").to_pylist(), langs)]
                yield pa.RecordBatch.from_pydict({"rel_path": part.column("rel_path"), "family": pa.array([flowrules.FAMILY[x] for x in langs], _S), "called": pa.array([g["called"] for g in got], pa.list_(_S)), "functions": pa.array([g["functions"] for g in got], _FUNCTIONS), "sites": pa.array([g["sites"] for g in got], _SITES)})

    return spread(files.select("rel_path", "language", "content")).mapInArrow(run, SCHEMA)
