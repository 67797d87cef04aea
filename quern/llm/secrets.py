"""Secrets: fixed patterns, and a linear-chain conditional random field that adds what they miss.

Patterns give the base spans (assign, access, hex). What could be a secret or tells of one opens a window of REACH
characters to either side: a token of 16 characters or more, a key block's dashes, a cue word, and any token of mixed
characters, however short, after a colon or an equals sign. Windows that touch are one chain. Each token of a chain is
tagged begin, inside or outside from its shape, the words around it and features of the whole text; Viterbi
decodes the tags. Tokens outside windows are not tagged. The weights maximise the conditional likelihood of generated files with known secrets (forward and backward sums, numpy).

Defined cases: null text counts as empty; an empty text has no spans; whole texts are searched however long they are;
an empty table gives no rows. Positions are code points, ends exclusive. An assign span is the whole match.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import map_rows

KINDS, FIELD = ("assign", "access", "hex"), "secret"
REACH, SEED = 48, 3
_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_KEYS = ("passw", "secret", "token", "api_key", "apikey")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
_TOKEN = re.compile(r"[A-Za-z0-9+/_.~-]+(?:={1,2}(?![A-Za-z0-9=]))?|[^\sA-Za-z0-9+/_.~-]")
#: A run that may be a secret: 16 characters or more, or a key block's dashes.
_MAYBE = re.compile(r"(?<![A-Za-z0-9+/_.~-])[A-Za-z0-9+/_.~-]{16,}|-----BEGIN[A-Z ]*-----")
_CUE = frozenset("password passwd pwd secret token key apikey bearer authorization auth credential credentials private access signature passphrase passcode".split())
_CUES = re.compile(rf"(?<![a-z])(?:{'|'.join(sorted(_CUE))})(?![a-z])")
#: A value of mixed characters after : or =, of any length: letters and digits, both cases in one word, or parts joined by signs.
_VALUE = re.compile(r"""(?<=[:=])[\x20\t]*["'`]?(?=[A-Za-z0-9+/_.~-])(?![A-Z]?[a-z]+(?![A-Za-z0-9+/_~-]|\.[A-Za-z0-9])|[A-Z]+(?![A-Za-z0-9+/_~-]|\.[A-Za-z0-9])|[0-9]+(?![A-Za-z0-9+/_~-]|\.[A-Za-z0-9]))[A-Za-z0-9+/_.~-]+""")
_REST = re.compile(r"[A-Za-z0-9+/_.~-]*(?:={1,2}(?![A-Za-z0-9=]))?")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the pattern matches, by start, then kind in the order of KINDS."""
    out = []
    low = text.lower()
    if any(k in low for k in _KEYS):
        out += [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(m.start(), m.end(), 2) for m in _HEX.finditer(text)]
    return [(a, b, KINDS[k]) for a, b, k in sorted(out, key=lambda x: (x[0], x[2], x[1]))]


def _entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in (s.count(x) for x in set(s)))


def file_features(text: str) -> list[str]:
    """Features of the whole text: how much of it looks like settings or code."""
    n = max(1, len(text))
    marks = text.count("=") + text.count(":") + text.count("{")
    return ["file-settings" if marks > n / 60 else "file-prose", "file-short" if n < 400 else "file-long"]


def _shape(token: str) -> list[str]:
    t = token
    lower, upper, digit = sum(c.islower() for c in t), sum(c.isupper() for c in t), sum(c.isdigit() for c in t)
    n = len(t)
    classes = (lower > 0) + (upper > 0) + (digit > 0)
    turns = sum(a.isdigit() != b.isdigit() for a, b in zip(t, t[1:]))
    out = [f"len{min(12, n // 4)}", f"classes{classes}", f"entropy{int(_entropy(t) * 2) if n > 3 else 0}", f"turns{min(8, turns // 2)}", f"digits{int(5 * digit / n)}"]
    out.append("word" if t.isalpha() and (t.islower() or t[:1].isupper() and t[1:].islower()) else "no-word")
    out.append("dots" if t.count(".") > 1 else "slashes" if t.count("/") > 1 else "dashes" if t.count("-") > 1 else "plain")
    if re.fullmatch(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}", t):
        out.append("uuid")
    if re.match(r"(?:gh[pousr]_|xox[bapr]-|sk[-_]|pk_|eyJ|AIza|glpat-|npm_|hf_|SG\.)", t):
        out.append("issued")
    if t.startswith("-----") or t.endswith("-----"):
        out.append("block-mark")
    if n >= 40 and re.fullmatch(r"[A-Za-z0-9+/]+=*", t):
        out.append("base64")
    if re.search(r"\.(?:com|org|net|html?|php|png|jpe?g|py|js|css|txt|pdf|gz)\b", t):
        out.append("file-or-host")
    return out


def _features(tokens: list[str], k: int, whole: list[str]) -> list[str]:
    out = ["one", *_shape(tokens[k]), *whole]
    for d in (-2, -1, 1):
        t = tokens[k + d] if 0 <= k + d < len(tokens) else ""
        parts = re.split(r"[^a-z]+", t.lower()) if t else []
        out.append(f"{d}:" + ("cue" if any(p in _CUE for p in parts) else "none" if not t else t if len(t) == 1 and not t.isalnum() else "long" if len(t) >= 16 else "other"))
    near = [p for t in tokens[max(0, k - 4) : k] for p in re.split(r"[^a-z]+", t.lower())]
    cue = "cue-before" if any(p in _CUE for p in near) else "no-cue-before"
    t = tokens[k]
    mixed = f"{'0' * any(map(str.isdigit, t))}{'a' * any(map(str.isalpha, t))}{'-' * min(3, t.count('-'))}"
    out += [cue, f"{cue} {mixed}", f"{out[-3]} {out[-2]} {mixed}"]
    return out


TAGS = 3  # outside, begin, inside
#: inside comes after begin or inside only
_ALLOWED = np.array([[0.0, 0.0, -1e9], [0.0, 0.0, 0.0], [0.0, 0.0, 0.0]])


def chains(text: str) -> list[list[tuple[int, int]]]:
    """The windows of tokens that the field tags: (start, end) of each token."""
    low = text.lower()
    spots = [m.span() for m in _MAYBE.finditer(text)]
    if len(low) == len(text):
        spots += [m.span() for m in _CUES.finditer(low)]
    else:
        spots += [m.span() for m in re.finditer(_CUES.pattern, text, re.I | re.A)]
    spots = sorted(spots + [m.span() for m in _VALUE.finditer(text)])
    if not spots:
        return []
    reach = REACH
    spans: list[list[int]] = []
    for a, b in spots:
        lo, hi = max(0, a - reach), min(len(text), b + reach)
        if spans and lo <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], hi)
        else:
            spans.append([lo, hi])
    whole: list[list[int]] = []
    for lo, hi in spans:
        least = whole[-1][1] if whole else 0
        while lo > least and text[lo - 1] > " ":  # no token is cut at the window's start
            lo -= 1
        if _REST.match(text, hi - 1).end() > hi - 1:  # nor at its end
            hi = _REST.match(text, hi).end()
        if whole and lo <= least:
            whole[-1][1] = max(least, hi)
        else:
            whole.append([lo, hi])
    out = []
    for lo, hi in whole:
        toks = [(m.start(), m.end()) for m in _TOKEN.finditer(text, lo, hi)]
        if toks:
            out.append(toks)
    return out


class Field:
    """Weights of (feature, tag) and of tag pairs."""

    def __init__(self, names: dict[str, int], w: np.ndarray, pair: np.ndarray):
        self.names, self.w, self.pair = names, w, pair

    def emissions(self, rows: list[list[str]]) -> np.ndarray:
        out = np.zeros((len(rows), TAGS))
        for k, f in enumerate(rows):
            ids = [self.names[x] for x in f if x in self.names]
            out[k] = self.w[ids].sum(axis=0)
        out[0, 2] = -1e9
        return out

    def tags(self, rows: list[list[str]]) -> list[int]:
        """The best tag sequence (Viterbi)."""
        e, trans = self.emissions(rows), self.pair + _ALLOWED
        score, back = e[0], []
        for k in range(1, len(rows)):
            each = score[:, None] + trans
            back.append(each.argmax(axis=0))
            score = each.max(axis=0) + e[k]
        out = [int(score.argmax())]
        for b in reversed(back):
            out.append(int(b[out[-1]]))
        return out[::-1]


def generated(count: int, seed: int = SEED) -> list[tuple[str, list[tuple[int, int]]]]:
    """Small files with the spans of their secrets, from templates; about half hold none."""
    r = random.Random(seed)
    pick = lambda chars, n: "".join(r.choice(chars) for _ in range(n))
    low, up, dig = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    word = lambda: pick(low, r.randint(3, 9))
    alnum, cues = low + up + dig, sorted(_CUE)

    def secret() -> str:
        return r.choice((
            lambda: r.choice(("ghp_", "gho_", "ghs_")) + pick(alnum, 36), lambda: "xoxb-" + pick(dig, 12) + "-" + pick(alnum, 24), lambda: r.choice(("sk-", "sk_live_", "pk_test_")) + pick(alnum, r.randint(24, 48)),
            lambda: "eyJ" + pick(alnum, 20) + ".eyJ" + pick(alnum, 40) + "." + pick(alnum + "-_", 43), lambda: "AIza" + pick(alnum + "-_", 35), lambda: pick(alnum + "+/", 40), lambda: "glpat-" + pick(alnum, 20),
            lambda: pick(alnum, 32), lambda: pick(alnum + "+/", 62) + "==", lambda: "SG." + pick(alnum, 22) + "." + pick(alnum, 43),
        ))()

    def short() -> str:
        """What stands as a secret only after a cue."""
        return r.choice((
            lambda: word() + pick(dig, r.randint(1, 4)) + pick(low, r.randint(0, 4)) + pick(dig, r.randint(0, 1)), lambda: pick(low + dig, r.randint(6, 15)), lambda: pick(alnum, r.randint(6, 23)), *[lambda: "-".join(word() for _ in range(r.randint(3, 5)))] * 2,
            lambda: word().title() + pick("_-+.", 1) + pick(dig, r.randint(2, 4)), lambda: pick(low, 3) + pick(dig, 3) + pick(low, 3) + pick(dig, 3), lambda: pick(low + up, r.randint(10, 30)), lambda: word().title() + word().title() + pick(dig, r.randint(1, 4)),
        ))()

    def benign() -> str:
        return r.choice((
            lambda: "-".join(pick("0123456789abcdef", n) for n in (8, 4, 4, 4, 12)), lambda: f"https/{word()}.com/{word()}/{pick(dig, 6)}.html", lambda: f"{word()}_{word()}_{word()}_{pick(dig, 2)}", lambda: f"/usr/{word()}/{word()}/{word()}-{pick(dig, 2)}.{pick(dig, 1)}.py",
            lambda: f"20{pick(dig, 2)}-{pick(dig, 2)}-{pick(dig, 2)}T{pick(dig, 2)}", lambda: pick(dig, r.randint(16, 20)), lambda: f"v{pick(dig, 1)}.{pick(dig, 2)}.{pick(dig, 1)}-{word()}.{pick(dig, 3)}", lambda: word().title() + word().title() + word().title() + pick(dig, 2),
            word, lambda: f"{pick(dig, 1)}.{pick(dig, 2)}", lambda: pick(dig, r.randint(1, 5)), lambda: f"{word()}_{word()}", lambda: f"{word()}{pick(dig, 1)}",
            lambda: f"{word()}.{word()}.{word()}@{word()}{pick(dig, 2)}", lambda: f"{pick(up, 3)}-{pick(dig, 4)}-{pick(dig, 4)}-{pick(dig, 4)}", lambda: f"{word()}-{word()}-{word()}-{pick(dig, 3)}", lambda: f"{word()}{pick(dig, 4)}{word()}{word()}",
        ))()

    out = []
    for k in range(count):
        parts, spans, at = [], [], 0
        rows = r.randint(1, 4)
        hot = r.randrange(rows) if k % 2 else -1
        for row in range(rows):
            brief = row == hot and r.random() < 0.5
            value = short() if brief else secret() if row == hot else benign()
            if row == hot and not brief and r.random() < 0.15:
                lines = "\n".join(pick(alnum + "+/", 64) for _ in range(r.randint(2, 4)))
                kind = r.choice(("", "", "RSA ", "EC "))
                value = f"-----BEGIN {kind}PRIVATE KEY-----\n{lines}\n-----END {kind}PRIVATE KEY-----"
            key = r.choice((*cues, "aws_secret_access_key")) if brief or (row == hot and r.random() < 0.75) or r.random() < 0.05 else word()
            q = r.choice(("", '"', "'"))
            head = r.choice((f"{key}: {q}", f"{key}={q}", f"{word()} {key} = {q}", f"{key} = {q}" if brief else f"{word()} {word()} {key} {q}", f"curl -H {q}{key}: Bearer ", *([f"{r.choice(('Authorization', 'auth'))}: {r.choice(('Bearer', 'Token'))} "] * (2 * brief))))
            if value.startswith("-----") and r.random() < 0.5:
                head = q = ""
            line = f"{head}{value}{q if q and head.endswith(q) else ''}{r.choice(('', ';', ',', ' ' + word()))}\n"
            if row == hot:
                spans.append((at + len(head), at + len(head) + len(value)))
            parts.append(line)
            at += len(line)
            if r.random() < 0.4:
                filler = " ".join(r.choice(cues) if r.random() < 0.1 else word() for _ in range(r.randint(4, 60))) + ".\n"
                parts.append(filler)
                at += len(filler)
        out.append(("".join(parts), spans))
    return out


@lru_cache(maxsize=2)
def trained(count: int = 500, epochs: int = 8, seed: int = SEED) -> Field:
    """The field fitted to generated files by AdaGrad steps on their conditional likelihood."""
    names: dict[str, int] = {}
    work = []
    for text, spans in generated(count, seed):
        whole = file_features(text)
        for toks in chains(text):
            words = [text[a:b] for a, b in toks]
            rows = [np.array([names.setdefault(x, len(names)) for x in _features(words, k, whole)]) for k in range(len(words))]
            inside = [any(a >= x and b <= y for x, y in spans) for a, b in toks]
            tags = [0 if not i else 1 if not k or not inside[k - 1] else 2 for k, i in enumerate(inside)]
            work.append((rows, tags))
    w, pair = np.zeros((len(names), TAGS)), np.zeros((TAGS, TAGS))
    gw, gp = np.full_like(w, 1e-6), np.full_like(pair, 1e-6)
    for _ in range(epochs):
        for i in np.random.default_rng(seed).permutation(len(work)):
            rows, tags = work[i]
            n = len(rows)
            e = np.array([w[f].sum(axis=0) for f in rows])
            e[0, 2] = -1e9
            trans = pair + _ALLOWED
            a, b = np.zeros((n, TAGS)), np.zeros((n, TAGS))
            a[0] = e[0]
            for k in range(1, n):
                x = a[k - 1][:, None] + trans
                top = x.max(axis=0)
                a[k] = e[k] + top + np.log(np.exp(x - top).sum(axis=0))
            for k in range(n - 2, -1, -1):
                x = trans + (e[k + 1] + b[k + 1])[None, :]
                top = x.max(axis=1)
                b[k] = top + np.log(np.exp(x - top[:, None]).sum(axis=1))
            z = a[-1].max() + np.log(np.exp(a[-1] - a[-1].max()).sum())
            post = np.exp(a + b - z)
            dw, dp = -0.001 * w, -0.001 * pair
            for k, f in enumerate(rows):
                d = -post[k]
                d[tags[k]] += 1
                dw[f] += d
            for k in range(1, n):
                dp -= np.exp(a[k - 1][:, None] + trans + (e[k] + b[k])[None, :] - z)
                dp[tags[k - 1], tags[k]] += 1
            gw += dw * dw
            gp += dp * dp
            w += 0.25 * dw / np.sqrt(gw)
            pair += 0.25 * dp / np.sqrt(gp)
    return Field(names, w, pair)


def find(text: str | None, field: Field) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans, and all spans (by start, then kind in the order of KINDS, then those of the field)."""
    if not text:
        return [], []
    base, more, whole = base_spans(text), [], None
    for toks in chains(text):
        whole = file_features(text) if whole is None else whole
        words = [text[a:b] for a, b in toks]
        tags = field.tags([_features(words, k, whole) for k in range(len(words))])
        start = None
        for k, t in enumerate([*tags, 0]):
            if start is not None and t != 2:
                a, b = toks[start][0], toks[k - 1][1]
                if not any(x < b and a < y for x, y, _ in base):
                    more.append((a, b, FIELD))
                start = None
            if t == 1:
                start = k
    return base, sorted(base + more, key=lambda x: (x[0], (*KINDS, FIELD).index(x[2]), x[1])) if more else base


def told(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def scanned(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """doc_id, the number of base spans of each kind, base_sha256 and spans of every row of docs."""
    field = trained() if field is None else field

    def run(part: pa.RecordBatch) -> dict:
        out: dict[str, list] = {k: [] for k in ("n_assign", "n_access", "n_hex", "base_sha256", "spans")}
        for text in part.column("text").to_pylist():
            base, every = find(text, field)
            for k in KINDS:
                out[f"n_{k}"].append(sum(x[2] == k for x in base))
            out["base_sha256"].append(hashlib.sha256(told(base).encode()).hexdigest())
            out["spans"].append(told(every))
        return {"doc_id": part.column("doc_id"), **out}

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, schema, text="text")
