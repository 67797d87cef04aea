"""Personal data: fixed patterns, and a semi-Markov conditional random field that adds what they miss.

Patterns give the base spans (email, ip, card, phone). Islands of text that hold many digits or spelt-out addresses
are cut into tokens, and every run of up to MAX_TOKENS tokens is a candidate segment of each kind. A candidate's score
is the weight of its whole-span features (grouping of digits, separators, check digit, octets, signs at its borders,
cue words before it); text outside entities scores 0. Dynamic programming over token positions, with segments of
bounded length, picks boundaries and kinds jointly. The weights maximise the conditional likelihood of generated
snippets with known spans: forward and backward sums over the same segments give the gradient, in numpy.

Defined cases: null text counts as empty; an empty text has no spans; whole texts are searched however long they are;
an empty table gives no rows. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left, bisect_right
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import map_rows, map_whole

KINDS = ("email", "ip", "card", "phone")
MAX_TOKENS, MAX_DIGITS, SEED = 18, 20, 5

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Matches of local@domain in time linear in the text: the local part is the run before the sign."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            out.append((start, end))
        at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the pattern matches, by start, then kind in the order of KINDS."""
    if not _ANY.search(text):
        return []
    out = [(a, b, 0) for a, b in _emails(text)]
    out += [(m.start(), m.end(), 1) for m in _IP.finditer(text) if all(len(x) < 4 and int(x or "0") <= 255 for x in (y.lstrip("0") for y in m[0].split(".")))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), m.end(), 2))
    if "+" in text:
        out += [(m.start(), m.end(), 3) for m in _PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return [(a, b, KINDS[k]) for a, b, k in sorted(out, key=lambda x: (x[0], x[2], x[1]))]


_ISLAND = re.compile(
    r"[+(]{0,2}[0-9](?:[\x20().,/+\[\]-]{0,3}[0-9]){6,}\)?"
    r"|[A-Za-z0-9._%+-]{1,64}[\x20]?(?:\[at\]|\(at\)|\{at\}|[\x20](?:AT|at)[\x20](?=[A-Za-z0-9-]{1,40}[\x20]?(?:\[|\(|\{|[\x20])(?:dot|DOT))|[\x20]@[\x20])[\x20]?"
    r"[A-Za-z0-9-]{1,64}(?:[\x20]?(?:\[dot\]|\(dot\)|\{dot\}|[\x20](?:dot|DOT)[\x20]|\.)[\x20]?[A-Za-z0-9-]{1,24}){1,4}"
    r"|[0-9]{1,3}(?:[\x20().,/+\[\]-]{1,3}[0-9]{1,3}){3,5}"  # 4 to 6 digits in four groups or more, such as a short address
)
_HINT = re.compile(r"[0-9][\x20().,/+\[\]-]{0,3}[0-9][\x20().,/+\[\]-]{0,3}[0-9][\x20().,/+\[\]-]{0,3}[0-9]|\bdot\b|\bDOT\b|[\[({]at[\])}]|\x20@\x20")
_TOKEN = re.compile(r"[0-9]+|[A-Za-z]+|\s|[^\sA-Za-z0-9]")
_WORD = re.compile(r"[A-Za-z]+")
#: Words that tell of a kind when they stand before a span.
CUES = {"email": "email mail e contact write reach", "ip": "ip host address server addr node", "card": "card visa mastercard credit debit amex", "phone": "phone tel call mobile fax cell dial telephone"}
_CUE = {w: k for k, ws in CUES.items() for w in ws.split()}
_TOP = frozenset("com org net edu gov io co info de fr es uk example".split())


def _features(text: str, a: int, b: int, left: str, kinds: tuple[str, ...]) -> list[list[str]]:
    """The features of a segment for each of the kinds."""
    s = text[a:b]
    digits = re.sub(r"[^0-9]", "", s)
    parts = re.findall(r"[0-9]+", s)
    shape = re.sub(r"[A-Za-z]+", "w", re.sub(r"[0-9]+", lambda m: str(min(9, len(m[0]))), s))
    out = ["one", f"n{min(20, len(digits))}", f"shape{shape[:24]}" if "email" not in kinds else "", f"groups{min(9, len(parts))}"]
    out.append("luhn" if 13 <= len(digits) <= 19 and luhn(digits) else "no-luhn")
    dotted = re.sub(r"[\[\]()]", "", s).replace(" ", "")
    out.append("octets" if re.fullmatch(r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}", dotted) and all(int(p) < 256 for p in parts) else "no-octets")
    out.append("at" if re.search(r"@|[\[({ ]at[\])} ]|[ ]AT[ ]", s) else "no-at")
    words = _WORD.findall(s)
    out.append("top" if words and words[-1].lower() in _TOP and s.endswith(words[-1]) else "no-top")
    out.append("starts+" if s[0] == "+" else "starts(" if s[0] == "(" else "starts-digit" if s[0].isdigit() else "starts-word" if s[0].isalpha() else "starts-sign")
    out.append("ends-sign" if not s[-1].isalnum() else "ends-alnum")
    out.append("balanced" if s.count("(") == s.count(")") and s.count("[") == s.count("]") else "unbalanced")
    before, after = text[a - 1 : a], text[b : b + 1]
    out.append("cut-left" if before and (before.isalnum() or before in "+-(/.") else "free-left")
    out.append("cut-right" if after and (after.isalnum() or after == "-" or after == "/") else "free-right")
    more = text[b : b + 3]
    out.append("more-digits" if re.match(r"[\x20().,/-]{1,2}[0-9]", more) else "no-more")
    out.append("prior-digits" if re.search(r"[0-9][\x20().,/-]{1,2}$", text[max(0, a - 3) : a]) else "no-prior")
    out.append("list-next" if re.match(r"\x20?,\x20{0,2}[0-9(+]", text[b : b + 5]) else "no-list-next")
    out.append("list-prior" if re.search(r"[0-9],\x20{0,2}$", text[max(0, a - 4) : a]) else "no-list-prior")
    cue = next((_CUE[w] for w in reversed(left.lower().split()) if w in _CUE), "none")
    out.append(f"cue-{cue}")
    out.append("separated" if re.search(r"[0-9][\x20.()-]+[0-9]", s) else "solid")
    out.append("comma" if "," in s or "/" in s else "plain")
    return [[f"{kind}|{x}" for x in out if x] for kind in kinds]


class Lattice:
    """Tokens of an island (they tile it) and its candidate segments, made as they are asked for.

    taken holds disjoint spans in order, which no candidate may overlap.
    """

    def __init__(self, text: str, start: int, end: int, taken: list[tuple[int, int]] = ()):  # type: ignore[assignment]
        self.text = text
        self.tokens = [(m.start(), m.end()) for m in _TOKEN.finditer(text, start, end)]
        self.left = " ".join(_WORD.findall(text[max(0, start - 40) : start])[-4:])
        self.digits, self.wordy, self.free, k = [], [], [], 0
        for a, b in self.tokens:
            while k < len(taken) and taken[k][1] <= a:
                k += 1
            self.free.append(k == len(taken) or taken[k][0] >= b)
            self.digits.append(b - a if "0" <= text[a] <= "9" else 0)
            self.wordy.append(text[a].isascii() and text[a].isalpha())

    def candidates(self, t: int) -> list[tuple[int, str, list[str]]]:
        """(from token, kind, features) of the segments that end with token t - 1, the longest first."""
        text, b = self.text, self.tokens[t - 1][1]
        if not text[b - 1].isalnum():
            return []
        out, n, wordy = [], 0, False
        for s in range(t - 1, max(0, t - MAX_TOKENS) - 1, -1):
            if not self.free[s]:
                break
            a = self.tokens[s][0]
            n, wordy = n + self.digits[s], wordy or self.wordy[s]
            if text[a] in " \n\t,./-])":
                continue
            kinds = ("email",) if wordy and t - s > 4 else ("ip", "card", "phone") if not wordy and 4 <= n <= MAX_DIGITS else ()
            if kinds:
                out += [(s, kind, f) for kind, f in zip(kinds, _features(text, a, b, self.left, kinds))][::-1]
        return out[::-1]

    def best(self, weights: dict[str, float]) -> list[tuple[int, int, str]]:
        """The segmentation with the highest score (semi-Markov Viterbi)."""
        n = len(self.tokens)
        score, back = [0.0] * (n + 1), [None] * (n + 1)
        for t in range(1, n + 1):
            score[t] = score[t - 1]
            for s, kind, f in self.candidates(t):
                v = score[s] + sum(weights.get(x, 0.0) for x in f)
                if v > score[t]:
                    score[t], back[t] = v, (s, kind)
        out, t = [], n
        while t > 0:
            if back[t] is None:
                t -= 1
            else:
                s, kind = back[t]
                out.append((self.tokens[s][0], self.tokens[t - 1][1], kind))
                t = s
        return out[::-1]


def generated(count: int, seed: int = SEED) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Snippets with the spans that hold personal data (one, or a list), from templates; half of them hold none."""
    r = random.Random(seed)
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(3, 9)))

    def card() -> str:
        body = r.choice("3456") + digits(r.choice((14, 14, 14, 13)))
        full = next(body + c for c in "0123456789" if luhn(body + c))
        sep = r.choice((".", "/", "  ", " - "))
        return sep.join(full[k : k + 4] for k in range(0, len(full), 4))

    def phone() -> str:
        a, b, c = r.choice("23456789") + digits(2), r.choice("23456789") + digits(2), digits(4)
        return r.choice((f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"({a}){b}-{c}", f"00{r.choice('1345')}{digits(1)} {a} {b} {c}", f"1-{a}-{b}-{c}"))

    def email() -> str:
        at, dot = r.choice(((" at ", " dot "), ("[at]", "[dot]"), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" @ ", "."), (" (at) ", "."), (" AT ", " DOT ")))
        return f"{word()}{r.choice(('', '.' + word(), digits(2)))}{at}{word()}{dot}{r.choice(('com', 'org', 'net', 'de', 'io'))}"

    def ip() -> str:
        top = r.choice((255, 255, 9, 20))  # short ones too
        return r.choice(("[.]", "(.)", " . ")).join(str(r.randint(0, top)) for _ in range(4))

    def none() -> str:
        return r.choice((
            f"{r.randint(1990, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}", f"{r.randint(1, 9)},{digits(3)},{digits(3)}", f"{digits(2)}/{digits(2)}/{digits(4)}", digits(r.randint(7, 20)), f"{digits(4)}-{digits(4)}",
            f"{digits(3)} {digits(3)} {digits(3)}", f"{r.randint(300, 999)}.{digits(3)}.{digits(3)}.{digits(3)}", f"{digits(1)}.{digits(2)}.{digits(3)}.{digits(4)}", f"{digits(4)} {digits(4)} {digits(4)} {digits(4)} {digits(4)} {digits(4)}",
            f"{digits(2)}:{digits(2)}:{digits(2)} {digits(4)}", f"{digits(5)}-{digits(5)}-{digits(5)}", f"{digits(3)}-{digits(2)}-{digits(1)}-{digits(6)}-{digits(1)}", f"{digits(8)}.{digits(4)}", f"{digits(4)} {digits(4)} {digits(4)} {digits(4)}",
            r.choice((", ", " ", "-", "/", ",", ") ")).join(str(r.randint(0, 12)) for _ in range(r.randint(4, 5))),
            f"meet at {word()} dot {word()}", f"{word()} at {word()}", f"{word()} @ {word()}",
        ))

    out = []
    for k in range(count):
        kind = KINDS[k // 2 % 4] if k % 2 else None
        make = {"email": email, "ip": ip, "card": card, "phone": phone}[kind] if kind else none
        values, sep = [make() for _ in range(r.choice((1, 1, 1, 2, 3, 4)))], r.choice((", ", ", ", " , ", ",  "))
        cue = r.choice(CUES[kind].split()) if kind and r.random() < 0.5 else word()
        head = f"{word()} {word()} {cue}{r.choice((' ', ': ', ' is '))}"
        text = f"{head}{sep.join(values)}{r.choice((' ', '. ', ', '))}{word()} {word()}."
        spans, at = [], len(head)
        for value in values if kind else ():
            spans.append((at, at + len(value), kind))
            at += len(value) + len(sep)
        out.append((text, spans))
    return out


def islands(text: str) -> list[tuple[int, int]]:
    """Spans that the field looks at."""
    return [(m.start(), m.end()) for m in _ISLAND.finditer(text)] if _HINT.search(text) else []


def united(spans: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """The spans (by start) as disjoint ones, in order."""
    out: list[tuple[int, int]] = []
    for a, b, _ in spans:
        if out and a < out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


@lru_cache(maxsize=2)
def trained(count: int = 600, epochs: int = 14, seed: int = SEED) -> dict[str, float]:
    """Weights of the whole-span features: AdaGrad steps on the conditional likelihood of generated snippets."""
    names: dict[str, int] = {}
    work = []
    for text, spans in generated(count, seed):
        taken = united(base_spans(text))
        for a, b in islands(text):
            lat = Lattice(text, a, b, taken)
            gold = {(x, y, k) for x, y, k in spans}
            segs = []
            for t in range(1, len(lat.tokens) + 1):
                for s, kind, f in lat.candidates(t):
                    ids = np.array([names.setdefault(x, len(names)) for x in f])
                    segs.append((s, t, ids, (lat.tokens[s][0], lat.tokens[t - 1][1], kind) in gold))
            if segs:
                work.append((len(lat.tokens), segs))
    w, g2 = np.zeros(len(names)), np.full(len(names), 1e-6)
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in order.permutation(len(work)):
            n, segs = work[k]
            score = [w[ids].sum() for _, _, ids, _ in segs]
            by_end, by_start = [[] for _ in range(n + 1)], [[] for _ in range(n + 1)]
            for j, (s, t, _, _) in enumerate(segs):
                by_end[t].append(j)
                by_start[s].append(j)
            fwd, bwd = np.zeros(n + 1), np.zeros(n + 1)
            for t in range(1, n + 1):
                fwd[t] = np.logaddexp.reduce([fwd[t - 1], *[fwd[segs[j][0]] + score[j] for j in by_end[t]]])
            for t in range(n - 1, -1, -1):
                bwd[t] = np.logaddexp.reduce([bwd[t + 1], *[bwd[segs[j][1]] + score[j] for j in by_start[t]]])
            grad = np.zeros(len(names))
            for j, (s, t, ids, gold) in enumerate(segs):
                grad[ids] += gold - np.exp(fwd[s] + score[j] + bwd[t] - fwd[n])
            grad -= 0.002 * w
            g2 += grad * grad
            w += 0.3 * grad / np.sqrt(g2)
    return {x: float(w[i]) for x, i in names.items() if abs(w[i]) > 1e-3}


def find(text: str | None, weights: dict[str, float]) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans, and all spans (by start, then kind in the order of KINDS)."""
    if not text:
        return [], []
    base, more = base_spans(text), []
    taken = united(base)
    starts, ends = [x[0] for x in taken], [x[1] for x in taken]
    for a, b in islands(text):
        more += Lattice(text, a, b, taken[bisect_right(ends, a) : bisect_left(starts, b)]).best(weights)
    if not more:
        return base, base
    return base, sorted(base + more, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def told(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def personal(docs: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """doc_id, the number of base spans of each kind, base_sha256, spans, and n_spans (how many spans there are in all) of every row of docs."""
    weights = trained() if weights is None else weights
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long"

    def run(part: pa.RecordBatch) -> dict:
        out: dict[str, list] = {k: [] for k in ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans")}
        for text in part.column("text").to_pylist():
            base, every = find(text, weights)
            for k in KINDS:
                out[f"n_{k}"].append(sum(x[2] == k for x in base))
            out["base_sha256"].append(hashlib.sha256(told(base).encode()).hexdigest())
            out["spans"].append(told(every))
            out["n_spans"].append(len(every))
        return {"doc_id": part.column("doc_id"), **out}

    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, schema, text="text")


def masked(text: str | None, weights: dict[str, float]) -> str | None:
    """The text with each span (overlapping ones as one) replaced by its kind in angle brackets."""
    _, spans = find(text, weights)
    if not spans:
        return text
    out, at = [], 0
    for a, b, kind in spans:
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join(out) + text[at:]


def without_personal(docs: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """docs with the personal data in text masked, and n_chars renewed where it changed; other columns as they are."""
    weights = trained() if weights is None else weights

    def mask(part: pa.RecordBatch) -> pa.RecordBatch:
        old = part.column("text").to_pylist()
        new = [masked(t, weights) for t in old]
        changed = [k for k, (a, b) in enumerate(zip(old, new)) if a is not b]
        if not changed:
            return part
        cols = {"text": pa.array(new, part.column("text").type)}
        if "n_chars" in part.schema.names and pa.types.is_integer(part.column("n_chars").type):
            n = part.column("n_chars").to_pylist()
            for k in changed:
                n[k] = len(new[k])
            cols["n_chars"] = pa.array(n, part.column("n_chars").type)
        return pa.RecordBatch.from_arrays([cols.get(c, part.column(i)) for i, c in enumerate(part.schema.names)], names=part.schema.names)

    return map_whole(docs, mask)
