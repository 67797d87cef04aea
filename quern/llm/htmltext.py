"""Main text of web pages: a recurrent labeller of blocks.

A page is read into its leaf sequence: runs of text between block boundaries, each with the path of tags (and class
and id words) above it. A block is described by hashed vectors of its path and of its words, and by some numbers
(length, share of link text, place). A bidirectional LSTM runs over the whole sequence in both directions, so each
label is given in the context of the whole document; a logistic layer says whether a block is main text. The network
is trained here, in numpy, by back-propagation through time on generated pages of many layouts whose blocks are known.
Blocks labelled main are joined in page order.

Runs under script, style, template, noscript, select, textarea, button, svg, title and the like never reach the text.
Character references are decoded; white space inside a block becomes one space.

Defined cases: null or empty html gives an empty text; markup that ends early or is not closed is read as far as it
goes; text outside all tags is a block like any other; pages of any length are read whole (the recurrence goes over
STRIDE blocks at a time and carries its states on, forwards from the first and backwards from the last); an empty
table gives no rows.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import map_rows

#: Buckets of path words and of text words; further numbers; width of the network; blocks that the recurrence takes at once.
PATHS, WORDS, NUMBERS, HIDDEN, STRIDE, SEED = 96, 48, 8, 16, 512, 9
WIDTH = PATHS + WORDS + NUMBERS

#: Fixed sets of element names of HTML: no content, content that is no text, inside a line, ended by a like one.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template noscript iframe object svg math canvas audio video select textarea button title option datalist".split())
TEXT_ONLY = frozenset("script style textarea title iframe noscript template".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr img input label".split())
ENDS = {t: frozenset(e.split()) for t, e in (("p", "p"), ("li", "li"), ("dt", "dt dd"), ("dd", "dt dd"), ("tr", "tr td th"), ("td", "td th"), ("th", "td th"), ("option", "option"))}
_BLOCKS_END_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul figure details".split())
_TAG = re.compile(r"<(?:!--.*?(?:-->|$)|!\[CDATA\[.*?(?:\]\]>|$)|[!?][^>]*(?:>|$)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*?)(?:>|$))", re.S)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_SPLIT = re.compile(r"[^a-z]+")


class Element:
    """An open element: its words (its name, and those of its class, id and role) and the element around it.

    Elements share what is above them, so a page takes memory and time in proportion to its length, however deep it is.
    """

    __slots__ = ("tag", "words", "up", "_sum", "_count")

    def __init__(self, tag: str, words: tuple[str, ...], up: "Element | None"):
        self.tag, self.words, self.up = tag, () if tag in INLINE else words, up
        self._sum: np.ndarray | None = None
        self._count = 0

    def told(self) -> tuple[np.ndarray, int]:
        """The hashed words of the element and all around it, added up, and how many there are."""
        chain, e = [], self
        while e is not None and e._sum is None:
            chain.append(e)
            e = e.up
        total, count = (np.zeros(PATHS, np.float32), 0) if e is None else (e._sum, e._count)
        for e in reversed(chain):
            if e.words:
                total = total.copy()
                for w in e.words:
                    i, sign = _bucket(w, PATHS, 1)
                    total[i] += sign
                count += len(e.words)
            e._sum, e._count = total, count
        return total, count

    def last(self, n: int) -> list[str]:
        """The last n words of the path."""
        out, e = [], self
        while e is not None and len(out) < n:
            out += reversed(e.words[-(n - len(out)) :] if e.words else ())
            e = e.up
        return out


class Block:
    __slots__ = ("element", "text", "linked")

    def __init__(self, element: Element | None, text: str, linked: int):
        self.element, self.text, self.linked = element, text, linked

    @property
    def path(self) -> tuple[str, ...]:
        """The words of the elements around it, from the outermost."""
        out, e = [], self.element
        while e is not None:
            out.append(e.words)
            e = e.up
        return tuple(w for words in reversed(out) for w in words)


class _Open:
    """The open elements of a page, with counts and places by name."""

    def __init__(self) -> None:
        self.stack: list[Element] = []
        self.at: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.raw = 0

    def top(self) -> Element | None:
        return self.stack[-1] if self.stack else None

    def has(self, *tags: str) -> bool:
        return any(self.at.get(t) for t in tags)

    def push(self, tag: str, words: tuple[str, ...]) -> None:
        self.at.setdefault(tag, []).append(len(self.stack))
        if tag not in INLINE:
            self.blocks.append(len(self.stack))
        self.raw += tag in RAW
        self.stack.append(Element(tag, words, self.top()))

    def pop(self) -> None:
        tag = self.stack.pop().tag
        self.at[tag].pop()
        if tag not in INLINE:
            self.blocks.pop()
        self.raw -= tag in RAW

    def close(self, tag: str) -> None:
        """Closes the last element of that name and all in it; one inside a line is not sought beyond the block around."""
        places = self.at.get(tag)
        if not places or tag in INLINE and self.blocks and self.blocks[-1] > places[-1]:
            return
        to = places[-1]
        while len(self.stack) > to:
            self.pop()


def blocks(page: str | None) -> list[Block]:
    """The leaf sequence of a page: text runs of blocks, each with the element that it stands in."""
    out: list[Block] = []
    if not page:
        return out
    opened = _Open()
    run: list[str] = []
    state: dict = {"linked": 0, "element": None}

    def flush() -> None:
        if run:
            text = " ".join(html.unescape("".join(run)).split())
            if text:
                out.append(Block(state["element"], text, state["linked"]))
        run.clear()
        state["linked"] = 0

    def add(text: str) -> None:
        if not text or opened.raw:
            return
        if not run:
            state["element"] = opened.top()
        run.append(text)
        if opened.has("a"):
            state["linked"] += len(text)

    at = 0
    while at < len(page):
        lt = page.find("<", at)
        if lt < 0:
            add(page[at:])
            break
        m = _TAG.match(page, lt)
        if m is None:  # a sign that opens no tag
            add(page[at : lt + 1])
            at = lt + 1
            continue
        add(page[at:lt])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag not in INLINE:
                flush()
            opened.close(tag)
            continue
        if tag == "br" or tag not in INLINE and tag not in VOID:
            if tag == "br":
                run.append(" ")
            else:
                flush()
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        if tag in _BLOCKS_END_P:
            while opened.has("p"):
                opened.pop()
        if tag in ENDS:
            while opened.stack and (opened.top().tag in ENDS[tag] or opened.top().tag in INLINE and opened.has(*ENDS[tag])):
                opened.pop()
        if m[3].rstrip().endswith("/") and tag in INLINE:
            continue
        words = [tag]
        for a, b, c in _NAMES.findall(m[3]):
            words += [w for w in _SPLIT.split((a or b or c).lower()) if w]
        opened.push(tag, tuple(words))
        if tag in TEXT_ONLY:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            opened.pop()
    flush()
    return out


@lru_cache(maxsize=200_000)
def _bucket(word: str, size: int, salt: int) -> tuple[int, float]:
    h = zlib.crc32(word.encode(), salt)
    return h % size, 1.0 if h >> 20 & 1 else -1.0


def vectors(seq: list[Block]) -> np.ndarray:
    """One row of WIDTH numbers for each block."""
    x = np.zeros((len(seq), WIDTH), dtype=np.float32)
    n = max(1, len(seq))
    for k, b in enumerate(seq):
        depth = 0
        if b.element is not None:
            x[k, :PATHS], depth = b.element.told()
            for w in b.element.last(2):
                i, s = _bucket(w, PATHS, 2)
                x[k, i] += s * 0.5
        words = b.text.lower().split()
        for w in words:
            i, s = _bucket(w, WORDS, 3)
            x[k, PATHS + i] += s / len(words)
        t, size = PATHS + WORDS, len(b.text)
        x[k, t : t + 8] = (np.log1p(size) / 6, min(1.0, b.linked / max(1, size)), k / n, 1.0 if size > 200 else 0.0, 1.0 if b.text[-1] in ".!?\"'" else 0.0, min(1.0, b.text.count(",") / 5), min(1.0, depth / 12), 1.0)
    return x


class Network:
    """A bidirectional LSTM and a logistic layer over its two states."""

    def __init__(self, rng: np.random.Generator):
        h = HIDDEN
        make = lambda *s: (rng.normal(0, 1, s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"wf": make(WIDTH, 4 * h), "uf": make(h, 4 * h), "bf": np.zeros(4 * h, np.float32), "wb": make(WIDTH, 4 * h), "ub": make(h, 4 * h), "bb": np.zeros(4 * h, np.float32), "o": make(2 * h, 1), "c": np.zeros(1, np.float32)}
        for b in ("bf", "bb"):
            self.p[b][h : 2 * h] = 1.0

    def run(self, x: np.ndarray, mask: np.ndarray, way: str, keep: bool, state: list[np.ndarray] | None = None) -> tuple[np.ndarray, list]:
        """States for x (steps x pages x WIDTH); mask is 1 where a page has a block. way is f or b.

        state, if given, holds the two states to start from, and afterwards those at the end.
        """
        t, n, _ = x.shape
        h = HIDDEN
        z_in = x @ self.p["w" + way] + self.p["b" + way]
        u = self.p["u" + way]
        s, c = state or (np.zeros((n, h), np.float32), np.zeros((n, h), np.float32))
        out, kept = np.zeros((t, n, h), np.float32), []
        for k in range(t) if way == "f" else range(t - 1, -1, -1):
            z = z_in[k] + s @ u
            gates = 1 / (1 + np.exp(-z[:, : 3 * h].clip(-30, 30)))
            i, f, o = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :]
            g = np.tanh(z[:, 3 * h :])
            c_new = f * c + i * g
            tc = np.tanh(c_new)
            m = mask[k][:, None]
            if keep:
                kept.append((k, s, c, i, f, o, g, tc, m))
            s, c = np.where(m > 0, o * tc, s), np.where(m > 0, c_new, c)
            out[k] = s
        if state is not None:
            state[:] = s, c
        return out, kept

    def scores(self, seqs: list[np.ndarray], stride: int = STRIDE) -> list[np.ndarray]:
        """The score of each block of each sequence; the sequences come in order of length.

        Both directions go over stride blocks at a time, with the sequences that reach so far.
        """
        out = [np.full(len(x), self.p["c"][0], np.float32) for x in seqs]
        lens = np.array([len(x) for x in seqs])
        starts = range(0, int(lens[-1]) if len(lens) else 0, stride)
        for way, half in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, None))):
            held = np.zeros((2, len(seqs), HIDDEN), np.float32)
            for at in starts if way == "f" else reversed(starts):
                first = int(np.searchsorted(lens, at, side="right"))
                state = list(held[:, first:])
                got, _ = self.run(*batched([x[at : at + stride] for x in seqs[first:]]), way, False, state)
                held[:, first:] = state
                got = (got @ self.p["o"][half])[..., 0]
                for j, k in enumerate(range(first, len(seqs))):
                    n = min(stride, len(seqs[k]) - at)
                    out[k][at : at + n] += got[:n, j]
        return out

    def step(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss and gradients for labels y (steps x pages)."""
        h = HIDDEN
        f_out, f_kept = self.run(x, mask, "f", True)
        b_out, b_kept = self.run(x, mask, "b", True)
        both = np.concatenate((f_out, b_out), axis=2)
        score = (both @ self.p["o"])[..., 0] + self.p["c"]
        prob = 1 / (1 + np.exp(-score.clip(-30, 30)))
        total = mask.sum()
        loss = float(-(mask * (y * np.log(prob + 1e-9) + (1 - y) * np.log(1 - prob + 1e-9))).sum() / total)
        d = ((prob - y) * mask / total).astype(np.float32)
        grad = {k: np.zeros_like(v) for k, v in self.p.items()}
        grad["o"] = (both * d[..., None]).sum(axis=(0, 1))[:, None]
        grad["c"] = np.array([d.sum()], np.float32)
        back = d[..., None] * self.p["o"][:, 0]
        for way, kept, part in (("f", f_kept, back[..., :h]), ("b", b_kept, back[..., h:])):
            u, ds, dc = self.p["u" + way], np.zeros_like(part[0]), np.zeros_like(part[0])
            for k, s, c, i, f, o, g, tc, m in reversed(kept):
                ds = ds + part[k]
                live, dead = ds * m, ds * (1 - m)
                dcn = dc * m + live * o * (1 - tc * tc)
                dz = np.concatenate((dcn * g * i * (1 - i), dcn * c * f * (1 - f), live * tc * o * (1 - o), dcn * i * (1 - g * g)), axis=1)
                grad["w" + way] += x[k].T @ dz
                grad["u" + way] += s.T @ dz
                grad["b" + way] += dz.sum(axis=0)
                ds, dc = dz @ u.T + dead, dcn * f + dc * (1 - m)
        return loss, grad


def batched(seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sequences side by side: steps x pages x WIDTH, and where there are blocks."""
    t = max(map(len, seqs))
    x, mask = np.zeros((t, len(seqs), WIDTH), np.float32), np.zeros((t, len(seqs)), np.float32)
    for k, s in enumerate(seqs):
        x[: len(s), k], mask[: len(s), k] = s, 1
    return x, mask


#: How many of the generated wrappers have names that tell nothing of what they hold.
SILENT = 0.3
#: Words that tell of parts that are not main text.
TELLING = {
    "nav": "home news about contact products blog menu login search archive", "notice": "cookie cookies consent accept privacy policy settings browser", "form": "subscribe newsletter email sign up join updates inbox", "comments": "reply replied thanks agree comment posted ago like share",
    "ad": "buy sale offer discount shop deal free sponsored", "footer": "copyright reserved rights terms imprint privacy",
}


def generated(count: int, seed: int = SEED) -> list[tuple[str, list[bool]]]:
    """Pages of many layouts, and for each of their blocks whether it is main text."""
    r = random.Random(seed)
    syllables = "an er in on re th ed es st le ti ar ou de la que sch lich eau ción or te ra ha é ü ñ ge ver".split()
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    some = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))
    noise = lambda t: t if r.random() > 0.15 else " ".join(w + r.choice(("&amp;&amp;", "%%%", "###", "***", "!!", " |")) for w in t.split())
    sentence = lambda a=3, b=40: noise(some(a, b).capitalize() + r.choice((".", ".", ".", "", "!", "?")))
    out = []
    told = {k: v.split() for k, v in TELLING.items()}

    def typical(kind: str, text: str) -> str:
        """The text with some words of its kind in it, wherever they fall."""
        words = text.split()
        for _ in range(r.randint(0, 1 + len(words) // 4)):
            words.insert(r.randint(0, len(words)), r.choice(told[kind]))
        return " ".join(words)

    def links(n: int) -> str:
        return "".join(r.choice(('<li><a href="/{0}">{0}</a></li>', '<a href="/{0}">{0}</a> ')).format(typical("nav", some(1, 3))) for _ in range(n))

    def bare(kind: str) -> str:
        """A part of the page that is not main text."""
        c = {"nav": ("nav menu navbar topnav", "nav div ul"), "header": ("header masthead topbar banner", "header div"), "footer": ("footer site-footer bottom copyright", "footer div"), "aside": ("sidebar aside related widget", "aside div section"), "ad": ("ad ads advert sponsor promo banner-ad", "div aside section"), "comments": ("comments comment-list replies discussion", "section div ol"), "form": ("subscribe newsletter signup search", "form div"), "notice": ("cookie notice consent banner alert", "div section")}[kind]
        cls, tag = r.choice(c[0].split()), r.choice(c[1].split())
        attr = r.choice((f' class="{cls}"', f' id="{cls}"', f' class="{cls} box"')) if tag in ("div", "section", "ul", "ol") or r.random() < 0.5 else ""
        if r.random() < SILENT:  # a wrapper whose name tells nothing
            tag, attr = r.choice(("div", "div", "section")), silent()
        body = {
            "nav": lambda: f"<ul>{links(r.randint(3, 9))}</ul>" if tag != "ul" else links(r.randint(3, 9)),
            "header": lambda: f"<h{r.randint(1, 2)}>{some(1, 4)}</h1><p>{sentence(2, 8)}</p>",
            "footer": lambda: r.choice((f"&copy; {some(1, 3)} &middot; {typical(kind, sentence(2, 9))}", f"<p>&copy; 20{r.randint(10, 30)} {some(1, 3)}</p>{links(3)}")),
            "aside": lambda: f"<h3>{some(1, 3)}</h3>" + r.choice((f"<ul>{links(r.randint(2, 6))}</ul>", f"<p>{sentence(3, 25)}</p>")),
            "ad": lambda: r.choice((typical(kind, sentence(3, 20)), f"<p>{typical(kind, sentence(4, 18))}</p><a href='#'>{some(1, 2)}</a>")),
            "comments": lambda: f"<h3>{some(1, 2)}</h3>" + "".join(f'<div class="comment"><b>{word()}</b><p>{typical(kind, sentence(3, 40))}</p></div>' for _ in range(r.randint(1, 5))),
            "form": lambda: f"<label>{some(1, 4)}</label><input type=text><p>{typical(kind, sentence(2, 12))}</p><button>{word()}</button>",
            "notice": lambda: f"<p>{typical(kind, sentence(4, 25))}</p><button>OK</button>",
        }[kind]()
        return f"<{tag}{attr}>{body}</{tag}>"

    def silent() -> str:
        return r.choice(("", f' class="{r.choice("abcdehkmxyz")}{r.randint(1, 99)}"', f' class="{word()}"', f' id="{r.choice("abcxyz")}-{r.randint(1, 9)}"'))

    def main() -> str:
        style = r.choice((("<p>{}</p>", "<p>{}</p>", "<p>{}", "<p><b>{}<br>", "<p><i>{}</i></p>"),) * 7 + (("<div>{}</div>",), ("<span>{}</span><br>", "{}<br><br>"), (f"<div{silent()}>{{}}</div>", "<p>{}</p>")))
        parts = [f"<h1>{noise(some(2, 12))}</h1>"] if r.random() < 0.85 else []
        for _ in range(r.choice((1, 1, 2, 3, 6, 12, 20))):
            kind = r.random()
            if kind < 0.75:
                text = sentence(1, 12) if r.random() < 0.25 else " ".join(sentence() for _ in range(r.randint(1, 7)))
                parts.append(r.choice(style).format(text))
            elif kind < 0.83:
                parts.append(f"<h{r.randint(2, 4)}>{some(1, 6)}</h2>")
            elif kind < 0.9:
                parts.append("<ul>" + "".join(f"<li>{sentence(2, 12)}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            elif kind < 0.95:
                parts.append(f"<blockquote>{sentence()}</blockquote>")
            else:
                parts.append("<table>" + "".join(f"<tr><td>{some(1, 3)}</td><td>{some(1, 3)}</td></tr>" for _ in range(3)) + "</table>")
        return "".join(parts)

    wraps = (("<article>", "</article>"), ("<main>", "</main>"), ('<div class="content">', "</div>"), ('<div id="article-body">', "</div>"), ("<main><article>", "</article></main>"), ('<div class="post-content entry">', "</div>"), ('<section class="story">', "</section>"), ("<article>", "</article>"))
    marks = ("\ue000", "\ue001")
    for _ in range(count):
        before = [bare(k) for k in ("header", "nav", "notice", "ad", "aside") if r.random() < (0.8 if k == "nav" else 0.4)]
        after = [bare(k) for k in ("ad", "aside", "comments", "form", "footer") if r.random() < (0.85 if k == "footer" else 0.4)]
        r.shuffle(before)
        open_, close = r.choice(wraps)
        if r.random() < SILENT:
            tag = r.choice(("div", "div", "section", "main"))
            open_, close = f"<{tag}{silent()}>", f"</{tag}>"
        body = main()
        if r.random() < 0.35:  # something foreign in the midst
            spots = [m.start() for m in re.finditer(r"<p>|<div>", body)]
            spot = r.choice(spots) if spots else len(body)
            body = body[:spot] + marks[1] + bare(r.choice(("ad", "form", "aside", "notice"))) + marks[0] + body[spot:]
        page = f"<!DOCTYPE html><html><head><title>{some(2, 8)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head><body>{''.join(before)}{open_}{marks[0]}{body}{marks[1]}{close}{''.join(after)}"
        page += "</body></html>" if r.random() < 0.8 else ""
        pure, inside, labels = [], False, []
        for piece in re.split(f"([{marks[0]}{marks[1]}])", page):
            if piece in marks and piece:
                inside = piece == marks[0]
            else:
                pure.append((piece, inside))
        text = "".join(p for p, _ in pure)
        marked = "".join(re.sub(r">([^<]+)", lambda m: ">" + (m[1] if not m[1].strip() else "\ue002" + m[1]), p) if i else p for p, i in pure)
        labels = ["\ue002" in b.text for b in blocks(marked)]
        if len(labels) == len(blocks(text)) and labels:
            out.append((text, labels))
    return out


@lru_cache(maxsize=2)
def trained(count: int = 1800, epochs: int = 20, seed: int = SEED) -> Network:
    """The network fitted to generated pages (Adam, batches of pages of like length)."""
    rng = np.random.default_rng(seed)
    work = [(vectors(blocks(p)), np.array(y, np.float32)) for p, y in generated(count, seed)]
    work.sort(key=lambda w: len(w[0]))
    net = Network(rng)
    m1, m2 = ({k: np.zeros_like(v) for k, v in net.p.items()} for _ in range(2))
    n = 0
    groups = [work[k : k + 24] for k in range(0, len(work), 24)]
    for epoch in range(epochs):
        for g in rng.permutation(len(groups)):
            x, mask = batched([w[0] for w in groups[g]])
            y = np.zeros(mask.shape, np.float32)
            for k, w in enumerate(groups[g]):
                y[: len(w[1]), k] = w[1]
            _, grad = net.step(x, mask, y)
            n += 1
            rate = 0.01 * (1 - 0.8 * epoch / epochs)
            for k, d in grad.items():
                m1[k] = 0.9 * m1[k] + 0.1 * d
                m2[k] = 0.99 * m2[k] + 0.01 * d * d
                net.p[k] -= rate * (m1[k] / (1 - 0.9**n)) / (np.sqrt(m2[k] / (1 - 0.99**n)) + 1e-7)
    return net


def labelled(pages: list[str | None], net: Network) -> list[list[tuple[Block, bool]]]:
    """The blocks of each page, and whether the network takes them for main text."""
    seqs = [blocks(p) for p in pages]
    order = sorted((k for k, s in enumerate(seqs) if s), key=lambda k: len(seqs[k]))
    out: list[list[tuple[Block, bool]]] = [[] for _ in seqs]
    for at in range(0, len(order), 64):
        group = order[at : at + 64]
        for k, score in zip(group, net.scores([vectors(seqs[k]) for k in group])):
            out[k] = [(b, bool(x > 0)) for b, x in zip(seqs[k], score)]
    return out


def texts(pages: list[str | None], net: Network) -> list[str]:
    return [" ".join(b.text for b, main in page if main) for page in labelled(pages, net)]


def main_text(pages: DataFrame, net: Network | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every row of pages (which has page_id, url, html)."""
    net = trained() if net is None else net
    shared = pages.sparkSession.sparkContext.broadcast(net)

    def run(part: pa.RecordBatch) -> dict:
        got = texts(part.column("html").to_pylist(), shared.value)
        return {"page_id": part.column("page_id"), "url": part.column("url"), "text": got, "n_chars": [len(t) for t in got]}

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return map_rows(rows, run, "page_id long, url string, text string, n_chars long", text="html")
