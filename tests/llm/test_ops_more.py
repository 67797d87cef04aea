"""Vector codes, line dedup and collocations on odd tables, against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from quern.llm import collocations, htmltext, linededup, vectorcodes

VECTORS = "vec_id long, embedding array<double>, label int, code string, error string, x int, n int"


def brute_codes(rows, entries, rounds):
    """vec_id, code, error, label_error and digest of rows (vec_id, embedding, label), every part against every entry."""
    most = 2**62
    good = []
    for i, x, y, *_ in rows:
        if x is not None and None not in x and np.isfinite(x).all():
            good.append((i, [max(-most, min(most, int(np.floor(1024.0 * v)) if abs(v) < 1e300 else int(np.sign(v)) * most)) for v in x], y))
    width = max(1, -(-max((len(x) for _, x, _ in good), default=0) // 4))
    parts = [[(x + [0] * (4 * width - len(x)))[p * width : (p + 1) * width] for p in range(4)] for _, x, _ in good]
    first = sorted((k for k in range(len(good)) if good[k][0] is not None), key=lambda k: (good[k][0], np.array(good[k][1], "<i8").tobytes()))[:entries]
    books = [[list(parts[k][p]) for k in first] for p in range(4)]

    def assigned():
        return [[min((sum((a - b) ** 2 for a, b in zip(v[p], e)), k) for k, e in enumerate(books[p])) for p in range(4)] for v in parts]

    for _ in range(rounds):
        at = assigned()
        for p in range(4):
            for k in range(len(books[p])):
                mine = [v[p] for v, a in zip(parts, at) if a[p][1] == k]
                if mine:
                    books[p][k] = [sum(c) // len(mine) for c in zip(*mine)]
    done, long = assigned(), 2**63 - 1
    error = [min(long, sum(d for d, _ in a)) for a in done]
    labels = Counter()
    for (_, _, y), e in zip(good, error):
        labels[y] += e
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return Counter((i, "".join(f"{k:02x}" for _, k in a), e, min(long, labels[y]), digest) for (i, _, y), a, e in zip(good, done, error))


def vector_rows():
    rng = np.random.default_rng(5)
    rows = [(int(i), [float(v) for v in rng.normal(0, 0.1, 8)], int(i) % 3 or None) for i in rng.permutation(290)]
    rows += [(301, None, 1), (302, [1.0, None], 1), (303, [float("nan")] * 8, 1), (304, [float("inf")] * 8, 1), (305, [], 1), (306, [0.5] * 3, 2), (None, [0.25] * 8, None)]
    rows += [(7, [0.125] * 8, 1), (7, [0.125] * 8, 1), rows[4], (310, [-0.0004] * 8, 2)]
    return [(*r, "c", "e", 1, 2) for r in rows]


@pytest.mark.parametrize("more", [[], [(400, [1e306, -3.0], 0, "", "", 0, 0), (401, [5e12] * 8, 0, "", "", 0, 0), (402, [-3e15] * 8, 0, "", "", 0, 0)]])
def test_vector_codes(spark, more):
    rows = vector_rows() + more
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    assert Counter(map(tuple, vectorcodes.compressed(df).collect())) == brute_codes(rows, 256, 4)


def test_vector_codes_of_few_and_no_rows(spark):
    rows = [(k, [0.5 * k, 1.0, 2.0, 3.0], None, "", "", 0, 0) for k in range(3)] * 2
    assert Counter(map(tuple, vectorcodes.compressed(spark.createDataFrame(rows, VECTORS)).collect())) == brute_codes(rows, 256, 4)
    for none in ([], [(None, [1.0], 1, "", "", 0, 0)], [(1, None, 1, "", "", 0, 0)]):
        assert vectorcodes.compressed(spark.createDataFrame(none, VECTORS)).count() == 0


@pytest.mark.parametrize("scale", [3, 1 << 28, 1 << 61])
def test_nearest_entries_with_many_ties(scale):
    rng = np.random.default_rng(6)
    book = rng.integers(-2, 3, (200, 5)) * scale
    parts = rng.integers(-3, 4, (400, 5)) * scale
    index, away = vectorcodes.nearest(parts, book, vectorcodes.tree(book))
    for v, k, d in zip(parts.tolist(), index, away):
        assert (int(d), int(k)) == min((sum((a - b) ** 2 for a, b in zip(v, e)), n) for n, e in enumerate(book.tolist()))


def test_codes_decode_to_their_entries(spark):
    vecs = vectorcodes.integers(spark.createDataFrame(vector_rows(), VECTORS)).persist()
    books = vectorcodes.trained(vecs, entries=16, rounds=2)
    codes = vectorcodes.coded(vecs, books)
    whole = {(r["vec_id"], bytes(r["codes"])): r["vector"] for r in vectorcodes.decoded(codes, books).collect()}
    for (_, code), vector in whole.items():
        assert vector == [v / 1024 for p in range(4) for v in books[p][code[p]].tolist()]
    first = vectorcodes.trained(vecs, entries=16, rounds=0)
    assert books.shape == first.shape == (4, 16, 2) and not (books == first).all()


DOCS = "doc_id long, text string, lang string, n_lines int, h string, lost string, top int, phrase string"


def line_rows():
    rng = np.random.default_rng(7)
    common = [f"This is a LINE of boilerplate number {k} that many of the pages share" for k in range(12)]
    rows = []
    for k in range(70):
        own = [f"{k} {n} " + "own words " * int(rng.integers(0, 9)) for n in range(4)]
        shared = [("  " + c.lower() + "\t") if rng.random() < 0.3 else c for c in common if rng.random() < 0.15]
        lines = own + shared + shared[:1]
        rng.shuffle(lines)
        rows.append((k if k % 9 else None, "\n".join(lines)))
    long = "x" * 39
    rows += [(200 + k, f"{long}\n{long}y\n\n" + "é" * 40 + f"\n{'E' * 41}\x0b") for k in range(6)]
    rows += [(300, None), (301, ""), (302, "\n\n"), (303, "a\r\n" + common[0] + "\r"), (5, rows[5][1]), (5, rows[5][1]), (None, common[1]), (None, None)]
    rows += [(400 + k, (common[2] + "\n") * 400) for k in range(3)]
    return [(*r, "en", 1, "h", "l", 3, "p") for r in rows]


def brute_lines(rows, length, documents):
    key = lambda b: b.strip(b" \t\n\x0b\x0c\r").lower()
    whole = [(i, (t or "").encode().split(b"\n")) for i, t, *_ in rows]
    held = defaultdict(list)
    for i, lines in whole:
        for k in {key(x) for x in lines}:
            if len(k.decode()) >= length:
                held[k].append(i)
    top = {k: max((i for i in ids if i is not None), default=None) for k, ids in held.items() if len(ids) >= documents}
    out = Counter()
    for i, lines in whole:
        kept = [x for x in lines if key(x) not in top or top[key(x)] == i]
        out[(i, "\n".join(x.decode() for x in kept), len(lines), len(lines) - len(kept))] += 1
    return out


@pytest.mark.parametrize(("documents", "batches", "fanout"), [(5, 6, 3), (2, 1, 2), (5, 9, 2), (1, 3, 4)])
def test_lines_that_many_documents_share(spark, documents, batches, fanout):
    rows = line_rows()
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    got = linededup.deduplicated(df, documents=documents, batches=batches, fanout=fanout)
    assert Counter(map(tuple, got.select("doc_id", "text", "n_lines", "n_dropped").collect())) == brute_lines(rows, 40, documents)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("quern_runs")]


def test_hot_lines_are_dealt_to_several_tasks(spark, monkeypatch):
    from quern.llm import common

    monkeypatch.setattr(common, "SPLIT", 4)
    rows = line_rows()
    got = linededup.deduplicated(spark.createDataFrame(rows, DOCS))
    assert Counter(map(tuple, got.select("doc_id", "text", "n_lines", "n_dropped").collect())) == brute_lines(rows, 40, 5)


def test_runs_are_merged_by_level(spark):
    runs = linededup.Runs(spark, fanout=2)
    seen: set[bytes] = set()
    for k in range(5):
        batch = [(bytes([n]), 10 * k + n) for n in range(k, k + 4)] * 2
        fresh = {bytes(r["h"]) for r in runs.read([runs.add(spark.createDataFrame(batch, "h binary, doc_id long"))]).collect()}
        assert fresh == {b for b, _ in batch} - seen
        seen |= fresh
    assert [len(x) for x in runs.levels] == [1, 0, 1]
    assert {r["h"][0]: r["n"] for r in runs.merged().collect()} == {n: 2 * sum(k <= n < k + 4 for k in range(5)) for n in range(8)}
    runs.drop()


def test_no_documents(spark):
    none = spark.createDataFrame([], DOCS)
    assert linededup.deduplicated(none).count() == 0 and collocations.collocations(none).count() == 0
    empty = spark.createDataFrame([(1, None, None, 1, "", "", 1, ""), (2, " ;\n", "en", 1, "", "", 1, "")], DOCS)
    assert collocations.collocations(empty, least=1).count() == 0 and linededup.deduplicated(empty).count() == 2


def phrase_rows():
    rng = np.random.default_rng(8)
    words = ["alpha", "Beta", "gamma", "délta", "Épsilon", "the", "of", "x-y", "(z)", "0"]
    rows = []
    for k in range(60):
        w = [str(x) for x in rng.choice(words, int(rng.integers(1, 60)), p=[0.2, 0.2, 0.1, 0.1, 0.05, 0.2, 0.05, 0.04, 0.03, 0.03])]
        seps = [str(x) for x in rng.choice([" ", "  ", "\t", ", ", ".\n", " ! ", "\r\n", "\x0b"], len(w), p=[0.7, 0.05, 0.05, 0.05, 0.05, 0.04, 0.03, 0.03])]
        rows.append((k % 50, "".join(a + b for a, b in zip(w, seps)) + "new york city hall is here " * (k % 4), ["en", "de", None, "und", ""][k % 5]))
    rows += [(None, None, "en"), (1, "", None), (2, ",;:", "en"), (3, "the " * 900, "fr"), (4, "the " * 900, "fr")]
    return [(*r, 1, "h", "l", 3, "p") for r in rows]


def brute_phrases(rows, least, most, top, percent=100):
    f, n = Counter(), Counter()
    for _, t, lang, *_ in rows:
        lang, t = "und" if lang is None else lang, "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        for piece in re.split("[.,;:!?\n-\r]", t):
            w = [x for x in re.split("[ \t]+", piece) if x]
            n[lang] += len(w)
            f.update((lang, *w[i : i + k]) for k in range(1, most + 1) for i in range(len(w) - k + 1))
    cand = {c: a for c, a in f.items() if len(c) > 2 and a >= least}
    inside = lambda c, l: any(l[1 + i : len(c) + i] == c[1:] for i in range(len(l) - len(c) + 1))
    out = defaultdict(list)
    for c, a in cand.items():
        if any(l[0] == c[0] and len(l) > len(c) and 100 * b >= percent * a and inside(c, l) for l, b in cand.items()):
            continue
        lang, w = c[0], c[1:]
        score, k = min((1000 * a * n[lang] // (f[(lang, *w[:k])] * f[(lang, *w[k:])]), k) for k in range(1, len(w)))
        out[lang].append((-score, -a, " ".join(w).encode(), f[(lang, *w[:k])], f[(lang, *w[k:])]))
    return {(lang, r, p.decode(), -a, left, right, n[lang], -s) for lang, found in out.items() for r, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1)}


@pytest.mark.parametrize(("least", "most", "top", "percent", "cells"), [(3, 5, 2000, 100, None), (3, 5, 7, 100, 16), (2, 3, 40, 60, 1 << 10), (300, 4, 10, 100, 1 << 17)])
def test_collocations(spark, least, most, top, percent, cells):
    rows = phrase_rows()
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    got = [tuple(r) for r in collocations.collocations(df, least, most, top, percent, cells).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_phrases(rows, least, most, top, percent)


def test_scores_beyond_64_bits(spark):
    text = " ".join(["new york"] * 4000) + " end " * 3000
    rows = [(1, text, "en", 1, "", "", 1, "")]
    got = {tuple(r) for r in collocations.collocations(spark.createDataFrame(rows, DOCS), 100, 2).collect()}
    assert got == brute_phrases(rows, 100, 2, 2000)
    big = spark.range(1).selectExpr("(cast(1000 as decimal(10,0)) * cast(cast(9000000000000 as decimal(19,0)) * cast(9000000000000 as decimal(19,0)) as decimal(28,0))) div cast(cast(9000000000 as decimal(19,0)) * cast(9000000000001 as decimal(19,0)) as decimal(38,0)) as x")
    assert big.first()["x"] == 1000 * 9000000000000**2 // (9000000000 * 9000000000001)


def test_pages_cost_in_proportion_to_their_length():
    import time

    def took(page):
        began = time.process_time()
        htmltext.vectors(htmltext.blocks(page))
        return time.process_time() - began

    took("<div>x" * 2000)
    for part, end in (("<div>x", ""), ("<div class=a><p>x<b>y", ""), ("<b>x", "</i>"), ("<i><div><i>x", "</i></p>")):
        assert took(part * 40000 + end * 40000) < 25 * max(took(part * 5000 + end * 5000), 0.02)
    deep = htmltext.blocks("<div>x" * 3000)
    assert len(deep) == 3000 and deep[-1].path == ("div",) * 3000 and deep[0].path == ("div",)


SAID = "The depot opened its second dock in the spring of that year. Crates were weighed by hand until the scale arrived. Nobody expected the lanes to fill so quickly."
MORE = [
    *SAID.split(". "), "Two clerks kept the books of the western lane", "Rain closed the yard for most of March", "A new crane came by rail in April", "The union asked for shorter shifts, and got them", "Prices fell again in the autumn", "Nobody remembers who painted the gate green", "The last ship left on a Tuesday",
]
LAYOUTS = [
    '<div class="hdr">Depot news</div><div class="x1"><a href="/a">home</a> <a href="/b">news</a> <a href="/c">about</a></div><div class="c2"><h1>The second dock</h1>{}</div><div class="z9">Copyright 2020 Depot</div>',
    '<body><div class="q1"><a href=x>home</a><a href=y>blog</a></div><section class="k7"><h2>Dock</h2>{}</section><div>&copy; 2021 All rights reserved</div>',
]


@pytest.mark.parametrize("layout", LAYOUTS)
@pytest.mark.parametrize("form", ["<div>{}</div>", "<span>{}</span><br>", "<p>{}</p>", "{}<br><br>"])
def test_articles_in_wrappers_that_tell_nothing(layout, form):
    """Most of an article is found although no name tells of it, and nothing else."""
    parts = [" ".join(MORE[k % len(MORE)].rstrip(".") + "." for k in range(i, i + 3)) for i in range(8)]
    text = htmltext.texts([layout.format("".join(form.format(x) for x in parts))], htmltext.trained())[0]
    assert sum(x in text for x in parts) >= 6 and not any(x in text for x in ("opyright", "reserved", "home", "blog"))


def test_layouts_held_out():
    pages = htmltext.generated(150, seed=404)
    wrong = sum(a != b for (_, want), got in zip(pages, htmltext.labelled([p for p, _ in pages], htmltext.trained())) for a, (_, b) in zip(want, got))
    assert wrong < 0.02 * sum(len(y) for _, y in pages)


@pytest.mark.skipif(not __import__("os").path.isdir("/root/testdata/sf0.01"), reason="the driver's tables are not here")
def test_pages_against_an_extraction_by_patterns(spark):
    """What stands between the tags of the article, without comments, scripts and foreign parts, by regular expressions alone."""
    import html

    from quern.llm.queries import op2_htmltext

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    got = {r["page_id"]: r["text"] for r in op2_htmltext(spark, "/root/testdata/sf0.01").collect()}
    for page, text in pages.items():
        inner = re.search(r"(?s)<article[^>]*>(.*)</article>", re.sub(r"(?s)<!--.*?-->|<(script|style)\b.*?</\1>", "", text))
        bare = re.sub(r"(?s)<(div|aside|section|form|nav|footer|ul|ol) class=\"?(?:ad|comments|related|share|promo)[^>]*>.*?</\1>", " ", inner[1] if inner else "")
        want = html.unescape(re.sub(r"</?(?:b|i|em|strong|a|span|u|s|code|small|mark)\b[^>]*>", "", re.sub(r"</?(?:p|h[1-6]|br|li|ul|ol|blockquote|div|table|tr|td|pre|figure|figcaption|hr)\b[^>]*>", " ", bare)))
        assert "".join(got[page].split()) == "".join(want.split()), (page, text)
