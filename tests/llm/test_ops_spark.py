"""The corpus operators on odd tables: nulls, empty and long texts, ties, repeated rows, clashing names, no rows."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from quern.llm import htmltext, langid, media, mixing, neardup, pieces, pii, secrets, tokenfile, topk

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, own string, src string, rest string, ids string, bucket int"
WORDS = [f"w{k}" for k in range(60)]


def rows():
    rng = np.random.default_rng(1)
    base = [" ".join(rng.choice(WORDS, 120)) for _ in range(6)]
    texts = [None, "", " \t\n", "one", "One", "two words", *base, *base[:3]]
    for b in base[:3]:
        w = b.split()
        w[10] = "changed"
        texts.append(" ".join(w))
        w[60] = "again"
        texts.append("  " + "\n".join(w))
    texts.append(" ".join(rng.choice(WORDS, 5000)))
    texts += ["mail a@b.com or 1.2.3.4, token = abcdef12", "x" * 3000]
    out = [(k, t, "en", f"s{k % 4}" if k % 5 else None, len(t) if t is not None else None, 1, "o", "x", "r", "i", 0) for k, t in enumerate(texts)]
    return out + [out[7], out[1], (None, "a null id", None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS).repartition(3).persist()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def brute_components(pairs, width, percent):
    sets = defaultdict(set)
    for i, t in pairs:
        w = (t or "").encode().lower().split()
        if i is not None:
            sets[i] |= {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and sets[a] and sets[b] and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates(docs, width):
    got = neardup.near_duplicates(docs, width).collect()
    assert len(got) == docs.count()
    want = brute_components([(r[0], r[1]) for r in rows()], width, 80)
    for r in got:
        assert r["component_id"] == (want[r["doc_id"]] if r["doc_id"] is not None else None)
        assert r["kept"] == (r["component_id"] == r["doc_id"] if r["doc_id"] is not None else True)


def test_near_duplicates_of_a_large_chain(spark, monkeypatch):
    """A group of drifting copies, so large that its buckets are cut into many cells."""
    monkeypatch.setattr(neardup, "BLOCK", 8)
    rng = np.random.default_rng(3)
    base, texts = list(rng.choice(WORDS, 150)), []
    for _ in range(90):
        w = list(base)
        for at in rng.integers(0, 150, rng.integers(0, 14)):
            w[at] = f"z{rng.integers(0, 999)}"
        texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(df, 2).collect()}
    assert got == brute_components(list(enumerate(texts)), 2, 80)


def test_one_of_each(docs):
    kept = neardup.one_of_each(docs, 2).collect()
    ids = [r["doc_id"] for r in kept]
    want = {c for c in brute_components([(r[0], r[1]) for r in rows()], 2, 80).values()} | {None}
    assert sorted(ids, key=str) == sorted(want, key=str) and set(kept[0].asDict()) == set(docs.columns)


def test_one_of_each_keeps_every_row_without_an_id(spark):
    texts = ["first text of its own", "second and different words", "third one unlike both"]
    df = spark.createDataFrame([*[(None, t) for t in texts], (1, "a b c"), (1, "a b c"), (2, "d e f")], "doc_id long, text string")
    got = Counter(map(tuple, neardup.one_of_each(df).collect()))
    assert got == Counter([*[(None, t) for t in texts], (1, "a b c"), (2, "d e f")])


def test_mix(docs):
    got = mixing.mix(docs).collect()
    assert len(got) == docs.count()
    size = {r[0]: len((r[1] or "").encode().split()) for r in rows()}
    taken, targets, sizes = Counter(), {}, Counter()
    total = sum(r["size"] for r in got)
    for r in got:
        assert r["size"] == size[r["doc_id"]] and 0 <= r["taken"] <= 2 * r["size"]
        key = (r["source_size"], r["target"])
        taken[key] += r["taken"]
        targets[key] = r["target"]
    for key, n in taken.items():
        assert abs(n - targets[key]) <= 1
    assert abs(sum(taken.values()) - 1.5 * total) <= len(taken)
    again = mixing.mix(docs.repartition(5)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_mixed_texts_hold_the_words_that_are_taken(docs):
    took = Counter()
    for r in mixing.mix(docs).collect():
        took[r["doc_id"]] += r["taken"]
    out = mixing.mixed_texts(docs).collect()
    got = Counter()
    for r in out:
        got[r["doc_id"]] += len(r["text"].encode().split())
    assert +took == +got and set(out[0].asDict()) == set(docs.columns)
    whole = {r[0]: r[1] for r in rows()}
    for r in out:
        if r["n_chars"] is not None:
            assert r["n_chars"] == len(r["text"])
        if len(r["text"].split()) == len(whole[r["doc_id"]].split()):
            assert r["text"] == whole[r["doc_id"]]


def test_permutation_is_one(spark):
    df = spark.range(1000).selectExpr("id", "id div 100 as g")
    for n in (1, 2, 7, 100):
        key, size = mixing.F.lit(5).cast("long"), mixing.F.lit(n).cast("long")
        keys, back = mixing.round_keys(key, size), mixing.round_keys(key, size, inverse=True)
        x = df.filter(f"id < {n}").select("id", mixing.permuted(mixing.F.col("id"), size, keys).alias("p")).select("id", "p", mixing.permuted(mixing.F.col("p"), size, back).alias("b")).collect()
        assert sorted(r["p"] for r in x) == list(range(n)) and all(r["b"] == r["id"] for r in x)


def test_personal_and_secrets(docs):
    from tests.llm.test_ops_small import plain_base, plain_secrets

    whole = {r[0]: r[1] or "" for r in rows()}
    for r in pii.personal(docs).collect():
        base = plain_base(whole[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(pii.told(base).encode()).hexdigest() and r["n_email"] == sum(b[2] == "email" for b in base)
    for r in secrets.scanned(docs).collect():
        base = plain_secrets(whole[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(secrets.told(base).encode()).hexdigest() and set(secrets.told(base).split(",")) <= set(r["spans"].split(","))
    out = pii.without_personal(docs).collect()
    assert len(out) == docs.count() and set(out[0].asDict()) == set(docs.columns)
    for r in out:
        if "<" not in (r["text"] or ""):
            assert (r["text"] or "") == whole[r["doc_id"]]
    assert any("<EMAIL>" in (r["text"] or "") for r in out)


def test_tokens(docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenfile.default_tokenizer())
    order = sorted(((r[0] if r[0] is not None else -1, r[1] is not None, r[1] or "") for r in rows()))
    want, at = Counter(), 0
    for i, _, t in order:
        ids = [*tok.encode(t, add_special_tokens=False).ids, 0]
        want[(i if i >= 0 else None, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))] += 1
        at += len(ids)
    for bits in (False, True):
        assert Counter(map(tuple, tokenfile.stored_tokens(docs, bits=bits).collect())) == want


def test_pieces(docs):
    e = pieces.Encoder(pieces.default_model())
    out = pieces.encoded(docs, docs["doc_id"]).collect()
    whole = {r[0]: r[1] or "" for r in rows()}
    assert len(out) == docs.count()
    for r in out:
        assert r["decoded_sha256"] == hashlib.sha256(whole[r["doc_id"]].encode()).hexdigest() and e.decode(np.array(r["ids"], np.int32)) == whole[r["doc_id"]] and r["n_tokens"] == len(r["ids"])
        assert r["rest"] == ("r" if r["doc_id"] is not None else None)


def test_copies_in_the_pipeline_are_cut_differently(spark):
    import corpus_pipeline

    text = " ".join(WORDS * 30)
    rows = [(k, f"{text} {k}", f"s{k}") for k in range(3)]
    mixed = corpus_pipeline.mix_sources(spark, spark.createDataFrame(rows, "doc_id long, text string, source string"), "").persist()
    assert mixed.columns == ["doc_id", "text", "source"]
    twice = {i for i, n in Counter(r["doc_id"] for r in mixed.collect()).items() if n == 2}
    out = defaultdict(list)
    for r in corpus_pipeline.encode_pieces(spark, mixed, "").collect():
        out[r["doc_id"]].append(r["ids"])
    assert twice and all(out[k][0][:300] != out[k][1][:300] for k in twice)


CLASHING = ("_text", "_copy", "copy", "text_hash", "tie1", "tie2", "row", "_shard", "_place", "_pieces", "_whole", "_took", "_tie1", "size", "src", "off", "ids", "rest", "doc", "key", "label", "rep", "hub")


def test_stages_leave_columns_of_any_name_as_they_are(spark):
    """Every stage gives back further columns, whatever they are called; the last one's own results come first."""
    import corpus_pipeline

    rng = np.random.default_rng(12)
    said = {"en": "the and of with this that from have were they".split(), "de": "der und die nicht sich auch werden nach oder wird".split()}
    rows = [(k, " ".join(rng.choice(said[y], 50)), y, f"s{k % 3}", *[f"{c}{k}" for c in CLASHING]) for k in range(120) for y in [("en", "de")[k % 2]]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"`{c}` string" for c in CLASHING))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        own = {"ids", "n_tokens"} if name == "sentencepiece" else set()
        assert set(docs.columns) - {"text"} <= set(out.columns) and (own or out.columns == docs.columns)
        got = out.collect()
        assert got and all(r[c] == f"{c}{r['doc_id']}" for r in got for c in CLASHING if c not in own)


def test_shards_hold_the_counts_that_were_drawn(spark):
    rng = np.random.default_rng(4)
    rows = [(k, " ".join(rng.choice(WORDS, int(rng.integers(1, 90)))), f"s{k % 3}") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    _, sums, _ = mixing.sizes(docs)
    plan = mixing.sources(sums, block=8).persist()
    counts = {(r["src"], r["shard"]): r["n"] for r in mixing.drawn(plan, 8, 200).collect()}
    blocks = mixing.mixed_blocks(docs, 8, 200).collect()
    assert Counter(("s" + r["source"], r["shard"]) for r in blocks) == Counter(counts)
    shards = {s for _, s in counts}
    total = Counter()
    for (src, _), n in counts.items():
        total[src] += n
    assert len(shards) == -(-sum(total.values()) // 200) > 4
    for (src, _), n in counts.items():  # multinomial: within 5 standard deviations
        mean = total[src] / len(shards)
        assert abs(n - mean) < 5 * mean**0.5 + 1
    took = {("s" + r["source"]): 0 for r in blocks}
    for r in blocks:
        assert len(r["text"].split(" ")) == r["n_words"] <= 8
        took["s" + r["source"]] += r["n_words"]
    assert all(abs(took[r["src"]] - r["target"]) <= 1 for r in plan.collect())
    order = [(r["shard"], r["place"]) for r in sorted(blocks, key=lambda r: (r["shard"], r["place"]))]
    assert len(set(order)) == len(order)
    whole = {("s" + s): " ".join(t for k, t, z in rows if z == s).split() for s in ("s0", "s1", "s2")}
    for r in blocks:
        assert Counter(r["text"].split(" ")) <= Counter(whole["s" + r["source"]])


def test_pipeline_equals_its_stages_by_brute_force(spark, tmp_path):
    """Each stage on all that the one before it kept, against plain Python."""
    import corpus_pipeline

    rng = np.random.default_rng(2)
    said = {"en": "the and of with this that from have were they".split(), "de": "der und die nicht sich auch werden nach oder wird".split()}
    docs = []
    for k in range(160):
        y = ("en", "de")[k % 2]
        docs.append((k, " ".join(rng.choice(said[y], 60)) + (" write to a.b@c.org" if k % 7 == 0 else ""), y, f"s{k % 3}"))
    docs += [(200, docs[0][1], "en", "s1"), (201, docs[1][1] + " und", "de", "s2"), (202, "12 34 !!", "en", "s0"), (203, None, "en", "s0"), (204, "", None, None)]
    docs = [(i, t, y, s, len(t) if t is not None else None) for i, t, y, s in docs]
    table = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    table.write.parquet(f"file://{tmp_path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    model = langid.fitted(table)
    one = stages["language"](spark, table, "").collect()
    assert sorted(map(tuple, one)) == sorted(d for d in docs if model.predict(d[1])[2])
    assert {r["doc_id"] for r in one} >= set(range(160)) and not {202, 203, 204} & {r["doc_id"] for r in one}
    near = brute_components([(r["doc_id"], r["text"]) for r in one], 5, 80)
    two = stages["near_duplicates"](spark, spark.createDataFrame(one, table.schema), "").collect()
    assert sorted(map(tuple, two)) == sorted(tuple(r) for r in one if near[r["doc_id"]] == r["doc_id"]) and 200 not in near.values()
    weights = pii.trained()
    three = stages["personal_data"](spark, spark.createDataFrame(two, table.schema), "").collect()
    for a, b in zip(sorted(two), sorted(three)):
        text = pii.masked(a["text"], weights)
        assert tuple(b) == (a["doc_id"], text, a["lang"], a["source"], len(text)) and "@" not in text
    before = spark.createDataFrame(three, table.schema).persist()
    took = {r["doc_id"]: r["taken"] for r in mixing.mix(before).collect()}
    four = stages["mix"](spark, before, "").collect()
    words = Counter()
    for r in four:
        words[r["doc_id"]] += len(r["text"].split())
    assert +words == +Counter(took)
    out = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()
    assert Counter((r["doc_id"], r["decoded_sha256"]) for r in out) == Counter((r["doc_id"], hashlib.sha256(r["text"].encode()).hexdigest()) for r in four)
    e = pieces.Encoder(pieces.default_model())
    by_hash = {hashlib.sha256(r["text"].encode()).hexdigest(): r["text"] for r in four}
    assert all(e.decode(np.array(r["ids"], np.int32)) == by_hash[r["decoded_sha256"]] for r in out) and "text" not in out[0].asDict()


def test_media(docs):
    whole = {r[0]: (r[1] or "").encode() for r in rows()}
    out = media.media_columns(docs).collect()
    assert len(out) == docs.count()
    for r in out:
        p = media.padded(whole[r["doc_id"]])
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(whole[r["doc_id"]]), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))


def test_resolved_sequences_keep_places(spark):
    pages = spark.createDataFrame([(1, "<p>a</p>" + media.figure("d1", "c1") + media.figure("gone", "c2") + "z"), (2, None)], "page_id long, html string")
    store = spark.createDataFrame([("d1", 5)], "digest string, media_bytes long")
    got = {r["id"]: r["items"] for r in media.resolved(media.sequences(pages, "page_id", "html"), store).collect()}
    assert [(x["pos"], x["kind"], x["caption"], x["media_bytes"]) for x in got[1]] == [(0, "text", None, None), (1, "media", "c1", 5), (2, "media", "c2", None), (3, "text", None, None)]
    assert got[2] == []


def brute_top(vecs, k=10):
    good = [(i, [max(-(2**62), min(2**62, int(np.floor(1024.0 * v)) if abs(v) < 1e300 else int(np.sign(v)) * 2**62)) for v in x]) for i, x, *_ in vecs if i is not None and x is not None and None not in x and np.isfinite(x).all()]
    clamp = lambda v: max(-(2**63), min(2**63 - 1, v))
    want = Counter()
    for n, (i, x) in enumerate(good):
        if i % 100 == 0:
            best = sorted((-clamp(sum(a * b for a, b in zip(x, y))), j) for m, (j, y) in enumerate(good) if m != n)[:k]
            want.update((i, r + 1, j, -s) for r, (s, j) in enumerate(best))
    return want


def test_top_k(spark):
    rng = np.random.default_rng(8)
    vecs = [(int(i), [float(x) for x in rng.normal(0, 0.2 + i % 3, 20)], 0) for i in range(400)]
    vecs += [(401, None, 0), (402, [1.0, None], 0), (403, [float("nan")] * 20, 0), (404, [], 0), (405, [float("inf")] * 20, 0), (406, vecs[5][1], 0), (407, vecs[5][1], 0), (None, vecs[1][1], 0), (500, [0.5] * 8, 0), (600, [0.0] * 20, 0)]
    vecs += [vecs[100], vecs[100], vecs[7], (700, [], 0)]
    for more in ([], [(800, [1e306, -3.0], 0), (801, [5e15] * 20, 0), (900, [1e17] * 3, 0)]):
        df = spark.createDataFrame(vecs + more, "vec_id long, embedding array<double>, label int").repartition(3)
        got = Counter(map(tuple, topk.search(df, mixing.F.col("vec_id") % 100 == 0).collect()))
        assert got == brute_top(vecs + more)


def test_split_joins_equal_plain_ones(spark, monkeypatch):
    from quern.llm import common

    monkeypatch.setattr(common, "SPLIT", 4)
    many = spark.createDataFrame([(k % 3 if k % 7 else None, k) for k in range(60)] + [(9, 99)], "k int, v int")
    one = spark.createDataFrame([(0, "a"), (1, "b"), (5, "c")], "k int, w string")
    for how in ("inner", "left"):
        for most in (100, 1):
            monkeypatch.setattr(common, "HOT", most)
            assert Counter(map(tuple, common.split_join(many, one, "k", [mixing.F.col("v")], how).select("k", "v", "w").collect())) == Counter(map(tuple, many.join(one, "k", how).select("k", "v", "w").collect()))


def test_top_k_over_many_blocks_and_partitions(spark, monkeypatch):
    monkeypatch.setattr(topk, "ROWS", 16)
    monkeypatch.setattr(topk, "QUERIES", 4)
    monkeypatch.setattr(topk, "MEETINGS", 2)
    rng = np.random.default_rng(9)
    vecs = [(int(i) * 10, [float(x) for x in rng.normal(0, 0.1 + (i % 17) ** 2, 12)], 0) for i in rng.permutation(260)] + [(0, [1.0] * 12, 0)] * 3
    df = spark.createDataFrame(vecs, "vec_id long, embedding array<double>, label int").repartition(7)
    assert Counter(map(tuple, topk.search(df, mixing.F.col("vec_id") % 100 == 0).collect())) == brute_top(vecs)


def test_languages(docs):
    got = langid.identify(docs, langid.fitted(docs)).collect()
    assert len(got) == docs.count()
    for r in got:
        text = dict((x[0], x[1]) for x in rows())[r["doc_id"]]
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in text or "")) and 0 <= r["score"] <= 1


def test_pages(spark):
    df = spark.createDataFrame([(1, "u", "<article><p>Some words here.</p></article>", 1), (2, None, None, 2), (3, "v", "", 3)], "page_id long, url string, html string, text int")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in htmltext.main_text(df).collect()}
    assert got[2] == got[3] == ("", 0) and got[1][1] == len(got[1][0])


def test_no_rows(spark, none):
    assert neardup.near_duplicates(none).count() == 0 and neardup.one_of_each(none).count() == 0
    assert mixing.mix(none).count() == 0 and mixing.mixed_texts(none).count() == 0
    assert pii.personal(none).count() == 0 and secrets.scanned(none).count() == 0 and tokenfile.stored_tokens(none).count() == 0
    assert pieces.encoded(none, none["doc_id"]).count() == 0 and media.media_columns(none).count() == 0
    assert langid.identify(none, langid.fitted(none)).count() == 0
    assert topk.search(spark.createDataFrame([], "vec_id long, embedding array<double>"), mixing.F.col("vec_id") % 100 == 0).count() == 0
    assert htmltext.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not __import__("os").path.isdir(DATA), reason="the driver's tables are not here")
def test_languages_of_rows_held_out(spark):
    from quern.llm.queries import op1_langid

    lang = {r["doc_id"]: (r["lang"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = op1_langid(spark, DATA).collect()
    assert len(got) == len(lang) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    judged = [r for r in got if r["held_out"] and lang[r["doc_id"]][0] is not None and r["lang_pred"] != "und"]
    assert sum(r["lang_pred"] == lang[r["doc_id"]][0] for r in judged) >= 0.97 * len(judged) > 0


@pytest.mark.skipif(not __import__("os").path.isdir(DATA), reason="the driver's tables are not here")
def test_pages_of_the_table(spark):
    """Every page's text is that of its article's blocks; menus, adverts and footers stay out."""
    from quern.llm.queries import op2_htmltext

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    got = {r["page_id"]: r for r in op2_htmltext(spark, DATA).collect()}
    assert set(got) == set(pages)
    for page, html in pages.items():
        blocks = htmltext.blocks(html)
        want = " ".join(b.text for b in blocks if "article" in b.path and "comments" not in b.path)
        assert got[page]["text"] == want and got[page]["n_chars"] == len(want)
