"""Small cases of the corpus operators that need no Spark."""

import hashlib
import re
import zlib

import numpy as np
import pytest

from quern.llm import common, htmltext, langid, media, neardup, pieces, pii, secrets, tokenfile, topk


def test_word_hashes_split_and_lower():
    a = common.word_hashes("Ab c\tAB  d\n".encode())
    assert len(a) == 4 and a[0] == a[2] and len(set(a.tolist())) == 3
    assert (common.word_hashes(b"ab", lower=False) != common.word_hashes(b"AB", lower=False)).all()
    assert len(common.word_hashes(b"")) == len(common.word_hashes(b" \n\x0b")) == 0


def test_word_hashes_do_not_depend_on_spans(monkeypatch):
    data = (b"x" * 50 + b" yy zz " + b"w" * 9) * 40
    whole = common.word_hashes(data)
    monkeypatch.setattr(common, "_SPAN", 16)
    common._POW.clear()
    cut = common.word_hashes(data)
    monkeypatch.undo()
    common._POW.clear()
    assert (whole == cut).all()


def test_shingles_of_short_texts():
    assert len(neardup.shingles(b"", 2)) == 0
    assert len(neardup.shingles(b" \t", 2)) == 0
    assert len(neardup.shingles(b"one", 2)) == 1
    assert len(neardup.shingles(b"a b a b", 2)) == 2


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 62, 3000).astype(np.uint64)
    for j in (0.3, 0.6, 0.8, 0.95):
        both = int(2000 * j / (1 + j))
        a, b = pool[:1000], np.concatenate((pool[:both], pool[1000 : 2000 - both]))
        ra, rb = (np.frombuffer(neardup.registers(x), np.uint8) for x in (a, b))
        got = neardup.estimate(np.array([(ra > rb).sum()], float), np.array([(ra < rb).sum()], float), np.array([1000.0]), np.array([1000.0]))[0]
        assert abs(got - j) < 4.5 * np.sqrt(0.25 / neardup.M)


def test_sketches_merge_by_the_larger_register():
    rng = np.random.default_rng(2)
    a, b = (rng.integers(0, 1 << 62, 500).astype(np.uint64) for _ in range(2))
    merged = np.maximum(*(np.frombuffer(neardup.registers(x), np.uint8) for x in (a, b)))
    assert merged.tobytes() == neardup.registers(np.concatenate((a, b)))


EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_base(text):
    out = [(m.start(), m.end(), 0) for m in EMAIL.finditer(text)]
    out += [(m.start(), m.end(), 1) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), m.end(), 2) for m in CARD.finditer(text) if 14 <= len(re.sub(r"\D", "", m[0])) <= 19 and pii.luhn(re.sub(r"\D", "", m[0]))]
    out += [(m.start(), m.end(), 3) for m in PHONE.finditer(text) if 10 <= len(re.sub(r"\D", "", m[0])) <= 15]
    return [(a, b, pii.KINDS[k]) for a, b, k in sorted(out, key=lambda x: (x[0], x[2], x[1]))]


def test_personal_base_spans_equal_plain_patterns():
    rng = np.random.default_rng(3)
    parts = ["a@b.c", "x.y@z", "@", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111111111111111", "+1 (555) 010-9999", "+", "é", " ", "-", "a%b@c-d.e.f", "12", "٣", "\n", "@@", "a@b.c@d.e", "0000001.2.3.4"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.integers(1, 9)))
        assert pii.base_spans(text) == plain_base(text), text


def test_addresses_with_parts_of_any_length():
    text = "0" * 5000 + "5.1.1.1 and 1.2.3." + "9" * 6000 + " x"
    assert pii.base_spans(text) == [(0, 5007, "ip")]
    many = "call " + "7," * 200_000 + " (212) 555-0199 ok"
    got = pii.find(many, pii.trained())[1]
    assert (len(many) - 17, len(many) - 3, "phone") in got


def test_field_adds_spans_and_keeps_base_ones():
    w = pii.trained()
    base, every = pii.find("write to joe [at] site [dot] org or a@b.com, call 555-867-5309 now", w)
    assert [x[2] for x in base] == ["email"] and set(base) <= set(every)
    assert {x[2] for x in every} == {"email", "phone"} and len(every) == 3
    assert pii.find("in 1999 we met 1,234,567 people on 2020-10-11", w)[1] == []
    assert pii.find(None, w) == pii.find("", w) == ([], [])
    assert pii.masked("mail a@b.com!", w) == "mail <EMAIL>!" and pii.masked(None, w) is None


def test_field_on_generated_snippets():
    w, hit, said, real = pii.trained(), 0, 0, 0
    for text, gold in pii.generated(300, seed=77):
        got = set(pii.find(text, w)[1])
        hit, said, real = hit + len(got & set(gold)), said + len(got), real + len(gold)
    assert hit / said > 0.95 and hit / real > 0.95


def test_personal_data_in_long_lists():
    w = pii.trained()
    for one in ("(415) 555-1234", "415-555-1234"):
        for sep in (", ", " ,  "):
            text, step = "call " + sep.join([one] * 40), len(one) + len(sep)
            assert pii.find(text, w)[1] == [(5 + k * step, 5 + k * step + len(one), "phone") for k in range(40)]
    assert pii.masked("server 8[.]8[.]8[.]8 and host 10[.]0[.]0[.]1 now", w) == "server <IP> and host <IP> now"
    assert pii.find("steps 1, 2, 3, 4 and 1-2-3-4 or 5 6 7 8", w)[1] == []


def plain_secrets(text):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    out = [(m.start(), m.end(), 0) for m in assign.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), m.end(), 1) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), m.end(), 2) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(a, b, secrets.KINDS[k]) for a, b, k in sorted(out, key=lambda x: (x[0], x[2], x[1]))]


def test_secret_base_spans_equal_plain_patterns():
    rng = np.random.default_rng(4)
    parts = ["token", "API_key", "apikey", " = ", ":", '"', "'", "abcdef", "AKIA", "ABCDEFGHIJKLMNOP", "0123456789abcdef", "f" * 24, "x", "PassWord", "secret", "é", "=", " "]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.integers(1, 9)))
        assert secrets.base_spans(text) == plain_secrets(text), text


def test_secret_field():
    f = secrets.trained()
    base, every = secrets.find("auth: Bearer ghp_" + "a1B2c3D4e5F6g7H8i9J0k1L2m3N4o5P6q7R8" + "\nsee https://host.com/path/123456.html", f)
    assert base == [] and [x[2] for x in every] == ["secret"]
    assert secrets.find("a plain line of prose with 2020 in it", f)[1] == [] and secrets.find(None, f) == ([], [])


def test_short_secrets_after_cues():
    f = secrets.trained()
    for head, value in (("pwd = ", "hunter2abc9"), ("Authorization: Bearer ", "abc123def456"), ("passphrase: ", "correct-horse-battery-staple")):
        text = f"some words here\n{head}{value}\nand more of them"
        at = text.index(value)
        assert secrets.find(text, f) == ([], [(at, at + len(value), "secret")])
    assert secrets.find("the key to the house gives access to every private room, note: we met at 10:30 in v2", f)[1] == []


@pytest.mark.parametrize("bits", [False, True])
@pytest.mark.parametrize("n", [0, 1, 7, 16384, 40001])
def test_planes_round_trip(bits, n):
    ids = np.random.default_rng(n).integers(0, 1 << 20, n).astype(np.uint32)
    chunk = tokenfile.pack(ids, bits)
    assert (tokenfile.unpack(chunk) == ids).all()
    if n > 16384:
        assert (tokenfile.unpack(chunk, only=1) == ids[16384 : 2 * 16384]).all()
    with pytest.raises(ValueError):
        tokenfile.unpack(b"none" + chunk)


ODD = ["", "a", " a", "a ", "  hi there\n\tx  y   z", "x\n a", "a  b", "日本語 😀", "a\0b c", "x \ny", "<|endoftext|> q", "I'm don't  12 ab1", "naïve ½ x²", " ", "　 x", "é a"]


def test_units_give_the_library_s_ids():
    from tokenizers import Tokenizer

    tok, mine = Tokenizer.from_file(tokenfile.default_tokenizer()), tokenfile.Tokens(tokenfile.default_tokenizer())
    for text, got in zip(ODD, mine.encode(ODD)):
        assert got.tolist() == tok.encode(text, add_special_tokens=False).ids, text


def test_pieces_without_dropout_are_the_library_s_and_decode():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    for rate in (0.0, 0.3):
        e = pieces.Encoder(pieces.default_model(), rate)
        texts = [*ODD, "▁x y", "the quick brown fox jumps over the lazy dog " * 9]
        for v in (0, 3):
            for text, ids in zip(texts, e.encode(texts, [v] * len(texts))):
                assert e.decode(ids) == text
                if not rate and "▁" not in text:
                    assert ids.tolist() == sp.encode(text), text


def test_rounds_equal_the_agenda_and_vary():
    p = pieces.Pieces(pieces.default_model())
    units = [" understanding", " internationalization", "  x", " éàü", " zzzz", " aaaaaaaa", " 漢字", " ."]
    seen = set()
    for v in range(4):
        ids, n = pieces.encode_units(units, p, 0.3, 7, v)
        ends = np.cumsum(n)
        for u, a, b in zip(units, ends - n, ends):
            assert ids[a:b].tolist() == pieces.agenda(u, p, 0.3, 7, v)
        seen.add(tuple(ids[: n[0]].tolist()))
    assert len(seen) > 1


def test_dropout_is_drawn_anew_at_each_occurrence():
    e, plain = pieces.Encoder(pieces.default_model(), 0.1), pieces.Encoder(pieces.default_model(), 0.0)
    text = "understanding " * 300
    got = [e.encode([text], [doc])[0] for doc in range(3)]
    assert len({g.tobytes() for g in got}) == 3 and all(e.decode(g) == text for g in got)
    assert (e.encode([text], [1])[0] == got[1]).all() and (pieces.Encoder(pieces.default_model(), 0.1).encode(["x y", text], [8, 1])[1] == got[1]).all()
    key = pieces.place_key(pieces.unit_key(pieces.coded([" understanding"] * 300), e.seed, 0), [1], np.array([300]))
    want, seen = [], set()
    for k in range(300):
        ids, _ = pieces.encode_units([" understanding"], e.p, 0.1, e.seed, 0, key[k : k + 1])
        want += ids.tolist()
        seen.add(tuple(ids.tolist()))
    assert got[1].tolist()[: len(want)] == want and len(seen) > 4
    assert plain.encode([text], [1])[0].tolist() == plain.encode([text], [2])[0].tolist()


def test_pictures_round_trip():
    for data in (b"", b"x", b"y" * 576, b"z" * 577):
        p = media.padded(data)
        assert len(p) % 576 == 0 and len(p) >= 576
        w, h, back = media.from_pgm(media.to_pgm(p))
        assert back == p and w * h == len(p) and back.rstrip(b"\xff") == data
    assert media.features(b"a" * 576, 24, 24) == media.features(b"a" * 576, 24, 24)


def test_items_keep_order_and_captions():
    page = "<p>one &amp; two</p>" + media.figure("d1", "first") + "tail <b>x</b><img src='media:sha256:d2' alt='alt2'><script>no</script><p>end"
    got = media.items(page)
    assert [(x["kind"], x["text"] or x["digest"], x["caption"]) for x in got] == [("text", "one & two", None), ("media", "d1", "first"), ("text", "tail x", None), ("media", "d2", "alt2"), ("text", "end", None)]
    assert [x["pos"] for x in got] == list(range(5)) and media.items(None) == media.items("") == []


def test_captions_and_sources_of_all_kinds():
    page = "<figure><figcaption>before</figcaption><img src='media:sha256:d1'><img src='https://a.org/x.png'></figure><p>t</p><figure><img src='data:text/plain;base64,aGk='><figcaption>after <b>it</b></figcaption></figure><img alt='z' src='data:,x%20y'><figure><img src='data:;base64,*'><figcaption>open"
    got = media.items(page)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert [(x["kind"], x["src"], x["digest"], x["caption"]) for x in got] == [
        ("media", "media:sha256:d1", "d1", "before"), ("media", "https://a.org/x.png", None, "before"), ("text", None, None, None), ("media", "data:text/plain;base64,aGk=", sha(b"hi"), "after it"), ("media", "data:,x%20y", sha(b"x y"), "z"), ("media", "data:;base64,*", None, "open"),
    ]
    assert media.items("<img src='data:," + "x" * 5000 + "'>")[0]["src"] is None


PAGE = """<html><head><title>T</title><style>p{}</style><script>var x="<p>no</p>";</script></head><body><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav>
<div class="ad">Buy these fine things now.</div><article><h1>A heading of the day</h1><p>First part &amp; more,
with   space and a good many words that make a paragraph.<p>Second <b>part</b> follows it closely.</p></article><div class="comments"><p>I like this.</p></div><footer>&copy; site</footer></body></html>"""


def test_main_text():
    net = htmltext.trained()
    want = "A heading of the day First part & more, with space and a good many words that make a paragraph. Second part follows it closely."
    assert htmltext.texts([PAGE, None, "", "<p>"], net) == [want, "", "", ""]


def test_labeller_on_held_out_layouts():
    net, ok, n = htmltext.trained(), 0, 0
    pages = htmltext.generated(120, seed=321)
    for (_, gold), got in zip(pages, htmltext.labelled([p for p, _ in pages], net)):
        ok, n = ok + sum(a == b for a, (_, b) in zip(gold, got)), n + len(gold)
    assert ok / n > 0.97


def test_every_word_of_a_block_counts():
    blocks = htmltext.blocks(f"<p>{'one ' * 30}cookie</p><p>{'one ' * 30}harbor</p>")
    a, b = (htmltext.vectors([x])[0, htmltext.PATHS : htmltext.PATHS + htmltext.WORDS] for x in blocks)
    assert (a != b).any()
    kinds = {w for page, _ in htmltext.generated(60) for w in re.sub("<[^>]*>", " ", page).split()}
    assert {"cookie", "subscribe", "reply"} <= kinds


def test_long_pages_are_labelled_in_the_context_of_the_whole():
    net = htmltext.Network(np.random.default_rng(5))
    rng = np.random.default_rng(6)
    seqs = [rng.normal(0, 1, (n, htmltext.WIDTH)).astype(np.float32) for n in (1, 700, 1024, 1500)]
    for x, got in zip(seqs, net.scores(seqs)):
        one, mask = htmltext.batched([x])
        both = np.concatenate((net.run(one, mask, "f", False)[0], net.run(one, mask, "b", False)[0]), axis=2)
        assert np.allclose((both @ net.p["o"])[:, 0, 0] + net.p["c"], got, atol=1e-4)
    net = htmltext.trained()
    page = "<article>" + "".join(f"<p>Some words of a story, number {k}.</p>" for k in range(1200)) + "</article>"
    seq = htmltext.vectors(htmltext.blocks(page))
    assert (np.abs(net.scores([seq])[0] - net.scores([seq], len(seq))[0]) < 1e-3).all()


def test_lstm_gradient():
    rng = np.random.default_rng(0)
    net = htmltext.Network(rng)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, mask = rng.normal(0, 1, (4, 3, htmltext.WIDTH)), np.ones((4, 3))
    mask[3, 1] = 0
    y = (rng.random((4, 3)) > 0.5).astype(float)
    _, grad = net.step(x, mask, y)
    for k, at in (("wf", (3, 5)), ("ub", (2, 7)), ("bf", (20,)), ("o", (4, 0))):
        old = net.p[k][at]
        loss = []
        for d in (1e-3, -1e-3):
            net.p[k][at] = old + d
            loss.append(net.step(x, mask, y)[0])
        net.p[k][at] = old
        assert abs((loss[0] - loss[1]) / 2e-3 - grad[k][at]) < 2e-3


def test_language_model_on_small_texts():
    r = np.random.default_rng(5)
    words = {"en": "the and of with this that from have were".split(), "de": "der und die nicht sich auch werden über".split(), "fr": "le la et les une dans pour être ça".split()}
    rows = [(" ".join(r.choice(words[y], 12)), y) for _ in range(80) for y in words]
    m = langid.train(rows)
    assert m.predict("Und die werden nicht über")[0] == "de" and m.predict("et les une")[0] == "fr"
    assert m.predict("") == m.predict(None) == m.predict("123 !? 4") == ("und", 0.0, False)
    assert langid.train([]).predict("text")[0] == "und"
    assert m.predict("\u0301\u0302 1")[0] == "und" and m.predict(chr(0x30010) * 5)[0] != "und"
    p = m.predict("the and of with")
    assert p[0] == "en" and 0 <= p[1] <= 1 and p[2]
    assert not m.predict("ждать больше нельзя")[2]


def test_pruned_search_equals_brute_force():
    rng = np.random.default_rng(6)
    x = rng.integers(-50, 50, (300, 24))
    axes = np.linalg.eigh((x.T @ x).astype(float))[1][:, ::-1]

    def block(ids):
        y = x[ids] @ axes
        return {"ids": np.array(ids, "<i8").tobytes(), "rows": np.array(ids, "<i8").tobytes(), "ints": x[ids].astype("<i8").tobytes(), "turned": y[:, : topk.LEAD].astype("<f8").tobytes(), "rest": np.sqrt((y[:, topk.LEAD :] ** 2).sum(1)).astype("<f8").tobytes(), "longest": float(np.sqrt((x[ids] ** 2).sum(1)).max())}

    q, c = list(range(7)), list(range(300))
    place, vec, score = topk.best_of(block(q), block(c), 24, 5, np.full(7, -np.inf))
    for i in q:
        want = sorted(((-int(x[i] @ x[j]), j) for j in c if j != i))[:5]
        assert [(-s, v) for p, v, s in zip(place, vec, score) if p == i] == want


def test_crc_of_ids_is_little_endian():
    assert zlib.crc32(np.array([1], "<u4").tobytes()) == zlib.crc32(b"\x01\0\0\0")


def test_components_stop_at_stars(spark, monkeypatch):
    """What is stars already takes no step; chains, rings and later edges between stars end in the least id."""
    from quern.llm import neardup

    steps = []
    monkeypatch.setattr(neardup, "released", lambda session: steps.append(1))
    edges = lambda rows: spark.createDataFrame(rows, "a long, b long")
    found = lambda df: {tuple(r) for r in df.collect()}
    stars = neardup.components(edges([(1, 2), (3, 1), (5, 6), (1, 2), (7, 7)]))
    assert found(stars) == {(1, 1), (2, 1), (3, 1), (5, 5), (6, 5)} and not steps
    assert found(neardup.components(neardup._stars(stars).unionByName(edges([(6, 3)])))) == {(k, 1) for k in (1, 2, 3, 5, 6)}
    assert found(neardup.components(edges([(k, k + 1) for k in range(20)] + [(40, 30), (30, 35), (35, 40)]))) == {(k, 0) for k in range(21)} | {(30, 30), (35, 30), (40, 30)}
    assert found(neardup.components(edges([]))) == set()
