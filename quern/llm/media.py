"""Media columns: interleaved sequences of text and media references, resolved by digest.

A page is parsed into an ordered list of items: text, or a reference to a medium by its source and the sha256 of its
stored form, with its caption. The digest is in the source of pages made here, and that of the bytes of a data URI;
media elsewhere keep their source alone. Media lie in a store, a table in the shared folder of digest and stored bytes.
References and media meet in a join on the digest; each item keeps its position, so captions and texts stay with their
media. A digest with many references is split over several tasks, and its medium with it.

Here the media are grey pictures in the PGM format: WIDTH x rows of 8-bit samples after a short header. A payload of
any bytes is padded with bytes 255 to a positive multiple of TILE, which no UTF-8 text ends with, so reading back
also tells the unpadded length. Stored bytes are read back before features are computed. Within a task each medium is
stored once; the same medium from several tasks is stored as often at most, and its features are joined once.

Defined cases: null text counts as empty (one tile of padding); equal texts have equal media; a reference whose medium
is not in the store keeps its place with null payload columns; broken markup is read as far as it goes; an empty table
gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import html
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import unquote_to_bytes

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import arrow, map_rows, shared_dir, slices, split_join

WIDTH, TILE = 24, 576
#: Digests that a task remembers, so as not to store a medium twice.
MEMORY = 200_000
SCHEME = "media:sha256:"
#: Characters of a source that an item keeps; a longer one, such as a data URI, is known by its digest.
LONGEST_SRC = 2048
ITEM = "struct<pos:int,kind:string,text:string,src:string,digest:string,caption:string>"


def padded(data: bytes) -> bytes:
    return data + b"\xff" * (max(TILE, -(-len(data) // TILE) * TILE) - len(data))


def to_pgm(payload: bytes) -> bytes:
    return b"P5\n%d %d\n255\n" % (WIDTH, len(payload) // WIDTH) + payload


def from_pgm(stored: bytes) -> tuple[int, int, bytes]:
    """Width, height and samples of a PGM picture."""
    kind, size, most, samples = stored.split(b"\n", 3)
    width, height = map(int, size.split())
    if kind != b"P5" or most != b"255" or len(samples) != width * height:
        raise ValueError("not an 8-bit PGM picture")
    return width, height, samples


def features(samples: bytes, width: int, height: int) -> str:
    """Size, mean, spread, a histogram of 16 levels and a hash of which bands lie above the mean."""
    x = np.frombuffer(samples, dtype=np.uint8)
    counts = np.bincount(x >> 4, minlength=16)
    mean = float(x.mean(dtype=np.float64))
    bands = [float(b.mean(dtype=np.float64)) for b in np.array_split(x, 32)]
    bits = sum(1 << k for k, b in enumerate(bands) if b > mean)
    return f"{width}x{height};mean={mean:.4f};std={float(x.std(dtype=np.float64)):.4f};levels={','.join(map(str, counts))};bands={bits:08x}"


def figure(digest: str, caption: str, text: str = "") -> str:
    """Markup of a paragraph and a figure that refers to a medium."""
    lead = f"<p>{html.escape(text)}</p>" if text else ""
    return f'{lead}<figure><img src="{SCHEME}{digest}"><figcaption>{html.escape(caption)}</figcaption></figure>'


def data_bytes(src: str) -> bytes | None:
    """The bytes of a data URI, or null."""
    head, comma, body = src.partition(",")
    if not comma or not head.startswith("data:"):
        return None
    try:
        return base64.b64decode(unquote_to_bytes(body), validate=True) if head.endswith(";base64") else unquote_to_bytes(body)
    except ValueError:
        return None


def digest_of(src: str) -> str | None:
    if src.startswith(SCHEME):
        return src[len(SCHEME) :]
    data = data_bytes(src)
    return None if data is None else hashlib.sha256(data).hexdigest()


_MEDIA = ("img", "video", "audio", "source")
_BLOCKS = ("p", "div", "section", "article", "li", "h1", "h2", "h3", "h4", "br", "table", "tr", "ul", "ol", "blockquote", "pre")


class _Items(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.run: list[str] = []
        self.caption: list[str] | None = None
        self.figures: list[dict] = []  # open ones: their media and their caption, whichever comes first
        self.skip = 0

    def flush(self) -> None:
        text = " ".join("".join(self.run).split())
        if text:
            self.items.append({"kind": "text", "text": text, "src": None, "digest": None, "caption": None})
        self.run = []

    def captioned(self) -> None:
        """Ends a caption and, with the figure, gives it to the figure's media."""
        if self.caption is not None and self.figures:
            self.figures[-1]["caption"] = " ".join("".join(self.caption).split()) or None
        self.caption = None

    def ended(self) -> None:
        self.captioned()
        figure = self.figures.pop()
        for item in figure["media"]:
            item["caption"] = figure["caption"] or item["caption"]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ("script", "style"):
            self.skip += 1
        elif tag == "figcaption":
            self.flush()
            self.caption = []
        elif tag == "figure":
            self.flush()
            self.figures.append({"media": [], "caption": None})
        elif tag in _MEDIA:
            src = (dict(attrs).get("src") or "").strip()
            if src:
                self.flush()
                item = {"kind": "media", "text": None, "src": src if len(src) <= LONGEST_SRC else None, "digest": digest_of(src), "caption": dict(attrs).get("alt")}
                self.items.append(item)
                if self.figures:
                    self.figures[-1]["media"].append(item)
        elif tag in _BLOCKS and self.caption is None:
            self.flush()

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        elif tag == "figcaption":
            self.captioned()
        elif tag == "figure" and self.figures:
            self.ended()
        elif tag in _BLOCKS and self.caption is None:
            self.flush()

    def handle_data(self, data: str) -> None:
        if not self.skip:
            (self.run if self.caption is None else self.caption).append(data)


def items(page: str | None) -> list[dict]:
    """The ordered items of a page, with their positions from 0."""
    if not page:
        return []
    parser = _Items()
    parser.feed(page)
    parser.close()
    while parser.figures:
        parser.ended()
    parser.flush()
    return [{"pos": k, **x} for k, x in enumerate(parser.items)]


def sequences(pages: DataFrame, id: str, html_column: str) -> DataFrame:
    """id and items (ordered texts and media references) of every page."""

    def run(part: pa.RecordBatch) -> dict:
        return {"id": part.column("id"), "items": pa.array([items(x) for x in part.column("html").to_pylist()], _ITEMS)}

    kind = pages.schema[id].dataType.simpleString()
    return map_rows(pages.select(F.col(id).alias("id"), F.col(html_column).cast("string").alias("html")), run, f"id {kind}, items array<{ITEM}>", text="html")


_ITEMS = pa.list_(pa.struct([("pos", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("src", pa.string()), ("digest", pa.string()), ("caption", pa.string())]))


def resolved_items(seqs: DataFrame, media: DataFrame) -> DataFrame:
    """id, pos, kind, text, src, digest and caption of every item, and the columns of media (a row for each digest) where it has one."""
    each = seqs.select("id", F.explode_outer("items").alias("item")).select("id", "item.*")
    return split_join(each, media, "digest", [F.col("id"), F.col("pos")], "left")


def resolved(seqs: DataFrame, media: DataFrame) -> DataFrame:
    """id and items in order, each item with the columns of media next to its own."""
    each = resolved_items(seqs, media)
    cols = ["pos", *[c for c in each.columns if c not in ("id", "pos")]]
    whole = each.groupBy("id").agg(F.sort_array(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct(*cols)))).alias("items"))
    return whole


def text_figures(docs: DataFrame) -> DataFrame:
    """doc_id and page: for every text, markup that refers to the picture of its bytes."""

    def run(part: pa.RecordBatch) -> dict:
        pages = []
        for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").cast(pa.binary()).to_pylist()):
            stored = to_pgm(padded(text or b""))
            pages.append(figure(hashlib.sha256(stored).hexdigest(), f"document {doc_id}", f"{len(text or b'')} bytes"))
        return {"doc_id": part.column("doc_id"), "page": pages}

    return map_rows(_texts(docs), run, "doc_id long, page string", text="text")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def store_texts(docs: DataFrame, name: str = "media") -> DataFrame:
    """The store of the pictures of all texts, written to the shared folder: digest and stored bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for part in slices(batches, "text"):
            digests, media = [], []
            for text in part.column("text").cast(pa.binary()).to_pylist():
                stored = to_pgm(padded(text or b""))
                h = hashlib.sha256(stored)
                if h.digest() not in seen:
                    if len(seen) < MEMORY:
                        seen.add(h.digest())
                    digests.append(h.hexdigest())
                    media.append(stored)
            yield pa.RecordBatch.from_pydict({"digest": pa.array(digests, pa.string()), "stored": pa.array(media, pa.binary())})

    import uuid

    spark = docs.sparkSession
    at = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    arrow(_texts(docs), run, "digest string, stored binary").write.option("compression", "zstd").parquet(at)
    return spark.read.parquet(at)


FEATURES = "digest string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def read_media(store: DataFrame) -> DataFrame:
    """A row of features for each digest of the store, from the stored bytes read back."""

    def run(part: pa.RecordBatch) -> dict:
        out: dict[str, list] = {k.split()[0]: [] for k in FEATURES.split(", ")}
        for stored in part.column("stored").to_pylist():
            width, height, payload = from_pgm(stored)
            own = hashlib.sha256(stored).hexdigest()
            row = (own, len(payload.rstrip(b"\xff")), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(stored), own, features(payload, width, height))
            for k, v in zip(out, row):
                out[k].append(v)
        return out

    rows = map_rows(store.select("stored"), run, FEATURES, text="stored")
    names = rows.columns[1:]
    return rows.groupBy("digest").agg(*[F.first(c).alias(c) for c in names])


def media_columns(docs: DataFrame) -> DataFrame:
    """doc_id and the features of the picture of its text, for every row of docs."""
    seqs = sequences(text_figures(docs), "doc_id", "page")
    got = resolved_items(seqs, read_media(store_texts(docs))).filter("kind = 'media'")
    return got.select(F.col("id").alias("doc_id"), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "caption")
