"""Token ids in binary chunks by plane shuffling.

A chunk holds the ids of whole documents, cut into blocks of BLOCK ids. A block is a matrix of ids by bytes (or bits);
transposed, each byte (or bit) position becomes a plane of its own, and each plane is compressed by zstandard. The
high planes hardly vary, so they shrink to next to nothing. A chunk begins with an index: the number of ids of each
block and the length of each of its planes, so one block can be read alone. Chunks are rows of a Parquet table in the
shared folder, next to the ids and lengths of their documents: Spark writes them and commits each task's once.

Documents are dealt to shards by ranges of doc_id and written in ascending order; a shard's chunks know the ids before
them in it, and a small table of sums by shard gives the rest, so no task sees more than its own shard.

Defined cases: null or empty text has the end id alone; a null doc_id comes first; rows that repeat a doc_id stand
next to each other, ordered by text; a text of any length is encoded whole (its chunk then has more blocks); an empty
table gives no rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import arrow, map_rows, slices, written
from quern.llm.pieces import gather

MAGIC, BLOCK, CHUNK, LEVEL, END_ID = b"QPL1", 16384, 65536, 1, 0
#: Characters of parts that a worker remembers, and 8 more for each.
MEMORY = 10_000_000
#: New parts that are looked at together.
TOGETHER = 20_000
#: What the cuts do not fit: white space (of Unicode) on both sides of a place, but for two line breaks before other
#: characters; or what may open a special token. In the syntax of Arrow's expressions.
_WHITE = r"\x09-\x0d\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_DIRTY = rf"[{_WHITE}\x20]\x20|[\x20\x09\x0b-\x0d\x1c-\x1f\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{3000}}]\n|\n[\x09\x0b-\x0d\x1c-\x1f\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{3000}}]|\n\n\n|\n\n\z|<\|"
#: A line break, letters that every version of Unicode counts as such, and marks.
_PLAIN = r"^(?P<n>\n?)(?P<a>[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}\x{400}-\x{481}\x{5d0}-\x{5ea}\x{3041}-\x{3096}\x{4e00}-\x{9fa5}\x{ac00}-\x{d7a3}]*)(?P<b>[!-/:-@\[-`{-~]*)$"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pack(ids: np.ndarray, bits: bool = False, block: int = BLOCK) -> bytes:
    """A chunk: MAGIC, bits or bytes, numbers of ids and blocks; the index; the planes."""
    press = zstandard.ZstdCompressor(level=LEVEL)
    ids = np.ascontiguousarray(ids, dtype="<u4")
    index, planes = [], []
    for at in range(0, len(ids), block):
        part = ids[at : at + block]
        rows = part.view(np.uint8).reshape(len(part), 4)
        if bits:
            rows = np.unpackbits(rows, axis=1, bitorder="little")
        each = []
        for k in range(rows.shape[1]):
            plane = np.ascontiguousarray(rows[:, k])
            data = b"" if not plane.any() else press.compress(np.packbits(plane, bitorder="little").tobytes() if bits else plane.tobytes())
            each.append(len(data))
            planes.append(data)
        index.append(struct.pack(f"<I{len(each)}I", len(part), *each))
    return b"".join((MAGIC, struct.pack("<BQI", bits, len(ids), len(index)), *index, *planes))


def block_index(chunk: bytes) -> tuple[bool, list[tuple[int, list[int], int]]]:
    """Whether planes are of bits, and for each block: number of ids, lengths of planes, where they begin."""
    if chunk[:4] != MAGIC:
        raise ValueError("not a chunk of planes")
    bits, _, blocks = struct.unpack_from("<BQI", chunk, 4)
    width, at, out = 32 if bits else 4, 17, []
    data = at + blocks * 4 * (width + 1)
    for _ in range(blocks):
        n, *lens = struct.unpack_from(f"<{width + 1}I", chunk, at)
        out.append((n, lens, data))
        at, data = at + 4 * (width + 1), data + sum(lens)
    return bool(bits), out


def unpack(chunk: bytes, only: int | None = None) -> np.ndarray:
    """The ids of a chunk, or of one block of it."""
    bits, blocks = block_index(chunk)
    press, out = zstandard.ZstdDecompressor(), []
    for n, lens, at in blocks if only is None else [blocks[only]]:
        rows = np.zeros((n, 32 if bits else 4), dtype=np.uint8)
        for k, size in enumerate(lens):
            if size:
                plane = np.frombuffer(press.decompress(chunk[at : at + size]), dtype=np.uint8)
                rows[:, k] = np.unpackbits(plane, bitorder="little")[:n] if bits else plane
                at += size
        if bits:
            rows = np.packbits(rows, axis=1, bitorder="little")
        out.append(np.ascontiguousarray(rows).view("<u4").ravel())
    return np.concatenate(out) if out else np.zeros(0, dtype="<u4")


class Tokens:
    """Ids of texts by the tokenizers library.

    For a byte-level model that splits by its usual pattern, a text is cut at single spaces and before line breaks: the
    pattern never reaches over such a place. The units between are numbered by Arrow, all texts of a slice at once;
    those of a line break or a space, letters, and marks behind them are parted as the pattern parts them, and each
    part goes through the library's model once and is kept. Other units go through its splitter first. Texts with
    other runs of white space, or with what may be a special token, go through the library as a whole, as do all texts
    for any other kind of tokenizer.
    """

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        plain = not spec.get("normalizer") and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        known = [t["content"] for t in spec.get("added_tokens", [])]
        self.by_unit = plain and all(t.startswith("<|") for t in known) and not (spec.get("truncation") or spec.get("padding"))
        direct = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(direct)]
        self.table = {b: chr(b) for b in direct} | {b: chr(256 + k) for k, b in enumerate(rest)}
        self.clear()

    def clear(self) -> None:
        """Forgets all parts; number 0 is that of the empty one."""
        self.spaced, self.bare, self.units = {"": 0}, {"": 0}, {"": 0}
        self.flat, self.lens, self.held = np.zeros(0, np.uint32), np.zeros(1, np.int64), 0

    def part(self, p: str) -> list:
        """Tokens of a part that the pattern leaves whole."""
        return self.tok.model.tokenize(p.encode().decode("latin-1").translate(self.table))

    def spaced_part(self, p: str) -> list:
        return self.tok.model.tokenize("\u0120" + p) if p.isascii() else self.part(" " + p)

    def unit(self, u: str) -> list:
        """Tokens of any unit."""
        return [t for s, _ in self.tok.pre_tokenizer.pre_tokenize_str(u) for t in self.tok.model.tokenize(s)]

    def numbers(self, known: dict[str, int], parts: list[str], tokens: Callable[[str], list]) -> np.ndarray:
        """The numbers of parts among those known; new ones get theirs, and their ids from tokens."""
        get = known.get
        out = np.array([get(p, -1) for p in parts], dtype=np.int64)
        at = np.flatnonzero(out < 0)
        for k in range(0, len(at), TOGETHER):
            some = at[k : k + TOGETHER]
            new = [parts[j] for j in some.tolist()]
            made, first = [tokens(p) for p in new], len(self.lens)
            out[some] = np.arange(first, first + len(new))
            known.update(zip(new, range(first, first + len(new))))
            self.held += sum(map(len, new)) + 8 * len(new)
            self.lens = np.append(self.lens, list(map(len, made)))
            self.flat = np.append(self.flat, np.array([t.id for ts in made for t in ts], dtype=np.uint32))
        return out

    def parted(self, units: pa.Array) -> np.ndarray:
        """The numbers of the three parts of each unit (a space goes before those without a line break in front)."""
        cut = pc.extract_regex(units, _PLAIN)
        lines, words, marks = (pc.fill_null(pc.struct_field(cut, k), "") for k in ("n", "a", "b"))
        breaks = pc.not_equal(lines, "").to_numpy(zero_copy_only=False)
        empty = pc.equal(words, "").to_numpy(zero_copy_only=False)
        odd = cut.is_null().to_numpy(zero_copy_only=False) | ~breaks & empty  # a space goes with the marks then
        out = np.zeros((len(units), 3), dtype=np.int64)
        out[breaks, 0] = self.numbers(self.bare, ["\n"], self.part)
        for k, which, known, tokens, column in ((1, ~odd & ~breaks, self.spaced, self.spaced_part, words), (1, ~odd & breaks, self.bare, self.part, words), (2, ~odd, self.bare, self.part, marks)):
            if which.any():
                each = column.filter(pa.array(which)).dictionary_encode()
                out[which, k] = self.numbers(known, each.dictionary.to_pylist(), tokens)[each.indices.to_numpy()]
        at = np.flatnonzero(odd)
        if len(at):
            rest = [u if u[:1] == "\n" else " " + u for u in units.take(pa.array(at)).to_pylist()]
            out[at] = 0
            out[at, 0] = self.numbers(self.units, rest, self.unit)
        return out

    def encode(self, texts: pa.Array | list[str]) -> list[np.ndarray]:
        """Ids of each text, as uint32; null counts as empty."""
        if self.held > MEMORY:
            self.clear()
        texts = pc.fill_null(pa.array(texts, pa.string()) if isinstance(texts, list) else texts, "")
        whole = pc.match_substring_regex(texts, _DIRTY).to_numpy(zero_copy_only=False) if self.by_unit else np.ones(len(texts), dtype=bool)
        out: list[np.ndarray | None] = [None] * len(texts)
        for k in np.flatnonzero(whole).tolist():
            out[k] = np.array(self.tok.encode(texts[k].as_py(), add_special_tokens=False).ids, dtype=np.uint32)
        clean = np.flatnonzero(~whole)
        if len(clean):
            lists = pc.split_pattern(pc.replace_substring(texts.take(pa.array(clean)), "\n", " \n"), " ")
            ends = lists.offsets.to_numpy()[1:].astype(np.int64)
            cut = lists.flatten()
            coded = cut.dictionary_encode()
            first = np.concatenate(([0], ends[:-1]))
            at = self.parted(coded.dictionary)[coded.indices.to_numpy()]
            at[first] = 0
            at[first, 0] = self.numbers(self.units, cut.take(pa.array(first)).to_pylist(), self.unit)
            lens = self.lens[at.ravel()]
            ids = gather(self.flat, (np.cumsum(self.lens) - self.lens)[at.ravel()], lens)
            to = np.cumsum(lens)[3 * ends - 1].tolist()
            for k, a, b in zip(clean.tolist(), [0, *to[:-1]], to):
                out[k] = ids[a:b]
        return out


_TOKENS: dict[str, Tokens] = {}


def _tokens(path: str) -> Tokens:
    """The worker's tokenizer, which serves all its tasks."""
    if path not in _TOKENS:
        _TOKENS[path] = Tokens(path)
    return _TOKENS[path]


CHUNKS = "shard int, chunk long, ids_before long, n_ids long, doc_ids array<long>, lengths array<long>, data binary"


def chunks(docs: DataFrame, path: str | None = None, bits: bool = False) -> DataFrame:
    """The chunk rows of docs (doc_id, text) in ascending order: shards in order, and chunks in order in a shard."""
    path = path or default_tokenizer()
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).repartitionByRange(F.col("doc_id")).sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, number, before = TaskContext.get().partitionId(), 0, 0
        names: list = []
        ids: list[np.ndarray] = []
        held = 0

        def chunk() -> pa.RecordBatch:
            data = pack(np.concatenate(ids), bits)
            return pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "chunk": [number], "ids_before": [before], "n_ids": [held], "doc_ids": pa.array([names], pa.list_(pa.int64())), "lengths": pa.array([[len(x) for x in ids]], pa.list_(pa.int64())), "data": pa.array([data], pa.binary())})

        for part in slices(batches, "text"):
            got = _tokens(path).encode(part.column("text"))
            for name, one in zip(part.column("doc_id").to_pylist(), got):
                names.append(name)
                ids.append(np.append(one, np.uint32(END_ID)).astype(np.uint32))
                held += len(one) + 1
                if held >= CHUNK:
                    yield chunk()
                    number, before, names, ids, held = number + 1, before + held, [], [], 0
        if ids:
            yield chunk()

    return arrow(dealt, run, CHUNKS)


def read_back(stored: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the stored chunks."""
    by = stored.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = by.select("shard", before.alias("base"))  # a row for each shard: no more than there are partitions

    def run(part: pa.RecordBatch) -> dict:
        names, starts, sizes, sums = [], [], [], []
        for k in range(part.num_rows):
            lens = np.array(part.column("lengths")[k].as_py(), dtype=np.int64)
            ids = unpack(part.column("data")[k].as_py())
            ends = np.cumsum(lens)
            names += part.column("doc_ids")[k].as_py()
            sizes += lens.tolist()
            starts += (ends - lens + part.column("base")[k].as_py() + part.column("ids_before")[k].as_py()).tolist()
            raw = ids.astype("<u4").tobytes()
            sums += [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lens.tolist())]
        return {"doc_id": pa.array(names, pa.int64()), "start": starts, "n_tokens": sizes, "ids_crc32": sums}

    rows = stored.join(F.broadcast(base), "shard").select("ids_before", "base", "doc_ids", "lengths", "data")
    return map_rows(rows, run, "doc_id long, start long, n_tokens long, ids_crc32 long", text="data")


def stored_tokens(docs: DataFrame, path: str | None = None, bits: bool = False) -> DataFrame:
    """read_back of the chunks of docs, written to the shared folder and read again."""
    return read_back(written(chunks(docs, path, bits), "token-chunks"))
