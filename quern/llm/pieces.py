"""SentencePiece BPE encoding and decoding with seeded merge dropout.

The vocabulary and the scores come from a SentencePiece model file; nothing is trained. A text gets the model's dummy
space in front and is cut before each run of spaces: no piece of such a model has a space after another character, so
merges never reach past a cut. In a unit the best-scored pair of neighbours (leftmost of equals) is merged until none
is left. A candidate merge is skipped if a keyed hash of seed, document, the unit's place in it, the unit and the
bounds of both halves falls under the dropout rate, so each occurrence of a unit is cut on its own, in the same way in
every run. Characters without a piece, and a literal U+2581, become byte pieces, so decoding gives back every text
exactly. With a rate of 0 the ids are those of the library.

What a unit gives without dropout is kept from its second occurrence on, with the merges that are tried on the way; an
occurrence of which none of these is skipped takes it as it is. For units that come often, what they give with one of these merges skipped is kept
in the same way. The others go through the agenda.

Units of like length go through the agenda together: each round takes the best candidate of every unit at once
(numpy), which for each unit is the order of an agenda. `agenda` does one unit with a heap, as units of more than LONG
characters do; tests compare the two.

Defined cases: null counts as empty; an empty text has no ids and decodes to an empty text; texts of any length are
encoded whole; a null key counts as 0; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import map_rows, mix64

RATE, SEED = 0.1, 7
#: Characters of units that a worker remembers between slices.
MEMORY = 4_000_000
#: Bytes of text that are encoded at once.
SLICE = 2 << 20
#: Units that go through the agenda together, and units whose merges are looked at together.
TOGETHER = SPAN = 131072
#: Occurrences from which what a unit gives with one merge skipped is kept; how many such results are kept.
OFTEN, BRANCHES = 12, 150_000
#: Bits of the filter that tells which units came before.
SEEN = 22
#: Characters of a unit from which it goes through a heap of its own and isn't kept.
LONG = 256
#: Widths of the tables in which units go through the agenda.
WIDTHS = np.array([2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 14, 17, 21, 27, 36, 64, 128, LONG])
_UNIT = re.compile(r" +[^ ]*|[^ ]+")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """The tables of a model file: ids of characters, mergeable pairs with their priority, bytes of pieces."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.size = n
        self.pairs: dict[int, int] | None = None  # for single units; made when first asked for
        pieces = [sp.id_to_piece(i) for i in range(n)]
        kind = [sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) for i in range(n)]
        self.ids = {p: i for i, p in enumerate(pieces) if not kind[i]}
        if any("▁" in p.lstrip("▁") for p in self.ids):
            raise ValueError("a piece of this model has a space after another character")
        order = {s: k for k, s in enumerate(sorted({sp.get_score(i) for i in range(n)}))}
        self.priority = np.array([order[sp.get_score(i)] + 1 for i in range(n)], dtype=np.int64)
        self.byte = np.zeros(256, dtype=np.int64)
        text = []
        for i, p in enumerate(pieces):
            if sp.is_byte(i):
                self.byte[int(p[3:5], 16)] = i
                text.append(bytes([int(p[3:5], 16)]))
            else:
                text.append(b"" if kind[i] else p.replace("▁", " ").encode())
        self.text_len = np.array([len(b) for b in text], dtype=np.int64)
        self.text_at = np.concatenate(([0], np.cumsum(self.text_len)))[:-1]
        self.text = np.frombuffer(b"".join(text), dtype=np.uint8)
        self.char = np.full(0x110000, -1, dtype=np.int32)
        for p, i in self.ids.items():
            if len(p) == 1 and p != "▁":
                self.char[ord(p)] = i
        self.char[0x20] = self.ids["▁"]
        pair = {}
        for p, i in self.ids.items():
            for k in range(1, len(p)):
                left, right = self.ids.get(p[:k]), self.ids.get(p[k:])
                if left is not None and right is not None:
                    pair[left * n + right] = i
        self._table(np.array(list(pair), dtype=np.int64), np.array(list(pair.values()), dtype=np.int32))

    def _table(self, keys: np.ndarray, ids: np.ndarray) -> None:
        """A hash table of the pairs: rows of as many places as the fullest one needs."""
        self.bits = np.uint64(64 - max(4, int(4 * len(keys)).bit_length()))
        row = self._row(keys)
        order = np.argsort(row, kind="stable")
        first = np.searchsorted(row[order], row[order])
        place = np.arange(len(keys)) - first
        kind = np.int32 if self.size**2 < 1 << 31 else np.int64
        self.pair_key = np.full((int(place.max(initial=0)) + 1, 1 << (64 - int(self.bits))), -1, dtype=kind)
        self.pair_id = np.full(self.pair_key.shape, -1, dtype=np.int32)
        self.pair_key[place, row[order]], self.pair_id[place, row[order]] = keys[order], ids[order]

    def _row(self, key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.bits).astype(np.int64)

    def pair(self, left: int, right: int) -> int:
        """The id of the piece that a pair merges to, or -1."""
        if self.pairs is None:
            at = self.pair_key >= 0
            self.pairs = dict(zip(self.pair_key[at].tolist(), self.pair_id[at].tolist()))
        return self.pairs.get(left * self.size + right, -1)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ids of the pieces that pairs merge to; -1 for none. Neither of a pair without a piece (-1) is in the table."""
        key = left.astype(np.int64) * self.size + right
        key[(left < 0) | (right < 0)] = -2
        row, out = self._row(key), np.full(len(key), -1, dtype=np.int32)
        key = key.astype(self.pair_key.dtype)
        for keys, ids in zip(self.pair_key, self.pair_id):
            hit = keys[row] == key
            out[hit] = ids[row[hit]]
        return out


def coded(units: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of units, one after the other, and how many each has."""
    return np.frombuffer("".join(units).encode("utf-32-le"), dtype=np.uint32), np.array([len(u) for u in units], dtype=np.int64)


def unit_key(units: tuple[np.ndarray, np.ndarray], seed: int, variant: int) -> np.ndarray:
    """A 64-bit number of each unit (coded), by seed and variant."""
    codes, lens = units
    starts = np.cumsum(lens) - lens
    place = (np.arange(len(codes)) - np.repeat(starts, lens)).astype(np.uint64)
    if not len(lens):
        return np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        each = mix64(codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + place * np.uint64(0xC2B2AE3D27D4EB4F))
        return mix64(np.add.reduceat(each, starts) + mix64(np.uint64([seed * 1_000_003 + variant]))[0])


def merge_key(start: np.ndarray, mid: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A number of the merge of [start, mid) and [mid, end)."""
    with np.errstate(over="ignore"):
        return mix64(start.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + mid.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + end.astype(np.uint64) * np.uint64(0x165667B19E3779F9))


def place_key(unit_keys: np.ndarray, docs: list[int], sizes: np.ndarray) -> np.ndarray:
    """Numbers of the occurrences of units in documents (of so many units each), by the document's number and their places."""
    place = np.arange(1, len(unit_keys) + 1) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    with np.errstate(over="ignore"):
        base = np.repeat(mix64(np.array([d & (1 << 64) - 1 for d in docs], dtype=np.uint64)), sizes)
        return mix64(unit_keys ^ mix64(base + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))


def dropped(key: np.ndarray, start: np.ndarray, mid: np.ndarray, end: np.ndarray, rate: float) -> np.ndarray:
    """Whether the merge of [start, mid) and [mid, end) of the unit with that key is skipped."""
    return hidden(key, merge_key(start, mid, end), rate)


def hidden(key: np.ndarray, where: np.ndarray, rate: float) -> np.ndarray:
    """Whether the merge with the number where is skipped in the unit with that key."""
    return (mix64(key ^ where) >> np.uint64(11)).astype(np.float64) < rate * 2.0**53


_FULL = (1 << 64) - 1


def _mixed(x: int) -> int:
    """mix64 of one number."""
    x ^= x >> 33
    x = x * 0xFF51AFD7ED558CCD & _FULL
    x ^= x >> 33
    x = x * 0xC4CEB9FE1A85EC53 & _FULL
    return x ^ x >> 33


def agenda(unit: str, p: Pieces, rate: float = 0.0, seed: int = SEED, variant: int = 0, key: int | None = None) -> list[int]:
    """Ids of one unit (a run of spaces and what follows it), by a heap of candidate merges; key is its number, else unit_key."""
    n, most = len(unit), rate * 2.0**53
    sym = [int(p.char[ord(c)]) for c in unit]
    end, prev = list(range(1, n + 1)), list(range(-1, n - 1))
    key = int(unit_key(coded([unit]), seed, variant)[0]) if key is None else key
    heap: list[tuple[int, int, int, int, int]] = []

    def offer(i: int) -> None:
        j = end[i]
        if j < n and sym[i] >= 0 and sym[j] >= 0:
            m = p.pair(sym[i], sym[j])
            if m >= 0 and not (rate > 0 and _mixed(key ^ _mixed(i * 0x9E3779B97F4A7C15 + j * 0xC2B2AE3D27D4EB4F + end[j] * 0x165667B19E3779F9 & _FULL)) >> 11 < most):
                heapq.heappush(heap, (-int(p.priority[m]), i, j, end[j], m))

    for i in range(n):
        offer(i)
    dead = [False] * n
    while heap:
        _, i, j, e, m = heapq.heappop(heap)
        if dead[i] or end[i] != j or dead[j] or end[j] != e:
            continue
        sym[i], end[i], dead[j] = m, e, True
        if e < n:
            prev[e] = i
        offer(i)
        if prev[i] >= 0:
            offer(prev[i])
    out, i = [], 0
    while i < n:
        out += [sym[i]] if sym[i] >= 0 else [int(p.byte[b]) for b in unit[i : end[i]].encode()]
        i = end[i]
    return out


def encode_units(units: list[str] | tuple[np.ndarray, np.ndarray], p: Pieces, rate: float, seed: int, variant: int, key: np.ndarray | None = None, tried: list | None = None, pairs: np.ndarray | None = None, skip: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the units (or coded units, of LONG characters at most) in order, and the number of ids of each; as by agenda.

    key has a number of each unit (else unit_key gives them); tried is given the merges looked at: arrays of units,
    starts, middles and ends. pairs has what each character and the next merge to, if that is known; skip the number of
    a merge of each unit that is skipped.
    """
    codes, lens = coded(units) if isinstance(units, list) else units
    starts, key = np.cumsum(lens) - lens, unit_key((codes, lens), seed, variant) if key is None else key
    pieces = p.char[codes]
    wide = np.searchsorted(WIDTHS, lens)
    order = np.argsort(wide, kind="stable")
    to = np.searchsorted(wide[order], np.arange(len(WIDTHS) + 1))
    sym = np.empty(len(codes), dtype=np.int32)
    for k, width in enumerate(WIDTHS.tolist()):
        which = order[to[k] : to[k + 1]]
        if len(which):
            at = starts[which][:, None] + np.arange(width)
            table, made = np.full((2, len(which), width + 1), -1, dtype=np.int32)
            exact = bool((lens[which] == width).all())
            real = ... if exact else np.arange(width) < lens[which][:, None]
            where = at if exact else at[real]
            table[:, :width][real] = pieces[where]
            if pairs is not None:
                made[:, :width][real] = pairs[where]
            _rounds(table, lens[which], p, rate, key[which], which, tried, made if pairs is not None else None, None if skip is None else skip[which])
            sym[where] = table[:, :width][real]
    origin = np.flatnonzero(sym != _DEAD)
    sym = sym[origin].astype(np.int64)
    owner = np.repeat(np.arange(len(lens)), lens)[origin]
    rare = np.flatnonzero(sym < 0)
    if len(rare):  # characters without a piece: one symbol each, so origin tells which
        raw = [p.byte[np.frombuffer(chr(c).encode(), dtype=np.uint8)] for c in codes[origin[rare]].tolist()]
        size = np.ones(len(sym), dtype=np.int64)
        size[rare] = [len(r) for r in raw]
        at = np.cumsum(size) - size
        out = np.repeat(sym, size)
        for k, r in zip(at[rare].tolist(), raw):
            out[k : k + len(r)] = r
        sym, owner = out, np.repeat(owner, size)
    return sym, np.bincount(owner, minlength=len(lens))


#: The place of a symbol that was merged into the one before it.
_DEAD = -2


def _rounds(table: np.ndarray, lens: np.ndarray, p: Pieces, rate: float, key: np.ndarray, names: np.ndarray, tried: list | None, pairs: np.ndarray | None, skip: np.ndarray | None = None) -> None:
    """Merges the symbols in the rows of table (a unit each, filled up with -1, with a spare column) until no candidate is left."""
    n, step = table.shape
    sym = table.reshape(-1)
    after = np.tile(np.arange(1, step + 1, dtype=np.int32), n)  # column of the next symbol
    before = np.tile(np.arange(-1, step - 1, dtype=np.int32), n)
    made = np.full(n * step, -1, dtype=np.int32) if pairs is None else pairs.reshape(-1)
    rank = np.full((n, step), -1, dtype=np.int32)

    def offer(row: np.ndarray, i: np.ndarray, j: np.ndarray, line: np.ndarray, m: np.ndarray | None = None) -> None:
        """Looks at the merges of columns i and j in rows; line has the places of those rows in rank, m what they give if known."""
        base = row * step
        m = p.merged(sym[base + i], sym[base + j]) if m is None else m
        ok = np.flatnonzero(m >= 0)
        if len(ok) and (rate > 0 or tried is not None):
            r, a, b = row[ok], i[ok], j[ok]
            e = after[base[ok] + b]
            if rate > 0 or skip is not None:
                kept = ~dropped(key[r], a, b, e, rate) if skip is None else merge_key(a, b, e) != skip[r]
                m[ok[~kept]] = -1
                ok, r, a, b, e = ok[kept], r[kept], a[kept], b[kept], e[kept]
            if tried is not None:
                tried.append((names[r], a, b, e))
        made[base + i] = m
        best = np.full(len(m), -1, dtype=np.int32)
        best[ok] = p.priority[m[ok]]
        rank[line, i] = best

    if pairs is None:
        row, col = np.nonzero(np.arange(step) < lens[:, None] - 1)
        offer(row, col, col + 1, row)
    else:
        row, col = np.nonzero(pairs >= 0)
        offer(row, col, col + 1, row, pairs[row, col])
    live = np.arange(n)  # the row of table that each row of rank stands for
    while len(live):
        i = rank.argmax(axis=1)  # the leftmost of equals
        on = rank[np.arange(len(live)), i] >= 0
        if not on.all():
            live, rank, i = live[on], rank[on], i[on]
            if not len(live):
                break
        line, base = np.arange(len(live)), live * step
        j = after[base + i]
        k = after[base + j]
        sym[base + i], sym[base + j] = made[base + i], _DEAD
        after[base + i], rank[line, j] = k, -1
        more = k < lens[live]
        before[base[more] + k[more]] = i[more]
        rank[line, i] = -1
        if more.any():
            offer(live[more], i[more], k[more], line[more])
        left = before[base + i]
        has = left >= 0
        if has.any():
            offer(live[has], left[has], i[has], line[has])


def gather_at(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The places start .. start + len - 1, one run after the other."""
    ends = np.cumsum(lens)
    return np.arange(int(lens.sum())) + np.repeat(starts - (ends - lens), lens)


def gather(flat: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The pieces flat[start : start + len], one after the other."""
    return flat[gather_at(starts, lens)]


class Encoder:
    """Encodes texts, keeping what units give without dropout (up to MEMORY characters and merges)."""

    def __init__(self, path: str, rate: float = RATE, seed: int = SEED):
        self.p, self.rate, self.seed = Pieces(path), rate, seed
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.held, self.seen = 0, np.zeros(1 << SEEN, dtype=bool)
        self.codes, self.pairs, self.sizes, self.ids, self.lens, self.merges, self.counts, self.keys, self.uses = (np.zeros(0, t) for t in (np.uint32, np.int32, np.int64, np.int32, np.int64, np.uint64, np.int64, np.uint64, np.int64))
        self.forget()

    def forget(self) -> None:
        """Forgets the results with one merge skipped: branch has the number of that for each merge, or -1."""
        self.branch = np.full(len(self.merges), -1, dtype=np.int32)
        self.branch_ids, self.branch_lens, self.branch_merges, self.branch_counts = (np.zeros(0, t) for t in (np.int32, np.int64, np.uint64, np.int64))

    def shrink(self, room: int = MEMORY // 2) -> None:
        """Forgets the units that come least often, so that the others fit into the room."""
        weight, least = self.sizes + 8 + self.counts, 2
        while (keep := self.uses >= least).any() and weight[keep].sum() > room:
            least *= 2
        keep, names = np.flatnonzero(keep), list(self.known)
        for sizes, flats in ((self.sizes, ("codes", "pairs")), (self.lens, ("ids",)), (self.counts, ("merges",))):
            at = gather_at((np.cumsum(sizes) - sizes)[keep], sizes[keep])
            for name in flats:
                setattr(self, name, getattr(self, name)[at])
        self.known = {names[k]: n for n, k in enumerate(keep.tolist())}
        self.sizes, self.lens, self.counts, self.keys, self.uses = (x[keep] for x in (self.sizes, self.lens, self.counts, self.keys, self.uses >> 1))
        self.held = int(weight[keep].sum())
        self.forget()

    def learn(self, new: list[str]) -> None:
        """Keeps the ids of new units, the merges tried for each, and their keys; of long units the characters alone."""
        for at in range(0, len(new), TOGETHER):
            part, tried = new[at : at + TOGETHER], []
            codes, sizes = coded(part)
            short = sizes <= LONG
            inside = np.repeat(short, sizes)
            pairs = self._pairs(codes, sizes)
            got, n = encode_units((codes[inside], sizes[short]), self.p, 0.0, self.seed, 0, tried=tried if self.rate > 0 else None, pairs=pairs[inside])
            unit, *where = (np.concatenate(x) for x in zip(*tried)) if tried else [np.zeros(0, np.int64)] * 4
            order = np.argsort(unit, kind="stable")
            lens, counts = np.zeros(len(part), np.int64), np.zeros(len(part), np.int64)
            lens[short], counts[short] = n, np.bincount(unit, minlength=int(short.sum()))
            for name, more in (("codes", codes), ("pairs", pairs), ("sizes", sizes), ("ids", got.astype(np.int32)), ("lens", lens), ("merges", merge_key(*where)[order]), ("counts", counts), ("keys", unit_key((codes, sizes), self.seed, 0)), ("uses", np.zeros(len(part), np.int64)), ("branch", np.full(len(order), -1, np.int32))):
                setattr(self, name, np.concatenate((getattr(self, name), more)))
            self.known.update(zip(part, range(len(self.known), len(self.known) + len(part))))
            self.held += len(codes) + 8 * len(part) + len(unit)

    def numbers(self, units: list[str]) -> np.ndarray:
        """The numbers of units among those kept, new ones learned."""
        out = np.array([self.known.get(u, -1) for u in units], dtype=np.int64)
        at = np.flatnonzero(out < 0)
        if len(at):
            self.learn(list({units[k]: None for k in at.tolist()}))
            out[at] = [self.known[units[k]] for k in at.tolist()]
        return out

    def counted(self, units: list[str], counts: np.ndarray) -> np.ndarray:
        """The numbers of different units that come so often; new ones are learned if they came before or come more than once.

        The others go behind the units that are kept, for these texts alone.
        """
        get = self.known.get
        out = np.array([get(u, -1) for u in units], dtype=np.int64)
        at = np.flatnonzero(out < 0)
        if not len(at):
            return out
        codes, sizes = coded([units[k] for k in at.tolist()])
        keys = unit_key((codes, sizes), self.seed, 0)
        bit = (keys >> np.uint64(64 - SEEN)).astype(np.int64)
        often = ((counts[at] > 1) | self.seen[bit] | (self.rate <= 0)) & (sizes <= LONG)
        self.seen[bit] = True
        if self.seen.mean() > 0.4:
            self.seen[:] = False
        base = len(self.sizes)
        out[at[often]] = base + np.arange(int(often.sum()))
        self.learn([units[k] for k in at[often].tolist()])
        rest, inside = ~often, np.repeat(~often, sizes)
        out[at[rest]] = len(self.sizes) + np.arange(int(rest.sum()))
        pairs = self._pairs(codes, sizes)
        zeros = np.zeros(int(rest.sum()), np.int64)
        for name, more in (("codes", codes[inside]), ("pairs", pairs[inside]), ("sizes", sizes[rest]), ("lens", zeros), ("counts", zeros), ("keys", keys[rest]), ("uses", zeros)):
            setattr(self, name, np.concatenate((getattr(self, name), more)))
        return out

    def _pairs(self, codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """What each character of coded units and the next one merge to, or -1."""
        pieces = self.p.char[codes]
        pairs = np.append(self.p.merged(pieces[:-1], pieces[1:]), -1).astype(np.int32)
        pairs[np.cumsum(sizes) - 1] = -1  # the last character of a unit has no next one
        return pairs[: len(codes)]

    def tidied(self) -> None:
        """Forgets the units behind those that are kept."""
        n = len(self.known)
        if len(self.sizes) > n:
            letters = int(self.sizes[:n].sum())
            self.codes, self.pairs = self.codes[:letters], self.pairs[:letters]
            self.sizes, self.lens, self.counts, self.keys, self.uses = (x[:n] for x in (self.sizes, self.lens, self.counts, self.keys, self.uses))

    def cut(self, texts: pa.Array) -> list[np.ndarray]:
        """The numbers of the units of each text; texts with runs of spaces are cut one by one, the others by Arrow at once."""
        out = [np.zeros(0, np.int64)] * len(texts)
        runs = pc.match_substring_regex(texts, r"^\x20|\x20\x20").to_numpy(zero_copy_only=False)
        for k in np.flatnonzero(runs).tolist():
            out[k] = self.numbers(_UNIT.findall(" " + texts[k].as_py()))
        at = np.flatnonzero(~runs & pc.not_equal(texts, "").to_numpy(zero_copy_only=False))
        if len(at):
            lists = pc.split_pattern(texts.take(pa.array(at)), " ")
            each = lists.flatten().dictionary_encode()
            place = each.indices.to_numpy()
            every = self.counted([" " + u for u in each.dictionary.to_pylist()], np.bincount(place, minlength=len(each.dictionary)))[place]
            ends = lists.offsets.to_numpy().tolist()
            for k, a, b in zip(at.tolist(), ends, ends[1:]):
                out[k] = every[a:b]
        return out

    def encode(self, texts: pa.Array | list[str | None], docs: list[int]) -> list[np.ndarray]:
        """Ids of each text, as int32; docs has a number of each, which its dropout is keyed by. Null counts as empty."""
        if self.held > MEMORY:
            self.shrink()
        if len(self.branch_lens) > BRANCHES:
            self.forget()
        cut = self.cut(pc.fill_null(pa.array(texts, pa.string()) if isinstance(texts, list) else texts, ""))
        sizes = np.array([len(x) for x in cut], dtype=np.int64)
        ids, lens = self._ids(np.concatenate([np.zeros(0, np.int64), *cut]), sizes, docs)
        self.tidied()
        to = np.concatenate(([0], np.cumsum(lens)))[np.cumsum(sizes)]
        return [ids[a:b] for a, b in zip([0, *to[:-1].tolist()], to.tolist())]

    def branches(self, places: np.ndarray, unit: np.ndarray) -> np.ndarray:
        """The numbers of the results of units with the merge at one of these places skipped; new ones are worked out and kept."""
        new, first = np.unique(places[self.branch[places] < 0], return_index=True)
        if len(new):
            unit = unit[self.branch[places] < 0][first]
            where, tried = gather_at((np.cumsum(self.sizes) - self.sizes)[unit], self.sizes[unit]), []
            got, lens = encode_units((self.codes[where], self.sizes[unit]), self.p, 0.0, self.seed, 0, self.keys[unit], tried, self.pairs[where], self.merges[new])
            own, *at = (np.concatenate(x) for x in zip(*tried)) if tried else [np.zeros(0, np.int64)] * 4
            order = np.argsort(own, kind="stable")
            self.branch[new] = len(self.branch_lens) + np.arange(len(new))
            for name, more in (("ids", got.astype(np.int32)), ("lens", lens), ("merges", merge_key(*at)[order]), ("counts", np.bincount(own, minlength=len(new)))):
                setattr(self, f"branch_{name}", np.concatenate((getattr(self, f"branch_{name}"), more)))
        return self.branch[places]

    def _ids(self, at: np.ndarray, sizes: np.ndarray, docs: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the units with these numbers in some texts (of so many units each), and how many each unit has; SPAN units at a time."""
        self.uses += np.bincount(at, minlength=len(self.uses))
        starts, tries, letters = (np.cumsum(x) - x for x in (self.lens, self.counts, self.sizes))
        keys = place_key(self.keys[at], docs, sizes)
        out, sizes_out = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for k in range(0, len(at), SPAN):
            a, key = at[k : k + SPAN], keys[k : k + SPAN]
            first, size, made, base = starts[a], self.lens[a], [], len(self.ids)
            if self.rate > 0:
                n = self.counts[a]
                own, places = np.repeat(np.arange(len(a)), n), gather_at(tries[a], n)
                hit = hidden(key[own], self.merges[places], self.rate)
                hits = np.bincount(own[hit], minlength=len(a))
                one = np.flatnonzero((hits[own[hit]] == 1) & (self.uses[a[own[hit]]] >= OFTEN))
                one, places = own[hit][one], places[hit][one]
                branch = self.branches(places, a[one])
                n = self.branch_counts[branch]
                own = np.repeat(np.arange(len(one)), n)
                where = gather_at((np.cumsum(self.branch_counts) - self.branch_counts)[branch], n)
                more = hidden(key[one][own], self.branch_merges[where], self.rate)
                fine = np.bincount(own[more], minlength=len(one)) == 0
                one, branch = one[fine], branch[fine]
                first[one], size[one] = base + (np.cumsum(self.branch_lens) - self.branch_lens)[branch], self.branch_lens[branch]
                made.append(self.branch_ids)
                base += len(self.branch_ids)
                hits[one] = 0
                odd = np.flatnonzero((hits > 0) | (a >= len(self.known)) & (self.sizes[a] <= LONG))
                where = gather_at(letters[a[odd]], self.sizes[a[odd]])
                ids, lens = encode_units((self.codes[where], self.sizes[a[odd]]), self.p, self.rate, self.seed, 0, key[odd], pairs=self.pairs[where])
                first[odd], size[odd] = base + np.cumsum(lens) - lens, lens
                made.append(ids.astype(np.int32))
                base += len(ids)
            for i in np.flatnonzero(self.sizes[a] > LONG).tolist():
                unit = self.codes[letters[a[i]] : letters[a[i]] + self.sizes[a[i]]].tobytes().decode("utf-32-le")
                made.append(np.array(agenda(unit, self.p, self.rate, key=int(key[i])), dtype=np.int32))
                first[i], size[i] = base, len(made[-1])
                base += len(made[-1])
            out.append(np.concatenate([self.ids, *made])[gather_at(first, size)])
            sizes_out.append(size)
        return np.concatenate(out), np.concatenate(sizes_out)

    def decode(self, ids: np.ndarray) -> str:
        """The text that the ids stand for."""
        p = self.p
        return gather(p.text, p.text_at[ids], p.text_len[ids]).tobytes()[1:].decode()


def encoded(docs: DataFrame, key: Column, path: str | None = None, rate: float = RATE, seed: int = SEED, checked: bool = True) -> DataFrame:
    """docs without text, with ids, n_tokens and, if checked, ids_crc32 and the sha256 of the text decoded from the ids.

    A column of docs that has the name of one of these gives way to it; all other columns stay as they are.
    """
    path = path or default_model()
    rest = [c for c in docs.columns if c != "text"]
    doc = F.when(key.isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(F.lit(seed), key))
    work = docs.select(F.struct(*rest).alias("rest"), F.col("text").cast("string").alias("text"), doc.alias("doc"))
    held: list[Encoder] = []

    def run(part: pa.RecordBatch) -> dict:
        if not held:
            held.append(_encoder(path, rate, seed))
        enc = held[0]
        got = enc.encode(part.column("text"), part.column("doc").to_pylist())
        ends = np.concatenate(([0], np.cumsum([len(g) for g in got]))).astype(np.int32)
        ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*got, np.zeros(0, np.int32)]).astype(np.int32)))
        out = {"rest": part.column("rest"), "ids": ids, "n_tokens": np.diff(ends).astype(np.int64)}
        if checked:
            out["ids_crc32"] = [zlib.crc32(g.astype("<u4").tobytes()) for g in got]
            out["decoded_sha256"] = [hashlib.sha256(enc.decode(g).encode()).hexdigest() for g in got]
        return out

    fields = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in docs.select(*rest).schema)
    more = ", ids_crc32 long, decoded_sha256 string" if checked else ""
    def done() -> None:
        for enc in held:
            enc.shrink()

    out = map_rows(work, run, f"rest struct<{fields}>, ids array<int>, n_tokens long{more}", text="text", done=done, most=SLICE)
    made = out.columns[1:]
    return out.select(*[F.col(f"rest.`{c}`").alias(c) for c in rest if c not in made], *made)


_ENCODERS: dict[tuple, Encoder] = {}


def _encoder(path: str, rate: float, seed: int) -> Encoder:
    """The worker's encoder: its tables are read once and serve all tasks of the worker."""
    if (path, rate, seed) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path, rate, seed] = Encoder(path, rate, seed)
    return _ENCODERS[path, rate, seed]
