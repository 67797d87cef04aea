"""Language identification: averaged hashed subword embeddings with a linear softmax and calibrated rejection.

Subwords are runs of 1 to 4 characters of the lower-cased words, each word between two boundary marks; they are
hashed to rows of an embedding table. A text is the mean of its rows, and a linear layer with softmax gives the
languages. Table and layer are trained together by stochastic gradient descent in numpy on a bounded sample of
labelled rows, whole texts and short pieces of them. A temperature fitted on rows kept apart calibrates the scores.
From the same rows come the two limits of the rejection: the score, and the share of subwords seen in training,
under which no more than ALPHA of those rows lie.

In prediction the table and the layer are multiplied once, so a subword costs one look-up of a row of len(langs)
numbers, however long the text is; texts are read whole.

Defined cases: null or empty text, or text without a letter, gives und with score 0 and is rejected; with no labelled
rows at all every text is und; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import map_rows, map_whole, mix64, returned

#: Labelled rows of a language that training and calibration take, about; rows in all at most.
PER_LANGUAGE, ROWS = 900, 6000
BUCKETS, DIM, ORDERS, EPOCHS, RATE, SEED, ALPHA = 1 << 17, 12, (1, 2, 3, 4), 4, 0.6, 11, 0.0005
#: Characters of a piece of text that is hashed at once.
SPAN = 1 << 18

_TABLE: list[np.ndarray] = []


#: Code points from which none is a letter.
_LAST = 0x32400


def _letters() -> np.ndarray:
    """For each code point below _LAST: 2 for a letter, 1 for a mark of one, else 0."""
    if not _TABLE:
        import unicodedata

        _TABLE.append(np.array([{"L": 2, "M": 1}.get(unicodedata.category(chr(c))[0], 0) for c in range(_LAST)], dtype=np.int8))
    return _TABLE[0]


def subwords(text: str) -> np.ndarray:
    """Bucket numbers of all subwords of the text; none of a text without a letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype=np.uint32)
    kind = _letters()[np.minimum(codes, _LAST - 1)]
    if not (kind == 2).any():
        return np.zeros(0, dtype=np.int64)
    letter = kind > 0
    # every run of other characters becomes one mark, with one before the first word and one after the last
    keep = letter | np.concatenate(([False], letter[:-1]))
    mark = np.array([32], dtype=np.uint64)
    c = np.where(letter, codes, 32)[keep].astype(np.uint64)
    c = np.concatenate((mark, c) if c[-1] == 32 else (mark, c, mark))
    word, out = c != 32, []
    h, inner = np.zeros(len(c), dtype=np.uint64), np.ones(len(c), dtype=bool)
    with np.errstate(over="ignore"):
        for n in range(1, max(ORDERS) + 1):
            if n > len(c):
                break
            h = h[: len(c) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + c[n - 1 :] + np.uint64(n)
            if n > 2:  # no subword reaches past the marks of its word
                inner = inner[: len(h)] & word[n - 2 : n - 2 + len(h)]
            ok = word if n == 1 else inner[: len(h)]
            out.append((h[ok] * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - 17)).astype(np.int64))
    return np.concatenate(out)


def _pieces(text: str):
    """The text in pieces of bounded length, cut at white space where there is any."""
    at = 0
    while at < len(text):
        to = min(len(text), at + SPAN)
        if to < len(text) and (cut := text.rfind(" ", at, to)) > at:
            to = cut
        yield text[at:to]
        at = to


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # BUCKETS x len(langs): embeddings times layer
    bias: np.ndarray
    seen: np.ndarray  # BUCKETS: was the bucket met in training
    temperature: float = 1.0
    least_score: float = 0.0
    least_known: float = 0.0

    def logits(self, text: str) -> tuple[np.ndarray, float] | None:
        """Mean logits, and the share of known subwords; None without a letter."""
        total, known, n = np.zeros(len(self.langs)), 0, 0
        for piece in _pieces(text):
            g = subwords(piece)
            if len(g):
                total += self.table.take(g, axis=0).sum(axis=0, dtype=np.float64)
                known += int(np.count_nonzero(self.seen.take(g)))
                n += len(g)
        return (total / n + self.bias, known / n) if n else None

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, calibrated score, and whether it is accepted."""
        got = self.logits(text) if text and self.langs else None
        if got is None:
            return "und", 0.0, False
        z = got[0] / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        best = int(p.argmax())
        return self.langs[best], float(p[best]), bool(p[best] >= self.least_score and got[1] >= self.least_known)


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(axis=-1, keepdims=True))
    return p / p.sum(axis=-1, keepdims=True)


def train(rows: list[tuple[str, str]], seed: int = SEED) -> Model:
    """A model from (text, language) rows; every fifth row calibrates and is not trained on."""
    rows = [(t, y) for t, y in rows if t and y is not None]
    langs = sorted({y for _, y in rows})
    if not langs:
        return Model([], np.zeros((1, 0), np.float32), np.zeros(0), np.zeros(BUCKETS, dtype=bool))
    number = {y: k for k, y in enumerate(langs)}
    rng = np.random.default_rng(seed)
    e = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    w, b = rng.normal(0, 0.1, (DIM, len(langs))).astype(np.float32), np.zeros(len(langs), np.float32)
    fit, apart, seen = [], [], np.zeros(BUCKETS, dtype=bool)
    for k, (text, y) in enumerate(rows):
        words = text.split()
        if k % 5 == 4:
            apart.append((text, number[y]))
            continue
        at = int(rng.integers(0, max(1, len(words))))
        for piece in (text, " ".join(words[at : at + int(rng.integers(2, 20))])):
            g = subwords(piece)
            if len(g):
                ids, n = np.unique(g, return_counts=True)
                fit.append((ids, (n / n.sum()).astype(np.float32), number[y]))
                seen[ids] = True
    share = np.bincount([y for _, _, y in fit], minlength=len(langs)).clip(1)
    weight = (share.mean() / share).clip(0.2, 5.0)
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for k in rng.permutation(len(fit)):
            ids, n, y = fit[k]
            rows_e = e[ids]
            mean = n @ rows_e
            d = _softmax(mean @ w + b)
            d[y] -= 1
            d *= weight[y] * rate
            back = w @ d
            w -= np.outer(mean, d)
            b -= d
            e[ids] = rows_e - np.outer(n * len(ids), back) * min(1.0, 8.0 / len(ids))
    model = Model(langs, e @ w, b.astype(np.float64), seen)
    got = [(*model.logits(t), y) for t, y in apart if model.logits(t) is not None]
    if got:
        z, known, y = np.array([g[0] for g in got]), np.array([g[1] for g in got]), np.array([g[2] for g in got])
        grid = np.geomspace(0.05, 20, 60)
        miss = 1 / (len(y) + 2)  # the rule of succession: no error among n rows doesn't mean that there is none
        spread = []
        for t in grid:
            logs = np.log(_softmax(z / t).clip(1e-12))
            own = logs[np.arange(len(y)), y]
            spread.append(((1 - miss) * own + miss * (logs.sum(axis=1) - own) / max(1, len(langs) - 1)).mean())
        model.temperature = float(grid[int(np.argmax(spread))])
        p = _softmax(z / model.temperature).max(axis=1)
        # limits under which no more than ALPHA of the rows kept apart lie, and never ones that a fair guess misses
        model.least_score = float(min(0.5, 0.999 * np.quantile(p, ALPHA, method="lower")))
        model.least_known = float(min(0.5, 0.8 * np.quantile(known, ALPHA, method="lower")))
    return model


def sample(labelled: DataFrame, id: Column, text: Column, lang: Column) -> list[tuple[str, str]]:
    """A bounded sample of labelled rows for train: about PER_LANGUAGE of each language, by a hash of id, ROWS at most.

    Languages are counted first, a row for each on the driver, as the model has a column for each; of many languages
    each gives fewer rows. Each row then goes in with the probability that its language's count asks for.
    """
    at = labelled.filter(lang.isNotNull() & text.isNotNull())
    counts = at.groupBy(lang.alias("y")).count().orderBy(F.desc("count"), "y").collect()
    if not counts:
        return []
    each = min(PER_LANGUAGE, max(1, ROWS // len(counts)))
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["y"], min(1.0, each / r["count"]))])
    drawn = F.pmod(F.xxhash64(F.lit(SEED), id), F.lit(1 << 40)) / float(1 << 40)
    rows = at.filter(drawn < F.element_at(share, lang)).select(text.alias("t"), lang.alias("y"), F.xxhash64(F.lit(SEED + 1), id).alias("h")).orderBy("h", "t").limit(ROWS)
    return [(r["t"], r["y"]) for r in rows.collect()]


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score and accepted of every row of docs (which has doc_id and text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(part: pa.RecordBatch) -> dict:
        got = [shared.value.predict(t) for t in part.column("text").to_pylist()]
        return {"doc_id": part.column("doc_id"), "lang_pred": [g[0] for g in got], "score": [g[1] for g in got], "accepted": [g[2] for g in got]}

    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id long, lang_pred string, score double, accepted boolean", text="text")


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs whose prediction is accepted, with all their columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(part: pa.RecordBatch) -> pa.RecordBatch:
        texts = part.column("text").cast(pa.string()).to_pylist()
        return part.filter(pa.array([shared.value.predict(t)[2] for t in texts], pa.bool_()))

    return map_whole(docs, keep)


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of doc_id as text, modulo 4, is 2: such rows are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fitted(docs: DataFrame) -> Model:
    """A model from the rows of docs that are not held out."""
    model = train(sample(docs.filter(~held_out(F.col("doc_id"))), F.col("doc_id"), F.col("text"), F.col("lang")))
    returned()  # what the sample and the training took on the driver
    return model
