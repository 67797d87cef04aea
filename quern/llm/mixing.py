"""Mixing of sources to target weights, with DataFrame operations alone.

Every source's words are packed, document after document, into blocks of a fixed number of words. The mix is a
sequence of slots in output shards; a slot takes one block. How many slots of each source a shard has is drawn: each of
a source's slots falls on a shard by a keyed hash, and the counts by source and shard are multinomial, given that a
source's total is exact. The slots of a source are then numbered through its counts, shard after shard; slot k takes
block perm(k), where perm is a keyed pseudorandom permutation of the block numbers ("swap or not"), applied anew in
each pass, so every block is taken once before any is taken twice. Slots and blocks meet in a join on (source, block).
The last slot of a source takes only the first words of its block, so that a source's words in the mix are its target
rounded. Within a shard a keyed hash puts the slots of all sources in order (place).

Weights, targets and offsets come from aggregates: sizes are summed by (source, bucket of documents) before any
ordering, so a source that holds a third of all rows is spread over as many tasks as it has buckets, and the number of
buckets grows with the number of documents.

Defined cases: null or empty text has size 0 and is taken 0 times; a null source is a source of its own, ordered
last; rows that repeat a doc_id count as documents of their own; rows without a doc_id are dealt by their text; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import cut

#: A modulus below 2**31, so that products of two residues fit in 64 bits.
P = 2147483647
#: Words in a block; rounds of the permutation; factor of the mix; weights; slots of an output shard.
BLOCK, ROUNDS, SHARE, WEIGHTS, SHARD = 128, 12, 1.5, (3, 1, 2), 65536
#: Documents of a bucket, about; fewest buckets.
BUCKET, BUCKETS = 2048, 64
#: Distinct sources up to which their table is broadcast (about 100 bytes each).
SMALL_SOURCES = 50_000
#: Slots of one row while slots are dealt out.
RUN = 2048


def words(text: Column) -> Column:
    """Number of runs of characters other than space and \\x09-\\x0D; 0 for null. Plain replacing and splitting: no regular expression runs."""
    t = text.cast("string")
    for code in range(9, 14):
        t = F.replace(t, F.lit(chr(code)), F.lit(" "))
    return F.coalesce(F.size(F.array_remove(F.split(t, " "), "")), F.lit(0)).cast("long")


def _mod(x: Column, n: Column | int) -> Column:
    return F.pmod(x, F.lit(n) if isinstance(n, int) else n)


def _dealt(doc_id: Column, text: Column) -> Column:
    """A number that deals documents to buckets: of the doc_id, or else of the text."""
    own = F.conv(F.substring(F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary")), 1, 7), 16, 10).cast("long")
    return _mod(F.when(doc_id.isNotNull(), _mod(doc_id.cast("long"), P)).otherwise(own) * 48271, P)


def buckets_of(documents: int) -> int:
    """The number of buckets for so many documents: a power of two."""
    return max(BUCKETS, 1 << max(0, -(-documents // BUCKET) - 1).bit_length())


def sources(sized: DataFrame, share: float = SHARE, weights: tuple[int, ...] = WEIGHTS, block: int = BLOCK) -> DataFrame:
    """One row per source: src, source_size, rank (by code point, null last), target and the plan of its slots.

    The targets solve sum(min(2 * size, x * weight)) = share * total: sources are ordered by size over weight, and x
    is read off the prefix at which the rest of the total fits. The table has a row per distinct source only.
    """
    by = sized.groupBy("src").agg(F.sum("size").alias("source_size"))
    every = Window.partitionBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by = by.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("src"))).cast("long") - 1)
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    by = by.withColumn("weight", weight).withColumn("total", F.sum("source_size").over(every))
    by = by.withColumn("cap", F.lit(2.0) * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    order = Window.partitionBy(F.lit(0)).orderBy("ratio", "rank")
    until = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    by = by.withColumn("capped", F.sum("cap").over(until) - F.col("cap")).withColumn("open", F.sum("weight").over(after))
    # the level at which this source and those after it would share what the capped ones before it leave
    by = by.withColumn("level", (F.lit(share) * F.col("total") - F.col("capped")) / F.col("open"))
    # levels rise while sources below them are capped, and fall after; the highest one is where the filling stops
    by = by.withColumn("x", F.max("level").over(every))
    by = by.withColumn("target", F.least(F.col("cap"), F.col("x") * F.col("weight")))
    by = by.withColumn("take", F.round("target").cast("long"))
    by = by.withColumn("blocks", F.ceil(F.col("source_size") / block).cast("long"))
    full = F.when(F.col("source_size") > 0, F.floor(F.col("take") / F.col("source_size"))).otherwise(0).cast("long")
    by = by.withColumn("passes", full).withColumn("rest", F.col("take") - full * F.col("source_size"))
    return by.select("src", "source_size", "rank", "weight", "target", "blocks", "passes", "rest")


def round_keys(key: Column, n: Column, inverse: bool = False, rounds: int = ROUNDS) -> Column:
    """For each round of a permutation of 0 .. n-1: the number r of its pairs, and two numbers of its hash."""

    def one(i: Column) -> Column:
        seed = _mod((key + 1) * 1103515245 + i * 69069 + 12345, P)
        return F.struct(_mod(_mod(seed * 16807, P), n).alias("r"), seed.alias("s"), _mod(seed * 69621, P).alias("t"))

    order = (rounds, 1, -1) if inverse else (1, rounds, 1)
    return F.transform(F.sequence(*[F.lit(x).cast("long") for x in order]), one)


def permuted(k: Column, n: Column, keys: Column) -> Column:
    """The place of k in a pseudorandom permutation of 0 .. n-1: rounds of "swap or not".

    In a round with a number r, x and (r - x) mod n form a pair; a keyed hash of the larger of the two says whether
    they change places. Each round is its own inverse, so the whole is a bijection for any n, and its inverse takes
    the rounds from the last to the first.
    """

    def step(x: Column, key: Column) -> Column:
        other = F.when(x <= key["r"], key["r"] - x).otherwise(key["r"] - x + n)
        bit = F.shiftright(((F.greatest(x, other) + key["s"]) % P * 48271 + key["t"]) % P, 7) % 2
        return F.when(bit == 1, other).otherwise(x)

    return F.aggregate(keys, k.cast("long"), step)


def drawn(plan: DataFrame, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """plan with shard, n and first: how many slots of a source each output shard has, and the number of the first of them.

    Every slot falls on one of the shards by a keyed hash, so a source's counts are a multinomial draw of its total;
    they are counted where they fall, and only a row for each source and shard is shuffled.
    """
    every = Window.partitionBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    p = plan.filter("source_size > 0").withColumn("short", F.col("blocks") * block - F.col("source_size"))
    last = F.expr(f"if(rest > 0, least(blocks, (rest + short + {block - 1}) div {block}), 0L)")
    p = p.withColumn("slots", F.col("passes") * F.col("blocks") + last)
    p = p.withColumn("shards", F.greatest(F.lit(1), F.ceil(F.sum("slots").over(every) / shard)).cast("long")).filter("slots > 0")
    key = F.col("rank") * 7919 + F.col("passes")
    p = p.withColumn("short_at", permuted(F.col("blocks") - 1, F.col("blocks"), round_keys(key, F.col("blocks"), inverse=True)))
    runs = _spread(p.select("src", "rank", "slots", "shards", F.explode(F.expr(f"sequence(0L, (slots - 1) div {RUN})")).alias("run")), "src", "run")
    each = runs.select("src", "rank", "shards", F.explode(F.expr(f"sequence(run * {RUN}, least(slots, (run + 1) * {RUN}) - 1)")).alias("slot"))
    counts = each.groupBy("src", F.pmod(F.xxhash64(F.lit(17), "rank", "slot"), F.col("shards")).alias("shard")).agg(F.count("slot").alias("n"))
    before = Window.partitionBy("src").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return p.join(counts, "src").withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))


def _spread(df: DataFrame, *by: str) -> DataFrame:
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism * 4), *by)


def slots(plan: DataFrame, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """Every slot of the mix: src, shard, place, pass, block_no, words (how many of the block's it takes) and whole.

    A source's slots are numbered through the drawn counts of the shards. A pass over a source takes all its blocks;
    the last pass stops at its rest. Only the last block can be short, and the inverse permutation tells which slot of
    the last pass takes it, so each slot knows how many words came before.
    """
    p = drawn(plan, block, shard)
    keys = F.array(*[round_keys(F.col("rank") * 7919 + F.lit(k), F.col("blocks")) for k in range(3)])  # no source is taken more than twice
    p = p.select("*", F.explode(F.expr(f"sequence(0L, (n - 1) div {RUN})")).alias("run"))
    p = _spread(p, "src", "shard", "run").withColumn("keys", keys)
    s = p.select("*", F.explode(F.expr(f"sequence(first + run * {RUN}, first + least(n, (run + 1) * {RUN}) - 1)")).alias("slot"))
    s = s.withColumn("pass", F.expr("slot div blocks")).withColumn("k", F.expr("slot % blocks"))
    s = s.withColumn("block_no", permuted(F.col("k"), F.col("blocks"), F.element_at("keys", (F.col("pass") + 1).cast("int"))))
    s = s.withColumn("fill", F.expr(f"{block} - if(block_no = blocks - 1, short, 0L)"))
    left = F.expr(f"rest - (k * {block} - if(short_at < k, short, 0L))")
    s = s.withColumn("words", F.when(F.col("pass") < F.col("passes"), F.col("fill")).otherwise(F.least(F.col("fill"), left))).filter("words > 0")
    return s.select("src", "shard", F.xxhash64(F.lit(23), "rank", "slot").alias("place"), "pass", "block_no", "words", (F.col("words") == F.col("fill")).alias("whole"))


def laid_out(docs: DataFrame, buckets: int) -> DataFrame:
    """docs (with doc_id, source, size, deal) with src and bucket, dealt out by them."""
    a = docs.withColumn("src", F.when(F.col("source").isNull(), F.lit("t")).otherwise(F.concat(F.lit("s"), F.col("source").cast("string"))))
    return a.withColumn("bucket", F.col("deal") % buckets).drop("deal").repartition("src", "bucket")


def packed(docs: DataFrame, sums: DataFrame, *tie: str) -> DataFrame:
    """docs laid out, with off: the words of its source before it.

    Order within a source is by bucket, then doc_id, size and the columns tie. The sums before a bucket come from the small table of
    sizes by (source, bucket), and only rows of one bucket are ever ordered together.
    """
    order = Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    parts = sums.select("src", "bucket", F.coalesce(F.sum("size").over(order), F.lit(0)).alias("base"))
    within = Window.partitionBy("src", "bucket").orderBy("doc_id", "size", *tie).rowsBetween(Window.unboundedPreceding, -1)
    a = docs.withColumn("ahead", F.coalesce(F.sum("size").over(within), F.lit(0)))
    a = a.join(parts, ["src", "bucket"]).withColumn("off", F.col("base") + F.col("ahead"))
    return a.drop("bucket", "base", "ahead")


def in_blocks(laid: DataFrame, block: int, *keep: str) -> DataFrame:
    """The parts of packed documents in blocks: src, off, block_no, from_word and to_word in the document, and the columns keep."""
    key = laid.filter("size > 0").select("src", "off", "size", *keep, F.explode(F.expr(f"sequence(off div {block}, (off + size - 1) div {block})")).alias("block_no"))
    return key.withColumn("from_word", F.expr(f"greatest(0L, block_no * {block} - off)")).withColumn("to_word", F.expr(f"least(size, (block_no + 1) * {block} - off)")).drop("size")


def taken_parts(laid: DataFrame, sums: DataFrame, few_sources: bool, block: int = BLOCK, *tie: str) -> tuple[DataFrame, DataFrame]:
    """The packed rows with source_size and target; and their parts in blocks that the mix takes.

    A part has src, off and doc_id of its document, from_word and to_word in it, whole (times taken as a whole), upto
    (words of it that the cut slot takes once more), and at: shard and place of the slots that take it, in order.
    """
    plan = sources(sums, block=block)
    told = plan.select("src", "source_size", "target")
    laid = packed(laid, sums, *tie).join(F.broadcast(told) if few_sources else told, "src")
    at = F.array_sort(F.collect_list(F.struct("pass", "shard", "place")))  # a block is taken twice at most, and once more in part
    used = slots(plan, block).groupBy("src", "block_no").agg(F.count(F.when(F.col("whole"), 1)).alias("whole"), F.max(F.when(~F.col("whole"), F.col("words"))).alias("cut"), at.alias("at"))
    seg = in_blocks(laid, block, "doc_id").join(used.hint("merge"), ["src", "block_no"])  # Spark takes what it explodes for small and would broadcast it
    seg = seg.withColumn("upto", F.expr(f"greatest(0L, least(to_word, block_no * {block} + coalesce(cut, 0L) - off) - from_word)"))
    return laid, seg.select("src", "off", "doc_id", "from_word", "to_word", "whole", "upto", "at")


#: Two numbers of a row of all its columns, as a name for it.
TIES = ("tie1", "tie2")


def _ties(docs: DataFrame) -> list[Column]:
    cols = [F.col(f"`{c}`") for c in docs.columns]
    return [F.xxhash64(F.lit(k), *cols).alias(t) for k, t in enumerate(TIES)]


def sizes(docs: DataFrame, *keep: Column) -> tuple[DataFrame, DataFrame, int]:
    """doc_id, source, size and keep of every row, laid out; the sizes by source and bucket; the number of buckets. The texts are read once."""
    sized = cut(docs.select("doc_id", "source", words(F.col("text")).alias("size"), _dealt(F.col("doc_id"), F.col("text")).alias("deal"), *keep))
    buckets = buckets_of(sized.count())
    rows = cut(laid_out(sized, buckets))
    return rows, cut(rows.groupBy("src", "bucket").agg(F.sum("size").alias("size"))), buckets


def few(docs: DataFrame, most: int = SMALL_SOURCES) -> bool:
    """Whether docs has so few sources that a table of them may be broadcast; reads that column alone."""
    return docs.select("source").distinct().limit(most + 1).count() <= most


def mix(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, size, source_size, target and taken (words of it in the mix, repeats counted) of every row of docs."""
    rows, sums, _ = sizes(docs)
    laid, seg = taken_parts(rows, sums, few(docs), block)
    took = seg.groupBy("src", "off", "doc_id").agg(F.sum(F.expr("(to_word - from_word) * whole + upto")).alias("taken"))
    none = laid.filter("size = 0").select("doc_id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"))
    some = laid.filter("size > 0").join(took.withColumnRenamed("doc_id", "_id"), ["src", "off"], "left")
    return some.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken")).unionByName(none)


_SPACE, _SOLID = r"[\x20\x09-\x0D]*+", r"[^\x20\x09-\x0D]++"
#: The words of a text with the white space behind them (before the first word, too).
_PIECES = rf"^{_SPACE}{_SOLID}{_SPACE}|{_SOLID}{_SPACE}"


def _named(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of docs as one column `row` with their TIES, so that no name of theirs clashes; of rows alike, one (they are told apart by what is joined to them)."""
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *_ties(docs))
    if rows.groupBy(*TIES).count().filter("count > 1").limit(1).count():
        named = named.dropDuplicates(list(TIES))
    return named


def mixed_blocks(docs: DataFrame, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """The mix as blocks: shard, place (order in the shard), source, block_no, n_words and text of every slot.

    The parts of a block are put together once; slots and blocks meet on (source, block number). A block's words are
    those of its documents in order, with one space between words.
    """
    rows, sums, _ = sizes(docs, *_ties(docs))
    texts = _named(docs, rows).select(*TIES, F.regexp_extract_all(F.col("row")["text"], F.lit(_SOLID), F.lit(0)).alias("pieces"))
    part = F.expr("slice(pieces, cast(from_word + 1 as int), cast(to_word - from_word as int))")
    parts = in_blocks(packed(rows, sums, *TIES), block, "source", *TIES).join(texts.hint("merge"), list(TIES)).select("src", "source", "block_no", "off", part.alias("part"))
    whole = parts.groupBy("src", "source", "block_no").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("off", "part"))), lambda x: x["part"])).alias("words_of"))
    out = slots(sources(sums, block=block), block, shard).join(whole.hint("merge"), ["src", "block_no"])
    text = F.array_join(F.slice("words_of", F.lit(1), F.col("words").cast("int")), " ")
    return out.select("shard", "place", "source", "block_no", F.col("words").alias("n_words"), text.alias("text")).repartition("shard").sortWithinPartitions("shard", "place")


def copies(rows: DataFrame, sums: DataFrame, few_sources: bool, block: int = BLOCK) -> DataFrame:
    """TIES, shard, place, whole and took of each copy of a document that the mix takes: took has the first word and the number of words of each part."""
    laid, seg = taken_parts(rows, sums, few_sources, block, *TIES)
    lists = seg.groupBy("src", "off").agg(F.sort_array(F.collect_list(F.struct("from_word", "to_word", "whole", "upto", "at"))).alias("parts"))

    def copy(number: int) -> Column:
        def one(p: Column) -> Column:
            n = F.when(p["whole"] >= number, p["to_word"] - p["from_word"]).when(p["whole"] == number - 1, p["upto"]).otherwise(F.lit(0))
            return F.struct((p["from_word"] + 1).cast("int").alias("at"), n.cast("int").alias("n"), F.element_at(p["at"], F.least(F.lit(number), F.size(p["at"]))).alias("slot"))

        return F.filter(F.transform("parts", one), lambda x: x["n"] > 0)

    out = laid.filter("size > 0").join(lists, ["src", "off"]).select(*TIES, "size", F.explode(F.array(copy(1), copy(2))).alias("took")).filter("size(took) > 0")
    count = F.aggregate("took", F.lit(0).cast("long"), lambda a, x: a + x["n"])
    slot = F.col("took")[0]["slot"]
    return out.select(*TIES, slot["shard"].alias("shard"), slot["place"].alias("place"), (count == F.col("size")).alias("whole"), F.transform("took", lambda x: F.struct(x["at"].alias("at"), x["n"].alias("n"))).alias("took"))


def mixed_texts(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The mix as rows of docs: a document's first and second copy, each with the words that the mix takes.

    A copy that is taken whole has the text as it was; of another, the parts taken are joined in their order. White
    space stays with the word before it (at the start, with the word after it). n_chars, if there, is renewed. A copy
    goes to the shard of the slot that takes its first part, and there to that slot's place. Texts are shuffled twice:
    to their copies, and to the shards.
    """
    rows, sums, _ = sizes(docs, *_ties(docs))
    taken = copies(rows, sums, few(docs), block).select(*[F.col(c).alias(f"_{c}") for c in (*TIES, "shard", "place", "whole", "took")])
    out = _named(docs, rows).join(taken.hint("merge"), (F.col("tie1") == F.col("_tie1")) & (F.col("tie2") == F.col("_tie2")))
    whole = F.col("row")["text"]
    out = out.withColumn("_pieces", F.when(~F.col("_whole"), F.regexp_extract_all(whole, F.lit(_PIECES), F.lit(0))))
    joined = F.array_join(F.flatten(F.transform("_took", lambda x: F.slice("_pieces", x["at"], x["n"]))), "")
    out = out.withColumn("_text", F.when(F.col("_whole"), whole).otherwise(joined)).select("_shard", "_place", "_text", "row").repartition("_shard").sortWithinPartitions("_shard", "_place")
    kept = {"text": F.col("_text")}
    if "n_chars" in docs.columns:
        kept["n_chars"] = F.length("_text").cast(docs.schema["n_chars"].dataType)
    return out.select(*[kept.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


#: The same in DuckDB: offsets by window, targets by the level of each prefix, the permutation by list_reduce.
ORACLE = """
WITH d AS (SELECT doc_id, source, CASE WHEN source IS NULL THEN 't' ELSE 's' || source END AS src,
    coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
    ((CASE WHEN doc_id IS NULL THEN ('0x' || left(md5(coalesce(text, '')), 7))::BIGINT ELSE (doc_id % {P} + {P}) % {P} END * 48271) % {P})
    % (SELECT greatest({BUCKETS}, (2 ** ceil(log2(greatest(1, ceil(count(*) / {BUCKET}.0)))))::BIGINT) FROM documents) AS bucket FROM documents),
laid AS (SELECT *, (coalesce(sum(size) OVER (PARTITION BY src ORDER BY bucket, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS off FROM d),
s0 AS (SELECT src, sum(size)::BIGINT AS source_size FROM d GROUP BY src),
s1 AS (SELECT *, row_number() OVER (ORDER BY src) - 1 AS rank FROM s0),
s2 AS (SELECT *, [3, 1, 2][rank % 3 + 1] AS weight, 2.0::DOUBLE * source_size AS cap, sum(source_size) OVER () AS total FROM s1),
s3 AS (SELECT *, cap / weight AS ratio FROM s2),
s4 AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY ratio, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
    sum(weight) OVER (ORDER BY ratio, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM s3),
s5 AS (SELECT *, (1.5::DOUBLE * total - capped) / open AS level FROM s4),
s6 AS (SELECT *, max(level) OVER () AS x FROM s5),
s7 AS (SELECT src, rank, source_size, least(cap, x * weight) AS target FROM s6),
s8 AS (SELECT *, round(target)::BIGINT AS take, ((source_size + {BLOCK} - 1) // {BLOCK})::BIGINT AS blocks FROM s7 WHERE source_size > 0),
s9 AS (SELECT *, take // source_size AS passes, take % source_size AS rest, blocks * {BLOCK} - source_size AS short FROM s8),
g AS (SELECT *, unnest(range(0, (passes + 1) * blocks)) AS slot FROM s9),
h AS (SELECT *, slot // blocks AS pass, slot % blocks AS k FROM g),
m AS (SELECT *, list_reduce(list_prepend(k, range(1, {ROUNDS} + 1)), lambda x, i: (
    CASE WHEN ((((greatest(x, ({OTHER})) + ({SEED})) % {P} * 48271 + (({SEED}) * 69621) % {P}) % {P}) >> 7) % 2 = 1 THEN ({OTHER}) ELSE x END)) AS block_no FROM h),
f AS (SELECT *, {BLOCK} - CASE WHEN block_no = blocks - 1 THEN short ELSE 0 END AS fill FROM m),
t AS (SELECT *, CASE WHEN pass < passes THEN fill ELSE least(fill, rest - coalesce(sum(fill) OVER (PARTITION BY src, pass ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) END AS words FROM f),
u AS (SELECT src, block_no, count(*) FILTER (WHERE words = fill) AS whole, coalesce(max(words) FILTER (WHERE words < fill), 0) AS cut FROM t WHERE words > 0 GROUP BY src, block_no),
e AS (SELECT src, off, doc_id, size, unnest(range(off // {BLOCK}, (off + size - 1) // {BLOCK} + 1)) AS block_no FROM laid WHERE size > 0),
w AS (SELECT src, off, sum((least(size, (block_no + 1) * {BLOCK} - off) - greatest(0, block_no * {BLOCK} - off)) * whole
    + greatest(0, least(least(size, (block_no + 1) * {BLOCK} - off), block_no * {BLOCK} + cut - off) - greatest(0, block_no * {BLOCK} - off))) AS taken
    FROM e JOIN u USING (src, block_no) GROUP BY src, off)
SELECT l.doc_id, l.size, s7.source_size, s7.target, (CASE WHEN l.size > 0 THEN coalesce(w.taken, 0) ELSE 0 END)::BIGINT AS taken
FROM laid l JOIN s7 USING (src) LEFT JOIN w ON l.src = w.src AND l.off = w.off AND l.size > 0
"""
_SEED = "(((rank * 7919 + pass + 1) * 1103515245 + i * 69069 + 12345) % {P})"
_OTHER = "((({SEED}) * 16807 % {P} - x) % blocks + blocks) % blocks"


def oracle() -> str:
    sql = ORACLE.replace("{OTHER}", _OTHER).replace("{SEED}", _SEED)
    for k, v in (("P", P), ("BUCKETS", BUCKETS), ("BUCKET", BUCKET), ("BLOCK", BLOCK), ("ROUNDS", ROUNDS)):
        sql = sql.replace("{%s}" % k, str(v))
    return sql.replace("\\\\x", "\\x")
