"""Mixing sources to target weights in fixed-length blocks of tokens.

The texts of a source, one after the other, are cut into blocks of equal length; a block is addressed by its index. The
number of slots of each source follows from the shares and the repeat caps; each output shard draws its source counts
from the multinomial given those totals, so that the whole mixture holds the shares exactly. The draws form a binary tree
over the shards, each node seeded by its place, so that a task draws its own shards without knowing the others'. A slot
finds its block by a pseudorandom permutation of the source's indices, a new one for each repetition, and slots and blocks
join by index.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapemill.llm.tokens import VOCABULARY, encoder, sound, spread
from tapemill.session import durable

BLOCK_TOKENS = 128
#: Documents of a source are spread over so many buckets, whatever the table's size.
BUCKETS = 65_536
SLOTS_PER_SHARD, MOST_SOURCES = 1024, 10_000
#: Shards that one task draws and fills.
SHARDS_PER_TASK = 64
#: The numpy draw takes fewer slots than this; more are split in proportion, to within a slot of each source.
MOST_DRAWN = 10**9
SEED = 1729


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permuted(index: np.ndarray, n: np.ndarray, key: np.ndarray, rounds: int = 6) -> np.ndarray:
    """A pseudorandom permutation of 0 .. n - 1 for each ``key``, at ``index``: a Feistel network walked into range.

    ``n`` and ``key`` go with each index. The network permutes 0 .. 4 ** h - 1, at most four times n on average.
    """
    half = np.zeros(len(index), np.uint64)
    for h in range(1, 32):
        half = np.where((half == 0) & (n.astype(np.float64) <= 4.0**h), np.uint64(h), half)
    mask = (np.uint64(1) << half) - np.uint64(1)
    x, out = index.astype(np.uint64), np.full(len(index), -1, np.int64)
    todo = np.arange(len(index))
    with np.errstate(over="ignore"):
        while len(todo):
            h, m, k = half[todo], mask[todo], key[todo].astype(np.uint64)
            left, right = x[todo] >> h, x[todo] & m
            for r in range(rounds):
                left, right = right, left ^ (_mix(right + k * np.uint64(0x9E3779B97F4A7C15) + np.uint64(r)) & m)
            x[todo] = (left << h) | right
            inside = x[todo] < n[todo].astype(np.uint64)
            out[todo[inside]] = x[todo[inside]].astype(np.int64)
            todo = todo[~inside]
    return out


def token_blocks(documents: DataFrame, block: int = BLOCK_TOKENS, vocabulary: str = VOCABULARY, buckets: int = BUCKETS) -> DataFrame:
    """(source, block_index, n_tokens, tokens, doc_ids, doc_starts): each source's tokens in blocks of ``block``.

    Documents follow each other in (bucket, doc_id) order, a source's last block may be short. Null and empty texts
    have no tokens; the null source is none. Tokenized once. A document's place comes from its bucket's offset, a sum
    over (source, bucket) rows, and a running sum inside the bucket, so that a source may hold any share of the rows.
    """

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = encoder(vocabulary)
        for batch in batches:
            for some in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                ids = [tokenizer.encode_ordinary(sound(t)) for t in some.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([some.column("source"), some.column("doc_id"), some.column("bucket"), pa.array(ids, pa.list_(pa.int32())), pa.array(map(len, ids), pa.int64())], ["source", "doc_id", "bucket", "ids", "n"])

    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int").alias("bucket")
    texts = documents.where("source is not null and text <> ''").select("source", "doc_id", bucket, "text")
    told = durable(spread(texts).mapInArrow(tokenize, "source string, doc_id bigint, bucket int, ids array<int>, n bigint").where("n > 0"))
    before = Window.unboundedPreceding, -1
    sums = told.groupBy("source", "bucket").agg(F.sum("n").alias("many"))
    offsets = sums.select("source", "bucket", F.coalesce(F.sum("many").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(*before)), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("source", "bucket").orderBy("doc_id", "n", F.xxhash64("ids")).rowsBetween(*before)
    placed = told.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(offsets, ["source", "bucket"]).withColumn("at", F.col("offset") + F.col("inside"))
    each = placed.select("source", "doc_id", "ids", "n", "at", F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("n") - 1) / block))).alias("block_index"))
    first = F.greatest(F.col("at"), F.col("block_index") * block)
    cut = F.slice("ids", (first - F.col("at") + 1).cast("int"), (F.least(F.col("at") + F.col("n"), (F.col("block_index") + 1) * block) - first).cast("int"))
    parts = each.select("source", "block_index", F.struct((first - F.col("block_index") * block).cast("int").alias("start"), "doc_id", cut.alias("part")).alias("p"))
    # At most ``block`` parts meet in a block.
    blocks = parts.groupBy("source", "block_index").agg(F.sort_array(F.collect_list("p")).alias("parts"))
    return blocks.select("source", "block_index", F.aggregate("parts.part", F.lit(0), lambda a, p: a + F.size(p)).alias("n_tokens"), F.flatten("parts.part").alias("tokens"), F.col("parts.doc_id").alias("doc_ids"), F.col("parts.start").alias("doc_starts"))


def quotas(blocks: dict[str, int], shares: dict[str, float], repeats: dict[str, int]) -> dict[str, int]:
    """Slots of each source: the most that hold the shares and no source's blocks times its repeats.

    Shares are those of the sources that have blocks, scaled to sum to 1. Largest remainders are rounded up first.
    """
    usable = {s: w for s, w in shares.items() if w > 0 and blocks.get(s, 0) * repeats.get(s, 0) > 0}
    if not usable:
        return {}
    total = sum(usable.values())
    room = {s: blocks[s] * repeats[s] for s in usable}
    slots = int(min(room[s] * total / w for s, w in usable.items()) + 1e-9)
    exact = {s: slots * w / total for s, w in usable.items()}
    got = {s: min(room[s], int(x)) for s, x in exact.items()}
    for s in sorted(usable, key=lambda s: (int(exact[s]) - exact[s], s)):
        if sum(got.values()) < slots and got[s] < room[s]:
            got[s] += 1
    return got


def _drawn(left: np.ndarray, size: int, node: list[int]) -> np.ndarray:
    """How many of ``size`` slots each source gets of what is ``left``."""
    total = int(left.sum())
    if size >= total:
        return left.copy()
    if total < MOST_DRAWN:
        return np.random.default_rng(node).multivariate_hypergeometric(left, size, method="marginals")
    shares = [divmod(int(k) * size, total) for k in left]
    got = np.array([whole for whole, _ in shares], np.int64)
    largest = sorted(range(len(left)), key=lambda i: (-shares[i][1], i))[: size - int(got.sum())]
    got[largest] += 1
    return got


def shard_total(slots: int) -> int:
    return max(1, -(-slots // SLOTS_PER_SHARD))


def shard_draws(quota: np.ndarray, a: int, b: int, seed: int = SEED) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, first slot and number of slots of each source) of the shards ``a`` to ``b``.

    A node of the tree is a range of shards; its left half draws from what the node holds, the right half gets the rest.
    Only nodes that overlap the wanted shards are drawn.
    """
    total = int(quota.sum())
    shards = shard_total(total)
    upto = lambda i: total * i // shards
    todo = [(0, shards, np.zeros(len(quota), np.int64), quota.astype(np.int64))]
    while todo:
        low, high, first, held = todo.pop()
        if high <= a or low >= b:
            continue
        if high - low == 1:
            yield low, first, held
            continue
        middle = (low + high) // 2
        own = _drawn(held, upto(middle) - upto(low), [seed, low, high])
        todo.append((middle, high, first + own, held - own))
        todo.append((low, middle, first, own))


def _targets(targets: DataFrame) -> list:
    rows = targets.where("source is not null").groupBy("source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("repeats")).limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    return rows


def mix(documents: DataFrame, targets: DataFrame, block: int = BLOCK_TOKENS, vocabulary: str = VOCABULARY, seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """The mixture, a row per slot: shard, slot_order, source, repeat, block_index, n_tokens, tokens, doc_ids, doc_starts.

    The mixture is as large as the shares and caps allow; no block of a source comes more than ``max_repeats`` times,
    and not again before all of the source's blocks came. Sources that are no target, or have no tokens, no share or
    no repeats, do not contribute; the others keep their relative shares. ``slot_order`` shuffles a shard. Shares hold
    to one slot by blocks; a source's last block, which may be short, is the only difference by tokens.
    """
    spark = documents.sparkSession
    wanted = _targets(targets)
    names = [r["source"] for r in wanted if r["share"] and r["repeats"]]
    made = durable(token_blocks(documents.where(F.col("source").isin(names)), block, vocabulary, buckets))
    have = {r["source"]: r["n"] for r in made.groupBy("source").agg((F.max("block_index") + 1).alias("n")).collect()}  # a row per target
    quota = quotas(have, {r["source"]: r["share"] for r in wanted}, {r["source"]: r["repeats"] or 0 for r in wanted})
    used = sorted(quota)
    slots, blocks = np.array([quota[s] for s in used], np.int64), np.array([have[s] for s in used], np.int64)
    shards = shard_total(int(slots.sum())) if used else 0

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for task in (t for batch in batches for t in batch.column("id").to_pylist()):
            for shard, first, many in shard_draws(slots, task * SHARDS_PER_TASK, (task + 1) * SHARDS_PER_TASK, seed):
                source = np.repeat(np.arange(len(used)), many)
                slot = np.repeat(first - np.cumsum(many) + many, many) + np.arange(len(source))
                n = blocks[source]
                repeat = slot // n
                index = permuted(slot % n, n, seed + source * 1_000_003 + repeat)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(slot), shard, np.int64)), pa.DictionaryArray.from_arrays(pa.array(source), pa.array(used, pa.string())).cast(pa.string()), pa.array(slot), pa.array(repeat.astype(np.int32)), pa.array(index)], ["shard", "source", "slot", "repeat", "block_index"])

    found = spark.range(-(-shards // SHARDS_PER_TASK)).mapInArrow(fill, "shard bigint, source string, slot bigint, repeat int, block_index bigint")
    order = F.xxhash64(F.lit(seed), "shard", "source", "slot").alias("slot_order")
    # Slots look few to the planner, which sees only the number of tasks: it must not broadcast them.
    return found.hint("merge").join(made, ["source", "block_index"]).select("shard", order, "source", "repeat", "block_index", "n_tokens", "tokens", "doc_ids", "doc_starts")


def held(shown: DataFrame, slack_slots: float = 1.0) -> DataFrame:
    """(source, target_share, max_repeats, capped, shared) of :func:`shares`: whether the cap and the share are kept.

    Shares are of the slots, among the sources that contribute, to within ``slack_slots``; a source that cannot is kept.
    """
    total = Window.partitionBy()  # one row per source
    exact = F.try_divide(F.col("target_share") * F.sum("slots").over(total), F.sum(F.when(F.col("slots") > 0, F.col("target_share"))).over(total))
    return shown.select("source", "target_share", "max_repeats", (F.col("most_repeats") <= F.col("max_repeats")).alias("capped"), ((F.col("slots") == 0) | (F.abs(F.col("slots") - exact) <= slack_slots)).alias("shared"))


def shares(mixture: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, slots, blocks, most_repeats, tokens, actual_share) of a mixture, per target."""
    used = mixture.groupBy("source", "block_index").agg(F.count("*").alias("times"), F.sum("n_tokens").alias("tokens")).groupBy("source").agg(F.sum("times").alias("slots"), F.count("*").alias("blocks"), F.max("times").alias("most_repeats"), F.sum("tokens").alias("tokens"))
    total = Window.partitionBy()  # one row per source
    joined = targets.select("source", "target_share", "max_repeats").join(used, "source", "left").na.fill(0, ["slots", "blocks", "most_repeats", "tokens"])
    return joined.withColumn("actual_share", F.try_divide(F.col("tokens"), F.sum("tokens").over(total)))
