"""Filling containers of fixed capacity with neighbouring texts along a Hilbert curve.

A document's token counts are hashed to a few dimensions, its cell in the cube gives a Hilbert key, and documents are
range-sorted by key: near ones on the curve are alike. Each range is packed on its own, a window of neighbours at a
time, the largest first into the open container it leaves the least room in.

Ranges are cut by a histogram of the keys' leading bits, not by a sample, so that the same table is packed the same way
each time. A cell of the histogram that is too heavy for one range, as of copies of one text, is spread over several by the
hash of the ids.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapemill.llm.tokens import VOCABULARY, encoder, sound, spread
from tapemill.session import durable

DIMENSIONS, BITS = 4, 10
#: Neighbours that are packed together, and containers kept open from one window to the next.
WINDOW, OPEN = 512, 64
#: A range fills this many containers at least, so that its last ones, which stay part empty, weigh little; and it weighs so
#: much at least, a document as its tokens and a little more, so that a task has enough to do and not too much.
CONTAINERS_PER_RANGE, RANGE_WEIGHT, DOCUMENT_WEIGHT = 1024, 1 << 25, 32
#: Leading bits of the key that the histogram counts by: at most 65,536 rows of it travel with the tasks.
CELL_BITS = 16
#: Ranges are hashed to tasks, at most so many.
MOST_TASKS = 65_536
MOST_SPECS = 1000


def hilbert_keys(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position on the Hilbert curve of each row of ``cells`` (n by d, unsigned below 2 ** bits; d times bits < 63)."""
    x = cells.astype(np.int64).T.copy()
    d = len(x)
    bit = 1 << (bits - 1)
    while bit > 1:  # undo the rotations, from the coarsest level down
        low = bit - 1
        for i in range(d):
            flip = (x[i] & bit) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(flip, low, swap)
            if i:
                x[i] ^= swap
        bit >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    bit = 1 << (bits - 1)
    while bit > 1:
        turn ^= np.where(x[-1] & bit, bit - 1, 0)
        bit >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | ((x[i] >> level) & 1)
    return key


def _projection(size: int, dimensions: int = DIMENSIONS, seed: int = 20_11) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((size, dimensions)).astype(np.float32)


def directions(ids: list[list[int]], projection: np.ndarray) -> np.ndarray:
    """Hashed vectors of length 1 of texts given as token ids; 0 for texts without tokens."""
    v = np.zeros((len(ids), projection.shape[1]))
    for i, t in enumerate(ids):
        if t:
            v[i] = projection[np.asarray(t)].sum(axis=0)
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)


def curve_key(unit: np.ndarray) -> np.ndarray:
    """Hilbert keys of vectors of length 1; 0 gets the centre's."""
    return hilbert_keys(np.minimum(((unit + 1) / 2 * 2**BITS).astype(np.int64), 2**BITS - 1))


def measured(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, tokens, curve): whole texts in tokens; null and empty texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = encoder(vocabulary)
        projection = _projection(tokenizer.n_vocab)
        for batch in batches:
            for some in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                ids = [tokenizer.encode_ordinary(sound(t)) if t else [] for t in some.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(map(len, ids), pa.int64()), pa.array(curve_key(directions(ids, projection)), pa.int64())], ["doc_id", "tokens", "curve"])

    return spread(documents.select("doc_id", "text")).mapInArrow(run, "doc_id bigint, tokens bigint, curve bigint")


class Packer:
    """Packs items that come in curve order; ``put`` and ``end`` return (item, container) pairs that are settled."""

    def __init__(self, capacity: int, first: int):
        self.capacity, self._next = capacity, first
        self._open: list[tuple[int, int]] = []  # (room, container), sorted
        self._window: list[tuple[int, object]] = []

    def put(self, size: int, item: object) -> list[tuple[object, int]]:
        self._window.append((size, item))
        return self._settle() if len(self._window) >= WINDOW else []

    def end(self) -> list[tuple[object, int]]:
        return self._settle()

    def _settle(self) -> list[tuple[object, int]]:
        out = []
        for size, item in sorted(self._window, key=lambda x: -x[0]):
            at = bisect_left(self._open, (size, -1))
            if at < len(self._open):
                room, container = self._open.pop(at)
            else:
                room, container = self.capacity, self._next
                self._next += 1
            if room - size > 0:
                insort(self._open, (room - size, container))
            out.append((item, container))
        self._window = []
        del self._open[: max(0, len(self._open) - OPEN)]  # those with the least room
        return out


def pack(documents: DataFrame, specs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(spec_id, container_id, doc_id, piece, tokens, capacity_tokens): every document in containers of each capacity.

    No container holds more than its capacity. A document is cut only if it is longer than the capacity: into pieces
    that fill a container each, and a rest that is packed like any other item. Texts that are null or empty take no
    room and are put into a container like others. Container ids are unique within a spec. Specs without a positive
    capacity are left out; specs, one row each by contract, are checked against ``MOST_SPECS``. Equal texts share a key;
    ids break ties, so many copies are split over ranges. The same table gives the same containers in every run.

    Texts are tokenized once. Then rows of a few numbers are shuffled once, by spec and range of the curve.
    """
    wanted = [(r[0], int(r[1])) for r in specs.where("capacity_tokens > 0").select("spec_id", "capacity_tokens").distinct().limit(MOST_SPECS + 1).collect()]
    if len(wanted) > MOST_SPECS:
        raise ValueError(f"more than {MOST_SPECS} container specs")
    schema = "spec_id int, container_id bigint, doc_id bigint, piece int, tokens bigint, capacity_tokens int"
    if not wanted:
        return documents.sparkSession.createDataFrame([], schema)
    sizes = durable(measured(documents, vocabulary))
    weight = F.col("tokens") + DOCUMENT_WEIGHT
    cell = F.shiftright("curve", BITS * DIMENSIONS - CELL_BITS).cast("int")
    histogram = sizes.groupBy(cell.alias("cell")).agg(F.sum(weight).alias("weight"), F.sum("tokens").alias("tokens")).collect()  # a row per cell, bounded by its bits
    if not histogram:
        return documents.sparkSession.createDataFrame([], schema)
    before, cells = 0, []
    for r in sorted(histogram):
        cells.append((r["cell"], before, r["weight"]))
        before += r["weight"]
    total, tokens = before, sum(r["tokens"] for r in histogram)
    ranges = {s: max(1, min(total // RANGE_WEIGHT, tokens // (CONTAINERS_PER_RANGE * c))) for s, c in wanted}

    # A document's place on the whole curve, from its cell's and its id's hash: the same in every run, even within a cell.
    places = F.broadcast(documents.sparkSession.createDataFrame(cells, "h_cell int, before bigint, cell_weight bigint"))
    within = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)
    placed = sizes.join(places, cell == F.col("h_cell")).select("doc_id", "tokens", "curve", ((F.col("before") + within * F.col("cell_weight")) / float(total)).alias("place"))
    spec = F.explode(F.array(*[F.struct(F.lit(s).cast("int").alias("spec_id"), F.lit(c).alias("capacity"), F.lit(int(ranges[s])).cast("bigint").alias("ranges")) for s, c in wanted])).alias("s")
    items = placed.select("*", spec).select("s.spec_id", "s.capacity", F.floor(F.col("place") * F.col("s.ranges")).cast("bigint").alias("range"), "doc_id", "tokens", "curve")
    cut = F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("tokens") / F.col("capacity")).cast("int") - 1, F.lit(0)))).alias("piece")
    pieces = items.select("*", cut).withColumn("tokens", F.least(F.col("capacity").cast("long"), F.col("tokens") - F.col("piece") * F.col("capacity").cast("long")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, here = None, None
        names = [f.split()[0] for f in schema.split(", ")]

        def rows(settled: list) -> pa.RecordBatch:
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32()]
            columns = zip(*[(here[0], c, doc, piece, size, packer.capacity) for (doc, piece, size), c in settled], strict=True)
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names)

        for batch in batches:
            for s, r, capacity, doc, size, piece in zip(*(batch.column(c).to_pylist() for c in ("spec_id", "range", "capacity", "doc_id", "tokens", "piece")), strict=True):
                if (s, r) != here:
                    if packer and (settled := packer.end()):
                        yield rows(settled)
                    packer, here = Packer(capacity, r << 32), (s, r)
                if settled := packer.put(size, (doc, piece, size)):
                    yield rows(settled)
        if packer and (settled := packer.end()):
            yield rows(settled)

    tasks = min(MOST_TASKS, 4 * sum(ranges.values()))
    order = ["spec_id", "range", "curve", "doc_id", "piece", "tokens"]
    return pieces.repartition(int(tasks), "spec_id", "range").sortWithinPartitions(*order).mapInArrow(run, schema)


def fill(packed: DataFrame) -> DataFrame:
    """(spec_id, containers, least_containers, tokens, fill_share) of a packing; least is total by capacity."""
    sums = packed.groupBy("spec_id", "capacity_tokens").agg(F.countDistinct("container_id").alias("containers"), F.sum("tokens").alias("tokens"))
    return sums.select("spec_id", "containers", F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("least_containers"), "tokens", F.try_divide(F.col("tokens"), F.col("containers") * F.col("capacity_tokens")).alias("fill_share"))


def soundness(packed: DataFrame, documents: DataFrame, specs: DataFrame) -> DataFrame:
    """(spec_id, capacity_tokens, documents, lost, overfull, cut_needlessly) of each spec that can be filled.

    ``lost``: documents of the table in no container; ``overfull``: containers beyond their capacity; ``cut_needlessly``:
    documents in several pieces that would have fitted into one container, or in more pieces than their length needs.
    """
    containers = packed.groupBy("spec_id", "container_id").agg(F.sum("tokens").alias("n"), F.first("capacity_tokens").alias("c")).groupBy("spec_id").agg(F.count_if(F.col("n") > F.col("c")).alias("overfull"))
    whole = packed.groupBy("spec_id", "doc_id").agg(F.sum("tokens").alias("n"), F.count("*").alias("pieces"), F.first("capacity_tokens").alias("c"), F.count_distinct("piece").alias("places"))
    copies = F.col("pieces") / F.col("places")  # of repeated ids
    per = whole.groupBy("spec_id").agg(F.count("*").alias("found"), F.count_if((F.col("places") > 1) & (F.col("places") > F.ceil(F.col("n") / copies / F.col("c")))).alias("cut_needlessly"))
    total = documents.agg(F.count_distinct("doc_id").alias("documents"))  # one row
    wanted = specs.where("capacity_tokens > 0").select("spec_id", "capacity_tokens").distinct()
    both = wanted.crossJoin(F.broadcast(total)).join(containers, "spec_id", "left").join(per, "spec_id", "left").na.fill(0, ["overfull", "found", "cut_needlessly"])
    return both.select("spec_id", "capacity_tokens", "documents", (F.col("documents") - F.col("found")).alias("lost"), "overfull", "cut_needlessly")


#: Dimensions of the vectors by which likeness is measured; not those that the curve was made from.
LIKENESS_DIMENSIONS = 32


def likeness(packed: DataFrame, documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(spec_id, containers, inside, anywhere): mean cosine of two documents of one container, and of any two.

    Over containers with two documents or more; hashed vectors of other dimensions than the curve's. Cosines come from the
    length of summed vectors, so that no pairs are made: n vectors of length 1 with sum s have the mean ``(s.s - n) / (n (n - 1))``.
    """
    names = [f"v{i}" for i in range(LIKENESS_DIMENSIONS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = encoder(vocabulary)
        projection = _projection(tokenizer.n_vocab, LIKENESS_DIMENSIONS, 7)
        for batch in batches:
            for some in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                unit = directions([tokenizer.encode_ordinary(sound(t)) for t in some.column("text").to_pylist()], projection)
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), *[pa.array(c) for c in unit.T]], ["doc_id", *names])

    vectors = spread(documents.where("text <> ''").select("doc_id", "text").dropDuplicates(["doc_id"])).mapInArrow(run, "doc_id bigint, " + ", ".join(f"{n} double" for n in names))
    sums = [F.count("*").alias("n"), *[F.sum(n).alias(n) for n in names]]
    mean = F.try_divide(sum((F.col(n) * F.col(n) for n in names), F.lit(0.0)) - F.col("n"), F.col("n") * (F.col("n") - 1))
    groups = packed.where("piece = 0").join(vectors, "doc_id").groupBy("spec_id", "container_id").agg(*sums).where("n > 1")
    anywhere = vectors.agg(*sums).select(mean.alias("anywhere"))  # one row
    return groups.groupBy("spec_id").agg(F.count("*").alias("containers"), F.avg(mean).alias("inside")).crossJoin(F.broadcast(anywhere))
