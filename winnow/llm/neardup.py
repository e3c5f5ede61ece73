"""Near-duplicate groups by HyperMinHash.

1. A text's set of five-word shingles becomes a fingerprint and a sketch. Texts with equal sets are one node.
2. Nodes that agree in a band of compressed registers share a bucket. A bucket emits links to its smallest node
   alone (a star), never all its pairs. The similarity of a candidate is estimated from the sketches with the
   correction for chance matches, and what may reach the threshold is verified on the full sets.
3. What a star can't settle follows exactly, without a cap. Jaccard distance is a metric, so of a bucket's members
   two that are both linked to its centre are connected already, and one that is linked to the centre and one that
   is far from it can't be similar. The other pairs are estimated and verified one by one in small buckets. Large
   buckets are cut into blocks of members, and the full sets of two blocks are intersected as bitmaps in one task,
   which returns links, not pairs.
4. Components of the verified links, by smallest labels.

Joins of pairs with sketches or sets are sort-merge joins at every size: pairs grow with the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.llm import hyperminhash as hmh
from winnow.llm.components import components
from winnow.llm.shared import fresh, joinable, map_batches, salt_of_nulls, written
from winnow.llm.textscan import blocks

#: Standard errors of an estimate by which a pair may fall short of the threshold and still be verified.
SIGMAS = 5
#: Bytes kept of a shingle's hash for verification: two sets of 1,000 share a false element with probability 4e-9.
WIDTH = 6
#: Members up to which a bucket's unsettled pairs are rows, members in a block of a larger one, shingles in a bitmap.
SMALL_BUCKET, BLOCK, BITMAP = 32, 1024, 1 << 13
#: Pairs of a star that are verified under one key, about.
STAR = 64


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, n, k1, k2, registers) of each row; registers are null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch):
                sets = hmh.shingle_sets(part.column(1))
                marks = np.array([hmh.fingerprint(s) for s in sets], np.int64).reshape(-1, 2)
                registers = [hmh.registers(s).tobytes() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(marks[:, 0]), pa.array(marks[:, 1]), pa.array(registers, pa.binary())], names=["doc_id", "n", "k1", "k2", "registers"])

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, n long, k1 long, k2 long, registers binary")


def _registers(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, hmh.BUCKETS)


def buckets(nodes: DataFrame) -> DataFrame:
    """(key, node): a row for each node and band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 1000):
                part = batch.slice(low, 1000)
                keys = hmh.band_keys(_registers(part.column(1)))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), part.column(0).take(pa.array(np.repeat(np.arange(len(keys)), hmh.BANDS)))], names=["key", "node"])

    return map_batches(nodes.select("node", "registers"), run, "key long, node long")


def estimated(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b, near) of pairs of nodes: the corrected estimate of their similarity; sizes that rule it out give 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 2000):
                part = batch.slice(low, 2000)
                n, m = (part.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
                near = hmh.estimate(_registers(part.column(4)), _registers(part.column(5)), n, m)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(near)], names=["a", "b", "near"])

    side = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("registers").alias(f"r_{x}")).hint("merge")
    joined = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "n_a", "n_b", "r_a", "r_b")
    return map_batches(joined, run, "a long, b long, near double")


def _packed(shingles: np.ndarray) -> bytes:
    return np.unique(shingles >> np.uint64(64 - 8 * WIDTH)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :WIDTH].tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // WIDTH, 8), np.uint8)
    out[:, :WIDTH] = np.frombuffer(data, np.uint8).reshape(-1, WIDTH)
    return out.view("<u8").ravel()


def full_sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, shingles): the whole set of each document in ``nodes``, packed."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([_packed(s) for s in hmh.shingle_sets(part.column(1))], pa.binary())], names=["node", "shingles"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(nodes.select(F.col("node").alias("doc_id")).distinct().hint("merge"), "doc_id", "left_semi")
    return map_batches(texts, sets, "node long, shingles binary").dropDuplicates(["node"])


def verified(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) whose full sets have 100 * intersection >= percent * union."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column(2), batch.column(3)
            same = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x, y = left[i].as_py(), right[i].as_py()
                n, m = len(x) // WIDTH, len(y) // WIDTH
                if 100 * min(n, m) >= percent * max(n, m):
                    both = len(np.intersect1d(_unpacked(x), _unpacked(y), assume_unique=True))
                    same[i] = 100 * both >= percent * (n + m - both)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(same))

    full = full_sets(docs, pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))))
    side = lambda x: full.select(F.col("node").alias(x), F.col("shingles").alias(f"s_{x}")).hint("merge")
    # The centre of a large star is a hot key: its pairs are salted by their other ends, and its set goes to each salt.
    # Written, so that the few large stars are broadcast while they are few, and a hot key's rows of two ids split else.
    large = written(pairs.groupBy("a").agg(F.ceil(F.count("*") / STAR).cast("int").alias("salts")).where("salts > 1"), "large")
    salted = pairs.select("a", "b").join(large, "a", "left").select("a", "b", F.coalesce(F.pmod(F.xxhash64("b"), F.col("salts")), F.lit(0)).alias("salt"))
    left = salted.select("a", "salt").distinct().join(side("a"), "a")
    return map_batches(salted.join(side("b"), "b").join(left.hint("merge"), ["a", "salt"]).select("a", "b", "s_a", "s_b"), compare, "a long, b long")


def _shared(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many elements each set of ``left`` shares with each of ``right``."""
    values, column = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    common = np.bincount(column) > 1  # an element of one set alone is in no intersection
    column = np.where(common[column], np.cumsum(common)[column] - 1, -1)
    row = np.repeat(np.arange(len(left) + len(right)), [len(s) for s in (*left, *right)])
    row, column = row[column >= 0], column[column >= 0]
    out = np.zeros((len(left), len(right)), np.int64)
    for low in range(0, int(common.sum()), BITMAP):
        own = (column >= low) & (column < low + BITMAP)
        width = min(BITMAP, int(common.sum()) - low)
        flags = np.zeros((len(left) + len(right), -(-width // 64) * 64), bool)
        flags[row[own], column[own] - low] = True
        bits = np.packbits(flags, axis=1).view(np.uint64)
        for i in range(len(left)):
            out[i] += np.bitwise_count(bits[len(left) :] & bits[i]).sum(axis=1, dtype=np.int64)
    return out


def _block_links(rows: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """What the links between the members of two blocks (or one) of a bucket connect, but for those its centre has settled."""
    node, side, joined, far = (rows[c].to_numpy() for c in ("node", "side", "joined", "far"))
    sets = [_unpacked(x) for x in rows["shingles"].to_pylist()]
    alone = rows["i"][0].as_py() == rows["j"][0].as_py()
    first, second = (np.flatnonzero(side == 0), np.flatnonzero(side == 0 if alone else side == 1))
    if not len(first) or not len(second):
        return node[:0], node[:0]
    size = np.array([len(s) for s in sets])
    both = _shared([sets[i] for i in first], [sets[i] for i in second])
    alike = 100 * both >= percent * (size[first][:, None] + size[second][None, :] - both)
    settled = (joined[first][:, None] & (joined | far)[second][None, :]) | (far[first][:, None] & joined[second][None, :])
    x, y = np.nonzero(alike & ~settled & (node[first][:, None] != node[second][None, :]))
    return _forest(node[first][x], node[second][y])


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Instead of all links (a, b), each node with the smallest that it reaches over them: the same components."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, label = ends[: len(a)], ends[len(a) :], np.arange(len(nodes))
    while True:
        new = label.copy()
        np.minimum.at(new, x, label[y])
        np.minimum.at(new, y, label[x])
        new = new[new]
        if (new == label).all():
            return nodes[label[label != np.arange(len(nodes))]], nodes[label != np.arange(len(nodes))]
        label = new


def blockwise(members: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """(a, b) for all that links among unsettled members (key, node, joined, far, open) of large buckets connect."""
    cut = members.withColumn("n", F.ceil(F.col("open") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("node"), F.col("n")).cast("int"))
    dealt = cut.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).select("key", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), (F.col("block") > F.col("with")).cast("int").alias("side"), "node", "joined", "far")
    task = ["key", "i", "j"]
    rows = dealt.join(full_sets(docs, members).hint("merge"), "node").repartition(*task).sortWithinPartitions(*task)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done() -> Iterator[pa.RecordBatch]:
            if held:
                a, b = _block_links(pa.Table.from_batches(held), percent)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
                held.clear()

        last = None
        for batch in batches:
            keys = list(zip(*(batch[c].to_pylist() for c in task), strict=True))
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                if high > low:
                    if keys[low] != last:
                        yield from done()
                    last = keys[low]
                    held.append(batch.slice(low, high - low))
        yield from done()

    return map_batches(rows, run, "a long, b long").distinct()


def groups(docs: DataFrame, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row of ``docs``.

    component_id is the smallest doc_id that the document reaches over links, itself included; kept tells whether
    that is its own. A null or empty text, or one without words, has an empty set and is linked with nothing. Rows
    that repeat a doc_id should repeat its text: each is reported, as one document. A null doc_id is linked with
    nothing, has a null component and is kept. doc_id is a whole number; text that spells none is an error.
    """
    level = percent / 100
    error = SIGMAS * (level * (1 - level) / hmh.BUCKETS) ** 0.5
    # A pair of one linked to the centre and one farther than this can't reach the level (triangle inequality).
    apart = max(0.0, 1 - 2 * (1 - level) - error)
    drawn = written(sketches(docs), "sketches")
    sets = ["k1", "k2", "n"]
    nodes = written(drawn.where("n > 0 AND doc_id IS NOT NULL").groupBy(*sets).agg(F.min(F.struct("doc_id", "registers")).alias("first")).select("first.doc_id", *sets, "first.registers").withColumnRenamed("doc_id", "node"), "nodes")
    keyed = written(buckets(nodes), "buckets")
    centres = keyed.groupBy("key").agg(F.count("*").alias("size"), F.min("node").alias("centre")).where("size > 1").select("key", "centre")
    members = written(keyed.join(centres, "key").where("node <> centre"), "members")
    stars = written(estimated(members.select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct(), nodes), "stars")
    linked = written(verified(stars.where(F.col("near") >= level - error), docs, percent), "linked")
    # Each member of a bucket by what its centre tells of it.
    told = stars.join(linked.withColumn("joined", F.lit(True)), ["a", "b"], "left").select(F.col("a").alias("centre"), F.col("b").alias("node"), F.coalesce("joined", F.lit(False)).alias("joined"), (F.col("near") < apart).alias("far"))
    placed = members.join(told.hint("merge"), ["centre", "node"])
    unsettled = placed.groupBy("key").agg(F.count("*").alias("open"), F.sum((~F.col("joined")).cast("int")).alias("apart"), F.max(~F.col("joined") & ~F.col("far")).alias("some_near")).where("apart > 1 OR open > 1 AND some_near")
    left = written(placed.join(unsettled.hint("merge"), "key").where("NOT joined OR some_near"), "left")
    small = left.where(F.col("open") <= SMALL_BUCKET)
    x, y = (small.select("key", F.col("node").alias(i), F.col("joined").alias(f"joined_{i}"), F.col("far").alias(f"far_{i}")) for i in "ab")
    settled = (F.col("joined_a") & (F.col("joined_b") | F.col("far_b"))) | (F.col("far_a") & F.col("joined_b"))
    rest = written(x.join(y.hint("merge"), "key").where((F.col("a") < F.col("b")) & ~settled).select("a", "b").distinct(), "rest")
    near = written(estimated(rest, nodes).where(F.col("near") >= level - error), "near")
    more = written(blockwise(left.where(F.col("open") > SMALL_BUCKET), docs, percent), "more")
    labels = components(linked.unionByName(verified(near, docs, percent)).unionByName(more))
    labelled = nodes.join(labels, "node", "left").select(*sets, F.coalesce("label", "node").alias("label"))
    out = drawn.join(labelled, sets, "left")
    component = F.when(F.col("label").isNull() | F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.col("label"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, percent: int = 75) -> DataFrame:
    """``docs`` with one document of each group: that with the smallest doc_id.

    All columns pass through, whatever they are called. Rows without a doc_id, a text or words stay; rows that repeat
    the doc_id that stays all stay. No documents give none.
    """
    own, salt, none = fresh(docs.columns, "gone", "salt", "none")
    gone = groups(docs, percent).where("NOT kept").select(F.col("doc_id").alias(own), F.lit(0).cast("long").alias(none)).distinct()
    salted = docs.withColumn(salt, salt_of_nulls(F.col("doc_id"), F.col("text")))
    return salted.join(joinable(written(gone, "gone")), (F.col("doc_id") == F.col(own)) & (F.col(salt) == F.col(none)), "left_anti").select(*docs.columns)
