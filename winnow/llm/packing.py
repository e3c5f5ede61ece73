"""Best-fit packing of whole documents into training sequences.

Documents are tokenized on the map side, once; only pieces (ids, lengths, places) are kept. The packing itself is
planned on the histogram of lengths, whose size is the capacity, by linear grouping (see ``grouping``). Each piece
then looks up its place by its rank among the pieces of its length. Ranks come from counts by block and length, so
no length's pieces ever meet in one task; while these counts are few, the pieces themselves aren't exchanged.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from winnow.llm.grouping import Bins, pack
from winnow.llm.pretokens import cache, encode_texts, strings
from winnow.llm.shared import map_batches, written
from winnow.llm.textscan import blocks


def pieces(docs: DataFrame, capacity: int, path: str, with_ids: bool) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, block, nth[, ids]), one row a piece.

    ``block`` is the task that cut the piece and ``nth`` counts its pieces of that length from 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, block = cache(path, False), TaskContext.get().partitionId()
        before = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for part in blocks(batch):
                ids, at = encode_texts(strings(part.column(1)), own)
                size = np.diff(at) + 1
                closed = np.insert(ids, at[1:], 0).astype("<u4")  # id 0 ends each document
                n = -(-size // capacity)
                doc = np.repeat(np.arange(len(size)), n)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                length = np.minimum(capacity, size[doc] - piece * capacity)
                begin = np.repeat(np.cumsum(size) - size, n) + piece * capacity
                crc = [zlib.crc32(closed[a : a + k]) for a, k in zip(begin.tolist(), length.tolist(), strict=True)]
                order = np.argsort(length, kind="stable")
                group = length[order]
                nth = np.empty(len(length), np.int64)
                nth[order] = np.arange(len(group)) - np.searchsorted(group, group)
                nth += before[length]
                before += np.bincount(length, minlength=capacity + 1)
                columns = [part.column(0).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(piece * capacity), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(doc), block), pa.int32()), pa.array(nth)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "block", "nth"]
                if with_ids:
                    columns.append(pa.LargeListArray.from_arrays(np.append(begin, len(closed)), pa.array(closed.astype(np.int32))).cast(pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", "text"), run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, block int, nth long" + ", ids array<int>" * with_ids)


def places(plan: list[Bins]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length, by rank: runs of places as (first rank, first sequence, copies in a sequence, offset of the first)."""
    runs: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    ranks: dict[int, int] = defaultdict(int)
    sequence = 0
    for bins in plan:
        offset = 0
        for length, copies in bins.items:
            runs[length].append((ranks[length], sequence, copies, offset))
            ranks[length] += bins.count * copies
            offset += length * copies
        sequence += bins.count
    return {length: tuple(np.array(x, np.int64) for x in zip(*r, strict=True)) for length, r in runs.items()}


def pack_documents(docs: DataFrame, capacity: int = 2048, path: str | None = None, with_ids: bool = True) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and its ids if asked for.

    A document is its ids and one id 0 at the end; a null or empty text is that id alone. Documents longer than
    ``capacity`` are cut every ``capacity`` ids, the others stay whole. Pieces fill each sequence from 0 without
    gaps. A repeated row is packed as often as it comes. No documents give no pieces.
    """
    spark = docs.sparkSession
    table = written(pieces(docs, capacity, path or public_tokenizers.path("word_bpe_49k.json"), with_ids), "pieces")
    histogram = sorted((r["length"], r["count"]) for r in table.groupBy("length").count().collect())  # a row a length: at most the capacity
    lengths, counts = (np.array(x, np.int64) for x in zip(*histogram, strict=True)) if histogram else (np.zeros(0, np.int64),) * 2
    plan = spark.sparkContext.broadcast(places(pack(lengths, counts, capacity)) if histogram else {})
    by_block = table.groupBy("block", "length").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # Written, so that their size is known before the join is planned: Spark broadcasts them while they are small
    # (spark.sql.autoBroadcastJoinThreshold) and the pieces stay where they are; beyond that both sides are exchanged.
    bases = written(by_block.select("block", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0).cast("long")).alias("base")), "bases")
    ranked = table.join(bases, ["block", "length"]).withColumn("rank", F.col("base") + F.col("nth")).drop("block", "nth", "base")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            cuts = np.flatnonzero(np.diff(length[order], prepend=-1))
            for own in np.split(order, cuts[1:]) if len(order) else []:
                size = int(length[own[0]])
                first, sequences, copies, offsets = plan.value[size]
                run = np.searchsorted(first, rank[own], "right") - 1
                inside = rank[own] - first[run]
                sequence[own] = sequences[run] + inside // copies[run]
                offset[own] = offsets[run] + inside % copies[run] * size
            yield batch.drop_columns(["rank"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    order = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.select(*order).schema)
    return map_batches(ranked.select(*order, "rank"), place, f"{fields}, sequence_id long, offset long")
