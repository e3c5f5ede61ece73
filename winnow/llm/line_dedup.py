"""Line de-duplication over range-partitioned line hashes [native].

Every line's key is hashed to 128 bits. The hash rows are range-partitioned by (hash, document), with a secondary
sort by document and position, so a key that holds a third of all rows is cut into ranges of documents instead of
meeting in one task. A window streams over the sorted ranges, without another exchange or sort, and lets the first
occurrence of each key in each document through; these are counted. Only per-document bitmaps of the lines to drop
leave the operator, without the words that are zero; texts never take part in the exchange of the hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from winnow.llm.shared import BLANKS, ascii_lower, fresh, salt_of_nulls, shuffle_partitions, text_keys, written


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, pos, h1, h2) of each line whose key has at least ``min_chars`` code points, but of rows without a doc_id."""
    lines = docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
    stripped = lines.select("doc_id", "pos", F.btrim("line", F.lit(BLANKS)).alias("line")).where(F.length("line") >= min_chars)
    h1, h2 = text_keys(ascii_lower(F.col("line")))
    return stripped.select("doc_id", "pos", h1.alias("h1"), h2.alias("h2"))


def first_occurrences(hashes: DataFrame) -> DataFrame:
    """Of the lines of each key in each document the first, streamed from sorted ranges."""
    order = ["h1", "h2", "doc_id", "pos"]
    ranged = hashes.repartitionByRange(shuffle_partitions(hashes.sparkSession), *order[:3]).sortWithinPartitions(*order)
    return ranged.withColumn("nth", F.row_number().over(Window.partitionBy(*order[:3]).orderBy("pos"))).where("nth = 1").drop("nth")


def drop_bitmaps(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """(doc_id, bitmap): the lines to drop of each document that loses any.

    ``bitmap`` is compressed: sorted (word, bits), the number of a 64-line word and its bits, without the words that
    are zero. Documents that keep all lines have no row. A key found in ``min_docs`` documents or more keeps only its
    lines in the largest doc_id that holds it.

    Rows that repeat a doc_id count as one document and should repeat its text. A row without a doc_id loses no line
    and isn't counted as a document. No documents give no rows.
    """
    hashes = written(line_hashes(docs.select("doc_id", "text"), min_chars), "line_hashes")
    # At most one row a key and task is exchanged here, however many documents hold the key.
    counted = first_occurrences(hashes).groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keeper")).where(F.col("n_docs") >= min_docs)
    # Written, so that the join has exchanges of its own on both sides and may split a key with very many documents.
    repeated = written(counted.select("h1", "h2", "keeper"), "repeated")
    lost = hashes.join(repeated, ["h1", "h2"]).where(F.col("doc_id") != F.col("keeper")).select("doc_id", "pos")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("pos").bitwiseAND(F.lit(63)))
    # Both steps find a document's rows together after one exchange.
    by_word = lost.repartition("doc_id").groupBy("doc_id", F.shiftright("pos", 6).alias("word")).agg(F.bit_or(bit).alias("bits"))
    return by_word.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("bitmap"))


def _dense(bitmap: Column) -> Column:
    """The bits of all words up to the last, so that each is found by its number."""
    gap = lambda e, i: e["word"] - F.coalesce(F.get(bitmap, i - 1)["word"], F.lit(-1)) - 1
    return F.flatten(F.transform(bitmap, lambda e, i: F.concat(F.array_repeat(F.lit(0).cast("long"), gap(e, i)), F.array(e["bits"]))))


def _stays(dense: Column, pos: Column) -> Column:
    word = F.coalesce(F.get(dense, F.shiftright(pos, 6)), F.lit(0).cast("long"))
    return F.call_function("shiftright", word, pos.bitwiseAND(F.lit(63))).bitwiseAND(F.lit(1)) == 0


def _marked(docs: DataFrame, bitmaps: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with one more column, the bitmap, and its name."""
    own, mark, salt, none = fresh(docs.columns, "own_id", "bitmap", "salt", "none")
    marks = bitmaps.select(F.col("doc_id").alias(own), F.col("bitmap").alias(mark), F.lit(0).cast("long").alias(none))
    salted = docs.withColumn(salt, salt_of_nulls(F.col("doc_id"), F.col("text")))
    joined = salted.join(marks.hint("shuffle_hash"), (F.col("doc_id") == F.col(own)) & (F.col(salt) == F.col(none)), "left")
    return joined.drop(own, salt, none), mark


def _kept(text: Column, bitmap: Column) -> Column:
    # An array of one, so that the lines and the bits are worked out once and not for each line.
    bound = F.array(F.struct(_lines(text).alias("lines"), _dense(bitmap).alias("dense")))
    left = F.transform(bound, lambda b: F.filter(b["lines"], lambda line, i: _stays(b["dense"], i)))
    return F.when(bitmap.isNull(), F.coalesce(text, F.lit(""))).otherwise(F.array_join(F.get(left, F.lit(0)), "\n"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``docs`` with ``text`` rebuilt from the kept lines; all other columns stay as they are, whatever they are called.

    A null text is one empty line. A document all of whose lines go keeps an empty text.
    """
    marked, mark = _marked(docs, bitmaps)
    return marked.withColumn("text", _kept(F.col("text"), F.col(mark))).select(*docs.columns)


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """``docs`` without the repeated lines: see :func:`drop_bitmaps` for which lines go."""
    return apply_bitmaps(docs, drop_bitmaps(docs, min_chars, min_docs))


def report(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) of each row of ``docs``."""
    marked, mark = _marked(docs.select("doc_id", "text"), drop_bitmaps(docs, min_chars, min_docs))
    n_dropped = F.aggregate(mark, F.lit(0).cast("long"), lambda acc, w: acc + F.bit_count(w["bits"]))
    return marked.select(
        "doc_id", F.size(_lines(F.col("text"))).cast("long").alias("n_lines"),
        F.when(F.col(mark).isNull(), F.lit(0).cast("long")).otherwise(n_dropped).alias("n_dropped"),
        F.sha2(_kept(F.col("text"), F.col(mark)), 256).alias("kept_sha256"),
    )
