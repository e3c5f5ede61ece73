"""Benchmark decontamination with a broadcast hash set of normalised n-grams [native].

Each document's words are exploded inside one generated stage; a row's n-gram hash probes the broadcast table of
benchmark n-grams, and the words themselves are compared on a hit. Neither words nor n-grams are shuffled: what
leaves the stage is one row a document and one a hit. The table names the items that hold an n-gram by a key of their
set; the sets are a table of their own, which only documents with hits are joined with.

A benchmark with more n-grams than may be broadcast with their words is broadcast as hashes alone, many to a block and
one scan a block. Only words whose hash is found leave that scan, with their n-gram, and meet the benchmark in a join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnow.llm.shared import ALNUM_WORD, ascii_lower, fresh, joinable, text_keys, written

#: Of n-grams in one broadcast, and of the bytes of their words with what a row takes beside them.
MAX_BROADCAST_GRAMS, MAX_BROADCAST_BYTES, ROW_BYTES = 1_000_000, 1 << 28, 64
#: Of hashes alone in one broadcast: at some 64 bytes each, 256 MB.
MAX_BROADCAST_HASHES = 4_000_000
#: Copies of one row that are made at a time.
COPIES = 4096


def words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(text), F.lit(ALNUM_WORD), F.lit(0))


def _gram_hash(array: Column, at: Column, n: int) -> Column:
    return F.xxhash64(*[F.get(array, at + i) for i in range(n)])


def benchmark_grams(benchmark: DataFrame, n: int = 13) -> DataFrame:
    """(n, gram, items, s1, s2): the distinct windows of the benchmark, the items that hold each, and a key of that set.

    An item of fewer than ``n`` words is one window; one without words, or with a null text, has none.
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.coalesce("text", F.lit(""))).alias("words")).where(F.size("words") > 0)
    size = F.least(F.size("words"), F.lit(n))
    grams = items.select("item", size.alias("n"), F.explode(F.transform(F.sequence(F.lit(1), F.size("words") - size + 1), lambda i: F.slice("words", i, size))).alias("gram"))
    held = grams.groupBy("n", "gram").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return held.select("n", "gram", "items", F.xxhash64("items").alias("s1"), F.xxhash64(F.lit(7), "items").alias("s2"))


def scanned(docs: DataFrame, benchmark: DataFrame, n: int = 13) -> tuple[DataFrame, DataFrame]:
    """What is found in ``docs``, and the item sets (s1, s2, items) that it names.

    Found: per distinct doc_id and text, with the text's keys h1 and h2, the number of such rows (copies), n_words,
    spans (sorted [start, end) word ranges of the windows found) and sets (the keys of the item sets found). Rows that
    agree in doc_id and text have the same words, so no row needs a number of its own.
    """
    grams = written(benchmark_grams(benchmark, n), "grams")
    sizes = grams.groupBy("n").agg(F.count("*").alias("count"), F.sum(F.octet_length(F.array_join("gram", " ")) + ROW_BYTES).alias("bytes")).orderBy("n").collect()  # n rows at most
    total = sum(r["count"] for r in sizes)
    whole = total <= MAX_BROADCAST_GRAMS and sum(r["bytes"] for r in sizes) <= MAX_BROADCAST_BYTES
    lengths = [r["n"] for r in sizes] or [n]
    h1, h2 = text_keys(F.col("text"))
    texts = docs.select("doc_id", h1.alias("h1"), h2.alias("h2"), words(F.coalesce("text", F.lit(""))).alias("words"))
    # The null at the end is a row that always passes: it carries n_words.
    rows = texts.select("doc_id", "h1", "h2", "words", F.posexplode(F.concat("words", F.array(F.lit(None).cast("string")))).alias("pos", "word"))
    if len(lengths) == 1:
        probes = rows.select("doc_id", "h1", "h2", "words", "pos", F.lit(lengths[0]).alias("len"), _gram_hash(F.col("words"), F.col("pos"), lengths[0]).alias("hash"))
    else:
        each = F.array(*[F.struct(F.lit(k).alias("len"), _gram_hash(F.col("words"), F.col("pos"), k).alias("hash")) for k in lengths])
        probes = rows.select("doc_id", "h1", "h2", "words", "pos", F.explode(each).alias("p")).select("doc_id", "h1", "h2", "words", "pos", "p.len", "p.hash")
    # The null row comes once for each length, and counts once.
    last = (F.col("pos") == F.size("words")) & (F.col("len") == lengths[0])
    table = grams.select(F.col("n").alias("g_len"), "gram", "s1", "s2", reduce(lambda done, k: F.when(F.col("n") == k, _gram_hash(F.col("gram"), F.lit(0), k)).otherwise(done), lengths, F.lit(None).cast("long")).alias("g_hash"))
    here = F.slice("words", F.col("pos") + 1, F.col("len"))
    span = F.struct(F.col("pos").alias("start"), (F.col("pos") + F.col("len")).alias("end"))
    if whole:
        hit = F.col("gram").isNotNull()
        joined = probes.join(F.broadcast(table), (F.col("hash") == F.col("g_hash")) & (F.col("len") == F.col("g_len")) & (here == F.col("gram")), "left").where(last | hit)
        found = joined.select("doc_id", "h1", "h2", F.when(last, F.col("pos")).alias("n_words"), F.when(hit, span).alias("span"), F.when(hit, F.struct("s1", "s2")).alias("set"))
    else:
        found = _by_hashes(probes, table, total, last, here, span)
    merged = found.groupBy("doc_id", "h1", "h2").agg(
        F.count("n_words").alias("copies"), F.max("n_words").cast("long").alias("n_words"),
        F.array_sort(F.collect_set("span")).alias("spans"), F.collect_set("set").alias("sets"),
    )
    return merged, grams.groupBy("s1", "s2").agg(F.first("items").alias("items"))


def _by_hashes(probes: DataFrame, table: DataFrame, total: int, last: Column, here: Column, span: Column) -> DataFrame:
    """The rows (doc_id, h1, h2, n_words, span, set) of a benchmark whose words aren't broadcast."""
    blocks = -(-total // MAX_BROADCAST_HASHES)
    known = F.col("known").isNotNull()
    each = []
    for b in range(blocks):
        hashes = table.where(F.pmod("g_hash", F.lit(blocks)) == b).select(F.col("g_hash").alias("known")).distinct()
        rows = probes.join(F.broadcast(hashes), F.col("hash") == F.col("known"), "left").where(last | known if b == 0 else known)
        n_words = F.when(last, F.col("pos")) if b == 0 else F.lit(None).cast("int")
        each.append(rows.select("doc_id", "h1", "h2", n_words.alias("n_words"), "hash", "len", F.when(known, here).alias("own"), span.alias("span")))
    # Written, so that the corpus is read once a block, and the join may split an n-gram that very many documents hold.
    kept = written(reduce(DataFrame.unionByName, each), "candidates")
    same = (F.col("hash") == F.col("g_hash")) & (F.col("len") == F.col("g_len")) & (F.col("own") == F.col("gram"))
    real = kept.where("own IS NOT NULL").join(table, same).select("doc_id", "h1", "h2", F.lit(None).cast("int").alias("n_words"), "span", F.struct("s1", "s2").alias("set"))
    counts = kept.where("n_words IS NOT NULL").select("doc_id", "h1", "h2", "n_words", F.lit(None).cast(real.schema["span"].dataType).alias("span"), F.lit(None).cast(real.schema["set"].dataType).alias("set"))
    return real.unionByName(counts)


def hits(docs: DataFrame, benchmark: DataFrame, n: int = 13) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, spans and items, the ids of the items found, sorted as strings."""
    found, sets = scanned(docs, benchmark, n)
    found = written(found, "found")
    none = found.where(F.size("sets") == 0).select("doc_id", "copies", "n_words", "spans", F.array().cast("array<string>").alias("items"))
    named = found.where(F.size("sets") > 0).select("doc_id", "h1", "h2", "copies", "n_words", "spans", F.explode("sets").alias("set")).select("*", "set.s1", "set.s2").join(sets, ["s1", "s2"])
    items = F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")
    some = named.groupBy("doc_id", "h1", "h2").agg(*[F.first(c).alias(c) for c in ("copies", "n_words", "spans")], items).drop("h1", "h2")
    each = none.unionByName(some).withColumn("low", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(COPIES).cast("long"))))
    repeated = F.array_repeat(F.lit(True), F.least(F.lit(COPIES).cast("long"), F.col("copies") - F.col("low")).cast("int"))
    return each.withColumn("row", F.explode(repeated)).select("doc_id", "n_words", "spans", "items")


def joined_spans(spans: Column) -> Column:
    """Sorted spans, with those that overlap or touch made one."""
    last = lambda done: F.get(done, F.size(done) - 1)
    longer = lambda done, s: F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last(done)["start"].alias("start"), F.greatest(last(done)["end"], s["end"]).alias("end"))))
    step = lambda done, s: F.when((F.size(done) > 0) & (last(done)["end"] >= s["start"]), longer(done, s)).otherwise(F.concat(done, F.array(s)))
    return F.aggregate(spans, F.array().cast("array<struct<start:int,end:int>>"), step)


def n_hit(spans: Column) -> Column:
    """How many words lie in the union of sorted spans."""
    return F.aggregate(joined_spans(spans), F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def _contaminated(n_hit: Column, n_words: Column) -> Column:
    return (n_hit > 0) & (20 * n_hit >= n_words)


def report(docs: DataFrame, benchmark: DataFrame, n: int = 13) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and the spans.

    A null text has no words; a repeated row is reported as often as it comes; a null doc_id is a document too. An
    empty benchmark hits nothing, and no documents give no rows.
    """
    counted = hits(docs, benchmark, n).withColumn("n_hit", n_hit(F.col("spans")))
    return counted.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        _contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"), "spans",
    )


def cut_spans(text: Column, spans: Column) -> Column:
    """``text`` without the words in ``spans`` and what stands before each of them."""
    gap = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
    pieces = F.regexp_extract_all(text, F.lit(f"{gap}*(?:{_cased(ALNUM_WORD)}|$)"), F.lit(0))
    return F.array_join(F.filter(pieces, lambda p, i: ~F.exists(spans, lambda s: (s["start"] <= i) & (i < s["end"]))), "")


def _cased(pattern: str) -> str:
    """The word pattern over texts that are not lower-cased: A-Z are letters too."""
    return pattern.replace(r"\x3A-\x60", r"\x3A-\x40\x5B-\x60")


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 13) -> DataFrame:
    """``docs`` without contaminated documents, and without the benchmark passages of the others.

    Rows keep their columns, whatever these are called; a document without hits keeps its text untouched. Each row has
    the verdict and the passages of its own text, also where several rows share a doc_id or have none. Null and empty
    texts stay as they are.
    """
    k1, k2, m1, m2, key, bad, spans = fresh(docs.columns, "h1", "h2", "own_h1", "own_h2", "own_id", "bad", "spans")
    found = scanned(docs, benchmark, n)[0].where(F.size("spans") > 0)
    marks = written(found.select(F.col("doc_id").alias(key), F.col("h1").alias(m1), F.col("h2").alias(m2), _contaminated(n_hit(F.col("spans")), F.col("n_words")).alias(bad), joined_spans(F.col("spans")).alias(spans)), "marks")
    keyed = docs.withColumns(dict(zip((k1, k2), text_keys(F.col("text")), strict=True)))
    same = (F.col(k1) == F.col(m1)) & (F.col(k2) == F.col(m2)) & F.col("doc_id").eqNullSafe(F.col(key))
    joined = keyed.join(joinable(marks), same, "left")
    text = F.when(F.col(spans).isNull(), F.col("text")).otherwise(cut_spans(F.col("text"), F.col(spans)))
    return joined.where(~F.coalesce(bad, F.lit(False))).withColumn("text", text).select(*docs.columns)
