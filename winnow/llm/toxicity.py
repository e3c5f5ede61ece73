"""Toxicity scores of whole texts by a convolutional classifier with thresholds calibrated by language.

The classifier is fitted in tasks to every labelled row that may be learned from; every ``CALIBRATES``-th of them, by a hash
of its id, sets thresholds instead of embeddings and filters. Its inputs are a text's words alone. The language that picks a
threshold is told from the text's own function words.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from winnow.llm import textcnn
from winnow.llm.shared import drawn_by_hash, fresh, joinable, map_batches, written
from winnow.llm.textscan import ALPHANUMERIC, Words, blocks

#: Every so many-th labelled row calibrates thresholds instead of training.
CALIBRATES = 4
#: Rows trained on are dealt over shares of about so many, one a task, until there are MOST_SHARES; then shares grow.
SHARE_ROWS, MOST_SHARES = 4000, 8
#: While no more ids are labelled, their hashes and labels are broadcast (9 bytes each); beyond, texts and labels are joined.
BROADCAST_IDS = 8_000_000
#: Embeddings travel in blocks of so many, so that no message or group is larger than a block of each share.
EMBEDDINGS = 1 << 12
#: Texts are scored for thresholds about so many words at a time.
BLOCK_WORDS = 1 << 17
#: Logits are counted for thresholds in steps of 1 / STEPS between -LARGEST and LARGEST, where scores are 0 and 1.
STEPS, LARGEST = 1024, 64
#: Bound of :func:`labelled_sample` alone: words of all rows of a class together.
MAX_WORDS = 2_000_000
#: Positive rows that a language needs to have a threshold of its own.
OWN_THRESHOLD = 20

#: Frequent function words by language.
FUNCTION_WORDS = {
    "en": "the of and to in is that it for was with as on be at by this are from not".split(),
    "fr": "le la les et des une est que dans pour qui du un par sur pas en ce au avec".split(),
    "de": "der die und das ist nicht den mit ein zu von auf im sich dem des eine auch als es".split(),
    "es": "el los las y del una por con para como que se su al lo es no más un".split(),
}
LANGUAGES = [*FUNCTION_WORDS, "other"]


def is_held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from: crc32 of the id's text is divisible by 5."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def _language_table() -> np.ndarray:
    """By word bucket: a bit for each language that has the word as a function word."""
    table = np.zeros(1 << textcnn.BUCKET_BITS, np.uint8)
    for i, words in enumerate(FUNCTION_WORDS.values()):
        np.bitwise_or.at(table, textcnn.buckets(Words(pa.array(words), ALPHANUMERIC).hashes()), np.uint8(1 << i))
    return table


def languages(words: np.ndarray, first: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The number of each text's language in LANGUAGES: that with the most function words, else the last."""
    bits = table[words]
    place = np.flatnonzero(bits)
    doc = np.searchsorted(first, place, "right") - 1
    counts = np.stack([np.bincount(doc, weights=(bits[place] >> i) & 1, minlength=len(first) - 1) for i in range(len(FUNCTION_WORDS))], axis=1)
    return np.where(counts.max(axis=1) > 0, counts.argmax(axis=1), len(FUNCTION_WORDS))


def learnable(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) of each id that may be learned from; one with several labels is toxic if any says so."""
    return labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))


def labelled_sample(docs: DataFrame, labels: DataFrame, per_class: int) -> tuple[list[np.ndarray], np.ndarray, float]:
    """Word features and labels of a bounded sample, in an order of their own, and the share of toxic rows in all labels learned from.

    For looking at what is learned from: nothing is fitted to it. Rows are taken in the order of their hashes, ``per_class`` of
    each class and while they fit in MAX_WORDS, the first one in any case. Repeated ids count as in :func:`labelled_features`.
    """
    known = learnable(labels)
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    sample = drawn_by_hash(known.where("toxic = 1"), "doc_id", per_class, counts.get(1, 0)).unionByName(drawn_by_hash(known.where("toxic = 0"), "doc_id", per_class, counts.get(0, 0)))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch):
                words = Words(part.column(2), ALPHANUMERIC)
                ids = textcnn.features(words)
                cut = [ids[a:b].astype("<i4").tobytes() for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.diff(words.first)), pa.array(cut, pa.binary())], names=["at", "toxic", "n", "words"])

    # Of bounded size: 2 * per_class ids.
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    drawn = written(map_batches(texts.select(F.xxhash64("doc_id").alias("at"), "toxic", "text"), hashed, "at long, toxic int, n long, words binary"), "sample")
    fits = F.lit(False)
    sizes = sorted((r["at"], r["n"], r["toxic"]) for r in drawn.select("at", "n", "toxic").collect())
    for label in (0, 1):
        at, n = (np.array([r[i] for r in sizes if r[2] == label], np.int64) for i in (0, 1))
        if len(at):
            fits = fits | (F.col("toxic") == label) & (F.col("at") <= int(at[max(0, int((np.cumsum(n) <= MAX_WORDS).sum()) - 1)]))
    rows = drawn.where(fits).select("at", "toxic", "words").collect()
    rows.sort(key=lambda r: (r["at"], r["words"]))
    total = sum(counts.values())
    return [np.frombuffer(r["words"], "<i4").reshape(-1, 1 + len(textcnn.PREFIXES)) for r in rows], np.array([r["toxic"] for r in rows]), counts.get(1, 0) / total if total else 0.0


def _with_labels(texts: DataFrame, known: DataFrame) -> DataFrame:
    """``texts`` of known ids with their labels, looked up by the hashes of ids, so that no other text is exchanged.

    xxhash64 gives different integers different hashes; of other ids a stranger is taken for a known one with probability
    n / 2**64.
    """
    table = known.select(F.xxhash64("doc_id").alias("at"), F.col("toxic").cast("byte").alias("toxic")).toArrow()  # at most BROADCAST_IDS
    ids, toxic = table["at"].to_numpy(), table["toxic"].to_numpy()
    order = np.argsort(ids)
    shared = known.sparkSession.sparkContext.broadcast((ids[order], toxic[order]))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, toxic = shared.value
        for batch in batches:
            at = batch.column(0).to_numpy()
            place = np.minimum(np.searchsorted(ids, at), len(ids) - 1)
            hit = ids[place] == at
            yield batch.filter(pa.array(hit)).append_column("toxic", pa.array(toxic[place[hit]].astype(np.int32)))

    return map_batches(texts, found, T.StructType([*texts.schema.fields, T.StructField("toxic", T.IntegerType())]))


def labelled_features(docs: DataFrame, known: DataFrame, n: int) -> DataFrame:
    """(calibrates, toxic, words) of every labelled document, a file for each share of them, in the order of their ids' hashes.

    A doc_id that several rows have counts once, by the smallest of its texts. ``known`` is a written table of ``n`` rows.
    """
    shares = int(np.clip(-(-n * (CALIBRATES - 1) // (CALIBRATES * SHARE_ROWS)), 1, MOST_SHARES))
    calibrates = F.pmod(F.xxhash64(F.lit(CALIBRATES), "doc_id"), F.lit(CALIBRATES)) == 0
    texts = docs.where(F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id")))
    if 0 < n <= BROADCAST_IDS and docs.schema["doc_id"].dataType == known.schema["doc_id"].dataType:
        rows = _with_labels(texts.select(F.xxhash64("doc_id").alias("at"), F.col("doc_id").cast("string").alias("key"), calibrates.alias("calibrates"), "text"), known)
    else:
        rows = texts.select("doc_id", "text").join(joinable(known), "doc_id").select(F.xxhash64("doc_id").alias("at"), F.col("doc_id").cast("string").alias("key"), calibrates.alias("calibrates"), "text", "toxic")
    # Dealt by ``at``, since an exchange by doc_id itself may be left out after a join.
    rows = rows.repartition(shares, "at").sortWithinPartitions("at", "key", F.col("text").asc_nulls_last())

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            ids = batch.column(0)
            if not len(ids):
                continue
            new = np.ones(len(ids), bool)
            new[1:] = pc.not_equal(ids.slice(1), ids.slice(0, len(ids) - 1)).to_numpy(zero_copy_only=False)
            new[0], last = ids[0].as_py() != last, ids[len(ids) - 1].as_py()
            for part in blocks(batch.filter(pa.array(new))):
                words = Words(part.column(3), ALPHANUMERIC)
                features = textcnn.features(words).astype("<i4")
                cut = [features[a:b].tobytes() for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), pa.array(cut, pa.binary())], names=["calibrates", "toxic", "words"])

    return written(map_batches(rows.select("key", "calibrates", "toxic", "text"), hashed, "calibrates boolean, toxic int, words binary"), "labelled")


def _texts(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(w, "<i4").reshape(-1, 1 + len(textcnn.PREFIXES)) for w in batch.column(batch.schema.get_field_index("words")).to_pylist()]


def known_buckets(rows: DataFrame) -> np.ndarray:
    """Which buckets LEAST_TEXTS texts hold; counts of all rows, added up by bucket."""

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(1 << textcnn.BUCKET_BITS, np.int64)
        for batch in batches:
            for t in _texts(batch):
                n[np.unique(t)] += 1
        found = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(n[found])], names=["bucket", "n"])

    counts = map_batches(rows.select("words"), held, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    known = np.zeros(1 << textcnn.BUCKET_BITS, bool)
    # One number for each bucket at most.
    known[counts.where(F.col("n") >= textcnn.LEAST_TEXTS).select("bucket").toArrow()["bucket"].to_numpy()] = True
    known[0] = False  # of words that are too short for a prefix
    return known


def _mean(table: pa.Table) -> pa.Table:
    """Of one block as the shares left it: embeddings are means over the shares that have moved them, all else over texts."""
    parts = sorted(table.to_pylist(), key=lambda r: (r["n"], r["at"], r["vectors"]))  # sums don't depend on the order of arrival
    block = parts[0]["block"]
    if block < 0:
        total = sum(r["n"] * np.frombuffer(r["vectors"], np.float64) for r in parts) / sum(r["n"] for r in parts)
        return pa.Table.from_pydict({"block": [block], "n": [0], "at": [b""], "vectors": [total.tobytes()], "squares": [b""]}, _MIXED)
    times, vectors, squares = np.zeros(EMBEDDINGS), np.zeros((EMBEDDINGS, textcnn.DIM)), np.zeros(EMBEDDINGS)
    for r in parts:
        at = np.frombuffer(r["at"], np.int32)
        times[at] += 1
        vectors[at] += np.frombuffer(r["vectors"], np.float32).reshape(-1, textcnn.DIM)
        squares[at] += np.frombuffer(r["squares"], np.float32)
    at = np.flatnonzero(times).astype(np.int32)
    vectors, squares = (vectors[at] / times[at, None]).astype(np.float32), (squares[at] / times[at]).astype(np.float32)
    return pa.Table.from_pydict({"block": [block], "n": [0], "at": [at.tobytes()], "vectors": [vectors.tobytes()], "squares": [squares.tobytes()]}, _MIXED)


_MIXED = pa.schema([("block", pa.int32()), ("n", pa.int64()), ("at", pa.binary()), ("vectors", pa.binary()), ("squares", pa.binary())])


def _round(rows: DataFrame, model: textcnn.Model, sums: textcnn.Sums, balance: dict[int, float], seed: int) -> None:
    """One pass over all ``rows``: each share goes on from the same classifier, and what they make of it is averaged."""
    state = rows.sparkSession.sparkContext.broadcast((model, sums))  # of fixed size: 2**BUCKET_BITS embeddings

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, n = state.value, 0
        model, sums = copy.deepcopy(before)
        for i, batch in enumerate(batches):
            labels = batch.column(batch.schema.get_field_index("toxic")).to_numpy(zero_copy_only=False)
            textcnn.learn(model, sums, [model.row[t] for t in _texts(batch)], labels, balance, np.random.default_rng([seed, i]))
            n += len(labels)
        if not n:
            return
        yield pa.RecordBatch.from_pydict({"block": [-1], "n": [n], "at": [b""], "vectors": [textcnn.dense_of(model, sums).tobytes()], "squares": [b""]}, _MIXED)
        moved = np.flatnonzero(sums.squares != before[1].squares)
        for block in np.unique(moved // EMBEDDINGS).tolist():
            mine = moved[moved // EMBEDDINGS == block]
            yield pa.RecordBatch.from_pydict({"block": [block], "n": [n], "at": [(mine - block * EMBEDDINGS).astype(np.int32).tobytes()], "vectors": [model.embedding[mine].tobytes()], "squares": [sums.squares[mine].tobytes()]}, _MIXED)

    kinds = "block int, n long, at binary, vectors binary, squares binary"
    # A block for each EMBEDDINGS of the classifier.
    for r in map_batches(rows.select("toxic", "words"), run, kinds).groupBy("block").applyInArrow(_mean, kinds).collect():
        if r["block"] < 0:
            textcnn.set_dense(model, sums, np.frombuffer(r["vectors"], np.float64))
        else:
            at = np.frombuffer(r["at"], np.int32) + r["block"] * EMBEDDINGS
            model.embedding[at] = np.frombuffer(r["vectors"], np.float32).reshape(-1, textcnn.DIM)
            sums.squares[at] = np.frombuffer(r["squares"], np.float32)
    state.destroy()


def _best_threshold(z: np.ndarray, toxic: np.ndarray, clean: np.ndarray, share: float) -> float:
    """The middle of the widest gap among cuts with the fewest errors, where the classes weigh as in all labels.

    ``z`` are different logits in ascending order, ``toxic`` and ``clean`` the numbers of texts that have each.
    """
    missed = np.concatenate([[0], np.cumsum(toxic)]) * (share / max(toxic.sum(), 1))
    wrong = np.concatenate([np.cumsum(clean[::-1])[::-1], [0]]) * ((1 - share) / max(clean.sum(), 1))
    errors = missed + wrong
    edges = np.concatenate([[z[0] - 1], (z[1:] + z[:-1]) / 2, [z[-1] + 1]])
    gaps = np.concatenate([[0], np.diff(z), [0]])
    best = np.flatnonzero(errors <= errors.min() + 1e-12)
    return float(edges[best[np.argmax(gaps[best])]])


def _calibrate(rows: DataFrame, model: textcnn.Model, share: float) -> None:
    """Sets the thresholds by the logits of all ``rows``, counted by language and step."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, table = shared.value, _language_table()
        for batch in batches:
            texts = _texts(batch)
            size = np.cumsum([len(t) for t in texts]) // BLOCK_WORDS
            for low, high in zip(*(np.searchsorted(size, np.unique(size), side) for side in ("left", "right")), strict=True):
                part, toxic = texts[low:high], batch.column(batch.schema.get_field_index("toxic")).slice(low, high - low)
                words, first = np.concatenate(part), np.concatenate([[0], np.cumsum([len(t) for t in part])])
                step = np.rint(np.clip(model.logits(words, first), -LARGEST, LARGEST) * STEPS).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(languages(words[:, 0], first, table).astype(np.int32)), pa.array(step), toxic], names=["language", "step", "toxic"])

    toxic = F.col("toxic").cast("long")
    counts = map_batches(rows.select("toxic", "words"), run, "language int, step int, toxic int").groupBy("language", "step").agg(F.sum(toxic).alias("toxic"), F.sum(1 - toxic).alias("clean"))
    # A row for each language and step at most.
    table = counts.orderBy("step", "language").toArrow()
    language, step, toxic, clean = (table[c].to_numpy() for c in ("language", "step", "toxic", "clean"))
    if toxic.sum() and clean.sum():
        z, at = np.unique(step, return_inverse=True)
        model.threshold = dict.fromkeys(LANGUAGES, _best_threshold(z / STEPS, np.bincount(at, toxic), np.bincount(at, clean), share))
        for i, name in enumerate(LANGUAGES):
            mine = language == i
            if toxic[mine].sum() >= OWN_THRESHOLD and clean[mine].sum() >= OWN_THRESHOLD:
                model.threshold[name] = _best_threshold(step[mine] / STEPS, toxic[mine], clean[mine], share)
    shared.destroy()


def fit(docs: DataFrame, labels: DataFrame) -> textcnn.Model:
    """The classifier, with the logit threshold of each language. Without labelled rows of both classes nothing is toxic.

    Every labelled row is learned from, in EPOCHS rounds over all shares. Where there are several, the first share goes ahead
    alone, so that filters mean the same in all shares when they are averaged.
    """
    known = written(learnable(labels), "labels")
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    total = sum(counts.values())
    rows = labelled_features(docs, known, total)
    trained = rows.where("NOT calibrates")
    n = {r["toxic"]: r["count"] for r in trained.groupBy("toxic").count().collect()}
    rng = np.random.default_rng(11)
    model, sums = textcnn.start(known_buckets(trained), rng)
    both = bool(n.get(1) and n.get(0))
    model.threshold = dict.fromkeys(LANGUAGES, 0.0 if both else 1e9)
    if not both:
        return model
    # A file is read by itself, so that a share is the same whatever the cluster's cores; MOST_SHARES scans at most.
    files = sorted(f.rsplit("/", 1)[1] for f in rows.inputFiles())
    shares = [trained.where(F.col("_metadata.file_name").isin(files[i::MOST_SHARES])) for i in range(min(len(files), MOST_SHARES))]
    passes = [*shares[:1] * (len(shares) > 1), *[reduce(DataFrame.unionAll, shares)] * textcnn.EPOCHS]
    for i, part in enumerate(passes):
        _round(part, model, sums, textcnn.balance_of(n[1] / (n[0] + n[1])), i)
    _calibrate(rows.where("calibrates"), model, counts.get(1, 0) / total)
    return model


def score(docs: DataFrame, model: textcnn.Model, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """``docs`` with two more columns: the score (0 to 1), and 1 if it is 0.5 or more, else 0.

    A null or empty text is scored as one unknown word; repeated rows get equal scores. All columns pass through: if one
    has a name of the new ones, whatever its case, a ValueError says so.
    """
    if fresh(docs.columns, *names) != list(names):
        raise ValueError(f"The rows have a column named {' or '.join(names)} already; give other names")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size: 2**BUCKET_BITS embeddings

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, table = shared.value, _language_table()
        cut = np.array([model.threshold[x] for x in LANGUAGES])
        for batch in batches:
            for part in blocks(batch):
                words = Words(part.column(part.schema.get_field_index("text")), ALPHANUMERIC)
                ids = textcnn.features(words)
                above = model.logits(ids, words.first) - cut[languages(ids[:, 0], words.first, table)]
                value = 1 / (1 + np.exp(-np.clip(above, -500, 500)))
                yield part.append_column(names[0], pa.array(value)).append_column(names[1], pa.array((value >= 0.5).astype(np.int32)))

    more = [T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.IntegerType())]
    return map_batches(docs, run, T.StructType([*docs.schema.fields, *more]))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row; a null doc_id isn't held out."""
    scored = score(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select("doc_id", F.coalesce(is_held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without those that are predicted toxic.

    Null and empty texts are judged as in :func:`score`, repeated rows alike, and columns keep their names, whatever
    these are. Without labelled rows of both classes every row stays; no rows give none.
    """
    names = tuple(fresh(docs.columns, "score", "predicted"))
    return score(docs, fit(docs, labels), names).where(F.col(names[1]) == 0).drop(*names)
