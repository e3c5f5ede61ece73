"""Near-duplicates, nearest neighbours and the pipeline against brute force."""

import os
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import brute
from winnow.llm import ann, decontam, hyperminhash, neardup
from winnow.llm.components import components
from winnow.llm.queries import queries


def _edited(words: list[str], edits: int, rng: random.Random) -> str:
    out = list(words)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"edit{rng.randrange(10**6)}"
    return " ".join(out)


def _corpus(seed: int = 2) -> list[tuple[int | None, str | None]]:
    """A large group of near copies of all degrees, small groups, exact copies, a shared passage, and awkward texts."""
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(3000)]
    draw = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    texts: list[str | None] = []
    base = draw(150)
    texts += [_edited(base, rng.randrange(0, 9), rng) for _ in range(160)]
    passage = draw(60)
    texts += [" ".join(draw(40) + passage + draw(40)) for _ in range(60)]
    for _ in range(25):
        own = draw(rng.randrange(6, 200))
        texts += [_edited(own, rng.randrange(0, 4), rng) for _ in range(4)]
    texts += [" ".join(base)] * 30 + [" ".join(draw(n)) for n in (1, 2, 3, 4, 5, 6, 7)]
    rng.shuffle(texts)
    return [*brute.awkward(), *((i + 100, t) for i, t in enumerate(texts))]


@pytest.mark.parametrize("small_bucket", [32, 4])
def test_groups_are_those_of_brute_force(spark, monkeypatch, small_bucket):
    monkeypatch.setattr(neardup, "SMALL_BUCKET", small_bucket)
    monkeypatch.setattr(neardup, "BLOCK", 16)
    texts = _corpus()
    want = brute.near_groups({i: t for i, t in texts if i is not None})
    rows = neardup.groups(brute.documents(spark, texts)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.component_id, r.kept) == (want[r.doc_id], want[r.doc_id] == r.doc_id)
    sizes = {i: len(brute.shingles(t)) for i, t in texts}
    assert all(r.n_shingles == sizes[r.doc_id] for r in rows if r.doc_id is not None)
    assert max(Counter(want.values()).values()) > 100


def test_one_of_each_group_stays(spark):
    docs = brute.documents(spark, _corpus(5))
    kept = neardup.keep_one(docs)
    want = brute.near_groups({i: t for i, t in _corpus(5) if i is not None})
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect() if r.doc_id is not None} == set(want.values())
    assert neardup.groups(docs.limit(0)).count() == 0
    assert sum(r.doc_id is None for r in kept.collect()) == 2
    assert {tuple(r[c] for c in brute.MORE) for r in kept.collect()} == {tuple(range(len(brute.MORE)))}


def test_estimates_are_close_to_the_similarity():
    rng = np.random.default_rng(1)
    for size, other, both in ((40, 40, 30), (500, 600, 400), (3000, 3000, 300), (5000, 5000, 0)):
        all_of = np.unique(rng.integers(0, 2**63, 20_000).astype(np.uint64) * np.uint64(3))
        a, b = all_of[:size], np.concatenate([all_of[:both], all_of[-(other - both) or len(all_of) :]])
        near = hyperminhash.estimate(hyperminhash.registers(np.sort(a))[None], hyperminhash.registers(np.sort(b))[None], np.array([size]), np.array([other]))[0]
        true = both / (size + other - both)
        assert abs(near - true) < 5 * (max(true * (1 - true), 0.01) / hyperminhash.BUCKETS) ** 0.5


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(0, 60)]
    star = [(1000, 1000 + i) for i in range(1, 200)]
    got = {r.node: r.label for r in components(spark.createDataFrame(chain + star + chain[:3], "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(1000, 1200), 1000)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def _nearest(rows, k):
    x = {i: np.array(v, float) for i, v in rows}
    out = {}
    for q in x:
        if q % 20 == 0:
            scored = sorted((-float((x[q] * x[i]).sum()), i) for i in x if i != q)
            out[q] = [i for _, i in scored[:k]]
    return out


def _vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, 0.0) for i, v in rows], "vec_id long, embedding array<float>, label int, score double")


def test_nearest_neighbours(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 300)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 10)
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(12, 16))
    rows = [(i, [float(np.float32(v)) for v in centers[i % 12] + 0.5 * rng.normal(size=16)]) for i in range(2000)]
    rows += [(i, rows[7][1]) for i in range(2000, 2900)]  # one vector that is very common
    bad = [(20_000, None), (20_020, [0.0] * 16), (20_040, [float("nan")] * 16), (20_060, [None] * 16), (20_080, [float("inf")] * 16), (20_100, [1.0, 2.0]), (20_120, []), (None, rows[0][1])]
    got: dict[int, list] = {}
    for r in ann.search(_vectors(spark, rows + bad), F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want, x = _nearest(rows, 20), dict(rows)
    assert set(got) == set(want)
    found = 0
    for q, held in got.items():
        held.sort()
        assert [r for r, _, _ in held] == list(range(1, 21)) and all(v != q for _, v, _ in held)
        assert [(-s, v) for _, v, s in held] == sorted((-s, v) for _, v, s in held)
        assert all(abs(s - np.dot(x[q], x[v])) < 1e-9 for _, v, s in held)
        found += len(set(want[q]) & {v for _, v, _ in held})
    assert found >= 0.9 * 20 * len(want)


def test_short_lists_are_topped_up(spark):
    """Groups of equal vectors are lists of their own: small ones hold fewer than 20, and one holds a query's own rows alone."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(26, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    group = [i for i in range(20) for _ in range(100)] + [i for i in range(20, 24) for _ in range(5)] + [24]
    rows = [(i, [float(np.float32(v)) for v in x[g]], int(g >= 20), 0.0) for i, g in enumerate(group)]
    rows += [(9000, [float(np.float32(v)) for v in x[25]], int(i == 0), 0.0) for i in range(40)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, score double")
    assert ann.fit(vectors.select("vec_id", "embedding"), len(rows)).probes < 20
    got = Counter(r.query_id for r in ann.search(vectors, F.col("label") == 1).collect())
    assert got == {**{i: 20 for i, g in enumerate(group) if g >= 20}, 9000: 20}


def test_a_repeated_query_row_asks_once(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(np.float32(v)) for v in rng.normal(size=8)]) for i in range(300)]
    rows += [rows[0], rows[0], rows[20]]
    got = ann.search(_vectors(spark, rows), F.col("vec_id") % 20 == 0, 10).collect()
    want = _nearest(rows[:300], 10)
    asked = Counter(r.query_id for r in got)
    assert asked == dict.fromkeys(want, 10)
    for q in (0, 20):
        found = [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == q]
        assert len(set(found)) == 10 and set(found) <= set(range(300)) - {q}


def test_recall_on_the_embeddings_table(spark):
    """All queries of the registered table against brute force."""
    folder = "/root/testdata/sf0.01"
    if not os.path.isdir(folder):
        pytest.skip("the tables aren't there")
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet")
    rows = sorted((r.vec_id, r.embedding) for r in vectors.select("vec_id", "embedding").collect())
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], np.float64)
    asked = np.flatnonzero(ids % 20 == 0)
    near = x[asked] @ x.T
    near[np.arange(len(asked)), asked] = -np.inf
    best = {int(ids[q]): set(ids[np.lexsort((ids, -near[i]))[:20]].tolist()) for i, q in enumerate(asked)}
    got: dict[int, set[int]] = {}
    for r in queries()["op6_nearest"](spark, folder).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert set(got) == set(best)
    assert sum(len(got[q] & best[q]) for q in best) >= 0.95 * 20 * len(best)


def test_vectors_of_odd_lengths_are_told_of(spark):
    rows = [(i, [1.0, float(i)]) for i in range(1, 6)] + [(9, [1.0]), (10, [1.0, 2.0, 3.0])]
    with pytest.warns(UserWarning, match="2 vectors"):
        got = ann.search(_vectors(spark, rows), F.lit(True), 3).collect()
    assert {r.query_id for r in got} == {1, 2, 3, 4, 5}


def test_few_vectors(spark):
    two = _vectors(spark, [(0, [1.0, 2.0, 3.0]), (1, [1.0, 2.0, 3.0])])
    assert [tuple(r) for r in ann.search(two, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 14.0)]
    assert ann.search(two.limit(0), F.col("vec_id") == 0).count() == 0
    assert ann.search(two.limit(1), F.lit(True)).count() == 0


def test_pipeline(spark, tmp_path):
    """Each stage's own brute force over what the one before kept."""
    rng = random.Random(9)
    line = "this line is repeated in many of the documents"
    item = " ".join(f"bench{i}" for i in range(40))
    texts = [(i, f"{line}\n" + " ".join(f"u{rng.randrange(5000)}" for _ in range(80))) for i in range(200, 260)]
    texts += [(300, texts[3][1]), (301, texts[3][1] + " more"), (302, "clean start " * 5 + item), (303, " ".join(f"u{i}" for i in range(900)) + " " + item)]
    texts += brute.awkward()
    docs = brute.documents(spark, texts)
    folder = str(tmp_path)
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    here = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in here.collect()}
        out = stage(spark, here, folder)
        assert out.columns == docs.columns and out.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
        out.write.parquet(f"{folder}/{name}")
        here = spark.read.parquet(f"{folder}/{name}")
        after = {r.doc_id: r.text for r in here.collect()}
        before.pop(None, None), after.pop(None, None)
        if name == "toxicity":
            assert after == before
        elif name == "line_dedup":
            assert after == {i: t for i, (_, _, t) in brute.kept_lines(before).items()}
        elif name == "near_dedup":
            assert after == {i: before[i] for i in set(brute.near_groups(before).values())}
        else:
            bad = {i for i, t in before.items() if 20 * (c := brute.contamination(t, {"1": item}))[1] >= c[0] and c[1]}
            assert bad == {302} and set(after) == set(before) - bad
            assert brute.contamination(after[303], {"1": item})[1] == 0
            assert all(after[i] == before[i] for i in after if i != 303)
    pieces = corpus_pipeline.STAGES[-1][1](spark, here, folder).collect()
    assert Counter(r.doc_id for r in pieces if r.piece == 0) == Counter(r.doc_id for r in here.collect())
    assert corpus_pipeline.run(spark, folder).count() == len(pieces)


def test_stages_take_empty_tables(spark, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    none = brute.documents(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, folder).count() == 0
    assert decontam.decontaminate(brute.documents(spark, brute.awkward()), spark.read.parquet(f"{folder}/benchmark.parquet")).count() == len(brute.awkward())
