"""Benchmark decontamination and line de-duplication against plain Python."""

import hashlib

from tests.llm import brute
from winnow.llm import decontam, line_dedup, neardup
from winnow.llm.oracles import oracle_sql

ITEMS = {"7": " ".join(f"bench{i}" for i in range(30)), "10": "short Item", "2": " ".join(f"w{i}" for i in range(5, 25)), "3": None, "4": "...", "5": "one"}


def _items(spark):
    return spark.createDataFrame([(int(k), v, "x") for k, v in ITEMS.items()], "item_id long, text string, words string")


def _texts():
    passage = " ".join(f"Bench{i}" for i in range(9, 25))
    more = [(20, f"before {passage} after"), (21, "x " * 500 + passage), (22, "a short-item, and one"), (23, "bench0 bench1 bench2")]
    return brute.awkward() + more


def test_contamination_is_that_of_plain_python(spark):
    rows = decontam.report(brute.documents(spark, _texts()), _items(spark)).collect()
    got = sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in rows)
    want = []
    for i, t in _texts():
        words, hit, found = brute.contamination(t, {k: v or "" for k, v in ITEMS.items()})
        want.append((str(i), words, hit, len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), hit > 0 and 20 * hit >= words))
    assert got == sorted(want)


def test_decontamination_cuts_passages_and_drops_documents(spark):
    docs = brute.documents(spark, _texts())
    left = {r.doc_id: r.text for r in decontam.decontaminate(docs, _items(spark)).collect()}
    assert 20 not in left and 22 not in left
    assert brute.contamination(left[21], {"7": ITEMS["7"]})[1] == 0 and left[21].startswith("x x x")
    assert left[23] == "bench0 bench1 bench2" and left[2] == "" and left[1] is None
    assert decontam.decontaminate(docs, _items(spark)).columns == docs.columns


def test_rows_of_one_doc_id_have_verdicts_of_their_own(spark):
    """Rows without an id, or with a repeated one, lose what their own texts hold and nothing else."""
    passages = [" ".join(f"bench{i}" for i in range(low, low + 14)) for low in (0, 15)]
    words = " ".join(f"own{i}" for i in range(1000))
    texts = [passages[0], words, f"{passages[0]} {words}", f"{words} {passages[1]}", f"{passages[1]} {passages[0]} {words} {passages[0]}", None, ""]
    want = sorted([words, words, words, words, words, "", "None"])
    docs = brute.documents(spark, [(i, t) for i in (None, 50) for t in [*texts, texts[1]]])
    rows = decontam.decontaminate(docs, _items(spark)).collect()
    for i in (None, 50):
        assert sorted(str(r.text).strip() for r in rows if r.doc_id == i) == want


def test_a_large_benchmark_is_broadcast_in_blocks(spark, monkeypatch):
    docs, items = brute.documents(spark, _texts()), _items(spark)
    whole = sorted(map(str, decontam.report(docs, items).collect()))
    for grams, size, hashes in ((7, 1 << 28, 1000), (1000, 100, 1000), (7, 100, 5)):
        monkeypatch.setattr(decontam, "MAX_BROADCAST_GRAMS", grams)
        monkeypatch.setattr(decontam, "MAX_BROADCAST_BYTES", size)
        monkeypatch.setattr(decontam, "MAX_BROADCAST_HASHES", hashes)
        assert sorted(map(str, decontam.report(docs, items).collect())) == whole


def test_marks_too_large_to_broadcast_are_exchanged(spark):
    docs = brute.documents(spark, _texts() + [(i, "a line that a few documents share, in any case") for i in range(60, 64)])
    run = lambda: [sorted(map(str, df.collect())) for df in (line_dedup.dedup_lines(docs), decontam.decontaminate(docs, _items(spark)), neardup.keep_one(docs))]
    small, before = run(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert run() == small
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_passage_of_very_many_items_is_one_small_row_of_the_broadcast(spark):
    words = " ".join(f"shared{i}" for i in range(20))
    items = spark.createDataFrame([(i, words) for i in range(3000)] + [(5000, words + " tail")], "item_id long, text string")
    rows = {r.doc_id: r for r in decontam.report(brute.documents(spark, [(1, words), (2, "clean"), (3, f"{words} tail")]), items).collect()}
    ids = [sorted(map(str, [*range(3000), 5000]))] * 2
    assert [rows[i].n_items for i in (1, 2, 3)] == [3001, 0, 3001]
    assert [rows[i].items_sha256 for i in (1, 3)] == [hashlib.sha256(",".join(x).encode()).hexdigest() for x in ids]
    found, sets = decontam.scanned(brute.documents(spark, [(1, words)]), items)
    assert sets.count() == 2 and found.first().n_words == 20


def test_repeated_rows_are_reported_as_often_as_they_come(spark, monkeypatch):
    monkeypatch.setattr(decontam, "COPIES", 3)
    texts = [(i, t) for i in (None, 1) for t in ("bench0 " + " ".join(f"bench{i}" for i in range(15)), None, "x y") for _ in range(8)]
    rows = decontam.report(brute.documents(spark, texts), _items(spark)).collect()
    assert len(rows) == len(texts) and sum(r.contaminated for r in rows) == 16 and sum(r.n_words == 0 for r in rows) == 16


def test_columns_of_any_name_pass_through(spark):
    texts = [*_texts(), *((i, "a line that a few documents share, in any case") for i in range(60, 64))]
    docs = brute.documents(spark, texts)
    for out in (decontam.decontaminate(docs, _items(spark)), line_dedup.dedup_lines(docs)):
        assert out.columns == docs.columns
        assert {tuple(r[c] for c in brute.MORE) for r in out.collect()} == {tuple(range(len(brute.MORE)))}


def test_first_occurrences_stream_without_a_second_exchange(spark):
    rows = [(i % 7, j, i % 3, 0) for i in range(60) for j in (4, 2, 9)]
    firsts = line_dedup.first_occurrences(spark.createDataFrame(rows, "doc_id long, pos int, h1 long, h2 long"))
    assert sorted((r.doc_id, r.pos, r.h1) for r in firsts.collect()) == sorted({(d, 2, h) for d, _, h, _ in rows})
    plan = firsts._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange") == 1 and plan.count("Sort [") == 1 and "Window [" in plan


def test_rows_without_an_id_lose_no_line_and_are_no_document(spark):
    line = "a line that three rows hold, one of them without an id"
    docs = brute.documents(spark, [(1, line), (2, line), (None, line), (None, line)])
    assert sum(r.n_dropped for r in line_dedup.report(docs).collect()) == 0
    more = docs.unionByName(brute.documents(spark, [(3, line)]))
    assert {(r.doc_id, r.n_dropped) for r in line_dedup.report(more).collect()} == {(1, 1), (2, 1), (3, 0), (None, 0)}


def test_kept_lines_are_those_of_plain_python(spark):
    texts = [(i, t) for i, t in brute.awkward() if i is not None] + [(i, f"unique {i}\n  A line THAT many documents hold \nshort\nshort") for i in range(100, 130)]
    docs = brute.documents(spark, texts)
    want = brute.kept_lines(dict(texts))
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in line_dedup.report(docs).collect()}
    assert got == {i: (n, k, hashlib.sha256(t.encode()).hexdigest()) for i, (n, k, t) in want.items()}
    kept = line_dedup.dedup_lines(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id: r.text for r in kept.collect()} == {i: t for i, (_, _, t) in want.items()}
    assert {r.n_lines for r in kept.collect()} == {6}  # a column of that name is left alone


def test_long_documents_have_long_bitmaps(spark):
    body = "\n".join(f"a line that is number {i} of the text" for i in range(300))
    docs = brute.documents(spark, [(i, body) for i in range(4)])
    got = {r.doc_id: r.n_dropped for r in line_dedup.report(docs).collect()}
    assert got == {0: 300, 1: 300, 2: 300, 3: 0}


def test_empty_tables_and_null_ids(spark):
    none = brute.documents(spark, [])
    assert line_dedup.report(none).count() == 0 and decontam.report(none, _items(spark)).count() == 0
    docs = brute.documents(spark, brute.awkward())
    assert decontam.report(docs, _items(spark).limit(0)).where("contaminated").count() == 0
    assert line_dedup.report(docs).where("doc_id IS NULL AND n_dropped = 0").count() == 2
    assert line_dedup.report(docs).count() == docs.count()


def test_no_python_in_the_plans(spark):
    docs = brute.documents(spark, brute.awkward())
    for df in (line_dedup.report(docs), decontam.report(docs, _items(spark))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_oracles_are_for_registered_queries():
    from winnow.llm.queries import queries

    assert set(oracle_sql()) <= set(queries())
