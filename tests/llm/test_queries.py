"""The registered queries over whole small tables: their columns, and DuckDB where SQL can express them."""

import duckdb
import pytest
from pyspark.sql import functions as F

from winnow.llm.oracles import oracle_sql
from winnow.llm.queries import queries

COLUMNS = {
    "op1_decontaminate": {"doc_id": "bigint", "n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "items_sha256": "string", "contaminated": "boolean"},
    "op2_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op3_near_duplicates": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op4_packing": {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op5_secrets": {"doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string"},
    "op6_nearest": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
    "op7_chat_format": {"conv_id": "bigint", "n_turns": "bigint", "turns_sha256": "string", "loss_chars": "bigint", "loss_sha256": "string", "formatted_chars": "bigint"},
    "op8_licenses": {"doc_id": "bigint", "n_words": "bigint", "n_base": "bigint", "first_word": "bigint", "last_word": "bigint", "base_labels": "string", "labels": "string", "score": "double"},
    "op9_token_counts": {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"},
    "op10_line_dedup": {"doc_id": "bigint", "n_lines": "bigint", "n_dropped": "bigint", "kept_sha256": "string"},
}


@pytest.mark.parametrize("name", list(COLUMNS))
def test_contract(spark, data, name):
    df = queries()[name](spark, data)
    assert dict(df.dtypes) == COLUMNS[name]
    rows = df.collect()
    documents = spark.read.parquet(f"{data}/documents.parquet")
    if "doc_id" in df.columns and name != "op4_packing":
        assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in documents.select("doc_id").collect())
    if name in oracle_sql():
        con = duckdb.connect()
        for t in ("documents", "benchmark", "conversations"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
        want = con.sql(oracle_sql()[name])
        assert sorted((tuple(r[c] for c in want.columns) for r in rows), key=repr) == sorted(want.fetchall(), key=repr)


def test_the_pipeline_is_registered(spark, data):
    df = queries()["pipeline"](spark, data)
    assert "doc_id" in df.columns and df.count() > 0


def test_scratch_tables_can_be_deleted(spark):
    from winnow.llm import shared

    shared.clear_scratch(spark)
    table = shared.written(spark.range(5), "five")
    assert table.count() == 5 and shared.clear_scratch(spark) == 1
    with pytest.raises(Exception, match="."):
        table.count()
    assert shared.clear_scratch(spark) == 0


def test_scratch_tables_go_at_the_end_of_their_block_also_after_an_error(spark):
    from winnow.llm import shared

    kept = shared.written(spark.range(3), "kept")
    with pytest.raises(ZeroDivisionError), shared.scratch(spark):
        table = shared.written(spark.range(5), "five")
        assert table.count() == 5
        1 / 0
    with pytest.raises(Exception, match="."):
        table.count()
    assert kept.count() == 3


def test_a_sample_is_drawn_by_hash(spark):
    from winnow.llm import shared

    rows = spark.range(20_000)
    drawn = [r.id for r in shared.drawn_by_hash(rows, "id", 500, 20_000).collect()]
    assert len(drawn) == 500 and drawn == [r.id for r in rows.orderBy(F.xxhash64("id"), "id").limit(500).collect()]
    assert shared.drawn_by_hash(rows, "id", 30_000, 20_000).count() == 20_000
    assert shared.fresh(["A", "b_"], "a", "b", "B") == ["a_", "b", "B__"]
