"""One registered query for each operator of the query language, over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow import builders
from winnow.operators.engine import Engine, default_engine
from winnow.plans.parser import parse
from winnow.plans.serializer import serialize
from winnow.plans.types import coerced
from winnow.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
Frame = Callable[[SparkSession, str], DataFrame]


def _of(name: str, *columns: str) -> Frame:
    return lambda spark, folder: table(spark, folder, name).select(*columns)


LINEITEM = _of("lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", "l_shipdate")
ORDERS = _of("orders", "o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
PART = _of("part", "p_partkey", "p_name", "p_brand", "p_type", "p_size")
CUSTOMER = _of("customer", "c_custkey", "c_name", "c_acctbal", "c_mktsegment")
EVENTS = _of("events", "event_id", "ts", "event_type", "value", "props")
TEXTS = _of("documents", "doc_id", "lang", "text")


def labelled(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with a boolean and, where they have no label, nulls."""
    labels = table(spark, folder, "labels").select("doc_id", (F.col("toxic") == 1).alias("toxic"), "quality")
    return table(spark, folder, "documents").select("doc_id", "lang", "source").join(labels, "doc_id", "left")


def nested(spark: SparkSession, folder: str) -> DataFrame:
    """Customers with a struct (null for some), an array of structs, a map and an array of words."""
    return CUSTOMER(spark, folder).select(
        "c_custkey",
        F.when(F.col("c_custkey") % 5 != 0, F.struct(F.col("c_mktsegment").alias("segment"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("balance"))).alias("meta"),
        F.array(F.struct(F.col("c_name").alias("name"), (F.col("c_custkey") % 7).alias("n")), F.struct(F.lit("spare").alias("name"), (F.col("c_custkey") % 3).alias("n"))).alias("items"),
        F.create_map(F.lit("Colour"), F.when(F.col("c_custkey") % 2 == 0, "red").otherwise("blue"), F.lit("size"), F.col("c_mktsegment")).alias("tags"),
        F.split("c_mktsegment", "I").alias("words"),
    )


def dated(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with their date as text in several shapes, as epoch milliseconds, as a date and as a time of day."""
    day = F.col("o_orderdate")
    return ORDERS(spark, folder).select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 4 == 0, "n/a").when(F.col("o_orderkey") % 4 == 1, F.date_format(day, "yyyy/MM/dd")).otherwise(F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T10:30:00.5+02:00"))).alias("text"),
        F.unix_millis(day.cast("timestamp")).alias("millis"), day.cast("date").alias("day"), F.date_format(day, "dd-MM-yyyy").alias("local"),
        F.format_string("%02d:%02d", (F.col("o_orderkey") % 24).cast("int"), (F.col("o_orderkey") % 60).cast("int")).alias("clock"),
        F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.col("o_orderkey").cast("string"), F.lit(".50"))).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("v"), F.col("o_orderkey").cast("string"))).otherwise(F.col("o_orderkey").cast("string")).alias("number"),
    )


def version(text: str) -> str | None:
    """Three numbers with dots, as text that sorts as they do."""
    parts = text.split(".")
    return ".".join(p.zfill(6) for p in parts) if len(parts) == 3 and all(p.isascii() and p.isdigit() for p in parts) else None


def releases(spark: SparkSession, folder: str) -> DataFrame:
    parts = [F.lit("1"), (F.col("p_partkey") % 12).cast("string"), (F.col("p_size") % 20).cast("string")]
    return PART(spark, folder).select("p_partkey", F.concat_ws(".", *parts).alias("release"))


def _filter(frame: Frame, query: str, *shown: str, **options) -> Query:
    engine = Engine(**options) if options else default_engine()
    return lambda spark, folder: engine.filter(query, frame(spark, folder)).select(*shown)


def _test(frame: Frame, query: str, *shown: str) -> Query:
    return lambda spark, folder: default_engine().test(query, frame(spark, folder)).select(*shown, "matched")


def _highlight(frame: Frame, query: str, key: str) -> Query:
    """The highlights as rows: path, and the spans as text."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        found = default_engine().highlight(query, frame(spark, folder)).select(key, F.explode("highlights").alias("h"))
        spans = F.array_join(F.transform("h.ranges", lambda r: F.concat_ws("-", r["start"].cast("string"), r["end"].cast("string"))), ",")
        return found.select(key, F.col("h.path").alias("path"), F.coalesce(spans, F.lit("")).alias("spans"))

    return run


def _built(spark: SparkSession, folder: str) -> DataFrame:
    b = builders
    tree = b.and_(b.tag(b.field("o_orderstatus"), b.term("f")), b.not_(b.compare(b.field("o_totalprice"), ":<", b.term("100000"))))
    return default_engine().filter(tree, ORDERS(spark, folder)).select("o_orderkey", "o_totalprice")


def _round_trip(spark: SparkSession, folder: str) -> DataFrame:
    query = serialize(parse('o_orderstatus:(f OR "o") -o_orderpriority:*urgent* o_totalprice:[1000 TO 250000}'))
    return default_engine().filter(query, ORDERS(spark, folder)).select("o_orderkey")


def _stream(spark: SparkSession, folder: str) -> DataFrame:
    from winnow.streaming.streams import filter_files

    return filter_files(spark, folder, "events.parquet", "event_type:*c* value:>50", "event_id", "value")


def queries() -> dict[str, Query]:
    keys = ("l_orderkey", "l_linenumber")
    releases_engine = {"types": (coerced("version", version, version, "string"),)}
    return {
        "flagship": _filter(LINEITEM, "l_returnflag:R AND l_shipdate:>=1995-01-01 AND NOT l_quantity:>5", *keys, "l_quantity"),
        "eq_ci": _filter(ORDERS, "o_orderpriority:1-urgent", "o_orderkey", "o_orderpriority"),
        "eq_cs": _filter(ORDERS, 'o_orderpriority::"1-URGENT"', "o_orderkey"),
        "eq_cs_miss": _filter(ORDERS, 'o_orderpriority::"1-urgent"', "o_orderkey"),
        "eq_relational": _filter(CUSTOMER, "c_mktsegment:=building", "c_custkey", "c_mktsegment"),
        "number_eq": _filter(PART, "p_size:15", "p_partkey", "p_size"),
        "number_ordered": _filter(PART, "p_size:>40 p_size:<=45", "p_partkey", "p_size"),
        "number_quoted": _filter(PART, 'p_size:"15"', "p_partkey"),
        "number_text": _filter(dated, "number:>=100", "o_orderkey", "number"),
        "number_range_incl": _filter(LINEITEM, "l_quantity:[10 TO 12]", *keys, "l_quantity"),
        "number_range_excl": _filter(LINEITEM, "l_quantity:{10 TO 12}", *keys, "l_quantity"),
        "number_range_mixed": _filter(LINEITEM, "l_quantity:[10 TO 12}", *keys, "l_quantity"),
        "number_range_open": _filter(CUSTOMER, "c_acctbal:{* TO 0}", "c_custkey", "c_acctbal"),
        "date_ge": _filter(LINEITEM, "l_shipdate:>=1998-01-01", *keys),
        "date_range": _filter(ORDERS, "o_orderdate:[1996-01-01 TO 1996-07-01}", "o_orderkey", "o_orderdate"),
        "date_offset": _filter(ORDERS, "o_orderdate:>1996-01-01T00:00:00+02:00 o_orderdate:<1996-02-01T00:00-05", "o_orderkey", "o_orderdate"),
        "date_text": _filter(dated, "text:>=1996-03-01T08:30:00.500Z", "o_orderkey", "text"),
        "date_column": _filter(dated, "day:[1996-02-01T12:00 TO 1996-02-10]", "o_orderkey", "day"),
        "date_epoch": _filter(dated, "millis:<1996-01-01", "o_orderkey"),
        "date_format": _filter(dated, "local:>=01-06-1997", "o_orderkey", "local", date_format="DD-MM-YYYY"),
        "time_of_day": _filter(dated, "clock:[08:30 TO 17:15}", "o_orderkey", "clock"),
        "wildcard_prefix": _filter(PART, "p_name:blu*", "p_partkey", "p_name"),
        "wildcard_suffix": _filter(PART, "p_name:*BOLT", "p_partkey", "p_name"),
        "wildcard_contains": _filter(PART, "p_type::*ECONOMY*", "p_partkey", "p_type"),
        "wildcard_multi": _filter(TEXTS, "text:*th*or*ing*sh*", "doc_id"),
        "wildcard_ends": _filter(PART, "p_name:b*e*t", "p_partkey", "p_name"),
        "wildcard_single": _filter(CUSTOMER, "c_name:*#?????0??5", "c_custkey", "c_name"),
        "wildcard_length": _filter(ORDERS, "o_orderpriority:?????", "o_orderkey", "o_orderpriority"),
        "wildcard_any": _filter(PART, "p_name:* NOT p_size:*", "p_partkey"),
        "regex_plain": _filter(TEXTS, "text:/license/", "doc_id"),
        "regex_flag_i": _filter(TEXTS, "text:/the (MIT|apache) license/i", "doc_id"),
        "regex_class": _filter(CUSTOMER, r"c_name:/#0*[1-9]\d?[02468]$/", "c_custkey", "c_name"),
        "regex_lines": _filter(TEXTS, "text:/^Th[a-f]+ [a-z]{3} /m", "doc_id"),
        "null_eq": _filter(labelled, "quality:null", "doc_id"),
        "null_under_null": _filter(nested, "meta.balance:null", "c_custkey"),
        "present": _filter(labelled, "toxic:[* TO *]", "doc_id"),
        "boolean_eq": _filter(labelled, "toxic:true OR toxic:=false quality:0", "doc_id", "toxic"),
        "bool_ops": _filter(ORDERS, "(o_orderstatus:F OR o_orderstatus:P) o_totalprice:>200000 -o_orderpriority:5*", "o_orderkey"),
        "not_two_valued": _filter(labelled, "NOT quality:1", "doc_id"),
        "not_nested": _filter(labelled, "NOT (toxic:false AND NOT quality:1)", "doc_id"),
        "field_group": _filter(PART, "p_brand:(brand#1* OR Brand#22 -*3)", "p_partkey", "p_brand"),
        "field_group_numbers": _filter(CUSTOMER, "c_acctbal:(-500 OR [-100 TO -50])", "c_custkey", "c_acctbal"),
        "or_many": _filter(PART, " OR ".join(f"p_brand:brand#{i}" for i in range(11, 36)), "p_partkey"),
        "scan_text": _filter(CUSTOMER, "machinery", "c_custkey"),
        "scan_number": _filter(PART, "7", "p_partkey"),
        "scan_wildcard": _filter(CUSTOMER, "auto*", "c_custkey"),
        "scan_date": _filter(ORDERS, '"1996-01-02"', "o_orderkey"),
        "scan_null": _filter(labelled, "null", "doc_id"),
        "scan_nested": _filter(nested, "blue household", "c_custkey"),
        "scan_range": _filter(PART, "[1 TO 5]", "p_partkey"),
        "match_keys": _filter(nested, "colour 3", "c_custkey", match_keys=True),
        "path_struct": _filter(nested, "meta.segment:building", "c_custkey"),
        "path_map": _filter(nested, "tags.Colour:RED", "c_custkey"),
        "path_array_of_structs": _filter(nested, "items.n:2", "c_custkey"),
        "array_any": _filter(nested, "words:tur*", "c_custkey"),
        "array_regex": _filter(nested, "words:/^[A-M].*E$/", "c_custkey"),
        "array_index": _filter(nested, "items.1.n:0 words.0:mach*", "c_custkey"),
        "array_float": lambda spark, folder: default_engine().filter("embedding:>0.4", table(spark, folder, "embeddings")).select("vec_id", "label"),
        "unknown_field": _filter(PART, "nosuch:x OR (nosuch:null AND p_size:1)", "p_partkey"),
        "empty_query": _filter(CUSTOMER, "  ", "c_custkey"),
        "test_column": _test(ORDERS, "o_totalprice:>150000 OR o_orderstatus:f", "o_orderkey"),
        "highlight_text": _highlight(TEXTS, "license", "doc_id"),
        "highlight_fielded": _highlight(ORDERS, "o_orderstatus:f AND o_totalprice:>300000", "o_orderkey"),
        "highlight_or_not": _highlight(ORDERS, "o_orderstatus:p OR (o_totalprice:>350000 NOT o_orderstatus:f)", "o_orderkey"),
        "highlight_wildcard": _highlight(PART, "p_name:bl*bolt", "p_partkey"),
        "highlight_array": _highlight(nested, "words:*y", "c_custkey"),
        "highlight_regex": _highlight(CUSTOMER, "c_name:/0{3,}[1-4]/", "c_custkey"),
        "tolerant_prune": _filter(ORDERS, "(o_orderstatus:f AND o_totalprice:>250000 AND o_orderpriority:", "o_orderkey", tolerant=True),
        "tolerant_repair": _filter(ORDERS, "o_orderdate:>=1996-02-31 o_orderstatus:p", "o_orderkey", tolerant=True),
        "value_error_throw": _filter(PART, "p_size:>=45 OR p_brand:brand#11", "p_partkey", on_value_error="throw"),
        "custom_type": _filter(releases, "release:[1.2.0 TO 1.10.0}", "p_partkey", "release", **releases_engine),
        "built_tree": _built,
        "round_trip": _round_trip,
        "stream_filter": _stream,
    }
