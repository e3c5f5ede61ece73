"""Registered queries for what the language does on the driver, and for types and highlights over made-up rows.

What an operator answers becomes a row, so that SQL can say the same: outcomes of parsing, checking and configuring,
the public constants and helpers, and the rows of small tables with awkward values.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

import winnow
from winnow.operators.engine import Engine
from winnow.plans import builders as b
from winnow.plans import limits, tree
from winnow.plans.types import Claimed, Reading, ValueType, coerced
from winnow.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def _rows(schema: str, make: Callable[[], Iterable[tuple]]) -> Query:
    return lambda spark, folder: spark.createDataFrame(list(make()), schema)


def outcome(run: Callable[[], object]) -> str:
    """"ok", or the code of the engine's error."""
    try:
        run()
    except winnow.QueryError as e:
        return e.code
    except TypeError:
        return "TypeError"
    return "ok"


# Syntax

_ERRORS = ["a AND (b", "f:", "a^2", "a~1", "+x", '"abc', "f:[1 TO", "/a/x", "a b", "f:(a OR b)", ""]
_KEYWORDS = ["AND", "and", "a and b", "a AND b", "not", "NOT", "or:x", "TO", '"OR"']
_UNQUOTED = ["plain", "two words", "AND", "true", "-x", "a:b", "a.b", "", "ünïcode", "a*"]
_ESCAPES = [r"a\:b", r"\*x", r"\AND", r"f\.g:1", "back\\", r"a\ b"]


def _leaf(query: str) -> str:
    """What the parsed query is: text of a literal, path of a field, or the kind of tree."""
    node = winnow.parse(query)
    match node:
        case tree.Literal():
            return f"text {node.value}"
        case tree.Tag():
            return "field " + "|".join(winnow.field_path(node.field))
        case tree.Logical():
            return node.operator + (" implicit" if node.implicit else "")
    return node.TYPE


def _hint(query: str) -> str:
    try:
        winnow.parse(query)
    except winnow.SyntaxError_ as e:
        return e.reason.split("Did you mean ")[-1] if "Did you mean " in e.reason else "no hint"
    return "ok"


def _helpers() -> Iterable[tuple[str, str]]:
    path = winnow.parse("a.'b.c'.0:x").field
    yield "field_path", "|".join(winnow.field_path(path))
    yield "field_name", winnow.field_name(path)
    low = winnow.parse("n:{1 TO 5]").expression
    yield "range_bracket lower", winnow.range_bracket("lower", low.lower)
    yield "range_bracket upper", winnow.range_bracket("upper", low.upper)
    yield "is_node", str(winnow.is_node(low)) + str(winnow.is_node("x"))


def _constants() -> Iterable[tuple[str, str]]:
    yield "KEYWORD_LITERALS", " ".join(sorted(winnow.KEYWORD_LITERALS))
    yield "RESERVED_WORDS", " ".join(sorted(winnow.RESERVED_WORDS))
    yield "RESERVED_CHARACTERS", "".join(sorted(c for c in winnow.RESERVED_CHARACTERS if c > " "))
    yield "OPERATOR_PRECEDENCE", " ".join(f"{k}={v}" for k, v in sorted(winnow.OPERATOR_PRECEDENCE.items()))
    yield "ROOT_NODE_TYPES", " ".join(sorted(winnow.ROOT_NODE_TYPES))
    yield "SYNTHETIC", f"{winnow.SYNTHETIC.start}-{winnow.SYNTHETIC.end}"
    yield "VERSION", str(bool(winnow.VERSION))


def _limits() -> Iterable[tuple[str, str]]:
    nested = lambda n: "(" * n + "a" + ")" * n
    path = lambda n: ".".join(["a"] * n) + ":1"
    stars = lambda n: "f:" + "a*" * (n // 2)
    cases = (("depth", nested, limits.MAX_DEPTH), ("clauses", lambda n: " ".join(["a"] * n), limits.MAX_CLAUSES), ("segments", path, limits.MAX_FIELD_SEGMENTS), ("pieces", stars, limits.MAX_WILDCARD_SEGMENTS))
    for name, make, most in cases:
        yield f"{name} {most}", outcome(lambda: winnow.parse(make(most)))  # noqa: B023
        yield f"{name} over", outcome(lambda: winnow.parse(make(most + 2)))  # noqa: B023


def _trees(spark: SparkSession, folder: str) -> DataFrame:
    """Trees that were built by hand, and what the engine says to them."""
    df = spark.range(1).select(F.col("id"), F.lit("x").alias("f"))
    deep: tree.Node = b.term("a")
    for _ in range(limits.MAX_AST_DEPTH + 1):
        deep = tree.Group(deep)
    made = {
        "term": b.term("a"), "and": b.and_(b.term("a"), b.term("b")), "no node": 5, "literal of a number": tree.Literal(5), "empty pattern": tree.Wildcard(()),
        "flag twice": tree.Regex("a", "ii"), "operator": tree.Tag(b.field("f"), ":~", b.term("a")), "field in a group": tree.Tag(b.field("f"), ":", tree.Group(tree.Tag(b.field("f"), ":", b.term("a")))),
        "joined by XOR": tree.Logical("XOR", b.term("a"), b.term("b")), "empty inside": tree.Group(tree.Empty()), "too deep": deep,
    }
    return spark.createDataFrame([(k, outcome(lambda: Engine().filter(v, df))) for k, v in made.items()], "made string, outcome string")  # noqa: B023


def _options() -> Iterable[tuple[str, str]]:
    cases = {
        "none": {}, "unknown": {"nosuch": 1}, "policy": {"on_value_error": "x"}, "flag": {"tolerant": 1}, "length": {"max_pattern_length": 0}, "half a date": {"date_format": "YYYY-MM"},
        "token twice": {"date_format": "HH:mm HH"}, "hook": {"parse_date": 5}, "type": {"types": (5,)}, "strategy": {"type_strategy": "x"}, "id": {"id": 5}, "two of a name": {"types": (_version(), _version())},
    }
    for name, options in cases.items():
        yield name, outcome(lambda: Engine(**options))  # noqa: B023


def _version() -> ValueType:
    return coerced("version", lambda t: t, lambda t: t, "string")


def _detected() -> Iterable[tuple[str, str | None, int | None]]:
    for text in ("2020-06-15", "2020/06/15", "2020-02-30", "14:30", "2020-06-15T10:30:00.250+02:00", "2020-06-15 10:30", "0099-01-01", "2020-06-15\n", "15-06-2020", "June"):
        found = winnow.resolve_temporal(text, ("DD-MM-YYYY",))
        yield text, winnow.detect_format(text), None if found is None else found.millis


def _recovered(spark: SparkSession, folder: str) -> DataFrame:
    df = spark.range(1).select(F.col("id"), F.lit("x").alias("f"))
    engine = Engine(tolerant=True, on_recovered="throw")
    return spark.createDataFrame([(q, outcome(lambda: engine.filter(q, df))) for q in ("f:x", "(f:x", "f:", "f:[1 TO", 'f:"x', "f:x)", "f:x AND")], "query string, outcome string")  # noqa: B023


# Types

def _introspected() -> Iterable[tuple[int, str, bool]]:
    engine = Engine(types=(_version(),), type_strategy="append")
    return ((i, t["name"], t["ordered"]) for i, t in enumerate(engine.types))


class _Watching(ValueType):
    """A type that remembers what it is told."""

    name, ordered = "watching", True

    def __init__(self):
        self.told: list[tuple[str, bool, bool]] = []

    def parse_operand(self, operand, context):
        self.told.append((context.site, context.case_sensitive, hasattr(context.options, "on_value_error")))
        return Claimed("x")

    def read(self, column, kind, operand, context):
        return Reading(column) if isinstance(kind, T.StringType) else None


def _contexts(spark: SparkSession, folder: str) -> DataFrame:
    df, out = spark.range(1).select(F.lit("x").alias("f")), []
    for query in ("a", "f:a", "f::a", "f:=a", "f:>a", "f:[a TO *]"):
        watching = _Watching()
        Engine(types=(watching,), on_value_error="throw").filter(query, df)
        out += [(query, *watching.told[0])]
    return spark.createDataFrame(out, "query string, site string, case_sensitive boolean, sees_policy boolean")


class _Broken(ValueType):
    name = "broken"

    def __init__(self, **does):
        self.does = does

    def parse_operand(self, operand, context):
        return self.does.get("parse", lambda: Claimed("x"))()

    def read(self, column, kind, operand, context):
        return Reading(column) if isinstance(kind, T.StringType) else None

    def equals(self, value, operand, context):
        return self.does.get("equals", lambda value: value.isNotNull())(value)

    def spans(self, operand, context):
        return self.does.get("spans")


def _guarded(spark: SparkSession, folder: str) -> DataFrame:
    df = spark.range(1).select(F.lit("x").alias("f"))
    cases = {
        "sound": {}, "parse raises": {"parse": lambda: 1 // 0}, "parse returns text": {"parse": lambda: "x"}, "equals raises": {"equals": lambda v: 1 // 0},
        "equals returns True": {"equals": lambda v: True}, "equals returns a number": {"equals": F.length},
    }
    return spark.createDataFrame([(k, outcome(lambda: Engine(types=(_Broken(**v),)).filter("f:a", df))) for k, v in cases.items()], "callback string, outcome string")  # noqa: B023


def _sealed() -> Iterable[tuple[str, str]]:
    def change(site: str) -> None:
        winnow.VALUE_FAILURE_POLICY[site]["miss"] = "value-error"

    def replace(site: str) -> None:
        winnow.VALUE_FAILURE_POLICY[site] = {}

    yield "change a policy", outcome(lambda: change("match"))
    yield "replace a policy", outcome(lambda: replace("match"))
    yield "match miss", winnow.disposition("match", "miss")
    yield "range miss", winnow.disposition("range", "miss")


def _throwing(spark: SparkSession, folder: str) -> DataFrame:
    """Whether each query raises on the first parts, and for which field and where."""
    parts, out = table(spark, folder, "part").where("p_partkey < 20"), []
    for query in ("p_size:>5", "p_name:>5", "p_size:>5 OR p_brand:>1", "p_name:nosuch AND p_type:>=5", "p_name:5", "5", "p_brand:[1 TO 2]"):
        try:
            Engine(on_value_error="throw").filter(query, parts).count()
            out.append((query, "ok", None, None))
        except Exception as e:  # noqa: BLE001 - told below, or raised again
            found = winnow.value_error(e)
            if found is None:
                raise
            out.append((query, found.code, found.details["field"], found.details["site"]))
    return spark.createDataFrame(out, "query string, outcome string, field string, site string")


# Rows of small tables

def _texts(spark: SparkSession) -> DataFrame:
    texts = ["12", "12\n", "1e1", "2020-06-15", "2020-06-15\n", "14:30", "14:30\n", "", str(2**130), str(2**130 + 1), "0" * 5000 + "12", None]
    return spark.createDataFrame(list(enumerate(texts)), "id int, t string")


def _over(query: str, **options) -> Query:
    return lambda spark, folder: Engine(**options).filter(query, _texts(spark)).select("id")


def _deep(spark: SparkSession) -> DataFrame:
    schema = "id int, m map<string,string>, items array<struct<v:string>>, n array<array<int>>, city string, `a.b` string, a struct<b:string>"
    return spark.createDataFrame([(1, {"colour": "red"}, [None, ("x",)], [[1, 2], None, [3, 2]], "İstanbul", "q", ("q",)), (2, {"red": "blue"}, [("x",), ("x",)], [[2]], "Bursa", None, None)], schema)


def _keyed(spark: SparkSession) -> DataFrame:
    """Maps inside arrays, and inside structs inside arrays."""
    schema = "id int, m array<map<string,int>>, s array<struct<name:string,deep:map<string,int>>>"
    return spark.createDataFrame([(1, [{"shade": 1}, None], [("x", None)]), (2, None, [("y", {"shade": 2})]), (3, [{"other": 1}], [None])], schema)


def _years(spark: SparkSession) -> DataFrame:
    texts = ["0099-12-31", "0000-02-29", "0100-01-01", "0001-01-01T00:30+01:00", "1999-01-01", "0099/06/15"]
    return spark.createDataFrame(list(enumerate(texts)), "id int, t string")


def _lit(query: str, **options) -> Query:
    """The highlights of the small nested table, a row each."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        found = Engine(**options).highlight(query, _deep(spark)).select("id", F.explode("highlights").alias("h"))
        spans = F.array_join(F.transform("h.ranges", lambda r: F.concat_ws("-", r["start"].cast("string"), r["end"].cast("string"))), ",")
        return found.select("id", F.array_join("h.segments", "|").alias("segments"), F.coalesce(spans, F.lit("none")).alias("spans"))

    return run


def _orders(query: str, **options) -> Query:
    """Highlights over the orders: path and spans."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        found = Engine(**options).highlight(query, table(spark, folder, "orders").select("o_orderkey", "o_orderstatus")).select("o_orderkey", F.explode("highlights").alias("h"))
        return found.select("o_orderkey", F.col("h.path").alias("path"), F.array_join(F.transform("h.ranges", lambda r: F.concat_ws("-", r["start"].cast("string"), r["end"].cast("string"))), ",").alias("spans"))

    return run


def _packed_days(spark: SparkSession, folder: str) -> DataFrame:
    """Days as numbers of eight digits, some of no real day, under a layout of digits alone."""
    day = F.date_format("o_orderdate", "yyyyMMdd").cast("long")
    frame = table(spark, folder, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 == 0, F.lit(19960631)).otherwise(day).alias("packed"))
    return Engine(date_format="YYYYMMDD").filter("packed:>=19960601 packed:<19970101", frame)


def _hooked(spark: SparkSession, folder: str) -> DataFrame:
    hook = lambda text: dt.datetime(1997, 1, 1) if text == "F" else None
    return Engine(parse_date=hook).filter("o_orderstatus:>=1997-01-01", table(spark, folder, "orders")).select("o_orderkey")


def queries() -> dict[str, Query]:
    garbage = {"equals": lambda v: v == "F", "spans": lambda text: [(-1, 1), (0, 9), (1, 1), (0, 1), "x"]}
    return {
        "parse_errors": _rows("query string, outcome string", lambda: ((q, outcome(lambda: winnow.parse(q))) for q in _ERRORS)),
        "parse_keywords": _rows("query string, outcome string", lambda: ((q, outcome(lambda: winnow.parse(q))) for q in _KEYWORDS)),
        "parse_escapes": _rows("query string, meaning string", lambda: ((q, _leaf(q)) for q in _ESCAPES)),
        "parse_space_hint": _rows("query string, hint string", lambda: ((q, _hint(q)) for q in ("f: v", "f:>= 5", "f: two words", "f:v", "f:"))),
        "safe_unquoted": _rows("text string, safe boolean", lambda: ((t, winnow.is_safe_unquoted(t)) for t in _UNQUOTED)),
        "tree_helpers": _rows("helper string, value string", _helpers),
        "constants": _rows("name string, value string", _constants),
        "limits": _rows("limit string, outcome string", _limits),
        "tree_validation": _trees,
        "option_validation": _rows("options string, outcome string", _options),
        "detect_and_resolve": _rows("text string, shape string, millis long", _detected),
        "recovered_throw": _recovered,
        "introspection": _rows("place int, name string, ordered boolean", _introspected),
        "type_contexts": _contexts,
        "type_guard": _guarded,
        "sealed_policy": _rows("what string, outcome string", _sealed),
        "value_error_raises": _throwing,
        "number_text_lf": _over("t:12"),
        "number_text_long": _over("t:>1e30"),
        "date_text_lf": _over("t:2020-06-15"),
        "time_lf": _over("t:>=14:00"),
        "highlight_map": _lit("red"),
        "highlight_keys": _lit("red", match_keys=True),
        "highlight_sparse": _lit("items.v:x"),
        "highlight_nested": _lit("2"),
        "highlight_fold": _lit("city:İstanbul OR city:bursa"),
        "highlight_dedupe": _lit("a.b:[* TO *] 'a.b':q"),
        "highlight_both_ways": _orders("o_orderstatus:f AND o_orderstatus:*f* AND o_orderstatus:[* TO *]"),
        "highlight_sanitised": _orders("o_orderstatus:anything", types=(_Broken(**garbage),)),
        "path_quoted": lambda spark, folder: Engine().filter("'a.b':q AND a.'b':Q", _deep(spark)).select("id"),
        "path_nested_index": lambda spark, folder: Engine().filter("n.2.0:3 OR items.0.v:X", _deep(spark)).select("id"),
        "keys_inside_arrays": lambda spark, folder: Engine(match_keys=True).filter("shade", _keyed(spark)).select("id"),
        "keys_are_no_values": lambda spark, folder: Engine().filter("shade", _keyed(spark)).select("id"),
        "date_years": lambda spark, folder: Engine().filter("t:<0100-01-01", _years(spark)).select("id"),
        "extend": lambda spark, folder: Engine(tolerant=True, match_keys=True).extend(match_keys=None, tolerant=False, date_format="DD-MM-YYYY").filter("o_orderdate:>=01-06-1997", table(spark, folder, "orders")).select("o_orderkey"),
        "keyword_as_term": lambda spark, folder: Engine().filter("and lang:en", table(spark, folder, "documents").select("doc_id", "lang", "text")).select("doc_id"),
        "escaped_value": lambda spark, folder: Engine().filter(r"c_name:customer\#00000001?", table(spark, folder, "customer")).select("c_custkey", "c_name"),
        "regex_unguarded": lambda spark, folder: Engine(regex_guard=False).filter("text:/(?<=the )mit license/i", table(spark, folder, "documents")).select("doc_id"),
        "regex_scan": lambda spark, folder: Engine().filter("/^blue b[a-z]+t$/", table(spark, folder, "part").select("p_partkey", "p_name", "p_brand")).select("p_partkey", "p_name"),
        "date_digits": _packed_days,
        "date_hook": _hooked,
    }
