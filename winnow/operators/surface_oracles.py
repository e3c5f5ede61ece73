"""DuckDB SQL for the queries of ``surface``: what is due is written out."""

from __future__ import annotations


def _values(columns: str, *rows: tuple) -> str:
    def one(x: object) -> str:
        return "NULL" if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) v({columns})"


def _ids(*ids: int) -> str:
    return f"SELECT CAST(id AS INTEGER) AS id FROM (VALUES {', '.join(f'({i})' for i in ids)}) v(id)"


def _typed(sql: str, **kinds: str) -> str:
    return f"SELECT * REPLACE ({', '.join(f'CAST({c} AS {k}) AS {c}' for c, k in kinds.items())}) FROM ({sql})"


def oracle_sql() -> dict[str, str]:
    lit = lambda *rows: _typed(_values("id, segments, spans", *rows), id="INTEGER")
    return {
        "parse_errors": _values(
            "query, outcome", ("a AND (b", "SYNTAX"), ("f:", "SYNTAX"), ("a^2", "UNSUPPORTED_SYNTAX"), ("a~1", "UNSUPPORTED_SYNTAX"), ("+x", "UNSUPPORTED_SYNTAX"), ('"abc', "SYNTAX"),
            ("f:[1 TO", "SYNTAX"), ("/a/x", "SYNTAX"), ("a b", "ok"), ("f:(a OR b)", "ok"), ("", "ok"),
        ),
        "parse_keywords": _values("query, outcome", ("AND", "SYNTAX"), ("and", "ok"), ("a and b", "ok"), ("a AND b", "ok"), ("not", "ok"), ("NOT", "SYNTAX"), ("or:x", "ok"), ("TO", "ok"), ('"OR"', "ok")),
        "parse_escapes": _values("query, meaning", (r"a\:b", "text a:b"), (r"\*x", "text *x"), (r"\AND", "text AND"), (r"f\.g:1", "field f.g"), ("back\\", "text back\\"), (r"a\ b", "text a b")),
        "parse_space_hint": _values("query, hint", ("f: v", "f:v?"), ("f:>= 5", "f:>=5?"), ("f: two words", 'f:"two words"?'), ("f:v", "ok"), ("f:", "no hint")),
        "safe_unquoted": _values(
            "text, safe", ("plain", True), ("two words", False), ("AND", False), ("true", False), ("-x", False), ("a:b", False), ("a.b", True), ("", False), ("ünïcode", True), ("a*", False),
        ),
        "tree_helpers": _values("helper, value", ("field_path", "a|b.c|0"), ("field_name", "a.b.c.0"), ("range_bracket lower", "{"), ("range_bracket upper", "]"), ("is_node", "TrueFalse")),
        "constants": _values(
            "name, value", ("KEYWORD_LITERALS", "false null true"), ("RESERVED_WORDS", "AND NOT OR TO"), ("RESERVED_CHARACTERS", "\"'()*/:<=>?[\\]^{}~"), ("OPERATOR_PRECEDENCE", "-=30 AND=20 NOT=30 OR=10"),
            ("ROOT_NODE_TYPES", "EmptyExpression LiteralExpression LogicalExpression MissingExpression ParenthesizedExpression RangeExpression RegexExpression Tag UnaryOperator WildcardExpression"),
            ("SYNTHETIC", "0-0"), ("VERSION", "True"),
        ),
        "limits": _values(
            '"limit", outcome', ("depth 200", "ok"), ("depth over", "SYNTAX"), ("clauses 2000", "ok"), ("clauses over", "SYNTAX"), ("segments 32", "ok"), ("segments over", "SYNTAX"), ("pieces 512", "ok"), ("pieces over", "SYNTAX"),
        ),
        "tree_validation": _values(
            "made, outcome", ("term", "ok"), ("and", "ok"), *((k, "ARGUMENT") for k in ("no node", "literal of a number", "empty pattern", "flag twice", "operator", "field in a group", "joined by XOR", "empty inside", "too deep")),
        ),
        "option_validation": _values(
            "options, outcome", ("none", "ok"), ("unknown", "ok"), *((k, "CONFIG") for k in ("policy", "flag", "length", "half a date", "token twice", "hook", "type", "strategy", "id", "two of a name")),
        ),
        "detect_and_resolve": _typed("""SELECT text, shape, CASE WHEN moment IS NULL THEN of_day ELSE epoch_ms(CAST(moment AS TIMESTAMP)) END AS millis FROM (VALUES ('2020-06-15', 'date', '2020-06-15', NULL), ('2020/06/15', 'date', '2020-06-15', NULL),
  ('2020-02-30', 'date', NULL, NULL), ('14:30', 'time', NULL, 52200000), ('2020-06-15T10:30:00.250+02:00', 'datetime', '2020-06-15 08:30:00.25', NULL), ('2020-06-15 10:30', 'datetime', '2020-06-15 10:30:00', NULL),
  ('0099-01-01', 'date', '0099-01-01', NULL), ('2020-06-15' || chr(10), NULL, NULL, NULL), ('15-06-2020', NULL, '2020-06-15', NULL), ('June', NULL, NULL, NULL)) v(text, shape, moment, of_day)""", millis="BIGINT"),
        "recovered_throw": _values("query, outcome", ("f:x", "ok"), *((q, "RECOVERED") for q in ("(f:x", "f:", "f:[1 TO", 'f:"x', "f:x)", "f:x AND"))),
        "introspection": _typed(_values(
            "place, name, ordered", (0, "regex", False), (1, "null", False), (2, "boolean", False), (3, "wildcard", False), (4, "datetime", True), (5, "number", True), (6, "string", False), (7, "version", True),
        ), place="INTEGER"),
        "type_contexts": _values(
            "query, site, case_sensitive, sees_policy", ("a", "scan", False, False), ("f:a", "match", False, False), ("f::a", "match", True, False), ("f:=a", "equality", False, False), ("f:>a", "ordered", False, False), ("f:[a TO *]", "range", False, False),
        ),
        "type_guard": _values(
            "callback, outcome", ("sound", "ok"), ("parse raises", "OPERAND"), ("parse returns text", "CONFIG"), ("equals raises", "CONFIG"), ("equals returns True", "CONFIG"), ("equals returns a number", "CONFIG"),
        ),
        "sealed_policy": _values("what, outcome", ("change a policy", "TypeError"), ("replace a policy", "TypeError"), ("match miss", "no-match"), ("range miss", "value-error")),
        "value_error_raises": _values(
            'query, outcome, field, site', ("p_size:>5", "ok", None, None), ("p_name:>5", "VALUE", "p_name", "ordered"), ("p_size:>5 OR p_brand:>1", "VALUE", "p_brand", "ordered"),
            ("p_name:nosuch AND p_type:>=5", "VALUE", "p_type", "ordered"), ("p_name:5", "ok", None, None), ("5", "ok", None, None), ("p_brand:[1 TO 2]", "VALUE", "p_brand", "range"),
        ),
        "number_text_lf": _ids(0, 10),
        "number_text_long": _ids(8),
        "date_text_lf": _ids(3),
        "time_lf": _ids(5),
        "highlight_map": lit((1, "m|colour", "0-3")),
        "highlight_keys": lit((1, "m|colour", "0-3"), (2, "m|red", "0-3")),
        "highlight_sparse": lit((1, "items|1|v", "0-1"), (2, "items|0|v", "0-1"), (2, "items|1|v", "0-1")),
        "highlight_nested": lit((1, "n|0|1", "none"), (1, "n|2|1", "none"), (2, "id", "none"), (2, "n|0|0", "none")),
        "highlight_fold": lit((1, "city", "none"), (2, "city", "0-5")),
        "highlight_dedupe": lit((1, "a|b", "none"), (1, "a.b", "0-1")),
        "highlight_both_ways": "SELECT o_orderkey, 'o_orderstatus' AS path, '0-1' AS spans FROM orders WHERE o_orderstatus = 'F'",
        "highlight_sanitised": "SELECT o_orderkey, 'o_orderstatus' AS path, '0-1' AS spans FROM orders WHERE o_orderstatus = 'F'",
        "path_quoted": _ids(1),
        "path_nested_index": _ids(1, 2),
        "keys_inside_arrays": _ids(1, 2),
        "keys_are_no_values": "SELECT CAST(0 AS INTEGER) AS id WHERE false",
        "date_years": _ids(0, 1, 3, 5),
        "extend": "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1997-06-01'",
        "keyword_as_term": "SELECT doc_id FROM documents WHERE lower(lang) = 'en' AND (contains(lower(text), 'and') OR contains(lower(lang), 'and'))",
        "escaped_value": "SELECT c_custkey, c_name FROM customer WHERE lower(c_name) LIKE 'customer#00000001_'",
        "regex_unguarded": "SELECT doc_id FROM documents WHERE contains(lower(text), 'the mit license')",
        "regex_scan": r"SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '\Ablue b[a-z]+t\z')",
        "date_digits": """SELECT o_orderkey, packed FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 19960631 ELSE CAST(strftime(o_orderdate, '%Y%m%d') AS BIGINT) END AS packed FROM orders)
WHERE packed <> 19960631 AND packed >= 19960601 AND packed < 19970101""",
        "date_hook": "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'",
    }
