"""DuckDB SQL with the same meaning as each registered query of the language."""

from __future__ import annotations

NESTED = """(SELECT c_custkey,
  CASE WHEN c_custkey % 5 <> 0 THEN struct_pack(segment := c_mktsegment, balance := CASE WHEN c_acctbal > 0 THEN c_acctbal END) END AS meta,
  c_name AS n0, c_custkey % 7 AS i0, c_custkey % 3 AS i1, CASE WHEN c_custkey % 2 = 0 THEN 'red' ELSE 'blue' END AS colour,
  c_mktsegment AS size, string_split(c_mktsegment, 'I') AS words FROM customer) nested"""
LABELLED = """(SELECT d.doc_id, d.lang, d.source, l.toxic = 1 AS toxic, l.quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id) labelled"""
DATED = """(SELECT o_orderkey,
  CASE WHEN o_orderkey % 4 = 0 THEN 'n/a' WHEN o_orderkey % 4 = 1 THEN strftime(o_orderdate, '%Y/%m/%d') ELSE strftime(o_orderdate, '%Y-%m-%d') || 'T10:30:00.5+02:00' END AS text,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 4 = 1 THEN CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) ELSE CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) + INTERVAL '8 hours 30 minutes 500 milliseconds' END AS read,
  epoch_ms(o_orderdate) AS millis, CAST(o_orderdate AS DATE) AS day, strftime(o_orderdate, '%d-%m-%Y') AS local,
  printf('%02d:%02d', CAST(o_orderkey % 24 AS INTEGER), CAST(o_orderkey % 60 AS INTEGER)) AS clock,
  CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey || '.50' WHEN o_orderkey % 3 = 1 THEN 'v' || o_orderkey ELSE CAST(o_orderkey AS VARCHAR) END AS number FROM orders) dated"""
LICENSE_HITS = """WITH d AS (SELECT doc_id, lower(text) AS t FROM documents WHERE contains(lower(text), 'license') AND length(lower(text)) = length(text)),
  p AS (SELECT doc_id, string_split(t, 'license') AS parts FROM d),
  s AS (SELECT doc_id, list_transform(range(1, len(parts)), lambda i: list_sum(list_transform(parts[1:i], lambda x: length(x))) + 7 * (i - 1)) AS starts FROM p)
SELECT doc_id, 'text' AS path, array_to_string(list_transform(starts, lambda a: CAST(CAST(a AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(a AS BIGINT) + 7 AS VARCHAR)), ',') AS spans FROM s"""


def _where(table: str, condition: str, *columns: str) -> str:
    return f"SELECT {', '.join(columns)} FROM {table} WHERE {condition}"


def oracle_sql() -> dict[str, str]:
    keys = ("l_orderkey", "l_linenumber")
    return {
        "flagship": _where("lineitem", "lower(l_returnflag) = 'r' AND l_shipdate >= TIMESTAMP '1995-01-01' AND NOT coalesce(l_quantity > 5, false)", *keys, "l_quantity"),
        "eq_ci": _where("orders", "lower(o_orderpriority) = '1-urgent'", "o_orderkey", "o_orderpriority"),
        "eq_cs": _where("orders", "o_orderpriority = '1-URGENT'", "o_orderkey"),
        "eq_cs_miss": _where("orders", "o_orderpriority = '1-urgent'", "o_orderkey"),
        "eq_relational": _where("customer", "lower(c_mktsegment) = 'building'", "c_custkey", "c_mktsegment"),
        "number_eq": _where("part", "p_size = 15", "p_partkey", "p_size"),
        "number_ordered": _where("part", "p_size > 40 AND p_size <= 45", "p_partkey", "p_size"),
        "number_quoted": _where("part", "false", "p_partkey"),
        "number_text": _where(DATED, "TRY_CAST(number AS DOUBLE) >= 100", "o_orderkey", "number"),
        "number_range_incl": _where("lineitem", "l_quantity >= 10 AND l_quantity <= 12", *keys, "l_quantity"),
        "number_range_excl": _where("lineitem", "l_quantity > 10 AND l_quantity < 12", *keys, "l_quantity"),
        "number_range_mixed": _where("lineitem", "l_quantity >= 10 AND l_quantity < 12", *keys, "l_quantity"),
        "number_range_open": _where("customer", "c_acctbal < 0", "c_custkey", "c_acctbal"),
        "date_ge": _where("lineitem", "l_shipdate >= TIMESTAMP '1998-01-01'", *keys),
        "date_range": _where("orders", "o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1996-07-01'", "o_orderkey", "o_orderdate"),
        "date_offset": _where("orders", "o_orderdate > TIMESTAMP '1995-12-31 22:00:00' AND o_orderdate < TIMESTAMP '1996-02-01 05:00:00'", "o_orderkey", "o_orderdate"),
        "date_text": _where(DATED, "read >= TIMESTAMP '1996-03-01 08:30:00.5'", "o_orderkey", "text"),
        "date_column": _where(DATED, "day >= DATE '1996-02-02' AND day <= DATE '1996-02-10'", "o_orderkey", "day"),
        "date_epoch": _where(DATED, "millis < epoch_ms(TIMESTAMP '1996-01-01')", "o_orderkey"),
        "date_format": _where(DATED, "day >= DATE '1997-06-01'", "o_orderkey", "local"),
        "time_of_day": _where(DATED, "clock >= '08:30' AND clock < '17:15'", "o_orderkey", "clock"),
        "wildcard_prefix": _where("part", "lower(p_name) LIKE 'blu%'", "p_partkey", "p_name"),
        "wildcard_suffix": _where("part", "lower(p_name) LIKE '%bolt'", "p_partkey", "p_name"),
        "wildcard_contains": _where("part", "p_type LIKE '%ECONOMY%'", "p_partkey", "p_type"),
        "wildcard_multi": _where("documents", "regexp_matches(lower(text), '(?s)th.*or.*ing.*sh')", "doc_id"),
        "wildcard_ends": _where("part", "lower(p_name) LIKE 'b%e%t'", "p_partkey", "p_name"),
        "wildcard_single": _where("customer", "lower(c_name) LIKE '%#_____0__5'", "c_custkey", "c_name"),
        "wildcard_length": _where("orders", "length(o_orderpriority) = 5", "o_orderkey", "o_orderpriority"),
        "wildcard_any": _where("part", "p_name IS NOT NULL", "p_partkey"),
        "regex_plain": _where("documents", "contains(text, 'license')", "doc_id"),
        "regex_flag_i": _where("documents", "regexp_matches(text, '(?i)the (MIT|apache) license')", "doc_id"),
        "regex_class": _where("customer", r"regexp_matches(c_name, '#0*[1-9]\d?[02468]\z')", "c_custkey", "c_name"),
        "regex_lines": _where("documents", r"regexp_matches(text, '(?m)^Th[a-f]+ [a-z]{3} ')", "doc_id"),
        "null_eq": _where(LABELLED, "quality IS NULL", "doc_id"),
        "null_under_null": _where(NESTED, "meta IS NOT NULL AND meta.balance IS NULL", "c_custkey"),
        "present": _where(LABELLED, "toxic IS NOT NULL", "doc_id"),
        "boolean_eq": _where(LABELLED, "toxic = true OR (toxic = false AND quality = 0)", "doc_id", "toxic"),
        "bool_ops": _where("orders", "lower(o_orderstatus) IN ('f', 'p') AND o_totalprice > 200000 AND NOT lower(o_orderpriority) LIKE '5%'", "o_orderkey"),
        "not_two_valued": _where(LABELLED, "NOT coalesce(quality = 1, false)", "doc_id"),
        "not_nested": _where(LABELLED, "NOT (coalesce(toxic = false, false) AND NOT coalesce(quality = 1, false))", "doc_id"),
        "field_group": _where("part", "lower(p_brand) LIKE 'brand#1%' OR (lower(p_brand) = 'brand#22' AND NOT lower(p_brand) LIKE '%3')", "p_partkey", "p_brand"),
        "field_group_numbers": _where("customer", "c_acctbal = -500 OR (c_acctbal >= -100 AND c_acctbal <= -50)", "c_custkey", "c_acctbal"),
        "or_many": _where("part", "lower(p_brand) IN (" + ", ".join(f"'brand#{i}'" for i in range(11, 36)) + ")", "p_partkey"),
        "scan_text": _where("customer", "contains(lower(c_name), 'machinery') OR contains(lower(c_mktsegment), 'machinery')", "c_custkey"),
        "scan_number": _where("part", "p_partkey = 7 OR p_size = 7 OR p_name = '7' OR p_brand = '7' OR p_type = '7'", "p_partkey"),
        "scan_wildcard": _where("customer", "lower(c_name) LIKE 'auto%' OR lower(c_mktsegment) LIKE 'auto%'", "c_custkey"),
        "scan_date": _where("orders", "o_orderdate = TIMESTAMP '1996-01-02'", "o_orderkey"),
        "scan_null": _where(LABELLED, "lang IS NULL OR source IS NULL OR toxic IS NULL OR quality IS NULL", "doc_id"),
        "scan_nested": _where(NESTED, "(contains(lower(n0), 'blue') OR colour = 'blue' OR contains(lower(size), 'blue')) AND contains(lower(size), 'household')", "c_custkey"),
        "scan_range": _where("part", "false", "p_partkey"),
        "match_keys": _where(NESTED, "c_custkey = 3 OR i0 = 3 OR coalesce(meta.balance = 3, false)", "c_custkey"),
        "path_struct": _where(NESTED, "lower(meta.segment) = 'building'", "c_custkey"),
        "path_map": _where(NESTED, "lower(colour) = 'red'", "c_custkey"),
        "path_array_of_structs": _where(NESTED, "i0 = 2 OR i1 = 2", "c_custkey"),
        "array_any": _where(NESTED, "len(list_filter(words, lambda w: lower(w) LIKE 'tur%')) > 0", "c_custkey"),
        "array_regex": _where(NESTED, r"len(list_filter(words, lambda w: regexp_matches(w, '\A[A-M].*E\z'))) > 0", "c_custkey"),
        "array_index": _where(NESTED, "i1 = 0 AND lower(words[1]) LIKE 'mach%'", "c_custkey"),
        "array_float": _where("embeddings", "len(list_filter(embedding, lambda x: CAST(x AS DOUBLE) > 0.4)) > 0", "vec_id", "label"),
        "unknown_field": _where("part", "p_size = 1", "p_partkey"),
        "empty_query": "SELECT c_custkey FROM customer",
        "test_column": "SELECT o_orderkey, coalesce(o_totalprice > 150000, false) OR coalesce(lower(o_orderstatus) = 'f', false) AS matched FROM orders",
        "highlight_text": f"{LICENSE_HITS} UNION ALL SELECT doc_id, 'text', '' FROM documents WHERE contains(lower(text), 'license') AND length(lower(text)) <> length(text)",
        "highlight_fielded": """WITH m AS (SELECT * FROM orders WHERE lower(o_orderstatus) = 'f' AND o_totalprice > 300000)
SELECT o_orderkey, 'o_orderstatus' AS path, '0-1' AS spans FROM m UNION ALL SELECT o_orderkey, 'o_totalprice', '' FROM m""",
        "highlight_or_not": """SELECT o_orderkey, 'o_orderstatus' AS path, '0-1' AS spans FROM orders WHERE lower(o_orderstatus) = 'p'
UNION ALL SELECT o_orderkey, 'o_totalprice', '' FROM orders WHERE o_totalprice > 350000 AND NOT coalesce(lower(o_orderstatus) = 'f', false)""",
        "highlight_wildcard": """SELECT p_partkey, 'p_name' AS path, '0-2,' || (instr(lower(p_name), 'bolt') - 1) || '-' || (instr(lower(p_name), 'bolt') + 3) AS spans
FROM part WHERE lower(p_name) LIKE 'bl%bolt'""",
        "highlight_array": f"""SELECT c_custkey, 'words.' || (i - 1) AS path, (length(words[i]) - 1) || '-' || length(words[i]) AS spans
FROM (SELECT c_custkey, words, unnest(range(1, len(words) + 1)) AS i FROM {NESTED}) WHERE lower(words[i]) LIKE '%y' AND strlen(replace(lower(words[i]), 'y', '')) = strlen(words[i]) - 1""",
        "highlight_regex": """SELECT c_custkey, 'c_name' AS path, (instr(c_name, m) - 1) || '-' || (instr(c_name, m) - 1 + length(m)) AS spans
FROM (SELECT c_custkey, c_name, regexp_extract(c_name, '0{3,}[1-4]') AS m FROM customer) WHERE m <> ''""",
        "tolerant_prune": _where("orders", "lower(o_orderstatus) = 'f' AND o_totalprice > 250000", "o_orderkey"),
        "tolerant_repair": _where("orders", "lower(o_orderstatus) = 'p'", "o_orderkey"),
        "value_error_throw": _where("part", "p_size >= 45 OR lower(p_brand) = 'brand#11'", "p_partkey"),
        "custom_type": _where("(SELECT p_partkey, '1.' || (p_partkey % 12) || '.' || (p_size % 20) AS release, p_partkey % 12 AS minor FROM part) r", "minor >= 2 AND minor < 10", "p_partkey", "release"),
        "built_tree": _where("orders", "lower(o_orderstatus) = 'f' AND NOT coalesce(o_totalprice < 100000, false)", "o_orderkey", "o_totalprice"),
        "round_trip": _where("orders", "lower(o_orderstatus) IN ('f', 'o') AND NOT lower(o_orderpriority) LIKE '%urgent%' AND o_totalprice >= 1000 AND o_totalprice < 250000", "o_orderkey"),
        "stream_filter": _where("events", "lower(event_type) LIKE '%c%' AND value > 50", "event_id", "value"),
    }
