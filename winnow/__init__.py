"""A search-query language for Spark DataFrames: text to a syntax tree, and the tree to Catalyst expressions."""

from winnow.functions.temporal import detect_format, resolve as resolve_temporal
from winnow.operators.engine import Engine, Options, default_engine, filter, highlight, test, value_error  # noqa: A004
from winnow.plans import builders
from winnow.plans.errors import (
    ArgumentError, ConfigError, DateFormatError, OperandError, QueryError, RecoveredQueryError, Span, SyntaxError_, ValueError_, is_query_error,
)
from winnow.plans.limits import MAX_AST_DEPTH, MAX_AST_NODES, MAX_CLAUSES, MAX_DEPTH, MAX_FIELD_SEGMENTS, MAX_WILDCARD_SEGMENTS
from winnow.plans.parser import parse
from winnow.plans.serializer import serialize
from winnow.plans.tree import (
    KEYWORD_LITERALS, OPERATOR_PRECEDENCE, RESERVED_CHARACTERS, RESERVED_WORDS, ROOT_NODE_TYPES, SYNTHETIC, field_name, field_path, from_dict, is_node, is_safe_unquoted, range_bracket, to_dict,
)
from winnow.plans.types import BUILTIN_TYPE_ORDER, DECLINED, VALUE_FAILURE_POLICY, Claimed, Context, Malformed, Reading, Registry, ValueType, builtin_types, coerced, disposition

VERSION = "0.1.0"

__all__ = [n for n in dir() if not n.startswith("_")]
