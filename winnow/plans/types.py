"""Value types: how an operand's text picks one, and how each reads and compares columns.

A type works at plan time. ``parse_operand`` claims the operand, declines it or says why it is wrong; ``read`` turns
a column of a known type into one of readable values, or says that no value of it can be one.
"""

from __future__ import annotations

import operator as operators
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from datetime import UTC
from decimal import Decimal
from types import MappingProxyType

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from winnow.functions import numbers, temporal
from winnow.functions.text import glob, regex_match
from winnow.plans.errors import ArgumentError, ConfigError, OperandError, QueryError
from winnow.plans.tree import ORDERINGS, Literal, Node, Regex, Wildcard

#: What happens to a value that a clause can't use: by site, for a value of another type (miss), one that is no
#: value of the type (invalid), and one that can't be compared with the operand.
VALUE_FAILURE_POLICY = MappingProxyType({
    "scan": MappingProxyType({"miss": "no-match", "invalid": "no-match", "incomparable": "no-match"}),
    "match": MappingProxyType({"miss": "no-match", "invalid": "value-error", "incomparable": "no-match"}),
    "equality": MappingProxyType({"miss": "no-match", "invalid": "value-error", "incomparable": "no-match"}),
    "ordered": MappingProxyType({"miss": "value-error", "invalid": "value-error", "incomparable": "value-error"}),
    "range": MappingProxyType({"miss": "value-error", "invalid": "value-error", "incomparable": "value-error"}),
})
BUILTIN_TYPE_ORDER = ("regex", "null", "boolean", "wildcard", "datetime", "number", "string")


@dataclass(frozen=True)
class Claimed:
    value: object


@dataclass(frozen=True)
class Malformed:
    reason: str


DECLINED = None
_COMPARES = {":>": operators.gt, ":>=": operators.ge, ":<": operators.lt, ":<=": operators.le}


@dataclass(frozen=True)
class Reading:
    """A column's values as a type reads them (null where it can't), and which values are invalid.

    ``invalid`` may be a function that makes the condition: only a strict policy asks for it.
    """

    value: Column
    invalid: Column | Callable[[], Column] | None = None


@dataclass(frozen=True)
class Settings:
    """What of an engine's options a value type may see: not the failure policy, which is the engine's own."""

    match_keys: bool = False
    regex_guard: bool = True
    max_pattern_length: int | None = None


@dataclass(frozen=True)
class Context:
    """What an operand is read with."""

    site: str = "match"  # scan, match, equality, ordered or range
    case_sensitive: bool = False
    options: Settings = Settings()
    lookup: Callable = lambda name: None


class ValueType:
    """A custom type overrides these. ``matches`` is what ``:`` and scans ask; ``compare`` makes the type ordered."""

    name = ""
    ordered = False

    def parse_operand(self, operand: Node, context: Context) -> Claimed | Malformed | None:
        return DECLINED

    def read(self, column: Column, kind: T.DataType, operand: object, context: Context) -> Reading | None:
        """None: no value of this column's type is one of this type (a miss)."""
        return None

    def matches(self, value: Column, operand: object, context: Context) -> Column | None:
        return self.equals(value, operand, context)

    def equals(self, value: Column, operand: object, context: Context) -> Column | None:
        return value == F.lit(operand)

    def compare(self, value: Column, operator: str, operand: object, context: Context) -> Column:
        """``value operator operand`` for the operators :> :>= :< :<=."""
        return _COMPARES[operator](value, operand)

    def exists(self, values: Column, operand: object, context: Context) -> Column | None:
        """Whether any text of an array matches, for types that can't test inside a lambda; None: test each."""
        return None

    def comparable(self, lower: object, upper: object) -> bool:
        return True

    def spans(self, operand: object, context: Context) -> Callable[[str], list[tuple[int, int]]] | str | None:
        """How to highlight: a function from text to spans, "whole" for all of it, None for the bare path."""
        return None


def _coerced(coerce: Callable[[object], object | None], text: str) -> object | None:
    try:
        return coerce(text)
    except Exception:  # noqa: BLE001 - a custom type's function: what it can't take is no value of it
        return None


def coerced(name: str, claim: Callable[[str], object | None], coerce: Callable[[object], object | None], result: str, ordered: bool = True) -> ValueType:
    """A custom type from two Python functions: of the operand's text, and of a column's text (None: not a value).

    Values are coerced in Arrow batches to the Spark type ``result``, whose own equality and order are used. A text for
    which ``coerce`` raises is invalid, as one for which it returns None; a result of another type than ``result`` is
    the type's defect and fails the job with a message that names the type.
    """

    class Custom(ValueType):
        def parse_operand(self, operand, context):
            if isinstance(operand, Literal) and operand.kind == "text":
                found = claim(operand.value)
                return DECLINED if found is None else found if isinstance(found, (Claimed, Malformed)) else Claimed(found)
            return DECLINED

        def read(self, column, kind, operand, context):
            if not isinstance(kind, T.StringType):
                return None
            arrow = to_arrow_type(T._parse_datatype_string(result))

            @F.arrow_udf(result)
            def values(texts: pa.Array) -> pa.Array:
                read = [None if t is None else _coerced(coerce, t) for t in texts.to_pylist()]
                try:
                    return pa.array(read, arrow)
                except (pa.ArrowInvalid, pa.ArrowTypeError, TypeError) as e:
                    raise ConfigError(f'Value type "{name}": coerce must return {result} or None ({e})', option="types") from e

            read = values(column)
            return Reading(read, column.isNotNull() & read.isNull())

    out = Custom()
    out.name, out.ordered = name, ordered
    return out


# Built-in types


class _Null(ValueType):
    name = "null"

    def parse_operand(self, operand, context):
        return Claimed(None) if isinstance(operand, Literal) and operand.kind == "null" else DECLINED

    def read(self, column, kind, operand, context):
        return Reading(column)

    def equals(self, value, operand, context):
        return value.isNull()


class _Boolean(ValueType):
    name = "boolean"

    def parse_operand(self, operand, context):
        return Claimed(operand.value) if isinstance(operand, Literal) and operand.kind == "boolean" else DECLINED

    def read(self, column, kind, operand, context):
        return Reading(column) if isinstance(kind, T.BooleanType) else None


class _Text(ValueType):
    """What string, wildcard and regex share: they read text alone."""

    def read(self, column, kind, operand, context):
        return Reading(column) if isinstance(kind, T.StringType) else None


class _String(_Text):
    name = "string"

    def parse_operand(self, operand, context):
        return Claimed(operand.value) if isinstance(operand, Literal) and operand.kind == "text" else DECLINED

    def equals(self, value, operand, context):
        if context.site == "scan":
            return F.lower(value).contains(operand.lower())
        return value == operand if context.case_sensitive else F.lower(value) == operand.lower()

    def spans(self, operand, context):
        if context.site != "scan":
            return "whole"
        needle = operand.lower()

        def occurrences(text: str) -> list[tuple[int, int]]:
            folded = text.lower()
            if not needle or len(folded) != len(text):
                return []
            out, at = [], folded.find(needle)
            while at >= 0:
                out.append((at, at + len(needle)))
                at = folded.find(needle, at + len(needle))
            return out

        return occurrences


class _Wildcard(_Text):
    name = "wildcard"

    def parse_operand(self, operand, context):
        return Claimed(operand.pattern) if isinstance(operand, Wildcard) else DECLINED

    def equals(self, value, operand, context):
        if context.case_sensitive:
            return glob(value, operand)
        if len(operand) == 1 and not isinstance(operand[0], str):
            return glob(value, operand)  # case says nothing
        return glob(F.lower(value), tuple(p.lower() if isinstance(p, str) else p for p in operand))

    def exists(self, values, operand, context):
        if context.case_sensitive:
            return glob(values, operand, True)
        return glob(F.transform(values, F.lower), tuple(p.lower() if isinstance(p, str) else p for p in operand), True)

    def spans(self, operand, context):
        fold = (lambda s: s) if context.case_sensitive else str.lower
        pieces = sorted({fold(p) for p in operand if isinstance(p, str)}, key=lambda p: (-len(p), p))

        def places(text: str) -> list[tuple[int, int]]:
            folded = fold(text)
            if len(folded) != len(text):
                return []
            taken: list[tuple[int, int]] = []
            for p in pieces:
                at = folded.find(p)
                while at >= 0:
                    if all(at >= b or at + len(p) <= a for a, b in taken):
                        taken.append((at, at + len(p)))
                        at = folded.find(p, at + len(p))
                    else:
                        at = folded.find(p, at + 1)
            return sorted(taken)

        return places


class _Regex(_Text):
    name = "regex"

    def parse_operand(self, operand, context):
        if not isinstance(operand, Regex):
            return DECLINED
        regex_match(F.lit(""), operand.pattern, operand.flags, context.options.max_pattern_length, context.options.regex_guard)  # refuses now
        return Claimed(operand)

    def equals(self, value, operand, context):
        return regex_match(value, operand.pattern, operand.flags, context.options.max_pattern_length, context.options.regex_guard)

    def exists(self, values, operand, context):
        return regex_match(values, operand.pattern, operand.flags, context.options.max_pattern_length, context.options.regex_guard, True)

    def spans(self, operand, context):
        from winnow.functions import regex as rx

        try:
            code = rx.program(rx.parse(operand.pattern, operand.flags))
        except OperandError:
            return None
        return lambda text: [m for m in rx.matches(code, text, "m" in operand.flags) if m[1] > m[0]]


_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


class _Number(ValueType):
    name, ordered = "number", True

    def parse_operand(self, operand, context):
        if not (isinstance(operand, Literal) and operand.kind == "text") or operand.quoted:
            return DECLINED
        found = numbers.parse_number(operand.value)
        return DECLINED if found is None else Claimed(found)

    def read(self, column, kind, operand, context):
        if isinstance(kind, (T.FloatType, T.DoubleType)):
            return Reading(column, lambda: F.isnan(column) | (F.abs(column) == float("inf")))
        if isinstance(kind, (*_INTEGERS, T.DecimalType)):
            return Reading(column)
        return Reading(numbers.number_column(column)) if isinstance(kind, T.StringType) else None

    def literal(self, kind: T.DataType, operand: int | float):
        """The operand as the column's own type where that is exact, so that the scan can take it."""
        if isinstance(operand, int) and isinstance(kind, _INTEGERS) and -(2**63) <= operand < 2**63:
            return F.lit(operand)
        if isinstance(kind, T.DecimalType):
            return F.lit(Decimal(repr(operand)))
        return F.lit(float(operand))

    def finite(self, kind: T.DataType, value: Column, test: Column, upper: bool, lower: bool) -> Column:
        if not isinstance(kind, (T.FloatType, T.DoubleType)):
            return test
        if upper:  # NaN counts as the largest
            test = test & (value < float("inf"))
        return test & (value > -float("inf")) if lower else test


class _Datetime(ValueType):
    """Made for an engine, since its layouts and hook are the engine's."""

    name, ordered = "datetime", True

    def __init__(self, formats: tuple[str, ...] = (), hook: Callable | None = None):
        self.formats, self.hook = formats, hook

    def parse_operand(self, operand, context):
        if not (isinstance(operand, Literal) and operand.kind == "text"):
            return DECLINED
        found = temporal.resolve(operand.value, self.formats, self.hook)
        if found is not None:
            return Claimed(found)
        shaped = temporal.detect_format(operand.value) or any(temporal.layout(f).read(operand.value) is False for f in self.formats)
        return Malformed(f'"{operand.value}" is not a real date') if shaped else DECLINED

    def exists(self, values: Column, operand: object, context: Context) -> Column | None:
        """Whether any text of an array matches, for types that can't test inside a lambda; None: test each."""
        return None

    def comparable(self, lower, upper):
        return lower.domain == upper.domain

    def read(self, column, kind, operand, context):
        instant = operand.domain == "instant"
        none = F.lit(None).cast("long")
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            return Reading(column if instant else none)
        if isinstance(kind, T.StringType):
            either = lambda d: temporal.text_column(column, d, self.formats, self.hook)
            return Reading(either(operand.domain), lambda: column.isNotNull() & either("instant").isNull() & either("time").isNull())
        if isinstance(kind, (*_INTEGERS, T.FloatType, T.DoubleType, T.DecimalType)):
            return self._from_number(column, kind, operand, none)
        return None

    def _from_number(self, column, kind, operand, none):
        """Epoch milliseconds; a layout of digits alone reads a number of its width first, and none else may."""
        millis = column if isinstance(kind, T.LongType) else column.cast("long") if isinstance(kind, _INTEGERS) else column.try_cast("long")
        whole = (millis <= temporal.MAX_INSTANT) & (millis >= -temporal.MAX_INSTANT)
        widths = [w for f in self.formats if (w := temporal.layout(f).digits)]
        # Bare, for the scan, where it can be: `test` keeps within the instants.
        value = millis if not widths and operand.domain == "instant" and isinstance(kind, _INTEGERS) else F.when(whole, millis)
        if widths:
            text = millis.cast("string")
            by_layout = temporal.text_column(text, operand.domain, self.formats)
            value = F.when(F.length(text).isin(widths), by_layout).otherwise(value if operand.domain == "instant" else none)
        elif operand.domain != "instant":
            value = none
        return Reading(value, lambda: column.isNotNull() & ~F.coalesce(whole, F.lit(False)))


def _moment(operand: temporal.Temporal, kind: T.DataType):
    moment = operand.moment()
    if moment is None:
        return None
    return F.lit(moment.replace(tzinfo=None)).cast("timestamp_ntz") if isinstance(kind, T.TimestampNTZType) else F.lit(moment.astimezone(UTC))


def date_test(column: Column, operator: str, operand: temporal.Temporal) -> Column:
    """A date is its midnight in UTC: the bound moves to a whole day, and the column stays bare."""
    days, rest = divmod(operand.millis, 86_400_000)
    day = lambda n: F.date_add(F.lit("1970-01-01").cast("date"), F.lit(n))
    if operator in (":", ":="):
        return column == day(days) if not rest else F.lit(False)
    if operator in (":>", ":<="):
        return column > day(days) if operator == ":>" else column <= day(days)
    return column >= day(days + bool(rest)) if operator == ":>=" else column < day(days + bool(rest))


def test(kind: ValueType, reading: Reading, column_type: T.DataType, operator: str, operand: object, context: Context, between: bool = False) -> Column:
    """``value operator operand``, null or false where it doesn't hold. ``between``: another test bounds the other side."""
    value = reading.value
    if isinstance(kind, _Number):
        if isinstance(column_type, T.StringType):
            column_type = T.DoubleType()
        number = kind.literal(column_type, operand)
        out = value == number if operator in (":", ":=") else ValueType.compare(kind, value, operator, number, context)
        return out if between else kind.finite(column_type, value, out, operator in (":>", ":>="), operator in (":<", ":<="))
    if isinstance(kind, _Datetime):
        if isinstance(column_type, T.DateType) and operand.domain == "instant":
            return date_test(value, operator, operand)
        bound = F.lit(operand.millis)
        if isinstance(column_type, (T.TimestampType, T.TimestampNTZType)) and operand.domain == "instant":
            bound = _moment(operand, column_type)
            if bound is None:  # before year 1: every timestamp that Spark reads from files is later
                return value.isNotNull() if operator in (":>", ":>=") else F.lit(False)
        if operator in (":", ":="):
            return value == bound
        out = ValueType.compare(kind, value, operator, bound, context)
        if isinstance(column_type, T.LongType) and not between:
            out = out & (value <= temporal.MAX_INSTANT if operator in (":>", ":>=") else value >= -temporal.MAX_INSTANT)
        return out
    return _custom(kind, reading.value, operator, operand, context)


def _custom(kind: ValueType, value: Column, operator: str, operand: object, context: Context) -> Column:
    """What a type's own method says of values; anything but a Column is the type's defect."""
    method = {":": "matches", ":=": "equals"}.get(operator, "compare")
    try:
        out = kind.compare(value, operator, operand, context) if method == "compare" else getattr(kind, method)(value, operand, context)
    except QueryError:
        raise
    except Exception as e:
        raise ConfigError(f'Value type "{kind.name}": {method} failed ({e})', option="types") from e
    if not isinstance(out, Column):
        raise ConfigError(f'Value type "{kind.name}": {method} must return a Column of booleans, not {type(out).__name__}', option="types")
    return out


# The registry


@dataclass(frozen=True)
class Registry:
    """Types in the order in which they are asked; names are unique."""

    types: tuple[ValueType, ...]

    def __post_init__(self):
        names = [t.name for t in self.types]
        if len(set(names)) < len(names) or not all(names):
            raise ConfigError(f"Value types need distinct names: {names}")

    def get(self, name: str) -> ValueType | None:
        return next((t for t in self.types if t.name == name), None)

    def describe(self) -> list[dict]:
        return [{"name": t.name, "ordered": t.ordered} for t in self.types]

    def with_types(self, types: Iterable[ValueType], strategy: str = "prepend") -> Registry:
        types = tuple(types)
        orders = {"prepend": types + self.types, "append": self.types + types, "replace": types}
        if strategy not in orders:
            raise ConfigError(f"No such strategy: {strategy}")
        return Registry(orders[strategy])

    def resolve(self, operand: Node, context: Context, raw: str) -> tuple[ValueType, object]:
        """The first type that claims the operand, and its reading; raises where one calls it malformed or none claims it."""
        for kind in self.types:
            try:
                found = kind.parse_operand(operand, context)
            except QueryError:
                raise
            except Exception as e:
                raise OperandError(f'Value type "{kind.name}" failed on the operand {raw}: {e}', raw=raw) from e
            if isinstance(found, Malformed):
                raise OperandError(f"{found.reason} ({raw})", raw=raw)
            if found is not None:
                if not isinstance(found, Claimed):
                    raise ConfigError(f'Value type "{kind.name}": parse_operand returned {found!r}')
                if context.site in ("ordered", "range") and not kind.ordered:
                    raise OperandError(f'"{raw}" is of type "{kind.name}", which has no order', "UNORDERED_TYPE", raw=raw)
                return kind, found.value
        raise OperandError(f"No value type takes {raw!r}", raw=raw)


def builtin_types(formats: tuple[str, ...] = (), hook: Callable | None = None) -> tuple[ValueType, ...]:
    made = {"regex": _Regex(), "null": _Null(), "boolean": _Boolean(), "wildcard": _Wildcard(), "datetime": _Datetime(formats, hook), "number": _Number(), "string": _String()}
    return tuple(made[name] for name in BUILTIN_TYPE_ORDER)


def disposition(site: str, kind: str) -> str:
    try:
        return VALUE_FAILURE_POLICY[site][kind]
    except KeyError:
        raise ArgumentError(f"No policy for {kind} at {site}") from None


__all__ = ["BUILTIN_TYPE_ORDER", "DECLINED", "ORDERINGS", "VALUE_FAILURE_POLICY", "Claimed", "Context", "Malformed", "Reading", "Registry", "Settings", "ValueType", "builtin_types", "coerced", "disposition", "test"]
