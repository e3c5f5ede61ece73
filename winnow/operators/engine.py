"""The engine: options, and the verbs that turn a query into a filtered or annotated DataFrame."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, fields, replace
from functools import cached_property, lru_cache

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from winnow.functions import temporal
from winnow.plans import recover
from winnow.plans.compile import HIT, RAISED, Compiled, Compiler, free_name, raising
from winnow.plans.errors import ArgumentError, ConfigError, ValueError_
from winnow.plans.parser import parse
from winnow.plans.tree import Empty, Node
from winnow.plans.types import Registry, ValueType, builtin_types
from winnow.plans.validate import check_tree

_CHOICES = {"type_strategy": ("prepend", "append", "replace"), "on_value_error": ("skip", "throw"), "on_recovered": ("prune", "throw")}


@dataclass(frozen=True)
class Options:
    """What an engine is made with. None in ``extend`` means: as before."""

    types: tuple[ValueType | Callable, ...] = ()
    type_strategy: str = "prepend"
    date_format: str | tuple[str, ...] | None = None
    parse_date: Callable | None = None
    match_keys: bool = False
    on_value_error: str = "skip"
    on_recovered: str = "prune"
    tolerant: bool = False
    regex_guard: bool = True
    max_pattern_length: int = 1000
    id: str = "default"
    #: Raise for a top-level field that the schema doesn't have, instead of finding nothing.
    strict_fields: bool = False

    def __post_init__(self):
        for name, choices in _CHOICES.items():
            if getattr(self, name) not in choices:
                raise ConfigError(f"{name} is one of {', '.join(choices)}, not {getattr(self, name)!r}", option=name)
        for name in ("match_keys", "tolerant", "regex_guard", "strict_fields"):
            if not isinstance(getattr(self, name), bool):
                raise ConfigError(f"{name} is true or false, not {getattr(self, name)!r}", option=name)
        if not isinstance(self.max_pattern_length, int) or isinstance(self.max_pattern_length, bool) or self.max_pattern_length < 1:
            raise ConfigError(f"max_pattern_length is a positive number, not {self.max_pattern_length!r}", option="max_pattern_length")
        if self.parse_date is not None and not callable(self.parse_date):
            raise ConfigError("parse_date is a function", option="parse_date")
        if not isinstance(self.id, str):
            raise ConfigError("id is text", option="id")
        object.__setattr__(self, "types", tuple(self.types))
        for f in self.formats:
            temporal.layout(f)

    @property
    def formats(self) -> tuple[str, ...]:
        return () if self.date_format is None else (self.date_format,) if isinstance(self.date_format, str) else tuple(self.date_format)


def _known(options: dict) -> dict:
    """Options that there are; unknown names are ignored, and None means that nothing was said."""
    names = {f.name for f in fields(Options)}
    return {k: v for k, v in options.items() if k in names and v is not None}


class Engine:
    """Queries with one set of options and value types. It holds no session: any DataFrame will do."""

    def __init__(self, **options):
        self.options = Options(**_known(options))
        self._registry = self.registry  # a bad type raises here

    def extend(self, **options) -> Engine:
        """An engine with ``options`` over this one's."""
        out = Engine.__new__(Engine)
        out.options = replace(self.options, **_known(options))
        out._registry = out.registry
        return out

    @cached_property
    def registry(self) -> Registry:
        builtin = Registry(builtin_types(self.options.formats, self.options.parse_date))
        made = []
        for t in self.options.types:
            if not isinstance(t, ValueType) and callable(t):
                try:
                    t = t(lambda name: self.registry.get(name))
                except Exception as e:
                    raise ConfigError(f"A function that makes a value type failed: {e}", option="types") from e
            if not isinstance(t, ValueType):
                raise ConfigError(f"Not a value type: {t!r}", option="types")
            made.append(t)
        return builtin.with_types(made, self.options.type_strategy)

    @property
    def types(self) -> list[dict]:
        return self.registry.describe()

    def parse(self, query: str) -> Node:
        return parse(query, self.options.tolerant)

    # Compilation

    def _prepared(self, query: str | Node, schema: T.StructType, options: Options) -> Node:
        if isinstance(query, str):
            query = parse(query, options.tolerant)
        check_tree(query)
        if options.on_recovered == "throw":
            recover.refuse_recovered(query)
        elif options.tolerant or recover.first_recovered(query):
            query = recover.prune(recover.repair(query, lambda n: Compiler(schema, options, self.registry).compile(n)))
        return query

    def _compiled(self, query: str | Node, schema: T.StructType, per_call: dict, highlight: bool = False) -> tuple[Compiled, Options]:
        allowed = ("match_keys", "max_pattern_length", "on_recovered", "on_value_error", "regex_guard")
        options = replace(self.options, **{k: v for k, v in _known(per_call).items() if k in allowed})
        tree = self._prepared(query, schema, options)
        if options.strict_fields:
            _check_fields(tree, schema)
        compiler = Compiler(schema, options, self.registry, options.on_value_error == "throw", highlight)
        compiled = compiler.compile(tree)
        compiled.prepared = compiler.prepared
        return compiled, options

    def column(self, query: str | Node, schema: T.StructType, **per_call) -> Column:
        """The predicate of ``query`` over rows of ``schema``, true or false for every row."""
        compiled, _ = self._compiled(query, schema, per_call)
        return raising(compiled)

    def _checked(self, df: DataFrame, predicate: Column) -> Column:
        """``predicate``, if it is one: a custom type's methods may have made it of something else than booleans."""
        if self.options.types:
            try:
                kind = df.select(predicate).schema[0].dataType
            except AnalysisException as e:
                raise ConfigError(f"A value type's methods don't make a predicate: {e}", option="types") from e
            if not isinstance(kind, T.BooleanType):
                raise ConfigError(f"A value type's method makes {kind.simpleString()} values where booleans are due", option="types")
        return predicate

    # Verbs

    def filter(self, query: str | Node, df: DataFrame, **per_call) -> DataFrame:
        """The rows of ``df`` that match, lazily: a narrow filter, batch or streaming."""
        _check_frame(df)
        compiled, options = self._compiled(query, df.schema, per_call)
        if options.on_value_error == "throw" and compiled.bad:
            return df.filter(self._checked(df, raising(compiled)))
        if compiled.predicate is True:
            return df
        return df.filter(F.lit(False) if compiled.predicate is False else self._checked(df, compiled.predicate))

    def test(self, query: str | Node, df: DataFrame, name: str = "matched", **per_call) -> DataFrame:
        """``df`` with a boolean column: whether each row matches."""
        _check_frame(df)
        compiled, _ = self._compiled(query, df.schema, per_call)
        return df.withColumn(name, self._checked(df, raising(compiled)))

    def highlight(self, query: str | Node, df: DataFrame, name: str = "highlights", **per_call) -> DataFrame:
        """``df`` with an array of what made each row match: paths, and spans in code points where there are some.

        Rows that don't match, and what stands under a negation, have none.
        """
        _check_frame(df)
        compiled, _ = self._compiled(query, df.schema, per_call, True)
        shown = [c for c in df.columns if c != name]
        ready = df.withColumns(compiled.prepared) if compiled.prepared else df
        # Spans are worked out first, in a projection of their own: Python can't run inside a lambda's expression.
        raw = free_name("__hits", ready.columns)
        hits = ready.withColumn(raw, F.when(raising(compiled), compiled.hits).otherwise(F.array().cast(f"array<{HIT}>")))
        found = F.array_distinct(raw)
        located = F.transform(F.filter(found, lambda h: h["ranges"].isNotNull()), lambda h: h["segments"])
        kept = F.filter(found, lambda h: h["ranges"].isNotNull() | ~F.array_contains(located, h["segments"]))
        return hits.select(*(F.col(f"`{c.replace('`', '``')}`") for c in shown), kept.alias(name))


def _check_frame(df: object) -> None:
    if not isinstance(df, DataFrame):
        raise ArgumentError(f"Rows come as a DataFrame, not {type(df).__name__}", argument="df")


def _check_fields(tree: Node, schema: T.StructType) -> None:
    from winnow.plans.tree import Tag, children

    stack, names = [tree], set(schema.names)
    while stack:
        node = stack.pop()
        if isinstance(node, Tag) and node.field.segments[0].name not in names:
            raise ArgumentError(f"No such field: {node.field.segments[0].name}", argument="query")
        stack += children(node)


def value_error(error: BaseException) -> ValueError_ | None:
    """The engine's own error, if a job failed because a row's value was refused."""
    if not isinstance(error, PySparkException) or RAISED not in str(error):
        return None
    told, _ = json.JSONDecoder().raw_decode(str(error).split(RAISED, 1)[1])
    return ValueError_(f'A value of "{told["field"]}" can\'t be read as a {told["type"]}, as its clause ({told["site"]}) needs', **told)


@lru_cache(maxsize=1)
def default_engine() -> Engine:
    return Engine()


def filter(query: str | Node, df: DataFrame, **per_call) -> DataFrame:  # noqa: A001
    return default_engine().filter(query, df, **per_call)


def test(query: str | Node, df: DataFrame, **per_call) -> DataFrame:
    return default_engine().test(query, df, **per_call)


def highlight(query: str | Node, df: DataFrame, **per_call) -> DataFrame:
    return default_engine().highlight(query, df, **per_call)


test.__test__ = False
__all__ = ["Empty", "Engine", "Options", "default_engine", "filter", "highlight", "test", "value_error"]
