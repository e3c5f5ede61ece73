"""From a tree and a schema to Columns: the predicate, the values that a strict policy refuses, and the highlights.

Every operand is resolved before any row is read, so a wrong query raises on the driver. Clauses over columns that
can't hold the operand's type are false at plan time. Predicates are left null where a value is null, which a filter
treats as false and which keeps bare columns pushable; only a negation closes them to two values.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from winnow.plans import types as V
from winnow.plans.errors import OperandError
from winnow.plans.limits import deep_recursion
from winnow.plans.paths import Candidate, at_path, leaves
from winnow.plans.tree import Empty, Field, Group, Literal, Logical, Missing, Node, Range, Regex, Tag, Unary, Wildcard, field_path, operands

HIT = "struct<path:string,segments:array<string>,ranges:array<struct<start:int,end:int>>>"
#: Marks the message of an error that a row raises.
RAISED = "winnow.value:"


@dataclass
class Compiled:
    predicate: Column | bool
    #: Conditions under which a row has a value that the strict policy refuses, each with what to tell of it.
    bad: list[tuple[Column, dict]] = field(default_factory=list)
    hits: Column | None = None
    #: (key, folded column, value) of an equality that a run of ORs may gather.
    equality: tuple[str, Column, str] | None = None
    #: Columns to add before ``hits`` is projected.
    prepared: dict[str, Column] = field(default_factory=dict)


def closed(predicate: Column | bool) -> Column:
    """A predicate of two values."""
    return F.lit(predicate) if isinstance(predicate, bool) else F.coalesce(predicate, F.lit(False))


def _balanced(parts: list[Column], join: Callable[[Column, Column], Column]) -> Column:
    """A tree of depth log n, whatever the length of the query's spine."""
    while len(parts) > 1:
        parts = [join(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


def _all(parts: list[Column | bool]) -> Column | bool:
    if any(p is False for p in parts):
        return False
    live = [p for p in parts if p is not True]
    return _balanced(live, lambda a, b: a & b) if live else True


def _any(parts: list[Column | bool]) -> Column | bool:
    if any(p is True for p in parts):
        return True
    live = [p for p in parts if p is not False]
    return _balanced(live, lambda a, b: a | b) if live else False


def _exists(c: Candidate, test: Callable[[Column, T.DataType], Column]) -> Column:
    return F.exists(c.column, lambda x: test(x, c.kind))


def _no_hits() -> Column:
    return F.array().cast(f"array<{HIT}>")


def _whole(text: Column, context: V.Context) -> Column:
    """One span over all of a text; none where folding it changes its length, since places in it mean nothing then."""
    span = F.array(F.struct(F.lit(0).alias("start"), F.length(text).alias("end")))
    return span if context.case_sensitive else F.when(F.length(F.lower(text)) == F.length(text), span)


def free_name(name: str, taken: list[str]) -> str:
    """``name``, or one like it that no column has."""
    used = {t.lower() for t in taken}
    while name.lower() in used:
        name += "_"
    return name


def _source(node: Node) -> str:
    match node:
        case Literal():
            return str(node.value) if node.kind == "text" else json.dumps(node.value)
        case Wildcard():
            return "".join(p if isinstance(p, str) else p.value for p in node.pattern)
        case Regex():
            return f"/{node.pattern}/{node.flags}"
    return node.TYPE


class Compiler:
    def __init__(self, schema: T.StructType, options, registry: V.Registry, strict: bool = False, highlight: bool = False):
        self.schema, self.options, self.registry, self.strict, self.highlight = schema, options, registry, strict, highlight
        self.settings = V.Settings(options.match_keys, options.regex_guard, options.max_pattern_length)
        #: Columns that highlights refer to by name: Python functions can't stand inside a lambda.
        self.prepared: dict[str, Column] = {}
        self._at: dict[tuple[str, ...], Candidate | None] = {}

    def at(self, field: Field) -> Candidate | None:
        """The candidate of a path, made once: each call of a Spark function costs a call of the JVM."""
        path = field_path(field)
        if path not in self._at:
            self._at[path] = at_path(self.schema, path)
        return self._at[path]

    def compile(self, tree: Node) -> Compiled:
        with deep_recursion():
            return self.node(tree, None, False)

    def node(self, node: Node, field: Field | None, exact: bool) -> Compiled:
        match node:
            case Empty():
                return Compiled(True, hits=self.none())
            case Missing():
                return Compiled(False, hits=self.none())
            case Group(expression=inner):
                return self.node(inner, field, exact)
            case Unary(operand=inner):
                found = self.node(inner, field, exact)
                negated = not found.predicate if isinstance(found.predicate, bool) else ~closed(found.predicate)
                return Compiled(negated, found.bad, self.none())
            case Logical():
                return self.logical(node, field, exact)
            case Tag(expression=inner):
                return self.node(inner, node.field, node.case_sensitive) if isinstance(inner, Group) else self.clause(inner, node.field, node.operator, node.case_sensitive)
        return self.clause(node, field, ":", exact)

    def none(self) -> Column | None:
        return _no_hits() if self.highlight else None

    def logical(self, node: Logical, field: Field | None, exact: bool) -> Compiled:
        parts = [self.node(n, field, exact) for n in operands(node)]
        bad = [b for p in parts for b in p.bad]
        if node.operator == "AND":
            predicate = _all([p.predicate for p in parts])
            hits = F.when(closed(predicate), F.concat(*[p.hits for p in parts])).otherwise(_no_hits()) if self.highlight else None
            return Compiled(predicate, bad, hits)
        hits = F.concat(*[F.when(closed(p.predicate), p.hits).otherwise(_no_hits()) for p in parts]) if self.highlight else None
        gathered: dict[str, list[tuple[Column, str]]] = {}
        rest: list[Column | bool] = []
        for p in parts:
            if p.equality:
                gathered.setdefault(p.equality[0], []).append(p.equality[1:])
            else:
                rest.append(p.predicate)
        same = [c[0][0].isin(*dict.fromkeys(v for _, v in c)) if len(c) > 1 else c[0][0] == c[0][1] for c in gathered.values()]
        return Compiled(_any([*same, *rest]), bad, hits)

    def candidates(self, field: Field | None, on_null: bool) -> list[Candidate]:
        if field is None:
            return list(leaves(self.schema, on_null, self.options.match_keys))
        found = self.at(field)
        if found is None:
            return []
        if not isinstance(found.kind, T.ArrayType):
            return [found]
        if not on_null:
            return [found.opened()]
        # A null array is a null candidate; an empty one has no candidates.
        whole = found.column if found.many else F.when(found.column.isNotNull(), F.lit(True))
        return [replace(found, kind=T.NullType(), column=whole), found.opened()]

    def clause(self, node: Node, field: Field | None, operator: str, exact: bool) -> Compiled:
        if isinstance(node, Missing):
            return Compiled(False, hits=self.none())
        if isinstance(node, Range):
            return self.range(node, field, exact)
        site = "scan" if field is None else {":": "match", ":=": "equality"}.get(operator, "ordered")
        context = V.Context(site, exact and field is not None, self.settings, self.registry.get)
        kind, operand = self.registry.resolve(node, context, _source(node))
        on_null = kind.name == "null"

        def test(column: Column, column_type: T.DataType) -> Column | None:
            reading = kind.read(column, column_type, operand, context)
            return None if reading is None else V.test(kind, reading, column_type, operator, operand, context)

        def many(values: Column) -> Column | None:
            return kind.exists(values, operand, context)

        out = self.over(field, test, many, on_null, lambda c: self.hit(c, kind, operand, context))
        if kind.name == "string" and field is not None and not self.highlight:
            found = self.at(field)
            if found is not None and isinstance(found.kind, T.StringType) and not found.many:
                key = f"{'=' if context.case_sensitive else '~'}{found.path}"
                out.equality = (key, found.column if context.case_sensitive else F.lower(found.column), operand if context.case_sensitive else operand.lower())
        if self.strict and site != "scan":
            out.bad = self.refused(field, kind, operand, context)
        return out

    def over(self, field, test, many, on_null, hit) -> Compiled:
        """The predicate (and highlights) of any candidate's passing the test."""
        tests, hits = [], []
        for c in self.candidates(field, on_null):
            if c.many:
                if test(F.lit(None).cast(c.kind), c.kind) is None:
                    continue
                whole = many(c.column) if isinstance(c.kind, T.StringType) else None
                passed = _exists(c, test) if whole is None else whole
            else:
                passed = test(c.column, c.kind)
                if passed is None:
                    continue
                if on_null and c.guard is not None:
                    passed = c.guard & passed
            if c.guard is not None and c.path and not on_null and isinstance(c.kind, T.StringType) and field is None and self.options.match_keys:
                passed = c.guard & passed
            tests.append(passed)
            if self.highlight:
                hits.append(F.when(closed(passed), hit((c, test))).otherwise(_no_hits()))
        return Compiled(_any(tests), hits=(F.concat(*hits) if hits else _no_hits()) if self.highlight else None)

    def hit(self, found, kind: V.ValueType, operand: object, context: V.Context) -> Column:
        """The highlights of a candidate that passed: its path, and the spans in it where the type has some."""
        from winnow.functions.spans import all_spans

        c, test = found
        try:
            how = kind.spans(operand, context) if isinstance(c.kind, T.StringType) else None
        except Exception:  # noqa: BLE001 - a custom type's method; the match itself stands
            how = None
        if not c.many:
            ranges = _whole(c.column, context) if how == "whole" else all_spans(c.column, how, False) if how else F.lit(None)
            return F.array(F.struct(F.lit(".".join(c.path)).alias("path"), F.array(*map(F.lit, c.path)).alias("segments"), ranges.alias("ranges")).cast(HIT))
        spans = self.prepare(all_spans(c.column, how, True)) if callable(how) else None
        tested = isinstance(c.kind, T.StringType) and kind.exists(F.array(), operand, context) is not None
        passes = self.prepare(all_spans(c.column, None, True, kind, operand, context)) if tested else None

        def one(p: Column, i: Column) -> Column:
            ranges = F.get(spans, i) if spans is not None else _whole(p["value"], context) if how == "whole" else F.lit(None)
            here = F.struct(F.array_join(p["at"], ".").alias("path"), p["at"].alias("segments"), ranges.alias("ranges")).cast(HIT)
            passed = F.get(passes, i) if passes is not None else closed(test(p["value"], c.kind))
            return F.when(passed, here)

        return F.filter(F.transform(c.located, one), lambda h: h.isNotNull())

    def prepare(self, column: Column) -> Column:
        name = free_name(f"__winnow_{len(self.prepared)}", self.schema.names)
        self.prepared[name] = column
        return F.col(name)

    def refused(self, field: Field, kind: V.ValueType, operand: object, context: V.Context) -> list[tuple[Column, dict]]:
        """When any candidate of the path is one that the policy refuses at this site."""
        of = V.VALUE_FAILURE_POLICY[context.site]

        def bad(column: Column, column_type: T.DataType) -> Column | None:
            reading = kind.read(column, column_type, operand, context)
            miss = of["miss"] == "value-error"
            if reading is None:
                return F.lit(True) if miss else None
            invalid = reading.invalid() if callable(reading.invalid) else reading.invalid
            invalid = F.lit(False) if invalid is None else F.coalesce(invalid, F.lit(False))
            return invalid | reading.value.isNull() if miss else invalid

        told = {"code": "VALUE", "field": ".".join(field_path(field)), "type": kind.name, "site": context.site}
        return [(test, told) for test in self.over_bad(field, bad)]

    def over_bad(self, field: Field, bad) -> list[Column]:
        tests = []
        for c in self.candidates(field, True):
            if bad(F.lit(None).cast(c.kind) if c.many else c.column, c.kind) is None:
                continue
            failed = _exists(c, bad) if c.many else bad(c.column, c.kind)
            tests.append(F.coalesce(failed if c.guard is None else c.guard & failed, F.lit(False)))
        return tests

    def range(self, node: Range, field: Field | None, exact: bool) -> Compiled:
        if field is None:
            return Compiled(False, hits=self.none())
        context = V.Context("range", exact, self.settings, self.registry.get)
        sides = [(b, *self.registry.resolve(b.value, context, _source(b.value))) if b.value is not None else None for b in (node.lower, node.upper)]
        bare = lambda c: self.hit(c, V.ValueType(), None, context)
        if sides == [None, None]:
            return self.over(field, lambda column, kind: None if isinstance(kind, T.NullType) else column.isNotNull(), lambda values: None, False, bare)
        kind, operand = next(s for s in sides if s)[1:]
        if all(sides):
            (_, low, a), (_, high, b) = sides
            if low.name != high.name:
                raise OperandError(f'One bound of this range is a "{low.name}" and the other a "{high.name}"', "MIXED_RANGE_TYPES", span=node.location)
            if not low.comparable(a, b):
                raise OperandError("The two bounds of this range have no common order", "MIXED_RANGE_TYPES", span=node.location)

        def test(column: Column, column_type: T.DataType) -> Column | None:
            reading = kind.read(column, column_type, operand, context)
            if reading is None:
                return None
            signs = ((">", ">="), ("<", "<="))
            each = [V.test(kind, reading, column_type, ":" + sign[s[0].inclusive], s[2], context, all(sides)) for s, sign in zip(sides, signs, strict=True) if s]
            return each[0] & each[1] if len(each) > 1 else each[0]

        out = self.over(field, test, lambda values: None, False, bare)
        if self.strict:
            out.bad = self.refused(field, kind, operand, context)
        return out


def raising(compiled: Compiled) -> Column:
    """The predicate of two values, or an error on any row with a refused value, whatever else holds for the row."""
    if not compiled.bad:
        return closed(compiled.predicate)
    out = F
    for test, told in compiled.bad:
        out = out.when(test, F.raise_error(F.lit(RAISED + json.dumps(told))).cast("boolean"))
    return out.otherwise(closed(compiled.predicate))
