"""From a field path, or from a whole schema, to the columns whose values are candidates of a clause.

A candidate is one column, or (``many``) an array of values, of which any may match. Struct fields are found by
their exact names; arrays are opened one level at each step of a path and all the way in a scan. For highlights a
second array says where each value is: steps over null elements and into maps keep the source's indexes and keys.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from winnow.plans.errors import ArgumentError

#: The place of an array's index or a map's key in a candidate's path.
INDEX = object()


def _live(values: Column) -> Column:
    return F.filter(values, lambda x: x.isNotNull())


def _placed(value: Column, at: Column) -> Column:
    return F.struct(value.alias("value"), at.alias("at"))


def _below(at: Column, step: Column) -> Column:
    return F.concat(at, F.array(step.cast("string")))


@dataclass(frozen=True)
class Candidate:
    #: None of the root, which is no value.
    column: Column | None
    kind: T.DataType
    path: tuple = ()
    many: bool = False
    #: Conditions under which there is a candidate at all; they matter only to what a null satisfies.
    guard: Column | None = None
    root: bool = False
    #: Of many, in the order of ``column``: (value, at), where ``at`` is the value's path.
    located: Column | None = None

    def _under(self, condition: Column | None) -> Column | None:
        return self.guard if condition is None else condition if self.guard is None else self.guard & condition

    def _own(self) -> Column:
        """The path of a single candidate."""
        return F.array(*map(F.lit, self.path)).cast("array<string>")

    def _step(self, name: str, kind: T.DataType, change: Callable[[Column], Column], holds: Callable[[Column], Column] = Column.isNotNull) -> Candidate:
        """Of many: the same step from each value for which ``holds``."""
        held = F.filter(self.located, lambda p: holds(p["value"]))
        return replace(
            self, column=F.transform(F.filter(self.column, holds), change), kind=kind, path=(*self.path, name),
            located=F.transform(held, lambda p: _placed(change(p["value"]), _below(p["at"], F.lit(name)))),
        )

    def _opened(self, kind: T.DataType, values: Callable[[Column], Column], places: Callable[[Column, Column], Column]) -> Candidate:
        """All values of this candidate, or of each of many; ``places`` gives (value, at) of those of one at a path."""
        if not self.many:
            return Candidate(values(self.column), kind, (*self.path, INDEX), True, self.guard, located=places(self.column, self._own()))
        held = F.filter(self.located, lambda p: p["value"].isNotNull())
        return replace(self, column=F.flatten(F.transform(_live(self.column), values)), kind=kind, located=F.flatten(F.transform(held, lambda p: places(p["value"], p["at"]))))

    def field(self, name: str, kind: T.DataType) -> Candidate:
        if self.root:
            return Candidate(F.col(f"`{name.replace('`', '``')}`"), kind, (name,))
        if self.many:
            return self._step(name, kind, lambda x: x.getField(name))
        return Candidate(self.column.getField(name), kind, (*self.path, name), False, self._under(self.column.isNotNull()))

    def key(self, name: str, kind: T.DataType) -> Candidate:
        if self.many:
            return self._step(name, kind, lambda x: F.try_element_at(x, F.lit(name)))
        return Candidate(F.try_element_at(self.column, F.lit(name)), kind, (*self.path, name), False, self._under(self.column.isNotNull()))

    def absent(self, name: str) -> Candidate:
        """A key that a live object doesn't have."""
        if self.many:
            return self._step(name, T.NullType(), lambda x: F.lit(None))
        return Candidate(F.lit(None), T.NullType(), (*self.path, name), False, None if self.root else self._under(self.column.isNotNull()))

    def at(self, i: int) -> Candidate:
        kind = self.kind.elementType
        if self.many:
            return self._step(str(i), kind, lambda x: F.get(x, F.lit(i)), lambda x: F.size(x) > i)
        return Candidate(F.get(self.column, F.lit(i)), kind, (*self.path, str(i)), False, self._under(F.coalesce(F.size(self.column) > i, F.lit(False))))

    def opened(self) -> Candidate:
        """The elements of an array (or of each of many arrays)."""
        return self._opened(self.kind.elementType, lambda x: x, lambda x, at: F.transform(x, lambda v, i: _placed(v, _below(at, i))))

    def values(self) -> Candidate:
        """The values of a map."""
        return self._opened(self.kind.valueType, F.map_values, lambda x, at: F.transform(F.map_entries(x), lambda e: _placed(e["value"], _below(at, e["key"]))))

    def keys(self) -> Candidate:
        """The keys of a map, each at its own place."""
        return self._opened(T.StringType(), F.map_keys, lambda x, at: F.transform(F.map_keys(x), lambda k: _placed(k, _below(at, k))))

    def named(self, name: str) -> Candidate:
        """The name of a struct's field, where there is a struct."""
        if self.many:
            return self._step(name, T.StringType(), lambda x: F.lit(name))
        return Candidate(F.lit(name), T.StringType(), (*self.path, name), False, None if self.root else self.column.isNotNull())


def _readable(kind: T.DataType, path: tuple) -> None:
    while isinstance(kind, T.ArrayType):
        kind = kind.elementType
    if isinstance(kind, T.VariantType):
        raise ArgumentError(f"Variant columns can't be searched; cast {'.'.join('[]' if p is INDEX else p for p in path)} to a struct, a map or text first", argument="df")


def at_path(schema: T.StructType, path: tuple[str, ...]) -> Candidate | None:
    """The candidate that ``path`` names, an array unopened; None if no row can have one."""
    here = Candidate(None, schema, root=True)
    for name in path:
        _readable(here.kind, here.path)
        index = int(name) if name.isascii() and name.isdigit() and str(int(name)) == name else None
        if isinstance(here.kind, T.ArrayType):
            if index is not None:
                here = here.at(index)
                continue
            here = here.opened()
        if isinstance(here.kind, T.StructType):
            kind = next((f.dataType for f in here.kind.fields if f.name == name), None)
            here = here.absent(name) if kind is None else here.field(name, kind)
        elif isinstance(here.kind, T.MapType) and isinstance(here.kind.keyType, T.StringType):
            here = here.key(name, here.kind.valueType)
        else:
            return None
    _readable(here.kind, here.path)
    return here


def leaves(schema: T.StructType, nulls: bool, keys: bool) -> Iterator[Candidate]:
    """All leaf candidates of a row, in the schema's order. ``nulls``: null objects and arrays too; ``keys``: object keys."""

    def below(c: Candidate) -> Iterator[Candidate]:
        if isinstance(c.kind, T.StructType):
            if nulls and not c.root:
                yield c
            for f in c.kind.fields:
                if keys:
                    yield c.named(f.name)
                yield from below(c.field(f.name, f.dataType))
        elif isinstance(c.kind, T.ArrayType):
            if nulls:
                yield c
            yield from below(c.opened())
        elif isinstance(c.kind, T.MapType):
            if nulls:
                yield c
            if keys and isinstance(c.kind.keyType, T.StringType):
                yield c.keys()
            yield from below(c.values())
        else:
            _readable(c.kind, c.path)
            yield c

    yield from below(Candidate(None, schema, root=True))
