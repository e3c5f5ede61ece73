"""Dates and times: from text on the driver, and from columns as expressions.

An instant is a number of milliseconds since 1970 in UTC (text without an offset is UTC); a time of day is a number
of milliseconds since midnight and a domain of its own.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from datetime import UTC, date, datetime, timedelta
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from winnow.plans.errors import DateFormatError

#: The shapes of ISO dates and times.
_DATE = r"(\d{4})([-/])(0[1-9]|1[0-2])\2(0[1-9]|[12]\d|3[01])"
_TIME = r"([01]\d|2[0-3]):([0-5]\d)(?::([0-5]\d)(?:[.,](\d+))?)?"
_OFFSET = r"([Zz]|[+-](?:[01]\d|2[0-3])(?::?[0-5]\d)?)?"
_DATE_TIME = f"{_DATE}[Tt ]{_TIME}{_OFFSET}"
_shapes = {name: re.compile(p, re.ASCII) for name, p in (("date", _DATE), ("datetime", _DATE_TIME), ("time", _TIME))}


def whole(pattern: str) -> str:
    """``pattern`` for columns, over all of a text. (Java's ``$`` would let a line feed follow.)"""
    return rf"^(?:{pattern})\z"


ISO_DATE, ISO_TIME, ISO_DATE_TIME = map(whole, (_DATE, _TIME, _DATE_TIME))
#: The tokens of layouts.
TOKENS = {"YYYY": r"(\d{4})", "SSS": r"(\d{3})", "MM": r"(\d{2})", "DD": r"(\d{2})", "HH": r"(\d{2})", "mm": r"(\d{2})", "ss": r"(\d{2})"}
#: The widest instant that the language's dates hold.
MAX_INSTANT = 8_640_000_000_000_000
_EPOCH = datetime(1970, 1, 1, tzinfo=UTC)


@dataclass(frozen=True)
class Temporal:
    domain: str  # instant or time
    millis: int
    kind: str = "datetime"

    def moment(self) -> datetime | None:
        """The instant as a datetime, or None where Python's years don't reach."""
        try:
            return _EPOCH + timedelta(milliseconds=self.millis)
        except OverflowError:
            return None


def _days(year: int, month: int, day: int) -> int | None:
    """Days since 1970 of a proleptic Gregorian date, year 0 included; None if there is no such day."""
    try:  # the calendar repeats every 400 years
        shift = 400 if year < 1 else 0
        return (date(year + shift, month, day) - date(1970, 1, 1)).days - (146_097 if shift else 0)
    except ValueError:
        return None


def _clock(hour: str | None, minute: str | None, second: str | None, fraction: str | None) -> int:
    return ((int(hour or 0) * 60 + int(minute or 0)) * 60 + int(second or 0)) * 1000 + int((fraction or "")[:3].ljust(3, "0"))


def _offset(text: str | None) -> int:
    if not text or text in "Zz":
        return 0
    digits = text[1:].replace(":", "").ljust(4, "0")
    return (1 if text[0] == "+" else -1) * (int(digits[:2]) * 60 + int(digits[2:])) * 60_000


def detect_format(text: str) -> str | None:
    """Which ISO shape ``text`` has (date, datetime, time), whether or not it names a real day."""
    return next((name for name, p in _shapes.items() if p.fullmatch(text)), None)


def parse_iso(text: str) -> Temporal | None:
    shape = detect_format(text)
    if shape is None:
        return None
    g = _shapes[shape].fullmatch(text).groups()
    if shape == "time":
        return Temporal("time", _clock(*g), "time")
    days = _days(int(g[0]), int(g[2]), int(g[3]))
    if days is None:
        return None
    clock = _clock(*g[4:8]) - _offset(g[8]) if shape == "datetime" else 0
    return Temporal("instant", days * 86_400_000 + clock, shape)


@dataclass(frozen=True)
class Layout:
    """A declared date format such as ``DD-MM-YYYY``; everything but its tokens is literal."""

    text: str
    pattern: str
    tokens: tuple[str, ...]

    @property
    def kind(self) -> str:
        return "time" if "DD" not in self.tokens else "datetime" if "HH" in self.tokens and "mm" in self.tokens else "date"

    @property
    def digits(self) -> int | None:
        """The width of a layout that is digits alone."""
        return len(self.text) if sum(map(len, self.tokens)) == len(self.text) else None

    def read(self, text: str) -> Temporal | bool | None:
        """What ``text`` says; None if it hasn't this layout, False if it names no real day or time."""
        m = re.fullmatch(self.pattern, text, re.ASCII)
        if not m:
            return None
        part = dict(zip(self.tokens, m.groups(), strict=True))
        clock = [part.get(t) for t in ("HH", "mm", "ss", "SSS")]
        if any(int(v or 0) > top for v, top in zip(clock, (23, 59, 59, 999), strict=True)):
            return False
        if self.kind == "time":
            return Temporal("time", _clock(*clock), "time")
        days = _days(int(part["YYYY"]), int(part["MM"]), int(part["DD"]))
        return False if days is None else Temporal("instant", days * 86_400_000 + _clock(*clock), self.kind)


@lru_cache(maxsize=256)
def layout(text: str) -> Layout:
    tokens, pattern = [], ""
    for m in re.finditer("(" + "|".join(TOKENS) + ")|(.)", text, re.DOTALL):
        if m[1] in tokens and m[1]:
            raise DateFormatError(f'The date format "{text}" has {m[1]} twice')
        if m[1]:
            tokens.append(m[1])
        pattern += TOKENS[m[1]] if m[1] else re.escape(m[2])
    days = {"YYYY", "MM", "DD"} & set(tokens)
    if days and len(days) < 3:
        raise DateFormatError(f'The date format "{text}" names a day by some of YYYY, MM and DD, and needs all three')
    if not days and not {"HH", "mm"} <= set(tokens):
        raise DateFormatError(f'The date format "{text}" names neither a day (YYYY, MM, DD) nor a time (HH, mm)')
    return Layout(text, pattern, tuple(tokens))


def from_hook(found: object) -> Temporal | None:
    """What a date hook returned: a datetime or date, milliseconds, a Temporal, or None to defer."""
    match found:
        case None:
            return None
        case Temporal():
            return found
        case datetime():
            moment = found if found.tzinfo else found.replace(tzinfo=UTC)
            return Temporal("instant", (moment - _EPOCH) // timedelta(milliseconds=1))
        case date():
            return Temporal("instant", (found - date(1970, 1, 1)).days * 86_400_000, "date")
        case bool():
            return None
        case int() | float() if abs(found) <= MAX_INSTANT:
            return Temporal("instant", int(found))
    return None


def resolve(text: str, formats: tuple[str, ...] = (), hook: Callable | None = None) -> Temporal | None:
    """The hook is asked first, then the layouts in order, then ISO. A text that has a layout but names no real day is none."""
    if hook and (found := from_hook(hook(text))):
        return found
    read = [layout(f).read(text) for f in formats]
    for r in read:
        if isinstance(r, Temporal):
            return r
    return None if False in read else parse_iso(text)


# Column expressions


def _part(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(text, pattern, group)


def _whole(text: Column) -> Column:
    return F.coalesce(text.try_cast("int"), F.lit(0))


def _fraction(text: Column) -> Column:
    return _whole(F.rpad(F.substring(text, 1, 3), 3, "0"))


def _clock_column(hour: Column, minute: Column, second: Column, fraction: Column) -> Column:
    return ((hour * 60 + minute) * 60 + second).cast("long") * 1000 + fraction


def _instant_column(year: Column, month: Column, day: Column, clock: Column) -> Column:
    return F.unix_millis(F.try_make_timestamp(year, month, day, F.lit(0), F.lit(0), F.lit(0), F.lit("UTC"))) + clock


def iso_column(text: Column, domain: str) -> Column:
    """Milliseconds of ISO text in ``domain``; null for any other text."""
    if domain == "time":
        parts = [_part(text, ISO_TIME, i) for i in range(1, 5)]
        return F.when(text.rlike(ISO_TIME), _clock_column(*map(_whole, parts[:3]), _fraction(parts[3])))
    day = lambda p: [_whole(_part(text, p, i)) for i in (1, 3, 4)]
    p = ISO_DATE_TIME
    offset = _part(text, p, 9)
    digits = F.rpad(F.regexp_replace(F.substring(offset, 2, 5), ":", ""), 4, "0")
    minutes = _whole(F.substring(digits, 1, 2)) * 60 + _whole(F.substring(digits, 3, 2))
    shift = F.when(offset.isin("", "Z", "z"), 0).otherwise(F.when(offset.startswith("+"), minutes).otherwise(-minutes) * 60_000)
    clock = _clock_column(*(_whole(_part(text, p, i)) for i in (5, 6, 7)), _fraction(_part(text, p, 8))) - shift
    return F.when(text.rlike(ISO_DATE), _instant_column(*day(ISO_DATE), F.lit(0))).when(text.rlike(p), _instant_column(*day(p), clock))


def text_column(text: Column, domain: str, formats: tuple[str, ...] = (), hook: Callable | None = None) -> Column:
    """Milliseconds in ``domain`` of a text column, by the same chain as :func:`resolve`."""
    read, has = [], []
    for f in map(layout, formats):
        pattern = whole(f.pattern)
        part = {t: _whole(_part(text, pattern, i + 1)) for i, t in enumerate(f.tokens)}
        hour, minute, second, fraction = (part.get(t, F.lit(0)) for t in ("HH", "mm", "ss", "SSS"))
        real = text.rlike(pattern) & (hour <= 23) & (minute <= 59) & (second <= 59)
        clock = _clock_column(hour, minute, second, fraction)
        value = clock if f.kind == "time" else _instant_column(part["YYYY"], part["MM"], part["DD"], clock)
        has.append(text.rlike(pattern))
        read.append((f.kind == "time", F.when(real, value)))
    # The first layout that reads the text decides, in whatever domain it is.
    decided = F.coalesce(*(v for _, v in read)) if read else F.lit(None).cast("long")
    own = F.lit(None).cast("long")
    for is_time, v in reversed(read):
        own = F.when(v.isNotNull(), v if is_time == (domain == "time") else F.lit(None).cast("long")).otherwise(own)
    shaped = F.lit(False)
    for h in has:
        shaped = shaped | h
    out = F.when(decided.isNotNull(), own).when(~shaped, iso_column(text, domain)) if read else iso_column(text, domain)
    if hook:
        asked = _hook_column(hook)(text)
        out = F.when(asked["domain"].isNotNull(), F.when(asked["domain"] == domain, asked["millis"])).otherwise(out)
    return out


def _hook_column(hook: Callable):
    @F.pandas_udf("domain string, millis long")
    def ask(texts: pd.Series) -> pd.DataFrame:
        found = [from_hook(hook(t)) if t is not None else None for t in texts]
        return pd.DataFrame({"domain": pd.Series([f and f.domain for f in found], dtype=object), "millis": pd.Series([f.millis if f else None for f in found], dtype="Int64")})

    return ask
