"""Regular expressions of the query language: parsed by its rules, refused where they say so, emitted for RE2.

The dialect is that of JavaScript without what can't run in linear time. Classes, anchors and case folding are
written out explicitly, so nothing depends on the other engine's own ideas of them.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import lru_cache

from winnow.plans.errors import OperandError

#: Limits of the dialect.
MAX_REPEAT, MAX_SIZE, MAX_CLASS_RANGES = 1000, 4000, 512
MAX_POINT = 0x10FFFF
_DIGIT = [(48, 57)]
_WORD = [(48, 57), (65, 90), (95, 95), (97, 122)]
#: White space and line ends of the dialect.
_SPACE = [(9, 13), (32, 32), (160, 160), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000), (0xFEFF, 0xFEFF)]
_LINE_ENDS = [(10, 10), (13, 13), (0x2028, 0x2029)]
_CONTROLS = {"f": 12, "n": 10, "r": 13, "t": 9, "v": 11}
Ranges = list[tuple[int, int]]


def _merged(ranges: Ranges) -> Ranges:
    out: Ranges = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _negated(ranges: Ranges) -> Ranges:
    out, at = [], 0
    for a, b in _merged(ranges):
        if a > at:
            out.append((at, a - 1))
        at = b + 1
    return [*out, (at, MAX_POINT)] if at <= MAX_POINT else out


@lru_cache(maxsize=1)
def _orbits() -> dict[int, tuple[int, ...]]:
    """Characters that fold together: equal upper case of one unit, and ASCII only with ASCII."""
    by: dict[int, list[int]] = {}
    for c in range(0x10000):
        up = chr(c).upper() if not 0xD800 <= c <= 0xDFFF else chr(c)
        key = ord(up) if len(up) == 1 and ord(up) < 0x10000 and not (c >= 128 > ord(up)) else c
        by.setdefault(key, []).append(c)
    return {c: tuple(group) for group in by.values() if len(group) > 1 for c in group}


def _folded(ranges: Ranges) -> Ranges:
    orbits = _orbits()
    more = [(x, x) for a, b in ranges for c in (range(a, b + 1) if b - a < len(orbits) else [c for c in orbits if a <= c <= b]) for x in orbits.get(c, ())]
    return _merged(ranges + more)


@dataclass
class Item:
    """kind: set (ranges), seq, alt, repeat (low, high), or an anchor: begin, end, edge, inside."""

    kind: str
    ranges: Ranges = field(default_factory=list)
    items: list[Item] = field(default_factory=list)
    low: int = 0
    high: int | None = None
    lazy: bool = False

    def nullable(self) -> bool:
        match self.kind:
            case "set":
                return False
            case "seq":
                return all(i.nullable() for i in self.items)
            case "alt":
                return any(i.nullable() for i in self.items)
            case "repeat":
                return self.low == 0 or self.items[0].nullable()
        return True

    def size(self) -> int:
        match self.kind:
            case "seq":
                return sum(i.size() for i in self.items)
            case "alt":
                return sum(i.size() + 2 for i in self.items)
            case "repeat":
                return self.items[0].size() * (self.high or self.low + 1) + 2
        return 1


def _refuse(why: str):
    raise OperandError(f"Regular expression refused: {why}", "UNSAFE_PATTERN")


class _Reader:
    def __init__(self, source: str, flags: str):
        self.s, self.at, self.flags = source, 0, flags

    def peek(self, n: int = 1) -> str:
        return self.s[self.at : self.at + n]

    def alternatives(self) -> Item:
        branches = [self.sequence()]
        while self.peek() == "|":
            self.at += 1
            branches.append(self.sequence())
        return branches[0] if len(branches) == 1 else Item("alt", items=branches)

    def sequence(self) -> Item:
        items = []
        while self.at < len(self.s) and self.peek() not in "|)":
            items.append(self.quantified())
        return Item("seq", items=items)

    def braces(self) -> tuple[int, int | None, int] | None:
        """{n}, {n,} or {n,m} at this place, with its end; anything else is literal text."""
        end = self.s.find("}", self.at)
        low, comma, high = self.s[self.at + 1 : end].partition(",") if end > 0 else ("", "", "")
        if not (low.isascii() and low.isdigit() and (not high or high.isascii() and high.isdigit())):
            return None
        return int(low), (int(high) if high else None) if comma else int(low), end + 1

    def quantified(self) -> Item:
        c = self.peek()
        if c in "*+?" or c == "{" and self.braces():
            _refuse("a quantifier follows nothing")
        body = self.atom()
        c, most = self.peek(), None
        if c and c in "*+?":
            low, most, end = {"*": (0, None), "+": (1, None), "?": (0, 1)}[c] + (self.at + 1,)
        elif c == "{" and (found := self.braces()):
            low, most, end = found
        else:
            return body
        if low > MAX_REPEAT or (most or 0) > MAX_REPEAT:
            _refuse(f"a repeat of more than {MAX_REPEAT}")
        if most is not None and most < low:
            _refuse("a repeat's bounds are reversed")
        if body.kind in ("begin", "end", "edge", "inside"):
            _refuse("a quantified assertion")
        if body.nullable():
            _refuse("a quantifier over a body that can be empty")
        self.at = end
        lazy = self.peek() == "?"
        self.at += lazy
        if self.peek() and (self.peek() in "*+?" or self.peek() == "{" and self.braces()):
            _refuse("a quantifier over a quantifier")
        return Item("repeat", items=[body], low=low, high=most, lazy=lazy)

    def chars(self, ranges: Ranges, negate: bool = False) -> Item:
        found = _merged(_folded(ranges) if "i" in self.flags else ranges)
        if len(found) > MAX_CLASS_RANGES:
            _refuse(f"a class of more than {MAX_CLASS_RANGES} ranges")
        return Item("set", _negated(found) if negate else found)

    def atom(self) -> Item:
        c = self.peek()
        self.at += 1
        match c:
            case "(":
                return self.group()
            case "[":
                return self.char_class()
            case ".":
                return Item("set", [(0, MAX_POINT)] if "s" in self.flags else _negated(_LINE_ENDS))
            case "^":
                return Item("begin")
            case "$":
                return Item("end")
            case "\\":
                return self.escape()
        return self.chars([(ord(c), ord(c))])

    def group(self) -> Item:
        if self.peek(2) == "?:":
            self.at += 2
        elif self.peek(3) in ("?<=", "?<!") or self.peek(2) in ("?=", "?!"):
            _refuse("lookaround")
        elif self.peek(2) == "?<":
            end = self.s.find(">", self.at)
            if end < self.at + 3:
                _refuse("a group without a name")
            self.at = end + 1
        elif self.peek() == "?":
            _refuse("an unknown kind of group")
        inner = self.alternatives()
        if self.peek() != ")":
            _refuse("an unclosed group")
        self.at += 1
        return inner

    def hexadecimal(self, n: int) -> int:
        digits = self.peek(n)
        if len(digits) < n or not all(d in "0123456789abcdefABCDEF" for d in digits):
            _refuse("an escape without its hexadecimal digits")
        self.at += n
        return int(digits, 16)

    def octal(self) -> int:
        n = 0
        for _ in range(3):
            if self.peek() and self.peek() in "01234567" and n * 8 + int(self.peek()) <= 0o377:
                n, self.at = n * 8 + int(self.peek()), self.at + 1
            else:
                break
        return n

    def escape(self) -> Item:
        c = self.peek()
        if c in ("b", "B"):
            self.at += 1
            return Item("edge" if c == "b" else "inside")
        if c and c in "123456789":
            _refuse("a back-reference")
        if c == "k" and self.peek(2) == "k<":
            _refuse("a back-reference")
        found = self.class_escape(False)
        if isinstance(found, list):
            return self.chars(found) if c in "dws" else Item("set", found)
        return self.chars([(found, found)])

    def class_escape(self, inside: bool) -> Ranges | int:
        """After a backslash: the ranges of a shorthand, or a character."""
        c = self.peek()
        if not c:
            _refuse("a backslash at the end")
        self.at += 1
        if c in "dwsDWS":
            base = {"d": _DIGIT, "w": _WORD, "s": _SPACE}[c.lower()]
            return base if c.islower() else _negated(base)
        if c in "pP":
            _refuse("a property class")
        if c == "x":
            return self.hexadecimal(2)
        if c == "u":
            return self.hexadecimal(4)
        if c == "c":
            n = self.peek()
            if n.isascii() and n.isalpha() or inside and n and n in "0123456789_":
                self.at += 1
                return ord(n) % 32
            self.at -= 1
            return 92
        if c in "01234567" and (inside or c == "0"):
            self.at -= 1
            return self.octal()
        return _CONTROLS.get(c) or ord(c)

    def char_class(self) -> Item:
        negate = self.peek() == "^"
        self.at += negate
        ranges: Ranges = []

        def member() -> Ranges | int:
            c = self.peek()
            self.at += 1
            if c != "\\":
                return ord(c)
            if self.peek() == "b":
                self.at += 1
                return 8
            return self.class_escape(True)

        while self.peek() != "]":
            if self.at >= len(self.s):
                _refuse("an unclosed class")
            first = member()
            if self.peek() == "-" and self.peek(2) not in ("-]", "-"):
                self.at += 1
                second = member()
                if isinstance(first, int) and isinstance(second, int):
                    if second < first:
                        _refuse("a reversed range")
                    ranges.append((first, second))
                    continue
                ranges += [(45, 45), *(second if isinstance(second, list) else [(second, second)])]
            ranges += first if isinstance(first, list) else [(first, first)]
        self.at += 1
        return self.chars(ranges, negate)


def parse(pattern: str, flags: str = "", max_length: int | None = None) -> Item:
    """The parsed expression; an OperandError of code UNSAFE_PATTERN if the dialect refuses it."""
    if max_length is not None and len(pattern) > max_length:
        _refuse(f"longer than {max_length} characters")
    if set(flags) & set("uv"):
        _refuse("the flags u and v")
    reader = _Reader(pattern, flags)
    tree = reader.alternatives()
    if reader.at < len(pattern):
        _refuse("a closing bracket without its group")
    if tree.size() > MAX_SIZE:
        _refuse(f"more than {MAX_SIZE} instructions")
    return tree


def _class(ranges: Ranges) -> str:
    point = lambda c: f"\\x{{{c:x}}}"
    valid = [(max(a, lo), min(b, hi)) for a, b in ranges for lo, hi in ((0, 0xD7FF), (0xE000, MAX_POINT)) if max(a, lo) <= min(b, hi)]
    if not valid:
        return r"[^\x{0}-\x{10ffff}]"
    return "[" + "".join(point(a) if a == b else f"{point(a)}-{point(b)}" for a, b in valid) + "]"


def to_re2(tree: Item, lines: bool = False) -> str:
    """The pattern as RE2 takes it. ``lines``: anchors match at line feeds too."""
    match tree.kind:
        case "set":
            return _class(tree.ranges)
        case "seq":
            return "".join(to_re2(i, lines) for i in tree.items)
        case "alt":
            return "(?:" + "|".join(to_re2(i, lines) for i in tree.items) + ")"
        case "repeat":
            count = {(0, None): "*", (1, None): "+", (0, 1): "?"}.get((tree.low, tree.high)) or (f"{{{tree.low},{'' if tree.high is None else tree.high}}}")
            return f"(?:{to_re2(tree.items[0], lines)}){count}" + "?" * tree.lazy
    return {"begin": "(?m:^)" if lines else r"\A", "end": "(?m:$)" if lines else r"\z", "edge": r"\b", "inside": r"\B"}[tree.kind]


def plain_text(tree: Item) -> str | None:
    """The literal that the whole expression is, if it is one."""
    items = tree.items if tree.kind == "seq" else [tree]
    if all(i.kind == "set" and len(i.ranges) == 1 and i.ranges[0][0] == i.ranges[0][1] for i in items):
        return "".join(chr(i.ranges[0][0]) for i in items)
    return None


# A small virtual machine, for what RE2 can't say (line anchors of this dialect) and for the places of matches.


def program(tree: Item) -> list[tuple]:
    """Instructions: (char, ranges), (split, first, second), (jump, to), (begin|end|edge|inside,), (match,)."""
    code: list[tuple] = []

    def emit(item: Item) -> None:
        match item.kind:
            case "set":
                code.append(("char", item.ranges))
            case "seq":
                for i in item.items:
                    emit(i)
            case "alt":
                jumps = []
                for n, i in enumerate(item.items):
                    last = n == len(item.items) - 1
                    split = len(code)
                    if not last:
                        code.append(())
                    emit(i)
                    if not last:
                        jumps.append(len(code))
                        code.append(())
                        code[split] = ("split", split + 1, len(code))
                for j in jumps:
                    code[j] = ("jump", len(code))
            case "repeat":
                body = item.items[0]
                for _ in range(item.low):
                    emit(body)
                if item.high is None:
                    split = len(code)
                    code.append(())
                    emit(body)
                    code.append(("jump", split))
                    ways = (split + 1, len(code))
                    code[split] = ("split", *(ways[::-1] if item.lazy else ways))
                else:
                    splits = []
                    for _ in range(item.high - item.low):
                        splits.append(len(code))
                        code.append(())
                        emit(body)
                    for at in splits:
                        ways = (at + 1, len(code))
                        code[at] = ("split", *(ways[::-1] if item.lazy else ways))
            case kind:
                code.append((kind,))

    emit(tree)
    code.append(("match",))
    return code


def _in(ranges: Ranges, c: int) -> bool:
    return any(a <= c <= b for a, b in ranges)


def search(code: list[tuple], text: str, start: int = 0, multiline: bool = False, steps: list[int] | None = None) -> tuple[int, int] | None:
    """The leftmost match from ``start`` on, of the first alternative. ``steps`` is lowered by each position visited."""
    n = len(text)
    word = lambda i: 0 <= i < n and (text[i] == "_" or text[i].isascii() and text[i].isalnum())
    line_end = lambda i: text[i] in "\n\r\u2028\u2029"

    def holds(kind: str, i: int) -> bool:
        if kind == "begin":
            return i == 0 or multiline and line_end(i - 1)
        if kind == "end":
            return i == n or multiline and line_end(i)
        return (word(i - 1) != word(i)) == (kind == "edge")

    threads: list[tuple[int, int]] = []
    best = None
    for i in range(start, n + 1):
        if steps is not None:
            steps[0] -= 1
        if best is None:
            threads.append((0, i))
        seen: set[int] = set()
        after: list[tuple[int, int]] = []
        for pc0, begin in threads:
            stack = [pc0]
            cut = False
            while stack:
                pc = stack.pop()
                if pc in seen:
                    continue
                seen.add(pc)
                op = code[pc]
                if op[0] == "split":
                    stack += [op[2], op[1]]
                elif op[0] == "jump":
                    stack.append(op[1])
                elif op[0] == "match":
                    best, cut = (begin, i), True
                    break
                elif op[0] == "char":
                    if i < n and _in(op[1], ord(text[i])):
                        after.append((pc + 1, begin))
                elif holds(op[0], i):
                    stack.append(pc + 1)
            if cut:
                break
        threads = after
        if not threads and best:
            break
    return best


def matches(code: list[tuple], text: str, multiline: bool = False) -> list[tuple[int, int]]:
    """Every match, leftmost first; none at all if the search visits more positions than the text's length allows."""
    out, at, steps = [], 0, [4 * len(text) + 1000]
    while at <= len(text):
        if steps[0] < 0:
            return []
        found = search(code, text, at, multiline, steps)
        if found is None:
            return out
        out.append(found)
        at = found[1] if found[1] > found[0] else found[1] + 1
    return out
