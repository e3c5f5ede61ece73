"""The language on the driver: parsing, serialising, mending, building and its limits."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import winnow
from winnow import builders as b
from winnow.plans import limits, recover
from winnow.plans.tree import Bound, Empty, Glob, Group, Literal, Logical, Missing, Range, Regex, Tag, Unary, Wildcard, operands

QUERIES = r"""
status:active
status::"in progress"
a.b.c:x
'full name'.first:x
a.'b.c':y
a\.b:1
"":x
f:>=10
f:=true
f:=null
f:[a TO b]
f:{1 TO *}
f:[* TO *]
f:[\* TO 9]
f:{"x y" TO 'z'}
name:*a*b?
name:"a*"
name:\*
/ab[/]c/i
x:/re\/s/gim
a AND b OR c
a b -c NOT d
(a OR b) AND c
(((a)))
NOT NOT a
- 3
-3
x:-3
f:(a OR -3 b)
f:(a OR - 3)
f:(NOT 3 a)
f:(14:30 OR "x")
f::(a b)
created:>=2020-01-01T10:00:00
a:b:c
14:30
and or not
\AND
f:\true
f:"true"
a."b"
"a \" b \\ c"
x::::y
f:[-5 TO 5]
f:\[x
a\ b
title:a*b*c*d
false
null
""
""".strip("\n").split("\n")


@pytest.mark.parametrize("query", QUERIES)
def test_round_trip(query):
    tree = winnow.parse(query)
    text = winnow.serialize(tree)
    assert winnow.parse(text) == tree and winnow.serialize(winnow.parse(text)) == text
    assert winnow.from_dict(json.loads(json.dumps(winnow.to_dict(tree)))) == tree


def test_shapes():
    assert winnow.parse("  ") == Empty()
    assert winnow.parse("f::>=1") == Tag(b.field("f"), ":>=", Literal("1"), True)
    assert winnow.parse("a b OR c") == Logical("OR", Logical("AND", Literal("a"), Literal("b"), True), Literal("c"))
    assert winnow.parse("a OR b c") == Logical("OR", Literal("a"), Logical("AND", Literal("b"), Literal("c"), True))
    assert winnow.parse("-a b").left == Unary("-", Literal("a"))
    assert winnow.parse("x:a**b").expression == Wildcard(("a", Glob.ANY, "b"))
    assert winnow.parse("x:[1 TO 5}").expression == Range(Bound(Literal("1")), Bound(Literal("5"), False))
    assert winnow.parse("x:(-3)").expression == Group(Literal("-3")) and winnow.parse("x:(- 3)").expression == Group(Unary("-", Literal("3")))
    assert winnow.parse("a.'b.c'.d:1").field == b.field("a", "b.c", "d") and winnow.field_path(b.field("a", "b.c")) == ("a", "b.c")
    assert winnow.parse("/a[/]b/im") == Regex("a[/]b", "im")
    assert [winnow.parse(w).value for w in ("true", "null", '"true"', "True")] == [True, None, "true", "True"]
    assert winnow.parse('f:"a*"').expression == Wildcard(("a", Glob.ANY), True)


@pytest.mark.parametrize(("query", "code", "reason", "at"), [
    ("status: active", "SYNTAX", "Did you mean status:active?", 7), ("(a", "SYNTAX", "lacks its", 2), ("f:", "SYNTAX", "value is missing", 2),
    ("f:>a*", "SYNTAX", "one value", 5), ("f:>true", "SYNTAX", "one text or number", 7), ("a^2", "UNSUPPORTED_SYNTAX", "boost", 1), ("a~", "UNSUPPORTED_SYNTAX", "fuzzy", 1),
    ("+x", "UNSUPPORTED_SYNTAX", "no meaning yet", 0), ('"abc', "SYNTAX", "quote is never closed", 0), ("/abc", "SYNTAX", "expression is never closed", 0), ("a)", "SYNTAX", "Unexpected", 1),
    ("f:[1 TO", "SYNTAX", "upper bound", 7), ("f:[1 2]", "SYNTAX", 'by "TO"', 5), ('n:("a":b)', "SYNTAX", "no fields of their own", 3),
    ("f:[* TO *x]", "SYNTAX", "no wildcards", 8), ('["*" TO 9]', "SYNTAX", "wildcards", 1), ("AND", "SYNTAX", "term is missing", 0), ("a OR", "SYNTAX", "term is missing", 4),
    (":", "SYNTAX", "Unexpected character", 0), ("/a/x", "SYNTAX", "Unknown regular expression flag", 0), ("/a/ii", "SYNTAX", "Duplicate", 0),
])
def test_errors_say_where(query, code, reason, at):
    with pytest.raises(winnow.SyntaxError_) as e:
        winnow.parse(query)
    assert e.value.code == code and reason in e.value.reason and e.value.span.start == at
    assert str(e.value).split("\n")[-1].index("^") == at + 2


@pytest.mark.parametrize(("query", "text", "reason"), [
    ("status: active", "status:active", None), ("(a", "(a)", "unclosed-group"), ("a^2", "a", "unsupported-modifier"), ("+x", "x", "unsupported-modifier"),
    ('"abc', '"abc"', "unterminated-quote"), ("/abc", "/abc/", "unterminated-regex"), ("a)", "a", "trailing-input"), ("a ] b", "a b", "stray-input"),
    ("a OR b ) c", "a OR b c", "stray-input"), ("a ) OR b", "a  OR b", "stray-input"), ("f:[1 TO", "f:[1 TO *]", None), ("f:(a:b", r"f:(a\:b)", None),
])
def test_tolerant_parses(query, text, reason):
    tree = winnow.parse(query, tolerant=True)
    assert winnow.serialize(tree) == text
    assert (tree.recovered and tree.recovered.reason) == reason
    assert recover.first_recovered(tree) is not None or query == "status: active"


@pytest.mark.parametrize(("query", "pruned"), [("f:", ""), ("a AND ", "a"), ("a OR NOT", "a"), ("(a f:>=)", "(a)"), ("f:(a OR", "f:(a)"), ("f:>a* b", "b"), ("f:[1 TO", ""), ("NOT", ""), ("a f:[x* TO 2]", "a")])
def test_holes_are_pruned(query, pruned):
    assert winnow.serialize(recover.prune(winnow.parse(query, True))) == pruned


def test_limits():
    winnow.parse("(" * 199 + "a" + ")" * 199)
    long = winnow.parse(" ".join(["a:1"] * 2000))
    with limits.deep_recursion():  # equality of nodes walks their depth
        assert len(list(operands(long))) == 2000 and winnow.parse(winnow.serialize(long)) == long and winnow.from_dict(winnow.to_dict(long)) == long
    for query in ("(" * 202 + "a" + ")" * 202, "NOT " * 202 + "a", " ".join(["a:1"] * 2001), ".".join(["a"] * 33) + ":1", "a:" + "?*" * 300):
        for tolerant in (False, True):
            with pytest.raises(winnow.SyntaxError_):
                winnow.parse(query, tolerant)


def test_builders_check_what_they_build():
    tree = b.or_(b.tag(b.field("a", "b.c"), b.wildcard("x*")), b.not_(b.compare(b.field("n"), ":>=", b.term("5")), "-"))
    assert winnow.serialize(tree) == 'a."b.c":x* OR -n:>=5' and winnow.parse(winnow.serialize(tree)) == tree
    assert winnow.serialize(b.and_(b.or_(b.term("a"), b.term("b")), b.quoted("c d"))) == '(a OR b) AND "c d"'
    assert winnow.serialize(b.tag(b.field("f"), b.range_(b.term("1"), False, None, True))) == "f:{1 TO *]"
    assert winnow.serialize(b.tag(b.field("f"), b.field_group(b.or_(b.term("x"), b.null())), True)) == "f::(x OR null)"
    assert b.wildcard(r"a\*") == Literal("a*") and winnow.serialize(b.term("AND")) == r"\AND" and winnow.serialize(b.empty()) == ""
    for wrong in (lambda: b.compare(b.field("f"), ":>", b.regex("x")), lambda: b.tag(b.field(), b.term("x")), lambda: b.regex("a", "xx"), lambda: b.tag(b.field("f"), b.group(b.tag(b.field("g"), b.term("x")))), lambda: b.and_(b.term("a"), "b")):
        with pytest.raises(winnow.ArgumentError):
            wrong()
    with pytest.raises(winnow.ArgumentError):
        winnow.from_dict({"type": "Nonsense"})
    with pytest.raises(winnow.ArgumentError):
        winnow.parse(5)


def test_reserved_modifiers_are_only_serialised():
    from dataclasses import replace

    from winnow.plans.tree import Modifiers

    assert winnow.serialize(replace(Literal("a"), modifiers=Modifiers(boost="2", fuzzy="", required=True))) == "+a^2~"


def test_constants_and_helpers():
    assert winnow.is_safe_unquoted("abc") and not any(map(winnow.is_safe_unquoted, ("", "AND", "true", "-a", "a b", "a:b", "a*")))
    assert winnow.range_bracket("lower", Bound(None, False)) == "[" and winnow.range_bracket("upper", Bound(Literal("x"), False)) == "}"
    assert winnow.is_node(Missing()) and not winnow.is_node({}) and len(winnow.ROOT_NODE_TYPES) == 10
    assert winnow.detect_format("2020-02-30") == "date" and winnow.detect_format("14:30") == "time" and winnow.detect_format("2020") is None


ATOM = st.sampled_from(["a", "AND", "true", "null", "a b", "*", "a*b", "x?y", "-3", "3", "c:d", "[x", "é“", "\\", '"', "'", "a.b", "TO", "/r", "~2", "+p", "=", ">5", ""])
WORDS = ATOM.map(lambda t: Literal(t)) | ATOM.map(lambda t: Literal(t, True)) | st.sampled_from([Literal(True), Literal(None), Regex("a/b".replace("/", r"\/"), "i"), Wildcard(("a", Glob.ANY), True), Wildcard((Glob.ONE, "AND", Glob.ANY, "-x"))])
BOUND = st.builds(Bound, st.none() | ATOM.map(Literal) | ATOM.map(lambda t: Literal(t, True)), st.booleans()).map(lambda x: Bound(None) if x.value is None else x)
RANGE = st.builds(Range, BOUND, BOUND)
FIELD = st.lists(ATOM, min_size=1, max_size=3).map(lambda p: b.field(*p))


def _join(inner):
    return st.builds(Logical, st.just("AND"), inner, inner, st.booleans()) | st.builds(lambda x, y: Logical("OR", x, y), inner, inner) | st.builds(Unary, st.sampled_from(["NOT", "-"]), inner) | inner.map(Group)


GROUPED = st.recursive(WORDS | RANGE, _join, max_leaves=4)
CLAUSE = st.builds(lambda f, e, c: Tag(f, ":", e, c), FIELD, WORDS | RANGE | GROUPED.map(Group), st.booleans()) | st.builds(lambda f, o, t: Tag(f, o, Literal(t)), FIELD, st.sampled_from([":=", ":>", ":<="]), ATOM)
TREES = st.recursive(WORDS | RANGE | CLAUSE, _join, max_leaves=8)


def _normal(node):
    """What a query can't tell apart: an empty bare term is quoted, and an exact AND/OR spine leans left."""
    from dataclasses import fields, replace

    if isinstance(node, Literal):
        return Literal("", True) if node.value == "" else node
    changed = {f.name: _normal(v) for f in fields(node) if hasattr(v := getattr(node, f.name), "recovered")}
    node = replace(node, **changed)
    weak = {"AND": 20, "OR": 10}
    if isinstance(node, Logical) and isinstance(node.right, Logical) and weak[node.right.operator] <= weak[node.operator]:
        node = replace(node, right=Group(node.right))
    if isinstance(node, Logical) and isinstance(node.left, Logical) and weak[node.left.operator] < weak[node.operator]:
        node = replace(node, left=Group(node.left))
    if isinstance(node, Unary) and isinstance(node.operand, Logical):
        node = replace(node, operand=Group(node.operand))
    return node


@settings(max_examples=300, deadline=None)
@given(TREES)
def test_any_tree_survives_its_own_text(tree):
    text = winnow.serialize(tree)
    again = winnow.parse(text)
    assert again == _normal(tree)
    assert winnow.serialize(again) == text


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("ab:()[]{}\"'\\/*?-+^~ .TO19AND"), max_size=24))
def test_any_text_parses_or_is_refused_with_the_engines_own_error(text):
    for tolerant in (False, True):
        try:
            tree = winnow.parse(text, tolerant)
        except winnow.QueryError:
            continue
        again = winnow.parse(winnow.serialize(recover.prune(tree)), tolerant)
        assert tolerant or again == tree
