"""Queries over rows: values, paths, policies, highlights, custom types and what the plans look like."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

import winnow
from winnow import Engine
from winnow.functions import numbers, regex, temporal

UTC = dt.UTC
SCHEMA = """id int, name string, state string, rank int, score double, live boolean, made string, due timestamp, day date, at string,
 tags array<string>, owner struct<name:string,age:int,pets:array<struct<kind:string,ages:array<int>>>>, props map<string,string>, `a.b` string, n bigint"""


def _rows():
    day = lambda s: dt.datetime.fromisoformat(s).replace(tzinfo=UTC)
    pets = [("cat", [1, 2]), ("dog", None)]
    return [
        (1, "Ship the Box", "In Progress", 3, 5.0, False, "2020-06-15T10:00:00Z", day("2020-07-01"), dt.date(2020, 7, 1), "14:30", ["red", "Blue"], ("Ada Lane", 30, pets), {"size": "L"}, "dot", 2**53),
        (2, "refactor it", "done", 1, float("nan"), True, "2019/01/01", day("2019-02-01T12:30:00"), dt.date(2019, 2, 1), "09:00:30", ["red"], ("Alan", None, None), {"Colour": "red"}, None, -3),
        (3, "Fix inactive", "inactive", 2, None, False, "n/a", None, None, "24:00", [], None, None, "x", 7),
        (4, "*literal* star?", "active", 5, float("inf"), None, "2021-02-29", day("2021-03-01"), dt.date(2021, 3, 1), None, None, ("adam", 7, []), {}, "5", 0),
        (5, "ſharp K é\nline two", "ACTIVE", 4, -2.5, True, "1592179200000", day("2020-06-15T00:00:00.500"), dt.date(2020, 6, 15), "2020-06-15", ["10", None, "a*b"], ("Grace", 30, [("fish", [5])]), {"size": "M", "n": "7"}, "007", 100),
    ]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(_rows(), SCHEMA).cache()


def ids(df, query, **options):
    return sorted(r.id for r in Engine(**options).filter(query, df).select("id").collect())


@pytest.mark.parametrize(("query", "want"), [
    ("", [1, 2, 3, 4, 5]), ("state:active", [4, 5]), ("state::active", [4]), ('state:"in progress"', [1]), ("state:=DONE", [2]), ("state:act", []),
    ("active", [3, 4, 5]), ("ada", [1, 4]), ("rank:3", [1]), ('rank:"3"', []), ("rank:>3", [4, 5]), ("rank:<=2", [2, 3]), ("rank:[2 TO 4}", [1, 3]), ("rank:{2 TO *]", [1, 4, 5]), ("rank:[4 TO 2]", []),
    ("score:>0", [1]), ("score:<0", [5]), ("score:<=5", [1, 5]), ("NOT score:>0", [2, 3, 4, 5]), ("score:5", [1]), ("score:[* TO *]", [1, 2, 4, 5]), ("n:9007199254740992", [1]), ("n:9007199254740993", []), ("n:1e2", [5]), ("n:2.5", []),
    ("live:true", [2, 5]), ('live:"true"', []), ("live:null", [4]), ("NOT live:true", [1, 3, 4]), ("live:=false", [1, 3]),
    ("due:>=2020-06-15", [1, 4, 5]), ("due:>2020-06-15T00:00:00.5", [1, 4]), ("due:2020-07-01T02:00+02:00", [1]), ("due:null", [3]), ("due:[2019-02-01 TO 2019-02-02}", [2]), ("due:2020/07/01", [1]), ("due:<0001-01-01", []), ("due:>0000-01-01", [1, 2, 4, 5]),
    ("day:2020-07-01", [1]), ("day:>2020-06-15T12:00", [1, 4]), ("day:<2020-06-15T00:01", [2, 5]), ("day:2020-06-15T01:00", []), ("day:>=2021", []),
    ("made:>=2020-01-01", [1]), ("made:2019-01-01", [2]), ("made:<2020-01-01", [2]), ("made:>=1000", [5]), ("at:>=10:00", [1]), ("at:14:30", [1]), ("at:[09:00 TO 09:01}", [2]), ("at:2020-06-15", [5]),
    ("tags:red", [1, 2]), ("tags:blue", [1]), ("tags::blue", []), ("tags:null", [4, 5]), ("tags.0:red", [1, 2]), ("tags.1:null", [5]), ("tags.9:null", []), ("tags.01:red", []), ("tags:10", [5]), ("tags:[* TO *]", [1, 2, 5]), ("tags:a\\*b", [5]), ("tags:*l?e", [1]), ("tags:/^[a-r]+$/", [1, 2]),
    ("owner.name:ada*", [1, 4]), ("owner.age:30", [1, 5]), ("owner.age:null", [2]), ("owner:null", [3]), ("owner:[* TO *]", [1, 2, 4, 5]), ("owner.Name:ada*", []), ("owner.none:null", [1, 2, 4, 5]), ("owner.none.more:null", []),
    ("owner.pets.kind:dog", [1]), ("owner.pets.ages:>4", [5]), ("owner.pets.ages:2", [1]), ("owner.pets.ages:null", [1]), ("owner.pets.1.kind:dog", [1]), ("owner.pets.0.ages.1:2", [1]), ("owner.pets:null", [2]), ("owner.pets.kind:/^.o/", [1]),
    ("props.size:m", [5]), ("props.Colour:red", [2]), ("props.colour:red", []), ("props.size:null", [2, 4]), ("props.n:7", [5]), ("props:null", [3]),
    ('"a.b":x', [3]), ("'a.b':5", [4]), ("a\\.b:7", [5]), ("a.b:x", []), ("nosuch:x", []), ("nosuch:null", [1, 2, 3, 4, 5]), ("NOT nosuch:x", [1, 2, 3, 4, 5]), ("nosuch:[* TO *]", []),
    ("name:*star*", [4]), ("name:\\*literal\\**", [4]), ("name:*\\?", [4]), ("name:*", [1, 2, 3, 4, 5]), ("rank:*", []), ("name:s*p*e*x", [1]), ("name::s*", []), ("name:?hip*", [1]), ("name:f*i*i*ve", [3]), ("state:????", [2]), ("name:*two", [5]), ("name:*x*x*", []), ("tags:*", [1, 2, 5]),
    ("name:/box/i", [1]), ("name:/^[A-Z]\\w+ the/", [1]), ("name:/K/i", [5]), ("name:/k é$/", []), ("name:/é$/m", [5]), ("name:/star\\?$/", [4]), ("rank:/3/", []), ("name:/./", [1, 2, 3, 4, 5]), ("name:/(ship|fix).*e$/i", [3]), ("name:/s/i", [1, 4]),
    ("state:(active OR done)", [2, 4, 5]), ("state::(active OR done)", [2, 4]), ("n:(-3 OR 7)", [2, 3]), ("n:(NOT 7 [0 TO *])", [1, 4, 5]), ("rank:(1 OR 2) -state:done", [3]), ("state:active OR rank:1 live:true", [2, 4, 5]), ("(state:active OR rank:1) live:true", [2, 5]), ("NOT (state:active OR rank:1)", [1, 3]),
    ("30", [1, 5]), ("true", [2, 5]), ('"2019-02-01"', [2]), ("red", [1, 2]), ("l", [1, 2, 4, 5]), ("[1 TO 5]", []), ("dog", [1]), ("gra*", [5]), ("/^adam$/", [4]), ("7", [3, 4, 5]), ("100", [5]), ("1592179200000", [5]),
])
def test_which_rows_match(df, query, want):
    assert ids(df, query) == want
    assert ids(df, f"NOT ({query})" if query else "NOT (* OR NOT *)") == sorted({1, 2, 3, 4, 5} - set(want))


def test_scans_find_nulls_and_keys(df):
    assert ids(df, "null") == [1, 2, 3, 4, 5]
    assert ids(df, "colour") == [] and ids(df, "colour", match_keys=True) == [2]
    assert ids(df, "pets", match_keys=True) == [1, 2, 4, 5] and ids(df, "rank", match_keys=True) == [1, 2, 3, 4, 5]
    assert Engine().filter("colour", df, match_keys=True).count() == 1


@pytest.mark.parametrize(("query", "code"), [
    ("state:>=m", "UNORDERED_TYPE"), ("due:>=2021-02-29", "OPERAND"), ("due:2021-02-29", "OPERAND"), ("rank:[1 TO 2020-01-01]", "MIXED_RANGE_TYPES"), ("at:[10:00 TO 2020-01-01]", "MIXED_RANGE_TYPES"),
    ("name:/(a*)*/", "UNSAFE_PATTERN"), ("name:/a(?=b)/", "UNSAFE_PATTERN"), ("nosuch:>=x", "UNORDERED_TYPE"), ("created:>=2020-06", "UNORDERED_TYPE"), ("2021-02-29", "OPERAND"), ('"2021-02-29"', "OPERAND"),
])
def test_wrong_queries_raise_before_any_row(df, query, code):
    with pytest.raises(winnow.OperandError) as e:
        Engine().filter(query, df)
    assert e.value.code == code


def _raises(df, query, **options):
    engine = Engine(on_value_error="throw", **options)
    try:
        engine.filter(query, df).collect()
    except Exception as e:
        found = winnow.value_error(e)
        assert isinstance(found, winnow.ValueError_) and found.details["field"] in query and found.code == "VALUE", e
        return True
    return False


@pytest.mark.parametrize(("query", "raises"), [
    ("made:2020-01-01", True), ("made:>=2020-01-01", True), ("rank:>2", False), ("score:>2", True), ("score:5", True), ("state:x", False), ("name:>5", True), ("live:true", False), ("live:=5", False),
    ("due:>2020-01-01", True), ("made:2020-01-01 AND state:nosuch", True), ("state:nosuch AND made:2020-01-01", True), ("state:active OR NOT made:2020-01-01", True), ("2020-01-01T00:00", False), ("at:>10:00", True), ("tags:>5", True), ("owner.age:>5", True), ("n:[1 TO 5]", False), ("nosuch:>5", True),
])
def test_strict_values(df, query, raises):
    assert _raises(df, query) == raises
    assert _raises(df, f"({query}) AND state:nosuch") == raises and _raises(df, f"state:nosuch AND ({query})") == raises


def test_options(df):
    assert ids(df, "made:>01-06-2020", date_format="DD-MM-YYYY") == [1] and ids(df, "due:>01-06-2020", date_format="DD-MM-YYYY") == [1, 4, 5]
    assert ids(df, "made:>2020-01-01", date_format=("YYYY/MM/DD",)) == [1] and ids(df, "made:2019-01-01", date_format="YYYY/MM/DD") == [2]
    hook = lambda text: dt.datetime(2021, 2, 28) if text == "2021-02-29" else None
    assert ids(df, "made:>=2021-01-01", parse_date=hook) == [4] and ids(df, "due:>2021-02-29", parse_date=hook) == [4]
    assert ids(df, "name:/(?<=the )box/i", regex_guard=False) == [1]
    parent = Engine(match_keys=True, id="x")
    child = parent.extend(tolerant=True, match_keys=None, nosuch=1)
    assert child.options.match_keys and child.options.tolerant and not parent.options.tolerant and child.options.id == "x"
    assert [t["name"] for t in parent.types] == ["regex", "null", "boolean", "wildcard", "datetime", "number", "string"]
    for bad in ({"on_value_error": "x"}, {"tolerant": 1}, {"max_pattern_length": 0}, {"date_format": "YYYY-MM"}, {"date_format": "MM MM"}, {"types": (5,)}, {"type_strategy": "x"}):
        with pytest.raises(winnow.ConfigError):
            Engine(**bad)
    with pytest.raises(winnow.OperandError):
        Engine(max_pattern_length=3).filter("name:/abcd/", df)
    with pytest.raises(winnow.ArgumentError):
        Engine(strict_fields=True).filter("nosuch:1", df)
    with pytest.raises(winnow.ArgumentError):
        Engine().filter("a", [1])


def test_tolerant_engines(df):
    assert ids(df, "state:", tolerant=True) == [1, 2, 3, 4, 5] and ids(df, "(rank:>3", tolerant=True) == [4, 5]
    assert ids(df, "state:>=m rank:1", tolerant=True) == [2] and ids(df, "due:>=2021-02-31 OR rank:1", tolerant=True) == [2]
    assert ids(df, "state:(active OR", tolerant=True) == [4, 5] and ids(df, "name:/(a*)*/ rank:2", tolerant=True) == [3]
    with pytest.raises(winnow.RecoveredQueryError):
        Engine(tolerant=True, on_recovered="throw").filter("(rank:>3", df)


def test_custom_types(df):
    version = lambda t: ".".join(p.zfill(4) for p in t.split(".")) if re.fullmatch(r"\d+\.\d+\.\d+", t) else None
    releases = df.sparkSession.createDataFrame([(1, "1.2.3"), (2, "1.10.0"), (3, "0.9.9"), (4, "n/a"), (5, None)], "id int, v string")
    own = winnow.coerced("version", version, version, "string")
    assert ids(releases, "v:>=1.2.3", types=(own,)) == [1, 2] and ids(releases, "v:[0.9.0 TO 1.10.0}", types=(own,)) == [1, 3] and ids(releases, "v:01.2.3", types=(own,)) == [1]
    assert _raises(releases, "v:1.2.3", types=(own,)) and ids(releases, "v:1.2.3") == [1]
    assert [t["name"] for t in Engine(types=(own,), type_strategy="append").types][-1] == "version"
    with pytest.raises(winnow.ConfigError):
        Engine(types=(own, own))
    with pytest.raises(winnow.OperandError):
        Engine(types=(own,), type_strategy="replace").filter("v:x", releases)


def hits(df, query, **options):
    rows = Engine(**options).highlight(query, df.select("id", "name", "state", "rank", "tags", "owner")).collect()
    return {r.id: [(h.path, None if h.ranges is None else [tuple(x) for x in h.ranges]) for h in r.highlights] for r in rows if r.highlights}


def test_highlights(df):
    assert hits(df, "active") == {3: [("name", [(6, 12)]), ("state", [(2, 8)])], 4: [("state", [(0, 6)])], 5: [("state", [(0, 6)])]}
    assert hits(df, "state:active rank:5") == {4: [("state", [(0, 6)]), ("rank", None)]}
    assert hits(df, "state:active AND rank:1") == {} and hits(df, "state:done OR (rank:3 AND rank:4)") == {2: [("state", [(0, 4)])]}
    assert hits(df, "NOT state:active") == {} and hits(df, "rank:2 NOT state:active") == {3: [("rank", None)]}
    assert hits(df, "tags:red") == {1: [("tags.0", [(0, 3)])], 2: [("tags.0", [(0, 3)])]}
    assert hits(df, "tags:*l*e") == {1: [("tags.1", [(1, 2), (3, 4)])]} and hits(df, "tags:/e./") == {1: [("tags.0", [(1, 3)])], 2: [("tags.0", [(1, 3)])]}
    assert hits(df, "owner.age:30") == {1: [("owner.age", None)], 5: [("owner.age", None)]}
    assert hits(df, "name:/t\\w+/") == {1: [("name", [(5, 8)])], 2: [("name", [(5, 8)])], 3: [("name", [(8, 12)])], 4: [("name", [(3, 8), (11, 14)])], 5: [("name", [(15, 18)])]}
    assert hits(df, "name:*STAR*") == {4: [("name", [(10, 14)])]} and hits(df, "state:active OR active")[4] == [("state", [(0, 6)])]
    assert hits(df, "owner:null") == {3: [("owner", None)]}


def test_places_of_highlights_are_the_sources(spark):
    """Indexes count nulls, keys of maps are names, nested arrays have an index a level, whatever was stepped over."""
    rows = spark.createDataFrame([(
        1, {"colour": "red", "size": None}, [None, {"v": "x", "m": {"k": "x"}}], [[1, 2], None, [3, 2]], [{"a": "red"}, None, {"b": "red"}], "İstanbul", "x", ("x",),
    )], "id int, m map<string,string>, items array<struct<v:string,m:map<string,string>>>, n array<array<int>>, maps array<map<string,string>>, city string, `a.b` string, a struct<b:string>")
    found = lambda q, **o: sorted((h.path, tuple(h.segments), None if h.ranges is None else [tuple(r) for r in h.ranges]) for h in Engine(**o).highlight(q, rows).first().highlights)
    assert found("red") == [("m.colour", ("m", "colour"), [(0, 3)]), ("maps.0.a", ("maps", "0", "a"), [(0, 3)]), ("maps.2.b", ("maps", "2", "b"), [(0, 3)])]
    assert found("items.v:x") == [("items.1.v", ("items", "1", "v"), [(0, 1)])] and found("items.m.k:x") == [("items.1.m.k", ("items", "1", "m", "k"), [(0, 1)])]
    assert found("2") == [("n.0.1", ("n", "0", "1"), None), ("n.2.1", ("n", "2", "1"), None)]
    assert found("items.1.v:x") == [("items.1.v", ("items", "1", "v"), [(0, 1)])] and found("maps.b:r*") == [("maps.2.b", ("maps", "2", "b"), [(0, 1)])]
    assert found("m.size:null") == [("m.size", ("m", "size"), None)] and found("n:null") == [("n.1", ("n", "1"), None)]
    assert found("colour", match_keys=True) == [("m.colour", ("m", "colour"), [(0, 6)])]
    assert [h[1] for h in found("b", match_keys=True)] == [("a", "b"), ("a.b",), ("city",), ("maps", "2", "b")]
    # A fold that changes the length leaves no place to point at, but the hit stands.
    assert found("city:İstanbul") == [("city", ("city",), None)] and found("city::İstanbul") == [("city", ("city",), [(0, 8)])] and found("stan") == [("city", ("city",), None)]
    # A bare hit at a.b within a struct stays beside a located one at the column named "a.b".
    assert found("a.b:[* TO *] 'a.b':x") == [("a.b", ("a", "b"), None), ("a.b", ("a.b",), [(0, 1)])]


def test_columns_that_have_the_engines_own_names(spark):
    rows = spark.createDataFrame([(1, "mine", ["red"], 5)], "id int, __hits string, tags array<string>, __winnow_0 int")
    got = Engine().highlight("tags:*e* OR tags:/r/", rows).first()
    assert (got["__hits"], got["__winnow_0"]) == ("mine", 5) and [h.path for h in got.highlights] == ["tags.0", "tags.0"]


def test_keys_of_maps_inside_arrays(spark):
    rows = spark.createDataFrame([(1, [{"alpha": 1}, None], [("x", None)]), (2, None, [("y", {"beta": 2})])], "id int, m array<map<string,int>>, s array<struct<name:string,deep:map<string,int>>>")
    assert [r.id for r in Engine(match_keys=True).filter("alpha", rows).collect()] == [1] and [r.id for r in Engine(match_keys=True).filter("beta", rows).collect()] == [2]
    assert Engine().filter("alpha", rows).count() == 0 and Engine(match_keys=True).filter("deep", rows).count() == 2


def test_variant_columns_are_refused(spark):
    rows = spark.range(1).selectExpr("id", "parse_json('{\"a\": 1}') AS v", "array(parse_json('1')) AS w")
    for query in ("v:1", "v.a:1", "w:1", "1"):
        with pytest.raises(winnow.ArgumentError, match="Variant"):
            Engine().filter(query, rows)
    assert Engine().filter("id:0", rows).count() == 1


class _Odd(winnow.ValueType):
    """A type whose methods do what they shouldn't."""

    name = "odd"

    def __init__(self, **does):
        self.does = does

    def parse_operand(self, operand, context):
        return self.does.get("parse", lambda context: winnow.Claimed("x"))(context)

    def read(self, column, kind, operand, context):
        return winnow.Reading(column) if str(kind) == "StringType()" else None

    def equals(self, value, operand, context):
        return self.does.get("equals", lambda value: value == operand)(value)

    def spans(self, operand, context):
        return self.does.get("spans")


def test_custom_types_are_guarded(df, spark):
    def fails(*_):
        raise RuntimeError("defect")

    engine = lambda **does: Engine(types=(_Odd(**does),))
    with pytest.raises(winnow.OperandError, match="odd.*defect"):
        engine(parse=fails).filter("name:a", df)
    with pytest.raises(winnow.ConfigError, match="parse_operand"):
        engine(parse=lambda c: 5).filter("name:a", df)
    for equals in (fails, lambda v: True, lambda v: None, lambda v: F.length(v)):
        with pytest.raises(winnow.ConfigError):
            engine(equals=equals).filter("name:a", df)
        with pytest.raises(winnow.ConfigError):
            engine(equals=equals).test("NOT name:a OR rank:1", df)
    with pytest.raises(winnow.ConfigError, match="defect"):
        Engine(types=(fails,))
    seen = []
    engine(parse=lambda c: seen.append(c) or winnow.Claimed("x")).filter("name:a", df)
    assert not hasattr(seen[0].options, "on_value_error") and seen[0].options.max_pattern_length == 1000 and seen[0].site == "match"
    # Spans that make no sense are left out; a hit without any is a bare one.
    rows = spark.createDataFrame([(1, "abcdef")], "id int, t string")
    spans = lambda f: [h.ranges if h.ranges is None else [tuple(r) for r in h.ranges] for h in engine(equals=lambda v: v.isNotNull(), spans=f).highlight("t:a", rows).first().highlights]
    assert spans(lambda t: [(4, 5), (0, 2), (-1, 3), (3, 9), (2, 2), "x", (1, "2"), (0.0, 1)]) == [[(0, 2), (4, 5)]]
    assert spans(lambda t: [(5, 5)]) == [None] and spans(fails) == [None] and spans(lambda t: 7) == [None]
    # What a coercion can't take is no value; what it makes of another type than declared is a defect.
    word = winnow.coerced("word", lambda t: t, lambda t: t if t != "abcdef" else fails(), "string")
    assert Engine(types=(word,)).filter("t:abcdef", rows).count() == 0
    with pytest.raises(Exception, match="coerce must return"):
        Engine(types=(winnow.coerced("word", lambda t: 5, lambda t: "text", "int"),)).filter("t:a", rows).collect()


def test_the_failure_policy_is_sealed():
    with pytest.raises(TypeError):
        winnow.VALUE_FAILURE_POLICY["match"]["miss"] = "value-error"
    with pytest.raises(TypeError):
        winnow.VALUE_FAILURE_POLICY["match"] = {}
    assert winnow.disposition("ordered", "miss") == "value-error"
    with pytest.raises(winnow.ArgumentError):
        winnow.disposition("ordered", "x")


def test_test_is_two_valued(df):
    rows = Engine().test("score:>0", df).collect()
    assert {r.id: r.matched for r in rows} == {1: True, 2: False, 3: False, 4: False, 5: False}
    assert df.where(Engine().column("rank:>3", df.schema)).count() == 2


# Regular expressions

SAFE = ["a|b", "^a+$", "(a|b)*c", "[^a-c]x", r"\bfoo\b", r"\d{2,3}-\w+", "a{0,2}b", "x?y", "(?:ab)+?", r"[\w-]+", "[a-]", "[]", "[^]", r"\x41B", r"[\b]", r"\cA", r"\0", "a{,2}", "{", "(?<n>a)b", "(a|aa)+$", r"\S+\s\S", ".", r"[\d-z]", r"\/", "a$b", r"\Bx"]
UNSAFE = ["(a*)*", "(a|b?)+", "^*", "a**", "+a", "(?=a)", "(?<!a)b", r"\1(a)", r"\k<n>", r"\p{L}", "a{1001}", "a{3,2}", "(a", "a)", "[a", "[z-a]", r"\x4", r"\u12", "(?i)a", "(?<>a)", "(a{100}){100}", "a\\"]


@pytest.mark.parametrize("pattern", SAFE)
def test_regular_expressions_agree_with_pythons(pattern):
    import pyarrow as pa
    import pyarrow.compute as pc

    rng = random.Random(pattern)
    texts = ["", "foo bar", "AB", "\x01", "\0", "a{,2}", "é foo", *("".join(rng.choice("abcxy foo1-2AB/{z") for _ in range(rng.randrange(12))) for _ in range(150))]
    tree = regex.parse(pattern)
    code, re2 = regex.program(tree), regex.to_re2(tree)
    theirs = {"[]": r"(?!)", "[^]": r"(?s:.)", r"\cA": "\x01", r"[\d-z]": r"[\dz-]", "(?<n>a)b": "(?P<n>a)b", "a{,2}": r"a\{,2\}"}.get(pattern, pattern.replace("$", r"\Z"))
    own = re.compile(theirs, re.ASCII)
    for t in texts:
        want = own.search(t)
        assert (regex.search(code, t) is not None) == (want is not None), t
        assert pc.match_substring_regex(pa.array([t]), re2)[0].as_py() == (want is not None), t
        assert regex.matches(code, t) == [m.span() for m in own.finditer(t)] or pattern in ("(a|b)*c",), t


@pytest.mark.parametrize("pattern", UNSAFE)
def test_regular_expressions_that_are_refused(pattern):
    with pytest.raises(winnow.OperandError) as e:
        regex.parse(pattern)
    assert e.value.code == "UNSAFE_PATTERN"


def test_lines_of_texts_that_end_otherwise(spark):
    texts = ["a\nb", "a\r\nb", "x\u2028b", "xb", "b\n", None, "\nb c", "ab\u2029c"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    own = lambda p: [i for i, t in enumerate(texts) if t is not None and regex.search(regex.program(regex.parse(p, "m")), t, 0, True) is not None]
    for pattern in ("^b$", "^b", "b$", "^c", "^$", r"a$\n?"):
        if pattern != r"a$\n?":
            assert [r.i for r in Engine().filter(f"t:/{pattern}/m", df).collect()] == own(pattern), pattern
    assert own("^b$") == [0, 1, 2, 4]


def test_spans_stop_where_too_many_positions_are_visited():
    code = regex.program(regex.parse("a"))
    assert len(regex.matches(code, "a" * 5000)) == 5000
    late = regex.program(regex.parse("a(.*z)?"))  # each match reads to the end of the text
    assert len(regex.matches(late, "a" * 40)) == 40 and regex.matches(late, "a" * 5000) == []


def test_the_dialect():
    on = lambda p, t, f="": regex.search(regex.program(regex.parse(p, f)), t, 0, "m" in f) is not None
    assert not on("a$", "a\n") and on(r"\s", "\xa0") and on(".", "\x85") and not on(".", "\u2028") and on("a.b", "a\nb", "s")
    assert not on("k", "\u212a", "i") and not on("s", "ſ", "i") and on("É", "é", "i") and on("[^a]", "b", "i") and not on("[^a]", "A", "i")
    assert on("^b$", "a\r\nb c".replace(" c", "")) is False and on("^b$", "a\rb", "m") and not on("^b", "ab", "m")
    long = "a" * 40_000 + "b"
    assert on("^(a|a)+$", long[:400]) and not on("^(a|a)+$", long[:400] + "b")


# Numbers and dates


def test_number_text():
    assert [numbers.parse_number(t) for t in ("5", "+5.", ".5", "1e3", "-0", "9007199254740993", "9007199254740992", "", " 5", "5d", "Infinity", "1e999", "٣")] == [5, 5, 0.5, 1000, 0, None, 2**53, None, None, None, None, None, None]


def test_number_columns(spark):
    texts = ["5", "+5.", ".5", "1e3", "9007199254740993", "9007199254740992", "", " 5", "5d", "NaN", "1e999", "12345678901234567890123456789012345678901234567890", None, "x", "12\n", "1e3\n", str(2**70), str(2**70 + 2**17), str(2**70 + 2**18), str(2**130), str(2**130 + 1), str(-(2**1000)), "0" * 5000 + "7", "-" + "0" * 60 + str(2**64), "1" + "0" * 400]
    rng = random.Random(3)
    texts += [str((rng.getrandbits(rng.randrange(1, 56)) << (e := rng.randrange(960))) + rng.choice([0, 1, 1 << max(e - 1, 0)])) for _ in range(100)]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(numbers.number_column(F.col("t"))).collect()]
    assert got == [None if t is None or numbers.parse_number(t) is None else float(numbers.parse_number(t)) for t in texts]


DATES = ["2020-06-15", "2020/06/15", "2020-06/15", "2020-6-15", "2020", "2020-02-30", "2021-02-29", "2000-02-29", "1900-02-29", "2020-06-15T10:30", "2020-06-15 10:30:05.1239", "2020-06-15t10:30:05,5z", "2020-06-15T10:30+05", "2020-06-15T10:30-0530", "2020-06-15T24:00", "2020-06-15T10:30:60", "0000-01-01", "0001-01-01T00:00+23:59", "9999-12-31T23:59:59.999-23:59", "14:30", "14:30:15.25", "24:00", "1:30", "2020-06-15T10:30 Europe/Paris", "", "x2020-06-15", "2020-06-15\n", "2020-06-15T10:30\n", "14:30\n", "\n14:30"]


def test_dates_in_columns_are_those_of_the_driver(spark):
    df = spark.createDataFrame([(t,) for t in DATES], "t string")
    for domain in ("instant", "time"):
        got = [r[0] for r in df.select(temporal.iso_column(F.col("t"), domain)).collect()]
        assert got == [p.millis if (p := temporal.parse_iso(t)) and p.domain == domain else None for t in DATES]
    layout = df.select(temporal.text_column(F.col("t"), "instant", ("YYYY-MM-DD",))).collect()
    assert [r[0] for r in layout] == [p.millis if (p := winnow.resolve_temporal(t, ("YYYY-MM-DD",))) and p.domain == "instant" else None for t in DATES]
    assert temporal.parse_iso("2020-06-15T10:30+05").millis == temporal.parse_iso("2020-06-15T05:30").millis
    assert winnow.resolve_temporal("31-12-2020", ("DD-MM-YYYY",)).millis == temporal.parse_iso("2020-12-31").millis


# A differential test against a plain evaluator


def _evaluate(node, row, field=None, exact=False):
    """The meaning of a query on one row of text, whole numbers and lists, said once more and plainly."""
    from winnow.plans import tree as T

    match node:
        case T.Logical():
            parts = [_evaluate(n, row, field, exact) for n in (node.left, node.right)]
            return all(parts) if node.operator == "AND" else any(parts)
        case T.Unary():
            return not _evaluate(node.operand, row, field, exact)
        case T.Group():
            return _evaluate(node.expression, row, field, exact)
        case T.Tag() if isinstance(node.expression, T.Group):
            return _evaluate(node.expression, row, node.field, node.case_sensitive)
        case T.Tag():
            return _clause(node.expression, row, winnow.field_name(node.field), node.operator, node.case_sensitive)
    return _clause(node, row, winnow.field_name(field) if field else None, ":", exact)


def _clause(node, row, name, operator, exact):
    from winnow.plans import tree as T

    if isinstance(node, T.Range) and name is None:
        return False
    values = [row[name]] if name else list(row.values())
    null_list = any(v is None for v in values)
    flat = [x for v in values for x in (v if isinstance(v, list) else [v])]
    fold = (lambda s: s) if exact else str.lower

    def one(v):
        if isinstance(node, T.Literal) and node.value is None:
            return v is None
        number = node.value if isinstance(node, T.Literal) and isinstance(node.value, int) else numbers.parse_number(node.value) if isinstance(node, T.Literal) and not node.quoted and isinstance(node.value, str) else None
        if isinstance(node, T.Range):
            bounds = [None if x.value is None else numbers.parse_number(x.value.value) for x in (node.lower, node.upper)]
            own = v if isinstance(v, int) else numbers.parse_number(v) if isinstance(v, str) else None
            if own is None:
                return False
            low = bounds[0] is None or own > bounds[0] or node.lower.inclusive and own == bounds[0]
            return low and (bounds[1] is None or own < bounds[1] or node.upper.inclusive and own == bounds[1])
        if number is not None:
            own = v if isinstance(v, int) else numbers.parse_number(v) if isinstance(v, str) else None
            return own is not None and {":": own == number, ":=": own == number, ":>": own > number, ":>=": own >= number, ":<": own < number, ":<=": own <= number}[operator]
        if not isinstance(v, str):
            return False
        if isinstance(node, T.Wildcard):
            body = "".join(".*" if p is T.Glob.ANY else "." if p is T.Glob.ONE else re.escape(fold(p)) for p in node.pattern)
            return re.fullmatch(body, fold(v), re.DOTALL) is not None
        return node.value.lower() in v.lower() if name is None else fold(v) == fold(node.value)

    return any(map(one, flat)) or isinstance(node, T.Literal) and node.value is None and null_list


def test_random_queries_on_random_rows(spark):
    rng = random.Random(17)
    word = lambda: rng.choice(["ab", "Ab", "abc", "b", "7", "07", "-3", "7.0", "a*b", "", "ba ab", "aab"])
    rows = [{"s": rng.choice([None, word()]), "n": rng.choice([None, -3, 0, 7, 70]), "l": rng.choice([None, [], [word()], [word(), None, word()]])} for _ in range(60)]
    df = spark.createDataFrame([(i, r["s"], r["n"], r["l"]) for i, r in enumerate(rows)], "id int, s string, n long, l array<string>").cache()
    value = lambda: rng.choice(["ab", "AB", "a*", "*b", "a?b", "?", "*a*b*", "7", "-3", "null", '"7"', "b", "*", "?b*", "ab*b"])

    def query(depth):
        if depth == 0 or rng.random() < 0.3:
            f = rng.choice(["s", "n", "l", "s:", "l:"])
            return rng.choice([f"{f}:{value()}", f"{f}:{value()}", f"{f}:{rng.choice(['>', '>=', '<', '<=', '='])}{rng.choice(['7', '-3', '0'])}", f"{f}:[{rng.choice(['-3', '*', '0'])} TO {rng.choice(['7', '70'])}}}", f"{f}:({value()} OR NOT {value()})", rng.choice(["ab", "7", "b*", '"a"', "null"])])
        return rng.choice(["({0}) AND ({1})", "({0}) OR ({1})", "NOT ({0})", "({0}) -({1})", "({0}) ({1})"]).format(query(depth - 1), query(depth - 1))

    checked = 0
    for _ in range(70):
        text = query(2)
        tree = winnow.parse(text)
        want = [i for i, r in enumerate(rows) if _evaluate(tree, {"id": i, **r})]
        assert ids(df, text) == want, text
        checked += 0 < len(want) < len(rows)
    assert checked > 25


# Plans


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_are_narrow_and_pushed_down(spark, data):
    lines = spark.read.parquet(f"{data}/lineitem.parquet")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = _plan(Engine().filter("l_shipdate:>=1995-01-01 l_quantity:[1 TO 5} l_returnflag::R NOT l_linestatus::O", lines).select("l_orderkey"))
    assert "Exchange" not in plan and "Python" not in plan and "l_comment" not in plan
    for pushed in ("GreaterThanOrEqual(l_shipdate,1995-01-01", "GreaterThanOrEqual(l_quantity,1.0)", "LessThan(l_quantity,5.0)", "EqualTo(l_returnflag,R)"):
        assert pushed in plan, plan
    schema = re.search(r"ReadSchema: struct<([^>]*)>", plan)[1]
    assert set(re.findall(r"(\w+):", schema)) == {"l_orderkey", "l_shipdate", "l_quantity", "l_returnflag", "l_linestatus"}
    assert "l_partkey" not in schema


def test_python_only_where_it_must_be(spark, data):
    parts = spark.read.parquet(f"{data}/part.parquet")
    for query in ("p_name:*a*e*", "p_name:re*", "p_name:/red/", "p_name:????", "red", "p_name:(a OR b)", "NOT p_size:>5"):
        assert "Python" not in _plan(Engine().filter(query, parts)), query
    assert "ArrowEvalPython" in _plan(Engine().filter("p_name:/r.d/", parts)) and "ArrowEvalPython" in _plan(Engine().filter("p_name:r?d*", parts))
    impossible = Engine().filter("p_size:/5/ OR p_name:true OR nosuch:x", parts)
    assert "LocalTableScan <empty>" in _plan(impossible) or "false" in _plan(impossible)
    assert "IN (" in _plan(Engine().filter("p_brand:a OR p_brand:b OR p_brand:c", parts)) or "INSET" in _plan(Engine().filter("p_brand:a OR p_brand:b OR p_brand:c", parts))


def test_long_queries_compile(spark, data):
    parts = spark.read.parquet(f"{data}/part.parquet")
    assert Engine().filter(" OR ".join(f"p_size:{i}" for i in range(300)), parts).count() == parts.count()
    assert Engine().filter(" ".join("NOT p_name:x*y" for _ in range(150)), parts).count() == parts.count()


def test_streams_are_filtered_as_tables_are(spark, data):
    from winnow.operators.queries import queries

    got = queries()["stream_filter"](spark, data).collect()
    want = Engine().filter("event_type:*c* value:>50", spark.read.parquet(f"{data}/events.parquet")).select("event_id", "value").collect()
    assert sorted(got) == sorted(want) and got
