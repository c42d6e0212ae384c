"""Values, errors and rejected expressions of the language."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tidewright.functions.library import java_pattern, java_replacement
from tidewright.functions.registry import REGISTRY, register
from tidewright.plans import types as T
from tidewright.plans.compiler import CheckFault, SyntaxFault, Value, compile_expression

ERROR = object()
ROW = """select 'a.b' s, '  John.Doe@Example.COM  ' email, 5L n, 2.5D d, true b, timestamp'2024-06-15 14:30:45' ts, array(3L,1L,2L) li, array(2.5D,1.5D) ld,
 array(29.99D,49.99D,19.99D,99.99D) prices, array(2L,1L,3L,1L) quantities, array(named_struct('price',10.25D,'qty',1L),named_struct('price',15.5D,'qty',2L),named_struct('price',25.5D,'qty',3L)) items,
 array(named_struct('pricing',named_struct('total',100.0D)),named_struct('pricing',named_struct('total',350.0D))) orders, map('k','v') m, cast(null as string) nul, array('x','y') ls,
 cast(array() as array<bigint>) em, cast(array() as array<double>) emd, cast(array() as array<struct<price:double,qty:bigint>>) noitems, array(double('NaN'), 1.0D) nan1, array(1.0D, double('NaN')) nan2,
 named_struct('name','Ann','age',30L,'address',named_struct('city','NYC','geo',named_struct('lat',40.7128D,'lng',-74.006D))) customer, cast(null as array<string>) nolist, array('x',null) nl"""

CASES = [
    # temporal
    ("year(event.ts)", 2024), ("month(event.ts)", 6), ("day(event.ts)", 15), ("hour(event.ts)", 14), ("minute(event.ts)", 30), ("second(event.ts)", 45), ("dayOfWeek(event.ts)", 6), ("dayOfYear(event.ts)", 167), ("weekOfYear(event.ts)", 24),
    ("date(event.ts)", "2024-06-15"), ('date(event.ts) + "/hour=" + string(hour(event.ts))', "2024-06-15/hour=14"), ("epochMillis(event.ts)", 1718461845000), ("fromEpochMillis(1718461845000) == event.ts", True),
    ('parseTimestamp("2024-01-02 03:04:05", "2006-01-02 15:04:05")', dt.datetime(2024, 1, 2, 3, 4, 5)), ('parseTimestamp("02/Jan/2024", "02/Jan/2006")', dt.datetime(2024, 1, 2)), ('parseTimestamp("bad", "2006-01-02")', ERROR),
    ('parseTimestamp("2024-06-15T14:30:45Z", "2006-01-02T15:04:05Z07:00") == event.ts', True),
    # strings
    ('lower("ABC")', "abc"), ('upper("abc")', "ABC"), ("trim(event.email)", "John.Doe@Example.COM"), ('trim("\\t a \\n")', "a"), ('trim("\\u00a0x\\u2003")', "x"), ('trimPrefix("xxab", "x")', "xab"), ('trimSuffix("abxx", "x")', "abx"), ('trimSuffix("ab", "q")', "ab"),
    ('replace("a.b.c", ".", "-")', "a-b-c"), ('replace("abc", "", "-")', "-a-b-c-"), ('split(event.s, ".")', ["a", "b"]), ('split("abc", "")', ["a", "b", "c"]), ('split("", ",")', [""]), ('join(event.ls, "-")', "x-y"), ('join(event.nl, "-")', ERROR),
    ('substr("hello", 1, 3)', "ell"), ('substr("hello", -2, 2)', "he"), ('substr("hello", 3, 99)', "lo"), ('substr("hello", 9, 2)', ""), ('substr("hello", 0, -1)', ERROR),
    ('padLeft("12345", 3, "0")', "345"), ('padLeft("1", 4, "ab")', "bab1"), ('padLeft("7", 3, "0")', "007"), ('padLeft("7", 3, "")', "7"), ('padRight("1", 4, "ab")', "1aba"), ('padRight("12345", 3, "0")', "123"), ('padRight("7", 3, "")', "7"),
    ('regexMatch("abc", "b+")', True), ('regexMatch("abc", "[")', ERROR), ('regexReplace("+1 (555) 123-4567", "[^0-9]", "")', "15551234567"), ('regexReplace("ab", "(a)(b)", "${2}$1")', "ba"), ('regexReplace("ab", "(a)", "$1x")', "b"), ('regexReplace("ab", "(?P<q>a)", "[$q]")', "[a]b"),
    ('mask("4111111111111111", 4, 4)', "4111********1111"), ('mask("abc", 2, 2)', "abc"), ('mask("abcd", -1, 1)', "***d"), ('truncate("hello world", 8)', "hello..."), ('truncate("hello", 2)', "he"), ('truncate("hi", 5)', "hi"), ('truncate("hello", 0)', ""),
    ('extractDomain("a@b@c.de")', "c.de"), ('extractDomain("none")', ""), ("extractDomain(lower(trim(event.email)))", "example.com"), ("upper(event.nul)", ERROR),
    # hashes
    ('xxhash("usr_12345")', "a81a7b2d595168a1"), ('xxhash("john.doe@example.com")', "7ea731dc1cc36e63"), ('sha256(lower(trim(event.email))).startsWith("836f82db99121b34")', True),
    # lists
    ("sum(event.quantities)", 7), ("sumDouble(event.prices)", 199.95999999999998), ("avgDouble(event.prices)", 49.989999999999995), ("avg(event.li)", 2.0), ("min(event.li)", 1), ("max(event.li)", 3), ("minDouble(event.ld)", 1.5), ("maxDouble(event.ld)", 2.5),
    ("sum(event.em)", 0), ("sumDouble(event.emd)", 0.0), ("min(event.em)", ERROR), ("max(event.em)", ERROR), ("minDouble(event.emd)", ERROR), ("avg(event.em)", math.nan), ("avgDouble(event.emd)", math.nan), ("first(event.em)", None), ("last(event.em)", None),
    ("first(event.li)", 3), ("last(event.li)", 2), ("flatten([[1, 2], [3]])", [1, 2, 3]), ('sumBy(event.items, "price")', 51.25), ('avgBy(event.items, "price")', 17.083333333333332), ('minBy(event.items, "qty")', 1.0), ('maxBy(event.items, "price")', 25.5),
    ('sumBy(event.orders, "pricing.total")', 450.0), ('sumBy(event.orders, "pricing..total")', 450.0), ('sumBy(event.noitems, "price")', 0.0), ('minBy(event.noitems, "price")', 0.0), ('maxBy(event.noitems, "price")', 0.0), ('avgBy(event.noitems, "price")', math.nan),
    ("minDouble(event.nan1)", math.nan), ("maxDouble(event.nan2)", 1.0), ("sum([9223372036854775807, 1])", ERROR), ("sumDouble(event.items.map(i, i.price * double(i.qty)))", 117.75),
    # conversions
    ('toInt("42")', 42), ('toInt("-7")', -7), ('toInt(" 42 ")', ERROR), ('toInt("x")', ERROR), ('toInt("99999999999999999999")', ERROR), ("toInt(3.9)", 3), ("toInt(-3.9)", -3), ("toInt(true)", 1), ('toDouble("1.5")', 1.5), ('toDouble("x")', ERROR), ("toDouble(2)", 2.0),
    ("toString(5)", "5"), ("toString(100.0)", "100"), ("toString(1e21)", "1000000000000000000000"), ("toString(1.5e-7)", "0.00000015"), ("toString(3.14)", "3.14"), ("toString(-2.5e10)", "-25000000000"), ("toString(true)", "true"), ('toBool("T")', True), ('toBool("0")', False), ('toBool("yes")', ERROR), ("toBool(2)", True),
    # nulls
    ('coalesce(event.nul, "USD")', "USD"), ('coalesce3(event.nul, null, "z")', "z"), ("coalesce4(event.nul, event.nul, event.nul, event.s)", "a.b"), ('ifNull(event.s, "d")', "a.b"), ('orDefault(event.nul, "d")', "d"), ("isNull(event.nul)", True), ("isNotNull(event.nul)", False), ('nullIf("a", "a")', None), ('nullIf("a", "b")', "a"), ('coalesce(event.m["z"], "d")', ERROR),
    # operators
    ("1 + 2 * 3", 7), ("7 / 2", 3), ("-7 / 2", -3), ("-7 % 3", -1), ("event.n / 0", ERROR), ("event.n % 0", ERROR), ("9223372036854775807 + 1", ERROR), ("-9223372036854775808 - 1", ERROR), ("1.0 / 0.0", math.inf), ("5u + 2u", 7), ("1u - 2u", ERROR), ("-event.n", -5), ("!event.b", False),
    ('"a" + "b"', "ab"), ("[1] + [2]", [1, 2]), ("event.nul == null", True), ("event.nul != null", False), ('event.nul == "x"', False), ('event.nul != "x"', True), ("event.n >= 5 && event.d < 3.0", True), ('"a" < "b"', True), ("event.nan1[0] == event.nan1[0]", False), ("event.nan1[0] > 1.0", False),
    ("false && event.n / 0 == 1", False), ("event.n / 0 == 1 && false", False), ("true || event.n / 0 == 1", True), ("event.n / 0 == 1 || true", True), ("event.n / 0 == 1 || false", ERROR), ("event.n / 0 == 1 && true", ERROR), ('event.n > 3 ? "big" : "small"', "big"), ("event.b ? 1 : 1 / 0", 1), ("!event.b ? 1 : 1 / 0", ERROR),
    ("event.li[1]", 1), ("event.li[7]", ERROR), ("event.li[-1]", ERROR), ('event.m["k"]', "v"), ('event.m["z"]', ERROR), ("event.m.k", "v"), ('"k" in event.m', True), ("3 in event.li", True), ("9 in event.li", False), ("has(event.nul)", False), ("has(event.s)", True), ("has(event.m.z)", False), ("size(event.li)", 3), ('"é漢".size()', 2), ('size(b"é")', 2), ("size({1: 2})", 1),
    ('event.s.startsWith("a")', True), ('event.s.endsWith("b")', True), ('event.s.contains(".")', True), ('event.s.matches("^a")', True), ("event.customer.address.geo.lat > 40.0 && event.customer.age >= 30", True), ("size(event.nolist)", ERROR),
    ("event.li.map(x, x * 2)", [6, 2, 4]), ("event.li.map(x, x > 1, x + 1)", [4, 3]), ("event.li.filter(x, x > 1)", [3, 2]), ("event.li.all(x, x > 0)", True), ("event.li.exists(x, x == 2)", True), ("event.li.exists_one(x, x > 1)", False), ("event.li.all(x, 6 / (x - 3) > 99)", False), ("event.li.exists(x, 6 / (x - 3) == 99)", ERROR), ("event.m.all(k, k == \"k\")", True), ("[1, 2].map(x, [10, 20].map(y, x * y))", [[10, 20], [20, 40]]), ("event.li.map(x, 6 / (x - 1))", ERROR),
    # standard functions
    ("int(2.9)", 2), ('int("12")', 12), ("int(event.ts)", 1718461845), ("uint(3)", 3), ("uint(-1)", ERROR), ("double(2)", 2.0), ('double("x")', ERROR), ("string(2.5)", "2.5"), ("string(event.ts)", "2024-06-15T14:30:45Z"), ('bytes("ab")', b"ab"), ('string(b"ab")', "ab"), ('bool("true")', True),
    ('timestamp("2024-06-15T14:30:45Z") == event.ts', True), ('timestamp("nope")', ERROR), ('event.ts + duration("1h30m")', dt.datetime(2024, 6, 15, 16, 0, 45)), ('duration("90s") > duration("1m")', True), ('event.ts - timestamp("2024-06-15T14:30:00Z") == duration("45s")', True), ('duration("soon")', ERROR), ('duration("90m").getHours()', 1),
    ("event.ts.getFullYear()", 2024), ("event.ts.getMonth()", 5), ("event.ts.getDate()", 15), ("event.ts.getDayOfMonth()", 14), ("event.ts.getDayOfWeek()", 6), ("event.ts.getDayOfYear()", 166), ("event.ts.getHours()", 14), ('event.ts.getHours("America/New_York")', 10), ("event.ts.getMilliseconds()", 0), ("type(event.n)", "int"), ("dyn(event.n) == 5", True),
]

REJECTED = [
    "event.missing", "event.customer.zip", "event.n + 1.0", 'event.n == "5"', "event.d > 1", "upper(event.n)", "event.s + 1", "nope(1)", "event.s.nope()", "unknown", "event.n && true", "!event.n", "event.li[\"a\"]", "event.n[0]", '[1, "a"]', "event.b ? 1 : \"a\"", "upper(null)", "has(event)", "1 +", "(1", "'a", "a b", "Msg{a: 1}", "event.li.map(1, 2)", "size(1)", 'sumBy(event.items, "nope")', "for", "", "event.s < 1",
]


@pytest.fixture(scope="module")
def results(spark):
    df = spark.sql(ROW)
    scope = {"event": Value(F.struct(*[F.col(c) for c in df.columns]), T.from_spark(df.schema, "event"), None, False)}
    out = {}
    for a in range(0, len(CASES), 60):
        cells = []
        for i, (source, _) in enumerate(CASES[a : a + 60]):
            v = compile_expression(source, scope)
            cells += [v.col.alias(f"v{i}"), (v.err if v.err is not None else F.lit(None).cast("string")).alias(f"e{i}")]
        row = df.select(*cells).first()
        out |= {source: (row[f"v{i}"], row[f"e{i}"]) for i, (source, _) in enumerate(CASES[a : a + 60])}
    return out, scope


@pytest.mark.parametrize(("source", "expected"), CASES, ids=[c[0] for c in CASES])
def test_value(results, source, expected):
    value, error = results[0][source]
    if expected is ERROR:
        assert error is not None and value is None
        return
    assert error is None
    value = bytes(value) if isinstance(value, bytearray) else value
    assert (value is not None and math.isnan(value)) if isinstance(expected, float) and math.isnan(expected) else value == expected


@pytest.mark.parametrize("source", REJECTED)
def test_rejected(results, source):
    with pytest.raises((CheckFault, SyntaxFault)):
        compile_expression(source, results[1])


def test_every_function_is_tried():
    names = {n for n in REGISTRY if n[0].isalpha() and n not in ("bucketed",)}
    assert {n for n in names if not any(n in source for source, _ in CASES)} <= {"getMinutes", "getSeconds"}


def test_own_functions(spark):
    register("shout", (T.STRING,), T.STRING, lambda a: F.concat(F.upper(a.col), F.lit("!")))
    df = spark.sql("select 'x' s")
    v = compile_expression("shout(event.s)", {"event": Value(F.struct("s"), T.from_spark(df.schema, "event"), None, False)})
    assert df.select(v.col).first()[0] == "X!"
    del REGISTRY["shout"]


def test_layouts_and_templates():
    assert java_pattern("2006-01-02T15:04:05.000Z07:00") == "yyyy-MM-dd'T'HH:mm:ss.SSSXXX"
    assert java_pattern("Mon, 02 Jan 2006") == "EEE, dd MMM yyyy"
    assert java_replacement("a$1-${2}") == "a$1-$2" and java_replacement("$$") == "\\$"


def _plan_size(spark, source):
    df = spark.range(10).select(F.col("id").alias("a"))
    v = compile_expression(source, {"a": Value(F.col("a"), T.INT)})
    return len(df.select(v.col.alias("v"), v.err.alias("e"))._jdf.queryExecution().analyzed().toString())


@pytest.mark.parametrize("source", ["a", "a * 3 - 1", "-a", "a % 7", "padLeft(toString(a), 3, '0') == 'x' ? a : 1"])
def test_plans_grow_with_the_length_of_an_expression(spark, source):
    """Twenty terms cost ten times two of them or little more, not a power of them."""
    two, twenty = (_plan_size(spark, " + ".join([f"({source})"] * n)) for n in (2, 20))
    assert twenty < 15 * two


def test_nested_functions_stay_bounded(spark):
    nested = "a"
    for _ in range(8):
        nested = f"toInt(padLeft(toString({nested}), 4, '0')) / 3"
    v = compile_expression(nested, {"a": Value(F.col("a"), T.INT)})
    df = spark.range(3).select((F.col("id") * 10_000_000).alias("a"))
    assert [r.v for r in df.select(v.col.alias("v")).collect()][0] == 0
