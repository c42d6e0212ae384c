"""The extension functions: temporal, string, hash, list, conversion and null handling."""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..plans import types as T
from .registry import Arg, register

B, I, D, S, Y, TS, DYN = T.BOOL, T.INT, T.DOUBLE, T.STRING, T.BYTES, T.TIMESTAMP, T.DYN
LIST = T.list_of(DYN)

# ---------------------------------------------------------------- temporal (times are in UTC)

for _name, _part in {
    "year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute, "second": F.second,
    "dayOfWeek": lambda c: F.dayofweek(c) - 1, "dayOfYear": F.dayofyear, "weekOfYear": F.weekofyear,
}.items():
    register(_name, (TS,), I, lambda a, part=_part: part(a.col).cast("long"))
register("date", (TS,), S, lambda a: F.date_format(a.col, "yyyy-MM-dd"))
register("epochMillis", (TS,), I, lambda a: F.unix_millis(a.col))
register("fromEpochMillis", (I,), TS, lambda a: F.timestamp_millis(a.col))

#: Layout elements of reference-time layouts, longest first, and Java's letters for them.
LAYOUT = (
    ("January", "MMMM"), ("Monday", "EEEE"), ("-07:00", "xxx"), ("Z07:00", "XXX"), ("2006", "yyyy"), ("-0700", "xx"), ("Z0700", "XX"), ("Jan", "MMM"), ("Mon", "EEE"), ("MST", "z"),
    ("01", "MM"), ("02", "dd"), ("15", "HH"), ("03", "hh"), ("04", "mm"), ("05", "ss"), ("06", "yy"), ("PM", "a"), ("_2", "d"), ("1", "M"), ("2", "d"), ("3", "h"), ("4", "m"), ("5", "s"),
)


def java_pattern(layout: str) -> str:
    """A reference-time layout (2006-01-02 15:04:05) as a Java date pattern."""
    out, text, at = [], "", 0

    def end_text() -> str:
        """Letters that stand for themselves, quoted together."""
        nonlocal text
        quoted, text = f"'{text}'" if text else "", ""
        return quoted

    while at < len(layout):
        fraction = re.match(r"[.,](?:(0+)|(9+))(?!\d)", layout[at:])
        element = next(((e, letters) for e, letters in LAYOUT if layout.startswith(e, at)), None)
        if fraction:  # nines may be missing
            digits = "S" * (fraction.end() - 1)
            out += [end_text(), layout[at] + digits if fraction[1] else f"[{layout[at]}{digits}]"]
            at += fraction.end()
        elif element:
            out += [end_text(), element[1]]
            at += len(element[0])
        else:
            if layout[at].isalpha():
                text += layout[at]
            else:
                out += [end_text(), "''" if layout[at] == "'" else layout[at]]
            at += 1
    return "".join([*out, end_text()])


def _parse_timestamp(text: Arg, layout: Arg):
    if layout.literal is None:
        raise TypeError("parseTimestamp needs a literal layout")
    value = F.try_to_timestamp(text.col, F.lit(java_pattern(layout.literal)))
    return value, {"cannot parse timestamp": value.isNull()}


register("parseTimestamp", (S, S), TS, _parse_timestamp)

# ---------------------------------------------------------------- strings (lengths in code points)

#: Unicode white space, as a Java character class.
_WHITE = r"[\t\n\x0B\f\r \x85\xA0  -     　]"
register("lower", (S,), S, lambda a: F.lower(a.col))
register("upper", (S,), S, lambda a: F.upper(a.col))
register("trim", (S,), S, lambda a: F.regexp_replace(a.col, f"^{_WHITE}+|{_WHITE}+$", ""))
register("trimPrefix", (S, S), S, lambda a, p: F.when(F.startswith(a.col, p.col), F.substring(a.col, F.length(p.col) + 1, F.length(a.col))).otherwise(a.col))
register("trimSuffix", (S, S), S, lambda a, p: F.when(F.endswith(a.col, p.col), F.substring(a.col, F.lit(1), F.length(a.col) - F.length(p.col))).otherwise(a.col))


def _replace(a: Arg, old: Arg, new: Arg) -> Column:
    between = F.concat(new.col, F.regexp_replace(a.col, "(?s)(.)", F.concat(F.lit("$1"), F.regexp_replace(new.col, r"([\\$])", r"\\$1"))))
    return F.when(F.length(old.col) == 0, between).otherwise(F.replace(a.col, old.col, new.col))


register("replace", (S, S, S), S, _replace)


def _split(a: Arg, sep: Arg) -> Column:
    # A quoted pattern; the separator's own end of a quotation is quoted apart.
    quoted = F.concat(F.lit("\\Q"), F.replace(sep.col, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    letters = F.when(F.length(a.col) == 0, F.array().cast("array<string>")).otherwise(F.regexp_extract_all(a.col, F.lit("(?s)(.)"), F.lit(1)))
    return F.when(F.length(sep.col) == 0, letters).otherwise(F.split(a.col, quoted, -1))


register("split", (S, S), T.list_of(S), _split)
register("join", (T.list_of(S), S), S, lambda a, sep: (F.array_join(a.col, sep.col) if sep.literal is None else F.array_join(a.col, sep.literal), {"null list element": F.exists(a.col, lambda x: x.isNull())}))


def _substr(a: Arg, start: Arg, size: Arg):
    n = F.length(a.col)
    first = F.least(F.greatest(start.col, F.lit(0)), n).cast("int")
    return F.substring(a.col, first + 1, F.least(F.greatest(size.col, F.lit(0)), n - first).cast("int")), {"negative length": size.col < 0}


register("substr", (S, I, I), S, _substr)


def _padding(a: Arg, n: Arg, pad: Arg) -> Column:
    """As much of the repeated padding as reaches the length, or more."""
    missing = F.greatest(n.col - F.length(a.col), F.lit(0))
    return F.when((F.length(pad.col) == 0) | (missing == 0), F.lit("")).otherwise(F.repeat(pad.col, F.ceil(missing / F.greatest(F.length(pad.col), F.lit(1))).cast("int")))


def _pad_left(a: Arg, n: Arg, pad: Arg) -> Column:
    whole = F.concat(_padding(a, n, pad), a.col)
    return F.when(F.length(pad.col) == 0, a.col).when(n.col <= 0, F.lit("")).otherwise(F.right(whole, F.least(n.col, F.length(whole).cast("long")).cast("int")))


def _pad_right(a: Arg, n: Arg, pad: Arg) -> Column:
    return F.when(F.length(pad.col) == 0, a.col).when(n.col <= 0, F.lit("")).otherwise(F.left(F.concat(a.col, _padding(a, n, pad)), n.col.cast("int")))


register("padLeft", (S, I, S), S, _pad_left)
register("padRight", (S, I, S), S, _pad_right)


def java_regex_fault(pattern: str) -> str | None:
    """Why the JVM won't take a pattern; None if it does."""
    spark = SparkSession.getActiveSession()
    try:
        if spark is None:
            re.compile(pattern)
        else:
            spark.sparkContext._jvm.java.util.regex.Pattern.compile(pattern)
    except Exception as e:  # noqa: BLE001  a fault of the pattern is data
        return str(e).splitlines()[0]
    return None


def _pattern(arg: Arg, what: str) -> tuple[str, bool]:
    if arg.literal is None:
        raise TypeError(f"{what} needs a literal pattern")
    pattern = arg.literal.replace("(?P<", "(?<")
    good = java_regex_fault(pattern) is None
    return (pattern if good else "x"), good


def _matches(a: Arg, pattern: Arg):
    p, good = _pattern(pattern, "a match")
    return a.col.rlike(p), {} if good else {"invalid pattern": F.lit(True)}


register("regexMatch", (S, S), B, _matches)


def java_replacement(template: str) -> str:
    """``$1``, ``${1}`` and ``$name`` of the language as Java writes them; a name takes all letters it can."""
    out, at = [], 0
    for m in re.finditer(r"\$(?:(\$)|\{(\w+)\}|(\w+))|([\\$])", template):
        out.append(template[at : m.start()])
        at = m.end()
        name = m[2] or m[3]
        if m[1] or m[4]:
            out.append("\\$" if m[1] or m[4] == "$" else "\\\\")
        elif name.isdigit():
            out.append(f"${{__{int(name)}}}")
        else:
            out.append(f"${{{name}}}")
    out.append(template[at:])
    # A digit after a numbered group would be read as part of the number.
    whole = re.sub(r"\$\{__(\d+)\}(?=\d)", lambda m: f"${m[1]}\\\\", "".join(out))
    return re.sub(r"\$\{__(\d+)\}", r"$\1", whole)


def _regex_replace(a: Arg, pattern: Arg, new: Arg):
    p, good = _pattern(pattern, "regexReplace")
    if new.literal is None:
        raise TypeError("regexReplace needs a literal replacement")
    groups = re.compile(r"\$(?:\{(\w+)\}|(\w+))")
    known = set(re.findall(r"\(\?<(\w+)>", p)) | {str(i) for i in range(p.count("(") - p.count("\\(") - p.count("(?:") + 1)}
    template = groups.sub(lambda m: m[0] if (m[1] or m[2]) in known else "", new.literal)  # unknown groups are empty
    return F.regexp_replace(a.col, p, java_replacement(template)), {} if good else {"invalid pattern": F.lit(True)}


register("regexReplace", (S, S, S), S, _regex_replace)


def _mask(a: Arg, first: Arg, last: Arg) -> Column:
    n, f, l = F.length(a.col), F.greatest(first.col, F.lit(0)).cast("int"), F.greatest(last.col, F.lit(0)).cast("int")
    hidden = F.concat(F.left(a.col, f), F.repeat(F.lit("*"), n - f - l), F.substring(a.col, n - l + 1, l))
    return F.when(f + l >= n, a.col).otherwise(hidden)


register("mask", (S, I, I), S, _mask)


def _truncate(a: Arg, most: Arg) -> Column:
    m = most.col.cast("int")
    return F.when(m <= 0, F.lit("")).when(F.length(a.col) <= m, a.col).when(m <= 3, F.left(a.col, m)).otherwise(F.concat(F.left(a.col, m - 3), F.lit("...")))


register("truncate", (S, I), S, _truncate)
register("extractDomain", (S,), S, lambda a: F.when(F.contains(a.col, F.lit("@")), F.substring_index(a.col, "@", -1)).otherwise(F.lit("")))

# ---------------------------------------------------------------- hashes

#: A long whose hash with Spark's own seed is 0, so that the hash of what follows it has the seed 0.
SEED_ZERO_64 = -365884300664092260
register("xxhash", (S,), S, lambda a: F.lower(F.hex(F.xxhash64(F.lit(SEED_ZERO_64), a.col))))
register("sha256", (S,), S, lambda a: F.sha2(a.col, 256))

# ---------------------------------------------------------------- lists (folds of one row's list)


def _folded(element: T.Type, empty_is_error: bool, fold):
    def build(a: Arg):
        c = a.col.cast("array<bigint>" if element == I else "array<double>")
        errors = {"null list element": F.exists(c, lambda x: x.isNull())}
        if empty_is_error:
            errors["empty list"] = F.size(c) == 0
        return fold(c), errors

    return build


def _sum(c: Column, zero) -> Column:
    return F.aggregate(c, F.lit(zero), lambda a, x: a + x)


def _long_sum(c: Column) -> Column:
    """Null where it leaves 64 bits, which is then reported."""
    return F.aggregate(c, F.lit(0).cast("decimal(38,0)"), lambda a, x: (a + x).cast("decimal(38,0)")).try_cast("bigint")


def _mean(c: Column, total: Column) -> Column:
    return F.when(F.size(c) == 0, F.lit(float("nan"))).otherwise(total / F.size(c))


def _extreme(less: bool):
    """The first element, replaced by each later one that compares beyond it; comparisons with NaN are false."""

    def fold(c: Column) -> Column:
        beyond = lambda a, x: (x < a if less else x > a) & ~F.isnan(x) & ~F.isnan(a)
        return F.aggregate(F.slice(c, 2, F.greatest(F.size(c), F.lit(1))), F.get(c, F.lit(0)), lambda a, x: F.when(beyond(a, x), x).otherwise(a))

    return fold


def _int_sum(a: Arg):
    c = a.col.cast("array<bigint>")
    return F.coalesce(_long_sum(c), F.lit(0).cast("long")), {"null list element": F.exists(c, lambda x: x.isNull()), "integer overflow": _long_sum(c).isNull()}


LI, LD = T.list_of(I), T.list_of(D)
register("sum", (LI,), I, _int_sum)
register("sumDouble", (LD,), D, _folded(D, False, lambda c: _sum(c, 0.0)))
register("min", (LI,), I, _folded(I, True, F.array_min))
register("max", (LI,), I, _folded(I, True, F.array_max))
register("minDouble", (LD,), D, _folded(D, True, _extreme(True)))
register("maxDouble", (LD,), D, _folded(D, True, _extreme(False)))
register("avg", (LI,), D, _folded(I, False, lambda c: _mean(c, F.aggregate(c, F.lit(0.0), lambda a, x: a + x.cast("double")))))
register("avgDouble", (LD,), D, _folded(D, False, lambda c: _mean(c, _sum(c, 0.0))))


def _element(given: list[T.Type]) -> T.Type:
    t = T.carrier(given[0])
    return T.dyn_of(t.args[0] if t.kind == "list" else None)


register("first", (LIST,), _element, lambda a: F.get(a.col, F.lit(0)))
register("last", (LIST,), _element, lambda a: F.try_element_at(a.col, F.lit(-1)))
register("flatten", (T.list_of(LIST),), lambda given: T.carrier(T.carrier(given[0]).args[0]), lambda a: F.flatten(a.col))


def _by_field(fold):
    def build(a: Arg, path: Arg):
        if path.literal is None:
            raise TypeError("a field path must be a literal")
        t = T.carrier(T.carrier(a.type).args[0]) if T.carrier(a.type).kind == "list" else DYN
        steps = [p for p in path.literal.split(".") if p]

        def value(x: Column) -> Column:
            kind, out = t, x
            for p in steps:
                kind = T.carrier(kind)
                if kind.kind == "object":
                    if kind.field_type(p) is None:
                        raise TypeError(f"no field {p!r} in {kind}")
                    kind, out = kind.field_type(p), out.getField(p)
                elif kind.kind == "map":
                    kind, out = kind.args[1], F.try_element_at(out, F.lit(p))
                else:
                    raise TypeError(f"{p!r} is not a field of {kind}")
            if T.carrier(kind).kind not in ("int", "double"):
                raise TypeError(f"{path.literal!r} is not a number")
            return out.cast("double")

        c = F.transform(a.col, value)
        return fold(c), {"missing or non-numeric field": F.exists(c, lambda x: x.isNull())}

    return build


register("sumBy", (LIST, S), D, _by_field(lambda c: _sum(c, 0.0)))
register("avgBy", (LIST, S), D, _by_field(lambda c: _mean(c, _sum(c, 0.0))))
register("minBy", (LIST, S), D, _by_field(lambda c: F.coalesce(_extreme(True)(c), F.lit(0.0))))
register("maxBy", (LIST, S), D, _by_field(lambda c: F.coalesce(_extreme(False)(c), F.lit(0.0))))

# ---------------------------------------------------------------- conversions


def _checked(value: Column, message: str):
    return value, {message: value.isNull()}


register("toInt", (S,), I, lambda a: _checked(F.when(a.col.rlike(r"^[+-]?[0-9]+\z"), a.col.try_cast("bigint")), "not an integer"))
register("toInt", (D,), I, lambda a: _checked(F.when(~F.isnan(a.col), a.col.try_cast("bigint")), "not an integer"))
register("toInt", (B,), I, lambda a: a.col.cast("bigint"))
#: Spellings of numbers that are accepted, besides the words for infinity and NaN.
_DOUBLE = r"^(?i)[+-]?(?:[0-9]+\.?[0-9]*(?:e[+-]?[0-9]+)?|\.[0-9]+(?:e[+-]?[0-9]+)?|inf|infinity|nan)\z"
register("toDouble", (S,), D, lambda a: _checked(F.when(a.col.rlike(_DOUBLE), a.col.try_cast("double")), "not a number"))
register("toDouble", (I,), D, lambda a: a.col.cast("double"))


def fixed_notation(c: Column) -> Column:
    """The shortest digits of a double that read back as it, without an exponent."""
    plain = c.cast("string")
    mantissa, exponent = F.substring_index(plain, "E", 1), F.substring_index(plain, "E", -1)
    power = F.when(F.contains(plain, F.lit("E")), exponent.try_cast("int")).otherwise(F.lit(0))
    sign = F.when(F.startswith(plain, F.lit("-")), F.lit("-")).otherwise(F.lit(""))
    whole = F.regexp_replace(F.substring_index(mantissa, ".", 1), "^-", "")
    part = F.regexp_replace(F.substring_index(mantissa, ".", -1), "0+$", "")
    digits = F.concat(whole, part)
    point = F.length(whole) + power  # digits before the point
    large = F.when(F.length(digits) <= point, F.rpad(digits, F.greatest(point, F.lit(1)), F.lit("0"))).otherwise(F.concat(F.substring(digits, F.lit(1), point), F.lit("."), F.substring(digits, point + 1, F.length(digits))))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), F.greatest(-point, F.lit(0))), digits)
    with_exponent = F.concat(sign, F.when(point > 0, large).otherwise(small))
    named = F.when(F.isnan(c), F.lit("NaN")).when(c == float("inf"), F.lit("+Inf")).when(c == float("-inf"), F.lit("-Inf"))
    return named.when(F.contains(plain, F.lit("E")), with_exponent).otherwise(F.regexp_replace(plain, r"\.0$", ""))


register("toString", (I,), S, lambda a: a.col.cast("string"))
register("toString", (D,), S, lambda a: fixed_notation(a.col))
register("toString", (B,), S, lambda a: a.col.cast("string"))
register("toBool", (S,), B, lambda a: _checked(F.when(a.col.isin("1", "t", "T", "TRUE", "true", "True"), True).when(a.col.isin("0", "f", "F", "FALSE", "false", "False"), False), "not a boolean"))
register("toBool", (I,), B, lambda a: a.col != 0)

# ---------------------------------------------------------------- nulls (the only functions that accept them)


def _common(given: list[T.Type]) -> T.Type:
    """dyn that holds the one type of all arguments."""
    kinds = [T.carrier(t) for t in given if T.carrier(t).kind not in ("null", "dyn")]
    for t in kinds[1:]:
        if t != kinds[0]:
            raise TypeError(f"arguments of different types: {kinds[0]} and {t}")
    return T.dyn_of(kinds[0] if kinds else None)


for _name, _n in {"coalesce": 2, "coalesce3": 3, "coalesce4": 4, "ifNull": 2, "orDefault": 2}.items():
    register(_name, (DYN,) * _n, _common, lambda *args: F.coalesce(*[a.col for a in args]), strict=False)
register("isNull", (DYN,), T.dyn_of(B), lambda a: a.col.isNull(), strict=False)
register("isNotNull", (DYN,), T.dyn_of(B), lambda a: a.col.isNotNull(), strict=False)
register("nullIf", (DYN, DYN), lambda given: T.dyn_of(T.carrier(given[0])), lambda a, b: F.when(a.col.eqNullSafe(b.col), F.lit(None)).otherwise(a.col), strict=False)
