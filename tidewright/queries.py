"""The engine's queries over the test tables, each with the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S

from .operators import lifecycle, partitioning
from .plans.config import from_dict
from .plans.pipeline import Pipeline, compile_pipeline, counters, scope_of_frame
from .sources import avro, log_store, sink
from .sources.decode import json_event
from .sources.schemas import map_json

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pipeline_over(df: DataFrame, columns: dict[str, str | tuple[str, str]], validate=(), where: str | None = None, partitions=(), sort=()) -> Pipeline:
    """A pipeline whose event is a row of ``df``; a column's value is an expression, or one and its output type."""
    specs = [{"name": n, "expr": e if isinstance(e, str) else e[0], "field_id": i, "as": None if isinstance(e, str) else e[1]} for i, (n, e) in enumerate(columns.items(), 1)]
    return compile_pipeline(from_dict({"columns": specs, "validate": list(validate), "filter": where, "partition_spec": list(partitions), "sort_order": list(sort)}), scope_of_frame(df))


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def projection(name: str, table: str, columns: dict, sql: str, prepare=None, as_text: tuple[str, ...] = (), **more) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = _table(spark, sf_dir, table)
        df = prepare(df) if prepare else df
        out = pipeline_over(df, columns, **more).ok_rows(df)
        return out.withColumns({c: F.col(c).cast("string") for c in as_text}) if as_text else out

    run.__name__ = name
    query(sql)(run)


_EVENT_COLUMNS = {"event_id": "event.event_id", "kind": "upper(event.event_type)", "dt": "date(event.ts)", "amount": "event.value * 100.0"}
_DAY = [{"source_id": 3, "field_id": 1000, "transform": "day", "name": "day"}]
_BY_ID = [{"source_id": 1, "direction": "asc", "null_order": "nulls-first"}]


@query("SELECT event_id, upper(event_type) AS kind, strftime(ts, '%Y-%m-%d') AS dt, value * 100.0 AS amount FROM events WHERE value >= 0.0 AND event_type <> 'view'")
def pipeline_ok(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _table(spark, sf_dir, "events")
    return pipeline_over(df, _EVENT_COLUMNS, ["event.value >= 0.0"], 'event.event_type != "view"', _DAY, _BY_ID).ok_rows(df)


_RULES = ["event.value >= 10.0", "event.user_id % 7 != 0"]


@query("""
    SELECT count(*) FILTER (s = 'ok') AS ok, count(*) FILTER (s = 'filtered') AS filtered, count(*) FILTER (s = 'rejected') AS rejected, count(*) FILTER (s = 'error') AS error,
           count(*) AS total, count(*) FILTER (s IN ('rejected', 'error')) > 0 AS has_errors
    FROM (SELECT CASE WHEN NOT value >= 10.0 OR user_id % 7 = 0 THEN 'rejected' WHEN event_type = 'view' THEN 'filtered' WHEN event_id % 5 = 0 THEN 'error' ELSE 'ok' END AS s FROM events)
""")
def pipeline_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _table(spark, sf_dir, "events")
    return counters(pipeline_over(df, {"x": "100 / (event.event_id % 5)"}, _RULES, 'event.event_type != "view"').classify(df))


@query("""
    SELECT o_orderkey, CASE WHEN NOT o_totalprice > 1000.0 OR NOT o_orderstatus <> 'P' THEN 'rejected' WHEN o_orderkey % 3 = 0 THEN 'filtered' ELSE 'ok' END AS _status,
           CASE WHEN NOT o_totalprice > 1000.0 THEN 'validate[0]' WHEN NOT o_orderstatus <> 'P' THEN 'validate[1]' WHEN o_orderkey % 3 = 0 THEN 'filter' END AS _location,
           CASE WHEN o_totalprice > 1000.0 AND o_orderstatus <> 'P' AND o_orderkey % 3 <> 0 THEN o_orderkey::VARCHAR END AS id
    FROM orders
""")
def validate_first_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _table(spark, sf_dir, "orders")
    return pipeline_over(df, {"id": ("event.o_orderkey", "string")}, ["event.o_totalprice > 1000.0", 'event.o_orderstatus != "P"'], "event.o_orderkey % 3 != 0").classify(df, keep=("o_orderkey",)).drop("_error")


projection("project_as_types", "lineitem", {"k": ("event.l_orderkey", "string"), "line": ("event.l_linenumber", "int"), "price": ("event.l_extendedprice", "decimal(12,2)"), "qty": ("event.l_quantity", "long"), "ship": ("event.l_shipdate", "date"), "flag": "event.l_returnflag", "big": "event.l_quantity > 25.0"},
           "SELECT l_orderkey::VARCHAR AS k, l_linenumber AS line, l_extendedprice::DECIMAL(12,2) AS price, l_quantity::BIGINT AS qty, l_shipdate::DATE::VARCHAR AS ship, l_returnflag AS flag, l_quantity > 25.0 AS big FROM lineitem", as_text=("ship",))
projection("temporal_parts", "events", {"event_id": "event.event_id", "y": "year(event.ts)", "mo": "month(event.ts)", "d": "day(event.ts)", "h": "hour(event.ts)", "mi": "minute(event.ts)", "s": "second(event.ts)", "dow": "dayOfWeek(event.ts)", "doy": "dayOfYear(event.ts)", "w": "weekOfYear(event.ts)", "dt": "date(event.ts)", "ms": "epochMillis(event.ts)", "back": "date(fromEpochMillis(epochMillis(event.ts)))", "parsed": 'epochMillis(parseTimestamp(date(event.ts) + " 01:02:03", "2006-01-02 15:04:05"))'},
           "SELECT event_id, year(ts) AS y, month(ts) AS mo, day(ts) AS d, hour(ts) AS h, minute(ts) AS mi, second(ts) AS s, dayofweek(ts) AS dow, dayofyear(ts) AS doy, weekofyear(ts) AS w, strftime(ts, '%Y-%m-%d') AS dt, epoch_us(ts) // 1000 AS ms, strftime(ts, '%Y-%m-%d') AS back, epoch_ms(date_trunc('day', ts)) + 3723000 AS parsed FROM events")
projection("standard_timestamp_parts", "orders", {"o_orderkey": "event.o_orderkey", "y": "event.o_orderdate.getFullYear()", "mo": "event.o_orderdate.getMonth()", "dom": "event.o_orderdate.getDayOfMonth()", "dt": "event.o_orderdate.getDate()", "doy": "event.o_orderdate.getDayOfYear()", "later": 'int(event.o_orderdate + duration("36h")) - int(event.o_orderdate)', "after": 'event.o_orderdate > timestamp("1995-01-01T00:00:00Z")'},
           "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) - 1 AS mo, day(o_orderdate) - 1 AS dom, day(o_orderdate) AS dt, dayofyear(o_orderdate) - 1 AS doy, 129600 AS later, o_orderdate > TIMESTAMP '1995-01-01' AS after FROM orders")
projection("string_norm", "customer", {"c_custkey": "event.c_custkey", "lo": "lower(event.c_name)", "up": "upper(event.c_mktsegment)", "tr": 'trim("  " + event.c_name + " ")', "tp": 'trimPrefix(event.c_name, "Customer#")', "ts": 'trimSuffix(event.c_mktsegment, "ING")', "rp": 'replace(event.c_name, "0", "o")', "dom": 'extractDomain(event.c_name + "@example.com")', "has": 'event.c_name.contains("1")', "st": 'event.c_mktsegment.startsWith("B")', "n": "size(event.c_name)"},
           "SELECT c_custkey, lower(c_name) AS lo, upper(c_mktsegment) AS up, c_name AS tr, CASE WHEN starts_with(c_name, 'Customer#') THEN substr(c_name, 10) ELSE c_name END AS tp, CASE WHEN ends_with(c_mktsegment, 'ING') THEN left(c_mktsegment, length(c_mktsegment) - 3) ELSE c_mktsegment END AS ts, replace(c_name, '0', 'o') AS rp, 'example.com' AS dom, contains(c_name, '1') AS has, starts_with(c_mktsegment, 'B') AS st, length(c_name) AS n FROM customer")
projection("string_pad_mask", "part", {"p_partkey": "event.p_partkey", "pl": 'padLeft(string(event.p_partkey), 3, "0")', "pr": 'padRight(event.p_brand, 12, "*")', "mk": "mask(event.p_name, 2, 2)", "tc": "truncate(event.p_name, 8)", "sb": "substr(event.p_name, 1, 4)"},
           "SELECT p_partkey, CASE WHEN length(p_partkey::VARCHAR) >= 3 THEN right(p_partkey::VARCHAR, 3) ELSE lpad(p_partkey::VARCHAR, 3, '0') END AS pl, rpad(p_brand, 12, '*') AS pr, CASE WHEN length(p_name) <= 4 THEN p_name ELSE left(p_name, 2) || repeat('*', length(p_name) - 4) || right(p_name, 2) END AS mk, CASE WHEN length(p_name) <= 8 THEN p_name ELSE left(p_name, 5) || '...' END AS tc, substr(p_name, 2, 4) AS sb FROM part")
projection("string_split_join", "pages", {"page_id": "event.page_id", "parts": 'split(event.url, "/")', "n": 'size(split(event.url, "/"))', "again": 'join(split(event.url, "/"), "|")', "deep": 'split(event.url, "/").exists(x, x.matches("^[0-9]+"))', "plain": 'regexReplace(event.url, "[?#].*$", "")', "secure": 'regexMatch(event.url, "^https:")'},
           "SELECT page_id, string_split(url, '/') AS parts, len(string_split(url, '/')) AS n, replace(url, '/', '|') AS again, len(list_filter(string_split(url, '/'), lambda x: regexp_matches(x, '^[0-9]+'))) > 0 AS deep, regexp_replace(url, '[?#].*$', '') AS plain, regexp_matches(url, '^https:') AS secure FROM pages")
projection("hash_sha256", "customer", {"c_custkey": "event.c_custkey", "h": "sha256(event.c_name)"}, "SELECT c_custkey, sha256(c_name) AS h FROM customer")


# Hashes of strings in SQL: shifts that lose bits are products and quotients of wide integers. Characters are bytes here.
_byte = lambda at: f"ord(substr(c_name, ({at})::BIGINT + 1, 1))::UBIGINT"
_times = lambda x, y, bits: f"(({x})::UHUGEINT * {y}::UHUGEINT % {2**bits}::UHUGEINT)"
_turned = lambda x, by, bits: f"({_times(x, 2**by, bits)} + ({x})::UHUGEINT // {2 ** (bits - by)}::UHUGEINT)::UBIGINT"
_plus = lambda x, y, bits: f"((({x})::UHUGEINT + {y}::UHUGEINT) % {2**bits}::UHUGEINT)::UBIGINT"
_number = lambda at, n: "(" + " + ".join(f"{_byte(f'{at} + {j}')}::UHUGEINT * {256**j}" for j in range(n)) + ")"

#: The primes of XXH64.
_PRIMES = (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)


def _xxhash_sql() -> str:
    """XXH64 of names, which are shorter than its stripes of 32 bytes."""
    p1, p2, p3, p4, p5 = _PRIMES
    eight = _times(_turned(_times(_number("8 * i", 8), p2, 64), 31, 64), p1, 64)
    four = _turned(f"xor(h, {_times(_number('n // 8 * 8', 4), p1, 64)}::UBIGINT)", 23, 64)
    return f"""
        WITH a AS (SELECT c_custkey, c_name, length(c_name) AS n FROM customer),
        b AS (SELECT *, list_prepend({_plus("n", p5, 64)}, list_transform(range(n // 8), lambda i: {eight}::UBIGINT)) AS parts FROM a),
        c AS (SELECT *, list_reduce(parts, lambda h, k: {_plus(_times(_turned("xor(h, k)", 27, 64), p1, 64), p4, 64)}) AS h FROM b),
        d AS (SELECT * REPLACE (CASE WHEN n % 8 >= 4 THEN {_plus(_times(four, p2, 64), p3, 64)} ELSE h END AS h) FROM c),
        e AS (SELECT c_custkey, list_reduce(list_prepend(h, list_transform(range(n // 4 * 4, n), lambda i: {_times(_byte("i"), p5, 64)}::UBIGINT)), lambda h, k: {_times(_turned("xor(h, k)", 11, 64), p1, 64)}::UBIGINT) AS h FROM d),
        f AS (SELECT c_custkey, {_times(f"xor(h, h // {2**33})", p2, 64)}::UBIGINT AS h FROM e),
        g AS (SELECT c_custkey, {_times(f"xor(h, h // {2**29})", p3, 64)}::UBIGINT AS h FROM f)
        SELECT c_custkey, lower(hex(xor(h, h // {2**32}))) AS h FROM g
    """


@query(_xxhash_sql())
def hash_xxhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _table(spark, sf_dir, "customer")
    return pipeline_over(df, {"c_custkey": "event.c_custkey", "h": "xxhash(event.c_name)"}).ok_rows(df)


def _per_order(df: DataFrame) -> DataFrame:
    ordered = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_quantity", F.col("l_partkey").alias("part"), F.struct("l_discount", "l_tax").alias("rate"))))
    each = df.groupBy("l_orderkey").agg(ordered.alias("items"))
    return each.select("l_orderkey", "items", F.transform("items", lambda x: x["part"]).alias("parts"), F.transform("items", lambda x: x["l_quantity"]).alias("qty"))


_PER_ORDER = "WITH o AS (SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber, l_quantity, l_partkey) AS parts, list(l_quantity ORDER BY l_linenumber, l_quantity, l_partkey) AS qty, list(l_discount ORDER BY l_linenumber, l_quantity, l_partkey) AS disc FROM lineitem GROUP BY l_orderkey) "
projection("list_folds", "lineitem", {"l_orderkey": "event.l_orderkey", "s": "sum(event.parts)", "sd": "sumDouble(event.qty)", "mn": "min(event.parts)", "mx": "max(event.parts)", "mnd": "minDouble(event.qty)", "mxd": "maxDouble(event.qty)", "av": "avg(event.parts)", "avd": "avgDouble(event.qty)", "f": ("first(event.parts)", "long"), "l": ("last(event.parts)", "long"), "fl": "size(flatten([event.parts, event.parts]))"},
           _PER_ORDER + "SELECT l_orderkey, list_sum(parts)::BIGINT AS s, list_sum(qty) AS sd, list_min(parts) AS mn, list_max(parts) AS mx, list_min(qty) AS mnd, list_max(qty) AS mxd, list_avg(parts) AS av, list_avg(qty) AS avd, parts[1] AS f, parts[-1] AS l, 2 * len(parts) AS fl FROM o", _per_order)
projection("list_by_field", "lineitem", {"l_orderkey": "event.l_orderkey", "s": 'sumBy(event.items, "l_quantity")', "a": 'avgBy(event.items, "l_quantity")', "mn": 'minBy(event.items, "rate.l_discount")', "mx": 'maxBy(event.items, "rate..l_discount")'},
           _PER_ORDER + "SELECT l_orderkey, list_sum(qty) AS s, list_avg(qty) AS a, list_min(disc) AS mn, list_max(disc) AS mx FROM o", _per_order)
projection("macros_lists", "lineitem", {"l_orderkey": "event.l_orderkey", "al": "event.qty.all(x, x > 1.0)", "ex": "event.qty.exists(x, x > 49.0)", "one": "event.parts.exists_one(x, x % 10 == 0)", "mp": "event.parts.map(x, x * 2)", "mp3": "event.parts.map(x, x % 2 == 0, x + 1)", "fi": "event.parts.filter(x, x > 100)", "has7": "7 in event.parts", "n": "size(event.items)", "first_qty": "event.items[0].l_quantity"},
           _PER_ORDER + "SELECT l_orderkey, list_min(qty) > 1.0 AS al, list_max(qty) > 49.0 AS ex, len(list_filter(parts, lambda x: x % 10 = 0)) = 1 AS one, list_transform(parts, lambda x: x * 2) AS mp, list_transform(list_filter(parts, lambda x: x % 2 = 0), lambda x: x + 1) AS mp3, list_filter(parts, lambda x: x > 100) AS fi, list_contains(parts, 7) AS has7, len(parts) AS n, qty[1] AS first_qty FROM o", _per_order)
projection("convert_matrix", "part", {"p_partkey": "event.p_partkey", "si": 'toInt(trimPrefix(event.p_brand, "Brand#"))', "di": "toInt(event.p_retailprice)", "bi": "toInt(event.p_size > 25)", "sd": 'toDouble("1.5")', "ids": "toDouble(event.p_size)", "ist": "toString(event.p_size)", "bs": "toString(event.p_size > 25)", "sb": 'toBool("T")', "ib": "toBool(event.p_size)"},
           "SELECT p_partkey, replace(p_brand, 'Brand#', '')::BIGINT AS si, trunc(p_retailprice)::BIGINT AS di, (p_size > 25)::BIGINT AS bi, 1.5::DOUBLE AS sd, p_size::DOUBLE AS ids, p_size::VARCHAR AS ist, CASE WHEN p_size > 25 THEN 'true' ELSE 'false' END AS bs, true AS sb, p_size <> 0 AS ib FROM part")


@query("SELECT e.event_id, coalesce(n.v, e.event_type) AS c2, coalesce(n.v, n.v, 'z') AS c3, n.v IS NULL AS isn, n.v IS NOT NULL AS nn, nullif(e.event_type, 'click') AS ni, coalesce(n.v, 'd') AS od FROM events e, LATERAL (SELECT CASE WHEN e.event_id % 3 = 0 THEN e.event_type END AS v) n")
def null_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _table(spark, sf_dir, "events").withColumn("opt", F.when(F.col("event_id") % 3 == 0, F.col("event_type")))
    columns = {"event_id": "event.event_id", "c2": "coalesce(event.opt, event.event_type)", "c3": 'coalesce3(event.opt, event.opt, "z")', "isn": ("isNull(event.opt)", "bool"), "nn": ("isNotNull(event.opt)", "bool"), "ni": 'nullIf(event.event_type, "click")', "od": 'orDefault(event.opt, "d")'}
    return pipeline_over(df, columns).ok_rows(df)


projection("logic_absorption", "events", {"event_id": "event.event_id", "a": "event.event_id % 2 == 0 && 10 / (event.event_id % 2) >= 0 || event.event_id % 2 == 0", "b": "event.event_id % 2 == 1 || 10 / (event.event_id % 2) > 0 || true", "c": "event.event_id % 2 == 0 ? -1 : 10 / (event.event_id % 2)"},
           "SELECT event_id, event_id % 2 = 0 AS a, true AS b, CASE WHEN event_id % 2 = 0 THEN -1 ELSE 10 END AS c FROM events")
projection("arithmetic", "lineitem", {"k": "event.l_orderkey * 10 + event.l_linenumber", "q": "event.l_orderkey / 3", "r": "event.l_orderkey % 3", "neg": "-event.l_linenumber", "net": "event.l_extendedprice * (1.0 - event.l_discount)", "text": 'event.l_returnflag + "/" + event.l_linestatus', "pick": 'event.l_returnflag in ["A", "R"]', "code": '{"A": 1, "N": 2, "R": 3}[event.l_returnflag]'},
           "SELECT l_orderkey * 10 + l_linenumber AS k, l_orderkey // 3 AS q, l_orderkey % 3 AS r, -l_linenumber::BIGINT AS neg, l_extendedprice * (1.0 - l_discount) AS net, l_returnflag || '/' || l_linestatus AS text, l_returnflag IN ('A', 'R') AS pick, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS code FROM lineitem")


_TERMS = " + ".join(["event.l_orderkey", "event.l_linenumber", "event.l_partkey", "event.l_suppkey"] * 3)
projection("sum_of_twelve", "lineitem", {"s": _TERMS, "big": f"{_TERMS} > 100000 && event.l_orderkey - event.l_partkey * 2 + 7 != 0"},
           "SELECT 3 * (l_orderkey + l_linenumber + l_partkey + l_suppkey) AS s, 3 * (l_orderkey + l_linenumber + l_partkey + l_suppkey) > 100000 AND l_orderkey - l_partkey * 2 + 7 <> 0 AS big FROM lineitem")


@query("SELECT event_id, event_id % 3 = 0 AS h, coalesce(CASE WHEN event_id % 3 = 0 THEN event_type END, 'z') AS c4, coalesce(CASE WHEN event_id % 3 = 0 THEN event_type END, 'none') AS fn FROM events")
def null_rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _table(spark, sf_dir, "events").withColumn("opt", F.when(F.col("event_id") % 3 == 0, F.col("event_type")))
    columns = {"event_id": "event.event_id", "h": "has(event.opt)", "c4": 'coalesce4(event.opt, event.opt, event.opt, "z")', "fn": 'ifNull(event.opt, "none")'}
    return pipeline_over(df, columns).ok_rows(df)


@query("SELECT event_id, json_extract(props, '$.k')::BIGINT AS k, CASE WHEN event_id % 4 <> 0 THEN json_extract(props, '$.k')::BIGINT END AS read, event_id % 4 = 0 AS bad FROM events")
def json_decode_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = map_json({"type": "object", "title": "Props", "properties": {"k": {"type": "integer"}}, "required": ["k"]})
    broken = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("["), F.col("props"))).otherwise(F.col("props"))
    event, problem = json_event(broken, schema)
    good, _ = json_event(F.col("props"), schema)
    return _table(spark, sf_dir, "events").select("event_id", good["k"].alias("k"), event["k"].alias("read"), problem.isNotNull().alias("bad"))


def _time(name: str, path: str, value: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        text, internal = partitioning.transform(name, F.col("o_orderdate"), S.TimestampNTZType(), 0)
        return _table(spark, sf_dir, "orders").select("o_orderkey", text.alias("path"), internal.cast("long").alias("value"))

    run.__name__ = f"part_{name}"
    query(f"SELECT o_orderkey, strftime(o_orderdate, '{path}') AS path, {value} AS value FROM orders")(run)


_time("year", "%Y", "year(o_orderdate) - 1970")
_time("month", "%Y-%m", "(year(o_orderdate) - 1970) * 12 + month(o_orderdate) - 1")
_time("day", "%Y-%m-%d", "date_diff('day', DATE '1970-01-01', o_orderdate::DATE)")
_time("hour", "%Y-%m-%d-%H", "epoch_us(date_trunc('hour', o_orderdate)) // 3600000000")


@query("SELECT p_partkey, left(p_name, 3) AS ts, p_partkey - p_partkey % 100 AS ti, -p_partkey - (100 - p_partkey % 100) % 100 AS tn, left(p_brand, 7) AS tb FROM part")
def part_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda c, kind, w: partitioning.truncate(c, kind, w)
    return _table(spark, sf_dir, "part").select("p_partkey", t(F.col("p_name"), S.StringType(), 3).alias("ts"), t(F.col("p_partkey"), S.LongType(), 100).alias("ti"), t(-F.col("p_partkey"), S.LongType(), 100).alias("tn"), t(F.col("p_brand"), S.StringType(), 7).alias("tb"))


@query("SELECT event_id, 'day=' || strftime(ts, '%Y-%m-%d') || '/kind=' || replace(event_type || '/x=1', '/', '%2F').replace('=', '%3D') AS path, date_diff('day', DATE '1970-01-01', ts::DATE) AS day_value FROM events")
def part_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _table(spark, sf_dir, "events")
    parts = [{"source_id": 2, "field_id": 1000, "transform": "day", "name": "day"}, {"source_id": 3, "field_id": 1001, "transform": "identity", "name": "kind"}, {"source_id": 1, "field_id": 1002, "transform": "void", "name": "none"}]
    p = pipeline_over(df, {"event_id": "event.event_id", "ts": "event.ts", "kind": 'event.event_type + "/x=1"'}, partitions=parts)
    return sink.with_paths(p.ok_rows(df), p).select("event_id", F.col("_partition_path").alias("path"), F.col("_partition.day").cast("long").alias("day_value"))


_M = 4294967296


@query(f"""
    WITH a AS (SELECT o_orderkey AS id, (o_orderkey & 4294967295)::HUGEINT AS lo, (o_orderkey >> 32)::HUGEINT AS hi FROM orders),
    k AS (SELECT id, hi, (lo * 3432918353) % {_M} AS x, (hi * 3432918353) % {_M} AS y FROM a),
    r AS (SELECT id, ((x * 32768) % {_M} + x // 131072) * 461845907 % {_M} AS k1, ((y * 32768) % {_M} + y // 131072) * 461845907 % {_M} AS k2 FROM k),
    s AS (SELECT id, k1::BIGINT AS h, k2::BIGINT AS k2 FROM r),
    t AS (SELECT id, (((((h << 13) & 4294967295) | (h >> 19)) * 5 + 3864292196) & 4294967295) AS h, k2 FROM s),
    u AS (SELECT id, xor(h, k2) AS h FROM t),
    v AS (SELECT id, (((((h << 13) & 4294967295) | (h >> 19)) * 5 + 3864292196) & 4294967295) AS h FROM u),
    w AS (SELECT id, xor(h, 8) AS h FROM v),
    f AS (SELECT id, ((xor(h, h >> 16))::HUGEINT * 2246822507 % {_M})::BIGINT AS h FROM w),
    g AS (SELECT id, ((xor(h, h >> 13))::HUGEINT * 3266489909 % {_M})::BIGINT AS h FROM f)
    SELECT id AS o_orderkey, (xor(h, h >> 16) & 2147483647) % 16 AS bucket FROM g
""")
def part_bucket_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "orders").select("o_orderkey", partitioning.bucket(F.col("o_orderkey"), S.LongType(), 16).alias("bucket"))


def _murmur_sql() -> str:
    mixed = lambda k: _times(_turned(_times(k, 3432918353, 32), 15, 32), 461845907, 32)
    return f"""
        WITH a AS (SELECT c_custkey, c_name, length(c_name) AS n FROM customer),
        b AS (SELECT c_custkey, n, list_prepend(0::UBIGINT, list_transform(range(n // 4), lambda i: {mixed(_number("4 * i", 4))}::UBIGINT)) AS parts,
                     coalesce(list_sum(list_transform(range(n % 4), lambda i: {_byte("n // 4 * 4 + i")} * (256 ** i)::UBIGINT)), 0)::UBIGINT AS rest FROM a),
        c AS (SELECT c_custkey, xor(xor(list_reduce(parts, lambda h, k: {_plus(_times(_turned("xor(h, k)", 13, 32), 5, 32), 3864292196, 32)}), {mixed("rest")}::UBIGINT), n::UBIGINT) AS h FROM b),
        d AS (SELECT c_custkey, {_times("xor(h, h // 65536)", 2246822507, 32)}::UBIGINT AS h FROM c),
        e AS (SELECT c_custkey, {_times("xor(h, h // 8192)", 3266489909, 32)}::UBIGINT AS h FROM d)
        SELECT c_custkey, (xor(h, h // 65536) & 2147483647) % 16 AS bucket FROM e
    """


@query(_murmur_sql())
def part_bucket_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "customer").select("c_custkey", partitioning.bucket(F.col("c_name"), S.StringType(), 16).alias("bucket"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month, row_number() OVER (PARTITION BY strftime(o_orderdate, '%Y-%m') ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders")
def sort_within_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order that the sink writes rows of a partition in."""
    df = _table(spark, sf_dir, "orders")
    p = pipeline_over(df, {"o_orderkey": "event.o_orderkey", "o_orderdate": "event.o_orderdate", "price": "event.o_totalprice"}, partitions=[{"source_id": 2, "field_id": 1000, "transform": "month", "name": "month"}], sort=[{"source_id": 3, "direction": "desc", "null_order": "nulls-last"}, {"source_id": 1}])
    out, _ = sink.laid_out(p.ok_rows(df), p)
    # Rows are numbered as they lie; a month in pieces, or in two tasks, would leave holes between its places.
    at = F.monotonically_increasing_id()
    return out.select("month", "o_orderkey", at.alias("at")).select("month", "o_orderkey", (F.col("at") - F.min("at").over(Window.partitionBy("month")) + 1).alias("place"))


@query("SELECT event_id, strftime(make_timestamp(CASE WHEN event_id % 3 = 0 THEN s * 1000000 WHEN event_id % 3 = 1 THEN s * 1000000 ELSE s * 1000000 END), '%Y-%m-%d-%H') AS path FROM (SELECT event_id, epoch_us(ts) // 1000000 AS s FROM events)")
def epoch_unit_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.unix_seconds(F.col("ts").cast("timestamp"))
    mixed = F.when(F.col("event_id") % 3 == 0, s).when(F.col("event_id") % 3 == 1, s * 1000).otherwise(s * 1_000_000)
    return _table(spark, sf_dir, "events").select("event_id", partitioning.transform("hour", mixed, S.LongType(), 0)[0].alias("path"))


# ---------------------------------------------------------------- lifecycle: a segment for each hour of events

_SEGMENTS_SQL = """
    WITH h AS (SELECT epoch_us(date_trunc('hour', ts)) // 3600000000 AS hour, count(*) AS n, max(event_id) AS top FROM events GROUP BY 1),
    s AS (SELECT row_number() OVER (ORDER BY hour) - 1 AS segment_id, hour, n, sum(n) OVER (ORDER BY hour) AS last_index FROM h),
    segments AS (SELECT segment_id, CASE WHEN segment_id % 19 = 17 THEN 1 WHEN segment_id % 23 = 22 THEN 3 ELSE 2 END AS state, 'node-' || (segment_id % 3) AS assigned_to, last_index - n + 1 AS first_index, last_index::BIGINT AS last_index, n AS entry_count, segment_id * 1000000 AS sealed_at, segment_id // 10 AS sealed_term, segment_id % 4 AS attempt_count FROM s)
"""


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours are few, one row each; they are numbered in one task."""
    h = _table(spark, sf_dir, "events").groupBy((F.call_function("div", F.unix_micros(F.col("ts").cast("timestamp")), F.lit(3_600_000_000).cast("bigint"))).alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy("hour")
    s = h.select((F.row_number().over(w) - 1).cast("long").alias("segment_id"), "n", F.sum("n").over(w).alias("last_index"))
    i = F.col("segment_id")
    return s.select("segment_id", F.when(i % 19 == 17, 1).when(i % 23 == 22, 3).otherwise(2).alias("state"), F.concat(F.lit("node-"), (i % 3).cast("string")).alias("assigned_to"), (F.col("last_index") - F.col("n") + 1).alias("first_index"), "last_index", F.lit(0).cast("long").alias("byte_size"), F.col("n").alias("entry_count"), (i * 1_000_000).alias("sealed_at"), F.lit(None).cast("long").alias("assigned_at"), F.call_function("div", i, F.lit(10).cast("bigint")).alias("sealed_term"), (i % 4).cast("int").alias("attempt_count"), F.lit("").alias("failure_reason"))


@query(_SEGMENTS_SQL + """, e AS (SELECT min(segment_id) AS e FROM segments WHERE state <> 2) SELECT coalesce(max(last_index), 0)::BIGINT AS safe_index, coalesce(arg_max(sealed_term, segment_id), 0)::BIGINT AS safe_term FROM segments, e WHERE segment_id < coalesce(e, 1e18)""")
def segments_safe_gc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.safe_gc(_segments(spark, sf_dir))


@query(_SEGMENTS_SQL + ", f AS (SELECT min(segment_id) AS f FROM segments WHERE state <> 2 OR last_index > 200) SELECT segment_id, state FROM segments, f WHERE segment_id >= f")
def segments_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.cleanup(_segments(spark, sf_dir), 200).select("segment_id", "state")


@query(_SEGMENTS_SQL + "SELECT segment_id, assigned_to FROM segments WHERE state = 1 AND sealed_at <= 500000000 - 300000000")
def segments_stalled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.stalled(_segments(spark, sf_dir), 500_000_000).select("segment_id", "assigned_to")


@query(_SEGMENTS_SQL + "SELECT segment_id, CASE WHEN attempt_count >= 3 THEN 'FAILED' ELSE 'REASSIGNED' END AS kind, CASE WHEN attempt_count >= 3 THEN assigned_to WHEN assigned_to = 'node-0' THEN 'node-1' ELSE 'node-0' END AS node, CASE WHEN attempt_count >= 3 THEN 'exceeded_max_reassignments' ELSE 'stall_detected' END AS reason FROM segments WHERE state = 1 AND sealed_at <= 700000000")
def segments_stall_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.stall_commands(_segments(spark, sf_dir), ["node-0", "node-1", "node-2"], 1_000_000_000)


@query(_SEGMENTS_SQL + "SELECT segment_id FROM (SELECT *, row_number() OVER (ORDER BY segment_id DESC) AS p FROM segments) WHERE p > 100")
def retention_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.retention(_segments(spark, sf_dir), 0, max_segments=100).select("segment_id")


@query(_SEGMENTS_SQL + "SELECT segment_id, 500 - first_index AS slot FROM segments WHERE first_index <= 500 AND 500 < first_index + entry_count")
def segment_for_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.locate(_segments(spark, sf_dir), 500).select("segment_id", "slot")


@query(_SEGMENTS_SQL + "SELECT segment_id, assigned_to, first_index, last_index FROM segments WHERE state = 1 AND assigned_to = 'node-1'")
def segments_of_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.sealed(_segments(spark, sf_dir), "node-1").select("segment_id", "assigned_to", "first_index", "last_index")


@query("""
    WITH c AS (SELECT o_orderkey AS segment_id, o_custkey % 3 AS n, o_orderkey % 5 AS k FROM orders)
    SELECT segment_id, CASE WHEN k = 1 OR k = 4 THEN 2 WHEN k = 2 THEN 3 ELSE 1 END AS state, CASE WHEN k = 3 AND n <> 1 THEN 'node-1' ELSE 'node-' || n END AS assigned_to, CASE WHEN k = 3 AND n <> 1 THEN 1 ELSE 0 END AS attempt_count, CASE WHEN k = 2 OR k = 4 THEN 'broken' ELSE '' END AS failure_reason FROM c
""")
def lifecycle_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order is a segment: sealed twice, then by its number uploaded, failed, moved, or failed and uploaded."""
    o = _table(spark, sf_dir, "orders")
    k, at = F.col("o_orderkey") % 5, F.col("o_orderkey") * 10
    node = F.concat(F.lit("node-"), (F.col("o_custkey") % 3).cast("string"))
    row = lambda i, kind, n, reason="": F.struct((at + i).alias("log_index"), F.lit(kind).alias("kind"), n.alias("node"), F.lit(reason).alias("reason"))
    some = F.array(row(1, "SEALED", node), row(2, "SEALED", F.lit("node-9")))
    more = F.when(k == 1, F.array(row(3, "UPLOADED", node), row(4, "FAILED", node, "late"))).when(k == 2, F.array(row(3, "FAILED", node, "broken"), row(4, "REASSIGNED", F.lit("node-1")))).when(k == 3, F.array(row(3, "REASSIGNED", F.lit("node-1")), row(4, "APPEND", node))).when(k == 4, F.array(row(3, "FAILED", node, "broken"), row(4, "UPLOADED", node))).otherwise(F.array(row(0, "UPLOADED", node), row(5, "NOTHING", node)))
    c = o.select(F.col("o_orderkey").alias("segment_id"), F.explode(F.concat(some, more)).alias("c")).select("segment_id", "c.*")
    zero = {n: F.lit(0).cast("long") for n in ("log_term", "first_index", "last_index", "byte_size", "entry_count", "sealed_at")}
    return lifecycle.fold(c.withColumns(zero)).select("segment_id", "state", "assigned_to", "attempt_count", "failure_reason")


@query(_SEGMENTS_SQL + """
    SELECT segment_id, greatest(first_index, 150)::BIGINT AS advanced, CASE WHEN entry_count * 20 > 0 THEN least(last_index, entry_count * 20) ELSE 0 END::BIGINT AS capped,
           CASE WHEN first_index - 1 > 0 AND first_index - 1 <= 300 THEN first_index - 1 ELSE 300 END::BIGINT AS snap, 'node-' || (segment_id % 3) AS node, entry_count > 0 AND last_index <= 500 AS goes FROM segments
""")
def segments_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indices that only move forward, deletes up to the safe index, snapshots, the node that a segment falls to, and what compaction frees."""
    s = _segments(spark, sf_dir)
    free = lifecycle.deletable(s, 500).select("segment_id", F.lit(True).alias("goes"))
    nodes = ["node-0", "node-1", "node-2"]
    long = lambda c: c.cast("long")
    out = s.select("segment_id", long(lifecycle.advance(F.col("first_index"), F.lit(150))).alias("advanced"), long(lifecycle.capped_delete(F.col("last_index"), F.col("entry_count") * 20)).alias("capped"), long(lifecycle.snapshot_index(F.col("first_index") - 1, F.lit(300))).alias("snap"), lifecycle.assign(F.col("segment_id"), nodes).alias("node"))
    return out.join(free, "segment_id", "left").withColumn("goes", F.coalesce("goes", F.lit(False)))


@query(_SEGMENTS_SQL + "SELECT last_index::BIGINT AS log_index, sealed_term::BIGINT AS log_term, 'UPLOADED' AS kind, segment_id, assigned_to AS node, entry_count, 'done' AS reason FROM segments WHERE state = 2")
def segments_snapshot_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commands for the uploaded segments of a snapshot that was written and read back."""
    from .sources.shared import shared_folder

    folder = shared_folder(spark, "snapshot")
    log_store.snapshot(_segments(spark, sf_dir), folder)
    held = log_store.restore(spark, folder).where("state = 2")
    return lifecycle.command_rows(held, "UPLOADED", F.col("last_index"), F.col("sealed_term"), "done").select("log_index", "log_term", "kind", "segment_id", "node", "entry_count", "reason")


@query("SELECT event_id, array_to_string(list_transform(range((event_id * 2) % 5), lambda x: props), '|') AS frames FROM events")
def batch_frame_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event's properties some times over, framed as one batch, with a broken end, and cut again."""
    copies = F.transform(F.sequence(F.lit(0), ((F.col("event_id") * 2) % 5).cast("int")), lambda x: F.col("props").cast("binary"))
    batch = F.concat(avro.join_frames(F.slice(copies, F.lit(1), F.size(copies) - 1)), F.unhex(F.lit("05000000AB")))
    frames = avro.split_frames(batch, F.lit(0))
    return _table(spark, sf_dir, "events").select("event_id", F.array_join(F.transform(frames, lambda x: x.cast("string")), "|").alias("frames"))


@query("SELECT event_id, event_id % 7 <> 0 AS good, CASE WHEN event_id % 7 <> 0 THEN event_id % 64 END AS k, CASE WHEN event_id % 7 <> 0 THEN event_type END AS kind, CASE WHEN event_id % 7 <> 0 AND event_id % 2 = 0 THEN user_id % 50 - 25 END AS u FROM events")
def avro_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Avro payloads that are put together from bytes; of every seventh the last byte is missing."""
    import json

    schema = {"type": "record", "name": "E", "fields": [{"name": "k", "type": "long"}, {"name": "kind", "type": "string"}, {"name": "u", "type": ["null", "int"]}]}
    byte = lambda n: F.lpad(F.hex(n.cast("long")), 2, "0")
    signed = F.col("user_id") % 50 - 25
    zigzag = F.when(signed >= 0, signed * 2).otherwise(-signed * 2 - 1)
    low = (F.col("event_id") % 64) * 2  # a number of one byte: below 128, and even for numbers that aren't negative
    union = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("02"), byte(zigzag))).otherwise(F.lit("00"))
    text = F.concat(byte(low), byte(F.octet_length("event_type") * 2), F.hex("event_type"), union)
    text = F.when(F.col("event_id") % 7 == 0, F.left(text, F.length(text) - 2)).otherwise(text)
    out = _table(spark, sf_dir, "events").withColumn("payload", F.unhex(text))
    d = out.withColumn("d", avro.decoder(json.dumps(schema))("payload"))
    return d.select("event_id", F.col("d.error").isNull().alias("good"), "d.event.k", "d.event.kind", F.col("d.event.u").cast("long").alias("u"))


@query("SELECT event_id::VARCHAR AS id, event_type AS kind, epoch_us(ts) AS us, props AS payload, event_id % 3 AS schema_id, CASE WHEN event_id % 2 = 0 THEN 'zstd' ELSE 'none' END AS compression, user_id::VARCHAR AS who, 7::BIGINT AS lsn FROM events")
def entries_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as binary log entries, read back and taken into the rows of the log."""
    from .sources import entries, ingest

    e = _table(spark, sf_dir, "events")
    event = F.struct(F.col("event_id").cast("string").cast("binary").alias("event_id"), "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("occurred_at"), F.lit(1).cast("long").alias("ingested_at"), F.col("props").cast("binary").alias("payload"), F.when(F.col("event_id") % 2 == 0, "zstd").otherwise("none").alias("compression"), (F.col("event_id") % 3).cast("long").alias("schema_id"), F.array(F.struct(F.lit("who").alias("key"), F.col("user_id").cast("string").cast("binary").alias("value"))).alias("metadata"))
    rows = ingest.to_log(e.select(entries.decoder(entries.encoder(event)).alias("d")).select("d.event.*"), 7)
    kept = ingest.scan_from(rows, 7)
    return kept.select(F.col("_event_id").cast("string").alias("id"), F.col("_event_type").alias("kind"), F.unix_micros("_occurred_at").alias("us"), F.col("payload").cast("string").alias("payload"), F.col("_schema_id").alias("schema_id"), "compression", F.col("metadata")[0]["value"].cast("string").alias("who"), F.col("_lsn").alias("lsn"))


@query("SELECT strftime(o_orderdate, '%Y') AS year, count(*)::BIGINT AS n, 4::BIGINT AS schema_id FROM orders GROUP BY 1")
def sink_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of a written table: rows of its files, summed by partition."""
    from .sources.shared import shared_folder

    df = _table(spark, sf_dir, "orders")
    p = pipeline_over(df, {"o_orderkey": "event.o_orderkey", "o_orderdate": "event.o_orderdate"}, partitions=[{"source_id": 2, "field_id": 1000, "transform": "year", "name": "year"}])
    folder = shared_folder(spark, "manifest")
    sink.write(p.ok_rows(df), p, folder)
    files = sink.manifest(spark, folder, 4)
    return files.groupBy(F.regexp_extract("object_key", "year=([0-9]+)", 1).alias("year"), "schema_id").agg(F.sum("row_count").alias("n"))


@query("SELECT * FROM (VALUES (1::BIGINT, 'o_orderkey', 'long'), (2, 'o_orderdate', 'timestamptz'), (3, 'price', 'decimal(12,2)')) AS t(id, name, type)")
def sink_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields of the schema that lies beside a written table."""
    from .sources.shared import shared_folder

    df = _table(spark, sf_dir, "orders")
    p = pipeline_over(df, {"o_orderkey": "event.o_orderkey", "o_orderdate": "event.o_orderdate", "price": ("event.o_totalprice", "decimal(12,2)")})
    folder = shared_folder(spark, "schema")
    sink.write(p.ok_rows(df), p, folder)
    text = spark.createDataFrame([(sink.table_schema(spark, folder),)], "text string")
    return text.select(F.explode(F.from_json("text", "fields array<struct<id:long,name:string,type:string>>")["fields"]).alias("f")).select("f.*")


@query("SELECT event_id, ((event_id * 2) % 5) AS n_frames FROM events")
def batch_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames cut from a binary batch: each event's properties, framed some times over, and a broken end."""
    raw = F.col("props").cast("binary")
    n = F.octet_length("props")
    header = F.unhex(F.concat(F.lpad(F.hex(n % 256), 2, "0"), F.lpad(F.hex(F.floor(n / 256)), 2, "0"), F.lit("0000")))
    one = F.concat(F.hex(header), F.hex(raw))
    framed = F.unhex(F.concat(F.repeat(one, ((F.col("event_id") * 2) % 5).cast("int")), F.lit("FF")))
    frames = avro.split_frames(framed, F.lit(0))
    return _table(spark, sf_dir, "events").select("event_id", F.size(frames).cast("long").alias("n_frames"))


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders as log entries, whose indices skip one after every 97 of them."""
    k = F.col("o_orderkey")
    return _table(spark, sf_dir, "orders").select((k + F.call_function("div", k, F.lit(97).cast("bigint"))).alias("index"), F.col("o_custkey").alias("term"))


@query("""
    WITH e AS (SELECT o_orderkey + o_orderkey // 97 AS i FROM orders)
    SELECT i AS last_index, n AS next_index FROM (SELECT i, lead(i) OVER (ORDER BY i) AS n FROM e) WHERE n > i + 1
""")
def log_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_store.gaps(_entries(spark, sf_dir))


@query("SELECT min(i) AS first_index, max(i) AS last_index FROM (SELECT o_orderkey + o_orderkey // 97 AS i, max(o_orderkey) OVER () AS top FROM orders) WHERE i <= top // 2")
def log_truncated_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ends of a log after its second half was cut off."""
    top = _table(spark, sf_dir, "orders").agg(F.max("o_orderkey")).first()[0]
    return log_store.first_last(log_store.truncate_to(_entries(spark, sf_dir), top // 2))


@query("SELECT o_orderkey AS index, CASE WHEN o_orderkey < top // 2 THEN 0 ELSE 1 END AS term FROM (SELECT o_orderkey, max(o_orderkey) OVER () AS top FROM orders) WHERE o_orderkey <= top - top // 4")
def log_overlapping_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch from the middle of a log of all orders on, up to three quarters, replaces its end, which reached further."""
    o = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("index"))
    top = o.agg(F.max("index")).first()[0]
    held, batch = o.withColumn("term", F.lit(0)), o.where(F.col("index").between(top // 2, top - top // 4)).withColumn("term", F.lit(1))
    return log_store.merged(held, batch)


@query("SELECT o_orderkey + 1 AS index, CASE WHEN o_orderkey < n // 4 THEN 1 WHEN o_orderkey < n // 3 THEN 3 ELSE 4 END AS term FROM orders, (SELECT count(*) AS n FROM orders) WHERE o_orderkey < n // 3 + n // 10")
def log_replaced_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of all orders whose end is replaced by three later batches, each starting before, in or after the one before it."""
    from .sources.shared import shared_folder

    o = _table(spark, sf_dir, "orders")
    n = o.count()

    def batch(low: int, high: int, term: int) -> DataFrame:
        return o.where((F.col("o_orderkey") + 1).between(low, high)).select((F.col("o_orderkey") + 1).cast("long").alias("index"), F.lit(term).cast("long").alias("term"), F.lit("command").alias("type"), F.col("o_orderdate").cast("timestamp").alias("appended_at"), F.col("o_orderstatus").cast("binary").alias("data"))

    log = log_store.LogTable(spark, shared_folder(spark, "log"))
    log.append(batch(1, n, 1), 1)
    log.append(batch(n // 2, n // 2 + n // 10, 2), 2)
    log.append(batch(n // 4 + 1, n // 3, 3), 3)
    log.append(batch(n // 3 + 1, n // 3 + n // 10, 4), 4)
    return log.read().select("index", "term")


_RULES_OF_JSON = {
    "type": "object", "required": ["user_id", "tags", "way"], "additionalProperties": False,
    "properties": {
        "user_id": {"type": "integer", "minimum": 0}, "name": {"enum": ["é", "b"]}, "tags": {"type": "array", "items": {"type": "object", "required": ["k"], "properties": {"k": {"type": "integer", "minimum": 0}}}},
        "way": {"oneOf": [{"type": "string"}, {"type": "integer", "minimum": 10}, {"type": "integer", "multipleOf": 2}]}, "note": {"anyOf": [{"type": "null"}, {"type": "string", "minLength": 2}]}, "loose": {"minimum": 5},
    },
}
#: A part of a payload for each number of an event, and whether the payload then satisfies the schema.
_FORMS = (
    ('"tags": [], "way": "x"', True), ('"tags": [{"k": 1}, {"k": 2}], "way": 11', True), ('"tags": [{"k": -1}], "way": 11', False), ('"tags": [{}], "way": 11', False), ('"tags": [{"k": "1"}], "way": 11', False),
    ('"tags": [], "way": 12', False), ('"tags": [], "way": 7', False), ('"tags": [], "way": 4', True), ('"tags": [], "way": 4, "name": "é"', True), ('"tags": [], "way": 4, "name": "e"', False), ('"tags": [], "way": 4, "note": null', True),
    ('"tags": [], "way": 4, "note": "a"', False), ('"tags": [], "way": 4, "note": "ab", "loose": "3"', True), ('"tags": [], "way": 4, "loose": 3', False), ('"tags": [], "way": 4, "more": 3', False), ('"way": 4', False),
)


@query("SELECT event_id, event_id % 16 IN (" + ", ".join(str(i) for i, (_, good) in enumerate(_FORMS) if good) + ") AS good, CASE WHEN good THEN user_id END AS u FROM events")
def json_schema_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads in valid and broken forms against one schema with alternatives, items and values that aren't ASCII."""
    form = F.get(F.array(*[F.lit(x) for x, _ in _FORMS]), (F.col("event_id") % len(_FORMS)).cast("int"))
    text = F.concat(F.lit('{"user_id": '), F.col("user_id").cast("string"), F.lit(", "), form, F.lit("}"))
    event, problem = json_event(text.cast("binary"), map_json(_RULES_OF_JSON))
    return _table(spark, sf_dir, "events").select("event_id", problem.isNull().alias("good"), event["user_id"].alias("u"))


def _bronze(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as they arrive: an envelope, and the payload as JSON text."""
    body = F.to_json(F.struct("user_id", "event_type", "value", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("at")))
    broken = F.when(F.col("event_id") % 50 == 7, F.lit("{")).when(F.col("event_id") % 50 == 8, F.lit('{"user_id": "x"}')).otherwise(body)
    return _table(spark, sf_dir, "events").select(F.col("event_id").alias("_lsn"), broken.cast("binary").alias("payload"))


@query("""
    SELECT event_id AS _lsn, CASE WHEN event_id % 50 IN (7, 8) THEN 'undecoded' WHEN NOT value >= 5.0 THEN 'rejected' WHEN event_type = 'view' THEN 'filtered' ELSE 'ok' END AS outcome,
           CASE WHEN event_id % 50 NOT IN (7, 8) AND value >= 5.0 AND event_type <> 'view' THEN 'u' || user_id || ':' || upper(event_type) || ':' || strftime(ts, '%Y-%m-%d') END AS label
    FROM events
""")
def decode_and_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads by a registered JSON Schema with an embedded pipeline, decoded, checked and classified."""
    import json

    from .sources.decode import decode
    from .sources.registry import prepare

    schema = {
        "type": "object", "title": "Click", "properties": {"user_id": {"type": "integer"}, "event_type": {"type": "string"}, "value": {"type": "number"}, "at": {"type": "string", "format": "date-time"}}, "required": ["user_id", "event_type", "value", "at"],
        "x-pipeline": {"validate": ["event.value >= 5.0"], "filter": 'event.event_type != "view"', "columns": [{"name": "label", "expr": '"u" + string(event.user_id) + ":" + upper(event.event_type) + ":" + date(event.at)', "field_id": 1}]},
    }
    registered = prepare(1, None, json.dumps(schema))
    decoded = decode(_bronze(spark, sf_dir), registered)
    out = registered.pipeline.classify(decoded, keep=("_lsn", "_decode_error"))
    return out.select("_lsn", F.when(F.col("_decode_error").isNotNull(), "undecoded").otherwise(F.col("_status")).alias("outcome"), "label")


@query("SELECT event_id, upper(event_type) AS kind, strftime(ts, '%Y-%m-%d') AS dt, value * 100.0 AS amount FROM events WHERE value >= 0.0 AND event_type <> 'view'")
def stream_ok(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship pipeline as a stream over the same file, read back from its partitioned table."""
    from .sources.shared import shared_folder
    from .streaming import stream

    df = _table(spark, sf_dir, "events")
    p = pipeline_over(df, _EVENT_COLUMNS, ["event.value >= 0.0"], 'event.event_type != "view"', [{"source_id": 3, "field_id": 1000, "transform": "truncate", "param": 7, "name": "month"}], _BY_ID)
    folder = shared_folder(spark, "stream")
    source = spark.readStream.schema(df.schema).parquet(f"{sf_dir}/events.parque[t]")  # a pattern, as the table is one file
    stream.run(source, p, f"{folder}/table", f"{folder}/checkpoint").awaitTermination()
    return spark.read.option("recursiveFileLookup", "true").parquet(f"{folder}/table/data").select(*p.column_names)


@query("SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM orders GROUP BY 1")
def sink_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written by month, sorted, and read back by partition."""
    from .sources.shared import shared_folder

    df = _table(spark, sf_dir, "orders")
    p = pipeline_over(df, {"o_orderkey": "event.o_orderkey", "o_orderdate": "event.o_orderdate"}, partitions=[{"source_id": 2, "field_id": 1000, "transform": "month", "name": "month"}], sort=[{"source_id": 1}])
    folder = shared_folder(spark, "sink")
    sink.write(p.ok_rows(df), p, folder)
    return spark.read.schema("o_orderkey long, o_orderdate timestamp, month string").parquet(folder).groupBy("month").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))
