"""Pipelines, schemas, decoding, layout, lifecycle, the sink and the stream."""

import datetime as dt
import hashlib
import json
import struct
import uuid

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as S

from tidewright.operators import lifecycle, partitioning
from tidewright.plans import types as T
from tidewright.plans.config import ConfigError, extract, from_dict
from tidewright.plans.pipeline import CompileError, RowFault, ValidationFault, compile_pipeline, counters, scope_of, scope_of_frame
from tidewright.sources import avro, decode, ingest, sink
from tidewright.sources.registry import Registry, SchemaExists, SchemaNotFound
from tidewright.sources.schemas import SchemaFault, map_avro, map_json
from tidewright.streaming import stream

COLUMNS = [{"name": "id", "expr": "event.id", "field_id": 1}, {"name": "half", "expr": "100 / event.n", "field_id": 2}]


def frame(spark):
    return spark.createDataFrame([(1, 10, "a"), (2, 0, "a"), (3, -1, "a"), (4, None, "a"), (5, 20, "skip"), (6, 50, None)], "id long, n long, kind string")


def test_classify_and_ok_rows(spark):
    df = frame(spark)
    p = compile_pipeline(from_dict({"columns": COLUMNS, "validate": ["event.n >= 0"], "filter": 'event.kind != "skip"'}), scope_of_frame(df))
    out = {r.id0: r for r in p.classify(df.withColumn("id0", F.col("id")), keep=("id0",)).collect()}
    assert {k: (r._status, r._location) for k, r in out.items()} == {1: ("ok", None), 2: ("error", "columns[1]"), 3: ("rejected", "validate[0]"), 4: ("error", "validate[0]"), 5: ("filtered", "filter"), 6: ("ok", None)}
    assert out[1].half == 10 and out[2].half is None and out[2].id is None
    assert [tuple(r) for r in p.ok_rows(df).orderBy("id").collect()] == [(1, 10), (6, 2)]
    c = counters(p.classify(df)).first()
    assert (c.ok, c.filtered, c.rejected, c.error, c.total, c.has_errors) == (2, 1, 1, 2, 6, True)
    fault = RowFault.of("rejected", "validate[3]", "no")
    assert isinstance(fault, ValidationFault) and fault.index == 3 and RowFault.of("ok", None, None) is None


def test_plain_conditions_reach_the_scan(spark, tmp_path):
    frame(spark).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    p = compile_pipeline(from_dict({"columns": COLUMNS[:1], "validate": ["event.n >= 0"], "filter": 'event.kind == "a"'}), scope_of_frame(df))
    plan = p.ok_rows(df)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(n,0)" in plan and "EqualTo(kind,a)" in plan


def test_all_faults_are_reported(spark):
    scope = scope_of_frame(frame(spark))
    with pytest.raises(CompileError) as e:
        compile_pipeline(from_dict({"columns": [{"name": "a", "expr": "event.nope", "field_id": 1}, {"name": "b", "expr": "event.id", "field_id": 2, "as": "int7"}], "validate": ["event.n", "event.n >"], "filter": "coalesce(event.kind, \"a\")"}), scope)
    assert [f.split(":")[0] for f in e.value.faults] == ["validate[0]", "validate[1]", "filter", "columns[0]", "columns[1]"]


@pytest.mark.parametrize(("change", "said"), [
    ({"columns": []}, "at least one"), ({"columns": [{"name": "", "expr": "1", "field_id": 1}]}, "empty name"), ({"columns": [COLUMNS[0], COLUMNS[0]]}, "duplicate"), ({"columns": [{"name": "a", "expr": "", "field_id": 1}]}, "empty expression"),
    ({"columns": [{"name": "a", "expr": "1", "field_id": 0}]}, "out of range"), ({"columns": [{"name": "a", "expr": "1", "field_id": 2147483447}]}, "out of range"), ({"partition_spec": [{"source_id": 9, "field_id": 1000, "transform": "day", "name": "d"}]}, "no column"),
    ({"partition_spec": [{"source_id": 1, "field_id": 1000, "transform": "week", "name": "d"}]}, "unknown transform"), ({"partition_spec": [{"source_id": 1, "field_id": 0, "transform": "day", "name": ""}]}, "not positive"), ({"sort_order": [{"source_id": 1, "direction": "up"}]}, "direction"), ({"sort_order": [{"source_id": 1, "null_order": "x"}]}, "null order"),
])
def test_unsound_configurations(change, said):
    with pytest.raises(ConfigError, match=said):
        from_dict({"columns": COLUMNS, **change}).check()


def test_extract():
    schema = {"type": "record", "name": "Order", "fields": [], "x-pipeline": {"columns": COLUMNS, "sort_order": [{"source_id": 2, "direction": "asc", "null_order": "nulls-last"}], "schema_format": "avro"}}
    cleaned, config = extract(json.dumps(schema))
    assert "x-pipeline" not in cleaned and config.column_names == ["id", "half"] and config.is_avro and config.has_sort_order and config.column_index("half") == 1 and config.column_by_field_id(2).name == "half"
    assert extract('{"type": "object"}')[1] is None
    with pytest.raises(ConfigError):
        extract("{")


def test_output_types(spark):
    df = spark.sql("select 5L n, 2.5D d, '2024-01-02' s, timestamp'2024-01-02 03:04:05' ts, 'f81d4fae-7dec-11d0-a765-00a0c91e6bf6' u, array(1L) l, named_struct('a', 1L) o")
    kinds = {"a": ("event.n", "int"), "b": ("event.n", "decimal(5,1)"), "c": ("event.s", "date"), "d": ("event.ts", "timestamp"), "e": ("event.u", "uuid"), "f": ("event.ts", "time"), "g": ("event.d", "float"), "h": ("event.s", "bytes"), "i": ("event.o", None), "j": ("coalesce(event.n, 1)", None), "k": ("event.l", None), "m": ("null", None), "q": ("event.s", "int")}
    config = from_dict({"columns": [{"name": k, "expr": e, "as": t, "field_id": i} for i, (k, (e, t)) in enumerate(kinds.items(), 1)], "schema_id": 3})
    p = compile_pipeline(config, scope_of_frame(df))
    row = p.classify(df).first()
    assert row._status == "error" and row._location == "columns[12]"  # not an int
    p = compile_pipeline(from_dict({"columns": [{"name": k, "expr": e, "as": t, "field_id": i} for i, (k, (e, t)) in enumerate(kinds.items(), 1) if k != "q"], "schema_id": 3}), scope_of_frame(df))
    row = p.ok_rows(df).first()
    assert (row.a, str(row.b), row.c, row.d, row.f, row.g, bytes(row.h), row.i, row.j, row.k, row.m) == (5, "5.0", dt.date(2024, 1, 2), dt.datetime(2024, 1, 2, 3, 4, 5), 11045000000, 2.5, b"2024-01-02", '{"a":1}', "5", [1], None)
    assert bytes(row.e) == uuid.UUID("f81d4fae-7dec-11d0-a765-00a0c91e6bf6").bytes
    fields = json.loads(p.iceberg_schema())["fields"]
    assert [f["type"] for f in fields] == ["int", "decimal(5,1)", "date", "timestamp", "uuid", "time", "float", "binary", "string", "string", "list<long>", "string"]
    assert [f["required"] for f in fields][-3:] == [False, True, False] and p.schema()["a"].metadata["parquet.field.id"] == 1
    for bad in ("int7", "decimal(39,1)", "decimal(3,4)"):
        with pytest.raises(ValueError, match="invalid output"):
            T.output_type(bad)


AVRO = {"type": "record", "name": "Order", "namespace": "com.example", "fields": [
    {"name": "order_id", "type": "string"}, {"name": "amount", "type": "double"}, {"name": "note", "type": ["null", "string"]}, {"name": "tags", "type": {"type": "array", "items": "string"}}, {"name": "meta", "type": {"type": "map", "values": "long"}},
    {"name": "at", "type": {"type": "long", "logicalType": "timestamp-micros"}}, {"name": "day", "type": {"type": "int", "logicalType": "date"}}, {"name": "kind", "type": {"type": "enum", "name": "Kind", "symbols": ["A", "B"]}}, {"name": "inner", "type": {"type": "record", "name": "Inner", "fields": [{"name": "ok", "type": "boolean"}, {"name": "again", "type": "Kind"}]}}, {"name": "raw", "type": {"type": "fixed", "name": "Two", "size": 2}}]}


def zigzag(n):
    n, out = (n << 1) ^ (n >> 63), bytearray()
    while n >= 0x80:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def encoded():
    s = lambda t: zigzag(len(t.encode())) + t.encode()
    return s("o-1") + struct.pack("<d", 12.5) + zigzag(1) + s("hi") + zigzag(2) + s("x") + s("y") + zigzag(0) + zigzag(-1) + zigzag(4) + s("k") + zigzag(7) + zigzag(0) + zigzag(1_700_000_000_000_000) + zigzag(19000) + zigzag(1) + b"\x01" + zigzag(0) + b"\xab\xcd"


def test_avro(spark):
    payload = encoded()
    df = spark.createDataFrame([(payload,), (payload[:-1],), (payload + b"\0",), (None,)], "payload binary")
    out = [r.d for r in df.select(avro.decoder(json.dumps(AVRO))("payload").alias("d")).collect()]
    e = out[0].event
    assert out[0].error is None and (e.order_id, e.amount, e.note, e.tags, e.meta, e.kind, e.inner.ok, e.inner.again, bytes(e.raw)) == ("o-1", 12.5, "hi", ["x", "y"], {"k": 7}, "B", True, "A", b"\xab\xcd")
    assert e.at == dt.datetime(2023, 11, 14, 22, 13, 20) and e.day == dt.datetime(2022, 1, 8)
    assert all(x.event is None and x.error for x in out[1:])


def test_avro_types():
    t = map_avro(AVRO).type
    assert str(t) == "com.example.Order" and t.field_type("note") == T.STRING and t.field_type("tags") == T.list_of(T.STRING) and t.field_type("at") == T.TIMESTAMP
    assert map_avro(["null", "int", "string"]).type == T.DYN and map_avro(["null"]).type == T.NULL and map_avro({"type": "bytes", "logicalType": "decimal"}).type == T.STRING
    for bad in ({"type": "record", "name": "R", "fields": [{"name": "r", "type": "R"}]}, "nope"):
        with pytest.raises(SchemaFault):
            map_avro(bad)


def test_json_schema_types():
    m = lambda s: map_json(s).type
    t = m({"type": "object", "title": "Order", "properties": {"name": {"type": "string"}, "age": {"type": "integer"}, "score": {"type": "number"}, "on": {"type": "boolean"}, "at": {"type": "string", "format": "date-time"}, "mail": {"type": "string", "format": "email"}, "opt": {"type": ["null", "string"]}, "mix": {"anyOf": [{"type": "string"}, {"type": "integer"}]}, "one": {"oneOf": [{"type": "null"}, {"type": "number"}]}, "e": {"enum": [1, 2]}, "c": {"const": "x"}, "list": {"type": "array", "items": {"type": "integer"}}, "any": {"type": "array"}, "map": {"type": "object", "additionalProperties": {"type": "number"}}, "bare": {"type": "object"}, "ref": {"$ref": "#/$defs/A"}, "all": {"allOf": [{"$ref": "#/$defs/A"}, {"properties": {"b": {"type": "integer"}}}]}}, "$defs": {"A": {"type": "object", "properties": {"a": {"type": "string"}}}}})
    f = t.field_type
    assert [f(k) for k in ("name", "age", "score", "on", "at", "mail", "opt", "mix", "one", "e", "c", "list")] == [T.STRING, T.INT, T.DOUBLE, T.BOOL, T.TIMESTAMP, T.STRING, T.STRING, T.DYN, T.DOUBLE, T.INT, T.STRING, T.list_of(T.INT)]
    assert f("map") == T.map_of(T.STRING, T.DOUBLE) and f("bare") == T.map_of(T.STRING, T.DYN) and f("any") == T.list_of(T.DYN) and f("ref").field_type("a") == T.STRING and f("all").field_type("b") == T.INT and f("all").field_type("a") == T.STRING
    with pytest.raises(SchemaFault):
        m({"$ref": "#/$defs/A", "$defs": {"A": {"$ref": "#/$defs/A"}}})


def test_json_payloads(spark):
    schema = map_json({"type": "object", "properties": {"name": {"type": "string", "minLength": 2}, "count": {"type": "integer", "minimum": 0}, "active": {"type": "boolean"}, "tags": {"type": "array", "items": {"type": "string"}}, "kind": {"enum": ["a", "b"]}}, "required": ["name", "count"], "additionalProperties": False})
    payloads = ['{"name": "ab", "count": 1, "active": true, "tags": ["x"], "kind": "a"}', '{"name": "ab", "count": 2}', '{"count": 1}', '{"name": 5, "count": 1}', '{"name": "ab", "count": "1"}', '{"name": "ab", "count": -1}', '{"name": "a", "count": 1}', '{"name": "ab", "count": 1, "kind": "z"}', '{"name": "ab", "count": 1, "more": 1}', '{"name": "ab", "count": 1, "tags": [1]}', '{"name": "ab", "count": 1.5}', "nope", "[1]"]
    df = spark.createDataFrame([(i, p.encode()) for i, p in enumerate(payloads)], "i int, payload binary")
    event, problem = decode.json_event(F.col("payload"), schema)
    out = {r.i: (r.event, r.problem) for r in df.select("i", event.alias("event"), problem.alias("problem")).collect()}
    assert [i for i, (_, p) in out.items() if p is None] == [0, 1] and out[0][0]["count"] == 1
    assert all(e is None for e, p in out.values() if p is not None)


def test_registry_and_unified_reader(spark, tmp_path):
    r = Registry(spark, f"{tmp_path}/schemas")
    declared = {"columns": [{"name": "id", "expr": "event.order_id", "field_id": 1}, {"name": "big", "expr": "event.amount > 10.0", "field_id": 2}]}
    r.register(1, "avro", json.dumps({**AVRO, "x-pipeline": declared}))
    r.register(2, None, json.dumps({"type": "object", "title": "J", "properties": {"order_id": {"type": "string"}}, "required": ["order_id"]}))
    with pytest.raises(SchemaExists):
        r.register(1, "avro", json.dumps(AVRO))
    again = Registry(spark, f"{tmp_path}/schemas")
    assert again.ids() == [1, 2] and again.get(1).pipeline.column_names == ["id", "big"] and again.get(2).kind == "json"
    with pytest.raises(SchemaNotFound):
        again.get(9)
    rows = spark.createDataFrame([(1, encoded()), (2, b'{"order_id": "j"}'), (2, b"{}"), (7, b"?"), (None, b"?")], "_schema_id long, payload binary")
    out = sorted(((x._schema_id, x.event, x._decode_error) for x in decode.as_variant(rows, again).collect()), key=repr)
    assert len(out) == 5 and sum(e is not None for _, e, _ in out) == 2 and sum("unknown schema" in (p or "") for _, _, p in out) == 2
    part = decode.by_schema(rows, again)[1]
    assert [tuple(x) for x in again.get(1).pipeline.ok_rows(part.withColumns({n: F.lit(None) for n in ("_event_id", "_event_type")})).collect()] == [("o-1", True)]


def test_envelope_names(spark):
    df = spark.createDataFrame([(bytearray(b"id"), "k", 7, (3,))], "_event_id binary, _event_type string, _lsn long, event struct<n:long>")
    t = T.object_of("e", {"n": T.INT})
    p = compile_pipeline(from_dict({"columns": [{"name": "x", "expr": "event.n + _lsn", "field_id": 1}], "filter": '_event_type == "k"'}), scope_of(t))
    assert p.ok_rows(df).first().x == 10
    assert str(scope_of(t, {"event": T.STRING})["event"].type) == "e"  # the event can't be shadowed


def test_hash_vectors(spark):
    assert partitioning.murmur3_32([b"iceberg", b"", None, b"abcd"]).tolist()[:3] == [1210000089, 0, 0]
    row = spark.sql("select 34L l, 'iceberg' s, timestamp'2017-11-16 22:31:08' ts, true b, date'2017-11-16' d, 1.0D f, -0.0D z, 0.0D p")
    out = row.select(partitioning.hash_long(F.col("l")).alias("l"), partitioning.hash_bytes(F.col("s")).alias("s"), partitioning._bucket_hash(F.col("ts"), S.TimestampType()).alias("ts"), partitioning._bucket_hash(F.col("d"), S.DateType()).alias("d"), partitioning._bucket_hash(F.col("f"), S.DoubleType()).alias("f"), partitioning._bucket_hash(F.col("z"), S.DoubleType()).alias("z"), partitioning._bucket_hash(F.col("p"), S.DoubleType()).alias("p")).first()
    assert (out.l, out.s, out.ts, out.d) == (2017239379, 1210000089, -2047944441, -653330422) and out.z == out.p
    assert spark.range(1).select(partitioning.bucket(F.lit(34).cast("long"), S.LongType(), 0)).first()[0] == 0


def test_transforms(spark):
    df = spark.sql("select timestamp'2024-12-19 10:30:00' a, timestamp'1969-12-31 23:30:00' b, cast(null as timestamp) c")
    cell = lambda name, c: [x.alias(f"{name}_{c}_{i}") for i, x in enumerate(partitioning.transform(name, F.col(c), S.TimestampType(), 0))]
    row = df.select(*[x for n in ("year", "month", "day", "hour", "void") for c in "abc" for x in cell(n, c)]).first()
    assert [row[f"{n}_a_0"] for n in ("year", "month", "day", "hour", "void")] == ["2024", "2024-12", "2024-12-19", "2024-12-19-10", ""]
    assert [row[f"{n}_a_1"] for n in ("year", "month", "day", "hour")] == [54, 659, 20076, 481834] and [row[f"{n}_b_1"] for n in ("year", "month", "day", "hour")] == [-1, -1, -1, -1]
    assert all(row[f"{n}_c_0"] == "" and row[f"{n}_c_1"] is None for n in ("year", "month", "day", "hour"))
    one = spark.range(1).select(partitioning.truncate(F.lit(-999).cast("long"), S.LongType(), 100).alias("t"), partitioning.truncate(F.lit("éab"), S.StringType(), 2).alias("s"), partitioning.escape(F.lit("a/b=c%\n")).alias("e")).first()
    assert (one.t, one.s, one.e) == (-1000, "éa", "a%2Fb%3Dc%25%0A")
    moments = spark.createDataFrame([(-1,), (99_999_999_999,), (100_000_000_000,), (99_999_999_999_999,), (100_000_000_000_000,)], "v long").select(F.unix_micros(partitioning.as_time(F.col("v"), S.LongType()))).collect()
    assert [r[0] for r in moments] == [-1_000_000, 99_999_999_999_000_000, 100_000_000_000_000, 99_999_999_999_999_000, 100_000_000_000_000]
    texts = spark.createDataFrame([("2024-01-02T03:04:05Z",), ("2024-01-02T03:04:05.5+01:00",), ("2024-01-02 03:04:05",), ("2024-01-02",), ("x",)], "v string").select(partitioning.as_time(F.col("v"), S.StringType())).collect()
    assert [r[0] for r in texts] == [dt.datetime(2024, 1, 2, 3, 4, 5), dt.datetime(2024, 1, 2, 2, 4, 5, 500000), dt.datetime(2024, 1, 2, 3, 4, 5), dt.datetime(2024, 1, 2), None]


def layout(spark):
    df = spark.createDataFrame([(i, dt.datetime(2024, 1, 1 + i % 3, i % 24), f"k{i % 2}/x") for i in range(40)], "id long, ts timestamp, kind string")
    config = from_dict({"columns": [{"name": "id", "expr": "event.id", "field_id": 1}, {"name": "ts", "expr": "event.ts", "field_id": 2}, {"name": "kind", "expr": "event.kind", "field_id": 3}], "partition_spec": [{"source_id": 2, "field_id": 1000, "transform": "day", "name": "day"}, {"source_id": 3, "field_id": 1001, "transform": "void", "name": "nothing"}], "sort_order": [{"source_id": 1, "direction": "desc"}]})
    return df, compile_pipeline(config, scope_of_frame(df))


def test_sink(spark, tmp_path):
    df, p = layout(spark)
    rows = p.ok_rows(df)
    paths = {r._partition_path for r in sink.with_paths(rows, p).collect()}
    assert paths == {"day=2024-01-01", "day=2024-01-02", "day=2024-01-03"}
    sink.write(rows, p, f"{tmp_path}/out", mode="overwrite")
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.count() == 40 and set(back.columns) == {"id", "ts", "kind", "day"}
    assert json.loads(sink.table_schema(spark, f"{tmp_path}/out")) == json.loads(p.iceberg_schema()) and sink.table_schema(spark, str(tmp_path)) is None
    summed = {"/" + r.object_key.removeprefix("file:").lstrip("/"): r.checksum for r in sink.manifest(spark, f"{tmp_path}/out", 4, checksums=True).collect()}
    assert summed == {str(f): hashlib.sha256(f.read_bytes()).hexdigest() for f in tmp_path.glob("out/*/*.parquet")}
    files = sink.manifest(spark, f"{tmp_path}/out", 4).collect()
    assert len(files) == 3 and sum(f.row_count for f in files) == 40 and all(f.schema_id == 4 for f in files)
    import pyarrow.parquet as pq

    f = pq.ParquetFile(files[0].object_key.removeprefix("file://"))
    assert f.schema_arrow.field("id").metadata[b"PARQUET:field_id"] == b"1"
    ids = f.read().column("id").to_pylist()
    assert ids == sorted(ids, reverse=True)


def test_log(spark, tmp_path):
    events = spark.createDataFrame([(b"1", "k", 0, b"p", 1), (b"2", "k", 1_700_000_000_000_000, b"q", 1)], "event_id binary, event_type string, occurred_at long, payload binary, schema_id long")
    assert ingest.append(events, f"{tmp_path}/log", 1) == {"success": True, "count": 2, "committed_lsn": 1}
    ingest.append(events, f"{tmp_path}/log", 2)
    ingest.append(events, f"{tmp_path}/log", 2)  # a retry
    assert ingest.append(events.limit(0), f"{tmp_path}/log", 3)["count"] == 0
    rows = ingest.log(spark, f"{tmp_path}/log")
    assert rows.count() == 4 and ingest.record_at(rows, 2).count() == 2 and ingest.truncated(rows, 1).count() == 2 and ingest.truncated(rows, 0).count() == 0 and ingest.scan_from(rows, 2).count() == 2 and ingest.scan_from(rows, 1, True).count() == 2 and ingest.without_range(rows, 1, 1).count() == 2
    assert rows.where("_occurred_at > '2024-01-01'").count() == 2
    with pytest.raises(ingest.BatchTooLarge):
        ingest.append(events, f"{tmp_path}/log", 4, limit=1)
    assert (ingest.health(False, None), ingest.health(False, "n"), ingest.health(True, None)) == ("degraded", "healthy", "healthy")


def test_frames(spark):
    f = lambda b: struct.pack("<I", len(b)) + b
    df = spark.createDataFrame([(1, f(b"a") + f(b"bc") + f(b"")), (2, b"\x05\0"), (3, f(b"abc")[:-1]), (4, None)], "i int, raw binary")
    assert [(r.i, r._ordinal, bytes(r._frame)) for r in avro.explode_frames(df, "raw").orderBy("i", "_ordinal").collect()] == [(1, 0, b"a"), (1, 1, b"bc"), (1, 2, b"")]
    assert avro.explode_frames(df, "raw", 2).count() == 2
    assert bytes(spark.range(1).select(avro.join_frames(F.array(F.lit(bytearray(b"a")), F.lit(bytearray(b"bc")), F.lit(bytearray())))).first()[0]) == f(b"a") + f(b"bc") + f(b"")


SEGMENT = "segment_id long, state int, last_index long, sealed_term long"
U, W, X = 2, 1, 3


@pytest.mark.parametrize(("rows", "safe"), [
    ([], (0, 0)), ([(0, U, 100, 1)], (100, 1)), ([(0, U, 100, 1), (1, U, 200, 1), (2, U, 300, 2)], (300, 2)), ([(0, W, 100, 1)], (0, 0)), ([(0, U, 100, 1), (1, W, 200, 1)], (100, 1)), ([(0, U, 100, 1), (2, U, 300, 1)], (100, 1)),
    ([(0, U, 100, 1), (1, W, 200, 1), (2, U, 300, 1)], (100, 1)), ([(1, U, 200, 1), (2, U, 300, 2)], (300, 2)), ([(5, U, 500, 1), (6, U, 600, 1), (8, U, 800, 1)], (600, 1)), ([(0, U, 100, 1), (1, X, 200, 1)], (100, 1)),
])
def test_safe_index(spark, rows, safe):
    assert tuple(lifecycle.safe_gc(spark.createDataFrame(rows, SEGMENT)).first()) == safe


def test_cleanup_and_indices(spark):
    s = spark.createDataFrame([(0, U, 100, 1), (1, U, 200, 1), (2, W, 300, 1), (3, U, 400, 1)], SEGMENT)
    ids = lambda d: sorted(r.segment_id for r in d.collect())
    assert ids(lifecycle.cleanup(s, 150)) == [1, 2, 3] and ids(lifecycle.cleanup(s, 900)) == [2, 3] and ids(lifecycle.cleanup(s, 0)) == [0, 1, 2, 3]
    one = spark.range(1).select(*[lifecycle.snapshot_index(F.lit(a), F.lit(b)).alias(f"s{i}") for i, (a, b) in enumerate([(200, 400), (0, 400), (300, 200)])], *[lifecycle.capped_delete(F.lit(a), F.lit(b)).alias(f"d{i}") for i, (a, b) in enumerate([(50, 40), (50, 60), (50, 0)])], lifecycle.advance(F.lit(5), F.lit(3)).alias("a"), lifecycle.assign(F.lit(4).cast("long"), ["x", "y", "z"]).alias("n")).first()
    assert tuple(one) == (200, 400, 200, 40, 50, 0, 5, "y")


def test_fold_of_commands(spark):
    def c(i, kind, seg, node="n1", last=0, reason=None):
        return (i, 1, kind, seg, node, 0, last, 1, 1, 5, reason)

    commands = spark.createDataFrame([
        c(1, "SEALED", 0, last=100), c(2, "SEALED", 1, last=200), c(3, "SEALED", 2, last=300), c(4, "UPLOADED", 0), c(5, "UPLOADED", 2), c(6, "UPLOADED", 1), c(7, "UPLOADED", 9), c(8, "APPEND", 0),
        c(10, "SEALED", 3), c(11, "REASSIGNED", 3, "n1"), c(12, "REASSIGNED", 3, "n2"), c(13, "FAILED", 3, "n2", reason="bad"), c(14, "FAILED", 3, "n3", reason="again"), c(15, "REASSIGNED", 3, "n4"), c(16, "SEALED", 3, "n9"), c(20, "SEALED", 4), c(21, "UPLOADED", 4), c(22, "FAILED", 4),
    ], "log_index long, log_term long, kind string, segment_id long, node string, first_index long, last_index long, byte_size long, entry_count long, sealed_at long, reason string")
    out = {r.segment_id: r for r in lifecycle.fold(commands).collect()}
    assert set(out) == {0, 1, 2, 3, 4} and all(out[i].state == lifecycle.UPLOADED for i in (0, 1, 2, 4))
    assert (out[3].state, out[3].assigned_to, out[3].attempt_count, out[3].failure_reason) == (lifecycle.FAILED, "n2", 1, "bad")
    for upto, safe in ((4, 100), (5, 100), (6, 300)):
        assert lifecycle.safe_gc(lifecycle.fold(commands.where((F.col("log_index") <= upto) & (F.col("segment_id") < 3)))).first().safe_index == safe


def test_stalls_and_retention(spark):
    minute = 60_000_000
    s = spark.createDataFrame([(1, 1, "a", 0, 2), (2, 1, "a", 0, 0), (3, 1, "a", 9 * minute, 0), (4, 2, "a", 0, 0)], "segment_id long, state int, assigned_to string, sealed_at long, attempt_count int").withColumn("assigned_at", F.lit(None).cast("long"))
    out = {r.segment_id: (r.kind, r.node, r.reason) for r in lifecycle.stall_commands(s, ["b", "a"], 10 * minute, minute * 5, 2).collect()}
    assert out == {1: ("FAILED", "a", "exceeded_max_reassignments"), 2: ("REASSIGNED", "b", "stall_detected")}
    assert lifecycle.stall_commands(s, ["a"], 10 * minute, minute * 5, 3).count() == 0
    ids = lambda **k: [r.segment_id for r in lifecycle.retention(s, 10 * minute, **k).collect()]
    assert ids(max_segments=2) == [1, 2] and ids(max_age_micros=5 * minute) == [1, 2, 4] and ids(max_age_micros=5 * minute, min_retained=2) == [1, 2] and ids() == []


def test_stream(spark, tmp_path):
    df, p = layout(spark)
    df.repartition(4).write.parquet(f"{tmp_path}/in")
    seen = []
    for expected in (40, 45):
        q = stream.run(stream.landing(spark, f"{tmp_path}/in", 2, "id long, ts timestamp, kind string"), p, f"{tmp_path}/table", f"{tmp_path}/cp", on_segment=seen.append)
        assert q.awaitTermination(120)
        data = spark.read.option("basePath", f"{tmp_path}/table/data").parquet(f"{tmp_path}/table/data/*")
        assert data.count() == expected and sum(s["ok"] for s in seen) == expected
        df.limit(5).write.mode("append").parquet(f"{tmp_path}/in")
    assert stream.segments(spark, f"{tmp_path}/table").agg(F.sum("total")).first()[0] == 45


def entries(spark, low, high, term=1):
    return spark.createDataFrame([(i, term, "command", dt.datetime(2024, 1, 1), str(i).encode()) for i in range(low, high + 1)], "index long, term long, type string, appended_at timestamp, data binary")


def test_log_store(spark, tmp_path):
    from tidewright.sources import log_store as ls

    t = ls.LogTable(spark, f"{tmp_path}/log")
    assert tuple(ls.first_last(t.read()).first()) == (0, 0)
    t.append(entries(spark, 1, 5), 1)
    t.append(entries(spark, 6, 9), 2)
    t.append(entries(spark, 6, 9), 2)  # a retry
    with pytest.raises(ls.LogGap):
        t.append(entries(spark, 11, 12), 3)
    with pytest.raises(ls.LogGap):
        t.append(entries(spark, 10, 10).unionByName(entries(spark, 12, 12)), 3)
    t.append(entries(spark, 8, 8, term=2), 3)  # replaces the end
    log = t.read()
    assert [(r["index"], r.term) for r in log.orderBy("index").collect()] == [*((i, 1) for i in range(1, 8)), (8, 2)]
    assert tuple(ls.first_last(log).first()) == (1, 8) and ls.get(log, 8).first().term == 2 and ls.get(log, 99).count() == 0
    assert ls.truncate_to(log, 3).count() == 3 and ls.truncate_to(log, 0).count() == 0 and ls.delete_range(log, 1, 4).count() == 4 and ls.delete_range(log, 5, 8).count() == 4
    with pytest.raises(ValueError, match="middle"):
        ls.delete_range(log, 3, 5)
    assert [tuple(r) for r in ls.gaps(log.where("index NOT IN (3, 4, 6)")).orderBy("last_index").collect()] == [(2, 5), (5, 7)] and ls.gaps(log).count() == 0
    t.backup_after(5, f"{tmp_path}/copy")
    assert spark.read.parquet(f"{tmp_path}/copy").count() == 3
    ls.snapshot(ls.first_last(log), f"{tmp_path}/snap")
    assert ls.restore(spark, f"{tmp_path}/snap").first().last_index == 8


def test_append_stream(spark, tmp_path):
    events = spark.createDataFrame([(b"1", "k", 5, b"p", 1)], "event_id binary, event_type string, occurred_at long, payload binary, schema_id long")
    events.write.parquet(f"{tmp_path}/in")
    for n in (1, 2):
        source = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
        assert stream.append_stream(source, f"{tmp_path}/log", f"{tmp_path}/cp").awaitTermination(120)
        assert sorted(r._lsn for r in ingest.log(spark, f"{tmp_path}/log").collect()) == list(range(1, n + 1))
        events.write.mode("append").parquet(f"{tmp_path}/in")


def segment_file(payloads, first_index=7):
    from tidewright.sources import segments as sg

    head = bytearray(sg.HEADER_SIZE)
    struct.pack_into(sg.HEADER, head, 0, 1, 10, 20, 64, len(payloads), 2, first_index)
    struct.pack_into("<I", head, sg.HEADER_SUM_AT, int(sg.crc32c([bytes(head[:56])])[0]))
    out = bytes(head)
    for p in payloads:
        body = struct.pack("<I", len(p)) + p
        out += struct.pack("<I", int(sg.crc32c([body])[0])) + body + sg.TRAILER
        out += b"\0" * (-len(out) % 8)
    return out + b"\0" * 64


def log_entry(index, data, term=3):
    return struct.pack("<QQBq", term, index, 0, 99) + bytes([len(data)]) + data + b"\0"


def test_segment_files(spark, tmp_path):
    from tidewright.sources import segments as sg

    assert sg.crc32c([b"123456789", b""]).tolist() == [0xE3069283, 0]
    whole = segment_file([log_entry(7, b"a"), log_entry(8, b""), b"?"])
    (tmp_path / "s").mkdir()
    (tmp_path / "s/000000001.wal").write_bytes(whole)
    (tmp_path / "s/000000002.wal").write_bytes(segment_file([log_entry(8, b"again", 4)], 8))
    rows = sg.read_segments(spark, f"{tmp_path}/s")
    assert sorted((r["index"] or 0, r.slot, r.first_index, bytes(r.data or b"")) for r in rows.collect()) == [(0, 2, 7, b""), (7, 0, 7, b"a"), (8, 0, 8, b"again"), (8, 1, 7, b"")]
    assert sorted((r["index"], r.term, bytes(r.data)) for r in sg.newest(rows).collect()) == [(7, 3, b"a"), (8, 4, b"again")]
    # A flipped bit anywhere ends the log before the record that it is in; a cut one before the cut.
    starts = [at for at, _ in sg.records(whole)] + [len(whole)]
    for at in range(sg.HEADER_SIZE, len(whole) - 64):
        bad = bytearray(whole)
        bad[at] ^= 1
        hit = sum(s <= at for s in starts) - 1
        end = starts[hit] + 8 + struct.unpack_from("<I", whole, starts[hit] + 4)[0] + 8
        assert len(sg.records(bytes(bad))) == (hit if at < end else 3)
    assert [len(sg.records(whole[:n])) for n in (64, starts[1], starts[2] + 5)] == [0, 1, 2]
    assert sg.header(whole[:63]) is None and sg.header(bytes([whole[0] ^ 1]) + whole[1:]) is None and sg.header(whole).entries == 3


def test_overlapping_append_holds_all_orders(spark, monkeypatch):
    from tidewright import queries
    from tidewright.sources import log_store as ls

    held, merged = [], ls.merged
    monkeypatch.setattr(ls, "merged", lambda h, b: held.append(h.count()) or merged(h, b))
    out = queries.QUERIES["log_overlapping_append"](spark, "/root/testdata/sf0.001")
    n = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").count()
    assert sorted(map(tuple, out.collect())) == [(i, int(i >= (n - 1) // 2)) for i in range(n - (n - 1) // 4)]
    assert held == [n]


def test_log_table_refuses_a_start_before_its_first_index_and_cuts_from_the_newest(spark, tmp_path):
    from tidewright.sources import log_store as ls

    t = ls.LogTable(spark, f"{tmp_path}/log")
    t.append(entries(spark, 5, 14), 1)
    with pytest.raises(ls.LogGap, match="starts at 5"):
        t.append(entries(spark, 4, 4), 2)
    t.append(entries(spark, 9, 11, term=2), 2)
    assert t.ends() == (5, 11)
    t.append(entries(spark, 7, 8, term=3), 3)
    assert [(r["index"], r.term) for r in t.read().orderBy("index").collect()] == [(5, 1), (6, 1), (7, 3), (8, 3)] and t.ends() == (5, 8)
    t.append(entries(spark, 7, 9, term=4), 3)  # another try of the newest batch
    assert [(r["index"], r.term) for r in t.read().orderBy("index").collect()] == [(5, 1), (6, 1), (7, 4), (8, 4), (9, 4)]
    with pytest.raises(ls.LogGap):
        t.append(entries(spark, 10, 10), 1)


@pytest.mark.parametrize("schema, good, bad", [
    ({"type": "object", "properties": {"a": {"oneOf": [{"type": "integer"}, {"minimum": 2}]}}}, ['{"a": 1}', '{"a": 2.5}', "{}"], ['{"a": 3}', '{"a": 1.5}']),
    ({"type": "object", "properties": {"a": {"not": {"type": "string"}}}}, ['{"a": 1}'], ['{"a": "x"}']),
    ({"type": "object", "properties": {"a": {"$ref": "#/$defs/n"}}, "$defs": {"n": {"type": "array", "uniqueItems": True, "items": {"type": "array", "items": {"const": "ü"}}}}}, ['{"a": []}', '{"a": [["ü"], []]}'], ['{"a": [["u"]]}', '{"a": [[], []]}']),
    ({"type": "object", "properties": {"it's": {"type": "null"}}, "additionalProperties": {"type": "integer"}, "maxProperties": 2}, ['{"it\'s": null, "b": 2}'], ['{"it\'s": 1}', '{"b": "x"}', '{"b": 1, "c": 1, "d": 1}']),
    ({"type": "object", "properties": {"a": {"type": "string"}, "b": {"type": "integer"}}, "if": {"required": ["a"]}, "then": {"required": ["b"]}, "else": {"maxProperties": 0}}, ["{}", '{"a": "x", "b": 1}'], ['{"a": "x"}', '{"b": 1}']),
])
def test_json_schema_keywords(spark, schema, good, bad):
    df = spark.createDataFrame([(x,) for x in [*good, *bad]], "payload string")
    _, problem = decode.json_event(F.col("payload"), map_json(schema))
    assert [r.p for r in df.select(problem.isNull().alias("p")).collect()] == [True] * len(good) + [False] * len(bad)


def test_columns_without_field_ids_and_formats():
    cleaned, config = extract(json.dumps({"type": "record", "name": "Event", "x-pipeline": {"columns": [{"name": "id", "expr": "event.id"}]}}))
    assert "x-pipeline" not in cleaned and config.column_names == ["id"] and config.columns[0].field_id is None
    with pytest.raises(ConfigError, match="schema format"):
        from_dict({"columns": COLUMNS, "schema_format": "xml"}).check()
    with pytest.raises(ConfigError, match="no parameter"):
        from_dict({"columns": COLUMNS, "sort_order": [{"source_id": 1, "transform": "bucket"}]}).check()


#: Fixed value: an entry laid out by hand (id b"i", type "t", occurred_at 5, schema_id 9, one pair of metadata).
ENTRY_BYTES = bytes.fromhex(
    "18000000" "1400" "2000" "0400" "0800" "1000" "0000" "0000" "0000" "1800" "1c00"  # root 24; vtable at 4: 20 bytes, table of 32, fields
    "14000000" "1c000000" "20000000" "00000000" "0500000000000000" "09000000" "14000000"  # table at 24
    "01000000" "69000000" "01000000" "74000000" "01000000" "0c000000" "0800" "0c00" "0400" "0800" "08000000" "08000000" "0c000000" "01000000" "6b000000" "01000000" "76000000"
)


def test_log_entries(spark):
    from tidewright.sources import entries as en

    event, error = en.decode_one(ENTRY_BYTES)
    assert error is None and event == {"event_id": b"i", "event_type": "t", "occurred_at": 5, "ingested_at": 0, "payload": None, "compression": "none", "schema_id": 9, "metadata": [{"key": "k", "value": b"v"}]}
    import random

    r = random.Random(3)
    raw = lambda: r.choice([None, b"", r.randbytes(r.randint(1, 30))])
    for _ in range(300):
        e = {"event_id": raw(), "event_type": r.choice([None, "", "click", "é漢"]), "occurred_at": r.choice([0, 2**62, 17]), "ingested_at": r.choice([0, 1]), "payload": raw(), "compression": r.choice(en.COMPRESSION), "schema_id": r.choice([0, 2**32 - 1]), "metadata": [{"key": r.choice(["k", ""]), "value": raw()} for _ in range(r.randint(0, 4))]}
        data = en.encode_one(e)
        assert en.decode_one(data) == (e, None)
        for cut in range(0, len(data), 3):
            en.decode_one(data[:cut])  # an error or a shorter event, never an exception
        broken = bytearray(data)
        broken[r.randrange(len(broken))] ^= 1 << r.randrange(8)
        en.decode_one(bytes(broken))
    df = spark.createDataFrame([(ENTRY_BYTES,), (b"x",), (None,)], "data binary")
    assert [x.d.error for x in df.select(en.decoder(F.col("data")).alias("d")).collect()] == [None, "decoding failed: too short", "no entry"]
