"""Segment lifecycle as operations on tables.

``commands``: log_index, log_term, kind (SEALED, UPLOADED, REASSIGNED, FAILED, or anything else, which does
nothing), segment_id, node, first_index, last_index, byte_size, entry_count, sealed_at, reason.
``segments``: segment_id, state, assigned_to, first_index, last_index, byte_size, entry_count, sealed_at,
assigned_at, sealed_term, attempt_count, failure_reason.

The fold of commands orders each segment's few commands by log index and applies them in one expression; one
shuffle by segment.  The safe index needs the order of all segments: that window is over the table of segments
(one row for each), with the heavy part, which are the rows up to the first gap, found by a minimum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SEALED, UPLOADED, FAILED = 1, 2, 3

SEGMENT_COLUMNS = ("segment_id", "state", "assigned_to", "first_index", "last_index", "byte_size", "entry_count", "sealed_at", "assigned_at", "sealed_term", "attempt_count", "failure_reason")
_STATE = "struct<state:int,assigned_to:string,first_index:bigint,last_index:bigint,byte_size:bigint,entry_count:bigint,sealed_at:bigint,assigned_at:bigint,sealed_term:bigint,attempt_count:int,failure_reason:string>"


def fold(commands: DataFrame) -> DataFrame:
    """The state of each segment after all commands.  The first SEALED makes a segment; later ones, and
    commands for segments that aren't there, change nothing."""
    fields = ("log_index", "kind", "node", "first_index", "last_index", "byte_size", "entry_count", "sealed_at", "log_term", "reason")
    each = commands.where(F.col("kind").isin("SEALED", "UPLOADED", "REASSIGNED", "FAILED")).groupBy("segment_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("c"))
    nothing = F.lit(None).cast(_STATE)

    def changed(s: Column, **new: Column) -> Column:
        for name, value in new.items():
            s = s.withField(name, value)
        return s

    def apply(s: Column, c: Column) -> Column:
        made = F.struct(
            F.lit(SEALED).alias("state"), c["node"].alias("assigned_to"), c["first_index"].cast("bigint").alias("first_index"), c["last_index"].cast("bigint").alias("last_index"), c["byte_size"].cast("bigint").alias("byte_size"),
            c["entry_count"].cast("bigint").alias("entry_count"), c["sealed_at"].cast("bigint").alias("sealed_at"), c["sealed_at"].cast("bigint").alias("assigned_at"), c["log_term"].cast("bigint").alias("sealed_term"), F.lit(0).alias("attempt_count"), F.lit("").alias("failure_reason"),
        ).cast(_STATE)
        moved = changed(s, assigned_to=c["node"], attempt_count=s["attempt_count"] + 1, assigned_at=F.coalesce(c["sealed_at"].cast("bigint"), s["assigned_at"]))
        failed = changed(s, state=F.lit(FAILED), failure_reason=c["reason"], assigned_to=F.coalesce(c["node"], s["assigned_to"]))
        return (
            F.when(s.isNull(), F.when(c["kind"] == "SEALED", made).otherwise(nothing))
            .when((c["kind"] == "UPLOADED") & (s["state"] != UPLOADED), changed(s, state=F.lit(UPLOADED)))
            .when((c["kind"] == "REASSIGNED") & (s["state"] == SEALED) & ~s["assigned_to"].eqNullSafe(c["node"]), moved)
            .when((c["kind"] == "FAILED") & (s["state"] == SEALED), failed)
            .otherwise(s)
        )

    done = each.select("segment_id", F.aggregate("c", nothing, apply).alias("s")).where("s IS NOT NULL")
    return done.select("segment_id", "s.*").select(*SEGMENT_COLUMNS)


def lookup(segments: DataFrame, segment_id: int) -> DataFrame:
    return segments.where(F.col("segment_id") == segment_id)


def sealed(segments: DataFrame, node: str | None = None) -> DataFrame:
    """Sealed segments, of one node if it is given, by id."""
    out = segments.where(F.col("state") == SEALED)
    return (out if node is None else out.where(F.col("assigned_to") == node)).orderBy("segment_id")


def for_node(segments: DataFrame, node: str) -> DataFrame:
    return segments.where(F.col("assigned_to") == node).orderBy("segment_id")


def _prefix(segments: DataFrame) -> DataFrame:
    """Segments of the longest run of consecutive ids from the smallest on that are all uploaded.

    The run ends at the smallest id that is not uploaded or whose predecessor is missing.  Predecessors are found
    by a join on id, so no window needs all segments in one task."""
    ids = segments.select((F.col("segment_id") + 1).alias("next_id"))
    first = segments.agg(F.min("segment_id")).scalar()
    known = segments.join(ids, segments["segment_id"] == ids["next_id"], "left")
    broken = (F.col("state") != UPLOADED) | (F.col("next_id").isNull() & (F.col("segment_id") != first))
    end = known.where(broken).agg(F.min("segment_id")).scalar()
    return segments.where(F.coalesce(F.col("segment_id") < end, F.lit(True)))


def safe_gc(segments: DataFrame) -> DataFrame:
    """One row: the last index and term up to which everything is uploaded; 0 and 0 if nothing is."""
    last = _prefix(segments).agg(F.max_by(F.struct("last_index", "sealed_term"), "segment_id").alias("s"))
    return last.select(F.coalesce("s.last_index", F.lit(0)).cast("long").alias("safe_index"), F.coalesce("s.sealed_term", F.lit(0)).cast("long").alias("safe_term"))


def cleanup(segments: DataFrame, safe_index: int) -> DataFrame:
    """What is left when the leading uploaded segments up to the safe index are deleted: from the first segment
    on that is not uploaded or ends beyond it."""
    stays = segments.where((F.col("state") != UPLOADED) | (F.col("last_index") > safe_index)).agg(F.min("segment_id")).scalar()
    return segments.where(F.col("segment_id") >= stays)


def advance(held: Column, new: Column) -> Column:
    """An index that only moves forward."""
    return F.greatest(F.coalesce(held, F.lit(0)), F.coalesce(new, F.lit(0)))


def capped_delete(upper: Column, safe: Column) -> Column:
    """How far a log may be deleted: to the safe index at most; nothing while that is 0."""
    return F.when(safe > 0, F.least(upper, safe)).otherwise(F.lit(0))


def snapshot_index(safe: Column, applied: Column) -> Column:
    return F.when((safe > 0) & (safe <= applied), safe).otherwise(applied)


def stalled(segments: DataFrame, now_micros: int, timeout_micros: int = 300_000_000) -> DataFrame:
    """Sealed segments whose last assignment is at least the timeout ago."""
    since = F.coalesce(F.col("assigned_at"), F.col("sealed_at"))
    return segments.where((F.col("state") == SEALED) & (since <= now_micros - timeout_micros))


def stall_commands(segments: DataFrame, nodes: list[str], now_micros: int, timeout_micros: int = 300_000_000, max_attempts: int = 3) -> DataFrame:
    """What to do about stalled segments: fail those that were moved often enough, move others to the first
    other node; those without another node stay as they are."""
    late = stalled(segments, now_micros, timeout_micros)
    others = F.filter(F.array(*[F.lit(n) for n in sorted(nodes)]).cast("array<string>"), lambda n: ~n.eqNullSafe(F.col("assigned_to")))
    give_up = F.col("attempt_count") >= max_attempts
    out = late.select(
        "segment_id",
        F.when(give_up, F.lit("FAILED")).otherwise(F.lit("REASSIGNED")).alias("kind"),
        F.when(give_up, F.col("assigned_to")).otherwise(F.get(others, F.lit(0))).alias("node"),
        F.when(give_up, F.lit("exceeded_max_reassignments")).otherwise(F.lit("stall_detected")).alias("reason"),
    )
    return out.where((F.col("kind") == "FAILED") | F.col("node").isNotNull())


def deletable(segments: DataFrame, compacted: int) -> DataFrame:
    """Sealed log segments with entries that end at or before the compacted index."""
    return segments.where((F.col("entry_count") > 0) & (F.col("last_index") <= compacted))


def retention(segments: DataFrame, now_micros: int, max_segments: int = 0, max_age_micros: int = 0, min_retained: int = 0) -> DataFrame:
    """Segments to delete, oldest first: those beyond the newest ``max_segments``, if that is set and exceeded,
    else those older than ``max_age_micros``; the newest ``min_retained`` always stay.

    Places are counted from the newest; the window needs one order of all segments, a control table."""
    place = F.row_number().over(Window.orderBy(F.desc("segment_id")))
    total = F.count(F.lit(1)).over(Window.partitionBy())
    too_many = (F.lit(max_segments) > 0) & (total > max_segments)
    old = (F.lit(max_age_micros) > 0) & (F.col("sealed_at") <= now_micros - max_age_micros)
    numbered = segments.withColumn("__place", place).withColumn("__go", F.when(too_many, F.col("__place") > max_segments).otherwise(old) if max_segments > 0 else old)
    return numbered.where(F.col("__go") & (F.col("__place") > min_retained)).drop("__place", "__go").orderBy("segment_id")


def locate(segments: DataFrame, log_index: Column | int) -> DataFrame:
    """The segment that holds a log index, and the place in it."""
    k = log_index if isinstance(log_index, Column) else F.lit(log_index)
    return segments.where((F.col("first_index") <= k) & (k < F.col("first_index") + F.col("entry_count"))).withColumn("slot", k - F.col("first_index"))


def assign(segment_id: Column, nodes: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in nodes]), (F.pmod(segment_id, F.lit(len(nodes))) + 1).cast("int"))


def command_rows(segments: DataFrame, kind: str, log_index: Column, log_term: Column, reason: str | None = None) -> DataFrame:
    """Commands of one kind for the rows of a segment table."""
    return segments.select(log_index.cast("long").alias("log_index"), log_term.cast("long").alias("log_term"), F.lit(kind).alias("kind"), "segment_id", F.col("assigned_to").alias("node"), "first_index", "last_index", "byte_size", "entry_count", "sealed_at", F.lit(reason).cast("string").alias("reason"))
