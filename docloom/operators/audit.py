"""Audit log: hash chains, statistics, bursts."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from datetime import timedelta

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType
from pyspark.sql.window import Window

from docloom.operators.retrieval import role_clearance

# Order of the hashed fields and the first link.
FIELDS = ("event_id", "created_at", "request_id", "event_type", "severity", "user_id", "action", "resource_type", "resource_id", "authorization_result", "query_fingerprint")
GENESIS = "GENESIS"
EVENT_TYPES = {"error": "auth_login_failure", "signup": "auth_register", "purchase": "document_read", "view": "rag_query", "click": "document_compared"}


def from_events(events: DataFrame) -> DataFrame:
    """AUD-06/07: audit rows of the events table."""
    kinds = F.create_map(*[F.lit(x) for kv in EVENT_TYPES.items() for x in kv])
    return events.select(
        F.col("event_id"), F.col("ts").cast("timestamp").alias("created_at"), F.concat(F.lit("req-"), F.col("event_id").cast("string")).alias("request_id"), F.element_at(kinds, F.col("event_type")).alias("event_type"),
        F.when(F.col("event_type") == "error", "WARNING").otherwise("INFO").alias("severity"), "user_id", F.col("event_type").alias("action"), F.lit("session").alias("resource_type"),
        F.col("user_id").cast("string").alias("resource_id"), F.when(F.col("event_type") == "error", "denied").otherwise("granted").alias("authorization_result"), F.lit(None).cast("string").alias("query_fingerprint"),
    )


def payload() -> Column:
    """The hashed fields before the previous link: time to the second, null as empty."""
    texts = [F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss") if f == "created_at" else F.col(f).cast("string") for f in FIELDS]
    return F.concat_ws("|", *[F.coalesce(t, F.lit("")) for t in texts])


def event_hash(previous: Column) -> Column:
    """AUD-01."""
    return F.sha2(F.concat_ws("|", payload(), F.coalesce(F.nullif(previous, F.lit("")), F.lit(GENESIS))), 256)


def _in_order(rows: DataFrame, by: str, step: Callable, more: list[StructField]) -> DataFrame:
    """rows in order of time within each `by`, folded row by row: a task carries one state, never a group.

    step(state, row) of the state before (None at a chain's begin) and a row's (created_at, event_id, further
    columns) gives the new state and the values of `more`.
    """
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, last, begun = None, None, False
        for b in batches:
            made = []
            for key, row in zip(b.column(names.index(by)).to_pylist(), b.to_pylist()):
                if not begun or key != last:
                    state, last, begun = None, key, True
                state, values = step(state, row)
                made.append(values)
            new = [pa.array([m[i] for m in made], pa.bool_() if f.dataType == BooleanType() else pa.string()) for i, f in enumerate(more)]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], names=[*names, *(f.name for f in more)])

    ordered = rows.repartition(by).sortWithinPartitions(by, "created_at", "event_id")
    return ordered.mapInArrow(run, StructType([*rows.schema.fields, *more]))


def chain(events: DataFrame, by: str = "user_id", last: DataFrame | None = None) -> DataFrame:
    """AUD-03, SNK-13: previous and own hash of each row, a fold over each chain (each hash needs the one before).

    last(by, event_hash): the newest link of the chains that a stored log holds; they are continued.
    """
    rows = events.withColumn("_payload", payload())
    rows = rows.withColumn("_last", F.lit(None).cast("string")) if last is None else rows.join(last.select(by, F.col("event_hash").alias("_last")), by, "left")

    def step(previous, row):
        previous = previous or row["_last"]
        own = hashlib.sha256(f"{row['_payload']}|{previous or GENESIS}".encode()).hexdigest()
        return own, (previous, own)

    return _in_order(rows, by, step, [StructField("previous_event_hash", StringType()), StructField("event_hash", StringType())]).drop("_payload", "_last")


def newest(log: DataFrame, by: str = "user_id") -> DataFrame:
    """SNK-13: (by, event_hash) of each chain's newest row, for chain()."""
    return log.groupBy(by).agg(F.max_by("event_hash", F.struct("created_at", "event_id")).alias("event_hash"))


def verify(log: DataFrame, by: str = "user_id") -> DataFrame:
    """AUD-02: violations (event_id, kind): broken links and changed rows; the first link is not checked."""
    w = Window.partitionBy(by).orderBy("created_at", "event_id")
    rows = log.withColumn("expected", F.lag("event_hash").over(w)).withColumn("n", F.row_number().over(w))
    link = (F.col("n") > 1) & ~F.col("previous_event_hash").eqNullSafe(F.col("expected"))
    changed = ~event_hash(F.col("previous_event_hash")).eqNullSafe(F.col("event_hash"))
    kinds = F.array_compact(F.array(F.when(link, "broken_link"), F.when(changed, "changed_row")))
    return rows.select("event_id", F.explode(kinds).alias("kind"))


def sliding(events: DataFrame, key: str = "user_id", minutes: int = 10, threshold: int = 5) -> DataFrame:
    """AUD-04/05: events at which the last `minutes` hold at least `threshold` of their key."""
    w = Window.partitionBy(key).orderBy(F.unix_micros("created_at")).rangeBetween(-minutes * 60_000_000, 0)
    return events.withColumn("n", F.count("*").over(w)).where(F.col("n") >= threshold)


def bursts(events: DataFrame, key: str = "user_id", minutes: int = 10, threshold: int = 5) -> DataFrame:
    """AUD-04: as sliding(), one alert a key and window: suppressed while an alert stands in the last `minutes`."""
    over = sliding(events, key, minutes, threshold).select(key, "event_id", "created_at", "n")
    span = timedelta(minutes=minutes)

    def step(alert, row):
        fresh = alert is None or row["created_at"] - alert > span
        return (row["created_at"] if fresh else alert), (fresh,)

    return _in_order(over, key, step, [StructField("_alert", BooleanType())]).where("_alert").drop("_alert")


def identity(events: DataFrame, *columns: str) -> DataFrame:
    """AUD-04/05: events with a column identity, the first of the columns (user, e-mail, address) that is set; without any, no alert can name it."""
    return events.withColumn("identity", F.coalesce(*[F.nullif(F.col(c).cast("string"), F.lit("")) for c in columns])).where("identity is not null")


def principals(events: DataFrame, users: DataFrame) -> DataFrame:
    """AUD-06, JON-14: events with the actor's email, department, roles and clearance of users(user_id, email, department, roles).

    A known user without roles is an employee; an unknown one has none and no clearance.
    """
    out = events.join(users.select("user_id", "email", "department", "roles", F.lit(True).alias("_known")), "user_id", "left")
    none = F.expr("cast(array() as array<string>)")
    roles = F.when(F.col("_known"), F.when(F.size(F.coalesce("roles", none)) == 0, F.array(F.lit("Employee"))).otherwise(F.col("roles"))).otherwise(none)
    out = out.withColumn("roles", roles)
    return out.withColumn("clearance", F.when(F.col("_known"), role_clearance(F.col("roles")))).drop("_known")


def statistics(events: DataFrame) -> DataFrame:
    """AGG-01..03: one row, one pass."""
    return events.agg(
        F.count("*").alias("total"), F.count_if(F.col("severity") == "WARNING").alias("warnings"), F.count_if(F.col("authorization_result") == "denied").alias("denied"),
        F.count_distinct("user_id").alias("users"), F.count_distinct("resource_id").alias("resources"), F.round(F.count_if(F.col("authorization_result") == "denied") / F.count("*"), 6).alias("denied_share"),
    )


def by_type(events: DataFrame) -> DataFrame:
    """AGG-01: counts by type, by severity and in all."""
    return events.groupingSets([["event_type"], ["severity"], []], "event_type", "severity").agg(F.count("*").alias("n"))


def search(events: DataFrame, limit: int = 50, offset: int = 0, **equal) -> DataFrame:
    """FLT-07, RNK-12: newest first; limit is clamped to 1..100; `start` and `end` bound the time."""
    start, end = equal.pop("start", None), equal.pop("end", None)
    for c, v in equal.items():
        events = events.where(F.col(c) == v)
    if start is not None:
        events = events.where(F.col("created_at") >= F.lit(start).cast("timestamp"))
    if end is not None:
        events = events.where(F.col("created_at") <= F.lit(end).cast("timestamp"))
    return events.orderBy(F.desc("created_at"), F.desc("event_id")).offset(max(0, offset)).limit(min(100, max(1, limit)))


def latest(events: DataFrame, key: str = "user_id") -> DataFrame:
    """RNK-13."""
    return events.groupBy(key).agg(F.max_by("event_id", F.struct("created_at", "event_id")).alias("event_id"))
