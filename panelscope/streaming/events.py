"""The event operators on streams; results equal the batch form on ordered input."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import dims
from ..operators.events import dedup_consecutive, latest_preferences, micros, quota_flags, quota_windows
from ..session import exists, write_scratch
from ..sources.keyed import merge_keyed


def _fields(df: DataFrame, *names: str) -> list[T.StructField]:
    return [df.schema[n] for n in names]


def _millis(idle: str | None) -> int | None:
    return None if idle is None else int(pd.Timedelta(idle).total_seconds() * 1000)


def _timeout(idle: str | None) -> str:
    return GroupStateTimeout.NoTimeout if idle is None else GroupStateTimeout.EventTimeTimeout


USER_BUCKETS = 512  # groups that users are dealt to; constant while a stream lives


def _by_user(
    rows: DataFrame, user: str, ts: str, key: str, order: str, out: T.StructType, kept: list[T.StructField],
    step: Callable, idle: str | None, buckets: int,
) -> DataFrame:
    """Run ``step`` on the rows of each micro-batch with what is ``kept`` of their users.

    Users are dealt to ``buckets``, and a bucket is a group of its own with the states of
    its users, as a call for every user takes longer than its few rows. ``step`` gets a
    bucket's rows in the order of users, ``order`` and ``key``, the places of each user's
    first and last row, and what is kept of each (None: nothing); it returns the rows that
    go out and what to keep. With ``idle``, a user's state is forgotten once the watermark
    is that far past the user's newest row.
    """
    idle_ms, kind = _millis(idle), rows.schema[key].dataType
    whole = isinstance(kind, T.IntegralType)
    lists = [T.StructField("user", rows.schema[user].dataType), *kept, T.StructField("due", T.LongType())]
    held = T.StructType([T.StructField(f.name, T.ArrayType(f.dataType)) for f in lists])
    # whole numbers beside nulls would become floats: no user has a bucket of its own, no key is told by a flag
    bucket = F.when(F.col(user).isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64(user), F.lit(buckets)).cast("int"))
    dealt = rows.withColumns({"_bucket": bucket, "_none": F.col(key).isNull()})
    if whole:
        dealt = dealt.withColumn(key, F.coalesce(F.col(key), F.lit(0).cast(kind)))

    def run(group, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = {u: tuple(rest) for u, *rest in zip(*state.get)} if state.exists else {}
        now = None if idle_ms is None else state.getCurrentWatermarkMs()
        new: dict = {}
        found = None
        if not state.hasTimedOut:
            some = pd.concat(list(batches)).sort_values([user, order, "_none", key], ignore_index=True)
            codes, names = pd.factorize(some[user], use_na_sentinel=False)
            users = [None if group[0] < 0 else u for u in np.asarray(names).tolist()]
            first = np.flatnonzero(np.diff(codes, prepend=-1))
            last = np.append(first[1:], len(some)) - 1
            found, left = step(some, first, last, [known[u][:-1] if u in known else None for u in users])
            due = [0] * len(users)
            if now is not None:
                newest = some[ts].iloc[last].to_numpy().astype("datetime64[ms]").astype(np.int64)
                due = np.maximum(newest + idle_ms, now + 1).tolist()
            new = {u: (*v, d) for u, v, d in zip(users, left, due)}
        if now is not None:
            known = {u: v for u, v in known.items() if v[-1] >= now}
        known |= new
        if known:
            state.update((list(known), *(list(column) for column in zip(*known.values()))))
            if now is not None:
                state.setTimeoutTimestamp(max(min(v[-1] for v in known.values()), now + 1))
        elif state.exists:
            state.remove()
        if found is not None:
            if whole and found["_none"].any():
                found[key] = found[key].astype("Int64").mask(found["_none"])
            yield found[out.names]

    return dealt.groupBy("_bucket").applyInPandasWithState(run, out, held, "append", _timeout(idle))


def dedup_consecutive_stream(
    views: DataFrame, user: str = "user_id", ts: str = "ts", key: str = "event_id",
    value: str = "institution", *, late: str, idle: str | None, buckets: int = USER_BUCKETS,
) -> DataFrame:
    """Keep changes of the viewed value per user; state is the last value.

    A view more than ``late`` behind the newest one seen is dropped; other late views
    are ordered within their micro-batch only. With ``idle``, users idle longer than
    that in event time lose their state, and their next view counts as a change;
    with None state is kept for ever and rows equal the batch form. A task holds a
    micro-batch's views of one of ``buckets`` groups of users.
    """
    real = views.withWatermark(ts, late).where(F.col(value).isNotNull() & (F.col(value) != ""))
    out = T.StructType(_fields(views, key, user, ts, value))

    def changes(rows: pd.DataFrame, first: np.ndarray, last: np.ndarray, known: list) -> tuple[pd.DataFrame, list]:
        previous = rows[value].shift(1)
        previous.iloc[first] = [None if k is None else k[0] for k in known]
        return rows[rows[value] != previous].copy(), [(v,) for v in rows[value].iloc[last].tolist()]

    return _by_user(real.select(out.names), user, ts, key, ts, out, [T.StructField("last", T.StringType())], changes,
                    idle, buckets)


def quota_stream(
    requests: DataFrame, limit: int = dims.QUOTA_LIMIT, window_seconds: int = dims.QUOTA_SECONDS,
    user: str = "user_id", ts: str = "ts", key: str = "event_id",
    *, late: str, idle: str | None, buckets: int = USER_BUCKETS,
) -> DataFrame:
    """Quota flags on a stream; state per user is the open window and its count.

    ``late``, ``idle`` and ``buckets`` as in ``dedup_consecutive_stream``. ``idle`` must be
    longer than the quota window, so that expired state never differs from a window that
    has run out. Requests without a time are left out, as in the batch form.
    """
    width = window_seconds * 1_000_000
    out = T.StructType([*_fields(requests, key, user, ts),
                        T.StructField("window_start_us", T.LongType()),
                        T.StructField("accepted", T.BooleanType())])

    def admit(rows: pd.DataFrame, first: np.ndarray, last: np.ndarray, known: list) -> tuple[pd.DataFrame, list]:
        times = rows["_t"].to_numpy()
        starts, flags, left = np.empty(len(rows), np.int64), np.empty(len(rows), bool), []
        for a, b, held in zip(first.tolist(), (last + 1).tolist(), known):
            opened, used = held or (None, 0)
            starts[a:b], flags[a:b] = quota_windows(times[a:b], limit, width, opened, used)
            start = int(starts[b - 1])
            left.append((start, int((starts[a:b] == start).sum()) + (used if opened == start else 0)))
        return rows.assign(window_start_us=starts, accepted=flags), left

    timed = requests.withWatermark(ts, late).where(F.col(ts).isNotNull()).select(key, user, ts, micros(ts).alias("_t"))
    kept = [T.StructField("opened", T.LongType()), T.StructField("used", T.LongType())]
    return _by_user(timed, user, ts, key, "_t", out, kept, admit, idle, buckets)


STATE_BUCKETS = 16  # folders of a state table; constant while a stream lives


def _state_before(spark: SparkSession, path: str, schema: T.StructType, batch_id: int) -> DataFrame:
    """The state of every key as it was before a micro-batch, which may be run again.

    A row holds its key, what a micro-batch left (``now``), that batch's number and what
    was there before it (``before``).
    """
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    key, *fields = schema.names
    now = T.StructType(schema.fields[1:])
    stored = spark.read.schema(T.StructType([
        schema.fields[0], T.StructField("now", now), T.StructField("batch", T.LongType()),
        T.StructField("before", now)])).parquet(path)
    held = F.when(F.col("batch") < batch_id, F.col("now")).otherwise(F.col("before"))
    return stored.select(key, held.alias("h")).where(F.col("h").isNotNull()).select(key, "h.*")


def _keep_state(spark: SparkSession, path: str, new: DataFrame, known: DataFrame, batch_id: int) -> None:
    """Store ``new``, of the keys a micro-batch touched, beside what was ``known`` of them."""
    key, *fields = new.columns
    before = known.select(key, F.struct(*fields).alias("before"))
    rows = new.select(key, F.struct(*fields).alias("now"), F.lit(batch_id).cast("long").alias("batch")).join(
        before, key, "left")
    merge_keyed(spark, path, rows, [key], ["batch"], STATE_BUCKETS)


def dedup_sink(
    out: str, state: str, user: str = "user_id", ts: str = "ts", key: str = "event_id",
    value: str = "institution", idle: str | None = None,
):
    """A ``foreachBatch`` function: changes of the viewed value per user, appended below ``out``.

    Each micro-batch runs the batch operator, whose tasks are bounded whatever share of
    the views one user has; the last view of every user is kept by key in ``state``. A
    micro-batch that is run again starts from the state before it and writes its own
    folder again. Late views are ordered within their micro-batch. With ``idle``, a
    first view longer than that after the user's last one counts as a change.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        real = write_scratch(batch.where(F.col(value).isNotNull() & (F.col(value) != "")).select(
            key, user, ts, value), "views")
        fields = {f.name: f for f in real.schema.fields}
        known = write_scratch(_state_before(
            spark, state, T.StructType([fields[user], fields[value], fields[ts]]), batch_id), "known-views")
        last = known
        if idle is not None:
            first = real.groupBy(user).agg(F.min(ts).alias("_first"))
            gap = F.expr(f"INTERVAL {int(pd.Timedelta(idle).total_seconds())} SECONDS")
            last = known.join(first, user).where(F.col("_first") <= F.col(ts) + gap).drop("_first")
        # what was seen last comes before everything
        seen = last.select(F.lit(None).cast(fields[key].dataType).alias(key), user,
                           F.lit("0001-01-01").cast("timestamp").cast(fields[ts].dataType).alias(ts), value)
        changed = dedup_consecutive(real.unionByName(seen), user, ts, key, value).where(F.col(key).isNotNull())
        changed.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        newest = real.groupBy(user).agg(F.max_by(F.struct(value, ts), F.struct(ts, key)).alias("v"))
        _keep_state(spark, state, newest.select(user, "v.*"), known, batch_id)

    return run


def quota_sink(
    out: str, state: str, limit: int = dims.QUOTA_LIMIT, window_seconds: int = dims.QUOTA_SECONDS,
    user: str = "user_id", ts: str = "ts", key: str = "event_id",
):
    """A ``foreachBatch`` function: quota flags, appended below ``out``.

    As ``dedup_sink``; state per user is the open window and its requests so far.
    Requests from before the open window count as made at its opening.
    """
    kinds = [T.StructField("opened", T.LongType()), T.StructField("used", T.LongType())]

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        asked = write_scratch(batch.where(F.col(user).isNotNull()).select(key, user, ts), "requests")
        known = write_scratch(_state_before(
            spark, state, T.StructType([asked.schema[user], *kinds]), batch_id), "known-windows")
        quota_flags(asked, limit, window_seconds, user, ts, key, known).write.mode("overwrite").parquet(
            f"{out}/batch={batch_id}")
        flags = spark.read.parquet(f"{out}/batch={batch_id}")
        counts = flags.groupBy(user, F.col("window_start_us").alias("opened")).agg(F.count(F.lit(1)).alias("_n"))
        newest = counts.groupBy(user).agg(F.max(F.struct("opened", "_n")).alias("v")).select(user, "v.*")
        was = known.select(user, F.col("opened").alias("_was"), F.col("used").alias("_used"))
        more = F.when(F.col("opened") == F.col("_was"), F.col("_used")).otherwise(F.lit(0))
        _keep_state(spark, state, newest.join(was, user, "left").select(
            user, "opened", (F.col("_n") + F.coalesce(more, F.lit(0))).alias("used")), known, batch_id)

    return run


def usage_counts_stream(
    events: DataFrame, ts: str = "ts", every: str = "1 day", *, late: str
) -> DataFrame:
    """Events per time window and type, for update mode: a row each time a count grows."""
    return (
        events.withWatermark(ts, late).groupBy(F.window(ts, every).alias("w"), "event_type")
        .agg(F.count(F.lit(1)).alias("n_events"))
        .select(F.col("w.start").alias("window_start"), "event_type", "n_events")
    )


def usage_users_stream(
    events: DataFrame, ts: str = "ts", every: str = "1 day", user: str = "user_id", *, late: str
) -> DataFrame:
    """Events per time window, type and user, for update mode; ``distinct_users`` counts them.

    State is one number a user and window, dropped ``late`` after the window's end, so
    counts of users are exact and no user or window is one task's.
    """
    return (
        events.withWatermark(ts, late).groupBy(F.window(ts, every).alias("w"), "event_type", user)
        .agg(F.count(F.lit(1)).alias("n_events"))
        .select(F.col("w.start").alias("window_start"), "event_type", user, "n_events")
    )


def distinct_users(per_user: DataFrame, user: str = "user_id") -> DataFrame:
    """Events and distinct users per window and type from the newest rows of ``usage_users_stream``."""
    return per_user.groupBy("window_start", "event_type").agg(
        F.sum("n_events").alias("n_events"), F.count(user).alias("n_users"))


def append_versions(path: str):
    """A ``foreachBatch`` function that appends the updated rows with their batch number.

    A batch that is run again writes its own folder again, so it counts once.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return run


def newest_versions(table: DataFrame, keys: list[str]) -> DataFrame:
    """The last version of every key of what ``append_versions`` wrote: all windows, open ones too."""
    return latest_preferences(table, keys, ["batch"]).drop("batch")


def latest_preferences_sink(path: str, order: Sequence[str] = ("updated_at",)):
    """A ``foreachBatch`` function that keeps the newest row per key of every micro-batch."""
    write = append_versions(path)

    def run(batch: DataFrame, batch_id: int) -> None:
        write(latest_preferences(batch, order=order), batch_id)

    return run
