"""Linking, crossing events and upserts on streams; state is kept per block or track."""

from __future__ import annotations

import contextlib
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tracklore.operators.lineage import kept
from tracklore.operators.link import LINKED, PLACE, LinkRules, Tracker

STATE = "tracks string, held string"


def _advance(rules: LinkRules, delay: int, timed: bool, patience: int):
    """Frames are held until one delay frames later has come, as all of a frame's detections are needed together, or
    until the watermark has passed the block's last detection by patience milliseconds."""

    kinds = ["block_name", "time", "object_label", *PLACE, *(["acquired"] if timed else [])]

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tracker, held, done = Tracker(rules), pd.DataFrame(), None
        if state.exists:
            kept, rows = state.get
            kept = json.loads(kept)
            tracker, done = Tracker(rules, kept["active"], kept["next_id"]), kept["done"]
            held = pd.DataFrame(json.loads(rows))
        rows = pd.concat([held, *batches])
        seen = rows["acquired"].max() if timed and len(rows) else None
        late = rows[rows["time"] <= done] if done is not None and len(rows) else rows.iloc[:0]
        rows = rows.drop(late.index) if not len(late) else rows[rows["time"] > done]
        last = (rows["time"].max() - (0 if state.hasTimedOut else delay)) if len(rows) else None
        ready = rows[rows["time"] <= last] if last is not None else rows
        rest = rows[rows["time"] > last] if last is not None else rows
        out = [late[["block_name", "time", "object_label"]].assign(track_id=None)] if len(late) else []
        for time, frame in ready.sort_values(["time", "object_label"], kind="stable").groupby("time", sort=True) if len(ready) else ():
            out.append(frame[["block_name", "time", "object_label"]].assign(track_id=tracker.step(frame[PLACE].to_numpy(float))))
            done = int(time)
        state.update((json.dumps({"active": tracker.active, "next_id": tracker.next_id, "done": done}), json.dumps(rest[kinds].to_dict("records") if len(rest) else [])))
        if timed and len(rest) and seen is not None:
            state.setTimeoutTimestamp(max(int(seen) + patience, state.getCurrentWatermarkMs() + 1))
        for found in out:
            yield found.astype({"track_id": "Int64"})

    return run


def link_stream(detections: DataFrame, rules: LinkRules, delay: int = 1, acquired: str | None = None, patience: str = "1 minute", patience_ms: int = 60_000) -> DataFrame:
    """link_tracks on a stream of detections: frames in order within a block, up to delay frames late.

    With a timestamp column acquired, a block's last frames are linked once the watermark, patience behind the newest
    detection, has passed them by patience_ms; without one they wait for more. A detection of a frame that is linked
    already comes out with a null track_id, so none is lost without a trace.
    """
    place = [F.col("block_name").cast("long"), F.col("time").cast("int"), F.col("object_label").cast("long"), *PLACE]
    if acquired is None:
        return detections.select(*place).groupBy("block_name").applyInPandasWithState(_advance(rules, delay, False, 0), LINKED, STATE, "append", GroupStateTimeout.NoTimeout)
    rows = detections.withWatermark(acquired, patience).select(*place, acquired, F.unix_millis(acquired).alias("acquired"))
    return rows.groupBy("block_name").applyInPandasWithState(_advance(rules, delay, True, patience_ms), LINKED, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def _crossings(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    seen, was = state.get if state.exists else (None, None)
    rows = pd.concat(list(batches)).sort_values("time")
    out = []
    for time, inside in zip(rows["time"].tolist(), rows["inside"].tolist(), strict=True):
        if seen is not None and time < seen:
            out.append((key[0], key[1], time, "late"))
            continue
        if was is not None and inside != was:
            out.append((key[0], key[1], time, "entry" if inside else "exit"))
        seen, was = int(time), bool(inside)
    state.update((seen, was))
    if out:
        yield pd.DataFrame(out, columns=["block_name", "track_id", "time", "event"])


def crossing_stream(rows: DataFrame) -> DataFrame:
    """Entries and exits of tracks (block_name, track_id, time, inside) against the last state of each.

    A row of an earlier frame than the last one seen changes nothing and comes out as late; crossings_in_order waits for
    such rows.
    """
    rows = rows.select(F.col("block_name").cast("long"), F.col("track_id").cast("long"), F.col("time").cast("int"), "inside")
    return rows.groupBy("block_name", "track_id").applyInPandasWithState(_crossings, "block_name long, track_id long, time int, event string", "time int, inside boolean", "append", GroupStateTimeout.NoTimeout)


#: Tracks share state by buckets, so that calls for state follow buckets, not tracks or rows.
BUCKETS = 1024


class Crossings(StatefulProcessor):
    """Rows of a bucket of tracks are held in a list until the watermark has passed them, and then met in order with the
    last state of their track; a map keeps that and counts each kind of event of the track. One timer of a bucket is set,
    for its earliest row that is held. State that nothing has touched for ttl milliseconds goes; 0 keeps it."""

    def __init__(self, ttl: int):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        ttl = self.ttl or None
        self.handle = handle
        self.held = handle.getListState("held", "track_id long, us long, number long, inside boolean", ttl)
        self.tracks = handle.getMapState("tracks", "track_id long", "inside boolean, entries long, exits long", ttl)
        self.timer = handle.getValueState("timer", "ms long", ttl)

    def _wake(self, us: int) -> None:
        """Sets the timer for a row at us, unless an earlier one is set."""
        ms, was = us // 1000 + 1, self.timer.get()[0] if self.timer.exists() else None
        if was is None or ms < was:
            if was is not None:
                self.handle.deleteTimer(was)
            self.handle.registerTimer(ms)
            self.timer.update((ms,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        fresh = pd.concat(list(rows))
        self.held.appendList(list(zip(*[fresh[c].tolist() for c in ("track_id", "us", "number", "inside")], strict=True)))
        self._wake(int(fresh["us"].min()))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        done, rest = [], []
        for row in self.held.get():
            (done if row[1] // 1000 < passed else rest).append(tuple(row))
        known, touched, out = {k[0]: tuple(v) for k, v in self.tracks.iterator()}, {}, []
        for track, us, number, inside in sorted(done):
            was, entries, exits = touched.get(track) or known.get(track) or (None, 0, 0)
            if was is not None and inside != was:
                entries, exits = (entries + 1, exits) if inside else (entries, exits + 1)
                out.append((track, pd.Timestamp(us, unit="us", tz="UTC"), number, "entry" if inside else "exit", entries if inside else exits))
            touched[track] = (inside, entries, exits)
        for track, state in touched.items():
            self.tracks.updateValue((track,), state)
        self.timer.clear()
        if rest:
            self.held.put(rest)
            self._wake(min(r[1] for r in rest))
        else:
            self.held.clear()
        yield pd.DataFrame(out, columns=["track_id", "at", "number", "event", "total"]) if out else pd.DataFrame()

    def close(self) -> None:
        pass


def crossings_in_order(rows: DataFrame, late: str, ttl: int = 0, buckets: int = BUCKETS) -> DataFrame:
    """Entries and exits of tracks (track_id, at, number, inside), rows in order of at and number however they arrive.

    Rows later than the watermark are dropped; others wait until it has passed them. total counts the events of this kind
    of the track so far. The result has the event time at, so that windows can follow in the same stream. The session
    must keep state in RocksDB (rocks_state).
    """
    rows = rows.select(F.col("track_id").cast("long").alias("track_id"), "at", F.col("number").cast("long").alias("number"), "inside", F.unix_micros("at").alias("us"), F.pmod(F.xxhash64(F.col("track_id").cast("long")), F.lit(buckets)).alias("bucket")).withWatermark("at", late)
    schema = "track_id long, at timestamp, number long, event string, total long"
    return rows.groupBy("bucket").transformWithStateInPandas(Crossings(ttl), schema, "Append", "EventTime", eventTimeColumnName="at")


def crossing_counts(events: DataFrame, width: str) -> DataFrame:
    """Entries and exits by window: how many, and the largest count that a track has reached; a window comes out once the
    watermark has passed it."""
    g = events.groupBy(F.window("at", width), "event").agg(F.count("*").alias("n"), F.max("total").alias("largest_total"))
    return g.select(F.col("window.start").alias("start"), "event", "n", "largest_total")


@contextlib.contextmanager
def rocks_state(spark: SparkSession) -> Iterator[None]:
    """Streams started here keep their state in RocksDB, which list, map and timer state need."""
    name = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, was)


def windowed_counts(events: DataFrame, time: str, kind: str, width: str, late: str) -> DataFrame:
    """Counts of events by tumbling window and kind. In append mode a window comes out once the watermark has passed it, and
    rows later than that are dropped; in complete mode all windows are kept and every row counts."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), kind).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), kind, "n")


def sessions(events: DataFrame, time: str, key: str, gap: str, late: str) -> DataFrame:
    """Sessions of each key: runs of events no further apart than the gap; late rows as in windowed_counts."""
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap), key).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "n")


def keep_last_writer(path: str, key: list[str], order: str, buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that upserts: a Parquet table with the latest row of each key.

    Keys are dealt to buckets by hash; a batch's rows are merged with what their buckets hold, and only those buckets
    are written again. A batch that is replayed changes nothing.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = kept(batch.withColumn("bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")))
        touched = [r[0] for r in fresh.select("bucket").distinct().collect()]
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
            fresh = fresh.unionByName(spark.read.schema(fresh.schema).parquet(path).where(F.col("bucket").isin(touched)))
        rest = [c for c in fresh.columns if c not in (*key, "bucket")]
        last = kept(fresh.groupBy("bucket", *key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*key, "r.*", "bucket"))
        last.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)

    return write


def replay(stream: DataFrame, write: Callable[[DataFrame, int], None], state: str, mode: str = "append") -> None:
    """Runs a stream over all that is there now, batch by batch, and ends."""
    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
