"""Structured Streaming jobs: metric windows, ingest, dedup, sessions, policy values, feedback totals, alerts."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from loamwork.functions.storage import stage
from loamwork.operators.ingest import chunked_files
from loamwork.operators.metrics import AlertRule, decayed_sums
from loamwork.operators.policy import start_value


def metric_windows(events: DataFrame, minutes: int = 5, slide: int | None = None, late: str = "10 minutes", by_type: bool = False) -> DataFrame:
    """start (epoch seconds), type, n, errors, per_second, mean_value by event-time windows, sliding if `slide` is given.

    by_type: a row for each window and event_type; else type is `all`. Rows later than `late` are dropped.
    """
    w = F.window("ts", f"{minutes} minutes", f"{slide or minutes} minutes")
    kind = F.col("event_type") if by_type else F.lit("all")
    agg = events.withWatermark("ts", late).groupBy(w.alias("w"), kind.alias("type")).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("event_type") == "error", 1)).alias("errors"), F.avg("value").alias("mean_value"))
    return agg.select(F.unix_timestamp("w.start").alias("start"), "type", "n", "errors", (F.col("n") / (60.0 * minutes)).alias("per_second"), "mean_value")


def stored(spark: SparkSession, target: str, before: int | None = None) -> DataFrame:
    """The rows of a table that merge_batch keeps: of each bucket, those of its newest version (under `before`, if given);
    of one that ingest_batch keeps, the chunks of each document's greatest seq."""
    every = spark.read.parquet(target)
    if "_bucket" not in every.columns:
        last = every.groupBy(F.col("doc").alias("_doc")).agg(F.max("seq").alias("_seq"))
        return every.join(last, F.col("doc").eqNullSafe(F.col("_doc")) & F.col("seq").eqNullSafe(F.col("_seq"))).drop("_doc", "_seq")
    every = every if before is None else every.where(F.col("_version") < before)
    newest = every.groupBy("_bucket").agg(F.max("_version").alias("_version"))  # a row for each bucket
    return every.join(F.broadcast(newest), ["_bucket", "_version"])


def merge_batch(target: str, key: list[str], make: Callable[[DataFrame], DataFrame], merge: Callable[[DataFrame, DataFrame], DataFrame], buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: the rows that make(batch) gives are merged into the Parquet table at target.

    merge(old, new) gets the old rows of the buckets (by a hash of key) that new rows fall into, and returns what they hold
    from now on. A batch reads and writes only these, each as a new version beside the old ones, so a batch that fails
    and runs again changes nothing twice. `stored` reads the table.
    """

    def run(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        new = stage(make(batch), "merge")
        bucket = F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int").alias("_bucket")
        old = new.where("false")
        if epoch:
            touched = new.select(bucket).distinct()  # at most `buckets` rows
            old = stored(spark, target, epoch).join(F.broadcast(touched), "_bucket", "left_semi").select(*new.columns)
        spread = merge(old, new).select("*", bucket, F.lit(epoch).alias("_version"))
        spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket", "_version").parquet(target)

    return run


def ingest_batch(target: str, chunker: Callable[[DataFrame], DataFrame], buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: make chunks (doc, id, text, seq; others stay too) of the batch and put them in the table at target.

    The chunks of a document's greatest seq replace all that it had, so none of a longer, older version stay. A batch adds its
    own chunks as a version, in `buckets` files at most, and reads and rewrites nothing of the table; one that runs again
    replaces what it wrote. `stored` reads the table.
    """

    def run(batch: DataFrame, epoch: int) -> None:
        made = chunker(batch).withColumn("_version", F.lit(epoch)).coalesce(buckets)
        made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_version").parquet(target)

    return run


def file_pieces(files: DataFrame) -> DataFrame:
    """files (path, content, seq, problem; a batch or a stream) with their chunks: on a stream, what file_chunks need not plan for each batch."""
    return chunked_files(files).select("path", "seq", "problem", "chunks")


def file_chunks(batch: DataFrame) -> DataFrame:
    """doc, id, text, kind, seq of a batch of files (path, content, seq, problem; or of file_pieces): chunks by format and route, under the
    file's path. Files too large to read have one row without text, of kind `too large`. Each file is read once, and no row is shuffled."""
    pieces = batch if "chunks" in batch.columns else file_pieces(batch)
    none = F.lit(None).cast("string")
    bad = F.array(F.struct(F.col("problem").alias("kind"), F.lit(None).cast("int").alias("idx"), F.lit(None).cast("int").alias("part"), none.alias("text")))
    x = pieces.select("path", "seq", "problem", F.explode(F.when(F.col("problem").isNotNull(), bad).otherwise(F.col("chunks"))).alias("x"))
    name = F.when(F.col("problem").isNull(), F.concat_ws("_", "path", "x.kind", "x.idx", "x.part")).otherwise(F.col("path"))
    return x.select(F.col("path").alias("doc"), name.alias("id"), "x.text", "x.kind", "seq")


def first_seen(events: DataFrame, key: list[str], ttl: str = "1 hour") -> DataFrame:
    """The first row of each key within a time to live, which repeats don't extend."""
    return events.withWatermark("ts", ttl).dropDuplicatesWithinWatermark(key)


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """user_id, start and end (epoch seconds), n of runs of events with gaps under `gap`."""
    s = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return s.select("user_id", F.unix_timestamp("w.start").alias("start"), F.unix_timestamp("w.end").alias("end"), "n")


def q_batch(target: str, rate: float = 0.1) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: state, action, n, q in the table at target follow the rewards (state, action, reward, seq).

    A reward makes q into (1 - rate) q + rate * reward, and such steps compose: a batch's are summed to one of a decay and a
    sum (decayed_sums, by ranges of seq, so a hot key is many groups) before the value of the key is read. Batches
    apply in the order they come; within one, rewards go by seq.
    """

    def steps(batch: DataFrame) -> DataFrame:
        sums = decayed_sums(batch.where("reward IS NOT NULL"), ["state", "action"], ["seq"], "reward", 1 - rate)
        return sums.select("state", "action", "n", (rate * F.col("total")).alias("q"))

    def apply(old: DataFrame, new: DataFrame) -> DataFrame:
        o = old.select("state", "action", F.col("n").alias("n0"), F.col("q").alias("q0"))
        both = new.join(o, ["state", "action"], "full")
        before, n = F.coalesce("q0", start_value(F.col("action"))), F.coalesce("n", F.lit(0))
        return both.select("state", "action", (n + F.coalesce("n0", F.lit(0))).alias("n"), (F.pow(F.lit(1 - rate), n) * before + F.coalesce("q", F.lit(0.0))).alias("q"))

    return merge_batch(target, ["state", "action"], steps, apply)


def feedback_totals(feedback: DataFrame) -> DataFrame:
    """rating, n, helpful: running totals."""
    return feedback.groupBy("rating").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("helpful"), 1)).alias("helpful"))


def feedback_windows(feedback: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """start (epoch seconds), n, helpful, average (rating) of each window."""
    agg = feedback.withWatermark("created_at", late).groupBy(F.window("created_at", window).alias("w"))
    got = agg.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("helpful"), 1)).alias("helpful"), F.avg("rating").alias("average"))
    return got.select(F.unix_timestamp("w.start").alias("start"), "n", "helpful", "average")


def rate_alerts(windows: DataFrame, limit: float) -> DataFrame:
    """Windows whose errors a second exceed limit. windows: of metric_windows."""
    return windows.where(F.col("errors") > limit * F.col("n") / F.greatest(F.col("per_second"), F.lit(1e-12)))


def stream_bins(requests: DataFrame, step: int, by: list[str], late: str = "10 minutes") -> DataFrame:
    """by, end, n, errors, last: the bins of metrics.metric_bins, each told once the watermark has passed its end."""
    w = requests.withWatermark("ts", late).groupBy(*by, F.window("ts", f"{step} minutes").alias("w"))
    agg = w.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("error"), 1)).alias("errors"), F.max_by("seconds", F.struct("ts", "event_id")).alias("last"))
    return agg.select(*by, F.unix_timestamp("w.end").alias("end"), "n", "errors", "last")


class AlertMachine(StatefulProcessor):
    """Follows each rule of a key through its bins. The key's state: the end of the last bin, the bins of the longest
    look-back, and since when each rule holds."""

    def __init__(self, rules: list[AlertRule], step: int, by: str):
        self.rules, self.step, self.width, self.by = rules, step, step * 60, by
        self.most = max(r.window for r in rules) // step

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("known", "known string")

    def holds(self, rule: AlertRule, recent: list[list]) -> bool:
        seen = recent[-(rule.window // self.step) :]
        if rule.kind == "errors":
            return sum(x[1] for x in seen) / (rule.window * 60) > rule.limit
        if rule.kind == "silent":
            return not any(x[0] for x in seen)
        last = next((x[2] for x in reversed(seen) if x[2] is not None), None)
        return last is not None and last > rule.limit

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        at, recent, since = json.loads(self.known.get()[0]) if self.known.exists() else (None, [], [None] * len(self.rules))
        out = []
        for end, n, errors, last in sorted(r for b in rows for r in b[["end", "n", "errors", "last"]].itertuples(index=False, name=None)):
            for t in range(at + self.width if at is not None else end, end + 1, self.width):
                full = t == end
                recent = [*recent, [int(n) if full else 0, int(errors) if full else 0, None if not full or pd.isna(last) else float(last)]][-self.most :]
                for i, rule in enumerate(self.rules):
                    if not self.holds(rule, recent):
                        if since[i] is not None:
                            out.append((rule.name, "resolved", t))
                        since[i] = None
                        continue
                    if since[i] is None:
                        since[i] = t
                        out.append((rule.name, "pending", t))
                    if t - since[i] == -(-rule.hold // self.step) * self.width:
                        out.append((rule.name, "firing", t))
            at = int(end)
        self.known.update((json.dumps([at, recent, since]),))
        if out:  # the columns of an empty frame are floats, which Spark can't make strings of
            yield pd.DataFrame({"rule": [x[0] for x in out], self.by: [key[0]] * len(out), "state": [x[1] for x in out], "at": pd.Series([x[2] for x in out], dtype="int64")})

    def close(self) -> None:
        pass


def timed_alerts(requests: DataFrame, rules: list[AlertRule], step: int, by: str, late: str = "10 minutes") -> DataFrame:
    """rule, by, state (pending, firing, resolved), at (epoch seconds): what becomes of each rule of each key as time passes.

    requests: ts, event_id, seconds, error and the key. They are summed to bins of `step` minutes before they reach the state
    machine, so a hot key sends it a row a bin; bins come when the watermark has passed them, so late rows within
    `late` count and later ones are dropped. Bins that never come are empty ones, evaluated when the next bin arrives. The
    transitions are those of metrics.alert_intervals over the bins that the watermark has passed. State is kept in RocksDB,
    which transformWithState needs: the query must start with rocksdb_state().
    """
    bins = stream_bins(requests, step, [by], late)
    kind = requests.schema[by].dataType.simpleString()
    return bins.groupBy(by).transformWithStateInPandas(AlertMachine(rules, step, by), f"rule string, {by} {kind}, state string, at long", "append", "None")


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(key, before)
