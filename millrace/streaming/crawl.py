"""Streams of crawl and search events, and their batch twins.

Event time stands for the processing time of a live crawl, so that a replay gives the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

MAX_SIZE, MAX_AGE, MAX_DOCUMENTS = 20, 60, 10
_OUT = "task string, seq int, size int, first timestamp, last timestamp"


def _flush(rows: list, size: int, age: float) -> tuple[list[tuple], list]:
    """The batches that close, in order, and what stays open. ``rows`` are (ts, id), sorted."""
    done, open_ = [], []
    for ts, key in rows:
        if open_ and (ts - open_[0][0]).total_seconds() >= age:
            done.append(open_)
            open_ = []
        open_.append((ts, key))
        if len(open_) >= size:
            done.append(open_)
            open_ = []
    return done, open_


def micro_batches(pages: DataFrame, size: int = MAX_SIZE, age: float = MAX_AGE) -> DataFrame:
    """T01 as a batch: (task, seq, size, first, last) over pages (task string, id, ts): a batch closes at ``size`` pages, or
    when the next page comes ``age`` seconds after its first; the last one is flushed. A task is one crawl, read in order."""
    own = pages.select("task", "ts", "id").filter("task is not null and ts is not null")
    own = own.repartition("task").sortWithinPartitions("task", "ts", "id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, seq, open_ = None, 0, []

        def closed(done: list) -> pd.DataFrame:
            nonlocal seq
            rows = []
            for d in done:
                seq += 1
                rows.append((now, seq, len(d), d[0][0], d[-1][0]))
            return pd.DataFrame(rows, columns=["task", "seq", "size", "first", "last"])

        for b in batches:
            for task, group in b.groupby("task", sort=False):
                if task != now:
                    if open_:
                        yield closed([open_])
                    now, seq, open_ = task, 0, []
                done, open_ = _flush(open_ + list(zip(group["ts"], group["id"])), size, age)
                if done:
                    yield closed(done)
        if open_:
            yield closed([open_])

    return own.mapInPandas(run, _OUT)


def micro_batch_stream(pages: DataFrame, size: int = MAX_SIZE, age: float = MAX_AGE, late: str = "10 minutes") -> DataFrame:
    """T01 as a stream with a watermark on ``ts``: batches by size at once, by age when event time passes."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seq, times, ids = state.get if state.exists else (0, [], [])
        rows = [(pd.Timestamp(t), i) for t, i in zip(times, ids)]
        if state.hasTimedOut:
            done, open_ = [rows] if rows else [], []
        else:
            new = [(r.ts, r.id) for b in batches for r in b.itertuples()]
            done, open_ = _flush(sorted(rows + new), size, age)
        out = []
        for d in done:
            seq += 1
            out.append((key[0], seq, len(d), d[0][0], d[-1][0]))
        state.update((seq, [t.to_pydatetime() for t, _ in open_], [i for _, i in open_]))
        if open_:
            at = int((open_[0][0].timestamp() + age) * 1000)
            state.setTimeoutTimestamp(max(at, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=["task", "seq", "size", "first", "last"])

    own = pages.select("task", "ts", "id").withWatermark("ts", late)
    return own.groupBy("task").applyInPandasWithState(
        step, _OUT, "seq int, times array<timestamp>, ids array<long>", "append", GroupStateTimeout.EventTimeTimeout
    )


def cap_documents(pages: DataFrame, column: str = "documents", most: int = MAX_DOCUMENTS) -> DataFrame:
    """The first ``most`` documents of each page."""
    return pages.withColumn(column, F.slice(column, 1, most))


def expired(sent: DataFrame, results: DataFrame, ttl: str = "5 minutes") -> DataFrame:
    """Requests (key, ts) without a result within the time to live; with watermarks on both sides it runs on streams
    as an outer join, as the state has an end."""
    s = sent.select(F.col("key"), F.col("ts").alias("sent_ts"))
    r = results.select(F.col("key").alias("_key"), F.col("ts").alias("result_ts"))
    met = (F.col("key") == F.col("_key")) & (F.col("result_ts") >= F.col("sent_ts")) & (F.col("result_ts") <= F.col("sent_ts") + F.expr(f"interval {ttl}"))
    return s.join(r, met, "left_outer").filter("result_ts is null").select("key", "sent_ts")


def over_limit(requests: DataFrame, limit: int = 60, seconds: int = 60) -> DataFrame:
    """Adds ``recent`` (requests of the user in the last minute, this one included) and ``refused``."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    span = Window.partitionBy("user_id").orderBy("_at").rangeBetween(-seconds * 1_000_000 + 1, 0)
    return requests.withColumn("_at", at).withColumn("recent", F.count("*").over(span)).withColumn("refused", F.col("recent") > limit).drop("_at")


def drain_parsed(progress: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """(drained, rest) of (task, url, status, ...): up to ``limit`` parsed entries of each task leave the table."""
    order = Window.partitionBy("task", "status").orderBy("url")
    marked = progress.withColumn("_out", (F.col("status") == "parsed") & (F.row_number().over(order) <= limit))
    out = F.coalesce("_out", F.lit(False))
    return marked.filter(out).drop("_out"), marked.filter(~out).drop("_out")


def event_order(events: DataFrame) -> DataFrame:
    """(task, events, ends, in_order): whether a task's events (task, type, seq, ts) are batches numbered from 1 without
    gaps and then one completion or failure with nothing after it."""
    end = F.col("type") != "PAGE_BATCH"
    out = events.groupBy("task").agg(
        F.count("*").alias("events"),
        F.sum(end.cast("int")).alias("ends"),
        F.count(F.when(~end, 1)).alias("_n"),
        F.countDistinct(F.when(~end, F.col("seq"))).alias("_d"),
        F.min(F.when(~end, F.col("seq"))).alias("_lo"),
        F.max(F.when(~end, F.col("seq"))).alias("_hi"),
        F.max(F.when(~end, F.col("ts"))).alias("_last"),
        F.min(F.when(end, F.col("ts"))).alias("_end"),
    )
    numbered = (F.col("_n") == 0) | ((F.col("_n") == F.col("_d")) & (F.col("_lo") == 1) & (F.col("_hi") == F.col("_n")))
    closed = (F.col("ends") == 1) & (F.col("_last").isNull() | (F.col("_last") <= F.col("_end")))
    return out.select("task", "events", "ends", (numbered & closed).alias("in_order"))


def crawl_events(pages: DataFrame, batched: bool = True, size: int = MAX_SIZE, age: float = MAX_AGE) -> DataFrame:
    """(task, type, seq, pages): what a crawl tells of its pages (task, id, ts). In batch mode each batch is an event and
    the completion carries none; else the completion carries all."""
    if not batched:
        return pages.groupBy("task").agg(F.count("*").cast("int").alias("pages")).select("task", F.lit("TASK_COMPLETED").alias("type"), F.lit(None).cast("int").alias("seq"), "pages")
    own = micro_batches(pages, size, age).select("task", F.lit("PAGE_BATCH").alias("type"), "seq", F.col("size").alias("pages"))
    ends = pages.select("task").distinct().select("task", F.lit("TASK_COMPLETED").alias("type"), F.lit(None).cast("int").alias("seq"), F.lit(0).alias("pages"))
    return own.unionByName(ends)


def users(events: DataFrame) -> DataFrame:
    """(user_id, first_seen, last_seen, first_event): one row for a user, with what came first."""
    return events.groupBy("user_id").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.min_by("event_type", F.struct("ts", "event_id")).alias("first_event"))


def sliding_sessions(events: DataFrame, ttl: str = "100 minutes") -> DataFrame:
    """Keys live until ``ttl`` after the last write: (user_id, start, last_write, writes). Runs on streams with a watermark."""
    own = events.groupBy("user_id", F.session_window("ts", ttl).alias("w")).agg(F.count("*").alias("writes"), F.max("ts").alias("last_write"))
    return own.select("user_id", F.col("w.start").alias("start"), "last_write", "writes")


def active_queries(queries: DataFrame, minutes: int = 1) -> DataFrame:
    """Adds ``refused``: another query of the user began within the last minute."""
    last = F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return queries.withColumn("refused", F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(last.cast("timestamp")) < minutes * 60_000_000, F.lit(False)))


def queue_source(spark, folder: str, schema: str, files_a_batch: int = 100) -> DataFrame:
    """A stream of (value, message, ok) from files with one JSON message a line; a message that can't be read stays as text
    with ``ok`` false, so that ``sink`` puts it aside and the stream goes on."""
    lines = spark.readStream.format("text").option("maxFilesPerTrigger", files_a_batch).load(folder)
    read = F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    out = lines.withColumn("message", read)
    ok = F.col("message").isNotNull() & F.col("message._bad").isNull()
    return out.select("value", F.when(ok, F.col("message").dropFields("_bad")).alias("message"), F.coalesce(ok, F.lit(False)).alias("ok"))


def sink(batches: DataFrame, path: str, checkpoint: str, good: str = "size > 0"):
    """A stream to parquet; rows that fail the check go to a quarantine beside it. Each micro-batch writes its own
    folder by number, so a repeated one overwrites itself."""

    def write(df: DataFrame, number: int) -> None:
        df.filter(good).write.mode("overwrite").parquet(f"{path}/good/batch={number}")
        df.filter(f"not coalesce({good}, false)").write.mode("overwrite").parquet(f"{path}/quarantine/batch={number}")

    return batches.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
