"""The ledger of conversion jobs as queries: load, order, expiry, purge, quota, repair, verdicts.

A ledger row: job_id, client_id, owner_id, status (queued, converting, succeeded, failed, expired, evicted), output_size,
created_at, completed_at, expires_at, purge_at. `now` is always given, so results can be repeated.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quireworks.shared import scratch

#: Jobs of a stretch of the admission's order, at least; times before and after all others, in microseconds.
STRETCH_JOBS, _BEFORE, _NEVER = 100_000, -(1 << 63), (1 << 63) - 1
UNFINISHED, TERMINAL, GONE = ("queued", "converting"), ("failed", "expired", "evicted"), ("expired", "evicted")


def prefix_sums(df: DataFrame, order: list[str], values: dict[str, str]) -> DataFrame:
    """df with each name of values = the sum of its column over all rows before this one, in the order of the columns `order` (nulls first), which
    tell all rows apart.

    A window over all rows would run in one task. Here rows are dealt by ranges of the whole order, so that any number of rows of one
    second are dealt too, and stored with their range; the ranges' sums, a row each, are accumulated, and each range runs its own window from its
    start. The stored copy makes sure that sums and windows see the same ranges."""
    spark, before = df.sparkSession, lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    to = scratch(spark, "ranges")
    ranged = df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    ranged.write.parquet(to)
    x = spark.read.schema(ranged.schema).parquet(to)
    sums = x.groupBy("_range").agg(*[F.sum(c).alias(f"_sum_{n}") for n, c in values.items()])
    starts = sums.select("_range", *[before(f"_sum_{n}", Window.orderBy("_range")).alias(f"_start_{n}") for n in values])  # as many rows as there are partitions
    own = Window.partitionBy("_range").orderBy(*order)
    return x.join(F.broadcast(starts), "_range").select(*df.columns, *[(F.col(f"_start_{n}") + before(c, own)).alias(n) for n, c in values.items()])


def prefix_sum(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """prefix_sums of one column."""
    return prefix_sums(df, order, {name: value})


def capacity(ledger: DataFrame, workers: int) -> DataFrame:
    n = ledger.agg(F.count_if(F.col("status") == "queued").alias("queued"), F.count_if(F.col("status").isin(*UNFINISHED)).alias("active"))
    return n.select("queued", "active", (F.col("active") - F.col("queued")).alias("running"), ((F.col("active") - F.col("queued") < workers) & (F.col("queued") == 0)).alias("available"))


def active_by_client(ledger: DataFrame) -> DataFrame:
    return ledger.filter(F.col("status").isin(*UNFINISHED) & (F.col("client_id").cast("string") != "")).groupBy("client_id").agg(F.count("*").alias("n_active"))


def queue_positions(ledger: DataFrame) -> DataFrame:
    """job_id, queue_position: 1-based among the queued in order of (created_at, job_id), those without created_at first; 0 for the others."""
    queued = ledger.filter("status = 'queued'").select("job_id", "created_at", F.lit(1).alias("one"))
    at = prefix_sum(queued, ["created_at", "job_id"], "one", "before").select("job_id", (F.col("before") + 1).alias("queue_position"))
    return at.unionByName(ledger.filter(~F.col("status").eqNullSafe("queued")).select("job_id", F.lit(0).cast("long").alias("queue_position")))


def after(c: str | Column, hours: int) -> Column:
    return F.timestamp_add("HOUR", F.lit(hours), F.col(c) if isinstance(c, str) else c)


def expire(ledger: DataFrame, leases: DataFrame, now: Column, retention_hours: int) -> DataFrame:
    """The rows that expire now, as they are afterwards."""
    due = ledger.filter((F.col("status") == "succeeded") & (F.col("expires_at") <= now)).join(leases, "job_id", "left_anti")
    return due.withColumns({"status": F.lit("expired"), "output_size": F.lit(0).cast("long"), "error_code": F.lit("expired"), "purge_at": after(now, retention_hours)})


def purge(ledger: DataFrame, leases: DataFrame, now: Column) -> DataFrame:
    """The rows to remove."""
    return ledger.filter(F.col("status").isin(*TERMINAL) & (F.col("purge_at") <= now)).join(leases, "job_id", "left_anti")


def evict_to_quota(ledger: DataFrame, leases: DataFrame, most: int, required: int = 0) -> DataFrame:
    """The succeeded rows without a lease to evict, oldest first, until what is used leaves `required` of `most` free.

    Nothing is evicted where required alone is over most, and no job without completed_at."""
    if most - required < 0:
        return ledger.limit(0)
    used = ledger.filter("status = 'succeeded'").agg(F.coalesce(F.sum("output_size"), F.lit(0)).alias("_used"))
    may = ledger.filter("status = 'succeeded' and completed_at is not null").join(leases, "job_id", "left_anti")
    x = prefix_sum(may, ["completed_at", "job_id"], "output_size", "_before").crossJoin(F.broadcast(used))  # one row
    return x.filter(F.col("_used") - F.col("_before") > most - required).drop("_before", "_used")


def storage_full(ledger: DataFrame, leases: DataFrame, most: int, required: int = 0) -> DataFrame:
    """used, evicted, storage_full: whether eviction can't reach the target."""
    gone = evict_to_quota(ledger, leases, most, required).agg(F.coalesce(F.sum("output_size"), F.lit(0)).alias("evicted"))
    used = ledger.filter("status = 'succeeded'").agg(F.coalesce(F.sum("output_size"), F.lit(0)).alias("used"))
    return used.crossJoin(gone).withColumn("storage_full", (F.lit(most - required) < 0) | (F.col("used") - F.col("evicted") > most - required))


def storage_usage(files: DataFrame) -> DataFrame:
    """job_id, n_bytes per job, and one row without job_id for the total."""
    return files.rollup("job_id").agg(F.sum("length").alias("n_bytes"))


def orphans(files: DataFrame, ledger: DataFrame, now: Column, timeout_minutes: int) -> DataFrame:
    """files(path, kind, job_id, modified_at): those of no job that are older than ten minutes and the timeout; inbox files by age only, the key file never."""
    old = files.filter((F.col("kind") != "key") & (F.col("modified_at") <= F.timestamp_add("MINUTE", F.lit(-max(10, timeout_minutes)), now)))
    inbox = old.filter("kind = 'inbox'")
    return old.filter("kind <> 'inbox'").join(ledger.select("job_id"), "job_id", "left_anti").unionByName(inbox)


def reconcile(ledger: DataFrame, inputs: DataFrame, outputs: DataFrame, now: Column, retention_hours: int) -> DataFrame:
    """The ledger after a restart, from the jobs that still have an input and those that have an output."""
    x = ledger.join(inputs.select("job_id", F.lit(True).alias("_in")).distinct(), "job_id", "left").join(outputs.select("job_id", F.lit(True).alias("_out")).distinct(), "job_id", "left")
    open_, lost = F.col("status").isin(*UNFINISHED), F.col("status") == "succeeded"
    status = F.when(open_ & F.col("_in"), "queued").when(open_, "failed").when(lost & F.col("_out").isNull(), "expired").otherwise(F.col("status"))
    code = F.when(open_ & F.col("_in").isNull(), "input_missing").when(lost & F.col("_out").isNull(), "output_missing")
    x = x.withColumns({"_status": status, "error_code": code})
    done = F.coalesce("completed_at", now)
    return x.select("job_id", F.col("_status").alias("status"), "error_code", F.when(F.col("_status").isin(*TERMINAL) & F.col("purge_at").isNull(), after(done, retention_hours)).otherwise(F.col("purge_at")).alias("purge_at"))


def finish(ledger: DataFrame, results: DataFrame, retention_hours: int) -> DataFrame:
    """The ledger after results(job_id, ok, timed_out, size, done_at): an upsert by join, others as they were."""
    r = results.select("job_id", "ok", "timed_out", "size", "done_at", F.lit(True).alias("_done"))
    x = ledger.join(r, "job_id", "left")
    done, ok = F.col("_done").isNotNull(), F.col("ok")
    return x.select(
        "job_id", F.when(done & ok, "succeeded").when(done, "failed").otherwise(F.col("status")).alias("status"),
        F.when(done & ok, F.col("size")).otherwise(F.col("output_size")).alias("output_size"),
        F.when(done & ~ok, F.when(F.col("timed_out"), "timeout").otherwise("conversion_failed")).alias("error_code"),
        F.when(done & ok, after("done_at", retention_hours)).otherwise(F.col("expires_at")).alias("expires_at"),
        F.when(done & ~ok, after("done_at", retention_hours)).otherwise(F.col("purge_at")).alias("purge_at"),
    )


def download_eligibility(requests: DataFrame, ledger: DataFrame, leases: DataFrame, files: DataFrame, now: Column) -> DataFrame:
    """requests(request_id, job_id, asker_id) with a verdict; the first test that holds decides."""
    x = requests.join(ledger.select("job_id", "owner_id", "status", "expires_at"), "job_id", "left")
    x = x.join(leases.select("job_id", F.lit(True).alias("_lease")).distinct(), "job_id", "left").join(files.select("job_id", F.lit(True).alias("_file")).distinct(), "job_id", "left")
    late = (F.col("expires_at") <= now) & F.col("_lease").isNull()
    verdict = (
        F.when(F.col("owner_id").isNull() | (F.col("owner_id") != F.col("asker_id")), "NOT_FOUND")
        .when(F.col("status").isin(*GONE), "EXPIRED").when(late, "EXPIRED").when(F.col("status") != "succeeded", "NOT_READY")
        .when(F.col("_file").isNull(), "EXPIRED").otherwise("OK")
    )
    return x.select("request_id", verdict.alias("verdict"))


def owner_jobs(ledger: DataFrame, owners: DataFrame) -> DataFrame:
    return ledger.join(owners, "owner_id", "left_semi").select("job_id", "owner_id", "status", "created_at", "completed_at", "output_size")


def history(records: DataFrame, now: Column, n: int = 30) -> DataFrame:
    """Of each owner the n latest records, one for each job."""
    newest = Window.partitionBy("owner_id", "job_id").orderBy(F.desc("updated_at"), F.desc("event_id"))
    latest = Window.partitionBy("owner_id").orderBy(F.desc("updated_at"), F.desc("job_id"))
    known = F.col("status").isin("queued", "converting", "succeeded", *TERMINAL)
    x = records.withColumn("_k", F.row_number().over(newest)).filter("_k = 1").withColumn("rank", F.row_number().over(latest)).filter(F.col("rank") <= n)
    status = F.when(~known | F.col("status").isNull(), "failed").when((F.col("status") == "succeeded") & (F.col("expires_at") <= now), "expired").otherwise(F.col("status"))
    return x.select("owner_id", "job_id", "rank", status.alias("status"))


def _lasts() -> Column:
    return F.col("done_at").isNull() | (F.col("done_at") > F.col("created_at"))  # other jobs are over as they begin


def open_counts(jobs: DataFrame) -> DataFrame:
    """jobs(job_id, client_id, created_at, done_at, size, taken) with what is open when each begins: all_low, held_low (bytes) and client_low count the
    jobs that are taken, all_high, held_high and client_high also those of which it isn't known (taken null). An end at a start's time comes before it.

    A job is one more at its start and one less at its end, so each count is a prefix sum: over all changes in order of time, and over
    those in order of client and time less what the clients before have left."""
    start = F.struct(F.col("created_at").alias("at"), F.lit(1).alias("kind"), F.when(_lasts(), 1).otherwise(0).alias("d"))
    end = F.when(_lasts() & F.col("done_at").isNotNull(), F.struct(F.col("done_at").alias("at"), F.lit(0).alias("kind"), F.lit(-1).alias("d")))
    x = jobs.withColumn("_e", F.explode(F.filter(F.array(start, end), lambda e: e.isNotNull()))).select(*jobs.columns, "_e.at", "_e.kind", "_e.d")
    low, high = F.when(F.col("taken"), F.col("d")).otherwise(0), F.when(F.coalesce("taken", F.lit(True)), F.col("d")).otherwise(0)
    x = x.withColumns({"_low": low, "_high": high, "_low_b": low * F.coalesce("size", F.lit(0)), "_high_b": high * F.coalesce("size", F.lit(0))})
    x = prefix_sums(x, ["at", "kind", "job_id"], {"all_low": "_low", "all_high": "_high", "held_low": "_low_b", "held_high": "_high_b"})
    x = prefix_sums(x, ["client_id", "at", "kind", "job_id"], {"client_low": "_low", "client_high": "_high"})
    first = F.min(F.struct("at", "kind", "job_id", "client_low", "client_high"))
    before = x.groupBy("client_id").agg(first.alias("f")).select(F.col("client_id").alias("_client"), F.col("f.client_low").alias("_l"), F.col("f.client_high").alias("_h"))
    y = x.filter("kind = 1").join(before, F.col("client_id").eqNullSafe(F.col("_client")))
    return y.select(*jobs.columns, "all_low", "all_high", "held_low", "held_high", (F.col("client_low") - F.col("_l")).alias("client_low"), (F.col("client_high") - F.col("_h")).alias("client_high"))


def busy_periods(submissions: DataFrame) -> DataFrame:
    """submissions(job_id, created_at, done_at, more) with period: a number that changes where, if all were taken, none would be open.

    What is open at a submission depends on its own period only."""
    starts = submissions.select(F.col("created_at").alias("at"), F.lit(1).alias("kind"), F.when(_lasts(), 1).otherwise(0).alias("d"), "job_id")
    ends = submissions.filter(_lasts() & F.col("done_at").isNotNull()).select(F.col("done_at").alias("at"), F.lit(0).alias("kind"), F.lit(-1).alias("d"), "job_id")
    running = prefix_sum(starts.unionByName(ends), ["at", "kind", "job_id"], "d", "_open").filter("kind = 1")
    first = prefix_sum(running.withColumn("_new", F.when(F.col("_open") <= 0, 1).otherwise(0)), ["at", "job_id"], "_new", "_periods")
    return submissions.join(first.select("job_id", (F.col("_periods") + F.col("_new")).alias("period")), "job_id")


def _admitted(per_client: int, capacity: int, storage: int, verdicts: bool):
    """Of each stretch its verdicts, or those of its jobs that are open at its end, from batches in the order of (stretch, kind, created_at, job_id): first the
    earlier jobs that are open as it begins (kind 0), then its own (kind 1). A task holds a batch and the open jobs only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stretch, open_, clients, held, number = None, [], Counter(), 0, 0
        fields: list[pa.Field] = []

        def still_open() -> Iterator[pa.RecordBatch]:
            own = [x[2] for x in sorted(open_) if x[2] is not None]
            if own and not verdicts:
                columns = [pa.array(c, pa.int64()).cast(f.type) if pa.types.is_timestamp(f.type) else pa.array(c, f.type) for c, f in zip(zip(*own), fields)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), stretch, np.int32)), *columns], names=["stretch", *(f.name for f in fields)])

        for batch in batches:
            fields = [batch.schema.field(n) for n in ("job_id", "client_id", "created_at", "done_at", "size")]
            stretches, kinds = (batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("stretch", "kind"))
            jobs, names, begins, ends, sizes = (c.cast(pa.int64()).to_pylist() if pa.types.is_timestamp(c.type) else c.to_pylist() for f in fields for c in [batch.column(batch.schema.get_field_index(f.name))])
            times = np.array([_BEFORE if t is None else t for t in begins], np.int64)
            edges = [*np.flatnonzero(np.diff(np.array(stretches)) != 0).tolist(), len(batch) - 1] if len(batch) else []
            out: tuple[list, ...] = ([], [], [], [], [])
            i = 0
            for last in edges:
                if stretches[i] != stretch:
                    yield from still_open()
                    stretch, open_, clients, held = stretches[i], [], Counter(), 0
                while i <= last:
                    if kinds[i]:
                        while open_ and open_[0][0] <= times[i]:
                            _, _, _, client, size = heapq.heappop(open_)
                            clients[client] -= 1
                            held -= size
                        if len(open_) >= capacity:  # nothing is taken before one of them ends
                            to = i + max(1, int(np.searchsorted(times[i : last + 1], open_[0][0]))) if open_ else last + 1
                            if verdicts:
                                n = [clients[c] for c in names[i:to]]
                                for x, more in zip(out, (jobs[i:to], names[i:to], ["ip_limit" if k >= per_client else "queue_full" for k in n], n, [len(open_)] * (to - i))):
                                    x.extend(more)
                            i = to
                            continue
                        n = clients[names[i]]
                        why = "ip_limit" if n >= per_client else "storage_full" if held + sizes[i] > storage else "accepted"
                        if verdicts:
                            for x, one in zip(out, (jobs[i], names[i], why, n, len(open_))):
                                x.append(one)
                        taken = why == "accepted" and (ends[i] is None or begins[i] is not None and ends[i] > begins[i])  # others are over as they begin
                    else:
                        taken = True
                    if taken:
                        number += 1
                        row = (jobs[i], names[i], begins[i], ends[i], sizes[i]) if kinds[i] else None
                        heapq.heappush(open_, (_NEVER if ends[i] is None else ends[i], number, row, names[i], sizes[i]))
                        clients[names[i]] += 1
                        held += sizes[i]
                    i += 1
            if verdicts and out[0]:
                types = (fields[0].type, fields[1].type, pa.string(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types)], names=["job_id", "client_id", "verdict", "client_open", "all_open"])
        if stretch is not None:
            yield from still_open()

    return run


def _stored(df: DataFrame) -> DataFrame:
    to = scratch(df.sparkSession, "admission")
    df.write.parquet(to)
    return df.sparkSession.read.schema(df.schema).parquet(to)


def _replayed(jobs: DataFrame, n_jobs: int, per_client: int, capacity: int, storage: int, stretch_jobs: int = STRETCH_JOBS) -> DataFrame:
    """job_id, client_id, verdict, client_open, all_open: stretches of the jobs' order are run through side by side, each from a guess of what is open as it
    begins: at first nothing, then what the stretches before it have left open. Stretches whose guess has changed run again, until none has. Then
    each has begun with what those before it left, from the first on, so every verdict is that of the sequence. What is open is soon forgotten, as a
    rule after two or three passes; each pass settles at least one stretch more."""
    spark = jobs.sparkSession
    most = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    n = max(1, min(most, n_jobs // stretch_jobs))
    names = ["stretch", "job_id", "client_id", "created_at", "done_at", "size"]
    kinds = dict(jobs.dtypes)
    ranged = _stored(jobs.repartitionByRange(n, "created_at", "job_id").withColumn("stretch", F.spark_partition_id()).select(*names))
    starts = ranged.groupBy("stretch").agg(F.min("created_at").alias("at")).withColumnRenamed("stretch", "to")  # a row a stretch

    def passed(rows: DataFrame, before: DataFrame, verdicts: bool) -> DataFrame:
        both = before.select(*names, F.lit(0).alias("kind")).unionByName(rows.select(*names, F.lit(1).alias("kind")))
        dealt = both.repartitionById(n, "stretch").sortWithinPartitions("stretch", "kind", "created_at", "job_id")
        shown = f"job_id {kinds['job_id']}, client_id {kinds['client_id']}, verdict string, client_open int, all_open int"
        return dealt.mapInArrow(_admitted(per_client, capacity, storage, verdicts), shown if verdicts else ", ".join(f"{c} {'int' if c == 'stretch' else kinds[c]}" for c in names))

    def marks(before: DataFrame) -> dict[int, tuple]:
        return {r[0]: (r[1], r[2]) for r in before.groupBy("stretch").agg(F.count("*"), F.sum(F.xxhash64("job_id").cast("decimal(38,0)"))).collect()}  # a row a stretch

    before, left, known = ranged.limit(0), ranged.limit(0), {}
    changed = list(range(n)) if n > 1 else []
    while changed:
        some = F.col("stretch").isin(changed)
        left = _stored(left.filter(~some).unionByName(passed(ranged.filter(some), before.filter(some), False)))
        later = (F.col("stretch") < F.col("to")) & (F.col("done_at").isNull() | (F.col("done_at") > F.col("at")))
        first = Window.partitionBy("to").orderBy("created_at", "job_id")  # no more than capacity can be open, so a wrong guess holds no more either
        guess = left.join(F.broadcast(starts), later).withColumn("_k", F.row_number().over(first)).filter(F.col("_k") <= capacity)
        before = _stored(guess.select(F.col("to").alias("stretch"), *names[1:]))
        was, known = known, marks(before)
        changed = [k for k in range(n) if known.get(k) != was.get(k)]
    return passed(ranged, before, True)


def admission_replay(submissions: DataFrame, per_client: int, capacity: int, storage: int, rounds: int = 0) -> DataFrame:
    """submissions(job_id, client_id, created_at, done_at, size) with the verdict of each: ip_limit where the client has per_client open jobs,
    else queue_full where capacity jobs are open, else storage_full where its size and those of the open jobs are more than storage, else
    accepted. Only accepted jobs count, until their done_at, or for good where that is null; an end at a start's time comes before it. A null size is 0.

    Admission is a sequence; stretches of it are run through side by side until they fit together (`_replayed`). Before that, as many `rounds` as asked for
    try to settle all by bounds: a job that fits beside all that may be open is in, one that does not fit beside what is surely open is out, and
    each round, a few prefix sums over all jobs, narrows the bounds of the next, while each settles an eighth of what is left. They pay where jobs
    that stay open for good fill the service one by one over a long time."""
    jobs = submissions.select("job_id", "client_id", "created_at", "done_at", F.coalesce("size", F.lit(0)).alias("size"))
    left = n_jobs = jobs.count()
    bounded = jobs.withColumn("taken", F.lit(None).cast("boolean"))
    fits = lambda k: (F.col(f"client_{k}") < per_client) & (F.col(f"all_{k}") < capacity) & (F.col(f"held_{k}") + F.col("size") <= storage)
    for _ in range(rounds):
        verdict = F.when(F.col("taken").isNotNull(), F.col("taken")).when(fits("high"), True).when(~fits("low"), False)
        bounded = _stored(open_counts(bounded).withColumn("taken", verdict).select(*bounded.columns))
        before, left = left, bounded.filter("taken is null").count()
        if not left or left > before - before // 8:  # settled, or too near its limits for bounds to close in
            break
    if left or not rounds:
        return _replayed(jobs, n_jobs, per_client, capacity, storage)
    why = F.when(F.col("client_low") >= per_client, "ip_limit").when(F.col("all_low") >= capacity, "queue_full").when(F.col("held_low") + F.col("size") > storage, "storage_full").otherwise("accepted")
    return open_counts(bounded).select("job_id", "client_id", why.alias("verdict"), F.col("client_low").cast("int").alias("client_open"), F.col("all_low").cast("int").alias("all_open"))


def stage_progress(ledger: DataFrame) -> DataFrame:
    """stage (0 uploading to 3 succeeded; ended jobs by the last stage they reached), n_jobs."""
    stage = F.when(F.col("status") == "queued", 1).when(F.col("status") == "converting", 2).when(F.col("status") == "succeeded", 3).when(F.col("status").isin(*GONE), 3).when(F.col("completed_at").isNotNull(), 2).otherwise(0)
    return ledger.groupBy(stage.alias("stage")).agg(F.count("*").alias("n_jobs"))
