"""Ledger, log and address cases."""

import hmac
import ipaddress
import random
import time

from pyspark.sql import functions as F

from quireworks.functions import addresses as IP
from quireworks.operators import access as A
from quireworks.operators import ledger as L
from quireworks.sources import corpus as S
from quireworks.streaming import streams


CLIENTS = [
    # remote, forwarded, client behind 172.30.0.0/16 and fd00:7::/32
    ("192.0.2.77:9000", "203.0.113.5", "192.0.2.77"),
    ("172.30.4.4:9000", None, "172.30.4.4"),
    ("172.30.4.4:9000", "  ", "172.30.4.4"),
    ("172.30.4.4:9000", "203.0.113.5", "203.0.113.5"),
    ("172.30.4.4:9000", "192.0.2.1, 203.0.113.5, 172.30.9.9", "203.0.113.5"),
    ("172.30.4.4", "172.30.1.1, 172.30.2.2", "172.30.1.1"),
    ("172.30.4.4:9000", "203.0.113.5, unknown", "172.30.4.4"),
    ("172.30.4.4:9000", "203.0.113.5:81", "172.30.4.4"),
    ("172.30.4.4:9000", "2001:DB8:0::00a1, 172.30.2.2", "2001:db8::a1"),
    ("172.30.4.4:9000", "203.0.113.5, fd00:7::9", "203.0.113.5"),
    ("172.30.4.4:9000", "::ffff:203.0.113.5", "203.0.113.5"),
    ("[fd00:7::2]:443", "2001:db8::7", "2001:db8::7"),
    ("[2001:db8::2]:443", "203.0.113.5", "2001:db8::2"),
    ("[::ffff:172.30.4.4]:443", "203.0.113.5", "203.0.113.5"),
    ("2001:db8::3", None, "2001:db8::3"),
    ("[2001:db8::zz]:1", None, None), ("where", "203.0.113.5", None), (None, None, None),
]


def test_clients(spark):
    df = spark.createDataFrame([(i, r, f) for i, (r, f, _) in enumerate(CLIENTS)], "id int, remote string, forwarded string")
    got = {r["id"]: r["client"] for r in A.attribute_clients(df, ("172.30.0.0/16", "fd00:7::/32")).collect()}
    assert got == {i: c for i, (_, _, c) in enumerate(CLIENTS)}
    alone = {r["id"]: r["client"] for r in A.attribute_clients(df, ()).collect()}
    assert alone[3] == "172.30.4.4" and alone[11] == "fd00:7::2"


URLS = [
    ("https://example.com/a", None), ("https://8.8.8.8:443/", None), ("https://e.com:0443/", None), ("https://e.com:/", None), ("https://[2001:db8::1]:443/x", None), ("https://0.1.2.3/", None),
    ("https://127.0.0.01/", None), ("https://e.com/%41?x=%zz", None), ("https://e.com%c3%a9/", None), ("https://e.com?q=a@b", None), ("https://[::10.0.0.1]/", None), ("https://100.128.0.0", None), ("https://é.com/", None),
    (None, "no_host"), ("", "no_host"), ("https:///x", "no_host"), ("https://:443/x", "no_host"), ("https:foo", "no_host"), ("//e.com/", "no_host"),
    ("https://u:p@example.com", "userinfo"), ("https://a@b@c/", "userinfo"), ("http://example.com/a", "scheme"), ("ftp://example.com", "scheme"),
    ("https://example.com:8443/", "port"), ("https://e.com:99999999999/", "port"), ("https://[fe80::1]:80/", "port"),
    ("https://h:abc/", "invalid"), ("https://h /", "invalid"), ("https://[zz]/", "invalid"), ("https://[::1/", "invalid"), ("https://a:b:443/", "invalid"), ("https://[1.2.3.4]/", "invalid"), ("https://a{b/", "invalid"),
    ("HTTPS://E.com/%zz", "invalid"), ("https://e.com/#%zz", "invalid"), ("https://e.com/a\tb", "invalid"), ("https://e.com%41/", "invalid"),
    *((f"https://{h}/", "address") for h in ("127.0.0.1", "[::1]", "100.64.1.1", "10.2.3.4", "[::ffff:10.0.0.1]", "169.254.1.1", "224.0.0.1", "0.0.0.0", "255.255.255.255", "[0:0:0:0:0:0:0:1]", "[0:0:0:0:0:ffff:10.0.0.1]",
                                              "[0:0:0:0:0:ffff:7f00:1]", "[::FFFF:8.8.8.8]", "[2001:db8::1%25eth0]", "[fd00::1]", "[fe80::1]", "[ff02::1]", "[::]", "100.127.255.255", "172.31.0.1", "192.168.0.1")),
]


def test_urls(spark):
    df = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(URLS)], "id int, url string")
    assert {r["id"]: r["reject_code"] for r in A.audit_urls(df).collect()} == {i: c for i, (_, c) in enumerate(URLS)}
    plain = spark.createDataFrame([("http://e.com/",), ("HTTP://e.com:80/",), ("http://e.com:8080/",), ("http://e.com:443/",), ("https://e.com/",)], "url string")
    assert [r["reject_code"] for r in A.audit_urls(plain, allow_http=True).collect()] == [None, None, "port", "port", None]


def test_addresses_against_the_standard_library(spark):
    rng, texts = random.Random(1), ["", ":", "::", ":::", "1::", "::1", "1:2:3:4:5:6:7::", "1::2:3:4:5:6:7:8", "1.2.3.4", "1.2.3", "01.2.3.4", "256.1.1.1", "::1.2.3.4", "1.2.3.4::", "fe80::1%eth0", "fe80::1%", "1.2.3.4%x", "::ffff:1.2.3.4"]
    for _ in range(1500):
        b = bytearray(rng.randbytes(16))
        for k in range(0, 16, 2):
            if rng.random() < 0.6:
                b[k : k + 2] = b"\0\0"
        a = ipaddress.IPv6Address(bytes(b) if rng.random() > 0.1 else bytes(10) + b"\xff\xff" + bytes(b[12:]))
        s = a.exploded if rng.random() < 0.3 else str(a)
        s = s.upper() if rng.random() < 0.3 else s
        if rng.random() < 0.2 and "::" not in s:
            s = ":".join([*s.split(":")[:-2], str(ipaddress.IPv4Address(bytes(b[12:])))])
        if rng.random() < 0.2:
            p = rng.randrange(len(s))
            s = s[:p] + rng.choice(":0g.f") + s[p + rng.randint(0, 1) :]
        texts.append(s)

    def usual(x):
        try:
            a = ipaddress.ip_address(x)
        except ValueError:
            return None
        return str(getattr(a, "ipv4_mapped", None) or a)

    blocks = ("10.0.0.0/8", "128.0.0.0/1", "::/3", "2000::/5", "192.0.2.0/27", "fe80::/10", "::/128")
    nets = [ipaddress.ip_network(b) for b in blocks]
    x = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("ip", IP.address(F.col("t")))
    for t, said, inside in x.select("t", IP.spelled(F.col("ip")), IP.is_within(F.col("ip"), blocks)).collect():
        assert said == usual(t), t
        assert inside == (said is not None and "%" not in said and any(ipaddress.ip_address(said) in n for n in nets)), t


def test_many_trusted_blocks(spark):
    """Thousands of blocks are sets of prefixes, a look-up each length, and one scan."""
    blocks = tuple(f"10.{k // 256}.{k % 256}.0/24" for k in range(5000)) + ("2001:db8::/33",)
    df = spark.createDataFrame([(i, "10.0.0.9:1", f) for i, f in enumerate(["198.51.100.1, 10.19.135.1", "198.51.100.1, 10.19.136.1", "198.51.100.1,2001:db8:7fff::1", "198.51.100.1, 2001:db8:8000::1"])], "id int, remote string, forwarded string")
    got = A.attribute_clients(df, blocks)
    assert [r["client"] for r in got.orderBy("id").collect()] == ["198.51.100.1", "10.19.136.1", "198.51.100.1", "2001:db8:8000::1"]
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString() and "Union" not in got._jdf.queryExecution().executedPlan().toString()


def test_hmac_and_names(spark):
    df = spark.createDataFrame([("10.0.0.1", "../bad%0D%0Aname.txt")], "ip string, name string")
    assert df.select(A.pseudonym(F.col("ip"), b"k")).first()[0] == hmac.new(b"k", b"10.0.0.1", "sha256").hexdigest()
    assert A.clean_names(df).first()["display_name"] == "badname.txt"


def test_quota_and_limits(spark):
    rows = [(1, "succeeded", 1024, "2024-01-01 00:00:00"), (2, "succeeded", 1024, "2024-01-01 00:01:00")]
    ledger = spark.createDataFrame(rows, "job_id long, status string, output_size long, completed_at string").withColumn("completed_at", F.to_timestamp("completed_at"))
    none = spark.createDataFrame([], "job_id long")
    assert [r["job_id"] for r in L.evict_to_quota(ledger, none, 2048 - 512).collect()] == [1]
    assert L.evict_to_quota(ledger, none, 100, 200).count() == 0 and L.storage_full(ledger, none, 100, 200).first()["storage_full"]


def replayed(rows, per_client, capacity, storage):
    """Admission by a plain scan over all submissions."""
    open_, out = [], {}
    for job, client, at, done, size in sorted(rows, key=lambda r: (r[2], r[0])):
        open_ = [o for o in open_ if o[1] > at]
        n, held = sum(o[0] == client for o in open_), sum(o[2] for o in open_)
        out[job] = "ip_limit" if n >= per_client else "queue_full" if len(open_) >= capacity else "storage_full" if held + size > storage else "accepted"
        if out[job] == "accepted":
            open_.append((client, max(done, at) if done else float("inf"), size))
    return out


def as_submissions(spark, rows):
    df = spark.createDataFrame(rows, "job_id long, client_id string, created_at long, done_at long, size long")
    return df.withColumns({c: F.timestamp_seconds(c).cast("timestamp_ntz") for c in ("created_at", "done_at")})


def test_a_refused_job_is_not_open(spark):
    rows = [(1, "a", 0, 10, 1), (2, "a", 5, 20, 1), (3, "a", 12, 30, 1), (4, "b", 12, 13, 1), (5, "c", 12, 13, 1), (6, "d", 13, 14, 9)]
    got = {r["job_id"]: r["verdict"] for r in L.admission_replay(as_submissions(spark, rows), 1, 2, 9).collect()}
    assert got == {1: "accepted", 2: "ip_limit", 3: "accepted", 4: "accepted", 5: "queue_full", 6: "storage_full"}


def test_admission_equals_a_scan(spark):
    rng = random.Random(7)
    rows = []
    for i in range(1500):
        at = rng.randint(0, 300_000)
        rows.append((i, f"c{rng.randint(0, 6)}", at, at + rng.choice([0, 5, 300, 900]) if i % 700 else None, rng.randint(0, 40)))
    got = {r["job_id"]: r["verdict"] for r in L.admission_replay(as_submissions(spark, rows), 2, 3, 60).collect()}
    assert got == replayed(rows, 2, 3, 60)
    rows = [r for r in rows if r[3]]
    got = {r["job_id"]: r["verdict"] for r in L.admission_replay(as_submissions(spark, rows), 2, 3, 60).collect()}
    assert got == replayed(rows, 2, 3, 60) and len(set(got.values())) == 4
    assert L.busy_periods(as_submissions(spark, rows)).select("period").distinct().count() > 50
    busy = [(i, f"c{i % 5}" if i % 9 else None, 10 * (i // 2), 10 * (i // 2) + rng.randint(0, 90), rng.randint(0, 40)) for i in range(400)]  # never idle, equal times, clients without a name
    for rounds in (1, 4):
        got = {r["job_id"]: r["verdict"] for r in L.admission_replay(as_submissions(spark, busy), 2, 3, 60, rounds).collect()}
        assert got == replayed(busy, 2, 3, 60)


def test_jobs_that_never_end_are_settled_by_bounds(spark, monkeypatch):
    """Where jobs stay open for good nothing is left to run through one after another."""
    rng = random.Random(11)
    rows = [(i, f"c{i}", 7 * i, None if i % 100 == 5 else 7 * i + rng.randint(1, 5), 1) for i in range(1500)]
    monkeypatch.setattr(L, "_replayed", None)
    got = {r["job_id"]: (r["verdict"], r["all_open"]) for r in L.admission_replay(as_submissions(spark, rows), 2, 4, 600, 12).collect()}
    assert {k: v for k, (v, _) in got.items()} == replayed(rows, 2, 4, 600) and got[1499] == ("queue_full", 4)


def test_admission_in_stretches(spark):
    """Stretches that run side by side and again, each from what those before it left open, give what one scan gives."""
    rng = random.Random(5)
    busy = [(i, f"c{i % 5}" if i % 9 else None, at, None if i % 301 == 7 else at + rng.choice([0, 20, 90, 4000]), rng.randint(0, 40)) for i in range(1200) for at in [10 + 10 * (i // 2)]]
    for capacity, storage in ((3, 60), (6, 200), (0, 60)):
        df = L._replayed(as_submissions(spark, busy), len(busy), 2, capacity, storage, stretch_jobs=150)
        got = {r["job_id"]: r["verdict"] for r in df.collect()}
        assert got == replayed(busy, 2, capacity, storage)
        shares = df.groupBy(F.spark_partition_id()).count().collect()
        assert len(shares) == 8 and max(r["count"] for r in shares) < 400  # no task has all of a service that is never idle


def test_admission_of_nothing(spark):
    assert L.admission_replay(as_submissions(spark, []), 1, 1, 1).count() == 0


def test_prefix_sum(spark):
    rng = random.Random(2)
    rows = [(i, rng.randint(0, 200_000), rng.randint(-5, 5)) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, at long, v long").withColumn("at", F.timestamp_seconds("at").cast("timestamp_ntz"))
    total, want = 0, {}
    for i, _, v in sorted(rows, key=lambda r: (r[1], r[0])):
        want[i] = total
        total += v
    assert {r["id"]: r["s"] for r in L.prefix_sum(df, ["at", "id"], "v", "s").collect()} == want


def test_one_second_is_dealt_over_tasks(spark):
    """A million rows of one second: their sums are right, and no task has more than a share of them."""
    df = spark.range(1_000_000).select(F.col("id").alias("job_id"), F.lit("queued").alias("status"), F.timestamp_seconds(F.lit(5)).alias("created_at"))
    x = L.queue_positions(df)
    assert x.filter("queue_position <> job_id + 1").count() == 0
    shares = L.prefix_sum(df, ["created_at", "job_id"], "job_id", "s").groupBy(F.spark_partition_id()).count().collect()
    assert len(shares) >= 4 and max(r["count"] for r in shares) < 500_000


def test_jobs_without_a_time(spark):
    rows = [(1, "queued", None), (2, "queued", 5), (3, "queued", None), (4, "failed", None), (5, None, 7)]
    df = spark.createDataFrame(rows, "job_id long, status string, at long").withColumn("created_at", F.timestamp_seconds("at"))
    assert {r["job_id"]: r["queue_position"] for r in L.queue_positions(df).collect()} == {1: 1, 3: 2, 2: 3, 4: 0, 5: 0}


def test_read_ledger(spark, tmp_path):
    for folder, text in (("j1", '{"id": "j1", "status": "queued",\n "input_size": 7}'), ("j2", '{"id": "other"}'), ("j3", "{broken"), ("j4", '{"id": "j4", "input_size": "much"}'), ("j5", '{"id": "j5", "status": "qu')):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "job.json").write_text(text)
    got = S.read_ledger(spark, str(tmp_path / "*/job.json")).collect()
    assert [(r["id"], r["status"], r["input_size"], r["output_name"]) for r in got] == [("j1", "queued", 7, None)]


def events_of(spark, tmp_path, batches):
    """events as a stream of one file a batch."""
    for i, rows in enumerate(batches):
        df = spark.createDataFrame([(j, c, k, at) for j, c, k, at in rows], "job_id string, client_key string, kind string, at long").withColumn("at", F.timestamp_seconds("at"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
        time.sleep(1.1)  # files are taken in the order of their times
    schema = "job_id string, client_key string, kind string, at timestamp"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "events"))


def rows_of(df, tmp_path, seen=None):
    """All rows so far; seen gets the rows of state after each batch."""
    q = streams.run_to_end(df, str(tmp_path / "rows"), str(tmp_path / "check"))
    if seen is not None:
        seen += [s["numRowsTotal"] for p in q.recentProgress for s in p["stateOperators"]]
    return df.sparkSession.read.schema(df.schema).parquet(str(tmp_path / "rows")).collect()


def test_stream_admission(spark, tmp_path):
    first = [("a", "x", "submit", 10), ("b", "x", "submit", 20), ("c", "y", "submit", 20)]
    later = [("a", "x", "finish", 30), ("d", "x", "submit", 40), ("b", "x", "finish", 45), ("e", "x", "submit", 50)]
    got = {r["job_id"]: (r["open"], r["admitted"]) for r in rows_of(streams.stream_admission(events_of(spark, tmp_path, [first, later]), 1), tmp_path)}
    assert got == {"a": (0, True), "b": (1, False), "c": (0, True), "d": (0, True), "e": (1, False)}


def test_state_of_idle_clients_goes(spark, tmp_path):
    """Jobs without an end leave after their lifetime, by event time and before the timer is due; the state metrics fall to nothing."""
    first = [(f"j{i}", f"c{i}", "submit", 100 + i) for i in range(20)] + [("k", "c3", "submit", 110), ("m", "c4", "submit", 110), ("j4", "c4", "finish", 108)]
    clock = [[("t1", "clock", "finish", 1000)], [("t2", "clock", "finish", 5000)], [("n", "c3", "submit", 5001)]]
    seen = []
    df = streams.stream_admission(events_of(spark, tmp_path, [first, *clock]), 1, 300, "1 second")
    got = {r["job_id"]: (r["open"], r["admitted"]) for r in rows_of(df, tmp_path, seen)}
    assert got["j3"] == (0, True) and got["k"] == (1, False) and got["m"] == (0, True) and got["n"] == (0, True) and len(got) == 23
    assert seen[0] >= 20 and seen[-1] <= 2, seen  # at the end the new job and its timer


def test_stream_timeouts(spark, tmp_path):
    first = [("late", "x", "start", 100), ("done", "x", "start", 100), ("turned", "x", "finish", 140), ("failed", "x", "start", 100), ("open", "x", "start", 4990), ("slow", "x", "start", 100), ("queer", "x", "finish", 900)]
    second = [("done", "x", "finish", 150), ("turned", "x", "start", 139), ("failed", "x", "fail", 145), ("slow", "x", "finish", 701), ("queer", "x", "start", 250)]  # an end may come before its start, or after its deadline
    clock = [[("clock", "x", "submit", at)] for at in (300, 5000, 5001)]
    batches = [[e for e in first if e[0] != "open"], second, clock[0], [e for e in first if e[0] == "open"], *clock[1:]]
    seen = []
    got = {r["job_id"]: r["status"] for r in rows_of(streams.stream_timeouts(events_of(spark, tmp_path, batches), 600, 3600, "1000 seconds"), tmp_path, seen)}
    assert got == {"late": "timeout", "slow": "timeout", "queer": "timeout", "done": "expired", "turned": "expired"}  # the watermark stands at 4001
    assert max(seen) > seen[-1] > 0
    stop = [("clock", "x", "submit", at) for at in (9000, 9001)]
    for e in stop:  # a restart from the checkpoint, with what was open
        later = events_of(spark, tmp_path, [[e]])
        got |= {r["job_id"]: r["status"] for r in rows_of(streams.stream_timeouts(later, 600, 3600, "1000 seconds"), tmp_path, seen)}
    late = events_of(spark, tmp_path, [[("older", "x", "start", 100)]])  # the watermark is past it
    got |= {r["job_id"]: r["status"] for r in rows_of(streams.stream_timeouts(late, 600, 3600, "1000 seconds"), tmp_path, seen)}
    assert got == {"late": "timeout", "slow": "timeout", "queer": "timeout", "done": "expired", "turned": "expired", "open": "timeout"}
    assert seen[-1] == 0


def test_stream_capacity(spark, tmp_path):
    first = [("a", "x", "submit", 1), ("b", "x", "submit", 2), ("c", "x", "submit", 3), ("a", "x", "start", 4)]
    second = [("a", "x", "finish", 9), ("b", "x", "start", 6), ("c", "x", "fail", 7), ("d", "x", "submit", 8), ("b", "x", "submit", 2), ("a", "x", "start", 8)]
    third = [[(f"e{i}", "x", k, 100 + i) for i in range(50) for k in ("submit", "start", "finish")], [("f", "x", "submit", 5000)], [("f", "x", "start", 5001)], [("f", "x", "start", 5002)]]
    seen = []
    q = streams.stream_capacity(events_of(spark, tmp_path, [first, second, *third]), str(tmp_path / "out"), str(tmp_path / "check"), "10 seconds")
    q.awaitTermination(120)
    got = {r["status"]: r["n_jobs"] for r in streams.capacity_at(spark, str(tmp_path / "out")).collect()}
    assert got == {"succeeded": 51, "converting": 2, "failed": 1, "queued": 1}
    seen = [s["numRowsTotal"] for p in q.recentProgress for s in p["stateOperators"]]
    assert max(seen) >= 53 and seen[-1] <= 3, seen  # b, d and f are open


def test_state_is_held_by_groups(spark, tmp_path):
    """State calls follow the groups, not the jobs: twenty thousand jobs at once leave a packed value a group."""
    first = [(f"j{i}", f"c{i}", k, 100 + i % 7 + s) for i in range(20_000) for s, k in enumerate(("submit", "start", "finish"))]
    q = streams.stream_capacity(events_of(spark, tmp_path, [first]), str(tmp_path / "out"), str(tmp_path / "check"), "1000 seconds")
    q.awaitTermination(120)
    assert [(r["status"], r["n_jobs"]) for r in streams.capacity_at(spark, str(tmp_path / "out")).collect()] == [("succeeded", 20_000)]
    seen = [s["numRowsTotal"] for p in q.recentProgress for s in p["stateOperators"]]
    assert 0 < max(seen) <= streams.GROUPS


def test_folders_are_dealt_by_rows(spark, tmp_path):
    """What a folder costs does not show in bytes: a few small rows are still dealt over tasks."""
    rows = spark.range(1200).select(F.col("id").alias("job"), F.format_string("record %d", "id").alias("value"))
    S.write_folders(rows, "job", str(tmp_path / "out"), 100)
    assert sorted(p.name for p in (tmp_path / "out").glob("job=*")) == sorted(f"job={i}" for i in range(1200))
    assert len({p.name.split("-")[1] for p in (tmp_path / "out").glob("job=*/part-*")}) > 8
