import datetime as dt

from pyspark.sql import functions as F

from terraloom.streaming import feeds as fd

SCHEMA = "k string, ts timestamp, value double"
T0 = dt.datetime(2024, 1, 1)


def land(spark, path, rows):
    df = spark.createDataFrame([(k, T0 + dt.timedelta(seconds=s), float(v)) for k, s, v in rows], SCHEMA)
    df.coalesce(1).write.mode("append").parquet(path)


def stream(spark, path, max_files=None):
    return fd.landed(spark, path, spark.createDataFrame([], SCHEMA).schema, "ts", max_files=max_files)


def test_windows_wait_for_the_watermark(spark, tmp_path):
    p = str(tmp_path / "in")
    land(spark, p, [("a", 0, 1), ("a", 3600, 3), ("a", 86400, 5), ("a", 6 * 86400, 7)])
    out = fd.drain(fd.tumbling_means(stream(spark, p), ["k"], "value"), "t").orderBy("start").collect()
    assert [(r.mean, r.n) for r in out] == [(2.0, 2), (5.0, 1)]


def test_spell_closes_after_a_gap(spark, tmp_path):
    p = str(tmp_path / "in")
    day = 86400
    land(spark, p, [("a", 0, 9), ("a", day, 9), ("a", 2 * day + 10, 9), ("a", 3 * day, 1), ("a", 5 * day, 9), ("a", 30 * day, 9)])
    s = fd.drain(fd.spells(stream(spark, p), ["k"], F.col("value") > 5), "s").orderBy("first").collect()
    assert [r.n for r in s] == [2, 1, 1] or [r.n for r in s] == [3, 1]


def test_upsert_is_idempotent_and_takes_late_rows(spark, tmp_path):
    p, out = str(tmp_path / "in"), str(tmp_path / "out")
    write = fd.upsert_into(out)
    land(spark, p, [("a", 100, 1), ("b", 100, 2)])
    b0 = spark.read.schema(SCHEMA).parquet(p)
    write(b0, 0)
    write(b0, 0)
    write(spark.createDataFrame([("a", T0 - dt.timedelta(days=40), 9.0)], SCHEMA), 1)
    got = {r.k: r.value for r in fd.current_observations(spark, out, ["k"], "ts").collect()}
    assert got == {"a": 9.0, "b": 2.0} and spark.read.parquet(out).count() == 3


def greedy(times, cooldown, cap):
    out = []
    for t in sorted(times):
        if len(out) < cap and (not out or t >= out[-1] + cooldown):
            out.append(t)
    return out


def test_limiter_across_batches(spark, tmp_path):
    p = str(tmp_path / "in")
    a = [0, 10, 29, 30, 31, 61, 62, 95, 130, 131, 170, 205, 300, 400]
    for part in (a[:6], a[6:10], a[10:]):
        land(spark, p, [("a", s, 0) for s in reversed(part)] + [("b", part[0], 0)])
    lim = fd.rate_limited(stream(spark, p, 1), ["k"], 30.0, 6)
    got = fd.drain(lim, "l").orderBy("k", "n").collect()
    secs = [int((r.ts - T0).total_seconds()) for r in got if r.k == "a"]
    assert len(secs) == 6 and all(y - x >= 30 for x, y in zip(secs, secs[1:]))
    one = str(tmp_path / "one")
    land(spark, one, [("a", s, 0) for s in a])
    secs = [int((r.ts - T0).total_seconds()) for r in fd.drain(fd.rate_limited(stream(spark, one), ["k"], 30.0, 6), "l1").orderBy("n").collect()]
    assert secs == greedy(a, 30, 6)


def test_static_join_dedupe_latest_sliding(spark, tmp_path):
    p = str(tmp_path / "in")
    land(spark, p, [("a", 0, 10), ("a", 60, 11), ("b", 60, 4), ("a", 20 * 86400, 1)])
    clim = spark.createDataFrame([("a", 1, 8.0), ("b", 1, 5.0)], "k string, doy int, normal double")
    got = fd.drain(fd.with_anomaly(stream(spark, p), clim, "value", "normal", ["k"]), "a").select("k", "anomaly").collect()
    assert sorted((r.k, r.anomaly) for r in got if r.anomaly is not None) == [("a", 2.0), ("a", 3.0), ("b", -1.0)]
    assert sorted((r.k, r.n) for r in fd.drain(fd.first_in_slot(stream(spark, p), ["k"]), "d").collect()) == [("a", 2), ("b", 1)]
    last = fd.drain(fd.latest_per_station(stream(spark, p), ["k"], "value"), "x").collect()
    assert {(r.k, r.latest) for r in last} == {("a", 11.0), ("b", 4.0)}
    sl = fd.drain(fd.sliding_sums(stream(spark, p), ["k"], "value"), "y").filter("k = 'a'").collect()
    assert len(sl) == 7 and {r.total for r in sl} == {21.0}


def test_registered_streams_read_folder_tables(spark, tmp_path):
    """A table stored as a folder of part files gives what the single file gives."""
    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.001"
    spark.read.parquet(f"{sf}/events.parquet").repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    for name in ("stream_daily", "stream_sliding", "stream_sessions", "stream_latest", "stream_upsert", "stream_anomaly", "stream_rate_limit", "stream_alert_dedupe"):
        one, many = (sorted(map(tuple, entry.queries()[name](spark, d).collect())) for d in (sf, str(tmp_path)))
        assert one == many and one, name


def test_alerts_hours_apart_are_kept(spark, tmp_path):
    p = str(tmp_path / "in")
    h = 3600
    land(spark, p, [("a", s, 1) for s in (0, h, 4 * h, 11 * h, 40 * h)] + [("b", 5 * h, 1), ("a", 30 * 24 * h, 1)])
    got = fd.drain(fd.first_in_slot(stream(spark, p), ["k"]), "alerts").collect()
    assert sorted((r.k, int((r.first - T0).total_seconds()) // h, r.n) for r in got) == [("a", 0, 2), ("a", 4, 1), ("a", 11, 1), ("a", 40, 1), ("b", 5, 1)]


def test_sessions_are_merged_before_the_exchange(spark, tmp_path):
    """One key with nine tenths of the rows: its sessions leave each task merged."""
    p = str(tmp_path / "in")
    rows = [("hot", 60 * k, 9) for k in range(900)] + [(f"k{k}", 50 * k, 9) for k in range(100)] + [("end", 40 * 86400, 9)]
    land(spark, p, rows)
    q = fd.spells(stream(spark, p), ["k"], F.col("value") > 5).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    plan = q._jsq.explainInternal(False)
    below = plan[plan.index("Exchange") :]  # plans are printed from the result down to the source
    assert "MergingSessions" in below and "MergingSessions" in plan[: plan.index("Exchange")]
    s = {r.k: r.n for r in fd.drain(fd.spells(stream(spark, p), ["k"], F.col("value") > 5), "s").collect()}
    assert s["hot"] == 900 and len(s) == 101
