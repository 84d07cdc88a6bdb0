"""Alert rules that must hold for a while, value steps that compose, and ranges of equal size."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from loamwork.functions.storage import new_path
from loamwork.operators import metrics as P
from loamwork.operators import policy as L
from loamwork.operators import sessions as M
from loamwork.streaming import jobs as X

RULES = [P.AlertRule("errors", "errors", 0.004, 15, 10), P.AlertRule("silent", "silent", 0, 10, 10), P.AlertRule("gauge", "gauge", 2.0, 10, 5)]
SCHEMA = "event_id long, endpoint string, ts timestamp, seconds double, error boolean"


def made(seed, n=300):
    rng, t, rows = random.Random(seed), 1_700_000_100, []
    for i in range(n):
        t += rng.choice([20, 60, 200, 1500])
        rows.append((i, rng.choice("ab"), t, rng.choice([0.5, 1.0, 2.5, 3.0, None]), rng.random() < 0.4))
    return rows


def machine(rows, step=300, until=None):
    """(rule, endpoint, state, at), evaluated bin by bin."""
    bins = defaultdict(list)
    for r in rows:
        if until is None or (r[2] // step + 1) * step <= until:
            bins[r[1], r[2] // step].append(r)
    out = []
    for key in {k for k, _ in bins}:
        own = [b for k, b in bins if k == key]
        for rule in RULES:
            since, back = None, rule.window * 60 // step
            for b in range(min(own), max(own) + 1):
                seen = [r for x in range(max(b - back + 1, min(own)), b + 1) for r in bins.get((key, x), [])]
                newest = {x: max(bins[key, x], key=lambda r: (r[2], r[0]))[3] for x in range(b - back + 1, b + 1) if (key, x) in bins}
                told = [newest[x] for x in sorted(newest) if newest[x] is not None]
                holds = {"errors": sum(r[4] for r in seen) / (rule.window * 60) > rule.limit, "silent": not seen, "gauge": bool(told) and told[-1] > rule.limit}[rule.kind]
                at = (b + 1) * step
                if not holds:
                    if since is not None:
                        out.append((rule.name, key, "resolved", at))
                    since = None
                    continue
                if since is None:
                    since = at
                    out.append((rule.name, key, "pending", at))
                if at - since == -(-rule.hold * 60 // step) * step:
                    out.append((rule.name, key, "firing", at))
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, k, t, s, e) for i, k, t, s, e in rows], "event_id long, endpoint string, t long, seconds double, error boolean").select("event_id", "endpoint", F.timestamp_seconds("t").alias("ts"), "seconds", "error")


@pytest.mark.parametrize("seed", [1, 2])
def test_alert_intervals(spark, seed):
    rows = made(seed)
    bins = P.metric_bins(frame(spark, rows), 5, ["endpoint"])
    got = []
    for rule in RULES:
        for r in P.alert_intervals(bins, rule, 5, ["endpoint"]).collect():
            got += [(r.rule, r.endpoint, x, r[x]) for x in ("pending", "firing", "resolved") if r[x] is not None]
    assert sorted(got) == machine(rows)
    assert {x[:1] + x[2:3] for x in got} >= {("errors", "firing"), ("silent", "firing"), ("gauge", "firing"), ("gauge", "resolved")}
    assert P.alert_intervals(bins.where("false"), RULES[0], 5, ["endpoint"]).collect() == []


def stream(spark, batches):
    path = new_path(spark, "alerts")
    for rows in batches:
        frame(spark, rows).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def test_alerts_on_a_stream_with_late_rows(spark):
    rows = made(3)
    late = rows[150]  # arrives a batch later, within the watermark
    batches = [rows[:150], [r for r in rows[151:] if r[2] - late[2] < 500], [late, *(r for r in rows[151:] if r[2] - late[2] >= 500)]]
    out, check = new_path(spark, "out"), new_path(spark, "check")
    moves = X.timed_alerts(stream(spark, batches), RULES, 5, "endpoint")
    run = lambda m, check, out: m.writeStream.trigger(availableNow=True).option("checkpointLocation", check).format("parquet").option("path", out).start().awaitTermination()
    with X.rocksdb_state(spark):
        run(moves, check, out)
    got = sorted(map(tuple, spark.read.schema(moves.schema).parquet(out).collect()))
    until = max(r[2] for r in rows) - 600
    assert got == machine(rows, until=until)
    much_later = (900, "a", rows[0][2] - 100_000, 9.0, True)
    again, out2 = stream(spark, [rows[:200], rows[200:250], [*rows[250:], much_later]]), new_path(spark, "out")  # Spark drops by the watermark of the batch before
    with X.rocksdb_state(spark):
        run(X.timed_alerts(again, RULES, 5, "endpoint"), new_path(spark, "check"), out2)
    assert sorted(map(tuple, spark.read.schema(moves.schema).parquet(out2).collect())) == machine(rows, until=until)


def test_a_batch_without_moves(spark):
    at = lambda n: 1_700_000_100 + n * 300
    calm = [(n, "b", at(n), 1.0, False) for n in range(12)]
    loud = [(100 + n, "a", at(n), 3.0, True) for n in range(12)]
    rows = [*calm, *loud]
    moves = X.timed_alerts(stream(spark, [calm[:6] + loud[:6], calm[6:] + loud[6:]]), RULES, 5, "endpoint")
    out = new_path(spark, "out")
    with X.rocksdb_state(spark):
        moves.writeStream.trigger(availableNow=True).option("checkpointLocation", new_path(spark, "check")).format("parquet").option("path", out).start().awaitTermination()
    got = sorted(map(tuple, spark.read.schema(moves.schema).parquet(out).collect()))
    assert got == machine(rows, until=max(r[2] for r in rows) - 600) and {x[1] for x in got} == {"a"}


def test_steps_compose(spark, monkeypatch):
    monkeypatch.setattr(P, "RANGE_ROWS", 20)
    rng = random.Random(4)
    log = [(rng.choice(L.STATES[:2]), "medium" if rng.random() < 0.9 else "low", rng.uniform(-1, 1), i) for i in range(400)]
    target, want = new_path(spark, "values"), {}
    step = X.q_batch(target, 0.1)
    for epoch, (a, b) in enumerate([(0, 150), (150, 151), (151, 151), (151, 400)]):
        part = log[a:b]
        step(spark.createDataFrame(rng.sample(part, len(part)), "state string, action string, reward double, seq long"), epoch)
        if epoch == 1:  # a batch that runs again changes nothing twice
            step(spark.createDataFrame(part, "state string, action string, reward double, seq long"), epoch)
    for s, a, r, _ in log:
        n, q = want.get((s, a), (0, 0.5 if a == "medium" else 0.3))
        want[s, a] = n + 1, q + 0.1 * (r - q)
    got = {(r.state, r.action): (r.n, r.q) for r in X.stored(spark, target).collect()}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(abs(got[k][1] - want[k][1]) < 1e-9 for k in want)


def test_ranges_hold_equally_many_rows(spark):
    outlier = spark.range(100_000).select("id").unionByName(spark.createDataFrame([(10**12,)], "id long"))
    sizes = [r["count"] for r in P.in_ranges(outlier, ["id"], 64).groupBy("_range").count().collect()]
    assert len(sizes) >= 60 and max(sizes) < 4000
    ties = spark.range(20_000).select(F.lit(5).alias("t"), "id")
    sizes = [r["count"] for r in P.in_ranges(ties, ["t", "id"], 16).groupBy("_range").count().collect()]
    assert len(sizes) >= 14 and max(sizes) < 4000
    cuts = P.in_ranges(outlier, ["id"], 64).groupBy("_range").agg(F.min("id").alias("a"), F.max("id").alias("b")).orderBy("_range").collect()
    assert all(x.b < y.a for x, y in zip(cuts, cuts[1:], strict=False))


def test_trim_with_an_outlier(spark, monkeypatch):
    monkeypatch.setattr(P, "RANGE_ROWS", 50)
    rows = [(i, 10**12 if i == 7 else (i * 37) % 500) for i in range(1000)]
    df = spark.createDataFrame(rows, "id long, at long")
    got = {r.id for r in M.lru_trim(df, 600, ["at", "id"]).collect()}
    want = {i for i, _ in sorted(rows, key=lambda r: (r[1], r[0]))[400 + 120 :]}
    assert got == want
