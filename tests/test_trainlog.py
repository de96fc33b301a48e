import datetime as dt
import random

import pytest

from docloom.operators import trainlog as L
from docloom.plans.segments import position
from docloom.streaming import stream_token_speed, token_speed
from pyspark.sql import functions as F

START = dt.datetime(2024, 1, 1)


def make_log(seed=1):
    """Runs of very different length, with restarts and repeated steps."""
    rng = random.Random(seed)
    rows = []
    for run, n in ((0, 400), (1, 30), (2, 1), (3, 12)):
        step, ts = 0, START
        for _ in range(n):
            rows.append((run, step, ts, round(rng.random(), 2)))
            step = max(0, step + rng.choice([0, 1, 1, 2, -3]))
            ts += dt.timedelta(seconds=rng.randint(1, 5000))
    return rows


def watched(rows, per_step):
    out = {}
    for run in {r[0] for r in rows}:
        last = None
        for _, step, ts, _ in (r for r in rows if r[0] == run):
            if last is None:
                last = (step, ts)
            elif step > last[0]:
                out[run, step] = (step - last[0]) * per_step / (ts - last[1]).total_seconds()
                last = (step, ts)
    return out


@pytest.mark.parametrize("hours", [1, 24, 10_000])
def test_tokens_per_second(spark, hours):
    rows = make_log()
    log = spark.createDataFrame(rows, "run bigint, step bigint, ts timestamp, loss double").repartition(4)
    got = {(r.run, r.step): r.tokens_per_second for r in L.tokens_per_second(log, 10, hours * 3_600_000_000).collect()}
    expected = watched(rows, 10)
    assert got.keys() == expected.keys()
    assert all(got[k] == pytest.approx(v) for k, v in expected.items())


def stops(losses, patience=3):
    best, waited = None, 0
    for at, loss in enumerate(losses):
        if best is None or loss < best:
            best, waited = loss, 0
        else:
            waited += 1
            if waited >= patience:
                return at
    return None


@pytest.mark.parametrize("segment", [1, 2, 5, 1_000_000])
def test_early_stop_step(spark, segment):
    rng = random.Random(9)
    runs = {r: [rng.choice([0.5, 1, 2, 3]) - 0.2 * i * (r % 2) for i in range(rng.randint(1, 25))] for r in range(40)}
    rows = [(r, i, float(x)) for r, losses in runs.items() for i, x in enumerate(losses)]
    log = spark.createDataFrame(rows, "run bigint, step bigint, loss double")
    got = {r.run: r.stop_step for r in L.early_stop_step(log, segment_steps=segment).collect()}
    assert got == {r: at for r, losses in runs.items() if (at := stops(losses)) is not None}


def test_position_of_a_hot_key(spark):
    rows = spark.range(500).select(F.when(F.col("id") < 400, 0).otherwise(F.col("id")).alias("k"), "id")
    got = position(rows, ["k"], [F.col("id")], [F.floor(F.col("id") / 16)], "at").collect()
    assert all(r["at"] == (r.id + 1 if r.id < 400 else 1) for r in got)


def test_stream_equals_batch_over_many_micro_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_speed, "MERGED", 3)
    rows = sorted(make_log(2), key=lambda r: r[2])
    schema = "run bigint, step bigint, ts timestamp, loss double"
    for n, at in enumerate(range(0, len(rows), 60)):
        part = spark.createDataFrame(rows[at : at + 60], schema)
        part.coalesce(1).write.parquet(str(tmp_path / "log" / f"part={n:03d}"))
        stream = spark.readStream.schema("run bigint, step bigint, ts timestamp").parquet(str(tmp_path / "log" / "part=*"))
        stream_token_speed(
            stream, str(tmp_path / "out"), str(tmp_path / "state"), str(tmp_path / "checkpoint"), per_step=10
        ).awaitTermination()
        # a micro-batch leaves its own runs only, and what was merged goes one micro-batch later
        state = spark.read.parquet(str(tmp_path / "state" / f"epoch={n}"))
        assert {r.run for r in state.collect()} == {r[0] for r in rows[at : at + 60]}
        kept = {p.name for p in (tmp_path / "state").iterdir()}
        due = n - n % 3
        older = {f"epoch={e}" for e in range(due - 3, due)} | {f"merged={due - 3}"} if due and n == due else set()
        assert kept <= {f"epoch={e}" for e in range(due, n + 1)} | {f"merged={due}"} | older
    assert n >= 7
    got = {(r.run, r.step): r.tokens_per_second for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    expected = watched(rows, 10)
    assert got.keys() == expected.keys()
    assert all(got[k] == pytest.approx(v) for k, v in expected.items())
