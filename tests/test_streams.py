"""The fact fed by drops, running flags, and exports as a stream, each against the same done at once."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import baselines
from tidemark.schema import COLUMNS, UNIFIED
from tidemark.streaming import fact, flags


def row(day, campaign="google_1", spend=1.0, revenue=2.0, drop=None):
    own = (day, "google", campaign, "n", "SEARCH", spend, revenue, 1, 2, 1.0, 5.0)
    return own if drop is None else (*own, drop)


DAY = dt.date(2025, 1, 1)


def days(n, zero=(), campaign="google_1"):
    return [row(DAY + dt.timedelta(i), campaign, 1.0 + i, 0.0 if i in zero else 3.0) for i in range(n)]


def put(spark, rows, folder, schema=fact.DROPPED):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def run(spark, tmp_path):
    fact.feed(fact.read_drops(spark, str(tmp_path / "in"), 1), str(tmp_path / "fact"), str(tmp_path / "checkpoint")).awaitTermination()
    return sorted(((str(r.date), r.campaign_id, r.spend) for r in fact.fact(spark, str(tmp_path / "fact")).collect()), key=repr)


def test_last_drop_counts_whenever_it_comes(spark, tmp_path):
    assert fact.fact(spark, str(tmp_path / "none")).count() == 0
    put(spark, [row(DAY, spend=5.0, drop=7), row(DAY, spend=4.0, drop=6), row(DAY, "google_2", 1.0, drop=1)], str(tmp_path / "in"))
    assert run(spark, tmp_path) == [("2025-01-01", "google_1", 5.0), ("2025-01-01", "google_2", 1.0)]
    put(spark, [row(DAY, spend=3.0, drop=3), row(DAY, spend=5.0, drop=7), row(DAY, "google_2", 2.0, drop=2)], str(tmp_path / "in"))  # older, again, newer
    want = [("2025-01-01", "google_1", 5.0), ("2025-01-01", "google_2", 2.0)]
    assert run(spark, tmp_path) == want
    assert run(spark, tmp_path) == want  # nothing new
    fact.compact(spark, str(tmp_path / "fact"))
    assert run(spark, tmp_path) == want and fact.rows_of(spark, str(tmp_path / "fact")).count() == 2
    put(spark, [row(DAY, None, 9.0, drop=1), row(None, "google_1", 8.0, drop=1)], str(tmp_path / "in"))
    assert len(run(spark, tmp_path)) == 4
    assert tuple(fact.fact(spark, str(tmp_path / "fact")).columns) == COLUMNS


def test_a_batch_that_runs_again_replaces_its_folder(spark, tmp_path):
    """As after a failure between the write and the commit: the batch's rows count once."""
    put(spark, [row(DAY, drop=1), row(DAY, drop=1)], str(tmp_path / "in"))
    once = run(spark, tmp_path)
    for f in (tmp_path / "checkpoint" / "commits").glob("[0-9.]*"):
        f.unlink()
    assert run(spark, tmp_path) == once
    assert fact.rows_of(spark, str(tmp_path / "fact")).count() == 1


def test_order_of_batches_does_not_matter(spark):
    rng = random.Random(3)
    rows = [row(DAY + dt.timedelta(rng.randrange(4)), f"c{rng.randrange(3)}", float(rng.randrange(3)), drop=rng.randrange(5)) for _ in range(60)]
    want = sorted(map(repr, fact.latest(spark.createDataFrame(rows, fact.DROPPED)).collect()))
    for _ in range(2):
        rng.shuffle(rows)
        parts = [fact.latest(spark.createDataFrame(rows[i::3], fact.DROPPED)) for i in range(3)]
        assert sorted(map(repr, fact.latest(parts[0].unionByName(parts[1]).unionByName(parts[2])).collect())) == want


@pytest.fixture
def state_store(spark):
    before = spark.conf.get(flags.STORE[0])
    spark.conf.set(*flags.STORE)
    yield
    spark.conf.set(flags.STORE[0], before)


def follow(spark, tmp_path, parts, **settings):
    for part in parts:
        put(spark, part, str(tmp_path / "in"), UNIFIED)
        stream = flags.running_flags(spark.readStream.schema(UNIFIED).parquet(str(tmp_path / "in")), **settings)
        stream.writeStream.outputMode("update").foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(str(tmp_path / f"flags/batch={n}"))).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    return flags.last_flags(spark.read.parquet(str(tmp_path / "flags")).drop("batch"))


def test_running_flags_equal_those_at_once(spark, tmp_path, state_store):
    """Rows out of order within the watermark, equal days, null amounts; a campaign that stops has a gap."""
    rng = random.Random(5)
    rows = days(70, zero=range(20, 27)) + days(41, zero=range(33, 41), campaign="google_2") + [row(DAY, "google_3", None, None), row(DAY, "google_3", 4.0, 0.0), row(DAY, "google_3", 2.0, 1.0)]
    parts = [[] for _ in range(4)]
    for r in rows:
        age = (r[0] - DAY).days
        parts[min(3, (age + 5 * (rng.random() < 0.3)) // 18)].append(r)
    for p in parts:
        rng.shuffle(p)
    got = {r.entity_id: r for r in follow(spark, tmp_path, parts, days=7, gap_days=15).collect()}
    fact_df = spark.createDataFrame(rows, UNIFIED)
    at_once = {r.entity_id: r for r in baselines.zero_revenue(fact_df, 7).join(baselines.cost_inflation(fact_df), "entity_id").collect()}
    assert set(got) == set(at_once)
    for k, r in got.items():
        want = at_once[k]
        assert (r.longest_zero_run, r.zero_revenue, r.early_ratio, r.late_ratio, r.cost_inflation) == (want.longest_zero_run, want.zero_revenue, want.early_ratio, want.late_ratio, want.cost_inflation)
    assert (got["google_1"].rows, got["google_1"].gap, got["google_2"].gap, str(got["google_2"].last)) == (70, False, True, "2025-02-10")


def test_the_halves_move_on_row_by_row():
    own = flags.Campaign(None, ())
    for i in range(1, 12):
        own.add((DAY, float(i), 1.0, 0, 0, 0, 0))
        assert own.early_spend == sum(range(1, i // 2 + 1)) and own.late_spend == sum(range(i // 2 + 1, i + 1)) and len(own.late) == i - i // 2
    again = flags.Campaign(own.settled(), list(own.late))
    again.add((DAY, 12.0, 0.0, 0, 0, 0, 0))
    assert (again.n, again.early_spend, again.run, again.longest) == (12, 21.0, 1, 1)


def test_latest_takes_one_shuffle_and_one_sort(spark):
    plan = fact.latest(spark.createDataFrame([row(DAY, drop=1)], fact.DROPPED))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and plan.count("Sort [") == 1


def test_rows_at_once_or_one_by_one(spark):
    """A campaign's numbers don't depend on how its rows are cut; nulls are no revenue, but end a run without it."""
    rng = random.Random(7)
    rows = [(DAY + dt.timedelta(i), *(rng.choice((None, 0.0, 0.0, float(rng.randrange(9)))) for _ in range(6))) for i in range(60)]
    one, some = flags.Campaign(None, ()), flags.Campaign(None, ())
    for r in rows:
        one.add(r)
    table = flags.np.array([[(r[0] - flags.EPOCH).days, *(flags.np.nan if x is None else x for x in r[1:])] for r in rows], float)
    for a, b in ((0, 1), (1, 8), (8, 8), (8, 41), (41, 60)):
        some.extend(table[a:b])
        some = flags.Campaign(some.settled(), flags.np.frombuffer(some.late.tobytes()))
    assert some.settled() == one.settled() and some.late.tolist() == one.late.tolist()
    revenue = [r[flags.REVENUE] for r in rows]
    assert one.longest == max(len(x) for x in "".join("z" if x == 0 else "-" for x in revenue).split("-"))
    assert (one.early_revenue, one.late_revenue) == (sum(x or 0 for x in revenue[:30]), sum(x or 0 for x in revenue[30:]))


def test_a_campaigns_state_is_one_value(spark, tmp_path, state_store):
    follow(spark, tmp_path, [days(40)], days=7, gap_days=15)
    state = spark.read.format("statestore").option("stateVarName", "campaign").load(str(tmp_path / "checkpoint"))
    assert state.count() == 1


def test_more_rows_make_more_files(spark, tmp_path):
    """Drops are written as tasks have them: no fixed number of files, whose tasks would grow with the table."""
    from tidemark.plans import catalogue

    assert catalogue._as_files(spark.range(200).repartition(20), str(tmp_path / "in")) == 20
    assert catalogue._as_files(spark.range(200).repartition(12), str(tmp_path / "in"), 20) == 12
