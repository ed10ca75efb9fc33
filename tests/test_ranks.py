import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.operators import intensity as it
from sightline.operators.ranks import bounded_quantiles, bucketed, group_quantiles, quantiles_from_runs, running_sums
from sightline.sources import fixtures as fx

PROBS = {"lo": 0.0, "a": 0.025, "m": 0.5, "b": 0.975, "hi": 1.0}


@pytest.fixture(scope="module")
def values(spark):
    """One large group, a third of it a single value, and two small ones."""
    i = F.col("id")
    group = F.when(i < 60000, 0).when(i < 60007, 1).otherwise(2)
    v = F.when(i % 3 == 0, 0.25).otherwise((i * 7919 % 104729) / 1000.0)
    return spark.range(60010).select(group.alias("g"), v.cast("double").alias("v")).cache()


def test_group_quantiles_equal_percentile(values):
    got = {r.g: tuple(r)[1:] for r in group_quantiles(values, ["g"], "v", PROBS).select("g", *PROBS).collect()}
    want = {r.g: tuple(r)[1:] for r in bounded_quantiles(values, ["g"], "v", PROBS).select("g", *PROBS).collect()}
    assert got.keys() == want.keys()
    for g in want:
        assert got[g] == pytest.approx(want[g], abs=1e-9)


def test_running_sums_and_quantiles_from_runs(spark, values):
    unit = values.filter("g = 0").groupBy((F.col("v") / 105).alias("u")).agg(F.count("*").alias("w")).withColumn("g", F.lit(0))
    runs = running_sums(unit, ["g"], "u", ["w"], rows=500)
    rows = runs.orderBy("u").collect()
    assert np.array_equal(np.cumsum([r.w for r in rows]), [r.w_run for r in rows])
    assert {r.w_all for r in rows} == {60000}
    probs = [0.0, 0.1, 0.5, 0.9, 1.0]
    got = {r.p: r.quantile for r in quantiles_from_runs(runs, ["g"], "u", "w", probs).collect()}
    whole = np.repeat([r.u for r in rows], [r.w for r in rows])
    for p in probs:
        assert got[p] == pytest.approx(np.quantile(whole, p), abs=1e-12)


def test_packed_values_spread_over_buckets(spark):
    """Nearly all values in a millionth of the range: no bucket holds much more than its share."""
    u = F.when(F.col("id") < 9900, 0.5 + F.col("id") / 1e12).otherwise(F.col("id") / 1e4)
    df = spark.range(10000).select(F.lit(1).alias("g"), u.alias("u"), F.lit(1).alias("w")).cache()
    sizes = [r["count"] for r in bucketed(df, ["g"], "u", rows=500).groupBy("bucket").count().collect()]
    assert len(sizes) == 20 and max(sizes) <= 600 and sum(sizes) == 10000
    rows = running_sums(df, ["g"], "u", ["w"], rows=500).orderBy("u").collect()
    assert [r.w_run for r in rows] == list(range(1, 10001))


def _below(plan, node):
    """The subtrees of a printed plan whose top names ``node``."""
    lines = plan.splitlines()
    depth = [len(line) - len(line.lstrip(" :+-*|")) for line in lines]
    for i, line in enumerate(lines):
        if node in line:
            end = next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))
            yield "\n".join(lines[i:end])


def test_values_of_draws_are_not_broadcast(spark, tmp_path):
    """Each draw makes 71 values; Spark takes them for as small as the draws, and only the brackets may travel."""
    vector = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda k: (F.hash("id", k) / 2.0 ** 32 + 0.5).cast("float"))
    rows = spark.range(60000).select(F.col("id").alias("vec_id"), vector.alias("embedding"), F.lit(0).alias("label"))
    rows.write.parquet(str(tmp_path / "embeddings.parquet"))  # too large to broadcast as a file
    found = group_quantiles(it.curve_social(fx.draws(spark, str(tmp_path))), ["i"], "value", it.BAND)
    assert len(found.collect()) == 71
    sent = list(_below(found._jdf.queryExecution().executedPlan().toString(), "BroadcastExchange"))
    assert sent and not any("Generate" in s and "Aggregate" not in s for s in sent)


def test_brackets_narrow_to_the_wanted_ranks(spark, frame):
    """Ties, infinities, NaN, negative numbers and tiny ones, in more groups than an object aggregate holds."""
    inf, nan = float("inf"), float("nan")
    odd = [-inf, -1e300, -3.5, -1e-9, -0.0, 0.0, 1e-12, 2.0, 2.0, 2.0, 7.25, 1e300, inf, nan]
    rows = [(g, v) for g in range(150) for v in ([odd[(g + j) % 14] for j in range(g % 5 + 1)] if g % 3 else [g + j * j / 7 for j in range(40)])]
    df = frame(rows + [(0, None)], "g int, v double")
    want = {r.g: tuple(r)[1:] for r in bounded_quantiles(df, ["g"], "v", PROBS).select("g", *PROBS).collect()}
    for bound in (0, 10, 10 ** 6):
        got = {r.g: tuple(r)[1:] for r in group_quantiles(df, ["g"], "v", PROBS, rows=bound).select("g", *PROBS).collect()}
        assert got.keys() == want.keys()
        for g in want:
            assert got[g] == pytest.approx(want[g], rel=1e-12, nan_ok=True)
    whole = spark.range(5000).select((F.col("id") % 2).alias("g"), (F.col("id") * 10 ** 15 - 10 ** 18).alias("v"))
    got, want = ([tuple(r) for r in f.select("g", *PROBS).orderBy("g").collect()] for f in (
        group_quantiles(whole, ["g"], "v", PROBS, rows=3), bounded_quantiles(whole, ["g"], "v", PROBS)))
    assert got == want


def test_a_task_sees_all_draws_of_its_cells(spark):
    """Counts by cell of ``blocks`` tasks have each cell once; values are those of draws spread over tasks."""
    draws = spark.range(300).select(F.col("id").alias("draw"), (F.col("id") / 300).alias("b0"), (-F.col("id") / 900).alias("b1"))
    pixels = spark.range(0, 103, 2).select(F.col("id").cast("int").alias("cell"), (F.col("id") / 7).alias("depth"))
    blocked = it.predict_draws(draws, pixels, 103, 5)
    held = blocked.withColumn("task", F.spark_partition_id()).select("cell", "task").distinct().groupBy("cell").count()
    assert {r["count"] for r in held.collect()} == {1} and held.count() == 52
    rows = [sorted(tuple(r) for r in f.collect()) for f in (blocked, it.predict_draws(draws, pixels, 103))]
    assert rows[0] == rows[1] and len(rows[0]) == 300 * 52
