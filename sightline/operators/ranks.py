"""Running sums and exact quantiles inside groups that may be too large for one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.session import settle

BUCKETS = 1024
BUCKET_ROWS = 20_000
SKETCH_ACCURACY = 10000
RANK_ROWS = 4_000_000
SLOTS = 32
PASSES = 8
SPANS = 200_000


def bucketed(df: DataFrame, keys: list[str], order: str, rows: int = BUCKET_ROWS) -> DataFrame:
    """Adds ``bucket``: ranges of ``order`` within ``keys`` cut at its sketched quantiles.

    There are enough cuts for about ``rows`` rows a bucket if one group had all rows, ``BUCKETS`` at most; values packed into a
    small part of the range are cut like others, as the cuts follow the rows and not the range. ``df`` is read three times.
    """
    cuts = min(BUCKETS, -(-df.count() // rows))
    if cuts < 2:
        return df.withColumn("bucket", F.lit(0))
    at = F.array(*[F.lit(i / cuts) for i in range(1, cuts)])
    borders = settle(df.groupBy(*keys).agg(F.array_distinct(F.percentile_approx(order, at, SKETCH_ACCURACY)).alias("borders")), "borders")
    # A value's bucket is the number of borders below it, found by halving: borders ascend.
    halves = F.array(*[F.lit(1 << i) for i in reversed(range(cuts.bit_length()))])
    place = F.aggregate(halves, F.lit(0), lambda a, h: F.when(F.get("borders", a + h - 1) < F.col(order), a + h).otherwise(a))
    return df.join(borders, keys).withColumn("bucket", place).drop("borders")


def running_sums(
    df: DataFrame, keys: list[str], order: str, sums: list[str], buckets: Column | None = None, rows: int = BUCKET_ROWS
) -> DataFrame:
    """Inclusive running sums of ``sums`` along ``order`` within ``keys``, plus the group totals.

    ``order`` must be unique within the keys (group equal values first). It is cut into buckets at its quantiles (``bucketed``); bucket
    totals give the carry into each bucket, so a window never spans a whole group. ``buckets``, a column that depends on the keys, asks
    for as many equal cuts of [0, 1] instead, for very many small groups. Output adds ``<c>_run`` and ``<c>_all`` for each summed column.
    """
    if buckets is None:
        cut = bucketed(df, keys, order, rows)
    else:
        cut = df.withColumn("bucket", F.floor(F.col(order) * buckets).cast("int"))
    group = Window.partitionBy(*keys)
    carry = group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    totals = cut.groupBy(*keys, "bucket").agg(*[F.sum(c).alias(c) for c in sums])
    carried = totals.select(
        *keys, "bucket",
        *[F.coalesce(F.sum(c).over(carry), F.lit(0)).alias(f"{c}_carry") for c in sums],
        *[F.sum(c).over(whole).alias(f"{c}_all") for c in sums],
    )
    inside = (
        Window.partitionBy(*keys, "bucket").orderBy(order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = cut.select("*", *[F.sum(c).over(inside).alias(f"{c}_in") for c in sums])
    return local.join(carried, [*keys, "bucket"]).select(
        *df.columns,
        *[(F.col(f"{c}_carry") + F.col(f"{c}_in")).alias(f"{c}_run") for c in sums],
        *[f"{c}_all" for c in sums],
    )


def bounded_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Type-7 quantiles from one sorted array per group: for groups whose size is known to be small.

    About twice as fast as ``percentile``, which keeps a hash map of distinct values.
    """
    held = df.groupBy(*keys).agg(F.sort_array(F.collect_list(value)).alias("held")).filter(F.size("held") > 0)

    def pick(p: float) -> Column:
        place = (F.size("held") - 1) * F.lit(float(p))
        low, high = (F.get("held", f(place).cast("int")) for f in (F.floor, F.ceil))
        return low + (place - F.floor(place)) * (high - low)

    return held.select(*keys, *[pick(p).alias(name) for name, p in probs.items()])


def _holding(slots: DataFrame, keys: list[str]) -> DataFrame:
    """The brackets that hold the wanted ranks, from slots that ascend with the values they count.

    ``slots`` has a row for each slot of each wanted quantile: ``count``, ``low`` and ``high`` of the values in it, and ``before``, the
    number of values below the first slot. Equal brackets of a group share a ``span``.
    """
    name = [*keys, "which", "p", "n"]
    run = Window.partitionBy(*name).orderBy("slot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = slots.withColumn("upto", F.col("before") + F.sum("count").over(run)).withColumn("from", F.col("upto") - F.col("count"))
    place = (F.col("n") - 1) * F.col("p")
    holds = [(F.col("from") <= at) & (at < F.col("upto")) for at in (F.floor(place), F.ceil(place))]
    found = ranked.filter(holds[0] | holds[1]).groupBy(*name).agg(
        F.min("from").alias("before"), F.min("low").alias("lo"), F.max("high").alias("hi"), (F.max("upto") - F.min("from")).alias("inside"))
    return settle(found.withColumn("span", F.min("which").over(Window.partitionBy(*keys, "lo", "hi"))), "brackets")


def group_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float], rows: int = RANK_ROWS) -> DataFrame:
    """Exact type-7 quantiles of groups of any size and number.

    Values are counted in slots that ascend with them: first on a logarithmic scale, then on ``SLOTS`` equal parts of the bracket, from the
    least to the greatest value of the slots that hold the wanted ranks. Counts move instead of the values, and ``df`` is read once for
    each count. When the open brackets hold at most ``rows`` values in all, or after ``PASSES`` counts, those inside are ranked
    in full, equal ones as one row. A bracket of one value is done.
    """
    v = F.col(value)
    df = df.select(*keys, value).filter(v.isNotNull())

    def counted(hits: DataFrame, by: list[str], slot: Column) -> DataFrame:
        return settle(hits.withColumn("slot", slot).groupBy(*by, "slot").agg(
            F.count("*").alias("count"), F.min(value).alias("low"), F.max(value).alias("high")), "slots")

    def inside(brackets: DataFrame) -> DataFrame:
        spans = settle(brackets.filter("which = span").select(*keys, "span", "lo", "hi"), "spans")
        # Brackets are few against the values: these stay where they are, however small Spark thinks they are.
        spans = F.broadcast(spans) if is_small(spans, SPANS) else spans.hint("merge")
        return df.join(spans, keys).filter((v >= F.col("lo")) & (v <= F.col("hi")))

    x, lo, hi = (F.col(c).cast("double") for c in (value, "lo", "hi"))
    first = counted(df, keys, F.signum(x) * F.floor(F.log(F.abs(x) * F.lit(2.0 ** 20) + 1) * 8))
    wanted = F.explode(F.array(*[F.struct(F.lit(i).alias("which"), F.lit(float(p)).alias("p")) for i, p in enumerate(probs.values())])).alias("w")
    sizes = first.groupBy(*keys).agg(F.sum("count").alias("n")).select(*keys, "n", wanted, F.lit(0).cast("bigint").alias("before"))
    brackets = _holding(sizes.select(*keys, "n", "w.*", "before").join(first, keys), keys)
    part = F.least(F.floor(F.try_divide(x - lo, hi - lo) * SLOTS), F.lit(SLOTS - 1)) + 1
    slot = F.when(v <= F.col("lo"), F.lit(0)).when(v >= F.col("hi"), F.lit(SLOTS + 1)).otherwise(part).cast("int")
    done = []
    for passed in range(PASSES + 1):
        done.append(brackets.filter("lo >= hi").select(*keys, "which", "p", "n", F.col("lo").alias("v0"), F.col("lo").alias("v1")))
        brackets = brackets.filter("lo < hi")
        if passed == PASSES or (brackets.filter("which = span").agg(F.sum("inside")).first()[0] or 0) <= rows:
            break
        slots = counted(inside(brackets), [*keys, "span"], slot)
        brackets = _holding(brackets.drop("lo", "hi", "inside").join(slots, [*keys, "span"]), keys)
    values = inside(brackets).groupBy(*keys, "span", value).agg(F.count("*").alias("w"))
    upto = Window.partitionBy(*keys, "which").orderBy(v).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    place = (F.col("n") - 1) * F.col("p")
    run = F.col("before") + F.sum("w").over(upto)
    ranked = brackets.join(values, [*keys, "span"]).withColumn("run", run).groupBy(*keys, "which", "p", "n").agg(*[
        F.min(F.when(F.col("run") > at, v)).alias(end) for end, at in (("v0", F.floor(place)), ("v1", F.ceil(place)))])
    q = F.col("v0") + (place - F.floor(place)) * (F.col("v1") - F.col("v0"))
    return reduce(DataFrame.unionByName, done, ranked).withColumn("q", q).groupBy(*keys).agg(*[
        F.max(F.when(F.col("which") == i, F.col("q"))).alias(name) for i, name in enumerate(probs)
    ])


def is_small(df: DataFrame, rows: int) -> bool:
    """Whether a table has at most ``rows`` rows; counted where the rows are."""
    return df.count() <= rows


def quantiles_from_runs(values: DataFrame, keys: list[str], value: str, weight: str, probs: list[float]) -> DataFrame:
    """Type-7 quantiles from distinct values with their counts and running counts.

    ``values`` is the output of ``running_sums`` for ``weight``. Each value row keeps only the wanted
    ranks that fall inside its own run, so nothing is multiplied by the number of quantiles.
    Returns (keys, p, quantile).
    """
    n, upto = F.col(f"{weight}_all"), F.col(f"{weight}_run")
    held = values.select(
        *keys, F.col(value).alias("v"), (n - 1).alias("last"), (upto - F.col(weight)).alias("a"), upto.alias("b")
    )

    def own(p: Column) -> Column:
        place = F.col("last") * p
        return ((F.floor(place) >= F.col("a")) & (F.floor(place) < F.col("b"))) | (
            (F.ceil(place) >= F.col("a")) & (F.ceil(place) < F.col("b")))

    wanted = F.filter(F.array(*[F.lit(p) for p in probs]), own)
    at = held.select(*keys, "v", "last", F.explode(wanted).alias("p")).groupBy(*keys, "p", "last").agg(
        F.min("v").alias("v0"), F.max("v").alias("v1")
    )
    place = F.col("last") * F.col("p")
    between = F.col("v0") + (place - F.floor(place)) * (F.col("v1") - F.col("v0"))
    return at.select(*keys, "p", between.alias("quantile"))
