"""Model table over detection, return and entry specifications.

Each part has a closed-form maximum-likelihood fit on counts (binomial or multinomial proportions);
detection by log(effort) is a logit-linear fit by Newton steps on the same counts. The three partial log-likelihoods are
added, so the table ranks specifications; it is not the full POPAN likelihood.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sightline.functions.scalar import let, one_row, xlogy

# Specification numbers of each part, in the order they enter a model name.
DETECT = {1: "~1", 2: "~log(effort)", 3: "~time"}
RETURN = {1: "~1", 2: "~time", 3: "~group"}
ENTRY = {1: "~1", 2: "~time", 3: "~group"}

NEWTON_STEPS = 25
CELL = ("spec", "t", "grp", "k", "n", "p", "loglik")


def model_grid(spark: SparkSession) -> DataFrame:
    """The 27 model names."""
    one = spark.range(1)
    for part, specs in (("p", DETECT), ("phi", RETURN), ("pent", ENTRY)):
        one = one.withColumn(part, F.explode(F.array(*[F.lit(s) for s in specs])))
    return one.select("p", "phi", "pent", F.concat(F.lit("Mod"), "p", "phi", "pent").alias("model"))


def _binomial(cells: DataFrame, spec: int, keys: list[str]) -> DataFrame:
    """Pooled proportion k / n per key with its log-likelihood."""
    pooled = cells.groupBy(*keys).agg(F.sum("k").alias("k"), F.sum("n").alias("n"))
    return _cells(pooled.filter("n > 0"), spec, F.col("k") / F.col("n").cast("double"), binomial=True)


def _cells(df: DataFrame, spec: int, p: Column, binomial: bool) -> DataFrame:
    for c in ("t", "grp"):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("int"))
    k, rest = F.col("k").cast("double"), (F.col("n") - F.col("k")).cast("double")
    loglik = xlogy(k, F.col("p"))
    if binomial:
        loglik = loglik + xlogy(rest, F.lit(1.0) - F.col("p"))
    return df.withColumns({"spec": F.lit(spec), "p": p}).withColumn("loglik", loglik).select(*CELL)


def detect_cells(counts: DataFrame) -> DataFrame:
    """Seen k of n known alive, at occasions where some individual is known alive around them."""
    return counts.select("t", F.col("s").alias("k"), (F.col("s") + F.col("z")).alias("n")).filter("n > 0")


def detect_models(counts: DataFrame) -> DataFrame:
    """Detection ~1 and ~time."""
    cells = detect_cells(counts)
    return _binomial(cells, 1, []).unionByName(_binomial(cells, 3, ["t"]))


def return_models(group_counts: DataFrame) -> DataFrame:
    """Seen-again rate of the captures before the last occasion: ~1, ~time, ~group."""
    last = one_row(group_counts, t=F.max("t"))
    cells = group_counts.filter(F.col("t") < last["t"]).select("t", "grp", F.col("r").alias("k"), "n")
    return (
        _binomial(cells, 1, [])
        .unionByName(_binomial(cells, 2, ["t"]))
        .unionByName(_binomial(cells, 3, ["grp"]))
    )


def entry_models(group_counts: DataFrame) -> DataFrame:
    """Distribution of first captures: ~1 (first occasion, then one common rate), ~time, ~group."""
    spans = one_row(group_counts, first=F.min("t"), k=F.count_distinct("t"))
    start = F.col("t") == spans["first"]
    base = group_counts.select(
        F.when(start, F.col("t")).alias("t0"), "t", "grp", F.col("u").alias("k"), spans["k"].alias("occ")
    )

    def constant(spec: int, keys: list[str]) -> DataFrame:
        size = base.groupBy(*keys).agg(F.sum("k").alias("n"))
        cell = base.groupBy(*keys, "t0", "occ").agg(F.sum("k").alias("k"))
        joined = cell.join(size, keys) if keys else cell.withColumn("n", size.scalar())
        share = F.col("k").cast("double") / F.col("n")
        p = F.when(F.col("t0").isNull(), share / (F.col("occ") - 1)).otherwise(share)
        return _cells(joined.withColumn("p", p).withColumnRenamed("t0", "t"), spec, F.col("p"), binomial=False)

    total = one_row(base, n=F.sum("k"))
    by_time = base.groupBy("t").agg(F.sum("k").alias("k")).withColumn("n", total["n"])
    timed = _cells(by_time, 2, F.col("k").cast("double") / F.col("n"), binomial=False)
    return constant(1, []).unionByName(timed).unionByName(constant(3, ["grp"]))


def part_fit(cells: DataFrame, part: str) -> DataFrame:
    """Number of parameters and log-likelihood of each specification of one part."""
    if part == "pent":
        free = F.when(F.col("spec") == 2, F.count("*") - 1).when(F.col("spec") == 1, F.lit(1)).otherwise(
            F.count_distinct("grp")
        )
    else:
        free = F.count("*")
    return cells.groupBy("spec").agg(free.cast("bigint").alias("npar"), F.sum("loglik").alias("loglik")).select(
        F.lit(part).alias("part"), "spec", "npar", "loglik"
    )


def binomial_newton(cells: DataFrame, keys: list[str], steps: int = NEWTON_STEPS) -> DataFrame:
    """Logit-linear fits k of n ~ intercept + slope x, one for each key, all in one pass.

    ``cells`` holds the keys and x, k, n; a key has as many cells as there are occasions (times groups), which meet as one short array.
    A fixed number of Newton steps from the pooled rate runs as a fold over that array. Returns the keys, npar, loglik,
    intercept and slope; a covariate without variation has slope 0 and one parameter. Fits that run off to infinity are NULL.
    """
    x, k, n = F.col("x").cast("double"), F.col("k").cast("double"), F.col("n").cast("double")
    held = cells.filter("n > 0").groupBy(*keys).agg(
        F.sum(k).alias("k"), F.sum(n).alias("n"), (F.sum(n * x) / F.sum(n)).alias("mean"), (F.min(x) < F.max(x)).alias("varies"),
        F.collect_list(F.struct(x.alias("x"), k.alias("k"), n.alias("n"))).alias("cells"))

    def total(term) -> Column:
        return F.aggregate("cells", F.lit(0.0), lambda a, cell: a + term(cell))

    def step(at: Column, _: Column) -> Column:
        def rate(cell: Column) -> Column:
            return 1 / (1 + F.exp(-(at["a"] + at["b"] * (cell["x"] - F.col("mean")))))

        def part(term) -> Column:
            return total(lambda cell: term(cell, cell["x"] - F.col("mean"), rate(cell)))

        sums = F.struct(part(lambda c, d, p: c["k"] - c["n"] * p).alias("ga"), part(lambda c, d, p: (c["k"] - c["n"] * p) * d).alias("gb"),
                        part(lambda c, d, p: c["n"] * p * (1 - p)).alias("aa"), part(lambda c, d, p: c["n"] * p * (1 - p) * d).alias("ab"),
                        part(lambda c, d, p: c["n"] * p * (1 - p) * d * d).alias("bb"))

        def moved(s: Column) -> Column:
            det = s["aa"] * s["bb"] - s["ab"] * s["ab"]
            da = F.when(F.col("varies"), F.try_divide(s["bb"] * s["ga"] - s["ab"] * s["gb"], det)).otherwise(F.try_divide(s["ga"], s["aa"]))
            db = F.when(F.col("varies"), F.try_divide(s["aa"] * s["gb"] - s["ab"] * s["ga"], det)).otherwise(0.0)
            return F.struct((at["a"] + da).alias("a"), (at["b"] + db).alias("b"))

        return let(sums, moved)

    start = F.struct(F.log(F.try_divide(F.col("k"), F.col("n") - F.col("k"))).alias("a"), F.lit(0.0).alias("b"))
    fit = held.withColumn("fit", F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step))
    logit = lambda cell: F.col("fit.a") + F.col("fit.b") * (cell["x"] - F.col("mean"))
    loglik = total(lambda cell: cell["k"] * logit(cell) - cell["n"] * F.log1p(F.exp(logit(cell))))
    return fit.select(*keys, F.when(F.col("varies"), 2).otherwise(1).cast("bigint").alias("npar"), loglik.alias("loglik"),
                      (F.col("fit.a") - F.col("fit.b") * F.col("mean")).alias("intercept"), F.col("fit.b").alias("slope"))


def detect_effort_fit(counts: DataFrame, effort: DataFrame) -> DataFrame:
    """Detection ~log(effort) on the occasion counts. One row."""
    cells = detect_cells(counts).join(effort, "t").select(
        F.lit("p").alias("part"), F.lit(2).alias("spec"), F.log(F.col("effort").cast("double")).alias("x"), "k", "n")
    return binomial_newton(cells, ["part", "spec"])


def model_compare(spark: SparkSession, parts: DataFrame, n_captures: Column, c_hat: Column) -> DataFrame:
    """AICc and QAICc of every model whose three parts are fitted, with delta, weight and rank."""
    models = model_grid(spark)
    for part in ("p", "phi", "pent"):
        fitted = parts.filter(F.col("part") == part).select(
            F.col("spec").alias(part), F.col("npar").alias(f"{part}_k"), F.col("loglik").alias(f"{part}_ll")
        )
        models = models.join(fitted, part)
    k = F.col("p_k") + F.col("phi_k") + F.col("pent_k")
    deviance = F.lit(-2.0) * (F.col("p_ll") + F.col("phi_ll") + F.col("pent_ll"))
    n = n_captures.cast("double")

    def corrected(fit: Column, par: Column) -> Column:
        return fit + 2 * par + F.try_divide((2 * par * (par + 1)).cast("double"), n - par - 1)

    scored = models.select("model", k.alias("npar"), deviance.alias("deviance")).withColumns({
        "aicc": corrected(F.col("deviance"), F.col("npar")),
        "qaicc": corrected(F.try_divide(F.col("deviance"), c_hat), F.col("npar") + 1),
    })
    whole = Window.partitionBy(F.lit(0))
    delta = F.col("qaicc") - F.min("qaicc").over(whole)
    weighed = scored.withColumn("delta", delta).withColumn("weight", F.exp(F.col("delta") * -0.5))
    return weighed.withColumns({
        "weight": F.col("weight") / F.sum("weight").over(whole),
        "model_rank": F.row_number().over(whole.orderBy("qaicc", "model")),
    })
