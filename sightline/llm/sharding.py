"""Sharding by sampled splitters (operator 6).

Rows are ordered by a hash of their text, so equal texts lie side by side. A size-weighted sample of keys, drawn by a
hash of the row and so the same on every run, gives quantile boundaries; a key that fills a range by itself in the sample
is fenced off. Bytes per range are then counted over all rows, and ranges that turn out overfull are subdivided by a
sample of their own. The ranges, at most a few thousand whatever the input, go to the shards largest first, each to the
lightest shard. Equal texts stay in one shard unless together they exceed a shard's fair share; only then their
range is cut by a hash of the row key.

Law: ``bytes``. Defined cases: the size of a row is the UTF-8 length of its text plus one, a null text has none; a null
key is a key like any other; repeated rows are placed one by one; an empty table gives no rows; other columns are ignored by
``assign`` and kept by ``write_shards``. The only things sent to the driver are the sample (``SAMPLE`` rows on average, a
documented bound) and the counts of ranges.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sightline.llm.common import settle, table

SHARDS = 8
RANGES_PER_SHARD = 256
SAMPLE = 30_000
ROUNDS = 3
CELL_ROWS, LEAST_CELL_ROWS = 500_000, 200


@dataclass
class ShardPlan:
    """Boundaries of the key ranges, and for each (range, cell) its shard and first slot."""

    bounds: list[float]
    cells: list[int]
    items: list[tuple[int, int, int, int]]


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    body = F.coalesce(docs[text], F.lit(""))
    return docs.select(
        docs[key].alias("key"), (F.octet_length(body) + 1).cast("bigint").alias("size"),
        F.crc32(F.encode(body, "utf-8")).alias("crc"), F.xxhash64(body).alias("h"),
    )


def _ranged(rows: DataFrame, bounds: list[float]) -> DataFrame:
    if not bounds:
        return rows.withColumn("range", F.lit(0))
    at = rows.withColumn("place", F.col("h").cast("double"))
    cut = Bucketizer(splits=[-math.inf, *bounds, math.inf], inputCol="place", outputCol="bucket").transform(at)
    return cut.select(*rows.columns, F.col("bucket").cast("int").alias("range"))


def _sample(rows: DataFrame, total: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys drawn with probability in proportion to size, and the weight that each stands for."""
    draw = F.pmod(F.xxhash64("key", "h", F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    share = F.col("size") * (SAMPLE / total)
    got = rows.filter(draw < share).select(F.col("h").cast("double"), F.greatest(share, F.lit(1.0))).collect()
    return np.array([r[0] for r in got]), np.array([r[1] for r in got])


def _splitters(keys: np.ndarray, weights: np.ndarray, ranges: int) -> list[float]:
    """Quantile boundaries of a weighted sample, with heavy single keys fenced off."""
    if not len(keys):
        return []
    distinct, back = np.unique(keys, return_inverse=True)
    weight = np.bincount(back, weights)
    upto = np.cumsum(weight)
    step = upto[-1] / ranges
    cuts = distinct[np.unique(np.searchsorted(upto, step * np.arange(1, ranges)).clip(max=len(distinct) - 1))]
    heavy = distinct[weight >= step]
    return sorted({*cuts.tolist(), *heavy.tolist(), *np.nextafter(heavy, np.inf).tolist()})


def plan_shards(rows: DataFrame, shards: int = SHARDS) -> ShardPlan:
    total = rows.agg(F.sum("size")).first()[0]
    if not total:
        return ShardPlan([], [1], [])
    target = total / (shards * RANGES_PER_SHARD)
    bounds = _splitters(*_sample(rows, total, 0), shards * RANGES_PER_SHARD)
    for attempt in range(1, ROUNDS + 1):
        counted = _ranged(rows, bounds).groupBy("range").agg(
            F.sum("size").alias("size"), F.count("*").alias("n"), F.min("h").alias("lo"), F.max("h").alias("hi")).collect()
        full = [r for r in counted if r["size"] > 2 * target and float(r["lo"]) != float(r["hi"])]
        if not full or attempt == ROUNDS:
            break
        inside = _ranged(rows, bounds).filter(F.col("range").isin([r["range"] for r in full]))
        weight = sum(r["size"] for r in full)
        more = _splitters(*_sample(inside, weight, attempt), math.ceil(2 * weight / target))
        bounds = sorted({*bounds, *more})
    fair = total / shards
    cells = [1] * (len(bounds) + 1)
    cell_rows = min(CELL_ROWS, max(LEAST_CELL_ROWS, 4 * sum(r["n"] for r in counted) // len(counted)))
    for r in counted:
        cells[r["range"]] = max(math.ceil(r["n"] / cell_rows), math.ceil(4 * r["size"] / fair) if r["size"] > fair else 1)
    split = _celled(_ranged(rows, bounds), cells).groupBy("range", "cell").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
    whole: dict[tuple[int, int], list] = {}
    large = {r["range"] for r in counted if r["size"] > fair}
    for r in split:
        whole.setdefault((r["range"], r["cell"] if r["range"] in large else -1), []).append(r)
    loads = [(0, s) for s in range(shards)]
    slots, items = [0] * shards, []
    for parts in sorted(whole.values(), key=lambda p: (-sum(r["size"] for r in p), p[0]["range"], p[0]["cell"])):
        load, shard = heapq.heappop(loads)
        heapq.heappush(loads, (load + sum(r["size"] for r in parts), shard))
        for r in sorted(parts, key=lambda r: r["cell"]):
            items.append((r["range"], r["cell"], shard, slots[shard]))
            slots[shard] += r["n"]
    return ShardPlan(bounds, cells, items)


def _celled(ranged: DataFrame, cells: list[int]) -> DataFrame:
    if max(cells) == 1:
        return ranged.withColumn("cell", F.lit(0))
    count = F.get(F.lit(cells), F.col("range"))  # one array literal, however many ranges have several cells
    return ranged.withColumn("cell", F.pmod(F.xxhash64("key", F.lit(11)), count).cast("int"))


def _placed(rows: DataFrame, plan: ShardPlan) -> DataFrame:
    items = rows.sparkSession.createDataFrame(plan.items, "range int, cell int, shard int, base bigint")
    # One row per range and cell: bounded by the number of ranges and by rows / CELL_ROWS.
    return _celled(_ranged(rows, plan.bounds), plan.cells).join(F.broadcast(items), ["range", "cell"])


def assign(docs: DataFrame, shards: int = SHARDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, size, text_crc32, law, shard, slot) of every row; slots run from 0 in every shard without gaps."""
    rows = settle(_keyed(docs, key, text), "shard-rows")
    inside = Window.partitionBy("range", "cell").orderBy("h", "key", "crc")
    return _placed(rows, plan_shards(rows, shards)).select(
        F.col("key").alias(key), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard",
        (F.col("base") + F.row_number().over(inside) - 1).alias("slot"),
    )


def write_shards(docs: DataFrame, folder: str, shards: int = SHARDS, key: str = "doc_id", text: str = "text") -> None:
    """Write all columns of the rows to one folder per shard."""
    body = F.coalesce(docs[text], F.lit(""))
    rows = docs.select(F.struct(*docs.columns).alias("row"), docs[key].alias("key"), F.xxhash64(body).alias("h"))
    plan = plan_shards(settle(_keyed(docs, key, text), "shard-rows"), shards)
    name = "shard_" if "shard" in docs.columns else "shard"
    _placed(rows, plan).select("row.*", F.col("shard").alias(name)).write.partitionBy(name).parquet(folder)


def op6_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(table(spark, sf_dir, "documents")).withColumns({"grown_shard": F.lit(None).cast("int")})


QUERIES = {"op6_sampled_splitters": op6_sampled_splitters}
ORACLES: dict[str, str] = {}
