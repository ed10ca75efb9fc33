"""Sharding where every one of very many ranges has several cells."""

from pyspark.sql import functions as F

from sightline.llm import sharding


def test_cells_of_thousands_of_ranges(spark):
    ranged = spark.range(6000).select(F.col("id").alias("key"), (F.col("id") % 3000).cast("int").alias("range"))
    out = sharding._celled(ranged, [1 + i % 5 for i in range(3000)])
    assert out.count() == 6000 and out.filter(F.col("cell") > F.col("range") % 5).count() == 0
    assert sharding._celled(ranged, [1] * 3000).filter("cell <> 0").count() == 0


def test_shards_with_small_cells(documents, monkeypatch):
    monkeypatch.setattr(sharding, "CELL_ROWS", 2)
    monkeypatch.setattr(sharding, "LEAST_CELL_ROWS", 2)
    rows = [(i, f"text {i} " * (i % 7)) for i in range(3000)] + [(9000 + i, "the same") for i in range(1000)]
    got = sharding.assign(documents(rows)).collect()
    assert len(got) == 4000
    for shard in range(sharding.SHARDS):
        slots = sorted(r.slot for r in got if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    sizes = [sum(r["size"] for r in got if r["shard"] == s) for s in range(sharding.SHARDS)]
    assert max(sizes) - min(sizes) < 0.1 * max(sizes)
