"""N-gram Jaccard join over size-banded tiles with hashed bitmap signatures (operator 3).

Sets of word shingles are banded by size so that two linked sets lie in one band or in neighbouring ones. Within a band
the hash space is cut into more cells than two linked sets can differ in, so they agree wholly on some cell they both
fill: equal cell contents form the tiles in which sets meet. Nothing depends on how frequent a shingle is, so a shared
passage brings few candidates; and linked sets agree on more than one cell, namely on all that their differences cannot
touch, so a set that shares fewer cells than that with all others together leaves its tiles. Tiles are first joined as stars around their smallest, largest and most central sets; a tile whose sets are then in one
component needs no further look. The others are cut by size into blocks of ``TILE`` sets, and block pairs of
compatible sizes are compared. Bit counts of hashed bitmaps bound the overlap from above for every pair, and pairs that
pass are verified by intersecting the sorted shingle arrays. The result is exact: no cap, no sampled candidates.

Sets with equal contents are one node from the start. Set ids and shingles are 64-bit hashes.

Defined cases: a null or wordless text has an empty set, is its own component and is linked with nothing; a text of fewer
than five words is one shingle of all its words; a null doc_id takes part, but never is a component id unless all of its
component are null; repeated rows each give a row; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sightline.llm.common import drop_kept, give_back, mix, settle, shingles_of, table, text_chunks, tidy, word_hashes
from sightline.llm.spread import join_spread

NEAR, OF = 80, 100
TILE = 1024
CENTRAL_ROUNDS = 4
STRONG_ROUNDS = 2
GROUP_BYTES = 8 << 20  # of bitmaps compared in one call
CELL_ENTRIES = 1_000_000
FILTER_BITS = 1 << 24
NAME_BYTES = 5  # of a signature, besides its cell; chance equality only costs a comparison
CHUNK = 2 << 20
SETS = "set bigint, n bigint"


def _edges() -> np.ndarray:
    edges = [1]
    while edges[-1] < 1 << 40:
        edges.append(max(edges[-1] + 1, -(-edges[-1] * OF // NEAR)))
    return np.array(edges, dtype=np.int64)


EDGES = _edges()


def cells_of_band(band: np.ndarray) -> np.ndarray:
    """Number of hash cells of a band: about four shingles a cell, two in small sets."""
    top = EDGES[band + 1]
    return np.where(top <= 64, top // 2, top // 4) + 2


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    drop_kept()
    yield from text_chunks(batches, "text", CHUNK)


def text_sets(column: pa.Array) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every text."""
    hashes, first = shingles_of(*word_hashes(column))
    return [np.unique(hashes[a:b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist())]


def set_ids(sets: list[np.ndarray]) -> np.ndarray:
    """A 64-bit id of each set's contents."""
    sizes = np.array([len(s) for s in sets], dtype=np.uint64)
    out = np.zeros(len(sets), dtype=np.uint64)
    full = np.flatnonzero(sizes)
    if len(full):
        flat = mix(np.concatenate([sets[i] for i in full]) + np.uint64(0xA24BAED4963EE407))
        starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]]).astype(np.int64)
        out[full] = mix(np.add.reduceat(flat, starts) + sizes[full] * np.uint64(0x9FB21C651E98DF25))
    return out.view(np.int64)


def _in_cells(sets: list[np.ndarray], up: int) -> tuple[np.ndarray, ...]:
    """Sets dealt to the cells of their own band (``up`` 0) or of the next (1).

    (band, first cell of every set with a closing end, cell of every shingle, hash of every shingle, whether a cell is filled,
    number of filled cells of every set, number of shingles in which a set there and one linked with it differ at most).
    """
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    hashed = mix(np.concatenate(sets) ^ np.uint64(0x8CB92BA72F3D8DD7))
    band = np.searchsorted(EDGES, sizes, side="right") - 1 + up
    cells = cells_of_band(band)
    base = np.concatenate([[0], np.cumsum(cells)])
    slot = ((hashed >> np.uint64(32)) * cells[owner].astype(np.uint64)) >> np.uint64(32)
    key = base[owner] + slot.astype(np.int64)
    filled = np.bincount(key, minlength=base[-1]) > 0
    most = np.minimum(EDGES[band + 1] - 1, sizes * OF // NEAR)
    differ = (sizes + np.where(most < EDGES[band], np.maximum(most, sizes), most)) // 9
    return band, base, key, hashed, filled, np.add.reduceat(filled.astype(np.int64), base[:-1]), differ


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(signature, place of its set) of every filled cell, in the set's own band and as smaller partner of the next.

    Where too many cells of a set are empty for the guarantee, its empty cells have signatures too.
    """
    out_s, out_o = [], []
    for up in (0, 1):
        band, base, key, hashed, filled, count, differ = _in_cells(sets, up)
        total = np.zeros(base[-1], dtype=np.uint64)
        np.add.at(total, key, hashed)
        of = np.repeat(np.arange(len(sets)), np.diff(base))
        number = (np.arange(base[-1]) - base[of]).astype(np.uint64)
        kept = np.flatnonzero(filled | (count <= differ)[of])
        label = mix(band[of[kept]].astype(np.uint64) << np.uint64(40) | number[kept])
        out_s.append(mix(total[kept] + label))
        out_o.append(of[kept])
    return np.concatenate(out_s), np.concatenate(out_o)


def least_shared(sets: list[np.ndarray]) -> np.ndarray:
    """How many signatures a set shares at least with any set that it is linked with.

    Every differing shingle spoils one of its filled cells at most. Where empty cells have signatures too, the other set may
    have none for them, so only one is sure.
    """
    least = np.zeros(len(sets), dtype=np.int64)
    full = [i for i, s in enumerate(sets) if len(s)]
    if full:
        held = [sets[i] for i in full]
        own, above = (np.maximum(count - differ, 1) for *_, count, differ in (_in_cells(held, 0), _in_cells(held, 1)))
        least[full] = np.minimum(own, above)
    return least


def bitmap(held: np.ndarray) -> bytes:
    """A hashed bitmap of a set, with 8 to 16 bits for each shingle."""
    width = max(256, 1 << (8 * len(held) - 1).bit_length())
    bits = np.zeros(width, dtype=np.uint8)
    bits[(mix(held) & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def folded(maps: list[bytes]) -> np.ndarray:
    """Bitmaps of one width: wider ones are folded to the narrowest."""
    words = min(map(len, maps)) // 8
    out = np.empty((len(maps), words), dtype=np.uint64)
    for i, m in enumerate(maps):
        out[i] = np.bitwise_or.reduce(np.frombuffer(m, np.uint64).reshape(-1, words), axis=0)
    return out


def linked(overlap: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return OF * overlap >= NEAR * (a + b - overlap)


def _text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def document_sets(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, rid, th, set, n, need) of every row; ``rid`` and ``th`` are hashes of the key and of the text."""
    plain = docs.select(
        docs[key].alias("key"), F.xxhash64(docs[key]).alias("rid"), _text_hash(docs[text]).alias("th"), docs[text].alias("text"))
    kind = plain.schema["key"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _chunks(batches):
            sets = text_sets(batch.column(3))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(set_ids(sets)), pa.array([len(s) for s in sets], pa.int64()), pa.array(least_shared(sets))],
                names=["key", "rid", "th", "set", "n", "need"])

    return plain.mapInArrow(tidy(work), f"key {kind}, rid bigint, th bigint, {SETS}, need bigint")


def _tiles(docs: DataFrame, text: str, cells: int) -> DataFrame:
    """(tile, set, shared): sets that agree on ``shared`` hash cells; no tiles of one set.

    Equal member lists have one tile id.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _chunks(batches):
            sets = [s for s in text_sets(batch.column(0)) if len(s)]
            if not sets:
                continue
            ids, one = np.unique(set_ids(sets), return_index=True)
            found, of = signatures([sets[i] for i in one])
            cell = ((found >> np.uint64(40)) % np.uint64(cells)).astype(np.int64)
            order = np.argsort(cell, kind="stable")
            bounds = np.searchsorted(cell[order], np.arange(cells + 1))
            held = np.flatnonzero(np.diff(bounds))
            names, members, parts = [], [], []
            for c in held.tolist():
                own = order[bounds[c]:bounds[c + 1]]
                local, back = np.unique(of[own], return_inverse=True)
                names.append(found[own].view(np.uint8).reshape(-1, 8)[:, :NAME_BYTES].tobytes())
                members.append(ids[local].tobytes())
                parts.append(back.astype(np.uint32 if len(local) > 65535 else np.uint16).tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(held, pa.int64()), pa.array(names, pa.binary()), pa.array(members, pa.binary()), pa.array(parts, pa.binary())],
                names=["cell", "found", "members", "parts"])

    def meet(group: pa.Table) -> pa.Table:
        found, owner = [], []
        for f, m, p in zip(*(group.column(c).to_pylist() for c in ("found", "members", "parts"))):
            m, n = np.frombuffer(m, np.int64), len(f) // NAME_BYTES
            wide = np.zeros((n, 8), np.uint8)
            wide[:, :NAME_BYTES] = np.frombuffer(f, np.uint8).reshape(n, NAME_BYTES)
            found.append(wide.view(np.uint64)[:, 0])
            owner.append(m[np.frombuffer(p, np.uint16 if len(p) == 2 * n else np.uint32)])
        found, owner = np.concatenate(found), np.concatenate(owner)
        order = np.argsort(found, kind="stable")
        found, owner = found[order], owner[order]
        same = np.flatnonzero(found[1:] == found[:-1])
        shared = np.unique(np.concatenate([same, same + 1]))
        found, owner = found[shared], owner[shared]
        order = np.lexsort((owner, found))
        found, owner = found[order], owner[order]
        new = np.ones(len(found), dtype=bool)
        new[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
        found, owner = found[new], owner[new]
        head = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]])) if len(found) else np.zeros(0, np.int64)
        size = np.diff(np.append(head, len(found)))
        tile = np.zeros(len(found), np.uint64)
        if len(head):
            tile = np.repeat(mix(np.add.reduceat(mix(owner.view(np.uint64)), head) + size.astype(np.uint64)), size)
        many = np.repeat(size > 1, size)
        tile, owner = tile[many], owner[many]
        order = np.lexsort((owner, tile))
        tile, owner = tile[order], owner[order]
        new = np.ones(len(tile), dtype=bool)
        new[1:] = (tile[1:] != tile[:-1]) | (owner[1:] != owner[:-1])
        shared = np.diff(np.append(np.flatnonzero(new), len(new)))
        out = pa.table({"tile": tile[new].view(np.int64), "set": owner[new], "shared": shared})
        del found, owner, tile, order, new, shared
        give_back()
        return out

    return docs.select(docs[text].alias("text")).mapInArrow(
        tidy(emit), "cell bigint, found binary, members binary, parts binary").groupBy("cell").applyInArrow(
        meet, "tile bigint, set bigint, shared bigint").groupBy("tile", "set").agg(F.sum("shared").alias("shared"))


def _strong(tiles: DataFrame, needs: DataFrame) -> DataFrame:
    """The rows of (tile, set, shared, ...) whose sets share enough cells in all to be linked with any other there.

    Linked sets are together in the tiles of all cells that they share, so both stay, whatever else leaves.
    """
    enough = tiles.groupBy("set").agg(F.sum("shared").alias("all")).join(needs, "set").filter("all >= need").select("set")
    return settle(tiles.join(enough, "set", "left_semi"), "strong")


def _with_hubs(tiles: DataFrame, needs: DataFrame) -> DataFrame:
    """(tile, set, shared, hub): strong sets with the smallest of their tile; no tiles of one set."""
    for _ in range(STRONG_ROUNDS):
        left = _strong(tiles.select("tile", "set", "shared"), needs)
        heads = left.groupBy("tile").agg(F.min("set").alias("hub"), F.max("set").alias("last")).filter("hub < last")
        tiles = settle(join_spread(left, heads.select("tile", "hub"), ["tile"]), "tiles")
    return tiles


def _marks(wanted: DataFrame, on: list[str]) -> bytes:
    """A bitmap of ``FILTER_BITS`` bits, whatever the input, of the hashes of the wanted rows."""
    place = F.pmod(F.xxhash64(*on), F.lit(FILTER_BITS)) + 1
    rows = wanted.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("b")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("m")).collect()
    bits = bytearray(FILTER_BITS // 8)
    for row in rows:
        at = (row["b"] - 1) * 4096
        bits[at:at + 4096] = row["m"]
    return bytes(bits)


def _sifted(df: DataFrame, wanted: DataFrame, on: list[str]) -> DataFrame:
    """Left semi join; a bitmap of the wanted rows lets most others go before the shuffle."""
    shared = df.sparkSession.sparkContext.broadcast(_marks(wanted, on))
    place = F.pmod(F.xxhash64(*on), F.lit(FILTER_BITS))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            p = batch.column(batch.num_columns - 1).to_numpy()
            hit = (marked[p // 8] >> (p % 8).astype(np.uint8)) & 1
            yield batch.filter(pa.array(hit.astype(bool))).select(range(batch.num_columns - 1))

    return df.withColumn("place_", place).mapInArrow(tidy(work), df.schema).join(wanted.select(*on).distinct(), on, "left_semi")


def _contents(docs: DataFrame, key: str, text: str, wanted: DataFrame, bits: bool) -> DataFrame:
    """(set, n, data) of the documents with a wanted ``rid``, and of a few more: bitmaps, or sorted shingles.

    A set may come more than once.
    """
    shared = docs.sparkSession.sparkContext.broadcast(_marks(wanted, ["rid"]))
    rows = docs.select(F.xxhash64(docs[key]).alias("rid"), docs[text].alias("text")).select(
        F.pmod(F.xxhash64("rid"), F.lit(FILTER_BITS)).alias("p"), "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = np.frombuffer(shared.value, np.uint8)
        for batch in _chunks(batches):
            p = batch.column(0).to_numpy()
            hit = (marked[p // 8] >> (p % 8).astype(np.uint8)) & 1
            sets = [s for s in text_sets(batch.column(1).filter(pa.array(hit.astype(bool)))) if len(s)] if hit.any() else []
            if sets:
                yield pa.RecordBatch.from_arrays([
                    pa.array(set_ids(sets)), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([bitmap(s) if bits else _packed(s) for s in sets], pa.binary()),
                ], names=["set", "n", "data"])

    return rows.mapInArrow(tidy(work), f"{SETS}, data binary")


def _packed(held: np.ndarray) -> bytes:
    """The low 48 bits of every shingle: enough to tell the shingles of two texts apart, at three quarters of the size."""
    return held.view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return wide.view(np.uint64)[:, 0]


def _bounded(pairs: DataFrame, marks: DataFrame) -> DataFrame:
    """The (a, b) whose bitmaps allow a link: bit counts bound the overlap from above."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for i, (na, nb, x, y) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(2, 6)))):
                if OF * min(na, nb) < NEAR * max(na, nb):
                    continue
                x, y = folded([x, y])
                bound = min(na - int(np.bitwise_count(x & ~y).sum()), nb - int(np.bitwise_count(y & ~x).sum()))
                if OF * bound >= NEAR * (na + nb - bound):
                    good.append(i)
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).take(pa.array(good, pa.int64()))

    def side(c: str) -> DataFrame:
        return marks.select(F.col("set").alias(c), F.col("n").alias(f"n_{c}"), F.col("data").alias(f"bits_{c}"))

    return pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select(
        "a", "b", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(tidy(work), "a bigint, b bigint")


def _verified(pairs: DataFrame, contents: DataFrame) -> DataFrame:
    """The linked ones of (a, b), by intersection of their sorted shingle arrays."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for i, (x, y) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                x, y = _unpacked(x), _unpacked(y)
                if linked(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y)):
                    good.append(i)
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).take(pa.array(good, pa.int64()))

    def side(c: str) -> DataFrame:
        return contents.select(F.col("set").alias(c), F.col("data").alias(f"all_{c}"))

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "all_a", "all_b").mapInArrow(tidy(work), "a bigint, b bigint")


def components(links: DataFrame) -> DataFrame:
    """(node, label) with the smallest node reachable by (a, b) links as label; a few rounds of minimum and jump."""
    both = links.select("a", "b").union(links.select("b", "a")).distinct()
    edges = settle(both, "edges")
    labels = settle(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = edges.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(
            F.min("label").alias("seen"))
        low = labels.join(near, "node").select("node", "label", F.least("label", "seen").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("label").alias("over"))
        after = settle(low.join(jump, "low", "left").select(
            "node", F.least("low", "over").alias("label"), (F.least("low", "over") < F.col("label")).alias("moved")), "labels")
        labels = after.select("node", "label")
        if after.filter("moved").isEmpty():
            return labels


def _crossing(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """The (set, hub, other) between different components; ``other`` is the hub's component."""
    def named(c: str, out: str) -> DataFrame:
        return labels.select(F.col("node").alias(c), F.col("label").alias(out))

    both = edges.join(named("set", "own"), "set", "left").join(named("hub", "other"), "hub", "left")
    return both.select("set", "hub", F.coalesce("own", "set").alias("own"), F.coalesce("other", "hub").alias("other")).filter(
        "own != other").select("set", "hub", "other")


def _named(tiles: DataFrame, labels: DataFrame) -> DataFrame:
    """(tile, set, shared, label) of the tiles whose sets are in more than one component."""
    named = tiles.select("tile", "set", "shared").join(labels.select(F.col("node").alias("set"), "label"), "set", "left").withColumn(
        "label", F.coalesce("label", "set"))
    mixed = named.groupBy("tile").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("tile")
    return named.join(mixed, "tile", "left_semi")


def _central(tiles: DataFrame, degrees: DataFrame) -> DataFrame:
    """For every set the most central set, by ``degree``, of another component in one of its tiles.

    The common original of many edited copies agrees with most of them in every cell, so it is the most central.
    """
    held = tiles.join(degrees, "set")
    parts = held.groupBy("tile", "label").agg(F.max(F.struct("degree", "set")).alias("top"))
    first = parts.groupBy("tile").agg(F.max(F.struct("top", "label")).alias("first"))
    others = parts.join(first, "tile").filter(F.col("label") != F.col("first.label")).groupBy("tile").agg(F.max("top").alias("second"))
    ends = first.join(others, "tile")
    partner = F.when(F.col("label") == F.col("first.label"), F.col("second")).otherwise(F.col("first.top"))
    return tiles.join(ends, "tile").groupBy(F.col("set").alias("a")).agg(F.max(partner).alias("partner")).select(
        "a", F.col("partner.set").alias("b"))


def _block_pairs(tiles: DataFrame, held: DataFrame) -> DataFrame:
    """(a, b) of different components of a tile that pass the bitmap bound, from size-ordered blocks of ``TILE`` sets.

    A set is sent to its own block's pairs with each later block of compatible size, never to a whole tile.
    """
    held = held.dropDuplicates(["set"]).withColumnRenamed("data", "bits")
    sized = tiles.join(held.select("set", "n"), "set")
    placed = sized.withColumn("block", F.floor(
        (F.row_number().over(Window.partitionBy("tile").orderBy("n", "set")) - 1) / TILE).cast("int"))
    ranges = placed.groupBy("tile", "block").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    left = ranges.select("tile", F.col("block").alias("i"), F.col("hi").alias("hi_i"))
    right = ranges.select("tile", F.col("block").alias("j"), F.col("lo").alias("lo_j"))
    met = left.join(right, "tile").filter((F.col("i") <= F.col("j")) & (F.col("hi_i") * OF >= F.col("lo_j") * NEAR))
    sides = met.select("tile", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    sent = settle(placed.select("tile", "block", "set", "label", "n").join(sides, ["tile", "block"]), "sent")
    groups = max(1, math.ceil(2 * (sent.agg(F.sum("n")).first()[0] or 0) / GROUP_BYTES))  # a bitmap has 1 to 2 bytes a shingle
    rows = sent.join(held.select("set", "bits"), "set").withColumn("group", F.pmod(F.xxhash64("tile", "i", "j"), F.lit(groups)))

    def meet(group: pa.Table) -> pa.Table:
        group = group.combine_chunks().sort_by([("tile", "ascending"), ("i", "ascending"), ("j", "ascending")])
        tile, i, j = (group.column(c).to_numpy() for c in ("tile", "i", "j"))
        new = np.flatnonzero((tile[1:] != tile[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
        starts = [0, *new.tolist(), group.num_rows]
        found = [meet_blocks(group.slice(a, b - a)) for a, b in zip(starts, starts[1:])]
        out = np.unique(np.concatenate(found, axis=1), axis=1)
        return pa.table({"a": out[0], "b": out[1]})

    def meet_blocks(group: pa.Table) -> np.ndarray:
        i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
        block, label, n, ids = (group.column(c).to_numpy() for c in ("block", "label", "n", "set"))
        maps = folded(group.column("bits").to_pylist())
        rows, cols = np.flatnonzero(block == i), np.flatnonzero(block == j)
        out_a, out_b = [], []
        for r in rows.tolist():
            c = cols[(label[cols] != label[r]) & (ids[cols] != ids[r])]
            c = c[(OF * np.minimum(n[c], n[r]) >= NEAR * np.maximum(n[c], n[r]))]
            missing = np.bitwise_count(maps[r] & ~maps[c]).sum(axis=1, dtype=np.int64)
            extra = np.bitwise_count(maps[c] & ~maps[r]).sum(axis=1, dtype=np.int64)
            c = c[linked(np.minimum(n[r] - missing, n[c] - extra), n[r], n[c])]
            out_a.append(np.minimum(ids[r], ids[c]))
            out_b.append(np.maximum(ids[r], ids[c]))
        none = np.zeros(0, np.int64)
        return np.stack([np.concatenate([none, *out_a]), np.concatenate([none, *out_b])])

    return rows.select("group", "tile", "i", "j", "block", "set", "label", "n", "bits").groupBy("group").applyInArrow(meet, "a bigint, b bigint").distinct()


def _labelled(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(rows with words as (key, rid, th, n, label), rows without)."""
    sets = settle(document_sets(docs, key, text), "sets")
    nodes = sets.filter("n > 0")
    entries = nodes.agg(F.sum("n")).first()[0] or 0
    cells = max(96, math.ceil(0.65 * entries / CELL_ENTRIES))
    needs = settle(nodes.groupBy("set").agg(F.min("need").alias("need")), "needs")
    tiles = _with_hubs(settle(_tiles(docs, text, cells), "tiles"), needs)
    edges = settle(tiles.filter("set != hub").select("set", "hub").distinct(), "edges")
    ends = edges.select("set").union(edges.select(F.col("hub").alias("set"))).distinct()
    wanted = settle(nodes.join(ends, "set", "left_semi").groupBy("set").agg(F.min("rid").alias("rid")), "wanted")
    marks = settle(_contents(docs, key, text, wanted, bits=True), "bitmaps")
    links, labels, crossing = None, None, edges.withColumn("other", F.lit(0))
    if edges.isEmpty():
        return nodes.select("key", "rid", "th", "n", F.col("set").alias("label")), sets.filter("n = 0")

    def join_pairs(pairs: DataFrame) -> bool:
        """Add the links among the pairs; whether there were any."""
        nonlocal links, labels
        near = settle(_bounded(pairs, marks), "near")
        ends = near.select(F.col("a").alias("set")).union(near.select(F.col("b").alias("set"))).distinct()
        contents = _contents(docs, key, text, wanted.join(ends, "set"), bits=False)
        found = settle(_verified(near, contents).distinct(), "links")
        any_ = not found.isEmpty()
        if any_ or links is None:
            links = found if links is None else links.union(found)
            labels = components(links)
        return any_

    def still_open(left: DataFrame) -> DataFrame:
        """A missing link lies in tiles of several components, so sets that share too few cells in those leave them."""
        for _ in range(STRONG_ROUNDS):
            left = _strong(_named(left, labels), needs)
        return settle(_named(left, labels), "open-tiles")

    for pick in (F.min, F.max):
        join_pairs(crossing.groupBy(F.col("set").alias("a"), "other").agg(pick("hub").alias("b")))
        crossing = settle(_crossing(edges, labels), "crossing")
    if not crossing.isEmpty():
        open_ = _sifted(tiles, crossing, ["set", "hub"]).select("tile").distinct()
        left = _sifted(tiles.select("tile", "set", "shared"), settle(open_, "open"), ["tile"])
        degrees = settle(tiles.groupBy("set").agg(F.count("*").alias("degree")), "degrees")
        left = still_open(left)
        for _ in range(CENTRAL_ROUNDS):
            if left.isEmpty() or not join_pairs(_central(left, degrees)):
                break
            left = still_open(left)
        if not left.isEmpty():
            join_pairs(_block_pairs(left, marks))
    full = nodes.join(labels.select(F.col("node").alias("set"), "label"), "set", "left").withColumn(
        "label", F.coalesce("label", "set"))
    return full.select("key", "rid", "th", "n", "label"), sets.filter("n = 0")


def join_components(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id) of every row."""
    full, empty = _labelled(docs, key, text)
    full = settle(full.select("key", "n", "label"), "labelled")
    ids = full.groupBy("label").agg(F.min("key").alias("component_id"))
    out = join_spread(full, ids, ["label"]).select("key", "n", "component_id")
    return out.union(empty.select("key", "n", F.col("key").alias("component_id"))).select(
        F.col("key").alias(key), F.col("n").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of every component, with all its columns: the one with the smallest key; rows without words all stay."""
    full, empty = _labelled(docs, key, text)
    first = full.groupBy("label").agg(F.min(F.struct(F.col("key").isNull(), "key", "th", "rid")).alias("one"))
    kept = first.select("one.rid", "one.th").withColumn("single", F.lit(True)).union(
        empty.select("rid", "th").distinct().withColumn("single", F.lit(False)))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.xxhash64(docs[key]).alias("rid"), _text_hash(docs[text]).alias("th"))
    held = rows.join(kept, ["rid", "th"]).withColumn(
        "place", F.row_number().over(Window.partitionBy("rid", "th").orderBy("rid")))
    return held.filter((F.col("place") == 1) | ~F.col("single")).select(*[F.col("row")[c].alias(c) for c in docs.columns])


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_components(table(spark, sf_dir, "documents"))


#: Shingle sets, links between sets of different contents (through a shared shingle), and components by smallest reachable doc_id.
ORACLE = """
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [list_aggregate(w, 'string_agg', ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: list_aggregate(w[i:i + 4], 'string_agg', ' '))) END AS s FROM words),
kinds AS (SELECT md5(list_aggregate(list_sort(s), 'string_agg', '|')) AS k, min(doc_id) AS rep, any_value(s) AS s
    FROM sets WHERE len(s) > 0 GROUP BY 1),
tokens AS (SELECT rep, len(s) AS n, unnest(s) AS t FROM kinds),
pairs AS (SELECT a.rep AS a, b.rep AS b FROM tokens a JOIN tokens b ON a.t = b.t AND a.rep < b.rep
    GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
edges AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach AS (SELECT rep AS node, rep AS root FROM kinds UNION SELECT e.b, r.root FROM reach r JOIN edges e ON e.a = r.node),
comp AS (SELECT node, min(root) AS root FROM reach GROUP BY node),
named AS (SELECT s.doc_id, len(s.s) AS n, k.rep FROM sets s LEFT JOIN kinds k
    ON len(s.s) > 0 AND md5(list_aggregate(list_sort(s.s), 'string_agg', '|')) = k.k)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, coalesce(root, doc_id) AS component_id FROM named LEFT JOIN comp ON rep = node
"""

QUERIES = {"op3_jaccard_join": op3_jaccard_join}
ORACLES = {"op3_jaccard_join": ORACLE}
