"""Sharding by a hierarchical weighted hash tree.

The tree has regions, racks and shards. A key descends from the root: at each level every child draws
``-ln(u) / weight`` from a hash of the key and its own name, an exponential variable whose rate is the summed weight of
the child's subtree, and the least draw takes the key. A key thus meets the children of three nodes, not all leaves.
When a weight changes, only draws on the path to it change: keys move into, out of or below the nodes of that path, and
all others stay.

A leaf that joins later brings a draw of its own against the root's least draw, which is exponential with the weight of
the whole tree: the leaf gets its share, and keys move into it and nowhere else. (Raising the weights of its ancestors
instead would draw keys into their older leaves too.)

Defined results: a NULL key is a key of its own; equal keys go to the same shard; NULL and empty texts have no
bytes; repeated rows each get a slot; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from popgauge.session import cut_lineage

#: Fan-out below a region and below a rack.
RACKS, SHARDS = 4, 5


def tree(shards: int, weights: dict[int, float] | None = None) -> list[tuple[int, int, int, float]]:
    """(region, rack, shard, weight) of every leaf: five shards to a rack, four racks to a region."""
    weights = weights or {}
    return [(s // (RACKS * SHARDS), s // SHARDS, s, float(weights.get(s, 1.0))) for s in range(shards)]


def _digits(text: Column) -> Column:
    """The first 48 bits of the text's MD5."""
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("bigint")


def draw(key: Column, node: str, weight: float) -> Column:
    """Exponential draw of a node from 48 bits of a hash of (node, key)."""
    u = (_digits(F.concat(F.lit(f"{node}:"), key)).cast("double") + F.lit(0.5)) / F.lit(float(1 << 48))
    return -F.ln(u) / F.lit(weight)


def _least(key: Column, kind: str, weights: dict[int, float]) -> Column:
    """The child with the least draw: struct of ``draw`` and ``node``."""
    return F.array_min(F.array(*[F.struct(draw(key, f"{kind}{n}", w).alias("draw"), F.lit(n).alias("node")) for n, w in weights.items()]))


def descend(rows: DataFrame, key: Column, leaves: list[tuple[int, int, int, float]]) -> DataFrame:
    """``rows`` with the leaf that ``key`` reaches (``region, rack, shard``) and the root's least draw (``draw``)."""
    regions: dict[int, float] = {}
    racks: dict[int, dict[int, float]] = {}
    shards: dict[int, dict[int, float]] = {}
    for region, rack, shard, weight in leaves:
        regions[region] = regions.get(region, 0.0) + weight
        below = racks.setdefault(region, {})
        below[rack] = below.get(rack, 0.0) + weight
        shards.setdefault(rack, {})[shard] = weight

    def among(node: str, kind: str, children: dict[int, dict[int, float]]) -> Column:
        # Only the branch of the node that was reached is evaluated.
        return F.coalesce(*[F.when(F.col(node) == n, _least(key, kind, c)["node"]) for n, c in children.items()])

    rooted = rows.withColumn("_root", _least(key, "region", regions)).select("*", F.col("_root.draw").alias("draw"), F.col("_root.node").alias("region"))
    return rooted.drop("_root").withColumn("rack", among("region", "rack", racks)).withColumn("shard", among("rack", "shard", shards))


def place(
    docs: DataFrame, shards: int, doc_id: str = "doc_id", text: str = "text", weights: dict[int, float] | None = None,
    rows_per_bucket: int = 20_000,
) -> DataFrame:
    """One row per document: ``doc_id, size, text_crc32, region, rack, shard, slot, grown_shard``.

    Slots count from 0 without gaps. A shard may be too large for one task, so its rows are dealt into hash buckets
    of about ``rows_per_bucket`` rows, numbered inside, and shifted by the rows of the buckets before. Equal rows
    are counted first and numbered as one."""
    bytes_ = F.col(text).cast("binary")
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.coalesce(F.octet_length(bytes_), F.lit(0)).cast("bigint") + F.lit(16)).alias("size"),
        F.crc32(F.coalesce(bytes_, F.lit(b""))).alias("text_crc32"),
    )
    total = rows.count()
    buckets = -(-total // (shards * rows_per_bucket)) + 1
    leaves = tree(shards, weights)
    new = tree(shards + 1, weights)[-1]
    same = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("copies"))
    text_key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    placed = descend(same, text_key, leaves).select(
        "*", F.when(draw(text_key, f"shard{new[2]}", new[3]) < F.col("draw"), F.lit(new[2])).otherwise(F.col("shard")).alias("grown_shard"),
        F.pmod(_digits(F.concat(F.lit("slot:"), text_key)), F.lit(buckets)).cast("int").alias("bucket"),
    ).drop("draw")
    placed = cut_lineage(placed)
    upto = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")
    inside = placed.withColumn("after", F.sum("copies").over(upto))
    held = inside.groupBy("shard", "bucket").agg(F.sum("copies").alias("held"))
    before = held.select(
        "shard", "bucket",
        (F.sum("held").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("held")).alias("base"),
    )
    first = F.col("base") + F.col("after") - F.col("copies")
    return inside.join(before, ["shard", "bucket"]).select(
        "doc_id", "size", "text_crc32", "region", "rack", "shard",
        F.explode(F.sequence(first, first + F.col("copies") - 1)).alias("slot"), "grown_shard",
    )
