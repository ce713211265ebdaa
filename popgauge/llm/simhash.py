"""SimHash near-duplicates through an inverted index over byte positions, with count filtering.

A fingerprint of B bytes within ``max_bits`` bits of another shares at least ``B - max_bits`` positional bytes with
it: the guaranteed number of matches. The index posts each distinct fingerprint under combinations of positional
bytes, chosen so that any two fingerprints with the guaranteed matches meet in at least one posting. Each pair that
meets is tallied over all positions, kept if it reaches the guarantee, and verified.

A posting of many fingerprints is never expanded into its pairs. With ``max_bits`` of 2 its members are linked
exactly through the fingerprints at most one bit away: two differ in at most two bits if and only if they share one,
and each is shared by 65 at most.

Defined results: NULL and blank texts have no shingle and the fingerprint zero; texts with fewer words than a shingle
are one shingle; equal texts share a fingerprint and are one node; empty tables give empty results; other columns
are ignored (``fingerprints``, ``linked``) or passed through (``one_of_each``).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from popgauge.llm.common import binary, lean, slices
from popgauge.llm.components import components
from popgauge.session import cut_lineage

SEED = 42
#: Postings up to this length are expanded into pairs.
EXPAND = 32


def shingles(data: bytes, words: int) -> list[bytes]:
    """Runs of ``words`` words of the lower-cased text, joined by one space; the whole sequence if it is shorter."""
    split = data.lower().split()
    if len(split) <= words:
        return [b" ".join(split)] if split else []
    if words == 1:
        return split
    line = b" ".join(split)
    ends = np.cumsum(np.fromiter(map(len, split), np.int64, len(split)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return [line[a:b] for a, b in zip(starts[: len(split) - words + 1].tolist(), ends[words - 1:].tolist())]


def fingerprint(features: list[bytes], lanes: int = 1) -> list[int]:
    """Signed 64-bit lanes; a bit is 1 if it is set in over half the features' hashes (XXH64, seeds 42, 43, ...)."""
    if not features:
        return [0] * lanes
    out, digest = [], xxhash.xxh64_intdigest
    for lane in range(lanes):
        hashes = np.fromiter((digest(f, SEED + lane) for f in features), np.uint64, len(features)).astype(">u8")
        counts = np.zeros(64, np.int64)
        for at in range(0, len(hashes), 4_096):
            counts += np.unpackbits(hashes[at:at + 4_096].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        out.append(int(np.packbits(2 * counts > len(features)).view(">i8")[0]))
    return out


def fingerprints(
    docs: DataFrame, words: int = 3, lanes: int = 1, doc_id: str = "doc_id", text: str = "text", keep_node: bool = False,
) -> DataFrame:
    """``doc_id, lanes`` of whole texts; ``keep_node`` adds the number of the text, the same for equal texts."""
    frame = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), *[_text_node(text).alias("node")] * keep_node)

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                prints = []
                for data in binary(part.column(1)):
                    prints.append(fingerprint(shingles(data or b"", words), lanes))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *part.columns[2:], pa.array(prints, pa.list_(pa.int64()))],
                    ["doc_id", *["node"] * keep_node, "lanes"])

    node = ", node bigint" if keep_node else ""
    return frame.mapInArrow(lean(take), f"doc_id {dict(frame.dtypes)['doc_id']}{node}, lanes array<bigint>")


def cover(n_bytes: int, matches: int, key_bytes: int) -> list[tuple[int, ...]]:
    """Byte positions of each key, so that any ``matches`` equal positions contain one whole key.

    Two designs, the smaller counts. Parts: cut the positions into p parts; some part has ``matches / p`` of the
    equal ones, so its combinations of ``key_bytes`` do. Blocks: of n blocks at most ``n_bytes - matches`` differ, so
    all combinations of the other blocks do."""
    parts = max(1, (matches - 1) // max(1, key_bytes - 1)) if key_bytes > 1 else 1
    cuts = [range(n_bytes * i // parts, n_bytes * (i + 1) // parts) for i in range(parts)]
    designs = [[c for cut in cuts for c in combinations(cut, key_bytes)]]
    for size in range(2, key_bytes + 1):
        whole = n_bytes // size - (n_bytes - matches)
        if n_bytes % size == 0 and whole * size >= key_bytes:
            blocks = [tuple(range(i, i + size)) for i in range(0, n_bytes, size)]
            designs.append([sum(chosen, ()) for chosen in combinations(blocks, whole)])
    return min(designs, key=len)


def _masks(positions: tuple[int, ...], lanes: int) -> list[int]:
    masks = [0] * lanes
    for p in positions:
        masks[p // 8] |= 0xFF << 8 * (7 - p % 8)
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _keys(lanes: int, keys: list[tuple[int, ...]]) -> Column:
    """Array of the posting keys of ``lanes``."""
    return F.array(*[
        F.xxhash64(F.lit(number), *[F.col("lanes")[i].bitwiseAND(F.lit(m)) for i, m in enumerate(_masks(key, lanes)) if m])
        for number, key in enumerate(keys)
    ])


def _tally(lanes: int, a: str, b: str) -> tuple[Column, Column]:
    """(equal positional bytes, differing bits) of two fingerprints."""
    equal, differing = F.lit(0), F.lit(0)
    for i in range(lanes):
        x = F.col(a)[i].bitwiseXOR(F.col(b)[i])
        differing = differing + F.bit_count(x)
        for byte in range(8):
            equal = equal + (F.shiftrightunsigned(x, 8 * byte).bitwiseAND(F.lit(255)) == 0).cast("int")
    return equal, differing


def _postings(nodes: DataFrame, lanes: int, keys: list[tuple[int, ...]]) -> DataFrame:
    """``node, key``; the fingerprints stay behind, so that what is shuffled is narrow."""
    return nodes.select("node", F.explode(_keys(lanes, keys)).alias("key"))


def _expanded(postings: DataFrame) -> DataFrame:
    """All pairs ``a < b`` of postings known to be short."""
    held = postings.groupBy("key").agg(F.collect_list("node").alias("m"))
    each = held.select(F.explode("m").alias("a"), "m").select("a", F.explode("m").alias("b"))
    return each.where("a < b")


def _filtered(pairs: DataFrame, nodes: DataFrame, lanes: int, matches: int, most_bits: int) -> DataFrame:
    """Distinct pairs that reach the guaranteed matches and differ in at most ``most_bits`` bits."""
    side = lambda name, print_: nodes.select(F.col("node").alias(name), F.col("lanes").alias(print_))
    both = pairs.distinct().join(side("a", "p"), "a").join(side("b", "q"), "b")
    equal, differing = _tally(lanes, "p", "q")
    return both.where((equal >= matches) & (differing <= most_bits)).select("a", "b")


def _lengths(postings: DataFrame) -> DataFrame:
    return postings.groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def linked(prints: DataFrame, key_bytes: int = 4) -> DataFrame:
    """``node`` (one-lane fingerprint) and ``root`` (least fingerprint reachable over links of at most two bits) of
    every distinct fingerprint that has a link."""
    max_bits = 2
    matches = 8 - max_bits
    nodes = cut_lineage(prints.select(F.col("lanes")[0].alias("node")).distinct()).withColumn("lanes", F.array("node"))
    postings = _postings(nodes, 1, cover(8, matches, key_bytes))
    short = postings.join(_lengths(postings).where(F.col("n").between(2, EXPAND)).select("key"), "key")
    links = _filtered(_expanded(short), nodes, 1, matches, max_bits)
    crowded = postings.join(_lengths(postings).where(F.col("n") > EXPAND).select("key"), "key").select("node").distinct()
    one_away = F.expr("concat(array(node), transform(sequence(0, 63), i -> node ^ shiftleft(1L, i)))")
    balls = crowded.select("node", F.explode(one_away).alias("centre"))
    stars = balls.groupBy("centre").agg(F.min("node").alias("a"), F.collect_list("node").alias("m")).where(F.size("m") > 1)
    return components(links.unionByName(stars.select("a", F.explode("m").alias("b")).where("a != b").distinct()))


def fingerprint_classes(docs: DataFrame, words: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, fingerprint`` (16 hex digits) and ``component_id`` (least id reachable over links of at most two
    bits) of every document. A component of NULL ids only has a NULL id."""
    prints = cut_lineage(fingerprints(docs, words, doc_id=doc_id, text=text).select("doc_id", F.col("lanes")[0].alias("node")))
    roots = linked(prints.select(F.array("node").alias("lanes")))
    nodes = prints.groupBy("node").agg(F.min("doc_id").alias("least"))
    rooted = cut_lineage(nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select("node", "component_id")
    return prints.join(named, "node").select(
        "doc_id", F.lower(F.lpad(F.hex("node"), 16, "0")).alias("fingerprint"), "component_id")


def _text_node(text: str) -> Column:
    """Number of a text: equal texts are one node."""
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """The documents, all columns kept: of each class of near duplicates (fingerprints linked at two bits, as in
    ``fingerprint_classes``) the row with the least id; of several rows with that id the one whose text has the least hash,
    and of rows equal in id and text one. NULL ids come last."""
    prints = cut_lineage(fingerprints(docs, words, doc_id=doc_id, text=text, keep_node=True).select(
        "doc_id", F.col("node").alias("text"), F.col("lanes")[0].alias("node")))
    roots = linked(prints.select(F.array("node").alias("lanes")))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text")
    least = prints.groupBy("node").agg(F.min(place).alias("first")).join(roots, "node", "left")
    winners = least.groupBy(F.coalesce("root", "node")).agg(F.min("first").alias("first")).select("first.doc_id", "first.text")
    rows = prints.groupBy("doc_id", "text").agg(F.count(F.lit(1)).alias("n"))
    same = F.col("w.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("w.text") == F.col("r.text"))
    kept = cut_lineage(winners.alias("w").join(rows.alias("r"), same).select("w.*", "n"))
    whole = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.col(doc_id).alias("doc_id"), _text_node(text).alias("text"))

    def of(chosen: DataFrame) -> DataFrame:
        match = whole["doc_id"].eqNullSafe(chosen["doc_id"]) & (whole["text"] == chosen["text"])
        return whole.join(chosen, match, "left_semi")

    # Only rows that are repeated have to meet; the others stay where they are if the kept ids are few enough to send.
    repeated = of(kept.where("n > 1")).groupBy("doc_id", "text").agg(F.first("row").alias("row"))
    return of(kept.where("n = 1")).select("row.*").unionByName(repeated.select("row.*"))
