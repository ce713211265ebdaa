"""Best-fit packing of token sequences into bins of several permitted lengths.

The lengths are optimised jointly: every capacity has a cost (by default the work of a transformer over that many
tokens: linear layers plus attention), pieces are placed in order of falling length into the open bin they fill
best, and where none has room the capacity with the least cost per token that holds the piece is opened. In the end
each bin is downsized to the cheapest capacity that holds its contents.

Documents are dealt into groups by a hash of their key, so that a group is one bounded task; bins never span groups.
A document longer than the largest capacity is cut into pieces of that capacity and a rest, spread over groups.

Defined results: NULL and empty texts have their end token only; NULL keys are keys; repeated rows are packed each
(``copy`` numbers them) and share no group if they are many; equal lengths are placed in the order of key, copy and
piece; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from popgauge.llm.common import binary, lean, slices
from popgauge.llm.tokens import encoder_of

#: Permitted sequence lengths.
CAPACITIES = (512, 1024, 2048, 4096, 8192)


def training_cost(capacity: int) -> float:
    """Relative work of one sequence: linear layers, and attention that catches up at 16,384 tokens."""
    return capacity * (1.0 + capacity / 16_384)


def best_fit(lengths: list[int], costs: dict[int, float]) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each length (given in falling order), and the capacity of each bin.

    Open bins are stacked by the room they have left; the bits of ``rooms`` tell which stacks are not empty."""
    by_rate = sorted(costs, key=lambda c: (costs[c] / c, c))
    rooms, stacks = 0, {}
    bins, offsets, used, opened = [], [], [], []
    for length in lengths:
        fitting = rooms >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            place = stacks[room].pop()
            if not stacks[room]:
                rooms ^= 1 << room
        else:
            room = next(c for c in by_rate if c >= length)
            place = len(used)
            used.append(0)
            opened.append(room)
        bins.append(place)
        offsets.append(used[place])
        used[place] += length
        left = room - length
        if left:
            if not stacks.get(left):
                stacks[left] = []
                rooms |= 1 << left
            stacks[left].append(place)
    by_cost = sorted(costs, key=lambda c: (costs[c], c))
    return bins, offsets, [next(c for c in by_cost if c >= u) for u in used]


def token_lengths(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_tokens``: tokens of each whole text, with one end token."""
    frame = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer)
        for batch in batches:
            for part in slices(batch):
                sizes = [len(ids) // encoder.width + 1 for ids in encoder.encode(binary(part.column(1)))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64())], ["doc_id", "n_tokens"])

    return frame.mapInArrow(lean(count), f"doc_id {dict(frame.dtypes)['doc_id']}, n_tokens bigint")


def packed(
    lengths: DataFrame, rows: int, costs: dict[int, float] | None = None, rows_per_group: int = 4_096,
) -> DataFrame:
    """``doc_id, copy, piece, first, n_tokens, bin_id, capacity, offset`` for ``lengths`` (``doc_id, n_tokens``).

    ``rows``: about how many documents there are; it sets the number of groups. ``first`` is the piece's first token
    in its document, ``offset`` in its bin."""
    costs = costs or {c: training_cost(c) for c in CAPACITIES}
    largest, groups = max(costs), max(1, -(-rows // rows_per_group))
    kind = dict(lengths.dtypes)["doc_id"]
    same = lengths.where("n_tokens > 0").groupBy("doc_id", "n_tokens").agg(F.count(F.lit(1)).alias("copies"))
    # A run of at most 64 copies and of at most 64 pieces is one row until it is dealt.
    runs = same.select(
        "doc_id", "n_tokens", "copies",
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1, F.lit(64).cast("bigint"))).alias("copy_from"),
    ).select(
        "*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n_tokens") - 1) / largest), F.lit(64).cast("bigint"))).alias("piece_from"),
    ).withColumn("pack", F.pmod(F.xxhash64("doc_id", "n_tokens", "copy_from", "piece_from"), F.lit(groups)))

    def fill(key: tuple, group: pa.Table) -> pa.Table:
        ids, pieces = group["doc_id"].combine_chunks(), []
        columns = (group[c].to_pylist() for c in ("n_tokens", "copies", "copy_from", "piece_from"))
        for row, (doc, n_tokens, copies, copy_from, piece_from) in enumerate(zip(ids.to_pylist(), *columns)):
            place = (doc is not None, 0 if doc is None else doc)
            for copy in range(copy_from, min(copies, copy_from + 64)):
                for piece in range(piece_from, min(-(-n_tokens // largest), piece_from + 64)):
                    pieces.append((-min(largest, n_tokens - piece * largest), *place, copy, piece, row))
        pieces.sort()
        bins, offsets, sizes = best_fit([-p[0] for p in pieces], costs)
        numbers = {
            "copy": [p[3] for p in pieces], "piece": [p[4] for p in pieces],
            "first": [p[4] * largest for p in pieces], "n_tokens": [-p[0] for p in pieces],
            "bin_id": [(key[0].as_py() << 32) + b for b in bins],
        }
        return pa.table({
            "doc_id": ids.take(pa.array([p[5] for p in pieces], pa.int64())), **{n: pa.array(v, pa.int64()) for n, v in numbers.items()},
            "capacity": pa.array([sizes[b] for b in bins], pa.int32()), "offset": pa.array(offsets, pa.int32()),
        })

    return runs.groupBy("pack").applyInArrow(
        fill, f"doc_id {kind}, copy bigint, piece bigint, first bigint, n_tokens bigint, bin_id bigint, capacity int, offset int",
    )
