"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

The ring has a fixed number of cells. Virtual nodes of the shards stand in cells; a key belongs to the first node clockwise
from its cell, and goes on clockwise while shards are full. What the driver needs is only how many keys each cell holds
(a number of counts that doesn't grow with the data): it replays the ring on these counts and gets, for each cell, which
ranks go to which shard. Keys are ranked within their cell in parallel.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm.shared import id_and_text, written

#: Cells of the ring, parts that a cell's keys are ranked in, virtual nodes of a shard.
CELLS, PARTS, NODES = 8192, 8, 64


def ring(shards: int, nodes: int = NODES, cells: int = CELLS) -> list[list[int]]:
    """For each cell, the shards whose virtual nodes stand there, in order. A shard's nodes don't depend on the others."""
    out: list[list[int]] = [[] for _ in range(cells)]
    for s in range(shards):
        for v in range(nodes):
            h = int.from_bytes(hashlib.blake2b(f"{s}/{v}".encode(), digest_size=8).digest(), "big")
            out[h % cells].append((h // cells, s))
    return [[s for _, s in sorted(x)] for x in out]


def place(counts: dict[tuple[int, int], int], shards: int, capacity: list[int], nodes: int = NODES, cells: int = CELLS) -> list[tuple[int, int, int, int, int, int]]:
    """(cell, part, from rank, to rank, shard, slot of the first): the ring replayed on counts.

    Keys arrive cell by cell. Each goes to the next node clockwise whose shard has room.
    """
    stops = ring(shards, nodes, cells)
    line = [(c, s) for c in range(cells) for s in stops[c]]
    begin, i = [], 0
    for c in range(cells):
        while i < len(line) and line[i][0] < c:
            i += 1
        begin.append(i % len(line))
    used = [0] * shards
    after = list(range(len(line)))  # the next node that isn't known to be full

    def find(x: int) -> int:
        seen = []
        while True:
            if used[line[x][1]] < capacity[line[x][1]]:
                break
            seen.append(x)
            step = after[x] if after[x] != x else (x + 1) % len(line)
            x = step
            if len(seen) > 2 * len(line):
                raise ValueError("capacities are below the number of keys")
        for s in seen:
            after[s] = x
        return x

    out = []
    for (cell, part), n in sorted(counts.items()):
        rank, x = 0, begin[cell]
        while rank < n:
            x = find(x)
            s = line[x][1]
            take = min(n - rank, capacity[s] - used[s])
            out.append((cell, part, rank, rank + take, s, used[s]))
            used[s] += take
            rank += take
    return out


def capacities(n: int, shards: int, epsilon: float) -> list[int]:
    """epsilon 0: floors and ceilings that sum to n, so counts are at most one apart. Else (1 + epsilon) times the mean."""
    if epsilon <= 0:
        return [n // shards + (s < n % shards) for s in range(shards)]
    return [math.ceil((1 + epsilon) * n / shards)] * shards


def assign_shards(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", epsilon: float = 0.0, nodes: int = NODES) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot: slots are gapless from 0 within a shard.

    A null text has no bytes; rows with a null id are spread over the ring one by one. An empty table gives no rows.
    Equal ids share a cell; ties within it are ordered by the text's checksum and size, and rows alike in all are alike.
    """
    if shards < 1:
        raise ValueError("at least one shard")
    base = id_and_text(docs, id_col, text_col)
    seed = F.when(F.col("doc_id").isNull(), F.xxhash64(F.lit("null"), F.monotonically_increasing_id())).otherwise(F.xxhash64("doc_id"))
    rows = written(
        base.select(
            "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).cast("long").alias("text_crc32"), seed.alias("_h"),
        ).withColumn("_cell", F.pmod("_h", F.lit(CELLS)).cast("int")).withColumn("_part", F.pmod(F.xxhash64("_h", "text_crc32"), F.lit(PARTS)).cast("int"))
    )
    counts = {(r[0], r[1]): r[2] for r in rows.groupBy("_cell", "_part").count().collect()}
    pieces = place(counts, shards, capacities(sum(counts.values()), shards, epsilon), nodes)
    table = docs.sparkSession.createDataFrame(pieces or [(0, 0, 0, 0, 0, 0)], "_cell int, _part int, _from long, _to long, shard int, _slot long")
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy("_cell", "_part").orderBy("_h", "doc_id", "text_crc32", "size")) - 1)
    # at most one piece for each cell and part and one more for each shard that fills up: CELLS * PARTS + shards * cells' turns
    out = ranked.join(F.broadcast(table), ["_cell", "_part"]).filter("_rank >= _from AND _rank < _to")
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("_slot") + F.col("_rank") - F.col("_from")).cast("long").alias("slot"))
