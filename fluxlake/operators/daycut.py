"""Greedy spacing of forecast starts: keep the first, then the first at least ``hours`` later.

The chain is sequential, but what happens inside a block of time depends only on where the chain
enters it. Blocks are therefore solved in parallel for every possible entry, the entries actually
used are chained over the (few) blocks, and only those chains are expanded.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fluxlake.functions.calendar import time_micros
from fluxlake.session import materialize

DAY_HOURS = 24
BLOCK_STEPS = 64          # block length in units of the minimum spacing
HOUR_US = 3_600_000_000


def _block_chains(times: np.ndarray, gap: int, block_start: int) -> list[tuple[int, int, list[int]]]:
    """(entry, last kept time, kept times) for every time the chain can enter the block at.

    The chain enters at the first time not earlier than (a kept time of an earlier block + gap),
    so only times up to one gap into the block, and the first one after, are possible.
    """
    following = np.searchsorted(times, times + gap, side="left")
    n_entries = min(int(np.searchsorted(times, block_start + gap, side="right")) + 1, len(times))
    chains = []
    for entry in range(n_entries):
        kept, at = [], entry
        while at < len(times):
            kept.append(int(times[at]))
            at = int(following[at])
        chains.append((kept[0], kept[-1], kept))
    return chains


def spaced_starts(starts: DataFrame, keys: list[str], time: str = "forecast_start",
                  hours: int = DAY_HOURS) -> DataFrame:
    """``keys, time`` of the starts the cut keeps. Repeated times count once.

    Starts lie on the bin grid, so a block holds at most ``64 * hours / cadence`` of them, and the
    chaining step sees one gap's worth of entries per block.
    """
    if hours <= 0:
        raise ValueError(f"hours must be positive; got {hours}")
    at, kind = time_micros(starts, time), starts.schema[time].dataType
    back = (F.col("_t") * 1000).cast(kind) if isinstance(kind, T.IntegralType) else F.timestamp_micros("_t").cast(kind)
    gap = int(hours * HOUR_US)
    block_len = BLOCK_STEPS * gap
    times = (
        starts.select(*keys, at.alias("_t")).distinct()
        .withColumn("_block", F.floor(F.col("_t") / F.lit(block_len)).cast("long"))
    )
    key_fields = [f for f in times.schema.fields if f.name in keys]
    long = T.LongType()

    def solve(group: pa.Table) -> pa.Table:
        block = group["_block"][0].as_py()
        ordered = np.sort(group["_t"].to_numpy())
        entries, lasts, kept = zip(*_block_chains(ordered, gap, block * block_len))
        n = len(entries)
        same = {k: pa.repeat(group[k][0], n) for k in [*keys, "_block"]}
        return pa.table({**same, "_entry": pa.array(entries, pa.int64()),
                         "_last": pa.array(lasts, pa.int64()),
                         "_kept": pa.array(kept, pa.list_(pa.int64()))})

    solved_schema = T.StructType(
        [*key_fields, T.StructField("_block", long), T.StructField("_entry", long),
         T.StructField("_last", long), T.StructField("_kept", T.ArrayType(long))])
    # read twice, by the chain and by the expansion
    solved = materialize(times.groupBy(*keys, "_block").applyInArrow(solve, solved_schema), "day-cut")

    def chain(group: pa.Table) -> pa.Table:
        group = group.sort_by("_entry")
        entry, last = group["_entry"].to_numpy(), group["_last"].to_numpy()
        used, at = [], 0
        while at < len(entry):
            used.append(int(entry[at]))
            at = int(np.searchsorted(entry, last[at] + gap, side="left"))
        same = {k: pa.repeat(group[k][0], len(used)) for k in keys}
        return pa.table({**same, "_entry": pa.array(used, pa.int64())})

    used_schema = T.StructType([*key_fields, T.StructField("_entry", long)])
    used = (solved.select(*keys, "_entry", "_last")
            .groupBy(*keys).applyInArrow(chain, used_schema))
    return (
        solved.join(used, [*keys, "_entry"])
        .select(*keys, F.explode("_kept").alias("_t"))
        .select(*keys, back.alias(time))
    )
