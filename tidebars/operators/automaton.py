"""Small state machines over series, without running a whole series in one task.

A machine is a table ``transitions[code][state] -> state``. What a block of rows does is one map of states, worked out
for every start at once by composing the table's rows pairwise (in numpy). A pass over one map per block tells in
which state each block starts; then every block is run from there by itself. Exact for any table.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebars.operators.blocks import BLOCK, OWN, blocked
from tidebars.schema import SERIES, TS
from tidebars.session import materialize


def _composed(maps: np.ndarray) -> np.ndarray:
    """Where each state ends up after all rows of maps."""
    states = maps.shape[1]
    while len(maps) > 1:
        if len(maps) % 2:
            maps = np.concatenate([maps, np.arange(states, dtype=maps.dtype)[None]])
        maps = np.take_along_axis(maps[1::2], maps[::2].astype(np.int64), axis=1)
    return maps[0]


def run_automaton(
    df: DataFrame,
    code: str,
    transitions: Sequence[Sequence[int]],
    keys: Sequence[str] = SERIES,
    ts: str = TS,
    step: int | None = None,
    start: int = 0,
    name: str = "state_before",
    rows: int = 4096,
) -> DataFrame:
    """``df`` plus the machine's state before each row (``name``); ``code`` is a row of the table.

    ``df`` is worked out once and written; only times and codes of its rows go through the machine.
    """
    keys = list(keys)
    table = np.asarray(transitions, dtype=np.int16)
    key_types = ", ".join(f"`{k}` {dict(df.dtypes)[k]}" for k in keys)
    df = materialize(df)
    coded = df.select(*keys, ts, F.col(code).cast("int").alias("_code"))
    cut = blocked(coded, keys=keys, ts=ts, step=step, rows=rows).filter(F.col(OWN))
    blocks = (cut.groupBy(*keys, BLOCK).agg(F.sort_array(F.collect_list(F.struct(F.unix_micros(ts).alias("at"), "_code"))).alias("_rows"))
              .select(*keys, BLOCK, F.col("_rows.at").alias("_at"), F.col("_rows._code").alias("_codes")))

    def maps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[[*keys, BLOCK]].assign(_map=[_composed(table[np.asarray(codes)]) for codes in batch["_codes"]])

    def starts(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(BLOCK)
        state, seen = start, []
        for block_map in group["_map"]:
            seen.append(state)
            state = int(block_map[state])
        return group.drop(columns="_map").assign(_start=np.asarray(seen, dtype=np.int32))

    def states(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        steps = table.tolist()
        for batch in batches:
            for row in batch.to_dict("records"):
                state, before = row["_start"], []
                for c in row["_codes"]:
                    before.append(state)
                    state = steps[c][state]
                yield pd.DataFrame({**{k: [row[k]] * len(before) for k in keys}, "_at": row["_at"], name: before})

    begin = (blocks.select(*keys, BLOCK, "_codes").mapInPandas(maps, f"{key_types}, {BLOCK} long, _map array<smallint>")
             .groupBy(*keys).applyInPandas(starts, f"{key_types}, {BLOCK} long, _start int"))
    resolved = blocks.join(begin, [*keys, BLOCK]).mapInPandas(states, f"{key_types}, _at long, `{name}` int").select(
        *keys, F.timestamp_micros("_at").alias(ts), name)
    return df.join(resolved, [*keys, ts])
