"""Ordered operators over long sequences, split into blocks.

A session can hold a third of all scans, so a window over a whole session would put
that third into one task. Every operator here windows over (session, block) and then
over one row per block; the block is a monotone function of the order.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanloom.session import cut, rounds

BLOCK = 4096


def block_of(order: Column, width: float = BLOCK) -> Column:
    return F.floor(order / width).cast("bigint")


def row_number(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column, name: str = "rn"
) -> DataFrame:
    """Row number from 1 within ``keys``, computed block by block plus a running offset."""
    df = df.withColumn("_blk", block)
    local = Window.partitionBy(*keys, "_blk").orderBy(*order)
    offsets = (
        df.groupBy(*keys, "_blk").agg(F.count("*").alias("_n"))
        .withColumn(
            "_off",
            F.coalesce(F.sum("_n").over(
                Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
            ), F.lit(0)),
        )
        .drop("_n")
    )
    return (
        df.withColumn("_loc", F.row_number().over(local))
        .join(offsets, [*keys, "_blk"])
        .withColumn(name, (F.col("_off") + F.col("_loc")).cast("bigint"))
        .drop("_blk", "_loc", "_off")
    )


def running_sum(df: DataFrame, keys: Sequence[str], order: str, block: Column, column: str, name: str) -> DataFrame:
    """Sum of ``column`` up to and with each row, block by block plus a running offset."""
    df = df.withColumn("_blk", block)
    before = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        df.groupBy(*keys, "_blk").agg(F.sum(column).alias("_n"))
        .withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    )
    local = F.sum(column).over(Window.partitionBy(*keys, "_blk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("_loc", local).join(offsets, [*keys, "_blk"]).withColumn(name, F.col("_off") + F.col("_loc")).drop("_blk", "_loc", "_off")


def neighbour(
    df: DataFrame, keys: Sequence[str], order: str, block: Column, take: Sequence[str],
    step: int = -1, name: str = "prev",
) -> DataFrame:
    """Struct ``name`` of columns ``take`` of the previous (-1) or next (+1) row."""
    df = df.withColumn("_blk", block).withColumn("_pay", F.struct(F.col(order).alias("_o"), *take))
    shift = F.lag if step < 0 else F.lead
    local = Window.partitionBy(*keys, "_blk").orderBy(order)
    edge = (F.max if step < 0 else F.min)("_pay")
    edges = (
        df.groupBy(*keys, "_blk").agg(edge.alias("_edge"))
        .withColumn("_edge", shift("_edge").over(Window.partitionBy(*keys).orderBy("_blk")))
    )
    return (
        df.withColumn("_near", shift("_pay").over(local))
        .join(edges, [*keys, "_blk"])
        .withColumn(name, F.coalesce("_near", "_edge"))
        .drop("_blk", "_pay", "_near", "_edge")
    )


def asof(
    probe: DataFrame, ref: DataFrame, keys: Sequence[str], probe_t: str, ref_t: str,
    take: Sequence[str], width: float = 60.0, strict: bool = False,
) -> DataFrame:
    """Add structs ``prev`` (last ref at or before) and ``next`` (first ref at or after).

    ``strict`` leaves out refs at exactly the probe's time.

    The time axis is cut into buckets of ``width``; a bucket without an earlier ref
    takes the last one of the buckets before it.
    """
    ref_row = F.struct(F.col(ref_t).alias("t"), *take)
    probe_row = F.struct(*[F.col(c) for c in probe.columns])
    left = probe.select(*keys, F.col(probe_t).cast("double").alias("_t"), F.lit(0 if strict else 1).alias("_tag"), probe_row.alias("_probe"))
    right = ref.select(*keys, F.col(ref_t).cast("double").alias("_t"), F.lit(1 if strict else 0).alias("_tag"), ref_row.alias("_ref"))
    both = left.unionByName(right, allowMissingColumns=True).withColumn("_b", block_of(F.col("_t"), width))
    lead_in = [Window.unboundedPreceding, Window.currentRow]
    fwd = Window.partitionBy(*keys, "_b").orderBy(F.col("_t"), F.col("_tag")).rowsBetween(*lead_in)
    back = Window.partitionBy(*keys, "_b").orderBy(F.col("_t").desc(), F.col("_tag")).rowsBetween(*lead_in)
    earlier = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy(*keys).orderBy(F.col("_b").desc()).rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        both.groupBy(*keys, "_b").agg(F.max("_ref").alias("_last"), F.min("_ref").alias("_first"))
        .withColumn("_pc", F.last("_last", ignorenulls=True).over(earlier))
        .withColumn("_nc", F.last("_first", ignorenulls=True).over(later))
        .select(*keys, "_b", "_pc", "_nc")
    )
    return (
        both.withColumn("_pl", F.last("_ref", ignorenulls=True).over(fwd))
        .withColumn("_nl", F.last("_ref", ignorenulls=True).over(back))
        .filter(F.col("_probe").isNotNull())
        .join(carry, [*keys, "_b"])
        .select("_probe.*", F.coalesce("_pl", "_pc").alias("prev"), F.coalesce("_nl", "_nc").alias("next"))
    )


Step = Callable[[np.ndarray | None, pd.DataFrame], tuple[np.ndarray, np.ndarray]]


def fold(
    df: DataFrame, keys: Sequence[str], order: str, block: Column, step: Step,
    flag: str = "flag", max_rounds: int = 1_000_000, sample: int = 0,
) -> DataFrame:
    """Run a sequential pass over each key, block by block, and add its per-row result.

    ``step(state, rows)`` returns one BIGINT per row and the state after the last row.
    All blocks run at once from an unknown state; a block is run again only when the
    state handed over by the block before it has changed. After round r the first r
    blocks are final, so the result always equals the sequential pass. A pass whose state
    forgets the past within a block settles in two or three rounds; the state must therefore
    hold no running number (see :func:`running_sum`).

    With ``sample`` the blocks start from a guess instead: a pass over so many evenly spaced rows of each block. That
    suits a state that never forgets where it began but follows the rows; where the guess is wrong the block is run
    again, so it changes the number of rounds only.
    """
    df = df.withColumn("_blk", block)
    columns = df.columns
    schema_keys = [f for f in df.schema.fields if f.name in (*keys, "_blk")]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema_keys)
    names = [f.name for f in schema_keys]

    def run_states(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        state = pdf["_in"].iloc[0]
        _, last = step(None if state is None else np.asarray(state, dtype=float), pdf)
        row = {n: [pdf[n].iloc[0]] for n in names}
        return pd.DataFrame({**row, "_out": [np.asarray(last, dtype=float)]})

    heads = df.groupBy(*keys, "_blk").agg(F.count("*").alias("_n")).drop("_n")
    order_blocks = Window.partitionBy(*keys).orderBy("_blk")
    if sample:

        def spaced(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(order, kind="stable")
            return pdf.iloc[np.unique(np.linspace(0, len(pdf) - 1, sample).astype(np.int64))]

        def guess(pdf: pd.DataFrame) -> pd.DataFrame:
            state, rows = None, []
            for _, part in pdf.sort_values(["_blk", order], kind="stable").groupby("_blk", sort=True):
                rows.append([*[part[n].iloc[0] for n in names], state])
                _, state = step(state, part)
                state = np.asarray(state, dtype=float)
            return pd.DataFrame(rows, columns=[*names, "_in"])

        few = df.groupBy(*keys, "_blk").applyInPandas(spaced, df.schema).filter(F.col("_blk").isNotNull())
        guessed = few.groupBy(*keys).applyInPandas(guess, f"{ddl}, _in array<double>")
        states = cut(heads.join(guessed, [*keys, "_blk"], "left").withColumn("_todo", F.lit(True)))
    else:
        states = cut(heads.withColumn("_in", F.lit(None).cast("array<double>")).withColumn("_todo", F.lit(True)))
    outs = None
    for _ in rounds(max_rounds, "sequential pass"):
        todo = states.filter("_todo").select(*keys, "_blk", "_in")
        fresh = (
            df.join(todo, [*keys, "_blk"])
            .groupBy(*keys, "_blk").applyInPandas(run_states, f"{ddl}, _out array<double>")
        )
        if outs is None:
            outs = cut(fresh)
        else:
            kept = outs.join(todo.select(*keys, "_blk"), [*keys, "_blk"], "left_anti")
            outs = cut(kept.unionByName(fresh))
        shifted = outs.withColumn("_new", F.lag("_out").over(order_blocks)).drop("_out")
        states = cut(
            states.drop("_todo").join(shifted, [*keys, "_blk"])
            .withColumn("_todo", ~F.col("_new").eqNullSafe(F.col("_in")))
            .select(*keys, "_blk", F.col("_new").alias("_in"), "_todo")
        )
        if states.filter("_todo").isEmpty():
            break

    out_fields = ", ".join(
        f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != "_blk"
    )

    def run_rows(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        state = pdf["_in"].iloc[0]
        flags, _ = step(None if state is None else np.asarray(state, dtype=float), pdf)
        out = pdf[[c for c in columns if c != "_blk"]].copy()
        out[flag] = np.asarray(flags, dtype=np.int64)
        return out

    return (
        df.join(states.drop("_todo"), [*keys, "_blk"])
        .groupBy(*keys, "_blk").applyInPandas(run_rows, f"{out_fields}, `{flag}` bigint")
    )
