"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.session import cut, rounds


def _orient(e: DataFrame, keys: Sequence[str]) -> DataFrame:
    return (
        e.filter(F.col("a") != F.col("b"))
        .select(*keys, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )


def _forest(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """Edges of each batch as stars around the smallest node of their part; self edges are left out.

    A batch is a bounded number of edges, so this needs no more memory for a large component.
    """
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        ends = np.concatenate([batch.column("a").to_numpy(), batch.column("b").to_numpy()])
        own = [np.tile(pd.factorize(batch.column(k).to_pandas())[0], 2) for k in keys]
        order = np.lexsort((ends, *own))
        new = np.ones(2 * n, bool)
        new[1:] = ends[order[1:]] != ends[order[:-1]]
        for k in own:
            new[1:] |= k[order[1:]] != k[order[:-1]]
        node = np.empty(2 * n, np.int64)
        node[order] = np.cumsum(new) - 1
        u, v = node[:n], node[n:]
        root = np.arange(int(new.sum()))
        while True:
            low = np.minimum(root[u], root[v])
            fresh = root.copy()
            np.minimum.at(fresh, u, low)
            np.minimum.at(fresh, v, low)
            np.minimum.at(fresh, root[u], low)
            np.minimum.at(fresh, root[v], low)
            fresh = fresh[fresh]
            if (fresh == root).all():
                break
            root = fresh
        first = order[new]  # where each node stands in ``ends``
        move = np.flatnonzero(root != np.arange(len(root)))
        rows = pa.array(first[move] % n)
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(k).take(rows) for k in keys], pa.array(ends[first[move]]), pa.array(ends[first[root[move]]])], [*keys, "a", "b"]
        )


def connected_components(edges: DataFrame, keys: Sequence[str] = (), max_rounds: int = 1000, batch_merge: bool = True) -> DataFrame:
    """Label every node of ``edges(keys, a, b)`` with the smallest node of its component.

    A hub is never collected: each round takes a minimum per node (combined map-side)
    and joins it back, so a component of any size stays spread over the cluster.
    Self edges keep isolated nodes in the result. The rounds end when nothing changes, which
    takes about the logarithm of the longest path; ``max_rounds`` only guards against a fault.
    ``batch_merge`` first shrinks the edges of every Arrow batch to stars: edges sorted by node
    lie close together, so most of a component is merged before the first round.
    """
    keys = list(keys)
    edges = cut(edges.select(*keys, F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b")).distinct())
    nodes = edges.select(*keys, F.col("a").alias("node")).union(edges.select(*keys, F.col("b").alias("node"))).distinct()
    if batch_merge:
        near = edges.filter(F.col("a") != F.col("b")).repartitionByRange(*keys, "a").sortWithinPartitions(*keys, "a")
        e = cut(_orient(near.mapInArrow(lambda batches: _forest(batches, keys), edges.schema), keys))
    else:
        e = cut(_orient(edges, keys))
    seen = None
    for _ in rounds(max_rounds, "connected components"):
        both = e.unionByName(e.select(*keys, F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy(*keys, "a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter(F.col("b") > F.col("a")).join(low, [*keys, "a"]).select(*keys, F.col("b").alias("a"), F.col("m").alias("b"))
        e1 = _orient(large, keys)
        low = e1.groupBy(*keys, "a").agg(F.min("b").alias("m"))
        small = e1.join(low, [*keys, "a"]).select(*keys, F.col("b").alias("a"), F.col("m").alias("b"))
        e = cut(_orient(small.unionByName(low.select(*keys, "a", F.col("m").alias("b"))), keys))
        mark = e.agg(F.count("*"), F.sum(F.xxhash64(*keys, "a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    return (
        nodes.join(e.select(*keys, F.col("a").alias("node"), F.col("b").alias("comp")), [*keys, "node"], "left")
        .withColumn("comp", F.coalesce("comp", "node"))
    )
