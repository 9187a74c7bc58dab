"""Distributed union-find: connected components of an edge list."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Scratch


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of each of n nodes' components, for edges within one task."""
    up = np.arange(n)
    while True:
        x, y = up[a], up[b]
        lo, hi = np.minimum(x, y), np.maximum(x, y)
        differ = lo != hi
        if not differ.any():
            return up
        a, b, lo, hi = a[differ], b[differ], lo[differ], hi[differ]
        np.minimum.at(up, hi, lo)
        while True:
            above = up[up]
            if (above == up).all():
                break
            up = above


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) of every node on an edge (a, b) of longs; the component is its smallest node.

    Alternates large-star and small-star steps (each joins every node to the smallest of its
    neighbourhood) until nothing changes: logarithmically many rounds, also for long chains, and
    a hub's edges are never gathered: its minimum is pre-aggregated and joined back, which adaptive
    execution may split. Each round is a table in the shared folder.
    """

    def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # what a task's own edges connect becomes one star for each batch
        for batch in batches:
            a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
            root = ids[roots(len(ids), at[: len(a)], at[len(a) :])]
            yield pa.RecordBatch.from_arrays([pa.array(ids[ids != root]), pa.array(root[ids != root])], names=["v", "u"])

    now = scratch.cut(edges.select("a", "b").mapInArrow(forest, "v long, u long").distinct(), "edges")
    before = None
    while True:
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())
        if state == before:
            return now.select(F.col("v").alias("node"), F.col("u").alias("component")).unionByName(now.select(F.col("u").alias("node"), F.col("u").alias("component"))).distinct() if state[0] else now.select(F.col("v").alias("node"), F.col("u").alias("component"))
        before = state
        # large star: all larger neighbours of a node go to the smallest of its neighbourhood
        both = now.unionByName(now.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.least(F.min("u"), F.first("v")).alias("m"))
        large = both.where("u > v").join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).where("v <> u").distinct()
        # small star: all smaller neighbours of a node, and itself, go to the smallest
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v").select("v", "u", "m")
        step = small.select(F.col("u").alias("v"), F.col("m").alias("u")).unionByName(least.select("v", F.col("m").alias("u"))).where("v <> u").distinct()
        after = scratch.cut(step, "edges")
        scratch.drop(now)
        now = after
