"""Cells of vectors: seeded k-means over directions, and exact top-K that reads only the cells a question can find something in."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.operators import retrieval

#: Rounding of angles and scores is below this.
SLACK = 1e-9


def _units(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of length 1, and the lengths they had; one of length 0 stays so."""
    v = retrieval._matrix(column)
    size = np.sqrt((v**2).sum(axis=1))
    return v / np.where(size > 0, size, 1)[:, None], size


def _nearest(units: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (units @ centres.T).argmax(axis=1)


def kmeans(rows: DataFrame, *, id_column: str, vector: str, k: int, rounds: int = 10, seed: int = 1) -> np.ndarray:
    """(k or fewer, dimensions) centres of length 1 of the rows' directions; rows whose vector is null or has length 0 don't count.

    It starts from the directions of the k rows of least seeded hash. In each round every task sums
    up the directions that are nearest to each centre (the first of equally near ones); only k
    sums reach the driver. Ends after ``rounds``, or when no centre moves. A centre that is left
    without rows stays where it is.
    """
    good = rows.select(F.col(id_column).alias("id"), F.col(vector).cast("array<double>").alias("v")).where("v is not null and exists(v, x -> x <> 0)")
    first = good.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(k).select("v").toArrow()
    if not first.num_rows:
        return np.zeros((0, 0))
    centres = np.unique(_units(first.column("v").combine_chunks())[0], axis=0)

    for _ in range(rounds):
        sent = rows.sparkSession.sparkContext.broadcast(centres)

        def sums(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            centres = sent.value
            total = np.zeros_like(centres)
            for batch in batches:
                if batch.num_rows:
                    units, _ = _units(batch.column("v"))
                    np.add.at(total, _nearest(units, centres), units)
            cell, place = np.nonzero(total)
            yield pa.record_batch([pa.array(cell), pa.array(place), pa.array(total[cell, place])], ["cell", "place", "x"])

        found = good.select("v").mapInArrow(sums, "cell long, place long, x double").groupBy("cell", "place").agg(F.sum("x").alias("x")).toArrow()
        sent.unpersist()
        total = np.zeros_like(centres)
        total[found.column("cell").to_numpy(), found.column("place").to_numpy()] = found.column("x").to_numpy()
        size = np.sqrt((total**2).sum(axis=1))
        # sums come in any order: their last digits are cut off
        moved = np.where(size[:, None] > 0, np.round(total / np.where(size > 0, size, 1)[:, None], 9), centres)
        still = (moved == centres).all()
        centres = moved
        if still:
            break
    return centres


def assigned(rows: DataFrame, centres: np.ndarray, *, vector: str) -> DataFrame:
    """rows with cell (the nearest centre), away (the angle to it) and size (the vector's length); null where the vector is null or has length 0."""
    sent = rows.sparkSession.sparkContext.broadcast(centres)
    kept = [c for c in rows.columns if c not in ("cell", "away", "size")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = sent.value
        for batch in batches:
            cell, away, length = (np.full(batch.num_rows, x, t) for x, t in ((-1, np.int64), (np.nan, float), (np.nan, float)))
            some = np.flatnonzero(np.array(batch.column("__v").is_valid()))
            if len(some) and len(centres):
                units, size = _units(batch.column("__v").take(pa.array(some)))
                near = _nearest(units, centres)
                angle = np.arccos(np.clip((units * centres[near]).sum(axis=1), -1, 1))
                good = size > 0
                cell[some[good]], away[some[good]], length[some[good]] = near[good], angle[good], size[good]
            none = cell < 0
            yield pa.record_batch([*(batch.column(c) for c in kept), pa.array(cell, pa.int32(), mask=none), pa.array(away, mask=none), pa.array(length, mask=none)], [*kept, "cell", "away", "size"])

    ddl = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept), "cell int, away double, size double"])
    return rows.select(*kept, F.col(vector).cast("array<double>").alias("__v")).mapInArrow(run, ddl)


def write_cells(rows: DataFrame, path: str, *, id_column: str, vector: str, cells: int, rounds: int = 10, seed: int = 1) -> None:
    """Store rows in folders of their cells, and of each cell its centre, how far from it and how long its vectors are at most."""
    spark = rows.sparkSession
    centres = kmeans(rows, id_column=id_column, vector=vector, k=cells, rounds=rounds, seed=seed)
    placed = assigned(rows, centres, vector=vector).where("cell is not null")
    placed.hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows")
    told = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>")
    stored = spark.read.schema(placed.schema).parquet(f"{path}/rows")
    bounds = stored.groupBy("cell").agg(F.max("away").alias("radius"), F.max("size").alias("longest"), F.min("size").alias("shortest"), F.count("*").alias("n"))
    told.join(bounds, "cell").coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")


def _promising(sent, least: str):
    """(q, v, cell) of the cells whose bound for a question reaches its column ``least``; without such a column the one of the greatest bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, centres, radius, longest, shortest = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            units, size = _units(batch.column("v"))
            angle = np.arccos(np.clip(units @ centres.T, -1, 1))
            cosine = np.cos(np.maximum(angle - radius - SLACK, 0))
            bound = size[:, None] * np.where(cosine > 0, longest, shortest) * cosine
            if least:
                row, cell = np.nonzero(bound >= batch.column(least).to_numpy(zero_copy_only=False)[:, None])
            else:
                row, cell = np.arange(batch.num_rows), bound.argmax(axis=1)
            taken = batch.select(["q", "v"]).take(pa.array(row))
            yield pa.record_batch([*taken.columns, pa.array(number[cell], pa.int32())], ["q", "v", "cell"])

    return run


def nearest(
    spark: SparkSession, path: str, queries: DataFrame, *, query_id: str, vector: str, order: tuple[str, ...], top_k: int = 5, digits: int = 6, row_vector: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """((query_id, score, rank, *order), (query_id, cell)): each question's top_k stored rows by dot product, exactly, and the cells that were read for it.

    First the most promising cell of each question is read, whose top_k-th score every other row
    has to reach; then the cells that may have such rows, by the angle between question and centre
    less the cell's radius, and the length of its vectors. Null vectors find nothing.
    """
    stored = spark.read.parquet(f"{path}/rows")
    cells = spark.read.parquet(f"{path}/cells").orderBy("cell").toArrow()
    asked = queries.select(F.col(query_id).alias("q"), F.col(vector).cast("array<double>").alias("v")).dropna()
    kind = queries.schema[query_id].dataType.simpleString()
    of_row = row_vector or vector
    bounds = (cells.column("cell").to_numpy(), retrieval._matrix(cells.column("centre").combine_chunks()), *(cells.column(c).to_numpy() for c in ("radius", "longest", "shortest")))
    sent = spark.sparkContext.broadcast(bounds)
    ddl = f"q {kind}, v array<double>, cell int"

    def found_in(pairs: DataFrame) -> DataFrame:
        return retrieval.top_k_of(stored, pairs, question_id="q", vector="v", row_vector=of_row, order=order, tenant="cell", row_tenant="cell", top_k=top_k, digits=digits)

    first = asked.mapInArrow(_promising(sent, ""), ddl)
    begun = found_in(first)
    reached = begun.groupBy("q").agg(F.when(F.count("*") >= top_k, F.min("score")).alias("least"))
    limit = F.coalesce(F.col("least") - 10.0**-digits, F.lit(-math.inf))
    more = asked.join(reached, "q", "left").select("q", "v", limit.alias("least")).mapInArrow(_promising(sent, "least"), ddl)
    rest = more.join(first.select("q", "cell"), ["q", "cell"], "left_anti").select("q", "v", "cell")
    every = reduce(DataFrame.unionByName, [begun, found_in(rest)])
    best = every.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), *order))).where(F.col("rank") <= top_k)
    visited = first.select("q", "cell").unionByName(rest.select("q", "cell"))
    return best.select(F.col("q").alias(query_id), "score", "rank", *order), visited.withColumnRenamed("q", query_id)
