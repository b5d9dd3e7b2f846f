"""Approximate nearest neighbours: one small-world graph per shard, results of the shards merged.

Vectors are dealt to shards by a hash. A shard's graph is one row of the index: its ids, vectors and
neighbour arrays as flat binaries, written to the shared folder. Queries are dealt to blocks of
bounded size; every block meets every shard in a task of its own, which returns the block's nearest
candidates with their exact inner products, and a ranking per query merges them. The work for a
query grows with the logarithm of a shard's size times the number of shards.

The longest vectors of a shard are held apart from its graph and compared with every query.

Equal vectors are one node of the graph. Of each vector only its NEAREST + 1 smallest ids can ever
be among the NEAREST of a query (ties go to the smaller id, and the query's own row is left out), so
no more are kept; hot vectors are cut down in salted groups first.

Defined results: vectors that are NULL or empty, all zero, or hold a NULL or a number that isn't
finite take no part, nor do rows without vec_id. Vectors of another length are not compared with
each other. Rows that repeat id and vector count once. With fewer than NEAREST candidates all are
returned. An empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from flowlens.llm import hnsw
from flowlens.llm.tables import materialize

NEAREST = 20
BEAM = 200
SHARDS = 8  # at least
SHARD_ROWS = 6_000  # vectors of a shard, about: many small graphs under a narrow beam find more than few large ones
BLOCK_ROWS = 16_384  # queries of a block, about: every block reads the whole index
SALTS = 64

INDEX = "size int, shard int, starts array<bigint>, ids array<bigint>, vectors binary, nodes array<binary>, links array<binary>, apart binary"


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0)


def vectors_of(embeddings: DataFrame) -> DataFrame:
    """(vec_id, vector, size) of the rows that take part."""
    rows = embeddings.select(
        embeddings["vec_id"].cast("bigint").alias("vec_id"), embeddings["embedding"].cast("array<float>").alias("vector")
    )
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    return rows.withColumn("size", F.size("vector"))


def candidates(rows: DataFrame, nearest: int) -> DataFrame:
    """The rows with, for each vector, its nearest + 1 smallest ids only."""
    first = Window.partitionBy("vector", "salt").orderBy("vec_id")
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)))
    rows = rows.dropDuplicates(["vector", "salt", "vec_id"])
    rows = rows.withColumn("r", F.row_number().over(first)).where(F.col("r") <= nearest + 1).drop("r", "salt")
    second = Window.partitionBy("vector").orderBy("vec_id")
    return rows.withColumn("r", F.row_number().over(second)).where(F.col("r") <= nearest + 1).drop("r")


def _built(group: pd.DataFrame) -> pd.DataFrame:
    vectors = np.stack(group["vector"].to_numpy()).astype(np.float32)
    ids = group["vec_id"].to_numpy()
    distinct, which = np.unique(vectors, axis=0, return_inverse=True)
    order = np.lexsort((ids, which.ravel()))
    starts = np.searchsorted(which.ravel()[order], np.arange(len(distinct) + 1))
    graph = hnsw.build(distinct, int(group["shard"].iloc[0]))
    return pd.DataFrame(
        {
            "size": [distinct.shape[1]], "shard": [group["shard"].iloc[0]], "starts": [starts.tolist()],
            "ids": [ids[order].tolist()], "vectors": [graph.vectors.tobytes()],
            "nodes": [[n.astype("<i4").tobytes() for n, _ in graph.levels]],
            "links": [[k.astype("<i4").tobytes() for _, k in graph.levels]],
            "apart": [graph.apart.astype("<i4").tobytes()],
        }
    )


def build_index(rows: DataFrame, shards: int) -> DataFrame:
    """One row per vector size and shard."""
    placed = rows.withColumn("shard", F.pmod(F.xxhash64("vector"), F.lit(shards)).cast("int"))
    return materialize(placed.groupBy("size", "shard").applyInPandas(_built, INDEX))


def _graph(row: pd.Series) -> hnsw.Graph:
    vectors = np.frombuffer(row["vectors"], np.float32).reshape(-1, row["size"] + hnsw.EXTRA)
    levels = []
    for nodes, links in zip(row["nodes"], row["links"]):
        nodes = np.frombuffer(nodes, "<i4").astype(np.int64)
        levels.append((nodes, np.frombuffer(links, "<i4").astype(np.int64).reshape(len(nodes), -1)))
    return hnsw.Graph(vectors, levels, np.frombuffer(row["apart"], "<i4").astype(np.int64))


FOUND = "query_id bigint, vec_id bigint, score double"


def _searching(nearest: int, beam: int):
    def run(index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(index) or not len(queries):
            return pd.DataFrame({"query_id": np.empty(0, np.int64), "vec_id": np.empty(0, np.int64), "score": np.empty(0)})
        row = index.iloc[0]
        graph, starts, ids = _graph(row), np.asarray(row["starts"]), np.asarray(row["ids"])
        asked = np.stack(queries["vector"].to_numpy()).astype(np.float32)
        own = queries["vec_id"].to_numpy()
        nodes = graph.search(asked, max(beam, nearest + 1), nearest + 1)
        original = graph.vectors[:, : -hnsw.EXTRA]
        out = []
        for i in range(len(asked)):
            near = np.concatenate([nodes[i][nodes[i] >= 0], graph.apart])
            # row by row, so that a score depends on the two vectors alone
            scores = (original[near].astype(np.float64) * asked[i].astype(np.float64)).sum(1)
            counts = starts[near + 1] - starts[near]
            found = np.concatenate([ids[starts[n] : starts[n + 1]] for n in near])
            score = np.repeat(scores, counts)
            mine = found != own[i]
            found, score = found[mine], score[mine]
            best = np.lexsort((found, -score))[:nearest]
            out.append((np.full(len(best), own[i]), found[best], score[best]))
        return pd.DataFrame(
            {name: np.concatenate([o[j] for o in out]) for j, name in enumerate(("query_id", "vec_id", "score"))}
        )

    return run


def search(index: DataFrame, queries: DataFrame, shards: int, nearest: int = NEAREST, beam: int = BEAM) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's nearest over all shards."""
    queries = materialize(queries.dropDuplicates(["vec_id", "vector"]))
    blocks = max(1, math.ceil(queries.count() / BLOCK_ROWS))
    asked = queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    spread = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    keys = ("size", "shard", "block")
    found = spread.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(_searching(nearest, beam), FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= nearest)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def nearest_neighbours(
    embeddings: DataFrame, every: int = 20, nearest: int = NEAREST, beam: int = BEAM, shard_rows: int = SHARD_ROWS
) -> DataFrame:
    """Searches all rows for the rows whose id is divisible by `every`."""
    rows = vectors_of(embeddings)
    kept = materialize(candidates(rows, nearest))
    shards = max(SHARDS, math.ceil(kept.count() / shard_rows))
    return search(build_index(kept, shards), rows.where(F.col("vec_id") % every == 0), shards, nearest, beam)
