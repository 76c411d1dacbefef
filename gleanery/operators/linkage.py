"""Complete linkage inside components, cosine neighbours by blocks, and the diameter of chains."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.operators.components import connected_components
from gleanery.session import staged

#: Distinct points of a component up to which linkage is complete; the matrix of their distances is held in one task.
MOST = 4000


def complete_linkage(distance: np.ndarray, below: float) -> np.ndarray:
    """Each member's cluster (its smallest member) after merging clusters whose farthest members are nearer than `below`.

    Nearest-neighbour chains: complete linkage is reducible, so following nearest clusters until two choose each other gives
    the tree of greedy merging in quadratic time. Ties go to the chain's previous cluster, then to the smaller index.
    """
    n = len(distance)
    d = distance.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    alive, merges, chain = np.ones(n, bool), [], []
    for _ in range(n - 1):
        if not chain:
            chain.append(int(np.flatnonzero(alive)[0]))
        while True:
            a = chain[-1]
            row = np.where(alive, d[a], np.inf)
            b = int(row.argmin())
            if len(chain) > 1 and row[chain[-2]] <= row[b]:
                b = chain[-2]
            if len(chain) > 1 and b == chain[-2]:
                break
            chain.append(b)
        a, b = sorted((chain.pop(), chain.pop()))
        merges.append((d[a, b], a, b))
        far = np.maximum(d[a], d[b])
        far[a] = np.inf
        d[a], d[:, a] = far, far
        alive[b] = False
    label = np.arange(n)
    for height, a, b in sorted(merges):
        if height < below:
            ra, rb = label[a], label[b]
            label[label == max(ra, rb)] = min(ra, rb)
    return label


SCHEMA = "id long, cluster_id long, linkage string"


def _in_components(points: DataFrame, pairs: DataFrame, below: float, payload: str, distance: Callable[[pd.DataFrame], np.ndarray], most: int) -> DataFrame:
    """(id, cluster_id, linkage) of points (id, same, payload): complete linkage inside each component of pairs.

    Points of equal `same` can't be told apart and are one. A component of over `most` distinct points is counted before anything is
    gathered, never sent to a task, and stays whole: its linkage is "single".
    """
    heads = points.groupBy("same").agg(F.min("id").alias("head"))
    of = staged(points.select("id", "same").join(heads, "same").select("id", "head"), "heads")
    side = lambda c: of.select(F.col("id").alias(c), F.col("head").alias(f"{c}h"))
    linked = pairs.join(side("i"), "i").join(side("j"), "j").where("ih <> jh").select("ih", "jh").distinct()
    found = staged(connected_components(linked, "ih", "jh"), "components")
    large = found.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") > most).select("component")
    reps = points.join(of.where("id = head").select("id"), "id").select("id", payload)

    def cluster(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id").reset_index(drop=True)
        ids = group["id"].to_numpy()
        return pd.DataFrame({"id": ids, "cluster_id": ids[complete_linkage(distance(group), below)], "linkage": "complete"})

    tied = reps.join(found.join(large, "component", "left_anti").withColumnRenamed("node", "id"), "id").groupBy("component").applyInPandas(cluster, SCHEMA)
    single = found.join(large, "component").select(F.col("node").alias("id"), F.col("component").alias("cluster_id"), F.lit("single").alias("linkage"))
    alone = of.where("id = head").join(found, F.col("id") == F.col("node"), "left_anti").select("id", F.col("id").alias("cluster_id"), F.lit("complete").alias("linkage"))
    every = tied.unionByName(single).unionByName(alone).withColumnRenamed("id", "head")
    return of.join(every, "head").select("id", "cluster_id", "linkage")


def near_clusters(signatures: DataFrame, pairs: DataFrame, threshold: float, most: int = MOST) -> DataFrame:
    """Complete linkage on 1 - agreement over signatures (id, sig, same): clusters whose members all agree in over threshold."""

    def distance(g: pd.DataFrame) -> np.ndarray:
        sig = np.stack(g["sig"].to_numpy())
        return 1 - np.stack([(sig == s).mean(axis=1) for s in sig])

    return _in_components(signatures, pairs, 1 - threshold, "sig", distance, most)


def semantic_clusters(vectors: DataFrame, pairs: DataFrame, threshold: float, most: int = MOST) -> DataFrame:
    """The same over vectors (id, vec, same) and cosines."""

    def distance(g: pd.DataFrame) -> np.ndarray:
        v = np.stack(g["vec"].to_numpy()).astype(float)
        return 1 - v @ v.T

    return _in_components(vectors, pairs, 1 - threshold, "vec", distance, most)


def graph_figures(points: DataFrame, pairs: DataFrame, by: str, most: int = MOST) -> DataFrame:
    """(by, edges, components, oversized): the graph of pairs over points (id, by, same); oversized lists the sizes of components whose distinct points exceed `most`."""
    of = points.select(F.col("id"), F.col(by))
    edges = pairs.join(of.withColumnRenamed("id", "i"), "i").groupBy(by).agg(F.count("*").alias("edges"))
    found = connected_components(pairs, "i", "j")
    rooted = points.join(found, F.col("id") == F.col("node"), "left").withColumn("component", F.coalesce("component", "id"))
    sizes = rooted.groupBy(by, "component").agg(F.count("*").alias("n"), F.count_distinct("same").alias("points"))
    figures = sizes.groupBy(by).agg(F.count("*").alias("components"), F.sort_array(F.collect_list(F.when(F.col("points") > most, F.col("n")))).alias("oversized"))
    return figures.join(edges, by, "left").select(by, F.coalesce("edges", F.lit(0)).alias("edges"), "components", "oversized")


def cosine_pairs(vectors: DataFrame, threshold: float, block: int = 2048, by: str | None = None) -> DataFrame:
    """(i, j, score), i < j, of unit vectors (id, vec) whose dot product reaches the threshold; with `by`, only within equal values of it.

    Every pair has to be compared: rows are dealt to blocks, each block goes to the tasks of the pairs of blocks that it is in, and
    a task is one matrix product. What a task holds is bounded; the number of tasks grows with the square of the blocks.
    """
    rows = vectors.select("id", F.col("vec").cast("array<double>").alias("vec"), (F.col(by).cast("string") if by else F.lit("")).alias("g"))
    counts = rows.groupBy(F.col("g").alias("of")).agg(F.ceil(F.count("*") / block).cast("long").alias("n"))
    dealt = rows.join(counts, F.col("g").eqNullSafe(F.col("of"))).select("id", "vec", "g", "n", F.pmod(F.xxhash64("id"), "n").alias("b"))
    copies = dealt.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).select("id", "vec", "g", "b", F.least("b", "o").alias("p"), F.greatest("b", "o").alias("q"))

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        _, p, q = key
        x, y = g[g["b"] == p], g[g["b"] == q]
        if not len(x) or not len(y):
            return pd.DataFrame({"i": [], "j": [], "score": []})
        s = np.stack(x["vec"].to_numpy()) @ np.stack(y["vec"].to_numpy()).T
        a, b = np.nonzero(s >= threshold)
        i, j, score = x["id"].to_numpy()[a], y["id"].to_numpy()[b], s[a, b]
        keep = i < j if p == q else i != j
        return pd.DataFrame({"i": np.minimum(i, j)[keep], "j": np.maximum(i, j)[keep], "score": score[keep]})

    return copies.groupBy("g", "p", "q").applyInPandas(run, "i long, j long, score double")


def chain_diameters(clusters: DataFrame, pairs: DataFrame, top: int = 40, sources: int = 64) -> DataFrame:
    """(cluster_id, size, diameter): the longest shortest path from `sources` members, for the `top` largest clusters of 3 or more."""
    sizes = clusters.groupBy("cluster_id").agg(F.count("*").alias("size")).where("size >= 3").orderBy(F.desc("size"), "cluster_id").limit(top)
    edges = pairs.join(clusters.select(F.col("id").alias("i"), "cluster_id"), "i").join(sizes, "cluster_id")

    def run(g: pd.DataFrame) -> pd.DataFrame:
        links = defaultdict(set)
        for i, j in zip(g["i"], g["j"], strict=True):
            links[i].add(j)
            links[j].add(i)
        most = 0
        for start in sorted(links)[:sources]:
            seen, front, steps = {start}, {start}, -1
            while front:
                front = {b for a in front for b in links[a]} - seen
                seen |= front
                steps += 1
            most = max(most, steps)
        return pd.DataFrame({"cluster_id": [g["cluster_id"].iloc[0]], "size": [g["size"].iloc[0]], "diameter": [most]})

    return edges.groupBy("cluster_id").applyInPandas(run, "cluster_id long, size long, diameter long")
