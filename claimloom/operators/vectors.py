"""Vectors: cosine search, linkage groups, medoids and density groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.scratch import Scratch

#: Vectors of a block in blocked products; a block of 64 floats is 0.5 MB.
BLOCK = 2000
#: Vectors that blocks are gathered around.
PIVOTS = 256
#: A vertex with at least 1/HOT_SHARE of all links (and HOT_LEAST) is hot: there are HOT_SHARE of them at most.
HOT_SHARE, HOT_LEAST = 400, 2000
#: Agglomeration and density clustering hold distances of one component; a larger one is refused, never cut short.
MOST_MEMBERS = 20_000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def blocks(vectors: DataFrame, size: int | None = None, pivots: np.ndarray | None = None) -> DataFrame:
    """Vectors ``(vec_id, embedding)`` packed into blocks ``(block, ids, flat)`` of about ``size`` rows; NULL vectors are left out.

    With ``pivots``, a block holds vectors whose nearest pivot is the same.
    """
    v, size = vectors.where("embedding is not null").select("vec_id", "embedding"), size or BLOCK
    if pivots is None:
        n = v.count()
        v = v.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(max(1, -(-n // size)))))
    else:
        shared = vectors.sparkSession.sparkContext.broadcast(pivots)

        @F.pandas_udf("int")
        def nearest_pivot(e: pd.Series) -> pd.Series:
            return pd.Series(np.argmax(np.stack(e).astype("float64") @ shared.value.T, axis=1).astype("int32"))

        v = Scratch(vectors.sparkSession, "pivots").cut(v.withColumn("pivot", nearest_pivot("embedding")), "v")
        parts = F.broadcast(v.groupBy("pivot").agg(F.ceil(F.count("*") / size).alias("parts")))  # one row a pivot
        v = v.join(parts, "pivot").withColumn("block", F.col("pivot") + F.lit(len(pivots)) * F.pmod(F.xxhash64("vec_id"), "parts"))
    return v.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))).alias("rows")).select("block", F.transform("rows", lambda r: r["vec_id"]).alias("ids"), F.flatten(F.transform("rows", lambda r: r["embedding"])).alias("flat"))


def similar_pairs(vectors: DataFrame, threshold: float) -> DataFrame:
    """``(a, b, cosine)``, a < b, of unit vectors with a cosine of at least ``threshold``: products of blocks of rows.

    Vectors are blocked by their nearest of up to PIVOTS vectors of the table.  Two blocks whose centres are further apart than
    the threshold and both radii allow hold no pair and never meet, which loses none; on vectors spread without any
    clusters that spares nothing, and all blocks meet.
    """
    scratch = Scratch(vectors.sparkSession, "blocks")
    # a pivot for each block there will be, so that small tables aren't cut to shreds
    n = min(PIVOTS, -(-vectors.where("embedding is not null").count() // BLOCK))
    some = vectors.where("embedding is not null").orderBy(F.xxhash64("vec_id"), "vec_id").limit(n).select("embedding").collect()
    if not some:
        return vectors.select(F.col("vec_id").alias("a"), F.col("vec_id").alias("b"), F.lit(0.0).alias("cosine")).where("false")
    b = scratch.cut(blocks(vectors, pivots=np.array([r["embedding"] for r in some], "float64")), "blocks")

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for r in rows.itertuples():
                x = np.asarray(r.flat, "float64").reshape(len(r.ids), -1)
                c = x.mean(axis=0)
                c /= max(1e-12, np.linalg.norm(c))
                out.append((r.block, c.tolist(), float(np.arccos(np.clip((x @ c).min(), -1, 1)))))
            yield pd.DataFrame(out, columns=["block", "centre", "radius"])

    shape = scratch.cut(b.mapInPandas(measure, "block long, centre array<double>, radius double"), "shapes")
    other = shape.toDF("block2", "centre2", "radius2")
    apart = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(F.col("centre"), F.col("centre2"))))) - F.col("radius") - F.col("radius2")
    # blocks, not vectors, are paired here: rows of a centre and a radius
    meet = shape.join(other, F.col("block") <= F.col("block2")).where(apart <= float(np.arccos(np.clip(threshold, -1, 1))) + 1e-9).select("block", "block2")
    pairs = meet.join(b, "block").join(b.toDF("block2", "ids2", "flat2"), "block2")

    def product(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for r in rows.itertuples():
                x = np.asarray(r.flat, "float64").reshape(len(r.ids), -1)
                y = np.asarray(r.flat2, "float64").reshape(len(r.ids2), -1)
                s = x @ y.T
                i, j = np.nonzero(s >= threshold)
                left, right = np.asarray(r.ids)[i], np.asarray(r.ids2)[j]
                keep = left < right if r.block == r.block2 else np.ones(len(i), bool)
                yield pd.DataFrame({"a": np.minimum(left, right)[keep], "b": np.maximum(left, right)[keep], "cosine": s[i, j][keep]})

    return pairs.mapInPandas(product, "a long, b long, cosine double")


def top_matches(scores: DataFrame, top: int = 5, threshold: float = 0.0) -> DataFrame:
    """``(query, rank, id, ord, score)`` of ``(query, id, ord, score)``: the best entry per concept, then the best concepts; ties by ``ord``.

    Scores are compared as they are and rounded to four places afterwards.
    """
    one = Window.partitionBy("query", "id").orderBy(F.desc("score"), "ord")
    best = scores.where(F.col("score") >= threshold).withColumn("_k", F.row_number().over(one)).where("_k = 1")
    rank = Window.partitionBy("query").orderBy(F.desc("score"), "ord")
    return best.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= top).select("query", "rank", "id", "ord", (F.round("score", 4) + F.lit(0.0)).alias("score"))


def nearest(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """``(vec_id, rank, neighbour, cosine)``: the k nearest of all vectors for each query vector, itself left out.

    Queries travel in blocks against blocks of all vectors; each product keeps
    k candidates per query, and the last step ranks them.
    """
    scratch = Scratch(vectors.sparkSession, "nearest")
    q = scratch.cut(blocks(queries), "q")
    v = scratch.cut(blocks(vectors), "v").select(F.col("block").alias("block2"), F.col("ids").alias("ids2"), F.col("flat").alias("flat2"))

    def product(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for r in rows.itertuples():
                x = np.asarray(r.flat, "float64").reshape(len(r.ids), -1)
                ids, ids2 = np.asarray(r.ids), np.asarray(r.ids2)
                s = x @ np.asarray(r.flat2, "float64").reshape(len(ids2), -1).T
                s[ids[:, None] == ids2[None, :]] = -np.inf
                m = min(k, s.shape[1])
                # ties at the edge by the least id
                order = np.lexsort((np.broadcast_to(ids2, s.shape), -np.round(s, 9)), axis=1)[:, :m]
                yield pd.DataFrame({"vec_id": np.repeat(ids, m), "neighbour": ids2[order].ravel(), "cosine": np.take_along_axis(s, order, 1).ravel()})

    got = q.join(v, F.lit(True)).mapInPandas(product, "vec_id long, neighbour long, cosine double").where("cosine > -2")
    rank = Window.partitionBy("vec_id").orderBy(F.desc(F.round("cosine", 9)), "neighbour")
    return got.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)


def _with_least(scratch: Scratch, rows: DataFrame, total: int) -> DataFrame:
    """Rows ``(u, v)`` with ``m``, the least of their u and its v's; a hot u gets it by a broadcast."""
    least = scratch.cut(rows.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("u", "m")), "least", most=F.max("n"))
    limit = max(HOT_LEAST, -(-total // HOT_SHARE))
    if (scratch.seen["most"] or 0) < limit:
        return rows.join(least.select("u", "m"), "u")
    hot = F.broadcast(least.where(F.col("n") >= limit).select("u", "m"))
    return rows.join(hot, "u").unionByName(rows.join(hot.select("u"), "u", "left_anti").join(least.select("u", "m"), "u"))


def min_label(pairs: DataFrame, vertices: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(v, group_id)``: least vertex of each component, by alternating large-star and small-star.

    Raises if ``max_rounds`` rounds, whose number grows with the logarithm of the vertices, don't suffice.
    """
    scratch = Scratch(pairs.sparkSession, "stars")
    state = {"n": F.count("*"), "x": F.bit_xor(F.xxhash64("u", "v"))}
    e = scratch.cut(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "e", **state)
    now = scratch.seen
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(scratch, both, 2 * now["n"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.cut(large, "large", n=F.count("*"))
        small = _with_least(scratch, large, scratch.seen["n"]).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        after = scratch.cut(small, "e", **state)
        scratch.drop(e, large)
        e, before, now = after, now, scratch.seen
        if before == now:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    of = e.groupBy("u").agg(F.min("v").alias("group_id"))
    return vertices.select(F.col("v")).distinct().join(of, F.col("u") == F.col("v"), "left").select("v", F.coalesce("group_id", "v").alias("group_id"))


def single_linkage(vectors: DataFrame, threshold: float) -> DataFrame:
    """``(vec_id, group_id)``: components of the graph of cosines of at least ``threshold``."""
    links = similar_pairs(vectors, threshold).select("a", "b")
    return min_label(links, vectors.select(F.col("vec_id").alias("v"))).withColumnRenamed("v", "vec_id")


def _agglomerate(x: np.ndarray, threshold: float, linkage: str) -> np.ndarray:
    """Average or complete linkage of one component, cut at cosine distance 1 - threshold; labels by least member.

    A chain of nearest neighbours ends in a pair that are each other's nearest, and such a pair may be
    merged at once, for neither linkage ever makes a merged cluster nearer than its parts were.  So the work
    is quadratic.  Ties go to the member before in the chain, then to the least cluster.
    """
    n = len(x)
    d = np.clip(1 - x @ x.T, 0, 2)
    np.fill_diagonal(d, np.inf)
    size, parent, alive = np.ones(n), np.arange(n), np.ones(n, bool)
    chain: list[int] = []
    while True:
        if not chain:
            rest = np.flatnonzero(alive)
            if not len(rest):
                break
            chain = [int(rest[0])]
        i = chain[-1]
        j = int(np.argmin(d[i]))
        if len(chain) > 1 and d[i, chain[-2]] <= d[i, j]:
            j = chain[-2]
        if not d[i, j] <= 1 - threshold + 1e-12:
            # nothing is near enough: this cluster is done, and so is no other, unless it is apart, too
            alive[i] = False
            d[i], d[:, i] = np.inf, np.inf
            chain.pop()
            continue
        if len(chain) < 2 or j != chain[-2]:
            chain.append(j)
            continue
        chain = chain[:-2]
        i, j = min(i, j), max(i, j)
        merged = np.maximum(d[i], d[j]) if linkage == "complete" else (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        merged[[i, j]] = np.inf
        d[i], d[:, i] = merged, merged
        d[j], d[:, j] = np.inf, np.inf
        size[i] += size[j]
        alive[j], parent[j] = False, i
    for k in range(n):  # a cluster's name is less than those of the clusters merged into it
        parent[k] = parent[parent[k]]
    return parent


def pairwise_grouping(vectors: DataFrame, threshold: float = 0.69, linkage: str = "average") -> DataFrame:
    """``(vec_id, group_id)`` by single, average or complete linkage; the group id is the least member.

    Average and complete linkage never join two single-linkage components, so
    each component is agglomerated by itself.
    """
    if linkage not in ("single", "average", "complete"):
        raise ValueError(f"unknown linkage {linkage!r}; choose single, average or complete")
    single = single_linkage(vectors, threshold)
    if linkage == "single":
        return single

    def one(g: pd.DataFrame) -> pd.DataFrame:
        if len(g) > MOST_MEMBERS:
            raise ValueError(f"a component of {len(g)} vectors is too large for {linkage} linkage; raise the threshold")
        g = g.sort_values("vec_id", ignore_index=True)
        ids = g["vec_id"].to_numpy()
        return pd.DataFrame({"vec_id": ids, "group_id": ids[_agglomerate(np.stack(g["embedding"]).astype("float64"), threshold, linkage)]})

    return vectors.join(single, "vec_id").groupBy("group_id").applyInPandas(one, "vec_id long, group_id long")


def medoids(vectors: DataFrame, groups: DataFrame) -> DataFrame:
    """``(group_id, size, central_id)``: the member with the largest mean cosine to its group, ties to the least id.

    The sum of the group's vectors stands in for all pairs.
    """
    m = vectors.join(groups, "vec_id")
    sums = m.select("group_id", F.posexplode("embedding").alias("pos", "x")).groupBy("group_id", "pos").agg(F.sum(F.col("x").cast("double")).alias("s"))
    part = m.select("group_id", "vec_id", F.posexplode("embedding").alias("pos", "x")).join(sums, ["group_id", "pos"]).groupBy("group_id", "vec_id").agg(F.sum(F.col("x").cast("double") * F.col("s")).alias("score"))
    return part.groupBy("group_id").agg(F.count("*").alias("size"), F.min(F.struct((-F.round("score", 6)).alias("neg"), "vec_id"))["vec_id"].alias("central_id"))


def density_labels(x: np.ndarray, min_cluster_size: int = 2, min_samples: int = 2) -> np.ndarray:
    """Hierarchical density clusters (excess of mass) of unit vectors; -1 is noise.  Needs all distances of its rows."""
    n = len(x)
    if n < min_cluster_size:
        return np.full(n, -1)
    d = np.sqrt(np.maximum(0, 2 - 2 * (x @ x.T)))
    np.fill_diagonal(d, 0)
    core = np.sort(d, axis=1)[:, min(min_samples, n) - 1]
    reach = np.maximum(d, np.maximum(core[:, None], core[None, :]))
    inside, dist, come = np.zeros(n, bool), np.full(n, np.inf), np.zeros(n, int)
    inside[0], edges = True, []
    dist = reach[0].copy()
    dist[0] = np.inf
    for _ in range(n - 1):
        j = int(np.argmin(np.where(inside, np.inf, dist)))
        edges.append((dist[j], come[j], j))
        inside[j] = True
        closer = (reach[j] < dist) & ~inside
        dist[closer], come[closer] = reach[j][closer], j
    # single-linkage tree: node n + k joins two nodes at its height
    parent, left, right, height, size = list(range(2 * n - 1)), {}, {}, {}, [1] * n + [0] * (n - 1)

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for k, (w, a, b) in enumerate(sorted(edges)):
        a, b, node = root(int(a)), root(int(b)), n + k
        left[node], right[node], height[node], size[node] = a, b, w, size[a] + size[b]
        parent[a] = parent[b] = node
    leaves: dict[int, list[int]] = {}

    def under(i: int) -> list[int]:
        out, stack = [], [i]
        while stack:
            u = stack.pop()
            if u < n:
                out.append(u)
            else:
                stack += [left[u], right[u]]
        return out

    # condensed tree, walked from the root; a cluster dies where it splits in two large ones
    clusters = [(2 * n - 2, 0.0, None)]
    stability, kids, members = {}, {}, {}
    at = 0
    while at < len(clusters):
        node, birth, _ = clusters[at]
        members[at], kids[at], total, u = under(node), [], 0.0, node
        while u >= n:
            lam = 1 / height[u] if height[u] > 0 else 1e12
            a, b = left[u], right[u]
            big = [c for c in (a, b) if size[c] >= min_cluster_size]
            if len(big) == 2:
                total += size[u] * (lam - birth)
                for c in big:
                    kids[at].append(len(clusters))
                    clusters.append((c, lam, at))
                break
            total += sum(size[c] for c in (a, b) if c not in big) * (lam - birth)
            if not big:
                break
            u = big[0]
        stability[at] = total
        at += 1
    chosen = set()
    for c in reversed(range(1, len(clusters))):
        below = sum(stability[k] for k in kids[c])
        if kids[c] and below > stability[c]:
            stability[c] = below
        else:
            stack = list(kids[c])
            while stack:
                k = stack.pop()
                chosen.discard(k)
                stack += kids[k]
            chosen.add(c)
    out = np.full(n, -1)
    for c in chosen:
        out[members[c]] = c
    del leaves
    return out


def density_grouping(vectors: DataFrame, link: float = 0.3, min_cluster_size: int = 2, min_samples: int = 2) -> DataFrame:
    """``(vec_id, group_id)`` by density, -1 for noise.

    The tree over all vectors needs all distances, so it is built for each component of cosines of at least
    ``link`` by itself: clusters that only hang together below ``link`` are never one cluster here, and
    the whole table is the root of one tree only if it is one component.  With ``link`` = -1 it always is, and the
    result is that of one tree (tests hold the two against each other).
    """
    parts = single_linkage(vectors, link)

    def one(g: pd.DataFrame) -> pd.DataFrame:
        if len(g) > MOST_MEMBERS:
            raise ValueError(f"a component of {len(g)} vectors is too large for density clustering; raise link")
        g = g.sort_values("vec_id", ignore_index=True)
        ids = g["vec_id"].to_numpy()
        lab = density_labels(np.stack(g["embedding"]).astype("float64"), min_cluster_size, min_samples)
        least = {k: ids[lab == k].min() for k in set(lab.tolist()) if k >= 0}
        return pd.DataFrame({"vec_id": ids, "group_id": [least.get(k, -1) for k in lab.tolist()]}).astype("int64")

    return vectors.join(parts, "vec_id").groupBy("group_id").applyInPandas(one, "vec_id long, group_id long")
