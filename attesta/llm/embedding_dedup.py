"""Embedding near-duplicates: a subspace pigeonhole join, exact at the cosine threshold.

For unit vectors cosine >= c is squared distance <= 2 - 2c. Vectors are turned by a fixed random rotation and split into
blocks of BLOCK coordinates; of the squared-distance budget a block gets its share of the dimensions, so a linked
pair keeps within budget in at least one block. Each block is range-joined: its first coordinate is cut into slabs
as wide as the block's radius, pairs of one slab or of neighbours are compared in the block's coordinates, and the
union of candidates is verified by the cosine of the original vectors in double precision. A pair found in several blocks
counts in the first one within budget only.

Identical vectors collapse first. Slabs above CHUNK vectors are cut and every pair of chunks is a task of its own. Tasks
return link counts and a spanning forest of their links, never the pairs. The exact join compares a fixed share of all pairs
when vectors have no structure; it is quadratic there, like any exact method.

Defined cases: vectors that are null, empty, zero, or hold null, infinite or NaN components, and rows with a null id, link
with nothing (their component is themselves); vectors of different lengths do not link; every row is a
vector, so repeated rows link with each other, and rows that share an id each link by their own vector (the smallest id
reachable may then be that of another row); other columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.components import components, local_labels
from attesta.llm.shared import Scratch
from attesta.llm.textarrays import lean

BLOCK, CHUNK, TILE = 16, 8192, 1024
SLACK = 1e-9


@lru_cache(4)
def rotation(dims: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(5).standard_normal((dims, dims)))[0]


def cuts(dims: int) -> list[tuple[int, int]]:
    return [(a, min(a + BLOCK, dims)) for a in range(0, dims, BLOCK)]


def radius(dims: int, a: int, b: int, cosine: float) -> float:
    return float(np.sqrt((2 - 2 * cosine) * (b - a) / dims + SLACK)) * (1 + 1e-9)


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow in the square
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _matrix(col: pa.Array) -> np.ndarray:
    return np.stack([np.asarray(v.values.to_numpy(zero_copy_only=False)) for v in col]) if len(col) else np.zeros((0, 1))


def _slabs(cosine: float):
    """The slab of each block; rows of one batch may differ in length."""

    def run(batches):
        for b in batches:
            sizes = np.array([len(v) for v in b.column("embedding")], np.int64)
            out: list = [None] * b.num_rows
            for dims in np.unique(sizes):
                at = np.flatnonzero(sizes == dims)
                x = unit(_matrix(b.column("embedding").take(pa.array(at))))
                first = x @ rotation(int(dims))[:, [a for a, _ in cuts(int(dims))]]
                r = np.array([radius(int(dims), a, e, cosine) for a, e in cuts(int(dims))])
                for i, s in zip(at, np.floor(first / r).astype(np.int64)):
                    out[i] = s.tolist()
            yield pa.RecordBatch.from_arrays([b.column("rep"), b.column("m"), b.column("embedding"), pa.array(sizes), pa.array(out, pa.list_(pa.int64()))], names=["rep", "m", "embedding", "dims", "slabs"])

    return run


def sides(bx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Single-precision factors whose product is the squared distance of each pair."""
    n, one = (bx * bx).sum(1, keepdims=True), np.ones((len(bx), 1))
    return np.hstack([-2 * bx, n, one]).astype(np.float32), np.hstack([bx, one, n]).astype(np.float32)


def tile_links(near: np.ndarray, x: np.ndarray, y: np.ndarray, bx: np.ndarray, by: np.ndarray, block: int, dims: int, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Verified pairs of a tile that belong to this block: near squared distances in the block, x, y unit vectors, bx, by rotated ones."""
    spans = cuts(dims)
    budgets = [(2 - 2 * cosine) * (e - a) / dims + SLACK for a, e in spans]
    # far more than single precision may err; the exact sums below decide
    at = np.flatnonzero(near <= np.float32(budgets[block] + 1e-5))
    i, j = at // near.shape[1], at % near.shape[1]
    if not len(i):
        return i, j
    if len(i) > 0.05 * near.size:
        ok = (x @ y.T)[i, j] >= cosine - 1e-12
        i, j = i[ok], j[ok]
    keep = [np.zeros(0, np.int64)]
    for s in range(0, len(i), 50_000):
        p, q = i[s : s + 50_000], j[s : s + 50_000]
        ok = np.einsum("ij,ij->i", x[p], y[q]) >= cosine
        p, q, at = p[ok], q[ok], np.flatnonzero(ok)
        square = (bx[p] - by[q]) ** 2
        owner = np.full(len(p), len(spans))
        for k in range(block, -1, -1):
            a, e = spans[k]
            owner[square[:, a:e].sum(1) <= budgets[k]] = k
        keep.append(s + at[owner == block])
    keep = np.concatenate(keep)
    return i[keep], j[keep]


_OUT = pa.schema([("kind", pa.int32()), ("u", pa.int64()), ("v", pa.int64())])


def _join(cosine: float):
    @lean
    def run(table: pa.Table) -> pa.Table:
        block, dims = table.column("block")[0].as_py(), table.column("dims")[0].as_py()
        side = table.column("side").to_numpy()
        rep, m = table.column("rep").to_numpy(), table.column("m").to_numpy()
        order = np.lexsort((rep, side))
        rep, m, side = rep[order], m[order], side[order]
        x = unit(_matrix(table.column("embedding").combine_chunks().take(pa.array(order))))
        bx = x @ rotation(dims)[:, : cuts(dims)[block][1]]
        n = int((side == 0).sum())
        apart = n < len(side)  # two chunks; otherwise one with itself
        left, right = sides(bx[:, slice(*cuts(dims)[block])])
        links, label = np.zeros(len(rep), np.int64), np.arange(len(rep))
        for a in range(0, n, TILE):
            ends = range(n, len(rep), TILE) if apart else range(a, n, TILE)
            for c in ends:
                p, q = slice(a, min(a + TILE, n)), slice(c, min(c + TILE, len(rep) if apart else n))
                i, j = tile_links(left[p] @ right[q].T, x[p], x[q], bx[p], bx[q], block, dims, cosine)
                i, j = i + a, j + c
                if not apart:
                    i, j = i[i < j], j[i < j]
                if len(i):
                    np.add.at(links, i, m[j])
                    np.add.at(links, j, m[i])
                    u, v = label[i], label[j]
                    if (u != v).any():
                        pair = np.unique(np.stack([u, v], 1)[u != v], axis=0)
                        label = local_labels(len(rep), pair[:, 0], pair[:, 1])[label]
        some, moved = np.flatnonzero(links), np.flatnonzero(label != np.arange(len(rep)))
        return pa.table([np.r_[np.zeros(len(some), np.int32), np.ones(len(moved), np.int32)], np.r_[rep[some], rep[moved]], np.r_[links[some], rep[label[moved]]]], schema=_OUT)

    return run


def embedding_near_dedup(vectors: DataFrame, cosine: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding", chunk: int = CHUNK) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row."""
    scratch = Scratch(vectors.sparkSession, "embedding")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("embedding"))
    huge = F.lit(float("inf"))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < huge)) & F.exists("embedding", lambda x: x != 0)
    rows = rows.withColumn("ok", F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(fine, F.lit(False)))
    # a class is a distinct vector under a hash of its components; ids come in at the end, as rows may share one
    classes = rows.where("ok").groupBy("embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("m"))
    classes = scratch.table(classes.withColumn("rep", F.xxhash64("embedding")), "classes")
    kind = dict(classes.dtypes)["embedding"]
    slabs = classes.select("rep", "m", "embedding").mapInArrow(_slabs(cosine), f"rep long, m long, embedding {kind}, dims long, slabs array<long>")
    cells = scratch.table(slabs.select("rep", "m", "embedding", "dims", F.posexplode("slabs").alias("block", "slab")), "cells")
    # a row for each slab of each block: the cube's width over the radius bounds their number, whatever the table's size
    sizes = cells.groupBy("dims", "block", "slab").agg(F.ceil(F.count("*") / chunk).cast("int").alias("k"))
    sizes = scratch.table(sizes, "sizes")
    key = ["dims", "block", "slab"]
    near = sizes.join(sizes.select("dims", "block", (F.col("slab") + 1).alias("slab"), F.col("k").alias("below")), key, "left").join(sizes.select("dims", "block", (F.col("slab") - 1).alias("slab"), F.col("k").alias("above")), key, "left")
    cells = cells.join(F.broadcast(near), key).withColumn("c", F.pmod(F.xxhash64("rep", "block"), F.col("k")).cast("int"))
    task = lambda slab, guest, i, j, side: F.struct(slab.cast("long").alias("slab"), F.lit(guest).alias("guest"), i.cast("int").alias("i"), j.cast("int").alias("j"), side.cast("int").alias("side"))
    zero, one = F.lit(0), F.lit(1)
    # side 0 and 1 are the two chunks; a chunk with itself has side 0 alone
    own = F.transform(F.sequence(zero, F.col("k") - 1), lambda o: task(F.col("slab"), False, F.least("c", o), F.greatest("c", o), F.when(F.col("c") <= o, 0).otherwise(1)))
    empty = F.array().cast("array<struct<slab:bigint,guest:boolean,i:int,j:int,side:int>>")
    host = F.when(F.col("below").isNotNull(), F.transform(F.sequence(zero, F.col("below") - 1), lambda o: task(F.col("slab"), True, F.col("c"), o, zero))).otherwise(empty)
    guest = F.when(F.col("above").isNotNull(), F.transform(F.sequence(zero, F.col("above") - 1), lambda o: task(F.col("slab") + 1, True, o, F.col("c"), one))).otherwise(empty)
    units = cells.select("rep", "m", "embedding", "dims", "block", F.explode(F.concat(own, host, guest)).alias("t")).select("rep", "m", "embedding", "dims", "block", "t.*")
    found = scratch.table(units.groupBy("dims", "block", "slab", "guest", "i", "j").applyInArrow(_join(cosine), "kind int, u long, v long"), "found")
    links = found.where("kind = 0").groupBy(F.col("u").alias("rep")).agg(F.sum("v").alias("links"))
    comp = scratch.table(components(found.where("kind = 1").select("u", "v"), scratch), "components")
    lowest = comp.join(classes, F.col("node") == F.col("rep")).groupBy("component").agg(F.min("least").alias("lowest"))
    comp = comp.join(lowest, "component").select("node", "lowest")
    of = classes.join(links, "rep", "left").join(comp, F.col("rep") == F.col("node"), "left")
    of = of.select("embedding", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("lowest", "least").alias("component_id"))
    good = rows.where("ok").select("vec_id", "embedding").join(of, "embedding").select("vec_id", "n_links", "component_id")
    bad = rows.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.union(bad).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op8_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    return embedding_near_dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP8_SQL = """
WITH RECURSIVE e AS (
  SELECT vec_id, [x::DOUBLE for x in embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM e a JOIN e b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.9),
reach(u, v) AS (SELECT u, v FROM link UNION SELECT r.u, l.v FROM reach r JOIN link l ON r.v = l.u),
n AS (SELECT u, count(*) AS c FROM link GROUP BY u),
m AS (SELECT u, min(v) AS c FROM reach GROUP BY u)
SELECT x.vec_id, coalesce(n.c, 0)::BIGINT AS n_links, least(x.vec_id, coalesce(m.c, x.vec_id)) AS component_id,
  x.vec_id = least(x.vec_id, coalesce(m.c, x.vec_id)) AS kept
FROM embeddings x LEFT JOIN n ON n.u = x.vec_id LEFT JOIN m ON m.u = x.vec_id
"""
