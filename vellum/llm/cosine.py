"""Embedding near-duplicates: int8 tile products with error bounds, then full precision.

A unit vector is its int8 image plus a remainder whose length is known. For two vectors
u, v with images a, b:  |u.v - a.b| <= |u - a| |b| + |v - b|,  so a tile's integer products
tell which pairs may reach the threshold; only those are computed in double precision.
Tiles hold vectors of one label, and a task sees two of them, whatever the label's size.
Equal vectors are compared once. A task gives each vector's number of links, and a forest
that connects what it found linked: never all pairs of a group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import join_many, staged, table
from .components import components

#: Vectors of a tile, about.
TILE = 4096
#: Rows of a tile that are multiplied at a time; pairs that are verified at a time.
ROWS, PAIRS = 512, 1 << 16
#: More than double precision can be off in a sum of products of unit vectors.
SLACK = 1e-9


def _images(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 images, their scales, lengths of the images, lengths of the remainders."""
    unit = v / np.sqrt((v * v).sum(axis=1))[:, None]
    scale = np.abs(unit).max(axis=1) / 127
    q = np.rint(unit / scale[:, None]).astype(np.int8)
    image = q * scale[:, None]
    return q, scale, np.sqrt((image * image).sum(axis=1)), np.sqrt(((unit - image) ** 2).sum(axis=1))


def linked_pairs(a: np.ndarray, b: np.ndarray, least: float):
    """(i, j) arrays of the pairs with cosine of a[i] and b[j] at least `least`."""
    qa, sa, la, ra = _images(a)
    qb, sb, lb, rb = _images(b)
    # products of int8 are whole numbers: single precision holds their sums exactly up to 2**24
    kind = np.float32 if a.shape[1] * 127 * 127 < 1 << 24 else np.float64
    right = qb.astype(kind).T
    na, nb = np.sqrt((a * a).sum(axis=1)), np.sqrt((b * b).sum(axis=1))
    for at in range(0, len(a), ROWS):
        rows = slice(at, at + ROWS)
        near = (qa[rows].astype(kind) @ right).astype(np.float64)
        near *= sa[rows, None]
        near *= sb[None]
        near += ra[rows, None] * lb[None]
        near += rb[None] + SLACK
        i, j = np.nonzero(near >= least)
        i += at
        for p in range(0, len(i), PAIRS):
            x, y = i[p : p + PAIRS], j[p : p + PAIRS]
            hit = np.einsum("ij,ij->i", a[x], b[y]) / (na[x] * nb[y]) >= least
            yield x[hit], y[hit]


def _tile_links(least: float):
    def run(key: tuple, tab: pa.Table) -> pa.Table:
        s, t = key[2].as_py(), key[3].as_py()
        own = tab.column("own").to_numpy()
        cid, weight = tab.column("cid").to_numpy(), tab.column("n").to_numpy()
        flat = tab.column("embedding").combine_chunks()
        v = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)
        v = v / np.abs(v).max(axis=1)[:, None]  # no overflow of squares; the cosine stays
        left = np.flatnonzero(own == s)
        right = left if s == t else np.flatnonzero(own == t)
        count, root = np.zeros(len(cid), np.int64), np.arange(len(cid))
        for x, y in linked_pairs(v[left], v[right], least):
            x, y = left[x], right[y]
            if s == t:
                x, y = x[x != y], y[x != y]
                np.add.at(count, x, weight[y])  # a tile with itself gives each pair both ways
            else:
                np.add.at(count, x, weight[y])
                np.add.at(count, y, weight[x])
            while len(x):
                np.minimum.at(root, x, root[y])
                np.minimum.at(root, y, root[x])
                root = root[root]
                on = root[x] != root[y]
                # tie the roots themselves, so that what hangs on them follows
                hi, lo = np.maximum(root[x], root[y])[on], np.minimum(root[x], root[y])[on]
                np.minimum.at(root, hi, lo)
                x, y = x[on], y[on]
        while not np.array_equal(root[root], root):
            root = root[root]
        out = np.flatnonzero(count)
        return pa.table({"cid": cid[out], "links": count[out], "root": cid[root[out]]})

    return run


def near_duplicates(df: DataFrame, least: float = 0.98, tile: int = TILE, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per input row.

    Rows with equal labels whose cosine is at least `least` (above 0) are linked. A null
    label, and a vector that is null, empty, all zero or holds null or non-finite
    components, links with nothing; vectors of different lengths do not link. Repeated rows
    are vectors of their own: they link, and share vec_id and component. A null vec_id keeps
    its row and never names a component; its kept is false. An empty table gives no rows.
    """
    if not least > 0:
        raise ValueError("the threshold must be above 0")
    v = F.col("embedding")
    fit = F.col("label").isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = df.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("embedding")).withColumn("fit", F.coalesce(fit, F.lit(False)))
    rows = rows.withColumn("h", F.xxhash64("embedding"))
    good = rows.filter("fit")
    kinds = good.groupBy("label", "h", "embedding").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("rep"))
    kinds = staged(kinds.withColumn("dims", F.size("embedding")).withColumn("cid", F.monotonically_increasing_id()), "cosine-kinds")

    sizes = kinds.groupBy("label", "dims").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("nt"))
    dealt = kinds.join(staged(sizes, "cosine-sizes"), ["label", "dims"]).withColumn("own", F.pmod(F.xxhash64("cid"), F.col("nt")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nt") - 1)))
    dealt = dealt.select("label", "dims", F.least("own", "other").alias("s"), F.greatest("own", "other").alias("t"), "own", "cid", "n", "embedding")
    found = staged(dealt.groupBy("label", "dims", "s", "t").applyInArrow(_tile_links(least), "cid long, links long, root long"), "cosine-links")

    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("cid").alias("u"), F.col("root").alias("v")))
    named = staged(joined.join(kinds.select(F.col("cid").alias("node"), "rep"), "node"), "cosine-members")
    least = staged(named.groupBy("root").agg(F.min("rep").alias("component_id"), F.count(F.lit(1)).alias("c")), "cosine-least")
    named = join_many(named, least, ["root"], "c").select(F.col("node").alias("cid"), "component_id")
    kinds = kinds.join(links, "cid", "left").join(named, "cid", "left")
    kinds = kinds.select("label", "h", "embedding", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"))
    out = join_many(good, staged(kinds, "cosine-named"), ["label", "h", "embedding"], "n").select("vec_id", "n_links", "component_id")
    rest = rows.filter("not fit").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op4_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates among `embeddings`: vec_id, n_links, component_id, kept."""
    return near_duplicates(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))


OP4_SQL = """
with recursive g as (
  select vec_id, label, embedding::double[] as e from embeddings
  where label is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0
), l as (
  select a.vec_id as u, b.vec_id as v from g a join g b on a.label = b.label and a.vec_id <> b.vec_id
  where list_inner_product(a.e, b.e) / sqrt(list_inner_product(a.e, a.e) * list_inner_product(b.e, b.e)) >= 0.98
), r as (
  select vec_id as u, vec_id as v from embeddings
  union
  select r.u, l.v from r join l on r.v = l.u
)
select e.vec_id, coalesce(n.n, 0)::bigint as n_links, c.m as component_id, e.vec_id = c.m as kept
from embeddings e
left join (select u, count(*) as n from l group by u) n on n.u = e.vec_id
join (select u, min(v) as m from r group by u) c on c.u = e.vec_id
"""
