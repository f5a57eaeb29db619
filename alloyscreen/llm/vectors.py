"""Near-duplicate embeddings by tile products of 8-bit quantised vectors with rigorous error bounds.

Unit vectors u are quantised to s * q with q from -127 to 127. With e = |u - s q|, the product of two vectors differs from that of their
quantised forms by at most e_v + (1 + e_v) e_u. Only pairs whose bound reaches the threshold are computed in double precision."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alloyscreen.llm.components import components
from alloyscreen.llm.folders import written

#: Vectors of a tile's side.
BLOCK = 2048


def quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """q (exact as float32, or as float64 for long vectors), s and e of unit rows; e is rounded up."""
    s = np.abs(unit).max(axis=1) / 127
    q = np.rint(unit / s[:, None])
    e = np.sqrt(((unit - s[:, None] * q) ** 2).sum(axis=1)) * (1 + 1e-9) + 1e-12
    return q.astype(np.float32 if unit.shape[1] <= 1000 else np.float64), s, e


def tile_links(x: np.ndarray, y: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """The places (i, j) of rows of x and y whose cosine in double precision reaches ``threshold``; i < j if both are the same."""
    norm_x, norm_y = np.sqrt((x * x).sum(axis=1)), np.sqrt((y * y).sum(axis=1))
    ux, uy = x / norm_x[:, None], y / norm_y[:, None]
    qx, sx, ex = quantised(ux)
    qy, sy, ey = quantised(uy)
    left, right = [], []
    for i in range(0, len(x), 256):
        product = (qx[i : i + 256] @ qy.T) * sx[i : i + 256, None] * sy[None, :]
        possible = product + (ey[None, :] + (1 + ey[None, :]) * ex[i : i + 256, None]) >= threshold - 1e-9
        if same:
            possible &= np.arange(i, i + len(product))[:, None] < np.arange(len(y))[None, :]
        a, b = np.nonzero(possible)
        for k in range(0, len(a), 1 << 16):
            c, d = a[k : k + (1 << 16)] + i, b[k : k + (1 << 16)]
            linked = np.einsum("ij,ij->i", ux[c], uy[d]) >= threshold
            left.append(c[linked])
            right.append(d[linked])
    return np.concatenate(left or [np.zeros(0, np.int64)]), np.concatenate(right or [np.zeros(0, np.int64)])


def in_range(v: Column) -> Column:
    """The vector times a power of two, where its components are so small or large that their squares leave the range of doubles. Its directions,
    and the cosines of all others, stay the same to the last bit."""
    most = F.array_max(F.transform(v, lambda x: F.abs(x)))
    factor = F.when(most < 1e-100, float(2**600)).when(most > 1e100, float(2**-600))
    return F.when(factor.isNull(), v).otherwise(F.transform(v, lambda x: x * factor))


def near_vectors(vectors: DataFrame, threshold: float = 0.98, block: int = BLOCK, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label") -> DataFrame:
    """vec_id, n_links (other vectors linked directly), component_id (smallest id reachable) and kept (vec_id = component_id).

    Vectors are linked if their labels are equal and not null, their lengths are equal and their cosine is at least ``threshold``.
    Vectors that are null, empty, zero or hold null or non-finite components link with nothing. Equal vectors of a label form a class that is
    compared once; its members get its links back. Classes fall into cells by two fixed orthonormal directions: linked unit
    vectors differ by at most sqrt(2 - 2 * threshold), so only neighbouring cells are compared. Cells are cut into blocks, and each pair of
    blocks is a tile, a task of bounded size that returns one row per vector: its number of links and the smallest vector
    that the tile links it with. Rows without id count as links but name no component: a component without any id is null,
    its rows are kept. Repeated rows are other vectors with the same id. Extra columns are not looked at."""
    own = vectors.select(
        F.col(f"`{id_column}`").cast("long").alias("vec_id"), F.col(f"`{vector_column}`").cast("array<double>").alias("v"), F.col(f"`{label_column}`").alias("label"),
    )
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    usable = F.col("label").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", bad) & F.exists("v", lambda x: x != 0)
    own = own.withColumn("node", F.when(F.coalesce(usable, F.lit(False)), F.xxhash64("label", "v")))
    classes = written(own.where("node IS NOT NULL").groupBy("node").agg(F.min("vec_id").alias("low"), F.count("*").alias("copies"), F.first("v").alias("v"), F.first("label").alias("label")).withColumn("v", in_range(F.col("v"))), "vectors")

    width = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-9
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    # two orthogonal directions for any length: the even places with signs from their number, and the odd ones
    sign = lambda i: F.when(F.pmod(F.xxhash64(i), F.lit(2)) == 0, 1.0).otherwise(-1.0)
    along = lambda odd: F.aggregate(F.transform("v", lambda x, i: F.when(F.pmod(i, F.lit(2)) == odd, x * sign(i)).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x)
    length = F.sqrt(F.greatest(F.lit(1.0), F.ceil(F.size("v") / 2)))
    cell = lambda odd: F.floor(along(odd) / F.col("norm") / length / width).cast("int")
    placed = classes.withColumn("norm", norm).select("node", "copies", "v", "label", F.size("v").alias("dim"), cell(0).alias("x"), cell(1).alias("y"))
    placed = placed.withColumn("group", F.xxhash64("label", "dim")).select("node", "copies", "v", "group", "x", "y")
    sizes = placed.groupBy("group", "x", "y").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    sizes = written(sizes, "cells")
    # the neighbours on one side, and the cell itself; the other side sees this one
    sides = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))])
    around = sizes.select("group", "x", "y", "blocks", F.explode(sides).alias("s")).select("group", "x", "y", "blocks", (F.col("x") + F.col("s.dx")).alias("x2"), (F.col("y") + F.col("s.dy")).alias("y2"))
    pairs = around.join(sizes.select("group", F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("blocks").alias("blocks2")), ["group", "x2", "y2"])
    pairs = pairs.select("group", "x", "y", "x2", "y2", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"), "blocks2")
    pairs = pairs.select("group", "x", "y", "x2", "y2", "i", F.explode(F.sequence(F.lit(0), F.col("blocks2") - 1)).alias("j"))
    pairs = pairs.where("x <> x2 OR y <> y2 OR i <= j").withColumn("tile", F.xxhash64("group", "x", "y", "x2", "y2", "i", "j"))
    same = (F.col("x") == F.col("x2")) & (F.col("y") == F.col("y2")) & (F.col("i") == F.col("j"))
    places = pairs.select("tile", "group", "x", "y", F.col("i").alias("block"), F.when(same, 0).otherwise(1).alias("side"))
    places = places.unionByName(pairs.where(~same).select("tile", "group", F.col("x2").alias("x"), F.col("y2").alias("y"), F.col("j").alias("block"), F.lit(2).alias("side")))
    places = places.groupBy("group", "x", "y", "block").agg(F.collect_list(F.struct("tile", "side")).alias("tiles"))
    blocks = placed.join(sizes, ["group", "x", "y"]).withColumn("block", F.pmod(F.xxhash64(F.lit(7), "node"), F.col("blocks")).cast("int"))
    dealt = blocks.join(places, ["group", "x", "y", "block"]).select("node", "copies", "v", F.explode("tiles").alias("t")).select("node", "copies", "v", "t.tile", "t.side")

    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        first = pdf[pdf.side <= 1]
        second = first if (first.side == 0).all() else pdf[pdf.side == 2]
        one = second is first
        if not len(first) or not len(second):
            return pd.DataFrame({"node": [], "n": [], "least": []}).astype("int64")
        a, b = tile_links(np.stack(first.v.to_list()), np.stack(second.v.to_list()), threshold, one)
        shift = 0 if one else len(first)
        nodes = first.node.to_numpy() if one else np.concatenate([first.node.to_numpy(), second.node.to_numpy()])
        copies = first.copies.to_numpy() if one else np.concatenate([first.copies.to_numpy(), second.copies.to_numpy()])
        b = b + shift
        n = np.zeros(len(nodes), np.int64)
        np.add.at(n, a, copies[b])
        np.add.at(n, b, copies[a])
        least = np.arange(len(nodes))
        while True:
            before = least.copy()
            np.minimum.at(least, a, least[b])
            np.minimum.at(least, b, least[a])
            least = least[least]
            if (least == before).all():
                break
        touched = n > 0
        return pd.DataFrame({"node": nodes[touched], "n": n[touched], "least": nodes[least[touched]]})

    tiles = written(dealt.groupBy("tile").applyInPandas(links, "node long, n long, least long"), "tiles")
    root = components(tiles.select(F.col("node").alias("a"), F.col("least").alias("b")))
    counts = tiles.groupBy("node").agg(F.sum("n").alias("n"))
    named = classes.select("node", "low", "copies").join(root.withColumnRenamed("id", "node"), "node", "left").withColumn("root", F.coalesce("root", "node")).join(counts, "node", "left")
    names = named.groupBy("root").agg(F.min("low").alias("component_id"))
    of_class = named.join(names, "root").select("node", "component_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = own.select("vec_id", "node").join(of_class, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull()),
    )
