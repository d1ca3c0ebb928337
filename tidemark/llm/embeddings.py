"""Near-duplicate vectors by int8 tile products with rigorous error bounds.

Unit vectors are rounded to int8 with one scale a vector. The product of two rounded vectors differs
from the cosine by no more than their rounding errors allow (Cauchy-Schwarz with measured error
norms), so a tile pair's integer product tells which pairs can reach the threshold; only these are
recomputed in double precision. Tiles are shipped as int8 codes, an eighth of the bytes; the components of
a tile are read from the shared folder where a pair of it is to be recomputed.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, groups, parts, shared_dir, staged

#: Vectors in a tile; a task holds two tiles and one product of CHUNK rows, and recomputes VALUES components at a time.
TILE, CHUNK, VALUES = 2048, 512, 1 << 21
#: Dimensions of one product of codes: its sums stay below 2^24, so that float32 holds them exactly.
EXACT = 1024


def levelled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two each, so that squares neither overflow nor vanish; exact, and cosines stay the same."""
    _, e = np.frexp(np.abs(x).max(axis=1))
    return np.ldexp(x, -e[:, None])


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 vectors, scales, and bounds of the rounding error's norm, of the unit vectors along x (doubles, not zero)."""
    x = levelled(x)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    scale = np.abs(x).max(axis=1) / 127
    q = np.rint(x / scale[:, None]).astype(np.int8)
    error = np.linalg.norm(x - q * scale[:, None], axis=1) * (1 + 1e-9) + 1e-12
    return q, scale, error


def products(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Integer products of the rows of two int8 matrices, exact."""
    out = np.zeros((len(q), len(p)))
    for s in range(0, q.shape[1], EXACT):
        out += q[:, s : s + EXACT].astype(np.float32) @ p[:, s : s + EXACT].astype(np.float32).T
    return out


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of levelled rows, pair by pair."""
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def tile_links(one, two, threshold: float, doubles) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs with cosine >= threshold, within one tile (two is None) or between two.

    one, two: codes, scales and error bounds. doubles() gives the components of both, and is called only if
    some pair may reach the threshold.
    """
    (qx, sx, ex), (qy, sy, ey) = one, two or one
    x = y = None
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for s in range(0, len(qx), CHUNK):
        # <u, v> <= <q_u, q_v> + e_u |q_v| + e_v, as |u| = 1 and |q_v| <= 1 + e_v
        most = products(qx[s : s + CHUNK], qy) * (sx[s : s + CHUNK, None] * sy[None, :]) + ex[s : s + CHUNK, None] * (1 + ey[None, :]) + ey[None, :]
        i, j = np.nonzero(most >= threshold - 1e-9)
        i += s
        if two is None:
            i, j = i[i < j], j[i < j]
        if not len(i):
            continue
        if x is None:
            x, y = map(levelled, doubles())
        step = max(1, VALUES // x.shape[1])
        for k in range(0, len(i), step):
            a, b = i[k : k + step], j[k : k + step]
            near = cosines(x[a], y[b]) >= threshold
            found.append((a[near], b[near]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = 0.9) -> DataFrame:
    """(key, n_links, component_id, kept) of every row: links at cosine >= threshold in double precision.

    Equal vectors are one class, compared once: its copies are counted as links of each other without a pair
    being made. Null, zero and non-finite vectors, and such with null or non-finite components, link with
    nothing. Vectors of other lengths never link. n_links is the number of other rows linked directly,
    component_id the smallest key of the rows reachable (nulls aside; null if all are), kept key = component_id.
    Rows with one key are rows of their own, with the links of their own vectors. Other columns are left out,
    an empty table gives no rows. Every class meets every other once: tile pairs are dealt to tasks, which
    return counts and a spanning forest, never pairs.
    """
    spark = df.sparkSession
    n = parts(spark)
    rows = df.select(F.col(key).cast("long").alias("k"), F.col(vector).cast("array<double>").alias("v"))
    fine = F.coalesce(
        F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0), F.lit(False)
    )
    rows = rows.withColumn("ok", fine).withColumn("v", F.when(F.col("ok"), F.transform("v", lambda x: x + F.lit(0.0))))
    rows = staged(rows.withColumn("c", F.when(F.col("ok"), F.sha2(F.to_json("v").cast("binary"), 256))), "vec")
    classes = rows.where("ok").groupBy("c").agg(F.min("k").alias("low"), F.count("*").alias("n"), F.any_value("v").alias("v"))
    total = rows.where("ok").select("c").distinct().count()
    tiles = max(1, -(-total // TILE))
    folder = f"{shared_dir(spark)}/vec-tile-{uuid.uuid4().hex}"
    tiled = classes.withColumn("size", F.size("v")).withColumn("tile", F.pmod(F.xxhash64("c"), F.lit(tiles)).cast("int"))
    tiled.repartition(min(n, tiles), "tile").write.partitionBy("size", "tile").parquet(folder)
    tiled = spark.read.schema("c string, low long, n long, v array<double>, size int, tile int").parquet(folder)

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column("size").to_numpy()
            for d in np.unique(size):
                b = batch.filter(pa.array(size == d))
                q, scale, error = quantised(b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, d))
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(c) for c in ("size", "tile", "c", "n")), pa.array([x.tobytes() for x in q], pa.binary()), pa.array(scale), pa.array(error)],
                    names=["size", "tile", "c", "n", "q", "scale", "error"],
                )

    coded = staged(tiled.select("size", "tile", "c", "n", "v").mapInArrow(codes, "size int, tile int, c string, n long, q binary, scale double, error double"), "vec-code")
    dealt = (
        coded.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
        .withColumn("i", F.least("tile", "o"))
        .withColumn("j", F.greatest("tile", "o"))
        .select("size", "i", "j", "tile", "c", "n", "q", "scale", "error")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, at = fs.FileSystem.from_uri(folder)
        held: dict[tuple[int, int], pa.Table] = {}

        def read(size: int, tile: int, names: list[str]) -> np.ndarray:
            """Components of a tile in the order of the names; the last two tiles are held."""
            if (size, tile) not in held:
                there = [f.path for f in files.get_file_info(fs.FileSelector(f"{at}/size={size}/tile={tile}")) if f.path.endswith(".parquet")]
                if len(held) > 1:
                    del held[next(iter(held))]
                held[size, tile] = pa.concat_tables([pq.read_table(f, columns=["c", "v"], filesystem=files, partitioning=None) for f in there])
            t = held[size, tile]
            place = {c: i for i, c in enumerate(t.column("c").to_pylist())}
            t = t.take(pa.array([place[c] for c in names], pa.int64()))
            return t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, size)

        for t in groups(batches, ["size", "i", "j"]):
            size, i, j = (t.column(c)[0].as_py() for c in ("size", "i", "j"))
            count, tile, name = t.column("n").to_numpy(), t.column("tile").to_numpy(), t.column("c").to_pylist()
            q = np.frombuffer(b"".join(t.column("q").to_pylist()), np.int8).reshape(-1, size)
            scale, error = t.column("scale").to_numpy(), t.column("error").to_numpy()
            a, b = np.flatnonzero(tile == i), np.flatnonzero(tile == j)
            if i == j:
                both = lambda: (read(size, i, name),) * 2  # noqa: B023, E731
                x, y = tile_links((q, scale, error), None, threshold, both)
            elif len(a) and len(b):
                both = lambda: (read(size, i, [name[k] for k in a]), read(size, j, [name[k] for k in b]))  # noqa: B023, E731
                x, y = tile_links((q[a], scale[a], error[a]), (q[b], scale[b], error[b]), threshold, both)
                x, y = a[x], b[y]
            else:
                continue
            if not len(x):
                continue
            more = np.bincount(x, count[y], len(name)) + np.bincount(y, count[x], len(name))
            root = np.arange(len(name))
            while True:  # labels sink along the links: a spanning forest
                new = root.copy()
                np.minimum.at(new, x, root[y])
                np.minimum.at(new, y, root[x])
                new = new[new]
                if (new == root).all():
                    break
                root = new
            some = np.flatnonzero(more)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name[k] for k in some]), pa.array([name[k] for k in root[some]]), pa.array(more[some].astype(np.int64))], names=["a", "b", "more"]
            )

    made = staged(
        dealt.repartition(n, "size", "i", "j").sortWithinPartitions("size", "i", "j").mapInArrow(run, "a string, b string, more long"), "vec-link"
    )
    linked = components(made.select("a", "b"))
    more = made.groupBy("a").agg(F.sum("more").alias("more"))
    of = tiled.select("c", "low", "n").join(more, F.col("c") == F.col("a"), "left").join(linked, F.col("c") == F.col("node"), "left")
    of = staged(of.select("c", "low", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), F.coalesce("component", "c").alias("component")), "vec-class")
    least = of.groupBy("component").agg(F.min("low").alias("component_id"))
    of = of.join(least, "component").select(F.col("c").alias("class"), "n_links", "component_id")
    out = rows.select("k", "c").join(of, F.col("c") == F.col("class"), "left")
    lowest = F.when(F.col("class").isNull(), F.col("k")).otherwise(F.col("component_id"))
    return out.select(
        F.col("k").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), lowest.alias("component_id"), F.col("k").eqNullSafe(lowest).alias("kept")
    )


def op6_embeddings(spark, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector, links at cosine 0.9."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
