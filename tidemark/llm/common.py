"""Pieces that several operators share: written stages, components, bucket kernels."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space of the word rule [^\x20\x09-\x0D]+, for Java and Python patterns.
SPACE = r"[\x20\x09-\x0D]"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir); a temporary one on a single machine, where it is unset."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = f"file://{os.path.join(tempfile.gettempdir(), 'tidemark-shared')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def staged(df: DataFrame, name: str, folders: tuple[str, ...] = ()) -> DataFrame:
    """Writes df as Parquet in the shared folder and returns it reread: a cut lineage that survives lost executors.

    Rows are laid in folders by the columns `folders`, of few values, which a filter then reads alone.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").partitionBy(*folders).parquet(path) if folders else df.write.parquet(path)
    spark._jvm.System.gc()  # the shuffles behind the written rows are garbage; executors delete their files when the driver notices
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes the files of a staged table that nothing reads any more."""
    jvm, spark = df.sparkSession._jvm, df.sparkSession
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(conf).delete(path, True)


def plain(df: DataFrame, *left_out: str) -> tuple[list[str], list]:
    """Names of the columns but those left out, and these columns under the names c0, c1, .. that clash with nothing."""
    names = [c for c in df.columns if c.lower() not in {x.lower() for x in left_out}]
    return names, [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)]


def columns_of(spark: SparkSession, path: str, *names: str) -> DataFrame:
    return spark.read.parquet(path).select(*names)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an edge list: (node, component), component the smallest node of each.

    Alternating large-star and small-star steps (Kiveris et al., 2014): each halves the distance to the
    root or better, so the rounds grow with the logarithm of the diameter. Only per-node minima are
    joined back, and each step's edges are a written table. No edge list or label reaches the driver:
    it sees two numbers a round. Nodes without an edge do not appear; self-links are harmless.
    """
    now = staged(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "cc-edges"
    )
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # a node that is its own minimum keeps its larger neighbours, the others hand them to the minimum
        large = large.union(low.where("m < u").select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        large = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        small = small.union(low.select("u", F.col("m").alias("v"))).distinct()
        after = staged(small, "cc-edges")
        # done when every node has one parent and no parent has a parent
        roots = after.select(F.col("v").alias("u")).distinct().join(after.select("u").distinct(), "u", "left_semi")
        sizes = after.agg(F.count("*").alias("n"), F.count_distinct("u").alias("k")).collect()[0]
        done = sizes.n == sizes.k and roots.isEmpty()
        dropped(now)
        now = after
        if done:
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def labels_of(adjacent: np.ndarray) -> np.ndarray:
    """Component labels (smallest index) of a boolean adjacency matrix."""
    n = len(adjacent)
    label = np.arange(n)
    adjacent = adjacent | np.eye(n, dtype=bool)
    while True:
        new = np.where(adjacent, label[None, :], n).min(axis=1)
        new = new[new]
        if (new == label).all():
            return label
        label = new


#: Rows of a bucket that one kernel call takes; a larger bucket is compared block by block.
BLOCK = 1024


def bucket_links(
    members: DataFrame,
    item: str,
    payload: list[str],
    links: Callable[[list[np.ndarray], list[np.ndarray] | None], list[tuple[int, int]]],
    item_type: str = "long",
) -> DataFrame:
    """Verified links (a, b) between the members of each bucket, enough to connect what any link connects.

    members: key long, item, payload columns. The rows are dealt by key and sorted, and a task walks over
    the runs of equal keys with at most BLOCK rows held. A larger bucket leaves this pass as it is and is
    cut into blocks dealt by (key, block pair): each pair of its rows meets in exactly one task, so that
    no task holds more than two blocks and nothing is dropped. links() gets the payload arrays of one
    block, or of two whose cross pairs alone count, and returns index pairs (a spanning forest will do).
    """
    cols = [item, *payload]
    kinds = {f.name: f.dataType.simpleString() for f in members.schema.fields}
    schema = "a " + item_type + ", b " + item_type + ", key long, " + ", ".join(f"p_{c} {kinds[c]}" for c in cols)

    def out(a, b, key, rows):
        n = max(len(a), len(key))
        fill = lambda x, t: pa.array(x, t) if len(x) else pa.nulls(n, t)
        return pa.RecordBatch.from_arrays(
            [fill(a, pa.int64()), fill(b, pa.int64()), fill(key, pa.int64())]
            + [rows.column(c).combine_chunks().cast(arrow[c]) if rows is not None else pa.nulls(n, arrow[c]) for c in cols],
            names=["a", "b", "key", *(f"p_{c}" for c in cols)],
        )

    arrow = {c: {"bigint": pa.int64(), "array<bigint>": pa.list_(pa.int64())}[kinds[c]] for c in cols}

    def values(t: pa.Table) -> list[np.ndarray]:
        return [
            np.array([np.array(x, dtype=np.int64) for x in t.column(c).to_pylist()] + [None], dtype=object)[:-1]
            if pa.types.is_list(t.schema.field(c).type)
            else t.column(c).to_numpy()
            for c in cols
        ]

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, over = None, None
        for last, batch in with_last(batches):
            t = pa.Table.from_batches([batch])
            if rest is not None:
                t = pa.concat_tables([rest, t])
            keys = t.column("key").to_numpy()
            if not len(keys):
                continue
            cut = np.flatnonzero(np.diff(keys)) + 1
            starts, ends = np.r_[0, cut], np.r_[cut, len(keys)]
            rest, before = None, over  # this batch may end one oversized bucket and begin another
            if not last:
                if ends[-1] - starts[-1] > BLOCK:
                    over = keys[-1]
                    yield out([], [], keys[starts[-1] :], t.slice(starts[-1]))
                elif keys[-1] == over:
                    yield out([], [], keys[starts[-1] :], t.slice(starts[-1]))
                else:
                    rest = t.slice(starts[-1])
                starts, ends = starts[:-1], ends[:-1]
            a: list[int] = []
            b: list[int] = []
            some = np.flatnonzero(ends - starts >= 2) if over is None else np.arange(len(starts))
            for s, e in zip(starts[some].tolist(), ends[some].tolist(), strict=True):
                run = t.slice(s, e - s)
                if keys[s] in (before, over) or e - s > BLOCK:
                    yield out([], [], keys[s:e], run)
                elif e - s > 1:
                    x = values(run)
                    for i, j in links(x[1:], None):
                        a.append(int(x[0][i]))
                        b.append(int(x[0][j]))
            if over is not None and len(starts) and keys[-1] != over:
                over = None
            if a:
                yield out(a, b, [], None)

    def crossed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, ["key", "bi", "bj"]):
            side = t.column("blk").to_numpy()
            i, j = t.column("bi")[0].as_py(), t.column("bj")[0].as_py()
            x = values(t)
            one = [v[side == i] for v in x]
            two = None if i == j else [v[side == j] for v in x]
            pairs = links(one[1:], two and two[1:])
            if pairs:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(one[0][p]) for p, _ in pairs], pa.int64()), pa.array([int((two or one)[0][q]) for _, q in pairs], pa.int64())],
                    names=["a", "b"],
                )

    n = parts(members.sparkSession)
    first = staged(members.select("key", *cols).repartition(n, "key").sortWithinPartitions("key").mapInArrow(small, schema), "bucket")
    big = first.where("key is not null").select("key", *(F.col(f"p_{c}").alias(c) for c in cols))
    found = first.where("a is not null").select("a", "b")
    if not big.isEmpty():
        sizes = big.groupBy("key").count().select("key", F.ceil(F.col("count") / F.lit(BLOCK)).cast("long").alias("nb"))
        dealt = (
            big.join(sizes, "key")
            .withColumn("blk", F.pmod(F.xxhash64(item, F.lit(7)), F.col("nb")))
            .withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)))
            .withColumn("bi", F.least("blk", "o"))
            .withColumn("bj", F.greatest("blk", "o"))
            .select("key", "bi", "bj", "blk", *cols)
        )
        more = dealt.repartition(n, "key", "bi", "bj").sortWithinPartitions("key", "bi", "bj")
        found = found.union(more.mapInArrow(crossed, f"a {item_type}, b {item_type}"))
    return found.distinct()


def with_last(it: Iterator) -> Iterator[tuple[bool, object]]:
    """Each element with whether it is the last."""
    held, empty = None, True
    for x in it:
        if not empty:
            yield False, held
        held, empty = x, False
    if not empty:
        yield True, held


def groups(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.Table]:
    """Tables of the runs of equal keys in sorted batches; one run is held at a time."""
    held: list[pa.Table] = []
    at = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        k = np.stack([t.column(c).to_numpy() for c in by], axis=1)
        cut = np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1
        for s, e in zip([0, *cut.tolist()], [*cut.tolist(), len(k)], strict=True):
            here = tuple(k[s].tolist())
            if held and here != at:
                yield pa.concat_tables(held)
                held = []
            at = here
            held.append(t.slice(s, e - s))
    if held:
        yield pa.concat_tables(held)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def groups_by_file(batches: Iterator[pa.RecordBatch], most: int = 256) -> Iterator[tuple[str, list[int], list[int]]]:
    """File name, offsets and lengths of sorted rows (file, offset, length), at most `most` at a time."""
    for b in batches:
        names, offsets, lengths = (b.column(i).to_pylist() for i in range(3))
        s = 0
        for e in range(1, len(names) + 1):
            if e == len(names) or names[e] != names[s] or e - s >= most:
                yield names[s], offsets[s:e], lengths[s:e]
                s = e


def ranked(df: DataFrame, by: list, sums: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Rows range-sorted by (g, *by) and written, and what each range holds of each group g (a string, never null).

    The rows gain _row (ascending in the sorted order) and _part (the range). The second frame has a row for
    each (g, _part): _first (the least _row), and of the row count `n` and each of `sums` the total before
    this range (before_*) and in the whole group (all_*). A row's place in its group is
    before_n + _row - _first. A group with most of the rows lies in many ranges, so no task takes it whole,
    and the second frame has no more rows than ranges and groups together.
    """
    n = parts(df.sparkSession)
    rows = df.repartitionByRange(n, "g", *by).sortWithinPartitions("g", *by).withColumn("_row", F.monotonically_increasing_id())
    rows = staged(rows.withColumn("_part", F.shiftright("_row", 33)), "ranked")
    per = rows.groupBy("g", "_part").agg(F.min("_row").alias("_first"), F.count("*").alias("n"), *(F.sum(c).alias(c) for c in sums))
    whole = Window.partitionBy("g")
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counted = [F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"before_{c}") for c in ("n", *sums)]
    return rows, per.select("g", "_part", "_first", *counted, *(F.sum(c).over(whole).alias(f"all_{c}") for c in ("n", *sums)))
