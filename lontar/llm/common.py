"""Shared pieces: scratch space, shuffle hygiene, prefix sums and connected components."""

from __future__ import annotations

import json
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. A folder of our own where it is unset, for local masters only:
    executors elsewhere would not see it."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
            spark.sparkContext.setCheckpointDir(set_dir)
        return set_dir.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lontar-"))
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
    return current.get().rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path on whatever file system it is on; no error if it is gone."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def names(spark: SparkSession, path: str) -> set[str]:
    """Names of the entries of a folder."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    found = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(target)
    return {str(f.getPath().getName()) for f in found}


def stage(df: DataFrame, path: str) -> DataFrame:
    """Write a DataFrame as Parquet and read it back: cuts the lineage, survives lost executors."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder. Its files stay until forget(), or, with
    spark.cleaner.referenceTracking.cleanCheckpoints, until nothing refers to them."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def forget(*checkpointed: DataFrame) -> None:
    """Delete the files of checkpoints that nothing will read any more."""
    for df in checkpointed:
        plan = df._jdf.queryExecution().logical()
        file = plan.rdd().getCheckpointFile() if hasattr(plan, "rdd") else None
        if file is not None and file.isDefined():
            remove(df.sparkSession, file.get())


@contextmanager
def released_shuffles(spark: SparkSession):
    """Shuffle files of each query that ends inside go at once, not when the driver happens to collect garbage."""
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash60(*cols: Column) -> Column:
    """60 hash bits as a non-negative long, the same in any SQL engine with md5 (columns joined by |)."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("null")) for c in cols])), 1, 15), 16, 10).cast("long")


def range_number(c: Column, cuts: np.ndarray) -> Column:
    """How many of the sorted cuts are smaller than c, one more than their number for null: two short scans of a
    constant, in the JVM."""
    n = len(cuts)
    if not n:
        return F.when(c.isNull(), 1).otherwise(0)
    step = max(1, int(n**0.5))
    blocks = [[int(x) for x in cuts[i : i + step]] for i in range(0, n, step)]
    constant = lambda x, kind: F.from_json(F.lit(json.dumps(x)), kind)
    block = F.size(F.filter(constant([b[0] for b in blocks], "array<bigint>"), lambda x: x < c))
    within = F.size(F.filter(F.element_at(constant(blocks, "array<array<bigint>>"), F.greatest(block, F.lit(1))), lambda x: x < c))
    return F.when(c.isNull(), n + 1).when(block == 0, 0).otherwise((block - 1) * step + within)


def identity(docs: DataFrame) -> Column:
    """128 hash bits of all columns: rows that share them are equal in all columns, so either may stand for the other."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    # hashes pass over nulls, so which columns are null counts too
    values = [*[c.isNull() for c in columns], *columns]
    return F.struct(F.xxhash64(*values).alias("a"), F.xxhash64(F.lit("b"), *values).alias("b"))


def packed(docs: DataFrame) -> DataFrame:
    """Each row of docs as one column _row, so that no name in it meets a name of an operator."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))


def keep_first(docs: DataFrame, rooted: DataFrame) -> DataFrame:
    """One row of docs for each root of rooted (a, b, doc_id, root; a and b of identity()): that of the smallest doc_id,
    null last, then of the smallest identity. Equal rows are one row. All columns stay."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "a", "b"))
    chosen = rooted.groupBy("root").agg(first.alias("f")).select(F.col("f.a").alias("_a"), F.col("f.b").alias("_b"))
    of = identity(docs)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), of["a"].alias("_a"), of["b"].alias("_b"))
    return rows.dropDuplicates(["_a", "_b"]).join(chosen, ["_a", "_b"], "left_semi").select("_row.*")


#: Edges that one task contracts at the end (16 bytes each).
LAST_EDGES = 1_000_000
#: Keys with more rows than a share of all, and than this, are joined from a broadcast: at most HEAVY_KEYS of them.
HEAVY_ROWS, HEAVY_KEYS = 64, 4096


def _apart(rows: DataFrame, lookup: DataFrame, key: str, n: str, limit: int, how: str = "inner") -> DataFrame:
    heavy, light = (lookup.where(w).drop(n) for w in (F.col(n) > limit, F.col(n) <= limit))
    rest = rows.join(F.broadcast(heavy.select(key)), key, "left_anti")
    return rows.join(F.broadcast(heavy), key).unionByName(rest.join(light, key, how))


def join_counted(rows: DataFrame, lookup: DataFrame, key: str, n: str, how: str = "inner") -> DataFrame:
    """rows joined (inner or left) with lookup, which has one row a key and in column n how many of rows have it. Rows of
    crowded keys stay where they are: total / limit rows of lookup at most are broadcast for them."""
    total, most = lookup.agg(F.sum(n), F.max(n)).first()
    limit = max(HEAVY_ROWS, (total or 0) // HEAVY_KEYS)
    return rows.join(lookup.drop(n), key, how) if (most or 0) <= limit else _apart(rows, lookup, key, n, limit, how)


def local_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join every node to the smallest node of its component among the given edges."""
    if not len(a):
        return a, b
    nodes, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inv[: len(a)], inv[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        nxt = label.copy()
        np.minimum.at(nxt, x, low)
        np.minimum.at(nxt, y, low)
        np.minimum.at(nxt, label[x], low)
        np.minimum.at(nxt, label[y], low)
        while (jump := nxt[nxt]).tolist() != nxt.tolist():
            nxt = jump
        if np.array_equal(nxt, label):
            break
        label = nxt
    keep = label != np.arange(len(nodes))
    return nodes[keep], nodes[label[keep]]


def _contract(batches):
    """Of each task's edges only a spanning forest goes on."""
    a, b, held = [], [], 0
    for batch in batches:
        a.append(batch.column(0).to_numpy(zero_copy_only=False))
        b.append(batch.column(1).to_numpy(zero_copy_only=False))
        held += len(a[-1])
        if held > 2_000_000:
            x, y = local_forest(np.concatenate(a), np.concatenate(b))
            a, b, held = [x], [y], 0
    if a:
        x, y = local_forest(np.concatenate(a), np.concatenate(b))
        for i in range(0, len(x), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 100_000], pa.int64()), pa.array(y[i : i + 100_000], pa.int64())], names=["a", "b"])


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(a long, b long) edges to (node, root): root is the smallest node of the component, roots themselves left out.

    Tasks contract what they hold; up to LAST_EDGES edges are then contracted by one task. More go through alternating
    large-star and small-star steps on DataFrames, each round checkpointed and the one before it deleted. The minimum of a node's neighbours is a partial aggregate, and
    hubs get theirs from a broadcast of bounded size, so a hub's edges are never dealt to one task. No edges: an empty
    result."""
    spark = edges.sparkSession
    edges = checkpoint(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").mapInArrow(_contract, "a long, b long"))
    seen, n = None, edges.count()
    if not n:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    if n <= LAST_EDGES:
        return checkpoint(edges.coalesce(1).mapInArrow(_contract, "a long, b long")).select(F.col("a").alias("node"), F.col("b").alias("root"))
    for _ in range(max_rounds):
        limit = max(HEAVY_ROWS, 2 * n // HEAVY_KEYS)
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
        large = _apart(both, low, "a", "n", limit).where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # each edge now points to a smaller node: its parents' minimum and the other parents meet there
        down = large.union(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
        down = checkpoint(down)
        least = down.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = _apart(down, least, "a", "n", limit).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        before, edges = edges, checkpoint(small)
        forget(before, down)
        now = edges.agg(F.count("*"), F.sum(F.col("b").cast("decimal(38,0)")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen or not now[0]:
            break
        seen, n = now, now[0]
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
