"""What the text operators share: the shared folder, tables that cut lineage, and connected components."""

from __future__ import annotations

import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shipping import ship

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: Bytes of an Arrow batch handed to Python, so that long texts do not pile up in a worker.
ARROW_BATCH_BYTES = 8 << 20
#: Bytes of a counted side of a join up to which it is broadcast.
BROADCAST_BYTES = 4 << 20
#: Edges of one node that a task of connected_components takes.
HUB_EDGES = 250_000

#: Folders for applications whose session names none, as in tests.
_FALLBACK: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a fresh local one only where it is unset and Spark
    runs in one machine. On a cluster an unset folder is an error, as executors would write to disks that nobody else reads."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = _FALLBACK.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="veilspark-")
        _FALLBACK[spark.sparkContext.applicationId] = found
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in this application's part of the shared folder."""
    return f"{shared_dir(spark)}/veilspark-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def cut(df: DataFrame, name: str = "table") -> DataFrame:
    """Writes a frame to the shared folder and rereads it: lost executors cost no recomputation of what came before."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found._scratch = path
    _MADE.append(found)
    return found


#: Frames that cut() made and nobody has dropped, in order.
_MADE: list[DataFrame] = []


def made() -> int:
    """How many tables of cut() there are, for drop_since()."""
    return len(_MADE)


def drop_since(number: int, but: DataFrame) -> None:
    """Deletes the tables that cut() made since made() gave number, save one: a stage's own tables, once its result is written."""
    for frame in _MADE[number:]:
        if frame is not but:
            drop_scratch(frame)


def drop_scratch(df: DataFrame) -> None:
    """Deletes the files of a frame made by cut(), once nothing reads it any more; other frames are left alone."""
    path = getattr(df, "_scratch", None)
    if path:
        _delete(df.sparkSession, path)
        _MADE[:] = [f for f in _MADE if f is not df]


def release(spark: SparkSession) -> None:
    """Deletes all tables and archives that this application made in the shared folder; results that read them end with them."""
    _delete(spark, f"{shared_dir(spark)}/veilspark-{spark.sparkContext.applicationId}")
    _MADE.clear()


def small_batches(spark: SparkSession) -> None:
    """Prepares a session for Python workers: small Arrow batches, and this package on their path."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BATCH_BYTES))


#: What this Python worker keeps from task to task, under the name of the operator that it belongs to: one operator's at a time.
_KEPT: dict[str, tuple] = {}


def kept(owner: str, key=None, make=None):
    """What make() gave this worker for the owner's key, made anew where the key is another. Workers outlive an operator, so what
    others kept is let go first, and its memory given back; without make, that is all."""
    if _KEPT and owner not in _KEPT:
        _KEPT.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
    if make is None:
        return None
    if owner not in _KEPT or _KEPT[owner][0] != key:
        _KEPT[owner] = key, make()
    return _KEPT[owner][1]


def ascii_lower(column):
    """A-Z lowered and nothing else. Spark's own lower is faster by far, and the same unless capitals beyond ASCII, or characters that regular expressions do not know yet, occur."""
    return F.when(column.rlike(r"[\p{IsUppercase}\p{Lt}\p{Cn}&&[^A-Z]]"), F.translate(column, UPPER, LOWER)).otherwise(F.lower(column))


def small(frame: DataFrame) -> DataFrame:
    """A frame of stored columns, marked for broadcast if its counted bytes are few: 40 a row, and what its strings and arrays take.

    Beyond, a join with it is a shuffle, in which adaptive execution splits the partition of a key that many rows share.
    """
    size = F.lit(40)
    for field in frame.schema.fields:
        if field.dataType.typeName() in ("string", "binary"):
            size += F.coalesce(F.octet_length(F.col(field.name)), F.lit(0))
        elif field.dataType.typeName() == "array":
            size += 40 * F.coalesce(F.size(F.col(field.name)), F.lit(0))
    found = frame.agg(F.sum(size.cast("long"))).first()[0] or 0
    if found > BROADCAST_BYTES:
        return frame
    marked = F.broadcast(frame)
    marked._broadcast = True
    return marked


def is_broadcast(frame: DataFrame) -> bool:
    """Whether small() found a frame to be small."""
    return getattr(frame, "_broadcast", False)


def crc_fold(column, folds: int):
    """crc32 of the decimal text of an id, modulo folds. A null id counts as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % folds


def connected_components(edges: DataFrame, hub_edges: int = HUB_EDGES) -> DataFrame:
    """(node, component) for every node of edges (a, b); component is the smallest node reachable.

    Alternating large-star and small-star rounds, until nothing changes: each round maps neighbours to the smallest
    node of the neighbourhood, so the edge count never grows and long chains shrink by powers. Minima are
    pre-aggregated before their shuffle. A hub's edges are dealt out to as many tasks as its counted edges need, so no
    task gets a whole hub. Each round is written to the shared folder. Null nodes and loops are ignored.
    """

    def both_ways(found: DataFrame) -> DataFrame:
        return found.select("u", "v").union(found.select(F.col("v").alias("u"), F.col("u").alias("v")))

    def with_minimum(pairs: DataFrame, salts: int) -> DataFrame:
        """pairs (u, v) with m, the smallest of u and its v."""
        minima = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        if salts == 1:
            return pairs.join(minima, "u")
        minima = minima.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        return pairs.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(salts)).cast("int")).join(minima, ["u", "salt"])

    def measure(found: DataFrame):
        """((edges, sum of their hashes), most edges of a node)."""
        of_node = both_ways(found).groupBy("u").agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"))
        n, h, most = of_node.agg(F.sum("n"), F.sum("h"), F.max("n")).first()
        return (n or 0, h), most or 0

    current = cut(
        edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        "components",
    )
    state, most = measure(current)
    while state[0]:
        salts = -(-most // hub_edges)
        large = with_minimum(both_ways(current), salts).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        starred = with_minimum(large, salts)
        star = starred.select(F.col("v").alias("u"), F.col("m").alias("v")).union(starred.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        after = cut(star, "components")
        before, (state, most) = state, measure(after)
        drop_scratch(current)
        current = after
        if state == before:
            break
    roots = current.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    return roots.union(current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
