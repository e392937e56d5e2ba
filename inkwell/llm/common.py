"""What the operators of this subpackage share: reading, stored intermediate tables, connected components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as words of most contracts are split by: \x20 and \x09-\x0D.
BLANKS = " \t\n\x0b\x0c\r"


#: Rows that Python gets at a time, where the session has Spark's own number: documents are long, and a batch is held several times.
ARROW_ROWS, ARROW_CONF = 2000, "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    if spark.conf.get(ARROW_CONF) == "10000":
        spark.conf.set(ARROW_CONF, str(ARROW_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders that local sessions without spark.checkpoint.dir use, by application.
_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, spark.checkpoint.dir. Where that is unset a local session gets a temporary folder, and a cluster
    an error: its executors don't share the driver's disk."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if context.applicationId not in _LOCAL:
            _LOCAL[context.applicationId] = f"file://{tempfile.mkdtemp(prefix='inkwell-')}"
        found = _LOCAL[context.applicationId]
    return found.rstrip("/")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores behind it as df's columns (whatever their case) leave it no other way."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts the lineage and survives the loss of executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/inkwell/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(spark: SparkSession, wanted: int) -> list[int]:
    """First arguments of a repartition into ``wanted`` parts where that is more than the session's setting; none otherwise, so that
    the setting holds and small parts are joined at run time."""
    return [wanted] if wanted > int(spark.conf.get("spark.sql.shuffle.partitions")) else []


Batches = Iterator[pa.RecordBatch]


def lean(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """run for mapInArrow, giving back the memory it has freed at its end: Python workers stay for later tasks, and what the allocators
    of idle ones keep counts against the executor."""

    @wraps(run)
    def held(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return held


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the undirected graph ``edges`` (a, b): rows (node, component), the smallest node of each.

    Alternating large-star and small-star rounds (Kiveris et al., 2014): every round re-hangs each node's
    neighbours on the smallest node it sees, so a path of length n takes about log n rounds. No node's neighbours are
    collected: the minimum is a partial aggregate and the join back is split by AQE where a node is hot.
    Each round is stored in the shared folder. Nodes without an edge do not appear; a self loop counts as none. Nodes are of any type
    that has an order.
    """
    now = stored(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u <> v").distinct(), "edges")
    before = None
    while True:
        # large star: neighbours above u hang on the smallest node around u (u included)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        now = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: u and its smaller neighbours hang on the smallest of them
        down = now.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        hung = down.join(least, "u")
        now = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(hung.select("u", F.col("m").alias("v")))
        now = stored(now.where("u <> v").distinct(), "edges")
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = state
