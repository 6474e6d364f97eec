"""Reading, staging and connected components shared by the corpus operators."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch handed to Python. Documents can be long, so batches are kept small.
BATCH_ROWS = 256
#: Part of its largest heap that the driver's JVM may hold before it is told to collect.
HEAP_SHARE = 0.5
#: Most bits of a filter by which rows are picked before a join: 32 MB.
FILTER_BITS = 1 << 28


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, found by their exact names, so that extra columns can never clash with the operator's own."""
    at = [df.columns.index(n) for n in names]
    return df.toDF(*(f"c{k}" for k in range(len(df.columns)))).select(*(F.col(f"c{k}").alias(n) for k, n in zip(at, names)))


_shipped: set[str] = set()


def ready_python(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, and bound the rows of an Arrow batch for this session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    if spark.sparkContext.applicationId in _shipped:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if os.path.isdir(top):
        archive = os.path.join(tempfile.mkdtemp(), "gaugework_llm.zip")
        with zipfile.ZipFile(archive, "w") as z:
            z.write(os.path.join(top, "__init__.py"), "gaugework/__init__.py")
            for name in sorted(os.listdir(os.path.join(top, "llm"))):
                if name.endswith(".py"):
                    z.write(os.path.join(top, "llm", name), f"gaugework/llm/{name}")
        spark.sparkContext.addPyFile(archive)
    _shipped.add(spark.sparkContext.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the session's spark.checkpoint.dir, or, where none is set, one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        # One machine holds driver and executors.
        found = f"file://{tempfile.mkdtemp(prefix='gaugework-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def tidy_driver(spark: SparkSession) -> None:
    """Collect the driver's garbage if its heap has grown beyond HEAP_SHARE.

    Each broadcast and each stage's tasks take some MB of it for a moment, so that many short steps
    make the heap grow to its limit though little of it is in use. A full collection gives that back,
    and tells Spark which shuffles and broadcasts nothing needs any more.
    """
    runtime = spark.sparkContext._jvm.java.lang.Runtime.getRuntime()
    if runtime.totalMemory() > HEAP_SHARE * runtime.maxMemory():
        runtime.gc()


_untrimmed: set[str] = set()


def trim_driver(spark: SparkSession) -> bool:
    """Have the driver's JVM give what its native code has freed back to the system; whether it could.

    Compression, the compiler and the network allocate outside the heap, in as many arenas as there are
    busy threads, and malloc keeps what they free. JVMs from 17 on have a command for that, on glibc; it
    takes some hundredths of a second. Others keep it.
    """
    context = spark.sparkContext
    if context.applicationId in _untrimmed:
        return False
    jvm = context._jvm

    def array(kind, *values):
        out = context._gateway.new_array(kind, len(values))
        for k, value in enumerate(values):
            out[k] = value
        return out

    try:
        # By reflection on the interface, as the server's own class is in no exported package.
        kinds = ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")
        invoke = jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethod("invoke", array(jvm.java.lang.Class, *map(jvm.java.lang.Class.forName, kinds)))
        commands = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), array(jvm.java.lang.Object, commands, "systemTrimNativeHeap", None, None))
    except Py4JError:
        _untrimmed.add(context.applicationId)
        return False
    return True


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a frame as a table in the shared folder and read it back, which cuts the lineage durably."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    tidy_driver(spark)
    trim_driver(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def unstage(df: DataFrame) -> None:
    """Remove a staged table that nothing will read again."""
    spark, path = df.sparkSession, getattr(df, "_staged_at", None)
    if path:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def among(rows: DataFrame, key: str, ids: DataFrame, id_: str) -> DataFrame:
    """The rows whose key may be among the ids, before a join on it shuffles them; a few others come along.

    The filter has sixteen bits for each id, up to FILTER_BITS, so its broadcast never grows beyond
    that many bits; with very many ids it lets more of the other rows pass, which the join then drops.
    """
    size = 1 << min(FILTER_BITS.bit_length() - 1, max(15, (16 * ids.count()).bit_length()))
    spot = lambda c: F.pmod(F.xxhash64(F.lit(5), c), F.lit(size)) + 1
    bits = ids.select(spot(F.col(id_)).alias("at")).groupBy(F.expr("bitmap_bucket_number(at)").alias("filter_bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(at))").alias("filter_bits"))
    marked = rows.withColumn("filter_at", spot(F.col(key))).withColumn("filter_bucket", F.expr("bitmap_bucket_number(filter_at)")).withColumn("filter_at", F.expr("bitmap_bit_position(filter_at)"))
    byte = F.conv(F.hex(F.substring("filter_bits", (F.col("filter_at") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return marked.join(F.broadcast(bits), "filter_bucket").where(byte.bitwiseAND(F.expr("shiftleft(1, cast(filter_at % 8 as int))")) != 0).select(*rows.columns)


def _stars(links: DataFrame) -> bool:
    """Whether each node u has one smaller neighbour v, which has no smaller one itself and so is the least of its component."""
    end = lambda name, up: F.struct(F.col(name).alias("id"), F.lit(up).alias("up"), F.lit(1 - up).alias("down"))
    ends = links.select(F.explode(F.array(end("u", 1), end("v", 0))).alias("e"))
    nodes = ends.groupBy("e.id").agg(F.sum("e.up").alias("up"), F.max("e.down").alias("down"))
    return nodes.agg(F.count_if(F.expr("up > 1 or (up = 1 and down = 1)"))).first()[0] == 0


def components(edges: DataFrame, a: str = "a", b: str = "b", known: DataFrame | None = None) -> DataFrame:
    """Connected components of undirected links, as (id, component) with the smallest id reachable.

    known: the components of further links, as this gives them; so links that come in turns are added
    to stars, which take fewer rounds than all links anew. It is removed in the end.

    Alternating large-star and small-star rounds until only stars are left: every round is two
    aggregations and two joins on node ids and the number of rounds grows with the logarithm of the
    size, so nothing is ever gathered on the driver. Each round is written to the shared folder. Nodes
    without a link, null ends and self links give no row; repeated links count once.
    """
    u, v = F.col(a), F.col(b)
    given = edges.where(u.isNotNull() & v.isNotNull() & (u != v)).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v"))
    if known is not None:
        given = given.union(known.where("id != component").select(F.col("id").alias("u"), F.col("component").alias("v")))
    now = stage(given.distinct(), "links")
    if known is not None:
        unstage(known)
    while not _stars(now):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        then = stage(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        unstage(now)
        now = then
    out = now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
    out._staged_at = now._staged_at
    return out


def blank(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))
