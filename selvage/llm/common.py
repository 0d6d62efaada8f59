"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_ROOT: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """Folder that driver and executors share, as the session names it.

    ``spark.checkpoint.dir`` is read from the session.  Only where it is unset
    and everything runs in this one process (tests, a laptop) a temporary folder
    of it is used instead; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
    if not _LOCAL_ROOT:
        _LOCAL_ROOT.append("file://" + tempfile.mkdtemp(prefix="selvage-shared-"))
    return _LOCAL_ROOT[0]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and read it back.

    A lost executor costs at most the running stage, because everything before
    it lies in the shared folder.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/selvage-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._selvage_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table written by :func:`materialize` once nothing reads it any more."""
    path = getattr(df, "_selvage_path", None)
    if path:
        jvm = df.sparkSession.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def connected_components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Smallest reachable id of every vertex of ``edges(a, b)``: columns ``node, component``.

    Self links are ignored; a vertex without other links does not appear.
    """
    now = stars(edges, max_rounds)
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)


def stars(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """``a, b``: every vertex of ``edges(a, b)`` but the smallest of its component, and that smallest one.

    Alternating large-star and small-star rounds.  Each is a grouped minimum,
    combined before the shuffle, and an equi-join that adaptive execution may
    split (minima counted to be few are broadcast), so a hub with very many
    neighbours is never gathered in one row.  Rounds end once no vertex with a
    smaller neighbour has another one, which the minima of the next round tell.
    Links of few vertices are written in as many files as there are cores.
    """
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "cc")
    for r in range(max_rounds + 1):
        both = now.union(now.select("b", "a")).toDF("u", "v")
        smaller = F.when(F.col("v") < F.col("u"), F.col("v"))
        around = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.max(smaller).alias("most"), F.max("v").alias("top"))
        around = around.persist()
        unsettled = (F.col("m") < F.col("u")) & ((F.col("most") > F.col("m")) | (F.col("top") > F.col("u")))
        left, vertices = around.agg(F.count_if(unsettled), F.count("*")).first()
        if not left:
            around.unpersist()
            return now.distinct() if r == 0 else now
        if r == max_rounds:
            raise RuntimeError("components did not settle")
        few = vertices <= SMALL_ROWS
        least = around.select("u", "m")
        large = both.where("v > u").join(F.broadcast(least) if few else least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b")
        # every row of `large` has a > b: the smaller neighbours of a are all its rows
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(F.broadcast(low) if few else low, "a").select(F.explode(F.array(
            F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
            F.struct(F.col("a").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        small = small.where("a <> b").distinct()
        new = materialize(small.coalesce(edges.sparkSession.sparkContext.defaultParallelism) if few else small, "cc")
        discard(now)
        around.unpersist()
        now = new


def bounded_batches(spark: SparkSession, rows: int = 512, size: int = 32 << 20) -> None:
    """Keep Arrow batches small in rows and bytes, as texts may be very long: a task holds a batch in memory."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        try:
            now = int(spark.conf.get(key))
        except Exception:  # given with a unit, or not known to this version
            now = 0
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))


#: Rows of a few numbers each that may be sent to every executor.
SMALL_ROWS = 400_000


def counted(df: DataFrame, within: int | None = None) -> int:
    """A bound on the rows of ``df``: ``within``, which is known to be one, if that is small; else they are counted.

    Every count is a query of its own, whose plan and figures the driver keeps.
    """
    return within if within is not None and within <= SMALL_ROWS else df.count()


def if_small(df: DataFrame, within: int | None = None) -> DataFrame:
    """Hint to broadcast a materialised table of a few numeric columns, if a bound on its rows (:func:`counted`) allows it; else it is shuffled."""
    return F.broadcast(df) if counted(df, within) <= SMALL_ROWS else df


def side(df: DataFrame, name: str, within: int) -> DataFrame:
    """``df`` as one side of one join: broadcast as it is if the bound ``within`` on its rows allows it, else materialised for :func:`if_small`."""
    if within <= SMALL_ROWS:
        return F.broadcast(df)
    written = materialize(df, name)
    out = if_small(written)
    out._selvage_path = written._selvage_path
    return out
