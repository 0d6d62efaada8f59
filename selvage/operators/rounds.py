"""Work in rounds over whole tables: lineage cut by written tables, and places of nodes that links tie together."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from selvage.operators.groups import dealt

_OWN: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """Where driver and executors both read and write: ``spark.checkpoint.dir``; only a local session without it gets a folder of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _OWN:
        _OWN.append("file://" + tempfile.mkdtemp(prefix="selvage-rounds-"))
    return _OWN[0]


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: later rounds start from it, also after an executor is lost."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def remove(*tables: DataFrame) -> None:
    """Delete tables of :func:`written` that nothing reads any more."""
    for df in tables:
        if path := getattr(df, "_written_to", None):
            context = df.sparkSession.sparkContext
            at = context._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


def _with_places(links: DataFrame, places: DataFrame) -> DataFrame:
    """Links with the root and the place of both ends."""
    for end in "ab":
        links = links.join(dealt(places.select("doc", F.col("id").alias(end), *(F.col(c).alias(f"{c}_{end}") for c in ("root", "x", "y")))), ["doc", end])
    return links


def placed(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``doc, id, root, x, y``: the smallest node that links reach, and where a node lies as seen from it.

    ``nodes(doc, id)``; ``links(doc, a, b, col, row)`` say that ``b`` lies ``col,
    row`` away from ``a``, and hold both ways.  In every round each root goes
    below the smallest root beside it, and ways to the new roots are halved; all
    documents take part at once.  Where links contradict each other the place is
    that of one of the ways, see :func:`contradicting`.
    """
    forth = links.select("doc", "a", "b", F.col("col").cast("long").alias("col"), F.col("row").cast("long").alias("row"))
    both = written(forth.union(forth.select("doc", "b", "a", -F.col("col"), -F.col("row"))).where("a <> b").distinct(), "links")
    zero = F.lit(0).cast("long")
    now = written(nodes.select("doc", "id", F.col("id").alias("root"), zero.alias("x"), zero.alias("y")).distinct(), "places")
    while True:
        ends = _with_places(both, now).where("root_a < root_b")
        below = F.struct(F.col("root_a").alias("up"), (F.col("x_a") + F.col("col") - F.col("x_b")).alias("dx"), (F.col("y_a") + F.col("row") - F.col("y_b")).alias("dy"))
        ways = written(ends.groupBy("doc", F.col("root_b").alias("root")).agg(F.min(below).alias("to")).select("doc", "root", "to.*"), "ways")
        if ways.isEmpty():
            remove(both, ways)
            return now
        held = [now, ways]
        for _ in range(3):
            on = ways.select("doc", F.col("root").alias("up"), F.col("up").alias("up2"), F.col("dx").alias("dx2"), F.col("dy").alias("dy2"))
            ways = ways.join(dealt(on), ["doc", "up"], "left").select(
                "doc", "root", F.coalesce("up2", "up").alias("up"), (F.col("dx") + F.coalesce("dx2", zero)).alias("dx"), (F.col("dy") + F.coalesce("dy2", zero)).alias("dy"))
        moved = now.join(dealt(ways), ["doc", "root"], "left").select(
            "doc", "id", F.coalesce("up", "root").alias("root"), (F.col("x") + F.coalesce("dx", zero)).alias("x"), (F.col("y") + F.coalesce("dy", zero)).alias("y"))
        now = written(moved, "places")
        remove(*held)


def contradicting(places: DataFrame, links: DataFrame) -> DataFrame:
    """``doc, root`` of nodes whose links don't agree on where they lie."""
    return _with_places(links, places).where("x_b - x_a <> col OR y_b - y_a <> row").select("doc", F.col("root_a").alias("root")).distinct()


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``doc, id, root``: the smallest node that the links ``doc, a, b`` reach."""
    return placed(nodes, links.select("doc", "a", "b", F.lit(0).alias("col"), F.lit(0).alias("row"))).select("doc", "id", "root")
