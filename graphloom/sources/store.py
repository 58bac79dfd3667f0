"""The property graph as stored tables: written once per session and state of the inputs, read with pruning.

The rules of `tables` stay the definition. Patterns that would run them many times over
read two Parquet tables in the shared folder instead: nodes are partitioned by their
labels and edges by their type, so that a filter on either reads only its folders. Each
folder is written for itself by the rules that make its rows, which go by without being
sorted or held. What passes the graph once reads the tables if they are there, else the
rules. A table that is rewritten (its length, files or time change) gives a new graph.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.sources import tables
from graphloom.sources.files import shared_path

#: Tables that the rules read.
INPUTS = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
#: Between the labels of a node in the name of its folder.
BETWEEN = "-"

_written: dict[tuple, object] = {}


def _state(spark: SparkSession, path: str) -> tuple[int, int, int]:
    """Length, number of files and time of a table."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    summary = fs.getContentSummary(p)
    return summary.getLength(), summary.getFileCount(), fs.getFileStatus(p).getModificationTime()


def _key(spark: SparkSession, sf_dir: str, what: str, inputs: Sequence[str]) -> tuple:
    return (what, spark.sparkContext.applicationId, sf_dir, *(_state(spark, f"{sf_dir}/{n}.parquet") for n in inputs))


def once(spark: SparkSession, sf_dir: str, what: str, inputs: Sequence[str], make: Callable[[], object]):
    """What `make` writes, made once per session and state of the input tables."""
    key = _key(spark, sf_dir, what, inputs)
    if key not in _written:
        _written[key] = make()
    return _written[key]


def graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """nodes (id, name, labels) and edges (src, dst, type, when, status), with the rows of `tables`."""

    def write() -> tuple[str, str]:
        n, e = shared_path(spark, "graph-nodes"), shared_path(spark, "graph-edges")
        kinds = tables.nodes(spark, sf_dir).select("id", "name", F.array_join("labels", BETWEEN).alias("kind"))
        for kind in sorted({BETWEEN.join(x) for x in tables.LABELS.values()}):
            kinds.filter(F.col("kind") == kind).drop("kind").write.parquet(f"{n}/kind={kind}")
        rules = tables.edges(spark, sf_dir)
        for t in tables.TYPES:
            rules.filter(F.col("type") == t).drop("type").write.parquet(f"{e}/type={t}")
        return n, e

    n, e = once(spark, sf_dir, "graph", INPUTS, write)
    nodes = spark.read.schema("id string, name string, kind string").parquet(n)
    edges = spark.read.schema("src string, dst string, when string, status string, type string").parquet(e)
    return nodes.select("id", "name", F.split("kind", BETWEEN).alias("labels")), edges.select("src", "dst", "type", "when", "status")


def once_through(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """nodes and edges for plans that pass them once: stored if a pattern has had them written, else by the rules."""
    if _key(spark, sf_dir, "graph", INPUTS) in _written:
        return graph(spark, sf_dir)
    return tables.nodes(spark, sf_dir), tables.edges(spark, sf_dir)


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once_through(spark, sf_dir)[0]


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once_through(spark, sf_dir)[1]


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a table of its own in the shared folder: plans that read it twice make it once and know its size."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Delete stored() tables that no later plan reads."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            p = spark._jvm.org.apache.hadoop.fs.Path(folder)
            p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)
