"""Readers of networks and of capacity trees."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.network import Network


def read_edge_list(spark: SparkSession, path: str, use_weight: bool = True) -> Network:
    """Lines ``src tgt {'weight': 0.9, ...}``; without a dictionary, or with ``use_weight=False``, the weight is 1.0. A dictionary without weight gives a null line, which is dropped."""
    lines = spark.read.text(path).where("trim(value) <> ''")
    parts = F.split(F.trim("value"), r"\s+", 3)
    rows = lines.select(parts[0].alias("src"), parts[1].alias("dst"), F.size(parts).alias("n"), F.regexp_extract("value", r"""['"]weight['"]\s*:\s*([-+0-9.eE]+)""", 1).alias("w"))
    weight = F.when(F.col("n") < 3, 1.0).otherwise(F.expr("try_cast(w AS DOUBLE)"))
    rows = rows.select("src", "dst", (weight if use_weight else F.lit(1.0)).alias("weight")).where("weight IS NOT NULL")
    return Network.from_edges(rows)


_NODE = "_id string, _label string, attvalues struct<attvalue: array<struct<_for: string, _value: string>>>"
_EDGE = "_id string, _source string, _target string, _weight string"
_ATTRIBUTE = "_id string, _title string"


def read_gexf(spark: SparkSession, path: str, use_weight: bool = True) -> Network:
    """A GEXF file: a vertex's name is its attribute titled ``gname``, an edge's ends are node ids, its weight 1.0 where it has none."""
    read = lambda tag, schema: spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
    title = read("attribute", _ATTRIBUTE).where("_title = 'gname'").select(F.col("_id").alias("for_id"))
    values = read("node", _NODE).select("_id", F.explode("attvalues.attvalue").alias("a"))
    names = values.join(F.broadcast(title.distinct()), F.col("a._for") == F.col("for_id")).select("_id", F.col("a._value").alias("name"))
    edges = read("edge", _EDGE).select("_source", "_target", F.coalesce(F.expr("try_cast(_weight AS DOUBLE)"), F.lit(1.0)).alias("weight"))
    edges = edges.join(names.select(F.col("_id").alias("_source"), F.col("name").alias("src")), "_source").join(names.select(F.col("_id").alias("_target"), F.col("name").alias("dst")), "_target")
    out = Network.from_edges(edges.select("src", "dst", F.col("weight") if use_weight else F.lit(1.0).alias("weight")))
    return Network(names.select("name").distinct(), out.edges)


def write_edge_list(network: Network, path: str) -> None:
    """Lines that ``read_edge_list`` reads."""
    line = F.format_string("%s %s {'weight': %s}", "src", "dst", F.col("weight").cast("string"))
    network.edges.select(line.alias("value")).write.text(path)


def write_gexf(network: Network, path: str) -> None:
    """A folder of files that ``read_gexf`` reads together, each a document by itself: the attribute of names, nodes, edges with weights."""

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch = lambda lines: pa.RecordBatch.from_arrays([lines], ["value"])
        yield batch(pa.array(["<gexf><graph>"]))
        yield from (batch(x.column(0)) for x in batches)
        yield batch(pa.array(["</graph></gexf>"]))

    escaped = lambda c: F.replace(F.replace(F.replace(F.col(c).cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    head = network.edges.sparkSession.sql("""SELECT '<attribute id="0" title="gname" type="string"/>' AS value""")
    nodes = network.vertices.select(F.format_string('<node id="%s" label="%s"><attvalues><attvalue for="0" value="%s"/></attvalues></node>', *[escaped("name")] * 3).alias("value"))
    edges = network.edges.select(F.format_string('<edge source="%s" target="%s" weight="%s"/>', escaped("src"), escaped("dst"), F.col("weight").cast("string")).alias("value"))
    head.union(nodes).union(edges).mapInArrow(documents, "value string").write.text(path)


def write_tree(tree: DataFrame, path: str) -> None:
    """Lines of three fields separated by spaces."""
    tree.select(F.concat_ws(" ", F.col("s").cast("string"), F.col("t").cast("string"), F.col("capacity").cast("string")).alias("value")).write.text(path)


def read_flows(spark: SparkSession, path: str) -> DataFrame:
    """``(u, v, flow)`` from tab-separated lines."""
    return spark.read.csv(path, sep="\t", schema="u string, v string, flow double")


def write_fasta(sequences: DataFrame, path: str, width: int = 60) -> None:
    """``(id, sequence)`` as header lines and lines of ``width`` letters."""
    lines = F.regexp_replace("sequence", f"(.{{{width}}})(?=.)", "$1\n")
    sequences.select(F.concat(F.lit(">"), F.col("id").cast("string"), F.lit("\n"), lines).alias("value")).write.text(path)


def read_tree(spark: SparkSession, path: str) -> DataFrame:
    """``(s, t, capacity)`` from lines of three fields separated by spaces."""
    return spark.read.csv(path, sep=" ", schema="s string, t string, capacity double")


def write_flows(flows: DataFrame, path: str) -> None:
    """``(u, v, flow)`` as tab-separated lines."""
    flows.select("u", "v", "flow").write.csv(path, sep="\t")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """``(id, sequence)``: the first word of a header line, and its lines joined."""
    rows = spark.read.text(path, lineSep=">").where("trim(value) <> ''")
    head = F.substring_index("value", "\n", 1)
    return rows.select(F.split(F.trim(head), r"\s+")[0].alias("id"), F.regexp_replace(F.substring("value", F.length(head) + 1, F.length("value")), r"\s+", "").alias("sequence"))
