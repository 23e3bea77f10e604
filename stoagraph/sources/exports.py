"""Graphs and records written as Cypher, GraphML, GEXF and JSON."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _quoted(c: Column) -> Column:
    """A string literal with JSON escapes."""
    return F.regexp_extract(F.to_json(F.array(c)), r"(?s)^\[(.*)\]$", 1)


def _literal(name: str, kind: str) -> Column:
    c = F.col(name)
    if kind.startswith(("array", "map", "struct")):
        return _quoted(F.to_json(c))
    if kind in ("string", "date") or kind.startswith("timestamp"):
        return _quoted(c.cast("string"))
    return c.cast("string")


def _pairs(df: DataFrame, skip: set[str]) -> Column:
    """``key: value`` of the fields that are not null."""
    made = [F.when(F.col(n).isNotNull(), F.concat(F.lit(f"{n}: "), _literal(n, k))) for n, k in df.dtypes if n not in skip]
    return F.concat_ws(", ", *made)


def cypher(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(part, value)``: one MERGE statement per node (part 0) and per edge (part 1); nulls are left out."""
    label, kind = (F.regexp_replace(F.coalesce(F.col(c), F.lit("RELATED_TO")), r"[^\p{L}\p{N}_]", "_") for c in ("label", "type"))
    n = nodes.select(F.lit(0).alias("part"), F.concat(F.lit("MERGE (n:"), label, F.lit(" {id: "), _literal("id", "string"), F.lit("}) SET n += {"), _pairs(nodes, {"id", "label"}), F.lit("};")).alias("value"))
    e = edges.select(
        F.lit(1).alias("part"),
        F.concat(F.lit("MATCH (a {id: "), _literal("src", "string"), F.lit("}), (b {id: "), _literal("dst", "string"), F.lit("}) MERGE (a)-[r:"), kind, F.lit("]->(b) SET r += {"), _pairs(edges, {"src", "dst", "type"}), F.lit("};")).alias("value"),
    )
    return n.unionByName(e)


def _xml(c: Column) -> Column:
    swaps = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")]
    clean = F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    return reduce(lambda x, s: F.replace(x, F.lit(s[0]), F.lit(s[1])), swaps, clean)


def _text(name: str, kind: str) -> Column:
    return F.to_json(name) if kind.startswith(("array", "map", "struct")) else F.col(name).cast("string")


def _lines(spark, part: int, lines: list[str]) -> DataFrame:
    """Fixed lines as one row, so that they keep their order."""
    return spark.createDataFrame([(part, "\n".join(lines))], "part int, value string")


def graphml(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(part, value)``: the parts of a GraphML file in order; lists are JSON text, nulls are left out."""
    spark = nodes.sparkSession
    own = [c for c in nodes.columns if c != "id"], [c for c in edges.columns if c not in ("src", "dst")]
    keys = [f'<key id="{w[0]}_{c}" for="{w}" attr.name="{c}" attr.type="string"/>' for w, cs in zip(("node", "edge"), own, strict=True) for c in cs]

    def data(df: DataFrame, mark: str, names: list[str]) -> Column:
        kinds = dict(df.dtypes)
        return F.concat_ws("", *(F.when(F.col(c).isNotNull(), F.concat(F.lit(f'<data key="{mark}_{c}">'), _xml(_text(c, kinds[c])), F.lit("</data>"))) for c in names))

    head = ['<?xml version="1.0" encoding="UTF-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">', *keys, '<graph edgedefault="directed">']
    n = nodes.select(F.lit(1).alias("part"), F.concat(F.lit('<node id="'), _xml(F.col("id")), F.lit('">'), data(nodes, "n", own[0]), F.lit("</node>")).alias("value"))
    e = edges.select(F.lit(2).alias("part"), F.concat(F.lit('<edge source="'), _xml(F.col("src")), F.lit('" target="'), _xml(F.col("dst")), F.lit('">'), data(edges, "e", own[1]), F.lit("</edge>")).alias("value"))
    return _lines(spark, 0, head).unionByName(n).unionByName(e).unionByName(_lines(spark, 3, ["</graph>", "</graphml>"]))


def gexf(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(part, value)``: the parts of a GEXF file in order."""
    spark = nodes.sparkSession
    n = nodes.select(F.lit(1).alias("part"), F.concat(F.lit('<node id="'), _xml(F.col("id")), F.lit('" label="'), _xml(F.coalesce("name", "title", "id")), F.lit('"/>')).alias("value"))
    e = edges.select(
        F.lit(3).alias("part"), F.concat(F.lit('<edge id="'), F.md5(F.concat_ws("\n", "src", "dst", F.coalesce("type", F.lit("RELATED_TO")))), F.lit('" source="'), _xml(F.col("src")), F.lit('" target="'), _xml(F.col("dst")), F.lit('" label="'), _xml(F.coalesce("type", F.lit("RELATED_TO"))), F.lit('"/>')).alias("value")
    )
    head = ['<?xml version="1.0" encoding="UTF-8"?>', '<gexf xmlns="http://gexf.net/1.3" version="1.3">', '<graph defaultedgetype="directed">', "<nodes>"]
    return _lines(spark, 0, head).unionByName(n).unionByName(_lines(spark, 2, ["</nodes>", "<edges>"])).unionByName(e).unionByName(_lines(spark, 4, ["</edges>", "</graph>", "</gexf>"]))


def write_lines(parts: DataFrame, path: str) -> None:
    """Write ``(part, value)`` as text files whose order by name is the order of the parts."""
    parts.repartitionByRange("part", "value").sortWithinPartitions("part", "value").select("value").write.mode("overwrite").text(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
