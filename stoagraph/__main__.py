"""Command line: build a graph from articles, analyse it, or export it."""

from __future__ import annotations

import argparse
import logging
import time

from stoagraph.operators import graph_queries as Q
from stoagraph.operators import pipeline
from stoagraph.operators import stats as S
from stoagraph.sources import exports as X
from stoagraph.sources.stages import StageStore


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="stoagraph")
    p.add_argument("store", help="folder of the stage tables")
    p.add_argument("--articles", help="Parquet table of articles to add")
    p.add_argument("--no-resume", action="store_true", help="extract all articles again")
    p.add_argument("--analyze", metavar="FOLDER", help="write the analyses as JSON")
    p.add_argument("--export", metavar="FOLDER", help="write the graph as Cypher, GraphML and GEXF")
    o = p.parse_args(args)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(message)s")
    log = logging.getLogger("stoagraph")
    from pyspark.sql import SparkSession

    spark, began = SparkSession.builder.getOrCreate(), time.time()
    store = StageStore(spark, o.store)
    if o.articles:
        nodes, edges = pipeline.run(spark.read.parquet(o.articles), store, not o.no_resume)
    else:
        nodes, edges = store.latest("nodes"), store.latest("edges")
    if nodes is None:
        p.error("the store holds no graph yet; give --articles")
    log.info("optional parts: %s", pipeline.available())
    log.info("%d nodes, %d edges", nodes.count(), edges.count())
    if o.analyze:
        X.write_json(S.graph_counts(nodes, edges), f"{o.analyze}/statistics")
        X.write_json(S.label_counts(nodes), f"{o.analyze}/labels")
        X.write_json(S.type_counts(edges), f"{o.analyze}/types")
        X.write_json(Q.largest_schools(nodes, edges, k=None, distinct=False), f"{o.analyze}/schools")
        X.write_json(Q.influence_scores(nodes, edges), f"{o.analyze}/influence")
        X.write_json(Q.concept_pairs(nodes, edges), f"{o.analyze}/concepts")
    if o.export:
        for name, make in (("cypher", X.cypher), ("graphml", X.graphml), ("gexf", X.gexf)):
            X.write_lines(make(nodes, edges), f"{o.export}/{name}")
    log.info("done after %.2f hours", (time.time() - began) / 3600)


if __name__ == "__main__":
    main()
