import datetime as dt

import pytest
from stoagraph.operators import pipeline
from stoagraph.sources.stages import StageStore
from stoagraph.streaming import updates as U


def test_build_resume_and_ask(spark, sf, tmp_path):
    articles = spark.read.parquet(f"{sf}/article_data.parquet")
    store = StageStore(spark, str(tmp_path / "store"))
    half = articles.filter("page_id % 2 = 0")
    pipeline.run(half, store)
    n_first = store.latest("mentions").select("article_id").distinct().count()
    nodes, edges = pipeline.run(articles, store)
    assert store.latest("mentions").select("article_id").distinct().count() > n_first > 0
    assert edges.count() > 0 and nodes.filter("label = 'Article'").count() == articles.select("id").distinct().count()
    whole = StageStore(spark, str(tmp_path / "whole"))
    pipeline.run(articles, whole)
    keys = ["source", "target", "type"]
    assert whole.latest("nodes").select("id").exceptAll(nodes.select("id")).filter("id LIKE 'article:%'").count() == 0
    assert set(store.latest("relations").columns) >= set(keys)
    assert pipeline.ask("compare realism and naturalism", nodes, edges).kind == "debate"
    net = pipeline.ask("network of realism", nodes, edges)
    assert net.kind == "network" and net.confidence == 0.85 and net.nodes.count() >= 0
    assert pipeline.ask("Who influenced Ada Lovelace", nodes, edges).kind == "influence"
    found = pipeline.ask("something about freedom", nodes, edges)
    assert found.kind == "search" and found.confidence == 0.7 and found.nodes.count() <= 20


def test_streams_equal_batches(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    counts = U.windowed_counts(stream, "ts", "event_type", "1 day", late="400 days")
    query = counts.writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    events = events.withColumn("ts", events.ts.cast("timestamp"))
    want = U.windowed_counts(events, "ts", "event_type", "1 day").selectExpr("begin", "by", "n")
    assert spark.table("windows").select("begin", "by", "n").exceptAll(want).count() == 0 and want.exceptAll(spark.table("windows").select("begin", "by", "n")).count() == 0


def test_late_rows_are_dropped_and_upserts_repeat(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    store = StageStore(spark, str(tmp_path / "store"))
    schema = "k string, t int, at timestamp"
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for i, rows in enumerate([[("a", 1, t0), ("b", 1, t0)], [("a", 3, t0), ("c", 1, t0)], [("a", 2, t0)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        U.upsert_stream(stream, store, "s", ["k"], ["t"], str(tmp_path / "c")).awaitTermination(120)
        U.upsert_stream(stream, store, "merged", ["k"], ["t"], str(tmp_path / "c3"), every=2).awaitTermination(120)
    assert len(store.deltas("s")) == 3 and not store.exists("s")
    assert len(store.deltas("merged")) == 1 and store.runs("merged") == [1]
    for stage in ("s", "merged"):
        assert {(r["k"], r["t"]) for r in store.current(stage, ["k"], ["t"]).collect()} == {("a", 3), ("b", 1), ("c", 1)}
    store.compact("s", ["k"], ["t"])
    assert store.deltas("s") == [] and {(r["k"], r["t"]) for r in store.latest("s").collect()} == {("a", 3), ("b", 1), ("c", 1)}
    assert store.current("nothing", ["k"], ["t"]) is None
    assert U.first_rows(spark.createDataFrame([("a", 1, t0), ("a", 2, t0)], schema), ["k"], "at").count() == 1
    done = U.staged(stream, lambda df: df.selectExpr("upper(k) AS k"), str(tmp_path / "out"), str(tmp_path / "c2"))
    done.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 90
    assert all(callable(q) for q in queries.values())


def test_a_missing_library_leaves_the_general_queries(monkeypatch):
    import __spark_entry__ as entry

    class Broken:
        def queries(self):
            raise ModuleNotFoundError("ahocorasick")

        oracle_sql = queries

    monkeypatch.setattr(entry, "llm_registry", Broken())
    assert "p3_found" in entry.queries() and "p3_found" in entry.oracle_sql() and "p1_found" not in entry.queries()


def test_a_cluster_without_a_shared_folder_is_refused():
    from types import SimpleNamespace as S

    from stoagraph.session import ensure_checkpoint_dir

    used = []

    def session(master, folder):
        none = S(getCheckpointDir=lambda: S(isDefined=lambda: False))
        context = S(master=master, _jsc=S(sc=lambda: none), getConf=lambda: S(get=lambda k, d: folder or d), setCheckpointDir=used.append)
        return S(sparkContext=context)

    with pytest.raises(ValueError):
        ensure_checkpoint_dir(session("spark://host:7077", ""))
    ensure_checkpoint_dir(session("spark://host:7077", "/shared"))
    ensure_checkpoint_dir(session("local[2]", ""))
    assert used[0] == "/shared" and "stoagraph-" in used[1]


class _Dies(StageStore):
    """Fails when relations are to be saved."""

    def save(self, stage, df):
        if "relations" in stage:
            raise OSError(stage)
        return super().save(stage, df)


def _article(spark, rows):
    metadata = "struct<title:string,authors:array<string>,pubdate:string,url:string,last_updated:string>"
    links = "array<struct<target:string,anchor_text:string,context:string,section:string>>"
    schema = f"page_id bigint, id string, metadata {metadata}, internal_links {links}, sections array<string>, full_text string, word_count int, fetched_at timestamp"
    return spark.createDataFrame([(p, i, (i, None, None, None, None), [], None, text, 9, at) for p, i, text, at in rows], schema)


def _rows(df):
    return sorted(map(str, df.selectExpr(*sorted(df.columns)).collect()))


def test_dead_runs_and_new_texts_lose_nothing(spark, tmp_path):
    t1, t2 = dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 1)
    text = "{} influenced {} at length. The ontological argument of realism."
    first = [(1, "a", text.format("Ada Lovelace", "Alan Turing"), t1), (2, "b", text.format("Ada Lovelace", "Alan Turing"), t1), (3, None, text.format("Mary Astell", "Anne Conway"), t1)]
    again = [(4, "a", text.format("Mary Shelley", "Alan Turing"), t2)]
    folder = str(tmp_path / "store")
    try:
        pipeline.run(_article(spark, first), _Dies(spark, folder))
        raise AssertionError("should have died")
    except OSError:
        pass
    store = StageStore(spark, folder)
    pipeline.run(_article(spark, first), store)
    for rows in (first, first + again):
        pipeline.run(_article(spark, rows), store)
        whole = StageStore(spark, str(tmp_path / f"whole{len(rows)}"))
        pipeline.run(_article(spark, rows), whole)
        for stage in ("mentions", "relations", "nodes", "edges"):
            assert _rows(store.latest(stage)) == _rows(whole.latest(stage)), stage
    found = {(r["source"], r["target"]) for r in store.latest("relations").collect()}
    assert found == {("Ada Lovelace", "Alan Turing"), ("Mary Shelley", "Alan Turing"), ("Mary Astell", "Anne Conway")}
