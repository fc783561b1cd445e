"""Changes, commands, stores, streams and edge cases on small literals."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera import queries
from tessera.functions import fulltext as ft
from tessera.functions import scalar as s
from tessera.operators import dml, graph, metrics, relational, vector
from tessera.plans import explain, nql, shards, statements, stats
from tessera.sources import files
from tessera.sources.database import SEGMENTS, Database, Exists, Missing, ResultCache
from tessera.sources.shared import shared_dir
from tessera.sources.storage import MemoryStorage, ParquetStorage
from tessera.streaming import windows


def values(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture
def db(spark, tmp_path):
    return Database(spark, str(tmp_path / "db"))


def people(db):
    db.create_table("people", [{"name": "id", "type": "integer"}, {"name": "name", "type": "string", "nullable": False}, {"name": "age", "type": "integer", "default": 30}])
    db.insert("people", [{"id": 1, "name": "Ann"}, {"id": 2, "name": "Bo", "age": None}, {"id": 3, "name": "Cy", "age": 51}])


def test_table_life(db):
    people(db)
    with pytest.raises(Exists):
        db.create_table("people", [{"name": "x"}])
    with pytest.raises(ValueError):
        db.create_table("none", [])
    with pytest.raises(ValueError):
        db.insert("people", [{"id": 9, "name": None}])
    with pytest.raises(ValueError):
        db.insert("people", [{"other": 1}])
    assert values(db.table("people")) == [(1, "Ann", 30), (2, "Bo", None), (3, "Cy", 51)]
    assert values(db.lookup("people", 2)) == [(2, "Bo", None)]
    assert db.update("people", {"age": 0}, F.col("age") > 40) == 1 and db.delete("people", F.col("age").isNull()) == 1
    assert values(db.table("people")) == [(1, "Ann", 30), (3, "Cy", 0)]
    assert values(db.sql("SELECT count(*) FROM people WHERE age < 10")) == [(1,)]
    assert [c["primary_key"] for c in db.describe("people")] == [True, False, False]
    db.drop_table("people")
    with pytest.raises(Missing):
        db.table("people")


def test_transactions_are_all_or_nothing(db):
    people(db)
    with pytest.raises(RuntimeError), db.transaction():
        db.delete("people")
        raise RuntimeError
    assert db.table("people").count() == 3
    batch = [{"op": "insert", "into": "people", "values": [{"id": 4, "name": "Di"}]}, {"op": "update", "table": "people", "set": {"age": 1}, "where": {"field": "id", "eq": 4}}]
    assert nql.execute(db, {"op": "transaction", "commands": batch}) == 2
    with pytest.raises(nql.CommandError):
        nql.execute(db, {"op": "transaction", "commands": [{"op": "delete", "from": "people"}, {"op": "nothing"}]})
    assert db.table("people").count() == 4 and values(db.lookup("people", 4)) == [(4, "Di", 1)]


def test_commands_for_documents_graphs_and_vectors(db):
    run = lambda **c: nql.execute(db, c)
    for i, author in enumerate(["Ann", "Bo"]):
        run(op="insert", collection="posts", document={"id": str(i), "author": author, "meta": {"likes": i}, "body": "Spark joins rows"})
    assert [r.doc_id for r in run(op="search", collection="posts", query={"field": "author", "eq": "Bo"}, fulltext={"field": "body", "match": "rows spark"}).collect()] == ["1"]
    assert [r.doc_id for r in run(op="search", collection="posts", query={"field": "meta.likes", "eq": "0"}).collect()] == ["0"]
    db.put_documents("posts", {"1": {"author": "Cy"}})
    assert sorted((r.doc_id, r.version) for r in db.documents("posts").collect()) == [("0", 1), ("1", 2)]
    db.create_graph("g")
    for n in "abc":
        run(op="graph_add_node", graph="g", node={"id": n, "label": "N"})
    for a, b in ("ab", "bc", "ab"):
        run(op="graph_add_edge", graph="g", edge={"from": a, "to": b, "label": "R"})
    assert [(r.path, r.hops) for r in run(op="graph_traverse", graph="g", start="a", end="c", max_depth=3).collect()] == [(["a", "b", "c"], 2)]
    assert run(op="graph_traverse", graph="g", start="c", end="a").collect() == []
    assert values(graph.neighbours(db.edges("g"), "a")) == [("b",), ("b",)]
    db.create_vectors("v", 2)
    for name, v in (("x", [1, 0]), ("y", [0, 1]), ("z", [1, 0.1])):
        run(op="vector_insert", collection="v", vector={"text": name, "embedding": v})
    assert [r.id for r in run(op="vector_search", collection="v", vector=[1, 0], k=2).collect()] == ["x", "z"]
    assert [r.id for r in run(op="vector_search", collection="v", vector=[1, 0], threshold=0.999).collect()] == ["x"]
    with pytest.raises(nql.CommandError):
        run(op="vector_insert", collection="v", vector={"text": "bad", "embedding": [1, 2, 3]})
    assert tuple(db.summary().select("tables", "collections", "graphs", "vector_collections").first()) == (0, 1, 1, 1)


def test_error_codes_and_envelopes(db):
    people(db)
    code = lambda **c: nql.envelope(db, c)["error"]["code"]
    assert code(op="select", **{"from": "nobody"}) == "TABLE_NOT_FOUND"
    assert code(op="select", **{"from": "people"}, where={"field": "height", "gt": 1}) == "COLUMN_NOT_FOUND"
    assert code(op="select", **{"from": "people"}, where={"field": "id", "about": 1}) == "INVALID_QUERY"
    assert code(op="create_table", name="people", columns=[{"name": "a"}]) == "ALREADY_EXISTS"
    assert code(op="fly") == "INVALID_QUERY"
    good = nql.envelope(db, {"op": "select", "from": "people", "columns": ["name"], "order_by": [{"field": "id", "desc": True}], "limit": 1})
    assert good["success"] and good["result"]["rows"] == [{"name": "Cy"}]


def test_key_values(db):
    db.put("kv", {"a:1": {"x": 1}, "a:2": None, "b:1": 3})
    db.put("kv", {"a:1": 5})
    assert values(db.scan("kv", "a:")) == [("a:1", "5"), ("a:2", "null")]
    db.remove("kv", "a:1")
    assert db.scan("kv").count() == 2


def test_values_parser():
    assert dml.parse_values("(1, 'it''s, ok', NULL), (-2.5, word, true)") == [[1, "it's, ok", None], [-2.5, "word", True]]
    with pytest.raises(ValueError):
        dml.parse_values("(1, 'open")


def test_joins_match_nulls_and_keep_schemas(spark):
    a = spark.createDataFrame([(1, "x"), (None, "n"), (1, "y")], "k int, a string")
    b = spark.createDataFrame([(1, "p"), (None, "q"), (7, "r")], "k int, b string")
    assert relational.join(a, b, [("k", "k")], "full", prefixes=("a", "b")).count() == 4
    assert relational.join(a, b.limit(0), [("k", "k")], "left", prefixes=("a", "b")).columns == ["a_k", "a_a", "b_k", "b_b"]
    assert relational.join(a, b, [("k", "k")], "anti", nulls_match=False).count() == 1
    with pytest.raises(ValueError):
        relational.join(a, b, [("k", "k")], "sideways")


def test_aggregates_on_nothing_and_nulls(spark):
    df = spark.createDataFrame([(None,), (2.0,), (4.0,)], "v double")
    items = [("n", "COUNT", None), ("m", "count", "v"), ("t", "sum", "v"), ("a", "avg", "v")]
    assert values(relational.aggregate(df, [], items)) == [(3, 2, 6.0, 3.0)]
    assert values(relational.aggregate(df.limit(0), [], items)) == [(0, 0, None, None)]
    with pytest.raises(ValueError):
        relational.aggregate(df, [], [("x", "median", "v")])


def test_window_ties(spark):
    df = spark.createDataFrame([("a", 5), ("a", 5), ("a", 3), ("b", None)], "d string, v int")
    got = relational.window(relational.window(df, "r", "rank", ["d"], [("v", False)]), "q", "dense_rank", ["d"], [("v", False)])
    assert values(got.select("d", "r", "q")) == [("a", 1, 1), ("a", 1, 1), ("a", 3, 2), ("b", 1, 1)]
    assert {r.l for r in relational.window(df, "l", "last_value", ["d"], [("v", True)], column="v").where("d = 'a'").collect()} == {5}


def test_scalar_subquery_fails_on_two_rows(spark):
    two = spark.range(2)
    with pytest.raises(Exception, match="SCALAR_SUBQUERY"):
        spark.range(1).select(relational.scalar(two)).collect()


def test_trims_and_rounds(spark):
    row = spark.range(1).select(s.trim(F.lit(" \n x \t")).alias("t"), s.rounded(F.lit(-2.5)).alias("r"), s.cast(F.lit("Yes"), "bool").alias("b"), s.length(F.lit("é")).alias("n")).first()
    assert tuple(row) == ("x", -3.0, True, 2)


def test_tokens_stems_and_odd_texts(spark):
    docs = spark.createDataFrame([(1, "The (needed) boss's a É! running"), (2, ""), (3, None)], "doc_id int, text string")
    assert [r.term for r in ft.tokens(docs).orderBy("position").collect()] == ["the", "needed", "boss's", "é", "running"]
    assert [r.term for r in ft.tokens(docs, stop=True, stemmed=True).orderBy("position").collect()] == ["ne", "boss'", "é", "runn"]
    assert ft.bm25(docs, ["running"]).count() == 1 and ft.search_any(docs, ["nothing"]).count() == 0
    assert spark.range(1).select(ft.stem(F.lit("needed"))).first()[0] == "ne"


def test_cosine_sentinel(spark):
    rows = [([1.0, 0.0], [2.0, 0.0], 0.0), ([1.0], [1.0, 2.0], 2.0), ([], [], 2.0), ([0.0], [1.0], 2.0), (None, [1.0], 2.0)]
    df = spark.createDataFrame(rows, "a array<float>, b array<float>, want double")
    assert all(r.d == r.want for r in df.withColumn("d", vector.cosine_distance(F.col("a"), F.col("b"))).collect())
    assert vector.wrong_dimension(df, 2, "a").count() == 4


def test_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1)], "src int, dst int")
    assert values(graph.on_cycles(edges, 3)) == [(1,), (2,), (3,)] and graph.on_cycles(edges, 2).count() == 0


def test_constraints_with_nulls(spark):
    df = spark.createDataFrame([(1, 1), (1, None), (None, 3)], "k int, v int")
    assert dml.primary_key_violations(df, "k").count() == 2
    assert dml.unique_violations(df, ["k", "v"]).count() == 0 and dml.check_violations(df, F.col("v") > 2).count() == 1
    assert values(dml.foreign_key_violations(df, "v", spark.createDataFrame([(1,), (None,)], "id int"), "id")) == [(None, 3)]


def test_a_band_join_cuts_frequent_bins_and_loses_no_pair(spark, monkeypatch):
    monkeypatch.setattr(relational, "SIDE", 4, raising=False)
    monkeypatch.setattr(relational, "PIECE", 50, raising=False)
    odd = [float("nan"), float("inf"), float("-inf"), None, 1e300, -100.0, 0.1, 100.1]
    a = spark.createDataFrame([(i, i % 2 or None, odd[i % 8] if i % 3 else 7.0 * i) for i in range(60)], "a int, ak int, av double")
    b = spark.createDataFrame([(i, i % 3 or None, odd[i % 8] if i % 3 else 11.0 * i) for i in range(90)], "b int, bk int, bv double")
    want = a.join(b, (F.col("ak") == F.col("bk")) & F.col("bv").between(F.col("av") - 100, F.col("av") + 100))
    got = relational.band_join(a, b, [("ak", "bk")], ("av", "bv"), 100)
    assert values(got.select("a", "b")) == values(want.select("a", "b")) and got.count() > 90
    text = queries.queries()["join_theta_range"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "_bin" in text  # not by the nation alone, of which there are 25


def test_log_replay(spark):
    log = spark.createDataFrame([(1, "a", "put", "Committed", "1"), (2, "a", "put", "Active", "2"), (3, "b", "put", "Committed", "3"), (4, "b", "delete", "Committed", None)], "lsn int, key string, operation string, status string, value string")
    assert [r.value for r in dml.replay(log).collect()] == ["1"]


def test_estimates_and_ring():
    assert stats.selectivity("eq", ndv=4) == 0.25 and stats.selectivity("like") == 0.1 and stats.selectivity("null", nulls=1, rows=4) == 0.25
    assert stats.output_rows(10, [0.25, 0.5]) == 2 and stats.predicate_order({"b": 0.1, "a": 0.5}) == ["b", "a"]
    assert len(stats.ring(["n1", "n2"], 16)) == 32 and stats.bloom_size(0)[0] == 8


def test_the_ring_hashes_a_key_once(spark):
    keys, places = ["", "a", "é☃😀\x00", "x" * 300, "\n\\ ", None], stats.ring(["n1", "n2", "n3"], 16)
    df = spark.createDataFrame([(k,) for k in keys], "k string").select("k", stats.djb2(F.col("k")).alias("h"), stats.node_of(F.col("k"), places).alias("node"))
    for k, h, node in df.collect():
        assert h == (None if k is None else stats._djb2(k)) and node == next((n for at, n in places if k is not None and at >= h), places[0][1])
    text = spark.range(9).select(stats.node_of(F.col("id").cast("string"), places).alias("node"))
    text = text._jdf.queryExecution().optimizedPlan().toString()
    assert text.index("aggregate(") < text.index("filter(") and text.count("aggregate(") == 1  # not within the filter, which asks for every place


def test_bloom_has_no_false_negatives(spark):
    df = spark.range(2000).withColumnRenamed("id", "k")
    bits = stats.bloom_filter(df.where("k < 100"), "k", 100)
    kept = {r.k for r in stats.bloom_members(df, "k", bits, 100).collect()}
    assert set(range(100)) <= kept and len(kept) < 180


def test_result_cache(spark):
    cache = ResultCache(1)
    for key in ("a", "a", "b"):
        cache.get(key, lambda: spark.range(1))
    assert len(cache) == 1 and cache.hit_ratio == pytest.approx(1 / 3)


def test_files_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k long, v string")
    for kind in ("parquet", "json", "orc"):
        files.write(df, str(tmp_path / kind), kind)
        assert values(files.read(spark, str(tmp_path / kind), kind).select("k", "v")) == values(df)
    files.write(df, str(tmp_path / "csv"), "csv", header=True)
    assert files.read(spark, str(tmp_path / "csv"), "csv", header=True, inferSchema=True).count() == 2


def test_streams(spark, tmp_path):
    spark.createDataFrame([(i, i % 2) for i in range(100)], "n long, k int").select(F.expr("timestamp_seconds(n * 60)").cast("timestamp_ntz").alias("ts"), "k").coalesce(1).write.parquet(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema("ts timestamp_ntz, k int").parquet(str(tmp_path / "in"))
    made = {
        "tumbling": windows.windowed(source(), "ts", "1 hour", "30 minutes", ["k"], F.count("*").alias("n")),
        "sliding": windows.windowed(source(), "ts", "1 hour", "1 hour", [], F.count("*").alias("n"), slide="30 minutes"),
        "session": windows.sessions(source(), "ts", "1 hour", "10 minutes", ["k"], F.count("*").alias("n")),
    }
    for name, df in made.items():
        query = df.writeStream.format("memory").queryName(f"s_{name}").outputMode("complete").option("checkpointLocation", str(tmp_path / f"c_{name}")).trigger(availableNow=True).start()
        query.awaitTermination(120)
    assert spark.table("s_tumbling").count() == 8 and spark.table("s_tumbling").agg(F.sum("n")).first()[0] == 100
    assert spark.table("s_sliding").agg(F.sum("n")).first()[0] == 200 and spark.table("s_session").count() == 2
    once = windows.deduplicated(source(), "ts", "5 hours", ["k"])
    query = once.writeStream.format("memory").queryName("s_once").outputMode("append").option("checkpointLocation", str(tmp_path / "c_once")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.table("s_once").count() == 2


def test_metrics(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(1, 11)] + [("b", None)], "k string, v double")
    assert values(metrics.metric_stats(df, "k", "v")) == [("a", 10, 1.0, 10.0, 5.5, 10.0, 10.0)]


def test_keys_and_constraints(db):
    db.create_table("t", [{"name": "id"}, {"name": "mail", "unique": True}, {"name": "age", "type": "integer"}], checks={"grown": "age >= 18"})
    db.create_table("o", [{"name": "id"}, {"name": "t", "type": "string"}], references=[("t", "t", "id")])
    db.insert("t", [{"id": "a", "mail": "x", "age": 20}, {"id": "b", "mail": None, "age": None}])
    db.insert("t", [{"id": "a", "mail": "y", "age": 21}])
    assert values(db.table("t")) == [("a", "y", 21), ("b", None, None)]
    for bad in ([{"id": None}], [{"id": "c"}, {"id": "c"}], [{"id": "c", "mail": "y"}], [{"id": "c", "age": 3}]):
        with pytest.raises(ValueError):
            db.insert("t", bad)
    for bad in ({"id": None}, {"id": "z"}, {"mail": "same"}, {"age": 1}):
        with pytest.raises(ValueError):
            db.update("t", bad)
    db.insert("o", [{"id": "1", "t": "a"}, {"id": "2"}])
    with pytest.raises(ValueError):
        db.insert("o", [{"id": "3", "t": "nobody"}])
    assert db.update("t", {"id": "q"}, F.col("id") == "b") == 1 and [r.id for r in db.table("t").orderBy("id").collect()] == ["a", "q"]


def test_registered_tables_are_tables(spark, db):
    db.register("n", spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string"))
    assert db.names() == ["n"] and [c["primary_key"] for c in db.describe("n")] == [True, False]
    with pytest.raises(Exists):
        db.register("n", spark.range(1))
    with pytest.raises(Exists):
        db.create_table("n", [{"name": "x"}])
    assert nql.execute(db, {"op": "update", "table": "n", "set": {"v": "c"}, "where": {"field": "k", "eq": 2}}) == 1
    assert values(db.table("n")) == [(1, "a"), (2, "c")] and values(db.sql("SELECT v FROM n WHERE k = 2")) == [("c",)]
    db.drop_table("n")
    assert db.names() == []


def test_segments_become_one(db):
    for i in range(SEGMENTS + 3):
        db.put("kv", {"k": i, f"k{i}": i})
    assert db.get("kv", "k") == SEGMENTS + 2 and db.count("kv") == SEGMENTS + 4 and len(db._read()["kv:kv"]["segments"]) < SEGMENTS
    db.create_graph("g")
    db.add_nodes("g", [("a", "x", {}), ("a", "y", {})])
    db.add_nodes("g", [("a", "z", {})])
    assert [r.label for r in db.node("g", "a").collect()] == ["z"] and db.graphs() == ["g"]


def test_documents_by_type_and_version(db):
    db.create_collection("c")
    db.put_documents("c", {"1": {"n": 7, "tags": ["a", "b"], "ok": True}, "2": {"n": "text", "tags": "a"}, "3": {"n": None}})
    ids = lambda **q: sorted(r.doc_id for r in nql.execute(db, {"op": "search", "collection": "c", "query": q}).collect())
    assert ids(field="n", gt=5) == ["1"] and ids(field="n", eq="text") == ["2"] and ids(field="tags", **{"in": ["a", "z"]}) == ["1", "2"]
    assert ids(field="ok", eq=True) == ["1"] and ids(field="n", between=[1, 9]) == ["1"] and ids(field="n", **{"in": [7]}) == ["1"]
    db.put_documents("c", {"1": {"n": 8}})
    assert [db.document("c", "1", v).selectExpr("try_variant_get(data, '$.n', 'int') AS n").first().n for v in (1, 2)] == [7, 8]
    with pytest.raises(nql.CommandError):
        nql.execute(db, {"op": "transaction", "isolation": "chaos", "commands": []})
    assert nql.execute(db, {"op": "transaction", "isolation": "read committed", "commands": []}) == 0


def test_cache_forgets_after_its_time(spark):
    now = [0.0]
    cache = ResultCache(5, ttl=10, clock=lambda: now[0])
    cache.get("a", lambda: spark.range(1))
    now[0] = 11
    cache.get("a", lambda: spark.range(2))
    assert cache.misses == 2 and cache.hits == 0


def test_statements(spark):
    assert statements.classify(spark, "WITH c AS (SELECT * FROM a) SELECT * FROM c, b") == statements.Statement("select", ("c", "b", "a")) or set(statements.classify(spark, "WITH c AS (SELECT * FROM a) SELECT * FROM c, b").tables) >= {"a", "b"}
    with pytest.raises(ValueError):
        statements.classify(spark, "SELEC a FORM b")


def test_plans_are_explained_and_compared(spark, db):
    people(db)
    rows = nql.execute(db, {"op": "explain", "query": {"op": "select", "from": "people", "where": {"field": "id", "gt": 1}}}).collect()
    assert any("Scan" in r.operator for r in rows) and rows[0].depth == 0
    few, many = spark.range(10), spark.range(10**6)
    assert explain.cheapest(many, few) is few and explain.cost(many.orderBy("id")) > explain.cost(many)
    assert "Physical Plan" in explain.text(few)


def test_shards_move_to_even_out(spark):
    m = shards.Shards([shards.Shard("a", "x", None, 10), shards.Shard("b", "x", 10, 40), shards.Shard("c", "y", 50)])
    df = spark.range(60)
    assert values(m.rows(df, "id")) == [("a", "x", 10), ("b", "x", 30), ("c", "y", 10), (None, None, 10)]
    for bad in (shards.Shard("d", "y", 5, 6), shards.Shard("a", "y", 40, 50), shards.Shard("e", "y", 60, None)):
        with pytest.raises(ValueError):
            m.add(bad)
    moves = m.plan(df, "id")
    assert moves == [("a", "x", "y")] and m.progress == 1
    m.start(moves)
    assert m.progress == 0
    m.finish("a")
    assert m.progress == 1 and m.shards["a"].node == "y" and m.plan(df, "id") == []
    m.remove("b")
    with pytest.raises(LookupError):
        m.remove("b")


def test_storages_agree(spark, tmp_path):
    for store in (MemoryStorage(spark), ParquetStorage(spark, f"file://{tmp_path}")):
        store.put({"a1": "1", "a2": "2", "b": "3"})
        store.flush()
        store.put({"a1": "9"})
        store.delete("a2")
        assert values(store.scan("a")) == [("a1", "9")] and store.get("a2") is None and store.get("b") == "3" and store.count() == 2
        store.flush()
        store.compact()
        assert values(store.scan()) == [("a1", "9"), ("b", "3")]


def test_numbers_over_all_rows(spark):
    df = spark.createDataFrame([(i * 7 % 50, None if i % 9 == 0 else i) for i in range(50)], "a int, b int")
    got = {r.a: r.n for r in relational.window(df, "n", "row_number", [], [("b", False), ("a", True)]).collect()}
    order = sorted(df.collect(), key=lambda r: (r.b is not None, -(r.b or 0), r.a))
    assert got == {r.a: i for i, r in enumerate(order, 1)}
    assert relational.numbered(df.limit(0), "n", [("a", True)]).count() == 0


def test_metric_stats_with_one_key_in_most_rows(spark):
    df = spark.createDataFrame([("a", float(i % 300)) for i in range(2000)] + [("b", 1.0), (None, 4.0)], "k string, v double")
    a = sorted(float(i % 300) for i in range(2000))
    want = [("a", 2000, 0.0, 299.0, sum(a) / 2000, a[1900], a[1980]), ("b", 1, 1.0, 1.0, 1.0, 1.0, 1.0), (None, 1, 4.0, 4.0, 4.0, 4.0, 4.0)]
    assert values(metrics.metric_stats(df, "k", "v")) == sorted(want, key=repr)


def test_boolean_casts(spark):
    row = spark.range(1).select(*[s.cast(F.lit(v), "bool").alias(f"c{i}") for i, v in enumerate([0, 2, -1, 0.5, "2", "YES", True, None])]).first()
    assert list(row) == [False, True, True, True, False, True, True, None]


def test_sessions_by_fractions_of_seconds(spark):
    df = spark.createDataFrame([("u", "2024-01-01 00:00:00"), ("u", "2024-01-01 00:00:10.9"), ("u", "2024-01-01 00:00:20.9")], "u string, t string").withColumn("t", F.col("t").cast("timestamp_ntz"))
    assert sorted(r.n for r in metrics.sessions(df, "u", "t", 10).collect()) == [1, 2]


def test_vectors_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(vector, "QUERY_BLOCK", 3)
    rows = [(i, [float(i % 5), float(i % 3), 1.0]) for i in range(40)] + [(100, [0.0, 0.0, 0.0]), (101, [1.0]), (102, None)]
    df = spark.createDataFrame(rows, "vec_id int, embedding array<float>")
    near = {(r.query, r.place): r.vec_id for r in vector.knn_of(df, df.where("vec_id < 8"), 3).collect()}
    assert len(near) == 24 and all((q, 1) in near for q in range(8)) and near[0, 1] == 15
    assert {r.vec_id for r in vector.within(df, df.where("vec_id = 0"), 0.999).collect()} == {15, 30}
    index = vector.InvertedLists(df, 4)
    assert index.rows.count() == 43 and index.search(df.where("vec_id < 8"), 3, probes=4).count() == 24


def test_an_index_is_searched_in_blocks_as_brute_force_is(spark):
    rows = [(i, [float(i % 7), float(i % 5), 1.0]) for i in range(60)] + [(100, [0.0, 0.0, 0.0]), (101, [1.0, 2.0]), (102, [2.0, 4.0]), (103, None)]
    df = spark.createDataFrame(rows, "vec_id int, embedding array<float>")
    asked = df.where("vec_id % 4 = 0 or vec_id > 99")
    index = vector.InvertedLists(df, 4)
    found = index.search(asked, 3, probes=4)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()  # no row for each pair
    assert values(found) == values(vector.knn_of(df, asked, 3))
    place, own = {r.vec_id: r._list for r in index.rows.collect()}, index.search(asked, 3, probes=1).collect()
    assert all(place[r.query] == place[r.vec_id] for r in own) and len({r["query"] for r in own}) > 8


def test_distances_are_held_in_tiles(monkeypatch):
    monkeypatch.setattr(vector, "QUERY_TILE", 4, raising=False)
    monkeypatch.setattr(vector, "VECTOR_TILE", 8, raising=False)
    v, seen = np.random.default_rng(1).normal(size=(20, 3)), []
    batch = pa.RecordBatch.from_arrays([pa.array(range(20)), pa.array(v.tolist())], ["vec_id", "embedding"])

    class Shipped:
        value = pa.array(range(10)), {3: (np.arange(10), vector._unit(batch["embedding"], 3)[:10], None)}

    def keep(distance):
        seen.append(distance.shape)
        return distance < 3

    found = pa.Table.from_batches(vector._against(Shipped, "vec_id", "embedding", keep)(iter([batch]))).to_pydict()
    assert len({*zip(found["query"], found["vec_id"], strict=True)}) == 200 and max(a for a, _ in seen) == 4 and max(b for _, b in seen) == 8


def test_terms_are_counted_in_one_pass(spark):
    texts = ["The (the) the-the them 'the' new york, New York!", "a A É (é) c++ c+ the", " \t\n", "", None, "the\u00a0the x.y ((x.y)) _x x_", "...", "the"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    terms = ["the", "them", "a", "é", "new york", "c++", "x.y", "_x", "", "the-the", "..."]
    one = [ft.term_count(F.col("text"), t) for t in terms]
    for some in (terms, ["the", "them", "é"], ["c++"]):
        names = [f"t{i}" for i in range(len(some))]
        want = docs.select("doc_id", ft.word_count(F.col("text")).alias("_len"), *(one[terms.index(t)].alias(n) for t, n in zip(some, names, strict=True)))
        assert values(ft._counted(docs, some, names, "doc_id", "text")) == values(want)
    plan = ft.bm25(docs, ["the", "them"])._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan and "text" not in plan  # the counts are made once, for the table and for each document


def test_postings_are_made_without_a_shuffle(spark):
    texts = ["b a b (B) É", None, "", " . ", "a " * 500, "The cat, the (dog).", "x.y b a"] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    want = lambda d: ft.tokens(d).groupBy("term", "doc_id").agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("position")).alias("positions"))
    got = ft.postings(docs)
    assert got.dtypes == want(docs).dtypes and values(got) == values(want(docs))
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    twice = docs.select(F.when(F.col("doc_id") % 5 > 0, F.col("doc_id") % 5).alias("doc_id"), "text")  # keys that repeat, null too
    assert values(ft.postings(twice)) == values(want(twice))
    batch = pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array([["a", "b", "a"], [], None] * 3)], ["k", "_tokens"])
    whole, ft_tokens = [pa.Table.from_batches(ft._grouped("k")(iter([batch]))).to_pylist()], ft.TOKENS
    try:
        for ft.TOKENS in (1, 4, 6):
            whole.append(pa.Table.from_batches(ft._grouped("k")(iter([batch.slice(1)]))).to_pylist())
    finally:
        ft.TOKENS = ft_tokens
    assert whole[0] == [{"term": t, "k": k, "tf": n, "positions": p} for k in (0, 3, 6) for t, n, p in (("a", 2, [0, 2]), ("b", 1, [1]))] and all(x == whole[0][2:] for x in whole[1:])


def test_postings_are_searched_by_bucket(spark, tmp_path):
    docs = spark.createDataFrame([(1, "The cat, the (dog)."), (2, "a.b dog"), (3, None), (4, "")], "doc_id int, text string")
    index = ft.Index.build(docs, f"file://{tmp_path}/i")
    assert values(index.search(["DOG"])) == [(1,), (2,)] and values(index.search(["dog", "cat"])) == [(1,)] and values(index.search(["cat", "a.b"], every=False)) == [(1,), (2,)]
    assert values(ft.search_all(docs, ["dog", "cat"])) == [(1,)] and values(ft.search_any(docs, ["a.b", "x"])) == [(2,)]
    key = lambda df: {r.doc_id: round(r.score, 9) for r in df.collect()}
    assert key(index.bm25(["the", "dog"])) == key(ft.bm25(docs, ["the", "dog"]))
    assert "PartitionFilters: [isnotnull(bucket" in index.postings(["dog"])._jdf.queryExecution().toString() or "PartitionFilters: [bucket" in index.postings(["dog"])._jdf.queryExecution().toString()


def test_an_index_shuffles_its_postings_once_and_keeps_terms_together(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"w{i % 7} x{i % 11} w{i % 7} yy") for i in range(200)], "doc_id int, text string")
    plan = ft.Index.bucketed(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Sort ") == 1
    index = ft.Index.build(docs, f"file://{tmp_path}/i")
    stored = spark.read.parquet(f"file://{tmp_path}/i/postings")
    assert values(stored.select("term", "doc_id", "tf", "positions")) == values(ft.postings(docs)) and index.postings(["yy"]).count() == 200
    by_file = {}
    for r in stored.select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at"), "term", "doc_id").collect():
        by_file.setdefault(r.file, []).append((r["at"], (r.term, r.doc_id)))
    assert all([x for _, x in sorted(rows)] == sorted(x for _, x in rows) for rows in by_file.values())


def test_a_cluster_must_name_the_shared_folder():
    class Cluster:
        class conf:  # noqa: N801
            get = staticmethod(lambda *a: None)

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Cluster)
