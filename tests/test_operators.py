"""Operators whose edge cases the tables do not hold."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import dml
from tessera.operators import relational as R
from tessera.operators import spatial as SP
from tessera.operators import text as T
from tessera.operators import vector as V
from tessera.plans.dialect import to_spark


@pytest.mark.parametrize(
    "sql,want",
    [
        ("SELECT a FROM t LIMIT 5, 10", "SELECT a FROM t LIMIT 10 OFFSET 5"),
        ("SELECT 'LIMIT 5, 10 QUALIFY' FROM t", "SELECT 'LIMIT 5, 10 QUALIFY' FROM t"),
        ("SELECT IIF(a > 1, 'x', 'y') FROM t", "SELECT if(a > 1, 'x', 'y') FROM t"),
        ("SELECT a FROM t GROUP BY a, ROLLUP(b)", "SELECT a FROM t GROUP BY ROLLUP(a, b)"),
        ("SELECT GROUP_CONCAT(a ORDER BY b SEPARATOR ';') FROM t", "SELECT listagg(a, ';') WITHIN GROUP (ORDER BY b) FROM t"),
        ("SELECT last_value(a IGNORE NULLS) OVER w FROM t", "SELECT last_value(a) IGNORE NULLS OVER w FROM t"),
    ],
)
def test_dialect(sql, want):
    assert " ".join(to_spark(sql).split()) == want


def test_dialect_needs_aliases_under_qualify():
    with pytest.raises(ValueError):
        to_spark("SELECT a + 1 FROM t QUALIFY row_number() OVER (ORDER BY a) = 1")


def test_null_aware_anti(spark):
    a = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    one = spark.createDataFrame([(1,)], "j int")
    assert [r[0] for r in R.null_aware_anti(a, one, "k", "j").collect()] == [2]
    assert R.null_aware_anti(a, one.union(spark.createDataFrame([(None,)], "j int")), "k", "j").count() == 0
    assert R.null_aware_anti(a, one.where("false"), "k", "j").count() == 3


def test_quantiles(spark):
    df = spark.createDataFrame([(float(x),) for x in range(1, 11)], "x double")
    row = df.agg(R.quantile_disc_floor(F.col("x"), 0.95).alias("d"), R.quantile_cont(F.col("x"), 0.25).alias("c")).first()
    assert (row["d"], row["c"]) == (9.0, 3.25)
    assert df.where("x > 99").agg(R.quantile_disc_floor(F.col("x"), 0.5)).first()[0] is None
    with pytest.raises(ValueError):
        R.quantile_cont(F.col("x"), 1.5)


def test_asof_with_clashing_names(spark):
    a = spark.createDataFrame([("u", 5, 1), ("u", 9, 2), ("w", 1, 3)], "by string, at int, v int")
    b = spark.createDataFrame([("u", 5, "x"), ("u", 8, "y")], "by string, at int, _at string")
    got = R.asof_join(a, b, ["by"], "at", "at", ["_at"]).collect()
    assert sorted((r["v"], r["_at"]) for r in got) == [(1, "x"), (2, "y"), (3, None)]


def test_recursive_distinct_ends(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "a int, b int")
    got = R.recursive_distinct(spark.createDataFrame([(1,)], "k int"), lambda n: n.join(edges, n["k"] == edges["a"]).select("b"))
    assert sorted(r[0] for r in got.collect()) == [1, 2, 3]


def test_merge_null_keys_do_not_match(spark):
    t = spark.createDataFrame([(1, "a"), (None, "b")], "k int, v string")
    s = spark.createDataFrame([(1, "x"), (None, "y")], "k int, v string")
    got = dml.upsert(t, s, ["k"]).collect()
    assert sorted(map(tuple, got), key=str) == [(1, "x"), (None, "b"), (None, "y")]


def test_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0]), (4, [0.0, 0.0])], "vec_id int, embedding array<double>")
    got = {r[0]: r[1] for r in V.nearest(df, [1.0, 0.0], 4, "cosine").collect()}
    assert got == {1: 1.0, 2: 0.0, 3: 0.0, 4: 0.0}
    assert V.nearest(df.where("false"), [1.0, 0.0], 4).count() == 0


def test_chunks(spark):
    text = "# Head\n\nfirst para\n\nsecond\n\n" + "x" * 40
    rows = T.chunks(spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id int, text string"), 30).orderBy("chunk_index").collect()
    assert [(r["chunk_index"], r["section_name"], r["content_text"]) for r in rows] == [(0, "Head", "# Head\n\nfirst para\n\nsecond"), (1, "x" * 40, "x" * 40)]


def test_cjk_terms(spark):
    row = spark.createDataFrame([("数据库 and The Query",)], "t string").select(T.terms(F.col("t"))).first()
    assert row[0] == sorted(["数", "数据", "据", "据库", "库", "数据库", "query"])


def test_spatial_bad_input(spark):
    row = spark.range(1).select(SP.parse_polygon(F.lit("POLYGON((0 0, x 1))")).isNull(), SP.st_within(SP.parse_point(F.lit("bad")), SP.parse_polygon(F.lit("POLYGON((0 0, 1 0, 1 1))"))).isNull()).first()
    assert tuple(row) == (True, True)


def test_cypher_refuses_what_it_cannot_do(spark):
    from tessera.operators.cypher import cypher
    from tessera.operators.graph import Graph

    nodes = spark.createDataFrame([("a", ["P"], {"age": "9"}), ("b", ["P"], {"age": "10"}), ("c", ["Q"], {})], "id string, labels array<string>, props map<string,string>")
    edges = spark.createDataFrame([("a", "b", "KNOWS", {}), ("b", "c", "KNOWS", {})], "src string, dst string, type string, props map<string,string>")
    g = Graph(nodes, edges)
    for text in ("CREATE (n)", "MATCH (a)-[:KNOWS*1..3]->(b) RETURN b", "MATCH (a)", "MATCH a RETURN a"):
        with pytest.raises(ValueError):
            cypher(g, text)
    assert [r[0] for r in cypher(g, "MATCH (n:P) WHERE n.age > 9 RETURN id(n) AS id").collect()] == ["b"]  # as numbers
    assert [tuple(r) for r in cypher(g, "MATCH (x)-->(y)-->(z) RETURN id(x) AS x, id(z) AS z").collect()] == [("a", "c")]
    assert cypher(g, "MATCH (n {age: '9'}) RETURN count(*) AS n").first()[0] == 1
    assert {(r["id"], r["depth"]) for r in g.bfs(["a"], 5, "out").collect()} == {("a", 0), ("b", 1), ("c", 2)}


def test_search_of_many_queries_keeps_ties_and_lengths(spark):
    df = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(12)] + [(50, [1.0]), (51, None)], "vec_id long, embedding array<double>")
    got = {}
    for r in V.nearest_of_each(df.where("vec_id in (0, 50, 51)"), df, 3, "euclidean").orderBy("rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got == {0: [3, 6, 9]}


def test_schema_changes(spark):
    from tessera.operators import schema as SC

    df = spark.range(5)
    with pytest.raises(ValueError):
        SC.add_column(df, "id", "int")
    with pytest.raises(ValueError):
        SC.drop_column(df, "x")
    got = SC.number_rows(df, "id", 10, 5).orderBy("id").collect()
    assert [r["nextval"] for r in got] == [10, 15, 20, 25, 30]


def test_stated_queries_are_searched_by_every_metric_filter_and_shard():
    from tessera.plans import retrieval

    assert {f"vec_each{x}" for x in ("", "_dot", "_euclidean", "_manhattan", "_filtered", "_sharded")} <= set(retrieval.QUERIES) & set(retrieval.ORACLES)


def test_merge_needs_unique_source_keys(spark):
    from tessera.operators import dml

    t = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k int, v string")
    twice = spark.createDataFrame([(1, "x"), (1, "y")], "k int, v string")
    with pytest.raises(Exception, match="several source rows"):
        dml.upsert(t, twice, ["k"]).collect()
    nulls = spark.createDataFrame([(None, "x"), (None, "y"), (2, "z")], "k int, v string")
    assert sorted(map(str, dml.upsert(t, nulls, ["k"]).collect())) == sorted(map(str, [*t.where("k = 1 OR k IS NULL").collect(), *nulls.collect()]))


def test_limits_hold_among_equal_rows(spark):
    from tessera.operators import dml

    t = spark.createDataFrame([(1, None)] * 3 + [(2, "b")], "k int, v string")
    one = [F.col("k")]
    assert sorted(r["k"] for r in dml.update(t, {"k": F.lit(9)}, F.col("k") == 1, one, 1).collect()) == [1, 1, 2, 9]
    assert sorted(r["k"] for r in dml.delete(t, F.col("k") < 5, one, 2).collect()) == [1, 2]
    assert dml.delete(t, F.lit(True), one, 0).count() == 4 and dml.delete(t, F.lit(True), one, 9).count() == 0


def test_dialect_errors():
    from tessera.plans.dialect import to_spark

    for text, what in (("SELECT DATE_TRUNC('decade', d) FROM t", "unknown unit"), ("SELECT DATE(d, 'sideways') FROM t", "unknown modifier"), ("SELECT STRCMP('a') FROM t", "does not take")):
        with pytest.raises(ValueError, match=what):
            to_spark(text)
    kept = "SELECT a, count(*) FROM t GROUP BY ALL; SELECT INTERVAL '1' DAY, INTERVAL (2) DAY, 'CONCAT(a)' -- FIELD(x)"
    assert to_spark(kept) == kept
    assert to_spark("SELECT a FROM t ORDER BY a, b DESC NULLS LAST LIMIT 2", "first") == "SELECT a FROM t ORDER BY a NULLS FIRST, b DESC NULLS LAST LIMIT 2"


def test_vector_searches_of_odd_rows(spark):
    """Null and empty vectors, those of another length, repeated ids and an empty table."""
    rows = [(i, [float(i % 5), 1.0, float(i)]) for i in range(40)] + [(50, None), (51, []), (52, [1.0, 2.0]), (None, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    some = df.where("vec_id IN (7, 50, 51, 52)")
    exact = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in V.nearest_of_each(some, df, 3).collect())
    assert [r[:2] for r in exact] == [(7, 1), (7, 2), (7, 3)]
    same = df.where("size(embedding) = 3")
    pq = V.ProductQuantizer(same, 3, centres=40)
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in pq.search_each(pq.encode(same), same.where("vec_id = 7"), 3, 39).collect()) == exact
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in V.lsh_nearest(some.where("vec_id = 7"), same, 3, 39).collect()) == exact
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in V.IvfIndex(same, 4).search_each(some.where("vec_id = 7"), 3, share=1.0).collect()) == exact
    assert V.nearest_of_each(some, df.where("false"), 3).count() == 0 and V.nearest_of_each(df.where("false"), df, 3).count() == 0


def test_chunks_of_long_texts(spark):
    """Linear in the text: a hundred thousand paragraphs; sections are first lines, long ones name none."""
    text = "\n\n".join(f"paragraph {i}" for i in range(100_000)) + "\n\n \n\n" + "y" * 90
    rows = T.chunks(spark.createDataFrame([(1, text)], "doc_id int, text string"), 500).orderBy("chunk_index").collect()
    assert "\n\n".join(r["content_text"] for r in rows) == text.replace("\n\n \n\n", "\n\n") and max(len(r["content_text"]) for r in rows) <= 500
    assert rows[0]["section_name"] == "paragraph 0" and rows[-1]["content_text"].endswith("y" * 90)
    assert T.chunks(spark.createDataFrame([(2, "z" * 90)], "doc_id int, text string")).first()["section_name"] is None


def test_index_of_odd_texts(spark):
    """German, Chinese, snake_case, null and repeated words, against counts by hand."""
    docs = spark.createDataFrame([(1, "Für den cold_cache, cold_cache! 数据库"), (2, None), (3, "the é ß of x"), (4, "")], "doc_id long, text string")
    got = {(r["term"], r["doc_id"]): r["tf"] for r in T.inverted_index(docs).collect()}
    assert got == {("für", 1): 1, ("den", 1): 1, ("cold_cache", 1): 2, ("数据库", 1): 1, ("é", 3): 1, ("ß", 3): 1, **{(g, 1): 1 for g in ("数", "数据", "据", "据库", "库")}}
    v = {r["doc_id"]: r["embedding"] for r in T.hash_embeddings(docs, dims=16).collect()}
    assert set(v) == {1, 2, 3, 4} and v[2] == v[4] == [0.0] * 16 and abs(sum(x * x for x in v[1]) - 1) < 1e-9 and len(v[1]) == 16


def test_bfs_stays_among_nodes(spark):
    from tessera.operators.graph import Graph

    nodes = spark.createDataFrame([(i, ["N"], {}) for i in (1, 2, 3)], "id long, labels array<string>, props map<string,string>")
    edges = spark.createDataFrame([(1, 2, "E", {}), (2, 9, "E", {}), (9, 3, "E", {})], "src long, dst long, type string, props map<string,string>")
    assert sorted(map(tuple, Graph(nodes, edges).bfs([1], 5).collect())) == [(1, 0), (2, 1)]


def test_stream_of_late_and_repeated_events(spark, tmp_path):
    """Four micro-batches: windows close behind the watermark, a row of a closed window is dropped, a repeated id counts once."""
    import time
    from datetime import datetime

    from tessera.streaming import events as ev

    at = lambda h, m: datetime(2024, 1, 1, h, m)
    batches = [[(1, at(10, 0), 1.0), (2, at(10, 4), 2.0), (2, at(10, 4), 2.0)], [(3, at(10, 8), 4.0), (4, at(12, 0), 8.0), (1, at(10, 0), 1.0)], [(6, at(12, 1), 32.0)], [(5, at(10, 5), 16.0), (7, at(15, 0), 64.0)]]
    kinds = "id long, at timestamp, v double"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, kinds).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)  # files are taken in order of their age
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    found, ids = {}, []
    stream = ev.event_stream(spark, str(tmp_path / "in"), schema, 1)
    ev.run_to_end(ev.windowed(stream, "at", "1 hour", None, [], "v", late="10 minutes"), lambda b, n: found.update({r["window_start"].hour: (r["n"], r["total"]) for r in b.collect()}), str(tmp_path / "c1"))
    assert found == {10: (5, 10.0), 12: (2, 40.0)}  # the repeated rows count here, the late one does not
    ev.run_to_end(ev.once_per_id(stream, "at", ["id"], late="3 hours").select("id"), lambda b, n: ids.extend(r["id"] for r in b.collect()), str(tmp_path / "c2"))
    assert sorted(ids) == [1, 2, 3, 4, 5, 6, 7]
