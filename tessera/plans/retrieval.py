"""Vector, text, graph and spatial queries beside SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import spatial as SP
from tessera.operators import text as T
from tessera.operators import vector as V
from tessera.operators.cypher import cypher
from tessera.operators.graph import Graph
from tessera.session import cut_lineage, table


def _query_vector(spark: SparkSession, d: str) -> list[float]:
    return [float(x) for x in table(spark, d, "embeddings").where("vec_id = 7").select("embedding").first()[0]]


def _knn(metric: str):
    return lambda spark, d: V.nearest(table(spark, d, "embeddings"), _query_vector(spark, d), 10, metric).select("vec_id", F.round("score", 5).alias("score"))


_VQ = "q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 7)"
_DIST = {
    "cosine": "list_sum(list_transform(list_zip(embedding, q.e), lambda x: CAST(x[1] AS DOUBLE) * CAST(x[2] AS DOUBLE))) / (sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) * sqrt(list_sum(list_transform(q.e, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))))",
    "dot": "list_sum(list_transform(list_zip(embedding, q.e), lambda x: CAST(x[1] AS DOUBLE) * CAST(x[2] AS DOUBLE)))",
    "euclidean": "1 / (1 + sqrt(list_sum(list_transform(list_zip(embedding, q.e), lambda x: (CAST(x[1] AS DOUBLE) - CAST(x[2] AS DOUBLE)) * (CAST(x[1] AS DOUBLE) - CAST(x[2] AS DOUBLE))))))",
    "manhattan": "1 / (1 + list_sum(list_transform(list_zip(embedding, q.e), lambda x: abs(CAST(x[1] AS DOUBLE) - CAST(x[2] AS DOUBLE)))))",
}


def vec_filtered(spark: SparkSession, d: str) -> DataFrame:
    return V.nearest(table(spark, d, "embeddings"), _query_vector(spark, d), 5, "cosine", where=F.col("label") == 3).select("vec_id", F.round("score", 5).alias("score"))


def vec_each(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return V.nearest_of_each(e.where("vec_id % 100 = 0"), e, 3).select("query_id", "vec_id", F.col("rank").cast("bigint").alias("rank"))


def _each(k: int, metric: str = "cosine", where: str = "true", shards: int = 0):
    """The stated queries (ids divisible by 100) by any metric, over labelled vectors, or over shards."""
    def run(spark: SparkSession, d: str) -> DataFrame:
        e = table(spark, d, "embeddings")
        queries, rows = e.where("vec_id % 100 = 0"), e.where(where)
        found = V.nearest_of_each_sharded(queries, rows, k, shards, metric) if shards else V.nearest_of_each(queries, rows, k, metric)
        return found.select("query_id", "vec_id", F.col("rank").cast("bigint").alias("rank"))

    return run


def _each_sql(k: int, metric: str = "cosine", where: str = "true") -> str:
    return f"WITH q AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id % 100 = 0) SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY {_DIST[metric]} DESC, vec_id) AS rank FROM embeddings, q WHERE vec_id <> query_id AND {where} QUALIFY rank <= {k}"


def _recall(exact: DataFrame, found: DataFrame, rows: DataFrame, read: float) -> DataFrame:
    """recall of found, whether it is 0.9 or more, and the share of the vectors that were read whole."""
    n, of = exact.agg(F.count(F.lit(1)).alias("n")), rows.agg(F.count(F.lit(1)).alias("rows"))
    hits = exact.join(found, ["query_id", "vec_id"]).agg(F.count(F.lit(1)).alias("hits"))
    share = F.round(F.lit(float(read)), 4) if read <= 1 else F.round(F.least(F.lit(1.0), F.lit(float(read)) / F.col("rows")), 4)
    recall = F.col("hits") / F.col("n")
    return hits.crossJoin(n).crossJoin(of).select((recall >= 0.9).alias("good"), F.round(recall, 4).alias("recall"), share.alias("read_share"))  # single rows


def _ivf_recall(spark: SparkSession, d: str) -> DataFrame:
    """Recall of the inverted lists, four fifths of them read, over the stated queries (ids divisible by 100), against brute force."""
    e = table(spark, d, "embeddings")
    queries = e.where("vec_id % 100 = 0")
    return _recall(V.nearest_of_each(queries, e, 10), V.IvfIndex(e, 16).search_each(queries, 10, share=0.8), e, 13 / 16)


def vec_recall_figures(spark: SparkSession, d: str) -> DataFrame:
    """method, recall against brute force, and the share of the vectors that were read whole."""
    named = {"inverted lists": _ivf_recall, "product codes": _pq_search_recall, "sign hashes": _lsh_recall}
    parts = [f(spark, d).select(F.lit(n).alias("method"), "recall", "read_share") for n, f in named.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def vec_pq(spark: SparkSession, d: str) -> DataFrame:
    """Mean squared error of product quantization, as a share of the vectors' mean square."""
    e = table(spark, d, "embeddings")
    pq = V.ProductQuantizer(e, 16)
    out = pq.decode(pq.encode(e))
    return out.agg((F.avg(F.pow(V.euclidean(F.col("embedding"), F.col("approx")), 2)) / F.avg(F.pow(V.norm(F.col("embedding")), 2))).alias("error_share"))


def _pq_search_recall(spark: SparkSession, d: str) -> DataFrame:
    """Recall of product codes, fifty candidates a query ranked by their vectors, over the stated queries, against brute force."""
    e = table(spark, d, "embeddings")
    queries, pq = e.where("vec_id % 100 = 0"), V.ProductQuantizer(e, 16)
    return _recall(V.nearest_of_each(queries, e, 10), pq.search_each(pq.encode(e), queries, 10, 50), e, 50)


def _lsh_recall(spark: SparkSession, d: str) -> DataFrame:
    """Recall of sign hashes, a hundred candidates a query ranked by their vectors, over the stated queries, against brute force."""
    e = table(spark, d, "embeddings")
    queries = e.where("vec_id % 100 = 0")
    return _recall(V.nearest_of_each(queries, e, 10), V.lsh_nearest(queries, e, 10, 100), e, 100)


def match_against(spark: SparkSession, d: str) -> DataFrame:
    i = T.inverted_index(table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("text")))
    return T.keyword_scores(i, ["red", "gear"]).select("doc_id", F.round("score", 6).alias("score"))


def text_terms(spark: SparkSession, d: str) -> DataFrame:
    i = T.inverted_index(table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("text")))
    return i.groupBy("term").agg(F.sum("tf").alias("tf"), F.count(F.lit(1)).alias("df"))


def text_search(spark: SparkSession, d: str) -> DataFrame:
    return T.search_all(T.inverted_index(table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("text"))), ["red", "widget"])


def text_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    return T.search_fuzzy(T.inverted_index(table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("text"))), ["rad", "widgett"], 1)


def hybrid_rrf(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    a = c.select(F.col("c_custkey").alias("doc_id"), F.col("c_acctbal").alias("score"))
    b = c.select(F.col("c_custkey").alias("doc_id"), (-F.col("c_custkey")).cast("double").alias("score"))
    return T.reciprocal_rank_fusion([a, b]).select("doc_id", F.round("score", 9).alias("score"))


def hybrid_weighted(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), F.col("c_acctbal").alias("score"))
    return T.weighted_hybrid(c, c.where("doc_id % 2 = 0"), c.where("doc_id % 3 = 0")).select("doc_id", F.round("score", 6).alias("score"))


def text_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks hold each document's paragraphs whole and in order: their characters and hashes, summed per document."""
    ch = T.chunks(table(spark, d, "documents"))
    return ch.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.length(F.regexp_replace("content_text", r"\s+", ""))).alias("signs"), F.sum((F.sha2("content_text", 256) == F.col("content_hash")).cast("bigint")).alias("hashed")).select("doc_id", "signs", (F.col("hashed") == F.col("chunks")).alias("sound"))


def text_evidence(spark: SparkSession, d: str) -> DataFrame:
    ch = T.chunks(table(spark, d, "documents"))
    return T.evidence(ch, ch.where("section_name IS NOT NULL").select("doc_id").distinct())


def text_hash_embedding(spark: SparkSession, d: str) -> DataFrame:
    v = T.hash_embeddings(table(spark, d, "part"), "p_partkey", "p_name")
    return v.select("p_partkey", F.round(V.norm(F.col("embedding")), 6).alias("norm"))


def docs_hash_embedding(spark: SparkSession, d: str) -> DataFrame:
    v = T.hash_embeddings(table(spark, d, "documents"))
    return v.select("doc_id", F.size("embedding").alias("dims"), F.round(V.norm(F.col("embedding")), 6).alias("norm"))


def _docs_index(spark: SparkSession, d: str) -> DataFrame:
    return T.inverted_index(table(spark, d, "documents"))


def docs_terms(spark: SparkSession, d: str) -> DataFrame:
    return _docs_index(spark, d).groupBy("term").agg(F.sum("tf").alias("tf"), F.count(F.lit(1)).alias("df"))


def docs_search(spark: SparkSession, d: str) -> DataFrame:
    """Documents of English, German and Chinese terms."""
    i = cut_lineage(_docs_index(spark, d))  # read once for each search
    found = [T.search_all(i, q).select(F.lit(" ".join(q)).alias("query"), "doc_id") for q in (["join", "order"], ["nicht", "zuständig"], ["没有"])]
    return found[0].unionByName(found[1]).unionByName(found[2])


def docs_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    return T.search_fuzzy(_docs_index(spark, d), ["histogramm", "latencyy"], 1)


def docs_scores(spark: SparkSession, d: str) -> DataFrame:
    s = T.keyword_scores(cut_lineage(_docs_index(spark, d)), ["cold", "cache", "histogram"])
    return s.select("doc_id", F.round("score", 6).alias("score"))


def vec_graph_join(spark: SparkSession, d: str) -> DataFrame:
    """Vectors joined with the edges of a graph (between rows of one label): of the ten nearest to each stated query, its neighbours in the graph."""
    e = table(spark, d, "embeddings")
    near = V.nearest_of_each(e.where("vec_id % 100 = 0"), e, 10)
    label = lambda c: e.select(F.col("vec_id").alias(c), F.col("label").alias(f"{c}_label"))
    return near.join(label("query_id"), "query_id").join(label("vec_id"), "vec_id").where("query_id_label = vec_id_label").select("query_id", "vec_id", F.col("rank").cast("bigint").alias("rank"))


def doc_versions(spark: SparkSession, d: str) -> DataFrame:
    return T.versions(table(spark, d, "documents"), "doc_number", "version_number", "text").select("doc_id", F.col("version").cast("bigint").alias("version"))


def _graph(spark: SparkSession, d: str) -> Graph:
    """Nations and suppliers; a supplier is LOCATED in its nation and SELLS to the nations of its customers."""
    n, s = table(spark, d, "nation"), table(spark, d, "supplier")
    nodes = n.select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.array(F.lit("Nation")).alias("labels"), F.create_map(F.lit("name"), "n_name").alias("props"))
    nodes = nodes.unionByName(s.select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.array(F.lit("Supplier")).alias("labels"), F.create_map(F.lit("name"), "s_name").alias("props")))
    none = F.create_map().cast("map<string,string>")
    edges = s.select(F.concat(F.lit("s"), "s_suppkey").alias("src"), F.concat(F.lit("n"), "s_nationkey").alias("dst"), F.lit("LOCATED").alias("type"), none.alias("props"))
    edges = edges.unionByName(n.select(F.concat(F.lit("n"), "n_nationkey").alias("src"), F.concat(F.lit("n"), (F.col("n_nationkey") * 2 + 1) % 25).alias("dst"), F.lit("TRADES").alias("type"), none.alias("props")))
    return Graph(nodes, edges)


def graph_one_hop(spark: SparkSession, d: str) -> DataFrame:
    g = _graph(spark, d)
    return g.hop(g.match_nodes("s", "Supplier"), "s", "n", "Nation", {"name": "NATION_7"}, "LOCATED").select(F.col("s.id").alias("s"), F.col("n.id").alias("n"))


def graph_two_hop(spark: SparkSession, d: str) -> DataFrame:
    g = _graph(spark, d)
    one = g.hop(g.match_nodes("s", "Supplier"), "s", "n", "Nation", kind="LOCATED")
    return g.hop(one, "n", "m", "Nation", kind="TRADES").select(F.col("s.id").alias("s"), F.col("m.id").alias("m"))


def graph_in_either(spark: SparkSession, d: str) -> DataFrame:
    g = _graph(spark, d)
    n = g.match_nodes("n", "Nation", {"name": "NATION_3"})
    i = g.hop(n, "n", "x", direction="in").select(F.lit("in").alias("way"), F.col("x.id").alias("x"))
    e = g.hop(n, "n", "x", direction="either", kind="TRADES").select(F.lit("either").alias("way"), F.col("x.id").alias("x"))
    return i.unionByName(e)


def graph_optional(spark: SparkSession, d: str) -> DataFrame:
    g = _graph(spark, d)
    return g.hop(g.match_nodes("n", "Nation"), "n", "s", "Supplier", kind="LOCATED", direction="in", optional=True).groupBy(F.col("n.id").alias("n")).agg(F.count("s").alias("suppliers"))


def graph_bfs(spark: SparkSession, d: str) -> DataFrame:
    return _graph(spark, d).bfs(["n1"], 3, direction="out").select("id", F.col("depth").cast("bigint").alias("depth"))


def graph_project(spark: SparkSession, d: str) -> DataFrame:
    p = _graph(spark, d).project(["n1"], 1, ["TRADES"])
    return p.nodes.agg(F.count(F.lit(1)).alias("nodes")).crossJoin(p.edges.agg(F.count(F.lit(1)).alias("edges")))  # two single rows


CYPHER = {
    "cypher_match": "MATCH (s:Supplier)-[:LOCATED]->(n:Nation {name: 'NATION_7'}) RETURN id(s) AS s, n.name AS nation",
    "cypher_hops": "MATCH (s:Supplier)-[:LOCATED]->(n)-[r:TRADES]->(m:Nation) WHERE m.name <> 'NATION_3' RETURN DISTINCT n.name AS a, m.name AS b, type(r) AS how",
    "cypher_optional": "MATCH (n:Nation) OPTIONAL MATCH (n)<-[:LOCATED]-(s:Supplier) RETURN n.name AS nation, count(s) AS suppliers",
    "cypher_with": "MATCH (s:Supplier)-[:LOCATED]->(n) WITH n.name AS nation, count(*) AS c WHERE c > 3 RETURN nation, c ORDER BY c DESC, nation SKIP 1 LIMIT 5",
    "cypher_union": "MATCH (n:Nation {name: 'NATION_1'})-[:TRADES]-(m) RETURN m.name AS x UNION MATCH (n:Nation {name: 'NATION_2'})-[:TRADES]-(m) RETURN m.name AS x",
}


def _cypher(text: str):
    return lambda spark, d: cypher(_graph(spark, d), text)


_NAMED = "e AS (SELECT s_name AS src, 'NATION_' || s_nationkey AS dst, 'LOCATED' AS type, 's' || s_suppkey AS id FROM supplier UNION ALL SELECT 'NATION_' || n_nationkey, 'NATION_' || ((n_nationkey * 2 + 1) % 25), 'TRADES', 'n' || n_nationkey FROM nation)"
_CYPHER_SQL = {
    "cypher_match": "SELECT 's' || s_suppkey AS s, 'NATION_7' AS nation FROM supplier WHERE s_nationkey = 7",
    "cypher_hops": f"WITH {_NAMED} SELECT DISTINCT a.dst AS a, b.dst AS b, b.type AS how FROM e a JOIN e b ON a.dst = b.src AND a.type = 'LOCATED' AND b.type = 'TRADES' WHERE b.dst <> 'NATION_3'",
    "cypher_optional": "SELECT n_name AS nation, count(s_suppkey) AS suppliers FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name",
    "cypher_with": "SELECT 'NATION_' || s_nationkey AS nation, count(*) AS c FROM supplier GROUP BY s_nationkey HAVING count(*) > 3 ORDER BY c DESC, nation LIMIT 5 OFFSET 1",
    "cypher_union": f"WITH {_NAMED} SELECT dst AS x FROM e WHERE type = 'TRADES' AND src IN ('NATION_1', 'NATION_2') UNION SELECT src FROM e WHERE type = 'TRADES' AND dst IN ('NATION_1', 'NATION_2')",
}

_EDGES = "e AS (SELECT 's' || s_suppkey AS src, 'n' || s_nationkey AS dst, 'LOCATED' AS type FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'n' || ((n_nationkey * 2 + 1) % 25), 'TRADES' FROM nation)"
_BFS = "WITH RECURSIVE w(id, depth) AS (SELECT 'n1', 0::BIGINT UNION SELECT 'n' || ((CAST(substr(id, 2) AS INT) * 2 + 1) % 25), depth + 1 FROM w WHERE depth < 3) SELECT id, min(depth) AS depth FROM w GROUP BY id"


def st_within(spark: SparkSession, d: str) -> DataFrame:
    ring = SP.parse_polygon(F.lit("POLYGON((0 0, 5000 0, 5000 12, 2000 12, 2000 20, 0 20, 0 0))"))
    return table(spark, d, "customer").select("c_custkey", SP.st_within(SP.point(F.col("c_acctbal") + 0.001, F.col("c_nationkey") + 0.5), ring).alias("inside"))


def st_distance(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", F.round(SP.st_distance(SP.point(F.col("c_acctbal"), F.col("c_nationkey")), SP.point(10, 20)), 6).alias("dist"))


def st_misc(spark: SparkSession, d: str) -> DataFrame:
    poly = lambda w: SP.parse_polygon(F.lit(w))
    a, b, c = poly("POLYGON((0 0, 4 0, 4 4, 0 4))"), poly("POLYGON((2 2, 6 2, 6 6, 2 6))"), poly("POLYGON((10 10, 12 10, 12 12))")
    return spark.range(1).select(SP.st_intersects(a, b).alias("meets"), SP.st_intersects(a, c).alias("apart"), SP.st_contains(a, SP.point(1, 1)).alias("holds"), SP.st_within(SP.point(1, 1), F.slice(a, 1, 2)).alias("two_corners"), SP.parse_point(F.lit("POINT(1 x)")).isNull().alias("bad"), SP.st_intersects_points(SP.point(1, 1), SP.point(1 + 1e-12, 1)).alias("same"))


def haversine(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    return n.select("n_nationkey", F.round(SP.haversine(F.col("n_nationkey") * 1.5, F.col("n_nationkey") * 2.5, F.lit(48.0), F.lit(11.0)), 3).alias("metres"))


DEFS = {f"vec_flat_{m}": (_knn(m), f"WITH {_VQ} SELECT vec_id, round(s, 5) AS score FROM (SELECT vec_id, {e} AS s FROM embeddings, q) ORDER BY s DESC, vec_id LIMIT 10") for m, e in _DIST.items()} | {
    "vec_filtered": (vec_filtered, f"WITH {_VQ} SELECT vec_id, round(s, 5) AS score FROM (SELECT vec_id, {_DIST['cosine']} AS s FROM embeddings, q WHERE label = 3) ORDER BY s DESC, vec_id LIMIT 5"),
    "vec_each": (vec_each, f"WITH q AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id % 100 = 0) SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY {_DIST['cosine']} DESC, vec_id) AS rank FROM embeddings, q WHERE vec_id <> query_id QUALIFY rank <= 3"),
    **{f"vec_each_{m}": (_each(10, m), _each_sql(10, m)) for m in _DIST if m != "cosine"},
    "vec_each_filtered": (_each(5, where="label = 3"), _each_sql(5, where="label = 3")),
    "vec_each_sharded": (_each(10, shards=8), _each_sql(10)),
    "vec_ivf_recall": (lambda spark, d: _ivf_recall(spark, d).select("good"), "SELECT true AS good"),
    "vec_pq_error": (vec_pq, None),
    "vec_pq_recall": (lambda spark, d: _pq_search_recall(spark, d).select("good"), "SELECT true AS good"),
    "vec_lsh_recall": (lambda spark, d: _lsh_recall(spark, d).select("good"), "SELECT true AS good"),
    "vec_recall_figures": (vec_recall_figures, None),
    "text_match_against": (match_against, "WITH w AS (SELECT p_partkey AS doc_id, unnest(regexp_split_to_array(lower(p_name), '[^a-z0-9]+')) AS term FROM part), tf AS (SELECT term, doc_id, count(*) AS tf FROM w WHERE length(term) > 1 GROUP BY ALL), n AS (SELECT count(DISTINCT doc_id) AS n FROM tf), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term) SELECT doc_id, round(sum(tf * ln(1 + n / df)), 6) AS score FROM tf JOIN df USING (term), n WHERE term IN ('red', 'gear') GROUP BY doc_id"),
    "text_terms": (text_terms, "WITH w AS (SELECT p_partkey, unnest(regexp_split_to_array(lower(p_name), '[^a-z0-9]+')) AS term FROM part) SELECT term, count(*) AS tf, count(DISTINCT p_partkey) AS df FROM w WHERE length(term) > 1 GROUP BY term"),
    "text_index_search": (text_search, "SELECT p_partkey AS doc_id FROM part WHERE list_contains(regexp_split_to_array(lower(p_name), '[^a-z0-9]+'), 'red') AND list_contains(regexp_split_to_array(lower(p_name), '[^a-z0-9]+'), 'widget')"),
    "text_fuzzy": (text_fuzzy, "WITH w AS (SELECT DISTINCT p_partkey AS doc_id, unnest(regexp_split_to_array(lower(p_name), '[^a-z0-9]+')) AS term FROM part), q AS (SELECT unnest(['rad', 'widgett']) AS t) SELECT doc_id, count(DISTINCT t) AS score FROM w, q WHERE length(term) > 1 AND levenshtein(term, t) <= 1 GROUP BY doc_id"),
    "hybrid_rrf": (hybrid_rrf, "SELECT c_custkey AS doc_id, round(1.0::DOUBLE / (60 + row_number() OVER (ORDER BY c_acctbal DESC, c_custkey)) + 1.0::DOUBLE / (60 + row_number() OVER (ORDER BY c_custkey)), 9) AS score FROM customer"),
    "hybrid_weighted": (hybrid_weighted, "SELECT c_custkey AS doc_id, round(c_acctbal * 0.5::DOUBLE + CASE WHEN c_custkey % 2 = 0 THEN c_acctbal * 0.3::DOUBLE ELSE 0 END + CASE WHEN c_custkey % 3 = 0 THEN c_acctbal * 0.2::DOUBLE ELSE 0 END, 6) AS score FROM customer"),
    "text_chunks": (text_chunks, r"SELECT doc_id, CAST(length(regexp_replace(text, '\s+', '', 'g')) AS BIGINT) AS signs, true AS sound FROM documents WHERE length(regexp_replace(text, '\s+', '', 'g')) > 0"),
    "text_evidence": (text_evidence, None),
    "text_docs_terms": (docs_terms, None),
    "text_docs_search": (docs_search, None),
    "text_docs_fuzzy": (docs_fuzzy, None),
    "text_docs_scores": (docs_scores, None),
    "text_docs_hash_embedding": (docs_hash_embedding, None),
    "vec_graph_join": (vec_graph_join, f"SELECT query_id, f.vec_id, rank FROM ({_each_sql(10)}) f JOIN embeddings a ON a.vec_id = query_id JOIN embeddings b ON b.vec_id = f.vec_id WHERE a.label = b.label"),
    "text_hash_embedding": (text_hash_embedding, "SELECT p_partkey, 1.0::DOUBLE AS norm FROM part"),
    "doc_versions": (doc_versions, "SELECT doc_id, row_number() OVER (PARTITION BY doc_number ORDER BY version_number) AS version FROM documents"),
    "graph_one_hop": (graph_one_hop, "SELECT 's' || s_suppkey AS s, 'n' || s_nationkey AS n FROM supplier WHERE s_nationkey = 7"),
    "graph_two_hop": (graph_two_hop, f"WITH {_EDGES} SELECT a.src AS s, b.dst AS m FROM e a JOIN e b ON a.dst = b.src WHERE a.type = 'LOCATED' AND b.type = 'TRADES'"),
    "graph_in_either": (graph_in_either, f"WITH {_EDGES} SELECT 'in' AS way, src AS x FROM e WHERE dst = 'n3' UNION ALL SELECT 'either', dst FROM e WHERE src = 'n3' AND type = 'TRADES' UNION ALL SELECT 'either', src FROM e WHERE dst = 'n3' AND type = 'TRADES'"),
    "graph_optional": (graph_optional, "SELECT 'n' || n_nationkey AS n, count(s_suppkey) AS suppliers FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey"),
    "graph_bfs": (graph_bfs, _BFS),
    "graph_project": (graph_project, f"WITH {_EDGES}, v AS (SELECT 'n1' AS id UNION SELECT src FROM e WHERE dst = 'n1' UNION SELECT dst FROM e WHERE src = 'n1') SELECT (SELECT count(*) FROM v) AS nodes, (SELECT count(*) FROM e WHERE type = 'TRADES' AND src IN (SELECT id FROM v) AND dst IN (SELECT id FROM v)) AS edges"),
    "st_within": (st_within, "SELECT c_custkey, (c_acctbal + 0.001 > 0 AND c_acctbal + 0.001 < 5000 AND c_nationkey < 12) OR (c_acctbal + 0.001 > 0 AND c_acctbal + 0.001 < 2000 AND c_nationkey < 20) AS inside FROM customer"),
    "st_distance": (st_distance, "SELECT c_custkey, round(sqrt((c_acctbal - 10) ** 2 + (c_nationkey - 20) ** 2), 6) AS dist FROM customer"),
    "st_misc": (st_misc, "SELECT true AS meets, false AS apart, true AS holds, false AS two_corners, true AS bad, true AS same"),
    "haversine": (haversine, "SELECT n_nationkey, round(2 * 6371000.0::DOUBLE * asin(sqrt(sin(radians(48.0 - n_nationkey * 1.5) / 2) ** 2 + cos(radians(n_nationkey * 1.5)) * cos(radians(48.0)) * sin(radians(11.0 - n_nationkey * 2.5) / 2) ** 2)), 3) AS metres FROM nation"),
}

DEFS |= {k: (_cypher(t), _CYPHER_SQL[k]) for k, t in CYPHER.items()}

QUERIES = {k: f for k, (f, _) in DEFS.items()}
ORACLES = {k: s for k, (_, s) in DEFS.items() if s}
