"""The queries of the clustering engine over the driver's tables, and their DuckDB SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from denspark.config import ClusterConfig, KnnParams
from denspark.errors import DISTANCE
from denspark.functions import scalar
from denspark.functions.distance import COSINE, EUCLIDEAN, LEVENSHTEIN, cosine, euclidean, levenshtein, norm
from denspark.lineage import cut, shared_dir
from denspark.operators import cells, components, density, graphcheck, knn, quality
from denspark.operators.components import chains, connected_components
from denspark.operators.descent import neighbour_graph
from denspark.operators.edits import edit_join, edit_search
from denspark.operators.hierarchy import condense, dendrogram
from denspark.operators.msf import kruskal, spanning_forest
from denspark.plans.clustering import cluster, complete_forest, label_summary, weighted_edges
from denspark.sources.readers import bad_rows, clean_line, number_rows, vector_faults
from denspark.streaming.session import ClusteringSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("item"))


def _dimension(points: DataFrame) -> int:
    """The greatest length of the vectors; 0 without any."""
    return points.agg(F.coalesce(F.max(F.size("item")), F.lit(0))).first()[0]


def _suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.array(F.col("s_acctbal").cast("float"), F.col("s_nationkey").cast("float")).alias("item"))


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return number_rows(_read(spark, sf_dir, "part").select(F.col("p_name").alias("item")).distinct(), ["item"])


# SQL for the same points, distances and neighbours.
_E = "e AS (SELECT vec_id AS id, embedding AS item FROM embeddings)"
_S = "e AS (SELECT s_suppkey AS id, [s_acctbal::FLOAT, s_nationkey::FLOAT] AS item FROM supplier)"
_N = "e AS (SELECT row_number() OVER (ORDER BY p_name) - 1 AS id, p_name AS item FROM (SELECT DISTINCT p_name FROM part))"


def _distance(a: str, b: str) -> str:
    return f"CAST(sqrt(list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE)))) AS FLOAT)"


def _near(k: int, points: str = _E) -> str:
    return f"""{points},
p AS (SELECT a.id AS query, b.id AS id, {_distance('a.item', 'b.item')} AS distance FROM e a JOIN e b ON a.id <> b.id),
knn AS (SELECT query, id, distance, CAST(row_number() OVER (PARTITION BY query ORDER BY distance, id) AS INTEGER) AS rank FROM p QUALIFY rank <= {k})"""


_CORE = "core AS (SELECT query AS id, coalesce(max(distance) FILTER (WHERE rank = 5), max(distance)) AS core FROM knn GROUP BY 1)"
_EDGES = "edges AS (SELECT least(query, id) AS source, greatest(query, id) AS target, min(distance) AS distance FROM knn GROUP BY 1, 2)"


@query(f"WITH {_E} SELECT a.id AS source, b.id AS target, {_distance('a.item', 'b.item')} AS distance FROM e a JOIN e b ON a.id < b.id")
def euclidean_pairs(spark, sf_dir):
    """Distances of all pairs: as many rows as there are pairs, made in blocks."""

    def distances(a, b):
        return np.sqrt(knn.summed(a, b, lambda x, y: np.square(x - y))).astype(np.float32)

    points = _vectors(spark, sf_dir)
    found = knn.all_pairs(points, distances, lambda rows: rows.withColumn("distance", euclidean(F.col("a"), F.col("b"))), _dimension(points))
    return found.select("source", "target", F.col("distance").cast("float").alias("distance"))


_DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"


@query(f"WITH {_E}, n AS (SELECT *, sqrt({_DOT.format(a='item', b='item')}) AS len FROM e) SELECT a.id AS source, b.id AS target, round(CAST(1::FLOAT - CAST(least(1, greatest(-1, {_DOT.format(a='a.item', b='b.item')} / (a.len * b.len))) AS FLOAT) AS DOUBLE), 5) AS distance FROM n a JOIN n b ON a.id < b.id")
def cosine_pairs(spark, sf_dir):
    """Cosine distances of all pairs, made in blocks."""

    def distances(a, b):
        na, nb = (np.sqrt(knn.summed(x, np.ones((1, x.shape[1])), lambda v, one: v * v * one)[:, 0]) for x in (a, b))
        if not (na > 0).all() or not (nb > 0).all():
            raise DISTANCE["ZERO_MAGNITUDE"]("a vector has length 0")
        similarity = knn.summed(a, b, lambda x, y: x * y) / (na[:, None] * nb[None])
        distance = (np.float32(1) - np.clip(similarity.astype(np.float32), -1, 1)).astype(np.float64)
        # None is below 0: halves go up, as in SQL.
        return np.floor(distance * 1e5 + 0.5) / 1e5

    points = _vectors(spark, sf_dir)
    rounded = lambda rows: rows.withColumn("distance", F.round(cosine(F.col("a"), F.col("b")).cast("double"), 5))
    return knn.all_pairs(points, distances, rounded, _dimension(points)).select("source", "target", "distance")


@query(f"WITH {_E} SELECT id, round(sqrt({_DOT.format(a='item', b='item')}), 9) AS length FROM e")
def vector_norms(spark, sf_dir):
    return _vectors(spark, sf_dir).select("id", F.round(norm(F.col("item")), 9).alias("length"))


@query(f"WITH {_N} SELECT a.item AS left_name, b.item AS right_name, CAST(levenshtein(a.item, b.item) AS FLOAT) AS distance FROM e a JOIN e b ON a.id < b.id")
def levenshtein_pairs(spark, sf_dir):
    names = _names(spark, sf_dir)
    right = names.select(F.col("id").alias("id2"), F.col("item").alias("right_name"))
    return names.join(right, F.col("id") < F.col("id2")).select(F.col("item").alias("left_name"), "right_name", levenshtein(F.col("item"), F.col("right_name")).alias("distance"))


@query("SELECT count(*) AS n, count(*) FILTER (WHERE embedding IS NULL) AS null_rows, count(*) FILTER (WHERE len(embedding) <> 64) AS wrong_sizes, count(*) FILTER (WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) > 0) AS not_finite FROM embeddings")
def vector_validation(spark, sf_dir):
    v, faults = F.col("item"), vector_faults("item", 64)
    bad = faults["NULL_VALUE"] | F.exists(v, lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    return _vectors(spark, sf_dir).agg(F.count("*").alias("n"), F.count_if(faults["NULL_ROW"]).alias("null_rows"), F.count_if(faults["INVALID_ROW_LENGTH"]).alias("wrong_sizes"), F.count_if(bad).alias("not_finite"))


@query(f"WITH {_near(10)} SELECT query, id, distance, rank FROM knn")
def knn_exact_k10(spark, sf_dir):
    return knn.exact_knn(_vectors(spark, sf_dir), 10)


@query(f"WITH {_N}, p AS (SELECT a.id AS query, b.id AS id, CAST(levenshtein(a.item, b.item) AS FLOAT) AS distance FROM e a JOIN e b ON a.id <> b.id) SELECT query, id, distance, CAST(row_number() OVER (PARTITION BY query ORDER BY distance, id) AS INTEGER) AS rank FROM p QUALIFY rank <= 5")
def knn_text_k5(spark, sf_dir):
    return knn.exact_knn(_names(spark, sf_dir), 5, LEVENSHTEIN)


@query(f"WITH {_N} SELECT a.id AS source, b.id AS target, CAST(levenshtein(a.item, b.item) AS FLOAT) AS distance FROM e a JOIN e b ON a.id < b.id WHERE levenshtein(a.item, b.item) <= 6")
def edit_join_names(spark, sf_dir):
    """Names of parts within six edits of each other, by the segments that they share."""
    return edit_join(_names(spark, sf_dir), 6)


@query(f"""WITH {_N}, q AS (SELECT p_partkey AS query, p_name AS item FROM part WHERE p_partkey % 20 = 0)
SELECT query, id, CAST(levenshtein(q.item, e.item) AS FLOAT) AS distance FROM q JOIN e ON levenshtein(q.item, e.item) <= 7""")
def edit_search_names(spark, sf_dir):
    """All names within seven edits of those of a stated set of parts."""
    asked = _read(spark, sf_dir, "part").where(F.col("p_partkey") % 20 == 0).select(F.col("p_partkey").alias("id"), F.col("p_name").alias("item"))
    return edit_search(_names(spark, sf_dir), asked, 7)


_TREES = f"""{_near(5, _S)}, {_CORE}, t AS (SELECT e.id, item, core, s_nationkey AS tree FROM e JOIN core USING (id) JOIN supplier ON s_suppkey = e.id),
w AS (SELECT a.tree, least(a.id, b.id) AS source, greatest(a.id, b.id) AS target, greatest({_distance('a.item', 'b.item')}, a.core, b.core) AS weight FROM t a JOIN t b ON a.tree <> b.tree)"""


@query(f"WITH {_TREES} SELECT CAST(tree AS BIGINT) AS tree, source, target, weight FROM w QUALIFY row_number() OVER (PARTITION BY tree ORDER BY weight, source, target) = 1")
def lightest_bridges_nations(spark, sf_dir):
    """The lightest mutual-reachability edge that leaves each nation's suppliers, found by the bounds of cells."""
    points = cut(_suppliers(spark, sf_dir))
    core = density.core_distances(knn.exact_knn(points, 5), 5)
    trees = _read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("of"), F.col("s_nationkey").alias("tree"))
    found = cells.lightest_bridges(points.join(core, "id").join(trees, F.col("id") == F.col("of")).drop("of")).edges
    return found.groupBy("tree").agg(F.min(F.struct("weight", "source", "target")).alias("e")).select("tree", "e.source", "e.target", "e.weight")


@query(f"WITH {_near(5)}, {_CORE} SELECT id, core FROM core")
def core_distances_k5(spark, sf_dir):
    return density.core_distances(knn.exact_knn(_vectors(spark, sf_dir), 5), 5)


@query(f"WITH {_near(10)}, {_CORE}, {_EDGES} SELECT source, target, greatest(distance, s.core, t.core) AS weight FROM edges JOIN core s ON s.id = source JOIN core t ON t.id = target")
def mutual_reachability_edges(spark, sf_dir):
    near = cut(knn.exact_knn(_vectors(spark, sf_dir), 10))
    return density.mutual_reachability(density.candidate_edges(near), density.core_distances(near, 5)).select("source", "target", "weight")


@query(f"WITH {_near(5)}, {_EDGES} SELECT source, target, distance FROM edges")
def edge_canonical_dedup(spark, sf_dir):
    return density.candidate_edges(knn.exact_knn(_vectors(spark, sf_dir), 5)).select("source", "target", "distance")


@query(f"WITH {_near(5)}, {_EDGES} SELECT row_number() OVER (ORDER BY distance, source, target) - 1 AS place, source, target FROM edges")
def edge_order_rank(spark, sf_dir):
    edges = density.candidate_edges(knn.exact_knn(_vectors(spark, sf_dir), 5))
    return number_rows(edges, ["distance", "source", "target", "sequence"]).select(F.col("id").alias("place"), "source", "target")


@query(f"""WITH RECURSIVE {_S},
w AS (SELECT a.id AS s, b.id AS t, {_distance('a.item', 'b.item')} AS weight FROM e a JOIN e b ON a.id <> b.id),
-- Prim: the tree so far and the edge that joined last; ties by the edge's ends.
prim AS (
  SELECT [0::BIGINT] AS tree, NULL::BIGINT AS source, NULL::BIGINT AS target, NULL::FLOAT AS weight
  UNION ALL
  SELECT list_append(tree, x.t), least(x.s, x.t), greatest(x.s, x.t), x.weight
  FROM prim, LATERAL (SELECT s, t, w.weight FROM w WHERE list_contains(prim.tree, s) AND NOT list_contains(prim.tree, t) ORDER BY w.weight, least(s, t), greatest(s, t) LIMIT 1) x)
SELECT source, target, weight FROM prim WHERE source IS NOT NULL""")
def msf_supplier(spark, sf_dir):
    points = _suppliers(spark, sf_dir)
    return kruskal(points.count(), complete_forest(points)).edges.select("source", "target", "weight")


@query("""WITH RECURSIVE l AS (SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON abs(a.s_acctbal - b.s_acctbal) <= 100),
r AS (SELECT s_suppkey AS node, s_suppkey AS seen FROM supplier UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.seen)
SELECT node, min(seen) AS component FROM r GROUP BY node""")
def components_at_eps(spark, sf_dir):
    """Suppliers whose balances are within 100 of each other, directly or by way of others."""
    s = _read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").cast("double").alias("item"))
    return connected_components(chains(s, 100.0), finish=components.FINISH)


def _links(spark, sf_dir):
    return cut(knn.exact_knn(_vectors(spark, sf_dir), 5))


@query(f"WITH {_near(5)}, {_EDGES} SELECT node, count(*) AS degree FROM (SELECT source AS node FROM edges UNION ALL SELECT target FROM edges) GROUP BY node")
def node_degrees(spark, sf_dir):
    return quality.degrees(density.candidate_edges(_links(spark, sf_dir)))


def _directed(spark, sf_dir):
    return _links(spark, sf_dir).select(F.col("query").alias("node"), F.lit(0).alias("layer"), F.col("id").alias("neighbour"))


@query(f"WITH {_near(5)}, i AS (SELECT id AS node, 0 AS layer, count(*) AS degree FROM knn GROUP BY 1) SELECT node, layer, degree FROM i WHERE degree > 8")
def degree_bounds(spark, sf_dir):
    turned = _directed(spark, sf_dir).select(F.col("neighbour").alias("node"), "layer", F.col("node").alias("neighbour"))
    return graphcheck.degree_bounds(turned, KnnParams(m=4, ef_construction=4))


@query(f"WITH {_near(5)} SELECT a.query AS node, 0 AS layer, a.id AS neighbour FROM knn a ANTI JOIN knn b ON a.query = b.id AND a.id = b.query")
def backlink_violations(spark, sf_dir):
    return graphcheck.bidirectional(_directed(spark, sf_dir))


@query(f"WITH {_near(5)} SELECT query AS node, 0 AS layer, id AS neighbour FROM knn JOIN embeddings ON vec_id = id WHERE label = 0")
def layer_violations(spark, sf_dir):
    """Links to nodes that a node table without the vectors labelled 0 lacks."""
    nodes = _read(spark, sf_dir, "embeddings").where("label <> 0").select(F.col("vec_id").alias("node"), F.lit(0).alias("level"))
    return graphcheck.layer_consistency(nodes, _directed(spark, sf_dir))


@query(f"WITH RECURSIVE {_near(5)}, r AS (SELECT 0::BIGINT AS node UNION SELECT knn.id FROM r JOIN knn ON knn.query = r.node) SELECT node FROM r")
def reachable_nodes(spark, sf_dir):
    return graphcheck.reachable(_directed(spark, sf_dir), spark.createDataFrame([(0, 0)], "node long, level int"))


@query(f"WITH {_near(5)} SELECT round(count(b.query) / count(*), 9) AS rnn_score FROM knn a LEFT JOIN knn b ON a.query = b.id AND a.id = b.query")
def rnn_score(spark, sf_dir):
    return quality.rnn_score(_links(spark, sf_dir), 5).select(F.round("rnn_score", 9).alias("rnn_score"))


@query("SELECT quality AS \"left\", toxic AS \"right\", count(*) AS n FROM labels GROUP BY 1, 2")
def contingency(spark, sf_dir):
    return quality.contingency(_read(spark, sf_dir, "labels").select(F.col("quality").alias("left"), F.col("toxic").alias("right")))


def _score_sql(left: str, right: str, table: str) -> str:
    return f"""WITH c AS (SELECT {left} AS l, {right} AS r, count(*)::DOUBLE AS n FROM {table} GROUP BY 1, 2),
a AS (SELECT l, sum(n) AS n FROM c GROUP BY 1), b AS (SELECT r, sum(n) AS n FROM c GROUP BY 1),
t AS (SELECT (SELECT sum(n) FROM c) AS n, (SELECT sum(n * (n - 1) / 2) FROM c) AS agree, (SELECT sum(n * (n - 1) / 2) FROM a) AS pl, (SELECT sum(n * (n - 1) / 2) FROM b) AS pr,
      (SELECT -sum(a.n / s * ln(a.n / s)) FROM a, (SELECT sum(n) AS s FROM c)) AS hl, (SELECT -sum(b.n / s * ln(b.n / s)) FROM b, (SELECT sum(n) AS s FROM c)) AS hr,
      (SELECT sum(c.n / s * ln(c.n * s / (a.n * b.n))) FROM c JOIN a USING (l) JOIN b USING (r), (SELECT sum(n) AS s FROM c)) AS mi)
SELECT CAST(n AS BIGINT) AS n, round((agree - pl * pr / (n * (n - 1) / 2)) / ((pl + pr) / 2 - pl * pr / (n * (n - 1) / 2)), 6) AS ari, round(mi / sqrt(hl * hr), 6) AS nmi FROM t"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(F.col("n").cast("long").alias("n"), F.round("ari", 6).alias("ari"), F.round("nmi", 6).alias("nmi"))


@query(_score_sql("quality", "toxic", "labels"))
def agreement_labels(spark, sf_dir):
    return _rounded(quality.scores(_read(spark, sf_dir, "labels").select(F.col("quality").alias("left"), F.col("toxic").alias("right"))))


@query(_score_sql("label", "vec_id % 10", "embeddings"))
def agreement_embeddings(spark, sf_dir):
    return _rounded(quality.scores(_read(spark, sf_dir, "embeddings").select(F.col("label").alias("left"), (F.col("vec_id") % 10).alias("right"))))


_COS = f"""n AS (SELECT *, sqrt({_DOT.format(a='item', b='item')}) AS len FROM e),
q AS (SELECT a.id AS query, b.id AS id, {_DOT.format(a='a.item', b='b.item')} / (a.len * b.len) AS c FROM n a JOIN n b ON a.id <> b.id),
cos AS (SELECT query, id FROM q QUALIFY row_number() OVER (PARTITION BY query ORDER BY 1 - c, id) <= 10)"""


@query(f"WITH {_near(10)}, {_COS} SELECT count(cos.query) AS hits, count(*) AS total, round(count(cos.query) / count(*), 2) AS fraction FROM knn LEFT JOIN cos USING (query, id)")
def recall_at_10(spark, sf_dir):
    points = _vectors(spark, sf_dir)
    found = quality.recall(knn.exact_knn(points, 10), knn.exact_knn(points, 10, COSINE), 10)
    return quality.total_recall(found).select("hits", "total", F.round("fraction", 2).alias("fraction"))


@query("SELECT o_orderkey, o_custkey, 8 * o_orderkey >= o_custkey * 16 AND o_orderkey <= 8 * o_custkey * 16 AS within, abs(o_orderkey - o_custkey * 16) AS deviation FROM orders")
def edge_scaling(spark, sf_dir):
    ok, off = quality.edge_scaling(F.col("o_orderkey"), F.col("o_custkey"), 16)
    return _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", ok.alias("within"), off.alias("deviation"))


@query("SELECT p_partkey, CAST(floor(ceil(p_retailprice) / p_size) AS BIGINT) AS per_point, CAST(floor(ceil(p_retailprice) / (p_partkey + 1)) AS BIGINT) AS per_edge FROM part")
def memory_per_item(spark, sf_dir):
    point, edge = quality.memory_record(F.ceil("p_retailprice"), F.col("p_size"), F.col("p_partkey") + 1)
    return _read(spark, sf_dir, "part").select("p_partkey", point.alias("per_point"), edge.alias("per_edge"))


@query("SELECT p_partkey, CAST(CASE WHEN p_size > 0 THEN floor(p_size * 10000 / (ceil(p_size / 16) * 16)) ELSE 0 END AS BIGINT) AS lanes FROM part")
def lane_utilisation(spark, sf_dir):
    return _read(spark, sf_dir, "part").select("p_partkey", scalar.lane_basis_points(F.col("p_size")).alias("lanes"))


@query("SELECT o_orderkey, CAST(CASE WHEN o_custkey > 0 THEN least(10000, greatest(0, round(o_orderkey * 10000 / o_custkey))) ELSE 0 END AS BIGINT) AS share FROM orders")
def duration_share(spark, sf_dir):
    return _read(spark, sf_dir, "orders").select("o_orderkey", scalar.duration_basis_points(F.col("o_orderkey"), F.col("o_custkey")).alias("share"))


@query("SELECT p_brand, CAST(floor(median(p_size)) AS BIGINT) AS median_size FROM part GROUP BY 1")
def sorted_median(spark, sf_dir):
    return _read(spark, sf_dir, "part").groupBy("p_brand").agg(scalar.floor_median(F.col("p_size")).alias("median_size"))


@query("SELECT count(*) AS calls, sum(p_size)::BIGINT AS candidates, min(p_size) AS least, max(p_size) AS most, CAST(floor(median(p_size)) AS BIGINT) AS median FROM part")
def batch_profile(spark, sf_dir):
    return quality.batch_profile(_read(spark, sf_dir, "part").select(F.col("p_size").alias("size")))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_discount = 0 THEN 'Infinity'::DOUBLE ELSE 1.0::DOUBLE / l_discount::DOUBLE END AS density FROM lineitem")
def lambda_values(spark, sf_dir):
    return _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", scalar.weight_to_lambda(F.col("l_discount").cast("double")).alias("density"))


@query("SELECT min(label)::BIGINT AS low, max(label)::BIGINT AS high, count(DISTINCT label) AS clusters, min(label) = 0 AND max(label) + 1 = count(DISTINCT label) AS contiguous FROM embeddings")
def assignment_contiguity(spark, sf_dir):
    one = label_summary(_read(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("label")))
    return one.select("low", "high", F.col("different").alias("clusters"), ((F.col("low") == 0) & (F.col("high") + 1 == F.col("different"))).alias("contiguous"))


@query(r"SELECT doc_id, regexp_replace(line, '[\r\n]+$', '') AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)")
def text_lines_clean(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents")
    return docs.select("doc_id", F.explode(F.split("text", "\n", -1)).alias("line")).select("doc_id", clean_line(F.col("line")).alias("line"))


@query(f"WITH {_E}, p AS (SELECT a.id AS source, b.id AS target, {_distance('a.item', 'b.item')} AS distance FROM e a JOIN e b ON a.id < b.id) SELECT * FROM p WHERE distance <= 1.2")
def similarity_join_eps(spark, sf_dir):
    return knn.similarity_join(_vectors(spark, sf_dir), 1.2)


@query(f"WITH {_near(5)} SELECT DISTINCT id FROM knn JOIN embeddings a ON a.vec_id = query JOIN embeddings b ON b.vec_id = id WHERE a.label = 0 AND b.label <> 0")
def incremental_targets(spark, sf_dir):
    """Older neighbours of new points, where those labelled 0 come last."""
    new = _read(spark, sf_dir, "embeddings").where("label = 0").select(F.col("vec_id").alias("id"), F.col("embedding").alias("item"))
    near = _links(spark, sf_dir).join(new.select(F.col("id").alias("query")), "query", "left_semi")
    return ClusteringSession.recompute_targets(new, near)


@query(f"WITH {_near(5, _S)}, {_CORE} SELECT id, core FROM core")
def session_core_distances(spark, sf_dir):
    """Core distances after appending all suppliers in two batches and recomputing what changed."""
    points = cut(_suppliers(spark, sf_dir))
    session = ClusteringSession(points, f"{shared_dir(spark)}/session-{uuid.uuid4().hex}")
    session.append_batch(points.where("id % 3 <> 0"), 0)
    session.recompute_core_distances()
    session.append_batch(points.where("id % 3 = 0"), 1)
    session.recompute_core_distances_full()
    return session.table("core").select("id", "core")


@query(f"WITH {_near(5, _S)}, {_CORE} SELECT id, core FROM core")
def session_after_restart(spark, sf_dir):
    """Core distances of a session that is opened anew for each batch of nations."""
    points = cut(_suppliers(spark, sf_dir))
    root = f"{shared_dir(spark)}/session-{uuid.uuid4().hex}"
    ClusteringSession(points, root).append_batch(points.where(F.get("item", F.lit(1)) < 12), 0)
    ClusteringSession(points, root).append_batch(points.where(F.get("item", F.lit(1)) >= 12), 1)
    session = ClusteringSession(points, root)
    session.recompute_core_distances()
    return session.table("core").select("id", "core")


@query("SELECT s_suppkey AS id FROM supplier")
def stream_append(spark, sf_dir):
    """The items of a session that follows a stream of their ids."""
    points = cut(_suppliers(spark, sf_dir))
    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    session = ClusteringSession(points, f"{root}/state")
    kinds = _read(spark, sf_dir, "supplier").schema
    ids = spark.readStream.schema(kinds).option("pathGlobFilter", "supplier.parquet").parquet(sf_dir).select(F.col("s_suppkey").alias("id"))
    session.follow(ids, f"{root}/checkpoint").awaitTermination()
    return session.table("points").select("id")


@query("SELECT vec_id AS id, CASE WHEN vec_id % 5 = 0 THEN 'NULL_ROW' WHEN vec_id % 5 = 1 THEN 'INVALID_ROW_LENGTH' ELSE 'NULL_VALUE' END AS reason FROM embeddings WHERE vec_id % 5 < 3")
def bad_vectors(spark, sf_dir):
    """What ingestion rejects where embeddings are broken: left out, cut short, or with an element missing."""
    v, kind = F.col("item"), F.col("id") % 5
    hole = F.concat(F.slice(v, 1, 63), F.array(F.lit(None).cast("float")))
    broken = F.when(kind == 0, F.lit(None)).when(kind == 1, F.slice(v, 1, 63)).when(kind == 2, hole).otherwise(v)
    return bad_rows(_vectors(spark, sf_dir).withColumn("item", broken), 64)


def _supplier_forest(spark, sf_dir):
    points = cut(_suppliers(spark, sf_dir))
    return points, cut(spanning_forest(weighted_edges(points, ClusterConfig(5), EUCLIDEAN)))


_WEIGHTED = f"""{_near(64, _S)}, {_CORE}, {_EDGES},
w AS (SELECT source, target, greatest(distance, s.core, t.core) AS weight FROM edges JOIN core s ON s.id = source JOIN core t ON t.id = target),
both_ways AS (SELECT source AS s, target AS t, weight FROM w UNION ALL SELECT target, source, weight FROM w),
prim AS (
  SELECT [0::BIGINT] AS tree, NULL::BIGINT AS source, NULL::BIGINT AS target, NULL::FLOAT AS weight
  UNION ALL
  SELECT list_append(tree, x.t), least(x.s, x.t), greatest(x.s, x.t), x.weight
  FROM prim, LATERAL (SELECT s, t, b.weight FROM both_ways b WHERE list_contains(prim.tree, s) AND NOT list_contains(prim.tree, t) ORDER BY b.weight, least(s, t), greatest(s, t) LIMIT 1) x),
forest AS (SELECT row_number() OVER (ORDER BY weight, source, target) AS place, source, target, weight FROM prim WHERE source IS NOT NULL),
-- The last merge above each point, after each edge in order.
m AS (
  SELECT 0::BIGINT AS place, (SELECT list(id ORDER BY id) FROM e) AS tops, NULL::BIGINT AS left, NULL::BIGINT AS right, NULL::FLOAT AS weight
  UNION ALL
  SELECT f.place, list_transform(m.tops, lambda t: CASE WHEN t = m.tops[f.source + 1] OR t = m.tops[f.target + 1] THEN len(m.tops) + f.place - 1 ELSE t END), m.tops[f.source + 1], m.tops[f.target + 1], f.weight
  FROM m JOIN forest f ON f.place = m.place + 1)"""


@query(f"WITH RECURSIVE {_WEIGHTED} SELECT CAST(len(tops) + place - 1 AS BIGINT) AS node, \"left\", \"right\", weight, CAST(len(list_filter(tops, lambda t: t = len(tops) + place - 1)) AS BIGINT) AS size FROM m WHERE place > 0")
def dendrogram_supplier(spark, sf_dir):
    points, forest = _supplier_forest(spark, sf_dir)
    return dendrogram(points.count(), forest)


_BIG, _BOTH = "(ls >= 5) <> (rs >= 5)", "ls >= 5 AND rs >= 5"
_CLUSTERS = f"""{_WEIGHTED},
d AS (SELECT place, CAST(len(tops) + place - 1 AS BIGINT) AS node, "left" AS l, "right" AS r, CAST(len(list_filter(tops, lambda t: t = len(tops) + place - 1)) AS BIGINT) AS size,
             CASE WHEN weight = 0 THEN 'Infinity'::DOUBLE ELSE CAST(1::FLOAT / weight AS DOUBLE) END AS density FROM m WHERE place > 0),
-- Merges of at least five points, with what they merge; clusters are named by the merge that begins them.
b AS (SELECT d.*, coalesce(x.size, 1) AS ls, coalesce(y.size, 1) AS rs FROM d LEFT JOIN d x ON x.node = d.l LEFT JOIN d y ON y.node = d.r WHERE d.size >= 5),
named AS (SELECT node, place AS start FROM b WHERE NOT ({_BIG}) UNION ALL
          SELECT b.node, named.start FROM named JOIN b ON {_BIG} AND named.node = CASE WHEN ls >= 5 THEN l ELSE r END),
shares AS (SELECT start, density, CASE WHEN NOT ({_BIG}) THEN size WHEN ls >= 5 THEN rs ELSE ls END AS part FROM b JOIN named USING (node)),
sums AS (SELECT start, sum(density * part) AS total, CAST(sum(part) AS BIGINT) AS size FROM shares GROUP BY 1),
kids AS (SELECT start, b.place AS parent, density AS birth, 0 AS side FROM b JOIN named n ON n.node = b.l WHERE {_BOTH} UNION ALL
         SELECT start, b.place, density, 1 FROM b JOIN named n ON n.node = b.r WHERE {_BOTH}),
c AS (SELECT start, parent, coalesce(birth, 0::DOUBLE) AS birth, coalesce(side, 0) AS side, size, total - coalesce(birth * size, 0) AS stability FROM sums LEFT JOIN kids USING (start)),
splits AS (SELECT k.parent AS place, max(start) FILTER (side = 0) AS l, max(start) FILTER (side = 1) AS r, max(stability) FILTER (side = 0) AS sl, max(stability) FILTER (side = 1) AS sr,
                  row_number() OVER (ORDER BY k.parent) AS nth FROM c k WHERE k.parent IS NOT NULL GROUP BY 1),
-- From the lowest split up: the best that is below each.
best AS (SELECT 0::BIGINT AS nth, list_transform(range(1, (SELECT max(place) + 1 FROM d)), lambda x: NULL::DOUBLE) AS below UNION ALL
         SELECT s.nth, list_transform(best.below, lambda x, i: CASE WHEN i = s.place THEN CASE WHEN best.below[s.l] > s.sl THEN best.below[s.l] ELSE s.sl END + CASE WHEN best.below[s.r] > s.sr THEN best.below[s.r] ELSE s.sr END ELSE x END)
         FROM best JOIN splits s ON s.nth = best.nth + 1),
k AS (SELECT c.*, NOT coalesce((SELECT arg_max(below, nth) FROM best)[start] > stability, FALSE) AS kept FROM c),
tops AS (SELECT start, CASE WHEN kept THEN start END AS chosen, '' AS path FROM k WHERE parent IS NULL UNION ALL
         SELECT k.start, coalesce(t.chosen, CASE WHEN k.kept THEN k.start END), t.path || k.side FROM tops t JOIN k ON k.parent = t.start),
numbers AS (SELECT chosen, row_number() OVER (ORDER BY path <> '', left(path, greatest(0, len(path) - 1)), right(path, 1)) - 1 AS label FROM tops WHERE chosen = start),
above AS (SELECT id, arg_min(u.node, u.place) AS node FROM (SELECT place, unnest(range(0, len(m.tops))) AS id, unnest(m.tops) AS node FROM m) u JOIN d ON d.node = u.node WHERE d.size >= 5 GROUP BY 1),
assigned AS (SELECT e.id, coalesce(label, (SELECT count(*) FROM numbers)) AS label FROM e LEFT JOIN above USING (id) LEFT JOIN named USING (node) LEFT JOIN tops USING (start) LEFT JOIN numbers USING (chosen))"""


@query(f"WITH RECURSIVE {_CLUSTERS} SELECT label, count(*) AS size FROM assigned GROUP BY 1")
def cluster_sizes_supplier(spark, sf_dir):
    return cluster(_suppliers(spark, sf_dir), ClusterConfig(5)).groupBy("label").agg(F.count("*").alias("size"))


@query(f"WITH RECURSIVE {_CLUSTERS} SELECT CAST(id AS BIGINT) AS id, label FROM assigned")
def cluster_labels_supplier(spark, sf_dir):
    return cluster(_suppliers(spark, sf_dir), ClusterConfig(5))


@query(f"WITH RECURSIVE {_CLUSTERS} SELECT CAST(id AS BIGINT) AS id, label FROM assigned")
def session_refresh(spark, sf_dir):
    """Labels of a session that is opened anew and refreshed after each of two batches of nations."""
    points = cut(_suppliers(spark, sf_dir))
    root = f"{shared_dir(spark)}/session-{uuid.uuid4().hex}"
    for number, own in enumerate((F.get("item", F.lit(1)) < 12, F.get("item", F.lit(1)) >= 12)):
        session = ClusteringSession(points, root)
        session.append_batch(points.where(own), number)
        session.refresh()
    return session.table("labels").select("id", "label")


@query()
def cluster_labels(spark, sf_dir):
    return cluster(_vectors(spark, sf_dir))


@query(f"WITH RECURSIVE {_CLUSTERS} SELECT -start AS cluster, -parent AS parent, round(birth, 6) AS birth, round(stability, 4) AS stability, size, kept, side FROM k")
def condensed_tree(spark, sf_dir):
    """Clusters are named by the number of the merge that begins them, turned negative."""
    points, forest = _supplier_forest(spark, sf_dir)
    tree = condense(points, forest, 5).clusters
    return tree.select("cluster", "parent", F.round("birth", 6).alias("birth"), F.round("stability", 4).alias("stability"), "size", "kept", "side")


@query()
def blobs_agreement(spark, sf_dir):
    """Clusters of the suppliers against their nations."""
    known = _read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").cast("long").alias("label"))
    return quality.compare(cluster(_suppliers(spark, sf_dir)), known)


@query()
def similarity_join_work(spark, sf_dir):
    """Pairs that the join over cells finds among suppliers, and pairs that it compared."""
    points = cut(_suppliers(spark, sf_dir))
    return cells.similarity_join(points, 50.0).work


@query()
def approximate_recall(spark, sf_dir):
    """Recall at 10 of the refined neighbour graph against the exact one, and the pairs that it compared."""
    points = cut(_vectors(spark, sf_dir))
    graph = neighbour_graph(points, 10)
    # A graph of all pairs is the exact one: it isn't made again.
    exact = graph.neighbours if graph.exact else knn.exact_knn(points, 10)
    found = quality.total_recall(quality.recall(exact, graph.neighbours, 10))
    return found.select("*", F.lit(graph.compared).alias("compared"), F.lit(graph.share).alias("share_of_square"), F.lit(graph.rounds).alias("rounds"))
