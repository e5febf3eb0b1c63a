"""Registered queries for the graph operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import communities as C
from ..operators import graph as G
from ..operators import rules as R
from ..operators import sampling as L
from ..sources.tables import scam_seed, tx_view
from .registry import register, with_tx

EDGES_SQL = """
e AS MATERIALIZED (SELECT from_addr AS src, to_addr AS dst, weight, tx_hash FROM (
        SELECT from_addr, to_addr, coalesce(CAST(value_eth AS DOUBLE), 1.0) AS weight, hash AS tx_hash,
               row_number() OVER (PARTITION BY from_addr, to_addr
                                  ORDER BY ts DESC, block_number DESC, tx_index DESC, hash DESC) AS rn
        FROM tx WHERE from_addr IS NOT NULL AND to_addr IS NOT NULL) WHERE rn = 1),
nodes AS MATERIALIZED (SELECT src AS address FROM e UNION SELECT dst FROM e),
nn AS (SELECT count(*) AS n FROM nodes),
scam AS (SELECT DISTINCT from_addr AS address FROM tx WHERE from_addr % 97 = 0),
und AS MATERIALIZED (SELECT DISTINCT u, v FROM (SELECT src AS u, dst AS v FROM e WHERE src <> dst
                                                UNION ALL SELECT dst, src FROM e WHERE src <> dst))"""

DEGREE_SQL = """
deg AS (SELECT address,
               CAST((SELECT count(*) FROM e WHERE e.dst = address) AS BIGINT) AS in_degree,
               CAST((SELECT count(*) FROM e WHERE e.src = address) AS BIGINT) AS out_degree
        FROM nodes),
degc AS (SELECT address, in_degree, out_degree,
                in_degree * CASE WHEN n - 1 > 0 THEN CAST(1 AS DOUBLE) / (n - 1) ELSE 0.0 END AS in_degree_centrality,
                out_degree * CASE WHEN n - 1 > 0 THEN CAST(1 AS DOUBLE) / (n - 1) ELSE 0.0 END AS out_degree_centrality,
                (in_degree + out_degree) * CASE WHEN n - 1 > 0 THEN CAST(1 AS DOUBLE) / (n - 1) ELSE 0.0 END
                  AS degree_centrality
         FROM deg, nn)"""

CLUSTER_SQL = """
d AS (SELECT u AS address, count(*) AS d FROM und GROUP BY u),
loops AS (SELECT DISTINCT src AS address, 1 AS lp FROM e WHERE src = dst),
dk AS (SELECT nodes.address, coalesce(d.d, 0) AS d, coalesce(loops.lp, 0) AS lp,
              coalesce(d.d, 0) + 2 * coalesce(loops.lp, 0) AS k
       FROM nodes LEFT JOIN d USING (address) LEFT JOIN loops USING (address)),
nb AS (SELECT und.u AS address, sum(dk.k) AS s FROM und JOIN dk ON dk.address = und.v GROUP BY und.u),
tri AS (SELECT a.u AS address, count(*) AS t FROM und a JOIN und b ON a.u = b.u AND a.v < b.v
        JOIN und c ON c.u = a.v AND c.v = b.v GROUP BY a.u),
cl AS (SELECT dk.address,
              CASE WHEN dk.d < 2 THEN 0.0 ELSE 2.0 * coalesce(tri.t, 0) / (dk.d * (dk.d - 1)) END AS clustering_coefficient,
              CASE WHEN dk.k = 0 THEN 0.0 ELSE (coalesce(nb.s, 0) + dk.lp * dk.k) / dk.k END AS avg_neighbor_degree,
              CAST(coalesce(tri.t, 0) AS BIGINT) AS triangles
       FROM dk LEFT JOIN nb USING (address) LEFT JOIN tri USING (address))"""


def _bfs_sql(levels: int = 25) -> str:
    parts = ["r0 AS MATERIALIZED (SELECT address AS node, 0 AS dist FROM scam WHERE address IN (SELECT address FROM nodes))"]
    for k in range(1, levels + 1):
        parts.append(
            f"r{k} AS MATERIALIZED (SELECT node, dist FROM r{k - 1} UNION ALL "
            f"SELECT DISTINCT e.src, {k} FROM e JOIN r{k - 1} p ON e.dst = p.node AND p.dist = {k - 1} "
            f"WHERE e.src NOT IN (SELECT node FROM r{k - 1}))")
    parts.append(f"dist AS (SELECT nodes.address, coalesce(r.dist, 999) AS distance_to_scam "
                 f"FROM nodes LEFT JOIN r{levels} r ON r.node = nodes.address)")
    return ",\n".join(parts)


SCAMN_SQL = """
sn AS (SELECT nodes.address, CAST(coalesce(c.cnt, 0) AS BIGINT) AS scam_neighbor_count,
              CASE WHEN coalesce(c.cnt, 0) > 0 THEN 1 ELSE 0 END AS direct_scam_connection
       FROM nodes LEFT JOIN (SELECT src, count(DISTINCT dst) AS cnt FROM e
                             WHERE dst IN (SELECT address FROM scam) GROUP BY src) c ON c.src = nodes.address)"""


def _edges(spark, sf):
    return G.build_edges(tx_view(spark, sf))


@register("graph_edges", with_tx(EDGES_SQL + """
SELECT src, dst, round(weight, 6) AS weight, tx_hash FROM e"""))
def q_edges(spark, sf):
    """G1: one edge per (from, to), the last transaction wins."""
    return _edges(spark, sf).select("src", "dst", "weight", "tx_hash")


@register("graph_stats", with_tx(EDGES_SQL + """
SELECT n AS n_nodes, (SELECT count(*) FROM e) AS n_edges,
       round(CAST((SELECT count(*) FROM e) AS DOUBLE) / CAST(n * (n - 1) AS DOUBLE), 6) AS density FROM nn"""))
def q_graph_stats(spark, sf):
    """G2."""
    return G.graph_stats(_edges(spark, sf))


@register("degree_centrality", with_tx(EDGES_SQL + "," + DEGREE_SQL + """
SELECT address, in_degree, out_degree, round(in_degree_centrality, 6) AS in_degree_centrality,
       round(out_degree_centrality, 6) AS out_degree_centrality, round(degree_centrality, 6) AS degree_centrality
FROM degc"""))
def q_degree(spark, sf):
    """G3."""
    return G.degree_centrality(_edges(spark, sf))


@register("clustering", with_tx(EDGES_SQL + "," + CLUSTER_SQL + """
SELECT address, round(clustering_coefficient, 6) AS clustering_coefficient,
       round(avg_neighbor_degree, 6) AS avg_neighbor_degree, triangles FROM cl"""))
def q_clustering(spark, sf):
    """Clustering coefficient, average neighbour degree, triangles."""
    return G.clustering_features(_edges(spark, sf))


@register("scam_distance", with_tx(EDGES_SQL + ",\n" + _bfs_sql() + """
SELECT address, distance_to_scam, CASE WHEN distance_to_scam = 999 THEN 0 ELSE 1 END AS reachable FROM dist"""))
def q_scam_distance(spark, sf):
    """Directed hops towards the nearest scam address (999 unreachable)."""
    tx = tx_view(spark, sf)
    return G.scam_distance(G.build_edges(tx), scam_seed(tx))


@register("scam_neighbors", with_tx(EDGES_SQL + "," + SCAMN_SQL + """
SELECT address, scam_neighbor_count, direct_scam_connection FROM sn"""))
def q_scam_neighbors(spark, sf):
    """G11 + G12."""
    tx = tx_view(spark, sf)
    return G.scam_neighbors(G.build_edges(tx), scam_seed(tx))


@register("graph_features", with_tx(EDGES_SQL + "," + DEGREE_SQL + "," + CLUSTER_SQL + ",\n" + _bfs_sql()
                                    + "," + SCAMN_SQL + """
SELECT tx.hash, round(coalesce(degc.degree_centrality, 0), 6) AS degree_centrality,
       round(coalesce(cl.clustering_coefficient, 0), 6) AS clustering_coefficient,
       CAST(coalesce(cl.triangles, 0) AS BIGINT) AS triangles,
       coalesce(dist.distance_to_scam, 0) AS distance_to_scam,
       CAST(coalesce(sn.scam_neighbor_count, 0) AS BIGINT) AS scam_neighbor_count
FROM tx LEFT JOIN degc ON degc.address = tx.from_addr LEFT JOIN cl ON cl.address = tx.from_addr
        LEFT JOIN dist ON dist.address = tx.from_addr LEFT JOIN sn ON sn.address = tx.from_addr"""))
def q_graph_features(spark, sf):
    """G13, the columns that its SQL has: node features joined to transactions on
    the sender (missing -> 0). ``graph_features_all`` has every column."""
    tx = tx_view(spark, sf)
    d = G.join_node_features(tx, G.relational_node_features(G._ckpt(G.build_edges(tx).select("src", "dst")), scam_seed(tx)))
    return d.select("hash", "degree_centrality", "clustering_coefficient", "triangles",
                    "distance_to_scam", "scam_neighbor_count")


@register("graph_features_all")
def q_graph_features_all(spark, sf):
    """All four feature tables joined to transactions on the sender (PageRank
    and betweenness in parts per million, so that six decimals keep the digits)."""
    tx = tx_view(spark, sf)
    d = G.graph_features(tx, scam_seed(tx))
    names = ["in_degree", "out_degree", "in_degree_centrality", "out_degree_centrality", "degree_centrality", "clustering_coefficient",
             "avg_neighbor_degree", "triangles", "community_id", "community_size", "distance_to_scam", "scam_neighbor_count", "direct_scam_connection"]
    return d.select("hash", *names, (F.col("pagerank_score") * 1000000).alias("pagerank_ppm"),
                    (F.col("betweenness_centrality") * 1000000).alias("betweenness_ppm"))


@register("scam_seed_from_labels", with_tx("""
scam AS (SELECT DISTINCT from_addr AS address FROM tx WHERE from_addr % 97 = 0),
lt AS (SELECT tx.*, CASE WHEN from_addr IN (SELECT address FROM scam) OR to_addr IN (SELECT address FROM scam)
                         THEN 1 ELSE 0 END AS is_fraud FROM tx)
SELECT DISTINCT to_addr AS address FROM lt WHERE is_fraud = 1 AND to_addr IS NOT NULL"""))
def q_seed_labels(spark, sf):
    """Receivers of fraud-labelled transactions."""
    tx = tx_view(spark, sf)
    return G.scam_seed_from_labels(R.known_scam_labels(tx, scam_seed(tx), out="is_fraud"))


@register("scam_seed_training", with_tx("""
scam AS (SELECT DISTINCT from_addr AS address FROM tx WHERE from_addr % 97 = 0),
o AS (SELECT tx.*, row_number() OVER (ORDER BY ts, hash) AS rn, count(*) OVER () AS n FROM tx)
SELECT DISTINCT to_addr AS address FROM o WHERE rn <= CAST(floor(n * 0.8) AS BIGINT) AND to_addr IS NOT NULL
  AND (from_addr IN (SELECT address FROM scam) OR to_addr IN (SELECT address FROM scam))"""))
def q_seed_training(spark, sf):
    """G14 from the training period only (the default form for models)."""
    tx = tx_view(spark, sf)
    d = L.temporal_split(R.known_scam_labels(tx, scam_seed(tx), out="is_fraud"))
    return G.scam_seed_from_labels(d, test_flag="is_test")


@register("top_central", with_tx(EDGES_SQL + "," + DEGREE_SQL + """
SELECT address, in_degree, out_degree, round(in_degree_centrality, 6) AS in_degree_centrality,
       round(out_degree_centrality, 6) AS out_degree_centrality, round(degree_centrality, 6) AS degree_centrality
FROM degc ORDER BY degree_centrality DESC, address LIMIT 50"""))
def q_top_central(spark, sf):
    """50 most central nodes."""
    return G.top_central(_edges(spark, sf))


PR_ITERS = 20


def _pagerank_sql(iters: int = PR_ITERS, alpha: float = 0.85) -> str:
    restart = repr((1.0 - alpha))
    parts = ["""ow AS (SELECT src, sum(weight) AS W FROM e GROUP BY src),
en AS MATERIALIZED (SELECT e.src, e.dst, e.weight / ow.W AS p FROM e JOIN ow USING (src) WHERE ow.W > 0),
dang AS MATERIALIZED (SELECT address AS node FROM nodes WHERE address NOT IN (SELECT src FROM ow WHERE W > 0)),
x0 AS MATERIALIZED (SELECT address AS node, 1.0 / n AS x FROM nodes, nn)"""]
    for i in range(1, iters + 1):
        p = f"x{i - 1}"
        parts.append(
            f"x{i} AS MATERIALIZED (SELECT nodes.address AS node, "
            f"CAST({alpha} AS DOUBLE) * coalesce(cc.c, 0.0) + CAST({alpha} AS DOUBLE) * dd.d / CAST(n AS DOUBLE) "
            f"+ CAST({restart} AS DOUBLE) / n AS x "
            f"FROM nodes LEFT JOIN (SELECT en.dst, sum({p}.x * en.p) AS c FROM en JOIN {p} ON en.src = {p}.node "
            f"GROUP BY en.dst) cc ON cc.dst = nodes.address, "
            f"(SELECT coalesce(sum(x), 0.0) AS d FROM {p} WHERE node IN (SELECT node FROM dang)) dd, nn)")
    return ",\n".join(parts)


@register("pagerank_fixed", with_tx(EDGES_SQL + ",\n" + _pagerank_sql() + f"""
SELECT node AS address, round(x * 1000000, 6) AS pagerank_ppm FROM x{PR_ITERS}"""))
def q_pagerank_fixed(spark, sf):
    """G5, fixed 20 rounds (comparable with an unrolled SQL form); in parts
    per million so that six decimals keep the digits."""
    pr = G.pagerank(_edges(spark, sf), fixed_iter=PR_ITERS)
    return pr.select(F.col("node").alias("address"), (F.col("pagerank") * 1000000).alias("pagerank_ppm"))


@register("pagerank")
def q_pagerank(spark, sf):
    """G5 to convergence (L1 change < n * 1e-6); checked by properties (sum 1)."""
    pr = G.pagerank(_edges(spark, sf))
    return pr.select(F.col("node").alias("address"), "pagerank")


LPA_ITERS = 10


def _lpa_sql(iters: int = LPA_ITERS) -> str:
    parts = ["l0 AS MATERIALIZED (SELECT address AS node, address AS label FROM nodes)"]
    for i in range(1, iters + 1):
        p = f"l{i - 1}"
        parts.append(
            f"l{i} AS MATERIALIZED (SELECT {p}.node, coalesce(b.label, {p}.label) AS label FROM {p} LEFT JOIN "
            f"(SELECT node, label FROM (SELECT und.u AS node, l.label, row_number() OVER "
            f"(PARTITION BY und.u ORDER BY count(*) DESC, l.label) AS rn FROM und JOIN {p} l ON und.v = l.node "
            f"GROUP BY und.u, l.label) WHERE rn = 1) b ON b.node = {p}.node)")
    return ",\n".join(parts)


@register("communities_fixed", with_tx(EDGES_SQL + ",\n" + _lpa_sql() + f""",
sizes AS (SELECT label, count(*) AS community_size FROM l{LPA_ITERS} GROUP BY label),
ranked AS (SELECT label, community_size,
                  CAST(row_number() OVER (ORDER BY community_size DESC, label) - 1 AS INTEGER) AS community_id
           FROM sizes)
SELECT node AS address, community_id, CAST(community_size AS BIGINT) AS community_size
FROM l{LPA_ITERS} JOIN ranked USING (label)"""))
def q_communities_fixed(spark, sf):
    """G9 (re-aimed), fixed 10 rounds (comparable with an unrolled SQL form)."""
    return G.label_propagation(_edges(spark, sf), LPA_ITERS)


@register("communities")
def q_communities(spark, sf):
    """G9 (re-aimed): synchronous label propagation until the labels settle, ids
    by size; checked against brute force."""
    return G.label_propagation(_edges(spark, sf))


# A view of all transactions with a planted partition: a receiver is taken from its sender's group (one of GROUPS),
# but for one transaction in sixteen, by an MD5 digit of the hash.
GROUPS = 8
MOVES = 6


def planted_edges(spark, sf):
    tx = tx_view(spark, sf)
    stray = F.substring(F.md5("hash"), 1, 1) == "0"
    home = F.col("to_addr") - F.col("to_addr") % GROUPS + F.col("from_addr") % GROUPS
    return G.build_edges(tx.withColumn("to_addr", F.when(stray, F.col("to_addr")).otherwise(home)))


def _moving_sql(rounds: int = MOVES) -> str:
    parts = [f"""pe AS MATERIALIZED (SELECT DISTINCT from_addr AS a, CASE WHEN md5(hash)[1] = '0' THEN to_addr
             ELSE to_addr - to_addr % {GROUPS} + from_addr % {GROUPS} END AS b FROM tx),
  pu AS MATERIALIZED (SELECT a AS u, b AS v FROM pe WHERE a != b UNION SELECT b, a FROM pe WHERE a != b),
  pm AS (SELECT count(*)::HUGEINT AS m2 FROM pu),
  pk AS MATERIALIZED (SELECT n.node, (SELECT count(*) FROM pu WHERE pu.u = n.node)::HUGEINT AS k, md5(n.node::VARCHAR)[1] >= '8' AS half
                      FROM (SELECT a AS node FROM pe UNION SELECT b FROM pe) n),
  c0 AS MATERIALIZED (SELECT node, k, half, node AS c FROM pk)"""]
    for i in range(1, rounds + 1):
        p = f"c{i - 1}"
        parts.append(f"""o{i} AS MATERIALIZED (SELECT n.node, n.c, n.k, x.cv, max(x.wc) AS wc FROM {p} n JOIN (
      SELECT pu.u, q.c AS cv, count(*) AS wc FROM pu JOIN {p} q ON pu.v = q.node GROUP BY ALL UNION ALL SELECT node, c, 0 FROM {p}) x
      ON x.u = n.node WHERE n.half = {'true' if i % 2 == 0 else 'false'} GROUP BY ALL),
  g{i} AS MATERIALIZED (SELECT o.node, o.c, o.cv, m2 * o.wc - o.k * (s.kc - CASE WHEN o.cv = o.c THEN o.k ELSE 0 END) AS gain
      FROM o{i} o JOIN (SELECT c, sum(k) AS kc FROM {p} GROUP BY c) s ON s.c = o.cv, pm),
  b{i} AS MATERIALIZED (SELECT node, arg_min(cv, (-gain, cv)) AS best, max(gain) AS top, max(CASE WHEN cv = c THEN gain END) AS own FROM g{i} GROUP BY node),
  c{i} AS MATERIALIZED (SELECT p.node, p.k, p.half, CASE WHEN b.top > b.own THEN b.best ELSE p.c END AS c FROM {p} p LEFT JOIN b{i} b ON b.node = p.node)""")
    return ",\n  ".join(parts)


@register("local_moving_fixed", with_tx(_moving_sql() + f""",
  z AS (SELECT c, count(*) AS community_size, min(node) AS low FROM c{MOVES} GROUP BY c),
  r AS (SELECT c, community_size, CAST(row_number() OVER (ORDER BY community_size DESC, low) - 1 AS INTEGER) AS community_id FROM z)
  SELECT node AS address, community_id, CAST(community_size AS BIGINT) AS community_size FROM c{MOVES} JOIN r USING (c)"""))
def q_local_moving(spark, sf):
    """Six rounds of local moving on the planted view (comparable with an unrolled SQL form)."""
    return C.local_communities(planted_edges(spark, sf), MOVES)


@register("communities_modularity")
def q_communities_modularity(spark, sf):
    """Communities of the planted view by local moving and contraction until no gain."""
    return C.modularity_communities(planted_edges(spark, sf))


@register("betweenness")
def q_betweenness(spark, sf):
    """Directed betweenness; all nodes as pivots up to 1000 nodes, else 1000
    pivots in hash order (the sampled estimator, scaled by n / k)."""
    e = _edges(spark, sf)
    return G.betweenness(e, G.sampled_pivots(e))
