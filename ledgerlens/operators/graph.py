"""Transfer-graph operators (G1-G15) over ``edges(src, dst, weight, ts, tx_hash)``.

Relational measures (degrees, triangles, clustering, neighbour degree, scam
neighbours) are joins and aggregations on the edge table. Triangles are counted
by colour triples: nodes are coloured by a hash, every edge goes to the groups
that hold its ends' colours, and each group counts its own. Iterative measures (BFS distance,
PageRank, label propagation) are driver loops of DataFrame steps; each round's
state is checkpointed to the session's checkpoint directory, so lineage stays
short and a lost executor costs one round, not the whole history.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.joins import land
from ..functions.ranking import row_number_by
from ..session import checkpoint_dir
from ..sources.tables import TX_ORDER
from .blocks import block_of, blocks_for, packed, spread
from .neighbours import ROW_ENDS, Neighbours, dealt, parts_for
from .pivots import dependencies

UNREACHABLE = 999


def build_edges(tx: DataFrame, weight_col: str = "value_eth", null_address=None) -> DataFrame:
    """G1: directed simple graph. A repeated (from, to) pair keeps the *last*
    transaction in time order (weight, time and hash are not summed); a missing
    weight is 1.0. Transactions without a receiver stay out unless
    ``null_address`` names a node for them."""
    t = tx
    if null_address is not None:
        t = t.withColumn("to_addr", F.coalesce(F.col("to_addr").cast("string"), F.lit(str(null_address))))
    t = t.where(F.col("from_addr").isNotNull() & F.col("to_addr").isNotNull())
    order = F.struct(*[F.col(c) for c in TX_ORDER])
    last = F.max_by(F.struct(F.coalesce(F.col(weight_col).cast("double"), F.lit(1.0)).alias("weight"),
                             F.col("ts").alias("ts"), F.col("hash").alias("tx_hash")), order)
    return (t.groupBy(F.col("from_addr").alias("src"), F.col("to_addr").alias("dst"))
            .agg(last.alias("_e")).select("src", "dst", "_e.weight", "_e.ts", "_e.tx_hash"))


def nodes_of(edges: DataFrame) -> DataFrame:
    """Node set = every endpoint."""
    return (edges.select(F.col("src").alias("address"))
            .union(edges.select(F.col("dst").alias("address"))).distinct())


def graph_stats(edges: DataFrame) -> DataFrame:
    """Nodes, edges, density m / (n (n - 1))."""
    n = nodes_of(edges).agg(F.count(F.lit(1)).alias("n_nodes"))
    m = edges.agg(F.count(F.lit(1)).alias("n_edges"))
    return n.crossJoin(m).withColumn(
        "density", F.try_divide(F.col("n_edges").cast("double"),
                                (F.col("n_nodes") * (F.col("n_nodes") - 1)).cast("double")))


def degree_centrality(edges: DataFrame) -> DataFrame:
    """In / out / total degree and their centralities (degree / (n - 1));
    a self-loop counts once in each direction."""
    nodes = nodes_of(edges)
    n = nodes.agg((F.count(F.lit(1)) - 1).alias("_n1"))
    ind = edges.groupBy(F.col("dst").alias("address")).agg(F.count(F.lit(1)).alias("in_degree"))
    outd = edges.groupBy(F.col("src").alias("address")).agg(F.count(F.lit(1)).alias("out_degree"))
    d = (nodes.join(ind, "address", "left").join(outd, "address", "left")
         .na.fill(0, ["in_degree", "out_degree"]).crossJoin(F.broadcast(n)))
    inv = F.when(F.col("_n1") > 0, 1.0 / F.col("_n1")).otherwise(F.lit(0.0))
    return d.select("address", F.col("in_degree").cast("bigint"), F.col("out_degree").cast("bigint"),
                    (F.col("in_degree") * inv).alias("in_degree_centrality"),
                    (F.col("out_degree") * inv).alias("out_degree_centrality"),
                    ((F.col("in_degree") + F.col("out_degree")) * inv).alias("degree_centrality"))


def undirected(edges: DataFrame) -> DataFrame:
    """Distinct undirected neighbour pairs (both orientations), self-loops dropped."""
    return both_ways(edges).distinct()


def both_ways(edges: DataFrame) -> DataFrame:
    """(u, v) and (v, u) of every edge, self-loops dropped."""
    e = edges.where(F.col("src") != F.col("dst"))
    return e.select(F.col("src").alias("u"), F.col("dst").alias("v")).union(
        e.select(F.col("dst").alias("u"), F.col("src").alias("v")))


#: Edges that a task of the triangle count should hold, and fewest colours (C + 2 over 3 groups keep that many tasks busy).
TASK_EDGES = 2_000_000
LEAST_COLOURS = 4
#: Wedges of one numpy step.
STEP_WEDGES = 4_000_000


def _count_triangles(key: tuple, rows: pa.Table) -> pa.Table:
    """Triangles of one colour triple per node: every oriented edge a->b with every b->c, if a->c is there."""
    want = np.sort(np.array([int(key[i].as_py()) for i in range(3)]))
    ends = pa.concat_arrays([c.chunk(i) for c in (rows.column("a"), rows.column("b")) for i in range(c.num_chunks)]).dictionary_encode()
    node = ends.indices.to_numpy().astype(np.int64)
    n, m = len(ends.dictionary), rows.num_rows
    a, b = node[:m], node[m:]
    colour = np.zeros(n, np.int64)
    colour[a], colour[b] = rows.column("ca").to_numpy(), rows.column("cb").to_numpy()
    edge = np.sort(a * n + b)
    a, b = edge // n, edge % n
    first = np.searchsorted(a, np.arange(n + 1))
    out = first[b + 1] - first[b]  # how many edges go on from b
    credit = np.zeros(n, np.int64)
    till = np.cumsum(out)
    i = 0
    while i < m:
        j = max(i + 1, int(np.searchsorted(till, (till[i - 1] if i else 0) + STEP_WEDGES, "right")))
        w = out[i:j]
        e = np.repeat(np.arange(i, j), w)
        c = b[np.arange(len(e)) - np.repeat(np.cumsum(w) - w, w) + first[b[e]]]
        ask = a[e] * n + c
        at = np.minimum(np.searchsorted(edge, ask), m - 1)
        hit = edge[at] == ask
        x, y, z = a[e][hit], b[e][hit], c[hit]
        mine = (np.sort(np.stack((colour[x], colour[y], colour[z])), axis=0) == want[:, None]).all(axis=0)
        for v in (x[mine], y[mine], z[mine]):
            credit += np.bincount(v, minlength=n)
        i = j
    some = np.flatnonzero(credit)
    return pa.table({"address": ends.dictionary.take(pa.array(some)), "t": pa.array(credit[some])})


def triangles(edges: DataFrame, und: DataFrame | None = None) -> DataFrame:
    """Triangles per node on the undirected graph (self-loops ignored).

    Nodes get one of C colours by a hash, and every edge is sent to the C groups of three colours that hold
    those of its ends: a triangle's edges meet in the group of its three colours and are counted there, and
    only there. So C copies of the edges are shuffled (C grows with the square root of the edges over
    ``TASK_EDGES``), and no neighbour list is sent anywhere. Edges point from the end of lower degree (then id)
    to the other, so few edges go on from any node, hubs included, and each triangle has one order."""
    und = und if und is not None else undirected(edges)
    deg = und.groupBy("u").agg(F.count(F.lit(1)).alias("d"))
    canon = und.where(F.col("u") < F.col("v"))
    r = (canon.join(deg.select("u", F.col("d").alias("du")), "u")
         .join(deg.select(F.col("u").alias("v"), F.col("d").alias("dv")), "v"))
    lower_u = (F.col("du") < F.col("dv")) | ((F.col("du") == F.col("dv")) & (F.col("u") < F.col("v")))
    fwd = r.select(F.when(lower_u, F.col("u")).otherwise(F.col("v")).alias("a"),
                   F.when(lower_u, F.col("v")).otherwise(F.col("u")).alias("b"))
    n_colours = max(LEAST_COLOURS, math.ceil(math.sqrt(9 * canon.count() / TASK_EDGES)))
    colour = [F.pmod(F.xxhash64(c), F.lit(n_colours)).cast("int").alias("c" + c) for c in "ab"]
    dealt = fwd.select("a", "b", *colour).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(n_colours - 1))))
    dealt = dealt.withColumn("k", F.array_sort(F.array("ca", "cb", "x"))).select("a", "b", "ca", "cb", *[F.col("k")[i].alias(f"k{i}") for i in range(3)])
    kind = dict(fwd.dtypes)["a"]
    t = dealt.groupBy("k0", "k1", "k2").applyInArrow(_count_triangles, f"address {kind}, t long") \
        .groupBy("address").agg(F.sum("t").alias("triangles"))
    return (nodes_of(edges).join(t, "address", "left")
            .select("address", F.coalesce(F.col("triangles"), F.lit(0)).cast("bigint").alias("triangles")))


def clustering_features(edges: DataFrame) -> DataFrame:
    """Local clustering 2T / (d (d - 1)) (d without self-loops, d < 2 -> 0),
    average neighbour degree (a self-loop counts 2 in degree and the node is its
    own neighbour; isolated -> 0) and triangle count. The undirected edge
    table feeds three branches and is checkpointed once; weights, times and hashes are not carried along."""
    edges = _ckpt(edges.select("src", "dst"))
    und = _ckpt(undirected(edges))
    nodes = nodes_of(edges)
    d = und.groupBy(F.col("u").alias("address")).agg(F.count(F.lit(1)).alias("d"))
    loops = edges.where(F.col("src") == F.col("dst")).select(F.col("src").alias("address")).distinct() \
        .withColumn("_loop", F.lit(1))
    deg = (nodes.join(d, "address", "left").join(loops, "address", "left")
           .select("address", F.coalesce(F.col("d"), F.lit(0)).alias("d"),
                   F.coalesce(F.col("_loop"), F.lit(0)).alias("_loop")))
    deg = deg.withColumn("k", F.col("d") + 2 * F.col("_loop"))
    nbr = (und.join(deg.select(F.col("address").alias("v"), F.col("k").alias("kv")), "v")
           .groupBy(F.col("u").alias("address")).agg(F.sum("kv").alias("_s")))
    tri = triangles(edges, und)
    out = deg.join(nbr, "address", "left").join(tri, "address", "left")
    s = F.coalesce(F.col("_s"), F.lit(0)) + F.col("_loop") * F.col("k")
    return out.select(
        "address",
        F.when(F.col("d") < 2, F.lit(0.0))
        .otherwise(2.0 * F.col("triangles") / (F.col("d") * (F.col("d") - 1))).alias("clustering_coefficient"),
        F.when(F.col("k") == 0, F.lit(0.0)).otherwise(s / F.col("k")).alias("avg_neighbor_degree"),
        F.col("triangles"))


def scam_neighbors(edges: DataFrame, scam: DataFrame) -> DataFrame:
    """Distinct successors in the scam set and the direct-connection flag."""
    s = scam.select(F.col("address").alias("dst")).distinct()
    c = (edges.join(s, "dst", "left_semi").groupBy(F.col("src").alias("address"))
         .agg(F.count_distinct("dst").alias("scam_neighbor_count")))
    d = nodes_of(edges).join(c, "address", "left").na.fill(0, ["scam_neighbor_count"])
    return d.select("address", F.col("scam_neighbor_count").cast("bigint"),
                    (F.col("scam_neighbor_count") > 0).cast("int").alias("direct_scam_connection"))


def _ckpt(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the session's shared checkpoint directory."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scam_distance(edges: DataFrame, scam: DataFrame) -> DataFrame:
    """Hops from each node *towards* the nearest scam address along edge
    direction (scam itself 0; unreachable 999 and ``reachable`` 0). One multi-source
    BFS over the reversed edges: the frontier moves from each level's nodes to
    their predecessors until no new node is reached, however many levels that
    takes. Edges and nodes are checkpointed once; a level adds only its own nodes."""
    nodes = _ckpt(nodes_of(edges))
    rev = _ckpt(edges.select(F.col("dst").alias("node"), F.col("src").alias("prev")).distinct())
    seed = scam.select(F.col("address").alias("node")).distinct().join(
        nodes.select(F.col("address").alias("node")), "node", "left_semi")
    visited = _ckpt(seed.withColumn("dist", F.lit(0)))
    frontier = visited
    level = 0
    while True:
        level += 1
        nxt = (frontier.join(rev, "node").select(F.col("prev").alias("node")).distinct()
               .join(visited.select("node"), "node", "left_anti"))
        nxt = _ckpt(nxt.withColumn("dist", F.lit(level)))
        if nxt.isEmpty():
            break
        visited = visited.unionByName(nxt)
        if level % 50 == 0:  # a union of very many tables plans slowly
            visited = _ckpt(visited)
        frontier = nxt
    return (nodes.join(visited.withColumnRenamed("node", "address"), "address", "left")
            .select("address", F.coalesce(F.col("dist"), F.lit(UNREACHABLE)).alias("distance_to_scam"),
                    F.col("dist").isNotNull().cast("int").alias("reachable")))


def pagerank(edges: DataFrame, alpha: float = 0.85, max_iter: int = 100, tol: float = 1e-6,
             fixed_iter: int | None = None, weighted: bool = True) -> DataFrame:
    """Weighted PageRank with uniform restart; nodes whose out-weight is 0
    are dangling and their mass is spread uniformly. Stops when the L1 change
    is below ``n * tol`` (raises if ``max_iter`` is reached), or after exactly
    ``fixed_iter`` rounds. Edges are packed and dealt by sender once; each round joins them to
    the ranks in place and shuffles one share per edge, by receiver, with a one-row dangling
    sum; ranks are checkpointed."""
    w = F.col("weight") if weighted else F.lit(1.0)
    e = land(edges.select("src", "dst", w.cast("double").alias("wt")))
    spark, parts = e.sparkSession, parts_for(e.sparkSession, e.count())
    with dealt(spark, parts):
        mine = Window.partitionBy("src")
        en = e.repartition("src").withColumn("wsum", F.sum("wt").over(mine)).where(F.col("wsum") > 0)
        en = en.withColumn("_piece", F.pmod(F.xxhash64("dst"), F.ceil(F.count(F.lit(1)).over(mine) / ROW_ENDS)))
        en = _ckpt(en.groupBy("src", "_piece").agg(F.collect_list(F.struct("dst", (F.col("wt") / F.col("wsum")).alias("p"))).alias("_e"))
                   .select("src", F.col("_e.dst").alias("dst"), F.col("_e.p").alias("p")))
        sends = en.select(F.col("src").alias("node")).distinct().withColumn("sends", F.lit(True))
        nodes = _ckpt(nodes_of(e).withColumnRenamed("address", "node").join(sends, "node", "left"))
        n = nodes.count()
        if n == 0:
            return nodes.select("node", F.lit(0.0).alias("pagerank"))
        x = nodes.withColumns({"x": F.lit(1.0 / n), "was": F.lit(1.0 / n)})
        rounds = fixed_iter if fixed_iter is not None else max_iter
        for i in range(rounds):
            dsum = x.where("sends IS NULL AND node IS NOT NULL").agg(F.coalesce(F.sum("x"), F.lit(0.0)).alias("_d"))
            contrib = (en.join(x.select(F.col("node").alias("src"), "x"), "src")
                       .select("x", F.inline(F.arrays_zip("dst", "p")))
                       .groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("x") * F.col("p")).alias("_c")))
            x = _ckpt(x.withColumnRenamed("x", "_old").join(contrib, "node", "left").crossJoin(F.broadcast(dsum))
                      .select("node", "sends", (F.lit(alpha) * F.coalesce(F.col("_c"), F.lit(0.0))
                                                + F.lit(alpha) * F.col("_d") / F.lit(float(n))
                                                + F.lit((1.0 - alpha) / n)).alias("x"), F.col("_old").alias("was")))
            if fixed_iter is None and x.agg(F.sum(F.abs(F.col("x") - F.col("was")))).first()[0] < n * tol:
                return x.select("node", F.col("x").alias("pagerank"))
    if fixed_iter is None:
        raise RuntimeError(f"pagerank did not converge in {max_iter} iterations")
    return x.select("node", F.col("x").alias("pagerank"))


def label_propagation(edges: DataFrame, iterations: int | None = None) -> DataFrame:
    """G9 (re-aimed): synchronous label propagation on the undirected graph.
    Every node starts with its own id as label; each round it takes the most
    frequent label among its neighbours (ties: smallest label); isolated nodes
    keep theirs. Communities are then numbered 0, 1, ... by size descending
    (ties by smallest label) with their size. Without ``iterations`` it runs until
    no label changes, or until the labels are those of two rounds ago (synchronous
    rounds may alternate between two states). A round shuffles one label per pair of neighbours."""
    edges = land(edges.select("src", "dst"))
    und = Neighbours.of(both_ways(edges), 2 * edges.count())
    done, settled = 0, False
    with dealt(edges.sparkSession, und.parts):
        lab = nodes_of(edges).select(F.col("address").alias("node"), F.col("address").alias("label"))
        if iterations is None:  # the labels of the round before and of two rounds ago
            lab = lab.withColumns({"was": F.col("label"), "before": F.col("label")})
        lab = _ckpt(lab)
        while not settled and (iterations is None or done < iterations):
            done += 1
            cnt = und.sent(lab.select(F.col("node").alias("v"), "label")).groupBy(F.col("u").alias("node"), "label").agg(F.count(F.lit(1)).alias("c"))
            best = cnt.groupBy("node").agg(F.min(F.struct((-F.col("c")).alias("c"), "label")).alias("_b"))
            lab = _ckpt(lab.join(best, "node", "left").select(
                "node", F.coalesce("_b.label", "label").alias("label"),
                *([] if iterations is not None else [F.col("label").alias("was"), F.col("was").alias("before")])))
            if iterations is None:
                changed = lab.agg(F.count_if(F.expr("label != was")), F.count_if(F.expr("label != before"))).first()
                settled = changed[0] == 0 or done > 1 and changed[1] == 0
        lab = lab.select("node", "label")
    sizes = lab.groupBy("label").agg(F.count(F.lit(1)).alias("community_size"))
    # numbering by size is a distributed row number (there may be ~n communities)
    sizes = row_number_by(sizes.withColumn("_neg", -F.col("community_size")), ["_neg", "label"], out="_rn")
    sizes = sizes.withColumn("community_id", (F.col("_rn") - 1).cast("int")).drop("_rn", "_neg")
    return (lab.join(sizes, "label")
            .select(F.col("node").alias("address"), "community_id", F.col("community_size").cast("bigint")))


def modularity(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """Newman modularity of a partition on the undirected simple graph (used to
    check G9): sum over communities of L_c / m - (D_c / 2m)^2."""
    und = undirected(edges)
    m = und.count() / 2.0
    c = communities.select("address", "community_id")
    intra = (und.join(c.select(F.col("address").alias("u"), F.col("community_id").alias("cu")), "u")
             .join(c.select(F.col("address").alias("v"), F.col("community_id").alias("cv")), "v")
             .where(F.col("cu") == F.col("cv")).groupBy("cu").agg((F.count(F.lit(1)) / 2).alias("L")))
    degs = (und.groupBy(F.col("u").alias("address")).agg(F.count(F.lit(1)).alias("k"))
            .join(c, "address").groupBy(F.col("community_id").alias("cu")).agg(F.sum("k").alias("D")))
    return (degs.join(intra, "cu", "left").na.fill(0.0, ["L"])
            .agg(F.sum(F.col("L") / m - (F.col("D") / (2 * m)) ** 2).alias("modularity")))


def scam_seed_from_labels(tx: DataFrame, label: str = "is_fraud", test_flag: str | None = None) -> DataFrame:
    """Receivers of fraud-labelled transactions. ``test_flag`` (L3's ``is_test``): only training rows
    name them, so that labels of the test period do not reach its features."""
    rows = tx.where(F.col(label) == 1)
    if test_flag is not None:
        rows = rows.where(F.col(test_flag) == 0)
    return rows.select(F.col("to_addr").alias("address")).where(F.col("address").isNotNull()).distinct()


def relational_node_features(edges: DataFrame, scam: DataFrame) -> DataFrame:
    """The node features that need no iteration to a fixed point but the distance: degree
    centralities, clustering, neighbour degree, triangles, scam distance and scam neighbours."""
    return (degree_centrality(edges).join(clustering_features(edges), "address", "left")
            .join(scam_distance(edges, scam).drop("reachable"), "address", "left").join(scam_neighbors(edges, scam), "address", "left"))


def join_node_features(tx: DataFrame, nodes: DataFrame) -> DataFrame:
    """Node features joined to the transactions on the sender; missing -> 0 (also the distance)."""
    d = tx.join(nodes.withColumnRenamed("address", "from_addr"), "from_addr", "left")
    return d.na.fill(0, [c for c in nodes.columns if c != "address"])


def sampled_pivots(edges: DataFrame, n: int = 1000) -> DataFrame:
    """Pivots of the original's sampled betweenness: ``n`` nodes in hash order (all, if there are fewer)."""
    return nodes_of(edges).orderBy(F.xxhash64(F.col("address"), F.lit(42)), "address").limit(n)


def graph_features(tx: DataFrame, scam: DataFrame, edges: DataFrame | None = None,
                   pivots: DataFrame | None = None, batch_size: int | None = None) -> DataFrame:
    """Centralities with PageRank and betweenness (from ``pivots``, by default
    the sampled ones), clustering, community id and size, scam distance and scam
    neighbours per node, joined to the transactions on the sender; missing -> 0."""
    e = _ckpt(edges if edges is not None else build_edges(tx))  # read by seven operators
    pivots = _ckpt(pivots if pivots is not None else sampled_pivots(e))
    g = (relational_node_features(e, scam)
         .join(betweenness(e, pivots, batch_size=batch_size).withColumnRenamed("betweenness", "betweenness_centrality"), "address", "left")
         .join(pagerank(e).select(F.col("node").alias("address"), F.col("pagerank").alias("pagerank_score")), "address", "left")
         .join(label_propagation(e), "address", "left"))
    return join_node_features(tx, g)


def top_central(edges: DataFrame, n: int = 50) -> DataFrame:
    """The n nodes with the highest degree centrality (ties by address)."""
    return degree_centrality(edges).orderBy(F.col("degree_centrality").desc(), "address").limit(n)


def betweenness(edges: DataFrame, pivots: DataFrame, normalized: bool = True,
                batch_size: int | None = None, _raw: bool = False) -> DataFrame:
    """Directed, unweighted betweenness from a set of pivot sources
    (Brandes): a BFS per pivot counts shortest paths level by level
    (``sigma``), then dependencies flow back down the levels. A graph that a task can hold is sent to the workers, where
    pivots run one by one (``pivots.dependencies``). On larger ones all pivots run at once as rows keyed by (pivot, node), which meet
    blocks of the edges (``blocks.spread``); state is checkpointed per level.
    With every node as pivot the result is exact; with k pivots it is scaled
    by n / k as in the sampled estimator."""
    nodes = nodes_of(edges)
    n = nodes.count()
    k = pivots.count()
    if batch_size and k > batch_size:
        # (pivot, node) state is pivots x reachable nodes: run the pivots in
        # batches (by hash) and add the unscaled dependencies
        pv = pivots.select("address").distinct().withColumn(
            "_batch", F.pmod(F.xxhash64("address"), F.lit((k + batch_size - 1) // batch_size)))
        parts = [betweenness(edges, pv.where(F.col("_batch") == b).select("address"), _raw=True)
                 .withColumnRenamed("betweenness", "_b")
                 for b in range((k + batch_size - 1) // batch_size)]
        tot = parts[0]
        for p_ in parts[1:]:
            tot = tot.unionByName(p_)
        raw = tot.groupBy("address").agg(F.sum("_b").alias("_b"))
        scale = float(n) / k
        if normalized and n > 2:
            scale = scale / ((n - 1) * (n - 2))
        return raw.select("address", (F.col("_b") * scale).alias("betweenness"))
    e = land(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).where(F.col("a") != F.col("b")).distinct())
    m = e.count()
    held = dependencies(e, m, pivots)
    if held is not None:
        return _scaled(held, nodes, n, k, normalized, _raw)
    out, back = _ckpt(packed(e, m)), _ckpt(packed(e.select(F.col("b").alias("a"), F.col("a").alias("b")), m))
    front = _ckpt(pivots.select(F.col("address").alias("pivot")).where(F.col("pivot").isNotNull()).distinct()
                  .select("pivot", F.array("pivot").alias("nodes"), F.array(F.lit(1.0)).alias("x"), block_of("pivot", blocks_for(m)).alias("j")))
    seen, levels, sizes = front, [front], [front.count()]
    while True:
        nxt = _ckpt(spread(out, m, front, sizes[-1], seen, sum(sizes), fresh=True))
        size = nxt.agg(F.sum(F.size("nodes"))).first()[0] or 0
        if not size:
            break
        levels.append(nxt)
        sizes.append(size)
        seen = seen.unionByName(nxt.drop("y"))
        if len(levels) % 50 == 0:  # a union of very many tables plans slowly
            seen = _ckpt(seen)
        front = nxt
    return _betweenness_sum(levels, sizes, back, m, nodes, n, k, normalized, _raw)


def _betweenness_sum(levels, sizes, back, m, nodes, n, k, normalized, raw=False):
    """Dependencies flow back level by level: for v one level above w on a
    shortest path, delta(v) += sigma_v / sigma_w * (1 + delta(w)). Levels hold x = sigma, ``back`` the turned edges."""
    if len(levels) < 2:
        return nodes.withColumn("betweenness", F.lit(0.0))
    tot, push = None, levels[-1]
    for L in range(len(levels) - 2, -1, -1):
        push = _ckpt(spread(back, m, push.select("pivot", "nodes", F.col("y").alias("x")), sizes[L + 1], levels[L], sizes[L], fresh=False))
        part = push.select("pivot", F.inline(F.arrays_zip(F.col("nodes").alias("node"), F.col("x").alias("x")))).where(F.col("pivot") != F.col("node"))
        tot = part if tot is None else tot.unionByName(part)
    return _scaled(tot.groupBy(F.col("node").alias("address")).agg(F.sum("x").alias("_b")), nodes, n, k, normalized, raw)


def _scaled(s, nodes, n, k, normalized, raw):
    """Betweenness of every node from the sums ``_b`` over k pivots."""
    scale = (float(n) / k) if k else 0.0
    if normalized and n > 2:
        scale = scale / ((n - 1) * (n - 2))
    if raw:
        scale = 1.0
    return (nodes.join(s, "address", "left")
            .select("address", (F.coalesce(F.col("_b"), F.lit(0.0)) * scale).alias("betweenness")))
