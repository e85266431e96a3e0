"""Graph measures per session, as joins and aggregates.

``nodes``: session_id, id, label, type, copies, properties (map).
``edges``: session_id, src, dst, relationship, weight with src < dst.

Every loop keeps its state in a table, cuts lineage in the shared folder and
stops on an unchanged fingerprint of that table; only the fingerprint reaches
the driver. Node groups are combined by partial aggregates, never listed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire import fixed_values as V
from quire.operators.packed_links import Packed, best_moves, between, inner_forest, local_forests
from quire.operators.search import top_k
from quire.session import cut_lineage, discard

PLACES = 9
POWER_STEPS = 8
_SCOPE = ["session_id", "resolution"]


def _fingerprint(state: DataFrame, *columns) -> tuple:
    return tuple(state.agg(F.count("*"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)"))).first())


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge from either end."""
    forward = edges.select("session_id", F.col("src").alias("node"), F.col("dst").alias("peer"), "weight")
    return forward.unionByName(
        edges.select("session_id", F.col("dst").alias("node"), F.col("src").alias("peer"), "weight")
    )


def session_sizes(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("session_id").agg(F.count("*").alias("n"))


def degrees(edges: DataFrame) -> DataFrame:
    ends = edges.select("session_id", F.explode(F.array("src", "dst")).alias("node"))  # reads the edges once
    return ends.groupBy("session_id", "node").agg(F.count("*").alias("degree"))


def degree_centrality(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return (
        nodes.select("session_id", F.col("id").alias("node"))
        .join(session_sizes(nodes), "session_id")
        .join(degrees(edges), ["session_id", "node"], "left")
        .select(
            "session_id", "node",
            F.when(F.col("n") <= 1, F.lit(1.0))
            .otherwise(F.coalesce("degree", F.lit(0)) / F.greatest(F.col("n") - 1, F.lit(1))).alias("degree"),
        )
    )


def shortest_paths(edges: DataFrame, distance: str = "weight", sources: DataFrame | None = None) -> DataFrame:
    """Distance and number of shortest paths from each source to what it reaches.

    Every round extends all paths by one edge, keeping the shortest per
    (source, node); distances are rounded so that equal sums tie. ``sources``
    (session_id, node) limits the start points; by default all nodes with an
    edge start.
    """
    step = both_ways(edges).withColumn(
        "step", F.col("weight") if distance == "weight" else 1.0 / F.col("weight")
    ).select("session_id", "node", "peer", "step")
    step = cut_lineage(step)
    starts = (sources if sources is not None else step).select("session_id", "node").distinct()
    start = starts.select(
        "session_id", F.col("node").alias("source"), "node",
        F.lit(0.0).alias("dist"), F.lit(1.0).alias("paths"),
    )
    state, seen = cut_lineage(start), None
    while True:
        extended = (
            state.join(step, ["session_id", "node"])
            .where(F.col("peer") != F.col("source"))
            .select(
                "session_id", "source", F.col("peer").alias("node"),
                F.round(F.col("dist") + F.col("step"), PLACES).alias("dist"), "paths",
            )
        )
        before, state = state, cut_lineage(
            extended.groupBy("session_id", "source", "node", "dist").agg(F.sum("paths").alias("paths"))
            .groupBy("session_id", "source", "node")
            .agg(F.min("dist").alias("dist"), F.min_by("paths", "dist").alias("paths"))
            .unionByName(start)
        )
        discard(before)
        mark = _fingerprint(state, "session_id", "source", "node", "dist", "paths")
        if mark == seen:
            return state
        seen = mark


def closeness_centrality(nodes: DataFrame, paths: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """Inverse mean distance, scaled by the share of the session reached.

    Give the ``sources`` that the paths were limited to: other nodes get null.
    """
    value = F.when(
        (F.col("total") > 0) & (F.col("n") > 1),
        (F.col("reach") / F.col("total")) * (F.col("reach") / (F.col("n") - 1)),
    ).otherwise(0.0)
    asked = nodes.select("session_id", F.col("id").alias("node"))
    if sources is not None:
        known = sources.select("session_id", "node", F.lit(True).alias("asked")).distinct()
        asked, value = asked.join(known, ["session_id", "node"], "left"), F.when(F.col("asked"), value)
    reached = paths.groupBy("session_id", F.col("source").alias("node")).agg(
        (F.count("*") - 1).alias("reach"), F.sum("dist").alias("total")
    )
    return (
        asked.join(session_sizes(nodes), "session_id").join(reached, ["session_id", "node"], "left")
        .select("session_id", "node", value.alias("closeness"))
    )


def betweenness_centrality(
    nodes: DataFrame, edges: DataFrame, paths: DataFrame, distance: str = "weight", sources: DataFrame | None = None
) -> DataFrame:
    """Share of shortest paths through each node, scaled to the session.

    Give the ``sources`` that the paths were limited to: the sums are scaled up
    to all nodes of the session, an estimate then.

    Dependencies flow back from far nodes to near ones along the edges that
    lie on shortest paths from one source; no triple of nodes is ever formed.
    """
    step = both_ways(edges).withColumn("step", F.col("weight") if distance == "weight" else 1.0 / F.col("weight"))
    near = paths.select("session_id", "source", "node", "dist", "paths")
    far = paths.select("session_id", "source", F.col("node").alias("peer"), F.col("dist").alias("far_dist"), F.col("paths").alias("far_paths"))
    tight = cut_lineage(
        near.join(step, ["session_id", "node"])
        .withColumn("far_dist", F.round(F.col("dist") + F.col("step"), PLACES))
        .join(far, ["session_id", "source", "peer", "far_dist"])
        .select("session_id", "source", "node", "peer", (F.col("paths") / F.col("far_paths")).alias("share"))
    )
    state = tight.select("session_id", "source", F.col("node").alias("peer"), F.lit(0.0).alias("flow")).limit(0)
    seen = None
    while True:
        before, state = state, cut_lineage(
            tight.join(state, ["session_id", "source", "peer"], "left")
            .groupBy("session_id", "source", F.col("node").alias("peer"))
            .agg(F.sum(F.col("share") * (1 + F.coalesce("flow", F.lit(0.0)))).alias("flow"))
        )
        discard(before)
        mark = _fingerprint(state, "session_id", "source", "peer", F.round("flow", 6))
        if mark == seen:
            break
        seen = mark
    through = (
        state.where("source <> peer").groupBy("session_id", F.col("peer").alias("node"))
        .agg(F.sum("flow").alias("flow"))
    )
    sizes, scale = session_sizes(nodes), F.lit(1.0)
    if sources is not None:
        picked = sources.select("session_id", "node").distinct().groupBy("session_id").agg(F.count("*").alias("k"))
        sizes, scale = sizes.join(picked, "session_id", "left"), F.col("n") / F.col("k")
    return (
        nodes.select("session_id", F.col("id").alias("node"))
        .join(sizes, "session_id")
        .join(through, ["session_id", "node"], "left")
        .select(
            "session_id", "node",
            F.when(F.col("n") > 2, scale * F.coalesce("flow", F.lit(0.0)) / ((F.col("n") - 1) * (F.col("n") - 2)))
            .otherwise(0.0).alias("betweenness"),
        )
    )


def eigenvector_centrality(nodes: DataFrame, edges: DataFrame, max_rounds: int = 1000, tolerance: float = 1e-6) -> DataFrame:
    """Weighted power iteration on the graph plus identity, unit length per session.

    Several steps run as one job. A session that has not settled in time gets
    NULL for this measure alone.
    """
    base = nodes.select("session_id", F.col("id").alias("node"))
    links = both_ways(edges).select("session_id", "node", "peer", "weight")
    itself = base.select("session_id", "node", F.col("node").alias("peer"), F.lit(1.0).alias("weight"))
    step = cut_lineage(links.unionByName(itself))
    sizes = base.groupBy("session_id").agg(F.count("*").alias("n"))
    state = stored = cut_lineage(base.join(sizes, "session_id").select("session_id", "node", "n", (1.0 / F.col("n")).alias("x")))

    def advance(rows: DataFrame) -> DataFrame:
        return (
            rows.join(step, ["session_id", "node"])
            .groupBy("session_id", F.col("peer").alias("node"))
            .agg(F.max("n").alias("n"), F.sum(F.col("x") * F.col("weight")).alias("x"))
        )

    def unit(rows: DataFrame, name: str) -> DataFrame:
        lengths = rows.groupBy("session_id").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("_len"))
        return rows.join(lengths, "session_id").select("session_id", "node", "n", (F.col("x") / F.col("_len")).alias(name))

    rounds = 0
    while True:
        rows = state
        for _ in range(POWER_STEPS - 1):
            rows = advance(rows)
        before = cut_lineage(rows)
        after = cut_lineage(advance(before))
        state = cut_lineage(unit(before, "was").join(unit(after, "x").drop("n"), ["session_id", "node"]))
        discard(stored, before, after)
        stored = state
        rounds += POWER_STEPS
        open_sessions = (
            state.groupBy("session_id").agg(F.sum(F.abs(F.col("x") - F.col("was"))).alias("change"), F.max("n").alias("n"))
            .where(F.col("change") >= F.col("n") * tolerance)
        )
        if rounds >= max_rounds or open_sessions.isEmpty():
            break
        state = state.select("session_id", "node", "n", "x")
    return state.join(open_sessions.select("session_id", F.lit(True).alias("_open")), "session_id", "left").select(
        "session_id", "node", F.when(F.col("_open").isNull(), F.col("x")).alias("eigenvector")
    )


def composite_centrality(degree: DataFrame, betweenness: DataFrame, closeness: DataFrame, eigenvector: DataFrame) -> DataFrame:
    keys = ["session_id", "node"]
    joined = degree.join(betweenness, keys).join(closeness, keys).join(eigenvector, keys)
    total = sum(
        (F.coalesce(name, F.lit(0.0)) * weight for name, weight in V.CENTRALITY_WEIGHTS.items()), F.lit(0.0)
    )
    return joined.withColumn("composite", total)


def centrality(nodes: DataFrame, edges: DataFrame, distance: str = "weight") -> DataFrame:
    """All measures of every node."""
    from quire.operators.path_blocks import betweenness_and_closeness

    edges = cut_lineage(edges.select("session_id", "src", "dst", "weight"))
    nodes = nodes.select("session_id", "id")
    by_paths = cut_lineage(betweenness_and_closeness(nodes, edges, distance))
    return composite_centrality(
        degree_centrality(nodes, edges), by_paths.drop("closeness"), by_paths.drop("betweenness"), eigenvector_centrality(nodes, edges),
    )


# --- components and communities -------------------------------------------------------

def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Lowest node id of each node's component.

    Alternates two star steps: hang larger neighbours on the smallest
    neighbour, then hang smaller ones there too. Long chains shrink by a
    constant factor a round, so the number of rounds stays logarithmic. Before
    that every task leaves a forest of the edges it reads, so no edge is shuffled
    that others of its task make up for.
    """
    keys = ["session_id", "u"]
    pairs = cut_lineage(local_forests(edges).select("session_id", F.col("src").alias("u"), F.col("dst").alias("v")).distinct())
    seen = None
    while True:
        ways = pairs.unionByName(pairs.select("session_id", F.col("v").alias("u"), F.col("u").alias("v")))
        low = ways.groupBy(*keys).agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = ways.where("v > u").join(low, keys).select("session_id", F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select("session_id", F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy(*keys).agg(F.min("v").alias("m"))
        joined = down.join(least, keys)
        small = joined.where("v <> m").select("session_id", F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            joined.select("session_id", "u", F.col("m").alias("v"))
        )
        before, pairs = pairs, cut_lineage(small.distinct())
        discard(before)
        mark = _fingerprint(pairs, "session_id", "u", "v")
        if mark == seen:
            break
        seen = mark
    roots = pairs.groupBy(*keys).agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    return nodes.select("session_id", F.col("id").alias("node")).join(roots, ["session_id", "node"], "left").withColumn(
        "component", F.coalesce("component", "node")
    )


def modularity(edges: DataFrame, partition: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Weighted modularity of (node, community) rows per session.

    ``by`` names further columns of the partition that tell several
    partitions of one session apart.
    """
    extra = by or []
    part = partition.select("session_id", *extra, "node", "community")
    total = edges.groupBy("session_id").agg(F.sum("weight").alias("m"))
    strength = both_ways(edges).groupBy("session_id", "node").agg(F.sum("weight").alias("k"))
    mass = (
        strength.join(part, ["session_id", "node"]).groupBy("session_id", *extra, "community").agg(F.sum("k").alias("mass"))
    )
    ends = edges.select("session_id", F.col("src").alias("node"), "dst", "weight").join(part, ["session_id", "node"])
    other = part.withColumnRenamed("node", "dst").withColumnRenamed("community", "other")
    inside = (
        ends.join(other, ["session_id", *extra, "dst"]).where("community = other")
        .groupBy("session_id", *extra, "community").agg(F.sum("weight").alias("inside"))
    )
    return (
        mass.join(inside, ["session_id", *extra, "community"], "left").join(total, "session_id")
        .groupBy("session_id", *extra)
        .agg(
            F.sum(
                F.coalesce("inside", F.lit(0.0)) / F.col("m")
                - F.pow(F.col("mass") / (2 * F.col("m")), F.lit(2))
            ).alias("modularity")
        )
    )


def _local_moves(links: DataFrame) -> DataFrame:
    """``_moves`` of links: session_id, resolution, node, peer, weight in both directions, self links once with their doubled weight."""
    packed = Packed(links, _SCOPE)
    return _named(packed, _moves(packed, packed.nodes))


def _moves(packed: Packed, nodes: DataFrame) -> DataFrame:
    """Move nodes to the neighbouring community that gains most: _SCOPE, node, place, k, community (a place).

    ``nodes``: those of every resolution. Rounds go on until no node gains
    by moving. A part of the nodes may move in a round, another one each time and
    a smaller one as rounds go by, so neighbours don't swap for ever: a move by
    itself raises the modularity.
    """
    columns = [*_SCOPE, "place", "node", "k"]
    state = stored = cut_lineage(nodes.select(*columns, F.col("place").alias("community")))
    number = 0
    while True:
        known = state.select(*_SCOPE, "place", "community", "k", F.col("resolution").alias("scale"))
        if number:  # a resolution that no node gains in has settled
            known = known.join(stored.where("gains").select(*_SCOPE).distinct(), _SCOPE, "left_semi")
        best = packed.each(known, _SCOPE, best_moves, "place int, best int, gains boolean")
        before, stored = stored, cut_lineage(state.join(best, [*_SCOPE, "place"], "left").fillna(False, ["gains"]))
        discard(before)
        if stored.where("gains").isEmpty():
            return stored.select(*columns, "community")
        may_move = F.pmod(F.xxhash64("node", F.lit(number)), F.lit(2 + number // 8)) == 0
        state = stored.select(*columns, F.when(may_move & F.col("gains"), F.col("best")).otherwise(F.col("community")).alias("community"))
        number += 1


def _named(packed: Packed, level: DataFrame) -> DataFrame:
    """(_SCOPE, node, community) with the community's node for its place."""
    names = packed.nodes.select(*packed.keys, F.col("place").alias("community"), F.col("node").alias("_name"))
    return level.join(names, [*packed.keys, "community"]).select(*_SCOPE, "node", F.col("_name").alias("community"))


def _split(packed: Packed, level: DataFrame) -> DataFrame:
    """``level`` (as of ``_moves``) with every community split into its connected parts, each named by its smallest place.

    A node that held two halves together may have moved on. No link runs between such
    parts, so splitting them raises the modularity. A packed row passes on a forest, not links.
    """
    inner = packed.each(level.select(*_SCOPE, "place", "community"), _SCOPE, inner_forest, "src int, dst int")
    scope = F.struct(*_SCOPE).alias("session_id")
    parts = connected_components(level.select(scope, F.col("place").alias("id")), inner.select(scope, "src", "dst"))
    parts = parts.select("session_id.session_id", "session_id.resolution", F.col("node").alias("place"), F.col("component").alias("community"))
    return cut_lineage(level.drop("community").join(parts, [*_SCOPE, "place"]))


def _connected_parts(links: DataFrame, level: DataFrame) -> DataFrame:
    """``_split`` of links and communities (_SCOPE, node, community) given as tables."""
    packed = Packed(links, _SCOPE)
    place = packed.nodes.select(*_SCOPE, F.col("node").alias("community"), F.col("place").alias("_at"))
    placed = packed.nodes.join(level, [*_SCOPE, "node"]).join(place, [*_SCOPE, "community"]).drop("community").withColumnRenamed("_at", "community")
    return _named(packed, _split(packed, placed))


def communities(
    nodes: DataFrame, edges: DataFrame, resolutions: list[float] = V.RESOLUTIONS
) -> DataFrame:
    """The partition of highest modularity over the resolutions.

    All resolutions run side by side, at first over the same packed links. After each level the communities become
    the nodes of a smaller graph, until a level moves nothing. Nodes without
    edges keep to themselves.
    """
    packed = Packed(both_ways(edges), ["session_id"])
    scales = F.explode(F.array(*[F.lit(float(r)) for r in resolutions])).alias("resolution")
    level_nodes = packed.nodes.select("*", scales)
    partition = level_nodes.select(*_SCOPE, "node", F.col("node").alias("community"))
    while True:
        level = _split(packed, _moves(packed, level_nodes))
        moved = not level.where("place <> community").isEmpty()
        weights = packed.each(level.select(*_SCOPE, "place", "community"), _SCOPE, between, "a int, b int, weight double")
        weights = weights.groupBy(*_SCOPE, "a", "b").agg(F.sum("weight").alias("weight"))
        one, two = (packed.nodes.select(*packed.keys, F.col("place").alias(c), F.col("node").alias(name)) for c, name in (("a", "node"), ("b", "peer")))
        links = cut_lineage(weights.join(one, [*packed.keys, "a"]).join(two, [*packed.keys, "b"]).select(*_SCOPE, "node", "peer", "weight"))
        if not moved:
            break
        lifted = _named(packed, level).select(*_SCOPE, F.col("node").alias("community"), F.col("community").alias("upper"))
        partition = cut_lineage(
            partition.join(lifted, [*_SCOPE, "community"]).select(*_SCOPE, "node", F.col("upper").alias("community"))
        )
        packed = Packed(links, _SCOPE)
        level_nodes = packed.nodes
    # modularity from the last level: a self link holds the doubled weight inside
    mass = links.groupBy(*_SCOPE, "node").agg(F.sum("weight").alias("k"), F.sum(F.when(F.col("node") == F.col("peer"), F.col("weight")).otherwise(0.0)).alias("inside"))
    total = mass.groupBy(*_SCOPE).agg(F.sum("k").alias("m2"))
    quality = cut_lineage(
        mass.join(total, _SCOPE).groupBy(*_SCOPE).agg(F.sum(F.col("inside") / F.col("m2") - F.pow(F.col("k") / F.col("m2"), F.lit(2))).alias("modularity"))
    )
    best = quality.groupBy("session_id").agg(
        F.max_by("resolution", F.struct(F.round("modularity", PLACES), -F.col("resolution"))).alias("resolution"),
        F.max("modularity").alias("modularity"),
    )
    chosen = partition.join(best, _SCOPE).select("session_id", "node", "community", "modularity")
    return (
        nodes.select("session_id", F.col("id").alias("node"))
        .join(chosen.select("session_id", "node", "community"), ["session_id", "node"], "left")
        .join(best.select("session_id", "modularity"), "session_id", "left")
        .withColumn("community", F.coalesce("community", "node"))
    )


# --- reports -------------------------------------------------------------------------------

def _is_empty() -> Column:
    return F.coalesce(F.col("properties")["length"] == "0", F.lit(False))


def graph_stats(nodes: DataFrame, edges: DataFrame, partition: DataFrame | None = None) -> DataFrame:
    """Counts and density per session, for distinct texts and for documents.

    Document figures follow from the copy counts: copies of one text are all
    linked to each other and to everything that text is linked to. Copies of
    the empty text aren't linked.
    """
    c = F.col("copies")
    inner = F.when(_is_empty(), 0).otherwise(F.expr("copies * (copies - 1) div 2"))
    per_node = nodes.groupBy("session_id").agg(
        F.count("*").alias("total_nodes"), F.sum(c).alias("document_nodes"),
        F.sum(inner).alias("_inner"),
    )
    per_edge = edges.groupBy("session_id").agg(
        F.count("*").alias("total_edges"), F.sum(F.col("src_copies") * F.col("dst_copies")).alias("_cross"),
    )
    zero = F.lit(0)
    out = per_node.join(per_edge, "session_id", "left").select(
        "session_id", "total_nodes", "document_nodes",
        F.coalesce("total_edges", zero).alias("total_edges"),
        (F.coalesce("_cross", zero) + F.col("_inner")).alias("document_edges"),
    )

    def density(e: str, n: str) -> Column:
        return F.col(e) / F.greatest(F.col(n) * (F.col(n) - 1) / 2, F.lit(1.0))

    out = out.withColumn("density", density("total_edges", "total_nodes")).withColumn(
        "document_density", density("document_edges", "document_nodes")
    )
    if partition is not None:
        found = partition.groupBy("session_id").agg(F.count_distinct("community").alias("communities_count"))
        out = out.join(found, "session_id", "left").fillna(0, ["communities_count"])
    return out


def type_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes per type and edges per relationship."""
    by_type = nodes.groupBy("session_id", F.lit("node").alias("kind"), F.col("type").alias("name")).count()
    return by_type.unionByName(
        edges.groupBy("session_id", F.lit("edge").alias("kind"), F.col("relationship").alias("name")).count()
    )


def most_connected(edges: DataFrame, k: int = 5) -> DataFrame:
    return top_k(degrees(edges), "session_id", [F.col("degree").desc(), F.col("node").asc()], k)


def most_important(measures: DataFrame, k: int = 3) -> DataFrame:
    return top_k(measures, "session_id", [F.round("composite", PLACES).desc(), F.col("node").asc()], k)


def neighbors(edges: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """Adjacent nodes with relationship and direction, for (session_id, node) rows."""
    def arm(own: str, other: str, direction: str) -> Column:
        return F.struct(F.col(own).alias("node"), F.col(other).alias("peer"), "relationship", F.lit(direction).alias("direction"))

    both = F.explode(F.array(arm("src", "dst", "outgoing"), arm("dst", "src", "incoming"))).alias("arm")
    arms = edges.select("session_id", both).select("session_id", "arm.*")
    return arms if wanted is None else arms.join(wanted, ["session_id", "node"], "left_semi")


def document_neighbors(nodes: DataFrame, edges: DataFrame, members: DataFrame, wanted: DataFrame) -> DataFrame:
    """Adjacent documents of (session_id, doc_id) rows, whichever copy is asked for.

    ``members`` (session_id, doc_id, node_id) comes from ``copy_members``. A
    neighbour is every copy of an adjacent text, and every other copy of the
    document's own text unless that is empty.
    """
    asked = members.join(wanted.select("session_id", "doc_id").distinct(), ["session_id", "doc_id"], "left_semi").withColumnRenamed("node_id", "node")
    peers = members.select("session_id", F.col("doc_id").alias("peer_doc"), F.col("node_id").alias("peer"))
    adjacent = asked.join(neighbors(edges), ["session_id", "node"]).join(peers, ["session_id", "peer"])
    empty = nodes.where(_is_empty()).select("session_id", F.col("id").alias("node"))
    copies = (
        asked.join(empty, ["session_id", "node"], "left_anti").join(peers.withColumnRenamed("peer", "node"), ["session_id", "node"]).where("doc_id <> peer_doc")
        .select("session_id", "doc_id", F.col("peer_doc").alias("peer"), F.lit("same_text").alias("relationship"), F.lit("copy").alias("direction"))
    )
    return adjacent.select("session_id", "doc_id", F.col("peer_doc").alias("peer"), "relationship", "direction").unionByName(copies)


def document_edge_lookup(edges: DataFrame, members: DataFrame, wanted: DataFrame) -> DataFrame:
    """The edge between the texts of two documents (session_id, a, b), whichever copies are asked for."""
    def end(column: str, node: str) -> DataFrame:
        return members.select("session_id", F.col("doc_id").alias(column), F.col("node_id").alias(node))

    return (
        wanted.select("session_id", "a", "b").distinct().join(end("a", "_a"), ["session_id", "a"]).join(end("b", "_b"), ["session_id", "b"])
        .withColumns({"src": F.least("_a", "_b"), "dst": F.greatest("_a", "_b")})
        .join(edges, ["session_id", "src", "dst"]).select("session_id", "a", "b", "relationship", "weight")
    )


def search_nodes(nodes: DataFrame, query: str, types: list[str] | None = None) -> DataFrame:
    """Nodes whose label or any property holds the text, whatever the case."""
    needle = query.lower()
    hit = F.lower("label").contains(needle) | F.exists(
        F.map_values("properties"), lambda v: F.lower(v).contains(needle)
    )
    return nodes.where(F.col("type").isin(types) & hit if types else hit)


def edge_lookup(edges: DataFrame, wanted: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edge between two ids in either order, with both node labels."""
    pairs = wanted.select("session_id", F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct()
    found = edges.join(pairs, ["session_id", "src", "dst"])
    names = nodes.select("session_id", "id", "label")
    return (
        found.select("session_id", "src", "dst", "relationship", "weight", "summary")
        .join(names.withColumnsRenamed({"id": "src", "label": "src_name"}), ["session_id", "src"])
        .join(names.withColumnsRenamed({"id": "dst", "label": "dst_name"}), ["session_id", "dst"])
    )


def document_nodes(texts: DataFrame) -> DataFrame:
    """Graph nodes for distinct texts (session_id, id, label, text, copies)."""
    props = F.create_map(
        F.lit("length"), F.length("text").cast("string"),
        F.lit("word_count"), F.size(F.array_remove(F.split("text", r"\s+"), "")).cast("string"),
        F.lit("filename"), F.col("label"),
        F.lit("document_type"), F.lit("research_paper"),
    )
    return texts.select("session_id", "id", "label", F.lit("document").alias("type"), "copies", props.alias("properties"))
