"""Graph operators as loops of joins and groupings; each round's table is written to the shared folder.

Only counts come to the driver. Rows with a null end are no edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.sources.scratch import settle


def linked_nodes(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of links (a, b: long). Nodes without links aren't
    listed. Null ends, links of a node with itself and repeated links change nothing.

    Each round points every node at its smallest neighbour and carries the links over to those; what is left of them
    at least halves in nodes, so the rounds are few. Minima are pre-aggregated and the joins have one row per node on
    one side, so a hub with any number of links needs no task of its own.
    """
    edges = settle(links.filter("a is not null and b is not null and a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = None
    while not edges.isEmpty():
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = settle(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("to")).withColumnRenamed("a", "node"), "up")
        # Two steps at once: the parent of the parent, which is a node of this round as well.
        up = up.alias("u").join(up.alias("v"), F.col("u.to") == F.col("v.node")).select(F.col("u.node").alias("node"), F.col("v.to").alias("to"))
        up = settle(up, "up")
        if labels is None:
            labels = up.select("node", F.col("to").alias("component"))
        else:
            labels = labels.alias("l").join(up.alias("u"), F.col("l.component") == F.col("u.node"), "left").select("l.node", F.coalesce("u.to", "l.component").alias("component"))
            labels = settle(labels, "labels")
        left = edges.join(up.select(F.col("node").alias("a"), F.col("to").alias("ta")), "a").join(up.select(F.col("node").alias("b"), F.col("to").alias("tb")), "b")
        edges = settle(left.filter("ta != tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), "edges")
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component) for each distinct node id: the smallest id that is reachable when edges (u, v) go both ways."""
    found = linked_nodes(edges.select(F.col("u").alias("a"), F.col("v").alias("b")))
    ids = nodes.select("id").filter("id IS NOT NULL").distinct()
    return ids.join(found.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def path_costs(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, id, cost): the least sum of lengths from each source to each node it reaches along directed edges.

    Of parallel edges the shortest counts; lengths that are null or negative make no edge. Each round relaxes only the
    nodes whose cost fell in the round before.
    """
    arcs = edges.filter("u IS NOT NULL AND v IS NOT NULL AND length_m >= 0").groupBy("u", "v").agg(F.min("length_m").alias("w"))
    arcs = settle(arcs, "arcs")
    known = settle(sources.select(F.col("id").alias("source"), "id", F.lit(0.0).alias("cost")).distinct(), "costs")
    moved = known
    while moved.limit(1).count():
        reach = moved.join(arcs, F.col("id") == F.col("u")).groupBy("source", F.col("v").alias("id")).agg(F.min(F.col("cost") + F.col("w")).alias("new"))
        merged = known.join(reach, ["source", "id"], "full")
        fell = F.coalesce(F.col("new") < F.col("cost"), F.col("new").isNotNull())
        step = settle(merged.select("source", "id", F.least("cost", "new").alias("cost"), fell.alias("fell")), "costs")
        known, moved = step.drop("fell"), step.filter("fell").drop("fell")
    return known


def longest_downstream(edges: DataFrame) -> DataFrame:
    """(id, length_m): the longest directed path that begins at each node of an acyclic graph; 0 where none leaves.

    Nodes on a cycle, and nodes that lead into one, have no longest path: they get NaN. Rounds go on until no node is
    ready, one a hop of the longest path.
    """
    arcs = settle(edges.filter("u IS NOT NULL AND v IS NOT NULL").groupBy("u", "v").agg(F.max("length_m").alias("w")), "arcs")
    ids = arcs.select(F.col("u").alias("id")).unionByName(arcs.select(F.col("v").alias("id"))).distinct()
    degree = arcs.groupBy(F.col("u").alias("id")).agg(F.count(F.lit(1)).alias("open"))
    state = settle(ids.join(degree, "id", "left").select("id", F.coalesce("open", F.lit(0)).alias("open"), F.lit(0.0).alias("length_m"), F.lit(False).alias("done")), "longest")
    while True:
        ready = state.filter("open = 0 AND NOT done")
        if not ready.limit(1).count():
            break
        up = ready.join(arcs, F.col("id") == F.col("v")).groupBy(F.col("u").alias("id")).agg(F.count(F.lit(1)).alias("closed"), F.max(F.col("length_m") + F.col("w")).alias("best"))
        state = settle(
            state.join(up, "id", "left").select(
                "id", (F.col("open") - F.coalesce("closed", F.lit(0))).alias("open"), F.greatest("length_m", "best").alias("length_m"), (F.col("done") | (F.col("open") == 0)).alias("done")
            ), "longest",
        )
    return state.select("id", F.when(F.col("done"), F.col("length_m")).otherwise(F.lit(float("nan"))).alias("length_m"))


def fill_gaps(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, value): unknown values become the mean of the values that neighbours had in the round before, one hop of
    the known region a round; nodes that no known one reaches get 0."""
    links = edges.filter("u != v").select("u", "v")
    links = settle(links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "links")
    state = settle(nodes.select("id", F.col("value").cast("double").alias("value")), "filled")
    while True:
        near = links.join(state.filter("value IS NOT NULL"), F.col("id") == F.col("v")).groupBy(F.col("u").alias("id")).agg(F.avg("value").alias("near"))
        step = settle(state.join(near, "id", "left").select("id", F.coalesce("value", "near").alias("value"), (F.col("value").isNull() & F.col("near").isNotNull()).alias("new")), "filled")
        state = step.drop("new")
        if not step.filter("new").limit(1).count():
            return state.select("id", F.coalesce("value", F.lit(0.0)).alias("value"))


def reached(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, id): all nodes that each start (start, id) reaches along edges (u, v), itself included; the frontier of
    each round is joined, one round a hop."""
    arcs = settle(edges.filter("u IS NOT NULL AND v IS NOT NULL").select("u", "v").distinct(), "arcs")
    known = settle(starts.select("start", "id").distinct(), "reached")
    fresh = known
    while True:
        step = fresh.join(arcs, F.col("id") == F.col("u")).select("start", F.col("v").alias("id")).distinct().join(known, ["start", "id"], "left_anti")
        fresh = settle(step, "frontier")
        if fresh.isEmpty():
            return known
        known = settle(known.unionByName(fresh), "reached")


def strong_components(edges: DataFrame) -> DataFrame:
    """(id, component) for each node of directed edges (u, v): the smallest id with which it lies on a common cycle.

    Rounds of colouring: each open node takes the least id that reaches it (its colour, by rounds of minima); nodes that
    reach the colour's own node within the colour are its component and leave. Nodes with no edge in or none out can lie on
    no cycle and leave at once, so acyclic parts cost little.
    """
    arcs = settle(edges.filter("u IS NOT NULL AND v IS NOT NULL AND u != v").select("u", "v").distinct(), "arcs")
    ends = edges.select(F.col("u").alias("id")).unionByName(edges.select(F.col("v").alias("id"))).filter("id IS NOT NULL").distinct()
    done = None
    while True:
        while True:  # trim
            inner = arcs.join(arcs.select(F.col("v").alias("u")).distinct(), "u", "left_semi").join(arcs.select(F.col("u").alias("v")).distinct(), "v", "left_semi").select("u", "v")
            inner = settle(inner, "arcs")
            if inner.count() == arcs.count():
                break
            arcs = inner
        if arcs.isEmpty():
            break
        colour = settle(arcs.select(F.col("u").alias("id")).distinct().withColumn("c", F.col("id")), "colours")
        while True:
            least = arcs.join(colour, F.col("u") == F.col("id")).groupBy("v").agg(F.min("c").alias("m"))
            step = settle(colour.join(least, F.col("id") == F.col("v"), "left").select("id", F.least("c", "m").alias("c"), (F.col("m") < F.col("c")).alias("fell")), "colours")
            colour = step.drop("fell")
            if not step.filter("fell").limit(1).count():
                break
        marked = arcs.join(colour.select(F.col("id").alias("u"), F.col("c").alias("cu")), "u").join(colour.select(F.col("id").alias("v"), F.col("c").alias("cv")), "v")
        inside = settle(marked.filter("cu = cv").select("u", "v", "cu"), "inside")
        # Backwards from each colour's own node, within the colour.
        found = reached(inside.select(F.col("v").alias("u"), F.col("u").alias("v")), colour.filter("id = c").select(F.col("c").alias("start"), "id"))
        found = found.select("id", F.col("start").alias("component"))
        done = settle(found if done is None else done.unionByName(found), "strong")
        gone = found.select("id")
        arcs = settle(arcs.join(gone, F.col("u") == F.col("id"), "left_anti").join(gone, F.col("v") == F.col("id"), "left_anti"), "arcs")
    if done is None:
        return ends.select("id", F.col("id").alias("component"))
    return ends.join(done, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def truncated(nodes: DataFrame, edges: DataFrame, west: float, south: float, east: float, north: float) -> DataFrame:
    """The edges (u, v) within a box whose ends (nodes: id, lon, lat) lie in its largest strongly connected part; of equally
    large parts the one of the smallest id."""
    inside = nodes.filter(F.col("lon").between(west, east) & F.col("lat").between(south, north)).select("id")
    part = edges.join(inside, F.col("u") == F.col("id"), "left_semi").join(inside, F.col("v") == F.col("id"), "left_semi")
    strong = settle(strong_components(part), "strong")
    top = strong.groupBy("component").count().orderBy(F.desc("count"), "component").limit(1).select("component")
    keep = strong.join(F.broadcast(top), "component").select("id")
    return part.join(keep, F.col("u") == F.col("id"), "left_semi").join(keep, F.col("v") == F.col("id"), "left_semi")


def simplified(edges: DataFrame, kept: DataFrame | None = None, first: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Chains of directed edges (u, v, length_m) through nodes without a choice, each as one edge, and their members.

    A node is passed through if it has just two neighbours and either one edge in and one out, or two in and two out, one to
    and one from each neighbour; kept (id) names nodes that stay whatever their edges, such as barriers. All others end
    chains, and so do nodes with parallel edges. A chain never turns back at a node that it passes. Rings that have no end
    at all are left out. Null ends are no edges; a null length counts as 0.

    Returns (chain, u, v, length_m, n, and as sets all different values of the columns named in first) and members (chain,
    place, u, v, length_m): chain is a number, place counts a chain's edges from 0. Chains are ranked by pointer jumping:
    each edge points to the one before it, and in each round looks twice as far back, so a chain of n edges takes about
    log(n) rounds; no task walks a chain.
    """
    rows = edges.filter("u IS NOT NULL AND v IS NOT NULL").select("u", "v", F.coalesce(F.col("length_m").cast("double"), F.lit(0.0)).alias("length_m"), *first)
    arcs = settle(rows.select(F.monotonically_increasing_id().alias("arc"), "*"), "arcs")
    out, into = arcs.select(F.col("u").alias("id"), F.col("v").alias("other"), F.lit(1).alias("o")), arcs.select(F.col("v").alias("id"), F.col("u").alias("other"), F.lit(0).alias("o"))
    ends = out.unionByName(into).groupBy("id", "other").agg(F.sum("o").alias("outs"), F.sum(1 - F.col("o")).alias("ins"))
    degree = ends.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.sum("outs").alias("outs"), F.sum("ins").alias("ins"), F.max(F.greatest("outs", "ins")).alias("most"), F.bool_or(F.col("id") == F.col("other")).alias("loop"))
    through = degree.filter("n = 2 AND NOT loop AND most = 1 AND outs = ins AND outs IN (1, 2)").select("id")
    if kept is not None:
        through = through.join(kept.select("id").filter("id IS NOT NULL").distinct(), "id", "left_anti")
    through = settle(through, "through")
    marked = arcs
    for side in ("u", "v"):
        marked = marked.join(through.select(F.col("id").alias(side), F.lit(True).alias(f"_{side}")), side, "left")
    marked = settle(marked.select("arc", "u", "v", "length_m", *first, F.coalesce("_u", F.lit(False)).alias("from_through"), F.coalesce("_v", F.lit(False)).alias("to_through")), "arcs")
    # What an edge out of a passed node follows: the edge into that node from the other neighbour.
    before = marked.filter("to_through").select(F.col("arc").alias("before"), F.col("u").alias("_from"), F.col("v").alias("u"))
    jump = marked.filter("from_through").join(before, "u").filter("_from != v").select("arc", "before")
    state = marked.select("arc", "from_through").join(jump, "arc", "left").select("arc", F.when(F.col("from_through"), F.col("before")).alias("before"), F.when(~F.col("from_through"), F.col("arc")).alias("chain"), F.when(F.col("from_through"), 1).otherwise(0).cast("bigint").alias("place"))
    state = settle(state, "jumps")
    while True:
        back = state.select(F.col("arc").alias("before"), F.col("before").alias("_b"), F.col("chain").alias("_c"), F.col("place").alias("_p"))
        # place counts the edges between an edge and where it points; at a chain's first edge the way ends.
        far = state.filter("chain IS NULL AND before IS NOT NULL").join(back, "before", "left")
        step = far.select("arc", F.col("_b").alias("before"), F.col("_c").alias("chain"), (F.col("place") + F.coalesce("_p", F.lit(0))).alias("place"))
        rest = state.filter("chain IS NOT NULL OR before IS NULL")
        state = settle(rest.withColumn("new", F.lit(False)).unionByName(step.withColumn("new", F.col("chain").isNotNull())), "jumps")
        if state.filter("new").isEmpty():
            break
        state = state.drop("new")
    members = settle(marked.join(state.filter("chain IS NOT NULL").select("arc", "chain", "place"), "arc"), "members")
    whole = members.groupBy("chain").agg(
        F.min_by("u", "place").alias("u"), F.max_by("v", "place").alias("v"), F.sum("length_m").alias("length_m"), F.count(F.lit(1)).alias("n"), *[F.array_sort(F.collect_set(c)).alias(c) for c in first]
    )
    return whole, members.select("chain", "place", "u", "v", "length_m")


def complete_ways(nodes: DataFrame, way_nodes: DataFrame, members: DataFrame, west: float, south: float, east: float, north: float) -> DataFrame:
    """(type, id) of what a cut to a box keeps: nodes (id, lon, lat) in it, ways (way_nodes: way_id, node_id) with such a node,
    whole, so their other nodes too, and relations (members: relation_id, type, ref) with such a node or way as a member;
    what only a relation names isn't followed. Semi joins on ids."""
    inside = settle(nodes.filter(F.col("lon").between(west, east) & F.col("lat").between(south, north)).select("id").distinct(), "inside")
    ways = settle(way_nodes.join(inside, F.col("node_id") == F.col("id"), "left_semi").select("way_id").distinct(), "ways")
    back = way_nodes.join(ways, "way_id", "left_semi").select(F.col("node_id").alias("id"))
    kept = inside.select(F.lit("node").alias("type"), F.col("id").alias("ref")).unionByName(ways.select(F.lit("way").alias("type"), F.col("way_id").alias("ref")))
    relations = members.join(kept, ["type", "ref"], "left_semi").select("relation_id").distinct()
    every = [("node", inside.unionByName(back).join(nodes.select("id"), "id", "left_semi").distinct(), "id"), ("way", ways, "way_id"), ("relation", relations, "relation_id")]
    out = [d.select(F.lit(t).alias("type"), F.col(c).alias("id")) for t, d, c in every]
    return out[0].unionByName(out[1]).unionByName(out[2])


def longest_runs(edges: DataFrame) -> DataFrame:
    """(component, a, b, length_m): for each component of edges (u, v, length_m; both ways) its longest shortest path as two
    sweeps find it: a is the node farthest from the smallest one, b the node farthest from a, ties to the smaller id. All
    components are swept at once."""
    both = settle(edges.select("u", "v", "length_m").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "length_m")), "both")
    parts = settle(components(both.select(F.col("u").alias("id")), both), "parts")

    def farthest(starts: DataFrame, name: str) -> DataFrame:
        reach = path_costs(both, starts.select("id")).join(parts, "id")
        best = reach.groupBy("component").agg(F.max(F.struct("cost", (-F.col("id")).alias("n"))).alias("b"))
        return settle(best.select("component", (-F.col("b.n")).alias("id"), F.col("b.cost").alias("cost")), name)

    one = farthest(parts.filter("id = component"), "sweep")
    two = farthest(one, "sweep")
    return one.select("component", F.col("id").alias("a")).join(two.select("component", F.col("id").alias("b"), F.col("cost").alias("length_m")), "component")


#: What an edge that was ridden costs again, and what it costs near a place that the author named.
REUSE, RELIEF = 8.0, 1.25


def circuits(edges: DataFrame, anchors: DataFrame, relief: DataFrame | None = None, reuse: float = REUSE, ease: float = RELIEF) -> DataFrame:
    """(request, leg, place, u, v, cost): the walk of each request through its anchors (request, k, node, optional) in order, by
    cheapest paths along directed edges (u, v, cost).

    An edge that the request rode on an earlier leg, either way, costs reuse times as much, or ease times if both its ends
    are among the request's relief (request, node). Of parallel edges the cheapest counts. An anchor equal to the one
    before makes no leg; an optional one that can't be reached is passed over, unless it is the last; a request of which
    another one can't be reached has no walk at all. cost is the edge's own. Ties go to fewer edges, then to smaller ids.

    All requests are solved together, leg by leg: each round relaxes the nodes whose cost fell, as rows of (request, node),
    and leaves out what costs more than the way to the anchor that is known already. Paths are read back by pointer
    jumping. So no task holds the graph or a request's search.
    """
    arcs = settle(edges.filter("u IS NOT NULL AND v IS NOT NULL AND u != v AND cost >= 0").groupBy("u", "v").agg(F.min("cost").alias("w")), "arcs")
    stops = settle(anchors.select("request", "k", "node", "optional"), "stops")
    last = stops.groupBy("request").agg(F.max("k").alias("last"))
    at = settle(stops.groupBy("request").agg(F.min_by("node", "k").alias("src")), "at")
    near = settle(relief.select("request", "node").distinct(), "relief") if relief is not None else None
    ridden, failed, walk = None, None, None
    for k in sorted(r.k for r in stops.select("k").distinct().collect())[1:]:
        goal = settle(stops.filter(F.col("k") == k).join(at, "request").join(last, "request").select("request", "src", F.col("node").alias("dst"), "optional", (F.col("last") == k).alias("final")), "goal")
        todo = goal.filter("src != dst").select("request", "src", "dst")
        known = settle(todo.select("request", F.col("src").alias("node"), F.lit(0.0).alias("cost"), F.lit(0).alias("hops"), F.lit(None).cast("long").alias("prev")), "known")
        moved = known
        while not moved.isEmpty():
            out = moved.join(arcs, F.col("node") == F.col("u")).select("request", "u", "v", "cost", "hops", "w")
            if ridden is not None:
                out = out.withColumns({"lo": F.least("u", "v"), "hi": F.greatest("u", "v")}).join(ridden, ["request", "lo", "hi"], "left").withColumn("w", F.col("w") * F.coalesce("factor", F.lit(1.0)))
            reach = out.groupBy("request", F.col("v").alias("node")).agg(F.min(F.struct((F.col("cost") + F.col("w")).alias("cost"), (F.col("hops") + 1).alias("hops"), F.col("u").alias("prev"))).alias("new"))
            merged = known.join(reach, ["request", "node"], "full")
            old = F.struct("cost", "hops", "prev")
            fell = F.col("new").isNotNull() & (F.col("cost").isNull() | (F.col("new") < old))
            step = settle(merged.select("request", "node", F.when(fell, F.col("new")).otherwise(old).alias("best"), fell.alias("fell")).select("request", "node", "best.*", "fell"), "known")
            known = step.drop("fell")
            bound = todo.join(known.withColumnRenamed("node", "dst").select("request", "dst", F.col("cost").alias("most")), ["request", "dst"]).select("request", "most")
            moved = step.filter("fell").drop("fell").join(bound, "request", "left").filter("most IS NULL OR cost <= most").drop("most")
        # The nodes that lie on the way: from the anchor back, twice as far in each round.
        on = settle(known.join(todo.select("request", F.col("dst").alias("node")), ["request", "node"], "left_semi").select("request", "node"), "on")
        back = settle(known.filter("prev IS NOT NULL").select("request", "node", "prev"), "back")
        while True:
            fresh = settle(on.join(back, ["request", "node"]).select("request", F.col("prev").alias("node")).distinct().join(on, ["request", "node"], "left_anti"), "on")
            if fresh.isEmpty():
                break
            on = settle(on.unionByName(fresh), "on")
            back = settle(back.join(back.select("request", F.col("node").alias("prev"), F.col("prev").alias("_p")), ["request", "prev"]).select("request", "node", F.col("_p").alias("prev")), "back")
        leg = known.join(on, ["request", "node"]).filter("prev IS NOT NULL").select("request", F.lit(k).alias("leg"), F.col("hops").alias("place"), F.col("prev").alias("u"), F.col("node").alias("v"))
        leg = settle(leg.join(arcs, ["u", "v"]).select("request", "leg", "place", "u", "v", F.col("w").alias("cost")), "leg")
        walk = leg if walk is None else walk.unionByName(leg)
        got = leg.select("request", F.lit(True).alias("got")).distinct()
        state = settle(goal.join(got, "request", "left").withColumn("ok", F.coalesce("got", F.lit(False)) | (F.col("src") == F.col("dst"))), "state")
        lost = state.filter("NOT ok AND (final OR NOT coalesce(optional, false))").select("request")
        failed = settle(lost if failed is None else failed.unionByName(lost), "failed")
        ended = at.join(state.select("request", "dst", "ok"), "request", "left").join(failed, "request", "left_anti")
        at = settle(ended.select("request", F.when(F.col("ok"), F.col("dst")).otherwise(F.col("src")).alias("src")), "at")
        used = walk.select("request", F.least("u", "v").alias("lo"), F.greatest("u", "v").alias("hi")).distinct().withColumn("factor", F.lit(float(reuse)))
        if near is not None:
            for side in ("lo", "hi"):
                used = used.join(near.select("request", F.col("node").alias(side), F.lit(True).alias(f"_{side}")), ["request", side], "left")
            used = used.withColumn("factor", F.when(F.col("_lo") & F.col("_hi"), float(ease)).otherwise(F.col("factor"))).drop("_lo", "_hi")
        ridden = settle(used, "ridden")
    if walk is None:
        return arcs.limit(0).select(F.lit(0).cast("long").alias("request"), F.lit(0).alias("leg"), F.lit(0).alias("place"), "u", "v", F.col("w").alias("cost"))
    return walk.join(failed, "request", "left_anti")
