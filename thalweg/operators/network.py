"""Operators on networks of directed links (fid, nodea, nodeb, length).

Other columns of the links go through. Nulls in node columns join nothing; ties are broken by the smallest
key. Work is done by joins and aggregates over links; nothing is gathered per basin.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import grid
from ..plans.iterate import closure, components, cut, drop, jump, relax, shed, some
from ..sources.derived import load, sql

# Node types by (links in, links out), 2 standing for two or more.
NODE_TYPES = {
    (0, 0): "ISOL", (0, 1): "SRCE", (0, 2): "DIVG", (1, 0): "EXUT", (1, 1): "NODE", (1, 2): "DIFL", (2, 0): "SINK", (2, 1): "CONF", (2, 2): "XSIN",
}


def degrees(links: DataFrame) -> DataFrame:
    """(gid, din, dout) of every node."""
    ends = links.select(F.explode(F.array(F.struct(F.col("nodea").alias("gid"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("nodeb").alias("gid"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e"))
    return ends.groupBy("e.gid").agg(F.sum("e.i").alias("din"), F.sum("e.o").alias("dout"))


def node_type(din: Column, dout: Column) -> Column:
    out = F.lit(None).cast("string")
    for (i, o), name in NODE_TYPES.items():
        out = F.when((F.least(din, F.lit(2)) == i) & (F.least(dout, F.lit(2)) == o), name).otherwise(out)
    return out


def network_nodes(links: DataFrame, measure: DataFrame | None = None, subset: list[str] | None = None) -> DataFrame:
    """(gid, din, dout, type[, meas]): nodes with their degrees, type and the measure of their first link."""
    out = degrees(links).withColumn("type", node_type(F.col("din"), F.col("dout")))
    if measure is not None:
        out = out.join(measure.select(F.col("node").alias("gid"), F.col("value").alias("meas")), "gid", "left")
    return out.where(F.col("type").isin(subset)) if subset else out


def reverse_flow_direction(links: DataFrame) -> DataFrame:
    """Links with nodes swapped, and the vertices of geom, if any, reversed."""
    swapped = {"nodea": F.col("nodeb"), "nodeb": F.col("nodea")}
    if "geom" in links.columns:
        swapped["geom"] = F.reverse("geom")
    return links.withColumns(swapped)


def aggregate_stream_segments(links: DataFrame, category: str | None = None, copy: list[str] | None = None) -> DataFrame:
    """(gid, [category], nodea, nodeb, length, n_links, copies): links merged through nodes with one link in and one out.

    gid is the smallest fid of the segment; copied columns come from its first link. A ring without a start is not emitted.
    """
    cat = F.col(category) if category else F.lit(0)
    rows = links.withColumn("cat", cat)
    ends = rows.select("cat", F.col("nodea").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")).union(rows.select("cat", F.col("nodeb").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    through = ends.groupBy("cat", "node").agg(F.sum("i").alias("din"), F.sum("o").alias("dout")).where("din = 1 and dout = 1").select("cat", "node")
    follow = rows.select("cat", F.col("nodea").alias("node"), F.col("fid").alias("next")).join(through, ["cat", "node"])
    steps = rows.select("fid", "cat", F.col("nodeb").alias("node")).join(follow, ["cat", "node"], "left").select(F.col("fid").alias("id"), "next", F.lit(1.0).alias("ahead"))
    chain = jump(steps, carry={"ahead": "sum"}).withColumnRenamed("id", "fid")
    parts = rows.join(chain, "fid")
    first = F.max_by(F.struct("nodea", *(copy or [])), F.col("ahead")).alias("first")
    out = parts.groupBy("root", "cat").agg(F.min("fid").alias("gid"), first, F.min_by("nodeb", "ahead").alias("nodeb"), F.sum("length").alias("length"), F.count("*").alias("n_links"))
    return out.select("gid", *([F.col("cat").alias(category)] if category else []), "first.nodea", "nodeb", "length", "n_links", *(F.col(f"first.{c}").alias(c) for c in copy or []))


def aggregate_undirected_lines(links: DataFrame) -> DataFrame:
    """(gid, length, n_links): links merged, whatever their direction, through nodes of degree 2; gid is the smallest fid."""
    ends = links.select("fid", F.col("nodea").alias("node")).union(links.select("fid", F.col("nodeb").alias("node")))
    through = ends.groupBy("node").agg(F.count("*").alias("n"), F.min("fid").alias("a"), F.max("fid").alias("b")).where("n = 2 and a <> b")
    label = components(through).withColumnRenamed("id", "fid")
    return links.join(label, "fid", "left").groupBy(F.coalesce("component", "fid").alias("gid")).agg(F.sum("length").alias("length"), F.count("*").alias("n_links"))


def outlets(links: DataFrame) -> DataFrame:
    """(node): nodes with links in and none out."""
    return links.select(F.col("nodeb").alias("node")).distinct().join(links.select(F.col("nodea").alias("node")).distinct(), "node", "left_anti")


def sources(links: DataFrame) -> DataFrame:
    return links.select(F.col("nodea").alias("node")).distinct().join(links.select(F.col("nodeb").alias("node")).distinct(), "node", "left_anti")


def single_downstream(links: DataFrame) -> bool:
    return not some(links.groupBy("nodea").agg(F.count("*").alias("n")).where("n > 1"))


def distance_to_outlet(links: DataFrame) -> DataFrame:
    """(node, value): the longest way to an outlet. A cycle above an outlet raises ValueError.

    Where every node has one link out, ways are followed by pointer jumping; else by relaxation from the outlets.
    """
    if single_downstream(links):
        flow = links.select(F.col("nodea").alias("id"), F.col("nodeb").alias("next"), "length")
        ends = outlets(links).select(F.col("node").alias("id"), F.lit(None).cast("long").alias("next"), F.lit(0.0).alias("length"))
        return jump(flow.unionByName(ends), carry={"length": "sum"}).where("root is not null").select(F.col("id").alias("node"), F.col("length").alias("value"))
    steps = links.select(F.col("nodeb").alias("src"), F.col("nodea").alias("dst"), F.col("length").alias("cost"))
    return relax(outlets(links).withColumn("value", F.lit(0.0)), steps, "max")


def measure_network(links: DataFrame) -> DataFrame:
    """Links with `measure`, the longest way from their to-node to an outlet."""
    at = distance_to_outlet(links).select(F.col("node").alias("nodeb"), F.col("value").alias("measure"))
    return links.join(at, "nodeb", "left")


def longest_path(links: DataFrame, multiflow: bool = True) -> DataFrame:
    """The links of the longest way from a source to an outlet; with multiflow all links downstream of its head."""
    at = cut(distance_to_outlet(links))
    head = at.join(sources(links), "node").orderBy(F.desc("value"), "node").limit(1).select("node")
    if multiflow:
        steps = links.select(F.col("nodea").alias("src"), F.col("nodeb").alias("dst"))
    else:
        far = links.join(at.select(F.col("node").alias("nodeb"), "value"), "nodeb")
        best = far.groupBy("nodea").agg(F.max_by("fid", F.struct(F.col("value") + F.col("length"), -F.col("fid"))).alias("fid"))
        links = cut(links.join(best.select("fid"), "fid", "left_semi"))
        steps = links.select(F.col("nodea").alias("src"), F.col("nodeb").alias("dst"))
    seen = closure(head, steps).select(F.col("node").alias("nodea"))
    return links.join(seen, "nodea", "left_semi")


def principal_stem(links: DataFrame, cost: str = "length") -> DataFrame:
    """The links on least-cost ways from every source to an outlet."""
    priced = links.withColumn("__cost", F.expr(cost).cast("double"))
    steps = priced.select(F.col("nodeb").alias("src"), F.col("nodea").alias("dst"), F.col("__cost").alias("cost"))
    at = cut(relax(outlets(links).withColumn("value", F.lit(0.0)), steps, "min"))
    far = priced.join(at.select(F.col("node").alias("nodeb"), "value"), "nodeb")
    best = far.groupBy("nodea").agg(F.min_by("fid", F.struct(F.col("value") + F.col("__cost"), "fid")).alias("fid"))
    return links.join(best.select("fid"), "fid", "left_semi")


def select_connected(links: DataFrame, seeds: DataFrame, direction: str = "upstream") -> DataFrame:
    """Links reachable from the seed links (fid): upstream, downstream, both or undirected."""
    up = links.select(F.col("nodeb").alias("src"), F.col("nodea").alias("dst"))
    down = links.select(F.col("nodea").alias("src"), F.col("nodeb").alias("dst"))
    start = links.join(seeds, "fid", "left_semi")
    parts = []
    if direction in ("upstream", "both"):
        nodes = closure(start.select(F.col("nodea").alias("node")), up)
        parts.append(links.join(nodes.select(F.col("node").alias("nodeb")), "nodeb", "left_semi").select("fid"))
    if direction in ("downstream", "both"):
        nodes = closure(start.select(F.col("nodeb").alias("node")), down)
        parts.append(links.join(nodes.select(F.col("node").alias("nodea")), "nodea", "left_semi").select("fid"))
    if direction == "undirected":
        nodes = closure(start.select(F.col("nodea").alias("node")), up.union(down))
        parts.append(links.join(nodes.select(F.col("node").alias("nodea")), "nodea", "left_semi").select("fid"))
    picked = start.select("fid")
    for p in parts:
        picked = picked.union(p)
    return links.join(picked.distinct(), "fid", "left_semi")


def select_connected_basins(basins: DataFrame, direction: str = "upstream") -> DataFrame:
    """Basins (id, downstream) reachable from those with is_selected."""
    seeds = basins.where("is_selected").select(F.col("id").alias("node"))
    down = basins.where("downstream is not null").select(F.col("id").alias("src"), F.col("downstream").alias("dst"))
    found = seeds
    if direction in ("upstream", "both"):
        found = found.union(closure(seeds, down.select(F.col("dst").alias("src"), F.col("src").alias("dst"))))
    if direction in ("downstream", "both"):
        found = found.union(closure(seeds, down))
    return basins.join(found.distinct(), basins.id == found.node, "left_semi")


def select_headwater_basins(basins: DataFrame) -> DataFrame:
    """Basins that drain into another one and have none upstream."""
    return basins.where("downstream is not null").join(basins.select(F.col("downstream").alias("id")), "id", "left_anti")


def _trimmed(links: DataFrame) -> DataFrame:
    """Links left after repeatedly taking away those whose from-node has no link in or whose to-node has no link out: cycles and what joins them."""
    rest = cut(links)
    n = rest.count()
    while n:
        kept = rest.join(rest.select(F.col("nodeb").alias("nodea")).distinct(), "nodea", "left_semi").join(rest.select(F.col("nodea").alias("nodeb")).distinct(), "nodeb", "left_semi")
        past, rest = rest, cut(kept)
        drop(past)
        m = rest.count()
        if m == n:
            break
        n = m
    return rest


def strong_components(links: DataFrame) -> DataFrame:
    """(node, scc) for nodes on cycles: forward and backward labels are narrowed until they agree."""
    rest, done = _trimmed(links.select("nodea", "nodeb").distinct()), None
    while some(rest):
        nodes = rest.select(F.col("nodea").alias("id")).union(rest.select("nodeb")).distinct()
        fwd = cut(_lowest(nodes, rest.select(F.col("nodea").alias("src"), F.col("nodeb").alias("dst"))))
        # The nodes that reach their own label's node are one component with it.
        back = rest.join(fwd.toDF("nodea", "la"), "nodea").join(fwd.toDF("nodeb", "lb"), "nodeb").where("la = lb")
        steps = back.select(F.col("nodeb").alias("src"), F.col("nodea").alias("dst"))
        reach = closure(fwd.where("id = label").select(F.col("id").alias("node")), steps)
        found = cut(reach.join(fwd.toDF("node", "scc"), "node"))
        done = found if done is None else done.union(found)
        rest = _trimmed(rest.join(found.select(F.col("node").alias("nodea")), "nodea", "left_anti").join(found.select(F.col("node").alias("nodeb")), "nodeb", "left_anti"))
    if done is None:
        return links.select(F.col("nodea").alias("node"), F.col("nodea").alias("scc")).limit(0)
    return done


def _lowest(nodes: DataFrame, steps: DataFrame) -> DataFrame:
    """(id, label): the smallest id that reaches each node."""
    label = held = cut(nodes.select("id", F.col("id").alias("label")))
    while True:
        near = steps.join(label.toDF("src", "theirs"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("theirs").alias("theirs"))
        after = cut(label.join(near, "id", "left").select("id", F.least("label", "theirs").alias("label"), F.col("label").alias("was")))
        drop(held)
        held, label = after, after.select("id", "label")
        if not some(after.where("label <> was")):
            return label


def select_graph_cycle(links: DataFrame) -> DataFrame:
    """Links that lie on a directed cycle."""
    scc = strong_components(links)
    return links.join(scc.toDF("nodea", "sa"), "nodea").join(scc.toDF("nodeb", "sb"), "nodeb").where("sa = sb").drop("sa", "sb")


def fix_network_cycles(links: DataFrame) -> DataFrame:
    """Links with `fixed`: within a cycle, links that run against the order of distance from the nodes that enter it are reversed.

    Nodes of a cycle take their rank from the fewest links from an entry (its smallest node where nothing enters); a link
    goes from the lower to the higher rank, ties by node.
    """
    scc = cut(strong_components(links).toDF("node", "scc"))
    tagged = links.join(scc.toDF("nodea", "sa"), "nodea", "left").join(scc.toDF("nodeb", "sb"), "nodeb", "left")
    inside = tagged.where("sa = sb")
    entries = tagged.where("sb is not null and (sa is null or sa <> sb)").select(F.col("nodeb").alias("node"), F.col("sb").alias("scc")).distinct()
    closed = scc.groupBy("scc").agg(F.min("node").alias("node")).join(entries.select("scc").distinct(), "scc", "left_anti").select("node", "scc")
    start = entries.unionByName(closed).select("node", F.lit(0.0).alias("value"))
    rank = relax(start, inside.select(F.col("nodea").alias("src"), F.col("nodeb").alias("dst"), F.lit(1.0).alias("cost")), "min")
    ra, rb = rank.select(F.col("node").alias("nodea"), F.col("value").alias("ra")), rank.select(F.col("node").alias("nodeb"), F.col("value").alias("rb"))
    out = tagged.join(ra, "nodea", "left").join(rb, "nodeb", "left")
    fixed = F.coalesce((F.col("sa") == F.col("sb")) & (F.struct("ra", "nodea") > F.struct(F.col("rb").alias("ra"), F.col("nodeb").alias("nodea"))), F.lit(False))
    cols = {"nodea": F.when(fixed, F.col("nodeb")).otherwise(F.col("nodea")), "nodeb": F.when(fixed, F.col("nodea")).otherwise(F.col("nodeb")), "fixed": fixed.cast("int")}
    return out.select(*(cols[c].alias(c) if c in cols else c for c in [*links.columns, "fixed"]))


def strahler_order(links: DataFrame, axis: str | None = None) -> DataFrame:
    """Links with `strahler`. Two arriving links of the highest order raise it, unless they are of one axis; loops get null.

    The order is the same along a chain of links, so chains are followed by pointer jumping and levels are
    those of confluences: a chain is known when all chains into its first node are. What has arrived at a
    node is kept as the greatest and the smallest axis of the highest order, and a count. Where levels are
    many, as on a stem with a tributary at every node, `_tree_orders` takes over: if an eighth of the chains is left
    after four levels, every node has one link out, and there is neither a cycle nor an axis to heed.
    """
    edges = cut(links.select("fid", "nodea", "nodeb", (F.col(axis) if axis else F.col("fid")).alias("axis")))
    through = degrees(edges).where("din = 1 and dout = 1").select(F.col("gid").alias("node"))
    follow = edges.select(F.col("nodea").alias("node"), F.col("fid").alias("next")).join(through, "node")
    chain = jump(edges.select(F.col("fid").alias("id"), F.col("nodeb").alias("node")).join(follow, "node", "left").select("id", "next", F.lit(1.0).alias("ahead")), carry={"ahead": "sum"})
    parts = edges.join(chain.select(F.col("id").alias("fid"), "root", "ahead").where("root is not null"), "fid")
    segs = cut(parts.groupBy("root").agg(F.max_by("nodea", "ahead").alias("nodea"), F.min_by("nodeb", "ahead").alias("nodeb"), F.min_by("axis", "ahead").alias("axis")))
    into = edges.groupBy(F.col("nodeb").alias("node")).agg(F.count("*").alias("din"))
    frontier = cut(segs.join(into.select(F.col("node").alias("nodea")), "nodea", "left_anti").withColumn("o", F.lit(1)))
    known, waiting, level = frontier, None, 0
    while some(frontier):
        level += 1
        if level == 4 and axis is None and 8 * (segs.count() - known.count()) > segs.count() and single_downstream(edges):
            flow = edges.select(F.col("nodea").alias("id"), F.col("nodeb").alias("next")).unionByName(outlets(edges).select(F.col("node").alias("id"), F.lit(None).cast("long").alias("next")))
            if not some(jump(flow).where("root is null")):
                return links.join(_tree_orders(edges), "fid", "left")
        came = frontier.groupBy(F.col("nodeb").alias("node")).agg(F.max(F.struct("o", "axis")).alias("hi"), F.min(F.struct((-F.col("o")).alias("o"), "axis")).alias("lo"), F.count("*").alias("n"))
        came = came if waiting is None else waiting.unionByName(came).groupBy("node").agg(F.max("hi").alias("hi"), F.min("lo").alias("lo"), F.sum("n").alias("n"))
        came = cut(came.join(into, "node"))
        waiting = came.where("n < din").drop("din")
        order = F.when(F.col("hi.axis") != F.col("lo.axis"), F.col("hi.o") + 1).otherwise(F.col("hi.o"))
        frontier = cut(segs.join(came.where("n = din").select(F.col("node").alias("nodea"), order.alias("o")), "nodea").select("root", "nodea", "nodeb", "axis", "o"))
        known = known.unionByName(frontier.select(*known.columns))
    orders = parts.select("fid", "root").join(known.select("root", F.col("o").alias("strahler")), "root").select("fid", "strahler")
    return links.join(orders, "fid", "left")


def _tree_orders(links: DataFrame) -> DataFrame:
    """(fid, strahler) of a tree without rounds for its confluences.

    A link has an order above k where, at its first node or upstream of it, two links of order k or more meet. So
    from k = 1 on the nodes where that happens are marked, and sums over the tree by doubling mark what is below
    them. Orders are logarithmic in the number of links, and each step keeps half of the sources at most.
    """
    alive = cut(links.select("fid", "nodea", "nodeb"))
    orders = alive.select("fid", F.lit(1).alias("strahler"))
    k = 1
    while True:
        met = cut(alive.groupBy(F.col("nodeb").alias("id")).agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit(1.0).alias("w")))
        if not some(met):
            return orders.groupBy("fid").agg(F.max("strahler").alias("strahler"))
        below = sum_upstream(alive.select(F.col("nodea").alias("id"), F.col("nodeb").alias("next")), met)
        alive = cut(alive.join(below.where("total > 0").select(F.col("id").alias("nodea")), "nodea", "left_semi"))
        k += 1
        orders = orders.unionByName(alive.select("fid", F.lit(k).alias("strahler")))


def hack_order(links: DataFrame) -> DataFrame:
    """Links of a tree with axis (the source of the longest branch), laxis (its length) and hack (its rank).

    At a confluence the link whose branch reaches farthest from the outlet keeps the axis; a tributary ranks one below
    the axis that it joins.
    """
    at = cut(distance_to_outlet(links))
    measured = links.join(at.select(F.col("node").alias("nodea"), F.col("value").alias("da")), "nodea").select("fid", "nodea", "nodeb", "da")
    measured = cut(measured)
    # Highest source distance above each link: relax downstream from the sources.
    far = cut(reach_of_sources(measured, at))
    ranked = measured.join(far, "nodea").withColumn("first", F.row_number().over(Window.partitionBy("nodeb").orderBy(F.desc("reach"), "fid")) == 1)
    ranked = cut(ranked)
    main = ranked.where("first").select(F.col("nodeb").alias("node"), F.col("fid").alias("above"))
    # The axis of a link is named by its topmost link: follow main links upstream.
    chain = ranked.select("fid", "nodea").join(main, ranked.nodea == main.node, "left").select(F.col("fid").alias("id"), F.col("above").alias("next"))
    axes = cut(jump(chain).select(F.col("id").alias("fid"), F.col("root").alias("axis")))
    lined = cut(ranked.join(axes, "fid"))
    # An axis ends where its lowest link is a tributary or an outlet; its parent is the axis of the link below.
    lowest = lined.join(lined.select(F.col("nodea").alias("n2"), F.col("axis").alias("below"), F.col("fid").alias("f2")), F.col("nodeb") == F.col("n2"), "left")
    ends = cut(lowest.where("below is null or below <> axis").groupBy("axis").agg(F.min("below").alias("parent"), F.min("nodeb").alias("end")))
    rank = jump(ends.select(F.col("axis").alias("id"), F.col("parent").alias("next"), F.lit(1.0).alias("hops")), carry={"hops": "sum"}).select(F.col("id").alias("axis"), (F.col("hops") + 1).cast("int").alias("hack"))
    end_at = ends.join(at.select(F.col("node").alias("end"), F.col("value").alias("end_at")), "end", "left").select("axis", "end_at")
    sizes = lined.groupBy("axis").agg(F.max("da").alias("source_at"))
    out = axes.join(rank, "axis").join(sizes.join(end_at, "axis").select("axis", (F.col("source_at") - F.coalesce("end_at", F.lit(0.0))).alias("laxis")), "axis")
    return links.join(out, "fid", "left")


def reach_of_sources(measured: DataFrame, at: DataFrame) -> DataFrame:
    """(nodea, reach): the largest distance to the outlet of any source above a node, itself included."""
    heads = at.join(sources(measured), "node").select("node", "value")
    if single_downstream(measured):
        top = sum_upstream(measured.select(F.col("nodea").alias("id"), F.col("nodeb").alias("next")), heads.select(F.col("node").alias("id"), F.col("value").alias("w")), "max")
        return top.where("total is not null").select(F.col("id").alias("nodea"), F.col("total").alias("reach"))
    steps = measured.select(F.col("nodea").alias("src"), F.col("nodeb").alias("dst"), F.lit(0.0).alias("cost"))
    return relax(heads, steps, "max").select(F.col("node").alias("nodea"), F.col("value").alias("reach"))


def total_upstream_channel_length(links: DataFrame, scale: float = 0.001) -> DataFrame:
    """Links with tucl: the length of all links above, each counted once, plus their own, times scale.

    Where a node has several links out, the one on its longest way to the outlet carries what is above; the
    others carry their own length only, which is credited to the node they reach.
    """
    at = cut(distance_to_outlet(links))
    far = links.join(at.select(F.col("node").alias("nodeb"), "value"), "nodeb")
    best = far.groupBy("nodea").agg(F.max_by("fid", F.struct(F.col("value") + F.col("length"), -F.col("fid"))).alias("main"))
    edges = cut(links.join(best, "nodea").select("fid", "nodea", "nodeb", "length", (F.col("fid") == F.col("main")).alias("main")))
    tree = edges.where("main")
    own = edges.groupBy(F.col("nodeb").alias("node")).agg(F.sum("length").alias("own"))
    # Sum over the tree by doubling: each node's mass goes to all nodes below it, level by level of powers of two.
    mass = sum_upstream(tree.select(F.col("nodea").alias("id"), F.col("nodeb").alias("next")), own.select(F.col("node").alias("id"), F.col("own").alias("w")))
    total = edges.join(mass.select(F.col("id").alias("nodea"), F.col("total")), "nodea", "left")
    value = F.when(F.col("main"), F.coalesce("total", F.lit(0.0)) + F.col("length")).otherwise(F.col("length"))
    return links.join(total.select("fid", (value * scale).alias("tucl")), "fid")


def sum_upstream(steps: DataFrame, weights: DataFrame, how: str = "sum") -> DataFrame:
    """(id, total): for each id the sum (or the max) of the weights of all ids whose chain (id -> next) passes it, its own included.

    Doubling: in round k an id's total over the last 2**k steps above it is added at the id 2**k steps below, and the
    pointers double; so rounds are the logarithm of the longest chain. Ids whose chain runs into a cycle have null.
    Leaves have their totals at once, and hand them on before the rounds, which hold what is left without them.
    """
    zero, gather = (F.lit(0.0), F.sum) if how == "sum" else (F.lit(None).cast("double"), F.max)
    both = (lambda a, b: F.col(a) + F.coalesce(b, F.lit(0.0))) if how == "sum" else F.greatest
    ids = steps.select("id").union(steps.where("next is not null").select("next")).union(weights.select("id")).distinct()
    state = ids.join(weights, "id", "left").join(steps, "id", "left").select("id", F.coalesce(F.col("w").cast("double"), zero).alias("total"), "next")
    state, levels = shed(cut(state), lambda rest, leaves: rest.join(leaves.where("next is not null").groupBy(F.col("next").alias("id")).agg(gather("total").alias("more")), "id", "left").select("id", both("total", F.col("more")).alias("total"), "next"))
    if levels:
        state = cut(state)
    taken = [level.where("leaf").select("id", "total") for level in levels]
    for _ in range(math.ceil(math.log2(max(2, state.count()))) + 1):
        if not some(state.where("next is not null")):
            return reduce(DataFrame.unionByName, taken, state.select("id", "total"))
        sent = state.where("next is not null").groupBy(F.col("next").alias("id")).agg(gather("total").alias("more"))
        far = state.select(F.col("id").alias("next"), F.col("next").alias("n2"))
        past, state = state, cut(state.join(far, "next", "left").join(sent, "id", "left").select("id", both("total", F.col("more")).alias("total"), F.col("n2").alias("next")))
        drop(past)
    out = state.select("id", F.when(F.col("next").isNull(), F.col("total")).alias("total"))
    if not levels or not some(state.where("next is not null")):
        return reduce(DataFrame.unionByName, taken, out)
    # Leaves above a cycle have null, too.
    lost = jump(steps).where("root is null").select("id", F.lit(True).alias("lost"))
    return reduce(DataFrame.unionByName, taken, out).join(lost, "id", "left").select("id", F.when(F.col("lost").isNull(), F.col("total")).alias("total"))


def fix_network_connectivity(links: DataFrame, subset: DataFrame) -> DataFrame:
    """The subset's links and those of the network on the shortest ways on from subset outlets that are no outlets of the network.

    Ways end at another node of the subset. They are found from the ends: distances to subset nodes over the
    network's links, then the best link out of each node is followed.
    """
    inner = subset.select(F.col("nodea").alias("node")).distinct()
    loose = cut(outlets(subset).join(outlets(links), "node", "left_anti"))
    steps = links.select(F.col("nodeb").alias("src"), F.col("nodea").alias("dst"), F.col("length").alias("cost"))
    ends = inner.union(outlets(links)).distinct().join(loose, "node", "left_anti")
    at = cut(relax(ends.withColumn("value", F.lit(0.0)), steps, "min"))
    far = links.join(at.select(F.col("node").alias("nodeb"), "value"), "nodeb").join(ends.select(F.col("node").alias("nodea")), "nodea", "left_anti")
    best = far.groupBy("nodea").agg(F.min_by("fid", F.struct(F.col("value") + F.col("length"), "fid")).alias("fid"))
    chosen = links.join(best.select("fid"), "fid", "left_semi")
    chosen = cut(chosen)
    nodes = closure(loose, chosen.select(F.col("nodea").alias("src"), F.col("nodeb").alias("dst")))
    added = chosen.join(nodes.select(F.col("node").alias("nodea")), "nodea", "left_semi")
    return subset.select(*links.columns).unionByName(added.select(*links.columns)).dropDuplicates(["fid"])


def fix_link_orientation(links: DataFrame, nodes: DataFrame, dry_run: bool = False) -> DataFrame:
    """Links turned downslope, with `flipped`: from-nodes are those with the higher z, ties the larger node; nodes has (node, z).

    With dry_run only the links to be turned are returned.
    """
    za, zb = nodes.select(F.col("node").alias("nodea"), F.col("z").alias("za")), nodes.select(F.col("node").alias("nodeb"), F.col("z").alias("zb"))
    both = links.join(za, "nodea", "left").join(zb, "nodeb", "left")
    flip = F.coalesce((F.col("za") < F.col("zb")) | ((F.col("za") == F.col("zb")) & (F.col("nodea") < F.col("nodeb"))), F.lit(False))
    if dry_run:
        return both.where(flip).select(*links.columns)
    cols = {"nodea": F.when(flip, F.col("nodeb")).otherwise(F.col("nodea")), "nodeb": F.when(flip, F.col("nodea")).otherwise(F.col("nodeb"))}
    if "geom" in links.columns:
        cols["geom"] = F.when(flip, F.reverse("geom")).otherwise(F.col("geom"))
    return both.select(*(cols[c].alias(c) if c in cols else c for c in links.columns), flip.cast("int").alias("flipped"))


def identify_network_nodes(lines: DataFrame, quantization: float = 1e8) -> tuple[DataFrame, DataFrame]:
    """(lines with nodea and nodeb, nodes (gid, x, y)) from end points (fid, ax, ay, bx, by_) on a grid of extent / quantization.

    gid follows first appearance: by feature, the from-end before the to-end.
    """
    ends = lines.select("fid", F.lit(0).alias("end"), F.col("ax").alias("x"), F.col("ay").alias("y")).union(lines.select("fid", F.lit(1).alias("end"), F.col("bx"), F.col("by_")))
    box = ends.agg(*(f(c).alias(f"{f.__name__}_{c}") for c in "xy" for f in (F.min, F.max)))
    step = {c: F.when(F.col(f"max_{c}") > F.col(f"min_{c}"), (F.col(f"max_{c}") - F.col(f"min_{c}")) / quantization).otherwise(1e-8) for c in "xy"}
    cells = ends.crossJoin(F.broadcast(box)).select("fid", "end", *(F.round((F.col(c) - F.col(f"min_{c}")) / step[c]).cast("long").alias(f"i{c}") for c in "xy"), *((F.round((F.col(c) - F.col(f"min_{c}")) / step[c]) * step[c] + F.col(f"min_{c}")).alias(c) for c in "xy"))
    first = cells.groupBy("ix", "iy").agg(F.min(F.struct("fid", "end")).alias("seen"), F.min("x").alias("x"), F.min("y").alias("y"))
    named = cut(numbered(first, ["seen.fid", "seen.end"]))
    both = cells.join(named.select("ix", "iy", "gid"), ["ix", "iy"]).groupBy("fid").agg(F.max(F.when(F.col("end") == 0, F.col("gid"))).alias("nodea"), F.max(F.when(F.col("end") == 1, F.col("gid"))).alias("nodeb"))
    return lines.join(both, "fid"), named.select("gid", "x", "y")


def numbered(df: DataFrame, order: list[str], name: str = "gid") -> DataFrame:
    """df with numbers from 0 in the order given, without sorting all rows in one task.

    Rows are range-partitioned and written; counts of the ranges (one row each) give the numbers' bases.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = cut(df.repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()))
    counts = parts.groupBy("__part").agg(F.count("*").alias("__n"))
    bases = counts.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__base"))
    rank = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return parts.withColumn("__rank", rank).join(F.broadcast(bases), "__part").withColumn(name, (F.col("__base") + F.col("__rank") - 1).cast("long")).drop("__part", "__rank", "__base")


def upstream_downstream_link(points: DataFrame, flow: DataFrame) -> DataFrame:
    """For points (pk, row, col) the next point's cell on their D8 flow path: pk, downid, down_row, down_col, or nulls."""
    steps = cut(grid.downstream(flow))
    at = points.select("pk", grid.cell("row", "col").alias("cell"))
    held = at.groupBy(F.col("cell").alias("id")).agg(F.min("pk").alias("holder"))
    marked = steps.join(held, "id", "left")
    root = jump(marked, stop=F.col("holder").isNotNull()).join(held.select(F.col("id").alias("root"), "holder"), "root", "left")
    first = at.join(steps.select(F.col("id").alias("cell"), "next"), "cell", "left").join(root.select(F.col("id").alias("next"), "root", "holder"), "next", "left")
    ok = F.col("holder").isNotNull()
    return first.select("pk", F.col("holder").alias("downid"), F.when(ok, grid.row_of(F.col("root"))).alias("down_row"), F.when(ok, grid.col_of(F.col("root"))).alias("down_col"))


def watershed_link(points: DataFrame, watersheds: DataFrame, flow: DataFrame) -> DataFrame:
    """For points (pk, row, col) the first watershed other than their own on the D8 path: pk, downws, down_row, down_col.

    The path is followed over exits, cells whose next cell lies in another watershed; an exit into no watershed is passed on.
    """
    ws = watersheds.where("value is not null and value <> 0").select(grid.cell("row", "col").alias("id"), F.col("value").alias("ws"))
    steps = cut(grid.downstream(flow).join(ws, "id", "left").join(ws.toDF("next", "next_ws"), "next", "left").select("id", "next", "ws", "next_ws"))
    # A cell stops where its next cell belongs to another watershed than it does itself.
    leaves = F.col("next_ws").isNotNull() & ~F.col("next_ws").eqNullSafe(F.col("ws"))
    exits = jump(steps, stop=leaves).join(steps.select(F.col("id").alias("root"), F.col("next").alias("to"), "next_ws"), "root")
    at = points.select("pk", grid.cell("row", "col").alias("id")).join(exits, "id", "left")
    ok = F.col("next_ws").isNotNull()
    return at.select("pk", F.col("next_ws").alias("downws"), F.when(ok, grid.row_of(F.col("to"))).alias("down_row"), F.when(ok, grid.col_of(F.col("to"))).alias("down_col"))


def merge_short_links(links: DataFrame, min_length: float, hack: str = "hack", axis: str = "axis") -> DataFrame:
    """Links with ugo: along each axis from its outlet upwards, links gather in a group until its length reaches min_length.

    The fold runs over an axis's links in order, one axis a row; the last group of an axis that stays short joins the one before.
    """
    links = cut(links)
    at = distance_to_outlet(links).select(F.col("node").alias("nodeb"), F.col("value").alias("at"))
    rows = links.join(at, "nodeb").groupBy(axis).agg(F.array_sort(F.collect_list(F.struct("at", "fid", "length"))).alias("parts"))
    none = F.array().cast("array<struct<fid:bigint,part:int>>")
    zero = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("part"), none.alias("out"))

    def step(acc, p):
        full = acc["sum"] >= min_length
        part = F.when(full, acc["part"] + 1).otherwise(acc["part"])
        return F.struct((F.when(full, 0.0).otherwise(acc["sum"]) + p["length"]).alias("sum"), part.alias("part"), F.array_append(acc["out"], F.struct(p["fid"].alias("fid"), part.alias("part"))).alias("out"))

    folded = rows.select(axis, F.aggregate("parts", zero, step).alias("f"))
    last = F.when((F.col("f.sum") < min_length) & (F.col("f.part") > 0), F.col("f.part") - 1).otherwise(F.col("f.part"))
    groups = folded.select(axis, last.alias("last"), F.inline("f.out")).select("fid", F.concat_ws("-", F.col(axis).cast("string"), F.least("part", "last").cast("string")).alias("ugo"))
    return links.join(groups, "fid", "left")


def _rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


def _q(name: str, make, oracle: str | None, *inputs: str, recursive: bool = False) -> None:
    QUERIES[name] = lambda spark, sf_dir: make(*(load(spark, sf_dir, i) for i in inputs))
    if oracle:
        SQL[name] = sql(oracle, *inputs, recursive=recursive)


QUERIES: dict = {}
SQL: dict = {}

_TYPE = "CASE least(din, 2) * 10 + least(dout, 2) WHEN 0 THEN 'ISOL' WHEN 1 THEN 'SRCE' WHEN 2 THEN 'DIVG' WHEN 10 THEN 'EXUT' WHEN 11 THEN 'NODE' WHEN 12 THEN 'DIFL' WHEN 20 THEN 'SINK' WHEN 21 THEN 'CONF' ELSE 'XSIN' END"
_DEG = "SELECT gid, CAST(sum(i) AS BIGINT) AS din, CAST(sum(o) AS BIGINT) AS dout FROM (SELECT nodea AS gid, 0 AS i, 1 AS o FROM {t} UNION ALL SELECT nodeb, 1, 0 FROM {t}) GROUP BY gid"
_q("network_nodes", network_nodes, f" SELECT *, {_TYPE} AS type FROM ({_DEG.format(t='links_dag')})", "links_dag")
_q("network_nodes_subset", lambda k: network_nodes(k, subset=["CONF", "DIFL"]), f" SELECT * FROM (SELECT *, {_TYPE} AS type FROM ({_DEG.format(t='links_dag')})) WHERE type IN ('CONF', 'DIFL')", "links_dag")
_q("reverse_flow_direction", lambda k: reverse_flow_direction(k), " SELECT fid, nodeb AS nodea, nodea AS nodeb, length, category FROM links", "links")
_CHAIN = """, n AS (SELECT category, node, sum(i) AS din, sum(o) AS dout FROM (SELECT category, nodea AS node, 0 AS i, 1 AS o FROM chains UNION ALL SELECT category, nodeb, 1, 0 FROM chains) GROUP BY 1, 2),
 s AS (SELECT c.fid, c.category, c.nodea, c.nodeb, c.length, c.fid AS head, 1 AS k FROM chains c LEFT JOIN n ON n.category = c.category AND n.node = c.nodea AND n.din = 1 AND n.dout = 1 WHERE n.node IS NULL
 UNION ALL SELECT c.fid, c.category, c.nodea, c.nodeb, c.length, s.head, s.k + 1 FROM s JOIN n ON n.category = s.category AND n.node = s.nodeb AND n.din = 1 AND n.dout = 1 JOIN chains c ON c.category = s.category AND c.nodea = s.nodeb)
 SELECT min(fid) AS gid, category, arg_min(nodea, k) AS nodea, arg_max(nodeb, k) AS nodeb, round(sum(length), 6) AS length, count(*) AS n_links FROM s GROUP BY head, category"""
_q("aggregate_stream_segments", lambda k: _rounded(aggregate_stream_segments(k, "category"), "length"), _CHAIN, "chains", recursive=True)
_q("aggregate_undirected_lines", lambda k: _rounded(aggregate_undirected_lines(k), "length"), " SELECT min(fid) AS gid, round(sum(length), 6) AS length, count(*) AS n_links FROM (SELECT *, fid - (row_number() OVER (ORDER BY fid)) AS g FROM chains) GROUP BY g", "chains")
_WALK = ", w AS (SELECT CAST(0 AS BIGINT) AS node, CAST(0 AS DOUBLE) AS value UNION ALL SELECT l.nodea, w.value + l.length FROM w JOIN {t} l ON l.nodeb = w.node), at AS (SELECT node, max(value) AS value FROM w GROUP BY node)"
_q("measure_network", lambda k: _rounded(measure_network(k), "measure"), _WALK.format(t="links_dag").replace("at AS", "m AS") + " SELECT l.*, round(m.value, 6) AS measure FROM links_dag l LEFT JOIN m ON m.node = l.nodeb", "links_dag", recursive=True)
_LONG = _WALK.format(t="links_dag").replace("at AS", "m AS") + """, h AS (SELECT m.node FROM m WHERE m.node NOT IN (SELECT nodeb FROM links_dag) ORDER BY m.value DESC, m.node LIMIT 1), r AS (SELECT node FROM h UNION SELECT l.nodeb FROM r JOIN links_dag l ON l.nodea = r.node)
 SELECT l.* FROM links_dag l WHERE l.nodea IN (SELECT node FROM r)"""
_q("longest_path_multiflow", lambda k: longest_path(k), _LONG, "links_dag", recursive=True)
_SINGLE = _WALK.format(t="links_dag").replace("at AS", "m AS") + """, h AS (SELECT m.node FROM m WHERE m.node NOT IN (SELECT nodeb FROM links_dag) ORDER BY m.value DESC, m.node LIMIT 1),
 b AS (SELECT l.*, row_number() OVER (PARTITION BY l.nodea ORDER BY m.value + l.length DESC, l.fid) AS rn FROM links_dag l JOIN m ON m.node = l.nodeb),
 r AS (SELECT node FROM h UNION SELECT b.nodeb FROM r JOIN b ON b.nodea = r.node AND b.rn = 1) SELECT fid, nodea, nodeb, length FROM b WHERE rn = 1 AND nodea IN (SELECT node FROM r)"""
_q("longest_path_single", lambda k: longest_path(k, False), _SINGLE, "links_dag", recursive=True)
_STEM = _WALK.format(t="links_dag").replace("max(value)", "min(value)").replace("at AS", "m AS") + " SELECT fid, nodea, nodeb, length FROM (SELECT l.*, row_number() OVER (PARTITION BY l.nodea ORDER BY m.value + l.length, l.fid) AS rn FROM links_dag l JOIN m ON m.node = l.nodeb) WHERE rn = 1"
_q("principal_stem", principal_stem, _STEM, "links_dag", recursive=True)
_SEED = "fid % 501 = 40"
_UP = f", r AS (SELECT nodea AS node FROM links_dag WHERE {_SEED} UNION SELECT l.nodea FROM r JOIN links_dag l ON l.nodeb = r.node) SELECT * FROM links_dag WHERE nodeb IN (SELECT node FROM r) OR {_SEED}"
_q("select_connected_upstream", lambda k: select_connected(k, k.where(_SEED)), _UP, "links_dag", recursive=True)
_DOWN = f", r AS (SELECT nodeb AS node FROM links_dag WHERE {_SEED} UNION SELECT l.nodeb FROM r JOIN links_dag l ON l.nodea = r.node) SELECT * FROM links_dag WHERE nodea IN (SELECT node FROM r) OR {_SEED}"
_q("select_connected_downstream", lambda k: select_connected(k, k.where(_SEED), "downstream"), _DOWN, "links_dag", recursive=True)
_q("select_connected_undirected", lambda k: select_connected(k, k.where("fid = 45"), "undirected"), " SELECT c.* FROM chains c WHERE floor(fid / 20) = 2", "chains")
_BUP = ", r AS (SELECT id AS node FROM basins WHERE is_selected UNION SELECT b.id FROM r JOIN basins b ON b.downstream = r.node) SELECT * FROM basins WHERE id IN (SELECT node FROM r)"
_q("select_connected_basins_upstream", select_connected_basins, _BUP, "basins", recursive=True)
_BDN = ", r AS (SELECT id AS node FROM basins WHERE is_selected UNION SELECT b.downstream FROM r JOIN basins b ON b.id = r.node WHERE b.downstream IS NOT NULL) SELECT * FROM basins WHERE id IN (SELECT node FROM r)"
_q("select_connected_basins_downstream", lambda b: select_connected_basins(b, "downstream"), _BDN, "basins", recursive=True)
_q("select_headwater_basins", select_headwater_basins, " SELECT b.* FROM basins b WHERE downstream IS NOT NULL AND id NOT IN (SELECT downstream FROM basins WHERE downstream IS NOT NULL)", "basins")
_CYC = """, u AS (SELECT nodea AS low, nodeb AS node FROM links_cycle WHERE fid >= 10000000 UNION ALL SELECT u.low, CAST(floor(u.node / 2) AS BIGINT) FROM u WHERE u.node > u.low)
 SELECT * FROM links_cycle WHERE (fid < 10000000 AND (nodea, nodeb) IN (SELECT node, CAST(floor(node / 2) AS BIGINT) FROM u WHERE node > low)) OR fid >= 10000000"""
_q("select_graph_cycle", select_graph_cycle, _CYC, "links_cycle", recursive=True)
QUERIES["fix_network_cycles"] = lambda spark, sf_dir: fix_network_cycles(load(spark, sf_dir, "links_cycle"))
_STRAHLER = """, n AS (SELECT fid, nodea AS k, length(bin(nodea)) AS lvl FROM links), t AS (SELECT max(lvl) AS top FROM n),
 s AS (SELECT k, lvl, 1 AS o FROM n, t WHERE lvl = top UNION ALL
 SELECT p.k, p.lvl, CASE WHEN max(c.o) IS NULL THEN 1 WHEN count(c.o) = 2 AND max(c.o) = min(c.o) THEN max(c.o) + 1 ELSE max(c.o) END FROM n p JOIN (SELECT DISTINCT lvl AS done FROM s) d ON p.lvl = d.done - 1 LEFT JOIN s c ON c.k // 2 = p.k GROUP BY p.k, p.lvl)
 SELECT l.*, s.o AS strahler FROM links l JOIN s ON s.k = l.nodea"""
_q("strahler_order", lambda k: strahler_order(k), _STRAHLER, "links", recursive=True)
_q("total_upstream_channel_length", lambda k: _rounded(total_upstream_channel_length(k), "tucl", digits=6), """, a AS (SELECT nodea AS node, nodeb AS above_of, length FROM links UNION ALL SELECT a.node, CAST(floor(a.above_of / 2) AS BIGINT), a.length FROM a WHERE a.above_of > 0),
 s AS (SELECT above_of AS node, sum(length) AS total FROM a GROUP BY 1) SELECT l.*, round((coalesce(s.total, 0) + l.length) * 0.001, 6) AS tucl FROM links l LEFT JOIN s ON s.node = l.nodea""", "links", recursive=True)
_HACK = """, w AS (SELECT nodea AS k, nodea AS below FROM links UNION ALL SELECT k, below // 2 FROM w WHERE below > 1),
 da AS (SELECT w.k, sum(l.length) AS da FROM w JOIN links l ON l.nodea = w.below GROUP BY w.k), leaf AS (SELECT k, da FROM da WHERE k NOT IN (SELECT nodeb FROM links)),
 reach AS (SELECT w.below AS k, max(leaf.da) AS reach FROM w JOIN leaf ON leaf.k = w.k GROUP BY w.below),
 r AS (SELECT l.fid, l.nodea, l.nodeb, l.length, row_number() OVER (PARTITION BY l.nodeb ORDER BY reach.reach DESC, l.fid) = 1 AS main FROM links l JOIN reach ON reach.k = l.nodea),
 x AS (SELECT nodea, nodeb, main, fid AS axis FROM r WHERE nodea IN (SELECT k FROM leaf) UNION ALL SELECT r.nodea, r.nodeb, r.main, x.axis FROM x JOIN r ON r.nodea = x.nodeb WHERE x.main),
 h AS (SELECT x.nodea, x.axis, 1 AS hack FROM x WHERE x.nodeb = 0 UNION ALL SELECT x.nodea, x.axis, h.hack + CASE WHEN x.axis = h.axis THEN 0 ELSE 1 END FROM h JOIN x ON x.nodeb = h.nodea),
 la AS (SELECT x.axis, sum(r.length) AS laxis FROM x JOIN r ON r.nodea = x.nodea GROUP BY x.axis)
 SELECT l.*, x.axis, h.hack, round(la.laxis, 6) AS laxis FROM links l JOIN x ON x.nodea = l.nodea JOIN h ON h.nodea = l.nodea JOIN la ON la.axis = x.axis"""
_q("hack_order", lambda k: _rounded(hack_order(k), "laxis"), _HACK, "links", recursive=True)
_q("merge_short_links", lambda k: merge_short_links(hack_order(k), 500.0).select("fid", "axis", "ugo"), None, "links")
_JOINED = """, sub AS (SELECT * FROM links_dag WHERE fid >= 10000000 OR fid % 5 <> 1), lo AS (SELECT DISTINCT nodeb AS node FROM sub WHERE nodeb NOT IN (SELECT nodea FROM sub) AND nodeb IN (SELECT nodea FROM links_dag)),
 en AS (SELECT nodea AS node FROM sub UNION SELECT nodeb FROM links_dag WHERE nodeb NOT IN (SELECT nodea FROM links_dag)), p AS (SELECT node AS start, node, 0e0 AS dist, []::BIGINT[] AS way FROM lo UNION ALL
 SELECT p.start, l.nodeb, p.dist + l.length, list_append(p.way, l.fid) FROM p JOIN links_dag l ON l.nodea = p.node WHERE p.node NOT IN (SELECT node FROM en)), b AS (SELECT start, arg_min(way, dist) AS way FROM p WHERE node IN (SELECT node FROM en) GROUP BY start)
 SELECT * FROM sub UNION SELECT l.* FROM links_dag l WHERE l.fid IN (SELECT unnest(way) FROM b)"""
_q("fix_network_connectivity", lambda k: fix_network_connectivity(k, k.where("fid >= 10000000 or fid % 5 <> 1")), _JOINED, "links_dag", recursive=True)
_q("identify_network_nodes", lambda k: identify_network_nodes(k)[0].select("fid", "nodea", "nodeb"), """, e AS (SELECT fid, 0 AS e, ax AS x, ay AS y FROM lines UNION ALL SELECT fid, 1, bx, by_ FROM lines), f AS (SELECT x, y, min(fid * 2 + e) AS seen FROM e GROUP BY x, y),
 g AS (SELECT x, y, row_number() OVER (ORDER BY seen) - 1 AS gid FROM f) SELECT l.fid, a.gid AS nodea, b.gid AS nodeb FROM lines l JOIN g a ON a.x = l.ax AND a.y = l.ay JOIN g b ON b.x = l.bx AND b.y = l.by_""", "lines")
QUERIES["fix_link_orientation"] = lambda spark, sf_dir: (lambda k: fix_link_orientation(k, k.select(F.col("nodea").alias("id")).union(k.select("nodeb")).distinct().selectExpr("id node", "id * 37 % 101 z")))(load(spark, sf_dir, "links"))
SQL["fix_link_orientation"] = sql(" SELECT fid, CASE WHEN flip THEN nodeb ELSE nodea END AS nodea, CASE WHEN flip THEN nodea ELSE nodeb END AS nodeb, length, category, CAST(flip AS INT) AS flipped FROM (SELECT *, nodea * 37 % 101 < nodeb * 37 % 101 OR (nodea * 37 % 101 = nodeb * 37 % 101 AND nodea < nodeb) AS flip FROM links)", "links")

_NEXT = "row + CASE WHEN d8 IN (8, 16) THEN 1 ELSE 0 END AS nrow, col + CASE WHEN d8 IN (4, 8) THEN 1 ELSE 0 END AS ncol"
_TRACE = f""", g AS (SELECT *, {_NEXT} FROM flow), st AS (SELECT g.row, g.col, CASE WHEN g.d8 > 0 AND t.d8 >= 0 THEN t.row END AS nrow, CASE WHEN g.d8 > 0 AND t.d8 >= 0 THEN t.col END AS ncol FROM g LEFT JOIN flow t ON t.row = g.nrow AND t.col = g.ncol)"""
_PTS = "SELECT CAST(row * 1000 + col AS BIGINT) AS pk, row, col FROM flow WHERE (row * 50 + col) % 37 = 5"
_q("upstream_downstream_link", lambda f: upstream_downstream_link(f.where("(row * 50 + col) % 37 = 5").selectExpr("bigint(row * 1000 + col) pk", "row", "col"), f), _TRACE + f""", p AS ({_PTS}),
 w AS (SELECT p.pk, st.nrow AS r, st.ncol AS c FROM p JOIN st ON st.row = p.row AND st.col = p.col UNION ALL SELECT w.pk, st.nrow, st.ncol FROM w JOIN st ON st.row = w.r AND st.col = w.c WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.row = w.r AND p.col = w.c))
 SELECT p.pk, q.pk AS downid, q.row AS down_row, q.col AS down_col FROM p LEFT JOIN (SELECT w.pk AS of_pk, p2.* FROM w JOIN p p2 ON p2.row = w.r AND p2.col = w.c) q ON q.of_pk = p.pk""", "flow", recursive=True)
_q("watershed_link", lambda f: watershed_link(f.where("(row * 50 + col) % 37 = 5").selectExpr("bigint(row * 1000 + col) pk", "row", "col"), f.selectExpr("row", "col", "int(floor(row / 7)) * 100 + int(floor(col / 9)) + 1 value"), f), _TRACE + f""", p AS ({_PTS}), ws AS (SELECT row, col, floor(row / 7) * 100 + floor(col / 9) + 1 AS v FROM flow),
 w AS (SELECT p.pk, v AS own, st.nrow AS r, st.ncol AS c FROM p JOIN st ON st.row = p.row AND st.col = p.col JOIN ws ON ws.row = p.row AND ws.col = p.col UNION ALL SELECT w.pk, w.own, st.nrow, st.ncol FROM w JOIN st ON st.row = w.r AND st.col = w.c JOIN ws ON ws.row = w.r AND ws.col = w.c WHERE ws.v = w.own)
 SELECT p.pk, q.downws, q.down_row, q.down_col FROM p LEFT JOIN (SELECT w.pk, CAST(ws.v AS INT) AS downws, w.r AS down_row, w.c AS down_col FROM w JOIN ws ON ws.row = w.r AND ws.col = w.c WHERE ws.v <> w.own) q ON q.pk = p.pk""", "flow", recursive=True)
