"""Axes of measured networks, and lines connected to nodes that they pass."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..plans.iterate import LIGHT, cut, drop, some
from ..plans.spatial_join import candidates, placed
from ..sources.derived import load, sql
from .network import numbered
from .vector import to_lines, to_segments


def running_sum(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """df with the sum of value over all rows before each in the order given, summed range by range."""
    ranked = cut(numbered(df, order, "__place").withColumn("__range", F.floor(F.col("__place") / 4096)))
    sums = ranked.groupBy("__range").agg(F.sum(value).alias("__sum"))
    # The sums of 4,096 rows each are added up once more, so the last window holds a four-thousandth of the rows.
    bases = sums.select("__range", F.coalesce(F.sum("__sum").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__base"))
    inner = F.coalesce(F.sum(value).over(Window.partitionBy("__range").orderBy("__place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranked.withColumn("__inner", inner).join(bases, "__range").withColumn(name, F.col("__base") + F.col("__inner")).drop("__place", "__range", "__base", "__inner")


def levelled(links: DataFrame) -> tuple[DataFrame, list[int], bool]:
    """(links with level and to_level, the largest to_level of each level, whether the last level holds cycles).

    A node's level is the number of links on the longest way down to it, to_level that of nodeb, null where no link
    leaves it. Nodes that no link enters are taken off with their links level by level, so what is written is a
    multiple of the links in a network that branches. Cycles, and what is below them, stay and are the last level.
    """
    held = rest = cut(links.where("nodea is not null"))
    n, parts, loops = rest.count(), [], False
    while n or not parts:
        entered = rest.select(F.col("nodeb").alias("nodea"), F.lit(True).alias("held")).distinct()
        level = cut(rest.join(entered, "nodea", "left"))
        taken, n = n, level.where("held").count()
        loops = 0 < n == taken
        if loops:
            parts.append((level, level.where("held").drop("held")))
            break
        parts.append((level, level.where("held is null").drop("held")))
        rest = level.where("held").drop("held")
    rows = reduce(DataFrame.unionByName, (part.withColumn("level", F.lit(k)) for k, (_, part) in enumerate(parts)))
    nodes = rows.groupBy(F.col("nodea").alias("nodeb")).agg(F.min("level").alias("to_level"))
    out = cut(rows.join(nodes, "nodeb", "left").sortWithinPartitions("level"))
    drop(held, *(level for level, _ in parts))
    reach = {r.level: r.to for r in out.groupBy("level").agg(F.max("to_level").alias("to")).collect()}
    return out, [-1 if reach.get(k) is None else reach[k] for k in range(len(parts))], loops


def update_axis(links: DataFrame) -> DataFrame:
    """(fid, source, axis, laxis, main) for links (fid, nodea, nodeb, hack, measure, length).

    A source is a node that no link of its own order enters, its order being the least hack about it. From every
    source links of that order or a higher number are followed down; its axis ends at the nearest node where a
    link of a lower number goes out, or none does. Links on the shortest way there are main (ties: the smaller end,
    then the smaller fid at each node from the source on). Axes are numbered by order, then by the source's measure
    from above (ties: the node); links beside the way take the number after it. A link that several sources reach has
    a row for each. Cycles may be reached; an axis without an end has a null length.

    What is below a node is the same for all sources of an order. So ends and ways are worked out for each node and
    order that reaches it, level by level from below, and rows of sources then pass each level once, from above.
    """
    links = cut(links.select("fid", "nodea", "nodeb", "hack", F.col("length").cast("double").alias("length"), (F.col("measure") + F.col("length")).alias("from")))
    about = links.select(F.col("nodea").alias("node"), "hack").union(links.select("nodeb", "hack"))
    order = about.groupBy("node").agg(F.min("hack").alias("order"))
    entered = links.select(F.col("nodeb").alias("node"), F.col("hack").alias("order")).distinct()
    flow, reach, loops = levelled(links)
    top = flow.groupBy(F.col("nodea").alias("node")).agg(F.max_by("from", "fid").alias("from"), F.min("level").alias("level"))
    sources = cut(order.where("order is not null").join(entered, ["node", "order"], "left_anti").join(top, "node").select("node", "order", F.lit(True).alias("source"), "from", "level").sortWithinPartitions("level"))
    last = len(reach) - 1
    # Pairs of nodes and orders that reach them, with the links on from there.
    arcs: list[DataFrame] = []
    for k in range(last + 1):
        came = [arcs[j].where(f"ok and to_level = {k}").select(F.col("to").alias("node"), "order").distinct() for j in range(k) if reach[j] >= k]
        pairs = sources.where(f"level = {k}").drop("level")
        step = flow.where(f"level = {k}").select(F.col("nodea").alias("node"), "fid", F.col("nodeb").alias("to"), "to_level", "hack", "length")
        if loops and k == last:
            came = [_closed(reduce(DataFrame.union, came, pairs.select("node", "order")).distinct(), step)]
        if came:
            blank = [F.lit(False).alias("source"), F.lit(None).cast(dict(pairs.dtypes)["from"]).alias("from")]
            pairs = reduce(DataFrame.unionByName, (c.select("node", "order", *blank) for c in came), pairs).groupBy("node", "order").agg(F.max("source").alias("source"), F.max("from").alias("from"))
        arcs.append(cut(pairs.join(step, "node").withColumn("ok", F.coalesce(F.col("hack") >= F.col("order"), F.lit(False)))))
    ways: list[DataFrame] = [None] * (last + 1)
    for k in range(last, -1, -1):
        if loops and k == last:
            ways[k] = _ways_in_loops(arcs[k])
            continue
        below = [ways[j].select(F.col("node").alias("to"), "order", "dist", "end", "more", "found") for j in range(k + 1, reach[k] + 1)]
        ways[k] = cut(_ways(arcs[k], reduce(DataFrame.union, below) if below else None))
    drop(*arcs)
    ends = reduce(DataFrame.union, (w.where("source and n > 0").select(F.col("node").alias("source"), "order", "from", "dist", "more") for w in ways))
    ranked = ends.select("source", "order", (-F.col("from")).alias("__from"), F.col("dist").alias("laxis"), (F.col("more").cast("long") + 1).alias("taken"))
    named = cut(running_sum(ranked, ["order", "__from", "source"], "taken", "earlier").select("source", "earlier", "laxis"))
    rows: list[DataFrame] = []
    for k in range(last + 1):
        state = ways[k].where("source and n > 0").select(F.col("node").alias("source"), "node", "order", F.col("found").alias("main"), F.lit(False).alias("split"))
        came = [rows[j].where(f"to_level = {k}").select("source", F.col("to").alias("node"), "order", "main", "split") for j in range(k) if reach[j] >= k]
        if came:
            both = reduce(DataFrame.union, came)
            # Only what has parted can meet again.
            met = both.where("split").groupBy("source", "node", "order").agg(F.max("main").alias("main")).withColumn("split", F.lit(True))
            state = state.union(both.where("not split")).union(met)
        if loops and k == last:
            rows.append(_rows_in_loops(state, ways[k]))
        else:
            rows.append(cut(_onward(state, ways[k])))
    drop(*ways, sources, flow)
    out = reduce(DataFrame.union, (r.select("source", "fid", "main") for r in rows))
    # The smaller table is hashed, so that the rows aren't sorted.
    out = out.join(named.hint("shuffle_hash"), "source")
    main = F.col("main").cast("int")
    return out.select("fid", "source", (F.col("earlier") + 2 - main).alias("axis"), "laxis", main.alias("main"))


def _ways(arcs: DataFrame, below: DataFrame | None) -> DataFrame:
    """For each node and order the nearest end's distance, the end, the first link there (best), whether links lie beside the way, and the links on."""
    if below is None:
        below = arcs.select("to", "order", F.lit(0.0).alias("dist"), F.col("to").alias("end"), F.lit(False).alias("more"), F.lit(False).alias("found")).limit(0)
    far = arcs.join(below, ["to", "order"], "left")
    way = F.when(F.col("ok") & F.col("to_level").isNull(), F.struct(F.col("length").alias("dist"), F.col("to").alias("end"), "fid", F.lit(False).alias("more")))
    way = way.when(F.col("ok") & F.col("found"), F.struct((F.col("length") + F.col("dist")).alias("dist"), "end", "fid", "more"))
    out = far.groupBy("node", "order").agg(
        F.min(way).alias("way"), F.coalesce(F.max(F.col("hack") < F.col("order")), F.lit(True)).alias("ended"), F.count_if("ok").alias("n"),
        F.collect_list(F.when(F.col("ok"), F.struct("fid", "to", "to_level"))).alias("on"), F.max("source").alias("source"), F.max("from").alias("from"),
    )
    here = F.when(F.col("ended"), F.struct(F.lit(0.0).alias("dist"), F.col("node").alias("end"), F.lit(None).cast(dict(arcs.dtypes)["fid"]).alias("fid"), F.lit(False).alias("more")))
    out = out.withColumn("way", F.least("way", here))
    beside = F.when(F.col("way.fid").isNull(), F.col("n") > 0).otherwise((F.col("n") > 1) | F.col("way.more"))
    return out.select("node", "order", "way.dist", "way.end", F.col("way.fid").alias("best"), beside.alias("more"), F.col("way").isNotNull().alias("found"), "n", "on", "source", "from")


def _onward(state: DataFrame, ways: DataFrame) -> DataFrame:
    """The links on from the nodes of state (source, node, order, main, split), a row for each source."""
    on = ways.select("node", "order", "best", "on")
    went = state.join(F.broadcast(on) if ways in LIGHT else on, ["node", "order"])
    went = went.select("source", "order", "main", "best", (F.col("split") | (F.size("on") > 1)).alias("split"), F.explode("on").alias("on"))
    return went.select("source", "order", "on.*", F.coalesce(F.col("main") & (F.col("on.fid") == F.col("best")), F.lit(False)).alias("main"), "split")


def _closed(pairs: DataFrame, step: DataFrame) -> DataFrame:
    """pairs (node, order) and those that links of the order or a higher number reach from them; rounds are the links of the longest way."""
    seen = frontier = cut(pairs)
    while some(frontier):
        ahead = frontier.join(step, "node").where("hack >= order and to_level is not null").select(F.col("to").alias("node"), "order").distinct()
        frontier = cut(ahead.join(seen, ["node", "order"], "left_anti"))
        past, seen = seen, cut(seen.union(frontier))
        drop(past)
    return seen


def _ways_in_loops(arcs: DataFrame) -> DataFrame:
    """_ways where links may lead back: only what gets nearer changes its way, so that ways don't run in circles."""
    low = lambda c: F.struct(F.col(f"{c}dist"), F.col(f"{c}end"))
    at = cut(_ways(arcs, None))
    while True:
        new = _ways(arcs, at.select(F.col("node").alias("to"), "order", "dist", "end", "more", "found")).select("node", "order", *(F.col(c).alias(f"new_{c}") for c in ("dist", "end", "best", "found")))
        nearer = F.col("new_found") & (~F.col("found") | F.coalesce(low("new_") < low(""), F.lit(False)))
        names = ("dist", "end", "best", "found")
        moved = at.join(new, ["node", "order"]).withColumn("moved", nearer)
        after = cut(moved.select("node", "order", *(F.when(F.col("moved"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in names), "more", "n", "on", "source", "from", "moved"))
        drop(at)
        at = after.drop("moved")
        if not some(after.where("moved")):
            break
        at = cut(at)
        drop(after)
    at = cut(at.withColumn("more", F.when(F.col("best").isNull(), F.col("n") > 0).otherwise(F.col("n") > 1)))
    drop(after)
    nexts = arcs.where("ok").select("node", "order", F.col("fid").alias("best"), "to")
    while True:
        ahead = at.join(nexts, ["node", "order", "best"]).select("node", "order", F.col("to"))
        sent = ahead.join(at.where("more").select(F.col("node").alias("to"), "order"), ["to", "order"]).select("node", "order", F.lit(True).alias("sent")).distinct()
        after = cut(at.join(sent, ["node", "order"], "left").withColumn("moved", ~F.col("more") & F.col("sent").isNotNull()).withColumn("more", F.col("more") | F.col("moved")).drop("sent"))
        drop(at)
        at = after.drop("moved")
        if not some(after.where("moved")):
            return after
        at = cut(at)
        drop(after)


def _rows_in_loops(state: DataFrame, ways: DataFrame) -> DataFrame:
    """_onward until nothing new is reached; a link on the main way is main, however it is reached besides."""
    keys = ["source", "node", "order", "main"]
    seen = frontier = cut(state.select(*keys, F.lit(False).alias("split")).distinct())
    found = []
    while some(frontier):
        found.append(cut(_onward(frontier, ways)))
        ahead = found[-1].where("to_level is not null").select("source", F.col("to").alias("node"), "order", "main").distinct()
        frontier = cut(ahead.join(seen, keys, "left_anti").withColumn("split", F.lit(False)))
        past, seen = seen, cut(seen.union(frontier))
        drop(past)
    names = ["source", "order", "fid", "to", "to_level"]
    empty = _onward(seen.limit(0), ways)
    out = cut(reduce(DataFrame.union, found, empty).groupBy(*names).agg(F.max("main").alias("main")).withColumn("split", F.lit(False)))
    drop(*found, seen)
    return out


def connect_lines(lines: DataFrame, distance: float) -> DataFrame:
    """(fid, kind, part, nodea, nodeb, geom): lines (fid, nodea, nodeb, geom) split where nodes of other lines are near, and connectors.

    A node snaps to the nearest line within distance that it doesn't end (ties: the smaller fid, the earlier
    segment). Lines are split at these places in their order along the line, except at their first vertex; each
    place gets a new node number, counted on from the largest by line and place, and a connector from the node
    where they are apart. A piece ends at the new node and the next one starts at the node that snapped; a place
    at the last vertex leaves no further piece. A node stands where its first line has it.
    """
    last = F.element_at("geom", -1)
    ends = lines.select("fid", F.explode(F.array(F.struct(F.lit(0).alias("end"), F.col("nodea").alias("node"), F.element_at("geom", 1)["x"].alias("x"), F.element_at("geom", 1)["y"].alias("y")), F.struct(F.lit(1).alias("end"), F.col("nodeb").alias("node"), last["x"].alias("x"), last["y"].alias("y")))).alias("e")).select("fid", "e.*")
    nodes = cut(ends.groupBy("node").agg(F.min_by(F.struct("x", "y"), F.struct("fid", "end")).alias("p"), F.countDistinct("fid").alias("lines")).select("node", "p.*", "lines"))
    segs = to_segments(lines).select("fid", "nodea", "nodeb", "at", "ax", "ay", "bx", "by_").where("nodea is not null and nodeb is not null")
    # The nearest line that a node doesn't end is among one more than it ends; nodes go by that number, to the power of two.
    class_ = F.ceil(F.log2("lines")).cast("int")
    near = None
    for row in nodes.where("node is not null").select(class_.alias("c")).distinct().collect():
        found = candidates(nodes.where((class_ == row.c) & F.col("node").isNotNull()).select("node", "x", "y"), segs, "fid", 2**row.c + 1, distance)
        if found is not None:
            each = found.select("node", "x", "y", F.explode("segs").alias("s")).select("node", "x", "y", "s.*").where("node <> nodea and node <> nodeb")
            near = each if near is None else near.unionByName(each)
    near = placed(nodes.select("node", "x", "y").crossJoin(segs).limit(0) if near is None else near).where(F.col("dist") <= distance)
    best = near.groupBy("node").agg(F.min_by(F.struct("x", "y", "fid", "at", "t", "px", "py", "dist"), F.struct("dist", "fid", "at")).alias("r")).select("node", "r.*")
    largest = nodes.agg(F.max("node").alias("largest"))
    snaps = cut(numbered(cut(best), ["fid", "at", "t", "node"], "rank").crossJoin(F.broadcast(largest)).withColumn("new", F.col("largest") + 1 + F.col("rank")))  # one row
    point = lambda x, y: g.vertex(x, y)
    links = snaps.where("dist > 0").select("fid", F.lit("connector").alias("kind"), F.col("rank").alias("part"), F.col("node").alias("nodea"), F.col("new").alias("nodeb"), F.array(point("x", "y"), point("px", "py")).alias("geom"))
    cuts = snaps.where("not (at = 0 and t = 0)").groupBy("fid").agg(F.array_sort(F.collect_list(F.struct("at", "t", "node", "new", "px", "py"))).alias("cuts"))
    split = lines.join(cuts, "fid")
    n = F.size("geom")
    piece = F.posexplode(F.concat("cuts", F.array(F.lit(None).cast(dict(cuts.dtypes)["cuts"][6:-1])))).alias("part", "c")
    rows = split.select("*", piece).withColumn("before", F.get("cuts", F.col("part") - 1))
    # A place at a segment's end is the start of the next one.
    at = F.coalesce(F.when(F.col("before.t") == 1, F.col("before.at") + 1).otherwise(F.col("before.at")), F.lit(0))
    head = F.when(F.col("before").isNull(), F.element_at("geom", 1)).otherwise(point("before.px", "before.py"))
    until = F.coalesce("c.at", n - 2)
    tail = F.when(F.col("c").isNull(), last).otherwise(point("c.px", "c.py"))
    inner = F.slice("geom", at + 2, F.greatest(until - at, F.lit(0)))
    rows = rows.where("c is not null or before is null or not (before.t = 1 and before.at = size(geom) - 2)")
    pieces = rows.select("fid", F.lit("piece").alias("kind"), F.col("part").cast("long").alias("part"), F.coalesce("before.node", "nodea").alias("nodea"), F.coalesce("c.new", "nodeb").alias("nodeb"), F.concat(F.array(head), inner, F.array(tail)).alias("geom"))
    # A line that nodes only join at its first vertex stays whole.
    whole = lines.join(cuts.select("fid"), "fid", "left_anti").select("fid", F.lit("line").alias("kind"), F.lit(0).cast("long").alias("part"), "nodea", "nodeb", "geom")
    return whole.unionByName(pieces).unionByName(links)


QUERIES: dict = {}
SQL: dict = {}


def _q(name: str, make, oracle: str, *inputs: str, recursive: bool = False) -> None:
    QUERIES[name] = lambda spark, sf_dir: make(*(load(spark, sf_dir, i) for i in inputs))
    SQL[name] = sql(oracle, *inputs, recursive=recursive)


# Axes of the tree with further links: hack and measure from the node numbers, so that orders and ends vary.
_HACKED = "SELECT fid, nodea, nodeb, length, 1 + nodea * 7 % 5 + CAST(nodea % 64 = 63 AS INT) AS hack, nodea * 31 % 1009 + 5e-1 AS measure FROM links_dag WHERE nodea > 3"
_AXIS = f""", k AS ({_HACKED}), o AS (SELECT node, min(hack) AS ord FROM (SELECT nodea AS node, hack FROM k UNION ALL SELECT nodeb, hack FROM k) GROUP BY node),
 s AS (SELECT o.node AS source, ord, (SELECT arg_max(measure + length, fid) FROM k WHERE k.nodea = o.node) AS top FROM o WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.nodeb = o.node AND k.hack = o.ord) AND EXISTS (SELECT 1 FROM k WHERE k.nodea = o.node)),
 w AS (SELECT source, ord, source AS node, 0e0 AS dist, [0::BIGINT] AS way FROM s UNION ALL SELECT w.source, w.ord, k.nodeb, w.dist + k.length, list_append(w.way, k.fid) FROM w JOIN k ON k.nodea = w.node AND k.hack >= w.ord),
 e AS (SELECT source, arg_min(way, [dist, node]) AS way, min(dist) AS laxis FROM w LEFT JOIN (SELECT nodea, min(hack) AS low FROM k GROUP BY nodea) l ON l.nodea = w.node WHERE low IS NULL OR low < ord GROUP BY source),
 f AS (SELECT DISTINCT w.source, k.fid FROM w JOIN k ON k.nodea = w.node AND k.hack >= w.ord), m AS (SELECT f.*, CAST(list_contains(e.way, f.fid) AS INT) AS main, e.laxis FROM f JOIN e ON e.source = f.source),
 r AS (SELECT s.source, coalesce(sum(1 + more) OVER (ORDER BY ord, top DESC, s.source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier FROM s JOIN (SELECT source, 1 - min(main) AS more FROM m GROUP BY source) x ON x.source = s.source)
 SELECT fid, m.source, CAST(earlier + 2 - main AS BIGINT) AS axis, round(laxis, 6) AS laxis, main FROM m JOIN r ON r.source = m.source"""
_q("update_axis", lambda k: update_axis(k.where("nodea > 3").selectExpr("fid", "nodea", "nodeb", "length", "1 + nodea * 7 % 5 + int(nodea % 64 = 63) hack", "nodea * 31 % 1009 + 0.5D measure")).withColumn("laxis", F.round("laxis", 6)), _AXIS, "links_dag", recursive=True)
# Lines of two vertices, so that a place on a line is its fraction.
_SNAP = """, l AS (SELECT fid, fid * 2 + 1 AS nodea, fid * 2 + 2 AS nodeb, ax, ay, bx, by_ FROM segs), n AS (SELECT nodea AS node, ax AS x, ay AS y FROM l UNION ALL SELECT nodeb, bx, by_ FROM l),
 p AS (SELECT node, x, y, l.*, greatest(0, least(1, ((x - ax) * (bx - ax) + (y - ay) * (by_ - ay)) / ((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)))) AS t FROM n JOIN l ON node <> nodea AND node <> nodeb),
 d AS (SELECT *, sqrt(pow(ax + (bx - ax) * t - x, 2) + pow(ay + (by_ - ay) * t - y, 2)) AS dist FROM p), b AS (SELECT * FROM d WHERE dist <= 60 QUALIFY row_number() OVER (PARTITION BY node ORDER BY dist, fid) = 1),
 s AS (SELECT *, row_number() OVER (ORDER BY fid, t, node) - 1 AS rank, (SELECT max(node) FROM n) + row_number() OVER (ORDER BY fid, t, node) AS new FROM b), c AS (SELECT *, row_number() OVER (PARTITION BY fid ORDER BY t, node) - 1 AS part FROM s WHERE t > 0),
 pc AS (SELECT fid, part, coalesce(lag(node) OVER w, nodea) AS nodea, new AS nodeb, (t - coalesce(lag(t) OVER w, 0)) * sqrt(pow(bx - ax, 2) + pow(by_ - ay, 2)) AS length FROM c WINDOW w AS (PARTITION BY fid ORDER BY part)
   UNION ALL SELECT fid, part + 1, node, nodeb, (1 - t) * sqrt(pow(bx - ax, 2) + pow(by_ - ay, 2)) FROM (SELECT * FROM c QUALIFY part = max(part) OVER (PARTITION BY fid)) WHERE t < 1)
 SELECT fid, 'line' AS kind, 0 AS part, nodea, nodeb, round(sqrt(pow(bx - ax, 2) + pow(by_ - ay, 2)), 6) AS length FROM l WHERE fid NOT IN (SELECT fid FROM c) UNION ALL SELECT fid, 'piece', part, nodea, nodeb, round(length, 6) FROM pc UNION ALL SELECT fid, 'connector', rank, node, new, round(dist, 6) FROM s WHERE dist > 0"""
_two = lambda s: to_lines(s.select("fid", F.explode(F.expr("array(struct(1 pos, ax x, ay y), struct(2 pos, bx x, by_ y))")).alias("v")).select("fid", "v.*")).select("fid", (F.col("fid") * 2 + 1).alias("nodea"), (F.col("fid") * 2 + 2).alias("nodeb"), "geom")
_q("connect_lines", lambda s: connect_lines(_two(s), 60.0).select("fid", "kind", "part", "nodea", "nodeb", F.round(g.length(F.col("geom")), 6).alias("length")), _SNAP, "segs")
