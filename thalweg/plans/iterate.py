"""Plans that need rounds: reachability, relaxation, pointer jumping and components.

Every round is a join and an aggregate over DataFrames; `cut` writes its result to the folder that
spark.checkpoint.dir names, so that plans stay short and executors may be lost. Once a round is written, `drop`
deletes the tables of the round before, which nothing reads any more: what is kept does not grow with the rounds.
"""

from __future__ import annotations

import math
import re
import tempfile
import uuid
from collections.abc import Callable
from weakref import WeakKeyDictionary, WeakSet

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: The folder of each table that `cut` returned.
FOLDERS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()

#: Tables that `cut` returned and that are small enough to be sent.
LIGHT: WeakSet[DataFrame] = WeakSet()


#: Bytes of a written table above which it isn't broadcast.
SENT = 1 << 18


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="thalweg-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    # What is small as a file may be large as a hash table, and a round's tables would all go through the driver.
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength() > SENT:
        out = out.hint("merge")
    else:
        LIGHT.add(out)
    FOLDERS[out] = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes the folders of tables that `cut` returned and no pending result reads; other tables are left alone."""
    for path in {FOLDERS.pop(t) for t in tables if t in FOLDERS}:
        spark = tables[0].sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def some(df: DataFrame) -> bool:
    return bool(df.limit(1).count())


def light(df: DataFrame) -> DataFrame:
    """df, sent to the other table's rows if it is small: those aren't shuffled for a round that a few rows take part in."""
    return F.broadcast(df) if df in LIGHT else df


#: Rows up to which rounds take all rows with them.
FEW = 1 << 16


def shed(rows: DataFrame, passed: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> tuple[DataFrame, list[DataFrame]]:
    """(what is left, levels): rows (id, next, ...) without leaves, ids that no row has for its next, taken off level by level.

    Goes on while more than FEW rows are left and a quarter of them was taken, so that what is written and shuffled is
    a multiple of the rows, whatever the levels. Each level is a written table with `leaf`; passed(rest, leaves) hands on to what is
    left what the leaves hold. rows, a table that `cut` returned, is deleted if levels come of it.
    """
    rest = held = rows
    levels, n = [], rows.count()
    while n > FEW:
        ahead = held.where("next is not null").select(F.col("next").alias("id"), F.lit(False).alias("leaf")).distinct()
        level = cut(rest.join(ahead, "id", "left").withColumn("leaf", F.coalesce("leaf", F.lit(True))))
        drop(rows)
        levels.append(level)
        held = level.where("not leaf").drop("leaf")
        rest = held if passed is None else passed(held, level.where("leaf").drop("leaf"))
        taken, n = n, held.count()
        if 4 * (taken - n) < taken:
            break
    return rest, levels


def closure(seeds: DataFrame, steps: DataFrame) -> DataFrame:
    """The nodes that steps (src, dst) reach from seeds (node), seeds included. Cycles are allowed.

    What isn't reached after PATIENCE rounds is found by pointer jumping where steps are a tree's: every node is
    entered by one step, or left by one. Elsewhere rounds are the steps of the longest way.
    """
    seen = frontier = cut(seeds.select("node").distinct())
    rounds = 0
    while True:
        ahead = steps.join(light(frontier), steps.src == frontier.node).select(F.col("dst").alias("node")).distinct()
        frontier = cut(ahead.join(seen, "node", "left_anti"))
        if not some(frontier):
            return seen
        seen = seen.union(frontier)
        rounds += 1
        if rounds == PATIENCE:
            many = lambda c: some(steps.select("src", "dst").distinct().groupBy(c).agg(F.count("*").alias("n")).where("n > 1"))
            if not many("dst"):
                # A node is reached if the way back from it meets a node seen.
                held = seen.select(F.col("node").alias("id"), F.lit(True).alias("held"))
                back = steps.select(F.col("dst").alias("id"), F.col("src").alias("next")).distinct().join(held, "id", "left")
                tops = seen.join(steps.select(F.col("dst").alias("node")), "node", "left_anti").select(F.col("node").alias("id"), F.lit(None).cast(dict(back.dtypes)["next"]).alias("next"), F.lit(True).alias("held"))
                root = jump(back.unionByName(tops), stop=F.col("held").isNotNull())
                return cut(root.join(seen.select(F.col("node").alias("root")), "root", "left_semi").select(F.col("id").alias("node")).union(seen).distinct())
            if not many("src"):
                return cut(_along(frontier, steps).union(seen).distinct())


def _along(seeds: DataFrame, steps: DataFrame) -> DataFrame:
    """(node): what is on the ways from seeds where each node has one step out: marks go 2**k steps on in round k.

    Leaves are taken off first: what isn't marked by then never is.
    """
    nodes = steps.select(F.col("src").alias("id")).union(steps.select("dst")).distinct()
    marked = seeds.select(F.col("node").alias("id"), F.lit(True).alias("on"))
    state = cut(nodes.join(steps.select(F.col("src").alias("id"), F.col("dst").alias("next")).distinct(), "id", "left").join(marked, "id", "left").select("id", "next", F.coalesce("on", F.lit(False)).alias("on")))
    marks = lambda rows: rows.where("on and next is not null").select(F.col("next").alias("id"), F.lit(True).alias("new")).distinct()
    state, levels = shed(state, lambda rest, leaves: rest.join(marks(leaves), "id", "left").select("id", "next", (F.col("on") | F.col("new").isNotNull()).alias("on")))
    if levels:
        state = cut(state)
    for _ in range(math.ceil(math.log2(max(2, state.count()))) + 1):
        if not some(state.where("on and next is not null")):
            break
        sent = marks(state)
        far = state.select(F.col("id").alias("next"), F.col("next").alias("n2"))
        past, state = state, cut(state.join(far, "next", "left").join(sent, "id", "left").select("id", F.col("n2").alias("next"), (F.col("on") | F.col("new").isNotNull()).alias("on")))
        drop(past)
    for level in levels:
        state = state.unionByName(level.where("leaf").select("id", "next", "on"))
    return state.where("on").select(F.col("id").alias("node"))


#: Rounds after which `relax` looks for chains to contract.
PATIENCE = 12


def _inner(start: DataFrame, steps: DataFrame) -> DataFrame:
    """(node): nodes with one step in and one out that nothing starts from."""
    ends = steps.select(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")).union(steps.select("dst", F.lit(1), F.lit(0)))
    return ends.groupBy("node").agg(F.sum("i").alias("i"), F.sum("o").alias("o")).where("i = 1 and o = 1").select("node").join(start.select("node"), "node", "left_anti")


def relax(start: DataFrame, steps: DataFrame, best: str, extra: str | None = None, limit: int | None = None, contract: bool = True, whole: bool = False) -> DataFrame:
    """Best value for each node over paths of steps (src, dst, cost) from start (node, value).

    best is "min" or "max". extra names a column of steps whose largest value on the path comes along as
    `worst`. Only improved nodes go on to the next round. What is not settled after PATIENCE rounds is done
    once more with chains of nodes that have one step in and one out contracted, so that rounds are those of
    the branchings and the logarithm of the longest chain. With "max", a cycle that can be reached and gains
    raises ValueError: its values would grow for ever.

    Unless limit or whole is given, dead ends are taken off before the rounds and valued after them, level by level: in a
    network that branches, rounds then hold a small part of the nodes.
    """
    if limit is None and not whole and steps.count() > FEW:
        return _relax_shed(start, steps, best, extra, contract)
    better = (lambda a, b: a < b) if best == "min" else (lambda a, b: a > b)
    pick = F.min if best == "min" else F.max
    start = start.select("node", F.col("value").cast("double").alias("value"), *([F.lit(None).cast("double").alias("worst")] if extra else []))
    state = frontier = cut(start)
    rounds = 0
    while some(frontier) and (limit is None or rounds < limit):
        if rounds == PATIENCE and contract and limit is None:
            inner = cut(_inner(start, steps))
            if 4 * inner.count() > steps.count():
                drop(state, frontier)
                return _relax_contracted(start, steps, inner, best, extra)
        if best == "max" and rounds > PATIENCE and rounds > state.count():
            raise ValueError("the steps hold a cycle")
        worst = [F.greatest("worst", extra).alias("worst")] if extra else []
        cost = F.struct((F.col("value") + F.col("cost")).alias("value"), *worst)
        tried = steps.join(light(frontier), steps.src == frontier.node).groupBy(F.col("dst").alias("node")).agg(pick(cost).alias("new"))
        old = state.select("node", F.col("value").alias("old"))
        past = state, frontier
        frontier = cut(tried.join(old, "node", "left").where(F.col("old").isNull() | better(F.col("new.value"), F.col("old"))).select("node", "new.*"))
        state = cut(state.join(frontier, "node", "left_anti").unionByName(frontier))
        drop(*past)
        rounds += 1
    return state


def _relax_shed(start: DataFrame, steps: DataFrame, best: str, extra: str | None, contract: bool) -> DataFrame:
    """relax over what is left of the steps without dead ends; these have the best value over the steps into them.

    A dead end is a node without start that no step leaves, or, where the least sum is asked for and no cost is below 0,
    one that has steps from and to one other node only. They are taken off while they are an eighth of the steps and more.
    """
    rows = cut(steps.where("src is not null and dst is not null").select("src", "dst", "cost", *([extra] if extra else [])))
    known = cut(start.select("node").distinct())
    back = " or lo = hi" if best == "min" and not some(rows.where("cost is null or cost < 0")) else ""
    rest, levels, n = rows, [], rows.count()
    while n > FEW:
        ends = rest.select(F.col("src").alias("node"), F.col("dst").alias("other"), F.lit(1).alias("out")).union(rest.select("dst", "src", F.lit(0)))
        seen = ends.groupBy("node").agg(F.max("out").alias("out"), F.min("other").alias("lo"), F.max("other").alias("hi"))
        dead = cut(seen.where(f"out = 0{back}").select("node").join(known, "node", "left_anti"))
        if 8 * dead.count() < n:
            drop(dead)
            break
        level = cut(rest.join(dead.toDF("src"), "src", "left_anti").join(dead.select(F.col("node").alias("dst"), F.lit(True).alias("hang")), "dst", "left").withColumn("hang", F.coalesce("hang", F.lit(False))))
        drop(dead, rows)
        levels.append(level)
        rest = level.where("not hang").drop("hang")
        n = rest.count()
    state = relax(start, rest, best, extra, contract=contract, whole=True)
    pick = F.min if best == "min" else F.max
    cost = F.struct((F.col("value") + F.col("cost")).alias("value"), *([F.greatest("worst", extra).alias("worst")] if extra else []))
    for level in reversed(levels):
        found = level.where("hang").join(state, F.col("src") == F.col("node")).groupBy(F.col("dst").alias("node")).agg(pick(cost).alias("new")).select("node", "new.*")
        past, state = state, cut(state.unionByName(found))
        drop(past, level)
    drop(rows, known)
    return state


def _relax_contracted(start: DataFrame, steps: DataFrame, inner: DataFrame, best: str, extra: str | None) -> DataFrame:
    """relax over the steps between nodes that are not inner; inner nodes have their chain's head's value and the way from there."""
    carry = {"cost": "sum"} | ({extra: "max"} if extra else {})
    both = [F.col(c) for c in carry]
    ahead = jump(steps.join(inner, steps.src == inner.node).select(F.col("src").alias("id"), F.col("dst").alias("next"), *both), carry=carry)
    ahead = ahead.select(F.col("id").alias("dst"), "root", F.col("cost").alias("rest"), *([F.col(extra).alias("high")] if extra else []))
    high = [F.greatest(extra, "high").alias(extra)] if extra else []
    short = steps.join(inner, steps.src == inner.node, "left_anti").join(ahead, "dst", "left")
    short = cut(short.select("src", F.coalesce("root", "dst").alias("dst"), (F.col("cost") + F.coalesce("rest", F.lit(0.0))).alias("cost"), *high))
    state = relax(start, short, best, extra, contract=False)
    behind = jump(steps.join(inner, steps.dst == inner.node).select(F.col("dst").alias("id"), F.col("src").alias("next"), *both), carry=carry)
    head = state.select(F.col("node").alias("root"), "value", *(["worst"] if extra else []))
    worst = [F.greatest("worst", extra).alias("worst")] if extra else []
    found = behind.join(head, "root").select(F.col("id").alias("node"), (F.col("value") + F.col("cost")).alias("value"), *worst)
    return cut(state.unionByName(found))


def jump(df: DataFrame, stop: Column | None = None, carry: dict[str, str] | None = None) -> DataFrame:
    """Pointer jumping over (id, next, ...): each id's last node on its chain as `root`, in log rounds.

    carry maps a numeric column, the cost of the step id -> next, to how it is combined along the chain: sum, max or min.
    A null next, or a row where stop holds, ends the chain. Ids whose chain runs into a cycle have a null root.
    Leaves are taken off first and take their next's root in the end, so that rounds hold what is left without them.
    """
    carry = carry or {}
    nxt = F.col("next") if stop is None else F.when(~stop, F.col("next"))
    zero = {"sum": F.lit(0.0), "max": F.lit(None).cast("double"), "min": F.lit(None).cast("double")}
    state = df.select("id", nxt.alias("next"), *(F.when(nxt.isNotNull(), F.col(c).cast("double")).otherwise(zero[k]).alias(c) for c, k in carry.items()))
    first = cut(state)
    state, levels = shed(first)
    state = cut(state.select("id", F.coalesce("next", "id").alias("root"), F.col("next").isNull().alias("done"), *carry))
    drop(first)
    most = math.ceil(math.log2(max(2, state.count()))) + 1  # by then every chain's end is reached
    join = {"sum": lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0.0)), "max": lambda a, b: F.greatest(a, b), "min": lambda a, b: F.least(a, b)}
    for left in range(most, -1, -1):
        far = state.select(F.col("id").alias("root"), F.col("root").alias("r2"), F.col("done").alias("d2"), *(F.col(c).alias(f"{c}2") for c in carry))
        own = state.join(far, "root", "left")
        moved = ~F.col("done") & F.col("r2").isNotNull()
        cols = [F.when(moved, join[k](c, f"{c}2")).otherwise(F.col(c)).alias(c) for c, k in carry.items()]
        past, state = state, cut(own.select("id", F.when(moved, F.col("r2")).otherwise(F.col("root")).alias("root"), (F.col("done") | F.col("d2").isNull() | F.col("d2")).alias("done"), *cols))
        drop(past)
        if not some(state.where("not done")):
            break
        if not left:
            state = state.withColumn("root", F.when(F.col("done"), F.col("root")))
    held, state = state, state.drop("done")
    for level in reversed(levels):
        far = state.select(F.col("id").alias("next"), F.col("root").alias("r2"), F.lit(True).alias("met"), *(F.col(c).alias(f"{c}2") for c in carry))
        own = level.where("leaf").join(far, "next", "left")
        met = F.col("met").isNotNull()
        cols = [F.when(met, join[k](c, f"{c}2")).otherwise(F.col(c)).alias(c) for c, k in carry.items()]
        state = cut(state.unionByName(own.select("id", F.when(met, F.col("r2")).otherwise(F.coalesce("next", "id")).alias("root"), *cols)))
        drop(held, level)
        held = state
    return state


#: Rows of one label above which `components` doesn't join them by it.
MANY = 1 << 16


def components(pairs: DataFrame) -> DataFrame:
    """(id, component) of the graph of pairs (a, b): the smallest id reachable."""
    both = cut(pairs.select("a", "b").union(pairs.select("b", "a")).distinct().toDF("id", "other"))
    label = held = cut(both.groupBy("id").agg(F.least(F.min("other"), F.col("id")).alias("component")))
    while True:
        near = both.join(label.toDF("other", "theirs"), "other").groupBy("id").agg(F.min("theirs").alias("theirs"))
        step = label.join(near, "id").select("id", F.col("component").alias("was"), F.least("component", "theirs").alias("component"))
        # A label that many have would put them all into one task; such labels are few and are sent to the rows instead.
        step = cut(step)
        many = step.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") > MANY).select("component")
        known = cut(many.join(label.toDF("component", "further"), "component", "left"))
        far, sent = label.toDF("component", "further"), F.broadcast(known)
        looked = step.join(F.broadcast(known.select("component")), "component", "left_anti").join(far, "component", "left").unionByName(step.join(sent, "component"))
        after = cut(looked.select("id", F.coalesce(F.least("further", "component"), "component").alias("component"), "was"))
        drop(held, step, known)
        held, label = after, after.select("id", "component")
        if not some(after.where("component <> was")):
            drop(both)
            return label


def loops(df: DataFrame) -> DataFrame:
    """(id, ring) over (id, next) made of loops alone: the smallest id on each id's loop, in log rounds."""
    state = held = cut(df.select("id", "next", F.least("id", "next").alias("ring")))
    while True:
        far = state.select(F.col("id").alias("next"), F.col("next").alias("n2"), F.col("ring").alias("r2"))
        after = cut(state.join(far, "next").select("id", F.col("n2").alias("next"), F.least("ring", "r2").alias("ring"), (F.col("r2") < F.col("ring")).alias("moved")))
        drop(held)
        if not some(after.where("moved")):
            return after.select("id", "ring")
        held, state = after, after.drop("moved")
