"""Edges: (src, pred, dst, origin). Deduplication, inverses, closure, traversal.

Every step is a join or an aggregation on node ids; sets of nodes never visit the driver,
and what an iteration has reached is written out before the next one reads it.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import staged

#: Predicates that record who wrote or checked a note; shortest paths avoid them.
PROVENANCE = ("generated_by", "generated", "verified_by", "verified")
#: Origins in the order in which they win a repeated edge.
ORIGINS = ("frontmatter", "body", "derived")


def _rank(origin: Column) -> Column:
    return F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(o) for o in ORIGINS]), origin), F.lit(0)), F.lit(len(ORIGINS) + 1))


def distinct_edges(edges: DataFrame, listed: bool = False) -> DataFrame:
    """One edge for each (src, pred, dst), with the origin that wins; no loops to itself. listed: every origin is one of
    ORIGINS, so that edges are told by its number and need not be sorted."""
    if listed:
        best = edges.filter("src <> dst").groupBy("src", "pred", "dst").agg(F.min(_rank(F.col("origin"))).alias("rank"))
        return best.select("src", "pred", "dst", F.element_at(F.array(*[F.lit(o) for o in ORIGINS]), F.col("rank").cast("int")).alias("origin"))
    first = F.min(F.struct(_rank(F.col("origin")).alias("rank"), F.col("origin")))
    return edges.filter("src <> dst").groupBy("src", "pred", "dst").agg(first["origin"].alias("origin"))


def inverse_edges(edges: DataFrame, inverses: Mapping[str, str]) -> DataFrame:
    """The edges that run the other way, for predicates that have an inverse."""
    if not inverses:
        return edges.limit(0).select("src", "pred", "dst", F.lit("derived").alias("origin"))
    table = F.create_map(*[F.lit(x) for pair in inverses.items() for x in pair])
    back = edges.select(F.col("dst").alias("src"), F.element_at(table, F.col("pred")).alias("pred"), F.col("src").alias("dst"), F.lit("derived").alias("origin"))
    return back.filter("pred is not null and src <> dst")


def _extended(known: DataFrame, new: DataFrame, most_rounds: int = 64) -> DataFrame:
    """The pairs, and all that follow from those of them that are new."""
    joined = lambda a, b: a.alias("a").join(b.alias("b"), F.col("a.dst") == F.col("b.src")).select(F.col("a.src"), F.col("b.dst"))
    for _ in range(most_rounds):
        longer = joined(new, known) if known is new else joined(new, known).unionByName(joined(known, new))
        new = staged(longer.distinct().join(known, ["src", "dst"], "left_anti"), "closure-new")
        if new.isEmpty():
            return known
        known = known.unionByName(new)
    raise RuntimeError("the closure did not settle")


def closure(edges: DataFrame, pred: str, most_rounds: int = 64) -> DataFrame:
    """Edges of a transitive predicate that follow from others: src, pred, dst, origin `derived`.

    Paths double in each round, so a chain of n edges takes log n rounds; only pairs that are new
    in a round are extended in the next. Pairs already there are not given again, nor pairs of a
    node with itself.
    """
    base = staged(edges.filter(F.col("pred") == pred).select("src", "dst").distinct(), "closure-base")
    known = _extended(base, base, most_rounds)
    out = known.filter("src <> dst").join(base, ["src", "dst"], "left_anti")
    return out.select("src", F.lit(pred).alias("pred"), "dst", F.lit("derived").alias("origin"))


def reach_after(was: DataFrame, base: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """src, dst: which nodes reach which, after a change. was: the pairs before it, base: the edges after it, added and removed
    the edges that it brought and took (all src, dst; pairs of a node with itself are left out).

    Pairs that had a way over a removed edge are taken out; of these, those come back for which an edge that is still there leads
    to a pair that holds, until none is left. Then added edges extend what holds, as in closure(). Work goes with the
    pairs that the change touches, not with all."""
    pairs = lambda df: df.select("src", "dst").filter("src <> dst").distinct()
    was, base, added, gone = staged(pairs(was), "reach-was"), staged(pairs(base), "reach-base"), pairs(added), staged(pairs(removed), "reach-gone")
    before = gone.join(was.select(F.col("src").alias("x"), F.col("dst").alias("src")), "src").select("x", "dst").unionByName(gone.select(F.col("src").alias("x"), "dst"))
    over = before.join(was.select(F.col("src").alias("dst"), F.col("dst").alias("y")), "dst").select("x", "y").unionByName(before.select("x", F.col("dst").alias("y")))
    doubt = staged(over.select(F.col("x").alias("src"), F.col("y").alias("dst")).distinct().join(was, ["src", "dst"], "left_semi"), "reach-doubt")
    known = staged(was.join(doubt, ["src", "dst"], "left_anti"), "reach-kept")
    # an edge first, then a pair that holds; the edges in doubt that are still there hold by themselves
    steps = lambda front: base.select("src", F.col("dst").alias("z")).join(front.select(F.col("src").alias("z"), "dst"), "z").select("src", "dst")
    of_doubt = doubt.select("src").distinct()
    first = steps(known).join(of_doubt, "src", "left_semi").unionByName(base)
    new = staged(first.distinct().join(doubt, ["src", "dst"], "left_semi"), "reach-back")
    while not new.isEmpty():
        known = known.unionByName(new)
        new = staged(steps(new).distinct().join(doubt, ["src", "dst"], "left_semi").join(known, ["src", "dst"], "left_anti"), "reach-back")
    known = staged(known, "reach-known")
    new = staged(added.join(base, ["src", "dst"], "left_semi").join(known, ["src", "dst"], "left_anti"), "reach-new")
    return pairs(_extended(known.unionByName(new), new)) if not new.isEmpty() else known


def neighbors(edges: DataFrame, start: DataFrame, depth: int = 1, preds: Iterable[str] | None = None) -> DataFrame:
    """src, pred, dst, depth: the edges out of the nodes reached within depth - 1 steps from
    start (a column id). A node is expanded once, at its least depth; an edge to a node seen
    before is still given."""
    if preds:
        edges = edges.filter(F.col("pred").isin(*preds))
    front = staged(start.select(F.col("id").alias("src")).distinct(), "front")
    seen, out = front, None
    for d in range(1, depth + 1):
        step = staged(edges.join(front, "src").select("src", "pred", "dst", F.lit(d).alias("depth")), "neighbors")
        out = step if out is None else out.unionByName(step)
        if d < depth:
            front = staged(step.select(F.col("dst").alias("src")).distinct().join(seen, "src", "left_anti"), "front")
            seen = seen.unionByName(front)
    if out is None:
        return edges.select("src", "pred", "dst", F.lit(0).alias("depth")).limit(0)
    return out


def _breadth_first(edges: DataFrame, start: DataFrame, most: int | None) -> list[DataFrame]:
    """For each level the nodes first reached there (node, depth), until there are none or `most` levels are done."""
    front = staged(start.select(F.col("id").alias("node"), F.lit(0).alias("depth")), "front")
    levels, seen = [front], front.select("node")
    while most is None or len(levels) <= most:
        step = edges.join(front.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti")
        front = staged(step.select("node", F.lit(len(levels)).alias("depth")), "front")
        if front.isEmpty():
            break
        levels.append(front)
        seen = seen.unionByName(front.select("node"))
        if len(levels) % 16 == 0:  # one table instead of many small ones
            seen = staged(seen, "seen")
    return levels


def distances(edges: DataFrame, start: DataFrame, most: int | None = None) -> DataFrame:
    """node, depth: fewest edges from the start nodes (a column id), themselves at 0. most: the
    greatest depth that is asked for."""
    return reduce(DataFrame.unionByName, _breadth_first(edges, start, most))


def reaches(edges: DataFrame, pairs: DataFrame, preds: Iterable[str] | None = None) -> DataFrame:
    """a, b: those of the pairs (a, b; not null) for which a path of one edge at least leads from a to b.

    All pairs are searched at once, from both ends; each round extends the side that has fewer rows, and a pair that has met
    is searched no further. No closure is made: rows are pairs times the nodes of the smaller side."""
    ways = edges.filter(F.col("pred").isin(*preds)) if preds else edges
    ways = ways.select("src", "dst").distinct()
    pairs = staged(pairs.select("a", "b").dropna().distinct(), "pairs")
    # what a side has reached: at the front a's successors, at the back b itself
    ahead = staged(pairs.join(ways.withColumnRenamed("src", "a"), "a").select("a", "b", F.col("dst").alias("node")).distinct(), "ahead")
    behind = pairs.select("a", "b", F.col("b").alias("node"))
    sides = {"ahead": [ahead, ahead], "behind": [behind, behind]}  # all, and the front
    met = []
    while True:
        hit = staged(sides["ahead"][0].join(sides["behind"][0], ["a", "b", "node"]).select("a", "b").distinct(), "met")
        met.append(hit)
        size = {}
        for name, (every, front) in sides.items():
            open_ = front.join(hit, ["a", "b"], "left_anti")
            sides[name] = [every.join(hit, ["a", "b"], "left_anti"), open_]
            size[name] = open_.count()
        if not min(size.values()):
            break  # one side has seen all that it can, and has not met the other
        name = min(size, key=size.get)
        here, there = ("src", "dst") if name == "ahead" else ("dst", "src")
        every, front = sides[name]
        step = front.join(ways.select(F.col(here).alias("node"), F.col(there).alias("next")), "node").select("a", "b", F.col("next").alias("node")).distinct()
        new = staged(step.join(every, ["a", "b", "node"], "left_anti"), name)
        sides[name] = [staged(every.unionByName(new), name + "-all"), new]
    return reduce(DataFrame.unionByName, met).distinct()


#: Levels that one job walks back.
BACK = 8


def _met(edges: DataFrame, a: str, b: str, most: int | None) -> list[DataFrame]:
    """Levels (node, prev, pred) from a to b, as wide as the shortest ways need; [] if there is none. Both ends search,
    and the smaller front goes on; where they meet, the way to b is walked through what b's side has seen."""
    spark = edges.sparkSession
    start = lambda x: staged(spark.createDataFrame([(x, None, None)], "node string, prev string, pred string"), "front")
    ahead, behind = [start(a)], [start(b)]
    seen = {"ahead": ahead[0].select("node"), "behind": behind[0].select("node")}
    size = {"ahead": 1, "behind": 1}
    while True:
        meet = staged(ahead[-1].join(behind[-1].select("node"), "node", "left_semi").select("node"), "meeting")
        if not meet.isEmpty():
            break
        if most is not None and len(ahead) + len(behind) - 2 >= most:
            return []
        name = min(size, key=size.get)
        levels, here, there = (ahead, "src", "dst") if name == "ahead" else (behind, "dst", "src")
        step = edges.join(levels[-1].select(F.col("node").alias(here)), here).groupBy(F.col(there).alias("node")).agg(F.min(F.struct(F.col(here).alias("prev"), "pred")).alias("w"))
        new = staged(step.join(seen[name], "node", "left_anti").select("node", "w.prev", "w.pred"), "front")
        size[name] = new.count()
        if not size[name]:
            return []
        levels.append(new)
        seen[name] = seen[name].unionByName(new.select("node"))
        if len(levels) % 16 == 0:  # one table instead of many small ones
            seen[name] = staged(seen[name], "seen")
    # from the meeting nodes on, only nodes that b's side reached in as many steps as are left
    at = meet
    for left in reversed(behind[:-1]):
        step = edges.join(at.select(F.col("node").alias("src")), "src").groupBy(F.col("dst").alias("node")).agg(F.min(F.struct("src", "pred")).alias("w"))
        at = staged(step.join(left.select("node"), "node", "left_semi").select("node", F.col("w.src").alias("prev"), F.col("w.pred").alias("pred")), "front")
        ahead.append(at)
    return ahead


def shortest_path(edges: DataFrame, a: str, b: str, skip: Iterable[str] = PROVENANCE, most: int | None = None) -> list[tuple[str, str, str]]:
    """A shortest path as (src, pred, dst) steps; [] if a is b or no path (of at most `most`
    steps, if given) leads there. Among equally short ones that of the least (src, pred) into each
    node, from the end on."""
    spark = edges.sparkSession
    if a == b:
        return []
    levels = _met(edges.filter(~F.col("pred").isin(*skip)) if skip else edges, a, b, most)
    out, at, no = [], b, len(levels) - 1
    while no > 0:  # a job joins the node's predecessors of several levels, a row each
        back = spark.createDataFrame([(at,)], "at string")
        for i in range(no, max(0, no - BACK), -1):
            one = levels[i].select(F.col("node").alias("at"), F.col("prev").alias(f"s{i}"), F.col("pred").alias(f"p{i}"))
            back = back.join(one, "at").withColumn("at", F.col(f"s{i}"))
        row = back.first()
        for i in range(no, max(0, no - BACK), -1):
            out.append((row[f"s{i}"], row[f"p{i}"], at))
            at = row[f"s{i}"]
        no = max(0, no - BACK)
    return out[::-1]
