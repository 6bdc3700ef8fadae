"""Trees and cycles of large graphs in few rounds: pointer doubling over single parents, then work on what is left.

A node with exactly one parent hangs on it; such links form trees (and rings). Doubling finds each node's top, its steps to it
and the sums of all below it in as many rounds as the logarithm of the depth. Nodes with several parents are few in most
graphs; searches step from one to the next over whole stretches of tree."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.session import discard, meet, stash


def climb(links: DataFrame, own: DataFrame | None = None, sums: bool = True) -> DataFrame:
    """(id, up, top, steps, total, size, height) for links (id, up), one a node, and own (id, value); see climb_from()."""
    nobody, nothing = F.lit(None).cast(links.schema["up"].dataType), F.lit(None).cast("long")
    rows = links.select("id", "up", nothing.alias("value")).unionByName(links.select(F.col("up").alias("id"), nobody.alias("up"), nothing.alias("value")))
    if own is not None:
        rows = rows.unionByName(own.select("id", nobody.alias("up"), F.col("value").cast("long").alias("value")))
    return climb_from(stash(rows.groupBy("id").agg(F.max("up").alias("up"), F.max("value").alias("value")), "climb"), sums)


def climb_from(start: DataFrame, sums: bool = True) -> DataFrame:
    """(id, up, top, steps, total, size, height) of all nodes (id, up, value), one row each; up is null for those without a single parent.

    top is the last node upwards and steps the way to it; total, size and height are over the node and all that hangs below it,
    and are left out without sums. up is null, but for nodes that hang on a ring, which have no top: there it lies on the ring,
    and the other columns say nothing. start is read several times.

    Round k knows what lies within 2^k steps, and works on nodes with an ancestor that far up alone. A node's sums for twice as
    far are its own and those of the nodes exactly 2^k below it: the latter are sent to it, and what all rounds sent is summed at
    the end. Each round leaves nodes behind as long as one hangs on a top; when none is, what is left hangs on rings, and
    the rounds end once all pointers lie on these."""
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    carried = [F.coalesce("value", zero).alias("total"), one.alias("size"), zero.alias("height")] if sums else []
    names = ["total", "size", "height"] if sums else []
    now = start.filter("up is not null").select("id", "up", one.alias("steps"), *carried)
    done, sent, reach, left = [], [], 1, None
    while True:
        n = now.count()
        if not n or n == left and _all_on_rings(now):
            break
        left = n
        way = lambda df: df.select(F.col("id").alias("up"), F.col("up").alias("up_up"), F.col("steps").alias("up_steps"))
        above = reduce(DataFrame.unionByName, [way(now), *map(way, done)])
        after = meet(now, above, "up", "left").select("id", F.coalesce("up_up", "up").alias("up"), (F.col("steps") + F.coalesce("up_steps", zero)).alias("steps"), *names)
        if sums:
            below = now.groupBy(F.col("up").alias("id")).agg(F.sum("total").alias("b_total"), F.sum("size").alias("b_size"), (F.max("height") + reach).alias("b_height"))
            sent.append(stash(below, "climb-sums"))
            after = meet(after, sent[-1], "id", "left").select("id", "up", "steps", (F.col("total") + F.coalesce("b_total", zero)).alias("total"), (F.col("size") + F.coalesce("b_size", zero)).alias("size"), F.greatest("height", "b_height").alias("height"))
        reach *= 2
        after = stash(after, "climb")
        done.append(after.filter(F.col("steps") < reach).select("id", "up", "steps"))
        now = after.filter(F.col("steps") == reach)
    nobody = F.lit(None).cast(start.schema["up"].dataType)
    ways = [d.select("id", nobody.alias("up"), F.col("up").alias("top"), "steps") for d in done]
    ways += [start.filter("up is null").select("id", nobody.alias("up"), F.col("id").alias("top"), zero.alias("steps")), now.select("id", "up", F.col("up").alias("top"), "steps")]
    found = reduce(DataFrame.unionByName, ways)
    if not sums:
        return stash(found, "climbed")
    parts = [found.select("*", zero.alias("total"), zero.alias("size"), zero.alias("height")), start.select("id", *[nobody.alias(c) for c in ("up", "top")], zero.alias("steps"), *carried)]
    parts += [b.select("id", *[nobody.alias(c) for c in ("up", "top")], zero.alias("steps"), F.col("b_total").alias("total"), F.col("b_size").alias("size"), F.col("b_height").alias("height")) for b in sent]
    totals = [F.sum("total").alias("total"), F.sum("size").alias("size"), F.max("height").alias("height")]
    return stash(reduce(DataFrame.unionByName, parts).groupBy("id").agg(F.max("up").alias("up"), F.max("top").alias("top"), F.max("steps").alias("steps"), *totals), "climbed")


def _all_on_rings(now: DataFrame) -> bool:
    """Whether the pointers (id, up) of nodes that hang on rings all lie on these: then following them again loses none of their ends."""
    ends = stash(now.select(F.col("up").alias("id")).distinct(), "ends")
    return meet(now, ends, "id", "left_semi").select("up").distinct().count() == ends.count()


def _apart(edges: DataFrame) -> DataFrame:
    return edges.filter("parent <> child").select("parent", "child").distinct()


def single_links(edges: DataFrame, without: DataFrame | None = None) -> DataFrame:
    """(id, up) of the nodes with exactly one parent, apart from those in without (id)."""
    one = edges.groupBy(F.col("child").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.first("parent").alias("up")).filter("n = 1").select("id", "up")
    return one if without is None else meet(one, without.select("id"), "id", "left_anti")


def jumps(edges: DataFrame, climbed: DataFrame) -> DataFrame:
    """(parent, child, through, w): the edges into nodes that hang on no single parent, from the top of the tree that each comes out of.

    through is the edge's own parent, w the way from the top through it."""
    tops = climbed.select(F.col("id").alias("through"), "top", "steps")
    landing = climbed.filter("steps = 0").select(F.col("id").alias("child"))
    return meet(meet(edges.select(F.col("parent").alias("through"), "child"), landing, "child", "left_semi"), tops, "through").select(F.col("top").alias("parent"), "child", "through", (F.col("steps") + 1).alias("w"))


def trim(edges: DataFrame) -> DataFrame:
    """The edges left after nodes without incoming or without outgoing edges are peeled off again and again."""
    left = stash(edges.select("parent", "child").distinct(), "core")
    n = left.count()
    while n:
        kept = meet(left, left.select(F.col("child").alias("parent")).distinct(), "parent", "left_semi")
        kept = stash(meet(kept, kept.select(F.col("parent").alias("child")).distinct(), "child", "left_semi").select("parent", "child"), "core")
        m = kept.count()
        discard(left)
        left = kept
        if m == n:
            break
        n = m
    return left


def has_cycles(edges: DataFrame, climbed: DataFrame, hops: DataFrame) -> bool:
    """Whether edges hold a cycle: a self-loop, a ring that climbing didn't leave, or one through the hops from tree to tree."""
    loops = edges.filter("parent = child").select(F.lit(1).alias("x")).limit(1)
    return not loops.unionByName(climbed.filter("up is not null").select(F.lit(1).alias("x")).limit(1)).isEmpty() or not trim(hops).isEmpty()


def relax(starts: DataFrame, steps: DataFrame) -> DataFrame:
    """(id, d): the least d of starts (id, d) plus the weights w of steps (parent, child, w) along the way; a round follows only
    what the last one bettered."""
    best = stash(starts.groupBy("id").agg(F.min("d").alias("d")), "relax")
    frontier = best
    while True:
        reached = meet(frontier, steps, frontier.id == steps.parent).groupBy(F.col("child").alias("id")).agg(F.min(F.col("d") + F.col("w")).alias("d"))
        had = best.select("id", F.col("d").alias("had"))
        better = stash(meet(reached, had, "id", "left").filter("had is null or d < had").select("id", "d"), "relax")
        if not better.limit(1).count():
            return best
        merged = stash(best.unionByName(better).groupBy("id").agg(F.min("d").alias("d")), "relax")
        discard(best)
        best, frontier = merged, better


def _colour_components(edges: DataFrame) -> DataFrame:
    """(id, component) of all nodes on cycles of edges (parent, child): each node takes the least id that leads to it; those
    of a colour that lead back to its first node are one component. The rest goes round again."""
    spark = edges.sparkSession
    kind = edges.schema["parent"].dataType.simpleString()
    found = spark.createDataFrame([], f"id {kind}, component {kind}")
    left = trim(edges)
    while left.limit(1).count():
        ids = left.select(F.col("parent").alias("id")).unionByName(left.select(F.col("child").alias("id"))).distinct()
        colour = stash(ids.select("id", F.col("id").alias("c")), "colours")
        frontier = colour
        while True:
            told = meet(frontier, left, frontier.id == left.parent).groupBy(F.col("child").alias("id")).agg(F.min("c").alias("new"))
            frontier = stash(meet(told, colour, "id").filter("new < c").select("id", F.col("new").alias("c")), "colours")
            if not frontier.limit(1).count():
                break
            colour = stash(colour.unionByName(frontier).groupBy("id").agg(F.min("c").alias("c")), "colours")
        a, b = colour.select(F.col("id").alias("parent"), F.col("c").alias("cp")), colour.select(F.col("id").alias("child"), F.col("c").alias("cc"))
        inside = stash(meet(meet(left, a, "parent"), b, "child").filter("cp = cc").select("parent", "child", F.col("cp").alias("c")), "coloured")
        back = stash(inside.filter("child = c").select(F.col("parent").alias("id"), "c").distinct(), "back")
        whole, frontier = back, back
        while frontier.limit(1).count():
            more = meet(inside, frontier.select(F.col("id").alias("child")), "child").select(F.col("parent").alias("id"), "c").distinct()
            frontier = stash(meet(more, whole, "id", "left_anti"), "back")
            whole = stash(whole.unionByName(frontier), "back")
        found = stash(found.unionByName(whole.select("id", F.col("c").alias("component"))), "components")
        # the first node of each colour is settled, be it on a cycle or not
        done = whole.select("id").unionByName(colour.filter("id = c").select("id")).distinct()
        rest = meet(meet(left, done.select(F.col("id").alias("parent")), "parent", "left_anti"), done.select(F.col("id").alias("child")), "child", "left_anti")
        left = trim(rest)
    return found


def strong_components(edges: DataFrame) -> DataFrame:
    """(id, component) of the nodes that lie on a cycle, a self-loop included; component is the same for nodes that lead to one another.

    Rings of nodes with one parent each are what doubling cannot leave; of the rest only the nodes with several parents, and the
    way between them, are searched. A cycle through them takes in the stretches of tree that it runs along."""
    e = stash(_apart(edges), "edges")
    all_ = e.select(F.col("parent").alias("id")).unionByName(e.select(F.col("child").alias("id"))).distinct().withColumn("value", F.lit(0).cast("long"))
    up = climb(single_links(e), all_, sums=False)
    ring = stash(up.filter("up is not null").select(F.col("up").alias("id")).distinct(), "ring")
    if ring.limit(1).count():
        # a ring's nodes are a component; its least node names it
        own = meet(meet(e, ring.select(F.col("id").alias("child")), "child", "left_semi"), ring.select(F.col("id").alias("parent")), "parent", "left_semi")
        rings = _ring_names(own)
        up = climb(single_links(e, ring), all_, sums=False)
    else:
        rings = ring.select("id", F.col("id").alias("component"))
    # rings have no other way in, so no cycle leads through them and on
    over = stash(jumps(meet(e, ring.select(F.col("id").alias("child")), "child", "left_anti"), up), "jumps")
    heads = _colour_components(over)
    at = heads.select(F.col("id").alias("parent"), F.col("component").alias("cp"))
    bt = heads.select(F.col("id").alias("child"), F.col("component").alias("cc"))
    within = stash(meet(meet(over, at, "parent"), bt, "child").filter("cp = cc").select(F.col("through").alias("id"), F.lit(1).cast("long").alias("value")).distinct(), "within")
    found = rings.unionByName(heads)
    if within.limit(1).count():
        marked = climb(single_links(e, ring), within)
        trees = meet(marked.filter("total > 0"), heads.select(F.col("id").alias("top"), "component"), "top").select("id", "component")
        found = found.unionByName(trees)
    loops = edges.filter("parent = child").select(F.col("parent").alias("id")).distinct()
    found = stash(found.groupBy("id").agg(F.min("component").alias("component")), "components")
    return found.unionByName(meet(loops, found, "id", "left_anti").select("id", F.col("id").alias("component")))


def _ring_names(edges: DataFrame) -> DataFrame:
    """(id, component) for edges that are rings: by doubling, each node sees ever more of its ring, until none sees a lesser name."""
    now = stash(edges.select(F.col("child").alias("id"), F.col("parent").alias("up"), F.least("child", "parent").alias("component")), "rings")
    while True:
        above = now.select(F.col("id").alias("up"), F.col("up").alias("up_up"), F.col("component").alias("c"))
        after = stash(meet(now, above, "up").select("id", F.col("up_up").alias("up"), F.least("component", "c").alias("component"), (F.col("c") < F.col("component")).alias("bettered")), "rings")
        discard(now)
        now = after.select("id", "up", "component")
        now._stashed_at = after._stashed_at
        if not after.filter("bettered").limit(1).count():
            return now.select("id", "component")
