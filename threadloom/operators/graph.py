"""Spawn-graph operators: threads (id, ...) and edges (parent, child, status)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.operators import contraction
from threadloom.operators.privacy import strip_hidden_chars
from threadloom.session import discard, meet, stash

#: Rounds of a walk after which its tables are merged into one.
COMPACT = 8


def nodes(threads: DataFrame, edges: DataFrame) -> DataFrame:
    """Thread ids and every id on an edge, blank ones apart."""
    return threads.select("id").union(edges.select("parent")).union(edges.select("child")).distinct()


def roots(threads: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without an incoming edge; a self-loop counts as one."""
    return nodes(threads, edges).join(edges.select(F.col("child").alias("id")), "id", "left_anti")


def children(edges: DataFrame) -> DataFrame:
    return edges.select("parent", "child").distinct()


def degrees(threads: DataFrame, steps: DataFrame, *more: Column) -> DataFrame:
    """(id, out, fed, above, up, ...) of every node, in one pass over threads and distinct steps (parent, child).

    out and fed count its children and parents, above those parents that it is not itself; up is one of these. more: aggregates
    of the columns of threads, which may not be named like those above."""
    none, zero, one = F.lit(None), F.lit(0).cast("long"), F.lit(1).cast("long")
    kind = steps.schema["parent"].dataType
    own = threads.select("*", zero.alias("out"), zero.alias("fed"), zero.alias("above"), none.cast(kind).alias("up"))
    apart = F.col("parent") != F.col("child")
    ends = steps.select(F.col("parent").alias("id"), one.alias("out"), zero.alias("fed"), zero.alias("above"), none.cast(kind).alias("up"))
    ends = ends.unionByName(steps.select(F.col("child").alias("id"), zero.alias("out"), one.alias("fed"), apart.cast("long").alias("above"), F.when(apart, F.col("parent")).alias("up")))
    return own.unionByName(ends, allowMissingColumns=True).groupBy("id").agg(*[F.sum(c).alias(c) for c in ("out", "fed", "above")], F.max("up").alias("up"), *more)


def fan_out(threads: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, child_count) of every node, by distinct children."""
    n = children(edges).groupBy(F.col("parent").alias("id")).agg(F.count(F.lit(1)).alias("child_count"))
    return nodes(threads, edges).join(n, "id", "left").na.fill(0, ["child_count"])


def spread(start: DataFrame, steps: DataFrame, limit: int | None = None) -> DataFrame:
    """Breadth-first: start (root, id, dist) followed along steps (parent, child); (root, id, dist), nearest first found.

    Each round joins only the new frontier, drops what was reached before and is written out, so lineage stays
    short; the rounds' tables are merged every COMPACT rounds, so that a deep graph reads few files a round. It ends
    when nothing new is reached, which makes it safe on cycles."""
    reached = stash(start.select("root", "id", F.col("dist").cast("int").alias("dist")), "bfs")
    frontier, seen, rounds = reached, [reached], 0
    while limit is None or rounds < limit:
        rounds += 1
        found = meet(frontier, steps, frontier.id == steps.parent).select("root", F.col("child").alias("id"), (F.col("dist") + 1).alias("dist")).distinct()
        old = reduce(DataFrame.unionByName, seen).select("root", "id")
        frontier = stash(meet(found, old, ["root", "id"], "left_anti"), "bfs")
        if frontier.limit(1).count() == 0:
            break
        seen.append(frontier)
        if len(seen) > COMPACT:
            merged = stash(reduce(DataFrame.unionByName, seen), "bfs")
            discard(*seen[:-1])  # the last one is the frontier
            seen = [merged]
    return reduce(DataFrame.unionByName, seen)


def _self(ids: DataFrame) -> DataFrame:
    return ids.select(F.col("id").alias("root"), "id", F.lit(0).alias("dist"))


def closure(ids: DataFrame, edges: DataFrame, limit: int | None = None) -> DataFrame:
    """(root, id, dist) of everything below each of ids, itself included, by shortest path."""
    return spread(_self(ids), children(edges), limit)


def depth(threads: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, depth): steps from the nearest root; where cycles lie above, the least of that and of the distance from
    a node on a cycle plus the length of its shortest cycle (the walk ends where it meets itself).

    Nodes with one parent take the depth of the top that they hang on and their steps to it; only nodes with several
    parents, and those on cycles, are searched round by round."""
    e = stash(children(edges), "steps")
    plain = e.filter("parent <> child")
    zero = F.lit(0).cast("long")
    everyone = stash(degrees(threads.select("id"), e), "nodes")
    single = everyone.select("id", F.when(F.col("above") == 1, F.col("up")).alias("up"), zero.alias("value"))
    starts = everyone.filter("fed = 0").select("id", zero.alias("d"))
    up = contraction.climb_from(single, sums=False)
    hops = _hops(plain, up)
    if contraction.has_cycles(e, up, hops):
        starts = stash(starts.unionByName(_girths(e, stash(contraction.strong_components(e), "cyclic"))), "starts")
        free = meet(single, starts.select("id", F.lit(True).alias("start")), "id", "left").select("id", F.when(F.col("start").isNull(), F.col("up")).alias("up"), "value")
        up = contraction.climb_from(stash(free, "climb"), sums=False)
        hops = _hops(plain, up)
    best = contraction.relax(starts, hops)
    return meet(up, best.select(F.col("id").alias("top"), "d"), "top").select("id", (F.col("d") + F.col("steps")).cast("int").alias("depth"))


def _hops(edges: DataFrame, climbed: DataFrame) -> DataFrame:
    """(parent, child, w): of the jumps from top to top the shortest."""
    return stash(contraction.jumps(edges, climbed).groupBy("parent", "child").agg(F.min("w").alias("w")), "jumps")


def _girths(edges: DataFrame, cyclic: DataFrame) -> DataFrame:
    """(id, d): for the nodes on cycles (id, component) the length of the shortest one through each."""
    a, b = cyclic.select(F.col("id").alias("parent"), F.col("component").alias("cp")), cyclic.select(F.col("id").alias("child"), F.col("component").alias("cc"))
    core = stash(meet(meet(edges, a, "parent"), b, "child").filter("cp = cc").select("parent", "child", F.col("cp").alias("component")), "core")
    nodes_ = cyclic.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    sizes = stash(meet(core.groupBy("component").agg(F.count(F.lit(1)).alias("m")), nodes_, "component"), "sizes")
    # with as many edges as nodes a component is one cycle and nothing else
    plain = meet(cyclic, sizes.filter("m = n"), "component").select("id", F.col("n").cast("long").alias("d"))
    woven = sizes.filter("m <> n").select("component")
    if woven.isEmpty():
        return plain
    core = stash(meet(core, woven, "component", "left_semi").select("parent", "child"), "core")
    inside = closure(meet(cyclic, woven, "component", "left_semi").select("id"), core)
    back = inside.alias("r").join(core.alias("e"), (F.col("r.id") == F.col("e.parent")) & (F.col("r.root") == F.col("e.child")))
    return plain.unionByName(back.groupBy(F.col("r.root").alias("id")).agg((F.min("r.dist") + 1).cast("long").alias("d")))


def ancestors(edges: DataFrame, node: str) -> DataFrame:
    """(id, dist) upwards from node, nearest first, ties by id; the node itself apart."""
    up = edges.select(F.col("child").alias("parent"), F.col("parent").alias("child")).distinct()
    start = edges.sparkSession.createDataFrame([(node, node, 0)], "root string, id string, dist int")
    return spread(start, up).filter(F.col("id") != node).select("id", "dist").orderBy("dist", "id")


def subtree(edges: DataFrame, node: str, limit: int | None = None) -> DataFrame:
    """(id, dist) downwards from node, itself included, to so many levels; an unknown id is its own subtree."""
    start = edges.sparkSession.createDataFrame([(node, node, 0)], "root string, id string, dist int")
    return spread(start, children(edges), limit).select("id", "dist")


def induced_edges(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """The edges with both ends in ids."""
    return edges.join(ids.select(F.col("id").alias("parent")), "parent", "left_semi").join(ids.select(F.col("id").alias("child")), "child", "left_semi")


def rollup(threads: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, self_tokens, subtree_tokens, subtree_count, max_depth, child_count) of every node.

    Diamonds count once, cycles end. What hangs on single parents is summed by doubling. Below that lie the trees of nodes
    with several parents: for each node the set of those that it reaches, with distances, and the sums of their trees; where
    there are none, as in a forest, nothing is left to do. A graph with cycles is walked from every node."""
    e = stash(children(edges), "steps")
    plain = e.filter("parent <> child")
    info = stash(degrees(threads.select("id", "tokens_used"), e, F.coalesce(F.max("tokens_used"), F.lit(0)).cast("long").alias("self_tokens")), "own")
    own = info.select("id", "self_tokens", F.col("out").alias("child_count"))
    trees = contraction.climb_from(info.select("id", F.when(F.col("above") == 1, F.col("up")).alias("up"), F.col("self_tokens").alias("value")))
    rings = not trees.filter("up is not null").isEmpty()
    whole = trees.select("id", F.col("total").alias("subtree_tokens"), F.col("size").alias("subtree_count"), F.col("height").alias("max_depth"))
    if not rings and info.filter("above > 1").isEmpty():
        sums = whole  # a forest
    else:
        over = stash(contraction.jumps(plain, trees), "jumps")
        if rings or contraction.has_cycles(plain, trees, over):
            below = closure(own.select("id"), plain)
            sums = meet(below, own, "id").groupBy("root").agg(F.sum("self_tokens").alias("subtree_tokens"), F.count(F.lit(1)).alias("subtree_count"), F.max("dist").alias("max_depth")).withColumnRenamed("root", "id")
        else:
            sums = _sums_over_trees(trees, info.filter("above = 1").select("id", "up"), over)
    return meet(own, sums, "id").select("id", "self_tokens", "subtree_tokens", "subtree_count", F.col("max_depth").cast("int").alias("max_depth"), "child_count")


def _sums_over_trees(trees: DataFrame, links: DataFrame, over: DataFrame) -> DataFrame:
    """(id, subtree_tokens, subtree_count, max_depth) where edges lead from one tree to the top of another.

    A top is reached by the nodes above an edge that leads to it, in the tree that the edge comes out of, and by whatever
    reaches that tree's top. Every way into a tree leads through its top, so its sums are taken whole and once."""
    hop = over.groupBy("parent", "child").agg(F.min("w").alias("w"))
    tops = over.select(F.col("child").alias("id")).distinct()
    among = stash(_distances(tops, stash(hop.join(tops.select(F.col("id").alias("parent")), "parent", "left_semi"), "hops")), "tops")
    above = _lineages(over.select(F.col("through").alias("id")).distinct(), links)
    first = over.select("through", "child").join(above.select(F.col("id").alias("through"), "root", "dist"), "through").groupBy("root", F.col("child").alias("id")).agg((F.min("dist") + 1).alias("dist"))
    first = stash(first, "first-tops")
    onward = first.select("root", F.col("id").alias("at"), "dist").join(among.select(F.col("root").alias("at"), "id", F.col("dist").alias("more")), "at").groupBy("root", "id").agg(F.min(F.col("dist") + F.col("more")).alias("dist"))
    sums = trees.select("id", "total", "size", "height")
    far = onward.join(sums, "id").groupBy(F.col("root").alias("id")).agg(F.sum("total").alias("f_total"), F.sum("size").alias("f_size"), F.max(F.col("dist") + F.col("height")).alias("f_height"))
    none = F.lit(0)
    return sums.join(far, "id", "left").select("id", (F.col("total") + F.coalesce("f_total", none)).alias("subtree_tokens"), (F.col("size") + F.coalesce("f_size", none)).alias("subtree_count"), F.greatest("height", "f_height").alias("max_depth"))


def _distances(ids: DataFrame, steps: DataFrame) -> DataFrame:
    """(root, id, dist) from each of ids along weighted steps (parent, child, w), itself included: the shortest ways."""
    best = stash(ids.select(F.col("id").alias("root"), "id", F.lit(0).cast("long").alias("dist")), "distances")
    frontier = best
    while True:
        reached = frontier.join(steps, frontier.id == steps.parent).groupBy("root", F.col("child").alias("id")).agg(F.min(F.col("dist") + F.col("w")).alias("dist"))
        had = best.select("root", "id", F.col("dist").alias("had"))
        better = stash(reached.join(had, ["root", "id"], "left").filter("had is null or dist < had").select("root", "id", "dist"), "distances")
        if not better.limit(1).count():
            return best
        best = stash(best.unionByName(better).groupBy("root", "id").agg(F.min("dist").alias("dist")), "distances")
        frontier = better


def _lineages(ids: DataFrame, links: DataFrame) -> DataFrame:
    """(id, root, dist): each of ids with itself and all nodes above it along links (id, up), in rounds that double."""
    known = stash(ids.select("id", F.col("id").alias("root"), F.lit(0).cast("long").alias("dist")), "lineages")
    jump, reach = stash(links.select(F.col("id").alias("root"), "up"), "jump"), 1
    while True:
        more = stash(known.join(jump, "root").select("id", F.col("up").alias("root"), (F.col("dist") + reach).alias("dist")), "lineages")
        if not more.limit(1).count():
            return known
        known = stash(known.unionByName(more), "lineages")
        up = jump.select(F.col("root").alias("up"), F.col("up").alias("up_up"))
        jump, reach = stash(jump.join(up, "up").select("root", F.col("up_up").alias("up")), "jump"), reach * 2


def timeline(threads: DataFrame, edges: DataFrame) -> DataFrame:
    """A row for each distinct birth, and one with a null birth for undated nodes: (birth_ms, nodes, first_ms, last_ms).

    The births of a large graph are rows and never one list; first and last are those of the whole graph."""
    born = threads.groupBy("id").agg(F.max("created_at_ms").alias("birth_ms"))
    births = nodes(threads, edges).join(born, "id", "left").groupBy("birth_ms").agg(F.count(F.lit(1)).alias("nodes"))
    span = threads.agg(F.min("created_at_ms").alias("first_ms"), F.max("created_at_ms").alias("last_ms"))
    return births.crossJoin(F.broadcast(span))  # one row


def as_of(threads: DataFrame, edges: DataFrame, ms: int) -> tuple[DataFrame, DataFrame]:
    """Threads born by then or undated, and the edges whose child passes; a child without a thread is undated."""
    then = threads.filter(F.col("created_at_ms").isNull() | (F.col("created_at_ms") <= ms))
    late = threads.filter(F.col("created_at_ms") > ms).select(F.col("id").alias("child"))
    return then, edges.join(late, "child", "left_anti").select(*edges.columns)


def digests(rows: DataFrame, key: list[str], columns: list[str], buckets: int) -> DataFrame:
    """(bucket, n, digest): rows in buckets by their key, with a digest of all their columns in which order plays no part."""
    h = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in columns], *[F.col(c).isNull() for c in columns])
    cut = F.pmod(F.xxhash64(*key), F.lit(buckets))
    return rows.groupBy(cut.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.sum(h.cast("decimal(38,0)")).alias("digest"), F.bit_xor(h).alias("mixed"))


def unequal(old: DataFrame, new: DataFrame, key: list[str], columns: list[str], buckets: int) -> tuple[DataFrame, DataFrame]:
    """The rows of both sides in those buckets by key whose digests differ; all others are the same on both sides."""
    a, b = digests(old, key, columns, buckets), digests(new, key, columns, buckets).toDF("b_bucket", "b_n", "b_digest", "b_mixed")
    same = (F.col("n") == F.col("b_n")) & (F.col("digest") == F.col("b_digest")) & (F.col("mixed") == F.col("b_mixed"))
    both = a.join(b, a.bucket == b.b_bucket, "full_outer")
    open_ = stash(both.filter(~F.coalesce(same, F.lit(False))).select(F.coalesce("bucket", "b_bucket").alias("bucket")), "unequal")  # at most buckets rows
    keep = lambda df: df.withColumn("bucket", F.pmod(F.xxhash64(*key), F.lit(buckets))).join(F.broadcast(open_), "bucket", "left_semi").drop("bucket")
    return keep(old), keep(new)


def diff(old: tuple[DataFrame, DataFrame], new: tuple[DataFrame, DataFrame], fields: list[str], buckets: int = 0) -> DataFrame:
    """(kind, id, parent, child, field, old, new): nodes and edges added or removed, and changed fields of threads
    on both sides. An edge is its pair; status takes no part.

    buckets: if given, both sides are first compared by the digests of so many buckets, and only the rows of unequal ones are
    shuffled and joined: for graphs that are nearly the same."""
    blank = F.lit(None).cast("string")
    o, n = nodes(*old), nodes(*new)
    text = lambda c: F.col(c).cast("string")
    a = old[0].select("id", *[text(f).alias(f) for f in fields])
    b = new[0].select("id", *[text(f).alias(f) for f in fields])
    eo, en = children(old[1]), children(new[1])
    if buckets:
        # digests of the edges as they stand may repeat pairs: equal ones are equal either way
        lo, ln = unequal(old[0].select("id").unionByName(old[1].select(F.col("parent").alias("id"))).unionByName(old[1].select(F.col("child").alias("id"))), new[0].select("id").unionByName(new[1].select(F.col("parent").alias("id"))).unionByName(new[1].select(F.col("child").alias("id"))), ["id"], ["id"], buckets)
        o, n = lo.distinct(), ln.distinct()
        eo, en = (x.distinct() for x in unequal(old[1].select("parent", "child"), new[1].select("parent", "child"), ["parent", "child"], ["parent", "child"], buckets))
        a, b = unequal(a, b, ["id"], ["id", *fields], buckets)
    a, b = a.toDF("id", *[f"o_{f}" for f in fields]), b.toDF("id", *[f"n_{f}" for f in fields])
    made = lambda df, kind: df.select(F.lit(kind).alias("kind"), "id", blank.alias("parent"), blank.alias("child"), blank.alias("field"), blank.alias("old"), blank.alias("new"))
    drawn = lambda df, kind: df.select(F.lit(kind).alias("kind"), blank.alias("id"), "parent", "child", blank.alias("field"), blank.alias("old"), blank.alias("new"))
    parts = [made(n.exceptAll(o), "node_added"), made(o.exceptAll(n), "node_removed"), drawn(en.exceptAll(eo), "edge_added"), drawn(eo.exceptAll(en), "edge_removed")]
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"o_{f}").alias("old"), F.col(f"n_{f}").alias("new")) for f in fields]))
    changed = a.join(b, "id").select("id", pairs.alias("x")).filter(~F.col("x.old").eqNullSafe(F.col("x.new")))
    parts.append(changed.select(F.lit("changed").alias("kind"), "id", blank.alias("parent"), blank.alias("child"), "x.field", "x.old", "x.new"))
    return reduce(DataFrame.unionByName, parts)


def diff_overlay(delta: DataFrame) -> DataFrame:
    """(key, mark, lines): added, removed or changed per node or 'parent>child', with a line for each changed field."""
    key = F.coalesce("id", F.concat_ws(">", "parent", "child"))
    mark = F.when(F.col("kind").endswith("added"), "added").when(F.col("kind").endswith("removed"), "removed").otherwise("changed")
    line = F.when(F.col("kind") == "changed", F.concat(F.col("field"), F.lit(": "), F.coalesce("old", F.lit("")), F.lit(" → "), F.coalesce("new", F.lit(""))))
    return delta.groupBy(key.alias("key")).agg(F.min(mark).alias("mark"), F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("lines"))


def thread_view(threads: DataFrame, edges: DataFrame, conversations: DataFrame) -> DataFrame:
    """A row for each thread as it may be shown: adapter, vendor, children, depth, and a flag instead of the path."""
    adapter = conversations.filter("provider <> ''").groupBy(F.col("thread_id").alias("id")).agg(F.min_by("provider", "conversation_id").alias("adapter"))
    return (
        threads.join(adapter, "id", "left").join(fan_out(threads, edges), "id").join(depth(threads, edges), "id", "left")
        .select("id", strip_hidden_chars(F.col("title")).alias("title"), F.coalesce("adapter", F.lit("")).alias("adapter"), F.col("model_provider").alias("vendor"), "tokens_used", "created_at_ms", "child_count", "depth", (F.coalesce("rollout_path", F.lit("")) != "").alias("has_rollout"))
    )


def cross_provider_edges(threads: DataFrame, edges: DataFrame) -> DataFrame:
    """(parent, child, is_cross_provider): both ends' providers known and different."""
    p = threads.select(F.col("id").alias("parent"), F.col("model_provider").alias("a"))
    c = threads.select(F.col("id").alias("child"), F.col("model_provider").alias("b"))
    known = (F.coalesce("a", F.lit("")) != "") & (F.coalesce("b", F.lit("")) != "")
    return children(edges).join(p, "parent", "left").join(c, "child", "left").select("parent", "child", (known & (F.col("a") != F.col("b"))).alias("is_cross_provider"))


def floor_lookup(times: DataFrame, events: DataFrame) -> DataFrame:
    """(t, event): for each t the greatest event at or before it (as-of), null if none; one sorted pass.

    Sorting stays within a minute; what came before is carried along the minutes of a day and then along the days,
    so that no task holds more than a minute's rows, a day's 1,440 minutes or a row a day."""
    both = times.select(F.col("t"), F.lit(None).cast("long").alias("e")).unionByName(events.select(F.col("e").alias("t"), F.col("e").cast("long").alias("e")))
    both = both.withColumn("minute", F.floor(F.col("t") / 60_000))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    minutes = both.groupBy("minute").agg(F.max("e").alias("last")).withColumn("day", F.floor(F.col("minute") / 1_440))
    days = minutes.groupBy("day").agg(F.max("last").alias("last"))
    days = days.select("day", F.max("last").over(earlier(Window.orderBy("day"))).alias("from_days"))
    minutes = minutes.withColumn("from_minutes", F.max("last").over(earlier(Window.partitionBy("day").orderBy("minute"))))
    prior = minutes.join(days, "day").select("minute", F.coalesce("from_minutes", "from_days").alias("carried"))
    within = Window.partitionBy("minute").orderBy("t").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("seen", F.max("e").over(within)).filter("e is null").join(prior, "minute").select("t", F.coalesce("seen", "carried").alias("event"))


def collapse_chains(threads: DataFrame, edges: DataFrame, min_len: int = 3) -> tuple[DataFrame, DataFrame]:
    """Runs of nodes with one child and one parent each, min_len or longer, folded into 'chain:<head>'.

    Returns nodes (id, label, tokens, members, created_at_ms) and edges (parent, child); a chain has the birth of its
    head. A link belongs to a chain if its
    parent has one child and its child one parent. Heads are found by pointer doubling, so a chain of n nodes
    takes log n rounds; a pure cycle has no head and stays as it is."""
    e = stash(children(edges), "edges")
    born = F.max("created_at_ms") if "created_at_ms" in threads.columns else F.max(F.lit(None).cast("long"))
    known = threads.select("id", *[c for c in ("tokens_used", "title", "created_at_ms") if c in threads.columns])
    info = degrees(known, e, F.max("tokens_used").alias("tokens"), F.min("title").alias("title"), born.alias("born"))  # for the nodes alone
    # numbers alone are counted, so that rows are combined before they move without being sorted; names would be sorted
    once = lambda c: e.groupBy(c).agg(F.count(F.lit(1)).alias("n")).filter("n = 1").select(c)
    single = meet(meet(e.filter("parent <> child"), once("parent"), "parent", "left_semi"), once("child"), "child", "left_semi")
    climbed = contraction.climb_from(stash(single.select(F.col("child").alias("id"), F.col("parent").alias("up")), "links"), sums=False)
    members = climbed.filter("up is null").select("id", F.col("top").alias("head"), F.col("steps").alias("hops"))  # the others lie on rings
    long_ = stash(members.groupBy("head").agg((F.count(F.lit(1)) + 1).alias("n")).filter(F.col("n") >= min_len).select("head"), "heads")
    # a head has no link of its own
    folded = meet(members, long_, "head").select("id", "head", "hops").unionByName(long_.select(F.col("head").alias("id"), "head", F.lit(0).cast("long").alias("hops")))
    folded = stash(folded, "folded")
    all_ = meet(info.select("id", "tokens", "title", "born"), folded.select("id", "head", "hops"), "id", "left")
    merged = F.when(F.col("head").isNotNull(), F.concat(F.lit("chain:"), "head")).otherwise(F.col("id"))
    grouped = all_.groupBy(merged.alias("node")).agg(
        F.sum(F.coalesce("tokens", F.lit(0))).cast("long").alias("tokens"),
        F.count(F.lit(1)).alias("size"),
        F.max(F.col("head").isNotNull()).alias("is_chain"),
        F.min_by("title", F.coalesce("hops", F.lit(0))).alias("title"),
        F.min_by("born", F.coalesce("hops", F.lit(0))).alias("created_at_ms"),
        F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("hops", F.lit(0).cast("long")).alias("h"), "id"))), lambda m: m.id).alias("members"),
    )
    out = grouped.select(F.col("node").alias("id"), F.when(F.col("is_chain"), F.concat(F.col("size").cast("string"), F.lit(" in a row"))).otherwise(F.coalesce("title", F.col("node"))).alias("label"), "tokens", "members", "created_at_ms")
    to = lambda c: folded.select(F.col("id").alias(c), F.concat(F.lit("chain:"), "head").alias(f"{c}_to"))
    moved = meet(meet(e, to("parent"), "parent", "left"), to("child"), "child", "left").select(F.coalesce("parent_to", "parent").alias("parent"), F.coalesce("child_to", "child").alias("child"))
    chain_inside = (F.col("parent") == F.col("child")) & F.col("parent").startswith("chain:")
    return out, moved.filter(~chain_inside).distinct()


MORE = "more:"


def cap_fan_out(threads: DataFrame, edges: DataFrame, most: int = 100) -> tuple[DataFrame, DataFrame]:
    """A parent with more than most children keeps the newest most - 1 (undated last, ties by id) and gets
    'more:<parent>' with the number hidden. Nodes that were reachable from a root and no longer are drop out; those of
    components without a root stay. Self-loops are no children and take no root away.

    Returns nodes (id, hidden, title, created_at_ms) and edges (parent, child); a placeholder is titled '+n more' and has its
    parent's birth. A placeholder of an earlier pass is no child either: if threads has a column hidden, its number is added
    to this pass's, so that a second pass changes nothing and a tighter one deepens it."""
    drawn = stash(children(edges).filter("parent <> child"), "edges")
    plain, carried = drawn.filter(~F.col("child").startswith(MORE)), drawn.filter(F.col("child").startswith(MORE))
    born = F.max("created_at_ms") if "created_at_ms" in threads.columns else F.max(F.lit(None).cast("long"))
    title = F.min("title") if "title" in threads.columns else F.lit(None).cast("string")
    number = F.max("hidden") if "hidden" in threads.columns else F.lit(None).cast("long")
    info = threads.groupBy("id").agg(born.cast("long").alias("created_at_ms"), title.alias("title"), number.cast("long").alias("prior"))
    rank = F.row_number().over(Window.partitionBy("parent").orderBy(F.col("created_at_ms").desc_nulls_last(), "child"))
    width = plain.groupBy("parent").agg(F.count(F.lit(1)).alias("width"))
    ranked = plain.join(width, "parent").join(info.select(F.col("id").alias("child"), "created_at_ms"), "child", "left").withColumn("rank", rank)
    kept = stash(ranked.filter((F.col("width") <= most) | (F.col("rank") < most)).select("parent", "child"), "kept")
    cut = width.filter(F.col("width") > most).select("parent", (F.col("width") - max(0, most - 1)).alias("n"))
    earlier = carried.join(info.select(F.col("id").alias("child"), F.col("prior").alias("n")), "child").filter("n > 0").select("parent", "n")
    more = cut.unionByName(earlier).groupBy("parent").agg(F.sum("n").cast("long").alias("hidden"))

    everyone = stash(nodes(threads, edges), "nodes")
    start = lambda ids: ids.select(F.lit("").alias("root"), "id", F.lit(0).alias("dist"))
    top = everyone.join(drawn.select(F.col("child").alias("id")), "id", "left_anti")
    before = stash(spread(start(top), drawn).select("id"), "reached")
    rootless = everyone.join(before, "id", "left_anti")
    stay = stash(spread(start(top.unionByName(rootless)), kept).select("id").filter(~F.col("id").startswith(MORE)), "visible")
    more = more.join(stay.select(F.col("id").alias("parent")), "parent", "left_semi")
    own = stay.join(info, "id", "left").select("id", F.lit(0).cast("long").alias("hidden"), F.coalesce("title", F.lit("")).alias("title"), "created_at_ms")
    signs = more.join(info.select(F.col("id").alias("parent"), "created_at_ms"), "parent", "left")
    signs = signs.select(F.concat(F.lit(MORE), "parent").alias("id"), "hidden", F.concat(F.lit("+"), F.col("hidden").cast("string"), F.lit(" more")).alias("title"), "created_at_ms")
    kept_edges = induced_edges(kept, stay).select("parent", "child").unionByName(more.select("parent", F.concat(F.lit(MORE), "parent").alias("child")))
    return own.unionByName(signs), kept_edges


def fold_subtree(threads: DataFrame, edges: DataFrame, node: str) -> tuple[DataFrame, DataFrame]:
    """Everything below node in one 'subtree:<node>' that carries the sum of tokens; edges are re-pointed."""
    below = stash(subtree(edges, node).select("id"), "below")
    tokens = threads.groupBy("id").agg(F.max("tokens_used").alias("tokens"))
    name = f"subtree:{node}"
    inside = below.withColumn("inside", F.lit(True))
    all_ = nodes(threads, edges).join(tokens, "id", "left").join(inside, "id", "left")
    to = F.when(F.col("inside"), name).otherwise(F.col("id"))
    out = all_.groupBy(to.alias("id")).agg(F.sum(F.coalesce("tokens", F.lit(0))).cast("long").alias("tokens"), F.count(F.lit(1)).alias("size"))
    at = lambda c: inside.select(F.col("id").alias(c), F.col("inside").alias(f"{c}_in"))
    moved = children(edges).join(at("parent"), "parent", "left").join(at("child"), "child", "left")
    pick = lambda c: F.when(F.col(f"{c}_in"), name).otherwise(F.col(c)).alias(c)
    return out, moved.select(pick("parent"), pick("child")).filter(F.col("parent") != F.col("child")).distinct()


def drawn_view(threads: DataFrame, edges: DataFrame, aggregated: bool = True, most: int = 100) -> tuple[DataFrame, DataFrame]:
    """Chains folded, then wide parents capped."""
    if not aggregated:
        return cap_fan_out(threads, edges, most)
    n, e = collapse_chains(threads, edges)
    n = stash(n.select("id", F.col("tokens").alias("tokens_used"), "created_at_ms"), "chain-nodes")
    return cap_fan_out(n, stash(e, "chain-edges"), most)


