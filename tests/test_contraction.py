"""Depths, roll-ups and cycles by doubling and contraction, against plain walks."""

import random

from threadloom.operators import contraction, graph

SHAPES = {
    "ring": [("a", "b"), ("b", "c"), ("c", "a")],
    "ring with a tail": [("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("c", "e")],
    "loop below a root": [("r", "x"), ("x", "y"), ("y", "z"), ("z", "x"), ("z", "q")],
    "two rings": [("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "c"), ("s", "s"), ("s", "t")],
    "cycle through a stretch": [("r", "m"), ("m", "p"), ("p", "q"), ("q", "m"), ("q", "u"), ("r", "n"), ("u", "n")],
    "ladder": [(f"n{i}", f"n{i + d}") for i in range(8) for d in (1, 2)],
    "diamonds": [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e"), ("d", "f"), ("e", "g"), ("f", "g"), ("g", "h")],
    "two shared": [("a", "x"), ("b", "x"), ("x", "y"), ("b", "z"), ("y", "z"), ("z", "w"), ("c", "w")],
}


def of(spark, edges, extra=()):
    ids = sorted({n for e in edges for n in e} | set(extra))
    t = spark.createDataFrame([(n, "", i % 7, None) for i, n in enumerate(ids)], "id string, title string, tokens_used long, created_at_ms long")
    return t, spark.createDataFrame([(a, b, "") for a, b in edges], "parent string, child string, status string"), ids


def reach(edges, n):
    """Shortest distances from n."""
    down = {}
    for a, b in edges:
        down.setdefault(a, set()).add(b)
    dist, todo = {n: 0}, [n]
    for x in todo:
        for y in down.get(x, ()):
            if y not in dist:
                dist[y] = dist[x] + 1
                todo.append(y)
    return dist


def check(spark, edges, extra=()):
    t, e, ids = of(spark, edges, extra)
    far = {n: reach(edges, n) for n in ids}
    kids = {n: {b for a, b in edges if a == n} for n in ids}
    girth = {n: min((far[k][n] + 1 for k in kids[n] if n in far[k]), default=None) for n in ids}
    starts = {n: 0 for n in ids if not any(b == n for _, b in edges)} | {n: g for n, g in girth.items() if g}
    want = {n: min(d + far[s][n] for s, d in starts.items() if n in far[s]) for n in ids}
    assert {r.id: r.depth for r in graph.depth(t, e).collect()} == want
    tokens = {n: i % 7 for i, n in enumerate(ids)}
    sums = {n: (tokens[n], sum(tokens[x] for x in far[n]), len(far[n]), max(far[n].values()), len(kids[n])) for n in ids}
    assert {r[0]: tuple(r)[1:] for r in graph.rollup(t, e).collect()} == sums
    found = {r.id: r.component for r in contraction.strong_components(e).collect()}
    assert set(found) == {n for n in ids if girth[n]}
    for a in found:
        for b in found:
            assert (found[a] == found[b]) == (b in far[a] and a in far[b])


def some(seed):
    """A random graph, without cycles for even seeds."""
    rng, n = random.Random(seed), 25
    edges = {(f"n{rng.randrange(max(1, i - 6), i + 1)}", f"n{i + 1}") for i in range(1, n) if rng.random() < 0.9}
    edges |= {(f"n{a}", f"n{b}") for a, b in (sorted(rng.sample(range(1, n), 2)) for _ in range(2 * (seed // 2)))}
    return sorted(edges | {(f"n{b}", f"n{a}") for a, b in (sorted(rng.sample(range(1, n), 2)) for _ in range(2 * (seed % 2)))})


def beside(graphs):
    """Graphs side by side, with names of their own."""
    return [(f"{k}/{a}", f"{k}/{b}") for k, edges in enumerate(graphs) for a, b in edges]


def test_graphs_without_cycles(spark):
    check(spark, beside([SHAPES["ladder"], SHAPES["diamonds"], SHAPES["two shared"], *map(some, (0, 2, 4, 6))]), ["alone"])


def test_graphs_with_cycles(spark):
    check(spark, beside([*SHAPES.values(), *map(some, (1, 3, 5))]), ["alone"])


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    n, made = 20_000, []
    for module in (graph, contraction):
        monkeypatch.setattr(module, "stash", lambda df, name="t", keep=module.stash: (made.append(name), keep(df, name))[1])
    t = spark.range(n + 1).selectExpr("cast(id as string) as id", "'' as title", "1L as tokens_used", "id as created_at_ms")
    e = spark.range(n).selectExpr("cast(id as string) as parent", "cast(id + 1 as string) as child", "'' as status")
    deep = graph.depth(t, e)
    assert deep.filter("depth <> cast(id as int)").count() == 0 and deep.count() == n + 1
    assert graph.rollup(t, e).filter(f"subtree_tokens <> {n + 1} - cast(id as int) or subtree_count <> subtree_tokens or max_depth <> {n} - cast(id as int)").count() == 0
    assert len(made) < 90
