"""Rounds and joins of the graph operators: as many as the graph's depth asks for, and no table that grows through the driver."""

from threadloom.operators import contraction, graph
from threadloom.plans import queries
from threadloom.session import meet, stash


def counted(monkeypatch):
    made = []
    for module in (graph, contraction):
        monkeypatch.setattr(module, "stash", lambda df, name="t", keep=module.stash: (made.append(name), keep(df, name))[1])
    return made


def rings(spark, n):
    """n rings of five with a tail of two each."""
    e = spark.range(5 * n).selectExpr("concat('r', id) as parent", "concat('r', id - id % 5 + (id + 1) % 5) as child")
    tails = spark.range(2 * n).selectExpr("if(id % 2 = 0, concat('r', 5 * (id div 2)), concat('t', id - 1)) as parent", "concat('t', id) as child")
    return e.unionByName(tails)


def test_rings_end_the_rounds_of_climbing(spark, monkeypatch):
    e, made = stash(rings(spark, 200)), counted(monkeypatch)
    up = contraction.climb(contraction.single_links(e), sums=False)
    assert len(made) < 9
    assert up.filter("up is not null").count() == up.count() == 1400
    assert up.filter("up like 't%'").isEmpty()


def test_depths_below_rings(spark):
    e = rings(spark, 3)
    t = e.selectExpr("child as id").distinct()
    found = {r.id: r.depth for r in graph.depth(t, e).collect()}
    assert found == {f"r{i}": 5 for i in range(15)} | {f"t{i}": 6 + i % 2 for i in range(6)}


def test_stashed_tables_are_not_broadcast(spark):
    a, b = stash(spark.range(1000).selectExpr("id", "id as x")), stash(spark.range(1000).selectExpr("id", "id as y"))
    plain = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" in plain(a.join(b, "id")) and "Broadcast" not in plain(meet(a, b, "id"))


def chains(spark, n):
    """n chains of four, each beside a lone pair."""
    e = spark.range(3 * n).selectExpr("concat('c', id div 3, '-', id % 3) as parent", "concat('c', id div 3, '-', id % 3 + 1) as child")
    return e.unionByName(spark.range(n).selectExpr("concat('p', id, '-0') as parent", "concat('p', id, '-1') as child"))


def test_short_chains_fold_in_few_rounds(spark, monkeypatch):
    e = stash(chains(spark, 300))
    t = e.selectExpr("parent as id").unionByName(e.selectExpr("child as id")).distinct().selectExpr("id", "id as title", "1L as tokens_used")
    made = counted(monkeypatch)
    n, kept = graph.collapse_chains(t, e)
    assert len(made) < 12
    assert n.filter("id like 'chain:%-0' and tokens = 4 and size(members) = 4").count() == 300 and n.count() == 900
    assert kept.count() == kept.filter("parent like 'p%'").count() == 300


def test_a_forest_is_rolled_up_in_one_pass_over_its_edges(spark, monkeypatch):
    e = stash(chains(spark, 300))
    t = e.selectExpr("parent as id").unionByName(e.selectExpr("child as id")).distinct().selectExpr("id", "1L as tokens_used")
    made = counted(monkeypatch)
    r = graph.rollup(t, e)
    assert made.count("jumps") == 0 and len(made) < 10
    assert r.count() == 1800 and r.filter("id like '%-0' and subtree_tokens = if(id like 'c%', 4, 2) and max_depth = subtree_tokens - 1").count() == 600


def test_edges_of_a_folded_graph_need_no_pass_over_its_nodes(spark, monkeypatch):
    e = stash(chains(spark, 300).unionByName(spark.range(5).selectExpr("concat('o', id) as parent", "concat('o', (id + 1) % 5) as child")))
    e = e.unionByName(spark.sql("select 'p0-1' as parent, 'p0-1' as child"))
    t = e.selectExpr("child as id", "child as title", "1L as tokens_used").distinct()
    made = counted(monkeypatch)
    n, kept = graph.collapse_chains(t, e)
    assert "nodes" not in made and made.count("folded") == 1
    assert kept.count() == 306 and kept.filter("parent like 'p%'").count() == 301 and kept.filter("parent like 'o%'").count() == 5
    assert n.filter("id like 'chain:c%-0' and size(members) = 4 and members[0] like 'c%-0' and members[3] like 'c%-3'").count() == 300 and n.count() == 905


def test_rings_of_suppliers_are_joined_without_the_driver(spark):
    for df in (queries._rings(spark, "/root/testdata/sf0.001")[1], queries.g4_strong_components(spark, "/root/testdata/sf0.001")):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
