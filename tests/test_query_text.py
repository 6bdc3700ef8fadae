"""What users type into the search box, media paths, and wide parents."""

import pytest
from pyspark.sql import functions as F

from threadloom.functions.scalars import is_local_media_path
from threadloom.operators import graph
from threadloom.operators.search import Clause, parse_query


@pytest.mark.parametrize("text,want", [
    ("file.py", [Clause(("file",)), Clause(("py",))]),
    ("src/a-b_c.py*", [Clause(("src",)), Clause(("a",)), Clause(("b",)), Clause(("c",)), Clause(("py",), prefix=True)]),
    ('"of the" and', [Clause(("of", "the")), Clause(("and",))]),
    ('"of th"*', [Clause(("of", "th"), prefix=True)]),
    ('"of th"* x*', [Clause(("of", "th"), prefix=True), Clause(("x",), prefix=True)]),
    ('"a" *', [Clause(("a",))]),
    ('"unclosed words', [Clause(("unclosed", "words"))]),
    ('"in*side"', [Clause(("in", "side"))]),
    ('a"b c"d', [Clause(("a",)), Clause(("b", "c")), Clause(("d",))]),
    ('""', []), ('"', []), ("* ( AND/", [Clause(("and",))]), ("", []), (None, []),
])
def test_query_text(text, want):
    assert parse_query(text) == want


def test_media_paths(spark):
    given = {
        "media/a.png": True, "a.png": True, "a/b:c.png": True, "x..y/z": True,
        "": False, None: False, "data:text/html,x": False, "javascript:alert(1)": False, "C:/x": False, "c:x": False, "http://h/x": False, "a/http://h": False,
        "/etc": False, "//h/x": False, "\\\\h\\x": False, "/\\h/x": False, "../x": False, "a/../x": False, "a\\..\\x": False, "mailto:x": False,
    }
    df = spark.createDataFrame([(p, w) for p, w in given.items()], "p string, want boolean")
    assert [r.p for r in df.filter(is_local_media_path(F.col("p")) != F.col("want")).collect()] == []


def capped(spark, edges, most, threads=(), hidden=()):
    t = spark.createDataFrame([(*x, dict(hidden).get(x[0])) for x in threads] or [("-", "", None, None)], "id string, title string, created_at_ms long, hidden long").filter("id <> '-'")
    e = spark.createDataFrame([(p, c, "") for p, c in edges], "parent string, child string, status string")
    n, ed = graph.cap_fan_out(t, e, most)
    return {r.id: r.hidden for r in n.collect()}, {tuple(r) for r in ed.collect()}, n, ed


def test_self_loops_are_no_children(spark):
    n, e, *_ = capped(spark, [("p", "p"), ("p", "a"), ("p", "b")], 2)
    assert (n, e) == ({"p": 0, "a": 0, "b": 0}, {("p", "a"), ("p", "b")})


def test_earlier_placeholders_are_held_apart(spark):
    n, e, *_ = capped(spark, [("p", "b"), ("p", "c"), ("p", "more:p")], 2, [("more:p", "+4 more", None)], [("more:p", 4)])
    assert (n, e) == ({"p": 0, "b": 0, "c": 0, "more:p": 4}, {("p", "b"), ("p", "c"), ("p", "more:p")})


def test_a_second_pass_changes_nothing_and_a_tighter_one_deepens(spark):
    threads = [("r", "root", 50)] + [(f"k{i}", f"t{i}", i * 10 or None) for i in range(6)]
    edges = [("r", f"k{i}") for i in range(6)] + [("k0", "deep"), ("x", "y"), ("y", "x"), ("r", "r")]
    n, e, nodes, ed = capped(spark, edges, 3, threads)
    assert n == {"r": 0, "k5": 0, "k4": 0, "more:r": 4, "x": 0, "y": 0} and ("x", "y") in e and ("y", "x") in e
    sign = nodes.filter("id = 'more:r'").first()
    assert (sign.title, sign.created_at_ms) == ("+4 more", 50)
    again = graph.cap_fan_out(nodes, ed.withColumn("status", F.lit("")), 3)
    assert {r.id: r.hidden for r in again[0].collect()} == n and {tuple(r) for r in again[1].collect()} == e
    tighter = graph.cap_fan_out(nodes, ed.withColumn("status", F.lit("")), 1)
    assert {r.id: (r.hidden, r.title) for r in tighter[0].collect()}["more:r"] == (6, "+6 more")


def test_hidden_children_stay_where_another_way_leads_to_them(spark):
    n, e, *_ = capped(spark, [("p", "a"), ("p", "b"), ("p", "c"), ("q", "c"), ("c", "d"), ("u", "v"), ("v", "u"), ("v", "b")], 2)
    assert n == {"p": 0, "a": 0, "q": 0, "c": 0, "d": 0, "u": 0, "v": 0, "b": 0, "more:p": 2} and ("q", "c") in e and ("v", "b") in e
