"""Short boilerplate lines count like long ones, unless a cut is asked for."""

from threadloom.llm import line_dedup


def test_short_lines(spark):
    rows = [(i, f"Log in\nown text of {i}\n\n  Log in \nx", f"site{i % 12}") for i in range(24)] + [(90 + i, "rare", f"site{i % 9}") for i in range(18)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: (r.n_removed, r.clean_text) for r in line_dedup.dedup_lines(docs).collect()}
    assert got == {i: (3, f"own text of {i}\n") for i in range(24)} | {90 + i: (0, "rare") for i in range(18)}
    assert not any(r.n_removed for r in line_dedup.dedup_lines(docs, min_chars=20).collect())
