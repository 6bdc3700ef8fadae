"""Gated graph export and the research payload."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.operators import graph, privacy
from threadloom.operators.filters import VIEW_COLUMNS, metadata_view
from threadloom.operators.stats import aggregate_stats
from threadloom.sources.versions import announce, newest, remove

TEXT_COLUMNS = ["title", "model_provider", "git_branch", "cwd", "agent_role", "agent_nickname", "preview", "rollout_path"]
MODES = ("full", "shareable")
VERSION = 1


def export_graph(threads: DataFrame, edges: DataFrame, mode: str, home: str = "", scrub: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, findings): hidden characters stripped, the mode's projection, the credential scan, and only
    if asked for the scrub. Findings are of what is exported before scrubbing. An unknown mode is refused."""
    if mode not in MODES:
        raise ValueError(f"unknown export mode: {mode!r}")
    n = privacy.sanitize_columns(threads, TEXT_COLUMNS)
    e = privacy.sanitize_columns(edges, ["status"])
    if mode == "shareable":
        n = privacy.shareable_threads(n, home)
    findings = privacy.scan_credentials(n, "thread", "id", TEXT_COLUMNS)
    if scrub:
        n = n.withColumns({c: privacy.scrub_credentials(F.col(c)) for c in TEXT_COLUMNS})
    return n, e, findings


def export_plan(nodes: DataFrame, edges: DataFrame, findings: DataFrame) -> DataFrame:
    """One row: nodes, edges, estimated bytes of their JSON, findings."""
    size = lambda df, name: df.agg(F.count(F.lit(1)).alias(name), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*[F.col(c) for c in df.columns])))), F.lit(0)).alias(f"{name}_bytes"))
    return size(nodes, "nodes").crossJoin(size(edges, "edges")).crossJoin(findings.agg(F.count(F.lit(1)).alias("findings"))).select("nodes", "edges", (F.col("nodes_bytes") + F.col("edges_bytes")).alias("bytes"), "findings")


def write_graph_artifact(nodes: DataFrame, edges: DataFrame, path: str, mode: str) -> None:
    """Sorted JSON lines under path/nodes and path/edges, and a one-row manifest with version and mode."""
    line = lambda df: F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]), {"ignoreNullFields": "false"}).alias("value")
    nodes.orderBy("id").select(line(nodes)).write.mode("overwrite").text(f"{path}/nodes")
    edges.orderBy("parent", "child").select(line(edges)).write.mode("overwrite").text(f"{path}/edges")
    nodes.sparkSession.createDataFrame([(VERSION, mode)], "version int, mode string").coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def read_graph_artifact(spark: SparkSession, path: str, nodes_like: DataFrame, edges_like: DataFrame) -> tuple[DataFrame, DataFrame]:
    return spark.read.schema(nodes_like.schema).json(f"{path}/nodes").select(*nodes_like.columns), spark.read.schema(edges_like.schema).json(f"{path}/edges").select(*edges_like.columns)


#: Buckets of digests by which what was written is compared with what was meant.
GATE_BUCKETS = 4096


def graph_gate(nodes: DataFrame, edges: DataFrame, staging: str, mode: str) -> bool:
    """Write to staging, read back and compare; true, to publish, only if the diff is empty."""
    write_graph_artifact(nodes, edges, staging, mode)
    back = read_graph_artifact(nodes.sparkSession, staging, nodes, edges)
    fields = [c for c in nodes.columns if c != "id"]
    return graph.diff((nodes, edges), back, fields, GATE_BUCKETS).isEmpty()


def publish_graph(nodes: DataFrame, edges: DataFrame, root: str, mode: str, pages_gate: DataFrame | None = None, findings: DataFrame | None = None) -> dict:
    """Publish a graph in two steps: write it as a version of its own, then name it in a new manifest, if all gates pass.

    The gates: the written graph read back has no diff, and no page of pages_gate (conversation_id, ok, missing), as the
    fidelity gate gives it, lacks a word. Until the manifest is whole, and whenever a gate fails, readers see the version before; a version
    that failed is removed. Findings are counted, and stop nothing. Returns the report: ok, version, graph_ok, pages_failed,
    findings; what is missing stays a table."""
    spark = nodes.sparkSession
    version = f"version-{uuid.uuid4().hex}"
    graph_ok = graph_gate(nodes, edges, f"{root}/{version}", mode)
    failed = 0 if pages_gate is None else pages_gate.filter(~F.col("ok")).count()
    report = {"ok": graph_ok and not failed, "version": version, "graph_ok": graph_ok, "pages_failed": failed, "findings": 0 if findings is None else findings.count()}
    if not report["ok"]:
        remove(spark, f"{root}/{version}")
        return report
    announce(spark, root, version)
    return report


def read_published(spark: SparkSession, root: str, nodes_like: DataFrame, edges_like: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """(nodes, edges) of the published version."""
    version = newest(spark, root)
    return None if version is None else read_graph_artifact(spark, f"{root}/{version}", nodes_like, edges_like)


def research_payload(index: DataFrame) -> tuple[DataFrame, DataFrame]:
    view = metadata_view(index)
    return view, aggregate_stats(view)


def research_prompt(view: DataFrame, instruction: str, batch: Column | None = None) -> DataFrame:
    """(batch, prompt): text from the allow-listed fields only, with key-sorted histograms, per bounded batch."""
    v = view.select(*VIEW_COLUMNS).withColumn("batch", F.lit(0) if batch is None else batch)
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    row = F.concat(*[x for c in VIEW_COLUMNS for x in (F.lit(("- " if c == "conversation_id" else "\n  ") + c + ": "), number(c).cast("string") if c.endswith("_count") else text(c))])
    base = v.groupBy("batch").agg(
        F.count(F.lit(1)).alias("n"), F.sum(number("turn_count")).alias("t"), F.sum(number("char_count")).alias("c"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("conversation_id", row.alias("r")))), lambda x: x.r), "\n").alias("rows"),
    )
    for facet in ("provider", "account"):
        counts = v.groupBy("batch", text(facet).alias("k")).agg(F.count(F.lit(1)).alias("k_n"))
        hist = counts.groupBy("batch").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "k_n"))), lambda x: F.concat(x.k, F.lit("="), x.k_n.cast("string"))), ", ").alias(f"by_{facet}"))
        base = base.join(hist, "batch")
    intro = "Below are figures about conversations, one entry each: ids, dates, sizes. Nothing that was written in them is included, so rely on these figures and on nothing else."
    prompt = F.concat(F.lit(f"{instruction}\n\n{intro}\n\n## Aggregate\nconversations: "), "n", F.lit("\ntotal_turns: "), "t", F.lit("\ntotal_chars: "), "c", F.lit("\nby_provider: "), "by_provider", F.lit("\nby_account: "), "by_account", F.lit("\n\n## Conversations\n"), "rows")
    return base.select("batch", prompt.alias("prompt"))


def parse_entities(col: Column) -> Column:
    """Names in a reply, split at commas and line breaks, trimmed of blanks, dashes and tabs, each once, in order."""
    parts = F.transform(F.split(F.coalesce(col, F.lit("")), "[,\n]"), lambda s: F.btrim(s, F.lit(" -\t")))
    return F.array_distinct(F.filter(parts, lambda s: s != ""))


def synthesize(prompts: DataFrame, backend: Callable[[str], str] = lambda prompt: "") -> list[tuple[int, str]]:
    """Hand each batch's prompt to a callable; the default backend answers nothing. Prompts stream to the driver."""
    return [(r["batch"], backend(r["prompt"])) for r in prompts.orderBy("batch").toLocalIterator()]
