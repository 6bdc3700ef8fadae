"""Task exports: threads of turns with input or output items (messages, pull requests, repository snapshots)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.sources.jsonl import at

CITATIONS = "array<struct<title:string,url:string>>"
BLOCK = f"struct<type:string,text:string,data:string,citations:{CITATIONS}>"
#: Fixed names of a diff's figures and of what is known of a turn.
DIFF_FIGURES = ("base_commit_sha", "repo_id", "type", "files_modified", "lines_added", "lines_removed", "additional_parent_commit_shas", "preapply_patch_base_commit_sha")
TURN_FIELDS = ("pull_request_status", "branch", "branch_name", "previous_turn_id", "external_pull_request_id")
PART = "struct<content_type:string,text:string,path:string,line_range_start:string,line_range_end:string,terminal_chunk_id:string,asset_pointer:string,width:long,height:long,size_bytes:long>"
FILES = "array<struct<path:string,missing_reason:string,contents:string,line_range_contents:array<struct<line_range_start:long,line_range_end:long,contains_end_of_file:boolean,content:variant>>>>"


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _block(kind: str, text: Column | str = "", data: Column | None = None, citations: Column | None = None) -> Column:
    text = F.lit(text) if isinstance(text, str) else F.coalesce(text, F.lit(""))
    nothing = F.lit(None)
    return F.struct(F.lit(kind).alias("type"), text.alias("text"), (nothing if data is None else data).cast("string").alias("data"), (nothing if citations is None else citations).cast(CITATIONS).alias("citations"))


def _none() -> Column:
    return F.array().cast(f"array<{BLOCK}>")


def _when(condition: Column, blocks: Column) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), blocks).otherwise(_none())


def _data(**fields: Column) -> Column:
    """JSON with all fields, those that are null too."""
    return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]), {"ignoreNullFields": "false"})


def _variant(json: Column, path: str) -> Column:
    return F.try_variant_get(F.try_parse_json(json), path, "variant")


def _elements(json: Column, path: str) -> Column:
    """The elements of an array as JSON texts; null where there is no array."""
    return F.transform(F.try_variant_get(F.try_parse_json(json), path, "array<variant>"), lambda v: F.to_json(v))


def _string(json: Column, field: str) -> Column:
    return F.coalesce(F.get_json_object(json, f"$.{field}"), F.lit(""))


def _said(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\S"), F.lit(False))


def _texts(json: Column, *fields: str) -> Column:
    return F.transform(F.filter(F.array(*[_string(json, f) for f in fields]), _said), lambda t: _block("text", t))


def _unknown(kind: Column, raw: Column) -> Column:
    return _block("unknown", "", F.to_json(F.struct(kind.alias("orig_type"), raw.alias("x_raw"))))


def part_blocks(parts: Column) -> Column:
    """Blocks of a message's parts (JSON texts): a citation goes to the last text before it, or stays as a file where
    there is none; blank texts are left out, what is not known is kept whole."""
    span = lambda x: F.concat(F.lit(":L"), F.coalesce(x.f.line_range_start, F.lit("None")), F.lit("-L"), F.coalesce(x.f.line_range_end, F.lit("None")))
    is_text = lambda x: F.coalesce(x.f.content_type == "text", F.lit(False))
    is_said = lambda x: is_text(x) & _said(x.f.text)

    def label(x: Column) -> Column:
        file = F.concat(F.coalesce(x.f.path, F.lit("")), span(x))
        terminal = F.concat(F.lit("terminal "), F.coalesce(x.f.terminal_chunk_id, F.lit("")), span(x))
        return F.when(x.f.content_type == "repo_file_citation", file).when(x.f.content_type == "terminal_chunk_citation", terminal)

    def marked(ps: Column) -> Column:
        said = F.filter(F.transform(ps, lambda x, i: F.when(is_said(x), i)), lambda i: i.isNotNull())
        return _let(said, lambda spots: F.transform(ps, lambda x, i: F.struct(x.f.alias("f"), x.j.alias("j"), label(x).alias("label"), F.array_max(F.filter(spots, lambda t: t < i)).alias("to"))))

    def block(ps: Column) -> Column:
        cited = lambda i: F.transform(F.filter(ps, lambda c: c.label.isNotNull() & (c.to == i)), lambda c: F.struct(c.label.alias("title"), F.lit(None).cast("string").alias("url")))
        media = lambda x: F.to_json(F.struct(x.f.asset_pointer.alias("path"), x.f.width.alias("width"), x.f.height.alias("height"), x.f.size_bytes.alias("size_bytes")))
        each = F.transform(ps, lambda x, i: (
            F.when(is_said(x), _block("text", x.f.text, citations=cited(i)))
            .when(is_text(x) | (x.label.isNotNull() & x.to.isNotNull()), F.lit(None))
            .when(x.label.isNotNull(), _block("file", x.label, F.to_json(F.struct(x.label.alias("file_name")))))
            .when(x.f.content_type == "image_asset_pointer_citation", _block("media", x.f.asset_pointer, media(x)))
            .otherwise(_unknown(x.f.content_type, x.j))
        ))
        return F.filter(each, lambda y: y.isNotNull())

    objects = F.transform(F.filter(parts, lambda j: j.startswith("{")), lambda j: F.struct(F.from_json(j, PART).alias("f"), j.alias("j")))
    return _let(_let(objects, marked), block)


def message_blocks(item: Column) -> Column:
    text = F.coalesce(F.get_json_object(item, "$.text"), F.get_json_object(item, "$.content"))
    return F.coalesce(part_blocks(_elements(item, "$.content")), F.array(_block("text", text)))


def request_info_blocks(item: Column) -> Column:
    """What a user hands in of a pull request: its title and description as text, and what it points to."""
    given = _data(base_ref=_variant(item, "$.base_ref"), head_ref=_variant(item, "$.head_ref"), merge_commit_sha=_variant(item, "$.merge_commit_sha"))
    return F.concat(_texts(item, "title", "body"), F.array(_block("tool_use", "", _named("pull_request_info", "input", given))))


def _named(name: Column | str, field: str, json: Column) -> Column:
    """JSON with a name and a field that is itself JSON."""
    return F.to_json(F.struct((F.lit(name) if isinstance(name, str) else name).alias("name"), F.try_parse_json(json).alias(field)))


def request_blocks(item: Column, turn: Column) -> Column:
    """What a turn puts into a pull request: title, message, patch, diff and figures. A diff that is stored elsewhere is a file
    without bytes, not an empty diff."""
    language = F.lit('{"language":"diff"}')
    patch, diff = _string(item, "pre_apply_patch"), _string(item, "output_diff.diff")
    is_object = F.coalesce(F.get_json_object(item, "$.output_diff").startswith("{"), F.lit(False))
    away = F.concat(F.lit("diff (external storage: file_id="), F.coalesce(F.get_json_object(item, "$.output_diff.external_storage_diff.file_id"), F.lit("None")), F.lit(", ttl="), F.coalesce(F.get_json_object(item, "$.output_diff.external_storage_diff.ttl"), F.lit("None")), F.lit(")"))
    offloaded = ~_said(diff) & F.coalesce(F.get_json_object(item, "$.output_diff.external_storage_diff").startswith("{"), F.lit(False))
    figures = _data(**{k: _variant(item, f"$.output_diff.{k}") for k in DIFF_FIGURES})
    inside = F.concat(
        _texts(item, "output_diff.commit_message"),
        _when(_said(diff), F.array(_block("code", diff, language))),
        _when(offloaded, F.array(_block("file", "diff (external storage)", F.to_json(F.struct(away.alias("file_name")))))),
        F.array(_block("tool_use", "", _named("pr_diff_stats", "input", figures))),
    )
    return F.concat(
        _texts(item, "pr_title", "pr_message"),
        _when(_said(patch), F.array(_block("code", patch, language))),
        F.when(is_object, inside).otherwise(F.array(_unknown(F.lit("output_diff"), F.get_json_object(item, "$.output_diff")))),
        F.array(_block("tool_use", "", _named("pull_request", "input", _data(**{k: _string(turn, k) for k in TURN_FIELDS})))),
    )


def snapshot_blocks(item: Column) -> Column:
    """A file excerpt each: an attachment with its ranges, or an error that says why it is missing."""

    def one(f: Column) -> Column:
        path = F.coalesce(f.path, F.lit(""))
        number = lambda n: F.coalesce(n.cast("string"), F.lit("None"))
        lines = lambda c: F.coalesce(F.array_join(F.try_variant_get(c, "$", "array<string>"), "\n"), F.try_variant_get(c, "$", "string"), F.lit(""))
        given = F.filter(F.coalesce(f.line_range_contents, F.array().cast("array<struct<line_range_start:bigint,line_range_end:bigint,contains_end_of_file:boolean,content:variant>>")), lambda r: r.isNotNull())
        excerpts = F.array_join(F.transform(given, lambda r: F.concat(F.lit("L"), number(r.line_range_start), F.lit("-L"), number(r.line_range_end), F.lit("\n"), lines(r.content))), "\n")
        body = F.coalesce(F.nullif(f.contents, F.lit("")), excerpts)
        ranges = F.transform(given, lambda r: F.struct(r.line_range_start.alias("line_range_start"), r.line_range_end.alias("line_range_end"), F.coalesce(r.contains_end_of_file, F.lit(False)).alias("contains_end_of_file")))
        extension = F.regexp_extract(path, r"[^/]*[^/.][^/]*\.([^./]*)$", 1)
        whole = _data(file_name=path, file_type=extension, file_size=F.length(body), extracted_content=body, ranges=ranges)
        missing = _data(name=F.concat(F.lit("repo_snapshot "), path), is_error=F.lit(True), content=f.missing_reason)
        return F.when(F.coalesce(f.missing_reason, F.lit("")) != "", _block("tool_result", "", missing)).otherwise(_block("attachment", path, whole))

    files = F.filter(F.from_json(F.get_json_object(item, "$.files"), FILES), lambda f: f.isNotNull())
    return F.coalesce(F.transform(files, one), _none())


def item_blocks(item: Column, turn: Column) -> Column:
    kind = F.get_json_object(item, "$.type")
    return (
        F.when(kind == "message", message_blocks(item))
        .when(kind == "pull_request_info", request_info_blocks(item))
        .when(kind == "partial_repo_snapshot", snapshot_blocks(item))
        .when(kind == "pr", request_blocks(item, turn))
        .otherwise(F.array(_unknown(kind, item)))
    )


def turn_status(turn: Column) -> Column:
    """COMPLETED, FAILED and so on, without the name of an enumeration before it."""
    return F.element_at(F.split(_string(turn, "turn_status"), r"\."), -1)


def provenance(turn: Column) -> Column:
    return F.struct(_string(turn, "id").alias("id"), turn_status(turn).alias("turn_status"), *[_string(turn, k).alias(k) for k in TURN_FIELDS])


def turn_blocks(turn: Column, user: Column) -> Column:
    """All blocks of a turn: standing instructions or an unfinished status first, then its items."""
    status, standing = turn_status(turn), _string(turn, "custom_instructions")
    state = _data(name=F.concat(F.lit("task "), status), is_error=status == "FAILED", content=provenance(turn))
    given = F.coalesce(F.when(user, _elements(turn, "$.input_items")).otherwise(_elements(turn, "$.output_items")), F.array().cast("array<string>"))
    items = F.filter(given, lambda j: j.startswith("{"))
    first = F.when(user, _when(_said(standing), F.array(_unknown(F.lit("custom_instructions"), standing)))).otherwise(_when(status != "COMPLETED", F.array(_block("tool_result", "", state))))
    return F.concat(first, F.flatten(F.transform(items, lambda j: item_blocks(j, turn))))


def task_tables(records: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(conversations, blocks, census) of records (json), a thread each. A turn stays even without blocks, as one empty text.

    census: what is known of each assistant turn, with the thread's archived flag and the first branch named."""
    each = records.select(at("id").alias("conversation_id"), at("title").alias("title"), at("created_at").alias("created_at"), (at("archived") == "true").alias("archived"), F.posexplode_outer(F.filter(_elements(F.col("json"), "$.turns"), lambda j: j.startswith("{"))).alias("turn_idx", "turn"))
    heads = each.groupBy("conversation_id").agg(F.first("title").alias("title"), F.first("created_at").alias("created_at"))
    stamp = F.col("created_at")
    conversations = heads.select("conversation_id", F.coalesce(F.nullif("title", F.lit("")), F.lit("(untitled)")).alias("title"), F.lit("codex-tasks").alias("provider"), F.lit("").alias("account"), F.lit("").alias("thread_id"), "created_at", stamp.alias("updated_at"))
    turn = F.col("turn")
    turns = each.filter("turn is not null").withColumn("user", _string(turn, "role") == "user")
    found = turns.select("conversation_id", "turn_idx", F.when(F.col("user"), "human").otherwise("assistant").alias("role"), F.posexplode_outer(turn_blocks(turn, F.col("user"))).alias("block_idx", "b"), _string(turn, "id").alias("uuid"), stamp.alias("ts"))
    full = found.withColumn("block_idx", F.coalesce("block_idx", F.lit(0))).withColumn("b", F.coalesce("b", _block("text")))
    blocks = full.select("conversation_id", "turn_idx", "role", "block_idx", "b.type", "b.text", "b.data", "uuid", "ts", "b.citations")
    census = turns.filter("not user").select("conversation_id", "turn_idx", "archived", provenance(turn).alias("p")).select("conversation_id", "turn_idx", "archived", "p.*")
    return conversations, blocks, census

