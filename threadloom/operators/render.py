"""Transcripts as Markdown or plain HTML, and the gate that compares their words with the source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.scalars import is_safe_url
from threadloom.operators.privacy import escape_html, neutralize_text, strip_hidden_chars
from threadloom.session import stash


def _line(c: Column) -> Column:
    """One line: a value can't forge a heading."""
    return F.regexp_replace(F.regexp_replace(strip_hidden_chars(c), r"(?U)\s*[\r\n\x0b\x0c\x{85}\x{2028}\x{2029}]+\s*", " "), r"(?U)^\s+|\s+$", "")


def _inline(c: Column) -> Column:
    return F.replace(F.replace(F.replace(_line(c), F.lit("\\"), F.lit("\\\\")), F.lit("["), F.lit("\\[")), F.lit("]"), F.lit("\\]"))


def _span(c: Column) -> Column:
    return F.replace(_line(c), F.lit("`"), F.lit("'"))


#: Characters that would end a link's address, and what stands for them.
ADDRESS = (("\t", "%09"), ("\n", ""), ("\r", ""), (" ", "%20"), ('"', "%22"), ("(", "%28"), (")", "%29"), ("<", "%3C"), (">", "%3E"), ("[", "%5B"), ("]", "%5D"))


def _url(c: Column) -> Column:
    for found, shown in ADDRESS:
        c = F.replace(c, F.lit(found), F.lit(shown))
    return c


def _or(c: Column, default: str) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(default))


def _at(name: str) -> Column:
    return F.get_json_object("data", f"$.{name}")


def block_markdown(text: Column, citations: Column) -> Column:
    """One block (type, text, data as JSON, citations array<struct<title,url>>) by its type."""
    body = strip_hidden_chars(text)
    shown = F.when(text != "", F.concat(F.lit("\n\n"), body)).otherwise("")

    def link(c: Column) -> Column:
        url = F.coalesce(c.url, F.lit(""))
        title = _inline(F.coalesce(F.nullif(c.title, F.lit("")), F.nullif(url, F.lit("")), F.lit("source")))
        return F.when(is_safe_url(url), F.concat(F.lit("["), title, F.lit("]("), _url(strip_hidden_chars(url)), F.lit(")"))).otherwise(F.concat(title, F.lit(" ("), _inline(url), F.lit(")")))

    sources = F.when(F.coalesce(F.size(citations), F.lit(0)) > 0, F.concat(F.lit("\n\nSources: "), F.array_join(F.transform(citations, link), " · "))).otherwise("")
    quoted = F.array_join(F.transform(F.split(body, "\n"), lambda s: F.concat(F.lit("> "), s)), "\n")
    path = F.coalesce(_at("path"), F.lit(""))
    remote = path.contains("://") | path.startswith("//")
    local = F.when(path.contains("/"), path).otherwise(F.concat(F.lit("../media/"), path))
    fence = lambda lang, c: F.concat(F.lit("```" + lang + "\n"), strip_hidden_chars(c), F.lit("\n```"))
    kind = F.col("type")
    extra = _at("extracted_content")
    return (
        F.when(kind == "text", F.concat(body, sources))
        .when(kind == "thinking", F.concat(F.lit("> 🧠 **Thinking**\n>\n"), quoted))
        .when(kind == "tool_use", F.concat(F.lit("**🔧 Tool call: `"), _span(_or(_at("name"), "tool")), F.lit("`**"), shown, F.lit("\n\n"), fence("json", F.coalesce(_at("input"), F.lit("")))))
        .when(kind == "tool_result", F.concat(F.lit("**↩️ Tool "), F.when(_at("is_error") == "true", "⚠️ error").otherwise("result"), F.lit(" (`"), _span(_or(_at("name"), "tool")), F.lit("`)**"), shown, F.lit("\n\n"), fence("", F.coalesce(_at("content"), F.lit("")))))
        .when(kind == "attachment", F.concat(F.lit("📎 **"), _line(_or(_at("file_name"), "attachment")), F.lit("** ("), _line(_or(_at("file_type"), "?")), F.lit(", "), _or(_at("file_size"), "?"), F.lit(" bytes)"),
              F.when(F.coalesce(extra, F.lit("")) != "", F.concat(F.lit("\n\n<details><summary>extracted content</summary>\n\n"), strip_hidden_chars(extra), F.lit("\n\n</details>"))).otherwise("")))
        .when(kind == "code", F.concat(F.lit("```"), _line(F.coalesce(_at("language"), F.lit(""))), F.lit("\n"), body, F.lit("\n```")))
        .when(kind == "event", F.concat(F.lit("> ✨ **"), _line(F.coalesce(F.nullif(text, F.lit("")), F.nullif(_at("name"), F.lit("")), F.lit("event"))), F.lit("**")))
        .when((kind == "media") & remote, F.concat(F.lit("🖼 "), _inline(path), F.lit(" _(remote media — not embedded)_")))
        .when(kind == "media", F.concat(F.lit("!["), _inline(_or(path, "media")), F.lit("]("), _url(strip_hidden_chars(local)), F.lit(")")))
        .when(kind == "file", F.concat(F.lit("📎 "), _line(_or(_at("file_name"), "file")), F.lit(" _(no content in export)_")))
        .when(kind == "unknown", F.concat(F.lit("_[unrendered "), _line(_or(_at("orig_type"), "unknown")), F.lit(" block]_"), F.when(_at("x_raw").isNotNull(), F.concat(F.lit("\n\n"), fence("json", _at("x_raw")))).otherwise("")))
        .otherwise(body)
    )


def _with_defaults(blocks: DataFrame) -> DataFrame:
    have = blocks.columns
    out = blocks
    if "data" not in have:
        out = out.withColumn("data", F.lit(None).cast("string"))
    if "citations" not in have:
        out = out.withColumn("citations", F.lit(None).cast("array<struct<title:string,url:string>>"))
    if "branch" not in have:
        out = out.withColumn("branch", F.lit(None).cast("struct<index:int,total:int>"))
    return out


def _joined_turns(blocks: DataFrame, rendered: Column, heading: Column, tail: Column, glue: str) -> DataFrame:
    """(conversation_id, turns): blocks in order within turns, turns in order."""
    per_turn = (
        _with_defaults(blocks).withColumn("md", rendered)
        .groupBy("conversation_id", "turn_idx")
        .agg(F.first("role").alias("role"), F.first("branch").alias("branch"), F.array_sort(F.collect_list(F.struct("block_idx", "md"))).alias("b"))
    )
    text = F.concat(heading, F.array_join(F.transform("b", lambda x: x.md), glue), tail)
    return per_turn.withColumn("t", text).groupBy("conversation_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn_idx", "t"))), lambda x: x.t), "").alias("turns"))


def render_markdown(conversations: DataFrame, blocks: DataFrame) -> DataFrame:
    """(conversation_id, markdown): title, facts, a heading per turn with its branch mark, blocks by type."""
    head = F.concat(F.lit("## "), F.when(F.col("role") == "human", "Human").otherwise("Assistant"), F.when(F.col("branch").isNotNull(), F.format_string("  _(branch %d/%d)_", "branch.index", "branch.total")).otherwise(""), F.lit("\n\n"))
    turns = _joined_turns(blocks, block_markdown(F.col("text"), F.col("citations")), head, F.lit("\n\n---\n\n"), "\n\n")
    c = conversations.join(turns, "conversation_id", "left")
    facts = F.array_join(F.filter(F.array(F.nullif("provider", F.lit("")), F.when(F.col("account") != "", F.concat(F.lit("account "), "account")), F.when(F.col("created_at") != "", F.concat(F.lit("created "), "created_at"))), lambda x: x.isNotNull()), " · ")
    text = F.concat(F.lit("# "), _line(F.col("title")), F.lit("\n\n"), F.when(facts != "", F.concat(F.lit("> "), facts, F.lit("\n\n"))).otherwise(""), F.coalesce("turns", F.lit("")))
    return c.select("conversation_id", F.concat(F.regexp_replace(text, r"\s+$", ""), F.lit("\n")).alias("markdown"))


def render_plain_html(conversations: DataFrame, blocks: DataFrame) -> DataFrame:
    """(conversation_id, html): escaped blocks with badges for hidden characters; plain, without Markdown."""
    show = lambda c: neutralize_text(c, "badge", html=True)
    data = F.coalesce("data", F.lit(""))
    block = F.concat(F.lit('<div class="block '), escape_html(F.col("type")), F.lit('"><pre>'), show(F.col("text")), F.when(data != "", F.concat(F.lit("\n"), show(data))).otherwise(""), F.lit("</pre></div>"))
    turns = _joined_turns(blocks, block, F.concat(F.lit('<section class="'), "role", F.lit('">')), F.lit("</section>\n"), "\n")
    page = F.concat(F.lit("<!doctype html><html><head><title>"), show(F.col("title")), F.lit("</title></head><body><h1>"), show(F.col("title")), F.lit("</h1>\n"), F.coalesce("turns", F.lit("")), F.lit("</body></html>"))
    return conversations.join(turns, "conversation_id", "left").select("conversation_id", page.alias("html"))


WORD = r"(?U)\w+"


def prose_tokens(blocks: DataFrame) -> DataFrame:
    """(conversation_id, token) of text and thinking blocks; list numbers are structure, not words."""
    body = F.regexp_replace("text", r"(?m)^[ \t]{0,3}\d+[.)][ \t]+", " ")
    return blocks.filter(F.col("type").isin("text", "thinking")).select("conversation_id", F.explode(F.regexp_extract_all(F.lower(body), F.lit(WORD), F.lit(0))).alias("token"))


#: The entities that a plain page uses.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "'"), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def html_visible_text(html: Column) -> Column:
    """Text a reader sees, and attribute values that can hold source words; no style, head or badges."""
    h = F.coalesce(html, F.lit(""))
    for pattern in (r'(?is)<span class="cp-badge".*?</span>', r"(?is)<style.*?</style>", r"(?is)<head.*?</head>"):
        h = F.regexp_replace(h, pattern, " ")
    attrs = F.array_join(F.concat(F.regexp_extract_all(h, F.lit(r'(?i)(?:href|src|alt|title)="([^"]*)"'), F.lit(1)), F.regexp_extract_all(h, F.lit(r'(?i)class="[^"]*language-([\w+.-]+)'), F.lit(1))), " ")
    out = F.concat(F.regexp_replace(h, r"<[^>]+>", " "), F.lit(" "), attrs)
    for a, b in ENTITIES:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def html_visible_tokens(pages: DataFrame) -> DataFrame:
    return pages.select("conversation_id", F.explode(F.regexp_extract_all(F.lower(html_visible_text(F.col("html"))), F.lit(WORD), F.lit(0))).alias("token"))


def fidelity_gate(want: DataFrame, got: DataFrame) -> DataFrame:
    """(conversation_id, ok, missing, coverage): the multiset difference of wanted and shown words, by counts.

    missing lists a word once for each time it lacks; coverage is 1.0 where nothing was wanted, in which case
    there is no row here and the caller counts the conversation as covered."""
    w = want.groupBy("conversation_id", "token").agg(F.count(F.lit(1)).alias("w"))
    g = got.groupBy("conversation_id", "token").agg(F.count(F.lit(1)).alias("g"))
    lack = F.greatest(F.lit(0).cast("long"), F.col("w") - F.coalesce("g", F.lit(0)))
    both = w.join(g, ["conversation_id", "token"], "left").withColumn("lack", lack)
    out = both.groupBy("conversation_id").agg(
        F.sum("lack").alias("n"), F.sum("w").alias("total"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.col("lack") > 0, F.struct("token", "lack")))), lambda x: F.array_repeat(x.token, x.lack.cast("int")))).alias("missing"),
    )
    return out.select("conversation_id", (F.col("n") == 0).alias("ok"), "missing", ((F.col("total") - F.col("n")) / F.col("total")).alias("coverage"))


def render_report(conversations: DataFrame, blocks: DataFrame, pages: DataFrame, gate: DataFrame, audit: DataFrame, sample: int = 20) -> DataFrame:
    """One row: conversations, rendered, turns, empty, gate_ok, hidden, failures (the first ids in order)."""
    turns = blocks.groupBy("conversation_id").agg(F.countDistinct("turn_idx").alias("turns"))
    flags = (
        conversations.select("conversation_id").join(turns, "conversation_id", "left")
        .join(pages.select("conversation_id", F.lit(True).alias("page")), "conversation_id", "left")
        .join(gate.select("conversation_id", "ok"), "conversation_id", "left")
        .join(audit.select("conversation_id", F.lit(True).alias("hidden")), "conversation_id", "left")
    )
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    ok = F.coalesce(F.col("ok"), F.lit(True))
    flags = stash(flags, "flags")
    first = flags.filter(~ok).select("conversation_id").orderBy("conversation_id").limit(sample)
    failures = first.agg(F.array_sort(F.collect_list("conversation_id")).alias("failures"))
    counts = flags.agg(
        F.count(F.lit(1)).alias("conversations"), n(F.col("page")).alias("rendered"), F.coalesce(F.sum("turns"), F.lit(0)).alias("turns"), n(F.col("turns").isNull()).alias("empty"),
        n(ok).alias("gate_ok"), n(F.col("hidden")).alias("hidden"),
    )
    return counts.crossJoin(F.broadcast(failures))  # one row


def raw_transcript(blocks: DataFrame) -> DataFrame:
    """(conversation_id, transcript): non-empty block texts in order, a line break between; for local use."""
    ordered = F.array_sort(F.collect_list(F.when(F.col("text") != "", F.struct("turn_idx", "block_idx", "text"))))
    return blocks.groupBy("conversation_id").agg(F.array_join(F.transform(ordered, lambda x: x.text), "\n").alias("transcript"))


def link_audit(citations: DataFrame) -> DataFrame:
    """citations (conversation_id, url): links that may not become live, by conversation."""
    return citations.filter(~is_safe_url(F.col("url"))).groupBy("conversation_id").agg(F.count(F.lit(1)).alias("unsafe"))
