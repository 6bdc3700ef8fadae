"""Mixing sources to target weights: hierarchical token budgets and seeded token-prefixes of each leaf."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from threadloom.llm.text import SPACE_WORD
from threadloom.session import fresh, join_checked, named, stash

LEVELS = ("domain", "lang", "source")
SEED = "mix-1"
BUDGET_PERCENT = 50
MAX_EPOCHS = 4
OTHER = "other"
#: Steps of a doubling of cap / weight by which the children of a node are grouped.
RATIO_STEPS = 16
#: Documents of a leaf in one bucket of its seeded order, about.
BUCKET_ROWS = 2_000


def domain_of(source: Column, domains: dict[str, str] | None = None) -> Column:
    """The domain that a declared mapping gives a source; 'other' for a source that it doesn't name."""
    if not domains:
        return F.lit(OTHER)
    declared = F.create_map(*[F.lit(v) for pair in domains.items() for v in pair])
    return F.coalesce(F.element_at(declared, F.coalesce(source, F.lit(""))), F.lit(OTHER))


def _ratio() -> Column:
    return F.col("cap") / F.col("weight")


def dry_rates(children: DataFrame) -> DataFrame:
    """(parent, at, left, share): where a parent's budget stops to cover its children (parent, cap, weight, given).

    Children run dry in the order of cap / weight. The first that does not, at that ratio, fixes the rate for itself
    and all after it: what is left, over their share of weights. No row for a parent whose children all run dry. A
    parent may have very many children, so they are added up by ratio, and the ratios by steps; only the sums of the steps,
    and the ratios within the step where the budget ends, are put in order."""
    exact = lambda c: F.col(c).cast("decimal(38,0)")
    step = F.floor(F.log2(_ratio()) * RATIO_STEPS).cast("int")
    ratios = children.groupBy("parent", _ratio().alias("at"), step.alias("step")).agg(F.sum("cap").alias("cap"), F.sum("weight").alias("weight"), F.max("given").alias("given"))
    steps = ratios.groupBy("parent", "step").agg(F.sum("cap").alias("cap"), F.sum("weight").alias("weight"), F.max("given").alias("given"), F.max(F.struct("at", "cap", "weight")).alias("top"))
    order = Window.partitionBy("parent").orderBy("step")
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    after = F.coalesce(F.sum("weight").over(order.rowsBetween(1, Window.unboundedFollowing)), F.lit(0))
    steps = steps.withColumn("before", before).withColumn("after", after)
    at_top = exact("top.cap") * (F.col("after") + F.col("top.weight")) <= (F.col("given") - F.col("before") - F.col("cap") + F.col("top.cap")) * exact("top.weight")
    ends = steps.filter(~at_top).groupBy("parent").agg(F.min(F.struct("step", "before", "after")).alias("end"))
    inside = join_checked(ratios, ends, "parent").filter("step = end.step")
    line = Window.partitionBy("parent").orderBy("at")
    left = F.col("given") - F.col("end.before") - F.coalesce(F.sum("cap").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    share = F.col("end.after") + F.sum("weight").over(line.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    inside = inside.withColumn("left", left).withColumn("share", share)
    first = inside.filter(~(exact("cap") * F.col("share") <= F.col("left") * exact("weight"))).groupBy("parent").agg(F.min(F.struct("at", "left", "share")).alias("r"))
    return stash(first.select("parent", "r.at", "r.left", "r.share"), "mix-rates")


def weight_path(weights: DataFrame) -> Column:
    """The column path as an array of names; a text is cut at its slashes."""
    return F.col("path") if isinstance(weights.schema["path"].dataType, ArrayType) else F.split("path", "/")


def leaf_budgets(leaves: DataFrame, total: Column, weights: DataFrame | None = None, epochs: int = MAX_EPOCHS) -> DataFrame:
    """leaves (domain, lang, source, tokens) with budget: how many tokens each leaf gives, out of total.

    A parent's budget is dealt to its children in proportion to their weights; a child takes no more than its
    subtree can give (tokens * epochs), and what it can't take goes to its siblings. Since a child's limit is
    its subtree's, a shortage leaves a family only when the whole family is exhausted: siblings come before
    ancestors. weights: (path, weight) with path 'domain', 'domain/lang' or 'domain/lang/source', or an array
    of these names, which it must be where a name holds a slash; integers from 1; 1 where there is none. A node is told by its
    names one by one, whatever they hold. All integer arithmetic, rounded down."""
    nodes = leaves.withColumn("cap", F.col("tokens") * epochs)
    none = F.array().cast("array<string>")
    path: list[str] = []
    parents = nodes.agg(F.coalesce(F.sum("cap"), F.lit(0)).cast("long").alias("cap")).select(none.alias("parent"), F.least("cap", total.cast("long")).alias("given"))
    for level in LEVELS:
        above = F.array(*path) if path else none
        path.append(level)
        here = nodes.groupBy(*path).agg(F.sum("cap").cast("long").alias("cap")).withColumn("parent", above).withColumn("path", F.array(*path))
        if weights is None:
            here = here.withColumn("weight", F.lit(1).cast("long"))
        else:
            w = weights.select(weight_path(weights).alias("path"), F.col("weight").cast("long").alias("given_weight"))
            here = here.join(w, "path", "left").withColumn("weight", F.coalesce("given_weight", F.lit(1).cast("long"))).drop("given_weight")
        here = join_checked(here, parents, "parent")
        here = stash(here, "mix-nodes")
        rates = dry_rates(here)
        here = join_checked(here, rates, "parent", "left")
        budget = F.when(_ratio() < F.col("at"), F.col("cap")).otherwise(F.expr("(cast(weight as decimal(38, 0)) * left) div share"))
        here = here.withColumn("budget", F.greatest(F.lit(0).cast("long"), F.when(F.col("at").isNull(), F.col("cap")).otherwise(budget)))
        if level != LEVELS[-1]:
            parents = here.select(F.col("path").alias("parent"), F.col("budget").alias("given"))
    return leaves.join(here.select(*LEVELS, "budget"), list(LEVELS))


def mix_sources(
    docs: DataFrame,
    domain: Column | None = None,
    weights: DataFrame | None = None,
    budget_percent: int = BUDGET_PERCENT,
    max_epochs: int = MAX_EPOCHS,
    seed: str = SEED,
    name: str = "mix",
) -> DataFrame:
    """docs chosen to fit the budgets, with a struct column named by name (one of that name is replaced):
    domain, lang, source, epoch, n_tokens, budget. A document comes once for each epoch that takes it.

    The total is budget_percent of all tokens (words between white space; a document has one at least, so null
    and empty texts cost one; a very long text costs all its words and is taken whole or not at all). A null lang or
    source is a leaf named '', a null domain is 'other'. An empty table stays empty. domain: a column of docs; without it all is one domain. In each epoch a leaf's documents stand
    in the order of md5(seed:epoch:id:md5 of text); whole epochs are taken while they fit, then the longest prefix
    within the rest. Rows that tie in all of that are repeated rows: they are taken together or not at all.

    The prefix needs running sums over a leaf that may hold a third of all rows: a leaf's order is cut into
    buckets by the leading digits of the md5, so that only sums per bucket are accumulated, and rows only in
    the one bucket of each leaf where the prefix ends. Bucket numbers grow with the leaf."""
    key = ["domain", "lang", "source"]
    n_tokens = F.greatest(F.lit(1), F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(SPACE_WORD))).cast("long")
    # what is worked out for a row lies in structs whose names the table doesn't have
    x, m, e = (fresh(docs, n) for n in ("__mix", "__limits", "__epoch"))
    rows = docs.withColumn(
        x,
        F.struct(
            F.struct(
                F.coalesce(*([] if domain is None else [domain]), F.lit(OTHER)).alias("domain"),
                F.coalesce(F.col("lang"), F.lit("")).alias("lang"),
                F.coalesce(F.col("source"), F.lit("")).alias("source"),
            ).alias("leaf"),
            n_tokens.alias("n_tokens"),
            F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce(F.col("text"), F.lit("")))).alias("label"),
        ),
    )
    # only ids, tokens and leaves are kept aside; the texts are read once more at the end
    ids = stash(rows.select(f"{x}.leaf.*", f"{x}.n_tokens", f"{x}.label"), "mix-rows")
    leaves = stash(ids.groupBy(*key).agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")), "mix-leaves")
    total = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("t")).first()["t"] * budget_percent // 100
    plan = leaf_budgets(leaves, F.lit(total), weights, max_epochs).select(
        *key, "budget", F.expr("cast(budget div tokens as int)").alias("whole"), F.expr("budget % tokens").alias("rest"),
        F.ceil(F.col("docs") / BUCKET_ROWS).alias("buckets"),
    )
    plan = stash(plan, "mix-plan")

    def spot(whole: Column, label: Column) -> Column:
        return F.md5(F.concat_ws(":", F.lit(seed), whole, label))

    def bucket(at: Column, buckets: Column) -> Column:
        return F.floor(F.conv(F.substring(at, 1, 8), 16, 10).cast("double") / 4294967296.0 * buckets)

    planned = join_checked(ids, plan, key)
    last = planned.withColumn("spot", spot(F.col("whole"), F.col("label"))).withColumn("bucket", bucket(F.col("spot"), F.col("buckets")))
    sums = last.groupBy(*key, "bucket").agg(F.sum("n_tokens").alias("in_bucket"))
    upto = Window.partitionBy(*key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("in_bucket").over(upto), F.lit(0)))
    ends = join_checked(sums, plan, key).filter("before + in_bucket > rest and before <= rest")
    # of each leaf the first bucket in which the sum passes the rest
    ends = stash(ends.groupBy(*key).agg(F.min(F.struct("bucket", "before")).alias("e")).select(*key, F.col("e.bucket").alias("end_bucket"), F.col("e.before").alias("end_before")), "mix-ends")
    placed = join_checked(last, ends, key, "left")
    inside = placed.filter("bucket = end_bucket")
    running = F.sum("n_tokens").over(Window.partitionBy(*key).orderBy("spot").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    border = inside.withColumn("upto", F.col("end_before") + running).groupBy(*key).agg(F.max(F.when(F.col("upto") <= F.col("rest"), F.col("spot"))).alias("last_spot"))
    border = stash(join_checked(ends, border, key, "left").select(*key, "end_bucket", F.coalesce("last_spot", F.lit("")).alias("last_spot")), "mix-border")

    limits = join_checked(plan, border, key, "left").select(F.struct(F.struct(*key).alias("leaf"), "budget", "whole", "buckets", "end_bucket", "last_spot").alias(m))
    own = [named(c) for c in docs.columns if c != name]
    at = join_checked(rows.select(*own, x), limits, F.col(f"{x}.leaf") == F.col(f"{m}.leaf"))
    here = spot(F.col(f"{m}.whole"), F.col(f"{x}.label"))
    slot, end = bucket(here, F.col(f"{m}.buckets")), F.col(f"{m}.end_bucket")
    partly = F.when(end.isNull(), F.lit(False)).otherwise((slot < end) | ((slot == end) & (here <= F.col(f"{m}.last_spot"))))
    taken = F.col(f"{m}.whole") + partly.cast("int")
    each = at.withColumn(e, F.explode(F.when(taken > 0, F.sequence(F.lit(0), taken - 1))))
    chosen = F.struct(f"{x}.leaf.domain", f"{x}.leaf.lang", f"{x}.leaf.source", F.col(e).alias("epoch"), f"{x}.n_tokens", f"{m}.budget")
    return each.select(*own, chosen.alias(name))
