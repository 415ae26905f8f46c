"""Mixing sources to target weights by temperature, in DataFrame functions only.

Each source's share of all tokens is raised to an exponent; bisection finds the exponent that meets a target entropy or a
repetition limit. The normalised weights become token budgets, and each epoch of a source runs through a permutation of its
blocks until the budget is used up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Exponents tried in one job (a job does as many bisection steps as this has bits), and jobs: 2^-30 in the end.
TRIED, JOBS = 32, 6
BLOCK_TOKENS = 200_000


def token_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source (null: empty string) and n_tokens (words that ASCII white space divides) of every whole text."""
    count = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(source_col), F.lit("")).alias("source"), count.cast("long").alias("n_tokens"))


def exponent(totals: DataFrame, budget: float | None, entropy_share: float | None, most_repeats: float | None) -> float:
    """The exponent in 0..1 for sources' token totals (source, tokens), in steps of 2^-30.

    entropy_share: the largest exponent whose weights reach that share of the entropy of equal weights. most_repeats: the smallest
    exponent at which no source exceeds so many epochs; 1 if even that has more. The driver sees a row for each exponent tried.
    """
    shares = totals.where("tokens > 0").select((F.col("tokens") / F.col("total")).alias("p"), F.col("total"), F.col("sources"))
    low, step = 0, 1 << (TRIED.bit_length() - 1) * JOBS
    for _ in range(JOBS):
        step //= TRIED
        tried = [(low + i * step) / (1 << 30) for i in range(1, TRIED)]
        t = F.col("t")
        raised = F.pow(F.col("p"), t)
        sums = shares.select("*", F.posexplode(F.array(*map(F.lit, tried))).alias("i", "t")).groupBy("i", "t").agg(F.sum(raised).alias("z"), F.sum(raised * F.log("p")).alias("zl"), F.max(F.pow(F.col("p"), t - 1)).alias("m"), F.max("total").alias("total"), F.max("sources").alias("n"))
        entropy = F.log("z") - t * F.col("zl") / F.col("z")
        meets = entropy >= F.lit(entropy_share) * F.log("n") if entropy_share is not None else F.coalesce(F.lit(budget), F.col("total")) / F.col("total") * F.col("m") / F.col("z") > F.lit(most_repeats)
        # both conditions hold up to some exponent: move to the last that meets it
        low += step * len(sums.where(meets).collect())
    return low / (1 << 30)


def block_hash(*parts: Column | str) -> Column:
    return F.md5(F.concat_ws("|", *parts))


def running_sums(rows: DataFrame, groups: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """rows with two more columns: rank, the row's place in its group from 1, and before, the sum of value over the rows before it.

    Rows are range-partitioned by group and order and written, so a group of any size lies in as many partitions as its rows
    need; within a partition a window adds up, and what a partition's first group has in the partitions before comes from one
    row for each partition. Rows must differ in order, unless they are equal in all columns that matter. Values are not null.
    """
    dealt = written(rows.repartitionByRange(*groups, *order).withColumn("pid", F.spark_partition_id()), name)
    group = F.struct(*groups)
    parts = dealt.groupBy("pid", *groups).agg(F.sum(value).alias("total"), F.count("*").alias("n"))
    ends = parts.groupBy("pid").agg(F.min(group).alias("first"), F.max(F.struct(group.alias("g"), "total", "n")).alias("last"))
    upto = Window.partitionBy("last.g").orderBy("pid").rowsBetween(Window.unboundedPreceding, 0)
    ends = ends.select("pid", "first", F.struct(F.col("last.g").alias("g"), F.sum("last.total").over(upto).alias("total"), F.sum("last.n").over(upto).alias("n")).alias("upto"))
    # one row for each partition
    ends = ends.withColumn("past", F.lag("upto").over(Window.orderBy("pid"))).where(F.col("past.g") == F.col("first")).select("pid", "first", "past")
    inside = Window.partitionBy("pid", *groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = dealt.withColumn("own_rank", F.count("*").over(inside)).withColumn("own", F.sum(value).over(inside) - F.col(value))
    goes_on = F.when(group == F.col("first"), F.col("past"))
    met = own.join(F.broadcast(ends), "pid", "left").withColumn("past", goes_on)
    rank, before = F.col("own_rank") + F.coalesce("past.n", F.lit(0)), F.col("own") + F.coalesce("past.total", F.lit(0))
    return met.select(*rows.columns, rank.alias("rank"), before.alias("before"))


def mix(tokens: DataFrame, budget: float | None = None, entropy_share: float | None = None, most_repeats: float | None = 2.0, block_tokens: int = BLOCK_TOKENS, seed: int = 1) -> DataFrame:
    """One row for each document and epoch in which it is used.

    tokens: token_table(). budget: tokens of the mixture, all tokens where None. Returns doc_id, source, n_tokens, epoch, block,
    block_rank (the block's place in that epoch's permutation of its source). Whole epochs hold every document; the last
    epoch holds blocks in order of the permutation, and of the block that crosses the budget the documents, by hash, that fit.
    A source without tokens is used once. Rows repeated in tokens count each; an empty table gives no rows. Null ids stay null; all of a
    source's share one block. Blocks and documents whose hashes tie go by their numbers, ids and tokens.

    Sums within blocks and over a source's blocks go by ranges of rows (running_sums), so neither a hot source, nor one without
    tokens, nor the null ids of one come together in one task.
    """
    tokens = written(tokens.select("doc_id", "source", "n_tokens"), "tokens")
    # places in the files just written: equal rows go to different ranges, the same ones if a task runs again
    tokens = tokens.withColumn("tie", F.xxhash64("_metadata.file_path", "_metadata.row_index"))
    per_source = tokens.groupBy("source").agg(F.sum("n_tokens").alias("tokens"))
    per_all = per_source.agg(F.sum("tokens").alias("total"), F.count_if(F.col("tokens") > 0).alias("sources"))
    totals = written(per_source.crossJoin(F.broadcast(per_all)), "totals")  # per_all is one row
    tau = exponent(totals, budget, entropy_share, None if entropy_share is not None else most_repeats)
    raised = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.col("total"), F.lit(tau))).otherwise(0.0)
    z = totals.agg(F.sum(raised).alias("z"))
    share = F.coalesce(F.lit(budget), F.col("total")) * raised / F.col("z") / F.col("tokens")
    plan = totals.crossJoin(F.broadcast(z)).select(
        "source",
        F.greatest(F.lit(1), F.ceil(F.col("tokens") / F.lit(block_tokens))).cast("long").alias("blocks"),
        F.when(F.col("tokens") > 0, F.floor(share)).otherwise(1).cast("long").alias("whole"),
        F.when(F.col("tokens") > 0, (share - F.floor(share)) * F.col("tokens")).otherwise(0.0).alias("rest"),
    )
    key = block_hash(F.lit(seed), F.col("doc_id"))
    number = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    placed = tokens.withColumn("key", key).join(plan.select("source", "blocks"), "source").select("doc_id", "source", "n_tokens", "key", "tie", F.pmod(number, F.col("blocks")).alias("block"))
    placed = running_sums(placed, ["source", "block"], ["key", "doc_id", "n_tokens", "tie"], "n_tokens", "placed")
    placed = placed.select("doc_id", "source", "n_tokens", "block", (F.col("before") + F.col("n_tokens")).alias("upto"))
    sums = placed.groupBy("source", "block").agg(F.sum("n_tokens").alias("block_tokens"))
    each = sums.join(plan, "source").select("source", "block", "block_tokens", "whole", "rest", F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole"))).alias("epoch"))
    each = each.withColumn("h", block_hash(F.lit(seed), "source", "epoch", "block"))
    ranked = running_sums(each, ["source", "epoch"], ["h", "block"], "block_tokens", "ranked")
    ranked = ranked.select("source", "block", "epoch", "whole", "rest", F.col("rank").alias("block_rank"), "before")
    used = placed.join(ranked, ["source", "block"]).where((F.col("epoch") < F.col("whole")) | ((F.col("rest") > 0) & (F.col("before") + F.col("upto") <= F.col("rest"))))
    return used.select("doc_id", "source", "n_tokens", "epoch", "block", "block_rank")


def oracle(table: str = "documents", most_repeats: float = 2.0, block_tokens: int = BLOCK_TOKENS, seed: int = 1) -> str:
    """DuckDB SQL of mix(token_table(documents), most_repeats=most_repeats)."""
    steps, low, size = "", "select 0::BIGINT as low", 1 << 30
    for i in range(JOBS):
        size //= TRIED
        steps += f"""grid{i} as (select low, (low + k * {size}) / {1 << 30}.0::DOUBLE as t from ({low}) l, range(1, {TRIED}) r(k)),
        low{i} as (select any_value(low) + {size} * count_if(m / z > {most_repeats}::DOUBLE) as low from (
            select low, t, sum(pow(p, t)) as z, max(pow(p, t - 1)) as m from grid{i}, shares group by low, t)),
        """
        low = f"select low from low{i}"
    return f"""with toks as (select doc_id, coalesce(source, '') as source,
            len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT as n_tokens from {table}),
        per as (select source, sum(n_tokens)::DOUBLE as tokens from toks group by source),
        tot as (select sum(tokens) as total from per),
        shares as (select tokens / total as p from per, tot where tokens > 0),
        {steps}
        zz as (select sum(pow(p, low / {1 << 30}.0::DOUBLE)) as z from shares, ({low})),
        plan as (select source, greatest(1, ceil(tokens / {block_tokens}.0::DOUBLE))::BIGINT as blocks,
            case when tokens > 0 then total * pow(tokens / total, low / {1 << 30}.0::DOUBLE) / z / tokens else 1 end as share, tokens
            from per, tot, zz, ({low})),
        placed as (select doc_id, t.source, n_tokens, blocks, md5(concat_ws('|', {seed}, doc_id)) as key from toks t join plan using (source)),
        blocked as (select *, ('0x' || substr(key, 1, 8))::BIGINT % blocks as block from placed),
        upto as (select *, sum(n_tokens) over (partition by source, block order by key, doc_id, n_tokens rows unbounded preceding) as upto from blocked),
        sums as (select source, block, sum(n_tokens) as bt from blocked group by source, block),
        ranked as (select s.source, block, epoch, floor(share) as whole, (share - floor(share)) * tokens as rest,
            row_number() over (partition by s.source, epoch order by md5(concat_ws('|', {seed}, s.source, epoch, block)), block) as block_rank,
            sum(bt) over (partition by s.source, epoch order by md5(concat_ws('|', {seed}, s.source, epoch, block)), block rows unbounded preceding) - bt as before
            from sums s join plan using (source), range(0, 1 + floor(share)::BIGINT) e(epoch))
        select doc_id, source, n_tokens, epoch, block, block_rank from upto join ranked using (source, block)
        where epoch < whole or (rest > 0 and before + upto <= rest)"""
