"""Mixing sources to target weights by Sainte-Lague apportionment.

A source's documents are dealt into shards and laid end to end there in a seeded order; the line
is cut into blocks of equal numbers of words. Seats (blocks of the mix) go to the sources by the
highest quotients target / (2k + 1), and each source's seats to its shards in the same way, by
shard size. A shard with q seats for n blocks takes every block q div n times and q mod n of
them, evenly spaced from a seeded start, once more. How many words of a document that takes is
arithmetic on its place in the line, so blocks are never rows.

Scale: one pass over the texts leaves (id, source, size), which is kept in the checkpoint folder.
Shards follow from the hash of the id, about ``shards`` in all and none below ``least_shard``
words, so a hot source is many groups and a window never holds more than a shard. Apportioning
sorts sources (or the shards of a source), never documents.

Defined cases: NULL text has size 0 and gets 0; NULL source is a source of its own, the last;
sources without words get target 0; documents of one id share a place and repeated rows each
count, with a place of their own where rows are numbered, as in ``mix``; no rows give no rows; other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm.common import WORD, checkpointed, numbered, text_of, word_count

WEIGHTS = (3.0, 1.0, 2.0)
BLOCK, SHARDS, LEAST_SHARD = 16, 4096, 1 << 16


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, target for rows (source, size): shares by weight, capped, excess dealt again.

    Sources fill up in the order of cap / weight; each gets the lower of its cap and the level that
    the remaining words give to the remaining weight.
    """
    each = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    each = each.withColumn(
        "weight", F.get(cycle, ((F.row_number().over(by_name) - 1) % len(weights)).cast("int"))
    ).withColumn("cap", most * F.col("source_size"))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    all_rows = fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    open_weight = F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    left = share * F.sum("source_size").over(all_rows) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    level = each.withColumn("level", left / open_weight).withColumn(
        "full", F.col("cap") <= F.col("level") * F.col("weight")
    )
    # after the first source that does not fill up, none does: all share the level reached there
    reached = F.first(F.when(~F.col("full"), F.col("level")), ignorenulls=True).over(all_rows)
    return level.select(
        "source", "source_size",
        F.least(F.col("cap"), F.coalesce(reached * F.col("weight"), F.col("cap"))).alias("target"),
    )


def apportion(parties: DataFrame, votes: str, seats: Column, within: Sequence[str] = (), order: Sequence[str] = ()) -> DataFrame:
    """Adds ``quota``: how many of the ``seats`` highest quotients votes / (2k + 1) are a party's.

    ``within`` names groups that each deal their own seats. The k-th quotients above the level
    votes * 2 / (votes of all) that seats + parties / 2 seats would need are certain; only the few
    between are made rows and ranked, a small number per party whatever the number of seats.
    """
    group = Window.partitionBy(*within) if within else Window.partitionBy(F.lit(0))
    p = parties.withColumns({
        "_v": F.col(votes).cast("double"),
        "_all": F.sum(F.col(votes).cast("double")).over(group),
        "_n": F.count(F.lit(1)).over(group),
        "_seats": seats.cast("long"),
    })
    # (v / level + 1) / 2 quotients are at or above a level; summed it is v_all / (2 level) +- n / 2
    sure = F.greatest(F.lit(0), F.floor(F.col("_v") / F.col("_all") * (F.col("_seats") - F.col("_n") / 2 - 1) - 0.5))
    most = F.ceil(F.col("_v") / F.col("_all") * (F.col("_seats") + F.col("_n") / 2 + 1) + 0.5)
    p = p.withColumns({
        "_sure": F.when(F.col("_all") > 0, sure).otherwise(0).cast("long"),
        "_most": F.when(F.col("_all") > 0, most).otherwise(0).cast("long"),
    }).withColumn("_left", F.col("_seats") - F.sum("_sure").over(group))
    keys = [*within, *order]
    spread = p.filter((F.col("_v") > 0) & (F.col("_most") > F.col("_sure"))).select(
        *keys, "_v", "_left", F.explode(F.sequence(F.col("_sure"), F.col("_most") - 1)).alias("_k")
    ).withColumn("_q", F.col("_v") / (2 * F.col("_k") + 1))
    ranked = (Window.partitionBy(*within) if within else Window.partitionBy(F.lit(0))).orderBy(
        F.col("_q").desc(), *[F.col(c).asc_nulls_last() for c in order], F.col("_k")
    )
    won = (
        spread.withColumn("_rank", F.row_number().over(ranked))
        .filter(F.col("_rank") <= F.col("_left")).groupBy(*keys).agg(F.count(F.lit(1)).alias("_won"))
    )
    right = won.select(*[F.col(c).alias(f"_r{i}") for i, c in enumerate(keys)], "_won")
    same = F.lit(True)
    for i, c in enumerate(keys):
        same = same & p[c].eqNullSafe(right[f"_r{i}"])
    return p.join(right, same, "left").select(
        *parties.columns, (F.col("_sure") + F.coalesce("_won", F.lit(0))).cast("long").alias("quota")
    )


def _digest(*parts) -> Column:
    return F.md5(F.concat_ws(":", *parts))


def _number(digest: Column, first: int) -> Column:
    """Eight hex digits as a number."""
    return F.conv(F.substring(digest, first, 8), 16, 10).cast("long")


def mix_plan(
    docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, most: float = 2.0,
    block: int = BLOCK, shards: int = SHARDS, least_shard: int = LEAST_SHARD, seed: int = 0,
    row: str | None = None,
) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, and the place: shard, first, blocks, seats, start.

    Every row of ``docs`` gives one row. ``row`` names a column that tells rows of one id apart, or of
    none; it is put out too. ``taken`` is at most twice ``size`` for ``most`` = 2.
    """
    own = [row] if row else []
    sizes = checkpointed(docs.select("doc_id", "source", word_count().alias("size"), *own))
    aims = checkpointed(targets(sizes, weights, share, most))
    total = F.sum("source_size").over(Window.partitionBy(F.lit(0)))
    aims = aims.withColumns({
        "_seats": F.round(share * total / block).cast("long"),
        "_shards": F.greatest(F.lit(1), F.ceil(F.col("source_size") / F.greatest(F.lit(least_shard), total / shards))).cast("long"),
    })
    aims = apportion(aims, "target", F.col("_seats"), order=["source"]).withColumnRenamed("quota", "_source_quota")
    no_id = [F.concat(F.lit("row "), F.col(row).cast("string"))] if row else []
    digest = _digest(F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), *no_id))
    aim = aims.withColumnRenamed("source", "_source")
    placed = sizes.join(aim, sizes["source"].eqNullSafe(aim["_source"]), "left").select(
        "doc_id", "source", "size", "source_size", "target", "_source_quota",
        *own, digest.alias("_digest"), (_number(digest, 1) % F.col("_shards")).alias("shard"),
    )
    keys = ["source", "shard"]
    shard_sizes = placed.groupBy(*keys).agg(
        F.sum("size").alias("_shard_size"), F.first("_source_quota").alias("_source_quota")
    )
    dealt = apportion(shard_sizes, "_shard_size", F.col("_source_quota"), within=["source"], order=["shard"])
    count = F.ceil(F.col("_shard_size") / block).cast("long")
    dealt = dealt.select(
        F.col("source").alias("_s"), F.col("shard").alias("_h"), count.alias("blocks"),
        F.least(F.col("quota"), F.lit(int(most)) * count).alias("seats"),
    )
    line = Window.partitionBy(*keys).orderBy("_digest", "doc_id", *own).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ordered = placed.withColumn("first", F.sum("size").over(line) - F.col("size"))
    both = ordered.join(dealt, ordered["source"].eqNullSafe(dealt["_s"]) & (ordered["shard"] == dealt["_h"]), "left")
    start = _number(_digest(F.lit(str(seed)), F.coalesce("source", F.lit("")), F.col("shard")), 9) % F.col("blocks")
    both = both.withColumn("start", F.when(F.col("blocks") > 0, start).otherwise(0))
    taken = F.when(F.col("size") == 0, F.lit(0)).otherwise(
        F.col("size") * repeats()
        + words_before(F.col("first") + F.col("size"), block) - words_before(F.col("first"), block)
    )
    return both.select(
        "doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"),
        "shard", "first", "blocks", "seats", "start", *own,
    )


def repeats() -> Column:
    """How often a shard takes each of its blocks."""
    return F.expr("seats div blocks")


def chosen_before(k: Column) -> Column:
    """How many of a shard's first ``k`` blocks are taken once more."""
    extra = F.expr("seats % blocks")
    return F.floor((k + F.col("start")) * extra / F.col("blocks")) - F.floor(F.col("start") * extra / F.col("blocks"))


def words_before(at: Column, block: int) -> Column:
    k = F.floor(at / block)
    return block * chosen_before(k) + (chosen_before(k + 1) - chosen_before(k)) * (at - k * block)


def mix(docs: DataFrame, block: int = BLOCK, **options) -> DataFrame:
    """The mixed rows: whole texts as often as all blocks are taken, then the words of the chosen blocks.

    Columns are those of ``docs``; cut texts join their words by one blank and get their own
    ``n_chars``. Rows are told apart by a number of their own, not by ``doc_id``.
    """
    rows = numbered(docs)
    plan = mix_plan(rows, block=block, row="_row", **options).select(
        "_row", "size", "taken", "first", "blocks", "seats", "start"
    )
    joined = rows.join(plan, "_row").filter(F.col("taken") > 0)
    at = lambda i: F.floor((F.col("first") + i) / block)
    words = F.regexp_extract_all(text_of(), F.lit(f"({WORD})"), F.lit(1))
    part = F.array_join(F.filter(words, lambda w, i: chosen_before(at(i) + 1) > chosen_before(at(i))), " ")
    whole = F.array_repeat(F.col("text"), repeats().cast("int"))
    rest = F.col("taken") > F.col("size") * repeats()
    both = joined.withColumn("_texts", F.when(rest, F.concat(whole, F.array(part))).otherwise(whole))
    out = both.withColumn("_text", F.explode("_texts"))
    swap = {"text": F.col("_text"), "n_chars": F.length("_text").cast("long")}
    return out.select(*[swap[c].alias(c) if c in swap else F.col(c) for c in docs.columns])
