"""Mixing sources to target weights by temperature, DataFrame and SQL functions only.

A source with share p of all tokens gets weight p^a / sum(p^a). The exponent a is bisected between 0 (all sources alike) and 1 (as
they are): either for the largest exponent whose weights reach a target entropy, or for the smallest one at which no
source is repeated more often than a limit. The bisection is one SQL fold over the array of source totals (one number per source).

The budget: unless given, the one at which the source with the least repetition is read exactly once, so that no document is
lost. A source's quota is weight * budget. It is realised in epochs: each epoch is a permutation of the source's
blocks, and of the rows in each block, both by keyed hashes. Whole epochs take every row; the last one takes rows while the sum
before them is below what is left, so a quota is overshot by less than one document.

Rows are dealt to blocks by a hash; sums run within a block, over some thousand block totals, and over the sums of these, so a source with a
third of all rows is never in one task.

Defined cases: null text counts no tokens, a null source is a source of its own; rows without tokens are taken once in every epoch that
is begun for their source; repeated rows count as rows of their own; an empty table gives no rows; extra columns stay in `mixed`, the five
columns epoch, block, position, source_weight and n_tokens are replaced where they clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, cut, starts, text_of


#: Columns that `mixed` adds.
ADDED = frozenset({"epoch", "block", "position", "source_weight", "n_tokens"})


def word_count(column: str = "text") -> Column:
    """Words between ASCII white space."""
    packed = F.trim(F.regexp_replace(text_of(column), f"{SPACE}+", " "))
    return F.when(packed == "", F.lit(0)).otherwise(F.length(packed) - F.length(F.replace(packed, F.lit(" "))) + 1).cast("long")


def _weights(totals: Column, a: Column) -> Column:
    """p^a / sum(p^a) for each of the totals; a total of zero gets no weight. Each sum is made once."""
    once = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))
    added = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)
    raised = once(added(totals), lambda whole: F.transform(totals, lambda t: F.when(t > 0, F.pow(t / whole, a)).otherwise(F.lit(0.0))))
    return once(F.struct(raised.alias("r")), lambda x: once(F.struct(x["r"].alias("r"), added(x["r"]).alias("s")), lambda y: F.transform(y["r"], lambda r: r / y["s"])))


def _entropy(weights: Column) -> Column:
    return F.aggregate(weights, F.lit(0.0), lambda s, w: s - F.when(w > 0, w * F.log(w)).otherwise(F.lit(0.0)))


def _spread(totals: Column, weights: Column) -> Column:
    """The largest ratio of repetitions between two sources."""
    rate = F.filter(F.zip_with(weights, totals, lambda w, t: F.when(t > 0, w / t)), lambda x: x.isNotNull())
    return F.array_max(rate) / F.array_min(rate)


def source_weights(per_source: DataFrame, entropy_share: float | None = None, repeat_limit: float | None = None, budget_tokens: int | None = None, steps: int = 50) -> DataFrame:
    """per_source (source, tokens) -> source, tokens, exponent, weight, quota (tokens to draw).

    entropy_share: target entropy as a part of the largest possible one, log(number of sources). repeat_limit: how many
    times as often as the least repeated source any may be read (with a budget: how often at all). One of them is given.
    """
    if (entropy_share is None) == (repeat_limit is None):
        raise ValueError("give one of entropy_share and repeat_limit")
    one = per_source.groupBy().agg(F.array_sort(F.collect_list(F.struct("source", F.col("tokens").cast("double").alias("tokens")))).alias("s"))
    one = one.withColumn("t", F.transform("s", lambda x: x["tokens"])).withColumn("all", F.aggregate("t", F.lit(0.0), lambda s, x: s + x))
    t, several = F.col("t"), F.size(F.filter("t", lambda x: x > 0))

    def flat_enough(a: Column) -> Column:
        """Is the exponent small enough (entropy), or still too small (repetitions)?"""
        w = _weights(t, a)
        if entropy_share is not None:
            return _entropy(w) >= F.lit(float(entropy_share)) * F.log(several.cast("double"))
        if budget_tokens is not None:
            return F.array_max(F.zip_with(w, t, lambda x, y: F.when(y > 0, x * F.lit(float(budget_tokens)) / y))) > F.lit(float(repeat_limit))
        return _spread(t, w) > F.lit(float(repeat_limit))

    def halve(s: Column, _: Column) -> Column:
        mid = (s["lo"] + s["hi"]) / 2
        ok = flat_enough(mid)
        return F.struct(F.when(ok, mid).otherwise(s["lo"]).alias("lo"), F.when(ok, s["hi"]).otherwise(mid).alias("hi"))

    span = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))
    # entropy falls as the exponent grows: lo still reaches it; repetitions fall too: hi keeps the limit, 1 repeats nothing
    end = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), span, halve, lambda s: s["lo"] if entropy_share is not None else s["hi"])
    edge = F.when(flat_enough(F.lit(1.0)), F.lit(1.0)) if entropy_share is not None else F.when(~flat_enough(F.lit(0.0)), F.lit(0.0))
    one = one.withColumn("exponent", F.when(several > 1, F.coalesce(edge, end)).otherwise(F.lit(1.0))).withColumn("w", _weights(t, F.col("exponent")))
    least = F.array_min(F.filter(F.zip_with("w", "t", lambda w, x: F.when(x > 0, w / x)), lambda x: x.isNotNull()))
    one = one.withColumn("budget", F.lit(float(budget_tokens)) if budget_tokens is not None else F.lit(1.0) / least)
    rows = one.select("exponent", "budget", F.explode(F.arrays_zip("s", "w")).alias("x"))
    # rounding up keeps a quota that is a source's own total from falling a token short
    return rows.select("x.s.source", F.col("x.s.tokens").cast("long").alias("tokens"), F.round("exponent", 9).alias("exponent"), F.coalesce("x.w", F.lit(0.0)).alias("weight"), F.ceil(F.round(F.coalesce("x.w", F.lit(0.0)) * F.col("budget"), 3)).cast("long").alias("quota"))


def mixed(docs: DataFrame, keep: list[str] | None = None, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", tokens: Column | None = None, seed: int = 1, rows_per_block: int = 500, **targets) -> DataFrame:
    """docs' rows, each as often as it is drawn, with epoch (from 0), block, position (in its source's epoch, in tokens), source_weight, n_tokens."""
    keep = docs.columns if keep is None else keep
    clash = ADDED
    row_key = F.xxhash64(F.lit(seed), F.col(id_col), text_of(text_col))
    slim = docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), row_key.alias("_key"), (word_count(text_col) if tokens is None else tokens).alias("_tokens"))
    slim = cut(slim.groupBy("_source", "_id", "_key", "_tokens").agg(F.count("*").alias("_rows")))
    spread = max(1, -(-slim.count() // rows_per_block))
    slim = slim.withColumn("_sum", F.col("_tokens") * F.col("_rows")).withColumn("_block", F.pmod(F.col("_key"), F.lit(spread)).cast("int"))
    per_block = cut(slim.groupBy("_source", "_block").agg(F.sum("_sum").alias("_sum")))
    weights = source_weights(per_block.groupBy(F.col("_source").alias("source")).agg(F.sum("_sum").alias("tokens")), **targets)
    weights = weights.select(
        F.col("source").alias("_of"), F.col("weight").alias("_weight"),
        F.when(F.col("tokens") > 0, F.floor(F.col("quota") / F.col("tokens"))).otherwise(1).cast("int").alias("_whole"),
        F.when(F.col("tokens") > 0, F.col("quota") % F.col("tokens")).otherwise(0).alias("_left"),
    )
    weights = weights.withColumn("_epochs", F.col("_whole") + (F.col("_left") > 0).cast("int"))
    same = per_block["_source"].eqNullSafe(weights["_of"])
    # each epoch has its own order of blocks; `before` is what the blocks before it hold
    shuffled = F.xxhash64(F.lit(seed), F.col("_epoch"), F.col("_block"))
    dealt = per_block.join(weights, same).withColumn("_epoch", F.explode(F.when(F.col("_epochs") > 0, F.sequence(F.lit(0), F.col("_epochs") - 1))))
    # (blocks of an epoch come in groups of some 4,096, so that no task has all of them)
    dealt = dealt.withColumn("_order", shuffled).withColumn("_high", F.pmod(F.xxhash64(F.lit(seed + 1), F.col("_epoch"), F.col("_block")), F.lit(-(-spread // 4_096))))
    dealt = starts(dealt, ["_source", "_epoch"], ["_high"], ["_order", "_block"], "_sum", "_before").where((F.col("_epoch") < F.col("_whole")) | (F.col("_before") < F.col("_left")))
    dealt = dealt.select(F.col("_source").alias("_of"), F.col("_block").alias("_in"), "_weight", "_epoch", "_before", "_whole", "_left")
    inner = Window.partitionBy("_source", "_block", "_epoch").orderBy(F.xxhash64(F.lit(seed), F.col("_epoch"), F.col("_key")), "_key", "_id").rowsBetween(Window.unboundedPreceding, -1)
    drawn = slim.join(dealt, slim["_source"].eqNullSafe(dealt["_of"]) & (slim["_block"] == dealt["_in"]))
    drawn = drawn.withColumn("position", F.col("_before") + F.coalesce(F.sum("_sum").over(inner), F.lit(0)))
    drawn = drawn.where((F.col("_epoch") < F.col("_whole")) | (F.col("position") < F.col("_left")))
    picks = drawn.select(F.col("_id").alias("_pick"), F.col("_key").alias("_pick_key"), F.col("_source").alias("_pick_source"), F.col("_tokens").alias("n_tokens"), F.col("_epoch").alias("epoch"), F.col("_block").alias("block"), "position", F.col("_weight").alias("source_weight"))
    keyed = docs.drop(*clash).withColumn("_key", row_key)
    match = keyed[id_col].eqNullSafe(picks["_pick"]) & (keyed["_key"] == picks["_pick_key"]) & keyed[source_col].eqNullSafe(picks["_pick_source"])
    return keyed.join(picks, match).select(*(c for c in keep if c not in clash), "epoch", "block", "position", "source_weight", "n_tokens")
