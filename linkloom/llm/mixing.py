"""Mixing sources to target weights along a curriculum.

Each source has a weight schedule over the training time from 0 to 1; its integral is the cumulative demand for the source's
tokens. Texts of a source are streamed in a hashed order, again and again up to the allowed number of times, until its
demand is met; the place of a text in that stream, inverted through the cumulative demand, is its training position. The
mix is the range-sort of all uses by position.

Schedules are straight lines w(t) = w * (1 + a * (2t - 1)), with tilts that sum to 0 under the weights, so the weights sum
to 1 at any time and each source's integral is its target. The default tilt lets small sources rise and large ones fall.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window as W, functions as F

from ..operators.prefix import prefix_sums
from ..runtime import cut, spread
from .tokens import with_tokens

#: Greatest tilt of a schedule: a source's weight at the start and the end differs from its target by this share at most.
TILT = 0.5
#: Texts of a source that are summed in one block, about.
BLOCK = 20_000


def canonical(source):
    """Spelling of a source: without outer white space, in lower case, words joined by an underscore."""
    c = F.col(source) if isinstance(source, str) else source
    return F.regexp_replace(F.lower(F.btrim(c, F.lit(" \t\r\n"))), r"[\s-]+", "_")


def plan(supply: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target, weight, max_repeats, supply, demand, tilt) of the sources with a positive target and some text.

    The mix is as large as the scarcest source allows: demand = weight x min over sources of supply x max_repeats / weight.
    A target source without any text can't have a share; the weights of the others are scaled up to 1.
    """
    wanted = targets.where("target_weight > 0 AND max_repeats > 0").groupBy(canonical("source").alias("source")).agg(F.sum("target_weight").alias("target"), F.max("max_repeats").alias("max_repeats"))
    every = W.partitionBy()  # a table of settings, some rows
    joined = wanted.join(supply.where("supply > 0"), "source")
    joined = joined.withColumn("weight", F.col("target") / F.sum("target").over(every))
    joined = joined.withColumn("demand", F.col("weight") * F.min(F.col("supply") * F.col("max_repeats") / F.col("weight")).over(every))
    gap = F.sum(F.col("weight") * F.col("weight")).over(every) - F.col("weight")
    widest = F.max(F.abs(F.col("gap"))).over(every)
    return joined.withColumn("gap", gap).withColumn("tilt", F.when(widest > 0, F.lit(TILT) * F.col("gap") / widest).otherwise(0.0)).drop("gap")


MIXED = ["position", "doc_id", "source", "use", "tokens"]


def mix(documents: DataFrame, targets: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(position, doc_id, source, use, tokens) sorted by position: every use of a text.

    Texts that are equal count as one, the row with the smallest doc_id of those with a target source standing for them, so
    that no text is used more often than its source allows; a text that several sources hold belongs to the source of that row. Null and empty texts
    and sources without a target take no part. ``use`` counts the uses of a text from 1.
    """
    parts = uses(documents, targets, tokenizer)
    return parts.orderBy("position", "doc_id", "use").select(*MIXED)


def uses(documents: DataFrame, targets: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Every use of a text with its position and what its source was planned, not sorted; see ``mix``."""
    wanted = targets.where("target_weight > 0 AND max_repeats > 0").select(canonical("source").alias("source")).distinct()
    rows = spread(documents.select("doc_id", "source", "text")).select("doc_id", canonical("source").alias("source"), F.md5("text").alias("same"), "text").join(F.broadcast(wanted), "source", "left_semi")
    sized = with_tokens(rows, path=tokenizer).where("tokens > 0")
    texts = cut(sized.groupBy("same").agg(F.min(F.struct("doc_id", "source", "tokens")).alias("x")).select("x.*"))
    planned = plan(texts.groupBy("source").agg(F.sum("tokens").alias("supply")), targets)
    rows = texts.join(F.broadcast(planned), "source")  # settings, one row a target source
    bits = max(0, math.ceil(math.log2(max(1, texts.count() / BLOCK))))
    placed = rows.withColumn("at", F.xxhash64("doc_id"))
    placed = placed.withColumn("block", F.shiftright("at", 64 - bits) if bits else F.lit(0))
    placed = prefix_sums(placed, ["source"], "block", ["at", "doc_id"], "tokens", "before")
    passes = F.ceil(F.col("demand") / F.col("supply")).cast("int")
    again = placed.where("demand > 0").withColumn("use", F.explode(F.sequence(F.lit(1), F.least(passes, "max_repeats"))))
    start = F.col("before") + (F.col("use") - 1) * F.col("supply")
    # a use counts where more than half of it lies within the demand
    again = again.withColumn("share", (start + F.col("tokens") / 2) / F.col("demand")).where("share <= 1")
    rise = 1 - F.col("tilt")
    inverse = F.when(F.abs("tilt") < 1e-9, F.col("share")).otherwise((F.sqrt(rise * rise + 4 * F.col("tilt") * F.col("share")) - rise) / (2 * F.col("tilt")))
    return again.withColumn("position", inverse)


def mix_report(documents: DataFrame, targets: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(source, target_weight, reached_share, tokens, texts, uses, most_uses, early_share) of each target source.

    ``early_share`` is the source's share of the tokens in the first half of the training time. A target source without any
    text is listed with zeros.
    """
    used = uses(documents, targets, tokenizer)
    early = F.col("position") < 0.5
    sums = used.groupBy("source").agg(
        F.sum("tokens").alias("tokens"), F.countDistinct("doc_id").alias("texts"), F.count(F.lit(1)).alias("uses"),
        F.max("use").alias("most_uses"), F.sum(F.when(early, F.col("tokens")).otherwise(0)).alias("early"),
    )
    every = W.partitionBy()  # one row a source
    shared = sums.withColumn("reached_share", F.col("tokens") / F.sum("tokens").over(every)).withColumn("early_share", F.try_divide(F.col("early"), F.sum("early").over(every)))
    wanted = targets.where("target_weight > 0 AND max_repeats > 0").groupBy(canonical("source").alias("source")).agg(F.sum("target_weight").alias("target_weight"))
    counts = ["tokens", "texts", "uses", "most_uses"]
    shares = [F.round(F.coalesce(c, F.lit(0.0)), 6).alias(c) for c in ("target_weight", "reached_share")]
    return wanted.join(shared, "source", "left").select("source", *shares, *[F.coalesce(c, F.lit(0)).alias(c) for c in counts], F.round(F.coalesce("early_share", F.lit(0.0)), 6).alias("early_share"))
