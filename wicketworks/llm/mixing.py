"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wicketworks.llm.common import WORD, cut, dropped, stored

DRAW_BITS, BUCKET_BITS = 52, 12


def words(text: str) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def source_targets(sized: DataFrame, weights: Sequence[int] = (1, 2, 3), most: int = 3) -> DataFrame:
    """(source, source_size, target): the words each source gets, of as many words as there are.

    Sources by code point, null last, take the weights in turn. A target ends at ``most`` times its
    source's size; what is cut off is shared by weight among the others, until none is above. That ends
    where each target is ``min(most * size, level * weight)`` with one level for all, found here from
    running sums over the sources in the order in which they reach their limit. ``sized`` holds source
    and size per document; the windows run over one row per source.
    """
    total = F.sum("source_size").over(Window.partitionBy())
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_limit = Window.orderBy((F.col("limit") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    sources = (
        sized.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("weight", weight.cast("long"))
        .withColumn("limit", F.col("source_size") * most)
        .withColumn("total", total)
        .withColumn("filled", F.coalesce(F.sum("limit").over(before), F.lit(0)))
        .withColumn("open", F.sum("weight").over(Window.partitionBy()) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("level", (F.col("total") - F.col("filled")).cast("double") / F.col("open"))
    )
    first = F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.struct("open", "level"))
    level = F.max(first).over(Window.partitionBy())["level"]
    target = F.least(F.col("limit").cast("double"), F.coalesce(level * F.col("weight"), F.col("limit").cast("double")))
    return sources.select("source", "source_size", target.alias("target"))


def draw(doc_id: str, seed: str) -> Column:
    """A uniform draw of 52 bits for a document, the same in every run and in any SQL engine."""
    key = F.concat_ws("/", F.lit(seed), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, DRAW_BITS // 4), 16, 10).cast("long")


def _rates(small: DataFrame, plan: DataFrame, most: int) -> DataFrame:
    """``plan`` with the expected copies of a document of weight 1, where none may expect more than ``most``.

    What documents at their limit cannot take goes to the others of their source by weight. Each round is one sum per
    source; documents only ever reach their limit, so rounds end, mostly after two or three.
    """
    summed = lambda c: F.sum(c.cast("decimal(38,6)")).cast("double")  # noqa: E731  the same in any order
    weighed = small.groupBy("key").agg(summed(F.col("weight") * F.col("size")).alias("open"))
    rate = F.when(F.col("open") > 0, F.col("target") / F.col("open")).otherwise(F.lit(0.0))
    rates = stored(plan.join(weighed, "key").withColumn("rate", rate).drop("open"))
    while True:
        over = F.col("weight") * F.col("rate") >= most
        sums = (
            small.join(rates.select("key", "rate"), "key")
            .groupBy("key")
            .agg(
                F.sum(F.when(over, F.col("size")).otherwise(0)).alias("full"),
                summed(F.when(over, F.lit(0.0)).otherwise(F.col("weight") * F.col("size"))).alias("open"),
            )
        )
        shared = F.when(F.col("open") > 0, (F.col("target") - F.col("full") * most) / F.col("open"))
        after = rates.join(sums, "key").withColumn("was", F.col("rate")).withColumn("rate", F.greatest("was", shared))
        last, rates = rates, stored(after.drop("full", "open"))
        changed = rates.where("rate > was").limit(1).count()
        dropped(last)
        if not changed:
            return rates.drop("was")


def mix_sources(
    docs: DataFrame,
    weights: Sequence[int] = (1, 2, 3),
    most: int = 3,
    seed: str = "mix",
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weight: str | None = None,
) -> DataFrame:
    """(row, size, source_size, target, copies, taken): how often the mix takes each document.

    A document's expected copies are its source's ratio ``target / size``, or in proportion to its ``weight`` inside the
    source, if a column of weights is named, up to ``most``. Of 2.3 expected copies two are certain; the rest, 0.3, is its
    inclusion probability in a Pareto sample: documents are ranked by the odds of a uniform draw divided by the odds of
    inclusion, and taken in that order up to the size that is wanted. Sizes are words, so the sample ends at the
    document that brings its words closest to what is missing.

    No source is ever sorted as a whole: words are summed by the rank's leading bits, and only documents
    that share these bits with the source's last document are put in order. Decisions come back as one
    small row per source, so texts stay where they are.

    ``row`` holds all columns of the input, whatever their names. Null or empty texts have size 0 and are
    never taken in part; a null source is a source of its own; rows with one doc_id share a draw, and hence, at equal
    weights, their fate; a null doc_id draws as an empty one. Weights that are null, negative or not finite are 0, and a source
    without other weights is not taken. An empty table gives no rows.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))  # joins null sources too
    own = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    sized = docs.select(
        F.struct("*").alias("row"),
        F.col(source).alias("source"),
        key.alias("key"),
        words(text).alias("size"),
        draw(doc_id, seed).alias("draw"),
        F.when((own >= 0) & (own < float("inf")), own).otherwise(F.lit(0.0)).alias("weight"),
    )
    small = cut(sized.select("source", "key", "size", "draw", "weight"))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    named = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    plan = source_targets(small, weights, most).withColumn("key", named).drop("source")
    # Plans are stored, so that Spark knows how small they are: the rows then need not be moved to one task for each source.
    plan = stored(plan.withColumn("rate", ratio)) if weight is None else _rates(small, plan, most)

    def ranked(rows: DataFrame, plan: DataFrame) -> DataFrame:
        """Certain copies, inclusion probability ``part``, rank and the rank's leading bits."""
        expected = F.least(F.lit(float(most)), F.col("rate") * F.col("weight"))
        u = (F.col("draw") + 0.5) / float(1 << DRAW_BITS)
        odds = u / (1 - u) * (1 - F.col("part")) / F.when(F.col("part") > 0, F.col("part"))
        bucket = F.least(F.floor(F.col("rank.odds") / (1 + F.col("rank.odds")) * (1 << BUCKET_BITS)), F.lit((1 << BUCKET_BITS) - 1))
        return (
            rows.join(plan, "key")
            .withColumn("whole", F.floor(expected).cast("long"))
            .withColumn("part", expected - F.col("whole"))
            .withColumn("rank", F.struct(odds.alias("odds"), "draw"))
            .withColumn("bucket", bucket.cast("int"))
        )

    parts = ranked(small, plan).where("part > 0")
    wanted = F.max(F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size")))
    if weight is not None:
        wanted = F.sum((F.col("part") * F.col("size")).cast("decimal(38,6)")).cast("double")
    extras = parts.groupBy("key").agg(wanted.alias("extra"))
    sums = parts.groupBy("key", "bucket").agg(F.sum("size").alias("words"))
    upto = F.sum("words").over(Window.partitionBy("key").orderBy("bucket"))
    crossed = sums.withColumn("upto", upto).join(extras, "key").where("upto > extra")
    last = crossed.groupBy("key").agg(F.min(F.struct("bucket", (F.col("upto") - F.col("words")).alias("before"), "extra")).alias("at"))
    last = stored(last.select("key", "at.*"))
    near = parts.select("key", "bucket", "rank", "size").join(last, ["key", "bucket"])
    inside = Window.partitionBy("key").orderBy("rank").rangeBetween(Window.unboundedPreceding, 0)
    missing = F.abs(F.col("before") + F.sum("size").over(inside) - F.col("extra"))
    best = near.withColumn("missing", missing).groupBy("key").agg(F.min(F.struct("missing", "rank")).alias("best"))
    end = F.when(F.col("best.missing") < F.abs(F.col("before") - F.col("extra")), F.col("best.rank"))
    ends = last.join(best, "key").select("key", F.col("bucket").alias("last"), end.alias("end"))
    decided = stored(plan.join(ends, "key", "left"))
    # Without a last bucket, all of a source's parts together do not make up what is missing.
    chosen = F.col("last").isNull() | (F.col("bucket") < F.col("last"))
    chosen = chosen | F.coalesce((F.col("bucket") == F.col("last")) & (F.col("rank") <= F.col("end")), F.lit(False))
    copies = F.col("whole") + F.when((F.col("part") > 0) & chosen, 1).otherwise(0)
    return (
        ranked(sized, decided)
        .withColumn("copies", copies.cast("long"))
        .select("row", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
    )
