"""Search for a size target over tables of probes (encoding itself is an input)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Qualities and resolution steps of the image search, steps of the document search.
LOW, HIGH, IMAGE_STEPS, DOCUMENT_STEPS = 2, 97, 12, 11


def best_quality(probes: DataFrame, target: int) -> DataFrame:
    """item_id, scale_step, quality, size_bytes, reached: the first resolution step whose lowest quality fits, with its highest quality that fits;
    where none fits, the smallest probe (the earliest of equals). Sizes must not fall with quality; they are below 2**43, steps and qualities below 1,024.

    A probe's rank is one number, as a minimum of numbers is a hash aggregate (one of structs sorts): one pass, merged before the exchange.
    """
    size, step, quality = (F.col(c).cast("long") for c in ("size_bytes", "scale_step", "quality"))
    fits = size <= target
    good = F.when(fits, step * 1024 + 1023 - quality)
    poor = F.when(~fits, (size * 1024 + step) * 1024 + quality)
    best = probes.groupBy("item_id").agg(F.min(good).alias("g"), F.min_by(size, good).alias("s"), F.min(poor).alias("p"))
    pick = lambda at_good, at_poor: F.when(F.col("g").isNotNull(), at_good).otherwise(at_poor)
    g, p = F.col("g"), F.col("p")
    return best.select(
        "item_id",
        pick(F.shiftright(g, 10), F.shiftright(p, 10).bitwiseAND(1023)).alias("scale_step"),
        pick(1023 - g.bitwiseAND(1023), p.bitwiseAND(1023)).alias("quality"),
        pick(F.col("s"), F.shiftright(p, 20)).alias("size_bytes"),
        g.isNotNull().alias("reached"),
    )


def replayed_quality(sizes: Column, target: Column) -> Column:
    """Bisection over a map quality -> size, as the probes would run: the last quality found to fit, or null if the lowest does not."""
    start = F.struct(F.lit(LOW + 1).alias("lo"), F.lit(HIGH).alias("hi"), F.lit(LOW).alias("best"))

    def step(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        fits, done = F.element_at(sizes, mid) <= target, s["lo"] > s["hi"]
        return F.when(done, s).otherwise(F.struct(F.when(fits, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(fits, s["hi"]).otherwise(mid - 1).alias("hi"), F.when(fits, mid).otherwise(s["best"]).alias("best")))

    return F.when(F.element_at(sizes, F.lit(LOW)) <= target, F.aggregate(F.sequence(F.lit(1), F.lit(8)), start, step, lambda s: s["best"]))


#: Least and greatest quality of document images, and the width at which the search ends; 5 halvings get there.
DOCUMENT_LOW, DOCUMENT_HIGH, PROBES = 0.05, 0.92, 5


def document_quality(size_at, target: Column) -> Column:
    """Bisection of a document's image quality in single precision: the last one found to fit, or null if the least does not. size_at: a Column of the quality to one of bytes."""
    real = lambda x: F.lit(x).cast("float")
    start = F.struct(real(DOCUMENT_LOW).alias("lo"), real(DOCUMENT_HIGH).alias("hi"))

    def step(s: Column, _: Column) -> Column:
        mid = (s["lo"] + s["hi"]) * real(0.5)
        fits = size_at(mid) <= target
        return F.struct(F.when(fits, mid).otherwise(s["lo"]).alias("lo"), F.when(fits, s["hi"]).otherwise(mid).alias("hi"))

    return F.when(size_at(real(DOCUMENT_LOW)) <= target, F.aggregate(F.sequence(F.lit(1), F.lit(PROBES)), start, step, lambda s: s["lo"]))


PRESET = 102400  # bytes, a fixed value


def target_size(custom: Column, use_preset: Column) -> Column:
    """Bytes to reach: the preset, or what was typed; null if that is no positive size."""
    return F.when(use_preset, F.lit(PRESET).cast("long")).otherwise(T.parse_size(custom))


def guard(selected: Column, target: Column, pages: Column) -> Column:
    """What stands in the way of a job, or null: nothing selected, no valid target, no pages."""
    return F.when(F.coalesce(selected, F.lit(0)) < 1, "nothing selected").when(F.coalesce(target, F.lit(0)) < 1, "no valid target").when(F.coalesce(pages, F.lit(0)) < 1, "no pages")


def slot_counts(documents: DataFrame, slots: DataFrame) -> DataFrame:
    """documents with image_count; those without images are only written anew."""
    own = slots.groupBy("doc_id").agg(F.count(F.lit(1)).alias("image_count"))
    return documents.join(own, "doc_id", "left").withColumn("image_count", F.coalesce("image_count", F.lit(0))).withColumn("recompressed", F.col("image_count") > 0)


def shrunk(size: Column, steps: Column) -> Column:
    """A dimension after that many resamplings by 0.85, each truncated, 1 at least."""
    return F.aggregate(F.sequence(F.lit(0), steps), size.cast("long"), lambda s, k: F.when(k == 0, s).otherwise(F.greatest(F.lit(1), F.floor(s * 0.85)).cast("long")))


def first_fit(attempts: DataFrame, target: int) -> DataFrame:
    """doc_id, step, size_bytes, reached: the first attempt that fits, else the last."""
    fit = F.when(F.col("size_bytes") <= target, F.col("step"))
    pick = attempts.groupBy("doc_id").agg(F.min(F.struct(fit.isNull().alias("miss"), F.when(fit.isNull(), -F.col("step")).otherwise(F.col("step")).alias("o"), "step", "size_bytes")).alias("p"))
    return pick.select("doc_id", "p.step", "p.size_bytes", (~F.col("p.miss")).alias("reached"))


def result_message(size_text: Column, target_text: Column, reached: Column, flattened: Column) -> Column:
    return F.concat_ws("\n", size_text, F.when(~reached, F.concat(F.lit("Target not reached: "), target_text)), F.when(flattened, F.lit("Transparent areas became white.")))
