"""Mixing sources to target weights by entropy balancing.

Every source has to give a target number of words. Of all rates between 0 and a limit, the
ones closest to 1 in relative entropy that meet the targets are exponential in a document's
size, cut at the limit; one multiplier per source solves the convex dual, found by Newton
steps over the counts of documents by source and size. Rates are then rounded into copies.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from wattframe.llm.staging import stage

WORD = r"[^\x20\x09-\x0D]+"
SHARE = 1.5
LIMIT = 2
STEPS = 100
TOLERANCE = 1e-9
BINS = 4096
REPAIRS = 6


def word_count(text: Column) -> Column:
    """Number of words; 0 for NULL."""
    return F.coalesce(F.size(F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")).cast("long"), F.lit(0).cast("long"))


def targets(sources: DataFrame, share: float = SHARE, limit: int = LIMIT) -> DataFrame:
    """Adds ``target`` to (k, source_size, weight), one row a source.

    ``share`` times all sizes are dealt by weight; none gets more than ``limit`` times its own
    size, and the excess goes to the others by weight. The sources that end at the limit are
    those with the least limit for their weight, so one ordered pass finds the level.
    """
    every = Window.partitionBy()
    order = Window.orderBy(F.col("cap") / F.col("weight"), "k")
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    level = (share * F.sum("source_size").over(every) - before) / rest
    return (
        sources.withColumn("cap", (limit * F.col("source_size")).cast("double"))
        .withColumn("level", level)
        .withColumn("level", F.max(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("level"))).over(every))
        .withColumn("target", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), "cap")))
        .drop("cap", "level")
    )


def balanced(sizes: DataFrame, sources: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(k, tilt, scale, full): the multiplier of each source, by safeguarded Newton steps.

    ``sizes`` has (k, size, n), ``sources`` (k, source_size, target). A document's rate is
    ``exp(tilt * size / scale)``, at most ``limit``; ``full`` sources take the limit
    throughout. Words taken grow with the tilt, so each step also narrows a bracket, and a
    Newton step that leaves it is replaced by the middle.
    """
    scale = (
        sizes.where("size > 0")
        .groupBy("k")
        .agg(
            (F.sum(F.col("n") * F.col("size") * F.col("size")) / F.sum(F.col("n") * F.col("size"))).alias("scale"),
            F.min("size").alias("least"),
        )
    )
    rises = F.col("target") > F.col("source_size")
    state = stage(
        sources.join(scale, "k").select(
            "k",
            "target",
            "scale",
            (F.col("target") >= limit * F.col("source_size") * (1 - 1e-12)).alias("full"),
            F.lit(0.0).alias("tilt"),
            F.when(rises, 0.0).otherwise(float("-inf")).alias("low"),
            F.when(rises, F.log(F.lit(float(limit))) * F.col("scale") / F.col("least")).otherwise(0.0).alias("high"),
            F.lit(float("inf")).alias("gap"),
        ),
        "balance",
    )
    rate = F.exp(F.col("tilt") * F.col("size") / F.col("scale"))
    words = F.col("n") * F.col("size")
    for _ in range(STEPS):
        sums = (
            sizes.where("size > 0")
            .join(state.select("k", "tilt", "scale"), "k")
            .groupBy("k")
            .agg(
                F.sum(words * F.least(F.lit(float(limit)), rate)).alias("taken"),
                F.sum(F.when(rate < limit, words * rate * F.col("size") / F.col("scale")).otherwise(0.0)).alias("slope"),
            )
        )
        over = F.col("taken") > F.col("target")
        low = F.when(over, F.col("low")).otherwise(F.col("tilt"))
        high = F.when(over, F.col("tilt")).otherwise(F.col("high"))
        newton = F.col("tilt") - (F.col("taken") - F.col("target")) / F.when(F.col("slope") > 0, F.col("slope"))
        gap = F.abs(F.col("taken") - F.col("target")) / F.greatest(F.col("target"), F.lit(1.0))
        done = F.col("full") | (gap <= TOLERANCE)
        state = stage(
            state.join(sums, "k")
            .withColumns({"low": low, "high": high, "newton": newton, "gap": F.when(done, 0.0).otherwise(gap)})
            .withColumn(
                "tilt",
                F.when(F.col("gap") == 0, F.col("tilt"))
                .when((F.col("newton") > F.col("low")) & (F.col("newton") < F.col("high")), F.col("newton"))
                .otherwise((F.col("low") + F.col("high")) / 2),
            )
            .select("k", "target", "scale", "full", "tilt", "low", "high", "gap"),
            "balance",
        )
        if not (state.agg(F.max("gap")).first()[0] or 0) > 0:
            break
    return state.select("k", "tilt", "scale", "full")


def _rounded(classes: DataFrame, limit: int) -> DataFrame:
    """Copies of each class of equal documents: (k, size, n, copies).

    Running sums of the rates are rounded, so copies are off by less than one anywhere; what
    is then missing or over in words is made up by the sizes that fit, the largest first.
    """
    source = Window.partitionBy("k")
    running = F.sum(F.col("n") * F.col("rate")).over(
        source.orderBy("size").rowsBetween(Window.unboundedPreceding, 0)
    )
    most = limit * F.col("n")
    ends = F.floor(running + 0.5)
    start = F.coalesce(F.lag(ends).over(source.orderBy("size")), F.lit(0))
    out = classes.withColumn("copies", F.least(F.greatest(ends - start, F.lit(0)), most))

    def repaired(df: DataFrame, _: int) -> DataFrame:
        gap = F.col("target") - F.sum(F.col("copies") * F.col("size")).over(source)
        room = F.when(F.col("gap") > 0, most - F.col("copies")).otherwise(F.col("copies"))
        fits = (F.col("size") > 0) & (F.col("size") <= F.abs("gap")) & (F.col("room") > 0)
        larger = source.orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, -1)
        used = F.coalesce(F.sum(F.when(F.col("fits"), F.col("room") * F.col("size"))).over(larger), F.lit(0))
        change = F.least(F.col("room"), F.floor((F.abs("gap") - F.col("used")) / F.col("size")))
        return (
            df.withColumn("gap", gap)
            .withColumn("room", room)
            .withColumn("fits", fits)
            .withColumn("used", used)
            .withColumn(
                "copies",
                F.when(
                    F.col("fits") & (F.col("used") < F.abs("gap")),
                    F.col("copies") + F.signum("gap").cast("long") * change,
                ).otherwise(F.col("copies")),
            )
            .drop("gap", "room", "fits", "used")
        )

    return reduce(repaired, range(REPAIRS), out).select("k", "size", "n", "copies")


def mixed(docs: DataFrame, weights: DataFrame, share: float = SHARE, limit: int = LIMIT) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, rate, copies, taken.

    ``weights`` has a row (source, weight > 0) per source, NULL counting as one; sources
    without a row are left out of the mix and the result. There is one row of weights a
    source, so that table, not the documents, passes one ordered window.

    Sizes are words of whole texts (NULL: 0). Documents of one source and size have one rate.
    Within such a class the copies that don't divide evenly go by the order of a hash of
    doc_id, found in 4096 bins, so a class with a third of all rows is split. ``taken`` is
    copies times size, at most ``limit`` times the size, and reruns agree. A source without
    words has target 0 and takes each document once. Repeated rows are documents of their own;
    rows without an id are ordered like an id of their own; other columns are ignored; an
    empty table gives no rows.
    """
    sizes = stage(
        docs.select(
            F.col("doc_id").cast("long"), F.col("source").cast("string"), word_count(F.col("text").cast("string")).alias("size")
        ),
        "sizes",
    )
    counts = stage(sizes.groupBy("source", "size").agg(F.count("*").alias("n")), "counts")
    totals = counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    named = weights.select(F.col("source").cast("string").alias("name"), F.col("weight").cast("double"))
    ranked = totals.join(named, F.col("source").eqNullSafe(F.col("name"))).drop("name")
    sources = stage(
        targets(
            ranked.withColumn("k", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))), share, limit
        ),
        "targets",
    )
    names = sources.select("k", F.col("source").alias("name"))
    keyed = stage(
        counts.join(names, F.col("source").eqNullSafe(F.col("name"))).select("k", "size", "n"), "counts"
    )
    tilts = balanced(keyed, sources, limit)
    rate = F.when(F.col("full"), float(limit)).otherwise(
        F.least(F.lit(float(limit)), F.exp(F.col("tilt") * F.col("size") / F.col("scale")))
    )
    classes = (
        keyed.join(sources.select("k", "target"), "k")
        .join(tilts, "k", "left")
        .withColumn("rate", F.when(F.col("size") == 0, 1.0).otherwise(F.coalesce(rate, F.lit(1.0))))
        .select("k", "size", "n", "target", "rate")
    )
    copies = stage(_rounded(classes, limit).join(classes.select("k", "size", "rate"), ["k", "size"]), "copies")
    place = F.xxhash64("doc_id", F.lit("mix"))
    placed = stage(
        sizes.join(names, F.col("source").eqNullSafe(F.col("name")))
        .drop("name")
        .withColumns({"place": place, "bin": F.pmod(place, F.lit(BINS))}),
        "placed",
    )
    bins = placed.groupBy("k", "size", "bin").agg(F.count("*").alias("docs"))
    ahead = F.sum("docs").over(
        Window.partitionBy("k", "size").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = stage(
        bins.withColumn("ahead", F.coalesce(ahead, F.lit(0)))
        .join(copies, ["k", "size"])
        .select(
            "k", "size", "bin", "ahead", "rate",
            F.floor(F.col("copies") / F.col("n")).alias("each"),
            (F.col("copies") % F.col("n")).alias("extra"),
        ),
        "offsets",
    )
    rank = F.row_number().over(Window.partitionBy("k", "size", "bin").orderBy("place", "doc_id"))
    taken = F.col("each") + F.when(F.col("ahead") + F.col("rank") <= F.col("extra"), 1).otherwise(0)
    return (
        placed.withColumn("rank", rank)
        .join(offsets, ["k", "size", "bin"])
        .join(sources.select("k", "source_size", "target"), "k")
        .select(
            "doc_id", "source", "size", "source_size", "target", "rate",
            taken.cast("long").alias("copies"),
            (taken * F.col("size")).cast("long").alias("taken"),
        )
    )


def cyclic_weights(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1)) -> DataFrame:
    """(source, weight) with the weights repeating over the sources by code point, NULL last."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    return (
        docs.select(F.col("source").cast("string"))
        .distinct()
        .withColumn("weight", F.element_at(F.lit(list(weights)), (F.row_number().over(order) - 1) % len(weights) + 1))
    )


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents, 150% of their words."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mixed(docs, cyclic_weights(docs)).select(
        "doc_id", "size", "source_size", "target", "taken", "source", "rate", "copies"
    )
