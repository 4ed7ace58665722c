"""Quality rules: hashed n-gram log-likelihood ratio between a trusted and the raw multinomial.

Words and pairs of words fall into a fixed number of buckets. A document's score is the mean
over its n-grams of the log ratio of the bucket's share in trusted texts to its share in all
texts; documents below a fixed threshold go, next to those that fail plain counts. Everything
is built of DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wattframe.llm.staging import stage

SPACES = r"[\x20\x09-\x0D]+"
BUCKETS = 1 << 14
SMOOTHING = 1.0
THRESHOLD = -0.05
WINDOW = 8
MIN_WORDS = 20
REPEATED_PERCENT = 30


def bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once a row, however often it is used."""
    return F.transform(F.array(value), body)[0]


def shifted(hashes: Column, by: int) -> Column:
    """Hash of each element with the one ``by`` places on; as many as have one."""
    left = F.size(hashes) - by
    return F.when(left > 0, F.slice(F.zip_with(hashes, F.slice(hashes, by + 1, F.greatest(left, F.lit(1))), lambda a, b: F.xxhash64(a, b)), 1, F.greatest(left, F.lit(1)))).otherwise(
        F.array().cast("array<bigint>")
    )


def covered(windows: Column, width: int) -> Column:
    """Number of words in windows whose hash occurs twice or more."""
    ordered = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    repeated = bound(
        ordered,
        lambda all_: F.filter(
            all_,
            lambda x, k: F.coalesce(F.get(all_, k - 1)["h"] == x["h"], F.lit(False))
            | F.coalesce(F.get(all_, k + 1)["h"] == x["h"], F.lit(False)),
        ),
    )
    places = F.array_sort(F.transform(repeated, lambda x: x["i"]))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("words"))
    total = F.aggregate(
        places,
        start,
        lambda acc, p: F.struct(
            (p + width).alias("end"), (acc["words"] + width - F.greatest(F.lit(0), acc["end"] - p)).cast("long").alias("words")
        ),
    )["words"]
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(total)


def with_grams(docs: DataFrame) -> DataFrame:
    """Adds words, and the hashes of all words (ones) and of all pairs of neighbours (twos)."""
    return (
        docs.withColumn("words", F.array_remove(F.split("text", SPACES), ""))
        .withColumn("ones", F.transform("words", lambda w: F.xxhash64(w)))
        .withColumn("twos", shifted(F.col("ones"), 1))
    )


def gram_counts(docs: DataFrame) -> DataFrame:
    """(bucket, n) of all words and pairs of all texts."""
    grams = with_grams(docs.select("text")).select(F.explode(F.concat("ones", "twos")).alias("gram"))
    return grams.groupBy(F.col("gram").bitwiseAND(BUCKETS - 1).alias("bucket")).agg(F.count("*").alias("n"))


def log_ratios(trusted: DataFrame, raw: DataFrame) -> DataFrame:
    """One row with the log ratio of each bucket, in order: ``ratios``, an array of fixed size."""
    buckets = raw.sparkSession.range(BUCKETS).select(F.col("id").alias("bucket"))
    both = (
        buckets.join(trusted.select("bucket", F.col("n").alias("t")), "bucket", "left")
        .join(raw.select("bucket", F.col("n").alias("r")), "bucket", "left")
        .na.fill(0, ["t", "r"])
    )
    one = both.agg(
        F.array_sort(F.collect_list(F.struct("bucket", "t", "r"))).alias("all"),
        F.sum("t").alias("ts"),
        F.sum("r").alias("rs"),
    )
    more = SMOOTHING * BUCKETS
    return one.select(
        F.transform(
            "all",
            lambda x: F.log((x["t"] + SMOOTHING) / (F.col("ts") + more)) - F.log((x["r"] + SMOOTHING) / (F.col("rs") + more)),
        ).alias("ratios")
    )


def judged(docs: DataFrame, trusted_ids: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, score, kept.

    ``trusted_ids`` (doc_id) names the trusted documents; the raw multinomial counts all
    documents, the trusted one all of them that are trusted. A document fails the base rules
    with fewer than 20 words or more than 30% of them in repeated windows of eight words; kept
    also needs a score of ``threshold`` or more. Equal texts are judged equally.

    NULL and empty texts have zeros, no score, and fail; repeated rows repeat their result; an
    empty table gives no rows, and without trusted documents every score is the same ratio
    against an even multinomial; other columns are ignored.
    """
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # by shuffle at every size: the ids grow with the corpus
    known = trusted_ids.select("doc_id").distinct().hint("merge")
    trusted = texts.join(known, "doc_id", "left_semi")
    ratios = stage(log_ratios(gram_counts(trusted), gram_counts(texts)), "ratios")
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    grams = F.concat("ones", "twos")
    total = F.aggregate(
        grams, F.lit(0.0), lambda acc, g: acc + F.col("ratios")[g.bitwiseAND(BUCKETS - 1).cast("int")]
    )
    measured = (
        with_grams(texts)
        .withColumn("windows", shifted(shifted(F.col("twos"), 2), 4))
        .withColumns({"lines": lines, "ratios": ratios.select("ratios").scalar()})
        .select(
            "doc_id",
            F.size("words").cast("long").alias("n_words"),
            F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
            F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
            (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
            covered(F.col("windows"), WINDOW).alias("n_repeat_words"),
            F.when(F.size(grams) > 0, total / F.size(grams)).alias("score"),
        )
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words"))
    return measured.withColumn("base_failed", failed).withColumn(
        "kept", ~F.col("base_failed") & F.coalesce(F.col("score") >= threshold, F.lit(False))
    )


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against those labelled as good and not toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1 and toxic = 0")
    return judged(spark.read.parquet(f"{sf_dir}/documents.parquet"), labels)
