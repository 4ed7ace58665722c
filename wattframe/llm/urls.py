"""URL filters by hash prefixes.

Each URL is expanded into expressions, a suffix of its host with a prefix of its path. Short
prefixes of their digests meet those of the rules in an equi-join, full digests confirm the
hits, and the longest rule decides. Everything is built of DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from wattframe.tables import local_table

PREFIX = 8  # hexadecimal digits of a digest that are joined
BROADCAST_RULES = 100_000
SALTS = 32
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
RULE_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in ("host", "path", "verdict")])


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path: both empty for NULL and where there is no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"\A([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return host, path


def host_suffixes(host: Column, labels: list[int]) -> Column:
    """The last so many labels of the host, for each of the numbers that it has."""
    parts = F.split(host, r"\.")
    numbers = F.filter(F.array(*map(F.lit, labels)), lambda n: n <= F.size(parts))
    return F.transform(numbers, lambda n: F.array_join(F.slice(parts, F.size(parts) - n + 1, n), "."))


def path_prefixes(path: Column, lengths: list[int]) -> Column:
    """Starts of the path, of each of the lengths that it has."""
    numbers = F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.length(path))
    return F.transform(numbers, lambda n: F.substring(path, 1, n))


def digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat_ws("\n", host, path), 256)


def filtered(pages: DataFrame, rules: DataFrame, default: str = "allow", broadcast_rules: int = BROADCAST_RULES) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict.

    ``rules`` (host, path, verdict) fit their host and all hosts below it where the URL's path
    starts with the rule's. The longest rule wins, host and path together; then the longer
    host; then ``block``. ``rule`` is host and path of the winner, NULL where none fits, and
    then the verdict is ``default``. Up to ``broadcast_rules`` rules, by count, go to every
    task; more are joined by shuffle with salted keys, as an expression like ``com/`` may
    stand for a third of all rows.

    A URL is only expanded to the path lengths and numbers of host labels that rules have, so
    one of a megabyte is no harder than others. NULL URLs and those without ``://`` have an empty host and path and only meet rules
    without a host. Rows that repeat an id and URL give a row each; other columns are ignored;
    an empty table gives no rows, and without rules all verdicts are the default.
    """
    host, path = url_parts(F.col("url").cast("string"))
    urls = pages.select(
        "page_id", F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path")
    )
    known = rules.select(
        F.translate(F.coalesce("host", F.lit("")), UPPER, LOWER).alias("rule_host"),
        F.coalesce("path", F.lit("")).alias("rule_path"),
        "verdict",
    ).distinct()
    small = known.limit(broadcast_rules + 1).count() <= broadcast_rules
    # As many numbers as rules have different lengths and labels; longer URLs give no more expressions.
    sizes = known.agg(F.collect_set(F.length("rule_path")), F.collect_set(F.size(F.split("rule_host", r"\."))))
    lengths, labels = (sorted(x) or [0] for x in sizes.first())
    known = known.withColumn("digest", digest(F.col("rule_host"), F.col("rule_path"))).withColumn(
        "prefix", F.substring("digest", 1, PREFIX)
    )
    asked = urls.groupBy("page_id", "host", "path").agg(F.count("*").alias("times"))
    suffixes = asked.withColumn("suffix", F.explode_outer(host_suffixes(F.col("host"), labels)))
    expressions = (
        suffixes.withColumn("start", F.explode_outer(path_prefixes(F.col("path"), lengths)))
        .withColumn("own", digest(F.col("suffix"), F.col("start")))
        .withColumn("prefix", F.substring("own", 1, PREFIX))
        .drop("suffix", "start")
    )
    if small:
        hits = expressions.join(F.broadcast(known), "prefix", "left")
    else:
        salted = expressions.withColumn("salt", F.pmod(F.xxhash64("page_id", "host", "path"), F.lit(SALTS)))
        copies = known.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        hits = salted.join(copies, ["prefix", "salt"], "left")
    fits = F.coalesce(F.col("digest") == F.col("own"), F.lit(False))
    rank = F.struct(
        F.length("rule_host") + F.length("rule_path"), F.length("rule_host"), F.col("verdict") == "block"
    )
    best = F.max_by(F.struct("rule_host", "rule_path", "verdict"), F.when(fits, rank))
    return (
        hits.groupBy("page_id", "host", "path", "times")
        .agg(F.max(fits).alias("fits"), best.alias("best"))
        .select(
            "page_id",
            "host",
            "path",
            F.when(F.col("fits"), F.concat("best.rule_host", "best.rule_path")).alias("rule"),
            F.when(F.col("fits"), F.col("best.verdict")).otherwise(F.lit(default)).alias("verdict"),
            F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("copy"),
        )
        .drop("copy")
    )


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages against five rules."""
    return filtered(spark.read.parquet(f"{sf_dir}/pages.parquet"), local_table(spark, RULES, RULE_SCHEMA))


OP4_SQL = r"""
with parts as (
    select page_id,
        case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest
    from pages
), urls as (
    select row_number() over () as r, page_id,
        translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path
    from parts
), rules(rule_host, rule_path, verdict) as (
    values ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
        ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), hits as (
    select r, rule_host || rule_path as rule, verdict,
        row_number() over (partition by r order by length(rule_host || rule_path) desc, length(rule_host) desc) as n
    from urls join rules on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)
)
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict
from urls left join (select * from hits where n = 1) h using (r)
"""
