"""URL filters by expression expansion and short hash prefixes.  Native: DataFrame functions only.

Every URL is expanded into (host suffix, path prefix) expressions, but only of the shapes (labels in the
host, characters in the path) that some rule has.  Expressions meet the rules in an equi-join on the first
32 bits of their SHA-256; the full digest is then compared, and precedence picks one rule per URL.

* Rules are broadcast while their number is at most ``BROADCAST_RULES`` (about 40 MB); a longer list meets the expressions
  in a shuffled equi-join, whose hot keys adaptive execution splits.
* Matches are reduced to one best rule per URL by a map-side max before the only exchange.
* A url that is null or has no ``://`` has an empty host and path and fits no rule.  Repeated rows, repeated
  page_ids and null ids stay separate rows.  An empty table gives an empty result; extra columns are ignored.
* Precedence: the longest rule (host plus path); then the longer host; then block before allow.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_RULES = 200_000
DEFAULT_VERDICT = "allow"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

Rule = tuple[str, str]  # (host/path, allow or block)


def url_host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def rules_frame(spark, rules: Sequence[Rule]) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rules], "rule string, verdict string")


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def _prepared(rules: DataFrame) -> DataFrame:
    """Rules with their shape, digest and prefix.  Of rules with the same text, block comes before allow."""
    cut = F.locate("/", "rule")
    parts = (
        rules.select(F.col("rule").cast("string").alias("rule"), F.col("verdict").cast("string").alias("rule_verdict"))
        .filter("rule is not null and rule_verdict is not null and rule <> ''")
        .withColumn("r_host", F.translate(F.when(cut > 0, F.substring_index("rule", "/", 1)).otherwise(F.col("rule")), UPPER, LOWER))
        .withColumn("r_path", F.when(cut > 0, F.expr("substring(rule, locate('/', rule))")).otherwise(F.lit("")))
    )
    return (
        parts.groupBy("r_host", "r_path").agg(F.max("rule_verdict").alias("rule_verdict"), F.min("rule").alias("rule"))
        .withColumn("labels", F.size(F.split("r_host", r"\.")))
        .withColumn("path_chars", F.length("r_path"))
        .withColumn("r_digest", _digest(F.col("r_host"), F.col("r_path")))
        .withColumn("prefix", F.substring("r_digest", 1, 8))
    )


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", keep: Sequence[str] = ("page_id",), default: str = DEFAULT_VERDICT) -> DataFrame:
    """One row per input row: keep columns, host, path, rule (null if none fits) and verdict."""
    ready = _prepared(rules)
    n_rules, shapes = ready.agg(F.count("*"), F.array_sort(F.collect_set(F.struct("labels", "path_chars")))).first()
    base = pages.select(*keep, F.col(url).alias("__url")).select(
        *keep, F.monotonically_increasing_id().alias("__row"), url_host(F.col("__url")).alias("host"), url_path(F.col("__url")).alias("path")
    )
    if not n_rules:
        return base.select(*keep, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    labels = F.col("__labels")
    expressions = [
        F.when(
            (F.size(labels) >= k) & (F.length("path") >= n),
            F.struct(F.substring_index("host", ".", -k).alias("host"), F.expr(f"left(path, {n})").alias("path")),
        )
        for k, n in shapes
    ]
    expanded = (
        base.withColumn("__labels", F.split("host", r"\."))
        .withColumn("__e", F.explode_outer(F.array_compact(F.array(*expressions))))
        .select(*keep, "__row", "host", "path", _digest(F.col("__e.host"), F.col("__e.path")).alias("__digest"))
        .withColumn("prefix", F.substring("__digest", 1, 8))
    )
    side = ready.select("prefix", "r_digest", "rule", "rule_verdict", F.length("r_host").alias("r_host_chars"))
    if n_rules <= BROADCAST_RULES:
        side = F.broadcast(side)
    hit = F.when(
        F.col("__digest") == F.col("r_digest"),
        F.struct(F.length("rule").alias("size"), F.col("r_host_chars"), F.col("rule_verdict"), F.col("rule")),
    )
    best = expanded.join(side, "prefix", "left").groupBy(*keep, "__row", "host", "path").agg(F.max(hit).alias("__best"))
    return best.select(*keep, "host", "path", F.col("__best.rule").alias("rule"), F.coalesce(F.col("__best.rule_verdict"), F.lit(default)).alias("verdict"))


#: The rule set of the registered query.
QUERY_RULES: tuple[Rule, ...] = (
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
)


def op3_url_filters(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return filter_urls(table(spark, sf_dir, "pages"), rules_frame(spark, QUERY_RULES))


ORACLE_SQL = """
WITH rules(rule, rule_verdict) AS (VALUES ('com/', 'allow'), ('example.com/en/', 'block'), ('www.example.com/en/', 'allow'),
                                          ('net/es/', 'block'), ('net/fr/', 'block')),
parts AS (
  SELECT page_id, row_number() OVER () AS rid,
         translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
hits AS (
  SELECT p.*, r.rule, r.rule_verdict,
         row_number() OVER (PARTITION BY rid ORDER BY length(r.rule) DESC NULLS LAST) AS k
  FROM parts p LEFT JOIN rules r
    ON (p.host = split_part(r.rule, '/', 1) OR ends_with(p.host, '.' || split_part(r.rule, '/', 1)))
   AND starts_with(p.path, substr(r.rule, strpos(r.rule, '/'))))
SELECT page_id, host, path, rule, coalesce(rule_verdict, 'allow') AS verdict FROM hits WHERE k = 1
"""
