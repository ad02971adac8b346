"""URL filters by hashed expressions.

A rule is a host and a path, like `example.org/es/`; it fits its host and all
subdomains where the URL's path starts with the rule's. Each distinct (host,
path) is expanded to its expressions: every suffix of the host with as many labels
as some rule's host, with every prefix of the path whose length some rule's path
has; other expressions can meet no rule. Expressions meet the rules
in an equi-join on the first 32 bits of their SHA-256, the full digests confirm
the match, and of the rules that fit the longest wins (then the one with the
longer host; block before allow for one rule given twice).

The verdicts of distinct (host, path) pairs are then joined to the rows, so a
very common URL is expanded once.

Defined cases: a null URL, or one without '://', has an empty host and path and
fits no rule; without a rule the verdict is allow; null ids and repeated rows keep
their rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmap.llm.shared import table, with_columns_renamed_apart

RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Rules up to this many (about 100 bytes each) are sent to all tasks; more are joined by a shuffle.
BROADCAST_RULES = 100_000
DEFAULT = "allow"


def rule_table(spark, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "verdict string, host string, path string")


def url_parts(url) -> tuple:
    """Host (A-Z lower-cased) and path of a URL column."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def judged(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict of each row."""
    rows = with_columns_renamed_apart(pages, {id_col: "page_id", url_col: "url"})
    host, path = url_parts(F.col("url"))
    rows = rows.select(F.col("page_id").cast("long"), host.alias("host"), path.alias("path"))
    own = rules.select(
        F.concat("host", "path").alias("rule"),
        F.col("verdict").alias("rule_verdict"),
        F.length("host").alias("rule_host"),
        F.sha2(F.concat("host", F.lit("\n"), "path"), 256).alias("rule_digest"),
    ).withColumn("key", F.substring("rule_digest", 1, 8))
    # As many numbers as the longest path of a rule has characters, and its longest host labels, at most.
    sizes_of = lambda c: F.array(*[F.lit(r[0]) for r in rules.select(c.alias("n")).distinct().orderBy("n").collect()])
    lengths, depths = sizes_of(F.length("path")), sizes_of(F.size(F.split("host", r"\.")))
    # Rows without a host fit no rule: they stay out of the joins.
    hosted = rows.filter("host <> ''")
    pairs = hosted.select("host", "path").distinct()
    n_labels = F.octet_length("host") - F.octet_length(F.replace(F.col("host"), F.lit("."), F.lit(""))) + 1
    suffixes = F.transform(F.filter(depths, lambda n: n <= n_labels), lambda n: F.call_function("substring_index", F.col("host"), F.lit("."), -n))
    prefixes = F.transform(F.filter(lengths, lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    expressions = pairs.select("host", "path", F.explode(suffixes).alias("suffix"), prefixes.alias("prefixes"))
    expressions = expressions.select("host", "path", "suffix", F.explode("prefixes").alias("prefix"))
    expressions = expressions.select("host", "path", F.sha2(F.concat("suffix", F.lit("\n"), "prefix"), 256).alias("digest")).withColumn("key", F.substring("digest", 1, 8))
    if rules.count() <= BROADCAST_RULES:
        own = F.broadcast(own)
    hits = expressions.join(own, "key").filter(F.col("digest") == F.col("rule_digest"))
    rank = F.struct(F.length("rule"), "rule_host", (F.col("rule_verdict") == "block").cast("int"), "rule", "rule_verdict")
    best = hits.groupBy(F.col("host").alias("h"), F.col("path").alias("p")).agg(F.max(rank).alias("best"))
    found = hosted.join(best, (F.col("host") == F.col("h")) & (F.col("path") == F.col("p")), "left").select("page_id", "host", "path", "best.rule", "best.rule_verdict")
    found = found.union(rows.filter("host = ''").select("page_id", "host", "path", F.lit(None).cast("string"), F.lit(None).cast("string")))
    return found.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", F.lit(DEFAULT)).alias("verdict"))


_VALUES = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
SQL = rf"""
WITH u AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path, row_number() OVER () AS row FROM pages
), r(v, h, p) AS (VALUES {_VALUES}),
fits AS (SELECT row, max_by(h || p, length(h || p)) AS rule, max_by(v, length(h || p)) AS v FROM u JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY row)
SELECT page_id, host, path, rule, coalesce(v, '{DEFAULT}') AS verdict FROM u LEFT JOIN fits USING (row)
"""


def op5_hashed_expressions(spark, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages"), rule_table(spark))
