"""URL allow and block rules by hashed host-suffix and path-prefix expressions.

Each distinct (host, path) is expanded into the host suffixes (cut at label
boundaries) combined with the path prefixes, of every number of labels and
every length that some rule has.  The expressions meet the rules in an equi-join on the first four bytes of their
SHA-256; a hit counts only if the full digests agree.  The longest rule wins.

The verdict is a function of (host, path), so pages are reduced to distinct
pairs first: a host or a url that holds a third of all rows costs one row a
map task, and the join back to the pages is a plain equi-join that AQE splits
where one pair is very frequent.  The rule table is joined without a hint:
Catalyst broadcasts it only below ``spark.sql.autoBroadcastJoinThreshold``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from reco.llm.common import free_name

PREFIX_HEX = 8  # four bytes, as hex digits
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``allow`` or ``block`` for a host and its subdomains, where the url's
    path starts with ``path`` (which begins with a slash)."""
    verdict: str
    host: str
    path: str


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased.
    Null url or no ``://``: empty."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    rows = [(r.verdict, r.host, r.path) for r in rules]
    df = spark.createDataFrame(rows, "verdict string, rule_host string, rule_path string")
    return _hashed(df, F.concat("rule_host", F.lit("\n"), "rule_path"))


def _hashed(df: DataFrame, expression: Column) -> DataFrame:
    return (df.withColumn("digest", F.sha2(expression.cast("binary"), 256))
            .withColumn("prefix", F.substring("digest", 1, PREFIX_HEX)))


def expand(pairs: DataFrame, path_lengths: list[int], label_counts: list[int]) -> DataFrame:
    """``host, path`` -> one hashed row per host suffix of as many labels and
    path prefix of as many code points as given."""
    def ints(values: list[int]) -> Column:
        return F.array(*[F.lit(n) for n in values]) if values else F.array().cast("array<int>")
    n_labels = F.length("host") - F.length(F.replace(F.col("host"), F.lit("."), F.lit(""))) + 1
    x = (pairs.withColumn("_n", F.explode(F.filter(ints(label_counts), lambda n: n <= n_labels)))
         .withColumn("_suffix", F.expr("substring_index(host, '.', -_n)"))
         .withColumn("_k", F.explode(F.filter(ints(path_lengths), lambda n: n <= F.length("path"))))
         .withColumn("_prefix", F.substring(F.col("path"), F.lit(1), F.col("_k"))))
    return _hashed(x, F.concat("_suffix", F.lit("\n"), "_prefix"))


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with ``host, path, rule, verdict`` in place of same-named
    columns; all other columns and every row stay.

    Null urls and urls without ``://`` have an empty host and path, which no
    rule fits.  Where no rule fits, ``rule`` is null and ``verdict`` is
    ``default``.  Of equally long rules the one with the longer host wins,
    then ``block``.  Repeated rows are judged alike; an empty table or an
    empty rule list gives no hits.  ``rules`` comes from ``rule_table``.
    """
    # at most as many numbers as the longest rule has code points
    lengths = [r[0] for r in rules.select(F.length("rule_path")).distinct().collect()]
    labels = [r[0] for r in rules.select(F.size(F.split("rule_host", r"\."))).distinct().collect()]
    keep = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    p = pages.select(*[F.col(f"`{c}`") for c in keep], host_of(F.col(f"`{url}`")).alias("host"),
                     path_of(F.col(f"`{url}`")).alias("path"))
    pairs = (pages.select(host_of(F.col(f"`{url}`")).alias("host"), path_of(F.col(f"`{url}`")).alias("path"))
             .filter(F.col("host") != "").distinct())
    e, r = expand(pairs, sorted(lengths), sorted(labels)).alias("e"), rules.alias("r")
    hits = (e.join(r, F.col("e.prefix") == F.col("r.prefix"))
            .filter(F.col("e.digest") == F.col("r.digest"))
            .select("host", "path", "verdict", F.concat("rule_host", "rule_path").alias("rule"),
                    F.struct(F.length("rule_host") + F.length("rule_path"), F.length("rule_host"),
                             (F.col("verdict") == "block").cast("int"),
                             F.concat("rule_host", "rule_path")).alias("_order")))
    best = (hits.groupBy("host", "path")
            .agg(F.max_by(F.struct("rule", "verdict"), "_order").alias("_hit")))
    hit = free_name(keep, "_hit")
    return (p.join(best.withColumnRenamed("_hit", hit), ["host", "path"], "left")
            .select(*[F.col(f"`{c}`") for c in keep], "host", "path", F.col(f"{hit}.rule").alias("rule"),
                    F.coalesce(F.col(f"{hit}.verdict"), F.lit(default)).alias("verdict")))
