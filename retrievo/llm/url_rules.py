"""URL verdicts by an equi-join of host-suffix and path-prefix expressions with a rule table.

Spark expressions only. An expression is a suffix of the host's labels and a prefix of the path. Only suffixes of as
many labels as some rule has and prefixes as long as some rule's path are made, so a URL gives a number of expressions
that the rules bound. They meet the rules on the first bytes of a digest; the full digest decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retrievo.staging import stage

PREFIX_HEX = 8  # hex digits of the digest that the join compares
DEFAULT = "allow"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, _PARTS, 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = DEFAULT) -> DataFrame:
    """Every row of ``pages`` with ``host``, ``path``, ``rule`` and ``verdict``.

    ``rules`` has ``host``, ``path`` and ``action`` (allow or block). A rule fits its host and all subdomains if the
    path starts with the rule's. The longest rule decides; of equally long ones block goes before allow, then the
    larger host does. Without a fitting rule ``rule`` is null and ``verdict`` the default. A null URL and one without
    ``://`` have an empty host and path. Rules with a null part fit nothing; repeated rules count once. Columns of
    ``pages`` named like a result are replaced, all others kept. Rows may repeat; each gets its verdict.
    """
    known = rules.select(F.translate("host", _UPPER, _LOWER).alias("rule_host"), F.col("path").alias("rule_path"),
                         "action").dropna().distinct()
    known = stage(known.withColumn("rule", F.concat("rule_host", "rule_path"))
                  .withColumn("rule_digest", F.sha2("rule", 256))
                  .withColumn("rule_prefix", F.substring("rule_digest", 1, PREFIX_HEX)), "rules")
    shape = known.agg(F.max(F.size(F.split("rule_host", r"\."))).alias("labels"),
                      F.sort_array(F.collect_set(F.char_length("rule_path"))).alias("lengths")).first()

    pages = pages.drop("rule", "verdict").withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(shape.labels or 1))),
                           lambda i: F.array_join(F.slice(labels, -i, i), "."))
    lengths = F.filter(F.array([F.lit(n) for n in shape.lengths]).cast("array<int>"),
                       lambda n: n <= F.char_length("path"))
    prefixes = F.transform(lengths, lambda n: F.substring(F.col("path"), F.lit(1), n))
    expressions = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))
    digests = pages.select("host", "path").distinct() \
        .select("host", "path", F.explode(F.transform(expressions, lambda e: F.sha2(e, 256))).alias("digest")) \
        .withColumn("prefix", F.substring("digest", 1, PREFIX_HEX))
    rank = F.struct(F.char_length("rule"), F.col("action") == "block", "rule_host")
    verdicts = digests.join(known, F.col("prefix") == F.col("rule_prefix")).where("digest = rule_digest") \
        .groupBy("host", "path").agg(F.max_by(F.struct("rule", "action"), rank).alias("best")) \
        .select("host", "path", "best.rule", F.col("best.action").alias("verdict"))
    names = [c for c in pages.columns if c not in ("host", "path")]
    return pages.join(stage(verdicts, "verdicts"), ["host", "path"], "left") \
        .select(*names, "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
