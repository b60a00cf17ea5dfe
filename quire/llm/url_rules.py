"""URL filter rules, found by their rarest literal token and then tried as regular expressions.

A rule is a host and a path prefix; it fits the host and all its subdomains.  Its *tokens* are the
labels of the host and the path parts that the rule holds whole.  The index files each rule under the
one token that the fewest rules share.  A URL is cut into the same tokens, which fetch candidate rules
from the index; only those candidates are run as patterns, and the longest that fits decides.

Defined results: a null URL, or one without ``://``, has an empty host and path and no rule; of rules
alike in length the longer host wins, then ``block``; a rule without any whole token is filed under the
empty token, which every URL has.  Repeated rows are judged alike; every input row yields one output row.
Rules are a table: up to ``MAX_BROADCAST_RULES`` rows, which are counted first, the index is sent to all
executors; a longer list is joined by token, spread over ``salts`` copies so that a frequent token is
not one task's work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: At about 200 bytes a rule, some 20 MB.
MAX_BROADCAST_RULES = 100_000
RULES = "action string, host string, path string"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def tokens(host: Column, path: Column) -> Column:
    """Distinct labels and path parts; a path part that nothing ends is no token, it may be cut short."""
    labels = F.split(host, r"\.")
    inner = F.split(path, "/")
    inner = F.when(F.size(inner) > 2, F.slice(inner, 2, F.size(inner) - 2)).otherwise(F.array().cast("array<string>"))
    return F.array_remove(F.array_distinct(F.concat(labels, inner)), "")


def quoted(text: Column) -> Column:
    return F.regexp_replace(text, r"([^A-Za-z0-9/_])", r"\\$1")


def rule_index(rules: DataFrame) -> DataFrame:
    """Each distinct rule under its rarest token: token, rule, pattern, action, width, host_width."""
    clean = rules.where("action in ('allow', 'block') and host is not null").select(
        "action", F.lower("host").alias("host"), F.coalesce("path", F.lit("")).alias("path")
    ).distinct()
    each = clean.select("*", F.explode(F.array_union(tokens(F.col("host"), F.col("path")), F.array(F.lit("")))).alias("token"))
    shared = each.groupBy("token").agg(F.count("*").alias("n"))
    # The empty token comes last whatever its count; a longer token comes before a shorter one.
    rank = F.struct(F.col("token") == "", F.col("n"), -F.length("token"), F.col("token"))
    best = each.join(shared, "token").groupBy("action", "host", "path").agg(F.min(rank).alias("best"))
    label = F.when(F.col("host") == "", F.lit(r"[^/?#]*")).otherwise(F.concat(F.lit(r"(?:[^/?#]*\.)?"), quoted(F.col("host"))))
    return best.select(
        F.col("best.token").alias("token"),
        F.concat("host", "path").alias("rule"),
        F.concat(F.lit("(?s)^"), label, F.when(F.substring("path", 1, 1) == "/", F.lit("")).otherwise(F.lit("(?=/|\\z)")), quoted(F.col("path"))).alias("pattern"),
        "action",
        F.length(F.concat("host", "path")).alias("width"),
        F.length("host").alias("host_width"),
    )


def judge(df: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", keys: tuple[str, ...] = (), salts: int = 16) -> DataFrame:
    """``keys`` of each row, then host, path, rule (null where none fits) and verdict."""
    index = rule_index(rules)
    pages = df.select(
        *[F.col(f"`{k}`").alias(f"key{i}") for i, k in enumerate(keys)],
        F.monotonically_increasing_id().alias("at"),
        host_of(F.col(url)).alias("host"),
        path_of(F.col(url)).alias("path"),
    )
    asked = pages.select("*", F.explode(F.array_union(tokens(F.col("host"), F.col("path")), F.array(F.lit("")))).alias("token"))
    if index.limit(MAX_BROADCAST_RULES + 1).count() <= MAX_BROADCAST_RULES:
        found = asked.join(F.broadcast(index), "token", "left")
    else:
        copies = index.select("*", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
        found = asked.withColumn("salt", F.pmod("at", F.lit(salts)).cast("int")).join(copies, ["token", "salt"], "left")
    fits = (F.col("host") != "") & F.rlike(F.concat("host", "path"), F.col("pattern"))
    best = F.max(F.when(fits, F.struct("width", "host_width", F.col("action") == "block", "rule", "action")))
    return (
        found.groupBy("at", *[f"key{i}" for i in range(len(keys))], "host", "path")
        .agg(best.alias("best"))
        .select(
            *[F.col(f"key{i}").alias(k) for i, k in enumerate(keys)],
            "host",
            "path",
            F.col("best.rule").alias("rule"),
            F.coalesce("best.action", F.lit(default)).alias("verdict"),
        )
    )
