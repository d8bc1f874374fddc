"""URL filter by host-suffix and path-prefix rules, joined over hashes of expressions.

Each URL is expanded into the expressions that could be a rule: every suffix of its host at a dot,
each with every prefix of its path at a slash. Rules have the same form, so that an equi-join over
the first bytes of the expression's digest finds the candidates; the whole digest and the rule's
own path then confirm them, and the longest rule decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara.llm.shared import lower_ascii, without
from opinara.workspace import stored

#: Hexadecimal digits of the digest that the join compares; the rest is compared afterwards.
SHORT = 8


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path as written, the host with A-Z lower-cased; both empty for null and without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    return lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _depth(path: Column) -> Column:
    return F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))


def _labels(host: Column) -> Column:
    return F.size(F.split(host, r"\."))


def _digest(host: Column, anchor: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), anchor), 256)


def expressions(host: Column, path: Column, most_labels: int, most_depth: int) -> Column:
    """Digests of all pairs of a host suffix and a path prefix, no longer than the longest rule."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.least(F.size(labels), F.lit(most_labels))),
        lambda k: F.array_join(F.slice(labels, F.size(labels) - k + 1, k), "."),
    )
    prefixes = F.transform(
        F.sequence(F.lit(0), F.least(_depth(path), F.lit(most_depth))),
        lambda k: F.when(k == 0, F.lit("")).otherwise(F.concat(F.call_function("substring_index", path, F.lit("/"), k), F.lit("/"))),
    )
    return F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: _digest(s, p))))


def rule_expressions(rules: DataFrame) -> DataFrame:
    """Rules (host, path, verdict) with the digest of their expression: the path up to its last slash."""
    host, path = lower_ascii(F.col("host")), F.coalesce(F.col("path"), F.lit(""))
    anchor = F.regexp_extract(path, r"(?s)^(.*/)?", 0)
    return rules.where(F.col("host").isNotNull() & F.col("verdict").isNotNull()).select(
        _digest(host, anchor).alias("rule_digest"),
        host.alias("rule_host"),
        path.alias("rule_path"),
        F.col("verdict").alias("rule_verdict"),
        _labels(host).alias("labels"),
        _depth(path).alias("depth"),
    )


def judge_urls(df: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """Adds ``host``, ``path``, ``rule`` and ``verdict``; columns of these names in ``df`` are replaced.

    A rule fits its host and all subdomains, where the path starts with the rule's path. Of several
    the longest text of host and path wins, then the longer host, then ``block``. Where no rule fits,
    the rule is null and the verdict ``default``. Null urls and urls without ``://`` have an empty host and path
    and fit no rule with a host. Repeated rows each get their verdict; empty tables give none. Rules
    with a null host or verdict are left out; a null path means every path.

    Rows are joined with rules only over distinct pairs of host and path, so a url that many rows
    share is matched once for all of a task's rows. Only the largest number of labels and of path
    parts among the rules comes to the driver.
    """
    host, path = host_and_path(F.col(f"`{url}`"))
    pages = df.select("*", host.alias("__host"), path.alias("__path"))
    known = rule_expressions(rules)
    most = known.agg(F.max("labels").alias("labels"), F.max("depth").alias("depth")).first()
    targets = pages.select("__host", "__path").distinct()
    expanded = targets.select(
        "__host", "__path", F.explode(expressions(F.col("__host"), F.col("__path"), most.labels or 1, most.depth or 0)).alias("__digest")
    )
    fits = expanded.join(
        known, (F.substring("__digest", 1, SHORT) == F.substring("rule_digest", 1, SHORT)), "inner"
    ).where((F.col("__digest") == F.col("rule_digest")) & F.startswith(F.col("__path"), F.col("rule_path")))
    order = F.struct(
        F.length("rule_host") + F.length("rule_path"),
        F.length("rule_host"),
        F.col("rule_verdict") == "block",
        F.concat("rule_host", "rule_path").alias("rule"),
        F.col("rule_verdict").alias("verdict"),
    )
    best = fits.groupBy("__host", "__path").agg(F.max(order).alias("best"))
    # Written out, so that the join below reads both sides through its own exchange and can split a url that many rows
    # share; merged, since these rows grow with the pages.
    best = stored(best.select(F.col("__host").alias("__h"), F.col("__path").alias("__p"), "best.rule", "best.verdict"), "url-verdicts").hint("merge")
    judged = without(pages, "host", "path", "rule", "verdict").join(best, (F.col("__host") == F.col("__h")) & (F.col("__path") == F.col("__p")), "left")
    return judged.select(
        *[F.col(f"`{c}`") for c in without(df, "host", "path", "rule", "verdict").columns],
        F.col("__host").alias("host"),
        F.col("__path").alias("path"),
        "rule",
        F.coalesce("verdict", F.lit(default)).alias("verdict"),
    )
