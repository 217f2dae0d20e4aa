"""URL rules by a sort-merge range join over reversed-host keys; DataFrame functions only.

A host is keyed by its labels from the last to the first, each closed by a mark, so that a
host and all its subdomains are one interval of keys: those that begin with the host's key.
Paths that begin with a rule's path are an interval too. Intervals of one kind are nested or
apart. A sweep sorts rules and urls into one order by key; a rule opens its interval and
carries the stack of rules that enclose it, itself on top. A url takes the stack of the
last rule before it and pops what is closed by then, that is, what its key doesn't begin
with. What stays are exactly the rules whose interval holds the url.

The first sweep goes over host keys and finds the rule hosts that a url's host lies under
(one for each of its labels at most); the second goes over (rule host, path) and finds the
innermost rule of each. The longest rule wins.

The order is dealt out by ranges over (key, row), so that one host with a third of all urls
lies over many tasks; each task starts with the stack that the tasks before it left open,
from a table of one row a task.

Defined cases: a null url, or one without "://", has an empty host and path, which only a
rule of an empty host fits; hosts are compared as they stand after A-Z became a-z (a port or
a closing dot is part of the host); of rules of equal length the one with the longer host
wins; of equal rules with different verdicts "block" wins; rules with a null host or
path are left out; no rules leave every url to the default verdict; repeated pages are judged
each; an empty table gives an empty result; columns other than id and url are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gavelflow.llm.scratch import Scratch

CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
LABEL_END, HOST_END, ESCAPE = "\x01", "\x00", "\x02"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), CAPITALS, SMALL)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def host_key(host: Column) -> Column:
    """Labels from the last to the first, each closed by LABEL_END; marks in the host itself are escaped."""
    plain = host
    for mark, code in ((ESCAPE, "2"), (LABEL_END, "1"), (HOST_END, "0")):
        plain = F.replace(plain, F.lit(mark), F.lit(ESCAPE + code))
    return F.concat(F.array_join(F.reverse(F.split(plain, r"\.", -1)), LABEL_END), F.lit(LABEL_END))


def with_stacks(rules: DataFrame) -> DataFrame:
    """x_key and x_stack: the keys that x_key begins with, itself last. rules: x_key, x_cuts
    (lengths at which an enclosing key could end)."""
    cut = rules.select("x_key", F.explode("x_cuts").alias("x_cut")).filter("x_cut < length(x_key)")
    outer = rules.select(F.col("x_key").alias("x_outer"))
    enclosing = cut.select("x_key", F.expr("left(x_key, x_cut)").alias("x_outer")).join(outer, "x_outer").groupBy("x_key").agg(F.array_sort(F.collect_set("x_outer")).alias("x_outers"))
    alone = F.array().cast("array<string>")
    return rules.select("x_key").join(enclosing, "x_key", "left").select("x_key", F.concat(F.coalesce("x_outers", alone), F.array("x_key")).alias("x_stack"))


def sweep(points: DataFrame, rules: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """points (x_key, x_row, x_point) and x_active: the keys of all rules whose interval holds x_key, outermost first."""
    kind = points.schema["x_point"].dataType
    starts = rules.select("x_key", F.lit(0).alias("x_kind"), F.lit(0).cast("long").alias("x_row"), "x_stack", F.lit(None).cast(kind).alias("x_point"))
    asked = points.select("x_key", F.lit(1).alias("x_kind"), "x_row", F.lit(None).cast("array<string>").alias("x_stack"), "x_point")
    dealt = starts.unionByName(asked).repartitionByRange("x_key", "x_kind", "x_row").withColumn("x_part", F.spark_partition_id())
    dealt = scratch.save(dealt, name)
    left = dealt.groupBy("x_part").agg(F.max_by("x_stack", F.when(F.col("x_kind") == 0, F.col("x_key"))).alias("x_left"))
    earlier = Window.orderBy("x_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = left.select("x_part", F.last("x_left", ignorenulls=True).over(earlier).alias("x_carried"))  # one row a task
    order = Window.partitionBy("x_part").orderBy("x_key", "x_kind", "x_row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = dealt.withColumn("x_opened", F.last("x_stack", ignorenulls=True).over(order)).filter("x_kind = 1").join(F.broadcast(carried), "x_part")
    stack = F.coalesce("x_opened", "x_carried", F.array().cast("array<string>"))
    return swept.select("x_row", "x_point", F.filter(stack, lambda k: F.col("x_key").startswith(k)).alias("x_active"))


def judge(pages: DataFrame, rules: DataFrame, *, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict: a row for each row of pages. rules: host, path, verdict."""
    scratch = Scratch(pages.sparkSession, "url-rules")
    known = rules.select(F.translate("host", CAPITALS, SMALL).alias("host"), "path", "verdict").filter("host IS NOT NULL AND path IS NOT NULL")
    known = known.groupBy("host", "path").agg(F.when(F.max(F.col("verdict") == "block"), F.lit("block")).otherwise(F.max("verdict")).alias("verdict"))
    known = scratch.save(known.withColumn("x_host", host_key(F.col("host"))), "rules")

    hosts = known.select(F.col("x_host").alias("x_key")).distinct()
    labels = F.split("x_key", LABEL_END, -1)  # and an empty string after the last mark
    cuts = F.transform(F.sequence(F.lit(1), F.size(labels) - 1), lambda i: F.aggregate(F.slice(labels, 1, i), F.lit(0), lambda a, label: a + F.length(label) + 1))
    host_rules = with_stacks(hosts.select("x_key", cuts.alias("x_cuts")))

    lengths = known.groupBy("x_host").agg(F.collect_set(F.length("x_host") + 1 + F.length("path")).alias("x_cuts"))
    full_key = lambda host, path: F.concat(host, F.lit(HOST_END), path)
    path_rules = with_stacks(known.join(lengths, "x_host").select(full_key("x_host", "path").alias("x_key"), "x_cuts"))

    id_ = F.col(f"`{id_col}`")
    urls = pages.select(id_.alias("page_id"), host_of(F.col(f"`{url_col}`")).alias("host"), path_of(F.col(f"`{url_col}`")).alias("path"))
    urls = urls.select(F.monotonically_increasing_id().alias("x_row"), F.struct("page_id", "host", "path").alias("x_point"))
    under = sweep(urls.withColumn("x_key", host_key(F.col("x_point.host"))), host_rules, scratch, "by-host")
    under = scratch.save(under, "under")

    asked = under.select("x_row", F.explode("x_active").alias("x_host"), F.col("x_point.path").alias("x_path"))
    asked = asked.select(full_key("x_host", "x_path").alias("x_key"), "x_row", F.struct("x_host").alias("x_point"))
    inner = sweep(asked, path_rules, scratch, "by-path").filter("size(x_active) > 0")
    size = F.length("host") + F.length("path")
    fits = known.select(full_key("x_host", "path").alias("x_fit"), F.struct(size.alias("size"), F.length("host").alias("host_size"), F.concat("host", "path").alias("rule"), "verdict").alias("x_rule"))
    inner = inner.select("x_row", F.get("x_active", F.size("x_active") - 1).alias("x_fit")).join(fits, "x_fit")
    best = inner.groupBy("x_row").agg(F.max("x_rule").alias("x_rule"))
    return under.join(best, "x_row", "left").select("x_point.*", F.col("x_rule.rule").alias("rule"), F.coalesce("x_rule.verdict", F.lit(default)).alias("verdict"))


#: The rules of the query: host, path, verdict.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def rule_table(spark, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    each = [F.struct(F.lit(host).alias("host"), F.lit(path).alias("path"), F.lit(verdict).alias("verdict")) for host, path, verdict in rules]
    return spark.range(1).select(F.inline(F.array(*each)))
