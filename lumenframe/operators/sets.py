"""Bags, registries and graphs: differences, checks and closures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .folders import work_folder


def bag_difference(baseline: DataFrame, candidate: DataFrame, key: str) -> DataFrame:
    """key, delta of tokens whose count in candidate is not that in baseline."""
    a = baseline.groupBy(key).agg(F.count("*").alias("a"))
    b = candidate.groupBy(key).agg(F.count("*").alias("b"))
    delta = F.coalesce("b", F.lit(0)) - F.coalesce("a", F.lit(0))
    return a.join(b, key, "full").select(key, delta.alias("delta")).where("delta != 0")


def judged_difference(baseline: DataFrame, candidate: DataFrame, ledger: DataFrame, key: str) -> DataFrame:
    """The bag difference less growth that the ledger allows. Losses are never allowed."""
    diff = bag_difference(baseline, candidate, key)
    return diff.where("delta < 0").unionByName(diff.where("delta > 0").join(ledger.select(key).distinct(), key, "left_anti"))


def registry_difference(found: DataFrame, registry: DataFrame, key: str, roles: list[str]) -> DataFrame:
    """key, finding: unregistered, stale, count changed or illegal role. found: key, n; registry: key, n, role."""
    both = found.select(key, F.col("n").alias("n_found")).join(registry.select(key, F.col("n").alias("n_registered"), "role"), key, "full")
    finding = (
        F.when(F.col("n_registered").isNull(), "unregistered").when(F.col("n_found").isNull(), "stale").when(~F.col("role").isin(roles), "illegal role").when(F.col("n_found") != F.col("n_registered"), "count changed")
    )
    return both.select(key, finding.alias("finding")).where("finding IS NOT NULL")


def only_in_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """key, side: keys that one of two lists lacks."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("left only")).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("right only")))


def all_or_none(symbols: DataFrame, group: str, present: str, expected: str) -> DataFrame:
    """group, verdict: PASS if all symbols are present, ABSENT if none (a failure where expected), else PARTIAL."""
    g = symbols.groupBy(group).agg(F.bool_and(present).alias("every"), F.bool_or(present).alias("some"), F.bool_or(expected).alias("wanted"))
    return g.select(group, F.when(F.col("every"), "PASS").when(~F.col("some"), F.when(F.col("wanted"), "ABSENT FAIL").otherwise("ABSENT")).otherwise("PARTIAL FAIL").alias("verdict"))


def classify_names(names: DataFrame, key: str, allowed: list[str], prefixes: list[str], staged: DataFrame) -> DataFrame:
    """key, origin: ALLOWED by a list or a prefix (any case), STAGED if staged has it, else MISSING."""
    low = F.lower(key)
    listed: Column = low.isin([a.lower() for a in allowed])
    for p in prefixes:
        listed = listed | low.startswith(p.lower())
    held = staged.select(F.lower(key).alias("__low")).distinct().withColumn("__held", F.lit(True))
    joined = names.withColumn("__low", low).join(held, "__low", "left")
    return joined.select(key, F.when(listed, "ALLOWED").when(F.col("__held"), "STAGED").otherwise("MISSING").alias("origin"))


def reachable(edges: DataFrame, roots: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """root, node of all nodes that edges (src, dst) lead to from roots (root), roots included.

    Breadth first: each round joins the newest nodes only and is cut from its lineage, so plans stay small. Joins are merges: many rounds of
    broadcasts would pass through the driver.
    """
    work_folder(roots.sparkSession)
    seen = roots.select("root", F.col("root").alias("node")).distinct()
    newest = seen
    for _ in range(max_rounds):
        step = newest.join(edges.hint("merge"), newest["node"] == edges["src"]).select("root", F.col("dst").alias("node")).distinct()
        newest = step.join(seen.hint("merge"), ["root", "node"], "left_anti").checkpoint()
        if newest.isEmpty():
            break
        seen = seen.unionByName(newest).checkpoint()
    else:
        raise RuntimeError(f"nodes are still found after {max_rounds} rounds")
    return seen


def latest(rows: DataFrame, key: str, order: str, most: int) -> DataFrame:
    """The keys written last, most of them: what a cache keeps that forgets the oldest write."""
    last = rows.groupBy(key).agg(F.max(order).alias("last_write"))
    return last.orderBy(F.desc("last_write"), key).limit(most)


def first_maximum(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """key, best, at: for each key the largest value and the first place, by order, that has it."""
    top = F.max_by(F.struct(F.col(order).alias("o"), F.col(value).alias("v")), F.struct(F.col(value), -F.col(order)))
    return rows.groupBy(key).agg(top.alias("t")).select(key, F.col("t.v").alias("best"), F.col("t.o").alias("at"))


def version_key(version: Column) -> Column:
    """A dotted version as an array that sorts by numeric parts."""
    return F.transform(F.split(version, r"\."), lambda p: p.cast("int"))


def sequence_difference(golden: DataFrame, rendered: DataFrame, key: str, place: str, value: str) -> DataFrame:
    """key, same, only_golden, only_rendered of two ordered lists per key."""
    listed = lambda d, name: d.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(place, value))), lambda s: s[value]).alias(name))
    both = listed(golden, "g").join(listed(rendered, "r"), key, "full")
    g, r = F.coalesce("g", F.array().cast("array<string>")), F.coalesce("r", F.array().cast("array<string>"))
    return both.select(key, (g == r).alias("same"), F.size(F.array_except(g, r)).cast("long").alias("only_golden"), F.size(F.array_except(r, g)).cast("long").alias("only_rendered"))


def matching_lines(texts: DataFrame, key: str, text: str, pattern: str) -> DataFrame:
    """key, line_no (from 1), line of lines that match a pattern."""
    lines = texts.select(key, F.posexplode(F.split(text, "\n")).alias("at", "line"))
    return lines.where(F.col("line").rlike(pattern)).select(key, (F.col("at") + 1).cast("long").alias("line_no"), "line")


def running_state(rows: DataFrame, key: str, order: list[str], state: Column) -> DataFrame:
    """rows where state differs from the one before (transition events), the first of each key included."""
    w = Window.partitionBy(key).orderBy(*order)
    marked = rows.withColumn("state", state)
    return marked.withColumn("__before", F.lag("state").over(w)).where("__before IS NULL OR __before != state").drop("__before")
