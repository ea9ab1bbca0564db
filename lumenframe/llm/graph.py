"""Connected components and link search as DataFrame operations.

Nothing here collects nodes or links to the driver, and no step emits all pairs of a bucket.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .line_blocks import bucket, place
from .storage import cut, discard, may_hold, membership, store


def dealt_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", condition: Column | None = None) -> DataFrame:
    """Join on key, with both sides dealt out for this join even where one is partitioned by key already.

    Only then can Spark split the partitions of a hot key while it runs. The extra key column leads to that.
    """
    left, right = left.withColumn("deal", F.hash(key)).alias("l"), right.withColumn("deal", F.hash(key)).alias("r")
    on = (F.col(f"l.{key}") == F.col(f"r.{key}")) & (F.col("l.deal") == F.col("r.deal"))
    return left.join(right, on if condition is None else on & condition, how)


def _are_stars(edges: DataFrame) -> bool:
    """Whether every u has one v only, and no v is a u."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up")))).alias("e"))
    nodes = ends.groupBy("e.node").agg(F.sum("e.up").alias("up"), F.count("*").alias("n"))
    return not nodes.agg(F.max((F.col("up") > 1) | ((F.col("up") == 1) & (F.col("n") > 1)))).first()[0]


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """u, v for every node u but the smallest v of its component, from links u, v (u != v).

    Alternating large-star and small-star steps: each node hands its larger, then its smaller neighbours to
    the smallest neighbour it knows, until only stars are left; the rounds grow with the logarithm of the size.
    Every round is written to the checkpoint folder.
    """
    edges = cut(links.select(F.least("u", "v").alias("v"), F.greatest("u", "v").alias("u")).where("u != v").distinct())
    for _ in range(max_rounds):
        if _are_stars(edges):
            break
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("m"))
        # only larger neighbours move, so each undirected edge is needed once: with its smaller end as u
        large = dealt_join(edges.select(F.col("v").alias("u"), F.col("u").alias("x")), least, "u").select(F.col("l.x").alias("u"), F.col("r.m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = dealt_join(large, low, "u").select(F.explode(F.array(F.struct("l.u", F.col("r.m").alias("v")), F.struct(F.col("l.v").alias("u"), F.col("r.m").alias("v")))).alias("e"))
        edges = cut(small.select("e.u", "e.v").where("u != v").distinct())
    else:
        raise RuntimeError(f"components are not complete after {max_rounds} rounds")
    return edges


def crowds(members: DataFrame) -> DataFrame:
    """The rows (bucket, node) of buckets with two or more nodes, dealt out by bucket once for both uses."""
    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = members.repartition(n, "bucket")
    sizes = dealt.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    return dealt.join(sizes, "bucket").select("bucket", "node", "size")


def shared_buckets(signed: DataFrame) -> DataFrame:
    """bucket, node, place, size of the buckets with two or more nodes, from rows node, keys (each node once; see line_blocks).

    Of buckets with the same nodes, known by their number, least, greatest and a hash of all, one is enough and stays. Buckets that
    no others share are counted away before any of their rows is dealt out, but for those that a bitmap of bounded size lets pass.
    """
    keys = signed.select("node", F.explode_outer("keys").alias("key")).where("key IS NOT NULL")
    rows = keys.select(bucket("key").alias("bucket"), "node", place("key").alias("place"))
    shared = store(rows.groupBy("bucket").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo != hi").select("bucket"))
    met = dealt_join(rows.where(may_hold(membership(shared, "bucket"), "bucket")), shared, "bucket", "left_semi")
    rows = store(met.groupBy("bucket", "node").agg(F.min("place").alias("place")))
    sets = rows.groupBy("bucket").agg(F.count("*").alias("size"), F.min("node").alias("lo"), F.max("node").alias("hi"), F.bit_xor(F.xxhash64("node")).alias("all"))
    one = sets.groupBy("size", "lo", "hi", "all").agg(F.min("bucket").alias("bucket"))
    crowd = store(dealt_join(rows, one, "bucket").select("l.bucket", "l.node", "l.place", "r.size"))
    discard(shared, rows)
    return crowd


def linked_components(
    crowd: DataFrame,
    attributes: DataFrame,
    near: Callable[[Callable[[str], Column], Callable[[str], Column]], Column],
    verify: Callable[[DataFrame], DataFrame],
    refine: Callable[[DataFrame], DataFrame] | None = None,
    exact: Callable[[Callable[[str], Column], Callable[[str], Column]], Column] | None = None,
    rounds: int = 2,
) -> DataFrame | None:
    """Components of the graph whose links are the pairs of nodes that share a bucket, are near and are verified.

    crowd: bucket, node, size, as crowds() gives them, and what near needs of a node in that bucket. attributes: one row per node,
    with node and what near needs of it.
    near(left, right) gets two functions from an attribute's name to the column and must hold for every true link.
    verify(pairs a, b) returns the linked pairs a, b. Returns u, v as components() does, None without any link.

    Emitting all pairs of a bucket would grow with the square of a group of near copies. Two nodes that are
    connected already need no check, so each of a few rounds compares every bucket with one centre, the node that
    shares the most bucket places with others (an unchanged original rather than one of its edited copies), and joins
    what is linked. Last, in every bucket that still holds several components, the nodes outside its largest component
    are compared with all nodes of other components: refine(rows bucket, node, part, attributes) may first leave out
    nodes that can have no link and add columns, and exact(left, right), on those columns, must hold for true links and
    runs inside the join, so that only pairs close to a link leave it. No pair of a bucket stays unchecked unless its
    nodes are connected, so no link is lost.
    """
    own = [c for c in crowd.columns if c not in ("bucket", "node", "size")]
    told = [c for c in attributes.columns if c != "node"]
    known = own + told
    fame = crowd.groupBy("node").agg(F.sum("size").alias("fame"))
    crowd = store(dealt_join(crowd, fame.join(attributes, "node"), "node").select("l.bucket", "l.node", "r.fame", *[f"l.{c}" for c in own], *[f"r.{c}" for c in told]))
    stars = None
    of_left = lambda c: F.col(f"l.{c}")

    def labelled() -> DataFrame:
        if stars is None:
            return crowd.withColumn("part", F.col("node"))
        roots = stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
        return dealt_join(crowd, roots, "node", "left").select("l.*", F.coalesce("r.root", "l.node").alias("part")).drop("deal")

    def test(pairs: DataFrame) -> DataFrame | None:
        pairs = cut(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        if pairs.isEmpty():
            return stars
        links = verify(pairs).select(F.col("a").alias("u"), F.col("b").alias("v"))
        return components(links if stars is None else links.unionByName(stars))

    for k in range(rounds):
        here = labelled()
        pick = F.struct(-F.col("fame") if k == 0 else F.xxhash64(F.lit(k), "node"), "node")
        centres = cut(
            here.groupBy("bucket")
            .agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.min_by(F.struct("node", "part", *known), pick).alias("c"))
            .where("lo != hi")
            .select("bucket", "c")
        )
        pairs = dealt_join(here, centres, "bucket", condition=(F.col("l.part") != F.col("r.c.part")) & near(of_left, lambda c: F.col(f"r.c.{c}")))
        stars = test(pairs.select(F.col("l.node").alias("a"), F.col("r.c.node").alias("b")))
    here = store(labelled().drop("fame"))
    discard(crowd)
    parts = here.groupBy("bucket", "part").agg(F.count("*").alias("n_part")).groupBy("bucket").agg(F.max_by("part", F.struct("n_part", "part")).alias("main"), F.count("*").alias("parts")).where("parts > 1")
    several = dealt_join(here, parts, "bucket").select("l.bucket", "l.node", "l.part", *[f"l.{c}" for c in known], "r.main")
    several = store(refine(several) if refine else several)
    discard(here)
    once = (F.col("r.part") == F.col("r.main")) | (F.col("l.node") < F.col("r.node"))  # else both ends meet the other
    holds = (F.col("l.part") != F.col("r.part")) & once & near(of_left, lambda c: F.col(f"r.{c}"))
    if exact:
        holds = holds & exact(of_left, lambda c: F.col(f"r.{c}"))
    pairs = dealt_join(several.where("part != main"), several, "bucket", condition=holds)
    stars = test(pairs.select(F.col("l.node").alias("a"), F.col("r.node").alias("b")))
    discard(several)
    return stars
