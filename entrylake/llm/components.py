"""Connected components by hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import stored

_MAX_ROUNDS = 60


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node that occurs in ``links`` (a long, b long); nodes of one component share a root.

    Each round draws a random order of the nodes, hooks each to the first node among itself and its
    neighbours, follows one more hook, and contracts the links. A random order shortens also long
    chains by a constant factor per round, and links between contracted nodes are kept once. All state is in
    narrow tables; the minimum over a hub's neighbours is taken before the shuffle, and joins on a hub
    have one row per node on the other side. Loops and repeated links are allowed; no links give no rows.
    """
    left = stored(links.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").distinct(), "links")
    hooks: list[DataFrame] = []
    while not left.isEmpty():
        if len(hooks) == _MAX_ROUNDS:
            raise RuntimeError("components do not converge")
        turn = F.lit(len(hooks))
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = (both.groupBy("a").agg(F.min(F.struct(F.xxhash64("b", turn).alias("p"), F.col("b").alias("n"))).alias("m"))
                 .select(F.col("a").alias("node"),
                         F.least("m", F.struct(F.xxhash64("a", turn).alias("p"), F.col("a").alias("n")))["n"].alias("up")))
        first = stored(first, "hooks")
        second = first.select(F.col("node").alias("up"), F.col("up").alias("top"))
        hook = stored(first.join(second, "up").select("node", F.col("top").alias("up")), "hooks")
        hooks.append(hook)
        left = stored(left.join(hook.select(F.col("node").alias("a"), F.col("up").alias("x")), "a")
                      .join(hook.select(F.col("node").alias("b"), F.col("up").alias("y")), "b")
                      .where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(),
                      "links")
    if not hooks:
        return links.select(F.col("a").cast("long").alias("node"), F.col("a").cast("long").alias("root")).limit(0)
    found = hooks[-1].select("node", F.col("up").alias("root"))
    for hook in reversed(hooks[:-1]):
        above = found.select(F.col("node").alias("up"), "root")
        found = hook.join(above, "up", "left").select("node", F.coalesce("root", "up").alias("root"))
    return found
