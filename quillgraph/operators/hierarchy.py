"""Parent-child rows to whole hierarchies: depth, root, path, nested-set ranges, cycles."""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from quillgraph.operators.prefix import prefix_sums
from quillgraph.session import drop, materialize, materialize_counted

#: Rows fewer than this are joined plainly: even all of them at one key are a small task.
FEW = 1_000_000
#: A key with more than this share of the rows is hot: its row of the other side is sent to all tasks (at most 1/HOT such rows).
HOT = 1 / 200


def one_parent(df: DataFrame, key: str, parent: str, extra: dict[str, str] | None = None) -> DataFrame:
    """(node, parent, ...): one row per key. Of several rows of a key the least parent (null last) and the least of each extra column counts."""
    cols = [F.col(key).alias("node"), F.col(parent).alias("parent")] + [F.col(v).alias(k) for k, v in (extra or {}).items()]
    return df.select(*cols).where(F.col("node").isNotNull()).groupBy("node").agg(F.min("parent").alias("parent"), *[F.min(k).alias(k) for k in extra or {}])


def links(df: DataFrame, key: str, parent: str, extra: dict[str, str] | None = None) -> DataFrame:
    """(node, parent, linked) of the nodes; ``parent`` is null for tops and where the parent isn't listed.

    Rows without a key are no nodes. Of several rows of a key the one with the least parent (null last) counts; of
    ``extra`` columns (new name: column) the least value. ``linked`` tells a missing parent (false) from none (null).
    """
    one = materialize(one_parent(df, key, parent, extra))
    listed = one.select(F.col("node").alias("parent"), F.lit(True).alias("listed"))
    out = lookup(one, listed, "parent")
    return out.withColumn("linked", F.when(F.col("parent").isNotNull(), F.col("listed").isNotNull())).withColumn(
        "parent", F.when(F.col("listed"), F.col("parent"))
    ).drop("listed")


def hot_keys(df: DataFrame, key: str, hot: float = HOT) -> list:
    """The keys that hold at least ``hot`` of the rows (so at most 1/hot of them), by one aggregation; none of a small input."""
    seen = Observation()
    counts = df.where(F.col(key).isNotNull()).groupBy(key).count().observe(seen, F.sum("count").alias("n"))
    most = counts.orderBy(F.col("count").desc()).limit(int(1 / hot)).collect()
    n = seen.get["n"] or 0
    return [r[0] for r in most if n >= FEW and r[1] >= n * hot]


def lookup(left: DataFrame, right: DataFrame, key: str, n: int | None = None, hot: float = HOT) -> DataFrame:
    """Left join on ``key``, which is unique on the right, though few keys may hold most rows of the left.

    The rows of hot keys meet the rows of the right for these keys (at most 1/hot), which are broadcast; rows without a key meet none; only
    all others are joined by a shuffle. ``n`` is the number of rows of the left, if it is known: few are joined plainly. Otherwise the left
    is read once to count its keys, and once for each part, so it should be a table or a scan with little work.
    """
    cols = [c for c in right.columns if c != key]
    plain = lambda rows, other: rows.join(other, key, "left").select(*left.columns, *cols)
    keys = hot_keys(left, key, hot) if n is None or n >= FEW else []
    if not keys and n is not None and n < FEW:
        return plain(left, right)
    none = left.where(F.col(key).isNull()).select("*", *[F.lit(None).cast(right.schema[c].dataType).alias(c) for c in cols])
    some = left.where(F.col(key).isNotNull())
    if not keys:
        return plain(some, right).unionByName(none)
    is_hot = F.col(key).isin(keys)
    return plain(some.where(is_hot), F.broadcast(right.where(is_hot))).unionByName(plain(some.where(~is_hot), right)).unionByName(none)


@dataclass
class Jumps:
    """What the upward rounds give: the pointers of each round with their number, sizes and heights, and what is never finished."""

    rounds: list[tuple[DataFrame, int]]
    sizes: DataFrame  #: (node, size, height) of the nodes with descendants
    stuck: DataFrame  #: (node, anc) of the nodes on cycles and below them
    on_cycle: DataFrame


def climb(tree: DataFrame) -> Jumps:
    """Subtree sizes and heights of nodes (node, parent) upward, 2^k levels in round k.

    Before round k, ``anc`` of a node is its ancestor 2^k levels up, and its size counts the descendants less than 2^k levels
    down: those 2^k to 2^(k+1)-1 levels down are the ones counted at the nodes whose ``anc`` it is. A node without an ancestor so far
    up is finished and leaves the rounds; what it still gains is summed up in the end. So trees of depth d take log2(d) rounds rather
    than d, and each handles only the nodes that are at least so deep. A node that is deeper than another round reaches
    has ancestors that this round does finish; so when a round finishes none, what is left is never processed: it is on
    cycles or below them.
    """
    one = lambda x: F.lit(x).cast("long")
    now, n = materialize_counted(tree.where(F.col("parent").isNotNull()).select("node", F.col("parent").alias("anc"), one(1).alias("size"), one(0).alias("height")), F.lit(True))
    rounds: list[tuple[DataFrame, int]] = []
    gains, step, before = [], 1, None
    while n not in (0, before):
        before = n
        rounds.append((now, n))
        gain = now.groupBy(F.col("anc").alias("node")).agg(F.sum("size").alias("add"), (F.max("height") + step).alias("below"))
        gains.append(now.select(F.col("anc").alias("node"), "size", (F.col("height") + step).alias("height")))
        grown = now.join(gain, "node", "left").select(
            "node", "anc", (F.col("size") + F.coalesce("add", F.lit(0))).alias("size"), F.greatest("height", F.coalesce("below", F.lit(0))).alias("height")
        )
        far = now.select(F.col("node").alias("anc"), F.col("anc").alias("anc2"))
        if n < FEW:
            moved = grown.join(far, "anc")
        else:
            moved = lookup(materialize(grown), far, "anc", n).where(F.col("anc2").isNotNull())
        now, n = materialize_counted(moved.select("node", F.col("anc2").alias("anc"), "size", "height"), F.lit(True))
        step *= 2
    total = functools.reduce(DataFrame.unionByName, gains) if gains else now.select("node", "size", "height")
    sizes = total.groupBy("node").agg((F.sum("size") + 1).alias("size"), F.max("height").alias("height"))
    return Jumps([(r.select("node", "anc"), k) for r, k in rounds], sizes, now.select("node", "anc"), _on_cycles(now.select("node", "anc"), n))


def _on_cycles(stuck: DataFrame, n: int) -> DataFrame:
    """(node) on cycles, of ``n`` nodes with an ancestor each that are all on or below cycles.

    Going up moves a set of such nodes towards the cycles. When it no longer shrinks, it goes round on them.
    """
    at, before = stuck.select("node"), None
    while n not in (0, before):
        before = n
        at, n = materialize_counted(stuck.join(at, "node", "left_semi").select(F.col("anc").alias("node")).distinct(), F.lit(True))
    return at


def _rings(cycle: DataFrame) -> DataFrame:
    """(node, ring) of the nodes (node, parent) on cycles: the least node of the same cycle, looked for 2^k steps around in round k."""
    now = cycle.select("node", F.col("parent").alias("anc"), F.col("node").alias("ring"))
    while True:
        far = now.select(F.col("node").alias("anc"), F.col("anc").alias("anc2"), F.col("ring").alias("ring2"))
        moved = now.join(far, "anc").select("node", F.col("anc2").alias("anc"), F.least("ring", "ring2").alias("ring"), (F.col("ring2") < F.col("ring")).alias("moved"))
        now, n = materialize_counted(moved, F.col("moved"))
        now = now.drop("moved")
        if n == 0:
            return now.select("node", "ring")


def _offsets(nodes: DataFrame, rounds: list[tuple[DataFrame, int]], with_path: bool, separator: str, deepest_first: bool, first: DataFrame | None = None) -> DataFrame:
    """(node, offset, depth, root, path) of the nodes (node, parent, size, height) of whole trees, with the pointers of :func:`climb`."""
    siblings = [F.col("height").desc(), F.col("node")] if deepest_first else [F.col("node")]
    rows = nodes.select("node", "parent", "size", "height")
    if first is not None:
        rows = rows.join(first.groupBy("node").agg(F.min("position").alias("position")), "node", "left")
        siblings = [F.col("position").asc_nulls_last(), *siblings]
    laid = prefix_sums(rows, "parent", siblings, "size", "before")
    now = materialize(laid.select(
        "node", (F.col("before") + 1).alias("offset"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("depth"), F.coalesce("parent", "node").alias("root"),
        *([F.col("node").cast("string").alias("path")] if with_path else []),
    ))
    cols = [c for c in now.columns if c != "node"]
    for pointers, n in rounds:
        far = now.select(F.col("node").alias("anc"), *[F.col(c).alias(f"{c}2") for c in cols])
        more = lookup(pointers, far, "anc", n).drop("anc").where(F.col("offset2").isNotNull())
        step = {"offset": F.col("offset") + F.coalesce("offset2", F.lit(0)), "depth": F.col("depth") + F.coalesce("depth2", F.lit(0)), "root": F.coalesce("root2", "root")}
        if with_path:
            step["path"] = F.when(F.col("path2").isNull(), F.col("path")).otherwise(F.concat_ws(separator, "path2", "path"))
        old, now = now, materialize(now.join(more, "node", "left").select("node", *[step[c].alias(c) for c in cols]))
        drop(old)
    return now


def _sized(tree: DataFrame, jumps: Jumps) -> DataFrame:
    """The nodes with their size and height; those without descendants have 1 and 0."""
    out = tree.join(jumps.sizes, "node", "left")
    return out.withColumns({"size": F.coalesce("size", F.lit(1)).cast("long"), "height": F.coalesce("height", F.lit(0)).cast("long")})


def _hanging(stuck: DataFrame, first: int, deepest_first: bool) -> DataFrame:
    """(node, offset, size, height, others) of the nodes (node, parent, cycle) on and below cycles; offsets come after ``first``.

    Each cycle is taken as one node, so that what hangs below it is a tree. The nodes of a cycle share its offset and
    size; ``others`` is how many more of them there are (null below a cycle), and they have no height.
    """
    ring = materialize(_rings(stuck.where(F.col("cycle")).select("node", "parent")))
    tops = ring.select(F.col("ring").alias("node"), F.lit(None).cast(stuck.schema["parent"].dataType).alias("parent")).distinct()
    up = lookup(stuck.where(F.col("cycle").isNull()).select("node", "parent"), ring.select(F.col("node").alias("parent"), "ring"), "parent")
    forest = materialize(tops.unionByName(up.select("node", F.coalesce("ring", "parent").alias("parent"))))
    jumps = climb(forest)
    sized = materialize(_sized(forest, jumps))
    laid = _offsets(sized, jumps.rounds, False, "", deepest_first)
    at = materialize(sized.join(laid, "node").select("node", (F.col("offset") + first).alias("offset"), "size", "height"))
    count = ring.groupBy("ring").agg((F.count("*") - 1).alias("others"))
    on = at.withColumnRenamed("node", "ring").join(count, "ring").join(ring, "ring").select("node", "offset", "size", F.lit(None).cast("long").alias("height"), "others")
    return on.unionByName(at.join(ring, "node", "left_anti").withColumn("others", F.lit(None).cast("long")))


def hierarchy(
    df: DataFrame, key: str, parent: str, *, recorded: str | None = None, with_path: bool = True, separator: str = "/", deepest_first: bool = False,
    below_cycles: bool = False, first: DataFrame | None = None,
) -> DataFrame:
    """For each node: (node_key, parent_key, root_key, depth, height, n_descendants, range_start, range_end, path, status).

    Nested sets: another node b is a descendant of a iff a.range_start <= b.range_start < a.range_end. ``depth`` is 0 at a top,
    ``height`` that of the subtree; ``path`` joins the keys from the root to the node. ``status`` is ``top``, ``orphan``
    (its parent isn't listed, so it is a root too), ``node``, ``cycle`` (its own ancestor), or ``below_cycle``; the last two have
    null for all but the keys. With ``recorded`` (a column with a stated height) ``height_matches`` is added: null if it
    isn't recorded or there is no height.

    With ``below_cycles`` the last two have what is defined for them too: null are only their root, depth and path, and
    the height of nodes on cycles. The nodes of a cycle share one range, and each has all others of it and all that
    hangs below any of them as descendants, but not itself.

    Upward rounds give the sizes, prefix sums over siblings give each node its offset from its parent, and downward
    rounds add the offsets (and paths) of 2^k ancestors in round k. All rounds are joins on unique keys.

    Siblings are laid out by their keys, with ``deepest_first`` the highest subtree first; ``first`` (node, position) puts those it has before all others.

    Null keys are no nodes; repeated rows count once (least parent, least recorded height); an empty table gives none.
    Clashing columns aren't read.
    """
    tree = materialize(links(df, key, parent, {"recorded": recorded} if recorded else None))
    jumps = climb(tree.select("node", "parent"))
    on_cycle = jumps.on_cycle.withColumn("cycle", F.lit(True))
    stuck = jumps.stuck.select("node", F.lit(True).alias("stuck"))
    base = _sized(tree, jumps).join(stuck, "node", "left").join(on_cycle, "node", "left")
    base = materialize(base.withColumn("stuck", F.coalesce("stuck", F.lit(False))))
    sound = base.where(~F.col("stuck"))
    out = base.join(_offsets(sound, jumps.rounds, with_path, separator, deepest_first, first), "node", "left")
    ok = ~F.col("stuck")
    size, height, others = F.when(ok, F.col("size")), F.when(ok, F.col("height")), F.lit(0)
    if below_cycles and not jumps.on_cycle.isEmpty():
        more = _hanging(base.where(F.col("stuck")).select("node", "parent", "cycle"), sound.count(), deepest_first)
        out = out.join(more.select("node", *[F.col(c).alias(f"{c}2") for c in ("offset", "size", "height", "others")]), "node", "left")
        out = out.withColumn("offset", F.coalesce("offset", "offset2"))
        size, height, others = F.coalesce(size, "size2"), F.coalesce(height, "height2"), F.coalesce("others2", F.lit(0))
    status = (
        F.when(F.col("cycle"), "cycle").when(F.col("stuck"), "below_cycle").when(F.col("parent").isNotNull(), "node").when(F.col("linked").isNull(), "top").otherwise("orphan")
    )
    return out.select(
        F.col("node").alias("node_key"),
        F.col("parent").alias("parent_key"),
        F.when(ok, F.col("root")).alias("root_key"),
        F.when(ok, F.col("depth")).alias("depth"),
        height.alias("height"),
        (size - 1 + others).alias("n_descendants"),
        F.col("offset").alias("range_start"),
        (F.col("offset") + size).alias("range_end"),
        *([F.col("path")] if with_path else []),
        status.alias("status"),
        *([(height == F.col("recorded")).alias("height_matches")] if recorded else []),
    )


def cycle_nodes(df: DataFrame, key: str, parent: str) -> DataFrame:
    """(node_key) of the nodes that are their own ancestor: what the upward rounds leave unprocessed."""
    return climb(one_parent(df, key, parent)).on_cycle.withColumnRenamed("node", "node_key")


def descendants(tree: DataFrame, of: DataFrame, blocks: int = 4096) -> DataFrame:
    """(ancestor_key, node_key) of all descendants of the nodes ``of`` (node_key), by ranges of :func:`hierarchy`.

    With ranges of ``below_cycles`` those on and below cycles are among them; no node is its own. Ranges are cut at multiples of ``blocks``, so the join is one on (block) keys and not of all pairs.
    """
    who = of.select("node_key").distinct().join(tree.select("node_key", "range_start", "range_end").where(F.col("n_descendants") > 0), "node_key")
    cut = F.explode(F.sequence(F.floor(F.col("range_start") / blocks), F.floor((F.col("range_end") - 1) / blocks)))
    spans = who.select(F.col("node_key").alias("ancestor_key"), F.col("range_start").alias("a"), F.col("range_end").alias("z"), cut.alias("block"))
    points = tree.where(F.col("range_start").isNotNull()).select("node_key", F.col("range_start").alias("at"), F.floor(F.col("range_start") / blocks).alias("block"))
    return points.join(spans, "block").where((F.col("at") >= F.col("a")) & (F.col("at") < F.col("z")) & (F.col("node_key") != F.col("ancestor_key"))).select("ancestor_key", "node_key")
