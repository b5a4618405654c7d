"""Parent-child links to full hierarchies (nested sets).

Subtree sizes flow upward, sibling ranges are allocated by prefix sums downward, and the resulting nested-set range
``[place, place + size)`` of a node holds exactly the node and its descendants; roots, depths, ancestors and descendants are
read off the ranges. What no round can finish lies on or below a circle.

Upward, leaves are taken off a few times: each time one exchange adds them to their parents, and most nodes are gone after
the first. The inner nodes that are left double their pointers: after round k a node has gathered what lies within 2^k levels,
so a tree of depth d takes about log2(d) rounds. Downward, the inner nodes sum the gaps above them in the same way, and the
leaves taken off follow layer by layer, each row once. Nodes whose pointer has reached the top ask no more.

Rounds shuffle only 64-bit numbers, hashes of the ids that are checked for clashes, and end in a checkpoint. No window or
task ever holds all children of one parent, nor more than a block of the positions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Observation, Window as W, functions as F

from ..runtime import clean_id, cut, keep
from .prefix import prefix_sums

SEPARATOR = " > "
#: Parameters with their meanings.
BASE_BITS = 4  # range joins cover a range by blocks of 2^(BASE_BITS i) positions
LAYERS = 3  # times that leaves are taken off before pointers are doubled
BLOCK_BITS = 14  # positions, as a power of two, whose ranges one task sweeps


def parent_links(edges: DataFrame, edge_type: str = "CONTAINS") -> DataFrame:
    """(child, parent): distinct links of one type; ids and types lose outer white space, types are compared in upper case.

    Links with a null or blank end are left out. A child with several parents keeps the smallest one by code point.
    """
    typed = edges.where(F.upper(F.btrim("type", F.lit(" \t\r\n"))) == edge_type)
    ends = typed.select(clean_id("target_id").alias("child"), clean_id("source_id").alias("parent")).dropna()
    return ends.groupBy("child").agg(F.min("parent").alias("parent"))


def _numbered(links: DataFrame) -> DataFrame:
    """(n, p, child, parent): the links with numbers for both ids.

    The numbers are hashes; where two ids have the same, which a second hash tells, all sorted ids are counted instead.
    """
    keyed = keep(links.select(F.xxhash64("child").alias("n"), F.xxhash64("parent").alias("p"), "child", "parent"))
    both = keyed.select(F.explode(F.array(F.struct("n", F.hash("child").alias("h")), F.struct(F.col("p").alias("n"), F.hash("parent").alias("h")))).alias("x")).select("x.*")
    if both.groupBy("n").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a <> b").limit(1).count() == 0:
        return keyed
    ids = keyed.select(F.explode(F.array("child", "parent")).alias("id")).distinct()
    ids = cut(ids.sort("id").select(F.monotonically_increasing_id().alias("num"), "id"))
    return keep(keyed.select("child", "parent").join(ids.toDF("n", "child"), "child").join(ids.toDF("p", "parent"), "parent").select("n", "p", "child", "parent"))


def _none():
    return F.lit(None).cast("long")


def _take_off(numbers: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Layers (n, p, size) of leaves that were taken off, one after the other, and what is left: (n, p, size), where ``size``
    counts the node and all below it that are gone. A root has no p. One exchange a layer."""
    said = lambda df, k, p, size, kids: df.select(F.col(k).alias("n"), p.alias("p"), size.alias("size"), F.lit(kids).alias("kids"))
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    heard = said(numbers, "n", F.col("p"), one, 0).unionByName(said(numbers, "p", _none(), zero, 1))
    layers = []
    for i in range(LAYERS + 1):
        met = heard.groupBy("n").agg(F.max("p").alias("p"), F.sum("size").alias("size"), F.sum("kids").alias("kids"))
        if i == LAYERS:
            break
        met = cut(met)
        leaf = F.col("p").isNotNull() & (F.col("kids") == 0)
        layers.append(met.where(leaf).select("n", "p", "size"))
        stays = met.where(~leaf)
        heard = said(stays, "n", F.col("p"), F.col("size"), 0).unionByName(said(layers[-1], "p", _none(), F.col("size"), 0)).unionByName(said(stays.where("p is not null"), "p", _none(), zero, 1))
    # a root has not counted itself yet
    return layers, cut(met.select("n", "p", F.when(F.col("p").isNull(), F.col("size") + 1).otherwise(F.col("size")).alias("size")))


def _until_settled(state: DataFrame, step) -> DataFrame:
    """Apply ``step`` to (.., up) until no row has a pointer left, or as many as after the round before."""
    left, n = None, None
    while n is None or (n and n != left):
        seen = Observation()
        left, state = n, cut((state if n is None else step(state)).observe(seen, F.count("up").alias("n")))
        n = seen.get["n"]
    return state


def _sizes(inner: DataFrame) -> DataFrame:
    """(n, size, up): sizes of whole subtrees. ``up`` is null where it is settled, and stays on and below circles."""

    def step(t: DataFrame) -> DataFrame:
        asking = t.where("up is not null").repartition("up")  # one exchange for the question and the answer
        over = t.select(F.col("n").alias("up"), F.col("up").alias("up2"))
        moved = asking.join(over, "up").select("n", F.lit(0).cast("long").alias("size"), F.col("up2").alias("up"))
        given = asking.groupBy("up").agg(F.sum("size").alias("size")).select(F.col("up").alias("n"), "size", _none().alias("up"))
        return t.select("n", "size", _none().alias("up")).unionByName(moved).unionByName(given).groupBy("n").agg(F.sum("size").alias("size"), F.max("up").alias("up"))

    return _until_settled(inner.select("n", "size", F.col("p").alias("up")), step)


def _placed(inner: DataFrame, with_path: bool) -> DataFrame:
    """(n, place[, path]) of inner nodes (n, p, gap, name) by summing gaps up to the root, whose gap is its place."""
    path = ["path"] if with_path else []
    state = inner.select("n", F.col("p").alias("up"), F.col("gap").alias("place"), *([F.col("name").alias("path")] if with_path else []))

    def step(t: DataFrame) -> DataFrame:
        over = t.select(F.col("n").alias("up"), F.col("up").alias("up2"), F.col("place").alias("place2"), *[F.col(c).alias(f"{c}2") for c in path])
        asking = t.where("up is not null").join(over, "up")
        told = [F.concat_ws(SEPARATOR, "path2", "path").alias("path")] if with_path else []
        return asking.select("n", F.col("up2").alias("up"), (F.col("place") + F.col("place2")).alias("place"), *told).unionByName(t.where("up is null"))

    return _until_settled(state, step).drop("up")


def _circles(rest: DataFrame) -> DataFrame:
    """(n, least, on_circle): for nodes on or below a circle the smallest id on it. rest: (n, p, up, name), ``up`` being some
    node above."""
    far, size = rest.select("n", "up"), None
    while True:
        on = cut(far.select(F.col("up").alias("n")).distinct())
        count = on.count()
        if count == size:
            break
        over = far.select(F.col("n").alias("up"), F.col("up").alias("up2"))
        size, far = count, cut(far.join(over, "up").select("n", F.col("up2").alias("up")))
    ring = cut(rest.join(on, "n").select("n", F.col("p").alias("up"), F.col("name").alias("least")))
    while count:
        over = ring.select(F.col("n").alias("up"), F.col("up").alias("up2"), F.col("least").alias("l2"))
        ring = cut(ring.join(over, "up").select("n", F.col("up2").alias("up"), F.least("least", "l2").alias("least"), (F.col("l2") < F.col("least")).alias("moved")))
        if ring.where("moved").count() == 0:
            break
        ring = ring.drop("moved")
    found = far.join(ring.select(F.col("n").alias("up"), "least"), "up").select("n", "least")
    return cut(found.join(on.withColumn("on", F.lit(True)), "n", "left").select("n", "least", F.coalesce("on", F.lit(False)).alias("on_circle")))


def _read_off(nodes: DataFrame) -> DataFrame:
    """Rows (place, size, name, ..) with ``depth``, ``root_id`` and ``pre``, the place inside the tree, read off the ranges.

    Swept in the order of places, the ranges that are open where a node begins are those of its ancestors, and the last
    that began with none open is its root's. Ranges that end at one place are counted together, so that a block of
    ``2^BLOCK_BITS`` places holds at most twice as many rows; what a block hands on to the next is three numbers and a name.
    """
    block = F.shiftright("at", BLOCK_BITS).alias("block")
    columns = [c for c in nodes.columns if c != "place"]
    begin = nodes.withColumnRenamed("place", "at").select(block, "at", F.lit(1).alias("kind"), F.lit(1).cast("long").alias("delta"), *columns)
    end = nodes.groupBy((F.col("place") + F.col("size")).alias("at")).agg((-F.count(F.lit(1))).alias("delta")).select(block, "at", F.lit(0).alias("kind"), "delta")
    events = begin.unionByName(end, allowMissingColumns=True)
    root = lambda *c: F.when(F.col("p").isNull() & (F.col("kind") == 1), F.struct("at", "name"))
    sums = begin.unionByName(end, allowMissingColumns=True).groupBy("block").agg(F.sum("delta").alias("open"), F.max(root()).alias("last"))
    before = W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)  # one row a block of places
    sums = sums.select("block", F.coalesce(F.sum("open").over(before), F.lit(0)).alias("opened"), F.max("last").over(before).alias("led"))
    inside = W.partitionBy("block").orderBy("at", "kind")
    upto = inside.rowsBetween(W.unboundedPreceding, 0)
    swept = events.withColumn("open", F.sum("delta").over(upto) - F.col("delta")).withColumn("head", F.max(root()).over(upto)).where("kind = 1").join(sums, "block")
    head = F.coalesce("head", "led")
    return swept.select(F.col("at").alias("place"), *columns, (F.col("open") + F.col("opened")).cast("int").alias("depth"), head["name"].alias("root_id"), (F.col("at") - head["at"]).alias("pre"))


def hierarchy(links: DataFrame, with_path: bool = False) -> DataFrame:
    """Nested sets of (child, parent) links, one parent a child.

    Returns (node_id, parent_id, root_id, depth, place, pre, size, on_circle[, path]) with a row for every id, roots included
    (parent_id null, depth 0). ``size`` counts the node and its descendants; ``place`` numbers all nodes of all trees so that
    the descendants of x are the rows with place in (x.place, x.place + x.size), ``pre`` the same inside the tree. ``path``
    joins the ids from the root to the node by `` > ``. On and below a circle depth is -1, root_id the smallest id on the
    circle, and place, pre, size and path are null. A link from an id to itself is a circle of one. No links give no rows;
    repeated links count once.
    """
    keyed = _numbered(links.select("child", "parent").dropna().groupBy("child").agg(F.min("parent").alias("parent")))
    layers, inner = _take_off(keyed.select("n", "p"))
    sized = _sizes(inner)
    settled = sized.where("up is null").select("n", "size").join(inner.select("n", "p"), "n").select("n", "p", "size")
    names = keyed.select("n", F.col("child").alias("name"), "parent")
    tops = settled.where("p is null")
    tops = tops.join(keyed.select(F.col("p").alias("n"), F.col("parent").alias("name")).groupBy("n").agg(F.first("name").alias("name")), "n").withColumn("parent", F.lit(None).cast("string"))
    turning = inner.select("n", "p").join(sized.where("up is not null").select("n", "up"), "n").select("n", "p", F.lit(0).cast("long").alias("size"), "up")
    below = settled.where("p is not null").withColumn("layer", F.lit(LAYERS)).unionByName(turning.withColumn("layer", F.lit(-1)), allowMissingColumns=True)
    for i, layer in enumerate(layers):
        below = below.unionByName(layer.withColumn("layer", F.lit(i)), allowMissingColumns=True)
    # places of children inside their parent's range, and of trees side by side: prefix sums in blocks
    gaps = prefix_sums(below.withColumn("block", F.shiftright("n", 58)), ["p"], "block", ["n"], "size", "gap").withColumn("gap", F.col("gap") + 1)
    starts = prefix_sums(tops.withColumn("block", F.shiftright("n", 48)), [], "block", ["n"], "size", "gap")
    rows = keep(gaps.join(names, "n").unionByName(starts.withColumn("layer", F.lit(LAYERS)), allowMissingColumns=True).select("n", "p", "up", "size", "gap", "layer", "name", "parent"), "layer")
    path = ["path"] if with_path else []
    inner_rows = rows.where(F.col("layer") == LAYERS)
    done = _placed(inner_rows, with_path).join(inner_rows, "n").select("n", "p", "place", "size", "name", "parent", *path, F.lit(None).cast("string").alias("least"), F.lit(False).alias("on_circle"))
    round_ = _circles(rows.where("layer = -1")) if rows.where("layer = -1").limit(1).count() else None
    if round_ is not None:
        held = round_.join(rows.where("layer = -1"), "n").select("n", "p", _none().alias("place"), "size", "name", "parent", *[F.lit(None).cast("string").alias(c) for c in path], "least", "on_circle")
        done = done.unionByName(held)
    parts = [keep(done)]
    for i in reversed(range(LAYERS)):
        above = reduce(DataFrame.unionByName, parts).select(F.col("n").alias("p"), F.col("place").alias("place2"), *[F.col(c).alias(f"{c}2") for c in path], "least")
        told = [F.when(F.col("path2").isNotNull(), F.concat_ws(SEPARATOR, "path2", "name")).alias("path")] if with_path else []
        now = rows.where(F.col("layer") == i).join(above, "p").select("n", "p", (F.col("place2") + F.col("gap")).alias("place"), "size", "name", "parent", *told, "least", F.lit(False).alias("on_circle"))
        parts.append(keep(now) if i else now)
    done = keep(reduce(DataFrame.unionByName, parts))
    placed = _read_off(done.where("place is not null")).select(F.col("name").alias("node_id"), F.col("parent").alias("parent_id"), "root_id", "depth", "place", "pre", "size", "on_circle", *path)
    lost = done.where("place is null").select(F.col("name").alias("node_id"), F.col("parent").alias("parent_id"), F.col("least").alias("root_id"), F.lit(-1).alias("depth"), "place", _none().alias("pre"), _none().alias("size"), "on_circle", *path)
    return placed.unionByName(lost)


def _sized(starts, bits: int):
    return F.transform(starts, lambda start: F.struct(F.lit(bits).alias("bits"), F.shiftright(start, bits).alias("block")))


def descendants(tree: DataFrame, asked: DataFrame) -> DataFrame:
    """(node_id, descendant_id, distance): all descendants of the asked node_ids, found by nested-set range.

    Each range is covered by aligned blocks of 16^i places, at most 30 of a size, and every node belongs to one block of
    each size: an equi-join on (size of block, block) with no rows beyond the result. Ids on circles have none.
    """
    placed = tree.where("place is not null")
    node = placed.select("place", "depth", F.col("node_id").alias("descendant_id"))
    top = placed.join(asked.select("node_id").distinct(), "node_id", "left_semi")
    top = top.where("size > 1").select("node_id", F.col("depth").alias("d0"), (F.col("place") + 1).alias("lo"), (F.col("place") + F.col("size")).alias("hi"))
    most = placed.agg(F.max(F.col("place") + F.col("size"))).first()[0] or 1
    levels = list(range(0, max(most.bit_length(), 1), BASE_BITS))
    blocks = []
    for bits in levels:
        # at this size: what is left and right of the next size's aligned middle
        one, nxt = 1 << bits, 1 << (bits + BASE_BITS)
        lo = F.expr(f"((lo + {one - 1}) div {one}) * {one}")
        hi = F.expr(f"(hi div {one}) * {one}")
        nlo = F.expr(f"((lo + {nxt - 1}) div {nxt}) * {nxt}")
        nhi = F.expr(f"(hi div {nxt}) * {nxt}")
        inner = nlo < nhi
        left, right = F.when(inner, nlo).otherwise(hi), F.when(inner, nhi).otherwise(hi)
        seq = lambda a, b: F.when(a < b, F.sequence(a, b - 1, F.lit(one))).otherwise(F.array().cast("array<bigint>"))
        starts = F.concat(seq(lo, left), seq(right, hi))
        blocks.append(_sized(starts, bits))
    cover = top.select("node_id", "d0", F.explode(F.concat(*blocks)).alias("x")).select("node_id", "d0", "x.*")
    keys = F.explode(F.array(*[F.struct(F.lit(b).alias("bits"), F.shiftright("place", b).alias("block")) for b in levels]))
    member = node.select("descendant_id", "depth", keys.alias("x")).select("descendant_id", "depth", "x.*")
    return cover.join(member, ["bits", "block"]).select("node_id", "descendant_id", (F.col("depth") - F.col("d0")).alias("distance"))


def contained(edges: DataFrame, edge_type: str = "CONTAINS") -> DataFrame:
    """(node_id, root_id, depth) of every id that is the target of a link of ``edge_type``."""
    return hierarchy(parent_links(edges, edge_type)).where("parent_id is not null").select("node_id", "root_id", "depth")
