"""Most similar vectors by cosine: a forest of random-projection trees searched through one priority queue.

The forest is fitted on a bounded sample and every vector is indexed by it. A query walks all trees at once: one queue,
ordered by the widest margin missed on the way, hands out leaves of any tree until ``look`` leaves are found, and the exact
cosine ranks what lies in them. Up to ``BLOCK`` queries, a checked number, go to all tasks, which read the vectors once; only
queries and partial best lists move. More queries meet the vectors by leaf: both sides are keyed by (tree, group of leaves),
large groups are salted, and a task holds one group of vectors at a time while the queries pass. Nothing of size reaches
the driver, and what is shuffled grows in proportion to vectors and queries.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from ..operators.graph import usable_vector
from ..runtime import clean_id, keep as stored

#: Parameters with their meanings.
WIDTH = 64  # numbers in a usable vector
TREES = 4
LEAF = 128  # vectors that a leaf should have
DEEPEST = 14  # levels of a tree at most; beyond 2^14 leaves they grow with the table
SOME, ROUNDS = 512, 6  # points that choose a plane, and rounds in which they do
SAMPLE = 65_536  # vectors that the trees are fitted on, at most
LOOK = 128  # leaves that a query looks into
BLOCK = 16_384  # queries that are sent to all tasks at most; more are joined by leaf
GROUP = 32_768  # vectors of neighbouring leaves that a task should hold
BATCH = 2_048  # queries that a task weighs at once
PAIRS = 500_000  # pairs of a query and a vector that a task weighs at once, about
NEAREST = 10


def usable(nodes: DataFrame, key: str = "id", vector: str = "embedding", width: int = WIDTH) -> DataFrame:
    """(id, vector): rows with a non-blank id and ``width`` finite numbers that are not all zero. Repeated ids stay."""
    v = F.col(vector)
    return nodes.where(usable_vector(v, width)).select(clean_id(key).alias("id"), v.cast("array<float>").alias("vector")).where("id is not null")


def _plane(points: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A unit vector to project on: from one random point to another, after both have moved to the middle of what is nearer
    to them for a few rounds, which cuts between clusters rather than through them."""
    plane = rng.normal(size=points.shape[1])
    if len(points) >= 2:
        some = points[rng.choice(len(points), min(len(points), SOME), replace=False)]
        a, b = some[0], some[1]
        for _ in range(ROUNDS):
            near = some @ (a - b) > (a @ a - b @ b) / 2
            if near.all() or not near.any():
                break
            a, b = some[near].mean(0), some[~near].mean(0)
        if np.linalg.norm(a - b) > 1e-6:
            plane = a - b
    return plane / np.linalg.norm(plane)


class Forest:
    """Random-projection trees over unit vectors; node k of a tree has children 2k + 1 and 2k + 2."""

    def __init__(self, sample: np.ndarray, rows: int, trees: int = TREES, leaf: int = LEAF, seed: int = 20240501) -> None:
        rng = np.random.default_rng(seed)
        n, width = sample.shape if len(sample) else (0, WIDTH)
        self.depth = int(np.clip(np.ceil(np.log2(max(rows, 1) / leaf)), 1, DEEPEST))
        self.planes = np.zeros((trees, (1 << self.depth) - 1, width), np.float32)
        self.cuts = np.zeros((trees, (1 << self.depth) - 1), np.float32)
        for t in range(trees):
            code = np.zeros(n, np.int64)
            for level in range(self.depth):
                first = (1 << level) - 1
                order = np.argsort(code, kind="stable")
                ends = np.searchsorted(code[order], np.arange((1 << level) + 1))
                for k in range(1 << level):
                    ix = order[ends[k] : ends[k + 1]]
                    plane = _plane(sample[ix], rng)
                    self.planes[t, first + k] = plane
                    self.cuts[t, first + k] = np.median(sample[ix] @ plane) if len(ix) else 0.0
                code = code * 2 + self._right(sample, t, first + code)

    def _right(self, x: np.ndarray, tree: int, at: np.ndarray) -> np.ndarray:
        return (np.einsum("ij,ij->i", x, self.planes[tree][at]) > self.cuts[tree][at]).astype(np.int64)

    def leaves(self, x: np.ndarray, tree: int) -> np.ndarray:
        code = np.zeros(len(x), np.int64)
        for level in range(self.depth):
            code = code * 2 + self._right(x, tree, (1 << level) - 1 + code)
        return code

    def margins(self, x: np.ndarray) -> np.ndarray:
        """Signed distances of vectors to the cuts of all nodes: (vector, tree, node)."""
        flat = self.planes.reshape(-1, x.shape[1])
        return (x.astype(np.float32) @ flat.T).reshape(len(x), *self.cuts.shape) - self.cuts

    def look(self, side: np.ndarray, leaves: int) -> list[tuple[int, int]]:
        """(tree, leaf) of the leaves nearest to one vector, given by its margins, over all trees."""
        queue = [(-np.inf, t, 0, 0) for t in range(len(side))]
        found: list[tuple[int, int]] = []
        while queue and len(found) < leaves:
            missed, t, level, code = heapq.heappop(queue)
            own = side[t]
            while level < self.depth:
                s = own.item((1 << level) - 1 + code)
                level += 1
                far = code * 2 + (s <= 0)
                code = code * 2 + (s > 0)
                heapq.heappush(queue, (max(missed, abs(s)), t, level, far))
            found.append((t, code))
        return found

    def looks(self, x: np.ndarray, leaves: int) -> Iterator[list[tuple[int, int]]]:
        for at in range(0, len(x), 64):
            for side in self.margins(x[at : at + 64]):
                yield self.look(side, leaves)


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def fit(vectors: DataFrame, trees: int = TREES, leaf: int = LEAF, sample: int = SAMPLE) -> Forest:
    """The forest of a table of (id, vector), from at most ``sample`` rows chosen by a hash of their ids."""
    rows = vectors.count()
    taken = vectors.orderBy(F.xxhash64("id"), "id").limit(sample).select("vector").toArrow()["vector"].combine_chunks()
    points = np.asarray(taken.flatten(), dtype=np.float32).reshape(len(taken), -1) if len(taken) else np.zeros((0, WIDTH), np.float32)
    return Forest(_unit(points), rows, trees, leaf)


class _Best:
    """The nearest distinct ids of each query so far."""

    def __init__(self, queries: int, keep: int) -> None:
        self.keep, self.least = keep, np.full(queries, -np.inf)
        self.query, self.sim, self.ids = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, object)

    def add(self, query: np.ndarray, sim: np.ndarray, ids: np.ndarray) -> None:
        query, sim, ids = np.r_[self.query, query], np.r_[self.sim, sim], np.r_[self.ids, ids]
        if not len(query):
            return
        code, names = pd.factorize(ids, sort=True)
        order = np.lexsort((code, -sim, query))
        _, first = np.unique(query[order] * len(names) + code[order], return_index=True)
        order = order[np.sort(first)]  # each id once a query, its greatest cosine
        starts = np.flatnonzero(np.diff(query[order], prepend=-1))
        place = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
        full = order[place == self.keep - 1]
        self.least[query[full]] = sim[full]
        order = order[place < self.keep]
        self.query, self.sim, self.ids = query[order], sim[order], ids[order]


def _looking(queries: DataFrame, forest, look: int) -> DataFrame:
    """(id, vector, leaves): each distinct query with the leaves that it looks into, as tree << 32 | leaf."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            if not part.num_rows:
                continue
            x = _unit(np.asarray(part.column(1).flatten(), dtype=np.float64).reshape(part.num_rows, -1))
            leaves = [[t << 32 | code for t, code in found] for found in forest.value.looks(x, look)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(leaves, pa.list_(pa.int64()))], names=["id", "vector", "leaves"])

    return queries.dropDuplicates(["id"]).select("id", "vector").mapInArrow(run, "id string, vector array<float>, leaves array<bigint>")


def _search_block(vectors: DataFrame, forest, names: list[str], points: np.ndarray, leaves: np.ndarray, keep: int) -> DataFrame:
    """(query, neighbour, cosine) with at most ``keep`` rows of each query from each partition."""
    order = np.argsort(leaves, axis=None, kind="stable")
    flat = leaves.reshape(-1)[order]
    ends = np.flatnonzero(np.diff(flat, append=-1)) + 1
    into = {(int(flat[e - 1]) >> 32, int(flat[e - 1]) & 0xFFFFFFFF): order[b:e] // leaves.shape[1] for b, e in zip([0, *ends[:-1]], ends)}
    asked = vectors.sparkSession.sparkContext.broadcast((names, points, into))
    schema = "query long, neighbour string, cosine double"
    step = 4096

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, points, into = asked.value
        own = np.array(names, dtype=object)
        best = _Best(len(names), keep)
        for whole in parts:
            for part in (whole.slice(at, step) for at in range(0, whole.num_rows, step)):
                ids = np.array(part.column(0).to_pylist(), dtype=object)
                x = _unit(np.asarray(part.column(1).flatten(), dtype=np.float64).reshape(len(ids), -1))
                found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
                held = 0

                def settle() -> None:
                    nonlocal held
                    if found:
                        query, row, sim = (np.concatenate(f) for f in zip(*found))
                        other = own[query] != ids[row]
                        best.add(query[other], sim[other], ids[row[other]])
                    found.clear()
                    held = 0

                for t in range(len(forest.value.planes)):
                    code = forest.value.leaves(x, t)
                    order = np.argsort(code, kind="stable")
                    ends = np.flatnonzero(np.diff(code[order], append=-1)) + 1
                    for begin, end in zip([0, *ends[:-1]], ends):
                        who = into.get((t, int(code[order[begin]])))
                        if who is None:
                            continue
                        few = max(1, PAIRS // len(who))
                        for at_ in range(begin, end, few):
                            rows = order[at_ : min(at_ + few, end)]
                            sims = points[who] @ x[rows].T
                            q, r = np.nonzero(sims >= best.least[who, None])
                            found.append((who[q], rows[r], sims[q, r]))
                            held += len(q)
                            if held > PAIRS:  # what is known by now raises the bar for the rest
                                settle()
                settle()
        if len(best.query):
            yield pa.RecordBatch.from_arrays([pa.array(best.query), pa.array(best.ids.tolist(), pa.string()), pa.array(best.sim)], names=["query", "neighbour", "cosine"])

    return vectors.mapInArrow(run, schema)


def nearest(queries: DataFrame, vectors: DataFrame, keep: int = NEAREST, look: int = LOOK, forest: Forest | None = None, block: int = BLOCK) -> DataFrame:
    """(id, neighbour, cosine): the ``keep`` most similar other ids of each distinct id in ``queries``.

    Both tables are (id, vector) as of ``usable``; repeated ids count once, equal cosines are ordered by id, an id is
    never its own neighbour. Fewer rows come out where fewer other ids exist; no queries or no vectors give none. The
    cosine of what comes out is exact; what is missed depends on ``look``. block: see ``BLOCK``.
    """
    spark = vectors.sparkSession
    known = spark.sparkContext.broadcast(forest or fit(vectors))
    asked = stored(_looking(queries, known, look)) if _at_most(queries, block) else None
    if asked is None:
        return _by_leaf(queries, vectors, known, keep, look)
    found = asked.toArrow().combine_chunks()
    if not found.num_rows:
        return spark.createDataFrame([], "id string, neighbour string, cosine double")
    names = found["id"].to_pylist()
    matrix = lambda c: np.asarray(found[c].combine_chunks().flatten()).reshape(len(names), -1)
    rows = _search_block(vectors, known, names, _unit(matrix("vector").astype(np.float64)), matrix("leaves"), keep)
    ids = spark.createDataFrame(list(enumerate(names)), "query long, id string")
    return _top(rows.join(F.broadcast(ids), "query").select("id", "neighbour", "cosine"), "id", "neighbour", keep)


def _at_most(rows: DataFrame, n: int) -> bool:
    return rows.limit(n + 1).count() <= n


def _top(found: DataFrame, query: str, other: str, keep: int) -> DataFrame:
    """The ``keep`` rows of each query with the greatest cosine, each other once; one exchange."""
    single = found.repartition(query).groupBy(query, other).agg(F.max("cosine").alias("cosine"))
    order = W.partitionBy(query).orderBy(F.desc("cosine"), other)
    return single.withColumn("place", F.row_number().over(order)).where(F.col("place") <= keep).drop("place")


# ---------------------------------------------------------------- many queries: a join by leaf


def _classes(vectors: DataFrame, keep: int) -> DataFrame:
    """(num, a, b, vector, ids): each distinct vector once, keyed by two hashes, with its first ``keep`` ids in order.

    A group of copies of a third of all rows leaves each task as ``keep`` rows, and no later step sees more of it.
    """
    rows = vectors.select("id", "vector", F.xxhash64("vector").alias("a"), F.hash("vector").alias("b")).dropDuplicates(["a", "b", "id"])
    first = rows.withColumn("place", F.row_number().over(W.partitionBy("a", "b").orderBy("id"))).where(F.col("place") <= keep)
    made = first.groupBy("a", "b").agg(F.first("vector").alias("vector"), F.array_sort(F.collect_list("id")).alias("ids"))
    return stored(made.select(F.monotonically_increasing_id().alias("num"), "a", "b", "vector", "ids"))


_ROUTED = "key long, salt int, side int, num long, leaves array<int>, vector array<float>"


def _routed(classes: DataFrame, forest, groups: int, sizes, look: int | None) -> DataFrame:
    """Rows of ``_ROUTED``: each vector (side 0) in the group of its leaf of each tree, or with ``look`` each query (side 1)
    in the groups of the leaves that it looks into; a query goes to all salts of a group, a vector to one."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, shift = forest.value, forest.value.depth - groups
        for part in parts:
            if not part.num_rows:
                continue
            num = np.asarray(part.column(0))
            raw = np.asarray(part.column(1).flatten(), dtype=np.float32).reshape(len(num), -1)
            x = _unit(raw.astype(np.float64)).astype(np.float32)
            if look is None:
                codes = np.stack([f.leaves(x, t) for t in range(len(f.planes))])
                key = ((np.arange(len(codes))[:, None] << 32) | (codes >> shift)).reshape(-1)
                row, leaves, lengths = np.tile(np.arange(len(num)), len(codes)), codes.reshape(-1), np.ones(codes.size, np.int64)
                every, place = np.unique(key, return_inverse=True)
                salt = num[row] % np.array([sizes.value.get(int(k), 1) for k in every])[place]
            else:
                row_, key_, salt_, leaf_, lengths_ = [], [], [], [], []
                for i, found in enumerate(f.looks(x, look)):
                    into: dict[int, list[int]] = {}
                    for t, code in found:
                        into.setdefault(t << 32 | code >> shift, []).append(code)
                    for k, own in into.items():
                        for s in range(sizes.value.get(k, 0)):  # a group without vectors is asked nothing
                            row_.append(i), key_.append(k), salt_.append(s), leaf_.extend(own), lengths_.append(len(own))
                row, key, salt, leaves, lengths = (np.array(v, dtype=np.int64) for v in (row_, key_, salt_, leaf_, lengths_))
            for at in range(0, len(row), 8192):
                to = min(at + 8192, len(row))
                ends = np.r_[0, np.cumsum(lengths)]
                lists = pa.ListArray.from_arrays(pa.array(ends[at : to + 1] - ends[at], pa.int32()), pa.array(leaves[ends[at] : ends[to]], pa.int32()))
                points = pa.ListArray.from_arrays(pa.array(np.arange(to - at + 1) * raw.shape[1], pa.int32()), pa.array(raw[row[at:to]].reshape(-1)))
                side = np.full(to - at, 0 if look is None else 1)
                columns = [pa.array(key[at:to], pa.int64()), pa.array(salt[at:to], pa.int32()), pa.array(side, pa.int32()), pa.array(num[row[at:to]], pa.int64()), lists, points]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _ROUTED.split(", ")])

    return classes.select("num", "vector").mapInArrow(run, _ROUTED)


def _group_sizes(classes: DataFrame, forest, groups: int) -> dict[int, int]:
    """How many salts each (tree, group of leaves) needs; at most as many entries as the forest has leaves."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = forest.value
        total = np.zeros((len(f.planes), 1 << groups), np.int64)
        for part in parts:
            if part.num_rows:
                x = _unit(np.asarray(part.column(0).flatten(), dtype=np.float64).reshape(part.num_rows, -1)).astype(np.float32)
                for t in range(len(total)):
                    total[t] += np.bincount(f.leaves(x, t) >> (f.depth - groups), minlength=1 << groups)
        t, g = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(t.astype(np.int64) << 32 | g), pa.array(total[t, g])], names=["key", "n"])

    counts = classes.select("vector").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).collect()
    return {r["key"]: -(-r["n"] // (2 * GROUP)) for r in counts}


def _weigh(rows: Iterator[pa.RecordBatch], keep: int) -> Iterator[pa.RecordBatch]:
    """(query, other, cosine): the best ``keep`` of each query in each (key, salt); rows come sorted by key, salt and side."""
    at, held, waiting, count = None, [], [], 0
    table = None  # of the group: numbers, vectors, and the rows of each leaf

    def flush():
        nonlocal waiting, count, held, table
        if table is None and held:
            num = np.concatenate([h[0] for h in held])
            leaf = np.concatenate([h[1] for h in held])
            order = np.argsort(leaf, kind="stable")
            ends = np.r_[0, np.flatnonzero(np.diff(leaf[order])) + 1, len(order)]
            raw = np.concatenate([h[2] for h in held])[order].astype(np.float64)
            x = _unit(raw)
            table = num[order], x, x.astype(np.float32), {int(leaf[order[b]]): (b, e) for b, e in zip(ends, ends[1:])}
            held = []
        asked, waiting, count = waiting, [], 0
        if not asked or table is None:
            return None
        num, exact, x, leaves = table
        query = np.concatenate([a[0] for a in asked])
        whole = _unit(np.concatenate([a[2] for a in asked]).astype(np.float64))
        points = whole.astype(np.float32)
        lists = np.concatenate([a[1] for a in asked])
        who = np.repeat(np.arange(len(query)), np.concatenate([a[3] for a in asked]))
        order = np.argsort(lists, kind="stable")
        ends = np.r_[0, np.flatnonzero(np.diff(lists[order])) + 1, len(order)]
        q_, o_, s_ = [], [], []
        for b, e in zip(ends, ends[1:]):
            span = leaves.get(int(lists[order[b]]))
            if span is None:
                continue
            q = who[order[b:e]]
            own = x[span[0] : span[1]].T
            step = max(1, PAIRS // own.shape[1])
            for i in range(0, len(q), step):
                sims = points[q[i : i + step]] @ own
                k = min(keep, sims.shape[1])
                best = np.argpartition(-sims, k - 1, axis=1)[:, :k] if k < sims.shape[1] else np.broadcast_to(np.arange(k), sims.shape)
                q_.append(np.repeat(q[i : i + step], k)), o_.append((span[0] + best).reshape(-1)), s_.append(np.take_along_axis(sims, best, 1).reshape(-1))
        if not q_:
            return None
        q, o, s = np.concatenate(q_), np.concatenate(o_), np.concatenate(s_)
        order = np.lexsort((num[o], -s, q))
        q, o = q[order], o[order]
        starts = np.flatnonzero(np.diff(q, prepend=-1))
        good = np.arange(len(q)) - np.repeat(starts, np.diff(np.append(starts, len(q)))) < keep
        q, o = q[good], o[good]
        cosine = np.einsum("ij,ij->i", whole[q], exact[o])
        return pa.RecordBatch.from_arrays([pa.array(query[q]), pa.array(num[o]), pa.array(cosine)], names=["query", "other", "cosine"])

    for part in rows:
        if not part.num_rows:
            continue
        key, salt, side, num = (np.asarray(part.column(i)) for i in range(4))
        lists, points = part.column(4), part.column(5)
        leaf, offsets = np.asarray(lists.flatten()), np.asarray(lists.offsets)
        x = np.asarray(points.flatten()).reshape(len(num), -1)
        offsets = offsets - offsets[0]
        change = np.r_[0, np.flatnonzero((np.diff(key) != 0) | (np.diff(salt) != 0) | (np.diff(side) != 0)) + 1, len(num)]
        for b, e in zip(change, change[1:]):
            if (key[b], salt[b]) != at:
                out = flush()
                if out is not None:
                    yield out
                at, held, table = (key[b], salt[b]), [], None
            if side[b] == 0:
                held.append((num[b:e], leaf[offsets[b] : offsets[e]], x[b:e]))
                continue
            for i in range(b, e, BATCH):
                j = min(i + BATCH, e)
                waiting.append((num[i:j], leaf[offsets[i] : offsets[j]], x[i:j], np.diff(offsets[i : j + 1])))
                count += j - i
                if count >= BATCH:
                    out = flush()
                    if out is not None:
                        yield out
    out = flush()
    if out is not None:
        yield out


def _by_leaf(queries: DataFrame, vectors: DataFrame, forest, keep: int, look: int) -> DataFrame:
    """``nearest`` for any number of queries: distinct vectors of both sides meet by (tree, group of leaves).

    One more neighbour than asked is sought for each distinct vector, since a query's own id may be among them.
    """
    more = keep + 1
    classes = _classes(vectors, more)
    asked = classes if queries is vectors else _classes(queries, 1)
    groups = int(np.clip(np.ceil(np.log2(max(classes.count(), 1) / GROUP)), 0, forest.value.depth))
    sizes = vectors.sparkSession.sparkContext.broadcast(_group_sizes(classes, forest, groups))
    sides = _routed(classes, forest, groups, sizes, None).unionByName(_routed(asked, forest, groups, sizes, look))
    met = sides.repartition("key", "salt").sortWithinPartitions("key", "salt", "side")
    near = _top(met.mapInArrow(lambda rows: _weigh(rows, more), "query long, other long, cosine double"), "query", "other", more)
    # from vectors back to ids: the neighbours of a vector as one list, which each of its ids takes without itself
    named = near.join(classes.select(F.col("num").alias("other"), F.explode("ids").alias("neighbour")), "other")
    item = F.struct((-F.col("cosine")).alias("far"), "neighbour")
    lists = named.groupBy("query").agg(F.slice(F.array_sort(F.collect_list(item)), 1, more).alias("near"))
    keyed = lists.join(asked.select(F.col("num").alias("query"), "a", "b"), "query").select("a", "b", "near")
    ids = queries.groupBy("id").agg(F.min(F.struct(F.xxhash64("vector").alias("a"), F.hash("vector").alias("b"))).alias("k")).select("id", "k.a", "k.b")
    own = ids.join(keyed, ["a", "b"]).select("id", F.explode(F.slice(F.filter("near", lambda x: x["neighbour"] != F.col("id")), 1, keep)).alias("x"))
    return own.select("id", F.col("x.neighbour").alias("neighbour"), (-F.col("x.far")).alias("cosine"))
