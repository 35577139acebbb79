"""Operator 2: near-duplicate vectors by a forest of random-projection trees.

Equal vectors are folded into one class first. Each tree splits the classes recursively at the median of a random
projection; vectors near a threshold go to both sides (spill), so close pairs seldom part, and many trees make a pair
that parts in one meet in another. Vectors are compared only within leaves, in double precision; what a leaf emits are
the links of a spanning star of each linked group, never its pairs. Their union gives components, and the links of each
vector are then counted exactly inside its component.

Thresholds come from medians of a sample (``sample`` vectors at most), so cells hold equal shares of the data however
it clusters: a third of all rows in one tight group is cut like the rest. Where a sample cannot make cells small enough,
each cell that is too large gets a tree of its own from a sample of its own rows, and again, until every cell fits one
task. Where a group is so tight that spilling would copy it whole to both sides, the node splits without spill and passes
a few hub vectors to both sides, which keep its halves connected.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite components link with nothing (n_links 0, own
component, kept); so do rows with a null vec_id, whose component and kept are null. Vectors of unequal length compare
as if the shorter ones ended in zeros. Rows that repeat a vector are links of each other; rows that share a vec_id but
not a vector are judged each by its own vector. An empty table gives no row; further columns are ignored.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sized, written
from .components import components

LEAF_SCHEMA = "tree int, leaf long, id long, vec binary"
LINK_SCHEMA = "a long, b long"


def usable(column: str):
    """Whether the vector takes part: no null or non-finite component and a norm above zero."""
    x = F.col(column)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(x, lambda v: v != 0), F.lit(False))


def plain_rows(column: pa.Array, dim: int) -> np.ndarray:
    """An Arrow list column as a matrix of its own number type, extended by zeros to ``dim``."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes, flat = np.diff(column.offsets.to_numpy()), column.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(sizes), dim), dtype=flat.dtype)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision."""
    out = rows.astype(np.float64)
    out /= np.abs(out).max(axis=1, keepdims=True, initial=1e-300)
    return out / np.sqrt((out * out).sum(axis=1, keepdims=True))


def unit_rows(column: pa.Array, dim: int) -> np.ndarray:
    return unit(plain_rows(column, dim))


def as_binary(rows: np.ndarray) -> pa.Array:
    """One binary value for each row of a matrix."""
    raw, step = np.ascontiguousarray(rows), rows.shape[1] * rows.itemsize
    ends = np.arange(len(raw) + 1, dtype=np.int64) * step
    return pa.Array.from_buffers(pa.large_binary(), len(raw), [None, pa.py_buffer(ends), pa.py_buffer(raw)]).cast(pa.binary())


def from_binary(column, kind: np.dtype, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(-1, dim)


class Tree:
    """Nodes in arrays: a direction, a threshold, a spill margin, hub ids; leaves are negative numbers."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, leaf: int, margin: float, rng: np.random.Generator, hubs: int = 4):
        self.w, self.t, self.m, self.kids, self.hubs, self.leaves = [], [], [], [], [], 0
        self.root = self._split(x, ids, np.arange(len(x)), leaf, margin, rng, hubs, 0)

    def _split(self, x, ids, at, leaf, margin, rng, hubs, depth) -> int:
        if len(at) <= leaf or depth > 40:
            self.leaves += 1
            return -self.leaves
        w = rng.standard_normal(x.shape[1])
        w /= np.linalg.norm(w)
        p = x[at] @ w
        t = float(np.median(p))
        left, right, hub = p <= t + margin, p > t - margin, np.zeros(0, dtype=np.int64)
        if max(left.sum(), right.sum()) > 0.85 * len(at):
            margin_here, order = 0.0, np.argsort(p, kind="stable")
            half = np.zeros(len(at), dtype=bool)
            half[order[: len(at) // 2]] = True
            t = float((p[order[len(at) // 2 - 1]] + p[order[len(at) // 2]]) / 2)
            mid = order[len(at) // 2 - hubs // 2 : len(at) // 2 + hubs - hubs // 2]
            hub, left, right = ids[at[mid]], half.copy(), ~half
            left[mid] = right[mid] = True
        else:
            margin_here = margin
        k = len(self.w)
        self.w.append(w)
        self.t.append(t)
        self.m.append(margin_here)
        self.hubs.append(hub)
        self.kids.append(None)
        self.kids[k] = tuple(self._split(x, ids, at[s], leaf, margin, rng, hubs, depth + 1) for s in (left, right))
        return k

    def leaves_of(self, x: np.ndarray, ids: np.ndarray):
        """(leaf number, rows) pairs: every row is in one leaf at least."""
        todo = [(self.root, np.arange(len(x)))]
        while todo:
            k, at = todo.pop()
            if not len(at):
                continue
            if k < 0:
                yield -k, at
                continue
            p = x[at] @ self.w[k]
            left, right = p <= self.t[k] + self.m[k], p > self.t[k] - self.m[k]
            if len(self.hubs[k]):
                both = np.isin(ids[at], self.hubs[k])
                left, right = left | both, right | both
            todo += [(self.kids[k][0], at[left]), (self.kids[k][1], at[right])]


def leaf_links(x: np.ndarray, ids: np.ndarray, least: float):
    """(id, smallest id of its linked group) within one leaf."""
    close = x @ x.T >= least
    label = np.arange(len(x))
    label = label[np.argsort(np.argsort(ids))]  # ranks of the ids, so the smallest label is the smallest id
    np.fill_diagonal(close, True)
    while True:
        new = np.where(close, label[None, :], len(x)).min(axis=1)
        if (new == label).all():
            break
        label = new
    root = np.sort(ids)[label]
    other = root != ids
    return ids[other], root[other]


def _group_links(x: np.ndarray, ids: np.ndarray, least: float, leaf: int, margin: float, seed: int):
    tree = Tree(x, ids, leaf, margin, np.random.default_rng(seed))
    for _, at in tree.leaves_of(x, ids):
        yield leaf_links(x[at], ids[at], least)


def forest_links(
    classes: DataFrame, dim: int, rows: int, least: float, trees: int, leaf: int, margin: float, sample: int, cell: int, seed: int
) -> DataFrame:
    """Spanning links (a, b) found in the leaves of all trees over ``classes`` (id, embedding)."""
    share = min(1.0, sample / max(rows, 1))
    chosen = classes.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30)))
    got = chosen.select("id", "embedding").toArrow()
    x, ids = unit_rows(got.column(1), dim), got.column(0).to_numpy()
    kind = np.dtype(np.float32) if classes.schema["embedding"].dataType.elementType.typeName() == "float" else np.dtype(np.float64)
    fit_leaf = max(32, int(cell * len(ids) / max(rows, 1)))
    fitted = [Tree(x, ids, fit_leaf, margin, np.random.default_rng((seed, t))) for t in range(trees)]
    shared = classes.sparkSession.sparkContext.broadcast(fitted)  # bounded by trees x sample / 32 nodes

    def deal(batches):
        for batch in batches:
            raw, own = plain_rows(batch.column(1), dim).astype(kind), batch.column(0).to_numpy()
            v = unit(raw)
            for t, tree in enumerate(shared.value):
                for number, at in tree.leaves_of(v, own):
                    tags = (pa.array(np.full(len(at), t, dtype=np.int32)), pa.array(np.full(len(at), number, dtype=np.int64)))
                    yield pa.RecordBatch.from_arrays([*tags, pa.array(own[at]), as_binary(raw[at])], names=["tree", "leaf", "id", "vec"])

    def compare(key, table):
        own = table.column("id").to_numpy()
        v = unit(from_binary(table.column("vec"), kind, dim))
        order = np.argsort(own)
        found = list(_group_links(v[order], own[order], least, leaf, margin, (seed + 7919 * key[0].as_py() + key[1].as_py()) % (1 << 63)))
        a, b = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, dtype=np.int64) for i in (0, 1))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    dealt = classes.select("id", "embedding").mapInArrow(deal, LEAF_SCHEMA)
    if rows * fit_leaf > 4 * cell * max(len(ids), 1):
        dealt = split_large_cells(written(dealt, "cells"), dim, kind, margin, sample, cell, seed)
    return dealt.groupBy("tree", "leaf").applyInArrow(compare, LINK_SCHEMA)


def split_large_cells(cells: DataFrame, dim: int, kind: np.dtype, margin: float, sample: int, cell: int, seed: int, rounds: int = 8) -> DataFrame:
    """``cells`` (tree, leaf, id, vec) with every cell of more than 4 * ``cell`` rows dealt anew by a tree of its own.

    A large cell's tree is fitted in one task on about ``sample`` of its rows, and its rows pass through copies of that
    tree in portions: no task ever holds a large cell. ``rounds`` only stops cells that no direction can part.
    """
    done = None
    for turn in range(rounds):
        held = written(cells.groupBy("tree", "leaf").agg(F.count(F.lit(1)).alias("held")).where(F.col("held") > 4 * cell), "held")
        n_held = held.count()
        if not n_held:
            break
        large = cells.join(sized(held, n_held), ["tree", "leaf"])
        small = cells.join(sized(held, n_held), ["tree", "leaf"], "left_anti")
        done = small if done is None else done.unionByName(small)
        rate = F.lit(float(sample) * (1 << 30)) / F.col("held")
        picked = large.where(F.pmod(F.xxhash64("id", F.lit(seed + turn)), F.lit(1 << 30)) < rate)

        def fit(key, table):
            own = table.column("id").to_numpy()
            order, held_here = np.argsort(own), table.column("held")[0].as_py()
            x = unit(from_binary(table.column("vec"), kind, dim))[order]
            rng = np.random.default_rng((seed, key[0].as_py(), key[1].as_py() % (1 << 63)))
            tree = Tree(x, own[order], max(32, int(cell * len(own) / held_here)), margin, rng)
            return pa.table({"tree": pa.array([key[0].as_py()], pa.int32()), "leaf": pa.array([key[1].as_py()], pa.int64()), "made": pa.array([pickle.dumps(tree)], pa.binary())})

        made = written(picked.groupBy("tree", "leaf").applyInArrow(fit, "tree int, leaf long, made binary"), "made")
        portions = F.ceil(F.col("held") / (4 * cell)).cast("int")
        trees = made.join(sized(held, n_held), ["tree", "leaf"]).withColumn("portion", F.explode(F.sequence(F.lit(0), portions - 1)))
        parts = large.withColumn("portion", F.pmod(F.xxhash64("id"), portions).cast("int"))

        def deal(key, rows, tree):
            if not rows.num_rows:
                return pa.table({"tree": pa.array([], pa.int32()), "leaf": pa.array([], pa.int64()), "number": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "vec": pa.array([], pa.binary())})
            raw, own = from_binary(rows.column("vec"), kind, dim), rows.column("id").to_numpy()
            numbers, at = zip(*pickle.loads(tree.column("made")[0].as_py()).leaves_of(unit(raw), own))
            number, at = np.repeat(numbers, [len(x) for x in at]), np.concatenate(at)
            same = lambda x, t: pa.array(np.full(len(at), x), t)
            return pa.table({"tree": same(key[0].as_py(), pa.int32()), "leaf": same(key[1].as_py(), pa.int64()), "number": pa.array(number, pa.int64()), "id": pa.array(own[at], pa.int64()), "vec": as_binary(raw[at])})

        keys = ["tree", "leaf", "portion"]
        again = parts.select(*keys, "id", "vec").groupBy(*keys).cogroup(trees.select(*keys, "made").groupBy(*keys))
        again = again.applyInArrow(deal, "tree int, leaf long, number long, id long, vec binary")
        cells = written(again.select("tree", F.xxhash64("leaf", "number").alias("leaf"), "id", "vec"), "cells")
    return cells if done is None else done.unionByName(cells)


def link_counts(members: DataFrame, dim: int, least: float, block: int = 1024) -> DataFrame:
    """(id, others): rows of other classes linked with each class, counted exactly inside its component.

    ``members``: component, id, embedding, copies, pivot (the component's first vector). Vectors within half the
    threshold's angle of the pivot form the core, whose pairs all link, so they are counted without comparing. The
    rest meet the core and each other in blocks of about ``block`` vectors: no group has to fit one task.
    """
    half = float(np.sqrt((1 + least) / 2)) + 1e-9
    dot = F.aggregate(
        F.zip_with("embedding", "pivot", lambda a, b: F.coalesce(a, F.lit(0.0)).cast("double") * F.coalesce(b, F.lit(0.0)).cast("double")),
        F.lit(0.0), lambda s, v: s + v,
    )
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    core = dot / norm("embedding") / norm("pivot") >= half
    m = written(members.withColumn("core", F.coalesce(core, F.lit(False))).drop("pivot"), "members")
    kinds = m.groupBy("component").agg(
        F.count_if("core").alias("n_core"), F.count_if(~F.col("core")).alias("n_rest"),
        F.sum(F.when(F.col("core"), F.col("copies"))).alias("core_rows"),
    )
    m = m.join(kinds, "component")
    by_core = m.where("core").select("id", (F.col("core_rows") - F.col("copies")).alias("others"))
    blocks_of = lambda c: F.ceil(F.col(c) / block).cast("int")
    h = F.xxhash64("id")
    mixed = m.where("n_rest > 0")
    slot = lambda c: F.pmod(h, blocks_of(c)).cast("int")
    core_side = mixed.where("core").select("component", "id", "embedding", "copies", F.lit(0).alias("kind"), slot("n_core").alias("i"), F.lit(-1).alias("j"))
    rest_core = mixed.where("not core and n_core > 0").select("component", "id", "embedding", "copies", F.lit(1).alias("kind"), F.explode(F.sequence(F.lit(0), blocks_of("n_core") - 1)).alias("i"), F.lit(-1).alias("j"))
    rest = mixed.where("not core").withColumn("own", slot("n_rest")).withColumn("k", F.explode(F.sequence(F.lit(0), blocks_of("n_rest") - 1)))
    rest_rest = rest.select("component", "id", "embedding", "copies", F.when(F.col("own") <= F.col("k"), 2).otherwise(3).alias("kind"), F.least("own", "k").alias("i"), F.greatest("own", "k").alias("j"))

    def count(key, table):
        ids, kind = table.column("id").to_numpy(), table.column("kind").to_numpy()
        x, copies = unit_rows(table.column("embedding"), dim), table.column("copies").to_numpy()
        i, j = key[1].as_py(), key[2].as_py()
        first, second = (kind == 0, kind == 1) if j < 0 else (kind == 2, kind == 3 if i != j else kind == 2)
        a, b = np.flatnonzero(first), np.flatnonzero(second)
        got, n = [], []
        for at in range(0, len(a), block):
            rows = a[at : at + block]
            close = x[rows] @ x[b].T >= least
            if i == j:
                close[np.arange(len(rows)), at + np.arange(len(rows))] = False
            got.append(ids[rows])
            n.append(close @ copies[b])
            if i != j:
                got.append(ids[b])
                n.append(copies[rows] @ close)
        return pa.table({"id": pa.array(np.concatenate(got or [ids[:0]]), pa.int64()), "others": pa.array(np.concatenate(n or [ids[:0]]).astype(np.int64), pa.int64())})

    sides = core_side.unionByName(rest_core).unionByName(rest_rest)
    # dealt by block: the join before leaves whole components together
    compared = sides.repartition("component", "i", "j").groupBy("component", "i", "j").applyInArrow(count, "id long, others long")
    return by_core.unionByName(compared).groupBy("id").agg(F.sum("others").alias("others"))


def near_vectors(
    rows: DataFrame, least: float = 0.9, trees: int = 10, leaf: int = 256, margin: float = 0.02, sample: int = 20_000, cell: int = 4000, seed: int = 17
) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept, and the size of its component.

    ``sample`` bounds the vectors on which the trees' upper part is fitted; ``cell`` is the number of vectors aimed at
    in one of its cells, where the tree goes on within the task that holds the cell.
    """
    base = rows.select("vec_id", "embedding").withColumn("ok", usable("embedding") & F.col("vec_id").isNotNull())
    good = base.where("ok").groupBy("embedding").agg(F.min("vec_id").alias("vec"), F.count(F.lit(1)).alias("copies"))
    # a number of its own for each distinct vector, fixed once written: two vectors may share a vec_id
    classes = written(good.withColumn("id", F.monotonically_increasing_id()), "classes")
    n, dim, copies = classes.agg(F.count(F.lit(1)), F.max(F.size("embedding")), F.max("copies")).first()
    dim = dim or 1
    if n:
        links = forest_links(classes, dim, n, least, trees, leaf, margin, sample, cell, seed)
    else:
        links = classes.select(F.col("id").alias("a"), F.col("id").alias("b"))
    comp = components(links)
    n_comp = comp.count()
    joined = classes.join(sized(comp, n_comp), "id")
    pivots = classes.select(F.col("id").alias("component"), F.col("embedding").alias("pivot"))
    pivots = pivots.join(sized(comp.where("id = component").select("component"), n_comp), "component", "left_semi")
    counts = link_counts(joined.join(pivots, "component"), dim, least)
    sizes = joined.groupBy("component").agg(F.sum("copies").alias("component_rows"), F.min("vec").alias("component_id"))
    linked = written(comp.join(counts, "id").join(sizes, "component").drop("component"), "linked")
    known = classes.join(sized(linked, n_comp), "id", "left").select(
        "embedding",
        "vec",
        (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component_id", "vec").alias("component_id"),
        F.coalesce("component_rows", "copies").alias("component_rows"),
    )
    lone = base.where("not ok").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"),
        F.when(F.col("vec_id").isNotNull(), F.lit(True)).alias("kept"), F.lit(1).cast("long").alias("component_rows"),
    )
    if (copies or 0) > 1:
        out = base.where("ok").join(known.drop("vec"), "embedding")
    else:  # each row is its class
        out = known.withColumnRenamed("vec", "vec_id")
    out = out.select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"), "component_rows")
    return out.unionByName(lone)
