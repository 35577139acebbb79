"""Histogram boosting of many models at once: all purged splits of a table share its passes.

A row is stored once, with its binned features and the numbers of the models it teaches. One pass over the table fills
the histograms of every open node of every model; they are added up and split by model on the executors, and the driver
sees one row for each node. Growing ``trees`` of ``depth`` thus takes trees * depth passes however many models there are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..session import materialise

BLOCK_SCHEMA = "n int, bins binary, y binary, w binary, draw binary, member binary"
SPLIT_SCHEMA = "model int, node int, feature int, bin int, gain double, left double, right double"


@dataclass(frozen=True)
class Boosted:
    """What to learn: probability of ``label`` 1, or (``group`` given) an order of the rows of each group by ``label``."""

    features: tuple[str, ...]
    label: str = "label"
    weight: str | None = None
    group: str | None = None
    trees: int = 20
    depth: int = 4
    rate: float = 0.1
    bins: int = 32
    rows: float = 0.8
    columns: float = 0.8
    l2: float = 1.0
    least: int = 20
    seed: int = DEFAULT.seed


class Forest:
    """Fitted models: trees as heaps of (feature, bin), values of their leaves, and the total gain of each feature."""

    def __init__(self, spec: Boosted, edges: list[np.ndarray], models: list[int], base: np.ndarray, only: dict[int, tuple[int, ...]]):
        shape = (len(models), spec.trees, (1 << spec.depth) - 1)
        self.spec, self.edges, self.models, self.base, self.done = spec, edges, models, base, 0
        #: features each model may use, and the models of each such set
        self.only = [only.get(m, tuple(range(len(edges)))) for m in models]
        self.kinds = {columns: np.flatnonzero([o == columns for o in self.only]) for columns in dict.fromkeys(self.only)}
        self.feature, self.bin = np.zeros(shape, dtype=np.int16), np.full(shape, 255, dtype=np.uint8)
        self.value = np.zeros((len(models), spec.trees, 1 << spec.depth))
        self.gain = np.zeros((len(models), len(edges)))

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k]) for k, e in enumerate(self.edges)], axis=1).astype(np.uint8)

    def node(self, bins: np.ndarray, row: np.ndarray, model: np.ndarray, tree: int, depth: int) -> np.ndarray:
        """Place in level ``depth`` of a tree that each (row, model) pair comes to."""
        at = np.zeros(len(row), dtype=np.int64)
        for _ in range(depth):
            right = bins[row, self.feature[model, tree, at]] > self.bin[model, tree, at]
            at = 2 * at + 1 + right
        return at - ((1 << depth) - 1)

    def margin(self, bins: np.ndarray, row: np.ndarray, model: np.ndarray) -> np.ndarray:
        out = self.base[model].copy()
        for t in range(self.done):
            out += self.value[model, t, self.node(bins, row, model, t, self.spec.depth)]
        return out

    def importances(self) -> dict[str, float]:
        """Mean share of the gain by feature, largest first."""
        share = (self.gain / np.maximum(self.gain.sum(axis=1, keepdims=True), 1e-300)).mean(axis=0)
        return dict(sorted(zip(self.spec.features, share.tolist()), key=lambda x: -x[1]))


def _pairwise(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the ranking loss of one group: every pair of different labels pulls apart, by how
    much swapping the two would change the normalised discounted gain of the present order."""
    place = np.empty(len(y), dtype=np.int64)
    place[np.argsort(-margin, kind="stable")] = np.arange(len(y))
    worth, discount = 2.0**y - 1, 1 / np.log2(place + 2.0)
    best = (np.sort(worth)[::-1] / np.log2(np.arange(len(y)) + 2.0)).sum()
    if best <= 0:
        return np.zeros(len(y)), np.zeros(len(y))
    above = y[:, None] > y
    swap = np.abs((worth[:, None] - worth) * (discount[:, None] - discount)) / best * above
    p = 1 / (1 + np.exp(np.clip(margin[:, None] - margin, -60, 60)))
    pull, bend = swap * p, swap * p * (1 - p)
    return pull.sum(axis=0) - pull.sum(axis=1), bend.sum(axis=0) + bend.sum(axis=1)


def _blocks(data: DataFrame, spec: Boosted, forest: Forest) -> DataFrame:
    """``data`` (features, label, weight, member) in blocks: a group of rows each, or what one Arrow batch holds."""
    slot = {m: i for i, m in enumerate(forest.models)}
    draw = F.xxhash64(F.lit(spec.seed), *[F.col(c) for c in data.columns if c != "member"])
    weight = F.coalesce(F.col(spec.weight), F.lit(0.0)).cast("double") if spec.weight else F.lit(1.0)
    group = F.col(spec.group) if spec.group else F.lit(0)
    rows = data.select(*[F.col(f).cast("double").alias(f"f{i}") for i, f in enumerate(spec.features)], F.col(spec.label).cast("double").alias("y"), weight.alias("w"), draw.alias("draw"), "member", group.alias("g"))
    width = len(spec.features)
    rows = rows.where("size(member) > 0")

    def pack(table) -> pa.RecordBatch:
        x = np.stack([table.column(i).to_numpy(zero_copy_only=False) for i in range(width)], axis=1)
        member = np.zeros((table.num_rows, len(slot)), dtype=np.uint8)
        for i, models in enumerate(table.column("member").to_pylist()):
            member[i, [slot[m] for m in models if m in slot]] = 1
        number = lambda c: table.column(c).to_numpy(zero_copy_only=False)
        parts = (forest.binned(x), number("y").astype("<f8"), number("w").astype("<f8"), number("draw").astype("<i8"), member)
        return pa.RecordBatch.from_arrays([pa.array([table.num_rows], pa.int32()), *[pa.array([p.tobytes()], pa.binary()) for p in parts]], names=[c.split()[0] for c in BLOCK_SCHEMA.split(", ")])

    if spec.group:
        whole = lambda table: pa.Table.from_batches([pack(table.combine_chunks())])
        return materialise(rows.groupBy("g").applyInArrow(whole, BLOCK_SCHEMA), "blocks")

    def by_batch(batches):
        for batch in batches:
            if batch.num_rows:
                yield pack(pa.Table.from_batches([batch]).combine_chunks())

    return materialise(rows.mapInArrow(by_batch, BLOCK_SCHEMA), "blocks")


def _level(blocks: DataFrame, forest: Forest, tree: int, depth: int) -> list:
    """Best splits (rows of SPLIT_SCHEMA) of all nodes of one level of all models."""
    spec, models, nodes = forest.spec, len(forest.models), 1 << depth
    shared = blocks.sparkSession.sparkContext.broadcast(forest)  # trees: bounded by models x trees x 2**depth
    keep = int(spec.rows * (1 << 20))

    def count(batches):
        made = shared.value
        total = {columns: np.zeros((3, len(slots) * nodes * len(columns) * spec.bins)) for columns, slots in made.kinds.items()}
        for batch in batches:
            for b in batch.to_pylist():
                bins = np.frombuffer(b["bins"], dtype=np.uint8).reshape(b["n"], len(made.edges))
                y, w = np.frombuffer(b["y"]), np.frombuffer(b["w"])
                drawn = np.frombuffer(b["draw"], dtype="<u8") * np.uint64(2 * tree + 1) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(44)
                member = np.frombuffer(b["member"], dtype=np.uint8).reshape(b["n"], models).astype(bool)
                model, row = np.nonzero(member.T)
                margin = made.margin(bins, row, model)
                if spec.group:
                    g, h = np.zeros(len(row)), np.zeros(len(row))
                    for m in np.unique(model):
                        mine = model == m
                        g[mine], h[mine] = _pairwise(margin[mine], y[row[mine]])
                else:
                    p = 1 / (1 + np.exp(-np.clip(margin, -60, 60)))
                    g, h = (p - y[row]) * w[row], np.maximum(p * (1 - p), 1e-6) * w[row]
                some = np.flatnonzero(drawn[row] < keep)
                row, model, g, h = row[some], model[some], g[some], h[some]
                node = made.node(bins, row, model, tree, depth)
                for columns, slots in made.kinds.items():
                    slot = np.full(models, -1)
                    slot[slots] = np.arange(len(slots))
                    mine = np.flatnonzero(slot[model] >= 0) if len(made.kinds) > 1 else slice(None)
                    r, gm, hm, sums = row[mine], g[mine], h[mine], total[columns]
                    place = (slot[model[mine]] * nodes + node[mine]) * len(columns)
                    for k, f in enumerate(columns):
                        at = (place + k) * spec.bins + bins[r, f]
                        for i, x in enumerate((gm, hm, None)):
                            sums[i] += np.bincount(at, x, sums.shape[1])
        for columns, slots in made.kinds.items():
            flat = np.moveaxis(total[columns].reshape(3, len(slots), nodes, len(columns), spec.bins), 0, -1)
            used = np.flatnonzero(flat[..., 2].any(axis=(1, 2, 3)))
            yield pa.RecordBatch.from_arrays([pa.array(slots[used], pa.int32()), pa.array([flat[m].tobytes() for m in used], pa.binary())], names=["model", "sums"])

    def best(key, table):
        columns = np.array(shared.value.only[key[0].as_py()])
        width = len(columns)
        sums = sum(np.frombuffer(x, dtype=np.float64) for x in table.column("sums").to_pylist()).reshape(nodes, width, spec.bins, 3)
        left = np.cumsum(sums, axis=2)
        whole = left[:, :, -1:, :]
        right = whole - left
        worth = lambda s: s[..., 0] ** 2 / (s[..., 1] + spec.l2)
        gain = worth(left) + worth(right) - worth(whole)
        gain[(left[..., 2] < spec.least) | (right[..., 2] < spec.least)] = 0.0
        rng = np.random.default_rng((spec.seed, tree, key[0].as_py()))
        gain[:, rng.permutation(width)[max(1, round(spec.columns * width)) :]] = 0.0
        flat = gain.reshape(len(gain), -1)
        at = flat.argmax(axis=1)
        node, f, b = np.arange(len(at)), at // spec.bins, at % spec.bins
        won = flat[node, at] > 1e-12
        value = lambda s: -spec.rate * s[..., 0] / (s[..., 1] + spec.l2)
        low = np.where(won, value(left[node, f, b]), value(whole[node, 0, 0]))
        out = (np.full(len(at), key[0].as_py()), node, np.where(won, columns[f], 0), np.where(won, b, 255))
        return pa.table([*[pa.array(x, pa.int32()) for x in out], pa.array(flat[node, at]), pa.array(low), pa.array(value(right[node, f, b]))], names=[c.split()[0] for c in SPLIT_SCHEMA.split(", ")])

    return blocks.mapInArrow(count, "model int, sums binary").groupBy("model").applyInArrow(best, SPLIT_SCHEMA).collect()


def fit(data: DataFrame, spec: Boosted, models: list[int], only: dict[int, tuple[int, ...]] | None = None) -> Forest:
    """Models numbered ``models``; a row teaches those in its array column ``member``.

    ``only`` names for a model the places in ``spec.features`` of those it may use. Rows that teach a model must know
    its features and the label; a null weight counts as 0. Models without two labels (or, for an
    order, without rows) are left out. Results do not depend on how rows are dealt to tasks.
    """
    quantiles = F.array(*[F.lit(k / spec.bins) for k in range(1, spec.bins)])
    got = data.agg(*[F.percentile_approx(F.col(f).cast("double"), quantiles, F.lit(10_000)) for f in spec.features]).first()
    edges = [np.unique(np.array(e if e else [0.0])) for e in got]
    weight = F.coalesce(F.col(spec.weight), F.lit(0.0)) if spec.weight else F.lit(1.0)
    per = data.select(F.explode("member").alias("m"), F.col(spec.label).cast("double").alias("y"), weight.alias("w")).groupBy("m")
    base = {r["m"]: r for r in per.agg((F.sum(F.col("y") * F.col("w")) / F.nullif(F.sum("w"), F.lit(0.0))).alias("mean"), F.count_distinct("y").alias("kinds")).collect()}
    known = [m for m in models if m in base and (spec.group or (base[m]["kinds"] >= 2 and 0 < (base[m]["mean"] or 0) < 1))]
    odds = np.array([0.0 if spec.group else np.log(base[m]["mean"] / (1 - base[m]["mean"])) for m in known])
    forest = Forest(spec, edges, known, odds, only or {})
    if not known:
        return forest
    blocks = _blocks(data, spec, forest)
    for tree in range(spec.trees):
        for depth in range(spec.depth):
            first = (1 << depth) - 1
            for r in _level(blocks, forest, tree, depth):
                at = first + r["node"]
                forest.feature[r["model"], tree, at], forest.bin[r["model"], tree, at] = r["feature"], r["bin"]
                forest.gain[r["model"], r["feature"]] += r["gain"]
                if depth == spec.depth - 1:
                    forest.value[r["model"], tree, 2 * r["node"] : 2 * r["node"] + 2] = r["left"], r["right"]
        forest.done = tree + 1
    return forest


def scored(forest: Forest, rows: DataFrame, model: str = "split_id", name: str = "score") -> DataFrame:
    """``rows`` with what the model named in column ``model`` says of each; rows of models that were left out go."""
    if not forest.models:
        return rows.withColumn(name, F.lit(None).cast("double")).where("false")
    spec, shared = forest.spec, rows.sparkSession.sparkContext.broadcast(forest)

    def score(number: pd.Series, *columns: pd.Series) -> pd.Series:
        made = shared.value
        slot = {m: i for i, m in enumerate(made.models)}
        bins = made.binned(np.stack([c.to_numpy(dtype=np.float64) for c in columns], axis=1))
        margin = made.margin(bins, np.arange(len(bins)), number.map(slot).to_numpy(dtype=np.int64))
        return pd.Series(margin if spec.group else 1 / (1 + np.exp(-margin)))

    udf = F.pandas_udf(score, "double")
    return rows.where(F.col(model).isin(forest.models)).withColumn(name, udf(F.col(model), *[F.col(f).cast("double") for f in spec.features]))
