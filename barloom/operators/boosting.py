"""Gradient boosting with the trees of ``pyspark.ml``'s GBTClassifier, grown on binned columns.

Candidate splits, drawn rows, drawn features, gains and leaf values are Spark's own; only where
they are computed differs. Spark adds up a bin a row and feature in every level of every round, on rows
that take about 200 bytes each. Here a row takes about 36 bytes, NumPy adds up two
features at a time, a level is read for the smaller of two siblings only, and a fit of at most
``LOCAL_ROWS`` rows is one task without a job per level.
"""

from __future__ import annotations

import contextlib
import os
import pickle
import shutil
import tempfile
import uuid
from array import array
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from py4j.java_gateway import JavaObject
from pyspark import RDD, SparkContext, StorageLevel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.serializers import BatchedSerializer, CPickleSerializer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOCAL_ROWS = 2_000_000  # a fit of so many rows runs in one task: the jobs of its levels would take longer than the sums
CHUNK = 65_536
EPSILON = 2.0**-52
MASK = (1 << 64) - 1

# -- random numbers as Spark draws them ------------------------------------------------


def signed(x: int, bits: int) -> int:
    x &= (1 << bits) - 1
    return x - (1 << bits) if x >> (bits - 1) else x


def _murmur(data: bytes, h: int) -> int:
    """MurmurHash3 of whole 4-byte blocks, as scala.util.hashing has it."""
    rotl = lambda x, r: ((x << r) | (x >> (32 - r))) & 0xFFFFFFFF
    for i in range(0, len(data), 4):
        k = rotl(int.from_bytes(data[i : i + 4], "little") * 0xCC9E2D51 & 0xFFFFFFFF, 15) * 0x1B873593 & 0xFFFFFFFF
        h = (rotl(h ^ k, 13) * 5 + 0xE6546B64) & 0xFFFFFFFF
    h ^= len(data)
    h = (h ^ (h >> 16)) * 0x85EBCA6B & 0xFFFFFFFF
    h = (h ^ (h >> 13)) * 0xC2B2AE35 & 0xFFFFFFFF
    return h ^ (h >> 16)


def hash_seed(seed: int) -> int:
    """First state of Spark's XORShiftRandom."""
    data = (seed & MASK).to_bytes(8, "big")
    low = _murmur(data, 0x3C074A61)
    return _murmur(data, low) << 32 | low


def shifted(x):
    """State after ``x``, for a number or, in place, for an array of states."""
    if isinstance(x, np.ndarray):
        x ^= x << np.uint64(21)
        x ^= x >> np.uint64(35)
        x ^= x << np.uint64(4)
        return x
    x = (x ^ x << 21) & MASK
    x ^= x >> 35
    return (x ^ x << 4) & MASK


@lru_cache(64)
def _jumps(steps: int, doublings: int) -> tuple[np.ndarray, ...]:
    """Tables (byte, value) -> state of the linear maps that go ``steps``, 2 ``steps``, 4 ``steps``, ... states on."""
    columns = lambda: np.uint64(1) << np.arange(64, dtype=np.uint64)

    def table(m: np.ndarray) -> np.ndarray:
        t = np.zeros((8, 256), np.uint64)
        for b in range(64):
            at = np.arange(256) >> (b % 8) & 1 == 1
            t[b // 8, at] ^= m[b]
        return t

    once, power = table(shifted(columns())), columns()
    for bit in bin(steps)[2:]:
        power = _jump(table(power), power)
        if bit == "1":
            power = _jump(once, power)
    out = []
    for _ in range(doublings):
        out.append(table(power))
        power = _jump(out[-1], power)
    return tuple(out)


def _jump(table: np.ndarray, states: np.ndarray) -> np.ndarray:
    out = np.zeros_like(states)
    for i in range(8):
        out ^= table[i][(states >> np.uint64(8 * i)) & np.uint64(255)]
    return out


def drawn(seed: int, n: int, share: float) -> np.ndarray:
    """Positions of the rows, of ``n``, that Spark draws without replacement with this seed of a partition.

    The generator is linear, so lanes that start some steps apart go on side by side.
    """
    if share >= 1.0 or n == 0:
        return np.arange(n, dtype=np.int32)
    doublings = max(0, min(12, n.bit_length() // 2 + 1))
    lanes = 1 << doublings
    each = -(-n // lanes)
    states = np.array([hash_seed(seed)], np.uint64)
    for t in _jumps(2 * each, doublings):
        states = np.concatenate([states, _jump(t, states)])
    taken, below = np.empty((each, lanes), bool), np.uint64(int(np.ceil(share * 2.0**53)))
    for i in range(each):
        high = (shifted(states) & np.uint64((1 << 26) - 1)) << np.uint64(27)
        taken[i] = high + (shifted(states) & np.uint64((1 << 27) - 1)) < below
    return np.flatnonzero(taken.T.reshape(-1)[:n]).astype(np.int32)


class JavaRandom:
    def __init__(self, seed: int) -> None:
        self.state = (seed ^ 0x5DEECE66D) & ((1 << 48) - 1)

    def _bits32(self) -> int:
        self.state = (self.state * 0x5DEECE66D + 0xB) & ((1 << 48) - 1)
        return signed(self.state >> 16, 32)

    def next_long(self) -> int:
        return signed((self._bits32() << 32) + self._bits32(), 64)


def reservoir(n: int, k: int, seed: int) -> list[int]:
    """``k`` of the numbers below ``n`` as Spark's reservoir sample leaves them."""
    kept, state = list(range(min(k, n))), hash_seed(seed)
    for item in range(k, n):
        state = shifted(state)
        high = (state & ((1 << 26) - 1)) << 27
        state = shifted(state)
        at = int((high + (state & ((1 << 27) - 1))) * 2.0**-53 * (item + 1))
        if at < k:
            kept[at] = item
    return kept


# -- rows of a task -------------------------------------------------------------------------


@dataclass(frozen=True)
class Plan:
    """Settings of a fit; ``splits`` are the candidate splits of each feature, a column holds the bins of ``joint`` features."""

    rounds: int
    depth: int
    step: float
    row_share: float
    per_node: int
    min_leaf: int
    min_gain: float
    seed: int
    splits: tuple[int, ...]
    joint: int

    @property
    def bits(self) -> int:
        return max(1, max(self.splits, default=0).bit_length())


@dataclass
class Block:
    """Rows of a partition in its order: bins by column, labels as -1 and 1."""

    index: int
    columns: np.ndarray
    label: np.ndarray


@dataclass
class Tree:
    """Splits (feature, bin) and leaf values by node; node k has the children 2 k and 2 k + 1."""

    splits: dict[int, tuple[int, int]] = field(default_factory=dict)
    values: dict[int, float] = field(default_factory=dict)


def packed(bins: np.ndarray, plan: Plan) -> np.ndarray:
    """Columns of bins (feature, row), two features in one where the plan says so."""
    wide = bins.astype(np.uint16)
    if plan.joint == 1:
        return wide
    if len(wide) % 2:
        wide = np.vstack([wide, np.zeros((1, wide.shape[1]), np.uint16)])
    return np.ascontiguousarray(wide[::2] << plan.bits | wide[1::2])


def nodes_of(block: Block, plan: Plan, tree: Tree) -> np.ndarray:
    """The node a row has come to, for every row: whole columns are compared, as few nodes cost less than rows picked node by node."""
    kind = np.uint8 if plan.depth < 8 else np.uint32
    out, low = np.empty(len(block.label), kind), np.uint16((1 << plan.bits) - 1)

    def below(node: int, part: slice) -> np.ndarray | int:
        if node not in tree.splits:
            return kind(node)
        feature, last = tree.splits[node]
        column = block.columns[feature // plan.joint, part]
        if plan.joint == 1:
            right = column > last
        else:
            right = column >= (last + 1 << plan.bits) if feature % 2 == 0 else (column & low) > last
        one, other = below(2 * node, part), below(2 * node + 1, part)
        return one ^ ((one ^ other) & np.negative(right.astype(kind)))  # all bits are set where a row goes right

    for start in range(0, len(out), CHUNK):
        part = slice(start, start + CHUNK)
        out[part] = below(1, part)
    return out


def advanced(block: Block, plan: Plan, total: np.ndarray, tree: Tree, weight: float) -> np.ndarray:
    """Sums of the trees so far with one tree more."""
    values = np.zeros(max(tree.values) + 1)
    for node, value in tree.values.items():
        values[node] = value * weight
    return total + values[nodes_of(block, plan, tree)]


def residuals(block: Block, total: np.ndarray | None, rows: np.ndarray) -> np.ndarray:
    """What a round is fitted to: the labels first, then the negative gradient of the logistic loss."""
    label = block.label.take(rows).astype(float)
    if total is None:
        return label
    with np.errstate(over="ignore"):
        return 4.0 * label / (1.0 + np.exp(2.0 * label * total.take(rows)))


def sums(block: Block, plan: Plan, total: np.ndarray | None, rows: np.ndarray) -> np.ndarray:
    """(count, sum, sum of squares) by feature and bin of the residuals of ``rows``.

    With a feature a column every sum runs in the order of the rows, as Spark's does in a partition.
    """
    out = np.zeros((3, len(block.columns), 1 << plan.bits * plan.joint))
    every = CHUNK if plan.joint > 1 else max(1, len(rows))
    for start in range(0, len(rows), every):
        some = rows[start : start + every]
        x = residuals(block, total, some)
        xx = x * x
        for c, column in enumerate(block.columns):
            key = column.take(some).astype(np.intp)
            for k, w in enumerate((None, x, xx)):
                out[k, c] += np.bincount(key, w, out.shape[2])
    if plan.joint > 1:
        both = out.reshape(3, len(block.columns), 1 << plan.bits, 1 << plan.bits)
        out = np.stack([both.sum(3), both.sum(2)], 2).reshape(3, -1, 1 << plan.bits)
    return out[:, : len(plan.splits)]


def drawn_rows(block: Block, plan: Plan, number: int) -> np.ndarray:
    return drawn(plan.seed + number + block.index + 1, len(block.label), plan.row_share)


def opened(block: Block, plan: Plan, number: int, total: np.ndarray | None, last: Tree | None) -> tuple[np.ndarray | None, np.ndarray, np.ndarray]:
    """Begins a round: (sums of trees with the last one, drawn rows, sums of the root)."""
    if last is not None:
        total = advanced(block, plan, np.zeros(len(block.label)) if total is None else total, last, 1.0 if number == 1 else plan.step)
    rows = drawn_rows(block, plan, number)
    return total, rows, sums(block, plan, total, rows)


def level_sums(block: Block, plan: Plan, total: np.ndarray | None, rows: np.ndarray, tree: Tree, nodes: list[int]) -> np.ndarray:
    """Sums of ``nodes``, in their order."""
    at = nodes_of(block, plan, tree).take(rows)
    return np.stack([sums(block, plan, total, rows[at == node]) for node in nodes])


class Local:
    """Rounds over blocks that one task holds."""

    def __init__(self, blocks: list[Block], plan: Plan) -> None:
        self.blocks, self.plan = blocks, plan
        self.states: list[tuple] = [(None, None)] * len(blocks)

    def begin(self, number: int, last: Tree | None) -> np.ndarray:
        done = [opened(b, self.plan, number, s[0], last) for b, s in zip(self.blocks, self.states)]
        self.states = [d[:2] for d in done]
        return sum(d[2] for d in done)

    def level(self, tree: Tree, nodes: list[int]) -> np.ndarray:
        return sum(level_sums(b, self.plan, *s, tree, nodes) for b, s in zip(self.blocks, self.states))


@dataclass(frozen=True)
class Shelf:
    """Arrays of a fit in the folder for local data of the executor a task runs in, which goes with the executor; None where it has none."""

    fit: str

    def folder(self) -> str:
        return os.path.join(os.environ.get("SPARK_LOCAL_DIRS", tempfile.gettempdir()).split(",")[0], "python", self.fit)

    def put(self, name: str, values: np.ndarray) -> None:
        os.makedirs(self.folder(), exist_ok=True)
        handle, part = tempfile.mkstemp(dir=self.folder())
        with os.fdopen(handle, "wb") as f:
            np.save(f, values)
        os.replace(part, os.path.join(self.folder(), name))

    def get(self, name: str) -> np.ndarray | None:
        try:
            found = np.load(os.path.join(self.folder(), name), mmap_mode="r" if name.endswith("columns") else None)
        except FileNotFoundError:
            return None
        return np.asarray(found)

    def drop(self, name: str) -> None:
        with contextlib.suppress(FileNotFoundError):
            os.remove(os.path.join(self.folder(), name))

    def put_block(self, block: Block) -> int:
        self.put(f"{block.index}.columns", block.columns)
        self.put(f"{block.index}.label", block.label)
        return block.index

    def block(self, index: int) -> Block | None:
        columns, label = self.get(f"{index}.columns"), self.get(f"{index}.label")
        return None if columns is None or label is None else Block(index, columns, label)

    def put_state(self, index: int, number: int, total: np.ndarray | None, rows: np.ndarray) -> None:
        if total is not None:
            self.put(f"{index}.{number}.total", total)
        self.put(f"{index}.{number}.rows", rows)
        for name in ("total", "rows"):
            self.drop(f"{index}.{number - 2}.{name}")

    def state(self, index: int, number: int) -> tuple[np.ndarray | None, np.ndarray] | None:
        total, rows = self.get(f"{index}.{number}.total"), self.get(f"{index}.{number}.rows")
        return None if rows is None or (number and total is None) else (total, rows)

    def clear(self) -> None:
        shutil.rmtree(self.folder(), ignore_errors=True)


class Spread:
    """Rounds over an RDD of blocks, a job a level.

    Blocks, the drawn rows of a round and the sums of the trees so far stay on a shelf where they are used:
    to send them from Spark to Python in each job would take longer than to add them up. What a
    task does not find there (another executor, a lost one) is made anew from the stored blocks and all trees.
    """

    def __init__(self, blocks: RDD, plan: Plan) -> None:
        self.sc, self.plan, self.shelf = blocks.context, plan, Shelf(f"boosting-{uuid.uuid4().hex}")
        self.blocks, shelf = stored(blocks), self.shelf
        self.parts, self.trees = self.blocks.getNumPartitions(), []
        self.homes = self.blocks.coalesce(self.sc.defaultParallelism).map(shelf.put_block).persist(StorageLevel.MEMORY_AND_DISK)

    def begin(self, number: int, last: Tree | None) -> np.ndarray:
        plan, shelf = self.plan, self.shelf
        self.trees += [] if last is None else [last]

        def run(index: int) -> np.ndarray | None:
            block, before = shelf.block(index), shelf.state(index, number - 1) if number else (None, None)
            if block is None or before is None:
                return None
            total, rows, found = opened(block, plan, number, before[0], last)
            shelf.put_state(index, number, total, rows)
            return found

        return self._summed(run, lambda block, total, rows: sums(block, plan, total, rows))

    def level(self, tree: Tree, nodes: list[int]) -> np.ndarray:
        plan, shelf, number = self.plan, self.shelf, len(self.trees)

        def run(index: int) -> np.ndarray | None:
            block, state = shelf.block(index), shelf.state(index, number)
            return None if block is None or state is None else level_sums(block, plan, *state, tree, nodes)

        return self._summed(run, lambda block, total, rows: level_sums(block, plan, total, rows, tree, nodes))

    def close(self) -> None:
        shelf = self.shelf
        self.homes.foreach(lambda _: shelf.clear())
        self.homes.unpersist()
        self.blocks.unpersist()

    def _summed(self, run: Callable[[int], np.ndarray | None], anew: Callable[..., np.ndarray]) -> np.ndarray:
        """Sums over all blocks in their order: by ``run`` where their arrays are, else by ``anew`` from stored blocks."""
        found = {index: part for index, part in self.homes.map(lambda index: (index, run(index))).collect() if part is not None}
        missing = [index for index in range(self.parts) if index not in found]
        if missing:
            plan, shelf, trees = self.plan, self.shelf, self.trees

            def made(blocks: Iterator[Block]) -> Iterator[tuple[int, np.ndarray]]:
                for block in blocks:
                    total, rows = restored(block, plan, trees)
                    shelf.put_block(block)
                    shelf.put_state(block.index, len(trees), total, rows)
                    yield block.index, anew(block, total, rows)

            found |= dict(self.sc.runJob(self.blocks, made, missing))
        return sum(found[index] for index in range(self.parts))


def restored(block: Block, plan: Plan, trees: list[Tree]) -> tuple[np.ndarray | None, np.ndarray]:
    """(sums of trees, drawn rows) of the round after ``trees``."""
    total = np.zeros(len(block.label)) if trees else None
    for k, tree in enumerate(trees):
        total = advanced(block, plan, total, tree, plan.step if k else 1.0)
    return total, drawn_rows(block, plan, len(trees))


def stored(rows: RDD) -> RDD:
    """One record of arrays a partition, on disk."""
    return rows._reserialize(BatchedSerializer(CPickleSerializer(), 1)).persist(StorageLevel.DISK_ONLY)


# -- growing -------------------------------------------------------------------------------------


@dataclass
class Node:
    """What the model keeps of a node: its (count, sum, sum of squares), impurity, and its split's gain."""

    stats: np.ndarray
    impurity: float
    gain: float = 0.0
    split: tuple[int, int] | None = None

    @property
    def value(self) -> float:
        return float(self.stats[1] / self.stats[0]) if self.stats[0] else 0.0


def impurity(stats: np.ndarray) -> np.ndarray:
    count, total, squares = stats
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(count == 0, 0.0, (squares - total * total / count) / count)


def best_split(found: np.ndarray, plan: Plan, features: list[int], node: Node | None) -> tuple[Node, tuple[np.ndarray, np.ndarray] | None]:
    """The node with its best split, and the sums of both children; no children where it stays a leaf. The first of equal gains wins."""
    features = [f for f in features if plan.splits[f]]
    if not features:
        node = node or Node(found[:, 0].sum(1), 0.0)
        return Node(node.stats, -1.0), None
    below = found[:, features].cumsum(2)
    last = np.array([plan.splits[f] for f in features])
    whole = below[:, np.arange(len(features)), last][:, :, None]
    left = below[:, :, :-1]
    right = whole - left
    if node is None:
        first = left[:, 0, 0] + right[:, 0, 0]
        node = Node(first, float(impurity(first)))
    n = left[0] + right[0]
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = node.impurity - left[0] / n * impurity(left) - right[0] / n * impurity(right)
        possible = (np.arange(left.shape[2]) < last[:, None]) & (left[0] >= plan.min_leaf) & (right[0] >= plan.min_leaf) & (gain >= plan.min_gain)
    gain = np.where(possible, gain, -np.inf)
    f, b = np.unravel_index(int(np.argmax(gain)), gain.shape)
    if not gain[f, b] > 0:
        return Node(node.stats, node.impurity if possible[f, b] else -1.0), None
    return Node(node.stats, node.impurity, float(gain[f, b]), (features[f], int(b))), (left[:, f, b], right[:, f, b])


def grown(source: Local | Spread, plan: Plan, number: int, last: Tree | None) -> tuple[dict[int, Node], Tree]:
    """One tree, level by level; nodes are visited in the order in which Spark takes them from its stack."""
    rng, nodes, tree = JavaRandom(plan.seed + number), {}, Tree()
    found, order = {1: source.begin(number, last)}, [1]
    for level in range(plan.depth):
        picked = [reservoir(len(plan.splits), plan.per_node, rng.next_long()) if plan.per_node < len(plan.splits) else list(range(len(plan.splits))) for _ in order]
        ahead: list[int] = []
        for at, features in zip(order, picked):
            nodes[at], children = best_split(found[at], plan, features, nodes.get(at))
            if children is None:
                continue
            tree.splits[at] = nodes[at].split
            for child, stats in zip((2 * at, 2 * at + 1), children):
                nodes[child] = Node(stats, float(impurity(stats)))
                if level + 1 < plan.depth and abs(nodes[child].impurity) >= EPSILON:
                    ahead.insert(0, child)
        if not ahead:
            break
        order, found = ahead, level_found(source, plan, tree, nodes, ahead, found)
    tree.values = {at: node.value for at, node in nodes.items() if node.split is None}
    return nodes, tree


def level_found(source: Local | Spread, plan: Plan, tree: Tree, nodes: dict[int, Node], order: list[int], above: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """Sums of the nodes of a level; of two siblings the larger one is what the smaller one leaves of their parent.

    With a feature a column both are read, so that sums are rounded as Spark's.
    """
    spared = {max(at, at ^ 1, key=lambda k: (nodes[k].stats[0], k)) for at in order if at ^ 1 in order} if plan.joint > 1 else set()
    read = [at for at in order if at not in spared]
    found = dict(zip(read, source.level(tree, read)))
    return found | {at: above[at // 2] - found[at ^ 1] for at in spared}


def boosted(source: Local | Spread, plan: Plan) -> list[dict[int, Node]]:
    """The nodes of the trees of all rounds."""
    out, last = [], None
    for number in range(plan.rounds):
        nodes, last = grown(source, plan, number, last)
        out.append(nodes)
    return out


# -- estimator -----------------------------------------------------------------------------------


def binned(thresholds: list[np.ndarray], plan: Plan) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Arrow batches of (features, label) -> one row a batch: packed columns, labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(n, len(thresholds))
            bins = np.stack([np.searchsorted(t, x[:, f]) for f, t in enumerate(thresholds)])
            label = (batch.column(1).to_numpy(zero_copy_only=False) * 2 - 1).astype(np.int8)
            yield pa.RecordBatch.from_arrays([pa.array([packed(bins, plan).tobytes()], pa.binary()), pa.array([label.tobytes()], pa.binary())], ["columns", "label"])

    return run


def block(index: int, parts: Iterable[tuple[bytes, bytes]], plan: Plan) -> Block:
    wide = -(-len(plan.splits) // plan.joint)
    columns, label = [np.empty((wide, 0), np.uint16)], [np.empty(0, np.int8)]
    for c, y in parts:
        columns.append(np.frombuffer(c, np.uint16).reshape(wide, -1))
        label.append(np.frombuffer(y, np.int8))
    return Block(index, np.concatenate(columns, 1), np.concatenate(label))


class Booster(GBTClassifier):
    """GBTClassifier whose rounds run here; the model is Spark's, with the same trees.

    Sums are rounded as Spark's where the rows are one partition; of several, Spark adds the parts
    in order of arrival, here it is the order of partitions. Weights, categorical features and a validation column are not supported.
    """

    def _fit_java(self, dataset: DataFrame) -> JavaObject:
        if self.isDefined("weightCol") or self.isDefined("validationIndicatorCol"):
            raise ValueError("rows have no weights and no validation column")
        self._transfer_params_to_java()
        sc, java = SparkContext._active_spark_context, self._java_obj
        ml = sc._jvm.org.apache.spark.ml
        module = lambda package, name: getattr(getattr(package, f"{name}$"), "MODULE$")
        instances = module(ml.util, "DatasetUtils").extractInstances(java, dataset._jdf, sc._jvm.scala.Some(2))
        mllib = sc._jvm.org.apache.spark.mllib.tree
        strategy = java.getOldBoostingStrategy(sc._jvm.PythonUtils.toScalaMap({}), mllib.configuration.Algo.Classification()).treeStrategy().copy()
        strategy.setAlgo(mllib.configuration.Algo.Regression())
        strategy.setImpurity(module(mllib.impurity, "Variance"))
        metadata = ml.tree.impl.DecisionTreeMetadata.buildMetadata(instances, strategy, 1, self.getFeatureSubsetStrategy())
        seed, parts = self.getSeed(), instances.getNumPartitions()
        splits = [list(s) for s in module(ml.tree.impl, "RandomForest").findSplits(instances, metadata, seed)]
        plan = Plan(
            self.getMaxIter(), self.getMaxDepth(), self.getStepSize(), self.getSubsamplingRate(), metadata.numFeaturesPerNode(),
            self.getMinInstancesPerNode(), self.getMinInfoGain(), seed, tuple(map(len, splits)), 1 if parts == 1 or max(map(len, splits), default=0) > 255 else 2,
        )
        thresholds = [np.array([s.threshold() for s in f]) for f in splits]
        rows = dataset.select(vector_to_array(self.getFeaturesCol()).alias("x"), F.col(self.getLabelCol()).cast("double").alias("y"))
        blocks = rows.mapInArrow(binned(thresholds, plan), "columns binary, label binary").rdd.mapPartitionsWithIndex(lambda i, r: [block(i, r, plan)])
        if metadata.numExamples() <= LOCAL_ROWS:
            near = stored(blocks)
            try:
                near.count()
                trees = near.coalesce(1).mapPartitions(lambda b: boosted(Local(sorted(b, key=lambda x: x.index), plan), plan)).collect()
            finally:
                near.unpersist()
        else:
            source = Spread(blocks, plan)
            try:
                trees = boosted(source, plan)
            finally:
                source.close()
        return java_model(sc, java.uid(), trees, plan, splits)


def java_model(sc: SparkContext, uid: str, trees: list[dict[int, Node]], plan: Plan, splits: list[list[JavaObject]]) -> JavaObject:
    """Spark's model of these trees; as there, leaves of equal value become one."""
    ml, gateway = sc._jvm.org.apache.spark.ml, sc._gateway
    inner, leaf, tree, calculator = ml.tree.InternalNode, ml.tree.LeafNode, ml.regression.DecisionTreeRegressionModel, sc._jvm.org.apache.spark.mllib.tree.impurity.VarianceCalculator
    # all arrays cross to the JVM at once: a call takes longer than a node
    order = [(k, at) for k, nodes in enumerate(trees) for at in nodes]
    place = {key: i for i, key in enumerate(order)}
    values = sc._jvm.org.apache.spark.mllib.api.python.SerDe.loads(bytearray(pickle.dumps([array("d", trees[k][at].stats) for k, at in order], 2)))

    def built(k: int, at: int) -> tuple[JavaObject, float | None]:
        node, stats = trees[k][at], calculator(values.get(place[k, at]), int(trees[k][at].stats[0]))
        if node.split is None:
            return leaf(node.value, node.impurity, stats), node.value
        (left, a), (right, b) = built(k, 2 * at), built(k, 2 * at + 1)
        if a is not None and a == b:
            return leaf(a, node.impurity, stats), a
        feature, last = node.split
        return inner(node.value, node.impurity, node.gain, left, right, splits[feature][last], stats), None

    models, weights = gateway.new_array(tree, len(trees)), gateway.new_array(gateway.jvm.double, len(trees))
    for k in range(len(trees)):
        models[k] = tree(built(k, 1)[0], len(splits))
        weights[k] = plan.step if k else 1.0
    return ml.classification.GBTClassificationModel(uid, models, weights, len(splits), 2)
