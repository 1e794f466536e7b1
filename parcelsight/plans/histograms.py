"""Trees on packed rows, for more rows than a learner keeps as objects: boosting and forests.

Spark's own learners keep each row with an integer for every slot of its feature vector, several hundred bytes, and pass
over them once for each level. Here numeric slots are bytes by their thresholds, the one-hot slots of a category together one
byte by their number, and several such columns one code of two bytes with the row's class. A task counts rows and targets by
node and code in numpy, both in one sum; Spark adds the counts up. Targets are whole numbers of parts, so that sums are
exact and do not depend on the order or number of tasks. Splits, gains and leaves are those of Spark's trees on the same thresholds.

In a boosting only the sums of nodes, bounded by nodes and thresholds, reach the driver, and of two sibling nodes the smaller is
counted, the other is the rest of their parent. Of a forest many trees are counted in one pass, and the best split of a node is
found by the task that adds it up.
"""

from __future__ import annotations

import json
import math
import sys
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel, TaskContext, cloudpickle
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from parcelsight.plans.boosting import GRID, Boosting, Loss
from parcelsight.sources.sinks import release, staging_root

#: Bins of a numeric slot, and about as many training rows as its thresholds are chosen from (Spark's learner takes 10,000).
BINS, SAMPLE = 32, 30_000
#: Codes that columns share, without the classes.
CODES = 4096
#: Rows of a packed block, most rows that lie together, and most rows of a task.
BLOCK_ROWS, PART_ROWS, TASK_ROWS = 32_768, 500_000, 2_000_000
#: A sum holds the rows above 2^SHIFT and the targets, of PARTS bits at most, below; so many rows fit in one.
PARTS, SHIFT, SUM_ROWS = 24, 39, 2 ** 14 - 1
#: Rounds between two looks at the validation loss, and between two stagings of the margin.
LOOK_ROUNDS, STAGE_ROUNDS = 5, 20
#: Trees of a forest that one pass counts.
FOREST_TREES = 100

# executors need not have this package: what tasks call goes with them
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass(frozen=True)
class Columns:
    """The slots of each packed column and its thresholds; a column without thresholds holds one-hot slots."""

    slots: list[np.ndarray]
    limits: list[np.ndarray | None]

    def __post_init__(self):
        widths = [len(s if t is None else t) + 1 for s, t in zip(self.slots, self.limits)]
        bundles, sizes, place = [], [], {}
        for c in sorted(range(len(widths)), key=lambda c: -widths[c]):
            b = next((i for i, n in enumerate(sizes) if n * widths[c] <= CODES), len(sizes))
            if b == len(sizes):
                bundles.append([])
                sizes.append(1)
            place[c] = b, sizes[b]
            bundles[b].append(c)
            sizes[b] *= widths[c]
        for name, value in (("widths", widths), ("bundles", bundles), ("sizes", sizes), ("place", place),
                            ("starts", np.concatenate([[0], np.cumsum(widths)]).astype(np.int64))):
            object.__setattr__(self, name, value)

    @property
    def n_slots(self) -> int:
        return sum(map(len, self.slots))

    def codes(self, x: np.ndarray, kind: np.ndarray, kinds: int) -> np.ndarray:
        """The codes of feature vectors and their classes, a row of the result for each bundle."""
        out = np.zeros((len(self.bundles), len(x)), np.int64)
        for c, (slots, limits) in enumerate(zip(self.slots, self.limits)):
            if limits is not None:
                cell = np.searchsorted(limits, x[:, slots[0]])  # a value at a threshold is left of it
            else:
                hot = x[:, slots] > 0.5
                if (hot.sum(1) > 1).any():
                    raise ValueError("a row has two codes of one category")
                cell = np.where(hot.any(1), hot.argmax(1), len(slots))
            b, stride = self.place[c]
            out[b] += cell * stride
        return (out * kinds + kind).astype(np.uint16)

    def right(self, column: int, byte: int, hot: bool, kinds: int) -> tuple[int, np.ndarray]:
        """Of a split its bundle, and for each of its codes whether it goes right."""
        b, stride = self.place[column]
        cell = np.arange(self.sizes[b]) // stride % self.widths[column]
        return b, np.repeat(cell == byte if hot else cell > byte, kinds)

    def by_column(self, bundle: int, counts: np.ndarray, kinds: int, out: np.ndarray) -> None:
        """Adds counts (node, code) to ``out`` (node, class, cell of every column)."""
        columns = self.bundles[bundle][::-1]  # the last one has the largest stride
        cube = counts.reshape(len(counts), *(self.widths[c] for c in columns), kinds)
        for i, c in enumerate(columns):
            others = tuple(1 + j for j in range(len(columns)) if j != i)
            out[:, :, self.starts[c]:self.starts[c + 1]] += cube.sum(others).transpose(0, 2, 1)

    def candidates(self) -> dict[str, np.ndarray]:
        """Every split by slot and threshold: its column, byte, kind and threshold."""
        rows = []
        for c, (slots, limits) in enumerate(zip(self.slots, self.limits)):
            rows += [(s, c, b, True, 0.5) for b, s in enumerate(slots)] if limits is None else [
                (slots[0], c, b, False, t) for b, t in enumerate(limits)]
        rows.sort(key=lambda r: (r[0], r[2]))
        names, kinds = ("slot", "column", "byte", "hot", "limit"), (int, int, int, bool, float)
        return {n: np.array([r[i] for r in rows], k) for i, (n, k) in enumerate(zip(names, kinds))}


def _hot_groups(frame: DataFrame) -> list[list[int]]:
    """Slots that the coding of a category made, by the vector's metadata; of these at most one is set."""
    groups: dict[str, list[int]] = {}
    attrs = frame.schema["features"].metadata.get("ml_attr", {}).get("attrs", {})
    for a in sorted((a for group in attrs.values() for a in group), key=lambda a: a["idx"]):
        if "__code_" in a.get("name", ""):
            groups.setdefault(a["name"].split("__code_")[0], []).append(a["idx"])
    return [g[i:i + 255] for g in groups.values() for i in range(0, len(g), 255)]


def _thresholds(values: np.ndarray) -> np.ndarray:
    """Middles between neighbouring values: all of them, or those next to equally many rows."""
    known = np.unique(values)
    if len(known) > BINS:
        ranks = np.sort(values)[np.arange(1, BINS) * len(values) // BINS]
        at = np.unique(np.searchsorted(known, ranks))
        at = at[at < len(known) - 1]
    else:
        at = np.arange(len(known) - 1)
    return (known[at] + known[at + 1]) / 2


def fit_columns(train: DataFrame, rows: int, seed: int) -> Columns:
    vectors = train.select(vector_to_array("features").alias("x"))
    drawn = vectors if rows <= SAMPLE else vectors.sample(SAMPLE / rows, seed)
    x = _matrix(drawn.toArrow()["x"].combine_chunks())
    hot = _hot_groups(train)
    coded = {s for g in hot for s in g}
    single = [s for s in range(x.shape[1]) if s not in coded]
    return Columns([np.array(g) for g in [[s] for s in single] + hot],
                   [_thresholds(x[:, s]) for s in single] + [None] * len(hot))


def _matrix(lists) -> np.ndarray:
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.chunk(0)
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


# --- rows --------------------------------------------------------------------------------

#: Rows that lie together: a number, codes by bundle, target (None where the codes hold the class), and the margin of a
#: boosting. Plain, as any task has to read it.
Rows = tuple[int, np.ndarray, np.ndarray | None, np.ndarray | None]
#: Kept as they are sent to Python, not written into bytes once more.
KEPT = StorageLevel.MEMORY_AND_DISK_DESER


def _target(rows: Rows, kinds: int) -> np.ndarray:
    _, codes, y, _ = rows
    return codes[0] % np.uint16(kinds) if y is None else y


def _packing(columns: Columns, kinds: int) -> Callable:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, targets, held, made = [], [], 0, TaskContext.get().partitionId() << 32

        def block() -> pa.RecordBatch:
            parts = [np.concatenate(codes, 1).tobytes()], [np.concatenate(targets).tobytes()]
            return pa.RecordBatch.from_arrays(
                [pa.array([made]), *(pa.array(p, pa.binary()) for p in parts)], ["number", "codes", "y"])

        for batch in batches:
            if not batch.num_rows:
                continue
            y = batch.column(1).to_numpy(zero_copy_only=False).astype(np.float64)
            codes.append(columns.codes(_matrix(batch.column(0)), y.astype(np.int64) if kinds > 1 else 0, kinds))
            targets.append(y)
            held += batch.num_rows
            if held >= BLOCK_ROWS:
                yield block()
                codes, targets, held, made = [], [], 0, made + 1
        if held:
            yield block()

    return pack


def _gathering(bundles: int, kinds: int, start: float | None) -> Callable:
    """Blocks in the order of their numbers, some of them together."""
    def gather(blocks: Iterator) -> Iterator[Rows]:
        found, at = sorted(((r[0], bytes(r[1]), bytes(r[2])) for r in blocks), key=lambda r: r[0]), 0
        while at < len(found):
            first, n = at, 0
            while at < len(found) and (n == 0 or n + len(found[at][2]) // 8 <= PART_ROWS):
                n, at = n + len(found[at][2]) // 8, at + 1
            y = np.concatenate([np.frombuffer(r[2]) for r in found[first:at]]) if kinds == 1 else None
            codes = np.concatenate([np.frombuffer(r[1], np.uint16).reshape(bundles, -1) for r in found[first:at]], 1)
            yield found[first][0], codes, y, None if start is None else np.full(n, start)

    return gather


def packed_rows(frame: DataFrame, target: Column, columns: Columns, kinds: int, rows: int, start: float | None = None) -> RDD:
    """The rows of (features, target), packed and dealt to a task for each core, or more tasks where they are many."""
    cores = frame.sparkSession.sparkContext.defaultParallelism
    tasks = cores * max(1, -(-rows // (cores * TASK_ROWS)))
    blocks = frame.select(vector_to_array("features").alias("x"), target.cast("double").alias("y")).mapInArrow(
        _packing(columns, kinds), "number long, codes binary, y binary").repartition(tasks)
    return blocks.rdd.mapPartitions(_gathering(len(columns.bundles), kinds, start))


# --- trees -------------------------------------------------------------------------------

class Tree:
    """A tree over packed columns, node 1 its root and 2i, 2i + 1 the children of node i; filled level by level."""

    def __init__(self, depth: int, kinds: int):
        size = 2 ** (depth + 1)
        self.depth, self.kinds, self.inner = depth, kinds, np.zeros(size, bool)
        self.column, self.byte, self.hot = np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(size, bool)
        self.slot, self.limit, self.gain = np.zeros(size, np.int64), np.zeros(size), np.zeros(size)
        self.rows, self.weight, self.sums = np.zeros(size, np.int64), np.zeros(size), None
        self.value = np.zeros(size)

    def set(self, node: int, found: dict) -> None:
        """A split, and what it says of the children."""
        self.inner[node] = True
        for name in ("column", "byte", "hot", "slot", "limit", "gain"):
            getattr(self, name)[node] = found[name]
        for child, (rows, weight, sums) in zip((2 * node, 2 * node + 1), found["sides"]):
            self.set_sums(child, rows, weight, sums)

    def set_sums(self, node: int, rows: float, weight: float, sums: np.ndarray) -> None:
        if self.sums is None:
            self.sums = np.zeros((len(self.inner), len(sums)))
        self.rows[node], self.weight[node], self.sums[node] = round(rows), weight, sums
        self.value[node] = (sums[0] / weight if weight else 0.0) if len(sums) == 1 else int(np.argmax(sums))

    def leaves(self) -> list[int]:
        """The leaves from left to right, as Spark numbers them."""
        def below(node: int) -> list[int]:
            return below(2 * node) + below(2 * node + 1) if self.inner[node] else [node]

        return below(1)

    def reach(self, codes: np.ndarray, columns: Columns, wanted: Sequence[int], start: np.ndarray | None = None) -> dict:
        """For each wanted node the places of its rows; ``start`` are the places at the root, all of them if None."""
        above = {node >> k for node in wanted for k in range(node.bit_length())}
        out, todo = {}, [(1, start)] if wanted else []
        known = set(wanted)
        while todo:
            node, at = todo.pop()
            if node in known:
                out[node] = np.arange(codes.shape[1]) if at is None else at
            children = [c for c in (2 * node, 2 * node + 1) if c in above]
            if children:
                b, table = columns.right(self.column[node], self.byte[node], self.hot[node], self.kinds)
                right = table[codes[b] if at is None else codes[b][at]]
                for child in children:
                    side = right if child % 2 else ~right
                    todo.append((child, np.flatnonzero(side) if at is None else at[side]))
        return out

    def add_to(self, margin: np.ndarray, codes: np.ndarray, columns: Columns, weight: float) -> np.ndarray:
        """The margin and what this tree adds to it."""
        step = np.empty(len(margin))
        for node, at in self.reach(codes, columns, self.leaves()).items():
            step[at] = weight * self.value[node]
        return margin + step

    def nodes(self, number: int) -> list[tuple]:
        """The nodes as Spark saves them, numbered from the root downwards, left first."""
        out = []

        def add(node: int) -> int:
            at = len(out)
            out.append(None)
            weight, sums = float(self.weight[node]), self.sums[node]
            if len(sums) == 1:
                stats, impurity = [weight, float(sums[0]), float(sums[0] ** 2 / weight) if weight else 0.0], 0.0
            else:
                stats, impurity = [float(s) for s in sums], float(1 - (sums ** 2).sum() / weight ** 2) if weight else 0.0
            left = right = -1
            split = (-1, [], -1)
            if self.inner[node]:
                left, right = add(2 * node), add(2 * node + 1)
                split = (int(self.slot[node]), [float(self.limit[node])], -1)
            out[at] = (number, (at, float(self.value[node]), impurity, stats, int(self.rows[node]),
                                float(self.gain[node]) if self.inner[node] else -1.0, left, right, split))
            return at

        add(1)
        return out


NODES = ("treeID int, nodeData struct<id: int, prediction: double, impurity: double, impurityStats: array<double>, rawCount: long, "
         "gain: double, leftChild: int, rightChild: int, split: struct<featureIndex: int, leftCategoriesOrThreshold: "
         "array<double>, numCategories: int>>")


def spark_forest(spark: SparkSession, trees: Sequence[Tree], slots: int, estimator=None):
    """The trees as Spark's own model with the estimator's settings, by the files that Spark saves a model as."""
    kind = "Regression" if len(trees[0].sums[1]) == 1 else "Classification"
    package = f"org.apache.spark.ml.{kind.lower()}"
    extra = {"numFeatures": slots} | ({"numClasses": len(trees[0].sums[1])} if kind == "Classification" else {})

    def metadata(name: str, params: dict, **more) -> str:
        return json.dumps({"class": f"{package}.{name}", "timestamp": 0, "sparkVersion": spark.version,
                           "uid": f"{name}_{uuid.uuid4().hex[:12]}", "defaultParamMap": {},
                           "paramMap": params | {"impurity": "variance" if kind == "Regression" else "gini"}} | more)

    path = f"{staging_root(spark)}/parcelsight/trees-{uuid.uuid4().hex}"
    spark.createDataFrame([(metadata(f"RandomForest{kind}Model", {"numTrees": len(trees)}, numTrees=len(trees), **extra),)],
                          "value string").coalesce(1).write.text(f"{path}/metadata")
    each = [(i, metadata(f"DecisionTree{kind}Model", {}, **extra), 1.0) for i in range(len(trees))]
    spark.createDataFrame(each, "_1 int, _2 string, _3 double").write.parquet(f"{path}/treesMetadata")
    made = spark.sparkContext.parallelize(range(len(trees)), min(len(trees), 64)).flatMap(lambda i: trees[i].nodes(i))
    spark.createDataFrame(made, NODES, verifySchema=False).write.parquet(f"{path}/data")
    if kind == "Regression":
        model = RandomForestRegressionModel.load(path)
    else:
        from pyspark.ml.classification import RandomForestClassificationModel as Model

        model = Model.load(path)
    release(spark, path)
    if estimator is not None:
        model = estimator._copyValues(model)
        model._transfer_params_to_java()
    return model


def _totals(codes: np.ndarray, columns: Columns, kinds: int, places: Sequence[np.ndarray], values: Sequence[np.ndarray],
            most: int, needs: Sequence | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rows and targets of each node by class and cell: two arrays, exact. ``needs`` names the bundles of each node."""
    shape = len(places), kinds, int(columns.starts[-1])
    found, sums = np.zeros(shape), np.zeros(shape)
    for b, size in enumerate(columns.sizes):
        code, size = codes[b], size * kinds
        asked = [i for i, at in enumerate(places) if len(at) and (needs is None or b in needs[i])]
        for first in range(0, len(asked), 64):  # some nodes at a time: nodes x codes stay small
            some = asked[first:first + 64]
            counts, targets = np.zeros((len(some), size)), np.zeros((len(some), size))
            for k, i in enumerate(some):
                for a in range(0, len(places[i]), most):
                    both = np.bincount(code[places[i][a:a + most]], values[i][a:a + most], size)
                    n = np.rint(both * 2.0 ** -SHIFT)
                    counts[k] += n
                    targets[k] += both - n * 2.0 ** SHIFT
            part = np.zeros((2, len(some), *shape[1:]))
            columns.by_column(b, counts, kinds, part[0])
            columns.by_column(b, targets, kinds, part[1])
            found[some] += part[0]
            sums[some] += part[1]
    return found, sums


def _best(found: np.ndarray, sums: np.ndarray | None, classes: np.ndarray, columns: Columns, splits: dict,
          allowed: np.ndarray | None, min_rows: int) -> list[tuple]:
    """For each node its rows, weight and sums, and the split of largest gain, the first of equals, or None without one.

    With ``sums``, the targets, the gain is in variance; without them it is in Gini's impurity of the classes.
    """
    weighed = found * classes[:, None]
    tables = [found.sum(1)[..., None], weighed.sum(1)[..., None],
              (sums * classes[:, None]).sum(1)[..., None] if sums is not None else weighed.transpose(0, 2, 1)]
    every = [t[:, :columns.starts[1]].sum(1) for t in tables]
    out = []
    if len(splits["slot"]):
        at, hot = columns.starts[splits["column"]] + splits["byte"], splits["hot"][None, :, None]
        first = columns.starts[splits["column"]]
        left = []
        for t, all_ in zip(tables, every):
            running = np.concatenate([np.zeros_like(t[:, :1]), np.cumsum(t, 1)], 1)
            left.append(np.where(hot, all_[:, None] - t[:, at], running[:, at + 1] - running[:, first]))
        right = [all_[:, None] - x for x, all_ in zip(left, every)]
        with np.errstate(divide="ignore", invalid="ignore"):
            own = (every[2] ** 2).sum(1) / every[1][:, 0]
            gain = ((left[2] ** 2).sum(2) / left[1][..., 0] + (right[2] ** 2).sum(2) / right[1][..., 0] - own[:, None]
                    ) / every[1]
        fine = (left[0][..., 0] >= min_rows) & (right[0][..., 0] >= min_rows) & np.isfinite(gain)
        if allowed is not None:
            fine &= allowed[:, splits["slot"]]
        gain[~fine] = 0.0
        best = gain.argmax(1)
    for i in range(len(found)):
        split = None
        # of rows that are all alike only rounding is left
        if len(splits["slot"]) and gain[i, best[i]] > 1e-12 * float((every[2][i] ** 2).sum()) / float(every[1][i, 0]) ** 2:
            k = best[i]
            split = {n: v[k] for n, v in splits.items()} | {"gain": gain[i, k], "sides": [
                (s[0][i, k, 0], s[1][i, k, 0], s[2][i, k]) for s in (left, right)]}
        out.append((every[0][i, 0], every[1][i, 0], every[2][i], split))
    return out


def _allowed(seed: Sequence[int], nodes: Sequence[int], slots: int, drawn: int) -> np.ndarray | None:
    """The slots that may split each node, drawn anew for each."""
    if drawn >= slots:
        return None
    out = np.zeros((len(nodes), slots), bool)
    for i, node in enumerate(nodes):
        out[i, np.random.default_rng([*seed, node]).choice(slots, drawn, replace=False)] = True
    return out


def _drawn(strategy: str, slots: int, forest: str | None = None) -> int:
    """How many slots a node may use: by Spark's names for it, or a share."""
    if strategy == "auto":
        strategy = {"Classification": "sqrt", "Regression": "onethird", None: "all"}[forest]
    share = {"all": slots, "sqrt": math.ceil(math.sqrt(slots)), "log2": max(1, math.ceil(math.log2(slots))) if slots else 0,
             "onethird": math.ceil(slots / 3.0)}.get(strategy)
    return share if share is not None else math.ceil(float(strategy) * slots)


# --- boosting ----------------------------------------------------------------------------

@dataclass(frozen=True)
class Aim:
    """What a boosting fits its trees to: ``kind`` is logistic, squared or quantile. ``parts`` of one are counted."""

    kind: str
    quantile: float = 0.5
    parts: float = 2.0 ** 22

    def target(self, y: np.ndarray, margin: np.ndarray, first: bool) -> np.ndarray:
        if self.kind == "logistic":
            sign = 2.0 * y - 1
            return sign if first else 4 * sign / (1 + np.exp(2 * sign * margin))
        if self.kind == "squared":
            return y if first else 2 * (y - margin)
        return np.where(y > margin, self.quantile, self.quantile - 1)

    def loss(self, y: np.ndarray, margin: np.ndarray) -> np.ndarray:
        if self.kind == "logistic":
            return 2 * np.logaddexp(0, -2 * (2.0 * y - 1) * margin)
        if self.kind == "squared":
            return (y - margin) ** 2
        return np.maximum(self.quantile * (y - margin), (self.quantile - 1) * (y - margin))


def _counting(tree: Tree, wanted: list[int], columns: Columns, aim: Aim, first: bool, share: float, seed: tuple) -> Callable:
    def count(parts: Iterator[Rows]) -> Iterator[tuple]:
        for rows in parts:
            number, codes, _, margin = rows
            y, start = _target(rows, tree.kinds), None
            if share < 1:
                start = np.flatnonzero(np.random.default_rng([*seed, number]).random(len(y)) < share)
            reached = tree.reach(codes, columns, wanted, start)
            places = [reached[n] for n in wanted]
            values = [np.rint(aim.target(y[at], margin[at], first) * aim.parts) + 2.0 ** SHIFT for at in places]
            yield _totals(codes, columns, tree.kinds, places, values, SUM_ROWS)

    return count


def _moving(trees: list[Tree], weights: list[float], columns: Columns) -> Callable:
    def move(rows: Rows) -> Rows:
        number, codes, y, margin = rows
        for tree, weight in zip(trees, weights):
            margin = tree.add_to(margin, codes, columns, weight)
        return number, codes, y, margin

    return move


def _losing(trees: list[Tree], weights: list[float], columns: Columns, aim: Aim, kinds: int) -> Callable:
    """The sum of the losses after each of the trees, by class, in whole parts."""
    def lose(rows: Rows) -> np.ndarray:
        (_, codes, _, margin), y = rows, _target(rows, kinds)
        out, kind = np.zeros((len(trees), kinds)), y.astype(np.int64) if kinds > 1 else np.zeros(len(y), np.int64)
        for i, (tree, weight) in enumerate(zip(trees, weights)):
            margin = tree.add_to(margin, codes, columns, weight)
            out[i] += np.bincount(kind, np.rint(aim.loss(y, margin) * 2.0 ** 20), kinds)
        return out

    return lose


def _grow(state: RDD, columns: Columns, splits: dict, drawn: int, classes: np.ndarray, aim: Aim, *, depth: int, min_rows: int,
          seed: tuple[int, int], first: bool, share: float) -> Tree:
    tree, counts, wanted, siblings = Tree(depth, len(classes)), {}, [1], {}
    for level in range(depth):
        if not wanted:
            break
        parts = state.mapPartitions(_counting(tree, wanted, columns, aim, first, share, seed)).collect()
        both = [sum(p[i] for p in parts) for i in range(2)]
        found = {node: (both[0][i], both[1][i] / aim.parts) for i, node in enumerate(wanted)}
        for small, other in siblings.items():
            found[other] = tuple(a - b for a, b in zip(counts[small // 2], found[small]))
        counts, nodes, wanted, siblings = found, sorted(found), [], {}
        best = _best(np.stack([found[n][0] for n in nodes]), np.stack([found[n][1] for n in nodes]), classes, columns, splits,
                     _allowed(seed, nodes, columns.n_slots, drawn), min_rows)
        for node, (rows, weight, sums, split) in zip(nodes, best):
            tree.set_sums(node, rows, weight, sums)
            if split is None:
                continue
            tree.set(node, split)
            children = [2 * node, 2 * node + 1]
            if max(tree.rows[children]) >= 2 * min_rows and level + 1 < depth:
                small, other = sorted(children, key=lambda i: tree.rows[i])
                wanted.append(small)
                siblings[small] = other
    return tree


def _residuals(tree: Tree, columns: Columns) -> Callable:
    """For each leaf its residuals in parts of the grid and how often each occurs."""
    def count(rows: Rows) -> Iterator[tuple]:
        _, codes, y, margin = rows
        residual = np.rint((y - margin) * GRID).astype(np.int64)
        for node, at in tree.reach(codes, columns, tree.leaves()).items():
            if len(at):
                yield int(node), np.unique(residual[at], return_counts=True)

    return count


def _added(one: tuple, other: tuple) -> tuple:
    values, place = np.unique(np.concatenate([one[0], other[0]]), return_inverse=True)
    return values, np.bincount(place, np.concatenate([one[1], other[1]]), len(values)).astype(np.int64)


def _percentiles(table: tuple, quantiles: Sequence[float]) -> list[float]:
    """Exact percentiles of counted values, between two of them by their distance."""
    values, upto = table[0], np.cumsum(table[1])
    out = []
    for q in quantiles:
        place = (upto[-1] - 1) * q
        low, high = (float(values[np.searchsorted(upto, int(p), "right")]) for p in (math.floor(place), math.ceil(place)))
        out.append(low if low == high else (math.ceil(place) - place) * low + (place - math.floor(place)) * high)
    return out


def boost(train: DataFrame, valid: DataFrame, *, rounds: int, depth: int, rate: float, min_rows: int = 1,
          column_share: str = "all", row_share: float = 1.0, seed: int = 42, patience: int | None = 30,
          loss: Loss | None = None, aim: str = "logistic", classes: Sequence[float] | None = None) -> Boosting:
    """Boost on rows of (features, label) until ``patience`` rounds brought no better validation loss.

    A logistic loss is of labels 0 and 1, weighing the same or as ``classes`` says; other rows are left out. ``loss`` names
    the quantile.
    """
    spark, logistic = train.sparkSession, aim == "logistic"
    kinds, sides, sizes = 2 if logistic else 1, [], []
    label = F.col("label").cast("double")
    for frame in (train, valid):
        frame = frame.where(F.col("label").isin(0, 1) if logistic else F.col("label").isNotNull())
        ones, n, most = frame.agg(F.count_if(label == 1), F.count("*"), F.max(F.abs(label))).first()
        sides.append(frame)
        sizes.append((np.array([n - ones, ones]) if logistic else np.array([n]), most))
    total = int(sizes[0][0].sum())
    if not total:
        raise ValueError("no rows to learn from")
    q, start = loss.quantile if loss else None, 0.0
    if q is not None:
        start = round(sides[0].agg(F.percentile(label, q)).first()[0] * GRID) / GRID
    # of a squared error a first margin may lie on the other side of the labels
    what = Aim(aim, q if q is not None else 0.5, 2.0 ** (PARTS - 2 - (
        math.ceil(math.log2(max(1.0, sizes[0][1]))) + 1 if aim == "squared" else 0)))
    columns = fit_columns(sides[0], total, seed)
    splits, drawn = columns.candidates(), _drawn(column_share, columns.n_slots)
    balance = [np.ones(1) if not logistic else np.divide(n.sum(), 2.0 * n, out=np.zeros(2), where=n > 0) if classes is None
               else np.array(classes) for n, _ in sizes]
    base, held = (packed_rows(f, F.col("label"), columns, kinds, int(n.sum()), start) for f, (n, _) in zip(sides, sizes))
    state, held = base.persist(KEPT), held.persist(KEPT)
    before, paths = None, []
    trees, weights, losses, leaves = [], [], [], []
    while len(trees) < rounds:
        at = len(trees)
        first = at == 0 and q is None
        tree = _grow(state, columns, splits, drawn, balance[0], what, depth=depth, min_rows=min_rows, seed=(seed, at),
                     first=first, share=row_share)
        weight = 1.0 if first else rate
        if q is not None:
            tree, weight = _with_leaf_quantiles(state, tree, columns, q, rate), 1.0
        trees.append(tree)
        weights.append(weight)
        if before is not None:
            before.unpersist()  # the root's pass has read this round's margins in full
        if len(trees) == rounds or len(trees) % LOOK_ROUNDS == 0 and len(trees) > (patience or 0):
            fresh = trees[len(losses):], weights[len(losses):]
            losses += _validation(held, *fresh, columns, what, balance[1], sizes[1][0])
            if len(trees) == rounds or patience is not None and len(losses) - _best_round(losses) >= patience:
                break
            moved = held.map(_moving(*fresh, columns)).persist(KEPT)
            if len(trees) % STAGE_ROUNDS == 0:
                moved, path = _staged(spark, moved)
                paths.append(path)
            else:
                moved.count()
            held.unpersist()
            held = moved
        before, state = state, state.map(_moving([tree], [weight], columns)).persist(KEPT)
        if len(trees) % STAGE_ROUNDS == 0:
            state, path = _staged(spark, state)
            paths.append(path)
            before.unpersist()
            before = None
    for kept in (state, held, before):
        if kept is not None:
            kept.unpersist()
    for path in paths:
        release(spark, path)
    best = _best_round(losses) if patience is not None else len(trees)
    made = list(spark_forest(spark, trees[:best], columns.n_slots).trees)
    values = [[float(t.value[n]) for n in t.leaves()] for t in trees[:best]] if q is not None else []
    return Boosting(made, weights[:best], values, start, losses)


def _with_leaf_quantiles(state: RDD, tree: Tree, columns: Columns, q: float, rate: float) -> Tree:
    """The tree whose leaves are the quantile of their rows' residuals, shortened by the rate, on the grid."""
    found = state.flatMap(_residuals(tree, columns)).reduceByKey(_added).mapValues(lambda t: _percentiles(t, [q])[0]).collect()
    tree.value[:] = 0.0
    for node, value in found:
        tree.value[node] = round(rate * value) / GRID
    return tree


def _staged(spark: SparkSession, rows: RDD) -> tuple[RDD, str]:
    """Rows written out, so that no plan reaches back over many rounds; what was kept of them is let go."""
    path = f"{staging_root(spark)}/parcelsight/packed-{uuid.uuid4().hex}"
    rows.saveAsPickleFile(path, 1)
    again = rows.context.pickleFile(path, rows.getNumPartitions()).persist(KEPT)
    again.count()
    rows.unpersist()
    return again, path


def _validation(held: RDD, trees: list[Tree], weights: list[float], columns: Columns, aim: Aim, balance: np.ndarray,
                sizes: np.ndarray) -> list[float]:
    """The mean loss of the held rows after each of the trees."""
    sums = sum(held.map(_losing(trees, weights, columns, aim, len(sizes))).collect(), np.zeros((len(trees), len(sizes))))
    weight = (balance * sizes).sum()
    return [float(x / weight) / 2.0 ** 20 if weight else float("nan") for x in sums @ balance]


def _best_round(losses: list[float]) -> int:
    return min(range(len(losses)), key=losses.__getitem__) + 1


# --- forests -----------------------------------------------------------------------------

@dataclass
class Forest:
    """A fitted forest, its trees over packed columns, and the packed rows that it was fitted on, which are still kept."""

    model: object
    trees: list[Tree]
    columns: Columns
    rows: RDD


def _bootstrap(seed: Sequence[int], n: int) -> np.ndarray:
    """How often each row is drawn: a Poisson number of mean 1."""
    upto = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])
    table = np.searchsorted(upto, (np.arange(2 ** 16) + 0.5) / 2 ** 16).astype(np.uint8)
    return table[np.random.default_rng(seed).integers(0, 2 ** 16, n, np.uint16)]


def _forest_counting(trees: dict[int, tuple[Tree, list[int], list | None]], columns: Columns, parts: float | None,
                     seed: int) -> Callable:
    def count(rows: Rows) -> Iterator[tuple]:
        number, codes, y, _ = rows
        value = np.full(codes.shape[1], 2.0 ** SHIFT) if parts is None else np.rint(y * parts) + 2.0 ** SHIFT
        for i, (tree, wanted, needs) in trees.items():
            times = _bootstrap([seed, i, number], codes.shape[1])
            reached = tree.reach(codes, columns, wanted, np.flatnonzero(times))
            places = [reached[n] for n in wanted]
            found, sums = _totals(codes, columns, tree.kinds, places, [times[at] * value[at] for at in places],
                                  SUM_ROWS // 2, needs)
            yield i, (found.astype(np.uint16 if found.max(initial=0) < 2 ** 16 else np.int64), sums if parts else None)

    return count


def _forest_splitting(trees: dict[int, tuple[Tree, list[int], list | None]], classes: np.ndarray, columns: Columns, splits: dict,
                      parts: float | None, drawn: int, min_rows: int, seed: int) -> Callable:
    """Adds up what the tasks counted of each tree and finds its nodes' best splits."""
    def split(counted: Iterator[tuple]) -> Iterator[tuple]:
        total: dict[int, list] = {}
        for i, (found, sums) in counted:
            if i not in total:
                total[i] = [found.astype(float), None if sums is None else sums.copy()]
            else:
                total[i][0] += found
                if sums is not None:
                    total[i][1] += sums
        for i, (found, sums) in total.items():
            wanted = trees[i][1]
            yield i, _best(found, None if sums is None else sums / parts, classes, columns, splits,
                           _allowed((seed, i), wanted, columns.n_slots, drawn), min_rows)

    return split


def forest(train: DataFrame, estimator, rows: int, classes: Sequence[float] | None) -> Forest:
    """A forest of the estimator's size, on rows drawn with replacement for each tree.

    ``classes`` are the weights of the classes 0, 1, ..; without them it is a regression. The caller lets ``rows`` go.
    """
    spark, kind = train.sparkSession, "Regression" if classes is None else "Classification"
    label, depth, least, seed = (estimator.getLabelCol(), estimator.getMaxDepth(), estimator.getMinInstancesPerNode(),
                                 estimator.getSeed() % 2 ** 63)
    weights = np.ones(1) if classes is None else np.array(classes, float)
    columns = fit_columns(train, rows, seed)
    splits, drawn = columns.candidates(), _drawn(estimator.getFeatureSubsetStrategy(), columns.n_slots, kind)
    parts = None
    if classes is None:
        most = train.agg(F.max(F.abs(F.col(label).cast("double")))).first()[0]
        parts = 2.0 ** (PARTS - 4 - math.ceil(math.log2(max(1.0, most))))
    packed = packed_rows(train, F.col(label), columns, len(weights), rows).persist(KEPT)
    bundle_of = np.zeros(columns.n_slots, np.int64)
    for c, slots in enumerate(columns.slots):
        bundle_of[slots] = columns.place[c][0]
    trees = [Tree(depth, len(weights)) for _ in range(estimator.getNumTrees())]
    for at in range(0, len(trees), FOREST_TREES):
        open_nodes = {i: [1] for i in range(at, min(at + FOREST_TREES, len(trees)))}
        for level in range(depth):
            some = {}
            for i, wanted in open_nodes.items():
                allowed = _allowed((seed, i), wanted, columns.n_slots, drawn)
                # the first bundle also tells the rows of a node
                needs = None if allowed is None else [{columns.place[0][0], *bundle_of[a]} for a in allowed]
                some[i] = trees[i], wanted, needs
            found = packed.flatMap(_forest_counting(some, columns, parts, seed)).partitionBy(
                min(len(some), packed.getNumPartitions())).mapPartitions(_forest_splitting(
                    some, weights, columns, splits, parts, drawn, least, seed)).collect()
            open_nodes = {}
            for i, best in sorted(found, key=lambda f: f[0]):
                tree, wanted = trees[i], []
                for node, (n, weight, sums, split) in zip(some[i][1], best):
                    tree.set_sums(node, n, weight, sums)
                    if split is not None:
                        tree.set(node, split)
                        wanted += [c for c in (2 * node, 2 * node + 1) if tree.rows[c] >= max(2, 2 * least) and level + 1 < depth]
                if wanted:
                    open_nodes[i] = wanted
            if not open_nodes:
                break
    return Forest(spark_forest(spark, trees, columns.n_slots, estimator), trees, columns, packed)


def leaf_percentiles(fitted: Forest, quantiles: Sequence[float]) -> list[tuple[int, list[tuple[int, list[float]]]]]:
    """For each tree the percentiles of the target in each of its leaves, which are numbered as Spark numbers them."""
    trees, columns = fitted.trees, fitted.columns

    def count(rows: Rows) -> Iterator[tuple]:
        _, codes, y, _ = rows
        values, place = np.unique(y, return_inverse=True)
        for i, tree in enumerate(trees):
            leaves = tree.leaves()
            reached = tree.reach(codes, columns, leaves)
            counts = [np.bincount(place[reached[node]], minlength=len(values)) for node in leaves]
            yield i, [(leaf, (values[n > 0], n[n > 0])) for leaf, n in enumerate(counts) if n.any()]

    def total(counted: Iterator[tuple]) -> Iterator[tuple]:
        tables: dict[int, dict[int, tuple]] = {}
        for i, leaves in counted:
            own = tables.setdefault(i, {})
            for leaf, table in leaves:
                own[leaf] = _added(own[leaf], table) if leaf in own else table
        for i, own in tables.items():
            yield i, [(leaf, _percentiles(table, quantiles)) for leaf, table in sorted(own.items())]

    return fitted.rows.flatMap(count).partitionBy(min(len(trees), fitted.rows.getNumPartitions())).mapPartitions(total).collect()
