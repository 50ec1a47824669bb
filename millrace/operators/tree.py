"""Exact decision and regression trees, grown level by level over all trees at once.

Values are coded once: the place of (feature, value) among all that occur, so a
feature's codes are a range in the order of its values. A level is one pass over
rows of codes: each partition adds up statistics (class counts, or count, sum
and sum of squares) by node and code in numpy, and Spark adds those of the
partitions. Counts are exact, so of two siblings only the smaller is counted, and
the larger is their parent minus it. Prefix sums in the order of codes give the
left side of every threshold; they go range of codes by range of codes, so no
window holds a whole feature. The best split of each node, a row per node of the
model, goes to the driver, and rows move to the left (code <= split) or right.
Where features have so few values that there are at most ``CELLS`` different
vectors, rows equal in all of them are added up once, before the first level.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators import metrics
from millrace.operators.validate import check_features, check_numeric, positive_int
from millrace.plans.lineage import cut, drop
from millrace.plans.ranks import positions
from millrace.plans.sums import matrix

RANGE_ROWS = 65_536  #: codes of a range
DICTIONARY = 1 << 20  #: different values up to which every task holds their list
CELLS = 1 << 18  #: possible vectors up to which equal ones become one row with sums
DIGITS = 12  #: gains equal in that many decimals are ties: lowest feature, then lowest threshold


@dataclass(frozen=True)
class Node:
    n: float
    impurity: float
    prediction: float
    counts: tuple[float, ...] = ()
    feature: int | None = None
    threshold: float | None = None
    gain: float = 0.0


@dataclass(frozen=True)
class Rules:
    """Stopping rules; ``max_features``: features tried per node (None: all),
    drawn by a hash or by ``draw`` of the tree and the node's heap number."""

    max_depth: int | None = None
    min_samples_split: int = 2
    min_samples_leaf: int = 1
    min_impurity_decrease: float = 0.0
    max_features: int | None = None
    seed: int = 0
    draw: Callable[[int, int], list[int]] | None = None


class _Classes:
    """Additive statistics of a classification node: rows per class."""

    exact = True  #: sums of whole weights can be subtracted without a rest

    def __init__(self, classes: list[float]):
        self.classes, self.names = classes, [f"c{i}" for i in range(len(classes))]

    def terms(self, y: Column, w: Column) -> list[Column]:
        return [F.sum(F.when(y == c, w).otherwise(0.0)) for c in self.classes]

    def weights(self, y: np.ndarray, w: np.ndarray) -> list[np.ndarray]:
        return [np.where(y == c, w, 0.0) for c in self.classes]

    def size(self, s: list[Column]) -> Column:
        return sum(s[1:], s[0])

    def impurity(self, s: list[Column]) -> Column:
        return metrics.entropy(s)

    def node(self, r) -> Node:
        counts = tuple(r[x] for x in self.names)
        n = sum(counts)
        h = -sum(c / n * math.log2(c / n) for c in counts if c) if n else 0.0
        return Node(n, max(h, 0.0), self.classes[max(range(len(counts)), key=lambda i: counts[i])], counts)


class _Moments:
    """Additive statistics of a regression node; targets are centred by ``shift``."""

    names = ["m0", "m1", "m2"]
    exact = False

    def __init__(self, shift: float):
        self.shift = shift

    def weights(self, y: np.ndarray, w: np.ndarray) -> list[np.ndarray]:
        z = y - self.shift
        return [w, w * z, w * z * z]

    def terms(self, y: Column, w: Column) -> list[Column]:
        z = y - self.shift
        return [F.sum(w), F.sum(w * z), F.sum(w * z * z)]

    def size(self, s: list[Column]) -> Column:
        return s[0]

    def impurity(self, s: list[Column]) -> Column:
        n = F.when(s[0] > 0, s[0])
        return F.coalesce(F.greatest(s[2] / n - (s[1] / n) * (s[1] / n), F.lit(0.0)), F.lit(0.0))

    def node(self, r) -> Node:
        n, a, b = r["m0"], r["m1"], r["m2"]
        same = r["lo"] == r["hi"]
        return Node(n, 0.0 if same else max(b / n - (a / n) ** 2, 0.0), r["lo"] if same else a / n + self.shift)


def _tried(rules: Rules, d: int, tree: int, node: int) -> list[int]:
    """Features of a node, drawn without replacement."""
    if rules.max_features is None or rules.max_features >= d:
        return list(range(d))
    if rules.draw is not None:
        return sorted(rules.draw(tree, node))
    rank = lambda f: hashlib.blake2b(f"{rules.seed}/{tree}/{node}/{f}".encode(), digest_size=8).digest()
    return sorted(sorted(range(d), key=rank)[: rules.max_features])


def _codes_of(values: list[np.ndarray], first: list[int]):
    """Adds nothing but turns ``x`` into codes, by the sorted values of each feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = matrix(b.column("x"))
                codes = np.stack([f + np.searchsorted(v, c) for f, v, c in zip(first, values, x.T)], axis=1)
                at = pa.array(np.arange(0, codes.size + 1, codes.shape[1]), pa.int32())
                rest = [c for c in b.schema.names if c not in ("tree", "x")]
                yield pa.RecordBatch.from_arrays([b.column("tree"), pa.ListArray.from_arrays(at, pa.array(codes.ravel())), *(b.column(c) for c in rest)], names=["tree", "x", *rest])

    return run


def coded(rows: DataFrame, d: int, dictionary: int = DICTIONARY, stats=None, cells: int = 0) -> tuple[DataFrame, DataFrame, list[int], int, np.ndarray | None]:
    """``rows`` (tree, x, y, w) with codes in place of values, the values (code,
    feature, value), the first code of each feature, and how many there are. Up
    to ``dictionary`` different values every task looks them up in a list, which
    is given too; more are joined, each row's values once. Where the values make at
most ``cells`` vectors, equal ones are one row with their ``stats`` and the least
and largest y (lo, hi) instead of y and w."""
    own = cut(rows.select(F.col("tree").cast("int").alias("tree"), "x", "y", "w"))
    values = positions(own.select(F.posexplode("x").alias("feature", "value")).distinct(), F.col("feature"), F.col("value"), name="code")
    firsts = {r["feature"]: (r["c"], r["n"]) for r in values.groupBy("feature").agg(F.min("code").alias("c"), F.count("*").alias("n")).collect()}
    first = [firsts[f][0] for f in range(d)] if firsts else [0] * d
    width = sum(n for _, n in firsts.values())
    if width <= dictionary:
        held = values.orderBy("code").toPandas()["value"].to_numpy()
        lists = [held[firsts[f][0] : sum(firsts[f])] for f in range(d)] if firsts else [np.zeros(0)] * d
        if stats is not None and firsts and math.prod(n for _, n in firsts.values()) <= cells:
            own = own.groupBy("tree", "x").agg(*(t.alias(n) for t, n in zip(stats.terms(F.col("y"), F.col("w")), stats.names)), F.min("y").alias("lo"), F.max("y").alias("hi"))
        shape = ", ".join(["tree int, x array<long>", *(f"{c} double" for c in own.columns[2:])])
        return own.mapInArrow(_codes_of(lists, first), shape), values, first, width, held
    marked = cut(own.withColumn("i", F.monotonically_increasing_id()))
    each = marked.select("i", F.posexplode("x").alias("feature", "value")).join(values, ["feature", "value"])
    back = each.groupBy("i").agg(F.transform(F.array_sort(F.collect_list(F.struct("feature", "code"))), lambda e: e["code"]).alias("x"))
    return marked.drop("x").join(back, "i").select("tree", "x", "y", "w"), values, first, width, None


def _histogram(stats, nodes: np.ndarray, tried: np.ndarray | None, width: int, held: int = 1 << 18):
    """Rows (tree, node, x, and y, w or sums) -> sums by node and code for the nodes asked
    for: ``nodes`` has the place in the level's list by tree and node (else -1),
    ``tried`` which features count at each place."""

    def merged(keys: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own, at = np.unique(keys, return_inverse=True)
        return own, np.stack([np.bincount(at, s, len(own)) for s in sums])

    def out(keys: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys // width), pa.array(keys % width), *(pa.array(s) for s in sums)], names=["place", "code", *stats.names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sums, n = [], [], 0
        for b in batches:
            if not b.num_rows:
                continue
            place = nodes[b.column("tree").to_numpy(), b.column("node").to_numpy()]
            own = np.flatnonzero(place >= 0)
            if not len(own):
                continue
            codes = b.column("x").flatten().to_numpy().reshape(b.num_rows, -1)[own]
            key = place[own][:, None] * width + codes
            if "y" in b.schema.names:
                w = np.stack(stats.weights(b.column("y").to_numpy()[own], b.column("w").to_numpy()[own]))
            else:
                w = np.stack([b.column(n).to_numpy()[own] for n in stats.names])
            w = np.repeat(w, codes.shape[1], axis=1)
            if tried is not None:
                use = tried[place[own]].ravel()
                key, w = key.ravel()[use], w[:, use]
            k, s = merged(key.ravel(), w)
            keys.append(k)
            sums.append(s)
            n += len(k)
            if n > held:
                k, s = merged(np.concatenate(keys), np.concatenate(sums, axis=1))
                if len(k) > held // 2:
                    yield out(k, s)
                    keys, sums, n = [], [], 0
                else:
                    keys, sums, n = [k], [s], len(k)
        if n:
            yield out(*merged(np.concatenate(keys), np.concatenate(sums, axis=1)))

    return run


def _with_sums(each: DataFrame, names: list[str], ranged: bool) -> DataFrame:
    """``each`` (place, feature, range, code, names) plus l_<name>, the sums up to
    the code, a_<name>, those of the feature, and the next code."""
    keys = ["place", "feature"]
    w = Window.partitionBy(*keys, "range").orderBy("code")
    left = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*keys, "range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    if not ranged:
        return each.withColumns({f"l_{n}": F.sum(n).over(left) for n in names} | {f"a_{n}": F.sum(n).over(whole) for n in names} | {"next": F.lead("code").over(w)})
    sums = each.groupBy(*keys, "range").agg(*(F.sum(n).alias(f"s_{n}") for n in names), F.min("code").alias("least"))
    w2 = Window.partitionBy(*keys).orderBy("range")
    before = w2.rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sums = sums.select(*keys, "range", F.lead("least").over(w2).alias("beyond"), *(F.coalesce(F.sum(f"s_{n}").over(before), F.lit(0.0)).alias(f"b_{n}") for n in names), *(F.sum(f"s_{n}").over(all_).alias(f"a_{n}") for n in names))
    got = each.join(sums, [*keys, "range"])
    return got.withColumns({f"l_{n}": F.col(f"b_{n}") + F.sum(n).over(left) for n in names} | {"next": F.coalesce(F.lead("code").over(w), F.col("beyond"))})


def grow(rows: DataFrame, d: int, stats, rules: Rules, range_rows: int = RANGE_ROWS, dictionary: int = DICTIONARY) -> dict[int, dict[int, Node]]:
    """``rows`` (tree, x, y, w) -> nodes by tree and heap number (root 1). On the
    rows, nodes are numbered within their level, so trees may be of any depth."""
    spark = rows.sparkSession
    trees: dict[int, dict[int, Node]] = {}
    found, values, first, width, held = coded(rows, d, dictionary, stats, CELLS)
    rows = cut(found.withColumn("node", F.lit(0)))
    names, depth = stats.names, 0
    carried = found.columns[2:]  # y and w, or sums
    if "y" in carried:
        agg = [t.alias(n) for t, n in zip(stats.terms(F.col("y"), F.col("w")), names)] + [F.min("y").alias("lo"), F.max("y").alias("hi")]
    else:
        agg = [F.sum(n).alias(n) for n in names] + [F.min("lo").alias("lo"), F.max("hi").alias("hi")]
    heap: dict[tuple[int, int], int] = {}  # heap number by tree and number in the level
    above: tuple[DataFrame, dict[tuple[int, int], int]] | None = None  # the parents' sums and places
    while True:
        level = rows.groupBy("tree", "node").agg(*agg).collect()
        active = []
        for r in sorted(level, key=lambda r: (r["tree"], r["node"])):
            node, at = stats.node(r), heap.get((r["tree"], r["node"]), 1)
            trees.setdefault(r["tree"], {})[at] = node
            pure = r["lo"] == r["hi"]
            if not pure and node.n >= rules.min_samples_split and (rules.max_depth is None or depth < rules.max_depth):
                active.append((r["tree"], r["node"], at, node.n, node.impurity))
        if not active:
            break
        size = {(r["tree"], r["node"]): trees[r["tree"]][heap.get((r["tree"], r["node"]), 1)].n for r in level}
        place = {(t, n): i for i, (t, n, *_) in enumerate(active)}
        some = rules.max_features is not None and rules.max_features < d
        # children 2i and 2i + 1 of one parent: the larger is what the smaller leaves of it
        less = {(t, n) for t, n in place if above and stats.exact and not some and (size[t, n], n) > (size[t, n ^ 1], n ^ 1)}
        nodes = np.full((1 + max(t for t, _ in size), 1 + max(n for _, n in size)), -1)
        count = {(t, n ^ 1) if (t, n) in less else (t, n) for t, n in place}
        listed = {key: place.get(key, len(active) + i) for i, key in enumerate(sorted(count))}
        for key, i in listed.items():
            nodes[key] = i
        tried = np.zeros((len(active), d), bool) if some else None
        for i, (t, _, at, *_) in enumerate(active if some else ()):
            tried[i, _tried(rules, d, t, at)] = True
        shape = "place long, code long, " + ", ".join(f"{n} double" for n in names)
        sums = rows.mapInArrow(_histogram(stats, nodes, tried, width), shape).groupBy("place", "code").agg(*(F.sum(n).alias(n) for n in names))
        if less:
            pairs = spark.createDataFrame([(above[1][t, n // 2], place[t, n], listed[t, n ^ 1]) for t, n in sorted(less)], "parent long, own long, other long")
            sums = cut(sums)
            whole = above[0].withColumnRenamed("place", "parent").join(pairs, "parent")
            part = sums.select(F.col("place").alias("other"), "code", *(F.col(n).alias(f"o_{n}") for n in names))
            rest = whole.join(part, ["other", "code"], "left").select(F.col("own").alias("place"), "code", *((F.col(n) - F.coalesce(f"o_{n}", F.lit(0.0))).alias(n) for n in names))
            sums = sums.unionByName(rest.where(stats.size([F.col(n) for n in names]) > 0))
        sums = sums.where(F.col("place") < len(active))
        kept = stats.exact and not some
        sums = cut(sums) if kept else sums
        feature = sum((F.when(F.col("code") >= f, 1).otherwise(0) for f in first[1:]), F.lit(0))
        node_of = spark.createDataFrame([(i, n, imp) for i, (_, _, _, n, imp) in enumerate(active)], "place long, pn double, pi double")
        each = sums.withColumn("feature", feature).withColumn("range", F.floor(F.col("code") / range_rows)).join(node_of, "place")
        each = _with_sums(each, names, width > range_rows)
        ls = [F.col(f"l_{n}") for n in names]
        rs = [F.col(f"a_{n}") - F.col(f"l_{n}") for n in names]
        each = each.where("next is not null").withColumn("nl", stats.size(ls)).withColumn("nr", stats.size(rs))
        each = each.where((F.col("nl") >= rules.min_samples_leaf) & (F.col("nr") >= rules.min_samples_leaf))
        gain = F.col("pi") - F.col("nl") / F.col("pn") * stats.impurity(ls) - F.col("nr") / F.col("pn") * stats.impurity(rs)
        each = each.withColumn("gain", F.round(gain, DIGITS))
        good = each.where((F.col("gain") > 0) & (F.col("gain") >= rules.min_impurity_decrease))
        best = good.groupBy("place").agg(F.min_by(F.struct("feature", "code", "next", "gain"), F.struct(-F.col("gain"), F.col("code"))).alias("b"))
        best = best.select("place", "b.*")
        if held is None:
            at = lambda name: values.select(F.col("code").alias(name), F.col("value").alias(f"v_{name}"))
            best = best.join(at("code"), "code").join(at("next"), "next")
        best = best.collect()
        if not best:
            break
        splits, below = [], {}
        for i, r in enumerate(sorted(best, key=lambda r: r["place"])):
            t, n, at_, *_ = active[r["place"]]
            old = trees[t][at_]
            low, high = (r["v_code"], r["v_next"]) if held is None else (float(held[r["code"]]), float(held[r["next"]]))
            trees[t][at_] = Node(old.n, old.impurity, old.prediction, old.counts, r["feature"], (low + high) / 2, r["gain"])
            splits.append((t, n, 2 * i, r["feature"], r["code"]))
            below |= {(t, 2 * i): 2 * at_, (t, 2 * i + 1): 2 * at_ + 1}
        s = spark.createDataFrame(splits, "tree int, node int, child int, f int, t long")
        moved = rows.join(s, ["tree", "node"]).select("tree", (F.col("child") + (F.get("x", "f") > F.col("t")).cast("int")).alias("node"), "x", *carried)
        rows, before, heap = cut(moved), rows, below
        # places of the parents under the numbers that their children come from
        gone = [above[0]] if above else []
        above = (sums, {(t, c // 2): place[t, n] for t, n, c, *_ in splits}) if kept else None
        drop(before, *gone)
        depth += 1
    drop(rows)
    return trees


WIDE = 64  #: leaves up to which a tree is a nested CASE


def leaf_numbers(nodes: dict[int, Node]) -> list[int]:
    return sorted(k for k, n in nodes.items() if n.feature is None)


def apply_tree(nodes: dict[int, Node], x: Column) -> Column:
    """Place of a row's leaf in ``leaf_numbers``: a nested CASE, or for larger
    trees a walk over arrays of their nodes, all rows of a batch a level at a time."""
    order = sorted(nodes)
    leaves = {k: i for i, k in enumerate(leaf_numbers(nodes))}
    if len(leaves) <= WIDE:

        def case(at: int) -> Column:
            n = nodes[at]
            return F.lit(leaves[at]) if n.feature is None else F.when(x[n.feature] <= n.threshold, case(2 * at)).otherwise(case(2 * at + 1))

        return case(1)
    place = {k: i for i, k in enumerate(order)}
    feature = np.array([-1 if nodes[k].feature is None else nodes[k].feature for k in order])
    threshold = np.array([nodes[k].threshold or 0.0 for k in order])
    child = np.array([leaves[k] if nodes[k].feature is None else place[2 * k] for k in order])
    other = np.array([-1 if nodes[k].feature is None else place[2 * k + 1] for k in order])

    def walk(rows: pd.Series) -> pd.Series:
        if not len(rows):
            return pd.Series([], dtype="int64")
        v, at = np.stack(rows.to_numpy()), np.full(len(rows), place[1])
        while (go := np.flatnonzero(feature[at] >= 0)).size:
            k = at[go]
            at[go] = np.where(v[go, feature[k]] <= threshold[k], child[k], other[k])
        return pd.Series(child[at])

    return F.pandas_udf(walk, "int")(x)


def leaf_values(nodes: dict[int, Node], leaf: Column, value) -> Column:
    """``value(node)`` of the leaf at that place; a number or an array of them."""
    got = [value(nodes[k]) for k in leaf_numbers(nodes)]
    lit = lambda v: F.array(*(F.lit(float(x)) for x in v)) if isinstance(v, (list, tuple)) else F.lit(float(v))
    return F.get(F.array(*(lit(v) for v in got)), leaf)


def importances(nodes: dict[int, Node], d: int, weighted: bool) -> list[float]:
    """Gain per feature, times rows where ``weighted``; shares, or zeros."""
    total = [0.0] * d
    for n in nodes.values():
        if n.feature is not None:
            total[n.feature] += n.gain * (n.n if weighted else 1)
    s = sum(total)
    return [v / s for v in total] if s else total


def node_frame(spark, trees: dict[int, dict[int, Node]]) -> DataFrame:
    """A row per node; node_id is the heap number, or the place in heap order
    (from 1) in trees too deep for that."""
    ids = {t: {k: k if max(nodes) < 1 << 62 else i + 1 for i, k in enumerate(sorted(nodes))} for t, nodes in trees.items()}
    rows = [(t, ids[t][k], n.feature is None, n.feature, n.threshold, float(n.prediction), float(n.n), n.impurity, n.gain) for t, nodes in sorted(trees.items()) for k, n in sorted(nodes.items())]
    return spark.createDataFrame(rows, "tree_id int, node_id long, is_leaf boolean, feature int, threshold double, prediction double, n_samples double, impurity double, info_gain double")


def _common(max_depth, least_depth: int, min_samples_split: int, min_samples_leaf: int, decrease: float) -> None:
    if max_depth is not None:
        positive_int("max_depth", max_depth, least_depth)
    positive_int("min_samples_split", min_samples_split, 2)
    positive_int("min_samples_leaf", min_samples_leaf)
    if decrease < 0:
        raise ValueError("min_impurity_decrease must not be negative")


def class_list(df: DataFrame, label: str) -> list[float]:
    return [r[0] for r in df.select(F.col(label).cast("double")).distinct().orderBy(label).collect()]


@dataclass(frozen=True)
class DecisionTreeClassifier:
    max_depth: int | None = None
    min_samples_split: int = 2
    min_samples_leaf: int = 1
    n_features: int | None = None
    min_impurity_decrease: float = 0.0
    seed: int = 0
    features: str = "features"
    label: str = "label"

    def __post_init__(self):
        _common(self.max_depth, 1, self.min_samples_split, self.min_samples_leaf, self.min_impurity_decrease)
        if self.n_features is not None:
            positive_int("n_features", self.n_features)

    @property
    def rules(self) -> Rules:
        return Rules(self.max_depth, self.min_samples_split, self.min_samples_leaf, self.min_impurity_decrease, self.n_features, self.seed)

    def get_params(self) -> dict:
        return {k: getattr(self, k) for k in self.__dataclass_fields__}

    def set_params(self, **params) -> DecisionTreeClassifier:
        unknown = set(params) - set(self.__dataclass_fields__)
        if unknown:
            raise ValueError(f"unknown parameters: {sorted(unknown)}")
        return type(self)(**(self.get_params() | params))

    def fit(self, df: DataFrame) -> TreeModel:
        d = check_features(df, self.features)
        check_numeric(df, self.label)
        if self.n_features is not None and self.n_features > d:
            raise ValueError("n_features must not exceed the number of features")
        classes = class_list(df, self.label)
        rows = df.select(F.lit(0).alias("tree"), F.col(self.features).cast("array<double>").alias("x"), F.col(self.label).cast("double").alias("y"), F.lit(1.0).alias("w"))
        nodes = grow(rows, d, _Classes(classes), self.rules)[0]
        return TreeModel(self, nodes, d, classes, importances(nodes, d, weighted=False))


@dataclass(frozen=True)
class DecisionTreeRegressor:
    max_depth: int | None = None
    min_samples_split: int = 2
    min_samples_leaf: int = 1
    min_impurity_decrease: float = 0.0
    max_features: int | float | str | None = None
    seed: int = 0
    features: str = "features"
    label: str = "label"

    def __post_init__(self):
        _common(self.max_depth, 0, self.min_samples_split, self.min_samples_leaf, self.min_impurity_decrease)
        m = self.max_features
        if isinstance(m, bool) or not (m is None or isinstance(m, (int, float, str))):
            raise TypeError("max_features must be None, a number, 'sqrt' or 'log2'")
        if isinstance(m, str) and m not in ("sqrt", "log2") or isinstance(m, int) and m < 1 or isinstance(m, float) and not 0 < m <= 1:
            raise ValueError(f"max_features {m!r} is out of range")

    def tried(self, d: int) -> int | None:
        m = self.max_features
        if m is None:
            return None
        n = math.ceil(math.sqrt(d)) if m == "sqrt" else math.ceil(math.log2(max(d, 2))) if m == "log2" else m if isinstance(m, int) else math.ceil(m * d)
        return min(max(n, 1), d)

    def fit(self, df: DataFrame, draw: Callable[[int, int], list[int]] | None = None) -> TreeModel:
        """``draw`` may replace the hash that draws a node's features."""
        d = check_features(df, self.features)
        check_numeric(df, self.label)
        y = F.col(self.label).cast("double")
        rows = df.select(F.lit(0).alias("tree"), F.col(self.features).cast("array<double>").alias("x"), y.alias("y"), F.lit(1.0).alias("w"))
        shift = df.agg(F.avg(y)).first()[0]
        rules = Rules(self.max_depth, self.min_samples_split, self.min_samples_leaf, self.min_impurity_decrease, self.tried(d), self.seed, draw)
        nodes = grow(rows, d, _Moments(shift), rules)[0]
        return TreeModel(self, nodes, d, [], importances(nodes, d, weighted=True))


@dataclass(frozen=True)
class TreeModel:
    params: DecisionTreeClassifier | DecisionTreeRegressor
    nodes: dict[int, Node]
    n_features: int
    classes: list[float]
    feature_importances: list[float] = field(default_factory=list)

    def _x(self) -> Column:
        ok = F.assert_true(F.size(self.params.features) == self.n_features, F.lit("width differs from the training width"))
        return F.when(ok.isNull(), F.col(self.params.features).cast("array<double>"))

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds prediction, and for classes probability over the sorted classes."""
        out = df.withColumn("__x", self._x()).withColumn("__leaf", apply_tree(self.nodes, F.col("__x")))
        out = out.withColumn("prediction", leaf_values(self.nodes, F.col("__leaf"), lambda n: n.prediction))
        if self.classes:
            out = out.withColumn("probability", leaf_values(self.nodes, F.col("__leaf"), lambda n: [c / n.n for c in n.counts]))
        return out.drop("__x", "__leaf")

    def node_table(self, spark) -> DataFrame:
        return node_frame(spark, {0: self.nodes})

    def score(self, df: DataFrame) -> float:
        """Accuracy, or R2 for regression."""
        m = metrics.accuracy if self.classes else metrics.r2
        t = self.transform(df).withColumn("__y", F.col(self.params.label).cast("double"))
        return t.agg(m("__y", "prediction")).first()[0]
