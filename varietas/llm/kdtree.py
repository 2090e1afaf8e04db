"""K-d tree partitioning of documents into shards of near-equal bytes.

The points of the tree are groups of equal texts (a group stays whole unless it
is larger than a shard).  A node is split along its widest metadata dimension at
a distributed weighted median, until a leaf stands for one shard.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varietas.llm.common import column, cut, fresh, numbered, packed

_HASH_BITS = 38          # low bits of an order key: hash of the group, so that ties can be cut
_COORD = (1 << 24) - 1   # a coordinate is an integer of 24 bits
_BINS = 8192             # bins of one refinement pass


@dataclass
class Node:
    leaves: list[int]
    dim: int | None = None
    at: int | None = None              # keys below go left
    left: "Node | None" = None
    right: "Node | None" = None
    path: list = field(default_factory=list)


def unit_hash(c: Column) -> Column:
    """A category as a 24-bit coordinate: equal values share it, null is 0."""
    return F.coalesce(F.xxhash64(c.cast("string")).bitwiseAND(_COORD), F.lit(0)).cast("long")


def log_coord(c: Column) -> Column:
    """A non-negative magnitude as a 24-bit coordinate (log scale); null is 0."""
    top = F.lit(float(_COORD))
    scaled = F.log1p(F.greatest(c.cast("double"), F.lit(0.0))) / F.lit(math.log1p(2.0 ** 40)) * top
    return F.coalesce(F.least(F.greatest(scaled, F.lit(0.0)), top).cast("long"), F.lit(0).cast("long"))


def _key(coord: Column) -> Column:
    """Order of the points along one dimension: coordinate, then group hash."""
    return F.shiftleft(coord, _HASH_BITS) + F.col("g").bitwiseAND((1 << _HASH_BITS) - 1)


def _pick(values: list[int]) -> Column:
    """The value of the row's node."""
    return F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), F.col("node") + 1)


def _node_of(root: Node, leaf_value) -> Column:
    """The tree as one expression: at most one comparison per inner node."""
    if root.at is None:
        return leaf_value(root)
    return (F.when(F.col(f"k{root.dim}") < root.at, _node_of(root.left, leaf_value))
            .otherwise(_node_of(root.right, leaf_value)))


def _front(root: Node) -> list[Node]:
    return [root] if root.at is None else _front(root.left) + _front(root.right)


def _build(light: DataFrame, room: list[float], n_dims: int, fine: float) -> Node:
    """Split until every leaf is one shard; ``room[s]`` is the bytes wanted from the tree in shard s.

    A cut is refined until its bin holds one key or at most ``fine`` bytes.
    """
    root = Node(list(range(len(room))))
    width0 = None
    while True:
        open_nodes = [n for n in _front(root) if len(n.leaves) > 1]
        if not open_nodes:
            return root
        number = {id(n): i for i, n in enumerate(open_nodes)}
        at_node = light.withColumn("node", _node_of(root, lambda n: F.lit(number.get(id(n)))))
        at_node = at_node.where(F.col("node").isNotNull())
        got = {r["node"]: r for r in at_node.groupBy("node").agg(
            F.sum("w").alias("w"), *[F.min(f"k{i}").alias(f"lo{i}") for i in range(n_dims)],
            *[F.max(f"k{i}").alias(f"hi{i}") for i in range(n_dims)]).collect()}  # one row per node: at most the shards
        want, lo, hi, below = {}, {}, {}, {}
        for n in open_nodes:
            k = number[id(n)]
            half = len(n.leaves) // 2
            n.left, n.right = Node(n.leaves[:half]), Node(n.leaves[half:])
            r = got.get(k)
            if r is None:          # no light group here: any cut will do
                n.dim, n.at = 0, 0
                continue
            wide = [(r[f"hi{i}"] >> _HASH_BITS) - (r[f"lo{i}"] >> _HASH_BITS) for i in range(n_dims)]
            width0 = width0 or [max(1, x) for x in wide]
            n.dim = max(range(n_dims), key=lambda i: (wide[i] / width0[i], -i))
            total = sum(room[s] for s in n.leaves)
            want[k] = r["w"] * (sum(room[s] for s in n.left.leaves) / total if total else 0.5)
            lo[k], hi[k], below[k] = r[f"lo{n.dim}"], r[f"hi{n.dim}"] + 1, 0   # the cut lies in (lo, hi]
        todo = {number[id(n)]: n for n in open_nodes if number[id(n)] in want}
        while todo:
            # one pass refines the cut of every open node
            step = {k: max(1, -(-(hi[k] - lo[k]) // _BINS)) for k in todo}
            ks = range(len(open_nodes))
            dim = _pick([todo[k].dim if k in todo else -1 for k in ks])
            key = F.element_at(F.array(*[F.col(f"k{i}") for i in range(n_dims)]), (dim + 1).cast("int"))
            inside = at_node.where(dim >= 0).select(
                "node", "w", key.alias("key"), _pick([lo.get(k, 0) for k in ks]).alias("low"),
                _pick([step.get(k, 1) for k in ks]).alias("step"))
            bins = inside.where(F.col("key") >= F.col("low")).withColumn(
                "bin", F.expr("(key - low) div step"))
            bins = (bins.where(F.col("bin") < _BINS).groupBy("node", "bin").agg(F.sum("w").alias("w"))
                    .collect())   # at most shards x bins rows
            by: dict[int, dict[int, int]] = {}
            for r in bins:
                by.setdefault(r["node"], {})[r["bin"]] = r["w"]
            for k, n in list(todo.items()):
                acc, done = below[k], False
                for b in sorted(by.get(k, {})):
                    if acc + by[k][b] >= want[k]:
                        lo_b = lo[k] + b * step[k]
                        if step[k] == 1 or by[k][b] <= fine:   # cut before or after the bin, whichever is nearer
                            n.at = lo_b if want[k] - acc < acc + by[k][b] - want[k] else lo_b + step[k]
                            done = True
                        else:
                            lo[k], hi[k], below[k] = lo_b, min(hi[k], lo_b + step[k]), acc
                        break
                    acc += by[k][b]
                else:
                    n.at, done = hi[k], True
                if done:
                    del todo[k]


def _even_out(weight: np.ndarray, leaf: np.ndarray, load: np.ndarray, goal: float) -> np.ndarray:
    """Leaves of the heavy groups, moved from where the tree put them as far as leaves above ``goal`` make it needed.

    While a leaf is above the goal, the move of one of its groups to another leaf, or the swap of two, that takes most off both
    leaves' excess is made; of equal ones that to the nearest leaf in tree order.  At most a few thousand groups.
    """
    leaf, load = leaf.copy(), load + np.bincount(leaf, weight, len(load))
    over = lambda x: np.maximum(x - goal, 0.0)
    stuck = np.zeros(len(load), bool)
    while True:
        full = np.where(stuck, -np.inf, load)
        k = int(full.argmax())
        if full[k] <= goal * (1 + 1e-9):
            return leaf
        own, rest = np.flatnonzero(leaf == k), np.flatnonzero(leaf != k)
        # partners: every other leaf with nothing in exchange, and every group of another leaf
        to = np.r_[np.arange(len(load)), leaf[rest]]
        back = np.r_[np.zeros(len(load)), weight[rest]]
        net = weight[own][:, None] - back[None, :]
        gain = over(load[k]) + over(load[to])[None, :] - over(load[k] - net) - over(load[to][None, :] + net)
        gain = np.where((to == k)[None, :] | (net <= 0), -np.inf, gain)
        best = gain.max() if gain.size else -np.inf
        if best <= goal * 1e-6:
            stuck[k] = True
            continue
        i, j = np.nonzero(gain >= best * (1 - 1e-12))
        at = np.lexsort((net[i, j], np.abs(to[j] - k)))[0]
        i, j = int(i[at]), int(j[at])
        load[k] -= net[i, j]
        load[to[j]] += net[i, j]
        leaf[own[i]] = to[j]
        if j >= len(load):
            leaf[rest[j - len(load)]] = k
        stuck[:] = False


def shard(docs: DataFrame, n_shards: int, size: Column, group: Column, coords: dict[str, Column],
          order: list[str], whole_share: float = 0.02) -> DataFrame:
    """Add ``shard`` (0 .. n_shards - 1) and ``slot`` (gapless from 0 within the shard) to ``docs``.

    ``size`` is the weight of a row (a positive number of bytes), ``group`` a
    64-bit hash of what must stay together, ``coords`` the metadata dimensions
    as 24-bit integers (:func:`unit_hash`, :func:`log_coord`).  A group has the
    smallest coordinates of its rows.

    Every group that fits a shard is a weighted point of the tree, whatever its size.  A cut cannot halve a
    group, so heavy ones (above ``whole_share`` of a shard: at most ``n_shards / whole_share`` of them) take the leaf that the tree
    gives them, are moved on only out of leaves that they overfill (:func:`_even_out`), and the tree is cut
    anew for all others, at medians weighted so that each leaf's heavy and other bytes together reach the target.  Only a group
    larger than a shard is no point: it is dealt in pieces by row hash.  Tree nodes, histogram bins and
    those bounded groups reach the driver.

    Cases: an empty table gives an empty result; null sizes count as 0; null
    groups and coordinates are values like others; repeated rows share a
    shard and get different slots; columns of ``docs`` are kept, and the added ones get an underscore if it has their names.

    Scale: a group of over a thousandth of all rows meets its leaf by a broadcast (below a thousand groups).
    """
    spark, n_dims = docs.sparkSession, len(coords)
    names = [fresh(docs, "shard"), fresh(docs, "slot")]
    rows = cut(docs.select(packed(docs), group.alias("g"), F.coalesce(size, F.lit(0)).cast("long").alias("s"),
                           *[column(c).alias(f"o{i}") for i, c in enumerate(order)],
                           *[c.alias(f"c{i}") for i, c in enumerate(coords.values())]))
    ordered = [f"o{i}" for i in range(len(order))]

    def slotted(out: DataFrame) -> DataFrame:
        return numbered(out, ["shard"], ordered, "slot").select(
            *[F.col("row").getField(c).alias(c) for c in docs.columns], F.col("shard").alias(names[0]), F.col("slot").alias(names[1]))
    points = rows.groupBy("g").agg(F.sum("s").alias("w"), F.count(F.lit(1)).alias("n"), *[F.min(f"c{i}").alias(f"c{i}") for i in range(n_dims)])
    points = cut(points.select("g", "w", "n", *[_key(F.col(f"c{i}")).alias(f"k{i}") for i in range(n_dims)]))
    seen = points.agg(F.sum("w").alias("w"), F.sum("n").alias("n")).first()
    total = seen["w"]
    if not total:
        return slotted(rows.withColumn("shard", F.lit(0)))
    goal = total / n_shards
    row_hash = F.xxhash64(*ordered)
    # groups above a shard are dealt in pieces of at most a quarter of it
    pieces = {r["g"]: math.ceil(4 * r["w"] / goal) for r in points.where(F.col("w") > goal).select("g", "w").collect()}   # below n_shards
    load, place = np.zeros(n_shards), []
    if pieces:
        cuts = spark.createDataFrame(list(pieces.items()), "pg long, k long")
        dealt = (rows.join(F.broadcast(cuts), F.col("g").eqNullSafe(F.col("pg")))
                 .groupBy("pg", F.pmod(row_hash, F.col("k")).alias("piece")).agg(F.sum("s").alias("w")).collect())
        for r in sorted(dealt, key=lambda r: (-r["w"], r["pg"] is None, r["pg"] or 0, r["piece"])):
            k = int(load.argmin())
            load[k] += r["w"]
            place.append((r["pg"], r["piece"], k))
    points = points.where(F.col("w") <= goal)
    tree, moved = tree_leaves(points, load, goal, n_dims, whole_share)
    leaf = _node_of(tree, lambda n: F.lit(n.leaves[0]))
    for_heavy = spark.createDataFrame(moved, "hg long, heavy int")            # at most n_shards / whole_share rows
    where = points.join(F.broadcast(for_heavy), F.col("g").eqNullSafe(F.col("hg")), "left")
    where = where.select(F.col("g").alias("pg"), "n", F.coalesce("heavy", leaf).cast("int").alias("leaf"))
    often = F.col("n") * 1000 > seen["n"]
    hot = where.where(often).select(F.col("pg").alias("bg"), F.col("leaf").alias("hot_leaf"))
    met = rows.join(F.broadcast(hot), F.col("g").eqNullSafe(F.col("bg")), "left")
    rare = met.where(F.col("hot_leaf").isNull()).join(where.where(~often), F.col("g").eqNullSafe(F.col("pg")), "left")
    # at most shards / whole_share placed groups and 4 pieces a shard: a bounded table
    placed = spark.createDataFrame(place, "qg long, hp long, piece_shard int")
    k_of = F.lit(1).cast("long")
    for x, k in pieces.items():
        k_of = F.when(F.col("g").eqNullSafe(F.lit(x)), F.lit(k).cast("long")).otherwise(k_of)
    keep = ["row", "g", *ordered]
    out = (met.where(F.col("hot_leaf").isNotNull()).select(*keep, F.col("hot_leaf").alias("leaf"))
           .unionByName(rare.select(*keep, "leaf")).withColumn("p", F.pmod(row_hash, k_of)))
    out = out.join(F.broadcast(placed), F.col("g").eqNullSafe(F.col("qg")) & (F.col("p") == F.col("hp")), "left")
    return slotted(out.select("row", *ordered, F.coalesce("piece_shard", "leaf").cast("int").alias("shard")))


def tree_leaves(points: DataFrame, load: np.ndarray, goal: float, n_dims: int, whole_share: float) -> tuple[Node, list]:
    """(tree, heavy): the tree whose leaves are the shards of the points ``(g, w, k0, ..)``, and (g, leaf) of those
    points whose leaf in an earlier tree stands instead, since a cut beside them would miss its target."""
    n = len(load)
    tree = _build(points, [max(0.0, goal - x) for x in load], n_dims, 0.002 * goal)
    big = points.where(F.col("w") > whole_share * goal)
    heavy = sorted(big.select("g", "w", _node_of(tree, lambda x: F.lit(x.leaves[0])).alias("leaf")).collect(),
                   key=lambda r: (r["g"] is None, r["g"] or 0))
    if not heavy:
        return tree, []
    weight, leaf = np.array([r["w"] for r in heavy], float), np.array([r["leaf"] for r in heavy], np.int64)
    leaf = _even_out(weight, leaf, load, goal)
    room = np.maximum(goal - load - np.bincount(leaf, weight, n), 0.0)
    tree = _build(points.where(F.col("w") <= whole_share * goal), room.tolist(), n_dims, 0.002 * goal)
    return tree, [(r["g"], int(x)) for r, x in zip(heavy, leaf, strict=True)]
