"""One-to-one matching of two point lists and its evaluation."""

from __future__ import annotations

import heapq
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelspark.functions.numbering import running
from voxelspark.functions.storage import cut
from voxelspark.operators.spatial import components, distance_join, met, near_pairs
from voxelspark.operators.tiling import inside


AXES = ("x", "y", "z")


def candidates(first: DataFrame, second: DataFrame, radius: float) -> DataFrame:
    """``a_id, b_id, d, weight`` of all pairs closer than the radius; weight is 1 over the distance (0.001 at least)."""
    pairs = near_pairs(first, radius, others=second)
    return pairs.withColumn("weight", 1.0 / F.greatest(F.lit(0.001), F.col("d")))


def greedy(pairs: DataFrame, group: tuple[str, ...] = ()) -> DataFrame:
    """Pairs picked by ascending (d, a, b), each end once (within its ``group``, if there are any).

    A pair that is the first of all live pairs at both its ends would be picked by the sequential walk as well, so
    whole rounds of such pairs are taken at once; every round settles at least the first pair that is left.
    """
    order = F.struct("d", "a_id", "b_id")
    live, out = cut(pairs.select(*group, "a_id", "b_id", "d")), None
    while not live.isEmpty():
        ranked = live.withColumn("fa", F.min(order).over(Window.partitionBy(*group, "a_id"))).withColumn("fb", F.min(order).over(Window.partitionBy(*group, "b_id")))
        won = cut(ranked.where((order == F.col("fa")) & (order == F.col("fb"))).select(*group, "a_id", "b_id", "d"))
        out = won if out is None else out.unionByName(won)
        taken = lambda end: won.select(*group, end).hint("shuffle_hash")
        live = cut(live.join(taken("a_id"), [*group, "a_id"], "left_anti").join(taken("b_id"), [*group, "b_id"], "left_anti"))
    return out if out is not None else live


def _walk(a: np.ndarray, b: np.ndarray, seen_a: np.ndarray, seen_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs in order those that the walk surely picks, and those it may pick, if pairs of ends that aren't ``seen`` are unknown.

    A pair that is the first of all left at both ends is picked if both are seen; if one isn't, the other is unsure from then on too.
    """
    sure, picked, open_ = [seen_a.copy(), seen_b.copy()], [], []
    taken = [np.zeros(len(seen_a), bool), np.zeros(len(seen_b), bool)]
    live = np.arange(len(a))
    while len(live):
        first = []
        for end, n in ((a[live], len(seen_a)), (b[live], len(seen_b))):
            at = np.zeros(n, np.int64)
            # the last one written is the first in order
            at[end[::-1]] = np.arange(len(live))[::-1]
            first.append(at[end] == np.arange(len(live)))
        both = first[0] & first[1]
        i, j = a[live[both]], b[live[both]]
        certain = sure[0][i] & sure[1][j]
        picked.append(live[both][certain])
        open_.append(live[both][~certain])
        taken[0][i[certain]], taken[1][j[certain]] = True, True
        sure[0][i[~certain]], sure[1][j[~certain]] = False, False
        live = live[~both]
        live = live[~taken[0][a[live]] & ~taken[1][b[live]]]
    return np.concatenate([np.zeros(0, np.int64), *picked]), np.concatenate([np.zeros(0, np.int64), *open_])


#: Rows that one task walks over at once; pairs a point has, about, in a stage of the walk.
WHOLE, EACH = 20_000, 8


def greedy_near(first: DataFrame, second: DataFrame, radius: float, side: float | None = None) -> DataFrame:
    """``a_id, b_id, d``: what ``greedy`` picks of all pairs of two lists of ``id, x, y, z`` closer than the radius, without listing them.

    Nearer pairs come first, so the walk goes by stages: all pairs under a radius at which a point has a few, then, of the
    points that are left, those under a wider one. In a stage blocks of the volume with what lies three radii round them go
    to tasks, which walk as far as is sure from what they see; points with live pairs go on in other blocks. Rows that share
    an id are one end, of which no block but the last sees all: such a pair is picked once it is the first of all at both ends.
    """
    rows = [df.dropna(subset=["id", *AXES]).select(F.lit(k).alias("side"), F.col("id").cast("long").alias("id"), *[F.col(a).cast("double").alias(a) for a in AXES]) for k, df in enumerate((first, second))]
    both = cut(rows[0].unionByName(rows[1]))
    several = both.groupBy("side", "id").count().where("count > 1").select("side", "id", F.lit(True).alias("several"))
    left = cut(both.join(several.hint("shuffle_hash"), ["side", "id"], "left").fillna(False, ["several"]))
    keys, shown = [f"_b{a}" for a in AXES], ["side", "id", *AXES, "several"]
    schema = "won boolean, side int, id long, x double, y double, z double, several boolean, a_id long, b_id long, d double"
    least = int(first.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def stage(reach: float, wide: float, shift: float, whole: bool):
        halo = 3 * reach
        # all pairs of these are here
        inner = (halo - reach) * (1 - 1e-9)

        def run(p: pd.DataFrame) -> pd.DataFrame:
            start = p[keys].iloc[0].to_numpy(float) * wide + shift
            # ends are in the order of ids
            p = p.sort_values(["side", "id"], kind="stable")
            at, which = p[list(AXES)].to_numpy(float), p["side"].to_numpy()
            own = np.full(len(p), True) if whole else (np.floor((at - shift) / wide) * wide + shift == start).all(axis=1)
            seen = own if whole else ((at >= start - inner) & (at <= start + wide + inner)).all(axis=1) & ~p["several"].to_numpy(bool)
            ia, ib = (np.flatnonzero(which == k) for k in (0, 1))
            (ids_a, ends_a), (ids_b, ends_b) = (np.unique(p["id"].to_numpy(np.int64)[k], return_inverse=True) for k in (ia, ib))
            found = list(met(at[ia], at[ib], reach)) if len(ib) and own.any() else []
            i, j, d = (np.concatenate([np.zeros(0, t), *c]) for t, c in zip((np.int64, np.int64, float), zip(*found, strict=True) if found else ((), (), ()), strict=True))
            order = np.lexsort((ends_b[j], ends_a[i], d))
            i, j, d = i[order], j[order], d[order]
            u, v = ends_a[i], ends_b[j]
            sure = [np.ones(len(n), bool) for n in (ids_a, ids_b)]
            for k, ends, here in ((0, ends_a, ia), (1, ends_b, ib)):
                sure[k][ends[~seen[here]]] = False
            won = _walk(u, v, *sure)[0] if len(d) else np.zeros(0, np.int64)
            taken = [np.zeros(len(n), bool) for n in (ids_a, ids_b)]
            taken[0][u[won]], taken[1][v[won]] = True, True
            live = np.flatnonzero(~taken[0][u] & ~taken[1][v])
            # one end's block may be sure where the other's isn't
            mine = won[own[ia[i[won]]] | own[ib[j[won]]]]
            pair, row = [mine], [ia[i[mine]]]
            for ends, here in ((i, ia), (j, ib)):
                # the first live pair of each row
                some, head = np.unique(ends[live], return_index=True)
                held = own[here[some]]
                pair.append(live[head[held]])
                row.append(here[some[held]])
            pair, kind = np.concatenate(pair), np.repeat([True, False, False], [len(x) for x in pair])
            out = p[shown].iloc[np.concatenate(row)].reset_index(drop=True)
            out.insert(0, "won", kind)
            return out.assign(a_id=ids_a[u[pair]], b_id=ids_b[v[pair]], d=d[pair])

        return run

    picked = []

    def ends(pairs: DataFrame) -> DataFrame:
        both = F.array(F.struct(F.lit(0).alias("side"), F.col("a_id").alias("id")), F.struct(F.lit(1).alias("side"), F.col("b_id").alias("id")))
        return pairs.select(F.explode(both).alias("e")).select("e.*").hint("shuffle_hash")

    reach = 0.0
    while reach < radius:
        extent = left.groupBy("side").agg(F.count(F.lit(1)), *[f(a) for f in (F.max, F.min) for a in AXES]).collect()
        if len(extent) < 2:
            break
        n, most = sum(r[1] for r in extent), max(r[1] for r in extent)
        box = float(np.prod([max(1e-9, max(r[2 + k] for r in extent) - min(r[5 + k] for r in extent)) for k in range(3)]))
        reach = min(radius, max(1.25 * reach, radius / 64, (EACH * box / (4.19 * most)) ** (1 / 3)))
        live, before, step = left, len(picked), 0
        while n:
            wide, whole = side or 16 * reach, side is None and n <= WHOLE
            # blocks lie otherwise in every round
            shift = wide * (step % 3) / 3
            block = lambda c: F.lit(0).cast("long") if whole else F.floor((c - shift) / wide).cast("long")  # noqa: B023, E731
            around = live
            for k, a in zip(keys, AXES, strict=True):
                around = around.withColumn(k, F.explode(F.sequence(block(F.col(a) - 3 * reach), block(F.col(a) + 3 * reach))))
            # small by their bytes, so their number is given
            dealt = around.repartition(1 if whole else max(2 * least, n // 20_000), *keys).groupBy(*keys)
            found = cut(dealt.applyInPandas(stage(reach, wide, shift, whole), schema))
            heads = found.where("NOT won")
            first_of = heads.groupBy("side", "id").agg(F.min(F.struct("d", "a_id", "b_id")).alias("m"))
            agreed = first_of.groupBy("m").count().where("count = 2").select("m.a_id", "m.b_id", "m.d")
            picked.append(cut(found.where("won").select("a_id", "b_id", "d").distinct().unionByName(agreed)))
            live = cut(heads.select(*shown).join(ends(picked[-1]), ["side", "id"], "left_anti"))
            n, step = live.count(), step + 1
        if reach < radius:
            left = cut(left.join(ends(reduce(DataFrame.unionByName, picked[before:])), ["side", "id"], "left_anti")) if len(picked) > before else left
    return reduce(DataFrame.unionByName, picked) if picked else both.select(F.col("id").alias("a_id"), F.col("id").alias("b_id"), F.col("x").alias("d")).limit(0)


class _Sparse:
    """Maximum-weight matching of a bipartite graph on adjacency lists, by shortest alternating paths with duals.

    Duals ``u`` and ``v`` are never negative and ``u + v`` is at least the weight of every edge, with equality on the pairs
    matched, and a node left single has dual 0; so the sum of all duals is the matching's weight, which proves it greatest.
    Rows come in one at a time: from one a path of least reduced cost leads to a column that is free or to a row that is
    better left single.
    """

    def __init__(self, a: np.ndarray, b: np.ndarray, weight: np.ndarray):
        n, m = int(a.max()) + 1, int(b.max()) + 1
        order = np.lexsort((b, a))
        self.to, self.weight = b[order].tolist(), weight[order].tolist()
        self.start = np.searchsorted(a[order], np.arange(n + 1)).tolist()
        self.u = np.maximum.reduceat(weight[order], self.start[:-1]).tolist()
        self.v, self.row, self.column = [0.0] * m, [-1] * m, [-1] * n
        for k in range(n):
            self._enter(k)

    def _enter(self, root: int) -> None:
        far, before, settled = {}, {}, []
        rows, heap, at, base = {root: 0.0}, [], root, 0.0
        best, end = self.u[root], ("row", root)
        while True:
            for e in range(self.start[at], self.start[at + 1]):
                j = self.to[e]
                d = base + max(0.0, self.u[at] + self.v[j] - self.weight[e])
                if d < best and d < far.get(j, float("inf")):
                    far[j], before[j] = d, at
                    heapq.heappush(heap, (d, j))
            while heap and heap[0][0] > far[heap[0][1]]:
                heapq.heappop(heap)
            if not heap or heap[0][0] >= best:
                break
            base, j = heapq.heappop(heap)
            if self.row[j] < 0:
                best, end = base, ("column", j)
                break
            settled.append(j)
            at = self.row[j]
            rows[at] = base
            if base + self.u[at] < best:
                best, end = base + self.u[at], ("row", at)
        for k, d in rows.items():
            if d < best:
                self.u[k] -= best - d
        for j in settled:
            if far[j] < best:
                self.v[j] += best - far[j]
        kind, node = end
        if kind == "row":
            self.u[node] = 0.0
            if node == root:
                return
            freed, self.column[node] = self.column[node], -1
            node = freed
        # along the path every column takes the row it was reached from
        while True:
            k = before[node]
            self.row[node], self.column[k], node = k, node, self.column[k]
            if k == root:
                return


def _solve(pdf: pd.DataFrame) -> pd.DataFrame:
    """A component: a row a pair matched, and one for each node with its dual."""
    pdf = pdf.sort_values(["a_id", "b_id"])
    (a, i), (b, j) = (np.unique(pdf[c], return_inverse=True) for c in ("a_id", "b_id"))
    found = _Sparse(i, j, pdf["weight"].to_numpy(float))
    d = dict(zip(zip(i.tolist(), j.tolist(), strict=True), pdf["d"].tolist(), strict=True))
    pairs = [(int(a[k]), int(b[c]), d[k, c], None) for k, c in enumerate(found.column) if c >= 0]
    duals = [(int(x), None, None, u) for x, u in zip(a, found.u, strict=True)] + [(None, int(x), None, v) for x, v in zip(b, found.v, strict=True)]
    return pd.DataFrame(pairs + duals, columns=["a_id", "b_id", "d", "dual"]).astype({"a_id": "Int64", "b_id": "Int64", "d": float, "dual": float})


def solved(pairs: DataFrame) -> DataFrame:
    """``a_id, b_id, d, dual``: the pairs of a matching of greatest total weight (dual null), and of every node its dual.

    The candidate graph falls into connected components, which are dealt to tasks; one needs memory for its edges.
    """
    coded = pairs.select((F.col("a_id") * 2).alias("u"), (F.col("b_id") * 2 + 1).alias("v"))
    nodes = coded.select(F.col("u").alias("id")).unionByName(coded.select(F.col("v").alias("id"))).distinct()
    group = components(nodes, coded)
    whole = pairs.join(group, pairs["a_id"] * 2 == group["id"]).select("component", "a_id", "b_id", "d", "weight")
    return whole.groupBy("component").applyInPandas(_solve, "a_id long, b_id long, d double, dual double")


def max_weight(pairs: DataFrame) -> DataFrame:
    """``a_id, b_id, d`` of a matching of greatest total weight."""
    return solved(pairs).where(F.col("d").isNotNull()).select("a_id", "b_id", "d")


class _Block:
    """Rows and columns at places, of which a part is ``held``: rows enter the matching as in ``_Sparse`` while all that their search meets is held.

    Edges aren't listed: a row's columns are looked up from the nearest on, and only as far as one could be on a shortest
    path. Duals of columns only grow, so old ones of columns that aren't held are bounds: what they can't shorten nothing can.
    """

    def __init__(self, rows: np.ndarray, u: np.ndarray, mate: np.ndarray, columns: np.ndarray, v: np.ndarray, row: np.ndarray, held: np.ndarray, radius: float):
        self.rows, self.u, self.column, self.v, self.row, self.held, self.radius = rows, u, mate, v, row, held, radius
        self.low, wide = columns.min(axis=0), np.ptp(columns, axis=0)
        spread = wide[wide > 0]
        self.side = min(radius, max(radius / 32, float((2 * np.prod(spread) / len(columns)) ** (1 / len(spread))))) if len(spread) else radius
        cell = np.floor((columns - self.low) / self.side).astype(np.int64)
        self.size = cell.max(axis=0) + 1
        code = np.ravel_multi_index(tuple(cell.T), tuple(self.size))
        self.order = np.argsort(code, kind="stable")
        self.code, self.places, self.known = code[self.order], columns[self.order], {}

    def _columns(self, at: int, wider: bool = False) -> tuple[np.ndarray, np.ndarray, float]:
        """Columns of a row by falling weight, and the radius within which they are all that there are."""
        found = self.known.get(at)
        if found is not None and not wider:
            return found
        radius = min(self.radius, 2 * (found[2] if found else self.side))
        place = self.rows[at]
        first = np.maximum(np.floor((place - self.low - radius) / self.side * (1 + 1e-12)).astype(np.int64) - 1, 0)
        last = np.minimum(np.floor((place - self.low + radius) / self.side).astype(np.int64) + 1, self.size - 1)
        some = np.zeros(0, np.int64)
        if (first <= last).all():
            line = ((np.arange(first[0], last[0] + 1)[:, None] * self.size[1] + np.arange(first[1], last[1] + 1)) * self.size[2]).ravel()
            start, end = np.searchsorted(self.code, line + first[2], "left"), np.searchsorted(self.code, line + last[2], "right")
            n = end - start
            some = np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())
        gap = place - self.places[some]
        d = np.sqrt(gap[:, 0] * gap[:, 0] + gap[:, 1] * gap[:, 1] + gap[:, 2] * gap[:, 2])
        near = np.flatnonzero(d < radius)
        near = near[np.lexsort((self.order[some[near]], d[near]))]
        self.known[at] = found = self.order[some[near]], 1.0 / np.maximum(0.001, d[near]), radius
        return found

    def _above(self, at: int, weight: float) -> tuple[np.ndarray, np.ndarray]:
        """A row's columns heavier than ``weight``."""
        to, w, radius = self._columns(at)
        while radius < self.radius and 1.0 / radius > weight:
            to, w, radius = self._columns(at, wider=True)
        n = len(w) - np.searchsorted(w[::-1], weight, "right")
        return to[:n], w[:n]

    def enter(self, root: int) -> bool:
        """False if the search meets a column that isn't held; nothing is changed then."""
        start, to, w = 0.0, *self._columns(root)[:2]
        if len(w):
            start = max(0.0, float((w - self.v[to]).max()))
        # further ones may be freer
        to, w = self._above(root, start)
        if len(w):
            start = max(start, float((w - self.v[to]).max()))
        far, before, settled = {}, {}, []
        rows, heap, at, base = {root: 0.0}, [], root, 0.0
        u = {root: start}
        best, end, out = start, ("row", root), float("inf")
        while True:
            to, w = self._above(at, base + u[at] - best)
            d = base + np.maximum(0.0, u[at] + self.v[to] - w)
            some = np.flatnonzero(d < best)
            for j, dj in zip(to[some].tolist(), d[some].tolist(), strict=True):
                if dj >= best or dj >= far.get(j, float("inf")):
                    continue
                if not self.held[j]:
                    out = min(out, dj)
                    continue
                far[j], before[j] = dj, at
                if self.row[j] < 0:
                    best, end = dj, ("column", j)
                else:
                    heapq.heappush(heap, (dj, j))
            while heap and heap[0][0] > far[heap[0][1]]:
                heapq.heappop(heap)
            if not heap or heap[0][0] >= min(best, out):
                break
            base, j = heapq.heappop(heap)
            settled.append(j)
            at = int(self.row[j])
            rows[at], u[at] = base, float(self.u[at])
            if base + u[at] < best:
                best, end = base + u[at], ("row", at)
        if out < best:
            return False
        self.u[root] = start
        for k, d in rows.items():
            if d < best:
                self.u[k] = max(0.0, self.u[k] - (best - d))
        for j in settled:
            if far[j] < best:
                self.v[j] += best - far[j]
        kind, node = end
        if kind == "row":
            self.u[node] = 0.0
            if node == root:
                return True
            freed, self.column[node] = self.column[node], -1
            node = int(freed)
        while True:
            k = before[node]
            self.row[node], self.column[k], node = k, node, int(self.column[k])
            if k == root:
                return True


def solved_near(first: DataFrame, second: DataFrame, radius: float, share: int = 4_000) -> DataFrame:
    """What ``solved`` says of the ``candidates`` of two lists of ``id, x, y, z``, without listing them.

    Blocks of the volume, with the columns in reach of them, go to tasks. A row whose search would leave its block waits for
    the next round, where blocks lie otherwise or are wider; in the end the volume is one. Duals hold in every round, so the
    matching is a greatest one whatever the blocks. A first block has about ``share`` rows, and is twice the radius wide at least.
    """
    rows, columns = (df.dropna(subset=["id", *AXES]).select("id", *[F.col(a).cast("double").alias(a) for a in AXES]) for df in (first, second))
    # where they are the more, those that must stay single would look through all the volume
    if rows.count() > columns.count():
        return solved_near(second, first, radius, share).select(F.col("b_id").alias("a_id"), F.col("a_id").alias("b_id"), "d", "dual")
    again = lambda df: not df.groupBy("id").count().where("count > 1").isEmpty()
    if again(rows) or again(columns):
        return solved(candidates(first, second, radius))
    least, most, n = (lambda r: (r[:3], r[3:6], r[6]))(rows.agg(*[f(a) for f in (F.min, F.max) for a in AXES], F.count(F.lit(1))).first())
    wide = [b - a for a, b in zip(least, most, strict=True) if a is not None and b > a]
    side = max(2 * radius, (share * float(np.prod(wide)) / n) ** (1 / len(wide)) if wide else 0.0)
    fresh = [F.lit(0.0).alias("dual"), F.lit(0).cast("long").alias("mate"), F.lit(False).alias("matched")]
    state = cut(rows.select(F.lit(0).alias("side"), "id", *AXES, *fresh, F.lit(True).alias("open")).unionByName(columns.select(F.lit(1).alias("side"), "id", *AXES, *fresh, F.lit(False).alias("open"))))
    keys, schema = [f"_b{a}" for a in AXES], "side int, id long, x double, y double, z double, dual double, mate long, matched boolean, open boolean"
    parts = 2 * int(first.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def mates(df: pd.DataFrame, others: pd.DataFrame) -> np.ndarray:
        """Where each row's mate stands among the others (by rising id), -1 if it isn't there."""
        ids, mate = others["id"].to_numpy(np.int64), df["mate"].to_numpy(np.int64)
        at = np.searchsorted(ids, mate)
        there = df["matched"].to_numpy(bool) & (at < len(ids))
        there[there] = ids[at[there]] == mate[there]
        return np.where(there, at, -1)

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        a, b = a.sort_values("id"), b.sort_values("id")
        own = b["own"].to_numpy(bool) if len(b) else np.zeros(0, bool)
        new = pd.concat([a, b[own]] if own.any() else [a])[["side", "id", *AXES, "dual", "mate", "matched", "open"]]
        waiting = np.flatnonzero(a["open"].to_numpy(bool))
        if not len(waiting) or not len(b):
            # no column in reach of a row means none anywhere
            return new.assign(open=False)
        row, column = mates(b, a), mates(a, b)
        held = own & ((row >= 0) | ~b["matched"].to_numpy(bool))
        block = _Block(a[list(AXES)].to_numpy(float), a["dual"].to_numpy(float).copy(), column, b[list(AXES)].to_numpy(float), b["dual"].to_numpy(float).copy(), row, held, radius)
        late = np.zeros(len(a), bool)
        for k in waiting:
            late[k] = not block.enter(int(k))
        new["dual"] = np.concatenate([block.u, block.v[own]])
        ids = lambda df, at: df["id"].to_numpy(np.int64)[np.maximum(at, 0)] if len(df) else np.zeros(len(at), np.int64)
        changed = np.concatenate([np.ones(len(a), bool), held[own]])
        new["mate"] = np.where(changed, np.concatenate([ids(b, block.column), ids(a, block.row[own])]), new["mate"])
        new["matched"] = np.where(changed, np.concatenate([block.column >= 0, block.row[own] >= 0]), new["matched"])
        new["open"] = np.concatenate([late, np.zeros(own.sum(), bool)])
        return new

    fresh = lambda df: df.select(*[F.col(x).alias(f"_q{k}") for k, x in enumerate(df.columns)]).toDF(*df.columns)
    # small by their bytes, so their number is given
    dealt = lambda df: fresh(df).repartition(parts, *keys).groupBy(*keys)
    reach, step = radius * (1 + 1e-9), 0
    while not state.where("open").isEmpty():
        whole = not wide or side >= max(wide)
        start = [(v or 0.0) - (side / 2 if step % 2 and not whole else 0.0) for v in least]
        # columns may lie outside the rows' extents; at last one block holds all
        block = lambda c, v: F.lit(0).cast("long") if whole else F.floor((c - v) / side).cast("long")  # noqa: B023, E731
        placed = state.where("side = 0").withColumns({k: block(F.col(a), v) for k, a, v in zip(keys, AXES, start, strict=True)})
        around = state.where("side = 1").withColumns({f"_o{a}": block(F.col(a), v) for a, v in zip(AXES, start, strict=True)})
        for k, a, v in zip(keys, AXES, start, strict=True):
            around = around.withColumn(k, F.explode(F.sequence(block(F.col(a) - reach, v), block(F.col(a) + reach, v))))
        around = around.withColumn("own", reduce(lambda p, q: p & q, [F.col(f"_o{a}") == F.col(k) for k, a in zip(keys, AXES, strict=True)])).drop(*[f"_o{a}" for a in AXES])
        state = cut(dealt(placed).cogroup(dealt(around)).applyInPandas(run, schema))
        side, step = side * (1 + step % 2), step + 1
    held, free = (state.where(f"side = {k}") for k in (0, 1))
    ends = held.where("matched").select(F.col("id").alias("a_id"), F.col("mate").alias("b_id"), *[F.col(a).alias(f"a_{a}") for a in AXES])
    ends = ends.hint("shuffle_hash").join(free.select(F.col("id").alias("b_id"), *[F.col(a).alias(f"b_{a}") for a in AXES]).hint("shuffle_hash"), "b_id")
    gap = [F.col(f"a_{a}") - F.col(f"b_{a}") for a in AXES]
    pairs = ends.select("a_id", "b_id", F.sqrt(reduce(lambda p, q: p + q, [g * g for g in gap])).alias("d"), F.lit(None).cast("double").alias("dual"))
    none = F.lit(None).cast("long")
    duals = held.select(F.col("id").alias("a_id"), none.alias("b_id"), F.lit(None).cast("double").alias("d"), "dual").unionByName(free.select(none.alias("a_id"), F.col("id").alias("b_id"), F.lit(None).cast("double").alias("d"), "dual"))
    return pairs.unionByName(duals)


def max_weight_near(first: DataFrame, second: DataFrame, radius: float) -> DataFrame:
    """``a_id, b_id, d`` of a matching of greatest total weight of the ``candidates``."""
    return solved_near(first, second, radius).where(F.col("d").isNotNull()).select("a_id", "b_id", "d")


def certificate(pairs: DataFrame, answer: DataFrame) -> DataFrame:
    """``weight, bound, uncovered, negative, shared``: what proves ``answer`` (of ``solved``) a greatest matching of ``pairs``.

    No matching is heavier than the bound, the sum of the duals, if no edge is uncovered (heavier than the duals of its
    ends by more than rounding) and none is negative; and no node may be shared by two pairs.
    """
    u = answer.where(F.col("d").isNull() & F.col("a_id").isNotNull()).select("a_id", F.col("dual").alias("u"))
    v = answer.where(F.col("d").isNull() & F.col("b_id").isNotNull()).select("b_id", F.col("dual").alias("v"))
    taken = answer.where(F.col("d").isNotNull()).select("a_id", "b_id")
    weight = pairs.join(taken, ["a_id", "b_id"], "left_semi").agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("weight"))
    bound = answer.agg(F.coalesce(F.sum("dual"), F.lit(0.0)).alias("bound"), F.count_if(F.col("dual") < 0).alias("negative"))
    open_ = pairs.join(u, "a_id").join(v, "b_id").agg(F.count_if(F.col("u") + F.col("v") < F.col("weight") * (1 - 1e-9)).alias("uncovered"))
    ends = taken.agg((F.count(F.lit(1)) * 2 - F.count_distinct("a_id") - F.count_distinct("b_id")).alias("shared"))
    return weight.crossJoin(F.broadcast(bound)).crossJoin(F.broadcast(open_)).crossJoin(F.broadcast(ends)).select("weight", "bound", "uncovered", "negative", "shared")


def prf(counts: DataFrame) -> DataFrame:
    """``precision, recall, f1`` from ``tp, fp, fn``: without hits precision is 1 only if nothing was predicted, recall only if nothing was missed."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    p = F.when(tp == 0, (fp == 0).cast("double")).otherwise(F.try_divide(tp, tp + fp))
    r = F.when(tp == 0, (fn == 0).cast("double")).otherwise(F.try_divide(tp, tp + fn))
    return counts.withColumn("precision", F.round(p, 6)).withColumn("recall", F.round(r, 6)).withColumn("f1", F.round(F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0), 6))


def classify(true: DataFrame, pred: DataFrame, matches: DataFrame) -> DataFrame:
    """``kind, id, x, y, z``: TP and FN by the true markers, FP by the predicted ones."""
    # written tables look small by their bytes: neither list is sent to all machines
    hit = matches.select(F.col("a_id").alias("id")).hint("shuffle_hash")
    found = matches.select(F.col("b_id").alias("id")).hint("shuffle_hash")
    part = lambda df, kind: df.select(F.lit(kind).alias("kind"), "id", "x", "y", "z")
    return part(true.join(hit, "id", "left_semi"), "TP").unionByName(part(true.join(hit, "id", "left_anti"), "FN")).unionByName(part(pred.join(found, "id", "left_anti"), "FP"))


def evaluate(true: DataFrame, pred: DataFrame, size: tuple[int, int, int], margin: float, diameter: float, by_weight: bool = True) -> tuple[DataFrame, DataFrame]:
    """(counts and scores, one row; every marker inside with its kind TP, FP, FN or REJ).

    Predictions with ``rejected`` true take no part and are only listed. By weight pairs within twice the diameter compete
    and those under half of it count; otherwise pairs under half the diameter are taken greedily. Hits are judged inside by
    the true marker, false positives by the predicted one.
    """
    rejected = F.coalesce(F.col("rejected"), F.lit(False)) if "rejected" in pred.columns else F.lit(False)
    live = pred.where(~rejected)
    if by_weight:
        matches = max_weight_near(true, live, 2 * diameter).where(F.col("d") < diameter / 2)
    else:
        matches = greedy_near(true, live, diameter / 2)
    listed = classify(true, live, cut(matches)).unionByName(pred.where(rejected).select(F.lit("REJ").alias("kind"), "id", "x", "y", "z")).where(inside(size, margin))
    counts = listed.agg(*[F.count_if(F.col("kind") == k).alias(k.lower()) for k in ("TP", "FP", "FN")])
    return prf(counts), listed


def lifetimes(pairs: DataFrame) -> DataFrame:
    """Of ``pairs`` (``a_id, b_id, d, v`` and more; ``v`` belongs to ``b_id``) those that the greedy walk over the pairs with ``v`` above a threshold picks at some threshold, with ``since`` and ``until``: at those from ``since`` up to, but not at, ``until``.

    One walk by (d, a, b) does for all thresholds. What stands before a pair leaves ``a`` taken below some threshold and
    ``b`` free below another one: the pair is picked between the two, after which they are exchanged. So each pair is
    looked at once. Rounds as in ``greedy``; a pair that can't be picked any more changes nothing and is dropped.
    """
    least, order = F.lit(float("-inf")), F.struct("d", "a_id", "b_id")
    by_a, by_b = Window.partitionBy("a_id"), Window.partitionBy("b_id")
    live, out = cut(pairs.where(F.col("v") > least).withColumns({"taken": least, "free": F.col("v"), "fb": F.min(order).over(by_b)})), None
    while not live.isEmpty():
        seen = live.withColumn("won", (F.min(order).over(by_a) == order) & (F.col("fb") == order))
        # at an end whose first pair is picked, the thresholds are exchanged for all its pairs
        seen = seen.withColumn("a_new", F.max(F.when(F.col("won"), F.col("free"))).over(by_a)).withColumn("b_new", F.max(F.when(F.col("won"), F.col("taken"))).over(by_b))
        seen = cut(seen)
        won = seen.where("won").select(*pairs.columns, F.col("taken").alias("since"), F.col("free").alias("until"))
        out = won if out is None else out.unionByName(won)
        rest = seen.where("NOT won").withColumns({"taken": F.coalesce("a_new", "taken"), "free": F.coalesce("b_new", "free")}).where(F.col("taken") < F.col("free"))
        live = cut(rest.select(*pairs.columns, "taken", "free").withColumn("fb", F.min(order).over(by_b)))
    return out if out is not None else live.select(*pairs.columns, F.col("taken").alias("since"), F.col("free").alias("until"))


def _steps(true: DataFrame, pred: DataFrame, attribute: str, size: tuple[int, int, int], margin: float, radius: float) -> DataFrame:
    """``value, hits, found``: by how much the matched true markers inside and the matched predictions inside change where the threshold passes ``value``.

    Only predictions with an attribute above the threshold take part. All thresholds are matched in one walk
    (``lifetimes``), which needs one attribute an id; lists with ids that repeat are matched anew for each of them.
    """
    repeats = lambda df: not df.dropna(subset=list(AXES)).groupBy("id").count().where("count > 1").isEmpty()
    if repeats(true) or repeats(pred):
        return _steps_each(true, pred, attribute, size, margin, radius)
    a = true.select("id", *AXES, inside(size, margin).alias("in"))
    b = pred.select("id", *AXES, inside(size, margin).alias("in"), F.col(attribute).cast("double").alias("v"))
    pairs = distance_join(a, b, radius).select("a_id", "b_id", "d", F.col("b_v").alias("v"), F.col("a_in").cast("long").alias("hits"), F.col("b_in").cast("long").alias("found"))
    ends = F.explode(F.array(F.struct(F.col("since").alias("value"), "hits", "found"), F.struct(F.col("until").alias("value"), (-F.col("hits")).alias("hits"), (-F.col("found")).alias("found"))))
    return lifetimes(pairs).select(ends.alias("e")).select("e.*")


def _steps_each(true: DataFrame, pred: DataFrame, attribute: str, size: tuple[int, int, int], margin: float, radius: float) -> DataFrame:
    """The same by matching anew: a matching falls into those of the connected components of all candidate pairs, and a
    component's changes only at its own attributes, so every component is matched once for each of those (and once for all
    its pairs, at null) and nothing is matched once a threshold of the whole list.
    """
    a = true.select("id", *AXES, inside(size, margin).alias("in"))
    b = pred.select("id", *AXES, inside(size, margin).alias("in"), F.col(attribute).cast("double").alias("v"))
    pairs = cut(distance_join(a, b, radius).select("a_id", "b_id", "d", "b_v"))
    coded = pairs.select((F.col("a_id") * 2).alias("u"), (F.col("b_id") * 2 + 1).alias("v"))
    group = components(coded.select(F.col("u").alias("id")).unionByName(coded.select(F.col("v").alias("id"))).distinct(), coded)
    named = cut(pairs.join(group, pairs["a_id"] * 2 == group["id"]).drop("id"))
    values = named.select("component", F.col("b_v").alias("value")).distinct()
    states = cut(values.unionByName(values.select("component", F.lit(None).cast("double").alias("value")).distinct()))
    # null, where all take part, is coded as the least value; no attribute is below it
    least = F.coalesce(F.col("value"), F.lit(float("-inf")))
    alive = named.join(states, "component").where(F.col("b_v") > least).select("component", least.alias("value"), "a_id", "b_id", "d")
    won = greedy(alive, ("component", "value"))
    # an id counts once for each of its rows inside
    rows = lambda df, end, name: df.where("in").groupBy(F.col("id").alias(end)).agg(F.count(F.lit(1)).alias(name)).hint("shuffle_hash")
    ends = won.join(rows(a, "a_id", "hits"), "a_id", "left").join(rows(b, "b_id", "found"), "b_id", "left")
    per = ends.groupBy("component", "value").agg(F.sum("hits").alias("hits"), F.sum("found").alias("found"))
    every = states.select("component", least.alias("value")).join(per, ["component", "value"], "left").fillna(0, ["hits", "found"])
    earlier = Window.partitionBy("component").orderBy("value")
    change = lambda c: F.col(c) - F.coalesce(F.lag(c).over(earlier), F.lit(0))
    return every.select("value", change("hits").alias("hits"), change("found").alias("found"))


def pr_sweep(true: DataFrame, pred: DataFrame, attribute: str, size: tuple[int, int, int], margin: float, radius: float, more_than: int = 10, at: list[float] | None = None) -> DataFrame:
    """``value, n, tp, fp, fn, precision, recall, f1`` for each distinct attribute of a prediction inside: predictions above it, matched greedily.

    ``n`` are the predictions inside above the value; values with ``more_than`` of them or fewer have no row. Hits are judged
    inside by the true marker, false positives by the predicted one. ``at`` are further values to judge at.
    """
    true, pred = cut(true), cut(pred.where(F.col(attribute).isNotNull()))
    total = true.where(inside(size, margin)).count()
    within = pred.where(inside(size, margin)).select(F.col(attribute).cast("double").alias("value"))
    steps = _steps(true, pred, attribute, size, margin, radius)
    asked = within.distinct()
    if at:
        asked = asked.unionByName(true.sparkSession.createDataFrame([(float(v),) for v in at], "value double")).distinct()
    none = [F.lit(0).cast("long").alias(c) for c in ("hits", "found", "gone")]
    events = steps.select("value", "hits", "found", none[2], F.lit(0).alias("asked"))
    events = events.unionByName(within.select("value", none[0], none[1], F.lit(1).cast("long").alias("gone"), F.lit(0).alias("asked"))).unionByName(asked.select("value", *none, F.lit(1).alias("asked")))
    merged = events.groupBy("value").agg(*[F.sum(c).alias(c) for c in ("hits", "found", "gone")], F.max("asked").alias("asked"))
    summed = running(merged, {"tp": "hits", "matched": "found", "below": "gone"}, F.col("value")).where("asked = 1")
    n = F.lit(within.count()) - F.col("below")
    counts = summed.select("value", n.alias("n"), "tp", (n - F.col("matched")).alias("fp"), (F.lit(total) - F.col("tp")).alias("fn")).where(F.col("n") > more_than)
    return prf(counts)


def best_cut(curve: DataFrame) -> DataFrame:
    """The row of a sweep with the greatest F1, the least value of equal ones."""
    return curve.agg(F.max_by(F.struct(*curve.columns), F.struct("f1", -F.col("value"))).alias("best")).where("best.f1 > 0").select("best.*")


def model_scores(log: DataFrame, *parameters: str) -> DataFrame:
    """``parameters, tp, fp, fn, precision, recall, f1``: the totals of each run over all its rows ``tp, fp, fn``."""
    return prf(log.groupBy(*parameters).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]))


def model_pivot(scores: DataFrame, rows: str, columns: str, score: str, values: list | None = None) -> DataFrame:
    """``rows`` and a column ``{columns}={value}`` for each value of ``columns`` (those given, or all there are): one score of each run.

    With rows and columns exchanged it is the transpose.
    """
    wide = scores.groupBy(rows).pivot(columns, values).agg(F.first(score))
    return wide.select(rows, *[F.col(f"`{c}`").alias(f"{columns}={c}") for c in wide.columns[1:]])


def _standing(at: np.ndarray, ids: np.ndarray, fixed: np.ndarray, seen: np.ndarray, own: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Of places in the order of a walk: those within the radius of a kept one (gone), and those no earlier one can suppress (free).

    ``fixed`` ones are kept, ``seen`` ones have all that is near here and suppress others if they are free, others are only
    judged if they are ``own``. Rows of one id don't suppress each other.
    """
    cell = np.floor((at - at.min(axis=0)) / (radius * (1 + 1e-9))).astype(np.int64) + 1
    size = cell.max(axis=0) + 2
    code = np.ravel_multi_index(tuple(cell.T), tuple(size))
    order = np.argsort(code, kind="stable")
    code = code[order]
    lines = np.array([(x * size[1] + y) * size[2] for x in (-1, 0, 1) for y in (-1, 0, 1)])
    gone, free = np.zeros(len(at), bool), fixed.copy()

    def near(k: int) -> np.ndarray:
        home = (cell[k, 0] * size[1] + cell[k, 1]) * size[2] + cell[k, 2] + lines
        begin, end = np.searchsorted(code, home - 1, "left"), np.searchsorted(code, home + 1, "right")
        some = np.concatenate([order[i:j] for i, j in zip(begin.tolist(), end.tolist(), strict=True)])
        gap = at[some] - at[k]
        some = some[np.sqrt(gap[:, 0] * gap[:, 0] + gap[:, 1] * gap[:, 1] + gap[:, 2] * gap[:, 2]) <= radius]
        return some[ids[some] != ids[k]]

    for k in np.flatnonzero(fixed).tolist():
        some = near(k)
        gone[some[~fixed[some]]] = True
    for k in np.flatnonzero((seen | own) & ~fixed).tolist():
        if gone[k]:
            continue
        some = near(k)
        # what is kept for sure has its neighbours gone already
        if not (~gone[some] & (some < k)).any():
            free[k] = True
            if seen[k]:
                gone[some[some > k]] = True
    return gone & ~free, free


def suppress(points: DataFrame, radius: float, heaviest_first: bool = True, group: str | None = None, side: float | None = None) -> DataFrame:
    """Greedy suppression: visit by mass, keep a point unless a kept one is within the radius.

    No pair is made. Blocks of the volume with what lies two radii round them go to tasks, which walk as far as is sure from
    what they see; points left unsure go on in other blocks, where those just kept suppress. That is the set the sequential
    walk keeps. A row whose id has several rows is near to what any of them is near to; it is kept once it is free at each
    place. Rows without id or without any place stay.
    """
    side, halo = side or 8 * radius, 2 * radius
    key, keys = (["_g"] if group else []), [f"_b{a}" for a in AXES]
    mass = F.col("mass").cast("double")
    of = [*([F.col(group).alias("_g")] if group else []), "id"]
    ranked = points.select(*of, (-mass if heaviest_first else mass).alias("m"), *[F.col(a).cast("double").alias(a) for a in AXES])
    ranked = cut(ranked.where(F.col("id").isNotNull()))
    again = ranked.groupBy(*key, "id").count().where("count > 1").select(*key, "id")
    twice = ranked.join(again.hint("shuffle_hash"), [*key, "id"], "left_semi")
    # each of their masses at each of their places
    places = twice.select(*key, "id", *AXES).distinct()
    spread = twice.select(*key, "id", "m").distinct().hint("shuffle_hash").join(places, [*key, "id"]).withColumn("several", F.lit(True))
    once = ranked.join(again.hint("shuffle_hash"), [*key, "id"], "left_anti").withColumn("several", F.lit(False))
    shown = [*key, "id", "m", *AXES, "several"]
    live = cut(once.select(*shown).unionByName(spread.select(*shown)).dropna(subset=list(AXES)).withColumn("fixed", F.lit(False)))
    kind = {f.name: f.dataType.simpleString() for f in ranked.schema.fields}
    schema = ", ".join([*[f"{c} {kind.get(c, 'boolean')}" for c in shown], "state int"])

    def rounds(shift: float):
        def run(p: pd.DataFrame) -> pd.DataFrame:
            start = p[keys].iloc[0].to_numpy(float) * side + shift
            p = p.sort_values(["m", "id"], kind="stable")
            p = p.iloc[np.argsort(~p["fixed"].to_numpy(bool), kind="stable")]
            at, fixed = p[list(AXES)].to_numpy(float), p["fixed"].to_numpy(bool)
            own = (np.floor((at - shift) / side) * side + shift == start).all(axis=1)
            inner = (halo - radius) * (1 - 1e-9)
            seen = ((at >= start - inner) & (at <= start + side + inner)).all(axis=1) & ~p["several"].to_numpy(bool)
            gone, free = _standing(at, p["id"].to_numpy(), fixed, seen, own, radius)
            return p[shown].assign(state=np.where(gone, 0, np.where(free, 1, 2)))[own & ~fixed]

        return run

    kept, n, step, least = None, live.count(), 0, int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while n:
        # blocks lie otherwise in every round
        shift = side * (step % 3) / 3
        block = lambda c: F.floor((c - shift) / side).cast("long")  # noqa: B023, E731
        around = live
        for k, a in zip(keys, AXES, strict=True):
            around = around.withColumn(k, F.explode(F.sequence(block(F.col(a) - halo), block(F.col(a) + halo))))
        # small by their bytes, so their number is given
        dealt = around.repartition(max(2 * least, n // 20_000), *key, *keys).groupBy(*key, *keys)
        found = cut(dealt.applyInPandas(rounds(shift), schema))
        alone, joint = found.where("NOT several"), found.where("several")
        # gone at one place is gone, free is free at all
        judged = joint.groupBy(*key, "id", "m").agg(F.min("state").alias("low"), F.max("state").alias("high")).select(*key, "id", "m", F.when(F.col("low") == 0, 0).otherwise(F.col("high")).alias("now"))
        same = [F.col("j.id") == F.col("w.id"), F.col("j.m").eqNullSafe(F.col("w.m")), *[F.col(f"j.{g}").eqNullSafe(F.col(f"w.{g}")) for g in key]]
        joint = joint.alias("j").join(judged.alias("w").hint("shuffle_hash"), reduce(lambda p, q: p & q, same)).select(*[f"j.{c}" for c in shown], F.col("w.now").alias("state"))
        found = cut(alone.unionByName(joint).where("state > 0"))
        won = found.where("state = 1").select(*key, "id", "m").distinct()
        kept = won if kept is None else kept.unionByName(won)
        left = found.where("state = 2").count()
        live, n, step = found.select(*shown, (F.col("state") == 1).alias("fixed")), found.count() if left else 0, step + 1
    # rows that take no part stay
    placed = ranked.dropna(subset=list(AXES)).select(*key, "id").distinct()
    whole = points.withColumn("_m", -mass if heaviest_first else mass)
    match = lambda t: [F.col(f"{t}.id") == F.col("p.id"), *[F.col(f"{t}.{g}").eqNullSafe(F.col(f"p.{group}")) for g in key]]
    no_place = whole.alias("p").join(placed.alias("s").hint("shuffle_hash"), reduce(lambda p, q: p & q, match("s")), "left_anti").drop("_m")
    if kept is None:
        return no_place
    held = whole.alias("p").join(kept.alias("k").hint("shuffle_hash"), reduce(lambda p, q: p & q, [*match("k"), F.col("p._m").cast("double").eqNullSafe(F.col("k.m"))]), "left_semi").drop("_m")
    return held.unionByName(no_place)


#: Hues that neighbours are told apart by.
HUES = (0, 25, 40, 60, 80, 100, 140, 160, 180, 200, 220, 240, 260, 280, 300, 330)


def colored(nodes: DataFrame, edges: DataFrame, seed: int = 0) -> DataFrame:
    """``id, color``: whole numbers from 0, the ends of an edge different, at any size.

    Rounds of independent sets: of the nodes without a colour those that come before all such neighbours (in a seeded
    order, those with more neighbours first) take their least free one. That is what a walk through the whole order gives.
    """
    both = edges.select("u", "v").where("u <> v")
    both = cut(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    degree = both.groupBy(F.col("u").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    rank = degree.select("id", F.struct("n", F.xxhash64("id", F.lit(seed)).alias("h"), F.col("id").alias("i")).alias("rank"))
    ranked = both.join(rank.select(F.col("id").alias("u"), F.col("rank").alias("ru")), "u").join(rank.select(F.col("id").alias("v"), F.col("rank").alias("rv")), "v")
    # each node waits for the neighbours before it
    waits = cut(ranked.where("rv > ru").select("u", "v"))
    alone = nodes.select("id").distinct().join(waits.select(F.col("u").alias("id")), "id", "left_anti").select("id", F.lit(0).alias("color"))
    done = cut(alone)
    live = waits
    while not live.isEmpty():
        seen = live.join(done.select(F.col("id").alias("v"), "color"), "v", "left").groupBy("u").agg(F.count_if(F.col("color").isNull()).alias("open"), F.collect_set("color").alias("taken"))
        least = F.array_min(F.array_except(F.sequence(F.lit(0), F.size("taken")), "taken"))
        new = cut(seen.where("open = 0").select(F.col("u").alias("id"), least.alias("color")))
        done = cut(done.unionByName(new))
        live = cut(live.join(new.select(F.col("id").alias("u")), "u", "left_anti"))
    return done


def hues(nodes: DataFrame, edges: DataFrame, seed: int = 0) -> DataFrame:
    """``id, color``: a hue a node, ends of an edge different; nodes without an edge have a seeded one.

    The usual hues come first; where a neighbourhood needs more, the whole degrees between them follow, and then numbers
    from 360 on, so there is a colouring for every graph.
    """
    rest = [k for k in range(360) if k not in HUES]
    number = F.col("color")
    hue = F.coalesce(F.get(F.lit([*HUES, *rest]), number), number)
    touched = edges.where("u <> v").select(F.col("u").alias("id")).unionByName(edges.where("u <> v").select(F.col("v").alias("id"))).distinct()
    chance = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(256)).cast("int")
    given = colored(nodes, edges, seed).join(touched.withColumn("on", F.lit(True)), "id", "left")
    return given.select("id", F.when(F.col("on"), hue).otherwise(chance).cast("int").alias("color"))


