"""Exact k-nearest candidates by pruned cells, and pairwise distance sums in blocks.

k nearest: donors are laid out in the leaves of a k-d tree, cells of about a quarter of
``DONOR_BLOCK_ROWS``.  The tree is fitted on a bounded sample of the donors (at most 16 rows
a cell): the largest leaf is split at the median of the feature that spreads its rows most
in the distance's own units, rows without that feature getting a leaf of their own.  Every
donor is laid out, and the cells' boxes are taken from all of them: per feature how many
donors have it and, for the features split on, the bounds.  A leaf that grew far past the
bound (equal rows cannot be split) keeps of equal rows those of the smallest keys, as no
other can be among the k nearest, and is dealt to several cells.

A receiver first meets the donors of its own leaf: the k-th real distance there bounds its
k-th neighbour.  It then visits the cells whose box is not farther than that: chunks of
receivers are held against regions of ``FAN_OUT`` cells in a row and then against cells.
Receivers and donors are co-grouped by ``GROUP_CELLS`` cells in a row, the receivers of a
crowded group are split: a receiver is copied once per group and not per cell, as one value,
no pair rows are materialised, and no group grows with the data.  Inside a group matrix
products bound every distance on both sides, the few that can matter are computed exactly,
and only each receiver's k best candidates in (distance, donor key) order (per missing
feature for imputation) leave the task.  At most ``MAX_CELLS`` boxes pass through the
driver; beyond that many cells, cells grow.

Distance sums (the exact silhouette) need every pair by definition: the rows are
hashed into blocks and grouped by unordered block pairs, so each distance is computed
once for both rows, by matrix products.

The distances of neighbours are summed coordinate by coordinate in column order, the
same arithmetic as the SQL oracle, so ties and values agree exactly.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from custlens.operators.ranking import bucket_of
from custlens.session import materialise_table

RECEIVER_BLOCK_ROWS = 4_096    # receivers per co-group (upper bound, hash-balanced)
DONOR_BLOCK_ROWS = 4_096       # four cells of donors
PAIR_BLOCK_ROWS = 262_144      # rows of a block where all pairs are needed
FAN_OUT = 64                   # cells per region
GROUP_CELLS = 16               # cells whose receivers and donors meet in one group
MAX_CELLS = 8_192              # cells at most
SAMPLE_ROWS = 16               # sampled donors a cell that the tree is fitted on
OTHER_ROWS = 2_048             # of these, per feature, for receivers whose own leaf lacks it
CURVE_FEATURES, CURVE_BITS = 4, 4
SUB_BLOCK = 256                # receivers per numpy distance block inside a group
DONOR_TILE = 4_096             # donor columns per in-cache distance tile
PAIR_TILE = 1_024              # the same where distances are only summed


def _dist_block(Q: np.ndarray, Qm: np.ndarray, D: np.ndarray, Dm: np.ndarray, n: int) -> np.ndarray:
    """NaN-aware distances sqrt(ss * n / common) for a receiver sub-block
    against the donors, computed in donor tiles with in-place buffers.

    ``ss`` adds the squared differences of the coordinates present on both
    sides in column order (absent ones add 0.0), exactly as the SQL form, so
    results are bit-identical; the common-coordinate counts are an exact
    integer matrix product of the presence masks."""
    m, nd = Q.shape[0], D.shape[0]
    out = np.empty((m, nd))
    q_all = Qm.all(axis=0)
    Qf = Qm.astype(np.float64)
    for j0 in range(0, nd, DONOR_TILE):
        Dt, Dmt = D[j0:j0 + DONOR_TILE], Dm[j0:j0 + DONOR_TILE]
        ss = out[:, j0:j0 + Dt.shape[0]]
        ss.fill(0.0)
        buf = np.empty(ss.shape)
        d_all = Dmt.all(axis=0)
        for f in range(n):
            np.subtract(Q[:, f, None], Dt[None, :, f], out=buf)
            np.multiply(buf, buf, out=buf)
            if not (q_all[f] and d_all[f]):
                np.copyto(buf, 0.0, where=~(Qm[:, f, None] & Dmt[None, :, f]))
            ss += buf
        ss *= float(n)
        if q_all.all() and d_all.all():
            ss /= float(n)
            np.sqrt(ss, out=ss)
            continue
        common = Qf @ Dmt.T.astype(np.float64)
        with np.errstate(invalid="ignore", divide="ignore"):
            ss /= common
        np.sqrt(ss, out=ss)
        ss[common == 0] = np.nan
    return out


def _squares(Q: np.ndarray, Qm: np.ndarray, D: np.ndarray, Dm: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Squared distances by a matrix product, how far off they may be by its rounding (a
    number per receiver), and which pairs have a coordinate in common (None: all).  Only
    the coordinates that some row lacks need products of their presence."""
    full = Qm.all(0) & Dm.all(0)
    part = np.flatnonzero(~full)
    many = float(full.sum())
    if len(part):
        qm, dm = Qm[:, part].astype(np.float64), Dm[:, part].astype(np.float64)
        many = many + qm @ dm.T
    centre = np.where(Dm, D, 0.0).sum(0) / np.maximum(Dm.sum(0), 1)
    q, d = np.where(Qm, Q - centre, 0.0), np.where(Dm, D - centre, 0.0)
    free = None if np.min(many) > 0 else many > 0
    if max(np.abs(q).max(initial=0), np.abs(d).max(initial=0)) < 1e100:    # neither infinite nor overflowing
        qq, dd = q * q, d * d
        own, other = qq[:, full].sum(1)[:, None], dd[:, full].sum(1)[:, None]
        left, right = [-2 * q, own, np.ones((len(q), 1))], [d, np.ones((len(d), 1)), other]
        if len(part):
            left, right = [*left, qq[:, part], qm], [*right, dm, dd[:, part]]
        ss = np.hstack(left) @ np.hstack(right).T
        off = (qq.sum(1) + dd.sum(1).max(initial=0.0)) * (8 * (n + 8) * np.finfo(float).eps)
    else:
        with np.errstate(invalid="ignore", over="ignore"):
            ss = _dist_block(Q, Qm, D, Dm, n) ** 2 * many / n
        off = 1e-9 * np.where(np.isfinite(ss), ss, 0.0).max(1, initial=0.0)
    scale = n / np.maximum(many, 1)
    ss *= scale
    if free is not None:
        ss[~free] = np.inf
    return ss, off * np.max(scale, initial=0.0), free


def _kth(square: np.ndarray, at: np.ndarray, near: np.ndarray, there: np.ndarray, k: int) -> np.ndarray:
    """The k-th least of ``square`` among the donors ``there`` in the rows ``at``: read from the
    nearest donors ``near`` (ascending) where k of them are there, else from all."""
    count = np.cumsum(there[near[at]], axis=1)
    found = count[:, -1] >= k
    place = np.argmax(count >= k, axis=1)
    out = square[at, near[at, place]]
    rest = at[~found]
    if len(rest):
        own = square[rest][:, there]
        out[~found] = np.partition(own, k - 1, axis=1)[:, k - 1]
    return out


def _pairs(Q: np.ndarray, D: np.ndarray, r: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs (receiver r, donor c) and their distances, by receiver, distance and donor;
    donors stand in key order, which decides between equal distances."""
    n = Q.shape[1]
    ss, common = np.zeros(len(r)), np.zeros(len(r))
    for f in range(n):
        a, b = Q[r, f], D[c, f]
        gap = a - b
        both = ~(np.isnan(a) | np.isnan(b))
        ss += np.where(both, gap * gap, 0.0)
        common += both
    dist = np.sqrt(ss * float(n) / common)
    order = np.lexsort((c, dist, r))
    return r[order], c[order], dist[order]


def _block_counts(nq: int, nd: int, min_groups: int,
                  receiver_block_rows: int, donor_block_rows: int) -> tuple[int, int]:
    """Receiver and donor block counts: blocks no larger than the bounds, and
    up to ``min_groups`` block pairs so every core has work.  Extra blocks go
    to the receiver side (each adds one copy of the donors), but never below
    one numpy sub-block of receivers per block, so a small input on a very
    large cluster is not copied once per receiver."""
    ndb = max(1, math.ceil(nd / donor_block_rows))
    nqb = max(1, math.ceil(nq / receiver_block_rows))
    if nqb * ndb < min_groups:
        nqb = max(nqb, min(math.ceil(max(nq, 1) / SUB_BLOCK), math.ceil(min_groups / ndb)))
    return nqb, ndb


def pair_blocks(n: int, cores: int) -> int:
    """Blocks that n rows are dealt to, so that every two blocks (and each with itself) make
    a group: enough groups for every core, PAIR_BLOCK_ROWS rows a block at most."""
    nqb, ndb = _block_counts(n, n, 8 * cores, PAIR_BLOCK_ROWS, PAIR_BLOCK_ROWS)
    return math.ceil(math.sqrt(2 * nqb * ndb)) if nqb * ndb > 1 else 1


def block_pairs(rows: DataFrame, block: Column, blocks: int):
    """``rows`` with their block (_b), grouped by each unordered pair of blocks (_i <= _j):
    a row is copied once per block, not once per row or cell it meets."""
    own, other = F.col("_b"), F.col("_o")
    every = rows.withColumn("_b", block).withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    every = every.withColumns({"_i": F.least(own, other), "_j": F.greatest(own, other)}).drop("_o")
    # the groups are compute-heavy but small in bytes: one partition per pair of blocks
    # keeps AQE from coalescing them onto a few tasks
    return every.repartition(blocks * (blocks + 1) // 2, "_i", "_j").groupBy("_i", "_j")


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances, to a relative error below 1e-10: by a matrix product, and where
    that would cancel (near rows) coordinate by coordinate, so equal rows are at 0."""
    def plain(a, b):
        out = np.zeros(np.broadcast_shapes(a[..., 0].shape, b[..., 0].shape))
        for f in range(a.shape[-1]):
            out += (a[..., f] - b[..., f]) ** 2
        return out

    if not len(x) or not len(y):
        return np.zeros((len(x), len(y)))
    with np.errstate(invalid="ignore", over="ignore"):
        mid = y.mean(0)
        a, b = x - mid, y - mid
        aa, bb = (a * a).sum(1), (b * b).sum(1)
        most = aa.max() + bb.max()
    if not 1e-100 < most < 1e100:                     # absent, infinite or no spread at all
        return np.sqrt(plain(x[:, None], y[None]))
    one = np.ones((max(len(x), len(y)), 1))
    ss = np.hstack([-2 * a, aa[:, None], one[:len(x)]]) @ np.hstack([b, one[:len(y)], bb[:, None]]).T
    near = ss < 1e-4 * most
    few = np.count_nonzero(near)
    if few > ss.size // 16:
        return np.sqrt(plain(x[:, None], y[None]))
    if few:
        at = np.flatnonzero(near)
        r, c = np.divmod(at, len(y))
        ss.ravel()[at] = plain(x[r], y[c])
    return np.sqrt(ss, out=ss)


_DTYPES = {"long": "int64", "int": "int32", "double": "float64"}


def _empty(schema: str) -> pd.DataFrame:
    return pd.DataFrame({name: pd.Series(dtype=_DTYPES[t])
                         for name, t in (f.split() for f in schema.split(", "))})


def _features(pdf: pd.DataFrame, fcols: list[str]) -> np.ndarray:
    return pdf[fcols].to_numpy(np.float64, na_value=np.nan)


def curve_place(d: DataFrame, fcols: list[str]) -> tuple[int, Column]:
    """Rows of ``d``, and each row's place on a Z-order curve over the CURVE_FEATURES that
    part the rows best."""
    probs = [k / (1 << CURVE_BITS) for k in range(1, 1 << CURVE_BITS)]
    st = d.agg(F.count(F.lit(1)).alias("n"), *[F.count(c).alias(f"n_{c}") for c in fcols],
               *[F.percentile_approx(c, probs, 1000).alias(f"e_{c}") for c in fcols]).first()
    edges = {c: sorted(set(st[f"e_{c}"] or [])) for c in fcols}
    best = sorted(fcols, key=lambda c: (-len(edges[c]), -st[f"n_{c}"]))[:CURVE_FEATURES]
    code = F.lit(0).cast("long")
    for bit in range(CURVE_BITS - 1, -1, -1):
        for c in best:
            own = F.shiftright(F.coalesce(bucket_of(F.col(c), edges[c]), F.lit(0).cast("long")), bit).bitwiseAND(F.lit(1).cast("long"))
            code = code * 2 + own
    return st["n"], code


class _Tree:
    """Splits of donors into leaves, numbered so that neighbours in the tree are neighbours
    in number.  A node is a leaf's number, or (feature, value, lower, upper, without)."""

    def __init__(self, x: np.ndarray, leaves: int):
        root: list = [None]
        heap, made, tick = [(-len(x), 0, root, 0, np.arange(len(x)))], 1, 0
        while heap and made < leaves:
            _, _, parent, place, rows = heapq.heappop(heap)
            v = x[rows]
            here = ~np.isnan(v)
            many = here.sum(0)
            mean = np.where(here, v, 0.0).sum(0) / np.maximum(many, 1)
            with np.errstate(invalid="ignore", over="ignore"):
                spread = np.nan_to_num((np.where(here, v - mean, 0.0) ** 2).sum(0), nan=0.0)
            f = int(np.argmax(spread))
            own = v[:, f]
            found = np.sort(own[here[:, f]])
            if not len(found) or found[0] == found[-1]:
                continue                                   # nothing parts these rows
            value = found[(len(found) - 1) // 2]
            if value == found[-1]:
                value = found[np.searchsorted(found, value) - 1]
            lost = int(many[f] < len(rows))
            if made + 1 + lost > leaves:
                break
            node = [f, float(value), None, None, None]
            parent[place] = node
            made += 1 + lost
            for side, who in ((2, own <= value), (3, own > value), (4, ~here[:, f])):
                if side < 4 or lost:
                    tick += 1
                    heapq.heappush(heap, (-int(who.sum()), tick, node, side, rows[who]))
        self.root, self.leaves, self.used = root[0], 0, set()
        self.root = self._number(self.root)

    def _number(self, node):
        if node is None:
            self.leaves += 1
            return self.leaves - 1
        f, value, lower, upper, without = node
        self.used.add(f)
        low, up = self._number(lower), self._number(upper)
        # rows without the feature, where the sample had none, go with the lower ones
        return f, value, low, up, low if without is None and isinstance(low, int) else self._number(without) if without is not None else low

    def place(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.int32)
        todo = [(self.root, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if isinstance(node, int):
                out[rows] = node
            elif len(rows):
                v = x[rows, node[0]]
                todo += [(node[2], rows[v <= node[1]]), (node[3], rows[v > node[1]]), (node[4], rows[np.isnan(v)])]
        return out


def _numbered(df: DataFrame, fcols: list[str], tree: _Tree, *tables: tuple[str, dict[int, int]]) -> DataFrame:
    """``df`` with its leaf in the tree (_leaf), and a number that the leaf has in each of
    ``tables`` (name, numbers)."""
    lists = [(name, np.array([of.get(p, 0) for p in range(tree.leaves)], np.int32)) for name, of in tables]

    def place(frames):
        for pdf in frames:
            leaf = tree.place(_features(pdf, fcols))
            pdf.insert(0, "_leaf", leaf)
            for i, (name, numbers) in enumerate(lists):
                pdf.insert(i + 1, name, numbers[leaf])
            yield pdf

    own = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInPandas(place, ", ".join(f"{c} int" for c in ("_leaf", *(name for name, _ in tables))) + ", " + own)


def _parts(counts: dict[int, int], rows: int) -> dict[int, int]:
    """Groups that the rows of a cell are dealt to."""
    return {p: max(1, math.ceil(m / rows)) for p, m in counts.items()}


def _counts(df: DataFrame, col: str) -> dict[int, int]:
    return {r[col]: r["count"] for r in df.groupBy(col).count().collect()}    # one row per cell


def _laid_out(d: DataFrame, fcols: list[str], rows: int, k: int) -> tuple[DataFrame, _Tree, dict[int, int], np.ndarray]:
    """``d`` with its cell (_spot), written once, the tree, the leaves' first cells, and the
    sample that the tree was fitted on."""
    n = d.count()
    leaves = max(1, min(MAX_CELLS, math.ceil(n / rows)))
    rows, take = max(rows, math.ceil(n / leaves)), max(20_000, SAMPLE_ROWS * leaves)
    part = d if n <= take else d.where(F.pmod(F.xxhash64(*d.columns), F.lit(1 << 30)) < int((1 << 30) * take / n))
    sample = _features(part.select(*fcols).toArrow().to_pandas(), fcols)
    tree = _Tree(sample, leaves)
    laid = materialise_table(_numbered(d, fcols, tree), "donor-leaves")
    over = {p for p, m in _counts(laid, "_leaf").items() if m > 4 * rows}
    start = {p: p for p in range(tree.leaves)}
    if not over:
        return laid.withColumnRenamed("_leaf", "_spot"), tree, start, sample
    # equal rows: with k of them, of k + 1 keys, no other is among anyone's k nearest
    full = F.col("_leaf").isin(sorted(over))
    w = Window.partitionBy("_leaf", *fcols)
    same = laid.where(full).withColumn("_own", F.row_number().over(Window.partitionBy("_leaf", *fcols, "_dk").orderBy("_dk"))) \
        .where(F.col("_own") <= k).withColumn("_rank", F.dense_rank().over(w.orderBy("_dk"))).where(F.col("_rank") <= k + 1).drop("_own", "_rank")
    same = materialise_table(same, "donor-equals")
    parts, start, at = _parts(_counts(same, "_leaf"), rows), {}, 0
    for p in range(tree.leaves):
        start[p] = at
        at += parts.get(p, 1)
    table = d.sparkSession.createDataFrame([(p, start[p], parts.get(p, 1)) for p in range(tree.leaves)], "_leaf int, _at int, _m int")
    spot = (F.col("_at") + F.pmod(F.xxhash64("_dk", *fcols), F.col("_m"))).cast("int")
    every = laid.where(~full).unionByName(same).join(table, "_leaf").withColumn("_spot", spot).select("_spot", "_dk", *fcols)
    return materialise_table(every, "donor-cells"), tree, start, sample


def _donor_cells(d: DataFrame, fcols: list[str], rows: int) -> DataFrame:
    return _laid_out(d, fcols, rows, rows)[0]


def _cell_boxes(cells: DataFrame, fcols: list[str]) -> DataFrame:
    """One row per cell: _spot, _region, donors, and per feature the donors that have it
    and their bounds."""
    per = [f(c).alias(f"{name}_{c}") for c in fcols for name, f in (("n", F.count), ("lo", F.min), ("hi", F.max))]
    got = cells.groupBy("_spot").agg(F.count(F.lit(1)).alias("n"), *per)
    return got.withColumn("_region", (F.col("_spot") / FAN_OUT).cast("int"))


class _Boxes:
    """Boxes of the cells over the features that the tree split on, and which cells a
    receiver has to visit."""

    def __init__(self, boxes: DataFrame, fcols: list[str], used: list[int]):
        cols = ["_spot", "_region", "n", *(f"n_{c}" for c in fcols), *(f"{s}_{fcols[f]}" for f in used for s in ("lo", "hi"))]
        got = boxes.select(*cols).toArrow().to_pandas().sort_values("_spot")     # one row per cell
        side = lambda s, cs: got[[f"{s}_{c}" for c in cs]].to_numpy(np.float64, na_value=np.nan).reshape(len(got), len(cs))
        have, rows, names = side("n", fcols), got["n"].to_numpy(np.int64), [fcols[f] for f in used]
        self.used, self.spots, self.some = used, got["_spot"].to_numpy(np.int32), have > 0
        sure = (have == rows[:, None])[:, used]
        # a feature that a donor lacks bounds nothing
        self.lo, self.hi = np.where(sure, side("lo", names), -np.inf), np.where(sure, side("hi", names), np.inf)
        first = np.unique(got["_region"].to_numpy(), return_index=True)[1]
        self.first = np.append(first, len(got))
        self.region_lo = np.minimum.reduceat(self.lo, first, axis=0) if len(got) else self.lo
        self.region_hi = np.maximum.reduceat(self.hi, first, axis=0) if len(got) else self.hi

    @staticmethod
    def _gap(lo: np.ndarray, hi: np.ndarray, low: np.ndarray, up: np.ndarray) -> np.ndarray:
        """Squared gaps between boxes and the box (low, up); NaN there: no bound."""
        away = np.fmax(np.fmax(lo - up, low - hi), 0.0)
        return (np.where(np.isfinite(away), away, 0.0) ** 2).sum(-1)

    def visits(self, x: np.ndarray, limit: np.ndarray, wanted: list) -> list[np.ndarray]:
        """Per receiver (NaN: absent) the cells within its limits (receivers x wanted, squared
        distances; NaN: not wanted)."""
        n, out, here = x.shape[1], [np.empty(0, np.int32)] * len(x), ~np.isnan(x)
        has = np.column_stack([np.ones(len(self.spots), bool) if f is None else self.some[:, f] for f in wanted])
        most = np.fmax.reduce(np.where(np.isnan(limit), -np.inf, limit), axis=1)
        pattern = here[:, self.used] @ (1 << np.arange(len(self.used), dtype=object)) if self.used else np.zeros(len(x), int)
        order = np.lexsort((most, np.unique(np.asarray(pattern, dtype=str), return_inverse=True)[1]))
        for i in range(0, len(x), SUB_BLOCK):
            rows = order[i:i + SUB_BLOCK]
            p = x[rows][:, self.used]
            low, up, reach = p.min(0, initial=np.inf), p.max(0, initial=-np.inf), most[rows].max()   # NaN where a receiver has none
            near = np.flatnonzero(self._gap(self.region_lo, self.region_hi, low, up) * (1 - 1e-9) <= reach)
            near = np.concatenate([np.arange(self.first[g], self.first[g + 1]) for g in near] or [np.empty(0, int)])
            near = near[self._gap(self.lo[near], self.hi[near], low, up) * (1 - 1e-9) <= reach]
            common = here[rows].astype(np.float64) @ self.some[near].T.astype(np.float64)
            ss = np.zeros(common.shape)
            for j in range(len(self.used)):
                away = np.fmax(np.fmax(self.lo[near, j][None, :] - p[:, j, None], p[:, j, None] - self.hi[near, j][None, :]), 0.0)
                ss += np.where(np.isfinite(away), away, 0.0) ** 2
            ss *= n / np.maximum(common, 1) * (1 - 1e-9)
            go = np.zeros(common.shape, bool)
            for j in range(len(wanted)):
                go |= has[near, j][None, :] & (ss <= limit[rows, j][:, None])
            go &= common > 0
            for a, r in enumerate(rows):
                out[r] = self.spots[near[go[a]]]
        return out


def _visits(q: DataFrame, cells: DataFrame, tree: _Tree, start: dict[int, int], boxes: _Boxes, fcols: list[str], k: int, wanted: list,
            exclude_self: bool, per_group: int, sample: np.ndarray) -> DataFrame:
    """Receivers: the doubles of their features and of the bounds that their own leaf's
    donors give (as ``wanted``, squared, NaN: not wanted) in _x, and the cells to visit
    (_spots).  Where too few of a leaf's donors have a feature, the sampled donors that
    have it give the bound."""
    schema = "_qk long, _x binary, _spots array<int>"

    sample = np.random.default_rng(0).permutation(sample)     # rows come in the table's order
    some = [] if wanted == [None] else [np.flatnonzero(~np.isnan(sample[:, f]))[:OTHER_ROWS] for f in wanted]
    others = pd.DataFrame(sample[np.unique(np.concatenate(some))], columns=fcols) if some else pd.DataFrame(columns=fcols)
    others["_dk"] = np.arange(len(others))

    def lower(limit: np.ndarray, qpdf: pd.DataFrame, dpdf: pd.DataFrame) -> None:
        for r0, j, _, r, _, dist, _ in _best(qpdf, dpdf, fcols, k, wanted, limit.copy(), exclude_self):
            got = np.bincount(r, minlength=len(limit))
            last = np.flatnonzero(np.append(r[1:] != r[:-1], True)) if len(r) else np.empty(0, int)
            last = last[got[r[last]] >= k]
            limit[r[last], j] = dist[last] ** 2 * (1 + 1e-9)

    def bound(qpdf: pd.DataFrame, dpdf: pd.DataFrame) -> pd.DataFrame:
        x = _features(qpdf, fcols)
        limit = np.full((len(x), len(wanted)), np.inf)
        for j, f in enumerate(wanted):
            if f is not None:
                limit[~np.isnan(x[:, f]), j] = np.nan
        lower(limit, qpdf, dpdf)
        far = np.flatnonzero(np.isinf(limit).any(1))
        if len(far) and len(others):
            rest = np.where(np.isinf(limit[far]), np.inf, np.nan)
            lower(rest, qpdf.iloc[far], others)
            limit[far] = np.fmin(limit[far], rest)
        return pd.DataFrame({"_qk": qpdf["_qk"].to_numpy(), "_x": [row.tobytes() for row in np.hstack([x, limit])], "_spots": boxes.visits(x, limit, wanted)})

    parts = _parts(_counts(_numbered(q, fcols, tree).select("_leaf"), "_leaf"), per_group)
    table = q.sparkSession.createDataFrame([(start[p], m) for p, m in parts.items()], "_spot int, _m int")
    key = ["_spot", "_sub"]
    # numbers by the placing itself: a join over the receivers' many conditions takes Spark's optimizer minutes
    left = _numbered(q, fcols, tree, ("_spot", start), ("_m", parts)) \
        .withColumn("_sub", F.pmod(F.xxhash64("_qk", *fcols), F.col("_m")).cast("int")).drop("_m", "_leaf")
    right = cells.join(table, "_spot").withColumn("_sub", F.explode(F.sequence(F.lit(0), F.col("_m") - 1))).drop("_m", "_leaf")
    groups = max(1, sum(parts.values()))
    met = left.repartition(groups, *key).groupBy(*key).cogroup(right.repartition(groups, *key).groupBy(*key)).applyInPandas(
        lambda a, b: bound(a, b) if len(a) else pd.DataFrame({c.split()[0]: [] for c in schema.split(", ")}), schema)
    return materialise_table(met, "visits")


def _best(qpdf: pd.DataFrame, dpdf: pd.DataFrame, fcols: list[str], k: int, wanted: list, limit: np.ndarray, exclude_self: bool):
    """``_nearest`` of frames."""
    return _nearest(qpdf["_qk"].to_numpy(np.int64), _features(qpdf, fcols), dpdf["_dk"].to_numpy(np.int64), _features(dpdf, fcols), k, wanted, limit, exclude_self)


def _nearest(qk: np.ndarray, Q: np.ndarray, dk: np.ndarray, D: np.ndarray, k: int, wanted: list, limit: np.ndarray, exclude_self: bool):
    """Per block of receivers and wanted feature: (block, place in ``wanted``, feature,
    receivers, keys, distances, values) of the k best donors within the limits."""
    if not len(qk) or not len(dk):
        return
    n = Q.shape[1]
    # donors in key order: ties at the k-th distance go to the smaller key
    order = np.argsort(dk, kind="stable")
    dk, D = dk[order], D[order]
    Dm = ~np.isnan(D)
    for r0 in range(0, len(qk), SUB_BLOCK):
        Qs, qs, own = Q[r0:r0 + SUB_BLOCK], qk[r0:r0 + SUB_BLOCK], limit[r0:r0 + SUB_BLOCK].copy()
        square, off, free = _squares(Qs, ~np.isnan(Qs), D, Dm, n)
        if exclude_self:
            free = np.ones(square.shape, bool) if free is None else free
            free &= qs[:, None] != dk[None, :]
            square[~free] = np.inf
        if wanted != [None]:
            own[~np.isnan(Qs[:, wanted])] = np.nan
        there = [np.ones(len(dk), bool) if f is None else Dm[:, f] for f in wanted]
        if np.isinf(own).any() and len(dk) > k:
            # the k-th of a feature is mostly one of the few donors nearest as a whole
            take = min(len(dk), 8 * k + 24)
            near = np.argpartition(square, take - 1, axis=1)[:, :take]
            near = np.take_along_axis(near, np.argsort(np.take_along_axis(square, near, 1), axis=1), 1)
            for j in range(len(wanted)):
                at = np.flatnonzero(np.isinf(own[:, j]))
                if len(at) and there[j].sum() > k:
                    own[at, j] = _kth(square, at, near, there[j], k) + off[at]
        own += off[:, None]                                # below it a distance may be within the limit
        within = square <= np.fmax.reduce(own, axis=1)[:, None]
        r, c = np.nonzero(within if free is None else within & free)
        lo, use = square[r, c], np.zeros(len(r), bool)
        for j in range(len(wanted)):
            use |= there[j][c] & (lo <= own[r, j])
        r, c, dist = _pairs(Qs, D, r[use], c[use])
        lo = square[r, c]
        for j, f in enumerate(wanted):
            ok = there[j][c] & (lo <= own[r, j])
            if ok.any():
                ar, ac, ad = r[ok], c[ok], dist[ok]
                kept = np.arange(len(ar)) - np.searchsorted(ar, ar, side="left") < k
                ar, ac = ar[kept], ac[kept]
                yield r0, j, f, ar + r0, dk[ac], ad[kept], None if f is None else D[ac, f]


def _index(queries: DataFrame, donors: DataFrame, qkey: str, dkey: str, cols: list[str], k: int, per_feature: bool,
           exclude_self: bool, receiver_rows: int | None = None, donor_rows: int | None = None):
    """Donors with their cells, receivers with their bounds and cells to visit, and the
    features wanted (None: the row as a whole); None if a side is empty."""
    q, d, fcols = _sides(queries, donors, qkey, dkey, cols)
    st = q.agg(F.count(F.lit(1)).alias("n"), *[F.count(c).alias(c) for c in fcols]).first()
    wanted = [f for f, c in enumerate(fcols) if st[c] < st["n"]] if per_feature else [None]
    if not st["n"] or not wanted:
        return None
    cells, tree, start, sample = _laid_out(d, fcols, donor_rows or max(1, DONOR_BLOCK_ROWS // 4), k)
    boxes = _Boxes(_cell_boxes(cells, fcols), fcols, sorted(tree.used))
    # receivers per group: enough groups for every core, but not below a sub-block
    rows = min(receiver_rows or RECEIVER_BLOCK_ROWS, max(SUB_BLOCK, st["n"] // (2 * q.sparkSession.sparkContext.defaultParallelism)))
    return cells, _visits(q, cells, tree, start, boxes, fcols, k, wanted, exclude_self, rows, sample), wanted, fcols, rows


def visit_share(queries: DataFrame, donors: DataFrame, qkey: str, dkey: str, cols: list[str], k: int,
                per_feature: bool = False) -> float:
    """Share of the (receiver, donor) pairs whose cells are visited."""
    found = _index(queries, donors, qkey, dkey, cols, k, per_feature, False)
    if found is None:
        return 0.0
    cells, go = found[:2]
    seen = go.select(F.explode("_spots").alias("_spot")).groupBy("_spot").count().join(cells.groupBy("_spot").agg(F.count(F.lit(1)).alias("n")), "_spot")
    return (seen.agg(F.sum(F.col("count") * F.col("n"))).first()[0] or 0) / max(1, go.count() * donors.count())


def _sides(queries: DataFrame, donors: DataFrame, qkey: str, dkey: str, cols: list[str]) -> tuple[DataFrame, DataFrame, list[str]]:
    fcols = [f"c{i}" for i in range(len(cols))]
    x = [F.nullif(F.col(f"`{c}`").cast("double"), F.lit(float("nan"))).alias(f) for c, f in zip(cols, fcols)]
    return queries.select(F.col(qkey).cast("long").alias("_qk"), *x), donors.select(F.col(dkey).cast("long").alias("_dk"), *x), fcols


def wide_candidates(queries: DataFrame, donors: DataFrame, qkey: str, dkey: str, cols: list[str],
                    k: int, per_feature: bool, exclude_self: bool = False,
                    receiver_block_rows: int | None = None,
                    donor_block_rows: int | None = None) -> DataFrame:
    """Candidate rows: (_qk, _dk, _dist) or, per feature, (_qk, _f, _dk, _dist, _v).
    With ``exclude_self`` a key names one donor."""
    schema = ("_qk long, _f int, _dk long, _dist double, _v double" if per_feature
              else "_qk long, _dk long, _dist double")
    found = _index(queries, donors, qkey, dkey, cols, k, per_feature, exclude_self, receiver_block_rows, donor_block_rows)
    if found is None:
        return queries.sparkSession.createDataFrame([], schema)
    cells, go, wanted, fcols, _ = found
    empty, n = _empty(schema), len(fcols)

    def fn(qpdf: pd.DataFrame, dpdf: pd.DataFrame) -> pd.DataFrame:
        if qpdf.empty or dpdf.empty:
            return empty
        both = np.frombuffer(b"".join(qpdf["_x"]), np.float64).reshape(len(qpdf), -1)
        qk, dk, x = qpdf["_qk"].to_numpy(np.int64), dpdf["_dk"].to_numpy(np.int64), _features(dpdf, fcols)
        # receivers and donors by cell
        who, spot = np.repeat(np.arange(len(qk)), qpdf["_spots"].map(len)), np.concatenate(list(qpdf["_spots"]))
        at, of = np.argsort(spot, kind="stable"), dpdf["_spot"].to_numpy()
        who, spot, rows = who[at], spot[at], np.argsort(of, kind="stable")
        out = []
        for cell in np.unique(of):
            q, d = who[slice(*np.searchsorted(spot, [cell, cell + 1]))], rows[slice(*np.searchsorted(of[rows], [cell, cell + 1]))]
            for _, _, f, r, near, dist, v in _nearest(qk[q], both[q, :n], dk[d], x[d], k, wanted, both[q, n:], exclude_self):
                got = {"_qk": qk[q[r]], "_dk": near, "_dist": dist}
                out.append(pd.DataFrame(got if f is None else {**got, "_f": np.full(len(r), f, np.int32), "_v": v}))
        return pd.concat(out, ignore_index=True)[list(empty.columns)] if out else empty

    group = lambda c: (c / GROUP_CELLS).cast("int")
    visits = go.select("_qk", "_x", "_spots", F.explode(F.array_distinct(F.transform("_spots", group))).alias("_group")) \
        .withColumn("_spots", F.filter("_spots", lambda c: group(c) == F.col("_group")))
    counts = _counts(visits.select("_group"), "_group")
    many = receiver_block_rows or min(4 * RECEIVER_BLOCK_ROWS, max(SUB_BLOCK, sum(counts.values()) // (2 * go.sparkSession.sparkContext.defaultParallelism)))
    parts = _parts(counts, many)
    split = go.sparkSession.createDataFrame(list(parts.items()), "_group int, _m int")
    key, groups = ["_group", "_sub"], max(1, sum(parts.values()))
    left = visits.join(split, "_group").withColumn("_sub", F.pmod(F.xxhash64("_qk", "_x"), F.col("_m")).cast("int")).drop("_m")
    right = cells.withColumn("_group", group(F.col("_spot"))).join(split, "_group").withColumn("_sub", F.explode(F.sequence(F.lit(0), F.col("_m") - 1))).drop("_m")
    return left.repartition(groups, *key).groupBy(*key).cogroup(right.repartition(groups, *key).groupBy(*key)).applyInPandas(fn, schema)


def grouped_distance_sums(df: DataFrame, key: str, group: str, cols: list[str], blocks: int | None = None) -> DataFrame:
    """Per (row, group of the other rows) and block: sum and count of Euclidean distances
    to the other rows of that group (self excluded).  Callers sum over the blocks.

    Rows are hashed into blocks (the hash covers the key and every feature, so even a key
    repeated on many rows spreads, and a recomputed task sends rows to the same blocks);
    each two blocks meet once and their distances count for the rows of both."""
    n = len(cols)
    fcols = [f"c{i}" for i in range(n)]
    base = df.select(F.col(key).cast("long").alias("_k"), F.col(group).cast("long").alias("_g"),
                     *[F.col(f"`{c}`").cast("double").alias(f) for c, f in zip(cols, fcols)])
    schema = "_qk long, _qg long, _dg long, s double, n long"

    def runs(g: np.ndarray) -> list[tuple[int, int, int]]:
        """Group, first place and end of each run of equal groups."""
        at = np.flatnonzero(np.append(True, g[1:] != g[:-1])).tolist()
        return [(int(g[i]), i, j) for i, j in zip(at, [*at[1:], len(g)])]

    def summed(k: np.ndarray, g: np.ndarray, other: np.ndarray, dg: int, s: np.ndarray, many: int) -> pd.DataFrame:
        # a row's own distance (exactly 0) only changes the count
        return pd.DataFrame({"_qk": k, "_qg": g, "_dg": np.full(len(k), dg, np.int64), "s": s, "n": many - np.isin(k, other).astype(np.int64)})

    def fn(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        sides = []
        for b in key:
            own = pdf[pdf["_b"] == b].sort_values("_g", kind="stable")
            sides.append((own["_k"].to_numpy(np.int64), own["_g"].to_numpy(np.int64), _features(own, fcols)))
        (xk, xg, X), (yk, yg, Y) = sides
        if not len(xk) or not len(yk):
            return _empty(schema)
        twice = key[0] != key[1]
        xruns, yruns = runs(xg), runs(yg)
        xs, ys = np.zeros((len(yruns), len(xk))), np.zeros((len(xruns), len(yk)))
        for r0 in range(0, len(xk), SUB_BLOCK):
            r1 = min(r0 + SUB_BLOCK, len(xk))
            for j, (_, lo, hi) in enumerate(yruns):
                for c0 in range(lo, hi, PAIR_TILE):
                    c1 = min(c0 + PAIR_TILE, hi)
                    dist = distances(X[r0:r1], Y[c0:c1])
                    xs[j, r0:r1] += dist.sum(1)
                    for i, (_, a, b) in enumerate(xruns) if twice else ():
                        if a < r1 and b > r0:
                            ys[i, c0:c1] += dist[max(a - r0, 0):b - r0].sum(0)
        out = [summed(xk, xg, yk[lo:hi], g, xs[j], hi - lo) for j, (g, lo, hi) in enumerate(yruns)]
        if twice:
            out += [summed(yk, yg, xk[lo:hi], g, ys[i], hi - lo) for i, (g, lo, hi) in enumerate(xruns)]
        return pd.concat(out, ignore_index=True)

    blocks = blocks or pair_blocks(base.count(), df.sparkSession.sparkContext.defaultParallelism)
    block = F.pmod(F.xxhash64("_k", "_g", *fcols), F.lit(blocks)).cast("int")
    return block_pairs(base, block, blocks).applyInPandas(fn, schema)
