"""Gradient-boosted trees: many fits of one frame at once, from histograms of gradients over (fit, node, column, bin).

Columns are binned once and stored in blocks of rows; folds, feature sets and settings of all fits share them. Each level of each round is an aggregate: a block
gives the sums of gradients and curvatures of every fit, node and bin, blocks are added up in Spark by (fit, slice of bins), and every slice
returns the best split of each node, so the driver sees one split per node and slice whatever the number of rows or categories. A frame that is a
task can hold (TASK_ROWS rows at most) needs no adding up: there the rounds of a fit run in one task, and fits are spread over tasks. The blocks of a larger
frame are held in memory with the scores of the round, are at least as many as there are cores, and need one job a level.

Gradients are whole multiples of 2^-30, so sums don't depend on the order of rows: both ways, and every partitioning, grow the same trees.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column as SparkColumn, DataFrame, SparkSession, functions as F

from riskweir.session import scratch

BLOCK_ROWS = 1 << 20
#: Rows of a frame up to which a fit is a task, which reads all blocks one after the other and holds some 70 bytes a row of them.
TASK_ROWS = 1 << 23
#: Rows that are worth a block of their own where cores would be idle.
LEAST_ROWS = 1 << 12
#: Rows whose codes are counted at once, so that they stay in a core's cache.
CHUNK = 1 << 15
#: Rows whose sums are whole as doubles, with a weight of up to 16 each.
EXACT = 1 << 18
#: Codes that columns share a lane up to.
LANE = 256
#: Codes of a column up to which a node has a table of where they go.
TABLE = 4096
#: Bins of a number; its last code stands for a missing cell.
BINS = 255
#: Bins that are added up together.
SLICE = 1 << 14
#: Rounds after which the scores so far are stored with the rows.
STORE_ROUNDS = 10
SCALE = float(1 << 30)
MISSING = -1


@dataclass(frozen=True)
class Settings:
    """``rounds`` trees of ``depth`` levels, each leaf times ``rate``. A split needs curvature ``least_weight`` on both sides and a gain above ``gain``; ``l1`` and
    ``l2`` are penalties on leaves. Every tree sees ``row_share`` of the rows and ``column_share`` of the columns. ``temperature`` is the exponent of
    random row weights (0: none), ``noise`` the size of random changes of the gains, which shrinks over the rounds."""

    rounds: int = 300
    rate: float = 0.05
    depth: int = 6
    least_weight: float = 0.0
    row_share: float = 1.0
    column_share: float = 1.0
    gain: float = 0.0
    l1: float = 0.0
    l2: float = 3.0
    temperature: float = 0.0
    noise: float = 0.0

    def __post_init__(self) -> None:
        if self.rounds < 1 or not 1 <= self.depth <= 12 or self.rate <= 0 or not 0 < self.row_share <= 1 or not 0 < self.column_share <= 1 or min(self.l1, self.l2, self.gain, self.least_weight, self.temperature, self.noise) < 0:
            raise ValueError(f"no such trees: {self}")


@dataclass(frozen=True)
class Column:
    """A binned column: a number with the upper bounds of its bins, or a category of ``size`` ordinals, split as one of them against the rest."""

    name: str
    edges: tuple[float, ...] = ()
    size: int = 0

    @property
    def width(self) -> int:
        """Codes of the column; the last is for missing cells."""
        return (self.size if self.size else len(self.edges) + 1) + 1

    def code(self, value: float | None) -> int:
        """The code that a fill value has."""
        if value is None:
            return self.width - 1
        return int(value) if self.size else int(np.searchsorted(self.edges, value, "left"))


@dataclass(frozen=True)
class Fit:
    """One model: the columns it may use, the codes that stand for missing cells, and the fold that it doesn't see (None: it sees all rows)."""

    name: str
    columns: tuple[str, ...]
    fills: dict[str, int]
    settings: Settings = field(default_factory=Settings)
    without: int | None = None
    seed: int = 42


class Trees(NamedTuple):
    """Complete binary trees as arrays [tree, node]; children of node i are 2i + 1 and 2i + 2. ``column`` is -1 at a leaf. A row goes left if its code is ``cut`` at most (numbers) or
    isn't ``cut`` (categories). ``cover`` is the number of training rows that came by."""

    base: float
    column: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    cover: np.ndarray


# -- blocks -----------------------------------------------------------------------------------------------------------------------


class Block(NamedTuple):
    codes: np.ndarray  #: [column, row], in as few bytes as the widest column needs
    label: np.ndarray
    fold: np.ndarray
    key: np.ndarray
    scores: dict[str, np.ndarray]  #: by fit, as of the last stored round


@dataclass
class Blocks:
    """Stored blocks of a frame and what their columns are."""

    table: DataFrame
    columns: list[Column]
    rows: int
    parts: int
    task_rows: int = TASK_ROWS

    @property
    def spark(self) -> SparkSession:
        return self.table.sparkSession


_STORED = "block binary"


def _pack(block: Block) -> bytes:
    return pickle.dumps(tuple(block), protocol=5)


def _unpack(data: bytes) -> Block:
    return Block(*pickle.loads(data))


def bin_edges(df: DataFrame, numeric: Sequence[str], bins: int = BINS) -> dict[str, tuple[float, ...]]:
    """Upper bounds of the bins of every number: its distinct values if they are few, else its quantiles, all in one pass. The last bin has no bound."""
    if not numeric:
        return {}
    cells = [F.percentile_approx(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), [k / bins for k in range(1, bins + 1)], 40 * bins).alias(str(i)) for i, c in enumerate(numeric)]
    found = df.agg(*cells).first()
    return {c: tuple(sorted(set(found[i] or ())))[:-1] for i, c in enumerate(numeric)}


def make_blocks(df: DataFrame, numeric: dict[str, tuple[float, ...]], categories: dict[str, int], label: str, key: SparkColumn, fold: str | None = None, block_rows: int | None = None) -> Blocks:
    """Bins ``df`` and stores it in blocks. ``numeric`` has the edges of each number, ``categories`` the number of ordinals of each int column; null cells are missing.

    ``key`` is a long that tells rows apart in draws; ``fold`` is the fold that a row is held out in. A frame of more than one block has one for every core.
    Where ``block_rows`` is given, no task of a fit holds more rows than that.
    """
    task_rows = block_rows or TASK_ROWS
    block_rows = block_rows or BLOCK_ROWS
    columns = [Column(c, e) for c, e in numeric.items()] + [Column(c, size=max(1, n)) for c, n in categories.items()]
    cells = [*(F.col(f"`{c}`").cast("double") for c in numeric), *(F.col(f"`{c}`").cast("int") for c in categories)]
    kind = np.min_scalar_type(max((c.width - 1 for c in columns), default=0))
    picked = df.select(*(c.alias(f"c{i}") for i, c in enumerate(cells)), F.col(label).cast("double").alias("y"), (F.col(fold) if fold else F.lit(-1)).cast("int").alias("fold"), key.cast("long").alias("key"))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Block] = []

        def packed() -> pa.RecordBatch:
            joined = Block(np.concatenate([b.codes for b in held], 1), *(np.concatenate([b[k] for b in held]) for k in (1, 2, 3)), {})
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([_pack(joined)], pa.binary())], names=["block"])

        for batch in rows:
            for at in range(0, batch.num_rows, block_rows):
                part = batch.slice(at, block_rows)
                codes = np.empty((len(columns), part.num_rows), kind)
                for i, c in enumerate(columns):
                    cell = part.column(i).to_numpy(zero_copy_only=False).astype(float)
                    none = np.isnan(cell)
                    own = cell if c.size else np.searchsorted(c.edges, cell, "left")
                    codes[i] = np.where(none, c.width - 1, np.where(none, 0, own)).astype(kind)
                n = len(columns)
                made = Block(codes, part.column(n).to_numpy(), part.column(n + 1).to_numpy(), part.column(n + 2).to_numpy(), {})
                if held and sum(len(b.label) for b in held) + len(made.label) > block_rows:
                    yield packed()
                held.append(made)
        if held:
            yield packed()

    n = df.count()
    parts = max(1, -(-n // block_rows))
    if parts > 1:
        parts = max(parts, min(df.sparkSession.sparkContext.defaultParallelism, -(-n // LEAST_ROWS)))
    table = _stored(picked.repartition(parts).mapInArrow(run, _STORED))
    return Blocks(table, columns, n, table.count(), task_rows)


def _stored(df: DataFrame) -> DataFrame:
    path = scratch(df.sparkSession, "blocks")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# -- one level --------------------------------------------------------------------------------------------------------------------


def _mixed(key: np.ndarray, *salts: int) -> np.ndarray:
    """Uniform numbers in (0, 1) by row and salts, the same wherever a row is."""
    x = key.astype(np.int64).view(np.uint64)
    for salt in salts:
        x = (x ^ np.uint64(salt % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(32)
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)


class Layout:
    """Places of the bins of a fit's columns in one array, cut into slices: numbers stay whole, categories may be cut anywhere."""

    def __init__(self, fit: Fit, columns: Sequence[Column]):
        place = {c.name: i for i, c in enumerate(columns)}
        self.at = [place[name] for name in fit.columns]
        self.columns = [columns[i] for i in self.at]
        widths = self.widths = np.array([c.width for c in self.columns], np.int64)
        self.starts = np.r_[0, np.cumsum(widths)]
        self.total = int(self.starts[-1])
        self.fill = np.array([fit.fills.get(c.name, c.width - 1) for c in self.columns], np.int64)
        self.owner = np.repeat(np.arange(len(widths)), widths)
        self.code = np.arange(self.total) - self.starts[self.owner]
        self.category = np.array([c.size > 0 for c in self.columns], bool)
        cuts, size = [0], 0
        for k, c in enumerate(self.columns):
            if size and size + c.width > SLICE:
                cuts.append(int(self.starts[k]))
                size = 0
            if c.size:
                cuts += range(int(self.starts[k]) + SLICE, int(self.starts[k + 1]), SLICE)
            size += c.width
        self.cuts = sorted({*cuts, self.total})

    def codes(self, block: Block, rows: np.ndarray | None) -> np.ndarray:
        """[column, row] with fills in the place of missing cells."""
        own = block.codes[self.at] if rows is None else block.codes[self.at][:, rows]
        last = np.array([c.width - 1 for c in self.columns])[:, None]
        return np.where(own == last, self.fill[:, None], own)

    def allowed(self, fit: Fit, round_: int) -> np.ndarray:
        """Bins that the tree of a round may split at; a category is a column of its own. Codes of missing cells and the last bin of a number are none."""
        ok = np.where(self.category[self.owner], self.code < np.diff(self.starts)[self.owner] - 1, self.code < np.diff(self.starts)[self.owner] - 2)
        share = fit.settings.column_share
        if share < 1:
            unit = np.where(self.category[self.owner], self.code + 1, 0) * 4096 + self.owner
            drawn = _mixed(unit, fit.seed, round_, 11)
            kept = drawn < share
            if not (ok & kept).any():
                kept = drawn == drawn[ok].min() if ok.any() else kept
            ok &= kept
        return ok


def _seen(fit: Fit, block: Block) -> np.ndarray:
    return np.flatnonzero(block.fold != fit.without) if fit.without is not None else np.arange(len(block.label))


def gradients(fit: Fit, label: np.ndarray, key: np.ndarray, score: np.ndarray, round_: int) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the logistic loss as whole numbers of 2^-30; rows that the round doesn't draw have none."""
    p = 1 / (1 + np.exp(-score))
    g, h = p - label, p * (1 - p)
    if fit.settings.row_share < 1:
        drawn = _mixed(key, fit.seed, round_, 5) < fit.settings.row_share
        g, h = g * drawn, h * drawn
    if fit.settings.temperature:
        weight = np.minimum((-np.log(_mixed(key, fit.seed, round_, 7))) ** fit.settings.temperature, 16.0)
        g, h = g * weight, h * weight
    return np.rint(g * SCALE), np.rint(h * SCALE)


def histogram(
    codes: np.ndarray, layout: Layout, node: np.ndarray, n_nodes: int, weights: Sequence[np.ndarray], rows: np.ndarray | None = None, wanted: np.ndarray | None = None,
) -> np.ndarray:
    """[weight, node, bin]: sums of each weight over the rows of a node with a code, all columns side by side. Rows with node ``n_nodes`` are left out, and so
    are those that aren't among ``rows`` and the columns of the fit that aren't ``wanted``, where these are given.

    ``codes`` are as stored, of all columns of the frame; sums of missing cells are added to those of the code that stands for them.
    """
    n = len(node) if rows is None else len(rows)
    out = np.zeros((len(weights), n_nodes, layout.total), np.int64)
    step = EXACT if n_nodes * layout.total > CHUNK * len(layout.at) else CHUNK
    for low in range(0, n, max(1, step)):
        at = slice(low, low + step) if rows is None else rows[low:low + step]
        own, *drawn = (x[at] if rows is None else x.take(at) for x in (node, *weights))
        _add_histogram(out, codes, at, layout, own, n_nodes, drawn, wanted)
    return out


def _add_histogram(
    out: np.ndarray, codes: np.ndarray, rows: slice | np.ndarray, layout: Layout, node: np.ndarray, n_nodes: int, weights: Sequence[np.ndarray], wanted: np.ndarray | None,
) -> None:
    spread: dict[int, np.ndarray] = {}
    for i, (at, start, width, fill) in enumerate(zip(layout.at, layout.starts, layout.widths.tolist(), layout.fill)):
        if wanted is not None and not wanted[i]:
            continue
        step = 1 << (width - 1).bit_length() if width <= 4096 else width
        if step not in spread:
            spread[step] = node.astype(np.intp) * step
        key = spread[step] + (codes[at][rows] if isinstance(rows, slice) else codes[at].take(rows))
        for k, w in enumerate(weights):
            # Sums of so few rows are below 2^53, so they are whole as doubles; they are added up as integers.
            found = np.bincount(key, w, (n_nodes + 1) * step)[:n_nodes * step].reshape(n_nodes, step)
            out[k, :, start:start + width - 1] += found[:, :width - 1].astype(np.int64)
            out[k, :, start + fill] += found[:, width - 1].astype(np.int64)


def _reduced(g: np.ndarray, l1: float) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0) if l1 else g


def best_splits(layout: Layout, fit: Fit, low: int, high: int, sums: np.ndarray, totals: np.ndarray, ok: np.ndarray, round_: int) -> list[tuple[float, int]]:
    """(gain, bin) of the best split of every node among the bins low to high; the first of equal ones, gain 0 if there is none.

    ``sums`` and ``totals`` are [2, node, bin] and [2, node]. Left of a number are its bins up to the cut, left of a category all but the cut.
    """
    s = fit.settings
    owner, code = layout.owner[low:high], layout.code[low:high]
    running = np.cumsum(sums, axis=2)
    first = np.maximum(layout.starts[owner] - low, 0)  # where the column begins in this slice; numbers are whole
    before = np.where(first > 0, np.take(running, np.maximum(first - 1, 0), axis=2), 0)
    left = np.where(layout.category[owner], totals[:, :, None] - sums, running - before) / SCALE
    whole = totals[:, :, None] / SCALE
    right = whole - left

    def worth(g: np.ndarray, h: np.ndarray) -> np.ndarray:
        return _reduced(g, s.l1) ** 2 / np.maximum(h + s.l2, 1e-12)

    gain = 0.5 * (worth(*left) + worth(*right) - worth(*whole)) - s.gain
    good = ok[low:high] & (left[1] >= max(s.least_weight, 1e-9)) & (right[1] >= max(s.least_weight, 1e-9)) & (gain > 1e-9)
    if s.noise:
        place = (np.arange(sums.shape[1])[:, None] << 32) + np.arange(low, high)
        draw = np.sqrt(-2 * np.log(_mixed(place, fit.seed, round_, 13))) * np.cos(2 * np.pi * _mixed(place, fit.seed, round_, 17))
        gain = gain + s.noise * draw / (1 + round_)
    gain = np.where(good, gain, -np.inf)
    at = gain.argmax(1)
    top = gain[np.arange(len(at)), at]
    return [(float(v) if np.isfinite(v) else 0.0, int(a) + low if np.isfinite(v) else -1) for v, a in zip(top, at)]


class Tree:
    """A tree while it grows."""

    def __init__(self, depth: int):
        n = (1 << depth + 1) - 1
        self.column, self.cut, self.value, self.cover = np.full(n, -1, np.int32), np.zeros(n, np.int32), np.zeros(n), np.zeros(n, np.int64)


class Way:
    """Where the nodes of a tree send rows, by the codes that are stored: right if a code is above ``low`` and ``high`` at most, or if it is ``also``. A
    missing cell goes where its fill goes. Leaves send rows to themselves."""

    def __init__(self, column: np.ndarray, cut: np.ndarray, at: np.ndarray, widths: np.ndarray, category: np.ndarray, fill: np.ndarray):
        inner, nodes = column >= 0, np.arange(len(column))
        if not inner.any():
            at, widths, category, fill = (np.zeros(1, x.dtype) for x in (at, widths, category, fill))
        own = np.where(inner, column, 0)
        last, chosen = widths[own] - 1, category[own]
        filled = np.where(chosen, fill[own] == cut, fill[own] > cut)
        self.at = at[own]
        self.low = np.where(inner, np.where(chosen, cut - 1, cut), np.iinfo(np.int32).max).astype(np.int32)
        self.high = np.where(chosen, cut, np.where(filled, last, last - 1)).astype(np.int32)
        self.also = np.where(inner & chosen & filled, last, -1).astype(np.int32)
        self.left = np.where(inner, 2 * nodes + 1, nodes)

    def follow(self, codes: np.ndarray, node: np.ndarray, levels: int) -> np.ndarray:
        """Nodes of the rows as many levels below ``node``."""
        place, rows, flat, odd = self.at * codes.shape[1], np.arange(codes.shape[1]), codes.reshape(-1), (self.also >= 0).any()
        for _ in range(levels):
            code = flat[place[node] + rows] if len(flat) else np.zeros(len(rows), np.int32)
            right = (code > self.low[node]) & (code <= self.high[node])
            if odd:
                right |= code == self.also[node]
            node = self.left[node] + right
        return node

    def down(self, codes: np.ndarray, levels: int) -> np.ndarray:
        """Nodes of the rows as many levels below the root."""
        return self.follow(codes, np.zeros(codes.shape[1], np.int64), levels)


def _way(tree: Tree, layout: Layout) -> Way:
    return Way(tree.column, tree.cut, np.array(layout.at, np.int64), layout.widths, layout.category, layout.fill)


def _open(tree: Tree, level: int) -> list[int]:
    """Nodes of a level that rows can come to."""
    nodes = [0]
    for _ in range(level):
        nodes = [c for n in nodes if tree.column[n] >= 0 for c in (2 * n + 1, 2 * n + 2)]
    return nodes


def _dense(tree: Tree, nodes: list[int]) -> np.ndarray:
    """The number of each node among ``nodes``; all others have the number after the last."""
    out = np.full(len(tree.column), len(nodes), np.int64)
    out[nodes] = np.arange(len(nodes))
    return out


def leaf_value(s: Settings, total: np.ndarray) -> float:
    g, h = total / SCALE
    return float(-s.rate * _reduced(np.array(g), s.l1) / max(h + s.l2, 1e-12)) if h > 0 else 0.0


def grow(tree: Tree, layout: Layout, fit: Fit, nodes: list[int], sums: dict[int, np.ndarray], found: list[tuple[float, int]], left_sums: list[np.ndarray]) -> None:
    """Makes the found splits; ``sums`` has the totals of nodes and gets those of their children."""
    for node, (gain, place), left in zip(nodes, found, left_sums):
        if gain > 0:
            tree.column[node], tree.cut[node] = layout.owner[place], layout.code[place]
            sums[2 * node + 1], sums[2 * node + 2] = left, sums[node] - left


def left_of(layout: Layout, sums: np.ndarray, total: np.ndarray, place: int, low: int = 0) -> np.ndarray:
    """Totals left of a split, from the sums of a node by bin (which begin with bin ``low``)."""
    if layout.category[layout.owner[place]]:
        return total - sums[:, place - low]
    start = layout.starts[layout.owner[place]] - low
    return sums[:, start:place - low + 1].sum(1)


class Lanes:
    """The columns of a fit as one task counts and walks them: small ones share a lane, whose code tells the codes of all of them, and a missing cell has the
    code of its fill. To :func:`histogram` the lanes are the columns of a layout."""

    def __init__(self, layout: Layout):
        self.layout = layout
        own = [max(1, int(w) - (f != w - 1)) for w, f in zip(layout.widths, layout.fill)]  # without the code of missing cells, if they have another
        self.tables = max(own, default=0) <= TABLE
        self.members: list[list[int]] = []
        self.shapes: list[list[int]] = []
        for i in sorted(range(len(own)), key=lambda i: -own[i]):
            lane = next((k for k, shape in enumerate(self.shapes) if self.tables and np.prod(shape) * own[i] <= LANE), len(self.members))
            if lane == len(self.members):
                self.members.append([])
                self.shapes.append([])
            self.members[lane].append(i)
            self.shapes[lane].append(own[i])
        self.at = list(range(len(self.members)))
        self.widths = np.array([np.prod(shape) for shape in self.shapes], np.int64)
        self.starts = np.r_[0, np.cumsum(self.widths)]
        self.total = int(self.starts[-1])
        self.fill = self.widths - 1
        self.lane = np.zeros(len(own), np.int64)
        self.digits: list[np.ndarray] = [np.empty(0)] * len(own)  # a column's code by that of its lane
        for lane, (members, shape) in enumerate(zip(self.members, self.shapes)):
            self.lane[members] = lane
            if self.tables:
                for i, digits in zip(members, np.unravel_index(np.arange(self.widths[lane]), shape)):
                    self.digits[i] = digits

    def codes(self, block: Block, rows: np.ndarray | None) -> np.ndarray:
        """[lane, row]"""
        kind = np.min_scalar_type(int(self.widths.max(initial=1)) - 1)
        out = np.zeros((len(self.members), len(block.label) if rows is None else len(rows)), kind)
        for lane, (members, shape) in enumerate(zip(self.members, self.shapes)):
            for i, width in zip(members, shape):
                own = block.codes[self.layout.at[i]] if rows is None else block.codes[self.layout.at[i]][rows]
                out[lane] *= kind.type(width if len(members) > 1 else 1)
                out[lane] += np.where(own == self.layout.widths[i] - 1, self.layout.fill[i], own).astype(kind)
        return out

    def wanted(self, ok: np.ndarray) -> np.ndarray:
        """Lanes with a bin among ``ok``."""
        out = np.zeros(len(self.members), bool)
        out[self.lane[np.logical_or.reduceat(ok, self.layout.starts[:-1])]] = True
        return out

    def spread(self, sums: np.ndarray) -> np.ndarray:
        """[weight, node, bin] of the fit's columns from that of the lanes."""
        out = np.zeros((*sums.shape[:2], self.layout.total), np.int64)
        for lane, (members, shape) in enumerate(zip(self.members, self.shapes)):
            cells = sums[:, :, self.starts[lane]:self.starts[lane + 1]].reshape(*sums.shape[:2], *shape)
            for k, i in enumerate(members):
                start = self.layout.starts[i]
                out[:, :, start:start + shape[k]] = cells.sum(tuple(2 + j for j in range(len(shape)) if j != k)) if len(shape) > 1 else cells
        return out

    def follow(self, tree: Tree, codes: np.ndarray, node: np.ndarray, level: int) -> np.ndarray:
        """Nodes of the rows one level below ``level``; ``node`` has theirs so far."""
        nodes, n = (1 << level + 1) - 1, codes.shape[1]
        inner = np.flatnonzero(tree.column[:nodes] >= 0)
        if not self.tables:
            wide = np.full(len(self.lane), np.iinfo(np.int32).max, np.int64)  # there are no missing cells
            return _chunked(Way(tree.column, tree.cut, self.lane, wide, self.layout.category, wide - 1), codes, node)
        width = int(self.widths.max(initial=1))
        below = np.repeat(np.arange(nodes, dtype=node.dtype), width).reshape(nodes, width)
        place = np.zeros(nodes, np.intp)
        for k in inner:
            i = tree.column[k]
            digits = self.digits[i]
            below[k, :len(digits)] = 2 * k + 1 + (digits == tree.cut[k] if self.layout.category[i] else digits > tree.cut[k])
            place[k] = self.lane[i] * n
        below, flat, out = below.reshape(-1), codes.reshape(-1), np.empty_like(node)
        for low in range(0, n, CHUNK):
            at = node[low:low + CHUNK].astype(np.intp)
            cell = place.take(at)
            cell += np.arange(low, low + len(at))
            at *= width
            at += flat.take(cell)
            out[low:low + CHUNK] = below.take(at)
        return out


def _chunked(way: Way, codes: np.ndarray, node: np.ndarray) -> np.ndarray:
    out = np.empty_like(node)
    for low in range(0, len(node), EXACT):
        out[low:low + EXACT] = way.follow(np.ascontiguousarray(codes[:, low:low + EXACT]), node[low:low + EXACT], 1)
    return out


# -- a single block ---------------------------------------------------------------------------------------------------------------


def fit_block(fit: Fit, block: Block, columns: Sequence[Column]) -> Trees:
    """All rounds of one fit on one block."""
    return fit_blocks(fit, [block], columns)


def fit_blocks(fit: Fit, blocks: Iterable[Block], columns: Sequence[Column]) -> Trees:
    """All rounds of one fit on the rows of all blocks, of which one at a time is held whole."""
    s, layout = fit.settings, Layout(fit, columns)
    lanes = Lanes(layout)
    draws = s.row_share < 1 or s.temperature > 0
    parts = []
    for block in blocks:
        rows = _seen(fit, block) if fit.without is not None else None
        parts.append((lanes.codes(block, rows), *(x if rows is None else x[rows] for x in (block.label, block.key if draws else block.label[:0] if rows is None else block.label))))
    codes, label, key = (np.concatenate(x, -1) if len(x) > 1 else x[0] for x in zip(*parts))
    del parts
    n = len(label)
    base = base_score(float(label.sum()), n)
    score, grown = np.full(n, base), []
    g, h = np.empty(n), np.empty(n)
    for round_ in range(s.rounds):
        root = np.zeros(2, np.int64)
        for low in range(0, n, CHUNK):
            at = slice(low, low + CHUNK)
            g[at], h[at] = gradients(fit, label[at], key[at], score[at], round_)
            root += [int(g[at].sum()), int(h[at].sum())]
        tree, node, ok = Tree(s.depth), np.zeros(n, np.int16), layout.allowed(fit, round_)
        sums = {0: root}
        drawn = (g != 0) | (h != 0)
        wanted = lanes.wanted(ok) if layout.total else np.zeros(0, bool)
        above: dict[int, np.ndarray] = {}
        for level in range(s.depth):
            nodes = _open(tree, level)
            if not nodes:
                break
            found = _level_histogram(codes, lanes, node, nodes, (g, h), drawn, wanted, above)
            above = {n: found[:, i] for i, n in enumerate(nodes)}
            hist = lanes.spread(found)
            totals = np.stack([sums[n] for n in nodes], 1)
            best = best_splits(layout, fit, 0, layout.total, hist, totals, ok, round_)
            grow(tree, layout, fit, nodes, sums, best, [left_of(layout, hist[:, i], totals[:, i], place) if gain > 0 else None for i, (gain, place) in enumerate(best)])
            node = lanes.follow(tree, codes, node, level)
        _finish(tree, s, sums)
        for low in range(0, n, CHUNK):
            score[low:low + CHUNK] += tree.value[node[low:low + CHUNK]]
        tree.cover = _covers(np.bincount(node, minlength=len(tree.column)))
        grown.append(tree)
    return _trees(base, grown, layout)


def _level_histogram(
    codes: np.ndarray, layout: Layout, node: np.ndarray, nodes: list[int], weights: Sequence[np.ndarray], drawn: np.ndarray, wanted: np.ndarray, above: dict[int, np.ndarray],
) -> np.ndarray:
    """:func:`histogram` of the nodes of a level, for the ``drawn`` rows (others have no weight) and the ``wanted`` columns. Of two siblings only the rows of the
    smaller one are counted; the other has what is left of its parent's sums in ``above``, exactly, as sums are whole numbers."""
    counted = nodes
    chunks = [slice(low, low + CHUNK) for low in range(0, len(node), CHUNK)]
    if above:
        size = np.zeros((1 << 1 + max(nodes).bit_length()) + 1, np.int64)
        for at in chunks:
            size += np.bincount(node[at], drawn[at], len(size)).astype(np.int64)
        counted = [a if size[a] <= size[a + 1] else a + 1 for a in nodes[::2]]
    elif drawn.all():
        return histogram(codes, layout, node, len(nodes), weights, wanted=wanted)
    place = np.full((1 << 1 + max(nodes).bit_length()) + 1, -1, np.int16)
    place[counted] = np.arange(len(counted))
    own, rows = np.empty(len(node), np.int16), [np.empty(0, np.intp)]
    for at in chunks:
        place.take(node[at], out=own[at], mode="clip")
        rows.append(np.flatnonzero((own[at] >= 0) & drawn[at]) + at.start)
    found = histogram(codes, layout, own, len(counted), weights, np.concatenate(rows), wanted)
    if not above:
        return found
    out = np.empty((len(weights), len(nodes), layout.total), np.int64)
    at = {n: i for i, n in enumerate(nodes)}
    for i, n in enumerate(counted):
        other = n + 1 if n % 2 else n - 1
        out[:, at[n]] = found[:, i]
        out[:, at[other]] = above[(n - 1) // 2] - found[:, i]
    return out


def base_score(positives: float, rows: int) -> float:
    """Log-odds of the rows, kept finite where one class is absent."""
    share = min(max(positives / max(1, rows), 1e-6), 1 - 1e-6)
    return float(np.log(share / (1 - share)))


def _finish(tree: Tree, s: Settings, sums: dict[int, np.ndarray]) -> None:
    for node, total in sums.items():
        if tree.column[node] < 0:
            tree.value[node] = leaf_value(s, total)


def _covers(at_leaves: np.ndarray) -> np.ndarray:
    out = at_leaves.astype(np.int64)
    for node in range(len(out) - 1, 0, -1):
        out[(node - 1) // 2] += out[node]
    return out


def _trees(base: float, grown: list[Tree], layout: Layout) -> Trees:
    """Columns by their number among all columns of the frame."""
    at = np.array([*layout.at, -1], np.int32)
    return Trees(base, *(np.stack(x) if x else np.empty((0, 1)) for x in ([at[t.column] for t in grown], [t.cut for t in grown], [t.value for t in grown], [t.cover for t in grown])))


# -- many blocks ------------------------------------------------------------------------------------------------------------------


def _fit_apart(blocks: Blocks, fits: Sequence[Fit]) -> dict[str, Trees]:
    """Every fit is a task, which reads the stored blocks; those that take longest come first."""
    context, columns = blocks.spark.sparkContext, blocks.columns
    ordered = sorted(fits, key=lambda f: -f.settings.rounds * f.settings.depth)
    known = context.broadcast(ordered)
    whole = blocks.table.rdd.coalesce(1)

    def run(i: int, held: Iterator) -> Iterator[tuple[str, bytes]]:
        fit = known.value[i]
        yield fit.name, pickle.dumps(tuple(fit_blocks(fit, (_unpack(row[0]) for row in held), columns)))

    found = context.union([whole] * len(ordered)).mapPartitionsWithIndex(run).collect()
    return {name: Trees(*pickle.loads(data)) for name, data in found}


def _current(fit: Fit, layout: Layout, codes: np.ndarray, score: np.ndarray, since: Sequence[Tree]) -> np.ndarray:
    for tree in since:
        score = score + tree.value[_way(tree, layout).down(codes, fit.settings.depth)]
    return score


def _held(stored: DataFrame) -> RDD:
    return stored.rdd.map(lambda row: _unpack(row[0])).persist(StorageLevel.MEMORY_AND_DISK)


def _fit_together(blocks: Blocks, fits: Sequence[Fit]) -> dict[str, Trees]:
    """A frame of many blocks: every level of every round is one aggregate over all fits."""
    spark, columns = blocks.spark, blocks.columns
    context = spark.sparkContext
    layouts = {f.name: Layout(f, columns) for f in fits}
    by_name = {f.name: f for f in fits}
    known = context.broadcast((by_name, layouts))
    spare = max(1, min(context.defaultParallelism, sum(len(layouts[f.name].cuts) - 1 for f in fits)))

    def counted(held: Iterator[Block]) -> Iterator[tuple[str, np.ndarray]]:
        for block in held:
            for f in known.value[0].values():
                label = block.label[_seen(f, block)]
                yield f.name, np.array([label.sum(), len(label)])

    stored = blocks.table
    held = _held(stored)
    whole = dict(held.mapPartitions(counted).reduceByKey(np.add, spare).collect())
    base = {f.name: base_score(*map(float, whole.get(f.name, (0, 0)))) for f in fits}
    grown: dict[str, list[Tree]] = {f.name: [] for f in fits}
    done: RDD | None = None  # the blocks with the scores of the round before
    kept = 0  # rounds whose scores are stored with the blocks
    rounds = max(f.settings.rounds for f in fits)
    for round_ in range(rounds):
        going = [f.name for f in fits if round_ < f.settings.rounds]
        depth = {f.name: f.settings.depth for f in fits}
        trees = {name: Tree(depth[name]) for name in going}
        sums: dict[str, dict[int, np.ndarray]] = {name: {} for name in going}
        for level in range(max(depth[name] for name in going)):
            opened = {name: nodes for name in going if level < depth[name] and (nodes := _open(trees[name], level))}
            if not opened:
                break
            grows = {name: trees[name] for name in opened}
            totals = {name: np.stack([sums[name][n] for n in nodes], 1) for name, nodes in opened.items() if level}

            def hists(held: Iterator[Block], round_=round_, level=level, grows=grows, opened=opened) -> Iterator[tuple[tuple[str, int], np.ndarray]]:
                known_fits, known_layouts = known.value
                out: dict[tuple[str, int], np.ndarray] = {}
                for block in held:
                    for name, nodes in opened.items():
                        f, layout, tree = known_fits[name], known_layouts[name], grows[name]
                        score = block.scores[name] if name in block.scores else np.full(len(block.label), base[name])
                        g, h = gradients(f, block.label, block.key, score, round_)
                        node = _dense(tree, nodes)[_way(tree, layout).down(block.codes, level)]
                        if f.without is not None:
                            node = np.where(block.fold != f.without, node, len(nodes))
                        hist = histogram(block.codes, layout, node, len(nodes), (g, h))
                        if not level:  # each slice of the root knows the root's totals
                            mine = node == 0
                            whole = np.array([g @ mine, h @ mine]).astype(np.int64).reshape(2, 1, 1)
                        for k, (low, high) in enumerate(zip(layout.cuts, layout.cuts[1:])):
                            own = hist[:, :, low:high] if level else np.concatenate([hist[:, :, low:high], whole], 2)
                            out[name, k] = out[name, k] + own if (name, k) in out else own
                yield from out.items()

            def best(item, round_=round_, level=level, totals=totals):
                (name, k), hist = item
                f, layout = known.value[0][name], known.value[1][name]
                low, high = layout.cuts[k], layout.cuts[k + 1]
                total = totals[name] if level else hist[:, :, -1]
                hist = hist[:, :, :high - low]
                found = best_splits(layout, f, low, high, hist, total, layout.allowed(f, round_), round_)
                return name, k, total, [(gain, place, left_of(layout, hist[:, i], total[:, i], place, low) if gain > 0 else None) for i, (gain, place) in enumerate(found)]

            slices = sorted(held.mapPartitions(hists).reduceByKey(np.add, spare).map(best).collect(), key=lambda x: x[:2])
            if done is not None:
                done.unpersist()
                done = None
            for name, nodes in opened.items():
                mine = [(total, found) for other, _, total, found in slices if other == name]
                if mine:
                    if not level:
                        sums[name][0] = mine[0][0][:, 0]
                    top = [max(options, key=lambda o: o[0]) for options in zip(*(found for _, found in mine))]  # the first slice of equal ones
                    grow(trees[name], layouts[name], by_name[name], nodes, sums[name], [t[:2] for t in top], [t[2] for t in top])
        for name in going:
            _finish(trees[name], by_name[name].settings, sums[name])
            grown[name].append(trees[name])
        done = held
        if round_ + 1 == rounds:
            break
        if round_ + 1 - kept == STORE_ROUNDS:
            stored, kept = _scored(stored, fits, layouts, grown, kept, base), round_ + 1
            held = _held(stored)
        else:
            held = _advanced(held, known, trees, base)
    for one in (held, done):
        if one is not None:
            one.unpersist()

    def covers(held: Iterator[Block]) -> Iterator[tuple[str, np.ndarray]]:
        own = shared.value
        for block in held:
            for name, f in known.value[0].items():
                layout, codes = known.value[1][name], np.ascontiguousarray(block.codes[:, _seen(f, block)])
                yield name, np.stack([np.bincount(_way(t, layout).down(codes, f.settings.depth), minlength=len(t.column)) for t in own[name]])

    shared = context.broadcast(grown)
    for name, found in blocks.table.rdd.map(lambda row: _unpack(row[0])).mapPartitions(covers).reduceByKey(np.add, spare).collect():
        for tree, own in zip(grown[name], found):
            tree.cover = _covers(own)
    return {f.name: _trees(base[f.name], grown[f.name], layouts[f.name]) for f in fits}


def _advanced(held: RDD, known, trees: dict[str, Tree], base: dict[str, float]) -> RDD:
    """The blocks with scores that the trees of a round were added to."""

    def run(block: Block) -> Block:
        scores = {}
        for name, tree in trees.items():
            own = block.scores[name] if name in block.scores else np.full(len(block.label), base[name])
            scores[name] = _current(known.value[0][name], known.value[1][name], block.codes, own, [tree])
        return block._replace(scores=scores)

    return held.map(run).persist(StorageLevel.MEMORY_AND_DISK)


def _scored(stored: DataFrame, fits: Sequence[Fit], layouts: dict[str, Layout], grown: dict[str, list[Tree]], kept: int, base: dict[str, float]) -> DataFrame:
    """The blocks with the scores of all rounds so far, as a new table: lineage ends here."""
    shared = stored.sparkSession.sparkContext.broadcast(pickle.dumps({f.name: grown[f.name][kept:] for f in fits}))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        since = pickle.loads(shared.value)
        for batch in rows:
            for data in batch.column(0).to_pylist():
                block = _unpack(data)
                scores = {}
                for f in fits:
                    own = block.scores.get(f.name, np.full(len(block.label), base[f.name]))
                    scores[f.name] = _current(f, layouts[f.name], block.codes, own, since[f.name])
                yield pa.RecordBatch.from_arrays([pa.array([_pack(block._replace(scores=scores))], pa.binary())], names=["block"])

    return _stored(stored.mapInArrow(run, _STORED))


def fit_many(blocks: Blocks, fits: Sequence[Fit]) -> dict[str, Trees]:
    """The trees of every fit. Names must differ; an empty frame gives trees without a split.

    A fit that sees no row has the score of an even chance. Ties between splits go to the first column of the fit, then to the first bin.
    """
    if len({f.name for f in fits}) < len(fits):
        raise ValueError("fits need names of their own")
    if not fits:
        return {}
    known = {c.name for c in blocks.columns}
    for f in fits:
        if missing := sorted(set(f.columns) - known):
            raise ValueError(f"{f.name} asks for columns that aren't binned: {missing}")
    if not blocks.rows:
        none = [Tree(f.settings.depth) for f in fits]
        return {f.name: _trees(0.0, [t] * f.settings.rounds, Layout(f, blocks.columns)) for f, t in zip(fits, none)}
    return _fit_apart(blocks, fits) if blocks.parts == 1 or blocks.rows <= blocks.task_rows else _fit_together(blocks, fits)


# -- scoring ----------------------------------------------------------------------------------------------------------------------


def margins(trees: Trees, codes: np.ndarray, category: np.ndarray) -> np.ndarray:
    """Log-odds of rows given as codes [column, row]; ``category`` tells which columns are categories."""
    out = np.full(codes.shape[1], trees.base)
    depth = int(trees.column.shape[1] + 1).bit_length() - 2
    codes = np.ascontiguousarray(codes, np.int32)
    # Codes come with their fills, so any width will do that no code reaches.
    at, widths = np.arange(len(codes)), np.full(len(codes), np.iinfo(np.int32).max, np.int64)
    for column, cut, value in zip(trees.column, trees.cut, trees.value):
        out += value[Way(column, cut, at, widths, category, widths - 1).down(codes, depth)]
    return out


def swapped_margins(trees: Trees, codes: np.ndarray, category: np.ndarray, sources: np.ndarray, given: np.ndarray) -> np.ndarray:
    """[source, row]: :func:`margins` of the rows with the codes of one source feature after the other taken from ``given`` [column, row].

    Only the trees that split at a feature are walked again for it; a row's leaves are added up in the order of the trees, so the scores are the same to the last bit.
    """
    depth = int(trees.column.shape[1] + 1).bit_length() - 2
    codes, given = np.ascontiguousarray(codes, np.int32), np.ascontiguousarray(given, np.int32)
    at, widths = np.arange(len(codes)), np.full(len(codes), np.iinfo(np.int32).max, np.int64)
    ways = [Way(column, cut, at, widths, category, widths - 1) for column, cut in zip(trees.column, trees.cut)]
    plain = np.stack([value[way.down(codes, depth)] for way, value in zip(ways, trees.value)]) if ways else np.empty((0, codes.shape[1]))
    out = np.empty((int(sources.max()) + 1 if len(sources) else 0, codes.shape[1]))
    for f in range(len(out)):
        own = np.where((sources == f)[:, None], given, codes)
        score = np.full(codes.shape[1], trees.base)
        for k, way in enumerate(ways):
            used = trees.column[k][trees.column[k] >= 0]
            score += trees.value[k][way.down(own, depth)] if (sources[used] == f).any() else plain[k]
        out[f] = score
    return out


# -- attributions -----------------------------------------------------------------------------------------------------------------


def _leaf_paths(column: np.ndarray, cover: np.ndarray) -> list[tuple[int, list[tuple[int, int]]]]:
    """(leaf, nodes that lead to it with the side taken) of every leaf that training rows came to."""
    out, todo = [], [(0, [])]
    while todo:
        node, path = todo.pop()
        if column[node] < 0:
            out.append((node, path))
            continue
        for side in (0, 1):
            child = 2 * node + 1 + side
            if cover[child] > 0:
                todo.append((child, [*path, (node, side)]))
    return out


def shapley(trees: Trees, codes: np.ndarray, category: np.ndarray, sources: np.ndarray, n_sources: int) -> np.ndarray:
    """[source, row]: exact Shapley values of the log-odds, features that aren't known being averaged over as the training rows went (path-dependent).

    ``sources`` names the feature that each column belongs to. A leaf's part of the score is its value times a product over the features on its path: 1 or 0 for a
    known feature (does the row go this way), the share of training rows that went this way for an unknown one. A feature's Shapley value is the
    leaf's value times the difference of both factors, times the weighted sum over all sets of the others, which are the coefficients of the polynomial
    prod(share + known * t). It takes the square of the path's length per leaf, for all rows at once.
    """
    out = np.zeros((n_sources, codes.shape[1]))
    for column, cut, value, cover in zip(trees.column, trees.cut, trees.value, trees.cover):
        if not cover[0]:
            continue
        goes = {}
        for leaf, path in _leaf_paths(column, cover):
            if not path or value[leaf] == 0:
                continue
            share: dict[int, float] = {}
            known: dict[int, np.ndarray] = {}
            for node, side in path:
                own = column[node]
                if node not in goes:
                    goes[node] = codes[own] == cut[node] if category[own] else codes[own] > cut[node]
                right = goes[node]
                f = int(sources[own])
                share[f] = share.get(f, 1.0) * cover[2 * node + 1 + side] / cover[node]
                step = right if side else ~right
                known[f] = known[f] & step if f in known else step
            # A row's part is decided by the features whose way it goes: it is worked out once for each set of them, where these are fewer than the rows.
            features = list(share)
            if 1 << len(features) < codes.shape[1]:
                pattern = np.zeros(codes.shape[1], np.intp)
                for k, f in enumerate(features):
                    pattern |= known[f].astype(np.intp) << k
                sets = np.arange(1 << len(features))
                table = _leaf_parts(value[leaf], [share[f] for f in features], [(sets >> k & 1).astype(bool) for k in range(len(features))])
                for f, part in zip(features, table):
                    out[f] += part[pattern]
            else:
                for f, part in zip(features, _leaf_parts(value[leaf], [share[f] for f in features], [known[f] for f in features])):
                    out[f] += part
    return out


def _leaf_parts(value: float, shares: Sequence[float], known: Sequence[np.ndarray]) -> list[np.ndarray]:
    """What a leaf adds to the value of each feature on its path, for rows that go its way (``known``) or don't."""
    weights = _set_weights(len(shares))
    # Coefficients of prod (share + known t) over all features; one factor at a time is divided out again.
    whole = np.zeros((len(shares) + 1, len(known[0])))
    whole[0] = 1
    for share, own in zip(shares, known):
        whole[1:] = whole[1:] * share + whole[:-1] * own
        whole[0] *= share
    return [value * (own - share) * (weights @ _divided(whole, share, own)) for share, own in zip(shares, known)]


def _set_weights(m: int) -> np.ndarray:
    """k! (m - 1 - k)! / m! for k known ones among the m - 1 others."""
    out = np.empty(m)
    out[0] = 1 / m
    for k in range(1, m):
        out[k] = out[k - 1] * k / (m - k)
    return out


def _divided(whole: np.ndarray, share: float, known: np.ndarray) -> np.ndarray:
    """The polynomial without the factor share + known t; shares are positive, as training rows came by."""
    rest = np.empty((len(whole) - 1, whole.shape[1]))
    # With a known way the leading coefficient is divided by 1, which is exact from above; without, all by the share.
    above = np.zeros(whole.shape[1])
    for k in range(len(rest) - 1, -1, -1):
        above = whole[k + 1] - share * above
        rest[k] = above
    return np.where(known, rest, whole[:-1] / share)


def expected(trees: Trees) -> float:
    """The score of a row of which nothing is known: the mean over the training rows."""
    total = trees.base
    for column, value, cover in zip(trees.column, trees.value, trees.cover):
        if cover[0]:
            total += sum(value[leaf] * cover[leaf] for leaf, _ in _leaf_paths(column, cover)) / cover[0]
    return float(total)
