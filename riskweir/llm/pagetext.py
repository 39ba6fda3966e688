"""Main text of web pages by a graphical model on the tree of each page.

Every node of the tree (an element that lays out blocks, or a run of text) is main text or not. A node has a potential from its features, an edge one from
the kinds of parent and child for each of the four joint states. As the graph is a tree, one pass of sum-product messages up and one down gives the
exact marginal of every node; the gradient of the log-likelihood of labelled pages needs the same marginals.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from riskweir.llm.common import pieces
from riskweir.llm.dom import Tree, parse
from riskweir.llm.labelled_pages import labelled_pages

#: Slots of node features and of edge features (hashed).
NODES, EDGES = 1 << 18, 1 << 12
#: Labelled pages that a model is fitted on at most.
MOST_LABELLED = 4000
SHORT = 6
#: Children of a node, or of a group of them.
FEW = 8


class Model(NamedTuple):
    node: np.ndarray  #: log-potential of "main text" of each feature
    edge: np.ndarray  #: log-potentials of (0, 0), (0, 1), (1, 0), (1, 1) of each kind of edge


class Graph(NamedTuple):
    """Trees of several pages: all nodes in one array, a parent before its children; -1 is the parent of a root."""

    parent: np.ndarray
    levels: list[np.ndarray]  #: nodes by depth, from the roots on
    features: np.ndarray
    starts: np.ndarray  #: where the features of each node begin
    edges: np.ndarray  #: two slots of each node's edge to its parent


@lru_cache(1 << 16)
def _slot(kind: str, value: object) -> int:
    return crc32(f"{kind} {value}".encode()) % NODES


@lru_cache(1 << 14)
def _named(tag: str, words: tuple[str, ...]) -> tuple[int, ...]:
    return (_slot("any", ""), _slot("tag", tag), *(_slot("word", w) for w in words), _slot("named", bool(words)))


@lru_cache(1 << 14)
def _measured(tag: str, size: int, links: int, leaves: int, share: int) -> tuple[int, ...]:
    kind = "text" if tag == "#text" else "element"
    return (_slot(f"{kind} size", size), _slot(f"{kind} links", links), _slot(f"{kind} leaves", leaves), _slot(f"{kind} share", share), _slot(f"{tag} links", links), _slot(f"{kind} size links", (size, links)))


@lru_cache(1 << 12)
def _edge(parent: str, child: str) -> tuple[int, int]:
    return crc32(f"{parent} {child}".encode()) % (EDGES - 1) + 1, 0


def _said(text: str) -> list[int]:
    """Features of what a run of text says, if it is short; signs of page furniture otherwise."""
    out = [_slot("end", text[-1] if text[-1] in ".!?:,;" else "other")]
    if "©" in text:
        out.append(_slot("sign", "©"))
    words = text.split(" ", SHORT + 1)
    if len(words) <= SHORT:
        out += [_slot("says", w.strip(".,:!?").lower()) for w in words]
        out += [_slot("few words", len(words)), _slot("says all", text.lower())]
    return out


def _scale(n: float) -> int:
    return int(n).bit_length()


def graph(trees: Sequence[Tree]) -> Graph:
    """The nodes of all trees in order, then the groups.

    An element with more than FEW children has them in groups of FEW, and those in groups again, so that a node gets a bounded
    number of messages: else a thousand short lines would outvote what their element says.
    """
    n = sum(len(tree.parent) for tree in trees)
    parents, depths, edges, flat, counts, groups = [-1] * n, [0] * n, [], [], [], []
    base = 0
    for tree in trees:
        own = len(tree.parent)
        size = [len(t) if t else 0 for t in tree.text]
        links, leaves = list(tree.links), [1 if t else 0 for t in tree.text]
        children: list[list[int]] = [[] for _ in range(own)]
        for k in range(own - 1, 0, -1):
            up = tree.parent[k]
            size[up] += size[k]
            links[up] += links[k]
            leaves[up] += leaves[k]
            children[up].append(k + base)
        whole = max(1, size[0])
        for k in range(own):
            tag, below = tree.tag[k], children[k][::-1]
            levels = [below]
            while len(levels[-1]) > FEW:
                levels.append([n + len(groups) + i for i in range(-(-len(levels[-1]) // FEW))])
                groups += [tag] * len(levels[-1])
                parents += [-1] * len(levels[-1])
                depths += [0] * len(levels[-1])
            above = [k + base]
            for level in reversed(levels):
                for i, node in enumerate(level):
                    parents[node] = above[i // FEW]
                    depths[node] = depths[above[i // FEW]] + 1
                above = level
            up = tree.parent[k]
            edges.append(_edge("" if up < 0 else tree.tag[up] + "+" * (len(children[up]) > FEW), tag))
            features = (
                *_named(tag, tree.words[k]), *(_said(tree.text[k]) if tree.text[k] else ()),
                *_measured(tag, min(12, _scale(size[k])), round(5 * links[k] / size[k]) if size[k] else -1, min(6, _scale(leaves[k])), round(4 * size[k] / whole)),
            )
            flat += features
            counts.append(len(features))
        base += own
    for tag in groups:
        edges.append(_edge(tag, "+"))
        flat.append(_slot("group", tag))
        counts.append(1)
    depth = np.array(depths, np.int64)
    order = np.argsort(depth, kind="stable")
    levels = np.split(order, np.flatnonzero(np.diff(depth[order])) + 1) if len(order) else []
    return Graph(np.array(parents, np.int64), levels, np.array(flat, np.int64), np.r_[0, np.cumsum(counts)].astype(np.int64), np.array(edges, np.int64).reshape(-1, 2))


def _potentials(g: Graph, model: Model) -> tuple[np.ndarray, np.ndarray]:
    return np.add.reduceat(model.node[g.features], g.starts[:-1]), model.edge[g.edges].sum(1).reshape(-1, 2, 2)


def marginals(g: Graph, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Probability of main text of each node, and the joint one (parent, child) of each edge, by sum-product in log space."""
    node, edge = _potentials(g, model)
    n = len(node)
    inside = np.zeros((n, 2))  # own potential and all messages from below
    inside[:, 1] = node
    sent = np.zeros((n, 2))
    for level in reversed(g.levels[1:]):
        sent[level] = np.logaddexp.reduce(edge[level] + inside[level][:, None, :], axis=2)
        np.add.at(inside, g.parent[level], sent[level])
    outside = np.zeros((n, 2))  # messages from above
    joint = np.zeros((n, 2, 2))
    for level in g.levels[1:]:
        up = g.parent[level]
        around = outside[up] + inside[up] - sent[level]  # the parent without this child
        both = around[:, :, None] + edge[level] + inside[level][:, None, :]
        outside[level] = np.logaddexp.reduce(around[:, :, None] + edge[level], axis=1)
        joint[level] = np.exp(both - np.logaddexp.reduce(both.reshape(-1, 4), axis=1)[:, None, None])
    belief = inside + outside
    return np.exp(belief[:, 1] - np.logaddexp.reduce(belief, axis=1)), joint


def labels(tree: Tree) -> np.ndarray:
    """1 for runs of main text by the innermost mark around them."""
    marked, out = [False] * len(tree.parent), np.zeros(len(tree.parent))
    for k, up in enumerate(tree.parent):
        marked[k] = tree.label[k] == "1" if tree.label[k] is not None else up >= 0 and marked[up]
        out[k] = bool(tree.text[k]) and marked[k]
    return out


def _observed(g: Graph, trees: Sequence[Tree]) -> np.ndarray:
    """Labels of all nodes; an element is main text if it holds some."""
    y = np.zeros(len(g.parent))
    known = np.concatenate([labels(t) for t in trees])
    y[:len(known)] = known
    for level in reversed(g.levels[1:]):
        np.maximum.at(y, g.parent[level], y[level])
    return y


def gradient(g: Graph, y: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Of the log-likelihood: what is observed less what the model expects."""
    p, joint = marginals(g, model)
    node = np.bincount(g.features, np.repeat(y - p, np.diff(g.starts)), NODES)
    child = np.flatnonzero(g.parent >= 0)
    off = -joint[child].reshape(-1, 4)
    off[np.arange(len(child)), (2 * y[g.parent[child]] + y[child]).astype(np.int64)] += 1
    edge = np.stack([sum(np.bincount(g.edges[child, j], off[:, s], EDGES) for j in (0, 1)) for s in range(4)], 1)
    return node, edge


def fit(pages: Sequence[str], epochs: int = 30, rate: float = 0.1, decay: float = 1e-4, batch: int = 250) -> Model:
    """Maximum likelihood with a small quadratic penalty on pages marked like :mod:`labelled_pages`, at most MOST_LABELLED of them.

    Steps go over the pages in batches; they are scaled by running means of the gradient and its square and shrink to nothing towards the
    end. The same pages give the same model.
    """
    trees = [parse(page) for page in pages[:MOST_LABELLED]]
    model = Model(np.zeros(NODES), np.zeros((EDGES, 4)))
    groups = [trees[k:k + batch] for k in range(0, len(trees), batch)]
    graphs = [graph(some) for some in groups]
    known = [_observed(g, some) for g, some in zip(graphs, groups)]
    moments, steps, step = [(np.zeros_like(w), np.zeros_like(w)) for w in model], epochs * len(groups), 0
    for _ in range(epochs):
        for g, y, some in zip(graphs, known, groups):
            step += 1
            for w, total, (first, second) in zip(model, gradient(g, y, model), moments):
                grad = total / len(some) - decay * w
                first += 0.1 * (grad - first)
                second += 0.01 * (grad * grad - second)
                w += rate * (1 - (step - 1) / steps) * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.99 ** step)) + 1e-6)
    return model


@lru_cache(2)
def standard_model(n: int = 3000, seed: int = 7) -> Model:
    """The model of ``n`` labelled pages of all layouts."""
    return fit(labelled_pages(n, seed))


def main_text(trees: Sequence[Tree], model: Model, threshold: float = 0.5) -> list[str]:
    """The runs of each tree that are more likely main text than not, in page order."""
    p, _ = marginals(graph(trees), model) if trees else (np.empty(0), None)
    out, at = [], 0
    for tree in trees:
        out.append("\n".join(t for k, t in enumerate(tree.text) if t and p[at + k] > threshold))
        at += len(tree.parent)
    return out


def extract(pages: DataFrame, model: Model | None = None, column: str = "html", keep: Sequence[str] = ("page_id", "url")) -> DataFrame:
    """``keep`` with (text, n_chars): the main text of each page, blocks joined by line feeds, and its code points.

    A null page is empty; a page without main text has an empty text. Repeated rows repeat, an empty table gives no rows, other columns are
    ignored. Pages are independent, so nothing is shuffled; the model, 2 MB, is broadcast.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model or standard_model())
    keep = list(keep)
    schema = pages.select(*keep).schema.add("text", "string").add("n_chars", "long")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for part in pieces(batch, size=1 << 20, column=len(keep), rows=512):
                texts = main_text([parse(x or "") for x in part.column(len(keep)).to_pylist()], shared.value)
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(len(keep))), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=schema.names)

    return pages.select(*keep, F.col(column).cast("string")).mapInArrow(run, schema)
