"""Main text of pages by a tree-structured graphical model over the DOM.

Every block element is a binary variable: part of the article or not. Its own
potential is linear in features of the element (name, words of its class, id
and role, length and link share of its text); each parent-child pair has
potentials by the child's kind. Sum-product messages go up the tree and down
again and give the exact marginals; an element's text is taken where its
marginal is over one half. The weights maximise the likelihood of labelled pages
(``html_pages``) and their gradient uses the same messages.

Each page is one row and one task step; messages run over an array of nodes in
page order, so deep trees need no recursion.

Defined results: a null or empty page, and a page without text, have the empty
string; markup that isn't closed ends with its parent or the page; repeated
rows give equal results.
"""

from __future__ import annotations

import functools
import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, html_pages
from .html_tree import Node, parse

#: Kinds of child elements; each has four pair potentials.
KINDS = {"section": 0, "div": 0, "main": 0, "article": 0, "td": 0, "table": 0, "tr": 0, "tbody": 0, "body": 0, "html": 0, "p": 1, "h1": 1, "h2": 1, "h3": 1, "h4": 1, "li": 1, "ul": 1, "ol": 1, "blockquote": 1, "pre": 1, "dd": 1, "dt": 1, "dl": 1}
OTHER = 2
SECTIONS = frozenset("article main nav aside footer header form".split())


def features(nodes: list[Node]) -> list[list[str]]:
    """Names of each node's features."""
    out, within = [], []
    for n in nodes:
        within.append(n.tag if n.tag in SECTIONS else within[n.parent] if n.parent >= 0 else "none")
        length = sum(len(t) for _, t, _ in n.runs)
        linked = sum(k for _, _, k in n.runs)
        own = ["1", f"tag={n.tag}", f"within={within[-1]}"]
        own += [f"name={w}" for w in n.names] or ["unnamed"]
        if length:
            own.append(f"length={min(7, int(math.log2(length)) // 1 - 1 if length > 1 else 0)}")
            own.append(f"links={min(3, int(4 * linked / length))}")
            own.append(f"ends={n.runs[-1][1][-1] in '.!?:;'}")
        else:
            own.append("no text")
        if n.silent:
            own.append("silent")
        out.append(own)
    return out


@dataclass
class Model:
    weights: dict[str, float]
    pairs: list[list[float]]  # by kind: (0,0), (0,1), (1,0), (1,1) of parent, child


def _log_add(a: float, b: float) -> float:
    return a + math.log1p(math.exp(b - a)) if a >= b else b + math.log1p(math.exp(a - b))


def messages(nodes: list[Node], unary: list[float], pairs: list[list[float]]) -> tuple[list[float], list[float], list[float]]:
    """For each node: log-odds from itself and below, from above, and its message upward."""
    belief, up, down = list(unary), [0.0] * len(nodes), [0.0] * len(nodes)
    for i in range(len(nodes) - 1, 0, -1):
        t, b = pairs[KINDS.get(nodes[i].tag, OTHER)], belief[i]
        up[i] = _log_add(t[2], t[3] + b) - _log_add(t[0], t[1] + b)
        belief[nodes[i].parent] += up[i]
    for i in range(1, len(nodes)):
        p = nodes[i].parent
        t, d = pairs[KINDS.get(nodes[i].tag, OTHER)], belief[p] + down[p] - up[i]
        down[i] = _log_add(t[1], t[3] + d) - _log_add(t[0], t[2] + d)
    return belief, down, up


def marginals(nodes: list[Node], model: Model) -> list[float]:
    """Probability that each node is part of the article."""
    get = model.weights.get
    unary = [sum(get(f, 0.0) for f in own) for own in features(nodes)]
    belief, down, _ = messages(nodes, unary, model.pairs)
    return [1 / (1 + math.exp(-max(-60.0, min(60.0, b + d)))) for b, d in zip(belief, down, strict=True)]


LABEL = re.compile(r'<([a-zA-Z0-9]+) y="(\d)"')


def labelled(page: str) -> tuple[list[Node], list[int]]:
    """Nodes of a training page and their labels; the root has label 1."""
    nodes = parse(page)
    y = [1] + [int(v) for _, v in LABEL.findall(page)]
    if len(y) != len(nodes):
        raise ValueError("each element of a training page has a label")
    return nodes, y


@functools.lru_cache(maxsize=1)
def trained(pages: int = 160, rounds: int = 150, ridge: float = 1e-4) -> Model:
    """Weights of greatest penalised likelihood over generated labelled pages, by resilient gradient steps."""
    data = [labelled(p) for p in html_pages.pages(pages)]
    named = [own for nodes, _ in data for own in features(nodes)]
    names = sorted({f for own in named for f in own})
    index = {f: k for k, f in enumerate(names)}
    column = np.array([index[f] for own in named for f in own])
    row = np.repeat(np.arange(len(named)), [len(own) for own in named])
    y = np.array([v for _, own in data for v in own])
    start = np.cumsum([0, *(len(nodes) for nodes, _ in data)]).tolist()
    parent = np.array([n.parent + at if n.parent >= 0 else -1 for (nodes, _), at in zip(data, start, strict=False) for n in nodes])
    kind = np.array([KINDS.get(n.tag, OTHER) for nodes, _ in data for n in nodes])
    child = np.flatnonzero(parent >= 0)
    up_to = parent[child]
    seen = np.bincount(4 * kind[child] + 2 * y[up_to] + y[child], minlength=12)
    w, size = np.zeros(len(names) + 12), np.full(len(names) + 12, 0.1)
    last = np.zeros_like(w)
    for _ in range(rounds):
        pairs = w[len(names) :].reshape(3, 4)
        unary = np.bincount(row, w[column], len(y)).tolist()
        sent = [messages(nodes, unary[at : at + len(nodes)], pairs.tolist()) for (nodes, _), at in zip(data, start, strict=False)]
        belief, down, up = (np.array([v for m in sent for v in m[k]]) for k in range(3))
        p = 1 / (1 + np.exp(-np.clip(belief + down, -60, 60)))
        d = (belief + down)[up_to] - up[child]
        e = pairs[kind[child]].copy()
        e[:, 1] += belief[child]
        e[:, 2] += d
        e[:, 3] += d + belief[child]
        e = np.exp(e - e.max(axis=1, keepdims=True))
        e /= e.sum(axis=1, keepdims=True)
        expected = np.array([np.bincount(kind[child], e[:, k], 3) for k in range(4)]).T.reshape(-1)
        g = np.concatenate([np.bincount(column, (y - p)[row], len(names)), seen - expected]) / len(y) - ridge * w
        same = np.sign(g) * np.sign(last)
        size = np.clip(np.where(same > 0, size * 1.2, np.where(same < 0, size * 0.5, size)), 1e-4, 0.5)
        last = np.where(same < 0, 0, g)
        w += np.sign(last) * size
    return Model({f: float(w[k]) for f, k in index.items()}, w[len(names) :].reshape(3, 4).tolist())


def main_text(page: str, model: Model) -> str:
    """Blocks of the article in page order, one a line."""
    nodes = parse(page)
    p = marginals(nodes, model)
    runs = [r for n, q in zip(nodes, p, strict=True) if q > 0.5 and not n.silent for r in n.runs]
    return "\n".join(t for _, t, _ in sorted(runs))


def extract(pages: DataFrame, column: str = "text") -> DataFrame:
    """``pages`` (with html) and the main text of each."""
    common.prepare(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(trained())

    def values():
        return lambda b: [pa.array([main_text(h, shared.value) for h in common.texts(b, "html")], pa.string())]

    return common.with_columns(pages, [(column, T.StringType())], values)


def op7_html_extract(spark, sf_dir: str) -> DataFrame:
    pages = common.table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))
