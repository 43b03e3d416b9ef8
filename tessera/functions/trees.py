"""Expression trees: XML to node and edge arrays.

One Arrow-batched function: Python's XML parser (in C) reads a tree, its nodes are listed breadth-first,
and the edges of a whole batch are built as arrays.  The same conversion from Spark's regular expressions
and array functions takes three times the CPU, since lambdas over arrays are interpreted (README).
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

# The element names of the vocabulary in the order that gives their ids; 0 is any other.
VOCABULARY = (
    "ci apply csymbol cn math times eq minus divide plus interval and cerror in list mtext infinity leq abs root sum matrixrow int lt gt geq set sin cos "
    "vector log factorial partialdiff subset neq limit merror matrix intersect equivalent union ln compose ns2 approx html setdiff exp tan emptyset not "
    "floor degree implies or exists notin determinant max gcd min mpadded arctan sec cot sinh cosh ceiling real mrow arcsin csc prsubset arccos tanh arg "
    "imaginary mo mi mn"
).split()
MAX_NODES = 256

GRAPH = "struct<x:array<int>,src:array<int>,dst:array<int>,num_nodes:int>"


def breadth_first(xml: str | None, most: int) -> tuple[list[str], list[int]]:
    """Names of the first ``most`` nodes in breadth-first order and the parent of each but the root; none if the
    tree is malformed, empty or a single node."""
    try:
        order = [ET.fromstring(xml or "")]
    except ET.ParseError:
        return [], []
    above: list[int] = []
    for i, element in enumerate(order):  # grows while it is read
        if n := len(element):
            order += element
            above += [i] * n
            if len(order) >= most:
                break
    if len(order) < 2 or most < 2:
        return [], []
    return [e.tag for e in order[:most]], above[: most - 1]


def graphs(trees: pa.Array, ids: dict[str, int], most: int) -> pa.Array:
    """The graph structs of a batch."""
    known: dict[str, int] = {}

    def named(tag: str) -> int:
        if tag not in known:
            known[tag] = ids.get(tag.rpartition("}")[2], 0)
        return known[tag]

    x: list[int] = []
    parents: list[int] = []
    sizes = np.zeros(len(trees), np.int64)
    for i, xml in enumerate(trees.to_pylist()):
        tags, above = breadth_first(xml, most)
        x += map(named, tags)
        parents += above
        sizes[i] = len(tags)
    edges = np.maximum(sizes - 1, 0)
    node = np.arange(len(parents)) - np.repeat(np.cumsum(edges) - edges, edges) + 1
    pairs = np.stack([np.array(parents, np.int32), node.astype(np.int32)], axis=1)
    lists = lambda n, values: pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), pa.array(values, pa.int32()))
    columns = [lists(sizes, x), lists(2 * edges, pairs.ravel()), lists(2 * edges, pairs[:, ::-1].ravel()), pa.array(sizes, pa.int32())]
    return pa.StructArray.from_arrays(columns, names=["x", "src", "dst", "num_nodes"], mask=pa.array(sizes == 0))


def tree_to_graph(vocabulary: Sequence[str] = VOCABULARY, most: int = MAX_NODES) -> Callable[[Column | str], Column]:
    """A column function from XML to a nullable graph struct: breadth-first node ids and both directions of each edge.

    Null for null, empty, malformed and single-node trees.  Nodes beyond ``most`` are cut off in
    breadth-first order.
    """
    ids = {tag: i + 1 for i, tag in enumerate(vocabulary)}

    @arrow_udf(GRAPH)
    def convert(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield graphs(batch, ids, most)

    return convert


def degrees(src: pa.Array, num_nodes: pa.Array) -> pa.Array:
    """Each node's number of edges, for the graphs of a batch; none where the graph is null."""
    sizes = np.asarray(num_nodes.fill_null(0))
    start = np.cumsum(sizes) - sizes
    edges = np.asarray(pc.list_value_length(src).fill_null(0))
    counts = np.bincount(np.asarray(src.flatten()) + np.repeat(start, edges), minlength=int(sizes.sum()))
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(counts, pa.int64()))


def node_degrees(graph: Column) -> Column:
    """Of a graph struct, the number of edges of each node in the order of ``x``."""

    @arrow_udf("array<long>")
    def convert(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for src, num_nodes in batches:
            yield degrees(src, num_nodes)

    return convert(graph["src"], graph["num_nodes"])


def valid_mask(graph: Column) -> Column:
    return graph.isNotNull()


def vocabulary_id(tag: Column, vocabulary: Sequence[str] = VOCABULARY) -> Column:
    """The id of an element name, 0 if unknown; a namespace prefix in braces is dropped."""
    pairs = [F.lit(x) for i, t in enumerate(vocabulary) for x in (t, i + 1)]
    return F.coalesce(F.element_at(F.create_map(*pairs), F.regexp_replace(tag, r"^\{[^}]*\}", "")), F.lit(0))
