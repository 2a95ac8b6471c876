"""How many bytes a reading moves, as arithmetic over counts of rows and nodes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of a cache line.
LINE = 128


def lines(size: Column) -> Column:
    """Bytes moved for ``size`` bytes in a row: whole lines."""
    return F.ceil(size / LINE) * LINE


#: Fixed values of the hardware model: bytes a second, seconds of a launch and of a memory access, joules a byte.
BANDWIDTH, LAUNCH, LATENCY, JOULES = 342e9, 2.8e-6, 0.3e-6, 5e-12
ELEMENT, BLOCK, NODE = 4, 32, 32


def flat_bytes(rows: Column) -> Column:
    """A scan of values in a row."""
    return lines(rows * ELEMENT)


def lod_bytes(levels: Column) -> Column:
    """The top levels of a binary tree of nodes."""
    return lines((F.pow(F.lit(2.0), levels) - 1) * NODE)


def coupled_bytes(items: Column) -> tuple[Column, Column]:
    """Value and context apart, and side by side in blocks."""
    return items * 2 * LINE, F.ceil(items / BLOCK) * LINE


def single_query(flat: Column) -> dict[str, Column]:
    """Seconds of reading ``flat`` bytes, of one launch, of one access."""
    return {"flat_s": flat / BANDWIDTH, "software_s": F.lit(LAUNCH), "native_s": F.lit(LATENCY)}


def batch_query(flat: Column, build: Column, queries: Column) -> dict[str, Column]:
    """A batch that scans against one that builds aggregates once, in seconds and joules."""
    return {"flat_s": flat / BANDWIDTH, "software_s": build / BANDWIDTH + LAUNCH, "native_s": queries * LATENCY, "flat_j": flat * JOULES, "build_j": build * JOULES}


# ---- storage of co-registered layers with embeddings

#: Bytes of a graph's links per vector, of a spatial entry, channels of the layers, neighbours visited.
GRAPH, SPATIAL, CHANNELS, VISITED = 128, 20, 5, 64


def stitched_bytes(own_nodes: Column, own_payload: Column, regions: Column, dims: Column, side: int) -> Column:
    """Separate trees, vectors, a graph over them, a thumbnail and a spatial index."""
    return own_nodes + own_payload + regions * dims * 4 + regions * GRAPH + (side // 8) ** 2 * 3 + regions * SPATIAL


def unified_bytes(nodes: Column, regions: Column, dims: Column, kept: Column) -> Column:
    """One tree with vectors at its leaves and ``kept`` numbers of a vector at inner nodes."""
    return nodes + regions * CHANNELS + regions * dims * 4 + nodes * kept * 4


def access_bytes(window: Column, dims: Column) -> dict[str, Column]:
    """Bytes of reading the regions of a window against a graph search and separate indexes."""
    return {
        "roi_shared": window * CHANNELS + window,
        "roi_apart": window * CHANNELS + 3 * window + 200,
        "scoped_shared": window * dims * 4,
        "scoped_graph": VISITED * (dims * 4 + GRAPH),
        "sum_shared": F.lit(12 * (1 + CHANNELS)),
        "sum_apart": window * CHANNELS,
    }


def composition_bytes(concepts: Column, terms: Column, dims: Column, vocabulary: Column) -> dict[str, Column]:
    """Dense vectors against equations over shared primitives: two bytes a reference, one an operator."""
    return {"dense": concepts * dims * 4, "equations": vocabulary * 8 + concepts * (terms * 2 + terms - 1)}
