"""Near-duplicate vectors: a small-world graph for each shard, every vector asked of every shard of its label, exact cosines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, functions as F

from pagewright.llm import hnsw
from pagewright.llm.components import components
from pagewright.llm.store import written, widened

FLOOR = 0.93
#: Bytes of the vectors of a shard.
SHARD = 16 << 20


def _unit(raw: np.ndarray) -> np.ndarray:
    """Rows of length 1, in double precision; large and tiny numbers don't overflow."""
    x = raw.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _components_of(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least number that each of n nodes reaches over the edges a-b."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while (root[root] != root).any():
            root = root[root]
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    return root


def link_shards(x: np.ndarray, graph: hnsw.Graph, y: np.ndarray | None, floor: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of x, row of y) with a cosine, in double precision, of at least ``floor``; without y pairs a < b within x."""
    q = x if y is None else y
    query, node = hnsw.near(graph, q.astype(np.float32), floor - 1e-4)
    pair = np.unique(np.minimum(query, node) * len(x) + np.maximum(query, node)) if y is None else np.unique(node * len(q) + query)
    a, b = pair // len(q), pair % len(q)
    exact = np.concatenate([np.einsum("ij,ij->i", x[a[i : i + 65536]], q[b[i : i + 65536]]) for i in range(0, max(len(a), 1), 65536)]) >= floor
    if y is None:
        exact &= a != b
    return a[exact], b[exact]


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", floor: float = FLOOR, shard: int = SHARD) -> DataFrame:
    """(id, n_links, component_id, kept) of every row; see the module.

    Rows link if their labels are equal and not null, their vectors have as many numbers and a cosine of at least ``floor``.
    Null, empty and zero vectors and those that hold null or non-finite numbers link with nothing. Equal vectors under a
    label are one node that counts its copies; repeated rows count as vectors of their own. A null id takes part, and names a
    component never, its own included. No rows give no rows; other columns are ignored.
    """
    given = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<float>").alias("v"))

    def read(batches: Iterator) -> Iterator:
        import hashlib

        import pyarrow as pa

        for batch in batches:
            raw = []
            for v in batch.column(2).to_pylist():
                x = None if not v or None in v else np.array(v, np.float32)
                raw.append(None if x is None or not np.isfinite(x).all() or not x.any() else (x + np.float32(0)).tobytes())
            marks = [None if r is None else hashlib.blake2b(r, digest_size=16).digest() for r in raw]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(marks, pa.binary()), pa.array(raw, pa.binary())], names=["id", "label", "mark", "raw"])

    rows = written(given.mapInArrow(read, widened(given.select("id", "label"), "mark binary, raw binary")))
    good = rows.filter("label IS NOT NULL AND mark IS NOT NULL")
    nodes = good.groupBy("label", "mark").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.any_value("raw").alias("raw"))
    nodes = written(nodes.withColumn("dim", F.octet_length("raw") / 4).withColumn("dim", F.col("dim").cast("int")))
    sizes = nodes.groupBy("label", "dim").agg(F.count("*").alias("n")).withColumn("shards", F.ceil(F.col("n") * F.col("dim") * 4 / shard).cast("int"))
    dealt = nodes.join(sizes.drop("n"), ["label", "dim"]).withColumn("shard", F.pmod(F.xxhash64("mark"), F.col("shards")).cast("int"))
    made = int(sizes.agg(F.coalesce(F.sum("shards"), F.lit(0))).first()[0])

    def build(table):
        import pyarrow as pa

        table = table.combine_chunks().sort_by("mark")
        raw = b"".join(table.column("raw").to_pylist())
        x = np.frombuffer(raw, np.float32).reshape(table.num_rows, -1)
        graph = hnsw.build(_unit(x).astype(np.float32))
        one = {k: [table.column(k)[0].as_py()] for k in ("label", "dim", "shard")}
        return pa.table(one | {"marks": [b"".join(table.column("mark").to_pylist())], "copies": [np.array(table.column("copies").to_pylist(), np.int64).tobytes()], "raw": [raw], "graph": [graph.to_bytes()]}).cast(built)

    kind = widened(dealt.select("label", "dim", "shard"), "marks binary, copies binary, raw binary, graph binary")
    from pyspark.sql.pandas.types import to_arrow_schema

    built = to_arrow_schema(kind)
    graphs = written(dealt.repartition(max(8, 4 * made), "label", "dim", "shard").groupBy("label", "dim", "shard").applyInArrow(build, kind))
    names = graphs.select("label", "dim", "shard")
    units = names.withColumnRenamed("shard", "a").join(names.withColumnRenamed("shard", "b"), ["label", "dim"]).filter("a <= b")
    left = graphs.select("label", "dim", *[F.col(k).alias("a" if k == "shard" else f"a_{k}") for k in ("shard", "marks", "copies", "raw", "graph")])
    right = graphs.select("label", "dim", *[F.col(k).alias("b" if k == "shard" else f"b_{k}") for k in ("shard", "marks", "copies", "raw")])
    work = units.join(left, ["label", "dim", "a"]).join(right, ["label", "dim", "b"])
    many = min(20_000, max(8, 2 * made * made))

    def link(table):
        import pyarrow as pa

        r = {k: table.column(k)[0].as_py() for k in table.column_names}
        x = _unit(np.frombuffer(r["a_raw"], np.float32).reshape(-1, r["dim"]))
        graph = hnsw.Graph.from_bytes(x.astype(np.float32), r["a_graph"])
        marks, copies = np.frombuffer(r["a_marks"], "V16"), np.frombuffer(r["a_copies"], np.int64)
        if r["a"] == r["b"]:
            a, b = link_shards(x, graph, None, floor)
        else:
            y = _unit(np.frombuffer(r["b_raw"], np.float32).reshape(-1, r["dim"]))
            a, b = link_shards(x, graph, y, floor)
            b, marks, copies = b + len(x), np.concatenate([marks, np.frombuffer(r["b_marks"], "V16")]), np.concatenate([copies, np.frombuffer(r["b_copies"], np.int64)])
        root = _components_of(len(marks), a, b)
        links = np.bincount(a, copies[b], len(marks)) + np.bincount(b, copies[a], len(marks))
        some = np.flatnonzero(links)
        own = [marks[i].tobytes() for i in some]
        tops = [marks[root[i]].tobytes() for i in some]
        return pa.table([pa.array([r["label"]] * len(some), found_kind.field("label").type), pa.array(own, pa.binary()), pa.array(tops, pa.binary()), pa.array(links[some].astype(np.int64))], schema=found_kind)

    found_schema = widened(dealt.select("label"), "mark binary, root binary, links long")
    found_kind = to_arrow_schema(found_schema)
    found = written(work.repartition(many, "label", "dim", "a", "b").groupBy("label", "dim", "a", "b").applyInArrow(link, found_schema))

    # a node is named by its label and mark; the two together in one comparable value
    name = lambda mark: F.struct(F.col("label"), F.col(mark).alias("mark"))
    reach = components(found.select(name("mark").alias("src"), name("root").alias("dst"))).select("id.label", F.col("id.mark").alias("mark"), "component")
    joined = nodes.select("label", "mark", "rep", "copies").join(reach, ["label", "mark"], "left").withColumn("component", F.coalesce("component", F.struct("label", "mark")))
    first = joined.groupBy("component").agg(F.min("rep").alias("component_id"))
    linked = found.groupBy("label", "mark").agg(F.sum("links").alias("links"))
    owner = joined.join(first, "component").join(linked, ["label", "mark"], "left").select("label", "mark", "component_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    alone = rows.filter("label IS NULL OR mark IS NULL").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = good.join(owner, ["label", "mark"]).select("id", "n_links", "component_id").union(alone)
    return out.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)))
