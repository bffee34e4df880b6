"""Near-duplicate embeddings: random-hyperplane sign hashing, exact cosines, connected components.

1. Equal vectors form a class that one member speaks for. Each class gets, in each of several
   tables, the signs of its products with random hyperplanes. Two vectors at the threshold agree in a sign with
   probability p = 1 - acos(threshold) / pi, so in a table of k signs with p^k; `tables_for` takes k from the
   number of classes, so that buckets keep their size as the corpus grows, and as many tables as bring the chance of
   meeting in one of them at the threshold to `recall`, 0.98: up to one pair in fifty at the threshold itself is not found, fewer above it, and none
   wrongly.
2. Vectors are dealt out by bucket, and pairs within a bucket are compared exactly, in double
   precision, in blocks. A pair counts in the first table it meets in. Buckets over CHUNK are cut into chunks
   by a digest of the vector, and each pair of chunks is a group of its own, so that no task holds a whole hot bucket.
   Pairs stay inside the tasks: what leaves them is, for each vector, the number of its links, and enough links to
   connect what is connected.
3. Links per vector are summed, and connected components run on the links.

Defined results: vectors that are null, empty or zero or have null or non-finite components link
with nothing, equal ones included; vectors of different dimensions do not link; a null vec_id is a value after all
others, and ids may be of any type that Spark can order; repeated rows are vectors of their own and link; an empty table gives an empty result; extra columns do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import acos, ceil, log, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType, StructType

from quern.llm.common import cut
from quern.llm.components import components
from quern.llm.shingles import mix

THRESHOLD = 0.95
RECALL = 0.98
CHUNK = 1024
#: Buckets up to this size are compared pair by pair, several buckets at once.
SMALL = 48
SEED = 20240601
#: Rows up to which the table of large buckets is broadcast.
BROADCAST_ROWS = 50_000


def tables_for(n: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """(tables, signs in each) for n vectors."""
    signs = max(6, min(40, n.bit_length() - 3))
    meet = (1 - acos(threshold) / pi) ** signs
    return max(1, ceil(log(1 - recall) / log(1 - meet))), signs


def _planes(tables: int, signs: int, dimension: int) -> np.ndarray:
    return np.random.Generator(np.random.Philox(SEED + dimension)).standard_normal((dimension, tables * signs))


def clean_vectors(df: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, node, vector): the components' bytes, of four each if the column has single precision, else eight, and a digest of the vector; both null if it links with nothing."""
    single = df.schema[embedding].dataType.elementType == FloatType()
    kind = np.float32 if single else np.float64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, vector = [], []
            lists = batch.column(1)
            for at, known in enumerate(lists.is_valid().to_pylist()):
                part = lists[at].values if known else None
                good = part is not None and len(part) and not part.null_count
                x = part.to_numpy(zero_copy_only=False).astype(kind) if good else None
                if good and np.isfinite(x).all() and x.any():
                    x = x + kind(0)  # no negative zeros, which would tell equal vectors apart
                    vector.append(x.tobytes())
                    node.append(int.from_bytes(hashlib.blake2b(vector[-1], digest_size=8).digest(), "little", signed=True))
                else:
                    vector.append(None)
                    node.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(node, pa.int64()), pa.array(vector, pa.binary())], ["vec_id", "node", "vector"])

    slim = df.select(F.col(vec_id).alias("vec_id"), F.col(embedding).cast("array<float>" if single else "array<double>").alias("embedding"))
    return slim.mapInArrow(run, StructType([slim.schema["vec_id"]]).add("node", "long").add("vector", "binary"))


def _matrix(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a column of bytes as a matrix, padded with zeros, and the length of each."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    flat = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(kind) if len(column) else np.zeros(0, kind)
    sizes = np.diff(offsets) // np.dtype(kind).itemsize
    if len(column) and (sizes == sizes[0]).all():
        return flat.reshape(len(column), sizes[0]), sizes
    out = np.zeros((len(column), sizes.max(initial=0)), kind)
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out, sizes


def _units(column: pa.Array, single: bool) -> tuple[np.ndarray, np.ndarray]:
    """Vectors at length one, in double precision, and their dimensions."""
    x, sizes = _matrix(column, np.float32 if single else np.float64)
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, initial=0, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True)), sizes


def _signed(classes: DataFrame, tables: int, signs: int, single: bool) -> DataFrame:
    """(node, n, vector, codes, marks): the signs for each table as bytes, and a digest of the table and them for the buckets."""
    code = _code(signs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, sizes = _units(batch.column(2), single)
            codes = np.zeros((len(x), tables), code)
            marks = np.zeros((len(x), tables), np.uint64)
            for dimension in np.unique(sizes):
                at = np.flatnonzero(sizes == dimension)
                bits = (x[at, :dimension] @ _planes(tables, signs, int(dimension)) >= 0).reshape(len(at), tables, signs)
                found = (bits * (np.uint64(1) << np.arange(signs, dtype=np.uint64))).sum(axis=2, dtype=np.uint64)
                codes[at] = found
                salt = np.arange(tables, dtype=np.uint64) + np.uint64(1000 * dimension)
                marks[at] = mix(found ^ mix(salt * np.uint64(0x9E3779B97F4A7C15)))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * tables), pa.array(marks.reshape(-1).view(np.int64)))
            raw = pa.array([c.tobytes() for c in codes], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, raw, lists], ["node", "n", "vector", "codes", "marks"])

    return classes.mapInArrow(run, "node long, n long, vector binary, codes binary, marks array<long>")


def _code(signs: int) -> type:
    return np.uint32 if signs <= 32 else np.uint64


def _compare(rows: DataFrame, threshold: float, single: bool, code: type) -> DataFrame:
    """(a, b, n): links (n is null), and how many vectors the class `a` links with (b is null), as far as each group shows.

    `rows` has grp, part (0 or 1 in a group of two chunks, else 2), at (the table), node, n, vector and codes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
            grp = table.column("grp").to_numpy()
            if not len(grp):
                continue
            # The last group may go on in the next batch.
            end = int(np.searchsorted(grp != grp[-1], False)) if grp[0] == grp[-1] else int(np.flatnonzero(grp != grp[-1])[-1]) + 1
            end = 0 if grp[0] == grp[-1] else end
            held = table.slice(end).combine_chunks().to_batches()[0]
            if end:
                yield _links(table.slice(0, end), threshold, single, code)
        if held is not None:
            yield _links(pa.Table.from_batches([held]), threshold, single, code)

    dealt = rows.repartition("grp").sortWithinPartitions("grp", "node")
    return dealt.mapInArrow(run, "a long, b long, n long")


def _links(table: pa.Table, threshold: float, single: bool, code: type) -> pa.RecordBatch:
    grp, part, at, node, n = (table.column(c).to_numpy() for c in ("grp", "part", "at", "node", "n"))
    units, sizes = _units(pa.concat_arrays(table.column("vector").chunks), single)
    marks = _matrix(pa.concat_arrays(table.column("codes").chunks), code)[0]
    links = np.zeros(len(grp), np.int64)
    a, b = [], []
    edges = np.concatenate([[0], np.flatnonzero(grp[1:] != grp[:-1]) + 1, [len(grp)]])
    size = np.repeat(np.diff(edges), np.diff(edges))
    small = np.flatnonzero(size <= SMALL)
    if small.size:
        x, g = units[small], grp[small]
        for step in range(1, SMALL):
            p = np.flatnonzero(g[step:] == g[:-step]) if step < len(g) else np.zeros(0, np.int64)
            if not p.size:
                break
            q = p + step
            near = (x[p] * x[q]).sum(axis=1) >= threshold
            i, j = small[p[near]], small[q[near]]
            before = np.arange(marks.shape[1]) < at[i][:, None]
            new = ~((marks[i] == marks[j]) & before).any(axis=1) & ((part[i] == 2) | (part[i] != part[j]))
            i, j = i[new], j[new]
            np.add.at(links, i, n[j])
            np.add.at(links, j, n[i])
            a.append(node[i])
            b.append(node[j])
    for s, e in zip(edges[:-1], edges[1:], strict=True):
        if e - s <= SMALL:
            continue
        x = units[s:e, : sizes[s]]
        near = x @ x.T >= threshold
        np.fill_diagonal(near, False)
        if part[s] != 2:
            near &= part[s:e, None] != part[None, s:e]
        new = near.copy()
        for t in range(int(at[s])):
            new &= marks[s:e, None, t] != marks[None, s:e, t]
        links[s:e] += new @ n[s:e]
        # The least row that each row is connected with in this group.
        label = np.arange(e - s)
        while True:
            low = np.minimum(label, np.where(near, label[None, :], e - s).min(axis=1))
            low = low[low]
            if (low == label).all():
                break
            label = low
        linked = label != np.arange(e - s)
        a.append(node[s:e][linked])
        b.append(node[s:e][label[linked]])
    a, b = np.concatenate([np.zeros(0, np.int64), *a]), np.concatenate([np.zeros(0, np.int64), *b])
    some = links > 0
    none = np.zeros(len(a), bool)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate([a, node[some]])),
            pa.array(np.concatenate([b, np.zeros(some.sum(), np.int64)]), mask=np.concatenate([none, np.ones(some.sum(), bool)])),
            pa.array(np.concatenate([np.zeros(len(a), np.int64), links[some]]), mask=np.concatenate([~none, np.zeros(some.sum(), bool)])),
        ],
        ["a", "b", "n"],
    )


def near_vectors(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = THRESHOLD, recall: float = RECALL, chunk: int = CHUNK) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    vectors = cut(clean_vectors(df, vec_id, embedding))
    single = df.schema[embedding].dataType.elementType == FloatType()
    classes = vectors.filter("node is not null").groupBy("node").agg(F.count("*").alias("n"), F.first("vector").alias("vector"))
    sized = cut(classes)
    tables, signs = tables_for(sized.count(), threshold, recall)
    signed = cut(_signed(sized, tables, signs, single))
    buckets = signed.select(F.explode("marks").alias("mark")).groupBy("mark").agg(F.count("*").alias("size"))
    large = cut(buckets.filter(F.col("size") > chunk).select(F.col("mark").alias("m"), F.ceil(F.col("size") / chunk).alias("chunks")))
    rows = signed.select("node", "n", "vector", "codes", F.posexplode("marks").alias("at", "mark"))
    rows = rows.join(F.broadcast(large) if large.count() <= BROADCAST_ROWS else large, F.col("mark") == F.col("m"), "left")
    own = F.pmod(F.xxhash64("node"), F.col("chunks"))
    one = F.struct(F.col("mark").alias("grp"), F.lit(2).alias("part"))
    pair = lambda j: F.struct(
        F.xxhash64("mark", F.least(F.col("own"), j), F.greatest(F.col("own"), j)).alias("grp"),
        F.when(F.col("own") == j, 2).when(F.col("own") < j, 0).otherwise(1).alias("part"),
    )
    rows = rows.withColumn("own", own).withColumn("to", F.when(F.col("chunks").isNull(), F.array(one)).otherwise(F.transform(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1), pair)))
    rows = rows.select(F.inline("to"), "at", "node", "n", "vector", "codes")
    found = cut(_compare(rows, threshold, single, _code(signs)))
    links = found.filter("b is null").groupBy("a").agg(F.sum("n").alias("others"))
    roots = components(found.filter("b is not null").select("a", "b"))
    named = sized.select("node", "n").join(links.withColumnRenamed("a", "node"), "node", "left").join(roots, "node", "left")
    named = named.select("node", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "node").alias("root"))
    placed = vectors.select("vec_id", "node").join(named, "node", "left")
    least = placed.filter("root is not null").groupBy("root").agg(F.min("vec_id").alias("least")).withColumnRenamed("root", "r")
    out = placed.join(least, F.col("root") == F.col("r"), "left")
    component = F.when(F.col("root").isNull(), F.col("vec_id")).otherwise(F.col("least"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
