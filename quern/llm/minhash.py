"""Near-duplicate documents by BagMinHash signatures of weighted word shingles.

A document is the bag of its five-word shingles, each weighing as often as it occurs. Two
documents are near-duplicates if their weighted Jaccard similarity, the sum of the lesser weights
over the sum of the greater ones, is 0.8 or more.

1. `signatures`: every shingle runs Poisson processes over the discretised weights 0, 1, 2, ...: one
   for each dyadic block (0, 1], (1, 2], (2, 4], ... that its weight reaches into, with a rate of the
   block's width and a seed that depends on shingle and block alone. A point carries a time, a
   component and a weight level, and counts if the level is within the shingle's weight. The
   earliest point of each component signs the document, so two signatures agree in a component
   with the probability of the weighted Jaccard similarity. Times are only followed up to the
   moment at which all components have a point, which for most shingles is before their first.
2. Documents with equal bags form a class, and classes are banded: two classes are candidates if
   all components of a band agree. Each bucket ties its members to its least, and connected
   components of these ties are the candidate groups; no pairs are made.
3. Members of a group fetch their texts once and are shingled once; what is shuffled are the digests of their bags' elements. `linked`
   compares bags exactly within the group, leaving out pairs that are already connected. Groups of more than CHUNK
   documents or CHUNK_WORDS shingles are dealt out in chunks: first each chunk with one common anchor, then what is still apart
   against the whole group, chunk by chunk.
4. Connected components of the exact links are the result.

Defined results: a null text counts as an empty one, and a text without words is alike to nothing;
one to four words make one shingle; rows that agree in doc_id and text are one document and get
the same answer; a null doc_id is a value that comes after all others; an empty table gives an
empty result; ids may be of any type that Spark can order; extra columns of any name do not matter, and `deduplicate` passes them on.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from quern.llm.common import cut, free_names, groups_of
from quern.llm.components import components
from quern.llm.shingles import bags, blocks, mix, shingles

BANDS, ROWS = 32, 8
SIMILARITY = 0.8
CHUNK, CHUNK_WORDS = 1000, 1_000_000
#: Bytes of text that are shingled at once on the way to a comparison.
BLOCK = 1 << 18
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def sign(digests: np.ndarray, weights: np.ndarray, counts: np.ndarray, m: int) -> np.ndarray:
    """The signatures, one row of `m` per bag; rows of empty bags are zero."""
    docs = np.repeat(np.arange(len(counts)), counts)
    total = np.bincount(docs, weights, len(counts))
    out = np.zeros(len(counts) * m, np.uint64)
    # Bags of like size are worked on together, so that a shingle's expected number of points is alike.
    scale = np.where(total > 0, np.log2(np.maximum(total, 1)).astype(int), -1)
    for s in np.unique(scale[scale >= 0]):
        mine = scale[docs] == s
        _run(docs[mine], digests[mine], weights[mine], total, out, m)
    return out.reshape(len(counts), m)


def _run(docs: np.ndarray, digests: np.ndarray, weights: np.ndarray, total: np.ndarray, out: np.ndarray, m: int) -> None:
    low, level = [np.zeros(len(docs), np.int64)], 1
    picked = [np.arange(len(docs))]
    while (reach := np.flatnonzero(weights > level)).size:
        picked.append(reach)
        low.append(np.full(reach.size, level))
        level *= 2
    picked, low = np.concatenate(picked), np.concatenate(low)
    width = np.maximum(low, 1)
    doc, inside = docs[picked], np.minimum(weights[picked] - low, width)
    seed = mix(digests[picked] + low.astype(np.uint64) * _GOLDEN)
    step = np.zeros(len(doc), np.uint64)
    time = np.zeros(len(doc))
    best = np.full(len(out), np.inf)
    open_docs = np.unique(doc)
    until = np.zeros(len(total))
    until[open_docs] = m * (log(m) + 2) / total[open_docs]
    pending = _draw(seed, step, width, time)
    alive = np.arange(len(doc))
    while open_docs.size:
        active = alive[pending[alive] <= until[doc[alive]]]
        while active.size:
            step[active] += np.uint64(1)
            value = mix(seed[active] + (step[active] * np.uint64(2)) * _GOLDEN)
            level = (value & np.uint64(0xFFFFFFFF)).astype(np.float64) / 2**32 * width[active]
            counts = level < inside[active]
            at, when, name = (doc[active] * m + ((value >> np.uint64(32)) % np.uint64(m)).astype(np.int64))[counts], pending[active][counts], value[counts]
            better = when < best[at]
            at, when, name = at[better], when[better], name[better]
            order = np.argsort(-when, kind="stable")
            at, when, name = at[order], when[order], name[order]
            best[at] = when
            out[at] = name
            time[active] = pending[active]
            pending[active] = _draw(seed[active], step[active], width[active], time[active])
            active = active[pending[active] <= until[doc[active]]]
        empty = np.isinf(best.reshape(-1, m)[open_docs]).any(axis=1)
        open_docs = open_docs[empty]
        if open_docs.size:
            until[open_docs] += m * 3 / total[open_docs]
            still = np.zeros(len(total), bool)
            still[open_docs] = True
            alive = np.flatnonzero(still[doc])


def _draw(seed: np.ndarray, step: np.ndarray, width: np.ndarray, time: np.ndarray) -> np.ndarray:
    """The time of the next point of each process."""
    value = mix(seed + (step * np.uint64(2) + np.uint64(1)) * _GOLDEN)
    return time - np.log(((value >> np.uint64(11)).astype(np.float64) + 0.5) / 2**53) / width


def signatures(df: DataFrame, text: str, doc_id: str, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, text_digest, node, bands, size): `node` is a digest of the bag, null without words; `bands` has a digest per band; `size` counts the bag."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = mix(np.arange(bands, dtype=np.uint64) + np.uint64(77))
        for batch in batches:
            for block, data, bounds in blocks(batch.column(2)):
                digests, weights, counts = bags(*shingles(data, bounds))
                signed = sign(digests, weights, counts, bands * rows).reshape(-1, bands, rows)
                key = np.broadcast_to(salt, signed.shape[:2]).copy()
                for k in range(rows):
                    key = mix(key * _GOLDEN + signed[:, :, k])
                full = counts > 0
                starts = np.concatenate([[0], np.cumsum(counts)])[:-1][full]
                node = np.zeros(len(counts), np.uint64)
                if full.any():
                    node[full] = mix(np.add.reduceat(mix(digests ^ mix(weights.astype(np.uint64))), starts))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(counts) + 1, dtype=np.int32) * bands), pa.array(key.reshape(-1).view(np.int64)))
                part = batch.slice(block.start, len(block))
                size = np.bincount(np.repeat(np.arange(len(counts)), counts), weights, len(counts)).astype(np.int64)
                columns = [part.column(0), part.column(1), pa.array(node.view(np.int64), mask=~full), lists, pa.array(size)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_digest", "node", "bands", "size"])

    slim = df.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("text_digest"), F.col(text).alias("text"))
    schema = StructType([slim.schema["doc_id"]]).add("text_digest", "long").add("node", "long").add("bands", ArrayType(LongType())).add("size", "long")
    return slim.mapInArrow(run, schema)


def elements(df: DataFrame, text: str) -> DataFrame:
    """`df` with `elements` in place of its text: digests of the bag's elements, where an occurrence of a shingle is one of its own, so that bags are sets."""
    keep = [c for c in df.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data, bounds in blocks(batch.column(len(keep)), BLOCK):
                digests, weights, counts = bags(*shingles(data, bounds))
                order = np.arange(int(weights.sum())) - np.repeat(np.cumsum(weights) - weights, weights)
                values = mix(np.repeat(digests, weights) + order.astype(np.uint64) * _GOLDEN)
                sizes = np.bincount(np.repeat(np.arange(len(counts)), counts), weights, len(counts)).astype(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values.view(np.int64)))
                part = batch.slice(block.start, len(block))
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(len(keep))), lists], [*keep, "elements"])

    schema = StructType(df.select(*keep).schema.fields).add("elements", ArrayType(LongType()))
    return df.select(*keep, text).mapInArrow(run, schema)


def linked(rows: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Exact links (a, b) within each group, enough of them to connect what is connected.

    `rows` has grp, node, label, compare and elements. Pairs with one member at least that has `compare` are
    looked at, unless their labels are equal or other links have connected them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups_of(batches, "grp"):
            lists = group.column("elements").combine_chunks()
            ends = lists.offsets.to_numpy()
            values = lists.values.to_numpy()[ends[0] : ends[-1]].view(np.uint64)
            found = list(_links(values, np.diff(ends).astype(np.int64), group.column("label").to_numpy(), group.column("compare").to_numpy(zero_copy_only=False), similarity))
            node = group.column("node").to_numpy()
            a, b = (np.array([f[k] for f in found], np.int64) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], ["a", "b"])

    dealt = rows.repartition("grp").sortWithinPartitions("grp", "node")
    return dealt.mapInArrow(run, "a long, b long")


def _links(elements: np.ndarray, sizes: np.ndarray, label: np.ndarray, compare: np.ndarray, similarity: float) -> Iterator[tuple[int, int]]:
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    _, label = np.unique(label, return_inverse=True)
    done = np.zeros(len(sizes), bool)
    for p in np.flatnonzero(compare):
        done[p] = True
        rest = np.flatnonzero((label != label[p]) & ~done & (sizes >= similarity * sizes[p]) & (similarity * sizes <= sizes[p]))
        if not rest.size:
            continue
        own = np.sort(elements[offsets[p] : offsets[p + 1]])
        n = sizes[rest]
        place = np.repeat(offsets[rest] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        values = elements[place]
        spot = np.minimum(np.searchsorted(own, values), len(own) - 1)
        both = np.add.reduceat((own[spot] == values).astype(np.int64), np.cumsum(n) - n)
        hit = rest[both >= similarity * (n + sizes[p] - both) - 1e-9]
        for q in hit:
            yield int(p), int(q)
        if hit.size:
            label[np.isin(label, label[hit])] = label[p]


def near_duplicates(df: DataFrame, text: str = "text", doc_id: str = "doc_id", similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, chunk: int = CHUNK) -> DataFrame:
    """One row per document: doc_id, text_digest, class_id (the least doc_id of its class), kept."""
    signed = cut(signatures(df, text, doc_id, bands, rows))
    # One member speaks for each class of equal bags.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_digest"))
    classes = cut(signed.filter("node is not null").groupBy("node").agg(first.alias("first"), F.first("bands").alias("bands"), F.first("size").alias("size")))
    buckets = classes.select("node", F.explode("bands").alias("band"))
    shared = buckets.groupBy("band").agg(F.min("node").alias("least"), F.count("*").alias("n")).filter("n > 1").select(F.col("band").alias("k"), "least")
    ties = buckets.join(shared, F.col("band") == F.col("k")).filter("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b")).distinct()
    grouped = components(ties).join(classes.select("node", "size"), "node")
    sized = cut(grouped.join(grouped.groupBy("root").agg(_chunks(chunk).alias("chunks")), "root"))
    speakers = classes.select("node", "first.doc_id", "first.text_digest").join(sized, "node").select(F.col("doc_id").alias("d"), F.col("text_digest").alias("t"), "node", "root", "chunks")
    texts = df.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("text_digest"), F.col(text).alias("text"))
    bodies = texts.join(speakers, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_digest") == F.col("t"))).select("node", "root", "chunks", "text")
    bodies = elements(bodies, "text")
    own = F.pmod(F.xxhash64("node"), F.col("chunks"))
    at = F.when((F.col("node") == F.col("root")) & (F.col("chunks") > 1), F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).otherwise(F.array(own))
    dealt = bodies.withColumn("at", F.explode(at)).select(F.xxhash64("root", "at").alias("grp"), "node", F.col("node").alias("label"), F.lit(True).alias("compare"), "elements")
    links = cut(linked(dealt, similarity))
    labels = components(links)
    wide = sized.filter("chunks > 1")
    if not wide.isEmpty():
        labels = components(cut(links.union(_across(wide, labels, texts, speakers, similarity, chunk))))
    named = signed.join(labels, "node", "left").withColumn("key", F.coalesce("root", "node"))
    best = named.filter("key is not null").groupBy("key").agg(first.alias("first")).select(F.col("key").alias("k"), "first")
    out = named.join(best, F.col("key") == F.col("k"), "left")
    alone = F.col("key").isNull()
    mine = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_digest") == F.col("first.text_digest"))
    return out.select("doc_id", "text_digest", F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("class_id"), (alone | mine).alias("kept"))


def _chunks(chunk: int) -> Column:
    """The number of chunks for the documents of a group."""
    return F.ceil(F.greatest(F.count("*") / chunk, F.sum("size") / (CHUNK_WORDS * chunk / CHUNK)))


def _across(wide: DataFrame, labels: DataFrame, texts: DataFrame, speakers: DataFrame, similarity: float, chunk: int) -> DataFrame:
    """Links of groups of several chunks that lie across chunks.

    What is not in the largest part of its group so far is compared with the whole group.
    """
    parts = wide.select("node", "size", F.col("root").alias("grp")).join(labels.withColumnRenamed("root", "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    counts = parts.groupBy("grp", "label").agg(F.count("*").alias("n"))
    largest = counts.groupBy("grp").agg(F.max(F.struct("n", "label"))["label"].alias("main"))
    marked = parts.join(largest, "grp").withColumn("stray", F.col("label") != F.col("main"))
    strays = marked.filter("stray").groupBy("grp").agg(_chunks(chunk).alias("x"))
    todo = cut(marked.join(strays, "grp").join(marked.groupBy("grp").agg(_chunks(chunk).alias("y")), "grp"))
    bodies = speakers.select("d", "t", "node").join(todo, "node")
    bodies = texts.join(bodies, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_digest") == F.col("t")))
    bodies = elements(bodies.select("grp", "node", "label", "stray", "x", "y", "text"), "text")
    count = lambda c: F.sequence(F.lit(0).cast("long"), F.col(c) - 1)
    mark = lambda c: F.pmod(F.xxhash64("node", F.lit(c)), F.col(c))
    stray = bodies.filter("stray").select("grp", "node", "label", "elements", mark("x").alias("i"), F.explode(count("y")).alias("j"), F.lit(True).alias("compare"))
    whole = bodies.select("grp", "node", "label", "elements", F.explode(count("x")).alias("i"), mark("y").alias("j"), F.lit(False).alias("compare"))
    both = stray.union(whole).select(F.xxhash64("grp", "i", "j").alias("grp"), "node", "label", "compare", "elements")
    return linked(both, similarity)


def deduplicate(df: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """The rows of `df` that stay: of each class the first document, once."""
    d, t, own = free_names(df, "d", "t", "digest")
    kept = near_duplicates(df, text, doc_id, **options).filter("kept").select(F.col("doc_id").alias(d), F.col("text_digest").alias(t))
    keyed = df.withColumn(own, F.xxhash64(F.col(text)))
    out = keyed.join(kept, F.col(doc_id).eqNullSafe(F.col(d)) & (F.col(own) == F.col(t)), "left_semi")
    return out.dropDuplicates([doc_id, own]).drop(own)
