"""Substring de-duplication by hashing lines, and runs of phrases inside lines.

A line is cut into phrases: after each sentence mark and, where no mark or line end is near, after the words whose
digest is the least among AROUND words on either side. Whether a phrase ends after a word thus depends on the few words
around it alone, so a passage falls into the same phrases wherever it stands. A unit is a run of phrases of one line: from each phrase on, as many
as reach `least` words; where the line ends before, the last ones of the line that reach `least` words, or the
whole line if it is shorter. So a line of any length counts as a whole, and less than a line counts from `least` words on.

Units are normalised (ASCII letters in lower case, white space between words as one space) and digested to 128 bits.
Digests are grouped over the whole corpus; of equal units the one that ranks first by (doc_id, text digest,
place in the text) stays, and the phrases of all others are cut out, but for those that a first occurrence of a repeated unit shares. So
every first occurrence stands whole, also where a unit overlaps itself. Nothing else is cut: what lies between two cuts stays unless it is part of a
repeated unit itself. The offsets of what was cut, in characters of the original text, come with the result. A cut takes the
blanks after it along, and a line that has no word left goes with its line end.

The first occurrences come from a grouped minimum, which is combined before the shuffle, and meet the
units again in a join whose commonest keys are salted, so a line that a third of the documents share is dealt to many tasks. Each document's text crosses the network once, with the numbers of its units to cut.

Defined results: a null text stays null with nothing removed; a text without words stays as it
is; rows that agree in doc_id and text are one document and get the same answer; a null doc_id
ranks after all others; ids of any type that Spark can order will do; an empty table gives an empty result; extra columns of any name pass on, and one that has
the name of an output column (`removed`) is replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from quern.llm.common import cut, free_names, map_batches
from quern.llm.shingles import blocks, mix, powers, word_digests, word_edges

LEAST = 8
#: Words on either side that decide whether a phrase ends where there is no mark.
AROUND = 4
SALTS = 64
#: Bytes of text whose units are found at once.
BLOCK = 1 << 18
#: Bytes at the end of a word in which a mark ends a sentence, as quotes and other signs may follow it.
TAIL = 4
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".!?"]] = True
_KEYS = (np.uint64(0xD1B54A32D192ED03), np.uint64(0xABC98388FB8FAC03))


def _phrase_ends(data: np.ndarray, words: np.ndarray, first: np.ndarray, last: np.ndarray, line_end: np.ndarray) -> np.ndarray:
    """Whether a phrase ends after each word."""
    stop = line_end | np.logical_or.reduce([_ENDS[data[np.maximum(last - k, first)]] for k in range(1, TAIL + 1)])
    n = len(words)
    value = mix(words * _KEYS[0] + np.append(words[1:], np.uint64(0)))
    free = ~stop
    for k in range(1, min(AROUND, n - 1) + 1):
        free[k:] &= ~stop[:-k] & (value[k:] < value[:-k])
        free[:-k] &= ~stop[k:] & (value[:-k] <= value[k:])
    free[:AROUND] = False
    return stop | free


def units(data: np.ndarray, bounds: np.ndarray, least: int = LEAST, whole_lines: bool = False) -> dict[str, np.ndarray]:
    """The phrases and units of texts laid end to end.

    Of each phrase `start` and `end` (bytes) and `line`; of each unit `text` (index), `number` (in its text), `a` and `b` (its first
    and last phrase) and `high`, `low` (digest).
    """
    folded = _LOWER[data]
    words, counts = word_digests(folded, bounds)
    first, last = word_edges(folded, bounds)
    n = len(words)
    if not n:
        return dict.fromkeys(("start", "end", "line", "text", "number", "a", "b", "high", "low"), np.zeros(0, np.int64))
    text = np.repeat(np.arange(len(counts)), counts)
    breaks = np.concatenate([[0], np.cumsum(data == 10)])
    line_end = np.ones(n, bool)
    line_end[:-1] = (breaks[first[1:]] > breaks[last[:-1]]) | (text[1:] != text[:-1])
    ends = np.flatnonzero(line_end if whole_lines else _phrase_ends(data, words, first, last, line_end))
    starts = np.concatenate([[0], ends[:-1] + 1])
    closing = np.flatnonzero(line_end[ends])  # the last phrase of each line
    opening = np.concatenate([[0], closing[:-1] + 1])
    line = np.repeat(np.arange(len(closing)), closing - opening + 1)
    least = 1 if whole_lines else least
    a, b = np.arange(len(starts)), np.searchsorted(ends, starts + least - 1)
    inside = b <= closing[line]
    # The end of a line, unless a run from one of its phrases comes to the same.
    tail = np.maximum(np.searchsorted(starts, ends[closing] - least + 1, "right") - 1, opening)
    new = b[tail] != closing
    a, b = np.concatenate([a[inside], tail[new]]), np.concatenate([b[inside], closing[new]])
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    up, down = powers(n)
    digests = []
    for key in _KEYS:
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(mix(words ^ key) * up[:n], out=total[1:])
        value = (total[ends[b] + 1] - total[starts[a]]) * down[starts[a]]
        digests.append(mix(value + (ends[b] - starts[a] + 1).astype(np.uint64)).view(np.int64))
    owner = text[starts[a]]
    return {
        "start": first[starts], "end": last[ends], "line": line, "text": owner, "number": np.arange(len(a)) - np.searchsorted(owner, owner),
        "a": a, "b": b, "high": digests[0], "low": digests[1],
    }


def find_units(df: DataFrame, text: str, doc_id: str, least: int, whole_lines: bool) -> DataFrame:
    """(doc_id, text_digest, number, high, low) for every unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data, bounds in blocks(batch.column(2), BLOCK):
                found = units(data, bounds, least, whole_lines)
                part = batch.slice(block.start, len(block))
                at = pa.array(found["text"])
                columns = [part.column(0).take(at), part.column(1).take(at), *(pa.array(found[k].astype(np.int64)) for k in ("number", "high", "low"))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_digest", "number", "high", "low"])

    slim = df.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("text_digest"), F.col(text).alias("text"))
    schema = StructType([slim.schema["doc_id"]]).add("text_digest", "long").add("number", "long").add("high", "long").add("low", "long")
    return slim.mapInArrow(run, schema)


def cut_text(text: str, gone: list[int], kept: list[int], least: int = LEAST, whole_lines: bool = False) -> tuple[str, list[tuple[int, int]]]:
    """The text without the phrases of the units in `gone` that no unit in `kept` has, and the offsets of what was cut, in characters."""
    raw = np.frombuffer(text.encode(), np.uint8)
    found = units(raw, np.array([0, len(raw)]), least, whole_lines)
    n = len(found["start"])

    def covered(numbers: list[int]) -> np.ndarray:
        edges = np.zeros(n + 1, np.int64)
        np.add.at(edges, found["a"][numbers], 1)
        np.add.at(edges, found["b"][numbers] + 1, -1)
        return np.cumsum(edges)[:n] > 0

    away = covered(gone) & ~covered(kept)
    line = found["line"]
    stays = np.zeros(line[-1] + 1, bool)
    np.logical_or.at(stays, line, ~away)
    # Neighbouring phrases of a line are one cut.
    begins = away & np.append(True, ~away[:-1] | (line[1:] != line[:-1]))
    stops = away & np.append(~away[1:] | (line[1:] != line[:-1]), True)
    characters = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    spans = list(zip(characters[found["start"][begins]].tolist(), characters[found["end"][stops]].tolist(), strict=True))
    out, at = [], 0
    for (a, b), part in zip(spans, stays[line[begins]].tolist(), strict=True):
        end = b
        while end < len(text) and text[end] in " \t\r\x0b\x0c":
            end += 1
        if not part:
            a = text.rfind("\n", 0, a) + 1
            end += end < len(text)
        out.append(text[at:a])
        at = end
    return "".join(out) + text[at:], spans


def substring_dedup(df: DataFrame, text: str = "text", doc_id: str = "doc_id", least: int = LEAST, whole_lines: bool = False) -> DataFrame:
    """`df` with repeated units cut from `text`, and `removed`, the (start, end) offsets of what was cut.

    With `whole_lines` units are whole lines only.
    """
    found = find_units(df, text, doc_id, least, whole_lines)
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_digest", "number")
    # Repeated rows have the same occurrences.
    grouped = found.groupBy("high", "low").agg(F.min(rank).alias("first"), F.max(rank).alias("last"), F.count("*").alias("n")).filter(~F.col("first").eqNullSafe(F.col("last")))
    first = cut(grouped.select(F.col("high").alias("h"), F.col("low").alias("l"), "first", "n"))
    # Units with more than a thousandth of all repeats, of which there are fewer than a thousand, meet their first occurrence in SALTS places.
    common = F.col("n") > max(1000, (first.agg(F.sum("n")).first()[0] or 0) // 1000)
    salted = first.withColumn("salt", F.explode(F.when(common, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    hot = F.broadcast(first.filter(common).select(F.col("h").alias("hot_h"), F.col("l").alias("hot_l")))
    own = F.when(F.col("hot_h").isNotNull(), F.pmod(F.xxhash64("doc_id", "text_digest", "number"), F.lit(SALTS))).otherwise(0).cast("int")
    found = found.join(hot, (F.col("high") == F.col("hot_h")) & (F.col("low") == F.col("hot_l")), "left").withColumn("own", own).drop("hot_h", "hot_l")
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_digest") == F.col("first.text_digest")) & (F.col("number") == F.col("first.number"))
    repeated = found.join(salted, (F.col("high") == F.col("h")) & (F.col("low") == F.col("l")) & (F.col("own") == F.col("salt"))).withColumn("stays", stays)
    keyed = df.drop("removed")
    d, t, marks = free_names(keyed, "d", "t", "marks")
    # At most the units of one document.
    numbers = lambda condition: F.array_sort(F.collect_set(F.when(condition, F.col("number"))))
    sides = F.struct(numbers(~F.col("stays")).alias("gone"), numbers(F.col("stays")).alias("kept"))
    gone = repeated.groupBy("doc_id", "text_digest").agg(sides.alias(marks)).filter(F.size(f"{marks}.gone") > 0).select(F.col("doc_id").alias(d), F.col("text_digest").alias(t), marks)
    marked = keyed.join(gone, F.col(doc_id).eqNullSafe(F.col(d)) & (F.xxhash64(F.col(text)) == F.col(t)), "left").drop(d, t)
    names = keyed.columns
    schema = StructType(list(keyed.schema.fields)).add("removed", ArrayType(StructType().add("start", "long").add("end", "long")))
    place = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            texts, cuts = batch.column(place), batch.column(len(names)).to_pylist()
            new, spans = texts.to_pylist(), [[] for _ in cuts]
            for i, mark in enumerate(cuts):
                if mark:
                    new[i], spans[i] = cut_text(new[i], mark["gone"], mark["kept"], least, whole_lines)
            columns = [batch.column(k) for k in range(len(names))]
            columns[place] = pa.array(new, texts.type)
            removed = pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], kind)
            yield pa.RecordBatch.from_arrays([*columns, removed], [*names, "removed"])

    return map_batches(marked, run, schema)
