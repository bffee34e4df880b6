"""Language identification by rank-order profiles of character n-grams.

A profile is the list of the most frequent n-grams of one to three letters, by falling frequency; blanks
stand at the ends of words, and ties go by code point. `learn` makes one for each language, and
`identify` makes one for each whole text and picks the language at the least out-of-place
distance: the sum of the differences in rank, with the profile's length for an n-gram that the
language's profile lacks. The score is second / (best + second), from 0.5 for a tie to 1.

Profiles are learned from a bounded sample: of each language about `per_language` documents, those with
the least digests of doc_id and text, where rows that agree in both count once; the text counts whole, in blocks of BLOCK characters at a time. A profile has `size` n-grams, so the model has at most
size rows for each language and is shipped with the task's code.

Defined results: a text that is null or has no letter gets `und` with score 0, as does every text
if there is nothing to learn from; of languages at the same distance the first by name wins;
rows are judged one by one, so repeated rows and null ids are no special case; an empty table
gives an empty result; extra columns pass on, and those that have the name of an output column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quern.llm.common import map_batches

SIZE = 300
PER_LANGUAGE = 4000
UNKNOWN = "und"
#: Characters whose n-grams are counted at once.
BLOCK = 1 << 20
_BLANK = 32


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point its lower-case letter, or the blank if it is no letter."""
    out = np.full(0x110000, _BLANK, np.int64)
    for c in range(0x110000):
        if (x := chr(c)).isalpha():
            low = x.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def ngrams(text: str) -> np.ndarray:
    """The codes of all n-grams of a text: 21 bits a letter."""
    points = np.frombuffer(f" {text} ".encode("utf-32-le", "replace"), np.uint32)
    letters = _letters()[points]
    blank = letters == _BLANK
    letters = letters[np.append(True, ~(blank[1:] & blank[:-1]))]
    word = letters != _BLANK
    one = letters[word]
    two = (letters[:-1] << 21) | letters[1:]
    three = (letters[:-2] << 42) | (letters[1:-1] << 21) | letters[2:]
    return np.concatenate([one, two, three[word[1:-1]]]) if one.size else one


def profile(text: str, size: int) -> np.ndarray:
    """The codes of a text's most frequent n-grams, most frequent first."""
    codes, counts = np.unique(ngrams(text), return_counts=True)
    falling = counts.max() - counts if counts.size else counts
    # Counts that fit in 16 bits are the sort's fast case; `codes` are in order, so a stable sort breaks ties.
    if counts.size and counts.max() <= 65535:
        falling = falling.astype(np.uint16)
    return codes[np.argsort(falling, kind="stable")[:size]]


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", size: int = SIZE, per_language: int = PER_LANGUAGE) -> dict[str, list[int]]:
    """The profile of every language: n-gram codes, most frequent first."""
    rows = labelled.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"), F.xxhash64(F.col(doc_id).cast("string"), F.col(text)).alias("digest")
    )
    # One row per language.
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    bound = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, per_language / n) * (1 << 20))])
    drawn = rows.filter(F.pmod("digest", F.lit(1 << 20)) < F.try_element_at(bound, F.col("lang")))
    sample = drawn.dropDuplicates(["lang", "digest"]).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[str, list[str]] = {}
            sizes: dict[str, int] = {}
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held.setdefault(name, []).append(value.as_py())
                sizes[name] = sizes.get(name, 0) + len(held[name][-1])
                if sizes[name] >= BLOCK:
                    yield counted(name, held.pop(name))
                    del sizes[name]
            for name, texts in held.items():
                yield counted(name, texts)

    def counted(name: str, texts: list[str]) -> pa.RecordBatch:
        codes, n = np.unique(np.concatenate([ngrams(x) for x in texts]), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array([name] * len(codes), pa.string()), pa.array(codes), pa.array(n)], ["lang", "code", "n"])

    summed = sample.mapInArrow(run, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    ranked = summed.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))).filter(F.col("rank") <= size)
    found: dict[str, list[int]] = {}
    for r in sorted(ranked.select("lang", "rank", "code").collect(), key=lambda r: (r["lang"], r["rank"])):
        found.setdefault(r["lang"], []).append(r["code"])
    return found


def identify(df: DataFrame, profiles: dict[str, list[int]], text: str = "text", size: int = SIZE) -> DataFrame:
    """Append lang_pred, score, and distance (0 for a text whose profile equals the language's, 1 for one with nothing in common)."""
    names = sorted(profiles)
    known = np.unique(np.array([c for p in profiles.values() for c in p], np.int64))
    ranks = np.full((len(known) + 1, len(names)), -1, np.int64)  # the last row is for n-grams that no profile has
    for j, name in enumerate(names):
        ranks[np.searchsorted(known, profiles[name]), j] = np.arange(len(profiles[name]))
    kept = df.drop("lang_pred", "score", "distance")
    columns = kept.columns
    place = columns.index(text)

    def judge(value: str | None) -> tuple[str, float, float]:
        mine = profile(value, size) if value and names else ()
        if not len(mine):
            return UNKNOWN, 0.0, 1.0
        at = np.minimum(np.searchsorted(known, mine), len(known) - 1)
        theirs = ranks[np.where(known[at] == mine, at, len(known))]
        away = np.where(theirs < 0, size, np.abs(theirs - np.arange(len(mine))[:, None])).sum(axis=0)
        order = np.argsort(away, kind="stable")
        best = int(away[order[0]])
        second = int(away[order[1]]) if len(names) > 1 else len(mine) * size
        return names[order[0]], second / (best + second) if best + second else 1.0, best / (len(mine) * size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [judge(x) for x in batch.column(place).to_pylist()]
            lang, score, distance = zip(*found, strict=True) if found else ((), (), ())
            extra = [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(distance, pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*columns, "lang_pred", "score", "distance"])

    schema = StructType(list(kept.schema.fields)).add("lang_pred", "string").add("score", "double").add("distance", "double")
    return map_batches(kept, run, schema)
