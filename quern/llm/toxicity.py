"""Toxicity: a logistic classifier on words, regularised by counterfactuals.

For every labelled text that mentions a group, copies are made in which the mention is swapped for each other
term of its list or for a neutral word. Beside the usual loss the training penalises the squared
difference of a text's score before the squashing and its copies', so mentions of a group as such
stop to weigh and the words around them have to carry the label: neutral mentions score lower.

`train` works on a bounded sample of the labelled rows: of either label about `per_label` documents at most, those with
the least digests of their id, weighted back to all rows; near copies among them share the weight of one. They are drawn among the labels, so the sampled ids are a
small table and texts are not shuffled to meet them. Features are words and the first letters of longer ones, which catch a word's forms.
Spark counts them in both classes of that sample and keeps the up to VOCABULARY that tell the classes apart best by
the likelihood ratio, where that is more than chance gives among so many, and all identity terms; what comes to the
driver are these features and, for every sampled text, the numbers of those it holds. `score` reads every
text whole and needs no shuffle; the model is at most VOCABULARY weights.

Defined results: a null or empty text, or one without known words, gets the base score; null
labels are left out; if one of the labels has no row, every score is the share of label 1 (0 without
labels); repeated rows are scored each; an empty table gives an empty result; extra columns pass on, and those
that have the name of an output column are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quern.llm.common import cut, map_batches
from quern.llm.common import words as words_of

PER_LABEL = 6000
VOCABULARY = 20_000
THRESHOLD = 0.7
#: Lengths of the starts of words that are features.
STARTS = (4, 5)
_WORD = re.compile(r"[^\W_]+")
# Terms that can stand for each other, by list, and the neutral words.
IDENTITY = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics"),
    ("gay", "lesbian", "straight", "bisexual", "transgender"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("immigrant", "immigrants", "refugee", "refugees", "foreigner", "foreigners"),
    ("deaf", "blind", "disabled"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("muslime", "christen", "juden", "hindus", "buddhisten", "atheisten", "katholiken"),
    ("schwule", "lesben", "bisexuelle", "transsexuelle"),
    ("einwanderer", "flüchtlinge", "ausländer", "migranten"),
    ("femmes", "hommes", "filles", "garçons"),
    ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées", "catholiques"),
    ("gays", "lesbiennes", "bisexuels", "transgenres"),
    ("immigrés", "réfugiés", "étrangers", "migrants"),
    ("mujeres", "hombres", "niñas", "niños"),
    ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos", "católicos"),
    ("homosexuales", "lesbianas", "bisexuales", "transexuales"),
    ("inmigrantes", "refugiados", "extranjeros"),
)
NEUTRAL = ("person", "people", "menschen", "leute", "personnes", "gens", "personas", "gente")


@dataclass
class Model:
    base: float = 0.0
    weights: dict[str, float] = field(default_factory=dict)
    terms: frozenset[str] = frozenset()

    def score(self, text: str | None) -> float:
        z = self.base + sum(self.weights[f] for f in features(tokens(text), self.terms) & self.weights.keys())
        return float(1 / (1 + np.exp(-np.clip(z, -35, 35))))


def tokens(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def features(words: set[str], terms: frozenset[str]) -> set[str]:
    """Words, and the first letters of the longer ones; identity terms count as words alone."""
    starts = {f"{w[:n]}*" for w in words if len(w) > 4 and w not in terms for n in STARTS if n < len(w)}
    return words | starts


def swaps(words: set[str], identity=IDENTITY, neutral=NEUTRAL) -> list[set[str]]:
    """The words of the text's counterfactual copies."""
    out = []
    for terms in identity:
        for term in words.intersection(terms):
            out += [(words - {term}) | {other} for other in (*terms, *neutral) if other != term]
    return out


def _bounded(docs: DataFrame, labels: DataFrame, text: str, label: str, doc_id: str, per_label: int) -> tuple[DataFrame, dict[int, int]]:
    """(text, label, weight) of the sample, and the number of rows of each label. The sample is drawn among the labels, before texts are read."""
    rows = labels.filter(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("drawn_id"), F.col(label).cast("int").alias("label"))
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    share = {k: min(1.0, per_label / n) for k, n in counts.items()}
    limit = F.when(F.col("label") == 1, share.get(1, 1.0)).otherwise(share.get(0, 1.0)) * (1 << 20)
    drawn = cut(rows.filter(F.pmod(F.xxhash64(F.col("drawn_id").cast("string")), F.lit(1 << 20)) < limit))
    small = drawn.count() <= 4 * per_label
    texts = docs.filter(F.col(text).isNotNull()).select(F.col(doc_id).alias("text_id"), F.col(text).alias("text"))
    joined = texts.join(F.broadcast(drawn) if small else drawn, F.col("text_id") == F.col("drawn_id"))
    return cut(_weighed(joined.select("text", "label"))), counts


def _weighed(sample: DataFrame) -> DataFrame:
    """Add `weight`, one part of the number of texts of that label that agree in the least and the greatest digest of their runs of three words.

    Copies of one text would make its rare words look like marks of its label. Near copies mostly agree in both digests, and other texts don't.
    """
    w = words_of(F.col("text"))
    runs = F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.xxhash64(F.get(F.col("w"), i), F.get(F.col("w"), i + 1), F.get(F.col("w"), i + 2)))
    ends = F.when(F.size("w") >= 3, F.struct(F.array_min("runs").alias("a"), F.array_max("runs").alias("b"))).otherwise(F.struct(F.xxhash64("text").alias("a"), F.lit(0).cast("long").alias("b")))
    keyed = sample.withColumn("w", w).withColumn("runs", F.when(F.size("w") >= 3, runs)).withColumn("ends", ends).drop("w", "runs")
    copies = keyed.groupBy(F.col("label").alias("l"), F.col("ends").alias("e")).agg(F.count("*").alias("copies"))
    return keyed.join(copies, (F.col("label") == F.col("l")) & (F.col("ends") == F.col("e"))).select("text", "label", (1 / F.col("copies")).alias("weight"))


def _vocabulary(sample: DataFrame, size: int, terms: frozenset[str]) -> tuple[list[str], dict[int, float]]:
    """The features that tell the labels apart best, and the weight of each label's texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count: dict[str, list[float]] = {}
            for text, label, weight in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for name in features(tokens(text), terms):
                    count.setdefault(name, [0.0, 0.0])[label] += weight
            yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), *(pa.array([c[k] for c in count.values()], pa.float64()) for k in (0, 1))], ["name", "clean", "toxic"])

    totals = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.sum("weight").alias("n")).collect()}
    n1, n0 = float(totals.get(1, 0)), float(totals.get(0, 0))
    counted = cut(sample.select("text", "label", "weight").mapInArrow(run, "name string, clean double, toxic double").groupBy("name").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")))
    both = F.col("clean") + F.col("toxic")
    part = lambda seen, expected: F.when(seen > 0, 2 * seen * F.log(seen / expected)).otherwise(0.0)
    ratio = sum(
        (part(seen, share / (n0 + n1) * total) for seen, share, total in (
            (F.col("toxic"), n1, both), (F.col("clean"), n0, both), (n1 - F.col("toxic"), n1, n0 + n1 - both), (n0 - F.col("clean"), n0, n0 + n1 - both),
        )),
        F.lit(0.0),
    )
    chance = 2 * float(np.log(max(counted.count(), 2)))
    # Weights are sums of fractions, so ratios are compared to six digits.
    best = counted.withColumn("ratio", F.round(ratio, 6)).filter(F.col("ratio") > chance).orderBy(F.desc("ratio"), "name").limit(size)
    return sorted({*terms, *(r["name"] for r in best.select("name").collect())}), totals


def train(
    docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic", doc_id: str = "doc_id", identity=IDENTITY, neutral=NEUTRAL,
    per_label: int = PER_LABEL, size: int = VOCABULARY, ridge: float = 0.1, fairness: float = 1.0, rounds: int = 400,
) -> Model:
    """The model of a table of texts and one of labels, which meet by doc_id."""
    sample, counts = _bounded(docs, labels, text, label, doc_id, per_label)
    total = sum(counts.values())
    if not counts.get(0) or not counts.get(1):
        p = counts.get(1, 0) / total if total else 0.0
        return Model(float(np.log((p + 1e-12) / (1 - p + 1e-12))))
    terms = frozenset(t for g in (*identity, neutral) for t in g)
    vocabulary, totals = _vocabulary(sample, size, terms)
    if not totals.get(0) or not totals.get(1):
        return Model(float(np.log(counts[1] / counts[0])))
    number = {w: i for i, w in enumerate(vocabulary)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.int32())
        for batch in batches:
            out, copies = [], []
            for text in batch.column(0).to_pylist():
                words = tokens(text)
                out.append(sorted(number[f] for f in features(words, terms) & number.keys()))
                # A copy is written down as its change: the term that goes and the one that comes.
                changes = [(next(iter(words - c), None), next(iter(c - words), None)) for c in swaps(words, identity, neutral)]
                copies.append([number[w] if w else -1 for change in changes for w in change])
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(out, kind), pa.array(copies, kind)], ["label", "weight", "words", "changes"])

    rows = sample.select("text", "label", "weight").mapInArrow(run, "label int, weight double, words array<int>, changes array<int>").toPandas()
    y, weight = rows["label"].to_numpy(np.float64), rows["weight"].to_numpy(np.float64)
    held = [np.asarray(w, np.int64) for w in rows["words"]]
    owner, index = np.repeat(np.arange(len(held)), [len(h) for h in held]), np.concatenate([*held, np.zeros(0, np.int64)])
    changes = np.concatenate([np.zeros(0, np.int64), *(np.asarray(c, np.int64) for c in rows["changes"])]).reshape(-1, 2)
    per_change = np.repeat(weight, [len(c) // 2 for c in rows["changes"]])
    w, base = np.zeros(len(vocabulary) + 1), float(np.log(totals[1] / totals[0]))
    gone, come = np.where(changes < 0, len(vocabulary), changes).T  # the last weight stays 0
    # Gradient steps with momentum; steps are scaled by how often each word occurs.
    swapped = np.bincount(gone, per_change, len(w)) + np.bincount(come, per_change, len(w))
    scale = 1 / (0.25 * np.bincount(index, weight[owner], len(w)) + ridge + 2 * fairness * swapped + 1)
    speed, base_speed = np.zeros_like(w), 0.0
    for _ in range(rounds):
        z = base + np.bincount(owner, w[index], len(held))
        error = weight * (1 / (1 + np.exp(-np.clip(z, -35, 35))) - y)
        slope = np.bincount(index, error[owner], len(w)) + ridge * w
        apart = fairness * per_change * (w[come] - w[gone])
        slope += np.bincount(come, apart, len(w)) - np.bincount(gone, apart, len(w))
        speed = 0.9 * speed - 0.5 * scale * slope
        base_speed = 0.9 * base_speed - 0.5 * error.sum() / (0.25 * weight.sum() + 1)
        w, base = w + speed, base + base_speed
        w[-1] = 0.0
    # Back to the share of the labels in all labelled rows.
    base += float(np.log(counts[1] / counts[0]) - np.log(totals[1] / totals[0]))
    return Model(float(base), {t: float(w[i]) for t, i in number.items() if abs(w[i]) > 1e-6}, terms)


def score(df: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Append score (0 to 1) and predicted (1 if the score reaches the threshold)."""
    kept = df.drop("score", "predicted")
    names = kept.columns
    place = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.score(x) for x in batch.column(place).to_pylist()]
            extra = [pa.array(found, pa.float64()), pa.array([int(x >= threshold) for x in found], pa.int32())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*names, "score", "predicted"])

    schema = StructType(list(kept.schema.fields)).add("score", "double").add("predicted", "integer")
    return map_batches(kept, run, schema)
