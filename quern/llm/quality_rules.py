"""Quality rules: a threshold table compiled into one Spark projection.

`measures(text)` gives every document its length, symbol, stop-word, repetition and line
figures, and `quality_rules` adds one boolean from a table of thresholds. Everything is a column
expression, so the plan is a scan and projections: no shuffle, no user function.

Defined results: a null text counts as an empty one (no words, so not kept); a null doc_id stays
null; repeated rows are judged row by row; an empty table gives an empty result; extra columns
are passed on, and one that has the name of an output column is replaced by it. Texts of any
length are measured whole; the repeat figure takes O(n log n) for n words.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import free_names, words

WINDOW = 5
SYMBOLS = "[#*$%&|<>]"
# Common function words of the four languages.
STOP_WORDS = (
    "the be to of and that have with is in it for on as by this are was "
    "der die das und zu den von mit ist ein nicht sich auf für im "
    "le la les de des et en un une du que est pour dans sur par "
    "el los las que y en un una por con para del no se"
).split()


@dataclass(frozen=True)
class Rule:
    """`(numerator + prior) / denominator` must lie in [low, high]; a zero denominator counts as one.

    The prior keeps a floor on a ratio from failing texts too short to show the ratio.
    """

    name: str
    numerator: str
    denominator: str | None = None
    low: float | None = None
    high: float | None = None
    prior: float = 0.0

    def passes(self) -> Column:
        value = F.col(self.numerator).cast("double") + F.lit(self.prior)
        if self.denominator:
            value = value / F.greatest(F.col(self.denominator), F.lit(1)).cast("double")
        ok = F.lit(True)
        if self.low is not None:
            ok = ok & (value >= F.lit(float(self.low)))
        if self.high is not None:
            ok = ok & (value <= F.lit(float(self.high)))
        return ok


#: The production thresholds.
RULES = (
    Rule("word_count", "n_words", low=10, high=1_000_000),
    Rule("mean_word_length", "word_chars", "n_words", low=2, high=14),
    Rule("symbols_to_words", "n_symbols", "n_words", high=0.3),
    Rule("stop_words", "n_stop_words", "n_words", low=0.02, prior=0.5),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", high=0.35),
)

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words")


def measures(df: DataFrame, text: str = "text") -> DataFrame:
    """Append the columns of MEASURES. Arrays that a later step reads more than once get a projection of their own."""
    body = F.coalesce(F.col(text), F.lit(""))
    out = df.drop(*(c for c in df.columns if c.lower() in MEASURES and c != text))
    w, lines, h, s, p = free_names(out, "w", "lines", "h", "s", "p")
    out = out.withColumns({w: words(F.col(text)), lines: F.filter(F.split(body, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})
    # Windows of five words as 64-bit digests; a text under five words has none.
    out = out.withColumn(
        h,
        F.when(
            F.size(w) >= WINDOW,
            F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*[F.get(F.col(w), i + k) for k in range(WINDOW)])),
        ).otherwise(F.array().cast("array<bigint>")),
    )
    # Only a text with a repeated window has its (digest, position) pairs sorted.
    out = out.withColumn(
        s,
        F.when(
            F.size(F.array_distinct(h)) < F.size(h),
            F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))),
        ),
    )
    same = lambda e, j: (e["h"] == F.get(F.col(s), j - 1)["h"]) | (e["h"] == F.get(F.col(s), j + 1)["h"])
    out = out.withColumn(p, F.sort_array(F.filter(F.transform(s, lambda e, j: F.when(same(e, j), e["i"])), lambda x: x.isNotNull())))
    covered = F.aggregate(
        F.transform(p, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col(p), j + 1) - x, F.lit(WINDOW)))),
        F.lit(0).cast("long"),
        lambda a, x: a + x,
    )
    stop = F.array(*map(F.lit, dict.fromkeys(STOP_WORDS)))
    return out.withColumns(
        {
            "n_words": F.size(w).cast("long"),
            "word_chars": F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.length(x)),
            "n_symbols": F.regexp_count(body, F.lit(SYMBOLS)).cast("long"),
            "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
            "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
            "n_lines": F.size(lines).cast("long"),
            "n_stop_words": F.regexp_count(F.lower(body), F.lit(r"(?<![^\x20\x09-\x0D])(?:" + "|".join(dict.fromkeys(STOP_WORDS)) + r")(?![^\x20\x09-\x0D.,;:!?#*$%&|<>])")).cast("long"),
        }
    ).drop(w, lines, h, s, p)


def quality_rules(df: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """Append the measures, `base_failed`, and `kept`: true if the base rules and every rule of the table hold."""
    out = measures(df, text)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    verdict = F.lit(True)
    for rule in rules:
        verdict = verdict & rule.passes()
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & verdict)
