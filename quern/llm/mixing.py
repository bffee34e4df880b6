"""Mixing sources to target weights by entropy balancing.

The mix repeats document i at a rate r_i between 0 and `cap`. Its constraints are on tokens: each source meets its target
number of words, and the words' mean log length of a document, and that length's spread, stay those of the corpus, so that a source of long documents
does not change what lengths the mix is made of. Of all such rates entropy balancing takes those closest to the base rate of 1 in
relative entropy (of r and of cap - r), weighted by size. Its convex dual has a multiplier for each source and one for each
length moment, and its optimum tilts the odds of every document exponentially,

    r_i / (cap - r_i) = exp(lambda_source + mu . f_i) / (cap - 1),

where f_i are the standardised log length and its square less one. The targets of sources are met exactly; the moments have a small ridge,
as no rates may meet both. Newton's method finds the multipliers: in each round Spark sums the gradient and the Hessian over (source, size) classes. The
Hessian is diagonal in the sources, so these are eliminated by a grouped sum, a two-by-two system is solved, and every source moves on its own as a row of a table.

Rates become whole copies by systematic rounding along each source's documents in order of size: the copies of any prefix
differ from the sum of its rates by less than one, and no document gets more than `cap` copies. Documents that weigh on the target are rounded
first, and the rates of the others are scaled to what these leave, so a source misses its target by about a short document.

Everything is DataFrame operations. Sums are taken over (source, size) classes first, so neither
a source that holds a third of the rows nor a common size becomes one task's work: within a class
documents are dealt to buckets by a digest of doc_id and text, and only a bucket's own rows are ranked. Sources, of which
there may be many, are ranked by ranges; the level at which targets stop comes from a few grouped sums.

Defined results: a null text or one without words has size 0 and takes nothing; a null source is
a source of its own, after all others; a null doc_id is treated as a value; repeated rows each
count; ties fall to digests, and rows equal in id and text are interchangeable; an
empty table gives an empty result; extra columns are dropped. Reruns agree on every row.
"""

from __future__ import annotations

from math import sqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import cut, n_words

CAP = 3
BUCKETS = 64
BUCKET_ROWS = 500_000
#: Rates are rounded to this many parts of one, far above the noise of sums in another order, and are summed as whole numbers.
PARTS = 10_000_000
#: Starting points of the systematic rounding that each source tries.
PHASES = 16
#: A document is long if this many of its size exceed its source's target.
LONG = 200
#: Weight of the multipliers' squares for the length moments, for each word of the corpus.
RIDGE = 0.05


def ranked_sources(sizes: DataFrame) -> DataFrame:
    """`sizes` with `place`, the source's number by code point, null last, from 0. Ranges of sources are ranked each by itself."""
    ranged = cut(sizes.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("range", F.spark_partition_id()))
    # One row per range.
    counts = ranged.groupBy("range").agg(F.count("*").alias("rows"))
    before = counts.select(F.col("range").alias("r"), (F.sum("rows").over(Window.orderBy("range")) - F.col("rows")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("range").orderBy(F.col("source").asc_nulls_last()))
    return ranged.withColumn("inside", inside).join(before, F.col("range") == F.col("r")).withColumn("place", F.col("before") + F.col("inside") - 1).drop("range", "r", "before", "inside")


def source_targets(sizes: DataFrame, cap: int = CAP, cycle: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources, by code point and null last, weigh `cycle`, repeating, and share the sum of all sizes.
    A target stops at `cap` times its source's size and the excess is shared again by weight, until none is above: each round
    finds from three sums the share of a unit of weight, which only grows.
    """
    weight = F.element_at(F.array(*map(F.lit, cycle)), (F.col("place") % len(cycle) + 1).cast("int")).cast("long")
    weighed = cut(ranked_sources(sizes).withColumn("weight", weight).drop("place"))
    wide = lambda c: F.col(c).cast("decimal(18,0)")
    share, weights, stopped = weighed.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0)), F.lit(0)).first()
    total = share
    while True:
        over = wide("source_size") * F.lit(cap * weights).cast("decimal(18,0)") < wide("weight") * F.lit(share).cast("decimal(18,0)") if weights else F.lit(True)
        above, left, n = weighed.agg(F.coalesce(F.sum(F.when(over, F.col("source_size"))), F.lit(0)), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0)), F.count(F.when(over, 1))).first()
        share, weights = total - cap * above, left
        if n == stopped:
            break
        stopped = n
    target = F.when(over, (cap * F.col("source_size")).cast("double"))
    return weighed.select("source", "source_size", target.otherwise((F.lit(share) * F.col("weight")).cast("double") / F.lit(float(max(weights, 1)))).alias("target"))


def balance(cells: DataFrame, cap: int = CAP, ridge: float = RIDGE, rounds: int = 60) -> DataFrame:
    """Add `rate` to cells (source, size, n, source_size, target) by Newton's method on the dual."""
    words = F.col("n") * F.col("size").cast("double")
    log_size = F.log2(F.col("size").cast("double"))
    total, mean, square = cells.filter("size > 0").agg(F.coalesce(F.sum(words), F.lit(0.0)), F.sum(words * log_size), F.sum(words * log_size * log_size)).first()
    if not total:
        return cells.withColumn("rate", F.lit(0.0))
    mean /= total
    spread = sqrt(max(square / total - mean * mean, 0.0))
    # Sums of floating-point numbers depend on their order, so what is this small is rounding.
    f1 = (log_size - mean) / spread if spread > 1e-6 else F.lit(0.0)
    capped = F.col("target") >= cap * F.col("source_size")
    open_cells = cells.filter((F.col("size") > 0) & ~capped & (F.col("target") > 0))
    open_cells = cut(open_cells.select("source", "target", "source_size", words.alias("w"), f1.alias("f1"), (f1 * f1 - 1 if spread > 1e-6 else F.lit(0.0)).alias("f2")))
    sources = open_cells.groupBy("source").agg(F.max("target").alias("target"), F.max("source_size").alias("source_size"))
    mean_rate = F.col("target") / F.col("source_size")
    lams = cut(sources.select(F.col("source").alias("s"), F.log((cap - 1) * mean_rate / (cap - mean_rate)).alias("lam")))
    m1 = m2 = 0.0
    for turn in range(2 * rounds):
        at = open_cells.join(lams, F.col("source").eqNullSafe(F.col("s")))
        at = at.withColumn("r", _rate(F.col("lam") + m1 * F.col("f1") + m2 * F.col("f2"), cap))
        at = at.withColumns({"wr": F.col("w") * F.col("r"), "wh": F.col("w") * F.col("r") * (1 - F.col("r") / cap)})
        add = lambda x: F.sum(x)
        wh, a, b = F.col("wh"), F.col("f1"), F.col("f2")
        sums = cut(
            at.groupBy("source").agg(
                F.max("lam").alias("lam"), F.max("target").alias("target"), (add("wr") - F.max("target")).alias("g"), add(wh).alias("h"), add(wh * a).alias("a1"), add(wh * b).alias("a2"),
                add(wh * a * a).alias("b11"), add(wh * a * b).alias("b12"), add(wh * b * b).alias("b22"), add(F.col("wr") * a).alias("g1"), add(F.col("wr") * b).alias("g2"),
            )
        )
        g, h, a1, a2 = (F.col(c) for c in ("g", "h", "a1", "a2"))
        s11, s12, s22, r1, r2, off = sums.agg(
            add(F.col("b11") - a1 * a1 / h), add(F.col("b12") - a1 * a2 / h), add(F.col("b22") - a2 * a2 / h),
            add(a1 * g / h - F.col("g1")), add(a2 * g / h - F.col("g2")), F.max(F.abs(g) / F.col("target")),
        ).first()
        if off is None:
            break
        s11, s22, r1, r2 = s11 + ridge * total, s22 + ridge * total, r1 - ridge * total * m1, r2 - ridge * total * m2
        det = s11 * s22 - s12 * s12
        d1, d2 = (r1 * s22 - r2 * s12) / det, (r2 * s11 - r1 * s12) / det
        # Where lengths hardly differ within sources the moments can't be met and their multipliers go far; after `rounds` they stay, and the sources' follow.
        shrink = min(1.0, 2.0 / max(abs(d1), abs(d2), 1e-300)) if turn < rounds else 0.0
        d1, d2 = d1 * shrink, d2 * shrink
        if off < 1e-9 and max(abs(d1), abs(d2)) < 1e-9:
            break
        step = (-g - a1 * d1 - a2 * d2) / h
        lams = sums.select(F.col("source").alias("s"), (F.col("lam") + F.greatest(F.lit(-2.0), F.least(F.lit(2.0), step))).alias("lam"))
        m1, m2 = m1 + d1, m2 + d2
    else:
        raise RuntimeError(f"the mix did not converge in {2 * rounds} rounds")
    tilted = _rate(F.col("lam") + m1 * f1 + m2 * (f1 * f1 - 1 if spread > 1e-6 else F.lit(0.0)), cap)
    rate = F.when((F.col("size") == 0) | (F.col("target") == 0), 0.0).when(capped, float(cap)).otherwise(tilted)
    return cells.join(lams, F.col("source").eqNullSafe(F.col("s")), "left").withColumn("rate", rate).drop("s", "lam")


def _rate(z: Column, cap: int) -> Column:
    return cap / (1 + (cap - 1) * F.exp(-z))


def entropy_mix(df: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", cap: int = CAP, buckets: int = BUCKETS, rows: int = BUCKET_ROWS) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, rate, copies, taken.

    Documents of one source and size are ranked in at least `buckets` buckets, and in so many that none holds more than about `rows`.
    """
    sized = cut(df.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"), F.xxhash64(F.col(doc_id).cast("string"), F.col(text)).alias("digest")))
    docs = sized.withColumn("bucket", F.pmod(F.xxhash64("digest"), F.lit(max(buckets, sized.count() // rows))))
    classes = docs.groupBy("source", "size", "bucket").agg(F.count("*").alias("n"))
    per_size = cut(classes.groupBy("source", "size").agg(F.sum("n").alias("n")))
    targets = source_targets(per_size.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))).withColumnRenamed("source", "s")
    cells = cut(balance(cut(per_size.join(targets, F.col("source").eqNullSafe(F.col("s"))).drop("s")), cap).withColumn("parts", F.round(F.col("rate") * PARTS).cast("long")).withColumn("rate", F.col("parts") / F.lit(PARTS)))
    # Long documents are rounded first, and the others' rates scaled to what is left of the target.
    cells = cells.withColumn("long", F.col("size") * LONG > F.col("target"))
    weight = F.col("parts").cast("decimal(12,0)") * (F.col("n") * F.col("size")).cast("decimal(20,0)")
    expected = (F.sum(F.when(~F.col("long"), weight).otherwise(F.lit(0).cast("decimal(30,0)"))) / F.lit(PARTS)).cast("double")
    first = cut(cells.filter("long").withColumnRenamed("target", "goal").join(cells.groupBy(F.col("source").alias("o")).agg(expected.alias("others")), F.col("source").eqNullSafe(F.col("o"))).drop("o"))
    long = _phases(first.withColumn("target", F.col("goal") - F.col("others"))).drop("others", "target").withColumnRenamed("goal", "target")
    done = long.groupBy(F.col("source").alias("o")).agg(F.max("words").alias("done"))
    done = cells.groupBy("source").agg(expected.alias("others")).join(done, F.col("source").eqNullSafe(F.col("o")), "left").select(F.col("source").alias("o"), "others", F.coalesce("done", F.lit(0)).alias("done"))
    rest = cut(cells.filter("not long").join(done, F.col("source").eqNullSafe(F.col("o"))).drop("o").withColumnRenamed("target", "goal").withColumn("target", F.greatest(F.col("goal") - F.col("done"), F.lit(0.0))))
    scaled = F.when(F.col("others") > 0, F.least(F.col("rate") * F.col("target") / F.col("others"), F.lit(float(cap)))).otherwise(0.0)
    others = _phases(rest.withColumn("parts", F.round(scaled * PARTS).cast("long"))).drop("others", "done", "target").withColumnRenamed("goal", "target")
    chosen = cut(long.unionByName(others).select(F.col("source").alias("s"), F.col("size").alias("z"), "source_size", "target", "rate", "parts", "start", "u"))
    by_bucket = Window.partitionBy("source", "size").orderBy("bucket")
    dealt = classes.withColumn("before", F.sum("n").over(by_bucket) - F.col("n")).join(chosen, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")))
    dealt = dealt.select("s", "z", F.col("bucket").alias("b"), "before", "source_size", "target", "rate", "parts", "start", "u")
    in_bucket = Window.partitionBy("source", "size", "bucket").orderBy("digest", "doc_id")
    ranked = docs.withColumn("rank", F.row_number().over(in_bucket)).join(dealt, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")) & (F.col("bucket") == F.col("b")))
    upto = lambda k: _whole(F.col("start") + k.cast("decimal(18,0)") * F.col("parts").cast("decimal(12,0)"), F.col("u"))
    place = F.col("before") + F.col("rank")
    return ranked.withColumn("copies", (upto(place) - upto(place - 1)).cast("long")).select(
        "doc_id", "source", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )


def _phases(cells: DataFrame) -> DataFrame:
    """Add to cells (source, size, n, parts, target) `start`, the rates of the source's longer documents, and the source's starting point `u` and `words` taken: of PHASES points the one that comes closest to the target."""
    exact = F.col("n").cast("decimal(18,0)") * F.col("parts").cast("decimal(12,0)")
    by_size = Window.partitionBy("source").orderBy(F.desc("size"))
    placed = cut(cells.withColumn("start", (F.sum(exact).over(by_size) - exact).cast("decimal(38,0)")).withColumn("all", exact.cast("decimal(38,0)")))
    words = lambda u: (_whole(F.col("start") + F.col("all"), u) - _whole(F.col("start"), u)) * F.col("size")
    tried = placed.select("source", "target", F.explode(F.transform(F.sequence(F.lit(0), F.lit(PHASES - 1)), lambda u: F.struct(u.alias("u"), words(u).alias("words")))).alias("x"))
    tried = tried.groupBy("source", F.col("x.u").alias("u")).agg(F.sum("x.words").alias("words"), F.max("target").alias("target"))
    best = tried.groupBy("source").agg(F.min(F.struct(F.abs(F.col("words") - F.col("target")).alias("miss"), "u", "words")).alias("best"))
    best = best.select(F.col("source").alias("s"), F.col("best.u").alias("u"), F.col("best.words").alias("words"))
    return placed.join(best, F.col("source").eqNullSafe(F.col("s"))).drop("s", "all")


def _whole(parts: Column, phase: Column) -> Column:
    """floor(parts / PARTS + phase / PHASES)."""
    return F.floor((parts + (phase * (PARTS // PHASES)).cast("decimal(12,0)")) / F.lit(PARTS).cast("decimal(12,0)")).cast("long")
