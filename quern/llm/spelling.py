"""Words grouped with the frequent words that they are one edit away from.

1. `counted_words` counts the words of all texts.
2. `trie` makes an edge table of the compressed trie of all words, each also written backwards: `>word` and `<drow`
   are two strings of one trie. Its nodes are the words and the longest common prefixes of neighbours in sorted order; a node's parent
   is what it shares with the node before it. Words are sorted by ranges, never in one task.
3. `neighbours` keeps a frontier of (word, position, node, edits) states and joins it with the edge table level by level. A state
   without an edit follows its own word; where an edge departs from it, it may replace, skip or add one code point there, and
   from then on has to agree exactly. A state with one edit that ends with its word at a word's node is a pair of neighbours.
   Edits are only made in the second half of a string. The edit of two words lies in the second half of at least one of
   its two writings, and there nodes have few children, so the frontier stays near the number of words.
4. `variants` gives each word the most frequent neighbour that has several times its occurrences, and follows these forms to the last by doubling pointers.

A round advances by an edge, which may have a label of many code points, so rounds follow the branches of the trie and not the
length of words. Every round's states are checkpointed. Edges near the roots, where most words meet, are broadcast for two rounds, as
an alphabet of 90 letters bounds their number; from the third on a node holds a small share of the words, and Spark splits what is skewed.

Defined results: a null text has no words; a null id counts as an empty one in the damage of `counted_words`; copies count each time; ties of forms go to
the first word in code-point order; an empty table gives an empty result; other columns don't matter; words may be of any length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import cut, release

#: Letters that words are made of, as a class of a regular expression: the 52 of ASCII and 64 of Latin-1.
LETTERS = "A-Za-zÀ-ÿ"
MIN_LENGTH, MIN_COUNT, RATIO = 6, 5, 5
#: Of so many pairs of text and word, one loses a letter (0: none).
DAMAGE = 199
_FORWARD, _BACKWARD = ">", "<"


def counted_words(df: DataFrame, text: str = "text", doc_id: str = "doc_id", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, damage: int = DAMAGE) -> DataFrame:
    """(word, n): maximal runs of letters, with A-Z as small letters, of at least `min_length` code points and `min_count` occurrences.

    Where `damage` divides the CRC-32 of `<doc_id>:<run>`, the run loses the letter at that number's remainder by its length.
    """
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    runs = df.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("d"), F.explode(F.regexp_extract_all(F.col(text), F.lit(f"[{LETTERS}]{{{min_length},}}"), F.lit(0))).alias("run"))
    small = runs.select("d", F.when(F.col("run").rlike("[A-Z]"), F.translate("run", upper, lower)).otherwise(F.col("run")).alias("run"))
    word = F.col("run")
    if damage:
        at = F.pmod("h", F.length("run")).cast("int")
        small = small.withColumn("h", F.crc32(F.concat("d", F.lit(":"), "run")))
        word = F.when(F.col("h") % damage == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))).otherwise(word)
    return small.select(word.alias("word")).filter(F.length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= min_count)


def _agreement(a: Column, b: Column) -> Column:
    """The number of leading code points that two different strings share."""
    letters = lambda x: F.split(x, "")
    return (F.array_position(F.zip_with(letters(a), letters(b), lambda x, y: x.eqNullSafe(y)), F.lit(False)) - 1).cast("int")


def _shared(strings: DataFrame) -> DataFrame:
    """(node, shared) of distinct strings `node`: the code points that each shares with the one before it in order; 0 for the first."""
    dealt = cut(strings.repartitionByRange("node").sortWithinPartitions("node").withColumn("part", F.spark_partition_id()))
    # One row per partition, so this window is small.
    ends = dealt.groupBy("part").agg(F.max("node").alias("last")).withColumn("before", F.lag("last").over(Window.orderBy("part"))).select("part", "before")
    inside = dealt.withColumn("prev", F.lag("node").over(Window.partitionBy("part").orderBy("node")))
    prev = F.coalesce("prev", "before", F.lit(""))
    return inside.join(ends, "part").select("node", _agreement(prev, F.col("node")).alias("shared"))


def trie(marked: DataFrame) -> DataFrame:
    """The edges (parent, label, child, is_word, next) of the compressed trie of distinct strings `node`.

    `is_word` tells whether the child is one of the strings, and `next` has a bit for each first letter that may follow it, by
    code point modulo 64.
    """
    inner = _shared(marked).select(F.substring("node", F.lit(1), F.col("shared")).alias("node")).union(marked.select(F.substring("node", 1, 1))).filter("node <> ''")
    nodes = marked.withColumn("is_word", F.lit(True)).union(inner.withColumn("is_word", F.lit(False))).groupBy("node").agg(F.max("is_word").alias("is_word"))
    parted = _shared(nodes.select("node"))
    edges = parted.filter("shared > 0").select(
        F.substring("node", F.lit(1), F.col("shared")).alias("parent"), F.substring("node", F.col("shared") + 1, F.length("node")).alias("label"), F.col("node").alias("child")
    )
    follow = edges.groupBy(F.col("parent").alias("node")).agg(F.bit_or(_bit(F.col("label"))).alias("next"))
    known = nodes.join(follow, "node", "left").select(F.col("node").alias("child"), "is_word", F.coalesce("next", F.lit(0).cast("long")).alias("next"))
    return edges.join(known, "child")


def _bit(letters: Column) -> Column:
    """A 64-bit number with the bit of the first letter, by its code point modulo 64."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.ascii(letters), F.lit(64)))


def neighbours(words: DataFrame) -> DataFrame:
    """(word, near) for all pairs of distinct words `word` that one inserted, deleted or replaced code point tells apart, in both orders."""
    both = F.array(F.concat(F.lit(_FORWARD), "word"), F.concat(F.lit(_BACKWARD), F.reverse("word")))
    marked = cut(words.select(F.explode(both).alias("node")))
    edges = cut(trie(marked))
    frontier = marked.select(F.col("node").alias("word"), F.lit(1).alias("p"), F.substring("node", 1, 1).alias("node"), F.lit(0).alias("edits"))
    found, near_root, depth = [], None, 0
    while depth == 0 or not frontier.isEmpty():
        here = edges
        if depth == 0:
            here = F.broadcast(edges.filter(F.length("parent") == 1))
            near_root = edges.filter(F.length("parent") == 1).select(F.col("child").alias("c"))
        elif depth == 1:
            here = F.broadcast(edges.join(F.broadcast(near_root), F.col("parent") == F.col("c"), "left_semi"))
        moved = cut(_advanced(frontier, here))
        found.append(moved.filter("hit").select("word", "node"))
        frontier = moved.filter("alive").select("word", "p", "node", "edits")
        depth += 1
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.union(more)
    plain = lambda c: F.when(F.substring(c, 1, 1) == _FORWARD, F.substring(c, F.lit(2), F.length(c))).otherwise(F.reverse(F.substring(c, F.lit(2), F.length(c))))
    return pairs.select(plain("word").alias("word"), plain("node").alias("near")).distinct()


def _advanced(frontier: DataFrame, edges: DataFrame) -> DataFrame:
    """The states (word, p, node, edits) one edge further, and whether each is a `hit` and `alive`."""
    length, label, rest = F.length("word"), F.col("label"), F.substring("word", F.col("p") + 1, F.length("label") + 1)
    half = F.floor(F.length("word") / 2)
    first = F.substring("label", 1, 1)
    # Up to its first half, or after its edit, a state only takes the edge that goes on with its word.
    bound = (F.col("edits") == 1) | (F.col("p") < half)
    held = frontier.filter(bound).withColumn("go", F.substring("word", F.col("p") + 1, F.lit(1)))
    one = held.join(edges, (F.col("node") == F.col("parent")) & (F.col("go") == first)).drop("go")
    many = frontier.filter(~bound).join(edges, F.col("node") == F.col("parent"))
    size = F.length("label")
    # The first code point, from 1, in which label and rest differ; beyond the label if they agree.
    m = F.when(F.startswith(rest, label), size + 1).when(first != F.substring(rest, 1, 1), F.lit(1)).otherwise(_agreement(label, rest) + 1)
    pairs = one.union(many).withColumns({"rest": rest, "m": m.cast("int"), "len": length, "half": half})
    m, rest, p = F.col("m"), F.col("rest"), F.col("p")
    agree = m > size
    edit = (F.col("edits") == 0) & ~agree & (p + m - 1 >= F.col("half"))
    tail = F.substring(label, m + 1, size)
    inside = m <= F.length(rest)
    state = lambda condition, at, edits: F.when(condition, F.struct(at.cast("int").alias("p"), edits.alias("edits")))
    states = F.array(
        state(agree, p + size, F.col("edits")),
        state(edit & inside & (tail == F.substring(rest, m + 1, size - m)), p + size, F.lit(1)),
        state(edit & (tail == F.substring(rest, m, size - m)), p + size - 1, F.lit(1)),
        state(edit & inside & (F.substring(label, m, size) == F.substring("word", p + m + 1, size - m + 1)), p + size + 1, F.lit(1)),
    )
    out = pairs.select(F.col("word"), "child", "is_word", "next", "len", "half", F.explode(F.array_compact(states)).alias("s")).select("word", "child", "is_word", "next", "len", "half", "s.*")
    left = F.col("len") - F.col("p")
    ended = (F.col("edits") == 1) & (left == 0) | (F.col("edits") == 0) & (left == 1) & (F.col("p") >= F.col("half"))
    goes = F.col("next").bitwiseAND(_bit(F.substring("word", F.col("p") + 1, F.lit(1)))) != 0
    alive = F.when(F.col("edits") == 1, (left > 0) & goes).otherwise(F.col("next") != 0)
    out = out.select("word", "p", F.col("child").alias("node"), "edits", (F.col("is_word") & ended).alias("hit"), alive.alias("alive"))
    return out.filter("hit or alive")


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of counted words (word, n).

    `form` is the most frequent neighbour, if it has `ratio` times the word's occurrences at least; `root` is the last of the forms of forms.
    """
    words = cut(words)
    near = neighbours(words.select("word"))
    counts = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    best = near.join(counts, "near").groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best"))
    large = -F.col("best.minus") >= F.col("n") * ratio
    out = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(large, F.col("best.near")).alias("form"), F.when(large, -F.col("best.minus")).alias("form_n")
    )
    out = cut(out)
    return out.join(_ends(out.filter("form is not null").select("word", "form")), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _ends(forms: DataFrame) -> DataFrame:
    """(word, root): where the pointers of (word, form) lead to. Occurrences grow along them, so there is no ring."""
    now = forms.select("word", F.col("form").alias("root"))
    while True:
        ahead = now.select(F.col("word").alias("w"), F.col("root").alias("further"))
        now = cut(now.join(ahead, F.col("root") == F.col("w"), "left").select("word", F.coalesce("further", "root").alias("root"), F.col("w").isNotNull().alias("moved")))
        if now.filter("moved").isEmpty():
            return now.select("word", "root")
        now = now.drop("moved")
        release(now.sparkSession)
