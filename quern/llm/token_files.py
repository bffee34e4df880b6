"""Token ids of whole texts in files of 64-bit words, coded as Simple-8b.

`encode` writes, `decode` reads. Documents are dealt out by ranges of their ids, tokenised where they lie in order, and
written through Spark's own committed writer, so a lost executor costs its tasks and leaves no half file.

Format: a file is a row of records, all little-endian and a multiple of 8 bytes long:

    header    8 words: magic "QTOKENS1", partition, record in the partition, documents, ids, blocks,
              words of payload, escaped values
    table     a word of two's complement per document: its id; a word each: 1 if it has an id, 0 if that is null, plus
              2 times the number of its token ids
    offsets   a word per block: the payload's word at which it starts
    payload   the blocks' words
    escapes   the raw values that don't fit
    trailer   8 bytes "QTOKEND\n"

A record closes with the document that brings it to RECORD ids. Its ids are cut into blocks of BLOCK, and every block starts on a
word of its own, so blocks decode independently. A word holds a selector in its upper 4 bits and, from the
lowest bit on, as many values as that selector says, of equal width (`COUNTS`, `WIDTHS`). Selector 0 is an escape: its lower
bits are the place of one value of more than 60 bits in `escapes`; so each word is a word of known kind, and all words
of a selector decode in one numpy step.

Defined results: a null text counts as an empty one, which has the end id alone; a null id comes before all
others; repeated rows and repeated ids each keep their own tokens, in order of their texts' digests; a table without rows gives files
without records; ids of documents are integers of up to 64 bits, and other types are refused; other columns don't matter.
"""

from __future__ import annotations

import re
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from quern.llm.common import cut, shared_folder
from quern.llm.tokens import byte_letters

END = 2
BLOCK, RECORD = 1024, 1 << 16
#: Bytes of text that are tokenised at once; a longer text is by itself.
CHUNK = 4 << 20
#: Records in a file; with RECORD ids of 20 bits each, about 20 MB.
RECORDS_PER_FILE = 128
MAGIC, TRAILER = b"QTOKENS1", b"QTOKEND\n"
#: How many values a word of each selector holds, and of how many bits.
COUNTS = np.array([1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 1], np.int64)
WIDTHS = np.array([60, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 60], np.int64)
_USED = range(1, 15)
_HEADER = 8


def bit_widths(values: np.ndarray) -> np.ndarray:
    """The number of bits of each unsigned 64-bit integer, exactly."""
    high = values >> np.uint64(32)
    low = values & np.uint64(0xFFFFFFFF)
    # A float's exponent is exact for less than 53 bits.
    return np.where(high > 0, np.frexp(high.astype(float))[1] + 32, np.frexp(low.astype(float))[1])


def selectors(values: np.ndarray, block: int) -> np.ndarray:
    """The densest selector whose values fit, at every place; a block's last word may hold fewer than its selector says."""
    n = len(values)
    choice = np.zeros(n, np.uint8)
    # A float's exponent is exact for less than 53 bits.
    width = bit_widths(values) if n and values.max() >> np.uint64(53) else np.frexp(values.astype(float))[1]
    # The widest of the next `seen` values of the block; beyond its end nothing is wide.
    widest, seen = np.zeros((-(-n // block), block), np.uint8), 1
    widest.reshape(-1)[:n] = width
    for s in reversed(_USED):
        while seen < COUNTS[s]:
            step = min(seen, int(COUNTS[s]) - seen)
            widest[:, :-step] = np.maximum(widest[:, :-step], widest[:, step:])
            seen += step
        fit = widest.reshape(-1)[:n] <= WIDTHS[s]
        if not fit.any():
            # A denser selector asks for more and narrower values.
            break
        choice[fit] = s
    return choice


def pack(values: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(payload words, word at which each block starts, escaped values) of unsigned 64-bit integers."""
    n = len(values)
    place = np.arange(n)
    room = np.minimum(block - place % block, n - place)
    choice = selectors(values, block)
    taken = np.minimum(COUNTS[choice], room)
    at, starts, step = 0, [], taken.tolist()
    while at < n:
        starts.append(at)
        at += step[at]
    start = np.array(starts, np.int64)
    chosen = choice[start]
    words = chosen.astype(np.uint64) << np.uint64(60)
    for s in np.unique(chosen):
        mine = np.flatnonzero(chosen == s)
        if s == 0:
            words[mine] |= np.arange(mine.size, dtype=np.uint64)
            continue
        first, have = start[mine], taken[start[mine]]
        for k in range(int(have.max())):
            if have.min() <= k:
                mine, first, have = mine[have > k], first[have > k], have[have > k]
            words[mine] |= values[first + k] << np.uint64(k * WIDTHS[s])
    return words, np.searchsorted(start, np.arange(0, n, block)), values[start[chosen == 0]]


def unpack(words: np.ndarray, offsets: np.ndarray, escapes: np.ndarray, n: int, block: int = BLOCK) -> np.ndarray:
    """The `n` values of `pack`."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    count = COUNTS[selector]
    # A block's last word may be cut short by the block's end: places count from the block's start.
    before = np.cumsum(count) - count
    owner = np.repeat(np.arange(len(offsets)), np.diff(np.append(offsets, len(words))))
    place = before - before[offsets][owner] + owner * block if len(words) else before
    limit = np.minimum((owner + 1) * block, n)
    out = np.zeros(n, np.uint64)
    for s in np.unique(selector):
        mine = np.flatnonzero(selector == s)
        if s == 0:
            out[place[mine]] = escapes[(words[mine] & np.uint64((1 << 60) - 1)).astype(np.int64)]
            continue
        mask = np.uint64((1 << int(WIDTHS[s])) - 1)
        for k in range(int(COUNTS[s])):
            have = mine[place[mine] + k < limit[mine]]
            out[place[have] + k] = (words[have] >> np.uint64(k * WIDTHS[s])) & mask
    return out


def record(partition: int, number: int, doc_ids: list[int | None], sizes: list[int], values: np.ndarray) -> bytes:
    words, offsets, escapes = pack(values)
    header = np.array([partition, number, len(sizes), len(values), len(offsets), len(words), len(escapes)], "<u8")
    keys = np.array([d or 0 for d in doc_ids], "<i8")
    known = np.array([d is not None for d in doc_ids], np.uint64) + np.array(sizes, np.uint64) * np.uint64(2)
    parts = [header, keys, known.astype("<u8"), offsets.astype("<u8"), words.astype("<u8"), escapes.astype("<u8")]
    return b"".join([MAGIC, *(p.tobytes() for p in parts), TRAILER])


def records(content: bytes) -> Iterator[tuple[int, int, list[int | None], np.ndarray, np.ndarray]]:
    """(partition, number, doc ids, sizes, token ids) of each record of a file; a damaged one raises ValueError."""
    at = 0
    while at < len(content):
        if content[at : at + 8] != MAGIC or len(content) < at + 8 * _HEADER:
            raise ValueError(f"no record at byte {at}")
        partition, number, docs, ids, n_blocks, n_words, n_escapes = np.frombuffer(content, "<u8", 7, at + 8).tolist()
        sizes = [docs, docs, n_blocks, n_words, n_escapes]
        end = at + 8 * (_HEADER + sum(sizes))
        if content[end : end + 8] != TRAILER:
            raise ValueError(f"the record at byte {at} is cut short")
        edges = np.cumsum([_HEADER, *sizes])
        body = np.frombuffer(content, "<u8", int(edges[-1]), at)
        keys, table, offsets, words, escapes = (body[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True))
        known = (table & np.uint64(1)).astype(bool).tolist()
        doc_ids = [k if have else None for k, have in zip(keys.view("<i8").tolist(), known, strict=True)]
        yield partition, number, doc_ids, (table >> np.uint64(1)).astype(np.int64), unpack(words, offsets.astype(np.int64), escapes, ids)
        at = end + 8


class ByteBpe:
    """The ids of texts, by the tokenizers library.

    The vocabulary's rules split a text to pieces before any merge: a word with the space before it, a number, a
    run of signs, or white space. A piece's ids don't depend on its neighbours, so each is merged once by
    the library's model and kept in a cache, which gives up what is not used again when it is full. A text is cut to units before spaces and around line ends,
    and at all white space where two such characters meet; the marks that end a unit are a piece of their own after a letter or digit.
    Units of many texts are cut, told apart and put back in place as Arrow columns, so only the different ones of a
    chunk are looked up. Texts in which the library's and Python's notions of
    white space differ, or with what may be a special token, go through the library whole.
    """

    CACHED = 250_000
    _UNIT = re.compile(r" ?\S+|\s+(?!\S)|\s+")
    _MARKS = ",.;:!?"
    _WHOLE = ("<|", "\x1c", "\x1d", "\x1e", "\x1f")
    #: What keeps a text from being cut at spaces and line ends alone: one of _WHOLE, or white space that meets.
    _ODD = "<[|]|[\x1c-\x1f]|[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{2}"
    #: Letters and digits by any version of Unicode, at the end.
    _WORD_END = "[0-9A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f]$"

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.letters = dict(enumerate(byte_letters()))
        # Fixed value: the split of byte-level vocabularies.
        self.pieces = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+").findall
        self.known = _Cache(self._unit, self.CACHED)

    @staticmethod
    @lru_cache(maxsize=2)
    def load(path: str) -> ByteBpe:
        return ByteBpe(path)

    def __call__(self, text: str) -> bytes:
        """A text's ids as little-endian 32-bit unsigned integers."""
        return self.ids(pa.array([text], pa.large_string()))[0].tobytes()

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one text after the other, and how many each has; a null text has none."""
        cut = self._cut(texts.cast(pa.large_string()).fill_null(""))
        units = cut.flatten().dictionary_encode()
        coded = self._coded(units.dictionary)
        sizes = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
        lists = pa.LargeListArray.from_arrays(np.append(0, np.cumsum(sizes)), np.frombuffer(b"".join(coded), "<u4"))
        ids = lists.take(units.indices).flatten().to_numpy()
        stops = np.cumsum(sizes[units.indices.to_numpy()])
        # Every text has a unit.
        return ids, np.diff(stops[np.cumsum(pc.list_value_length(cut).to_numpy()) - 1], prepend=0)

    def _cut(self, texts: pa.Array) -> pa.Array:
        """Each text's units."""
        odd = pc.match_substring_regex(texts, self._ODD)
        plain = texts.filter(pc.invert(odd))
        # No plain text has the separator. A line end is a unit of its own, a space begins one.
        for sign, apart in ((" ", "\x1f "), ("\n", "\x1f\n\x1f")):
            plain = pc.replace_substring(plain, sign, apart)
        units = pc.split_pattern(plain, "\x1f")
        if not odd.true_count:
            return units
        others = pa.array(map(self._cut_odd, texts.filter(odd).to_pylist()), units.type)
        place = np.argsort(np.argsort(odd.to_numpy(zero_copy_only=False), kind="stable"))
        return pa.concat_arrays([units, others]).take(pa.array(place))

    def _cut_odd(self, text: str) -> list[str]:
        return [text] if any(x in text for x in self._WHOLE) else self._UNIT.findall(text)

    def _coded(self, units: pa.Array) -> list[bytes]:
        stems = pc.utf8_rtrim(units, characters=self._MARKS)
        stems = pc.if_else(pc.match_substring_regex(stems, self._WORD_END), stems, units)
        known = self.known
        pairs = zip(*(x.to_numpy(zero_copy_only=False).tolist() for x in (units, stems)), strict=True)
        return [known[s] if len(s) == len(u) else known[s] + known[u[len(s) :]] for u, s in pairs]

    def _unit(self, unit: str) -> bytes:
        if unit.removeprefix(" ").isalpha():
            return self._piece(unit)
        if any(x in unit for x in self._WHOLE):
            return np.array(self.whole.encode(unit, add_special_tokens=False).ids, "<u4").tobytes()
        pieces = self.pieces(unit)
        return self._piece(unit) if len(pieces) == 1 else b"".join(map(self.known.__getitem__, pieces))

    def _piece(self, piece: str) -> bytes:
        spelled = piece.replace(" ", self.letters[32]) if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(self.letters)
        return array("I", [token.id for token in self.model.tokenize(spelled)]).tobytes()


class _Cache(dict):
    """Made values by key. When `most` are held, all but those that are used again before the next `most` are given up."""

    def __init__(self, make, most: int):
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key: str) -> bytes:
        out = self.old.get(key)
        if out is None:
            out = self.make(key)
        if len(key) <= 64:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[key] = out
        return out


def encode(df: DataFrame, folder: str, vocabulary: str, text: str = "text", doc_id: str = "doc_id", end: int = END) -> None:
    """Write the ids of every text of `df`, in ascending order of `doc_id`, to files in `folder`."""
    if not isinstance(df.schema[doc_id].dataType, IntegralType):
        raise TypeError(f"{doc_id} has to be an integer column")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe.load(vocabulary)
        partition, number = TaskContext.get().partitionId(), 0
        ids, sizes, parts, held = [], [], [], 0
        for chunk in _chunks(batches):
            coded, lengths = bpe.ids(chunk.column(1))
            coded, lengths = np.insert(coded, np.cumsum(lengths), end), lengths + 1
            first = 0
            for d, n, stop in zip(chunk.column(0).to_pylist(), lengths.tolist(), np.cumsum(lengths).tolist(), strict=True):
                ids.append(d)
                sizes.append(n)
                held += n
                if held >= RECORD:
                    yield _row(partition, number, ids, sizes, [*parts, coded[first:stop]])
                    ids, sizes, parts, held, number, first = [], [], [], 0, number + 1, stop
            parts.append(coded[first:])
        if ids:
            yield _row(partition, number, ids, sizes, parts)

    # Rows with a common id are dealt out by their texts, and copies by their place.
    keys = ["doc_id", "digest", "tie"]
    slim = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("digest"), F.monotonically_increasing_id().alias("tie"))
    dealt = slim.repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "text")
    out = dealt.mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value"))
    # The writer puts raw bytes and, after each row, the separator, here the record's trailer.
    out.write.option("lineSep", TRAILER.decode()).option("maxRecordsPerFile", RECORDS_PER_FILE).option("compression", "none").text(folder)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches' rows in parts of about CHUNK bytes of text, which is the second column."""
    for batch in batches:
        size = pc.binary_length(batch.column(1)).fill_null(0).to_numpy()
        edges = np.flatnonzero(np.diff(np.cumsum(size, dtype=np.int64) // CHUNK)) + 1
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows], strict=True):
            if a < b:
                yield batch.slice(a, b - a)


def _row(partition: int, number: int, ids: list, sizes: list, parts: list) -> pa.RecordBatch:
    values = np.concatenate(parts).astype(np.uint64)
    body = record(partition, number, ids, sizes, values).removesuffix(TRAILER)
    return pa.RecordBatch.from_arrays([pa.array([body], pa.binary())], ["record"])


def decode(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of the files' documents; `start` counts the ids of all documents before it, `ids` has unsigned 32-bit integers."""
    return _read(spark, folder, lambda ids: ids.astype("<u4").tobytes(), "ids binary", pa.binary())


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of the files' documents."""
    return _read(spark, folder, lambda ids: zlib.crc32(ids.astype("<u4").tobytes()), "ids_crc32 long", pa.int64())


def _read(spark: SparkSession, folder: str, made, column: str, kind: pa.DataType) -> DataFrame:
    """A row per document, in which `made` of its ids is the last column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                for partition, number, doc_ids, sizes, values in records(content.as_py()):
                    stops = np.cumsum(sizes)
                    outs = [made(values[b - n : b]) for n, b in zip(sizes.tolist(), stops.tolist(), strict=True)]
                    same = [np.full(len(sizes), x, np.int64) for x in (partition, number)]
                    columns = [pa.array(x) for x in (*same, doc_ids, stops - sizes, sizes)]
                    columns[2] = columns[2].cast(pa.int64())
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(outs, kind)], ["partition", "number", "doc_id", "inside", "n_tokens", column.split()[0]])

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                yield _heads(content.as_py())

    files = spark.read.format("binaryFile").load(folder).select("content")
    # One row per record, thousands of documents each; the window runs over partitions first, then within them.
    heads = cut(files.mapInArrow(totals, "partition long, number long, n long"))
    whole = heads.groupBy("partition").agg(F.sum("n").alias("n"))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    firsts = whole.select("partition", before(Window.orderBy("partition")).alias("first"))
    starts = heads.select("partition", "number", before(Window.partitionBy("partition").orderBy("number")).alias("at")).join(firsts, "partition")
    starts = starts.select("partition", "number", (F.col("first") + F.col("at")).alias("base"))
    docs = files.mapInArrow(run, f"partition long, number long, doc_id long, inside long, n_tokens long, {column}")
    return docs.join(starts, ["partition", "number"]).select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", column.split()[0])


def _heads(content: bytes) -> pa.RecordBatch:
    """Partition, number and ids of a file's records, from their headers."""
    at, rows = 0, []
    while at < len(content):
        partition, number, docs, ids, n_blocks, n_words, n_escapes = np.frombuffer(content, "<u8", 7, at + 8).tolist()
        rows.append((partition, number, ids))
        at += 8 * (_HEADER + 2 * docs + n_blocks + n_words + n_escapes + 1)
    table = np.array(rows, np.int64).reshape(-1, 3)
    return pa.RecordBatch.from_arrays([pa.array(table[:, k]) for k in range(3)], ["partition", "number", "n"])


def token_files(df: DataFrame, vocabulary: str, folder: str | None = None, **options) -> DataFrame:
    """Write `df`'s ids to files and read their digests back from them."""
    spark = df.sparkSession
    folder = folder or f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    encode(df, folder, vocabulary, **options)
    return digests(spark, folder)
