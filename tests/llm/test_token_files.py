"""Token files: exact round trips, and whole texts against the tokenizers library."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quern.llm import token_files as tf
from quern.llm.packing import tokenizer_path

VOCABULARY = tokenizer_path("byte_bpe_50k.json")


def greedy(values, block):
    """Simple-8b word by word, as its definition goes."""
    words, starts, escapes = [], [], []
    for base in range(0, len(values), block):
        rest = values[base : base + block]
        starts.append(len(words))
        while rest:
            for s in range(1, 15):
                n, width = min(int(tf.COUNTS[s]), len(rest)), int(tf.WIDTHS[s])
                if all(v < 1 << width for v in rest[:n]):
                    words.append(s << 60 | sum(v << k * width for k, v in enumerate(rest[:n])))
                    break
            else:
                n = 1
                words.append(len(escapes))
                escapes.append(rest[0])
            rest = rest[n:]
    return words, starts, escapes


@pytest.mark.parametrize("block", [7, 64, 1024])
def test_words_equal_the_definition_and_come_back(block):
    rng = random.Random(block)
    cases = [[], [0], [2**64 - 1], [1] * 500, [2**60 - 1, 2**60, 0, 1], [rng.randrange(50257) for _ in range(3000)]]
    cases += [[rng.randrange(1 << rng.choice([1, 2, 5, 9, 16, 31, 60, 64])) for _ in range(rng.randrange(400))] for _ in range(40)]
    cases += [sum(([v] * rng.randrange(90) for v in [0, 1, 3, 900, 70_000, 2**61, 5]), []) for _ in range(20)]
    for values in cases:
        array = np.array(values, np.uint64)
        words, starts, escapes = tf.pack(array, block)
        assert (words.tolist(), starts.tolist(), escapes.tolist()) == greedy(values, block)
        assert tf.unpack(words, starts, escapes, len(values), block).tolist() == values


def test_a_record_tells_damage():
    body = tf.record(3, 4, [5, None, -7], [2, 0, 1], np.array([9, 2**63, 1], np.uint64))
    assert len(body) % 8 == 0
    ((partition, number, ids, sizes, values),) = list(tf.records(body))
    assert (partition, number, ids, sizes.tolist(), values.tolist()) == (3, 4, [5, None, -7], [2, 0, 1], [9, 2**63, 1])
    for bad in (body[:-8], body[:40], b"x" + body, body + b"x"):
        with pytest.raises(ValueError, match="byte"):
            list(tf.records(bad))


def strange_texts():
    rng = random.Random(5)
    signs = ["a", "B", "é", "ß", "1", "²", " ", "  ", "\n", "\t", "\r\n", "\x0b", "\x1c", "\x85", "\xa0", " ", "​", "　", "🙂", "'s", "'ll", "don't", ".", "--", "<|", "<|endoftext|>", "́", "中", "\x00", "#"]
    return ["".join(rng.choice(signs) for _ in range(rng.randrange(1, 30))) for _ in range(1500)]


def test_cached_pieces_equal_the_library():
    whole, mine = Tokenizer.from_file(VOCABULARY), tf.ByteBpe(VOCABULARY)
    for text in [*strange_texts(), "", " ", "word " * 5000, "x" * 3000]:
        assert np.frombuffer(mine(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)


def test_many_texts_at_once_equal_the_library(monkeypatch):
    monkeypatch.setattr(tf, "CHUNK", 200)
    whole, bpe = Tokenizer.from_file(VOCABULARY), tf.ByteBpe(VOCABULARY)
    plain = ["Two words, \nthen 3 more: $, end.", "don't, 'll, stop!!", " , \xa0, Ñu, 中, ²,", "x\t,y\x0b.z\x85!", "", " ", "\n,"]
    texts = [None, *sum(([a, b] for a, b in zip(strange_texts(), plain * 300, strict=False)), []), None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], ["doc_id", "text"])
    chunks = list(tf._chunks(iter([batch, batch.slice(0, 0), batch.slice(5, 9)])))
    assert len(chunks) > 50 and [d for c in chunks for d in c.column(0).to_pylist()] == [*range(len(texts)), *range(5, 14)]
    for chunk in chunks:
        ids, sizes = bpe.ids(chunk.column(1))
        want = [whole.encode(t or "", add_special_tokens=False).ids for t in chunk.column(1).to_pylist()]
        assert sizes.tolist() == [len(x) for x in want] and ids.tolist() == sum(want, [])


def test_a_repeated_unit_is_looked_up_once_a_chunk():
    class Counting(tf._Cache):
        looked_up = 0

        def __getitem__(self, key):
            self.looked_up += 1
            return super().__getitem__(key)

    bpe = tf.ByteBpe(VOCABULARY)
    bpe.known = Counting(bpe._unit, 1000)
    text = "one word and one word, and one more\nline."
    ids, sizes = bpe.ids(pa.array([text] * 5000))
    assert len(ids) == sizes.sum() and set(sizes.tolist()) == {len(bpe.whole.encode(text, add_special_tokens=False).ids)}
    assert bpe.known.looked_up < 20


def test_a_full_cache_gives_up_what_is_not_used_again():
    made = []
    cache = tf._Cache(lambda x: made.append(x) or x.encode(), 2)
    assert [cache[x] for x in "abcadcea"] == [x.encode() for x in "abcadcea"]
    assert len(cache) <= 2 and made.count("c") == 1 and made.count("d") == 1


def rows():
    rng = random.Random(8)
    texts = strange_texts()[:150]
    out = [(rng.randrange(-50, 10**12), t) for t in texts] + [(i, None if i % 7 == 0 else "") for i in range(30)]
    return [*out, (None, "no id # here"), (None, None), (77, "long text " * 30_000), *[(78, "a copy")] * 50]


def test_files_hold_every_document_in_order(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tf, "RECORDS_PER_FILE", 1)
    df = spark.createDataFrame(rows(), "doc_id long, text string").repartition(5).withColumns({"digest": F.lit(1), "_tie": F.lit(None).cast("string"), "start": F.lit("x")})
    folder = str(tmp_path / "ids")
    tf.encode(df, folder, VOCABULARY)
    whole = Tokenizer.from_file(VOCABULARY)
    want = sorted(((d is not None, d or 0), [*whole.encode(t or "", add_special_tokens=False).ids, tf.END]) for d, t in rows())
    got = sorted(tf.decode(spark, folder).collect(), key=lambda r: r["start"])
    ids = [((r["doc_id"] is not None, r["doc_id"] or 0), np.frombuffer(r["ids"], "<u4").tolist()) for r in got]
    assert [x[0] for x in ids] == [x[0] for x in want] and sorted(ids) == want
    at = 0
    for r in got:
        assert r["start"] == at and r["n_tokens"] == len(r["ids"]) // 4
        at += r["n_tokens"]
    crc = {(r["start"], r["doc_id"]): r["ids_crc32"] for r in tf.digests(spark, folder).collect()}
    assert crc == {(r["start"], r["doc_id"]): zlib.crc32(r["ids"]) for r in got}


def test_empty_tables_and_other_ids(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id int, text string")
    assert tf.token_files(empty, VOCABULARY, str(tmp_path / "none")).count() == 0
    with pytest.raises(TypeError, match="integer"):
        tf.encode(spark.createDataFrame([("a", "b")], "doc_id string, text string"), str(tmp_path / "bad"), VOCABULARY)
