"""Packing tokenised documents into sequences of a fixed length by swap-based local search.

1. `pieces` tokenises every document once and cuts the ones longer than a sequence.
2. Pieces are dealt out in shards of a bounded number of tokens and pieces, and each shard is packed by itself: `fold` makes
   a first packing, and `Search` then exchanges pieces between underfull bins. A move, a one-for-one, a two-for-one or a
   one-for-two exchange from an emptier bin to one at least as full increases the sum of squared fills, so the emptiest
   bins empty. Of the exchanges that an emptier bin can make, the one that leaves the fuller one least room is made. It ends when the bins are as few
   as the pieces allow (`fewest`), or no exchange helps. Bins with the same content are one kind and are exchanged together. Every
   shard is searched with all of these moves.
3. Bins that are full are done, but for as many as are underfull. The pieces of these, some percent, are dealt out anew in fewer shards, until one
   shard is left; it also reopens full bins if it has more bins than its pieces need.

A shard is a bounded group and shards are even, whatever lengths, ids or copies are common: pieces are dealt by their
place in the checkpointed table. Nothing comes to the driver but row counts.

Defined results: a null text counts as an empty one and gives a piece of the end token alone; a
null doc_id stays null; ids of any type will do; repeated rows are packed once each; an empty table gives an empty result;
extra columns are dropped. Only texts longer than a sequence are cut.
"""

from __future__ import annotations

import random
import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quern.llm.common import cut, free_names, groups_of
from quern.llm.tokens import WordBpe

LIMIT = 4096
END_ID = 1
#: Sequences' worth of tokens, and pieces, that a shard holds on average.
SHARD_BINS, SHARD_PIECES = 512, 20_000
#: Times that the last shard reopens full bins, and how many of them.
REOPENINGS, REOPENED = 24, 60

#: What a bin holds: its pieces' lengths, falling.
Bin = tuple[int, ...]


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(df: DataFrame, text: str = "text", doc_id: str = "doc_id", path: str | None = None, limit: int = LIMIT, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): the pieces of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = WordBpe.load(path or tokenizer_path())
        end = end_id.to_bytes(4, "little")
        for batch in batches:
            ids, rows = batch.column(0), []
            for i, text in enumerate(batch.column(1).to_pylist()):
                data = encode(text or "") + end
                for k in range(0, len(data), 4 * limit):
                    part = data[k : k + 4 * limit]
                    rows.append((i, k // (4 * limit), k // 4, len(part) // 4, zlib.crc32(part)))
            at, piece, start, length, crc = zip(*rows, strict=True) if rows else ((),) * 5
            columns = [ids.take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])

    slim = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = StructType([slim.schema["doc_id"]]).add("piece", "integer").add("start", "long").add("length", "long").add("ids_crc32", "long")
    return slim.mapInArrow(run, schema)


def fold(counts: dict[int, int], limit: int) -> Counter[Bin]:
    """A first packing of {length: pieces}, as {bin: how many}: the longest piece left opens a bin, and the shortest ones left fill it."""
    left, up = dict(counts), sorted(counts)
    low, high = 0, len(up) - 1
    out: Counter[Bin] = Counter()
    while low <= high:
        if not left[up[high]]:
            high -= 1
            continue
        need, free, k = Counter({up[high]: 1}), limit - up[high], low
        while k <= high and up[k] <= free:
            n = min(free // up[k], left[up[k]] - need[up[k]])
            if n > 0:
                need[up[k]] += n
                free -= n * up[k]
            k += 1
        bins = min(left[x] // n for x, n in need.items() if n)
        for x, n in need.items():
            left[x] -= n * bins
        out[tuple(sorted(need.elements(), reverse=True))] += bins
        while low <= high and not left[up[low]]:
            low += 1
    return out


class Search:
    """Local search over kinds of bins.

    `slots[c]` has the ways to make room for c tokens in an underfull bin: (bin, the piece that leaves it, if any) -> the bin's fill. Ways with
    two leaving pieces are many, so they are not listed but looked for once nothing else helps.
    """

    def __init__(self, kinds: dict[Bin, int], limit: int):
        self.limit = limit
        self.full: Counter[Bin] = Counter()
        self.under: dict[Bin, int] = {}
        self.slots: defaultdict[int, dict] = defaultdict(dict)
        self.sums: dict[Bin, np.ndarray] = {}  # of two pieces, for the bins that were looked at
        self.rooms: list[int] = []  # the keys of `slots` in order
        self.queue: list[tuple[int, Bin]] = []
        self.bins = 0
        for kind, n in kinds.items():
            self.add(kind, n)

    def add(self, kind: Bin, n: int) -> None:
        fill = sum(kind)
        if not kind:
            return
        self.bins += n
        if fill == self.limit:
            self.full[kind] += n
        elif kind in self.under:
            self.under[kind] += n
        else:
            self.under[kind] = n
            heappush(self.queue, (fill, kind))
            for out in self._leave(kind):
                at = self.slots[self.limit - fill + sum(out)]
                if not at:
                    insort(self.rooms, self.limit - fill + sum(out))
                at[kind, out] = fill

    def take(self, kind: Bin, n: int) -> None:
        self.bins -= n
        self.under[kind] -= n
        if self.under[kind]:
            return
        del self.under[kind]
        self.sums.pop(kind, None)
        free = self.limit - sum(kind)
        for out in self._leave(kind):
            at = self.slots[free + sum(out)]
            del at[kind, out]
            if not at:
                del self.rooms[bisect_left(self.rooms, free + sum(out))]

    @staticmethod
    def _leave(kind: Bin) -> list[Bin]:
        return [(), *((x,) for x in set(kind))]

    def find(self, low: Bin) -> tuple[Bin, Bin, Bin] | None:
        """What to exchange between `low` and a bin at least as full: (given, the bin, taken)."""
        fill, alone = sum(low), self.under[low] == 1
        # A bin as full as `low` has at most this much room.
        most = self.limit - fill
        best = None
        pairs = sorted(set(combinations(low, 2)), key=sum, reverse=True)
        for given in ([(x,) for x in sorted(set(low), reverse=True)], pairs):
            for give in given:
                size = sum(give)
                i = bisect_left(self.rooms, size)
                while i < len(self.rooms) and (room := self.rooms[i]) - size < (best[0] if best else most):
                    for (kind, out), f in self.slots[room].items():
                        if sum(out) < size and f >= fill and (kind != low or not alone) and (out or len(give) == 1):
                            best = (room - size, give, kind, out)
                            break
                    i += 1
                if best and not best[0]:
                    return best[1:]
            if best:
                return best[1:]
        return self._two_leave(low)

    def _two_leave(self, low: Bin) -> tuple[Bin, Bin, Bin] | None:
        """One piece of `low` for two of a bin at least as full."""
        own, fill = np.unique(low), sum(low)
        for kind, n in self.under.items():
            if len(kind) < 2 or sum(kind) < fill or (kind == low and n == 1):
                continue
            if kind not in self.sums:
                self.sums[kind] = np.unique([a + b for a, b in set(combinations(kind, 2))])
            sums = self.sums[kind]
            # The largest sum below each of the low bin's pieces.
            at = np.searchsorted(sums, own) - 1
            fits = (at >= 0) & (own - sums[at] <= self.limit - sum(kind))
            if fits.any():
                k = int(fits.argmax())
                return (int(own[k]),), kind, next(p for p in combinations(kind, 2) if sum(p) == sums[at[k]])
        return None

    def exchange(self, low: Bin, give: Bin, high: Bin, out: Bin) -> None:
        n = self.under[low] // 2 if low == high else min(self.under[low], self.under[high])
        new_low, new_high = list(low), list(high)
        for x in give:
            new_low.remove(x)
        for x in out:
            new_high.remove(x)
        self.take(low, n)
        self.take(high, n)
        self.add(tuple(sorted((*new_low, *out), reverse=True)), n)
        self.add(tuple(sorted((*new_high, *give), reverse=True)), n)

    def run(self) -> Counter[Bin]:
        """Exchange until the bins are as few as the pieces allow or no exchange helps."""
        least = fewest(self.under, self.limit) + sum(self.full.values())
        stuck: list[Bin] = []
        moved = False
        while self.bins > least:
            if not self.queue:
                if not moved:
                    break
                self.queue = [(sum(k), k) for k in stuck if k in self.under]
                heapify(self.queue)
                stuck, moved = [], False
                continue
            fill, low = heappop(self.queue)
            if low not in self.under:
                continue
            found = self.find(low)
            if found is None:
                stuck.append(low)
                continue
            moved = True
            self.exchange(low, *found)
            if low in self.under:
                heappush(self.queue, (fill, low))
        return self.full + Counter(self.under)


def fewest(kinds: dict[Bin, int], limit: int) -> int:
    """A number of bins below which no packing of these pieces can go.

    Besides the tokens themselves it sees pieces that fill a bin badly. Two kinds of rounding keep whatever fits one bin within one bin: a piece counts as
    so many k-th parts of a bin as it has whole (k+1)-th parts, so pieces over a half count one, those over a third
    a half, and so on; or pieces over limit - a count as whole bins, and those under a as nothing.
    """
    lengths = lengths_of(kinds)
    if not lengths:
        return 0
    x, n = (np.array(v, np.int64) for v in zip(*sorted(lengths.items()), strict=True))
    best = -(-int((x * n).sum()) // limit)
    for k in range(1, 25):
        # In limit * k-th parts; a whole number of (k+1)-th parts keeps its own size.
        parts = np.where((k + 1) * x % limit == 0, k * x, (k + 1) * x // limit * limit)
        best = max(best, -(-int((parts * n).sum()) // (limit * k)))
    half = x[x <= limit // 2]
    tokens = np.concatenate([[0], np.cumsum(x * n)])
    count = np.concatenate([[0], np.cumsum(n)])
    # Pieces from a to limit - a by their tokens, and longer ones by their number.
    low, high = np.searchsorted(x, half), np.searchsorted(x, limit - half, "right")
    if half.size:
        bound = count[-1] - count[high] + -(-(tokens[high] - tokens[low]) // limit)
        best = max(best, int(bound.max()))
    return best


def lengths_of(kinds: dict[Bin, int]) -> Counter[int]:
    out: Counter[int] = Counter()
    for kind, n in kinds.items():
        for x in kind:
            out[x] += n
    return out


def pack_lengths(counts: dict[int, int], limit: int = LIMIT, reopenings: int = 0) -> Counter[Bin]:
    """A packing of {length: pieces} as {bin: how many}."""
    kinds = Search(fold(counts, limit), limit).run()
    least = fewest(kinds, limit)
    for turn in range(reopenings):
        if sum(kinds.values()) <= least:
            break
        # The underfull bins and some full ones are packed afresh, from a first-fit start in another order.
        full = sorted((k for k in kinds if sum(k) == limit), key=lambda k: (-len(k), k))
        rng = random.Random(turn)
        again = Counter({k: n for k, n in kinds.items() if sum(k) < limit})
        again.update(dict.fromkeys(rng.sample(full[: 4 * REOPENED], min(REOPENED, len(full))) if turn % 2 else full[:REOPENED], 1))
        items = list(lengths_of(again).elements())
        rng.shuffle(items)
        found = Search(first_fit(items, limit), limit).run()
        if sum(found.values()) < sum(again.values()):
            kinds = kinds - again + found
    return kinds


def first_fit(items: Iterable[int], limit: int) -> Counter[Bin]:
    bins: list[list[int]] = []
    for x in items:
        at = next((b for b in bins if sum(b) + x <= limit), None)
        if at is None:
            bins.append([x])
        else:
            at.append(x)
    return Counter(tuple(sorted(b, reverse=True)) for b in bins)


def place(lengths: np.ndarray, limit: int, reopenings: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each piece its bin, its offset there, and whether the bin is done: full, and not among the ones of most pieces that come along with the underfull ones."""
    order = np.argsort(lengths, kind="stable")
    values, first, n = np.unique(lengths[order], return_index=True, return_counts=True)
    following = dict(zip(values.tolist(), first.tolist(), strict=True))
    ids, offsets, done = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), np.zeros(len(lengths), bool)
    kinds = pack_lengths(dict(zip(values.tolist(), n.tolist(), strict=True)), limit, reopenings)
    number, along = 0, sum(bins for kind, bins in kinds.items() if sum(kind) < limit)
    for kind, bins in sorted(kinds.items(), key=lambda x: (-len(x[0]), x)):
        offset, full = 0, sum(kind) == limit
        for x in kind:
            rows = order[following[x] : following[x] + bins]
            following[x] += bins
            ids[rows], offsets[rows], done[rows] = np.arange(number, number + bins), offset, full and np.arange(bins) >= along
            offset += x
        number += bins
        along = max(along - bins, 0) if full else along
    return ids, offsets, done


def pack(parts: DataFrame, limit: int = LIMIT, shard_bins: int = SHARD_BINS, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Add sequence_id and offset to pieces that have a `length` up to `limit`. Other columns pass on."""
    columns = [c for c in parts.columns if c not in ("sequence_id", "offset")]
    key, done_with = free_names(parts, "key", "done")
    # A checkpointed row's place doesn't change, so neither does its number.
    todo = cut(parts.select(*columns).withColumn(key, F.monotonically_increasing_id()))
    done, turn, before = [], 0, None
    schema = StructType(todo.schema.fields).add("sequence_id", "long").add("offset", "long").add(done_with, "boolean")
    while True:
        rows, tokens = todo.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
        shards = max(1, -(-tokens // (limit * shard_bins)), -(-rows // shard_pieces))
        last = shards == 1 or (before is not None and 4 * rows > 3 * before)
        todo = cut(_pack_shards(todo, shards, turn, key, done_with, schema, limit, REOPENINGS if last else 0))
        if last:
            break
        done.append(todo.filter(done_with))
        todo, turn, before = todo.filter(~F.col(done_with)).drop("sequence_id", "offset", done_with), turn + 1, rows
    for part in done:
        todo = todo.unionByName(part)
    return todo.drop(key, done_with)


def _pack_shards(rows: DataFrame, shards: int, turn: int, key: str, done: str, schema: StructType, limit: int, reopenings: int) -> DataFrame:
    """Each shard packed by itself, with sequence_id (of turn, shard and bin), offset, and whether the sequence is done."""
    names = schema.fieldNames()
    shard = done + "_shard"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups_of(batches, shard):
            ids, offsets, away = place(group.column("length").to_numpy(), limit, reopenings)
            ids += (turn << 56) + (group.column(shard)[0].as_py() << 24)
            kept = [group.column(k).combine_chunks() for k in range(len(names) - 3)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(ids), pa.array(offsets), pa.array(away)], names)

    dealt = rows.withColumn(shard, F.pmod(F.xxhash64(F.col(key), F.lit(turn)), F.lit(shards)))
    return dealt.repartition(min(shards, 4096), shard).sortWithinPartitions(shard, key).mapInArrow(run, schema)


def pack_documents(df: DataFrame, text: str = "text", doc_id: str = "doc_id", path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(pieces(df, text, doc_id, path, limit), limit).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
