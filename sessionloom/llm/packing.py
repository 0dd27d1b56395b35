"""Best-fit packing of token pieces into sequences by swap-based local search.

Lengths are integers from 1 to the capacity, so a corpus is, for packing, one
count for each length.  The search works on kinds of bins (a multiset of
lengths, and how many bins there are of that kind); each move is applied to as
many bins at once as both sides have, the one that adds most over all of them
first, and the search ends when no move is left.
Best fit uses up, with each kind it makes, an older kind or a length, so it
leaves at most three kinds for each length whatever the corpus; a move adds two
at most.  Pieces find their place by their rank among the pieces of their
length, so no piece is ever collected.
"""

from __future__ import annotations

import bisect
import heapq
import zlib
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, pick, prepare, staged
from .tokens import encoder, tokenizer_path

_PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, part int, nth long"


# --- choosing bins ---------------------------------------------------------


def best_fit(counts: dict[int, int], capacity: int) -> Counter:
    """Best-fit decreasing over counts of lengths: kinds of bins and their numbers.

    A kind is a tuple of lengths, longest first.  Equal bins are filled together.
    """
    open_by_room: dict[int, Counter] = defaultdict(Counter)
    rooms: list[int] = []  # ascending
    full: Counter = Counter()

    def put(kind: tuple[int, ...], room: int, n: int) -> None:
        if room == 0:
            full[kind] += n
            return
        if not open_by_room[room]:
            bisect.insort(rooms, room)
        open_by_room[room][kind] += n

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                many = max(1, capacity // length)
                if left >= many:
                    put((length,) * many, capacity - many * length, left // many)
                    left -= left // many * many
                else:
                    put((length,) * left, capacity - left * length, 1)
                    left = 0
                continue
            room = rooms[at]
            kinds = open_by_room[room]
            kind, n = next(iter(kinds.items()))
            many = min(room // length, left)
            used = min(n, left // many)
            kinds[kind] -= used
            if not kinds[kind]:
                del kinds[kind]
            if not kinds:
                rooms.pop(at)
            put((*kind, *(length,) * many), room - many * length, used)
            left -= used * many
    for kinds in open_by_room.values():
        full.update(kinds)
    return Counter({tuple(sorted(k, reverse=True)): n for k, n in full.items() if n})


def _pair_sums(kind: tuple[int, ...]) -> dict[int, tuple[int, int]]:
    """Two lengths of a kind by their sum."""
    held = Counter(kind)
    own = sorted(held)
    return {a + b: (a, b) for i, a in enumerate(own) for b in own[i:] if a != b or held[a] > 1}


class Kinds:
    """Kinds of bins in arrays, so that all moves of one kind with all others are weighed at once.

    Only underfull kinds have their lengths, and sums of two of them, in the
    arrays; a kind that has run out keeps its slot with a count of 0.
    """

    def __init__(self, bins: Counter, capacity: int):
        self.capacity, self.slot, self.kinds = capacity, {}, []
        self.fill, self.count = np.zeros(64, np.int64), np.zeros(64, np.int64)
        #: (value, slot) of lengths, and of sums of two.
        self.ones, self.twos = np.zeros((2, 256), np.int64), np.zeros((2, 256), np.int64)
        self.n_ones = self.n_twos = 0
        for kind, n in sorted(bins.items()):
            self.add(kind, n)

    @staticmethod
    def _grown(array: np.ndarray, size: int) -> np.ndarray:
        while array.shape[-1] < size:
            array = np.concatenate([array, np.zeros_like(array)], axis=-1)
        return array

    def add(self, kind: tuple[int, ...], n: int) -> int:
        slot = self.slot.setdefault(kind, len(self.kinds))
        if slot == len(self.kinds):
            self.kinds.append(kind)
            self.fill, self.count = self._grown(self.fill, slot + 1), self._grown(self.count, slot + 1)
            self.fill[slot] = sum(kind)
            if self.fill[slot] < self.capacity:
                own, sums = sorted(set(kind)), sorted(_pair_sums(kind))
                self.ones, self.twos = self._grown(self.ones, self.n_ones + len(own)), self._grown(self.twos, self.n_twos + len(sums))
                self.ones[:, self.n_ones : self.n_ones + len(own)] = own, [slot] * len(own)
                self.twos[:, self.n_twos : self.n_twos + len(sums)] = sums, [slot] * len(sums)
                self.n_ones, self.n_twos = self.n_ones + len(own), self.n_twos + len(sums)
        self.count[slot] += n
        return slot

    def bins_of(self, giver: int, taker: int) -> int:
        """To how many bins a move between two kinds applies."""
        return int(self.count[giver] // 2 if giver == taker else min(self.count[giver], self.count[taker]))

    def best(self, slot: int) -> tuple[int, int, int, tuple[int, ...], int] | None:
        """(worth, giver, taker, what goes, what comes back or 0) of the best move of a kind with any.

        The taker is as full as the giver or fuller and gains ``g``: squared fill
        grows by twice g * (difference + g) in each of the bins it applies to.
        """
        kind, fill, count = self.kinds[slot], self.fill[slot], self.count[slot]
        if fill >= self.capacity or not count:
            return None
        worth, found = 0, None

        def weigh(gain: np.ndarray, room: np.ndarray, apart: np.ndarray, n: np.ndarray):
            """Where the best of these moves is, if it is better than the best so far."""
            nonlocal worth
            if not len(n):
                return None
            value = np.where((gain > 0) & (gain <= room), n * gain * (apart + gain), 0)
            at = int(value.argmax())
            if value[at] <= worth:
                return None
            worth = int(value[at])
            return at

        own, sums = sorted(set(kind)), _pair_sums(kind)
        back, other = self.ones[:, : self.n_ones]
        apart, n = self.fill[other] - fill, np.minimum(self.count[other], count)
        n = np.where(apart < 0, 0, np.where(other == slot, count // 2, n))
        room = self.capacity - self.fill[other]
        for x in own:
            if (at := weigh(np.full(len(back), x), room, apart, n)) is not None:
                found = (slot, int(other[at]), (x,), 0)
        for x, gives in [*((x, (x,)) for x in own), *sums.items()]:
            if (at := weigh(x - back, room, apart, n)) is not None:
                found = (slot, int(other[at]), gives, int(back[at]))
        for single, (values, other) in ((True, self.ones[:, : self.n_ones]), (False, self.twos[:, : self.n_twos])):
            apart, n = fill - self.fill[other], np.minimum(self.count[other], count)
            n, room = np.where((apart < 0) | (other == slot), 0, n), self.capacity - fill
            for y in ([0] if single else []) + own:
                if (at := weigh(values - y, room, apart, n)) is not None:
                    giver, x = int(other[at]), int(values[at])
                    found = (giver, slot, (x,) if single else _pair_sums(self.kinds[giver])[x], y)
        return (worth, *found) if found else None


def local_search(bins: Counter, capacity: int) -> Counter:
    """Exchange or move lengths between underfull bins while squared fill grows.

    Moves: one piece from a bin to a fuller one; one piece for a larger one; two
    pieces for one larger.  Each lets the fuller bin gain and the emptier one
    lose the same amount, which always increases the sum of squared fills; a bin
    that empties is gone.  A move applies to all bins of both kinds at once, and
    the one that adds most over all of them goes first, so whole kinds move
    before single bins do.  It ends when no two bins have a move left: every kind
    waits with its best move until it has none with any other, and a kind that
    comes anew is weighed against all.
    """
    kinds = Kinds(bins, capacity)
    waiting: list[tuple] = []

    def wait(slot: int) -> None:
        if move := kinds.best(slot):
            heapq.heappush(waiting, (-move[0], slot, *move[1:]))

    for slot in range(len(kinds.kinds)):
        wait(slot)
    while waiting:
        worth, slot, giver, taker, gives, back = heapq.heappop(waiting)
        n, gain = kinds.bins_of(giver, taker), sum(gives) - back
        if 2 * n * gain * int(kinds.fill[taker] - kinds.fill[giver] + gain) < -worth or not n:
            wait(slot)  # its partner has gone, or most of its bins have
            continue
        left, more = list(kinds.kinds[giver]), [*kinds.kinds[taker], *gives]
        for x in gives:
            left.remove(x)
        if back:
            more.remove(back)
            left.append(back)
        kinds.count[giver] -= n
        kinds.count[taker] -= n
        for new in (left, more):
            if new:
                at = kinds.add(tuple(sorted(new, reverse=True)), n)
                if kinds.count[at] - n < 2:  # it wasn't there, or can now pair with its like
                    wait(at)
        wait(slot)
    return Counter({k: int(kinds.count[s]) for k, s in kinds.slot.items() if kinds.count[s]})


def pack_counts(counts: dict[int, int], capacity: int) -> Counter:
    """Kinds of bins for counts of lengths, none of them above ``capacity``."""
    if any(not 0 < x <= capacity for x in counts):
        raise ValueError("lengths must be from 1 to the capacity")
    return local_search(best_fit(counts, capacity), capacity)


class Slots:
    """Where the r-th piece of a length goes: its sequence and offset.

    A kind has one entry for each of its different lengths, of which, as they
    add up to the capacity at most, there are fewer than the root of twice that.
    """

    def __init__(self, bins: Counter):
        base, spans = 0, defaultdict(list)  # length -> [(first rank, first sequence, bins, offset)]
        given: Counter = Counter()
        for kind in sorted(bins, key=lambda k: (-sum(k), k)):
            n, offset = bins[kind], 0
            for length, times in Counter(kind).items():
                spans[length].append((given[length], base, n, offset))
                given[length] += n * times
                offset += length * times
            base += n
        self.total = base
        self.by_length = {k: tuple(np.array(x, dtype=np.int64) for x in zip(*v)) for k, v in spans.items()}

    def shares(self, entries: int) -> list[Slots]:
        """The same, a bounded number of entries at a time (but a length is never split)."""
        out, size = [], entries + 1
        for length, span in sorted(self.by_length.items()):
            size += len(span[0])
            if size > entries:
                size = len(span[0])
                out.append(object.__new__(Slots))
                out[-1].total, out[-1].by_length = self.total, {}
            out[-1].by_length[length] = span
        return out or [self]

    def place(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
        for length in np.unique(lengths):
            at = np.nonzero(lengths == length)[0]
            first, base, bins, off = self.by_length[int(length)]
            k = np.searchsorted(first, ranks[at], side="right") - 1
            nth = ranks[at] - first[k]
            sequence[at] = base[k] + nth % bins[k]
            offset[at] = off[k] + nth // bins[k] * length
        return sequence, offset


# --- the corpus ------------------------------------------------------------


def _cut(path: str, capacity: int, end: bytes):
    """Pieces of each text, each with its rank among its task's pieces of that length."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen, tokens = TaskContext.get().partitionId(), [0] * (capacity + 1), encoder(path)
        for batch in batches:
            doc, piece, begin, size, crc, nth = [], array("i"), array("q"), array("i"), array("q"), array("q")
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = tokens.encode([text])[0] + end
                n, start, k = len(ids) // 4, 0, 0
                length = n % capacity or min(n, capacity)
                while start < n:
                    doc.append(doc_id)
                    piece.append(k)
                    begin.append(start)
                    size.append(length)
                    crc.append(zlib.crc32(ids[4 * start : 4 * (start + length)]))
                    nth.append(seen[length])
                    seen[length] += 1
                    start, k, length = start + length, k + 1, capacity
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), *(pa.array(np.array(x)) for x in (piece, begin, size, crc)), pa.array(np.full(len(doc), part, np.int32)), pa.array(np.array(nth))],
                ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"],
            )

    return run


def _place(slots):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = slots.value
        for batch in batches:
            sequence, offset = where.place(batch.column(3).to_numpy(), batch.column(5).to_numpy())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequence), pa.array(offset)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int | None = 2, max_entries: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    Documents of more than ``capacity`` ids are cut into pieces of that length,
    the first piece taking the remainder, so that all others fill a sequence.
    ``max_entries`` bounds what is broadcast of the places (32 bytes each); more
    are taken by stretches of lengths, each of which reads its pieces.

    A null text is an empty one (a piece with the end id alone; without an end
    id an empty text has no piece); a null id stays null; each of repeated rows
    is packed; no rows give no pieces.
    """
    spark = docs.sparkSession
    prepare(spark)
    end = b"" if end_id is None else int(end_id).to_bytes(4, "little")
    rows = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    pieces = staged(rows.mapInArrow(_cut(tokenizer_path(tokenizer), capacity, end), _PIECES), "pieces")
    by_task = staged(pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "lengths")
    # at most one row for each length up to the capacity
    counts = {x["length"]: x["n"] for x in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    first = by_task.select("length", "part", F.coalesce(before, F.lit(0)).alias("first"))
    shares = Slots(pack_counts(counts, capacity)).shares(max_entries)
    ranked = pieces.join(first, ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("nth")).alias("nth"))
    out = None
    for share in shares:
        own = ranked.where(F.col("length").between(min(share.by_length), max(share.by_length))) if len(shares) > 1 else ranked
        placed = own.mapInArrow(_place(spark.sparkContext.broadcast(share)), "doc_id long, piece int, start long, length int, ids_crc32 long, sequence_id long, offset long")
        out = placed if out is None else out.union(placed)
    return out.withColumn("length", F.col("length").cast("long"))


def query(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), "byte_bpe_50k.json")
