"""Bigram language model in a log-frequency Bloom filter.

Training tokens are counted exactly: each task sends, for each group of blocks of
the hash space, its sorted distinct n-gram hashes with counts, packed into one row,
and blocks are merged where the shuffle brings them together.  A count is quantised
to a level ``q`` on a logarithmic scale, and a block's filter holds the entries
(n-gram, 1) to (n-gram, q), so that a reader finds a count by asking for one
level after the other until one is missing.

Probabilities are smoothed with a Dirichlet prior, p(w|v) = (c(vw) + K p(w)) /
(c(v) + K), with p(w) = (c(w) + 1) / (N + V + 1).

The filter is broadcast if its size is within a stated bound; beyond it its
blocks stay where they are and what texts ask of them is brought there by a
shuffle, so that the same bits answer at every size.  There texts are read once:
what a group of blocks is asked is answered for many chunks of texts at once, with
exact counts of words beside the filter's.  Words are known by
64-bit hashes: of V distinct ones, V squared / 2**65 pairs are expected to clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_bucket, lean, pick, prepare, shuffle_partitions, staged
from .words import coded, joined, mix

#: Stand for the begin and the end of a text among word hashes.
BEGIN, END = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)
BASE = 1.5
BITS, PROBES, LEVELS = 8, 4, 60
_FLUSH = 2_000_000
_CHUNK = 1 << 20
#: Bytes of texts that are taken apart together.
_TEXTS, _SCORED_TEXTS = 8 << 20, 2 << 20
_STEPS = np.floor(np.log(np.arange(1, 1 << 12)) / np.log(BASE) + 1e-9).astype(np.int64) + 1


def level(counts: np.ndarray) -> np.ndarray:
    """1 for a count of 1, then one more for each power of :data:`BASE`."""
    c = counts.astype(np.float64)
    return np.minimum(np.floor(np.log(np.maximum(c, 1)) / np.log(BASE) + 1e-9).astype(np.int64) + 1, LEVELS)


def _typical() -> np.ndarray:
    """The count that stands for each level (0: none): the middle of its whole numbers."""
    out = np.zeros(LEVELS + 1)
    for q in range(1, LEVELS + 1):
        own = np.nonzero(_STEPS == q)[0]
        out[q] = own.mean() + 1 if len(own) and BASE**q < len(_STEPS) else BASE ** (q - 0.5)
    return out


TYPICAL = _typical()


def block_bits(n_bytes: int) -> int:
    """How many leading bits of a hash name its block, by the training texts' size alone.

    Blocks of a kind grow in number with the square root of the corpus, so do
    their sizes: 1,024 at 1 GB, 8,192 at 30 GB, half a million at 100 TB.
    """
    return max(4, math.ceil(math.log2(max(1.0, n_bytes / 1024)) / 2))


def group_bits(bits: int) -> int:
    """How many leading bits name a group of blocks, the unit that is sent and asked: four blocks, one if there are few."""
    return max(4, bits - 2)


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts that lie one after the other: hashes of the distinct tokens, the tokens (words, then an end) as places among these, and how many each text has."""
    h, inner, lengths = coded(texts)
    ends = np.cumsum(lengths + 1) - 1
    word = np.ones(len(inner) + len(ends), bool)
    word[ends] = False
    places = np.full(len(word), len(h), np.int64)
    places[word] = inner
    return np.append(h, END), places, lengths + 1


def bigrams(every: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A hash for each token and the one before it in its text."""
    before = np.concatenate([[BEGIN], every[:-1]]).astype(np.uint64)
    before[np.cumsum(lengths) - lengths] = BEGIN
    return joined(before, every)


def _gathered(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Batches put together up to some bytes."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
        if size >= limit:
            yield pa.concat_batches(held)
            held.clear()
            size = 0
    if held:
        yield pa.concat_batches(held)


def _groups(h: np.ndarray, bits: int) -> Iterator[tuple[int, int, int]]:
    """Sorted hashes by their leading bits: group, start and end of each that there is."""
    groups, starts = np.unique(h >> np.uint64(64 - bits), return_index=True)
    return zip(groups.tolist(), starts.tolist(), [*starts[1:].tolist(), len(h)])


# --- counting --------------------------------------------------------------


def _planes(x: np.ndarray) -> bytes:
    return x.view(np.uint8).reshape(len(x), -1).T.tobytes()


def _packed(h: np.ndarray, c: np.ndarray, pack) -> bytes:
    """Sorted hashes as differences and counts, byte by byte of all."""
    return pack(_planes(np.diff(h, prepend=np.uint64(0))) + _planes(c.astype(np.uint32)))


def _unpacked(blob: bytes, n: int, unpack) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(unpack(blob), np.uint8)
    d = np.ascontiguousarray(raw[: 8 * n].reshape(8, n).T).view(np.uint64).ravel()
    return np.cumsum(d, dtype=np.uint64), np.ascontiguousarray(raw[8 * n :].reshape(4, n).T).view(np.uint32).ravel()


def _added(h: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes and the sums of their counts."""
    order = np.argsort(h, kind="stable")
    h, c = h[order], c[order].astype(np.int64)
    first = np.nonzero(np.concatenate([[True], h[1:] != h[:-1]]))[0]
    return h[first], np.add.reduceat(c, first)


def _count(coarse: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=1).compress
        counted: list[tuple[np.ndarray, np.ndarray]] = []
        pairs: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            rows: list[tuple[int, int, int, bytes]] = []
            one = _added(*(np.concatenate(x) for x in zip(*counted)))
            two = np.unique(np.concatenate(pairs), return_counts=True)
            counted.clear()
            pairs.clear()
            for kind, (h, c) in enumerate((one, two), 1):
                for group, start, end in _groups(h, coarse):
                    rows.append((kind, group, end - start, _packed(h[start:end], c[start:end], pack)))
            kinds, groups, n, blobs = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(groups, pa.int32()), pa.array(n, pa.int64()), pa.array(blobs, pa.binary())], ["kind", "part", "n", "blob"])

        for batch in _gathered(batches, _TEXTS):
            u, places, lengths = tokens(batch.column(0))
            counted.append((u, np.bincount(places, minlength=len(u))))
            pairs.append(bigrams(u[places], lengths))
            size += len(places)
            if size >= _FLUSH:
                yield flush()
                size = 0
        if size:
            yield flush()

    return run


def _entries(h: np.ndarray, c: np.ndarray) -> np.ndarray:
    """What a filter holds for counted n-grams: one hash for each level."""
    q, out = level(c), []
    for k in range(1, int(q.max(initial=0)) + 1):
        out.append(_at(h[q >= k], k))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _at(h: np.ndarray, k: int) -> np.ndarray:
    return mix(h + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1))


def _probe(e: np.ndarray, k: int, size: np.ndarray | np.uint64) -> np.ndarray:
    """The k-th place of an entry in a filter of ``size`` bits."""
    return ((e & np.uint64(0xFFFFFFFF)) + np.uint64(k) * ((e >> np.uint64(32)) | np.uint64(1))) % size


def build_filter(h: np.ndarray, c: np.ndarray, per_entry: int = BITS) -> bytes:
    """The bit array of one block."""
    e = _entries(h, c)
    size = max(64, -(-len(e) * per_entry // 64) * 64)
    bits = np.zeros(size, bool)
    for k in range(PROBES):
        bits[_probe(e, k, np.uint64(size))] = True
    return np.packbits(bits, bitorder="little").tobytes()


def _merge(keep: tuple[int, ...], per_entry: int, bits: int):
    """Blocks with the counts of a group's rows, added up; rows come sorted by kind and group."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack, pack = zstandard.ZstdDecompressor().decompress, zstandard.ZstdCompressor(level=1).compress
        held: list[tuple[np.ndarray, np.ndarray]] = []
        at: tuple[int, int] | None = None

        def done() -> Iterator[pa.RecordBatch]:
            every, counts = _added(*(np.concatenate(x) for x in zip(*held)))
            kind = at[0]
            held.clear()
            for block, start, end in _groups(every, bits):
                h, c = every[start:end], counts[start:end]
                blob = _packed(h, np.minimum(c, (1 << 32) - 1), pack) if kind in keep else None
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x], t) for x, t in ((kind, pa.int32()), (block, pa.int32()), (len(h), pa.int64()), (int(c.sum()), pa.int64()), (blob, pa.binary()), (build_filter(h, c, per_entry), pa.binary()))],
                    ["kind", "block", "n", "tokens", "blob", "filter"],
                )

        for batch in batches:
            for kind, part, n, blob in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if at is not None and at != (kind, part):
                    yield from done()
                at = (kind, part)
                held.append(_unpacked(blob, n, unpack))
        if held:
            yield from done()

    return run


@lean
def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        for n, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            h, c = _unpacked(blob, n, unpack)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.astype(np.int64))], ["h", "c"])


# --- scoring ---------------------------------------------------------------


class Filter:
    """All blocks of one kind, side by side."""

    def __init__(self, bits: int, blocks: list[tuple[int, bytes]]):
        self.shift = np.uint64(64 - bits)
        sizes = np.zeros(1 << bits, np.uint64)
        for block, data in blocks:
            sizes[block] = 8 * len(data)
        self.sizes = np.maximum(sizes, np.uint64(1))
        self.starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.uint64)
        self.empty = sizes == 0
        self.data = np.frombuffer(b"".join(data for _, data in sorted(blocks)), np.uint8)

    def levels(self, h: np.ndarray) -> np.ndarray:
        """The level found for each hash: one round of probes for each level."""
        out = np.zeros(len(h), np.int64)
        block = (h >> self.shift).astype(np.int64)
        live, q = np.nonzero(~self.empty[block])[0], 0
        while len(live) and q < LEVELS:
            q += 1
            e = _at(h[live], q)
            for k in range(PROBES):
                b = block[live]
                at = self.starts[b] + _probe(e, k, self.sizes[b])
                found = (self.data[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
                live, e = live[found], e[found]
            out[live] = q
        return out


class Model:
    """What workers hold: the filters, and exact counts of the most common words."""

    def __init__(self, tokens: int, types: int, hot: tuple[np.ndarray, np.ndarray], filters: tuple[Filter, Filter] | None, prior: float):
        self.tokens, self.types, self.hot, self.filters, self.prior = tokens, types, hot, filters, prior
        self.size = float(tokens + types + 1)

    def log10(self, c: np.ndarray, before: np.ndarray, both: np.ndarray) -> np.ndarray:
        """Smoothed log probabilities from quantised counts of words, histories and pairs."""
        p = (both + self.prior * (c + 1) / self.size) / (before + self.prior)
        return np.log10(np.minimum(p, 1.0))

    def scores(self, c: np.ndarray, both: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Score of each of the texts that lie one after the other."""
        ends = np.cumsum(lengths)
        starts = ends - lengths
        before = np.concatenate([[0.0], c[:-1]])
        # a text begins as often as one ends
        before[starts] = c[ends - 1]
        return np.add.reduceat(self.log10(c, before, both), starts)


def _score(model_of):
    """Per text: row number, tokens, those known among the common words and the sum of their log counts, the rest, and the model's score."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        model, row = model_of.value, TaskContext.get().partitionId() << 40
        hot_h, hot_c = model.hot
        words_f, pairs_f = model.filters
        for batch in _gathered(batches, _SCORED_TEXTS):
            u, places, lengths = tokens(batch.column(1))
            starts = np.cumsum(lengths) - lengths
            at = np.minimum(np.searchsorted(hot_h, u), max(len(hot_h) - 1, 0))
            exact = np.where(hot_h[at] == u, hot_c[at], 0) if len(hot_h) else np.zeros(len(u), np.int64)
            known, logs = (exact > 0)[places], np.log10(exact + 1.0)[places]
            # a text's other words, each once, with how often it has them
            text = np.repeat(np.arange(len(lengths)), lengths)
            rare, times = np.unique(text[~known] * len(u) + places[~known], return_counts=True)
            offsets = pa.array(np.searchsorted(rare, np.arange(len(lengths) + 1) * len(u)).astype(np.int32))
            rare = u[rare % len(u)].view(np.int64)
            pairs, back = np.unique(bigrams(u[places], lengths), return_inverse=True)
            score = model.scores(TYPICAL[words_f.levels(u)][places], TYPICAL[pairs_f.levels(pairs)][back], lengths)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(np.arange(row, row + len(lengths))),
                    pa.array(lengths),
                    pa.array(np.add.reduceat(known.astype(np.int64), starts)),
                    pa.array(np.add.reduceat(logs, starts)),
                    pa.array(score),
                    pa.ListArray.from_arrays(offsets, pa.array(rare)),
                    pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int64))),
                ],
                ["doc_id", "row", "n_tokens", "known", "logs", "score", "rare", "times"],
            )
            row += len(lengths)

    return run


_SCORED = "doc_id long, row long, n_tokens long, known long, logs double, score double, rare array<long>, times array<long>"


_ASKED = "kind int, part int, chunk long, n long, blob binary, counts binary, ids array<long>"


def _asked_rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 7
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["kind", "part", "chunk", "n", "blob", "counts", "ids"])


def _plain(raw: np.ndarray, dtype: type) -> np.ndarray:
    """Undo :func:`_planes`."""
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(width, -1).T).view(dtype).ravel()


def _asked(coarse: int):
    """Chunks of texts: the n-grams each asks of each group of blocks (kinds 1 and 2), and its tokens with the ids of its texts (kind 0).

    A chunk is known by its place and its content, so that what a repeated task makes of rows in another order is never mixed with what it made at first.
    """

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        import zstandard
        from pyspark import TaskContext

        pack = zstandard.ZstdCompressor(level=1).compress
        task = TaskContext.get().partitionId()
        for number, batch in enumerate(_gathered(batches, _TEXTS)):
            u, places, lengths = tokens(batch.column(1))
            h, back = np.unique(u, return_inverse=True)
            places, ids = back[places], batch.column(0).to_pylist()
            pairs = np.unique(bigrams(h[places], lengths))
            own = b"".join(_planes(x) for x in (lengths.astype(np.uint32), places.astype(np.uint32), np.diff(h, prepend=np.uint64(0))))
            chunk = xxhash.xxh64_intdigest(own + repr((task, number, ids)).encode()) >> 1
            rows = [(0, chunk & 0x7FFFFFFF, chunk, len(ids), pack(own), None, ids)]
            for kind, x in ((1, h), (2, pairs)):
                for part, start, end in _groups(x, coarse):
                    rows.append((kind, part, chunk, end - start, pack(_planes(np.diff(x[start:end], prepend=np.uint64(0)))), None, None))
            yield _asked_rows(rows)

    return run


def _answered(bits: int):
    """Levels of what is asked of a group of blocks, for words exact counts too; rows come sorted by kind and group, each group's blocks (chunk below 0) first."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack, pack = zstandard.ZstdDecompressor().decompress, zstandard.ZstdCompressor(level=1).compress
        at: tuple[int, int] | None = None
        own: Filter | None = None
        blocks: list[tuple[int, bytes]] = []
        counted: list[tuple[np.ndarray, np.ndarray]] = []
        asks: list[tuple[int, np.ndarray]] = []
        size = 0

        def answers() -> pa.RecordBatch:
            """Of many chunks at once."""
            every = np.concatenate([h for _, h in asks])
            levels, counts, rows, start = own.levels(every).astype(np.uint8), None, [], 0
            if at[0] == 1:
                counts = np.zeros(len(every), np.uint32)
                if counted:
                    h, c = (np.concatenate(x) for x in zip(*counted))
                    found = np.minimum(np.searchsorted(h, every), len(h) - 1)
                    counts = np.where(h[found] == every, c[found], np.uint32(0))
            for chunk, h in asks:
                end = start + len(h)
                rows.append((*at, chunk, len(h), pack(levels[start:end].tobytes()), None if counts is None else pack(_planes(counts[start:end])), None))
                start = end
            asks.clear()
            return _asked_rows(rows)

        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(7))):
                kind, part, chunk, n, blob, counts, _ = row
                if (kind, part) != at:
                    if asks:
                        yield answers()
                        size = 0
                    at, own = (kind, part), None
                    blocks.clear()
                    counted.clear()
                if kind == 0:
                    yield _asked_rows([row])
                elif chunk < 0:
                    blocks.append((chunk, blob))
                    if counts is not None:
                        counted.append(_unpacked(counts, n, unpack))
                else:
                    own = own or Filter(bits, [(block & (1 << bits) - 1, data) for block, data in blocks])
                    asks.append((chunk, np.cumsum(_plain(np.frombuffer(unpack(blob), np.uint8), np.uint64), dtype=np.uint64)))
                    size += n
                    if size >= _CHUNK:
                        yield answers()
                        size = 0
        if asks:
            yield answers()

    return run


def _put_together(model: Model):
    """What is known of a chunk's texts; rows come sorted by chunk, kind and group, so that the answers are in the order of the hashes."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        at: int | None = None
        texts: tuple[list, bytes] | None = None
        levels: dict[int, list[bytes]] = {1: [], 2: []}
        counts: list[np.ndarray] = []

        def done() -> pa.RecordBatch:
            ids, own = texts
            raw = np.frombuffer(unpack(own), np.uint8)
            lengths = _plain(raw[: 4 * len(ids)], np.uint32).astype(np.int64)
            split = 4 * (len(ids) + int(lengths.sum()))
            places = _plain(raw[4 * len(ids) : split], np.uint32)
            h = np.cumsum(_plain(raw[split:], np.uint64), dtype=np.uint64)
            pairs, back = np.unique(bigrams(h[places], lengths), return_inverse=True)
            one, two = (np.frombuffer(b"".join(levels[kind]), np.uint8) for kind in (1, 2))
            exact = np.concatenate(counts)
            if not len(one) == len(exact) == len(h) or len(two) != len(pairs):
                raise ValueError("answers of a chunk of texts are missing or come twice")
            starts = np.cumsum(lengths) - lengths
            known, logs = (exact > 0).astype(np.int64)[places], np.log10(exact + 1.0)[places]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array(lengths),
                    pa.array(np.add.reduceat(known, starts)),
                    pa.array(np.add.reduceat(logs, starts)),
                    pa.array(model.scores(TYPICAL[one][places], TYPICAL[two][back], lengths)),
                ],
                ["doc_id", "n_tokens", "known", "logs", "score"],
            )

        for batch in batches:
            for kind, chunk, n, blob, found, ids in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4, 5, 6))):
                if chunk != at:
                    if at is not None:
                        yield done()
                    at, texts, levels, counts = chunk, None, {1: [], 2: []}, []
                if kind == 0:
                    texts = ids, blob
                else:
                    levels[kind].append(unpack(blob))
                    if kind == 1:
                        counts.append(_plain(np.frombuffer(unpack(found), np.uint8), np.uint32))
        if at is not None:
            yield done()

    return run


def _asked_scores(rows: DataFrame, merged: DataFrame, model: Model, bits: int, partitions: int) -> DataFrame:
    """The same with the filter's blocks left distributed, for a filter beyond the bound."""
    coarse = group_bits(bits)
    # below 0 and in the order of the blocks
    block = F.col("block").cast("long") - F.lit(1 << bits)
    blocks = merged.select("kind", F.shiftright("block", bits - coarse).alias("part"), block.alias("chunk"), "n", F.col("filter").alias("blob"), F.col("blob").alias("counts"), F.lit(None).cast("array<long>").alias("ids"))
    asks = blocks.union(rows.mapInArrow(_asked(coarse), _ASKED)).repartition(2 * partitions, "kind", "part").sortWithinPartitions("kind", "part", "chunk")
    dealt = asks.mapInArrow(_answered(bits), _ASKED).repartition(2 * partitions, "chunk").sortWithinPartitions("chunk", "kind", "part")
    return dealt.mapInArrow(_put_together(model), "doc_id long, n_tokens long, known long, logs double, score double")


def _broadcast_scores(rows: DataFrame, merged: DataFrame, tokens: int, types: int, prior: float, bits: int, common_words: int) -> DataFrame:
    """What is known of texts by a filter that every worker holds; exact counts of words beyond the most common ones are joined."""
    unigrams = staged(merged.where("kind = 1").select("n", "blob").mapInArrow(_rows, "h long, c long"), "unigrams")

    # the least count whose words, with all more frequent ones, are within the bound
    step = F.floor(F.log2("c") * 8).cast("int")
    steps = sorted(((r["step"], r["n"]) for r in unigrams.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect()), reverse=True)
    taken, least = 0, None
    for at, n in steps:
        if taken + n > common_words:
            break
        taken, least = taken + n, at
    hot = unigrams.where(step >= least).toArrow() if least is not None else None
    hot_h = hot.column(0).to_numpy().view(np.uint64) if hot is not None else np.zeros(0, np.uint64)
    hot_c = hot.column(1).to_numpy() if hot is not None else np.zeros(0, np.int64)
    order = np.argsort(hot_h, kind="stable")

    found = merged.select("kind", "block", "filter").toArrow()
    parts: dict[int, list[tuple[int, bytes]]] = {1: [], 2: []}
    for kind, block, data in zip(*(found.column(k).to_pylist() for k in range(3))):
        parts[kind].append((block, data))
    del found
    filters = tuple(Filter(bits, parts.pop(k)) for k in (1, 2))
    model = Model(tokens, types, (hot_h[order], hot_c[order]), filters, prior)
    scored = staged(rows.mapInArrow(_score(rows.sparkSession.sparkContext.broadcast(model)), _SCORED), "scored")

    rare = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("h"), F.col("x.times").alias("n"))
    rest = rare.join(unigrams, "h").groupBy("row").agg(F.sum("n").alias("more"), F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("more_logs"))
    known = F.col("known") + F.coalesce("more", F.lit(0))
    logs = F.col("logs") + F.coalesce("more_logs", F.lit(0.0))
    return scored.drop("rare", "times").join(rest, "row", "left").select("doc_id", "n_tokens", known.alias("known"), logs.alias("logs"), "score")


def lm_scores(
    docs: DataFrame, training: DataFrame, prior: float = 100.0, max_filter_mb: int = 256, common_words: int = 1 << 20, bits_per_entry: int = BITS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Score all ``docs`` with a model of the texts in ``training``.

    Gives ``doc_id, n_tokens, n_known, train_tokens, base_score, score``: tokens
    are words and an end; ``base_score`` is the log10 probability under add-one
    unigrams, from exact counts, and ``score`` that under the bigram model.
    ``max_filter_mb`` bounds a filter that is broadcast (a larger one gives the
    same scores from where it lies), ``bits_per_entry`` sets how often it has
    what was never put in (8: one probe in 42), and ``common_words`` bounds the
    exact counts broadcast with it; those of other words are joined.  The filter's
    layout goes by the size of the training texts alone, so the same rows have
    the same scores however they are partitioned.

    A null text is an empty one, of one token; a null id stays null; each of
    repeated rows gets its scores; without training texts every probability is 1.
    """
    spark = docs.sparkSession
    prepare(spark)
    partitions = shuffle_partitions(spark)
    rows = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), "text")
    learnt = pick(training, text=text_col)
    bits = block_bits(learnt.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    sent = learnt.mapInArrow(_count(group_bits(bits)), "kind int, part int, n long, blob binary")
    dealt = sent.repartition(2 * partitions, "kind", "part").sortWithinPartitions("kind", "part")
    schema = "kind int, block int, n long, tokens long, blob binary, filter binary"
    merged = staged(dealt.mapInArrow(_merge((1,), bits_per_entry, bits), schema), "ngrams")
    sums = merged.where("kind = 1").agg(F.sum("tokens"), F.sum("n")).first()
    tokens, types = sums[0] or 0, sums[1] or 0
    size = merged.agg(F.sum(F.octet_length("filter"))).first()[0] or 0
    if size <= max_filter_mb << 20:
        out = _broadcast_scores(rows, merged, tokens, types, prior, bits, common_words)
    else:
        none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        out = _asked_scores(rows, merged, Model(tokens, types, none, None, prior), bits, partitions)
    logs = F.col("logs") - F.col("n_tokens") * F.log10(F.lit(float(tokens + types + 1)))
    return out.select("doc_id", "n_tokens", F.col("known").alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"), logs.alias("base_score"), "score")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    training = docs.where(crc_bucket(F.col("doc_id"), 7) != 2)
    return lm_scores(docs, training).withColumn("held_out", crc_bucket(F.col("doc_id"), 7) == 2)
