"""Benchmark passages in training texts: rare n-gram seeds, then local alignment.

The items of a benchmark are a stated query set, taken in blocks of bounded size.
Word n-grams that few items of a block have are its seeds: wherever a text has one,
the passage around it is joined to these items and aligned with them by the
Smith-Waterman recurrence over words, which scores edited copies too.  Rarity
goes by items, so that copies of a leak can't make its n-grams common.  An n-gram
of very many items (a phrase that questions open with) would join them all at
each place, so it brings in only those of whose words the text nearby has enough.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_index, lean, pick, prepare, row_columns, with_row
from .words import grams, hashed

SEED = 3
#: An n-gram that at most so many items of a block have is rare.
RARE = 8
MATCH, MISMATCH, GAP = 1.0, 0.5, 0.5
_PUNCT = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_PLAIN = bytes(32 if b in _PUNCT else b for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words in lower case, without ASCII punctuation."""
    return (text or "").lower().encode("utf-8", "replace").translate(_PLAIN).split()


def align(item: np.ndarray, passage: np.ndarray) -> tuple[float, int, int]:
    """Best local alignment of two sequences of word hashes: score, and where it starts and ends in the passage.

    Row by row over the item; the gaps along a row are resolved at once, since
    with linear costs the best of them is a running maximum.
    """
    n = len(passage)
    ramp = GAP * np.arange(n + 1)
    prev, began = np.zeros(n + 1), np.arange(n + 1)
    best, at = 0.0, (0, 0)
    for w in item:
        step = np.where(passage == w, MATCH, -MISMATCH)
        diagonal, down = prev[:-1] + step, prev[1:] - GAP
        row = np.zeros(n + 1)
        start = np.arange(n + 1)
        row[1:] = np.maximum(diagonal, np.maximum(down, 0.0))
        start[1:] = np.where(row[1:] <= 0, start[1:], np.where(diagonal >= down, began[:-1], began[1:]))
        lifted = row + ramp
        top = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == top, np.arange(n + 1), 0))
        row, start = np.maximum(top - ramp, 0.0), start[source]
        k = int(row.argmax())
        if row[k] > best:
            best, at = float(row[k]), (int(start[k]), k)
        prev, began = row, start
    return best, *at


class Items:
    """A block of benchmark items: hashed words, and their n-grams with the items and places that have them.

    An n-gram is rare if at most ``rare`` items of the block have it.
    """

    def __init__(self, rows: list[tuple[int, str | None]], seed: int, rare: int = RARE):
        self.seed, self.ids, self.words = seed, [], []
        #: Items too short for a seed, by their words.
        self.short: dict[bytes, list[int]] = defaultdict(list)
        places, held = [], []
        for item_id, text in rows:
            h = hashed(words_of(text))
            if 0 < len(h) < seed:
                self.short[h.tobytes()].append(item_id)
            if len(h) >= seed:
                k = len(self.ids)
                self.ids.append(item_id)
                self.words.append(h)
                g = grams(h, seed)
                places.append((g, np.full(len(g), k), np.arange(len(g))))
                own, times = np.unique(h, return_counts=True)
                held.append((own, np.full(len(own), k), times))
        self.sizes = np.array([len(h) for h in self.words], np.int64)
        #: Items of like length share a stretch of text in :meth:`_possible`.
        self.classes = np.ceil(np.log2(np.maximum(self.sizes, 2))).astype(np.int64)
        self.grams, self.gram_from, self.gram_item, self.gram_at = self._index(places)
        self.known, self.word_from, self.word_item, self.word_times = self._index(held)
        of = np.repeat(np.arange(len(self.grams)), np.diff(self.gram_from))
        pairs = np.unique(np.stack([of, self.gram_item]), axis=1)[0] if len(of) else of
        self.rare = np.bincount(pairs, minlength=len(self.grams)) <= rare

    @staticmethod
    def _index(found: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(sorted different keys, where the rows of each begin, and the rows' two values)."""
        if not found:
            return np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        keys, item, value = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(keys, kind="stable")
        different, first = np.unique(keys[order], return_index=True)
        return different, np.append(first, len(keys)).astype(np.int64), item[order], value[order]

    @staticmethod
    def _among(sorted_keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``x`` whose value is among the keys, and which key that is."""
        if not len(x) or not len(sorted_keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(sorted_keys, x), len(sorted_keys) - 1)
        where = np.nonzero(sorted_keys[at] == x)[0]
        return where, at[where]

    @staticmethod
    def _rows(begin: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of an index that the keys ``which`` have, and for each the place in ``which``."""
        many = begin[which + 1] - begin[which]
        of = np.repeat(np.arange(len(which)), many)
        return begin[which][of] + np.arange(len(of)) - (np.cumsum(many) - many)[of], of

    def _possible(self, h: np.ndarray, where: np.ndarray, which: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """(item, start) of hits of common n-grams around which the text has enough words of the item.

        All items of a length class and a stretch of the text are weighed at
        once.  The stretch reaches twice an item's length beyond the hit on both
        sides, which no alignment that counts exceeds.
        """
        rows, of = self._rows(self.gram_from, which)
        item, p = self.gram_item[rows], where[of]
        start = p - self.gram_at[rows]
        kept = np.zeros(len(item), bool)
        for size in np.unique(self.classes[item]).tolist():
            reach = 2 << size
            mine = np.nonzero(self.classes[item] == size)[0]
            stretch = p[mine] // (2 * reach)
            for s in np.unique(stretch).tolist():
                own = mine[stretch == s]
                near = h[max(0, (2 * s - 1) * reach) : (2 * s + 3) * reach]
                _, words = self._among(self.known, np.unique(near))
                at, _ = self._rows(self.word_from, words)
                enough = np.bincount(self.word_item[at], weights=self.word_times[at], minlength=len(self.ids)) >= least * self.sizes
                kept[own] = enough[item[own]]
        return item[kept], start[kept]

    def find(self, h: np.ndarray, least: float) -> list[tuple[int, float, int, int, int]]:
        """(item, score, first word, words, seeds) of every item that aligns with a passage of the text.

        A rare n-gram brings its items to the passage around it; a common one
        only those of whose words the text nearby has enough for ``least``, since
        no alignment matches more of them.  What is aligned has enough itself.
        An item of fewer words than a seed has is only found as a whole text.
        """
        if len(h) < self.seed:
            return [(i, 1.0, 0, len(h), 0) for i in self.short.get(h.tobytes(), ())] if len(h) else []
        where, which = self._among(self.grams, grams(h, self.seed))
        if not len(where):
            return []
        rare = self.rare[which]
        rows, of = self._rows(self.gram_from, which[rare])
        item, start = self.gram_item[rows], where[rare][of] - self.gram_at[rows]
        seeds = np.bincount(item, minlength=len(self.ids))
        if not rare.all():
            more = self._possible(h, where[~rare], which[~rare], least)
            item, start = np.concatenate([item, more[0]]), np.concatenate([start, more[1]])
        if not len(item):
            return []
        order = np.lexsort((start, item))
        item, start = item[order], start[order]
        begins = np.concatenate([[0], np.nonzero((item[1:] != item[:-1]) | (start[1:] - start[:-1] > self.sizes[item[1:]]))[0] + 1])
        ends = np.append(begins[1:], len(item)) - 1
        best: dict[int, tuple[float, int, int]] = {}
        for k, first, last in zip(item[begins].tolist(), start[begins].tolist(), start[ends].tolist()):
            words = self.words[k]
            n = len(words)
            low, high = max(0, first - n // 2), min(len(h), last + n + n // 2 + 1)
            if np.isin(words, h[low:high]).sum() / n >= least:
                score, b, e = align(words, h[low:high])
                if score > best.get(k, (0.0,))[0]:
                    best[k] = (score, low + b, low + e)
        return [(self.ids[k], score / (MATCH * len(self.words[k])), b, e - b, int(seeds[k])) for k, (score, b, e) in sorted(best.items()) if score / (MATCH * len(self.words[k])) >= least]


_FOUND = "doc_id long, item_id long, score double, first_word long, n_words long, n_seeds long, passage string"


def _find(items, least: float):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = items.value
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text:
                    w = words_of(text)
                    for item, score, first, n, seeds in own.find(hashed(w), least):
                        rows.append((doc_id, item, round(score, 6), first, n, seeds, b" ".join(w[first : first + n]).decode("utf-8", "replace")))
            columns = list(zip(*rows)) or [()] * 7
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "item_id", "score", "first_word", "n_words", "n_seeds", "passage"])

    return run


def _blocks(benchmark: DataFrame, seed: int, rare: int, block_items: int, block_bytes: int, item_col: str, text_col: str):
    """The items, a bounded block at a time, broadcast."""
    spark = benchmark.sparkSession
    items = pick(benchmark, item_id=item_col, text=text_col).select(F.col("item_id").cast("long"), "text").where("item_id is not null and text is not null").distinct()
    n, size = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-n // block_items), -(-size // block_bytes))
    for k in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).orderBy("item_id", "text").collect()
        yield spark.sparkContext.broadcast(Items([(r["item_id"], r["text"]) for r in part], seed, rare))


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    least: float = 0.5,
    seed: int = SEED,
    rare: int = RARE,
    block_items: int = 20000,
    block_bytes: int = 32 << 20,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """A row for each document and item that align.

    ``doc_id, item_id, score, first_word, n_words, n_seeds, passage``: the score
    is that of the best local alignment over that of the item with itself (1: an
    exact copy), and at least ``least``; ``n_seeds`` counts the item's rare n-grams
    in the document (at most ``rare`` items of a block have one), and may be 0
    where only common ones survive.  A copy of which no ``seed`` words in a row survive is not found.
    An item of fewer than ``seed`` words is found where it is a whole document.
    ``block_items`` and ``block_bytes`` bound the items taken, and broadcast, at
    once (by more than that only if one item alone is longer).

    Null and empty texts align with nothing; a null document id stays null; repeated rows of a document each give
    their rows, repeated items count once; an empty table gives no rows.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), "text")
    out = None
    for items in _blocks(benchmark, seed, rare, block_items, block_bytes, item_col, item_text_col):
        found = rows.mapInArrow(_find(items, least), _FOUND)
        out = found if out is None else out.union(found)
    return out


def _clean(items, least: float):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = items.value
        for batch in batches:
            keep = [not (text and own.find(hashed(words_of(text)), least)) for text in batch.column(1).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return run


def drop_leaks(docs: DataFrame, benchmark: DataFrame, least: float = 0.5, seed: int = SEED, rare: int = RARE, block_items: int = 20000, block_bytes: int = 32 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of the rows of ``docs`` that hold no passage of the benchmark.

    What counts is said at :func:`find_leaks`.  Rows with null or empty texts stay;
    a null id and repeated rows go by their text alone; no rows, or no items, drop
    nothing.
    """
    prepare(docs.sparkSession)
    column_index(docs, id_col)
    carried = with_row(docs, text=text_col)
    for items in _blocks(benchmark, seed, rare, block_items, block_bytes, "item_id", "text"):
        carried = carried.mapInArrow(_clean(items, least), carried.schema)
    return row_columns(carried, docs)


def query(spark, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{x}.parquet") for x in ("documents", "benchmark"))
    return find_leaks(docs, benchmark)
