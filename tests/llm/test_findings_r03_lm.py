"""What a review of round 3 found: the language model where its filter is beyond the bound of a broadcast."""

import math
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sessionloom.llm import lm_scoring
from sessionloom.llm.words import coded, hashed, words

SCHEMA = "doc_id long, text string"


def texts(n, seed):
    rnd = random.Random(seed)
    return [" ".join(f"w{int(rnd.paretovariate(0.6)) % 900}" for _ in range(rnd.randint(0, 60))) for _ in range(n)]


def test_words_of_many_texts_are_those_of_each():
    given = ["", None, " a", "a  B\t", "\x0b\x1c x\x85y  z  É", "  ", "A a \x00 b\x1f", "one", *texts(50, 1)]
    want = [hashed(words(x)) for x in given]
    for kind in (pa.string(), pa.large_string()):
        for skipped in (0, 3):
            h, places, lengths = coded(pa.array(given, kind)[skipped:])
            assert len(set(h.tolist())) == len(h) and lengths.tolist() == [len(x) for x in want[skipped:]]
            assert (h[places] == np.concatenate(want[skipped:])).all()


def test_texts_are_read_once_where_the_filter_stays_distributed(spark):
    """Before, three times: for their rare words, for what they ask and for where it stands."""
    rows = list(enumerate(texts(120, 2))) + [(500, None), (501, ""), (7, "w1 w2"), (None, "w1")]
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(text):
        read.add(1)
        return text

    docs, training = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(rows[:90], SCHEMA)
    got = sorted(map(str, lm_scoring.lm_scores(docs.withColumn("text", seen("text")), training, max_filter_mb=0).collect()))
    assert read.value == len(rows) == len(got)
    # one answer for each row, whatever its id, and the base by hand
    count = {}
    for _, t in rows[:90]:
        for w in [*(t or "").split(), None]:
            count[w] = count.get(w, 0) + 1
    n, v = sum(count.values()), len(count)
    want = sorted(round(sum(math.log10((count.get(w, 0) + 1) / (n + v + 1)) for w in [*(t or "").split(), None]), 6) for _, t in rows)
    found = sorted(round(r.base_score, 6) for r in lm_scoring.lm_scores(docs, training, max_filter_mb=0).collect())
    assert found == want


def test_a_group_of_blocks_answers_many_chunks_at_once(monkeypatch):
    """Rows grow with blocks times chunks: no round of probes for each of them."""
    import zstandard

    bits, coarse = 8, lm_scoring.group_bits(8)
    rng = np.random.default_rng(3)
    h = np.unique(rng.integers(0, 1 << 58, 4000, dtype=np.uint64))  # all of group 0
    c = rng.integers(1, 50, len(h))
    pack = zstandard.ZstdCompressor(level=1).compress
    rows = [(1, 0, block - (1 << bits), end - start, lm_scoring.build_filter(h[start:end], c[start:end]), lm_scoring._packed(h[start:end], c[start:end], pack), None) for block, start, end in lm_scoring._groups(h, bits)]
    assert len(rows) == 1 << bits - coarse
    asked = [np.sort(rng.choice(h, 9, replace=False)) for _ in range(300)]
    rows += [(1, 0, chunk, 9, pack(lm_scoring._planes(np.diff(x, prepend=np.uint64(0)))), None, None) for chunk, x in enumerate(asked)]
    probed, own = [], lm_scoring.Filter.levels
    monkeypatch.setattr(lm_scoring.Filter, "levels", lambda self, x: probed.append(len(x)) or own(self, x))
    out = [row for batch in lm_scoring._answered(bits)(iter([lm_scoring._asked_rows(rows[k : k + 50]) for k in range(0, len(rows), 50)])) for row in batch.to_pylist()]
    assert probed == [9 * 300] and [r["chunk"] for r in out] == list(range(300))
    unpack = zstandard.ZstdDecompressor().decompress
    for r, x in zip(out, asked):
        want = c[np.searchsorted(h, x)]
        assert (lm_scoring._plain(np.frombuffer(unpack(r["counts"]), np.uint8), np.uint32) == want).all()
        assert (np.frombuffer(unpack(r["blob"]), np.uint8) >= lm_scoring.level(want)).all()
