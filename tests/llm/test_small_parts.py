"""Parts of the operators against plain versions of the same rules."""

import io
import random
import re
import struct
import time
import zlib
from collections import Counter

import numpy as np
import pytest

from sessionloom.llm import decontaminate, lm_scoring, near_dedup, packing, pii, token_files, topk, toxicity
from sessionloom.llm.tokens import ChunkEncoder, tokenizer_path
from sessionloom.llm.words import shingles


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_chunk_encoder_gives_the_library_ids(name):
    from tokenizers import Tokenizer

    path = tokenizer_path(name)
    whole, mine, rnd = Tokenizer.from_file(path), ChunkEncoder(path, limit=50), random.Random(1)
    parts = [" ", "  ", "\n", "\t", "a", "Bc", "'s", "=", "12", ".", "é", "é", "\x1c", "\x85", "<|endoftext|>", "Σ", "日本", "😀", "İ", "Word,", "Été.\nAb", "ſ", "x" * 80, "odd###", "ESSAT!!", "né,%%%", "to*'s", "it's", "<b>", "&&&\nEn$"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14))) for _ in range(2000)]
    for text, ids in zip(texts, mine.encode(texts)):
        want = whole.encode(text, add_special_tokens=False).ids
        assert ids == struct.pack(f"<{len(want)}I", *want), repr(text)


def naive_spans(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and pii._luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def test_base_spans_equal_the_plain_patterns():
    rnd = random.Random(5)
    parts = ["a", "b.", "@", ".", "1", "25", "4111111111111111", " ", "-", "+1", "+", "(", ")", "é", "x@y.zz", "1.2.3.4", "\n"]
    for _ in range(5000):
        t = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 25)))
        assert pii.base_spans(t) == naive_spans(t), t


@pytest.mark.parametrize("text", ["a" * 200000 + "@", "1" * 200000, "@" * 100000, "a@" * 50000, "+1" * 50000, "+1" + "(" * 100000, "a=1" * 50000, "a at a dot " * 30000, "1 " * 100000, "(" * 100000 + "1"])
def test_pii_is_quick_on_long_runs(text):
    pii.slots(text, pii.base_spans(text))


@pytest.mark.parametrize("between", [" ", ",", "/", "\n", " and then "])
def test_slots_take_linear_time_in_identifiers(between):
    def seconds(n):
        text = between.join(f"u{i}@h{i}.com" for i in range(n))
        spans = pii.base_spans(text)
        began = time.process_time()
        assert len(pii.slots(text, spans)) >= n
        return time.process_time() - began

    assert min(seconds(16000) for _ in range(3)) < 12 * max(min(seconds(4000) for _ in range(3)), 0.02)


def test_slots_join_groups_and_words():
    text = "call 030 123 4567, or joe.x at host dot org (say (0171) 99 88 77)"
    found = [text[s:e] for s, e, k, _, _ in pii.slots(text, pii.base_spans(text)) if k < 0]
    assert sorted(found) == ["(0171) 99 88 77", "030 123 4567", "joe.x at host dot org"]


def test_align_is_smith_waterman():
    def plain(a, b):
        h, best = np.zeros((len(a) + 1, len(b) + 1)), 0.0
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                h[i, j] = max(0, h[i - 1, j - 1] + (1 if a[i - 1] == b[j - 1] else -0.5), h[i - 1, j] - 0.5, h[i, j - 1] - 0.5)
                best = max(best, h[i, j])
        return best

    rnd = random.Random(1)
    for _ in range(200):
        a, b = (np.array([rnd.randint(0, 6) for _ in range(rnd.randint(1, n))], np.uint64) for n in (14, 25))
        score, start, end = decontaminate.align(a, b)
        assert abs(score - plain(a, b)) < 1e-9
        if score:
            assert abs(plain(a, b[start:end]) - score) < 1e-9


@pytest.mark.parametrize("n", [0, 1, 7, 3000])
def test_packing_places_every_piece_once(n):
    rnd = random.Random(n)
    counts = Counter(min(1024, int(rnd.lognormvariate(5.3, 1)) + 1) for _ in range(n))
    bins = packing.pack_counts(dict(counts), 1024)
    placed = Counter()
    for kind, many in bins.items():
        assert sum(kind) <= 1024
        for length in kind:
            placed[length] += many
    assert placed == counts
    total = sum(k * v for k, v in counts.items())
    assert sum(bins.values()) <= -(-total // 1024) * 1.01 + 1
    slots, used = packing.Slots(bins), {}
    for length, many in counts.items():
        seq, off = slots.place(np.full(many, length), np.arange(many))
        for s, o in zip(seq, off):
            used.setdefault(int(s), []).append((int(o), length))
    for spans in used.values():
        at = 0
        for o, length in sorted(spans):
            assert o == at
            at += length
        assert at <= 1024
    assert len(used) == sum(bins.values())


def test_local_search_empties_bins():
    # two bins of 6 and 4 with room: one bin is enough
    assert sum(packing.local_search(Counter({(6,): 1, (4,): 1}), 10).values()) == 1
    # one-for-one: 7+2 and 8 -> 8+2 and 7
    bins = packing.local_search(Counter({(7, 2): 1, (8,): 1}), 10)
    assert bins == Counter({(8, 2): 1, (7,): 1})


def test_token_file_round_trip_and_checksum():
    rnd = random.Random(2)
    docs = [(None, b"\x01\0\0\0"), *((i // 2, struct.pack("<3I", i, i + 1, 1) * rnd.randint(0, 9000)) for i in range(60))]
    out = io.BytesIO()
    writer = token_files.Writer(out)
    for doc in docs:
        writer.add(*doc)
    size = writer.close()
    assert size == len(out.getvalue())
    reader = token_files.Reader(io.BytesIO(out.getvalue()), size)
    assert [x for k in range(len(reader.seek)) for x in reader.frame(k)] == docs
    assert len(reader.seek) > 1
    for i in (0, 7, 29):
        assert reader.find(i) == [ids for d, ids in docs if d == i]
    assert reader.find(1000) == []
    bad = bytearray(out.getvalue())
    bad[reader.starts[1] + reader.seek[1][0] // 2] ^= 1
    with pytest.raises(Exception):
        token_files.Reader(io.BytesIO(bytes(bad)), size).frame(1)
    # the frames are plain zstandard, whatever reads them
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(out.getvalue()[: reader.seek[0][0]])
    assert len(raw) == reader.seek[0][1] and zlib.crc32(raw) == zlib.crc32(raw)


def test_filter_finds_every_count_and_few_others():
    rng = np.random.default_rng(1)
    h = np.unique(rng.integers(0, 1 << 63, 20000, dtype=np.uint64) * np.uint64(2))
    c = rng.geometric(0.3, len(h))
    blocks = []
    bits = 4
    for b in range(1 << bits):
        own = h >> np.uint64(64 - bits) == b
        blocks.append((b, lm_scoring.build_filter(h[own], c[own])))
    found = lm_scoring.Filter(bits, blocks)
    got, want = found.levels(h), lm_scoring.level(c)
    assert (got >= want).all() and (got == want).mean() > 0.95
    other = np.setdiff1d(rng.integers(0, 1 << 63, 20000, dtype=np.uint64), h)
    assert (found.levels(other) > 0).mean() < 0.05


def test_isotonic_is_monotone_and_keeps_the_mean():
    rng = np.random.default_rng(0)
    m = rng.normal(size=500).round(1)
    y = (rng.random(500) < 1 / (1 + np.exp(-m))).astype(float)
    knots, values = toxicity.isotonic(m, y)
    assert (np.diff(values) >= 0).all() and (np.diff(knots) >= 0).all()
    assert abs(np.interp(m, knots, values).mean() - y.mean()) < 1e-9


def test_boosting_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    assert (((toxicity.boost(x, y).margin(x) > 0) == y).mean()) > 0.95


@pytest.mark.parametrize("kind", ["normal", "ties", "zero query"])
def test_threshold_algorithm_equals_brute_force(kind):
    rng = np.random.default_rng(3)
    x = rng.integers(-50, 50, (700, 6)) if kind != "ties" else rng.integers(-1, 2, (700, 6))
    q = np.zeros(6) if kind == "zero query" else x[5].astype(float)
    best = []
    for k in range(0, 700, 128):
        best = topk.Lists(list(range(k, min(700, k + 128))), list(x[k : k + 128])).search(q, 5, 10, best)
    want = sorted((-int(x[i] @ q), i) for i in range(700) if i != 5)[:10]
    assert best == want


@pytest.mark.parametrize("kind", ["even", "decaying", "lengths"])
def test_the_threshold_stops_where_weight_or_length_is_uneven(kind):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(4000, 24))
    if kind == "decaying":
        x *= 0.6 ** np.arange(24)
    if kind == "lengths":
        x *= rng.pareto(2.0, 4000)[:, None]
    x = np.floor(1024 * x)
    lists, shares = topk.Lists(list(range(4000)), list(x)), []
    for q in range(0, 4000, 200):
        best = lists.search(x[q], q, 10, [])
        assert best == sorted((-int(x[i] @ x[q]), i) for i in range(4000) if i != q)[:10]
        shares.append(lists.scored / 4000)
    if kind != "even":
        assert np.mean(shares) < 0.5, shares


def test_bounds_hold():
    rng = np.random.default_rng(4)
    for _ in range(60):
        x = np.floor(rng.normal(size=(200, 5)) * rng.choice([3, 50], 5) + rng.choice([0, 40, -40], 5))
        q = np.floor(rng.normal(size=5) * 20)
        lists = topk.Lists(list(range(200)), list(x))
        dims = np.nonzero(q)[0]
        up, down = dims[q[dims] < 0], dims[q[dims] > 0]
        for depth in (0, 1, 5, 40, 120, 199):
            met = set(lists.order[up, :depth].ravel()) | set(lists.order[down, 200 - depth :].ravel())
            unmet = [int(x[i] @ q) for i in range(200) if i not in met]
            assert not unmet or max(unmet) <= lists.bound(q, up, down, depth)


def test_scores_beyond_64_bits_are_held():
    x = [np.array([1e30, -2.0]), np.array([-1e30, 3.0]), np.array([5.0, 1.0])]
    got = topk.Lists([1, 2, 3], x).search(np.array([1e30, 7.0]), 9, 3, [])
    assert got == [(-((1 << 63) - 1), 1), (-((1 << 63) - 1), 3), (1 << 63, 2)]
    assert np.isfinite(topk.integers([1.7e308, -1.7e308])).all()


def test_integers_of_vectors():
    assert topk.integers(None) is None and topk.integers([1.0, None]) is None and topk.integers([float("nan")]) is None
    assert list(topk.integers([0.5, -0.0001])) == [512, -1]


def test_minhash_agreement_estimates_similarity():
    words = [f"w{i}" for i in range(3000)]
    a, b = shingles(" ".join(words)), shingles(" ".join([*words[:2700], *(f"v{i}" for i in range(300))]))
    both = len(np.intersect1d(a, b))
    similarity = both / (len(a) + len(b) - both)
    agree = (near_dedup.minhashes(a) == near_dedup.minhashes(b)).mean()
    assert abs(agree - similarity) < 0.15


def test_shingles_of_short_texts():
    assert len(shingles(None)) == len(shingles("  \n")) == 0
    assert len(shingles("one two")) == 1 and shingles("one two") != shingles("two one")
    assert np.array_equal(shingles("One TWO three"), shingles("one two\tthree"))
    assert not np.array_equal(shingles("É b c"), shingles("é b c"))
