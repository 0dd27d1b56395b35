"""Whole queries and operators against plain versions of what they compute."""

import math
import random
import time
import types
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest

from sessionloom.llm import decontaminate, lm_scoring, near_dedup, packing, pii, quality, token_files, toxicity
from sessionloom.llm.words import words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], SCHEMA)


def texts(n, seed, size=40):
    rnd = random.Random(seed)
    pool = [f"{a}{b}" for a in "bdklmnprst" for b in ("a", "e", "io", "u", "ant", "el")]
    return [" ".join(rnd.choice(pool) for _ in range(rnd.randint(1, size))) for _ in range(n)]


# --- op2 ---------------------------------------------------------------------


def test_quality_is_the_discriminant_of_its_formulas(spark):
    rnd = random.Random(6)
    rows = list(enumerate(texts(120, 3))) + [(1000, None), (1001, "")]
    rows = [(i, t if i % 2 or not t else " ".join(t.split()[:2] * rnd.randint(3, 9)) + " !!! ###") for i, t in rows]
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows if i < 1000], "doc_id long, quality int")
    got = {r.doc_id: r.score for r in quality.quality_scores(table(spark, rows), labels).collect()}
    x = {i: np.array(quality.statistics(t or "")) for i, t in rows}
    learn = [i for i, _ in rows if i < 1000 and not quality.held_out(i, 5)]
    k = len(quality.FEATURES)
    groups = [np.array([x[i] for i in learn if i % 2 == c]) for c in (0, 1)]
    means = [g.mean(0) for g in groups]
    within = sum(((g - m).T @ (g - m) for g, m in zip(groups, means)), np.zeros((k, k))) / (len(learn) - 2)
    floor = 1e-2 * np.diag(within).mean() + 1e-6
    for i, t in rows:
        g = []
        for c in (0, 1):
            own = np.cov(groups[c].T)
            cov = 0.9 * own + 0.05 * within + 0.05 * np.diag(np.diag(own)) + floor * np.eye(k)
            d = x[i] - means[c]
            g.append(math.log(len(groups[c]) / len(learn)) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * d @ np.linalg.solve(cov, d))
        z = max(-500.0, min(500.0, (g[1] - g[0]) / 2.0))
        assert abs(got[i] - 1 / (1 + math.exp(-z))) < 1e-6


# --- op3 ---------------------------------------------------------------------


def plain_align(item, text):
    best, prev = 0.0, [0.0] * (len(text) + 1)
    for w in item:
        row = [0.0]
        for j, v in enumerate(text, 1):
            row.append(max(0.0, prev[j - 1] + (1.0 if w == v else -0.5), prev[j] - 0.5, row[-1] - 0.5))
        best, prev = max(best, *row), row
    return best / len(item)


def test_decontamination_finds_what_aligning_everything_finds(spark):
    rnd = random.Random(12)
    items = [(k, f"item{k} " + " ".join(rnd.choice("abcdefghij") * rnd.randint(1, 3) for _ in range(rnd.randint(6, 20)))) for k in range(12)]
    rows = []
    for i in range(60):
        item = items[rnd.randrange(12)][1].split()
        kept = [w if rnd.random() > 0.2 else f"x{rnd.randrange(9)}" for w in item][: rnd.randint(4, 20)]
        rows.append((i, f"{texts(1, i)[0]} {' '.join(kept)} {texts(1, 100 + i)[0]}"))
    rows += [(100, "filler " * 30000 + items[3][1]), (101, items[5][1].upper() + "!"), (102, None), (103, "")]
    found = {(r.doc_id, r.item_id): r.score for r in decontaminate.find_leaks(table(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    for i, t in rows:
        own = decontaminate.words_of(t)[-400:]
        for k, item in items:
            score = plain_align(decontaminate.words_of(item), own)
            grams = {tuple(decontaminate.words_of(item)[j : j + 3]) for j in range(len(item.split()) - 2)}
            seeded = any(tuple(own[j : j + 3]) in grams for j in range(len(own) - 2))
            # an alignment without any three words in a row is stated not to be found
            if score >= 0.5 and seeded:
                assert abs(found[i, k] - score) < 1e-6, (i, k)
            elif score < 0.5:
                assert (i, k) not in found
    assert (100, 3) in found and found[101, 5] == 1.0


def hot_items():
    rnd = random.Random(4)
    items = [(k, "which of the following " + " ".join(f"w{rnd.randrange(9000)}" for _ in range(20))) for k in range(5000)]
    words = [w for _ in range(50) for w in ["which", "of", "the", "following", *(f"f{rnd.randrange(5000)}" for _ in range(40))]]
    return items, words


def test_an_n_gram_of_very_many_items_is_quick():
    items, words = hot_items()
    block = decontaminate.Items(items, 3)
    halves = items[7][1].split()[:16]
    h = decontaminate.hashed([w.encode() for w in [*words[:1000], *halves, *words[1000:]]])
    began = time.time()
    found = block.find(h, 0.5)
    assert time.time() - began < 0.5
    assert [x[0] for x in found] == [7] and abs(found[0][1] - 16 / 24) < 1e-9


@pytest.mark.parametrize("rare", [0, 1, 8, 100])
def test_rarity_decides_the_way_and_not_what_is_found(rare):
    rnd = random.Random(9)
    items = [(k, "which of the following " + " ".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(0, 30)))) for k in range(60)]
    plain, block = decontaminate.Items(items, 3, 10**9), decontaminate.Items(items, 3, rare)
    for i in range(40):
        text = [*(rnd.choice("abcdefghijxyz") for _ in range(rnd.randint(0, 200))), *rnd.choice(items)[1].split(), *"which of the following z z z".split()]
        h = decontaminate.hashed([w.encode() for w in text])
        assert [x[:2] for x in block.find(h, 0.5)] == [x[:2] for x in plain.find(h, 0.5)]


def test_short_items_are_found_as_whole_documents(spark):
    items = spark.createDataFrame([(1, "Yes, please"), (2, "42"), (3, "")], "item_id long, text string")
    rows = [(1, "yes please"), (2, "say yes please now"), (3, "42!"), (4, ""), (5, None), (6, "42 42")]
    assert sorted((r.doc_id, r.item_id, r.score) for r in decontaminate.find_leaks(table(spark, rows), items).collect()) == [(1, 1, 1.0), (3, 2, 1.0)]
    assert sorted(r.doc_id for r in decontaminate.drop_leaks(table(spark, rows), items, block_bytes=3).collect()) == [2, 4, 5, 6]


# --- op5 ---------------------------------------------------------------------


def test_language_model_scores_row_by_row(spark):
    rows = list(enumerate(texts(80, 9))) + [(500, None), (501, ""), (502, "never seen words here")]
    train = [(i, t) for i, t in rows if i % 3]
    got = {r.doc_id: r for r in lm_scoring.lm_scores(table(spark, rows), table(spark, train), bits_per_entry=80).collect()}
    one, two, starts = Counter(), Counter(), 0
    for _, t in train:
        w = [*words(t), None]
        one.update(w)
        two.update(zip(["<", *w], w))
    n, v = sum(one.values()), len(one)

    def held(c):
        """What a count is worth after it was put on the logarithmic scale."""
        return float(lm_scoring.TYPICAL[lm_scoring.level(np.array([c]))[0]]) if c else 0.0

    off = 0
    for i, t in rows:
        w = [*words(t), None]
        base = sum(math.log10((one[x] + 1) / (n + v + 1)) for x in w)
        assert abs(got[i].base_score - base) < 1e-9 and got[i].n_known == sum(one[x] > 0 for x in w) and got[i].train_tokens == n
        score = 0.0
        for a, b in zip(["<", *w], w):
            before = held(one[None] if a == "<" else one[a])
            score += math.log10(min(1.0, (held(two[a, b]) + 100.0 * (held(one[b]) + 1) / (n + v + 1)) / (before + 100.0)))
        # with so many bits the filter has next to nothing that was never put in
        off += abs(got[i].score - score) > 1e-6
    assert off <= 1
    usual = {r.doc_id: r.score for r in lm_scoring.lm_scores(table(spark, rows), table(spark, train)).collect()}
    assert all(abs(usual[i] - got[i].score) <= 0.03 * abs(got[i].score) + 0.5 for i, _ in rows)


def test_scores_do_not_depend_on_partitions(spark):
    rows = table(spark, list(enumerate(texts(60, 21))))
    old, got = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for partitions, bound in (("3", 256), ("16", 256), ("16", 0)):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            got.append({r.doc_id: (r.score, r.base_score) for r in lm_scoring.lm_scores(rows.repartition(int(partitions)), rows, max_filter_mb=bound).collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert all(abs(got[0][i][k] - other[i][k]) < 1e-9 for other in got[1:] for i in got[0] for k in (0, 1))
    assert [lm_scoring.block_bits(n) for n in (0, 10**6, 10**9, 3 * 10**10, 10**14)] == [4, 5, 10, 13, 19]


# --- op6 ---------------------------------------------------------------------


def test_toxicity_features_by_hand():
    lexicon = {b"idiot": 2.0, b"mud": 1.0}
    f = dict(zip(toxicity.FEATURES, toxicity.features("You IDIOT! yourrr mud, id1ot a.b", lexicon)))
    m = 7  # you idiot yourrr mud id1ot a b
    assert f["hits"] == pytest.approx(math.log1p(2)) and f["hit_rate"] == pytest.approx(200 / m) and f["weight_rate"] == pytest.approx(300 / m)
    assert f["distinct_hits"] == 2 and f["starter_rate"] == pytest.approx(100 / m) and f["near_you"] == 2 and f["you_rate"] == pytest.approx(100 / m)
    assert f["shouted"] == pytest.approx(1 / m) and f["exclaims"] == pytest.approx(1 / m) and f["runs"] == pytest.approx(1 / m) and f["undone_hits"] == 1
    assert toxicity.features("", lexicon) == [0.0] * len(toxicity.FEATURES)


def plain_boost(x, y, trees, depth, rate, ridge, cuts):
    margin = np.full(len(y), math.log(y.mean() / (1 - y.mean())))
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)

        def grow(rows, left):
            if not left:
                margin[rows] -= rate * g[rows].sum() / (h[rows].sum() + ridge)
                return
            best, at = 1e-9, None
            for j, own in enumerate(cuts):
                for c in own:
                    a, b = rows[x[rows, j] <= c], rows[x[rows, j] > c]
                    if h[a].sum() < 1e-3 or h[b].sum() < 1e-3:
                        continue
                    gain = g[a].sum() ** 2 / (h[a].sum() + ridge) + g[b].sum() ** 2 / (h[b].sum() + ridge) - g[rows].sum() ** 2 / (h[rows].sum() + ridge)
                    if gain > best + 1e-12:
                        best, at = gain, (a, b)
            for part in at or (rows,):
                grow(part, left - 1)

        grow(np.arange(len(y)), depth)
    return margin


def test_boosting_equals_plain_boosting():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 3)).round(1)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, 9)[1:-1])) for j in range(3)]
    got = toxicity.boost(x, y, trees=6, depth=2, bins=8).margin(x)
    assert np.abs(got - plain_boost(x, y, 6, 2, 0.2, 1.0, cuts)).max() < 1e-9


def test_the_same_model_whatever_text_of_a_repeated_id_comes_first(spark):
    rows = [(i, t) for i, t in enumerate(texts(200, 4))] + [(i, f"{t} mud mudder you") for i, t in enumerate(texts(200, 5))]
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, label int")
    one, two = (toxicity.fit(table(spark, r).repartition(n), labels) for r, n in ((rows, 2), (rows[::-1], 5)))
    assert one.lexicon == two.lexicon and np.array_equal(one.trees.leaf, two.trees.leaf)


# --- op8 ---------------------------------------------------------------------


def test_wanted_documents_are_read_alone(spark, tmp_path, monkeypatch):
    from tokenizers import Tokenizer

    from sessionloom.llm.tokens import tokenizer_path

    rows = [(i // 2 if i < 40 else i, t) for i, t in enumerate(texts(300, 7, 60))] + [(None, "of nobody"), (999, ""), (1000, None)]
    folder = f"file://{tmp_path}/tokens"
    token_files.write_token_files(table(spark, rows), folder, "word_bpe_49k.json")
    tok = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    ids = [3, 3, 7, 55, 299, 999, 1000, 5000, None]
    got = sorted((r.doc_id, tuple(r.ids)) for r in token_files.read_documents(spark, folder, spark.createDataFrame([(i,) for i in ids], "doc_id long")).collect())
    want = sorted((i, (*tok.encode(t or "", add_special_tokens=False).ids, 1)) for i, t in rows if i in set(ids) - {None})
    assert got == want
    assert not (tmp_path / "tokens" / "_attempts").exists()
    assert [token_files.arrow_uri(u) for u in ("s3a://b/x", "file:///x", "/x", "hdfs://h/x")] == ["s3://b/x", "file:///x", "/x", "hdfs://h/x"]


# --- op10 --------------------------------------------------------------------


def least_bins(items, capacity):
    """The least number of bins, by trying everything."""
    best = len(items)

    def place(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(items):
            best = len(rooms)
            return
        for r in {room: j for j, room in enumerate(rooms) if room >= items[k]}.values():
            rooms[r] -= items[k]
            place(k + 1, rooms)
            rooms[r] += items[k]
        rooms.append(capacity - items[k])
        place(k + 1, rooms)
        rooms.pop()

    place(0, [])
    return best


def test_swaps_empty_bins_that_best_fit_leaves():
    items = [10, 10, 8, 8, 8, 6, 5, 5, 4, 4, 4, 2, 2, 2, 2]
    start = packing.best_fit(Counter(items), 20)
    assert sum(start.values()) == 5 and sum(packing.local_search(start, 20).values()) == 4 == least_bins(items, 20)
    rnd = random.Random(1)
    fewer = near = 0
    for _ in range(150):
        capacity = rnd.choice([20, 30])
        items = sorted((rnd.randint(1, capacity // 2) for _ in range(rnd.randint(4, 12))), reverse=True)
        start = packing.best_fit(Counter(items), capacity)
        found = packing.local_search(start, capacity)
        assert Counter(x for kind, n in found.items() for x in kind * n) == Counter(items) and max(map(sum, found)) <= capacity
        assert sum(found.values()) <= sum(start.values())
        assert sum(sum(k) ** 2 * n for k, n in found.items()) >= sum(sum(k) ** 2 * n for k, n in start.items())
        fewer += sum(found.values()) < sum(start.values())
        near += sum(found.values()) == least_bins(items, capacity)
    assert near >= 148


@pytest.mark.parametrize("low, high, times, share", [(300, 399, 1, 1.12), (300, 499, 1, 1.14), (300, 699, 1, 1.006), (300, 699, 50, 1.006), (1, 1024, 1, 1.02)])
def test_the_search_ends_in_seconds_near_the_bound(low, high, times, share):
    rnd = random.Random(1)
    counts = {x: rnd.randint(1000, 10000) * times for x in range(low, high + 1)}
    start = packing.best_fit(counts, 1024)
    began = time.time()
    found = packing.local_search(start, 1024)
    assert time.time() - began < 60  # a second or two on an idle machine
    held = Counter()
    for kind, n in found.items():
        assert n > 0 and sum(kind) <= 1024
        for x in kind:
            held[x] += n
    assert held == Counter(counts)
    assert sum(found.values()) <= share * sum(x * n for x, n in counts.items()) / 1024
    assert sum(found.values()) <= sum(start.values())
    kinds = packing.Kinds(found, 1024)
    assert all(kinds.best(s) is None for s in range(0, len(kinds.kinds), 7))


def test_places_in_shares_are_the_same(spark, monkeypatch):
    rnd = random.Random(3)
    counts = Counter(rnd.randint(1, 64) for _ in range(500))
    whole = packing.Slots(packing.pack_counts(dict(counts), 64))
    for share in whole.shares(40):
        for length in share.by_length:
            r = np.arange(counts[length])
            assert all(np.array_equal(a, b) for a, b in zip(share.place(np.full(len(r), length), r), whole.place(np.full(len(r), length), r)))
    docs = table(spark, list(enumerate(texts(100, 8))))
    got = [sorted(map(tuple, packing.pack(docs, "byte_bpe_50k.json", 64, max_entries=n).collect())) for n in (1 << 20, 30)]
    assert got[0] == got[1]


# --- the pipeline ------------------------------------------------------------


def write_tables(spark, folder, docs, labels, items):
    table(spark, docs).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_pipeline_on_awkward_tables(spark, tmp_path):
    rnd = random.Random(4)
    bad = ["grimble", "snorkug", "fleebat"]
    plain = texts(400, 30, 50)
    docs = [(i, t if i % 4 else " ".join(x for w in t.split() for x in ((w, rnd.choice(bad)) if rnd.random() < 0.3 else (w,))) + " grimble fleebat snorkug") for i, t in enumerate(plain)]
    labels = [(i, 1, int(i % 4 == 0)) for i in range(400)]
    item = "the seven quiet wizards brew strong coffee for the lazy brown fox every single morning"
    extra = [(1000, None), (1001, ""), (1002, None), (1003, plain[1]), (1003, plain[2]), (1004, f"{texts(1, 50)[0]} {item} {texts(1, 51)[0]}"), (1005, "write to ann@example.org soon"), (1006, "long " * 30000), (None, "nobody owns this text at all")]
    write_tables(spark, tmp_path / "t", docs + extra, labels, [(1, item), (2, None), (3, "")])
    pieces = corpus_pipeline.run(spark, str(tmp_path / "t")).collect()
    kept = {r.doc_id for r in pieces}
    # what each stage says, by its own plain rule on the same rows
    model_says = {r.doc_id: r.score for r in toxicity.toxicity_scores(table(spark, docs + extra), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    left = [(i, t) for i, t in docs + extra if i is None or model_says[i] < 0.7]
    assert sum(i is not None and i < 400 and i % 4 == 0 for i, _ in left) <= 5 and sum(i is not None and i < 400 and i % 4 > 0 for i, _ in left) >= 297
    component = {r.doc_id: r.component_id for r in near_dedup.duplicate_components(table(spark, left)).collect()}
    left = [(i, t) for i, t in left if i is None or component[i] == i]
    assert 1004 not in kept and {1000, 1001, 1002, None, 1006} <= kept and 1003 not in kept
    want = {i for i, _ in left if i != 1004}
    assert kept == want
    by_sequence = {}
    for r in pieces:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    long = sorted((r.piece, r.start, r.length) for r in pieces if r.doc_id == 1006)
    assert len(long) > 20 and all(b[1] == a[1] + a[2] and b[2] == 1024 for a, b in zip(long, long[1:]))
    assert pii.find_pii(table(spark, [(1, "write to <email> soon")])).first().base == []


def test_pipeline_on_empty_tables(spark, tmp_path):
    write_tables(spark, tmp_path / "t", [], [], [])
    out = corpus_pipeline.run(spark, str(tmp_path / "t"))
    assert out.collect() == [] and out.columns[:5] == ["doc_id", "piece", "start", "length", "ids_crc32"]
    write_tables(spark, tmp_path / "u", [(1, None), (2, "two words")], [], [])
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path / "u")).collect()) == [1, 2]


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    from sessionloom.llm import common

    none = types.SimpleNamespace(conf=types.SimpleNamespace(get=lambda *a: None), sparkContext=types.SimpleNamespace(getCheckpointDir=lambda: None, master="spark://far:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(none)


