"""Every operator on awkward small tables, against plain versions."""

import hashlib
import math
import random
import struct
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sessionloom.llm import decontaminate, lm_scoring, near_dedup, packing, pii, quality, token_counts, token_files, topk, toxicity
from sessionloom.llm.components import components
from sessionloom.llm.tokens import tokenizer_path

BYTE, WORD = "byte_bpe_50k.json", "word_bpe_49k.json"
#: Extra columns that clash with what operators make, and with each other but for case.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, n_tokens string, component_id string, row string, key string, Extra int"


def table(spark, rows):
    full = [(i, t, "en", "s", None if t is None else len(t), 0.5, "x", "y", "z", None, 1) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA)


def sample_rows(n=60, seed=1):
    rnd = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "été", "x1", "No.", "so,", "you", "run"]
    return [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 60)))) for i in range(n)]


LONG = "word " * 40000
AWKWARD = [(1000, None), (1001, ""), (None, "no id here"), (None, None), (1002, LONG), (1003, "   \n\t "), (1004, "same text of six words here"), (1004, "same text of six words here"), (1005, "same text of six words here")]


def labels(spark, ids, toxic=lambda i: i % 2, good=lambda i: i % 2):
    return spark.createDataFrame([(i, good(i), toxic(i)) for i in ids] + [(None, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, sample_rows() + AWKWARD)


@pytest.fixture(scope="module")
def nothing(spark):
    return table(spark, [])


def everything(df):
    return df.collect()


def test_duplicate_named_columns_are_no_matter(spark, docs):
    twice = docs.select("*", F.lit("other").alias("TEXT"), F.lit(5).alias("text2"))
    twice = twice.toDF(*twice.columns[:-1], "text")
    assert token_counts.count_tokens(twice, BYTE).count() == docs.count()
    assert pii.redact(twice).columns == twice.columns
    assert decontaminate.drop_leaks(twice, spark.createDataFrame([(1, "never in any of them")], "item_id long, text string")).count() == docs.count()


def test_token_counts_and_cache(spark, docs, nothing, tmp_path):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path(BYTE))
    cache = str(tmp_path / "cache")
    want = Counter((r.doc_id, len((r.text or "").encode()), len(tok.encode(r.text or "", add_special_tokens=False).ids)) for r in docs.collect())
    for _ in range(2):  # the second run finds all in the cache
        got = Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(docs, BYTE, cache).collect())
        assert got == want
    stored = spark.read.parquet(cache)
    assert stored.count() == stored.select("digest").distinct().count() == docs.select(F.coalesce("text", F.lit(""))).distinct().count()
    assert token_counts.count_tokens(nothing, BYTE, cache).count() == 0


def test_token_files(spark, docs, nothing, tmp_path):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path(WORD))
    folder = f"file://{tmp_path}/tokens"
    parts = token_files.write_token_files(docs, folder, WORD)
    got = token_files.read_token_files(spark, folder).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, token_files.read_token_files(spark, folder, parts).collect()))
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = [r.doc_id if r.doc_id is not None else -1 for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order)
    want = Counter()
    for r in docs.collect():
        ids = [*tok.encode(r.text or "", add_special_tokens=False).ids, 1]
        want[(r.doc_id, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    empty = f"file://{tmp_path}/none"
    assert token_files.read_token_files(spark, empty, token_files.write_token_files(nothing, empty, WORD)).count() == 0


def test_packing(spark, docs, nothing):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path(BYTE))
    got = packing.pack(docs, BYTE, capacity=64).collect()
    want = Counter()
    for r in docs.collect():
        ids = [*tok.encode(r.text or "", add_special_tokens=False).ids, 2]
        first = len(ids) % 64 or 64
        cuts = [0, *range(first, len(ids) + 1, 64)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[(r.doc_id, k, a, b - a, zlib.crc32(struct.pack(f"<{b - a}I", *ids[a:b])))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 64
    total = sum(r.length for r in got)
    assert len(sequences) <= math.ceil(total / 64) * 1.05 + 1
    assert packing.pack(nothing, BYTE).count() == 0


def plain_components(rows):
    sets = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        if i is not None and w:
            sets.setdefault(i, []).append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))))
    parent = {i: i for i, _ in rows if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if any(100 * len(s & t) >= 75 * len(s | t) for s in sets[a] for t in sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: find(i) for i in parent}


def near_rows():
    rnd = random.Random(4)
    base = [f"w{rnd.randint(0, 500)}" for _ in range(90)]
    rows = [(100, " ".join(base))]
    for i in range(101, 150):  # edited copies, near the threshold and far from it
        words = list(base)
        for _ in range(rnd.randint(0, 4)):
            words[rnd.randrange(90)] = f"v{rnd.randint(0, 9999)}"
        rows.append((i, " ".join(words)))
    return rows + [(i, t.upper()) for i, t in rows[:3]] + [(7, "one two three"), (6, "ONE two\tthree"), (5, "one two four"), (9, "aa bb cc dd ee"), (8, "aa bb cc dd ee ff")]


def test_near_duplicates_equal_brute_force(spark, nothing):
    rows = near_rows() + AWKWARD
    df = table(spark, rows)
    want = plain_components(rows)
    got = near_dedup.duplicate_components(df).collect()
    assert len(got) == len(rows)
    assert len(set(want.values())) < len(want)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.component_id, r.kept) == (want[r.doc_id], r.doc_id == want[r.doc_id])
    kept = near_dedup.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").select("doc_id").distinct().collect()) == sorted(set(want.values()))
    assert near_dedup.duplicate_components(nothing).count() == 0 and near_dedup.drop_near_duplicates(nothing).count() == 0


def test_rows_that_repeat_an_id_are_one_document(spark):
    a, b, other = ("one two three four five six seven", "red green blue black white grey", "no text is like this one at all")
    rows = [(3, a), (5, a), (5, b), (9, b), (11, other), (11, ""), (12, None), (13, b), (13, None)]
    got = near_dedup.duplicate_components(table(spark, rows)).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.component_id, r.kept) for r in got} == {(3, 3, True), (5, 3, False), (9, 3, False), (11, 11, True), (12, 12, True), (13, 3, False)}


def test_recall_among_edited_copies_of_one_text(spark):
    rnd = random.Random(11)
    base = [f"w{rnd.randrange(5000)}" for _ in range(300)]
    rows = []
    for i in range(240):
        copy = list(base)
        for at in rnd.sample(range(300), rnd.randrange(1, 14)):
            copy[at] = f"edit{rnd.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(296)} for i, t in rows}
    component = {i: i for i, _ in rows}
    def root(i):
        while component[i] != i:
            i = component[i]
        return i
    for i in range(240):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                component[max(root(i), root(j))] = min(root(i), root(j))
    got = {r.doc_id: r.component_id for r in near_dedup.duplicate_components(table(spark, rows)).collect()}
    right = sum(got[i] == root(i) for i in range(240))
    assert right >= 0.99 * 240 and len({root(i) for i in range(240)}) > 5


def test_components_of_chains_stars_and_loops(spark):
    rnd = random.Random(9)
    links = [(i, i + 1) for i in range(100, 160)] + [(500, 500 + k) for k in range(1, 40)] + [(9, 9)] + [(rnd.randint(1000, 1100), rnd.randint(1000, 1100)) for _ in range(60)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: find(i) for i in parent if i != 9 and (find(i) != i or sum(find(j) == i for j in parent) > 1)}


def test_language_model(spark, docs, nothing):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    training = docs.where("doc_id % 2 = 0")
    counts = Counter()
    for i, t in rows:
        if i is not None and i % 2 == 0:
            counts.update((t or "").encode().lower().split())
            counts[None] += 1
    n, v = sum(counts.values()), len(counts)
    results = [lm_scoring.lm_scores(docs, training, common_words=k, max_filter_mb=m).collect() for k, m in ((1 << 20, 256), (3, 256), (0, 0))]
    want = Counter()
    for i, t in rows:
        w = [*(t or "").encode().lower().split(), None]
        want[(i, len(w), sum(counts[x] > 0 for x in w), n, round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), 4))] += 1
    for got in results:
        assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
        assert all(r.score <= 0 for r in got)
    sums = [sum(r.score for r in got) for got in results]
    assert sums[0] == pytest.approx(sums[1]) and sums[0] == pytest.approx(sums[2], rel=0.05)
    assert lm_scoring.lm_scores(nothing, nothing).count() == 0
    untrained = lm_scoring.lm_scores(docs, nothing).first()
    assert untrained.train_tokens == 0 and untrained.base_score == 0


def test_the_filter_answers_alike_broadcast_or_not(spark):
    rnd = random.Random(12)
    df = table(spark, [(i, " ".join(f"w{int(rnd.paretovariate(0.5)) % 3000}" for _ in range(rnd.randint(0, 200)))) for i in range(300)] + AWKWARD).repartition(3, "doc_id")
    training = df.where("doc_id % 2 = 0")
    one, two = ([(r.doc_id, r.n_tokens, round(r.score, 6)) for r in lm_scoring.lm_scores(df, training, max_filter_mb=m).collect()] for m in (256, 0))
    assert Counter(one) == Counter(two)


def test_pii_spans(spark, docs, nothing):
    texts = ["mail a.b@c.de or 1.2.3.4, not 1.2.3.400", "card 4111 1111 1111 1111 phone +1 (555) 010-9999", None, "", "é +49 30 1234567"]
    df = table(spark, list(enumerate(texts)) + [(1, texts[1]), (None, texts[0])])
    got = pii.find_pii(df).collect()
    assert len(got) == 7
    for r in got:
        if r.doc_id is not None:
            spans = [tuple(s) for s in r.base]
            assert spans == pii.base_spans(texts[r.doc_id] or "")
            assert r.base_sha256 == hashlib.sha256(pii.joined(spans).encode()).hexdigest()
    out = {r.doc_id: r for r in pii.redact(df).collect()}
    assert out[0].text == "mail <email> or <ip>, not 1.2.3.400" and out[0].n_chars == len(out[0].text)
    assert out[1].text == "card <card> phone <phone>" and out[2].text is None and out[3].text == ""
    assert pii.find_pii(nothing).count() == 0 and pii.redact(nothing).count() == 0


def test_patterns_find_what_no_rule_knows(spark):
    known = [(i, f"some words reach e-mail: user{i}@host{i}.com then more") for i in range(12)]
    new = [(100 + i, f"please reach e-mail: joe{i}[at]host.com bye {i}") for i in range(3)]
    other = [(200 + i, f"the room x{i}@ is free, ordinary text {i}45678901 here") for i in range(20)]
    found = {r.doc_id: r for r in pii.find_pii(table(spark, known + new + other)).collect()}
    for i, text in new:
        start = text.index("joe")
        assert [tuple(s) for s in found[i]["all"]] == [(start, 0, text.index(" bye"))]
    for i, _ in known + other:
        assert found[i].base == found[i]["all"]


def test_discovered_instances_induce_patterns(spark):
    """Seeds teach ``e-mail:``; what stands there teaches ``reachable under``; that finds others.  Precision and recall of the added spans are 1."""
    rows = [(i, f"text {i} e-mail: user{i}@host{i}.com more") for i in range(40)]
    rows += [(100 + i, f"please e-mail: joe{i}[at]host.com bye") for i in range(4)]
    rows += [(200 + i, f"she is reachable under joe{i % 4}[at]host.com today") for i in range(8)]
    rows += [(300, "he is reachable under ann0[at]other.org today")]
    rows += [(400 + i, f"phone: +49 30 1234{i}67 or so") for i in range(12)] + [(500 + i, f"phone: 030 123 45{i}7 or so") for i in range(3)]
    rows += [(600 + i, f"room x{i}@ is free, number 123 45{i}7 8 and y{i}[at]z are of no kind") for i in range(20)]
    want = {(i, text[s : s + n]) for i, text in rows for mark, n in (("joe", 16), ("ann", 17), ("030", 12)) for s in [text.find(mark)] if s >= 0}
    texts = dict(rows)
    got = set()
    for r in pii.find_pii(table(spark, rows)).collect():
        assert set(r.base) <= set(r["all"])
        got |= {(r.doc_id, texts[r.doc_id][s.start : s.end]) for s in set(r["all"]) - set(r.base)}
    assert got == want


def test_a_chain_of_contexts_is_followed_to_its_end(spark):
    """Eight generations from the seeds: each context teaches instances, of which the next context is learnt."""
    rows = [f"text via0 lane0 user{i}@host{i}.com more" for i in range(60)]
    for g in range(1, 9):
        for near in (g - 1, g):
            rows += [f"text via{near} lane{near} kin{g}n{i % 4}[at]host.com more" for i in range(60)]
    rows.append("text via8 lane8 last[at]host.com more")
    found = {r.doc_id: [tuple(s) for s in r["all"]] for r in pii.find_pii(table(spark, list(enumerate(rows)))).collect()}
    for i, text in enumerate(rows):
        start = text.index("lane") + 6
        assert found[i] == [(start, 0, text.index(" more"))], text


def test_decontamination(spark, docs, nothing):
    rnd = random.Random(2)
    items = [(k, " ".join(f"q{rnd.randint(0, 5000)}" for _ in range(30))) for k in range(20)] + [(50, None), (51, ""), (52, "two words"), (None, "a b c d e f g"), (3, None)]
    bench = spark.createDataFrame(items + items[:2], "item_id long, text string")
    filler = " ".join(f"f{i}" for i in range(200))
    exact = [(k, f"{filler} {items[k][1].upper()}. {filler}") for k in range(0, 5)]
    edited = []
    for k in range(5, 10):
        words = items[k][1].split()
        for at in range(2, 30, 6):
            words[at] = "changed"
        edited.append((k, f"{filler} {' '.join(words[:12])} extra {' '.join(words[12:])} {filler}"))
    clean = [(100 + i, t) for i, t in sample_rows(30)] + [(200, " ".join(items[11][1].split()[:6]))]
    df = table(spark, exact + edited + clean + [(None, None), (301, "")])
    for block in (20000, 3):
        got = decontaminate.find_leaks(df, bench, block_items=block).collect()
        assert sorted((r.doc_id, r.item_id) for r in got) == [(k, k) for k in range(10)]
        assert all(r.score == 1 for r in got if r.doc_id < 5)
    assert decontaminate.drop_leaks(df, bench).count() == df.count() - 10
    assert decontaminate.find_leaks(nothing, bench).count() == 0 and decontaminate.find_leaks(df, bench.limit(0)).count() == 0


def test_a_passage_in_very_many_documents_still_has_seeds(spark):
    item = "the quick brown fox jumps over the lazy dog while seven wizards quietly brew strong coffee"
    df = table(spark, [(i, f"start {i} {item} end {i}") for i in range(300)])
    got = decontaminate.find_leaks(df, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert got.count() == 300


@pytest.mark.parametrize("copies,others", [(5, 40), (300, 40), (100, 200)])
def test_an_edited_passage_in_many_documents_is_found(spark, copies, others):
    words = [f"q{k}" for k in range(40)]
    edited = ["changed" if k % 5 == 4 else w for k, w in enumerate(words)]
    half = words[:22]
    rows = [(i, f"start {i} {' '.join(edited)} end {i}") for i in range(copies)] + [(1000 + i, f"start {' '.join(half)} end {i}") for i in range(copies)]
    rows += [(5000 + i, f"nothing of it in {i} but q1 q2 q3 alone") for i in range(others)]
    df, bench = table(spark, rows), spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    got = {r.doc_id: r.score for r in decontaminate.find_leaks(df, bench).collect()}
    assert got == {i: 0.7125 if i < 1000 else 0.55 for i, _ in rows if i < 5000}
    # the edited copies alone, without the other half of the item anywhere
    assert decontaminate.drop_leaks(df.where("doc_id < 1000 or doc_id >= 5000"), bench).count() == others


def toxic_rows():
    rnd = random.Random(8)
    plain = [f"p{k}" for k in range(300)]
    bad = ["grimble", "snorkug", "fleebat"]
    rows = []
    for i in range(600):
        words = [rnd.choice(plain) for _ in range(rnd.randint(15, 60))]
        if i % 4 == 0:
            for _ in range(3):
                words.insert(rnd.randrange(len(words)), rnd.choice(bad))
        rows.append((i, " ".join(words)))
    return rows


def test_toxicity_learns_words_from_labels(spark, nothing):
    rows = toxic_rows()
    df = table(spark, rows + AWKWARD)
    known = labels(spark, [i for i, _ in rows], toxic=lambda i: int(i % 4 == 0))
    got = toxicity.toxicity_scores(df, known).collect()
    assert len(got) == len(rows) + len(AWKWARD) and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 600]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got if r.doc_id is not None)
    assert sum((r.score >= 0.7) == (r.doc_id % 4 == 0) for r in held) >= 0.97 * len(held)
    kept = toxicity.drop_toxic(df, known)
    assert kept.columns == df.columns and 400 <= kept.count() - len(AWKWARD) <= 470
    assert toxicity.toxicity_scores(nothing, known).count() == 0
    assert {r.score for r in toxicity.toxicity_scores(df, known.limit(0)).collect()} == {0.0}


def test_quality_learns_from_labels(spark, docs, nothing):
    rnd = random.Random(6)
    rows = []
    for i in range(400):
        words = [f"w{rnd.randint(0, 900)}" for _ in range(rnd.randint(30, 80))]
        rows.append((i, " ".join(words) + "." if i % 3 else " ".join(w.upper() + "!!" for w in words[:5]) * 8))
    df = table(spark, rows + AWKWARD)
    known = labels(spark, [i for i, _ in rows], good=lambda i: int(i % 3 != 0))
    got = quality.quality_scores(df, known).collect()
    assert len(got) == len(rows) + len(AWKWARD) and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 400]
    assert held and sum((r.score >= 0.3) == (r.doc_id % 3 != 0) for r in held) >= 0.97 * len(held)
    assert quality.quality_scores(nothing, known).count() == 0
    assert {r.score for r in quality.quality_scores(df, known.limit(0)).collect()} == {0.0}


def test_top_k(spark):
    rnd = random.Random(3)
    rows = [(i, [rnd.choice([-1.0, -0.5, 0.0, 0.25, 0.5]) for _ in range(4)]) for i in range(300)]
    odd = [(400, None), (500, [1.0, None, 0.0, 0.0]), (600, [float("nan")] * 4), (700, [float("inf")] * 4), (None, [1.0] * 4), (800, [0.5, 0.5]), (900, [0.0] * 4), (3, rows[3][1]), (100, rows[100][1])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    whole = {i: [math.floor(1024 * x) for x in v] for i, v in rows + [(900, [0.0] * 4), (800, [0.5, 0.5])]}
    for block in (4096, 2):
        got = topk.top_k(df, df.where("vec_id % 100 = 0"), block_queries=block).collect()
        want = set()
        for q in (0, 100, 200, 900, 800):
            scores = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q and len(v) == len(whole[q]))
            want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(scores[:10])}
        assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in got} == want and len(got) == len(want)
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0
    huge = spark.createDataFrame([(0, [1e30, 1.0]), (1, [1e30, 2.0]), (2, [-1e30, 0.0]), (100, [None, 1.0]), (100, [1.0, 1.0])], "vec_id long, embedding array<double>")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.top_k(huge, huge.where("vec_id % 100 = 0")).collect()}
    assert got[0, 1] == (1, 2**63 - 1) and got[0, 3] == (2, -(2**63)) and (100, 1) in got
