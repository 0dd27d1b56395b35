"""Shared beginnings, repeated strings and filters together, against plain versions."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import pytest

from sessionloom.llm import filter_audit, prefix_trie, substrings
from sessionloom.llm.suffix_groups import repeated, suffix_array

# --- op11 --------------------------------------------------------------------


def plain_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn, role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(v, key=lambda x: (x[0], x[1] or 0))] for c, v in own.items()}
    whole = {}
    for c, mine in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = turns.get(c - int(math.fmod(c, 20)), [])[:h] + mine[h:]
    members = defaultdict(list)
    for c, w in sorted(whole.items()):
        for d in range(len(w) + 1):
            members[tuple(w[:d])].append(c)
    below = defaultdict(set)
    for p in members:
        for d in range(len(p) + 1):
            below[p[:d]].add(p)
    out = set()
    for p, cs in members.items():
        kids = sum(len(q) == len(p) + 1 for q in below[p])
        leaves = sum(not any(len(r) > len(q) for r in below[q]) for q in below[p])
        saved = sum((len(members[q]) - 1) * len(q[-1][1].split()) for q in below[p] if q)
        ends = ",".join(str(c) for c in cs if len(whole[c]) == len(p))
        out.add((cs[0], len(p), members[p[:-1]][0] if p else None, len(cs), kids, leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


NODES = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
TURNS = "conv_id long, turn long, role string, text string"


def trie(spark, rows):
    got = [tuple(r[x] for x in NODES) for r in prefix_trie.prefix_trie(spark.createDataFrame(rows, TURNS)).collect()]
    assert len(got) == len(set(got))
    return set(got)


def conversations(n, seed):
    rnd, rows = random.Random(seed), []
    for c in range(n):
        for t in range(rnd.randint(1, 7)):
            rows.append((c, None if t == 0 and c % 7 == 0 else t, rnd.choice(["user", None, "assistant"]), rnd.choice(["a b", "", None, "c\td  e", "x"])))
    return rows


def test_trie_equals_all_prefixes(spark):
    # families without their first, turnless conversations, negative and null ids
    rows = [r for r in conversations(90, 1) if r[0] != 40] + [(-7, 1, "u", "w"), (None, 1, "u", "w"), (None, None, None, None), (10**12 + 3, 0, "u", "w")]
    assert trie(spark, rows) == plain_trie(rows)


def test_a_long_conversation_is_taken_by_stretches(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "STRETCH", 5)
    rows = conversations(45, 2) + [(c, t, "u", f"t{t}") for c in (60, 61, 62) for t in range(8, 75)]
    assert trie(spark, rows) == plain_trie(rows)


def test_very_many_ends_of_one_node(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "STRETCH", 16)
    rows = [(c, t, "u", f"same {t}") for c in range(300) for t in range(4)]
    assert trie(spark, rows) == plain_trie(rows)


def test_trie_of_nothing_and_of_clashing_columns(spark):
    empty = spark.createDataFrame([], TURNS)
    assert prefix_trie.prefix_trie(empty).columns == list(NODES) and prefix_trie.prefix_trie(empty).count() == 0
    assert prefix_trie.prefix_trie(spark.createDataFrame([(None, 1, "u", "x")], TURNS)).count() == 0
    more = spark.createDataFrame([(1, 1, "u", "x", 5, 6, 7)], TURNS + ", KEY int, depth int, _chunk int")
    assert prefix_trie.prefix_trie(more).count() == 2 - (zlib.crc32(b"1") % 4 > 0)


def test_alike_turns_and_repeated_rows_are_turns_each(spark):
    rows = [(20, 1, "u", "x")] * 3 + [(20, 2, "u", "y")]
    assert trie(spark, rows) == plain_trie(rows)


# --- op12 --------------------------------------------------------------------


@pytest.mark.parametrize("letters", [1, 2, 4])
def test_suffix_array_is_the_order_of_suffixes(letters):
    rnd = random.Random(letters)
    for _ in range(300):
        s = [rnd.randrange(letters) for _ in range(rnd.randint(1, 60))]
        assert suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


@pytest.mark.parametrize("alphabet", [b"ab", b"abc d", b"abcdefgh \n", bytes(range(200))])
def test_repeated_windows_of_a_block(alphabet):
    rnd = random.Random(7)
    for length in (3, 8, 13):
        for _ in range(40):
            strings = [b"x"] + [bytes(rnd.choice(alphabet) for _ in range(rnd.randint(0, 80))) for _ in range(5)]
            seen = Counter(s[i : i + length] for s in strings for i in range(len(s) - length + 1))
            assert [x.tolist() for x in repeated(strings, length)] == [[seen[s[i : i + length]] > 1 for i in range(len(s) - length + 1)] for s in strings]


def plain_cut(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(x[i : i + length] for x in raw for i in range(len(x) - length + 1))
    out = []
    for x in raw:
        gone = [False] * len(x)
        for i in range(len(x) - length + 1):
            if seen[x[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        spans = [i for i in range(len(x)) if gone[i] and (i == 0 or not gone[i - 1])]
        out.append((len(x), sum(gone), len(spans), bytes(b for b, g in zip(x, gone) if not g)))
    return out


def cut(spark, texts, length):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in substrings.cut_repeats(docs, length).collect()}
    return [(r.n_bytes, sum(s["end"] - s["start"] for s in r.removed), len(r.removed), bytes(r.kept)) for r in (got[i] for i in range(len(texts)))]


def passages(seed, n=60):
    rnd = random.Random(seed)

    def prose(k):
        return " ".join("".join(rnd.choice("abdeilmnorstu") for _ in range(rnd.randint(1, 9))) for _ in range(k))

    shared = [prose(60) for _ in range(4)]
    texts = [prose(rnd.randint(0, 60)) + rnd.choice(["", rnd.choice(shared), rnd.choice(shared)[20:300]]) + "é" + prose(rnd.randint(0, 30)) for _ in range(n)]
    return [*texts, texts[3], texts[3], "a" * 900, "b" * 199, "b" * 200, "ab" * 300, "", None, None, "ü" * 350, shared[0][:200], shared[0][1:201]]


def test_cut_equals_counting_every_window(spark):
    texts = passages(1)
    assert cut(spark, texts, 200) == plain_cut(texts, 200)


@pytest.mark.parametrize("group", [0, 3])
def test_keys_with_very_many_strings_are_dealt_out_anew(spark, monkeypatch, group):
    monkeypatch.setattr(substrings, "GROUP", group)
    texts = passages(2)
    assert cut(spark, texts, 200) == plain_cut(texts, 200)


def test_texts_longer_than_a_slice(spark, monkeypatch):
    monkeypatch.setattr(substrings, "SLICE", 300)
    texts = passages(3, 20)
    assert cut(spark, texts, 60) == plain_cut(texts, 60)


def test_short_windows(spark):
    rnd = random.Random(5)
    texts = ["".join(rnd.choice("ab ") for _ in range(rnd.randint(0, 40))) for _ in range(40)]
    assert cut(spark, texts, 6) == plain_cut(texts, 6)


def test_cut_of_nothing_of_null_ids_and_of_clashing_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert substrings.cut_repeats(empty).count() == 0
    rows = [(None, "z" * 250, 1, "k"), (None, "z" * 250, 1, "k"), (3, "short", 2, "k")]
    got = substrings.cut_repeats(spark.createDataFrame(rows, "doc_id long, text string, sid long, key string")).collect()
    assert sorted((r.doc_id or 0, r.n_bytes, len(r.kept)) for r in got) == [(0, 250, 0), (0, 250, 0), (3, 5, 5)]


# --- op13 --------------------------------------------------------------------


def plain_audit(docs, labels):
    labels = [x for x in labels if x[0] is not None]
    good, toxic = {d for d, q, _ in labels if q == 1}, {d for d, _, t in labels if t == 1}
    failing = []
    for i, text, part in docs:
        text = text or ""
        words = [w for w in text.replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text),
            "D": any(c in "#$%&*|" for c in text),
            "E": i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in docs),
        }
        failing.append((part or "", i in good, i in toxic, fails))
    out = {}
    for part in {p for p, *_ in failing}:
        for order in permutations("ABCDE"):
            left = [x for x in failing if x[0] == part]
            everyone = left
            for step, f in enumerate(order, 1):
                gone = [x for x in left if x[3][f]]
                left = [x for x in left if not x[3][f]]
                redundant = sum(x[3][f] for x in everyone) - len(gone)
                alone = sum(x[3][f] and sum(x[3].values()) == 1 for x in everyone)
                out[part, "".join(order), step] = [len(left), len(gone), redundant, alone, sum(x[1] for x in gone), sum(x[2] for x in gone)]
    share = Counter()
    for (part, order, step), x in out.items():
        share[part, order[step - 1]] += x[1]
    return {k: (*x, share[k[0], k[1][k[2] - 1]]) for k, x in out.items()}


def test_audit_equals_applying_every_order(spark):
    rnd, docs = random.Random(3), []
    for i in range(150):
        words = [rnd.choice(["a", "bc", "X", "Yz", "#", "qé"]) + (str(rnd.randint(0, 400)) if i % 3 else "") for _ in range(rnd.choice([0, 5, 199, 200, 260]))]
        docs.append((i, rnd.choice([" ", "\x0b", " \n\t"]).join(words), rnd.choice(["en", "de", None, ""])))
    docs += [(200 + i, docs[i][1], "en") for i in range(0, 60, 2)] + [(300, None, "fr"), (301, "", "fr"), (302, None, None)]
    docs += [(5, docs[5][1], "de"), (5, docs[5][1], "en"), (None, docs[5][1], "en"), (None, "new", "en"), (400, "new", "en"), (401, "  A", "en")]
    labels = [(i, rnd.choice([0, 1, None]), rnd.choice([0, 1])) for i in range(0, 220, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (9999, 1, 1)]
    got = filter_audit.audit(spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    found = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in got.collect()}
    assert found == plain_audit(docs, labels)


def test_audit_of_nothing_and_of_clashing_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(empty, labels).count() == 0
    more = spark.createDataFrame([(1, "x", "en", 3, "y", True)], "doc_id long, text string, lang string, mask int, digest string, first boolean")
    assert filter_audit.audit(more, labels).count() == 600
