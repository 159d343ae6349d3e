"""Conversation tries, vector codes and register sketches against plain versions."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from occura.llm import prefixes, setsketch, vectors
from occura.llm.radix import Full, Indexed, Tree

# --- conversation trie ---------------------------------------------------------------------------------------------------


def plain_trie(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            convs[conv].append(((turn is not None, turn or 0), hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest(), role, text))
    own = {c: [(role, text) for *_, role, text in sorted(v)] for c, v in convs.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = tuple(own.get(c - c % 100, [])[:h] + turns[h:])
    members, kids = defaultdict(list), defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    for path in members:
        if path:
            kids[path[:-1]].append(path)
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        leaves[path] = sum(leaves[k] for k in kids[path]) if kids[path] else 1
        saved[path] = sum(saved[k] for k in kids[path]) + ((len(members[path]) - 1) * len(path[-1][1]) if path else 0)
    return sorted(
        (
            (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p], prefixes.sha_of([c for c in m if len(built[c]) == len(p)]))
            for p, m in members.items()
        ),
        key=str,
    )


TURNS = "conv_id bigint, turn bigint, role string, text string, key string, node string, chunk int, head bigint, part int"


def trie(spark, rows, **more):
    df = spark.createDataFrame([(*r, "x", None, 1, 2, 3) for r in rows], TURNS)  # extra columns with names that are used within
    return sorted(map(tuple, prefixes.conversation_trie(df, **more).collect()), key=str)


def made_turns():
    rng = np.random.default_rng(3)
    rows = []
    for c in range(260):
        shared = int(rng.integers(0, 4))
        for t in range(int(rng.integers(1, 7))):
            text = f"shared {t}" if t < shared else f"own {rng.integers(0, 40)} é"
            rows.append((c, t, ["user", "assistant"][t % 2], text))
    rows += [(300 + k, t, "user", f"copy {t}") for k in range(40) for t in range(7)]  # a group of equal conversations
    rows += [(401, t, "user", f"long {t % 3}") for t in range(350)]
    rows += [(500, None, None, None), (500, None, None, None), (500, 1, "", ""), (500, 1, "user", None), (500, 1, "user", "b"), (None, 1, "user", "lost"), (501, 3, "user", "b"), (777, 0, "system", "alone")]
    return rows


@pytest.mark.parametrize("chunk", [1, 7, 20_000])
def test_trie_equals_plain_version(spark, chunk):
    rows = made_turns()
    assert trie(spark, rows, chunk=chunk) == plain_trie(rows)


def test_trie_of_ties_repeats_and_empty_tables(spark):
    assert trie(spark, []) == []
    rows = [(5, 0, "user", "a"), (5, 0, "user", "a"), (5, 0, "user", "z"), (7, 2, None, None)]
    assert trie(spark, rows) == plain_trie(rows) == trie(spark, rows[::-1])


def test_borrowed_turns_can_leave_a_conversation_empty(spark):
    c = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 >= 2)
    found = trie(spark, [(c, 0, "user", "gone")])
    assert found == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_hot_first_turns_and_ends_are_split(spark):
    """A third of the conversations are equal, over several partitions; their ends meet as one text a chunk."""
    rows = [(c, t, "user", f"hot {t}") for c in range(0, 3000, 3) for t in range(6)] + [(c, 0, "user", f"own {c}") for c in range(1, 3000, 3)]
    assert trie(spark, rows, chunk=50) == plain_trie(rows)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(min_size=0, max_size=5), max_size=400))
def test_radix_tree_keeps_all_keys_in_order(keys):
    tree = Tree()
    for k, key in enumerate(keys):
        tree.insert(key, k)
    found = [k for node, _, down in tree.walk() if down for k in node.values]
    assert found == sorted(range(len(keys)), key=lambda k: (keys[k], k))


def test_radix_layouts_grow():
    tree = Tree()
    kinds = []
    for byte in range(256):
        tree.insert(bytes([byte, 1]), byte)
        children = tree.root.children
        kinds.append(children.room if children else 0)
    assert kinds[1] == 4
    assert kinds[4] == 16
    assert kinds[16] == 48
    assert kinds[48] == 256
    assert isinstance(tree.root.children, Full)
    assert Indexed.room == 48


# --- vector codes --------------------------------------------------------------------------------------------------------


def plain_codes(rows, entries, rounds):
    kept = sorted(((i is None, i or 0, [int(np.floor(1024 * float(x))) for x in v], k) for i, v, k in rows if v and all(x is not None and np.isfinite(x) for x in v)), key=lambda r: r[:3])
    width = len(kept[0][2]) // 4
    books, codes, errors = [], [], [0] * len(kept)
    for p in range(4):
        points = [r[2][p * width : (p + 1) * width] for r in kept]
        book = [list(x) for x in points[:entries]]
        for turn in range(rounds + 1):
            best = [min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book)) for x in points]
            if turn < rounds:
                for k in range(len(book)):
                    own = [x for x, (_, j) in zip(points, best, strict=True) if j == k]
                    if own:
                        book[k] = [sum(c) // len(own) for c in zip(*own, strict=True)]
        books.append(book)
        codes.append([k for _, k in best])
        errors = [e + far for e, (far, _) in zip(errors, best, strict=True)]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    by_label = defaultdict(int)
    for r, e in zip(kept, errors, strict=True):
        by_label[r[3]] += e
    return sorted(((None if r[0] else r[1], "".join(f"{c[k]:02x}" for c in codes), errors[k], by_label[r[3]], sha) for k, r in enumerate(kept)), key=str)


VECTORS = "vec_id bigint, embedding array<float>, label int, row string, part string, code int, error string, n int, v int"


def coded(spark, rows, **more):
    df = spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], k, "r", "p", 1, "e", 2, 3) for i, v, k in rows], VECTORS)
    return sorted(map(tuple, vectors.vector_codes(df, **more).collect()), key=str)


def made_vectors(n, width, seed=1):
    rng = np.random.default_rng(seed)
    centers = rng.normal(0, 0.3, (5, width))
    return [(int(i), (centers[i % 5] + rng.normal(0, 0.05, width)).astype(np.float32).tolist(), int(i % 3)) for i in rng.permutation(n)]


def test_codes_equal_plain_version(spark):
    rows = made_vectors(300, 16)
    hot = rows[0][1]
    rows += [(1000 + k, hot, None) for k in range(150)]  # a third are one vector
    rows += [(2000, None, 1), (2001, [None] * 16, 1), (2002, [float("nan")] * 16, 2), (2003, [float("inf")] + [0.0] * 15, 2), (2004, [], 2)]
    rows += [(None, rows[1][1], 7), (None, rows[2][1], 7), (5, rows[3][1], 1), (rows[4][0], rows[4][1], rows[4][2])]  # null, shared and repeated ids
    assert coded(spark, rows, entries=12, rounds=3) == plain_codes(rows, 12, 3)


def test_codes_of_few_equal_and_no_vectors(spark):
    assert coded(spark, []) == []
    assert coded(spark, [(1, None, 1)]) == []
    rows = [(k, [0.5, -0.25, 0.125, 1.0], None) for k in range(9)]
    assert coded(spark, rows) == plain_codes(rows, 256, 4)


def test_codes_of_large_components_are_exact(spark):
    rows = [(k, [(-1.0) ** k * 60000.0 + k * 0.37, k * 11.1, -3e4 + k, 0.001 * k] * 2, k % 2) for k in range(40)]
    assert coded(spark, rows, entries=6, rounds=2) == plain_codes([(i, np.float32(v).tolist(), k) for i, v, k in rows], 6, 2)
    with pytest.raises(ValueError, match="components"):
        coded(spark, [(1, [1e9, 0, 0, 0], 1)])
    with pytest.raises(ValueError, match="length"):
        coded(spark, [(1, [1.0] * 4, 1), (2, [1.0] * 8, 1)])


def test_shortlists_hold_every_nearest_entry():
    rng = np.random.default_rng(2)
    entries = rng.integers(-400, 400, (64, 6))
    for _ in range(50):
        points = rng.integers(-300, 300, 6) + rng.integers(-40, 40, (30, 6))
        least, most = vectors.box_distances(points.min(0)[None], points.max(0)[None], entries)
        listed = set(np.flatnonzero(least[0] <= most[0].min()).tolist())
        far = ((points[:, None] - entries[None]) ** 2).sum(2)
        assert {int(k) for k in np.flatnonzero((far == far.min(1)[:, None]).any(0))} <= listed
        assert (least[0] <= far.min(0)).all()
        assert (most[0] >= far.max(0)).all()


def test_hilbert_curve_visits_neighbours():
    side = np.arange(16)
    points = np.stack(np.meshgrid(side, side), -1).reshape(-1, 2)
    keys = vectors.hilbert_keys(points, 4)
    assert sorted(keys.tolist()) == list(range(256))
    path = points[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


# --- register sketches ---------------------------------------------------------------------------------------------------


def plain_links(rows, size, percent):
    sets = []
    for _, text in rows:
        words = [w for w in re.split("[\x20\x09-\x0d]+", "".join(c.lower() if c.isascii() else c for c in text or "")) if w]
        width = min(size, len(words))
        sets.append({tuple(words[k : k + width]) for k in range(len(words) - width + 1)} if words else set())
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if rows[i][0] is not None and rows[j][0] is not None and common and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                a, b = sorted((find(i), find(j)))
                top[b] = a
    least = {}
    for i, (doc, _) in enumerate(rows):
        least.setdefault(find(i), []).append(doc)
    low = {k: None if v == [None] else min(v) for k, v in least.items()}
    return sorted(((d, len(sets[i]), low[find(i)], d is None or low[find(i)] == d) for i, (d, _) in enumerate(rows)), key=str)


def near(spark, rows, **more):
    df = spark.createDataFrame([(d, t, "k", 5, "s", 1) for d, t in rows], "doc_id bigint, text string, key string, n int, sketch string, token int")
    return sorted(map(tuple, setsketch.near_duplicates(df, **more).collect()), key=str)


def made_texts():
    rng = np.random.default_rng(11)
    word = lambda: f"w{rng.integers(0, 3000)}"
    base = [[word() for _ in range(int(rng.integers(20, 200)))] for _ in range(6)]
    rows = [(k, " ".join(b)) for k, b in enumerate(base)]
    for k in range(140):
        copy = list(base[k % 6])
        for _ in range(int(rng.integers(0, 6))):
            copy[rng.integers(0, len(copy))] = word()
        rows.append((100 + k, " ".join(copy)))
    return rows + [(400 + k, " ".join(word() for _ in range(30))) for k in range(60)]


def test_near_duplicates_equal_plain_version(spark):
    rows = made_texts()
    assert near(spark, rows) == plain_links(rows, 4, 80)
    assert near(spark, rows, size=5) == plain_links(rows, 5, 80)


def test_large_groups_of_near_copies_meet_in_blocks(spark, monkeypatch):
    """Copies of one text, many too far from it to link, over several blocks a bucket."""
    monkeypatch.setattr(setsketch, "BLOCK", 20)
    rng = np.random.default_rng(8)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(150):
        copy = list(base)
        for at in rng.integers(0, 120, int(rng.integers(1, 9))):
            copy[at] = f"x{rng.integers(0, 10**6)}"
        rows.append((k, " ".join(copy)))
    found = near(spark, rows)
    assert found == plain_links(rows, 4, 80)
    assert 10 < len({r[2] for r in found}) < 150


def test_parities_never_turn_a_similar_pair_away():
    rng = np.random.default_rng(4)
    for _ in range(200):
        n = int(rng.integers(2, 800))
        tokens = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        a, b = tokens[: len(tokens) - len(tokens) // 10], tokens[len(tokens) // 10 :]
        words = [np.frombuffer(setsketch.parities(t), np.uint64)[None] for t in (a, b)]
        common = len(np.intersect1d(a, b))
        if 100 * common >= 80 * len(tokens):
            assert setsketch.can_be_similar(*words, np.array([len(a)]), np.array([len(b)]), 80).all()


def test_near_duplicates_of_odd_texts(spark):
    """Nulls, texts without words, short and very long ones, null ids that come first with a set, repeated rows."""
    long = " ".join(f"x{k}" for k in range(30_000))
    rows = [(9, None), (8, ""), (7, " \t\n"), (6, "One"), (5, "one"), (4, "a b c"), (3, "A B\nC"), (2, long), (12, long + " end"), (None, "lone text of some words here"), (13, "lone text of some words here"), (None, None), (6, "One"), (1, "é É"), (14, "É É")]
    assert near(spark, rows) == plain_links(rows, 4, 80)
    assert near(spark, []) == []


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(5)
    tokens = np.unique(rng.integers(0, 1 << 63, 6000, dtype=np.uint64))
    a, b = tokens[:4000], tokens[1000:5000]
    x, y, both = setsketch.sketches([a, b, np.union1d(a, b)])
    assert (setsketch.merged(x, y) == both).all()
    found = []
    for k in range(60):
        s = np.unique(rng.integers(0, 1 << 63, 1000, dtype=np.uint64))
        x, y = setsketch.sketches([s[:900], s[100:]])
        found.append(setsketch.estimates(x[None], y[None], np.array([900.0]), np.array([len(s) - 100.0]))[0])
    assert abs(np.mean(found) - 0.8) < 0.015
    assert np.std(found) < 0.04
    assert setsketch.estimates(x[None], x[None], np.array([900.0]), np.array([900.0]))[0] > 0.999


def test_shingle_sets_hash_each_word_by_itself():
    import numpy as np
    import xxhash

    from occura.llm import jaccard

    texts = [b"One two  three\tone", b"a", b" \n", None]
    sets = jaccard.shingle_sets(texts, 1)  # nothing is remembered between texts
    step = lambda h: (h ^ (h >> np.uint64(32))) * jaccard._ODD[9]
    of = lambda *words: np.unique(step(np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64) * jaccard._ODD[0]))
    assert [s.tolist() for s in sets] == [of(b"one", b"two", b"three").tolist(), of(b"a").tolist(), [], []]
    assert [len(s) for s in jaccard.shingle_sets(texts, 3)] == [2, 1, 0, 0]
