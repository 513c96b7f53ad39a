"""Operators 2, 3 and 4 and the components they share."""

import hashlib
import random
from functools import cache
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from entrylake.llm import capfilters, shingles, simhash, suffix
from entrylake.llm.common import stored, table
from entrylake.llm.components import components
from helpers import DOCS, ODD_TEXTS, Union, documents, prose


def groups(pairs):
    out = {}
    for node, root in pairs:
        out.setdefault(root, set()).add(node)
    return sorted(map(sorted, out.values()))


@pytest.mark.parametrize("seed", range(3))
def test_components_of_random_links(spark, seed):
    rng = random.Random(seed)
    n = 300
    links = [(rng.randrange(n), rng.randrange(n)) for _ in range((40, 150, 400)[seed])]
    union = Union(n)
    for a, b in links:
        union.join(a, b)
    nodes = {x for a, b in links if a != b for x in (a, b)}
    got = components(spark.createDataFrame(links + links[:5], "a long, b long")).collect()
    assert groups((r.node, r.root) for r in got) == groups((x, union.find(x)) for x in nodes)


def test_components_of_a_chain_and_of_nothing(spark):
    chain = spark.range(0, 400).selectExpr("id as a", "id + 1 as b")
    got = components(chain).collect()
    assert len(got) == 401 and len({r.root for r in got}) == 1
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- embeddings

def plain_links(rows, threshold):
    """rows: (vec_id, vector or None, label); result per row: links, component."""
    def fit(v):
        return v and all(x is not None and np.isfinite(x) for x in v) and any(v)
    union, links = Union(len(rows)), [0] * len(rows)
    for i, (_, a, la) in enumerate(rows):
        for j, (_, b, lb) in enumerate(rows[:i]):
            if la is not None and la == lb and fit(a) and fit(b) and len(a) == len(b):
                x, y = np.array(a, float), np.array(b, float)
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= threshold:
                    links[i] += 1
                    links[j] += 1
                    union.join(i, j)
    least = {}
    for i, (k, _, _) in enumerate(rows):
        least.setdefault(union.find(i), []).append(k)
    return sorted((k, links[i], min(least[union.find(i)])) for i, (k, _, _) in enumerate(rows))


def test_near_vectors_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    rows = []
    for label in (0, 1, None):
        for _ in range(12):
            base = rng.normal(size=16)
            rows += [(base + rng.normal(size=16) * s, label) for s in rng.choice([0.0, 0.03, 0.06, 0.1], size=8)]
    crowd = rng.normal(size=16)
    rows += [(crowd + rng.normal(size=16) * 0.05, 1) for _ in range(150)]
    rows = [(i * 3, [float(x) for x in v], label) for i, (v, label) in enumerate(rows)]
    rows += [(9001, None, 1), (9002, [], 1), (9003, [0.0] * 16, 1), (9004, [float("nan")] * 16, 1), (9005, [None] * 16, 1), (9006, [1.0], 1),
             (9007, [2.0], 1), (9008, [-1.0], 1), (9009, [1e200] * 16, 1), (9010, [1e200] * 16, 1), (9011, [float("inf")] * 16, 1)]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, cid string, n long")
    want = plain_links(rows[:-3], 0.98) + [(9009, 1, 9009), (9010, 1, 9009), (9011, 0, 9011)]
    for block in (256, 20):
        got = capfilters.near_vectors(frame, block=block).collect()
        assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == want
        assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_near_vectors_repeated_rows_and_none(spark):
    schema = "vec_id long, embedding array<float>, label int"
    rows = [(5, [1.0, 0.0], 1), (5, [1.0, 0.0], 1), (7, [2.0, 0.0], 1), (None, [1.0, 0.0], 1), (8, [1.0, 0.0], 2)]
    got = capfilters.near_vectors(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.vec_id or -1, r.n_links, r.component_id) for r in got) == [(-1, 3, 5), (5, 3, 5), (5, 3, 5), (7, 3, 5), (8, 0, 8)]
    assert capfilters.near_vectors(spark.createDataFrame([], schema)).count() == 0


def test_filters_miss_no_link_of_the_table(spark, small):
    rows = [(r.vec_id, list(r.embedding), r.label) for r in table(spark, small, "embeddings").collect()]
    rng = np.random.default_rng(1)
    rows += [(10_000 + i, list(np.array(v) + rng.normal(size=len(v)) * 0.015), label) for i, (_, v, label) in enumerate(rows[:150])]
    rows = [(k, [float(x) for x in v], label) for k, v, label in rows]
    got = capfilters.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    want = plain_links(rows, 0.98)
    assert sum(n for _, n, _ in want) >= 300
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == want


# --- SimHash

def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_fingerprints_and_components(spark):
    base = [prose(i, 400) for i in range(6)]
    rows = [(i * 10, t) for i, t in enumerate(base)]
    rng = random.Random(4)
    for i, t in enumerate(base * 6):
        words = t.split()
        words[rng.randrange(len(words))] = "CHANGED"
        rows.append((100 + i, " ".join(words)))
    rows += [(500 + i, t) for i, t in enumerate(ODD_TEXTS)] + [(600, ""), (601, base[0].upper()), (0, base[0]), (None, base[1])]
    prints = [plain_fingerprint(t) for _, t in rows]
    union = Union(len(rows))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                union.join(i, j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[union.find(i)] = min(k, least.get(union.find(i), k))
    want = sorted((k if k is not None else -1, f"{prints[i]:016x}", least[union.find(i)]) for i, (k, _) in enumerate(rows))
    got = simhash.simhash_dedup(documents(spark, rows)).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.fingerprint, r.component_id) for r in got) == want
    kept = simhash.keep_one(documents(spark, rows)).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(least.values()))


@cache
def five_words(text):
    words = text.lower().split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_similarity(a, b):
    a, b = five_words(a), five_words(b)
    return len(a & b) / len(a | b) if a or b else 1.0


@pytest.mark.parametrize("crowd", [64, 8, 2])
def test_near_copies_by_five_word_shingles(spark, crowd):
    """Texts with some words changed all over are found by the stage, whatever their fingerprints differ in; less similar ones stay."""
    rng = random.Random(7)
    texts = []
    for i in range(30):
        base = prose(1000 + i, rng.choice([12, 60, 300, 900]))
        texts.append(base)
        for share in (0.002, 0.015, 0.02, 0.03, 0.05) * (2 if i else 10):
            texts.append(" ".join("CHANGED" + str(rng.random()) if rng.random() < share else w for w in base.split()))
    texts += [t for t in ODD_TEXTS] + ["", "x", "X", texts[5].upper()]
    texts = [t or "" for t in texts]
    order = [*range(len(texts))]
    rng.shuffle(order)
    rows = [(i * 3, texts[k]) for i, k in enumerate(order)]
    union = Union(len(rows))
    near = [[plain_similarity(a, b) >= 0.8 for _, b in rows] for _, a in rows]
    for i in range(len(rows)):
        for j in range(i):
            if near[i][j]:
                union.join(i, j)
    assert sum((simhash.fingerprint(rows[i][1].encode()) ^ simhash.fingerprint(rows[j][1].encode())).bit_count() > 3
               for i in range(len(rows)) for j in range(i) if near[i][j]) > 100
    got = [r.doc_id for r in shingles.keep_one(documents(spark, rows), max_crowd=crowd).collect()]
    assert sorted(got) == sorted({3 * union.find(i) for i in range(len(rows))})
    if crowd == 64:
        staged = corpus_pipeline.drop_near_copies(spark, documents(spark, rows + [(None, rows[0][1]), (0, rows[0][1])]), "")
        assert sorted(r.doc_id for r in staged.collect()) == sorted(got)
        assert shingles.keep_one(documents(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("seed", [1])
def test_no_link_is_lost_in_crowded_bands(spark, seed):
    """Many variants of a few texts, near to each other through others only: the same texts stay, however few classes make a crowd."""
    rng = random.Random(seed)
    texts = []
    for i in range(8):
        base = prose(2000 + 10 * seed + i, 120).split()
        texts += [" ".join(f"z{rng.randrange(10**6)}" if rng.random() < 0.017 else w for w in base) for _ in range(25)]
    rng.shuffle(texts)
    rows = [*enumerate(texts)]
    union = Union(len(rows))
    for i in range(len(rows)):
        for j in range(i):
            if plain_similarity(texts[i], texts[j]) >= 0.8:
                union.join(i, j)
    want = sorted({union.find(i) for i in range(len(rows))})
    assert 8 < len(want) < 150
    for crowd in (2, 64):
        assert sorted(r.doc_id for r in shingles.keep_one(documents(spark, rows), max_crowd=crowd).collect()) == want


def variants(seed, n, words=150, most=16):
    """A text and versions of it with 0 to ``most`` words replaced; most of them are near to few others."""
    rng = random.Random(seed)
    base = prose(seed, words).split()
    out = []
    for _ in range(n):
        made = base[:]
        for at in rng.sample(range(words), rng.randint(0, most)):
            made[at] = f"z{rng.randrange(10**6)}"
        out.append(" ".join(made))
    return out


def test_few_pairs_of_a_group_of_variants_are_measured(spark, monkeypatch):
    """Of a group whose classes share bands, but are hardly near, few pairs are measured, not all; the same texts stay."""
    measured = []

    def noted(df, purpose):
        made = stored(df, purpose)
        if purpose == "measured":
            measured.append(made.count())
        return made
    monkeypatch.setattr(shingles, "stored", noted)
    n = 600
    rows = [*enumerate(variants(31, n))]
    sets = [five_words(t) for _, t in rows]
    union = Union(n)
    for i in range(n):
        for j in range(i):
            if 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j])):
                union.join(i, j)
    want = sorted({union.find(i) for i in range(n)})
    assert n / 3 < len(want) < n
    assert sorted(r.doc_id for r in shingles.keep_one(documents(spark, rows), max_crowd=8).collect()) == want
    assert sum(measured) < 16 * n


@pytest.mark.parametrize("counted", [1 << 18, 50])
def test_near_sets_share_a_rare_shingle(spark, counted, monkeypatch):
    """Every near pair of a crowd shares a list within the places that their sizes leave, however the shingles are dealt for counting."""
    monkeypatch.setattr(shingles, "_COUNTED", counted)
    made = {i: shingles.shingles(t.encode()).view(np.int64).tolist() for i, t in enumerate(
        [*variants(5, 40, 60, 6), *[" ".join(t.split()[:n]) for n, t in zip(range(48, 60), variants(5, 12, 60, 2))]])}
    sets = spark.createDataFrame(list(made.items()), "cls long, members array<long>")
    crowd = spark.createDataFrame([(i, len(m), 0 if i % 2 else min(map(len, made.values()))) for i, m in made.items()], "cls long, size int, smallest int")
    times = Counter(s for m in made.values() for s in m)
    lists = {(r.cls, r.list): r.place for r in shingles.rare_shingles(crowd, sets).collect()}
    for i, m in made.items():
        for place, s in enumerate(sorted(m, key=lambda s: (times[s], s))):
            assert lists.get((i, s), place) == place and (times[s] > 1 or (i, s) not in lists)
    near = 0
    for i, a in made.items():
        for j in range(i):
            b = made[j]
            if 9 * len(set(a) & set(b)) >= 4 * (len(a) + len(b)):
                need, near = -(-4 * (len(a) + len(b)) // 9), near + 1
                assert any((j, s) in lists and min(len(a) - lists[i, s], len(b) - lists[j, s]) >= need for s in a if (i, s) in lists)
    assert near > 30


def test_sets_are_stored_for_candidates_only(spark, monkeypatch):
    """What the stage stores of texts that resemble no other is small beside the texts; that of near copies, copies and repeated rows is still compared."""
    sizes = {}

    def noted(df, purpose):
        made = stored(df, purpose)
        sizes[made._stored_at] = sum(p.stat().st_size for p in Path(made._stored_at.removeprefix("file:")).rglob("*.parquet"))
        return made
    monkeypatch.setattr(shingles, "stored", noted)
    texts = [prose(5000 + i, 3000) for i in range(100)]
    near = [" ".join([*t.split()[:-5], "other", "words"]) for t in texts[:3]]
    rows = [*enumerate(texts + near + texts[3:5]), (None, texts[6]), (7, texts[7]), (7, texts[7]), (200, None), (201, " ")]
    got = [r.doc_id for r in shingles.keep_one(documents(spark, rows)).collect()]
    assert sorted(got) == [*range(100), 200]
    assert 0 < sum(sizes.values()) < sum(map(len, texts)) / 2


def test_majority_is_that_of_the_fingerprint():
    for text in ("a b c d e f g", "x", "one two three four five six seven eight"):
        words = text.encode().split()
        h = [xxhash.xxh64_intdigest(b" ".join(words[i:i + 3]), 42) for i in range(max(1, len(words) - 2))]
        assert simhash.majority(np.array(h, np.uint64)) == simhash.fingerprint(text.encode())
    assert simhash.majority(np.zeros(0, np.uint64)) == 0


def test_long_text_equals_short_steps(monkeypatch):
    text = prose(9, 900).encode()
    want = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "_SHINGLES_AT_ONCE", 7)
    assert simhash.fingerprint(text) == want == (plain_fingerprint(text.decode()) + 2 ** 63) % 2 ** 64 - 2 ** 63


@pytest.mark.parametrize("crowd", [1, 4, 64])
def test_crowded_lists_connect_the_same(spark, crowd):
    rng = random.Random(crowd)
    values = {rng.getrandbits(64) for _ in range(40)}
    for centre in list(values)[:8]:
        for _ in range(60):
            for _ in range(2):
                centre ^= 1 << rng.randrange(64)
            values.add(centre)
    fps = sorted(v - 2 ** 64 if v >> 63 else v for v in values)
    union = Union(len(fps))
    for i, a in enumerate(fps):
        for j in range(i):
            if ((a ^ fps[j]) & (2 ** 64 - 1)).bit_count() <= 3:
                union.join(i, j)
    want = [g for g in groups((fps[i], union.find(i)) for i in range(len(fps))) if len(g) > 1]
    got = components(simhash.near_pairs(spark.createDataFrame([(f,) for f in fps], "fp long"), crowd)).collect()
    assert groups((r.node, r.root) for r in got) == want


def test_large_set_of_24_bits():
    rng = np.random.default_rng(2)
    values = np.unique(np.r_[rng.integers(0, 1 << 24, 2500), rng.integers(0, 1 << 9, 400)])
    assert len(values) > 2048
    union = Union(len(values))
    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(values[i] ^ values[:i]) <= 3):
            union.join(i, int(j))
    assert simhash.connect_24_bits(values).tolist() == [union.find(i) for i in range(len(values))]


# --- suffixes

def plain_repeats(rows, width):
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(d[i:i + width] for d in data for i in range(len(d) - width + 1))
    out = []
    for (k, _), d in zip(rows, data):
        gone = bytearray(len(d))
        for i in range(len(d) - width + 1):
            if seen[d[i:i + width]] > 1:
                gone[i:i + width] = b"\1" * width
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        kept = bytes(c for c, g in zip(d, gone) if not g)
        out.append((k if k is not None else -1, len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def passages():
    shared = [prose(50 + i, 60) for i in range(4)]
    rows = []
    for i in range(40):
        rng = random.Random(i)
        cut = rng.randrange(60)
        rows.append((i, " ".join([prose(i, 30), shared[i % 4][cut:cut + 200], prose(i + 99, 20), shared[(i + 1) % 4]])))
    rows += [(100, "ab" * 400), (101, "q" + "ab" * 300), (102, "line of words\n" * 60), (None, rows[3][1]), (3, rows[3][1]), (3, rows[3][1])]
    return rows + [(200 + i, t) for i, t in enumerate(ODD_TEXTS)] + [(300, "é" * 699 + "è")]


@pytest.mark.parametrize(("width", "gram", "block"), [(100, 40, 1 << 20), (100, 40, 1500), (64, 8, 1 << 20), (400, 128, 1 << 20)])
def test_repeats_against_counting_windows(spark, width, gram, block, monkeypatch):
    rows = passages()
    monkeypatch.setattr(suffix.with_spans, "__defaults__", (400, gram, block))
    got = suffix.dedup_digest(documents(spark, rows), width).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, *r[1:]) for r in got) == plain_repeats(rows, width)


def test_repeats_of_nothing(spark):
    assert suffix.dedup_digest(spark.createDataFrame([], DOCS)).count() == 0
    one = suffix.dedup_digest(documents(spark, [(1, "x" * 399), (2, "x" * 399)])).collect()
    assert [r.n_removed for r in one] == [0, 0]


def test_segments_do_not_matter(monkeypatch):
    text = (prose(1, 300) + prose(2, 100) + prose(1, 300)).encode()
    def starts():
        return sorted((int(lo), int(n * times)) for _, a, r, lo, n, times in suffix.regions([text], 100, 40) for lo, n, times in zip(lo, n, times) if times)
    whole = starts()
    monkeypatch.setattr(suffix, "SEGMENT", 700)
    parts = starts()
    assert sum(n for _, n in whole) == sum(n for _, n in parts) == len(text) - 99 and len(parts) > len(whole)


def test_longest_match_streamed_from_run_ends():
    rng = random.Random(6)
    for _ in range(30):
        parts = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 40))).encode() for _ in range(rng.randint(1, 6))]
        parts += parts[:2]
        longest, first = suffix.longest_elsewhere(parts, 64)
        subs = Counter(p[i:j] for p in parts for i in range(len(p)) for j in range(i + 1, len(p) + 1))
        for p, at in zip(parts, first):
            want = [max([j - i for j in range(i + 1, len(p) + 1) if subs[p[i:j]] > 1], default=0) for i in range(len(p))]
            assert longest[at:at + len(p)].tolist() == want


def test_removed_text_stays_valid(spark):
    tail = "Ã" * 210  # C3 83 ...
    rows = [(1, "a" + tail + "b"), (2, "cé" + tail + "d"), (3, None), (4, "short")]
    out = {r.doc_id: r for r in suffix.remove_repeats(documents(spark, rows)).collect()}
    assert out[1].text == "ab" and out[2].text == "céd" and out[3].text is None and out[4].text == "short"
    assert out[1].n_chars == 2 and out[1].fits == 2


def test_stage_cuts_repeats_of_more_than_fifty_words(spark):
    """Repeated runs of 51 short words go in the stage, those of 50 stay, and so do two shorter ones side by side."""
    def run(seed, n):
        return " ".join(f"{seed}{chr(97 + i % 26)}{i // 26}" for i in range(n))
    a, b, c, d = run("p", 51), run("q", 50), run("r", 30), run("s", 30)
    rows = [(1, f"one {a} two"), (2, f"three\n{a.replace(' ', chr(10))} é"), (3, f"é {b} four"), (4, f"five {b} six"), (5, f"{c} {d}"),
            (6, f"{c} x"), (7, f"y {d}"), (8, "Ã" * 210 + "b"), (9, "c" + "Ã" * 210), (10, None), (11, " "), (12, a)]
    out = {r.doc_id: r for r in corpus_pipeline.cut_repeats(spark, documents(spark, rows), "").collect()}
    want = {**dict(rows), 1: "one  two", 2: "three\n é", 8: "b", 9: "c", 12: ""}
    assert {i: r.text for i, r in out.items()} == want
    assert all(r.n_chars == len(r.text) for r in out.values() if r.text is not None)
    assert len(a.encode()) < 400


@pytest.mark.parametrize("seed", range(30))
def test_sparse_windows_by_definition(seed):
    rng = random.Random(seed)
    data = "".join(rng.choice("ab \n" if seed % 2 else "abcdef ") for _ in range(rng.randint(0, 120))).encode()
    for width, words in ((20, 2), (20, 4), (30, 5)):
        def full(window):
            inner = [w for w in window.replace(b"\n", b" ").split(b" ")][1:-1]
            return sum(bool(w) for w in inner)
        want = any(full(data[i:i + width]) <= words for i in range(len(data) - width + 1))
        assert suffix.has_sparse_window(data, width, words) == want or not want
