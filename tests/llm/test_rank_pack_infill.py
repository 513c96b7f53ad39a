"""Operators 11, 12 and 13."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import count

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from entrylake.llm import differencing, infill, queries, ranked
from entrylake.llm.common import table
from helpers import DOCS, ODD_TEXTS, documents, prose

MORE = ["n int", "rank string", "score string", "ids int", "output string", "restored int", "form int", "codes int", "offset int"]


def clashing(spark, rows):
    """Rows (doc_id, text) with columns of names that the operators use."""
    return spark.createDataFrame([(*r, *[None] * len(MORE)) for r in rows], "doc_id long, text string, " + ", ".join(MORE))


# --- differencing

def plain_difference(sizes, k):
    """Windows of the definition: all partitions have k windows, the two of largest imbalance are merged."""
    serial = count()
    parts = [(s, next(serial), [s] + [0] * (k - 1)) for s in sizes]
    while len(parts) > 1:
        parts.sort(key=lambda p: (-p[0], p[1]))
        (_, _, a), (_, _, b), *parts = parts
        made = [x + y for x, y in zip(sorted(a), sorted(b, reverse=True))]
        parts.append((max(made) - min(made), next(serial), made))
    return sorted(parts[0][2])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 10**9), min_size=1, max_size=60, unique=True), st.integers(1, 12))
def test_differencing_is_that_of_the_definition(sizes, k):
    serial = count()
    got = differencing.difference([[(s, next(serial), (i, 0, s))] for i, s in enumerate(sizes)], k, serial)
    assert [0] * (k - len(got)) + [w[0] for w in got] == plain_difference(sizes, k)
    assert sorted(p[0] for w in got for p in differencing.pieces(w[2])) == list(range(len(sizes)))


def test_differencing_is_near_equal():
    rng = random.Random(4)
    sizes = [rng.randint(1, 500) for _ in range(3000)]
    serial = count()
    windows = differencing.difference([[(s, next(serial), (i, 0, s))] for i, s in enumerate(sizes)], 100, serial)
    assert windows[-1][0] - windows[0][0] <= 3


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=80), st.integers(1, 64))
def test_windows_hold_every_token_once(sizes, capacity):
    windows = differencing.balanced(sizes, capacity)
    assert all(0 < sum(e - s for _, s, e in w) <= capacity for w in windows)
    seen = Counter((i, t) for w in windows for i, s, e in w for t in range(s, e))
    assert seen == Counter((i, t) for i, n in enumerate(sizes) for t in range(n))
    assert len(windows) <= -(-sum(sizes) // capacity) + 4


def test_equal_sizes_and_one_that_fills_all():
    assert [len(w) for w in differencing.balanced([2048] * 5)] == [1] * 5
    sums = [sum(e - s for _, s, e in w) for w in differencing.balanced([1500] * 40)]
    assert max(sums) <= 2048 and 30 <= len(sums) <= 31
    assert differencing.balanced([]) == []


def check_packing(rows, texts, capacity=2048):
    """Every id in one piece, sequences without gaps."""
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    ids = {key: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for key, t in texts.items()}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert set(by_doc) == set(ids)
    for key, found in by_doc.items():
        at = 0
        for r in sorted(found, key=lambda r: r["start"]):
            assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == len(ids[key])
            at += r["length"]
            assert r["ids_crc32"] == zlib.crc32(ids[key][r["start"]:at].tobytes())
        assert at == len(ids[key])
    for found in by_sequence.values():
        at = 0
        for r in sorted(found, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    tokens = sum(map(len, ids.values()))
    return len(by_sequence), tokens


def test_packing_of_a_table(spark, small):
    docs = table(spark, small, "documents")
    rows = queries.op11_differencing_packing(spark, small).collect()
    n, tokens = check_packing(rows, {r.doc_id: r.text for r in docs.collect()})
    assert n * 2048 - tokens <= 0.03 * tokens  # this table is one group
    assert {tuple(r) for r in rows} == {tuple(r) for r in queries.op11_differencing_packing(spark, small).collect()}


def test_packing_of_odd_texts(spark):
    rows = [(i, t) for i, t in enumerate(ODD_TEXTS)] + [(100, prose(1, 9000)), (101, "idiot " * 2047), (102, "idiot " * 2048), (103, "idiot " * 4095)]
    got = differencing.pack_digest(clashing(spark, rows), queries.vocabulary()).collect()
    check_packing([r.asDict() for r in got], dict(rows))
    twice = differencing.pack_digest(documents(spark, [(1, "a b"), (1, "a b"), (None, "c")]).coalesce(1), queries.vocabulary()).collect()
    assert sorted((r.doc_id or 0, r.length, r.doc_tokens) for r in twice) == [(0, 2, 2), (1, 3, 3), (1, 3, 3)]
    assert len({r.sequence_id for r in twice}) == 1 and sorted(r.offset for r in twice)[0] == 0
    assert differencing.pack_digest(spark.createDataFrame([], DOCS), queries.vocabulary()).count() == 0


def test_packing_in_groups(spark):
    """Small groups and sequences; the operator gives the ids themselves."""
    rows = [(i, prose(i, 5 + 7 * i % 90)) for i in range(150)]
    got = differencing.pack(documents(spark, rows), queries.vocabulary(), capacity=64, group=500).collect()
    check_packing([{**r.asDict(), "ids_crc32": zlib.crc32(r.ids)} for r in got], dict(rows), 64)
    assert all(len(r.ids) == 4 * r.length for r in got)


# --- ranked search

def plain_rank(items, docs, k=10):
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    lower = str.maketrans({c: chr(c + 32) for c in range(65, 91)})

    def terms(t):
        return Counter(w.translate(lower) for w in term.findall(t or ""))
    bags = [(i, terms(t)) for i, t in docs]
    N, L = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(w for _, b in bags for w in b)
    out = []
    for item, text in items:
        wanted, scored = terms(text), []
        for doc, bag in bags:
            if not bag:
                continue
            m = 100 - 75 + (75 * sum(bag.values()) * N) // L
            score = sum(q * math.floor(1000 * math.log((2 * N + 2) / (2 * df[w] + 1))) * ((10**9 * bag[w]) // (1000 * bag[w] + 8 * m))
                        for w, q in wanted.items() if w in bag)
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, r, doc, -s) for r, (s, _, _, doc) in enumerate(sorted(scored)[:k], 1)]
    return out


def ranks(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def test_search_against_plain_version(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(120)] + ["É", "straße", "ſ", "K", "a-b"]
    docs = [(i, " ".join(rng.choices(words, range(len(words), 0, -1), k=rng.randint(0, 60)))) for i in range(400)]
    docs += [(1000 + i, t) for i, t in enumerate(ODD_TEXTS)] + [(7, docs[3][1]), (7, docs[3][1]), (None, docs[3][1]), (2000, "w5 " * 50_000)]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(1, 40)))) for i in range(30)]
    items += [(100, None), (101, ""), (102, " -- "), (103, "unseen"), (104, "w1 W1 w1"), (105, " ".join(words * 2)), (5, items[5][1]), (None, "w2")]
    given_docs = clashing(spark, docs).repartition(7)
    given_items = spark.createDataFrame([(*i, 1, "x") for i in items], "item_id long, text string, rank int, doc_id string")
    want = sorted(plain_rank(items, docs), key=str)
    assert ranks(ranked.rank(given_items, given_docs)) == want
    assert ranks(ranked.rank(given_items, given_docs, item_bytes=300)) == want  # many blocks of items
    assert ranks(ranked.rank(given_items, given_docs, k=1)) == sorted(plain_rank(items, docs, 1), key=str)


def test_search_of_empty_tables(spark):
    none, docs = spark.createDataFrame([], DOCS), documents(spark, [(1, "a")])
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert ranks(ranked.rank(items, none)) == [] and ranks(ranked.rank(items.limit(0), docs)) == []
    assert ranks(ranked.rank(items, documents(spark, [(1, None), (2, ""), (3, "--")]))) == []
    assert ranks(ranked.rank(items, docs)) == sorted(plain_rank([(1, "a b")], [(1, "a")]), key=str)


def test_few_documents_are_evaluated(spark, monkeypatch):
    """Groups whose bound is below the tenth best score are left out."""
    seen = []
    plain = ranked.Documents.scores
    monkeypatch.setattr(ranked.Documents, "scores", lambda self, some, weight: seen.append(len(some)) or plain(self, some, weight))
    rng = random.Random(1)
    docs = [(i, " ".join(rng.choices([f"w{j}" for j in range(200)], k=30))) for i in range(3000)]
    for i in range(10):
        docs[i] = (i, "rare words of one item " + docs[i][1])
    item = "rare words of one item w1 w2"
    vocabulary = {t: i for i, t in enumerate(dict.fromkeys(ranked.terms(item.encode())))}
    made = ranked.postings(documents(spark, docs), vocabulary).coalesce(1).toArrow().combine_chunks().to_batches()
    df = ranked.document_frequencies(ranked.postings(documents(spark, docs), vocabulary), len(vocabulary))
    weight = np.array([math.floor(1000 * math.log((2 * 3000 + 2) / (2 * int(x) + 1))) for x in df])
    total = sum(len(ranked.terms(t.encode())) for _, t in docs)
    best = ranked.Best(10)
    for batch in made:
        block = ranked.Documents(batch, 3000, total, len(weight))
        codes = np.arange(len(weight))
        block.search(codes, weight, best)
    assert [r[2] for r in sorted(best.rows, key=lambda r: r[2])] == list(range(10))
    assert sum(seen) <= 300


# --- fill in the middle

def plain_infill(doc_id, text):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i:i + 8], 16) for i in (0, 8, 16, 24))
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 100:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 50:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


LINES = [None, "", "\n", "\n\n\n", "a", "a\n", "a\nb", "\na", "é\nß\U0001f44d\n", "<P>\nx", "x<S>y\nz", "<M>", "<\nS>\n<P", "<<P\n<<S\n>M>\n", "\r\n\x0b\x85 x\n"]


def test_infill_against_plain_version(spark):
    rng = random.Random(6)
    rows = [(i, "".join(rng.choice("ab<\n\nPSM>é") for _ in range(rng.randint(0, 60)))) for i in range(300)]
    rows += [(1000 + i, t) for i, t in enumerate([*LINES, *ODD_TEXTS])] + [(None, "p\nq\nr"), (3, rows[3][1]), (-5, "k\nl"), (9999, "line\n" * 300_000)]
    got = infill.restore(infill.rearrange(clashing(spark, rows).repartition(6))).collect()
    assert len(got) == len(rows)
    assert Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored) for r in got) == \
        Counter((i, *plain_infill(i, t), t or "") for i, t in rows)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert infill.infill_digest(spark.createDataFrame([], DOCS)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<PSM>a\n\r ", max_size=40), st.integers(-2**63, 2**63 - 1))
def test_infill_is_read_back(text, doc_id):
    made = infill.Cutter()(doc_id, text)
    assert infill.restored(made.output, made.form) == text


def test_infill_rates_and_units():
    plain = infill.Cutter(rate=0)
    assert {plain(i, "a\nb").form for i in range(50)} == {"plain"}
    half = [infill.Cutter(rate=50)(i, "a\nb").form for i in range(400)]
    assert 150 < half.count("plain") < 250
    words = infill.Cutter(unit=r"\s*\S+|\s+$", suffix_first=0)
    assert words.ends(" ab  c d ") == [3, 6, 8, 9] and {words(i, "a b c").form for i in range(20)} == {"psm"}
    with pytest.raises(ValueError):
        infill.Cutter(unit="a")(1, "b")
