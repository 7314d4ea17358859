"""Ops 11, 12 and 13 against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import WORDS, text
from pyspark.sql import functions as F

import regframe.llm.ranked_search as ranked_search
import regframe.llm.spelling as spelling
from regframe.llm.order_minhash import (DRAWS, edited_text, fingerprint_of, fingerprints, kmer_hashes, likeness,
                                        likeness_of, neighbours_compared, occurrence_numbers)
from regframe.llm.ranked_search import rank_documents
from regframe.llm.spelling import SYMBOLS, near_words, neighbour_keys, own_keys, spelling_variants, vocabulary_counts


# --- ranked search --------------------------------------------------------

def _terms(body):
    body = re.sub("[A-Z]", lambda m: m.group().lower(), body or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", body)


def plain_ranking(docs, items, k):
    counts = [(i, Counter(_terms(body))) for i, body in docs]
    counts = [(i, c, sum(c.values())) for i, c in counts if c]
    n_all, total = len(counts), sum(n for _, _, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    wanted = defaultdict(set)
    for item, body in items:
        wanted[item] |= set(_terms(body))
    out = set()
    for item, terms in wanted.items():
        found = []
        for at, (i, c, n) in enumerate(counts):
            m = 50 + (50 * n * n_all) // total
            s = sum(math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) * ((10 ** 9 * c[t]) // (1000 * c[t] + 20 * m))
                    for t in terms if t in c)
            if s > 0:
                found.append((-s, i is None, i or 0, at))
        for rank, (s, _, _, at) in enumerate(sorted(found)[:k], 1):
            out.add((item, rank, counts[at][0], -s))
    return out


def _search_rows(rng, n):
    docs = [(i * 7 % n, text(rng, 1 + i % 4, 9).upper() if i % 3 else text(rng, 2, 30)) for i in range(n)]
    docs += [(i + n, docs[i][1]) for i in range(0, n, 9)]                       # ties: equal texts
    docs += [(3, docs[5][1]), (3, docs[5][1]), (None, docs[5][1]), (n * 2, None), (n * 2 + 1, ""), (n * 2 + 2, "?! ...")]
    docs += [(n * 2 + 3, "Ñandú-ñandú kabar 日本 ½x_y " + "loden " * 5000), (n * 2 + 4, "kabar " * 30_000)]
    items = [(1, "kabar loden, Ñandú ñANDÚ"), (2, text(rng, 1, 30)), (3, "日本 x"), (4, None), (5, ""), (6, "unseenword"),
             (7, " ".join(WORDS)), (None, "mibar minat"), (2, "rusos " + WORDS[3]), (8, docs[5][1])]
    return docs, items


@pytest.mark.parametrize("block, wave", [(4096, 1 << 20), (16, 1 << 20), (16, 12)])
def test_ranked_search_equals_all_documents_scored(spark, monkeypatch, block, wave):
    monkeypatch.setattr(ranked_search, "BLOCK", block)
    monkeypatch.setattr(ranked_search, "WAVE_TERMS", wave)
    monkeypatch.setattr(ranked_search, "PART", 3)
    docs, items = _search_rows(random.Random(4), 150)
    d = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, item_id int, score string").repartition(5)
    q = spark.createDataFrame([(*r, 0.5) for r in items], "item_id long, text string, rank double").repartition(2)
    got = [tuple(r) for r in rank_documents(d, q, k=7).collect()]
    assert len(got) == len(set(r[:2] for r in got)) and set(got) == plain_ranking(docs, items, 7)


def test_ranked_search_blocks_split_by_postings(spark, monkeypatch):
    monkeypatch.setattr(ranked_search, "BLOCK_POSTINGS", 40)
    docs, items = _search_rows(random.Random(5), 60)
    got = rank_documents(spark.createDataFrame(docs, "doc_id long, text string"),
                         spark.createDataFrame(items, "item_id long, text string"), k=50)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert {tuple(r) for r in got.collect()} == plain_ranking(docs, items, 50)


def test_ranked_search_of_empty_tables_and_text_ids(spark, no_docs):
    none = spark.createDataFrame([], "item_id string, text string")
    docs = spark.createDataFrame([("b", "kabar"), ("a", "kabar"), ("c", "loden")], "doc_id string, text string")
    items = spark.createDataFrame([("q", "kabar")], "item_id string, text string")
    assert rank_documents(docs, none).count() == 0 and rank_documents(no_docs, items).count() == 0
    assert rank_documents(no_docs, none).count() == 0
    assert [r.doc_id for r in rank_documents(docs, items).orderBy("rank").collect()] == ["a", "b"]


# --- spelling variants ----------------------------------------------------

def plain_words(docs):
    out = Counter()
    for i, body in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", body or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) >= len(b)):] == b[i + (len(b) >= len(a)):]


def plain_variants(words):
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, some in near.items():
        best = min(some, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return out


def _reduced(word):
    return spelling._SYMBOL[np.frombuffer(word.encode("latin-1"), np.uint8)][None, :]


@pytest.mark.parametrize("word", ["a", "aaaaa", "kabar", "straßenbahn", "ab" * 9, "abcdefghijklmnopqrst", "é" * 21, "x" * 19 + "yz",
                                  "mississippi" * 4])
def test_neighbourhoods_hold_every_neighbour_once(word, monkeypatch):
    def key(form):
        return int(own_keys(np.array([form], np.uint64))[0])

    form = tuple(int(s) for s in _reduced(word)[0])
    want = {form} | {form[:i] + form[i + 1:] for i in range(len(form))}
    for i in range(len(form) + 1):
        for s in range(SYMBOLS):
            want |= {form[:i] + (s,) + form[i:], form[:i] + (s,) + form[i + 1:]}
    want.discard(())
    for cells in (1 << 18, 7):
        monkeypatch.setattr(spelling, "_CELLS", cells)
        got = [int(k) for _, keys in neighbour_keys(_reduced(word)) for k in keys]
        assert len(got) == len(set(got)) and set(got) == {key(f) for f in want}


def _misspelt(rng, n):
    docs = []
    for i in range(n):
        words = []
        for _ in range(25):
            w = rng.choice(WORDS[:40]) + rng.choice(["", "a", "ß", "É"])
            if rng.random() < 0.3:
                at = rng.randrange(len(w))
                w = rng.choice([w[:at] + w[at + 1:], w[:at] + rng.choice("aeéz") + w[at + 1:], w[:at] + rng.choice("aeéz") + w[at:]])
            words.append(w.upper() if rng.random() < 0.1 else w)
        docs.append((i, rng.choice([" ", ", ", "×", "1", "日"]).join(words)))
    return docs + [(n, None), (n + 1, ""), (None, "kabara kabara kabara kabbara"), (0, docs[0][1]), (0, docs[0][1]),
                   (n + 2, "z" * 30_000 + " " + "z" * 30_001 + " " + "z" * 29_999 + "y"), (n + 3, ("q" * 25 + " ") * 4 + ("q" * 26 + " ") * 9),
                   (n + 4, ("z" * 30_000 + " ") * 3), (n + 5, ("z" * 30_001 + " ") * 7),
                   (n + 6, "linkaa " * 3 + "linkab " * 6 + "linkbb " * 12 + "linkbbx " * 30)]


@pytest.mark.parametrize("bits", [1 << 26, 1 << 16])
def test_spelling_variants_equal_all_pairs_compared(spark, monkeypatch, bits):
    monkeypatch.setattr(spelling, "MAX_BITS", bits)
    monkeypatch.setattr(spelling, "_FLUSH", 100)
    docs = _misspelt(random.Random(8), 150)
    words = plain_words(docs)
    want = plain_variants(words)
    assert any(w[1] for w in want) and any(w[2] not in (w[0], w[1]) for w in want) and any(len(w) > 20 for w in words)
    df = spark.createDataFrame([(*r, "k", 1) for r in docs], "doc_id long, text string, word string, n int").repartition(3)
    got = spelling_variants(df)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(want) and set(rows) == want


def test_spelling_of_empty_and_odd_tables(spark, no_docs, odd_docs):
    assert spelling_variants(no_docs).count() == 0
    rows = {r.word: r for r in spelling_variants(odd_docs).collect()}
    assert rows["alpha"].n == 3 and rows["words"].n > 39_000 and rows["alpha"].root == "alpha"


def test_near_words_of_a_dense_group(spark):
    """Words that share most reduced forms: every pair one edit apart, none lost."""
    words = [f"{a}{b}{c}bar" for a in "aeiou" for b in "aeiou" for c in "aeiou"]
    got = near_words(spark.createDataFrame([(w, i) for i, w in enumerate(words)], "word string, n long"))
    assert {(r.word, r.near) for r in got.collect()} == {(a, b) for a in words for b in words if one_edit(a, b)}


# --- fingerprints ---------------------------------------------------------

def test_kmers_and_occurrences_equal_plain_ones():
    rng = random.Random(2)
    body = "".join(rng.choice("ab😀") for _ in range(3000))
    for k in (1, 2, 5, 12, 13):
        h = kmer_hashes(body, k)
        named = {}
        for i in range(len(body) - k + 1):
            assert named.setdefault(body[i:i + k], h[i]) == h[i]
        assert len(set(named.values())) == len(named)
    h, seen = kmer_hashes(body, 5), Counter()
    for i, number in enumerate(occurrence_numbers(h)):
        assert number == seen[body[i:i + 5]]
        seen[body[i:i + 5]] += 1


def test_fingerprints_follow_order_and_edits():
    rng = random.Random(3)
    parts = [text(rng, 1, 40) for _ in range(8)]
    whole = " ".join(parts)
    swapped = " ".join(parts[4:] + parts[:4])
    one = whole[:500] + "X" + whole[501:]
    other = text(rng, 8, 40)
    assert fingerprint_of(whole) == fingerprint_of(whole) and len(fingerprint_of("")) == 4 * DRAWS
    likes = [likeness_of(fingerprint_of(whole), fingerprint_of(t)) for t in (whole, one, swapped, other)]
    assert likes[0] == 1.0 and likes[0] > likes[1] > 0.8 > likes[2] > likes[3] and likes[3] < 0.05
    assert likes[2] < 0.75  # the same k-mers in another order are not the same text
    assert likeness_of(fingerprint_of(""), fingerprint_of("")) == 1.0 > likeness_of(fingerprint_of(""), fingerprint_of("a"))


def plain_neighbours(docs):
    rows = sorted(((i, body or "") for i, body in docs), key=lambda r: (r[0] is None, -(r[0] or 0), r[1].encode()))
    out = []
    for at, (i, body) in enumerate(rows):
        follower = rows[(at + 1) % len(rows)][1]
        third = len(body) // 3
        edited = body[:len(body) - third] + follower[:third]
        a, b, c = fingerprint_of(body), fingerprint_of(edited), fingerprint_of(follower)
        out.append((i, len(body), hashlib.sha256(edited.encode()).hexdigest(), a, b, likeness_of(a, b), likeness_of(a, c)))
    return Counter(out)


def test_neighbours_equal_the_sorted_table_walked(spark, monkeypatch):
    rng = random.Random(6)
    docs = [(rng.randrange(-500, 500), text(rng, 1 + i % 5, 8) + "😀" * (i % 3)) for i in range(120)]
    docs += [(7, None), (8, ""), (9, "ab"), (None, "no id"), (None, None), (3, docs[0][1]), (3, docs[0][1]), (999, "x" * 70_000)]
    df = spark.createDataFrame([(*r, 1, "y") for r in docs], "doc_id long, text string, n_chars int, range string").repartition(6)
    got = neighbours_compared(df)
    assert got.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    assert Counter(tuple(r) for r in got.collect()) == plain_neighbours(docs)


def test_neighbours_of_small_tables(spark, no_docs):
    def of(rows):
        return Counter(tuple(r) for r in neighbours_compared(spark.createDataFrame(rows, "doc_id long, text string")).collect())

    assert neighbours_compared(no_docs).count() == 0
    for rows in ([(1, "alone in here, alone")], [(1, "one text"), (2, "two text")], [(None, "x"), (None, "yy")], [(5, None)] * 3,
                 [(5, "same")] * 40 + [(6, "other")]):
        assert of(rows) == plain_neighbours(rows)
    named = spark.createDataFrame([("b", "text one"), ("a", "text two"), ("é", "text three")], "doc_id string, text string")
    got = {r.doc_id: r.edited_sha256 for r in neighbours_compared(named).collect()}
    assert got["a"] == hashlib.sha256(edited_text("text two", "text three").encode()).hexdigest()


def test_fingerprints_and_their_likeness_as_columns(spark, odd_docs):
    got = fingerprints(odd_docs)
    rows = got.collect()
    assert got.columns == ["doc_id", "n_chars", "fingerprint"] and len(rows) == odd_docs.count()
    pairs = got.alias("a").join(got.alias("b"), F.col("a.doc_id") < F.col("b.doc_id"))
    for r in pairs.select(F.col("a.fingerprint").alias("x"), F.col("b.fingerprint").alias("y"),
                          likeness(F.col("a.fingerprint"), F.col("b.fingerprint")).alias("z")).collect():
        assert r.z == likeness_of(r.x, r.y)


def test_vocabulary_counts_by_partition_and_whole(spark):
    docs = _misspelt(random.Random(9), 40)
    got = vocabulary_counts(spark.createDataFrame(docs, "doc_id long, text string").repartition(4))
    assert {r.word: r.n for r in got.collect()} == plain_words(docs)
