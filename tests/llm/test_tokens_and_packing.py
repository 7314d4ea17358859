"""Ops 1, 7 and 9: exact ids, counts, packing and shards."""

import random
import zlib

import numpy as np
import pytest
from helpers import text

from regframe.llm import materialise as M
from regframe.llm.packing import best_cuts, packed_pieces, packed_sequences
from regframe.llm.token_counts import token_counts
from regframe.llm.tokens import Codec, Generations, vocabulary

WORD = vocabulary("word_bpe_49k.json")
BYTE = vocabulary("byte_bpe_50k.json")


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_ids_equal_the_library(path):
    rng = random.Random(3)
    signs = "aé Σσ\n\t .,'s1²<|日́  x \x1c"
    texts = ["", " ", "  ", "a  b", "a \n b\tc ", " x", "it's we'll 'S", "<|endoftext|> a", "İstanbul ΑΣ Σ.",
             "a<|startoftext|>b <|ENDOFTEXT|>", "x" * 3000]
    texts += ["".join(rng.choice(signs) for _ in range(40)) for _ in range(1500)]
    texts += ["".join(chr(rng.randrange(lo, 0x260)) for _ in range(30)) for lo in (0x20, 0x20, 0x100, 0x178) for _ in range(300)]
    own = Codec(path, cache_units=50)
    assert all(own.ids(t) == own.library(t) for t in texts)
    assert own.ids(None) == b""


def test_plain_pattern_equals_the_pattern():
    import regex
    import regframe.llm.tokens as tokens
    given = r"'s|'t|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    plain, whole = tokens.plain_pattern(given), regex.compile(given)
    rng = random.Random(8)
    for _ in range(3000):
        body = "".join(c for c in (chr(rng.randrange(0x180)) for _ in range(12)) if not "\x1c" <= c <= "\x1f" and c != "\u0130")
        assert max(body.lower(), default="") < "ƀ" and plain.findall(body.lower()) == whole.findall(body.lower())
    assert tokens.plain_pattern(r"\p{L}+|x") is None


def test_byte_level_texts_are_cut_into_the_words_of_the_whole_pattern():
    """Words are encoded once, whatever marks and white space stand beside them."""
    import regex
    import regframe.llm.tokens as tokens
    own = Codec(vocabulary("byte_bpe_50k.json"))
    whole = regex.compile(tokens.BYTE_LEVEL_PATTERN)
    rng = random.Random(5)
    words = ["alpha", "beta", "don't", "it's", "naïve", "x2²", "Ünal", "_"]
    marks = ["", ",", ".", "!?", "'", "\n", " ", "  ", "\t", "\u00a0", "-", ")", "''s"]
    made = []
    own._words = Generations(lambda w: made.append(w) or own._word(w), 1000)
    for _ in range(2000):
        text = rng.choice([" ", "", "\n"]) + "".join(rng.choice(words) + rng.choice(marks) + rng.choice([" ", " ", "", "\n"]) for _ in range(12))
        assert own.parts(text) == whole.findall(text)
        assert own.ids(text) == own.library(text) == b"".join(map(own.part_ids, own.parts(text)))
    assert len(made) == len(set(made)) < 700


def test_top_counts_are_those_of_a_full_sort():
    from collections import Counter
    from regframe.llm.token_counts import _top
    rng = random.Random(6)
    for keep in (1, 5, 40, 400):
        counts = Counter("".join(rng.choice("abc") for _ in range(rng.randrange(1, 5))) for _ in range(300))
        assert _top(counts, keep) == dict(sorted(counts.items(), key=lambda kv: (kv[1], kv[0]), reverse=True)[:keep])


def test_cache_generations_stay_bounded():
    g = Generations(lambda k: k * 2, 10)
    assert [g[i] for i in [*range(100), *range(100)]] == [2 * i for i in [*range(100), *range(100)]]
    assert len(g) <= 10 and len(g._old) <= 10


def test_token_counts(spark, odd_docs, no_docs):
    own = Codec(BYTE)
    rows = token_counts(odd_docs, BYTE, limit=3, frequent=4).collect()
    want = sorted((len((r.text or "").encode()), len(own.library(r.text or "")) // 4) for r in odd_docs.collect())
    assert sorted((r.n_bytes, r.n_tokens) for r in rows) == want
    assert all(r.over_limit == (r.n_tokens > 3) for r in rows)
    assert token_counts(no_docs, BYTE).collect() == []


def test_best_cuts_is_optimal():
    rng = np.random.default_rng(5)
    for _ in range(30):
        places = np.concatenate([[0], np.sort(rng.choice(np.arange(1, 60), 14, replace=False))])
        places = places[np.concatenate([[True], np.diff(places) > 0])]
        cost = rng.integers(0, 9, len(places)).astype(float)
        length = int(max(np.diff(places).max(), 12))
        best = [0.0] + [np.inf] * (len(places) - 1)
        for j in range(1, len(places)):
            best[j] = min(best[i] + length - (places[j] - places[i]) + cost[j]
                          for i in range(j) if places[j] - places[i] <= length)
        cuts = best_cuts(places, cost, length).tolist()
        got = sum(length - (b - a) + cost[places.tolist().index(b)] for a, b in zip([0, *cuts], cuts))
        assert got == pytest.approx(best[-1]) and cuts[-1] == places[-1]


def _check_pieces(docs, rows, length):
    own = Codec(WORD)
    texts = {}
    for r in docs.collect():
        texts.setdefault(r.doc_id, []).append(np.append(np.frombuffer(own.library(r.text or ""), np.uint32), 1))
    assert sum(r.length for r in rows) == sum(len(i) for v in texts.values() for i in v)
    for r in rows:
        ids = [i for i in texts[r.doc_id] if len(i) == r.doc_tokens]
        assert r.ids_crc32 in [zlib.crc32(i[r.start:r.start + r.length].astype("<u4").tobytes()) for i in ids]
    by_seq = {}
    for r in rows:
        by_seq.setdefault(r.sequence_id, []).append(r)
    for pieces in by_seq.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= length
    return by_seq


def test_packing(spark, odd_docs, no_docs):
    _check_pieces(odd_docs, packed_pieces(odd_docs, WORD, length=64, horizon=500).collect(), 64)
    assert packed_pieces(no_docs, WORD).collect() == []
    rng = random.Random(8)
    docs = spark.createDataFrame([(i, text(rng, rng.randint(1, 30))) for i in range(300)], "doc_id long, text string")
    rows = packed_pieces(docs.coalesce(1), WORD, length=512, horizon=20_000).collect()
    by_seq = _check_pieces(docs, rows, 512)
    assert sum(r.length for r in rows) / (512 * len(by_seq)) > 0.98
    seqs = packed_sequences(docs.coalesce(1), WORD, length=512, horizon=20_000).collect()
    assert {s.sequence_id: s.n_tokens for s in seqs} == {k: sum(p.length for p in v) for k, v in by_seq.items()}
    assert all(len(s.ids) == 512 for s in seqs)


def test_permutation_round_trip():
    for n in (1, 2, 3, 5, 64, 1000, 4097):
        for key in (1, 9):
            s = M.slots_of(np.arange(n), n, key)
            assert sorted(s.tolist()) == list(range(n))
            assert (M.slots_of(s, n, key, back=True) == np.arange(n)).all()
    assert M.slots_of(np.arange(1000), 1000, 1).tolist() != M.slots_of(np.arange(1000), 1000, 2).tolist()


def test_shards_round_trip(spark, odd_docs, no_docs, tmp_path):
    path = f"file://{tmp_path}/shards"
    rows = sorted(M.materialise(odd_docs, WORD, path, length=128, per_shard=16).collect(), key=lambda r: r.slot)
    m = M.read_manifest(path)
    assert [r.slot for r in rows] == list(range(m["n"])) and m["n"] > 100
    assert all((r.shard, r.offset) == (r.slot // 16, r.slot % 16 * 256) for r in rows)
    own = Codec(WORD)
    assert sum(r.n_tokens for r in rows) == sum(len(own.library(d.text or "")) // 4 + 1 for d in odd_docs.collect())
    got = {r.slot: r.ids for r in M.read_slots(spark, path, 13, 70).collect()}  # resumed in the middle of a shard
    assert sorted(got) == list(range(13, 70))
    for slot, ids in got.items():
        want = np.array(ids[:rows[slot].n_tokens], "<u2").tobytes()
        assert zlib.crc32(want) == rows[slot].ids_crc32
    empty = f"file://{tmp_path}/none"
    assert M.materialise(no_docs, WORD, empty).collect() == [] and M.read_slots(spark, empty).collect() == []


def test_a_worker_keeps_four_times_as_many_words_as_units():
    own = Codec(vocabulary("word_bpe_49k.json"), cache_units=10)
    made = []
    own._words._make = lambda w: made.append(w) or own._word(w)
    texts = [f"{a}{b}" for a in "abcde" for b in "fghijk"]  # 30 words
    for _ in range(4):
        assert [own.ids(t) for t in texts] == [own.library(t) for t in texts]
    assert len(made) == 30
