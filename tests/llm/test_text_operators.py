"""Ops 2, 3, 4, 6 and 8 against plain versions and planted cases."""

import hashlib
import random
import re
import threading
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from helpers import PII, Union, pii_spans, text, water_fill
from pyspark.sql import functions as F

import regframe.llm.minhash as minhash
from regframe.llm.line_dedup import chunks, dedup_lines
from regframe.llm.minhash import Sampler, common_words, near_duplicates, one_of_each, weighted_jaccard
from regframe.llm.mixing import mix, mixed_documents, pivotal, pivotal_with_rest
from regframe.llm.pii import found_spans, sanitise, span_digest
from regframe.llm.toxicity import Lexicon, fit_lexicon, fold, hits, score_toxicity


# --- toxicity -------------------------------------------------------------

def test_fold_and_hits():
    assert fold("ІDI0T") == fold("idiot") == "idiot" and fold("Ünïcödé") == "unicode" and fold("ｓｃｕｍ") == "scum"
    auto = Lexicon({"idiot ": 4.0, "scum": 3.0}).automaton()
    found = hits(fold("an 1diot, idiots; scummy $cum viscum"), auto)
    assert [w for _, _, w in found] == [4.0, 3.0, 3.0]


def test_lexicon_learns_words_stems_and_leaves_clean_rows(spark, no_docs):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(900):
        body, toxic = text(rng, 3), int(i % 6 == 0)
        if toxic:
            words = body.split(" ")
            words.insert(rng.randrange(len(words)), "gronk" if i % 12 else "zorb" + rng.choice(["a", "es", "ik", "um"]))
            body = " ".join(words)
        rows.append((i, body))
        labels.append((i, toxic))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    lexicon = fit_lexicon(docs, marks)
    assert any("gronk".startswith(t.strip()) for t in lexicon.weights)
    more = docs.union(spark.createDataFrame(
        [(5000, "kabar ZORBIK loden"), (5001, "a gr0nk here"), (5002, "kabar loden"), (5003, None), (5004, ""),
         (None, "gronk " * 50_000)], "doc_id long, text string"))
    got = {r.doc_id: r for r in score_toxicity(more, lexicon).collect()}
    assert len(got) == 906 and all(0 <= r.score <= 1 for r in got.values())
    assert [got[i].predicted for i in (5000, 5001, 5002, 5003, 5004, None)] == [1, 1, 0, 0, 0, 1]
    held = [(got[i].predicted, y) for i, y in labels]
    assert sum(p == y for p, y in held) / len(held) > 0.99
    assert fit_lexicon(no_docs.select("doc_id", "text"), marks).weights == {}
    clash = more.withColumn("score", F.lit("x")).withColumn("key", F.lit(1))
    assert score_toxicity(clash, lexicon).columns == ["doc_id", "text", "key", "score", "predicted"]


def _fitting_rows(rng):
    rows, labels = [], []
    for i in range(500):
        body, toxic = text(rng, 3), int(i % 5 == 0)
        if i % 5 in (0, 1) and i % 2:
            body += " late gronkers again"
        if toxic:
            body = f"{body} gronk {'zorbes' if i % 3 else 'gronkle'}"
        rows.append((i, body))
        labels.append((i, toxic))
    rows += [(1000 + i, rows[i][1]) for i in range(60)]                # exact copies, some with another label
    labels += [(1000 + i, int(i % 7 == 0)) for i in range(60)]
    return rows, labels


def test_the_lexicon_does_not_depend_on_the_partitioning(spark):
    rows, labels = _fitting_rows(random.Random(21))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    fits = [fit_lexicon(docs.repartition(n, order).sortWithinPartitions(order), marks.repartition(n))
            for n, order in ((1, "doc_id"), (7, "text"), (3, F.rand(5)))]
    assert fits[0].weights and all((f.weights, f.exceptions, f.curve) == (fits[0].weights, fits[0].exceptions, fits[0].curve)
                                   for f in fits)
    scores = [[r.score for r in score_toxicity(docs.repartition(3), f).orderBy("doc_id").collect()] for f in fits]
    assert scores[0] == scores[1] == scores[2]


def test_hits_equal_every_term_tried_at_every_word():
    rng = random.Random(22)
    for _ in range(300):
        weights = {}
        for _ in range(rng.randint(1, 8)):
            body = "".join(rng.choice("ab") for _ in range(rng.randint(1, 4)))
            weights[body + rng.choice(["", " "])] = float(rng.randint(1, 9))
        folded = "".join(rng.choice("aab .") for _ in range(rng.randint(0, 40)))
        want = []
        for m in re.finditer(r"[^\W_]+", folded):
            found = [(w, m.start(), m.start() + len(t.rstrip(" "))) for t, w in weights.items()
                     if (m.group() == t[:-1] if t.endswith(" ") else m.group().startswith(t))]
            if found:
                want.append((m.start(), max(found)[0]))
        got = hits(folded, Lexicon(weights).automaton())
        assert [(s, w) for s, _, w in got] == want


# --- personal data --------------------------------------------------------

def test_base_spans_equal_the_plain_patterns(spark):
    rng = random.Random(3)
    signs = "a.@b-1 2+34(5)😀.é_9"
    texts = ["a@b@c.d é😀 x@y.z", "a@b.c.@d.e", "a@b_c@d.e _d@e.f", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.255",
             "4111 1111 1111 1111-5500-0000-0000-0004 +1 (386) 555-3733 +123456789 +1(((((", "", None,
             "9" * 3000 + " " + "1.2.3." * 500, "😀" * 5 + " bob@x.example.com " * 300, "a" * 20_000]
    texts += ["".join(rng.choice(signs) for _ in range(60)) for _ in range(1500)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in span_digest(found_spans(docs)).collect():
        want = pii_spans(texts[r.doc_id] or "")
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(want[k]) for k in PII]
        joined = ",".join(f"{k}:{s}:{e}" for k in PII for s, e in want[k])
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest() and r.spans.startswith(joined)


def test_disclosing_terms_are_removed_and_common_ones_stay(spark, odd_docs, no_docs):
    rng = random.Random(4)
    rows = [(i, f"{text(rng, 2)} {'the quellmaster writes' if i < 6 else 'anyone writes'} from "
                f"{'q@farm.example.com' if i < 6 else f'u{i}@x.example.com'} today") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in found_spans(docs).collect()}
    for i, body in rows:
        terms = [body[s.start:s.end] for s in got[i].term]
        assert ("quellmaster" in terms) == (i < 6) and "writes" not in terms and "today" not in terms
    clean = {r.doc_id: r.text for r in sanitise(docs).collect()}
    assert all("[EMAIL]" in t and "@" not in t and "quellmaster" not in t for t in clean.values())
    assert len(clean) == 60
    assert sanitise(odd_docs).columns == odd_docs.columns and sanitise(odd_docs).count() == odd_docs.count()
    assert found_spans(no_docs).collect() == [] and sanitise(no_docs).collect() == []


def test_long_texts_with_many_terms_take_linear_time(spark):
    """Offsets of 6,000 terms were computed anew for every term: these three texts took minutes."""
    body = "alphabet " * 5_990 + "quellmaster q@farm.example.com éabcd@x.org abcd"
    rows = [(i, body if i < 3 else "anyone") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    timer = threading.Timer(90, spark.sparkContext.cancelAllJobs)
    timer.start()
    try:
        got = {r.doc_id: r for r in found_spans(docs).collect()}
    finally:
        timer.cancel()
    for i in range(3):
        # words that overlap an entity, as the é before an address, are no terms
        assert {body[s.start:s.end] for s in got[i].term} == {"alphabet", "quellmaster", "abcd"}
        assert len(got[i].term) == 5_992 and [s.value for s in got[i].email] == ["q@farm.example.com", "abcd@x.org"]
    assert all(got[i].term == [] for i in range(3, 60))


def test_disclosing_terms_far_from_the_mention_are_marked_whole(spark):
    rng = random.Random(14)
    rows = [(i, f"{'Quellmaster' if i < 5 else 'Anyone'} says: {text(rng, 3)} write to "
                f"{'q@farm.example.com' if i < 5 else f'u{i}@x.example.com'} {text(rng, 3)} "
                f"{'signed quellmaster of Switzerland' if i < 5 else 'unsigned'}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for r in found_spans(docs).collect():
        terms = [rows[r.doc_id][1][s.start:s.end] for s in r.term]
        assert terms == (["Quellmaster", "signed", "quellmaster", "Switzerland"] if r.doc_id < 5 else [])
    assert not any("quellmaster" in r.text.lower() for r in sanitise(docs).collect())


# --- line dedup -----------------------------------------------------------

def test_chunks_give_the_text_back_and_resist_shifts():
    rng = random.Random(5)
    for _ in range(50):
        body = "\n".join(text(rng, 1, rng.choice([0, 1, 5, 30])) for _ in range(rng.randint(1, 30)))
        assert "\n".join(chunks(body)) == body
    passage = text(rng, 12, 8)
    a, b = (set(chunks(text(rng, n, 8) + "\n" + passage + "\n" + text(rng, 3, 8))) for n in (2, 7))
    assert sum(len(c.split()) for c in a & b) >= 50
    assert chunks(None) == [] and chunks("") == []


def test_repeated_passages_go_once_kept(spark, odd_docs, no_docs):
    rng = random.Random(6)
    one_line, many_lines = text(rng, 1, 70), text(rng, 16, 7)
    rows = []
    for i in range(40):
        body = [text(rng, 1, rng.choice([6, 25])) for _ in range(6)]
        if i in (3, 9, 17):
            body.insert(rng.randint(0, 5), one_line)
        if i in (5, 21):
            body.insert(rng.randint(1, 5), many_lines)
        body.append("short footer")
        rows.append((i, "\n".join(body)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r for r in dedup_lines(docs).collect()}
    assert one_line in got[3].text and one_line not in got[9].text and one_line not in got[17].text
    assert got[5].text == rows[5][1] and got[21].words_removed >= 50
    for i, body in rows:
        if i not in (9, 17, 21):
            assert got[i].text == body and got[i].chunks_removed == 0
        assert got[i].text.endswith("short footer")
    out = dedup_lines(odd_docs)
    assert out.columns == [*odd_docs.columns, "chunks_removed", "words_removed"]
    back = sorted((r.doc_id or -1, r.text or "") for r in out.collect())
    assert back == sorted((r.doc_id or -1, r.text or "") for r in odd_docs.collect())
    assert dedup_lines(no_docs).collect() == []


def test_whole_passages_of_short_lines_go(spark):
    rng = random.Random(12)
    shapes = [(3, 18), (4, 14), (5, 11), (6, 9), (8, 7)]
    rows, want = [], {}
    for k, (lines, words) in enumerate(shapes):
        for trial in range(6):
            passage = text(rng, lines, words).split("\n")
            for copy in range(3):
                i = len(rows)
                before, after = ([text(rng, 1, rng.randint(4, 9)) for _ in range(4)] for _ in "ab")
                own = passage if copy < 2 else [x for line in passage for x in (line, "  ")][:-1]  # blank lines between
                rows.append((i, "\n".join([*before, *own, *after])))
                want[i] = (rows[-1][1], 0, 0) if copy == 0 else ("\n".join(before + after), lines, lines * words)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert {r.doc_id: (r.text, r.chunks_removed, r.words_removed) for r in dedup_lines(docs).collect()} == want


def _plain_line_dedup(bodies, least=20):
    """Lines left of each text: those in no run of ``least`` words that stands before, compared run by run."""
    texts = [[x for x in (b or "").split("\n") if x.strip()] for b in bodies]
    n, runs, out = [[len(x.split()) for x in t] for t in texts], {}, []
    for i, t in enumerate(texts):
        for a in range(len(t)):
            for b in range(a, len(t)):
                if sum(n[i][a:b + 1]) >= least:
                    runs.setdefault(tuple(t[a:b + 1]), (i, a, b))
    for i, t in enumerate(texts):
        gone = set()
        for a in range(len(t)):
            for b in range(a, len(t)):
                first = runs.get(tuple(t[a:b + 1]))
                if first and (first[0] != i or a > first[2]):
                    gone.update(range(a, b + 1))
        out.append([x for a, x in enumerate(t) if a not in gone])
    return out


def test_line_dedup_equals_all_runs_compared(spark):
    rng = random.Random(13)
    pool = [text(rng, 1, rng.choice([1, 3, 6, 9, 15, 25])) for _ in range(14)] + ["", " "]
    bodies = ["\n".join(rng.choice(pool) for _ in range(rng.randint(0, 9))) for _ in range(60)]
    bodies += ["\n".join([pool[2]] * 3 + [text(rng, 1, 12)] * 9), "\n".join([text(rng, 1, 12), text(rng, 1, 11)] * 5)]
    docs = spark.createDataFrame(list(enumerate(bodies)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.text for r in dedup_lines(docs).collect()}
    want = _plain_line_dedup(bodies)
    for i in range(len(bodies)):
        assert [x for x in got[i].split("\n") if x.strip()] == want[i]


# --- mixing ---------------------------------------------------------------

def test_pivotal_keeps_words_and_expectations():
    rng = np.random.default_rng(7)
    p, size = rng.random(400), rng.integers(1, 50, 400).astype(float)
    out, left = pivotal(p, size, rng)
    whole = np.delete(out, left) if left >= 0 else out
    assert set(whole.tolist()) <= {0.0, 1.0} and (out * size).sum() == pytest.approx((p * size).sum())
    out = pivotal_with_rest(p, size, rng)
    assert set(out.tolist()) <= {0.0, 1.0} and abs((out * size).sum() - (p * size).sum()) <= 5
    p, size = np.array([0.3, 0.6, 0.2, 0.9, 0.5]), np.array([5.0, 9.0, 2.0, 4.0, 7.0])
    for f in (lambda g: pivotal(p, size, g)[0], lambda g: pivotal_with_rest(p, size, g)):
        mean = np.mean([f(np.random.default_rng(s)) for s in range(4000)], axis=0)
        assert np.abs(mean - p).max() < 0.04


def test_mix(spark, odd_docs, no_docs):
    rng = random.Random(9)
    rows = [(i, text(rng, rng.randint(1, 9)), ["big", "b", "c", None, ""][0 if i % 3 == 0 else rng.randint(0, 4)])
            for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mix(docs, block=64).collect()
    again = mix(docs.repartition(7), block=64).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    sizes, source = {}, {i: s for i, _, s in rows}
    for r in got:
        sizes[source[r.doc_id]] = sizes.get(source[r.doc_id], 0) + r.size
    want = water_fill(sizes)
    for s in sizes:
        own = [r for r in got if source[r.doc_id] == s]
        assert {(r.source_size, round(r.target, 6)) for r in own} == {(sizes[s], round(want[s], 6))}
        assert abs(sum(r.taken for r in own) - want[s]) <= max(r.size for r in own)
        assert all(r.taken <= 3 * r.size for r in own)
    made = mixed_documents(docs, block=64).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in made} == {r.doc_id: r.copies for r in got if r.copies}
    assert mix(odd_docs).count() == odd_docs.count() and mixed_documents(odd_docs).columns == odd_docs.columns
    assert mix(no_docs).collect() == [] and mixed_documents(no_docs).collect() == []


# --- near duplicates ------------------------------------------------------

def _edited(rng, body, n):
    words = body.split(" ")
    for _ in range(n):
        words[rng.randrange(len(words))] = rng.choice(["kabar", "zzz", "lohem"])
    return " ".join(words)


def test_word_hashes_stand_for_the_words():
    rng = random.Random(31)
    named = {}
    for _ in range(400):
        body = "".join(rng.choice("abÀ😀İ\u00a0\u3000\x1c\x85\t\n  ") for _ in range(rng.randint(0, 40)))
        words, got = body.lower().split(), minhash.word_hashes(body)
        assert len(words) == len(got)
        for word, h in zip(words, got.tolist()):
            assert named.setdefault(word, h) == h
    assert len(set(named.values())) == len(named)
    long = minhash.word_hashes("x" * 70_000 + " " + "x" * 69_999)
    assert len(set(long.tolist())) == 2


def test_consistent_samples_agree_as_often_as_the_similarity(spark):
    rng = random.Random(10)
    sampler = Sampler(b"", b"", 2.0)
    same = total = 0
    for _ in range(150):
        a = text(rng, 12)
        b = _edited(rng, a, 5)
        j = weighted_jaccard(sampler.shingles(a), sampler.shingles(b))
        same += sum(x == y for x, y in zip(sampler.band_keys(a), sampler.band_keys(b))) / 16 - j ** 3
        total += 1
    assert abs(same / total) < 0.04


@pytest.mark.parametrize("rare, growth", [(1e-3, 8), (0.05, 2)])
def test_classes_equal_brute_force(spark, odd_docs, no_docs, monkeypatch, rare, growth):
    """Also where rare words share the highest weight, as in tables of more than 1 / RARE texts."""
    monkeypatch.setattr(minhash, "RARE", rare)
    monkeypatch.setattr(minhash, "GROWTH", growth)
    monkeypatch.setattr(minhash.common_words, "__defaults__", (rare,))
    rng = random.Random(11)
    rows = []
    for _ in range(25):
        base = text(rng, 10)
        rows += [base] * rng.randint(1, 3) + [_edited(rng, base, rng.randint(0, 8)) for _ in range(rng.randint(0, 5))]
    hub = text(rng, 14)
    rows += [_edited(rng, hub, 3) for _ in range(120)] + [text(rng, 8) for _ in range(80)] + ["", "", "one two", None]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: r for r in near_duplicates(docs).collect()}
    sampler = Sampler(*common_words(docs.filter("text is not null")))
    sets = [sampler.shingles(t) if t is not None else None for t in rows]
    u = Union(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if rows[i] is not None and rows[j] is not None and (
                    rows[i] == rows[j] or weighted_jaccard(sets[i], sets[j]) >= 0.8):
                u.join(i, j)
    assert [got[i].class_id for i in range(len(rows))] == [u.top(i) for i in range(len(rows))]
    assert all(got[i].kept == (u.top(i) == i) for i in got)
    left = one_of_each(odd_docs)
    assert left.columns == odd_docs.columns
    ids = sorted((r.doc_id or -1) for r in left.collect())
    assert ids == [-1, 1, 2, 3, 4, 5, 6, 7]
    assert near_duplicates(no_docs).collect() == [] and one_of_each(no_docs).collect() == []


def test_texts_reach_python_in_small_batches(spark, monkeypatch):
    """Batches of 10,000 texts, twice a pair, took executors beyond their memory."""
    key, rows_seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    before, signatures = spark.conf.get(key), minhash._signatures
    rng = random.Random(21)
    docs = spark.createDataFrame([(i, text(rng, 2)) for i in range(700)], "doc_id long, text string").coalesce(1)

    def rows_of(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    def noted(rows, weights):
        rows_seen.extend(r.n for r in rows.select("id").mapInArrow(rows_of, "n long").collect())
        return signatures(rows, weights)

    monkeypatch.setattr(minhash, "_signatures", noted)
    assert near_duplicates(docs).count() == 700
    assert sum(rows_seen) == 700 and max(rows_seen) <= 512 and spark.conf.get(key) == before
    whole = common_words(docs)
    monkeypatch.setattr(minhash, "WORDS_HELD", 50)  # counts handed on in many parts
    assert common_words(docs) == whole and len(whole[0]) > 0


def _with_own_words(rng, body, n, tag):
    words = body.split(" ")
    for i, at in enumerate(rng.sample(range(len(words)), n)):
        words[at] = f"own{tag}x{i}"
    return " ".join(words)


def test_texts_whose_own_words_rule_out_a_link_are_not_compared(spark, monkeypatch):
    """All pairs of a large group alike but below 0.8 were compared on their texts."""
    rng = random.Random(41)
    hub = " ".join(rng.choice(["lorem", "kabar", "sit", "amet", "dolor"]) + str(i) for i in range(200))
    far = [_with_own_words(rng, hub, 9, i) for i in range(70)]  # about 45 of 196 shingles each
    near = [_with_own_words(rng, hub, 1, f"n{i}") for i in range(30)]
    docs = spark.createDataFrame(list(enumerate(far + near)), "doc_id long, text string")
    compared, verified = [], minhash._verified

    def noted(pairs, texts, weights, threshold):
        compared.append(pairs.count())
        return verified(pairs, texts, weights, threshold)

    monkeypatch.setattr(minhash, "_verified", noted)
    got = {r.doc_id: r.class_id for r in near_duplicates(docs).collect()}
    sampler = Sampler(*common_words(docs))
    sets = [sampler.shingles(t) for t in far + near]
    u = Union(range(100))
    for i in range(100):
        for j in range(i):
            if weighted_jaccard(sets[i], sets[j]) >= 0.8:
                u.join(i, j)
    assert [got[i] for i in range(100)] == [u.top(i) for i in range(100)]
    assert sum(compared) < 700  # of 4,950 pairs


def test_own_weights_are_of_shingles_in_one_text_alone(spark):
    rng = random.Random(42)
    texts = [text(rng, 3) for _ in range(40)] + ["one two", "one two three four five", "Zero one two three four five", ""]
    docs = spark.createDataFrame([(hashlib.md5(t.encode()).digest(), t) for t in set(texts)],
                                 "node binary, text string")
    weights = common_words(docs)
    sampler = Sampler(*weights)
    sets = {bytes(r.node): dict(zip(*(x.tolist() for x in sampler.shingles(r.text)))) for r in docs.collect()}
    held = Counter(c for s in sets.values() for c in s)
    want = {n: sum(w for c, w in s.items() if held[c] == 1) for n, s in sets.items()}
    got = {bytes(r.node): r.own for r in minhash._own_weights(docs, weights).collect()}
    assert got == {n: pytest.approx(w) for n, w in want.items() if w}


def test_shuffle_files_of_a_round_go_with_it(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    rng = random.Random(43)
    docs = spark.createDataFrame([(i, text(rng, 2)) for i in range(60)], "doc_id long, text string")
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        return {name for name in blocks.getAllFiles().mkString("\n").split("\n") if "shuffle_" in name}

    there = files()
    found = near_duplicates(docs)
    assert files() <= there and spark.conf.get(key) == before
    assert found.count() == 60
