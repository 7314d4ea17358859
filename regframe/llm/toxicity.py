"""Toxicity by a weighted lexicon, matched with Aho-Corasick over folded text.

Texts are lowered and folded: accents go, letters of other scripts that look
like Latin ones and digits that stand for letters become those letters. The
lexicon holds whole words and word beginnings. It is learned from labelled rows,
a bounded sample of ``MAX_FIT`` of them, where near copies count once: a term
enters when its share of toxic documents cannot be chance, and weighs its log
odds. Phrases around a term that only clean rows use are exceptions and cancel
the hit. The hits' weight, as a sum and per word of the text, goes through a
logistic curve fitted on the same sample.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SEED, cut, first_by_hash, quoted

MAX_FIT = 20_000      # labelled rows that the lexicon and the curve are fitted on, at most
MAX_TERMS = 5_000     # entries of the lexicon, at most
SHORTEST, LONGEST = 4, 10
THRESHOLD = 0.3

# Look-alike letters, and digits and signs used for letters.
LOOKALIKES = {"а": "a", "в": "b", "е": "e", "і": "i", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p",
              "с": "c", "т": "t", "у": "y", "х": "x", "ѕ": "s", "ј": "j", "ԁ": "d", "ɡ": "g", "ո": "n",
              "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x"}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b"}
SIGNS = re.compile(r"(?<=\w)[@$](?=\w)|(?<!\S)[@$](?=[^\W\d])")
_WORD = re.compile(r"[^\W_]+")


def _fold_table() -> dict[int, str]:
    table = {ord(k): v for k, v in {**LOOKALIKES, **DIGITS}.items()}
    for c in range(0xC0, 0x250):  # accented Latin letters to their base letters
        base = unicodedata.normalize("NFKD", chr(c))[0]
        if base.isascii() and base.isalpha():
            table[c] = base
    for c in range(0xFF01, 0xFF5F):  # full-width forms
        table[c] = chr(c - 0xFEE0).lower()
    return table | {c: None for c in (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, *range(0x300, 0x370))}


_FOLD = _fold_table()
_NEEDS_FOLD = re.compile(r"[^\x00-\x2f\x3a-\x7f]|[0134578]")


def fold(text: str) -> str:
    """Lower case, without accents, look-alikes, digit letters and invisible signs."""
    text = text.lower()
    if "@" in text or "$" in text:
        text = SIGNS.sub(lambda m: "a" if m[0] == "@" else "s", text)
    return text.translate(_FOLD) if _NEEDS_FOLD.search(text) else text


def terms_of(folded: str) -> set[str]:
    """Whole words, marked by a final blank, and their beginnings."""
    out = set()
    for w in set(_WORD.findall(folded)):
        if len(w) >= SHORTEST - 1:
            out.add(w + " ")
            out.update(w[:n] for n in range(SHORTEST, min(len(w), LONGEST) + 1))
    return out


@dataclass
class Lexicon:
    """Terms with weights, exception phrases, and the logistic curve over both features."""

    weights: dict[str, float]
    exceptions: frozenset[tuple[str, str]] = frozenset()
    curve: tuple[float, float, float] = (-4.0, 2.0, 1.0)

    def automaton(self):
        import ahocorasick
        auto = ahocorasick.Automaton()
        best: dict[str, tuple] = {}
        for term, weight in self.weights.items():  # a beginning wins over the equal whole word
            best.setdefault(term.rstrip(" "), (0.0, 0.0))
            word, start = best[term.rstrip(" ")]
            best[term.rstrip(" ")] = (max(word, weight), max(start, 0.0 if term.endswith(" ") else weight))
        for body, pair in best.items():
            auto.add_word(body, (len(body), *pair))
        if len(auto):
            auto.make_automaton()
        return auto


def hits(folded: str, auto) -> list[tuple[int, int, float]]:
    """``(start, end, weight)`` of the heaviest term in each word that holds one."""
    if not len(auto):
        return []
    best: dict[int, tuple] = {}
    n = len(folded)
    for end, (size, word, start_weight) in auto.iter(folded):
        start, stop = end - size + 1, end + 1
        if start and folded[start - 1].isalnum():
            continue
        weight = word if stop == n or not folded[stop].isalnum() else start_weight
        if weight > 0 and (start not in best or best[start][2] < weight):
            best[start] = (start, stop, weight)
    return [best[k] for k in sorted(best)]


def neighbours(folded: str, start: int, stop: int) -> tuple[str, str]:
    """The phrases ``before term`` and ``term after``."""
    left = _WORD.findall(folded[max(0, start - 40):start])
    right = _WORD.findall(folded[start:stop + 40])
    own = right[0] if right else ""
    return (f"{left[-1]} {own}" if left else "", f"{own} {right[1]}" if len(right) > 1 else "")


def features(folded: str, lexicon: Lexicon, auto) -> tuple[float, float]:
    """Weight of the hits, and weight per hundred words, both as log1p."""
    total = 0.0
    for start, stop, weight in hits(folded, auto):
        if lexicon.exceptions and any(p in lexicon.exceptions for p in neighbours(folded, start, stop)):
            continue
        total += weight
    if not total:
        return 0.0, 0.0
    return math.log1p(total), math.log1p(100.0 * total / (folded.count(" ") + 1))


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str,
                    max_fit: int = MAX_FIT, seed: int = SEED) -> DataFrame:
    """At most ``max_fit`` labelled training rows, the first by a hash of their id."""
    train = (labels.filter((F.crc32(F.col(id_col).cast("string")) % 4 != 2) & F.col("toxic").isNotNull())
             .groupBy(id_col).agg(F.max("toxic").alias("toxic")))
    train = first_by_hash(train, max_fit, labels.count(), seed, id_col)  # a documented bound
    found = docs.select(F.col(quoted(id_col)).alias(id_col), F.col(quoted(text_col)).cast("string").alias("text"))
    return found.join(F.broadcast(train), id_col).filter("text is not null").select("text", "toxic")


def _one_of_near_copies(sample: DataFrame) -> DataFrame:
    """Rows of the sample, those with an equal minimum of hashed word runs once, whatever the partitioning."""
    def run(batches):
        for batch in batches:
            low = []
            for text in batch.column(0).to_pylist():
                w = text.lower().split()
                runs = {" ".join(w[i:i + 5]) for i in range(max(1, len(w) - 4))}
                low.append([min(xxhash.xxh64_intdigest(r, seed=s) >> 1 for r in runs) for s in (1, 2)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1).cast(pa.int32()), pa.array([x[0] for x in low], pa.int64()),
                 pa.array([x[1] for x in low], pa.int64())], names=["text", "toxic", "a", "b"])

    made = sample.mapInArrow(run, "text string, toxic int, a long, b long")
    # of copies the smallest by a hash stays, and it is toxic if any of them is
    for key in ("a", "b"):
        first = F.min(F.struct(F.xxhash64("text").alias("h"), "text", "a", "b")).alias("first")
        made = (made.groupBy(F.col(key).alias("copy")).agg(first, F.max("toxic").alias("toxic"))
                .select("first.text", "toxic", "first.a", "first.b"))
    return made.select("text", "toxic")


def _term_counts(sample: DataFrame) -> DataFrame:
    """``term, toxic, clean``: documents of each class that hold the term."""
    def run(batches):
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts[1 if toxic == 1 else 0].update(terms_of(fold(text)))
        terms = list(counts[0].keys() | counts[1].keys())
        for k in range(0, len(terms), 50_000):
            part = terms[k:k + 50_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.string()), pa.array([counts[1][t] for t in part], pa.int64()),
                 pa.array([counts[0][t] for t in part], pa.int64())], names=["term", "toxic", "clean"])

    return (sample.mapInArrow(run, "term string, toxic long, clean long")
            .groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")))


def _log_chance(toxic: int, clean: int, rate: float) -> float:
    """Log of a bound on the chance of so many toxic rows among those with the term."""
    n = toxic + clean
    share = toxic / n
    if share <= rate:
        return 0.0
    kl = share * math.log(share / rate) + ((1 - share) * math.log((1 - share) / (1 - rate)) if clean else 0.0)
    return -n * kl


def choose_terms(counts: list[tuple[str, int, int]], n_toxic: int, n_clean: int, n_tested: int) -> dict[str, float]:
    """Weights of terms whose toxic share cannot be chance.

    Of nested terms one stays: the longest that is found in nearly as many
    toxic documents as the shortest telling one, so that a stem keeps its
    inflections and a word does not lend its weight to its first letters.
    """
    rate = n_toxic / max(1, n_toxic + n_clean)
    limit = math.log(0.05 / max(1, n_tested))
    odds = {}
    for term, toxic, clean in counts:
        if toxic >= 3 and toxic >= clean and _log_chance(toxic, clean, rate) <= limit:
            weight = (math.log((toxic + 0.5) / (n_toxic + 1)) - math.log((clean + 0.5) / (n_clean + 1)))
            odds[term] = (min(8.0, weight), toxic, clean)
    longer: dict[str, list[str]] = {}
    for term in odds:
        for n in range(SHORTEST, len(term)):
            if term[:n] in odds:
                longer.setdefault(term[:n], []).append(term)
    kept: dict[str, float] = {}
    covered: set[str] = set()
    for term in sorted(odds, key=lambda t: (len(t), t)):
        if term in covered:
            continue
        _, toxic, clean = odds[term]
        within = longer.get(term, [])
        if clean and any(odds[u][2] * 4 <= clean and odds[u][1] * 2 >= toxic for u in within):
            continue  # a longer term is as telling and purer
        best = max([u for u in within if odds[u][1] >= 0.97 * toxic], key=lambda u: (len(u), u), default=term)
        kept[best] = odds[best][0]
        covered.update(within)
    most = sorted(kept.items(), key=lambda kv: (-kv[1], kv[0]))[:MAX_TERMS]
    return dict(most)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Ridge logistic regression by Newton steps; slopes are never negative."""
    a = np.column_stack([np.ones(len(x)), x])
    b = np.array([-3.0, 0.5, 0.5])
    ridge = np.diag([1e-3, 1e-2, 1e-2])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + ridge, a.T @ (y - p) - ridge @ b)
        b = b + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(b[0]), max(0.0, float(b[1])), max(0.0, float(b[2]))


def fit_lexicon(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                max_fit: int = MAX_FIT) -> Lexicon:
    """Lexicon, exceptions and curve from labelled rows; an empty lexicon without toxic rows."""
    sample = cut(labelled_sample(docs, labels, id_col, text_col, max_fit))
    apart = cut(_one_of_near_copies(sample))
    sizes = dict(apart.groupBy("toxic").count().collect())
    n_toxic, n_clean = sizes.get(1, 0), sum(n for k, n in sizes.items() if k != 1)
    if not n_toxic or not n_clean:
        return Lexicon({})
    counts = cut(_term_counts(apart))
    n_tested = counts.filter("toxic >= 3").count()
    likely = counts.filter(f"toxic >= 3 and toxic >= clean and (toxic + clean) <= {n_toxic + n_clean}")
    lexicon = Lexicon(choose_terms([tuple(r) for r in likely.collect()], n_toxic, n_clean, n_tested))

    def phrases(batches):  # all phrases around hits, once a document
        auto = lexicon.automaton()
        for batch in batches:
            y, found = [], []
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                f = fold(text)
                own = {p for s, e, _ in hits(f, auto) for p in neighbours(f, s, e) if p}
                y += [int(toxic == 1)] * len(own)
                found += own
            yield pa.RecordBatch.from_arrays([pa.array(y, pa.int32()), pa.array(found, pa.string())], names=["y", "p"])

    exceptions = (apart.mapInArrow(phrases, "y int, p string")
                  .groupBy("p").agg(F.sum("y").alias("toxic"), F.count("*").alias("n"))
                  .filter("toxic = 0 and n >= 3").orderBy(F.desc("n"), "p").limit(MAX_TERMS).collect())

    def look(batches):  # features of the sample
        auto = lexicon.automaton()
        for batch in batches:
            texts, toxic = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(t == 1) for t in toxic], pa.int32()),
                 pa.array([list(features(fold(t), lexicon, auto)) for t in texts], pa.list_(pa.float64()))], names=["y", "x"])

    rows = sample.mapInArrow(look, "y int, x array<double>").collect()  # at most max_fit rows of two numbers
    lexicon.exceptions = frozenset(r["p"] for r in exceptions)
    rows = sorted((r["y"], *r["x"]) for r in rows)  # sums in one order, whatever the partitioning
    lexicon.curve = _logistic(np.array([r[1:] for r in rows], float).reshape(-1, 2), np.array([r[0] for r in rows], float))
    return lexicon


def toxicity_score(text: Column, lexicon: Lexicon) -> Column:
    """Score of a whole text between 0 and 1; a missing text scores as an empty one."""
    made: list = []

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        if not made:
            made.append(lexicon.automaton())
        x = np.array([features(fold(t), lexicon, made[0]) if t else (0.0, 0.0) for t in texts]).reshape(-1, 2)
        a, b, c = lexicon.curve
        return pd.Series(1 / (1 + np.exp(-np.clip(a + b * x[:, 0] + c * x[:, 1], -30, 30))))

    return score.asNondeterministic()(text.cast("string"))


def score_toxicity(docs: DataFrame, lexicon: Lexicon, text_col: str = "text",
                   threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``score`` and ``predicted``; columns that bear these names are replaced.

    Every row keeps its place: repeated rows score alike, a missing or empty
    text scores as one without hits, texts of any length are read whole, and an
    empty table gives no rows.
    """
    kept = docs.drop("score", "predicted")
    scored = kept.withColumn("score", toxicity_score(F.col(quoted(text_col)), lexicon))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
