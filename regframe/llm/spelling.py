"""Spelling variants by reduced-alphabet generation.

The letters of a word are hashed to a few symbols. Words one edit apart have
reduced forms at most one edit apart, so every word generates the full one-edit
neighbourhood of its reduced form: the form itself and all its deletions,
replacements and insertions, which a small alphabet keeps short. These keys
join the reduced vocabulary, and the pairs that meet are verified on the
original words. No bucket is cut and no pair is lost.

Keys are integers: a reduced form of up to ``EXACT`` symbols is written in base
``SYMBOLS`` and is exact, a longer one is a polynomial hash, so that the keys of
a word of any length come without building its neighbours. Keys that no word
of the vocabulary has are dropped where they arise, by a broadcast bitmap of at
most ``MAX_BITS`` bits; past that size it only passes more of them.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, partition_sketches, quoted

SYMBOLS = 8
EXACT = 20                # 3 bits a symbol and a leading one fit 61 bits
MIN_LENGTH, MIN_COUNT = 5, 3
DROP_EVERY = 97
MAX_BITS = 1 << 26
_FLUSH = 400_000
_CELLS = 1 << 18          # positions whose neighbours are built at once

#: Latin-1 bytes to words: A-Z in lower case, a-z and 0xC0-0xFF stay, the rest separates.
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0xC0 else 0x20 for b in range(256))
#: Symbol (0 to SYMBOLS - 1) and mask bit of every code point up to 0xFF.
_SYMBOL = ((np.arange(256, dtype=np.uint64) * np.uint64(2654435761)) >> np.uint64(16)) % np.uint64(SYMBOLS)
_MASK = np.uint64(1) << ((np.arange(256, dtype=np.uint64) * np.uint64(40503)) >> np.uint64(6)) % np.uint64(64)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _utf8(word: bytes) -> bytes:
    return word if word.isascii() else word.decode("latin-1").encode()


def _code_points(text: str) -> bytes:
    """A text as Latin-1 bytes, one a code point; code points past it become ``?``."""
    return text.encode("latin-1", "replace")


def words_of(doc_id: object, text: str) -> Counter:
    """Occurrences of a text's words; where the digest of id and word says so, one code point is gone."""
    head = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    found: Counter = Counter()
    for word, n in Counter(_code_points(text).translate(_FOLD).split()).items():
        h = zlib.crc32(_utf8(word), head)
        if h % DROP_EVERY == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1:]
        found[word] += n
    return found


def vocabulary_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """``word, n`` of the distinct words that are long and frequent enough."""
    def run(batches):
        seen: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays(
                [pa.array([w.decode("latin-1") for w in seen], pa.string()), pa.array(list(seen.values()), pa.int64())],
                names=["word", "n"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text:
                    for word, n in words_of(doc, text).items():
                        if len(word) >= min_length:
                            seen[word] += n
                if len(seen) > _FLUSH:
                    yield out()
                    seen.clear()
        yield out()

    return (docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).cast("string").alias("text"))
            .mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
            .filter(F.col("n") >= min_count))


def _base(length: int) -> np.uint64:
    return np.uint64(SYMBOLS) if length <= EXACT else _BASE


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n + 1, base)
    out[0] = 1
    return np.multiply.accumulate(out)


def _finish(value: np.ndarray, length: int) -> np.ndarray:
    """Keys of forms of one length: a leading one before exact values, the top bit on hashes."""
    if length <= EXACT:
        return value | np.uint64(1 << (3 * length))
    value = (value ^ (value >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return value ^ (value >> np.uint64(32)) ^ np.uint64(length) | np.uint64(1 << 63)


def _ends(form: np.ndarray, base: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Values of every prefix and of every suffix of forms of one length, in columns."""
    n, length = form.shape
    power = _powers(base, length)
    before, after = np.zeros((n, length + 1), np.uint64), np.zeros((n, length + 1), np.uint64)
    for i in range(length):
        before[:, i + 1] = before[:, i] * base + form[:, i]
        j = length - 1 - i
        after[:, j] = form[:, j] * power[i] + after[:, j + 1]
    return before, after


def own_keys(form: np.ndarray) -> np.ndarray:
    """The key of each reduced form (a row)."""
    return _finish(_ends(form, _base(form.shape[1]))[0][:, -1], form.shape[1])


def neighbour_keys(form: np.ndarray):
    """``(rows, keys)`` of the full one-edit neighbourhoods of forms of one length, each neighbour once."""
    n, length = form.shape
    symbols = np.arange(SYMBOLS, dtype=np.uint64)
    every = np.arange(n)
    yield every, own_keys(form)
    step = max(1, _CELLS // n)
    for lo in range(0, length + 1, step):
        hi = min(length, lo + step)
        here = form[:, lo:hi]
        if length > 1:  # deletions: of a run of one symbol, its first
            base = _base(length - 1)
            before, after = _ends(form, base)
            power = _powers(base, length)
            value = before[:, lo:hi] * power[length - 1 - np.arange(lo, hi)] + after[:, lo + 1:hi + 1]
            first = np.ones_like(here, bool)
            first[:, int(lo == 0):] = here[:, int(lo == 0):] != form[:, max(lo, 1) - 1:hi - 1]
            rows, cols = np.nonzero(first)
            yield rows, _finish(value[rows, cols], length - 1)
        base = _base(length)
        before, after = _ends(form, base)
        power = _powers(base, length)
        at = np.arange(lo, hi)
        value = ((before[:, lo:hi] * power[length - at] + after[:, lo + 1:hi + 1])[:, :, None]
                 + power[length - 1 - at][None, :, None] * symbols)
        rows, cols, signs = np.nonzero(here[:, :, None] != symbols)
        yield rows, _finish(value[rows, cols, signs], length)
        base = _base(length + 1)  # insertions: of a symbol into a run of it, behind the run
        before, after = _ends(form, base)
        power = _powers(base, length + 1)
        at = np.arange(lo, min(length + 1, lo + step))
        value = ((before[:, at] * power[length + 1 - at] + after[:, at])[:, :, None]
                 + power[length - at][None, :, None] * symbols)
        free = np.ones((n, len(at), SYMBOLS), bool)
        free[:, :hi - lo] = here[:, :, None] != symbols
        rows, cols, signs = np.nonzero(free)
        yield rows, _finish(value[rows, cols, signs], length + 1)


def _by_length(words: list[str]):
    """``(places, code points)`` of words of one length, in bounded groups."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    for length in np.unique(size):
        places = np.flatnonzero(size == length)
        step = max(1, _CELLS // int(length))
        for lo in range(0, len(places), step):
            some = places[lo:lo + step]
            points = np.frombuffer("".join(words[i] for i in some).encode("latin-1"), np.uint8)
            yield some, points.reshape(len(some), length)


def _bits(keys: np.ndarray, log: int) -> np.ndarray:
    return (keys * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - log)


def _bitmap(words: DataFrame, log: int) -> bytes:
    """Bits of the keys of all reduced words."""
    def build(batches) -> bytes:
        held = np.zeros(1 << log, bool)
        for batch in batches:
            for _, points in _by_length(batch.column(0).to_pylist()):
                held[_bits(own_keys(_SYMBOL[points]), log)] = True
        return np.packbits(held).tobytes()

    def merge(blobs: list[bytes]) -> bytes:
        out = np.zeros((1 << log) // 8, np.uint8)
        for blob in blobs:
            out |= np.frombuffer(blob, np.uint8)
        return out.tobytes()

    return partition_sketches(words.select("word"), build, merge, fan_in=32)


def _masks(points: np.ndarray) -> np.ndarray:
    return np.bitwise_or.reduce(_MASK[points], axis=1).view(np.int64)


def _reduced(words: DataFrame) -> DataFrame:
    """``key, mask`` beside ``word, n``."""
    def run(batches):
        for batch in batches:
            keys, masks = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for places, points in _by_length(batch.column(0).to_pylist()):
                keys[places], masks[places] = own_keys(_SYMBOL[points]).view(np.int64), _masks(points)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys), pa.array(masks)],
                                             names=["near", "near_n", "key", "near_mask"])

    return words.select("word", "n").mapInArrow(run, "near string, near_n long, key long, near_mask long")


def _generated(words: DataFrame, bitmap, log: int) -> DataFrame:
    """``word, mask, key`` for every neighbour of a word's reduced form that the vocabulary may hold."""
    def run(batches):
        seen = np.unpackbits(np.frombuffer(bitmap.value, np.uint8)).view(bool)
        for batch in batches:
            column = batch.column(0)
            for places, points in _by_length(column.to_pylist()):
                masks = _masks(points)
                rows, keys = [], []
                for at, found in neighbour_keys(_SYMBOL[points]):
                    held = seen[_bits(found, log)]
                    rows.append(at[held])
                    keys.append(found[held])
                rows, keys = np.concatenate(rows), np.concatenate(keys)
                if points.shape[1] >= EXACT:  # two hashed neighbours of one word may collide
                    rows, keys = np.unique(np.stack([rows.astype(np.uint64), keys]), axis=1)
                    rows = rows.astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [column.take(pa.array(places[rows])), pa.array(masks[rows]), pa.array(keys.view(np.int64))],
                    names=["word", "mask", "key"])

    return words.select("word").mapInArrow(run, "word string, mask long, key long")


def near_words(words: DataFrame) -> DataFrame:
    """``word, near, near_n`` for every ordered pair of words exactly one edit apart.

    ``words`` holds distinct ``word, n``; the words consist of code points up
    to U+00FF. A letter mask parts most pairs of unlike words in the join; the
    distance of the others is computed on the words.
    """
    total = words.count()
    log = int(np.clip(np.ceil(np.log2(16 * total + 1)), 16, np.log2(MAX_BITS)))
    bitmap = words.sparkSession.sparkContext.broadcast(_bitmap(words, log))
    return (_generated(words, bitmap, log).join(_reduced(words), "key")
            .filter((F.bit_count(F.col("mask").bitwiseXOR(F.col("near_mask"))) <= 2) & (F.col("word") != F.col("near")))
            .filter(F.levenshtein("word", "near", 1) == 1).select("word", "near", "near_n"))


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of words with a form: the last of the forms, by doubling the steps.

    A form occurs at least twice as often as its word, so the chains are short
    and without cycles.
    """
    ahead = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        further = ahead.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        moved = cut(ahead.join(further, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"),
                                                              F.col("beyond").isNotNull().alias("moved")))
        ahead = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return ahead


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of the vocabulary.

    A word's form is its near word of largest count if that is at least twice
    its own, equal counts to the smaller word in code-point order; the root
    follows forms to the last. A missing text holds no word, an empty one
    neither; a missing id digests as an empty one. Rows that repeat an id and a
    text each add their occurrences. Texts and words of any length are read
    whole. An empty table gives no rows; other columns are not read.
    """
    words = cut(vocabulary_counts(docs, id_col, text_col, min_length, min_count))
    best = (near_words(words).groupBy("word")
            .agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
            .select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.less")).alias("near_n")))
    strong = F.col("near_n") >= 2 * F.col("n")
    formed = cut(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(strong, F.col("near")).alias("form"), F.when(strong, F.col("near_n")).alias("form_n")))
    return (formed.join(_roots(formed.filter("form is not null")), "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
