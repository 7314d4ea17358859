"""Removal of repeated passages of whole lines.

Every line is a chunk. A window is a shortest run of lines with at least
``min_words`` words: one begins at each line that holds a word, and one ends at
each. A passage of that many words that stands in two places holds windows that
cover all its lines, wherever it stands and whatever is around it, so the union
of the repeated windows is the union of the repeated passages. Lines without a
word bridge a window and count for nothing.

Equal window hashes meet in an aggregate that combines on the map side. The
repeated windows of a text are thinned to pieces that cover the same lines once,
the bytes of a piece are compared with those of the copy that stays, and the
lines of verified pieces leave the text. The first copy by document id and place
stays; every line that goes has an equal one before it that stays. A window that
overlaps its own first copy stays as well.
"""

from __future__ import annotations

from itertools import accumulate

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, quoted

MIN_WORDS = 20
BITMAP = 1 << 17      # words of 64 bits in the bitmap of wanted keys


def chunks(text: str | None) -> list[str]:
    """The lines of a text; joined by line breaks they give it back."""
    return text.split("\n") if text else []


def worded(text: str | None) -> list[str]:
    """The lines that hold a word; places count these."""
    return [line for line in chunks(text) if line.strip()]


def windows(text: str | None, min_words: int = MIN_WORDS) -> list[tuple[int, int, bytes]]:
    """``at, stop, hash`` of the shortest runs of enough words from each line on and up to each line."""
    lines = worded(text)
    total = [0, *accumulate(len(line.split()) for line in lines)]
    spans = set()
    stop = 0
    for at in range(len(lines)):
        stop = max(stop, at)
        while stop < len(lines) and total[stop + 1] - total[at] < min_words:
            stop += 1
        if stop == len(lines):
            break
        spans.add((at, stop))
    at = 0
    for stop in range(len(lines)):
        while at < stop and total[stop + 1] - total[at + 1] >= min_words:
            at += 1
        if total[stop + 1] - total[at] >= min_words:
            spans.add((at, stop))
    if not spans:
        return []
    own = [xxhash.xxh3_128_digest(line.encode("utf-8", "surrogatepass")) for line in lines]
    return [(at, stop, own[at] if at == stop else xxhash.xxh3_128_digest(b"".join(own[at:stop + 1])))
            for at, stop in sorted(spans)]


def _window_rows(rows: DataFrame, min_words: int) -> DataFrame:
    """``key, at, stop, hash`` of every window."""
    def run(batches):
        for batch in batches:
            of, ats, stops, hashes = [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                for at, stop, own in windows(text, min_words):
                    of.append(i)
                    ats.append(at)
                    stops.append(stop)
                    hashes.append(own)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(of, pa.int64())), pa.array(ats, pa.int32()),
                 pa.array(stops, pa.int32()), pa.array(hashes, pa.binary())], names=["key", "at", "stop", "hash"])

    kind = rows.schema["key"].dataType.simpleString()
    return rows.select("key", "text").mapInArrow(run, f"key {kind}, at int, stop int, hash binary")


def pieces(places: list[dict]) -> list[dict]:
    """Parts of windows sorted by ``at`` that cover their lines once; ``skip`` lines of the window lie before."""
    out, done, i = [], -1, 0
    while True:
        best = None
        while i < len(places) and places[i]["at"] <= done + 1:
            if best is None or places[i]["stop"] > best["stop"]:
                best = places[i]
            i += 1
        if best is not None and best["stop"] > done:
            at = max(best["at"], done + 1)
            out.append({**best, "at": at, "skip": at - best["at"]})
            done = best["stop"]
        elif i < len(places):
            done = places[i]["at"] - 1
        else:
            return out


def _piece_rows(places: DataFrame) -> DataFrame:
    """``key, at, stop, hash, skip`` of the pieces of each ``key, places``."""
    def run(batches):
        for batch in batches:
            of, kept = [], []
            for i, held in enumerate(batch.column(1).to_pylist()):
                for piece in pieces(held):
                    of.append(i)
                    kept.append(piece)
            ints = [pa.array([p[name] for p in kept], pa.int32()) for name in ("at", "stop", "skip")]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(of, pa.int64())), *ints, pa.array([p["hash"] for p in kept], pa.binary())],
                names=["key", "at", "stop", "skip", "hash"])

    kind = places.schema["key"].dataType.simpleString()
    return places.mapInArrow(run, f"key {kind}, at int, stop int, skip int, hash binary")


def _bodies(texts: DataFrame) -> DataFrame:
    """``key, at, stop, body, n_words`` of the ``spans`` of each text."""
    def run(batches):
        for batch in batches:
            of, ats, stops, bodies, words = [], [], [], [], []
            for i, (text, wanted) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                own = worded(text)
                for span in wanted:
                    body = "\n".join(own[span["at"]:span["stop"] + 1])
                    of.append(i)
                    ats.append(span["at"])
                    stops.append(span["stop"])
                    bodies.append(body)
                    words.append(len(body.split()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(of, pa.int64())), pa.array(ats, pa.int32()), pa.array(stops, pa.int32()),
                 pa.array(bodies, pa.string()), pa.array(words, pa.int32())],
                names=["key", "at", "stop", "body", "n_words"])

    kind = texts.schema["key"].dataType.simpleString()
    return texts.select("key", "text", "spans").mapInArrow(
        run, f"key {kind}, at int, stop int, body string, n_words int")


def _may_be_among(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """All rows whose key is among the keys, and few others: a bitmap of fixed size, broadcast, tells them.

    It only spares the shuffle of most other rows' texts; a join by key must follow.
    """
    h = F.xxhash64("key")
    word, bit = F.pmod(h, F.lit(BITMAP)).alias("word"), F.shiftrightunsigned(h, 58).cast("int").alias("bit")
    bitmap = (keys.select(word, bit).groupBy("word")
              .agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")))
    return (rows.select("*", word, bit).join(F.broadcast(bitmap), "word")
            .filter("(bits & shiftleft(1L, bit)) <> 0").select(*rows.columns))


def repeated_places(rows: DataFrame, min_words: int) -> DataFrame:
    """``key, at, stop, n_words`` of lines to remove: verified copies of lines kept elsewhere."""
    found = _window_rows(rows, min_words)  # made twice, which is cheaper than to store it
    first = cut(found.groupBy("hash").agg(F.min(F.struct("key", "at", "stop")).alias("first"), F.count("*").alias("n"))
                .filter("n > 1").select("hash", "first"))
    apart = (F.col("key") != F.col("first.key")) | (F.col("at") > F.col("first.stop"))
    copies = (found.join(first, "hash").filter(apart)
              .groupBy("key").agg(F.sort_array(F.collect_list(F.struct("at", "stop", "hash"))).alias("places")))
    gone = cut(_piece_rows(copies))
    at = F.col("first.at") + F.col("skip")
    kept = cut(first.join(gone.select("hash", "skip", (F.col("stop") - F.col("at")).alias("more")).distinct(), "hash")
               .select("hash", "skip", "first.key", at.alias("at"), (at + F.col("more")).alias("stop")))
    wanted = (gone.select("key", "at", "stop").unionByName(kept.select("key", "at", "stop"))
              .groupBy("key").agg(F.collect_set(F.struct("at", "stop")).alias("spans")))
    # one row per key: rows that repeat an id and its text have the same lines
    near = _may_be_among(rows, gone.select("key").unionByName(kept.select("key")))
    bodies = cut(_bodies(near.join(wanted, "key").dropDuplicates(["key"])))
    kept_bodies = kept.join(bodies, ["key", "at", "stop"]).select("hash", "skip", F.col("body").alias("kept_body"))
    return (gone.join(bodies, ["key", "at", "stop"]).join(kept_bodies, ["hash", "skip"])
            .filter(F.col("body") == F.col("kept_body")).select("key", "at", "stop", "n_words"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                min_words: int = MIN_WORDS) -> DataFrame:
    """All columns of ``docs`` with the text cleaned, and ``chunks_removed, words_removed``.

    Removed chunks are lines that hold a word; lines without one between them go too.

    A missing text stays missing and an empty one empty; a text may become
    empty. Rows with the same id and text count as one document. Ids order the
    copies; rows with a missing id keep their text and serve no other row.
    Other columns pass through whatever their names; columns that bear the two
    new names are replaced.
    """
    text = F.col(quoted(text_col)).cast("string")
    key = F.struct(F.col(quoted(id_col)).alias("id"), F.xxhash64(text).alias("h"))
    rows = docs.filter(F.col(quoted(id_col)).isNotNull()).select(key.alias("key"), text.alias("text"))
    gone = cut(repeated_places(rows, min_words).groupBy("key")
               .agg(F.collect_set(F.struct("at", "stop")).alias("spans"), F.sum("n_words").alias("words"),
                    F.sum(F.col("stop") - F.col("at") + 1).cast("int").alias("lines")))
    packed = docs.select(key.alias("key"), F.struct("*").alias("row"))
    joined = packed.join(gone, "key", "left")
    fields = [f for f in docs.schema.fields if f.name not in ("chunks_removed", "words_removed")]
    cleaned = _cleaned(F.col("row")[text_col].cast("string"), F.col("spans"))
    return joined.select(*[(cleaned if f.name == text_col else F.col("row")[f.name]).alias(f.name) for f in fields],
                         F.coalesce("lines", F.lit(0)).alias("chunks_removed"),
                         F.coalesce("words", F.lit(0)).alias("words_removed"))


def without(text: str, spans: list[dict]) -> str:
    """The text without the lines of the spans, and without those between two of them that hold no word."""
    drop = {at for span in spans for at in range(span["at"], span["stop"] + 1)}
    out, at = [], 0
    for line in chunks(text):
        if line.strip():
            if at not in drop:
                out.append(line)
            at += 1
        elif not (at - 1 in drop and at in drop):
            out.append(line)
    return "\n".join(out)


def _cleaned(text, spans):
    """The text without the listed lines; rows that lose none stay in the JVM's hands."""
    @F.pandas_udf("string")
    def cleaned(texts: pd.Series, places: pd.Series) -> pd.Series:
        return pd.Series([body if body is None or gone is None or not len(gone) else without(body, gone)
                          for body, gone in zip(texts, places)], dtype=object)

    return F.when(spans.isNull(), text).otherwise(cleaned(F.when(spans.isNotNull(), text), spans))
