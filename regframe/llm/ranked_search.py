"""Ranked lexical search by pipelined term partitioning.

Terms are dealt to owners by their share of the documents, rare terms first.
A document belongs to one block of at most ``BLOCK`` documents, and an owner
keeps, for each block and term, the documents and their weight fractions. An
item travels as one bundle a block: a sparse accumulator of document scores.
The bundles visit the owners one after the other; at each a cogroup by block
brings them beside the owner's postings, which add integer contributions.

A bundle drops a document when its score and the largest contributions that
later owners could still add stay below the bundle's own k-th score. Scores
only grow, so such a document is none of the k, and results are exact. What a
bundle carries, what a task holds and what an owner adds are bounded by the
block, however common a term is. The last stage brings each bundle's k best to
the ids of its block, and the best of all blocks are the result.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, quoted, shared_folder

BLOCK = 4096                    # documents of a block, at most
BLOCK_POSTINGS = 1 << 21        # a block closes early at so many postings
PART = 256                      # items that share a cogroup key, about
WAVE_TERMS = 1 << 20            # (item, term) pairs whose terms are broadcast at once; more items go in further waves
OWNERS = (2 ** -8, 2 ** -5, 2 ** -3)  # shares of the documents that part the owners, rare to common

#: Bytes to terms: A-Z in lower case, other letters, digits and bytes from 0x80 stay, the rest separates.
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
              for b in range(256))

_BUNDLE = "block long, part int, slot int, docs binary, scores binary"


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text, in order."""
    return text.translate(_FOLD).split()


def _texts(batch: pa.RecordBatch, at: int) -> list[bytes | None]:
    return batch.column(at).cast(pa.binary()).to_pylist()


def _item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Distinct ``item, term``."""
    kind = items.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows, terms = [], []
            for i, text in enumerate(_texts(batch, 1)):
                found = sorted(set(terms_of(text))) if text else []
                rows += [i] * len(found)
                terms += found
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(terms, pa.binary())], names=["item", "term"])

    return (items.select(F.col(quoted(id_col)).alias("item"), F.col(quoted(text_col)).cast("string").alias("text"))
            .mapInArrow(run, f"item {kind}, term binary").distinct())


def _statistics(docs: DataFrame, wanted) -> DataFrame:
    """``term, df, top``: documents with a wanted term and its most occurrences in one.

    The row without a term holds the number of documents with terms, and the
    number of all their terms.
    """
    def run(batches):
        df, top, n, total = Counter(), {}, 0, 0
        for batch in batches:
            for text in _texts(batch, 1):
                words = terms_of(text) if text else ()
                if not words:
                    continue
                n += 1
                total += len(words)
                for term, tf in Counter(filter(wanted.value.__contains__, words)).items():
                    df[term] += 1
                    if tf > top.get(term, 0):
                        top[term] = tf
        yield pa.RecordBatch.from_arrays(
            [pa.array([None, *df], pa.binary()), pa.array([n, *df.values()], pa.int64()),
             pa.array([total, *map(top.__getitem__, df)], pa.int64())], names=["term", "df", "top"])

    return (docs.mapInArrow(run, "term binary, df long, top long").groupBy("term")
            .agg(F.sum("df").alias("df"), F.max("top").alias("top"), F.sum("top").alias("total")))


def _block_rows(block: int, ids: pa.Array, found: list, owner: dict, documents: int, total: int):
    """A block's row of ids, and a row of documents and weight fractions for each term."""
    order = pc.sort_indices(ids, null_placement="at_end").to_numpy()
    terms = sorted({t for doc, _ in found for t in doc})
    number = {t: i for i, t in enumerate(terms)}
    sizes = [len(found[i][0]) for i in order]
    term = np.fromiter((number[t] for i in order for t in found[i][0]), np.int64, sum(sizes))
    tf = np.fromiter((c for i in order for c in found[i][0].values()), np.int64, sum(sizes))
    n = np.fromiter((found[i][1] for i in order), np.int64, len(order))
    doc = np.repeat(np.arange(len(order)), sizes)
    m = (50 + (50 * n * documents) // max(1, total))[doc]
    part = (1_000_000_000 * tf) // (1000 * tf + 20 * m)
    by = np.argsort(term, kind="stable")
    ends = np.searchsorted(term[by], np.arange(len(terms) + 1))
    doc, part = doc[by].astype(np.uint16), part[by].astype(np.int32)
    return pa.RecordBatch.from_arrays(
        [pa.array([-1, *(owner[t] for t in terms)], pa.int32()), pa.array([block] * (len(terms) + 1), pa.int64()),
         pa.array([None, *terms], pa.binary()),
         pa.array([None, *(doc[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:]))], pa.binary()),
         pa.array([None, *(part[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:]))], pa.binary()),
         pa.array([ids.take(pa.array(order)).to_pylist(), *[None] * len(terms)], pa.list_(ids.type))],
        names=["owner", "block", "term", "docs", "fractions", "ids"])


def _postings(docs: DataFrame, owners, documents: int, total: int) -> tuple[DataFrame, str]:
    """``owner, block, term, docs, fractions, ids`` of every block."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches):
        from pyspark import TaskContext
        owner = owners.value
        block = TaskContext.get().partitionId() << 32
        ids, found, size = [], [], 0

        def close():
            return _block_rows(block, pa.concat_arrays(ids), found, owner, documents, total)

        for batch in batches:
            start = 0
            for i, text in enumerate(_texts(batch, 1)):
                words = terms_of(text) if text else ()
                tf = Counter(filter(owner.__contains__, words))
                found.append((tf, len(words)))
                size += len(tf)
                if len(found) == BLOCK or size >= BLOCK_POSTINGS:
                    ids.append(batch.column(0).slice(start, i + 1 - start))
                    yield close()
                    block, start, ids, found, size = block + 1, i + 1, [], [], 0
            ids.append(batch.column(0).slice(start))
        if found:
            yield close()

    schema = f"owner int, block long, term binary, docs binary, fractions binary, ids array<{kind}>"
    return docs.mapInArrow(run, schema), schema


def _adder(k: int):
    """One stage of the pipeline for one block and one part of the items."""
    def add(left: pa.Table, right: pa.Table) -> pa.Table:
        held = {s: (np.frombuffer(d, np.uint16), np.frombuffer(v, np.int64)) for s, d, v in zip(
            left["slot"].to_pylist(), left["docs"].to_pylist(), left["scores"].to_pylist())}
        rest: dict = {}
        for slots, rests in zip(right["slots"].to_pylist(), right["rests"].to_pylist()):
            rest.update(zip(slots, rests))
        row = {s: i for i, s in enumerate(rest)}
        score = np.zeros((len(row), BLOCK), np.int64)
        for s, i in row.items():
            if s in held:
                score[i, held[s][0]] = held[s][1]
        for slots, w, docs, part in zip(right["slots"].to_pylist(), right["w"].to_pylist(),
                                        right["docs"].to_pylist(), right["fractions"].to_pylist()):
            at = np.fromiter(map(row.__getitem__, slots), np.intp, len(slots))
            score[at[:, None], np.frombuffer(docs, np.uint16)[None, :]] += w * np.frombuffer(part, np.int32).astype(np.int64)
        for s, i in row.items():
            docs = np.flatnonzero(score[i])
            own = score[i, docs]
            if len(docs) > k:
                stay = own + rest[s] >= np.partition(own, -k)[-k]
                docs, own = docs[stay], own[stay]
            held[s] = docs.astype(np.uint16), own
        either = left if left.num_rows else right
        n = len(held)
        return pa.table({"block": pa.array([either["block"][0].as_py()] * n, pa.int64()),
                         "part": pa.array([either["part"][0].as_py()] * n, pa.int32()),
                         "slot": pa.array(list(held), pa.int32()),
                         "docs": pa.array([d.tobytes() for d, _ in held.values()], pa.binary()),
                         "scores": pa.array([v.tobytes() for _, v in held.values()], pa.binary())})

    return add


def _selector(k: int, kind: pa.DataType):
    """The k best of each bundle of a block, with the documents' ids."""
    def select(left: pa.Table, right: pa.Table) -> pa.Table:
        ids = right["ids"].combine_chunks().flatten() if right.num_rows else pa.array([], kind)
        part, slot, doc, score = [], [], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for p, s, d, v in zip(left["part"].to_pylist(), left["slot"].to_pylist(),
                              left["docs"].to_pylist(), left["scores"].to_pylist()):
            d, v = np.frombuffer(d, np.uint16).astype(np.int64), np.frombuffer(v, np.int64)
            best = np.lexsort((d, -v))[:k]
            doc.append(d[best])
            score.append(v[best])
            part += [p] * len(best)
            slot += [s] * len(best)
        return pa.table({"part": pa.array(part, pa.int32()), "slot": pa.array(slot, pa.int32()),
                         "doc": ids.take(pa.array(np.concatenate(doc))), "score": pa.array(np.concatenate(score))})

    return select


def _wave(spark: SparkSession, docs: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """``item, rank, doc, score`` of the items of ``pairs``."""
    kind = docs.schema["id"].dataType
    wanted = [bytes(r[0]) for r in pairs.select("term").distinct().collect()]  # at most about WAVE_TERMS
    stats = cut(_statistics(docs, spark.sparkContext.broadcast(frozenset(wanted))))
    whole = stats.filter("term is null").first()
    documents, total = (whole["df"], whole["total"]) if whole else (0, 0)
    share = F.col("df") / F.lit(float(max(1, documents)))
    owner = sum((share >= edge).cast("int") for edge in OWNERS)
    terms = stats.filter("term is not null").select(
        "term", owner.alias("owner"),
        F.floor(1000 * F.log((2.0 * documents + 2) / (2 * F.col("df") + 1))).cast("long").alias("w"),
        (F.ceil(1e9 * F.col("top") / (1000 * F.col("top") + 1000)) + 1).cast("long").alias("most"))
    owners = {bytes(r["term"]): r["owner"] for r in terms.select("term", "owner").collect()}
    path = shared_folder(spark, "postings")
    made, schema = _postings(docs, spark.sparkContext.broadcast(owners), documents, total)
    made.write.partitionBy("owner").parquet(path)
    postings = spark.read.schema(schema).parquet(path)

    # items in parts of about PART, numbered within theirs; what each owner's successors can still add
    parts = max(1, -(-pairs.select("item").distinct().count() // PART))
    slots = (pairs.select("item").distinct().withColumn("part", F.pmod(F.xxhash64("item"), F.lit(parts)).cast("int"))
             .withColumn("slot", F.row_number().over(Window.partitionBy("part").orderBy("item"))))
    weighed = pairs.join(terms, "term")
    later = weighed.groupBy("item").agg(*[
        F.sum(F.when(F.col("owner") > s, F.col("w") * F.col("most")).otherwise(0)).alias(f"rest{s}")
        for s in range(len(OWNERS) + 1)])
    slots = cut(slots.join(later.withColumnRenamed("item", "same"), F.col("item").eqNullSafe(F.col("same"))).drop("same"))
    weighed = weighed.join(slots.withColumnRenamed("item", "same"), F.col("item").eqNullSafe(F.col("same"))).drop("same")

    bundles = spark.createDataFrame([], _BUNDLE)
    for s in range(len(OWNERS) + 1):
        visit = (weighed.filter(F.col("owner") == s).groupBy("part", "term", "w")
                 .agg(F.sort_array(F.collect_list(F.struct("slot", F.col(f"rest{s}").alias("rest")))).alias("seats"))
                 .select("part", "term", "w", F.col("seats.slot").alias("slots"), F.col("seats.rest").alias("rests")))
        owned = (postings.filter(F.col("owner") == s).select("block", "term", "docs", "fractions")
                 .join(visit, "term").drop("term"))
        bundles = (bundles.groupBy("block", "part").cogroup(owned.groupBy("block", "part"))
                   .applyInArrow(_adder(k), _BUNDLE))
    named = postings.filter("owner = -1").select("block", "ids")
    from pyspark.sql.pandas.types import to_arrow_type
    chosen = (bundles.groupBy("block").cogroup(named.groupBy("block"))
              .applyInArrow(_selector(k, to_arrow_type(kind)),
                            f"part int, slot int, doc {kind.simpleString()}, score long"))
    best = Window.partitionBy("part", "slot").orderBy(F.col("score").desc(), F.col("doc").asc_nulls_last())
    ranked = chosen.filter("score > 0").withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.join(slots, ["part", "slot"]).select("item", "rank", "doc", "score")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text",
                   item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``item, rank, doc, score``: the ``k`` highest-scoring documents of every item.

    Each row of ``docs`` is a document of its own, also when its id or text
    repeats or is missing; a missing or empty text has no terms and is never
    found. Rows of ``items`` with one id, or with none, are one item with the
    terms of all their texts; an item without terms, or whose terms occur
    nowhere, has no rows. Equal scores rank by ascending id, missing ids last.
    Empty tables give no rows. Texts of any length are read whole; other
    columns are not read. The two result columns of ids are named after the
    tables' own.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).cast("string").alias("text"))
    pairs = cut(_item_terms(items, item_col, item_text_col))
    waves = max(1, -(-pairs.count() // WAVE_TERMS))
    found = None
    for wave in range(waves):
        mine = pairs.filter(F.pmod(F.xxhash64("item", F.lit(1)), F.lit(waves)) == wave) if waves > 1 else pairs
        ranked = _wave(spark, rows, mine, k)
        found = ranked if found is None else found.unionByName(ranked)
    return found.select(F.col("item").alias(item_col), "rank", F.col("doc").alias(id_col), "score")
