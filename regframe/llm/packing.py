"""Order-preserving packing of documents into training sequences.

Each input partition is one stream of documents, so nothing is shuffled. Cuts
may fall at document ends (free), sentence ends (cheap) and, so that every
text can be cut, on a token grid (dear). A dynamic program over these places
minimises padding plus cut penalties:

    f(j) = min over i with p(j) - p(i) <= length of
           f(i) + length - (p(j) - p(i)) + penalty(j)

``f(i) + p(i)`` is the only term that depends on i, so a monotone queue over
the sliding window gives each minimum in constant time. The program runs over
``horizon`` tokens at a time; the last, open sequence moves to the next run.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import quoted
from .tokens import codec

SENTENCE_PENALTY = 2.0
INSIDE_PENALTY = 24.0
GRID = 64
HORIZON = 1 << 19
SENTENCE_ENDS = ".!?。！？"

_ENDS: dict[str, np.ndarray] = {}


def sentence_end_ids(path: str) -> np.ndarray:
    """For each id of the vocabulary, whether its token ends a sentence."""
    if path not in _ENDS:
        tok = codec(path).tok
        vocab = tok.get_vocab(with_added_tokens=True)
        table = np.zeros(max(vocab.values(), default=0) + 1, bool)
        for token, i in vocab.items():
            table[i] = token.removesuffix("</w>")[-1:] in tuple(SENTENCE_ENDS)
        _ENDS[path] = table
    return _ENDS[path]


def cut_places(ids: np.ndarray, doc_ends: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places where a sequence may end, ascending from 0, and the penalty of each."""
    penalty = np.full(len(ids) + 1, np.inf)
    penalty[0::GRID] = INSIDE_PENALTY
    penalty[1:][ends[np.minimum(ids, len(ends) - 1)]] = SENTENCE_PENALTY
    penalty[doc_ends] = 0.0
    penalty[0] = penalty[-1] = 0.0
    places = np.flatnonzero(penalty < np.inf)
    return places, penalty[places]


def best_cuts(places: np.ndarray, penalties: np.ndarray, length: int) -> np.ndarray:
    """Ends of the sequences of a cheapest cutting; the last place is always one."""
    at, cost = places.tolist(), penalties.tolist()
    total = [0.0] * len(at)
    came = [0] * len(at)
    queue: deque = deque([0])
    lead = [0.0] * len(at)
    for j in range(1, len(at)):
        p = at[j]
        low = p - length
        while at[queue[0]] < low:
            queue.popleft()
        i = queue[0]
        came[j] = i
        total[j] = t = lead[i] + length - p + cost[j]
        lead[j] = t = t + p
        while queue and lead[queue[-1]] >= t:
            queue.pop()
        queue.append(j)
    cuts, j = [], len(at) - 1
    while j > 0:
        cuts.append(at[j])
        j = came[j]
    return np.array(cuts[::-1], np.int64)


class _Stream:
    """Documents of one partition, cut and numbered as they come."""

    def __init__(self, partition: int, length: int, ends: np.ndarray):
        self.next_id, self.length, self.ends = partition << 33, length, ends
        self.docs: list[tuple] = []   # id, ids, start in the document, tokens of the document
        self.held = 0

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.docs.append((doc_id, ids, 0, len(ids)))
        self.held += len(ids)

    def flush(self, last: bool) -> Iterator[tuple]:
        """``(doc_id, start, ids, doc_tokens, sequence_id, offset)`` of closed sequences."""
        if not self.docs:
            return
        ids = np.concatenate([d[1] for d in self.docs])
        doc_ends = np.cumsum([len(d[1]) for d in self.docs])
        cuts = best_cuts(*cut_places(ids, doc_ends, self.ends), self.length)
        stop = len(ids) if last else (int(cuts[-2]) if len(cuts) > 1 else 0)
        cuts = cuts[cuts <= stop]
        all_ends = np.union1d(cuts, doc_ends[doc_ends <= stop]) if len(cuts) else cuts
        starts = np.concatenate([[0], all_ends[:-1]]).astype(np.int64) if len(all_ends) else all_ends
        doc_of = np.searchsorted(doc_ends, starts, "right")
        seq_of = np.searchsorted(cuts, starts, "right")
        seq_start = np.concatenate([[0], cuts])
        doc_start = np.concatenate([[0], doc_ends])
        for s, e, d, q in zip(starts.tolist(), all_ends.tolist(), doc_of.tolist(), seq_of.tolist()):
            doc_id, _, before, tokens = self.docs[d]
            yield (doc_id, before + s - int(doc_start[d]), ids[s:e], tokens,
                   self.next_id + q, s - int(seq_start[q]))
        self.next_id += len(cuts)
        rest = []
        for k in range(int(np.searchsorted(doc_ends, stop, "right")), len(self.docs)):
            doc_id, own, before, tokens = self.docs[k]
            gone = max(0, stop - int(doc_start[k]))
            rest.append((doc_id, own[gone:], before + gone, tokens))
        self.docs, self.held = rest, len(ids) - stop


def _pieces(batches, path: str, length: int, end_id: int, horizon: int) -> Iterator[tuple]:
    from pyspark import TaskContext
    own = codec(path)
    stream = _Stream(TaskContext.get().partitionId(), length, sentence_end_ids(path))
    tail = np.array([end_id], np.uint32).tobytes()
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            stream.add(doc_id, np.frombuffer(own.ids(text) + tail, np.uint32))
            if stream.held >= horizon:
                yield from stream.flush(False)
    yield from stream.flush(True)


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).cast("string").alias("text"))


def packed_pieces(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text",
                  length: int = 2048, end_id: int = 1, horizon: int = HORIZON) -> DataFrame:
    """One row per piece of a document: where its ids lie and their CRC-32.

    A missing or empty text is the end id alone. Repeated rows are packed as
    often as they occur. ``sequence_id`` is unique across partitions; offsets
    within a sequence run from 0 without gaps.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        rows: list[tuple] = []

        def out():
            cols = list(zip(*rows))
            return pa.RecordBatch.from_arrays(
                [pa.array(cols[0], id_type)] + [pa.array(c, pa.int64()) for c in cols[1:]],
                names=["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for doc_id, start, ids, tokens, seq, offset in _pieces(batches, vocab_path, length, end_id, horizon):
            rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4", copy=False).tobytes()),
                         tokens, seq, offset))
            if len(rows) >= 20_000:
                yield out()
                rows = []
        if rows:
            yield out()

    from pyspark.sql.pandas.types import to_arrow_type
    id_type = to_arrow_type(docs.schema[id_col].dataType)
    found = _documents(docs, id_col, text_col).mapInArrow(
        run, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return found.withColumnRenamed("id", id_col)


def packed_sequences(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text",
                     length: int = 2048, end_id: int = 1, pad_id: int = 0,
                     horizon: int = HORIZON) -> DataFrame:
    """The sequences themselves: ``sequence_id, n_tokens, ids`` padded to ``length``."""
    def run(batches):
        seqs: dict[int, list] = {}

        def out(done):
            got = [np.concatenate(v) for v in done.values()]
            padded = [np.pad(g, (0, length - len(g)), constant_values=pad_id).astype(np.int32) for g in got]
            return pa.RecordBatch.from_arrays(
                [pa.array(list(done), pa.int64()), pa.array([len(g) for g in got], pa.int64()),
                 pa.array(padded, pa.list_(pa.int32()))], names=["sequence_id", "n_tokens", "ids"])

        for _, _, ids, _, seq, _ in _pieces(batches, vocab_path, length, end_id, horizon):
            if seq not in seqs and len(seqs) >= 256:
                yield out(seqs)
                seqs = {}
            seqs.setdefault(seq, []).append(ids)
        if seqs:
            yield out(seqs)

    return _documents(docs, id_col, text_col).mapInArrow(
        run, "sequence_id long, n_tokens long, ids array<int>")
