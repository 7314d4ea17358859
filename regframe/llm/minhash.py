"""Near-duplicate texts by improved consistent weighted sampling.

A text is a weighted set of five-word shingles. A shingle weighs its count times
the mean inverse document frequency of its words, counted over all texts. Words
in less than ``RARE`` of the texts share the highest frequency weight, so the
table of the others is bounded by (mean distinct words of a text) / ``RARE``
and can be broadcast.

Consistent weighted samples agree with a probability equal to the weighted
Jaccard similarity. ``BANDS`` bands of ``ROWS`` samples make candidates; a pair
at 0.8 is missed with a probability of (1 - 0.8^3)^16, 1 in 97,000. A candidate
must also agree in ``AGREE`` of all samples, compared byte by byte inside the
join; a pair at 0.8 does not with a probability of 1e-5. What is left is
compared exactly on the texts, and links of at least ``threshold`` join classes.

Equal texts are one node. A bucket never makes all its pairs: its members meet
a few leaders a round, and buckets whose members already share a class are done.
Shingles that no other open text holds count for the union of a pair alone, which
bounds the similarity; texts and pairs that cannot reach the threshold leave.
Only the texts of open buckets and of pairs that passed the join are ever moved.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, quoted, shared_folder, short_shuffles, small_batches
from .components import components

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 16, 3
RARE = 1e-3
AGREE = 26            # of the BANDS * ROWS samples
LEADERS = 4           # members of a mixed bucket that all others meet in the first round
GROWTH = 4            # times as many in the next
SEMI_BYTES = 32 << 20  # node lists up to this size are broadcast to the documents, larger ones are joined by shuffle
BATCH = 512           # texts, or pairs of texts, handed to Python at once
WORDS_HELD = 1 << 21  # distinct words of texts, 8 bytes each, that a task counts before it hands on the counts
SIG_WORDS = -(-BANDS * ROWS // 7)
_SIG = [f"s{i}" for i in range(SIG_WORDS)]
_LOW = 0x007F7F7F7F7F7F7F
_BLOCK = 4096
_DRAW_BITS = 16
_DRAWS = 1 << _DRAW_BITS
_MIX = np.uint64(0x94D049BB133111EB)
#: Whether a code point parts words; all that do lie below the last entry.
_SPACE = np.array([chr(c).isspace() for c in range(0x3001)] + [False])
_POWERS = np.multiply.accumulate(np.full(256, np.uint64(0xD1342543DE82EF95)))


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of every word of the lower-cased text, in order; words as ``str.split`` parts them."""
    x = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = np.zeros(len(x) + 2, bool)
    inside[1:-1] = ~_SPACE[np.minimum(x, len(_SPACE) - 1)]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, size = edges[::2], edges[1::2] - edges[::2]
    if not len(starts):
        return np.empty(0, np.uint64)
    first = np.cumsum(size) - size
    within = np.arange(int(size.sum())) - np.repeat(first, size)
    longest = int(size.max())
    power = _POWERS if longest <= len(_POWERS) else np.multiply.accumulate(np.full(longest, _POWERS[0]))
    h = np.add.reduceat((x[inside[1:-1]] + np.uint64(1)) * power[within], first) ^ size.astype(np.uint64)
    h = (h ^ (h >> np.uint64(30))) * _MIX
    return h ^ (h >> np.uint64(31))


class Sampler:
    """Shingle weights of a text, and its consistent weighted samples."""

    def __init__(self, common: bytes, idf: bytes, most: float):
        self.common, self.idf = np.frombuffer(common, np.uint64), np.frombuffer(idf, np.float64)
        self.most = most
        rng = np.random.default_rng(7)
        n = BANDS * ROWS
        r, c, beta = rng.gamma(2.0, 1.0, _DRAWS), rng.gamma(2.0, 1.0, _DRAWS), rng.random(_DRAWS)
        # a shingle's step is t = floor(ln(weight) / r + beta), its value ln c - r (t - beta + 1)
        self.draws = np.stack([r, 1 / r, np.log(c) + r * (beta - 1), beta], axis=1).astype(np.float32)
        self.odd = rng.integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.mix = rng.integers(0, 1 << 63, (4, n), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def shingles(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Distinct shingles, ascending, and their weights."""
        h = word_hashes(text)
        if not len(h):
            return np.empty(0, np.uint64), np.empty(0)
        w = np.full(len(h), self.most)
        if len(self.common):
            at = np.minimum(np.searchsorted(self.common, h), len(self.common) - 1)
            known = self.common[at] == h
            w[known] = self.idf[at[known]]
        k = min(SHINGLE, len(h))
        n = len(h) - k + 1
        code, weight = np.full(n, k, np.uint64), np.zeros(n)
        for i in range(k):
            code = (code ^ h[i:i + n]) * np.uint64(0x9E3779B97F4A7C15)
            code ^= code >> np.uint64(29)
            weight += w[i:i + n]
        order = np.argsort(code)
        code = code[order]
        first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        count = np.diff(np.append(first, n))
        return code[first], count * (weight[order[first]] / k)

    def band_keys(self, text: str) -> list[int] | None:
        """One signed 64-bit key a band; none for a text without words."""
        return self.keys_of(*self.shingles(text))

    def keys_of(self, code: np.ndarray, weight: np.ndarray) -> list[int] | None:
        found = self.signature(code, weight)
        return found and found[0]

    def signature(self, code: np.ndarray, weight: np.ndarray) -> tuple[list[int], list[int]] | None:
        """Band keys, and one byte of each sample, seven to a word (``SIG_WORDS`` words)."""
        if not len(code):
            return None
        n = BANDS * ROWS
        best = np.full(n, np.inf, np.float32)
        at, step = np.zeros(n, np.int64), np.zeros(n, np.float32)
        log_w = np.log(weight).astype(np.float32)
        short = (code ^ (code >> np.uint64(32))).astype(np.uint32)
        rows = np.arange(n)
        for lo in range(0, len(code), _BLOCK):
            # a sample a row, a shingle a column; one gather brings all four draws
            draw = self.draws.take(((self.odd[:, None] * short[None, lo:lo + _BLOCK]) >> np.uint32(32 - _DRAW_BITS)).astype(np.intp), axis=0)
            t = log_w[lo:lo + _BLOCK] * draw[..., 1]
            t += draw[..., 3]
            np.floor(t, out=t)
            log_a = draw[..., 0] * t
            np.subtract(draw[..., 2], log_a, out=log_a)
            i = log_a.argmin(axis=1)
            low = log_a[rows, i]
            better = low < best
            best[better], at[better], step[better] = low[better], i[better] + lo, t[rows, i][better]
        picked = code[at] * self.mix[0] ^ (step.astype(np.int64).astype(np.uint64) * self.mix[1])
        picked ^= picked >> np.uint64(31)
        picked = picked * self.mix[2]
        packed = np.zeros((SIG_WORDS, 8), np.uint8)
        spread = np.zeros(SIG_WORDS * 7, np.uint8)
        spread[:n] = (picked >> np.uint64(56)).astype(np.uint8)
        packed[:, :7] = spread.reshape(SIG_WORDS, 7)
        picked = picked.reshape(BANDS, ROWS)
        keys = picked[:, 0]
        for i in range(1, ROWS):
            keys = (keys ^ (keys >> np.uint64(27))) * np.uint64(0x94D049BB133111EB) + picked[:, i]
        keys = (keys ^ (keys >> np.uint64(30))) + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)
        return keys.view(np.int64).tolist(), packed.view("<i8").ravel().tolist()


def weighted_jaccard(a: tuple, b: tuple) -> float:
    """Sum of minima over sum of maxima of two weighted sets; 0 if both are empty."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    if len(a[0]) > len(b[0]):
        a, b = b, a
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    same = b[0][at] == a[0]
    low = float(np.minimum(a[1][same], b[1][at[same]]).sum())
    high = float(a[1].sum() + b[1].sum()) - low
    return low / high if high > 0 else 0.0


def common_words(texts: DataFrame, rare: float = RARE) -> tuple[bytes, bytes, float]:
    """Hashes of words in at least ``rare`` of the texts, their weights, and the weight of all others."""
    def count(batches):
        held, size = [], 0

        def counted():
            words, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n.astype(np.int32))], names=["word", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.append(np.unique(word_hashes(text)))
                size += len(held[-1])
                if size >= WORDS_HELD:
                    yield counted()
                    held, size = [], 0
        if held:
            yield counted()

    n = texts.count()
    found = (texts.select("text").mapInArrow(count, "word long, n int")
             .groupBy("word").agg(F.sum("n").alias("df")).filter(F.col("df") >= F.lit(rare * n)))
    rows = found.collect()  # at most (mean distinct words of a text) / rare rows
    words = np.array([r["word"] for r in rows], np.int64).view(np.uint64)
    share = np.array([r["df"] for r in rows], float) / max(1, n)
    idf = 1.0 + np.log(1.0 / np.clip(share, rare, 1.0))
    order = np.argsort(words)
    return words[order].tobytes(), idf[order].tobytes(), float(1.0 + np.log(1.0 / rare))


def _signatures(rows: DataFrame, weights: tuple) -> DataFrame:
    """``keys``, the total ``weight`` and the sample bytes beside ``id, node`` of rows with a text."""
    id_type = rows.schema["id"].dataType.simpleString()

    def run(batches):
        sampler = Sampler(*weights)
        for batch in batches:
            keys, total, sig = [], [], []
            for text in batch.column(2).to_pylist():
                code, weight = sampler.shingles(text)
                found = sampler.signature(code, weight)
                keys.append(found and found[0])
                sig.append(found[1] if found else [0] * SIG_WORDS)
                total.append(float(weight.sum()))
            words = np.array(sig, np.int64).reshape(-1, SIG_WORDS)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(keys, pa.list_(pa.int64())), pa.array(total, pa.float64()),
                 *(pa.array(words[:, i]) for i in range(SIG_WORDS))], names=["id", "node", "keys", "weight", *_SIG])

    return rows.select("id", "node", "text").mapInArrow(
        run, f"id {id_type}, node binary, keys array<long>, weight double, " + ", ".join(f"{c} long" for c in _SIG))


def _agreements(left, right):
    """Equal bytes of two lists of words: a word of seven has 56 bits less the zero bytes of the difference."""
    total = F.lit(-(SIG_WORDS * 7 - BANDS * ROWS))  # bytes that no sample uses agree
    for x, y in zip(left, right):
        diff = x.bitwiseXOR(y)
        total = total + (56 - F.bit_count((diff.bitwiseAND(F.lit(_LOW)) + F.lit(_LOW)).bitwiseOR(diff).bitwiseOR(F.lit(_LOW))))
    return total


def _verified(pairs: DataFrame, texts: DataFrame, weights: tuple, threshold: float) -> DataFrame:
    """The pairs ``a, b`` with ``linked``: whether their weighted Jaccard similarity reaches the threshold."""
    def run(batches):
        sampler = Sampler(*weights)
        held: dict = {}
        for batch in batches:
            a, b, ta, tb = (batch.column(i) for i in range(4))
            linked = []
            for name, left, right in zip(b.to_pylist(), ta.to_pylist(), tb.to_pylist()):
                if name not in held:  # leaders come in runs
                    if len(held) >= 64:
                        held.clear()
                    held[name] = sampler.shingles(right)
                linked.append(weighted_jaccard(sampler.shingles(left), held[name]) >= threshold)
            yield pa.RecordBatch.from_arrays([a, b, pa.array(linked, pa.bool_())], names=["a", "b", "linked"])

    with_a = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    with_b = with_a.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    return (with_b.select("a", "b", "text_a", "text_b").mapInArrow(run, "a binary, b binary, linked boolean"))


def _only(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, text`` of the ``nodes``, as often as they occur."""
    nodes = nodes.distinct()
    side = F.broadcast(nodes) if nodes.count() * 64 <= SEMI_BYTES else nodes
    return texts.select("node", "text").join(side, "node", "left_semi")


def _texts_of(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``node, text`` of the nodes in ``pairs``."""
    return _only(texts, pairs.select(F.explode(F.array("a", "b")).alias("node")))


def _own_weights(texts: DataFrame, weights: tuple) -> DataFrame:
    """``node, own``: the weight of its shingles that no other of the ``texts`` holds; nodes without any are left out."""
    def run(batches):
        sampler = Sampler(*weights)
        for batch in batches:
            codes, weight, size = [], [], []
            for text in batch.column(1).to_pylist():
                code, w = sampler.shingles(text)
                codes.append(code)
                weight.append(w)
                size.append(len(code))
            if size:
                halves = np.frombuffer(b"".join(batch.column(0).to_pylist()), ">i8").astype(np.int64).reshape(-1, 2)
                halves = np.repeat(halves, size, axis=0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(codes).view(np.int64)), pa.array(halves[:, 0]), pa.array(halves[:, 1]),
                     pa.array(np.concatenate(weight))], names=["code", "hi", "lo", "weight"])

    alone = (texts.select("node", "text").mapInArrow(run, "code long, hi long, lo long, weight double").groupBy("code")
             .agg(F.count("*").alias("n"), F.max("hi").alias("hi"), F.max("lo").alias("lo"), F.max("weight").alias("weight"))
             .filter("n = 1"))  # the halves of one node then
    whole = F.unhex(F.concat(*(F.lpad(F.hex(c), 16, "0") for c in ("hi", "lo"))))
    return alone.groupBy("hi", "lo").agg(F.sum("weight").alias("own")).select(whole.alias("node"), "own")


def _mixed(rows: DataFrame) -> DataFrame:
    """The ``rows`` of buckets whose members are not all of one class."""
    keys = rows.groupBy("key").agg(F.min("of").alias("lo"), F.max("of").alias("hi")).filter("lo <> hi").select("key")
    return rows.join(keys, "key")


def _overlap_allows(x: str, y: str, threshold: float):
    """Whether two structs' shared weights allow the similarity: their overlap is at most the smaller one."""
    shared = F.least(f"{x}_shared", f"{y}_shared")
    return (1 + threshold) * shared >= (threshold - 1e-9) * (F.col(f"{x}.weight") + F.col(f"{y}.weight"))


def _may_link(a: str, b: str, threshold: float):
    """Whether two structs' total weights allow the similarity, which is at most their ratio, and their samples agree."""
    x, y = F.col(f"{a}.weight"), F.col(f"{b}.weight")
    agree = _agreements([F.col(f"{a}.{c}") for c in _SIG], [F.col(f"{b}.{c}") for c in _SIG])
    return (F.least(x, y) >= (threshold - 1e-9) * F.greatest(x, y)) & (agree >= AGREE)


class _Tables:
    """Tables written to the shared folder, which go when nothing needs them any more."""

    def __init__(self, spark):
        self.spark, self.paths = spark, {}

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        """``df`` written and read back; the table of that name before it is deleted."""
        path = shared_folder(self.spark, f"minhash-{name}")
        df.write.parquet(path)
        old, self.paths[name] = self.paths.get(name), path
        if old:
            discard(self.spark, old)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            if name in self.paths:
                discard(self.spark, self.paths.pop(name))


def _relabelled(label: DataFrame, links: DataFrame) -> DataFrame:
    """``node, component`` after ``links``: components are found over the labels, not over all nodes again."""
    def of(end: str):
        return label.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}"))

    ends = (links.join(of("a"), "a", "left").join(of("b"), "b", "left")
            .select("a", "b", F.coalesce("of_a", "a").alias("x"), F.coalesce("of_b", "b").alias("y")))
    merged = components(ends.select(F.col("x").alias("a"), F.col("y").alias("b")))
    known = label.unionByName(ends.select(F.explode(F.array(
        F.struct(F.col("a").alias("node"), F.col("x").alias("component")),
        F.struct(F.col("b").alias("node"), F.col("y").alias("component")))).alias("e")).select("e.*")).distinct()
    into = merged.select(F.col("node").alias("component"), F.col("component").alias("into"))
    return known.join(into, "component", "left").select("node", F.coalesce("into", "component").alias("component"))


def _apart(pairs: DataFrame, label: DataFrame) -> DataFrame:
    """The ``pairs`` whose ends are not in one component."""
    def of(end: str):
        return label.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}"))

    ends = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return ends.filter(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b")


def _text_node(text):
    return F.unhex(F.md5(text))


def _classes(docs: DataFrame, id_col: str, text_col: str, threshold: float) -> DataFrame:
    """``id, node, class_id, class_size`` of every row; the node is the MD5 of its text."""
    text = F.col(quoted(text_col)).cast("string")
    rows = docs.select(F.col(quoted(id_col)).alias("id"), _text_node(text).alias("node"), text.alias("text"))
    there = rows.filter("text is not null")
    weights = common_words(there)
    spark, tables = docs.sparkSession, _Tables(docs.sparkSession)
    signed = tables.keep("signed", _signatures(there, weights))
    node = signed.filter("keys is not null").dropDuplicates(["node"])
    narrow = node.select("node", F.explode("keys").alias("key"))
    shared = narrow.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    me = F.struct("node", "weight", *_SIG).alias("me")
    member = tables.keep("member", narrow.join(shared, "key").join(node.select("node", "weight", *_SIG), "node").select("key", me))
    # first round: each node and the leader it shares most buckets with
    leader = member.groupBy("key").agg(F.min("me").alias("head"))
    met = (member.join(leader, "key").filter((F.col("me.node") != F.col("head.node")) & _may_link("me", "head", threshold))
           .groupBy(F.col("me.node").alias("node"), F.col("head.node").alias("b")).count())
    pairs = tables.keep("pairs", met.groupBy("node").agg(F.max_by("b", F.struct("count", "b")).alias("b"))
                        .select(F.col("node").alias("a"), "b"))
    label = spark.createDataFrame([], "node binary, component binary")
    done = tables.keep("done0", _verified(pairs, _texts_of(pairs, there).dropDuplicates(["node"]), weights, threshold))
    links, leaders, turn, texts = done, LEADERS, 0, None
    while True:
        links = links.filter("linked").select("a", "b")
        if not links.isEmpty():
            label = tables.keep("label", _relabelled(label, links))
        labelled = (member.join(label.select(F.col("node").alias("same"), "component"), F.col("me.node") == F.col("same"), "left")
                    .select("key", "me", F.coalesce("component", "me.node").alias("of")))
        open_rows = tables.keep("open", _mixed(labelled))
        if open_rows.isEmpty():
            break
        nodes = open_rows.select(F.col("me.node").alias("node"))
        if texts is None:  # later rounds have no other nodes
            texts = tables.keep("texts", _only(there, nodes).dropDuplicates(["node"]))
        own = _own_weights(_only(texts, nodes), weights).select(F.col("node").alias("held_by"), "own")
        live = (open_rows.join(own, F.col("me.node") == F.col("held_by"), "left")
                .select("key", "me", "of", (F.col("me.weight") - F.coalesce("own", F.lit(0.0))).alias("me_shared"))
                .filter(F.col("me_shared") >= (threshold - 1e-9) * F.col("me.weight")))
        open_rows = tables.keep("open", _mixed(live))
        if open_rows.isEmpty():
            break
        seat = F.pmod(F.xxhash64("me.node", F.lit(leaders)), F.lit(leaders))
        heads = tables.keep("heads", open_rows.groupBy("key", seat.alias("seat"))
                            .agg(F.min(F.struct("me", "of", "me_shared")).alias("first"))
                            .select("key", F.col("first.me").alias("head"), F.col("first.of").alias("head_of"),
                                    F.col("first.me_shared").alias("head_shared")))
        agree = _agreements([F.col(f"me.{c}") for c in _SIG], [F.col(f"head.{c}") for c in _SIG])
        pairs = (open_rows.join(heads, "key").filter((F.col("of") != F.col("head_of")) & _may_link("me", "head", threshold)
                                                     & _overlap_allows("me", "head", threshold))
                 .select(F.greatest("me.node", "head.node").alias("a"), F.least("me.node", "head.node").alias("b"),
                         agree.alias("agree")).distinct())
        before = done.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        pairs = tables.keep("pairs", pairs.join(before, ["a", "b"], "left_anti"))
        # the likeliest partner of each node first: the classes that then join need no further comparison
        best = pairs.groupBy("a").agg(F.max_by("b", F.struct("agree", "b")).alias("b"))
        best = tables.keep("best", best)
        turn += 1
        links = tables.keep(f"done{turn}", _verified(best, _texts_of(best, texts), weights, threshold))
        done = done.unionByName(links)
        links = links.filter("linked").select("a", "b")
        if not links.isEmpty():
            label = tables.keep("label", _relabelled(label, links))
        rest = _apart(pairs.join(best, ["a", "b"], "left_anti").select("a", "b"), label)
        rest = tables.keep("rest", rest)
        turn += 1
        links = tables.keep(f"done{turn}", _verified(rest, _texts_of(rest, texts), weights, threshold))
        done = done.unionByName(links)
        # leaders have now met every member of another class in their bucket
        met = heads.select("key", F.col("head.node").alias("node"))
        member = tables.keep("member", open_rows.select("key", "me").join(
            met, (open_rows["key"] == met["key"]) & (F.col("me.node") == F.col("node")), "left_anti"))
        leaders *= GROWTH
    tables.drop("member", "pairs", "best", "rest", "open", "texts", "heads", *(f"done{i}" for i in range(turn + 1)))
    named = signed.select("id", "node").join(label, "node", "left").select(
        "id", "node", F.coalesce("component", "node").alias("component"))
    classes = named.groupBy("component").agg(F.min("id").alias("class_id"), F.count("*").alias("class_size"))
    linked = named.join(classes, "component").select("id", "node", "class_id", "class_size")
    alone = rows.filter("text is null").select("id", "node", F.col("id").alias("class_id"),
                                               F.lit(1).cast("long").alias("class_size"))
    return linked.unionByName(alone)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    threshold: float = THRESHOLD) -> DataFrame:
    """``id, class_id, kept, class_size`` of every row.

    The class id is the smallest id of the rows reachable by links; that row is
    kept. Equal texts are linked, also when they hold no word; texts of fewer
    than five words are one shingle. A missing text links with nothing and is
    kept. Rows that repeat an id and a text are in one class. Other columns are
    not read.
    """
    with small_batches(docs.sparkSession, BATCH), short_shuffles(docs.sparkSession):
        found = _classes(docs, id_col, text_col, threshold)
    return found.select(
        F.col("id").alias(id_col), "class_id", F.col("id").eqNullSafe(F.col("class_id")).alias("kept"), "class_size")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one row of each class, that of the smallest id; all columns stay."""
    with small_batches(docs.sparkSession, BATCH), short_shuffles(docs.sparkSession):
        found = _classes(docs, id_col, text_col, threshold)
    kept = (found.filter(F.col("id").eqNullSafe(F.col("class_id")))
            .select(F.col("id").alias("kept_id"), F.col("node").alias("kept_node")).distinct())
    packed = docs.select(F.struct("*").alias("row"), F.col(quoted(id_col)).alias("row_id"),
                         _text_node(F.col(quoted(text_col)).cast("string")).alias("row_node"))
    joined = packed.join(kept, F.col("row_id").eqNullSafe(F.col("kept_id")) &
                         F.col("row_node").eqNullSafe(F.col("kept_node")), "left_semi")
    return joined.dropDuplicates(["row_id", "row_node"]).select("row.*")
