"""Information-theoretic sanitisation of personal data, in SQL functions only.

Patterns find the protected entities: email and IP addresses, card and phone
numbers. The terms of documents that hold an entity, wherever they stand, are
weighed by how much they reveal of it over the whole corpus:

    PMI(e; t) = log2( c(e, t) N / (c(e) c(t)) ),   IC(e) = log2( N / c(e) )

with documents as the unit of every count. A term whose PMI reaches ``alpha``
of the entity's information content in at least ``min_docs`` documents
discloses the entity; all its occurrences in documents with the entity become
spans of kind ``term``. Words inside entity spans are no terms of a document. ``sanitise`` generalises entity spans to their kind and
removes disclosing terms.

Every pattern is possessive and starts only where a match may start, so the
time is linear in the text, and equals the plain pattern's leftmost,
non-overlapping matches.
"""

from __future__ import annotations

import operator
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, quoted

ALPHA = 0.8
MIN_DOCS = 3
TERM = r"\p{L}{4,}+"
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_PART = r"0*+(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])?"
_IP_OK = rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$"
_CHUNK = 64


def _may_hold(kind: str, text: Column) -> Column:
    """A cheap test that every text with a match passes."""
    if kind == "email":
        return F.contains(text, F.lit("@"))
    if kind == "phone":
        return F.contains(text, F.lit("+"))
    return text.rlike(r"[0-9]\.[0-9]" if kind == "ip" else r"[0-9][ -]?[0-9]")


def _once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with columns computed once a row; a lambda that names a projected column would compute it at every call."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def _running(df: DataFrame, steps: list[str], op: Callable[[Column, Column], Column] = operator.add) -> DataFrame:
    """``df`` with the running sums, or another ``op``, of arrays of longs, by chunks so that long arrays stay cheap."""
    def along(values: Column) -> Column:
        return F.slice(F.aggregate(values, F.array(F.lit(0).cast("long")),
                                   lambda acc, x: F.concat(acc, F.array(op(F.element_at(acc, -1), x)))),
                       2, F.greatest(F.size(values), F.lit(1)))

    def chunks(name: str) -> Column:
        last = F.floor((F.greatest(F.size(name), F.lit(1)) - 1) / _CHUNK).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda k: along(F.slice(name, k * _CHUNK + 1, F.lit(_CHUNK))))

    def whole(name: str) -> Column:
        return F.flatten(F.transform(f"c_{name}", lambda c, k: F.transform(c, lambda x: op(x, F.get(f"b_{name}", k)))))

    df = _once(df, {f"c_{name}": chunks(name) for name in steps})
    df = _once(df, {f"b_{name}": F.concat(F.array(F.lit(0).cast("long")), along(F.transform(
        f"c_{name}", lambda c: F.coalesce(F.try_element_at(c, F.lit(-1)), F.lit(0).cast("long"))))) for name in steps})
    return _once(df.drop(*steps), {name: whole(name) for name in steps}).drop(
        *[f"{x}_{name}" for x in "cb" for name in steps])


def _with_spans(df: DataFrame, patterns: dict[str, str], may_hold: Callable[[str, Column], Column]) -> DataFrame:
    """``df`` with an array a pattern: ``value, start, end`` of each match in ``text``.

    Offsets count code points, the end is exclusive. They are the running sums
    of the lengths of the matches and of the pieces between them.
    """
    def found(name: str) -> Column:
        return F.when(may_hold(name, F.col("text")), F.regexp_extract_all("text", F.lit(patterns[name]), F.lit(0))).otherwise(
            F.array().cast("array<string>"))

    def gaps(name: str) -> Column:
        return F.when(F.size(f"m_{name}") > 0, F.transform(F.split("text", patterns[name], -1), lambda s: F.length(s).cast("long")))

    def steps(name: str) -> Column:
        return F.transform(f"m_{name}", lambda m, i: F.get(f"g_{name}", i) + F.when(i == 0, F.lit(0)).otherwise(
            F.length(F.get(f"m_{name}", i - 1))).cast("long"))

    def spans(name: str) -> Column:
        return F.zip_with(f"m_{name}", f"s_{name}", lambda m, s: F.struct(
            m.alias("value"), s.alias("start"), (s + F.length(m)).alias("end")))

    df = _once(df, {f"m_{name}": found(name) for name in patterns})
    df = _once(df, {f"g_{name}": gaps(name) for name in patterns})
    df = _once(df, {f"s_{name}": steps(name) for name in patterns})
    df = _running(df, [f"s_{name}" for name in patterns])
    return _once(df, {name: spans(name) for name in patterns}).drop(*[f"{x}_{name}" for x in "mgs" for name in patterns])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, r"[^0-9]", "")


def _luhn(value: Column) -> Column:
    padded = F.lpad(_digits(value), 20, "0")

    def term(i: Column) -> Column:
        d = F.substring(padded, i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, 2 * d - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.lit(20)), F.lit(0), lambda acc, i: acc + term(i)) % 10 == 0


def _holds(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(_IP_OK)
    n = F.length(_digits(value))
    if kind == "card":
        return F.when(n.between(13, 19), _luhn(value)).otherwise(False)
    return n.between(9, 15) if kind == "phone" else F.lit(True)


def _check(kind: str):
    return lambda s: _holds(kind, s["value"])


def entity_spans(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``row, id``, an array of spans a kind, and ``entities`` and ``text`` of rows that hold any."""
    text = F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit(""))
    rows = docs.select(F.col(quoted(id_col)).alias("id"), text.alias("text"))
    rows = _with_spans(rows, {kind: PATTERNS[kind] for kind in KINDS}, _may_hold)
    kept = {f"k_{kind}": F.filter(kind, _check(kind)) for kind in KINDS}
    rows = _once(rows, kept).select("id", "text", *[F.col(f"k_{kind}").alias(kind) for kind in KINDS])
    entities = F.array_distinct(F.concat(*[F.transform(kind, _entity(kind)) for kind in KINDS]))
    return (rows.withColumn("entities", entities)
            .select(F.monotonically_increasing_id().alias("row"), "id", *KINDS, "entities",
                    F.when(F.size("entities") > 0, F.col("text")).alias("text")))


def _entity(kind: str):
    return lambda s: F.concat(F.lit(f"{kind}:"), F.lower(s["value"]))


def _terms(base: DataFrame, entities: DataFrame) -> DataFrame:
    """``row, entities, terms``: the listed entities of a row and all its terms outside entity spans."""
    listed = (base.select("row", F.explode("entities").alias("entity")).join(entities, "entity")
              .groupBy("row").agg(F.collect_list("entity").alias("entities")))
    rows = base.filter("text is not null").select("row", "text", F.concat(*KINDS).alias("own")).join(listed, "row")
    rows = _with_spans(rows, {"term": TERM}, lambda name, text: F.lit(True)).filter(F.size("term") > 0)

    def event(at: str, own: bool):
        return lambda s: F.struct(s[at].alias("at"), F.lit(own).alias("own"), s["value"].alias("value"),
                                  s["start"].alias("start"), s["end"].alias("end"))

    # a term is free if no entity span that starts before its end ends after its start
    events = F.array_sort(F.concat(F.transform("own", event("start", True)), F.transform("term", event("end", False))))
    rows = _once(rows, {"events": events})
    rows = _once(rows, {"ends": F.transform("events", lambda e: F.when(e["own"], e["end"]).otherwise(F.lit(0).cast("long")))})
    rows = _once(_running(rows, ["ends"], F.greatest), {"marked": F.zip_with("events", "ends", lambda e, end: F.struct(
        e.alias("e"), (~e["own"] & (end <= e["start"])).alias("free")))})
    return rows.select("row", "entities", F.transform(F.filter("marked", lambda x: x["free"]), lambda x: F.struct(
        F.lower(x["e"]["value"]).alias("term"), x["e"]["start"].alias("start"), x["e"]["end"].alias("end"))).alias("terms"))


def disclosing_terms(docs: DataFrame, held: DataFrame, entities: DataFrame, text_col: str, alpha: float = ALPHA,
                     min_docs: int = MIN_DOCS) -> DataFrame:
    """``entity, term, pmi, information`` of pairs in which the term reveals the entity."""
    pairs = (held.select(F.explode("entities").alias("entity"), F.array_distinct("terms.term").alias("own"))
             .select("entity", F.explode("own").alias("term")).groupBy("entity", "term")
             .agg(F.count("*").alias("c_et")).filter(F.col("c_et") >= min_docs))
    # one row a distinct word of a text; the counts combine on the map side
    words = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(
        F.lower(F.col(quoted(text_col)).cast("string")), F.lit(TERM), F.lit(0)))).alias("term"))
    terms = words.groupBy("term").agg(F.count("*").alias("c_t"))
    n = docs.agg(F.count("*").alias("n"))
    joined = pairs.join(entities, "entity").join(terms, "term").crossJoin(F.broadcast(n))  # one row
    scored = joined.select("entity", "term",
                           F.log2(F.col("c_et") * F.col("n") / (F.col("c_e").cast("double") * F.col("c_t"))).alias("pmi"),
                           F.log2(F.col("n") / F.col("c_e")).alias("information"))
    return scored.filter((F.col("information") > 0) & (F.col("pmi") >= alpha * F.col("information")))


def _joined(spans: dict[str, Column]) -> Column:
    """``kind:start:end`` of all spans, by kind as listed and start, with commas."""
    def written(kind: str):
        return lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["end"])

    return F.concat_ws(",", F.flatten(F.array(*[F.transform(c, written(kind)) for kind, c in spans.items()])))


def found_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", alpha: float = ALPHA,
                min_docs: int = MIN_DOCS) -> DataFrame:
    """``id, email, ip, card, phone, term``: arrays of spans of every row's whole text.

    A missing text counts as empty; ids may be missing or repeat. Other columns
    are not read.
    """
    base = cut(entity_spans(docs, id_col, text_col))
    entities = cut(base.select(F.explode("entities").alias("entity")).groupBy("entity")
                   .agg(F.count("*").alias("c_e")).filter(F.col("c_e") >= min_docs))
    held = cut(_terms(base, entities.select("entity")))
    telling = cut(disclosing_terms(docs, held, entities, text_col, alpha, min_docs))
    each = (held.select("row", F.explode("entities").alias("entity"), "terms")
            .select("row", "entity", F.inline("terms")))
    terms = (each.join(telling, ["entity", "term"]).groupBy("row")
             .agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("term")))
    return base.drop("entities", "text").join(terms, "row", "left").select(
        F.col("id").alias(id_col), *KINDS,
        F.coalesce("term", F.array().cast("array<struct<start:long,end:long>>")).alias("term"))


def span_digest(spans: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts, the digest of the entity spans, and all spans as text."""
    base = {kind: F.col(kind) for kind in KINDS}
    return spans.select(
        id_col, *[F.size(kind).cast("long").alias(f"n_{kind}") for kind in KINDS],
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined({**base, "term": F.col("term")}).alias("spans"),
        F.size("term").cast("long").alias("n_term"))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", alpha: float = ALPHA,
             min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with every entity span generalised to its kind and disclosing terms removed.

    Overlapping spans count as one, labelled by the first. Rows whose id is
    missing or stands for different texts are matched by their text as well.
    """
    text = F.col(quoted(text_col)).cast("string")
    marked = docs.select(F.struct("*").alias("row_"), F.struct(F.col(quoted(id_col)).alias("id"),
                                                               F.md5(text).alias("h")).alias("key_"))
    keyed = docs.select(F.struct(F.col(quoted(id_col)).alias("id"), F.md5(text).alias("h")).alias("key_"),
                        text.alias("text_"))
    spans = found_spans(keyed, "key_", "text_", alpha, min_docs).dropDuplicates(["key_"])

    def label(kind: str):
        name = "" if kind == "term" else f"[{kind.upper()}]"
        return lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(name).alias("label"))

    labelled = F.array_sort(F.flatten(F.array(*[F.transform(k, label(k)) for k in (*KINDS, "term")])))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("parts"))
    own = F.col("row_")[text_col].cast("string")

    def step(acc: Column, s: Column) -> Column:
        part = F.concat(F.substring(own, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), s["label"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"),
                        F.when(s["start"] >= acc["at"], F.concat(acc["parts"], F.array(part)))
                        .otherwise(acc["parts"]).alias("parts"))

    folded = F.aggregate("all_", start, step)
    done = (marked.join(spans.select("key_", labelled.alias("all_")), "key_", "left")
            .withColumn("folded_", folded))
    clean = F.concat(F.array_join("folded_.parts", ""),
                     F.substring(own, (F.col("folded_.at") + 1).cast("int"), F.length(own)))
    return done.select(*[(F.when(F.size("all_") > 0, clean).otherwise(own) if f.name == text_col
                          else F.col("row_")[f.name]).alias(f.name) for f in docs.schema.fields])
