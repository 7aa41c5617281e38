"""Information-theoretic sanitisation of personal data.

Protected entities are the e-mail addresses, IP addresses, card and phone
numbers of the corpus: each value, each class of values (a mail domain, the
first half of an address, the leading digits of a number) and each kind. How
strongly a term near an entity reveals it is its pointwise mutual information
with the entity over the entity's information content, both from counts over the
whole corpus; the ratio is 1 for a term that is never seen without it. As most
values occur once or twice, the joint count is shrunk to its lower bound given
how many different surroundings speak for it, which is nothing for one. Terms
above one threshold are generalised, above another removed. (After C-sanitized
by Sanchez and Batet, 2016.)
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import quoted, staged, whole_rows, whole_text
from .spans import Kind, counted, matches, none_of, overlaps, spelled


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})){3}$"

#: The base kinds, in the order that breaks ties of position. A match can only begin where a run of
#: its characters does or where the last match ended, which keeps the search linear in long runs.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda t: F.contains(t, F.lit("@")), lambda v: F.lit(True)),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}", lambda t: t.rlike(r"[0-9]\.[0-9]"), lambda v: v.rlike(OCTETS)),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", lambda t: t.rlike("[0-9]"), lambda v: F.char_length(_digits(v)).between(12, 19) & F.call_function("luhn_check", _digits(v))),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda t: F.contains(t, F.lit("+")), lambda v: F.char_length(_digits(v)).between(9, 15)),
)
TERM = r"\p{L}{3,}+"
#: Leading digits that a class of card or phone numbers shares.
CLASS_DIGITS = 6
SPANS = "array<struct<start:int,rank:int,kind:string,end:int>>"
NEAR = "array<struct<entities:array<string>,context:bigint,near:array<string>>>"
FOUND = "array<struct<start:int,rank:int,kind:string,end:int,value:string>>"


def base_spans(text: Column) -> Column:
    """Spans of the base kinds by position, then kind."""

    def told(kind: Kind, rank: int) -> Column:
        return F.transform(kind.find(text), lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind.name).alias("kind"), m["end"].alias("end"), m["value"].alias("value"))).cast(FOUND)

    return F.array_sort(F.concat(*(told(k, i) for i, k in enumerate(KINDS))))


def _entities(s: Column) -> Column:
    """Digests of the span's value, of the value's class and of its kind."""
    value = F.lower(s["value"])
    wide = F.when(s["kind"] == "email", F.substring_index(value, "@", -1)).when(s["kind"] == "ip", F.substring_index(value, ".", 2)).otherwise(F.substring(_digits(value), 1, CLASS_DIGITS))
    return F.array(*(F.sha2(F.concat_ws(":", F.lit(level), s["kind"], x), 256) for level, x in (("value", value), ("class", wide), ("kind", F.lit("")))))


def _contexts(text: Column, spans: Column, reach: int) -> Column:
    """For each span its entities and the distinct whole terms within ``reach`` code points of it, outside all spans."""

    def terms(piece: Column, at: Column, whole: Callable, close: Column) -> Column:
        found = F.filter(matches(piece, TERM), lambda m: whole(m) & ~overlaps(close, m["start"] + at, m["end"] + at))
        return F.transform(found, lambda m: F.lower(m["value"]))

    def one(s: Column) -> Column:
        first = F.greatest(s["start"] - reach, F.lit(0))
        left = text.substr(first + 1, s["start"] - first)
        right = text.substr(s["end"] + 1, F.lit(reach))
        cut = F.char_length(right) == reach
        close = F.filter(spans, lambda o: (o["start"] < s["end"] + reach) & (o["end"] > first))
        near = F.concat(
            terms(left, first, lambda m: (m["start"] > 0) | (first == 0), close),
            terms(right, s["end"], lambda m: ~cut | (m["end"] < reach), close),
        )
        return F.struct(_entities(s).alias("entities"), F.xxhash64(left, right).alias("context"), F.array_distinct(near).alias("near"))

    return F.transform(spans, one)


def examine(rows: DataFrame, reach: int = 80) -> DataFrame:
    """Adds to rows with ``text`` their base spans, each span's surroundings and the number of terms."""
    text = F.col("text")
    spans = rows.withColumn("base", base_spans(text)).withColumn("terms", F.regexp_count(text, F.lit(TERM)).cast("long"))
    near = F.when(F.size("base") > 0, _contexts(text, F.col("base"), reach)).otherwise(none_of(NEAR))
    spans = spans.withColumn("near", near.cast(NEAR)).withColumn("row", F.monotonically_increasing_id())
    return spans.withColumn("base", F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["kind"].alias("kind"), s["end"].alias("end"))))


def disclosure(uses: DataFrame, rows: DataFrame, texts: DataFrame, least: float, sureness: float = 1.0) -> DataFrame:
    """entity, term and strength of every term that reveals an entity by ``least`` or more.

    ``uses``: entity, context and near of each span and level; ``rows``: with
    the number of terms of each; ``texts``: text of the same documents, over
    which terms are counted. Of the spans near which a term is, c different
    surroundings count c - ``sureness`` * sqrt(c), so one passage proves nothing
    however often it is copied.
    """
    total = rows.agg(F.sum("terms")).first()[0] or 0
    entities = staged(uses.groupBy("entity").agg(F.count("*").alias("n_entity")), narrow=True)  # apart from the join, which can then split a kind
    per_context = uses.select("entity", "context", F.explode("near").alias("term")).groupBy("entity", "term", "context").agg(F.count("*").alias("n"))
    pairs = per_context.groupBy("entity", "term").agg(F.count("*").alias("contexts"), F.sum("n").alias("n_both"))
    sure = (F.col("contexts") - sureness * F.sqrt("contexts")) / F.col("contexts")
    pairs = staged(pairs.withColumn("sure", sure).where("sure > 0"))
    words = texts.select(F.explode(F.split(F.lower("text"), r"\P{L}+")).alias("term")).where(F.char_length("term") >= 3).groupBy("term").agg(F.count("*").alias("n_term"))
    shared = F.log(F.col("sure") * F.col("n_both") * F.lit(float(total)) / (F.col("n_entity") * F.col("n_term")))
    strength = shared / F.log(F.lit(float(total) + 1) / F.col("n_entity"))
    return pairs.join(entities, "entity").join(words, "term").select("entity", "term", strength.alias("strength")).where(F.col("strength") >= least)


def revealing(rows: DataFrame, texts: DataFrame, generalise: float = 0.6, remove: float = 0.85) -> DataFrame:
    """Spans of revealing terms of each row (row, added): every place of a term in a text where it stands near an entity that it reveals.

    ``rows``: written rows with row, base, near, terms, and text where there are base spans.
    """
    uses = rows.select("row", F.explode("near").alias("n")).select("row", F.explode("n.entities").alias("entity"), "n.context", "n.near")
    told = disclosure(uses, rows, texts, generalise)
    act = F.when(F.max("strength") >= remove, "removed").otherwise("term")
    of_row = uses.select("row", "entity", F.explode("near").alias("term")).join(told, ["entity", "term"]).groupBy("row", "term").agg(act.alias("kind"))
    of_row = of_row.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("term", "kind"))).alias("told"))
    found = F.transform(matches(F.col("text"), TERM), lambda m: F.struct(m["start"].alias("start"), F.lit(len(KINDS)).alias("rank"), F.element_at(F.col("told"), F.lower(m["value"])).alias("kind"), m["end"].alias("end")))
    placed = F.filter(F.filter(found, lambda m: m["kind"].isNotNull()), lambda m: ~overlaps(F.col("base"), m["start"], m["end"]))
    return rows.where(F.size("base") > 0).select("row", "base", "text").join(of_row, "row").select("row", placed.cast(SPANS).alias("added"))


def find_pii(docs: DataFrame, **options) -> DataFrame:
    """Personal data of every whole text, and the terms that reveal it.

    Returns doc_id, the counts of base spans, base_sha256, spans (base spans,
    and those of terms to generalise, ``term``, or remove, ``removed``), n_terms
    and n_private, the number of all spans.

    Null text is empty; rows are told apart by place, so null and repeated
    doc_ids are kept; an empty table gives an empty result; further columns are
    ignored.
    """
    texts = docs.select("doc_id", whole_text().alias("text"))
    rows = examine(texts)
    rows = staged(rows.withColumn("text", F.when(F.size("base") > 0, F.col("text"))))
    every = F.array_sort(F.concat("base", F.coalesce("added", none_of(SPANS))))
    return rows.drop("text", "near").join(revealing(rows, texts, **options), "row", "left").select(
        "doc_id",
        *(counted(F.col("base"), k.name).alias(f"n_{k.name}") for k in KINDS),
        F.sha2(spelled(F.col("base")), 256).alias("base_sha256"),
        spelled(every).alias("spans"),
        F.coalesce(F.size("added"), F.lit(0)).cast("long").alias("n_terms"),
        F.size(every).cast("long").alias("n_private"),
    )


def rewritten(text: Column, spans: Column) -> Column:
    """The text with each span, in order, replaced by its kind in brackets, and removed terms by nothing."""
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def add(acc: Column, s: Column) -> Column:
        label = F.when(s["kind"] == "removed", "").otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
        gap = text.substr(acc["at"] + 1, s["start"] - acc["at"])
        fresh = F.struct(s["end"].alias("at"), F.concat(acc["out"], F.array(gap, label)).alias("out"))
        return F.when(s["start"] >= acc["at"], fresh).otherwise(F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out")))

    return F.aggregate(spans, empty, add, lambda acc: F.concat(F.array_join(acc["out"], ""), text.substr(acc["at"] + 1, F.char_length(text))))


def sanitise(docs: DataFrame, **options) -> DataFrame:
    """The documents with personal data and revealing terms replaced in ``text``; all columns and rows stay.

    Null text stays null. Only rows with personal data meet the shuffle by row.
    """
    names = docs.columns
    rows = staged(examine(docs.select(whole_rows(docs).alias("doc"), whole_text().alias("text"))))
    every = F.array_sort(F.concat("base", F.coalesce("added", none_of(SPANS))))
    held = rows.where(F.size("base") > 0).join(revealing(rows, rows.select("text"), **options), "row", "left")
    clean = held.withColumn("text", rewritten(F.col("text"), every)).withColumn("n_chars", F.char_length("text").cast("long"))
    out = [F.col("text") if n == "text" else F.col("n_chars").cast(docs.schema[n].dataType).alias(n) if n == "n_chars" else F.col(f"doc.{quoted(n)}").alias(n) for n in names]
    return rows.where(F.size("base") == 0).select("doc.*").unionByName(clean.select(*out))
