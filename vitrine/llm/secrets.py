"""Secret scans: corpus-wide ownership frequency of candidate credentials.

A credential copied from documentation turns up under many owners, or in many
repositories of a few; a live one belongs to its owner. Candidates are hashed,
counted by distinct repositories and owners over the corpus, and each occurrence
gets the verdict of its hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged, whole_text
from .spans import Kind, counted, none_of, overlaps, spelled

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]++)"""

#: The base kinds, in the order that breaks ties of position.
KINDS = (
    Kind("assign", ASSIGN, lambda t: t.rlike("[:=]"), lambda v: F.char_length(F.regexp_extract(v, ASSIGN, 2)) >= 8),
    Kind("access", r"AKIA[A-Z0-9]++", lambda t: F.contains(t, F.lit("AKIA")), lambda v: F.char_length(v) >= 16),
    Kind("hex", r"[0-9a-f]{32,}+", lambda t: t.rlike(r"[0-9a-f]{32}"), lambda v: F.lit(True)),
)


def live_looking(value: Column) -> Column:
    """Letters and digits mixed, of many kinds, and no word such as an example would have."""
    varied = F.size(F.array_distinct(F.split(value, ""))) >= 10
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]") & varied & ~value.rlike("(?i)example|sample|changeme|placeholder|dummy|xxxx|1234567|your")


#: Further candidates, which become spans only where the corpus speaks for a live secret.
OPAQUE = Kind("live", r"(?:\G|(?<![A-Za-z0-9+/_=-]))[A-Za-z0-9+/_=-]{20,}+", lambda t: t.rlike("[0-9]"), live_looking)

SPANS = "array<struct<start:int,rank:int,kind:string,end:int,digest:string,lively:boolean>>"


def _found(text: Column) -> tuple[Column, Column]:
    """Base spans by position and kind, and the opaque strings beside them."""

    def told(kind: Kind, rank: int) -> Column:
        def one(m: Column) -> Column:
            secret = F.regexp_extract(m["value"], ASSIGN, 2) if kind.name == "assign" else m["value"]
            return F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind.name).alias("kind"), m["end"].alias("end"), F.sha2(secret, 256).alias("digest"), live_looking(secret).alias("lively"))

        return F.transform(kind.find(text), one).cast(SPANS)

    return F.array_sort(F.concat(*(told(k, i) for i, k in enumerate(KINDS)))), told(OPAQUE, len(KINDS))


def _examined(docs: DataFrame, owner: str, repository: str) -> DataFrame:
    """Written rows: doc_id, owner, repository, row, base, and the opaque strings outside the base spans."""
    base, opaque = _found(F.col("text"))
    rows = docs.select("doc_id", whole_text().alias("text"), F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("owner"), F.coalesce(F.col(repository).cast("string"), F.lit("")).alias("repository"))
    rows = rows.select("doc_id", "owner", "repository", F.monotonically_increasing_id().alias("row"), base.alias("base"), opaque.alias("opaque"))
    return staged(rows.withColumn("opaque", F.filter("opaque", lambda s: ~overlaps(F.col("base"), s["start"], s["end"]))))


def _uses(rows: DataFrame) -> DataFrame:
    return rows.select("row", "owner", "repository", F.explode(F.concat("base", "opaque")).alias("s")).select("row", "owner", "repository", "s", F.col("s.digest").alias("digest"))


def ownership(uses: DataFrame, example_owners: int, example_repositories: int) -> DataFrame:
    """owners, repositories, uses and verdict of every digest; counts are summed up before they are dealt out by digest alone."""
    by_repository = uses.groupBy("digest", "owner", "repository").agg(F.count("*").alias("n"), F.max("s.lively").alias("lively"))
    by_owner = by_repository.groupBy("digest", "owner").agg(F.count("*").alias("repositories"), F.sum("n").alias("n"), F.max("lively").alias("lively"))
    known = by_owner.groupBy("digest").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"), F.sum("n").alias("uses"), F.max("lively").alias("lively"))
    example = (F.col("owners") >= example_owners) | (F.col("repositories") >= example_repositories)
    return known.withColumn("verdict", F.when(example, "example").when(F.col("lively"), "live").otherwise("unclear")).drop("lively")


def candidates(docs: DataFrame, owner: str = "source", repository: str = "lang", example_owners: int = 3, example_repositories: int = 4) -> DataFrame:
    """digest (SHA-256 of the secret), owners, repositories, uses and verdict of every candidate of the corpus."""
    return ownership(_uses(_examined(docs, owner, repository)), example_owners, example_repositories)


def scan_secrets(docs: DataFrame, owner: str = "source", repository: str = "lang", example_owners: int = 3, example_repositories: int = 4) -> DataFrame:
    """Secrets of every whole text, with the corpus's verdict on each.

    An owner is the first column given, a repository a pair of both: where a
    table names no repositories, what one source has in one language is the
    finest unit that it tells apart. A candidate seen under ``example_owners``
    owners or in ``example_repositories`` repositories, or more, is an example;
    one of fewer that looks live is live. Returns doc_id, the counts of base
    spans, base_sha256, spans (base spans, and ``live`` spans of opaque strings
    outside them that are live), n_live and n_example over all spans, n_secrets
    (all spans), and the owners and repositories of the most widely used one.

    Null text is empty; a null owner or repository counts as one of its own;
    rows are told apart by place, so repeated rows and doc_ids are kept; an empty
    table gives an empty result; further columns are ignored.
    """
    rows = _examined(docs, owner, repository)
    uses = _uses(rows)
    # written apart, so that no aggregate below the join keeps a digest of many uses from being split
    known = staged(ownership(uses, example_owners, example_repositories), narrow=True)
    judged = uses.join(known, "digest").select("row", "s", "verdict", "owners", "repositories")
    added = (F.col("verdict") == "live") & (F.col("s.kind") == "live")
    told = F.struct(F.col("s.start").alias("start"), F.col("s.rank").alias("rank"), F.col("s.kind").alias("kind"), F.col("s.end").alias("end"))
    by_row = judged.groupBy("row").agg(
        F.collect_list(F.when(added, told)).alias("added"),
        F.count(F.when((F.col("s.kind") != "live") & (F.col("verdict") == "live") | added, 1)).alias("n_live"),
        F.count(F.when(F.col("verdict") == "example", 1)).alias("n_example"),
        F.max("owners").alias("owners"),
        F.max("repositories").alias("repositories"),
    )
    every = F.array_sort(F.concat(F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["kind"].alias("kind"), s["end"].alias("end"))), F.coalesce("added", none_of("array<struct<start:int,rank:int,kind:string,end:int>>"))))
    none = F.lit(0).cast("long")
    return rows.join(by_row, "row", "left").select(
        "doc_id",
        *(counted(F.col("base"), k.name).alias(f"n_{k.name}") for k in KINDS),
        F.sha2(spelled(F.col("base")), 256).alias("base_sha256"),
        spelled(every).alias("spans"),
        *(F.coalesce(c, none).alias(c) for c in ("n_live", "n_example", "owners", "repositories")),
        F.size(every).cast("long").alias("n_secrets"),
    )
