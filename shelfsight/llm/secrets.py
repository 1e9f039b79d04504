"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

Candidates are found in every whole text by regular expressions. Their hashes are then counted
over the corpus by distinct owners and repositories: a value that many owners hold is a copied
example, a value of one owner that looks random is a live-looking credential.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfsight.llm.common import own_columns, saved

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
MIXED = r"[A-Za-z0-9_-]{20,}"
KINDS = ("assign", "access", "hex", "owned")


def located(text: Column, pattern: str) -> Column:
    """array<struct<start,end,m>> of the leftmost non-overlapping matches, in code points.

    Positions follow from the lengths of the pieces between matches. Work grows with the text,
    and with the square of its number of matches.
    """
    def add(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["gap"])
        end = start + F.length(x["m"])
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(F.struct(
            start.alias("start"), end.alias("end"), x["m"].alias("m")))).alias("out"))

    none = F.array().cast("array<struct<start:int,end:int,m:string>>")

    def walk(found: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), 1, F.size(found))
        steps = F.zip_with(gaps, found, lambda g, m: F.struct(g.alias("gap"), m.alias("m")))
        return F.when(F.size(found) == 0, none).otherwise(
            F.aggregate(steps, F.struct(F.lit(0).alias("at"), none.alias("out")), add, lambda s: s["out"]))
    return F.get(F.transform(F.array(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))), walk), 0)


def _kind(matches: Column, kind: str, value) -> Column:
    rank = KINDS.index(kind)
    return F.transform(matches, lambda x: F.struct(
        x["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), x["end"].alias("end"),
        F.sha2(value(x["m"]).cast("binary"), 256).alias("hash")))


def _random_looking(m: Column) -> Column:
    kinds = m.rlike("[a-z]") & m.rlike("[A-Z]") & m.rlike("[0-9].*[0-9]")
    return kinds & (F.size(F.array_distinct(F.split(m, ""))) >= 10)


def candidates(docs: DataFrame, owner: str = "source", repository: list[str] | None = None) -> DataFrame:
    """(doc_id, tk, owner, repository, spans) with tk a hash of the text that tells repeated ids apart."""
    repository = repository or ["source", "lang"]
    text = F.coalesce("text", F.lit(""))
    value = F.regexp_extract("m", ASSIGN, 2)
    base = own_columns(docs, dict.fromkeys(["doc_id", "text", owner, *repository])).select(
        "doc_id", F.xxhash64(text).alias("tk"), F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("owner"),
        F.concat_ws("/", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in repository]).alias("repository"),
        located(text, ASSIGN).alias("a"), located(text, ACCESS).alias("k"), located(text, HEX).alias("h"),
        located(text, MIXED).alias("x"))
    secret = lambda m: F.regexp_extract(m, ASSIGN, 2)
    same = lambda m: m
    kept = F.concat(
        _kind(F.filter("a", lambda x: F.length(secret(x["m"])) >= 12), "assign", secret),
        _kind(F.col("k"), "access", same), _kind(F.col("h"), "hex", same))
    base = base.select("doc_id", "tk", "owner", "repository", kept.alias("base"), F.filter("x", lambda x: _random_looking(x["m"])).alias("x"))
    free = F.filter("x", lambda x: ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    return base.select("doc_id", "tk", "owner", "repository", F.concat("base", _kind(free, "owned", same)).alias("spans"))


def ownership(spans: DataFrame) -> DataFrame:
    """(hash, n_owners, n_repositories): distinct holders of each value, pre-aggregated pair by pair."""
    held = spans.groupBy("hash", "owner", "repository").agg(F.count("*").alias("n"))
    held = held.groupBy("hash", "owner").agg(F.count("*").alias("r"))
    return held.groupBy("hash").agg(F.count("*").alias("n_owners"), F.sum("r").alias("n_repositories"))


def scan(docs: DataFrame, owner: str = "source", repository: list[str] | None = None, widely: int = 3) -> DataFrame:
    """(doc_id, tk, spans, judged) for every row of documents (doc_id, text, owner, repository columns).

    spans are the base spans: `assign`, `access` and `hex` matches. judged adds the `owned` ones and
    gives each span (start, rank, kind, end, hash, verdict): `example` where `widely` or more distinct
    owners hold the value, else `live`. A random-looking token outside base spans becomes an `owned`
    span only as `live`. Both arrays are sorted by start, then kind. Null texts count as empty, null
    owners and repositories as "". Repeated rows come back as often as they stand; an empty table gives
    no rows. Other columns are not read.
    """
    found = saved(candidates(docs, owner, repository))
    each = found.select("doc_id", "tk", "owner", "repository", F.explode("spans").alias("s")) \
        .select("doc_id", "tk", "owner", "repository", "s.*")
    verdict = F.when(F.col("n_owners") >= widely, "example").otherwise("live")
    judged = (
        each.select("doc_id", "tk", "start", "rank", "kind", "end", "hash").distinct()
        .join(ownership(each), "hash").withColumn("verdict", verdict)
        .where("kind <> 'owned' OR verdict = 'live'")
        .groupBy("doc_id", "tk").agg(F.sort_array(F.collect_list(
            F.struct("start", "rank", "kind", "end", "hash", "verdict"))).alias("judged")))
    empty = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int,hash:string,verdict:string>>")
    base = F.sort_array(F.filter("spans", lambda s: s["kind"] != "owned"))
    return (
        found.select("doc_id", "tk", base.alias("spans")).join(judged.withColumnRenamed("doc_id", "d").withColumnRenamed("tk", "t"),
                                                              F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tk") == F.col("t")), "left")
        .select("doc_id", "tk", "spans", F.coalesce("judged", empty).alias("judged")))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def report(docs: DataFrame) -> DataFrame:
    """Per document: numbers of base spans, their digest, all spans, and how many are live or examples."""
    found = scan(docs)
    many = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    of = lambda v: F.size(F.filter("judged", lambda s: s["verdict"] == v)).cast("long")
    return found.select(
        "doc_id", *[many(k).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(listed(F.col("spans")).cast("binary"), 256).alias("base_sha256"), listed(F.col("judged")).alias("spans"),
        of("live").alias("n_live"), of("example").alias("n_example"))


def masked(text: Column, judged: Column) -> Column:
    """The text with each span replaced by a word for its verdict; overlapping spans count as one."""
    def add(state: Column, s: Column) -> Column:
        new = s["start"] >= state["at"]
        gap = F.substring(text, state["at"] + 1, F.greatest(s["start"] - state["at"], F.lit(0)))
        mark = F.concat(F.lit("["), F.upper(s["verdict"]), F.lit(" SECRET]"))
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"),
                        F.when(new, F.concat(state["out"], gap, mark)).otherwise(state["out"]).alias("out"))
    done = F.aggregate(judged, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), add)
    return F.get(F.transform(F.array(done), lambda d: F.concat(d["out"], F.substring(text, d["at"] + 1, F.length(text)))), 0)


def redact(docs: DataFrame) -> DataFrame:
    """documents with secrets masked: every column kept, n_chars counted anew where the text changed."""
    judged = scan(docs).where(F.size("judged") > 0).select(F.col("doc_id").alias("_d"), F.col("tk").alias("_t"), "judged") \
        .dropDuplicates(["_d", "_t"])
    joined = docs.join(judged, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("_t")), "left")
    changed = F.col("judged").isNotNull()
    text = F.when(changed, masked(F.col("text"), F.col("judged"))).otherwise(F.col("text"))
    out = joined.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
