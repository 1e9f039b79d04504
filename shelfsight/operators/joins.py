"""Join patterns that Catalyst does not derive on its own.

What reaches the driver is a bitmap of the substring index, whose size is bounded by a parameter.
"""

from __future__ import annotations

import json
import math
import uuid
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from shelfsight.session import checkpoint_dir

GRAM = 4
#: Characters of a block of text; no row of the index search is longer than this and the longest term.
PIECE = 128
#: Sizes of the two fixed hash tables, powers of two.
COUNT_SLOTS = 1 << 16
ANCHOR_BITS = 1 << 20


def spread(df: DataFrame) -> DataFrame:
    """Round-robin a table whose scan has fewer splits than the session has cores.

    Per-row text work on one small file would otherwise run in one task. A table with
    enough splits is returned unchanged.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def stored(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back, for what several branches of a plan read."""
    path = f"{checkpoint_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ranked(df: DataFrame, lead: Column, text: Column, order: list[Column], name: str = "rk", prefix: int = 2) -> DataFrame:
    """df with the rank of each row along (lead, text, ...), `order` being that order in full.

    Two levels: rows are ranked within (lead, the first characters of text), and the buckets'
    sizes are added up over the far smaller table of buckets. Text order must be binary.
    """
    keyed = df.withColumn("_lead", lead).withColumn("_px", F.substring(text, 1, prefix))
    before = W.orderBy("_lead", "_px").rowsBetween(W.unboundedPreceding, -1)
    sizes = keyed.groupBy("_lead", "_px").agg(F.count("*").alias("_n")) \
        .select("_lead", "_px", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    own = F.row_number().over(W.partitionBy("_lead", "_px").orderBy(*order))
    return (keyed.withColumn("_own", own).join(sizes, ["_lead", "_px"])
            .withColumn(name, (F.col("_own") + F.col("_off")).cast("long")).drop("_lead", "_px", "_own", "_off"))


def _slot(key: Column, size: int) -> Column:
    """A place below `size`, a power of two, for a string."""
    return F.xxhash64(key).bitwiseAND(F.lit(size - 1).cast("long"))


def _row_hash(text: str, keep: list[str], carry: list[str]) -> Column:
    return F.xxhash64(*keep, *carry, text).alias("_id")


def _pieces(docs: DataFrame, text: str, keep: list[str], tail: int, carry: list[str] | None = None) -> DataFrame:
    """Texts cut into blocks of PIECE characters, each with the next `tail` characters after it.

    What starts in a block and is at most `tail` + 1 long lies inside its body, so the work on a
    body is bounded and the work on a text grows with its length alone.
    """
    carry = carry or []
    cut = docs.where(F.length(text) > 0).select(
        *keep, *carry, _row_hash(text, keep, carry), F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)).alias("_all"))
    after = F.substring(F.array_join(F.slice("_all", F.col("_i") + 2, -(-tail // PIECE)), ""), 1, tail)
    return cut.select(*keep, *carry, "_id", "_all", F.posexplode("_all").alias("_i", "_own")).select(
        *keep, *carry, "_id", "_i", F.concat("_own", after).alias("_body"))


def _places(pieces: DataFrame, *columns: str) -> DataFrame:
    """One row for each character of a body, with the gram that begins there (shorter at the end)."""
    # Each match takes one code point, so places count as substring does; one pass over a body.
    grams = F.regexp_extract_all("_body", F.lit(f"(?s)(?=(.{{1,{GRAM}}}))."), F.lit(1))
    return pieces.select(*columns, "_body", F.posexplode(grams).alias("_pos", "_gram"))


def gram_counts(docs: DataFrame, text: str, slots: int = COUNT_SLOTS) -> DataFrame:
    """How often the grams of each hash slot occur in all texts: `slots` rows at most.

    They can be stored and handed to any number of searches of the same texts.
    """
    pieces = _pieces(docs, text, [], GRAM - 1)
    grams = _places(pieces, "_i").where(F.length("_gram") == GRAM)
    return grams.groupBy(_slot(F.col("_gram"), slots).alias("_slot")).agg(F.count("*").alias("_n"))


def term_anchors(terms: DataFrame, term: str, counts: DataFrame, slots: int = COUNT_SLOTS) -> DataFrame:
    """The rows of terms with their rarest gram and where in the term it begins (_key, _off).

    Ties go to the first place. A term shorter than a gram is its own anchor. Null and empty terms
    have none and fall out.
    """
    words = terms.where(F.length(term) > 0)
    each = words.select(F.col(term).alias("_term")).distinct()
    last = F.greatest(F.length("_term") - GRAM, F.lit(0))
    grams = each.select("_term", F.explode(F.sequence(F.lit(0), last)).alias("_off")).withColumn(
        "_key", F.substr("_term", F.col("_off") + 1, F.lit(GRAM)))
    known = grams.withColumn("_slot", _slot(F.col("_key"), slots)).join(counts, "_slot", "left")
    rare = F.min_by(F.struct("_key", "_off"), F.struct(F.coalesce("_n", F.lit(0)), "_off")).alias("_a")
    found = known.groupBy("_term").agg(rare).select("_term", "_a.*")
    return words.withColumn("_term", F.col(term)).join(found, "_term").drop("_term")


class KeyFilter:
    """A bitmap of at most `bits` places, sized by `n`, that says which keys a table may hold: one row on the driver."""

    def __init__(self, rows: DataFrame, key: str, n: int, bits: int) -> None:
        self.bits = min(bits, max(64, 1 << (32 * n).bit_length()))
        slot = _slot(F.col(key), self.bits)
        word = rows.groupBy(F.shiftright(slot, 6).alias("w")).agg(F.bit_or(
            F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63).cast("long")).cast("int"))).alias("b"))
        full = dict(map(tuple, word.collect()))  # self.bits / 64 rows at most
        self._bitmap = F.from_json(F.lit(json.dumps([full.get(i, 0) for i in range(self.bits // 64)])), "array<bigint>")

    def holds(self, key: Column) -> Column:
        slot = _slot(key, self.bits)
        return F.getbit(F.get(self._bitmap, F.shiftright(slot, 6).cast("int")), slot.bitwiseAND(F.lit(63).cast("long")).cast("int")) == 1


class SubstringIndex:
    """Terms with their anchors, written once to the shared folder and searched any number of times.

    What reaches the driver is one row: the number of terms, the longest length, the lengths below
    a gram and a bitmap of at most `bits` places, sized by the number of terms, that says which
    anchors exist. Neither the bitmap's size nor the counts change what a search finds.
    """

    def __init__(self, terms: DataFrame, term: str, counts: DataFrame, bits: int = ANCHOR_BITS) -> None:
        spark = terms.sparkSession
        path = f"{checkpoint_dir(spark)}/substring-index-{uuid.uuid4().hex}"
        term_anchors(terms, term, counts).write.parquet(path)
        self.rows, self.term, self.columns = spark.read.parquet(path), term, terms.columns
        size = F.length(term)
        n, reach, short = self.rows.agg(
            F.count("*"), F.max(size), F.bit_or(F.when(size < GRAM, F.expr(f"shiftleft(1, length(`{term}`))")))).head()
        self.reach = reach or 1
        self.short = [k for k in range(1, GRAM) if (short or 0) >> k & 1]
        self.anchors = KeyFilter(self.rows, "_key", n, bits)

    def search(self, docs: DataFrame, text: str, keep: list[str], carry: list[str] | None = None) -> DataFrame:
        """One row for each row of docs and each term row that its text contains.

        Columns of `carry` come out like those of `keep`, but no row is told apart by comparing them
        and they are left out of the whole search when nothing reads them.
        """
        carry = carry or []
        return _for_each(docs, text, self.once(docs, text, keep, carry), self.rows.select(*self.columns), self.term, keep, carry)

    def once(self, docs: DataFrame, text: str, keep: list[str], carry: list[str]) -> DataFrame:
        """(_id, *keep, _term, *carry): one row for each different row of docs and term that its text contains."""
        reach = self.reach
        keys = [F.col("_gram"), *[F.substring("_gram", 1, k) for k in self.short]]
        places = _places(_pieces(docs, text, keep, reach - 1, carry), *keep, *carry, "_id").where(
            reduce(or_, [self.anchors.holds(k) for k in keys]))
        begin = F.greatest(F.col("_pos") - reach, F.lit(0))
        key = F.explode(F.array_distinct(F.array(*keys))) if self.short else F.col("_gram")
        found = places.select(
            *keep, *carry, "_id", "_pos", (F.col("_pos") - begin).alias("_in"),
            F.substr("_body", begin + 1, F.lit(2 * reach)).alias("_near"), key.alias("_key"))
        term = F.col(self.term).alias("_term")
        anchors = self.rows.select("_key", "_off", term).distinct()
        start, local = F.col("_pos") - F.col("_off"), F.col("_in") - F.col("_off")
        # An occurrence belongs to the block in which it starts.
        hits = found.join(anchors, "_key").where(
            (local >= 0) & (start < PIECE) & (F.substr("_near", local + 1, F.length("_term")) == F.col("_term")))
        # Occurrences fall together before they are shuffled.
        return hits.groupBy("_id", *keep, "_term").agg(*[F.first(x).alias(x) for x in carry or ["_key"]])


def _for_each(docs: DataFrame, text: str, once: DataFrame, terms: DataFrame, term: str, keep: list[str], carry: list[str], fetch: bool = False) -> DataFrame:
    """One row for each row of docs and of terms, from `once`.

    Equal rows of docs, rare or none, are counted apart, and the terms' other columns are added last.
    With `fetch` the columns of `carry` are not in `once` but come from docs here, once a row.
    """
    brought = carry if fetch else []
    equal = docs.where(F.length(text) > 0).select(*keep, *brought, _row_hash(text, keep, carry)).groupBy(
        "_id", *keep).agg(F.count("*").alias("_n"), *[F.first(x).alias(x) for x in brought])
    equal = equal if brought else equal.where("_n > 1")
    equal = equal.select(F.col("_id").alias("_id2"), F.struct(*keep).alias("_k2") if keep else F.lit(0).alias("_k2"), "_n", *brought)
    same = F.struct(*keep).eqNullSafe(F.col("_k2")) if keep else F.lit(True)
    every = once.join(equal, (F.col("_id") == F.col("_id2")) & same, "left").select(
        *keep, *carry, "_term", F.explode(F.sequence(F.lit(1).cast("long"), F.coalesce("_n", F.lit(1).cast("long")))))
    full = terms.select(F.col(term).alias("_term"), F.struct(*terms.columns).alias("_t"))
    return every.join(full, "_term").select(*keep, *carry, *[F.col(f"_t.{c}").alias(c) for c in terms.columns])


def _word_search(
    docs: DataFrame, text: str, terms: DataFrame, term: str, shortest: int, keep: list[str], bits: int, carry: list[str],
) -> DataFrame:
    """The search for terms of ASCII letters alone, `shortest` or longer.

    Such a term lies within one run of letters of a text. So only the different runs of all texts are
    searched by characters, each once; a text then looks its runs up in the table of those that hold a term.
    """
    runs = F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(f"[A-Za-z]{{{shortest},}}"), F.lit(0)))).alias("_run")
    some = docs.where(F.length(text) > 0)
    different = stored(some.select(runs).distinct())
    index = SubstringIndex(terms, term, gram_counts(different, "_run"), bits)
    inside = stored(index.once(different, "_run", ["_run"], []).select("_run", "_term"))
    holding = KeyFilter(inside, "_run", inside.count(), bits)
    found = some.select(*keep, _row_hash(text, keep, carry), runs).where(holding.holds(F.col("_run")))
    once = found.join(inside, "_run").groupBy("_id", *keep, "_term").agg(F.first("_run").alias("_run"))
    return _for_each(docs, text, once, terms, term, keep, carry, fetch=True)


def containment_join(
    docs: DataFrame, terms: DataFrame, text: str, term: str, keep: list[str] | None = None,
    counts: DataFrame | None = None, bits: int = ANCHOR_BITS, carry: list[str] | None = None,
) -> DataFrame:
    """One row for each document row and each term row whose term the text contains.

    `text` must already be lower-cased when terms are. `keep` lists the document columns of the
    result (default: all but the text); these and the term columns must be of types that can be
    grouped. Wide columns that need not tell rows apart go to `carry`. Null and empty terms, and null and empty texts, match nothing; repeated rows on either
    side come out as often as they meet. Empty tables give no rows.

    A substring index: every term is known by its rarest gram (`counts`, by default counted here
    over all texts). The grams of the texts are probed in a bitmap of the anchors; what passes is
    joined with the terms on the anchor, and the whole term is compared at its place. Texts are read
    once to count and once to probe, however many terms there are, and no text is shuffled: only a
    stretch of twice the longest term's length around an anchor is, if the terms are too many to be
    copied to every task; after that one short row for each document row and term.
    If every term is a word of ASCII letters and no counts are given, only the different words of the
    texts are searched like that, and each text looks up its words.
    """
    keep = keep if keep is not None else [x for x in docs.columns if x != text]
    if counts is None:
        terms = stored(terms.where(F.length(term) > 0))
        others, shortest = terms.agg(F.count_if(~F.col(term).rlike(r"\A[A-Za-z]+\z")), F.min(F.length(term))).head()
        if not others:
            return _word_search(docs, text, terms, term, shortest or 1, keep, bits, carry or [])
    index = SubstringIndex(terms, term, counts if counts is not None else gram_counts(docs, text), bits)
    return index.search(docs, text, keep, carry)


def any_contained(text, terms: list[str]) -> Column:
    """True where the (lower-cased) text contains any of a fixed list of strings."""
    expr = F.lit(False)
    for t in terms:
        expr = expr | text.contains(t)
    return expr


def coverage_spans(df: DataFrame, keys: list[str], at: str, reach: float) -> DataFrame:
    """Per key, the disjoint spans covered by [at - reach, at + reach] of its points."""
    w = W.partitionBy(*keys).orderBy(at)
    new = F.when(F.col(at) - F.lag(at).over(w) <= 2 * reach, 0).otherwise(1)
    return (
        df.select(*keys, at).distinct()
        .withColumn("_n", new)
        .withColumn("_span", F.sum("_n").over(w))
        .groupBy(*keys, "_span")
        .agg((F.min(at) - reach).alias("span_lo"), (F.max(at) + reach).alias("span_hi"))
        .drop("_span")
    )


def within_spans_join(points: DataFrame, spans: DataFrame, keys: list[str], at: str, width: float) -> DataFrame:
    """Points joined to the spans that cover them.

    Both sides are cut into time buckets of `width`, so one very long key is spread over
    many tasks, and each point meets a span once.
    """
    p = points.withColumn("_b", F.floor(F.col(at) / width))
    s = spans.withColumn(
        "_b", F.explode(F.sequence(F.floor(F.col("span_lo") / width), F.floor(F.col("span_hi") / width))))
    return (
        p.join(s, [*keys, "_b"])
        .where((F.col(at) >= F.col("span_lo")) & (F.col(at) <= F.col("span_hi")))
        .drop("_b", "span_lo", "span_hi")
    )


def trailing_blocks(df: DataFrame, epoch: str, block: int) -> DataFrame:
    """Copy every row into its own time block and the next one.

    A trailing frame no longer than `block` can then be computed inside (key, block)
    partitions, which splits a hot key by time. `_own` marks the rows to keep.
    """
    b = F.floor(F.col(epoch) / block)
    return (
        df.withColumn("_blk", F.explode(F.array(b, b + 1)))
        .withColumn("_own", F.col("_blk") == b)
    )


#: Rows of one key on the split side of a salted join that go to one task.
SALT_ROWS = 50_000


def salted_join(left: DataFrame, right: DataFrame, key: str, rows: int = SALT_ROWS, parts: int | None = None) -> DataFrame:
    """Inner equi-join on one key; a key with more than `rows` rows on the right is split.

    The rows of such a key are dealt over as many places as it needs, and the left rows of the key
    are copied to each. Null keys match nothing. The result equals that of a plain join. The place
    is a hash of the row, the same when a task is run again; equal rows stay together.
    `parts` fixes the number of tasks, where the work is in the pairs and not in the rows.
    """
    sizes = right.groupBy(key).agg(F.ceil(F.count("*") / rows).cast("int").alias("_salts"))
    a = left.join(sizes, key).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))).drop("_salts")
    b = right.join(sizes, key).withColumn("_salt", F.pmod(F.xxhash64(*right.columns), F.col("_salts")).cast("int"))
    b = b.drop("_salts")
    if parts:
        a, b = (x.repartition(parts, key, "_salt") for x in (a, b))
    return a.join(b, [key, "_salt"]).drop("_salt")


def _numbered_grams(strings: DataFrame, text: str, key: str, size: int) -> DataFrame:
    """(text, key): the grams of each string, padded so that there are length + size - 1 of them, the
    repeated ones of a string numbered."""
    pad = F.concat(F.lit("\u0001" * (size - 1)), F.col(text), F.lit("\u0001" * (size - 1)))
    each = strings.select(text, F.explode(F.transform(
        F.sequence(F.lit(1), F.length(text) + size - 1), lambda i: F.substr(pad, i, F.lit(size)))).alias("_gram"))
    per = each.groupBy(text, "_gram").agg(F.count("*").alias("_n"))
    return per.select(text, "_gram", F.explode(F.sequence(F.lit(1).cast("long"), "_n")).alias("_nth")).select(
        text, F.concat_ws("\u0001", "_gram", F.col("_nth").cast("string")).alias(key))


#: 64-bit words of a string's signatures over its single characters and over its two-character grams.
SIGNATURE = {1: range(0, 2), 2: range(2, 6)}
#: Steps of length between a string and the shortest that may pair with it.
LENGTH_STEPS = 4
#: Left strings of near lengths that are compared in one part of the join.
PART_ROWS = 4096


def _signed(strings: DataFrame, text: str, name: str) -> DataFrame:
    """Each string as column `name` with its signatures: a bit for the hash of every numbered gram."""
    grams = [_numbered_grams(strings, text, "_key", size).select(
        text, (F.pmod(F.xxhash64("_key"), F.lit(64 * len(words))) + 64 * words[0]).cast("int").alias("_bit")) for size, words in SIGNATURE.items()]
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_bit").bitwiseAND(63))
    masks = [F.coalesce(F.bit_or(F.when(F.shiftright("_bit", 6) == w, one)), F.lit(0).cast("long")).alias(f"{name}_{w}")
             for words in SIGNATURE.values() for w in words]
    return grams[0].unionByName(grams[1]).groupBy(F.col(text).alias(name)).agg(*masks).withColumn(f"{name}_n", F.length(name))


def _lacking(a: str, b: str, size: int) -> Column:
    """A lower bound of how many numbered grams of string a are none of string b's."""
    return sum((F.bit_count(F.col(f"{a}_{w}").bitwiseAND(F.bitwise_not(f"{b}_{w}"))) for w in SIGNATURE[size]), F.lit(0))


def edit_ratio_join(left: DataFrame, right: DataFrame, a: str, b: str, ratio: float, rows: int = PART_ROWS) -> DataFrame:
    """Distinct string pairs (a, b) with 1 - edit distance / longer length >= ratio, for ratio >= .5.

    Strings meet by classes of length, the left ones of a class split into parts of some `rows`. Inside
    that join two bounds are read off fixed-size signatures, so that few pairs are compared in full:
    strings `edits` apart share all but `edits` of the longer one's characters, and all but twice as
    many of its padded two-character grams. A signature has a bit for each numbered gram; a bit that
    only one string has is a gram that the other lacks, so hash collisions let more pairs through and
    lose none. Only true pairs leave the join. Its work is a few machine words for each pair of near
    lengths, its memory the rows of one part.

    Null and empty strings pair with nothing; repeated rows count once; empty tables give no rows.
    """
    if ratio < 0.5:
        raise ValueError("ratios below 0.5 share no gram for certain")
    one, two = (stored(_signed(x.select(F.col(c).alias("_s")).where(F.length(c) > 0).distinct(), "_s", name))
                for x, c, name in ((left, a, "_a"), (right, b, "_b")))
    step = -math.log(min(ratio * (1 - 1e-9), 0.99)) / LENGTH_STEPS

    def band(n: str) -> Column:
        return F.floor(F.log(F.col(n)) / step).cast("int")
    one = one.withColumn("_band", F.explode(F.sequence(band("_a_n") - LENGTH_STEPS, band("_a_n") + LENGTH_STEPS)))
    parts = 8 * left.sparkSession.sparkContext.defaultParallelism
    pairs = salted_join(two.withColumn("_band", band("_b_n")), one, "_band", rows, parts)
    longer = F.greatest("_a_n", "_b_n")
    edits = longer * (1 - ratio) + 1e-9
    apart = {size: longer - F.least(F.col("_a_n") - _lacking("_a", "_b", size), F.col("_b_n") - _lacking("_b", "_a", size)) for size in SIGNATURE}
    near = pairs.where((longer - F.least("_a_n", "_b_n") <= edits) & (apart[2] <= 2 * edits) & (apart[1] <= edits))
    return near.where(F.levenshtein("_a", "_b") <= edits).select(F.col("_a").alias(a), F.col("_b").alias(b))
