"""Licence scan by canonical digest, in DataFrame functions only.

A text and a licence that differ in case, punctuation, copyright lines or spelling have one
canonical form; the digests of canonical forms are hash-joined. Entire documents and entire
lines are looked up alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfsight.llm.common import own_columns

#: Licence notices and short licence texts as published.
KNOWN = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3."],
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions:\n"
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        "Software.\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT "
        "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL "
        "THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, "
        "TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."],
    "0BSD": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."],
}
COPYRIGHT = r"(?i)(^|\n)[ \t]*(copyright|\(c\)|©|all rights reserved)[^\n]*"
MARKS = r"[^a-z0-9\n\x{80}-\x{10FFFF}]+"
SPELLINGS = [(r"\b(sub)?licenc(e|es|ed|ing)\b", r"{1}licens{2}"), (r"\bnoncommercial\b", "non commercial"), (r"\bversion (\d)", r"v{1}")]


def canonical_lines(text: Column) -> Column:
    """The text in canonical form, its lines still apart."""
    c = F.regexp_replace(text, COPYRIGHT, "$1")
    c = F.regexp_replace(F.lower(c), MARKS, " ")
    for pattern, to in SPELLINGS:
        c = F.regexp_replace(c, pattern, to.replace("{1}", "$1").replace("{2}", "$2"))
    return c


def _whole(lines: Column) -> Column:
    return F.trim(F.regexp_replace(lines, r"[ \n]+", " "))


def known_licences(spark: SparkSession, texts: dict[str, list[str]] | None = None) -> DataFrame:
    rows = [(k, t) for k, ts in (texts or KNOWN).items() for t in ts]
    return spark.createDataFrame(rows, "licence string, text string")


def scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, licence, n_notices, licences) for every row of documents (doc_id, text).

    known has (licence, text). licence is the licence that the entire text is, null if none (the
    least by name if several texts agree); n_notices counts its lines that are known texts, and
    licences lists their names, sorted and joined by commas, the entire text's included. Texts
    whose canonical form is empty, nulls among them, match nothing. Rows that repeat a doc_id keep
    their own results. An empty table gives no rows, without known licences nothing matches. Extra
    columns are not read.
    """
    names = (
        own_columns(known, ["licence", "text"]).select("licence", _whole(canonical_lines(F.col("text"))).alias("form"))
        .where("form <> ''").groupBy(F.sha2(F.col("form").cast("binary"), 256).alias("digest"))
        .agg(F.min("licence").alias("licence"), F.first(F.length("form")).alias("n")))
    # Lengths rule out nearly every line before hashing; one number for each distinct length.
    lengths = [x["n"] for x in names.select("n").distinct().collect()]
    lines = canonical_lines(F.coalesce("text", F.lit("")))
    forms = own_columns(docs, ["doc_id", "text"]).select("doc_id", F.xxhash64("text").alias("tk"), lines.alias("c"))
    forms = forms.select("doc_id", "tk", _whole(F.col("c")).alias("form"), F.transform(F.split("c", "\n"), lambda x: F.trim(x)).alias("lines"))
    digest = lambda x: F.sha2(x.cast("binary"), 256)
    fits = lambda x: F.length(x).isin(lengths)
    units = F.concat(
        F.when(fits(F.col("form")), F.array(F.struct(digest(F.col("form")).alias("digest"), F.lit(True).alias("entire"), F.lit(1).alias("n"))))
        .otherwise(F.array().cast("array<struct<digest:string,entire:boolean,n:int>>")),
        F.transform(F.filter("lines", fits), lambda x: F.struct(digest(x).alias("digest"), F.lit(False).alias("entire"), F.lit(1).alias("n"))))
    forms = forms.select("doc_id", "tk", units.alias("units"))
    found = (
        forms.where(F.size("units") > 0).select("doc_id", "tk", F.explode("units").alias("u")).select("doc_id", "tk", "u.*")
        .join(names.select("digest", F.col("licence").alias("name")), "digest")
        .groupBy("doc_id", "tk").agg(
            F.max(F.when(F.col("entire"), F.col("name"))).alias("licence"),
            F.count(F.when(~F.col("entire"), 1)).alias("lines"), F.array_sort(F.collect_set("name")).alias("all")))
    copies = forms.groupBy("doc_id", "tk").agg(F.count("*").alias("copies")).where("copies > 1")
    found = found.join(copies, [found["doc_id"].eqNullSafe(copies["doc_id"]), found["tk"] == copies["tk"]], "left") \
        .select(found["doc_id"].alias("_d"), found["tk"].alias("_t"), "licence", (F.col("lines") / F.coalesce("copies", F.lit(1))).cast("long").alias("lines"), "all")
    return forms.join(found, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("tk") == F.col("_t")), "left").select(
        "doc_id", "licence", F.coalesce("lines", F.lit(0)).cast("long").alias("n_notices"),
        F.coalesce(F.array_join("all", ","), F.lit("")).alias("licences"))


def oracle_sql(texts: dict[str, list[str]] | None = None) -> str:
    """The same result in SQL over `documents`."""
    def sql(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def form(col: str) -> str:
        c = f"regexp_replace({col}, {sql(COPYRIGHT)}, '\\1', 'g')"
        c = f"regexp_replace(lower({c}), {sql(MARKS)}, ' ', 'g')"
        for pattern, to in SPELLINGS:
            c = f"regexp_replace({c}, {sql(pattern)}, {sql(to.replace('{1}', chr(92) + '1').replace('{2}', chr(92) + '2'))}, 'g')"
        return c
    values = ", ".join(f"({sql(k)}, {sql(t)})" for k, ts in (texts or KNOWN).items() for t in ts)
    whole = lambda c: f"trim(regexp_replace({c}, '[ \\n]+', ' ', 'g'))"
    return f"""
WITH known AS (SELECT min(licence) AS licence, form FROM (
    SELECT licence, {whole(form('text'))} AS form FROM (VALUES {values}) k(licence, text)) WHERE form <> '' GROUP BY form),
forms AS (SELECT doc_id, {form("coalesce(text, '')")} AS c FROM documents),
units AS (SELECT doc_id, {whole('c')} AS form, TRUE AS entire FROM forms
    UNION ALL SELECT doc_id, trim(unnest(string_split(c, chr(10)))) AS form, FALSE AS entire FROM forms),
found AS (SELECT doc_id, max(CASE WHEN entire THEN licence END) AS licence, count(CASE WHEN NOT entire THEN 1 END) AS n,
    array_to_string(list_sort(list(DISTINCT licence)), ',') AS licences FROM units JOIN known USING (form) GROUP BY doc_id)
SELECT d.doc_id, f.licence, coalesce(f.n, 0)::BIGINT AS n_notices, coalesce(f.licences, '') AS licences
FROM documents d LEFT JOIN found f ON d.doc_id = f.doc_id"""
