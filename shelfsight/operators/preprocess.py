"""Transcript preprocessing over a corpus: six stages in one narrow pass, with metrics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfsight.functions import fixed
from shelfsight.functions import text as tx

STAGES = ["Noise Removal", "Semantic Filtering", "Entity Focus",
          "Context Window Optimization", "De-duplication", "Length Limiting"]


@dataclass(frozen=True)
class Options:
    max_length: int = 8000
    min_density: float = 0.02
    window: int = 200
    aggressive: bool = True
    aggressiveness: float = 0.5  # below 0.3 stages 2-4 are skipped
    overlapping: bool = True  # whether hits of a keyword that overlap each other all count


def preprocess(docs: DataFrame, keywords: list[str] | None = None, options: Options = Options()) -> DataFrame:
    """docs(video_id, text, ...) -> one row per document with the reduced text and metrics.

    A narrow chain of projections, no shuffle. `stages` holds (stage, name, input_len,
    output_len) of the stages that ran.
    """
    keywords = fixed.DOMAIN_KEYWORDS if keywords is None else keywords
    zero = F.lit(0).cast("long")
    lens: list[str] = ["_l0"]

    def step(df, text_col):
        lens.append(f"_l{len(lens)}")
        return df.withColumn("_t", text_col).withColumn(lens[-1], F.length("_t"))

    d = docs.withColumn("_l0", F.length("text"))
    d = d.withColumn("_x", tx.remove_fillers(F.col("text"))).withColumn("fillers_removed", F.col("_x.removed"))
    d = d.withColumn("_y", tx.drop_sponsor_sentences(F.col("_x.text"))).withColumn("sponsors_removed", F.col("_y.dropped"))
    d = step(d, tx.strip_intro_outro(F.col("_y.text")))
    ran = [1]
    if keywords and options.aggressiveness >= 0.3:
        d = d.withColumn("_x", tx.keep_keyword_sentences(F.col("_t"), keywords))
        d = step(d.withColumn("sentences_removed", F.col("_x.dropped")), F.col("_x.text"))
        d = d.withColumn("_x", tx.entity_focus(F.col("_t"), keywords, options.min_density, options.aggressive))
        d = step(d.withColumn("keywords_found", F.size("_x.found").cast("long")), F.col("_x.text"))
        d = step(d, tx.context_windows(F.col("_t"), keywords, options.window, overlapping=options.overlapping))
        ran += [2, 3, 4]
    else:
        d = d.withColumn("sentences_removed", zero).withColumn("keywords_found", zero)
    d = d.withColumn("_x", tx.dedupe_pieces(F.col("_t")))
    d = step(d.withColumn("repeats_removed", F.col("_x.repeats")), F.col("_x.text"))
    d = step(d, tx.limit_length(F.col("_t"), options.max_length))
    ran += [5, 6]
    stages = F.array(*[
        F.struct(F.lit(k).cast("long").alias("stage"), F.lit(STAGES[k - 1]).alias("name"),
                 F.col(lens[i]).cast("long").alias("input_len"), F.col(lens[i + 1]).cast("long").alias("output_len"))
        for i, k in enumerate(ran)])
    n_in, n_out = F.col("_l0"), F.col(lens[-1])
    return d.select(
        *docs.columns, "fillers_removed", "sponsors_removed", "sentences_removed", "keywords_found",
        "repeats_removed", stages.alias("stages"), F.col("_t").alias("processed"),
        F.when(n_in > 0, (n_in - n_out) / n_in * 100).otherwise(0.0).alias("reduction_pct"),
        F.ceil(n_in / 4).alias("tokens_before"), F.ceil(n_out / 4).alias("tokens_after"))


def stage_metrics(processed: DataFrame, key: str = "video_id") -> DataFrame:
    red = F.col("input_len") - F.col("output_len")
    return processed.select(key, F.inline_outer("stages")).withColumn("reduction", red).withColumn(
        "reduction_pct", F.when(F.col("input_len") > 0, red / F.col("input_len") * 100).otherwise(0.0))


def sufficient(docs: DataFrame, keywords: list[str], min_density: float = 0.02, aggressiveness: float = 0.5) -> DataFrame:
    """Documents with enough domain words; lenient or keyword-less verticals pass all."""
    if not keywords or aggressiveness < 0.3:
        return docs.withColumn("keyword_share", F.lit(None).cast("double"))
    return docs.withColumn("keyword_share", tx.keyword_word_share(F.col("text"), keywords)).where(
        F.col("keyword_share") >= min_density)
