"""Quality by perplexity under a Kneser-Ney model of trusted text.

The model is over words, across the words of a text, and trained on all trusted
documents. Every document gets its perplexity per token (a word or the text's end); in each language, documents above the quantile ``keep`` of
that language's perplexities are rejected. Quantiles come from mergeable
sketches over all documents.

A null text, or one without words, has a null perplexity and is rejected. A null
language is a language of its own. Without trusted text nothing can be judged:
perplexities are null and nothing is kept. Repeated rows are judged each for
itself. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small, written
from .word_lm import score_texts


def classify(docs: DataFrame, trusted: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", order: int = 3, keep: float = 0.9, accuracy: int = 10_000, slices_: int = 12) -> DataFrame:
    """``trusted`` holds the keys of trusted documents; ``order`` counts words; the more
    ``slices_``, the less of the tokens is on disk at once. Per row: ``key, lang, n_tokens, perplexity, threshold, kept``."""
    rows = docs.select(F.col(key).alias("key"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    own = trusted.select(F.col(key).alias("key"), F.lit(True).alias("chosen")).where("key is not null").distinct()
    marked = rows.join(small(own), "key", "left").select("key", "lang", "text", F.coalesce("chosen", F.lit(False)).alias("chosen"))
    scored = score_texts(marked, ["chosen"], extra=("key", "lang"), order=order, slices_=slices_)
    if scored is None:
        scored = rows.select("key", "lang", F.lit(0).cast("long").alias("n_tokens"), F.lit(None).cast("double").alias("perplexity"))
    else:
        scored = scored.select("key", "lang", "n_tokens", F.round(F.exp(F.try_divide(F.col("losses")[0], F.col("n_tokens"))), 6).alias("perplexity"))
    scored = written(scored, "scored")
    bounds = scored.groupBy(F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("of")).agg(F.percentile_approx("perplexity", keep, accuracy).alias("threshold"))
    # a row for each language: sent to the scored rows, so that those of a common language stay where they are
    bounds = small(written(bounds, "bounds"))
    out = scored.withColumn("of", F.coalesce(F.concat(F.lit("="), "lang"), F.lit(""))).join(bounds, "of", "left")
    kept = F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(False))
    return out.select(F.col("key").alias(key), F.col("lang").alias(lang), "n_tokens", "perplexity", "threshold", kept.alias("kept"))
