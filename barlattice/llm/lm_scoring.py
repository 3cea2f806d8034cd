"""Cross-entropy difference between a target and a background language model.

Both are Kneser-Ney models of one order over one vocabulary of words, whose
n-grams cross word borders: the target's counts come from the chosen documents,
the background's from all. The
score of a document is its loss per token under the target model less that under
the background model; the lower, the more it is like the target.

A null text, or one without words, has no tokens and null figures. Without any
chosen text the target is the background and scores are 0. Repeated rows count
and are scored each for itself. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small
from .word_lm import score_texts


def score_documents(docs: DataFrame, targets: DataFrame, *, key: str = "doc_id", text: str = "text", order: int = 3) -> DataFrame:
    """``targets`` holds the keys of the target documents; ``order`` counts words.
    Per row: ``key, n_tokens, target_loss, background_loss, score``."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    chosen = targets.select(F.col(key).alias("key"), F.lit(True).alias("chosen")).where("key is not null").distinct()
    marked = rows.join(small(chosen), "key", "left").select("key", "text", F.coalesce("chosen", F.lit(False)).alias("chosen"))
    scored = score_texts(marked, ["chosen", "total"], extra=("key",), order=order)
    if scored is None:
        empty = F.lit(None).cast("double")
        return rows.select(F.col("key").alias(key), F.lit(0).cast("long").alias("n_tokens"), empty.alias("target_loss"), empty.alias("background_loss"), empty.alias("score"))
    loss = [F.round(F.try_divide(F.col("losses")[k], F.col("n_tokens")), 6) for k in (0, 1)]
    return scored.select(F.col("key").alias(key), "n_tokens", loss[0].alias("target_loss"), loss[1].alias("background_loss"), F.round(loss[0] - loss[1], 6).alias("score"))
