"""Human feedback on pairs, and how well a signature agrees with it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import upsert


def canonical(pairs: DataFrame, a: str, b: str, *rest: str) -> DataFrame:
    """Pairs once each, the smaller id first; a pair with itself is none."""
    return pairs.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("contentid1"), F.greatest(a, b).alias("contentid2"), *rest).distinct()


def upsert_feedback(current: DataFrame, changes: DataFrame) -> DataFrame:
    """contentid1, contentid2, aresimilar after changes (with seq and deleted): the last change of a pair wins."""
    return upsert(current, changes, ["contentid1", "contentid2"], "seq")


def with_feedback(pairs: DataFrame, feedback: DataFrame) -> DataFrame:
    return pairs.join(feedback, ["contentid1", "contentid2"], "left")


def confusion(found: DataFrame, known: DataFrame) -> DataFrame:
    """One row: true and false positives, false negatives, precision, recall, F1; null where they are not defined."""
    marks = known.select("contentid1", "contentid2", (F.col("aresimilar") == 1).alias("good"))
    rows = marks.join(found.select("contentid1", "contentid2", F.lit(True).alias("hit")), ["contentid1", "contentid2"], "left")
    counts = rows.agg(
        F.count_if(F.col("hit") & F.col("good")).alias("tp"), F.count_if(F.col("hit") & ~F.col("good")).alias("fp"),
        F.count_if(F.col("hit").isNull() & F.col("good")).alias("fn"), F.count("*").alias("known"), F.count_if("good").alias("positives"),
    )
    share = lambda x, y: F.try_divide(x.cast("double"), y)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.withColumns({"precision": share(tp, tp + fp), "recall": share(tp, tp + fn), "f1": share(2 * tp, 2 * tp + fp + fn), "share_positive": share(F.col("positives"), F.col("known"))})
