"""Which files to delete, as rows to review. Nothing here deletes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

POLICIES = ("keep_first", "keep_last")


def deletion_plan(files: DataFrame, policy: str = "keep_first") -> DataFrame:
    """(path, contentid, action, reason) of every file of a shared content: one is kept, in path order first or last.

    Further paths of the kept file's inode stay too: deleting them frees nothing.
    """
    if policy not in POLICIES:
        raise ValueError(f"policy is one of {', '.join(POLICIES)}")
    rows = files.select("contentid", "inode", F.struct("dir", "name").alias("at"))
    pick = F.min if policy == "keep_first" else F.max
    chosen = rows.groupBy("contentid").agg(pick(F.struct("at", "inode")).alias("kept"), F.count("*").alias("n")).where("n > 1")
    path = lambda x: F.concat_ws("/", x["dir"], x["name"])
    joined = rows.join(chosen, "contentid")
    same, linked = F.col("at") == F.col("kept.at"), F.coalesce(F.col("inode") == F.col("kept.inode"), F.lit(False))
    action = F.when(same | linked, "keep").otherwise("delete")
    reason = F.when(same, "chosen").when(linked, "hard link of the chosen file").otherwise(F.concat(F.lit("same content as "), path(F.col("kept.at"))))
    return joined.select(path(F.col("at")).alias("path"), "contentid", action.alias("action"), reason.alias("reason"))


def decided_plan(files: DataFrame, decisions: DataFrame, policy: str = "keep_first") -> DataFrame:
    """deletion_plan with the reviewer's choices. decisions: path, action (keep or delete), for any of the files.

    A decision is followed as it stands, and where one file of a content is decided to be kept, the others go unless
    decided too. A content of which everything were to be deleted keeps its file by the policy.
    """
    plan = deletion_plan(files, policy).join(decisions.select("path", F.col("action").alias("decided")).dropDuplicates(["path"]), "path", "left")
    kept_one = plan.where("decided = 'keep'").select("contentid").distinct().withColumn("has_kept", F.lit(True))
    action = F.coalesce("decided", F.when(F.col("has_kept"), "delete").otherwise(F.col("action")))
    done = plan.join(kept_one, "contentid", "left").withColumn("new", action)
    left = done.groupBy("contentid").agg(F.count_if(F.col("new") == "keep").alias("stay"))
    final = F.when((F.col("stay") == 0) & (F.col("reason") == "chosen"), "keep").otherwise(F.col("new"))
    reason = F.when((F.col("stay") == 0) & (F.col("reason") == "chosen"), "last one of its content").when(F.col("decided").isNotNull(), "decided").when(F.col("has_kept"), "another one was chosen").otherwise(F.col("reason"))
    return done.join(left, "contentid").select("path", "contentid", final.alias("action"), reason.alias("reason"))


def truncated_plan(pairs: DataFrame) -> DataFrame:
    """(path, action, reason): the small side of every truncated pair."""
    return pairs.groupBy(F.col("small_path").alias("path")).agg(F.min("large_path").alias("large")).select("path", F.lit("delete").alias("action"), F.concat(F.lit("truncated copy of "), F.col("large")).alias("reason"))


def numbered(plan: DataFrame, order: str) -> DataFrame:
    """plan with the place of each row within its content, for stepwise review."""
    return plan.withColumn("place", F.row_number().over(Window.partitionBy("contentid").orderBy(order)))
