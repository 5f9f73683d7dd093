"""Row-level visibility as semi-joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def secured(rows: DataFrame, owner: str, memberships: DataFrame, principal: str, staff: bool = False, published: str | None = None) -> DataFrame:
    """Rows that a principal may see: all for staff, else published ones and those of an owner with whom it has a membership.

    memberships: principal, owner. Rows with a null owner are seen only if published.
    """
    if staff:
        return rows
    mine = memberships.where(F.col("principal") == principal).select(F.col("owner").alias(owner)).distinct().withColumn("_mine", F.lit(True))
    open_ = F.coalesce(F.col(published), F.lit(False)) if published else F.lit(False)
    return rows.join(mine, owner, "left").where(F.coalesce("_mine", F.lit(False)) | open_).select(*rows.columns)


def readable_documents(documents: DataFrame, backed: DataFrame, owners: DataFrame, memberships: DataFrame, principal: str, staff: bool = False) -> DataFrame:
    """Documents that a principal may read: all for staff, else those that back something published and those of its owners.

    documents and backed: document_id; owners: document_id, owner; memberships: principal, owner. Semi-joins only; each
    document once for each row it has.
    """
    if staff:
        return documents
    mine = owners.join(memberships.where(F.col("principal") == principal).select("owner"), "owner", "left_semi").select("document_id")
    return documents.join(backed.select("document_id").union(mine).distinct(), "document_id", "left_semi")
