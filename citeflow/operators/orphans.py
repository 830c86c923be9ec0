"""References to records that do not exist.

A reference is a tuple of columns, any of which may be null. Rows are grouped by
null mask and each mask is anti-joined on its non-null columns only, under the
declared match semantics of SQL's MATCH clause:

- ``simple``: a reference with any null column is satisfied;
- ``partial``: a reference is satisfied by a target equal on its non-null
  columns; with all columns null it is satisfied;
- ``full``: all columns null is satisfied, some null is an orphan.

``required`` columns are part of every mask: a null there means that there is
no reference at all. So with required columns no mask is without a column, and a
reference whose other columns are all null is compared on the required ones
(partial) or an orphan (full). The joins are equi-joins on aggregated targets (one row for
each distinct key), so a hot key is one row on the target side and AQE splits
it on the reference side."""

from __future__ import annotations

from functools import reduce
from itertools import product
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MATCHES = ("simple", "partial", "full")


def targets(df: DataFrame, keys: list[str], arrived: str | None = None, deleted: str | None = None) -> DataFrame:
    """One row for each distinct key: keys, first_at (first arrival) and gone
    (some row is a tombstone)."""
    return df.groupBy(*keys).agg(
        (F.min(arrived) if arrived else F.lit(None).cast("timestamp")).alias("first_at"),
        (F.max(F.coalesce(F.col(deleted), F.lit(False))) if deleted else F.lit(False)).alias("gone"),
    )


def orphans(
    refs: DataFrame,
    found: DataFrame,
    keys: list[str],
    at: str | None = None,
    match: str = "partial",
    required: list[str] | None = None,
) -> DataFrame:
    """The rows of refs that refer to nothing, with a column ``why``: missing,
    deleted or later.

    found has the keys, first_at and gone, as ``targets`` gives them. ``at`` is
    the time of the reference: a target that first arrives after it does not
    count yet. A null time on either side is not later. Columns of refs other
    than the keys may have any name: both sides' keys are renamed for the join."""
    if match not in MATCHES:
        raise ValueError(f"match is one of {', '.join(MATCHES)}")
    required = required or []
    loose = [k for k in keys if k not in required]
    held = refs.withColumn("__ref", F.struct(*[F.col(f"`{c}`") for c in refs.columns]))
    held = held.select("__ref", *[F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(keys)], (F.col(f"`{at}`") if at else F.lit(None).cast("timestamp")).alias("__at"))
    right = found.select(*[F.col(f"`{k}`").alias(f"__t{i}") for i, k in enumerate(keys)], F.col("first_at").alias("__first"), F.col("gone").alias("__gone"))
    slot = {k: i for i, k in enumerate(keys)}
    for k in required:
        held = held.where(F.col(f"__k{slot[k]}").isNotNull())
    out = None
    # Only partial match looks at each mask by itself: simple asks for whole references, and under full a null column equals no target's.
    for mask in product((True, False), repeat=len(loose)) if match == "partial" else [(True,) * len(loose)]:
        live = [k for k in keys if k in required or mask[loose.index(k)]]
        if not live:
            continue
        if match == "full":
            rows = held.where(reduce(or_, [F.col(f"__k{slot[k]}").isNotNull() for k in keys]))
        else:
            rows = held
            for k, on in zip(loose, mask):
                rows = rows.where(F.col(f"__k{slot[k]}").isNotNull() if on else F.col(f"__k{slot[k]}").isNull())
        # The least demanding target of each partial key: one that is not gone, the earliest.
        best = right.groupBy(*[f"__t{slot[k]}" for k in live]).agg(
            F.min_by(F.struct("__gone", "__first"), F.struct("__gone", F.coalesce("__first", F.lit("0001-01-01").cast("timestamp")))).alias("__best")
        )
        joined = rows.join(best, [F.col(f"__k{slot[k]}") == F.col(f"__t{slot[k]}") for k in live], "left")
        why = (
            F.when(F.col("__best").isNull(), "missing")
            .when(F.col("__best.__gone"), "deleted")
            .when(F.col("__best.__first") > F.col("__at"), "later")
        )
        part = joined.select("__ref", why.alias("why")).where("why IS NOT NULL")
        out = part if out is None else out.unionByName(part)
    if out is None:  # no mask is left: nothing can be an orphan
        out = held.select("__ref", F.lit("missing").alias("why")).limit(0)
    kind: StructType = refs.schema
    return out.select(*[F.col("__ref").getField(c).alias(c) for c in kind.names if c != "why"], "why")
