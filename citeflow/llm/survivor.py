"""The best representative of each group of duplicates.

Records are points in (completeness, recency, trust). The skyline of a group
holds the records that no other one dominates; the policy picks one of them
lexicographically. Its first criterion is whether the trust is enough, not how
high it is; then come completeness, recency and the least id. So a record that is
as complete and recent as another but less trusted can be first by the policy and
is yet never chosen, as it is not on the skyline. A null field of the chosen
record is filled from the best record of its layer that has a value, else from
the next layer's.

A group may hold any number of rows, so it is reduced before it is gathered: all
records of equal (completeness, trust, day) have one dominance layer, and each
such cell keeps, field by field, the value of its best record. There are as many
cells as levels times levels times days of the calendar, whatever the rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def layers(points: list[tuple]) -> list[int]:
    """Dominance layer of each point (larger is better in each dimension): 1
    for the skyline, else one more than the deepest of its dominators. Equal
    points do not dominate one another. The time is the number of points times
    that of distinct values in all dimensions but the first."""
    depth: dict[tuple, int] = {}
    deepest: dict[tuple, int] = {}  # by the other dimensions, of points whose first is as large or larger
    for p in sorted(set(points), reverse=True):
        depth[p] = deepest[p[1:]] = 1 + max((v for q, v in deepest.items() if all(x >= y for x, y in zip(q, p[1:]))), default=0)
    return [depth[p] for p in points]


def complete(fields: list[Column]) -> Column:
    """How many of the fields hold a value; blank strings and empty lists
    count as none when they are null beforehand."""
    total = F.lit(0)
    for f in fields:
        total = total + F.when(f.isNotNull(), 1).otherwise(0)
    return total


def survivors(records: DataFrame, group: str, key: str, fields: list[str], recency: str, trust: str, enough: int = 8) -> DataFrame:
    """One row for each group: group, key of the chosen record, the trust it
    has, how many records and layers there are, and each field with its best
    value, with ``filled`` naming the fields that came from another record.

    records: one row for each record; rows whose group or key is null are left
    out; rows that repeat a key count as records of it; fields of any atomic or
    array type and any name; recency a timestamp (null is oldest); trust an
    integer (null is 0), of which ``enough`` is enough for the policy. Ties go to
    the least key."""
    kinds = dict(records.dtypes)
    day = F.coalesce(F.datediff(F.col(recency).cast("date"), F.lit("1970-01-01")), F.lit(-100000))
    rows = records.where(F.col(group).isNotNull() & F.col(key).isNotNull()).select(
        F.col(group).alias("g"), F.col(key).alias("k"), complete([F.col(f"`{f}`") for f in fields]).alias("c"),
        F.coalesce(F.col(trust).cast("int"), F.lit(0)).alias("t"), day.alias("d"), F.coalesce(F.col(recency), F.lit("0001-01-01").cast("timestamp")).alias("at"),
        *[F.to_json(F.struct(F.col(f"`{f}`").alias("v"))).alias(f"f{i}") for i, f in enumerate(fields)],
    )
    # Within a cell the latest record comes first, then the least key. The
    # order is ascending, so that min_by serves for all.
    first = F.struct((-F.unix_micros("at")).alias("o"), "k")
    cells = rows.groupBy("g", "c", "t", "d").agg(
        F.min_by("k", first).alias("k"), F.count("*").alias("n"), F.min(first)["o"].alias("o"),
        *[F.min_by(F.when(F.col(f"f{i}") != "{}", F.struct(F.col(f"f{i}").alias("v"), "k")), F.when(F.col(f"f{i}") != "{}", first)).alias(f"f{i}") for i in range(len(fields))],
    )
    key_kind = records.schema[key].dataType
    one = T.StructType([T.StructField("g", records.schema[group].dataType), T.StructField("k", key_kind), T.StructField("trust", T.IntegerType()), T.StructField("records", T.LongType()), T.StructField("layers", T.IntegerType()), T.StructField("filled", T.ArrayType(T.StringType())), *[T.StructField(f"f{i}", T.StringType()) for i in range(len(fields))]])
    gathered = cells.groupBy("g").agg(F.collect_list(F.struct("c", "t", "d", "k", "n", "o", *[f"f{i}" for i in range(len(fields))])).alias("cells"))

    def choose(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in it:
            out = []
            for g, cells in zip(batch["g"], batch["cells"]):
                cells = list(cells)
                depth = layers([(x["d"], x["c"], x["t"]) for x in cells])
                order = sorted(range(len(cells)), key=lambda i: (depth[i], cells[i]["t"] < enough, -cells[i]["c"], -cells[i]["d"], cells[i]["o"], cells[i]["k"]))
                best = cells[order[0]]
                values, filled = [], []
                for j, f in enumerate(fields):
                    got = next((cells[i][f"f{j}"] for i in order if cells[i][f"f{j}"] is not None), None)
                    values.append(None if got is None else got["v"])
                    if got is not None and got["k"] != best["k"]:
                        filled.append(f)
                out.append((g, best["k"], best["t"], sum(x["n"] for x in cells), max(depth), filled, *values))
            yield pd.DataFrame(out, columns=one.names)

    chosen = gathered.mapInPandas(choose, one)
    return chosen.select(
        F.col("g").alias(group), F.col("k").alias(key), "trust", "records", "layers", "filled",
        *[F.from_json(f"f{i}", f"v {kinds[f]}")["v"].alias(f) for i, f in enumerate(fields)],
    )
