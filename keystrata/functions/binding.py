"""Evaluating a group of expressions once, behind a name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def bind(df: DataFrame, **exprs: Column) -> DataFrame:
    """Adds (or replaces) columns whose expressions later stages refer to by name only.

    A long chain of plain projections, each naming the last one's columns several times,
    makes the optimizer write earlier expressions into later ones (when it merges
    projections or follows a join key down to its scan) until the plan no longer fits in
    memory. Producing the columns from a one-row generator keeps each stage's expressions
    apart; filters and column pruning still pass through it.
    """
    columns = df.columns
    structs = [f.name for f in df.schema.fields if isinstance(f.dataType, StructType) and f.name not in exprs]
    keep = [c for c in columns if c not in exprs and c not in structs]
    # Struct columns travel through the generator too: field pruning would otherwise be
    # pushed below several generators in turn, which the optimizer gets wrong.
    cells = [F.col(f"`{c}`").alias(c) for c in structs] + [e.alias(n) for n, e in exprs.items()]
    out = df.select(*[F.col(f"`{c}`") for c in keep], F.inline(F.array(F.struct(*cells))))
    return out.select(*[F.col(f"`{c}`") for c in columns], *[n for n in exprs if n not in columns])
