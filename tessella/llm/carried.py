"""Stages that return their rows with all of the caller's columns, whatever these are called."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OTHERS = "_others"


def carry(docs: DataFrame, own: tuple[str, ...], stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What the stage makes of docs, which meets only the columns it works on: the others travel in one struct, so none of them can clash with a working name.

    Columns keep their order; those that the stage adds come last, in place of any of the same name, and those that it drops are gone.
    """
    others = [c for c in docs.columns if c not in own]
    if not others:
        return stage(docs)
    done = stage(docs.select(*[c for c in docs.columns if c in own], F.struct(*[F.col(f"`{c}`") for c in others]).alias(OTHERS)))
    new = [c for c in done.columns if c not in (*own, OTHERS)]
    kept = [F.col(OTHERS).getField(c).alias(c) if c in others else F.col(c) for c in docs.columns if c not in new and (c in others or c in done.columns)]
    return done.select(*kept, *new)
