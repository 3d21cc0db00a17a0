"""Deletions that cascade over several levels of tables, by their foreign keys."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from graphlib import CycleError, TopologicalSorter
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import kept


class ForeignKey(NamedTuple):
    child: str
    column: str
    parent: str
    key: str


SCHEMA = (
    ForeignKey("documents", "owner_id", "users", "owner_id"), ForeignKey("chunks", "document_id", "documents", "document_id"), ForeignKey("chunks", "owner_id", "users", "owner_id"),
    ForeignKey("jobs", "document_id", "documents", "document_id"), ForeignKey("jobs", "owner_id", "users", "owner_id"), ForeignKey("sessions", "owner_id", "users", "owner_id"), ForeignKey("messages", "session_id", "sessions", "session_id"),
)


def _levels(tables: Mapping[str, DataFrame], keys: Sequence[ForeignKey], root: str) -> list[str]:
    """The tables below root, parents first."""
    graph: dict[str, set[str]] = {name: set() for name in tables}
    for k in keys:
        graph[k.child].add(k.parent)
    try:
        order = list(TopologicalSorter(graph).static_order())
    except CycleError as e:
        raise ValueError("foreign keys that form a circle") from e
    below = {root}
    for name in order:
        if graph[name] & below:
            below.add(name)
    return [name for name in order if name in below and name != root]


def delete(tables: Mapping[str, DataFrame], root: str, doomed: DataFrame, keys: Sequence[ForeignKey] = SCHEMA) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """What is left of each table, and what is gone of root and the tables below it, when the rows of root that ``doomed`` names go.

    doomed has columns of root; rows that agree in all of them go. A row goes if any of its parents goes; null keys and keys without a parent stay. Repeated rows go or stay together. Each table
    is rewritten once, and only keys are carried down, level by level, through tables in the shared folder.
    """
    left, gone = dict(tables), {}
    named = doomed.distinct()
    left[root], gone[root] = tables[root].join(named, named.columns, "left_anti"), tables[root].join(named, named.columns, "left_semi")
    carried: dict[tuple[str, str], DataFrame] = {}

    def lost(parent: str, key: str) -> DataFrame:
        if (parent, key) not in carried:
            carried[parent, key] = kept(gone[parent].select(F.col(key).alias("_lost")).where("_lost is not null").distinct(), f"lost-{parent}")
        return carried[parent, key]

    for child in _levels(tables, keys, root):
        ups = [k for k in keys if k.child == child and k.parent in gone]
        rows = tables[child]
        left[child] = reduce(lambda df, k: df.join(lost(k.parent, k.key), F.col(f"`{k.column}`") == F.col("_lost"), "left_anti"), ups, rows)
        # A row with several lost parents is counted at the first of them.
        parts, rest = [], rows
        for k in ups:
            parts.append(rest.join(lost(k.parent, k.key), F.col(f"`{k.column}`") == F.col("_lost"), "left_semi"))
            rest = rest.join(lost(k.parent, k.key), F.col(f"`{k.column}`") == F.col("_lost"), "left_anti")
        gone[child] = reduce(DataFrame.unionByName, parts)
    return left, gone


def unlinked(gone: DataFrame, left: DataFrame, checksum: str = "checksum") -> DataFrame:
    """Checksums of files that lost their last document, of any owner."""
    return gone.select(checksum).where(F.col(checksum).isNotNull()).distinct().join(left.select(checksum), checksum, "left_anti")
