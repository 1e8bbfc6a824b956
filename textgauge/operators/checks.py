"""Data-quality constraints: the pairing of engines, the completeness of tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from textgauge.sources import files, sinks


class CheckFailed(AssertionError):
    """A constraint does not hold; the message names the first rows against it."""


def _none(rows: DataFrame, what: str) -> None:
    if found := rows.limit(5).collect():
        raise CheckFailed(f"{what}: {', '.join(str(tuple(r)) for r in found)}")


def unpaired(rows: DataFrame, by: tuple[str, ...] = ("track", "lang"), engine: str = "engine", utt: str = "utt_id") -> DataFrame:
    """by, utterance, n_engines, n_expected for utterances that not all engines of a (track, lang) have."""
    engines = rows.groupBy(*by).agg(F.count_distinct(engine).alias("n_expected"))
    have = rows.groupBy(*by, utt).agg(F.count_distinct(engine).alias("n_engines"))
    return have.join(engines, list(by)).where("n_engines <> n_expected")


def paired(rows: DataFrame, how: str = "strict", by: tuple[str, ...] = ("track", "lang"), engine: str = "engine", utt: str = "utt_id") -> DataFrame:
    """strict: `rows`, if all engines have the same utterances, else CheckFailed. intersect: the rows of common utterances."""
    odd = unpaired(rows, by, engine, utt)
    if how == "intersect":
        return rows.join(odd.select(*by, utt), [*by, utt], "left_anti")
    if how != "strict":
        raise ValueError(how)
    _none(odd, "utterances that not all engines have")
    return rows


def without_failed(rows: DataFrame, failed: DataFrame, by: tuple[str, ...] = ("track", "lang"), utt: str = "utt_id") -> DataFrame:
    """Drops an utterance for all engines if any engine failed on it."""
    return rows.join(failed.select(*by, utt).distinct(), [*by, utt], "left_anti")


def failed_share(rows: DataFrame, failed: DataFrame, by: tuple[str, ...] = ("track", "lang"), utt: str = "utt_id", most: float = 0.02) -> DataFrame:
    """by, n_utterances, n_failed, share, flagged (more than `most`)."""
    lost = failed.select(*by, utt).distinct().withColumn("__lost", F.lit(1))
    each = rows.select(*by, utt).distinct().join(lost, [*by, utt], "left")
    out = each.groupBy(*by).agg(F.count("*").alias("n_utterances"), F.count("__lost").alias("n_failed"))
    return out.withColumn("share", F.col("n_failed") / F.col("n_utterances")).withColumn("flagged", F.col("share") > most)


def same_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """keys and side for what only one of the tables has: the symmetric difference of their key sets."""
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct()
    return a.exceptAll(b).withColumn("side", F.lit("left")).union(b.exceptAll(a).withColumn("side", F.lit("right")))


def require_rows(rows: DataFrame, n: int) -> None:
    if (got := rows.count()) != n:
        raise CheckFailed(f"{got} rows, expected {n}")


def require_cells(rows: DataFrame, cells: int, each: int, keys: tuple[str, ...] = ("engine", "lang")) -> None:
    """As many cells, and so many rows in each."""
    sizes = rows.groupBy(*keys).count()
    _none(sizes.where(F.col("count") != each), f"cells without {each} rows")
    require_rows(sizes, cells)


def require_not_null(rows: DataFrame, column: str) -> None:
    _none(rows.where(F.col(column).isNull()), f"null {column}")


def require_same_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> None:
    _none(same_keys(left, right, keys), "keys on one side only")


# --- constraints that ride on a write


@dataclass(frozen=True)
class Rule:
    """A condition that no row may meet, and the columns that name a row that does."""

    name: str
    broken: Column
    names: tuple[str, ...]


def key_digest(keys: Iterable[str], times: Column | None = None) -> list[Column]:
    """Two sums that tell multisets of keys apart in whatever order they come: no two different ones agree but by a chance of some 2^-60 each. `times`: how often a row counts."""
    text = F.to_json(F.struct(*(F.col(k).cast("string").alias(k) for k in keys)), {"ignoreNullFields": "false"})
    hashes = (F.xxhash64(text), F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10))
    return [F.sum(h.cast("decimal(38,0)") * (1 if times is None else times)) for h in hashes]


def observed(rows: DataFrame, rules: Iterable[Rule] = (), **more: Column) -> tuple[DataFrame, Observation]:
    """`rows`, and an observation that a single pass over them, such as their write, fills: rows, for each rule how many rows
    break it and the first of them by its names, and further aggregates. Every pass counts, that which samples rows for ranges too."""
    watch = Observation()
    told = [F.count("*").alias("rows")]
    for r in rules:
        told += [F.count_if(r.broken).alias(f"n {r.name}"), F.min(F.when(r.broken, F.to_json(F.struct(*r.names)))).alias(f"first {r.name}")]
    return rows.observe(watch, *told, *(c.alias(name) for name, c in more.items())), watch


def settle(watch: Observation, rules: Iterable[Rule]) -> dict:
    """What the pass found; CheckFailed, with counts and a row for each broken rule, if any is."""
    found = watch.get
    broken = [f"{r.name}: {found[f'n {r.name}']} rows, such as {found[f'first {r.name}']}" for r in rules if found[f"n {r.name}"]]
    if broken:
        raise CheckFailed("; ".join(broken))
    return found


def write_package(transcriptions: DataFrame, cells: DataFrame, folder: str, card: str, rows: int | None = None, n_cells: int | None = None, each: int | None = None) -> dict[str, int]:
    """Writes {folder}/transcriptions and {folder}/cell_scores as ordered Parquet and copies the card, if all constraints hold; else nothing.

    The constraints: a card; no null hypothesis; so many rows, cells, and utterances in each cell (where given); and the cells of both
    tables the same, with as many utterances as they say. The write of each table also adds up what is checked, so that there is no pass for the checks: a digest of
    (engine, lang) over the utterances against that over the cells, times their utterances. Only where these differ are the tables joined,
    to name what one of them lacks.
    """
    spark = transcriptions.sparkSession
    if not files.exists(spark, card):
        raise CheckFailed(f"no card {card}")
    staged = f"{folder}/_staged-{uuid.uuid4().hex}"
    keys, each_rule = ["engine", "lang"], [Rule(f"cells without {each} utterances", ~F.col("n_utterances").eqNullSafe(F.lit(each)), ("engine", "lang", "n_utterances"))] if each is not None else []
    no_text = [Rule("null hypothesis", F.col("hypothesis").isNull(), ("engine", "lang", "utt_id"))]
    digests = lambda times=None: dict(zip(("one", "two"), key_digest(keys, times), strict=True))
    watches: dict[str, Observation] = {}

    def watched(name: str, rules: list[Rule], **more: Column):
        def through(rows: DataFrame) -> DataFrame:
            rows, watches[name] = observed(rows, rules, **more)
            return rows

        return through

    try:
        sinks.write_parquet(transcriptions, f"{staged}/transcriptions", *keys, "utt_id", manifest=False, through=watched("texts", no_text, **digests()))
        sinks.write_parquet(cells, f"{staged}/cell_scores", "lang", "engine", manifest=False, through=watched("cells", each_rule, **digests(F.col("n_utterances"))))
        got, has = settle(watches["texts"], no_text), settle(watches["cells"], each_rule)
        for what, n, wanted in (("rows", got["rows"], rows), ("cells", has["rows"], n_cells)):
            if wanted is not None and n != wanted:
                raise CheckFailed(f"{n} {what}, expected {wanted}")
        if (got["one"], got["two"]) != (has["one"], has["two"]):
            read = spark.read.parquet(f"{staged}/transcriptions")
            sizes = read.groupBy(*keys).agg(F.count("*").alias("n_utterances"))
            require_same_keys(sizes.select(*keys, F.col("n_utterances").cast("long")), cells.select(*keys, F.col("n_utterances").cast("long")), [*keys, "n_utterances"])
            raise CheckFailed("cells of the two tables differ")
        for name in ("transcriptions", "cell_scores"):
            files.replace(spark, f"{staged}/{name}", f"{folder}/{name}")
        files.copy(spark, card, f"{folder}/{card.rsplit('/', 1)[-1]}")
    finally:
        files.delete(spark, staged)
    return {"rows": got["rows"], "cells": has["rows"]}
