"""Rates, counts and percentiles of cells; ranks and tiers of engines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The keys of a cell.
CELL = ("engine", "track", "lang")


def corpus_rate(errors: Column, ref_len: Column) -> Column:
    """Sum of errors over sum of lengths; without length 1 if there are errors, else 0; 0 for no rows. Integers are summed first."""
    e, n = F.coalesce(F.sum(errors), F.lit(0)), F.coalesce(F.sum(ref_len), F.lit(0))
    return F.when(n != 0, e / F.when(n != 0, n)).otherwise(F.when(e > 0, 1.0).otherwise(0.0))


def utterance_rate(errors: Column, ref_len: Column) -> Column:
    return F.when(ref_len != 0, errors / F.when(ref_len != 0, ref_len)).otherwise(F.when(errors > 0, 1.0).otherwise(0.0))


def utterance_mean(errors: Column, ref_len: Column) -> Column:
    return F.coalesce(F.avg(utterance_rate(errors, ref_len)), F.lit(0.0))


def is_empty(text: Column) -> Column:
    """No character but white space, in the Unicode sense; true for null."""
    return ~F.coalesce(text, F.lit("")).rlike(r"(?U)[^\s\x1c-\x1f]")


def real_time_factor(latency: Column, duration: Column) -> Column:
    """Latency over duration; null without a duration; a missing latency counts as none."""
    usable = duration.isNotNull() & (duration != 0)
    return F.when(usable, F.coalesce(latency, F.lit(0.0)) / F.when(usable, duration))


def percentiles(value: Column, *at: float) -> Column:
    """Exact percentiles with linear interpolation; null where there are no values."""
    return F.percentile(value, F.array(*map(F.lit, at)))


def sorted_set(value: Column) -> Column:
    """Distinct non-empty values in order."""
    return F.array_sort(F.collect_set(F.when(value != "", value)))


def model_ids(params: Column) -> Column:
    """All of the keys under which engines name their model, as an array without nulls and empty strings."""
    keys = ("model", "model_id", "modelId", "grammarFileNames")
    return F.filter(F.array(*(F.get_json_object(params, f"$.{k}") for k in keys)), lambda x: x.isNotNull() & (x != ""))


def model_id(params: Column) -> Column:
    """The first of three keys that is set, or the empty string."""
    keys = ("model_id", "model", "grammarFileNames")
    return F.coalesce(*(F.nullif(F.get_json_object(params, f"$.{k}"), F.lit("")) for k in keys), F.lit(""))


def run_date(timestamp: Column) -> Column:
    return F.substring(timestamp, 1, 10)


def headline(lang: Column, cer: Column, wer: Column) -> Column:
    """Characters for Japanese, Chinese and Thai, words for the others."""
    return F.when(lang.isin("ja", "zh", "th"), cer).otherwise(wer)


def ranked(cells: DataFrame, rate: str, by: tuple[str, ...] = ("track", "lang")) -> DataFrame:
    """`cells` with rank_no, by rate and then engine."""
    return cells.withColumn("rank_no", F.row_number().over(Window.partitionBy(*by).orderBy(rate, "engine")))


def tiers(groups: DataFrame, by: tuple[str, ...] = ("track", "lang")) -> DataFrame:
    """One row an engine from arrays of arrays in tie_groups: tie_group (1-based), members, first_in_tier, rowspan."""
    rows = groups.select(*by, F.posexplode("tie_groups").alias("pos", "members"))
    rows = rows.select(*by, (F.col("pos") + 1).alias("tie_group"), "members", F.posexplode("members").alias("place", "engine"))
    return rows.select(*by, "engine", "tie_group", F.array_join("members", ";").alias("tie_group_members"), (F.col("place") == 0).alias("first_in_tier"), F.size("members").alias("rowspan"))


def tier_matrix(tiered: DataFrame, langs: list[str]) -> DataFrame:
    """Engines by languages: the tier or "n/a"; engines with most first places first, then by name."""
    wide = tiered.groupBy("engine").pivot("lang", langs).agg(F.first("tie_group"))
    firsts = tiered.groupBy("engine").agg(F.count_if(F.col("tie_group") == 1).alias("t1_count"))
    cells = [F.coalesce(F.col(x).cast("string"), F.lit("n/a")).alias(x) for x in langs]
    return wide.join(firsts, "engine").select("engine", "t1_count", *cells).orderBy(F.desc("t1_count"), "engine")


def first_utterances(rows: DataFrame, n: int = 200, by: tuple[str, ...] = CELL, order: str = "utt_id") -> DataFrame:
    """The first n utterances of each cell in order."""
    numbered = rows.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(order)))
    return numbered.where(F.col("__n") <= n).drop("__n")


def term_recall(terms: DataFrame, hyps: DataFrame, on: list[str], by: list[str] | None = None) -> DataFrame:
    """Share of normalized terms that stand in the normalized hypothesis of their utterance, over all or by some columns."""
    met = terms.join(hyps, on, "left")
    return met.groupBy(*(by or [])).agg(F.avg(F.when(F.coalesce(F.col("hyp"), F.lit("")).contains(F.col("term")), 1.0).otherwise(0.0)).alias("term_recall"))


def without_fillers(tokens: Column, fillers: Column) -> Column:
    """Tokens that are in no filler list; applied to both sides before alignment."""
    return F.filter(tokens, lambda t: ~F.array_contains(fillers, t))


def judge_median(votes: Column) -> Column:
    """The median of the votes of a row's judges."""
    ordered = F.array_sort(votes)
    return F.when(F.size(ordered) % 2 == 1, F.element_at(ordered, (F.size(ordered) / 2).cast("int") + 1)).otherwise((F.element_at(ordered, (F.size(ordered) / 2).cast("int")) + F.element_at(ordered, (F.size(ordered) / 2).cast("int") + 1)) / 2)
