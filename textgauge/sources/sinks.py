"""Writing score documents, Parquet tables, summaries and the tables behind a leaderboard page."""

from __future__ import annotations

import json
from collections.abc import Callable
from html import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textgauge.functions.native import html_escape, percent_interval
from textgauge.sources import files
from textgauge.sources.raw import read_strings, require_strings, template

#: A score document has one small entry a cell; more cells than this are no leaderboard.
MAX_CELLS = 100_000
PAGE_BYTES = 1 << 20


def write_parquet(df: DataFrame, path: str, *order: str, manifest: bool = True, through: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> None:
    """zstd files with pages of 1 MiB, in a fixed order of rows: by the order of file names, then within each file.

    Rows are dealt over the files by ranges of the order, as many as the session has partitions for them. `_ranges.json`
    tells for each file its rows and the first and last of the order in it. Rows that the order leaves equal are ordered by the other columns.
    `through` is put over the rows as they are written, after the ranges are settled, which takes a pass of its own.
    """
    rest = [c for c in df.columns if c not in order and df.schema[c].dataType.typeName() not in ("map", "variant")]
    keys = [*order, *rest]
    laid = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    writer = through(laid).write.mode("overwrite").option("compression", "zstd").option("parquet.page.size", PAGE_BYTES).option("parquet.page.row.count.limit", 1 << 30)
    writer.parquet(path)
    if manifest:
        spark = df.sparkSession
        name = F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file")
        ends = [f(F.struct(*order)).alias(to) for f, to in ((F.min, "first"), (F.max, "last"))]
        ranges = spark.read.parquet(path).select(name, *order).groupBy("file").agg(F.count("*").alias("rows"), *ends).orderBy("file")
        rows = [json.loads(r) for r in ranges.toJSON().collect()]  # one a file
        files.write_text(spark, json.dumps(rows, ensure_ascii=False, indent=1) + "\n", f"{path}/_ranges.json")


def score_document(cells: DataFrame) -> dict:
    """The nested document of cells (see plans.score.cell_table): rates to 6 places, real-time factors to 4, as Python rounds."""
    rows = cells.limit(MAX_CELLS + 1).collect()
    if len(rows) > MAX_CELLS:
        raise ValueError(f"more than {MAX_CELLS} cells")
    places = lambda x, n: None if x is None else round(x, n)

    def block(r, kind: str) -> dict | None:
        if r[f"{kind}_corpus"] is None:
            return None
        return {"corpus_rate": places(r[f"{kind}_corpus"], 6), "ci95": [places(r[f"{kind}_ci95_lo"], 6), places(r[f"{kind}_ci95_hi"], 6)], "utterance_mean": places(r[f"{kind}_utterance_mean"], 6)}

    tracks: dict = {}
    for r in rows:
        node = tracks.setdefault(r.track, {}).setdefault(r.lang, {"engines": {}})
        node["headline_metric"], node["tie_groups"] = r.headline_metric, r.tie_groups
        node["engines"][r.engine] = {
            "n_utterances": r.n_utterances, "empty_transcripts": r.empty_transcripts, "cer": block(r, "cer"), "wer": block(r, "wer"),
            "rtf_p50": places(r.rtf_p50, 4), "rtf_p90": places(r.rtf_p90, 4), "model_ids": r.model_ids, "run_dates": r.run_dates,
            "price_per_audio_hour_usd": r.price_per_audio_hour_usd,
        }
    return {"tracks": tracks}


def write_document(document: dict, path: str) -> None:
    """UTF-8, two spaces, sorted keys, a line break at the end: the same bytes at every run. Any file system of the active session, whole or not at all."""
    files.write_text(SparkSession.active(), json.dumps(document, ensure_ascii=False, indent=2, sort_keys=True) + "\n", path)


def copy_file(source: str, target: str) -> int:
    """A byte-for-byte copy; its size."""
    return files.copy(SparkSession.active(), source, target)


def summary(document: dict) -> list[str]:
    """A line for each track and language: T1[engine=0.0123,...] T2[...]."""
    lines = []
    for track, langs in sorted(document["tracks"].items()):
        for lang, node in sorted(langs.items()):
            kind = node["headline_metric"]
            rate = lambda e: f"{e}={node['engines'][e][kind]['corpus_rate']:.4f}"  # noqa: B023, E731
            tiers = " ".join(f"T{i}[{','.join(map(rate, tier))}]" for i, tier in enumerate(node["tie_groups"], 1))
            lines.append(f"{track}/{lang} ({kind.upper()}): {tiers}")
    return lines


def summary_column(tier_arrays: str = "tie_groups") -> F.Column:
    """The tiers of a row as text, without rates: T1[a,b] T2[c]."""
    return F.array_join(F.transform(tier_arrays, lambda g, i: F.concat(F.lit("T"), (i + 1).cast("string"), F.lit("["), F.array_join(g, ","), F.lit("]"))), " ")


#: The order of languages on a page. Fixed values.
LANGUAGE_ORDER = ("ja", "en", "zh", "ko", "vi", "id", "th", "de", "fr", "es", "pt", "ru")


def language_place(lang: F.Column) -> F.Column:
    """1, 2, ... by the order of the page; null for a language that is not shown."""
    return F.nullif(F.array_position(F.array(*map(F.lit, LANGUAGE_ORDER)), lang), F.lit(0))


def page_rows(cells: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """The tables of a page as rows in order: lang, place, tier (at most 4 shades), first_in_tier, rowspan, engine, label, headline, other, empty, rtf, price.

    `cells` is that of plans.score.cell_table; engines without a name keep their key.
    """
    label = F.col("engine")
    if names:
        label = F.coalesce(F.create_map(*(F.lit(x) for pair in names.items() for x in pair))[F.col("engine")], label)
    by_cer = F.col("headline_metric") == "cer"
    shown = {k: percent_interval(*(F.col(f"{k}_{x}") for x in ("corpus", "ci95_lo", "ci95_hi"))) for k in ("cer", "wer")}
    rows = cells.withColumn("place", language_place(F.col("lang"))).where("place is not null")
    rows = rows.select(
        "lang", "place", F.col("tie_group").alias("tier"), F.least("tie_group", F.lit(4)).alias("shade"), "first_in_tier", "rowspan", "engine", html_escape(label).alias("label"),
        F.when(by_cer, shown["cer"]).otherwise(shown["wer"]).alias("headline"), F.when(by_cer, shown["wer"]).otherwise(shown["cer"]).alias("other"), F.col("empty_transcripts").alias("empty"),
        F.when(F.col("rtf_p50").isNotNull(), F.format_string("%.2f / %.2f", "rtf_p50", "rtf_p90")).otherwise("—").alias("rtf"),
        F.when(F.col("price_per_audio_hour_usd").isNull(), "—").otherwise(F.format_string("$%.3f", "price_per_audio_hour_usd")).alias("price"),
    )
    return rows.orderBy("place", "tier", F.desc("first_in_tier"), "engine")


class Page:
    """A leaderboard page of a score document in one locale: a matrix of engines by languages, then a table a language.

    Strings come from the locale or else from the fallback, both as read by raw.read_strings; a key that
    neither has shows as itself. `own` names engines that carry a tag.
    """

    COLUMNS = ("tier", "engine", "headline", "other", "empty", "rtf", "price", "dates")

    def __init__(self, document: dict, title: str, track: str = "a", names: dict[str, str] | None = None, strings: dict[str, str] | None = None, fallback: dict[str, str] | None = None, own: tuple[str, ...] = ()):
        self.cells, self.title, self.names, self.own = document["tracks"].get(track, {}), title, names or {}, own
        self.strings, self.fallback = strings or {}, fallback or {}
        self.langs = [lang for lang in LANGUAGE_ORDER if lang in self.cells]
        self.tier = {(engine, lang): i for lang in self.langs for i, group in enumerate(self.cells[lang]["tie_groups"], 1) for engine in group}

    def say(self, key: str, **values: str) -> str:
        return escape(template(self.strings, self.fallback, key, **values) or key)

    def label(self, engine: str) -> str:
        return escape(self.names.get(engine, engine)) + (f" <em>{self.say('own_engine')}</em>" if engine in self.own else "")

    def firsts(self, engine: str) -> int:
        return sum(self.tier.get((engine, lang)) == 1 for lang in self.langs)

    def matrix(self) -> str:
        engines = sorted({engine for engine, _ in self.tier}, key=lambda e: (-self.firsts(e), e))
        mark = lambda n: "<td>n/a" if n is None else f'<td class="tier{min(n, 4)}">T{n}'
        rows = ["<tr><th>" + "<th>".join([self.say("engine"), *map(escape, self.langs), "#T1"])]
        rows += [f"<tr><th>{self.label(e)}{''.join(mark(self.tier.get((e, lang))) for lang in self.langs)}<td>{self.firsts(e)}" for e in engines]
        return f"<table>{''.join(rows)}</table>"

    def rate(self, block: dict | None) -> str:
        return "—" if block is None else f"{block['corpus_rate'] * 100:.2f} ({block['ci95'][0] * 100:.2f}–{block['ci95'][1] * 100:.2f})"

    def table(self, lang: str) -> str:
        node = self.cells[lang]
        main = node["headline_metric"]
        other = "wer" if main == "cer" else "cer"
        rows = ["<tr><th>" + "<th>".join(map(self.say, self.COLUMNS))]
        for tier, group in enumerate(node["tie_groups"], 1):
            for place, engine in enumerate(group):
                m = node["engines"][engine]
                price, speed = m.get("price_per_audio_hour_usd"), (m.get("rtf_p50"), m.get("rtf_p90"))
                texts = [self.rate(m[main]), self.rate(m[other]), m["empty_transcripts"], "—" if None in speed else "{:.2f} / {:.2f}".format(*speed), "—" if price is None else f"${price:.3f}", escape(", ".join(m["run_dates"]))]
                lead = "" if place else f'<td rowspan="{len(group)}" class="tier{min(tier, 4)}">T{tier}'
                rows.append(f"<tr>{lead}<td>{self.label(engine)}<br>{escape(', '.join(m['model_ids']) or '—')}" + "".join(f"<td>{x}" for x in texts))
        n = next(iter(node["engines"].values()))["n_utterances"]
        return f'<section id="{escape(lang)}"><h2>{escape(lang)} ({main.upper()})</h2><p>{n} {self.say("utterances")}</p><table>{"".join(rows)}</table></section>'

    def html(self) -> str:
        head = f"<!doctype html><meta charset=utf-8><title>{escape(self.title)}</title><h1>{escape(self.title)}</h1>"
        return "\n".join([head, self.matrix(), *map(self.table, self.langs)]) + "\n"


def leaderboard_html(document: dict, title: str, track: str = "a", names: dict[str, str] | None = None, **how) -> str:
    return Page(document, title, track, names, **how).html()


def write_pages(document: dict, title: str, strings_dir: str, locales: list[str], folder: str, **how) -> list[str]:
    """A page for each locale in {folder}/{locale}.html, English strings as the fallback; the paths."""
    fallback = read_strings(strings_dir, "en")
    require_strings(fallback)
    out = []
    for locale in locales:
        out.append(f"{folder}/{locale}.html")
        files.write_text(SparkSession.active(), leaderboard_html(document, title, strings=read_strings(strings_dir, locale), fallback=fallback, **how), out[-1])
    return out
