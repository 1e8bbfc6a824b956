"""Registered queries of the core engine and their SQL twins.

The driver's tables stand in for transcriptions: adjacent turns of `conversations` for references
and hypotheses, `documents` for cells (source as the engine), `events` for latencies and parameters,
`embeddings` for waveforms.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textgauge.functions import native
from textgauge.functions.normalize import BY_CHARACTER, normalized, tokenized
from textgauge.operators import aggregates as A
from textgauge.operators import audio, checks, stats
from textgauge.operators.align import by_cost, char_errors, edit_split, word_errors
from textgauge.plans import score
from textgauge.plans.session import materialized, spread
from textgauge.plans.spell import SPELLERS, spelled
from textgauge.plans.twins import draws_sql, english_sql, normal_sql
from textgauge.sources.raw import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql is not None:
            ORACLES[name or f.__name__] = sql
        return f

    return add


def _text(x) -> str:
    return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)


def _values(rows) -> str:
    return "VALUES " + ", ".join("(" + ", ".join(map(_text, r)) + ")" for r in rows)


# --- scans and counts


@query("SELECT lang, count(*) AS n_rows, sum(n_chars)::BIGINT AS n_chars, count(DISTINCT source) AS n_sources FROM documents GROUP BY lang")
def scan_counts(spark, sf):
    return table(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("n_rows"), F.sum("n_chars").alias("n_chars"), F.count_distinct("source").alias("n_sources"))


@query("SELECT source AS engine, lang, count(*) AS n_utterances FROM documents GROUP BY ALL")
def cell_counts(spark, sf):
    return table(spark, sf, "documents").groupBy(F.col("source").alias("engine"), "lang").agg(F.count("*").alias("n_utterances"))


@query("SELECT DISTINCT source AS engine FROM documents")
def engine_list(spark, sf):
    return table(spark, sf, "documents").select(F.col("source").alias("engine")).distinct()


@query(r"SELECT role, count(*) AS n_utterances, count(*) FILTER (NOT regexp_matches(coalesce(text, ''), '[^\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{85}\x{0B}\x{1C}-\x{1F}]')) AS empty_transcripts FROM conversations GROUP BY role")
def empty_count(spark, sf):
    return table(spark, sf, "conversations").groupBy("role").agg(F.count("*").alias("n_utterances"), F.count_if(A.is_empty(F.col("text"))).alias("empty_transcripts"))


# --- projections


@query("SELECT event_type AS engine, round(quantile_cont(value / (user_id % 10), 0.5), 6) AS rtf_p50, round(quantile_cont(value / (user_id % 10), 0.9), 6) AS rtf_p90, count(*) AS n FROM events WHERE value IS NOT NULL AND user_id % 10 <> 0 GROUP BY 1")
def rtf_percentiles(spark, sf):
    rows = table(spark, sf, "events").where(F.col("value").isNotNull())
    rows = rows.select(F.col("event_type").alias("engine"), A.real_time_factor(F.col("value"), (F.col("user_id") % 10).cast("double")).alias("rtf")).where("rtf is not null")
    out = rows.groupBy("engine").agg(A.percentiles(F.col("rtf"), 0.5, 0.9).alias("p"), F.count("*").alias("n"))
    return out.select("engine", F.round(F.col("p")[0], 6).alias("rtf_p50"), F.round(F.col("p")[1], 6).alias("rtf_p90"), "n")


@query("SELECT event_type AS engine, array_to_string(list_sort(list(DISTINCT strftime(ts, '%Y-%m-%d'))), ';') AS run_dates FROM events GROUP BY 1")
def run_dates(spark, sf):
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return table(spark, sf, "events").groupBy(F.col("event_type").alias("engine")).agg(F.array_join(A.sorted_set(A.run_date(stamp)), ";").alias("run_dates"))


_PARAMS_SQL = "SELECT event_type, json_object('model', CASE WHEN event_id % 3 = 0 THEN event_type END, 'model_id', CASE WHEN event_id % 3 = 1 THEN 'm' || (event_id % 7) ELSE '' END, 'grammarFileNames', CASE WHEN event_id % 3 = 2 THEN '-a-general' END) AS params FROM events"


def _params(spark, sf):
    pick = lambda n, x: F.when(F.col("event_id") % 3 == n, x)
    params = F.struct(pick(0, F.col("event_type")).alias("model"), F.coalesce(pick(1, F.concat(F.lit("m"), (F.col("event_id") % 7).cast("string"))), F.lit("")).alias("model_id"), pick(2, F.lit("-a-general")).alias("grammarFileNames"))
    return table(spark, sf, "events").select("event_type", F.to_json(params).alias("params"))


@query(f"SELECT event_type AS engine, array_to_string(list_sort(list(DISTINCT m)), ';') AS model_ids FROM (SELECT event_type, unnest([json_extract_string(params, '$.model'), json_extract_string(params, '$.model_id'), json_extract_string(params, '$.grammarFileNames')]) AS m FROM ({_PARAMS_SQL})) WHERE m <> '' GROUP BY 1")
def model_ids(spark, sf):
    ids = F.array_sort(F.array_distinct(F.flatten(F.collect_set(A.model_ids(F.col("params"))))))
    return _params(spark, sf).groupBy(F.col("event_type").alias("engine")).agg(F.array_join(ids, ";").alias("model_ids"))


@query(f"SELECT model_id, count(*) AS n FROM (SELECT coalesce(nullif(json_extract_string(params, '$.model_id'), ''), nullif(json_extract_string(params, '$.model'), ''), nullif(json_extract_string(params, '$.grammarFileNames'), ''), '') AS model_id FROM ({_PARAMS_SQL})) GROUP BY 1")
def model_id_coalesce(spark, sf):
    return _params(spark, sf).groupBy(A.model_id(F.col("params")).alias("model_id")).agg(F.count("*").alias("n"))


@query("SELECT lang, CASE WHEN lang IN ('ja', 'zh', 'th') THEN 'cer' ELSE 'wer' END AS headline_metric, count(*) AS n FROM documents GROUP BY ALL")
def headline_metric(spark, sf):
    return table(spark, sf, "documents").groupBy("lang", A.headline(F.col("lang"), F.lit("cer"), F.lit("wer")).alias("headline_metric")).agg(F.count("*").alias("n"))


_NAMES = [("src0", "openai"), ("src1", "whisper1"), ("src2", "deepgram"), ("src3", "amivoice")]


@query(f"SELECT d.source, e.engine, p.price::DOUBLE AS price_per_audio_hour_usd, count(*) AS n FROM documents d JOIN ({_values(_NAMES)}) e(source, engine) ON e.source = d.source LEFT JOIN ({_values([(k, float(v)) for k, v in score.PRICES.items()])}) p(engine, price) ON p.engine = e.engine GROUP BY ALL")
def price_lookup(spark, sf):
    names = spark.createDataFrame(_NAMES, "source string, engine string")
    rows = table(spark, sf, "documents").join(F.broadcast(names), "source").join(F.broadcast(score.prices(spark)), "engine", "left")
    return rows.groupBy("source", "engine", "price_per_audio_hour_usd").agg(F.count("*").alias("n"))


# --- text rules over whole texts


@query(r"SELECT doc_id, md5(regexp_replace(text, '[\pP\pS]', ' ', 'g')) AS digest, length(text) AS n_chars FROM documents")
def strip_marks(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(native.blank_marks(F.col("text")).cast("binary")).alias("digest"), F.length("text").cast("bigint").alias("n_chars"))


@query(r"SELECT doc_id, md5(trim(regexp_replace(text, '[\s\x{A0}\x{0B}\x{85}\x{2028}\x{2029}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}\x{1680}]+', ' ', 'g'))) AS digest FROM documents")
def collapse_spaces(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(native.one_space(F.col("text")).cast("binary")).alias("digest"))


@query("SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS n_words, len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS n_distinct FROM documents")
def tokenize_words(spark, sf):
    words = native.simple_words(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.size(words).cast("bigint").alias("n_words"), F.size(F.array_distinct(words)).cast("bigint").alias("n_distinct"))


@query("SELECT doc_id, length(text) AS n_tokens FROM documents")
def char_tokens(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.size(native.characters(F.col("text"))).cast("bigint").alias("n_tokens"))


_RULES = {
    "comma_groups": native.join_comma_groups, "point_groups": native.join_point_groups, "decimal_comma": native.comma_to_point, "ordinals_en": partial(native.bare_ordinals, endings="st|nd|rd|th"),
    "ordinals_es": partial(native.bare_ordinals, endings="[oa]s?"), "thai_digits": native.thai_digits, "yo": native.fold_yo, "one_space": native.one_space, "blank_marks": native.blank_marks,
}


def _rule_texts(spark, sf) -> DataFrame:
    """o_orderkey and a text with every kind of number, mark and space that the single rules are about."""
    k = F.col("o_orderkey")
    three = lambda x: F.lpad((x % 1000).cast("string"), 3, "0")
    text = F.concat(k, F.lit(", a,b 1,"), three(k), F.lit(","), three(k * 7), F.lit(" 2."), three(k * 3), F.lit("."), three(k * 11), F.lit(" 3,"), k % 10, F.lit(" 3.14 12."), k, F.lit(" "), k, F.lit("st "), k, F.lit("ths x"), k, F.lit("nd "),
        k % 100, F.lit("a "), k % 100, F.lit("os "), F.translate(k.cast("string"), "0123456789", "๐๑๒๓๔๕๖๗๘๙"), F.lit(" Ё ёлка \u00a0— \t x-y!  "), F.col("o_orderpriority"))
    return table(spark, sf, "orders").select("o_orderkey", text.alias("t"))


_RULE_TEXTS_SQL = """SELECT o_orderkey, o_orderkey || ', a,b 1,' || lpad((o_orderkey % 1000)::VARCHAR, 3, '0') || ',' || lpad((o_orderkey * 7 % 1000)::VARCHAR, 3, '0') || ' 2.' || lpad((o_orderkey * 3 % 1000)::VARCHAR, 3, '0') || '.'
  || lpad((o_orderkey * 11 % 1000)::VARCHAR, 3, '0') || ' 3,' || (o_orderkey % 10) || ' 3.14 12.' || o_orderkey || ' ' || o_orderkey || 'st ' || o_orderkey || 'ths x' || o_orderkey || 'nd ' || (o_orderkey % 100) || 'a ' || (o_orderkey % 100) || 'os '
  || translate(o_orderkey::VARCHAR, '0123456789', '๐๑๒๓๔๕๖๗๘๙') || ' Ё ёлка ' || chr(160) || '— ' || chr(9) || ' x-y!  ' || o_orderpriority AS t FROM orders"""
# the twin's expressions know no lookaround: what two matches share is seen by a second pass
_RULE_SQL = {
    "comma_groups": r"regexp_replace(regexp_replace(t, '(\d),(\d)', '\1\2', 'g'), '(\d),(\d)', '\1\2', 'g')",
    "point_groups": r"regexp_replace(regexp_replace(t, '(\d)\.(\d{3})([^\d]|$)', '\1\2\3', 'g'), '(\d)\.(\d{3})([^\d]|$)', '\1\2\3', 'g')",
    "decimal_comma": r"regexp_replace(regexp_replace(t, '(\d),(\d)', '\1.\2', 'g'), '(\d),(\d)', '\1.\2', 'g')",
    "ordinals_en": r"regexp_replace(t, '\b(\d+)(st|nd|rd|th)\b', '\1', 'g')", "ordinals_es": r"regexp_replace(t, '\b(\d+)(os|o|as|a)\b', '\1', 'g')",
    "thai_digits": "translate(t, '๐๑๒๓๔๕๖๗๘๙', '0123456789')", "yo": "replace(t, 'ё', 'е')", "one_space": rf"trim(regexp_replace(t, '[\s' || chr(160) || ']+', ' ', 'g'))", "blank_marks": r"regexp_replace(t, '[\pP\pS]', ' ', 'g')",
}


@query(" UNION ALL ".join(f"SELECT o_orderkey, '{name}' AS rule, {sql} AS output FROM ({_RULE_TEXTS_SQL})" for name, sql in _RULE_SQL.items()))
def text_rules(spark, sf):
    """Each single rule over a text for every order."""
    made = F.explode(F.array(*(F.struct(F.lit(name).alias("rule"), rule(F.col("t")).alias("output")) for name, rule in _RULES.items())))
    return _rule_texts(spark, sf).select("o_orderkey", made.alias("r")).select("o_orderkey", "r.rule", "r.output")


#: A sentence of each language around a number, and what is left of it in the normal form where the two differ.
_AROUND = {
    "en": ("Page {}, here!", "page {} here"), "de": ("Seite {} hier.", "seite {} hier"), "es": ("¿Página {} aquí?", "página {} aquí"), "fr": ("La page {} ici.", "la page {} ici"), "pt": ("Página {} aqui…", "página {} aqui"),
    "ru": ("Ещё: страница {} здесь", "еще страница {} здесь"), "vi": ("Trang {} đây.", "trang {} đây"), "id": ("Halaman {} sini.", "halaman {} sini"), "ko": ("쪽 {} 여기.", "쪽 {} 여기"),
    "ja": ("頁 {} です。", "頁 {} です"), "zh": ("頁 {} 在。", "页 {} 在"), "th": ("หน้า {} นี้", "หน้า {} นี้"),
}
#: Numbers whose words are left alone, as they are words of other meanings as well.
_LEFT_ALONE = {
    "en": {1}, "fr": {1}, "pt": {1}, "vi": set(range(10)), "id": set(range(10)), "ko": {*range(11), 100, 1000, 1004, 10_000, 10_001, 10_002, 10_004, 50_000}, "ja": {10, 100, 110, 1000, 1010, 1100, 1110}, "zh": {10}, "th": {0},
}


def _order_number():
    """Every ninth order up to 120, as smaller numbers are the irregular ones, the others up to 99,999; null where the price is."""
    return F.when(F.col("o_orderkey") % 9 == 0, F.col("o_orderkey") % 121).otherwise(F.floor("o_totalprice") % 100_000).cast("int")


#: Orders of a task of the number grammars: some seconds to a minute, by how many of their texts a worker has met before.
ORDERS_EACH = 500_000


def _normalize(lang, spark, sf):
    before, after = _AROUND[lang][0].split("{}")
    text = F.concat(F.lit(before), spelled(lang, _order_number()), F.lit(after))
    rows = spread(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), ORDERS_EACH).select("o_orderkey", text.alias("t"))
    return rows.select("o_orderkey", normalized(F.lit(lang), F.col("t"), F.col("o_orderkey") % 2 == 1).alias("output"))


def _normalize_sql(lang: str) -> str:
    """The number in digits within the normal sentence; its words where they are left alone; no spaces where they are stripped."""
    before, after = _AROUND[lang][1].split("{}")
    kept = "".join(f" WHEN {n} THEN {_text(normal_words)}" for n in sorted(_LEFT_ALONE.get(lang, ())) for normal_words in [SPELLERS[lang](n)])
    number = f"CASE n{kept} ELSE n::VARCHAR END" if kept else "n::VARCHAR"
    out = f"{_text(before)} || {number} || {_text(after)}"
    if lang in BY_CHARACTER:
        out = f"CASE WHEN o_orderkey % 2 = 1 THEN replace({out}, ' ', '') ELSE {out} END"
    return f"SELECT o_orderkey, {out} AS output FROM (SELECT o_orderkey, (CASE WHEN o_orderkey % 9 = 0 THEN o_orderkey % 121 ELSE floor(o_totalprice)::BIGINT % 100000 END)::INTEGER AS n FROM orders)"


for _lang in _AROUND:
    query(_normalize_sql(_lang), f"normalize_{_lang}")(partial(_normalize, _lang))


_NORMAL_SQL = f"SELECT doc_id, lang, CASE WHEN text IS NOT NULL THEN {normal_sql('lang', 'text')} END AS normal FROM documents"


@query(f"SELECT doc_id, lang, md5(normal) AS digest, length(normal)::INTEGER AS n_chars FROM ({_NORMAL_SQL})")
def normalize_documents(spark, sf):
    made = normalized(F.col("lang"), F.col("text"))
    return spread(table(spark, sf, "documents")).select("doc_id", "lang", made.alias("normal")).select("doc_id", "lang", F.md5(F.col("normal").cast("binary")).alias("digest"), F.length("normal").alias("n_chars"))


@query(f"SELECT doc_id, CASE WHEN normal = '' THEN 0 ELSE len(string_split(normal, ' ')) END::INTEGER AS n_words FROM ({_NORMAL_SQL})")
def tokenize_documents(spark, sf):
    return spread(table(spark, sf, "documents")).select("doc_id", tokenized(F.col("lang"), F.col("text")).alias("w")).select("doc_id", F.size("w").alias("n_words"))


# --- alignment

_PAIRS_SQL = "SELECT a.conv_id, a.turn, a.text AS ref_raw, b.text AS hyp_raw FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant'"
_CLEAN = r"trim(regexp_replace(regexp_replace(lower({}), '[^\pL\pN ]', '', 'g'), ' +', ' ', 'g'))"
_CLEAN_SQL = f"SELECT conv_id, turn, {_CLEAN.format('ref_raw')} AS ref, {_CLEAN.format("coalesce(hyp_raw, '')")} AS hyp FROM ({_PAIRS_SQL}) WHERE ref_raw IS NOT NULL"
# the twin's levenshtein counts bytes, so letters beyond ASCII are given single bytes first
_ACCENTS, _BYTES = "àáâãäåæçèéêëìíîïñòóôõöøùúûüýÿœß", "ABCDEFGHIJKLMNOPQRSTUVWXYZ!#$%&"


def _char_distance_sql(ref: str, hyp: str) -> str:
    narrow = lambda x: f"translate({x}, '{_ACCENTS}', '{_BYTES}')"
    return f"levenshtein({narrow(ref)}, {narrow(hyp)})::INTEGER"


def word_split_sql(rows: str) -> str:
    """`rows` (with word lists r and h) and n_sub, n_del, n_ins of the alignment found backwards from the end: the table row by row.

    A cell packs its three counts into one number; it comes from the diagonal where the words are
    equal or the cost allows a substitution, else from above (a deletion), else from the left.
    """
    cost = lambda x: f"(({x} & 1048575) + (({x} >> 20) & 1048575) + ({x} >> 40))"
    left = "a[len(a)]"
    least = f"least({cost('e[2]')}, {cost('e[3]')}, {cost(left)})"
    cell = f"CASE WHEN e[1] = t[1] THEN e[2] WHEN {cost('e[2]')} = {least} THEN e[2] + 1 WHEN {cost('e[3]')} = {least} THEN e[3] + (1::BIGINT << 20) ELSE {left} + (1::BIGINT << 40) END"
    row = f"list_reduce(list_transform(hs, lambda x, j: [x, prev[j], prev[j + 1]]), lambda a, e: list_append(a, {cell}), [prev[1] + (1::BIGINT << 20)])"
    last = f"list_reduce(rs, lambda prev, t: {row}, list_transform(range(len(hs) + 1), lambda j: j::BIGINT << 40))"
    ids = f"SELECT *, list_distinct(list_concat(r, h)) AS known FROM ({rows})"
    ids = f"SELECT * EXCLUDE known, list_transform(r, lambda x: [list_position(known, x)::BIGINT]) AS rs, list_transform(h, lambda x: list_position(known, x)::BIGINT) AS hs FROM ({ids})"
    done = f"SELECT * EXCLUDE (rs, hs), ({last})[len(hs) + 1] AS v FROM ({ids})"
    return f"SELECT * EXCLUDE v, (v & 1048575)::INTEGER AS n_sub, ((v >> 20) & 1048575)::INTEGER AS n_del, (v >> 40)::INTEGER AS n_ins FROM ({done})"


_WORDS = "CASE WHEN {0} = '' THEN []::VARCHAR[] ELSE string_split({0}, ' ') END"
_WORD_SPLIT_SQL = word_split_sql(f"SELECT conv_id, turn, {_WORDS.format('ref')} AS r, {_WORDS.format('hyp')} AS h FROM ({_CLEAN_SQL})")


def pairs(spark, sf) -> DataFrame:
    """Adjacent turns, user then assistant: conv_id, turn, ref_raw, hyp_raw."""
    turns = table(spark, sf, "conversations")
    ref = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("ref_raw"))
    hyp = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("hyp_raw"))
    return ref.join(hyp, ["conv_id", "turn"])


def _clean(c):
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N} ]", ""), " +", " "))


def clean_pairs(spark, sf) -> DataFrame:
    # an alignment costs the product of two lengths, so rows are dealt by that
    rows = by_cost(pairs(spark, sf).where("ref_raw is not null"), F.length("ref_raw").cast("double") * F.length("hyp_raw"))
    return rows.select("conv_id", "turn", _clean(F.col("ref_raw")).alias("ref"), _clean(F.coalesce("hyp_raw", F.lit(""))).alias("hyp"))


@query(f"SELECT conv_id, turn, {_char_distance_sql('ref', 'hyp')} AS errors, length(ref)::INTEGER AS ref_len FROM ({_CLEAN_SQL})")
def cer_total(spark, sf):
    return clean_pairs(spark, sf).select("conv_id", "turn", char_errors(F.col("ref"), F.col("hyp")).alias("errors"), F.length("ref").alias("ref_len"))


def _word_pairs(spark, sf):
    return clean_pairs(spark, sf).select("conv_id", "turn", native.words(F.col("ref")).alias("ref"), native.words(F.col("hyp")).alias("hyp"))


@query(f"SELECT conv_id, turn, n_sub + n_del + n_ins AS errors, len(r)::INTEGER AS ref_len FROM ({_WORD_SPLIT_SQL})")
def wer_total(spark, sf):
    return _word_pairs(spark, sf).select("conv_id", "turn", word_errors(F.col("ref"), F.col("hyp")).alias("errors"), F.size("ref").alias("ref_len"))


@query(f"SELECT conv_id, turn, n_sub, n_del, n_ins, len(r)::INTEGER AS ref_len FROM ({_WORD_SPLIT_SQL})")
def wer_split(spark, sf):
    rows = _word_pairs(spark, sf).select("conv_id", "turn", edit_split(F.col("ref"), F.col("hyp")).alias("o"))
    return rows.select("conv_id", "turn", F.col("o.sub").alias("n_sub"), F.col("o.del").alias("n_del"), F.col("o.ins").alias("n_ins"), "o.ref_len")


_PARTS_SQL = "SELECT a.p_partkey, string_split(lower(a.p_name || a.p_brand), '') AS r, string_split(lower(b.p_type || b.p_name), '') AS h FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1"


@query(f"SELECT p_partkey, n_sub, n_del, n_ins, len(r)::INTEGER AS ref_len FROM ({word_split_sql(_PARTS_SQL)})")
def edit_split_cases(spark, sf):
    """The split by character of short texts that have little in common: each part against the next one."""
    parts = table(spark, sf, "part")
    one = parts.select("p_partkey", F.lower(F.concat("p_name", "p_brand")).alias("ref"))
    other = parts.select((F.col("p_partkey") - 1).alias("p_partkey"), F.lower(F.concat("p_type", "p_name")).alias("hyp"))
    made = one.join(other, "p_partkey").select("p_partkey", edit_split(F.col("ref"), F.col("hyp")).alias("o"))
    return made.select("p_partkey", F.col("o.sub").alias("n_sub"), F.col("o.del").alias("n_del"), F.col("o.ins").alias("n_ins"), "o.ref_len")


_ERRORS_SQL = f"SELECT conv_id, turn, {_char_distance_sql('ref', 'hyp')} AS errors, length(ref) AS ref_len FROM ({_CLEAN_SQL})"


@query(f"SELECT turn, sum(errors)::BIGINT AS errors, sum(ref_len)::BIGINT AS ref_len, round(CASE WHEN sum(ref_len) <> 0 THEN sum(errors)::DOUBLE / sum(ref_len) WHEN sum(errors) > 0 THEN 1.0 ELSE 0.0 END, 6)::DOUBLE AS corpus_rate FROM ({_ERRORS_SQL}) GROUP BY turn")
def corpus_rates(spark, sf):
    rows = cer_total(spark, sf).groupBy("turn").agg(F.sum("errors").alias("errors"), F.sum("ref_len").alias("ref_len"), F.round(A.corpus_rate(F.col("errors"), F.col("ref_len")), 6).alias("corpus_rate"))
    return rows


@query(f"SELECT turn, round(avg(CASE WHEN ref_len <> 0 THEN errors::DOUBLE / ref_len WHEN errors > 0 THEN 1.0 ELSE 0.0 END), 6) AS utterance_mean FROM ({_ERRORS_SQL}) GROUP BY turn")
def utterance_means(spark, sf):
    return cer_total(spark, sf).groupBy("turn").agg(F.round(A.utterance_mean(F.col("errors"), F.col("ref_len")), 6).alias("utterance_mean"))


# --- cells of documents: a document's marks are its errors, its characters its length

_CELLS_SQL = r"SELECT source AS engine, 'a' AS track, lang, doc_id AS utt_id, length(text) - length(regexp_replace(text, '[|%&$#*!]', '', 'g')) AS errors, length(text) AS ref_len FROM documents"
_RATES_SQL = f"SELECT engine, track, lang, CASE WHEN sum(ref_len) <> 0 THEN sum(errors)::DOUBLE / sum(ref_len)::DOUBLE ELSE 0.0 END AS rate FROM ({_CELLS_SQL}) GROUP BY ALL"


_ENGINE_RATES_SQL = f"SELECT engine, CASE WHEN sum(ref_len) <> 0 THEN sum(errors)::DOUBLE / sum(ref_len)::DOUBLE ELSE 0.0 END AS rate FROM ({_CELLS_SQL}) GROUP BY engine"


def document_cells(spark, sf) -> DataFrame:
    n = F.length("text")
    errors = n - F.length(F.regexp_replace("text", "[|%&$#*!]", ""))
    return spread(table(spark, sf, "documents")).select(F.col("source").alias("engine"), F.lit("a").alias("track"), "lang", F.col("doc_id").alias("utt_id"), errors.alias("errors"), n.alias("ref_len"))


def _cell_rates(spark, sf):
    return document_cells(spark, sf).groupBy(*A.CELL).agg(A.corpus_rate(F.col("errors"), F.col("ref_len")).alias("rate"))


@query(f"SELECT engine, track, lang, round(rate, 9) AS rate, row_number() OVER (PARTITION BY track, lang ORDER BY rate, engine)::INTEGER AS rank_no FROM ({_RATES_SQL})")
def rank_engines(spark, sf):
    return A.ranked(_cell_rates(spark, sf), "rate").select(*A.CELL, F.round("rate", 9).alias("rate"), "rank_no")


_TIER_SQL = f"SELECT engine, lang, dense_rank() OVER (PARTITION BY lang ORDER BY round(rate, 2))::INTEGER AS tie_group FROM ({_RATES_SQL})"


def _tier_groups(spark, sf):
    """Tiers by equal rounded rates, as arrays of arrays."""
    rows = _cell_rates(spark, sf).withColumn("r", F.round("rate", 2))
    tiers = rows.groupBy("track", "lang", "r").agg(F.array_sort(F.collect_list("engine")).alias("g"))
    return tiers.groupBy("track", "lang").agg(F.array_sort(F.collect_list(F.struct("r", "g"))).alias("x")).select("track", "lang", F.col("x.g").alias("tie_groups"))


@query(f"SELECT t.engine, t.lang, t.tie_group, m.members AS tie_group_members, m.first_engine = t.engine AS first_in_tier, m.n::INTEGER AS rowspan FROM ({_TIER_SQL}) t JOIN (SELECT lang, tie_group, string_agg(engine, ';' ORDER BY engine) AS members, min(engine) AS first_engine, count(*) AS n FROM ({_TIER_SQL}) GROUP BY ALL) m USING (lang, tie_group)")
def tier_rows(spark, sf):
    return A.tiers(_tier_groups(spark, sf)).drop("track")


@query(f"SELECT engine, count(*) FILTER (tie_group = 1) AS t1_count, coalesce(max(CASE WHEN lang = 'de' THEN tie_group END)::VARCHAR, 'n/a') AS de, coalesce(max(CASE WHEN lang = 'en' THEN tie_group END)::VARCHAR, 'n/a') AS en, coalesce(max(CASE WHEN lang = 'es' THEN tie_group END)::VARCHAR, 'n/a') AS es, coalesce(max(CASE WHEN lang = 'fr' THEN tie_group END)::VARCHAR, 'n/a') AS fr, coalesce(max(CASE WHEN lang = 'th' THEN tie_group END)::VARCHAR, 'n/a') AS th FROM ({_TIER_SQL}) GROUP BY engine")
def tier_matrix(spark, sf):
    return A.tier_matrix(A.tiers(_tier_groups(spark, sf)), ["de", "en", "es", "fr", "th"])


@query(f"SELECT lang, string_agg('T' || tie_group || '[' || members || ']', ' ' ORDER BY tie_group) AS summary FROM (SELECT lang, tie_group, string_agg(engine, ',' ORDER BY engine) AS members FROM ({_TIER_SQL}) GROUP BY ALL) GROUP BY lang")
def tier_summary(spark, sf):
    from textgauge.sources.sinks import summary_column

    return _tier_groups(spark, sf).select("lang", summary_column().alias("summary"))


@query(f"SELECT lang, engine, format('{{:.2f}}', rate * 100) || ' (' || format('{{:.2f}}', rate * 50) || '–' || format('{{:.2f}}', rate * 150) || ')' AS cell FROM ({_RATES_SQL})")
def percent_cells(spark, sf):
    return _cell_rates(spark, sf).select("lang", "engine", native.percent_interval(F.col("rate"), F.col("rate") / 2, F.col("rate") * 1.5).alias("cell"))


@query("SELECT conv_id, turn, md5(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')) AS digest FROM conversations")
def html_escaped(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", F.md5(native.html_escape(F.col("text")).cast("binary")).alias("digest"))


@query(f"SELECT track, lang, engine, round(rate, 9) AS rate FROM ({_RATES_SQL})")
def nest_unnest(spark, sf):
    return score.unnest(score.nest(_cell_rates(spark, sf))).withColumn("rate", F.round("rate", 9))


@query("SELECT engine, lang, utt_id FROM (SELECT source AS engine, lang, doc_id AS utt_id, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS r FROM documents) WHERE r <= 200")
def first_200(spark, sf):
    return A.first_utterances(document_cells(spark, sf)).select("engine", "lang", "utt_id")


# --- completeness


@query("SELECT lang, doc_id AS utt_id, 1::BIGINT AS n_engines, 2::BIGINT AS n_expected FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def pairing_check(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    labelled = docs.join(table(spark, sf, "labels").select("doc_id").distinct(), "doc_id")
    rows = docs.withColumn("engine", F.lit("all")).union(labelled.withColumn("engine", F.lit("labelled"))).withColumnRenamed("doc_id", "utt_id")
    return checks.unpaired(rows, ("lang",)).select("lang", "utt_id", "n_engines", "n_expected")


@query("SELECT doc_id, 'left' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT DISTINCT doc_id, 'right' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def cell_diff(spark, sf):
    return checks.same_keys(table(spark, sf, "documents"), table(spark, sf, "labels"), ["doc_id"])


@query("SELECT lang, doc_id AS utt_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def drop_failed(spark, sf):
    docs = table(spark, sf, "documents").select("lang", F.col("doc_id").alias("utt_id"))
    failed = table(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").alias("utt_id"))
    return checks.without_failed(docs, failed, ())


@query("SELECT d.lang, count(*) AS n_utterances, count(l.doc_id) AS n_failed, count(l.doc_id)::DOUBLE / count(*) AS share, count(l.doc_id)::DOUBLE / count(*) > 0.02 AS flagged FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1) l USING (doc_id) GROUP BY d.lang")
def failed_share(spark, sf):
    docs = table(spark, sf, "documents").select("lang", F.col("doc_id").alias("utt_id"))
    failed = docs.join(table(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").alias("utt_id")), "utt_id", "left_semi")
    return checks.failed_share(docs, failed, ("lang",))


# --- statistics


@query()
def bootstrap_ci(spark, sf):
    return stats.cell_intervals(document_cells(spark, sf), list(A.CELL))


def _numbered_cells(spark, sf):
    """All sources over utterances numbered alike."""
    rows = document_cells(spark, sf).withColumn("utt", F.row_number().over(Window.partitionBy("engine").orderBy("utt_id")))
    return rows.select("engine", "track", F.lit("all").alias("lang"), F.col("utt").alias("utt_id"), "errors", "ref_len")


@query()
def paired_diff(spark, sf):
    return stats.paired_intervals(_numbered_cells(spark, sf), ["track", "lang"])


@query()
def tie_groups(spark, sf):
    # tiers are of engines that share their utterances: what one source lacks is left out for all
    return stats.tie_group_table(checks.paired(materialized(_numbered_cells(spark, sf)), "intersect"), ["track", "lang"])


# a few resamples, so that SQL can draw them as well
FEW = 20
_DIVIDED = "CASE WHEN sum({1}) <> 0 THEN sum({0})::DOUBLE / sum({1})::DOUBLE ELSE 0.0 END"
_BOUNDS_SQL = "round(quantile_cont({0}, 0.025), 9) AS lo, round(quantile_cont({0}, 0.975), 9) AS hi"


@query(f"""WITH RECURSIVE cells AS (SELECT engine, track, lang, errors, ref_len, row_number() OVER (PARTITION BY engine, track, lang ORDER BY utt_id) - 1 AS pos, count(*) OVER (PARTITION BY engine, track, lang) AS size FROM ({_CELLS_SQL})),
{draws_sql(FEW, stats.SEED, "SELECT DISTINCT size FROM cells")},
rates AS (SELECT engine, track, lang, resample, {_DIVIDED.format("errors", "ref_len")} AS rate FROM cells JOIN draws USING (size, pos) GROUP BY ALL)
SELECT engine, track, lang, {_BOUNDS_SQL.format("rate")} FROM rates GROUP BY ALL""")
def bootstrap_few(spark, sf):
    """The published intervals of every cell, from the first resamples of the stream."""
    made = stats.cell_intervals(document_cells(spark, sf), list(A.CELL), n=FEW)
    return made.select(*A.CELL, *(F.round(c, 9).alias(c) for c in ("lo", "hi")))


_ALL_NUMBERED_SQL = f"SELECT engine, errors, ref_len, row_number() OVER (PARTITION BY engine ORDER BY utt_id) AS utt FROM ({_CELLS_SQL})"
_PAIRS_OF_SQL = f"""numbered AS (SELECT * FROM ({_ALL_NUMBERED_SQL}) {{0}}),
standing AS (SELECT engine, {_DIVIDED.format("errors", "ref_len")} AS rate FROM numbered GROUP BY engine),
met AS (SELECT x.engine AS worse, y.engine AS better, a.errors AS ea, a.ref_len AS ra, b.errors AS eb, b.ref_len AS rb, row_number() OVER (PARTITION BY x.engine, y.engine ORDER BY a.utt) - 1 AS pos, count(*) OVER (PARTITION BY x.engine, y.engine) AS size
  FROM standing x JOIN standing y ON (x.rate, x.engine) > (y.rate, y.engine) JOIN numbered a ON a.engine = x.engine JOIN numbered b ON b.engine = y.engine AND a.utt = b.utt),
{draws_sql(FEW, stats.SEED, "SELECT DISTINCT size FROM met")},
gaps AS (SELECT worse, better, resample, {_DIVIDED.format("ea", "ra")} - {_DIVIDED.format("eb", "rb")} AS gap FROM met JOIN draws USING (size, pos) GROUP BY ALL)"""


@query(f"WITH RECURSIVE {_PAIRS_OF_SQL.format('')} SELECT worse, better, {_BOUNDS_SQL.format('gap')} FROM gaps GROUP BY ALL")
def paired_few(spark, sf):
    """The published intervals of every two sources, over what they share, from the first resamples of the stream."""
    made = stats.paired_intervals(_numbered_cells(spark, sf), ["track", "lang"], n=FEW)
    return made.select("worse", "better", *(F.round(c, 9).alias(c) for c in ("lo", "hi")))


_SHORTEST_SQL = f"WHERE utt <= (SELECT min(n) FROM (SELECT max(utt) AS n FROM ({_ALL_NUMBERED_SQL}) GROUP BY engine))"


@query(f"""WITH RECURSIVE {_PAIRS_OF_SQL.format(_SHORTEST_SQL)},
tied AS (SELECT worse, better, quantile_cont(gap, 0.025) <= 0 AND quantile_cont(gap, 0.975) >= 0 AS tied FROM gaps GROUP BY ALL),
ranked AS (SELECT engine, row_number() OVER (ORDER BY rate, engine) AS place FROM standing),
fold(place, engine, leader, tier) AS (SELECT place, engine, engine, 1 FROM ranked WHERE place = 1
  UNION ALL SELECT r.place, r.engine, CASE WHEN t.tied THEN f.leader ELSE r.engine END, CASE WHEN t.tied THEN f.tier ELSE f.tier + 1 END
  FROM fold f JOIN ranked r ON r.place = f.place + 1 JOIN tied t ON t.worse = r.engine AND t.better = f.leader)
SELECT engine, tier::INTEGER AS tier, place::INTEGER AS place FROM fold""")
def tie_groups_few(spark, sf):
    """The tiers of sources over the utterances that all have, from the first resamples of the stream."""
    groups = stats.tie_group_table(checks.paired(materialized(_numbered_cells(spark, sf)), "intersect"), ["track", "lang"], n=FEW)
    rows = groups.select("tie_groups", F.posexplode("tie_groups").alias("tier", "members")).select(F.flatten("tie_groups").alias("all"), "tier", F.explode("members").alias("engine"))
    return rows.select("engine", (F.col("tier") + 1).alias("tier"), F.array_position("all", F.col("engine")).cast("int").alias("place"))


# --- extras of the specification

_TERMS = ["thing", "the", "ion", "zzz"]
_FILLERS = ["of", "the", "a"]


_HYPS_SQL = f"SELECT lang, coalesce(normal, '') AS hyp FROM ({_NORMAL_SQL})"


@query(f"SELECT h.lang, t.term, avg(CASE WHEN contains(h.hyp, t.term) THEN 1.0 ELSE 0.0 END)::DOUBLE AS term_recall FROM ({_HYPS_SQL}) h, ({_values([(t,) for t in _TERMS])}) t(term) GROUP BY ALL")
def term_recall(spark, sf):
    docs = spread(table(spark, sf, "documents"))
    hyps = docs.select("doc_id", "lang", normalized(F.col("lang"), F.col("text")).alias("hyp"))
    terms = docs.select("doc_id", "lang", F.explode(F.array(*map(F.lit, _TERMS))).alias("term"))
    return A.term_recall(terms, hyps, ["doc_id", "lang"], ["lang", "term"])


@query(f"SELECT conv_id, turn, len(list_filter(string_split(ref, ' '), lambda w: w <> '' AND w NOT IN ({', '.join(map(_text, _FILLERS))})))::INTEGER AS n_kept FROM ({_CLEAN_SQL})")
def filler_tolerant(spark, sf):
    kept = A.without_fillers(F.col("ref"), F.array(*map(F.lit, _FILLERS)))
    return _word_pairs(spark, sf).select("conv_id", "turn", F.size(kept).alias("n_kept"))


@query("SELECT user_id, round(median(value), 6) AS vote FROM events WHERE value IS NOT NULL GROUP BY user_id")
def judge_median(spark, sf):
    votes = table(spark, sf, "events").where("value is not null").groupBy("user_id").agg(F.collect_list("value").alias("votes"))
    return votes.select("user_id", F.round(A.judge_median(F.col("votes")), 6).alias("vote"))


@query("SELECT vec_id, round(peak, 6) AS peak, round(CASE WHEN peak > 0 THEN 0.5 / peak ELSE 1.0 END, 6) AS scale, CASE WHEN peak > 0 THEN true ELSE false END AS passes FROM (SELECT vec_id, list_max(list_transform(embedding, lambda x: abs(x)))::DOUBLE AS peak FROM embeddings)")
def peak_normalize(spark, sf):
    x = F.col("embedding")
    return table(spark, sf, "embeddings").select("vec_id", F.round(audio.peak(x), 6).alias("peak"), F.round(audio.scale(x), 6).alias("scale"), audio.passes(F.lit("PCM_16"), audio.peak(audio.peak_normalized(x))).alias("passes"))


# --- the whole evaluation


def records(spark, sf) -> DataFrame:
    """Adjacent turns as records of two engines: "next" answers with the next turn, "echo" with the reference less its last tenth."""
    rows = pairs(spark, sf).where("ref_raw is not null")
    common = [F.lit("a").alias("track"), F.lit("en").alias("lang_key"), F.concat_ws("_", F.lit("en"), "conv_id", "turn").alias("file_utt_id"), F.col("ref_raw").alias("ref_text_raw")]
    rest = [F.length("ref_raw").cast("double").alias("duration_sec"), (F.col("turn") + 1).cast("double").alias("latency_sec"), F.lit("2026-07-05T00:00:00Z").alias("timestamp_utc")]
    engine = lambda name, text: rows.select(F.lit(name).alias("engine_key"), *common, text.alias("text"), *rest, F.lit(f'{{"model": "{name}"}}').alias("params"))
    clipped = F.expr("substring(ref_raw, 1, cast(length(ref_raw) * 0.9 as int))")
    return engine("next", F.col("hyp_raw")).union(engine("echo", clipped))


@query()
def cell_scores(spark, sf):
    rows = materialized(score.score_utterances(records(spark, sf)).drop("cer_ops", "wer_ops"))
    return score.cell_scores(score.cell_table(rows))


_RECORDS_SQL = f"""
SELECT e.engine, 'a' AS track, 'en' AS lang, 'en_' || conv_id || '_' || turn AS utt_id, ref_raw, length(ref_raw)::DOUBLE AS duration, (turn + 1)::DOUBLE AS latency,
  coalesce(CASE e.engine WHEN 'next' THEN hyp_raw ELSE substring(ref_raw, 1, floor(length(ref_raw) * 0.9)::INTEGER) END, '') AS hyp_raw
FROM ({_PAIRS_SQL}), (VALUES ('next'), ('echo')) e(engine) WHERE ref_raw IS NOT NULL"""
_FORMS_SQL = f"SELECT *, {english_sql('ref_raw')} AS ref, {english_sql('hyp_raw')} AS hyp FROM ({_RECORDS_SQL})"
_SCORED_SQL = word_split_sql(f"SELECT *, {_WORDS.format('ref')} AS r, {_WORDS.format('hyp')} AS h FROM ({_FORMS_SQL})")
_UTTERANCES_SQL = rf"""
SELECT engine, track, lang, utt_id, {_char_distance_sql('ref', 'hyp')} AS cer_errors, length(ref)::INTEGER AS cer_len, n_sub + n_del + n_ins AS wer_errors, len(r)::INTEGER AS wer_len,
  trim(regexp_replace(hyp_raw, '\s', '', 'g')) = '' AS empty, CASE WHEN duration <> 0 THEN latency / duration END AS rtf
FROM ({_SCORED_SQL})"""


@query(_UTTERANCES_SQL)
def utterance_scores(spark, sf):
    rows = score.score_utterances(records(spark, sf))
    return rows.select("engine", "track", "lang", "utt_id", "cer_errors", "cer_len", "wer_errors", "wer_len", "empty", "rtf")


_RATE = "CASE WHEN sum({1}) <> 0 THEN sum({0})::DOUBLE / sum({1}) WHEN sum({0}) > 0 THEN 1.0 ELSE 0.0 END"
_MEAN = "avg(CASE WHEN {1} <> 0 THEN {0}::DOUBLE / {1} WHEN {0} > 0 THEN 1.0 ELSE 0.0 END)"


CELL_FIGURES_SQL = f"""
SELECT engine, lang, 'wer' AS headline_metric, count(*)::INTEGER AS n_utterances, count(*) FILTER (empty)::INTEGER AS empty_transcripts, engine AS model_ids, '2026-07-05' AS run_dates,
  NULL::DOUBLE AS price_per_audio_hour_usd, round(quantile_cont(rtf, 0.5), 6) AS rtf_p50, round(quantile_cont(rtf, 0.9), 6) AS rtf_p90,
  round({_RATE.format('cer_errors', 'cer_len')}, 6) AS cer_corpus, round({_MEAN.format('cer_errors', 'cer_len')}, 6) AS cer_utterance_mean,
  round({_RATE.format('wer_errors', 'wer_len')}, 6) AS wer_corpus, round({_MEAN.format('wer_errors', 'wer_len')}, 6) AS wer_utterance_mean
FROM ({_UTTERANCES_SQL}) GROUP BY engine, lang"""


def rounded_figures(cells: DataFrame) -> DataFrame:
    rounded = [F.round(c, 6).alias(c) for c in ("rtf_p50", "rtf_p90", "cer_corpus", "cer_utterance_mean", "wer_corpus", "wer_utterance_mean")]
    return cells.select("lang", "engine", "headline_metric", "n_utterances", "empty_transcripts", "model_ids", "run_dates", "price_per_audio_hour_usd", *rounded)


@query(CELL_FIGURES_SQL)
def cell_figures(spark, sf):
    """The published table of cells but for what the seeded generator decides."""
    return rounded_figures(cell_scores(spark, sf))


@query(f"SELECT engine, track, lang, round(rate, 9) AS rate, true AS brackets FROM ({_RATES_SQL})")
def interval_brackets(spark, sf):
    """Every interval holds the rate it is of."""
    cells = bootstrap_ci(spark, sf).join(_cell_rates(spark, sf), list(A.CELL))
    return cells.select(*A.CELL, F.round("rate", 9).alias("rate"), (F.col("rate") >= F.col("lo") - 1e-12).alias("a"), (F.col("rate") <= F.col("hi") + 1e-12).alias("b")).select(*A.CELL, "rate", (F.col("a") & F.col("b")).alias("brackets"))


_NUMBERED_SQL = f"SELECT engine, errors, ref_len, row_number() OVER (PARTITION BY engine ORDER BY utt_id) AS utt FROM ({_CELLS_SQL})"
_SHARED_SQL = f"SELECT engine, CASE WHEN sum(ref_len) <> 0 THEN sum(errors)::DOUBLE / sum(ref_len)::DOUBLE ELSE 0.0 END AS rate FROM ({_NUMBERED_SQL}) WHERE utt <= (SELECT min(n) FROM (SELECT max(utt) AS n FROM ({_NUMBERED_SQL}) GROUP BY engine)) GROUP BY engine"


@query(f"SELECT engine, row_number() OVER (ORDER BY rate, engine)::INTEGER AS place FROM ({_SHARED_SQL})")
def tie_group_order(spark, sf):
    """Every engine once, in the order of rates over what all share, however the tiers are cut."""
    return tie_groups(spark, sf).select(F.posexplode(F.flatten("tie_groups")).alias("at", "engine")).select("engine", (F.col("at") + 1).alias("place"))


@query(f"SELECT a.engine AS worse, b.engine AS better, true AS brackets FROM (SELECT engine, rate FROM ({_ENGINE_RATES_SQL})) a JOIN (SELECT engine, rate FROM ({_ENGINE_RATES_SQL})) b ON (a.rate, a.engine) > (b.rate, b.engine)")
def paired_order(spark, sf):
    """Every two engines once, the worse first, and intervals whose upper end says so."""
    return paired_diff(spark, sf).select("worse", "better", (F.col("hi") > -1e-3).alias("brackets"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every cell: rates, intervals and tiers."""
    return cell_scores(spark, sf_dir)
