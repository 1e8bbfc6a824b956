"""One query for each operator of this subpackage, over the whole of its table, and SQL twins where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textgauge.llm import audit, codes, embeddings, flac, langid, mixing, pieces, quality, simhash, sketches, substrings, tokens, urls
from textgauge.llm.common import crc_mod, hold_batches
from textgauge.llm.common import table as _table
from textgauge.plans.session import spread

TOKEN_LIMIT = 1024
#: Words and pieces that a worker of the two token queries keeps: some 300 MB.
REMEMBERED = 400_000
QUALITY_FROM = 0.3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the queries, in a session whose batches suit documents, over all cores."""
    hold_batches(spark)
    return spread(_table(spark, sf_dir, name))


def tokenizer(name: str) -> str:
    """Where a public vocabulary file lies; a parameter of the operators."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _holds(condition):
    return F.coalesce(condition, F.lit(False))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted for every document; learned from labels that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), crc_mod("doc_id", 5) != 0)
    scored = quality.score(docs.select("doc_id", "text"), model)
    predicted = F.when(F.col("score") >= QUALITY_FROM, 1).otherwise(0)
    return scored.select("doc_id", _holds(crc_mod("doc_id", 5) == 0).alias("held_out"), "score", predicted.alias("predicted"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id for every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex16(F.col("fp")).alias("fingerprint"), "component_id")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, n_fallback, round_trip, ids for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    made = pieces.encode_documents(spark, docs, tokenizer("piece_bpe_32k.model"), remembered=REMEMBERED)
    return made.select("doc_id", "pieces.n_tokens", "pieces.n_fallback", "pieces.round_trip", "pieces.ids")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, cut_1024 (characters of the longest prefix within the limit)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    made = tokens.count_tokens(spark, docs, tokenizer("byte_bpe_50k.json"), (TOKEN_LIMIT,), remembered=REMEMBERED)
    return made.select("doc_id", "tokens.n_bytes", "tokens.n_tokens", (F.col("tokens.n_tokens") > TOKEN_LIMIT).alias("over_limit"), f"tokens.cut_{TOKEN_LIMIT}")


def op5_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes, digests and PCM blocks (how many, and the sample offset of the last, sought and read by itself) of each text stored as FLAC and read back."""
    stored = flac.store_media(table(spark, sf_dir, "documents").select("doc_id", "text"))
    read = flac.media_features(stored.select("doc_id", "n_bytes", "media"))
    return read.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_blocks", "last_offset")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken for every document."""
    return mixing.mix_report(mixing.Mix(table(spark, sf_dir, "documents")))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id, kept for every vector."""
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, owner_doc_id, first_byte, last_byte, n_words for every repeated passage outside the first document that has it."""
    found = substrings.repeated_spans(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.col("owner").alias("owner_doc_id"), "first_byte", "last_byte", "n_words")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict, pattern for every page."""
    made = urls.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"))
    return made.select("page_id", "judged.host", "judged.path", "judged.rule", "judged.verdict", "judged.pattern")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document; learned from documents that are not held out."""
    docs = table(spark, sf_dir, "documents")
    profiles = langid.fit(docs, crc_mod("doc_id", 4) != 2)
    made = langid.identify(docs.select("doc_id", "text"), profiles)
    return made.select("doc_id", _holds(crc_mod("doc_id", 4) == 2).alias("held_out"), "language.lang_pred", "language.score")


def op11_document_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every document."""
    made = sketches.edited_likeness(table(spark, sf_dir, "documents"))
    prints = (F.lower(F.hex(c)).alias(to) for c, to in (("sketch", "fingerprint"), ("edited_sketch", "edited_fingerprint")))
    return made.select("doc_id", "n_chars", "edited_sha256", *prints, "near_edited", "near_next")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 for every vector without null or non-finite components."""
    made, books = codes.compress(_table(spark, sf_dir, "embeddings"))
    return made.select("vec_id", codes.hex_code(F.col("codes")).alias("code"), "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley, filter: five filters in all their orders."""
    made = audit.audit_orders(table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return made.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley", "filter")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_quality, op2_simhash, op3_sentencepiece, op4_token_counts, op5_flac, op6_mixing, op7_embedding_dedup, op8_substring_dedup, op9_url_filter, op10_language_id, op11_document_sketch, op12_vector_codes, op13_filter_audit)}


def _url_sql() -> str:
    """For each rule a test on host and path; the greatest (site before pattern, length, block) that holds decides."""

    def text(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    site = [
        f"SELECT page_id, {len(r.name)} AS n, {text(r.name)} AS rule, {text(r.action)} AS action FROM parts WHERE (host = {text(h)} OR ends_with(host, {text('.' + h)})) AND starts_with(path, {text(p)})"
        for r in urls.SITE_RULES
        for h, p in [(r.name[: r.name.index("/")], r.name[r.name.index("/") :])]
    ]
    word = " ".join(f"WHEN regexp_matches(host, {text(f'(^|[.-])({a}-{b}|{b}-{a})([.-]|$)')}) THEN {text(r.name)}" for r in sorted(urls.WORD_RULES, key=lambda r: (len(r.name), r.name), reverse=True) for a, b in [r.tokens])
    return f"""
    WITH parts AS (
      SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{urls.ASCII_UPPER}', '{urls.ASCII_LOWER}') AS host,
             regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
      FROM pages),
    fit AS ({' UNION ALL '.join(site)}),
    best AS (SELECT page_id, rule, action FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY n DESC, action DESC) AS r FROM fit) WHERE r = 1),
    words AS (SELECT *, CASE {word} END AS pattern FROM parts)
    SELECT w.page_id, w.host, w.path, b.rule,
           coalesce(b.action, CASE WHEN w.pattern IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
           CASE WHEN b.rule IS NULL THEN w.pattern END AS pattern
    FROM words w LEFT JOIN best b USING (page_id)"""


EMBEDDING_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
good AS (SELECT * FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT vec_id AS node, vec_id AS other FROM v UNION SELECT r.node, l.b FROM reach r JOIN links l ON r.other = l.a)
SELECT v.vec_id, (SELECT count(*) FROM links l WHERE l.a = v.vec_id)::BIGINT AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN (SELECT node, min(other) AS component_id FROM reach GROUP BY node) c ON c.node = v.vec_id"""

#: Three assignments (`near`) and two means, each over all vectors; distances in exact integers.
CODES_SQL = """
WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
parts AS (SELECT vec_id, label, p, v[p * len(v) // 16 + 1 : (p + 1) * len(v) // 16] AS v FROM kept, range(16) r(p)),
book0 AS (SELECT p, e, v FROM parts JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept ORDER BY vec_id LIMIT 64) USING (vec_id)),
""" + "".join(
    f"""near{i} AS (SELECT vec_id, p, min(struct_pack(d := list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, e := b.e)) AS n
  FROM parts x JOIN book{i} b USING (p) GROUP BY vec_id, p),
"""
    + (f"""mean{i} AS (SELECT p, e, list(m::BIGINT ORDER BY k) AS v FROM (SELECT p, n.e AS e, k, floor(sum(v[k])::DECIMAL(38, 0) / count(*)) AS m
  FROM (SELECT near{i}.*, v, unnest(range(1, len(v) + 1)) AS k FROM near{i} JOIN parts USING (vec_id, p)) GROUP BY p, n.e, k) GROUP BY p, e),
book{i + 1} AS (SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM book{i} b LEFT JOIN mean{i} m USING (p, e)),
""" if i < 2 else "")
    for i in range(3)
) + """coded AS (SELECT vec_id, string_agg(lpad(lower(hex(n.e)), 2, '0'), '' ORDER BY p) AS code, sum(n.d)::BIGINT AS error FROM near2 GROUP BY vec_id),
labelled AS (SELECT vec_id, label, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error FROM coded JOIN kept USING (vec_id))
SELECT vec_id, code, error, label_error, (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) FROM book2) AS codebooks_sha256 FROM labelled"""  # fmt: skip


def _audit_sql() -> str:
    """Every order and step is judged by itself, from the documents' own flags."""
    steps = ", ".join(f"('{o}', {n}, {applied}, {bit})" for o, n, _, applied, bit in audit.order_steps(list("ABCDE")))
    return f"""
    WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
    w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS words, coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS again FROM d),
    l AS (SELECT doc_id, bool_or(coalesce(quality, 0) = 1) AS good, bool_or(coalesce(toxic, 0) = 1) AS toxic FROM labels GROUP BY doc_id),
    m AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
            (len(words) < 200)::INT + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::INT
            + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * again::INT AS mask
          FROM w LEFT JOIN l USING (doc_id)),
    c AS (SELECT part, good, toxic, mask, count(*) AS n FROM m GROUP BY ALL),
    s AS (SELECT * FROM (VALUES {steps}) AS s(filter_order, step, applied, bit)),
    r AS (SELECT part, filter_order, step, bit,
            sum(CASE WHEN mask & (applied | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
            sum(CASE WHEN mask & applied = 0 AND mask & bit > 0 THEN n ELSE 0 END)::BIGINT AS removed,
            sum(CASE WHEN mask & applied > 0 AND mask & bit > 0 THEN n ELSE 0 END)::BIGINT AS redundant,
            sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
            sum(CASE WHEN good AND mask & applied = 0 AND mask & bit > 0 THEN n ELSE 0 END)::BIGINT AS good_lost,
            sum(CASE WHEN toxic AND mask & applied = 0 AND mask & bit > 0 THEN n ELSE 0 END)::BIGINT AS toxic_lost
          FROM c, s GROUP BY part, filter_order, step, bit)
    SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
           (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley, filter_order[step] AS filter FROM r"""


ORACLES: dict[str, str] = {"op12_vector_codes": CODES_SQL, "op13_filter_audit": _audit_sql(), "op7_embedding_dedup": EMBEDDING_SQL, "op9_url_filter": _url_sql()}
