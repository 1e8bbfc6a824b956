"""Language identification by rank-order profiles.

The profile of a language is the list of its most frequent n-grams of one to three letters (with a
mark at the ends of words), most frequent first. A document's own list is compared with each by the
out-of-place distance: the sum over its n-grams of the difference of ranks, or of the profile's
length where a profile lacks one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textgauge.llm.common import low_hash, sliced, text_udf, wide_share

PROFILE = 400
#: Documents of each language that a profile is fitted on, at most: those with the smallest hash of their id.
FIT_DOCS = 500
#: Languages a model holds at most.
MAX_LANGUAGES = 1000
#: Characters counted at once; bounds the memory a very long text takes.
STEP = 1 << 19
_kinds = np.full(0x110000, -1, np.int8)


def letters(text: str) -> np.ndarray:
    """Code points of the lower-cased letters plus one, and 1 for every other character."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = _kinds[codes]
    if (kinds < 0).any():
        for c in np.unique(codes[kinds < 0]).tolist():
            _kinds[c] = chr(c).isalpha()
        kinds = _kinds[codes]
    return np.where(kinds == 1, codes.astype(np.int64) + 1, 1)


def gram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Codes of a text's n-grams, ascending, and how often each stands there; none without letters.

    A text passes through in parts, each behind the last two characters of the one before, so that
    n-grams reach across and memory is bounded whatever the script. The ends of a text, and runs of
    other characters, are a single 1.
    """
    text, parts, behind = text or "", [], np.ones(1, np.int64)
    for at in range(0, len(text), STEP):
        last = [1] if at + STEP >= len(text) else []
        seq = np.concatenate((behind, letters(text[at : at + STEP]), np.array(last, np.int64)))
        seq = seq[np.concatenate(([True], (seq[1:] != 1) | (seq[:-1] != 1)))]
        new = len(behind)
        behind = seq[-2:]
        two = seq[:-1] << 21 | seq[1:]
        three = two[:-1] << 21 | seq[2:]
        ends = np.arange(2, len(seq))
        three = three[(seq[1:-1] != 1) & (ends >= new)]
        one = seq[new:]
        two = two[max(0, new - 1) :]
        if len(one):
            parts.append(np.unique(np.concatenate((one[one != 1], two, three)), return_counts=True))
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(parts) == 1:
        return parts[0]
    codes, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return codes, np.bincount(where, weights=np.concatenate([p[1] for p in parts])).astype(np.int64)


def ranked(codes: np.ndarray, counts: np.ndarray, n: int = PROFILE) -> np.ndarray:
    """The n most frequent codes, most frequent first, ties by code."""
    return codes[np.argsort(-counts, kind="stable")[:n]]


class Profiles:
    def __init__(self, profiles: dict[str, list[int]], size: int = PROFILE):
        self.langs, self.size = sorted(profiles), size
        self.codes = np.unique(np.concatenate([np.array(p, np.int64) for p in profiles.values()] or [np.zeros(0, np.int64)]))
        self.ranks = np.full((len(self.langs), len(self.codes) + 1), -1, np.int64)
        for i, lang in enumerate(self.langs):
            self.ranks[i, np.searchsorted(self.codes, np.array(profiles[lang], np.int64))] = np.arange(len(profiles[lang]))

    def predict(self, text: str | None) -> tuple[str, float]:
        """The nearest language and 1 less its share of the greatest distance; ties go to the first name.

        ("und", 0) for a text that is null or has no letter, and where no language was learned.
        """
        mine = ranked(*gram_counts(text), self.size)
        if not len(mine) or not self.langs:
            return "und", 0.0
        at = np.searchsorted(self.codes, mine)
        at[at == len(self.codes)] = 0
        at[self.codes[at] != mine] = len(self.codes)
        ranks = self.ranks[:, at]
        apart = np.where(ranks < 0, self.size, np.abs(ranks - np.arange(len(mine)))).sum(axis=1)
        best = int(apart.argmin())
        return self.langs[best], 1 - float(apart[best]) / (self.size * len(mine))


def fit(docs: DataFrame, usable: Column, id_col: str = "doc_id", text: str = "text", lang: str = "lang", size: int = PROFILE, fit_docs: int = FIT_DOCS) -> Profiles:
    """Profiles from `fit_docs` documents of each language among those where `usable` holds.

    Documents whose language or text is null are not used. The sample is the same at every run;
    the profiles (languages times `size` numbers) come to the driver.
    """
    ranked_ids = docs.where(usable & F.col(lang).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("__id"), F.col(lang).alias("__lang"))
    sizes = ranked_ids.groupBy("__lang").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not sizes:
        return Profiles({}, size)
    share = F.element_at(F.create_map(*(F.lit(x) for r in sizes for x in (r["__lang"], wide_share(fit_docs, r.n)))), F.col("__lang"))
    first = Window.partitionBy("__lang").orderBy(F.pmod(F.xxhash64("__id"), F.lit(1 << 40)), "__id")
    chosen = ranked_ids.where(low_hash(F.col("__id"), share)).withColumn("__r", F.row_number().over(first)).where(F.col("__r") <= fit_docs).select("__id").distinct()
    sample = docs.where(usable & F.col(lang).isNotNull() & F.col(text).isNotNull()).join(F.broadcast(chosen), F.col(id_col) == F.col("__id"), "left_semi")  # fit_docs ids a language at most

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, t in zip(pdf["lang"], pdf["text"], strict=True):
                codes, n = gram_counts(t)
                yield pd.DataFrame({"lang": name, "code": codes, "n": n})

    counted = sample.select(F.col(lang).alias("lang"), F.col(text).alias("text")).mapInPandas(count, "lang string, code bigint, n bigint")
    sums = counted.groupBy("lang", "code").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    rows = sums.withColumn("r", F.row_number().over(order)).where(F.col("r") <= size).collect()
    profiles: dict[str, list[int]] = {}
    for r in sorted(rows, key=lambda r: (r.lang, r.r)):
        profiles.setdefault(r.lang, []).append(r.code)
    return Profiles(profiles, size)


def identify(docs: DataFrame, profiles: Profiles, text: str = "text", to: str = "language") -> DataFrame:
    """`docs` with a struct column `to`: lang_pred and score, from the whole of each text. A column of that name is replaced."""

    def predicted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in sliced(batches):
            rows = [profiles.predict(t.as_py()) for t in texts]
            names, scores = zip(*rows) if rows else ((), ())
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["lang_pred", "score"])

    return docs.withColumn(to, text_udf(predicted, "struct<lang_pred:string,score:double>")(F.col(text)))
