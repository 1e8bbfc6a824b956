"""URL filtering by pattern rules, each indexed under its rarest literal token.

A URL is cut into tokens (runs of ASCII letters and digits). Every rule names the tokens that a
URL it matches must hold whole, and is filed under the one of them that is rarest in the table at
hand. The tokens of a URL fetch the rules filed under them, and only those run their regular
expressions. The table is read twice, for the counts and for the verdicts. Only tokens that some rule
names are counted, so nothing is shuffled but one partial count a task and rule token.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

#: Rules a worker holds at most; more are a configuration error, not a reason to drop some.
MAX_RULES = 1_000_000
ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TOKEN = re.compile("[0-9a-z]+")


class Rule(NamedTuple):
    """regex runs on host + newline + path, with the host in lower case. Longer name wins; of equals, block."""

    name: str
    action: str
    regex: str
    tokens: tuple[str, ...]
    site: bool = True


def site_rule(action: str, host: str, path: str) -> Rule:
    """Fits a host and all its subdomains where the path begins with `path`."""
    whole = path.lower()[: path.rfind("/") + 1]  # only a closed segment is a whole token of every URL that fits
    tokens = tuple(dict.fromkeys(_TOKEN.findall(host) + (_TOKEN.findall(whole) if path == path.lower() else [])))
    return Rule(host + path, action, rf"^(?:[^\n]*\.)?{re.escape(host)}\n{re.escape(path)}", tokens)


def word_rule(word: str, beside: str) -> Rule:
    """Blocks hosts with a label that holds both words between its hyphens."""
    a, b = re.escape(word), re.escape(beside)
    return Rule(f"{word}-{beside}", "block", rf"^(?:[^\n]*\.)?(?:[^.\n]*-)?(?:{a}-{b}|{b}-{a})(?:-[^.\n]*)?(?:\.|\n)", (word, beside), False)


#: The rules of the contract. Fixed values.
SITE_RULES = (
    site_rule("block", "com", "/en/"),
    site_rule("allow", "example.com", "/en/7"),
    site_rule("allow", "net", "/de/"),
    site_rule("block", "example.net", "/de/8"),
    site_rule("block", "org", "/es/"),
)
#: The filter's own patterns, which decide where no site rule fits: hosts with a label that holds a
#: word of a trade and, beside it, a word it is advertised with. Any rules may be given instead.
TRADES = {
    "gambling": ("bet bets betting bingo blackjack casino casinos gamble gambling jackpot lotto poker roulette slots wager", "best big bonus cash free live lucky mega online play royal vip win winner"),
    "pharmacy": ("drugs meds pharmacy pills steroids tablets viagra cialis", "buy cheap discount fast free generic online order sale"),
    "lending": ("loan loans payday credit", "cash cheap easy fast instant quick"),
}
WORD_RULES = tuple(word_rule(word, beside) for words, besides in TRADES.values() for word in words.split() for beside in besides.split())


def host_of(url: Column) -> Column:
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(found, F.lit("")), ASCII_UPPER, ASCII_LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _tokens(host: str, path: str) -> set[str]:
    # the path's letters count in lower case here; the expressions then see them as they are
    return set(_TOKEN.findall(host)) | set(_TOKEN.findall(path.lower()))


def token_counts(pages: DataFrame, rules: tuple[Rule, ...], url: str = "url") -> dict[str, int]:
    """How many rows of `pages` hold each token that some rule names; one row a token comes to the driver."""
    wanted = sorted({t for r in rules for t in r.tokens})
    spark = pages.sparkSession
    cut = F.array_distinct(F.regexp_extract_all(F.concat_ws("\n", host_of(F.col(url)), F.lower(path_of(F.col(url)))), F.lit("([0-9a-z]+)")))
    named = spark.createDataFrame([(t,) for t in wanted], "token string")
    rows = pages.select(F.explode(cut).alias("token")).join(F.broadcast(named), "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))  # tokens of MAX_RULES rules at most
    return {t: 0 for t in wanted} | {r.token: r.n for r in rows.collect()}


def build_index(rules: tuple[Rule, ...], counts: dict[str, int]) -> tuple[dict[str, list[Rule]], list[Rule]]:
    """Rules by their rarest token, and those that name no token and so run for every URL."""
    index: dict[str, list[Rule]] = {}
    always = []
    for rule in rules:
        if rule.tokens:
            index.setdefault(min(rule.tokens, key=lambda t: (counts.get(t, 0), t)), []).append(rule)
        else:
            always.append(rule)
    return index, always


def _order(rule: Rule) -> tuple:
    return rule.site, len(rule.name), rule.action == "block", rule.name


def judge(host: str, path: str, index: dict[str, list[Rule]], always: list[Rule], compiled: dict[str, re.Pattern]) -> tuple[str | None, str, str | None, int]:
    """(site rule or None, verdict, pattern rule or None, expressions run)."""
    fit, subject, ran = [], f"{host}\n{path}", 0
    for rule in [*always, *(r for t in _tokens(host, path) for r in index.get(t, ()))]:
        ran += 1
        if (p := compiled.get(rule.regex)) is None:
            p = compiled[rule.regex] = re.compile(rule.regex)
        if p.match(subject):
            fit.append(rule)
    if not fit:
        return None, "allow", None, ran
    best = max(fit, key=_order)
    return (best.name if best.site else None), best.action, (None if best.site else best.name), ran


def filter_urls(pages: DataFrame, rules: tuple[Rule, ...] = SITE_RULES + WORD_RULES, url: str = "url", to: str = "judged") -> DataFrame:
    """`pages` with a struct column `to`: host, path, rule, verdict, pattern, ran.

    A null URL, or one without "://", has an empty host and path, which fit no rule with tokens,
    and is allowed. Of site rules the longest wins, of equally long ones a blocking one; a site
    rule beats any pattern. `ran` says how many expressions the URL's tokens fetched.
    Extra columns and repeated rows pass through; a column named `to` is replaced.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; a worker holds {MAX_RULES}")
    shared = pages.sparkSession.sparkContext.broadcast(build_index(rules, token_counts(pages, rules, url)))

    def judged(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        (index, always), compiled = shared.value, {}
        for hosts, paths in batches:
            rows = [judge(h.as_py(), p.as_py(), index, always, compiled) for h, p in zip(hosts, paths, strict=True)]
            rule, verdict, pattern, ran = zip(*rows) if rows else ((), (), (), ())
            yield pa.StructArray.from_arrays([pa.array(rule, pa.string()), pa.array(verdict, pa.string()), pa.array(pattern, pa.string()), pa.array(ran, pa.int32())], names=["rule", "verdict", "pattern", "ran"])

    run = arrow_udf(judged, "struct<rule:string,verdict:string,pattern:string,ran:int>")
    host, path = host_of(F.col(url)), path_of(F.col(url))
    made = pages.withColumn("__j", run(host, path))
    return made.withColumn(to, F.struct(host.alias("host"), path.alias("path"), "__j.rule", "__j.verdict", "__j.pattern", "__j.ran")).drop("__j")
