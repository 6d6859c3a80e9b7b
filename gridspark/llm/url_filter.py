"""Weighted URL vocabulary and host rules.

An Aho-Corasick automaton finds every term of a strict and a soft vocabulary in
a lower-cased URL; an occurrence counts only between boundaries (no ASCII letter
or digit next to it). One strict term, or several distinct soft terms, reject
the URL. Host rules come first: the longest that fits decides.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, ascii_lower, documents

#: Vocabulary: one of these is enough.
STRICT_TERMS = ("porn", "porno", "xxx", "adult", "sex", "hentai", "camgirl", "escort", "casino", "warez")
#: Vocabulary: so many different ones of these are needed.
SOFT_TERMS = ("ads", "track", "bet", "poker", "nude", "dating", "pills", "viagra", "loan", "torrent", "click", "popup", "spam", "crack", "free", "win")
SOFT_LIMIT = 2
#: (host, path, verdict)
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
_FOLD = str.maketrans(UPPER, LOWER)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (lower-cased) and path of a URL; both empty for null or no ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = ascii_lower(F.regexp_extract(url, pattern, 1))
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, pattern, 2), F.lit(""))


def matched_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Rule (host and path) and verdict of the longest rule that fits, or nulls.
    Of two of equal length the one with the longer host wins."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), len(r[0]))):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


class Vocabulary:
    """Counts the distinct strict and soft terms of a text."""

    def __init__(self, strict: Sequence[str], soft: Sequence[str]):
        self.automaton = ahocorasick.Automaton()
        for term in {*strict, *soft}:
            self.automaton.add_word(term, (term, term in strict))
        if len(self.automaton):
            self.automaton.make_automaton()

    def counts(self, text: str | None) -> tuple[int, int]:
        found: dict[str, bool] = {}
        text = (text or "").translate(_FOLD)
        if not text or not len(self.automaton):
            return 0, 0
        for end, (term, is_strict) in self.automaton.iter(text):
            start = end - len(term)
            if (start < 0 or not _is_word(text[start])) and (end + 1 == len(text) or not _is_word(text[end + 1])):
                found[term] = is_strict
        n = sum(found.values())
        return n, len(found) - n


def _is_word(c: str) -> bool:
    return c.isascii() and c.isalnum()


def filter_urls(
    df: DataFrame,
    url: str = "url",
    rules: Sequence[tuple[str, str, str]] = RULES,
    strict: Sequence[str] = STRICT_TERMS,
    soft: Sequence[str] = SOFT_TERMS,
    soft_limit: int = SOFT_LIMIT,
) -> DataFrame:
    """All columns of ``df`` and host, path, rule, strict_hits, soft_hits, verdict.

    A null or empty URL has an empty host and path, no rule and no hits: it is
    allowed. Each row is judged by itself, so repeated rows and ties agree and
    an empty table gives an empty one. Input columns named like an output
    column are replaced.
    """

    @F.pandas_udf("strict_hits int, soft_hits int")
    def hits(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        words = Vocabulary(strict, soft)
        for urls in parts:
            yield pd.DataFrame([words.counts(u) for u in urls], columns=["strict_hits", "soft_hits"]).astype("int32")

    df = df.drop(*({"host", "path", "rule", "strict_hits", "soft_hits", "verdict", "_hits"} - {url}))
    host, path = url_parts(F.col(url))
    out = df.withColumns({"host": host, "path": path, "_hits": hits(F.col(url))})
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    weighed = F.when((F.col("_hits.strict_hits") > 0) | (F.col("_hits.soft_hits") >= soft_limit), "block").otherwise("allow")
    return out.select(
        *df.columns, "host", "path", rule.alias("rule"), "_hits.strict_hits", "_hits.soft_hits", F.coalesce(verdict, weighed).alias("verdict")
    )


def op7_url_filter(spark, sf_dir) -> DataFrame:
    pages = documents(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages).select("page_id", "host", "path", "rule", "verdict", "strict_hits", "soft_hits")


def oracle() -> str:
    """The same in SQL, with a regular expression a term in place of the automaton."""
    def has(term: str) -> str:
        return f"(CASE WHEN regexp_matches(low, '(^|[^a-z0-9]){term}($|[^a-z0-9])') THEN 1 ELSE 0 END)"

    fits = [(h, p, v, f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))") for h, p, v in sorted(RULES, key=lambda r: (-len(r[0] + r[1]), -len(r[0])))]
    fold = f"translate({{}}, '{UPPER}', '{LOWER}')"
    return f"""
    WITH parts AS (
      SELECT page_id, {fold.format("coalesce(url, '')")} AS low,
        {fold.format("regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)([^?#]*)', 1)")} AS host,
        regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)([^?#]*)', 2) AS path
      FROM pages),
    hits AS (
      SELECT *, CAST({" + ".join(map(has, STRICT_TERMS))} AS INTEGER) AS strict_hits,
        CAST({" + ".join(map(has, SOFT_TERMS))} AS INTEGER) AS soft_hits
      FROM parts)
    SELECT page_id, host, path,
      CASE {" ".join(f"WHEN {f} THEN '{h}{p}'" for h, p, _, f in fits)} END AS rule,
      CASE {" ".join(f"WHEN {f} THEN '{v}'" for _, _, v, f in fits)}
        WHEN strict_hits > 0 OR soft_hits >= {SOFT_LIMIT} THEN 'block' ELSE 'allow' END AS verdict,
      strict_hits, soft_hits
    FROM hits"""
