"""URL filter: allow/block rules by host and path, and gradient-boosted trees on lexical features for the rest.

Everything that touches the table is DataFrame expressions: the fitted trees and the suffix statistics are written out as SQL
CASE expressions, so a scan of the url column, the features and the verdict are one stage without a shuffle. The trees are fitted
on the driver from labelled URLs (at most boosting.MAX_ROWS of them). The tables have no labelled URLs, so the default labels are
the seeded list of seed_urls(); pass your own (url, blocked) pairs to fit().
"""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from annolytics.llm import boosting

#: (host, path, verdict); a rule fits its host and all subdomains where the url's path starts with the rule's.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

FEATURES = (
    "host_length", "path_length", "query_length", "labels", "longest_label", "depth", "host_hyphens", "host_digit_ratio",
    "url_digit_ratio", "host_entropy", "parameters", "suffix_odds", "domain_odds",
)

#: Lexicon of the seeded labelled URLs.
BAIT = "casino bets pills poker adult spam ads track win cheap free loan bonus click prize dating viagra slots farm promo x hot xxx jackpot deals".split()
PLAIN = "news maps garden river history school library museum weather travel music kitchen science city forum studio tion ther ing ble ear and sta".split()
TAILS = ("", "/", ".html", "?page=2&ref=x", "?utm_source=feed", "#top")


def seed_urls(n: int = 4000, seed: int = 11) -> list[tuple[str, int]]:
    """A seeded list of labelled URLs: hosts of ordinary words, and hosts that string bait words together. One in 50 labels is wrong."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        bad = int(i % 4 == 0)
        if bad:
            name = "-".join(rng.sample(BAIT, rng.choice((2, 2, 2, 3)))) + rng.choice(("", "", str(rng.randrange(1000))))
        else:
            name = "".join(rng.sample(PLAIN, rng.choice((1, 2, 2, 3)))) if rng.random() < 0.95 else "-".join(rng.sample(PLAIN, 2))
        host = rng.choice(("", "www.", "m.", "blog.")) + name + rng.choice((".example", ".site", "")) + rng.choice((".com", ".net", ".org"))
        path = rng.choice(("", "/", f"/{rng.choice(('en', 'de', 'fr', 'es'))}/{rng.randrange(10000)}", f"/{rng.choice(PLAIN)}/{rng.choice(PLAIN)}/{rng.randrange(100)}"))
        url = rng.choice(("http", "https")) + "://" + host + (path + rng.choice(TAILS) if len(path) > 1 else path)
        out.append((url, bad ^ int(rng.random() < 0.02)))
    return out


def split_url(url: str | None) -> tuple[str, str, str]:
    """host, path and query of the contract, in Python: used on labelled URLs only."""
    if url is None or "://" not in url:
        return "", "", ""
    rest = url.split("://", 1)[1]
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host, rest = rest[:cut], rest[cut:]
    end = min((rest.find(c) for c in "?#" if c in rest), default=len(rest))
    path, rest = rest[:end], rest[end:]
    query = rest[1:].split("#", 1)[0] if rest.startswith("?") else ""
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path, query


def suffixes(host: str) -> tuple[str, str]:
    parts = host.split(".")
    return parts[-1], ".".join(parts[-2:])


@dataclass
class UrlModel:
    trees: boosting.Boosted
    odds: dict[str, float]  # of one- and two-label suffixes; others 0

    def features(self, url: str | None) -> list[float]:
        host, path, query = split_url(url)
        text = url or ""
        top, domain = suffixes(host)
        n = len(host)
        entropy = -sum(k / n * math.log2(k / n) for k in Counter(host).values()) if n else 0.0
        digits = lambda s: sum("0" <= c <= "9" for c in s)
        return [
            n, len(path), len(query), host.count(".") + 1 if n else 0, max(map(len, host.split("."))), sum(bool(p) for p in path.split("/")),
            host.count("-"), digits(host) / n if n else 0.0, digits(text) / len(text) if text else 0.0, entropy,
            sum(bool(p) for p in query.split("&")), self.odds.get(top, 0.0), self.odds.get(domain, 0.0),
        ]

    def blocked(self, url: str | None) -> float:
        return float(self.trees.margin(np.array([self.features(url)], dtype=float))[0])


def fit(labelled: Iterable[tuple[str, int]], *, rounds: int = 24, depth: int = 3, max_suffixes: int = 200) -> UrlModel:
    """Suffix statistics (smoothed log odds, the max_suffixes most frequent) and trees from (url, blocked) pairs."""
    labelled = list(labelled)
    seen: dict[str, list[int]] = defaultdict(lambda: [0, 0])
    for url, y in labelled:
        for s in {*suffixes(split_url(url)[0])}:
            seen[s][y] += 1
    base = sum(y for _, y in labelled) / max(1, len(labelled))
    prior = math.log((base + 0.01) / (1.01 - base))
    often = sorted(seen, key=lambda s: (-sum(seen[s]), s))[:max_suffixes]
    # few observations say little: shrunk towards the prior by 20 rows
    odds = {s: round(math.log((seen[s][1] + 20 * base + 0.1) / (seen[s][0] + 20 * (1 - base) + 0.1)) - prior, 6) for s in often if sum(seen[s]) >= 20}
    model = UrlModel(boosting.Boosted(0.0, []), odds)
    x = np.array([model.features(u) for u, _ in labelled], dtype=float).reshape(-1, len(FEATURES))
    model.trees = boosting.fit(x, np.array([y for _, y in labelled]), rounds=rounds, depth=depth)
    return model


@lru_cache(maxsize=1)
def default_model() -> UrlModel:
    return fit(seed_urls())


def host_of(url: Column) -> Column:
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(found, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*(/[^?#]*)", 1), F.lit(""))


def query_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*(?:/[^?#]*)?\?([^#]*)", 1), F.lit(""))


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters, in bits; 0 for an empty text."""
    n = F.length(text)
    share = lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n
    bits = F.aggregate(F.array_distinct(F.split(text, "")), F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c)))
    return F.when(n > 0, bits).otherwise(F.lit(0.0))


def with_features(df: DataFrame, model: UrlModel) -> DataFrame:
    """df (url, host, path) with one double column for each of FEATURES, prefixed _f_."""
    url, host, path = F.coalesce("url", F.lit("")), F.col("host"), F.col("path")
    ratio = lambda s: F.when(F.length(s) > 0, F.regexp_count(s, F.lit("[0-9]")) / F.length(s)).otherwise(F.lit(0.0))
    labels = F.split(host, r"\.", -1)
    domain = F.substring_index(host, ".", -2)
    known = F.create_map(*[F.lit(x) for pair in model.odds.items() for x in pair]) if model.odds else F.create_map(F.lit(""), F.lit(0.0))
    odds = lambda s: F.coalesce(F.element_at(known, s), F.lit(0.0))
    query = query_of(F.col("url"))
    values = (
        F.length(host), F.length(path), F.length(query), F.when(F.length(host) > 0, F.size(labels)).otherwise(0),
        F.array_max(F.transform(labels, F.length)), F.regexp_count(path, F.lit("[^/]+")), F.regexp_count(host, F.lit("-")), ratio(host), ratio(url),
        entropy(host), F.regexp_count(query, F.lit("[^&]+")), odds(F.substring_index(host, ".", -1)), odds(domain),
    )
    return df.withColumns({f"_f_{k}": v.cast("double") for k, v in zip(FEATURES, values, strict=True)})


def judged(pages: DataFrame, *, rules: Sequence[tuple[str, str, str]] = RULES, model: UrlModel | None = None, threshold: float = 0.0) -> DataFrame:
    """pages with host, path, rule, verdict and margin (log odds of a block by the trees).

    The longest fitting rule decides; without one, the trees: block above threshold. A null url, or one without ://, has an empty
    host and path, fits no rule, and is judged on its remaining features. Long urls are read whole; equal urls get equal verdicts.
    Columns of the input named host, path, rule, verdict or margin are replaced.
    """
    model = model or default_model()
    df = pages.drop("host", "path", "rule", "verdict", "margin").withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))
    rule = verdict = None
    for host, path, what in ordered:
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule = F.when(fits, host + path) if rule is None else rule.when(fits, host + path)
        verdict = F.when(fits, what) if verdict is None else verdict.when(fits, what)
    df = df.withColumns({"rule": rule if rule is not None else F.lit(None).cast("string"), "verdict": verdict if verdict is not None else F.lit(None).cast("string")})
    df = with_features(df, model).withColumn("margin", F.expr(model.trees.sql([f"_f_{f}" for f in FEATURES])))
    df = df.withColumn("verdict", F.coalesce("verdict", F.when(F.col("margin") > threshold, "block").otherwise("allow")))
    return df.drop(*[f"_f_{f}" for f in FEATURES])
