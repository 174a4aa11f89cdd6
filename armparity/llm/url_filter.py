"""URL filter: host rules first, else logistic regression on hashed character n-grams.

Host and path have n-grams of their own. The regression is fitted on a small labelled
table of URLs (:func:`labelled_urls`, or the caller's), on the driver; scoring is by row.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from armparity.llm.common import ASCII_LOWER

BITS = 18
SIZES = (3, 4, 5)

#: Seed words of the labelled table: parts of host names that stand for unwanted or for ordinary sites.
UNWANTED = ("casino", "poker", "slots", "bets", "betting", "free-bets", "jackpot", "adult", "xxx", "porn", "sexcam", "escort", "pills", "pharma-deal",
            "viagra", "cheap-pills", "spam", "spam-farm", "link-farm", "clickbait", "ads", "ads-track", "adserver", "tracker", "popunder", "win-prize",
            "casino-win", "adult-x", "warez", "crackz", "torrentz", "malware", "phish", "fake-news", "payday-loan", "replica-watch")
ORDINARY = ("news", "library", "museum", "journal", "university", "school", "science", "weather", "history", "garden", "recipes", "travel", "music",
            "cinema", "review", "forum", "docs", "wiki", "archive", "city", "theatre", "sports", "health", "nature", "maps", "books", "poetry",
            "kitchen", "report", "herald", "tribune", "station", "theory", "nation", "thether", "ination", "thering", "ontario", "tension", "then",
            "therapist", "other", "weather-report", "motherland", "theorem", "lithium", "ethics", "athens", "thirty", "smith", "stone", "traction")
_TAILS = ("example.com", "example.org", "example.net", "site.info", "blog.io", "web.de", "page.fr", "lugar.es")
_FRONTS = ("", "www.", "m.", "blog.")
_PATHS = ("/en/{}", "/de/{}/", "/fr/{}.html", "/es/{}?page=2", "/{}", "/article/{}", "/")


def labelled_urls() -> list[tuple[str, int]]:
    """The labelled table: every seed word under several fronts, endings and paths; 1 is unwanted."""
    rows = []
    for label, words in ((1, UNWANTED), (0, ORDINARY)):
        for i, (word, (j, tail)) in enumerate(itertools.product(words, enumerate(_TAILS))):
            front, path = _FRONTS[(i + j) % len(_FRONTS)], _PATHS[(i * 3 + j) % len(_PATHS)]
            rows.append((f"https://{front}{word}.{tail}{path.format((i * 7919) % 9973)}", label))
    return rows


def host_path(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a URL; both empty where it is null or has no ``://``."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    end = min((k for k in map(rest.find, "/?#") if k >= 0), default=len(rest))
    host, rest = rest[:end].translate(ASCII_LOWER), rest[end:]
    end = min((k for k in map(rest.find, "?#") if k >= 0), default=len(rest))
    return host, rest[:end]


def _hashed(host: str, path: str) -> np.ndarray:
    found = set()
    for mark, text in (("h", host), ("p", path)):
        if not text:
            continue
        data = f"{mark}^{text}$".encode("utf-8", "replace")
        head = data[:1]
        body = data[1:]
        for n in SIZES:
            for i in range(len(body) - n + 1):
                found.add(zlib.crc32(head + body[i : i + n]) >> (32 - BITS))
    return np.fromiter(sorted(found), np.int64, len(found))


def fit(rows: Sequence[tuple[str, int]], decay: float = 2e-4, steps: int = 300) -> np.ndarray:
    """Weights of the hashed n-grams; the last one is the intercept. Full-batch Adam, no randomness."""
    hashed = [_hashed(*host_path(url)) for url, _ in rows]
    y = np.array([label for _, label in rows], float)
    at, col = np.repeat(np.arange(len(rows)), [len(h) for h in hashed]), np.concatenate(hashed)
    w = np.zeros((1 << BITS) + 1)
    first, second = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        z = np.bincount(at, weights=w[col], minlength=len(rows)) + w[-1]
        error = y - 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        grad = np.append(np.bincount(col, weights=error[at], minlength=1 << BITS), error.sum()) / len(rows)
        grad[:-1] -= decay * w[:-1]
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
        w += 0.03 * first / (1 - 0.9**step) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return w


def probability(weights: np.ndarray, host: str, path: str) -> float:
    """P(unwanted); without a host or path, that of the intercept."""
    z = float(weights[_hashed(host, path)].sum() + weights[-1])
    return 1 / (1 + np.exp(-min(500.0, max(-500.0, z))))


def match(rules: Sequence[tuple[str, str]], host: str, path: str) -> tuple[str, str] | None:
    """The longest rule (verdict, ``host/path``) that fits: same host or a subdomain, path a prefix; ties to the first."""
    best = None
    for verdict, rule in rules:
        of, slash, rest = rule.partition("/")
        if (host == of or host.endswith("." + of)) and path.startswith(slash + rest) and (best is None or len(rule) > len(best[1])):
            best = (verdict, rule)
    return best


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]], weights: np.ndarray, cutoff: float = 0.5) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict`` (allow or block), ``p_unwanted``: one row per page.

    Null and malformed URLs have an empty host and path and are judged by the intercept.
    Repeated rows are judged alike; other columns play no part.
    """
    narrow = pages.select("page_id", "url")
    rules = tuple(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for value in batch.column(1):
                host, path = host_path(value.as_py())
                p = probability(weights, host, path)
                rule = match(rules, host, path)
                verdict = rule[0] if rule else "block" if p >= cutoff else "allow"
                for to, x in zip(out, (host, path, rule[1] if rule else None, verdict, p)):
                    to.append(x)
            kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, out, kinds)], names=["page_id", "host", "path", "rule", "verdict", "p_unwanted"])

    return narrow.mapInArrow(run, f"page_id {dict(narrow.dtypes)['page_id']}, host string, path string, rule string, verdict string, p_unwanted double")
