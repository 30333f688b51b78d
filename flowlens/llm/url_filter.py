"""URL filter: host and path rules first, then logistic regression on hashed character n-grams of host and path.

A rule is a host and a path prefix. It fits a URL whose host is the rule's host or a subdomain of it and whose path
starts with the rule's path; of several the longest rule wins. What no rule fits is judged by a linear model over the
n-grams (`SIZES` letters) of the host and of the path, hashed to `BUCKETS` numbers; host and path grams are told apart.
The model is trained from a small table of labelled URLs, by default labelled_urls(), with a penalty on its weights. Its
threshold comes from URLs held out by host: the least at which at most `most_wrong` of the good ones are blocked.

A null URL, or one without `://`, has an empty host and path; no rule fits it, and without a gram its probability is 0, so it
is allowed. A row
for each row, repeated ones too; an empty table gives none; columns other than page_id and url are left out.
"""

from __future__ import annotations

import functools
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZES, BUCKETS = (3, 4, 5), 1 << 15
#: The log-odds of a URL of which the model knows nothing: such URLs are allowed.
PRIOR = -3.0

#: (rule, verdict), as given for the pages query.
PAGE_RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]

#: Words of URLs to block, and words of any others.
UNWANTED = (
    "casino poker bets betting slots jackpot roulette lottery bingo viagra cialis pills pharmacy porn xxx sex adult escort cams nudes payday forex replica warez torrent crack keygen serial "
    "spam clickbait tracker track adserver ads adclick popup popunder banner phishing winner win prize bonus cheap miracle hookup dating backlinks farm pump doubler giveaway coupon hacked"
).split()
NEUTRAL = (
    "news blog wiki docs guide school history science garden recipe travel museum library weather sport music health city county journal forum archive kitchen river mountain paper radio course "
    "family design energy water forest village culture report research company service events student teacher nature planet camera bicycle language maths engineering court parliament novel"
).split()
#: Frequent letter pairs and endings, from which names without a meaning are made.
_PAIRS = "th he in er an re nd on en at ou ed ha to or it is hi es ng de le la un ie st se ar te ca ing tion ly ble ent".split()
_TOPS, _SUBS = ("example", "example.org", "example.net", "example.com"), ("", "www.", "m.", "blog.")


@functools.lru_cache(maxsize=1)
def labelled_urls(unwanted: tuple[str, ...] = tuple(UNWANTED), neutral: tuple[str, ...] = tuple(NEUTRAL)) -> list[tuple[str, int]]:
    """The labelled table (url, 1 to block), made by a rule from words: both classes use the same kinds of hosts, tops, paths and
    neutral words, so only unwanted words tell them apart. Words that are left out are nowhere in the table."""
    out, turn = [], 0

    def pick(choices):
        nonlocal turn
        turn += 1
        return choices[zlib.crc32(f"pick {turn}".encode()) % len(choices)]

    def page() -> str:
        number = zlib.crc32(f"page {turn}".encode()) % 10_000
        return pick((f"{pick(('en', 'de', 'fr', 'es'))}/{number}", f"{pick(('en', 'de', 'fr', 'es'))}/{number}.html", f"{pick(neutral)}/{number}/", f"{pick(neutral)}/{pick(neutral)}", f"{number}?page=2&ref=x", ""))

    def add(name: str, path: str, bad: int) -> None:
        out.append((f"{pick(('http', 'https'))}://{pick(_SUBS)}{name}.{pick(_TOPS)}/{path}", bad))

    for word in unwanted:
        for _ in range(6):
            add(f"{word}-{pick(unwanted)}", page(), 1)
            add(f"{word}-{pick('abcxyz0123456789')}", page(), 1)
            add(f"{pick(neutral)}-{word}", page(), 1)
            add(f"{pick(unwanted)}{word}", page(), 1)
            add(f"{word}{pick(neutral)}", page(), 1)
            add(pick(neutral) + pick(neutral), f"{word}/{page()}", 1)
    for word in neutral:
        for _ in range(6):
            add(f"{word}-{pick(neutral)}", page(), 0)
            add(f"{word}-{pick('abcxyz0123456789')}", page(), 0)
            add(f"{pick(neutral)}{word}", page(), 0)
            add(word, f"{pick(neutral)}/{page()}", 0)
    for k in range(1000):
        name = "".join(pick(_PAIRS) for _ in range(1 + k % 5))
        add(name if k % 3 else f"{name}-{pick(_PAIRS)}{pick(_PAIRS)}", page(), 0)
    return out


def host_of(url: Column) -> Column:
    """From after the first `://` to `/`, `?`, `#` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """From the host's end to `?`, `#` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_fits(rule: str, host: Column, path: Column) -> Column:
    name, _, prefix = rule.partition("/")
    return ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(f"/{prefix}"))


def grams(host: str, path: str) -> np.ndarray:
    """Distinct numbers of the n-grams; the ends of host and path count as letters."""
    found = set()
    for kind, text in (("h", f"^{host}$"), ("p", f"^{path}$")):
        if len(text) > 2:
            for n in SIZES:
                found.update(zlib.crc32(f"{kind}{text[i : i + n]}".encode("utf-8", "surrogatepass")) % BUCKETS for i in range(len(text) - n + 1))
    return np.array(sorted(found), np.int64)


def split_url(url: str) -> tuple[str, str]:
    """host_of and path_of for the labelled table."""
    rest = url.partition("://")[2].partition("?")[0].partition("#")[0]
    host, slash, path = rest.partition("/")
    return host.lower(), slash + path


def _fit(found: list[np.ndarray], y: np.ndarray, steps: int, penalty: float) -> np.ndarray:
    """Weights of the logistic regression by accelerated gradient steps; each URL's grams are scaled to length 1, so the curvature
    is at most a quarter. The bias is PRIOR and isn't fitted."""
    row, column = np.repeat(np.arange(len(found)), [len(x) for x in found]), np.concatenate(found)
    size = 1 / np.sqrt(np.maximum(1, [len(x) for x in found]))
    w, ahead, t = np.zeros(BUCKETS), np.zeros(BUCKETS), 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(np.bincount(row, ahead[column], len(found)) * size + PRIOR)))
        slope = np.bincount(column, ((p - y) * size)[row], BUCKETS) / len(y) + penalty * ahead
        new = ahead - slope / (0.25 + penalty)
        after = (1 + (1 + 4 * t * t) ** 0.5) / 2
        ahead, w, t = new + (t - 1) / after * (new - w), new, after
    return w


def probability(w: np.ndarray, has: np.ndarray) -> float:
    return 0.0 if not len(has) else float(1 / (1 + np.exp(-(PRIOR + w[has].sum() / max(1, len(has)) ** 0.5))))


@functools.lru_cache(maxsize=4)
def train(seeds: tuple[tuple[str, int], ...], steps: int = 250, penalty: float = 3e-6, folds: int = 3, most_wrong: float = 0.005) -> tuple[np.ndarray, float]:
    """Weights and threshold. The table must be small: it is held whole. Folds are by host, so that a host's URLs are never
    on both sides."""
    split = [split_url(url) for url, _ in seeds]
    found, y = [grams(*x) for x in split], np.array([v for _, v in seeds], np.float64)
    fold = np.array([zlib.crc32(host.encode("utf-8", "surrogatepass")) % folds for host, _ in split])
    out_of = np.full(len(seeds), 0.5)
    for k in range(folds):
        if 0 < (fold == k).sum() < len(seeds):
            w = _fit([x for x, f in zip(found, fold, strict=True) if f != k], y[fold != k], steps, penalty)
            out_of[fold == k] = [probability(w, x) for x, f in zip(found, fold, strict=True) if f == k]
    good = np.sort(out_of[y == 0])[::-1]
    threshold = max(0.55, float(good[int(most_wrong * len(good))]) + 1e-9) if len(good) else 0.55
    return _fit(found, y, steps, penalty), threshold


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]] | None = None, seeds: list[tuple[str, int]] | None = None, threshold: float | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict (allow or block) and spam, the model's probability; a row for each of pages."""
    rules = PAGE_RULES if rules is None else rules
    w, held_out = train(tuple(labelled_urls() if seeds is None else seeds))
    threshold = held_out if threshold is None else threshold
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, ruled = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, verdict in sorted(rules, key=lambda r: len(r[0])):  # the longest is asked first
        fits = rule_fits(text, F.col("host"), F.col("path"))
        rule, ruled = F.when(fits, text).otherwise(rule), F.when(fits, verdict).otherwise(ruled)

    def score(batches):
        for batch in batches:
            spam = [probability(w, grams(host, path)) for host, path in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(spam, pa.float64())], names=[*batch.schema.names, "spam"])

    kind = pages.schema["page_id"].dataType.simpleString()
    scored = parts.mapInArrow(score, f"page_id {kind}, host string, path string, spam double")
    verdict = F.coalesce(ruled, F.when(F.col("spam") >= threshold, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), "spam")
