"""URL filters: rules by host and path, and logistic regression on hashed character n-grams for the rest."""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import fresh, ship

#: Hashed n-grams fall in so many features.
FEATURES = 1 << 15
SIZES = (3, 4, 5)
#: From this probability on a url is blocked: on words left out of the training, 3 in 100 wanted urls are.
SURE = 0.6
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A general vocabulary, of subjects that a filter of web pages usually keeps out, and of usual ones.
UNWANTED = (
    "casino", "poker", "roulette", "blackjack", "jackpot", "slots", "betting", "bets", "gambling", "lottery", "bingo", "wager",
    "viagra", "cialis", "pills", "pharma", "steroids", "slimming", "adult", "porn", "xxx", "sexcam", "escort", "webcam", "hookup",
    "spam", "spamlink", "phishing", "malware", "spyware", "warez", "keygen", "cracked", "torrent", "pirated", "clickbait", "popunder", "popup", "banner",
    "ads", "adserver", "tracker", "tracking", "affiliate", "payday", "loans", "quickcash", "forex", "replica", "counterfeit", "linkfarm", "doorway",
)
WANTED = (
    "news", "library", "docs", "museum", "university", "weather", "garden", "history", "science", "recipes", "city", "school", "music", "travel",
    "health", "wiki", "forum", "sports", "station", "theatre", "nation", "other", "thread", "method", "northern", "earth", "month", "section",
    "gazette", "tribune", "herald", "journal", "research", "institute", "college", "council", "government", "parliament", "justice", "hospital",
    "clinic", "nursing", "cooking", "baking", "kitchen", "gardening", "farming", "weaving", "hiking", "sailing", "cycling", "painting", "printing",
    "reading", "writing", "learning", "teaching", "lessons", "grammar", "dictionary", "literature", "poetry", "archive", "heritage", "village",
    "mountain", "river", "forest", "ocean", "island", "coast", "harbour", "railway", "bridge", "engine", "software", "developer", "python", "compiler",
    "database", "network", "physics", "chemistry", "biology", "geology", "astronomy", "mathematics", "statistics", "economy", "energy", "transport",
    "housing", "children", "parents", "family", "animals", "horses", "birds", "insects", "flowers", "leather", "letters", "together",
)
#: Words put beside a subject, whatever the label; and paths that speak for a label, or for none.
BESIDE = ("online", "best", "my", "top", "daily", "live")
PATHS = (
    ("articles/2021", "about", "guide/index.html", "wiki/page", "lesson-3", "archive/issue-12"),
    ("bonus", "signup-now", "promo/deal", "click", "out/redirect", "buy-now"),
)
NEUTRAL = ("", "en/", "fr/", "de/", "es/", "item/")


def labelled_urls(skip: frozenset[str] = frozenset()) -> list[tuple[str, int]]:
    """A small table of (url, unwanted), made by rule: each subject alone and beside another word, under several ends.

    Half of the paths speak for the label, the others are numbers under
    headings that both labels have. Subjects in ``skip`` are left out.
    """
    out = []
    ends = ("example.com", "example.net", "example.org", "site.org", "web.com", "page.info")
    for label, words in ((1, UNWANTED), (0, WANTED)):
        for i, word in enumerate(w for w in words if w not in skip):
            for j, front in enumerate(("", "www.", "m.", "blog.", "shop.", "")):
                beside = BESIDE[(i + j) % len(BESIDE)]
                host = (word, word, f"{word}-{beside}", f"{beside}-{word}", f"{word}{beside}", word)[j]
                path = PATHS[label][(i + j) % 6] if j % 2 else f"{NEUTRAL[(i + j) % 6]}{i * 37 + j}"
                out.append((f"https://{front}{host}.{ends[(i + 2 * j) % 6]}/{path}", label))
    return out


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty where there is no ``://`` or no url."""
    host = F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def features(host: str, path: str) -> np.ndarray:
    """Hashed n-grams of host and path, each once; the two are told apart."""
    seen = set()
    for mark, value in (("h", f"^{host}$"), ("p", f"^{path}$")):
        raw = value.encode()
        for n in SIZES:
            for i in range(len(raw) - n + 1):
                seen.add(crc32(mark.encode() + raw[i : i + n]) % FEATURES)
    return np.fromiter(seen, np.int64, len(seen))


def train(rows: list[tuple[str, int]], *, steps: int = 1000, rate: float = 0.5, decay: float = 1e-3) -> np.ndarray:
    """Weights, the bias last, by gradient descent on the logistic loss; both labels weigh the same in all."""
    found = [features(*split(url)) for url, _ in rows]
    label = np.array([y for _, y in rows], np.float64)
    sizes = np.array([max(1, len(f)) for f in found])
    column, row = np.concatenate(found), np.repeat(np.arange(len(rows)), [len(f) for f in found])
    scale = 1 / np.sqrt(sizes)
    share = np.where(label == 1, 0.5 / max(1.0, label.sum()), 0.5 / max(1.0, (1 - label).sum()))
    w, bias = np.zeros(FEATURES), 0.0
    for _ in range(steps):
        score = np.bincount(row, w[column], len(rows)) * scale + bias
        off = (1 / (1 + np.exp(-score)) - label) * share
        w -= rate * 20 * (np.bincount(column, (off * scale)[row], FEATURES) + decay * w / len(rows))
        bias -= rate * off.sum()
    return np.append(w, bias)


def split(url: str | None) -> tuple[str, str]:
    """What :func:`parts` gives, in Python."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    rest = rest[: min((i for i in (rest.find("?"), rest.find("#")) if i >= 0), default=len(rest))]
    at = rest.find("/")
    host, path = (rest, "") if at < 0 else (rest[:at], rest[at:])
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def unwanted(weights: np.ndarray, host: str, path: str) -> float:
    """The probability that a url is unwanted; 0 where it has no host."""
    if not host:
        return 0.0
    f = features(host, path)
    return float(1 / (1 + np.exp(-(weights[f].sum() / np.sqrt(max(1, len(f))) + weights[-1]))))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule (verdict, ``host/path``) that fits, and its verdict; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, value in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        own, _, start = value.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith("/" + start)
        rule, verdict = F.when(fits, value).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def judge(pages: DataFrame, *, url: str = "url", rules: list[tuple[str, str]] = (), labelled: list[tuple[str, int]] | None = None, threshold: float = SURE, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all) of each row with ``host``, ``path``, ``rule``, ``score`` and ``verdict``.

    A rule's verdict stands; other urls are judged by logistic regression,
    trained by the driver from the small table ``labelled``. A null url or one
    without ``://`` has an empty host and path and is allowed with score 0.
    Columns of the added names are replaced, in any case of their letters;
    repeated rows are each judged; very long urls are judged whole; an empty
    table gives an empty one.
    """
    ship(pages.sparkSession)
    names = ["host", "path", "rule", "score", "verdict"]
    kept = [c for c in (keep or pages.columns) if c.lower() not in names]
    weights = train(labelled or labelled_urls())
    host, path = parts(F.col(f"`{url}`"))
    source = pages.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(kept)], host.alias("host"), path.alias("path"))
    score = fresh(source, "score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([round(unwanted(weights, *p), 6) for p in pairs], pa.float64())], [*batch.schema.names, score])

    scored = source.mapInArrow(run, StructType(list(source.schema.fields)).add(score, "double"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), list(rules))
    by_method = F.when(F.col(score) >= threshold, "block").otherwise("allow")
    out = scored.select(*[f"k{i}" for i in range(len(kept))], "host", "path", rule.alias("rule"), score, F.coalesce(verdict, by_method).alias("verdict"))
    return out.toDF(*kept, *names)
