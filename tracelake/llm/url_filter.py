"""URL filters: a small rule list, and a logistic regression on hashed character n-grams for all other URLs.

The model is fitted on a small labelled table, two lists of hosts and what a rule makes of their words; its cutoff keeps
to a stated rate of false blocks on labelled rows that it has not seen.  Below the cutoff a URL is allowed.

Defined results: of rules of equal length that fit, the last in code-point order decides, of the same rule twice the later one; a null URL or one without "://" has an empty host and path; it then falls to the model, like any
URL that no rule fits.  Repeated rows are judged alike, an empty table gives no rows, other columns are ignored.
Without labelled rows the model is all zero and allows everything.
"""

from __future__ import annotations

import random
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Fixed values: (verdict, rule); a rule is a host, followed by the start of a path.
RULES = [
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
]

# The labelled URL table, host and path; what to block and what to allow.
BLOCKED = """
best-casino-bonus.example /play/slots  lucky-casino.example /bonus/free-spins  online-poker-win.example /poker/bonus  slots-jackpot.example /casino/play
bet-now.example /betting/odds  sports-betting.example /bet/live  free-spins-casino.example /slots/win  royal-poker.example /casino/jackpot
casino777.example /bonus/slots  jackpot-win.example /play/casino  betting-odds.example /sports/bet  poker-bonus.example /win/free
cheap-pills.example /buy/viagra  pills-online.example /order/cialis  buy-viagra.example /cheap/pills  pharmacy-discount.example /pills/order
cheap-cialis.example /buy/online  online-pharmacy.example /viagra/discount  pills-discount.example /buy/cheap  order-pills.example /pharmacy/cheap
xxx-videos.example /porn/free  free-porn.example /xxx/videos  sex-cams.example /live/girls  porn-tube.example /videos/xxx
hot-girls.example /sex/live  adult-cams.example /xxx/live  live-sex.example /cams/adult  xxx-tube.example /free/porn
ads.tracker.example /click/banner  adserver.example /banner/click?  track-clicks.example /ads/pixel  banner-ads.example /adclick/track
popup-ads.example /click/redirect  adclick.example /track/banner  pixel-tracker.example /ads/click  doubleads.example /banner/popup
replica-watches.example /cheap/rolex  cheap-rolex.example /replica/buy  replica-bags.example /buy/cheap  fake-watches.example /replica/cheap
payday-loans.example /apply/fast-cash  fast-cash.example /loans/payday  quick-loans.example /cash/apply  easy-payday.example /fast/loans
spam-farm.example /spam/links  link-farm.example /farm/spam  mass-spam.example /links/farm
crack-download.example /warez/keygen  keygen-free.example /crack/serial  warez-serials.example /download/crack  free-warez.example /keygen/download
"""
ALLOWED = """
city-library.example /catalogue/books  state-university.example /research/papers  history-museum.example /exhibits/today  daily-news.example /world/article
science-journal.example /volume/article  public-school.example /lessons/maths  city-council.example /minutes/meeting  health-institute.example /guides/vaccines
open-encyclopedia.example /wiki/geology  news-herald.example /politics/article  national-archive.example /records/letters  cooking-recipes.example /soup/lentil
university-press.example /books/history  garden-club.example /plants/roses  weather-service.example /forecast/week  chess-club.example /openings/sicilian
python-docs.example /tutorial/classes  compiler-notes.example /docs/parser  linux-manual.example /pages/kernel  math-lectures.example /notes/algebra
bird-watching.example /species/robin  train-timetable.example /stations/lines  music-theory.example /lessons/harmony  language-course.example /grammar/verbs
law-review.example /articles/contract  economics-department.example /research/papers  physics-lab.example /papers/optics  art-gallery.example /exhibits/prints
museum-of-history.example /collection/letters  library-archive.example /books/records  evening-news.example /local/article  school-science.example /lessons/physics
research-institute.example /reports/climate  county-records.example /archive/minutes  poetry-journal.example /volume/poems  travel-guide.example /cities/museums
national-library.example /catalogue/archive  observatory.example /notes/stars  medical-journal.example /volume/papers  parliament.example /records/debates
astronomy-club.example /guides/planets  geology-department.example /lectures/rocks  village-school.example /news/term  book-reviews.example /history/article
botany-notes.example /plants/ferns  river-trust.example /reports/water  teachers-college.example /courses/grammar  film-archive.example /catalogue/records
"""

#: Weights of the model; n-grams are hashed to so many places.
DIMENSIONS = 1 << 14
#: Documented bound of the labelled URL table that the model is fitted on.
MAX_LABELLED = 4000
#: Of the URLs to allow, the share that the model may block, as measured on labelled rows that it wasn't fitted on.
FALSE_BLOCKS = 0.005

# Parts of the made hosts and paths, the same for both labels.
SUBDOMAINS, ENDS, LANGS = ("", "", "www.", "m.", "blog."), (".example.com", ".example.net", ".example.org"), ("en", "de", "fr", "es")
ONSETS = ("", "b", "c", "ch", "d", "f", "g", "h", "k", "l", "m", "n", "p", "pr", "r", "s", "sh", "st", "t", "th", "tr", "v", "w", "z")
CODAS = ("", "", "n", "nd", "ng", "nt", "r", "l", "s", "st", "t", "th", "m", "on", "er")


def host_path(url: Column) -> tuple[Column, Column]:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://(.*)\z", 1)
    host = F.translate(F.regexp_extract(rest, r"\A[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none fits."""
    rule = verdict = F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, start = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + start)
        rule = F.when(fits, text).otherwise(rule)
        verdict = F.when(fits, says).otherwise(verdict)
    return rule, verdict


def ngrams(hosts: list[str], paths: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Rows and hashed places of all character 2-, 3- and 4-grams, host and path told apart."""
    rows, places = [], []
    for kind, texts in enumerate((hosts, paths)):
        raw = [b"^" + t.encode() + b"$" for t in texts]
        data = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
        owner = np.repeat(np.arange(len(raw)), [len(r) for r in raw])
        for n in (2, 3, 4):
            if len(data) < n:
                continue
            h = np.full(len(data) - n + 1, 1469598103934665603 + 31 * n + 7 * kind, np.uint64)
            for i in range(n):
                h = (h ^ data[i : len(data) - n + 1 + i]) * np.uint64(1099511628211)
            inside = owner[: len(h)] == owner[n - 1 :]
            rows.append(owner[: len(h)][inside])
            places.append(((h ^ (h >> np.uint64(29))) % np.uint64(DIMENSIONS)).astype(np.int64)[inside])
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(rows), np.concatenate(places)


def fit(hosts: list[str], paths: list[str], labels: list[int], steps: int = 600, rate: float = 8.0, l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias by full-batch gradient descent with momentum; the same rows give the same model."""
    w, b = np.zeros(DIMENSIONS), 0.0
    if not labels or len(set(labels)) < 2:
        return w, b
    y = np.asarray(labels, float)
    rows, places = ngrams(hosts, paths)
    scale = (1 / np.sqrt(np.maximum(1, np.bincount(rows, minlength=len(y)))))[rows]
    vw, vb = np.zeros(DIMENSIONS), 0.0
    for _ in range(steps):
        z = np.bincount(rows, w[places] * scale, len(y)) + b
        g = (1 / (1 + np.exp(-z)) - y) / len(y)
        vw = 0.9 * vw - rate * 0.1 * (np.bincount(places, g[rows] * scale, DIMENSIONS) + l2 * w)
        vb = 0.9 * vb - rate * 0.1 * g.sum()
        w, b = w + vw, b + vb
    return w, b


def scores(w: np.ndarray, b: float, hosts: list[str], paths: list[str]) -> np.ndarray:
    rows, places = ngrams(hosts, paths)
    n = np.maximum(1, np.bincount(rows, minlength=len(hosts)))
    z = np.bincount(rows, w[places], len(hosts)) / np.sqrt(n) + b
    return 1 / (1 + np.exp(-z))


def score_udf(w: np.ndarray, b: float):
    small = w.astype(np.float32)

    @F.pandas_udf("double")
    def score(host: pd.Series, path: pd.Series) -> pd.Series:
        return pd.Series(scores(small, b, host.tolist(), path.tolist()))

    return score


def word_lists() -> tuple[list[str], list[str]]:
    """The words of the hosts of what is to block and to allow; words in both tell nothing and are left out."""
    bad, good = (set(re.findall("[a-z]{3,}", " ".join(t.split()[::2]).replace(".example", ""))) for t in (BLOCKED, ALLOWED))
    return sorted(bad - good), sorted(good - bad)


def labels(seed: int = 1, each: int = 500) -> list[tuple[str, str, int]]:
    """(host, path, label) of the labelled table; label 1 is block.  The two lists above, and hosts made of their words by rule:
    `each` of either label, and twice as many names that are no words, to allow, as most hosts are.  All have the same
    kinds of subdomains, ends and article paths, so that only the names tell; one path in four is one of the lists'."""
    out = [("", "", 0)]
    words, paths = word_lists(), []
    for text, label in ((BLOCKED, 1), (ALLOWED, 0)):
        parts = text.split()
        out += [(h.removesuffix(".example"), p, label) for h, p in zip(parts[::2], parts[1::2], strict=True)]
        paths.append(parts[1::2])
    r = random.Random(seed)

    def row(name: str, label: int) -> tuple[str, str, int]:
        article = f"/{r.choice(LANGS)}/{r.randrange(10_000)}{r.choice(('', '', '/', '.html'))}"
        return r.choice(SUBDOMAINS) + name + r.choice(ENDS), article if r.random() < 0.75 else r.choice(paths[1 - label]), label

    for label in (1, 0):
        for _ in range(each):
            x, y = r.sample(words[1 - label], 2)
            out.append(row(r.choice((f"{x}-{y}", f"{x}{y}", f"{x}-{y}-{r.randrange(100)}", f"{x}{r.randrange(100)}", x)), label))
    syllable = lambda: r.choice(ONSETS) + r.choice("aeiouy") + r.choice(CODAS)
    out += [row(r.choice(("", "", "", "the", "my")) + "".join(syllable() for _ in range(r.randint(2, 3))), 0) for _ in range(2 * each)]
    return out


def learned(rows: list[tuple[str, str, int]], rate: float = FALSE_BLOCKS) -> tuple[np.ndarray, float, float]:
    """Weights, bias and cutoff.  Two thirds of the rows are fitted on; the cutoff is the least one, from 0.5 on, above which at most `rate`
    of the rows to allow among the rest score.  With too few of these to tell, all rows are fitted on and it is 0.5."""
    held = [x for i, x in enumerate(rows) if i % 3 == 2]
    good = [(h, p) for h, p, x in held if x == 0]
    if len(good) * rate < 1:
        return *fit(*(list(c) for c in zip(*rows, strict=True)) if rows else ([], [], [])), 0.5
    w, b = fit(*(list(c) for c in zip(*[x for i, x in enumerate(rows) if i % 3 != 2], strict=True)))
    s = np.sort(scores(w, b, [h for h, _ in good], [p for _, p in good]))
    return w, b, max(0.5, float(s[len(s) - 1 - int(len(s) * rate)]))


def labelled_urls(pages: DataFrame, url: str = "url", rules: list[tuple[str, str]] = RULES, bound: int = MAX_LABELLED) -> DataFrame:
    """A labelled table for filter_urls() that follows the rules: of the distinct URLs that a rule decides, the `bound` least by
    hash; label 1 is block."""
    u = F.col(url)
    host, path = host_path(u)
    return (
        pages.select(u.alias("url"), host.alias("host"), path.alias("path"))
        .select("url", "host", "path", rule_of(F.col("host"), F.col("path"), rules)[1].alias("verdict"))
        .where("verdict is not null")
        .distinct()
        .orderBy(F.xxhash64("url"), "url")
        .limit(bound)
        .select("host", "path", (F.col("verdict") == "block").cast("int").alias("label"))
    )


def filter_urls(pages: DataFrame, labelled: DataFrame | None = None, rules: list[tuple[str, str]] = RULES, id: str = "page_id", url: str = "url", bound: int = MAX_LABELLED, rate: float = FALSE_BLOCKS) -> DataFrame:
    """(id, host, path, rule, verdict, score).  labelled: (host, path, label), cut to `bound` rows; without it, labels().
    What no rule decides is blocked where its score is above the cutoff of learned(), and allowed otherwise."""
    rows = [(r.host or "", r.path or "", r.label) for r in labelled.select("host", "path", "label").limit(bound).collect()] if labelled is not None else labels()
    w, b, cutoff = learned(rows, rate)
    host, path = host_path(F.col(url))
    judged = pages.select(F.col(id).alias(id), host.alias("host"), path.alias("path"))
    judged = judged.withColumn("score", score_udf(w, b)("host", "path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return judged.select(
        id, "host", "path", rule.alias("rule"),
        F.coalesce(verdict, F.when(F.col("score") > cutoff, "block").otherwise("allow")).alias("verdict"), "score",
    )
