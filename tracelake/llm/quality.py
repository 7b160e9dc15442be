"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Word counts, symbol counts and repeats come from each whole text.  Cutoffs are used in a stratum (language) only if
the exact binomial bound on a labelled holdout certifies them.  A setting is one cutoff or none for each rule, and
what counts is the union of the rules: with k of n good documents rejected by the setting, P(Binomial(n, risk) <= k)
must not exceed the setting's part of delta.  Settings lie on paths fixed beforehand: path p tightens rule p from its
loosest cutoff to its strictest, then rule p + 1, and so on round.  Along a path the settings are nested, so they are
tested as a fixed sequence, each at the path's full part, up to the first that fails; paths and strata share delta by
Bonferroni.  So with probability 1 - delta no certified setting of any stratum rejects more than `risk` of its good
documents, and any of them may be chosen: the one that rejects most labelled bad documents, then fewest good ones,
then lies nearest the start of its path, so that no rule is tightened for nothing; then the first path.  Where none rejects a bad document, none is used.

Defined results: null text counts as empty; an empty text has zero words and fails the base rule.  Labels that
contradict each other count as good.  Null quality is no label.  Languages beyond the listed strata, and null, share
the stratum "other".  Repeated rows are judged alike; an empty table gives no rows; without labels nothing is certified.
"""

from __future__ import annotations

from math import log, pi

from pyspark.sql import Column, DataFrame, Window, functions as F

from tracelake.sources.shared import cut

SPACE = r"[\x20\x09-\x0D]+"
STRATA = ("en", "de", "fr", "es")
#: Share of good documents of a stratum that all rules together may reject, and the chance of breaking that anywhere.
RISK, DELTA = 0.05, 0.05
#: (name, share that is large in bad documents); each is rejected beyond the cutoff of the chosen setting.
RULES = {
    "symbols": "n_symbols / greatest(word_chars, 1)",
    "marks": "n_marks / greatest(word_chars, 1)",
    "capitals": "n_capitals / greatest(word_chars, 1)",
    "repeats": "n_repeat_words / greatest(n_words, 1)",
    "lines": "n_dup_lines / greatest(n_lines, 1)",
}
CUTOFFS = (0.02, 0.04, 0.06, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5)


def counts(text: Column) -> Column:
    """All counts of one text as a struct of longs."""

    def of(t: Column) -> Column:
        words = F.filter(F.split(t, SPACE), lambda w: w != "")
        lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        return _let(words, lambda w: _let(lines, lambda ln: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
            (F.size(ln) - F.size(F.array_distinct(ln))).cast("long").alias("n_dup_lines"),
            repeat_words(w).cast("long").alias("n_repeat_words"),
            F.size(ln).cast("long").alias("n_lines"),
            F.regexp_count(t, F.lit(r"[!?]")).cast("long").alias("n_marks"),
            F.length(F.regexp_replace(t, r"\P{Lu}+", "")).cast("long").alias("n_capitals"),
        )))

    return _let(F.coalesce(text, F.lit("")), of)


def _let(value: Column, of) -> Column:
    """of(value), with value computed once a row."""
    return F.transform(F.array(value), of)[0]


def repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more: windows are sorted by hash, equal neighbours give the
    window starts, and each start covers three words or as many as lie before the next start."""
    n = F.size(words)
    windows = F.sort_array(F.transform(
        F.when(n >= 3, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")),
    ))

    def starts(s: Column) -> Column:
        twice = F.filter(F.transform(s, lambda x, j: F.when(F.coalesce(F.get(s, j - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False)), x["i"])), lambda i: i.isNotNull())
        return F.sort_array(twice)

    return _let(windows, lambda s: _let(starts(s), lambda p: F.aggregate(
        F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x)))


def failed() -> Column:
    return F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")


def stratum(lang: Column, strata=STRATA) -> Column:
    return F.when(lang.isin(*strata), lang).otherwise("other")


def log_factorial(m: Column) -> Column:
    """ln(m!): exact up to 20, then by Stirling's series, whose first term left out is below 1e-12 there."""
    x = m.cast("double")
    series = (x + 0.5) * F.log(x) - x + F.lit(0.5 * log(2 * pi)) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, F.lit(5.0)))
    return F.when(m <= 20, F.log(F.factorial(F.least(m, F.lit(20)).cast("int")).cast("double"))).otherwise(series)


def at_most(n: Column, k: Column, p: float) -> Column:
    """P(Binomial(n, p) <= k), summed from the k-th term down; only right (and only used) where k < n * p.

    Terms fall faster than those of a normal tail, so 40 standard deviations below k they are below a double's last
    place; the sum stops there, and one row holds at most 40 * sqrt(n * p) + 40 terms."""
    top = log_factorial(n) - log_factorial(k) - log_factorial(n - k) + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1 - p))
    last = F.greatest(F.lit(1).cast("long"), k - F.ceil(40 * F.sqrt(n * F.lit(p))) - 40)
    down = F.aggregate(
        F.when(k > 0, F.sequence(k, last, F.lit(-1).cast("long"))).otherwise(F.array().cast("array<bigint>")),
        F.struct(F.lit(1.0).alias("sum"), F.lit(1.0).alias("term")),
        lambda a, i: F.struct(
            (a["sum"] + a["term"] * i / (n - i + 1) * F.lit((1 - p) / p)).alias("sum"),
            (a["term"] * i / (n - i + 1) * F.lit((1 - p) / p)).alias("term"),
        ),
    )["sum"]
    return F.exp(top) * down


def part(delta: float = DELTA, strata=STRATA) -> float:
    """What each path of each stratum may spend of delta."""
    return delta / ((len(strata) + 1) * len(RULES))


def _turn(path: int, rule: int) -> int:
    """How many settings of the path come before those that tighten the rule."""
    return (rule - path) % len(RULES) * len(CUTOFFS)


def rejected_at(path: int) -> Column:
    """The first setting of the path that rejects a row; null if none does."""
    def step(r: str) -> Column:
        return sum((F.col(r) <= c).cast("int") for c in CUTOFFS)

    return F.least(*[F.when(F.col(r) > min(CUTOFFS), F.lit(_turn(path, i)) + step(r)) for i, r in enumerate(RULES)])


def thresholds(features: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA, strata=STRATA) -> DataFrame:
    """One row for each stratum with a chosen setting: its name and the cutoff of each rule (null: none).

    features: (doc_id, stratum, shares by rule name, base_failed); labels: (doc_id, quality).  At most one row for
    each listed stratum and one for "other", whatever the input."""
    verdicts = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg((F.max("quality") == 1).alias("good"))
    held = features.where("not base_failed").join(verdicts, "doc_id")
    paths = F.array(*[F.struct(F.lit(p).alias("path"), rejected_at(p).alias("step")) for p in range(len(RULES))])
    counted = held.select("stratum", "good", F.inline(paths)).groupBy("stratum", "path", "step").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    # at most one row for each step of each path of each stratum from here on
    whole = Window.partitionBy("stratum", "path")
    so_far = whole.orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    never = F.col("step").isNull()
    settings = counted.select(
        "stratum", "path", "step", F.sum("good").over(whole).alias("n"),
        F.sum(F.when(never, 0).otherwise(F.col("good"))).over(so_far).alias("k"), F.sum(F.when(never, 0).otherwise(F.col("bad"))).over(so_far).alias("bad"),
    ).where(~never)
    sure = settings.where(F.col("k") < F.col("n") * risk).where(at_most(F.col("n"), F.col("k"), risk) <= part(delta, strata)).where("bad > 0")
    best = F.struct(F.col("bad"), -F.col("k"), -F.col("step"), -F.col("path"))
    chosen = sure.groupBy("stratum").agg(F.max_by(F.struct("path", "step"), best).alias("s")).select("stratum", "s.*")
    # a rule has its loosest cutoff from its turn on, and its strictest from the next rule's turn on
    loosest_first = F.array(*map(F.lit, sorted(CUTOFFS, reverse=True)))
    past = [F.col("step") - F.pmod(F.lit(i) - F.col("path"), F.lit(len(RULES))) * len(CUTOFFS) for i in range(len(RULES))]
    return chosen.select("stratum", *[F.when(x >= 0, F.get(loosest_first, F.least(x, F.lit(len(CUTOFFS) - 1)))).alias(f"cut_{r}") for r, x in zip(RULES, past)])


def features(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(doc_id, stratum, counts, shares by rule name, base_failed) of each row."""
    f = docs.select(F.col(id).alias("doc_id"), stratum(F.col(lang)).alias("stratum"), counts(F.col(text)).alias("c"))
    return told(f)


def told(rows: DataFrame) -> DataFrame:
    """rows with a struct c of counts as its columns, and the shares and base_failed beside them."""
    flat = rows.select("*", "c.*").drop("c")
    return flat.select("*", failed().alias("base_failed"), *[F.expr(e).alias(r) for r, e in RULES.items()])


def beyond() -> Column:
    """Whether a share is beyond a certified cutoff."""
    out = F.lit(False)
    for r in RULES:
        out = out | F.coalesce(F.col(r) > F.col(f"cut_{r}"), F.lit(False))
    return out


def judge(docs: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, stratum) of each row,
    and the cutoff of each rule that holds in its stratum."""
    f = cut(features(docs))
    t = thresholds(f, labels, risk, delta)
    judged = f.join(F.broadcast(t), "stratum", "left")  # thresholds() bounds its rows
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~beyond()).alias("kept"), "stratum",
        *[f"cut_{r}" for r in RULES],
    )


def keep_good(docs: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """The rows of docs that are kept, with their own columns."""
    rows = docs.select(F.struct("*").alias("row"), stratum(F.col("lang")).alias("stratum"), counts(F.col("text")).alias("c"))
    rows = cut(rows)  # counted once; what follows reads the counts
    t = thresholds(told(rows.select(F.col("row.doc_id").alias("doc_id"), "stratum", "c")), labels, risk, delta)
    judged = told(rows).join(F.broadcast(t), "stratum", "left")  # thresholds() bounds its rows
    return judged.where(~F.col("base_failed") & ~beyond()).select("row.*")
