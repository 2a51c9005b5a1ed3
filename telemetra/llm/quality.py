"""Quality rules as weak supervision, in DataFrame functions only.

Each rule votes good, bad or abstains on a document. Expectation-maximisation over the counts of vote
patterns estimates, for every rule, how often its vote is right on good and on bad documents, and the share
of good documents; a document's verdict is its posterior probability of being good, so one failed rule does
not decide by itself. There are at most 3**rules patterns, whatever the number of documents.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .tables import stored

BLANK = r"[\x20\x09-\x0D]"
#: (rule, measure, bad when the measure is above, good when it is at most); between the two it abstains.
RULES = [
    ("symbols", "n_symbols / n_words", 0.25, 0.05),
    ("symbol_chars", "n_symbols / word_chars", 0.08, 0.02),
    ("other_chars", "1 - n_letters / word_chars", 0.25, 0.15),
    ("dup_lines", "n_dup_lines / n_lines", 0.3, 0.05),
    ("repeats", "n_repeat_words / n_words", 0.4, 0.15),
    ("capitals", "n_capitals / word_chars", 0.5, 0.2),
    ("bangs", "n_bangs / n_words", 0.3, 0.05),
    ("long_words", "word_chars / n_words", 16.0, 11.0),
    ("short_words", "-word_chars / n_words", -2.0, -3.0),
]
FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_bangs", "n_letters"]


def _window_words(w: str = "__w") -> tuple[Column, Column]:
    n = F.size(w)
    hashes = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(
        F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))).otherwise(F.array().cast("array<bigint>"))
    return n, hashes


def measure(docs: DataFrame, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """The measures of each row of ``docs``, with the columns ``keep`` in a struct ``__row`` (so that no name
    can clash), stored once: the fit and the verdict both read them.

    Null text has no words, all counts 0. Repeated rows are measured alike; an empty table stays empty.
    ``n_repeat_words`` counts the words that lie in a three-word window found at least twice in the text:
    windows are sorted by their hash, those with an equal neighbour are marked, and the marked positions
    are measured as overlapping runs. Work per text is n log n, with no shuffle.
    """
    return stored(_features(docs, keep or [], text), "quality-measures")


def _features(docs: DataFrame, keep: list[str], text: str) -> DataFrame:
    """The plan behind ``measure``. A filter pushed below its steps would repeat them for every reference, so it is stored
    before anything is asked of it.
    """
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep] or [F.lit(None).alias("none")]).alias("__row"),
                       F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("__t"))
    a = base.withColumn("__p", F.split("__t", BLANK))
    b = (a.withColumn("__w", F.filter("__p", lambda x: x != ""))
         .withColumn("__l", F.filter(F.split("__t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))))
    n, hashes = _window_words()
    c = b.select("__row", n.cast("long").alias("n_words"),
                 (F.length("__t") - (F.size("__p") - 1)).cast("long").alias("word_chars"),
                 F.regexp_count("__t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
                 (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
                 F.size("__l").cast("long").alias("n_lines"),
                 F.regexp_count("__t", F.lit(r"\p{Lu}")).cast("long").alias("n_capitals"),
                 F.regexp_count("__t", F.lit("!")).cast("long").alias("n_bangs"),
                 F.regexp_count("__t", F.lit(r"\p{L}")).cast("long").alias("n_letters"),
                 hashes.alias("__h"))
    rest = [x for x in c.columns if x != "__h"]
    # only texts that repeat a window pay for the sort
    d = c.select(*rest, F.when(F.size(F.array_distinct("__h")) < F.size("__h"), F.sort_array(F.transform(
        "__h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))).alias("__s"))
    e = d.select(*rest, F.sort_array(F.transform(F.filter("__s", lambda x, i: (
        F.get("__s", i + 1)["h"] == x["h"]) | (F.get("__s", i - 1)["h"] == x["h"])), lambda x: x["i"])).alias("__at"))
    runs = F.aggregate(F.transform("__at", lambda x, i: F.least(F.lit(3), F.coalesce(F.get("__at", i + 1) - x, F.lit(3)))),
                       F.lit(0), lambda s, x: s + x)
    return e.select(*rest, F.coalesce(runs, F.lit(0)).cast("long").alias("n_repeat_words"))


def votes() -> list[Column]:
    """The vote of each rule: 0 abstain, 1 good, 2 bad. A measure without a value (no words) abstains."""
    out = []
    for _, measure, bad, good in RULES:
        for total in ("n_words", "n_lines", "word_chars"):
            measure = measure.replace(f"/ {total}", f"/ nullif({total}, 0)")
        m = F.expr(measure)
        out.append(F.when(m > bad, 2).when(m <= good, 1).otherwise(0))
    return out


@dataclass
class Model:
    prior: float               # share of good documents
    good_if_good: list[float]  # by rule: P(votes good | document good, rule votes)
    good_if_bad: list[float]   # by rule: P(votes good | document bad, rule votes)

    def posterior(self, vote: list[Column]) -> Column:
        """The probability that a document with these votes is good."""
        z = F.lit(math.log(self.prior / (1 - self.prior)))
        for v, g, b in zip(vote, self.good_if_good, self.good_if_bad):
            z = z + F.when(v == 1, math.log(g / b)).when(v == 2, math.log((1 - g) / (1 - b))).otherwise(0.0)
        return 1 / (1 + F.exp(-z))


def fit(measured: DataFrame, steps: int = 30) -> Model:
    """Expectation-maximisation over all documents that pass the base checks, by vote pattern.

    The first step counts the patterns (at most 3**9 rows); each further step is one small aggregate over that
    table. Counts are smoothed by one vote of either kind, so no estimate reaches 0 or 1. An empty table
    leaves the starting values.
    """
    model = Model(0.8, [0.98] * len(RULES), [0.7] * len(RULES))
    names = [f"v{k}" for k in range(len(RULES))]
    voted = measured.where(~base_failed()).select(*[v.alias(n) for v, n in zip(votes(), names)])
    counts = stored(voted.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).coalesce(1), "vote-patterns")
    vote = [F.col(n) for n in names]
    for _ in range(steps):
        p = counts.withColumn("g", F.col("n") * model.posterior(vote)).withColumn("b", F.col("n") - F.col("g"))
        sums = [F.sum("g").alias("g"), F.sum("n").alias("n")]
        for k, v in enumerate(vote):
            sums += [F.sum(F.when(v == x, F.col(c))).alias(f"{c}{x}_{k}") for c in "gb" for x in (1, 2)]
        r = {k: float(x or 0) for k, x in p.agg(*sums).first().asDict().items()}
        if not r["n"]:
            break
        share = lambda c, k: (r[f"{c}1_{k}"] + 1) / (r[f"{c}1_{k}"] + r[f"{c}2_{k}"] + 2)
        # a rule's good vote may not speak against a document, nor its bad vote for it
        good = [share("g", k) for k in range(len(RULES))]
        bad = [min(share("b", k), good[k]) for k in range(len(RULES))]
        now = Model((r["g"] + 1) / (r["n"] + 2), good, bad)
        moved = abs(now.prior - model.prior) + max(abs(x - y) for x, y in zip(now.good_if_bad, model.good_if_bad))
        model = now
        if moved < 1e-6:
            break
    return model


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judge(measured: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """``measured`` with base_failed, quality (the posterior probability) and kept: not base_failed and
    quality of at least ``threshold``."""
    return (measured.withColumn("quality", model.posterior(votes()))
            .withColumn("base_failed", base_failed())
            .withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold)))
