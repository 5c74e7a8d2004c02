"""Quality rules as weak supervision: rules vote or abstain, expectation-maximisation weighs them (operator 9).

Each rule looks at counts of one text and votes 1 (bad), -1 (good) or 0 (abstains). Votes are modelled as independent
given the hidden quality, each rule with its own rates of bad votes on good and on bad documents. EM runs over the
table of distinct vote patterns (at most 3^8 rows, whatever the input); the posterior
probability of good quality then decides instead of an all-must-pass filter.

Defined cases: null text counts as empty; texts without words have zero counts and fail the base rule; repeated rows
are judged each on its own; an empty table gives an empty result; extra columns are kept unless `columns` is left out
of the output; null doc_id is carried along.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, whole_text, words_of

RULES = ("length", "symbols", "punctuation", "shouting", "exclamations", "repeated_lines", "repeated_words", "distinct_words")
#: (rate of bad votes on good documents, on bad documents) that EM starts from.
START = (0.02, 0.4)
PRIOR_GOOD = 0.8
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÇÈÉÊÍÓÖÜÑ"
PUNCTUATION = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


def only(text: Column, characters: str) -> Column:
    """How many characters of text are among `characters`."""
    listed = "".join(f"\\x{{{ord(c):x}}}" for c in characters)
    return F.char_length(F.regexp_replace(text, f"[^{listed}]+", "")).cast("long")


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_upper, n_exclaim (native)."""
    body = F.col("__text")
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    df = docs.withColumn("__text", whole_text(docs, text)).withColumn("__words", words_of(body))
    words = F.col("__words")
    df = df.withColumn("n_words", F.size(words).cast("long"))
    lines = F.filter(F.split(body, "\n"), lambda x: F.btrim(x, F.lit(" \t\x0b\x0c\r")) != "")
    df = df.select(
        "*",
        F.char_length(F.array_join(words, "")).cast("long").alias("word_chars"),
        only(body, SYMBOLS).alias("n_symbols"),
        only(body, "!").alias("n_exclaim"),
        only(body, UPPER).alias("n_upper"),
        only(body, PUNCTUATION).alias("n_punctuation"),
        F.size(F.array_distinct(words)).cast("long").alias("n_distinct"),
        lines.alias("__lines"),
        # A hash of each window of three words.
        F.when(
            F.col("n_words") >= 3,
            F.transform(F.slice(words, F.lit(1), (F.col("n_words") - 2).cast("int")),
                        lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))),
        ).otherwise(F.array().cast("array<bigint>")).alias("__hashes"),
    )
    # Where some window is found twice: (hash, place), equal ones next to each other.
    df = df.withColumn("__grams", F.when(
        F.size("__hashes") > F.size(F.array_distinct("__hashes")),
        F.sort_array(F.transform("__hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
    ).otherwise(none))
    grams = F.col("__grams")
    df = df.select(
        "*",
        F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.sort_array(F.transform(
            F.filter(grams, lambda g, i: F.coalesce(F.get(grams, i - 1)["h"] == g["h"], F.lit(False))
                     | F.coalesce(F.get(grams, i + 1)["h"] == g["h"], F.lit(False))),
            lambda g: g["i"],
        )).alias("__places"),
    )
    places = F.col("__places")
    covered = F.transform(places, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(places, i + 1) - x, F.lit(3))))
    df = df.withColumn("n_repeat_words", F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x))
    return df.drop("__text", "__words", "__lines", "__hashes", "__grams", "__places")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def votes() -> dict[str, Column]:
    """Each rule's vote from the counts: 1 bad, -1 good, 0 abstains."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    chars = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")

    def vote(bad: Column, good: Column) -> Column:
        return F.when(bad, 1).when(good, -1).otherwise(0).cast("tinyint")

    share = {
        "symbols": F.col("n_symbols") / n, "punctuation": F.col("n_punctuation") / chars, "shouting": F.col("n_upper") / chars,
        "exclamations": F.col("n_exclaim") / n, "repeated_lines": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeated_words": F.col("n_repeat_words") / n, "distinct_words": F.col("n_distinct") / n,
    }
    enough = F.col("n_words").between(50, 5000)
    return {
        "length": vote(F.col("n_words") < 20, F.col("n_words") >= 80),
        "symbols": vote(share["symbols"] > 0.15, share["symbols"] <= 0.05),
        "punctuation": vote(share["punctuation"] > 0.12, share["punctuation"] <= 0.08),
        "shouting": vote(share["shouting"] > 0.25, share["shouting"] <= 0.1),
        "exclamations": vote(share["exclamations"] > 0.3, share["exclamations"] <= 0.1),
        "repeated_lines": vote((share["repeated_lines"] > 0.35) & (F.col("n_lines") > 2), F.col("n_dup_lines") <= 1),
        "repeated_words": vote(share["repeated_words"] > 0.35, share["repeated_words"] <= 0.15),
        "distinct_words": vote(enough & (share["distinct_words"] < 0.3), enough & (share["distinct_words"] >= 0.45)),
    }


def posterior_good(rates: dict[str, tuple[float, float]], prior: float) -> Column:
    """Probability of good quality from the vote columns v_<rule>; abstentions say nothing."""
    odds = F.lit(math.log(prior / (1 - prior)))
    for rule, (on_good, on_bad) in rates.items():
        odds = odds + F.when(F.col(f"v_{rule}") == 1, math.log(on_good / on_bad)).when(
            F.col(f"v_{rule}") == -1, math.log((1 - on_good) / (1 - on_bad))).otherwise(0.0)
    return 1 / (1 + F.exp(-odds))


def fit(patterns: DataFrame, rounds: int = 100, tolerance: float = 1e-6) -> tuple[dict[str, tuple[float, float]], float]:
    """EM over the vote patterns (v_<rule>..., n): at most 3^8 rows, so they are summed up on the driver.

    Rates are smoothed by ten pseudo-documents and kept ordered (a bad vote is never evidence of good quality), so the
    two classes cannot swap. An empty table leaves the starting values.
    """
    rows = [([row[f"v_{r}"] for r in RULES], row["n"]) for row in patterns.collect()]
    rates, prior = {r: START for r in RULES}, PRIOR_GOOD
    for _ in range(rounds if rows else 0):
        sums, all_good, total = {r: [0.0] * 4 for r in RULES}, 0.0, 0.0
        for pattern, n in rows:
            odds = math.log(prior / (1 - prior))
            for r, v in zip(RULES, pattern):
                on_good, on_bad = rates[r]
                odds += math.log(on_good / on_bad) if v == 1 else math.log((1 - on_good) / (1 - on_bad)) if v == -1 else 0.0
            good = 1 / (1 + math.exp(min(-odds, 700)))
            all_good, total = all_good + n * good, total + n
            for r, v in zip(RULES, pattern):
                if v:
                    s = sums[r]
                    s[0], s[1] = s[0] + n * good, s[1] + n * (1 - good)
                    if v == 1:
                        s[2], s[3] = s[2] + n * good, s[3] + n * (1 - good)
        new = {}
        for r, (good, bad, good_1, bad_1) in sums.items():
            on_good = min(max((good_1 + 10 * START[0]) / (good + 10), 0.0005), 0.5)
            new[r] = (on_good, min(max((bad_1 + 10 * START[1]) / (bad + 10), on_good, 0.001), 0.999))
        new_prior = min(max((all_good + 8) / (total + 10), 0.05), 0.99)
        moved = max([abs(new_prior - prior), *(abs(a - b) for r in RULES for a, b in zip(new[r], rates[r]))])
        rates, prior = new, new_prior
        if moved < tolerance:
            break
    return rates, prior


def voted(docs: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """`columns` of docs with the counts, base_failed and votes, written once."""
    own = docs.select(*[F.col(c).alias(f"__own_{i}") for i, c in enumerate(columns)], F.col(text).alias("__body"))
    counted = with_counts(own, "__body")
    out = counted.select(*[f"__own_{i}" for i in range(len(columns))], *COUNTS, base_failed().alias("base_failed"),
                         *[v.alias(f"v_{r}") for r, v in votes().items()])
    return materialize(out, "quality-votes")


def posterior(votes_table: DataFrame) -> Column:
    patterns = votes_table.groupBy(*[f"v_{r}" for r in RULES]).agg(F.count(F.lit(1)).alias("n"))
    return posterior_good(*fit(patterns))


def judge(docs: DataFrame, text: str = "text", threshold: float = 0.5, columns: list[str] | None = None) -> DataFrame:
    """`columns` of docs (all but the text if None; those named like a result are left out) with counts, votes, quality and kept."""
    made = {*COUNTS, "base_failed", "quality", "kept", *[f"v_{r}" for r in RULES]}
    columns = [c for c in (docs.columns if columns is None else columns) if c != text and c not in made]
    table = voted(docs, text, columns)
    kept = table.withColumn("quality", posterior(table)).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))
    return kept.withColumnsRenamed({f"__own_{i}": c for i, c in enumerate(columns)})


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"), columns=["doc_id"])


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, each row once, with its own columns.

    Votes are computed twice, once to weigh the rules and once to filter, so that no copy of the texts is written. The row
    number keeps the filter above the projection of the votes; below it, every use of a vote would compute it anew.
    """
    own = docs.select(*[F.col(c).alias(f"__own_{i}") for i, c in enumerate(docs.columns)], F.col("text").alias("__body"))
    judged = with_counts(own, "__body").select(*[f"__own_{i}" for i in range(len(docs.columns))], base_failed().alias("__failed"),
                                               *[v.alias(f"v_{r}") for r, v in votes().items()], F.monotonically_increasing_id().alias("__row"))
    kept = judged.filter((F.col("__row") >= 0) & ~F.col("__failed") & (posterior(judged) >= 0.5))
    return kept.select(*[F.col(f"__own_{i}").alias(c) for i, c in enumerate(docs.columns)])
