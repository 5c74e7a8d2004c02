"""Mixing sources to target weights by iterative proportional fitting (operator 5).

Tokens are summed up by cell (source, language, topic). Raking multiplies the cells' sampling probabilities by factors until
the expected tokens meet the target of every margin in turn; a probability is the least of one and the product of its factors,
and the bound is part of every sum, so that what capped cells cannot give is asked of the other cells of the same category. By
default a margin's targets are its token shares to the power `temperature`, rescaled; a category without a target keeps its
token share. A category that has fewer tokens than its target gives all it has, and the rest is shared among the others of
its margin; margins() tells the wanted, the feasible and the reached share of every category. A document is taken if a hash of
its id falls below its cell's probability.

On Spark: a margin's totals are an aggregate of the cell table and its factors a join with it; the cell table is
pre-aggregated, so a source with a third of all rows is a few cells. A cell table of at most `MOST_CELLS` rows is raked in one
go on the driver instead, to the same rule. A raking that has not converged is reported by a warning.

Defined cases: null source or language is a category of its own; null or empty text has no tokens, weight and
probability of its cell (1 where the cell has no tokens); null doc_id is hashed as null; repeated rows share their fate;
an empty table gives an empty result; extra columns are not carried.
"""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_materialized, materialize, whole_text, words_of

MARGINS = ("source", "lang", "topic")
#: Cells that may be raked on the driver.
MOST_CELLS = 100_000
#: Bound of a factor, for categories that no probabilities of at most one can fill.
MOST_FACTOR = 1e12


def topic_of(text: Column, n_tokens: Column) -> Column:
    """A coarse topic by form: what the text mostly consists of."""
    marks = F.size(F.split(text, r"[#*$%&|<>]")) - 1
    return (F.when(n_tokens < 50, "fragment").when(marks * 5 > n_tokens, "markup").when(n_tokens >= 800, "long prose").otherwise("prose"))


def with_cells(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add n_tokens (words) and topic."""
    body = whole_text(docs, text)
    docs = docs.withColumn("n_tokens", F.size(words_of(body)).cast("long"))
    return docs.withColumn("topic", topic_of(whole_text(docs, text), F.col("n_tokens")))


def feasible(share: np.ndarray, tokens: np.ndarray, wanted: float) -> np.ndarray:
    """Expected tokens of each category: its share of `wanted`, at most its own tokens, the rest shared among the others."""
    target = np.minimum(tokens, share * wanted)
    for _ in range(len(share)):
        free = (target < tokens) & (share > 0)
        lack = wanted - target.sum()
        if lack <= 1e-9 * wanted or not free.any():
            break
        target[free] = np.minimum(tokens[free], target[free] * (1 + lack / target[free].sum()))
    return target


def rake(tokens: np.ndarray, codes: list[np.ndarray], targets: list[np.ndarray], factor: np.ndarray, rounds: int = 2000, tolerance: float = 1e-7) -> np.ndarray:
    """Factors with which the sums of tokens * least(1, factor) by each margin's codes meet its targets."""
    off = 0.0
    for _ in range(rounds):
        off = 0.0
        for code, target in zip(codes, targets):
            now = np.bincount(code, tokens * np.minimum(1.0, factor), len(target)).astype(float)
            off = max(off, float(np.abs(now - target).max(initial=0.0)) / max(float(target.sum()), 1e-300))
            factor = np.minimum(MOST_FACTOR, factor * np.divide(target, now, out=np.ones_like(now), where=now > 0)[code])
        if off < tolerance:
            break
    else:
        warnings.warn(f"raking stopped {off:.2g} of all tokens off its targets: the margins' targets cannot all be met", stacklevel=2)
    return factor


def raked(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = 60, tolerance: float = 1e-6) -> DataFrame:
    """cells(margins..., tokens) with a factor, such that the sums of tokens * least(1, factor) meet targets[margin](margin, share)."""
    cells, old, off = cells.withColumn("factor", F.lit(1e-6)), None, 0.0
    expected = F.sum(F.col("tokens") * F.least(F.lit(1.0), F.col("factor")))
    for _ in range(rounds):
        for m in targets:
            total = cells.groupBy(m).agg(expected.alias("now")).filter("now > 0")
            scale = total.join(targets[m], total[m].eqNullSafe(targets[m][f"_{m}"])).select(F.col(f"_{m}").alias("_k"), (F.col("share") / F.col("now")).alias("by"))
            cells = cells.join(scale, cells[m].eqNullSafe(scale["_k"]), "left").withColumn(
                "factor", F.least(F.lit(MOST_FACTOR), F.col("factor") * F.coalesce("by", F.lit(1.0)))).drop("_k", "by")
        cells = materialize(cells, "mixing-cells")
        if old is not None:
            drop_materialized(old)
        old, off = cells, 0.0
        for m in list(targets)[:-1]:
            now = cells.groupBy(m).agg(expected.alias("now"))
            row = now.join(targets[m], now[m].eqNullSafe(targets[m][f"_{m}"])).agg(F.max(F.abs(F.col("now") - F.col("share"))).alias("off"), F.sum("share").alias("all")).first()
            off = max(off, (row["off"] or 0.0) / (row["all"] or 1.0))
        if off < tolerance:
            break
    else:
        warnings.warn(f"raking stopped {off:.2g} of all tokens off its targets", stacklevel=2)
    return cells


def margin_targets(cells: DataFrame, keep: float, temperature: float, targets: dict[str, DataFrame] | None) -> dict[str, DataFrame]:
    """For each margin: _margin, tokens, wanted (share of the sample), share (expected tokens that are feasible)."""
    found = {}
    for m in MARGINS:
        own = cells.groupBy(m).agg(F.sum("tokens").cast("double").alias("tokens"))
        if targets is None:
            own = own.withColumn("raw", F.when(F.col("tokens") > 0, F.pow("tokens", F.lit(temperature))).otherwise(0.0)).withColumn("told", F.lit(True))
        else:
            told = targets[m]
            own = own.join(told, own[m].eqNullSafe(told[f"_{m}"]), "left").select(m, "tokens", F.coalesce("share", F.lit(0.0)).alias("raw"), F.col("share").isNotNull().alias("told"))
        sums = own.agg(F.sum("tokens").alias("all"), F.sum(F.when(F.col("told"), F.col("tokens"))).alias("of_told"), F.sum("raw").alias("raw"), F.count(F.lit(1)).alias("n")).first()
        every, of_told = sums["all"] or 0.0, sums["of_told"] or 0.0
        # Categories without a target keep their token share; the others divide what remains.
        wanted = F.when(F.col("told"), F.col("raw") * ((of_told / every if every else 0.0) / (sums["raw"] or 1.0))).otherwise(F.col("tokens") / (every or 1.0))
        own = own.select(F.col(m).alias(f"_{m}"), "tokens", wanted.alias("wanted"))
        if sums["n"] <= MOST_CELLS:
            rows = own.collect()
            share = feasible(np.array([r["wanted"] for r in rows], float), np.array([r["tokens"] for r in rows], float), keep * every)
            found[m] = own.sparkSession.createDataFrame([(r[0], r["tokens"], r["wanted"], float(x)) for r, x in zip(rows, share)], f"_{m} string, tokens double, wanted double, share double")
        else:
            scale, least = 1.0, F.least(F.col("tokens"), F.col("wanted") * keep * every)
            for _ in range(60):
                least = F.least(F.col("tokens"), F.col("wanted") * (scale * keep * every))
                now = own.agg(F.sum(least)).first()[0] or 0.0
                if now >= keep * every * (1 - 1e-9) or not now:
                    break
                scale *= keep * every / now
            found[m] = materialize(own.withColumn("share", least), f"mixing-target-{m}")
    return found


def calibrated(celled: DataFrame, keep: float, temperature: float, targets: dict[str, DataFrame] | None) -> tuple[DataFrame, dict[str, DataFrame]]:
    """The cell table with weight (the product of factors) and probability, and the margins' targets."""
    spark = celled.sparkSession
    cells = materialize(celled.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens")), "mixing-counts")
    goals = margin_targets(cells, keep, temperature, targets)
    few = cells.count() <= MOST_CELLS
    if few:
        rows = cells.collect()
        drop_materialized(cells)
        tokens, codes, shares = np.array([r["tokens"] for r in rows], float), [], []
        for m in MARGINS:
            place = {r[0]: (i, r["share"]) for i, r in enumerate(goals[m].collect())}
            codes.append(np.array([place[r[m]][0] for r in rows], np.int64))
            shares.append(np.array([share for _, share in place.values()], float))
        factor = rake(tokens, codes, shares, np.full(len(rows), keep))
        found = spark.createDataFrame([(*[r[m] for m in MARGINS], float(r["tokens"]), float(x)) for r, x in zip(rows, factor)],
                                      ", ".join(f"{m} string" for m in MARGINS) + ", tokens double, factor double")
    else:
        found = raked(cells, goals)
    table = found.select(*[F.col(m).alias(f"_{m}") for m in MARGINS], F.col("tokens").alias("cell_tokens"), F.col("factor").alias("weight"),
                         F.when(F.col("tokens") > 0, F.least(F.lit(1.0), F.col("factor"))).otherwise(1.0).alias("probability"))
    return (F.broadcast(table) if few else table), goals


def margins(docs: DataFrame, keep: float = 0.5, temperature: float = 0.5, targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """margin, category, wanted, feasible and reached share of the expected sample, for every category of every margin."""
    celled = with_cells(docs.select("source", "lang", "text")).select(*MARGINS, "n_tokens")
    cells, goals = calibrated(celled, keep, temperature, targets)
    expected = F.sum(F.col("cell_tokens") * F.col("probability"))
    total = cells.agg(expected).first()[0] or 1.0
    out = None
    for m, goal in goals.items():
        now = cells.groupBy(F.col(f"_{m}").alias("category")).agg((expected / total).alias("reached"))
        part = goal.join(now, goal[f"_{m}"].eqNullSafe(now["category"])).select(F.lit(m).alias("margin"), "category", "wanted", (F.col("share") / total).alias("feasible"), "reached")
        out = part if out is None else out.unionByName(part)
    return out


def draw(doc_id: Column, seed: int) -> Column:
    """A number in [0, 1) from the document's id."""
    return F.shiftrightunsigned(F.xxhash64(doc_id, F.lit(seed)), 11) / F.lit(float(1 << 53))


def mix(docs: DataFrame, keep: float = 0.5, temperature: float = 0.5, targets: dict[str, DataFrame] | None = None, seed: int = 11) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, weight, probability, selected for every row of docs."""
    celled = materialize(with_cells(docs.select("doc_id", "source", "lang", "text")).drop("text"), "mixing-documents")
    cells, _ = calibrated(celled, keep, temperature, targets)
    same = F.lit(True)
    for m in MARGINS:
        same = same & celled[m].eqNullSafe(cells[f"_{m}"])
    joined = celled.join(cells, same, "left")
    return joined.select("doc_id", *MARGINS, "n_tokens", "weight", "probability", (draw(F.col("doc_id"), seed) < F.col("probability")).alias("selected"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str, keep: float = 0.5, temperature: float = 0.5, seed: int = 11) -> DataFrame:
    """The sampled documents, with the columns of docs; documents without tokens stay, an empty table stays empty."""
    own = docs.select(*[F.col(c).alias(f"__own_{i}") for i, c in enumerate(docs.columns)], "doc_id", "source", "lang", "text")
    celled = with_cells(own)
    cells, _ = calibrated(celled.select(*MARGINS, "n_tokens"), keep, temperature, None)
    same = F.lit(True)
    for m in MARGINS:
        same = same & celled[m].eqNullSafe(cells[f"_{m}"])
    taken = celled.join(cells, same, "left").filter(draw(F.col("doc_id"), seed) < F.col("probability"))
    return taken.select(*[F.col(f"__own_{i}").alias(c) for i, c in enumerate(docs.columns)])
