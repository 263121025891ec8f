"""Mixing sources to target weights: raking of token weights, then sampling by calibrated probabilities."""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import apart, rejoined, table, words_and_end

ROUNDS = 200
TOLERANCE = 1e-9
MOST_CELLS = 200_000
TEMPERATURE = 0.7
KEEP = 0.8
SEED = 17
# Stands for null among the values of an axis.
NULL = "\0null"
TOPICS = ("tabular", "shouted", "quoted", "short", "prose")


def topic(text: Column) -> Column:
    """A coarse topic by form: tables, shouting, dialogue, short pieces, prose."""
    size = F.length(text)
    share = lambda mark: (size - F.length(F.replace(text, F.lit(mark), F.lit("")))) / size
    return (F.when(F.coalesce(size, F.lit(0)) == 0, "short").when(share("|") > 0.02, "tabular").when(share("!") > 0.02, "shouted")
            .when(share('"') > 0.01, "quoted").when(size < 400, "short").otherwise("prose"))


def rake(weights: np.ndarray, targets: list[np.ndarray], rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> np.ndarray:
    """Iterative proportional fitting: scale the table of weights, one axis after the other, until each
    marginal has its target shares. Targets of empty slices are left out and the rest scaled up."""
    total = weights.sum()
    now = weights.astype(float).copy()
    if total <= 0:
        return now
    goals = []
    for axis, target in enumerate(targets):
        present = weights.sum(axis=tuple(a for a in range(weights.ndim) if a != axis)) > 0
        goal = np.where(present, target, 0.0)
        goals.append(total * (goal / goal.sum() if goal.sum() > 0 else present / present.sum()))
    for _ in range(rounds):
        worst = 0.0
        for axis, goal in enumerate(goals):
            others = tuple(a for a in range(now.ndim) if a != axis)
            have = now.sum(axis=others)
            factor = np.divide(goal, have, out=np.zeros_like(goal), where=have > 0)
            worst = max(worst, np.abs(have - goal).max() / total)
            shape = [1] * now.ndim
            shape[axis] = -1
            now *= factor.reshape(shape)
        if worst < tolerance:
            break
    return now


def tempered(tokens: Mapping[str, float], temperature: float = TEMPERATURE) -> dict[str, float]:
    """Target shares in proportion to a power of the token counts: below 1, small values gain."""
    powered = {k: max(v, 0.0) ** temperature for k, v in tokens.items()}
    total = sum(powered.values())
    return {k: v / total for k, v in powered.items()} if total else {}


def calibrated(ratio: np.ndarray, weights: np.ndarray, keep: float) -> np.ndarray:
    """Probabilities min(1, c * ratio), with c such that a share ``keep`` of all weight is expected to stay.

    No document is repeated, so cells that would need more than themselves are kept whole.
    """
    low, high = 0.0, 1.0 / ratio[ratio > 0].min() if (ratio > 0).any() else 1.0
    for _ in range(100):
        c = (low + high) / 2
        low, high = (c, high) if (weights * np.minimum(1.0, c * ratio)).sum() < keep * weights.sum() else (low, c)
    return np.minimum(1.0, high * ratio)


def chances(docs: DataFrame, axes: Mapping[str, Column], tokens: Column, targets: Mapping[str, Mapping[str, float]] | None = None,
            key: str = "doc_id", keep: float = KEEP, seed: int = SEED) -> DataFrame:
    """Every row of ``docs`` as ``row``, with its ``cell`` (the values of ``axes``), ``tokens``, ``probability`` and whether it is ``kept``.

    Token counts by cell are raked to the target shares of each axis; without targets an axis aims at tempered shares of its own counts. A cell's
    probability is its raked over its given weight, scaled so that a share ``keep`` of all tokens is expected to stay and
    held at 1. A document is kept if the hash of its id falls below its probability, so
    copies of an id stay or go together, as do all rows without an id in a cell. Null values form a value of their own; a row of no or null tokens counts as one token. The table of cells
    is bounded by MOST_CELLS and a larger one raises. An empty table has no rows; columns of any name come back in ``row``.
    """
    names = list(axes)
    size = F.greatest(F.coalesce(tokens.cast("double"), F.lit(0.0)), F.lit(1.0))
    cell = F.struct(*[F.coalesce(axes[n].cast("string"), F.lit(NULL)).alias(f"a{i}") for i, n in enumerate(names)])
    marked = apart(docs, cell=cell, tokens=size, place=place(F.col(key), seed))
    counted = marked.groupBy("cell").agg(F.sum("tokens").alias("w")).limit(MOST_CELLS + 1).collect()
    if len(counted) > MOST_CELLS:
        raise ValueError(f"more than {MOST_CELLS} cells of {names}")
    values = [sorted({r.cell[i] for r in counted}) for i in range(len(names))]
    if np.prod([len(v) for v in values], dtype=float) > 50 * MOST_CELLS:
        raise ValueError(f"the table of {names} is too large to rake")
    at = [{v: i for i, v in enumerate(vs)} for vs in values]
    table = np.zeros([len(v) for v in values])
    for r in counted:
        table[tuple(a[v] for a, v in zip(at, r.cell))] = r.w
    goals = []
    for axis, (name, vs) in enumerate(zip(names, values)):
        given = (targets or {}).get(name)
        if given is None:
            sums = table.sum(axis=tuple(a for a in range(table.ndim) if a != axis))
            given = tempered(dict(zip(vs, sums)))
        goals.append(np.array([given.get(v, 0.0) for v in vs]))
    ratio = np.divide(rake(table, goals), table, out=np.zeros_like(table), where=table > 0)
    chance = calibrated(ratio, table, keep)
    rows = [(tuple(r.cell), float(chance[tuple(a[v] for a, v in zip(at, r.cell))])) for r in counted]
    known = docs.sparkSession.createDataFrame(rows, f"cell struct<{', '.join(f'a{i}: string' for i in range(len(names)))}>, probability double")
    return marked.join(F.broadcast(known), "cell").select("row", "cell", "tokens", "probability", (F.col("place") < F.col("probability")).alias("kept"))


def place(key: Column, seed: int) -> Column:
    """A number from 0 to 1 for every id, from a digest of its text."""
    digest = F.sha2(F.concat(F.coalesce(key.cast("string"), F.lit(NULL)), F.lit(f":{seed}")).cast("binary"), 256)
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def mix(docs: DataFrame, axes: Mapping[str, Column], tokens: Column, targets: Mapping[str, Mapping[str, float]] | None = None,
        key: str = "doc_id", keep: float = KEEP, seed: int = SEED) -> DataFrame:
    """The rows of ``docs`` that ``chances`` keeps, with their own columns."""
    return rejoined(chances(docs, axes, tokens, targets, key, keep, seed).where("kept"), docs)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    axes = {"source": F.col("source"), "lang": F.col("lang"), "topic": topic(text)}
    found = chances(table(spark, sf_dir, "documents"), axes, words_and_end(text))
    return found.select("row.doc_id", "row.source", "row.lang", F.col("cell.a2").alias("topic"), F.col("tokens").cast("bigint").alias("n_tokens"),
                        F.round("probability", 6).alias("probability"), "kept")


QUERIES = {"op2_mixing": op2_mixing}
ORACLE = {"op2_mixing": rf"""
WITH RECURSIVE t AS (SELECT *, coalesce(length(text), 0) AS size, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS words FROM documents),
d AS (SELECT doc_id, source, lang, CASE WHEN size = 0 THEN 'short' WHEN (size - length(replace(text, '|', '')))::DOUBLE / size > 0.02 THEN 'tabular'
    WHEN (size - length(replace(text, '!', '')))::DOUBLE / size > 0.02 THEN 'shouted' WHEN (size - length(replace(text, '"', '')))::DOUBLE / size > 0.01 THEN 'quoted'
    WHEN size < 400 THEN 'short' ELSE 'prose' END AS topic, CASE WHEN words > 0 THEN words + 1 ELSE 1 END AS n_tokens FROM t),
cells AS (SELECT coalesce(source, '') AS a, coalesce(lang, '') AS b, topic AS c, sum(n_tokens)::DOUBLE AS w FROM d GROUP BY ALL),
axes AS (SELECT 0 AS axis, a AS value, sum(w) AS w FROM cells GROUP BY a UNION ALL SELECT 1, b, sum(w) FROM cells GROUP BY b UNION ALL SELECT 2, c, sum(w) FROM cells GROUP BY c),
goals AS (SELECT axis, value, pow(w, {TEMPERATURE}) / sum(pow(w, {TEMPERATURE})) OVER (PARTITION BY axis) * sum(w) OVER (PARTITION BY axis) AS goal FROM axes),
raked AS (SELECT 0 AS step, a, b, c, c.w AS given, c.w, ga.goal AS ga, gb.goal AS gb, gc.goal AS gc FROM cells c JOIN goals ga ON ga.axis = 0 AND ga.value = a
    JOIN goals gb ON gb.axis = 1 AND gb.value = b JOIN goals gc ON gc.axis = 2 AND gc.value = c
  UNION ALL SELECT step + 1, a, b, c, given, w * CASE step % 3 WHEN 0 THEN ga WHEN 1 THEN gb ELSE gc END
    / sum(w) OVER (PARTITION BY CASE step % 3 WHEN 0 THEN a WHEN 1 THEN b ELSE c END), ga, gb, gc FROM raked WHERE step < {3 * ROUNDS}),
ratios AS (SELECT a, b, c, given, w / given AS r FROM raked WHERE step = {3 * ROUNDS}),
scales AS (SELECT r, ({KEEP} * sum(given) OVER () - coalesce(sum(given) OVER (ORDER BY r DESC, a, b, c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(given * r) OVER (ORDER BY r DESC, a, b, c ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS scale FROM ratios),
scale AS (SELECT scale FROM scales WHERE scale * r <= 1 ORDER BY r DESC LIMIT 1),
chances AS (SELECT a, b, c, least(1.0::DOUBLE, coalesce((SELECT scale FROM scale), 1e300) * r) AS p FROM ratios)
SELECT doc_id, source, lang, topic, n_tokens::BIGINT AS n_tokens, round(p, 6) AS probability,
  ('0x' || substr(sha256(doc_id || ':{SEED}'), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE < p AS kept
FROM d JOIN chances ON a = coalesce(source, '') AND b = coalesce(lang, '') AND c = topic
"""}
