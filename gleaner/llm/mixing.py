"""Mixing sources to target weights by iterative proportional fitting, in DataFrame operations only.

Documents fall into cells of source, language and topic; a cell's weight starts as its tokens. Each
round scales the weights to the target share of every source, then language, then topic, by joining
the sums of each value back to the cells. Every BLOCK rounds the sums are held against their targets:
raking ends where none is off by more than TOLERANCE, or where a block brought them less than a tenth nearer, as targets
that contradict each other are never met; a warning then tells by how much they are missed. A cell's ratio of fitted weight to tokens, scaled so that the kept tokens meet the
budget with no chance over 1, is the chance of each of its documents; a hash of the id makes the
draw, so that it is the same in every attempt.

Topics: a column `topic` of the documents, or the `topic` parameter; else a rough kind of text by its
marks and length (`topic_of`). The corpus's own frequent terms were tried instead and cost 2,000 CPU seconds a GB.

Tokens are words unless the `tokens` parameter is a column that holds better counts.

The only shuffle of the corpus is the sum by cell, summed in the tasks first, so that a hot source
costs nothing. Cells are as many as combinations of the three values that occur; no
step brings them into one task but for what the planner coalesces.

Targets: {dimension: {value: share}}; values without a share get none. The default is each value's
own share to the power `temper`, which lifts small ones.

Cases: a null source, language or topic is the value "(none)". A null text has no
tokens; a cell without tokens keeps its documents with the chance `budget`, 1 at most. Rows repeating an id share its
draw; a null id is drawn like the text "null". An empty table stays empty. Texts of any length are counted whole. Other
columns stay under their names; those that mix makes replace columns so called, whatever their case.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import few_tasks, forget, fresh, q, without, written

DIMENSIONS = ("source", "lang", "topic")
NONE = "(none)"
ROUNDS = 40
BLOCK = 5
TOLERANCE = 1e-3
TEMPER = 0.7
BUDGET = 0.5
SEED = "mix-1"


def tokens_of(text: Column) -> Column:
    """Words: runs of anything but ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def topic_of(text: Column) -> Column:
    """A rough kind of text where the corpus has no topic of its own."""
    return (
        F.when(F.contains(text, F.lit(" | ")), "table")
        .when(F.contains(text, F.lit("!! ")), "shouting")
        .when(text.rlike(r"[#$%&*]{3}"), "symbols")
        .when(F.length(text) < 500, "note")
        .otherwise("article")
    )


def rake(cells: DataFrame, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> tuple[DataFrame, float]:
    """(cells with w raked to goal_source, goal_lang and goal_topic, the largest distance of a sum from its goal)."""
    cells = written(cells.withColumn("w", F.col("tokens").cast("double")), "raked")
    rows, residual = cells.count(), float("inf")
    for k in range(1, rounds + 1):
        for d in DIMENSIONS:  # written each time: a plan that joins a table to its own sums doubles with every step
            total = few_tasks(cells.groupBy(F.col(d).alias("of")).agg(F.sum("w").alias("total")), rows)
            now = cells.join(total, F.col(d) == F.col("of")).drop("of")
            now = now.withColumn("w", F.when(F.col("total") > 0, F.col("w") * F.col(f"goal_{d}") / F.col("total")).otherwise(F.lit(0.0))).drop("total")
            before, cells = cells, written(few_tasks(now, rows), "raked")
            forget(before)
        if k % BLOCK and k < rounds:
            continue
        missed = [few_tasks(cells.groupBy(d).agg(F.abs(F.sum("w") - F.max(f"goal_{d}")).alias("gap")).select("gap"), rows) for d in DIMENSIONS]
        last, residual = residual, missed[0].union(missed[1]).union(missed[2]).agg(F.max("gap")).first()[0] or 0.0
        if residual <= tolerance or residual > 0.9 * last:
            break
    return cells, residual


def chances(cells: DataFrame, targets: dict[str, dict[str, float]] | None = None, rounds: int = ROUNDS, temper: float = TEMPER, budget: float = BUDGET) -> DataFrame:
    """(source, lang, topic, tokens, weight, chance) from cells (source, lang, topic, tokens)."""
    rows = cells.count()
    for d in DIMENSIONS:
        if targets and d in targets:
            shares = F.create_map(*(F.lit(x) for kv in targets[d].items() for x in kv)) if targets[d] else F.lit(None).cast("map<string,double>")
            cells = cells.withColumn(f"goal_{d}", F.coalesce(shares[F.col(d)].cast("double"), F.lit(0.0)))
        else:
            own = cells.groupBy(F.col(d).alias("of")).agg(F.pow(F.sum("tokens").cast("double"), F.lit(temper)).alias("own"))
            own = written(few_tasks(own, rows), "shares")
            all_ = own.agg(F.sum("own")).first()[0] or 1.0
            cells = cells.join(own, F.col(d) == F.col("of")).withColumn(f"goal_{d}", F.col("own") / F.lit(all_)).drop("of", "own")
    cells, residual = rake(cells, rounds)
    if residual > TOLERANCE:
        warnings.warn(f"the targets contradict each other: missed by up to {residual:.4f} after {rounds} rounds", stacklevel=2)
    cells = cells.withColumn("r", F.when(F.col("tokens") > 0, F.col("w") / F.col("tokens")).otherwise(F.lit(0.0)))
    room = budget * (cells.agg(F.sum("tokens")).first()[0] or 0)
    scale, full = 0.0, -1
    while True:  # cells whose chance would pass 1 are kept whole, and the rest share what is left; each turn adds cells
        over = F.col("r") * F.lit(scale) >= 1
        whole, n, rest = cells.agg(F.sum(F.when(over, F.col("tokens"))), F.count_if(over), F.sum(F.when(~over, F.col("r") * F.col("tokens")))).first()
        if n == full or not rest:
            scale = scale if rest else float("inf")
            break
        scale, full = max(scale, (room - (whole or 0)) / rest), n
    chance = F.when(F.col("tokens") == 0, F.lit(min(1.0, budget))).when(F.col("r") == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.lit(scale) * F.col("r")))
    return cells.select(*DIMENSIONS, "tokens", F.col("w").alias("weight"), chance.alias("chance"))


def mix(
    docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, topic: Column | None = None, id_col: str = "doc_id", text_col: str = "text",
    source_col: str = "source", lang_col: str = "lang", rounds: int = ROUNDS, temper: float = TEMPER, budget: float = BUDGET, seed: str = SEED, tokens: Column | None = None,
) -> DataFrame:
    """docs with mix_topic, mix_tokens, mix_weight (its cell's share), mix_chance and mix_kept."""
    made = ("mix_topic", "mix_tokens", "mix_weight", "mix_chance", "mix_kept")
    docs = without(docs, *made)
    text = q(text_col)
    if topic is None:
        topic = q("topic") if "topic" in docs.columns else topic_of(text)
    tokens = tokens_of(text) if tokens is None else F.coalesce(tokens.cast("long"), F.lit(0))
    part = {"source": q(source_col), "lang": q(lang_col), "topic": topic}
    part = {d: F.coalesce(c.cast("string"), F.lit(NONE)) for d, c in part.items()}
    slim = docs.select(*(c.alias(d) for d, c in part.items()), tokens.alias("tokens"))
    cells = written(slim.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens")), "cells")
    cells = written(chances(cells, targets, rounds, temper, budget), "chances")
    of = {d: fresh(f"cell_{d}", docs) for d in DIMENSIONS}
    own = {d: fresh(f"own_{d}", docs) for d in DIMENSIONS}
    cells = cells.select(*(F.col(d).alias(of[d]) for d in DIMENSIONS), F.col("weight").alias("mix_weight"), F.col("chance").alias("mix_chance"))
    full = docs.select("*", *(part[d].alias(own[d]) for d in DIMENSIONS), tokens.alias("mix_tokens"))
    full = full.join(cells, (q(own["source"]) == q(of["source"])) & (q(own["lang"]) == q(of["lang"])) & (q(own["topic"]) == q(of["topic"])))
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(q(id_col).cast("string"), F.lit("null"))).cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)
    full = full.withColumn("mix_topic", q(own["topic"])).withColumn("mix_kept", draw < F.col("mix_chance"))
    return full.select(*(q(c) for c in docs.columns), *made)


def mix_sql(rounds: int = ROUNDS, temper: float = TEMPER, budget: float = BUDGET, seed: str = SEED) -> str:
    """DuckDB SQL of mix(documents) with its defaults, digits as in the query."""
    steps, last, ends = [], "w0", []
    for k in range(rounds):
        for d in DIMENSIONS:
            now = f"w{k}_{d}"
            steps.append(f"{now} AS MATERIALIZED (SELECT * REPLACE (coalesce(w * goal_{d} / nullif(sum(w) OVER (PARTITION BY {d}), 0), 0) AS w) FROM {last})")
            last = now
        if (k + 1) % BLOCK == 0 or k + 1 == rounds:
            ends.append(last)
    gaps = " UNION ALL ".join(f"SELECT {k} AS block, max(gap) AS gap FROM (" + " UNION ALL ".join(f"SELECT abs(sum(w) - max(goal_{d})) AS gap FROM {e} GROUP BY {d}" for d in DIMENSIONS) + ")" for k, e in enumerate(ends))
    steps.append(f"gaps AS ({gaps})")
    steps.append(f"done AS (SELECT coalesce(min(block), {len(ends) - 1}) AS block FROM (SELECT block, gap, lag(gap) OVER (ORDER BY block) AS before FROM gaps) WHERE gap <= {TOLERANCE} OR gap > 0.9 * before)")
    steps.append("raked AS (" + " UNION ALL ".join(f"SELECT * FROM {e} WHERE (SELECT block FROM done) = {k}" for k, e in enumerate(ends)) + ")")
    last = "raked"
    goals = ", ".join(f"g_{d} AS (SELECT {d}, pow(sum(tokens), {temper}) / sum(pow(sum(tokens), {temper})) OVER () AS goal_{d} FROM cells GROUP BY {d})" for d in DIMENSIONS)
    return rf"""
WITH parts AS (
  SELECT doc_id, coalesce(source, '{NONE}') AS source, coalesce(lang, '{NONE}') AS lang,
    CASE WHEN contains(text, ' | ') THEN 'table' WHEN contains(text, '!! ') THEN 'shouting'
         WHEN regexp_matches(text, '[#$%&*]{{3}}') THEN 'symbols' WHEN length(text) < 500 THEN 'note' ELSE 'article' END AS topic,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS tokens
  FROM documents
), cells AS (SELECT source, lang, topic, sum(tokens)::BIGINT AS tokens FROM parts GROUP BY ALL),
{goals},
w0 AS (SELECT *, tokens::DOUBLE AS w FROM cells JOIN g_source USING (source) JOIN g_lang USING (lang) JOIN g_topic USING (topic)),
{", ".join(steps)},
ratio AS (SELECT *, CASE WHEN tokens > 0 THEN w / tokens ELSE 0 END AS r, sum(tokens) OVER () AS total FROM {last}),
filled AS (
  SELECT *, row_number() OVER o AS place,
    ({budget} * total - coalesce(sum(tokens) OVER (ORDER BY r DESC, source, lang, topic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / nullif(sum(r * tokens) OVER (ORDER BY r DESC, source, lang, topic ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS scale
  FROM ratio WINDOW o AS (ORDER BY r DESC, source, lang, topic)
), best AS (SELECT arg_min(scale, place) AS scale FROM filled WHERE scale > 0 AND scale * r <= 1 + 1e-9),
chance AS (SELECT source, lang, topic, w, CASE WHEN tokens = 0 THEN least(1.0, {budget}) WHEN r = 0 THEN 0 ELSE least(1.0, best.scale * r) END AS chance FROM filled, best)
SELECT p.doc_id, p.source, p.lang, p.topic, p.tokens, round(c.w, 6) AS weight, round(c.chance, 6) AS chance,
  (('0x' || substr(md5('{seed}:' || coalesce(p.doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / 4503599627370496.0) < c.chance AS kept
FROM parts p JOIN chance c USING (source, lang, topic)
"""
