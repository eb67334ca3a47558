"""Mixing sources to target weights by iterative proportional fitting, in DataFrame operations only.

Documents are grouped to cells of (source, lang, topic); the token weight of the cells is
raked in turn to the target marginal of each dimension, and a document is kept with the
probability rate * raked weight / weight of its cell, against a seeded hash of its id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import Scratch

DIMS = ("source", "lang", "topic")
#: Target share of a value: in proportion to its token share to this power (1: as it is, 0: all alike).
POWERS = {"source": 0.5, "lang": 0.7, "topic": 0.9}
ROUNDS = 12
RATE = 0.5
#: Cells up to this number are raked in one task; beyond it by shuffles.
ONE_TASK_CELLS = 200_000
TOKENS = "regexp_count(coalesce(text, ''), '[^\\\\x20\\\\x09-\\\\x0D]+')"
TOPIC = """CASE WHEN n_tokens = 0 THEN 'empty' WHEN text LIKE '% | %' THEN 'table'
WHEN 10 * (length(text) - length(translate(text, '#*$%&<>', ''))) > n_tokens THEN 'markup'
WHEN 5 * (length(text) - length(translate(text, '!?', ''))) > n_tokens THEN 'exclaimed'
WHEN n_tokens < 100 THEN 'brief' WHEN n_tokens < 1000 THEN 'article' ELSE 'long' END"""


def described(docs: DataFrame, topic: Column | None = None) -> DataFrame:
    """docs(doc_id, text, lang, source) -> doc_id, source, lang, topic, n_tokens. Null source or lang is the value `(none)`.

    No topics are given, so the default topic is the form of the text: table, markup,
    exclaimed, or prose by length. Pass a column for topics of your own.
    """
    facts = docs.withColumn("n_tokens", F.expr(TOKENS).cast("long")).withColumn("_t", topic if topic is not None else F.expr(TOPIC))
    return facts.select("doc_id", *(F.coalesce(F.col(c).cast("string"), F.lit("(none)")).alias(c) for c in ("source", "lang")), F.coalesce("_t", F.lit("(none)")).alias("topic"), "n_tokens")


def rake(cells: DataFrame, scratch: Scratch, powers: dict[str, float] = POWERS, rounds: int = ROUNDS, targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """cells(source, lang, topic, tokens) with `factor`, the raked weight over the weight (1 for cells without tokens).

    targets[dim](value, share) replaces the tempered target of a dimension; values it lacks get no weight.
    """
    total = cells.agg(F.sum("tokens").alias("all_tokens"))
    out = cells.crossJoin(F.broadcast(total)).withColumn("w", F.col("tokens").cast("double"))
    for d in DIMS:
        if targets and d in targets:
            t = targets[d].select(F.col("value").cast("string").alias(d), F.col("share").cast("double").alias(f"t_{d}"))
            out = out.join(t, d, "left").withColumn(f"t_{d}", F.coalesce(f"t_{d}", F.lit(0.0)) * F.col("all_tokens"))
            continue
        share = F.pow(F.sum("tokens").over(Window.partitionBy(d)) / F.col("all_tokens"), F.lit(float(powers[d])))
        first = F.row_number().over(Window.partitionBy(d).orderBy(*DIMS)) == 1
        out = out.withColumn(f"p_{d}", F.when(F.col("all_tokens") > 0, share).otherwise(0.0)).withColumn("_f", first)
        norm = out.where("_f").agg(F.sum(f"p_{d}").alias("_n"))
        out = out.crossJoin(F.broadcast(norm)).withColumn(f"t_{d}", F.col(f"p_{d}") / F.when(F.col("_n") > 0, F.col("_n")) * F.col("all_tokens")).drop("_f", "_n", f"p_{d}")
    out = scratch.keep("targets", out)
    if out.count() <= ONE_TASK_CELLS:
        out = out.coalesce(1)
    for _ in range(rounds):
        for d in DIMS:
            got = F.sum("w").over(Window.partitionBy(d))
            out = out.withColumn("w", F.when(got > 0, F.col("w") * F.col(f"t_{d}") / got).otherwise(0.0))
    return scratch.keep("raked", out.select(*DIMS, F.when(F.col("tokens") > 0, F.col("w") / F.col("tokens")).otherwise(1.0).alias("factor")))


def mixed(docs: DataFrame, *, seed: str = "mix", rate: float = RATE, powers: dict[str, float] = POWERS, rounds: int = ROUNDS, topic: Column | None = None, targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, probability (six decimals), kept for every row of docs.

    Probabilities are min(1, rate * factor of the cell), so the kept tokens follow the raked
    marginals except where a cell would need more than all its documents. Rows that repeat
    an id are kept or left together; a null id counts as the empty string. Empty texts weigh
    nothing and are kept at `rate`. The rounds are fixed: targets on data without some
    combinations may be met only nearly; margins() says how nearly.
    """
    scratch = Scratch(docs.sparkSession)
    facts = scratch.keep("facts", described(docs, topic))
    cells = scratch.keep("cells", facts.groupBy(*DIMS).agg(F.sum("n_tokens").alias("tokens")))
    factors = rake(cells, scratch, powers, rounds, targets)
    small = factors.limit(ONE_TASK_CELLS + 1).count() <= ONE_TASK_CELLS
    joined = facts.join(F.broadcast(factors) if small else factors, list(DIMS))
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(seed + "|"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))
    p = F.round(F.least(F.lit(1.0), F.lit(float(rate)) * F.col("factor")), 6)
    return joined.withColumn("probability", p).select("doc_id", *DIMS, "n_tokens", "probability", (draw < F.col("probability")).alias("kept"))


def margins(mixed_docs: DataFrame, powers: dict[str, float] = POWERS) -> DataFrame:
    """dim, value, target, expected: for each value of each dimension the tempered target share of the tokens and the share that the probabilities of mixed() give.

    They differ where a probability is clipped at 1, or where the rounds have not settled.
    """
    out = None
    whole = mixed_docs.agg(F.sum("n_tokens").alias("_all"), F.sum(F.col("n_tokens") * F.col("probability")).alias("_got"))
    for d in DIMS:
        cells = mixed_docs.groupBy(F.col(d).alias("value")).agg(F.sum("n_tokens").alias("n"), F.sum(F.col("n_tokens") * F.col("probability")).alias("got"))
        cells = cells.crossJoin(F.broadcast(whole)).withColumn("p", F.when(F.col("n") > 0, F.pow(F.col("n") / F.col("_all"), F.lit(float(powers[d])))).otherwise(0.0))
        cells = cells.crossJoin(F.broadcast(cells.agg(F.sum("p").alias("_p"))))
        part = cells.select(F.lit(d).alias("dim"), "value", (F.col("p") / F.expr("nullif(_p, 0)")).alias("target"), (F.col("got") / F.expr("nullif(_got, 0)")).alias("expected"))
        out = part if out is None else out.unionByName(part)
    return out


def sampled(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that mixed() keeps. Ids with rows of several cells count as kept where any of their rows is."""
    keep = mixed(docs, **options).where("kept").select("doc_id").distinct()
    return docs.join(keep, docs["doc_id"].eqNullSafe(keep["doc_id"]), "left_semi")


def oracle(rounds: int = ROUNDS, rate: float = RATE, seed: str = "mix", powers: dict[str, float] = POWERS) -> str:
    """DuckDB SQL for mixed() with tempered targets."""
    steps = ["f0 AS (SELECT doc_id, text, coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n_tokens FROM documents)"]
    steps.append(f"facts AS (SELECT doc_id, source, lang, n_tokens, coalesce({TOPIC}, '(none)') AS topic FROM f0)")
    steps.append("cells AS (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens, sum(sum(n_tokens)) OVER ()::DOUBLE AS total FROM facts GROUP BY ALL)")
    for d in DIMS:
        steps.append(f"g_{d} AS (SELECT {d}, pow(sum(tokens) / any_value(total), {powers[d]}) AS p, any_value(total) AS total FROM cells GROUP BY {d})")
        steps.append(f"t_{d} AS (SELECT {d}, p / sum(p) OVER () * total AS t_{d} FROM g_{d})")
    steps.append("w0 AS (SELECT cells.*, tokens AS w, t_source, t_lang, t_topic FROM cells JOIN t_source USING (source) JOIN t_lang USING (lang) JOIN t_topic USING (topic))")
    k = 0
    for _ in range(rounds):
        for d in DIMS:
            got = f"sum(w) OVER (PARTITION BY {d})"
            steps.append(f"w{k + 1} AS MATERIALIZED (SELECT * REPLACE (CASE WHEN {got} > 0 THEN w * t_{d} / {got} ELSE 0 END AS w) FROM w{k})")
            k += 1
    steps.append(f"p AS (SELECT source, lang, topic, round(least(1.0, {rate} * CASE WHEN tokens > 0 THEN w / tokens ELSE 1 END), 6) AS probability FROM w{k})")
    draw = f"CAST('0x' || substr(md5('{seed}|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) / 281474976710656.0"
    return "WITH " + ",\n".join(steps) + f"\nSELECT doc_id, source, lang, topic, n_tokens, probability, {draw} < probability AS kept FROM facts JOIN p USING (source, lang, topic)"
