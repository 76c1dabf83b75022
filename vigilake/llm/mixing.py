"""Mixing sources to target weights by iterative proportional fitting (operator 2).

Token counts per (source, language, topic) cell are raked until what is expected to be drawn
meets the target of every source, language and topic; documents are then drawn with the
probability of their cell. No probability passes 1: a step solves, for each key, the factor at
which its cells, full ones held at all their tokens, add up to its target. All steps are
DataFrame operations over one small table of cells, written every few sweeps.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, exactly, written

DIMENSIONS = ("source", "lang", "topic")
#: Topic and the literal marks that speak for it; a text without any mark is prose.
TOPICS = {
    "tables": ("|",),
    "contacts": ("@", "+1-", "tel"),
    "secrets": ("token", "key =", "password"),
    "licences": ("icense", "opyright"),
    "markup": ("http", "</", "#"),
}


def topic_of(text: Column, topics: dict[str, tuple[str, ...]] = TOPICS) -> Column:
    """The topic with most marks over the whole text; the first listed on a tie."""
    text = F.coalesce(text, F.lit(""))

    def marks(needles):
        return reduce(lambda a, b: a + b, [
            ((F.length(text) - F.length(F.replace(text, F.lit(n)))) / len(n)).cast("long") for n in needles])

    counts = F.array(*[F.struct(marks(n).alias("n"), F.lit(-i).alias("i"), F.lit(t).alias("t"))
                       for i, (t, n) in enumerate(topics.items())])
    best = F.array_max(counts)
    return F.when(best["n"] > 0, best["t"]).otherwise(F.lit("prose"))


def measured(docs: DataFrame, text_col: str = "text", prefix: str = "__") -> DataFrame:
    """docs with source, lang, topic (null counts as empty) and tokens (words of the whole text), each
    under its name after ``prefix``."""
    text = exactly(text_col)
    present = {c.lower() for c in docs.columns}
    return docs.withColumns({
        f"{prefix}source": F.coalesce(exactly("source").cast("string"), F.lit("")) if "source" in present else F.lit(""),
        f"{prefix}lang": F.coalesce(exactly("lang").cast("string"), F.lit("")) if "lang" in present else F.lit(""),
        f"{prefix}topic": F.coalesce(exactly("topic").cast("string"), F.lit("")) if "topic" in present else topic_of(text),
        f"{prefix}tokens": F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long"),
    })


def _factor(part: list[str], weight: str, target: Column, ties: list[str]) -> tuple[Column, Column]:
    """For the factor f at which the sum of least(tokens, weight * f) over a part is ``target``: f
    itself where the target takes all tokens, and a candidate per cell.

    With the cells in the order in which they fill up, holding those before a cell full gives its
    candidate; the true sum never exceeds any of these sums, so the largest candidate is f.
    """
    fills = F.col("tokens") / F.col(weight)
    up = Window.partitionBy(*part).orderBy(fills.asc(), *[F.col(t).asc() for t in ties])
    down = Window.partitionBy(*part).orderBy(fills.desc(), *[F.col(t).desc() for t in ties])
    full = F.coalesce(F.sum("tokens").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    open_ = F.sum(weight).over(down.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    whole = Window.partitionBy(*part)
    return F.when(target >= F.sum("tokens").over(whole), F.max(fills).over(whole)), (target - full) / open_


def _scaled(cells: DataFrame, part: list[str], weight: str, target: Column, ties: list[str]) -> DataFrame:
    """cells with ``weight`` times the factor of its part."""
    whole, candidate = _factor(part, weight, target, ties)
    solved = cells.withColumns({"_whole": whole, "_candidate": candidate})
    factor = F.coalesce("_whole", F.max("_candidate").over(Window.partitionBy(*part)))
    return solved.withColumn(weight, F.col(weight) * factor).drop("_whole", "_candidate")


def tempered(cells: DataFrame, keep: float, power: float) -> dict[str, DataFrame]:
    """Target tokens per key of each dimension: in proportion to its own tokens to a power, none over
    all it has, ``keep`` of all tokens together."""
    out = {}
    for d in DIMENSIONS:
        sums = cells.groupBy(d).agg(F.sum("tokens").alias("tokens")).withColumns(
            {"p": F.pow(F.col("tokens").cast("double"), F.lit(power)), "one": F.lit(1)})
        budget = F.sum("tokens").over(Window.partitionBy("one")).cast("double") * keep
        filled = _scaled(sums.withColumn("budget", budget), ["one"], "p", F.col("budget"), [d])
        out[d] = filled.select(d, F.least(F.col("tokens").cast("double"), "p").alias("target"))
    return out


def given(cells: DataFrame, shares: dict[str, DataFrame], keep: float) -> dict[str, DataFrame]:
    """Target tokens of given shares. The budget is ``keep`` of all tokens, or less where a key has too few
    for its share of that; keys without a share get none."""
    sums = {d: cells.groupBy(d).agg(F.sum("tokens").alias("tokens")).join(shares[d].where("share > 0"), d) for d in DIMENSIONS}
    most = reduce(DataFrame.union, [s.select((F.col("tokens") / F.col("share")).alias("most")) for s in sums.values()])
    budget = written(most.agg(F.min("most").alias("most")).crossJoin(F.broadcast(cells.agg((F.sum("tokens") * keep).alias("all")))).select(
        F.least("most", "all").alias("budget")), "budget")
    return {d: s.crossJoin(F.broadcast(budget)).select(d, (F.col("share") * F.col("budget")).alias("target")) for d, s in sums.items()}


#: Up to so many cells a sweep needs no shuffle: one task holds them.
ONE_TASK = 100_000


def rake(cells: DataFrame, targets: dict[str, DataFrame], sweeps: int = 20, block: int = 4) -> DataFrame:
    """cells with ``drawn`` (tokens expected to be drawn, at most all) and ``off``, the largest
    relative miss among the cell's three targets.

    A sweep takes sources, then languages, then topics. Cells of a key without a target are left out.
    """
    ties = list(DIMENSIONS)
    state = cells.withColumn("w", F.col("tokens").cast("double"))
    for d in DIMENSIONS:
        state = state.join(targets[d].select(d, F.col("target").alias(f"t_{d}")), d)
    state = written(state, "cells")
    few = state.count() <= ONE_TASK
    state = state.coalesce(1) if few else state
    for sweep in range(sweeps):
        for d in DIMENSIONS:
            state = _scaled(state, [d], "w", F.col(f"t_{d}"), ties)
        if sweep % block == block - 1:
            state = written(state, "cells")
            state = state.coalesce(1) if few else state
    state = state.withColumn("drawn", F.least(F.col("tokens").cast("double"), "w"))
    miss = [F.abs(F.sum("drawn").over(Window.partitionBy(d)) / F.col(f"t_{d}") - 1) for d in DIMENSIONS]
    return state.withColumn("off", F.greatest(*miss)).select(*DIMENSIONS, "tokens", "drawn", "off")


def rated(rows: DataFrame, targets: dict[str, DataFrame] | None = None, keep: float = 0.5, power: float = 0.5,
          seed: str = "mix", id_col: str = "doc_id", sweeps: int = 20, prefix: str = "__") -> DataFrame:
    """Measured rows with rate, off and drawn after ``prefix``; see ``mix``."""
    keys = [f"{prefix}{d}" for d in DIMENSIONS]
    cells = written(rows.groupBy(keys).agg(F.sum(f"{prefix}tokens").alias("tokens")).where("tokens > 0")
                    .select(*[exactly(k).alias(d) for k, d in zip(keys, DIMENSIONS)], "tokens"), "cells")
    raked = rake(cells, given(cells, targets, keep) if targets else tempered(cells, keep, power), sweeps)
    rates = written(raked.select(*[F.col(d).alias(k) for k, d in zip(keys, DIMENSIONS)],
                                 F.round(F.col("drawn") / F.col("tokens"), 6).alias(f"{prefix}rate"), F.round("off", 4).alias(f"{prefix}off")), "rates")
    drawn = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(exactly(id_col).cast("string"), F.lit("")))), 1, 8), 16, 10)
    rate = F.when(exactly(f"{prefix}tokens") > 0, F.coalesce(exactly(f"{prefix}rate"), F.lit(0.0))).otherwise(F.lit(0.0))
    return rows.join(rates, keys, "left").withColumn(f"{prefix}rate", rate).withColumn(
        f"{prefix}drawn", drawn.cast("double") / 4294967296.0 < exactly(f"{prefix}rate"))


def mix(docs: DataFrame, targets: dict[str, DataFrame] | None = None, keep: float = 0.5, power: float = 0.5,
        seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", sweeps: int = 20, prefix: str = "__") -> DataFrame:
    """docs with source, lang, topic, tokens, rate, off and drawn, each after ``prefix``.

    ``keep`` is the share of all tokens to aim for. ``targets``: per dimension (source, lang, topic) a
    table of key and share; the budget is lowered where a key has too few tokens for its share. By
    default a key's target is in proportion to its own tokens to the power ``power``, and all it
    has at most. A row's rate is what its cell is expected to give over what it has, never
    above 1; ``off`` is the largest relative miss among the cell's three targets, for targets
    that no choice of rates can meet together. A row is drawn by a hash of ``seed`` and its id, so
    a draw repeats, and equal ids fall alike. Documents without words (null, empty, blank) carry
    no tokens: their rate is 0 and they are not drawn. Repeated rows count each; an empty table
    gives no rows; a null id is hashed as an empty one. Columns of ``docs`` whose names begin
    with ``prefix`` and one of these words are replaced: ``drawn_rows`` finds a free prefix.
    """
    return rated(measured(docs, text_col, prefix), targets, keep, power, seed, id_col, sweeps, prefix)


def drawn_rows(docs: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` that ``mix`` draws, with the columns of ``docs`` alone, whatever their names."""
    prefix = "__"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    return mix(docs, prefix=prefix, **settings).where(exactly(f"{prefix}drawn")).select(*[exactly(c) for c in docs.columns])


def mix_sql(keep: float, power: float, seed: str, sweeps: int) -> str:
    """The same in SQL: sweeps written out one after the other. A step tries, for each cell of a key, the
    factor at which that cell is just full, and solves the stretch in which the target lies."""
    counts = [" + ".join(f"((length(t) - length(replace(t, '{n}', ''))) // {len(n)})" for n in needles) for needles in TOPICS.values()]
    best = f"greatest({', '.join(counts)})"
    topic = " ".join(f"WHEN {c} = {best} THEN '{t}'" for t, c in zip(TOPICS, counts))

    def solved(name: str, table: str, part: str, weight: str, target: str) -> str:
        # per key: the cells full at a factor, and the largest factor that a cell fills at while the sum stays below the target
        return f"""{name}_f AS MATERIALIZED (SELECT a.{part} AS k, a.f, sum(least(b.tokens, b.{weight} * a.f)) AS reached,
    any_value(b.{target}) AS target FROM (SELECT DISTINCT {part}, tokens / {weight} AS f FROM {table}) a JOIN {table} b ON a.{part} = b.{part} GROUP BY ALL),
  {name}_l AS MATERIALIZED (SELECT k, coalesce(max(f) FILTER (reached <= target), 0) AS low, max(f) AS high, max(reached) <= any_value(target) AS whole FROM {name}_f GROUP BY k),
  {name}_s AS MATERIALIZED (SELECT k, CASE WHEN any_value(whole) THEN any_value(high) ELSE
     (any_value({target}) - coalesce(sum(tokens) FILTER (tokens / {weight} <= low), 0)) / sum({weight}) FILTER (tokens / {weight} > low) END AS f
    FROM {table} JOIN {name}_l ON {part} = k GROUP BY k)"""

    steps, last = [], "cells0"
    for d in DIMENSIONS:
        steps.append(f"""p_{d} AS MATERIALIZED (SELECT {d}, 1 AS one, sum(tokens) AS tokens, power(sum(tokens)::DOUBLE, {power}) AS p, {keep} * (SELECT sum(tokens) FROM cells)::DOUBLE AS budget
    FROM cells GROUP BY {d})""")
        steps.append(solved(f"q_{d}", f"p_{d}", "one", "p", "budget"))
        steps.append(f"t_{d} AS MATERIALIZED (SELECT {d}, least(tokens, p * f) AS target FROM p_{d} JOIN q_{d}_s ON one = k)")
    steps.append(f"""cells0 AS MATERIALIZED (SELECT source, lang, topic, tokens, tokens::DOUBLE AS w, {', '.join(f't_{d}.target AS t_{d}' for d in DIMENSIONS)}
    FROM cells {' '.join(f'JOIN t_{d} USING ({d})' for d in DIMENSIONS)})""")
    for i in range(sweeps):
        for d in DIMENSIONS:
            steps.append(solved(f"s{i}{d}", last, d, "w", f"t_{d}"))
            steps.append(f"w{i}{d} AS MATERIALIZED (SELECT c.* REPLACE (w * f AS w) FROM {last} c JOIN s{i}{d}_s ON c.{d} = k)")
            last = f"w{i}{d}"
    misses = ", ".join(f"abs(sum(least(tokens, w)) OVER (PARTITION BY {d}) / t_{d} - 1)" for d in DIMENSIONS)
    return f"""WITH d AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, coalesce(text, '') AS t,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens FROM documents),
  m AS MATERIALIZED (SELECT doc_id, source, lang, n_tokens, CASE WHEN {best} = 0 THEN 'prose' {topic} END AS topic FROM d),
  cells AS MATERIALIZED (SELECT source, lang, topic, sum(n_tokens)::BIGINT AS tokens FROM m GROUP BY ALL HAVING sum(n_tokens) > 0),
  {', '.join(steps)},
  r AS (SELECT source, lang, topic, round(least(tokens, w) / tokens, 6) AS rate, round(greatest({misses}), 4) AS off FROM {last})
SELECT m.doc_id, m.source, m.lang, m.topic, m.n_tokens, r.off,
  CASE WHEN m.n_tokens > 0 THEN coalesce(r.rate, 0.0) ELSE 0.0 END AS rate,
  ('0x' || substr(md5('{seed}' || coalesce(m.doc_id::VARCHAR, '')), 1, 8))::BIGINT / 4294967296.0
    < CASE WHEN m.n_tokens > 0 THEN coalesce(r.rate, 0.0) ELSE 0.0 END AS drawn
FROM m LEFT JOIN r USING (source, lang, topic)"""
