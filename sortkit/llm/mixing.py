"""Mixing sources to target weights by iterative proportional fitting.

Token weights are summed in cells of the margin columns.  Each step scales the cells so that one
margin's sums meet their targets; steps go round the margins until all are met, and a warning tells the margin
error if they aren't after ``ROUNDS`` (targets that no weights of these cells can meet).  A document of a cell is
kept with the probability ``min(1, s * ratio)``, where ratio is the cell's fitted by its counted tokens and s is such
that ``keep`` of all tokens are expected to stay: rare cells that are wanted more often than they occur stay whole, and
don't lower the others' share.

All of it is DataFrame work.  The cells, one row for each combination of margin values, are gathered in one
partition if there are at most ``MOST_CELLS`` of them; more are raked as a distributed table, by grouped sums and joins.

Defined results: a null margin value is the value ``(none)``; null or empty text has 0 tokens and
is kept by its cell's probability; a cell without tokens has ratio 1; an empty
table gives no rows; repeated ids are kept or dropped together; other columns, whatever their names, don't matter.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sortkit.llm.common import cut

#: Rounds over all margins at most; rounds end when no cell changes by a larger part than the tolerance.
ROUNDS = 40
TOLERANCE = 1e-10
ROUNDS_PER_JOB = 4
#: Margin targets are the counted shares to this power, made to sum to 1.
TEMPER = 0.7
#: Share of all tokens that are expected to be kept.
KEEP = 0.6
#: Cells up to this number are raked in one partition, more as a distributed table.
MOST_CELLS = 50_000
#: Largest difference between a margin's share and its target that passes without a warning.
MARGIN_ERROR = 1e-3
#: Digits of weights and probabilities shown; drawing uses them unrounded.
DIGITS = 9
#: Cells up to this number are broadcast to the documents (about 100 bytes each).
BROADCAST_CELLS = 20_000
NONE = "(none)"
WORD = r"[^\x20\x09-\x0D]+"


def topic_of(text: str | Column) -> Column:
    """A topic by plain marks of a text's matter: licence, records, table or prose."""
    t = F.col(text) if isinstance(text, str) else text
    return (
        F.when(F.lower(t).contains("licen"), "licence")
        .when(t.rlike(r"[0-9]{8}"), "records")
        .when(t.contains("|"), "table")
        .otherwise("prose")
    )


def with_tokens(docs: DataFrame, margins: Mapping[str, Column], text_col: str, id_col: str) -> DataFrame:
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("tokens"),
        *(F.coalesce(c.cast("string"), F.lit(NONE)).alias(f"m_{k}") for k, c in margins.items()),
    )


def _over(df: DataFrame, margin: str, value: Column, wide: bool) -> DataFrame:
    """``df`` with ``_sum``, the sum of ``value`` over the rows that share the margin's value."""
    if not wide:
        return df.withColumn("_sum", F.sum(value).over(Window.partitionBy(margin)))
    return df.join(df.groupBy(margin).agg(F.sum(value).alias("_sum")), margin)


def rake(cells: DataFrame, margins: Sequence[str], targets: Mapping[str, Mapping[str, float]] | None = None, temper: float = TEMPER, rounds: int = ROUNDS, wide: bool = False) -> DataFrame:
    """``cells`` (margin columns and ``base``) with ``weight``, fitted to the targets; ``wide`` keeps them distributed.

    ``targets`` gives shares by margin and value; values without one get 0.  A margin without
    targets gets its tempered counted shares."""
    together = (lambda t: t) if wide else (lambda t: t.coalesce(1))
    total = float(cells.agg(F.sum("base")).first()[0] or 0.0)
    one = together(cells).withColumn("total", F.lit(total))
    for m in margins:
        if targets and m in targets:
            given = F.create_map(*(F.lit(x) for kv in targets[m].items() for x in kv))
            one = one.withColumn(f"t_{m}", F.coalesce(given[F.col(m)].cast("double"), F.lit(0.0)))
        else:
            # a row's part of its value's tempered share: the rows of a value share it evenly
            one = _over(one, m, F.col("base"), wide).withColumn(f"s_{m}", F.pow(F.col("_sum") / F.col("total"), F.lit(float(temper)))).drop("_sum")
            each = cells.groupBy(m).agg(F.pow(F.sum("base") / F.lit(total), F.lit(float(temper))).alias("s")) if total else None
            norm = float(each.agg(F.sum("s")).first()[0] or 0.0) if total else 0.0
            one = one.withColumn(f"t_{m}", F.col(f"s_{m}") / F.lit(norm) if norm else F.lit(0.0)).drop(f"s_{m}")
    one = cut(one.withColumn("weight", F.col("base").cast("double")))
    for done in range(0, rounds, ROUNDS_PER_JOB):
        one = together(one)
        for _ in range(min(ROUNDS_PER_JOB, rounds - done)):
            one = one.withColumn("before", F.col("weight"))
            for m in margins:
                one = _over(one, m, F.col("weight"), wide)
                one = one.withColumn("weight", F.when(F.col("_sum") > 0, F.col("weight") * F.col(f"t_{m}") * F.col("total") / F.col("_sum")).otherwise(F.col("weight"))).drop("_sum")
        one = cut(one)
        change = one.agg(F.max(F.abs(F.col("weight") - F.col("before")) / F.greatest(F.col("before"), F.lit(1e-300)))).first()[0] or 0.0
        if change < TOLERANCE:
            break
    # rounds also settle into a cycle where no weights meet all targets, so the margins are looked at themselves
    if total:
        met = one
        for m in margins:
            met = _over(met, m, F.col("weight"), wide).withColumn(f"e_{m}", F.abs(F.col("_sum") / F.col("total") - F.col(f"t_{m}"))).drop("_sum")
        error = max(met.agg(*(F.max(f"e_{m}") for m in margins)).first(), default=0.0)
        if error > MARGIN_ERROR:
            warnings.warn(f"margins are met within {error:.4f} only", stacklevel=2)
    return one.select(*margins, "base", "weight")


def scale(cells: DataFrame, keep: float) -> float:
    """s such that the sum of ``base * min(1, s * ratio)`` is ``keep`` of the tokens; infinite if all are to be kept.
    Each step takes the cells that reach 1 as whole and fits the rest to what remains, until no other cell reaches 1."""
    total = float(cells.agg(F.sum("base")).first()[0] or 0.0)
    s, whole = 0.0, -1
    while total and keep < 1:
        capped = (F.lit(s) * F.col("ratio") >= 1) & (F.col("base") > 0)
        n, base, rest = cells.agg(F.sum(capped.cast("long")), F.sum(F.when(capped, F.col("base")).otherwise(0)), F.sum(F.when(capped, F.lit(0.0)).otherwise(F.col("weight")))).first()
        if n == whole:
            return s
        if not rest:
            break
        whole, s = n, (keep * total - float(base)) / float(rest)
    return float("inf")


def ratios(rows: DataFrame, names: Sequence[str], targets: Mapping[str, Mapping[str, float]] | None, temper: float, rounds: int, keep: float) -> tuple[DataFrame, bool]:
    """``(<names>, ratio, p)`` for each cell of ``with_tokens`` rows, and whether they are few enough to broadcast."""
    cells = cut(rows.groupBy(*names).agg(F.sum("tokens").alias("base")))
    n = cells.count()
    fitted = rake(cells, names, {f"m_{k}": v for k, v in (targets or {}).items()}, temper, rounds, n > MOST_CELLS)
    fitted = cut(fitted.withColumn("ratio", F.when(F.col("base") > 0, F.col("weight") / F.col("base")).otherwise(F.lit(1.0))))
    s = scale(fitted, keep)
    p = F.least(F.lit(1.0), F.lit(s) * F.col("ratio")) if s < float("inf") else F.when(F.col("ratio") > 0, F.lit(1.0)).otherwise(F.lit(0.0))
    return fitted.select(*names, "ratio", p.alias("p")), n <= BROADCAST_CELLS


def draw(id_: Column, salt: str) -> Column:
    """A number in [0, 1) that depends on the id only."""
    digest = F.md5(F.concat(F.lit(salt + ":"), F.coalesce(id_.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(2.0**32)


def shown(c: str) -> Column:
    """Rounded, but never to 0."""
    return F.when((F.round(c, DIGITS) == 0) & (F.col(c) > 0), F.col(c)).otherwise(F.round(c, DIGITS))


def mix(docs: DataFrame, margins: Mapping[str, Column], targets: Mapping[str, Mapping[str, float]] | None = None, *, id_col: str = "doc_id", text_col: str = "text", temper: float = TEMPER, rounds: int = ROUNDS, salt: str = "mix", keep: float = KEEP) -> DataFrame:
    """``(doc_id, tokens, <margins>, weight, probability, selected)`` for every row; ``weight`` is the
    fitted tokens for each token counted in the row's cell."""
    rows = with_tokens(docs, margins, text_col, id_col)
    names = [f"m_{k}" for k in margins]
    fitted, small = ratios(rows, names, targets, temper, rounds, keep)
    out = rows.join(F.broadcast(fitted) if small else fitted, names)
    return out.select(
        F.col("doc_id").alias(id_col), "tokens", *(F.col(f"m_{k}").alias(k) for k in margins),
        shown("ratio").alias("weight"), shown("p").alias("probability"), (draw(F.col("doc_id"), salt) < F.col("p")).alias("selected"),
    )


def sample(docs: DataFrame, margins: Mapping[str, Column], targets: Mapping[str, Mapping[str, float]] | None = None, *, id_col: str = "doc_id", text_col: str = "text", temper: float = TEMPER, rounds: int = ROUNDS, salt: str = "mix", keep: float = KEEP) -> DataFrame:
    """The selected rows of ``docs`` with their own columns."""
    names = [f"m_{k}" for k in margins]
    fitted, small = ratios(with_tokens(docs, margins, text_col, id_col), names, targets, temper, rounds, keep)
    # a row's own columns travel as one, so that none can clash with the cells'
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.col(id_col).alias("_id"), *(F.coalesce(c.cast("string"), F.lit(NONE)).alias(f"m_{k}") for k, c in margins.items()))
    rows = rows.join(F.broadcast(fitted) if small else fitted, names)
    return rows.where(draw(F.col("_id"), salt) < F.col("p")).select("_row.*")


def document_margins() -> dict[str, Column]:
    return {"source": F.col("source"), "lang": F.col("lang"), "topic": topic_of("text")}


def oracle_sql(table: str = "documents", temper: float = TEMPER, rounds: int = ROUNDS, salt: str = "mix", keep: float = KEEP) -> str:
    """DuckDB SQL for ``mix(table, document_margins())``."""
    margins = ["source", "lang", "topic"]
    by = ", ".join(margins)
    out = [f"""
WITH rows AS (
  SELECT doc_id, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS tokens,
         coalesce(source, '{NONE}') AS source, coalesce(lang, '{NONE}') AS lang,
         CASE WHEN contains(lower(text), 'licen') THEN 'licence' WHEN regexp_matches(text, '[0-9]{{8}}') THEN 'records'
              WHEN contains(text, '|') THEN 'table' ELSE 'prose' END AS topic
  FROM {table}),
cells AS (SELECT {by}, sum(tokens)::DOUBLE AS base FROM rows GROUP BY {by})"""]
    for m in margins:
        out.append(f"""
t_{m} AS (SELECT {m}, s / sum(s) OVER () AS t FROM (SELECT {m}, pow(sum(base) / (SELECT sum(base) FROM cells), {temper}) AS s FROM cells GROUP BY {m}))""")
    out.append(f"""
w0 AS (SELECT {by}, base, base AS weight, (SELECT sum(base) FROM cells) AS total FROM cells)""")
    k = 0
    for _ in range(rounds):
        for m in margins:
            out.append(f"""
w{k + 1} AS MATERIALIZED (SELECT {by}, base, total, CASE WHEN sum(weight) OVER (PARTITION BY {m}) > 0
  THEN weight * t * total / sum(weight) OVER (PARTITION BY {m}) ELSE weight END AS weight FROM w{k} JOIN t_{m} USING ({m}))""")
            k += 1
    show = lambda c: f"CASE WHEN round({c}, {DIGITS}) = 0 AND {c} > 0 THEN {c} ELSE round({c}, {DIGITS}) END"
    return ",".join(out) + f""",
r AS (SELECT {by}, base, weight, total, CASE WHEN base > 0 THEN weight / base ELSE 1 END AS ratio FROM w{k}),
c AS (SELECT *, ({keep} * total - (sum(base) OVER o - base)) / nullif(sum(CASE WHEN base > 0 THEN weight ELSE 0 END) OVER u, 0) AS s,
             row_number() OVER o AS n FROM r WHERE base > 0
      WINDOW o AS (ORDER BY ratio DESC, {by} ROWS UNBOUNDED PRECEDING), u AS (ORDER BY ratio DESC, {by} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
s AS (SELECT arg_min(s, n) AS s FROM c WHERE s * ratio <= 1),
p AS (SELECT {by}, ratio, CASE WHEN s IS NULL THEN (ratio > 0)::INT::DOUBLE ELSE least(1, s * ratio) END AS p FROM r, s)
SELECT doc_id, tokens, {by}, {show("ratio")} AS weight, {show("p")} AS probability,
       ('0x' || substr(md5('{salt}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8))::BIGINT / 4294967296.0 < p AS selected
FROM rows JOIN p USING ({by})
"""
