"""Mixing sources to target weights by iterative proportional fitting.

Tokens (words) are summed by source, language and topic. The tokens to keep of each cell are raked until the
shares of all three marginals meet their targets, and never pass what the cell has; each document is then kept with
its cell's calibrated probability, kept over present, decided by a hash of its doc_id. So the kept tokens have
the targets' shares and are ``rate`` of all tokens in expectation, as far as the cells hold enough. Everything is DataFrame
operations: one pre-aggregated pass over the documents, and rounds over the table of cells, each staged.

Targets: for each marginal a DataFrame (value, share), or by default its own shares tempered: the share to
the power ``temper``, made to add up to one. Values without a target, and targets without documents, are
left out of the raking of that marginal (factor 1); targets are scaled to the mass of those present.

Rounds end when the worst share lies within ``near`` of its target, or when no cell moves any more (targets that the
cells can't fill, or that contradict each other). A gap that is left then is told by a warning.

Defined results: null source, lang or topic is a cell value of its own ('(none)'); null or empty texts
weigh no tokens and are kept with their cell's probability; rows of equal doc_id are decided alike, and a
null doc_id hashes like any value; an empty table gives an empty table; columns of any other name pass through.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

MARGINS = ("source", "lang", "topic")
TEMPER, RATE, ROUNDS, NEAR = 0.9, 0.9, 20, 1e-4
#: Cells up to which their rounds run in one task.
FEW = 50_000


def topic() -> Column:
    """A document's register, by its whole text: how it is written stands in for what it is about."""
    n = F.greatest(F.length("text"), F.lit(1))
    share = lambda chars: (F.length("text") - F.length(F.translate("text", chars, ""))) / n
    return (
        F.when(F.col("text").isNull(), None).when(share("#*$%&|<>{}=;") > 0.03, "markup").when(share("0123456789") > 0.05, "figures").when(share("ABCDEFGHIJKLMNOPQRSTUVWXYZ") > 0.3, "capitals").when(n > 6000, "long prose").when(n > 1000, "prose").otherwise("notes")
    )


def words() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("double")


def amounts(cells: DataFrame, margin: str, targets: DataFrame | None, temper: float, rate: float) -> DataFrame:
    """(value, amount): the tokens to keep of each of the margin's values that has a target and tokens."""
    own = cells.groupBy(margin).agg(F.sum("n").alias("n")).where("n > 0")
    if targets is None:
        own = own.withColumn("share", F.pow("n", F.lit(temper)))
    else:
        own = own.join(targets.toDF(margin, "share"), margin)
    own = stage(own.where("share > 0"))
    scale = own.agg(F.lit(rate) * F.sum("n") / F.sum("share")).scalar()
    return stage(own.select(margin, (F.col("share") * scale).alias("amount")))


def with_sum(cells: DataFrame, margin: str, name: str) -> DataFrame:
    """``cells`` with the sum of w over its value of the margin: in one partition by a window, else by a join, which splits hot values."""
    if cells.rdd.getNumPartitions() == 1:
        return cells.withColumn(name, F.sum("w").over(Window.partitionBy(margin)))
    return cells.join(cells.groupBy(margin).agg(F.sum("w").alias(name)), margin)


def rake(cells: DataFrame, goals: dict[str, DataFrame], rate: float, rounds: int = ROUNDS, near: float = NEAR) -> DataFrame:
    """``cells`` (margins, n) with ``w``: tokens to keep, n at most, so that each margin's values have their amounts."""
    # a table of counted, small size stays in one partition, so its rounds need no exchange
    few = cells.count() <= FEW
    placed = (lambda x: stage(x.coalesce(1)).coalesce(1)) if few else stage
    cells = cells.withColumn("w", F.col("n") * F.lit(float(rate)))
    for margin in MARGINS:
        cells = cells.join(goals[margin].withColumnRenamed("amount", f"amount_{margin}"), margin, "left")
    cells, worst = placed(cells), None
    total = cells.agg(F.sum("n")).first()[0] or 0.0
    for k in range(rounds):
        cells = cells.withColumn("was", F.col("w"))
        for margin in MARGINS:
            cells = with_sum(cells, margin, "have")
            cells = cells.withColumn("w", F.least(F.col("n"), F.col("w") * F.coalesce(F.col(f"amount_{margin}") / F.nullif("have", F.lit(0.0)), F.lit(1.0)))).drop("have")
        if few and k % 2 == 0 and k + 1 < rounds:
            continue  # two rounds make a plan of fair size
        cells = placed(cells)
        off = cells
        for margin in MARGINS:
            off = with_sum(off, margin, f"have_{margin}")
        gaps = (F.max(F.abs(F.col(f"have_{m}") - F.col(f"amount_{m}"))) for m in MARGINS)
        *apart, moved = off.agg(*gaps, F.max(F.abs(F.col("w") - F.col("was")))).first()
        apart = [x for x in apart if x is not None]
        if not apart or not total:
            return cells
        worst = max(apart) / (rate * total)
        if worst < near:
            return cells
        if moved / total < near / 10:
            break
    if worst is not None:
        warnings.warn(f"the kept shares miss a target by {worst:.4f} at worst", stacklevel=2)
    return cells


def measured(docs: DataFrame, by: tuple = ("source", "lang", None)) -> DataFrame:
    """``row`` (all columns of ``docs``), the three margins and tokens. by: the columns of the margins; None stands for ``topic()``."""
    kind = [F.coalesce(F.col(c).cast("string") if isinstance(c, str) else topic(), F.lit("(none)")).alias(m) for m, c in zip(MARGINS, by, strict=True)]
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *kind, words().alias("tokens"))


def mix(marked: DataFrame, targets: dict[str, DataFrame] | None = None, temper: float = TEMPER, rate: float = RATE, rounds: int = ROUNDS, near: float = NEAR, seed: int = 42) -> DataFrame:
    """``marked`` (of ``measured``) with probability, factor (probability over ``rate``) and kept."""
    cells = stage(marked.groupBy(*MARGINS).agg(F.sum("tokens").alias("n")))
    goals = {m: amounts(cells, m, (targets or {}).get(m), temper, rate) for m in MARGINS}
    chances = stage(rake(cells, goals, rate, rounds, near).select(*(F.col(m).alias(f"{m}_of") for m in MARGINS), F.when(F.col("n") > 0, F.col("w") / F.col("n")).otherwise(F.lit(float(rate))).alias("probability")))
    same = F.lit(True)
    for m in MARGINS:
        same = same & (F.col(m) == F.col(f"{m}_of"))
    draw = F.pmod(F.xxhash64(F.col("row.doc_id"), F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    out = marked.join(chances, same, "left").drop(*(f"{m}_of" for m in MARGINS))
    return out.withColumns({"factor": F.col("probability") / F.lit(float(rate)), "kept": draw < F.col("probability")})


def sample(docs: DataFrame, by: tuple = ("source", "lang", None), **options) -> DataFrame:
    """The kept rows of ``docs``, with its own columns."""
    return mix(measured(docs, by), **options).where("kept").select("row.*")


def report(docs: DataFrame, by: tuple = ("source", "lang", None), **options) -> DataFrame:
    """doc_id, source, lang, topic, tokens, factor, probability, kept of every document."""
    own = measured(docs.select(*dict.fromkeys(("doc_id", "text", *(c for c in by if c)))), by)
    m = mix(stage(own.select(F.struct("row.doc_id").alias("row"), *MARGINS, "tokens")), **options)
    return m.select("row.doc_id", *MARGINS, F.col("tokens").cast("bigint").alias("tokens"), "factor", "probability", "kept")
