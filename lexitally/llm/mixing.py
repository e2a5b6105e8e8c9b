"""Mixing sources to target weights: raking by iterative proportional fitting.

Tokens are added up per cell, a combination of the values of all dimensions. Probabilities of
the cells begin equal and are fitted to the wanted tokens of each dimension's values in turn;
documents are then sampled with the probability of their cell.

A value that is wanted more than it holds is taken whole, and what it lacks is shared out among
the others of its dimension by their weights, so that every dimension has the whole budget.
Cells keep a weight, of which the probability is what lies below one: a cell that is full goes
on being fitted, and others of its values make up for it. This ends when all margins are met to
`TOLERANCE`; where they contradict each other, after `ROUNDS`, and the error tells how far off
they are.

Only the table of cells is gone over again and again; it is written between rounds. Its size
is that of the combinations that occur, not of the documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexitally.session import written

# Rounds over all dimensions at most, and the largest relative error of a margin that ends them.
ROUNDS, TOLERANCE = 64, 1e-9
# Bytes of text per token, by which tokens are estimated; every document has one more.
BYTES_PER_TOKEN = 4
# Sizes, in bytes, at which a text changes its class.
CLASSES = (("note", 512), ("page", 4096), ("article", 32768))


def tokens(text_col: str = "text") -> Column:
    size = F.octet_length(F.coalesce(F.col(text_col), F.lit("")))
    return (1 + F.floor(size / BYTES_PER_TOKEN)).cast("long")


def size_class(text_col: str = "text") -> Column:
    """Stands for the topic where a table has none: the class of the text's size."""
    size = F.octet_length(F.coalesce(F.col(text_col), F.lit("")))
    found = F.lit("book")
    for name, below in reversed(CLASSES):
        found = F.when(size < below, name).otherwise(found)
    return found


def tempered(power: float) -> Column:
    """Weights between those of the table (1) and equal ones (0)."""
    return F.pow("tokens", F.lit(power))


def given(weights: dict[str, float], others: float = 0.0) -> Column:
    """Weights by value; values that are not named get ``others``."""
    found = F.lit(others)
    for value, weight in weights.items():
        found = F.when(F.col("value") == value, float(weight)).otherwise(found)
    return found


def wanted(sums: DataFrame, share: float) -> DataFrame:
    """``sums`` (``value, tokens, weight``) with ``want``: the share of all tokens, dealt out by
    weight, with no value getting more than it has while another can still take some."""
    total, weights = F.sum("tokens"), F.sum("weight")
    whole = sums.agg(total.alias("tokens"), weights.alias("weights")).first()
    budget = share * (whole["tokens"] or 0)
    level, before = budget / (whole["weights"] or 1.0), None
    # More values are full each time, until none is added.
    while level != before:
        full = F.col("tokens") <= F.lit(level) * F.col("weight")
        left = sums.agg(
            F.sum(F.when(full, F.col("tokens"))).alias("tokens"),
            F.sum(F.when(~full, F.col("weight"))).alias("weights"),
        ).first()
        if not left["weights"]:
            break
        before, level = level, (budget - (left["tokens"] or 0)) / left["weights"]
    most = F.least(F.col("tokens").cast("double"), F.lit(float(level)) * F.col("weight"))
    return sums.withColumn("want", most)


def fitted(
    cells: DataFrame, targets: dict[str, Column], share: float, rounds: int = ROUNDS
) -> DataFrame:
    """``cells`` (the dimensions and ``tokens``) with ``probability`` and ``error``, the largest
    relative error of a margin.

    ``targets`` gives for each dimension the weight of its values, as a column over
    ``value`` and ``tokens``; weights need not sum to anything. ``share`` of all tokens is
    wanted in total. Where all weights of a dimension are zero, nothing is wanted.
    """
    wants = {}
    now = cells.withColumn("w", F.lit(float(share)))
    for name, weight in targets.items():
        sums = cells.groupBy(F.col(name).alias("value")).agg(F.sum("tokens").alias("tokens"))
        sums = written(sums.withColumn("weight", weight.cast("double")), "mixing-targets")
        wants[name] = F.col(f"want_{name}")
        want = wanted(sums, share).select(F.col("value").alias(name), F.col("want").alias(f"want_{name}"))
        now = now.join(want, name)
    now = written(now, "mixing-cells")
    columns = now.columns
    probability = F.least(F.lit(1.0), F.col("w"))
    full = F.col("w") >= 1
    for _ in range(rounds):
        now = now.withColumn("error", F.lit(0.0))
        for name, want in wants.items():
            have = now.groupBy(name).agg(
                F.sum(F.col("tokens") * probability).alias("have"),
                F.sum(F.when(full, F.col("tokens")).otherwise(0)).alias("filled"),
                F.sum(F.when(full, 0.0).otherwise(F.col("tokens") * F.col("w"))).alias("rest"),
            )
            lacks = want - F.col("filled")
            factor = (
                F.when((lacks > 0) & (F.col("rest") > 0), lacks / F.col("rest"))
                .when(F.col("have") > 0, want / F.col("have"))
                .otherwise(1.0)
            )
            off = F.abs(F.col("have") - want) / F.greatest(want, F.lit(1e-9))
            now = now.join(have, name).select(
                *[(F.col("w") * factor).alias("w") if c == "w" else c for c in columns],
                F.greatest("error", off).alias("error"),
            )
        now = written(now, "mixing-cells")
        error = now.agg(F.max("error").alias("error")).first()["error"]
        now = now.drop("error")
        if error is None or error < TOLERANCE:
            break
    return now.select(*cells.columns, probability.alias("probability"), F.lit(error or 0.0).alias("error"))


def draw(id_col: str, seed: str) -> Column:
    """A number from 0 to 1 that depends on the id and the seed only."""
    key = F.concat(F.lit(seed), F.lit(":"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / float(1 << 52)


def mixed(
    docs: DataFrame,
    dimensions: dict[str, Column],
    targets: dict[str, Column],
    share: float,
    id_col: str = "doc_id",
    text_col: str = "text",
    seed: str = "mix",
    rounds: int = ROUNDS,
) -> DataFrame:
    """``row`` (the row itself), the dimensions, ``tokens``, ``probability``, ``kept``, and
    ``error``, how far the margins are off at most, relative to what was wanted.

    Every row is returned, repeated ones too; rows of one id are kept or left together. A
    null value of a dimension is the same as an empty one. A null text has one token. An
    empty table gives no rows. The columns of ``docs`` lie in ``row`` only, so none of
    their names can clash.
    """
    named = {f"d{i}": name for i, name in enumerate(dimensions)}
    rows = docs.select(
        F.struct("*").alias("row"),
        *[
            F.coalesce(dimensions[name].cast("string"), F.lit("")).alias(short)
            for short, name in named.items()
        ],
        tokens(text_col).alias("tokens"),
        draw(id_col, seed).alias("draw"),
    )
    cells = written(rows.groupBy(*named).agg(F.sum("tokens").alias("tokens")), "mixing-sums")
    fit = fitted(cells, {short: targets[name] for short, name in named.items()}, share, rounds)
    probable = rows.join(fit.select(*named, "probability", "error"), list(named))
    return probable.select(
        "row",
        *[F.col(short).alias(name) for short, name in named.items()],
        "tokens",
        "probability",
        (F.col("draw") < F.col("probability")).alias("kept"),
        "error",
    )
