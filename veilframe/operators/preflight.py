"""What suppression would cost, and which quasi-identifiers cost most.

The class table is made once, and for l-diversity the counts of each sensitive value in
each class. Each step of the search is one GROUPING SETS query over them that measures every
subset with one column less, whatever the number of rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.errors import PolicyError
from veilframe.operators.kanon import cardinalities, checked, class_metrics, class_table, value_table

MOST_QIS = 15


@dataclass(frozen=True)
class Step:
    """A column that is left out, and the rows that would still be suppressed."""

    column: str
    rows_suppressed: int
    ratio: float
    improvement: float


def drop_each(classes: DataFrame, qis: list[str], at: list[int], k: int) -> DataFrame:
    """(left_out, rows_suppressed, rows_total): each of the columns left out in turn."""
    names = [f"q{i}" for i in at]
    sets = [[n for n in names if n != out] for out in names]
    sizes = classes.groupingSets([[F.col(n) for n in s] for s in sets], *[F.col(n) for n in names]).agg(F.grouping_id().alias("gid"), F.sum("size").alias("size"))
    # grouping_id sets the bit of the column that is left out; the first name has the highest.
    place = F.lit(len(names) - 1) - F.log2(F.col("gid").cast("double")).cast("int")
    sums = sizes.groupBy("gid").agg(F.sum(F.when(F.col("size") < k, F.col("size")).otherwise(0)).alias("rows_suppressed"), F.sum("size").alias("rows_total"))
    which = F.element_at(F.array(*[F.lit(qis[i]) for i in at]), place + 1)
    return sums.select(which.alias("left_out"), F.col("rows_suppressed").cast("long").alias("rows_suppressed"), F.col("rows_total").cast("long").alias("rows_total"))


def drop_each_diverse(values: list[DataFrame], qis: list[str], at: list[int], k: int, l: int) -> DataFrame:
    """The same where l-diversity counts too, from a table of (classes, value, size) for each sensitive column.

    A class is suppressed if it is too small, or if one of the columns has too few values in it.
    """
    names = [f"q{i}" for i in at]
    sets = [[n for n in names if n != out] for out in names]
    place = F.lit(len(names) - 1) - F.log2(F.shiftright("gid", 1).cast("double")).cast("int")
    rows = None
    for number, table in enumerate(values):
        # Values stay in each set, so the bit of s, the last one, is never set.
        each = table.groupingSets([[F.col(n) for n in s] + [F.col("s")] for s in sets], *[F.col(n) for n in names], F.col("s"))
        each = each.agg(F.grouping_id().alias("gid"), F.sum("size").alias("size"))
        each = each.groupBy("gid", *names).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("d")).withColumn("column", F.lit(number))
        rows = each if rows is None else rows.union(each)
    classes = rows.groupBy("gid", *names).agg(F.max("size").alias("size"), F.min("d").alias("d"))
    gone = (F.col("size") < k) | (F.col("d") < l)
    sums = classes.groupBy("gid").agg(F.sum(F.when(gone, F.col("size")).otherwise(0)).alias("rows_suppressed"), F.sum("size").alias("rows_total"))
    which = F.element_at(F.array(*[F.lit(qis[i]) for i in at]), place + 1)
    return sums.select(which.alias("left_out"), F.col("rows_suppressed").cast("long").alias("rows_suppressed"), F.col("rows_total").cast("long").alias("rows_total"))


def _impact(classes: DataFrame, values: list[DataFrame], qis: list[str], left: list[str], k: int, l: int, base: int, total: int) -> list[Step]:
    if len(left) < 2:
        return []
    at = [qis.index(c) for c in left]
    measured = drop_each_diverse(values, qis, at, k, l) if values else drop_each(classes, qis, at, k)
    found = {r.left_out: r.rows_suppressed for r in measured.collect()}  # a row a column
    share = lambda n: n / total if total else 0.0
    return [Step(c, found.get(c, 0), share(found.get(c, 0)), share(base) - share(found.get(c, 0))) for c in left]


def preflight(df: DataFrame, qis: list[str], k: int, sensitive: list[str] | None = None, l: int = 1, soft_cap: float = 0.10, hard_cap: float = 0.50) -> dict:
    """Metrics, worst columns, the effect of leaving each out, and a greedy plan."""
    qis, sensitive = checked(df, qis, k, sensitive or [], l)
    if len(qis) > MOST_QIS:
        raise PolicyError(f"more than {MOST_QIS} quasi-identifiers")
    if not qis:
        n = df.count()
        return {"rows_total": n, "rows_suppressed": 0, "ratio": 0.0, "k_achieved": n, "cardinalities": [], "drop_one": [], "plan": None, "suggestions": ["There are no quasi-identifiers, so nothing is suppressed."]}
    classes = class_table(df, qis, sensitive if l > 1 else []).persist()
    values = [value_table(df, qis, c).persist() for c in sensitive] if l > 1 else []
    try:
        base = class_metrics(classes, k, l, sensitive if l > 1 else []).first()
        total, now = base.rows_total, base.rows_suppressed
        ratio = now / total if total else 0.0
        distinct = cardinalities(df, qis)
        many = dict(distinct)
        ones = _impact(classes, values, qis, qis, k, l, now, total)
        target = hard_cap if ratio > hard_cap else soft_cap
        plan, left, at = [], list(qis), ratio
        steps = ones
        while at > target and len(left) > 1:
            best = min(steps, key=lambda s: (s.ratio, -s.improvement, -many[s.column], s.column))
            plan.append(best)
            left.remove(best.column)
            at = best.ratio
            steps = _impact(classes, values, qis, left, k, l, best.rows_suppressed, total)
    finally:
        for table in (classes, *values):
            table.unpersist()
    out = {"rows_total": total, "rows_suppressed": now, "ratio": ratio, "k_achieved": base.k_achieved, "classes_total": base.classes_total, "classes_below_k": base.classes_below_k, "soft_cap": soft_cap, "hard_cap": hard_cap, "cardinalities": distinct}
    out["drop_one"] = sorted(ones, key=lambda s: -s.improvement)
    out["plan"] = {"steps": plan, "columns": [s.column for s in plan], "final_ratio": at, "target": target, "reaches_target": at <= target} if ratio > target else None
    out["suggestions"] = _advice(out)
    return out


def _advice(found: dict) -> list[str]:
    ratio, plan = found["ratio"], found["plan"]
    if ratio > found["hard_cap"]:
        out = [f"{ratio:.1%} of rows would be suppressed, beyond the hard cap of {found['hard_cap']:.0%}; a run is refused."]
    elif ratio > found["soft_cap"]:
        out = [f"{ratio:.1%} of rows would be suppressed, beyond the soft cap of {found['soft_cap']:.0%}; a run needs an override."]
    else:
        return [f"{ratio:.1%} of rows would be suppressed, within the caps."]
    if found["cardinalities"]:
        out.append(f"The column with most distinct values is {found['cardinalities'][0][0]}; coarser values or leaving it out help most often.")
    if plan and plan["columns"]:
        reach = "reaches" if plan["reaches_target"] else "does not reach"
        out.append(f"Leaving out {', then '.join(plan['columns'])} {reach} the target: {plan['final_ratio']:.1%} would remain.")
    return out
