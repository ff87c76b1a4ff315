"""Tables and documents made of results."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.evaluate import headline

COLUMNS = ("router", "demand", "cap_scale", "target_vc", "max_vc", "mean_s", "p95_s", "total_s", "poa", "sim_mean_s", "sim_p95_s", "gini_vc", "iters", "converged", "gap")
SOURCES = ("router", "demand_level", "capacity_scale", "target_vc", "max_vc", "mean_realized_s", "p95_realized_s", "total_network_time_s", "poa", "sim_mean_realized_s", "sim_p95_realized_s", "gini_vc", "iters", "converged", "gap")
FORMATS = ("%s", "%s", "%.2f", "%.2f", "%.4f", "%.2f", "%.2f", "%.2f", "%.4f", "%.2f", "%.2f", "%.4f", "%d", "%s", "%s")


def header() -> str:
    return "| " + " | ".join(COLUMNS) + " |"


def separator() -> str:
    return "| " + " | ".join("---" for _ in COLUMNS) + " |"


def markdown_rows(cells: DataFrame) -> DataFrame:
    """(target_vc, router, line) of result rows."""
    values = [F.col(c).cast("string") if f == "%s" else F.format_string(f, F.col(c)) for c, f in zip(SOURCES, FORMATS)]
    return cells.select("target_vc", "router", F.concat(F.lit("| "), F.concat_ws(" | ", *values), F.lit(" |")).alias("line"))


def markdown(cells: DataFrame, order: tuple[str, ...]) -> str:
    """The whole table; a report has a row per level and strategy."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("router"))
    lines = [r["line"] for r in markdown_rows(cells).orderBy("target_vc", place).collect()]
    return "\n".join([header(), separator(), *lines])


def report_json(cells: DataFrame, seed: int, od_count: int, total_vph: float) -> DataFrame:
    """One row: what was run, all cells, naive's price of anarchy at each level, and the
    level where most time is saved, as JSON. A report has a row per level and strategy."""
    one = F.struct("target_vc", "router", F.struct(*cells.columns).alias("cell"))
    level = F.struct("target_vc", F.struct("demand_level", "poa").alias("of"))
    body = cells.agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["cell"]).alias("cells"), F.transform(F.array_sort(F.collect_list(F.when(F.col("router") == "naive", level))), lambda x: x["of"]).alias("poa_by_level"))
    best = headline(cells.withColumn("total_s", F.col("total_network_time_s"))).agg(F.first(F.struct("demand_level", "router", "improvement_pct")).alias("headline_improvement"))
    return body.join(best).select(F.to_json(F.struct(F.lit(seed).alias("seed"), F.lit(od_count).alias("od_count"), F.lit(total_vph).alias("total_demand_vph"), "cells", "poa_by_level", "headline_improvement")).alias("body"))


def replace_region(text: str, name: str, body: str) -> str:
    """``text`` with what stands between the markers of ``name`` replaced; without both, in order, an error."""
    begin, end = f"<!-- {name}:begin -->", f"<!-- {name}:end -->"
    pattern = re.escape(begin) + r".*?" + re.escape(end)
    if not re.search(pattern, text, re.S):
        raise ValueError(f"no region {name}")
    return re.sub(pattern, lambda _: f"{begin}\n{body}\n{end}", text, count=1, flags=re.S)
