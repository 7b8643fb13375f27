"""Sinks for results: CSV, JSON, and reports of small results as Markdown or HTML."""

from __future__ import annotations

import html
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def describe(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, column, count, mean, std, min, p25, p50, p75, max), with exact quantiles."""
    long = df.unpivot(list(keys), list(columns), "column", "value")
    out = long.groupBy(*keys, "column").agg(F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"), F.max("value").alias("max"))
    return out.select(*keys, "column", "count", "mean", "std", "min", *[F.col("q")[i].alias(f"p{p}") for i, p in enumerate((25, 50, 75))], "max")


def write_csv(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    writer = df.write.mode("overwrite").option("header", True)
    (writer.partitionBy(*partition_by) if partition_by else writer).csv(path)


def as_json(df: DataFrame, name: str = "json") -> DataFrame:
    """One JSON text a row; times in ISO form."""
    return df.select(F.to_json(F.struct(*df.columns), {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss"}).alias(name))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def _cells(df: DataFrame, most: int) -> tuple[list[str], list[list[str]]]:
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report has at most {most} rows; aggregate first")
    return df.columns, [["" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v) for v in r] for r in rows]


def markdown(title: str, sections: dict[str, DataFrame], most: int = 500) -> str:
    """A report of small results. A result of more than `most` rows is an error, not a cut."""
    out = [f"# {title}"]
    for name, df in sections.items():
        head, rows = _cells(df, most)
        out += [f"\n## {name}\n", "| " + " | ".join(head) + " |", "|" + "---|" * len(head), *("| " + " | ".join(r) + " |" for r in rows)]
    return "\n".join(out) + "\n"


def html_page(title: str, sections: dict[str, DataFrame], most: int = 500) -> str:
    esc = html.escape
    out = [f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{esc(title)}</title></head><body><h1>{esc(title)}</h1>"]
    for name, df in sections.items():
        head, rows = _cells(df, most)
        out.append(f"<h2>{esc(name)}</h2><table><tr>{''.join(f'<th>{esc(h)}</th>' for h in head)}</tr>")
        out += ["<tr>" + "".join(f"<td>{esc(c)}</td>" for c in r) + "</tr>" for r in rows]
        out.append("</table>")
    return "".join(out) + "</body></html>"


def bias_report(violations: DataFrame) -> str:
    """What the look-ahead validator found, as Markdown."""
    found = violations.groupBy("symbol").agg(F.count("*").alias("violations"), F.min("t").alias("first_bar")).orderBy("symbol")
    text = markdown("Look-ahead check", {"Violations": found})
    return text + ("\nNo signal changes when later bars are taken away.\n" if found.isEmpty() else "")
