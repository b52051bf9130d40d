"""Reports as text: tables in Markdown or HTML, and data-quality, drift and lineage summaries built from aggregates."""

from __future__ import annotations

import html
import re

from pyspark.sql import DataFrame

from ..functions.expr import datetime_columns, numeric_columns, string_columns
from .drift import detect_all_drift
from .quality import cardinality, column_kinds, detect_duplicates, missing_profile, top_values
from .stats import bivariate, datetime_summary, numeric_summary, pca, pearson

#: Rows of a table in a report.
ROWS = 100


def _cell(x) -> str:
    return "" if x is None else f"{x:.4g}" if isinstance(x, float) else str(x)


def to_markdown(df: DataFrame, rows: int = ROWS) -> str:
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    for r in df.limit(rows).collect():
        lines.append("| " + " | ".join(_cell(x).replace("|", "\\|").replace("\n", " ") for x in r) + " |")
    return "\n".join(lines)


def to_html(df: DataFrame, rows: int = ROWS) -> str:
    head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
    body = "".join("<tr>" + "".join(f"<td>{html.escape(_cell(x))}</td>" for x in r) + "</tr>" for r in df.limit(rows).collect())
    return f"<table><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table>"


def _document(title: str, parts: dict[str, DataFrame], form: str) -> str:
    if form == "markdown":
        return f"# {title}\n\n" + "\n\n".join(f"## {name}\n\n{to_markdown(df)}" for name, df in parts.items()) + "\n"
    if form == "html":
        inner = "".join(f"<h2>{html.escape(name)}</h2>{to_html(df)}" for name, df in parts.items())
        return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1>{inner}</body></html>"
    raise ValueError(f"unknown form {form!r}")


def quality_parts(df: DataFrame) -> dict[str, DataFrame]:
    parts = {"Columns": column_kinds(df), "Missing values": missing_profile(df), "Cardinality": cardinality(df, df.columns), "Duplicates": detect_duplicates(df, df.columns)}
    if numbers := numeric_columns(df):
        parts["Numbers"] = numeric_summary(df, numbers)
        if len(numbers) > 1:
            parts["Correlation"] = pearson(df, numbers)
    return parts


def quality_report(df: DataFrame, title: str = "Data quality", form: str = "markdown") -> str:
    """Columns, missing values, cardinality, duplicates, numbers and correlation of a table."""
    return _document(title, quality_parts(df), form)


def eda_parts(df: DataFrame, target: str | None = None, top: int = 10) -> dict[str, DataFrame]:
    """Every table of an exploration by name: columns one by one, against the target, and together; each is one aggregate or a few."""
    numbers, texts, dates = numeric_columns(df), string_columns(df), datetime_columns(df)
    parts = {"Missing values": missing_profile(df)}
    if numbers:
        parts["Numbers"] = numeric_summary(df, numbers)
    parts |= {f"Values of {c}": top_values(df, c, top) for c in texts}
    parts |= {f"Range of {c}": datetime_summary(df, c) for c in dates}
    if target:
        parts[f"Against {target}"] = bivariate(df, [c for c in [*numbers, *texts] if c != target], target)
    if len(numbers) > 1:
        parts |= {"Correlation": pearson(df, numbers), "Principal components": pca(df, numbers, min(3, len(numbers)))}
    return parts


def eda_report(df: DataFrame, target: str | None = None, title: str = "Exploration", form: str = "markdown") -> str:
    return _document(title, eda_parts(df, target), form)


def drift_report(reference: DataFrame, current: DataFrame, title: str = "Drift", form: str = "markdown") -> str:
    return _document(title, {"Features": detect_all_drift(reference, current)}, form)


def pipeline_diagram(steps: list[str]) -> str:
    """A text drawing of steps in order."""
    return "\n  |\n".join(f"[{i + 1}] {s}" for i, s in enumerate(steps))


def escape_markup(text: str) -> str:
    """Escape the characters that plot markup would read, and the backslash."""
    return "".join("\\" + c if c in "\\$_^%{}" else c for c in text)


def unescape_markup(text: str) -> str:
    """The inverse of escape_markup."""
    return re.sub(r"\\([\\$_^%{}])", r"\1", text)
