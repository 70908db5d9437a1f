"""Markdown and HTML from small aggregates."""

from __future__ import annotations

import html
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame

MAX_ROWS = 5000


def _rows(df: DataFrame) -> list[dict]:
    found = [r.asDict(recursive=True) for r in df.limit(MAX_ROWS + 1).collect()]
    if len(found) > MAX_ROWS:
        raise ValueError(f"a report table of more than {MAX_ROWS} rows")
    return found


def shown(value: object) -> str:
    return "–" if value is None else f"{value:.3f}" if isinstance(value, float) else str(value)


def markdown_table(df: DataFrame, columns: Sequence[str] | None = None) -> str:
    names = list(columns or df.columns)
    lines = ["| " + " | ".join(names) + " |", "|" + "---|" * len(names)]
    return "\n".join(
        lines
        + [
            "| " + " | ".join(shown(r[c]).replace("|", "\\|").replace("\n", " ") for c in names) + " |"
            for r in _rows(df)
        ]
    )


def write_markdown(path: str, title: str, tables: dict[str, DataFrame]) -> None:
    Path(path).write_text("\n\n".join([f"# {title}", *[f"## {name}\n\n{markdown_table(df)}" for name, df in tables.items()]]) + "\n", encoding="utf-8")


def html_table(df: DataFrame, longest: int = 400) -> str:
    """Cells are escaped first and cut after, as the reports' definition has it."""
    names = df.columns
    head = "".join(f"<th>{html.escape(c)}</th>" for c in names)
    body = "".join(
        "<tr>" + "".join(f"<td>{html.escape(shown(r[c]))[:longest]}</td>" for c in names) + "</tr>" for r in _rows(df)
    )
    return f"<table><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table>"


def write_html(path: str, title: str, tables: dict[str, DataFrame]) -> None:
    style = "body{font-family:sans-serif;max-width:960px;margin:2em auto}table{border-collapse:collapse;margin:1em 0}td,th{border:1px solid #ccc;padding:.3em .6em;text-align:left}"
    parts = "".join(f"<h2>{html.escape(name)}</h2>{html_table(df)}" for name, df in tables.items())
    Path(path).write_text(
        f"<!doctype html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title><style>{style}</style></head><body><h1>{html.escape(title)}</h1>{parts}</body></html>",
        encoding="utf-8",
    )
