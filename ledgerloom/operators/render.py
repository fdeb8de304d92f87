"""Small reports as text: fixed-width tables and Markdown, of frames whose rows a reader can take in."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Rows that a rendered report may have; it is for reading.
MOST_ROWS = 10_000


def _cell(x) -> str:
    return "" if x is None else f"{x:.3f}" if isinstance(x, float) else str(x)


def _rows(df: DataFrame, order: list[str]) -> list[list[str]]:
    rows = df.orderBy(*order).limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ValueError(f"more than {MOST_ROWS} rows: aggregate before rendering")
    return [[_cell(x) for x in r] for r in rows]


def fixed_width(df: DataFrame, order: list[str]) -> str:
    """Columns padded to their longest cell: text to the left, numbers to the right."""
    rows = _rows(df, order)
    widths = [max(len(x) for x in (name, *(r[i] for r in rows))) for i, name in enumerate(df.columns)]
    right = [kind not in ("string", "boolean") for _, kind in df.dtypes]
    line = lambda cells: "  ".join(c.rjust(w) if r else c.ljust(w) for c, w, r in zip(cells, widths, right, strict=True)).rstrip()
    return "\n".join(line(r) for r in (df.columns, *rows))


def markdown(df: DataFrame, order: list[str]) -> str:
    bar = lambda cells: "| " + " | ".join(c.replace("|", "\\|").replace("\n", " ") for c in cells) + " |"
    return "\n".join([bar(df.columns), bar(["---"] * len(df.columns)), *map(bar, _rows(df, order))])
