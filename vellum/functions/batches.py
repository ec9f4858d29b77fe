"""Rows that Python makes, handed on in lots, as a table a document costs more than what is in it."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd


def lots(rows: Iterable[tuple], columns: list[str], most: int = 4096, **options) -> Iterator[pd.DataFrame]:
    """Tables of at most so many rows. Only those of one table are held, besides what `rows` holds."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= most:
            yield pd.DataFrame(held, columns=columns, **options)
            held = []
    if held:
        yield pd.DataFrame(held, columns=columns, **options)


#: Whole files that are handed on at a time.
FILES = 256
