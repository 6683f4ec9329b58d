"""Reading order of words on a page, and text of cell tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Distances in points.
LINE_TOLERANCE = 3.0
WORD_GAP = 96.0
COLUMN_TOLERANCE = 48.0

_PLACES = (
    "document_name string, page_index int, text string, x0 double, x1 double, top double, "
    "column_no int, line_no int, word_no int"
)


def line_numbers(top: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Line of each word, lines numbered as they open, words taken from the top."""
    line = np.full(len(top), -1)
    tops, ends = np.empty(len(top)), np.empty(len(top))
    opened = 0
    for word in np.lexsort((left, top)):
        fits = (np.abs(tops[:opened] - top[word]) <= LINE_TOLERANCE) & (left[word] - ends[:opened] <= WORD_GAP)
        if fits.any():
            line[word] = fits.argmax()
            ends[line[word]] = max(ends[line[word]], right[word])
        else:
            line[word], tops[opened], ends[opened] = opened, top[word], right[word]
            opened += 1
    return line


def column_numbers(top: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Column of each line, columns numbered from the left, lines taken from the left."""
    column = np.full(len(top), -1)
    starts, ends = np.empty(len(top)), np.empty(len(top))
    opened = 0
    for line in np.lexsort((top, left)):
        shared = np.minimum(right[line], ends[:opened]) - np.maximum(left[line], starts[:opened])
        fits = (shared > 0) | (np.abs(left[line] - starts[:opened]) <= COLUMN_TOLERANCE)
        at = fits.argmax() if fits.any() else opened
        if at == opened:
            starts[at], ends[at] = left[line], right[line]
            opened += 1
        column[line] = at
        starts[at], ends[at] = min(starts[at], left[line]), max(ends[at], right[line])
    return np.argsort(np.argsort(starts[:opened], kind="stable"))[column]


def page_order(top: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of a page in reading order, with the column and the line of each word so ordered."""
    line = line_numbers(top, left, right)
    lines = np.arange(line.max() + 1)
    order = np.lexsort((left, top, line))
    starts = np.searchsorted(line[order], lines)
    first = top[order][starts]
    ends = np.minimum.reduceat(left[order], starts), np.maximum.reduceat(right[order], starts)
    column = column_numbers(first, *ends)
    line_no = np.empty(len(lines), dtype=int)
    line_no[np.lexsort((ends[0], first, column))] = lines
    words = np.lexsort((left, line_no[line]))
    return words, column[line][words], line_no[line][words]


def _padded(counts: np.ndarray, most: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pages of like size at a time: their numbers, the places of their items, and which of these there are."""
    starts, order, k = np.cumsum(counts) - counts, np.argsort(-counts, kind="stable"), 0
    while k < len(order):
        width = max(int(counts[order[k]]), 1)
        pages = order[k : k + max(most // width, 1)]
        there = np.arange(width) < counts[pages, None]
        yield pages, np.where(there, starts[pages, None] + np.arange(width), 0), there
        k += len(pages)


def line_numbers_of(counts: np.ndarray, top: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """``line_numbers`` of many pages, whose words stand one page after the other, from the top: a word of every page at a time."""
    line = np.zeros(len(top), int)
    for pages, at, there in _padded(counts):
        tops, ends = np.empty(at.shape), np.empty(at.shape)
        opened, every = np.zeros(len(pages), int), np.arange(len(pages))
        for k in range(at.shape[1]):
            live, m = there[:, k], opened.max(initial=0)
            t, l, r = (c[at[:, k]] for c in (top, left, right))  # noqa: E741
            fits = (np.abs(tops[:, :m] - t[:, None]) <= LINE_TOLERANCE) & (l[:, None] - ends[:, :m] <= WORD_GAP) & (np.arange(m) < opened[:, None])
            joins = fits.any(1)
            to = np.where(joins, fits.argmax(1) if m else 0, opened)
            line[at[live, k]] = to[live]
            old, new = live & joins, live & ~joins
            held = ends[every[old], to[old]]
            ends[every[old], to[old]] = np.where(r[old] > held, r[old], held)
            tops[every[new], to[new]], ends[every[new], to[new]] = t[new], r[new]
            opened += new
    return line


def column_numbers_of(counts: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """``column_numbers`` of many pages, whose lines stand one page after the other, from the left."""
    column = np.zeros(len(left), int)
    for pages, at, there in _padded(counts):
        starts, ends = np.full(at.shape, np.inf), np.empty(at.shape)
        opened, every = np.zeros(len(pages), int), np.arange(len(pages))
        for k in range(at.shape[1]):
            live, m = there[:, k], opened.max(initial=0)
            l, r = left[at[:, k]][:, None], right[at[:, k]][:, None]  # noqa: E741
            shared = np.minimum(r, ends[:, :m]) - np.maximum(l, starts[:, :m])
            fits = ((shared > 0) | (np.abs(l - starts[:, :m]) <= COLUMN_TOLERANCE)) & (np.arange(m) < opened[:, None])
            joins = fits.any(1)
            to = np.where(joins, fits.argmax(1) if m else 0, opened)
            column[at[live, k]] = to[live]
            old, new = live & joins, live & ~joins
            e, o = (every[old], to[old]), (every[new], to[new])
            starts[o], ends[o] = l[new, 0], r[new, 0]
            starts[e], ends[e] = np.minimum(starts[e], l[old, 0]), np.maximum(ends[e], r[old, 0])
            opened += new
        ranks = np.argsort(np.argsort(starts, axis=1, kind="stable"), axis=1)
        rows = np.broadcast_to(every[:, None], at.shape)[there]
        column[at[there]] = ranks[rows, column[at[there]]]
    return column


def pages_order(page: np.ndarray, top: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``page_order`` of many pages at once, ``page`` ascending: the words in reading order, with the column, the line and the
    number in its page of each word so ordered."""
    pages = page[-1] + 1
    down = np.lexsort((left, top, page))
    line = np.empty(len(page), int)
    line[down] = line_numbers_of(np.bincount(page, minlength=pages), top[down], left[down], right[down])
    order = np.lexsort((left, top, line, page))
    opens = np.flatnonzero((np.diff(page[order], prepend=-1) != 0) | (np.diff(line[order], prepend=-1) != 0))
    of_page, first = page[order][opens], top[order][opens]
    low, high = np.minimum.reduceat(left[order], opens), np.maximum.reduceat(right[order], opens)
    across = np.lexsort((first, low, of_page))
    column = np.empty(len(opens), int)
    column[across] = column_numbers_of(np.bincount(of_page, minlength=pages), low[across], high[across])
    read = np.lexsort((low, first, column, of_page))
    line_no = np.empty(len(opens), int)
    line_no[read] = np.arange(len(opens)) - np.searchsorted(of_page, of_page)
    entry = np.empty(len(page), int)
    entry[order] = np.repeat(np.arange(len(opens)), np.diff(np.r_[opens, len(page)]))
    words = np.lexsort((left, line_no[entry], page))
    return words, column[entry[words]], line_no[entry[words]], np.arange(len(page)) - np.searchsorted(page, page)


def _whole_pages(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Rows sorted by page, cut between pages, with the number of each row's page; a page may span batches."""
    def numbered(parts: list[pd.DataFrame]) -> tuple[pd.DataFrame, np.ndarray]:
        rows = parts[0] if len(parts) == 1 else pd.concat(parts, ignore_index=True)
        keys = [rows[c].to_numpy() for c in ("document_name", "page_index")]
        turns = np.r_[False, (keys[0][1:] != keys[0][:-1]) | (keys[1][1:] != keys[1][:-1])]
        return rows, np.cumsum(turns)

    parts, last = [], None
    for batch in batches:
        if not len(batch):
            continue
        ends = [(batch["document_name"].iloc[k], batch["page_index"].iloc[k]) for k in (0, -1)]
        one_page = ends[0] == ends[1]
        parts.append(batch)
        if last is not None and (not one_page or ends[0] != last) or not one_page:
            rows, page = numbered(parts)
            start = np.searchsorted(page, page[-1])
            yield rows.iloc[:start], page[:start]
            parts = [rows.iloc[start:]]
        last = ends[1]
    if parts:
        yield numbered(parts)


def _by_page(words: DataFrame) -> DataFrame:
    return words.select("document_name", "page_index", "text", "x0", "top", "x1").repartition("document_name", "page_index").sortWithinPartitions("document_name", "page_index")


def _placed(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    for rows, page in _whole_pages(batches):
        if len(rows):
            at, column, line, word = pages_order(page, *(rows[c].to_numpy() for c in ("top", "x0", "x1")))
            yield rows.iloc[at].assign(column_no=column, line_no=line, word_no=word), page


def placed_words(words: DataFrame) -> DataFrame:
    """Words with the numbers of their column, of their line in it and of themselves in the line.

    A page is the unit of placing; a task places the words of many pages at once."""

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, _ in _placed(batches):
            yield rows[["document_name", "page_index", "text", "x0", "x1", "top", "column_no", "line_no", "word_no"]]

    return _by_page(words).mapInPandas(placed, _PLACES)


def reading_order(words: DataFrame) -> DataFrame:
    """Text per page in reading order: a break where the next word is on another height, far off or to the left.

    The text is put together where the words are placed, so words are shuffled once."""

    def texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, page in _placed(batches):
            x0, x1, top = (rows[c].to_numpy(float) for c in ("x0", "x1", "top"))
            opens = np.diff(page, prepend=-1) != 0
            right, above = np.r_[np.nan, x1[:-1]], np.r_[np.nan, top[:-1]]
            broken = (np.abs(above - top) > LINE_TOLERANCE) | (x0 - right > WORD_GAP) | (x0 < right)
            between = np.where(opens | np.isnan(right), "", np.where(broken, "\n", " ")).tolist()
            pieces = ["" if w is None else b + w for b, w in zip(between, rows["text"].tolist())]
            starts = np.flatnonzero(opens)
            joined = ["".join(pieces[a:b]) for a, b in zip(starts, [*starts[1:], len(pieces)])]
            yield rows.iloc[starts][["document_name", "page_index"]].assign(text=joined)

    return _by_page(words).mapInPandas(texts, "document_name string, page_index int, text string")


def table_lines(cells: DataFrame) -> DataFrame:
    """Rows of cell tables as lines: cells joined by `` | ``, blank rows dropped."""
    tidy = F.btrim(F.regexp_replace("cell", r"\s+", " "))
    return (
        cells.select("document_name", "table_no", "row_no", F.struct("column_no", tidy.alias("cell")).alias("c"))
        .groupBy("document_name", "table_no", "row_no").agg(F.array_sort(F.collect_list("c")).alias("cs"))
        .select("document_name", "table_no", "row_no", F.array_join(F.transform("cs", lambda x: x["cell"]), " | ").alias("line"))
        .filter(F.btrim("line", F.lit(" |")) != "")
    )


def table_text(cells: DataFrame) -> DataFrame:
    """One text per table: its lines in order.  Tables too long for one cell stay as ``table_lines``."""
    return (
        table_lines(cells).groupBy("document_name", "table_no")
        .agg(F.array_sort(F.collect_list(F.struct("row_no", "line"))).alias("rows"))
        .select("document_name", "table_no", F.array_join(F.transform("rows", lambda x: x["line"]), "\n").alias("text"))
    )
