"""Comparison of document versions: token diff, line multiset diff, grid diff."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from quire.functions import text as X
from quire.sources.tables import dealt

# Luminance tolerance and the number of cells that makes a difference.
GRID_TOLERANCE = 15
GRID_MIN_CELLS = 50
BLANK = 255

#: pairs of tokens of two pages up to which all of them are compared
TABLE = 100_000_000
#: cells of a table whose rows are all kept, a bit each
ROWS = 1 << 26
EQUAL, INSERT, DELETE = "equal", "insert", "delete"


def align_pages(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = ("pair_id", "page_number"),
                ) -> DataFrame:
    """Pages of both versions side by side; a missing page is an empty text."""
    left = a.select(*keys, F.col("page_text").alias("text_a"))
    right = b.select(*keys, F.col("page_text").alias("text_b"))
    return left.join(right, list(keys), "full").select(
        *keys, F.coalesce("text_a", F.lit("")).alias("text_a"),
        F.coalesce("text_b", F.lit("")).alias("text_b"))


class _Places(dict):
    """Places of a token in a list as a number with a bit for each. Those that fit into ``most`` bytes
    are kept, others made each time."""

    def __init__(self, b: list[int], most: int = 64 << 20):
        self.at: dict[int, list[int]] = {}
        for j, token in enumerate(b):
            self.at.setdefault(token, []).append(j)
        self.width, self.left = len(b) // 8 + 1, most

    def __missing__(self, token: int) -> int:
        at, found = self.at.get(token, ()), 0
        if len(at) < 16:
            for j in at:
                found |= 1 << j
        else:
            bits = np.zeros(8 * self.width, np.uint8)
            bits[at] = 1
            found = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
        if self.left > 0:
            self.left -= 100 + (self.width if at else 0)
            self[token] = found
        return found


def _rows_of(row: int, tokens: list[int], places: _Places, ones: int) -> list[int]:
    """Successive rows of the longest-common-subsequence table below ``row``.

    A row is a number: bit j is 0 if column j + 1 holds one more than column j, so that a row takes a
    few operations on whole numbers (Hyyro, 2004).
    """
    out = []
    for token in tokens:
        met = row & places[token]
        if met:
            row = (row + met | row - met) & ones
        out.append(row)
    return out


def _by_table(a: list[int], b: list[int]) -> Iterator[tuple[str, int]]:
    """Runs of edits and matches from the ends of two lists to their beginnings.

    Where two tokens differ the walk takes the insertion if the column before holds as much. Of a
    large table only every s-th row is kept (s = square root of its height); the rows between
    are made again when the walk back reaches them, so memory grows with n * sqrt(m).
    """
    i, j = len(a), len(b)
    step = max(i, 1) if i * j <= ROWS else max(64, int(i ** 0.5))
    places, ones = _Places(b), (1 << j) - 1
    kept = [ones]
    for start in range(0, i - step, step):
        kept.append(_rows_of(kept[-1], a[start:start + step], places, ones)[-1])
    first, table = i, []
    op, n = EQUAL, 0
    while i and j:
        if a[i - 1] == b[j - 1]:
            now, i, j = EQUAL, i - 1, j - 1
        else:
            if i <= first:
                first = (i - 1) // step * step
                table = _rows_of(kept[first // step], a[first:i], places, ones)
            if table[i - first - 1] >> (j - 1) & 1:
                now, j = INSERT, j - 1
            else:
                now, i = DELETE, i - 1
        if now is op:
            n += 1
        else:
            yield op, n
            op, n = now, 1
    yield op, n
    yield INSERT, j
    yield DELETE, i


def _same(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the common beginning of two arrays."""
    at, step, n = 0, 64, min(len(a), len(b))
    while at < n:
        other = np.flatnonzero(a[at:at + step][:n - at] != b[at:at + step][:n - at])
        if len(other):
            return at + int(other[0])
        at, step = at + step, step * 4
    return n


def _reached(before: np.ndarray, ia: np.ndarray, ib: np.ndarray) -> np.ndarray:
    """Furthest places with one edit more: element t is the diagonal 2 * t - d, counted in ``ia``."""
    d, n, m = len(before), len(ia), len(ib)
    k = 2 * np.arange(d + 1) - d
    x = np.maximum(np.append(-1, before + 1), np.append(before, -1))
    x = np.minimum(x, np.minimum(n, m + k))
    x = np.where(x < np.maximum(k, 0), -n - m, x)
    going = np.flatnonzero((x >= 0) & (x < n) & (x - k < m))
    for _ in range(8):  # most matches behind an edit are short
        going = going[ia[x[going]] == ib[x[going] - k[going]]]
        x[going] += 1
        going = going[(x[going] < n) & (x[going] - k[going] < m)]
        if not len(going):
            return x
    for t in going.tolist():
        x[t] += _same(ia[x[t]:], ib[x[t] - k[t]:])
    return x


def _by_edits(ia: np.ndarray, ib: np.ndarray, most: int) -> list[tuple[str, int]] | None:
    """As ``_by_table`` in time (n + m) * edits (Myers, 1986); None if there are over ``most``.

    A cell of the table is at most d edits away if the furthest place of d edits on its diagonal
    is not before it, so the furthest places answer the walk back. Of them every s-th row is kept.
    """
    n, m = len(ia), len(ib)
    step = max(16, int((n + m) ** 0.25) * 8)
    row = np.array([_same(ia, ib)])
    kept = [row]
    d = 0
    while (n - m + d) % 2 or not 0 <= (n - m + d) // 2 <= d or row[(n - m + d) // 2] < n:
        d += 1
        if d > most:
            return None
        row = _reached(row, ia, ib)
        if d % step == 0:
            kept.append(row)
    out: list[tuple[str, int]] = []
    i, j, first, rows = n, m, d + 1, []
    while i or j:
        same = _same(ia[:i][::-1], ib[:j][::-1])
        if same:
            out.append((EQUAL, same))
            i, j = i - same, j - same
            continue
        d -= 1
        if d < first:
            first = d // step * step
            rows = [kept[first // step]]
            while len(rows) <= d - first:
                rows.append(_reached(rows[-1], ia, ib))
        t = (i - j + 1 + d) // 2  # the diagonal of an insertion
        insert = j > 0 and 0 <= t <= d and rows[d - first][t] >= i
        out.append((INSERT if insert else DELETE, 1))
        i, j = (i, j - 1) if insert else (i - 1, j)
    return out


def diff_runs(a: list[str], b: list[str], table: int = TABLE) -> list[tuple[str, str]]:
    """Runs of equal, inserted and deleted text between two token lists.

    Ties take the insertion, read from the end. Up to ``table`` pairs of tokens the whole table is
    filled, 64 columns at once; for longer lists the time grows with the edits, unless there are so
    many that the table is cheaper. Both ways give the same runs.
    """
    if not a or not b:
        text = "".join(a or b)
        return [(DELETE if a else INSERT, text)] if a or b else []
    ids = {token: no for no, token in enumerate(dict.fromkeys(chain(a, b)))}
    ia, ib = [*map(ids.__getitem__, a)], [*map(ids.__getitem__, b)]
    # a common end is matched first by the walk back
    tail, most = 0, min(len(a), len(b))
    while tail < most and ia[-1 - tail] == ib[-1 - tail]:
        tail += 1
    del ia[len(a) - tail:], ib[len(b) - tail:]
    ops = None
    if len(ia) * len(ib) > table:
        ops = _by_edits(np.array(ia), np.array(ib), max(500, int((len(ia) * len(ib)) ** 0.5) // 32))
    i, j = len(a), len(b)
    runs: list[list] = []  # op, begin and end in its list
    for op, n in chain([(EQUAL, tail)], _by_table(ia, ib) if ops is None else ops):
        if not n:
            continue
        end = j if op == INSERT else i
        i, j = i - n * (op != INSERT), j - n * (op != DELETE)
        if runs and runs[-1][0] == op:
            runs[-1][1] = end - n
        else:
            runs.append([op, end - n, end])
    return [(op, "".join((b if op == INSERT else a)[low:high])) for op, low, high in reversed(runs)]


def token_diff(pairs: DataFrame, keys: tuple[str, ...] = ("pair_id", "page_number")) -> DataFrame:
    """Diff runs of aligned pages: keys, run_no, op, text.

    Equal pages are answered by comparison alone. The others are spread over
    the cluster; a pair is worked on in its row, in time that grows with its edits.
    """
    changed = F.col("text_a") != F.col("text_b")
    rows = pairs.where((F.col("text_a") != "") | (F.col("text_b") != "")).select(
        *keys, F.when(~changed, F.col("text_a")).alias("same"),
        F.when(changed, X.diff_tokens(F.col("text_a"))).alias("ta"),
        F.when(changed, X.diff_tokens(F.col("text_b"))).alias("tb"))
    types = dict(pairs.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", run_no int, op string, text string"

    def runs_of(row) -> list[tuple[str, str]]:
        if row.same is not None:
            return [(EQUAL, row.same)]
        return diff_runs(list(row.ta), list(row.tb))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [
                (*(getattr(r, k) for k in keys), no, op, text)
                for r in batch.itertuples(index=False)
                for no, (op, text) in enumerate(runs_of(r))
            ]
            yield pd.DataFrame(found, columns=[*keys, "run_no", "op", "text"])

    return rows.mapInPandas(run, schema)


def diff_summary(runs: DataFrame, keys: tuple[str, ...] = ("pair_id", "page_number")) -> DataFrame:
    """Token counts per kind and the ratio of changed tokens."""
    n = F.size(X.diff_tokens(F.col("text"))).cast("bigint")

    def of(op: str):
        return F.sum(F.when(F.col("op") == op, n).otherwise(0))

    counted = runs.groupBy(*keys).agg(of(INSERT).alias("additions"), of(DELETE).alias("deletions"),
                                      of(EQUAL).alias("unchanged"))
    changed = F.col("additions") + F.col("deletions")
    total = changed + F.col("unchanged")
    return counted.withColumn(
        "diff_ratio", F.when(total > 0, changed / total).otherwise(F.lit(0.0)))


def pages_with_differences(a: DataFrame, b: DataFrame, pair: str = "pair_id") -> DataFrame:
    """Differing pages out of all pages per pair; only hashes of the pages are moved."""
    def hashed(pages: DataFrame, name: str) -> DataFrame:
        return pages.select(pair, "page_number", F.unhex(F.sha2("page_text", 256)).alias(name))

    blank = F.unhex(F.sha2(F.lit(""), 256))
    both = hashed(a, "a").join(hashed(b, "b"), [pair, "page_number"], "full")
    return both.groupBy(pair).agg(
        F.count_if(F.coalesce("a", blank) != F.coalesce("b", blank)).alias("pages_changed"),
        F.count("*").alias("pages_total"))


def line_diff(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = ("pair_id",)) -> DataFrame:
    """Multiset difference of lines: how often each line was kept, deleted, inserted.

    Both sides are counted in one partial aggregate, so a line repeated in a
    third of the corpus costs one row per task.
    """
    both = a.select(*keys, "line", F.lit(1).alias("a"), F.lit(0).alias("b")).unionAll(
        b.select(*keys, "line", F.lit(0).alias("a"), F.lit(1).alias("b")))
    n = both.groupBy(*keys, "line").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    ops = F.array(
        F.struct(F.lit(EQUAL).alias("op"), F.least("a", "b").alias("n")),
        F.struct(F.lit(DELETE).alias("op"), (F.col("a") - F.col("b")).alias("n")),
        F.struct(F.lit(INSERT).alias("op"), (F.col("b") - F.col("a")).alias("n")))
    return n.select(*keys, "line", F.inline(ops)).where(F.col("n") > 0)


def luminance(r, g, b):
    return F.floor((r + g + b) / 3).cast("int")


def grid_cells(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """Cells of two grids (x, y, lum) side by side with their class.

    Both sides are aggregated by cell instead of joined, which keeps cells that only one side has;
    of a cell that a side has several times the largest luminance counts. The cells are dealt to
    tasks whose number grows with the grids.
    """
    both = a.select(*keys, "x", "y", F.col("lum").alias("a"), F.lit(None).cast("int").alias("b"))
    both = both.unionAll(
        b.select(*keys, "x", "y", F.lit(None).cast("int").alias("a"), F.col("lum").alias("b")))
    cells = dealt(both, *keys, "x", "y").groupBy(*keys, "x", "y").agg(
        F.coalesce(F.max("a"), F.lit(BLANK)).alias("lum_a"),
        F.coalesce(F.max("b"), F.lit(BLANK)).alias("lum_b"))
    differs = F.abs(F.col("lum_a") - F.col("lum_b")) > GRID_TOLERANCE
    return cells.withColumn(
        "class", F.when(~differs, "same").when(F.col("lum_a") < F.col("lum_b"), "removed")
        .otherwise("added"))


def grid_diff(cells: DataFrame, keys: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """Counts per class and the share of differing cells of the covering rectangle."""
    total = (F.max("x") + 1).cast("bigint") * (F.max("y") + 1).cast("bigint")
    n = cells.groupBy(*keys).agg(
        F.count_if(F.col("class") == "removed").alias("removed"),
        F.count_if(F.col("class") == "added").alias("added"), total.alias("total_cells"))
    different = F.col("removed") + F.col("added")
    return n.withColumns({
        "diff_ratio": different / F.col("total_cells"),
        "has_differences": different > GRID_MIN_CELLS})
