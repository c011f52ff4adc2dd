import random

from pyspark.sql import functions as F

from quire.functions import text as X
from quire.operators import compare as D
from quire.sources import tables


def table_diff(a, b):
    """Full table and walk back, insertion first on ties."""
    m, n = len(a), len(b)
    t = [[0] * (n + 1) for _ in range(m + 1)]
    for i in range(m):
        for j in range(n):
            t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i + 1][j], t[i][j + 1])
    ops, i, j = [], m, n
    while i or j:
        if i and j and a[i - 1] == b[j - 1]:
            ops.append(("equal", a[i - 1]))
            i, j = i - 1, j - 1
        elif j and (not i or t[i][j - 1] >= t[i - 1][j]):
            ops.append(("insert", b[j - 1]))
            j -= 1
        else:
            ops.append(("delete", a[i - 1]))
            i -= 1
    runs = []
    for op, tok in reversed(ops):
        if runs and runs[-1][0] == op:
            runs[-1] = (op, runs[-1][1] + tok)
        else:
            runs.append((op, tok))
    return runs


def test_diff_runs_equal_full_table():
    rng = random.Random(7)
    for _ in range(400):
        a = [rng.choice("abc ") for _ in range(rng.randrange(0, 150))]
        b = [rng.choice("abc ") for _ in range(rng.randrange(0, 150))]
        assert D.diff_runs(a, b) == table_diff(a, b)


def test_long_pair_is_diffed_whole():
    rng = random.Random(8)
    a = [f"w{rng.randrange(2000)}" for _ in range(4000)]
    b = a[:1500] + ["new"] + a[1500:]
    runs = D.diff_runs(a, b)
    assert "".join(t for op, t in runs if op != "delete") == "".join(b)
    assert "".join(t for op, t in runs if op != "insert") == "".join(a)
    assert sum(len(t) for op, t in runs if op == "insert") == 3


def test_token_diff_frame(spark):
    a = "Le contrat est conclu le 12/01/2024 pour 1 000 euros."
    b = "Le contrat est conclu le 15/03/2024 pour 2 500 euros."
    pairs = spark.createDataFrame(
        [(1, 1, a, b), (2, 1, a, a), (3, 1, "", ""), (4, 1, "", b), (5, 1, a, "")],
        "pair_id bigint, page_number int, text_a string, text_b string")
    runs = {}
    for r in D.token_diff(pairs).orderBy("pair_id", "run_no").collect():
        runs.setdefault(r.pair_id, []).append((r.op, r.text))
    assert any(op == "equal" and "Le contrat est conclu" in t for op, t in runs[1])
    assert {op for op, _ in runs[1]} == {"equal", "insert", "delete"}
    assert runs[2] == [("equal", a)] and 3 not in runs
    assert runs[4] == [("insert", b)] and runs[5] == [("delete", a)]
    s = {r.pair_id: r for r in D.diff_summary(D.token_diff(pairs)).collect()}
    assert s[2].diff_ratio == 0.0 and s[4].diff_ratio == 1.0 and s[1].unchanged > 0


def test_tokens(spark):
    got = spark.range(1).select(X.diff_tokens(F.lit("Été 12,5  b!")).alias("t")).collect()[0].t
    assert got == ["Été", " ", "12", ",", "5", "  ", "b", "!"]


def test_line_diff_and_grid(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (1, "y")], "pair_id int, line string")
    b = spark.createDataFrame([(1, "x"), (1, "z")], "pair_id int, line string")
    got = {(r.line, r.op): r.n for r in D.line_diff(a, b).collect()}
    assert got == {("x", "equal"): 1, ("x", "delete"): 1, ("y", "delete"): 1, ("z", "insert"): 1}

    def grid(w, h, lum):
        return spark.createDataFrame([(1, x, y, lum(x, y)) for x in range(w) for y in range(h)],
                                     "page_id int, x int, y int, lum int")

    base = grid(10, 10, lambda x, y: 100)
    same = D.grid_diff(D.grid_cells(base, grid(10, 10, lambda x, y: 115))).collect()[0]
    assert (same.removed, same.added, same.has_differences) == (0, 0, False)
    more = D.grid_diff(D.grid_cells(base, grid(10, 10, lambda x, y: 116 if x < 5 else 100))).collect()[0]
    assert more.removed == 50 and not more.has_differences and more.diff_ratio == 0.5
    wide = D.grid_diff(D.grid_cells(base, grid(11, 6, lambda x, y: 100))).collect()[0]
    assert wide.total_cells == 110 and wide.removed == 40 and wide.added == 6


def test_grid_tasks_grow_with_the_grids(spark, tmp_path, monkeypatch):
    """Cells are dealt by the size of the grids, not by the session's shuffle partitions."""
    grid = spark.range(20_000).selectExpr("id % 50 AS page_id", "cast(id % 20 AS int) AS x",
                                          "cast(id DIV 1000 AS int) AS y", "cast(id % 256 AS int) AS lum")
    grid.write.parquet(f"{tmp_path}/g")
    monkeypatch.setattr(tables, "DEALT_BYTES", 500)
    a = spark.read.parquet(f"{tmp_path}/g")
    cells = D.grid_cells(a, a.where("x > 3"))
    assert cells.rdd.getNumPartitions() > 8
    counted = {r["class"]: r["count"] for r in cells.groupBy("class").count().collect()}
    want = a.groupBy("page_id", "x", "y").agg({"lum": "max"}).where("x <= 3").where(
        f"abs(`max(lum)` - {D.BLANK}) > {D.GRID_TOLERANCE}").count()
    assert counted.get("removed", 0) + counted.get("added", 0) == want > 0
