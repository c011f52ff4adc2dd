import random

from pyspark.sql import functions as F

from quire.functions import text as X
from quire.operators import textlayer as L


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def test_lines_and_pages(spark):
    df = docs(spark, ["log line\n" * 60, "", "a\r\nb\n", "a\n\n", "\n", "x\ry"])
    got = {}
    for r in L.lines(df).orderBy("doc_id", "line_no").collect():
        got.setdefault(r.doc_id, []).append((r.line, r.page_number, r.page_count))
    assert [len(got.get(i, [])) for i in range(6)] == [60, 0, 2, 2, 1, 1]
    assert got[0][47][1:] == (1, 2) and got[0][48][1:] == (2, 2)
    assert got[2][0][0] == "a" and got[5][0][0] == "x\ry"
    pages = {(r.doc_id, r.page_number): r.n_lines for r in L.pages(df).collect()}
    assert pages[(0, 1)] == 48 and pages[(0, 2)] == 12 and pages[(1, 1)] == 0
    assert len(pages) == 7


def test_mail_pages_hold_39_then_47(spark):
    df = docs(spark, ["x\n" * 140])
    got = [r.page_number for r in L.mail_lines(df).orderBy("line_no").collect()]
    assert got == [1] * 39 + [2] * 47 + [3] * 47 + [4] * 7


def test_located_words_equal_a_scan(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab é\t ") for _ in range(rng.randrange(0, 900))) for _ in range(40)]
    texts.append(" ".join(f"w{i}" for i in range(1500)) + "  ")
    df = docs(spark, texts).select("doc_id", X.located_words(F.col("text")).alias("w"))
    import re
    for r in df.collect():
        want = [(m.group(), m.start()) for m in re.finditer(r"[^ \t\n\f\r\x0b]+", texts[r.doc_id])]
        assert [(w.text, w.start) for w in r.w] == want


def test_page_text_and_spans(spark):
    df = docs(spark, ["  Hello  World\n\nagain"])
    spans = L.spans(L.lines(df))
    rows = spans.orderBy("line_no", "span_idx").collect()
    assert [(r.text, r.x, r.y, r.width) for r in rows] == [
        ("Hello", 62.0, 32.0, 30.0), ("World", 104.0, 32.0, 30.0), ("again", 50.0, 62.0, 30.0)]
    assert L.page_text(spans).collect()[0].page_text == "Hello World\nagain"
    assert L.page_texts(df).collect()[0].page_text == "Hello World\nagain"
    raw = L.page_texts(docs(spark, ["a  b\n\nc\n" * 20, ""]), words_only=False)
    assert [(r.doc_id, r.page_number, r.page_text.count("\n")) for r in raw.collect()] == [
        (0, 1, 47), (0, 2, 11), (1, 1, 0)]


def test_wrap_by_bytes(spark):
    df = spark.createDataFrame([(1, "aa éé bb cccccccccc d")], "k int, line string")
    got = [r.line for r in L.wrap(df, "line", 7).orderBy("wrap_no").collect()]
    assert got == ["aa éé", "bb", "cccccccccc", "d"]


def test_flow_pages_brute_force(spark):
    rng = random.Random(2)
    texts = ["\n".join(rng.choice(["", "text", "  "]) for _ in range(rng.randrange(1, 200)))
             for _ in range(8)]
    got = {}
    for r in L.flow_pages(docs(spark, texts)).collect():
        got[(r.doc_id, r.line_no)] = (r.page_number, r.y)
    for d, text in enumerate(texts):
        parts = text.split("\n")
        if parts[-1] == "":
            parts.pop()
        y, page = 780, 1
        for i, line in enumerate(parts):
            assert got[(d, i)] == (page, y)
            y -= 12 if not line.strip() else (24 if i == 0 else 16)
            if line.strip() and y < 60:
                page, y = page + 1, 780


def test_headings_and_escapes(spark):
    df = spark.createDataFrame(
        [("1. Intro",), ("TITRE ÉLEVÉ 2",), ("Not a heading",), ("",), ("A" * 60,)], "line string")
    assert [r.line for r in L.headings(df).collect()] == ["1. Intro", "TITRE ÉLEVÉ 2"]
    e = df.limit(1).select(X.escape_xml(F.lit("<a b=\"c\">&'")).alias("x"),
                           X.escape_pdf(F.lit("a\\(b)\n")).alias("p")).collect()[0]
    assert e.x == "&lt;a b=&quot;c&quot;&gt;&amp;&apos;" and e.p == "a\\\\\\(b\\)\\n"


def test_first_box_wins(spark):
    span = [(1, 1, 0, 0, "a", 100.0, 50.0, 12.0, 10.0), (1, 1, 0, 1, "b", 300.0, 50.0, 12.0, 10.0)]
    spans = spark.createDataFrame(
        span, "doc_id int, page_number int, line_no int, span_idx int, text string, x double, "
              "y double, width double, height double")
    boxes = spark.createDataFrame(
        [(1, 1, 5, 111.9, 60.0, 40.0), (1, 1, 3, 95.0, 74.9, 60.0), (1, 1, 1, 112.0, 50.0, 9.0)],
        "doc_id int, page_number int, box_no int, x double, top_y double, width double")
    got = {r.text: r.box_no for r in L.match_boxes(spans, boxes).collect()}
    assert got == {"a": 3, "b": None}


def brute_fit(words, boxes):
    """Plain walk over one line: (x, width, scale) per word."""
    out, i = [], 0
    while i < len(words):
        text, x, y, w, h = words[i]
        box = next((b for b in boxes if abs(b[0] - x) < 12 and abs(b[1] - y) < 25), None)
        if box is None:
            out.append((x, w, 1.0))
            i += 1
            continue
        j = i
        while j + 1 < len(words):
            nx = words[j + 1]
            if any(abs(b[0] - box[0]) > 2 and abs(b[0] - nx[1]) < 8 and abs(b[1] - nx[2]) < 25
                   for b in boxes) or nx[1] + nx[3] > box[0] + box[2] + 15:
                break
            j += 1
        width = words[j][1] + words[j][3] - x
        raw = box[2] * (0.855 if i == j else 0.935) / width if width > 0 else 1.0
        scale = 1.0 if (len(text) <= 1 and i == j) or raw <= 1 else min(raw, 1.25)
        for k in range(i, j + 1):
            out.append((x + (words[k][1] - x) * scale if scale > 1 else words[k][1],
                        words[k][3] * scale, scale))
        i = j + 1
    return out


def test_fit_to_boxes_brute_force(spark):
    rng = random.Random(5)
    spans, boxes, want = [], [], {}
    for line in range(30):
        y, x, words = 15.0 * line * 10, 50.0, []
        for i in range(12):
            n = rng.randrange(1, 8)
            words.append(("w" * n, x, y, 6.0 * n, 10.0))
            x += 6.0 * n + rng.choice([6, 18])
        mine = [(rng.choice(words)[1] + rng.uniform(-9, 9), y + rng.uniform(-5, 5),
                 rng.uniform(20, 200)) for _ in range(3)]
        want[line] = brute_fit(words, mine)
        spans += [(1, 1, line, i, *w) for i, w in enumerate(words)]
        boxes += [(1, 1, line * 10 + k, *b) for k, b in enumerate(mine)]
    s = spark.createDataFrame(spans, "doc_id int, page_number int, line_no int, span_idx int, "
                                     "text string, x double, y double, width double, height double")
    b = spark.createDataFrame(boxes, "doc_id int, page_number int, box_no int, x double, "
                                     "top_y double, width double")
    got = {}
    for r in L.fit_to_boxes(s, b).orderBy("line_no", "span_idx").collect():
        got.setdefault(r.line_no, []).append((r.x, r.width, r.scale))
    for line in want:
        for g, w in zip(got[line], want[line], strict=True):
            assert all(abs(p - q) < 1e-9 for p, q in zip(g, w))


def test_spans_meet_their_boxes_in_one_join(spark):
    """The boxes of a cell are one row, so spans are neither grouped nor joined again."""
    spans = spark.createDataFrame(
        [], "doc_id int, page_number int, line_no int, span_idx int, text string, x double, "
            "y double, width double, height double")
    boxes = spark.createDataFrame(
        [], "doc_id int, page_number int, box_no int, x double, top_y double, width double")
    plan = L.match_boxes(spans, boxes)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1


def test_lines_that_span_batches_are_walked_whole(spark):
    """Groups over many Arrow batches and lines give what each line gives by itself."""
    words = [(1, 1, line, k, "wort", 10.0 + 20 * k, 50.0 + 60 * line, 15.0, 10.0)
             for line in range(3) for k in range(2500 if line == 1 else 4)]
    s = spark.createDataFrame(
        words, "doc_id int, page_number int, line_no int, span_idx int, text string, x double, "
               "y double, width double, height double")
    boxes = [(10.0, 50.0, 300.0), (30010.0, 110.0, 30000.0), (50.0, 170.0, 90.0)]
    b = spark.createDataFrame([(1, 1, k, *x) for k, x in enumerate(boxes)],
                              "doc_id int, page_number int, box_no int, x double, top_y double, width double")
    got = [(round(r.x, 6), round(r.width, 6), round(r.scale, 6))
           for r in L.fit_to_boxes(s, b).orderBy("line_no", "span_idx").collect()]
    want = []
    for line in range(3):
        want += brute_fit([w[4:] for w in words if w[2] == line], boxes)
    assert got == [tuple(round(v, 6) for v in w) for w in want]
