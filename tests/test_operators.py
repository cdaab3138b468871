from datetime import date
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from tessera.functions import amounts, dates, text
from tessera.operators import diff, extracts, finance, joins, layout, sequences
from tessera.plans import expressions, interpreter, rules
from tessera.streaming import intake


def column(spark, values, kind, make):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], f"x {kind}").select(make(F.col("x"))).collect()]


def test_amounts(spark):
    assert column(spark, ["1.234,56", "12,50", "1,234", "1,234.5", "x"], "string", amounts.whole_amount) == [D("1234.56"), D("12.50"), 1234, D("1234.5"), None]
    assert column(spark, ["$1,200.50", "(3)", ""], "string", amounts.cell_amount) == [D("1200.50"), -3, None]
    assert column(spark, ["a 5 b 7,000"], "string", lambda c: amounts.grouped_amount(c, first=True)) == [5]
    assert column(spark, [D("20"), D("1"), D("0.2")], "decimal(10,2)", amounts.tax_rate) == [D("0.2"), 1, D("0.2")]


def test_dates(spark):
    texts = ["2024-01-05", "05 Jan 24", "Jan. 5, 2024", "due 5-Jan-2024 net", "05/01/2024", "31.12.1999", "1 May 70", "soon", None]
    day = date(2024, 1, 5)
    assert column(spark, texts, "string", dates.printed_date) == [day, day, day, day, day, date(1999, 12, 31), date(1970, 5, 1), None, None]
    assert column(spark, ["01/02/2024", "2024-02-03T10:00"], "string", dates.field_date) == [date(2024, 1, 2), date(2024, 2, 3)]
    assert column(spark, ["01/02/2024"], "string", dates.printed_date) == [date(2024, 2, 1)]


def test_printed_amounts(spark):
    assert column(spark, ["Fee (45.00)", "12 CR 3", "5%", "-$7.50", ".83", "1,234", "1,23", "none"], "string", amounts.printed_amount) == [D(-45), D(-3), D(5), D("-7.5"), D("0.83"), D(1234), D("1.23"), None]
    assert column(spark, ["5% of 7", "20 %"], "string", lambda c: amounts.printed_amount(c, ignore_percent=True)) == [D(7), None]


def test_containment_index(spark):
    needles = spark.createDataFrame([(1, "Alpha-beta gamma delta"), (2, "x"), (3, "not there at all, nowhere"), (4, " "), (5, None)], "n long, needle string")
    texts = spark.createDataFrame([("a", "... ALPHA beta, gamma delta ..."), ("b", "only alpha"), ("c", "x"), ("d", None)], "t string, text string")
    got = joins.contained(needles, texts, needle="needle", text="text", needle_key="n", text_key="t").collect()
    assert {(r.n, r.t) for r in got} == {(1, "a"), (2, "c")}
    plan = joins.contained(needles.where("n = 1"), texts, needle="needle", text="text", needle_key="n", text_key="t")._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_regions_that_resume_on_every_page(spark):
    rows = spark.createDataFrame([("d", p, i, t, []) for i, (p, t) in enumerate([(1, "start"), (1, "a"), (1, "foot"), (1, "b"), (2, "c"), (2, "foot"), (3, "d")])], "doc_id string, page int, row_index int, text string, cells array<struct<text:string,x0:double,x1:double>>")
    texts = lambda region: [r.text for r in interpreter.locate(rows, region).orderBy("page", "row_index").collect()]
    assert texts(interpreter.Region(("start",), ("foot",))) == ["a"]
    assert texts(interpreter.Region(("start",), ("foot",), resume=True)) == ["a", "c", "d"]
    assert texts(interpreter.Region(("start",), ("foot",), keep_anchor=True)) == ["start", "a"]
    assert texts(interpreter.Region(("start",), ("foot",), pages=(1,), resume=True)) == ["a"]


def test_text(spark):
    assert column(spark, ["Account No: 12 Date: x", "none"], "string", lambda c: text.after_label(c, "account no", ["date"])) == ["12", None]
    assert column(spark, ["USD total", "x"], "string", lambda c: text.mapped(c, {"usd": "US", "total": "T"})) == ["US", "x"]
    assert column(spark, ["Grand TOTAL"], "string", lambda c: text.has_any(c, "foo, total")) == [True]
    assert column(spark, ["abc"], "string", lambda c: text.matches(c, "(")) == [False]


DOCS = "doc_id string, subtotal decimal(18,2), tax decimal(18,2), fees decimal(18,2), current_charges decimal(18,2), total_due decimal(18,2), excluded_total decimal(18,2)"
LINES = "doc_id string, charge_type string, amount decimal(18,2), tax_amount decimal(18,2)"


@pytest.mark.parametrize(
    ("doc", "lines", "status", "computed"),
    [
        ((150, None, None, None, 150, None), [("recurring", 100), ("usage", 50)], "reconciled", 150),
        ((None, None, None, None, 115, None), [("recurring", 100), ("tax", 10), ("fee", 5)], "reconciled", 115),
        ((None, 15, None, None, 165, None), [("recurring", 100), ("recurring", 50)], "reconciled", 165),
        ((None, None, None, None, 0, None), [("recurring", 100)], "reconciled", 100),
        ((None,) * 6, [("recurring", 100)], "unverifiable", 100),
        ((None, None, None, None, 200, None), [("recurring", 100)], "mismatch", 100),
        ((100, None, None, None, None, None), [("recurring", 100), ("fee", 9)], "reconciled", 109),
        ((None, 10, 2, None, 110, None), [("recurring", 100)], "reconciled", 110),
        ((None, None, None, 90, 150, 40), [("recurring", 110)], "reconciled", 110),
    ],
)
def test_reconciliation(spark, doc, lines, status, computed):
    money = lambda x: None if x is None else D(x)
    docs = spark.createDataFrame([("d", *map(money, doc))], DOCS)
    items = spark.createDataFrame([("d", k, D(a), None) for k, a in lines], LINES)
    (row,) = finance.reconciled(docs, finance.charge_sums(items)).collect()
    assert (row.status, row.computed_total) == (status, computed)


def test_a_document_without_lines_is_compared_as_zero(spark):
    docs = spark.createDataFrame([("d", None, None, None, None, D(5), None)], DOCS)
    (row,) = finance.reconciled(docs, finance.charge_sums(spark.createDataFrame([], LINES))).collect()
    assert (row.computed_total, row.variance, row.status) == (0, -5, "mismatch")


@pytest.mark.parametrize(("cents", "total", "expected"), [([75000, 25000], 10000, [7500, 2500]), ([10000] * 3, 1000, [333, 334, 333]), ([100000, -20000], 8000, [10000, -2000]), ([0, 0], 10, [None, None])])
def test_allocation_adds_up(spark, cents, total, expected):
    rows = spark.createDataFrame([("d", i, c, total) for i, c in enumerate(cents)], "doc string, i int, cents long, tax_cents long")
    got = [r.allocated for r in finance.allocated(rows, doc="doc", order=["i"]).orderBy("i").collect()]
    assert got == expected


def test_scores_of_nothing(spark):
    empty = spark.createDataFrame([], "a int")
    one = spark.createDataFrame([(1,), (1,)], "a int")
    assert diff.scores(diff.counts(empty, empty, ["a"])).first().f1 == 1.0
    assert diff.scores(diff.counts(one, empty, ["a"])).first().f1 == 0.0
    assert [r.a for r in diff.missing(one, one.limit(1), ["a"]).collect()] == [1]


def test_region_toggles(spark):
    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate(["a", "S", "b", "SE", "c", "SE", "d", "E", "e"])], "k int, i int, t string")
    got = rules.in_region(rows, ["k"], ["i"], F.col("t").contains("S"), F.col("t").contains("E")).orderBy("i").collect()
    assert [r.t for r in got] == ["b", "d"]


def test_runs_and_islands(spark):
    rows = spark.createDataFrame([(1, 1, [1, 2, 3]), (1, 2, [1, 2, 9]), (1, 4, [1, 2]), (1, 5, [7])], "d int, page int, sig array<int>")
    assert [r.run for r in sequences.runs(rows, ["d"], "page", "sig").orderBy("page").collect()] == [1, 1, 2, 3]
    found = sequences.islands(rows, ["d"], "page").orderBy("first").collect()
    assert [(r["first"], r["last"], r.n) for r in found] == [(1, 2, 2), (4, 5, 2)]


def test_run_compare_keeps_unscored(spark):
    a = spark.createDataFrame([(1, 1.0), (2, None), (3, 1.0)], "k int, s double")
    b = spark.createDataFrame([(1, 2.0), (2, 1.0), (4, None)], "k int, s double")
    got = {r.k: r.outcome for r in joins.run_compare(a, b, ["k"], "s").collect()}
    assert got == {1: "improved", 2: "unscored", 3: "missing", 4: "new"}


def test_rows_cells_and_roles(spark):
    words = [("d", 1, k, t, x, y, x + 5 * len(t), y + 10) for k, (t, x, y) in enumerate([("Item", 0.0, 0.0), ("A", 25.0, 1.0), ("9.50", 200.0, 2.0), ("Total", 0.0, 20.0), ("9.50", 200.0, 22.0)])]
    df = spark.createDataFrame(words, "doc_id string, page int, word_seq int, text string, x0 double, y0 double, x1 double, y1 double")
    cells = layout.cells(layout.visual_rows(df)).withColumn("role", layout.cell_role(F.col("text"))).orderBy("row_index", "cell_index").collect()
    assert [(r.row_index, r.text, r.role) for r in cells] == [(0, "Item A", "text"), (0, "9.50", "amount"), (1, "Total", "summary"), (1, "9.50", "amount")]


def test_value_expressions(spark):
    one = spark.createDataFrame([(None, D(7)), (D(5), None), (None, None)], "a decimal(10,2), b decimal(10,2)")
    got = one.select(*[expressions.value_expression(op, [F.col("a"), F.col("b")]).alias(op) for op in ("extract", "sum", "subtract", "product")]).collect()
    assert [tuple(r) for r in got] == [(7, 7, None, None), (5, 5, 5, None), (None, None, None, None)]
    with pytest.raises(ValueError, match="unknown operation"):
        expressions.plan_expression({"op": "divide"})


def test_intake_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.pdf").write_bytes(b"one")
    (tmp_path / "in/empty.pdf").write_bytes(b"")
    stream = intake.dropped_files(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("intake").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    stream.awaitTermination(60)
    assert [r.length for r in spark.table("intake").collect()] == [3]


def cells_of(spark, rows):
    return spark.createDataFrame([("d", 1, *r) for r in rows], "doc_id string, page int, row_index int, cell_index int, text string, x0 double, y0 double, x1 double, y1 double")


def test_columns_bands_and_tables(spark):
    cells = cells_of(spark, [(0, 0, "Item", 0.0, 0.0, 40.0, 10.0), (0, 1, "Amount", 200.0, 0.0, 240.0, 10.0), (1, 0, "A", 0.0, 20.0, 10.0, 30.0), (1, 1, "B", 15.0, 20.0, 20.0, 30.0), (1, 2, "9.50", 210.0, 20.0, 240.0, 30.0), (2, 0, "late", 0.0, 120.0, 30.0, 130.0)])
    got = {r.row_index: (r.left, ) for r in layout.in_column(cells, 0, 60, "left").collect()}
    assert got == {0: ("Item",), 1: ("A B",), 2: ("late",)}
    assert {r.row_index: r.amount for r in layout.in_column(cells, 200, 260, "amount").collect()}[2] is None
    rows = cells.groupBy("doc_id", "page", "row_index").agg(F.min("y0").alias("y0"), F.max("y1").alias("y1"))
    assert [r.table for r in layout.table_regions(rows, F.col("row_index") >= 0).orderBy("row_index").collect()] == [1, 1, 2]
    found = layout.cells_by_band(cells.where("row_index > 0"), layout.bands(cells.where("row_index = 0"))).collect()
    assert {(r.text, r.band) for r in found} == {("A", "Item"), ("B", "Item"), ("9.50", "Amount"), ("late", "Item")}


def brute_gutter(rows, width):
    """The best place to part rows of words (x0, x1), tried one by one."""
    words = [w for r in rows for w in r]
    c0, c1, n = min(a for a, _ in words), max(b for _, b in words), len(rows)
    if n < 15 or len(words) < 40 or c1 - c0 < width * 0.45:
        return None
    best, k, lo = None, 0, c0 + 0.35 * (c1 - c0)
    while (x := lo + 3.0 * k) <= c0 + 0.65 * (c1 - c0):
        left, right = sum(all(b <= x for _, b in r) for r in rows), sum(all(a >= x for a, _ in r) for r in rows)
        if (left + right) / n >= 0.6 and min(left, right) >= 0.15 * n:
            key = (abs(left - right), sum(a < x < b for a, b in words), abs(x - (c0 + c1) / 2), x)
            best = min(best or (key, 0), (key, (left + right) / n))
        k += 1
    return best and (round(best[1], 9), round(best[0][3], 6), round(best[0][3] / width * 1000, 2))


def test_gutters_equal_trying_every_place(spark):
    import random

    rnd, pages = random.Random(2), {}
    for p in range(40):
        rows = []
        for r in range(rnd.choice([14, 15, 24, 40])):
            side = rnd.choice([0, 300, 300, 0, 150]) if p % 3 else rnd.choice([0, 300])
            rows.append([(float(x := side + rnd.randrange(0, 250, 5)), float(x + rnd.choice([0, 15, 30, 60]))) for _ in range(rnd.randrange(1, 5))])
        pages[p] = rows
    pages[40] = [[(3.0 * k, 3.0 * k + 9) for k in range(3)] for _ in range(30)]  # too narrow
    words = [("d", p, r, a, b, 612.0) for p, rows in pages.items() for r, row in enumerate(rows) for a, b in row]
    got = layout.gutters(spark.createDataFrame(words, "doc_id string, page int, row_index int, x0 double, x1 double, page_width double")).collect()
    want = {p: g for p, rows in pages.items() if (g := brute_gutter(rows, 612.0))}
    assert {r.page: (round(r.fraction, 9), round(r.x, 6), r.normal_x) for r in got} == want and 5 < len(want) < 40


def test_rows_are_numbered_through_the_columns(spark):
    words = spark.createDataFrame([("d", 1, k, t, x, y, x + 20, y + 8) for k, (t, x, y) in enumerate([("a", 0.0, 0.0), ("b", 300.0, 1.0), ("c", 0.0, 20.0), ("d", 300.0, 21.0), ("e", 290.0, 40.0), ("f", 25.0, 20.0)])], "doc_id string, page int, word_seq int, text string, x0 double, y0 double, x1 double, y1 double")
    got = layout.rows_by_column(words, [300.0]).collect()
    assert {(r.text, r.reading_column, r.row_index) for r in got} == {("a", 0, 0), ("c", 0, 1), ("f", 0, 1), ("b", 1, 2), ("d", 1, 3), ("e", 1, 4)}


def test_steady_clock_and_budget(spark):
    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate([5, 5, 3, 20, 20, 9, 40])], "k int, i int, t long")
    assert [r.s for r in extracts.steady_clock(rows, ["k"], "i", "t", "s").orderBy("i").collect()] == [5, 6, 7, 20, 21, 22, 40]
    assert [r.i for r in extracts.within_budget(rows, ["k"], ["i"], F.col("t"), 13).orderBy("i").collect()] == [0, 1, 2]
    assert [r.i for r in extracts.within_budget(rows, ["k"], ["i"], F.col("t"), 1).collect()] == [0]


def test_inferred_formats(spark):
    rows = spark.createDataFrame([("a", 1, "01/02/2024"), ("a", 2, "x 14/02/2024"), ("a", 3, "02/14/2024"), ("b", 1, "1/2/2024")], "k string, i int, t string")
    assert [tuple(r) for r in extracts.date_formats(rows, ["k"], "t", "i").collect()] == [("a", "d/M/yyyy")]
    assert column(spark, ["0.0000", "10.0000", "0.0500"], "string", lambda c: extracts.rate_text(c.cast("double"))) == ["0", "10", "0.05"]
    assert column(spark, ["Account", "12", "ab", None], "string", extracts.label_like) == [True, False, False, None]


def _in_rows(words, tolerance=3.0):
    """Rows of words (y0, x0, y1, word_seq) of one page, one word after another."""
    rows = []
    for y0, _, y1, seq in sorted(words, key=lambda w: (w[0], w[1], w[3])):
        centre = (y0 + y1) / 2
        row = next((r for r in rows if abs(centre - r[0] / len(r[1])) <= tolerance), None)
        if row is None:
            rows.append(row := [0.0, []])
        row[0] += centre
        row[1].append(seq)
    return {seq: k for k, (_, held) in enumerate(sorted(rows, key=lambda r: r[0] / len(r[1]))) for seq in held}


def test_words_are_dealt_once_and_rows_are_as_one_by_one(spark):
    import random

    from tessera.sources import words

    draw = random.Random(3)
    pages = {p: [(draw.randrange(0, 120) * 0.5, float(draw.randrange(0, 9)), 0.0, k) for k in range(80)] for p in range(1, 6)}
    pages = {p: [(y0, x0, y0 + draw.choice([8.0, 8.0, 10.0, 12.0]), k) for y0, x0, _, k in held] for p, held in pages.items()}
    made = [("d", p, k, "t", x0, y0, x0 + 4, y1) for p, held in pages.items() for y0, x0, y1, k in held]
    got = layout.visual_rows(spark.createDataFrame(made, "doc_id string, page int, word_seq int, text string, x0 double, y0 double, x1 double, y1 double")).collect()
    assert {(r.page, r.word_seq): r.row_index for r in got} == {(p, seq): k for p, held in pages.items() for seq, k in _in_rows(held).items()}
    docs = spark.createDataFrame([(1, "a bc  d\n\ne"), (2, None)], "doc_id long, text string")
    rows = layout.rows_of(layout.cells(layout.visual_rows(words.from_text(docs)), gap=4.0))
    assert [(r.row_id, r.text, [(c.text, c.x0, c.x1) for c in r.cells]) for r in rows.orderBy("row_index").collect()] == [("p1.r1", "a bc d", [("a", 0, 5), ("bc", 10, 20), ("d", 30, 35)]), ("p1.r2", "e", [("e", 0, 5)])]
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Python" not in plan and "Arrow" not in plan


def test_page_profiles_read_cells_once(spark):
    rows = [("d", 1, r, k, float(x)) for r in range(4) for k, x in enumerate((5, 25, 45 + 20 * r))] + [("d", 2, 0, 0, 5.0)]
    got = layout.page_profiles(spark.createDataFrame(rows, "doc_id string, page int, row_index int, cell_index int, x0 double"))
    assert list(map(tuple, got.collect())) == [("d", 1, 4, [0, 1])]
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()


def test_rows_by_column_and_gutters_join_nothing(spark):
    words = spark.createDataFrame([("d", 1, 0, "a", 0.0, 0.0, 9.0, 10.0, 612.0)], "doc_id string, page int, word_seq int, text string, x0 double, y0 double, x1 double, y1 double, page_width double")
    rows = layout.rows_by_column(words, [300.0])
    for df in (rows, layout.gutters(rows)):
        assert "Join" not in df._jdf.queryExecution().executedPlan().toString()


def test_amounts_are_read_once_each(spark):
    rows = spark.createDataFrame([("d", 1, k, t, [(t, 0.0, 1.0)]) for k, t in enumerate(["A x", "N (1,234.50)", "R 2.25", "A y", "N none", "A z", "N 3"])], f"doc_id string, page int, row_index int, text string, cells {'array<struct<text:string,x0:double,x1:double>>'}")
    source = lambda role, last=False: interpreter.Source(role, last=last, column="c")
    model = interpreter.Model(interpreter.Region(columns={"c": (0.0, 9.0)}), (("start", {"row_text": "^A "}), ("tax", {"row_text": "^R "})), ("transition", "start"), {"combined": interpreter.Rule(sources=(source("detail", True), source("tax")), kind="decimal")})
    got = interpreter.candidates(rows, model).select("group", "combined")
    assert got._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 2
    assert sorted(map(tuple, got.collect())) == [(1, D("-1232.25")), (2, None), (3, D(3))]
