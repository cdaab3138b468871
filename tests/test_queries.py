"""Queries on small tables that bring out what larger ones showed."""

import hashlib

from pyspark.sql import functions as F

from tessera import stores
from tessera.operators import discovery


def test_labels_of_a_brand_are_counted_as_rows(spark, tmp_path):
    rows = [("a", "Big, small"), ("a", "BIG"), ("a", "SMALL ,other"), ("b", None), ("c", " , ")]
    spark.createDataFrame(rows, "p_brand string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    got = stores.set09_labels(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == [("a", 3), ("b", 0), ("c", 0)]
    assert "collect_list" not in got._jdf.queryExecution().toString()


def test_headings_count_plain_letters_only(spark, tmp_path):
    rows = [(1, "élé dédé abc\nplain words here"), (2, "été déjà")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = stores.srt20_headings(spark, str(tmp_path)).collect()
    assert list(map(tuple, got)) == [(1, hashlib.md5(b"plain words here").hexdigest())]


def test_letters_that_grow_in_upper_case_are_no_letters(spark):
    got = spark.createDataFrame([("Straße 1",), ("ﬁnal é",), ("ıſx",)], "t string").select(discovery.bare(F.col("t")))
    assert [r[0] for r in got.collect()] == ["STRAE1", "NAL", "ISX"]


def test_changes_of_a_part_in_several_files_all_count(spark, tmp_path):
    import datetime

    from tessera import streams

    start = datetime.datetime(2024, 1, 1)
    rows = [(k, k % 5, start + datetime.timedelta(minutes=97 * k), "view" if k % 11 else "error", 100.0 + k) for k in range(120)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp_ntz, event_type string, value double")
    for k in range(3):
        events.where(f"event_id % 3 = {k}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    want, quiet = [], datetime.timedelta(hours=streams.QUIET)
    for path in range(5):
        size = since = None
        for _, _, at, kind, value in [r for r in rows if r[1] == path] + [(0, path, rows[-1][2], "end", None)]:
            if size is not None and size > 0 and since + quiet <= at and (kind != "end" or since + quiet < at):
                want.append((str(path), size, since + quiet))
                size = -1
            if kind == "error":
                size = None
            elif size != -1 and kind != "end":
                size, since = int(value // 100), at
    got = streams.stm01_file_drop(spark, str(tmp_path)).collect()
    minute = lambda t: int(t.replace(tzinfo=datetime.timezone.utc).timestamp()) // 60
    assert sorted(map(tuple, got)) == sorted((p, s, minute(t)) for p, s, t in want)


def test_values_are_looked_for_in_their_own_documents_only(spark, monkeypatch):
    from tessera.operators import labels

    monkeypatch.delattr(labels, "matches")  # a pass over all lines with the values of all documents
    rows = [(d, 1, 0, "detail", [("Customer No", 0.0, 9.0), (f"C{d}", 10.0, 19.0)]) for d in (1, 2)]
    near = labels.neighbours(spark.createDataFrame(rows, f"doc long, page int, row_index int, role string, cells {labels.CELLS}"))
    targets = spark.createDataFrame([(1, "customer", "text", "C1"), (2, "customer", "text", "C1")], "doc long, name string, kind string, expected string")
    assert [(r.doc, r.label, r.position) for r in labels.proposed(near, targets).collect()] == [(1, "Customer No", "right")]


def test_files_of_suppliers_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    from tessera import streams

    monkeypatch.setattr(streams, "_target", lambda *_: str(tmp_path / "drop"))
    spark.createDataFrame([(k, f"s{k}") for k in range(40)], "s_suppkey long, s_name string").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    got = streams.src18_dropped_files(spark, str(tmp_path)).collect()
    assert sorted((r.s_suppkey, r.length) for r in got) == [(k, len(f"s{k}") + 1) for k in range(40)]
    assert len({f.name.split("-")[1] for f in (tmp_path / "drop" / "in").glob("*/part-*")}) > 4


def test_fields_of_groups_take_one_exchange_and_are_worked_out_once(spark, tmp_path):
    import datetime
    import re
    from decimal import Decimal

    from tessera import models

    lines = [(1, "A", 10.0), (1, "N", 5.0), (1, "R", 1.5), (2, "A", 3.0), (3, "R", 2.0), (3, "A", 1.0), (3, "R", 4.0)]
    rows = [(k, 7, 8, n, price, flag, datetime.datetime(2024, 1, 1)) for n, (k, flag, price) in enumerate(lines)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_extendedprice double, l_returnflag string, l_shipdate timestamp_ntz").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = models.exp07_field_precedence(spark, str(tmp_path))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert len(re.findall(r"role = detail\)", plan)) == 1
    assert sorted(map(tuple, got.collect())) == [(1, 1, "fixed", Decimal("6.5"), "1.50"), (3, 1, "fixed", Decimal("4"), "4.00")]


def test_lines_meet_neighbours_and_documents_in_one_exchange(spark, monkeypatch):
    import re

    from tessera.operators import labels

    plans, keep = {}, labels.staged

    def staged(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return keep(df, name)

    monkeypatch.setattr(labels, "staged", staged)
    cell = lambda t, x: (t, float(x), float(x + 9))
    rows = [(d, p, r, "detail", [cell(t, 0), cell(v, 10)]) for d in (1, 2) for p in (1, 2) for r, (t, v) in enumerate([("Total", f"{d}.0{p}"), ("No", f"C{d}")])]
    lines = spark.createDataFrame(rows, f"doc long, page int, row_index int, role string, cells {labels.CELLS}")
    docs = spark.createDataFrame([(1, "m"), (2, "m"), (3, "m")], "doc long, model string")
    rules = spark.createDataFrame([("m", "total", "Total", "right", "amount"), ("m", "under", "Total", "below", "text")], "model string, name string, label string, position string, kind string")
    got = labels.lookup(lines, docs, rules)
    exchanges = re.findall(r"Exchange hashpartitioning\((doc#[^)]*)\)", plans["picks"])
    assert len(exchanges) == 2 and all(re.fullmatch(r"doc#\d+L, \d+", x) for x in exchanges)  # lines and documents, the others are of rules
    assert not re.search(r"Filter.*size\(", plans["picks"])  # what is exploded is not worked out for a filter first
    assert sorted((r.doc, r.name, r.value) for r in got.collect()) == [(1, "total", "1.01"), (1, "under", "No"), (2, "total", "2.01"), (2, "under", "No")]


def test_long_needles_are_found_in_one_pass_by_their_heads(spark):
    from tessera.operators import needles

    wanted = [f"{k:032d}" + "tail é" * 30 for k in range(10)] + [f"{3:032d}" + "tail"] + ["x" * 40 + chr(97 + k) for k in range(12)] + ["0" * 30, "x" * 32, "b"]
    texts = [(k, " ".join(wanted[k % 5 :: 3]) + w[:-1] + w) for k, w in enumerate(wanted)] + [(99, "0" * 40), (100, None)]
    got = needles.matches(spark.createDataFrame(texts, "k long, text string"), "text", spark.createDataFrame([(w,) for w in wanted], "w string"), "w", part=1000)
    assert got._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert sorted(map(tuple, got.collect())) == sorted((k, w, t.find(w), t.rfind(w)) for k, t in texts if t for w in wanted if w in t)


def test_links_of_copies_are_compared_once_and_values_read_once(spark, tmp_path):
    import re

    from tessera import inductions

    texts = [(k, "s", "No 17\nsome line\nacc 4") for k in range(6)] + [(6, "s", "No 17\nother\nacc 5"), (7, "s", "acc 5\nx"), (8, None, "lone\nline"), (9, "t", None), (10, "u", "")]
    spark.createDataFrame(texts, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, int(k in (1, 2, 6, 7, 9))) for k, _, _ in texts], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    links = inductions.jn22_linked(spark, str(tmp_path))
    assert sorted(map(tuple, links.collect())) == [("s", 1, 0, 2, "paired"), ("s", 2, 0, 2, "paired"), ("s", 6, 6, 2, "paired"), ("s", 7, 7, 2, "paired")]
    levels = inductions.aut06_evidence_level(spark, str(tmp_path))
    assert len(re.findall(r"FileScan parquet \[[^\]]*\btext#", levels._jdf.queryExecution().executedPlan().toString())) == 1  # for the profiles alone
    assert sorted(map(tuple, levels.collect())) == [("", "invoice_only"), ("s", "paired_blueprint"), ("u", "invoice_only")]


def test_plans_are_read_off_all_pages(spark, tmp_path):
    from tessera import inductions

    lines = [f"line {k}" for k in range(25 * inductions.LINES)]
    lines[0], lines[9], lines[-8], lines[-1] = "No 17", "abcdefghijklmnop", "abcdefghijklmnop", "acc 4"
    lines[23 * inductions.LINES] = "Period 01/02/2024 to 29/02/2024"
    spark.createDataFrame([(1, "s", "\n".join(lines))], "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    (plan,) = inductions.aut06_plans(spark, str(tmp_path)).collect()
    assert (plan.n_pages, plan.has_period) == (24, True)


def test_words_of_pages_are_placed_within_a_row(spark):
    from tessera.operators import layout
    from tessera.sources import words

    texts = {1: " ".join("x" * (k % 7) for k in range(9000)) + "\n\n a  bc \tq", 2: "\n".join(f"l{k} é 𝄞x" for k in range(130)), 3: "", 4: None, 5: "\n" * 70 + "end", 6: "  "}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = []
    for d, t in texts.items():
        for n, line in enumerate((t or "").split("\n")):
            at = 0
            for k, w in enumerate(line.split(" ")):
                if w.strip(" "):
                    want.append((str(d), n // 60 + 1, n % 60 * 10000 + k, w, 5.0 * at, 12.0 * (n % 60), 5.0 * (at + len(w)), 12.0 * (n % 60) + 10))
                at += len(w) + 1
    got = words.from_text(docs)
    assert sorted(tuple(r)[:8] for r in got.collect()) == sorted(want)
    pages = words.pages(docs)
    for df in (got, layout.rows_of_lines(layout.lines_of(pages)), layout.lines_by_column(pages, [40.0])):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and "Aggregate" not in plan and "Sort" not in plan
    old = layout.visual_rows(got)
    whole = lambda df: sorted((r.doc_id, r.page, r.row_index, r.text, [tuple(c) for c in r.cells], r.x0, r.y0, r.x1, r.y1, r.role) for r in df.collect())
    assert whole(layout.rows_of_lines(layout.lines_of(pages))) == whole(layout.rows_of(layout.cells(old)))
    by_column = layout.rows_by_column(got, [40.0]).collect()
    lines = layout.lines_by_column(pages, [40.0]).collect()
    assert sorted((r.doc_id, r.page, r.reading_column, r.row_index, r.word_seq) for r in by_column) == sorted((r.doc_id, r.page, r.reading_column, r.row_index, w.word_seq) for r in lines for w in r.w)
