"""Snapshots, statement and stream sources: round trips and properties."""

import csv
import datetime as dt
import json
import os
import random
import tempfile
from pathlib import Path

from pyspark.sql import functions as F

from conftest import SF_SMALL
from tallyspark.operators import query as Q
from tallyspark.session import shared_dir
from tallyspark.sources import fixtures as FX
from tallyspark.sources import snapshot as SN
from tallyspark.sources import statements as ST
from tallyspark.streaming import statements as SS


def test_read_document_validate_and_import(spark):
    doc = {
        "exported_at": "2024-02-01T10:00:00", "source_db": "ledger.db",
        "tables": {
            "transactions": {"count": 3, "data": [
                {"transaction_date": "2024-01-05", "description": "Payroll", "amount": 100.0,
                 "balance": None, "category": "Income", "source": "Payroll", "notes": None,
                 "csv_hash": "x", "imported_at": None},
                {"transaction_date": "2024-01-05", "description": "Payroll", "amount": 100.0},
                {"transaction_date": "2024-01-06", "description": "", "amount": -5.0},
            ]},
            "person_mappings": {"count": 2, "data": [
                {"person_name": "Avery", "keyword": "payroll", "created_at": None},
                {"person_name": "Blake", "keyword": ""},
            ]},
        },
    }
    path = os.path.join(tempfile.mkdtemp(prefix="doc-"), "export.json")
    with open(path, "w") as fh:
        json.dump(doc, fh, indent=2)
    snap = SN.read_document(spark, path)
    bad = {(r.table, r["index"], r.reason) for r in SN.validate_snapshot(snap).collect()}
    assert bad == {("transactions", 2, "missing_description"),
                   ("person_mappings", 1, "missing_keyword")}
    man = {r.table: r["count"] for r in snap.manifest.collect()}
    assert man == {"transactions": 3, "person_mappings": 2}
    empty_t = spark.createDataFrame([], "transaction_date date, description string, "
                                        "amount decimal(12,2)")
    empty_m = spark.createDataFrame([], "person_name string, keyword string")
    new_t, new_m, counts = SN.import_snapshot(empty_t, empty_m, snap)
    got = {r.table: (r.incoming, r.inserted, r.skipped) for r in counts.collect()}
    assert got == {"transactions": (3, 2, 1), "person_mappings": (2, 2, 0)}
    assert new_t.filter(F.col("imported_at").isNull()).count() == 0


def test_export_order_and_counts(spark):
    t = FX.orders_ledger(spark, SF_SMALL)
    path = shared_dir(spark, "snap-test")
    man = SN.export_snapshot(t, FX.mappings(spark), path)
    counts = {r.table: r["count"] for r in man.collect()}
    assert counts == {"transactions": t.count(), "person_mappings": 8}
    snap = SN.read_snapshot(spark, path)
    dates = [r.transaction_date for r in snap.transactions.orderBy("row_id").collect()]
    assert dates == sorted(dates, reverse=True)
    ok = SN.verify_counts(snap.transactions, snap.mappings, snap.manifest)
    assert all(r.ok for r in ok.collect())


def plain_records(text):
    """(header line number, [(first line number, cells)] from the header on, whether the end is inside a
    quote) by the csv module."""
    lines = text.removeprefix("\ufeff").replace("\r\n", "\n").replace("\r", "\n").split("\n")
    lines = lines[:-1] if lines[-1] == "" else lines
    head = next((i for i, x in enumerate(lines)
                 if any(w in x.lower() for w in ("date", "amount", "description"))), 0)
    reader = csv.reader([x + "\n" for x in lines[head:]] + ["\x01"])
    out, at = [], head
    for cells in reader:
        out.append((at, cells))
        at = head + reader.line_num
    is_open = out[-1][1] != ["\x01"]
    return head, out if is_open else out[:-1], is_open


def plain_file(path):
    return plain_records(Path(path).read_bytes().decode())


def test_statement_lines_add_up(spark):
    ledger = FX.orders_ledger(spark, SF_SMALL)
    d = FX.write_statements(ledger, shared_dir(spark, "st-test"))
    want = {}
    for p in sorted(Path(d.removeprefix("file:")).rglob("*.txt")):
        head, records, _ = plain_file(p)
        names = [c.strip().lower() for c in records[0][1]] if records else []
        usable = {"transaction date", "description", "amount"} <= set(names)
        want[str(p)] = sum(1 for _, c in records[1:] if any(c)) if usable else 1
    clean, rejects = ST.read_statements(spark, d, glob="*.txt")
    got = clean.select("path").unionByName(rejects.select("path")).groupBy("path").count().collect()
    # every data record is either clean or rejected; an unusable file is one reject
    assert {r.path.removeprefix("file:"): r["count"] for r in got} == want


def test_join_records_equals_the_csv_module(spark):
    rnd = random.Random(5)
    texts = {f"f{n:03d}": "\n".join("".join(rnd.choice('"",,ab ') for _ in range(rnd.randint(0, 7)))
                                     for _ in range(rnd.randint(1, 14))) for n in range(300)}
    texts |= {"blank": "\n\n\n", "stray": 'a,5" pipe,b\nc,"d"e,f', "long": 'x,"' + "y\n" * 40 + '",z\nlast,"l"',
              "open": 'a,b\n"c,d\ne,f'}
    lines = spark.createDataFrame([(n, i, x) for n, t in texts.items() for i, x in enumerate(t.split("\n"))],
                                  "path string, idx long, line string").repartition(7)

    def rows(df):
        return {(r.path, r.idx): (r.cells, r.bad) for r in df.select(
            "path", "idx", "bad", ST._cells(F.col("line")).alias("cells")).collect()}
    want = {}
    for n, t in texts.items():
        reader, at = csv.reader([x + "\n" for x in t.split("\n")] + ["\x01"]), 0
        for cells in reader:
            if cells != ["\x01"]:
                is_open = reader.line_num == len(t.split("\n")) + 1
                want[n, at] = None if is_open else (cells or [""], None)
            at = reader.line_num
    for chunk in (1, 3, 8192):
        got = rows(ST.join_records(lines, chunk_lines=chunk))
        assert set(got) == set(want)
        for k, v in want.items():
            assert got[k][1] == "unbalanced_quote" if v is None else got[k] == v, (k, got[k], v)
    # a record of too many lines is one reject, and what follows it is read
    got = rows(ST.join_records(lines.filter("path = 'long'"), chunk_lines=3, record_lines=40))
    assert {k[1]: v[1] for k, v in got.items()} == {0: "quote_too_long", 41: None}
    got = rows(ST.join_records(lines.filter("path = 'long'"), chunk_lines=3, record_lines=41))
    assert got["long", 0] == (["x", "y\n" * 40, "z"], None)
    assert ST.join_records(lines.limit(0)).count() == 0


def test_quoted_line_breaks_in_statements(spark, tmp_path):
    files = {
        "cells.csv": 'Pre,"amble\nDate,Description,Amount,Balance\n01/15/2024,"Coffee\nShop, ""A""",1.50,\n'
                     '01/16/2024,plain,2,\n01/17/2024,5" pipe,3,\n01/18/2024,"a\n\n,b\n",4,5\n',
        "head.csv": '"Date","Description\n","Amount"\n01/15/2024,"x\ny",1\n\n01/16/2024,z,2\n',
        "open.csv": 'Date,Description,Amount\n01/15/2024,x,1\n01/16/2024,"y,2\n01/17/2024,z,3\n',
        "crlf.csv": 'Date,Description,Amount\r\n01/15/2024,"x\r\ny",1\r\n',
    }
    for n, t in files.items():
        (tmp_path / n).write_bytes(t.encode())
    want = {("cells.csv", 2, 'Coffee\nShop, "A"', 1.5), ("cells.csv", 4, "plain", 2.0),
            ("cells.csv", 5, '5" pipe', 3.0), ("cells.csv", 6, "a\n\n,b", 4.0), ("head.csv", 2, "x\ny", 1.0),
            ("head.csv", 5, "z", 2.0), ("open.csv", 1, "x", 1.0), ("crlf.csv", 1, "x\ny", 1.0)}
    name = F.element_at(F.split("path", "/"), -1)
    for split in (None, "64"):              # whole, and in splits that begin inside a cell
        if split:
            spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        try:
            clean, rejects = ST.read_statements(spark, str(tmp_path))
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert {tuple(r) for r in clean.select(
            name, "line_no", "description", F.col("amount").cast("double")).collect()} == want
        assert [tuple(r) for r in rejects.select(name, "line_no", "raw", "reason").collect()] == [
            ("open.csv", 2, '01/16/2024,"y,2', "unbalanced_quote")]


def test_stream_equals_batch(spark):
    ledger = FX.orders_ledger(spark, SF_SMALL)
    in_dir = shared_dir(spark, "s-in")
    FX.write_statements(ledger, f"{in_dir}/a")
    out, ckpt = shared_dir(spark, "s-out"), shared_dir(spark, "s-ckpt")
    SS.stream_statements(spark, in_dir, out, ckpt, glob="*.txt").awaitTermination()
    # a second run with no new file imports nothing new
    SS.stream_statements(spark, in_dir, out, ckpt, glob="*.txt").awaitTermination()
    streamed = SS.read_ledger(spark, out).select("transaction_date", "description", "amount")
    clean, _ = ST.read_statements(spark, in_dir, glob="*.txt")
    batch = clean.select("transaction_date", "description", "amount")
    assert streamed.count() == batch.count()
    assert streamed.exceptAll(batch).count() == 0 and batch.exceptAll(streamed).count() == 0


def test_stream_replay_of_a_batch_is_idempotent(spark):
    ledger = FX.orders_ledger(spark, SF_SMALL)
    in_dir = shared_dir(spark, "r-in")
    FX.write_statements(ledger, in_dir)
    out = shared_dir(spark, "r-out")
    batch = ST.binary_files(spark, in_dir, "*.txt")
    SS.import_batch(batch, 0, out)
    first = SS.read_ledger(spark, out).count()
    SS.import_batch(batch, 0, out)          # the same batch again, e.g. after a failure
    assert SS.read_ledger(spark, out).count() == first
    SS.import_batch(batch, 1, out)          # a later batch with the same files adds nothing
    assert SS.read_ledger(spark, out).count() == first


def test_page_has_next(spark):
    t = FX.orders_ledger(spark, SF_SMALL)
    n, size = t.count(), 70
    last = (n + size - 1) // size
    assert n % size and all(r.has_next for r in Q.page(t, 1, size).collect())
    rows = Q.page(t, last, size).collect()
    assert len(rows) == n - (last - 1) * size and not any(r.has_next for r in rows)
    # a full last page still offers "next" (the browser's rule), which is empty
    assert Q.page(t, last + 1, size).count() == 0


def test_watermark_defaults(spark):
    t = FX.coarse_events(spark, SF_SMALL)
    empty = t.limit(0)
    as_of = dt.date(2024, 1, 31)
    got = I_since(empty, t, as_of)
    assert got.agg(F.min("transaction_date")).first()[0] >= as_of - dt.timedelta(days=30)


def I_since(existing, incoming, as_of):
    from tallyspark.operators.ingest import since_watermark
    return since_watermark(existing, incoming, as_of)


def test_stream_accepts_late_rows_and_skips_repeats(spark):
    ledger = FX.orders_ledger(spark, SF_SMALL)
    in_dir = shared_dir(spark, "late-in")
    out, ckpt = shared_dir(spark, "late-out"), shared_dir(spark, "late-ckpt")
    recent = F.col("transaction_date") >= F.lit(dt.date(1998, 1, 1))
    FX.write_statements(ledger.filter(recent), f"{in_dir}/d1")
    SS.stream_statements(spark, in_dir, out, ckpt, glob="*.txt").awaitTermination()
    first = SS.read_ledger(spark, out).count()
    # the second drop holds older rows plus repeats of a tenth of the first drop
    FX.write_statements(ledger.filter(~recent | (F.col("id") % 10 == 0)), f"{in_dir}/d2")
    SS.stream_statements(spark, in_dir, out, ckpt, glob="*.txt").awaitTermination()
    streamed = SS.read_ledger(spark, out).select("transaction_date", "description", "amount")
    assert streamed.count() > first
    all_dir = shared_dir(spark, "late-all")
    FX.write_statements(ledger, all_dir)
    clean, _ = ST.read_statements(spark, all_dir, glob="*.txt")
    batch = clean.select("transaction_date", "description", "amount")
    assert streamed.exceptAll(batch).count() == 0 and batch.exceptAll(streamed).count() == 0


def test_many_splits_give_the_rows_of_one(spark):
    ledger = FX.orders_ledger(spark, SF_SMALL)
    d = FX.write_statements(ledger, shared_dir(spark, "split-st"))
    a, ra = ST.read_statements(spark, d, glob="*.txt")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")     # force many splits
    try:
        b, rb = ST.read_statements(spark, d, glob="*.txt")
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
        assert ra.exceptAll(rb).count() == 0 and rb.exceptAll(ra).count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_statement_files_do_not_depend_on_their_neighbours(spark, tmp_path):
    head, row = b"Date,Description,Amount\n", b"01/15/2024,x,1\n"
    files = {"a b+%41.txt": head + row, "bad.txt": b"\xef\xbb\xbfDate,Description,Amount,\xff\n" + row,
             "empty.txt": b"", "bom.txt": b"\xef\xbb\xbf", "two.txt": b"\xef\xbb\xbf" * 2 + head + row,
             "crlf.txt": (head + row).replace(b"\n", b"\r\n"), "[s]{1}.txt": head + row + row}

    def seen(clean, rejects):
        name = F.element_at(F.split("path", "/"), -1)
        return ({tuple(r) for r in clean.select(name, "line_no", "csv_hash", "description").collect()},
                {tuple(r) for r in rejects.select(name, "line_no", "reason").collect()})

    alone, beside = tmp_path / "alone", tmp_path / "beside"
    for d in (alone, beside):
        d.mkdir()
        for n, b in files.items():
            (d / n).write_bytes(b)
    (beside / "large.txt").write_bytes((b"z" * (1 << 20) + b"\n") * 66 + head + row)
    clean, rejects = seen(*ST.read_statements(spark, str(alone), glob="*.txt"))
    assert rejects == {("bad.txt", None, "invalid_utf8"), ("empty.txt", None, "empty_file"),
                       ("bom.txt", None, "missing_column"), ("two.txt", None, "missing_column")}
    assert {c[:2] for c in clean} == {("a b+%41.txt", 1), ("crlf.txt", 1), ("[s]{1}.txt", 1), ("[s]{1}.txt", 2)}
    assert len({c[2] for c in clean}) == 3
    c, r = ST.read_statements(spark, str(beside), glob="*.txt")
    small = ~F.col("path").endswith("large.txt")
    assert seen(c.filter(small), r) == (clean, rejects)
    # the stream gives the same, and an empty file's reject only once
    out = str(tmp_path / "ledger")
    for _ in range(2):
        SS.stream_statements(spark, str(alone), out, str(tmp_path / "ckpt"), glob="*.txt").awaitTermination()
        (alone / "later.txt").write_bytes(b"Nothing\n")
    got = seen(SS.read_ledger(spark, out), spark.read.schema("path string, line_no int, reason string")
               .json(f"{out}_rejects"))
    # the import keeps the first of the rows, which are all alike
    assert got == ({c for c in clean if c[:2] == ("[s]{1}.txt", 1)},
                   rejects | {("later.txt", None, "missing_column")})
    assert spark.read.json(f"{out}_rejects").filter("reason = 'empty_file'").count() == 1


def test_statement_files_are_opened_once(spark, tmp_path):
    """After their lines are stored no step opens, lists or names the files again."""
    from tallyspark.plans.inspect import plan_text
    d = FX.write_statements(FX.orders_ledger(spark, SF_SMALL), str(tmp_path / "st"))
    text = plan_text(ST.parse_statement_files(spark, d, "*.txt"), "simple")
    assert "FileScan parquet" in text and "FileScan text" not in text and "binaryFile" not in text


def test_statement_writer_opens_few_folders(spark, tmp_path):
    ledger = spark.range(4000).selectExpr(
        "id", "id * 16 AS account_id", "DATE'2024-01-15' AS transaction_date", "concat('é ', id) AS description",
        "CAST(id AS decimal(12,2)) AS amount", "CAST(NULL AS decimal(12,2)) AS balance")
    d = FX.write_statements(ledger, str(tmp_path / "st"))
    assert FX.write_statements(ledger, d) == d              # again: the same files
    found = list((tmp_path / "st").glob("**/*.txt"))
    assert len(found) == 4000 and len({f.parent for f in found}) <= FX.FOLDERS
    (one,) = (tmp_path / "st").glob("**/file_key=1000*/**/*.txt") if not (
        own := list((tmp_path / "st").glob("**/file_key=1000.txt"))) else own
    assert one.read_bytes().decode() == (
        'Account,1000\n\nTransaction Date ,DESCRIPTION,Amount,Balance,Ref\n"01/15/2024","é 1000","1000.00",,1000\n'
        .replace('"01/15/2024"', f'"{one.read_text(encoding="utf-8").splitlines()[3].split(chr(34))[1]}"'))
    clean, rejects = ST.read_statements(spark, d, glob="*.txt")
    assert clean.count() + rejects.count() == 4000


def test_stream_lists_its_folder_once_a_run(spark, tmp_path, monkeypatch):
    calls = []
    monkeypatch.setattr(SS, "empty_files", lambda *a, of=ST.empty_files: calls.append(a) or of(*a))
    src, out = tmp_path / "in", str(tmp_path / "ledger")
    src.mkdir()
    for i in range(3):
        (src / f"{i}.csv").write_text("Date,Description,Amount\n" + "".join(
            f"01/{k:02}/2024,x{k % 7},{k}\n" for k in range(1, 29 - i)))
    (src / "none.csv").write_text("")
    SS.stream_statements(spark, str(src), out, str(tmp_path / "ckpt"), max_files=1).awaitTermination()
    led = SS.read_ledger(spark, out)
    assert led.count() == 28 and len(calls) == 1
    assert spark.read.json(f"{out}_rejects").filter("reason = 'empty_file'").count() == 1
    # one file a month, however many tasks had its rows
    assert led.filter("batch_id = 0").select(F.input_file_name()).distinct().count() == 1


def _months(folder, name, months):
    (folder / name).write_text("Date,Description,Amount\n" + "".join(
        f"{m % 12 + 1:02}/15/{2000 + m // 12},{name} {m},{m + 1}\n" for m in months))


def test_stream_reads_stored_keys_from_few_files(spark, tmp_path):
    """A batch opens the key files of earlier batches, not a file a month and batch."""
    src, out = tmp_path / "in", str(tmp_path / "ledger")
    src.mkdir()
    for i in range(3):
        _months(src, f"{i}.csv", range(24))
    SS.stream_statements(spark, str(src), out, str(tmp_path / "ckpt"), max_files=1).awaitTermination()
    assert SS.read_ledger(spark, out).select(F.input_file_name()).distinct().count() == 72

    def stored():
        keys = SS._stored_keys(spark, out, SS._key_folders(spark, out))
        led = SS.read_ledger(spark, out).select(*keys.columns)
        assert keys.exceptAll(led).count() == 0 and led.exceptAll(keys).count() == 0
        return keys.inputFiles()
    files = stored()
    assert len(files) < 36 and all("/ledger_keys/" in f for f in files)
    # what is put into a batch's ledger folder, or taken out, counts: then its keys are not
    (month,) = (tmp_path / "ledger" / "batch_id=1").glob("month=2001-03")
    (file,) = month.glob("*.parquet")
    (month / "more.parquet").write_bytes(file.read_bytes())
    files = stored()
    assert any("/batch_id=1/month=2001-03/more.parquet" in f for f in files)
    assert not any("/ledger_keys/batch_id=1/" in f for f in files) and any("/ledger_keys/" in f for f in files)
    # a batch that comes again is imported as if it had not come, its key folder as well
    assert SS.read_ledger(spark, out).count() == 73
    came = SS.read_ledger(spark, out).filter("batch_id = 1").select("path").first().path
    SS.import_batch(ST.binary_files(spark, str(src), came.split("/")[-1]), 1, out)
    assert SS.read_ledger(spark, out).count() == 72 and len(stored()) < 36


def test_stream_goes_on_with_a_ledger_without_key_files(spark, tmp_path):
    """As it was written before there were any; batches without rows are in it too."""
    src, out = tmp_path / "in", str(tmp_path / "ledger")
    src.mkdir()
    _months(src, "a.csv", range(5))
    SS.import_batch(ST.binary_files(spark, str(src), "a.csv"), 0, out)
    SS.import_batch(ST.binary_files(spark, str(src), "a.csv"), 1, out)      # nothing new
    (tmp_path / "ledger_keys").rename(tmp_path / "elsewhere")
    assert set(SS._key_folders(spark, out).values()) == {None}
    (src / "b.csv").write_text((src / "a.csv").read_text() + "07/15/2003,new,7\n")
    SS.import_batch(ST.binary_files(spark, str(src), "*.csv"), 2, out)
    led = SS.read_ledger(spark, out)
    assert led.count() == 6 and led.filter("batch_id = 2").select("description").first()[0] == "new"


def test_stream_looks_files_up_in_few_tasks(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "ledger")
    src.mkdir()
    for i in range(70):
        _months(src, f"{i}.csv", range(2))
    before = dict(spark.conf.getAll)
    q = SS.stream_statements(spark, str(src), out, str(tmp_path / "ckpt"))
    q.awaitTermination()
    seen = spark.sparkContext.statusTracker()
    stages = [seen.getStageInfo(s) for j in seen.getJobIdsForGroup(str(q.runId))
              for s in seen.getJobInfo(j).stageIds]
    assert stages and max(s.numTasks for s in stages if s) <= 32
    assert SS.read_ledger(spark, out).count() == 140 and dict(spark.conf.getAll) == before


def test_parser_columns_are_built_once(spark):
    """Building them costs a stream seconds a batch; they fit any table of lines."""
    assert ST._line_columns() is ST._line_columns() and ST._header_columns() is ST._header_columns()
    for other in (spark, spark.newSession()):
        lines = other.sql("SELECT 'p' AS path, 'h' AS csv_hash, CAST(NULL AS string) AS file_reason, 1 AS header_no, "
                          "3 AS width, 1 AS p_transaction_date, 2 AS p_description, 3 AS p_amount, 0 AS p_balance, "
                          "4L AS idx, '01/15/2024,Payroll,2.50' AS line, CAST(NULL AS string) AS bad")
        (row,) = ST._parse_lines(lines).collect()
        assert (row.line_no, str(row.transaction_date), row.description, str(row.amount), row.category,
                row.reason) == (4, "2024-01-15", "Payroll", "2.50", "Income", None)
