"""Bank-statement CSV files -> clean typed ledger rows and rejects (S1-S7).

Plan shape: files of every size are read with the split ``text`` source, so no file
is read by one task. They are listed and opened once: their lines are written to the
shared checkpoint folder, and every later step reads that copy, as opening a folder of
many small files costs more than its bytes. Exact line numbers come from per-split
offsets. One per-file
aggregate gives the content hash (S6), the UTF-8 check, the header (S2), its aliases
and required columns (S3, S4) and whether a quoted cell runs over a line's end. This
table (a row a file) is written once, so that its size is known when the lines meet it:
small, it is broadcast and no line moves. Files without a line (0 bytes, or a BOM
alone) are known from the listing only, which is gone through if it counts more files
than have lines.

A quoted cell may hold line breaks. Only files in which some line ends inside a quote
go through ``join_records``, which finds the state at every line's start in chunks of
lines and joins the lines of one record; the others are read line by line, which gives
the same rows. Line breaks inside a cell become ``\n``, whichever they were.
One quote-aware regular expression splits the cells; every cell goes through the
native-Column parsers.
Bad rows become rejects with a reason instead of failing the job (S7). A record that the
file's end leaves open is one reject (``unbalanced_quote``) with its first line; so is one
of over ``RECORD_LINES`` lines (``quote_too_long``), as a record is one row of one task.
"""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.classify import categorize, extract_source
from ..functions.parse import is_na, parse_amount, parse_balance, with_parsed_dates
from ..functions.text import strip_ws
from ..schema import REJECTS, conform
from ..session import built_once, shared_dir, stored
from .lines import numbered, split_offsets, text_lines

# Header aliases (compared trimmed and lower-case).
ALIASES = {
    "transaction_date": ["date", "transaction date", "transactiondate"],
    "description": ["description"],
    "amount": ["amount"],
    "balance": ["balance"],
}
REQUIRED = ["transaction_date", "description", "amount"]
# A line is the header when its lower-case text contains one of
# these ("date" also covers "transaction date" and "transactiondate").
HEADER_WORDS = ["date", "amount", "description"]

CLEAN_COLUMNS = ["path", "line_no", "csv_hash", "transaction_date", "description", "amount",
                 "balance", "category", "source"]


# A quoted part (doubled quotes inside) closes at the first single quote; what follows up to the
# comma belongs to the cell as it stands. A quote elsewhere than at a cell's start is plain text.
INSIDE = r'(?:[^"]++|"")*+'
CSV_FIELD = rf',("{INSIDE}"[^,]*+|[^,]*+)'
# The rest of a line, from a cell's start on, that ends inside a quoted part.
LEFT_OPEN = rf'(?:(?:"{INSIDE}"[^,]*+|[^",][^,]*+|),)*+"{INSIDE}\z'

CHUNK_LINES = 8192        # lines whose states one task works out together
RECORD_LINES = 100_000    # most lines of one record


def _cells(line: Column) -> Column:
    """All CSV fields of a record (one regex pass), quotes removed."""
    raw = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(CSV_FIELD), 1)

    def unquote(f):
        inner = F.regexp_extract(f, f'^"({INSIDE})"', 1)
        rest = F.substring(f, F.length(inner) + 3, F.length(f))
        return F.when(f.rlike(f'^"{INSIDE}"'),
                      F.concat(F.replace(inner, F.lit('""'), F.lit('"')), rest)).otherwise(f)
    return F.transform(raw, unquote)


def _opens(line: Column) -> Column:
    """Whether a line that starts outside of quotes ends inside."""
    return F.when(line.contains('"'), line.rlike("^" + LEFT_OPEN)).otherwise(False)


def _stays_open(line: Column) -> Column:
    """Whether a line that starts inside of quotes ends inside."""
    return F.when(line.contains('"'),
                  line.rlike(rf'^{INSIDE}(?:\z|"[^,]*+,{LEFT_OPEN})')).otherwise(True)


def _with_state(rows: DataFrame, part: list[str], pos: str) -> DataFrame:
    """Each row is a step of the state 0 (outside) or 1 (inside): ``o`` and ``i`` are what it makes of
    them. Adds the state before the row if the first row of ``part`` starts outside (``st0``) or
    inside (``st1``): the last step that gives the same for both, and the swaps since then."""
    before = Window.partitionBy(*part).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    swap = F.when((F.col("o") == 1) & (F.col("i") == 0), 1).otherwise(0)
    rows = rows.withColumn("swaps", F.coalesce(F.sum(swap).over(before), F.lit(0)))
    fixed = F.when(F.col("o") == F.col("i"), (F.col("o") + F.col("swaps")) % 2)
    rows = rows.withColumn("fixed", F.last(fixed, ignorenulls=True).over(before))
    return rows.select("*", *[((F.coalesce("fixed", F.lit(s)) + F.col("swaps")) % 2).alias(f"st{s}")
                              for s in (0, 1)]).drop("swaps", "fixed")


def join_records(lines: DataFrame, chunk_lines: int | None = None,
                 record_lines: int | None = None) -> DataFrame:
    """``lines(path, idx, line)``, each file from a record's start on -> (path, idx, line, bad): one
    row a record under the number of its first line, its lines joined by ``\n``. ``bad`` is the
    reason why a record is none (then ``line`` is its first line), else NULL.

    A chunk of lines is worked out for both states it may start in, and is then itself one step
    (a row) in the running state of its file; no task takes more than a chunk's lines."""
    chunk_lines, record_lines = chunk_lines or CHUNK_LINES, record_lines or RECORD_LINES
    rows = lines.select("path", "idx", "line", _opens(F.col("line")).cast("int").alias("o"),
                        _stays_open(F.col("line")).cast("int").alias("i"),
                        F.floor(F.col("idx") / chunk_lines).alias("chunk"))
    rows = _with_state(rows, ["path", "chunk"], "idx")
    upto = Window.partitionBy("path", "chunk").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("*", *[F.max(F.when(F.col(f"st{s}") == 0, F.col("idx"))).over(upto).alias(f"rec{s}")
                              for s in (0, 1)])

    def after(s):
        return F.when(F.col(f"st{s}") == 0, F.col("o")).otherwise(F.col("i"))
    chunks = rows.groupBy("path", "chunk").agg(
        F.max_by(after(0), "idx").alias("o"), F.max_by(after(1), "idx").alias("i"),
        F.max("rec0").alias("last0"), F.max("rec1").alias("last1"))
    chunks = _with_state(chunks, ["path"], "chunk").withColumn(
        "last", F.when(F.col("st0") == 0, F.col("last0")).otherwise(F.col("last1")))
    order = Window.partitionBy("path").orderBy("chunk")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    chunks = chunks.select(
        "path", "chunk", F.col("st0").alias("start"),
        F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("earlier"),
        F.when(F.last(after(0)).over(whole) == 1, F.max("last").over(whole)).alias("open_rec"))
    rec = F.coalesce(F.when(F.col("start") == 0, F.col("rec0")).otherwise(F.col("rec1")), F.col("earlier"))
    rows = rows.select("path", "chunk", "idx", "line", "rec0", "rec1").join(chunks, ["path", "chunk"]).select(
        "path", "idx", "line", rec.alias("rec"), F.coalesce(F.col("open_rec") == rec, F.lit(False)).alias("open"))
    # of a record that ends nowhere only the first line is taken, of one too long only what tells so
    rows = rows.filter((F.col("idx") == F.col("rec")) | ~F.col("open")
                       & (F.col("idx") - F.col("rec") <= record_lines))
    recs = rows.groupBy("path", "rec").agg(
        F.array_sort(F.collect_list(F.struct("idx", "line"))).alias("ls"), F.max("open").alias("open"))
    bad = (F.when(F.col("open"), "unbalanced_quote")
           .when(F.size("ls") > record_lines, "quote_too_long"))
    text = F.when(bad.isNull(), F.array_join(F.col("ls.line"), "\n")).otherwise(
        F.element_at("ls", 1).getField("line"))
    return recs.select("path", F.col("rec").alias("idx"), text.alias("line"), bad.alias("bad"))


def _is_header(line: Column, strict: bool) -> Column:
    low = F.lower(line)
    if strict:
        return low.contains("date") & low.contains("amount") & low.contains("description")
    return low.rlike("|".join(HEADER_WORDS))


def _alias_test(words: list[str]):
    return lambda h: F.coalesce(h.isin(words), F.lit(False))


@built_once
def _header_columns() -> tuple[dict[str, Column], dict[str, Column], Column]:
    """The columns that ``_resolve_header`` adds: names and width, then positions, then the verdict."""
    names = F.transform(_cells(F.col("header")), lambda h: F.lower(strip_ws(h)))
    places = {}
    for target, words in ALIASES.items():
        flags = F.transform("names", _alias_test(words))
        places[f"n_{target}"] = F.size(F.filter(flags, lambda x: x))
        places[f"p_{target}"] = F.array_position(flags, True).cast("int")
    reason = (F.when(~F.col("utf8"), "invalid_utf8")
              .when(F.col("empty"), "empty_file"))
    for target in ALIASES:
        reason = reason.when(F.col(f"n_{target}") > 1, "duplicate_column")
    for target in REQUIRED:
        reason = reason.when(F.col(f"n_{target}") == 0, "missing_column")
    return {"names": names}, {"width": F.size("names"), **places}, reason


def _resolve_header(f: DataFrame) -> DataFrame:
    """From per-file ``header`` text (plus ``utf8``/``empty`` flags): names,
    width, column positions and the file-level verdict ``file_reason``."""
    names, places, reason = _header_columns()
    return f.withColumns(names).withColumns(places).withColumn("file_reason", reason)


def _line_hash(idx: Column, line: Column) -> Column:
    """120 bits of a line's text and number, to be combined by xor over a file's lines."""
    h = F.md5(F.concat(idx.cast("string"), F.lit("|"), line))
    return F.struct(F.conv(F.substring(h, 1, 15), 16, 10).cast("long").alias("a"),
                    F.conv(F.substring(h, 16, 15), 16, 10).cast("long").alias("b"))


def _file_hash(size: Column, n: Column, a: Column, b: Column) -> Column:
    """``csv_hash``: of the file's bytes in all, its lines and their order, nothing else (two
    files that differ only in which line ends are CR LF, at equal size, are alike)."""
    return F.md5(F.concat_ws("|", *[F.coalesce(c, F.lit(0)).cast("string")
                                    for c in (size, n, a, b)]))


@built_once
def _line_columns() -> tuple[Column, list[Column], list[Column], list[Column], list[Column]]:
    """The columns of ``_parse_lines``: the cells, then what each of its stages selects."""
    def cell(p: str) -> Column:
        return F.when(F.col(p) > 0, F.get(F.col("cells"), F.col(p) - 1))

    in_width = F.slice("cells", 1, F.greatest(F.col("width"), F.lit(1)))
    is_file = F.col("file_reason").isNotNull()
    texts = [
        "path", "csv_hash", "file_reason", "p_balance",
        F.when(~is_file, F.col("idx")).cast("int").alias("line_no"),
        F.col("line").alias("raw"),
        cell("p_transaction_date").alias("date_raw"),
        cell("p_description").alias("desc_raw"),
        cell("p_amount").alias("amount_raw"),
        cell("p_balance").alias("balance_raw"),
        "bad",
        F.exists(F.slice("cells", F.col("width") + 1, F.greatest(F.size("cells") - F.col("width"), F.lit(0))),
                 lambda c: c != "").alias("too_wide"),
        (is_file | F.col("bad").isNotNull() | F.exists(in_width, lambda c: ~is_na(c))).alias("keep"),
    ]
    bal = parse_balance(F.col("balance_raw"))
    parsed = [
        "*", parse_amount(F.col("amount_raw")).alias("amt"),
        F.when(F.col("p_balance") > 0, bal.getField("value")).alias("bal"),
        (F.col("p_balance").isNull() | (F.col("p_balance") == 0) | bal.getField("ok"))
        .alias("bal_ok"),
        F.when(is_na(F.col("desc_raw")), F.lit("nan")).otherwise(strip_ws(F.col("desc_raw")))
        .alias("desc")]
    reason = (F.when(is_file, F.col("file_reason"))
              .when(F.col("bad").isNotNull(), F.col("bad"))
              .when(F.col("too_wide"), "too_wide")
              .when(F.col("date").isNull(), "bad_date")
              .when(F.col("amt").isNull(), "bad_amount")
              .when(~F.col("bal_ok"), "bad_balance"))
    out = [
        "path", "line_no", "csv_hash", "raw", reason.alias("reason"),
        F.when(~is_file, F.col("date")).alias("transaction_date"),
        F.when(~is_file, F.col("desc")).alias("description"),
        F.when(~is_file, F.col("amt")).alias("amount"),
        F.when(~is_file, F.col("bal")).alias("balance")]
    classified = [
        "path", "line_no", "csv_hash", "raw", "transaction_date", "description", "amount",
        "balance",
        F.when(F.col("reason").isNull(), categorize(F.col("description"), F.col("amount")))
        .alias("category"),
        F.when(F.col("reason").isNull(), extract_source(F.col("description"), F.col("amount")))
        .alias("source"),
        "reason"]
    return _cells(F.col("line")), texts, parsed, out, classified


def _parse_lines(lines: DataFrame) -> DataFrame:
    """Records (path, csv_hash, file_reason, header_no, width, p_*, idx, line, bad)
    -> parsed rows with a reject ``reason``.

    Each stage adds named columns (cells, raw cell texts, parsed values,
    reason), so every parser runs once per record and the generated code stays
    small."""
    cells, texts, parsed, out, classified = _line_columns()
    rows = lines.withColumn("cells", cells).select(*texts).filter("keep")
    return with_parsed_dates(rows, {"date": "date_raw"}).select(*parsed).select(*out).select(*classified)


def empty_files(spark: SparkSession, path: str, glob: str = "*.csv") -> DataFrame:
    """(path, size 0) of the 0-byte files, which no scan returns: the names of the
    listing that the scan of the listing's metadata does not have."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", glob)
             .option("recursiveFileLookup", "true").load(path))
    names = [(re.sub("^file:///", "file:/", unquote(n)),) for n in files.inputFiles()]
    return (spark.createDataFrame(names, "path string").join(files.select("path"), "path", "left_anti")
            .select("path", F.lit(0).cast("long").alias("size")))


def _listing(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """(path, size) of every file, from metadata only."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", glob)
             .option("recursiveFileLookup", "true").load(path))
    return files.select("path", F.col("length").alias("size")).unionByName(
        empty_files(spark, path, glob))


def _count_files(scan: DataFrame) -> int:
    """How many files the listing of ``scan`` holds; their names stay where the listing is."""
    try:
        return len(scan._jdf.inputFiles())
    except AttributeError:      # Spark Connect: no JVM handle
        return len(scan.inputFiles())


def _listed(spark: SparkSession, path: str, glob: str, scan: DataFrame, raw: DataFrame) -> DataFrame:
    """(path, size) of every file under ``path``: as its lines say, if all files have some."""
    sizes = stored(raw.groupBy("path").agg(F.max("size").alias("size")), "statement-sizes")
    if _count_files(scan) == sizes.count():
        return sizes
    return _listing(spark, path, glob)


def _file_table(lines: DataFrame, listed: DataFrame, strict_header: bool) -> DataFrame:
    """A row a file, written to the shared checkpoint folder: hash, header line, ``multi`` (some line
    ends inside a quote) and the flags of the verdict."""
    looks = _is_header(F.col("line"), strict_header)
    h = _line_hash(F.col("idx"), F.col("line"))
    per_file = lines.groupBy("path").agg(
        F.min(F.when(looks, F.struct("idx", "line"))).alias("hit"),
        F.min(F.struct("idx", "line")).alias("first"),
        F.count(F.lit(1)).alias("n"),
        F.bit_xor(h["a"]).alias("a"), F.bit_xor(h["b"]).alias("b"),
        F.max(_opens(F.col("line"))).alias("multi"),
        F.min(F.is_valid_utf8("line").cast("int")).alias("utf8"))
    header = F.coalesce(F.col("hit"), F.col("first"))
    return stored(listed.join(per_file, "path", "left").select(
        "path",
        _file_hash(F.col("size"), F.col("n"), F.col("a"), F.col("b")).alias("csv_hash"),
        (F.coalesce(F.col("utf8"), F.lit(1)) == 1).alias("utf8"),
        (F.col("size") == 0).alias("empty"),
        F.coalesce("multi", F.lit(False)).alias("multi"),
        (F.coalesce(header.getField("idx"), F.lit(0)) + 1).cast("int").alias("header_no"),
        F.coalesce(header.getField("line"), F.lit("")).alias("header")), "statement-files")


def _records_of(lines: DataFrame, files: DataFrame) -> DataFrame:
    """The records of ``files(path, header_no)`` from the header on."""
    own = lines.join(files, "path").filter(F.col("idx") + 1 >= F.col("header_no"))
    return join_records(own.select("path", "idx", "line"))


def parse_statement_files(spark: SparkSession, path, glob: str = "*.csv",
                          strict_header: bool = False,
                          listed: DataFrame | None = None) -> DataFrame:
    """Statement files -> one row per record with parsed values and a ``reason`` (NULL for
    clean rows), plus one row per rejected file. Every stage is split: files are read by many
    tasks, and lines meet their file's header through a join with the stored file table
    (broadcast when small; AQE splits a hot file's lines otherwise).

    ``path`` is a folder (with ``glob``) or a list of the names of files with bytes in
    them; a list needs ``listed(path, size)``, which may name 0-byte files too."""
    scan = text_lines(spark, path, glob)
    raw = stored(scan, "statement-lines")
    if listed is None:
        lines = numbered(raw)
        listed = _listed(spark, path, glob, scan, raw)
    else:       # a list is bounded: its splits are counted once
        lines = numbered(raw, stored(split_offsets(raw), "statement-splits"))
    files = _file_table(lines, listed, strict_header)
    # two flags over the file table: plans without a quoted line break need no joining of lines
    multi = F.col("multi") & F.col("utf8")
    any_multi, any_head = files.agg(F.max(multi), F.max(multi & _opens(F.col("header")))).first()
    if any_head:
        open_heads = files.filter(multi & _opens(F.col("header"))).select("path", "header_no")
        heads = _records_of(lines, open_heads).join(open_heads, "path").filter(
            F.col("idx") + 1 == F.col("header_no")).select("path", F.col("line").alias("head"))
        files = files.join(heads, "path", "left").withColumn(
            "header", F.coalesce("head", "header")).drop("head")
    cols = ["path", "csv_hash", "file_reason", "header_no", "width", "p_transaction_date",
            "p_description", "p_amount", "p_balance"]
    known = _resolve_header(files)
    accepted = known.filter(F.col("file_reason").isNull())
    rows = lines.select("path", "idx", "line", F.lit(None).cast("string").alias("bad")).join(
        accepted.filter(~multi).select(*cols), "path")
    if any_multi:
        records = _records_of(lines, files.filter(multi).select("path", "header_no"))
        rows = rows.unionByName(records.join(accepted.filter(multi).select(*cols), "path"))
    data = rows.filter((F.col("idx") + 1 > F.col("header_no")) & (F.col("line") != ""))
    markers = known.filter(F.col("file_reason").isNotNull()).select(
        *cols, F.lit(None).cast("long").alias("idx"), F.lit(None).cast("string").alias("line"),
        F.lit(None).cast("string").alias("bad"))
    return _parse_lines(data.select(*cols, "idx", "line", "bad").unionByName(markers))


def read_large_statements(spark: SparkSession, path: str, strict_header: bool = False,
                          glob: str = "*.csv", out_dir: str | None = None
                          ) -> tuple[DataFrame, DataFrame]:
    """``read_statements``: one reader serves files of every size."""
    return read_statements(spark, path, strict_header, glob, out_dir)


def split_parsed(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(clean, rejects) from ``parse_statement_files``. Both read the same
    lineage; ``read_statements`` materializes it once instead."""
    clean = parsed.filter(F.col("reason").isNull()).select(*CLEAN_COLUMNS)
    rejects = parsed.filter(F.col("reason").isNotNull()).select("path", "line_no", "raw",
                                                                "reason")
    return clean, rejects


def binary_files(spark: SparkSession, path: str, glob: str = "*.csv") -> DataFrame:
    return (spark.read.format("binaryFile").option("pathGlobFilter", glob)
            .option("recursiveFileLookup", "true").load(path).select("path", "content"))


def write_parsed(parsed: DataFrame, out_dir: str) -> str:
    """Write parsed lines once, partitioned by ``status`` (clean/reject)."""
    status = F.when(F.col("reason").isNull(), "clean").otherwise("reject")
    parsed.withColumn("status", status).write.mode("overwrite").partitionBy("status") \
        .parquet(out_dir)
    return out_dir


def read_parsed(spark: SparkSession, out_dir: str) -> tuple[DataFrame, DataFrame]:
    """(clean, rejects) from a ``write_parsed`` folder (partition pruning on status)."""
    t = spark.read.parquet(out_dir)
    clean = t.filter(F.col("status") == "clean").select(*CLEAN_COLUMNS)
    rejects = conform(t.filter(F.col("status") == "reject"), REJECTS)
    return clean, rejects


def read_statements(spark: SparkSession, path: str, strict_header: bool = False,
                    glob: str = "*.csv", out_dir: str | None = None
                    ) -> tuple[DataFrame, DataFrame]:
    """Read every statement file under ``path`` at once -> (clean, rejects).

    The files are parsed in one job and the result is written once to
    ``out_dir`` (default: a new folder under the shared checkpoint folder),
    partitioned by status; clean rows and rejects are then two pruned reads.
    Writing cuts the lineage, so neither side re-parses the files and a lost
    executor never forces a re-parse.
    """
    out_dir = out_dir or shared_dir(spark, "statements-parsed")
    write_parsed(parse_statement_files(spark, path, glob, strict_header), out_dir)
    return read_parsed(spark, out_dir)
