"""Secret scans over an incremental blob ledger.

Every version of every path (document) is content-addressed by its SHA-256. The ledger is a
folder of three Parquet tables:

* ``versions`` (path, blob): every historical version ever seen;
* ``findings`` (blob, kind, rule_version, start, stop, value_sha256);
* ``scanned`` (blob, kind, rule_version): the pairs whose scan is complete.

``update`` scans only the (blob, rule version) pairs that ``scanned`` lacks, each blob once
however many paths hold it, and ``findings_by_path`` joins findings back to all paths. A batch
writes its findings before its ``scanned`` rows, so a batch that died is scanned again, and
readers drop the repeats.

Which row's text stands for a blob is settled on hashes and ids alone; texts are then moved by
(blob, id), so a text with very many copies does not meet in one task.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.session import shared_dir

from .common import free_name, read, read_or_empty, slices, stored, subset


@dataclass(frozen=True)
class Rule:
    """A kind of secret: leftmost non-overlapping matches of ``pattern`` are kept if ``group``
    has at least ``least`` characters. Raise ``version`` with any change of the pattern."""
    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 0


# Fixed values of the contract; ``pem`` is the method's own addition. For access and hex a match
# is a run up to its end, so a shorter run can be skipped inside the pattern itself. A pem match is
# the key up to its END line, without one the lines of base64 that follow.
RULES = (
    Rule("assign", 1, r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?"
                      r"([A-Za-z0-9+/_.=-]+)", 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}", 0, 20),
    Rule("hex", 1, r"[0-9a-f]{24,}", 0, 24),
    Rule("pem", 2, r"-----BEGIN ((?:[A-Z]+ )*)PRIVATE KEY-----"
                   r"(?:(?:[^-]|-(?!-))*+-----END \1PRIVATE KEY-----|(?:\s+[A-Za-z0-9+/=]{16,})*+)", 0, 0),
)
BASE = ("assign", "access", "hex")

FINDINGS = ("blob binary, kind string, rule_version int, start long, stop long, "
            "value_sha256 string")
SCANNED = "blob binary, kind string, rule_version int"


def scan_text(text: str, rules) -> list[tuple[Rule, int, int, str]]:
    """(rule, start, stop, value) of every match, offsets in code points."""
    out = []
    for r in rules:
        for m in re.finditer(r.pattern, text):
            if m.end(r.group) - m.start(r.group) >= r.least:
                out.append((r, m.start(), m.end(), m.group(r.group)))
    return out


def _scan(texts: DataFrame, rules) -> DataFrame:
    """``blob, text, kinds`` -> findings of the named kinds."""
    by_kind = {r.kind: r for r in rules}

    def run(batches):
        for whole in batches:
            for b in slices(whole):
                rows = []
                for blob, text, kinds in zip(*(b.column(c).to_pylist()
                                               for c in ("blob", "text", "kinds"))):
                    rows += [(blob, r.kind, r.version, a, z, hashlib.sha256(v.encode()).hexdigest())
                             for r, a, z, v in scan_text(text, [by_kind[k] for k in kinds])]
                cols = list(zip(*rows)) or [[]] * 6
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(cols, (
                        pa.binary(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string()))],
                    names=["blob", "kind", "rule_version", "start", "stop", "value_sha256"])
    return texts.mapInArrow(run, FINDINGS)


def rule_rows(spark: SparkSession, rules) -> DataFrame:
    return F.array(*[F.struct(F.lit(r.kind).alias("kind"),
                              F.lit(r.version).cast("int").alias("rule_version")) for r in rules])


def update(docs: DataFrame, ledger: str, rules=RULES, doc_id: str = "doc_id",
           text: str = "text") -> DataFrame:
    """Enter all rows of ``docs`` as versions and scan what is new; returns their
    ``path, blob`` rows (one per input row).

    Null text is the empty blob. Null ids are a path like any other; repeated rows give repeated
    version rows in the result and one in the ledger; an empty table changes nothing.
    """
    spark = docs.sparkSession
    src = subset(docs, path=doc_id, text=text).select(
        "path", F.coalesce("text", F.lit("")).alias("text")).withColumn(
        "blob", F.unhex(F.sha2("text", 256)))
    versions = stored(src.select("path", "blob"), "blob-versions")
    kind = versions.schema["path"].dataType.simpleString()
    old = read_or_empty(spark, f"{ledger}/versions", f"path {kind}, blob binary")
    fresh = versions.distinct()
    if not old.isEmpty():
        seen = old.select(F.col("path").alias("p"), F.col("blob").alias("b"))
        fresh = fresh.join(seen, F.col("path").eqNullSafe(F.col("p"))
                           & (F.col("blob") == F.col("b")), "left_anti")
    fresh.write.mode("append").parquet(f"{ledger}/versions")

    # One path stands for each blob; what is missing of it is settled without its text.
    one = versions.groupBy("blob").agg(F.min("path").alias("rep"))
    done = read_or_empty(spark, f"{ledger}/scanned", SCANNED)
    if done.isEmpty():
        todo = one.withColumn("missing", rule_rows(spark, rules))
    else:
        todo = (one.select("blob", "rep", F.explode(rule_rows(spark, rules)).alias("r"))
                .select("blob", "rep", "r.kind", "r.rule_version")
                .join(done, ["blob", "kind", "rule_version"], "left_anti")
                .groupBy("blob", "rep")
                .agg(F.collect_set(F.struct("kind", "rule_version")).alias("missing")))
    todo = stored(todo, "blob-todo")
    want = todo.select(F.col("blob").alias("b"), "rep", F.col("missing.kind").alias("kinds"))
    texts = src.join(want, (F.col("blob") == F.col("b")) & F.col("path").eqNullSafe(F.col("rep")))
    found = _scan(texts.select("blob", "text", "kinds"), rules).distinct()
    found.write.mode("append").option("compression", "zstd").parquet(f"{ledger}/findings")
    (todo.select("blob", F.explode("missing").alias("r")).select("blob", "r.kind", "r.rule_version")
     .write.mode("append").option("compression", "zstd").parquet(f"{ledger}/scanned"))
    return versions


def findings_by_path(versions: DataFrame, ledger: str, rules=RULES) -> DataFrame:
    """``path, found``: for every row of ``versions`` the findings of its blob under the current
    rules as an array of (start, stop, order, kind), sorted; null where there are none."""
    spark = versions.sparkSession
    order = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i))])
    now = F.create_map(*[x for r in rules for x in (F.lit(r.kind), F.lit(r.version).cast("int"))])
    hits = (read_or_empty(spark, f"{ledger}/findings", FINDINGS)
            .where(now[F.col("kind")] == F.col("rule_version"))
            .select("blob", "start", "stop", "kind").distinct())
    per = hits.groupBy("blob").agg(F.array_sort(F.collect_list(F.struct(
        "start", order[F.col("kind")].alias("order"), "stop", "kind"))).alias("found"))
    return versions.join(per, "blob", "left").select("path", "blob", "found")


def redact(docs: DataFrame, ledger: str, mark: str = "[secret]", rules=RULES,
           doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with every found span of ``text`` replaced by ``mark``; other columns as they
    are. Overlapping spans are replaced as one."""
    update(docs, ledger, rules, doc_id, text)
    spark = docs.sparkSession
    blob, spans = free_name(docs, "blob"), free_name(docs, "spans")
    hits = (read_or_empty(spark, f"{ledger}/findings", FINDINGS)
            .groupBy("blob").agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias(spans))
            .withColumnRenamed("blob", blob))
    keyed = docs.withColumn(blob, F.unhex(F.sha2(F.coalesce(F.col(f"`{text}`"), F.lit("")), 256)))
    at = F.aggregate(
        F.col(spans),
        F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("pos")),
        lambda a, s: F.struct(
            F.when(s["start"] >= a["pos"], F.concat(
                a["out"], F.col(f"`{text}`").substr(a["pos"].cast("int") + 1,
                                                   (s["start"] - a["pos"]).cast("int")),
                F.lit(mark))).otherwise(a["out"]).alias("out"),
            F.greatest(a["pos"], s["stop"]).alias("pos")))
    made = F.concat(at["out"], F.col(f"`{text}`").substr(at["pos"].cast("int") + 1,
                                                       F.length(F.col(f"`{text}`"))))
    got = keyed.join(hits, blob, "left")
    return got.withColumn(text, F.when(F.col(spans).isNull(), F.col(f"`{text}`"))
                          .otherwise(made)).select(*[F.col(f"`{c}`") for c in docs.columns])


def op2_secret_ledger(spark, sf_dir):
    ledger = shared_dir(spark, "secret-ledger")
    versions = update(read(spark, sf_dir, "documents"), ledger)
    got = findings_by_path(versions, ledger)

    def text(kinds):
        mine = F.filter("found", lambda x: x["kind"].isin(*kinds))
        return F.coalesce(F.array_join(F.transform(mine, lambda x: F.concat_ws(
            ":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ","), F.lit(""))

    def count(kind):
        return F.coalesce(F.size(F.filter("found", lambda x: x["kind"] == kind)),
                          F.lit(0)).cast("long")
    return got.select(F.col("path").alias("doc_id"),
                      *[F.greatest(count(k), F.lit(0)).alias(f"n_{k}") for k in BASE],
                      F.sha2(text(BASE), 256).alias("base_sha256"),
                      text([r.kind for r in RULES]).alias("spans"))
