"""Batch maintenance of mappings and transactions (M1-M3).

The reference edits one row per request; here each operation takes a table
of changes and returns new tables, so a million edits cost one join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip_ws
from ..schema import MAPPINGS, conform
from ..session import stored

EDITABLE = ["category", "source", "notes", "description"]
MAPPING_KEY = ["person_name", "keyword"]


def list_mappings(m: DataFrame) -> DataFrame:
    """All mappings ordered by person, then keyword."""
    return m.select("id", "person_name", "keyword", "created_at").orderBy(*MAPPING_KEY)


def upsert_mappings(m: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Add ``new`` (person_name, keyword) rows: both trimmed; an empty value is
    rejected (``empty_person`` / ``empty_keyword``); a pair already stored, or
    repeated in the batch, is rejected as ``duplicate``. Returns
    ``(mappings_after, rejects)``. Ids of added rows are a 64-bit hash of the key.

    Duplicate rejects are the input rows themselves: each row gets a row id,
    the smallest id per key (a partial aggregate) is the accepted copy, and
    the other rows are found by joining back on the key -- a join AQE splits
    when one key holds many copies, instead of one task generating them.
    """
    has_created = "created_at" in new.columns
    n = new.select(
        strip_ws(F.col("person_name")).alias("person_name"),
        strip_ws(F.col("keyword")).alias("keyword"),
        (F.col("created_at") if has_created else F.lit(None).cast("timestamp"))
        .alias("created_at"),
        F.monotonically_increasing_id().alias("_rid"))
    empty_p = F.col("person_name").isNull() | (F.col("person_name") == "")
    empty_k = F.col("keyword").isNull() | (F.col("keyword") == "")
    checked = n.withColumn("reason", F.when(empty_p, "empty_person").when(empty_k,
                                                                           "empty_keyword"))
    valid = checked.filter(F.col("reason").isNull())
    per_key = valid.groupBy(*MAPPING_KEY).agg(
        F.min("_rid").alias("_keep"), F.min_by("created_at", "_rid").alias("created_at"))
    stored = m.select(*MAPPING_KEY).distinct().withColumn("_stored", F.lit(True))
    flagged = per_key.join(stored, MAPPING_KEY, "left")
    added = flagged.filter(F.col("_stored").isNull()).select(
        F.xxhash64(*MAPPING_KEY).alias("id"), *MAPPING_KEY,
        F.coalesce(F.col("created_at"), F.current_timestamp()).alias("created_at"))
    dupes = valid.join(flagged.select(*MAPPING_KEY, "_keep", "_stored"), MAPPING_KEY).filter(
        F.col("_stored").isNotNull() | (F.col("_rid") != F.col("_keep"))).select(
        *MAPPING_KEY, F.lit("duplicate").alias("reason"))
    rejects = checked.filter(F.col("reason").isNotNull()).select(
        *MAPPING_KEY, "reason").unionByName(dupes)
    return conform(m, MAPPINGS).unionByName(conform(added, MAPPINGS)), rejects


def delete_mappings(m: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Remove mappings whose id is in ``ids`` (column ``id``). Returns
    ``(mappings_after, not_found_ids)``."""
    ids = ids.select("id").distinct()
    return m.join(ids, "id", "left_anti"), ids.join(m.select("id"), "id", "left_anti")


def apply_corrections(t: DataFrame, corrections: DataFrame, order: str | None = None) -> DataFrame:
    """The ledger after ``corrections``, without those that ``correct`` refuses."""
    return correct(t, corrections, order)[0]


def correct(t: DataFrame, corrections: DataFrame, order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Apply ``corrections(id, changes map<string,string>)`` to the ledger; returns
    ``(ledger_after, refused)``.

    Only category, source, notes and description change; a key present with a
    NULL value sets NULL, an absent key keeps the value; other keys (such as
    amount) are ignored; unknown ids have no effect. ``order`` (a column of
    ``corrections``) tells which edit comes first: later ones win field by field, an
    explicit NULL included. Without it, edits come in the order of their ids, and those of one id
    are one edit, of which conflicting non-NULL values give the largest.

    An edit whose new description would give its row the key (date, description, amount) that
    another row has at that time is refused whole, with reason ``duplicate_key``. Rows with a NULL
    in the key never collide. Each id's merged map holds at most the four editable fields.
    """
    entries = corrections.select("id", F.explode("changes").alias("field", "value"),
                                 *([F.col(order).alias("_order")] if order else [])).filter(
        F.col("field").isin(EDITABLE))
    if order is None:
        merged = entries.groupBy("id", "field").agg(F.max("value").alias("value")).groupBy("id").agg(
            _as_map().alias("changes"))
        edits = merged.select("id", "changes", F.struct("id").alias("seq"))
    else:
        edits = corrections.select("id", "changes", F.struct(
            F.col(order).alias("at"), "id", F.xxhash64(F.to_json("changes")).alias("tie")).alias("seq"))
    refused = _refused(t, edits)
    if refused is not None:
        edits = edits.join(refused.select("id", "seq"), ["id", "seq"], "left_anti")
    last = edits.select("id", "seq", F.explode("changes").alias("field", "value")).filter(
        F.col("field").isin(EDITABLE)).groupBy("id", "field").agg(
        F.max_by(F.struct("value"), "seq")["value"].alias("value"))
    joined = t.join(last.groupBy("id").agg(_as_map().alias("_changes")), "id", "left")
    ch = F.col("_changes")
    cols = [F.when(F.map_contains_key(ch, F.lit(name)), ch.getItem(name)).otherwise(F.col(name)).alias(name)
            if name in EDITABLE else F.col(name) for name in t.columns]
    reason = F.lit("duplicate_key").alias("reason")
    if refused is None:
        refused = edits.limit(0).select("id", F.lit(None).cast("string").alias("description"), reason)
    else:
        refused = refused.select("id", F.col("to").alias("description"), reason)
    return joined.select(*cols), refused


def _as_map():
    return F.map_from_entries(F.collect_list(F.struct("field", "value")))


def _refused(t: DataFrame, edits: DataFrame) -> DataFrame | None:
    """``id, seq, to`` of the edits whose description would collide, None if no edit has one.

    Edits are decided in rounds of equi-joins, not one after another. The first open edit of a row
    can be decided when no earlier open edit concerns its new key (``to``): if a row holds that key
    and has no earlier open edit, the edit is refused; if no row does, the earliest edit to that key
    may take it, once no earlier edit waits for the key its own row leaves. So a round refuses all
    edits to a key that stays taken, however many there are, and the rounds follow the longest
    chain of rows that move after one another. The table of open edits is stored each round."""
    key = ["transaction_date", "amount"]
    wants = edits.where(F.map_contains_key("changes", F.lit("description"))).select(
        "id", "seq", F.col("changes")["description"].alias("to"))
    rows = t.select("id", *key, F.col("description").alias("held"))
    wants = stored(wants.join(rows.drop("held"), "id"), "edits")     # unknown ids have no effect
    if wants.isEmpty():
        return None
    targets = wants.select(*key, F.col("to").alias("held")).distinct()
    movers = wants.select("id").distinct()
    # rows that move, and rows that hold a key some row moves to
    held = stored(rows.join(movers, "id", "left_semi").unionByName(
        rows.join(movers, "id", "left_anti").join(targets, [*key, "held"], "left_semi")), "edited-rows")
    out = None
    while not wants.isEmpty():
        first = wants.groupBy("id").agg(F.min("seq").alias("seq"))
        waiting = wants.groupBy(*key, F.col("to").alias("held")).agg(F.min("seq").alias("wanted"))
        # per key: who holds it and until when at least, and since when it is wanted
        keys = held.join(first.withColumnRenamed("seq", "leaves"), "id", "left").select(
            *key, "held", F.col("id").alias("holder"), "leaves")
        open_ = (wants.join(first, ["id", "seq"], "left_semi")
                 .join(held.select("id", "held"), "id")
                 .withColumnRenamed("held", "own")
                 .join(keys.withColumnRenamed("held", "to"), [*key, "to"], "left")
                 .join(waiting.select(*key, F.col("held").alias("to"), "wanted"), [*key, "to"], "left")
                 .join(waiting.select(*key, F.col("held").alias("own"), F.col("wanted").alias("own_wanted")),
                       [*key, "own"], "left"))
        seq, never = F.col("seq"), F.lit(False)
        stays = F.col("to").eqNullSafe(F.col("own"))
        # a key with a NULL collides with none
        free = F.col("to").isNull() | F.col("transaction_date").isNull() | F.col("amount").isNull()
        taken = F.col("holder").isNotNull() & (F.col("holder") != F.col("id"))
        unclaimed = F.coalesce(F.col("own_wanted") >= seq, F.lit(True))      # none waits for its own key
        verdict = (F.when(stays, F.lit("kept"))
                   .when(~free & taken & F.coalesce(F.col("leaves") > seq, F.lit(True)), F.lit("refused"))
                   .when((free | (~F.coalesce(taken, never) & (F.col("wanted") == seq))) & unclaimed, F.lit("moved")))
        # a key may have several holders if the ledger has repeated keys: one that refuses decides
        decided = stored(open_.withColumn("verdict", verdict).groupBy("id", "seq", "to").agg(
            F.max(F.when(F.col("verdict") == "refused", 2).when(F.col("verdict").isNull(), 1).otherwise(0)).alias("worst"),
            F.max(F.when(F.col("verdict") == "moved", 1).otherwise(0)).alias("moved")).where("worst <> 1"), "decided")
        no = decided.where("worst = 2").select("id", "seq", "to")
        out = no if out is None else out.unionByName(no)
        moved = decided.where("worst = 0 AND moved = 1").select("id", "to", F.lit(True).alias("moved"))
        held = stored(held.join(moved, "id", "left").select(
            "id", *key, F.when(F.col("moved"), F.col("to")).otherwise(F.col("held")).alias("held")), "edited-rows")
        wants = stored(wants.join(decided, ["id", "seq"], "left_anti"), "edits")
    return out
