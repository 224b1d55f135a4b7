"""Attribution of deposits to people by keyword (theta join on ILIKE).

The join condition is ``description ILIKE '%' || keyword || '%'``. Two exact
physical strategies produce the same (row, mapping) pairs:

* ``inline``: the mappings become expressions of the ledger row itself, one
  test per mapping, so there is no join and no shuffle of the ledger. Chosen
  only after measuring the mapping table (row count and bytes) against fixed
  bounds, because the cost is rows x keywords; a larger table takes the other
  strategy even where ``inline`` is asked for.
* ``ngram``: for large mapping tables. Each pattern's longest literal segment
  must occur in any matching description, so one of its n-grams is an equi-join
  key against the n-grams of the distinct lower-cased descriptions. n is the
  largest of ``GRAM_LENGTHS`` that fits the segment, and of a segment's n-grams
  the one shared by the fewest mappings is taken: a description has at most as
  many candidates as it has n-grams, times the mappings that share one.
  Candidates are verified with the full ILIKE, so the result is exact. Patterns
  with no literal character (only ``%``/``_``) reduce to a length test and join
  on length. Only a mapping table measured as small is broadcast (then no n-gram
  is shuffled); the n-grams of descriptions never are, as their size estimate
  does not count the explode. Matches are found and summed per distinct
  description, mapping copies as a count, and equi-joined back to the ledger
  rows (AQE splits a skewed description on that join).

Aggregations follow the reference's fan-out semantics: ``SUM(amount)`` over
join pairs (a row hit by two keywords of one person counts twice) and
``COUNT(DISTINCT id)``. Both come from one row per (ledger row, person) with its
number of hits: inline, the row itself yields them; else a pre-aggregate whose
map-side combine collapses all pairs of a row inside its task.
"""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import months_since
from ..functions.text import contains_pattern
from .query import date_range, ledger_month

# Size bounds of the inline strategy (checked on the mapping table).
INLINE_MAX_KEYWORDS = 256
INLINE_MAX_BYTES = 4 << 20
# Size bounds of a mapping table that the n-gram plan broadcasts.
BROADCAST_MAX_KEYWORDS = 10_000
BROADCAST_MAX_BYTES = 4 << 20
# Lengths of the n-grams: few, so that a description has few, and a literal's length is at most
# doubled from one to the next.
GRAM_LENGTHS = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32)

_ROW_COLS = ["id", "transaction_date", "description", "amount", "balance"]


@dataclass(frozen=True)
class MappingProfile:
    rows: int
    bytes: int
    ngram_lengths: tuple[int, ...]   # n-gram lengths needed (of GRAM_LENGTHS)
    wildcard_only: int               # patterns with no literal character
    max_underscores: int


def gram_length(length: Column) -> Column:
    """The largest of ``GRAM_LENGTHS`` up to ``length`` (0 for none, null for null)."""
    fitting = [F.when(length >= n, F.lit(n)) for n in reversed(GRAM_LENGTHS)]
    return F.coalesce(*fitting, F.when(length.isNotNull(), F.lit(0)))


def _patterns(m: DataFrame) -> DataFrame:
    """person_name, keyword, lower-case safe pattern, its longest literal
    segment and the number of ``_`` wildcards."""
    pattern = F.lower(contains_pattern(F.col("keyword")))
    # Escape pairs -> private-use placeholders (pairs consumed left to right,
    # ``\\`` first), then split on the remaining (unescaped) wildcards.
    ph = F.regexp_replace(pattern, r"\\\\", "\ue002")
    ph = F.regexp_replace(ph, r"\\%", "\ue000")
    ph = F.regexp_replace(ph, r"\\_", "\ue001")
    segs = F.split(ph, "[%_]")
    longest = F.aggregate(segs, F.lit(""),
                          lambda acc, x: F.when(F.length(x) > F.length(acc), x).otherwise(acc))
    literal = F.translate(longest, "\ue000\ue001\ue002", "%_\\")
    underscores = F.length(ph) - F.length(F.regexp_replace(ph, "_", ""))
    return m.select(
        "person_name", "keyword", pattern.alias("pattern"), literal.alias("literal"),
        gram_length(F.length(literal)).alias("n"), underscores.alias("underscores"),
        _plain(F.col("keyword")).alias("plain"))


def profile(m: DataFrame) -> MappingProfile:
    """One small aggregate over the mapping table (a single row comes back)."""
    p = _patterns(m)
    r = p.agg(
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.sum(F.length("person_name") + F.length("keyword") * 3 + 32), F.lit(0))
        .alias("bytes"),
        F.collect_set(F.when(F.col("n") > 0, F.col("n"))).alias("ns"),
        F.count(F.when(F.col("n") == 0, F.lit(1))).alias("wild"),
        F.coalesce(F.max(F.when(F.col("n") == 0, F.col("underscores"))), F.lit(0)).alias("mx"),
    ).first()
    return MappingProfile(int(r["rows"]), int(r["bytes"]), tuple(sorted(r["ns"])),
                          int(r["wild"]), int(r["mx"]))


def _local_size(m: DataFrame) -> tuple[int, int] | None:
    """Exact (rows, bytes) when the optimized plan is an in-memory local
    relation (literal rows); None otherwise."""
    try:
        plan = m._jdf.queryExecution().optimizedPlan()
        if plan.getClass().getSimpleName() != "LocalRelation":
            return None
        return int(plan.data().size()), int(plan.stats().sizeInBytes())
    except Exception:  # Spark Connect or an unexpected plan: measure instead
        return None


def size_bound(m: DataFrame) -> tuple[int, int]:
    """(rows, bytes) of the mapping table: read from a local relation, else
    measured with one aggregate."""
    local = _local_size(m)
    if local is not None:
        return local
    prof = profile(m)
    return prof.rows, prof.bytes


def choose_strategy(prof) -> str:
    rows, nbytes = (prof.rows, prof.bytes) if isinstance(prof, MappingProfile) else prof
    if rows <= INLINE_MAX_KEYWORDS and nbytes <= INLINE_MAX_BYTES:
        return "inline"
    return "ngram"


def _grams(text: Column, n) -> Column:
    """Hashes of the n-grams of ``text`` (empty when shorter than n)."""
    idx = F.sequence(F.lit(1), F.length(text) - n + 1)
    return F.when(F.length(text) >= n,
                  F.transform(idx, lambda i: F.xxhash64(F.substring(text, i, n)))
                  ).otherwise(F.array().cast("array<bigint>"))


def _description_matches(rows: DataFrame, m: DataFrame, prof: MappingProfile) -> DataFrame:
    """Large-dimension plan (see module docstring): ``ld`` (a distinct lower-cased description of
    ``rows``), ``person_name``, ``keyword`` and ``copies``, the mappings that are alike."""
    pats = _patterns(m)
    small = prof.rows <= BROADCAST_MAX_KEYWORDS and prof.bytes <= BROADCAST_MAX_BYTES
    side = "broadcast" if small else "merge"
    descs = rows.select(F.lower(F.col("description")).alias("ld")).distinct()
    one = ["person_name", "keyword", "pattern", "literal", "plain", "n"]

    found = []
    if prof.ngram_lengths:
        kp = pats.filter(F.col("n") > 0).groupBy(*one).agg(F.count(F.lit(1)).alias("copies"))
        kg = kp.select(*one, "copies", F.explode(F.array_distinct(
            _grams(F.col("literal"), F.col("n")))).alias("gram"))
        shared = kg.groupBy("gram").agg(F.count(F.lit(1)).alias("mappings"))
        best = (kg.join(shared.hint("merge"), "gram").groupBy(*one, "copies")
                .agg(F.min_by("gram", F.struct("mappings", "gram")).alias("gram")))
        dg = descs.select("ld", F.explode(F.array_distinct(F.concat(
            *[_grams(F.col("ld"), n) for n in prof.ngram_lengths]))).alias("gram"))
        verified = F.when(F.col("plain"), F.col("ld").contains(F.col("literal"))).otherwise(
            F.like(F.col("ld"), F.col("pattern")))
        found.append(dg.join(best.hint(side), "gram").filter(verified)
                     .select("ld", "person_name", "keyword", "copies"))
    if prof.wildcard_only:
        # '%' + only wildcards + '%': matches iff length >= number of '_'.
        wp = (pats.filter(F.col("n") == 0).groupBy("person_name", "keyword", "underscores")
              .agg(F.count(F.lit(1)).alias("copies")).withColumnRenamed("underscores", "len_min"))
        dl = descs.select("ld", F.explode(F.sequence(
            F.lit(0), F.least(F.length("ld"), F.lit(prof.max_underscores)))).alias("len_min"))
        found.append(dl.join(wp.hint(side), "len_min").select("ld", "person_name", "keyword", "copies"))
    if not found:
        return descs.limit(0).select("ld", F.lit(None).cast("string").alias("person_name"),
                                     F.lit(None).cast("string").alias("keyword"),
                                     F.lit(0).cast("bigint").alias("copies"))
    return reduce(DataFrame.unionByName, found)


def _with_matches(rows: DataFrame, matched: DataFrame) -> DataFrame:
    """``rows`` joined with the columns that ``matched`` has for their description."""
    ld = F.lower(F.col("description"))
    return rows.withColumn("ld", ld).join(matched.hint("merge"), "ld").drop("ld")


def _plain(keyword: Column) -> Column:
    """True when the keyword has no LIKE metacharacter (``%``, ``_``, ``\\``)."""
    return ~keyword.rlike(r"[%_\\]")


@dataclass(frozen=True)
class Test:
    """One mapping as a test on a ledger row."""
    person: str | None
    keyword: str
    holds: Column


def tests(m: DataFrame, strategy: str = "auto") -> list[Test] | None:
    """The mappings as tests, by person (null last); None where the n-gram plan is to be used. Only a
    table within the bounds is brought to the driver. A keyword without wildcards is a substring
    search on the lower-cased description; only ``%``/``_``/``\\`` need a LIKE pattern."""
    if strategy == "ngram" or choose_strategy(size_bound(m)) == "ngram":
        return None
    kw = F.col("keyword")
    rows = m.select("person_name", "keyword", _plain(kw).alias("plain"), F.lower(kw).alias("low"),
                    contains_pattern(kw).alias("pattern")).where(kw.isNotNull()).collect()
    rows.sort(key=lambda r: (r.person_name is None, (r.person_name or "").encode()))
    low = F.lower(F.col("description"))
    return [Test(r.person_name, r.keyword, low.contains(r.low) if r.plain else
                 F.ilike(F.col("description"), F.lit(r.pattern))) for r in rows]


def _any(found: list[Test]) -> Column:
    return reduce(lambda a, b: a | b, [x.holds for x in found], F.lit(False))


def _people(found: list[Test]) -> list[tuple[str | None, list[Test]]]:
    """The tests of each person, in order of the names."""
    out: dict = {}
    for x in found:
        out.setdefault(x.person, []).append(x)
    return list(out.items())


def keyword_matches(rows: DataFrame, m: DataFrame, strategy: str = "auto") -> DataFrame:
    """Every (ledger row, mapping) pair with ``description ILIKE %keyword%``.

    Output: the columns of ``rows`` plus ``person_name`` and ``keyword``.
    """
    found = tests(m, strategy)
    if found is None:
        # a mapping repeated in ``m`` matches once per copy, as in the inline plan
        copy = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("_copy")
        matched = _description_matches(rows, m, profile(m)).select("ld", "person_name", "keyword", copy)
        return _with_matches(rows, matched).drop("_copy")
    pairs = [F.when(x.holds, F.struct(F.lit(x.person).cast("string").alias("person_name"),
                                      F.lit(x.keyword).alias("keyword"))) for x in found]
    pair = F.explode(F.array_compact(F.array(*pairs)) if pairs else
                     F.array().cast("array<struct<person_name:string,keyword:string>>"))
    return rows.where(_any(found)).select("*", pair.alias("_pair")).select(
        *rows.columns, "_pair.person_name", "_pair.keyword")


def _deposits(t: DataFrame, start, end) -> DataFrame:
    return date_range(t, start, end).filter(F.col("amount") > 0)


def contributions(t: DataFrame, m: DataFrame, start=None, end=None, person: str | None = None,
                  strategy: str = "auto", ordered: bool = False) -> DataFrame:
    """Deposits matched to people; one row per transaction with the
    alphabetically first matching person. ``person`` filters the mappings
    before the pick."""
    if person:
        m = m.filter(F.col("person_name") == F.lit(person))
    rows = _deposits(t, start, end).select(*_ROW_COLS)
    found = tests(m, strategy)
    if found is None:
        first = F.min("person_name").alias("person_name")
        matched = _description_matches(rows, m, profile(m)).groupBy("ld").agg(first)
        out = _with_matches(rows, matched).groupBy(*_ROW_COLS).agg(first)
    else:
        # people in order of their names: the first that holds is the least
        first = reduce(lambda rest, p: F.when(_any(p[1]), F.lit(p[0]).cast("string")).otherwise(rest),
                       reversed(_people(found)), F.lit(None).cast("string"))
        out = rows.where(_any(found)).withColumn("person_name", first)
    out = out.select(F.col("id"), F.col("transaction_date"), F.col("description"),
                     F.col("amount").cast("double").alias("amount"),
                     F.col("balance").cast("double").alias("balance"), F.col("person_name"))
    return out.orderBy(F.desc("transaction_date"), "id") if ordered else out


def per_row_person(t: DataFrame, m: DataFrame, start=None, end=None,
                   strategy: str = "auto") -> DataFrame:
    """One row per (transaction, person) with ``hits`` = matching keywords: ``id, month, amount,
    person_name, hits``."""
    rows = _deposits(t, start, end).select(
        "id", "amount", ledger_month(t).alias("month"), "description")
    found = tests(m, strategy)
    if found is None:
        # summed per description first: a ledger row meets a person once, however many mappings hit
        matched = _description_matches(rows, m, profile(m)).groupBy("ld", "person_name").agg(
            F.sum("copies").alias("hits"))
        return _with_matches(rows, matched).groupBy("id", "month", "amount", "person_name").agg(
            F.sum("hits").alias("hits"))
    people = [F.when(_any(own), F.struct(
        F.lit(name).cast("string").alias("person_name"),
        reduce(lambda a, b: a + b, [x.holds.cast("bigint") for x in own]).alias("hits")))
        for name, own in _people(found)]
    hit = F.explode(F.array_compact(F.array(*people)) if people else
                    F.array().cast("array<struct<person_name:string,hits:bigint>>"))
    return rows.where(_any(found)).select("id", "month", "amount", hit.alias("_hit")).select(
        "id", "month", "amount", "_hit.person_name", "_hit.hits")


def month_person(t: DataFrame, m: DataFrame, start=None, end=None,
                 strategy: str = "auto") -> DataFrame:
    """The (month, person) base table the monthly statistics roll up from.

    ``total`` = fan-out SUM over join pairs, ``ids`` = distinct transactions,
    ``pairs`` = join pairs, ``total_distinct`` = SUM over distinct (id, person).
    """
    per_id = per_row_person(t, m, start, end, strategy)
    return per_id.groupBy("month", "person_name").agg(
        F.sum(F.col("amount") * F.col("hits")).alias("total"),
        F.count(F.lit(1)).alias("ids"),
        F.sum("hits").alias("pairs"),
        F.sum("amount").alias("total_distinct"),
    )


def totals(t: DataFrame, m: DataFrame, start=None, end=None, distinct_pairs: bool = False,
           strategy: str = "auto", ordered: bool = False) -> DataFrame:
    """Per person: total (fan-out, or per distinct row with ``distinct_pairs``)
    and the number of distinct transactions."""
    per_id = per_row_person(t, m, start, end, strategy)
    value = F.col("amount") if distinct_pairs else F.col("amount") * F.col("hits")
    out = per_id.groupBy("person_name").agg(F.sum(value).cast("double").alias("total"),
                                            F.count(F.lit(1)).alias("count"))
    return out.orderBy(F.desc("total"), "person_name") if ordered else out


def monthly_totals(t: DataFrame, m: DataFrame, start=None, end=None, strategy: str = "auto",
                   ordered: bool = False) -> DataFrame:
    out = month_person(t, m, start, end, strategy).select(
        "month", "person_name", F.col("total").cast("double").alias("total"))
    return out.orderBy(F.desc("month"), "person_name") if ordered else out


def summary(t: DataFrame, m: DataFrame, start=None, end=None,
            strategy: str = "auto") -> DataFrame:
    """Number of people, sum of their totals, sum of their distinct counts."""
    mp = month_person(t, m, start, end, strategy)
    return mp.agg(
        F.count_distinct("person_name").alias("people"),
        F.coalesce(F.sum("total"), F.lit(0)).cast("double").alias("total_amount"),
        F.coalesce(F.sum("ids"), F.lit(0)).cast("bigint").alias("total_count"),
    )


def monthly_average(t: DataFrame, m: DataFrame, as_of: _dt.date, start=None, end=None,
                    strategy: str = "auto") -> DataFrame:
    """Per person: total / calendar months from the first contribution month
    to ``as_of`` (inclusive, at least 1)."""
    mp = month_person(t, m, start, end, strategy)
    per = mp.groupBy("person_name").agg(F.sum("total").alias("total"),
                                        F.min("month").alias("first_month"))
    months = months_since(F.col("first_month"), as_of)
    return per.select("person_name", F.col("total").cast("double").alias("total"),
                      "first_month", months.cast("bigint").alias("months"),
                      (F.col("total").cast("double") / months).alias("monthly_average"))


def avg_monthly(t: DataFrame, m: DataFrame, start=None, end=None,
                strategy: str = "auto") -> DataFrame:
    """Sum of totals / number of distinct months with any contribution (0 if none)."""
    mp = month_person(t, m, start, end, strategy)
    return mp.agg(
        F.coalesce(F.sum("total").cast("double") / F.count_distinct("month"), F.lit(0.0))
        .alias("avg_monthly_contributions"))


def distinct_people(t: DataFrame, m: DataFrame, start=None, end=None, strategy: str = "auto",
                    ordered: bool = True) -> DataFrame:
    """People with at least one contribution (the browser's person list)."""
    out = month_person(t, m, start, end, strategy).select("person_name").distinct()
    return out.orderBy("person_name") if ordered else out
