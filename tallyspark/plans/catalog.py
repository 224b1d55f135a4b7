"""Registry of named queries: a Spark plan and its DuckDB oracle SQL.

Every query reads the driver's tables (through the fixtures) in full, so its
work grows with the scale factor. ``QUERIES[name] = (fn(spark, sf_dir), sql)``;
``sql`` is None for operators that are not SQL-expressible.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import contrib as C
from ..operators import ingest as I
from ..operators import maintain as M
from ..operators import paging as G
from ..operators import partials as A
from ..operators import project as P
from ..operators import recurring as R
from ..operators import query as Q
from ..operators import stats as S
from ..functions import parse as PF
from ..schema import money_out
from ..session import shared_dir, stored
from ..sources import fixtures as FX
from ..sources import snapshot as SN
from ..sources import statements as ST
from ..streaming import statements as SS
from . import oracle as O

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, tuple[QueryFn, str | None]] = {}

# Fixed clock for every "now"-dependent query.
AS_OF = _dt.date(2001, 9, 1)


def register(name: str, sql: str | None):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = (fn, sql)
        return fn
    return deco


def _orders(spark, sf):
    return FX.stored_orders_ledger(spark, sf)


# --- statistics (A1-A5, P5, P7) ------------------------------------------

@register("monthly_breakdown", O.with_orders("""
SELECT strftime(transaction_date, '%Y-%m') AS month,
       CAST(COALESCE(SUM(CASE WHEN amount > 0 THEN amount ELSE 0 END), 0) AS DOUBLE) AS deposits,
       CAST(COALESCE(SUM(CASE WHEN amount < 0 THEN amount ELSE 0 END), 0) AS DOUBLE) AS withdrawals,
       CAST(COALESCE(SUM(amount), 0) AS DOUBLE) AS net
FROM ledger GROUP BY 1"""))
def monthly_breakdown(spark, sf):
    return S.monthly(_orders(spark, sf))


@register("overall_statistics", O.with_orders("""
SELECT COUNT(*) AS total_transactions,
       CAST(COALESCE(SUM(CASE WHEN amount > 0 THEN amount ELSE 0 END), 0) AS DOUBLE) AS total_deposits,
       CAST(COALESCE(SUM(CASE WHEN amount < 0 THEN amount ELSE 0 END), 0) AS DOUBLE) AS total_withdrawals,
       CAST(COALESCE(SUM(amount), 0) AS DOUBLE) AS net_change,
       COALESCE(CAST(SUM(amount) AS DOUBLE) / COUNT(amount), 0) AS avg_transaction,
       MIN(transaction_date) AS earliest_date, MAX(transaction_date) AS latest_date
FROM ledger"""))
def overall_statistics(spark, sf):
    return S.overall(_orders(spark, sf))


@register("overall_statistics_range", O.with_orders("""
SELECT COUNT(*) AS total_transactions,
       CAST(COALESCE(SUM(CASE WHEN amount > 0 THEN amount ELSE 0 END), 0) AS DOUBLE) AS total_deposits,
       CAST(COALESCE(SUM(CASE WHEN amount < 0 THEN amount ELSE 0 END), 0) AS DOUBLE) AS total_withdrawals,
       CAST(COALESCE(SUM(amount), 0) AS DOUBLE) AS net_change,
       COALESCE(CAST(SUM(amount) AS DOUBLE) / COUNT(amount), 0) AS avg_transaction,
       MIN(transaction_date) AS earliest_date, MAX(transaction_date) AS latest_date
FROM ledger WHERE transaction_date >= DATE '1997-01-01' AND transaction_date <= DATE '1998-12-31'"""))
def overall_statistics_range(spark, sf):
    return S.overall(_orders(spark, sf), start="1997-01-01", end="1998-12-31")


@register("overall_by_account", O.with_orders("""
SELECT account_id, COUNT(*) AS total_transactions,
       CAST(COALESCE(SUM(CASE WHEN amount > 0 THEN amount ELSE 0 END), 0) AS DOUBLE) AS total_deposits,
       CAST(COALESCE(SUM(CASE WHEN amount < 0 THEN amount ELSE 0 END), 0) AS DOUBLE) AS total_withdrawals,
       CAST(COALESCE(SUM(amount), 0) AS DOUBLE) AS net_change,
       COALESCE(CAST(SUM(amount) AS DOUBLE) / COUNT(amount), 0) AS avg_transaction,
       MIN(transaction_date) AS earliest_date, MAX(transaction_date) AS latest_date
FROM ledger GROUP BY account_id"""))
def overall_by_account(spark, sf):
    return S.overall(_orders(spark, sf), keys=["account_id"])


@register("statistics_one_pass", O.with_orders("""
SELECT stat_set, group_key, transactions, deposit_count, deposits, withdrawals, net,
       net / transactions AS avg_transaction, earliest_date, latest_date
FROM (
  SELECT CASE GROUPING(source, m, category) WHEN 7 THEN 'overall' WHEN 3 THEN 'source'
              WHEN 5 THEN 'month' ELSE 'category' END AS stat_set,
         CASE GROUPING(source, m, category) WHEN 3 THEN source WHEN 5 THEN m
              WHEN 6 THEN category END AS group_key,
         GROUPING(source, m, category) AS gid,
         COUNT(*) AS transactions,
         COUNT(*) FILTER (WHERE amount > 0) AS deposit_count,
         CAST(COALESCE(SUM(CASE WHEN amount > 0 THEN amount ELSE 0 END), 0) AS DOUBLE) AS deposits,
         CAST(COALESCE(SUM(CASE WHEN amount < 0 THEN amount ELSE 0 END), 0) AS DOUBLE) AS withdrawals,
         CAST(COALESCE(SUM(amount), 0) AS DOUBLE) AS net,
         MIN(transaction_date) AS earliest_date, MAX(transaction_date) AS latest_date,
         category AS cat
  FROM (SELECT *, strftime(transaction_date, '%Y-%m') AS m FROM ledger)
  GROUP BY GROUPING SETS ((), (source), (m), (category))
)
WHERE gid IN (7, 5) OR (gid = 3 AND deposit_count > 0) OR (gid = 6 AND cat IS NOT NULL)"""))
def statistics_one_pass(spark, sf):
    return S.statistics_one_pass(_orders(spark, sf))


@register("deposits_by_source", O.with_orders("""
SELECT source, CAST(SUM(amount) AS DOUBLE) AS total, COUNT(*) AS count
FROM ledger WHERE amount > 0 GROUP BY source"""))
def deposits_by_source(spark, sf):
    return S.deposits_by_source(_orders(spark, sf))


@register("category_breakdown", O.with_orders("""
SELECT category, CAST(SUM(amount) AS DOUBLE) AS total, COUNT(*) AS count
FROM ledger WHERE category IS NOT NULL GROUP BY category"""))
def category_breakdown(spark, sf):
    return S.by_category(_orders(spark, sf))


@register("recurring_descriptions", O.with_orders("""
SELECT description, COUNT(*) AS occurrences,
       CAST(SUM(amount) AS DOUBLE) / COUNT(amount) AS avg_amount,
       CAST(MIN(amount) AS DOUBLE) AS min_amount, CAST(MAX(amount) AS DOUBLE) AS max_amount
FROM ledger GROUP BY description HAVING COUNT(*) >= 3"""))
def recurring_descriptions(spark, sf):
    return S.recurring(_orders(spark, sf), min_occurrences=3)


@register("top_sources", O.with_orders("""
SELECT source, CAST(SUM(amount) AS DOUBLE) AS total, COUNT(*) AS count
FROM ledger WHERE amount > 0 GROUP BY source
ORDER BY total DESC, source NULLS LAST LIMIT 5"""))
def top_sources(spark, sf):
    return S.top_sources(_orders(spark, sf), 5)


@register("recent_months", O.with_orders("""
SELECT strftime(transaction_date, '%Y-%m') AS month,
       CAST(COALESCE(SUM(CASE WHEN amount > 0 THEN amount ELSE 0 END), 0) AS DOUBLE) AS deposits,
       CAST(COALESCE(SUM(CASE WHEN amount < 0 THEN amount ELSE 0 END), 0) AS DOUBLE) AS withdrawals,
       CAST(COALESCE(SUM(amount), 0) AS DOUBLE) AS net
FROM ledger GROUP BY 1 ORDER BY month DESC LIMIT 6"""))
def recent_months(spark, sf):
    return S.recent_months(_orders(spark, sf), 6)


# --- per-row classification (P3, P4) ----------------------------------------

@register("categorize", O.with_orders("""
SELECT id, description, CAST(amount AS DOUBLE) AS amount, category, source FROM ledger"""))
def categorize(spark, sf):
    return money_out(_orders(spark, sf).select("id", "description", "amount", "category",
                                                 "source"))


@register("extract_source", O.with_orders("""
SELECT id, description, CAST(amount AS DOUBLE) AS amount, source FROM ledger"""))
def extract_source(spark, sf):
    return money_out(_orders(spark, sf).select("id", "description", "amount", "source"))


# --- distinct lists and point statistics (A8-A11, A16) ---------------------

@register("distinct_categories", O.with_orders("""
SELECT DISTINCT category FROM ledger WHERE category IS NOT NULL AND category <> ''"""))
def distinct_categories(spark, sf):
    return Q.distinct_values(_orders(spark, sf), "category", ordered=False)


@register("distinct_sources", O.with_orders("""
SELECT DISTINCT source FROM ledger WHERE source IS NOT NULL AND source <> ''"""))
def distinct_sources(spark, sf):
    return Q.distinct_values(_orders(spark, sf), "source", ordered=False)


@register("transaction_count", O.with_orders("""
SELECT COUNT(*) AS transaction_count FROM ledger"""))
def transaction_count(spark, sf):
    return Q.transaction_count(_orders(spark, sf))


@register("latest_date", O.with_orders("""
SELECT MAX(transaction_date) AS latest_date FROM ledger"""))
def latest_date(spark, sf):
    return Q.latest_date(_orders(spark, sf))


# --- search (F1-F9, A15) ----------------------------------------------------

def _search_sql(where: str) -> str:
    return O.with_orders(f"""
SELECT id, account_id, transaction_date, description, CAST(amount AS DOUBLE) AS amount,
       CAST(balance AS DOUBLE) AS balance, category, source, notes
FROM ledger WHERE {where}""")


_SEARCH_COLS = ["id", "account_id", "transaction_date", "description", "amount", "balance",
                "category", "source", "notes"]


def _search(spark, sf, **filters):
    return money_out(Q.search(_orders(spark, sf), **filters).select(*_SEARCH_COLS))


@register("search_text", _search_sql(
    "(description ILIKE '%coffee%' OR notes ILIKE '%coffee%')"))
def search_text(spark, sf):
    return _search(spark, sf, text="coffee")


@register("search_wildcard", _search_sql(
    "(description ILIKE '%e_d%' OR notes ILIKE '%e_d%')"))
def search_wildcard(spark, sf):
    return _search(spark, sf, text="e_d")


@register("search_dates", _search_sql(
    "transaction_date >= DATE '1996-03-01' AND transaction_date <= DATE '1996-05-31'"))
def search_dates(spark, sf):
    return _search(spark, sf, start="1996-03-01", end="1996-05-31")


@register("search_category", _search_sql("category = 'Dining'"))
def search_category(spark, sf):
    return _search(spark, sf, category="Dining")


@register("search_source", _search_sql("source = 'Transfer'"))
def search_source(spark, sf):
    return _search(spark, sf, source="Transfer")


@register("search_amounts", _search_sql("amount >= 0 AND amount <= 50000"))
def search_amounts(spark, sf):
    return _search(spark, sf, min_amount=0, max_amount=50000)


@register("search_amounts_between_cents", _search_sql("amount >= -1234.564 AND amount <= 10000000000.0"))
def search_amounts_between_cents(spark, sf):
    return _search(spark, sf, min_amount=-1234.564, max_amount=1e10)


@register("search_combined", _search_sql(
    "(description ILIKE '%e%' OR notes ILIKE '%e%') "
    "AND transaction_date >= DATE '1995-01-01' AND transaction_date <= DATE '1998-12-31' "
    "AND category = 'Dining' AND source = 'Coffee House' AND amount >= -250000.005 AND amount <= 250000.005"))
def search_combined(spark, sf):
    return _search(spark, sf, text="e", start="1995-01-01", end="1998-12-31", category="Dining",
                   source="Coffee House", min_amount=-250000.005, max_amount=250000.005)


@register("search_empty_filters", _search_sql("TRUE"))
def search_empty_filters(spark, sf):
    return _search(spark, sf, text="", start="", end="", category="", source="")


@register("search_total", O.with_orders("""
SELECT CAST(COALESCE(SUM(amount), 0) AS DOUBLE) AS total, COUNT(*) AS matches
FROM ledger WHERE (description ILIKE '%transfer%' OR notes ILIKE '%transfer%')
  AND transaction_date >= DATE '1996-01-01'"""))
def search_total(spark, sf):
    return Q.search_total(_orders(spark, sf), text="transfer", start="1996-01-01")


# --- listing and paging (O1-O6) --------------------------------------------

_LIST_SQL = """
SELECT id, account_id, transaction_date, description, CAST(amount AS DOUBLE) AS amount,
       CAST(balance AS DOUBLE) AS balance, category, source, notes
FROM ledger ORDER BY transaction_date DESC, id DESC"""


def _listed(df):
    return money_out(df.select(*_SEARCH_COLS))


@register("list_page", O.with_orders(_LIST_SQL + " LIMIT 50 OFFSET 100"))
def list_page(spark, sf):
    return _listed(Q.list_page(_orders(spark, sf), limit=50, offset=100))


@register("list_all_when_limit_zero", O.with_orders(_LIST_SQL))
def list_all_when_limit_zero(spark, sf):
    return _listed(Q.list_page(_orders(spark, sf), limit=0, offset=100))


@register("page_deep", O.with_orders("""
SELECT * EXCLUDE (place) FROM (
  SELECT id, account_id, transaction_date, description, CAST(amount AS DOUBLE) AS amount,
         CAST(balance AS DOUBLE) AS balance, category, source, notes,
         ROW_NUMBER() OVER (ORDER BY transaction_date DESC, id DESC) AS place
  FROM ledger) WHERE place > (SELECT COUNT(*) // 2 FROM ledger)
               AND place <= (SELECT COUNT(*) // 2 FROM ledger) + 50"""))
def page_deep(spark, sf):
    """The fifty rows after half of the ledger, by its stored row-count index."""
    t = _orders(spark, sf)
    index = stored(G.day_counts(t), "day-counts")
    half = index.agg(F.sum("n")).first()[0] // 2
    return _listed(G.page_at(t, 50, half, index, near=0))


@register("page_view", O.with_orders("""
SELECT *, COUNT(*) OVER () = 50 AS has_next FROM (
  SELECT id, account_id, transaction_date, description, CAST(amount AS DOUBLE) AS amount,
         CAST(balance AS DOUBLE) AS balance, category, source, notes
  FROM ledger ORDER BY transaction_date DESC, id DESC LIMIT 50 OFFSET 150)"""))
def page_view(spark, sf):
    return money_out(Q.page(_orders(spark, sf), 4, 50).select(*_SEARCH_COLS, "has_next"))


@register("list_after", O.with_orders("""
SELECT id, account_id, transaction_date, description, CAST(amount AS DOUBLE) AS amount,
       CAST(balance AS DOUBLE) AS balance, category, source, notes
FROM ledger
WHERE transaction_date < DATE '1998-06-15' OR (transaction_date = DATE '1998-06-15' AND id < 5000)
ORDER BY transaction_date DESC, id DESC LIMIT 50"""))
def list_after(spark, sf):
    return _listed(Q.list_after(_orders(spark, sf), "1998-06-15", 5000, 50))


@register("recent", O.with_orders(_LIST_SQL + " LIMIT 20"))
def recent(spark, sf):
    return _listed(Q.recent(_orders(spark, sf), 20))


@register("latest_balance", O.with_orders("""
SELECT CAST(balance AS DOUBLE) AS balance, transaction_date AS as_of_date
FROM ledger ORDER BY transaction_date DESC, id DESC LIMIT 1"""))
def latest_balance(spark, sf):
    return Q.latest_balance(_orders(spark, sf))


@register("latest_balance_by_account", O.with_orders("""
SELECT account_id, CAST(balance AS DOUBLE) AS balance, transaction_date AS as_of_date
FROM ledger
QUALIFY row_number() OVER (PARTITION BY account_id ORDER BY transaction_date DESC, id DESC) = 1"""))
def latest_balance_by_account(spark, sf):
    return Q.latest_balance(_orders(spark, sf), keys=["account_id"])


# --- keyword contributions (J1, J2, A6, A7, A11-A14, F13) ------------------

_PAIRS_SQL = """
pairs AS (
  SELECT t.id, t.transaction_date, t.description, t.amount, t.balance,
         strftime(t.transaction_date, '%Y-%m') AS month, m.person_name, m.keyword
  FROM ledger t JOIN mappings m ON t.description ILIKE '%' || m.keyword || '%'
  WHERE t.amount > 0
)"""


def _with_pairs(body: str, *more: str) -> str:
    return O.with_orders_and_mappings(body, _PAIRS_SQL, *more)


def _mappings(spark):
    return FX.mappings(spark)


@register("contributions", _with_pairs("""
SELECT id, transaction_date, description, CAST(amount AS DOUBLE) AS amount,
       CAST(balance AS DOUBLE) AS balance, MIN(person_name) AS person_name
FROM pairs GROUP BY id, transaction_date, description, amount, balance"""))
def contributions(spark, sf):
    return C.contributions(_orders(spark, sf), _mappings(spark))


@register("contributions_ngram", _with_pairs("""
SELECT id, transaction_date, description, CAST(amount AS DOUBLE) AS amount,
       CAST(balance AS DOUBLE) AS balance, MIN(person_name) AS person_name
FROM pairs GROUP BY id, transaction_date, description, amount, balance"""))
def contributions_ngram(spark, sf):
    return C.contributions(_orders(spark, sf), _mappings(spark), strategy="ngram")


@register("contributions_for_person", _with_pairs("""
SELECT id, transaction_date, description, CAST(amount AS DOUBLE) AS amount,
       CAST(balance AS DOUBLE) AS balance, MIN(person_name) AS person_name
FROM pairs WHERE person_name = 'Blake' AND transaction_date >= DATE '1996-01-01'
GROUP BY id, transaction_date, description, amount, balance"""))
def contributions_for_person(spark, sf):
    return C.contributions(_orders(spark, sf), _mappings(spark), person="Blake",
                           start="1996-01-01")


@register("contribution_totals", _with_pairs("""
SELECT person_name, CAST(SUM(amount) AS DOUBLE) AS total, COUNT(DISTINCT id) AS count
FROM pairs GROUP BY person_name"""))
def contribution_totals(spark, sf):
    return C.totals(_orders(spark, sf), _mappings(spark))


@register("contribution_totals_ngram", _with_pairs("""
SELECT person_name, CAST(SUM(amount) AS DOUBLE) AS total, COUNT(DISTINCT id) AS count
FROM pairs GROUP BY person_name"""))
def contribution_totals_ngram(spark, sf):
    return C.totals(_orders(spark, sf), _mappings(spark), strategy="ngram")


def _customer_keywords(spark, sf):
    """A large mapping dimension: every customer name is a keyword of its
    market segment (grows with the data; above the broadcast bound)."""
    c = FX.table(spark, sf, "customer")
    return c.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("person_name"),
                    F.col("c_name").alias("keyword"))


@register("contribution_totals_large_dimension", """
WITH """ + O.ORDERS_LEDGER_CTE.strip() + """,
kw AS (SELECT c_mktsegment AS person_name, c_name AS keyword FROM customer)
SELECT kw.person_name, CAST(SUM(t.amount) AS DOUBLE) AS total, COUNT(DISTINCT t.id) AS count
FROM ledger t JOIN kw ON t.description ILIKE '%' || kw.keyword || '%'
WHERE t.amount > 0
GROUP BY kw.person_name""")
def contribution_totals_large_dimension(spark, sf):
    # strategy "auto": the size check sees more than 256 keywords -> n-gram plan
    return C.totals(_orders(spark, sf), _customer_keywords(spark, sf))


@register("contribution_totals_distinct", _with_pairs("""
SELECT person_name, CAST(SUM(amount) AS DOUBLE) AS total, COUNT(*) AS count
FROM (SELECT DISTINCT id, person_name, amount FROM pairs) GROUP BY person_name"""))
def contribution_totals_distinct(spark, sf):
    return C.totals(_orders(spark, sf), _mappings(spark), distinct_pairs=True)


@register("contribution_months", _with_pairs("""
SELECT month, person_name, CAST(SUM(amount) AS DOUBLE) AS total
FROM pairs GROUP BY month, person_name"""))
def contribution_months(spark, sf):
    return C.monthly_totals(_orders(spark, sf), _mappings(spark))


@register("contribution_summary", _with_pairs("""
SELECT COUNT(*) AS people, CAST(COALESCE(SUM(total), 0) AS DOUBLE) AS total_amount,
       CAST(COALESCE(SUM(cnt), 0) AS BIGINT) AS total_count
FROM (SELECT person_name, SUM(amount) AS total, COUNT(DISTINCT id) AS cnt
      FROM pairs GROUP BY person_name)"""))
def contribution_summary(spark, sf):
    return C.summary(_orders(spark, sf), _mappings(spark))


@register("contribution_monthly_average", _with_pairs(f"""
SELECT person_name, CAST(total AS DOUBLE) AS total, first_month, months,
       CAST(total AS DOUBLE) / months AS monthly_average
FROM (SELECT person_name, SUM(amount) AS total, MIN(month) AS first_month,
             CAST(greatest(1, {AS_OF.year * 12 + AS_OF.month}
                   - (CAST(substr(MIN(month), 1, 4) AS INTEGER) * 12
                      + CAST(substr(MIN(month), 6, 2) AS INTEGER)) + 1) AS BIGINT) AS months
      FROM pairs GROUP BY person_name)"""))
def contribution_monthly_average(spark, sf):
    return C.monthly_average(_orders(spark, sf), _mappings(spark), AS_OF)


@register("avg_monthly_contributions", _with_pairs("""
SELECT COALESCE(CAST(SUM(amount) AS DOUBLE) / COUNT(DISTINCT month), 0)
         AS avg_monthly_contributions
FROM pairs"""))
def avg_monthly_contributions(spark, sf):
    return C.avg_monthly(_orders(spark, sf), _mappings(spark))


@register("list_mappings", O.with_orders_and_mappings("""
SELECT id, person_name, keyword FROM mappings
UNION ALL
SELECT c_custkey + 1000000000 AS id, c_mktsegment AS person_name, lower(c_name) AS keyword
FROM customer"""))
def list_mappings(spark, sf):
    # S9 over the fixture mappings plus mappings derived from ``customer``
    derived = _id_mappings(spark, sf).withColumn("id", F.col("id") + 1_000_000_000)
    m = _mappings(spark).select("id", "person_name", "keyword").unionByName(derived)
    return M.list_mappings(m.withColumn("created_at", F.lit(None).cast("timestamp"))).select(
        "id", "person_name", "keyword")


@register("distinct_people", _with_pairs("""
SELECT DISTINCT person_name FROM pairs"""))
def distinct_people(spark, sf):
    return C.distinct_people(_orders(spark, sf), _mappings(spark), ordered=False)


# --- recurrence (R1, P12) ---------------------------------------------------

_FREQ_SQL = """CASE WHEN gap IS NULL THEN 'monthly' WHEN gap <= 10 THEN 'weekly'
            WHEN gap <= 17 THEN 'biweekly' WHEN gap <= 35 THEN 'monthly'
            WHEN gap <= 100 THEN 'quarterly' ELSE 'yearly' END"""


def _recurring_sql(n: int) -> str:
    return f"""
SELECT direction, description, CAST(total AS DOUBLE) / occurrences AS amount,
       {_FREQ_SQL} AS frequency, gap AS avg_days_between, occurrences
FROM (
  SELECT direction, description, COUNT(*) AS occurrences, SUM(abs(amount)) AS total,
         CASE WHEN COUNT(*) > 1 THEN date_diff('day', MIN(transaction_date), MAX(transaction_date))
              / (COUNT(*) - 1) END AS gap
  FROM (SELECT *, CASE WHEN amount > 0 THEN 'deposit' ELSE 'withdrawal' END AS direction
        FROM ledger)
  GROUP BY direction, description
  HAVING COUNT(*) >= {n}
)"""


@register("recurring_frequency", O.with_orders(_recurring_sql(3)))
def recurring_frequency(spark, sf):
    return R.analyze_recurring(_orders(spark, sf), min_occurrences=3)


@register("recurring_frequency_ranked", O.with_orders(f"""
SELECT *, ROW_NUMBER() OVER (ORDER BY direction, amount DESC, description) AS place
FROM ({_recurring_sql(3)})"""))
def recurring_frequency_ranked(spark, sf):
    """The places of the rows in the operator's own order (O7)."""
    rows = R.analyze_recurring(_orders(spark, sf), min_occurrences=3, ordered=True)
    return G.numbered(rows)


@register("recurring_frequency_events", f"WITH {O.EVENTS_LEDGER_CTE}" + _recurring_sql(2))
def recurring_frequency_events(spark, sf):
    return R.analyze_recurring(FX.events_ledger(spark, sf), min_occurrences=2)


# --- stored partial aggregates (A1-A5, R1) ------------------------------------

def _partials(spark, sf):
    """Partials of the ledger up to mid-1998, renewed for the months of the rows that came after:
    the folder and the whole ledger."""
    ledger = _orders(spark, sf)
    late = F.col("transaction_date") > F.lit(_dt.date(1998, 6, 16))
    path = shared_dir(spark, "ledger-partials")
    A.write(ledger.filter(~late), path)
    A.refresh(ledger, path, ledger.filter(late))
    return path, ledger


@register("statistics_from_partials", QUERIES["statistics_one_pass"][1])
def statistics_from_partials(spark, sf):
    path, ledger = _partials(spark, sf)
    return S.fold_cells(A.read(spark, path, "cells", ledger))


@register("overall_statistics_from_partials", O.with_orders("""
SELECT COUNT(*) AS total_transactions,
       CAST(COALESCE(SUM(CASE WHEN amount > 0 THEN amount ELSE 0 END), 0) AS DOUBLE) AS total_deposits,
       CAST(COALESCE(SUM(CASE WHEN amount < 0 THEN amount ELSE 0 END), 0) AS DOUBLE) AS total_withdrawals,
       CAST(COALESCE(SUM(amount), 0) AS DOUBLE) AS net_change,
       COALESCE(CAST(SUM(amount) AS DOUBLE) / COUNT(amount), 0) AS avg_transaction,
       MIN(transaction_date) AS earliest_date, MAX(transaction_date) AS latest_date
FROM ledger WHERE transaction_date >= DATE '1996-01-17' AND transaction_date <= DATE '1998-07-04'"""))
def overall_statistics_from_partials(spark, sf):
    """A range that cuts its first and its last month."""
    path, ledger = _partials(spark, sf)
    return A.overall(A.cells_between(A.read(spark, path, "cells", ledger), ledger,
                                     "1996-01-17", "1998-07-04"))


@register("recurring_from_partials", QUERIES["recurring_frequency"][1])
def recurring_from_partials(spark, sf):
    path, ledger = _partials(spark, sf)
    return A.analyze_recurring(A.read(spark, path, "groups", ledger), min_occurrences=3)


# --- projection (R2-R6, P6, P10, P11) ---------------------------------------

PROJECTION_MONTHS = 12

_FACTORS_SQL = [("weekly", "52.0::DOUBLE / 12"), ("biweekly", "26.0::DOUBLE / 12"), ("monthly", "1::DOUBLE"),
                ("quarterly", "1.0::DOUBLE / 3"), ("yearly", "1.0::DOUBLE / 12")]


def _flow_sql(cond: str, value: str) -> str:
    """Amount times occurrences a month, summed."""
    factor = " ".join(f"WHEN '{name}' THEN {k}" for name, k in _FACTORS_SQL)
    return (f"COALESCE(fsum(CASE WHEN {cond} THEN CAST({value} AS DOUBLE) * CASE lower(COALESCE(frequency, 'monthly')) "
            f"{factor} ELSE CAST(1 AS DOUBLE) END END), 0)")


_SCENARIO_CTE = f"""
WITH accounts AS (
  SELECT c_custkey AS account_id, CAST(c_acctbal AS DOUBLE) AS current_balance FROM customer
), items AS (
  SELECT c_custkey AS account_id, 'deposit' AS direction, CAST(100 + c_custkey % 50 AS DOUBLE)
           AS amount,
         ['weekly', 'biweekly', 'monthly', 'quarterly', 'yearly', 'other'][c_custkey % 6 + 1]
           AS frequency
  FROM customer
  UNION ALL
  SELECT c_custkey, 'withdrawal', CAST(-(200 + c_custkey % 30) AS DOUBLE), 'monthly' FROM customer
), flows AS (
  SELECT account_id,
         {_flow_sql("direction = 'deposit'", "COALESCE(amount, 0)")} AS dep,
         {_flow_sql("direction <> 'deposit'", "abs(COALESCE(amount, 0))")} AS wd
  FROM items GROUP BY account_id
), base AS (
  SELECT a.account_id, a.current_balance AS b0, COALESCE(f.dep, 0) AS dep,
         COALESCE(f.wd, 0) AS wd, COALESCE(f.dep, 0) - COALESCE(f.wd, 0) AS net
  FROM accounts a LEFT JOIN flows f USING (account_id)
)"""


def _grid_sql(months: int, as_of: _dt.date) -> str:
    return f"""
SELECT account_id, strftime(DATE '{as_of}' + to_months(i), '%Y-%m') AS month,
       strftime(DATE '{as_of}' + to_months(i), '%B %Y') AS month_name,
       CASE WHEN i > 0 THEN dep ELSE 0.0 END AS deposits,
       CASE WHEN i > 0 THEN wd ELSE 0.0 END AS withdrawals,
       CASE WHEN i > 0 THEN net ELSE 0.0 END AS net_change,
       b0 + CAST(i AS DOUBLE) * net AS projected_balance
FROM base, range(0, {months} + 1) AS r(i)"""


def _summary_sql(months: int) -> str:
    return f"""
SELECT account_id, b0 AS current_balance, b0 + {float(max(months, 0))} * net AS final_balance,
       (b0 + {float(max(months, 0))} * net) - b0 AS total_change,
       dep * {float(months)} AS total_deposits, wd * {float(months)} AS total_withdrawals,
       net AS monthly_net,
       CASE WHEN net > 0 THEN 'positive' WHEN net < 0 THEN 'negative' ELSE 'neutral' END AS trend,
       CASE WHEN net < 0 AND b0 > 0 THEN CAST(floor(b0 / abs(net)) AS BIGINT) END
         AS months_until_zero
FROM base"""


def _scenario(spark, sf):
    return P.project_balances(FX.accounts(spark, sf), FX.recurring_items(spark, sf),
                              PROJECTION_MONTHS, AS_OF)


@register("projection_grid", _SCENARIO_CTE + _grid_sql(PROJECTION_MONTHS, AS_OF))
def projection_grid(spark, sf):
    return _scenario(spark, sf)[0]


@register("projection_summary", _SCENARIO_CTE + _summary_sql(PROJECTION_MONTHS))
def projection_summary(spark, sf):
    return _scenario(spark, sf)[1]


@register("projection_rejects", O.with_orders("""
SELECT account_id, 'missing_balance' AS reason FROM (
  SELECT account_id, balance FROM ledger
  QUALIFY row_number() OVER (PARTITION BY account_id ORDER BY transaction_date DESC, id DESC) = 1
) WHERE balance IS NULL"""))
def projection_rejects(spark, sf):
    # accounts whose newest ledger row carries no balance cannot be projected
    accounts = Q.latest_balance(_orders(spark, sf), keys=["account_id"]).select(
        "account_id", F.col("balance").alias("current_balance"))
    return P.projection_rejects(accounts)


_AUTO_CTES = ["""
withdrawals AS (
  SELECT description, abs(CAST(total AS DOUBLE) / occurrences) AS amount, 'monthly' AS frequency
  FROM (SELECT description, COUNT(*) AS occurrences, SUM(abs(amount)) AS total
        FROM ledger WHERE amount <= 0
        GROUP BY description HAVING COUNT(*) >= 2)
)""", """
latest AS (
  SELECT CAST(balance AS DOUBLE) AS b0 FROM ledger
  ORDER BY transaction_date DESC, id DESC LIMIT 1
)""", """
contrib AS (
  SELECT COALESCE(CAST(SUM(amount) AS DOUBLE) / COUNT(DISTINCT month), 0) AS avg_dep FROM pairs
)""", """
base0 AS (
  SELECT CAST(0 AS BIGINT) AS account_id, (SELECT b0 FROM latest) AS b0,
         (SELECT avg_dep FROM contrib) AS dep,
         COALESCE((SELECT fsum(amount) FROM withdrawals), 0) AS wd
)""", """
base AS (SELECT account_id, b0, dep, wd, dep - wd AS net FROM base0)"""]


def _auto(spark, sf):
    t = _orders(spark, sf)
    wd = R.analyze_recurring(t, min_occurrences=2).filter(F.col("direction") == "withdrawal") \
        .select("description", "amount", F.lit("monthly").alias("frequency"))
    return P.auto_scenario(t, _mappings(spark), wd, AS_OF, PROJECTION_MONTHS)


@register("auto_scenario", _with_pairs(_summary_sql(PROJECTION_MONTHS), *_AUTO_CTES))
def auto_scenario(spark, sf):
    return _auto(spark, sf)[1]


@register("auto_scenario_grid", _with_pairs(_grid_sql(PROJECTION_MONTHS, AS_OF), *_AUTO_CTES))
def auto_scenario_grid(spark, sf):
    return _auto(spark, sf)[0]


# --- import (K1, K2, I1) ----------------------------------------------------

IMPORT_SPLIT = _dt.date(2024, 1, 16)
IMPORT_FROM = _dt.date(2024, 1, 10)
EVENTS_AS_OF = _dt.date(2024, 1, 31)


def _import_inputs(spark, sf):
    coarse = FX.coarse_events(spark, sf)
    existing = I.first_per_key(coarse.filter(F.col("transaction_date") < F.lit(IMPORT_SPLIT)),
                               ["line_no"])
    incoming = coarse.filter(F.col("transaction_date") >= F.lit(IMPORT_FROM))
    return existing, incoming


_IMPORT_CTE = f"""WITH {O.COARSE_EVENTS_CTE},
existing AS (
  SELECT * FROM coarse WHERE transaction_date < DATE '{IMPORT_SPLIT}'
  QUALIFY row_number() OVER (PARTITION BY transaction_date, description, amount
                             ORDER BY line_no) = 1
), incoming AS (
  SELECT * FROM coarse WHERE transaction_date >= DATE '{IMPORT_FROM}'
), firsts AS (
  SELECT * FROM incoming
  QUALIFY row_number() OVER (PARTITION BY transaction_date, description, amount
                             ORDER BY line_no) = 1
), new_rows AS (
  SELECT f.* FROM firsts f ANTI JOIN existing e
    USING (transaction_date, description, amount)
)"""


@register("import_dedupe", _IMPORT_CTE + """
SELECT id, account_id, transaction_date, description, CAST(amount AS DOUBLE) AS amount, line_no
FROM new_rows""")
def import_dedupe(spark, sf):
    existing, incoming = _import_inputs(spark, sf)
    res = I.import_transactions(existing, incoming, ["line_no"])
    return money_out(res.new.select("id", "account_id", "transaction_date", "description",
                                    "amount", "line_no"))


@register("import_counts", _IMPORT_CTE + """
SELECT (SELECT COUNT(*) FROM incoming) AS incoming, (SELECT COUNT(*) FROM new_rows) AS inserted,
       (SELECT COUNT(*) FROM incoming) - (SELECT COUNT(*) FROM new_rows) AS skipped""")
def import_counts(spark, sf):
    existing, incoming = _import_inputs(spark, sf)
    return I.import_transactions(existing, incoming, ["line_no"]).counts


@register("import_idempotent", _IMPORT_CTE + """
SELECT (SELECT COUNT(*) FROM incoming) AS incoming, CAST(0 AS BIGINT) AS inserted,
       (SELECT COUNT(*) FROM incoming) AS skipped""")
def import_idempotent(spark, sf):
    existing, incoming = _import_inputs(spark, sf)
    first = I.import_transactions(existing, incoming, ["line_no"])
    stored = existing.unionByName(first.new)
    return I.import_transactions(stored, incoming, ["line_no"]).counts


@register("watermark_load", f"""WITH {O.COARSE_EVENTS_CTE},
existing AS (
  SELECT * FROM coarse WHERE transaction_date < DATE '{IMPORT_SPLIT}'
  QUALIFY row_number() OVER (PARTITION BY transaction_date, description, amount
                             ORDER BY line_no) = 1
), incoming AS (
  SELECT * FROM coarse
  WHERE transaction_date >= (SELECT MAX(transaction_date) FROM existing)
    AND transaction_date <= DATE '{EVENTS_AS_OF}'
), firsts AS (
  SELECT * FROM incoming
  QUALIFY row_number() OVER (PARTITION BY transaction_date, description, amount
                             ORDER BY line_no) = 1
), new_rows AS (
  SELECT f.* FROM firsts f ANTI JOIN existing e USING (transaction_date, description, amount)
)
SELECT (SELECT COUNT(*) FROM incoming) AS incoming, (SELECT COUNT(*) FROM new_rows) AS inserted,
       (SELECT COUNT(*) FROM incoming) - (SELECT COUNT(*) FROM new_rows) AS skipped""")
def watermark_load(spark, sf):
    coarse = FX.coarse_events(spark, sf)
    existing = I.first_per_key(coarse.filter(F.col("transaction_date") < F.lit(IMPORT_SPLIT)),
                               ["line_no"])
    window = I.since_watermark(existing, coarse, EVENTS_AS_OF)
    return I.import_transactions(existing, window, ["line_no"]).counts


# --- maintenance (M1-M3) ----------------------------------------------------

def _new_mappings(spark, sf):
    """Mapping requests derived from ``customer``: padded names, empty
    keywords, repeats of stored pairs and repeats inside the batch."""
    c = FX.table(spark, sf, "customer")
    k = F.col("c_custkey")
    person = F.when(k % 4 == 0, F.concat(F.lit("  "), F.col("c_mktsegment"), F.lit(" "))) \
        .otherwise(F.col("c_mktsegment"))
    keyword = F.when(k % 9 == 0, F.lit("   ")).otherwise(F.lower(F.col("c_name")))
    base = c.select(person.alias("person_name"), keyword.alias("keyword"))
    repeats = c.select(F.col("c_mktsegment").alias("person_name"),
                       F.lower(F.col("c_name")).alias("keyword"))
    stored = FX.mappings(spark).select(
        F.concat(F.lit(" "), F.col("person_name")).alias("person_name"), "keyword")
    return base.unionByName(repeats).unionByName(stored)


_NEW_MAPPINGS_CTES = ["""
requests AS (
  SELECT CASE WHEN c_custkey % 4 = 0 THEN '  ' || c_mktsegment || ' ' ELSE c_mktsegment END
           AS person_name,
         CASE WHEN c_custkey % 9 = 0 THEN '   ' ELSE lower(c_name) END AS keyword
  FROM customer
  UNION ALL SELECT c_mktsegment, lower(c_name) FROM customer
  UNION ALL SELECT ' ' || person_name, keyword FROM mappings
)""", """
cleaned AS (
  SELECT trim(person_name) AS person_name, trim(keyword) AS keyword FROM requests
)"""]


def _new_mappings_sql(body: str) -> str:
    return O.with_orders_and_mappings(body, *_NEW_MAPPINGS_CTES)


@register("upsert_mappings", _new_mappings_sql("""
SELECT person_name, keyword FROM mappings
UNION ALL
SELECT DISTINCT c.person_name, c.keyword FROM cleaned c
WHERE c.person_name <> '' AND c.keyword <> ''
  AND NOT EXISTS (SELECT 1 FROM mappings m
                  WHERE m.person_name = c.person_name AND m.keyword = c.keyword)"""))
def upsert_mappings(spark, sf):
    after, _ = M.upsert_mappings(FX.mappings(spark), _new_mappings(spark, sf))
    return after.select("person_name", "keyword")


@register("upsert_mapping_rejects", _new_mappings_sql("""
SELECT person_name, keyword, reason FROM (
  SELECT person_name, keyword,
         CASE WHEN person_name = '' THEN 'empty_person' WHEN keyword = '' THEN 'empty_keyword'
              END AS reason
  FROM cleaned
) WHERE reason IS NOT NULL
UNION ALL
SELECT person_name, keyword, 'duplicate' AS reason FROM (
  SELECT c.person_name, c.keyword,
         row_number() OVER (PARTITION BY c.person_name, c.keyword) AS rn,
         EXISTS (SELECT 1 FROM mappings m
                 WHERE m.person_name = c.person_name AND m.keyword = c.keyword) AS stored
  FROM cleaned c WHERE c.person_name <> '' AND c.keyword <> ''
) WHERE stored OR rn > 1"""))
def upsert_mapping_rejects(spark, sf):
    _, rejects = M.upsert_mappings(FX.mappings(spark), _new_mappings(spark, sf))
    return rejects


def _id_mappings(spark, sf):
    """Every customer name as a keyword of its market segment, id = customer key."""
    c = FX.table(spark, sf, "customer")
    return c.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("person_name"),
                    F.lower(F.col("c_name")).alias("keyword"))


def _delete_ids(spark, sf):
    """One delete request per order: every third names its customer's mapping,
    the others an id no mapping has."""
    o = FX.table(spark, sf, "orders")
    k = F.col("o_orderkey")
    return o.select(F.when(k % 3 == 0, F.col("o_custkey")).otherwise(k + 1_000_000_000)
                    .alias("id"))


_DELETE_IDS_SQL = """
SELECT CASE WHEN o_orderkey % 3 = 0 THEN o_custkey ELSE o_orderkey + 1000000000 END AS id
FROM orders"""


@register("delete_mappings", f"""
SELECT c_custkey AS id, c_mktsegment AS person_name, lower(c_name) AS keyword FROM customer
WHERE c_custkey NOT IN ({_DELETE_IDS_SQL})""")
def delete_mappings(spark, sf):
    after, _ = M.delete_mappings(_id_mappings(spark, sf), _delete_ids(spark, sf))
    return after


@register("delete_mappings_not_found", f"""
SELECT DISTINCT id FROM ({_DELETE_IDS_SQL})
WHERE id NOT IN (SELECT c_custkey FROM customer)""")
def delete_mappings_not_found(spark, sf):
    _, missing = M.delete_mappings(_id_mappings(spark, sf), _delete_ids(spark, sf))
    return missing


def _corrections(spark, sf):
    """One correction per order, by order key: set the category; clear notes
    and try to change the amount (ignored); target an id that does not exist;
    rewrite description and source."""
    o = FX.table(spark, sf, "orders")
    k = F.col("o_orderkey")
    r = k % 4
    changes = (
        F.when(r == 0, F.create_map(F.lit("category"), F.col("o_orderpriority")))
        .when(r == 1, F.create_map(F.lit("notes"), F.lit(None).cast("string"),
                                   F.lit("amount"), F.lit("1")))
        .when(r == 2, F.create_map(F.lit("source"), F.lit("nowhere")))
        .otherwise(F.create_map(F.lit("description"), F.upper(F.col("o_orderstatus")),
                                F.lit("source"), F.col("o_orderpriority"))))
    target = F.when(r == 2, k + 10_000_000_000).otherwise(k)
    return o.select(target.alias("id"), changes.alias("changes"))


@register("apply_corrections", O.with_orders("""
SELECT id,
       CASE WHEN id % 4 = 0 THEN o_orderpriority ELSE category END AS category,
       CASE WHEN id % 4 = 3 THEN o_orderpriority ELSE source END AS source,
       CASE WHEN id % 4 = 1 THEN NULL ELSE notes END AS notes,
       CASE WHEN id % 4 = 3 THEN upper(o_orderstatus) ELSE description END AS description,
       CAST(amount AS DOUBLE) AS amount
FROM ledger JOIN orders ON ledger.id = orders.o_orderkey"""))
def apply_corrections(spark, sf):
    t = M.apply_corrections(_orders(spark, sf), _corrections(spark, sf))
    return money_out(t.select("id", "category", "source", "notes", "description", "amount"))


def _renamed(spark, sf):
    """Orders with unique descriptions and one amount; every order of status F is renamed to SAME, in
    the order of the order keys: on each date the first takes the name."""
    o = FX.table(spark, sf, "orders")
    t = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("date").alias("transaction_date"),
                 F.concat(F.lit("ORDER "), F.col("o_orderkey")).alias("description"),
                 F.lit(1).cast("decimal(12,2)").alias("amount"), F.lit("").alias("category"),
                 F.lit("").alias("source"), F.lit("").alias("notes"))
    c = o.where(F.col("o_orderstatus") == "F").select(
        F.col("o_orderkey").alias("id"), F.create_map(F.lit("description"), F.lit("SAME"),
                                                      F.lit("notes"), F.lit("renamed")).alias("changes"))
    return M.correct(t, c)


_RENAMED_SQL = """
SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS day, o_orderstatus = 'F' AS asked,
       row_number() OVER (PARTITION BY CAST(o_orderdate AS DATE), o_orderstatus = 'F' ORDER BY o_orderkey) AS place
FROM orders"""


@register("correction_conflicts", f"""
SELECT id, 'SAME' AS description, 'duplicate_key' AS reason FROM ({_RENAMED_SQL}) WHERE asked AND place > 1""")
def correction_conflicts(spark, sf):
    return _renamed(spark, sf)[1]


@register("corrections_refused_whole", f"""
SELECT id, CASE WHEN asked AND place = 1 THEN 'SAME' ELSE 'ORDER ' || id END AS description,
       CASE WHEN asked AND place = 1 THEN 'renamed' ELSE '' END AS notes FROM ({_RENAMED_SQL})""")
def corrections_refused_whole(spark, sf):
    return _renamed(spark, sf)[0].select("id", "description", "notes")


# --- parsing (P1, P2) and statement files (S1-S7) ----------------------------

@register("parse_dates", """
SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS transaction_date FROM orders""")
def parse_dates(spark, sf):
    o = FX.table(spark, sf, "orders")
    d = F.col("o_orderdate").cast("date")
    text = o.select(F.col("o_orderkey").alias("id"),
                    FX.render_date(d, F.col("o_orderkey")).alias("text"))
    return PF.with_parsed_dates(text, {"transaction_date": "text"}).select(
        "id", "transaction_date")


@register("parse_amounts", """
SELECT o_orderkey AS id, CAST(CASE WHEN o_orderstatus = 'F' THEN -CAST(o_totalprice AS DECIMAL(12,2))
  ELSE CAST(o_totalprice AS DECIMAL(12,2)) END AS DOUBLE) AS amount FROM orders""")
def parse_amounts(spark, sf):
    o = FX.table(spark, sf, "orders")
    a = F.col("o_totalprice").cast("decimal(12,2)")
    a = F.when(F.col("o_orderstatus") == "F", -a).otherwise(a)
    text = FX.render_amount(a, F.col("o_orderkey"))
    return o.select(F.col("o_orderkey").alias("id"),
                    PF.parse_amount(text).cast("double").alias("amount"))


def _statement_dir(spark, sf):
    return FX.write_statements(_orders(spark, sf), shared_dir(spark, "statements"))


_STATEMENT_ROWS = """
SELECT * FROM ledger
WHERE floor(account_id / 16) % 23 <> 0 AND id % 101 <> 0 AND id % 103 <> 0"""


@register("statement_ingest", O.with_orders(f"""
SELECT transaction_date, description, CAST(amount AS DOUBLE) AS amount,
       CAST(balance AS DOUBLE) AS balance, category, source
FROM ({_STATEMENT_ROWS})"""))
def statement_ingest(spark, sf):
    clean, _ = ST.read_statements(spark, _statement_dir(spark, sf), glob="*.txt")
    return money_out(clean.select("transaction_date", "description", "amount", "balance",
                                  "category", "source"))


@register("statement_ingest_split", O.with_orders(f"""
SELECT transaction_date, description, CAST(amount AS DOUBLE) AS amount,
       CAST(balance AS DOUBLE) AS balance, category, source
FROM ({_STATEMENT_ROWS})"""))
def statement_ingest_split(spark, sf):
    # the large-file reader: split text scan, per-file header aggregate, join
    clean, _ = ST.read_large_statements(spark, _statement_dir(spark, sf), glob="*.txt")
    return money_out(clean.select("transaction_date", "description", "amount", "balance",
                                  "category", "source"))


@register("statement_quoted_breaks", O.with_orders(f"""
SELECT transaction_date, CAST(amount AS DOUBLE) AS amount, CAST(balance AS DOUBLE) AS balance,
       CASE WHEN id % 7 = 0 THEN description || chr(10) || 'ref, "' || id || '"'
            ELSE description END AS description
FROM ({_STATEMENT_ROWS})"""))
def statement_quoted_breaks(spark, sf):
    """Every seventh description holds a line break, a comma and quotes inside its quoted cell."""
    ref = F.concat("description", F.lit('\nref, "'), F.col("id").cast("string"), F.lit('"'))
    ledger = _orders(spark, sf).withColumn(
        "description", F.when(F.col("id") % 7 == 0, ref).otherwise(F.col("description")))
    clean, _ = ST.read_statements(spark, FX.write_statements(ledger, shared_dir(spark, "quoted")),
                                  glob="*.txt")
    return money_out(clean.select("transaction_date", "description", "amount", "balance"))


@register("statement_rejects", O.with_orders("""
SELECT reason, COUNT(*) AS n FROM (
  SELECT CASE WHEN id % 101 = 0 THEN 'bad_date' ELSE 'bad_amount' END AS reason
  FROM ledger
  WHERE floor(account_id / 16) % 23 <> 0 AND (id % 101 = 0 OR id % 103 = 0)
  UNION ALL
  SELECT 'missing_column' FROM (SELECT DISTINCT floor(account_id / 16) AS k FROM ledger)
  WHERE k % 23 = 0
) GROUP BY reason"""))
def statement_rejects(spark, sf):
    _, rejects = ST.read_statements(spark, _statement_dir(spark, sf), glob="*.txt")
    return rejects.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@register("statement_files", O.with_orders(f"""
SELECT CAST(k AS BIGINT) AS file_key, COUNT(*) AS clean_rows, 1::BIGINT AS hashes,
       MIN(line_no) AS first_line, MAX(line_no) AS last_line
FROM (SELECT *, floor(account_id / 16) AS k,
             2 + ROW_NUMBER() OVER (PARTITION BY floor(account_id / 16) ORDER BY id) AS line_no
      FROM ledger)
WHERE k % 23 <> 0 AND id % 101 <> 0 AND id % 103 <> 0 GROUP BY k"""))
def statement_files(spark, sf):
    """Where the clean rows of each statement file stand: below its preamble, in the order of its
    lines (S5), under one content hash a file (S6)."""
    clean, _ = ST.read_statements(spark, _statement_dir(spark, sf), glob="*.txt")
    key = F.regexp_extract("path", r"file_key=(\d+)", 1).cast("long").alias("file_key")
    return clean.groupBy(key).agg(
        F.count(F.lit(1)).alias("clean_rows"), F.count_distinct("csv_hash").alias("hashes"),
        F.min("line_no").cast("long").alias("first_line"),
        F.max("line_no").cast("long").alias("last_line"))


@register("statement_hash_follows_content", O.with_orders("""
SELECT COUNT(DISTINCT floor(account_id / 16)) AS contents,
       COUNT(DISTINCT floor(account_id / 16)) AS hashes,
       2 * COUNT(DISTINCT floor(account_id / 16)) AS files
FROM ledger WHERE floor(account_id / 16) % 23 <> 0"""))
def statement_hash_follows_content(spark, sf):
    """Every statement file is there twice under two names: copies share a hash, others do not."""
    root = shared_dir(spark, "statement-copies")
    for name in ("a", "b"):
        FX.write_statements(_orders(spark, sf), f"{root}/{name}")
    clean, _ = ST.read_statements(spark, root, glob="*.txt")
    rows = clean.select("path", "csv_hash").distinct()
    key = F.regexp_extract("path", r"file_key=(\d+)", 1)
    return rows.agg(F.count_distinct(key).alias("contents"),
                    F.count_distinct("csv_hash").alias("hashes"),
                    F.count_distinct("path").alias("files"))


@register("statement_import", O.with_orders(f"""
SELECT COUNT(*) AS incoming,
       COUNT(*) FILTER (WHERE transaction_date >= DATE '1998-01-01') AS inserted,
       COUNT(*) FILTER (WHERE transaction_date < DATE '1998-01-01') AS skipped
FROM ({_STATEMENT_ROWS})"""))
def statement_import(spark, sf):
    clean, _ = ST.read_statements(spark, _statement_dir(spark, sf), glob="*.txt")
    existing = _orders(spark, sf).filter(F.col("transaction_date") < F.lit(_dt.date(1998, 1, 1)))
    return I.import_transactions(existing, clean, ["path", "line_no"]).counts


@register("stream_ingest", O.with_orders(f"""
SELECT transaction_date, description, CAST(amount AS DOUBLE) AS amount,
       CAST(balance AS DOUBLE) AS balance, category, source
FROM ({_STATEMENT_ROWS})"""))
def stream_ingest(spark, sf):
    """Two drops of statement files, each picked up by one availableNow run."""
    ledger = _orders(spark, sf)
    key = F.floor(F.col("account_id") / FX.ACCOUNTS_PER_FILE)
    in_dir = shared_dir(spark, "stream-in")
    out_dir = shared_dir(spark, "stream-ledger")
    ckpt = shared_dir(spark, "stream-ckpt")
    for i, part in enumerate([key % 2 == 0, key % 2 == 1]):
        FX.write_statements(ledger.filter(part), f"{in_dir}/drop{i}")
        q = SS.stream_statements(spark, in_dir, out_dir, ckpt, glob="*.txt")
        q.awaitTermination()
    return money_out(SS.read_ledger(spark, out_dir).select(
        "transaction_date", "description", "amount", "balance", "category", "source"))


@register("import_empty", "SELECT 0::BIGINT AS incoming, 0::BIGINT AS inserted, 0::BIGINT AS skipped")
def import_empty(spark, sf):
    """An empty batch against the whole ledger (K2)."""
    t = _orders(spark, sf)
    return I.import_transactions(t, t.where("false").withColumn("line_no", F.lit(0)), ["line_no"]).counts


# --- snapshots (K3-K7, S10) -------------------------------------------------

def _exported(spark, sf, ledger=None, m=None):
    path = shared_dir(spark, "snapshot")
    SN.export_snapshot(ledger if ledger is not None else _orders(spark, sf),
                       m if m is not None else _mappings(spark), path)
    return SN.read_snapshot(spark, path)


@register("snapshot_roundtrip", O.with_orders("""
SELECT transaction_date, description, CAST(amount AS DOUBLE) AS amount,
       CAST(balance AS DOUBLE) AS balance, category, source, notes FROM ledger"""))
def snapshot_roundtrip(spark, sf):
    snap = _exported(spark, sf)
    return money_out(SN.snapshot_to_ledger(snap.transactions).select(
        "transaction_date", "description", "amount", "balance", "category", "source", "notes"))


@register("snapshot_validation", O.with_orders_and_mappings("""
SELECT 'transactions' AS "table", 'missing_description' AS reason, COUNT(*) AS n
FROM ledger WHERE id % 89 = 0 OR id % 83 = 0 GROUP BY 1, 2
UNION ALL
SELECT 'person_mappings', 'missing_keyword', COUNT(*) FROM mappings WHERE person_name = 'Drew'"""))
def snapshot_validation(spark, sf):
    k = F.col("id")
    broken = _orders(spark, sf).withColumn(
        "description", F.when(k % 89 == 0, F.lit(None).cast("string"))
        .when(k % 83 == 0, F.lit("")).otherwise(F.col("description")))
    m = _mappings(spark).withColumn(
        "keyword", F.when(F.col("person_name") == "Drew", F.lit("")).otherwise(F.col("keyword")))
    snap = _exported(spark, sf, broken, m)
    return SN.validate_snapshot(snap).groupBy("table", "reason").agg(
        F.count(F.lit(1)).alias("n"))


@register("snapshot_invalid_rows", O.with_orders("""
SELECT 'transactions' AS "table", "index", 'missing_description' AS reason FROM (
  SELECT row_number() OVER (ORDER BY id) - 1 AS "index", amount FROM ledger) WHERE amount > 200000"""))
def snapshot_invalid_rows(spark, sf):
    """A snapshot in order of the ids; the position of every row that a dry run finds fault with."""
    broken = _orders(spark, sf).withColumn("description", F.when(F.col("amount") <= 200000, F.col("description")))
    path = shared_dir(spark, "snapshot")
    SN.export_snapshot(broken.limit(0), _mappings(spark), path)
    broken.orderBy("id").select("transaction_date", "description", "amount").write.mode("overwrite").json(
        f"{path}/transactions")
    return SN.validate_snapshot(SN.read_snapshot(spark, path))


def _two_copies(spark, sf):
    """A snapshot whose second, larger file repeats the keys of its first with other notes."""
    t = _orders(spark, sf).select("transaction_date", "description", "amount", "notes")
    path = shared_dir(spark, "snapshot")
    SN.export_snapshot(_orders(spark, sf).limit(0), _mappings(spark), path)
    early = F.col("transaction_date") < F.lit(_dt.date(1996, 1, 1))
    for name, rows in (("0", t.where(early)), ("1", t)):
        rows.withColumn("notes", F.lit(name)).write.json(f"{path}/transactions/{name}")
    return SN.read_snapshot(spark, path)


@register("snapshot_first_wins", O.with_orders("""
SELECT CASE WHEN transaction_date < DATE '1996-01-01' THEN '0' ELSE '1' END AS notes, COUNT(*) AS n,
       CAST(SUM(amount) AS DOUBLE) AS total
FROM (SELECT DISTINCT transaction_date, description, amount FROM ledger) GROUP BY 1"""))
def snapshot_first_wins(spark, sf):
    empty_t, empty_m = _orders(spark, sf).limit(0), _mappings(spark).limit(0)
    new, _, _ = SN.import_snapshot(empty_t, empty_m, _two_copies(spark, sf))
    return new.groupBy("notes").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").cast("double").alias("total"))


@register("snapshot_times", O.with_orders("""
SELECT notes, COUNT(*) AS n, COUNT(*) FILTER (WHERE notes = 'given') AS kept,
       COUNT(*) FILTER (WHERE notes = 'absent') AS now FROM (
  SELECT CASE WHEN transaction_date < DATE '1998-01-01' THEN 'given' ELSE 'absent' END AS notes FROM (
    SELECT DISTINCT transaction_date, description, amount FROM ledger)) GROUP BY 1"""))
def snapshot_times(spark, sf):
    """Given import times stay, absent ones become the time of the import (K9)."""
    given = F.to_timestamp(F.lit("2001-02-03 04:05:06"))
    early = F.col("transaction_date") < F.lit(_dt.date(1998, 1, 1))
    t = (_orders(spark, sf).withColumn("imported_at", F.when(early, given))
         .withColumn("notes", F.when(early, F.lit("given")).otherwise(F.lit("absent"))))
    new, _, _ = SN.import_snapshot(t.limit(0), _mappings(spark).limit(0), _exported(spark, sf, t))
    return new.groupBy("notes").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("imported_at") == given).alias("kept"),
        F.count_if(F.abs(F.unix_timestamp("imported_at") - F.unix_timestamp()) < 86400).alias("now"))


@register("snapshot_counts", O.with_orders_and_mappings("""
SELECT 'transactions' AS "table", COUNT(*) AS expected, COUNT(*) AS actual, TRUE AS ok FROM ledger
UNION ALL
SELECT 'person_mappings', COUNT(*), COUNT(*), TRUE FROM mappings"""))
def snapshot_counts(spark, sf):
    snap = _exported(spark, sf)
    return SN.verify_counts(snap.transactions, snap.mappings, snap.manifest)


@register("snapshot_import", O.with_orders_and_mappings("""
SELECT 'transactions' AS "table", COUNT(*) AS incoming,
       COUNT(*) FILTER (WHERE transaction_date >= DATE '1998-01-01') AS inserted,
       COUNT(*) FILTER (WHERE transaction_date < DATE '1998-01-01') AS skipped FROM ledger
UNION ALL
SELECT 'person_mappings', (SELECT COUNT(*) FROM mappings) + COUNT(*),
       (SELECT COUNT(*) FROM mappings), COUNT(*) FROM customer"""))
def snapshot_import(spark, sf):
    # the snapshot holds the fixture mappings and one per customer; the stored
    # side already has the customer ones
    customer_m = _id_mappings(spark, sf).withColumn("created_at", F.lit(None).cast("timestamp"))
    snap = _exported(spark, sf, m=_mappings(spark).unionByName(customer_m))
    existing_t = _orders(spark, sf).filter(F.col("transaction_date") < F.lit(_dt.date(1998, 1, 1)))
    _, _, counts = SN.import_snapshot(existing_t, customer_m, snap)
    return counts


@register("existing_counts", O.with_orders_and_mappings("""
SELECT (SELECT COUNT(*) FROM ledger) AS existing_transactions,
       (SELECT COUNT(*) FROM mappings) AS existing_mappings"""))
def existing_counts(spark, sf):
    return SN.existing_counts(_orders(spark, sf), _mappings(spark))
