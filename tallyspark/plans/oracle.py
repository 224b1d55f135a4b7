"""DuckDB oracle SQL for the registered queries.

Written independently of the Spark plans: the ledgers are rebuilt from the
driver tables with plain SQL (``CASE``, ``contains``, ``split_part``), and each
query states the reference semantics directly. Money leaves as DOUBLE cast
from exact DECIMAL sums; ratios are ``CAST(sum AS DOUBLE) / count``.
"""

from __future__ import annotations

from ..sources.fixtures import MAPPING_ROWS, VOCABULARY


def _values(rows) -> str:
    def q(v):
        return "'" + str(v).replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(q(x) if isinstance(x, str) else str(x) for x in r) + ")"
                     for r in rows)


VOCAB_VALUES = _values([(i, t) for i, t in enumerate(VOCABULARY)])
MAPPING_VALUES = _values([(i + 1, p, k) for i, (p, k) in enumerate(MAPPING_ROWS)])

_ORDERS_BASE = f"""
orders_base AS (
  SELECT o.o_orderkey AS id, c.c_custkey AS account_id,
         CAST(o.o_orderdate AS DATE) AS transaction_date,
         CONCAT(v.txt, ' - ', c.c_name) AS description,
         CASE WHEN o.o_orderkey % 97 = 0 THEN CAST(0 AS DECIMAL(12,2))
              WHEN o.o_orderstatus = 'F' OR (o.o_orderstatus = 'P' AND o.o_orderkey % 2 = 1)
                THEN -CAST(o.o_totalprice AS DECIMAL(12,2))
              ELSE CAST(o.o_totalprice AS DECIMAL(12,2)) END AS amount,
         CASE WHEN o.o_orderkey % 5 = 0 THEN NULL
              ELSE CAST(c.c_acctbal AS DECIMAL(12,2)) END AS balance,
         CASE WHEN o.o_orderkey % 7 = 0 THEN o.o_orderpriority END AS notes
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN (VALUES {VOCAB_VALUES}) AS v(i, txt) ON o.o_orderkey % 24 = v.i
)"""

CATEGORY_SQL = """
CASE WHEN amount > 0 THEN
  CASE WHEN contains(lower(description), 'direct dep') OR contains(lower(description), 'deposit')
         OR contains(lower(description), 'payroll') OR contains(lower(description), 'salary')
         THEN 'Income'
       WHEN contains(lower(description), 'transfer') OR contains(lower(description), 'xfer')
         THEN 'Transfer In'
       WHEN contains(lower(description), 'interest') OR contains(lower(description), 'dividend')
         THEN 'Interest/Dividend'
       ELSE 'Other Income' END
ELSE
  CASE WHEN contains(lower(description), 'atm') OR contains(lower(description), 'withdrawal')
         THEN 'ATM/Cash'
       WHEN contains(lower(description), 'grocery') OR contains(lower(description), 'supermarket')
         OR contains(lower(description), 'food') THEN 'Groceries'
       WHEN contains(lower(description), 'gas') OR contains(lower(description), 'fuel')
         OR contains(lower(description), 'shell') OR contains(lower(description), 'exxon')
         OR contains(lower(description), 'chevron') THEN 'Gas/Fuel'
       WHEN contains(lower(description), 'restaurant') OR contains(lower(description), 'cafe')
         OR contains(lower(description), 'coffee') THEN 'Dining'
       WHEN contains(lower(description), 'utility') OR contains(lower(description), 'electric')
         OR contains(lower(description), 'water') THEN 'Utilities'
       WHEN contains(lower(description), 'transfer') OR contains(lower(description), 'xfer')
         THEN 'Transfer Out'
       WHEN contains(lower(description), 'check') OR contains(lower(description), 'cheque')
         THEN 'Check'
       WHEN contains(lower(description), 'fee') OR contains(lower(description), 'charge')
         THEN 'Fees'
       ELSE 'Other Expense' END
END"""

SOURCE_SQL = r"""
CASE WHEN amount > 0 THEN
  CASE WHEN contains(lower(description), 'direct dep') OR contains(lower(description), 'payroll') THEN
         CASE WHEN len(string_split_regex(trim(description), '\s+')) > 2
              THEN array_to_string(string_split_regex(trim(description), '\s+')[3:4], ' ')
              ELSE 'Payroll' END
       WHEN contains(lower(description), 'transfer') THEN 'Transfer'
       WHEN contains(lower(description), 'interest') THEN 'Interest'
       ELSE 'Other' END
ELSE left(trim(split_part(description, '-', 1)), 50)
END"""

ORDERS_LEDGER_CTE = f"""{_ORDERS_BASE},
ledger AS (
  SELECT *, {CATEGORY_SQL} AS category, {SOURCE_SQL} AS source FROM orders_base
)"""

MAPPINGS_CTE = f"""
mappings AS (
  SELECT * FROM (VALUES {MAPPING_VALUES}) AS m(id, person_name, keyword)
)"""

EVENTS_LEDGER_CTE = """
ledger AS (
  SELECT event_id AS id, user_id AS account_id, CAST(ts AS DATE) AS transaction_date,
         CONCAT(event_type, ' ', CAST(user_id AS VARCHAR), '/', CAST(event_id % 5 AS VARCHAR))
           AS description,
         CASE WHEN event_type IN ('purchase', 'error') THEN -CAST(value AS DECIMAL(12,2))
              ELSE CAST(value AS DECIMAL(12,2)) END AS amount
  FROM events
)"""

COARSE_EVENTS_CTE = """
coarse AS (
  SELECT event_id AS id, user_id AS account_id, CAST(ts AS DATE) AS transaction_date,
         event_type AS description, CAST(round(value, 0) AS DECIMAL(12,2)) AS amount,
         event_id AS line_no
  FROM events
)"""


def with_ctes(*ctes: str, body: str) -> str:
    """``WITH cte1, cte2, ... body`` from ``name AS (...)`` definitions."""
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n" + body


def with_orders(body: str) -> str:
    return with_ctes(ORDERS_LEDGER_CTE, body=body)


def with_orders_and_mappings(body: str, *more: str) -> str:
    return with_ctes(ORDERS_LEDGER_CTE, MAPPINGS_CTE, *more, body=body)
