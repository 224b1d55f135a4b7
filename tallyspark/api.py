"""Call-for-call access to the operators under the reference's method names.

``Ledger`` holds the transactions and mappings DataFrames and answers every
read and write the reference offers; results are DataFrames (or tuples of
them) instead of lists of dicts, and every write returns new tables instead
of mutating a database. ``keys`` (e.g. ``["account_id"]``) runs the same call
for many accounts at once.
"""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import contrib as C
from .operators import ingest as I
from .operators import maintain as M
from .operators import project as P
from .operators import query as Q
from .operators import recurring as R
from .operators import stats as S
from .sources import snapshot as SN
from .sources import statements as ST


@dataclass(frozen=True)
class Statistics:
    overall: DataFrame
    deposits_by_source: DataFrame
    monthly_breakdown: DataFrame
    by_category: DataFrame


@dataclass(frozen=True)
class Ledger:
    spark: SparkSession
    transactions: DataFrame
    mappings: DataFrame
    keys: tuple[str, ...] = ()

    # --- reads -------------------------------------------------------------
    def get_all_transactions(self, limit: int | None = None, offset: int = 0) -> DataFrame:
        return Q.list_page(self.transactions, limit, offset)

    def get_transaction_count(self) -> DataFrame:
        return Q.transaction_count(self.transactions)

    def search_transactions(self, search_term=None, start_date=None, end_date=None,
                            category=None, source=None, min_amount=None,
                            max_amount=None) -> DataFrame:
        return Q.search(self.transactions, text=search_term, start=start_date, end=end_date,
                        category=category, source=source, min_amount=min_amount,
                        max_amount=max_amount, ordered=True)

    def get_statistics(self, start_date=None, end_date=None) -> Statistics:
        keys = list(self.keys)
        t = self.transactions
        return Statistics(
            S.overall(t, start_date, end_date, keys),
            S.deposits_by_source(t, start_date, end_date, keys, ordered=True),
            S.monthly(t, start_date, end_date, keys, ordered=True),
            S.by_category(t, start_date, end_date, keys, ordered=True))

    def get_recurring_transactions(self, min_occurrences: int = 3) -> DataFrame:
        return S.recurring(self.transactions, min_occurrences, list(self.keys), ordered=True)

    def get_categories(self) -> DataFrame:
        return Q.distinct_values(self.transactions, "category")

    def get_sources(self) -> DataFrame:
        return Q.distinct_values(self.transactions, "source")

    def get_person_mappings(self) -> DataFrame:
        return M.list_mappings(self.mappings)

    def get_contributions(self, start_date=None, end_date=None, person_name=None) -> DataFrame:
        return C.contributions(self.transactions, self.mappings, start_date, end_date,
                               person_name, ordered=True)

    def get_contribution_statistics(self, start_date=None, end_date=None
                                    ) -> tuple[DataFrame, DataFrame]:
        """(by_person, monthly_by_person)."""
        return (C.totals(self.transactions, self.mappings, start_date, end_date, ordered=True),
                C.monthly_totals(self.transactions, self.mappings, start_date, end_date,
                                 ordered=True))

    def analyze_recurring_from_transactions(self, min_occurrences: int = 3) -> DataFrame:
        return R.analyze_recurring(self.transactions, min_occurrences, list(self.keys),
                                   ordered=True)

    def calculate_projections(self, accounts: DataFrame, items: DataFrame, months: int = 12,
                              as_of: _dt.date | None = None) -> tuple[DataFrame, DataFrame]:
        return P.project_balances(accounts, items, months, as_of, list(self.keys) or None)

    def latest_balance(self) -> DataFrame:
        return Q.latest_balance(self.transactions, list(self.keys))

    # --- writes (return a new Ledger plus what the reference reports) -------
    def import_csv(self, path: str, glob: str = "*.csv", strict_header: bool = False):
        """Statement files -> (new ledger, counts, rejects)."""
        clean, rejects = ST.read_statements(self.spark, path, strict_header, glob)
        res = I.import_transactions(self.transactions, clean, ["path", "line_no"])
        # new rows get an id from their key (the key is unique in the ledger)
        keyed = res.new.withColumn("id", F.xxhash64(*I.KEY)).withColumn(
            "imported_at", F.current_timestamp())
        new = keyed.select(*[c for c in self.transactions.columns if c in keyed.columns])
        return (replace(self, transactions=self.transactions.unionByName(
            new, allowMissingColumns=True)), res.counts, rejects)

    def update_transactions(self, corrections: DataFrame) -> Ledger:
        return replace(self, transactions=M.apply_corrections(self.transactions, corrections))

    def add_person_mappings(self, new: DataFrame) -> tuple[Ledger, DataFrame]:
        m, rejects = M.upsert_mappings(self.mappings, new)
        return replace(self, mappings=m), rejects

    def delete_person_mappings(self, ids: DataFrame) -> tuple[Ledger, DataFrame]:
        m, missing = M.delete_mappings(self.mappings, ids)
        return replace(self, mappings=m), missing

    def export_snapshot(self, path: str) -> DataFrame:
        return SN.export_snapshot(self.transactions, self.mappings, path)

    def import_snapshot(self, path: str, document: bool = False):
        """(new ledger, counts) from a snapshot folder (or a single document)."""
        snap = SN.read_document(self.spark, path) if document else SN.read_snapshot(
            self.spark, path)
        new_t, new_m, counts = SN.import_snapshot(self.transactions, self.mappings, snap)
        new_t = new_t.withColumn("id", F.xxhash64(*I.KEY))
        t = self.transactions.unionByName(
            new_t.select(*[c for c in self.transactions.columns if c in new_t.columns]),
            allowMissingColumns=True)
        m = self.mappings.unionByName(
            new_m.withColumn("id", F.xxhash64("person_name", "keyword")),
            allowMissingColumns=True)
        return replace(self, transactions=t, mappings=m), counts
