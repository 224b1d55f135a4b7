"""Every registered query against its DuckDB oracle SQL (the driver's check)."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF_SMALL

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def _norm(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])

    def v(x):
        if isinstance(x, float):
            return "nan" if math.isnan(x) else round(x, 6)
        return x.isoformat() if hasattr(x, "isoformat") else x
    out = [tuple(v(r[i]) for i in order) for r in rows]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        p = f"{SF_SMALL}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF_SMALL)
    srows = [tuple(r) for r in df.collect()]
    cur = duck.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    assert _norm(srows, df.columns) == _norm(drows, dcols)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["month", "deposits", "withdrawals", "net"]


def test_random_search_filters_match_duckdb(spark, duck):
    import random

    from tallyspark.operators import query as Q
    from tallyspark.plans import oracle as O
    from tallyspark.sources import fixtures as FX
    rnd = random.Random(43)
    t = FX.orders_ledger(spark, SF_SMALL)
    for _ in range(12):
        p = {"text": rnd.choice([None, "", "coffee", "e_d", "TRANSFER", "high", "1%"]),
             "start": rnd.choice([None, "", "1996-01-01", "1998-06-30"]),
             "end": rnd.choice([None, "", "1997-12-31", "2000-01-01"]),
             "category": rnd.choice([None, "", "Dining", "Income", "Fees"]),
             "source": rnd.choice([None, "", "Transfer", "Other"]),
             "min_amount": rnd.choice([None, 0, -1000, 50000]),
             "max_amount": rnd.choice([None, 0, 100000])}
        where = ["TRUE"]
        if p["text"]:
            pat = "%" + p["text"] + "%"
            where.append(f"(description ILIKE '{pat}' OR notes ILIKE '{pat}')")
        if p["start"]:
            where.append(f"transaction_date >= DATE '{p['start']}'")
        if p["end"]:
            where.append(f"transaction_date <= DATE '{p['end']}'")
        if p["category"]:
            where.append(f"category = '{p['category']}'")
        if p["source"]:
            where.append(f"source = '{p['source']}'")
        if p["min_amount"] is not None:
            where.append(f"amount >= {p['min_amount']}")
        if p["max_amount"] is not None:
            where.append(f"amount <= {p['max_amount']}")
        sql = O.with_orders("SELECT id FROM ledger WHERE " + " AND ".join(where))
        want = sorted(r[0] for r in duck.execute(sql).fetchall())
        got = sorted(r.id for r in Q.search(t, **p).select("id").collect())
        assert got == want, p
