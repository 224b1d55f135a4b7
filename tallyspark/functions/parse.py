"""Tolerant parsing of statement cells: NA detection, dates and amounts.

Every parser returns NULL for a value it cannot read, so callers route such
rows to ``rejects`` instead of failing the job (ANSI mode is on in Spark 4).
All parsers are built-in expressions (no UDF) and are kept small enough to
stay inside whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import built_once
from .text import strip_ws

# The cell texts pandas ``read_csv`` treats as missing by default.
NA_VALUES = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

_MONTH_NAME = (
    r"(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|"
    r"aug(?:ust)?|sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
)
_MONTH_ABBR = ["jan", "feb", "mar", "apr", "may", "jun",
               "jul", "aug", "sep", "oct", "nov", "dec"]
_ISO = (r"^(\d{4})-(\d{1,2})-(\d{1,2})[T ]\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?"
        r"(?:Z|[+-]\d{2}:?\d{2})?$")

# Number grammar accepted by the amount parser after cleaning (no inf/nan,
# no digit underscores: both are deliberate rejects).
NUMBER_RE = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def is_na(raw: Column) -> Column:
    """True for a missing cell: NULL or one of pandas' default NA texts."""
    return raw.isNull() | raw.isin(NA_VALUES)


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` worked out once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _pivot_yy(yy: Column) -> Column:
    """Two-digit year as ``%y`` reads it: 69..99 -> 19xx, 00..68 -> 20xx."""
    return F.when(yy >= 69, yy + 1900).otherwise(yy + 2000)


def _digits(x: Column) -> Column:
    """Non-empty and made of ASCII digits only (no regex)."""
    return (F.length(x) > 0) & (F.translate(x, "0123456789", "") == "")


def make_valid_date(y: Column, m: Column, d: Column) -> Column:
    """DATE for (y, m, d), or NULL when it is not a calendar date."""
    ok = y.between(1, 9999) & m.between(1, 12) & (d >= 1)
    first = F.when(ok, F.make_date(y, m, F.lit(1)))
    return F.when(d <= F.dayofmonth(F.last_day(first)), F.date_add(first, d - 1))


def _month_from_name(name: Column) -> Column:
    abbr = F.array(*[F.lit(m) for m in _MONTH_ABBR])
    return F.array_position(abbr, F.lower(F.substring(name, 1, 3))).cast("int")


def _named(s: Column, regex: str, order: str) -> Column:
    full = f"(?i)^{regex}$"
    g = {k: F.regexp_extract(s, full, i + 1) for i, k in enumerate(order)}
    return F.when(s.rlike(full), _date_of(g["y"].cast("int"), _month_from_name(g["m"]),
                                          g["d"].cast("int")))


def _date_of(y: Column, m: Column, d: Column) -> Column:
    """``make_valid_date`` of fields that are dear to work out."""
    return _let(F.struct(y.alias("y"), m.alias("m"), d.alias("d")),
                lambda v: make_valid_date(v["y"], v["m"], v["d"]))


def _readings(s: Column, parts: Column, seps: Column) -> tuple[Column, Column]:
    """The month-first and day-first readings of a date text as ``yyyymmdd``
    integers (``s`` stripped, ``parts`` split on ``/``/``-``, ``seps`` its
    separators); NULL when the text does not have that shape."""
    slash, dash = seps == "//", seps == "--"
    two = slash | dash
    a, b, c = (F.get(parts, i) for i in range(3))
    av, bv, cv = (p.try_cast("int") for p in (a, b, c))
    la, lb, lc = (F.length(p) for p in (a, b, c))

    def num(p, n):                    # digits only (separators already checked)
        return ~p.contains(" ") & (n > 0)

    def month(p, n, x):               # %m
        return num(p, n) & (n <= 2) & x.between(1, 12)

    def day(p, n, x):                 # %d, including ' 5'
        spaced = (n == 2) & p.startswith(" ") & (F.substring(p, 2, 1) != "0")
        return (num(p, n) & (n <= 2) & x.between(1, 31)) | spaced

    def ymd(y, m, d):                 # one integer yyyymmdd (checked later)
        return F.when(y >= 1, y * 10000 + m * 100 + d)

    y4c, y4a, y2c = num(c, lc) & (lc == 4), num(a, la) & (la == 4), num(c, lc) & (lc == 2)
    ad, bd, cd = (F.trim(p).try_cast("int") for p in (a, b, c))
    mdy = month(a, la, av) & day(b, lb, bv)
    pivot = _pivot_yy(cv)
    # month-first reading: M/d/yyyy, yyyy-M-d, M-d-yyyy, yyyy/M/d, M/d/yy
    first = (F.when(two & y4c & mdy, ymd(cv, av, bd))
             .when(two & y4a & month(b, lb, bv) & day(c, lc, cv), ymd(av, bv, cd))
             .when(slash & y2c & mdy, ymd(pivot, av, bd)))
    # day-first reading: d/M/yyyy, d-M-yyyy; then the fallback d/M/yy
    short = num(a, la) & (la <= 2) & num(b, lb) & (lb <= 2)
    second = (F.when(two & y4c & day(a, la, av) & month(b, lb, bv), ymd(cv, bv, ad))
              .when(slash & y2c & short, ymd(pivot, bv, ad)))
    return first, second


def _combine(s: Column, first: Column, second: Column) -> Column:
    """First valid reading, else the regex fallbacks (evaluated lazily)."""
    def valid(code):
        text = F.lpad(code.cast("string"), 8, "0")
        return F.call_function("try_to_date", text, F.lit("yyyyMMdd"))

    fallbacks = [
        F.when(s.rlike(_ISO), _date_of(F.regexp_extract(s, _ISO, 1).cast("int"),
                                       F.regexp_extract(s, _ISO, 2).cast("int"),
                                       F.regexp_extract(s, _ISO, 3).cast("int"))),
        _named(s, _MONTH_NAME + r"\.? +(\d{1,2}),? +(\d{4})", "mdy"),
        _named(s, r"(\d{1,2}) +" + _MONTH_NAME + r"\.?,? +(\d{4})", "dmy"),
        F.when(_digits(s) & (F.length(s) == 8),
               _date_of(F.substring(s, 1, 4).cast("int"),
                        F.substring(s, 5, 2).cast("int"),
                        F.substring(s, 7, 2).cast("int"))),
    ]
    return F.coalesce(valid(first), valid(second), *fallbacks)


def _split_date(s: Column) -> tuple[Column, Column]:
    return F.split(s, "[/-]"), F.translate(s, "0123456789 ", "")


DATE_RULES = """Order (first success wins): M/d/yyyy, yyyy-M-d, M-d-yyyy, d/M/yyyy,
    yyyy/M/d, M/d/yy, d-M-yyyy (field grammars of ``strptime``: month and day
    1-2 digits -- a day may also be a space and a digit --, ``%Y`` 4 digits,
    ``%y`` 2 digits pivoting at 69); then a fixed fallback list standing in
    for the open-ended general parser: ``d/M/yy``, ISO date-time (space or
    ``T``), ``Jan 15, 2024``, ``15 Jan 2024``, ``yyyyMMdd``. Ambiguous dates are
    month-first; a calendar-invalid reading (Feb 30) falls through.

    The seven main formats are told apart by their separators and by which
    field has four (or two) digits, so at most two readings -- month-first,
    then day-first -- need a calendar check, with no regular expression or
    format parser; the regex fallbacks only run for text no reading accepts."""


def parse_date(raw: Column) -> Column:
    """Statement date text -> DATE, or NULL when no format applies.

    Column form; for bulk parsing ``with_parsed_dates`` computes the stripped
    text and its fields once per row as intermediate columns.
    """
    s = strip_ws(raw.cast("string"))
    parts, seps = _split_date(s)
    return F.when(~is_na(raw), _combine(s, *_readings(s, parts, seps)))


parse_date.__doc__ += "\n\n    " + DATE_RULES


@built_once
def _date_stages(raw: str, prefix: str) -> tuple[list[dict[str, Column]], Column]:
    """The intermediate columns of ``with_parsed_dates``, stage by stage, and the date."""
    s_, p_, e_, r1, r2 = (f"{prefix}{k}" for k in ("s", "p", "e", "r1", "r2"))
    parts, seps = _split_date(F.col(s_))
    first, second = _readings(F.col(s_), F.col(p_), F.col(e_))
    return ([{s_: strip_ws(F.col(raw).cast("string"))}, {p_: parts, e_: seps}, {r1: first, r2: second}],
            F.when(~is_na(F.col(raw)), _combine(F.col(s_), F.col(r1), F.col(r2))))


def with_parsed_dates(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add ``out = parse_date(raw)`` for each ``{out: raw}`` in stages.

    The stripped text, its split fields and both readings are intermediate
    columns, so each is computed once per row and the final expression stays
    small enough for whole-stage code generation.
    """
    tmp = []
    for i, (out, raw) in enumerate(columns.items()):
        stages, date = _date_stages(raw, f"_pd{i}_")
        for stage in stages:
            df = df.withColumns(stage)
            tmp += stage
        df = df.withColumn(out, date)
    return df.drop(*tmp)


with_parsed_dates.__doc__ += "\n\n    " + DATE_RULES


def clean_amount_text(raw: Column) -> Column:
    """Strip, drop ``$``, ``,`` and spaces, then turn ``(x)`` into ``-x``."""
    def signed(s: Column) -> Column:
        inner = F.substring(s, F.lit(2), F.length(s) - 2)
        return F.when(s.startswith("(") & s.endswith(")"), F.concat(F.lit("-"), inner)).otherwise(s)
    return _let(F.translate(strip_ws(raw.cast("string")), "$, ", ""), signed)


# A zero mantissa with any exponent ("0e99") is zero; Spark's decimal cast
# would count the exponent as integer digits and overflow.
ZERO_RE = r"^[+-]?(0+\.?0*|\.0+)([eE][+-]?\d+)?$"


def parse_number(raw: Column) -> Column:
    """Amount text -> decimal(12,2) (HALF_UP), NULL when unreadable."""
    return _let(clean_amount_text(raw), lambda s: (
        F.when(s.rlike(ZERO_RE), F.lit(0).cast("decimal(12,2)"))
        .when(s.rlike(NUMBER_RE), s.try_cast("decimal(12,2)"))))


def parse_amount(raw: Column) -> Column:
    """Amount cell -> decimal(12,2); a missing cell is 0.00, NULL = reject."""
    return F.when(is_na(raw), F.lit(0).cast("decimal(12,2)")).otherwise(parse_number(raw))


def parse_balance(raw: Column) -> Column:
    """Balance cell: a missing cell stays NULL; unreadable text is a reject.

    Returns a struct ``(value, ok)`` so the caller can tell NULL from reject.
    """
    return _let(parse_number(raw), lambda value: F.struct(
        F.when(is_na(raw), F.lit(None).cast("decimal(12,2)")).otherwise(value).alias("value"),
        (is_na(raw) | value.isNotNull()).alias("ok"),
    ))
