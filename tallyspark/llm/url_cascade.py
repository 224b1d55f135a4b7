"""URL rules through a Bloom-filter cascade over the corpus's complete key universe.

A rule is ``host + path prefix`` (``example.net/en/``). A url's *keys* are every host suffix
(on label borders) with each path prefix whose length some rule has. The cascade holds, for a
list of rule keys, alternate Bloom filters: level 0 the listed keys, level 1 those keys of the
universe that pass level 0 without being listed, level 2 the listed keys that pass level 1, and
so on until a level has no false positive left. Membership of any key of the universe is then
exact, and the judged table meets the filters as literals: no join and no shuffle of urls.

The filters' size follows the rule list (about 1.44 log2(universe / list) bits a listed key on
level 0, under 2 bits a key below), so they take less memory than the list that the caller hands
over. Only built-in functions are used.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, read, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Fixed values of the contract.
RULES = (("net/", "block"), ("example.net/en/", "allow"),
         ("example.com/de/", "block"), ("org/fr/", "allow"))
# The filter's own list: hosts blocked where no rule fits (with all subdomains).
HOSTS = ("spam-farm.example.org", "cheap-pills.example.com")


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def url_keys(host: Column, path: Column, labels: int, lengths: list[int]) -> Column:
    """Every (host suffix of at most ``labels`` labels) x (path prefix of a length in
    ``lengths`` that the path has), as ``suffix + prefix``. An empty host has none."""
    parts = F.split(host, r"\.", -1)
    n = F.size(parts)
    take = F.sequence(F.lit(1), F.least(n, F.lit(labels)))
    suffixes = F.transform(take, lambda i: F.array_join(F.slice(parts, n - i + 1, i), "."))
    none = F.array().cast("array<string>")

    def with_prefix(size):
        return F.when(F.length(path) >= size, F.transform(
            suffixes, lambda s: F.concat(s, F.substring(path, 1, size)))).otherwise(none)
    return F.when(host != "", F.concat(*map(with_prefix, lengths))).otherwise(none)


class Level:
    """One Bloom filter: ``bits`` bits as 64-bit words, ``hashes`` probes, its own seed."""

    def __init__(self, seed: int, bits: int, hashes: int, words: list[int]):
        self.seed, self.bits, self.hashes, self.words = seed, bits, hashes, words

    def has(self, key: Column) -> Column:
        # one literal, folded when the plan is made
        table = F.from_json(F.lit(str(self.words)), "array<bigint>")
        return reduce(lambda a, b: a & b, [
            F.bit_get(F.get(table, F.shiftright(p, 6).cast("int")),
                      F.pmod(p, F.lit(64)).cast("int")) == 1
            for p in positions(key, self.seed, self.bits, self.hashes)])


def positions(key: Column, seed: int, bits: int, hashes: int) -> list[Column]:
    a = F.pmod(F.xxhash64(key, F.lit(2 * seed)), F.lit(bits))
    step = F.pmod(F.xxhash64(key, F.lit(2 * seed + 1)), F.lit(max(1, bits - 1))) + 1
    return [F.pmod(a + F.lit(j) * step, F.lit(bits)) for j in range(hashes)]


def make_level(keys: DataFrame, n: int, rate: float, seed: int) -> Level:
    """A filter of ``n`` keys with about ``rate`` false positives. Its words are aggregated by
    Spark; the driver gets at most ``bits / 64`` of them."""
    bits = 64 * max(1, math.ceil(n * -math.log(rate) / math.log(2) ** 2 / 64))
    hashes = min(32, max(1, round(-math.log2(rate))))
    pos = keys.select(F.explode(F.array(*positions(F.col("key"), seed, bits, hashes)))
                      .alias("p"))
    got = (pos.groupBy(F.shiftright("p", 6).alias("w"))
           .agg(F.expr("bit_or(shiftleft(1L, cast(pmod(p, 64) as int)))").alias("v")).collect())
    words = [0] * (bits // 64)
    for r in got:
        words[r.w] = r.v
    return Level(seed, bits, hashes, words)


class Cascade:
    """Exact membership in ``listed`` for every key of the universe it was built over."""

    def __init__(self, levels: list[Level]):
        self.levels = levels

    def has(self, key: Column) -> Column:
        out = F.lit(False)
        for level in reversed(self.levels):
            out = level.has(key) & ~out
        return F.lit(False) if not self.levels else out


def build_cascade(universe: DataFrame, listed: DataFrame, n_universe: int) -> Cascade:
    """``universe``: distinct non-null ``key`` rows of the corpus; ``listed``: ``key`` rows."""
    listed = listed.where("key is not null").distinct()
    n = listed.count()
    if not n:
        return Cascade([])
    inside, outside = listed, universe.join(listed, "key", "left_anti")
    levels: list[Level] = []
    rate = min(0.5, n / max(1, n_universe))
    while n:
        levels.append(make_level(inside, n, rate, len(levels)))
        wrong = stored(outside.where(levels[-1].has(F.col("key"))), "cascade-level")
        inside, outside, n, rate = wrong, inside, wrong.count(), 0.5
    return Cascade(levels)


def filter_urls(pages: DataFrame, rules=RULES, hosts=HOSTS, url: str = "url") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict`` appended (columns of these
    names are replaced).

    Longest fitting rule wins; of equal length the later in code-point order, and a rule listed
    both ways blocks. Without a rule, ``hosts`` (with subdomains) are blocked and all else,
    null and malformed urls included, is allowed. Repeated rows stay; an empty table gives an
    empty result.
    """
    spark = pages.sparkSession
    cut = [(r, r.index("/") if "/" in r else len(r), a) for r, a in rules]
    lengths = sorted({len(r) - at for r, at, _ in cut} | {0})
    labels = max([r[:at].count(".") + 1 for r, at, _ in cut] + [h.count(".") + 1 for h in hosts])
    host, path = split_url(F.col(f"`{url}`"))
    keys = url_keys(host, path, labels, lengths)
    universe = stored(pages.select(F.explode(keys).alias("key")).distinct(), "url-universe")
    n_universe = universe.count()

    def cascade(listed):
        return build_cascade(
            universe, spark.createDataFrame([(k,) for k in listed], "key string"), n_universe)

    blocked = cascade([r for r, _, a in cut if a == "block"])
    allowed = cascade([r for r, _, a in cut if a == "allow"])
    own = cascade(list(hosts))
    base = pages.drop("host", "path", "rule", "verdict") if url not in (
        "host", "path", "rule", "verdict") else pages
    held = free_name(base, "keys")
    judged = base.withColumns({"host": host, "path": path}).withColumn(held, keys)
    hits = F.filter(held, lambda k: blocked.has(k) | allowed.has(k))
    best = F.array_max(F.transform(hits, lambda k: F.struct(F.length(k).alias("n"), k.alias("k"))))
    judged = judged.withColumn("rule", best["k"])
    verdict = (F.when(F.col("rule").isNotNull(),
                      F.when(blocked.has(F.col("rule")), F.lit("block")).otherwise("allow"))
               .when(F.exists(held, lambda k: own.has(k)), F.lit("block")).otherwise("allow"))
    return judged.withColumn("verdict", verdict).drop(held)


def op10_url_filter(spark, sf_dir):
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages).select("page_id", "host", "path", "rule", "verdict")


OP10_SQL = f"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3)
                       ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id, row_number() OVER () AS rid,
         translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(rule, rhost, rpath, act) AS (VALUES
  {", ".join(f"('{r}', '{r[:r.index('/')]}', '{r[r.index('/'):]}', '{a}')" for r, a in RULES)}),
h(bad) AS (VALUES {", ".join(f"('{x}')" for x in HOSTS)}),
m AS (
  SELECT rid, arg_max(rule, length(rule)) AS rule, arg_max(act, length(rule)) AS act
  FROM p JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY rid)
SELECT page_id, host, path, m.rule,
       CASE WHEN m.rule IS NOT NULL THEN m.act
            WHEN EXISTS (SELECT 1 FROM h WHERE host = bad OR ends_with(host, '.' || bad))
            THEN 'block' ELSE 'allow' END AS verdict
FROM p LEFT JOIN m USING (rid)
"""
