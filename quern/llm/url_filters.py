"""URL filtering by Bloom filter cascades, in DataFrame functions alone.

A cascade answers exactly whether a key is in a list, for every key of a known universe. Level 0 encodes the
listed keys; level 1 the universe's other keys that level 0 lets through; level 2 the listed keys that level 1
lets through; and so on until nothing passes wrongly. A key's first refusing level gives the answer, so judging
a url takes a few bit tests on constants and no join.

The universe is every (host suffix, path prefix) key that any url of the table can ask about, so the answers
are exact for the whole table. Level 0's rate is chosen from the universe's size, which keeps every later level
no larger than the list itself: the filters grow with the list and the logarithm of the universe.

Defined results: a null url, or one without ``://``, has an empty host and path, fits no rule and is allowed;
an empty table gives no rows; repeated rows are judged alike; further columns are ignored. A key listed as both
allow and block counts as block.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.session import materialize

#: Keys that differ in hash come apart after a few levels, each halving what is left; more than this is a fault.
LEVELS = 200
#: Listed keys up to so many characters are broadcast; more are joined by shuffle.
BROADCAST_CHARS = 8_000_000
#: Filters up to so many bits are constants of the plan; a larger list is refused.
MOST_BITS = 64_000_000
#: Stands between listed keys; no key holds it.
SEPARATOR = "\x00"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str  # allow or block

    @property
    def key(self) -> str:
        return self.host + self.path


RULES = (
    Rule("com", "/", "allow"),
    Rule("example.com", "/en/", "block"),
    Rule("www.example.com", "/en/", "allow"),
    Rule("net", "/es/", "block"),
    Rule("net", "/fr/", "block"),
)


def url_host(url: Column) -> Column:
    at = F.locate("://", url)
    rest = F.substring(url, at + F.lit(3), F.length(url))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return F.when(at > 0, host).otherwise(F.lit(""))


def url_path(url: Column) -> Column:
    at = F.locate("://", url)
    rest = F.substring(url, at + F.lit(3), F.length(url))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.when(at > 0, path).otherwise(F.lit(""))


def rule_keys(host: Column, path: Column, rules) -> Column:
    """Every key under which a rule could fit, longest first: at most (labels of a rule) x (rule path lengths)."""
    most = max((r.host.count(".") + 1 for r in rules), default=1)
    lengths = sorted({len(r.path) for r in rules})
    labels = F.split(host, r"\.", -1)
    n = F.size(labels)
    tails = F.transform(
        F.sequence(F.lit(1), F.least(n, F.lit(most))), lambda i: F.array_join(F.slice(labels, n - i + 1, i), ".")
    )
    ends = F.array(*[F.when(F.length(path) >= k, F.substring(path, 1, k)) for k in lengths]) if lengths else F.array()
    ends = F.filter(ends, lambda e: e.isNotNull())
    keys = F.flatten(F.transform(tails, lambda t: F.transform(ends, lambda e: F.concat(t, e))))
    # longest first; of equally long ones the one with the longer host, that is the shorter path
    return F.array_sort(
        keys,
        lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).otherwise(
            F.locate("/", b) - F.locate("/", a)
        ),
    )


@dataclass(frozen=True)
class Level:
    seed: int
    bits: int
    hashes: int
    words: tuple[int, ...]

    def positions(self, key: Column) -> list[Column]:
        one = F.pmod(F.xxhash64(F.lit(self.seed), key), F.lit(self.bits))
        two = F.pmod(F.xxhash64(key, F.lit(self.seed + 1)), F.lit(self.bits))
        return [F.pmod(one + two * F.lit(i) + F.lit(i * i), F.lit(self.bits)) for i in range(self.hashes)]

    def may_contain(self, key: Column) -> Column:
        held = F.split(F.lit(",".join(map(str, self.words))), ",").cast("array<bigint>")  # folded to a constant, at most MOST_BITS
        hit = F.lit(True)
        for p in self.positions(key):
            word = F.element_at(held, (F.floor(p / 64) + 1).cast("int"))
            hit = hit & (F.getbit(word, (p % 64).cast("int")) == 1)
        return hit


def encode(keys: DataFrame, count: int, rate: float, seed: int) -> Level:
    """A Bloom filter of the frame's one column; the words brought to the driver are bits/64, set by count."""
    bits = max(64, 64 * math.ceil(count * math.log2(1 / rate) / math.log(2) / 64))
    if bits > MOST_BITS:
        raise ValueError(f"a filter of {bits} bits is over {MOST_BITS}: split the list")
    hashes = max(1, round(math.log2(1 / rate)))
    empty = Level(seed, bits, hashes, ())
    set_bits = keys.select(F.explode(F.array(*empty.positions(F.col(keys.columns[0])))).alias("p"))
    words = set_bits.groupBy(F.floor(F.col("p") / 64).cast("int").alias("w")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("b")
    )
    held = {r.w: r.b for r in words.collect()}
    return Level(seed, bits, hashes, tuple(held.get(i, 0) for i in range(bits // 64)))


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Level, ...]

    def contains(self, key: Column) -> Column:
        """Exact for every key of the universe that the cascade was built over."""
        answer = F.lit(len(self.levels) % 2 == 1)
        for i, level in reversed(list(enumerate(self.levels))):
            answer = F.when(~level.may_contain(key), F.lit(i % 2 == 1)).otherwise(answer)
        return answer


def build_cascade(universe: DataFrame, size: int, listed: list[str], seed: int = 0) -> Cascade:
    """universe: one column of keys, repeats allowed; size: about how many differ; listed: the keys to hold."""
    spark, listed = universe.sparkSession, sorted(set(listed))
    if any(SEPARATOR in x for x in listed):
        raise ValueError("a listed key holds the separator")
    if not listed:
        return Cascade(())
    key = F.col(universe.columns[0])
    text = SEPARATOR.join(listed)
    table = spark.range(1).select(F.explode(F.split(F.lit(text), SEPARATOR)).alias("key"))  # one constant, however many keys
    rate = min(0.5, len(listed) * math.sqrt(0.5) / max(size, 1))
    levels = [encode(table, len(listed), rate, seed)]
    # what passes level 0 wrongly: about as many keys as are listed, whatever the universe's size
    wrong = universe.where(levels[0].may_contain(key)).select(key.alias("key")).distinct()
    held = F.broadcast(table) if len(text) <= BROADCAST_CHARS else table
    wrong = materialize(wrong.join(held, "key", "left_anti"), "cascade")
    inside, outside = table, wrong
    while n := outside.count():
        if len(levels) == LEVELS:
            raise RuntimeError(f"{n} keys still pass wrongly after {LEVELS} levels")
        levels.append(encode(outside, n, 0.5, seed + 2 * len(levels)))
        inside, outside = outside, inside.where(levels[-1].may_contain(F.col("key")))
    return Cascade(tuple(levels))


def judge_urls(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id_col, host, path, rule, verdict for every row of pages."""
    rows = pages.select(F.col(id_col).alias(id_col), F.col(url_col).alias("_u"))
    rows = rows.select(id_col, url_host(F.col("_u")).alias("host"), url_path(F.col("_u")).alias("path"))
    keyed = rows.withColumn("_keys", rule_keys(F.col("host"), F.col("path"), rules))
    universe = keyed.select(F.explode("_keys").alias("key"))
    size = universe.agg(F.approx_count_distinct("key")).first()[0]
    blocked = build_cascade(universe, size, [r.key for r in rules if r.verdict == "block"], seed=1_000)
    allowed = build_cascade(universe, size, [r.key for r in rules if r.verdict == "allow"], seed=2_000)
    fits = F.filter("_keys", lambda k: blocked.contains(k) | allowed.contains(k))
    judged = keyed.withColumn("rule", F.get(fits, F.lit(0)))
    return judged.select(
        id_col,
        "host",
        "path",
        "rule",
        F.when(F.col("rule").isNotNull() & blocked.contains(F.col("rule")), "block").otherwise("allow").alias("verdict"),
    )


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN NULL
                       ELSE substr(url, strpos(url, '://') + 3) END AS rest FROM pages
), p AS (
  SELECT page_id,
    CASE WHEN rest IS NULL THEN '' ELSE translate(regexp_extract(rest, '^[^/?#]*'),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END AS host,
    CASE WHEN rest IS NULL THEN '' ELSE regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) END AS path
  FROM u
), rules(rhost, rpath, v) AS (VALUES
  ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
  ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), best AS (
  SELECT page_id, rank_key, v FROM (
    SELECT p.page_id, rhost || rpath AS rank_key, v,
      row_number() OVER (PARTITION BY p.page_id ORDER BY length(rhost || rpath) DESC) AS rn
    FROM p JOIN rules ON (p.host = rhost OR ends_with(p.host, '.' || rhost)) AND starts_with(p.path, rpath)
  ) WHERE rn = 1
)
SELECT p.page_id, p.host, p.path, best.rank_key AS rule, coalesce(best.v, 'allow') AS verdict
FROM p LEFT JOIN best ON p.page_id = best.page_id
"""
