"""URL filters (1): longest-prefix rules, then exact list membership by a Bloom filter cascade.

Level 0 is a Bloom filter of the listed keys.  Over the corpus's complete key universe, the unlisted keys that pass
it by mistake are known; level 1 encodes just those, level 2 the listed keys that pass level 1 by mistake, and so on
until a level has no mistakes left.  A key of the universe is decided by the first level that does not hold it, so
the answer is exact, and pages are judged in the scan without a join.

Everything is DataFrame expressions: positions from xxhash64, words by ``bit_or``, tests by ``getbit`` on an array
read once through a scalar subquery.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

BITS_PER_KEY, HASHES, MAX_LEVELS = 12, 6, 40
#: A cascade is sent to every task only up to this size; a larger list is matched by a shuffled join instead.
MAX_FILTER_BYTES = 64 << 20

#: The given rules: (host, path prefix, verdict).
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
         ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or no ``://``."""
    host = F.regexp_extract(_after_scheme(url), "^[^/?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty for null or no ``://``."""
    return F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule string or null, verdict or null) of the longest rule that fits; equal lengths: the first listed."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    shortest_first = sorted(reversed(rules), key=lambda r: len(r[0] + r[1]))  # a later one overrides
    for h, p, v in shortest_first:
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def _positions(key: Column, level: int, bits: int) -> list[Column]:
    first = F.pmod(F.xxhash64(F.lit(level), key), F.lit(bits))
    step = F.pmod(F.xxhash64(key, F.lit(level)), F.lit(bits - 1)) + 1
    return [F.pmod(first + i * step, F.lit(bits)) for i in range(HASHES)]


def _bits_for(keys: int) -> int:
    return 64 * max(1, -(-keys * BITS_PER_KEY // 64))


def _filter_row(keys: DataFrame, level: int, bits: int) -> DataFrame:
    """One row holding the filter's 64-bit words in order; its size is ``bits / 8`` bytes, checked by the caller."""
    at = keys.select(F.explode(F.array(*_positions(F.col("key"), level, bits))).alias("at"))
    words = (at.groupBy(F.floor(F.col("at") / 64).cast("int").alias("i"))
             .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("at", F.lit(64)).cast("int"))).alias("word")))
    filled = (keys.sparkSession.range(bits // 64).select(F.col("id").cast("int").alias("i")).join(words, "i", "left")
              .select("i", F.coalesce("word", F.lit(0).cast("long")).alias("word")))
    return filled.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))),
                                  lambda x: x["word"]).alias("words"))


def _holds(words: Column, key: Column, level: int, bits: int) -> Column:
    hit = F.lit(True)
    for at in _positions(key, level, bits):
        word = F.get(words, F.floor(at / 64).cast("int"))
        hit = hit & (F.getbit(word, F.pmod(at, F.lit(64)).cast("int")) == 1)
    return hit


class BloomCascade:
    """Membership filter that is exact for the keys of the universe it was built over."""

    def __init__(self, levels: list[tuple[DataFrame, int]]):
        self.levels = levels

    @property
    def bytes(self) -> int:
        return sum(bits // 8 for _, bits in self.levels)

    def contains(self, key: Column) -> Column:
        """Whether a key of the universe is listed: odd levels hold mistakes, so the first miss decides."""
        # past the last level no mistake is left: the last level's own kind is the answer
        answer = F.lit(len(self.levels) % 2 == 1)
        for i, (row, bits) in reversed(list(enumerate(self.levels))):
            answer = F.when(_holds(row.scalar(), key, i, bits), answer).otherwise(F.lit(i % 2 == 1))
        return answer


def build_cascade(universe: DataFrame, listed: DataFrame, max_bytes: int = MAX_FILTER_BYTES) -> BloomCascade | None:
    """Cascade for the distinct, non-null ``key`` values of ``universe`` and ``listed``; None if over ``max_bytes``.

    Each level tests only the keys that the one before let through by mistake, so the work shrinks level by level.
    Listed keys outside the universe are left out; an empty list gives a cascade that holds nothing.
    """
    marks = (universe.select("key", F.lit(0).alias("listed")).union(listed.select("key", F.lit(1).alias("listed")))
             .where(F.col("key").isNotNull()).groupBy("key")
             .agg(F.max("listed").alias("listed"), F.min("listed").alias("outside")).where("outside = 0"))
    marks = materialize(marks.select("key", (F.col("listed") == 1).alias("listed")), "keys")
    encoded, tested = marks.where("listed").select("key"), marks.where("not listed").select("key")
    levels: list[tuple[DataFrame, int]] = []
    used = 0
    while (n := encoded.count()) > 0:
        if len(levels) == MAX_LEVELS:
            raise RuntimeError("the cascade did not end")
        bits = _bits_for(n)
        used += bits // 8
        if used > max_bytes:
            return None
        row = materialize(_filter_row(encoded, len(levels), bits), "filter")
        mistakes = materialize(tested.where(_holds(row.scalar(), F.col("key"), len(levels), bits)), "mistakes")
        levels.append((row, bits))
        encoded, tested = mistakes, encoded
    return BloomCascade(levels)


def judge_urls(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]] = RULES,
               max_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """``pages`` with host, path, rule, listed and verdict (allow or block) as the only added columns.

    ``listed`` has a column ``key`` of hosts to block.  A fitting rule decides; otherwise a listed host is blocked
    and any other allowed.  A null url has empty host and path, fits no rule and is allowed unless '' is listed.
    Existing columns of these names are replaced; repeated rows stay.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rule, given = rule_of(F.col("host"), F.col("path"), rules)
    parsed = pages.withColumns({"host": host, "path": path})
    hosts = parsed.select(F.col("host").alias("key")).distinct()
    cascade = build_cascade(hosts, listed, max_bytes)
    if cascade is None:  # too large a list for every task: shuffled join on the host, split by AQE if a host is hot
        keys = listed.select(F.col("key").alias("__key")).distinct().withColumn("__listed", F.lit(True))
        parsed = parsed.join(keys, parsed["host"] == keys["__key"], "left")
        member = F.coalesce("__listed", F.lit(False))
    else:
        member = cascade.contains(F.col("host"))
    out = parsed.withColumn("listed", member).withColumns({"rule": rule})
    verdict = F.coalesce(given, F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow")))
    return out.withColumn("verdict", verdict).drop("__key", "__listed")
