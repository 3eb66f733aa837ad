"""URL filters: host and path rules, looked up in a cascade of Bloom filters.

A rule is a host and a path prefix. The keys of a URL are the pairs of a suffix of its host and a prefix of its
path that a rule of that shape could equal: as many labels and as long a path as some rule has. All keys of the
corpus make up the universe. Level 1 of a cascade encodes the universe's listed keys; level 2 those keys of the
universe that level 1 holds wrongly; level 3 the listed keys that level 2 holds wrongly; and so on until nothing
is held wrongly. A key is listed if the first level that lacks it is an even one. That is exact for every key of
the universe, and each URL is judged by reading bits: no join.

Level 1 gets as many bits a key as it takes to hold no more keys wrongly than are listed, however large the
universe. So all levels together grow with the list, which the driver holds anyway, and with the logarithm of the
universe: about 10 to 60 bits for each listed key that the corpus has.

There is one cascade for each action. Of the rules that fit, the longest decides (host and path together).

Cases: a null URL and one without ``://`` have an empty host and path and no rule; so has an empty host. Host
labels are compared as they stand, a port included. A rule's path must be a prefix of the URL's path, so a rule
for ``/`` does not fit an empty path. URLs without a rule get ``default``. Repeated rows are judged one by one.
Columns named like the results are replaced, all others passed through.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, materialize, others, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The share of keys that a level holds wrongly, and its most hash functions.
WRONG, HASHES = 0.01, 24
MOST_LEVELS = 64


@dataclass(frozen=True)
class Rule:
    action: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))


def host_and_path(url: F.Column) -> tuple[F.Column, F.Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def url_keys(host: F.Column, path: F.Column, shapes: Sequence[tuple[int, int]]) -> F.Column:
    """The keys of one URL, in order: an array of strings.

    ``shapes``: (labels of the host, characters of the path) of the rules.
    """
    labels = F.size(F.split(host, "\\.", -1))
    keys = []
    for n, k in shapes:
        suffix = F.substring_index(host, ".", -n)
        keys.append(F.when((host != "") & (labels >= n) & (F.length(path) >= k), F.concat(suffix, F.substring(path, 1, k))))
    return F.sort_array(F.array_compact(F.array(*keys))) if keys else F.array().cast("array<string>")


def _literal(values: Sequence, kind: str) -> F.Column:
    """An array literal of any length, sent as one text and read when the plan is optimised."""
    return F.from_json(F.lit(json.dumps(list(values))), f"array<{kind}>")


class Bloom:
    """A Bloom filter whose bits are one array literal of longs."""

    def __init__(self, keys: DataFrame, n: int, wrong: float, level: int) -> None:
        """``keys``: one string column of ``n`` distinct keys; ``wrong``: the share of others that it may hold."""
        self.hashes = max(1, min(HASHES, round(math.log2(1 / wrong))))
        # With h hashes, m bits hold a share (1 - exp(-h * n / m)) ** h of all other keys.
        self.bits = max(64, math.ceil(-self.hashes * n / math.log1p(-(wrong ** (1 / self.hashes))) / 64) * 64)
        self.level = level
        spots = keys.select(F.explode(self._spots(F.col(keys.columns[0]))).alias("spot"))
        grouped = spots.groupBy(F.shiftright("spot", 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("spot", F.lit(64)).cast("int"))).alias("bits"))
        words = [0] * (self.bits // 64)
        for x in grouped.toLocalIterator():  # of listed keys or about as many: no more than the rules in memory
            words[x.word] = x.bits
        self.words = _literal(words, "bigint")

    def _spots(self, key: F.Column) -> F.Column:
        """Double hashing; the second hash is odd."""
        first, second = F.xxhash64(key, F.lit(2 * self.level)), F.xxhash64(key, F.lit(2 * self.level + 1)).bitwiseOR(F.lit(1))
        both = F.transform(F.array(F.struct(first.alias("a"), second.alias("b"))), lambda h: F.transform(F.sequence(F.lit(0), F.lit(self.hashes - 1)), lambda i: F.pmod(F.pmod(h["a"], F.lit(self.bits)) + i * F.pmod(h["b"], F.lit(self.bits)), F.lit(self.bits))))
        return F.flatten(both)

    def holds(self, key: F.Column) -> F.Column:
        return F.forall(self._spots(key), lambda spot: F.getbit(F.get(self.words, F.shiftright(spot, 6).cast("int")), F.pmod(spot, F.lit(64)).cast("int")) == 1)


class Cascade:
    """Exact membership in ``listed`` for every key of ``universe``."""

    def __init__(self, universe: DataFrame, listed: DataFrame) -> None:
        """Both: one column ``key``. Listed keys outside the universe are not encoded: nothing asks for them."""
        universe = universe.select("key").distinct()
        inside = universe.join(listed.select("key").distinct(), "key", "left_semi")
        outside = universe.join(listed.select("key").distinct(), "key", "left_anti")
        self.levels: list[Bloom] = []
        encode, wrong = inside, outside
        n, rest = encode.count(), wrong.count()
        while n:
            if len(self.levels) >= MOST_LEVELS:
                raise RuntimeError("the cascade does not end")
            level = Bloom(encode, n, min(WRONG, n / max(1, rest)), len(self.levels) + 1)
            self.levels.append(level)
            encode, wrong = materialize(wrong.where(level.holds(F.col("key"))), "held"), encode
            n, rest = encode.count(), n

    def holds(self, key: F.Column) -> F.Column:
        out = F.lit(len(self.levels) % 2 == 1)
        for i in reversed(range(len(self.levels))):
            out = F.when(self.levels[i].holds(key), out).otherwise(F.lit(i % 2 == 1))
        return out


def _fitting(keys: F.Column, cascade: Cascade, action: str) -> F.Column:
    """The listed keys as structs that sort by length."""
    listed = F.filter(keys, cascade.holds)
    return F.transform(listed, lambda k: F.struct(F.length(k).alias("length"), k.alias("rule"), F.lit(action).alias("action")))


def filter_urls(pages: DataFrame, rules: Sequence[Rule] = RULES, default: str = "allow") -> DataFrame:
    """``pages`` (url, ...) with host, path, rule and verdict.

    The list of rules may be long: a plan holds its filters, not its rules, and rules are read back from the key.
    """
    own = others(pages.columns, "host", "path", "rule", "verdict")
    host, path = host_and_path(F.col("url"))
    split = pages.select(F.struct(*map(column, own)).alias("own"), host.alias("host"), path.alias("path"))
    shapes = sorted({(r.host.count(".") + 1, len(r.path)) for r in rules})
    keys = url_keys(F.col("host"), F.col("path"), shapes)
    universe = materialize(split.select(F.explode(keys).alias("key")).distinct(), "urls")
    actions = {r.text: r.action for r in rules}  # of rules for one text, the last counts
    found = []
    for action in sorted(set(actions.values())):
        listed = pages.sparkSession.range(1).select(F.explode(_literal([k for k, a in actions.items() if a == action], "string")).alias("key"))
        found.append(_fitting(keys, Cascade(universe, listed), action))
    best = F.array_max(F.concat(*found) if len(found) > 1 else found[0]) if found else F.expr("cast(null as struct<length:int,rule:string,action:string>)")
    judged = split.withColumn("best", best)
    return judged.select(*(F.col("own")[c].alias(c) for c in own), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"))


def query(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages).select("page_id", "host", "path", "rule", "verdict")


ORACLE = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), split AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), rules(action, rule_host, rule_path) AS (
  VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')
), fits AS (
  SELECT page_id, rule_host || rule_path AS rule, action, row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC) AS n
  FROM split JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
)
SELECT s.page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM split s LEFT JOIN fits f ON f.page_id = s.page_id AND f.n = 1
"""
