"""URL filters: a blocked Bloom filter of listed canonical URLs, then an exact hash join.

Every distinct URL yields the canonical keys under which a rule could list it: host suffixes with path prefixes, only
of the label counts and path lengths that rules have. Keys whose eight bits are set in their block of the filter, and
no others, go on to an exact join with the rules, which removes false positives. The longest rule that fits decides;
what is decided is joined back to the rows, and all others get the default verdict.

The filter is probed where keys are made, if it takes at most FILTER_BYTES. That of a longer list is a table of
blocks, which the distinct keys are joined with, and the rules of the keys that pass take the place of the list.

Defined cases: a null URL, or one without ``://``, has an empty host and path and fits no rule; repeated rows are
each judged; an empty list leaves the default verdict; if one host and path is listed twice, the smaller verdict
holds; very long URLs yield keys of the listed lengths only; other columns of the input are ignored.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hakuspark.llm.common import BROADCAST_ROWS, literal_rows, stored, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (host, path, verdict) of the registered query.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
WORDS = 8
BITS_PER_KEY = 16
#: What may be broadcast besides BROADCAST_ROWS: characters of rules or URLs, and bytes of the filter.
BROADCAST_CHARS = 16_000_000
FILTER_BYTES = 8_000_000


def host_of(url: Column) -> Column:
    rest = _after_scheme(url)
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    rest = _after_scheme(url)
    return F.regexp_extract(F.regexp_replace(rest, "^[^/?#]*", ""), "^[^?#]*", 0)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def _bits(host: Column, path: Column) -> list[Column]:
    """The word that a key sets in each of the eight words of its block."""
    h = F.xxhash64(F.lit(1), host, path)
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(63).cast("int")) for i in range(WORDS)]


def _block(host: Column, path: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(0), host, path), F.lit(blocks))


def bloom_blocks(rules: DataFrame, blocks: int) -> DataFrame:
    """One row a block: its number and eight 64-bit words. Built with partial OR before any shuffle."""
    bits = rules.select(_block(F.col("r_host"), F.col("r_path"), blocks).alias("b_block"), *(b.alias(f"_w{i}") for i, b in enumerate(_bits(F.col("r_host"), F.col("r_path")))))
    return bits.groupBy("b_block").agg(*(F.bit_or(f"_w{i}").alias(f"b_{i}") for i in range(WORDS)))


def candidate_keys(host: Column, path: Column, shapes: list[tuple[int, int]]) -> Column:
    """(k_host, k_path) for every (dots in the host, length of the path) of shapes that a URL has."""
    lengths = [sorted(n for d, n in shapes if d == dots) for dots in range(max(d for d, _ in shapes) + 1)]
    table_ = F.from_json(F.lit(json.dumps(lengths)), "array<array<int>>")
    dots = F.least(F.length(host) - F.length(F.replace(host, F.lit("."))), F.lit(len(lengths) - 1))

    def of_suffix(d: Column) -> Column:
        suffix = F.call_function("substring_index", host, F.lit("."), -(d + 1))
        fitting = F.filter(F.element_at(table_, d + 1), lambda n: n <= F.length(path))
        return F.transform(fitting, lambda n: F.struct(suffix.alias("k_host"), F.substring(path, F.lit(1), n).alias("k_path")))

    return F.flatten(F.transform(F.sequence(F.lit(0), dots), of_suffix))


def _passes(words: list[Column]) -> Column:
    """Whether a key's bits are all set in the words of its block."""
    bits = _bits(F.col("k_host"), F.col("k_path"))
    return reduce(lambda a, b: a & b, (w.bitwiseAND(b) == b for w, b in zip(words, bits)))


def possible_hits(keys: DataFrame, listed: DataFrame, blocks: int) -> tuple[DataFrame, DataFrame]:
    """The rows of keys that the filter of listed lets pass, and the rules that they can hit."""
    bloom, at = bloom_blocks(listed, blocks), _block(F.col("k_host"), F.col("k_path"), blocks)
    if blocks * WORDS * 8 <= FILTER_BYTES:
        words = F.struct(*(F.coalesce(f"b_{i}", F.lit(0).cast("long")).alias(f"b_{i}") for i in range(WORDS)))
        whole = keys.sparkSession.range(blocks).join(bloom, F.col("id") == F.col("b_block"), "left").select("id", words.alias("w"))
        array = whole.agg(F.array_sort(F.collect_list(F.struct("id", "w"))).alias("f")).scalar()
        block = F.get(array, at.cast("int"))["w"]
        return keys.where(_passes([block[f"b_{i}"] for i in range(WORDS)])), listed
    distinct = keys.select("k_host", "k_path").distinct().withColumn("_at", at)
    passed = distinct.join(bloom, F.col("_at") == F.col("b_block")).where(_passes([F.col(f"b_{i}") for i in range(WORDS)]))
    hit = listed.join(passed.select("k_host", "k_path"), (F.col("r_host") == F.col("k_host")) & (F.col("r_path") == F.col("k_path")), "left_semi")
    return keys, stored(hit, "rules")


def _near(df: DataFrame, *texts: str) -> DataFrame:
    """df, marked for broadcast if it is small in rows and characters."""
    facts = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(sum((F.length(t) for t in texts), F.lit(0))), F.lit(0)).alias("chars")).first()
    return F.broadcast(df) if facts["n"] <= BROADCAST_ROWS and facts["chars"] <= BROADCAST_CHARS else df


def judge_urls(urls: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """Return key, host, path, rule and verdict for every row of urls; rules has host, path and verdict.

    Rules, and decided URLs, are broadcast only up to BROADCAST_ROWS and BROADCAST_CHARS; beyond, both sides of a join
    are shuffled.
    """
    given = rules.where("host is not null and path is not null").groupBy(F.translate("host", UPPER, LOWER).alias("r_host"), F.col("path").alias("r_path")).agg(F.min("verdict").alias("r_verdict"))
    listed = stored(given, "rules")
    dots = F.length("r_host") - F.length(F.replace(F.col("r_host"), F.lit(".")))
    facts = listed.agg(F.count("*").alias("n"), F.collect_set(F.struct(dots.alias("d"), F.length("r_path").alias("n"))).alias("shapes")).first()
    pages = urls.select(F.col(key).alias("_key"), F.coalesce(host_of(F.col(url)), F.lit("")).alias("_host"), F.coalesce(path_of(F.col(url)), F.lit("")).alias("_path"))
    if not facts["n"]:
        return pages.select(F.col("_key").alias(key), F.col("_host").alias("host"), F.col("_path").alias("path"), F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    keys = pages.select("_host", "_path").distinct().select("_host", "_path", F.explode(candidate_keys(F.col("_host"), F.col("_path"), [tuple(s) for s in facts["shapes"]])).alias("k"))
    blocks = max(1, facts["n"] * BITS_PER_KEY // (64 * WORDS))
    possible, listed = possible_hits(keys.select("_host", "_path", "k.*"), listed, blocks)
    fit = possible.join(_near(listed, "r_host", "r_path"), (F.col("k_host") == F.col("r_host")) & (F.col("k_path") == F.col("r_path")))
    best = F.max(F.struct((F.length("r_host") + F.length("r_path")).alias("n"), F.length("r_host").alias("h"), "r_host", "r_path", "r_verdict")).alias("_best")
    decided = stored(fit.groupBy(F.col("_host").alias("d_host"), F.col("_path").alias("d_path")).agg(best).select("d_host", "d_path", F.concat("_best.r_host", "_best.r_path").alias("rule"), F.col("_best.r_verdict").alias("_verdict")), "decided")
    judged = pages.join(_near(decided, "d_host", "d_path"), (F.col("_host") == F.col("d_host")) & (F.col("_path") == F.col("d_path")), "left")
    return judged.select(F.col("_key").alias(key), F.col("_host").alias("host"), F.col("_path").alias("path"), "rule", F.coalesce("_verdict", F.lit(default)).alias("verdict"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), literal_rows(spark, ["host", "path", "verdict"], RULES))


_CASES = " ".join(f"when {'true' if h == '*' else f"(host = '{h}' or ends_with(host, '.{h}'))"} and starts_with(path, '{p}') then {{{i}}}" for i, (h, p, _) in sorted(enumerate(RULES), key=lambda x: -len(x[1][0] + x[1][1])))
ORACLE_SQL = f"""
with cut as (
  select page_id, case when url is null or strpos(url, '://') = 0 then '' else substr(url, strpos(url, '://') + 3) end as rest from pages
), parts as (
  select page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') as host,
         regexp_extract(regexp_replace(rest, '^[^/?#]*', ''), '^[^?#]*') as path from cut
)
select page_id, host, path,
       case {_CASES.format(*(f"'{h}{p}'" for h, p, _ in RULES))} end as rule,
       case {_CASES.format(*(f"'{v}'" for _, _, v in RULES))} else 'allow' end as verdict
from parts
"""

QUERIES = {"op5_url_filter": op5_url_filter}
ORACLES = {"op5_url_filter": ORACLE_SQL}
