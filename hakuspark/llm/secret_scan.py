"""Secret scans: fixed patterns, and character Markov models of random strings and of ordinary identifiers.

The patterns give base spans: `assign` (a key word, a sign and a value), `access` (AKIA keys) and `hex`. The method
adds `random`: a run of token characters that base spans don't cover wholly and whose log-likelihood ratio, under two
first-order character models, favours the model of random strings by MARGIN. Both are trained from labelled
samples: random strings made from digests, and ordinary words and identifiers. Everything is Spark expressions.

Positions are code points, end exclusive. A span's start is the length of the gaps and matches before it, as
split() and regexp_extract_all() give them in turn. All steps take time in proportion to a text and its spans.

Defined cases: a null text is an empty one; a text without spans has an empty list; an empty table has no rows (and
the models then know random strings and identifiers only); spans of equal start come in the order of kinds; equal
spans of two kinds are both given; repeated rows are each scanned; other columns are ignored. Texts are scanned whole.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hakuspark.functions.core import let, places
from hakuspark.llm.common import literal_rows, mask_of, masked, table, unmasked

# The base patterns. A run of [0-9a-f]+ of 16 or more characters is what {16,} finds; likewise AKIA.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
VALUE_CHARS = 12
KINDS = ["assign", "access", "hex", "random"]

CANDIDATE = r"[A-Za-z0-9_+/-]{20,}={0,2}"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_+/-="
MARGIN = 12.0
#: The ordinary sample: words of about so many distinct texts, drawn by a hash of the text, alone or as parts of
#: identifiers, and these identifiers.
SAMPLE_DOCS = 2_000
SAMPLE_RANDOM = 2_000
IDENTIFIERS = "getElementById addEventListener removeEventListener setRequestHeader hasOwnProperty toLocaleUpperCase createDocumentFragment internal_server_error connection_timeout_ms max_retry_count default_value_or_none user_profile_settings is_authenticated_user content_type_options last_modified_since ArrayIndexOutOfBoundsException IllegalArgumentException NullPointerException AbstractFactoryBuilder DocumentProcessingPipeline repartitionByRange monotonically_increasing_id application-configuration background-color-primary read-only-file-system utf8_to_utf16_converter sha256_file_checksum base64EncodedString http2_stream_identifier x86_64-unknown-linux-gnu float32_to_float64 ipv4_address_prefix page_2_of_17_results test_case_0042_retry build-2024-01-15-nightly"
_SPANS = "array<struct<kind:string,start:int,end:int>>"


def _spans(text: Column, kind: str, pattern: str, keep=None) -> Column:
    """Spans of the leftmost non-overlapping matches that keep() accepts."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), 0), F.split(text, pattern, -1)
    dots = lambda n: F.rpad(F.lit(""), n, ".")
    drawn = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda gap, hit: F.concat(dots(F.length(gap)), F.lit("<"), dots(F.length(hit) - 1)))
    span = lambda hit, start: F.struct(F.lit(kind).alias("kind"), start.cast("int").alias("start"), (start + F.length(hit)).cast("int").alias("end"), hit.alias("hit"))
    spans = F.zip_with(found, places(F.array_join(drawn, ""), "<"), span)
    kept = F.filter(spans, lambda s: keep(s["hit"])) if keep else spans
    return F.when(text.rlike(pattern), F.transform(kept, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))).otherwise(F.array().cast(_SPANS))


def covered(spans: Column, n: Column) -> Column:
    """For each of n characters whether a span holds it. Spans come by start, and those of a kind don't overlap."""

    def of(kind: str) -> Column:
        drawn = lambda all_: F.transform(all_, lambda s, i: F.concat(F.array_repeat(F.lit(False), s["start"] - F.coalesce(F.get(all_, i - 1)["end"], F.lit(0))), F.array_repeat(F.lit(True), s["end"] - s["start"])))
        rest = lambda all_: F.array_repeat(F.lit(False), n - F.coalesce(F.try_element_at(all_, F.lit(-1))["end"], F.lit(0)))
        return let(F.filter(spans, lambda s: s["kind"] == kind), lambda all_: F.concat(F.flatten(drawn(all_)), rest(all_)))

    return reduce(lambda a, b: F.zip_with(a, b, lambda x, y: x | y), map(of, KINDS))


def _ordered(spans: Column) -> Column:
    """By start, then by kind as listed."""
    rank = lambda s: F.array_position(F.lit(KINDS), s["kind"]).cast("int")
    return F.transform(F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), rank(s).alias("rank"), s["kind"].alias("kind"), s["end"].alias("end")))), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def base_spans(text: Column) -> Column:
    long_value = lambda hit: F.length(F.regexp_extract(hit, ASSIGN, 2)) >= VALUE_CHARS
    return _ordered(F.concat(_spans(text, "assign", ASSIGN, long_value), _spans(text, "access", ACCESS), _spans(text, "hex", HEX)))


def labelled_samples(docs: DataFrame, text: str = "text", sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """Rows of token and is_random: digests in three notations; words of a bounded sample of docs, and identifiers."""
    spark, texts = docs.sparkSession, docs.select(F.col(text).alias("t"), F.xxhash64(text).alias("h"))
    n = texts.select("h").distinct().count()
    digest = F.unhex(F.sha2(F.col("id").cast("string"), 256))
    random = spark.range(SAMPLE_RANDOM).select(F.explode(F.array(F.rtrim(F.base64(digest), F.lit("=")), F.lower(F.hex(digest)), F.translate(F.base64(digest), "abcdefghijklmnopqrstuvwxyz+/=", "ABCDEFGHIJKLMNOPQRSTUVWXYZ89"))).alias("token"), F.lit(True).alias("is_random"))
    drawn = texts.where(F.pmod("h", F.lit(1_000_003)) < min(1.0, sample_docs / max(n, 1)) * 1_000_003).groupBy("h").agg(F.min("t").alias("t"))
    # Words stand alone, or twice as the parts of identifiers do: with a sign between, or each with a capital.
    words = drawn.select(F.explode(F.regexp_extract_all("t", F.lit("[A-Za-z]{4,}"), 0)).alias("w"))
    style, capital = F.pmod(F.xxhash64("w"), F.lit(4)), F.initcap("w")
    joined = F.when(style == 0, F.col("w")).when(style == 1, F.concat_ws("_", "w", "w")).when(style == 2, F.concat_ws("-", "w", "w")).otherwise(F.concat(capital, capital))
    words = words.select(joined.alias("token"), F.lit(False).alias("is_random"))
    names = literal_rows(spark, ["token", "is_random"], [(x, False) for x in IDENTIFIERS.split()])
    return random.unionByName(words).unionByName(names)


def fit(samples: DataFrame) -> list[float]:
    """The log-likelihood ratio of each character after each other (0: at the start), row by row.

    Pair counts cover all samples; at most 2 * 68 * 67 of them come to the driver.
    """
    chars = F.concat(F.array(F.lit("")), F.split("token", ""))
    pairs = samples.select("is_random", F.explode(F.transform(F.sequence(F.lit(1), F.size(chars) - 1), lambda i: F.struct(F.get(chars, i - 1).alias("a"), F.get(chars, i).alias("b")))).alias("p"))
    code = lambda c: F.when(c == "", 0).otherwise(F.instr(F.lit(ALPHABET), c))
    counts: dict[tuple[bool, int, int], int] = {}
    for r in pairs.select("is_random", code(F.col("p.a")).alias("a"), code(F.col("p.b")).alias("b")).where("b > 0").groupBy("is_random", "a", "b").agg(F.count("*").alias("n")).collect():
        counts[r["is_random"], r["a"], r["b"]] = r["n"]
    size, out = len(ALPHABET), []
    rows = {(k, a): sum(counts.get((k, a, b), 0) for b in range(1, size + 1)) for k in (True, False) for a in range(size + 1)}
    for a in range(size + 1):
        for b in range(1, size + 1):
            p = [(counts.get((k, a, b), 0) + 0.5) / (rows[k, a] + 0.5 * size) for k in (True, False)]
            out.append(round(math.log(p[0] / p[1]), 4))
    return out


def ratio(token: Column, model: list[float]) -> Column:
    """Log-likelihood ratio of a token: above 0, it looks random."""
    table_ = F.split(F.lit(",".join(map(str, model))), ",").cast("array<double>")
    codes = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    add = lambda acc, b: F.struct(F.when(b > 0, acc["s"] + F.coalesce(F.get(table_, acc["a"] * len(ALPHABET) + b - 1), F.lit(0.0))).otherwise(acc["s"]).alias("s"), b.alias("a"))
    return F.aggregate(codes, F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("a")), add, lambda acc: acc["s"])


def find_secrets(docs: DataFrame, model: list[float] | None = None, text: str = "text") -> DataFrame:
    """docs with the column `secrets` (in place of one of that name): base and random spans in order. The model is fitted on docs if none is given."""
    model = fit(labelled_samples(docs, text)) if model is None else model
    whole = F.coalesce(F.col(text), F.lit(""))
    based = docs.withColumn("secrets", base_spans(whole))
    found = _spans(whole, "random", CANDIDATE, lambda hit: ratio(hit, model) > MARGIN)
    held = F.when(F.size(found) > 0, covered(F.col("secrets"), F.length(whole)))
    free = let(held, lambda flags: F.filter(found, lambda s: F.exists(F.slice(flags, s["start"] + 1, s["end"] - s["start"]), lambda x: ~x)))
    return based.withColumn("secrets", F.when(F.size(found) > 0, _ordered(F.concat("secrets", free))).otherwise(F.col("secrets")))


def redact(docs: DataFrame, model: list[float] | None = None, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with each run of characters that spans hold replaced by a mark; null texts stay null."""
    name = mask_of(docs, text)
    found, whole = find_secrets(masked(docs), model, name), F.col(name)
    left = lambda flags: F.transform(F.split(whole, ""), lambda c, i: F.when(~F.get(flags, i), c).when(F.coalesce(F.get(flags, i - 1), F.lit(False)), "").otherwise(mark))
    clean = let(covered(F.col("secrets"), F.length(whole)), lambda flags: F.array_join(left(flags), ""))
    return unmasked(found.withColumn(name, F.when(F.size("secrets") > 0, clean).otherwise(whole)), docs)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    n = lambda k: F.size(F.filter("secrets", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("secrets", lambda s: s["kind"] != "random")
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("secrets")).alias("spans"))


QUERIES = {"op6_secret_scan": op6_secret_scan}
ORACLES: dict[str, str] = {}
