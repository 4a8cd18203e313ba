"""The Markov models on tokens they have not seen, the added spans against a plain walk, and texts of very many spans."""

import random
import re
import string
import time

import pytest
from pyspark.sql import functions as F

from hakuspark.llm import secret_scan
from tests.llm.test_ops import base

WORDS = "account active address array async batch buffer cache client column config context counter cursor data default device encode error event fetch field filter format group handler header index input item json kernel label length limit list lock logger manager message method model module network number object offset option output packet page param parser path pointer pool port process query queue random reader record region request result retry route sample schema server session setting signal size socket source state status stream string table target task thread time token tree update upload user value vector version view window worker writer".split()
ALPHABETS = [string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_uppercase + string.digits, string.ascii_lowercase + string.digits, string.hexdigits.lower()[:16]]


@pytest.fixture(scope="module")
def model(spark):
    return secret_scan.fit(secret_scan.labelled_samples(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")))


def plain_ratio(token, model):
    total, before = 0.0, 0
    for c in token:
        at = secret_scan.ALPHABET.find(c) + 1
        if at:
            total += model[before * len(secret_scan.ALPHABET) + at - 1]
        before = at
    return total


def identifier(r):
    words = [r.choice(WORDS) for _ in range(r.randint(3, 6))]
    style = r.randint(0, 3)
    joined = "_".join(words) if style == 0 else "".join(w.capitalize() for w in words) if style == 1 else "-".join(words) if style == 2 else words[0] + "".join(w.capitalize() for w in words[1:])
    return joined + (str(r.randint(0, 99)) if r.random() < 0.3 else "")


def test_held_out(spark, model):
    """Precision and recall on random strings from another generator, and identifiers of words not in the samples."""
    r = random.Random(31)
    tokens = [("".join(r.choice(a) for _ in range(r.randint(24, 48))), True) for a in ALPHABETS for _ in range(400)]
    tokens += [(t, False) for t in (identifier(r) for _ in range(2_000)) if len(t) >= 20]
    got = [x["r"] for x in spark.createDataFrame([(i, t) for i, (t, _) in enumerate(tokens)], "i int, t string").orderBy("i").select(secret_scan.ratio(F.col("t"), model).alias("r")).collect()]
    assert all(abs(x - plain_ratio(t, model)) < 1e-6 for x, (t, _) in zip(got, tokens))
    said = [x > secret_scan.MARGIN for x in got]
    right = sum(s and y for s, (_, y) in zip(said, tokens))
    precision, recall = right / max(1, sum(said)), right / sum(y for _, y in tokens)
    print(f"precision {precision:.4f}, recall {recall:.4f} of {len(tokens)} tokens")
    assert precision >= 0.98 and recall >= 0.95


def test_added_spans(spark, model):
    """All spans against a plain walk: candidates of high ratio that base spans don't hold wholly."""
    r = random.Random(32)
    parts = [lambda: "".join(r.choice(ALPHABETS[0]) for _ in range(r.randint(15, 40))), lambda: identifier(r), lambda: "token=", lambda: "deadbeef" * r.randint(1, 4), lambda: "AKIA" + "AB12" * 5, lambda: " ", lambda: "é😀", lambda: "/", lambda: ", "]
    texts = ["".join(r.choice(parts)() for _ in range(r.randint(0, 12))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["doc_id"]: [tuple(s) for s in x["secrets"]] for x in secret_scan.find_secrets(df, model).select("doc_id", "secrets").collect()}
    clean = {x["doc_id"]: x["text"] for x in secret_scan.redact(df, model).collect()}
    added = 0
    for i, t in enumerate(texts):
        known = base(t)
        held = {p for _, a, b in known for p in range(a, b)}
        more = [("random", m.start(), m.end()) for m in re.finditer(secret_scan.CANDIDATE, t) if plain_ratio(m[0], model) > secret_scan.MARGIN and not held.issuperset(range(*m.span()))]
        spans = sorted(known + more, key=lambda s: (s[1], secret_scan.KINDS.index(s[0])))
        assert got[i] == spans
        added += len(more)
        held |= {p for _, a, b in more for p in range(a, b)}
        assert clean[i] == "".join(c if p not in held else "" if p - 1 in held else "[SECRET]" for p, c in enumerate(t))
    assert added > 100


def test_many_spans(spark, model):
    """A text of 40,000 spans, in time that does not grow with their square."""
    text = "0123456789abcdef, " * 40_000
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    start = time.time()
    assert len(secret_scan.find_secrets(df, model).first()["secrets"]) == 40_000
    assert secret_scan.redact(df, model).first()["text"] == "[SECRET], " * 40_000
    assert time.time() - start < 60
