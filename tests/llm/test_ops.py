"""Each operator against brute force on small tables with nulls, empty and long texts, ties, repeats, odd columns."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hakuspark.llm import common, components, embedding_dedup, lang_id, license_scan, minhash, packing, pieces, registry, secret_scan, url_filter, warc
from hakuspark.llm.tokens import WordTokenizer, vocabulary_path

#: Names that operators use inside, as extra columns of the input.
CLASHING = ["_key", "_text", "_row", "cid", "label", "ids", "score", "lang_pred", "secrets", "h1", "rank", "host", "v", "n"]


def clash(df):
    return df.withColumns({c: F.lit(7) for c in CLASHING if c not in df.columns})


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


@pytest.fixture(scope="module")
def texts(spark):
    r = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "eins", "zwei", "drei", "été", "naïve", "漢字", "x", "don't", "A.", "b,"]
    long = " ".join(r.choice(words) for _ in range(30_000))
    base = [r.choice(words) + str(i % 9) for i in range(60)]
    near = [" ".join(w if r.random() > 0.03 else "changed" for w in base) for _ in range(40)]
    data = [(i, t) for i, t in enumerate([None, "", "   ", "one", "one two", "ONE  two\n", "one two", long, long + " end", *near, *near[:5], "Straße\tÉté", "x" * 5_000, "\u00a0nbsp\u2028x"])]
    data += [(3, "one"), (7, "another text under an id that repeats"), (None, "one two"), (None, None)]
    return data, spark.createDataFrame(data, "doc_id long, text string")


# --- 1: embeddings


def test_embedding_dedup(spark):
    r = np.random.default_rng(1)
    heads = r.normal(size=(6, 16))
    data = [(i, (heads[i % 6] + r.normal(size=16) * 0.12 * (i % 3)).tolist()) for i in range(400)]
    data += [(400 + i, data[0][1]) for i in range(50)] + [(500, None), (501, [0.0] * 16), (502, [1.0, None]), (503, [float("nan")] * 16), (504, [float("inf")] * 16), (505, []), (506, [2.0]), (507, [3.0, 0.0]), (508, [1e300] * 16), (509, [1e-300] * 16), (5, data[7][1])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    padded = [np.pad(np.array(v, float), (0, 16 - len(v))) if v and None not in v and np.isfinite(v).all() and any(v) else None for _, v in data]
    unit = [None if v is None else v / np.abs(v).max() / np.linalg.norm(v / np.abs(v).max()) for v in padded]
    links = [[j for j, u in enumerate(unit) if j != i and v is not None and u is not None and v @ u >= 0.95] for i, v in enumerate(unit)]
    parent = np.arange(len(data))
    for i, js in enumerate(links):
        components.unite(parent, np.full(len(js), i), np.array(js, int))
    root = components.roots(parent, np.arange(len(data)))
    least = {x: min(data[i][0] for i in np.flatnonzero(root == x)) for x in set(root.tolist())}
    expected = sorted(((k, len(js), least[root[i]], k == least[root[i]]) for i, ((k, _), js) in enumerate(zip(data, links))), key=repr)
    assert rows(embedding_dedup.near_duplicates(clash(df)), "vec_id", "n_links", "component_id", "kept") == expected
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0
    assert rows(embedding_dedup.near_duplicates(df.where("vec_id = 500")), "n_links", "component_id", "kept") == [(0, 500, True)]


def test_cover_tree_large_groups():
    r = np.random.default_rng(2)
    points = embedding_dedup.unit(np.concatenate([r.normal(size=(1, 24)) + s * r.normal(size=(n, 24)) for n, s in ((700, 0.01), (500, 0.06), (300, 2.0), (300, 0.1))]))
    one, two = points[:1000], points[1000:]
    trees = [embedding_dedup.CoverTree(p, np.arange(len(p)), np.ones(len(p), int)) for p in (one, two)]
    for t in trees:
        t.single()
        for node in np.flatnonzero(t.last > 0):  # radii halve, and cover what is below
            for child in t.below(node):
                part = t.points[t.start[child] : t.end[child]]
                assert np.sqrt(np.maximum(0, 2 - 2 * part @ t.points[t.center[child]])).max() <= t.reach[child] + 1e-7 and t.reach[child] <= t.reach[node] + 1e-7
    own = embedding_dedup.Links(trees[0], None, 0.95)
    own.run()
    assert (own.counts == (trees[0].points @ trees[0].points.T >= 0.95).sum(1) - 1).all()
    both = embedding_dedup.Links(*trees, 0.95)
    both.run()
    hit = trees[0].points @ trees[1].points.T >= 0.95
    assert (both.counts == np.concatenate((hit.sum(1), hit.sum(0)))).all()


def test_cover_tree_close_centres():
    """Pairs of nodes whose centres nearly agree and whose farthest points are just not linked."""
    r = np.random.default_rng(13)
    for _ in range(40):
        ahead, aside = np.linalg.qr(r.normal(size=(16, 2)))[0].T

        def fan(turn, reach, n):
            """A centre turned one way, and points around it, about so far, the other way."""
            angles = turn - np.concatenate(([0.0], 2 * np.arcsin(r.uniform(reach * 0.99, reach, n) / 2)))
            return embedding_dedup.unit(np.cos(angles)[:, None] * ahead + np.sin(angles)[:, None] * aside)

        one, two = fan(0.0, 0.31605, 90), fan(r.uniform(2e-4, 3e-4), 1e-6, 90)
        trees = [embedding_dedup.CoverTree(p, np.arange(len(p)), np.ones(len(p), int)) for p in (one, two)]
        for t in trees:
            t.single()
        both = embedding_dedup.Links(*trees, 0.95)
        both.run()
        hit = np.einsum("ik,jk->ij", trees[0].points, trees[1].points) >= 0.95
        assert (both.counts == np.concatenate((hit.sum(1), hit.sum(0)))).all()


def test_embedding_tiles(spark, monkeypatch):
    """Many small blocks in groups of several, against all pairs."""
    monkeypatch.setattr(embedding_dedup, "BLOCK_BYTES", 1)  # 256 rows
    monkeypatch.setattr(embedding_dedup, "GROUP_BLOCKS", 3)
    r = np.random.default_rng(14)
    heads = r.normal(size=(40, 12))
    data = (heads[r.integers(0, 40, 3000)] + r.normal(size=(3000, 12)) * r.choice([0.05, 0.15, 0.6], (3000, 1))).tolist()
    df = spark.createDataFrame(list(enumerate(data)), "vec_id long, embedding array<double>")
    points = embedding_dedup.unit(np.array(data))
    hit = points @ points.T >= 0.95
    i, j = np.nonzero(hit)
    nodes, least = components.local_components(i, j)
    assert rows(embedding_dedup.near_duplicates(df), "vec_id", "n_links", "component_id") == sorted(((int(k), int(n) - 1, int(x)) for k, n, x in zip(nodes, hit.sum(1), least)), key=repr)


def test_components_contract(spark):
    r = random.Random(4)
    pairs = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(200)] + [(r.randint(2000, 2400), r.randint(2000, 2400)) for _ in range(300)]
    found = {x["node"]: x["root"] for x in components.components(spark.createDataFrame(pairs, "a long, b long"), local_edges=20).collect()}
    nodes, least = components.local_components(*np.array(pairs).T)
    groups = {}
    for n, x in zip(nodes.tolist(), least.tolist()):
        if n in found:
            groups.setdefault(x, set()).add(found[n])
    assert all(len(g) == 1 for g in groups.values()) and len({min(g) for g in groups.values()}) == len(groups)


# --- 2: WARC


def test_warc(spark, tmp_path):
    data = [(1, "http://a/", "x\r\n"), (2, "http://b/\r\nX: y", "x\r\n"), (3, None, None), (4, "u", ""), (5, "u", "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n"), (6, "u", "a\r\n\r\n"), (7, "u", "\r\n"), (8, "u", "\r\n" * 5), (9, "u", "é" * 50_000), (6, "u", "a\r\n\r\n"), (None, "u", "é" * 50_000), (10, "u", "é" * 50_000)]
    clash(spark.createDataFrame(data, "page_id long, url string, html string")).write.parquet(str(tmp_path / "pages.parquet"))
    first, expected = {}, []
    for k, _, h in data:
        body = (h or "").encode()
        if k is not None:
            first[body] = min(k, first.get(body, k))
    for k, _, h in data:
        body = (h or "").encode()
        new = k is None or first[body] == k
        expected.append((k, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if new else "revisit", None if new else first[body]))
    assert rows(warc.op2_warc(spark, str(tmp_path)), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == sorted(expected, key=repr)
    path = str(tmp_path / "archive")
    warc.write_archive(spark.read.parquet(str(tmp_path / "pages.parquet")), path, min_bytes=6)
    records = warc.read_records(spark, path)
    assert records.count() == 3 * len(data) and records.where("truncated").count() == 0
    assert records.where("record_type = 'revisit'").count() == 1  # the long payload; shorter ones are all responses
    assert {bytes(r["payload"]) for r in records.where("record_type = 'response'").collect()} == {(h or "").encode() for _, _, h in data}
    whole = warc.assemble(records)
    assert whole.count() == len(data) and whole.where("part = 0 and size(requests) = 1 and size(metadata) = 1").count() == len(data)
    cut = warc.assemble(records.unionByName(records.where("record_type = 'request'").withColumn("record_id", F.concat("record_id", F.lit("x")))), related_rows=1)
    assert sum(len(r["requests"]) for r in cut.collect()) == 2 * len(data)  # nothing is dropped when a capture goes on in more rows
    warc.write_archive(spark.read.parquet(str(tmp_path / "pages.parquet")).limit(0), path + "0")
    assert warc.read_records(spark, path + "0").count() == 0


def test_warc_blocks():
    def record(block, kind="resource"):
        return f"WARC/1.1\r\nWARC-Type: {kind}\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"

    blocks = [b"", b"a", b"\r\n", b"a\r\n", b"\r\na", b"a\r\n\r\nb", b"\r\n\r\n\r\n", b"\r\n" * 7, b"WARC/1.1\r\n\r\n"]
    pieces_ = b"".join(map(record, blocks)).split(warc.SEPARATOR)
    assert [b for _, b, cut in warc._blocks(pieces_) if not cut] == blocks
    assert list(warc._blocks([b"WARC/1.1\r\nContent-Length: 9", b"abc"]))[0][1:] == (b"abc", True)


# --- 3: SentencePiece


def test_pieces(spark, texts, monkeypatch):
    model = pieces.PieceModel(vocabulary_path(pieces.MODEL))
    usable = {p: i for i, p in enumerate(s.decode("utf-8", "ignore").replace(" ", pieces.BLANK) for s in model.spelled) if p and i > 258}

    def best(text):
        """Highest score of any segmentation, over all substrings."""
        score = [0.0] + [-np.inf] * len(text)
        for i in range(1, len(text) + 1):
            score[i] = max([score[i - 1] + model.unknown, *(score[j] + model.scores[usable[text[j:i]]] for j in range(max(0, i - 48), i) if text[j:i] in usable)])
        return score[-1]

    def cost(ids, text):
        return sum(model.scores[i] if i > 258 else 0 for i in ids) + model.unknown * sum(c not in usable for c in text)

    r = random.Random(11)
    drawn = ["".join(r.choices(["the", "ing", "tion", "un", "e", "s", " ", "  ", ".", "é", "語", "\n", "\t", "0", "Q"], k=r.randint(1, 60))) for _ in range(150)]
    for text in ["the theory of ouen the", "a  b   c", " x", "日本語テスト 😀", "tabs\tand\nlines\r\n", "aaaaaaaaaa", "Straße été", *drawn]:
        ids = model.encode(text).tolist()
        assert model.decode(ids) == text
        assert cost(ids, written := pieces.BLANK + text.replace(" ", pieces.BLANK)) == pytest.approx(best(written))
    data, df = texts
    unbroken = "".join(t for _, t in data[9:20]).replace(" ", "")
    listed = model.segment(unbroken)
    monkeypatch.setattr(pieces, "LONG", 10)
    assert model.segment(unbroken) == listed and model.decode(listed) == unbroken
    got = pieces.encode(clash(df), vocabulary_path(pieces.MODEL))
    assert got.where("round_trip = false").count() == 0 and got.count() == len(data)
    assert got.where("ids is null").count() == sum(t is None for _, t in data)
    back = pieces.decode(got, vocabulary_path(pieces.MODEL))
    assert rows(back, "doc_id", "text") == sorted(data, key=repr)
    assert pieces.encode(df.limit(0), vocabulary_path(pieces.MODEL)).count() == 0


# --- 4: packing


def test_packing(spark, texts):
    data, df = texts
    path = vocabulary_path(packing.TOKENIZER)
    tokenizer = WordTokenizer(path)
    ids_of = lambda t: np.array([*tokenizer.tokenizer.encode(t or "", add_special_tokens=False).ids, packing.END_ID], "<u4")

    def check(got):
        at = {}
        for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
            assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] and r["offset"] == at.get(r["sequence_id"], 0)
            at[r["sequence_id"]] = r["offset"] + r["length"]
        assert all(n == packing.CAPACITY or n & (n - 1) == 0 for n in at.values())

    # The ids of every document, under ids of their own.
    own = packing.pack(clash(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(data)], "doc_id long, text string")), path, with_ids=True).collect()
    check(own)
    found: dict = {}
    for r in sorted(own, key=lambda r: r["start"]):
        assert r["start"] == len(found.get(r["doc_id"], b"")) // 4
        found[r["doc_id"]] = found.get(r["doc_id"], b"") + r["ids"]
    assert found == {i: ids_of(t).tobytes() for i, (_, t) in enumerate(data)}
    got = packing.pack(clash(df), path, with_ids=True).collect()
    check(got)
    sizes: Counter = Counter()
    for r in got:
        sizes[r["doc_id"], r["doc_tokens"]] += r["length"]
    expected: Counter = Counter()
    for k, t in data:
        expected[k, len(ids_of(t))] += len(ids_of(t))
    assert sizes == expected
    assert packing.pack(df.limit(0), path).count() == 0


def test_packing_lots(monkeypatch):
    """Texts cut into lots, and signs cut from words, give the ids of whole texts."""
    tokenizer = WordTokenizer(vocabulary_path(packing.TOKENIZER))
    r = random.Random(15)
    parts = ["stop", ",", ".", "'s", "don't", "%%%", "été", "ß", "»", "3.5", " ", "\n", "\t", "\x1c", "A", "<|endoftext|>", "e\u0301", "漢", "\u00a0", "=\u0338", "ŉ", "(x)"]
    data = ["".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(2_000)] + [None, ""]
    monkeypatch.setattr(packing, "LOT_BYTES", 500)
    texts = pa.array(data)
    for a, b in packing._lots(texts):
        ids, ends = tokenizer.encode_all(texts[a:b])
        for i, t in enumerate(data[a:b]):
            assert ids[ends[i - 1] if i else 0 : ends[i]].tolist() == tokenizer.tokenizer.encode(t or "", add_special_tokens=False).ids


def test_windows():
    r = random.Random(6)
    for _ in range(60):
        capacity = r.choice([16, 32, 64])
        counts = {n: r.randint(1, 4) for n in r.sample(range(1, capacity + 1), 6)}
        items = sorted((n for n, c in counts.items() for _ in range(c)), reverse=True)
        sums = {items[0]}
        for n in items[1:]:
            sums |= {s + n for s in sums if s + n <= capacity}
        used = packing.fill_window(counts, capacity)
        assert sum(n * k for n, k in used.items()) == max(sums) and used[max(counts)] >= 1
        assert all(k <= counts[n] for n, k in used.items())


def test_word_tokenizer():
    tokenizer = WordTokenizer(vocabulary_path(packing.TOKENIZER))
    for text in ["don't stop, U.S.A. 3.5, é.", "H̱ello, Å", "<|endoftext|> <|ENDOFTEXT|> x.", "ﬁ. ª, ß. Ñ, x y.\x1cz ,. a,b. A.\n.B", "İSTANBUL, ς Σ. ŁÓDŹ. ŉ", "", " ", "a.\u0301 b,\u0338"]:
        assert tokenizer.encode(text).tolist() == tokenizer.tokenizer.encode(text, add_special_tokens=False).ids


# --- 5: URLs


def test_urls(spark):
    urls = [None, "", "nothing", "http://www.example.com/en/1", "https://EXAMPLE.com/en/", "http://notexample.com/en/", "http://example.com", "http://a.net/es/x?y", "http://net/fr/#z", "x://b.org/a://c.com/", "http://m.www.example.com/en/", "http://example.com/de/", "http://example.com?/en/", "ftp://u@h.com:8/", "http://" + "a." * 300 + "com/" + "b" * 5000, "http://a.com/\nb"]
    data = [(i, u) for i, u in enumerate(urls)] + [(3, urls[3]), (None, urls[3])]

    def judge(url):
        rest = url.partition("://")[2] if url else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fits = [r for r in url_filter.RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
        best = max(fits, key=lambda r: len(r[0] + r[1]), default=None)
        return host, path, best and best[0] + best[1], best[2] if best else "allow"

    rules = common.literal_rows(spark, ["host", "path", "verdict"], url_filter.RULES)
    df = spark.createDataFrame(data, "page_id long, url string")
    expected = sorted(((k, *judge(u)) for k, u in data), key=repr)
    assert rows(url_filter.judge_urls(clash(df), rules), "page_id", "host", "path", "rule", "verdict") == expected
    assert rows(url_filter.judge_urls(df, rules.limit(0)), "verdict") == [("allow",)] * len(data)
    assert url_filter.judge_urls(df.limit(0), rules).count() == 0


# --- 6: secrets


def base(text):
    assign = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    found = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return [(secret_scan.KINDS[k], a, b) for a, k, b in sorted(found)]


def test_secrets(spark, texts):
    r = random.Random(8)
    parts = ["password", "Token", "api_key", "APIKEY", "secret", "=", ":", " ", '"', "'", "abcdef012345", "AKIA", "ABCDEFGH12345678", "deadbeefdeadbeef", "é", "😀", "\n", "x", "_", "漢", "0123456789abcdef" * 2]
    data = [(i, "".join(r.choice(parts) for _ in range(r.randint(0, 25)))) for i in range(400)] + [(i + 400, t) for i, (_, t) in enumerate(texts[0])]
    df = spark.createDataFrame(data, "doc_id long, text string")
    model = secret_scan.fit(secret_scan.labelled_samples(df))
    found = secret_scan.find_secrets(clash(df), model).select("doc_id", "secrets").collect()
    for row in found:
        spans = [(s["kind"], s["start"], s["end"]) for s in row["secrets"]]
        assert [s for s in spans if s[0] != "random"] == base(dict(data)[row["doc_id"]] or "")
    clean = {x["doc_id"]: x["text"] for x in secret_scan.redact(clash(df), model).collect()}
    for k, t in data:
        spans = base(t or "")
        assert (clean[k] is None) == (t is None) and (not spans or "[SECRET]" in clean[k])
        assert t is None or not base(clean[k].replace("[SECRET]", "\n"))
    assert secret_scan.find_secrets(df.limit(0)).count() == 0


def test_markov(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = secret_scan.fit(secret_scan.labelled_samples(docs))
    tokens = {"Zx9Qw3Rt7Yp2Lm8Nk4Vb6Cc1": True, "ghp_16C7e42F292c6912E7710c838347Ae178B4a": True, "internationalizationoptions": False, "get_user_profile_settings": False, "Donaudampfschifffahrtsgesellschaft": False}
    df = spark.createDataFrame([(t,) for t in tokens], "t string")
    assert {r["t"]: r["r"] > secret_scan.MARGIN for r in df.select("t", secret_scan.ratio(F.col("t"), model).alias("r")).collect()} == tokens
    odd = spark.createDataFrame([(1, "see Zx9Qw3Rt7Yp2Lm8Nk4Vb6Cc1.")], "doc_id long, text string")
    assert [tuple(s) for s in secret_scan.find_secrets(odd, model).first()["secrets"]] == [("random", 4, 28)]


# --- 7: MinHash


def sets_of(text, words):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())


def brute_components(data, words, percent=80):
    sets = [sets_of(t, words) for _, t in data]
    parent = np.arange(len(data))
    for i, a in enumerate(sets):
        js = [j for j in range(i) if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j])]
        components.unite(parent, np.full(len(js), i), np.array(js, int))
    root = components.roots(parent, np.arange(len(data)))
    least = {x: min((k for (k, _), y in zip(data, root) if y == x and k is not None), default=None) for x in set(root.tolist())}
    return sorted(((k, len(s), least[x], k == least[x]) for (k, _), s, x in zip(data, sets, root.tolist())), key=repr)


@pytest.mark.parametrize("words", [2, 5])
def test_minhash(spark, texts, words):
    data, df = texts
    assert rows(minhash.near_duplicates(clash(df), words), "doc_id", "n_shingles", "component_id", "kept") == brute_components(data, words)
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_minhash_large_bucket(spark, monkeypatch):
    """Groups near the threshold, through the second round and its blocks."""
    for name, value in (("SMALL", 3), ("FIRST_TEXTS", 5), ("FIRST_SHINGLES", 700), ("PART_TEXTS", 7), ("PART_SHINGLES", 900)):
        monkeypatch.setattr(minhash, name, value)
    r = random.Random(9)
    base_ = [f"w{i}" for i in range(100)]
    data = []
    for i in range(150):
        rate = r.choice([0.0, 0.02, 0.05, 0.08, 0.1])
        data.append((i, " ".join(w if r.random() > rate else f"{w}x{i}" for w in base_)))
    df = spark.createDataFrame(data, "doc_id long, text string")
    assert rows(minhash.near_duplicates(df, 2), "doc_id", "n_shingles", "component_id", "kept") == brute_components(data, 2)


def test_deduplicate_rows(spark, texts):
    data, df = texts
    kept = minhash.deduplicate(clash(df), 2)
    assert kept.columns == clash(df).columns
    left = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert len([t for _, t in left if t and sets_of(t, 2) == sets_of("one two", 2)]) == 1
    assert (7, "another text under an id that repeats") in left and (0, None) in left and (None, None) in left


def test_numbered_rows(spark, tmp_path):
    """Numbers depend on files and places only, not on how the files are split or what is read besides."""
    spark.range(5_000).selectExpr("id", "repeat('x', cast(id % 50 as int)) as _metadata_", "1 as _file").repartition(3, "id").write.option("parquet.block.size", 4_000).parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    once = {r["id"]: r["_row"] for r in common.numbered(common.masked(docs), "_row").toDF("id", "b", "c", "_row").collect()}
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
        again = {r["id"]: r["_row"] for r in common.numbered(common.masked(docs), "_row").toDF("id", "b", "c", "_row").where("id > 100").collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert len(set(once.values())) == len(once) == 5_000 and all(once[k] == v for k, v in again.items())
    made = spark.range(10).withColumn("_metadata", F.lit(1))
    assert common.numbered(common.masked(made), "_row").select("_row").distinct().count() == 10


def test_signature_variance():
    """Values agree as often as sets overlap, for least and greatest alike."""
    r = np.random.default_rng(5)
    agree = []
    for _ in range(60):
        pool = r.integers(0, 1 << 63, 450, dtype=np.uint64)
        one, two = np.sort(pool[:400]), np.sort(pool[50:])
        agree.append((minhash.signature(one) == minhash.signature(two)).reshape(2, -1).mean(1))
    assert np.abs(np.mean(agree, axis=0) - 350 / 450).max() < 0.02


# --- 8: language


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = lang_id.op8_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    assert len(got) == docs.count() and all((zlib.crc32(str(i).encode()) % 4 == 2) == h for i, h in zip(got.doc_id, got.held_out))
    assert (held.lang_pred == held.lang).mean() >= 0.97 and got.score.between(0, 1).all()


def test_language_odd_rows(spark, texts):
    data, df = texts
    learned = lang_id.fit(spark.createDataFrame([("the cat and the dog sat there", "en"), ("der hund und die katze", "de")] * 3 + [(None, "fr"), ("x", None)], "text string, lang string"))
    got = {r["doc_id"]: r for r in lang_id.predict(clash(df.where("doc_id is not null and doc_id not in (3, 7)")), learned).collect()}
    assert got[0]["lang_pred"] == got[1]["lang_pred"] == got[2]["lang_pred"] == "und" and got[0]["score"] == 0
    assert all(r["lang_pred"] in ("de", "en") for k, r in got.items() if k > 2)
    assert {r["lang_pred"] for r in lang_id.predict(df, lang_id.fit(df.withColumn("lang", F.lit(None).cast("string")))).collect()} == {"und"}
    assert lang_id.predict(df.limit(0), learned).count() == 0


def test_language_filter_counts():
    """The filter contains every n-gram that was put in, for its languages, and few others."""
    r = np.random.default_rng(3)
    grams = {c: r.integers(0, 1 << 63, 5_000, dtype=np.uint64) for c in "abc"}
    model = lang_id.LanguageModel(grams)
    for i, c in enumerate("abc"):
        assert (model.containing(grams[c]) >> np.uint8(i) & 1).all()
    other = model.containing(r.integers(0, 1 << 63, 200_000, dtype=np.uint64))
    for i in range(3):
        assert np.mean(other >> np.uint8(i) & 1) == pytest.approx(model.false_rate[i], rel=0.5, abs=1e-4)


def test_language_slices(monkeypatch):
    """Long texts give the same n-grams in slices, wherever these are cut."""
    r = random.Random(16)
    for _ in range(60):
        text = "".join(r.choice("abÉ漢 .1\n") * r.choice([1, 1, 1, 5]) for _ in range(r.randint(5, 200))).lower()
        monkeypatch.setattr(lang_id, "SLICE", 10**9)
        whole = Counter(lang_id._gram_hashes([text])[0].tolist())
        monkeypatch.setattr(lang_id, "SLICE", r.choice([1, 2, 3, 4, 7]))
        assert Counter(h for p, _, _ in lang_id._lots([text, "ab"]) for h in p.tolist()) - Counter(lang_id._gram_hashes(["ab"])[0].tolist()) == whole


def plain_grams(text):
    """Four characters each of words and single blanks, with a blank at both ends; blanks alone are none."""
    words = "".join(c if c.isalpha() else " " for c in text.lower())
    line = " " + re.sub(" +", " ", words) + " "
    return [line[i : i + 4] for i in range(len(line) - 3) if line[i : i + 4].strip()]


def test_language_against_sets(spark):
    """Bloom filters decide as exact sets of n-grams do."""
    docs = [(r["text"], r["lang"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect() if r["text"] and r["lang"]]
    learned: dict = {}
    for text, lang in docs[::2]:
        learned.setdefault(lang, Counter()).update(plain_grams(text))
    sets = {k: {g for g, n in c.most_common(3_000)} for k, c in learned.items()}
    code = lambda g: np.uint64(0) + lang_id._mixed(np.array([sum(int(ord(c)) * pow(0x9E3779B97F4A7C15, 3 - i, 1 << 64) for i, c in enumerate(g)) % (1 << 64)], np.uint64))[0]
    model = lang_id.LanguageModel({k: np.array(sorted(map(code, s)), np.uint64) for k, s in sets.items()})
    labels, scores = model.predict([t for t, _ in docs])
    for (text, _), label, score in zip(docs, labels, scores):
        grams = plain_grams(text)
        share = {k: sum(g in s for g in grams) / max(len(grams), 1) for k, s in sets.items()}
        off = 0.03 + 2 / max(len(grams), 1)  # a short text may hold a false positive or two
        assert abs(share[label] - score) < off and share[label] >= max(share.values()) - off


# --- 10: licences


def test_licenses(spark, texts):
    data, df = texts
    same = license_scan.LICENSES[0][1].upper().replace("<year> <copyright holders>", "2020 X").replace("LICENSE", "licence").replace(",", " ,")
    more = spark.createDataFrame([(900, same), (901, "Copyright (c) 2020 X\n" + license_scan.LICENSES[1][1]), (902, "released under the mit licence"), (903, "Released under the MIT License. And more.")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in license_scan.scan_licenses(clash(df.unionByName(more))).collect()}
    assert [got[i]["license_id"] for i in (900, 901, 902, 903, 0, 1)] == ["MIT", "MIT", "MIT", None, None, None]
    assert got[0]["canonical_sha256"] is None and got[1]["canonical_sha256"] == hashlib.sha256(b"").hexdigest()
    assert license_scan.scan_licenses(df).count() == len(data) and license_scan.scan_licenses(df.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        connection.sql(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    got = registry.queries()[name](spark, "/root/testdata/sf0.001")
    columns = sorted(got.columns)
    wanted = connection.sql(registry.oracle_sql()[name]).select(*columns).fetchall()
    assert sorted(map(repr, (tuple(r) for r in got.select(*columns).collect()))) == sorted(map(repr, wanted))
