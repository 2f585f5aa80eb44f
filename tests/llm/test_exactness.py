"""Results that must hold whatever the words, the lengths, the sizes of groups and the plan: against the tokenizers library and brute force."""

import hashlib
import math
import types
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from oracle import SF
from pyspark.sql import functions as F
from test_llm import ODD, WORDS, brute_components, brute_removal, check_packing, documents, library

from textquarry.llm import bpe, common, line_dedup, minhash_dedup, packing, planes, quality_classifier, quality_rules, queries, spans, substring_dedup, tokens
from textquarry.llm.common import shared_path


def thue_morse(n, letters="ab"):
    out = letters
    while len(out) < n:
        out += out.translate(str.maketrans(letters, letters[::-1]))
    return out


#: Pairs of words that hashes which are linear modulo a power of two can't tell apart.
PAIRS = [(thue_morse(n), thue_morse(n, "ba")) for n in (1024, 2048)]


@pytest.fixture
def many_hot(monkeypatch):
    """All keys of three rows or more count as hot."""
    monkeypatch.setattr(common, "HOT", 3)
    monkeypatch.setattr(common, "SALTS", 4)
    monkeypatch.setattr(substring_dedup, "HOT", 3)
    monkeypatch.setattr(substring_dedup, "SALTS", 4)


def test_names():
    rng = np.random.default_rng(0)
    data = [bytes(rng.integers(97, 99, rng.integers(1, 20)).astype(np.uint8)) for _ in range(3000)] + [b"a", b"a\x00", b"\x00a", b"A" * 15, b"a" * 15, b"a" * 16]
    raw = np.frombuffer(b"".join(data), np.uint8)
    ends = np.cumsum([len(x) for x in data])
    first = ends - np.array([len(x) for x in data])
    for lower in (False, True):
        low, high = spans.names(raw, first, ends, lower)
        groups = defaultdict(set)
        for a, b, x in zip(low.tolist(), high.tolist(), data):
            groups[a, b].add(x.lower() if lower else x)
        assert all(len(x) == 1 for x in groups.values()) and len(groups) == len({x.lower() if lower else x for x in data})


@pytest.mark.parametrize("path", [tokens.word_vocabulary(), tokens.byte_vocabulary()])
def test_encoder_tells_words_apart(path):
    texts = [f"{w} x {w}" for pair in PAIRS for w in pair] + [PAIRS[0][0] + "\n" + PAIRS[0][1]]
    ids, sizes = bpe.Bpe(path).encode_batch(pa.array(texts))
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [library(path).encode(t, add_special_tokens=False).ids for t in texts]


def test_encoder_forgets_in_time(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    monkeypatch.setattr(bpe, "REMEMBERED_BYTES", 50)
    model, lib = bpe.Bpe(tokens.byte_vocabulary()), library(tokens.byte_vocabulary())
    for t in ["one two three four five six", "y" * 40, "y" * 41 + " one", "y" * 40]:
        assert model.encode_batch(pa.array([t]))[0].tolist() == lib.encode(t, add_special_tokens=False).ids


def test_encoder_refuses_other_vocabularies(tmp_path):
    import json

    with open(tokens.byte_vocabulary(), encoding="utf-8") as f:
        spec = json.load(f)
    spec["normalizer"] = {"type": "NFKC"}
    (tmp_path / "v.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError):
        bpe.Bpe(str(tmp_path / "v.json"))


def test_every_row_of_the_round_trip(spark):
    lib = library(tokens.word_vocabulary())
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in queries.QUERIES["op2_bpe_encode"](spark, SF).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = {}
    for i, t in texts.items():
        ids = lib.encode(t, add_special_tokens=False).ids
        want[i] = (len(ids), sha(" ".join(map(str, ids))), sha(lib.decode(ids, skip_special_tokens=False)))
    assert got == want


def test_every_row_of_the_shards(spark):
    lib = library(tokens.byte_vocabulary())
    at, want = 0, {}
    for r in sorted(spark.read.parquet(f"{SF}/documents.parquet").collect(), key=lambda r: r["doc_id"]):
        ids = lib.encode(r["text"] or "", add_special_tokens=False).ids + [2]
        want[r["doc_id"]] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in queries.QUERIES["op9_bit_planes"](spark, SF).collect()}
    assert got == want


def test_shards_are_read_one_by_one(spark):
    docs = documents(spark, ["same text"] * 60 + [w for p in PAIRS for w in p], [7] * 60 + [1, 2, 3, 4])
    manifest = planes.write_shards(docs, shared_path(spark, "t"), tokens.byte_vocabulary(), shards=4)
    assert max(r["n_docs"] for r in manifest.collect()) < 40  # a text that many rows repeat is split
    read = planes.read_shards(manifest)
    assert len({r["sid"] for r in read.select(F.spark_partition_id().alias("sid")).collect()}) == manifest.count() > 1
    lib = library(tokens.byte_vocabulary())
    own = {r["doc_id"]: np.frombuffer(r["ids_le"], "<u4").tolist() for r in read.collect()}
    assert [own[i] for i in (1, 2, 3, 4)] == [lib.encode(w, add_special_tokens=False).ids + [2] for p in PAIRS for w in p]


def test_packing_tells_words_apart(spark):
    lib, texts = library(tokens.word_vocabulary()), [w for p in PAIRS for w in p]
    pieces = packing.with_crc(packing.pack(documents(spark, texts), tokens.word_vocabulary())).collect()
    check_packing(pieces, {i: lib.encode(t, add_special_tokens=False).ids + [1] for i, t in enumerate(texts)})


# Duplicates ---------------------------------------------------------------------------------------------------


def families(seed=4):
    rng = np.random.default_rng(seed)
    vocab = [f"w{i}" for i in range(2000)]
    texts = [*ODD, *(f"{w} a b c d" for p in PAIRS for w in p)]
    for family in range(6):
        words = list(rng.choice(vocab, rng.integers(40, 160)))
        for _ in range(14):
            texts.append(" ".join(words))
            words = words if rng.random() < 0.6 else list(words)
            for _ in range(rng.integers(1, 4)):
                words[rng.integers(len(words))] = rng.choice(vocab)
    return texts


def test_near_duplicates_in_small_blocks(spark, monkeypatch, many_hot):
    monkeypatch.setattr(minhash_dedup, "BLOCK", 3)
    texts = families()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash_dedup.near_duplicates(documents(spark, texts), k=4).collect()}
    assert got == brute_components(texts, list(range(len(texts))), 4, 80)


def test_blocks_find_all_links_of_a_bucket(spark):
    """Members of one bucket in several blocks, against all pairs."""
    rng = np.random.default_rng(1)
    base = rng.choice(5000, 200, replace=False)
    texts = [" ".join(f"v{x}" for x in np.where(rng.random(200) < share, rng.integers(5000, 9000, 200), base)) for share in (0.01, 0.02, 0.03, 0.2) for _ in range(10)]
    rows = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    sets = minhash_dedup.full_sets(rows, 1, 5)
    made = minhash_dedup.sketches(rows.select(F.col("node").alias("id"), F.lit("").cast("binary").alias("h"), "text"), 1, 5)
    nodes = made.select(F.col("id").alias("node"), "n", "sketch")
    open_ = nodes.select(F.lit(1).cast("long").alias("band"), "node", "n", F.col("node").alias("comp"), F.lit(4).cast("long").alias("blocks"))
    found = minhash_dedup.verified(minhash_dedup.apart_links(open_, sets, 80), sets, 80, None).collect()
    words = [set(t.split()) for t in texts]
    want = {(a, b) for a in range(len(texts)) for b in range(a) if 100 * len(words[a] & words[b]) >= 80 * len(words[a] | words[b])}
    assert want and {(r["a"], r["b"]) for r in found} == want


def test_rows_that_repeat_near_duplicates(spark, many_hot):
    words = [f"u{i}" for i in range(60)]
    texts = [" ".join(words)] * 12 + [" ".join([*words[:-1], "x"])] * 12 + [None, ""]
    got = minhash_dedup.near_duplicates(documents(spark, texts, [5] * 12 + [None] * 12 + [1, 2]), k=4).collect()
    assert len(got) == 26 and sum(r["kept"] for r in got) == 3 and {r["component_id"] for r in got if r["n_shingles"]} == {5}


def test_sketches_merge():
    x = np.random.default_rng(0).integers(0, 2**63, 500).astype(np.uint64)
    whole, one, two = (minhash_dedup.registers(v, np.array([len(v)])) for v in (x, x[:300], x[200:]))
    assert (minhash_dedup.merged(one, two) == whole).all()


def passages(seed=2):
    rng = np.random.default_rng(seed)
    vocab = [f"v{i}" for i in range(3000)]
    passage = list(rng.choice(vocab, 60))
    texts = [*ODD, "a b " * 100, *(" ".join([*rng.choice(vocab, rng.integers(0, 90)), *(passage[: rng.integers(0, 60)] if i % 2 else []), *rng.choice(vocab, 20)]) for i in range(40))]
    rest = " ".join(f"t{i}" for i in range(34))
    return texts + [f"{rest} {w}" for p in PAIRS for w in p]


@pytest.mark.parametrize("most", [28, 4])
def test_substrings_whatever_the_sketch(spark, monkeypatch, many_hot, most):
    """Broadcast sketch and table of cells give the same, hot windows dealt over several tasks."""
    monkeypatch.setattr(substring_dedup, "MOST", most)
    texts = passages()
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in substring_dedup.remove_repeats(documents(spark, texts).repartition(3)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_removal(texts, 35)


def test_share_let_through_does_not_grow(spark):
    """Cells follow the size of the input beyond what is broadcast; unrepeated keys meet another in both depths as rarely as before."""
    sizes = [spark.range(1).select(F.lit("x" * n).alias("text")) for n in (1 << 20, 1 << 24)]
    small, large = map(substring_dedup.cell_bits, sizes)
    assert large == small + 4
    keys = np.random.default_rng(0).integers(0, 2**62, 1 << 14).astype(np.uint64)
    for n in (1 << 12, 1 << 14):
        bits = int(math.log2(4 * n))
        met = np.ones(n, bool)
        for c in substring_dedup.cells(keys[:n], bits):
            met &= np.bincount(c, minlength=1 << bits)[c] > 1
        assert met.mean() < 0.08


# Lines, rules, classifier -------------------------------------------------------------------------------------


def brute_lines(texts, min_docs=5):
    """The tree by plain loops: number of lines dropped and kept text of each."""
    lines = [[WORDS.findall(x) for x in (t or "").split("\n")] for t in texts]
    leaf = lambda w: (len(w), *("<*>" if any(c in "0123456789" for c in x) else x for x in w[:3]))
    by_leaf, by_node, by_template = defaultdict(set), defaultdict(set), defaultdict(set)
    for d, own in enumerate(lines):
        for w in own:
            if len(w) >= 3:
                by_leaf[leaf(w)].add(d)
                for i, x in enumerate(w):
                    by_node[leaf(w), i, x].add(d)

    def template(w):
        if len(w) < 3 or len(by_leaf[leaf(w)]) < min_docs:
            return None
        t = tuple(x if len(by_node[leaf(w), i, x]) >= min_docs else None for i, x in enumerate(w))
        return (leaf(w), t) if sum(x is not None for x in t) >= 0.7 * len(w) else None

    for d, own in enumerate(lines):
        for w in own:
            by_template[template(w)].add(d)
    out = []
    for t, own in zip(texts, lines):
        gone = [template(w) is not None and len(by_template[template(w)]) >= min_docs for w in own]
        out.append((sum(gone), "\n".join(x for x, g in zip((t or "").split("\n"), gone) if not g)))
    return out


@pytest.mark.parametrize("rows", [500_000, 0])
def test_lines_against_plain_loops(spark, monkeypatch, many_hot, rows):
    """A crowded leaf with several templates, a document that repeats its own line, variable fields; with and without a broadcast."""
    monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", rows)
    rng = np.random.default_rng(0)
    texts = [None, "", "1 2 3 alone in this one document only\n" * 5]
    for i in range(30):
        own = [f"{i} {i + 1} {i + 2} {a} {b} {c} was seen at noon" for a, b, c in [rng.choice([f"z{k}" for k in range(300)], 3)]]
        own += [f"{i} 7 {i * 3} request of {i} was answered in time"] * (i % 3 == 0)
        own += [f"{i} 8 {i * 5} page of printed words lies here now"] * (i % 4 == 0)
        texts.append("\n".join([*own, f"only here {i} stands q{i} r{i} s{i}"]))
    texts += ["shown once by all of these documents"] * 9 + ["shown once by too few documents here"] * 4
    got = {r["doc_id"]: (r["n_dropped"], r["kept_text"]) for r in line_dedup.line_dedup(documents(spark, texts)).collect()}
    want = brute_lines(texts)
    assert [got[i] for i in range(len(texts))] == want and want[2][0] == 0 and want[3][0] > 0


def test_repeats_in_long_texts(spark):
    words = [f"w{i}" for i in range(1_000_000)]
    texts = [" ".join(words), " ".join([*words, *words[500:503]]), "p q r " * 20_000]
    got = [r["n_repeat_words"] for r in quality_rules.ledger(documents(spark, texts)).orderBy("doc_id").collect()]
    assert got == [0, 6, 60_000]


def brute_posteriors(rows):
    """Means of sites and hosts shrunk by the method of moments, from rows (host, path, evidence)."""
    paths, hosts = defaultdict(list), defaultdict(list)
    for host, path, e in rows:
        paths[host, path].append(e)
        hosts[host].append(e)
    mu = np.clip(np.mean([e for _, _, e in rows]), 1e-6, 1 - 1e-6)

    def strength(groups, center):
        n = sum(map(len, groups.values()))
        between = sum(len(v) * (np.mean(v) - center[k]) ** 2 for k, v in groups.items())
        within = sum(len(v) * center[k] * (1 - center[k]) for k, v in groups.items()) / n
        spread = max(between / n - within * len(groups) / n, 1e-6)
        return np.clip(within / spread - 1, 1, 1e6)

    kappa = strength(hosts, dict.fromkeys(hosts, mu))
    theta = {k: (sum(v) + kappa * mu) / (len(v) + kappa) for k, v in hosts.items()}
    lam = strength(paths, {k: theta[k[0]] for k in paths})
    out = []
    for host, path, e in rows:
        v = paths[host, path]
        site = np.clip((sum(v) - e + lam * theta[host]) / (len(v) - 1 + lam), 1e-6, 1 - 1e-6)
        odds = np.log(e / (1 - e)) + np.log(site / (1 - site)) - np.log(mu / (1 - mu))
        out.append((site, 1 / (1 + np.exp(-odds))))
    return out


@pytest.mark.parametrize("rows", [200_000, 0])
def test_posteriors_against_plain_loops(spark, monkeypatch, rows):
    monkeypatch.setattr(quality_classifier, "BROADCAST_ROWS", rows)
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    got = quality_classifier.classify(docs, spark.read.parquet(f"{d}/labels.parquet")).join(docs.select("doc_id", "source", "lang"), "doc_id").collect()
    want = brute_posteriors([(r["source"], r["lang"], r["evidence"]) for r in got])
    for r, (site, posterior) in zip(got, want):
        assert abs(r["site"] - site) < 1e-9 and abs(r["posterior"] - posterior) < 1e-6 and r["kept"] == (r["posterior"] >= 0.5)
    assert len({r["evidence"] for r in got}) > 100


# Shared folder and pipeline -----------------------------------------------------------------------------------


def test_cluster_needs_a_shared_folder():
    conf = types.SimpleNamespace(get=lambda k, d=None: d)
    session = types.SimpleNamespace(conf=conf, sparkContext=types.SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None))
    with pytest.raises(ValueError):
        common.shared_dir(session)


def test_scratch_is_removed(spark):
    import os

    with common.scratch(spark) as path:
        assert common.written(spark.range(3), "x").count() == 3 and os.path.isdir(path)
    assert not os.path.exists(path)


@pytest.mark.parametrize("ids", [True, False])
def test_ids_that_are_no_integers_are_refused_or_kept(spark, ids):
    from pyspark.errors import PySparkException

    docs = spark.createDataFrame([("a", "x y z")], "doc_id string, text string")
    if ids:
        assert tokens.encode(docs, tokens.word_vocabulary()).first()["doc_id"] == "a" and line_dedup.line_dedup(docs).first()["doc_id"] == "a"
    else:
        with pytest.raises(PySparkException):
            substring_dedup.remove_repeats(docs).collect()


def pipeline_docs(spark, tmp_path, rows, labels=((0, 1, 0),)):
    d = str(tmp_path / "sf")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, digest string, h string, key string")
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d, docs


def test_pipeline_with_odd_rows(spark, tmp_path):
    """Nulls in every column, empty texts, repeated rows, ties and extra columns with clashing names: one of each text stays, and nothing fails."""
    import corpus_pipeline as p

    rows = [(i, t, None, None, None, "x", None, "k") for i, t in enumerate(ODD)]
    rows += rows[3:6] + [(None, None, None, None, None, None, None, None), (None, "alone without an id here", "en", "s", 1, "a", "b", "c")]
    d, docs = pipeline_docs(spark, tmp_path, rows)
    now = docs
    for name, stage in p.STAGES[:-1]:
        now = stage(spark, now, d)
        assert now.columns == docs.columns, name
        now = spark.createDataFrame(now.collect(), now.schema)
    squeezed = lambda t: "".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")
    left = Counter(squeezed(r["text"]) for r in now.collect())
    assert left.pop("") == 2 and set(left.values()) == {1} and "alonewithoutanidhere" in left  # the empty text, and the one whose words all repeat
    lib, whole = library(tokens.word_vocabulary()), p.run(spark, d).collect()
    assert {r["doc_id"] for r in whole} == {r["doc_id"] for r in now.collect()}
    assert sum(r["length"] for r in whole) == sum(len(lib.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in now.collect())


def test_pipeline_of_nothing(spark, tmp_path):
    import corpus_pipeline as p

    d, docs = pipeline_docs(spark, tmp_path, [])
    assert p.run(spark, d).count() == 0


def test_fit_in_batches():
    rng = np.random.default_rng(3)
    x = rng.random((60, 40)).astype(np.float16)
    y, ids = (x[:, 0] > 0.5).astype(float), rng.permutation(60)

    def batch(a, b):
        return pa.record_batch([pa.array(ids[a:b]), pa.array(y[a:b]), pa.array([r.tobytes() for r in x[a:b]], pa.binary())], ["id", "y", "x"])

    order = np.argsort(ids)
    whole = quality_classifier.fit(x[order].astype(np.float32), y[order])
    for cuts in ([0, 60], [0, 1, 1, 25, 60]):
        (got,) = quality_classifier.fitted(batch(a, b) for a, b in zip(cuts, cuts[1:]))
        assert np.array_equal(np.frombuffer(got.column(0)[0].as_py()), whole)
    assert not list(quality_classifier.fitted(iter([])))
    assert not list(quality_classifier.fitted(pa.record_batch([pa.array(ids[k]), pa.array(y[k]), pa.array([r.tobytes() for r in x[k]], pa.binary())], ["id", "y", "x"]) for k in [y > 0]))


def colliding():
    """Two words of 64 letters with one xxhash64 (seed 42): the second stripe of a lane makes up for the first."""
    p1, p2, m = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, (1 << 64) - 1
    rng = np.random.default_rng(0)
    back, start = pow(p2, -1, 1 << 64), (42 + p1 + p2) & m
    turned = lambda x: ((x << 31) | (x >> 33)) & m
    after = lambda x: turned((start + x * p2) & m) * p1 & m
    letters = lambda n: bytes(rng.integers(97, 123, n).astype(np.uint8))
    number = lambda b: int.from_bytes(b, "little")
    while True:
        a, b, x = letters(8), letters(8), letters(8)
        y = ((number(x) + (after(number(a)) - after(number(b))) * back) & m).to_bytes(8, "little")
        if a != b and all(33 <= c < 127 for c in y):
            rest, more = letters(24), letters(24)
            return (a + rest + x + more).decode(), (b + rest + y + more).decode()


def test_lines_with_colliding_words(spark):
    """Tokens, lines and templates are told apart by themselves: two words of one xxhash64 are two words."""
    a, b = colliding()
    one = spark.createDataFrame([(a, b)], "a string, b string").select(F.xxhash64("a") == F.xxhash64("b")).first()
    assert a != b and one[0]
    lines = [f"{i}a {i}b {i}c one two three four five six {a if i < 3 else b}" for i in range(5)]
    got = line_dedup.line_dedup(documents(spark, lines)).collect()
    assert [r["n_dropped"] for r in got] == [0] * 5
    same = [f"{i}a {i}b {i}c one two three four five six {a}" for i in range(5)]
    assert [r["n_dropped"] for r in line_dedup.line_dedup(documents(spark, same)).collect()] == [1] * 5
    long = ["x" * 70_000 + f" tail of {w} it" for w in (a, a, a, b, b)]  # leading tokens and lines beyond any length
    assert [r["n_dropped"] for r in line_dedup.line_dedup(documents(spark, long)).collect()] == [1] * 5
    pair = spark.createDataFrame([(a * 40, b * 40)], "a string, b string").select(common.row_key(F.col("a")), common.row_key(F.col("b"))).first()
    assert pair[0] != pair[1] and len(pair[0]) == 16


def test_sites_beyond_the_broadcast(spark, monkeypatch):
    """The verdicts are those of the broadcast, whatever the number of sites, with a site of most documents."""
    texts = [f"good words in a row {i}" if i % 2 else f"bad {i} $$$ buy" for i in range(80)]
    docs = documents(spark, texts).withColumn("source", F.when(F.col("doc_id") < 60, "hot").otherwise(F.concat(F.lit("s"), F.col("doc_id"))))
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    want = {r["doc_id"]: round(r["posterior"], 9) for r in quality_classifier.classify(docs, labels).collect()}
    monkeypatch.setattr(quality_classifier, "BROADCAST_ROWS", 1)
    monkeypatch.setattr(common, "HOT", 3)
    assert {r["doc_id"]: round(r["posterior"], 9) for r in quality_classifier.classify(docs, labels).collect()} == want
