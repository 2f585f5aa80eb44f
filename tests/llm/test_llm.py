"""Operators of the subpackage against SQL, the tokenizers library and brute force, with odd inputs."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from oracle import SF, check
from pyspark.sql import functions as F

from textquarry.llm import bpe, common, components, exact_dedup, line_dedup, minhash_dedup, packing, planes, quality_classifier, quality_rules, queries, substring_dedup, tokens, warc
from textquarry.llm.common import shared_path

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
DOC = "doc_id long, text string, lang string, source string, n_chars long, kept string, ids string, h string, row string, text_sha256 string"


def documents(spark, texts, ids=None):
    """Documents with clashing extra columns; texts may be null."""
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, "en" if k % 2 else None, "src1" if k % 3 else None, None, "x", "y", "z", "r", "s") for k, (i, t) in enumerate(zip(ids, texts))]
    return spark.createDataFrame(rows, DOC)


ODD = [None, "", " \t\n", "a", "one two", "é ü ñ 日本", "word " * 6000, "x" * 50_000, "\x00 \x0b\x1c\x85", "a b c d e f g h", "a b c d e f g h", "<|endoftext|> hi", "don't <|startoftext|>", "\n\n\n", "line one\nline one\n"]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, name):
    assert check(spark, queries.QUERIES[name], queries.ORACLES[name]) > 0


# Tokens -------------------------------------------------------------------------------------------------------


def library(path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_padding()
    t.no_truncation()
    return t


def fuzz(n=400, seed=3):
    rng = np.random.default_rng(seed)
    parts = list("aaabceéßΣσς İI'sS tT  \n\t\x1c\x85  12٣½!?.,-<|> 日本é🙂\x00") + ["<|endoftext|>", "<|startoftext|>", "the ", "'re", " \n ", "aaaa"]
    return ["".join(rng.choice(parts, rng.integers(0, 40))) for _ in range(n)]


@pytest.mark.parametrize("path", [tokens.word_vocabulary(), tokens.byte_vocabulary()])
def test_encoder_equals_the_library(path):
    texts = [t or "" for t in ODD] + fuzz()
    ids, sizes = bpe.load(path).encode_batch(pa.array(texts, pa.string()))
    lib = library(path)
    for text, got in zip(texts, np.split(ids, np.cumsum(sizes)[:-1])):
        want = lib.encode(text, add_special_tokens=False).ids
        assert got.tolist() == want, repr(text)
        assert bpe.load(path).decode(want) == lib.decode(want, skip_special_tokens=False), repr(text)


def test_encode_decode_frames(spark):
    path, lib = tokens.word_vocabulary(), library(tokens.word_vocabulary())
    df = documents(spark, ODD)
    got = tokens.decode(tokens.encode(df, path), path).orderBy("doc_id").collect()
    assert len(got) == len(ODD)
    for r, t in zip(got, ODD):
        want = lib.encode(t or "", add_special_tokens=False).ids
        assert (r["ids"], r["n_tokens"], r["decoded"]) == (want, len(want), lib.decode(want, skip_special_tokens=False))
    assert tokens.encode(df.limit(0), path).count() == 0
    q = queries.QUERIES["op2_bpe_encode"](spark, SF).first()
    text = spark.read.parquet(f"{SF}/documents.parquet").where(F.col("doc_id") == q["doc_id"]).first()["text"]
    ids = lib.encode(text, add_special_tokens=False).ids
    assert q["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() and q["decoded_sha256"] == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def check_packing(pieces, encoded):
    """Pieces tile each document and sequences are gapless; returns padding and tokens."""
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in pieces:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    for doc, ids in encoded.items():
        at = 0
        for r in sorted(by_doc[doc], key=lambda r: r["start"]):
            assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    padding = 0
    for rows in by_seq.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert len({r["context"] for r in pieces}) >= 1
    return padding, sum(map(len, encoded.values()))


def test_packing(spark):
    lib = library(tokens.word_vocabulary())
    want = lambda rows: {r["doc_id"]: lib.encode(r["text"] or "", add_special_tokens=False).ids + [1] for r in rows}
    docs = documents(spark, ODD).coalesce(1)
    check_packing(packing.with_crc(packing.pack(docs, tokens.word_vocabulary())).collect(), want(docs.collect()))
    real = spark.read.parquet(f"{SF}/documents.parquet")
    pieces = queries.QUERIES["op3_pack"](spark, SF).collect()
    padding, n = check_packing(pieces, want(real.collect()))
    assert padding <= 2048 * real.rdd.getNumPartitions() and padding < 0.02 * n
    assert packing.pack(docs.limit(0), tokens.word_vocabulary()).count() == 0


def test_steps_are_balanced():
    windows = [(256, [(n, 0, 0), (256 - n, 1, 0)]) for n in range(1, 129)]
    counts = {512: 0, 256: 0}
    steps = defaultdict(list)
    for t, w, s in packing.stepped(windows, [512, 256], 4, counts):
        steps[s].append(sum(x[0] ** 2 for x in w))
    assert {len(x) for x in steps.values()} == {8}
    cost = [sum(x) for x in steps.values()]
    assert max(cost) / min(cost) < 1.1


@pytest.mark.parametrize("kind", ["bit", "byte"])
def test_planes_round_trip(tmp_path, kind):
    from textquarry.llm.files import new_file, open_file

    ids = np.random.default_rng(0).integers(0, 50_257, 10_001).astype(np.int32)
    with new_file(str(tmp_path), "s", ".planes") as (out, path):
        w = planes.ShardWriter(out, kind, 4096)
        for part in np.array_split(ids, 7):
            w.add(part)
        w.close([1, None], [10_000, 1])
    with open_file(path) as f:
        r = planes.ShardReader(f)
        assert (r.ids(0, 10_001) == ids).all() and (r.ids(4090, 4100) == ids[4090:4100]).all()
        assert r.footer["keys"] == [1, None]


def test_shards(spark):
    path, lib = tokens.byte_vocabulary(), library(tokens.byte_vocabulary())
    docs = documents(spark, ODD, ids=[None, 3, 3, *range(4, 16)]).repartition(3)
    got = planes.read_shards(planes.write_shards(docs, shared_path(spark, "t"), path)).collect()
    assert len(got) == len(ODD)
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at and len(r["ids_le"]) == 4 * r["n_tokens"]
        at += r["n_tokens"]
    own = {r["doc_id"]: np.frombuffer(r["ids_le"], "<u4").tolist() for r in got}
    for i, t in zip(range(4, 16), ODD[3:]):
        assert own[i] == lib.encode(t, add_special_tokens=False).ids + [2]
    keys = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0))
    assert planes.read_shards(planes.write_shards(docs.limit(0), shared_path(spark, "t"), path)).count() == 0


# Archives -----------------------------------------------------------------------------------------------------


def test_archives(spark, tmp_path):
    big = "é" * 600
    rows = [(1, "http://a\r\nX: y", big), (2, None, big), (None, "u", big), (4, "u", None), (5, "u", "short"), (6, "u", "short"), (2, None, big), (8, "u", "x" * 5000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1)).withColumn("digest", F.lit(2))
    index = warc.write_bundles(pages, shared_path(spark, "w"))
    got = warc.read_bundles(index).collect()
    assert len(got) == len(rows)
    kinds = Counter((r["page_id"], r["record_type"], r["refers_to"]) for r in got)
    assert kinds == Counter([(1, "revisit", 2), (2, "response", None), (2, "response", None), (None, "revisit", 2), (4, "response", None), (5, "response", None), (6, "response", None), (8, "response", None)])
    one = next(r for r in got if r["page_id"] == 1)
    assert one["payload_bytes"] == 1200 and one["payload_digest"] == hashlib.sha1(big.encode()).hexdigest() and one["payload"] is None
    for r in index.collect():
        assert warc.read_record(r["path"], r["frame"], r["offset"], r["size"])["page"] == r["page"]
    assert warc.read_bundles(warc.write_bundles(pages.limit(0), shared_path(spark, "w"))).count() == 0


def test_frames_and_bundles(spark, monkeypatch):
    """Records share frames, bundles are several, a hot payload is dealt over tasks, one page is larger than a batch of the reader."""
    from textquarry.llm.files import open_file

    monkeypatch.setattr(common, "HOT", 3)
    rng = np.random.default_rng(0)
    texts = ["same page " * 200] * 50 + [f"page {i} " + "words of it " * int(rng.integers(1, 400)) for i in range(100)] + ["ü" * (9 << 20)]
    pages = spark.createDataFrame([(i, "u", t) for i, t in enumerate(texts)], "page_id long, url string, html string").repartition(2)
    index = warc.write_bundles(pages, shared_path(spark, "w"), frame=4096, bundle=40_000)
    rows = index.collect()
    paths = {r["path"] for r in rows}
    assert len(paths) > 2 and max(Counter((r["path"], r["frame"]) for r in rows).values()) > 3 and any(r["offset"] for r in rows)
    for path in paths:
        with open_file(path) as f:
            places = warc.seek_table(f)
            assert len(places) == len({r["frame"] for r in rows if r["path"] == path})
            sizes = [len(warc.read_frame(f, *p)) for p in places]
        for r in rows:
            assert r["path"] != path or r["offset"] + r["size"] <= sizes[r["frame"]]
    got = {r["page_id"]: r for r in warc.read_bundles(index).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert (got[i]["record_type"], got[i]["refers_to"]) == (("revisit", 49) if i < 49 else ("response", None))
        assert got[i]["payload_digest"] == hashlib.sha1(t.encode()).hexdigest() and (got[i]["payload"] is None or got[i]["payload"].decode() == t)
    one = max(rows, key=lambda r: r["size"])
    assert len(warc.read_record(one["path"], one["frame"], one["offset"], one["size"])["payload"]) == 18 << 20
    alone = warc.write_bundles(pages, shared_path(spark, "w"), frame=1).select("path").distinct()
    size = lambda df: sum(__import__("os").path.getsize(r["path"].removeprefix("file://").removeprefix("file:")) for r in df.collect())
    assert size(index.select("path").distinct()) < size(alone)


# Duplicates ---------------------------------------------------------------------------------------------------


def test_exact(spark):
    texts, ids = ["a b", "ab", "a  b", None, "", "\n", "ab", "c"], [5, 1, 7, 2, 3, None, 1, 9]
    got = exact_dedup.exact_dedup(documents(spark, texts, ids)).collect()
    assert len(got) == 8
    kept = [(r["doc_id"], r["keep_id"], r["group_size"]) for r in got if r["kept"]]
    assert sorted(kept, key=str) == sorted([(7, 7, 4), (9, 9, 1), (None, None, 3)], key=str)
    assert sum(r["kept"] for r in got) == 3
    assert exact_dedup.exact_dedup(documents(spark, texts, ids).limit(0)).count() == 0
    hot = documents(spark, ["same"] * 300 + [f"t{i}" for i in range(50)])
    assert exact_dedup.exact_dedup(hot).where("kept").count() == 51
    assert exact_dedup.keep_first(hot).count() == 51


def shingle_sets(texts, k):
    out = []
    for t in texts:
        w = WORDS.findall("".join(c.lower() if c.isascii() else c for c in t or ""))
        out.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set()))
    return out


def brute_components(texts, ids, k, percent):
    sets = shingle_sets(texts, k)
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(texts)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            root[find(i)] = find(j)
    low = {}
    for i in range(len(texts)):
        low[find(i)] = min(low.get(find(i), math.inf), ids[i])
    return {ids[i]: (len(sets[i]), low[find(i)]) for i in range(len(texts))}


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates_against_all_pairs(spark, k):
    rng = np.random.default_rng(k)
    vocab = [f"w{i}" for i in range(2000)]
    texts = list(ODD)
    for family in range(12):  # chains of edited copies around the threshold
        words = list(rng.choice(vocab, rng.integers(40, 160)))
        for _ in range(14):
            texts.append((" " if family % 2 else "\n").join(words))
            base = words if rng.random() < 0.6 else list(words)
            for _ in range(rng.integers(1, 4)):
                base[rng.integers(len(base))] = rng.choice(vocab)
            words = base
    ids = list(range(100, 100 + len(texts)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash_dedup.near_duplicates(documents(spark, texts, ids), k=k).collect()}
    assert got == brute_components(texts, ids, k, 80)


def test_near_duplicates_odd_rows(spark):
    text = "one two three four five six"
    got = minhash_dedup.near_duplicates(documents(spark, [text, text, text, None, ""], [None, 4, 4, None, 2]), k=4).collect()
    assert len(got) == 5 and sum(r["kept"] for r in got) == 3
    assert {r["component_id"] for r in got if r["n_shingles"]} == {4}
    assert minhash_dedup.near_duplicates(documents(spark, [text]).limit(0)).count() == 0


def test_blocks_of_a_bucket():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 5000, 300)).astype(np.uint32) for _ in range(20)]
    want = [[len(set(a) & set(b)) for b in sets[8:]] for a in sets[:8]]
    assert (minhash_dedup.common_counts(sets[:8], sets[8:]) == want).all()


def test_estimates():
    rng = np.random.default_rng(1)
    for share in (0.3, 0.8):
        x = rng.integers(0, 2**63, 2000).astype(np.uint64)
        n = round(1000 * 2 * share / (1 + share))
        a, b = x[:1000], x[1000 - n : 2000 - n]
        r = minhash_dedup.registers(np.concatenate([a, b]), np.array([1000, 1000]), 512)
        assert abs(minhash_dedup.estimate(r[:1], r[1:], np.array([1000.0]), np.array([1000.0]))[0] - share) < 0.08
        both = minhash_dedup.registers(np.concatenate([a, b]), np.array([2000]), 512)
        assert (np.maximum(r[0], r[1]) == both[0]).all()


def test_components(spark):
    n = 40
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(100, 101)], "a long, b long")
    got = {r["node"]: r["comp"] for r in components.components(edges).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 100: 100, 101: 100}
    assert components.components(edges.limit(0)).count() == 0


def brute_removal(texts, size):
    words = [WORDS.findall(t or "") for t in texts]
    count = Counter(tuple(w[i : i + size]) for w in words for i in range(len(w) - size + 1))
    out = []
    for w in words:
        gone = {i + j for i in range(len(w) - size + 1) if count[tuple(w[i : i + size])] > 1 for j in range(size)}
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


@pytest.mark.parametrize("size,gram", [(35, 16), (35, 35), (5, 2), (3, 1)])
def test_substrings_against_all_windows(spark, size, gram):
    rng = np.random.default_rng(size)
    vocab = [f"v{i}" for i in range(30 if size < 10 else 3000)]
    passage = list(rng.choice(vocab, 60))
    texts = [*ODD, "a b " * 100, *(" ".join([*rng.choice(vocab, rng.integers(0, 90)), *(passage[: rng.integers(0, 60)] if i % 2 else []), *rng.choice(vocab, 20)]) for i in range(40))]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in substring_dedup.remove_repeats(documents(spark, texts).repartition(3), size=size, gram=gram).collect()}
    assert [got[i] for i in range(len(texts))] == brute_removal(texts, size)


def test_substrings_odd_rows(spark):
    text = " ".join(map(str, range(50)))
    got = substring_dedup.remove_repeats(documents(spark, [text, text, None, ""], [1, 1, None, None]), others=("lang",)).collect()
    assert sorted((r["n_removed"], r["text"] or "") for r in got) == [(0, ""), (0, ""), (50, text), (50, text)]
    assert substring_dedup.remove_repeats(documents(spark, [text]).limit(0)).count() == 0


def test_sketch_never_counts_low():
    keys = np.random.default_rng(0).integers(0, 300, 400).astype(np.uint64)
    for c in substring_dedup.cells(keys, 16):
        seen = np.bincount(c, minlength=1 << 16)
        assert (seen[c] >= np.array([Counter(keys.tolist())[k] for k in keys.tolist()])).all()


# Lines, rules, classifier -------------------------------------------------------------------------------------


def test_line_templates(spark):
    texts = [f"request {i} took {i * 7} ms on the host of today\nown words of document number{i} {i}x{i} q{'abcdefghij'[i]} z{'abcdefghij'[i]}" for i in range(8)]
    got = line_dedup.line_dedup(documents(spark, [*texts, None, "", *texts[:1]])).orderBy("doc_id").collect()
    assert len(got) == 11
    for r, t in zip(got, texts):
        assert (r["n_lines"], r["n_dropped"]) == (2, 1) and r["kept_text"] == t.split("\n")[1]
    assert got[8]["kept_text"] == "" and got[9]["n_dropped"] == 0
    assert line_dedup.line_dedup(documents(spark, texts).limit(0)).count() == 0
    few = line_dedup.line_dedup(documents(spark, texts[:4])).collect()
    assert all(r["n_dropped"] == 0 for r in few)


def brute_measures(text):
    text = text or ""
    w = WORDS.findall(text)
    tri = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    rep = {i + j for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    return (len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(rep))


def test_rules(spark):
    texts = [*ODD, "a a a a", "# $ % |", *fuzz(80, 5), "p q r s p q r t p q r"]
    led = quality_rules.ledger(documents(spark, texts))
    got = {r["doc_id"]: (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in led.collect()}
    assert [got[i] for i in range(len(texts))] == [brute_measures(t) for t in texts]
    rows = {r["rule"]: r for r in quality_rules.ablations(led, "v2").collect()}
    kept = quality_rules.verdict(led, "v2").where("kept").count()
    for k, rule in enumerate(quality_rules.RULES):
        masks = [r["failures"] for r in led.collect()]
        assert rows[rule]["n_failed"] == sum(m >> k & 1 for m in masks)
        assert rows[rule]["n_only"] == sum(m == 1 << k for m in masks) and rows[rule]["n_kept_without"] == kept + rows[rule]["n_only"]
    assert quality_rules.ledger(documents(spark, texts).limit(0)).count() == 0


def test_classifier_on_held_out_labels(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    half = labels.where("doc_id % 2 = 0")
    got = quality_classifier.classify(docs, half).join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    assert len(got) > 100
    right = sum(r["kept"] == (r["quality"] == 1) for r in got) / len(got)
    assert right > 0.97
    assert sum(r["kept"] for r in got if r["quality"] == 1) / sum(r["quality"] == 1 for r in got) > 0.98


def test_classifier_odd_rows(spark):
    docs = documents(spark, ODD, [None, 1, 1, *range(3, 15)])
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    got = quality_classifier.classify(docs, none).collect()
    assert len(got) == len(ODD) and all(r["kept"] for r in got)
    labels = spark.createDataFrame([(3, 0), (4, 1), (5, 1)], "doc_id long, quality int")
    assert quality_classifier.classify(docs, labels).count() == len(ODD)
    assert quality_classifier.classify(docs.limit(0), labels).count() == 0


def test_shrinkage(spark):
    """Sparse sites go to their parents' mean, large ones to their own."""
    rows = spark.createDataFrame([("a", 1000, 900.0), ("b", 2, 0.0), ("c", 1000, 500.0)], "host string, n long, s double")
    kappa = quality_classifier.strength(rows, "0.7D")
    post = lambda n, s: (s + kappa * 0.7) / (n + kappa)
    assert abs(post(1000, 900) - 0.9) < 0.05 and abs(post(2, 0) - 0.7) < abs(post(2, 0) - 0.0) + 0.4


# Pipeline -----------------------------------------------------------------------------------------------------


def test_pipeline_against_brute_force(spark, tmp_path):
    """Planted cases: junk, exact and near copies, a shared passage."""
    import corpus_pipeline as p

    rng = np.random.default_rng(9)
    vocab = ["".join(rng.choice(list("abcdefghijklmnop"), rng.integers(2, 8))) for _ in range(3000)]
    make = lambda n: " ".join(rng.choice(vocab, n)) + "."
    passage = make(60)
    texts = [make(120) for _ in range(30)]
    texts += [" ".join(w + "***" for w in make(120).split()) for _ in range(30)]  # junk
    texts += [texts[0], texts[1].replace(" ", "  "), texts[2] + " tail", f"{make(80)}\n{passage}", f"{make(70)}\n{passage}"]
    labels = [(i, 1, 0) for i in range(20)] + [(i, 0, 0) for i in range(30, 50)]
    d = str(tmp_path / "sf")
    docs = spark.createDataFrame([(i, t, "en", f"src{i % 3}", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    now, kept = docs, []
    for name, stage in p.STAGES[:-1]:
        now = stage(spark, now, d)
        assert sorted(now.columns) == sorted(docs.columns), name
        now = spark.createDataFrame(now.collect(), docs.schema)
        kept.append({r["doc_id"]: r["text"] for r in now.collect()})
    assert set(kept[0]) == {*range(30), *range(60, 65)}
    assert set(kept[1]) == {*range(30), 61, 62, 63, 64} - {1}
    assert set(kept[2]) == set(kept[1]) - {62}
    assert kept[3][63] == texts[63].split("\n")[0] and kept[3][64] == texts[64].split("\n")[0] and kept[3][5] == texts[5]
    lib = library(tokens.word_vocabulary())
    want = {i: lib.encode(t, add_special_tokens=False).ids + [1] for i, t in kept[3].items()}
    check_packing(p.run(spark, d).collect(), want)


def test_pipeline_keeps_one_of_repeated_rows(spark, tmp_path):
    """Copies that share an id or have none: one stays, and the substring stage leaves it whole. Different texts without an id all stay."""
    import corpus_pipeline as p

    rng = np.random.default_rng(10)
    vocab = ["".join(rng.choice(list("abcdefghijklmnop"), rng.integers(2, 8))) for _ in range(3000)]
    make = lambda n: " ".join(rng.choice(vocab, n)) + "."
    texts = [make(120) for _ in range(26)]
    rows = list(enumerate(texts[:20])) + [(3, texts[3]), (3, texts[3]), (4, texts[4].replace(" ", "  ")), (30, texts[3])]
    rows += [(None, texts[20])] * 3 + [(None, t) for t in texts[21:24]] + [(None, texts[24]), (24, texts[24]), (None, texts[25]), (None, texts[25] + " ")]
    docs = spark.createDataFrame([(i, t, "en", "src1", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    want = Counter([(i, t) for i, t in enumerate(texts[:20]) if i != 4] + [(4, texts[4].replace(" ", "  "))] + [(None, t) for t in texts[20:24]] + [(24, texts[24]), (None, texts[25] + " ")])
    assert Counter((r["doc_id"], r["text"]) for r in exact_dedup.keep_first(docs).collect()) == want
    d, now = str(tmp_path), docs
    for name, stage in p.STAGES[1:-1]:
        now = stage(spark, now, d)
        assert now.columns == docs.columns, name
        now = spark.createDataFrame(now.collect(), docs.schema)
        assert Counter((r["doc_id"], r["text"]) for r in now.collect()) == want, name
