"""Near-duplicate groups by SetSketch registers.

A document's set is the set of hashes of its word shingles: 96 bits, mixed with a key
that is drawn for each run, so that no text can be made to agree with another. Register i of its
SetSketch is the truncated logarithm, to a base near 1, of the smallest of
exponentially distributed values of the elements; sketches of parts merge by
the larger register. Documents with equal sets are one node. Runs of registers
are band keys; nodes that share a band are candidates. For a pair, the Jaccard
similarity is estimated by maximum likelihood jointly from the numbers of larger,
smaller and equal registers and both set sizes; pairs that come near the
threshold are verified on their full sets.

With 32 bands of 4 registers, a pair of similarity 0.8 shares no band with a
probability below 1e-7, and a verified pair is discarded by the estimate with one
of about 1e-6 (five standard errors).

Keys with very many rows (a bucket, its smallest node, a group, equal sets) are dealt over
several tasks. No group is expanded into all its pairs. In a first round each bucket's members
are compared with its smallest node, in a second one those that are not yet
connected with another member drawn by hash. Buckets that are then still not of one
component are cut into blocks of bounded size; intersections of the sets of two blocks
are matrix products inside a task, from which only pairs at the threshold come out, to be
estimated and verified like all others. So no link between
members of a bucket is lost, and rows follow members times blocks, not pairs.

Null, empty and blank texts have empty sets and stand alone. Repeated rows and
rows with equal sets fall into one group. Ids are integers; others are refused by the cast. A group's id is its smallest
non-null id; of rows with this id one is kept. An empty table gives no rows.
Columns other than the two that are named are not looked at. Long texts are
hashed as bytes, without an object for each word.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.llm.common import col, hot_keys, row_key, salted_join, table, text_of, written
from textquarry.llm.components import components
from textquarry.llm.spans import U, give_back, keyed, names, new_key, seeds, utf8, words
from textquarry.llm.spans import joined as paired
from textquarry.llm.tokens import slices

REGISTERS = 128
ROWS = 4
#: Base of the truncated logarithms and the largest register.
BASE, TOP, SHIFT = 1.001, 65535, 4000
#: Standard errors by which an estimate may miss the threshold.
SLACK = 5
#: Bytes of text that are hashed together, about.
PART = 2 << 20
#: Members of a block of a bucket, and values in their sets, about.
BLOCK, BLOCK_VALUES = 1024, 2_000_000


def shingles(texts: pa.Array, k: int, key: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of each text in a row, as 64 and another 32 bits, and their numbers; of fewer words, the whole sequence is one."""
    raw, starts, ends = utf8(texts)
    first, last, n = words(raw, starts, ends)
    low, high = names(raw, first, last, lower=True)
    stop = np.cumsum(n)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    at = np.repeat((stop - n) - (np.cumsum(count) - count), count) + np.arange(count.sum())
    size = np.repeat(np.minimum(n, k), count)
    out = []
    for lane in (key, key + 7):
        h, acc = keyed(low, high, lane), size.astype(U)
        for j in range(k):
            if (use := j < size).all():
                acc = paired(acc, h[at + j], lane)
            else:
                acc[use] = paired(acc[use], h[at[use] + j], lane)
        out.append(acc)
    return out[0], (out[1] >> U(32)).astype(np.uint32), count


def registers(values: np.ndarray, counts: np.ndarray, m: int = REGISTERS) -> np.ndarray:
    """SetSketch of each non-empty run of values: a row of m 16-bit registers."""
    starts = (np.cumsum(counts) - counts)[counts > 0]
    out = np.empty((len(starts), m), np.uint16)
    for i, a in enumerate(seeds(m, 11) | U(1)):
        low = np.minimum.reduceat(values * a, starts) if len(starts) else np.zeros(0, U)
        h = -np.log1p(-(low.astype(np.float64) + 1) / 2.0**64)
        out[:, i] = np.clip(np.floor(SHIFT + 1 - np.log(h) / np.log(BASE)), 0, TOP)
    return out


def estimate(left: np.ndarray, right: np.ndarray, n_left: np.ndarray, n_right: np.ndarray, grid: int = 101) -> np.ndarray:
    """The most likely Jaccard similarity of each pair of sketches, given both set sizes."""
    more, less = (left > right).sum(1), (left < right).sum(1)
    same = left.shape[1] - more - less
    u = n_left / (n_left + n_right)
    v = 1 - u
    most = np.minimum(u / v, v / u)
    p = lambda x: -np.log(np.maximum(1 - x * (BASE - 1) / BASE, 1e-300)) / np.log(BASE)
    best, at = np.full(len(u), -np.inf), np.zeros(len(u))
    for step in np.linspace(0, 1, grid):
        j = most * step
        up, down = np.maximum(p(np.maximum(u - v * j, 0)), 1e-9), np.maximum(p(np.maximum(v - u * j, 0)), 1e-9)
        score = more * np.log(up) + less * np.log(down) + same * np.log(np.maximum(1 - up - down, 1e-9))
        better = score > best
        best[better], at[better] = score[better], j[better]
    return at


def parts(batches, text_at: int):
    """Runs of rows with about PART bytes of text each."""
    for batch in batches:
        column = batch.column(text_at).cast(pa.large_string())
        offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
        for a, b in slices(batch, np.diff(offsets), PART):
            yield batch.slice(a, b - a)
    give_back()


def merged(*sketches: np.ndarray) -> np.ndarray:
    """The sketch of a union from those of its parts."""
    return np.maximum.reduce(sketches)


def distinct(values: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different pairs of value and more, in order."""
    by = np.argsort(values)
    x, y = values[by], more[by]
    if ((x[1:] == x[:-1]) & (y[1:] != y[:-1])).any():
        by = np.lexsort((more, values))
        x, y = values[by], more[by]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    return x[new], y[new]


def sets_of(texts: pa.Array, k: int, key: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """The set of each text, and the sketches of the non-empty ones."""
    values, more, counts = shingles(texts, k, key)
    ends = np.cumsum(counts)
    return [distinct(values[a:b], more[a:b]) for a, b in zip((ends - counts).tolist(), ends.tolist())], registers(values, counts)


def sketches(rows: DataFrame, k: int, key: int) -> DataFrame:
    """id, h, n (set size), digest (of the set) and sketch for rows (id, h, text)."""

    def run(batches):
        for part in parts(batches, 2):
            sets, made = sets_of(part.column(2), k, key)
            made = iter(made)
            yield pa.record_batch(
                [
                    part.column(0),
                    part.column(1),
                    pa.array([len(x) for x, _ in sets], pa.int64()),
                    pa.array([hashlib.blake2b(x.tobytes() + y.tobytes(), digest_size=16).digest() for x, y in sets], pa.binary()),
                    pa.array([next(made).tobytes() if len(x) else None for x, _ in sets], pa.binary()),
                ],
                ["id", "h", "n", "digest", "sketch"],
            )

    return rows.mapInArrow(run, "id long, h binary, n long, digest binary, sketch binary")


def full_sets(rows: DataFrame, k: int, key: int) -> DataFrame:
    """node, set (sorted 64-bit hashes) and more (32 other bits of each) for rows (node, text)."""

    def run(batches):
        for part in parts(batches, 1):
            values, more, counts = shingles(part.column(1), k, key)
            ends = np.cumsum(counts)
            sets = [distinct(values[a:b], more[a:b]) for a, b in zip((ends - counts).tolist(), ends.tolist())]
            yield pa.record_batch([part.column(0), *(pa.array([s[i].tobytes() for s in sets], pa.binary()) for i in (0, 1))], ["node", "set", "more"])

    return rows.mapInArrow(run, "node long, set binary, more binary")


def common_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each left with each right set, as products of 0/1 matrices over the values that occur twice or more."""
    both = left + right
    owner = np.repeat(np.arange(len(both)), list(map(len, both)))
    values = np.concatenate(both)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    new = np.concatenate([[True], values[1:] != values[:-1]]) if len(values) else np.zeros(0, bool)
    column = np.cumsum(new) - 1
    often = np.bincount(column)[column] > 1 if len(values) else new
    values, owner = np.unique(column[often], return_inverse=True)[1], owner[often]
    out = np.zeros((len(left), len(right)), np.float32)
    width = 2048
    cuts = np.searchsorted(values, np.arange(0, (values[-1] + 1 if len(values) else 0) + width, width))
    for c, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
        m = np.zeros((len(both), width), np.float32)
        m[owner[a:b], values[a:b] - c * width] = 1
        out += m[: len(left)] @ m[len(left) :].T
    return out


def near_bound(percent: int) -> float:
    """What an estimate must reach."""
    t = percent / 100
    return t - SLACK * (t * (1 - t) / REGISTERS) ** 0.5


def apart_links(open_: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of one bucket but different components that may be linked, from rows (band, node, n, comp, blocks).

    A bucket is cut into blocks of bounded size; each pair of blocks is one group, in which the sizes of all intersections come
    from matrix products. Only pairs that reach the threshold leave the task. The 32 bits of a hash that it looks at
    never make an intersection smaller by more than the values that a set loses to equal ones, which are added;
    the links are estimated and verified on the full hashes after this.
    """

    def run(key, part):
        _, low, high = (k.as_py() for k in key)
        block, node, comp, n = (part.column(c).to_numpy() for c in ("block", "node", "comp", "n"))
        small = [np.unique(np.frombuffer(x, np.uint32)) for x in part.column("more").to_pylist()]
        one, two = np.flatnonzero(block == low), np.flatnonzero(block == high)
        if not len(one) or not len(two):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        lost = n - np.fromiter(map(len, small), np.int64, len(small))
        common = common_counts([small[i] for i in one], [small[i] for i in two]) + np.minimum(lost[one][:, None], lost[two][None, :])
        near = 100 * common >= percent * (n[one][:, None] + n[two][None, :] - common)
        near &= comp[one][:, None] != comp[two][None, :]
        i, j = np.nonzero(near)
        a, b = node[one][i], node[two][j]
        pairs = np.unique(np.column_stack([np.maximum(a, b), np.minimum(a, b)]), axis=0)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    own = open_.withColumn("block", F.pmod(F.xxhash64("node", "band"), F.col("blocks")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    dealt = own.withColumn("other", other).select("band", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "node", "n", "comp")
    dealt = dealt.join(sets.select("node", "more"), "node")
    return dealt.groupBy("band", "low", "high").applyInArrow(run, "a long, b long").distinct()


def likely(pairs: DataFrame, nodes: DataFrame, percent: int, hot: list | None) -> DataFrame:
    """Pairs (a, b) whose sizes allow the threshold and whose estimate comes near it."""
    bound = near_bound(percent)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("sa", "sb"))
            near = estimate(left, right, *(np.array(batch.column(c), np.float64) for c in ("na", "nb"))) >= bound
            yield batch.filter(pa.array(near)).select(["a", "b"])

    own = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    joined = salted_join(pairs.join(own("a"), "a"), own("b"), "b", hot, ["a"]).where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
    return joined.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame, percent: int, hot: list | None) -> DataFrame:
    """The pairs (a, b) that are linked: 100 * intersection >= percent * union of the full sets."""

    def run(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, row in enumerate(zip(*(batch.column(c).to_pylist() for c in ("xa", "xb", "ya", "yb")))):
                (xa, xb), (ya, yb) = (np.frombuffer(v, U) for v in row[:2]), (np.frombuffer(v, np.uint32) for v in row[2:])
                x, y = np.concatenate([xa, xb]), np.concatenate([ya, yb])
                common = len(x) - len(distinct(x, y)[0])
                keep[i] = 100 * common >= percent * (len(x) - common)
            yield batch.filter(pa.array(keep)).select(["a", "b"])

    own = lambda x: sets.select(F.col("node").alias(x), F.col("set").alias(f"x{x}"), F.col("more").alias(f"y{x}"))
    return salted_join(pairs.join(own("a"), "a"), own("b"), "b", hot, ["a"]).select("a", "b", "xa", "xb", "ya", "yb").mapInArrow(run, "a long, b long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, key: int | None = None) -> DataFrame:
    """A row for each row of df: id_col, h (row_key of the text), n_shingles, component_id, kept. key is that of the hashes; none draws one."""
    if k < 1 or not 1 <= percent <= 100:
        raise ValueError("k is at least 1 and percent from 1 to 100")
    key = new_key() if key is None else key
    text = text_of(text_col)
    source = df.select(col(id_col).cast("long").alias("id"), row_key(text).alias("h"), text.alias("text"))
    rows = written(sketches(source, k, key).withColumn("row", F.monotonically_increasing_id()), "sketches")
    filled = rows.where("n > 0")
    best = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row")).alias("best")
    nodes = filled.groupBy("digest").agg(F.min(F.struct("row", "id", "h", "n", "sketch")).alias("r"), best, F.count("*").alias("rows"))
    nodes = written(nodes.select(F.col("r.row").alias("node"), "r.id", "r.h", "r.n", "r.sketch", "digest", "best", "rows"), "nodes")

    width = 2 * ROWS
    keys = F.transform(F.sequence(F.lit(0), F.lit(REGISTERS // ROWS - 1)), lambda j: F.xxhash64(F.substring("sketch", j * width + 1, F.lit(width)), j))
    banded = nodes.select("node", "n", F.explode(keys).alias("band"))
    shared = written(banded.groupBy("band").agg(F.min("node").alias("pivot"), F.count("*").alias("c")).where("c > 1"), "buckets")
    members = written(salted_join(banded, shared.select("band", "pivot"), "band", hot_keys(shared, "band", "c"), ["node"]), "members")

    if rows.groupBy("id", "h").count().where("count > 1").isEmpty():
        texts = source
    else:  # rows that agree in id and text: one of each, before they are shuffled
        texts = source.groupBy("id", "h").agg(F.min("text").alias("text"))
    wanted = members.select("node").distinct().join(nodes.select("node", "id", "h"), "node")
    sets = texts.alias("s").join(wanted.alias("w"), F.expr("s.id <=> w.id and s.h = w.h")).select("w.node", "s.text")
    sets = written(full_sets(sets, k, key), "sets")

    def linked(pairs: DataFrame) -> DataFrame:
        hot = hot_keys(pairs.groupBy("b").agg(F.count("*").alias("c")), "b", "c")
        return written(verified(likely(pairs, nodes, percent, hot), sets, percent, hot), "links")

    tested = written(members.where("node != pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct(), "pairs")
    comps = components(linked(tested))

    def open_members(comps: DataFrame) -> DataFrame:
        """Members, with their components, of buckets whose members are not all connected."""
        now = members.join(comps, "node", "left").select("band", "node", "n", F.coalesce("comp", "node").alias("comp"))
        apart = now.groupBy("band").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.min(F.struct(F.xxhash64("node", "band").alias("x"), "node", "comp")).alias("p"), F.count("*").alias("c"), F.sum("n").alias("s")).where("low != high")
        blocks = F.ceil(F.greatest(F.col("c") / BLOCK, F.col("s") / BLOCK_VALUES)).alias("blocks")
        apart = written(apart.select("band", F.col("p.node").alias("other"), F.col("p.comp").alias("other_comp"), blocks, "c"), "apart")
        return written(salted_join(now, apart.drop("c"), "band", hot_keys(apart, "band", "c"), ["node"]), "open")

    def joined(comps: DataFrame, links: DataFrame) -> DataFrame:
        """Components after new links between them."""
        if links.isEmpty():
            return comps
        at = lambda x: comps.select(F.col("node").alias(x), F.col("comp").alias(f"c{x}"))
        between = links.join(at("a"), "a", "left").join(at("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).where("a != b")
        merged = components(between)
        large = hot_keys(comps.groupBy("comp").agg(F.count("*").alias("c")), "comp", "c")
        old = salted_join(comps, merged.select(F.col("node").alias("comp"), F.col("comp").alias("new")), "comp", large, ["node"], "left").select("node", F.coalesce("new", "comp").alias("comp"))
        fresh = merged.join(comps.select("node"), "node", "left_anti")
        return written(old.unionByName(fresh), "components")

    left = open_members(comps)
    again = left.where("comp != other_comp").select(F.greatest("node", "other").alias("a"), F.least("node", "other").alias("b")).distinct()
    again = written(again.join(tested, ["a", "b"], "left_anti"), "pairs")
    comps = joined(comps, linked(again))

    rest = written(apart_links(open_members(comps).select("band", "node", "n", "comp", "blocks"), sets, percent), "pairs")
    comps = joined(comps, linked(rest))

    # Groups are settled among nodes, rows only look their node up.
    member = comps.join(nodes.select("node", "best"), "node")
    first = written(member.groupBy("comp").agg(F.min("best").alias("first"), F.count("*").alias("c")), "groups")
    of_node = salted_join(comps, first.drop("c"), "comp", hot_keys(first, "comp", "c"), ["node"])
    placed = nodes.join(of_node, "node", "left").select("digest", F.coalesce("first", "best").alias("first"))
    out = salted_join(rows, placed, "digest", hot_keys(nodes.select("digest", "rows"), "digest", "rows"), ["row"], "left")
    return out.select(
        F.col("id").alias(id_col),
        "h",
        F.col("n").alias("n_shingles"),
        F.when(F.col("first").isNull(), F.col("id")).otherwise(F.col("first.id")).alias("component_id"),
        (F.col("first").isNull() | (F.col("row") == F.col("first.row"))).alias("kept"),
    )


def op4_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    """Groups of all documents by four-word shingles and a similarity of 0.8 or more."""
    return near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=80).drop("h")


OP4_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN [array_to_string(w[i:i + 3], ' ') FOR i IN range(1, len(w) - 2)] WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS x FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2
), e AS (
  SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)
), r AS (
  SELECT doc_id AS id, doc_id AS v FROM documents UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.v
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT id AS doc_id, min(v) AS component_id FROM r GROUP BY id) c USING (doc_id)
"""
