"""Merkle manifest of a dataset, with proofs by pointer jumping.

Leaves are digests of rows. In each group (a language) the leaves, in the order of their ids, are the lowest level of
a tree in which eight consecutive nodes have one parent; the groups' subroots, in the order of
their groups, are the lowest level of another tree, whose top is the root.

A node holds a segment: for each step towards an ancestor, the digests to its left and to its right among that
step's siblings. At first the ancestor is the parent. A self-join that looks the ancestor up and appends
its segment doubles the distance, so after log2(height) joins every node reaches the root. The leaves of one
parent share everything above it, so they are kept as the parent's row until the end: pointers are an eighth of
the leaves. A proof is then the leaf's own siblings and its parent's segment.

Places in a group come from a range partitioning by group and id and from counts of (group, partition): no group
is ever in one task, however large it is. Levels are grouped by place, eight rows a key. In a join of round r an ancestor has at
most 8**(2**r) rows; ancestors are broadcast while they are at most BROADCAST_ROWS, which are those of the high levels.
Every level and every round is a written table.

Ids order as their type does, null first; repeated ids are ordered by leaf, and each row is a leaf of its own. Null
columns count as ``-``, empty texts as ``0:``. A null group is a group, the first one. A text of any length is hashed in one pass where it is read. An
empty table gives an empty table. Columns other than those named are not looked at; names of the result win over those of carried columns, which must differ from them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquarry.llm.common import col, hot_keys, salted_join, table, written

ARITY = 8
BROADCAST_ROWS = 10_000
#: Group number of the tree above the subroots.
TOP = -1
SEGMENT = "array<struct<l:string,r:string>>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def sha(text: Column) -> Column:
    return F.sha2(text, 256)


def leaf_of(*columns: Column) -> Column:
    """Digest of a row: each value as its length in bytes, a colon and the value; null as a hyphen."""
    field = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return sha(F.concat(*(field(c.cast("string")) for c in columns)))


def numbered(df: DataFrame, group: str | None, keys: list[str], name: str) -> tuple[DataFrame, DataFrame | None]:
    """df with pos, the place in its group by keys, from 0; and a table of the groups with their number of rows, n."""
    order = ([group] if group else []) + keys
    at = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), name)
    part = F.shiftright("at", 33).alias("part")
    own = [group] if group else []
    counts = at.groupBy(*own, part).agg(F.min("at").alias("first"), F.count("*").alias("c"))
    counts = written(counts, f"{name}-counts")  # a row for each group and partition
    before = F.sum("c").over(_window(own))
    starts = counts.select(*(F.col(c).alias("of") for c in own), F.col("part").alias("p"), (before - F.col("c") - F.col("first")).alias("shift"))
    match = (F.shiftright("at", 33) == F.col("p")) & (F.col(group).eqNullSafe(F.col("of")) if group else F.lit(True))
    out = at.join(starts, match).withColumn("pos", F.col("at") + F.col("shift")).drop("of", "p", "shift", "at")
    return out, counts.groupBy(group).agg(F.sum("c").alias("n")) if group else None


def _window(own: list[str]):
    from pyspark.sql import Window

    return Window.partitionBy(*own).orderBy("part").rowsBetween(Window.unboundedPreceding, 0)


def node(g: Column, lv: Column | int, pos: Column, n: Column) -> Column:
    """Name of a node. The only node of a group's level is its subroot, and as such a leaf of the upper tree."""
    lv = F.lit(lv) if isinstance(lv, int) else lv
    sub = (g != TOP) & (n == 1)
    return F.struct(F.when(sub, TOP).otherwise(g).cast("long").alias("g"), F.when(sub, 0).otherwise(lv).cast("int").alias("lv"), F.when(sub, g).otherwise(pos).cast("long").alias("pos"))


def beside(kids: Column, i: Column) -> Column:
    """The digests left and right of the i-th of some siblings, each side in a row."""
    return F.struct(F.array_join(F.slice(kids, F.lit(1), i), "").alias("l"), F.array_join(F.slice(kids, i + 2, F.size(kids)), "").alias("r"))


def climb(level: DataFrame, lv: int, n: int) -> tuple[list[DataFrame], list[DataFrame], int]:
    """From nodes (g, pos, hash, n) of level lv, the levels above: pointers (node, anc, seg) of all nodes that have a parent, those nodes that have none, and the top's level. n: the most nodes of a group."""
    pointers, tops = [], [level.where("n = 1")]
    while n > 1:
        up, wide = F.floor(F.col("pos") / ARITY).cast("long"), F.ceil(F.col("n") / ARITY).cast("long")
        kids = level.where("n > 1").groupBy("g", "n", up.alias("up")).agg(F.array_sort(F.collect_list(F.struct("pos", "hash"))).alias("kids"))
        runs = written(kids.select("g", "n", "up", F.transform("kids", lambda k: k["hash"]).alias("kids")), f"level-{lv}")
        each = runs.select("g", "n", "up", "kids", F.posexplode("kids").alias("i", "hash"))
        own, parent = node(F.col("g"), lv, F.col("up") * ARITY + F.col("i"), F.col("n")), node(F.col("g"), lv + 1, F.col("up"), wide)
        pointers.append(each.select(own.alias("node"), parent.alias("anc"), F.array(beside(F.col("kids"), F.col("i"))).alias("seg")))
        level = runs.select("g", F.col("up").alias("pos"), sha(F.array_join("kids", "")).alias("hash"), wide.alias("n"))
        tops.append(level.where("n = 1"))
        n, lv = -(-n // ARITY), lv + 1
    return pointers, tops, lv


def jumped(pointers: DataFrame, height: int) -> DataFrame:
    """Pointers (node, anc, seg) that reach the root: each round doubles their distance."""
    reach = 1
    while reach < height:
        above = pointers.where((F.col("node.g") == TOP) | (F.col("node.lv") > reach)).select(F.col("node").alias("at"), F.col("anc").alias("next"), F.col("seg").alias("more"))
        if above.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
            above = F.broadcast(above)
        far = pointers.join(above, F.col("anc") == F.col("at"), "left")
        pointers = written(far.select("node", F.coalesce("next", "anc").alias("anc"), F.when(F.col("more").isNull(), F.col("seg")).otherwise(F.concat("seg", "more")).alias("seg")), "pointers")
        reach *= 2
    return pointers


def manifest(df: DataFrame, leaf: Column, id_col: str = "doc_id", group_col: str = "lang", carried: dict[str, Column] | None = None) -> DataFrame:
    """A row for each row of df: id_col, leaf, subroot, root, proof (for each step to the root the digests left and right), and the carried columns."""
    carried = carried or {}
    spark = df.sparkSession
    leaves = df.select(col(group_col).alias("lang"), col(id_col).alias("id"), leaf.alias("leaf"), F.struct(*(c.alias(k) for k, c in carried.items()), F.lit(0).alias("none")).alias("own"))
    leaves = written(leaves.withColumn("row", F.monotonically_increasing_id()), "leaves")
    placed, groups = numbered(leaves, "lang", ["id", "leaf", "row"], "ordered-leaves")
    groups = written(numbered(groups, None, ["lang"], "groups")[0].withColumnRenamed("pos", "g"), "numbered-groups")
    size = groups.agg(F.count("*").alias("groups"), F.max("n").alias("n")).first()
    if not size["groups"]:
        return spark.createDataFrame([], _schema(leaves, id_col, carried))
    few = size["groups"] <= BROADCAST_ROWS
    named = groups.select(F.col("lang").alias("of"), "g", "n")

    # Leaves by eight. A lone leaf is its group's subroot.
    if few:
        known = placed.join(F.broadcast(named), F.col("lang").eqNullSafe(F.col("of")))
    else:  # null is a language of its own
        key = F.struct("lang").alias("lang")
        known = salted_join(placed.withColumn("lang", F.to_json(key)), named.select(F.to_json(F.struct(F.col("of").alias("lang"))).alias("lang"), "g", "n"), "lang", hot_keys(groups.withColumn("lang", F.to_json(key)), "lang", "n"), ["row"])
    kids = known.groupBy("g", "n", F.floor(F.col("pos") / ARITY).cast("long").alias("up")).agg(F.array_sort(F.collect_list(F.struct("pos", "id", "leaf", "own"))).alias("kids"))
    wide = F.when(F.col("n") == 1, 1).otherwise(F.ceil(F.col("n") / ARITY)).cast("long")
    digest = F.when(F.col("n") == 1, F.col("kids")[0]["leaf"]).otherwise(sha(F.array_join(F.transform("kids", lambda k: k["leaf"]), "")))
    runs = written(kids.select("g", "n", "up", node(F.col("g"), 1, F.col("up"), wide).alias("node"), digest.alias("hash"), wide.alias("wide"), F.transform("kids", lambda k: k.dropFields("pos")).alias("kids")), "runs")

    low, tops, lv = climb(runs.select("g", F.col("up").alias("pos"), "hash", F.col("wide").alias("n")), 1, -(-size["n"] // ARITY))
    subroots = written(reduce(DataFrame.unionByName, tops).select("g", F.col("hash").alias("subroot")), "subroots")
    upper = subroots.select(F.lit(TOP).cast("long").alias("g"), F.col("g").alias("pos"), F.col("subroot").alias("hash"), F.lit(size["groups"]).cast("long").alias("n"))
    high, roots, top = climb(upper, 0, size["groups"])
    root = reduce(DataFrame.unionByName, roots).first()["hash"]
    pointers = None
    if low or high:
        pointers = jumped(written(reduce(DataFrame.unionByName, low + high), "pointers"), lv - 1 + top)

    met = runs.join(F.broadcast(subroots), "g") if few else salted_join(runs, subroots, "g", hot_keys(groups, "g", "n"), ["up"])
    if pointers is not None:
        met = met.join(pointers.select(F.col("node").alias("at"), F.col("seg").alias("above")), F.col("node") == F.col("at"), "left")
    else:
        met = met.withColumn("above", F.lit(None).cast(SEGMENT))
    above = F.coalesce("above", F.array().cast(SEGMENT))
    each = met.select("subroot", "n", above.alias("above"), F.transform("kids", lambda k: k["leaf"]).alias("leaves"), F.posexplode("kids").alias("i", "kid"))
    proof = F.when(F.col("n") == 1, F.col("above")).otherwise(F.concat(F.array(beside(F.col("leaves"), F.col("i"))), "above"))
    return each.select(F.col("kid.id").alias(id_col), F.col("kid.leaf").alias("leaf"), "subroot", F.lit(root).alias("root"), proof.alias("proof"), *(F.col("kid.own").getField(k).alias(k) for k in carried))


def _schema(leaves: DataFrame, id_col: str, carried: dict[str, Column]):
    from pyspark.sql import types as T

    own = leaves.schema["own"].dataType
    text = [T.StructField(k, T.StringType()) for k in ("leaf", "subroot", "root")]
    proof = T.StructField("proof", T.ArrayType(T.StructType([T.StructField("l", T.StringType()), T.StructField("r", T.StringType())])))
    return T.StructType([T.StructField(id_col, leaves.schema["id"].dataType), *text, proof, *(T.StructField(k, own[k].dataType) for k in carried)])


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and a proof give."""
    return F.aggregate(proof, leaf, lambda acc, s: sha(F.concat(s["l"], acc, s["r"])))


def proof_digest(proof: Column) -> Column:
    """Digest of all siblings of a proof in their order."""
    return sha(F.array_join(F.transform(proof, lambda s: F.concat(s["l"], s["r"])), ""))


def lowered(text: Column) -> Column:
    """text with A-Z in lower case, and nothing else."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def op12_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    """Manifest of all documents, each proof checked against a copy in which a third of the texts are tampered with."""
    docs = table(spark, sf_dir, "documents")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, leaf_of(*fields[:-1], lowered(fields[-1])))
    out = manifest(docs, leaf_of(*fields), carried={"tampered": tampered})
    found = out.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), folded(F.coalesce("tampered", "leaf"), F.col("proof")).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


_FIELD = "coalesce(octet_length(encode({0}))::VARCHAR || ':' || {0}, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR")) + " || " + _FIELD + ")"
_RUN = "PARTITION BY g, lv, pos // 8 ORDER BY pos ROWS BETWEEN"
OP12_SQL = f"""
WITH RECURSIVE k AS (
  SELECT [list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, 3988292384 * (c & 1))) FOR i IN range(256)] AS k
), d AS (
  SELECT doc_id, lang, {_LEAF.format("text")} AS leaf, {_LEAF.format(f"translate(text, '{UPPER}', '{UPPER.lower()}')")} AS other FROM documents
), e AS (
  SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM d
), c AS (
  SELECT e.*, xor(list_reduce([4294967295] || [ascii(x)::BIGINT FOR x IN string_split(doc_id::VARCHAR, '')], lambda c, b: xor(k[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) AS crc FROM e, k
), t(g, lv, pos, hash, n) AS (
  SELECT g, 0, pos, leaf, n FROM e
  UNION ALL
  SELECT g, lv + 1, pos // 8, sha256(string_agg(hash, '' ORDER BY pos)), (any_value(n) + 7) // 8 FROM t WHERE n > 1 GROUP BY g, lv, pos // 8
), u(g, lv, pos, hash, n) AS (
  SELECT -1, 0, g, hash, (SELECT count(DISTINCT g) FROM e) FROM t WHERE n = 1
  UNION ALL
  SELECT g, lv + 1, pos // 8, sha256(string_agg(hash, '' ORDER BY pos)), (any_value(n) + 7) // 8 FROM u WHERE n > 1 GROUP BY g, lv, pos // 8
), s AS (
  SELECT *, coalesce(string_agg(hash, '') OVER ({_RUN} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(hash, '') OVER ({_RUN} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM (SELECT * FROM t UNION ALL SELECT * FROM u) WHERE n > 1
), step(g, lv, pos, l, r, next_g, next_lv, next_pos) AS (
  SELECT g, lv, pos, l, r, CASE WHEN g >= 0 AND n <= 8 THEN -1 ELSE g END, CASE WHEN g >= 0 AND n <= 8 THEN 0 ELSE lv + 1 END, CASE WHEN g >= 0 AND n <= 8 THEN g ELSE pos // 8 END FROM s
), w(doc_id, leaf, lang_g, at_g, at_lv, at_pos, proof, now) AS (
  SELECT doc_id, leaf, g, CASE WHEN n = 1 THEN -1 ELSE g END, 0, CASE WHEN n = 1 THEN g ELSE pos END, '', CASE WHEN crc % 3 = 0 THEN other ELSE leaf END FROM c
  UNION ALL
  SELECT doc_id, leaf, lang_g, next_g, next_lv, next_pos, proof || l || r, sha256(l || now || r) FROM w JOIN step ON at_g = g AND at_lv = lv AND at_pos = pos
), top AS (
  SELECT max(hash) AS root, max(lv) AS lv FROM u WHERE n = 1
)
SELECT doc_id, leaf, sub.hash AS subroot, root, sha256(proof) AS proof_sha256, now AS folded_root, now = root AS verified
FROM w, top JOIN (SELECT g, hash FROM t WHERE n = 1) sub ON sub.g = lang_g WHERE at_g = -1 AND at_lv = top.lv
"""
