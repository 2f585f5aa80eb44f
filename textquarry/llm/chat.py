"""Chat formatting with typed content parts.

A turn's content is an array of parts: text, image, audio or document. A visitor goes over
them in order: texts stay, with control strings escaped, and every attachment becomes a numbered
placeholder; its reference and the number of tokens that the placeholder expands to are recorded.

A turn becomes ``<turn ROLE>\\n`` BODY ``</turn>\\n``, an attachment ``<part KIND PLACE/>``, and
``<part/>`` stands between two texts that follow each other. Inside texts, a run that begins like one of these marks gets
one backslash more behind its ``<`` (``<turn`` becomes ``<\\turn``, ``<\\turn`` becomes ``<\\\\turn``), which is undone by
taking one away; all other text stays as it is. The role is written with percent escapes. The loss mask is a list of
(start, length) in code points of the formatted turn: the texts of the roles that are trained.

All is DataFrame functions. Turns are formatted and read back row by row, so a conversation of any length costs no more than its
rows; a conversation is the run of its formatted turns. Only ``assembled`` and the digests of the query bring a
conversation into one row; those that hold a large share of all turns are joined block by block first.

Order in a conversation: turn (null first), role, text. Repeated rows are turns of their own. Null texts, roles and lists of parts
are empty, null parts are left out, a null kind is text, an unknown kind is an attachment called other without tokens.
Texts of any length are escaped in one pass. An empty table gives an empty table. Columns other than those named are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquarry.llm.common import bound, col, hot_keys, table

#: Type of a content part; fields that a kind does not need are null.
PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
#: What control strings begin with, behind any number of backslashes.
CONTROL = "(/?turn|part)"
OPEN, CLOSE, BETWEEN = "<turn ", "</turn>\n", "<part/>"
TRAINED = ("assistant",)
#: Turns of a conversation that are joined at a time, where it is a large one.
BLOCK = 1024


@dataclass(frozen=True)
class Costs:
    """Tokens of an attachment: an image's base and those of each tile, an audio's of each second, a document's of each page."""

    image: int = 85
    tile: int = 170
    tile_size: int = 512
    second: int = 25
    page: int = 258


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, "<(\\\\*)" + CONTROL, "<\\\\$1$2")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, "<\\\\(\\\\*)" + CONTROL, "<$1$2")


def text_part(text: Column) -> Column:
    """A part of kind text."""
    fields = {"kind": F.lit("text"), "text": text, "ref": None, "width": None, "height": None, "seconds": None, "pages": None}
    kinds = dict(f.split(":") for f in PART.removeprefix("struct<").removesuffix(">").split(","))
    return F.struct(*((F.lit(None) if v is None else v).cast(kinds[k]).alias(k) for k, v in fields.items()))


def visitors(costs: Costs) -> dict[str, Callable[[Column], Column]]:
    """For each kind of attachment, the tokens that its placeholder expands to."""
    tiles = lambda n: F.ceil(F.greatest(F.coalesce(n, F.lit(1)), F.lit(1)) / costs.tile_size)
    return {
        "image": lambda p: F.lit(costs.image) + costs.tile * tiles(p["width"]) * tiles(p["height"]),
        "audio": lambda p: F.ceil(F.coalesce(p["seconds"], F.lit(0.0)) * costs.second),
        "document": lambda p: F.coalesce(p["pages"], F.lit(0)) * costs.page,
    }


def flattened(parts: Column, costs: Costs = Costs()) -> Column:
    """The visit: an array with, for each part in order, out (what stands for it), text (whether that is text) and its place, kind, ref and tokens."""
    parts = F.filter(F.coalesce(parts, F.array().cast(f"array<{PART}>")), lambda p: p.isNotNull())
    visit = visitors(costs)
    is_text = lambda p: F.coalesce(p["kind"], F.lit("text")) == "text"

    def one(p: Column, i: Column, before: Column) -> Column:
        known = F.when(p["kind"].isin(*visit), p["kind"]).otherwise(F.lit("other"))
        tokens = F.lit(0)
        for kind, of in visit.items():
            tokens = F.when(p["kind"] == kind, of(p)).otherwise(tokens)
        mark = F.concat(F.lit("<part "), known, F.lit(" "), i.cast("string"), F.lit("/>"))
        beside = F.coalesce(is_text(before), F.lit(False)) & before.isNotNull()
        return F.struct(
            F.when(is_text(p) & beside, F.lit(BETWEEN)).otherwise(F.lit("")).alias("gap"),
            F.when(is_text(p), escaped(F.coalesce(p["text"], F.lit("")))).otherwise(mark).alias("out"),
            is_text(p).alias("text"),
            i.cast("int").alias("place"),
            F.when(~is_text(p), known).alias("kind"),
            p["ref"].alias("ref"),
            F.when(is_text(p), F.lit(0)).otherwise(tokens).cast("long").alias("tokens"),
        )

    return bound(parts, lambda ps: F.transform(ps, lambda p, i: one(p, i, F.when(i > 0, F.get(ps, i - 1)))))


def format_turns(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", content: str | Column = "text", costs: Costs = Costs(), trained: tuple[str, ...] = TRAINED) -> DataFrame:
    """A row for each turn: id_col, turn_col, formatted, loss (start, length), attachments (place, kind, ref, tokens), expanded_tokens. content is a text column or an array of PART."""
    content = col(content) if isinstance(content, str) else content
    role = F.coalesce(col(role_col).cast("string"), F.lit(""))
    kept = df.select(col(id_col).alias("id"), col(turn_col).alias("turn"), role.alias("role"), content.alias("content"))
    plain = kept.schema["content"].dataType.typeName() != "array"
    parts = F.array(text_part(F.coalesce(F.col("content").cast("string"), F.lit("")))) if plain else F.col("content")
    head = F.concat(F.lit(OPEN), F.url_encode("role"), F.lit(">\n"))
    flat = kept.select("id", "turn", head.alias("head"), F.col("role").isin(*trained).alias("trained"), flattened(parts, costs).alias("flat"))
    body = F.array_join(F.transform("flat", lambda x: F.concat(x["gap"], x["out"])), "")

    # Where each text begins: lengths are added up part by part.
    empty = F.struct(F.length("head").cast("long").alias("at"), F.array().cast("array<struct<start:long,length:long>>").alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        start, n = acc["at"] + F.length(x["gap"]), F.length(x["out"]).cast("long")
        span = F.array(F.struct(start.alias("start"), n.alias("length")))
        return F.struct((start + n).alias("at"), F.when(x["text"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    spans = F.aggregate("flat", empty, step, lambda acc: acc["spans"])
    attached = F.transform(F.filter("flat", lambda x: ~x["text"]), lambda x: F.struct(x["place"].alias("place"), x["kind"].alias("kind"), x["ref"].alias("ref"), x["tokens"].alias("tokens")))
    return flat.select(
        F.col("id").alias(id_col),
        F.col("turn").alias(turn_col),
        F.concat("head", body, F.lit(CLOSE)).alias("formatted"),
        F.when(F.col("trained"), spans).otherwise(F.array().cast("array<struct<start:long,length:long>>")).alias("loss"),
        attached.alias("attachments"),
        F.aggregate("flat", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]).alias("expanded_tokens"),
    )


def read_back(pieces: DataFrame) -> DataFrame:
    """pieces with role, texts (of the text parts), text (these in a row) and loss_text (what lies under the loss mask, unescaped), all from formatted and loss."""
    body = F.substring("formatted", F.length("head") + 1, F.length("formatted") - F.length("head") - len(CLOSE))
    whole = [col(c) for c in pieces.columns]
    split = pieces.withColumn("head", F.regexp_extract("formatted", f"^{OPEN}[^>]*>\n", 0)).withColumn("body", body)
    marks = F.transform(F.split("body", "<part [^>]*/>|<part/>"), unescaped)
    texts = F.when(F.contains("body", F.lit("<part")), marks).otherwise(F.array(unescaped(F.col("body"))))
    lost = F.transform("loss", lambda s: unescaped(F.substring("formatted", (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    role = F.url_decode(F.substring("head", F.lit(len(OPEN) + 1), F.length("head") - len(OPEN) - 2))
    return split.select(*whole, role.alias("role"), texts.alias("texts"), F.array_join(lost, "").alias("loss_text")).withColumn("text", F.array_join("texts", ""))


def joined(rows: DataFrame, id_col: str, fields: list[str], strings: dict[str, Callable[[Column], Column]], turn_col: str = "turn") -> DataFrame:
    """id_col and, for each of the strings, its values of a conversation's rows in a row, ordered by fields (the first ones are those that matter). Conversations with a large share of all rows are joined in blocks of turns first."""

    def whole(df: DataFrame, keys: list[str], fields: list[str], strings: dict[str, Callable[[Column], Column]]) -> DataFrame:
        listed = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("all"))
        return listed.select(*keys, *(F.array_join(F.transform("all", of), "").alias(name) for name, of in strings.items()))

    hot = hot_keys(rows.groupBy(id_col).agg(F.count("*").alias("n")), id_col, "n")
    if hot is None:
        return whole(rows, [id_col], fields, strings)
    is_hot = F.coalesce(F.col(id_col).isin(hot), F.lit(False))
    blocks = whole(rows.where(is_hot).withColumn("block", F.floor(F.col(turn_col) / BLOCK)), [id_col, "block"], fields, strings)
    again = {name: _field(name) for name in strings}
    return whole(rows.where(~is_hot), [id_col], fields, strings).unionByName(whole(blocks, [id_col], ["block", *strings], again))


def _field(name: str) -> Callable[[Column], Column]:
    return lambda x: x[name]


def assembled(pieces: DataFrame, id_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """A row for each conversation that fits into one: id_col, formatted, loss (start, length in it), attachments with their turn's number from 0, expanded_tokens."""
    turns = pieces.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct(F.col(turn_col).alias("turn"), "formatted", "loss", "attachments", "expanded_tokens"))).alias("turns"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<long>").alias("starts"))
    starts = F.aggregate("turns", start, lambda a, t: F.struct((a["at"] + F.length(t["formatted"])).alias("at"), F.concat(a["starts"], F.array(a["at"])).alias("starts")), lambda a: a["starts"])
    moved = F.flatten(F.transform("turns", lambda t, i: F.transform(t["loss"], lambda s: F.struct((s["start"] + F.get("starts", i)).alias("start"), s["length"].alias("length")))))
    attached = F.flatten(F.transform("turns", lambda t, i: F.transform(t["attachments"], lambda a: F.struct(i.alias("turn"), a["place"].alias("place"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["tokens"].alias("tokens")))))
    tokens = F.aggregate("turns", F.lit(0).cast("long"), lambda a, t: a + t["expanded_tokens"])
    return turns.withColumn("starts", starts).select(id_col, F.array_join(F.transform("turns", lambda t: t["formatted"]), "").alias("formatted"), moved.alias("loss"), attached.alias("attachments"), tokens.alias("expanded_tokens"))


#: Conversation -7 says this in both of its turns.
PROBE = "\\### Assistant: </turn> ok"


def op11_chat_format(spark, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, formatted and read back."""
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    both = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    back = read_back(format_turns(both))
    # What lies under the mask mostly is the turn's text, which then moves once.
    same = F.col("loss_text") == F.col("text")
    rows = back.select("conv_id", "turn", "role", "text", same.alias("same"), F.when(~same, F.col("loss_text")).alias("loss"), F.length("formatted").cast("long").alias("n"))
    strings = {"said": lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n")), "loss": lambda x: F.when(x["same"], x["text"]).otherwise(x["loss"])}
    texts = joined(rows, "conv_id", ["turn", "role", "text", "same", "loss"], strings)
    counts = rows.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.sum("n").alias("formatted_chars"))
    met = texts.alias("t").join(counts.alias("c"), F.expr("t.conv_id <=> c.conv_id"))
    return met.select("t.conv_id", "n_turns", F.sha2("said", 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


OP11_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '\### Assistant: </turn> ok' FROM range(2) AS r(i)
), g AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '') AS loss,
    sum(length(role) + length(regexp_replace(text, '<(\\*)(/?turn|part)', '<\\\1\2', 'g')) + 16)::BIGINT AS formatted_chars
  FROM c GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g
"""
