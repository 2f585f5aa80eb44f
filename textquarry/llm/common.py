"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.llm.files import remove
from textquarry.operators.storage import shared_dir

#: ASCII white space as the operators see it: blank and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"
#: RE2 and Java agree on this class.
WORD = "[^\\x20\\x09-\\x0D]+"


_scratch: ContextVar[tuple[str, ...]] = ContextVar("scratch", default=())


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, or below that of the scratch that is open."""
    base = _scratch.get()[-1] if _scratch.get() else f"{shared_dir(spark).rstrip('/')}/textquarry"
    return f"{base}/{name}-{uuid.uuid4().hex}"


@contextmanager
def scratch(spark: SparkSession):
    """What is written inside is removed at the end: for steps whose result has been written elsewhere by then."""
    path = shared_path(spark, "scratch")
    before = _scratch.set((*_scratch.get(), path))
    try:
        yield path
    finally:
        _scratch.reset(before)
        remove(path)


def written(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """df written as Parquet to the shared folder and read back: later steps start from the files, whichever executor is lost."""
    path = f"{folder}/{name}-{uuid.uuid4().hex}" if folder else shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Keys that are dealt over several tasks: those of at least one in HOT rows, so that there are HOT at most.
HOT = 1000
#: Parts of such a key.
SALTS = 64


def hot_keys(counts: DataFrame, key: str, n: str) -> list | None:
    """The keys of a table of counts that have at least one in HOT rows, HOT at most; None if there are none."""
    whole = counts.agg(F.sum(n).alias("s"), F.max(n).alias("m")).first()
    if not whole["s"] or whole["m"] * HOT < whole["s"] or whole["m"] < HOT:
        return None
    found = counts.where(F.col(n) * HOT >= whole["s"]).select(key).collect()  # HOT rows at most
    return [bytes(r[0]) if isinstance(r[0], bytearray) else r[0] for r in found]


def salted_join(left: DataFrame, right: DataFrame, key: str, hot: list | None, by: list[str], how: str = "inner") -> DataFrame:
    """left joined with right, which has a row for each key. Rows of a hot key are dealt over SALTS tasks by a hash of their columns by; right's row of it goes to each of these."""
    if hot is None:
        return left.join(right, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    dealt = left.withColumn("salt", F.when(is_hot, F.pmod(F.xxhash64(*by), F.lit(SALTS))).otherwise(F.lit(0)).cast("int"))
    spread = right.withColumn("salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return dealt.join(spread, [key, "salt"], how).drop("salt")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def col(name: str) -> Column:
    """The column of this very name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def text_of(name: str) -> Column:
    """Null texts count as empty."""
    return F.coalesce(col(name), F.lit(""))


def row_key(text: Column) -> Column:
    """128 bits of a text's SHA-256: with the id, it tells rows apart."""
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def row_pair(id_: Column, text: Column) -> tuple[Column, Column]:
    """A row's id and text as two 64-bit numbers: 120 bits of SHA-256, and the id mixed into one of them, so that equal pairs are equal rows."""
    digest = F.sha2(F.concat(F.when(id_.isNull(), "-").otherwise("+"), text), 256)
    bits = lambda at: F.conv(F.substring(digest, at, 15), 16, 10).cast("long")
    return F.coalesce(id_, F.lit(0).cast("long")).bitwiseXOR(bits(1)), bits(16)


def without(text: Column, letters: str, instead: str = "") -> Column:
    """text with each of the letters replaced; one byte search per letter, which is much cheaper than translate."""
    for c in letters:
        text = F.replace(text, F.lit(c), F.lit(instead))
    return text


def words_of(text: Column) -> Column:
    """Array of the words [^\\x20\\x09-\\x0D]+ in order. One plain split at blanks, which needs no regular expression."""
    return F.filter(F.split(without(text, BLANKS[1:], " "), " "), lambda w: w != "")


def squeezed(text: Column) -> Column:
    """text without blanks."""
    return without(text, BLANKS)


def bound(value: Column, use) -> Column:
    """use(value) with value computed once, however often use names it: it becomes the variable of a lambda over an array of one element."""
    return F.transform(F.array(value), use)[0]
