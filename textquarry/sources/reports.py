"""Search results as text: citations, BibTeX, Markdown, HTML, contexts for prompts; and their sinks.

A result row has qid, rank, title, authors (joined by commas), published (text), link, doc_id, text, score.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Forms of citations and of prompts.
STYLES = {
    "apa": "{authors} ({year}). {title}. arXiv.",
    "mla": '{authors}. "{title}." {year}, arXiv.',
    "chicago": '{authors}. {year}. "{title}." arXiv.',
    "ieee": '{authors}, "{title}," arXiv, {year}.',
    "default": "{authors} ({year}). {title}.",
}


def year(published: Column) -> Column:
    return F.substring(F.coalesce(published, F.lit("")), 1, 4)


def filled(template: str, **values: Column) -> Column:
    """The template with each {name} in place."""
    import re

    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*(values[p] if i % 2 else F.lit(p) for i, p in enumerate(parts) if i % 2 or p))


def citation(style: str) -> Column:
    return filled(STYLES.get(style, STYLES["default"]), authors=F.coalesce("authors", F.lit("Unknown")), title=F.coalesce("title", F.lit("Untitled")), year=year(F.col("published")))


def bibtex() -> Column:
    """An entry whose key is first author, year and id, with every field in double braces."""
    first = F.trim(F.split(F.coalesce(F.nullif("authors", F.lit("")), F.lit("unknown")), ",")[0])
    paper = F.col("doc_id").cast("string")
    field = lambda name, value: F.concat(F.lit(f"  {name}={{{{"), value, F.lit("}},\n"))
    return F.concat(
        F.lit("@article{"), first, year(F.col("published")), paper, F.lit(",\n"),
        field("title", F.coalesce("title", F.lit("Untitled"))), field("author", F.coalesce("authors", F.lit("Unknown"))), field("journal", F.concat(F.lit("arXiv preprint arXiv:"), paper)), field("year", year(F.col("published"))), F.lit("}\n"),
    )


def joined(results: DataFrame, line: Column, between: str) -> DataFrame:
    """qid and the lines of its results in order of rank."""
    lists = results.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("l"))
    return lists.select("qid", F.array_join(F.transform("l", lambda x: x["line"]), between).alias("text"))


def contexts(results: DataFrame) -> DataFrame:
    """The numbered context of a prompt for each query."""
    line = F.concat(F.lit("["), "rank", F.lit("] "), F.coalesce("title", F.lit("Untitled")), F.lit("\nSOURCE: "), F.coalesce("link", F.lit("")), F.lit("\nEXCERPT: "), F.col("text"), F.lit("\n"))
    return joined(results, line, "\n")


def bounded_contexts(results: DataFrame, each: int = 2000, most: int = 32_000) -> DataFrame:
    """Titles and texts cut to each characters; the whole is cut to most, and says so."""
    line = F.concat(F.lit("["), "rank", F.lit("] "), F.col("title"), F.lit("\n"), F.substring("text", 1, each), F.lit("\n"))
    whole = joined(results, line, "\n")
    return whole.withColumn("text", F.when(F.length("text") > most, F.concat(F.substring("text", 1, most), F.lit("\n...(truncated)"))).otherwise(F.col("text")))


def prompts(context: DataFrame, questions: DataFrame) -> DataFrame:
    """Question and context in one prompt: qid, prompt. questions: qid, question."""
    template = "Answer the question from the numbered sources below and cite them by number.\n\nQuestion: {question}\n\nSources:\n{context}\nAnswer:"
    return context.join(questions, "qid").select("qid", filled(template, question=F.col("question"), context=F.col("text")).alias("prompt"))


def markdown(results: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """qid and a page of its results; with answers (qid, question, answer) under the question and its answer."""
    line = F.concat("rank", F.lit(". **"), "title", F.lit("** - "), "authors", F.lit(" ("), year(F.col("published")), F.lit(")  \n   <"), "link", F.lit(">"))
    whole = joined(results, line, "\n")
    if answers is None:
        return whole.withColumn("text", F.concat(F.lit("# Results\n\n"), "text", F.lit("\n")))
    text = F.concat(F.lit("# "), "question", F.lit("\n\n"), F.coalesce("answer", F.lit("")), F.lit("\n\n## Sources\n\n"), F.coalesce("text", F.lit("")), F.lit("\n"))
    return answers.join(whole, "qid", "left").select("qid", text.alias("text"))


def html(results: DataFrame, abstract: int | None = 500) -> DataFrame:
    from textquarry.functions.screen import sanitised

    body = sanitised(F.col("text"), abstract or 1_000_000)
    line = F.concat(F.lit("<li><h3>"), sanitised(F.col("title")), F.lit("</h3><p>"), body, F.lit("</p></li>"))
    return joined(results, line, "\n").withColumn("text", F.concat(F.lit("<!DOCTYPE html><html><body><ol>\n"), "text", F.lit("\n</ol></body></html>")))


def result_json(results: DataFrame, metadata: Column | None = None, timestamp: str | None = None) -> DataFrame:
    """qid and one JSON document: the time of the export, metadata (a map), count and results in order."""
    row = F.struct("rank", "doc_id", "title", "score")
    at = F.lit(timestamp) if timestamp else F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    meta = F.create_map().cast("map<string,string>") if metadata is None else metadata
    lists = results.groupBy("qid").agg(F.count("*").alias("count"), F.array_sort(F.collect_list(row)).alias("results"))
    return lists.select("qid", F.to_json(F.struct(at.alias("timestamp"), meta.alias("metadata"), "count", "results")).alias("json"))


def result_table(results: DataFrame) -> DataFrame:
    """The columns of the CSV export."""
    return results.select("qid", "rank", "title", "authors", year(F.col("published")).alias("year"), "link", "score")


def audit_table(log: DataFrame) -> DataFrame:
    """All columns as text for export: nulls empty, booleans true or false."""
    return log.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in log.columns))


def write_text(df: DataFrame, path: str, column: str = "text") -> None:
    df.select(column).write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
