"""Query expansion, variants and templates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textquarry.functions.text import word_tokens

# Acronyms and related terms that queries are expanded with.
ACRONYMS = {
    "RAG": "retrieval augmented generation",
    "LLM": "large language model",
    "ML": "machine learning",
    "DL": "deep learning",
    "NLP": "natural language processing",
    "CV": "computer vision",
    "API": "application programming interface",
    "GPU": "graphics processing unit",
    "TPU": "tensor processing unit",
    "SOTA": "state of the art",
    "GPT": "generative pre-trained transformer",
    "BERT": "bidirectional encoder representations from transformers",
    "TF": "transformer",
}
RELATED = {
    "retrieval": ["search", "fetching", "query", "indexing"],
    "embedding": ["vector", "representation", "encoding"],
    "chunk": ["segment", "fragment", "split"],
    "semantic": ["meaning", "context", "understanding"],
    "transformer": ["attention", "self-attention", "GPT", "BERT"],
    "attention": ["focus", "mechanism", "self-attention", "cross-attention"],
    "rag": ["retrieval", "augmented", "generation", "knowledge", "external"],
    "query": ["question", "search", "inquiry", "request"],
    "model": ["neural network", "architecture", "algorithm"],
}
TEMPLATES = ("{query}", "What is {query}?", "Explain {query} in detail.", "Discuss the key aspects of {query}.", "How does {query} work?")
#: Queries outside these lengths are not expanded; below the next two, expansion is full or moderate.
SHORTEST, LONGEST, FULL_BELOW, MODERATE_BELOW = 10, 200, 30, 100


def intensity(query: Column) -> Column:
    n = F.length(F.trim(query))
    return F.when(n < FULL_BELOW, "full").when(n < MODERATE_BELOW, "moderate").otherwise("minimal")


def expandable(query: Column) -> Column:
    return F.length(F.trim(query)).between(SHORTEST, LONGEST)


def acronym_terms(query: Column) -> Column:
    """Expansions of the acronyms that occur anywhere in the query (also inside words), in the fixed order; two at most for long queries."""
    low = F.lower(query)
    found = F.array_compact(F.array(*(F.when(F.contains(low, F.lit(a.lower())) & ~F.contains(low, F.lit(x)), F.lit(x)) for a, x in ACRONYMS.items())))
    return F.when(intensity(query) == "minimal", F.slice(found, 1, 2)).otherwise(found)


def related_terms(query: Column) -> Column:
    """Terms related to the query's words in their order, but for those the query has; three at most at moderate length, one for long queries."""
    low = F.lower(query)
    table = F.create_map(*(x for w, terms in RELATED.items() for x in (F.lit(w), F.array(*map(F.lit, terms)))))
    terms = F.flatten(F.transform(word_tokens(query), lambda w: F.coalesce(F.try_element_at(table, w), F.array().cast("array<string>"))))
    fresh = F.filter(terms, lambda t: ~F.contains(low, t))
    kind = intensity(query)
    return F.when(kind == "minimal", F.slice(fresh, 1, 1)).when(kind == "moderate", F.slice(fresh, 1, 3)).otherwise(fresh)


def expanded(query: Column, method: str = "acronym") -> Column:
    """The query with its expansions; methods acronym, related, both, none."""
    if method == "none":
        return query
    parts = [F.array(query)] + ([acronym_terms(query)] if method in ("acronym", "both") else []) + ([related_terms(query)] if method in ("related", "both") else [])
    return F.when(expandable(query), F.array_join(F.concat(*parts), " ")).otherwise(query)


def variants(query: Column) -> Column:
    """The query, its expansion, its first sentence (more than 10 characters) and itself without parentheses (more than 5), each once."""
    sentence = F.trim(F.split(query, "[.!?]")[0])
    bare = F.trim(F.regexp_replace(F.regexp_replace(query, "\\([^)]*\\)", ""), "\\s+", " "))
    return F.array_distinct(F.array_compact(F.array(query, expanded(query), F.when(F.length(sentence) > 10, sentence), F.when(F.length(bare) > 5, bare))))


def template_variants(query: Column) -> Column:
    return F.array(*(F.replace(F.lit(t), F.lit("{query}"), query) for t in TEMPLATES))


def variant_lines(answer: Column, original: Column, n: int, least: int = 3) -> Column:
    """Lines of an answer as variants: trimmed, longer than least, n at most, the original first."""
    lines = F.filter(F.transform(F.split(answer, "\n"), F.trim), lambda x: F.length(x) > least)
    return F.slice(F.array_distinct(F.concat(F.array(original), lines)), 1, n + 1)
