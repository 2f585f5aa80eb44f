"""Screening of texts in bulk: threat labels, injected instructions, sanitising, rules with reasons."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textquarry.functions.text import balanced, normalised

# Patterns of threats, in the order of their labels.
THREATS = {
    "sql_injection": r"(?i)\b(SELECT|INSERT|UPDATE|DELETE|DROP|CREATE|ALTER|EXEC|UNION|SCRIPT)\b",
    "xss": r"(?i)<script[^>]*>.*?</script>|javascript:|on\w+\s*=",
    "path_traversal": r"\.\.[/\\]",
    "command_injection": r"(?i)[;&|`$()]|<\s*\?(?:php|perl|python|ruby|bash|sh)",
}
# Patterns of instructions injected into prompts.
INJECTIONS = (
    r"ignore\s+(previous|all)\s+instructions?",
    r"disregard\s+(previous|all)\s+instructions?",
    r"forget\s+(previous|all)\s+instructions?",
    r"(new|updated)\s+instructions?:?",
    r"override\s+instructions?",
    r"system\s*:\s*you\s+are",
    r"<\|(.*?)\|>",
    r"<<.*?>>",
    r"\[SYSTEM\]:?",
    r"\[INSTRUCTIONS?\]:?",
    r"act\s+as\s+(a|an)?\s*.*?",
    r"pretend\s+(to\s+be|you\s+are)",
    r"roleplay\s+as",
    r"assume\s+the\s+role",
    r"you\s+are\s+now\s+(a|an)",
    r"from\s+now\s+on\s+you\s+are",
    r"i\s+want\s+you\s+to\s+act\s+as",
    r"you\s+must\s+(ignore|forget|disregard)",
    r"instead\s+of\s+.*\s+,",
    r"no\s+matter\s+what",
    r"above\s+instructions?\s+(are|were)",
    r"previous\s+(instructions?|text|prompts?)",
    r"<\|.*?\|>",
)
INJECTION = "(?im)" + "|".join(f"(?:{p})" for p in INJECTIONS)
LONGEST_QUERY = 2000


def threats(text: Column) -> Column:
    """Labels of the threat patterns found, in the fixed order; null text has none."""
    return F.array_compact(F.array(*(F.when(text.rlike(p), F.lit(label)) for label, p in THREATS.items())))


def injections(text: Column) -> Column:
    """Texts that match an injection pattern, each once in the order of its first find."""
    return F.coalesce(F.array_distinct(F.regexp_extract_all(text, F.lit(INJECTION), F.lit(0))), F.array().cast("array<string>"))


def sanitised(text: Column, longest: int = 10_000) -> Column:
    """Trimmed, cut, without NUL, with the marks of HTML escaped."""
    out = F.replace(F.substring(F.trim(text), 1, longest), F.lit("\0"), F.lit(""))
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(mark), F.lit(name))
    return out


def search_query(text: Column) -> Column:
    """A cleaned query, null where it holds an injection."""
    return F.when(F.size(injections(text)) == 0, F.substring(normalised(F.replace(text, F.lit("\0"), F.lit(""))), 1, LONGEST_QUERY))


def question_problems(text: Column) -> Column:
    """Reasons against a question."""
    t = F.coalesce(text, F.lit(""))
    rules = {
        "empty": F.trim(t) == "",
        "too_short": F.length(F.trim(t)).between(1, 2),
        "too_long": F.length(t) > LONGEST_QUERY,
        "unbalanced_parentheses": ~balanced(t, "(", ")"),
        "unbalanced_brackets": ~balanced(t, "[", "]"),
        "unbalanced_quotes": F.pmod(F.length(t) - F.length(F.replace(t, F.lit('"'), F.lit(""))), F.lit(2)) != 0,
        "injection": F.size(injections(t)) > 0,
    }
    return F.array_compact(F.array(*(F.when(c, F.lit(name)) for name, c in rules.items())))


#: Marks that a search query may not have, with the names of their kinds, in the order in which they are looked for.
FORBIDDEN = (("&&", "shell operators"), ("||", "shell operators"), (";", "command separator"), ("--", "SQL comment"), ("/*", "C-style comment"))
#: Characters of the longest search query; key and value of a filter; least and most results.
LONGEST_SEARCH, LONGEST_KEY, LONGEST_VALUE, RESULTS = 500, 100, 500, (1, 20)
#: Patterns of the strict checks by kind, as they are matched without regard to case.
STRICT = {
    "sql": (r"(\b(SELECT|INSERT|UPDATE|DELETE|DROP|CREATE|ALTER|EXEC|UNION)\b)", r"(;.*\b(DROP|DELETE|EXECUTE)\b)", r"(\bOR\s+\w+\s*=\s*\w+)", r"(--|#)", r"(\b(1=1|1 = 1)\b)"),
    "xss": (r"<script[^>]*>.*?</script>", r"javascript:", r"on\w+\s*=", r"<iframe", r"<object", r"<embed", r"<link", r"fromCharCode", r"eval\s*\("),
    "path": (r"\.\.[/\\]", r"\.\.%2f", r"\.\.%5c"),
    "command": (r"[;|&$`\n\r]", r"<\s*\?(php|perl|python|ruby|bash|sh)", r"eval\s*\(", r"exec\s*\(", r"system\s*\("),
}


def strict_threats(text: Column) -> Column:
    """kind and the number of its pattern, from 0, of every strict pattern that is found."""
    found = [F.when(text.rlike(f"(?i){p}"), F.lit(f"{kind}:{i}")) for kind, patterns in STRICT.items() for i, p in enumerate(patterns)]
    return F.array_compact(F.array(*found))


def search_problem(text: Column) -> Column:
    """The first reason against a search query, or null."""
    t = F.coalesce(text, F.lit(""))
    even = lambda mark: F.pmod(F.length(t) - F.length(F.replace(t, F.lit(mark), F.lit(""))), F.lit(2)) == 0
    rules = [
        (F.trim(t) == "", "empty"),
        (F.length(t) > LONGEST_SEARCH, "too_long"),
        (~balanced(t, "(", ")"), "unbalanced_parentheses"),
        (~balanced(t, "[", "]"), "unbalanced_brackets"),
        (~even('"'), "unbalanced_quotes"),
        (~even("'"), "unbalanced_single_quotes"),
        *((F.contains(t, F.lit(mark)), name.replace(" ", "_")) for mark, name in FORBIDDEN),
        (F.size(injections(t)) > 0, "injection"),
    ]
    return F.coalesce(*(F.when(c, F.lit(name)) for c, name in rules))


def results_problem(k: Column) -> Column:
    """The reason against a number of results, which may come as text, or null."""
    n = k.try_cast("int")
    low, high = RESULTS
    return F.when(n.isNull(), "not_a_number").when(n < low, "too_few").when(n > high, "too_many")


def filters_cleaned(filters: Column) -> Column:
    """A map of filters with keys and values sanitised; entries with a blank key or without a value go, and of keys that become equal the last stays."""
    entries = F.transform(F.map_entries(filters), lambda e: F.struct(sanitised(e["key"], LONGEST_KEY).alias("key"), sanitised(e["value"], LONGEST_VALUE).alias("value")))
    kept = F.filter(entries, lambda e: (e["key"] != "") & e["value"].isNotNull())
    last = F.filter(kept, lambda e, i: ~F.exists(F.slice(kept, i + 2, F.size(kept)), lambda x: x["key"] == e["key"]))
    return F.map_from_entries(last)


def nested(value: Column, kind: T.DataType, each: Callable[[Column], Column] = sanitised) -> Column:
    """value with all its texts rewritten, inside structs, arrays and maps (keys too) of any depth. Other values stay."""
    if isinstance(kind, T.StringType):
        return each(value)
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*(nested(value.getField(f.name), f.dataType, each).alias(f.name) for f in kind)))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: nested(x, kind.elementType, each))
    if isinstance(kind, T.MapType):
        return F.map_from_entries(F.transform(F.map_entries(value), lambda e: F.struct(nested(e["key"], kind.keyType, each).alias("key"), nested(e["value"], kind.valueType, each).alias("value"))))
    return value


def rejected(value: Column, kind: T.DataType, path: Column | str = "") -> Column:
    """path, text and found (the injections) of all texts inside value that hold one: a path has field names, places in brackets and keys in braces."""
    path = F.lit(path) if isinstance(path, str) else path
    none = F.array().cast("array<struct<path:string,text:string,found:array<string>>>")
    if isinstance(kind, T.StringType):
        return F.when(F.size(injections(value)) > 0, F.array(F.struct(path.alias("path"), value.alias("text"), injections(value).alias("found")))).otherwise(none)
    if isinstance(kind, T.StructType):
        parts = [rejected(value.getField(f.name), f.dataType, F.concat(path, F.lit(f".{f.name}"))) for f in kind]
        return F.coalesce(F.concat(none, *parts), none)
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.flatten(F.transform(value, lambda x, i: rejected(x, kind.elementType, F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))), none)
    if isinstance(kind, T.MapType):
        inner = lambda e: rejected(e["value"], kind.valueType, F.concat(path, F.lit("{"), e["key"].cast("string"), F.lit("}")))
        return F.coalesce(F.flatten(F.transform(F.map_entries(value), inner)), none)
    return none


def sanitised_rows(df: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """df with all texts of all columns but the keys sanitised, and the side table of its rejects: keys, path (that begins with the column), text, found."""
    kinds = {f.name: f.dataType for f in df.schema if f.name not in keys}
    clean = df.select(*keys, *(nested(F.col(f"`{c}`"), kind).alias(c) for c, kind in kinds.items()))
    all_ = [rejected(F.col(f"`{c}`"), kind, c) for c, kind in kinds.items()]
    bad = df.select(*keys, F.explode(F.concat(*all_)).alias("r")).select(*keys, "r.path", "r.text", "r.found") if all_ else df.select(*keys).limit(0)
    return clean, bad


def formats(text: Column) -> Column:
    """Which of the forms e-mail address, URL, date a value has; null if none."""
    return (
        F.when(text.rlike(r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$"), "email")
        .when(text.rlike(r"^https?://[^\s/$.?#][^\s]*$"), "url")
        .when(F.try_to_date(text, "yyyy-MM-dd").isNotNull(), "date")
    )


def error_label(message: Column) -> Column:
    """severity and type by the first rule that a lower-cased message meets, and whether a retry makes sense."""
    m = F.lower(message)
    # The words of each kind, in the order of the rules.
    has = lambda *words: F.coalesce(m.rlike("|".join(words)), F.lit(False))
    rules = (
        (has("timeout", "connection"), "warning", "connection"),
        (has("rate limit", "429"), "warning", "rate_limit"),
        (has("auth", "401", "api key"), "error", "authentication"),
        (has("invalid", "400"), "error", "invalid_request"),
        (has("503", "502", "unavailable"), "warning", "server_error"),
    )
    out = F.struct(F.lit("error").alias("severity"), F.lit("unknown").alias("type"), F.lit(False).alias("retryable"))
    for c, severity, kind in reversed(rules):
        out = F.when(c, F.struct(F.lit(severity).alias("severity"), F.lit(kind).alias("type"), F.lit(severity == "warning").alias("retryable"))).otherwise(out)
    return out
