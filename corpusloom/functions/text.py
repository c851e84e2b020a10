"""Column functions on code and question texts; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that say nothing in a question.
STOP_WORDS = sorted(set("an the a of in on at to with for how when where what are is can could should would will does these those this that".split()))
NAME_STOP_WORDS = sorted(set("a an calls can class do does find function how is locate method should that the this type used uses what where who will".split()))
PUNCTUATION = ".,!?;:'\"()[]{}"


def count_lines(text: Column) -> Column:
    """Lines of a text; a newline at the end begins no line, and an empty text has none."""
    newlines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return newlines + ((text != "") & ~F.endswith(text, F.lit("\n"))).cast("int")


def estimated_tokens(text: Column) -> Column:
    """A quarter of the UTF-8 bytes, rounded down."""
    return F.floor(F.octet_length(text) / 4).cast("long")


def identifier_tokens(name: Column) -> Column:
    """Lower-case parts of an identifier, cut at underscores and before capitals."""
    return F.filter(F.transform(F.split(name, "_|(?=[A-Z])"), F.lower), lambda x: x != "")


def trimmed(word: Column, marks: str = PUNCTUATION) -> Column:
    return F.btrim(word, F.lit(marks))


def question_words(question: Column) -> Column:
    """Words to search a question's answer by: cut at spaces and marks, of 3 bytes or more, no stop words; those with underscores also by part."""
    stop = F.array(*map(F.lit, STOP_WORDS))
    good = lambda w: (F.octet_length(w) > 2) & ~F.array_contains(stop, w)
    words = F.filter(F.transform(F.split(F.lower(question), r"[ ,.!?;:()\[\]]+"), lambda w: F.btrim(w, F.lit("\"'"))), good)
    return F.flatten(F.transform(words, lambda w: F.when(F.contains(w, F.lit("_")), F.concat(F.array(w), F.filter(F.split(w, "_"), good))).otherwise(F.array(w))))


def symbol_candidates(question: Column) -> Column:
    """Words of a question that may be names (3 bytes or more, without marks at the ends), and their parts; each once."""
    words = F.filter(F.transform(F.split(question, r"\s+"), lambda w: trimmed(w)), lambda w: F.octet_length(w) > 2)
    return F.array_distinct(F.flatten(F.transform(words, lambda w: F.concat(F.array(w), identifier_tokens(w)))))


def entity_name(question: Column) -> Column:
    """The first word that looks like a name (a capital and then a small letter somewhere, or an underscore), else the first that is no stop word, else ''."""
    stop = F.array(*map(F.lit, NAME_STOP_WORDS))
    words = F.filter(F.split(F.trim(question), r"\s+"), lambda w: (w != "") & ~F.array_contains(stop, F.lower(w)))
    likely = F.filter(words, lambda w: w.rlike("^[A-Z].*[a-z]") | F.contains(w, F.lit("_")))
    return F.coalesce(F.get(likely, F.lit(0)), F.get(words, F.lit(0)), F.lit(""))


def fuzzy_score(pattern: Column, target: Column) -> Column:
    """Likeness of two names: 1000 equal, 500 contained, else 10 for each equal place, 2 for each character in common, less the difference in length."""
    p, t = F.split(pattern, ""), F.split(target, "")
    p, t = F.filter(p, lambda x: x != ""), F.filter(t, lambda x: x != "")
    places = F.size(F.filter(F.arrays_zip(p.alias("p"), t.alias("t")), lambda z: z["p"] == z["t"]))
    common = F.aggregate(F.array_distinct(p), F.lit(0), lambda n, c: n + F.least(F.size(F.filter(p, lambda x: x == c)), F.size(F.filter(t, lambda x: x == c))))
    return F.when(pattern == target, 1000).when(F.contains(target, pattern), 500).otherwise(10 * places + 2 * common - F.abs(F.length(target) - F.length(pattern)))


def truncated(text: Column, most: int = 2000) -> Column:
    """A text of at most ``most`` (2000 or less) characters: a longer one ends at its last newline before the limit, or at the limit, with '...'."""
    most = min(most, 2000)
    cut = F.left(text, F.lit(most - 3))
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.when(F.contains(cut, F.lit("\n")), F.regexp_replace(cut, r"\n[^\n]*\z", "")).otherwise(cut), F.lit("...")))


def one_line(text: Column, most: int) -> Column:
    return F.left(F.trim(F.replace(text, F.lit("\n"), F.lit(" "))), F.lit(most))


TODO = r"(?i)\b(todo|fixme|xxx|hack)\b[:\s]*(.*)"


def todo_priority(text: Column) -> Column:
    lower = F.lower(text)
    return F.when(lower.rlike("critical|urgent"), "high").when(lower.rlike("minor|low"), "low").otherwise("medium")


#: note_type and pattern by language; matched without regard to case but for C.
SECURITY = {
    "Python": [("password_handling", "password"), ("sensitive_data", "secret|api_key|token"), ("code_execution", r"eval\("), ("code_execution", r"exec\("), ("dynamic_import", "__import__"), ("deserialization", r"pickle\.load"), ("command_execution", r"subprocess|os\.(system|popen)")],
    "Go": [("sensitive_data", "apikey|password|secret|token"), ("code_execution", r"eval\("), ("command_execution", r"exec\.command|os\.exec"), ("unsafe_code", r"unsafe\."), ("sql_query", r"(db|sql)\.query")],
    "C": [("unsafe_string", r"\b(gets|strcat|strcpy|v?sprintf)\b"), ("command_execution", r"\b(system|popen)\s*\(|\bexec\w*\s*\("), ("manual_memory", r"\b(malloc|calloc|realloc|free)\b"), ("unsafe_input", r"\bf?scanf\b"), ("memory_operation", r"\bmem(cpy|move|set)\b"), ("privilege_change", r"\b(setuid|setgid|seteuid)\b"), ("weak_random", r"\b(rand|random)\(\)")],
}

#: Tags by what a lower-cased name contains, shared by the languages.
NAME_TAGS = {
    "authentication": "auth|login|logout|password|encrypt|decrypt|hash|token",
    "security": "auth|login|logout|password|encrypt|decrypt|hash|token",
    "api": "api|route|endpoint|handler|view|serve|http",
    "http-handler": "handler|view|controller|serve",
    "database": "db|query|insert|select|update|delete|save|fetch|find",
    "validation": "valid|check|verify|sanitize",
    "utility": "util|helper",
    "configuration": "config|setting|option",
    "logging": "log|debug",
    "error-handling": "error|exception",
    "file-io": "read|write|file|open|load",
    "network": "socket|connect|request|response|dial|listen",
    "parsing": "parse|decode|unmarshal",
    "serialization": "serialize|encode|marshal",
    "initialization": "init|setup|bootstrap",
    "cleanup": "cleanup|close|shutdown|dispose",
}


def name_tags(name: Column) -> Column:
    """Sorted tags of a name."""
    lower = F.lower(name)
    rules = [F.when(lower.rlike(p), F.lit(t)) for t, p in NAME_TAGS.items()]
    rules += [F.when(lower.isin("main", "run", "start"), F.lit("entry-point")), F.when(lower.rlike("^(test|bench)"), F.lit("testing"))]
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*rules))))
