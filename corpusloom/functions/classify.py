"""The type of a question, from patterns, then from the names in it, then from words."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import STOP_WORDS

#: In the order of trial: type, priority, whether an answer needs retrieved context, and terms (a space is any white space).
PATTERNS = [
    ("debug", 1, True, "why is|why does|why doesn't|exception|crash|fail|not working|problem|issue|bug|error"),
    ("comparison", 2, True, "vs|versus|compare|similar to|differ from|differs from|difference between|what's the difference"),
    ("example", 2, True, "sample|example|demonstrate|how to use|show me how"),
    ("dataflow", 3, True, "trace data|data flow|data path|how data|value propagat|pass through|passes through"),
    ("security", 1, True, "xss|csrf|injection|validation|sanitize|vulnerable|authorization|authentication|security"),
    ("performance", 2, True, "memory usage|latency|speed|efficient|bottleneck|optimize|fast|slow|performance"),
    ("refactoring", 3, True, "better way|simplify|restructure|clean up|optimize|improve|refactor"),
    ("dependency", 2, False, "third party|third-party|external|import|required by|dependencies|depend on|depends on"),
    ("testing", 3, True, "coverage|mock|test"),
    ("documentation", 3, True, "meant to do|purpose of|what does|describe|explain|comment|document"),
    ("location", 5, False, None),
    ("usage", 4, False, None),
    ("architecture", 3, True, "module organization|component diagram|system design|high level|high-level|overall structure|architecture"),
    ("implementation", 2, True, "build a|create new|add feature|implement"),
]
SPECIAL = {"location": r"^(locate|show\s+me|find\s+the|where\s+(can\s+i\s+find|are|is))\s", "usage": r"(which|what|who).*(call|use|invoke|reference|depends\s+on)"}
#: After the names: type, confidence, priority, needs context, words.
WORDS = [
    ("debug", 0.85, 1, "fails|not working|exception|crash|problem|issue|bug|error|debug"),
    ("performance", 0.85, 2, "memory|speed|efficient|bottleneck|optimize|slow|performance"),
    ("refactoring", 0.85, 3, "better way|simplify|restructure|clean up|improve|refactor"),
    ("testing", 0.85, 3, "coverage|mock|test"),
    ("implementation", 0.80, 2, "build|create|add|implement"),
    ("architecture", 0.80, 3, "system|overview|design|structure|architecture"),
]
COMMON = sorted(set("are been can could does has have how should that the these this those what when where why will would".split()))
#: CapWords, a lower-case name, or an upper-case one.
_NAME = "(?:(?:[A-Z][a-z]+)+|[a-z_][a-z0-9_]*|[A-Z_][A-Z0-9_]+)"
#: The same for RE2, where a word's edge is between ASCII characters, and for Java, where it must be said.
SYMBOL, _SYMBOL = rf"\b{_NAME}\b", f"(?<![A-Za-z0-9_]){_NAME}(?![A-Za-z0-9_])"


def _pattern(terms: str) -> str:
    return "|".join(r"\s+".join(map(re.escape, t.split())) for t in terms.split("|")).replace(r"\-", "-")


def pattern_of(kind: str) -> str:
    """The expression that a lower-cased question of this type matches (also for RE2)."""
    return SPECIAL.get(kind) or next(_pattern(t) for k, _, _, t in PATTERNS if k == kind)


def symbols(question: Column, known: Column | None = None) -> Column:
    """Names in a question in order, each once; with ``known`` (an array) only those in it, unless it is empty."""
    found = F.array_distinct(F.filter(F.regexp_extract_all(question, F.lit(f"({_SYMBOL})"), F.lit(1)), lambda w: ~F.lower(w).isin(COMMON)))
    return found if known is None else F.when(F.size(known) == 0, found).otherwise(F.filter(found, lambda w: F.array_contains(known, w)))


def keywords(question: Column) -> Column:
    return F.filter(F.split(F.lower(question), r"[^\p{L}\p{N}_]+"), lambda w: (F.octet_length(w) > 2) & ~w.isin(STOP_WORDS))


def entities(names: Column, types: Column, functions: Column) -> Column:
    """Each name with its kind: type before function before unknown."""
    return F.transform(names, lambda n: F.struct(n.alias("name"), F.when(F.array_contains(types, n), "type").when(F.array_contains(functions, n), "function").otherwise("unknown").alias("type")))


def _any(text: Column, terms: str) -> Column:
    return text.rlike("|".join(map(re.escape, terms.split("|"))))


def classify(question: Column, found: Column | None = None) -> Column:
    """struct(answer: (type, confidence, priority, needs_context, level), symbols) of a question; ``found``: the names in it, where they have been checked."""
    lower = F.lower(F.trim(question))
    found = symbols(question) if found is None else found
    answer = lambda kind, confidence, priority, needs, level: F.struct(F.lit(kind).alias("type"), F.lit(confidence).alias("confidence"), F.lit(priority).alias("priority"), F.lit(needs).alias("needs_context"), F.lit(level).alias("level"))
    rules = [(lower.rlike(pattern_of(k)), answer(k, 0.95, p, needs, 1)) for k, p, needs, _ in PATTERNS]
    n = F.size(found)
    rules += [
        ((n >= 2) & _any(lower, "difference|compare|vs|similar"), answer("comparison", 0.92, 2, True, 2)),
        ((n == 1) & _any(lower, "where|find|locate|show"), answer("location", 0.90, 5, False, 2)),
        ((n == 1) & _any(lower, "calls|uses|invokes|called by|used by"), answer("usage", 0.90, 4, False, 2)),
        ((n == 1) & _any(lower, "example|how to use|sample"), answer("example", 0.90, 2, True, 2)),
        (n > 1, answer("understanding", 0.85, 3, True, 2)),
    ]
    rules += [(_any(lower, words), answer(k, c, p, True, 3)) for k, c, p, words in WORDS]
    chain = F
    for condition, value in rules:
        chain = chain.when(condition, value)
    return F.struct(chain.otherwise(answer("understanding", 0.75, 3, True, 3)).alias("answer"), found.alias("symbols"))
