"""What the parsers of all languages share: marks, notes, tags and records."""

from __future__ import annotations

import re

from ..functions.text import NAME_TAGS, SECURITY, TODO

_TODO = re.compile(TODO)
_NAMES = [(tag, re.compile(p)) for tag, p in NAME_TAGS.items()]
_NOTES = {lang: [(kind, re.compile(p if lang == "C" else "(?i)" + p)) for kind, p in rules] for lang, rules in SECURITY.items()}


def lines_of(text: str) -> list[str]:
    out = text.split("\n")
    return out[:-1] if out[-1] == "" else out


def todos(text: str) -> list[dict]:
    out = []
    for n, line in enumerate(lines_of(text), 1) if _TODO.search(text) else []:
        if m := _TODO.search(line):
            low = line.lower()
            out.append({"line": n, "text": m[2].strip(), "priority": "high" if re.search("critical|urgent", low) else "low" if re.search("minor|low", low) else "medium"})
    return out


def security_notes(text: str, lang: str) -> list[dict]:
    lines = lines_of(text)
    # A pattern that is nowhere in the text isn't tried on its lines.
    return [{"line": n, "note_type": kind, "description": line.strip()} for kind, p in _NOTES.get(lang, []) if p.search(text) for n, line in enumerate(lines, 1) if p.search(line)]


def tags(name: str, doc: str, calls: list[dict], lang: str, extra: tuple[str, ...] = ()) -> list[str]:
    low, said = name.lower(), doc.lower()
    out = {tag for tag, p in _NAMES if p.search(low)} | set(extra)
    if low in ("main", "run", "start", "__main__"):
        out.add("entry-point")
    if low.startswith(("test", "bench")):
        out.add("testing")
    if "authentication" in said:
        out |= {"authentication", "security"}
    if "http" in said or "endpoint" in said:
        out.add("api")
    if "handle" in said and ("error" in said or "exception" in said):
        out.add("error-handling")
    called = {c["callee"].lower() for c in calls}
    if any("thread" in c for c in called):
        out.add("threading")
    return sorted(out)


def importance(name: str, decorators: list[str], lang: str, static: bool = False) -> float:
    score = 0.5
    if name == "main" or (lang == "Python" and name in ("run", "start")):
        score += 0.3
    if lang == "Python":
        score += 0.2 * any(re.search("route|api|endpoint", d) for d in decorators) + 0.2 * bool(re.search("auth|login", name.lower())) - 0.2 * (name.startswith("_") and not name.startswith("__"))
    elif lang == "Go":
        score += 0.1 * name[:1].isupper()
    else:
        score += -0.2 * name.startswith("_") - 0.1 * static
    return max(0.0, min(1.0, score))


def flow(complexity: int) -> dict:
    return {"complexity": complexity, "branches": [], "loops": [], "try_blocks": []}
