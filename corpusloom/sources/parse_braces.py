"""Go and C sources to records, by a scanner that knows strings, comments and brackets and goes on past errors."""

from __future__ import annotations

import re

from . import parse_common as common

GO_STDLIB = ("bufio", "bytes", "context", "crypto", "database", "encoding", "errors", "fmt", "io", "log", "math", "net", "os", "path", "reflect", "regexp", "sort", "strconv", "strings", "sync", "testing", "time", "unicode")
_WORDS = frozenset("if for while switch return sizeof do else case func go defer select range catch typeof var type struct interface map chan".split())


def masked(source: str, lang: str) -> str:
    """The source with the insides of comments, strings and character constants as blanks, at the same places."""
    raw = r"|`[^`]*`" if lang == "Go" else ""
    pattern = re.compile(r'//[^\n]*|/\*.*?(?:\*/|\Z)|"(?:\\.|[^"\\\n])*"?|\'(?:\\.|[^\'\\\n])*\'?' + raw, re.S)
    return pattern.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), source)


def closing(code: str, at: int) -> int:
    """Where the bracket that opens at ``at`` closes, or the end."""
    pairs, depth = {"(": ")", "{": "}", "[": "]"}, 0
    opens, closes = code[at], pairs[code[at]]
    for m in re.compile("[" + re.escape(opens + closes) + "]").finditer(code, at):
        depth += 1 if m[0] == opens else -1
        if depth == 0:
            return m.start()
    return len(code)


def _closing_whiles(code: str, start: int, end: int) -> dict[int, int]:
    """The place of each do, and that of the while that closes it."""
    out = {}
    for m in reversed(list(re.compile(r"\bdo\b").finditer(code, start, end))):
        body = re.compile(r"\s*").match(code, m.end()).end()
        at = closing(code, body) + 1 if code[body : body + 1] == "{" else m.end()
        found = next((x.start() for x in re.compile(r"\bwhile\b").finditer(code, at, end) if x.start() not in out.values()), None)
        if found is not None:
            out[m.start()] = found
    return out


def _split(text: str) -> list[str]:
    out, depth, last = [], 0, 0
    for i, c in enumerate(text):
        depth += (c in "([{") - (c in ")]}")
        if c == "," and depth == 0:
            out.append(text[last:i])
            last = i + 1
    return [x.strip() for x in [*out, text[last:]] if x.strip()]


class _Body:
    """A function's body: what is called where."""

    def __init__(self, source: str, code: str, start: int, end: int, lang: str):
        self.source, self.code, self.start, self.end, self.lang = source, code, start, end, lang
        self.blocks = []  # (from, to, context, keyword's place, condition)
        closes = _closing_whiles(code, start, end) if lang == "C" else {}
        for m in re.compile(r"\b(if|else|for|while|do|switch|select)\b").finditer(code, start, end):
            if m.start() in closes.values():
                continue
            if m.start() in closes:
                # The condition stands after the body, behind the while that closes it.
                paren = code.find("(", closes[m.start()], end)
                after = closing(code, paren)
                self.blocks.append((m.start(), after, "loop", "do-while", source[paren + 1 : after].strip(), code.find("{", m.end(), end)))
                continue
            brace = code.find("{", m.end(), end)
            stop = code.find(";", m.end(), end) if lang == "C" else -1
            if lang == "C" and m[1] in ("if", "for", "while", "switch"):
                paren = code.find("(", m.end(), end)
                if paren < 0:
                    continue
                after = closing(code, paren) + 1
                brace = after + len(code[after:end]) - len(code[after:end].lstrip())
                stop = code.find(";", after, end)
                condition = source[paren + 1 : after - 1].strip()
                last = closing(code, brace) if code[brace : brace + 1] == "{" else stop
            else:
                condition = source[m.end() : brace].strip() if brace >= 0 else ""
                last = closing(code, brace) if brace >= 0 and not (lang == "C" and 0 <= stop < brace) else stop
            if m[1] == "else" and re.match(r"\s*if\b", code[m.end() :]):
                continue
            context = {"if": "if", "else": "if", "switch": "switch", "select": "switch"}.get(m[1], "loop")
            self.blocks.append((m.start(), last if last >= 0 else end, context, m[1], condition, brace))

    def line(self, at: int) -> int:
        return self.code.count("\n", 0, at) + 1

    def found(self, start: int | None = None, end: int | None = None) -> list[tuple[str, int, int]]:
        # Names before an open bracket, but for words of the language.
        return [(m[1].split(".")[-1], m.start(), m.end() - 1) for m in re.compile(r"([A-Za-z_][\w.]*)\s*\(").finditer(self.code, self.start if start is None else start, self.end if end is None else end) if m[1] not in _WORDS]

    def calls(self) -> list[dict]:
        out, seen = [], set()
        for name, at, paren in self.found():
            line = self.line(at)
            if (name, line) in seen:
                continue
            seen.add((name, line))
            around = [b for b in self.blocks if b[0] <= at <= b[1]]
            context = max(around)[2] if around else "unconditional"
            args = _split(self.source[paren + 1 : closing(self.code, paren)])
            out.append({"callee": name, "defined_in": None, "line": line, "args": args, "is_conditional": bool(around), "context": context})
        return out

    def path(self, start: int, end: int) -> dict:
        returns = re.compile(r"\breturn\b([^;\n]*)").search(self.code, start, end)
        raises = re.compile(r"\bpanic\s*\(").search(self.code, start, end) if self.lang == "Go" else None
        return {"calls": list(dict.fromkeys(n for n, *_ in self.found(start, end))), "returns": self.source[returns.start(1) : returns.end(1)].strip() if returns else None, "raises": "panic" if raises else None}

    def flow(self, complexity: int) -> dict:
        out = common.flow(complexity)
        for start, end, context, word, condition, _ in self.blocks:
            if word == "if":
                other = re.compile(r"\s*else\b").match(self.code, end + 1)
                false = next((self.path(b[0], b[1]) for b in self.blocks if other and b[3] == "else" and b[0] == other.end() - 4), None)
                out["branches"].append({"branch_type": "if", "condition": condition, "line": self.line(start), "true_path": self.path(start, end), "false_path": false})
            elif context == "loop":
                out["loops"].append({"loop_type": word, "condition": condition, "line": self.line(start), "calls": list(dict.fromkeys(n for n, *_ in self.found(start, end)))})
        return out


def _comment_before(source: str, line: int) -> str:
    lines, out = source.split("\n"), []
    n = line - 2
    if n >= 0 and lines[n].rstrip().endswith("*/"):
        while n >= 0:
            out.append(lines[n])
            if "/*" in lines[n]:
                break
            n -= 1
    else:
        while n >= 0 and lines[n].lstrip().startswith("//"):
            out.append(lines[n])
            n -= 1
    return "\n".join(re.sub(r"^\s*(//+|/?\*+/?)\s?|\s*\*+/\s*$", "", x) for x in reversed(out)).strip()


def _record(source: str, code: str, lang: str, name: str, of: str | None, start: int, brace: int, params: list[dict], returns: str, signature: str, static: bool = False) -> dict:
    end = closing(code, brace)
    body = _Body(source, code, brace, end, lang)
    inner = code[brace:end]
    pattern = r"\b(if|for|switch)\b|&&|\|\||[^=!<>]==|!=|<=|>=|[^-+*/&|<]\s[-+*/<>]\s" if lang == "Go" else r"\b(if|for|while|do|switch|case)\b|\?|&&|\|\|"
    complexity = 1 + len(re.findall(pattern, inner)) - (len(_closing_whiles(code, brace, end)) if lang == "C" else 0)
    first, last = body.line(start), body.line(end)
    doc, calls = _comment_before(source, first), body.calls()
    variables = [{"name": p["name"], "var_type": p["type_annotation"], "scope": "param", "defined_at": first, "transformations": [], "used_in": [], "returned": bool(re.search(rf"\breturn\s+{re.escape(p['name'])}\b", inner))} for p in params if re.fullmatch(r"\w+", p["name"])]
    known = {v["name"] for v in variables}
    for m in re.compile(r"\b(\w+)\s*:=" if lang == "Go" else r"\b(?:(?:unsigned|const|struct)\s+)*(?:int|char|long|short|float|double|size_t|bool|\w+_t)\s*\*?\s*(\w+)\s*[=;]").finditer(inner):
        if m[1] not in known:
            known.add(m[1])
            variables.append({"name": m[1], "var_type": "", "scope": "local", "defined_at": body.line(brace + m.start()), "transformations": [], "used_in": [], "returned": bool(re.search(rf"\breturn\s+{m[1]}\b", inner))})
    extra = ()
    if lang == "Go":
        extra = (*(["concurrency"] if re.search(r"\bgo\s", inner) else []), *(["channels"] if "<-" in inner or "chan " in inner else []), *(["defer"] if re.search(r"\bdefer\b", inner) else []), *(["exported"] if name[:1].isupper() else []))
    elif re.search(r"\b(malloc|calloc|realloc|free)\b", inner):
        extra = ("memory-management",)
    return {
        "kind": "method" if of else "function", "class_name": of, "id": f"method_{of}_{name}" if of else f"func_{name}", "name": name, "signature": " ".join(signature.split()), "params": params,
        "return_type": returns, "docstring": doc, "line_start": first, "line_end": last, "calls": calls, "variables": variables, "control_flow": body.flow(complexity),
        "exceptions": {"raises": ["panic"] * len(re.findall(r"\bpanic\s*\(", inner)) if lang == "Go" else [], "propagates": [], "handles": []}, "complexity": complexity, "is_async": False, "decorators": [],
        "tags": common.tags(name, doc, calls, lang, extra), "importance_score": common.importance(name, [], lang, static) + (0.1 if lang == "Go" and of else 0.0),
    }


def _go_params(text: str) -> list[dict]:
    out, waiting = [], []
    for part in _split(text):
        name, _, kind = part.partition(" ")
        waiting.append(name)
        if kind:
            out += [{"name": w, "type_annotation": kind.strip(), "default_value": None} for w in waiting]
            waiting = []
    return out + [{"name": w, "type_annotation": "", "default_value": None} for w in waiting]


def parse_go(source: str) -> dict:
    code = masked(source, "Go")
    out: dict = {"error": None, "imports": [], "functions": [], "classes": [], "global_vars": []}
    for m in re.finditer(r"^import\b[ \t]*(\()?", code, re.M):
        block = source[m.end() : closing(code, m.end() - 1)] if m[1] else source[m.start() + 6 :].split("\n", 1)[0]
        for alias, module in re.findall(r'([\w.]*)[ \t]*"([^"]+)"', block):
            kind = "stdlib" if module.split("/")[0] in GO_STDLIB else "external" if "/" in module else "internal"
            out["imports"].append({"module": module, "items": [alias] if alias else [], "type": kind})
    for m in re.finditer(r"^func\s*(?:\(([^)]*)\)\s*)?(\w+)\s*(?:\[[^\]]*\])?\s*\(", code, re.M):
        close = closing(code, m.end() - 1)
        brace = code.find("{", close)
        if brace < 0 or "\nfunc" in code[close:brace]:
            continue
        of = re.sub(r"\[.*", "", (m[1] or "").split()[-1].lstrip("*")) if (m[1] or "").strip() else None
        out["functions"].append(_record(source, code, "Go", m[2], of, m.start(), brace, _go_params(source[m.end() : close]), source[close + 1 : brace].strip(), source[m.start() : brace]))
    for m in re.finditer(r"^type\s+(\w+)\s*(?:\[[^\]]*\])?\s*(struct|interface)\s*\{", code, re.M):
        end = closing(code, m.end() - 1)
        fields = [re.match(r"\s*(\w+)\s+([^`/\n]+)", x) for x in source[m.end() : end].split("\n")]
        bases = [b[1] for x in code[m.end() : end].split("\n") if (b := re.fullmatch(r"\s*\*?([\w.]+)\s*", x))]
        line = code.count("\n", 0, m.start()) + 1
        out["classes"].append({"id": f"struct_{m[1]}", "name": m[1], "bases": bases, "docstring": _comment_before(source, line), "line_start": line, "line_end": code.count("\n", 0, end) + 1, "attributes": [{"name": f[1], "type_annotation": f[2].strip(), "value": None} for f in fields if f], "decorators": []})
    for m in re.finditer(r"^(?:var|const)\s+(\w+)[ \t]*([^=\n(]*)(?:=[ \t]*([^\n]*))?$", code, re.M):
        out["global_vars"].append({"name": m[1], "type_annotation": m[2].strip(), "value": source[m.start(3) : m.end(3)].strip() if m[3] is not None else "", "line": code.count("\n", 0, m.start()) + 1})
    return out


def parse_c(source: str) -> dict:
    code = masked(source, "C")
    out: dict = {"error": None, "imports": [], "functions": [], "classes": [], "global_vars": []}
    for system, own in re.findall(r"^[ \t]*#[ \t]*include[ \t]*(?:<([^>\n]+)>|\"([^\"\n]+)\")", source, re.M):
        out["imports"].append({"module": system or own, "items": [], "type": "stdlib" if system else "external" if "/" in own else "internal"})
    flat = re.sub(r"^[ \t]*#(?:[^\n\\]|\\.|\\\n)*", lambda m: re.sub(r"[^\n]", " ", m[0]), code, flags=re.M)
    taken = 0
    for m in re.finditer(r"^([A-Za-z_][\w\s*]*?[\s*])(\w+)\s*\(", flat, re.M):
        if m.start() < taken or m[2] in _WORDS or re.match(r"\s*(return|else|typedef)\b", m[1]):
            continue
        close = closing(flat, m.end() - 1)
        after = re.compile(r"\s*\{").match(flat, close + 1)
        if not after:
            continue
        brace = after.end() - 1
        params = []
        for k, p in enumerate(x for x in _split(source[m.end() : close]) if x != "void"):
            name = re.search(r"(\w+)\s*(\[[^\]]*\])*$", p)
            params.append({"name": "...", "type_annotation": "", "default_value": None} if p == "..." else {"name": name[1], "type_annotation": p[: name.start()].strip(), "default_value": None} if name and p[: name.start()].strip() else {"name": f"_param{k}", "type_annotation": p, "default_value": None})
        returns = " ".join(w for w in m[1].split() if w not in ("static", "inline", "extern"))
        out["functions"].append(_record(source, flat, "C", m[2], None, m.start(), brace, params, returns, source[m.start() : close + 1], "static" in m[1].split()))
        taken = closing(flat, brace)
    for m in re.finditer(r"\b(struct|union)\s+(\w+)?\s*\{", flat):
        end = closing(flat, m.end() - 1)
        name = m[2] or (re.match(r"\s*(\w+)", flat[end + 1 :]) or [None, None])[1]
        if not name:
            continue
        fields = [re.search(r"(\w+)\s*(\[[^\]]*\])*$", x.strip()) for x in source[m.end() : end].split(";")]
        parts = [x.strip() for x in source[m.end() : end].split(";")]
        line = flat.count("\n", 0, m.start()) + 1
        out["classes"].append({"id": f"{m[1]}_{name}", "name": name, "bases": [], "docstring": _comment_before(source, line), "line_start": line, "line_end": flat.count("\n", 0, end) + 1, "attributes": [{"name": f[1], "type_annotation": p[: f.start()].strip(), "value": None} for f, p in zip(fields, parts, strict=True) if f], "decorators": []})
    outside = re.sub(r"\{[^{}]*\}", lambda m: re.sub(r"[^\n]", " ", m[0]), flat)
    while "{" in outside and (nxt := re.sub(r"\{[^{}]*\}", lambda m: re.sub(r"[^\n]", " ", m[0]), outside)) != outside:
        outside = nxt
    for m in re.finditer(r"^((?:static|const|extern|volatile|unsigned|signed|struct)\s+)*([A-Za-z_]\w*[\s*]+)(\w+)\s*(\[[^\]\n]*\])?\s*(?:=\s*([^;]*))?;", outside, re.M):
        if m[2].split()[0] not in ("return", "typedef", "struct", "union", "goto"):
            out["global_vars"].append({"name": m[3], "type_annotation": " ".join(((m[1] or "") + m[2]).split()), "value": source[m.start(5) : m.end(5)].strip() if m[5] is not None else "", "line": outside.count("\n", 0, m.start(3)) + 1})
    return out
