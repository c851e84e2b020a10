"""Python sources to records, by the standard library's parser; a file with a syntax error is read line by line."""

from __future__ import annotations

import ast
import bisect
import re

from . import parse_common as common

STDLIB = frozenset("abc argparse asyncio collections datetime functools itertools json logging math os pathlib random re sys threading time typing".split())
#: Kinds of nodes as tuples: a union of types is made anew at each test of a node.
_LOOPS, _TRIES, _DEFINITIONS = (ast.For, ast.AsyncFor, ast.While), (ast.Try, ast.TryStar), (ast.FunctionDef, ast.AsyncFunctionDef)
_BLOCKS = (ast.If, *_LOOPS, *_TRIES)
_BRANCHING = (ast.If, *_LOOPS, ast.ExceptHandler, ast.With, ast.AsyncWith)
_BOUND, _YIELDS = (ast.Assign, ast.AnnAssign, ast.Return), (ast.Yield, ast.YieldFrom)
_DUNDER = re.compile("__.*__")


def import_kind(module: str) -> str:
    return "stdlib" if module in STDLIB else "internal" if module.startswith(".") or "/" in module else "external"


def _call_name(node: ast.Call) -> str:
    f = node.func
    return f.attr if isinstance(f, ast.Attribute) else f.id if isinstance(f, ast.Name) else ""


def _children(node: ast.AST) -> list[ast.AST]:
    out = []
    for field in node._fields:
        value = getattr(node, field, None)
        if value.__class__ is list:
            out += [x for x in value if isinstance(x, ast.AST)]
        elif isinstance(value, ast.AST) and value._fields:
            out.append(value)
    return out


def _walk(node: ast.AST) -> tuple[list[ast.AST], dict[int, list[ast.AST]]]:
    """All nodes under and with ``node``, but for the marks of loading and storing, and the children of each by its id."""
    out, children = [node], {}
    for n in out:
        children[id(n)] = found = _children(n)
        out += found
    return out, children


class _Source:
    """A file's lines as bytes, which the parser's columns count; cut once, and not for each piece as the library does."""

    def __init__(self, source: str):
        self.lines = [line.encode() for line in re.split(r"(?<=\n)|(?<=\r)(?!\n)", source)]

    def text(self, node: ast.AST | None) -> str:
        if node is None:
            return ""
        first, last = node.lineno - 1, node.end_lineno - 1
        if first == last:
            return self.lines[first][node.col_offset : node.end_col_offset].decode()
        return b"".join([self.lines[first][node.col_offset :], *self.lines[first + 1 : last], self.lines[last][: node.end_col_offset]]).decode()


class _Function:
    def __init__(self, source: _Source, node: ast.FunctionDef | ast.AsyncFunctionDef):
        self.source, self.node, self.text = source, node, source.text
        self.nodes, self.children = _walk(node)
        self.called = sorted((x.lineno, x.col_offset, name) for x in self.nodes if isinstance(x, ast.Call) and (name := _call_name(x)))

    def names(self, nodes: list[ast.stmt]) -> list[str]:
        """What a run of statements calls, in order, each once."""
        if not nodes:
            return []
        low = bisect.bisect_left(self.called, (nodes[0].lineno, nodes[0].col_offset))
        high = bisect.bisect_left(self.called, (nodes[-1].end_lineno, nodes[-1].end_col_offset))
        return list(dict.fromkeys(name for *_, name in self.called[low:high]))

    def params(self) -> list[dict]:
        a = self.node.args
        plain = [*a.posonlyargs, *a.args]
        defaults = [None] * (len(plain) - len(a.defaults)) + list(a.defaults)
        every = [("", p, d) for p, d in zip(plain, defaults, strict=True)]
        every += [("*", a.vararg, None)] if a.vararg else []
        every += [("", p, d) for p, d in zip(a.kwonlyargs, a.kw_defaults, strict=True)]
        every += [("**", a.kwarg, None)] if a.kwarg else []
        return [{"name": s + p.arg, "type_annotation": self.text(p.annotation), "default_value": self.text(d) if d is not None else None} for s, p, d in every if p.arg not in ("self", "cls")]

    def calls(self) -> list[dict]:
        out, seen = [], set()

        def visit(node: ast.AST, context: str) -> None:
            if isinstance(node, ast.Call) and (name := _call_name(node)) and (name, node.lineno) not in seen:
                seen.add((name, node.lineno))
                args = [self.text(x) for x in node.args if isinstance(x, ast.Name) or (isinstance(x, ast.Constant) and isinstance(x.value, str | int))]
                out.append({"callee": name, "defined_in": None, "line": node.lineno, "args": args, "is_conditional": context != "unconditional", "context": context})
            parts: list[tuple[list[ast.AST], str]]
            if isinstance(node, ast.If):
                chained = len(node.orelse) == 1 and isinstance(node.orelse[0], ast.If) and self.source.text(node.orelse[0]).startswith("elif")
                parts = [([node.test, *node.body], "elif" if context == "_elif" else "if"), (node.orelse, "_elif" if chained else "else")]
            elif isinstance(node, _LOOPS):
                inner = [node.test] if isinstance(node, ast.While) else [node.target, node.iter]
                parts = [([*inner, *node.body], "loop"), (node.orelse, "else")]
            elif isinstance(node, _TRIES):
                parts = [(node.body, "try"), (node.handlers, "except"), (node.orelse, "else"), (node.finalbody, "try")]
            else:
                parts = [(self.children[id(node)], context)]
            for nodes, where in parts:
                for n in nodes:
                    visit(n, where)

        for n in self.node.body:
            visit(n, "unconditional")
        return out

    def variables(self, params: list[dict]) -> list[dict]:
        make = lambda name, kind, scope, line: {"name": name, "var_type": kind, "scope": scope, "defined_at": line, "transformations": [], "used_in": [], "returned": False}
        found = {p["name"]: make(p["name"], p["type_annotation"], "param", self.node.lineno) for p in params}
        for n in sorted((x for x in self.nodes if isinstance(x, _BOUND)), key=lambda x: (x.lineno, x.col_offset)):
            if isinstance(n, ast.Return):
                if isinstance(n.value, ast.Name) and n.value.id in found:
                    found[n.value.id]["returned"] = True
                continue
            for target in n.targets if isinstance(n, ast.Assign) else [n.target]:
                if not isinstance(target, ast.Name):
                    continue
                if isinstance(n.value, ast.Call) and (via := _call_name(n.value)):
                    for x in n.value.args:
                        if isinstance(x, ast.Name) and x.id in found:
                            found[x.id]["transformations"].append({"line": n.lineno, "via": via, "becomes": target.id})
                if target.id not in found:
                    found[target.id] = make(target.id, self.text(n.annotation) if isinstance(n, ast.AnnAssign) else "", "local", n.lineno)
        return list(found.values())

    def path(self, nodes: list[ast.stmt]) -> dict:
        returns = next((self.text(n.value) for n in nodes if isinstance(n, ast.Return)), None)
        raises = next((self.raised(n) for n in nodes if isinstance(n, ast.Raise)), None)
        return {"calls": self.names(nodes), "returns": returns, "raises": raises}

    def raised(self, node: ast.Raise) -> str:
        e = node.exc.func if isinstance(node.exc, ast.Call) else node.exc
        return self.text(e)

    def flow(self, complexity: int) -> dict:
        out = common.flow(complexity)
        for n in sorted((x for x in self.nodes if isinstance(x, _BLOCKS)), key=lambda x: (x.lineno, x.col_offset)):
            if isinstance(n, ast.If):
                out["branches"].append({"branch_type": "if", "condition": self.text(n.test), "line": n.lineno, "true_path": self.path(n.body), "false_path": self.path(n.orelse) if n.orelse else None})
            elif isinstance(n, _TRIES):
                clauses = [{"exception_type": self.text(h.type) or "Exception", "line": h.lineno, "calls": self.names(h.body)} for h in n.handlers]
                out["try_blocks"].append({"line": n.lineno, "try_calls": self.names(n.body), "except_clauses": clauses, "finally_calls": self.names(n.finalbody)})
            else:
                kind, condition = ("while", self.text(n.test)) if isinstance(n, ast.While) else ("for", f"{self.text(n.target)} in {self.text(n.iter)}")
                out["loops"].append({"loop_type": kind, "condition": condition, "line": n.lineno, "calls": self.names(n.body)})
        return out

    def exceptions(self) -> dict:
        raises = [self.raised(n) for n in self.nodes if isinstance(n, ast.Raise) and n.exc is not None]
        handles = [self.text(t) for n in self.nodes if isinstance(n, ast.ExceptHandler) and n.type is not None for t in (n.type.elts if isinstance(n.type, ast.Tuple) else [n.type])]
        return {"raises": list(dict.fromkeys(raises)), "propagates": [], "handles": list(dict.fromkeys(handles))}

    def complexity(self) -> int:
        n = 1
        for x in self.nodes:
            if isinstance(x, _BRANCHING):
                n += 1
            elif isinstance(x, ast.BoolOp):
                n += len(x.values) - 1
        return n

    def record(self, of: str | None) -> dict:
        node, params, calls = self.node, self.params(), self.calls()
        is_async, doc, complexity = isinstance(node, ast.AsyncFunctionDef), ast.get_docstring(node, clean=False) or "", self.complexity()
        decorators = ["@" + self.text(d) for d in node.decorator_list]
        shown = ", ".join(p["name"] + (f": {p['type_annotation']}" if p["type_annotation"] else "") + (f" = {p['default_value']}" if p["default_value"] is not None else "") for p in params)
        returns = self.text(node.returns)
        extra = (*(["async"] if is_async else []), *(["dunder"] if _DUNDER.fullmatch(node.name) else ["private"] if node.name.startswith("_") else []), *(["property"] if "@property" in decorators else []), *(["generator"] if any(isinstance(x, _YIELDS) for x in self.nodes) else []))
        return {
            "kind": "method" if of else "function", "class_name": of, "id": f"method_{of}_{node.name}" if of else f"func_{node.name}", "name": node.name,
            "signature": f"{'async ' if is_async else ''}def {node.name}({shown})" + (f" -> {returns}" if returns else ""), "params": params, "return_type": returns, "docstring": doc.strip(),
            "line_start": node.lineno, "line_end": node.end_lineno, "calls": calls, "variables": self.variables(params), "control_flow": self.flow(complexity), "exceptions": self.exceptions(),
            "complexity": complexity, "is_async": is_async, "decorators": decorators, "tags": common.tags(node.name, doc, calls, "Python", extra), "importance_score": common.importance(node.name, decorators, "Python"),
        }


def _class(source: _Source, node: ast.ClassDef) -> dict:
    text = source.text
    attributes = [{"name": n.target.id, "type_annotation": text(n.annotation), "value": text(n.value) if n.value is not None else None} for n in node.body if isinstance(n, ast.AnnAssign) and isinstance(n.target, ast.Name)]
    return {"id": f"class_{node.name}", "name": node.name, "bases": [text(b) for b in node.bases], "docstring": (ast.get_docstring(node, clean=False) or "").strip(), "line_start": node.lineno, "line_end": node.end_lineno, "attributes": attributes, "decorators": ["@" + text(d) for d in node.decorator_list]}


def parse(source: str) -> dict:
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        return by_line(source) | {"error": f"{type(e).__name__}: {e}"}
    out: dict = {"error": None, "imports": [], "functions": [], "classes": [], "global_vars": []}
    cut = _Source(source)
    try:
        for n in tree.body:
            if isinstance(n, ast.Import):
                out["imports"] += [{"module": a.name, "items": [], "type": import_kind(a.name)} for a in n.names]
            elif isinstance(n, ast.ImportFrom):
                module = "." * n.level + (n.module or "")
                out["imports"].append({"module": module, "items": [a.name for a in n.names], "type": import_kind(module)})
            elif isinstance(n, _DEFINITIONS):
                out["functions"].append(_Function(cut, n).record(None))
            elif isinstance(n, ast.ClassDef):
                out["classes"].append(_class(cut, n))
                out["functions"] += [_Function(cut, m).record(n.name) for m in n.body if isinstance(m, _DEFINITIONS)]
            elif isinstance(n, ast.Assign | ast.AnnAssign) and n.value is not None:
                for t in n.targets if isinstance(n, ast.Assign) else [n.target]:
                    if isinstance(t, ast.Name):
                        note = cut.text(n.annotation) if isinstance(n, ast.AnnAssign) else ""
                        out["global_vars"].append({"name": t.id, "type_annotation": note or "", "value": cut.text(n.value), "line": n.lineno})
    except RecursionError as e:
        return by_line(source) | {"error": f"RecursionError: {e}"}
    return out


def by_line(source: str) -> dict:
    """Names, imports and calls of a file that can't be parsed: a definition goes to the next line of no deeper indent."""
    lines = common.lines_of(source)
    out: dict = {"imports": [], "functions": [], "classes": [], "global_vars": []}
    of, depth = None, 0

    def end(start: int, indent: int) -> int:
        last = start
        for n in range(start, len(lines)):
            if lines[n].strip() and len(lines[n]) - len(lines[n].lstrip()) <= indent:
                break
            last = n + 1 if lines[n].strip() else last
        return last

    for n, line in enumerate(lines, 1):
        if m := re.match(r"(\s*)class\s+(\w+)\s*(?:\(([^)]*)\))?", line):
            of, depth = m[2], len(m[1])
            out["classes"].append({"id": f"class_{of}", "name": of, "bases": [b.strip() for b in (m[3] or "").split(",") if b.strip()], "docstring": "", "line_start": n, "line_end": end(n, depth), "attributes": [], "decorators": []})
        elif m := re.match(r"(\s*)(async\s+)?def\s+(\w+)\s*\(([^)]*)", line):
            inside = of if of and len(m[1]) > depth else None
            if len(m[1]) and not inside:
                continue
            last = end(n, len(m[1]))
            body = "\n".join(lines[n:last])
            calls = [{"callee": c[1], "defined_in": None, "line": n + 1 + body[: c.start()].count("\n"), "args": [], "is_conditional": False, "context": "unconditional"} for c in re.finditer(r"(\w+)\s*\(", body) if c[1] not in ("if", "while", "for", "return", "def", "and", "or", "not", "in", "class", "elif")]
            complexity = 1 + len(re.findall(r"\b(if|elif|while|for|except|with|and|or)\b", body))
            out["functions"].append({
                "kind": "method" if inside else "function", "class_name": inside, "id": f"method_{inside}_{m[3]}" if inside else f"func_{m[3]}", "name": m[3], "signature": line.strip().rstrip(":"),
                "params": [{"name": p.split(":")[0].split("=")[0].strip(), "type_annotation": "", "default_value": None} for p in m[4].split(",") if p.strip() and p.strip() not in ("self", "cls")],
                "return_type": "", "docstring": "", "line_start": n, "line_end": last, "calls": calls, "variables": [], "control_flow": common.flow(complexity), "exceptions": {"raises": [], "propagates": [], "handles": []},
                "complexity": complexity, "is_async": bool(m[2]), "decorators": [], "tags": common.tags(m[3], "", calls, "Python"), "importance_score": common.importance(m[3], [], "Python"),
            })
        elif m := re.match(r"(?:from\s+(\S+)\s+)?import\s+(.+)", line):
            for module in [m[1]] if m[1] else [x.split()[0] for x in m[2].split(",") if x.strip()]:
                out["imports"].append({"module": module, "items": [x.split()[0] for x in m[2].strip("() ").split(",") if x.strip()] if m[1] else [], "type": import_kind(module)})
    return out
