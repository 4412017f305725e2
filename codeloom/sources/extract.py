"""Symbols, calls and dependencies of source files.

Python files are read with the language's own parser. Go, TypeScript or
JavaScript and PHP files are read with a lexer that blanks comments and
strings, then finds declarations and matches braces; so what is unusual in
layout may be missed.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

SYMBOL = "struct<name:string,parent:string,kind:string,signature:string,start_line:int,end_line:int>"
CALL = "struct<enclosing:int,callee:string,qualifier:string,hint:string,line:int>"
DEP = "struct<enclosing:int,kind:string,target:string,source:string,line:int>"
PARSED = f"path string, lang string, namespace string, symbols array<{SYMBOL}>, calls array<{CALL}>, deps array<{DEP}>"
LONGEST_SIGNATURE = 160
# words that stand before a parenthesis without being called
NOT_CALLS = {
    "go": frozenset("if for switch return func go defer select case range import const var type".split()),
    "tsjs": frozenset("if for while switch return function catch case new typeof await yield super constructor else do try import of in".split()),
    "php": frozenset("if for while switch return function catch case foreach match elseif echo print isset empty unset list array include require include_once require_once fn use and or not".split()),
}


@dataclass
class Parsed:
    namespace: str = ""
    symbols: list[dict] = field(default_factory=list)
    spans: list[tuple[int, int]] = field(default_factory=list)
    calls: list[dict] = field(default_factory=list)
    deps: list[dict] = field(default_factory=list)

    def symbol(self, span: tuple[int, int], lines: tuple[int, int], name: str, parent: str, kind: str, signature: str) -> None:
        self.spans.append(span)
        clean = " ".join(signature.split())[:LONGEST_SIGNATURE]
        self.symbols.append({"name": name, "parent": parent, "kind": kind, "signature": clean, "start_line": lines[0], "end_line": lines[1]})

    def enclosing(self, at: int) -> int:
        """The smallest span around a place, the first of equal ones; -1 if none."""
        inside = [(e - s, i) for i, (s, e) in enumerate(self.spans) if s <= at < e]
        return min(inside)[1] if inside else -1


# Python


class PythonReader(ast.NodeVisitor):
    def __init__(self, source: str) -> None:
        self.out, self.lines = Parsed(), source.split("\n")
        self.starts = [0]
        for line in self.lines:
            self.starts.append(self.starts[-1] + len(line.encode()) + 1)
        self.body_of, self.self_of, self.late = "", "", []

    def at(self, line: int, column: int) -> int:
        return self.starts[line - 1] + column

    def span(self, node: ast.AST) -> tuple[int, int]:
        return self.at(node.lineno, node.col_offset), self.at(node.end_lineno, node.end_col_offset)

    def declare(self, node, parent: str, kind: str) -> None:
        text = " ".join(self.lines[node.lineno - 1 : max(node.lineno, node.body[0].lineno - 1)])
        self.out.symbol(self.span(node), (node.lineno, node.end_lineno), node.name, parent, kind, text.strip().rstrip(":"))

    def inside(self, node: ast.AST, body_of: str, self_of: str) -> None:
        before = self.body_of, self.self_of
        self.body_of, self.self_of = body_of, self_of
        self.generic_visit(node)
        self.body_of, self.self_of = before

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        self.declare(node, "", "type")
        for base in node.bases:
            if isinstance(base, ast.Name):
                self.late.append((self.out.deps, {"kind": "extends", "target": base.id, "source": "", "line": base.lineno}, self.at(base.lineno, base.col_offset)))
        self.inside(node, node.name, self.self_of)

    def visit_FunctionDef(self, node) -> None:
        self.declare(node, self.body_of, "method" if self.body_of else "func")
        self.inside(node, "", self.body_of or self.self_of)

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_Import(self, node: ast.Import) -> None:
        for name in node.names:
            self.late.append((self.out.deps, {"kind": "imports", "target": name.name, "source": "", "line": node.lineno}, self.at(node.lineno, node.col_offset)))

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        for name in node.names:
            if name.name != "*":
                self.late.append((self.out.deps, {"kind": "imports", "target": name.name, "source": "." * node.level + (node.module or ""), "line": node.lineno}, self.at(node.lineno, node.col_offset)))

    def visit_Call(self, node: ast.Call) -> None:
        callee, qualifier = "", ""
        if isinstance(node.func, ast.Name):
            callee = node.func.id
        elif isinstance(node.func, ast.Attribute):
            callee, owner = node.func.attr, node.func.value
            if isinstance(owner, ast.Name):
                qualifier = self.self_of if owner.id in ("self", "cls") else owner.id if owner.id[:1].isupper() else ""
        if callee:
            self.late.append((self.out.calls, {"callee": callee, "qualifier": qualifier, "hint": "", "line": node.lineno}, self.at(node.lineno, node.col_offset)))
        self.generic_visit(node)


def read_python(source: str) -> Parsed:
    reader = PythonReader(source)
    try:
        reader.visit(ast.parse(source))
    except (SyntaxError, ValueError, RecursionError):
        return Parsed()
    for where, row, at in reader.late:
        where.append(row | {"enclosing": reader.out.enclosing(at)})
    return reader.out


# languages with braces


def blanked(source: str, quotes: str, hash_comments: bool) -> str:
    """source with comments and what strings hold replaced by blanks, of the same length and lines."""
    marks = [r"//[^\n]*", r"/\*.*?\*/"] + ([r"#(?!\[)[^\n]*"] if hash_comments else [])
    strings = [rf"{q}(?:\\.|[^\\{q}])*{q}" if q != "`" else r"`[^`]*`" for q in quotes]
    blank = lambda m: re.sub(r"[^\n]", " ", m[0]) if m[0][0] in "/#" else m[0][0] + re.sub(r"[^\n]", " ", m[0][1:-1]) + m[0][-1]
    return re.sub("|".join(marks + strings), blank, source, flags=re.S)


class BraceReader:
    def __init__(self, source: str, quotes: str, hash_comments: bool = False) -> None:
        self.source, self.code = source, blanked(source, quotes, hash_comments)
        self.newlines = [i for i, c in enumerate(source) if c == "\n"]
        self.close: dict[int, int] = {}
        open_: list[int] = []
        for i, c in enumerate(self.code):
            if c == "{":
                open_.append(i)
            elif c == "}" and open_:
                self.close[open_.pop()] = i + 1
        self.out = Parsed()

    def line(self, at: int) -> int:
        return bisect_right(self.newlines, at - 1) + 1

    def block(self, at: int, stop: str = ";") -> tuple[int, int]:
        """The first block from a place on: (its brace, its end); without one, the end of the statement twice."""
        depth = 0
        for i in range(at, len(self.code)):
            c = self.code[i]
            depth += (c in "([") - (c in ")]")
            if depth <= 0 and c == "{" and i in self.close:
                return i, self.close[i]
            if depth <= 0 and c in stop:
                return i, i
        return len(self.code), len(self.code)

    def declare(self, at: int, header: int, name: str, parent: str, kind: str, stop: str = ";") -> tuple[int, int]:
        brace, end = self.block(header, stop)
        self.out.symbol((at, end), (self.line(at), self.line(max(at, end - 1))), name, parent, kind, self.source[at:brace])
        return brace, end

    def dep(self, at: int, kind: str, target: str, source: str = "") -> None:
        self.out.deps.append({"enclosing": self.out.enclosing(at), "kind": kind, "target": target, "source": source, "line": self.line(at)})

    def call(self, at: int, callee: str, qualifier: str = "", hint: str = "") -> None:
        self.out.calls.append({"enclosing": self.out.enclosing(at), "callee": callee, "qualifier": qualifier, "hint": hint, "line": self.line(at)})


def read_go(source: str) -> Parsed:
    r = BraceReader(source, "\"`'")
    receivers: list[tuple[int, int, str, str]] = []
    declared = set()
    for m in re.finditer(r"^func\s*(?:\(\s*(?:(\w+)\s+)?\*?\s*(\w+)[^)]*\)\s*)?(\w+)\s*(?:\[[^\]]*\])?\(", r.code, re.M):
        brace, end = r.declare(m.start(), m.end() - 1, m[3], m[2] or "", "method" if m[2] else "func", "\n")
        declared.add(m.start(3))
        receivers.append((brace, end, m[1] or "", m[2] or ""))
    structs = []
    for m in re.finditer(r"^(?:type\s+|[ \t]+)(\w+)\s+(struct|interface)\s*\{", r.code, re.M):
        _, end = r.declare(m.start(), m.end() - 1, m[1], "", "type")
        structs += [(m.end(), end - 1)] if m[2] == "struct" else []
    for m in re.finditer(r"^type\s+(\w+)\s+(?!struct\b|interface\b)[\w*\[\].]", r.code, re.M):
        r.declare(m.start(), m.end(), m[1], "", "type", "\n")
    for lo, hi in structs:
        for m in re.finditer(r"^[ \t]*\*?(?:\w+\.)?([A-Z]\w*)[ \t]*$", r.code[lo:hi], re.M):
            r.dep(lo + m.start(1), "extends", m[1])
    aliases = {}
    for m in re.finditer(r"^import\s*\((.*?)\)|^import\s+([^\n(]+)", r.source, re.M | re.S):
        at = m.start(1) if m[1] is not None else m.start(2)
        for spec in re.finditer(r"(?:([\w.]+)[ \t]+)?\"([^\"]+)\"", m[1] if m[1] is not None else m[2]):
            aliases[spec[1] or spec[2].rpartition("/")[2]] = spec[2]
            r.dep(at + spec.start(), "imports", spec[2])
    for m in re.finditer(r"(?:\b(\w+)\s*\.\s*)?\b(\w+)\s*\(", r.code):
        if m.start(2) in declared or m[2] in NOT_CALLS["go"]:
            continue
        own = next(((v, t) for lo, hi, v, t in receivers if lo <= m.start() < hi), ("", ""))
        qualifier = own[1] if m[1] and m[1] == own[0] else ""
        r.call(m.start(), m[2], qualifier, aliases.get(m[1] or "", "") if not qualifier else "")
    return r.out


def read_tsjs(source: str) -> Parsed:
    r = BraceReader(source, "\"'`")
    classes, declared = [], set()
    for m in re.finditer(r"\bclass\s+(\w+)(?:\s*<[^{]*?>)?(?:\s+extends\s+([\w.]+)(?:<[^{]*?>)?)?(?:\s+implements\s+([^{]+))?\s*\{", r.code):
        brace, end = r.declare(m.start(), m.end() - 1, m[1], "", "type")
        classes.append((brace, end, m[1]))
        if m[2]:
            r.dep(m.start(2), "extends", m[2].rpartition(".")[2])
        for name in re.findall(r"\w+(?=\s*(?:<[^,]*>)?\s*(?:,|$))", m[3] or ""):
            r.dep(m.start(3), "implements", name)
    for m in re.finditer(r"\benum\s+(\w+)\s*\{", r.code):
        r.declare(m.start(), m.end() - 1, m[1], "", "type")
    for m in re.finditer(r"\bfunction\s*\*?\s*(\w+)\s*(?:<[^(]*>)?\(", r.code):
        r.declare(m.start(), m.end() - 1, m[1], "", "func")
        declared.add(m.start(1))
    for m in re.finditer(r"\b(?:const|let|var)\s+(\w+)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\([^()]*\)|\w+)\s*(?::[^=]+)?=>", r.code):
        r.declare(m.start(), m.end(), m[1], "", "func", ";\n")
    for brace, end, name in classes:
        for m in re.finditer(r"^[ \t]*(?:(?:public|private|protected|static|async|readonly|override|abstract|get|set)\s+)*[#*]?(\w+)\s*(?:<[^(]*>)?\([^;{}]*\)\s*(?::[^;{}]+)?\{", r.code[brace + 1 : end], re.M):
            at = brace + 1 + m.start(1)
            if m[1] not in NOT_CALLS["tsjs"] - {"constructor"} and sum(b <= at < e for b, e in r.close.items()) == sum(b <= brace < e for b, e in r.close.items()):
                r.declare(at, brace + m.end(), m[1], name, "method")
                declared.add(at)
    for m in re.finditer(r"\bimport\s+(?!\s*\*)(?:type\s+)?(?:(\w+)\s*,?\s*)?(?:\{([^}]*)\})?\s*from\s*[\"']([^\"']+)[\"']", r.source):
        names = [m[1]] if m[1] else []
        names += [n.strip().split(" as ")[0].strip() for n in (m[2] or "").split(",") if n.strip()]
        for n in names:
            r.dep(m.start(), "imports", n, m[3])
    for m in re.finditer(r"(?:\b(\w+)\s*\??\.\s*)?(new\s+)?\b(\w+)\s*(?:<[\w, ]+>)?\(", r.code):
        if m.start(3) in declared or m[3] in NOT_CALLS["tsjs"]:
            continue
        own = next((n for b, e, n in reversed(classes) if b <= m.start() < e), "")
        r.call(m.start(), m[3], own if m[1] == "this" else m[1] if m[1] and m[1][:1].isupper() else "")
    return r.out


def read_php(source: str) -> Parsed:
    r = BraceReader(source, "\"'", hash_comments=True)
    if m := re.search(r"^\s*namespace\s+([\w\\]+)", r.code, re.M):
        r.out.namespace = m[1]
    last = lambda name: name.strip().rpartition("\\")[2]
    classes, declared = [], set()
    for m in re.finditer(r"\b(?:class|interface|trait)\s+(\w+)(?:\s+extends\s+([\w\\, ]+?))?(?:\s+implements\s+([\w\\, ]+?))?\s*\{", r.code):
        brace, end = r.declare(m.start(), m.end() - 1, m[1], "", "type")
        classes.append((brace, end, m[1]))
        for group, kind in ((2, "extends"), (3, "implements")):
            for name in (m[group] or "").split(","):
                if name.strip():
                    r.dep(m.start(group), kind, last(name))
    owner = lambda at: next((n for b, e, n in reversed(classes) if b <= at < e), "")
    for m in re.finditer(r"\bfunction\s+&?(\w+)\s*\(", r.code):
        own = owner(m.start())
        r.declare(m.start(), m.end() - 1, m[1], own, "method" if own else "func")
        declared.add(m.start(1))
    for m in re.finditer(r"^[ \t]*use\s+(?!function|const)([\w\\, {}]+?)(?:\s+as\s+\w+)?\s*;", r.code, re.M):
        for name in m[1].split(","):
            if owner(m.start()):
                r.dep(m.start(), "implements", last(name))
            else:
                r.dep(m.start(), "imports", last(name), name.strip())
    for m in re.finditer(r"(?:(\$?\w+)\s*(?:->|\?->|::)\s*)?(new\s+)?([\w\\]+)\s*\(", r.code):
        if m.start(3) in declared or last(m[3]) in NOT_CALLS["php"] or m[3][0].isdigit():
            continue
        q = m[1] or ""
        r.call(m.start(), last(m[3]), owner(m.start()) if q in ("$this", "self", "static") else q if q[:1].isupper() else "")
    return r.out


READERS = {"python": read_python, "go": read_go, "tsjs": read_tsjs, "php": read_php}


def parse(lang: str, source: str) -> Parsed:
    return READERS[lang](source) if lang in READERS else Parsed()


def extract(files: DataFrame) -> DataFrame:
    """What each file (path, lang, content) declares and uses; a file that cannot be read declares nothing."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, lang, content in zip(pdf["path"], pdf["lang"], pdf["content"], strict=True):
                p = parse(lang, content or "")
                rows.append((path, lang, p.namespace, p.symbols, p.calls, p.deps))
            yield pd.DataFrame(rows, columns=["path", "lang", "namespace", "symbols", "calls", "deps"])

    return files.select("path", "lang", "content").mapInPandas(run, PARSED)
