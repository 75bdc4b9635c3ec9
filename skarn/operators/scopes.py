"""Scopes of source files as chunks: classes, functions, methods and tests, each with its comments.

A file is read as nested regions of lines.  Every region that stands for a definition
becomes a chunk; what is left of its parent becomes the parent's chunk, without the lines
its children have taken.  Comment and decorator lines right above a region belong to it.
What no region takes becomes blocks.

Tests (``describe``/``it``, ``context``/``specify``): an example is a chunk of its own, named
by its scopes; what a scope has besides is its setup.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

#: Lines of macros in a Ruby class body that stand together as one chunk.
MACRO_LINES = 3


@dataclass
class Region:
    first: int  # lines from 1, with comments above
    last: int
    kind: str  # class, interface, function, method, test, scope, setup
    name: str
    static: bool = False
    children: list[Region] = field(default_factory=list)


# What opens tests and their setup, in scripts and in Ruby.
SCRIPT_SCOPES, SCRIPT_TESTS, SCRIPT_SETUP = ("describe", "context", "suite"), ("it", "test", "specify"), ("beforeEach", "beforeAll", "afterEach", "afterAll", "before", "after", "setup", "teardown")
RUBY_SCOPES, RUBY_TESTS, RUBY_SETUP = ("describe", "context", "feature", "shared_examples", "shared_context"), ("it", "specify", "scenario", "example"), ("before", "after", "around", "let", "let!", "subject")

_SCRIPT = (
    (re.compile(r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(?P<name>\w+)"), "class"),
    (re.compile(r"^\s*(?:export\s+)?(?:declare\s+)?(?:interface|enum|namespace)\s+(?P<name>\w+)"), "interface"),
    (re.compile(r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(?P<name>\w+)\s*[<(]"), "function"),
    (re.compile(r"^\s*(?:export\s+)?(?:const|let|var)\s+(?P<name>\w+)\s*(?::[^=]+)?=\s*(?:async\s+)?(?:function\b|\([^)]*\)\s*(?::[^=]+)?=>|\w+\s*=>)"), "function"),
    (re.compile(r"^\s*(?:module\.)?exports\.(?P<name>\w+)\s*=\s*(?:async\s+)?(?:function\b|\(|\w+\s*=>)"), "function"),
    (re.compile(r"^\s*(?P<owner>\w+)\.prototype\.(?P<name>\w+)\s*=\s*(?:async\s+)?function\b"), "method"),
    (re.compile(r"^\s*(?P<static>\w+)\.(?P<name>\w+)\s*=\s*(?:async\s+)?(?:function\b|\([^)]*\)\s*=>)"), "method"),
)
_MEMBER = re.compile(r"^\s*(?P<mods>(?:(?:public|private|protected|static|async|override|readonly|get|set)\s+)*)(?P<name>#?[\w$]+)\s*(?:<[^(]*>)?\([^;]*$")
_FIELD = re.compile(r"^\s*(?:(?:public|private|protected|static|readonly)\s+)*(?P<name>#?\w+)\s*(?::[^=]+)?=\s*(?:async\s+)?(?:\([^)]*\)|\w+)\s*=>")
_CALLS = re.compile(r"^\s*(?P<call>[\w!]+)(?:\.\w+)*\s*\(?\s*(?P<text>['\"`].*?['\"`]|[\w:]+)?")
_NO_MEMBER = frozenset("if for while switch catch function return constructor_".split())


def _above(lines: list[str], first: int, low: int, comment: str) -> int:
    """The first of the comment and decorator lines that stand right above a line."""
    k = first
    while k - 1 > low and re.match(comment, lines[k - 2]):
        k -= 1
    return k


def _brace_end(bare: list[str], k: int, last: int) -> int:
    depth, seen = 0, False
    for j in range(k, last + 1):
        depth += bare[j - 1].count("{") - bare[j - 1].count("}")
        seen = seen or "{" in bare[j - 1]
        if seen and depth <= 0:
            return j
        if not seen and bare[j - 1].rstrip().endswith(";"):
            return j
    return last


def script_regions(lines: list[str], bare: list[str], low: int, last: int, inside: str | None = None) -> list[Region]:
    """Regions of TypeScript and JavaScript between two lines."""
    out, k = [], low + 1
    taken = low
    while k <= last:
        line, hit = bare[k - 1], None
        call = _CALLS.match(lines[k - 1])
        if call and call["call"].split(".")[0] in (*SCRIPT_SCOPES, *SCRIPT_TESTS, *SCRIPT_SETUP) and re.search(r"=>\s*\{|function\b|=>\s*$", line):
            verb = call["call"]
            hit = ("scope" if verb in SCRIPT_SCOPES else "test" if verb in SCRIPT_TESTS else "setup", (call["text"] or verb).strip("'\"`"), False)
        else:
            for pattern, kind in _SCRIPT:
                if m := pattern.match(line):
                    g = m.groupdict()
                    owner = g.get("owner") or g.get("static")
                    hit = (kind, f"{owner}{'#' if g.get('owner') else '.'}{m['name']}" if owner else m["name"], bool(g.get("static")))
                    break
            if hit is None and inside == "class" and (m := _MEMBER.match(line) or _FIELD.match(line)) and m["name"] not in _NO_MEMBER:
                hit = ("method", m["name"], "static" in line.split("(")[0].split())
        if hit is None:
            k += 1
            continue
        end = _brace_end(bare, k, last)
        r = Region(_above(lines, k, taken, r"^\s*(?://|/\*|\*|@\w)"), end, *hit)
        if hit[0] in ("class", "scope"):
            r.children = script_regions(lines, bare, k, end - 1, hit[0])
        out.append(r)
        taken, k = end, end + 1
    return out


_RUBY_OPEN = re.compile(r"^\s*(?:class|module|def|if|unless|while|until|case|begin|for)\b|(?:=|\breturn)\s*(?:if|unless|case|begin)\b|\bdo\s*(?:\|[^|]*\|)?\s*$")


#: A method of one expression has no ``end``.
ENDLESS = re.compile(r"^\s*def\s+(?:self\.)?\w+[?!]?(?:\([^)]*\))?\s+=\s")


def _ruby_end(bare: list[str], k: int, last: int) -> int:
    if ENDLESS.match(bare[k - 1]) or re.search(r"\bend\s*$", bare[k - 1].strip()) and not bare[k - 1].strip().startswith("end") or ("{" in bare[k - 1] and bare[k - 1].count("{") == bare[k - 1].count("}")):
        return k
    depth = 0
    for j in range(k, last + 1):
        body = bare[j - 1].strip()
        if re.match(r"end\b", body):
            depth -= 1
            if depth <= 0:
                return j
        elif _RUBY_OPEN.search(bare[j - 1]) and not re.search(r"\bend\s*$", body) and not ENDLESS.match(bare[j - 1]):
            depth += 1
    return last


def ruby_regions(lines: list[str], bare: list[str], low: int, last: int, inside: str | None = None) -> list[Region]:
    """Regions of Ruby between two lines; macros in a class body that stand together are one."""
    out, k, taken = [], low + 1, low
    macros: list[int] = []

    def flush() -> None:
        if len(macros) >= MACRO_LINES:
            names = [bare[m - 1].split()[0] for m in macros]
            out.append(Region(macros[0], macros[-1], "block", max(set(names), key=names.count)))
        macros.clear()

    while k <= last:
        line, hit = bare[k - 1], None
        if m := re.match(r"^\s*(?:class|module)\s+(?P<name>[A-Z][\w:]*)", line):
            hit = ("class", m["name"], False)
        elif m := re.match(r"^\s*def\s+(?P<self>self\.)?(?P<name>[\w]+[?!=]?|[^\s(]+)", line):
            hit = ("method" if inside == "class" else "function", m["name"], bool(m["self"]))
        elif (m := _CALLS.match(re.sub(r"^\s*RSpec\.", "", lines[k - 1]))) and m["call"] in (*RUBY_SCOPES, *RUBY_TESTS, *RUBY_SETUP) and re.search(r"\bdo\b|\{", line):
            verb = m["call"]
            hit = ("scope" if verb in RUBY_SCOPES else "test" if verb in RUBY_TESTS else "setup", (m["text"] if m["text"] not in (None, "do") else verb).strip("'\"`"), False)
        if hit is None:
            if inside == "class" and re.match(r"^\s+[a-z_]+\s+[:\"'A-Z]", line) and (not macros or k == macros[-1] + 1):
                macros.append(k)
            elif macros and k > macros[-1] + 1:
                flush()
            k += 1
            continue
        flush()
        end = _ruby_end(bare, k, last)
        r = Region(_above(lines, k, taken, r"^\s*#"), end, *hit)
        if hit[0] in ("class", "scope"):
            r.children = ruby_regions(lines, bare, k, end - 1, hit[0])
        out.append(r)
        taken, k = end, end + 1
    flush()
    return out


def chunks(text: str, bare: str, find: Callable[..., list[Region]], fallback: Callable[[str], list[dict]]) -> list[dict]:
    """The chunks of a file from its regions."""
    lines = text.split("\n")
    regions = find(lines, bare.split("\n"), 0, len(lines))
    if not regions:
        return fallback(text)
    made: list[dict] = []

    def own(r: Region) -> str:
        cut = {k for c in r.children for k in range(c.first, c.last + 1)}
        return "\n".join(lines[k - 1] for k in range(r.first, r.last + 1) if k not in cut).strip()

    def emit(r: Region, parent: str | None, kind: str | None, scopes: tuple[str, ...]) -> None:
        if r.kind in ("scope", "setup", "test"):
            path = (*scopes, r.name)
            if r.kind == "test" or r.kind == "setup":
                made.append({"chunk_type": "test" if r.kind == "test" else "test_setup", "name": " > ".join(path), "symbol_id": " > ".join(path), "parent_symbol_id": " > ".join(scopes) or parent, "parent_type": "test" if scopes else kind, "start_line": r.first, "end_line": r.last, "content": "\n".join(lines[r.first - 1 : r.last])})
                return
            for c in r.children:
                emit(c, parent, kind, path)
            rest = own(r)
            if len([x for x in rest.split("\n") if x.strip()]) > 2:
                made.append({"chunk_type": "test_setup", "name": " > ".join(path), "symbol_id": " > ".join((*path, "setup")), "parent_symbol_id": " > ".join(scopes) or parent, "parent_type": "test" if scopes else kind, "start_line": r.first, "end_line": r.last, "content": rest})
            return
        join = "::" if find is ruby_regions else "."
        if r.kind == "method" and parent:
            symbol = f"{parent}{'.' if r.static else '#'}{r.name}"
        else:
            symbol = f"{parent}{join}{r.name}" if parent and r.kind in ("class", "interface") else r.name
        if r.kind in ("class", "interface"):
            made.append({"chunk_type": r.kind, "name": r.name, "symbol_id": symbol, "parent_symbol_id": parent, "parent_type": kind, "start_line": r.first, "end_line": r.last, "content": own(r)})
            for c in r.children:
                emit(c, symbol, "class", scopes)
        else:
            made.append({"chunk_type": "block" if r.kind == "block" else "function", "name": r.name, "symbol_id": None if r.kind == "block" else symbol, "parent_symbol_id": parent, "parent_type": kind, "start_line": r.first, "end_line": r.last, "content": "\n".join(lines[r.first - 1 : r.last])})

    for r in regions:
        emit(r, None, None, ())
    taken = {k for r in regions for k in range(r.first, r.last + 1)}
    run: list[int] = []
    for k in [*range(1, len(lines) + 1), None]:
        if k is not None and k not in taken:
            run.append(k)
            continue
        content = "\n".join(lines[x - 1] for x in run).strip()
        if content:
            made.append({"chunk_type": "block", "start_line": run[0], "end_line": run[-1], "content": content})
        run = []
    return sorted(made, key=lambda m: (m["start_line"], -m["end_line"]))
