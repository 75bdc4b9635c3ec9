"""Segmentation: texts cut into chunks, file by file.

Chunking carries state from line to line within a file, so it runs in Arrow batches of
files (``mapInArrow``), in parallel over files; everything after it is relational.
"""

from __future__ import annotations

import ast
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.lexing import blanked
from . import scopes

# Chunk sizes in characters, and what makes a good place to cut.
CHUNK_SIZE, OVERLAP, MAX_SIZE = 2500, 300, 5000
LOOK_AHEAD, TAIL = 20, 50
BREAK_LINES, BREAK_STARTS = ("", "}", "};", "]);"), ("//", "#")
# Markdown sections.
SECTION_DEPTH, MIN_SECTION, MIN_CODE = 3, 50, 50
DIAGRAMS = r"(?:flowchart|graph|sequenceDiagram|classDiagram|stateDiagram|erDiagram|gantt|pie|gitGraph|subgraph)"

SCHEMA = "path string, language string, chunk_index int, chunk_type string, name string, symbol_id string, parent_symbol_id string, parent_type string, heading_path array<struct<depth:int,text:string>>, is_documentation boolean, start_line int, end_line int, content string"
ARROW = pa.schema([
    ("path", pa.string()), ("language", pa.string()), ("chunk_index", pa.int32()), ("chunk_type", pa.string()), ("name", pa.string()), ("symbol_id", pa.string()), ("parent_symbol_id", pa.string()), ("parent_type", pa.string()),
    ("heading_path", pa.list_(pa.struct([("depth", pa.int32()), ("text", pa.string())]))), ("is_documentation", pa.bool_()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("content", pa.string()),
])


def by_characters(text: str, size: int = CHUNK_SIZE, overlap: int = OVERLAP, max_size: int = MAX_SIZE) -> list[tuple[int, int, str]]:
    """(first line, last line, content): lines gathered up to ``size`` characters.

    A full chunk runs on to the next good break within reach; the next one repeats as
    many lines as ``overlap`` characters have on average; a short tail is dropped.
    """
    lines = text.split("\n")
    out, n = [], 0  # the chunk so far is lines[at - n:at]
    chars, first, at = 0, 1, 0
    while at < len(lines):
        chars += len(lines[at]) + 1
        at, n = at + 1, n + 1
        if chars < size:
            continue
        ahead = (k for k in range(at, min(at + LOOK_AHEAD, len(lines))) if (s := lines[k].strip()) in BREAK_LINES or s.startswith(BREAK_STARTS))
        stop = next(ahead, at)
        if stop - (at - 1) < LOOK_AHEAD:
            while at <= stop and at < len(lines) and chars + len(lines[at]) + 1 <= max_size:
                chars += len(lines[at]) + 1
                at, n = at + 1, n + 1
        out.append((first, first + n - 1, "\n".join(lines[at - n : at]).strip()))
        keep = math.floor(overlap / max(size / max(n, 1), 1))
        keep = min(keep, n)
        first, n = first + n - keep, keep
        chars = sum(len(x) + 1 for x in lines[at - keep : at]) if keep else 0
    rest = "\n".join(lines[at - n : at]).strip()
    if len(rest) > TAIL:
        out.append((first, first + n - 1, rest))
    return out


def _headings(lines: list[str]) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]], int]:
    """ATX headings (line, depth, text), fenced blocks (first, last, language), front matter's end."""
    heads, blocks, fence, start = [], [], None, 0
    if lines and lines[0].strip() == "---":
        end = next((k for k in range(1, len(lines)) if lines[k].strip() == "---"), None)
        start = end + 1 if end else 0
    for k in range(start, len(lines)):
        m = re.match(r"^ {0,3}(`{3,}|~{3,})\s*(\S*)", lines[k])
        if fence is None and m:
            fence = (k, m[1], m[2])
        elif fence is not None and m and m[1].startswith(fence[1]) and not m[2]:
            blocks.append((fence[0], k, fence[2]))
            fence = None
        elif fence is None and (h := re.match(r"^ {0,3}(#{1,6})\s+(.*?)\s*#*\s*$", lines[k])):
            heads.append((k, len(h[1]), h[2]))
    if fence is not None:
        blocks.append((fence[0], len(lines), fence[2]))
    return heads, blocks, start


def by_markdown(text: str, max_size: int = MAX_SIZE) -> list[dict]:
    """Sections at headings of depth 1 to 3 with their trail, code blocks apart, preamble.

    Sections of depth 3 join the one before while both fit; a text without any section is
    one chunk.
    """
    lines = text.split("\n")
    heads, blocks, start = _headings(lines)
    sections = [h for h in heads if h[1] <= SECTION_DEPTH]
    hidden = {k for a, b, _ in blocks for k in range(a, b + 1)}

    def body(a: int, b: int) -> str:
        return "\n".join(lines[k] for k in range(a, b) if k not in hidden).strip()

    def trail(line: int) -> list[dict]:
        out: list[tuple[int, str]] = []
        for k, depth, name in sections:
            if k > line:
                break
            out = [x for x in out if x[0] < depth] + [(depth, name)]
        return [{"depth": d, "text": t} for d, t in out]

    made: list[dict] = []
    for i, (k, depth, name) in enumerate(sections):
        end = sections[i + 1][0] if i + 1 < len(sections) else len(lines)
        content = body(k, end)
        if len(content) < MIN_SECTION:
            continue
        last = made[-1] if made else None
        if depth == SECTION_DEPTH and last and last["depth"] == SECTION_DEPTH and last["to"] == k and len(last["content"]) + len(content) + 2 <= max_size:
            last |= {"content": f"{last['content']}\n\n{content}", "to": end, "end_line": end}
            continue
        path = trail(k)
        crumbs = " > ".join(h["text"] for h in path[:-1])
        made.append({"depth": depth, "to": end, "name": name, "heading_path": path, "start_line": k + 1, "end_line": end, "content": f"{crumbs}\n\n{content}" if crumbs else content, "parent_symbol_id": path[-2]["text"] if len(path) > 1 else None, "parent_type": f"h{path[-2]['depth']}" if len(path) > 1 else None})
    for a, b, language in blocks:
        value = "\n".join(lines[a + 1 : b])
        if len(value) < MIN_CODE or language == "mermaid" or (not language and re.match(rf"\s*{DIAGRAMS}\b", value)):
            continue
        path = trail(a)
        base = {"name": f"Code: {language}" if language else "Code block", "heading_path": path, "language": language or "code", "parent_symbol_id": path[-1]["text"] if path else None, "parent_type": f"h{path[-1]['depth']}" if path else None}
        pieces = by_characters(value, max_size // 2, OVERLAP, max_size) if len(value) > max_size else [(1, b - a - 1, value)]
        made += [base | {"start_line": a + 1 + x, "end_line": a + 1 + y, "content": c} for x, y, c in pieces]
    head = body(start, sections[0][0]) if sections else ""
    if len(head) >= MIN_SECTION:
        made.append({"name": "Preamble", "heading_path": [], "start_line": start + 1, "end_line": sections[0][0], "content": head})
    if not made and (whole := "\n".join(lines[start:]).strip()):
        made.append({"name": None, "heading_path": [], "start_line": start + 1, "end_line": len(lines), "content": whole})
    return [{"chunk_type": "block", "is_documentation": True, "symbol_id": m["name"]} | m for m in made]


def by_python(text: str, max_size: int = MAX_SIZE) -> list[dict]:
    """Functions and methods as chunks of their own, classes without their methods, the rest as blocks."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return [{"chunk_type": "block", "start_line": a, "end_line": b, "content": c} for a, b, c in by_characters(text, max_size // 2, OVERLAP, max_size)]
    lines, made, taken = text.split("\n"), [], set()

    def visit(body, prefix: str, kind: str | None) -> None:
        for node in body:
            if not isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                continue
            first = min([node.lineno, *[d.lineno for d in node.decorator_list]])
            last = node.end_lineno or node.lineno
            static = kind and any(isinstance(d, ast.Name) and d.id in ("staticmethod", "classmethod") for d in node.decorator_list)
            name = f"{prefix}{'.' if static or isinstance(node, ast.ClassDef) or not kind else '#'}{node.name}" if prefix else node.name
            if isinstance(node, ast.ClassDef):
                inner = [n for n in node.body if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))]
                cut = {k for n in inner for k in range(min([n.lineno, *[d.lineno for d in n.decorator_list]]), (n.end_lineno or n.lineno) + 1)}
                content = "\n".join(lines[k - 1] for k in range(first, last + 1) if k not in cut).strip()
                made.append({"chunk_type": "class", "name": node.name, "symbol_id": name, "parent_symbol_id": prefix or None, "parent_type": kind, "start_line": first, "end_line": last, "content": content})
                visit(node.body, name, "class")
            else:
                test = node.name.startswith("test")
                made.append({"chunk_type": "test" if test else "function", "name": node.name, "symbol_id": name, "parent_symbol_id": prefix or None, "parent_type": kind, "start_line": first, "end_line": last, "content": "\n".join(lines[first - 1 : last])})
            taken.update(range(first, last + 1))

    visit(tree.body, "", None)
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


#: Lines that begin a definition in languages with braces, and what it defines.
DEFINITIONS = (
    (r"^\s*(?:export\s+)?(?:default\s+)?(?:public\s+|abstract\s+|final\s+)*class\s+(\w+)", "class"), (r"^\s*(?:export\s+)?(?:public\s+)?(?:interface|trait)\s+(\w+)", "interface"),
    (r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s+(\w+)", "function"), (r"^\s*(?:pub\s+)?(?:async\s+)?fn\s+(\w+)", "function"), (r"^func\s+(?:\([^)]*\)\s*)?(\w+)", "function"),
    (r"^\s*(?:export\s+)?(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*=>\s*\{", "function"),
    (r"^\s+(?:(?:public|private|protected|static|async|final|override)\s+)*(?!if\b|for\b|while\b|switch\b|catch\b|return\b)[\w<>\[\], ]*?(\w+)\s*\([^;]*\)\s*(?::[^{]+)?\{\s*$", "method"),
)


def by_braces(text: str, max_size: int = MAX_SIZE) -> list[dict]:
    """Definitions in languages with braces, from their first line to the matching brace."""
    lines, made = text.split("\n"), []

    def end(k: int) -> int:
        depth, seen = 0, False
        for j in range(k, len(lines)):
            bare = re.sub(r"//.*|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'", "", lines[j])
            depth += bare.count("{") - bare.count("}")
            seen = seen or "{" in bare
            if seen and depth <= 0:
                return j
        return len(lines) - 1

    def scan(a: int, b: int, parent: str | None) -> None:
        k = a
        while k <= b:
            hit = next(((m[1], kind) for p, kind in DEFINITIONS if (m := re.match(p, lines[k])) and (kind != "method" or parent)), None)
            if hit is None:
                k += 1
                continue
            name, kind = hit
            last = min(end(k), b)
            symbol = f"{parent}#{name}" if parent and kind == "method" else name
            made.append({"chunk_type": "function" if kind == "method" else kind, "name": name, "symbol_id": symbol, "parent_symbol_id": parent, "parent_type": "class" if parent else None, "start_line": k + 1, "end_line": last + 1, "content": "\n".join(lines[k : last + 1])})
            if kind == "class":
                scan(k + 1, last, name)
            k = last + 1

    scan(0, len(lines) - 1, None)
    if not made:
        return [{"chunk_type": "block", "start_line": a, "end_line": b, "content": c} for a, b, c in by_characters(text, max_size // 2, OVERLAP, max_size)]
    return made


def oversized(chunk: dict, max_size: int = MAX_SIZE) -> list[dict]:
    """A chunk over ``max_size`` cut at lines into parts ``name (part i/n)`` and ``id#partN``."""
    if len(chunk["content"]) <= max_size:
        return [chunk]
    parts: list[list[str]] = [[]]
    for line in chunk["content"].split("\n"):
        for k in range(0, max(len(line), 1), max_size):  # a line over the size is cut too
            piece = line[k : k + max_size]
            if parts[-1] and sum(len(x) + 1 for x in parts[-1]) + len(piece) > max_size:
                parts.append([])
            parts[-1].append(piece)
    total, at, out = sum(map(len, parts)), 0, []
    span = chunk["end_line"] - chunk["start_line"] + 1
    for i, p in enumerate(parts):
        a, b = at * span // total, (at + len(p)) * span // total
        at += len(p)
        named = chunk.get("name") and f"{chunk['name']} (part {i + 1}/{len(parts)})"
        out.append(chunk | {"content": "\n".join(p), "name": named, "symbol_id": chunk.get("symbol_id") and f"{chunk['symbol_id']}#part{i + 1}", "start_line": chunk["start_line"] + a, "end_line": chunk["start_line"] + max(b - 1, a)})
    return out


BRACES = ("typescript", "javascript", "java", "go", "rust", "c", "cpp", "c_sharp", "php", "kotlin", "swift", "scala", "dart")


def chunk_file(text: str, language: str | None, max_size: int = MAX_SIZE) -> list[dict]:
    """The chunks of one file by its language; others by characters."""
    if not text:
        return []
    if language == "markdown":
        made = by_markdown(text, max_size)
    elif language == "python":
        made = by_python(text, max_size)
    elif language in ("typescript", "javascript", "ruby"):
        by_size = lambda t: [{"chunk_type": "block", "start_line": a, "end_line": b, "content": c} for a, b, c in by_characters(t, max_size // 2, OVERLAP, max_size)]
        made = scopes.chunks(text, blanked(text, language), scopes.ruby_regions if language == "ruby" else scopes.script_regions, by_size)
    elif language in BRACES:
        made = by_braces(text, max_size)
    else:
        made = [{"chunk_type": "block", "start_line": a, "end_line": b, "content": c} for a, b, c in by_characters(text, CHUNK_SIZE, OVERLAP, max_size)]
    return [p for m in made for p in oversized(m, max_size)]


def chunks(files: DataFrame, max_size: int = MAX_SIZE, path: str = "path", language: str = "language", text: str = "text") -> DataFrame:
    """All chunks of all files (path, language, text); null texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, kind, content in zip(*[b.column(i).to_pylist() for i in range(3)], strict=True):
                made = chunk_file(content or "", kind, max_size)
                if made:
                    rows = [{"language": kind, "is_documentation": False, "heading_path": []} | c | {"path": name, "chunk_index": i} for i, c in enumerate(made)]
                    yield pa.RecordBatch.from_pylist(rows, schema=ARROW)

    return files.select(path, language, text).mapInArrow(run, SCHEMA)
