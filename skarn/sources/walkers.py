"""Facts of source files for call resolution: definitions, calls, imports, bindings, types.

Python files are read by the language's own parser.  The others are read line by line by a
scanner: comments and strings are blanked, lines are joined until their parentheses are
closed, and braces (or ``end``) close what a definition has opened.  That is no parser: what
is not written one definition to a line may be missed.

A file's facts are rows of one table (``FACT``); ``facts`` deals it into the tables that
``operators.resolution`` takes.  Ids of calls are the file's path, line and place in it.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lexing import SCRIPTS, blanked
from ..operators.resolution import Facts
from ..operators.scopes import ENDLESS
from ..storage import written

FACT = (
    "kind string, language string, rel_path string, line int, at int, owner string, scope string, name string, receiver string, value string, names array<string>, "
    "n_args int, min_args int, max_args int, splat boolean, keywords array<string>, required array<string>, visibility string, flag boolean, ordinal int"
)
_KINDS = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
_SCHEMA = pa.schema([(x.split()[0], _KINDS[x.split()[1]]) for x in FACT.split(", ")])

#: Words that look like calls or definitions in languages with braces.
KEYWORDS = frozenset("if for while switch catch return function new typeof await throw else do match loop unsafe move fn func defer go select case super this sizeof in of yield delete void import require synchronized assert".split())


# -- Python ------------------------------------------------------------------------


class _Python(ast.NodeVisitor):
    def __init__(self, path: str):
        self.path, self.rows, self.types, self.owners = path, [], [], []

    def add(self, kind: str, node: ast.AST, **more) -> None:
        self.rows.append({"kind": kind, "line": getattr(node, "lineno", 1), "at": getattr(node, "col_offset", 0), "owner": self.owners[-1] if self.owners else None, "scope": self.types[-1] if self.types else None} | more)

    def visit_Import(self, node: ast.Import) -> None:
        for k, a in enumerate(node.names):
            self.add("import", node, value=a.name, names=[a.asname or a.name.split(".")[0]], ordinal=k)

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        self.add("import", node, value="." * node.level + (node.module or ""), names=[a.asname or a.name for a in node.names], ordinal=0)

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        full = ".".join([*self.types, node.name]) if self.types else node.name
        self.add("symbol", node, name=node.name, value=full, flag=True)
        for k, b in enumerate(node.bases):
            name = ast.unparse(b).rpartition(".")[2]
            if name.isidentifier():
                self.add("inherit", node, name=node.name, value=name, receiver="extends", ordinal=k)
        self.types.append(node.name)
        for x in node.body:
            if isinstance(x, ast.AnnAssign) and isinstance(x.target, ast.Name):
                self.typed_field(x, x.target.id, x.annotation)
            self.visit(x)
        self.types.pop()

    def typed_field(self, node: ast.AST, name: str, annotation: ast.expr) -> None:
        kind = _annotated(annotation)
        if kind:
            self.add("field", node, name=name, value=kind)

    def visit_FunctionDef(self, node) -> None:
        names = {d.id for d in node.decorator_list if isinstance(d, ast.Name)}
        static = bool(names & {"staticmethod", "classmethod"})
        inside = bool(self.types) and not (self.owners and self.owners[-1] is not None and not self.owners[-1].startswith(self.types[-1]))
        full = f"{self.types[-1]}{'.' if static else '#'}{node.name}" if inside else node.name
        a = node.args
        positional = [x.arg for x in (*a.posonlyargs, *a.args)]
        if inside and "staticmethod" not in names:
            positional = positional[1:]
        keyword = [x.arg for x in a.kwonlyargs]
        needed = [x.arg for x, d in zip(a.kwonlyargs, a.kw_defaults, strict=True) if d is None]
        self.add("symbol", node, name=node.name, value=full, min_args=max(len(positional) - len(a.defaults), 0), max_args=len(positional), splat=a.vararg is not None, keywords=keyword + positional if a.kwarg is None else None, required=needed, visibility="private" if node.name.startswith("__") and not node.name.endswith("__") else "public")
        if node.returns is not None and (kind := _annotated(node.returns)):
            self.add("return", node, name=full, value=kind)
        self.owners.append(full)
        for x in (*a.posonlyargs, *a.args, *a.kwonlyargs):
            if x.annotation is not None and (kind := _annotated(x.annotation)):
                self.add("binding", x, name=x.arg, value=kind)
        for x in node.body:
            self.visit(x)
        self.owners.pop()

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_Assign(self, node: ast.Assign) -> None:
        for t in node.targets:
            self.assigned(node, t, node.value)
        self.generic_visit(node)

    def visit_AnnAssign(self, node: ast.AnnAssign) -> None:
        kind = _annotated(node.annotation)
        if kind and isinstance(node.target, ast.Name) and self.owners:
            self.add("binding", node, name=node.target.id, value=kind)
        if kind and isinstance(node.target, ast.Attribute) and isinstance(node.target.value, ast.Name) and node.target.value.id == "self":
            self.add("field", node, name=node.target.attr, value=kind)
        self.generic_visit(node)

    def assigned(self, node: ast.AST, target: ast.expr, value: ast.expr) -> None:
        if not isinstance(value, ast.Call):
            return
        made = ast.unparse(value.func)
        short = made.rpartition(".")[2]
        new = short[:1].isupper()
        if isinstance(target, ast.Attribute) and isinstance(target.value, ast.Name) and target.value.id == "self" and new:
            self.add("field", node, name=target.attr, value=short)
        elif isinstance(target, ast.Name):
            self.add("binding" if new else "call_binding", node, name=target.id, value=made if new else short)

    def visit_Call(self, node: ast.Call) -> None:
        f = node.func
        keys = [k.arg for k in node.keywords if k.arg]
        many = any(k.arg is None for k in node.keywords)
        count = None if any(isinstance(x, ast.Starred) for x in node.args) else len(node.args)
        if isinstance(f, ast.Attribute):
            self.add("call", node, name=f.attr, receiver=ast.unparse(f.value), n_args=count, keywords=keys, splat=many)
        elif isinstance(f, ast.Name):
            self.add("call", node, name=f.id, n_args=count, keywords=keys, splat=many, flag=f.id in ("getattr", "eval", "exec"))
        self.generic_visit(node)


def _annotated(node: ast.expr) -> str | None:
    """The type that an annotation names, inside ``Optional``, ``X | None`` and quotes too."""
    if isinstance(node, ast.Constant) and isinstance(node.value, str):
        try:
            return _annotated(ast.parse(node.value, mode="eval").body)
        except SyntaxError:
            return None
    if isinstance(node, ast.BinOp):
        return _annotated(node.left) or _annotated(node.right)
    if isinstance(node, ast.Subscript):
        return _annotated(node.slice) if ast.unparse(node.value).endswith("Optional") else None
    if isinstance(node, (ast.Name, ast.Attribute)):
        name = ast.unparse(node)
        return name if name.rpartition(".")[2][:1].isupper() else None
    return None


def python_facts(path: str, text: str) -> list[dict]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return []
    walker = _Python(path)
    walker.visit(tree)
    return walker.rows


# -- languages with braces ---------------------------------------------------------


def logical(text: str) -> Iterator[tuple[int, str]]:
    """(first line, text) of lines joined until their parentheses are closed (forty at most)."""
    held, first, depth = [], 0, 0
    for k, line in enumerate(text.split("\n"), 1):
        if not held:
            first = k
        held.append(line)
        depth += line.count("(") + line.count("[") - line.count(")") - line.count("]")
        if depth <= 0 or len(held) >= 40:
            yield first, " ".join(held)
            held, depth = [], 0
    if held:
        yield first, " ".join(held)


def arguments(text: str, at: int) -> list[str]:
    """The arguments of the parenthesis that opens at ``at``."""
    depth, out, start = 0, [], at + 1
    for k in range(at, len(text)):
        c = text[k]
        if c in "([{<" and not (c == "<" and text[k - 1 : k] in (" ", "=")):
            depth += 1
        elif c in ")]}" or (c == ">" and text[k - 1 : k] not in ("=", "-", " ")):
            depth -= 1
            if depth <= 0 and c == ")":
                out.append(text[start:k])
                return [x.strip() for x in out if x.strip()]
        elif c == "," and depth == 1:
            out.append(text[start:k])
            start = k + 1
    return []


_TYPE = r"[A-Z]\w*"
_CALL = re.compile(r"(?:(?P<receiver>(?:this|self|super|[\w$@]+)(?:(?:\??\.|::|!?\.)[\w$]+(?:\([^()]*\))?)*?)(?:\??\.|::|!\.))?(?P<name>[\w$]+[?!]?)(?:<[\w, ]+>)?\(")

#: How types and functions begin, by language: (pattern, what it defines).
OPENERS: dict[str, list[tuple[re.Pattern, str]]] = {
    "script": [
        (re.compile(r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(?P<name>\w+)(?:<[^{]*?>)?(?:\s+extends\s+(?P<base>[\w.]+))?(?:<[^{]*?>)?(?:\s+implements\s+(?P<also>[\w., <>]+?))?\s*\{"), "type"),
        (re.compile(r"^\s*(?:export\s+)?interface\s+(?P<name>\w+)(?:<[^{]*?>)?(?:\s+extends\s+(?P<also>[\w., <>]+?))?\s*\{"), "type"),
        (re.compile(r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(?P<name>\w+)\s*(?:<[^(]*>)?\("), "function"),
        (re.compile(r"^\s*(?:export\s+)?(?:const|let|var)\s+(?P<name>\w+)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:function\s*)?\((?=[^=]*(?:=>|\{))"), "function"),
        (re.compile(r"^\s*(?:(?P<mods>(?:(?:public|private|protected|static|async|override|readonly|get|set)\s+)*))(?P<name>[\w$#]+)\s*(?:<[^(]*>)?\((?=[^;]*\)\s*(?::[^{;]+)?\{)"), "method"),
    ],
    "java": [
        (re.compile(r"^\s*(?:(?:public|private|protected|static|final|abstract|sealed)\s+)*(?:class|record|enum)\s+(?P<name>\w+)[^{]*?(?:extends\s+(?P<base>[\w.]+))?(?:<[^{]*?>)?(?:\s*implements\s+(?P<also>[\w., <>]+?))?\s*\{"), "type"),
        (re.compile(r"^\s*(?:(?:public|private|protected|static)\s+)*interface\s+(?P<name>\w+)(?:<[^{]*?>)?(?:\s+extends\s+(?P<also>[\w., <>]+?))?\s*\{"), "type"),
        (re.compile(r"^\s*(?P<mods>(?:(?:public|private|protected|static|final|abstract|synchronized|default)\s+)*)(?:<[^>]+>\s*)?(?:(?P<result>[\w.<>\[\], ?]+?)\s+)?(?P<name>\w+)\s*\((?=[^;]*\)\s*(?:throws[^{]+)?\{)"), "method"),
    ],
    "go": [
        (re.compile(r"^\s*type\s+(?P<name>\w+)\s+(?:struct|interface)\s*\{"), "type"),
        (re.compile(r"^func\s+\(\s*(?P<self>\w+)?\s*\*?(?P<on>\w+)[^)]*\)\s*(?P<name>\w+)\s*\("), "method"),
        (re.compile(r"^func\s+(?P<name>\w+)\s*(?:\[[^\]]*\])?\("), "function"),
    ],
    "rust": [
        (re.compile(r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum|trait|union)\s+(?P<name>\w+)"), "type"),
        (re.compile(r"^\s*impl(?:<[^{]*?>)?\s+(?:(?P<base>[\w:]+)(?:<[^{]*?>)?\s+for\s+)?(?P<name>\w+)"), "impl"),
        (re.compile(r"^\s*(?P<mods>(?:pub(?:\([^)]*\))?\s+)?)(?:const\s+)?(?:async\s+)?(?:unsafe\s+)?fn\s+(?P<name>\w+)\s*(?:<[^(]*>)?\("), "method"),
    ],
}


def brace_facts(path: str, text: str, language: str) -> list[dict]:
    """Facts of TypeScript, JavaScript, Java, Go and Rust files."""
    dialect = "script" if language in SCRIPTS else language
    bare = blanked(text, language)
    rows: list[dict] = []
    stack: list[tuple[int, str, str]] = []  # depth outside, kind, name
    depth = 0
    row = lambda kind, line, at, **more: rows.append({"kind": kind, "line": line, "at": at, "owner": owner(), "scope": scope()} | more)
    scope = lambda: next((n for _, k, n in reversed(stack) if k == "type"), None)
    owner = lambda: next((n for _, k, n in reversed(stack) if k == "function"), None)
    _imports(language, text, row)
    for line, code in logical(bare):
        opened, after = None, 0
        for pattern, kind in OPENERS[dialect]:
            m = pattern.match(code)
            if not m or m["name"] in KEYWORDS or (kind == "method" and dialect in ("script", "java") and not (scope() and stack and stack[-1][1] == "type")):
                continue
            g = m.groupdict()
            if kind in ("type", "impl"):
                if kind == "type":
                    row("symbol", line, 0, name=g["name"], value=g["name"], flag=True)
                bases = [g.get("base"), *re.findall(r"[\w.]+", re.sub(r"<[^>]*>", "", g.get("also") or ""))]
                for k, b in enumerate(x for x in bases if x):
                    row("inherit", line, 0, name=g["name"], value=re.split(r"[.:]+", b)[-1], receiver="extends" if k == 0 and g.get("base") else "implements", ordinal=k)
                opened, after = ("type", g["name"]), m.end()
            else:
                on = g.get("on") or scope()
                params = arguments(code, code.index("(", m.start("name")))
                static = "static" in (g.get("mods") or "") or (language == "rust" and on and not (params and "self" in params[0].split(":")[0]))
                full = f"{on}{'.' if static else '#'}{g['name']}" if on and kind == "method" else g["name"]
                plain = [p for p in params if not (language == "rust" and re.match(r"&?(?:mut\s+)?self\b", p))]
                row("symbol", line, 0, name=g["name"], value=full, scope=on if kind == "method" else None, min_args=sum("=" not in p and "?:" not in p and not p.startswith("...") for p in plain), max_args=len(plain), splat=any("..." in p for p in plain), visibility="private" if "private" in (g.get("mods") or "") or g["name"].startswith("#") else "public")
                result = g.get("result") or _result(code, m.start("name"), dialect)
                if result and (t := re.match(rf"(?:Promise<|Option<|Result<|Box<)?[*&]*({_TYPE})", result.strip().lstrip("("))):
                    row("return", line, 0, name=full, value=t[1])
                opened, after = ("function", full), code.index("(", m.start("name"))
                stack.append((depth, "function", full))
                if g.get("self"):
                    row("binding", line, 0, name=g["self"], value=g["on"])
                for p in plain:
                    if b := _parameter(p, dialect):
                        row("binding", line, 0, name=b[0], value=b[1])
                        if dialect == "script" and g["name"] == "constructor" and re.match(r"(?:public|private|protected|readonly)\b", p):
                            row("field", line, 0, name=b[0], value=b[1])
                stack.pop()
            break
        here = owner()
        if opened and opened[0] == "function":
            stack.append((depth, *opened))
        _bindings(dialect, code, line, row, bool(scope()) and (not here or dialect == "rust" and stack and stack[-1][1] == "type"))
        for m in _CALL.finditer(code, after if opened and opened[0] == "function" else 0):
            if opened and opened[0] == "function" and m.end() - 1 == after:
                continue
            name, receiver = m["name"], m["receiver"]
            if name == "super" and dialect == "script" and not receiver:
                row("call", line, m.start(), name="constructor", receiver="super", n_args=len(arguments(code, m.end() - 1)))
                continue
            if name in KEYWORDS or re.search(r"\b(?:function|fn|func|class)\s+$", code[: m.start("name")]) or (opened and opened[0] == "type"):
                continue
            new = re.search(r"\bnew\s+$", code[: m.start()])
            args = arguments(code, m.end() - 1)
            if new:
                row("call", line, m.start(), name="constructor" if dialect == "script" else name, receiver=f"{receiver}.{name}" if receiver else name, n_args=len(args))
            else:
                row("call", line, m.start(), name=name, receiver=receiver, n_args=None if any(a.startswith("...") for a in args) else len(args))
        if language in SCRIPTS and path.endswith("x"):
            for m in re.finditer(r"<([A-Z]\w*)[\s/>]", code):
                if not re.search(r"[\w)]$", code[: m.start()].rstrip()) or code[: m.start()].rstrip().endswith("return"):
                    row("call", line, m.start(), name=m[1])
        if opened and opened[0] == "type":
            stack.append((depth, *opened))
        depth += code.count("{") - code.count("}")
        while stack and depth <= stack[-1][0] and "}" in code or stack and stack[-1][0] > depth or stack and stack[-1][0] == depth and "{" not in code and ("}" in code or code.rstrip().endswith(";")):
            stack.pop()
    return rows


def _result(code: str, start: int, dialect: str) -> str | None:
    at = code.index("(", start)
    depth = 0
    for k in range(at, len(code)):
        depth += (code[k] == "(") - (code[k] == ")")
        if not depth:
            rest = code[k + 1 :]
            m = re.match({"script": r"\s*:\s*([^{=;]+)", "rust": r"\s*->\s*([^{;]+)", "go": r"\s*(\(?[*\w.\[\]]+)"}.get(dialect, "$^"), rest)
            return m[1] if m else None
    return None


def _parameter(text: str, dialect: str) -> tuple[str, str] | None:
    """(name, type) of a parameter with a type of a project's kind."""
    forms = {
        "script": rf"(?:(?:public|private|protected|readonly)\s+)*(\w+)\??\s*:\s*({_TYPE})(?![\w\[])", "java": rf"(?:final\s+)?({_TYPE})(?:<[^>]*>)?\s+(\w+)$",
        "go": rf"(\w+)\s+\*?(?:\w+\.)?({_TYPE})$", "rust": rf"(?:mut\s+)?(\w+)\s*:\s*&?(?:mut\s+)?(?:dyn\s+)?(?:\w+::)*({_TYPE})(?!\w)",
    }
    m = re.match(forms[dialect], text)
    return None if not m else (m[2], m[1]) if dialect == "java" else (m[1], m[2])


def _bindings(dialect: str, code: str, line: int, row, in_type: bool) -> None:
    """Variables and fields with a known type, and variables assigned from a call."""
    if dialect == "script":
        if in_type and (m := re.match(rf"^\s*(?:(?:public|private|protected|readonly|static|declare)\s+)*#?(\w+)[?!]?\s*:\s*({_TYPE})\s*(?:[;=]|$)", code)):
            row("field", line, 0, name=m[1], value=m[2])
        if m := re.search(rf"(?:\bthis\.(\w+)|\b(?:const|let|var)\s+(\w+)(?:\s*:\s*[\w<>\[\], ]+)?|(?:^|\s)(\w+))\s*=\s*new\s+({_TYPE})", code):
            row("field" if m[1] or in_type and not m[2] else "binding", line, m.start(), name=m[1] or m[2] or m[3], value=m[4])
        elif m := re.search(rf"\b(?:const|let|var)\s+(\w+)\s*:\s*({_TYPE})\b", code):
            row("binding", line, m.start(), name=m[1], value=m[2])
        elif m := re.search(r"\b(?:const|let|var)\s+(\w+)\s*=\s*(?:await\s+)?(?:this\.)?([\w.]+)\(", code):
            row("call_binding", line, m.start(), name=m[1], value=m[2].rpartition(".")[2])
    elif dialect == "java":
        if m := re.match(rf"^\s*(?:(?:public|private|protected|static|final)\s+)*({_TYPE})(?:<[^=;]*>)?\s+(\w+)\s*(?:=|;)", code):
            row("field" if in_type else "binding", line, 0, name=m[2], value=m[1])
        elif m := re.match(rf"^\s*(?:final\s+)?var\s+(\w+)\s*=\s*new\s+({_TYPE})", code):
            row("binding", line, 0, name=m[1], value=m[2])
    elif dialect == "go":
        if m := re.search(rf"(\w+)(?:\s*,\s*\w+)*\s*:?=\s*&?(?:\w+\.)?({_TYPE})\{{", code):
            row("binding", line, m.start(), name=m[1], value=m[2])
        elif m := re.match(rf"^\s*var\s+(\w+)\s+\*?(?:\w+\.)?({_TYPE})", code):
            row("binding", line, 0, name=m[1], value=m[2])
        elif m := re.search(r"(\w+)(?:\s*,\s*\w+)*\s*:=\s*(?:\w+\.)?(\w+)\(", code):
            row("call_binding", line, m.start(), name=m[1], value=m[2])
    elif dialect == "rust":
        if in_type and (m := re.match(rf"^\s*(?:pub(?:\([^)]*\))?\s+)?(\w+)\s*:\s*(?:Box<|Arc<|Rc<|Option<)*(?:dyn\s+)?(?:\w+::)*({_TYPE})", code)):
            row("field", line, 0, name=m[1], value=m[2])
        if m := re.search(rf"\blet\s+(?:mut\s+)?(\w+)\s*:\s*&?(?:\w+::)*({_TYPE})", code) or re.search(rf"\blet\s+(?:mut\s+)?(\w+)\s*=\s*(?:\w+::)*({_TYPE})(?:::|\s*\{{)", code):
            row("binding", line, m.start(), name=m[1], value=m[2])


def _imports(language: str, text: str, row) -> None:
    at = lambda m: text.count("\n", 0, m.start()) + 1
    found: list[tuple[re.Match, str, list[str]]] = []
    if language in SCRIPTS:
        for m in re.finditer(r"^\s*(?:import|export)\s+(?:type\s+)?([^'\";]*?)\s*(?:from\s*)?['\"]([^'\"]+)['\"]", text, re.M):
            names = [x.strip() for x in re.sub(r"\*\s+as\s+|\w+\s+as\s+|[{}]|\btype\s+", " ", m[1]).split(",")]
            found.append((m, m[2], [n for n in names if re.fullmatch(r"[\w$]+", n)]))
        for m in re.finditer(r"\b(?:const|let|var)\s+([\w{}, ]+?)\s*=\s*require\(['\"]([^'\"]+)['\"]\)", text):
            found.append((m, m[2], re.findall(r"\w+", m[1])))
    elif language == "java":
        found = [(m, m[1], [m[1].rpartition(".")[2]]) for m in re.finditer(r"^\s*import\s+(?:static\s+)?([\w.*]+)\s*;", text, re.M)]
    elif language == "go":
        for b in re.finditer(r"^import\s*(?:\(([^)]*)\)|(?:\w+\s+)?\"([^\"]+)\")", text, re.M):
            found += [(b, x, [x.rpartition("/")[2]]) for x in ([b[2]] if b[2] else re.findall(r"\"([^\"]+)\"", b[1]))]
    elif language == "rust":
        found = [(m, m[1].strip(), re.findall(r"\w+", m[1].rpartition("::")[2])) for m in re.finditer(r"^\s*(?:pub\s+)?use\s+([^;]+);", text, re.M)]
    for k, (m, value, names) in enumerate(found):
        row("import", at(m), k, value=value, names=names, ordinal=k)


# -- Ruby and shell ------------------------------------------------------------------

_RUBY_OPEN = re.compile(r"^\s*(?:class|module|def|if|unless|while|until|case|begin|for)\b|(?:=|\breturn)\s*(?:if|unless|case|begin)\b|\bdo\s*(?:\|[^|]*\|)?\s*$")
_RUBY_CALL = re.compile(r"(?P<dot>&?\.)?(?P<name>[a-z_]\w*[?!]?)(?P<open>\(|(?=\s+[\w:@\"'\[{])|(?=\s*(?:$|[|&)}\],;]|do\b)))?")
_RUBY_WORDS = frozenset("if unless while until case when then else elsif end begin rescue ensure return yield def class module do and or not in for self nil true false next break redo retry raise puts attr_reader attr_writer attr_accessor include extend prepend private public protected require require_relative alias undef super lambda proc loop defined? belongs_to has_one has_many".split())


def _receiver(code: str, dot: int) -> str | None:
    """What stands before a dot: names, calls and indexes that belong together."""
    k = dot
    while k > 0:
        c = code[k - 1]
        if c in ")]":
            depth, j = 0, k
            while j > 0:
                j -= 1
                depth += (code[j] in ")]") - (code[j] in "([")
                if not depth:
                    break
            k = j
        elif c.isalnum() or c in "_@:?!.&":
            k -= 1
        else:
            break
    found = code[k:dot].lstrip(".:&!?")
    return found or None


def ruby_facts(path: str, text: str) -> list[dict]:
    """Facts of Ruby files: constants with their lexical scope, visibility, mixins, associations."""
    bare = blanked(text, "ruby")
    rows: list[dict] = []
    stack: list[tuple[str, str]] = []  # kind, name
    visibility = {"": "public"}
    scope = lambda: "::".join(n for k, n in stack if k == "type") or None
    owner = lambda: next((n for k, n in reversed(stack) if k == "function"), scope())
    row = lambda kind, line, at, **more: rows.append({"kind": kind, "line": line, "at": at, "owner": owner(), "scope": scope()} | more)
    for k, m in enumerate(re.finditer(r"^\s*require(_relative)?\s*\(?\s*['\"]([^'\"]+)['\"]", text, re.M)):
        rows.append({"kind": "import", "line": text.count("\n", 0, m.start()) + 1, "at": k, "owner": None, "scope": None, "value": ("./" if m[1] else "") + m[2], "names": [m[2]], "ordinal": k})
    for m in re.finditer(r"^\s*([A-Z][A-Z0-9_]*)\s*=\s*\{([^{}]*)\}", bare, re.M):
        for t in re.findall(r"(?:=>|:)\s*([A-Z][\w:]*)", m[2]):
            rows.append({"kind": "registry", "line": 1, "at": 0, "name": m[1], "value": t})
    ordinal = 0
    for line, code in logical(bare):
        body = code.strip()
        single = bool(re.search(r";\s*end\b|\bend\s*$", body) or ENDLESS.match(code)) and not body.startswith("end")
        if m := re.match(r"(class|module)\s+([A-Z][\w:]*)(?:\s*<\s*([A-Z][\w:]*))?", body):
            full = f"{scope()}::{m[2]}" if scope() else m[2]
            row("symbol", line, 0, name=m[2].rpartition("::")[2], value=full, flag=True)
            if m[3]:
                row("inherit", line, 0, name=full, value=m[3], receiver="extends", ordinal=0)
            ordinal = 1
            if not single:
                stack.append(("type", m[2]))
                visibility[scope() or ""] = "public"
            continue
        if re.match(r"class\s*<<\s*self", body):
            stack.append(("self", ""))
            continue
        if m := re.match(r"def\s+(self\.)?([\w]+[?!=]?)\s*(\(?)", body):
            at = code.index(m[0]) + m.end(3) - m.start() - 1 if m[3] else -1
            params = arguments(code, at) if m[3] else [x.strip() for x in re.split(r"\bend\b|;", body[m.end() :])[0].split(",") if x.strip()]
            static = bool(m[1]) or any(k == "self" for k, _ in stack)
            full = f"{scope()}{'.' if static else '#'}{m[2]}" if scope() else m[2]
            keys = [p.split(":")[0].strip() for p in params if re.match(r"\w+:", p)]
            needed = [p.split(":")[0].strip() for p in params if re.match(r"\w+:\s*$", p)]
            plain = [p for p in params if not re.match(r"\w+:|\*|&", p)]
            row("symbol", line, 0, name=m[2], value=full, min_args=sum("=" not in p for p in plain), max_args=len(plain), splat=any(re.match(r"\*\w*$", p) for p in params), keywords=None if any(p.startswith("**") for p in params) else keys, required=needed, visibility=visibility.get(scope() or "", "public"), flag=False, ordinal=int(any(p.startswith("&") for p in params)))
            if not single:
                stack.append(("function", full))
            continue
        if m := re.match(r"(include|extend|prepend)\s+([A-Z][\w:]*)", body):
            row("inherit", line, 0, name=scope() or "", value=m[2], receiver=m[1], ordinal=ordinal)
            ordinal += 1
            continue
        if m := re.match(r"(private|public|protected)\s*$", body):
            visibility[scope() or ""] = m[1]
            continue
        if m := re.match(r"(belongs_to|has_one|has_many)\s+:(\w+)", body):
            name = m[2][:-3] + "y" if m[1] == "has_many" and m[2].endswith("ies") else m[2].removesuffix("s") if m[1] == "has_many" else m[2]
            kind = "".join(w.capitalize() for w in name.split("_"))
            if m[1] != "has_many":
                row("return", line, 0, name=f"{scope()}#{m[2]}", value=kind)
            continue
        if body.startswith("attr_"):
            for name in re.findall(r":(\w+)", body):
                row("symbol", line, 0, name=name, value=f"{scope()}#{name}" if scope() else name, min_args=0, max_args=0)
            continue
        if m := re.match(r"(@?\w+)\s*\|?\|?=\s*([A-Z][\w:]*)\.new\b", body):
            row("field" if m[1].startswith("@") else "binding", line, 0, name=m[1], value=m[2], flag=False)
        elif m := re.match(r"([a-z_]\w*)\s*=\s*([A-Z][\w:]*)\s*$", body):
            row("binding", line, 0, name=m[1], value=m[2], flag=True)
        elif m := re.match(r"([a-z_]\w*)\s*=\s*(?:([A-Z][\w:]*)\.)?([a-z_]\w*[?!]?)\b(?!\s*[=.])", body):
            row("call_binding", line, 0, name=m[1], value=f"{m[2]}.{m[3]}" if m[2] else m[3])
        if body.startswith("super"):
            inside = owner() or ""
            row("call", line, 0, name=re.split(r"[.#]", inside)[-1], receiver="super")
        for m in _RUBY_CALL.finditer(code):
            name, receiver = m["name"], _receiver(code, m.start("dot")) if m["dot"] else None
            if not receiver and (m["dot"] or name in _RUBY_WORDS or m["open"] is None or re.search(r"[:@\w.|]$", code[: m.start()]) or re.match(r"\s*(?:=(?!=)|\|\|=|:)", code[m.end("name") :])):
                continue
            args = arguments(code, m.end() - 1) if m["open"] == "(" else None
            keys = [a.split(":")[0] for a in args or () if re.match(r"\w+:(?!:)", a)]
            row("call", line, m.start(), name=name, receiver=receiver, n_args=None if args is None or any(a.startswith("*") for a in args) else len(args) - len(keys), keywords=keys if args is not None else None, splat=any(a.startswith("**") for a in args or ()), flag=name in ("send", "public_send", "__send__"), ordinal=int(bool(re.search(r"\bdo\b|\{", code[m.end() :]))))
        if re.match(r"end\b", body):
            if stack:
                stack.pop()
        elif _RUBY_OPEN.search(code) and not single:
            stack.append(("block", ""))
    return rows


def bash_facts(path: str, text: str) -> list[dict]:
    """Functions of a shell script, the files it sources, and the commands it runs."""
    rows: list[dict] = []
    owner: list[tuple[int, str]] = []
    depth = 0
    for k, (raw, code) in enumerate(zip(text.split("\n"), blanked(text, "bash").split("\n"), strict=True), 1):
        add = lambda kind, **more: rows.append({"kind": kind, "line": k, "at": 0, "owner": owner[-1][1] if owner else None, "scope": None} | more)  # noqa: B023, E731
        if m := re.match(r"\s*(?:\.|source)\s+[\"']?([^\s\"';]+)", raw):
            add("import", value=re.sub(r"^\$\{?\w+\}?/", "", m[1]), names=[], ordinal=k)
            continue
        if m := re.match(r"\s*(?:function\s+)?([\w:-]+)\s*\(\)\s*\{?", code) or re.match(r"\s*function\s+([\w:-]+)\s*\{?", code):
            add("symbol", name=m[1], value=m[1])
            owner.append((depth, m[1]))
            code = code[m.end() - ("{" in m[0]) :]
        for part in re.split(r"[;|&]+|\$\(|`|\bthen\b|\bdo\b|\belse\b|\{", code):
            if (m := re.match(r"\s*([A-Za-z_][\w:-]*)(?![\w:-]*=)(?=\s|$|\))", part)) and m[1] not in ("if", "then", "else", "fi", "for", "do", "done", "while", "case", "esac", "in", "function", "local", "return", "export", "elif", "until"):
                add("call", name=m[1])
        depth += code.count("{") - code.count("}")
        while owner and depth <= owner[-1][0] and "}" in code:
            owner.pop()
    return rows


def file_facts(path: str, language: str | None, text: str) -> list[dict]:
    """The facts of one file; a language without a walker has none."""
    if language == "python":
        made = python_facts(path, text)
    elif language == "ruby":
        made = ruby_facts(path, text)
    elif language in ("bash", "shell"):
        made = bash_facts(path, text)
        language = "bash"
    elif language in (*SCRIPTS, "java", "go", "rust"):
        made = brace_facts(path, text, language)
    else:
        return []
    return [r | {"language": language, "rel_path": path} for r in made]


def walk(files: DataFrame, path: str = "path", language: str = "language", text: str = "text") -> DataFrame:
    """The facts of all files (path, language, text); null texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, kind, content in zip(*[b.column(i).to_pylist() for i in range(3)], strict=True):
                made = file_facts(name, kind, content or "")
                if made:
                    yield pa.RecordBatch.from_pylist(made, schema=_SCHEMA)

    return files.select(path, language, text).mapInArrow(run, FACT)


def facts(walked: DataFrame) -> Facts:
    """The tables of resolution from walked files; written once, as every strategy reads them."""
    w = written(walked, "facts")
    of = lambda kind: w.where(F.col("kind") == kind)
    calls = of("call").select(
        F.concat_ws(":", "rel_path", "line", "at", "name").alias("call_id"), "language", "rel_path", "line", F.col("owner").alias("source_symbol_id"), "scope", "receiver", F.col("name").alias("member"), "n_args",
        F.col("keywords").alias("given_keywords"), F.col("splat").alias("keyword_splat"), (F.coalesce("ordinal", F.lit(0)) == 1).alias("has_block"), F.coalesce("flag", F.lit(False)).alias("dynamic"),
    ).dropDuplicates(["call_id"])
    symbols = of("symbol").select(
        "language", "rel_path", F.col("value").alias("symbol_id"), F.col("name").alias("short_name"), "scope", "min_args", "max_args", "splat", F.col("required").alias("required_keywords"), F.col("keywords").alias("declared_keywords"), "visibility",
        (F.coalesce("ordinal", F.lit(0)) == 1).alias("accepts_block"), F.lit(False).alias("is_column"),
    )
    return Facts(
        calls=calls, symbols=symbols, imports=of("import").select("language", "rel_path", F.col("ordinal").alias("position"), F.col("value").alias("import_text"), "names"),
        bindings=of("binding").select("rel_path", "owner", "name", "line", F.col("value").alias("type"), F.coalesce("flag", F.lit(False)).alias("is_class")),
        fields=of("field").select("language", "scope", F.col("name").alias("field"), F.col("value").alias("type")),
        inheritance=of("inherit").select("language", F.col("name").alias("source_fq_name"), F.col("value").alias("ancestor_fq_name"), F.col("receiver").alias("kind"), "ordinal"),
        returns=of("return").select("language", F.col("name").alias("function"), F.col("value").alias("type")).unionByName(of("return").select("language", F.regexp_extract("name", r"([^.#]+)$", 1).alias("function"), F.col("value").alias("type"))).distinct(),
        call_bindings=of("call_binding").select("rel_path", "owner", "name", "line", F.col("value").alias("function")),
        registries=of("registry").select("language", "name", F.col("value").alias("type")),
    )
