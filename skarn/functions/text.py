"""String, hash, path and identifier functions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import col

# BM25 and feature-hash constants.
BM25_K1, BM25_B, BM25_AVERAGE = 1.2, 0.75, 50.0
HASH_SPACE = 65536
FNV_OFFSET, FNV_PRIME, WORD = 2166136261, 16777619, 4294967295

# Words that carry no meaning in code search, and in headings.
STOP_WORDS = [
    "the", "a", "an", "is", "in", "of", "to", "and", "or", "for", "it", "this", "that", "with", "as", "by", "on", "at", "be", "are", "was", "were", "been", "has", "have", "had", "not",
    "but", "from", "will", "do", "if", "no", "so", "we", "he", "she", "my", "your",
]
HEADING_STOP_WORDS = [
    "the", "a", "an", "in", "on", "at", "to", "for", "of", "and", "or", "is", "are", "was", "were", "be", "been", "with", "from", "by", "as", "it", "this", "that",
]

# Path tokens that mark security-relevant code.
SECURITY_TOKENS = [
    "auth", "authn", "authz", "authentication", "authorization", "security", "crypto", "password", "passwords", "secret", "secrets", "token", "tokens", "credential", "credentials",
    "permission", "permissions", "acl", "oauth", "jwt", "sso",
]


#: Parts of identifiers: an acronym before a word, a word, capitals, digits.
PARTS = r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|[0-9]+"


def code_tokens(text) -> Column:
    """Lower-case tokens of at least two characters from identifiers and prose.

    camelCase, ACRONYMWord and letter-digit borders are cut, all signs separate, and words
    without meaning go.  One pass of one pattern over the text.
    """
    parts = F.regexp_extract_all(col(text), F.lit(PARTS), F.lit(0))
    tokens = F.split(F.lower(F.array_join(parts, " ")), " ")
    return F.filter(tokens, lambda w: (F.length(w) >= 2) & ~w.isin(*STOP_WORDS))


def feature_hash(token) -> Column:
    """32-bit FNV-1a over the characters, masked to 65,536 buckets."""
    chars = F.transform(F.sequence(F.lit(1), F.length(col(token))), lambda i: F.ascii(F.substring(col(token), i, F.lit(1))).cast("bigint"))
    h = F.aggregate(chars, F.lit(FNV_OFFSET).cast("bigint"), lambda a, c: (a.bitwiseXOR(c) * FNV_PRIME).bitwiseAND(F.lit(WORD)))
    return F.when(F.length(col(token)) > 0, h.bitwiseAND(F.lit(HASH_SPACE - 1))).otherwise(F.lit(FNV_OFFSET % HASH_SPACE)).cast("int")


def bm25_tf(tf, length, k1: float = BM25_K1, b: float = BM25_B, average: float = BM25_AVERAGE) -> Column:
    f, n = col(tf).cast("double"), col(length).cast("double")
    return f * (k1 + 1) / (f + k1 * (1 - b + b * n / average))


def path_tokens(path) -> Column:
    """Lower-case parts of a path: by slash, by ``-_. ``, by camel case."""
    p = F.regexp_replace(col(path), "([a-z0-9])([A-Z])", "$1 $2")
    return F.filter(F.split(F.lower(p), r"[/\-_. ]+"), lambda x: F.length(x) > 0)


def heading_tokens(text) -> Column:
    stop = F.array(*[F.lit(w) for w in HEADING_STOP_WORDS])
    return F.filter(F.split(F.lower(col(text)), r"[\s\-_/]+"), lambda w: (F.length(w) > 1) & ~F.array_contains(stop, w))


def path_risk(path) -> Column:
    """1 where a token of the path marks security-relevant code, else 0."""
    return F.arrays_overlap(path_tokens(path), F.array(*[F.lit(x) for x in SECURITY_TOKENS])).cast("double")


# Forms of ticket ids (pattern, prefix).
TICKETS = ((r"\b([A-Z]{2,10}-\d{1,6})\b", ""), (r"(?:^|[^&])#(\d{1,7})\b", "#"), (r"\bAB#(\d{1,7})\b", "AB#"), (r"!(\d{1,7})\b", "!"))


def task_ids(text) -> Column:
    """Distinct ticket ids of a message, form by form in order of appearance."""
    t = F.coalesce(col(text), F.lit(""))
    found = [F.regexp_extract_all(t, F.lit(pattern), F.lit(1)) for pattern, _ in TICKETS]
    marked = [F.transform(x, (lambda p: lambda i: F.concat(F.lit(p), i))(prefix)) for x, (_, prefix) in zip(found, TICKETS, strict=True)]
    return F.array_distinct(F.concat(*marked))


# What makes a message a bug fix, and what does not.
MERGE_SUBJECT = r"(?i)^Merge\b"
COSMETIC_FIX = r"(?i)\bfix(?:e[sd])?\s+(?:typo|lint|linter|format|formatting|style|whitespace|indentation|imports?|tests?|specs?|flaky|rubocop|eslint|prettier|ci|pipeline|migration|review|code\s*review|conflicts?)\b"
TEXT_FIX = r"(?i)\btext\s+fix(?:es)?\b"
FIX_SUBJECTS = (r"(?i)^(?:hot)?fix(?:\([^)]+\))?!?:", r"(?i)^\[(?:Fix|Bug|Hotfix|Bugfix)\]", r"(?i)^\[?[A-Z]+-\d+\]?\s+(?:fix|fixed|fixes)\b")
CLOSES_ISSUE = r"(?i)\b(?:fix|fixe[sd]|resolve[sd]?|close[sd]?)\s+#\d+"


def subject(message) -> Column:
    return F.element_at(F.split(F.coalesce(col(message), F.lit("")), "\n"), 1)


def is_merge_subject(message) -> Column:
    return subject(message).rlike(MERGE_SUBJECT)


def is_fix(message) -> Column:
    """Whether a commit message announces a bug fix; merges and cosmetic fixes do not."""
    m = F.coalesce(col(message), F.lit(""))
    fix = reduce(lambda a, b: a | b, [subject(m).rlike(p) for p in FIX_SUBJECTS]) | m.rlike(CLOSES_ISSUE)
    return F.when(is_merge_subject(m) | m.rlike(COSMETIC_FIX) | m.rlike(TEXT_FIX), F.lit(False)).otherwise(fix)


def chunk_id(path, start, end, symbol, content) -> Column:
    parts = F.concat_ws(":", *[F.coalesce(col(x).cast("string"), F.lit("")) for x in (path, start, end, symbol, content)])
    return F.concat(F.lit("chunk_"), F.substring(F.sha2(parts, 256), 1, 16))


def doc_symbol_id(path, headings) -> Column:
    return F.concat(F.lit("doc:"), F.substring(F.sha2(F.concat_ws("#", col(path), F.array_join(col(headings), " > ")), 256), 1, 12))


def ring_position(key) -> Column:
    """First four bytes of the MD5 of a key as an unsigned number."""
    return F.conv(F.substring(F.md5(col(key).cast("binary")), 1, 8), 16, 10).cast("bigint")


# Control flow that adds a branch to a piece of code.
BRANCHES = (r"\bif\b", r"\belse\b", r"\bfor\b", r"\bwhile\b", r"\bswitch\b", r"\bcase\b", r"\bcatch\b", r"&&", r"\|\|", r"\?[^?]")
DEFINITION = r"\b(function|class|def|fn)\b"


def complexity(code) -> Column:
    """Number of branching constructs; at least 1 where something is defined."""
    n = reduce(lambda a, b: a + b, [F.size(F.regexp_extract_all(col(code), F.lit(p), F.lit(0))) for p in BRANCHES])
    return F.when(F.trim(F.coalesce(col(code), F.lit(""))) == "", 0).when((n == 0) & col(code).rlike(DEFINITION), 1).otherwise(n)


def imports(code, language) -> Column:
    """Modules named by import statements (Python, JavaScript, TypeScript)."""
    script = F.concat(F.regexp_extract_all(col(code), F.lit(r"""from\s+['"]([^'"]+)['"]"""), F.lit(1)), F.regexp_extract_all(col(code), F.lit(r"""require\(\s*['"]([^'"]+)['"]\s*\)"""), F.lit(1)))
    python = F.concat(F.regexp_extract_all(col(code), F.lit(r"(?m)^\s*import\s+([\w.]+)"), F.lit(1)), F.regexp_extract_all(col(code), F.lit(r"(?m)^\s*from\s+([\w.]+)\s+import"), F.lit(1)))
    return F.array_distinct(F.when(col(language) == "python", python).when(col(language).isin("javascript", "typescript"), script).otherwise(F.array().cast("array<string>")))


def exports(code) -> Column:
    return F.array_distinct(F.regexp_extract_all(col(code), F.lit(r"\bexport\s+(?:default\s+)?(?:async\s+)?(?:class|function|const|let|var|interface|type|enum)\s+(\w+)"), F.lit(1)))


def method_density(chars, lines, method_lines) -> Column:
    """Characters per line, less trusted for pieces much shorter than their method."""
    need = F.greatest(F.lit(2.0), F.ceil(F.sqrt(col(method_lines).cast("double"))))
    return F.when(col(lines) > 0, F.floor(col(chars) / col(lines) * F.least(F.lit(1.0), col(lines) / need) + 0.5)).otherwise(0)


def directory(path) -> Column:
    """What stands before the last slash; empty for a bare name."""
    return F.regexp_extract(col(path), r"^(.*)/[^/]*$", 1)


def split_method(symbol) -> Column:
    """struct(owner, separator, member), cut at the last ``#`` or else the last dot."""
    s = col(symbol)
    at = lambda sep: F.struct(*[F.regexp_extract(s, rf"^(.+)({sep})([^{sep}]+)$", k).alias(n) for k, n in ((1, "owner"), (2, "separator"), (3, "member"))])
    return F.when(s.rlike("^.+#[^#]+$"), at("#")).when(s.rlike(r"^.+\.[^.]+$"), at(r"\."))


def last_segment(symbol) -> Column:
    return F.element_at(F.split(col(symbol), r"::|[#.]"), -1)


def symbol_id(prefix, name, instance, separator: str = "::") -> Column:
    """prefix#name for instances, prefix.name for statics, prefix::name where neither."""
    sep = F.when(col(instance).isNull(), F.lit(separator)).when(col(instance), F.lit("#")).otherwise(F.lit("."))
    return F.when(F.coalesce(col(prefix), F.lit("")) == "", col(name)).otherwise(F.concat(col(prefix), sep, col(name)))


# Kinds of call receivers, in order of precedence where texts are ambiguous.
RECEIVER_KINDS = ("constant", "localVar", "selfMember", "super", "bareCall", "ivar", "chain", "index", "dynamic")
CONSTANT = r"^[A-Z][A-Za-z0-9_]*(?:::[A-Z][A-Za-z0-9_]*)*$"


def receiver_kind(receiver, locals_=None) -> Column:
    """The kind of a call's receiver; ``locals_`` is an array of typed local names."""
    r = col(receiver)
    local = F.array_contains(col(locals_), r) if locals_ is not None else F.lit(False)
    return (
        F.when(r.isNull(), "bareCall").when(r.isin("super", "<super>"), "super").when(r == "self", "selfMember").when(F.coalesce(local, F.lit(False)), "localVar")
        .when(r.rlike(CONSTANT), "constant").when(F.contains(r, F.lit("[")), "index").when(F.contains(r, F.lit(".")), "chain").when(r.startswith("@"), "ivar").otherwise("dynamic")
    )


def edge_visible(kind, confidence) -> Column:
    """Low-confidence dynamic edges are hidden when navigating."""
    return ~((F.coalesce(col(kind), F.lit("exact")) == "dynamic") & (F.coalesce(col(confidence), F.lit(1.0)) < 1))


def expand_braces(pattern: str) -> list[str]:
    """All alternatives of nested ``{a,b}`` groups."""
    depth, start = 0, -1
    for i, c in enumerate(pattern):
        if c == "{":
            if depth == 0:
                start = i
            depth += 1
        elif c == "}" and depth:
            depth -= 1
            if depth == 0:
                options, level, now = [], 0, ""
                for x in pattern[start + 1 : i]:
                    level += (x == "{") - (x == "}")
                    if x == "," and level == 0:
                        options.append(now)
                        now = ""
                    else:
                        now += x
                options.append(now)
                return [y for o in options for y in expand_braces(pattern[:start] + o + pattern[i + 1 :])]
    return [pattern]


def glob_regex(pattern: str) -> str:
    """A regular expression for one glob: ``**`` any folders, ``*`` and ``?`` within one."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif pattern[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif pattern[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + re.escape(pattern[i]), i + 1
    return f"^{out}$"


def matches_glob(path, pattern: str) -> Column:
    """Whether a path matches a glob; a leading ``!`` negates."""
    if pattern.startswith("!"):
        return ~matches_glob(path, pattern[1:])
    return reduce(lambda a, b: a | b, [col(path).rlike(glob_regex(p)) for p in expand_braces(pattern)])


def contains_glob(path, pattern: str) -> Column:
    """The looser reading: the longest literal part occurs anywhere in the path."""
    if pattern.startswith("!"):
        return ~contains_glob(path, pattern[1:])
    parts = [max(re.split(r"[*?]+", p), key=len).strip("/") for p in expand_braces(pattern)]
    return reduce(lambda a, b: a | b, [F.contains(col(path), F.lit(p)) for p in parts])
