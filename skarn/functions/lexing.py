"""Source texts with what is no code blanked out."""

from __future__ import annotations

import re

SCRIPTS = ("typescript", "javascript")


def blanked(text: str, language: str) -> str:
    """The text with comments and the insides of strings as blanks; length and lines stay."""
    line = {"python": "#", "ruby": "#", "bash": r"(?<![\w$&{])#"}.get(language, "//")
    quotes = r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'" + (r"|`(?:\\.|[^`\\])*`" if language in (*SCRIPTS, "go") else "")
    if language == "rust":
        quotes = r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\\n])'"
    block = r"/\*.*?\*/|" if line == "//" else r"^=begin.*?^=end[^\n]*|" if language == "ruby" else ""

    def blank(m: re.Match) -> str:
        s = m[0]
        inner = re.sub(r"[^\n]", " ", s)
        return s[0] + inner[1:-1] + s[-1] if s[0] in "\"'`" and len(s) > 1 else inner

    return re.sub(f"{block}{line}[^\n]*|{quotes}", blank, text, flags=re.S | re.M)
