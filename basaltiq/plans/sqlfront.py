"""A pass over SQL text for the syntax that Spark's parser lacks: $n, -> and ->>, ARRAY[...]."""

from __future__ import annotations

import re

from ..errors import ParseError

TOKEN = re.compile(r"""'(?:[^']|'')*'|"(?:[^"]|"")*"|`[^`]*`|--[^\n]*|\$\d+|->>|->|\w+(?:\.\w+)*|\s+|.""", re.S)


def tokens(sql: str) -> list[str]:
    return TOKEN.findall(sql)


def _operand_start(out: list[str]) -> int:
    """Where the operand that ends `out` begins: a name, a literal or a bracketed term with its function name."""
    i = len(out) - 1
    while i >= 0 and out[i].isspace():
        i -= 1
    if i >= 0 and out[i] in ")]":
        depth = 0
        while i >= 0:
            depth += (out[i] in ")]") - (out[i] in "([")
            if depth == 0:
                break
            i -= 1
        if i > 0 and re.fullmatch(r"[\w.]+", out[i - 1]):
            i -= 1
    if i < 0:
        raise ParseError("-> without a left operand")
    return i


def translate(sql: str, params: int = 0) -> str:
    """The same statement for Spark; $n becomes :pn."""
    out: list[str] = []
    todo = tokens(sql)
    i = 0
    brackets: list[str] = []
    while i < len(todo):
        t = todo[i]
        if t in ("->", "->>"):
            i += 1
            while i < len(todo) and todo[i].isspace():
                i += 1
            if i == len(todo):
                raise ParseError(f"{t} without a right operand")
            key = todo[i]
            step = f"[{key}]" if key.isdigit() else "['" + key.strip("'").replace("''", "'") + "']"
            at = _operand_start(out)
            left = "".join(out[at:]).rstrip()
            chained = re.fullmatch(r"get_json_object\((.*), \"(\$.*)\"\)", left, re.S)
            out[at:] = [f'get_json_object({chained[1]}, "{chained[2]}{step}")' if chained else f'get_json_object({left}, "${step}")']
        elif re.fullmatch(r"\$\d+", t):
            n = int(t[1:])
            if params and not 1 <= n <= params:
                raise ParseError(f"parameter {t} of {params}")
            out.append(f":p{n}")
        elif t.upper() == "ARRAY" and "".join(todo[i + 1 : i + 3]).strip().startswith("["):
            while todo[i + 1].isspace():
                i += 1
            i += 1
            brackets.append(")")
            out += ["array", "("]
        elif t == "[":
            brackets.append("]")
            out.append(t)
        elif t == "]":
            out.append(brackets.pop() if brackets else t)
        elif t.startswith('"'):
            out.append("`" + t[1:-1].replace('""', '"') + "`")
        elif t.startswith("--"):
            pass
        else:
            out.append(t)
        i += 1
    return "".join(out)


def split_top(text: str, sep: str = ",") -> list[str]:
    """Split at separators outside brackets and literals."""
    parts, depth, last = [], 0, []
    for t in tokens(text):
        depth += (t in "([") - (t in ")]") if len(t) == 1 else 0
        if t == sep and depth == 0:
            parts.append("".join(last).strip())
            last = []
        else:
            last.append(t)
    tail = "".join(last).strip()
    return [*parts, tail] if tail or parts else []


def first_statement(sql: str) -> str:
    return split_top(sql, ";")[0] if sql.strip() else ""


def cut_keyword(text: str, word: str) -> tuple[str, str | None]:
    """text before and after the first `word` outside brackets and literals."""
    depth, out = 0, []
    todo = tokens(text)
    for i, t in enumerate(todo):
        depth += (t in "([") - (t in ")]") if len(t) == 1 else 0
        if depth == 0 and t.upper() == word:
            return "".join(out).strip(), "".join(todo[i + 1 :]).strip()
        out.append(t)
    return text.strip(), None
