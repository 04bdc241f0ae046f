"""Small helpers for SQL text shared by the query modules."""

from __future__ import annotations


def select_items(sel: str) -> list[str]:
    """Split a SQL select list on top-level commas (outside parentheses and
    string literals) so the same text feeds ``selectExpr`` and DuckDB."""
    out, depth, cur, quoted = [], 0, "", False
    for ch in sel:
        if ch == "'":
            quoted = not quoted
        elif not quoted and ch == "(":
            depth += 1
        elif not quoted and ch == ")":
            depth -= 1
        if ch == "," and depth == 0 and not quoted:
            out.append(cur.strip())
            cur = ""
        else:
            cur += ch
    out.append(cur.strip())
    return [x for x in out if x]
