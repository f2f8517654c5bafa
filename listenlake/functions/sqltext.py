"""SQL statements laid out for logs."""

from __future__ import annotations

import re
import textwrap

#: Keywords that begin a line; fixed values.
LINE_STARTS = ("SELECT", "FROM", "WHERE", "GROUP BY", "HAVING", "ORDER BY", "LIMIT", "LEFT JOIN", "RIGHT JOIN", "INNER JOIN", "OUTER JOIN", "JOIN", "UNION ALL", "UNION", "INSERT INTO", "VALUES", "UPDATE", "SET", "DELETE")
_TOKEN = re.compile(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|\s+|[^\s'\"]+|['\"]")


def format_sql(text: str, width: int = 120) -> str:
    """White space collapsed, a line for each clause, lines of ``width`` at most where words allow; quoted text stays as it is."""
    quoted: list[str] = []

    def piece(m: re.Match) -> str:
        t = m[0]
        if t[0] in "'\"" and len(t) > 1:
            quoted.append(t)
            return f"\x00{len(quoted) - 1}\x00"
        return " " if t.isspace() else t

    flat = _TOKEN.sub(piece, text).strip()
    starts = "|".join(re.escape(k).replace(r"\ ", " ") for k in sorted(LINE_STARTS, key=len, reverse=True))
    lines = re.sub(rf"(?i) (?=(?:{starts})\b)", "\n", flat).split("\n")
    # a join's own words stay with it
    merged: list[str] = []
    for line in lines:
        if merged and re.fullmatch(r"(?i)(left|right|inner|outer|union)", merged[-1].rsplit(" ", 1)[-1]) and re.match(r"(?i)(join|all)\b", line):
            merged[-1] += " " + line
        else:
            merged.append(line)
    wrapped = [w for line in merged for w in (textwrap.wrap(line, width, break_long_words=False, break_on_hyphens=False, subsequent_indent="    ") or [""])]
    return re.sub("\x00(\\d+)\x00", lambda m: quoted[int(m[1])], "\n".join(wrapped))
