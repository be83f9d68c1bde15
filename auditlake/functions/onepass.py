"""Forms of patterns that walk a text once.

A pattern like ``head.*tail`` starts again at every head, so a long line with many heads and no tail
costs the square of its length. But if the first head of a line finds no tail after it, no later head
of that line does. The forms here begin at the start of a line (or of a stretch without closing
brackets) or where the last match ended, go to the first head there, and do not look for another.
"""

from __future__ import annotations

import re

from auditlake.functions.dialect import WS

_GAP = re.compile(r"(?<!\\)\.\*\??|\[\^([^\]\\\w]*(?:\\\[)?)\]\*\??")
_SPACE = r"\s*"
_SAME_LINE = "[" + WS.replace(r"\t-\r", r"\t\x0b-\r") + "]*"


def one_pass(pattern: str) -> str | None:
    """A pattern with groups 1 (text before a match), 2 and 3 (the match), or None if there is no such form.

    ``$1`` + mark + ``$2$3`` in a replacement puts a mark before each match of the given pattern.
    """
    first = _GAP.search(pattern)
    if not first or "(?=" in pattern or "(?!" in pattern or not _balanced(pattern[: first.start()]):
        return None
    head, stops, rest = _plain(pattern[: first.start()]), first.group(1), _plain(pattern[first.end() :])
    greedy, gaps = not first.group().endswith("?"), list(_GAP.finditer(rest))
    if not head or not rest or not _balanced(rest):
        return None
    if stops is None:  # the gap runs to the end of the line
        run, begin = r"[^\n]", "^"
        if any(g.group(1) is not None for g in gaps):
            return None
        more = [rest[a:b] for a, b in zip([0, *(g.end() for g in gaps)], [*(g.start() for g in gaps), len(rest)], strict=True)]
    else:  # the gap runs to a sign that the head must not hold; what follows it is tried once for each stretch
        run, begin, more = f"[^{stops}]", rf"\A|(?<=[{stops}])", [rest]
        if any(rf"\{s}" in head for s in stops.replace("\\", "")):
            return None
    # all parts but the last are met where they first occur; only the last gap decides where a match ends
    middle = "".join(f"(?>{run}*?{part})" for part in more[:-1])
    tail = f"{middle}{run}*{'' if greedy else '?'}{more[-1]}"
    if run != r"[^\n]" or _SPACE not in head:
        return rf"(?:{begin}|\G)((?>{run}*?(?={head})))({head}{tail})()"
    same = head.replace(_SPACE, _SAME_LINE)
    at = [m.start() for m in re.finditer(re.escape(_SPACE), head)]
    # heads that reach into the next line, by the first white space that does
    across = "|".join(head[:i].replace(_SPACE, _SAME_LINE) + _SAME_LINE + r"\n\s*" + head[i + len(_SPACE) :] for i in at)
    return rf"(?:(?:{begin}|\G)((?>{run}*?(?={same})))({same}{tail})|((?:{across}){tail}))"


def _plain(pattern: str) -> str:
    """The pattern without capturing groups."""
    return re.sub(r"(?<!\\)\((?!\?)", "(?:", pattern)


def _balanced(pattern: str) -> bool:
    bare = re.sub(r"\\.|\[[^\]]*\]", "", pattern)
    return bare.count("(") == bare.count(")")
