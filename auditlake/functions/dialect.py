"""Python ``re`` patterns and shell globs as JVM regular expressions.

The engine matches with Spark's own regex functions. The two dialects agree on nearly everything;
the differences that change results are rewritten here.
"""

from __future__ import annotations

import re

# Fixed value: the characters Python's str.strip() and \s treat as white space.
WS = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# Fixed value: what Python's str.splitlines() ends a line at.
LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
_WORD = r"\p{L}\p{N}_"
_DIGIT = r"\p{Nd}"

# i = ignore case, m = ^ and $ at lines, u = Unicode case folding, d = only \n ends a line
JVM_FLAGS = "(?imud)"


class UnsupportedPattern(ValueError):
    """The pattern has no JVM form with the same meaning."""


_REPEAT = re.compile(r"\{(?:\d+(?:,\d*)?|,\d*)\}")
_LETTER = re.compile(r"[A-Za-z0-9_](?![?*{])")
_UPPER_RANGE = re.compile("[A-Z]-[A-Z]")
_OCTAL = re.compile(r"0[0-7]{0,2}|[0-3][0-7][0-7]")


def _escape(pattern: str, at: int) -> tuple[str, int]:
    """JVM form of the escape at ``at`` and the position after it."""
    octal = _OCTAL.match(pattern, at + 1)
    if octal:
        return f"\\x{{{int(octal.group(), 8):x}}}", octal.end()
    e = pattern[at + 1]
    if e == "v":
        return r"\x0b", at + 2
    if e == "U":
        return f"\\x{{{pattern[at + 2 : at + 10]}}}", at + 10
    if e == "N":
        raise UnsupportedPattern("named characters")
    return "\\" + e, at + 2


def to_jvm(pattern: str, flags: str = JVM_FLAGS) -> str:
    """JVM regular expression with the meaning Python's ``re`` gives ``pattern``."""
    outside = {
        "s": f"[{WS}]", "S": f"[^{WS}]", "w": f"[{_WORD}]", "W": f"[^{_WORD}]",
        "d": _DIGIT, "D": r"\P{Nd}", "Z": r"\z",
        "b": f"(?:(?<=[{_WORD}])(?![{_WORD}])|(?<![{_WORD}])(?=[{_WORD}]))",
        "B": f"(?:(?<=[{_WORD}])(?=[{_WORD}])|(?<![{_WORD}])(?![{_WORD}]))",
    }
    folds = "i" in flags
    inside = {"s": WS, "w": _WORD, "d": _DIGIT, "b": r"\x08"}
    out, i, in_class, class_start = [], 0, False, -1
    after_letter = False  # the atom just written is a plain word character
    groups: dict[str, str] = {}  # JVM group names have no underscore
    while i < len(pattern):
        c = pattern[i]
        was_letter, after_letter = after_letter, False
        if c == "\\":
            if i + 1 >= len(pattern):
                raise UnsupportedPattern("trailing backslash")
            e = pattern[i + 1]
            i += 2
            if in_class:
                if e in "SWD":
                    raise UnsupportedPattern(f"\\{e} inside a character class")
                if e in inside:
                    out.append(inside[e])
                else:
                    text, i = _escape(pattern, i - 2)
                    out.append(text)
            elif e == "b" and was_letter:
                out.append(f"(?![{_WORD}])")
            elif e == "b" and _LETTER.match(pattern, i):
                out.append(f"(?<![{_WORD}])")
            elif e in outside:
                out.append(outside[e])
            else:
                text, i = _escape(pattern, i - 2)
                out.append(text)
            continue
        if in_class:
            if c == "]" and i > class_start:
                in_class = False
                out.append("]")
            elif c in "[]&~":
                out.append("\\" + c)
            elif folds and _UPPER_RANGE.match(pattern, i):
                # letters that fold to ASCII are compared in lower case only
                out.append(pattern[i : i + 3] + pattern[i : i + 3].lower())
                i += 2
            else:
                out.append(c)
        elif c == "[":
            in_class = True
            out.append("[")
            class_start = i + 1
            if pattern[i + 1 : i + 2] == "^":
                out.append("^")
                i += 1
                class_start += 1
        elif c == "(" and pattern.startswith("(?", i):
            rest = pattern[i + 2 :]
            if rest.startswith("P<"):
                end = pattern.index(">", i)
                out.append("(?<" + groups.setdefault(pattern[i + 4 : end], f"g{len(groups)}") + ">")
                i = end
            elif rest.startswith("P="):
                end = pattern.index(")", i)
                if pattern[i + 4 : end] not in groups:
                    raise UnsupportedPattern("reference to an unknown group")
                out.append(r"\k<" + groups[pattern[i + 4 : end]] + ">")
                i = end
            elif rest[:1] in ("P", "(", "#") or re.match(r"[a-zA-Z]*[aLx]", rest):
                raise UnsupportedPattern("group form without a JVM equivalent")
            else:
                out.append("(?")
                i += 1
        elif c == "{":
            # Python reads a brace that starts no repetition as itself, and {,n} as {0,n}
            repeat = _REPEAT.match(pattern, i)
            if repeat:
                out.append(repeat.group().replace("{,", "{0,"))
                i = repeat.end() - 1
            else:
                out.append(r"\{")
        else:
            out.append(c)
            after_letter = c == "_" or (c.isascii() and c.isalnum())
        i += 1
    return flags + "".join(out)


def _class_items(body: str) -> str:
    """Body of a glob character class, without ranges that run backwards."""
    keep = []
    i = 0
    while i < len(body):
        if i + 2 < len(body) and body[i + 1] == "-":
            low, high = body[i], body[i + 2]
            if low <= high:
                keep.append(re.escape(low) + "-" + re.escape(high))
            i += 3
        else:
            keep.append("\\" + body[i] if body[i] in r"\[]^-&~" else body[i])
            i += 1
    return "".join(keep)


def glob_to_jvm(glob: str, *, star: str = ".*", one: str = ".") -> str:
    """Shell glob as an unanchored JVM pattern body; ``*`` crosses ``/`` unless ``star`` says otherwise."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            out.append(star)
        elif c == "?":
            out.append(one)
        elif c == "[":
            first = i + 2 if glob[i + 1 : i + 2] == "!" else i + 1
            end = glob.find("]", first + 1)
            if end < 0:
                out.append(r"\[")
            else:
                negated = first == i + 2
                items = _class_items(glob[first:end])
                if items:
                    out.append(f"[{'^' if negated else ''}{items}]")
                else:
                    out.append(one if negated else "(?!)")
                i = end
        else:
            out.append(c if c.isalnum() or c == "_" else "\\" + c if c.isascii() else c)
        i += 1
    return "".join(out)


def whole_glob(glob: str) -> str:
    """Anchored JVM pattern for a glob that must cover a whole name or path."""
    return r"(?s)\A" + glob_to_jvm(glob) + r"\z"


def tail_glob(glob: str) -> str:
    """JVM pattern for a glob matched against the last components of a path, component by component."""
    parts = [p for p in glob.split("/") if p not in ("", ".")]
    body = "/".join(
        "[^/]+" if p in ("*", "**") else glob_to_jvm(p, star="[^/]*", one="[^/]") for p in parts
    )
    return r"(?s)(?:\A|/)" + body + r"\z"
