"""Plain Python answers on small fixtures, written from the documented behaviour."""

import math
import re
from collections import Counter, defaultdict
from pathlib import PurePosixPath

from auditlake.catalog.rules import ENTROPY_RULE
from auditlake.functions.text import DEFAULT_MARKER

FLAGS = re.IGNORECASE | re.MULTILINE


def suppressed(line, rule_id, marker=DEFAULT_MARKER):
    for comment in ("# ", "// "):
        head, tag, rest = line.partition(comment + marker)
        if tag and (not rest.strip() or rule_id in rest.split()):
            return True
    return False


def line_at(text, offset):
    start = text.rfind("\n", 0, offset) + 1
    end = text.find("\n", start)
    return text.count("\n", 0, offset) + 1, text[start:] if end < 0 else text[start:end]


def rule_findings(files, rules):
    """{(path, rule_id): (first line, matches, snippet)}"""
    out = {}
    for path, text in files.items():
        ext = PurePosixPath(path).suffix.lower()
        for rule in rules:
            if rule.extensions and ext not in rule.extensions:
                continue
            lines = [line_at(text, m.start()) for m in re.finditer(rule.pattern, text, FLAGS)]
            open_lines = [(n, raw) for n, raw in lines if not suppressed(raw, rule.rule_id)]
            if open_lines:
                n, raw = open_lines[0]
                out[path, rule.rule_id] = (n, len(open_lines), raw.strip()[:100])
    return out


def entropy(text):
    return -sum(c / len(text) * math.log2(c / len(text)) for c in Counter(text).values()) if text else 0.0


def entropy_findings(files):
    """{(path, stripped line): first line number}"""
    out = {}
    for path, text in files.items():
        for m in re.finditer(ENTROPY_RULE.pattern, text, re.IGNORECASE):
            n, raw = line_at(text, m.start())
            if entropy(m.group(1)) >= 4.5 and not suppressed(raw, ENTROPY_RULE.rule_id):
                out.setdefault((path, raw.strip()), n)
    return out


def log_context(lines):
    """[(line, commit, author, date, message, file)] of the added lines of a log."""
    state = defaultdict(str)
    out = []
    for line in lines:
        for name, prefix in (("c", "COMMIT:"), ("a", "AUTHOR:"), ("d", "DATE:"), ("m", "MSG:")):
            if line.startswith(prefix):
                state[name] = line[len(prefix):].strip()
        head = re.match(r"^diff --git a/(.+) b/(.+)$", line)
        if head:
            state["f"] = head[2]
        if line.startswith("+") and not line.startswith("+++"):
            out.append((line[1:], *(state[k] for k in "cadmf")))
    return out
