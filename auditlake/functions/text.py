"""Scalar building blocks over text columns. Every function takes and returns Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from auditlake.catalog.rules import MASK_PATTERN
from auditlake.functions.dialect import WS

SNIPPET_CHARS = 100
HISTORY_SNIPPET_CHARS = 120
DEFAULT_MARKER = "audit-ignore"


def sql_literal(text: str) -> str:
    """SQL string literal; patterns hold quotes and backslashes, so both are escaped."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def file_ext(path: Column) -> Column:
    """Last suffix of the base name, lower-cased; names that only start with a dot have none."""
    return F.lower(F.regexp_extract(file_name(path), r"(?s)^.+(\.[^.]+)$", 1))


def normalize_newlines(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("\r")), F.regexp_replace(text, r"\r\n?", "\n")).otherwise(text)


def decode_text(raw: Column) -> Column:
    """Bytes to text: undecodable bytes are dropped, CRLF and CR become LF.

    ``make_valid_utf8`` marks bad bytes with U+FFFD; a U+FFFD the file really holds is put aside
    first so that only the marks are dropped.
    """
    text = raw.cast("string")
    marked = F.make_valid_utf8(text)
    genuine = F.replace(F.replace(text, F.lit("\ufdd0"), F.lit("\ufdd0\ufdd1")), F.lit("\ufffd"), F.lit("\ufdd0\ufdd2"))
    cleaned = F.replace(F.make_valid_utf8(genuine), F.lit("\ufffd"), F.lit(""))
    restored = F.replace(
        F.replace(cleaned, F.lit("\ufdd0\ufdd2"), F.lit("\ufffd")), F.lit("\ufdd0\ufdd1"), F.lit("\ufdd0")
    )
    return normalize_newlines(F.when(F.contains(marked, F.lit("\ufffd")), restored).otherwise(text))


# A run of one character.
RUNS = r"(?s)(.)\1*"
_ENDS = rf"\A[{WS}]+|[{WS}]+\z"


def strip(text: Column) -> Column:
    """White space off both ends, in the Unicode sense."""
    return F.regexp_replace(text, _ENDS, "")


def snippet(line: Column, chars: int = SNIPPET_CHARS) -> Column:
    return F.left(strip(line), F.lit(chars))


def normalize_path(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def fingerprint(rule_id: Column, path: Column, code: Column, *, slash_paths: bool = True) -> Column:
    """Identity of a finding that survives line shifts: 16 hex digits over rule, path and code."""
    where = normalize_path(path) if slash_paths else path
    return F.left(F.sha1(F.concat_ws(":", rule_id, where, strip(code)).cast("binary")), F.lit(16))


def mask_secret(code: Column) -> Column:
    return F.regexp_replace(code, MASK_PATTERN, "$1****$1")


def display_snippet(category: Column, code: Column) -> Column:
    """What may be shown: quoted values of secret findings are masked, other code is kept."""
    return F.when(category == "Secrets", mask_secret(code)).otherwise(code)


def entropy_sql(text: str) -> str:
    """Bits per character; 0 for the empty string. Takes and gives SQL text.

    The characters are sorted, so that equal ones form runs and each run is one term of the sum.
    """
    size = f"char_length({text})"
    runs = f"regexp_extract_all(array_join(sort_array(split({text}, '')), ''), {sql_literal(RUNS)}, 0)"
    share = f"char_length(run) / {size}"
    return (
        f"CASE WHEN {size} = 0 THEN 0D ELSE "
        f"aggregate({runs}, 0D, (total, run) -> total - ({share}) * log2({share})) END"
    )


def shannon_entropy(text: str) -> Column:
    """``entropy_sql`` as a column."""
    return F.expr(entropy_sql(text))


def strip_sql(text: str) -> str:
    return f"regexp_replace({text}, {sql_literal(_ENDS)}, '')"


def suppressed_sql(line: str, rule_id: str, marker: str = DEFAULT_MARKER) -> str:
    """Whether a line carries the marker after ``#`` or ``//``, bare or followed by the rule's id.

    Takes and gives SQL text, as it is mostly used inside lambdas over a file's lines.
    """

    def after(comment: str) -> str:
        tag = f"{comment} {marker}"
        at = f"instr({line}, {sql_literal(tag)})"
        rest = strip_sql(f"substring({line}, {at} + {len(tag)}, char_length({line}))")
        words = f"split({rest}, {sql_literal(f'[{WS}]+')})"
        return f"CASE WHEN {at} > 0 THEN {rest} = '' OR array_contains({words}, {rule_id}) ELSE false END"

    return f"(contains({line}, {sql_literal(marker)}) AND ({after('#')} OR {after('//')}))"


def is_suppressed(line: str, rule_id: str, marker: str = DEFAULT_MARKER) -> Column:
    """``suppressed_sql`` as a column."""
    return F.expr(suppressed_sql(line, rule_id, marker))


def describe_count(description: Column, count: Column) -> Column:
    """Description with the number of further matches in the same file."""
    extra = (count - 1).cast("string")
    return F.when(count > 1, F.concat(description, F.lit(" (and "), extra, F.lit(" more in this file)"))).otherwise(
        description
    )


def strip_count_suffix(description: Column) -> Column:
    return F.split_part(description, F.lit(" (and "), F.lit(1))


def html_escape(text: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def gate_text(content: Column) -> Column:
    """Lower-cased text for literal gates.

    Four letters fold to ASCII under case-insensitive matching but not under ``lower``; they are
    replaced first where they occur, so a gate never hides a match.
    """
    odd = F.lit(False)
    for ch in "\u017f\u0131\u0130\u212a":
        odd = odd | F.contains(content, F.lit(ch))
    return F.lower(F.when(odd, F.translate(content, "\u017f\u0131\u0130\u212a", "siik")).otherwise(content))


def sentinel(content: Column) -> Column:
    """A character that does not occur in the text."""
    return (
        F.when(~F.contains(content, F.lit("\u0001")), F.lit("\u0001"))
        .when(~F.contains(content, F.lit("\ufdd0")), F.lit("\ufdd0"))
        .when(~F.contains(content, F.lit("\ufdd1")), F.lit("\ufdd1"))
        .otherwise(F.lit("\U0010ffff"))
    )


def match_lines(content: str = "content", pattern: str = "pattern", mark: str = "mark", grouped: str = "false") -> Column:
    """Lines on which matches start, in order: array of (line, raw, n). Arguments are SQL text.

    Matches run over the whole text and may span lines. Each gets ``mark`` put before its start;
    splitting at line ends then tells the start line and the number of matches on it. A ``grouped``
    pattern has the text before the match as its first group. A text without a match is not split.
    """
    marked = f"concat(IF({grouped}, '$1', ''), {mark}, IF({grouped}, '$2$3', '$0'))"
    return F.expr(f"""
        flatten(transform(
          filter(array(regexp_replace({content}, {pattern}, {marked})), whole -> contains(whole, {mark})),
          whole -> transform(
            filter(
              transform(split(whole, '\\n', -1), (text, i) -> named_struct('line', i + 1, 'text', text)),
              x -> contains(x.text, {mark})),
            x -> named_struct('line', x.line, 'raw', replace(x.text, {mark}, ''),
                              'n', bigint(char_length(x.text) - char_length(replace(x.text, {mark}, '')))))))""")
