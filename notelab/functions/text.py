"""Row-local text functions, all ``Column -> Column`` and JVM-side (no Python UDF).

Python's ``\\s``, ``\\w`` and ``\\d`` are Unicode classes; Java's defaults are not, so the
classes are spelled out (``WS``, ``W``, ``D``) and used everywhere a pattern needs them.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vocab import ENGLISH_STOP_WORDS

WS = r"[\t-\r\x{1c}-\x{20}\x{85}\p{Z}]"
W = r"[\p{L}\p{N}_]"
NOT_W = r"[^\p{L}\p{N}_]"
D = r"\p{Nd}"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def ws_tokens(col) -> Column:
    """Whitespace tokens, like Python's ``str.split()`` (no empty tokens)."""
    return F.filter(F.split(_c(col), WS + "+"), lambda t: t != F.lit(""))


def token_count(col) -> Column:
    """Number of whitespace tokens; NULL text gives NULL."""
    return F.size(ws_tokens(col))


def lower_text(col) -> Column:
    """P8."""
    return F.lower(_c(col))


def mrn_from_file(col) -> Column:
    """First run of digits followed by ``_``; NULL when there is none."""
    return F.nullif(F.regexp_extract(_c(col), r"(\p{Nd}+)_", 1), F.lit(""))


def visit_from_file(col) -> Column:
    """Fifth character from the end as a number (one character, so 12 reads as 2)."""
    c = _c(col)
    return F.when(F.length(c) >= 5, F.substring(c, -5, 1).try_cast("int"))


def note_name_from_xmi(col) -> Column:
    """``.xmi`` -> ``.txt`` at every occurrence."""
    return F.replace(_c(col), F.lit(".xmi"), F.lit(".txt"))


def anon_id(col) -> Column:
    """P5: drop the last extension, keep the part before the first ``-``."""
    stem = F.regexp_extract(_c(col), r"^(.*)\.", 1)
    return F.get(F.split(stem, "-"), 0)


def file_stem(col) -> Column:
    """File name up to the first ``.txt``."""
    return F.substring_index(_c(col), ".txt", 1)


def note_body(col) -> Column:
    """Fourth non-blank line (header + two skipped rows), first tab-separated field."""
    lines = F.filter(F.split(_c(col), r"\r\n|\r|\n"), lambda x: F.trim(x) != F.lit(""))
    return F.get(F.split(F.get(lines, 3), "\t"), 0)


def _sql_str(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def clean_text_sql(x: str, stop_words: Iterable[str] = ENGLISH_STOP_WORDS, max_tokens: int | None = None,
                   already_lower: bool = False) -> str:
    """The chain of ``clean_text`` as one Spark SQL expression over the SQL expression ``x``.

    Sent to the JVM in one call; regex patterns are raw literals, so backslashes reach the regex
    engine unchanged.  The steps keep the reference's order.  C18 binds the chain once (a
    one-element ``transform``), so that the branches don't run it again.
    """
    stop = ", ".join(_sql_str(w) for w in stop_words)

    def rr(s, pat, rep):
        return f"regexp_replace({s}, r'{pat}', '{rep}')"

    def toks(s, v):
        return f"filter(split({s}, r'{WS}+'), {v} -> {v} != '')"

    t = rr(x, WS + "[?¿]" + WS, " ")
    t = f"translate({t}, '\\n?¿\\u00A0', '    ')"
    t = rr(t, WS + "{2,}", " ")
    if stop:
        t = f"array_join(filter({toks(t, 'c7t')}, c7w -> NOT c7w IN ({stop})), ' ')"
    t = rr(t, "(?<!" + W + ")" + W + "*+:", "")
    t = rr(t, D + "{1,2}/" + D + "{2}/" + D + "{4}", "")
    t = rr(t, D + "{1,2}/" + D + "{2}/" + D + "{2}", "")
    t = rr(t, D, "")
    t = rr(t, r"\[" + NOT_W + r"*\]", " ")
    t = rr(t, r"\(" + NOT_W + r"*\)", " ")
    t = f"translate({t}, '/()[]', ' ')"
    t = rr(t, r"[^\p{L}\p{N}_" + WS[1:-1] + r".]", "  ")
    t = rr(t, WS + "{2,}", " ")
    t = rr(t, WS + r"\.", ".")
    t = f"array_join(filter({toks(t, 'c17t')}, c17w -> length(c17w) > 1), ' ')"
    t = rr(t, r"(?<![^ ])[._]+|[._]+(?![^ ])", "")
    if max_tokens is not None:
        # a text over the cap has a character and a space per word at least; only such a text is split, once
        capped = "array_join(filter(c18w, c18u -> length(c18u) > 2), ' ')"
        split = f"transform(array({toks('c18x', 'c18t')}), c18w -> CASE WHEN size(c18w) > {max_tokens} THEN {capped} ELSE c18x END)[0]"
        t = f"transform(array({t}), c18x -> CASE WHEN length(c18x) > {2 * max_tokens} THEN {split} ELSE c18x END)[0]"
    out = t if already_lower else f"lower({t})"
    return f"CASE WHEN {x} IS NULL OR {x} = '' THEN CAST(NULL AS STRING) ELSE {out} END"


def clean_text(col: str, stop_words: Iterable[str] = ENGLISH_STOP_WORDS, max_tokens: int | None = None,
               already_lower: bool = False) -> Column:
    """C1-C17 of a text column, and with ``max_tokens`` C18 (longer results lose words of two letters).

    Single-character replacements use ``translate``; the stop list is an ``IN`` set; ``\\w*:`` is
    anchored at word starts (same matches, no rescans inside words).  With ``already_lower`` (text
    lower-cased upstream) the final ``lower`` is skipped: no step adds an upper-case letter.
    """
    return F.expr(clean_text_sql(f"`{col}`", stop_words, max_tokens, already_lower))
