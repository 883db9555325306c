"""Section finder (P11, P12, P14-P19, O1, W1, W2) as staged SQL expressions.

Everything here is row-local: one note in, an array of section structs out.  Each stage is a
column of its own (one JVM call each), so that no stage is inlined and computed again by a later
one; the queries of the single operators read the same stages.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vocab import ASSESSMENT_TITLES, OBJECTIVE, SUBJECTIVE

SECTION_TYPE = (
    "array<struct<section_name:string,start_title:int,end_title:int,start_section:int,end_section:int>>"
)
_TITLE = "struct<start_title:int,end_title:int,section_name:string>"


def overlap_sql(p: str, x: str) -> str:
    """Closed-interval overlap of two titles; -1 none, 0 the first is at least as long, 1 the second is longer."""
    return (f"CASE WHEN {p}.start_title <= {x}.end_title AND {x}.start_title <= {p}.end_title THEN "
            f"CASE WHEN {p}.end_title - {p}.start_title >= {x}.end_title - {x}.start_title THEN 0 ELSE 1 END ELSE -1 END")


def interval_overlap(b1, e1, b2, e2) -> Column:
    """Closed overlap as 0/1 (touching counts)."""
    return F.when((e1 < b2) | (e2 < b1), F.lit(0)).otherwise(F.lit(1))


def _third_sql(t: str) -> str:
    """The first assessment-like title the text contains; NULL = unsectioned."""
    whens = " ".join(f"WHEN contains({t}, '{title}') THEN '{title}'" for title in ASSESSMENT_TITLES)
    return f"CASE {whens} END"


def _found_sql() -> str:
    """The titles present, 0-based [start, end) of their first occurrence, sorted by start."""
    def one(pos, name, length):
        return (f"CASE WHEN {pos} > 0 THEN named_struct('start_title', {pos} - 1, 'end_title', {pos} - 1 + {length}, "
                f"'section_name', {name}) END")
    cands = ", ".join([one("_pos.s", f"'{SUBJECTIVE}'", len(SUBJECTIVE)), one("_pos.o", f"'{OBJECTIVE}'", len(OBJECTIVE)),
                       one("_pos.a", "_third", "length(_third)")])
    return f"array_sort(filter(array({cands}), f -> f IS NOT NULL))"


def _kept_sql(found: str = "_found") -> str:
    """Greedy pass over adjacent titles, state = (kept titles, pending title).

    No overlap keeps the pending title and makes the next one pending; an overlap keeps the longer
    (the first on a tie) and consumes both, so the winner is never compared again.  Where the
    reference runs past the end on a last overlapping pair, the winner is kept.
    """
    none = f"CAST(NULL AS {_TITLE})"

    def state(kept, pend):
        return f"named_struct('kept', {kept}, 'pend', {pend})"
    with_pend, with_x = "array_append(acc.kept, acc.pend)", "array_append(acc.kept, x)"
    return (f"aggregate({found}, {state(f'CAST(array() AS array<{_TITLE}>)', none)}, (acc, x) -> "
            f"CASE WHEN acc.pend IS NULL THEN {state('acc.kept', 'x')} ELSE CASE {overlap_sql('acc.pend', 'x')} "
            f"WHEN -1 THEN {state(with_pend, 'x')} WHEN 0 THEN {state(with_pend, none)} ELSE {state(with_x, none)} END END, "
            f"acc -> CASE WHEN acc.pend IS NULL THEN acc.kept ELSE {with_pend} END)")


def _bounds_sql(t: str, absent: str = "_third IS NULL", kept: str = "_kept") -> str:
    """Content runs from a title's end to the next kept title's start; the last to the text end."""
    return (f"CASE WHEN {absent} OR {t} IS NULL THEN CAST(array() AS {SECTION_TYPE}) ELSE "
            f"CAST(transform({kept}, (k, i) -> named_struct('section_name', k.section_name, 'start_title', k.start_title, "
            "'end_title', k.end_title, 'start_section', k.end_title, 'end_section', "
            f"CASE WHEN i + 1 < size({kept}) THEN get({kept}, i + 1).start_title ELSE length({t}) END)) AS {SECTION_TYPE}) END")


def with_sections(df: DataFrame, text_col: str, out: str = "sections", keep_titles: bool = False) -> DataFrame:
    """P16 as staged projections: route, title positions, sorted titles, greedy pass, bounds.

    Empty array = unsectioned.  ``keep_titles`` leaves the stages ``_third``, ``_found`` and ``_kept``.
    """
    t = f"`{text_col}`"
    staged = (df.withColumn("_third", F.expr(_third_sql(t)))
              .withColumn("_pos", F.expr(f"named_struct('s', instr({t}, '{SUBJECTIVE}'), 'o', instr({t}, '{OBJECTIVE}'), "
                                         f"'a', CASE WHEN _third IS NOT NULL THEN instr({t}, _third) ELSE 0 END)"))
              .withColumn("_found", F.expr(_found_sql()))
              .withColumn("_kept", F.expr(_kept_sql())))
    result = staged.withColumn(out, F.expr(_bounds_sql(t)))
    return result.drop("_pos", *([] if keep_titles else ["_third", "_found", "_kept"]))


def _literal(title: str) -> str:
    return "'" + title.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _listed_sql(t: str, titles: Sequence[str]) -> str:
    """O1, P11 for any list: every title of the list that the text holds, [start, end) of its first occurrence.

    The list is one array literal and each title one substring search, so a row's work is the list's length times its text's.
    Sorted by start; titles that start together come in the list's order. ``t`` must be a bound variable, as every title reads it.
    """
    known = ", ".join(f"named_struct('n', {_literal(x)}, 'l', {len(x)}, 'i', {i})" for i, x in enumerate(titles))
    at = f"transform(array({known}), k -> named_struct('start_title', instr({t}, k.n) - 1, 'i', k.i, 'l', k.l, 'n', k.n))"
    return (f"transform(array_sort(filter({at}, f -> f.start_title >= 0)), f -> named_struct('start_title', f.start_title, "
            "'end_title', f.start_title + f.l, 'section_name', f.n))")


def with_title_sections(df: DataFrame, text_col: str, titles: Sequence[str], out: str = "sections", keep_titles: bool = False) -> DataFrame:
    """P11, W1, W2 with a list of titles: the section array of every text that holds one of them; else an empty array.

    A title is found at its first occurrence, case as given.  Of two neighbours that touch or overlap the longer one stays
    (the first on a tie).  A null text has no sections; an empty title is an error.  Search, pass and bounds are one expression
    whose steps are bound variables: a filter that the planner pushes below it then repeats it once, not once per step.
    """
    if not titles or not all(titles):
        raise ValueError("titles must be non-empty strings")
    found = f"CASE WHEN txt IS NULL THEN CAST(array() AS array<{_TITLE}>) ELSE {_listed_sql('txt', titles)} END"
    steps = f"transform(array(`{text_col}`), txt -> named_struct('t', txt, 'found', {found}))"
    steps = f"transform({steps}, x -> named_struct('t', x.t, 'found', x.found, 'kept', {_kept_sql('x.found')}))"
    bounds = _bounds_sql("x.t", "size(x.found) = 0", "x.kept")
    if not keep_titles:
        return df.withColumn(out, F.expr(f"transform({steps}, x -> {bounds})[0]"))
    whole = df.withColumn("_steps", F.expr(f"transform({steps}, x -> named_struct('found', x.found, 'kept', x.kept, 'sections', {bounds}))[0]"))
    return whole.withColumns({out: F.col("_steps.sections"), "_found": F.col("_steps.found"), "_kept": F.col("_steps.kept")}).drop("_steps")


def section_texts(text, secs, sections_list: Sequence[str] | None = None, delete_empty: bool = True) -> Column:
    """Texts of the sections in order of appearance; of those in ``sections_list`` if it is given, empty ones only if asked for."""
    if sections_list is not None:
        secs = F.filter(secs, lambda s: s["section_name"].isin(list(sections_list)))
    if delete_empty:
        secs = F.filter(secs, lambda s: s["end_section"] != s["start_section"])
    return F.transform(secs, lambda s: text.substr(s["start_section"] + 1, s["end_section"] - s["start_section"]))


def extract(df: DataFrame, text_col: str, titles: Sequence[str], sections_list: Sequence[str] | None = None, delete_empty: bool = True) -> DataFrame:
    """``sections`` and their ``section_texts``; without ``sections_list`` those of all the titles."""
    chosen = titles if sections_list is None else sections_list
    found = with_title_sections(df, text_col, titles)
    return found.withColumn("section_texts", section_texts(F.col(text_col), F.col("sections"), chosen, delete_empty))


def offset_sql(secs: str = "sections") -> dict[str, str]:
    """P17 + P18 as SQL expressions over the section array column ``secs``."""
    out = {}
    for prefix, names in (("subjective", (SUBJECTIVE,)), ("objective", (OBJECTIVE,)),
                          ("assessment", ("assessment",)), ("assessmentplan", ("assessment and plan",)),
                          ("planassessment", ("plan and assessment",))):
        cond = " OR ".join(f"q.section_name = '{n}'" for n in names)
        first = f"get(filter(`{secs}`, q -> {cond}), 0)"
        out[f"{prefix}_start"] = f"{first}.start_section"
        out[f"{prefix}_end"] = f"{first}.end_section"
    for side in ("start", "end"):
        out[f"assessment_{side}"] = (f"coalesce({out[f'assessment_{side}']}, {out[f'assessmentplan_{side}']}, "
                                     f"{out[f'planassessment_{side}']})")
    return out
