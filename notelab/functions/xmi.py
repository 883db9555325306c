"""Attribute extraction from stand-off annotation fragments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import D, W


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def fragments(content) -> Column:
    """The document line split at ``><``."""
    return F.split(_c(content), "><")


def tag_fragments(content) -> Column:
    """P6 + F1: only fragments that mention ``semanticTag``."""
    return F.filter(fragments(content), lambda f: F.contains(f, F.lit("semanticTag")))


def _first(frag, pattern: str) -> Column:
    return F.get(F.regexp_extract_all(_c(frag), F.lit(pattern), 0), 0)


def xmi_id(frag) -> Column:
    return _first(frag, r'(?<=xmi:id=")' + D + r'+(?=")')


def begin(frag) -> Column:
    return _first(frag, r'(?<=begin=")' + D + r'+(?=")')


def end(frag) -> Column:
    return _first(frag, r'(?<=end=")' + D + r'+(?=")')


def semantic_tag(frag) -> Column:
    return _first(frag, r'(?<=semanticTag=")' + W + r'*(?=")')


def doc_tags_sql(content: str = "content") -> str:
    """A1 / O2: sorted distinct tags of one document (NULL tags left out), as SQL."""
    tag = f"get(regexp_extract_all(f, r'(?<=semanticTag=\"){W}*(?=\")', 0), 0)"
    return (f"array_sort(array_distinct(filter(transform(filter(split({content}, '><'), "
            f"f -> contains(f, 'semanticTag')), f -> {tag}), t -> t IS NOT NULL)))")
