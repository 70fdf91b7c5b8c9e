"""Markdown documents to bounded chunks, one row-local expression per document.

No document leaves its row and no row meets another, so chunking adds no shuffle; whole
texts are processed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_CHUNK_CHARS = 1800

_SPACE = r"[\\s\\x1c-\\x1f]"
_LINE_END = r"\\r\\n|[\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]"


def _strip(c: str) -> str:
    return f"regexp_replace({c}, '(?U)^{_SPACE}+|{_SPACE}+$', '')"


_BLOCKS = rf"""split(concat('\n', regexp_replace(regexp_replace(text, '{_LINE_END}', '\n'), '\\n\\z', '')),
  '\\n(?=#{{1,3}} )')"""

# A block opens with its heading line, except the first, which holds what precedes any heading.
_SECTIONS = rf"""filter(transform(blocks, (b, i) -> if(i = 0,
  if(b = '' or text = '', null, named_struct('title', 'Introduction', 'body', substring(b, 2))),
  if(instr(b, '\n') = 0, null, named_struct(
    'title', {_strip("regexp_replace(substring_index(b, '\\n', 1), '^[# ]+', '')")},
    'body', substring(b, instr(b, '\n') + 1))))), s -> s is not null)"""

_SLUG = (
    "substring(regexp_replace(regexp_replace(lower(s.title), '[^a-z0-9]+', '-'), '^-+|-+$', ''), 1, 80)"
)
_FRAGMENTS = rf"""flatten(transform(filter(transform(split(s.body, '(?U)\\n{_SPACE}*\\n'),
  p -> {_strip("p")}), p -> p <> ''),
  p -> regexp_extract_all(p, '(?s).{{1,{MAX_CHUNK_CHARS}}}', 0)))"""
_PIECES = rf"""aggregate({_FRAGMENTS},
  named_struct('done', cast(array() as array<string>), 'open', ''),
  (acc, f) -> if(acc.open = '', named_struct('done', acc.done, 'open', f),
    if(length(acc.open) + length(f) + 2 > {MAX_CHUNK_CHARS},
      named_struct('done', concat(acc.done, array(acc.open)), 'open', f),
      named_struct('done', acc.done, 'open', {_strip("concat(acc.open, '\\n\\n', f)")}))),
  acc -> if(acc.open = '', acc.done, concat(acc.done, array(acc.open))))"""


def chunk_documents(documents: DataFrame) -> DataFrame:
    """(document_id, text) -> chunks split at headings, packed by paragraph.

    Chunk ids name document, section and ordinal, so edits elsewhere keep them.
    """
    sections = (
        documents.select("document_id", "text")
        .selectExpr("document_id", "text", f"{_BLOCKS} as blocks")
        .selectExpr("document_id", f"{_SECTIONS} as sections")
        .selectExpr(
            "document_id",
            f"transform(sections, s -> named_struct('title', s.title, 'slug', "
            f"if({_SLUG} = '', 'section', {_SLUG}), 'pieces', {_PIECES})) as sections",
        )
        .selectExpr(
            "document_id",
            "explode(transform(sections, (s, i) -> named_struct('title', s.title, 'pieces', s.pieces, "
            "'section_id', concat(s.slug, '-', "
            "size(filter(slice(sections, 1, i + 1), e -> e.slug = s.slug)))))) as s",
        )
    )
    return sections.selectExpr(
        "document_id",
        "s.section_id",
        "s.title as section_title",
        "posexplode(s.pieces) as (ordinal, chunk_text)",
    ).select(
        F.concat_ws(":", "document_id", "section_id", "ordinal").alias("chunk_id"),
        "document_id",
        "section_id",
        "section_title",
        "ordinal",
        "chunk_text",
        F.sha2("chunk_text", 256).alias("content_sha256"),
    )
