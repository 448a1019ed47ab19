"""URLs, and JSON inside other text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def resolve_url(url: Column) -> Column:
    """The PDF behind an arXiv abstract or HTML page, a PDF's own URL, else null."""
    u = F.trim(url)
    host, path = F.lower(F.try_parse_url(u, F.lit("HOST"))), F.btrim(F.try_parse_url(u, F.lit("PATH")), F.lit("/"))
    paper = F.btrim(F.regexp_extract(path, "^(?:abs|html)/(.+)$", 1), F.lit("/"))
    return F.when((host == "arxiv.org") | F.endswith(host, F.lit(".arxiv.org")), F.when(paper != "", F.concat(F.lit("https://arxiv.org/pdf/"), paper, F.lit(".pdf"))).when(F.endswith(F.lower(path), F.lit(".pdf")), url)).when(
        host.isNotNull() & F.endswith(F.lower(F.try_parse_url(u, F.lit("PATH"))), F.lit(".pdf")), url
    )


def is_pdf(url: Column, content_type: Column, head: Column) -> Column:
    """Whether a download counts as a PDF: by its URL, its type or its first bytes."""
    return F.coalesce(F.endswith(F.lower(F.regexp_replace(url, r"[?#].*$", "")), F.lit(".pdf")), F.lit(False)) | F.coalesce(F.contains(F.lower(content_type), F.lit("pdf")), F.lit(False)) | F.coalesce(F.startswith(head, F.lit("%PDF")), F.lit(False))


def salvaged_json(x: Column) -> Column:
    """The JSON object in a text: all of it, or from the first brace to the last; null if neither parses."""
    inner = F.regexp_extract(x, r"(?s)(\{.*\})", 1)
    ok = lambda s: F.when(F.try_parse_json(s).isNotNull(), s)
    return F.coalesce(ok(F.trim(x)), ok(F.nullif(inner, F.lit(""))))
