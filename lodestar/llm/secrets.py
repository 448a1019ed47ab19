"""Secret scans: fixed patterns, and random strings exposed by how few characters a token of them holds.

Ordinary words fit a byte-pair vocabulary, so a token holds several characters; random strings break into tokens of one
or two. A run of key characters with a low ratio is a secret unless it is a known digest, a UUID, a number or an
identifier whose parts, in lower case, are words by the same ratio.
"""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import batches as batches_
from .common import only, tidy

# The base patterns and the lengths that a match must have.
ASSIGN = re.compile(r"((?ai:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
KEYWORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
KINDS = ("assign", "access", "hex", "random")

RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
DIGEST = re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)")
DIGEST_LENGTHS = frozenset({32, 40, 48, 56, 64, 96, 128})
UUID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
NUMBERED = re.compile(r"[A-Za-z]{1,8}[-_/=]?[0-9]+(?:[-_/][0-9]+)*(?:[-_/]?[A-Za-z])?")
LONE = re.compile(r"(?<![a-z])[a-z](?![a-z])|(?<![A-Z])[A-Z](?![A-Za-z])")
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
SHORT = 2  #: letters of a part that says nothing, as in v2, x86 or to
WORDS = 0.5  #: the share of letters and digits that longer parts of an identifier make up at least
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long"


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


_encodings: dict[str, object] = {}


def _encoding(path: str):
    if path not in _encodings:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[path] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind as its place in KINDS, end) of the fixed patterns."""
    found, low = [], text.lower()
    if any(k in low for k in KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def known(run: str) -> bool:
    """A digest of a usual length, a UUID, a number, or a number behind a short name, as of books, papers and standards."""
    return bool((len(run) in DIGEST_LENGTHS and DIGEST.fullmatch(run)) or UUID.fullmatch(run) or not re.search("[A-Za-z]", run) or NUMBERED.fullmatch(run))


def identifier(run: str) -> bool:
    """Whether run is words, capitalised or not, capitals and numbers: no letter of it stands alone. Linear in its length."""
    return not LONE.search(run) and any(map(str.isalnum, run))


def word_parts(run: str) -> Iterator[list[str]]:
    """The letters by which run can be told an identifier: all its parts where no letter stands alone, and the parts of more
    than SHORT letters where they make up the share WORDS of it. Linear in its length."""
    parts = PART.findall(run)
    if identifier(run):
        yield parts
    long_ = [p for p in parts if len(p) > SHORT]
    if sum(map(len, long_)) >= WORDS * sum(map(str.isalnum, run)):
        yield long_


def random(run: str, ranks: str, ratio: float) -> bool:
    """Whether run has fewer characters a token than ratio, and so have the parts of an identifier.

    Capitals and separators break common words into more tokens, so the letters of an identifier count once more by part.
    """
    tokens = lambda x: len(_encoding(ranks).encode_ordinary(x))
    words = lambda parts: bool(parts) and sum(map(len, parts)) >= ratio * sum(tokens(p.lower()) for p in parts)
    return len(run) < ratio * tokens(run) and not any(map(words, word_parts(run)))


def all_spans(text: str, ranks: str, ratio: float) -> tuple[list, list]:
    base = base_spans(text)
    starts, reach = [s for s, _, _ in base], list(accumulate((e for _, _, e in base), max))
    more = []
    for m in RUN.finditer(text):
        s, e = m.span()
        before = bisect_right(starts, s)
        if known(m[0]) or (before and reach[before - 1] >= e):  # within a base span
            continue
        if random(m[0], ranks, ratio):
            more.append((s, 3, e))
    return base, sorted(base + more)


def listed(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def redacted(text: str, spans: list, mark: str = "[SECRET]") -> str:
    """text with each span, or run of overlapping spans, replaced."""
    out, at = [], 0
    for s, _, e in spans:
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, ranks: str | None = None, ratio: float = 2.5) -> DataFrame:
    """Counts and spans of secrets in every whole text of (doc_id, text).

    ratio: a run with fewer characters a token than this is random. A null text is empty: zero counts and no spans.
    Spans of unlike kinds may overlap and are all listed; of spans with one start the kind listed first comes first. Texts
    and runs of any length take linear time. Rows stay as they are, repeated ones and null doc_ids too; other columns are
    ignored; an empty table gives no rows.
    """
    ranks = ranks or default_ranks()

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), 512):
                part, rows = batch.slice(at, 512), []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    base, every = all_spans(text or "", ranks, ratio)
                    n = [sum(k == x for _, k, _ in every) for x in range(4)]
                    rows.append((doc, *n[:3], hashlib.sha256(listed(base).encode()).hexdigest(), listed(every), n[3]))
                cols, kinds = zip(*rows, strict=True), [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
                names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    return only(docs, "doc_id", "text").selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(tidy(run), SCHEMA)


def redact(docs: DataFrame, ranks: str | None = None, ratio: float = 2.5) -> DataFrame:
    """docs with every secret in text replaced by a mark, and n_chars, where there is one, made anew.

    Null texts stay null, empty ones empty; overlapping spans share one mark; repeated rows and null doc_ids stay; an empty
    table gives no rows.
    """
    ranks, schema = ranks or default_ranks(), docs.schema

    def run(batches):
        for batch in batches:
            texts = [t if t is None or not (s := all_spans(t, ranks, ratio)[1]) else redacted(t, s) for t in batch.column("text").to_pylist()]
            batch = batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))
            if "n_chars" in batch.schema.names:
                at = batch.schema.get_field_index("n_chars")
                batch = batch.set_column(at, "n_chars", pa.array([None if t is None else len(t) for t in texts], batch.schema.field(at).type))
            yield batch

    batches_(docs.sparkSession)
    return docs.mapInArrow(tidy(run), schema)
