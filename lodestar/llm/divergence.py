"""How far the sources of a language differ in their words, by tries of terms that are counted apart and merged.

Each task counts the terms of its documents in one radix trie a language: a leaf holds in how many documents its term stands
and how often each source has it; the root, the empty term, holds the documents themselves. Tries travel as their leaves in
byte order and are merged by range of prefixes. A range is then walked in the order of UTF-8: every term adds to the
differences of all pairs of sources, and the terms that lift a source most are kept, ties in that order.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches, gathered, only, tidy, written

LEAF = "lang string, term binary, docs long, sources array<string>, counts array<long>"
BLOCK = "lang string, leaves array<struct<term: binary, sources: array<string>, counts: array<long>>>"
FOUND = "lang string, source string, part string, item binary, value long"
#: Bytes that end a term become a space, capital letters A-Z small ones; every byte of a longer character stays.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
FOLDED = np.frombuffer(FOLD, np.uint8)
UNIT, ADDED = 1_000_000_000, 5


class Node:
    __slots__ = ("children", "counts", "docs", "label")

    def __init__(self, label: bytes):
        self.label, self.children, self.docs, self.counts = label, {}, 0, None


class Trie:
    """A radix trie over bytes; leaves count documents, and occurrences by source. Leaves that are there already are found by
    their whole key."""

    def __init__(self):
        self.root = Node(b"")
        self.known: dict[bytes, Node] = {}
        self.entries = 0

    def leaf(self, key: bytes) -> Node:
        """The leaf of a key, made where it isn't there yet."""
        found = self.known.get(key)
        if found is None:
            found = self.known[key] = self._made(key)
            if found.counts is None:
                found.counts = {}
        return found

    def _made(self, key: bytes) -> Node:
        """The node at the end of a key; an edge that parts from the key on the way is split."""
        node, at, n = self.root, 0, len(key)
        while at < n:
            below = node.children.get(key[at])
            if below is None:
                below = node.children[key[at]] = Node(key[at:])
                return below
            label = below.label
            if key.startswith(label, at):
                node, at = below, at + len(label)
                continue
            same = 1
            most = min(len(label), n - at)
            while same < most and label[same] == key[at + same]:
                same += 1
            upper = node.children[key[at]] = Node(label[:same])
            below.label = label[same:]
            upper.children[label[same]] = below
            node, at = upper, at + same
        return node

    def add(self, key: bytes, docs: int, counts) -> None:
        """counts: (source, number) pairs, a source once."""
        node = self.leaf(key)
        node.docs += docs
        held = node.counts
        before = len(held)
        if before:
            for source, n in counts:
                held[source] = held.get(source, 0) + n
        else:
            held.update(counts)
        self.entries += len(held) - before

    def leaves(self) -> Iterator[tuple[bytes, Node]]:
        """(key, node) of what has been added, in the order of bytes, which is that of UTF-8."""
        open_ = [(b"", self.root)]
        while open_:
            prefix, node = open_.pop()
            key = prefix + node.label
            if node.counts is not None:
                yield key, node
            open_ += [(key, node.children[b]) for b in sorted(node.children, reverse=True)]


def terms_of(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """(terms, places of their texts) of all texts, in order."""
    joined = np.frombuffer(b" ".join(texts), np.uint8)
    folded = FOLDED[joined]
    inside = folded != 32
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    begins = np.cumsum([0, *[len(t) + 1 for t in texts[:-1]]])
    terms = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(folded[inside]))])
    return terms, np.searchsorted(begins, starts, "right") - 1


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys in order, how often each occurs), by sorting."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.diff(keys, prepend=keys[:1] - 1))
    return keys[first], np.diff(np.append(first, len(keys)))


class Leaves:
    """The terms of a chunk of documents by language: for each (language, term), in order of its code, its documents and, from
    first to first, its entries (source, count)."""

    def __init__(self, lang: np.ndarray, source: np.ndarray, texts: list[bytes]):
        terms, doc = terms_of(texts)
        coded = terms.dictionary_encode()
        self.terms, codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        n, m = max(1, len(self.terms)), int(source.max()) + 1
        once, _ = distinct(doc * n + codes)
        self.leaf, self.docs = distinct(lang[once // n] * n + once % n)
        entries, self.counts = distinct((lang[doc] * n + codes) * m + source[doc])
        self.sources = entries % m
        self.first = np.searchsorted(entries // m, self.leaf)
        self.lang, self.term = self.leaf // n, self.leaf % n


def counted(documents: DataFrame, most: int = 1_000_000, chunk: int = 32 << 20) -> DataFrame:
    """The leaves of the tries of each task, a row a language and term; a trie of over `most` counters leaves its task early.

    Documents are counted in chunks of about so many bytes. Most terms of a corpus stand in one document: such a leaf has one
    counter of one source and no path of its own to share, so it stays a bare key beside the trie.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = only(documents, "text", "lang", "source").select(text("lang"), text("source"), text("text").cast("binary").alias("text"))

    def run(given):
        tries: dict[str, Trie] = defaultdict(Trie)

        def out() -> Iterator[pa.RecordBatch]:
            for lang in sorted(tries):
                yield from leaf_rows(lang, tries[lang].leaves())
            tries.clear()

        for batch in gathered(given, chunk):
            (langs, lang), (sources, source) = (numbered(batch.column(k)) for k in (0, 1))
            groups, n = np.unique(lang * len(sources) + source, return_counts=True)
            for g, k in zip(groups.tolist(), n.tolist(), strict=True):
                tries[langs[g // len(sources)]].add(b"", k, ((sources[g % len(sources)], k),))
            found = Leaves(lang, source, batch.column(2).to_pylist())
            lone = np.flatnonzero(found.docs == 1)
            for at in range(0, len(lone), 16_384):
                some = lone[at : at + 16_384]
                ones = pa.array(np.arange(len(some) + 1, dtype=np.int32))
                of = lambda names, places: pa.array(names, pa.string()).take(pa.array(places))
                entry = found.first[some]
                columns = [of(langs, found.lang[some]), found.terms.take(pa.array(found.term[some])), pa.array(found.docs[some]), pa.ListArray.from_arrays(ones, of(sources, found.sources[entry])), pa.ListArray.from_arrays(ones, pa.array(found.counts[entry]))]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "term", "docs", "sources", "counts"])
            rest = np.flatnonzero(found.docs > 1)
            terms, names, counts = found.terms.take(pa.array(found.term[rest])).to_pylist(), found.sources.tolist(), found.counts.tolist()
            first = np.append(found.first, len(names))
            for term, of_lang, docs, x, y in zip(terms, found.lang[rest].tolist(), found.docs[rest].tolist(), first[rest].tolist(), first[rest + 1].tolist(), strict=True):
                tries[langs[of_lang]].add(term, docs, [(sources[names[k]], counts[k]) for k in range(x, y)])
            if sum(t.entries for t in tries.values()) > most:
                yield from out()
        yield from out()

    return rows.mapInArrow(tidy(run), LEAF)


def numbered(column: pa.Array) -> tuple[list[str], np.ndarray]:
    """(distinct values, the place of each row's value among them)."""
    coded = column.dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def leaf_rows(lang: str, leaves, rows: int = 4096) -> Iterator[pa.RecordBatch]:
    while part := list(itertools.islice(leaves, rows)):
        nodes = [n for _, n in part]
        columns = [pa.array([lang] * len(part)), pa.array([k for k, _ in part], pa.binary()), pa.array([n.docs for n in nodes], pa.int64()), pa.array([list(n.counts) for n in nodes], pa.list_(pa.string())), pa.array([list(n.counts.values()) for n in nodes], pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["lang", "term", "docs", "sources", "counts"])


class Kept:
    """Of leaves in order of (lang, term) those of the root and of terms in `least` documents or more, over all rows of a term.

    A term's rows wait until it has documents enough, so fewer rows than that ever wait; from then on they pass.
    """

    def __init__(self, least: int):
        self.least, self.waiting, self.sure = least, None, None

    def take(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        if self.waiting is not None and len(self.waiting):
            batch = pa.Table.from_batches([self.waiting, batch]).combine_chunks().to_batches()[0]
        n = len(batch)
        lang, term = batch.column(0), batch.column(1)
        same = pc.and_(pc.equal(lang.slice(1), lang.slice(0, n - 1)), pc.equal(term.slice(1), term.slice(0, n - 1))).to_numpy(zero_copy_only=False)
        first = np.flatnonzero(np.concatenate([[True], ~same]))
        total = np.add.reduceat(batch.column(2).to_numpy(), first)
        passes = (total >= self.least) | (pc.binary_length(term.take(pa.array(first))).to_numpy() == 0)
        key = lambda k: (lang[int(k)].as_py(), term[int(k)].as_py())
        passes[0] |= key(0) == self.sure
        self.sure = key(n - 1) if passes[-1] else None
        self.waiting = batch.slice(int(first[-1])) if not passes[-1] else None
        return batch.filter(pa.array(np.repeat(passes, np.diff(np.concatenate([first, [n]])))))


def merged(leaves: DataFrame, least: int = 30, terms: int = 512, most: int = 400_000) -> DataFrame:
    """Blocks of at most `terms` leaves of one language, merged over all tasks: the root, and terms in `least` documents or more.

    Leaves are dealt by range of (lang, term) and come in that order; those of kept terms are put together in a trie, which can
    leave between two keys once it has grown large.
    """

    def run(given):
        trie, lang, last, kept = Trie(), None, None, Kept(least)

        def blocks() -> Iterator[pa.RecordBatch]:
            found = trie.leaves()
            while part := list(itertools.islice(found, terms)):
                held = [{"term": key, "sources": list(n.counts), "counts": list(n.counts.values())} for key, n in part]
                kind = pa.list_(pa.struct([("term", pa.binary()), ("sources", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))]))
                yield pa.RecordBatch.from_arrays([pa.array([lang], pa.string()), pa.array([held], kind)], ["lang", "leaves"])

        for batch in gathered(given):
            for of, term, docs, sources, counts in zip(*[c.to_pylist() for c in kept.take(batch).columns], strict=True) if len(batch) else ():
                if of != lang:
                    if lang is not None:
                        yield from blocks()
                    trie, lang = Trie(), of
                elif trie.entries > most and term != last:
                    yield from blocks()
                    trie = Trie()
                trie.add(term, docs, zip(sources, counts, strict=True))
                last = term
        if lang is not None:
            yield from blocks()

    return leaves.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term").mapInArrow(tidy(run), BLOCK)


def totals(blocks: DataFrame) -> DataFrame:
    """(lang, kept, groups): how many terms a language keeps, and (source, n) of its groups in order, n the occurrences of
    kept terms there."""
    each = blocks.select("lang", F.explode("leaves").alias("x"))
    term = F.length("x.term") > 0
    kept = each.groupBy("lang").agg(F.count_if(term).alias("kept"))
    n = each.select("lang", term.alias("_t"), F.explode(F.arrays_zip("x.sources", "x.counts")).alias("y")).groupBy("lang", F.col("y.sources").alias("source")).agg(F.sum(F.when(F.col("_t"), F.col("y.counts")).otherwise(0)).alias("n"))
    return kept.join(n.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct(F.col("source").cast("binary").alias("source"), "n"))).alias("groups")), "lang")


def shares(counts: np.ndarray, n: np.ndarray, kept: int) -> np.ndarray:
    """1 + floor(UNIT * (count + ADDED) / (n + ADDED * kept)) by long division, three digits at a time: exact in 63 bits while
    the divisor stays below 9 * 10^15."""
    by = n + ADDED * kept
    rest, out = counts + ADDED, np.zeros(counts.shape, np.int64)
    whole, rest = rest // by, rest % by
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // by
        rest = rest % by
    return 1 + whole * UNIT + out


def best_terms(values: np.ndarray, most: int) -> np.ndarray:
    """Places of the `most` largest of values over 0, ties in order of place."""
    at = np.flatnonzero(values > 0)
    return at[np.argsort(-values[at], kind="stable")[:most]]


def measured(blocks: DataFrame, sums: DataFrame, most: int = 50) -> DataFrame:
    """Each task's share of the results: differences of the pairs of sources (once a pair), and its `most` best terms a group.

    The totals of a language come to its blocks by a join. A task holds one square of sources a language, and so does the result.
    """
    state = blocks.join(sums, "lang").select("lang", "kept", "groups", "leaves")

    def run(given):
        square: dict[str, np.ndarray] = {}
        names: dict[str, list[bytes]] = {}
        best: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]] = {}
        for batch in given:
            for lang, kept, groups, leaves in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                of = names.setdefault(lang, [g["source"] for g in groups])
                place = {s: k for k, s in enumerate(of)}
                size = len(of)
                sum_ = square.setdefault(lang, np.zeros((size, size), np.int64))
                leaves = [x for x in leaves if x["term"]]
                if not leaves:
                    continue
                n = np.array([g["n"] for g in groups], np.int64)
                counts = np.zeros((len(leaves), size), np.int64)
                for k, x in enumerate(leaves):
                    counts[k, [place[s.encode()] for s in x["sources"]]] = x["counts"]
                p = shares(counts, n[None, :], kept)
                for a in range(size):
                    sum_[a, a + 1 :] += np.abs(p[:, a + 1 :] - p[:, a : a + 1]).sum(0)
                above = np.where(counts > 0, p - shares(counts.sum(1), n.sum(), kept)[:, None], 0)
                terms = np.array([x["term"] for x in leaves], object)
                for a in range(size):
                    at = best_terms(above[:, a], most)
                    if len(at):
                        v, t = above[at, a], terms[at]
                        if (lang, a) in best:  # blocks come in no given order
                            v, t = np.concatenate([best[lang, a][0], v]), np.concatenate([best[lang, a][1], t])
                            o = sorted(range(len(v)), key=lambda k: (-v[k], t[k]))[:most]
                            v, t = v[o], t[o]
                        best[lang, a] = v, t
        for lang, of in names.items():
            for a, source in enumerate(of):
                v, t = best.get((lang, a), (np.zeros(0, np.int64), np.zeros(0, object)))
                value, item = np.concatenate([square[lang][a, a + 1 :], v]), [*of[a + 1 :], *t]
                if item:
                    part = ["pair"] * (len(of) - a - 1) + ["term"] * len(t)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(item)), pa.array([source.decode()] * len(item)), pa.array(part), pa.array(item, pa.binary()), pa.array(value)], ["lang", "source", "part", "item", "value"])

    return state.mapInArrow(tidy(run), FOUND)


def audit(documents: DataFrame, least: int = 30, most: int = 50) -> DataFrame:
    """(lang, source, part, item, value, rank): by group of documents (text, lang, source) the other sources of its language by
    how far they differ ('pair'), and its terms of the largest lift over the language ('term', `most` at most).

    Null texts, languages and sources are empty ones; each row is a document, repeated ones too; a group without terms has its
    pairs; a language without kept terms has differences of 0; equal values go by the bytes of the item; other columns are
    ignored; an empty table gives no rows.
    """
    leaves = written(counted(documents), "tries")
    batches(documents.sparkSession, 16_384)  # leaves are short
    blocks = written(merged(leaves, least), "merged-tries")
    batches(documents.sparkSession)
    found = written(measured(blocks, totals(blocks), most), "differences")
    pairs = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    turned = pairs.select("lang", F.col("item").cast("string").alias("source"), "part", F.col("source").cast("binary").alias("item"), "value")
    every = pairs.unionByName(turned).unionByName(found.where("part = 'term'"))
    by = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = every.withColumn("rank", F.row_number().over(by)).where((F.col("part") == "pair") | (F.col("rank") <= most))
    return ranked.select("lang", "source", "part", F.col("item").cast("string").alias("item"), "value", "rank")


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term FROM w GROUP BY ALL HAVING count(DISTINCT id) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY ALL),
grid AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY ALL),
p AS (SELECT lang, source, term, n, 1 + (CAST(1000000000 AS HUGEINT) * (n + 5)) // CAST(sum(n) OVER (PARTITION BY lang, source) + 5 * v AS HUGEINT) AS p FROM grid JOIN v USING (lang)),
t AS (SELECT lang, term, sum(n) AS n FROM grid GROUP BY ALL),
q AS (SELECT lang, term, 1 + (CAST(1000000000 AS HUGEINT) * CAST(n + 5 AS HUGEINT)) // CAST(sum(n) OVER (PARTITION BY lang) + 5 * v AS HUGEINT) AS q FROM t JOIN v USING (lang)),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
terms AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, p.p - q.q AS value FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE p.n > 0 AND p.p > q.q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM r WHERE part = 'pair' OR rank <= 50
"""
