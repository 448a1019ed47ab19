"""Toxicity by class-conditional Kneser-Ney models of words as character sequences.

One model of toxic and one of ordinary texts give each character of a word its probability after the seven before it. The
full-length counts are the class's own; all shorter ones are continuation counts shared by both classes and gathered from
the words of all documents, so a rare expression says the same in either, while forms of one stem support each other. Every
labelled row that isn't held out counts, and every context of either class.

Grams lie in tasks by TAIL characters before their last one, so the counts after all longer contexts of a gram are in its
task; the probabilities of the shorter ones come from a table. Words get the sums of their grams by a join, documents those of
their words; only a bounded number of the most frequent grams and words is broadcast instead.

Two values compare a document's log-likelihoods: their difference over the number of its words; and, as the noise of n
ordinary words adds up to about the square root of n, what its words' differences have beyond FLOOR, over that root. A
logistic curve turns both into a score; the curve is fitted on labelled rows that the models haven't counted.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches as batches_
from .common import dropped, gathered, only, tidied, tidy, written

WORD = re.compile(r"[^\W_]+")
ORDER = 8
FLOOR = 4.0
TAIL = 3
FREQUENT = 200_000  # grams, and words, whose differences are broadcast
START, END = 1, 2
CHUNK = 1 << 20  # characters worked on at once
CHARACTER = np.uint64(0xFFFF)  # the part of a key that is the character itself; the rest is a hash of those before it
_CONTEXT = ~CHARACTER
_POWERS = [np.uint64(pow(0x9E3779B97F4A7C15, j, 1 << 64)) for j in range(ORDER)]


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


class Grams:
    """The characters of words, with ORDER - 1 starts before each and an end after it, and keys of the characters up to any.

    Keys are a 48-bit hash of the characters before and the character's 16 bits (of one beyond them, its lower ones).
    """

    def __init__(self, words: list[str]):
        pad = chr(START) * (ORDER - 1)
        joined = (pad + (chr(END) + pad).join(words) + chr(END)) if words else ""
        self.c = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint16).astype(np.uint64)
        self.first = np.cumsum([0, *(len(w) + ORDER for w in words)])  # where each word's starts begin

    def chunks(self) -> Iterator[np.ndarray]:
        """Places of all characters but starts, a bounded number at once, whatever the words' lengths."""
        for a in range(0, len(self.c), CHUNK):
            yield np.flatnonzero(self.c[a : a + CHUNK] != START) + a

    def word(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, at, "right") - 1

    def key(self, at: np.ndarray) -> np.ndarray:
        """Keys of ORDER characters at places that follow each other closely (those of a chunk)."""
        if not len(at):
            return np.zeros(0, np.uint64)
        low, high = int(at[0]), int(at[-1]) + 1
        before = self.c[low - 1 : high - 1] * _POWERS[1]
        for j in range(2, ORDER):
            before += self.c[low - j : high - j] * _POWERS[j]
        return ((before & _CONTEXT) | self.c[low:high])[at - low]

    def whole(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ORDER characters up to any places, the last four in one number, those before them in another."""
        four = lambda at: self.c[at - 3] << np.uint64(48) | self.c[at - 2] << np.uint64(32) | self.c[at - 1] << np.uint64(16) | self.c[at]
        return four(at - 4), four(at)

    def keys(self, at: np.ndarray) -> Iterator[np.ndarray]:
        """Keys of 1 to ORDER characters at any places, one level at a time."""
        now, before = self.c[at], np.zeros(len(at), np.uint64)
        yield now
        for j in range(1, ORDER):
            before += self.c[at - j] * _POWERS[j]
            yield (before & _CONTEXT) | now


def _level(keys: np.ndarray, n: np.ndarray, discount: float):
    """Sorted keys with their discounted shares of their contexts, sorted contexts with the mass left over."""
    heads, at = np.unique(keys & _CONTEXT, return_inverse=True)
    total = np.bincount(at, n)
    share = np.maximum(n - discount, 0) / total[at]
    return keys, share.astype(np.float32), heads, np.maximum(1 - np.bincount(at, share), 1e-9).astype(np.float32)


def _at(sorted_: np.ndarray, values: np.ndarray, wanted: np.ndarray, absent: float) -> np.ndarray:
    if not len(sorted_):
        return np.full(len(wanted), absent)
    k = np.minimum(np.searchsorted(sorted_, wanted), len(sorted_) - 1)
    return np.where(sorted_[k] == wanted, values[k], absent)


def _among(sorted_: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    return _at(sorted_, np.ones(len(sorted_), bool), wanted, False).astype(bool)


class Model:
    """The models in one process, after the contexts of toxic texts only; Fitted has them after all, in tables.

    levels[k - 1]: the keys of k characters and their counts; the last level has the counts of each class."""

    def __init__(self, levels: list[tuple], discount: float):
        *lower, (keys, n0, n1) = levels
        self.lower = [_level(k, n.astype(float), discount) for k, n in lower]
        self.top = [_level(keys[n > 0], n[n > 0].astype(float), discount) for n in (n0, n1)]
        self.slope, self.shift = np.ones(2), 0.0
        self.cache: dict[str, float] = {}
        self.held = 0  # bytes of the cache, about
        heads = self.top[1][2]
        self.marks = np.zeros(1 << 22, bool)  # by the first bits of a context, so that most others are passed over at once
        self.marks[heads >> np.uint64(42)] = True

    def __getstate__(self):
        return self.__dict__ | {"cache": {}, "held": 0}

    def differences(self, words: list[str]) -> np.ndarray:
        """By word: its log-likelihood as toxic less that as ordinary."""
        out, made = np.zeros(len(words)), Grams(words)
        for at in made.chunks():
            key = made.key(at)
            some = self.marks[key >> np.uint64(42)]  # elsewhere the classes say the same
            at, key = at[some], key[some]
            some = _among(self.top[1][2], key & _CONTEXT)
            at, key = at[some], key[some]
            if not len(at):
                continue
            key, first, back = np.unique(key, return_index=True, return_inverse=True)
            levels, p = made.keys(at[first]), np.full(len(key), 1 / 65536)
            for (g, share, heads, rest), k in zip(self.lower, levels):
                p = _at(g, share, k, 0.0) + _at(heads, rest, k & _CONTEXT, 1.0) * p
            d = np.zeros(len(key))
            for sign, (g, share, heads, rest) in zip((-1, 1), self.top, strict=True):
                d += sign * np.log(_at(g, share, key, 0.0) + _at(heads, rest, key & _CONTEXT, 1.0) * p)
            word = made.word(at)
            sums = np.bincount(word - word[0], d[back])
            out[word[0] : word[0] + len(sums)] += sums
        return out

    def raws(self, texts: list[str | None], limit: int = 48 << 20) -> np.ndarray:
        """The two values of each text; zeros without words. limit: bytes of words whose values are kept for later texts."""
        if self.held > limit:
            self.cache.clear()
            self.held = 0
        split, out = [words_of(t) for t in texts], np.zeros((len(texts), 2))
        new = list(set().union(*split).difference(self.cache))
        known = self.cache
        if new:
            values = self.differences(new)
            size = sum(map(len, new)) * 2 + 120 * len(new)
            if self.held + size > 2 * limit:  # too many or too long to keep
                known = dict(zip(new, values.tolist(), strict=True)) | {w: known[w] for ws in split for w in ws if w in known}
            else:
                known.update(zip(new, values.tolist(), strict=True))
                self.held += size
        get = known.__getitem__
        for k, ws in enumerate(split):
            if ws:
                d = np.fromiter(map(get, ws), float, len(ws))
                out[k] = d.mean(), np.maximum(d - FLOOR, 0).sum() / np.sqrt(len(ws))
        return out

    def scores(self, texts: list[str | None]) -> list[float]:
        z = np.clip(self.raws(texts) @ self.slope + self.shift, -500, 500)
        return (1 / (1 + np.exp(-z))).tolist()


def held_out(doc_id) -> F.Column:
    """The rows that no label is learnt from; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def chosen_labels(labels: DataFrame) -> DataFrame:
    """doc_id, toxic, part (0 to 9, by a hash) of all labelled rows but those held out."""
    marked = only(labels, "doc_id", "toxic").where("toxic in (0, 1) and doc_id is not null").where(~held_out(F.col("doc_id")))
    marked = marked.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    return marked.withColumn("part", (F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) % 10).cast("int"))


def word_counts(texts: DataFrame, most_words: int = 250_000, most_bytes: int = 16 << 20) -> DataFrame:
    """word, n0, n1, n over all of `texts` (text, toxic): every word of any text, with its counts in texts of either class and in all.

    A task holds about `most_words` words or `most_bytes` of long ones, and one text, before it passes them on.
    """

    def count(batches):
        kinds, every = (Counter(), Counter()), Counter()

        def out():
            words = list(every)
            for at in range(0, len(words), 20_000):
                part = words[at : at + 20_000]
                cols = [pa.array(part, pa.string()), *[pa.array([k.get(w, 0) for w in part], pa.int64()) for k in (*kinds, every)]]
                yield pa.RecordBatch.from_arrays(cols, ["word", "n0", "n1", "n"])
            for c in (*kinds, every):
                c.clear()

        size = 0
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(text)
                every.update(words)
                if toxic is not None:
                    kinds[toxic].update(words)
                size += len(text) if text and len(text) > 64 * len(words) else 0  # long words; usual ones are counted by number
                if size > most_bytes or len(every) > most_words:
                    yield from out()
                    size = 0
        yield from out()

    made = texts.mapInArrow(tidy(count), "word string, n0 long, n1 long, n long")
    return made.groupBy("word").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("n").alias("n"))


def contexts(words: list[str]) -> list[np.ndarray]:
    """By number of characters of a gram: the sorted contexts of all grams of words."""
    found: list = [np.zeros(0, np.uint64)] * ORDER
    made = Grams(words)
    for at in made.chunks():
        found = [np.union1d(f, k & _CONTEXT) for f, k in zip(found, made.keys(at), strict=True)]
    return found


def gram_counts(words: DataFrame, needed: list[np.ndarray]) -> DataFrame:
    """k, key, n, n0, n1 of the grams of words (word, n0, n1) whose context is needed: for k below ORDER, n is how many
    longer grams end in this one; for ORDER, n0 and n1 are how often each class holds it (those of neither are left out)."""
    shared = words.sparkSession.sparkContext.broadcast(needed)
    names = ["k", "key", "longer", "n0", "n1"]

    def rows(k, key, longer, n0, n1):
        cols = [pa.array(np.full(len(key), k, np.int32)), *[pa.array(x.view(np.int64)) for x in (key, longer)], pa.array(n0), pa.array(n1)]
        return pa.RecordBatch.from_arrays(cols, names)

    def count(batches):
        heads = shared.value
        for batch in gathered(batches):
            n, made = [batch.column(k).to_numpy() for k in (1, 2)], Grams(batch.column(0).to_pylist())
            for at in made.chunks():
                longer, first, back = np.unique(made.key(at), return_index=True, return_inverse=True)
                word = made.word(at)
                sums = [np.bincount(back, x[word], len(longer)).astype(np.int64) for x in n]
                some = _among(heads[-1], longer & _CONTEXT) & (sums[0] + sums[1] > 0)
                if some.any():
                    yield rows(ORDER, longer[some], longer[some], sums[0][some], sums[1][some])
                at = at[first]  # a place of each distinct gram; the distinct shorter ones are among their ends
                levels = list(made.keys(at))
                at = np.arange(len(at))
                for k in range(ORDER - 1, 0, -1):
                    key = levels[k - 1][at]
                    some = _among(heads[k - 1], key & _CONTEXT)
                    if some.any():
                        zero = np.zeros(int(some.sum()), np.int64)
                        yield rows(k, key[some], levels[k][at][some], zero, zero)
                    at = at[np.unique(key, return_index=True)[1]]

    made = words.mapInArrow(tidy(count), "k int, key long, longer long, n0 long, n1 long")
    grams_ = made.groupBy("k", "key", "longer").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    return grams_.groupBy("k", "key").agg(F.count(F.lit(1)).alias("n"), F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def model_of(counts: pa.Table, discount: float) -> Model:
    k, key = counts["k"].to_numpy(), counts["key"].to_numpy().view(np.uint64)
    levels: list = []
    for size in range(1, ORDER + 1):
        at = np.flatnonzero(k == size)
        at = at[np.argsort(key[at])]
        levels.append((key[at], *[counts[c].to_numpy()[at] for c in (["n"] if size < ORDER else ["n0", "n1"])]))
    return Model(levels, discount)


def _counted(at: np.ndarray, n: np.ndarray, head: np.ndarray, discount: float) -> tuple[np.ndarray, np.ndarray]:
    """Of grams with counts n and contexts `head`, of which `at` has a row each: discounted shares of contexts, and by context
    the mass left over; all of it after contexts that nothing is counted after."""
    total = np.bincount(head[at], n, head.max() + 1)
    share = np.maximum(n - discount, 0) / np.maximum(total, 1)[head[at]]
    return share, np.where(total > 0, np.maximum(1 - np.bincount(head[at], share, len(total)), 1e-9), 1.0)


def _differences(hi: np.ndarray, lo: np.ndarray, n: list[np.ndarray], counted: np.ndarray, p: np.ndarray, discount: float) -> np.ndarray:
    """By distinct gram its log-likelihood after its context as toxic less that as ordinary. All grams of a tail are there; n:
    counts by class; counted: whether any word of the documents holds it; p: the probability after TAIL - 1 characters."""
    char = lambda j: (lo >> np.uint64(16 * j) if j < 4 else hi >> np.uint64(16 * (j - 4))) & CHARACTER
    ids = lambda keys: np.unique(keys, return_index=True, return_inverse=True)[1:]
    first, gram = ids(lo)
    head = ids(lo >> np.uint64(16))[1]
    for k in range(TAIL + 1, ORDER):
        after, longer = ids(gram.astype(np.uint64) << np.uint64(16) | char(k))
        some = np.bincount(longer, counted)[longer[after]] > 0
        share, rest = _counted(first, np.bincount(gram[after], some, len(first)), head, discount)
        p = share[gram] + rest[head] * p
        head = ids(head.astype(np.uint64) << np.uint64(16) | char(k))[1]
        first, gram = after, longer
    every, q = np.arange(len(lo)), []
    for c in n:
        share, rest = _counted(every, c.astype(float), head, discount)
        q.append(share + rest[head] * p)
    return np.log(q[1]) - np.log(q[0])


def _whole(batches, most: int = 1_000_000):
    """Tables of about `most` rows with all rows of their tails, from batches in order of tails."""
    held, n, wanted = [], 0, most
    for b in batches:
        held.append(b)
        n += len(b)
        if n >= wanted:
            t = pa.Table.from_batches(held).combine_chunks()
            tail = t["tail"].to_numpy()
            cut = int(np.searchsorted(tail, tail[-1]))
            if cut:
                yield t.slice(0, cut)
            held, n = t.slice(cut).to_batches(), len(t) - cut
            wanted = max(most, 2 * n)
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def _once(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """An order of rows by their keys, the last one first, and where in it each distinct row begins."""
    order = np.lexsort(keys)
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.any([k[order[1:]] != k[order[:-1]] for k in keys], 0)
    return order, np.flatnonzero(new)


def _numbers(batch, *names: str) -> list[np.ndarray]:
    return [batch[c].to_numpy(zero_copy_only=False) if isinstance(batch, pa.RecordBatch) else batch[c].to_numpy() for c in names]


def short_ones(words: DataFrame, discount: float) -> DataFrame:
    """lo, p: the distinct last TAIL + 1 characters of grams of words (word, counted), and the probability of the last one after
    TAIL - 1 before it."""

    def ends(batches):
        for batch in gathered(batches):
            counted, made = _numbers(batch, "counted")[0], Grams(batch["word"].to_pylist())
            for at in made.chunks():
                lo = made.whole(at)[1]
                order, first = _once([lo])
                if len(order):
                    some = np.maximum.reduceat(counted[made.word(at)][order], first)
                    yield pa.RecordBatch.from_arrays([pa.array(lo[order[first]].view(np.int64)), pa.array(some.astype(np.int64))], ["lo", "n"])

    every = written(words.select("word", "counted").mapInArrow(tidy(ends), "lo long, n long").groupBy("lo").agg(F.max("n").alias("n")), "ends")
    end = lambda c, k: F.col(c).bitwiseAND(F.lit((1 << 16 * k) - 1))
    levels, last = [], every
    for k in range(TAIL, 0, -1):
        last = last.groupBy(end("lo", k).alias("lo")).agg(F.count_if(F.col("n") > 0).alias("n"))
        levels.append((k, last))
    known = None
    for k, rows in reversed(levels):
        left = F.greatest(F.col("n") - discount, F.lit(0.0))
        rows = rows.withColumn("head", F.shiftrightunsigned("lo", 16))
        heads = rows.groupBy("head").agg(F.sum("n").alias("_t"), F.sum(left).alias("_s"))
        rows = rows.join(heads, "head").withColumn("_z", end("lo", k - 1)) if k > 1 else rows.join(heads, "head")
        below = F.lit(1 / 65536)
        if known is not None:
            rows, below = rows.join(known.withColumnRenamed("lo", "_z"), "_z"), F.col("p")
        mixed = F.when(F.col("_t") > 0, left / F.col("_t") + F.greatest(1 - F.col("_s") / F.col("_t"), F.lit(1e-9)) * below).otherwise(below)
        known = rows.select("lo", mixed.alias("p"))
    return every.withColumn("_z", end("lo", TAIL)).join(known.withColumnRenamed("lo", "_z"), "_z").select("lo", "p")


def gram_differences(words: DataFrame, discount: float) -> DataFrame:
    """hi, lo, d, n of the distinct grams of words (word, n0, n1, counted): the difference, where the classes say different things,
    and how many words hold it, about."""

    def grams(batches):
        for batch in gathered(batches):
            (n0, n1, counted), made = _numbers(batch, "n0", "n1", "counted"), Grams(batch["word"].to_pylist())
            for at in made.chunks():
                (hi, lo), word = made.whole(at), made.word(at)
                order, first = _once([lo, hi])
                if len(order):
                    word = word[order]
                    sums = [np.add.reduceat(x[word].astype(np.int64), first) for x in (n0, n1, counted)]
                    held = np.diff(np.append(first, len(order)))
                    keys = [pa.array(x[order[first]].view(np.int64)) for x in (hi, lo)]
                    yield pa.RecordBatch.from_arrays([*keys, *map(pa.array, sums), pa.array(held)], ["hi", "lo", "n0", "n1", "counted", "n"])

    def compared(batches):
        for t in _whole(batches):
            ends = t.filter(t["p"].is_valid())
            lo, p = _numbers(ends, "lo", "p")
            lo = lo.view(np.uint64)
            order = np.argsort(lo)
            lo, p = lo[order], p[order]
            t = t.filter(t["p"].is_null())
            if not len(t):
                continue
            hi_, lo_ = (x.view(np.uint64) for x in _numbers(t, "hi", "lo"))
            order, first = _once([lo_, hi_])
            hi_, lo_ = hi_[order[first]], lo_[order[first]]
            n0, n1, counted, n = (np.add.reduceat(x[order], first) for x in _numbers(t, "n0", "n1", "counted", "n"))
            d = _differences(hi_, lo_, [n0, n1], counted, p[np.searchsorted(lo, lo_)], discount)
            some = np.flatnonzero(d)
            yield pa.RecordBatch.from_arrays([*[pa.array(x[some].view(np.int64)) for x in (hi_, lo_)], pa.array(d[some]), pa.array(n[some])], ["hi", "lo", "d", "n"])

    kinds = "hi long, lo long, n0 long, n1 long, counted long, n long"
    made = words.select("word", "n0", "n1", "counted").mapInArrow(tidy(grams), kinds).withColumn("p", F.lit(None).cast("double"))
    ends = short_ones(words, discount).select(F.lit(0).cast("long").alias("hi"), "lo", *[F.lit(0).cast("long").alias(c) for c in ("n0", "n1", "counted", "n")], "p")
    batches_(words.sparkSession, 20_000)
    rows = made.unionByName(ends).withColumn("tail", F.shiftrightunsigned("lo", 16))
    return written(rows.repartition("tail").sortWithinPartitions("tail").mapInArrow(tidy(compared), "hi long, lo long, d double, n long"), "grams")


def word_differences(words: DataFrame, grams: DataFrame) -> DataFrame:
    """word, d of words (id, word), by the differences of grams, as a written table."""
    most = grams.orderBy(F.desc("n"), "hi", "lo").limit(FREQUENT).select("hi", "lo", "d").toArrow()
    hi, lo, d = (_numbers(most, c)[0] for c in ("hi", "lo", "d"))
    code = lambda hi, lo: (hi.view(np.uint64) * _POWERS[1]) ^ lo.view(np.uint64)  # noqa: E731  # a row may share it, so both are compared
    key = code(hi, lo)
    _, once = np.unique(key, return_index=True)
    shared = words.sparkSession.sparkContext.broadcast((key[once], hi[once], lo[once], d[once]))

    def spread(batches):
        key, hi, lo, d = shared.value
        for batch in gathered(batches):
            ids, text = batch["id"].to_numpy(), batch["word"]
            made, sums = Grams(text.to_pylist()), np.zeros(len(ids))
            for at in made.chunks():
                if not len(at):
                    continue
                (h, l), word = (x.view(np.int64) for x in made.whole(at)), made.word(at)
                if len(key):
                    k = np.minimum(np.searchsorted(key, code(h, l)), len(key) - 1)
                    known = (hi[k] == h) & (lo[k] == l)
                    sums += np.bincount(word[known], d[k[known]], len(ids))
                    h, l, word = h[~known], l[~known], word[~known]
                order, first = _once([l, h, word])
                if len(order):
                    times, at = np.diff(np.append(first, len(order))), order[first]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[word[at]]), pa.nulls(len(at), pa.string()), pa.array(h[at]), pa.array(l[at]), pa.array(times.astype(float))], ["id", "word", "hi", "lo", "x"])
            yield pa.RecordBatch.from_arrays([pa.array(ids), text.cast(pa.string()), pa.nulls(len(ids), pa.int64()), pa.nulls(len(ids), pa.int64()), pa.array(sums)], ["id", "word", "hi", "lo", "x"])

    made = written(words.select("id", "word").mapInArrow(tidy(spread), "id long, word string, hi long, lo long, x double"), "words-by-grams")
    rest = made.where("word is null").join(grams.select("hi", "lo", "d"), ["hi", "lo"]).groupBy("id").agg(F.sum(F.col("x") * F.col("d")).alias("_d"))
    both = made.where("word is not null").join(rest, "id", "left")
    out = written(both.select("word", (F.col("x") + F.coalesce("_d", F.lit(0.0))).alias("d")), "word-differences")
    dropped(words.sparkSession, made)
    return out


class Fitted:
    """The models as tables: words (id, word, n0, n1, n) of all documents and their differences (word, d), the most frequent
    ones broadcast; and the curve's slope and shift."""

    def __init__(self, words: DataFrame, discount: float):
        self.words, self.discount = words, discount
        self.slope, self.shift, self.cache = np.zeros(2), 0.0, {}
        spark = words.sparkSession
        every = words.withColumn("counted", F.lit(True))
        grams = gram_differences(every, discount)
        self.known = word_differences(every, grams)
        dropped(spark, grams)
        most = words.orderBy(F.desc("n"), "word").limit(FREQUENT).select("word")
        with tidied(spark):
            got = self.known.join(most, "word").where(F.length("word") < 64).toArrow()  # long words would make it large
        self.frequent = spark.sparkContext.broadcast(dict(zip(got["word"].to_pylist(), got["d"].to_pylist(), strict=True)))
        batches_(spark)

    def differences_of(self, asked: DataFrame) -> DataFrame:
        """word, d of distinct words (word) that no document had."""
        given = written(asked.select(F.monotonically_increasing_id().alias("id"), "word", *[F.lit(0).cast("long").alias(c) for c in ("n0", "n1")], F.lit(False).alias("counted")), "asked")
        grams = gram_differences(self.words.select("id", "word", "n0", "n1", F.lit(True).alias("counted")).unionByName(given), self.discount)
        out = word_differences(given, grams)
        dropped(asked.sparkSession, grams)
        batches_(asked.sparkSession)
        return out

    def sums(self, rows: DataFrame) -> DataFrame:
        """rows (text and more) without their texts, with mean and excess: the two values of each; zeros without words."""
        shared, kept = self.frequent, [c for c in rows.columns if c != "text"]
        given = rows.select(F.monotonically_increasing_id().alias("_row"), *kept, "text")
        names = ["_row", *kept, "_word", "_n", "_d", "_e"]

        def run(batches):
            get = shared.value.get
            for batch in gathered(batches):
                row, n, d, e, ids, words, times = batch["_row"].to_pylist(), [], [], [], [], [], []
                for i, text in zip(row, batch["text"].to_pylist(), strict=True):
                    mine = words_of(text)
                    got = list(map(get, mine))
                    x = np.array([v for v in got if v is not None], float)
                    n.append(len(mine))
                    d.append(float(x.sum()))
                    e.append(float(np.maximum(x - FLOOR, 0).sum()))
                    if len(x) < len(mine):
                        other = Counter(w for w, v in zip(mine, got, strict=True) if v is None)
                        ids.extend([i] * len(other))
                        words.extend(other)
                        times.extend(other.values())
                yield pa.RecordBatch.from_arrays([*[batch[c] for c in names[: len(kept) + 1]], pa.nulls(len(n), pa.string()), pa.array(n, pa.int64()), pa.array(d, pa.float64()), pa.array(e, pa.float64())], names)
                for at in range(0, len(ids), 20_000):
                    part, m = slice(at, at + 20_000), len(ids[at : at + 20_000])
                    yield pa.RecordBatch.from_arrays([pa.array(ids[part], pa.int64()), *[pa.nulls(m, batch[c].type) for c in kept], pa.array(words[part], pa.string()), pa.array(times[part], pa.int64()), *[pa.nulls(m, pa.float64())] * 2], names)

        kinds = dict(given.dtypes)
        schema = ", ".join([f"`{c}` {kinds[c]}" for c in names[: len(kept) + 1]] + ["_word string, _n long, _d double, _e double"])
        batches_(rows.sparkSession)
        met = written(given.mapInArrow(tidy(run), schema), "rows-by-words")
        rest = written(met.where("_word is not null").select("_row", F.col("_word").alias("word"), "_n").join(self.known, "word", "left"), "rare-words")
        unseen = rest.where("d is null")
        if not unseen.isEmpty():
            found = self.differences_of(unseen.select("word").distinct())
            rest = rest.join(found.withColumnRenamed("d", "_f"), "word", "left").withColumn("d", F.coalesce("d", "_f"))
        rest = rest.groupBy("_row").agg(F.sum(F.col("_n") * F.col("d")).alias("_rd"), F.sum(F.col("_n") * F.greatest(F.col("d") - FLOOR, F.lit(0.0))).alias("_re"))
        out = met.where("_word is null").join(rest, "_row", "left")
        both = lambda x, y: F.col(x) + F.coalesce(y, F.lit(0.0))
        over = lambda x, n: F.when(F.col("_n") > 0, x / n).otherwise(0.0)
        return out.select(*[F.col(f"`{c}`") for c in kept], over(both("_d", "_rd"), F.col("_n")).alias("mean"), over(both("_e", "_re"), F.sqrt("_n")).alias("excess"))

    def scored(self, rows: DataFrame) -> DataFrame:
        """rows without their texts, with score."""
        z = F.col("mean") * float(self.slope[0]) + F.col("excess") * float(self.slope[1]) + F.lit(float(self.shift))
        return self.sums(rows).withColumn("score", 1 / (1 + F.exp(-F.greatest(F.lit(-500.0), F.least(F.lit(500.0), z))))).drop("mean", "excess")

    def differences(self, words: list[str]) -> np.ndarray:
        """By word of a list, for looking at a few: its log-likelihood as toxic less that as ordinary."""
        given = self.words.sparkSession.createDataFrame(pa.table({"word": pa.array(list(set(words)), pa.string())}))
        got = given.join(self.known, "word", "left")
        new = got.where("d is null").select("word")
        found = self.differences_of(new) if not new.isEmpty() else self.known.limit(0)
        d = dict(map(tuple, [*got.where("d is not null").select("word", "d").collect(), *found.collect()]))
        return np.array([d[w] for w in words])

    def raws(self, texts: list[str | None], limit: int = 48 << 20) -> np.ndarray:
        """The two values of each text of a list, for looking at a few; nothing is kept, whatever the limit."""
        given = pa.table({"k": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())})
        got = {r.k: (r.mean, r.excess) for r in self.sums(self.words.sparkSession.createDataFrame(given)).collect()}
        return np.array([got[k] for k in range(len(texts))])


def fit(docs: DataFrame, labels: DataFrame, discount: float = 0.75) -> Fitted:
    """Fits the models on docs (doc_id, text) and all rows of labels (doc_id, toxic) that aren't held out; rows of one doc_id
    count as toxic if any is.

    8 in 10 labelled rows are counted by class, the others calibrate; the words of all documents count for the shared part.
    Without labels of both kinds every score is about the share of toxic labels, a third without any.
    """
    spark = docs.sparkSession
    labelled = written(chosen_labels(labels), "labels")
    rows = only(docs, "doc_id", "text").join(labelled, "doc_id", "left")
    counted = word_counts(rows.select("text", F.when(F.col("part") < 8, F.col("toxic")).alias("toxic")))
    model = Fitted(written(counted.select(F.monotonically_increasing_id().alias("id"), "word", "n0", "n1", "n"), "words"), discount)
    some = only(docs, "doc_id", "text").join(labelled.where("part >= 8"), "doc_id").select("text", "toxic")
    model.slope, model.shift = curve(written(model.sums(some), "calibration"))
    dropped(spark, labelled)
    return model


def curve(rows: DataFrame) -> tuple[np.ndarray, float]:
    """Slope and shift of the logistic curve for rows (mean, excess, toxic), by Newton's method; Spark adds up each step's sums."""
    got = rows.agg(F.count(F.lit(1)), F.sum("toxic"), F.avg(F.col("mean") * F.col("mean")), F.avg(F.col("excess") * F.col("excess"))).first()
    every, toxic = got[0], got[1] or 0
    if not toxic or toxic == every:
        return np.zeros(2), float(np.log((toxic + 0.5) / (every - toxic + 1)))
    scale = np.maximum(np.sqrt(np.array([got[2], got[3]])), 1e-9)
    x, b = [F.col("mean") / float(scale[0]), F.col("excess") / float(scale[1]), F.lit(1.0)], np.array([0.0, 0.0, np.log(toxic / (every - toxic))])
    ridge = np.array([1e-2, 1e-2, 1e-6])  # against separable rows
    cells = [(i, j) for i in range(3) for j in range(i, 3)]
    for _ in range(200):
        z = sum((x[i] * float(b[i]) for i in range(3)), F.lit(0.0))
        p = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))
        at = rows.select(*[c.alias(f"x{i}") for i, c in enumerate(x)], p.alias("p"), "toxic")
        sums = at.agg(*[F.sum((F.col("p") - F.col("toxic")) * F.col(f"x{i}")) for i in range(3)], *[F.sum(F.col("p") * (1 - F.col("p")) * F.col(f"x{i}") * F.col(f"x{j}")) for i, j in cells]).first()
        H = np.zeros((3, 3))
        for (i, j), v in zip(cells, sums[3:], strict=True):
            H[i, j] = H[j, i] = v
        step = np.linalg.solve(H + np.diag(ridge), np.array(sums[:3]) + ridge * b)
        b = b - step / max(1.0, float(np.abs(step).max()) / 2)
        if np.abs(step).max() < 1e-9:
            break
    return b[:2] / scale, float(b[2])


def score(docs: DataFrame, model: Fitted) -> DataFrame:
    """doc_id, held_out, score and predicted of every whole text of (doc_id, text).

    A null or empty text, or one without words, gets the score of no evidence; a score of exactly 0.5 predicts 1; texts and
    words may be of any length; rows stay as they are, repeated ones and null doc_ids too; other columns are ignored; an
    empty table gives no rows.
    """
    given = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return model.scored(given).select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def ordinary(docs: DataFrame, model: Fitted) -> DataFrame:
    """The rows of docs that the model doesn't reject (a score of 0.5 is a rejection), with all their columns; null and empty
    texts count as texts without words, repeated rows each for itself; an empty table gives no rows."""
    digest = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)  # a score is its text's alone
    rejected = model.scored(only(docs, "text").select(digest.alias("_digest"), "text")).where("score >= 0.5").select("_digest").distinct()
    return docs.join(written(rejected, "rejected"), digest == F.col("_digest"), "left_anti")
