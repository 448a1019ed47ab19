"""Token ids by the tokenizers library, with a bounded cache over words.

The whole text decides every id. For a tokenizer that drops white space and never lets a token cross it
(word_bpe_49k.json), a text's ids are the ids of its words in order, so each distinct word is encoded once
and then looked up; any other tokenizer encodes each text as a whole.
"""

from __future__ import annotations

import json
import os
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

END_ID = 1
#: Words of printable ASCII and Latin-1 letters: lower() and the split pattern act on each alone.
_PLAIN = "^[!-{}-~À-ÿ]+$"  # without the bar
_BAR = "|"
_encoders: dict[tuple[str, int], "Encoder"] = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encoder(path: str, cache_words: int = 400_000) -> "Encoder":
    """One encoder for each Python worker process; its cache lasts over tasks."""
    key = (path, cache_words)
    if key not in _encoders:
        _encoders[key] = Encoder(path, cache_words)
    return _encoders[key]


def slices(texts: pa.Array, most: int = 4 << 20):
    """(start, length) of runs of texts of about `most` bytes; a longer text is a run of its own."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    run = np.cumsum(size) // most
    cuts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(texts)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:]) if b > a]


class Known:
    """Words and their ids, end to end in one array."""

    def __init__(self, dtype: np.dtype):
        self.at: dict[str, int] = {}
        self.start, self.size = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32)
        self.ids, self.used = np.zeros(1 << 18, dtype), 0
        self.bytes = 0  # of words and ids, about

    def places(self, words: list[str]) -> np.ndarray:
        """The place of each word, -1 if it is new."""
        return np.fromiter(map(self.at.get, words, repeat(-1)), np.int64, len(words))

    def add(self, words: list[str], ids: np.ndarray, size: np.ndarray) -> np.ndarray:
        n, k = len(self.at), len(words)
        if n + k > len(self.size):
            more = np.zeros(max(n + k, len(self.size)), np.int32)
            self.start, self.size = np.concatenate([self.start, more]), np.concatenate([self.size, more])
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(ids), len(self.ids)), self.ids.dtype)])
        self.start[n : n + k] = self.used + np.cumsum(size) - size
        self.size[n : n + k] = size
        self.ids[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        self.at.update(zip(words, range(n, n + k), strict=True))
        self.bytes += 120 * k + 2 * sum(map(len, words)) + ids.nbytes
        return np.arange(n, n + k)

    def take(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words by place, end to end, and their numbers: fewer than 2^31, as they are of one Arrow array of texts."""
        n = self.size[places]
        end = np.cumsum(n, dtype=np.int32)
        at = np.repeat(self.start[places] - (end - n), n)
        at += np.arange(len(at), dtype=np.int32)
        return self.ids[at], n


class Encoder:
    """cache_words, cache_bytes: what a generation of known words may hold, and one slice of texts beyond; two are kept."""

    def __init__(self, path: str, cache_words: int = 400_000, cache_bytes: int = 64 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.vocab_size = self.tok.get_vocab_size()
        self.dtype = np.dtype("<u2") if self.vocab_size <= 1 << 16 else np.dtype("<u4")
        self.limit, self.most_bytes = cache_words, cache_bytes
        self.known, self.old, self.parts = Known(self.dtype), Known(self.dtype), Known(self.dtype)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.pattern = self._word_pattern(spec)
        bar = self.tok.encode(_BAR, add_special_tokens=False).ids
        self.bar = bar[0] if len(bar) == 1 else None
        self.light = self._light(Tokenizer)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.by_word = self.pattern is not None and self.bar is not None and all(_BAR in s and not any(map(str.isspace, s)) for s in self.special)

    def _light(self, kind):
        """The same model for parts that are lower case and split already: only white space parts them."""
        from tokenizers import pre_tokenizers as pre

        light = kind(self.tok.model)
        light.pre_tokenizer = pre.Sequence([pre.WhitespaceSplit(), pre.ByteLevel(add_prefix_space=False, use_regex=False)])
        return light

    @staticmethod
    def _word_pattern(spec):
        """The pattern of the tokenizer's own split, if it is lower case, white space dropped, tokens within words."""
        kinds = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        if kinds != ["NFC", "Replace", "Lowercase"] or len(steps) != 2:
            return None
        first = steps[0]
        if first.get("type") != "Split" or first.get("behavior") != "Removed" or not first.get("invert") or steps[1].get("add_prefix_space"):
            return None
        pattern = first["pattern"].get("Regex", "")
        tail = r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
        # the letters and digits of plain words in lower case
        return f"({pattern.removesuffix(tail)}|[a-zß-öø-ÿ]+|[0-9]|[^\\sa-z0-9ß-öø-ÿ]+)" if pattern.endswith(tail) else None

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all whole texts (null: empty) end to end, each text's followed by the end id, and their numbers."""
        texts = pc.fill_null(texts, "")
        if self.by_word:
            ids, n = self._by_word(texts)
        else:
            each = [np.array(e.ids, self.dtype) for e in self.tok.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            ids, n = np.concatenate([np.zeros(0, self.dtype), *each]), np.array([len(e) for e in each], np.int64)
        ends = np.cumsum(n + 1) - 1
        out = np.full(len(ids) + len(n), END_ID, self.dtype)
        inner = np.ones(len(out), bool)
        inner[ends] = False
        out[inner] = ids
        return out, n + 1

    def _by_word(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = split.flatten().dictionary_encode()
        here = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.known.at) > self.limit or self.known.bytes + self.parts.bytes > self.most_bytes:  # the last generation stays at hand, so frequent words are kept
            self.old = self.known if self.known.bytes <= self.most_bytes else Known(self.dtype)
            self.known, self.parts = Known(self.dtype), Known(self.dtype)
        places = self.known.places(here)
        new = np.flatnonzero(places < 0)
        if len(new):
            places[new] = self._learn([here[k] for k in new.tolist()])
        ids, n = self.known.take(places[coded.indices.to_numpy()])
        last = np.cumsum(split.value_lengths().to_numpy().astype(np.int64))
        return ids, np.diff(np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], last])])

    def _learn(self, new: list[str]) -> np.ndarray:
        """Adds new words and returns their places.

        Plain words are put in lower case and parted by the tokenizer's own pattern here, all at once; the rest are left
        to the tokenizer as they are.
        """
        old = self.old.places(new)
        out = np.empty(len(new), np.int64)
        again, fresh = np.flatnonzero(old >= 0), np.flatnonzero(old < 0)
        if len(again):
            out[again] = self.known.add([new[k] for k in again.tolist()], *self.old.take(old[again]))
        words = pa.array([new[k] for k in fresh.tolist()], pa.string())
        plain = pc.match_substring_regex(words, _PLAIN)
        is_plain = plain.to_numpy(zero_copy_only=False).astype(bool)
        rest = words.filter(pc.invert(plain)).to_pylist()
        if rest:
            out[fresh[~is_plain]] = self.known.add(rest, *self._encode(rest, self.tok))
        chosen = words.filter(plain)
        if len(chosen):
            parted = pc.split_pattern(pc.replace_substring_regex(pc.utf8_lower(chosen), self.pattern, r"\1 "), " ")
            coded = parted.flatten().dictionary_encode()
            parts = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
            places = self.parts.places(parts)
            unseen = np.flatnonzero(places < 0)
            if len(unseen):
                names = [parts[k] for k in unseen.tolist()]
                places[unseen] = self.parts.add(names, *self._encode(names, self.light))
            ids, n = self.parts.take(places[coded.indices.to_numpy()])
            last = np.concatenate([[0], np.cumsum(parted.value_lengths().to_numpy().astype(np.int64))])
            out[fresh[is_plain]] = self.known.add(chosen.to_pylist(), ids, np.diff(np.concatenate([[0], np.cumsum(n)])[last]))
        return out

    def _encode(self, items: list[str], tok) -> tuple[np.ndarray, np.ndarray]:
        """Ids of strings end to end and their numbers; many at a time, with a bar that none of them holds between them."""
        if any(_BAR in x or not x for x in items):
            each = [np.array(tok.encode(x, add_special_tokens=False).ids, self.dtype) if _BAR in x or not x else None for x in items]
            ids, n = self._encode([x for x in items if _BAR not in x and x], tok)
            other = iter(np.split(ids, np.cumsum(n)[:-1]) if len(n) else [])
            each = [next(other) if e is None else e for e in each]
            return np.concatenate([np.zeros(0, self.dtype), *each]), np.array([len(e) for e in each], np.int64)
        step, bar = 256, f" {_BAR} "
        lines = [bar.join(items[k : k + step]) + bar for k in range(0, len(items), step)]
        ids = np.concatenate([np.zeros(0, self.dtype), *[np.array(e.ids, self.dtype) for e in tok.encode_batch_fast(lines, add_special_tokens=False)]])
        ends = np.flatnonzero(ids == self.bar)
        return np.delete(ids, ends), np.diff(ends, prepend=-1) - 1
