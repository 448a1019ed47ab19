import os
import zlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestar.llm import packing, token_file
from lodestar.llm.tokens import Encoder, default_vocabulary
from tests.llm import data


def plain(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_vocabulary())
    return [e.ids + [1] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


ENCODER = Encoder(default_vocabulary(), 50)


def encoded(texts):
    import pyarrow as pa

    ids, n = ENCODER.encode(pa.array(texts, pa.string()))
    return [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("abcDEF012 .,'|<>\n\té́ÄΣς  İſK"), st.characters(codec="utf-8")), max_size=40), min_size=1, max_size=5))
def test_words_give_the_ids_of_whole_texts(texts):
    assert encoded(texts) == plain(texts)


def test_awkward_texts():
    texts = [t for _, t in data.awkward()] + ["don't we'll it's 'sa", "<|startoftext|>a", "x" * 5000, "¦ | || |a"]
    assert encoded(texts) == plain(texts)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=70))
def test_ranks_round_trip(ranks):
    r = np.array(ranks, "<u4")
    control, out = token_file.encode_ranks(r)
    assert len(control) == -(-len(r) // 4)
    assert token_file.decode_ranks(control, out, len(r)).tolist() == ranks


def test_token_files_hold_all_documents_in_order(spark):
    docs = data.documents(spark)
    got = [tuple(r) for r in token_file.token_digests(docs).collect()]
    rows = [(d, ids) for (d, _), ids in zip(data.awkward(), plain([t for _, t in data.awkward()]), strict=True)]
    assert sorted((str(g[0]), g[2], g[3]) for g in got) == sorted((str(d), len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for d, i in rows)
    got.sort(key=lambda g: g[1])
    assert [g[0] is not None for g in got] == sorted(g[0] is not None for g in got)  # null ids first
    known = [g[0] for g in got if g[0] is not None]
    assert known == sorted(known)
    assert [g[1] for g in got] == np.concatenate([[0], np.cumsum([g[2] for g in got])[:-1]]).tolist()


def test_frequent_ids_take_one_byte(spark, tmp_path):
    path = f"file://{tmp_path}/f"
    made = token_file.write_token_files(data.documents(spark), path)
    total = sum(m[2] for m in made)
    size = sum(os.path.getsize(f"{tmp_path}/f/{f}") for f in os.listdir(f"{tmp_path}/f") if f.endswith(".ids"))
    assert size < 1.4 * total + 1000


def test_no_documents(spark):
    assert token_file.token_digests(data.empty(spark)).collect() == []
    assert packing.pack(data.empty(spark)).collect() == []


def _starts(ids, pieces):
    """Each id with the start of the piece of its document that holds its place."""
    cuts = sorted({p.start for p in pieces if p.doc_tokens == len(ids)})
    return [(max(c for c in cuts if c <= k), i) for k, i in enumerate(ids)]


def test_packing_cuts_and_places_every_id_once(spark):
    docs = data.documents(spark).repartition(3)
    pieces = packing.pack(docs, with_ids=True).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert p.length == len(p.ids) > 0
        assert p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes())
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    want = defaultdict(list)
    for (d, _), ids in zip(data.awkward(), plain([t for _, t in data.awkward()]), strict=True):
        want[d].append(ids)
    for d, ps in by_doc.items():
        assert sorted((p.start, i) for p in ps for i in p.ids) == sorted((s, i) for ids in want[d] for s, i in _starts(ids, ps))
        if len(want[d]) == 1:
            assert [i for p in sorted(ps, key=lambda p: p.start) for i in p.ids] == want[d][0]
    assert set(by_doc) == set(want)
    for ps in by_sequence.values():
        ps.sort(key=lambda p: p.offset)
        at = 0
        for p in ps:
            assert p.offset == at
            at += p.length
        assert at == 2048 or at & (at - 1) == 0  # nothing is padded


def test_placement_minimises_the_sum_of_squares():
    rng = np.random.default_rng(3)
    packer = packing.Packer(64)
    for _ in range(500):
        size = int(rng.integers(1, 64))
        n = packer.counts.copy()

        def cost(level):
            m = n.copy()
            if level:
                m[level] -= 1
            if level + size < 64:
                m[level + size] += 1
            return int((m[1:64] ** 2).sum())

        best = min(cost(h) for h in [0, *[h for h in range(1, 64 - size + 1) if n[h]]])
        assert cost(packer.level_for(size)) == best
        list(packer.add(0, np.arange(size)))
        assert all(len(packer.open[h]) == packer.counts[h] for h in range(64))


def test_open_windows_are_filled_up_from_the_emptiest():
    import random

    r = random.Random(4)
    for n in (0, 1, 2, 5, 60, 400):
        packer, pieces, docs = packing.Packer(64, max_open=40), [], [np.arange(r.randrange(1, 150)) + 1000 * k for k in range(n)]
        for k, ids in enumerate(docs):
            pieces += packer.add(k, ids)
        before = {(p[0], p[1]) for level in packer.open for box in level for p in box}
        end = list(packer.finish())
        whole = {(d, s) for d, s, ids, total, _, _ in end if s + len(ids) == total}
        assert not before or len(before & whole) >= len(before) // 2  # the fullest stay as they were placed
        pieces += end
        for k, ids in enumerate(docs):
            assert np.concatenate([p[2] for p in sorted(pieces, key=lambda p: p[1]) if p[0] == k]).tolist() == ids.tolist()
        fill = defaultdict(list)
        for p in pieces:
            fill[p[4]].append((p[5], len(p[2])))
        for parts in fill.values():
            parts.sort()
            assert [o for o, _ in parts] == np.concatenate([[0], np.cumsum([m for _, m in parts])[:-1]]).tolist()
            assert (size := sum(m for _, m in parts)) == 64 or (size & (size - 1) == 0)
        assert sum(sum(m for _, m in parts) != 64 for parts in fill.values()) <= 6 * (1 + n // 20)


def test_long_words_do_not_pile_up():
    import pyarrow as pa

    enc = Encoder(default_vocabulary(), cache_bytes=4 << 20)
    for k in range(60):
        words = [chr(97 + k % 26) * 9_000 + str(j) + "q" * 9_000 for j in range(k, k + 40)]
        enc.encode(pa.array([" ".join(words)], pa.string()))
        assert enc.known.bytes + enc.old.bytes + enc.parts.bytes < 24 << 20
    many = pa.array([" ".join(f"{'xyz' * 30}{k}w" for k in range(a, a + 10_000)) for a in range(0, 100_000, 10_000)], pa.string())
    for k in range(len(many)):
        enc.encode(many.slice(k, 1))
    assert enc.known.bytes + enc.old.bytes < 24 << 20
