"""op7_packing: what a word, a piece and a window cost."""

import random
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from tallyframe.llm import packing, wordids

WORDS = public_tokenizers.path("word_bpe_49k.json")


def made_up(n, seed, letters="abcdefghijklmnopqrstuvwxyzéüßñйлшÓ'7,%", least=3):
    rnd = random.Random(seed)
    return ["".join(rnd.choices(letters, k=rnd.randint(least, 11))) for _ in range(n)]


def same_ids(coder, texts):
    plain = Tokenizer.from_file(WORDS)
    flat, at = coder.encode(pa.array(texts, pa.string()))
    assert [flat[a:b].tolist() for a, b in zip(at, at[1:])] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_new_words_leave_the_known_ones_in_place():
    coder = wordids.WordIds(WORDS)
    same_ids(coder, [" ".join(made_up(500, k)) for k in range(12)])
    coder.encode(pa.array([" ".join(made_up(300, 99, least=9))]))
    held = coder.hashes, coder.at, coder.size, coder.flat, coder.slots
    same_ids(coder, ["onlynewword andonemore", "<|endoftext|> Kept Case", "", " "])
    # a batch with a few new words does not copy all known ones
    assert all(a is b for a, b in zip(held, (coder.hashes, coder.at, coder.size, coder.flat, coder.slots)))


def test_words_stay_right_when_the_table_starts_anew(monkeypatch):
    monkeypatch.setattr(wordids, "CACHED_WORDS", 700)
    coder = wordids.WordIds(WORDS)
    for k in range(6):
        same_ids(coder, [" ".join(made_up(400, k % 4)), " ".join(made_up(40, 50 + k))])


def test_plain_words_need_the_model_alone():
    letters = [chr(c) for c in range(0x600) if wordids.PLAIN(chr(c))]
    words = letters + [a + b for a in letters for b in letters] + made_up(3000, 5, "".join(letters))
    whole = Tokenizer.from_file(WORDS)
    text = " ".join(words)
    assert wordids.WordIds(WORDS).bare.encode(text, add_special_tokens=False).ids == whole.encode(text, add_special_tokens=False).ids


def test_projected_pieces_take_little_memory():
    rng = np.random.default_rng(4)
    pieces = [rng.integers(2, 40_000, 500).astype("<u2") for _ in range(256)] + [np.ones(1, "<u2"), np.empty(0, "<u2")]
    of, ids, count, size = packing._counts(pieces, packing.END_ID)
    model = packing.Model.of(np.arange(40_000), np.maximum(1, np.bincount(ids, minlength=40_000)), size)
    base = packing.base_of(model)
    tracemalloc.start()
    got = model.projected(pieces, packing.END_ID, base)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # a row of `base` for each term of all pieces would be 49 MB
    assert peak < 30e6
    weight = model.weights(of, ids, count, size)
    for i in (0, 7, 255, 256, 257):
        row = (base[ids[of == i]] * weight[of == i][:, None]).sum(axis=0)
        assert np.allclose(got[i], row / max(np.linalg.norm(row), 1e-12))


def plain_shard(pieces, window, model):
    """Windows as (doc_id, start, length), by a ranking of all unused pieces for each seed."""
    index = packing.Index([p.ids for p in pieces], packing.END_ID, model)
    left = {i: p for i, p in enumerate(pieces)}
    out = []
    while left:
        seed = min(left)
        score = index.scores([seed])[0]
        own, long = [left.pop(seed)], None
        for i in sorted(left, key=lambda i: (-score[i], i)):
            room = window - sum(len(p.ids) for p in own)
            if room and len(left[i].ids) <= room:
                own.append(left.pop(i))
            elif room and long is None:
                long = i
        room = window - sum(len(p.ids) for p in own)
        if room and long is not None:
            own.append(left[long].take(room))
        out.append([(p.doc_id, p.start, len(p.ids)) for p in own])
    return out


def test_windows_are_those_of_a_whole_ranking():
    rng = np.random.default_rng(6)
    for sizes in ([1] * 90, rng.integers(1, 60, 150), rng.integers(1, 8, 200), [63] * 20 + [1] * 5, [5]):
        ids = [np.append(rng.integers(2, 40, n - 1), 1).astype("<u2") for n in sizes]
        ids += ids[:10]
        both = [[packing.Piece(i, 0, x, len(x)) for i, x in enumerate(ids)] for _ in range(2)]
        windows, last = packing.pack_shard(both[0], 64, packing.END_ID)
        got = [[(p.doc_id, p.start, len(p.ids)) for p in own] for own in [*windows, *([last] if last else [])]]
        assert got == plain_shard(both[1], 64, None)
