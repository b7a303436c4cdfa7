"""Long units of SentencePiece: the path by matches against the table, and its time."""

import random
import time

import numpy as np
import pytest

from intervale.llm import sentencepiece_unigram as sp
from intervale.llm.sentencepiece_unigram import Codec, Pieces


def codec_of(rng, alphabet, size):
    texts = {"".join(rng.choices(alphabet, k=rng.randrange(1, 7))) for _ in range(size)} | {"aa", "aaaa"}
    normal = sorted(texts)
    names = [*(f"<0x{b:02X}>" for b in range(256)), *normal]
    scores = [0.0] * 256 + [rng.choice([-1.0, -2.0, -rng.uniform(0.5, 9)]) for _ in normal]
    return Codec(Pieces.of(names, scores, list(range(256)), list(range(256, len(names)))))


@pytest.mark.parametrize("seed", range(6))
def test_matches_give_the_path_of_the_table(seed, monkeypatch):
    """Ties of scores, characters without a piece, and blocks of places that cut pieces."""
    rng = random.Random(seed)
    codec = codec_of(rng, rng.choice(["ab", "aé東", "abc𝄞"]), 30)
    monkeypatch.setattr(sp, "STARTS_AT_ONCE", rng.choice([1, 3, 1 << 16]))
    for _ in range(150):
        unit = "".join(rng.choices("abé東𝄞z", weights=[9, 5, 3, 3, 1, 1], k=rng.randrange(1, 40))).encode()
        if rng.random() < 0.2:
            unit = bytes(rng.choices(range(1, 256), k=9))  # no valid text
        text = np.frombuffer(unit, np.uint8)
        want_ids, want_count, want_score = codec.viterbi(text[None, :].copy(), np.array([len(text)]))
        ids, score = codec.long_path(text)
        assert ids.tolist() == want_ids.tolist() and len(ids) == want_count[0] and score == want_score[0]


def test_mixed_lengths_encode_alike(monkeypatch):
    """Whatever goes side by side, the ids are the same."""
    rng = random.Random(9)
    texts = ["".join(rng.choices("ab é東", k=rng.randrange(0, 60))) for _ in range(300)] + ["東" * 500, "a" * 3000]
    found = []
    for together in (0, 5, 128, 10**6):
        monkeypatch.setattr(sp, "SIDE_BY_SIDE", together)
        codec = codec_of(random.Random(3), "ab é東".replace(" ", ""), 40)
        found.append([(ids.tolist(), score) for ids, score in map(codec.encode, texts)])
    assert all(f == found[0] for f in found)


def test_long_texts_without_spaces_are_quick():
    import public_tokenizers

    codec = Codec(sp.load(public_tokenizers.path("piece_bpe_32k.model")))
    rng = random.Random(1)
    chinese = "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(32_000))
    for text in (chinese, "a" * 20_000, "".join(rng.choices("abcdefghij0123456789+/", k=100_000))):
        began = time.process_time()
        ids, _ = codec.encode(text)
        took = time.process_time() - began
        assert codec.decode(ids.tolist()) == text and took < 2.0
