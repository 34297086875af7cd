import random

import numpy as np
import pyarrow as pa

from spanloom.llm import words as W


def thue_morse(bits):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(1 << bits))


def test_words_of_two_letters_keep_their_hashes_apart():
    texts = [t for bits in range(1, 14) for t in (thue_morse(bits), thue_morse(bits).translate(str.maketrans("ab", "ba")))]
    assert len(np.unique(W.word_hashes(texts))) == len(texts)


def test_hashes_depend_on_the_word_alone():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abéxyz09ü") for _ in range(rng.choice([1, 2, 7, 8, 9, 16, 17, 600])))
    own = list({word() for _ in range(400)})
    alone = dict(zip(own, W.word_hashes(own).tolist(), strict=True))
    assert len(set(alone.values())) == len(own)
    texts = [" - ".join(rng.choice(own) for _ in range(rng.randint(0, 30))) for _ in range(50)] + [None, ""]
    found = W.split(pa.array(texts), W.ALPHANUMERIC)
    assert found.hash.tolist() == [alone[w] for t in texts if t for w in t.split(" - ")]


def test_lanes_end_with_the_word():
    # Words that differ only behind a lane's edge, and bytes behind a word that must not count.
    assert len(np.unique(W.word_hashes(["abcdefgh", "abcdefghi", "abcdefghj", "abcdefg"]))) == 4
    a, b = (W.split(pa.array([t]), W.ALPHANUMERIC).hash[0] for t in ("abc", "abc!defgh"))
    assert a == b
