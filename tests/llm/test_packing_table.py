"""What a packing worker remembers of pieces it has encoded."""

import numpy as np

from quillmark.llm import packing


class Tokenizer:
    def __init__(self):
        self.asked = []

    def encode_batch_fast(self, texts, add_special_tokens):
        self.asked += texts
        return [type("Found", (), {"ids": [int(t or 0), 1000 + int(t or 0)][: 1 + int(t or 0) % 2]})() for t in texts]


def encoder(most):
    out = packing.Encoder.__new__(packing.Encoder)
    out.tokenizer, out.MOST = Tokenizer(), most
    out._forget()
    return out


def ids(e, number):
    return [e.flat[e.at[i] : e.at[i + 1]].tolist() for i in number]


def test_pieces_that_come_again_are_encoded_once():
    e, often = encoder(100), [b"%d" % i for i in range(20)]
    for k in range(1, 40):
        pieces = [*often, *(b"%d" % (100 * k + i) for i in range(30))]
        number = e._learn(pieces)
        assert ids(e, number) == [[int(p), 1000 + int(p)][: 1 + int(p) % 2] for p in pieces]
        assert len(e.known) <= 100 + 50
    assert all(e.tokenizer.asked.count(p.decode()) == 1 for p in often)


def test_a_table_of_pieces_that_all_come_again_stays_bounded():
    e, pieces = encoder(100), [b"%d" % i for i in range(150)]
    for _ in range(4):
        assert ids(e, e._learn(pieces)) == [[i, 1000 + i][: 1 + i % 2] for i in range(150)]
        assert len(e.known) == 150


def test_a_piece_twice_in_one_call():
    e = encoder(100)
    assert e._learn([b"", b"7", b"", b"8"]).tolist() == [0, 1, 0, 2]
    assert e._learn([b"8", b"", b"9"]).tolist() == [2, 0, 3]
    assert np.array_equal(e.again, [True, False, True, False])
