"""What a packing worker holds at once."""

from quillmark.llm import packing


def test_new_pieces_are_encoded_in_bounded_batches():
    sizes = []

    class Found:
        ids = [7]

    class Tokenizer:
        def encode_batch_fast(self, texts, add_special_tokens):
            sizes.append(len(texts))
            return [Found() for _ in texts]

    encoder = packing.Encoder.__new__(packing.Encoder)
    encoder.tokenizer = Tokenizer()
    encoder._forget()
    assert encoder._learn([b"%d" % i for i in range(10_000)]).tolist() == list(range(10_000))
    assert sum(sizes) == 10_000 and max(sizes) <= 4_096


def test_free_memory_is_handed_back():
    packing._release()
