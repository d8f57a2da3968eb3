import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from quillmark.llm import packing


def test_encoder_equals_an_untouched_tokenizer():
    path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        e = packing.Encoder(f.read())
    t = Tokenizer.from_file(path)
    contents = [x.content for x in t.get_added_tokens_decoder().values()]
    assert contents
    texts = ["plain it's", "", "tail <|endof", "text|> head", "<|endoftext", "|>", None, *(x for c in contents for x in (f"{c} hi", f"a{c}", f"a {c} b{c}{c}", c, f"é {c}\n\n x"))]
    for text, got in zip(texts, e.rows(pa.array(texts)), strict=True):
        assert list(got) == t.encode(text or "", add_special_tokens=False).ids
