"""The encoder looks pieces up text by text, and gathers those of texts that hold a new one alone."""

import public_tokenizers
import pytest

from tessera.llm.tokenizing import CachedEncoder, tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["", " ", "one two  three", "one two", "one four ", "two one\n two", "ü <|endoftext|> one", "one two"]


@pytest.mark.parametrize("most", [0, 3, 1000])
def test_same_ids_as_of_the_library(most):
    encoder = CachedEncoder(PATH, max_pieces=most)
    want = [b"".join(i.to_bytes(4, "little") for i in tokenizer(PATH).encode(t, add_special_tokens=False).ids) for t in TEXTS]
    for _ in range(3):  # with nothing, some or all of it known
        assert encoder.encode(TEXTS) == want
    assert len(encoder.whole) + len(encoder.after_blank) <= max(most, 0) or most == 1000


def test_known_texts_are_not_gathered():
    encoder = CachedEncoder(PATH)
    assert encoder._joined(["one"], ["two"]) is None
    ids = encoder.encode(["one two"])
    encoder._batch = encoder._together = None  # no call to the library any more
    assert encoder.encode(["one two", "one two two"])[0] == ids[0] == encoder._joined(["one"], ["two"])
