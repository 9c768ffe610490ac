"""Inputs on which IDs by ranks alone differ from those of the tokenizers file."""

import pytest


@pytest.mark.parametrize("text", ["a b <|endoftext|> c d", "<|endoftext|>", "x<|endoftext|><|endoftext|>  \n", "a <|endoftext| > b", "a" + " " * 1_000_000 + "b", "\n" * 1_000_000, " " * 1_000_000 + "<|endoftext|> x", "a" + " " * 99_999 + "b"], ids=range(8))
def test_ids_are_those_of_the_file(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    from corpusmill.llm.tokens import encoder

    want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids
    assert encoder()(text) == want
