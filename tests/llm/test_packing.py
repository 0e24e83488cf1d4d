"""Token ids of packed texts: those of the tokenizers library, with nothing kept a word."""

from __future__ import annotations

import public_tokenizers
import tokenizers

from portlens.llm import bpe, packing

TEXTS = ["", " ", "a", "two  spaces", "tab\tand\n\nlines \n x", "end ", "  <|endoftext|> after<|endoftext|>", "naïve 漢字 🙂🙂", "don't DON'T 123 4567",
         "\r\n\r\n  indented", "x" * 3000, " ".join(f"w{i * 7919:x}" for i in range(3000))]


def test_ids_are_those_of_the_library_and_no_word_is_kept():
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = tokenizers.Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    encode = packing._Encoder(bpe.read_vocabulary(path))
    for text in TEXTS:
        assert encode(text).tolist() == library.encode(text, add_special_tokens=False).ids
    assert encode(None).tolist() == []
    assert not encode.coder.first and not encode.coder.later  # distinct words cost no more than others
