"""Words are cut a chunk of texts at a time; ids are those of the tokenizer."""

from __future__ import annotations

import public_tokenizers
from tokenizers import Tokenizer

from catalith.llm import tokens

TEXTS = ["", "  ", "A b\x0bC\x0cD\rE\x1cF G\t", "don't 'tis ('hello') \"Ünïcode\"... 日本語。 x\x85y", "<|endoftext|> A b", "#$% 1,234.5 foo_bar", "naïve-café (naïve)"]


def test_chunk_of_texts():
    path = public_tokenizers.path("word_bpe_49k.json")
    words, whole = tokens.WordIds(path), Tokenizer.from_file(path)
    assert len(words.words([t.encode() for t in TEXTS])) == len(TEXTS)
    found = [len(x) // 4 for x in words.encode(t.encode() for t in TEXTS)]
    assert found == [len(whole.encode(t, add_special_tokens=False).ids) for t in TEXTS]
