"""Ids against a tokenizer of the library as it is loaded, with nothing set."""

from __future__ import annotations

import json

import pytest
from tokenizers import Tokenizer

from lumenfold.llm import queries
from lumenfold.llm.encoding import Encoder

BYTE, WORDS = (queries.tokenizer(f) for f in ("byte_bpe_50k.json", "word_bpe_49k.json"))
TEXTS = ["a <|endoftext|> b", "<|endoftext|>", "x<|startoftext|>y  <|endoftext|>", "a <|ENDOFTEXT|> b", "a <| b |> c", "plain words, don't", "", "tab\tx"]


@pytest.mark.parametrize("path", [BYTE, WORDS])
def test_ids_are_those_of_the_library(path):
    enc, fresh = Encoder(path, 0), Tokenizer.from_file(path)
    for text in TEXTS:
        assert enc.ids(text).tolist() == [*fresh.encode(text, add_special_tokens=False).ids, 0], text


def test_special_token_in_a_text():
    assert Encoder(BYTE, 0).ids("a <|endoftext|> b").tolist() == [64, 220, 50256, 275, 0]
    assert 49407 in Encoder(WORDS, 0).ids("a <|endoftext|> b").tolist()


def test_other_special_tokens_go_to_the_library(tmp_path):
    spec = json.load(open(BYTE))
    spec["added_tokens"].append(spec["added_tokens"][0] | {"id": len(spec["model"]["vocab"]), "content": "[SEP]"})
    (tmp_path / "own.json").write_text(json.dumps(spec))
    enc, fresh = Encoder(str(tmp_path / "own.json"), 0), Tokenizer.from_file(str(tmp_path / "own.json"))
    assert enc.ids("a [SEP] b").tolist() == [*fresh.encode("a [SEP] b", add_special_tokens=False).ids, 0]
