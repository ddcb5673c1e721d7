"""The encoder's memory of chunks: as few as can be, and the library's ids."""

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from movelines.llm import tokens

WORDS, BYTES = (public_tokenizers.path(x) for x in ("word_bpe_49k.json", "byte_bpe_50k.json"))


def agree(encoder, library, texts):
    ids, offsets = encoder.encode(pa.array(texts, pa.string()))
    got = [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])]
    assert got == [library.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_a_word_is_learned_once_whatever_its_case_and_line():
    e = tokens.Encoder(WORDS)
    agree(e, Tokenizer.from_file(WORDS), ["x Word word\nWORD\nword wOrd", "x word"])
    assert sorted(e.young) == [b" word", b"x"]


def test_case_and_lines_count_where_the_tokenizer_keeps_them():
    e = tokens.Encoder(BYTES)
    agree(e, Tokenizer.from_file(BYTES), ["x Word word\nWORD\nword wOrd", "x word"])
    assert len(e.young) == 6


def test_plain_words_need_no_normaliser_and_no_separator(monkeypatch):
    e, seen = tokens.Encoder(WORDS), []
    separated = e._separated
    monkeypatch.setattr(e, "_separated", lambda texts: seen.extend(texts) or separated(texts))
    agree(e, Tokenizer.from_file(WORDS), ["x Plain wörter only éa, don't 4x straße ŉa"])
    assert sorted(seen) == sorted(["x", ",", " don't", " 4x"])


def test_batches_that_hold_no_plain_word_after_all(monkeypatch):
    monkeypatch.setattr(tokens, "_WORD", tokens.re.compile(r" .*"))  # says that all is one word
    agree(tokens.Encoder(WORDS), Tokenizer.from_file(WORDS), ["x one two's a4 ... five", None, "", " six 7"])


ODD = [
    "J̌", "ǰ", "T̈x", "İ", "İ", "Å", "K", "Σ", "aΣ", "ﬁ", "ǅ", "ª",
    "ŉ", "\n", "\ń", " ̈a", "\n\n", "  ", "Don'T", "'S", "X.", "Y?!", "A1b", "_a",
    "<|ENDOFTEXT|>", "<|endoftext|>", "<|EndOfText|>́", "<|startoftext|>.", "</w>", " w</w>", "\x01", "\t", "\xa0", "　",
]


@pytest.mark.parametrize("path", [WORDS, BYTES])
def test_odd_letters_have_the_librarys_ids(path):
    e, library = tokens.Encoder(path), Tokenizer.from_file(path)
    agree(e, library, [a + sep + b for a in ODD for b in ODD for sep in ("", " ", "\n", "Q")])
    agree(e, library, [" ".join(ODD[:24]), "".join(ODD[:24]), *ODD, None, ""])


_encoders = {p: (tokens.Encoder(p), Tokenizer.from_file(p)) for p in (WORDS, BYTES)}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*ODD[:23], "Ab", "ab ", "\nAB", ".", "é", "É"]) | st.text(max_size=4), max_size=12).map("".join), max_size=5), st.sampled_from([WORDS, BYTES]))
def test_any_texts_have_the_librarys_ids(texts, path):
    agree(*_encoders[path], texts)


def test_no_texts():
    ids, offsets = tokens.Encoder(WORDS).encode(pa.array([], pa.string()), 2)
    assert not len(ids) and offsets.tolist() == [0]
    ids, offsets = tokens.Encoder(WORDS).encode(pa.array([None, ""], pa.string()), 2)
    assert ids.tolist() == [2, 2] and np.diff(offsets).tolist() == [1, 1]
