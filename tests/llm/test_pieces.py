"""Piece encoding against the sentencepiece library, and the character map against its normaliser."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece as spm
from hypothesis import given, settings
from hypothesis import strategies as st

import __spark_entry__ as entry
from movelines.llm import pieces
from movelines.llm.common import utf8

SF = "/root/testdata/sf0.001"
MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", None, " ", "  a", "a  ", "▁", "a▁b", "▁▁ x", "é 漢字 \U0001f600 \x07\0 x", "<s></s><unk><0x41>", "\n\n  \t x", "a b", "﻿ hi", "x" * 3000, "ab " * 5000]


@pytest.fixture(scope="module")
def library():
    return spm.SentencePieceProcessor(model_file=MODEL)


def check(texts, library):
    ids, begins, ends, first, decoded = pieces.pieces(MODEL).encode(pa.array(texts, pa.string()))
    for k, text in enumerate(texts):
        want = library.encode(text or "", add_eos=True)
        own = slice(first[k], first[k + 1])
        assert ids[own].tolist() == want and decoded[k] == library.decode(want)
        spans = [(p.begin, p.end) for p in library.encode(text or "", return_type="proto").pieces]
        size = len((text or "").encode())
        assert list(zip(begins[own].tolist(), ends[own].tolist())) == [*spans, (size, size)]


def test_odd_texts(library):
    check(ODD, library)
    check(ODD[::-1], library)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("ab  ▁\n.é"), st.characters(exclude_categories=["Cs"])), max_size=30), min_size=1, max_size=6))
def test_any_text(texts):
    check(texts, spm.SentencePieceProcessor(model_file=MODEL))


def test_a_small_memory_forgets_nothing_needed(library, monkeypatch):
    small = pieces.Pieces(MODEL, memory=3)
    for texts in (["one two three four five"], ["six one two"], ["three one nine ten"], ["one"]):
        ids = small.encode(pa.array(texts))[0].tolist()
        assert ids == library.encode(texts[0], add_eos=True)


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf"])
def test_character_map(rule):
    from sentencepiece import sentencepiece_model_pb2 as pb

    theirs = spm.SentencePieceNormalizer(rule_name=rule)
    spec = pb.NormalizerSpec.FromString(theirs.serialized_normalizer_spec())
    ours = pieces.Normaliser(spec.precompiled_charsmap, spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces)
    rnd = random.Random(1)
    letters = "aAB  \t\n　ＡＢ①ﬁ̧́éﾊﾞﾞﾊ가각ᄀㅏ​漢ß½ﷺ"
    texts = ["", " ", "  ", *("".join(rnd.choice(letters) for _ in range(rnd.randint(0, 14))) for _ in range(1500))]
    buf, offsets = utf8(pa.array(texts, pa.string()))
    out, cut, origin, ends = ours(buf, offsets)
    for k, text in enumerate(texts):
        want, places = theirs.normalize(text, with_offsets=True)
        got = out[cut[k] : cut[k + 1]].tobytes().decode()
        assert got == want
        if got:  # the library counts characters
            chars = np.cumsum([0, *(len(c.encode()) for c in text)]).tolist()
            at = np.cumsum([0, *(len(c.encode()) for c in got)])
            source = np.append(origin[cut[k] : cut[k + 1]], ends[k]) - offsets[k]
            assert [chars.index(s) for s in source[at].tolist()] == list(places)


def test_malformed_bytes_count_one_by_one():
    ours = pieces.Normaliser(b"", True, False, True)
    raw = "a b".encode() + b"\xff\xe6\xbc" + "é".encode()
    out, cut, origin, ends = ours(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    assert out.tobytes().decode() == "▁a▁b���é"
    assert origin[-11:].tolist() == [3] * 3 + [4] * 3 + [5] * 3 + [6, 6]


def test_models_with_own_symbols_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto.FromString(open(MODEL, "rb").read())
    model.pieces[300].type = pb.ModelProto.SentencePiece.USER_DEFINED
    (tmp_path / "own.model").write_bytes(model.SerializeToString())
    with pytest.raises(ValueError):
        pieces.Pieces(str(tmp_path / "own.model"))


def test_a_model_with_a_map_and_without_byte_pieces(tmp_path):
    """The same vocabulary with another normaliser, and characters that it doesn't know."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto.FromString(open(MODEL, "rb").read())
    model.normalizer_spec.CopyFrom(pb.NormalizerSpec.FromString(spm.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_normalizer_spec()))
    model.trainer_spec.byte_fallback = False
    for p in model.pieces:
        if p.type == pb.ModelProto.SentencePiece.BYTE:
            p.type = pb.ModelProto.SentencePiece.UNUSED
    path = tmp_path / "other.model"
    path.write_bytes(model.SerializeToString())
    library, ours = spm.SentencePieceProcessor(model_file=str(path)), pieces.Pieces(str(path))
    texts = ["ＡＢＣ ① ﬁsh", "  a  b  ", "x ꙮꙮ y ꙮ", "ﾊﾞ", "", "plain text"]
    ids, begins, ends, first, decoded = ours.encode(pa.array(texts))
    for k, text in enumerate(texts):
        own = slice(first[k], first[k + 1])
        want = library.encode(text, add_eos=True)
        assert ids[own].tolist() == want and decoded[k] == library.decode(want)
        assert list(zip(begins[own].tolist(), ends[own].tolist()))[:-1] == [(p.begin, p.end) for p in library.encode(text, return_type="proto").pieces]


def test_query(spark, library):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = entry.queries()["op11_pieces"](spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in rows:
        ids = library.encode(docs[r["doc_id"]], add_eos=True)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids)))


def test_edges_of_tables(spark):
    rows = [(None, "a b", 1), (2, None, 2), (2, "", 3), (2, "x y", 4), (2, "x y", 4)]
    d = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = pieces.encode_documents(d, MODEL).collect()
    assert len(got) == 5 and sum(r["ids"] == [2] for r in got) == 2
    r = next(r for r in got if r["doc_id"] is None)
    assert (r["decoded"], r["begins"], r["ends"]) == ("a b", [0, 1, 3], [1, 3, 3])
    assert pieces.encode_documents(d.limit(0), MODEL).collect() == []
