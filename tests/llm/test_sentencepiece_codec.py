import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as proto

from inkwell.llm._text import text_bytes
from inkwell.llm.queries import QUERIES
from inkwell.llm.sentencepiece_codec import Codec, decode, encode

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["a  b", "  x  y\n\n z", "don't 's a'll", "　 全角 空白", "</s> <unk> hi <0x0A>", "a \n b", "x\ty z", "é è  ü", "", "\n", " ", "a", "😀 😀\n😀",
       "नमस्ते दुनिया", "▁a ▁ b▁", "\x00a", "ﬁ Å ① ㌔", " lead", "trail  ", "word " * 2000, "x" * 30_000, "ｈｅｌｌｏ　ｗｏｒｌｄ", "é ạ̀"]


def check(path, texts, spans=True):
    codec = Codec(path)
    whole = codec.whole
    data, bounds = text_bytes(pa.array(texts, pa.string()))
    ids, counts, starts, ends = codec.encode(data, bounds)
    stops = np.cumsum(counts)
    full, sizes = codec.with_end(ids, counts)
    decoded, decimals = codec.decode(full, sizes), codec.decimals(full, sizes)
    for i, text in enumerate(texts):
        own = slice(stops[i] - counts[i], stops[i])
        expected = whole.encode(text or "")
        assert ids[own].tolist() == expected
        assert decoded[i].decode() == whole.decode([*expected, whole.eos_id()])
        assert decimals[i] == " ".join(map(str, [*expected, whole.eos_id()])).encode()
        if spans:  # every piece's span lies in the text, in order, and what it covers is all of it
            a, b = starts[own], ends[own]
            assert (a <= b).all() and (np.diff(a) >= 0).all() and (b <= len((text or "").encode())).all()
    return codec, ids, counts, starts, ends


def test_ids_text_and_spans_are_the_librarys():
    codec, ids, counts, starts, ends = check(PATH, [*ODD, None, *ODD])
    stops = np.cumsum(counts)
    for i, text in enumerate(ODD):
        pieces = codec.whole.encode(text, return_type="proto").pieces
        own = slice(stops[i] - counts[i], stops[i])
        raw = text.encode()
        # Byte pieces of one character share its bytes in the library; here each has its own.
        for p, a, b in zip(pieces, starts[own], ends[own], strict=True):
            if not codec.whole.is_byte(p.id):
                assert (p.begin, p.end) == (a, b) or raw[a:b].decode() == p.surface


@pytest.mark.parametrize("rule", ["nfkc", "nmt_nfkc_cf"])
@pytest.mark.parametrize("squeeze", [False, True])
@pytest.mark.parametrize("prefix", [False, True])
def test_compiled_character_maps(tmp_path, rule, squeeze, prefix):
    model, other = proto.ModelProto(), proto.ModelProto()
    with open(PATH, "rb") as f:
        model.ParseFromString(f.read())
    other.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto())
    model.normalizer_spec.precompiled_charsmap = other.normalizer_spec.precompiled_charsmap
    model.normalizer_spec.remove_extra_whitespaces, model.normalizer_spec.add_dummy_prefix = squeeze, prefix
    path = tmp_path / "own.model"
    path.write_bytes(model.SerializeToString())
    check(str(path), ODD)


def test_tables(frame):
    rows = [(i, t) for i, t in enumerate([*ODD, None])] + [(3, ODD[3])]
    encoded = encode(frame(rows), PATH)
    back = decode(encoded, PATH)
    assert sorted((r.doc_id, r.text) for r in back.collect()) == sorted((i, (t or "").replace("▁", " ")) for i, t in rows)
    assert encode(frame([]), PATH).count() == 0 and encoded.where("size(starts) <> size(ids) - 1").count() == 0
    odd_ids = frame([(1, "x")]).selectExpr("doc_id", "CAST(NULL AS array<int>) ids")
    assert decode(odd_ids, PATH).first().text == ""


def test_query_against_the_library(spark, small):
    whole = sentencepiece.SentencePieceProcessor(model_file=PATH)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = QUERIES["op8_sentencepiece"](spark, small).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = whole.encode(texts[r.doc_id] or "", add_eos=True)
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), digest(" ".join(map(str, ids))), digest(whole.decode(ids)))
