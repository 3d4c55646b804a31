import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from inkwell.llm._text import ChunkCodes, runs, span_hashes, text_bytes, windows
from inkwell.llm._tokenizer import ByteBpe

ODD = ["a  b", "  x  y\n\n z", "don't 's a'll", "　 全角 空白", "<|endoftext|> hi", "a \n b", "x\ty z", "é è  ü", "", "\n", " ", "a", "😀 😀\n😀",
       "नमस्ते दुनिया", "a\x1c b", "1 2\n3", "a\x85 b", "Ā́ b", "x ́y", "a.b,c!d 'e", "word," * 50, "x" * 5000, None]


def test_spans_hash_alike_wherever_they_stand():
    data, bounds = text_bytes(pa.array(["one two one", "two", None, "xtwo"]))
    starts, ends = runs(data != 32, bounds)
    h = span_hashes(data, starts, ends)
    assert h[0] == h[2] and h[1] == h[3] and len(set(h.tolist())) == 3


def test_windows_cover_all_rows_once():
    bounds = np.array([0, 5, 5, 50, 51, 60])
    assert [r for i, j in windows(bounds, 10, 2) for r in range(i, j)] == [0, 1, 2, 3, 4]


def test_chunk_codes_survive_growth_and_clearing():
    codes = ChunkCodes(lambda chunks: [[len(c)] * len(c) for c in chunks], limit=50)
    for n in range(1, 200, 7):
        text = ("w" * n + " ").encode() * 3
        data = np.frombuffer(text, np.uint8)
        starts, ends = runs(data != 32, np.array([0, len(data)]))
        ids, counts = codes.ids_of(data, starts, ends)
        assert counts.tolist() == [n] * 3 and ids.tolist() == [n] * 3 * n


@pytest.mark.parametrize("repeat", [1, 3])
def test_ids_are_the_tokenizers_own(repeat):
    encoder = ByteBpe(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ODD * repeat
    data, bounds = text_bytes(pa.array(texts, pa.string()))
    ids, counts = encoder.ids(data, bounds)
    expected = [e.ids for e in encoder.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    ends = np.cumsum(counts)
    assert [ids[e - c : e].tolist() for e, c in zip(ends, counts, strict=True)] == expected
