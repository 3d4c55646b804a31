"""SentencePiece encoding that keeps offsets, and decoding.

A text is normalised by longest prefixes through the model's compiled character map; every
byte of the result remembers where it came from. The normalised text is cut wherever no
piece of the vocabulary reaches over, each distinct chunk is segmented once by the
library (with a model whose own normaliser does nothing), and the pieces' lengths laid end
to end project every piece to a span of the original bytes.

Inside, the normalised text holds a space for the library's space sign.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm._text import ChunkCodes, gather, small_batches, text_bytes, windows, worker_store

SPACE_SIGN = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # piece types of the model file
BPE = 2  # model type of the model file


class CharacterMap:
    """The compiled character map: a double-array trie over source bytes, and the strings it leads to."""

    def __init__(self, compiled: bytes):
        size = int.from_bytes(compiled[:4], "little") if compiled else 0
        self.units = np.frombuffer(compiled[4 : 4 + size], "<u4").tolist()
        self.strings = compiled[4 + size :]

    def __bool__(self) -> bool:
        return bool(self.units)

    def longest(self, data: bytes, at: int) -> tuple[bytes, int] | None:
        """What the longest mapped prefix of ``data[at:]`` becomes, and its length; None without one."""
        units, found = self.units, None
        unit = units[0]
        place = self._offset(unit)
        for i in range(at, len(data)):
            byte = data[i]
            place ^= byte
            if place >= len(units):
                break
            unit = units[place]
            if unit & 0x800000FF != byte:
                break
            place ^= self._offset(unit)
            if unit >> 8 & 1:
                begin = units[place] & 0x7FFFFFFF
                found = (self.strings[begin : self.strings.index(b"\0", begin)], i + 1 - at)
        return found

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 1 << 9) >> 6)


class Codec:
    """One model file: ``encode`` gives ids and spans, ``decode`` text, both for many rows at once."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        with open(path, "rb") as f:
            raw = f.read()
        model = proto.ModelProto()
        model.ParseFromString(raw)
        spec = model.normalizer_spec
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.prefix, self.squeeze = spec.add_dummy_prefix, spec.remove_extra_whitespaces
        self.suffix = model.trainer_spec.treat_whitespace_as_suffix
        self.whole = sentencepiece.SentencePieceProcessor(model_proto=raw)
        types = np.array([p.type for p in model.pieces])
        self.end_id, self.types = self.whole.eos_id(), types
        self.symbols = sorted((p.piece.encode() for p in model.pieces if p.type == USER_DEFINED), key=len, reverse=True)
        spec.precompiled_charsmap, spec.add_dummy_prefix, spec.remove_extra_whitespaces = b"", False, False
        self.plain = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        surface = [self._surface(p) for p in model.pieces]
        self.surface, self.surface_at, self.surface_len = self._table(surface)
        self.decimal, self.decimal_at, self.decimal_len = self._table([b"%d " % i for i in range(len(surface))])
        # A library that falls back to bytes never joins pieces of different chunks.
        self.cut = model.trainer_spec.model_type == BPE and model.trainer_spec.byte_fallback
        self.reaching = np.zeros((256, 256), bool)
        for p in model.pieces:
            if p.type in (NORMAL, USER_DEFINED, UNUSED):
                letters = [c.encode() for c in p.piece.replace(SPACE_SIGN, " ")]
                for a, b in zip(letters, letters[1:]):
                    self.reaching[a[-1], b[0]] = True
        self.codes = ChunkCodes(lambda chunks: self.plain.encode([c.replace(" ", SPACE_SIGN) for c in chunks], num_threads=1))

    @staticmethod
    def _surface(piece) -> bytes:
        if piece.type == BYTE:
            return bytes([int(piece.piece[1:-1], 16)])
        return b"" if piece.type == CONTROL else piece.piece.replace(SPACE_SIGN, " ").encode()

    @staticmethod
    def _table(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lengths = np.array([len(s) for s in strings], np.int32)
        return np.frombuffer(b"".join(strings), np.uint8), (np.cumsum(lengths) - lengths).astype(np.int32), lengths

    def normalised(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Normalised bytes of all rows, their bounds, and for each byte (and a last one) where it came from."""
        signs = data == 0xE2
        special = bool(self.map or self.symbols or self.squeeze or self.suffix) or (
            signs.any() and bool(((data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81)).any())
        )
        if special:
            raw = data.tobytes()
            rows = [self._normalised_row(raw[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            text = np.frombuffer(b"".join(r[0] for r in rows), np.uint8)
            came = np.concatenate([np.asarray(r[1], np.int64) + a for r, a in zip(rows, bounds[:-1], strict=True)] + [[0]])
            return text, np.concatenate(([0], np.cumsum([len(r[0]) for r in rows]))).astype(np.int64), came
        added = (np.diff(bounds) > 0) & self.prefix
        before = np.concatenate(([0], np.cumsum(added)))
        at = bounds[:-1][added]
        text = np.insert(data, at, 0x20)
        came = np.insert(np.arange(len(data)), at, at)
        return text, bounds + before, np.append(came, 0)

    def _normalised_row(self, raw: bytes) -> tuple[bytes, list[int]]:
        out, came, at = bytearray(), [], 0
        if self.squeeze:
            while at < len(raw):
                piece, n = self._prefix(raw, at)
                if piece != b" ":
                    break
                at += n
        if at == len(raw):
            return b"", []
        if self.prefix and not self.suffix:
            out += b" "
            came.append(at)
        space = self.squeeze
        while at < len(raw):
            piece, n = self._prefix(raw, at)
            if space:
                piece = piece.lstrip(b" ")
            if piece:
                space = self.squeeze and piece.endswith(b" ")
                piece = piece.replace(SPACE_SIGN.encode(), b" ")  # a sign in the text is a space, but not one to squeeze
                out += piece
                came += [at] * len(piece)
            at += n
        if self.squeeze:
            kept = len(out.rstrip(b" "))
            del out[kept:], came[kept:]
        if self.prefix and self.suffix:
            out += b" "
            came.append(at)
        return bytes(out), came

    def _prefix(self, raw: bytes, at: int) -> tuple[bytes, int]:
        for symbol in self.symbols:
            if raw.startswith(symbol, at):
                return symbol, len(symbol)
        found = self.map.longest(raw, at) if self.map else None
        if found is None:
            lead = raw[at]
            n = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            found = (raw[at : at + n], n)
        return found

    def encode(self, data: np.ndarray, bounds: np.ndarray, spans: bool = True):
        """Ids of all rows laid end to end, each row's number, and (start, end) of every piece in its row's bytes.

        A piece of several source bytes covers them all; an inserted space covers none."""
        text, edges, came = self.normalised(data, bounds)
        first = np.zeros(len(text) + 1, bool)
        first[edges] = True
        if self.cut and len(text) > 1:
            inner = (text[1:] & 0xC0) == 0x80  # never between the bytes of one character
            first[1:-1] |= ~self.reaching[text[:-1], text[1:]] & ~inner
        starts = np.flatnonzero(first[:-1])
        ids, per = self.codes.ids_of(text, starts, np.append(starts[1:], len(text)))
        total = np.concatenate(([0], np.cumsum(per, dtype=np.int64)))
        at = total[np.searchsorted(starts, edges)]
        counts = np.diff(at)
        if not spans:
            return ids, counts, None, None
        sizes = self.surface_len[ids].astype(np.int64)
        if (self.types[ids] == UNKNOWN).any():  # an unknown piece is as long as what it stands for
            sizes = self._unknown_sizes(ids, sizes, per, starts, text)
        stops = np.cumsum(sizes)
        row = np.repeat(bounds[:-1], counts)
        ends_row = np.repeat(bounds[1:], counts)
        begin = came[stops - sizes]
        end = np.where(stops == np.repeat(edges[1:], counts), ends_row, came[np.minimum(stops, len(came) - 1)])
        return ids, counts, begin - row, end - row

    def _unknown_sizes(self, ids: np.ndarray, sizes: np.ndarray, per: np.ndarray, starts: np.ndarray, text: np.ndarray) -> np.ndarray:
        """Lengths with those of unknown pieces, for which the library is asked what they stand for."""
        sizes, at, raw = sizes.copy(), 0, text.tobytes()
        for k, (a, b) in enumerate(zip(starts.tolist(), [*starts[1:].tolist(), len(raw)], strict=True)):
            m = int(per[k])
            if (self.types[ids[at : at + m]] == UNKNOWN).any():
                parts = self.plain.encode(raw[a:b].decode().replace(" ", SPACE_SIGN), return_type="proto").pieces
                sizes[at : at + m] = [len(p.surface.replace(SPACE_SIGN, " ").encode()) for p in parts]
            at += m
        return sizes

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """Each row's text, as the library's decode gives it for the row's ids."""
        stops = np.cumsum(counts)
        if (self.types[ids] == UNKNOWN).any():
            return [self.whole.decode(ids[a:b].tolist()).encode() for a, b in zip(stops - counts, stops, strict=True)]
        sizes = self.surface_len[ids]
        flat = gather(self.surface, self.surface_at[ids], sizes)
        edges = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))[np.concatenate(([0], stops))]
        raw, out = flat.tobytes(), []
        for i, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
            text = raw[a:b]
            if self.squeeze and text[:2] == b"  ":  # signs that stood in the text: how many go depends on the pieces
                out.append(self.whole.decode(ids[stops[i] - counts[i] : stops[i]].tolist()).encode())
                continue
            out.append(text[1:] if text[:1] == b" " and (self.prefix or self.squeeze) and not self.suffix else text)
        return out

    def decimals(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """Each row's ids in decimal, joined by spaces."""
        sizes = self.decimal_len[ids]
        raw = gather(self.decimal, self.decimal_at[ids], sizes).tobytes()
        edges = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))[np.concatenate(([0], np.cumsum(counts)))].tolist()
        return [raw[a : max(a, b - 1)] for a, b in zip(edges, edges[1:])]

    def with_end(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out = np.full(len(ids) + len(counts), self.end_id, np.int32)
        out[np.arange(len(ids)) + np.repeat(np.arange(len(counts)), counts)] = ids
        return out, counts + 1


def codec(path: str) -> Codec:
    """The worker's codec for this model file, with the chunks it has met so far."""
    store = worker_store()
    if ("piece", path) not in store:
        store["piece", path] = Codec(path)
    return store["piece", path]


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", spans: bool = True, digests: bool = False) -> DataFrame:
    """Per document: doc_id, ids (the end id last); with ``spans`` also starts and ends, byte offsets
    of every piece but the end in the original text; with ``digests`` n_tokens, ids_sha256
    and decoded_sha256 in place of them.

    NULL and empty texts give the end id alone. Texts are encoded whole; repeated rows give
    repeated rows, an empty table none. Other columns are not read."""
    schema = "doc_id long, " + ("n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>" + (", starts array<long>, ends array<long>" if spans else ""))

    def listed(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(values, kind))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for batch in batches:
            data, bounds = text_bytes(batch.column(1))
            for i, j in windows(bounds):
                ids, counts, starts, ends = own.encode(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], spans and not digests)
                full, sizes = own.with_end(ids, counts)
                if digests:
                    columns = [
                        pa.array(sizes, pa.int64()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in own.decimals(full, sizes)]),
                        pa.array([hashlib.sha256(x).hexdigest() for x in own.decode(full, sizes)]),
                    ]
                else:
                    columns = [listed(full, sizes, pa.int32())]
                    if spans:
                        columns += [listed(starts, counts, pa.int64()), listed(ends, counts, pa.int64())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *columns], [f"c{k}" for k in range(1 + len(columns))])

    return small_batches(docs).select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(encoded, schema)


def decode(encoded: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The text of each row's ids: doc_id, text. NULL or no ids give the empty text."""

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for batch in batches:
            rows = batch.column(1).to_pylist()
            counts = np.array([len(r or ()) for r in rows], np.int64)
            ids = np.fromiter((x for r in rows for x in r or ()), np.int32, int(counts.sum()))
            texts = [t.decode("utf-8", "replace") for t in own.decode(ids, counts)] if len(rows) else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return small_batches(encoded).select(F.col(id_col).cast("long"), ids_col).mapInArrow(decoded, "doc_id long, text string")
