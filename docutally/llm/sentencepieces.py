"""SentencePiece encoding and decoding on the tokenizers library.

Method: the model's protobuf is parsed field by field; from it the backend is rebuilt: normaliser (white-space rules and
the precompiled character map), the metaspace marker, the unigram scores, or for a BPE model the merges in the order of the
scores of what they make, and byte fallback. Texts are encoded in multithreaded batches. Where no piece holds a
marker behind another character, a text is encoded by segments that begin with the marker, each distinct one once a worker.
Parity: every distinct segment is encoded by the sentencepiece library too and both are compared; the
result counts differences per document.

Scale: map-only. What a worker keeps is bounded by ``KEPT`` segments.

Defined results: null text counts as empty and has no ids; rows that share an id are encoded each; a text is
decoded to its normalised form, a marker of its own to a space (the library drops leading ones); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docutally.llm.common import text_or_empty, worker_cache

MARK = "▁"
#: Segments that a worker remembers at most before it starts anew.
KEPT = 400_000

# --- Fixed values: field numbers and types of the model file -------------------------
PIECES, TRAINER, NORMALIZER = 1, 2, 3
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def fields(data: bytes):
    """(field number, value) of one protobuf message; nested messages come as bytes."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        elif key & 7 == 1:
            yield key >> 3, struct.unpack_from("<d", data, at)[0]
            at += 8
        elif key & 7 == 5:
            yield key >> 3, struct.unpack_from("<f", data, at)[0]
            at += 4
        else:
            size = varint()
            yield key >> 3, data[at : at + size]
            at += size


class Model:
    """What a model file says."""

    def __init__(self, data: bytes):
        self.pieces, trainer, normalizer = [], {}, {}
        for number, value in fields(data):
            if number == PIECES:
                own = dict(fields(value))
                self.pieces.append((own[1].decode("utf-8"), own.get(2, 0.0), own.get(3, NORMAL)))
            elif number == TRAINER:
                trainer = dict(fields(value))
            elif number == NORMALIZER:
                normalizer = dict(fields(value))
        self.kind = trainer.get(3, UNIGRAM)
        self.byte_fallback = bool(trainer.get(35, 0))
        self.charsmap = normalizer.get(2, b"")
        self.dummy_prefix = bool(normalizer.get(3, 1))
        self.trim = bool(normalizer.get(4, 1))
        self.unknown = next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)
        #: Whether segments that begin with the marker can be encoded one by one.
        self.separable = not any(re.search(f"[^{MARK}]{MARK}", p) for p, _, kind in self.pieces if kind in (NORMAL, USER_DEFINED))

    def tokenizer(self):
        """The backend: model and decoder. Normalising is left to :meth:`normalised`."""
        from tokenizers import Tokenizer, decoders, models

        if self.kind == UNIGRAM:
            model = models.Unigram([(p, s) for p, s, _ in self.pieces], self.unknown, self.byte_fallback)
        else:
            vocab = {p: i for i, (p, _, _) in enumerate(self.pieces)}
            rank = {p: (-s, i) for i, (p, s, kind) in enumerate(self.pieces) if kind in (NORMAL, USER_DEFINED)}
            merges = sorted((rank[p], k, p) for p in rank for k in range(1, len(p)) if p[:k] in rank and p[k:] in rank)
            model = models.BPE(vocab, [(p[:k], p[k:]) for _, k, p in merges], unk_token=self.pieces[self.unknown][0], fuse_unk=True, byte_fallback=self.byte_fallback)
        out = Tokenizer(model)
        steps = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
        out.decoder = decoders.Sequence([*steps, decoders.Strip(" ", 1, 0)] if self.dummy_prefix else steps)
        return out

    def normalised(self, text: str, charsmap=None) -> str:
        """Text with the marker for spaces, as the model's pieces spell it."""
        if charsmap is not None:
            text = charsmap.normalize_str(text)
        if self.trim:
            text = re.sub(" +", " ", text.strip(" "))
        if not text:
            return ""
        return (MARK if self.dummy_prefix else "") + text.replace(" ", MARK)


def _loaded(name: str):
    """(model, backend, character map, sentencepiece processor, remembered segments), once a worker."""
    have = worker_cache().get(name)
    if have is None:
        import public_tokenizers
        import sentencepiece
        from tokenizers import normalizers

        path = public_tokenizers.path(name)
        with open(path, "rb") as file:
            model = Model(file.read())
        charsmap = normalizers.Precompiled(model.charsmap) if model.charsmap else None
        have = worker_cache()[name] = (model, model.tokenizer(), charsmap, sentencepiece.SentencePieceProcessor(model_file=path), {})
    return have


_SEGMENT = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


def encode_texts(texts: list[str], name: str) -> list[tuple[np.ndarray, str, int, str]]:
    """(ids, normalised text, segments on which both libraries differ, the ids decoded) of each text."""
    model, backend, charsmap, other, known = _loaded(name)
    if len(known) > KEPT:
        known.clear()
    whole = [model.normalised(t, charsmap) for t in texts]
    parts = [_SEGMENT.findall(t) if model.separable else [t] * bool(t) for t in whole]
    fresh = list({s for p in parts for s in p}.difference(known))
    if fresh:
        ours = [e.ids for e in backend.encode_batch_fast(fresh, add_special_tokens=False)]
        # The library adds the marker itself; a segment without one stands at the front of an unmarked text only.
        plain = [s[1:].replace(MARK, " ") if model.dummy_prefix and s[0] == MARK else s.replace(MARK, " ") for s in fresh]
        # A lone marker would be an empty text for it, and where it trims spaces runs of markers are out of its
        # reach; these are not compared.
        theirs = other.encode(plain)
        back = backend.decode_batch(ours, skip_special_tokens=False)
        for s, a, b, spoken in zip(fresh, ours, theirs, back):
            same = a == b or s == MARK or (model.trim and MARK in s[1:]) or s[0] != MARK
            known[s] = (np.array(a, "<u4").tobytes(), not same, spoken)
    out = []
    for text, segments in zip(whole, parts):
        found = [known[s] for s in segments]
        # Decoding drops the space that a leading marker stands for: between segments it comes back.
        spoken = (" " if model.dummy_prefix else "").join([f[2] for f in found])
        out.append((np.frombuffer(b"".join([f[0] for f in found]), "<u4"), text, sum([f[1] for f in found]), spoken))
    return out


def decode_ids(ids: list[list[int]], name: str) -> list[str]:
    _, backend, _, _, _ = _loaded(name)
    return backend.decode_batch(ids, skip_special_tokens=False)


def encode(docs: DataFrame, name: str = "piece_bpe_32k.model", id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Rows (id_col, n_ids, ids_crc32, round_trip, differences), on demand with the ids.

    ``round_trip``: decoding the ids gives the normalised text back. ``differences``: segments on which the
    sentencepiece library disagrees.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    extra = ", ids array<long>" if with_ids else ""
    schema = f"_id {kind}, n_ids long, ids_crc32 long, round_trip boolean, differences long{extra}"

    def run(batches):
        for batch in batches:
            done = encode_texts(batch.column("_text").to_pylist(), name)
            model = _loaded(name)[0]
            spoken = [t[len(MARK) * model.dummy_prefix :].replace(MARK, " ") if t else "" for _, t, _, _ in done]
            arrays = [batch.column("_id"), pa.array([len(d[0]) for d in done], pa.int64()), pa.array([zlib.crc32(d[0].tobytes()) for d in done], pa.int64()), pa.array([a == b for a, b in zip([d[3] for d in done], spoken)], pa.bool_()), pa.array([d[2] for d in done], pa.int64())]
            names = ["_id", "n_ids", "ids_crc32", "round_trip", "differences"]
            if with_ids:
                arrays, names = [*arrays, pa.array([d[0].astype(np.int64) for d in done], pa.list_(pa.int64()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    rows = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text"))
    done = rows.mapInArrow(run, schema)
    return done.select(F.col("_id").alias(id_col), "n_ids", "ids_crc32", "round_trip", "differences", *(["ids"] if with_ids else []))


def op6_sentencepiece(spark, sf_dir: str) -> DataFrame:
    from docutally.llm.common import prepare, table

    return encode(table(prepare(spark), sf_dir, "documents"))
