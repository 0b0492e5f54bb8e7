"""Encoding texts with a public tokenizer, cut beforehand where no token can reach across."""

from __future__ import annotations

import base64
import importlib.util
import os
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Folder of the vocabulary files; set it where they lie elsewhere.
TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
BYTE_BPE_50K = "byte_bpe_50k.tiktoken"
# fixed value: the pattern that splits text before the merges of the byte-level vocabularies
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Distinct fragments a worker remembers; when full it starts anew, which costs time but no result.
REMEMBERED = 400_000


class ForcedCuts:
    """A byte-level BPE encoder that encodes fragments between certain cuts.

    Two bytes that never stand next to each other inside any vocabulary token are parted in every encoding: no merge
    leads across. Text is cut between such bytes, the fragments are encoded independently (each distinct one once
    per worker) and the ids concatenated. A cut must not change how the vocabulary's pattern splits the text
    either, so it is made only after an ASCII character that isn't white space, before the first byte of a
    character, and never before an apostrophe (which may open a contraction).
    """

    def __init__(self, path: str, pattern: str = PATTERN):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding(os.path.basename(path), pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        together = np.zeros((256, 256), dtype=bool)
        for token in ranks:
            for a, b in zip(token, token[1:]):
                together[a, b] = True
        left = np.zeros(256, dtype=bool)
        left[33:127] = True
        right = np.ones(256, dtype=bool)
        right[0x80:0xC0] = False  # continuation bytes
        right[ord("'")] = False
        self.cut = (~together & left[:, None] & right[None, :]).ravel()
        self.known: dict[bytes, list[int]] = {}
        #: bytes of each token
        self.lengths = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, rank in ranks.items():
            self.lengths[rank] = len(token)

    def cuts(self, data: bytes) -> list[int]:
        """Byte offsets of the certain cuts, with 0 and the end; data isn't empty."""
        b = np.frombuffer(data, dtype=np.uint8)
        pairs = b[:-1].astype(np.int32) * 256 + b[1:]
        return [0, *(np.flatnonzero(self.cut[pairs]) + 1).tolist(), len(data)]

    def fragment(self, piece: bytes) -> list[int]:
        ids = self.known.get(piece)
        if ids is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            ids = self.bpe.encode_ordinary(piece.decode("utf-8"))
            if len(piece) <= 64:
                self.known[piece] = ids
        return ids

    def fragments(self, data: bytes, at: list[int] | None = None) -> Iterator[list[int]]:
        """The ids of each fragment; at: the cuts, where the caller knows more than the certain ones."""
        at = self.cuts(data) if at is None else at
        known, fragment = self.known, self.fragment
        for a, z in zip(at, at[1:]):
            piece = data[a:z]
            yield known[piece] if piece in known else fragment(piece)

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text without special tokens; none for null and empty text."""
        if not text:
            return []
        out: list[int] = []
        for ids in self.fragments(text.encode("utf-8", "surrogatepass")):
            out += ids
        return out

    def count(self, text: str | None) -> int:
        return sum(map(len, self.fragments(text.encode("utf-8", "surrogatepass")))) if text else 0


def encoder(path: str) -> ForcedCuts:
    """One encoder per worker process and file, kept from task to task."""
    kept = sys.__dict__.setdefault("_corroborate_encoders", {})
    if path not in kept:
        kept[path] = ForcedCuts(path)
    return kept[path]


def tokenizer_path(name: str = BYTE_BPE_50K, folder: str = TOKENIZERS) -> str:
    """The vocabulary file: in folder, or else where the package public_tokenizers lies."""
    path = os.path.join(folder, name)
    if not os.path.exists(path) and (spec := importlib.util.find_spec("public_tokenizers")) and spec.origin:
        path = os.path.join(os.path.dirname(spec.origin), name)
    return path


def token_ids(text: Column, path: str) -> Column:
    """ARRAY<INT>: the ids of each text; an empty array for null and empty text."""

    def run(texts: pa.Array) -> pa.Array:
        encode = encoder(path).encode
        return pa.array([encode(t) for t in texts.to_pylist()], type=pa.list_(pa.int32()))

    return F.arrow_udf(run, "array<int>")(text)


def token_counts(text: Column, path: str) -> Column:
    """BIGINT: how many ids each text has; 0 for null and empty text."""

    def run(texts: pa.Array) -> pa.Array:
        count = encoder(path).count
        return pa.array([count(t) for t in texts.to_pylist()], type=pa.int64())

    return F.arrow_udf(run, "bigint")(text)


def encode_corpus(documents: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids) of every document. No shuffle: every row is encoded where it is read, and a repeated doc_id
    gives a row each time. Very long texts are encoded fragment by fragment, in time linear in their length unless
    they hold a run without any certain cut, which the vocabulary's own merge loop then encodes as one fragment."""
    return documents.select("doc_id", token_ids(F.col("text"), path or tokenizer_path()).alias("ids"))
