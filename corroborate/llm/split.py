"""Splitting oversized texts at natural boundaries, by lexical cohesion."""

from __future__ import annotations

import bisect
import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from corroborate.llm.encode import encoder, tokenizer_path

#: Words on either side of a gap whose likeness is the cohesion there.
BLOCK = 24
#: Pieces end in the last part of their window where a gap lies there, so that none is made needlessly short.
LEAST_FILL = 0.5

_WORD = re.compile(r"\w+")
# where a text lets itself be cut: at the end of a line, or after a sentence with the marks that close it
_GAP = re.compile(r"\n+|[.!?…;][\"')\]”’]*+(?=\s)|[。！？；][。！？；\"')\]”’」』）】》]*+")
# ends of words that the certain cuts may miss: white space of both Python and the tokenizer, next to other than ASCII
_WORD_END = re.compile(r"[^\x00-\x7f\s](?=[^\S\x1c-\x1f])|\S(?=[^\S\x00-\x7f])")


def gap_offsets(text: str) -> list[int]:
    """The line and sentence ends within a text, in characters: each before its white space and after the marks that
    close a sentence, in order."""
    out, last = [], 0
    for m in _GAP.finditer(text):
        c = m.end()
        if text[c - 1] == "\n":
            c = m.start()
            while c > last and text[c - 1].isspace():
                c -= 1
            if c == last:  # more white space of the same gap
                last = m.end()
                continue
            last = m.end()
        if 0 < c < len(text) and (not out or c > out[-1]):
            out.append(c)
    return out


def parts_words(text: str, c: int) -> bool:
    """Whether the tokenizer's pattern starts anew at a gap whatever surrounds it: white space after none, or a letter
    or digit after a mark that opens no contraction."""
    after = text[c]
    return not "\x1c" <= after <= "\x1f" if after.isspace() else after.isalnum() and text[c - 1] != "'"


class Cohesion:
    """How deep the cohesion valley at a gap is: the likeness (cosine of the sets of words) of the blocks of words
    before and after it, seen from the nearest peaks on either side. Likenesses are worked out where they are asked
    for, and once."""

    def __init__(self, text: str, gaps: list[int], block: int = BLOCK):
        low = text.lower()
        found = list(_WORD.finditer(low if len(low) == len(text) else text))
        self.words = [m[0] for m in found]
        self.starts = [m.start() for m in found]
        self.gaps, self.block, self.known = gaps, block, {}

    def like(self, i: int) -> float:
        x = self.known.get(i)
        if x is None:
            p = bisect.bisect_left(self.starts, self.gaps[i])
            a, b = set(self.words[max(0, p - self.block) : p]), set(self.words[p : p + self.block])
            self.known[i] = x = len(a & b) / math.sqrt(len(a) * len(b)) if a and b else 0.0
        return x

    def depth(self, i: int) -> float:
        here = self.like(i)
        up = down = here
        for j in range(i - 1, -1, -1):
            if (like := self.like(j)) <= up:
                break
            up = like
        for j in range(i + 1, len(self.gaps)):
            if (like := self.like(j)) <= down:
                break
            down = like
        return (up - here) + (down - here)

    def deepest(self, lo: int, hi: int) -> int:
        """The gap of lo ... hi - 1 with the deepest valley; of equals the last."""
        return max(range(lo, hi), key=lambda i: (self.depth(i), i))


def split_text(text: str, enc, most: int, overlap: int) -> list[tuple[int, int, int, int]]:
    """(start, end, tokens, shared) of the pieces of a text longer than `most` tokens, in characters; [] for others.

    Tokens are those of the whole text's encoding while cutting; `tokens` is what the piece encoded by itself has,
    and never exceeds `most`. Each piece but the first starts `overlap` tokens before the end of the one before
    (`shared`; a few more where that would part a character, or where a piece ends inside a token). A piece ends at
    the gap (line or sentence end, whatever characters it is between) with the deepest cohesion valley in the last
    half of its window, else at the last gap of the first half, else before the last white space, else at the last
    certain cut, else at the last token that ends a character.
    """
    data = text.encode("utf-8", "surrogatepass")
    if len(data) <= most:
        return []
    at = enc.cuts(data)
    parts = list(enc.fragments(data, at))
    if sum(map(len, parts)) <= most:
        return []
    raw = np.frombuffer(data, dtype=np.uint8)
    whole = np.ones(len(data) + 1, dtype=bool)  # offsets that start a character
    whole[:-1] = (raw & 0xC0) != 0x80
    chars = np.concatenate(([0], np.cumsum(whole[:-1])))  # characters before each byte
    byte_of_char = np.flatnonzero(whole)
    gap_chars = gap_offsets(text)
    gap_bytes = byte_of_char[np.asarray(gap_chars, dtype=np.int64)].tolist()
    # where the pattern starts anew no token reaches across either, so the fragments may be cut there too
    new = {z for c, z in zip(gap_chars, gap_bytes) if parts_words(text, c)}
    if not text.isascii():
        new.update(byte_of_char[np.asarray([m.end() for m in _WORD_END.finditer(text)], dtype=np.int64)].tolist())
    if not new.issubset(at):
        at = sorted(new.union(at))
        parts = list(enc.fragments(data, at))
    cut_tokens = [0, *itertools.accumulate(map(len, parts))]  # tokens before each cut
    total = cut_tokens[-1]
    overlap = max(0, min(overlap, most // 2))
    ids = list(itertools.chain.from_iterable(parts))
    lengths = enc.lengths[np.asarray(ids, dtype=np.int64)]
    byte = np.concatenate(([0], np.cumsum(lengths)))  # where each token starts
    # the tokens that start before each gap; where it lies inside a token that one counts
    gap_tokens = np.searchsorted(byte, gap_bytes).tolist()
    cohesion = Cohesion(text, gap_chars)

    def alone(a: int, z: int) -> int:
        return len(enc.encode(data[a:z].decode("utf-8", "surrogatepass")))

    pieces = []
    start, ended = 0, 0  # tokens where the piece starts and where the one before ended
    while True:
        first = bisect.bisect_left(cut_tokens, start)
        a = int(byte[start])
        # the part of a fragment a piece starts with may have more tokens by itself than in the text
        head = data[a : at[first]]
        extra = (len(enc.bpe.encode_ordinary(head.decode("utf-8", "surrogatepass"))) - (cut_tokens[first] - start)) if head else 0
        limit = start + most - max(0, extra)

        def count(z: int) -> int:
            """Tokens of the piece by itself if it ends at byte z."""
            i = bisect.bisect_right(at, z) - 1
            if i < first:
                return alone(a, z)
            return cut_tokens[i] - start + extra + (alone(at[i], z) if at[i] < z else 0)

        if total <= limit:
            end, z = total, len(data)
        else:
            past = max(ended, start + overlap) + 1  # a piece has to bring something new
            least = max(past, int(start + most * LEAST_FILL))
            end = z = 0
            lo, hi = bisect.bisect_left(gap_tokens, least), bisect.bisect_right(gap_tokens, limit)
            if lo < hi:
                i = cohesion.deepest(lo, hi)
                if count(gap_bytes[i]) > most:  # inside a token: the next deepest that fits
                    i = next((j for j in sorted(range(lo, hi), key=lambda j: (-cohesion.depth(j), -j)) if count(gap_bytes[j]) <= most), -1)
                if i >= 0:
                    end, z = gap_tokens[i], gap_bytes[i]
            if not end:
                i = next((j for j in range(lo - 1, bisect.bisect_left(gap_tokens, past) - 1, -1) if count(gap_bytes[j]) <= most), -1)
                if i >= 0:
                    end, z = gap_tokens[i], gap_bytes[i]
            if not end:
                i = bisect.bisect_right(cut_tokens, limit) - 1
                spaces = i
                while spaces > 0 and cut_tokens[spaces] >= least and not text[chars[at[spaces]] : chars[at[spaces]] + 1].isspace():
                    spaces -= 1
                for j in (spaces, i):
                    if j > 0 and cut_tokens[j] > max(ended, start + overlap):
                        end, z = cut_tokens[j], at[j]
                        break
            if not end:  # one long fragment
                end = limit
                while end > start + 1 and (not whole[byte[end]] or alone(a, int(byte[end])) > most):
                    end -= 1
                z = int(byte[end])
        pieces.append((int(chars[a]), int(chars[z]), count(z), ended - start))
        if end >= total:
            return pieces
        ended = end
        # a piece that ends inside a token is followed from that token's start at the latest
        last = end if byte[end] == z else end - 1
        start = min(max(last - overlap, start + 1), last)
        while start > 0 and not whole[byte[start]]:
            start -= 1


def split_documents(documents: DataFrame, limits: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, piece_no, start_char, end_char, n_tokens, shared_tokens, text): the pieces of every text that is
    longer than its source's max_tokens; shorter ones, null texts and those of a source without a limit give none.

    No shuffle: limits is a fixed table of a few sources and is broadcast; each text is cut where it is read, whole,
    in time linear in its length. piece_no counts from 1; the pieces without their shared parts make up the text.
    Rows that repeat a doc_id are cut each by itself.
    """
    path = path or tokenizer_path()
    doc_type = to_arrow_type(documents.schema["doc_id"].dataType)
    schema = pa.schema([("doc_id", doc_type), ("piece_no", pa.int32()), ("start_char", pa.int32()), ("end_char", pa.int32()), ("n_tokens", pa.int32()), ("shared_tokens", pa.int32()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            rows = []
            for i, t, m, o in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "max_tokens", "overlap_tokens"))):
                for n, (a, z, tokens, shared) in enumerate(split_text(t, enc, m, o or 0), 1):
                    rows.append((i, n, a, z, tokens, shared, t[a:z]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    known = limits.where("source is not null and max_tokens > 0").groupBy("source").agg(F.min("max_tokens").alias("max_tokens"), F.min_by("overlap_tokens", "max_tokens").alias("overlap_tokens"))
    # a text has at most as many tokens as bytes
    long = documents.select("doc_id", "source", "text").join(F.broadcast(known), "source").where(F.octet_length("text") > F.col("max_tokens"))
    return long.select("doc_id", "text", "max_tokens", "overlap_tokens").mapInArrow(run, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, piece_no int, start_char int, end_char int, n_tokens int, shared_tokens int, text string")
