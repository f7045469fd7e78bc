"""Byte-level BPE as a monoid: encodings of two halves join into the encoding of the whole.

Merging by rank gives the tokens t1..tn for their concatenated bytes exactly if every two
neighbours give themselves: a merge across a boundary would need only the bytes of the two
tokens beside it. So two encodings join by re-encoding a window around their boundary and
widening it on the side where the token outside and the window's outer token do not give
themselves. Once both sides do, no token outside can change. A string is encoded by halves, and
decoding concatenates up the same tree.

A whole match of the pattern that is itself a token is that token, as in the tiktoken library.

Defined results: a null text is empty and has no tokens; the hashes are those of no bytes; what
spells a special token is plain text; very long texts are encoded whole, match by match, and a very
long match by halves; repeated rows stay repeated; an empty table gives no rows; only doc_id and
text are read, whatever other columns are called.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, row_slices

SLICE_BYTES = 1 << 20
#: Encodings that a worker keeps: of pattern matches and chunks, of short halves, and of pairs of tokens.
KEPT, KEPT_HALVES, SHORT = 400_000, 300_000, 8


class TreeBPE:
    """The encoder of one file of ranks."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.tokens: dict[int, bytes] = {i: t for t, i in self.ranks.items()}
        self.pattern = regex.compile(pattern)
        self.halves: dict[bytes, tuple[int, ...]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.pieces: dict[bytes, tuple[int, ...]] = {}

    def merge(self, data: bytes) -> list[int]:
        """Merges by rank, the lowest and then the leftmost first, until none applies; for windows."""
        if len(data) > 64:
            return self._merge_long(data)
        ranks = self.ranks
        parts = [data[i : i + 1] for i in range(len(data))]
        scores = [ranks.get(a + b) for a, b in zip(parts, parts[1:])]
        while True:
            best, at = None, 0
            for i, s in enumerate(scores):
                if s is not None and (best is None or s < best):
                    best, at = s, i
            if best is None:
                return [ranks[p] for p in parts]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del scores[at]
            if at:
                scores[at - 1] = ranks.get(parts[at - 1] + parts[at])
            if at < len(scores):
                scores[at] = ranks.get(parts[at] + parts[at + 1])

    def _merge_long(self, data: bytes) -> list[int]:
        """The same with a heap over a linked list, in n log n steps."""
        ranks, n = self.ranks, len(data)
        ends, before = list(range(1, n + 1)), list(range(-1, n))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapify(heap)
        alive = [True] * n
        while heap:
            _, i, end = heappop(heap)
            if not alive[i] or ends[i] >= n or ends[ends[i]] != end:
                continue
            gone = ends[i]
            alive[gone], ends[i] = False, end
            if end < n:
                before[end] = i
                if (r := ranks.get(data[i : ends[end]])) is not None:
                    heappush(heap, (r, i, ends[end]))
            if (p := before[i]) >= 0 and (r := ranks.get(data[p:end])) is not None:
                heappush(heap, (r, p, end))
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i : ends[i]]])
            i = ends[i]
        return out

    def stable(self, a: int, b: int) -> bool:
        """Whether two neighbours give themselves."""
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) > KEPT:
                self.pairs.clear()
            known = self.pairs[a, b] = self.merge(self.tokens[a] + self.tokens[b]) == [a, b]
        return known

    def join(self, a: tuple[int, ...], b: tuple[int, ...]) -> tuple[int, ...]:
        """The encoding of two encodings' bytes in a row."""
        if not a or not b:
            return a + b
        if self.stable(a[-1], b[0]):
            return a + b
        left, right, tokens = 1, 1, self.tokens
        while True:
            window = self.merge(b"".join([tokens[t] for t in a[-left:] + b[:right]]))
            good_left = left == len(a) or self.stable(a[-left - 1], window[0])
            good_right = right == len(b) or self.stable(window[-1], b[right])
            if good_left and good_right:
                return a[:-left] + tuple(window) + b[right:]
            if not good_left:
                left = min(2 * left, len(a))
            if not good_right:
                right = min(2 * right, len(b))

    def encode_bytes(self, data: bytes) -> tuple[int, ...]:
        """The tree reduction: halves, then their join."""
        n = len(data)
        if n < 2:
            return (self.ranks[data],) if n else ()
        if n <= SHORT:
            known = self.halves.get(data)
            if known is None:
                if len(self.halves) > KEPT_HALVES:
                    self.halves.clear()
                known = self.halves[data] = self.join(self.encode_bytes(data[: n // 2]), self.encode_bytes(data[n // 2 :]))
            return known
        return self.join(self.encode_bytes(data[: n // 2]), self.encode_bytes(data[n // 2 :]))

    def encode_match(self, data: bytes) -> tuple[int, ...]:
        """One match of the pattern."""
        known = self.pieces.get(data)
        if known is None:
            if len(self.pieces) > KEPT:
                self.pieces.clear()
            whole = self.ranks.get(data)
            known = self.pieces[data] = self.encode_bytes(data) if whole is None else (whole,)
        return known

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for match in self.pattern.findall(text):
            out += self.encode_match(match.encode())
        return out

    def decode(self, ids: list[int]) -> bytes:
        """Bytes of ids, concatenated up the tree."""
        if len(ids) <= 4096:
            return b"".join([self.tokens[i] for i in ids])
        return self.decode(ids[: len(ids) // 2]) + self.decode(ids[len(ids) // 2 :])


#: A space between two characters that are not white space: the pattern starts a match there, whatever surrounds it.
CUT = regex.compile(r"(?<![\s\x1c-\x1f]) (?![\s\x1c-\x1f])")


def chunks(text: str) -> list[str]:
    """text cut before such spaces, which are left out; no match of the pattern crosses a cut."""
    found = text.split(" ")
    if all(found) and not any(map(str.isspace, {x for c in set(found) for x in (c[0], c[-1])})):
        return found
    return CUT.split(text)


def _coder(path: str, pattern: str) -> tuple[TreeBPE, dict[str, bytes], list[bytes]]:
    """The worker's encoder, with the chunks it has encoded (as uint32 bytes) and the ids' decimal numbers."""

    def make():
        coder = TreeBPE(path, pattern)
        return coder, {}, [b"%d" % i for i in range(max(coder.tokens) + 1)]

    return kept(("tree", path, pattern), make)


def encode_ids(text: str, coder: TreeBPE, known: dict[str, bytes]) -> np.ndarray:
    """Ids of a whole text, chunk by chunk; chunks after the first carry their space."""
    if not text:
        return np.zeros(0, "<u4")
    first, *rest = chunks(text)
    new = set(rest).difference(known)
    if len(known) + len(new) > KEPT:
        known.clear()
        new = set(rest)
    for chunk in new:
        known[chunk] = np.array(coder.encode(" " + chunk), "<u4").tobytes()
    return np.frombuffer(np.array(coder.encode(first), "<u4").tobytes() + b"".join(map(known.__getitem__, rest)), "<u4")


def encode(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN, keep_ids: bool = True, keep_text: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids, decoded) for every row of docs.

    path names the file of ranks on the executors; without it, the multilingual one of the
    tokenizer package there. ids and decoded are null unless kept.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, known, decimals = _coder(path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), pattern)
        for rows in row_slices(batches, "text", SLICE_BYTES):
            out = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "ids": [], "decoded": []}
            for text in rows.column(1).to_pylist():
                numbers = encode_ids(text or "", coder, known)
                ids = numbers.tolist()
                decoded = coder.decode(ids)
                out["n_tokens"].append(len(ids))
                out["ids_sha256"].append(hashlib.sha256(b",".join(map(decimals.__getitem__, ids))).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(decoded).hexdigest())
                out["ids"].append(numbers.view(np.int32) if keep_ids else None)
                out["decoded"].append(decoded.decode() if keep_text else None)
            kinds = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string(), "ids": pa.list_(pa.int32()), "decoded": pa.string()}
            yield pa.RecordBatch.from_arrays([rows.column(0), *(pa.array(out[k], t) for k, t in kinds.items())], names=["doc_id", *kinds])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        run, f"doc_id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string, ids array<int>, decoded string"
    )
