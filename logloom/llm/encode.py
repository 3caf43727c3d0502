"""Token ids of whole texts, by forced-boundary splitting.

A byte pair that occurs inside no token of the vocabulary can't be merged over,
so a text may be cut there and the fragments encoded by themselves.  The pairs
are found from the vocabulary, once a worker.  Three kinds of places are left
uncut although no token spans them, since the splitting pattern looks around
itself there: after white space, before an apostrophe, and inside a character.
Fragments are mostly a word long and recur, so each worker keeps the ids of
those it has seen and a fragment is encoded once, not once an occurrence.

A null or empty text gives an empty list.  Texts are never cut short; a batch
is worked through in slices of bounded size, so long texts don't add up.
"""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text worked on at once, fragments kept by a worker, and the longest fragment that is kept.
SLICE_BYTES, KEPT, KEPT_BYTES = 4 << 20, 200_000, 64
#: Last bytes of white space characters in UTF-8, and the separators that some patterns count as white space.
_SPACE_ENDS = [*range(0x09, 0x0E), *range(0x1C, 0x21), *range(0x80, 0x8B), 0x8E, 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]


def tokenizer_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """The installed vocabulary file ``name``; LOGLOOM_TOKENIZERS names another folder."""
    folder = os.environ.get("LOGLOOM_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of byte strings by one vocabulary file of ranks."""

    def __init__(self, path: str) -> None:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.whole = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        joined = np.zeros((256, 256), bool)
        for token in ranks:
            b = np.frombuffer(token, np.uint8)
            joined[b[:-1], b[1:]] = True
        self.cuts = ~joined
        self.cuts[_SPACE_ENDS, :] = False
        self.cuts[:, 0x27] = False
        self.cuts[:, 0x80:0xC0] = False
        self.flat = self.cuts.reshape(-1)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.lists: list[np.ndarray] = []

    def fragments(self, data: bytes) -> list[bytes]:
        b = np.frombuffer(data, np.uint8)
        at = np.flatnonzero(self.flat[(b[:-1].astype(np.uint16) << 8) | b[1:]]) + 1
        # 0xFF never occurs in UTF-8, so it can stand at the cuts.
        return np.insert(b, at, 0xFF).tobytes().split(b"\xff")

    def _place(self, fragment: bytes) -> int:
        ids = np.asarray(self.whole.encode_ordinary(fragment.decode("utf-8")), np.int32)
        self.lists.append(ids)
        if len(fragment) <= KEPT_BYTES:
            self.known[fragment] = len(self.lists) - 1
        return len(self.lists) - 1

    def many(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, and where each text's ids begin (one more than texts)."""
        if len(self.lists) > KEPT:
            self._forget()
        known, place = self.known, self._place
        picked: list[int] = []
        bounds = [0]
        for text in texts:
            if text:
                for fragment in self.fragments(text):
                    i = known.get(fragment)
                    picked.append(place(fragment) if i is None else i)
            bounds.append(len(picked))
        if not picked:
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        index = np.asarray(picked)
        used, back = np.unique(index, return_inverse=True)
        parts = [self.lists[i] for i in used]
        sizes = np.asarray([len(p) for p in parts])
        firsts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        flat, n = np.concatenate(parts), sizes[back]
        ends = np.concatenate([[0], np.cumsum(n)])
        taken = np.repeat(firsts[back] - ends[:-1], n) + np.arange(ends[-1])
        return flat[taken], ends[np.asarray(bounds)]

    def one(self, text: str | None) -> list[int]:
        ids, _ = self.many([None if text is None else text.encode("utf-8")])
        return ids.tolist()


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _slices(column: pa.Array) -> Iterator[list[bytes | None]]:
    out, held = [], 0
    for cell in column:
        text = cell.as_py()
        out.append(text)
        held += len(text or b"")
        if held >= SLICE_BYTES:
            yield out
            out, held = [], 0
    if out:
        yield out


def encode(df: DataFrame, text: str, out: str = "ids", path: str | None = None, counts_only: bool = False) -> DataFrame:
    """``df`` without ``text``, with ``out``: its ids (or, with ``counts_only``, how many).

    All other columns are kept; one that is called ``out`` already gives way.
    """
    path = path or tokenizer_path()
    kept = [c for c in df.columns if c not in (text, out)]
    kind = T.IntegerType() if counts_only else T.ArrayType(T.IntegerType(), False)
    schema = T.StructType([*[df.schema[c] for c in kept], T.StructField(out, kind, False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            done = 0
            texts = batch.column(text).cast(pa.large_binary())
            others = batch.select(kept)
            for part in _slices(texts):
                ids, ends = own.many(part)
                if counts_only:
                    made: pa.Array = pa.array(np.diff(ends).astype(np.int32))
                else:
                    made = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids, pa.int32()))
                piece = others.slice(done, len(part))
                yield pa.RecordBatch.from_arrays([*piece.columns, made], names=[*kept, out])
                done += len(part)

    return df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`")).mapInArrow(run, schema)


def token_counts(df: DataFrame, key: str, text: str, path: str | None = None) -> DataFrame:
    """``key, n_tokens`` of each row."""
    return encode(df.select(key, text), text, "n_tokens", path, counts_only=True)
