"""Token ids of whole texts by a tokenizer file, with each distinct chunk encoded once.

The tokenizer splits at white space and never merges across it, so the ids of a text
are the ids of its white-space separated chunks in order. The chunks of a slice are
dictionary-encoded by Arrow. Distinct chunks of plain Latin characters are encoded
together by the merge table in one call; the tokenizers library takes all others.
Both give the same ids: tests hold them against each other.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa

from gavelflow.llm import textkit as K

#: Text bytes that are encoded together; each distinct chunk among them costs once.
SLICE_BYTES = 16 << 20

#: How word_bpe files split a text into words before merging.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}\x00\x01]+"

WORD_END, CHUNK_END = "\x00", "\x01"


def _byte_of_symbol() -> dict[str, int]:
    """The printable stand-ins for bytes that byte-level vocabularies use."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class MergeTable:
    """The file's merges as ranks of byte strings; a word's end is one more byte."""

    def __init__(self, path: str):
        import regex
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        symbol, suffix = _byte_of_symbol(), model["end_of_word_suffix"]

        def raw(token: str) -> bytes:
            end = token.endswith(suffix)
            return bytes(symbol[c] for c in (token[: -len(suffix)] if end else token)) + WORD_END.encode() * end

        # A letter joins its word's end before any other merge; then the file's order.
        order = [bytes([b]) for b in range(256)] + [bytes([b]) + WORD_END.encode() for b in range(2, 256)]
        for merge in model["merges"]:
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            order.append(raw(a) + raw(b))
        ranks = {t: i for i, t in reversed(list(enumerate(order)))}
        self.id_of = np.zeros(len(order), np.int64)
        known = {raw(t): i for t, i in model["vocab"].items() if not t.startswith("<|")}
        for t, i in ranks.items():
            self.id_of[i] = known.get(t, -1)
        self.mark = ranks[CHUNK_END.encode()]
        self.coder = tiktoken.Encoding("words", pat_str=r"[^\x00\x01]+\x00|\x01", mergeable_ranks=ranks, special_tokens={})
        self.words = regex.compile(WORD_PATTERN)

    def encode(self, chunks: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids of each chunk); each chunk is followed by the chunk end."""
        text = self.words.sub(r"\g<0>" + WORD_END, chunks.decode().lower())
        ranks = np.array(self.coder.encode_ordinary(text), np.int64)
        marks = np.flatnonzero(ranks == self.mark)
        ids = self.id_of[np.delete(ranks, marks)]
        return ids.astype(np.uint32), np.diff(marks, prepend=-1) - 1


#: Bytes of U+0021 to U+017E in UTF-8; see plain_chunks() for what is left out.
_PLAIN = np.zeros(256, bool)
_PLAIN[0x21:0x7F] = _PLAIN[0x80:0xC0] = _PLAIN[0xC2:0xC6] = True


def plain_chunks(raw: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Which chunks hold only characters that lower-case and classify alike everywhere:
    no controls, no U+0080 to U+00A0, no dotted I, no opening of a special token."""
    bad = ~_PLAIN[raw]
    if len(raw) > 1:
        a, b = raw[:-1], raw[1:]
        bad[:-1] |= ((a == 0xC2) & (b < 0xA1)) | ((a == 0xC4) & (b == 0xB0)) | ((a == 0x3C) & (b == 0x7C))
    total = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(bad, out=total[1:])
    return total[places[1:]] == total[places[:-1]]


class ChunkEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one thread for each task
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.table = MergeTable(path)

    def distinct(self, raw: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, first id of each chunk and the end) of distinct chunks."""
        plain = plain_chunks(raw, places)
        size = np.diff(places)
        counts = np.zeros(len(size), np.int64)
        ids = np.empty(0, np.uint32)
        if plain.any():
            sizes = size[plain]
            ends = np.cumsum(sizes + 1)
            joined = np.full(int(ends[-1]), ord(CHUNK_END), np.uint8)
            inside = np.ones(len(joined), bool)
            inside[ends - 1] = False
            joined[inside] = raw[K.gathered(sizes, places[:-1][plain])]
            ids, counts[plain] = self.table.encode(joined.tobytes())
        others = np.flatnonzero(~plain)
        if len(others):
            texts = [raw[places[i] : places[i + 1]].tobytes().decode() for i in others.tolist()]
            found = [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
            counts[others] = [len(x) for x in found]
            at = np.repeat(plain, counts)
            out = np.empty(len(at), np.uint32)
            out[at] = ids
            out[~at] = np.fromiter((i for x in found for i in x), np.uint32, int(counts[others].sum()))
            ids = out
        starts = np.zeros(len(size) + 1, np.int64)
        np.cumsum(counts, out=starts[1:])
        return ids, starts

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows one after another, ids of each row)."""
        rows = len(offsets) - 1
        solid = ~K.ASCII_SPACE[raw]
        start, end, row = K.runs(solid, offsets)
        if not len(start):
            return np.empty(0, np.uint32), np.zeros(rows, np.int64)
        places = np.zeros(len(start) + 1, np.int64)
        np.cumsum(end - start, out=places[1:])
        chunks = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(places), pa.py_buffer(raw[solid]))
        coded = chunks.dictionary_encode()
        ids, starts = self.distinct(*K.text_bytes(coded.dictionary))
        slot = coded.indices.to_numpy(zero_copy_only=False)
        counts = np.diff(starts)[slot]
        each = np.bincount(row, weights=counts, minlength=rows).astype(np.int64)
        return ids[K.gathered(counts, starts[slot])], each


@lru_cache(maxsize=4)
def encoder(path: str) -> ChunkEncoder:
    return ChunkEncoder(path)
