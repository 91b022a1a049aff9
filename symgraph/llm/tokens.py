"""Token ids of whole texts by the tokenizers library, each distinct chunk encoded once.

Byte-level BPE first cuts a text into pieces by a pattern and merges within pieces only. A text may therefore be cut
before any space, line feed or punctuation run that can't share a piece with what precedes it, and the chunks encoded
alone: the ids are those of the whole text. Texts where that isn't so (two white-space characters in a row, control
marks) are encoded whole.
"""

from __future__ import annotations

import os
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACE = r"[\s\x0b\x0c\x1c-\x1f\x85\p{Z}]"
#: Two white spaces in a row, or the mark itself, in any text.
_WHOLE = rf"{_SPACE}{_SPACE}|\x01"
#: A letter, then punctuation that starts a piece of its own.
_CUT = r"(\p{L})([!-&(-/:-@\[-`{-~])"


def _byte_marks() -> dict[int, str]:
    """The printable character that byte-level BPE writes for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


_MARKS = _byte_marks()


class Encoder:
    def __init__(self, path: str, most: int = 350_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model, self.most = self.tokenizer.model, most
        self._renew({})

    def _renew(self, old: dict) -> None:
        """The younger half of the cache becomes the older one."""
        self.old, self.young = old, {}

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        run = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        return [np.array(e.ids, np.uint32) for e in run(texts, add_special_tokens=False)]

    def _lookup(self, keys: list[str]) -> list[bytes]:
        young, old = self.young, self.old
        found = [young.get(k) for k in keys]
        missing = []
        for i, v in enumerate(found):
            if v is None:
                k = keys[i]
                v = old.get(k)
                if v is None:
                    missing.append(i)
                else:
                    found[i] = young[k] = v
        odd, merge = [], self.model.tokenize
        for i in missing:
            k, space = keys[i], "\u0120"
            if k[:1] == "\x01":
                k, space = k[1:], ""
            if k.isalpha() and (k.isascii() or max(k) < "\u0250"):  # one piece: straight to the merges
                w = space + (k if k.isascii() else k.encode().decode("latin-1").translate(_MARKS))
                found[i] = young[keys[i]] = array("I", [t.id for t in merge(w)]).tobytes()
            else:
                odd.append(i)
        for at in range(0, len(odd), 20_000):
            part = odd[at : at + 20_000]
            texts = [k[1:] if (k := keys[i])[:1] == "\x01" else k if k[:1] == "\n" else " " + k for i in part]
            for i, ids in zip(part, self._ids(texts), strict=True):
                found[i] = young[keys[i]] = ids.tobytes()
        if len(young) > self.most:
            self._renew(young)
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and each text's offsets. A null is an empty text."""
        texts = pc.fill_null(texts, "")
        n = len(texts)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        whole = pc.match_substring_regex(texts, _WHOLE)
        rest = pc.if_else(whole, "", texts)
        cut = pc.replace_substring_regex(rest, _CUT, "\\1 \x01\\2")
        cut = pc.replace_substring(cut, "\n", " \n")
        parts = pc.split_pattern(pc.binary_join_element_wise("\x01", cut, ""), " ")
        counts = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = parts.flatten().dictionary_encode()
        blobs = self._lookup(coded.dictionary.to_pylist())
        flat = np.frombuffer(b"".join(blobs), np.uint32)
        lens = np.fromiter(map(len, blobs), np.int64, len(blobs)) >> 2
        starts = np.cumsum(lens) - lens
        codes = coded.indices.to_numpy(zero_copy_only=False)
        n_ids = lens[codes]
        ends = np.cumsum(n_ids)
        total = int(ends[-1]) if len(ends) else 0
        ids = flat[np.repeat(starts[codes] - (ends - n_ids), n_ids) + np.arange(total)] if total else np.zeros(0, np.uint32)
        offsets = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        odd = np.flatnonzero(whole.to_numpy(zero_copy_only=False))
        if not len(odd):
            return ids, offsets.astype(np.int64)
        own = dict(zip(odd.tolist(), self._ids(texts.take(pa.array(odd)).to_pylist()), strict=True))
        pieces = [own[i] if i in own else ids[offsets[i] : offsets[i + 1]] for i in range(n)]
        return np.concatenate(pieces), np.concatenate([[0], np.cumsum([len(p) for p in pieces])]).astype(np.int64)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One a worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def with_end(ids: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with one more id after each text."""
    n = len(offsets) - 1
    out = np.full(len(ids) + n, end, np.uint32)
    out[np.arange(len(ids)) + np.repeat(np.arange(n), np.diff(offsets))] = ids
    return out, offsets + np.arange(n + 1)


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())
