"""Tokenizing whole texts with the tokenizers library, one encoding for each distinct word of a task."""

from __future__ import annotations

import os
import re

import numpy as np

#: A text may be cut before white space that follows other text: the byte-level pattern never joins the two.
PIECE = re.compile(r"\s*\S+|\s+")
#: Python counts these as white space, the pattern doesn't; such rare texts are encoded whole.
ODD = re.compile("[\x1c-\x1f]")


class Encoder:
    """encode(texts) gives the ids of each text as little-endian 32-bit bytes, equal to encoding it whole.

    A text is cut before each space that text follows: the byte-level pattern leaves that space to what comes after it. If white
    space follows some space, the text is cut before its runs of white space instead.
    `limit` bounds the memos of encoded pieces; when it is reached they start anew (results don't change).
    """

    def __init__(self, path: str, limit: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.limit, self.memo = limit, {}
        self.spaced: dict[str, bytes | None] = {}  # piece without the space before it -> ids; None if no such cut is right
        vocabulary = self.tokenizer.get_vocab()
        self.n_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.n_bytes[list(vocabulary.values())] = [len(t) for t in vocabulary]  # one character stands for one byte

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, pieces: list[str], run: int = 400) -> dict[str, bytes]:
        """Ids of each piece. Pieces that begin with white space and end without it are encoded in runs, cut again by bytes."""
        joined = [p for p in pieces if p[0].isspace() and not p[-1].isspace()]
        out = dict(zip(rest := [p for p in pieces if not (p[0].isspace() and not p[-1].isspace())], self._ids(rest)))
        runs = [joined[i : i + run] for i in range(0, len(joined), run)]
        for own, got in zip(runs, self._ids(["".join(r) for r in runs])):
            ids = np.frombuffer(got, "<u4")
            ends = np.cumsum(self.n_bytes[ids])
            cuts = np.searchsorted(ends, np.cumsum([len(p.encode()) for p in own])) + 1
            a = 0
            for p, b in zip(own, (cuts * 4).tolist()):
                out[p], a = got[a:b], b
        return out

    def _by_runs(self, texts: list[str]) -> list[bytes]:
        cut = [None if ODD.search(t) else PIECE.findall(t) for t in texts]
        new = list({p for pieces in cut if pieces for p in pieces} - self.memo.keys())
        self.memo.update(self._pieces(new))
        get = self.memo.__getitem__
        return [self._ids([t])[0] if pieces is None else b"".join(map(get, pieces)) for t, pieces in zip(texts, cut)]

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.memo) + len(self.spaced) > self.limit:
            self.memo.clear()
            self.spaced.clear()
        cut = [t.split(" ") for t in texts]
        firsts = [own.pop(0) for own in cut]
        new = set().union(*cut) - self.spaced.keys()
        wrong = {p for p in new if not p or p[0].isspace()}
        self.spaced.update(dict.fromkeys(wrong))
        self.spaced.update((p[1:], ids) for p, ids in self._pieces([f" {p}" for p in new - wrong]).items())
        out: list[bytes | None] = []
        get = self.spaced.__getitem__
        for own, first in zip(cut, self._by_runs(firsts)):
            try:
                out.append(first + b"".join(map(get, own)))
            except TypeError:  # a None
                out.append(None)
        others = [i for i, x in enumerate(out) if x is None]
        for i, ids in zip(others, self._by_runs([texts[i] for i in others])):
            out[i] = ids
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder, and so one memo, for each worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
