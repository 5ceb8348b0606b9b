"""Encoding by public tokenizers, piece by piece, with each piece encoded once per worker.

Both tokenizers cut a text before they merge: no token spans a blank between two words. So texts are split at blanks
where that is provably safe, the distinct pieces of a batch are encoded by the library, and the ids of a text are the
ids of its pieces in order. Pieces met in two batches are kept for the worker's life, the others for the task, both
up to a bound; long pieces are never kept.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces kept for the worker and for the task (about 200 bytes each), the longest of them, and characters split at once.
KEPT_PIECES, TASK_PIECES, CACHED_CHARS, CHARS = 200_000, 150_000, 64, 4 << 20
END = "<|endoftext|>"
#: How the byte-level vocabulary writes a blank.
_BLANK = "\u0120"
_SAFE_BLANK = re.compile(r"(?<!\s) ")
_BARE = "\x00"
#: Texts cut by the slow way: those that hold a special string or the sign above and, where a blank counts, a blank after
#: any character that some tokenizer or Python takes for white space.
_ODD = r"<\||\x00"
_ODD_SPACED = _ODD + r"|[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}] "
#: A comma or full stop between a letter and a blank (or the end) is always a word of its own.
_MARKED = r"([A-Za-z\x{df}-\x{f6}\x{f8}-\x{ff}])([.,])( |$)"
_ENCODERS: dict[tuple[str, bool], Encoder] = {}


class Encoder:
    """``spaced``: a blank belongs to the word after it (byte-level); otherwise white space is dropped by the tokenizer."""

    def __init__(self, path: str, spaced: bool):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.spaced = spaced
        self.end = self.tokenizer.token_to_id(END)
        self.known: dict[str, bytes] = {}
        self.recent: dict[str, bytes] = {}

    def _encode(self, pieces: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def _encode_many(self, pieces: list[str]) -> list[bytes]:
        """Short pieces: many to a call, parted by a special token, which the library cuts out first."""
        if any("<|" in p for p in pieces):
            return self._encode(pieces)
        groups = [pieces[at: at + 64] for at in range(0, len(pieces), 64)]
        out: list[bytes] = []
        for e in self.tokenizer.encode_batch_fast([END.join(g) for g in groups], add_special_tokens=False):
            ids = np.array(e.ids, "<u4")
            cuts = np.nonzero(ids == self.end)[0] * 4
            data = ids.tobytes()
            out += [data[a:b] for a, b in zip([0, *(cuts + 4).tolist()], [*cuts.tolist(), len(data)], strict=True)]
        return out

    def _new(self, pieces: list[str]) -> list[bytes]:
        """Letters of ASCII stand for themselves as bytes and are one word, so the model takes them as they are; the rest goes through the library's whole path."""
        tokenize, out, rest = self.tokenizer.model.tokenize, {}, []
        for piece in pieces:
            word = piece[1:] if self.spaced and piece[:1] == " " else piece
            if word.isascii() and word.isalpha() and (self.spaced or word.islower()):
                out[piece] = array("I", [t.id for t in tokenize(_BLANK + word if word is not piece else word)]).tobytes()
            else:
                rest.append(piece)
        out.update(zip(rest, self._encode_many(rest), strict=True))
        return list(map(out.__getitem__, pieces))

    def of_pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of distinct pieces."""
        got = list(map(self.known.get, pieces))
        gaps = [i for i, x in enumerate(got) if x is None]
        recent = self.recent.get
        for i in gaps:
            got[i] = recent(pieces[i])
        if len(self.known) < KEPT_PIECES:
            self.known.update((pieces[i], got[i]) for i in gaps if got[i] is not None)
        new = [i for i in gaps if got[i] is None]
        for i, ids in zip(new, self._new([pieces[i] for i in new]), strict=True):
            got[i] = ids
        if len(self.recent) + len(new) > TASK_PIECES:
            self.recent = {}
        self.recent.update((pieces[i], got[i]) for i in new if len(pieces[i]) <= CACHED_CHARS)
        return got

    def task_over(self) -> None:
        """Let go of what only this task has met."""
        self.recent = {}
        pa.default_memory_pool().release_unused()

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        out: list[bytes] = []
        start = size = 0
        for i, text in enumerate(texts):
            size += len(text)
            if size >= CHARS or i + 1 == len(texts):
                out += self._some(texts[start: i + 1])
                start, size = i + 1, 0
        return out

    def _some(self, texts: list[str]) -> list[bytes]:
        column = pa.array(texts, pa.large_string())
        odd = pc.match_substring_regex(column, _ODD_SPACED if self.spaced else _ODD)
        column = pc.if_else(odd, pa.scalar("", pa.large_string()), column)
        if not self.spaced:
            column = pc.ascii_lower(pc.replace_substring(column, "\n", " "))
        split = pc.split_pattern(pc.replace_substring_regex(column, _MARKED, r"\1 " + (_BARE if self.spaced else "") + r"\2\3"), " ")
        starts = split.offsets.to_numpy()
        flat = split.flatten()
        coded = flat.dictionary_encode()
        at = coded.indices.to_numpy().astype(np.int64)
        pieces = coded.dictionary.to_pylist()
        if self.spaced:  # the first piece of a text and a mark have no blank before them
            table = self.of_pieces([p[1:] if p[:1] == _BARE else " " + p for p in pieces])
            first = flat.take(pa.array(starts[:-1])).to_pylist()
            at[starts[:-1]] = len(pieces) + np.arange(len(texts))
            table += self._each(first)
        else:
            table = self.of_pieces(pieces)
        lengths = np.fromiter(map(len, table), np.int64, len(table)) // 4
        begins = np.cumsum(lengths) - lengths
        each = lengths[at]
        ends = np.cumsum(each)
        known = np.frombuffer(b"".join(table), "<u4")
        data = known[np.repeat(begins[at] - (ends - each), each) + np.arange(int(ends[-1]) if len(ends) else 0)].tobytes()
        cuts = (np.concatenate([[0], ends])[starts] * 4).tolist()
        out = [data[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        for i in np.nonzero(odd.to_numpy(zero_copy_only=False))[0].tolist():
            parts = _SAFE_BLANK.split(texts[i])
            out[i] = b"".join(self._each([parts[0], *[" " + p for p in parts[1:]]] if self.spaced else parts))
        return out

    def _each(self, pieces: list[str]) -> list[bytes]:
        names = list(dict.fromkeys(pieces))
        return list(map(dict(zip(names, self.of_pieces(names), strict=True)).__getitem__, pieces))


def encoder(path: str, spaced: bool) -> Encoder:
    """The worker's encoder for a tokenizer file; kept between tasks."""
    if (path, spaced) not in _ENCODERS:
        _ENCODERS[path, spaced] = Encoder(path, spaced)
    return _ENCODERS[path, spaced]


def vocabulary(name: str) -> str:
    """Where a public tokenizer's file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
