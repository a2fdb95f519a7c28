"""Token ids of whole texts by a public tokenizer, with a bounded cache of pieces per worker.

A text is cut where a run of white space begins. Both vocabularies used here split there
themselves and look no further than the run and the next character, so the ids of the pieces,
one after the other, are the ids of the text (tests compare them). A piece that a worker has
seen before, with the same two 64-bit hashes, is not encoded again. Unseen pieces go to the library in one call, joined by the
end-of-text token, which it never merges with its neighbours.

Of the word vocabulary a piece of printable ASCII and Latin-1 letters only is cut further, into the words that the
vocabulary's own pattern finds there, in lower case: a word is encoded once, whatever its case and the punctuation around
it. It goes to the library's model alone, as there is nothing left to normalise or to split in it. All other pieces (other
letters, combining marks, control characters, special tokens) are encoded whole.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from vozlake.llm import textscan as ts

#: pieces a worker remembers (about 50 bytes each) before it starts anew
CACHE_PIECES = 1_000_000
#: bytes of unseen pieces encoded in one call
CALL_BYTES = 1 << 11
END = "<|endoftext|>"

#: the steps before the model for which :meth:`PieceTokenizer._words` holds
WORD_STEPS = {
    "normalizer": {"type": "Sequence", "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
         "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
}
#: that pattern, on the bytes of a plain piece in lower case
WORD = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z\x80-\xff]+|[0-9]|[^a-z0-9\x80-\xff]+")
OTHER, SPACE, LETTER, DIGIT, SIGN, WHOLE = range(6)
#: what each byte is; the letters from U+00C0 to U+00FF are C3 and one of ``LATIN``
KIND = np.full(256, OTHER, dtype=np.uint8)
KIND[0x21:0x7F] = SIGN
KIND[~ts.NOT_SPACE] = SPACE
KIND[0x30:0x3A] = DIGIT
KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = LETTER
LATIN = np.zeros(256, dtype=bool)
LATIN[0x80:0xC0] = True
LATIN[[0x97, 0xB7]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
LATIN_LOWER = np.arange(256, dtype=np.uint8)
LATIN_LOWER[0x80:0x9F] += 32
#: the character that stands for each byte in a byte-level vocabulary
_SELF = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_CHAR = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _SELF)}

_open: dict[str, "PieceTokenizer"] = {}


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file; every worker has the package installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


def of_worker(name: str) -> "PieceTokenizer":
    """The tokenizer of this Python worker; it outlives a task."""
    if name not in _open:
        _open[name] = PieceTokenizer(vocabulary(name))
    return _open[name]


class PieceTokenizer:
    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.end = self.library.token_to_id(END)
        with open(path, encoding="utf-8") as file:
            steps = json.load(file)
        added = steps["added_tokens"]
        self.marks = [t["content"].encode() for t in added]
        self.by_word = all(steps[name] == step for name, step in WORD_STEPS.items()) and not any(
            t[flag] for t in added for flag in ("single_word", "lstrip", "rstrip", "normalized"))
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, dtype=np.uint64)  # sorted
        self.checks = np.zeros(0, dtype=np.uint64)
        self.begin = np.zeros(0, dtype=np.int64)
        self.length = np.zeros(0, dtype=np.int64)
        self.ids = np.zeros(0, dtype=np.uint32)

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def _encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces end to end, and how many each has."""
        ids, lengths, mark = [], np.zeros(len(pieces), dtype=np.int64), END.encode()
        batch: list[int] = []
        size = 0

        def flush() -> None:
            if not batch:
                return
            joined = END.join(pieces[i].decode() for i in batch)
            got = np.array(self.library.encode_batch_fast([joined], add_special_tokens=False)[0].ids, dtype=np.uint32)
            ends = np.flatnonzero(got == self.end)
            if len(ends) != len(batch) - 1:
                raise RuntimeError("a piece holds an end mark")
            lengths[batch] = np.diff(np.concatenate([[-1], ends, [len(got)]])) - 1
            ids.append(got[got != self.end])
            batch.clear()

        for i, piece in enumerate(pieces):
            if mark in piece:
                flush()
                size = 0
                own = self.encode(piece.decode())
                lengths[i] = len(own)
                ids.append(own)
                continue
            batch.append(i)
            size += len(piece) + len(END)
            if size > CALL_BYTES:
                flush()
                size = 0
        flush()
        return (np.concatenate(ids) if ids else np.zeros(0, np.uint32)), lengths

    def _encode_words(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Like :meth:`_encode_pieces`, for words that :meth:`_words` found."""
        ids, lengths, tokenize = [], [], self.library.model.tokenize
        for piece in pieces:
            before = len(ids)
            for word in WORD.findall(piece) if b"'" in piece else (piece,):
                shown = word.decode() if word.isascii() else word.decode("latin-1").translate(BYTE_CHAR)
                ids.extend([t.id for t in tokenize(shown)])
            lengths.append(len(ids) - before)
        return np.array(ids, dtype=np.uint32), np.array(lengths, dtype=np.int64)

    def _words(self, data: np.ndarray, starts: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of pieces that begin at ``starts``, in texts that begin at ``firsts``: the bytes, in lower case where a piece is plain,
        starts and ends of the words of plain pieces and of all other pieces whole, and which of them are such words (and not long:
        the model alone makes an object of each id).

        An apostrophe stays with the letters after it, as the pattern may take both together; :data:`WORD` parts them."""
        kind, lower = KIND[data], LOWER[data]
        at = np.flatnonzero(data[:-1] == 0xC3)
        at = at[LATIN[data[at + 1]]]
        kind[at] = kind[at + 1] = LETTER
        lower[at + 1] = LATIN_LOWER[data[at + 1]]
        whole = np.logical_or.reduceat(kind == OTHER, starts)
        raw = data.tobytes()
        for mark in self.marks:
            found = [m.start() for m in re.finditer(re.escape(mark), raw)]
            whole[np.searchsorted(starts, found, side="right") - 1] = True
        if whole.any():
            inside = np.repeat(whole, np.diff(np.append(starts, len(data))))
            kind[inside] = WHOLE
            lower[inside] = data[inside]
        begins = np.empty(len(data), dtype=bool)
        begins[0] = True
        begins[1:] = kind[1:] != kind[:-1]
        begins |= kind == DIGIT
        after = np.flatnonzero(data[:-1] == 0x27) + 1
        begins[after[kind[after] == LETTER]] = False
        begins[firsts] = begins[starts[whole]] = True
        edges = np.flatnonzero(begins)
        kept = kind[edges] != SPACE
        starts, ends = edges[kept], np.append(edges[1:], len(data))[kept]
        return lower, starts, ends, (kind[starts] != WHOLE) & (ends - starts <= CALL_BYTES)

    def chunk_ids(self, chunk: ts.Chunk) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts of a chunk end to end, and how many each text has."""
        data, n = chunk.data, chunk.data.size
        counts = np.zeros(chunk.count, dtype=np.int64)
        if n == 0:
            return np.zeros(0, np.uint32), counts
        begins, firsts = _cuts(data), chunk.offsets[:-1][np.diff(chunk.offsets) > 0]
        begins[firsts] = True
        starts = np.flatnonzero(begins)
        if self.by_word:
            data, starts, ends, is_word = self._words(data, starts, firsts)
        else:
            ends, is_word = np.append(starts[1:], n), np.zeros(len(starts), dtype=bool)
        keys, where, which = np.unique(ts.span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), dtype=bool)
        inside = at < len(self.keys)
        checks = ts.span_hashes(data, starts[where], ends[where], seed=1)
        met = self.keys[at[inside]] == keys[inside]
        known[inside] = met & (self.checks[at[inside]] == checks[inside])
        new = ~known
        new[inside] &= ~met  # of two pieces with one key the first stays
        begin = np.empty(len(keys), dtype=np.int64)
        length = np.empty(len(keys), dtype=np.int64)
        begin[known], length[known] = self.begin[at[known]], self.length[at[known]]
        unseen = np.flatnonzero(~known)
        word = is_word[where[unseen]]
        unseen = np.concatenate([unseen[word], unseen[~word]])
        raw, at_piece = data.tobytes(), where[unseen]
        pieces = [raw[a:b] for a, b in zip(starts[at_piece].tolist(), ends[at_piece].tolist())]
        n_words = int(word.sum())
        encoded = self._encode_words(pieces[:n_words]), self._encode_pieces(pieces[n_words:])
        got, got_length = (np.concatenate(both) for both in zip(*encoded))
        begin[unseen] = len(self.ids) + np.cumsum(got_length) - got_length
        length[unseen] = got_length
        pool = np.concatenate([self.ids, got])
        per_piece = length[which]
        out = pool[ts.slices(begin[which], per_piece)]
        edges = np.searchsorted(starts, chunk.offsets)
        counts = np.diff(np.concatenate([[0], np.cumsum(per_piece)])[edges])
        if len(self.keys) + len(unseen) > CACHE_PIECES:
            self._forget()
        else:
            place = at[new]
            self.begin = np.insert(self.begin, place, begin[new])
            self.length = np.insert(self.length, place, length[new])
            self.keys = np.insert(self.keys, place, keys[new])
            self.checks = np.insert(self.checks, place, checks[new])
            self.ids = pool
        return out, counts

    def texts(self, column: pa.Array, end_id: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(number of the first text, ids of some texts, count of each), with ``end_id`` after each text."""
        for chunk in ts.chunks(column, 2 * ts.CHUNK_BYTES):
            ids, counts = self.chunk_ids(chunk)
            yield chunk.first, np.insert(ids, np.cumsum(counts), np.uint32(end_id)), counts + 1


def _cuts(data: np.ndarray) -> np.ndarray:
    """A mark on each byte where a run of white space begins, after a character that is certainly none itself."""
    space = ~ts.NOT_SPACE[data]
    begins = space.copy()
    begins[1:] &= ~space[:-1]
    at = np.flatnonzero(begins)
    at = at[at >= 3]
    # U+0085 and U+00A0 are C2 85 and C2 A0; the other spaces are three bytes from E1, E2 or E3
    wide = np.isin(data[at - 3], (0xE1, 0xE2, 0xE3)) | ((data[at - 2] == 0xC2) & np.isin(data[at - 1], (0x85, 0xA0)))
    odd = (data[at - 1] >= 0x1C) & (data[at - 1] <= 0x1F)
    begins[:] = False
    begins[at[~wide & ~odd]] = True
    return begins
