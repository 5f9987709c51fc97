"""Whole texts to token ids by the tokenizers library, with one encoding per distinct piece.

A byte-level BPE of this kind first cuts a text into words, and no token crosses a cut. Cuts
that are certain whatever surrounds them are: before a space between two characters that aren't
white space, on both sides of such a newline, and between a letter or digit and punctuation.
Texts are cut there, each distinct piece is encoded once, and ids are put together by numpy.
Texts with runs of white space or with the vocabulary's special tokens are encoded as they are.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_WS = r"\t\n\x0b\x0c\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_PUNCT = r"([\pL\pN])([.,!?;:*#$%&|\-)(]+)"
_SPACES = frozenset("\t\n\x0b\x0c\r \x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
#: Letters and nothing else, in blocks whose every code point is one in any version of Unicode.
_WORD = r"^ ?[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}]+$"
#: The characters that stand for bytes in byte-level vocabularies: printable ones for themselves.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_CHARS = {b: chr(b) for b in _PRINTED} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _PRINTED)}
CACHE_PIECES = 300_000
JOINED = 4096
BLOCK_BYTES = 3 << 19


class Encoder:
    """encode(texts) gives all ids in a row and the offsets of the texts in them."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, int] = {}
        self._reset()
        before = self.tokenizer.pre_tokenizer
        known_kind = type(before).__name__ == "ByteLevel" and before.use_regex and not before.add_prefix_space
        self.cuts = known_kind and self.tokenizer.normalizer is None and self.tokenizer.post_processor is None and type(self.tokenizer.model).__name__ == "BPE"
        newline = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.newline = newline[0] if len(newline) == 1 else -1
        special = [str(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = [s for s in special if s]

    def _reset(self) -> None:
        self.known.clear()
        self.flat = np.empty(1 << 20, np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32)
        self.starts = np.zeros(1, np.int32)

    def _slots(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The place of each distinct piece, and the ids and their offsets that places refer to.

        New pieces enter the cache while there is room; later ones, rare as a rule, are
        encoded for this call alone, behind it.
        """
        known = self.known
        found = list(map(known.get, pieces))
        new = [i for i, slot in enumerate(found) if slot is None]
        if not new:
            return np.array(found, np.int32), self.flat, self.starts
        n, used = len(known), int(self.starts[-1])
        parts, ends = [], [self.starts]
        for at in range(0, len(new), JOINED):
            ids, sizes = self._encode_new([pieces[i] for i in new[at : at + JOINED]])
            parts.append(ids)
            ends.append((used + np.cumsum(sizes)).astype(np.int32))
            used += len(ids)
        start = int(self.starts[-1])
        if used > len(self.flat):
            grown = np.empty(max(used, 2 * len(self.flat)), self.flat.dtype)
            grown[:start] = self.flat[:start]
            self.flat = grown
        self.flat[start:used] = np.concatenate(parts)
        starts = np.concatenate(ends)
        for k, i in enumerate(new):
            found[i] = n + k
        room = max(0, CACHE_PIECES - n)
        known.update((pieces[i], n + k) for k, i in enumerate(new[:room]))
        self.starts = starts[: len(known) + 1]
        return np.array(found, np.int32), self.flat, starts

    def _encode_words(self, words: list[str]) -> tuple[list[int], list[int]]:
        """Ids and their numbers of words that are one piece for certain, by the BPE model itself."""
        tokenize, ids, sizes = self.tokenizer.model.tokenize, [], []
        for word in "\n".join(words).encode().decode("latin-1").translate(_BYTE_CHARS).split(_BYTE_CHARS[10]):
            own = [t.id for t in tokenize(word)]
            ids += own
            sizes.append(len(own))
        return ids, sizes

    def _encode_new(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words go to the model, pieces that may be several words to the whole tokenizer."""
        word = pc.match_substring_regex(pa.array(pieces, pa.string()), _WORD).to_numpy(zero_copy_only=False)
        if not word.any():
            return self._encode_joined(pieces)
        words, others = np.flatnonzero(word), np.flatnonzero(~word)
        ids, sizes = self._encode_words([pieces[i] for i in words])
        more, counts = self._encode_joined([pieces[i] for i in others]) if len(others) else (np.empty(0, np.uint32), np.empty(0, np.int64))
        n = np.empty(len(pieces), np.int64)
        n[words], n[others] = sizes, counts
        out = np.empty(n.sum(), np.uint32)
        whose = np.repeat(word, n)
        out[whose], out[~whose] = ids, more
        return out, n

    def _encode_joined(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the pieces in a row, and how many each has. Lines are cut from lines."""
        plain = [i for i, p in enumerate(pieces) if p and p[-1] not in _SPACES and (p[0] not in _SPACES or p[0] == " ")]
        found = np.array(self.tokenizer.encode_batch_fast(["\n".join(map(pieces.__getitem__, plain))], add_special_tokens=False)[0].ids, np.uint32)
        cuts = np.flatnonzero(found == self.newline)
        if len(plain) == len(pieces) and len(cuts) == len(plain) - 1:
            return np.delete(found, cuts), np.diff(np.concatenate([[-1], cuts, [len(found)]])) - 1
        if len(cuts) == len(plain) - 1:
            own = dict(zip(plain, np.split(found, cuts)))
            parts = [own[i][i != plain[0] :] if i in own else self._encode_one(p) for i, p in enumerate(pieces)]
        else:
            parts = [self._encode_one(p) for p in pieces]
        return np.concatenate(parts), np.array([len(x) for x in parts], np.int64)

    def _encode_one(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        n = len(texts)
        odd = pc.match_substring_regex(texts, f"[{_WS}][{_WS}]|\x01")
        for s in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, s))
        if not self.cuts:  # another kind of tokenizer: nothing is known about its cuts
            odd = pa.array(np.ones(n, bool))
        plain = pc.if_else(odd, "", texts)
        cut = pc.replace_substring(pc.replace_substring(plain, "\n", "\x01\n\x01"), " ", "\x01 ")
        pieces = pc.split_pattern(pc.replace_substring_regex(cut, _PUNCT, "\\1\x01\\2"), "\x01")
        first = pieces.offsets.to_numpy()
        coded = pieces.flatten().dictionary_encode()
        places, flat, starts = self._slots(coded.dictionary.to_pylist())
        slots = places[coded.indices.to_numpy()]
        begin = starts[slots]
        lens = starts[slots + 1] - begin
        ends = np.zeros(len(lens) + 1, np.int64)
        np.cumsum(lens, out=ends[1:])
        ids = flat[np.repeat(begin - ends[:-1].astype(np.int32), lens) + np.arange(ends[-1], dtype=np.int32)].astype(np.uint32)
        offsets = ends[first - first[0]]
        where = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        if not len(where):
            return ids, offsets
        parts, sizes = [], np.diff(offsets)
        at = 0
        for i in where:
            parts.append(ids[offsets[at] : offsets[i]])
            own = self._encode_one(texts[int(i)].as_py())
            parts.append(own)
            sizes[i] = len(own)
            at = i + 1
        parts.append(ids[offsets[at] : offsets[n]])
        return np.concatenate(parts), np.concatenate([[0], np.cumsum(sizes)])


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def blocks(batch: pa.RecordBatch, column: str | int, most: int = BLOCK_BYTES):
    """Slices of the batch whose texts hold about so many bytes, or a single longer text.

    After the last one the memory that Arrow keeps for itself is given back.
    """
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    at, held = 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > most:
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += int(size)
    if at < len(sizes):
        yield batch.slice(at)
    pa.default_memory_pool().release_unused()
