"""Token ids of whole texts by the tokenizers library, each distinct piece encoded once per task."""

from __future__ import annotations

import functools
import json
import os
import re
from codecs import charmap_decode
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_PIECES = re.compile(r" ?\S+|\s+(?!\S)|\s+")
#: Texts whose white space isn't single spaces and line feeds between other characters (RE2), and what only Python counts as white space.
_UNEVEN = "[\x00\t\x0b\x0c\r\x1c-\x1f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]|  | \n|\n |\n\n|\\A[ \n]|[ \n]\\z|\\A\\z"
_FOREIGN = re.compile("[\x1c-\x1f]")
#: Letters that stay letters when lower-cased, and the other ASCII characters whose splitting is plain: digits, and marks but ' and <.
_LETTER, _MARK = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff", r"!-&(-/:;=-@\[-`{-~"
#: Pieces that are split here, and the parts of these, by kind of tokenizer.
_PLAIN = {"words": f"[{_LETTER}0-9{_MARK}]+", "spaced": f" ?[{_LETTER}0-9{_MARK}]+"}
_PARTS = {"words": re.compile(f"[{_LETTER}]+|[0-9]|[{_MARK}]+"), "spaced": re.compile(f" ?[{_LETTER}]+| ?[0-9]+| ?[{_MARK}]+")}
_LETTERS = f" ?[{_LETTER}]+"
#: New pieces to a string that is encoded; longer strings take longer per piece.
_JOIN = 128
#: Bytes of texts that are cut and looked up at once.
SLICE = 8 << 20
#: Bytes of a remembered piece beside its characters: string, number, place in the dictionary and in the arrays.
_PIECE = 200


def _byte_characters() -> str:
    """The character that byte-level tokenizers write for each byte, but 0 for itself.

    Bytes that are printable in Latin-1 stand for themselves, the others for 256, 257, ...
    """
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in shown)}
    return "\0" + "".join(names[b] for b in range(1, 256))


def slices(column: pa.Array, most: int = SLICE):
    """Parts of a string column of about ``most`` bytes, at least one row each."""
    at, sizes = 0, pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    while at < len(column):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield at, column.slice(at, stop - at)
        at = stop


class _Pieces(dict):
    """piece -> number, with the ids of piece k at ids[start[k] : start[k] + length[k]]."""

    def __init__(self, encode, most_bytes: int):
        super().__init__()
        self.encode, self.most = encode, most_bytes
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.size, self.used = 0, 0
        self.ids, self.start, self.length = np.zeros(1 << 16, np.int32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.again = np.zeros(1 << 14, bool)

    def shrink(self) -> None:
        """Forget the pieces that no batch had after their first; all, if too many would be left."""
        numbers = np.flatnonzero(self.again[: len(self)])
        kept = [p for p, again in zip(self, self.again.tolist(), strict=False) if again]
        ids, length = self.expand(numbers)
        size = sum(map(len, kept)) + _PIECE * len(kept)
        self.reset()
        if size > self.most // 2:
            return
        self.update(zip(kept, range(len(kept)), strict=True))
        self.size, self.used = size, len(ids)
        self.ids = np.concatenate([ids, self.ids])
        self.start, self.length = np.concatenate([np.cumsum(length) - length, self.start]), np.concatenate([length, self.length])
        self.again = np.zeros(len(self.start), bool)

    def numbers(self, pieces: list[str]) -> np.ndarray:
        """The numbers of distinct pieces; new ones are encoded."""
        first = len(self)
        out = np.fromiter(map(self.get, pieces, repeat(-1)), np.int64, len(pieces))
        missing = np.flatnonzero(out < 0)
        self.again[out[out >= 0]] = True
        out[missing] = first + np.arange(len(missing))
        new = [pieces[k] for k in missing.tolist()]
        if new:
            self.update(zip(new, range(first, first + len(new)), strict=True))
            self.size += sum(map(len, new)) + _PIECE * len(new)
            self._settle(first, new)
        return out

    def _settle(self, first: int, new: list[str]) -> None:
        while len(self.start) < len(self):
            self.again = np.concatenate([self.again, np.zeros(len(self.again), bool)])
            self.start, self.length = np.resize(self.start, 2 * len(self.start)), np.resize(self.length, 2 * len(self.length))
        for numbers, ids, lengths in self.encode(new):
            while len(self.ids) < self.used + len(ids):
                self.ids = np.resize(self.ids, 2 * len(self.ids))
            self.length[first + numbers] = lengths
            self.start[first + numbers] = self.used + np.cumsum(lengths) - lengths
            self.ids[self.used : self.used + len(ids)] = ids
            self.used += len(ids)

    def expand(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a row of pieces, and how many each piece has."""
        length = self.length[numbers]
        ends = np.cumsum(length)
        total = int(ends[-1]) if len(ends) else 0
        at = np.arange(total) + np.repeat(self.start[numbers] - ends + length, length)
        return self.ids[at], length


class TextEncoder:
    """Ids of texts without special tokens, as ``Tokenizer.encode(text, add_special_tokens=False)``.

    Both kinds of tokenizers split text before merging, and never across the places used here, so
    pieces between them can be encoded once and remembered (up to ``most_bytes``; then those not met again are forgotten).

    kind "words": the tokenizer drops white space; pieces are runs between ASCII white space.
    kind "spaced": byte-level with a leading space in the piece. A text whose white space is single
    spaces and line feeds between other characters is cut before each space and around each line
    feed, any other text by _PIECES.

    New pieces are encoded in strings of _JOIN pieces. Those of Latin letters, digits and plain
    marks (_PLAIN) are split into _PARTS here and go to the tokenizer's own model behind a splitter
    at zeros, which spares its regular expressions; they end where an id ends a word, or at a line feed's id. Others have a mark after
    them that has an id of its own. Pieces that hold the mark or unusual white space are encoded one by one.
    """

    def __init__(self, path: str, kind: str, most_bytes: int = 200 << 20):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.kind = Tokenizer.from_file(path), kind
        self.mark = " \x01 " if kind == "words" else "\n"
        self.alone = re.compile(r"[\x01<\s]" if kind == "words" else r"(?<!^)\s|^[^\S ]|<|^ $")
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\0")
        self.plain, self.parts = _PLAIN[kind], _PARTS[kind].findall
        self.written = _byte_characters()
        self.ends = None
        if kind == "words":
            suffix, vocabulary = json.loads(self.tokenizer.to_str())["model"]["end_of_word_suffix"], self.tokenizer.get_vocab()
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[[k for w, k in vocabulary.items() if w.endswith(suffix)]] = True
        (self.mark_id,) = self.tokenizer.encode(self.mark, add_special_tokens=False).ids
        self.pieces = _Pieces(self._encode_new, most_bytes)

    @staticmethod
    def _ids(tokenizer, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts, one after another, and how many each has."""
        found = [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.int32, int(lengths.sum())), lengths

    def _plain_strings(self, pieces: list[str], letters: list[bool]) -> tuple[list[str], np.ndarray]:
        """_JOIN pieces to a string, with a zero between their parts, and how many parts each piece has."""
        cut = [p if one else "\0".join(self.parts(p)) for p, one in zip(pieces, letters, strict=True)]
        between = "\0" if self.ends is not None else "\0\n\0"
        strings = [between.join(cut[i : i + _JOIN]) + between[:-1] for i in range(0, len(cut), _JOIN)]
        if self.ends is None:
            return [charmap_decode(x.encode(), "strict", self.written)[0] for x in strings], np.zeros(0)
        return [charmap_decode(x.lower().encode(), "strict", self.written)[0] for x in strings], np.fromiter((c.count("\0") + 1 for c in cut), np.int64, len(cut))

    def _encode_new(self, pieces: list[str]):
        """(numbers of pieces, their ids one after another, how many each has), in several parts."""
        column, alone = pa.array(pieces, pa.string()), self.alone.search
        plain, letters = (pc.match_substring_regex(column, f"\\A(?:{x})\\z").to_numpy(zero_copy_only=False) for x in (self.plain, _LETTERS))
        numbers = np.flatnonzero(plain)
        for i in range(0, len(numbers), 64 * _JOIN):
            part = numbers[i : i + 64 * _JOIN]
            strings, counts = self._plain_strings([pieces[k] for k in part.tolist()], letters[part].tolist())
            ids, _ = self._ids(self.model, strings)
            if self.ends is not None:
                yield part, ids, np.diff(np.flatnonzero(self.ends[ids])[np.cumsum(counts) - 1], prepend=-1)
            else:
                yield part, ids[ids != self.mark_id], np.diff(np.flatnonzero(ids == self.mark_id), prepend=-1) - 1
        other = np.flatnonzero(~plain)
        single = np.fromiter((alone(pieces[k]) is not None for k in other.tolist()), bool, len(other))
        yield other[single], *self._ids(self.tokenizer, [pieces[k] for k in other[single].tolist()])
        numbers = other[~single]
        for i in range(0, len(numbers), 64 * _JOIN):
            part = numbers[i : i + 64 * _JOIN]
            some = [pieces[k] for k in part.tolist()]
            ids, _ = self._ids(self.tokenizer, [self.mark.join(some[j : j + _JOIN]) + self.mark for j in range(0, len(some), _JOIN)])
            yield part, ids[ids != self.mark_id], np.diff(np.flatnonzero(ids == self.mark_id), prepend=-1) - 1

    def _cut(self, texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        """(order of the texts, their pieces one after another, how many pieces each has)."""
        if self.kind == "words":
            cut, order = pc.ascii_split_whitespace(texts), np.arange(len(texts))
            return order, cut.flatten(), pc.list_value_length(cut).to_numpy(zero_copy_only=False)
        uneven = pc.match_substring_regex(texts, _UNEVEN)
        even = texts.filter(pc.invert(uneven))
        even = pc.replace_substring(pc.replace_substring(even, "\n", "\x00\n\x00"), " ", "\x00 ")
        even = pc.split_pattern(even, "\x00")
        rest = [[t] if _FOREIGN.search(t) else _PIECES.findall(t) for t in texts.filter(uneven).to_pylist()]
        rest = pa.array(rest, pa.list_(pa.string()))
        mask = uneven.to_numpy(zero_copy_only=False)
        order = np.concatenate([np.flatnonzero(~mask), np.flatnonzero(mask)])
        counts = np.concatenate([pc.list_value_length(x).to_numpy(zero_copy_only=False) for x in (even, rest)])
        return order, pa.concat_arrays([even.flatten(), rest.flatten()]), counts

    def encode(self, texts) -> list[np.ndarray]:
        """The ids of each text of a list or an Arrow column; null counts as empty."""
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        if self.pieces.size > self.pieces.most:
            self.pieces.shrink()
        order, pieces, counts = self._cut(texts)
        coded = pieces.dictionary_encode()
        numbers = self.pieces.numbers(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        flat = numbers[coded.indices.to_numpy()] if len(numbers) else numbers
        ids, length = self.pieces.expand(flat)
        ends = np.concatenate([[0], np.cumsum(length)])
        bounds = ends[np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)]
        out: list = [None] * len(texts)
        for k, a, b in zip(order.tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            out[k] = ids[a:b]
        return out


@functools.lru_cache(maxsize=1)
def text_encoder(path: str, kind: str, most_bytes: int = 200 << 20) -> TextEncoder:
    """This Python worker's encoder: its tasks share the pieces that it remembers."""
    return TextEncoder(path, kind, most_bytes)


def public_path(name: str) -> str:
    """Where a public tokenizer's file lies on this machine; a path is taken as it is."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)
