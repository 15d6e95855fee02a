"""Encoding whole texts with the ``tokenizers`` library, each distinct piece once per worker.

A byte-level BPE without normaliser never joins characters across a single space between
two words, and one that drops white space never across any ASCII white space. So a text
is cut there, and beside line feeds and punctuation where both patterns cut, unknown pieces are encoded by the library, and known ones come from a
bounded table of numpy arrays, so no Python object is made for a piece that is known. A tokenizer of any other make, and any text whose cuts would not be
safe, is encoded whole. The ids are those of ``encode(text, add_special_tokens=False)``.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from functools import cache

import numpy as np
import pyarrow as pa
import regex

from quarryline.llm.common import flat_text, hash_words, mix, word_spans

_U = np.uint64

#: Bytes of text whose distinct pieces are looked up at once.
ENCODE_BYTES = 2 << 20
#: Pieces that a worker keeps.
CACHE_PIECES = 2_000_000

#: Characters whose classes no version of Unicode disputes, without odd spaces or controls.
_LATIN = re.compile("[\\t\\n !-~\u00a1-\u00ac\u00ae-\u024f]*").fullmatch
#: One part of either pattern: letters, after a space at most.
_LETTERS = re.compile(" ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+").fullmatch
#: The two pre-tokenizers' patterns. They are those of the public vocabulary files.
_SPACE_PARTS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_WORD_PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"


_LETTER, _MARK, _SPACE = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
#: ASCII punctuation but for the apostrophe, which may start a part with the letters after it.
_MARK[[b for b in range(33, 127) if not chr(b).isalnum() and b != 39]] = True
_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
#: What tells pieces after a space or a line feed from equal ones at the start of a text.
_PREFIX = np.array([0, 0x5851F42D4C957F2D, 0x14057B7EF767814F], np.uint64)


def _byte_chars() -> dict[int, str]:
    """How byte-level vocabularies spell a byte: itself if it prints in Latin-1, else the next free character from 256."""
    prints = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(256 + i) for i, b in enumerate(others)}


_BYTE_CHARS = _byte_chars()


def public_path(name: str) -> str:
    """Where the installed vocabulary files lie."""
    import public_tokenizers

    return public_tokenizers.path(name)


class PieceTable:
    """Ids of known pieces by the piece's 64-bit hash: sorted keys, and places in a pool of ids.

    About 30 bytes a piece. Beyond ``CACHE_PIECES`` it starts anew.
    """

    #: A piece at which the text must not be cut has this many ids.
    UNSAFE = (1 << 24) - 1

    def __init__(self):
        self.keys, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.pool, self.filled = np.zeros(1 << 16, np.uint32), 0

    def look_up(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of ascending distinct keys, and which of them are known."""
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        known = self.keys[at] == keys
        return self.place[at], known

    def add(self, keys: np.ndarray, found: list[bytes | None]) -> np.ndarray:
        """Take in new ascending keys with their ids (None: unsafe); returns their places."""
        sizes = np.array([self.UNSAFE if f is None else len(f) // 4 for f in found], np.int64)
        ids = np.frombuffer(b"".join([f for f in found if f]), "<u4")
        if self.filled + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.filled], np.zeros(self.filled + 2 * len(ids), np.uint32)])
        self.pool[self.filled : self.filled + len(ids)] = ids
        held = np.where(sizes == self.UNSAFE, 0, sizes)
        place = (self.filled + np.cumsum(held) - held) << 24 | sizes
        self.filled += len(ids)
        at = np.searchsorted(self.keys, keys)
        self.keys, self.place = np.insert(self.keys, at, keys), np.insert(self.place, at, place)
        return place

    def forget(self) -> None:
        self.keys, self.place, self.filled = self.keys[:0], self.place[:0], 0

    def gather(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start in the ids, size as stored, ids) of the pieces at these places, one after another."""
        sizes = place & self.UNSAFE
        held = np.where(sizes == self.UNSAFE, 0, sizes)
        start = np.cumsum(held) - held
        return start, sizes, self.pool[np.repeat((place >> 24) - start, held) + np.arange(int(held.sum()))]


class PieceEncoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        plain = model["type"] == "BPE" and not model.get("dropout") and not spec.get("post_processor")
        self.mode = "whole"  # until one of the two known makes is recognised
        if plain and not spec.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
            self.mode = "space"
        elif plain and self._drops_space(spec):
            self.mode = "word"
        # A special token's string in a text is encoded as that token, so no cut may fall inside one.
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        if any(c.isspace() for t in self.special for c in t) or any(t.get("lstrip") or t.get("rstrip") for t in spec.get("added_tokens", [])):
            self.mode = "whole"
        self.model = self.tok.model
        self.table = PieceTable()
        self.parts: dict[str, bytes] = {}
        self.line_feed = self._ids(["\n"])[0]
        self.split = regex.compile(_WORD_PARTS if self.mode == "word" else _SPACE_PARTS).findall

    @staticmethod
    def _drops_space(spec: dict) -> bool:
        norm = spec.get("normalizer") or {"type": "Sequence", "normalizers": []}
        steps = norm["normalizers"] if norm["type"] == "Sequence" else [norm]
        pre = spec.get("pre_tokenizer") or {}
        parts = pre.get("pretokenizers", [pre])
        first = parts[0] if parts else {}
        return all(s["type"] in ("NFC", "Lowercase", "Replace") and s.get("content", " ") == " " for s in steps) and first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") is True and first.get("pattern", {}).get("Regex", "").replace("[\\p{L}]", "\\p{L}").replace("[\\p{N}]", "\\p{N}") == _WORD_PARTS and all(p.get("type") == "Split" or not p.get("add_prefix_space") for p in parts)

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _part_ids(self, part: str) -> bytes:
        """Ids of what the pre-tokenizer would cut out as one part, from the tokenizer's BPE model."""
        spelt = part.replace(" ", "\u0120") if part.isascii() and part.isprintable() else part.encode().decode("latin-1").translate(_BYTE_CHARS)
        return array("I", [t.id for t in self.model.tokenize(spelt)]).tobytes()

    def _piece_ids(self, piece: str) -> bytes:
        """Ids of a short piece: of plain Latin characters, part by part; of others, by the whole tokenizer."""
        if _LETTERS(piece):
            return self._part_ids(piece.lower() if self.mode == "word" else piece)
        if not _LATIN(piece):
            return self._ids([piece])[0]
        out = []
        for part in self.split(piece.lower() if self.mode == "word" else piece):
            ids = self.parts.get(part)
            if ids is None:
                ids = self.parts[part] = self._part_ids(part)
            out.append(ids)
        return b"".join(out)

    def _found(self, piece: str, prefix: int) -> bytes | None:
        """Ids of a piece with the space (1) or line feed (2) before it; None if the text must not be cut beside it."""
        if self.mode == "word":
            return self._piece_ids(piece)
        if not prefix:
            return self._piece_ids(piece) if piece == piece.rstrip() else None
        if not piece or piece != piece.strip():
            return None
        return self._piece_ids(" " + piece) if prefix == 1 else self.line_feed + self._piece_ids(piece)

    def _pieces(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Start, end, row and prefix of each piece.

        Cuts are at single spaces (or at white space, where it is dropped), at line feeds
        between other characters, and before ASCII punctuation after an ASCII letter: either
        pattern ends a part there.
        """
        mark = np.flatnonzero(_LETTER[data[:-1]] & _MARK[data[1:]]) + 1 if len(data) else np.zeros(0, np.int64)
        mark = mark[offs[np.searchsorted(offs, mark)] != mark] if len(mark) else mark
        if self.mode == "word":
            s, e, _ = word_spans(data, offs)
            start, end = np.sort(np.concatenate([s, mark])), np.sort(np.concatenate([e, mark]))
            return start, end, np.searchsorted(offs, start, "right") - 1, np.zeros(len(start), np.int8)
        full = np.flatnonzero(offs[1:] > offs[:-1])
        feed = np.flatnonzero(data == 10)
        feed = feed[(feed > 0) & (feed < len(data) - 1)]
        feed = feed[~_SPACE[data[feed - 1]] & ~_SPACE[data[feed + 1]]]
        cut = np.concatenate([np.flatnonzero(data == 32), feed])
        every = np.sort(np.concatenate([cut, mark]), kind="stable")
        breaks = np.searchsorted(every, offs[1:][full]) - np.searchsorted(every, offs[:-1][full])
        start = np.sort(np.concatenate([offs[:-1][full], cut + 1, mark]), kind="stable")
        end = np.sort(np.concatenate([cut, mark, offs[1:][full]]), kind="stable")
        row = np.repeat(full, breaks + 1)
        before = data[start - 1]
        prefix = np.where(start == offs[row], 0, np.where(before == 32, 1, np.where(before == 10, 2, 0)))
        return start, end, row, prefix

    def _whole_rows(self, raw: bytes, offs: np.ndarray) -> set[int]:
        """Rows with a special token's string: a cut might fall inside it."""
        rows = set()
        for token in self.special:
            at = raw.find(token.encode())
            while at >= 0:
                rows.add(int(np.searchsorted(offs, at, "right")) - 1)
                at = raw.find(token.encode(), at + 1)
        return rows

    def encode_flat(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts in a byte buffer, one after another, and their bounds (rows + 1)."""
        n, raw = len(offs) - 1, data.tobytes()
        if self.mode == "whole":
            return self._joined(self._ids([raw[a:b].decode() for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]))
        s, e, row, prefix = self._pieces(data, offs)
        keys = hash_words(data, s, e)
        if self.mode == "space":
            keys ^= _PREFIX[prefix]
        keys, first, back = np.unique(keys, return_index=True, return_inverse=True)
        place, known = self.table.look_up(keys)
        table = self.table
        if not known.all():
            new = np.flatnonzero(~known)
            if len(self.parts) > CACHE_PIECES // 8:
                self.parts.clear()
            at = first[new]
            found = [self._found(raw[a:b].decode(), p) for a, b, p in zip(s[at].tolist(), e[at].tolist(), prefix[at].tolist(), strict=True)]
            if len(table.keys) + len(new) > CACHE_PIECES:  # known pieces are read before the table starts anew
                start, sizes, ids = table.gather(place[known])
                table.forget()
                place[known] = table.add(keys[known], [None if k == table.UNSAFE else ids[a : a + k].tobytes() for a, k in zip(start.tolist(), sizes.tolist(), strict=True)])
            place[new] = table.add(keys[new], found)
        place = place[back]
        _, sizes, ids = table.gather(place)
        unsafe = sizes == table.UNSAFE
        bounds = np.concatenate([[0], np.cumsum(np.bincount(row, np.where(unsafe, 0, sizes), n).astype(np.int64))])
        whole = self._whole_rows(raw, offs).union(np.unique(row[unsafe]).tolist())
        if not whole:
            return ids, bounds
        out = [ids[a:b].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        for i in whole:
            out[i] = self._ids([raw[offs[i] : offs[i + 1]].decode()])[0]
        return self._joined(out)

    @staticmethod
    def _joined(ids: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        bounds = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int64)
        return np.frombuffer(b"".join(ids), "<u4"), bounds

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        ids, bounds = self.encode_flat(*flat_text(pa.array(texts, pa.large_string())))
        return [ids[a:b].astype("<u4").tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


@cache
def encoder(path: str) -> PieceEncoder:
    """One encoder for each file in a worker, kept between tasks."""
    return PieceEncoder(path)
