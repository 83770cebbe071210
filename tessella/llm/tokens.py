"""Exact, cached encoding of whole texts with the tokenizers library."""

from __future__ import annotations

import re
import struct
import threading
import time
from collections.abc import Callable
from functools import lru_cache

import numpy as np

#: Letters and numbers among the characters for which the pattern below equals the tokenizer's own.
_L = "a-zA-ZªµºÀ-ÖØ-öø-ɏ"
_N = "0-9²³¹¼-¾"
_OTHER = rf"[^\s{_L}{_N}]+"
#: Any other character (or U+0130, whose lower case is two characters) sends the whole text to the library.
_UNUSUAL = re.compile("[^\t\n\r\x20-\x7e\xa1-įı-ž]")
_PIECES = {
    "byte": re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?{_OTHER}|\s+(?!\S)|\s+"),
    "word": re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|{_OTHER}"),
}
#: The characters of vocabularies of bytes for bytes that aren't printable in Latin-1.
_BYTE_CHARS = {b: 256 + k for k, b in enumerate([*range(33), *range(127, 161), 173])}
#: Pieces kept by a Python worker, about 200 bytes each; fewer save memory and cost time.
CACHE_ENTRIES = 900_000
#: Where words are kept beside their pieces, the share of both in that of pieces alone.
_WITH_WORDS = 1.8
#: Longer ones are not kept, so the bound on their number bounds the memory.
_LONGEST = 64
#: A Python worker that encodes nothing for so many seconds gives the cache's memory back.
_IDLE_S = 3


class _Ids(dict):
    """Ids of pieces, and of words of several pieces, as bytes; what isn't there is worked out and kept. At `most` entries all are forgotten.

    A piece is encoded by the tokenizer's model alone. `cut` finds the pieces of a word; a piece cut again is itself.
    """

    def __init__(self, tokenizer, most: int, cut: Callable[[str], list[str]] | None):
        super().__init__()
        self.tokenize, self.bytes, self.most, self.cut = tokenizer.model.tokenize, "ByteLevel" in str(tokenizer.pre_tokenizer), most, cut

    def __missing__(self, text: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        if self.cut and not text.isalpha() and len(pieces := self.cut(text)) > 1:
            data = b"".join(map(self.__getitem__, pieces))
        else:
            plain = text
            if self.bytes:
                plain = text.replace(" ", "\u0120") if text.isascii() and text.isprintable() else text.encode().decode("latin-1").translate(_BYTE_CHARS)
            ids = [t.id for t in self.tokenize(plain)]
            data = struct.pack(f"<{len(ids)}I", *ids)
        if len(text) <= _LONGEST:
            self[text] = data
        return data


class Encoder:
    """Token ids of texts as little-endian unsigned 32-bit integers.

    Tokenizers of this kind encode each piece of a text by itself, so pieces
    are cut by a pattern, each piece is encoded by the library's model once, and its ids are kept (in a bounded
    cache) as bytes that are joined per text. Where no piece holds a blank, a text is cut at its blanks first, and
    the ids of whole words are kept too, which is one look-up a word in place of a search for its pieces. Texts
    that hold a special token's string, or characters outside the checked range,
    are encoded by the library whole, so a special string has its special id.
    """

    def __init__(self, file: str, kind: str, entries: int = CACHE_ENTRIES):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        special = sorted({t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()})
        # a text without the first characters of any special string is told apart by a plain search
        self.openings, self.special = {t[:2] for t in special}, re.compile("|".join(map(re.escape, special)) or r"(?!)", re.I)
        self.kind, self.cut = kind, _PIECES[kind].findall
        self.cache = _Ids(self.tokenizer, int(entries * _WITH_WORDS), self.cut) if kind == "word" else _Ids(self.tokenizer, entries, None)
        self.lock, self.used, self.watched = threading.Lock(), 0.0, False

    def _watch(self) -> None:
        while True:
            time.sleep(_IDLE_S / 2)
            with self.lock:
                if time.monotonic() - self.used > _IDLE_S:
                    self.cache.clear()
                    self.watched = False
                    return

    def _whole(self, text: str) -> bool:
        return _UNUSUAL.search(text) is not None or any(o in text for o in self.openings) and self.special.search(text) is not None

    def encode(self, texts: list[str | None], end_id: int | None = None) -> list[bytes]:
        with self.lock:
            out = self._encode(texts, b"" if end_id is None else int(end_id).to_bytes(4, "little"))
            self.used = time.monotonic()
            if not self.watched:
                self.watched = True
                threading.Thread(target=self._watch, daemon=True).start()
        return out

    def _encode(self, texts: list[str | None], end: bytes) -> list[bytes]:
        out: list[bytes] = []
        ids = self.cache.__getitem__
        for text in texts:
            text = text or ""
            if self._whole(text):
                data = np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
            else:
                data = b"".join(map(ids, text.lower().split() if self.kind == "word" else self.cut(text)))
            out.append(data + end)
        return out


@lru_cache(maxsize=4)
def encoder(name: str, kind: str, entries: int = CACHE_ENTRIES) -> Encoder:
    """The encoder of one public vocabulary file, once per Python worker. `name` may also be a path."""
    import os

    if not os.path.isabs(name):
        import public_tokenizers

        name = public_tokenizers.path(name)
    return Encoder(name, kind, entries)
