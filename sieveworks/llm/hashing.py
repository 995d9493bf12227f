"""Hashed words of whole texts as arrays, shared by the two document classifiers."""

from __future__ import annotations

from zlib import crc32

import numpy as np

END_OF_TEXT, END_OF_SENTENCE = b"\x02", b"\x01"
#: ASCII characters outside words turn into blanks, sentence ends into a token of their own.
_TABLE = bytes(1 if c in b".!?\n" else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 or c == 2 else 32 for c in range(256))


def hashed_words(texts: list[str | None], stems: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """32-bit hashes of every lower-case word of the texts, with the sentence and the text that each is in.

    One column for the whole word and one for each number of leading bytes in ``stems``.

    Sentences end at full stops, exclamation and question marks and line breaks, and are numbered through all texts;
    a text without words has neither words nor sentences here.
    """
    joined = "\x02".join([(t or "").replace("\x02", " ").lower() for t in texts]).encode("utf-8", "surrogatepass")
    words = joined.translate(_TABLE).replace(END_OF_SENTENCE, b" \x01 ").replace(END_OF_TEXT, b" \x02 ").split()
    h = np.fromiter(map(crc32, words), np.uint32, len(words))
    text_end = h == crc32(END_OF_TEXT)
    if int(text_end.sum()) != len(texts) - 1 and texts:  # some word has the separator's hash
        text_end = np.fromiter((w == END_OF_TEXT for w in words), bool, len(words))
    stop = text_end | (h == crc32(END_OF_SENTENCE))
    text = np.cumsum(text_end)[~stop]
    sentence = np.cumsum(stop)[~stop]
    if len(sentence):
        sentence = np.cumsum(np.diff(sentence, prepend=sentence[0]) > 0)
    more = [np.fromiter((crc32(w[:k], k) for w in words), np.uint32, len(words)) for k in stems]
    return np.stack([h, *more], axis=1)[~stop], sentence, text
