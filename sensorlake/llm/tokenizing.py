"""Tokenizers of public vocabularies, as they are used inside tasks."""

from __future__ import annotations

import os
import re
from functools import cached_property, lru_cache

import numpy as np


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Entries that a memo of a task's Python process may hold, at about 200 bytes each.
MEMO = 200_000


class WordEncoder:
    """Ids of a BPE with word ends whose words never cross white space.

    A text is split at white space; the ids of these pieces come out of a memo, and those of their words out of
    another. One that holds ``memo`` entries loses the latter half of them: common words came early. Texts with characters above U+024F, or with characters that
    the two libraries see differently, go to the tokenizer whole; both ways give the same ids. So do texts that may hold
    the names of special tokens, which stand for these unless ``special`` is False.
    """

    ODD = re.compile("[^\x00-\x1b\x20-\u012f\u0131-\u024f]|<\\|")
    #: The vocabulary's own word pattern, for the characters that are not ODD.
    WORDS = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[^\W\d_\u00b2\u00b3\u00b9\u00bc-\u00be]+|[\d\u00b2\u00b3\u00b9\u00bc-\u00be]|(?:[^\s\w]|_)+")

    def __init__(self, path: str, special: bool = True, memo: int = MEMO):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        self.model = self.tokenizer.model
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        #: Bytes as the characters that the vocabulary writes for them.
        self.bytes = {b: b for b in printable} | {b: 256 + k for k, b in enumerate(others)}
        self.memo: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.most = memo

    def _bound(self, memo: dict[str, bytes]) -> None:
        if len(memo) >= self.most:
            for _ in range(self.most // 2):
                memo.popitem()

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        found = self.words.get(word)
        if found is None:
            self._bound(self.words)
            spelled = word.encode().decode("latin-1").translate(self.bytes)
            found = self.words[word] = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(spelled)])
        return found

    def ids(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if self.ODD.search(text):
            return self._whole(text)
        pieces, memo = text.lower().split(), self.memo
        found = list(map(memo.get, pieces))
        if None in found:
            for k, x in enumerate(found):
                if x is None:
                    piece = pieces[k]
                    if (x := memo.get(piece)) is None:
                        self._bound(memo)
                        x = memo[piece] = b"".join(map(self._word, self.WORDS.findall(piece)))
                    found[k] = x
        return b"".join(found)


@lru_cache(maxsize=2)
def word_encoder(path: str, special: bool = True) -> WordEncoder:
    return WordEncoder(path, special)


class ByteEncoder:
    """Byte-level BPE: ids, and the character span of each token from the lengths of the tokens in bytes."""

    def __init__(self, path: str, fallback: str):
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.lengths[rank] = len(token)
        self.fallback = fallback

    @cached_property
    def whole(self):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(self.fallback)
        t.encode_special_tokens = True
        return t

    def ids(self, text: str) -> np.ndarray:
        try:
            return self.encoding.encode_to_numpy(text, allowed_special=set(), disallowed_special=())
        except ValueError:  # the regular expression gives up on very long runs of white space
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.int64)

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, first characters, and ends (exclusive) of the last characters that the tokens touch."""
        ids = self.ids(text)
        ends = np.cumsum(self.lengths[ids])
        starts = ends - self.lengths[ids]
        if text.isascii():
            return ids, starts, ends
        raw = np.frombuffer(text.encode(), np.uint8)
        char = np.cumsum((raw & 0xC0) != 0x80) - 1
        return ids, char[starts], char[ends - 1] + 1


@lru_cache(maxsize=2)
def byte_encoder(path: str, fallback: str) -> ByteEncoder:
    return ByteEncoder(path, fallback)
