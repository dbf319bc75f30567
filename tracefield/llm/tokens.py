"""Token ids of whole texts by the ``tokenizers`` library, memoised by word.

The vocabulary used here lower-cases, drops white space and never joins
characters across it, so the ids of a text are those of its white-space
separated chunks in order.  A chunk of plain letters followed by punctuation
is in turn the ids of its lower-cased letters and of its punctuation.  Each
process keeps the ids of chunks and words it has met, up to a bound, so the
library runs once per new word instead of once per occurrence.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

#: Letters that lower-case one to one and never compose with what follows
#: here, then ASCII punctuation without the apostrophe.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)").fullmatch
_OPEN: dict[str, "Encoder"] = {}


def encoder(path: str) -> "Encoder":
    """This process's encoder for a ``tokenizers`` file."""
    if path not in _OPEN:
        _OPEN[path] = Encoder(path)
    return _OPEN[path]


class Encoder:
    """``max_chunks`` and ``max_words`` bound the memory of the memo, at about
    150 bytes an entry; a full memo is emptied and fills again."""

    def __init__(self, path: str, max_chunks: int = 250_000, max_words: int = 250_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        described = json.loads(self.tokenizer.to_str())
        vocabulary = described["model"]["vocab"]
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        # the shortcut needs marked word ends and a normaliser that lower-cases
        self.by_word = described["model"].get("end_of_word_suffix") == "</w>" and '"Lowercase"' in json.dumps(described["normalizer"])
        self.max_chunks, self.max_words = max_chunks, max_words
        self.chunks: dict[bytes, bytes] = {}
        self.words: dict[str, bytes] = {}

    def ids_of(self, tokens: list[str]) -> list[int]:
        """The ids of vocabulary entries that exist among ``tokens``."""
        found = map(self.tokenizer.token_to_id, tokens)
        return [i for i in found if i is not None]

    def _direct(self, texts: list[str]) -> list[bytes]:
        got = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, "<u4").tobytes() for x in got]

    def _learn_words(self, words: list[str]) -> None:
        """One call for all new words; each ends at the token that closes it."""
        ids = np.frombuffer(self._direct([" ".join(words)])[0], "<u4")
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) != len(words) or cuts[-1] != len(ids):
            self.words.update(zip(words, self._direct(words)))
            return
        data, at = ids.tobytes(), 0
        for word, cut in zip(words, (cuts * 4).tolist()):
            self.words[word] = data[at:cut]
            at = cut

    def _learn(self, chunks: set[bytes]) -> None:
        if len(self.chunks) > self.max_chunks:
            self.chunks.clear()
            chunks = chunks | self._now
        if len(self.words) > self.max_words:
            self.words.clear()
        plain, odd = [], []
        for chunk in chunks:
            found = _PLAIN(text := chunk.decode())
            if found:
                plain.append((chunk, found[1].lower(), found[2]))
            else:
                odd.append((chunk, text))
        new = {w for x in plain for w in x[1:] if w and w not in self.words}
        if new:
            self._learn_words(list(new))
        words = self.words
        for chunk, letters, marks in plain:
            self.chunks[chunk] = words[letters] + words[marks] if marks else words[letters]
        if odd:
            self.chunks.update(zip((c for c, _ in odd), self._direct([t for _, t in odd])))

    def forget(self) -> None:
        """Give the memory of the chunks back; words stay."""
        self.chunks.clear()

    def encode(self, text: str | None) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers; a null
        text has none."""
        if not text:
            return b""
        if not self.by_word:
            return self._direct([text])[0]
        parts = text.encode().split()
        self._now = set(parts)
        new = self._now.difference(self.chunks)
        if new:
            self._learn(new)
        return b"".join(map(self.chunks.__getitem__, parts))
