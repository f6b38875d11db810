"""Whole texts to ids with a public tokenizer, fast where texts share words.

Both vocabularies split texts into words before they merge, so the ids of a text are those of its words, one after the other. A
worker keeps the ids of the words it has met, up to a bound, and gives the library only new words: many in one call, as the ids
show where a word begins or ends.
"""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import regex

CACHED_CHUNKS, CACHED_WORDS = 100_000, 500_000
SLICE_CHARS = 2 << 20
TOGETHER = 500
# Fixed value: the word pattern of the lower-casing vocabulary.
LOWER_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _keep(known: dict, new: list, bound: int) -> None:
    """Take back what was added beyond the bound."""
    for key in new[max(0, bound - (len(known) - len(new))):]:
        del known[key]


class ChunkTokenizer:
    """ids of texts as little-endian unsigned 32-bit bytes.

    ``leading``: words keep the space before them and nothing is normalized (byte-level vocabulary); else words are
    lower-cased and end in a mark (word-end vocabulary). The latter normalizes Unicode, so texts are split into words here only
    if they hold nothing but letters and signs up to U+024F, less the dotted capital I, which normalize to themselves but
    for case. Other texts are cut at spaces, and of these chunks those with other signs go to the library whole.
    """

    def __init__(self, path: str, leading: bool) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._library = Tokenizer.from_file(path)
        self._library.encode_special_tokens = True  # their strings in a text are ordinary text
        self._leading = leading
        self._chunks: dict[str, bytes] = {}
        self._words: dict[str, bytes] = {}
        vocabulary = self._library.get_vocab()
        self._marks = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, number in vocabulary.items():
            self._marks[number] = token.startswith("\u0120") if leading else token.endswith("</w>")
        self._split = regex.compile(public_tokenizers.PATTERN if leading else LOWER_PATTERN).findall
        self._plain = re.compile("[\x00-\u012f\u0131-\u024f]*").fullmatch

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self._library.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, words: list[str]) -> list[bytes]:
        """ids of words that the library tells apart in one text."""
        text = ("" if self._leading else " ").join(words)
        ids = np.array(self._library.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
        marked = np.flatnonzero(self._marks[ids])
        cuts = marked if self._leading else np.concatenate(([0], marked + 1))
        if len(marked) != len(words) or cuts[0]:
            return self._ids(words)
        raw, ends = ids.tobytes(), [*(4 * cuts).tolist(), 4 * len(ids)]
        return [raw[a:b] for a, b in zip(ends, ends[1:])]

    def _learn_words(self, words: set[str]) -> list[str]:
        new = list(words.difference(self._words))
        clear = [w for w in new if not self._leading or w[0] == " " and len(w) > 1 and not w[1].isspace()]
        for at in range(0, len(clear), TOGETHER):
            some = clear[at:at + TOGETHER]
            self._words.update(zip(some, self._joined(some)))
        rest = [w for w in new if w not in self._words]
        self._words.update(zip(rest, self._ids(rest)))
        return new

    def encode(self, texts: list[str]) -> list[bytes]:
        if self._leading:
            split = [self._split(text) for text in texts]
        else:
            split = [self._split(text.lower()) if self._plain(text) else None for text in texts]
        new = self._learn_words(set().union(*filter(None, split)))
        find = self._words.__getitem__
        out = [b"" if words is None else b"".join(map(find, words)) for words in split]
        _keep(self._words, new, CACHED_WORDS)
        odd = [i for i, words in enumerate(split) if words is None]
        for i, ids in zip(odd, self._by_chunks([texts[i] for i in odd])):
            out[i] = ids
        return out

    def _by_chunks(self, texts: list[str]) -> list[bytes]:
        cut = [text.split(" ") for text in texts]
        new = list(set().union(*cut).difference(self._chunks))
        own = [chunk for chunk in new if self._plain(chunk)]
        whole = [chunk for chunk in new if not self._plain(chunk)]
        split = [self._split(chunk.lower()) for chunk in own]
        words = self._words
        new_words = self._learn_words(set().union(*split))
        self._chunks.update((chunk, b"".join([words[w] for w in some])) for chunk, some in zip(own, split))
        self._chunks.update(zip(whole, self._ids(whole)))
        find = self._chunks.__getitem__
        out = [b"".join(map(find, pieces)) for pieces in cut]
        _keep(self._chunks, own + whole, CACHED_CHUNKS)
        _keep(words, new_words, CACHED_WORDS)
        return out


@functools.lru_cache(maxsize=4)
def tokenizer(path: str, leading: bool) -> ChunkTokenizer:
    """One per worker and vocabulary, kept between tasks."""
    return ChunkTokenizer(path, leading)


def encoded(batches: Iterable, path: str, leading: bool) -> Iterator[tuple]:
    """From Arrow batches with doc_id and text: (doc_id, ids) per row, a few megabytes of text at a time; null text is empty."""
    coder = tokenizer(path, leading)
    for batch in batches:
        ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
        at = 0
        while at < len(ids):
            some, chars = [], 0
            while at + len(some) < len(ids) and (not some or chars < SLICE_CHARS):
                some.append(texts[at + len(some)].as_py() or "")
                chars += len(some[-1])
            yield from zip(ids[at:at + len(some)], coder.encode(some))
            at += len(some)
