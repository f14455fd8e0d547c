"""Token ids of whole texts, by the tokenizers library, with each distinct word encoded once per worker.

Where a vocabulary's pre-tokenizer never joins characters across white space, a text's ids are those of its
white-space-separated chunks, one after the other. Chunks repeat: encoding each distinct one once is several times as
fast as encoding every text. A new chunk of lower-case letters, digits and ASCII signs but apostrophes is left alone by the
normaliser and cut into runs of letters, single digits and runs of signs; each part goes straight to the library's model.
Other chunks take the whole way. Both short cuts are tried on a few strings when a vocabulary is loaded, and left out if its
ids differ; tests compare whole texts.
"""

from __future__ import annotations

import os
import re
import sys
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa

#: Chunks kept at once per worker: about 200 bytes each. The older half goes when as many new ones have come.
KEEP_CHUNKS = 800_000
#: Longer chunks are encoded each time, not kept.
LONG_CHUNK = 64
#: Documents encoded at once, which bounds the texts and ids that a worker holds besides its batch.
DOCS_AT_ONCE = 1024

#: Lower-case letters that have no decomposition to undo, digits, and signs; and the parts that a chunk of them has.
_PLAIN = re.compile("[a-z0-9ß-öø-ÿ!-&(-/:-@\\[-`{-~]+")
_PARTS = re.compile("[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
_PROBES = ("the", "der,", "été.", "straße", "señor,", "zzxqj", "a", "unquestionably.", "x***", "12,5%", "a1b", "$$$", "http://a.b/c?d=e_f", "{`~|}", "é&ü")

_encoders: dict[str, Encoder] = {}


def _byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class _Known(dict):
    """Ids by chunk; a chunk that isn't known is learnt when it is asked for."""

    def __init__(self, learn):
        self.learn = learn

    def __missing__(self, chunk: bytes) -> bytes:
        ids = self.learn(chunk)
        if len(chunk) <= LONG_CHUNK:
            self[chunk] = ids
        return ids


class Encoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.special = [t.content.encode().lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.new = _Known(self._learn)
        self.old: dict[bytes, bytes] = {}
        self.by_model = False
        self.by_chunk = self.encode_whole(" ".join(_PROBES) + "\n\t" + _PROBES[0].upper()) == b"".join(map(self.encode_whole, [*_PROBES, _PROBES[0]]))
        self.by_model = self.by_chunk and array("I").itemsize == 4 and sys.byteorder == "little" and all(self._plain(p) == self.encode_whole(p) for p in _PROBES)

    def encode_whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _part(self, part: str) -> bytes:
        word = part if part.isascii() else part.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(word)]).tobytes()

    def _plain(self, chunk: str) -> bytes:
        parts = _PARTS.findall(chunk)
        if len(parts) == 1:
            return self._part(chunk)
        return b"".join([self.new[p.encode()] if self.by_model else self._part(p) for p in parts])

    def _learn(self, chunk: bytes) -> bytes:
        if (ids := self.old.get(chunk)) is not None:
            return ids
        text = chunk.decode()
        if self.by_model and chunk.isalpha() and chunk.islower():
            return self._part(text)
        if self.by_model and _PLAIN.fullmatch(text) and not (b"<" in chunk and any(s in chunk for s in self.special)):
            return self._plain(text)
        return self.encode_whole(text)

    def encode(self, texts: Iterable[bytes]) -> Iterable[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers. Texts are UTF-8."""
        for text in texts:
            if not self.by_chunk:
                yield self.encode_whole(text.decode())
                continue
            if len(self.new) > KEEP_CHUNKS // 2:
                self.old, self.new = self.new, _Known(self._learn)
            # the vocabulary is lower case; a special token's letters must stay as they are
            yield b"".join(map(self.new.__getitem__, (text if b"<|" in text else text.lower()).split()))


def encoder(path: str) -> Encoder:
    """This worker's encoder of a vocabulary file: it outlives the task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches' rows, ``DOCS_AT_ONCE`` at a time."""
    for b in batches:
        for i in range(0, b.num_rows, DOCS_AT_ONCE):
            yield b.slice(i, DOCS_AT_ONCE)


def forget() -> None:
    """What this worker's encoders have learnt goes, and they learn anew; memory that Arrow holds unused goes back to the system."""
    for e in _encoders.values():
        e.new.clear()
        e.old.clear()
    pa.default_memory_pool().release_unused()


def after_encoding(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``work`` of a stage that follows the encoding, often in the same worker: the chunks kept there go before it begins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        yield from work(batches)

    return run
