"""Encoding of whole texts with a vocabulary of the ``tokenizers`` library.

The pre-tokeniser used here never joins what white space parts, nor a letter and
the ASCII marks after it, so a text's ids are those of its words' pieces in order.
Arrow cuts a batch into words, words into pieces, and finds the distinct pieces;
each worker keeps a table of pieces it has encoded, bounded in bytes, so the
library sees a frequent piece about once, not once a row.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of pieces and ids that a worker keeps, in two generations. Speed only.
CACHE_BYTES = 16 << 20
#: Longer pieces are encoded each time they occur.
CACHE_LENGTH = 64
#: Bytes of text encoded at once.
PART = 2 << 20
#: What may be cut off a word's end: with an apostrophe, the pre-tokeniser may not.
MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'")
#: Letters after which marks may be cut: the same in lower case and normal form.
LETTER = "[a-zß-öø-ÿ]$"
#: Pieces handed to the library as one line.
LINE = 1024


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def encoder(path: str) -> "WordEncoder":
    return WordEncoder(path)


class WordEncoder:
    """Gives texts' ids, as ``Tokenizer.encode(text, add_special_tokens=False)``
    does. A null text has none. A text that holds the opening of a special token
    goes to the library whole, as all do where a vocabulary's normaliser is not
    known to keep words apart."""

    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        folds = [x.get("type") for x in (rules.get("normalizer") or {}).get("normalizers", [])]
        specials = [t["content"] for t in rules.get("added_tokens", [])]
        self.by_word = folds == ["NFC", "Replace", "Lowercase"] and all(s.startswith("<|") for s in specials)
        ends = [t.endswith("</w>") for t, _ in sorted(self.tokenizer.get_vocab().items(), key=lambda x: x[1])]
        self.ends = np.array(ends)
        self.cache_bytes = cache_bytes
        self.known = self.older = _table([], [])  # pieces met lately move back to known

    def parts(self, batches):
        """(the batch, ids, offsets of its rows in ids) of record batches whose
        second column is text. They are joined or cut to a bounded length, as more
        text holds fewer different words; a row is never parted."""
        held, size = [], 0
        for batch in batches:
            for part in self._cut(batch):
                held.append(part)
                size += part.column(1).nbytes
                if size >= PART:
                    yield self._encoded(held)
                    held, size = [], 0
        if held:
            yield self._encoded(held)

    def _encoded(self, held: list[pa.RecordBatch]):
        batch = held[0] if len(held) == 1 else pa.concat_batches(held)
        return batch, *self.encode(batch.column(1))

    @staticmethod
    def _cut(batch: pa.RecordBatch):
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + PART, side="right")))
            yield batch.slice(at, to - at)
            at = to

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids (int32), and where each row's begin and the last's end."""
        texts = pc.fill_null(texts, "")
        if not self.by_word:
            return _flat(self._whole(texts))
        special = pc.match_substring(texts, "<|")
        at = np.flatnonzero(special.to_numpy(zero_copy_only=False))
        ids, ends = self._by_words(pc.if_else(special, "", texts) if len(at) else texts)
        if len(at):  # empty so far: their ids go in between the others'
            theirs, theirs_end = _flat(self._whole(texts.take(pa.array(at))))
            size = np.diff(theirs_end)
            ids = np.insert(ids, np.repeat(ends[at], size), theirs)
            added = np.zeros(len(ends), np.int64)
            added[at + 1] = size
            ends = ends + np.cumsum(added)
        return ids, ends

    def _whole(self, texts: pa.Array) -> pa.ListArray:
        got = self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)
        return _lists([np.array(x.ids, np.int32) for x in got])

    def _by_words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        words = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        coded = words.values.dictionary_encode()
        pieces = _halves(coded.dictionary).dictionary_encode()
        halves = self.lookup(pieces.dictionary).take(pieces.indices)
        # a word's ids: its two pieces', which lie side by side
        per_word = pa.ListArray.from_arrays(halves.offsets[::2], halves.values)
        ids, ends = _flat(per_word.take(coded.indices))
        return ids, ends[words.offsets.to_numpy()]

    def lookup(self, pieces: pa.StringArray) -> pa.ListArray:
        """The ids of each of ``pieces``, all different."""
        at = pc.index_in(pieces, value_set=self.known["piece"])
        new = pieces.filter(pc.is_null(at))
        if len(new):
            back = pc.index_in(new, value_set=self.older["piece"])
            moved = self.older.take(pc.drop_null(back))
            learnt = self._learn(new.filter(pc.is_null(back)))
            short = learnt.filter(pc.less_equal(pc.binary_length(learnt["piece"]), CACHE_LENGTH))
            every = pa.concat_batches([self.known, moved, learnt])
            kept = pa.concat_batches([self.known, moved, short])
            at = pc.index_in(pieces, value_set=every["piece"])
            if kept.nbytes > self.cache_bytes // 2:
                self.known, self.older = _table([], []), kept
            else:
                self.known = kept
        else:
            every = self.known
        return every["ids"].take(at)

    def _learn(self, new: pa.StringArray) -> pa.RecordBatch:
        """Pieces of letters alone are one pre-token each, whose last id is one that
        ends a word: a line of them is encoded at once and cut there."""
        letters = pc.utf8_is_alpha(new)
        lined, others = new.filter(letters).to_pylist(), new.filter(pc.invert(letters)).to_pylist()
        tables = []
        for at in range(0, len(lined), LINE):
            line = lined[at : at + LINE]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(line)], add_special_tokens=False)[0].ids, np.int32)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(line):
                offsets = pa.array(np.concatenate([[0], ends]), pa.int32())
                tables.append(_table(line, pa.ListArray.from_arrays(offsets, pa.array(ids))))
            else:
                others += line
        for at in range(0, len(others), LINE):
            part = pa.array(others[at : at + LINE], pa.string())
            tables.append(_table(part, self._whole(part)))
        return pa.concat_batches(tables) if tables else _table([], [])


def _table(pieces, ids) -> pa.RecordBatch:
    lists = ids if isinstance(ids, pa.Array) else pa.array(ids, pa.list_(pa.int32()))
    return pa.RecordBatch.from_arrays([pieces if isinstance(pieces, pa.Array) else pa.array(pieces, pa.string()), lists], ["piece", "ids"])


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in rows])])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *rows])))


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of all rows, and where each row's begin and the last's end."""
    offsets = lists.offsets.to_numpy().astype(np.int64)
    return lists.values.to_numpy()[offsets[0] : offsets[-1]], offsets - offsets[0]


def _halves(words: pa.StringArray) -> pa.StringArray:
    """Each word as two strings of the same bytes: up to the ASCII marks after its
    last letter, and these; the second is empty where there are none."""
    stems = pc.utf8_rtrim(words, characters=MARKS)
    parted = pc.match_substring_regex(stems, LETTER).to_numpy(zero_copy_only=False)
    offsets = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1, 4 * words.offset) if len(words) else np.zeros(1, np.int32)
    both = np.empty(2 * len(words) + 1, np.int32)
    both[::2] = offsets
    both[1::2] = np.where(parted, offsets[:-1] + pc.binary_length(stems).to_numpy(), offsets[1:])
    return pa.StringArray.from_buffers(2 * len(words), pa.py_buffer(both), words.buffers()[2])


def with_end(ids: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows' ids with ``end`` after each row's, and the new offsets."""
    rows = np.arange(len(offsets) - 1)
    out = np.full(len(ids) + len(rows), end, np.int32)
    out[np.arange(len(ids)) + np.repeat(rows, np.diff(offsets))] = ids
    return out, offsets + np.arange(len(offsets))
