"""Index terms of whole batches of texts at once, on the bytes of Arrow arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quillspark.functions.text import MIN_WORD, STOP_WORDS, WORD_CAP

#: Bytes of text, about, that are taken in one go.
CHUNK = 1 << 22

_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True

#: Letters of the longest stop word.
_LONGEST_STOP = max(map(len, STOP_WORDS))


def _gathered(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    """The stretches of a buffer as an array of strings."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    at = np.arange(total, dtype=np.int64) + np.repeat(start - (ends - size), size)
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[at]))])


def _chunks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row past the last, bytes, bounds of rows in them) of runs of rows of about CHUNK bytes, one longer row at least."""
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    held = texts.buffers()[2]
    data = np.frombuffer(held, dtype=np.uint8) if held is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = min(max(int(np.searchsorted(offsets, offsets[lo] + CHUNK, side="right")) - 1, lo + 1), len(texts))
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def _words(texts: pa.Array, stop_words: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, bytes, bounds of rows in them, row, start and size of each word, whether it is dropped as a stop word) of some rows at a time."""
    for lo, hi, data, bounds in _chunks(texts):
        if not len(data):
            continue
        letter = _LETTER[data]
        first = np.zeros(len(data) + 1, dtype=bool)
        first[bounds] = True  # no run passes a row's border
        opens = letter.copy()
        opens[1:] &= ~letter[:-1] | first[1:-1]
        closes = letter
        closes[:-1] &= ~letter[1:] | first[1:-1]
        start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        size = end - start
        long = size >= MIN_WORD
        start, end, size = start[long], end[long], size[long]
        row = np.searchsorted(bounds, start, side="right") - 1
        last = end == bounds[row + 1]
        over = (size > WORD_CAP) & ~last
        start = np.where(over, end - WORD_CAP, start)
        size = end - start
        stop = np.zeros(len(start), dtype=bool)
        if stop_words:
            some = np.flatnonzero(~last & (size <= _LONGEST_STOP) & (data[start] < 97))  # in capitals, as stop words are
            stop[some] = pc.is_in(_gathered(data, start[some], size[some]), value_set=pa.array(sorted(STOP_WORDS))).to_numpy(zero_copy_only=False).astype(bool)
        yield lo, data, bounds, row, start, size, stop


def terms_of(texts: pa.Array, stop_words: bool = True) -> Iterator[tuple[np.ndarray, pa.Array, np.ndarray]]:
    """(row, term, position) of the index terms of an array of texts, some rows at a time: what text.tokens() gives, null texts nothing."""
    for lo, data, bounds, row, start, size, stop in _words(texts, stop_words):
        keep = np.flatnonzero(~stop)
        start, size, row = start[keep], size[keep], row[keep]
        letters = np.cumsum((data & 0xC0) != 0x80)  # characters up to and with each byte
        base = np.concatenate([[0], letters])[bounds[row]]
        yield lo + row, _gathered(data & 0xDF, start, size), (letters[start] - 1 - base).astype(np.int32)


def grouped(row: np.ndarray, term: pa.Array, pos: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray, pa.Array]:
    """(row, term, count, positions) of each term of each row, by term, then row; positions rise."""
    code = term.dictionary_encode()
    by_name = pc.sort_indices(code.dictionary).to_numpy().astype(np.int64)
    rank = np.empty(len(by_name), dtype=np.int64)
    rank[by_name] = np.arange(len(by_name))
    wide = int(row.max()) + 1 if len(row) else 1
    key = rank[code.indices.to_numpy(zero_copy_only=False)] * wide + row
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(key)), dtype=bool), key[1:] != key[:-1]]))
    count = np.diff(np.append(first, len(key))).astype(np.int32)
    places = pa.ListArray.from_arrays(pa.array(np.append(first, len(key)).astype(np.int32)), pa.array(pos[order]))
    return key[first] % wide, code.dictionary.take(pa.array(by_name[key[first] // wide])), count, places


def postings_batches(batches: Iterator[pa.RecordBatch], stop_words: bool = True) -> Iterator[pa.RecordBatch]:
    """(segment, term, doc_id, tf, places) of batches of (segment, doc_id, text), some rows at a time, those of a segment by term, then id: so a later sort only merges."""
    for b in batches:
        b = b.take(pc.sort_indices(b, sort_keys=[(b.schema.names[0], "ascending"), (b.schema.names[1], "ascending")])) if b.num_rows > 1 else b
        for row, term, pos in terms_of(b.column(2), stop_words):
            at, word, count, places = grouped(row, term, pos)
            rows = pa.array(at)
            yield pa.RecordBatch.from_arrays([b.column(0).take(rows), word, b.column(1).take(rows), pa.array(count), places], names=["segment", "term", "doc_id", "tf", "places"])


def stop_word_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, with_stop_words, kept) of batches of (doc_id, text): how many index terms each text has with its stop words, and without; null texts have none."""
    for b in batches:
        every, dropped = np.zeros(b.num_rows, np.int32), np.zeros(b.num_rows, np.int32)
        for lo, _, bounds, row, _, _, stop in _words(b.column(1), True):
            rows = slice(lo, lo + len(bounds) - 1)
            every[rows] = np.bincount(row, minlength=len(bounds) - 1)
            dropped[rows] = np.bincount(row[stop], minlength=len(bounds) - 1)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(every), pa.array(every - dropped)], names=["doc_id", "with_stop_words", "kept"])
