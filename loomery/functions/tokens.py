"""Byte-pair encoding with a given vocabulary, decoding, and what is known of tokens by their lengths.

A vocabulary is a file of a public tokenizer, or merges in the order they were learnt. It is read
once on the driver, checked for its size and sent to the tasks; each worker builds its encoder once.
Texts are merged whole, by merge rank, without being split into words first, unless
the file's own splitting is asked for. The work on a text grows with n log n of its length.

An encoder holds some hundred bytes a token, so texts go to it few at a time. A text to be merged
whole is cut where no merge can reach across: between two bytes that follow each other in no
token. The tokens are the same. Only a text without such a place is encoded in one piece.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import cache
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A vocabulary is sent to all tasks; larger files than this are refused.
MOST_BYTES = 64 << 20
#: Bytes that are encoded at once, bytes of a piece of a text (about), and tokens whose lengths or bytes are looked up at once.
AT_ONCE, PIECE, LOOKED_UP = 1 << 18, 1 << 13, 1 << 18


def byte_letters() -> list[str]:
    """The letter that stands for each byte in such files: the printable ones for themselves, the rest from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


def read_vocabulary(path: str, *, split: bool = False) -> str:
    """A byte-level vocabulary from a tokenizer's JSON file, as JSON; split: with the file's own splitting of texts."""
    with open(path, encoding="utf-8") as f:
        text = f.read(MOST_BYTES + 1)
    if len(text) > MOST_BYTES:
        raise ValueError(f"{path} is over {MOST_BYTES} characters")
    model = json.loads(text)
    if not split:
        model["pre_tokenizer"] = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": False, "use_regex": False}
    return json.dumps(model | {"normalizer": None, "post_processor": None, "decoder": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": False, "use_regex": False}, "truncation": None, "padding": None})


def from_merges(merges: Sequence[tuple[int, int]], reserved: Sequence[str] = (), *, split: bool = False) -> str:
    """A vocabulary of reserved tokens, then the 256 bytes, then one token for each merge (pairs of ids without the reserved ones, in order).

    split: nothing is merged across words, and every digit is a token of its own.
    """
    letters, first = byte_letters(), len(reserved)
    if set(reserved) & set(letters):
        raise ValueError("a reserved token is a byte's letter")
    said = list(letters)
    for a, b in merges:
        said.append(said[a] + said[b])
    model = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False, "vocab": {t: i for i, t in enumerate([*reserved, *said])}, "merges": [[said[a], said[b]] for a, b in merges]}
    level = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": False, "use_regex": False}
    words = {"type": "Sequence", "pretokenizers": [{"type": "Digits", "individual_digits": True}, level | {"use_regex": True}]}
    added = [{"id": i, "content": t, "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True} for i, t in enumerate(reserved)]
    if first and len({*reserved}) != first:
        raise ValueError("reserved tokens must differ")
    return json.dumps({"version": "1.0", "truncation": None, "padding": None, "added_tokens": added, "normalizer": None, "pre_tokenizer": words if split else level, "post_processor": None, "decoder": level, "model": model})


def write_merges(merges: Iterable[tuple[int, int]], path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump({"merges": [{"pair": [a, b], "id": 256 + k} for k, (a, b) in enumerate(merges)]}, f)


def read_merges(path: str) -> list[tuple[int, int]]:
    """Merges (pairs of ids, bytes being 0 to 255) of a JSON file, in order; their ids must count up from 256."""
    with open(path, encoding="utf-8") as f:
        entries = json.load(f)["merges"]
    if [e["id"] for e in entries] != [256 + k for k in range(len(entries))]:
        raise ValueError(f"{path}: ids of merges must count up from 256")
    return [tuple(e["pair"]) for e in entries]


@cache
def encoder(vocabulary: str) -> Any:
    """The encoder of a vocabulary; strings of reserved tokens in a text are ordinary text."""
    from tokenizers import Tokenizer

    found = Tokenizer.from_str(vocabulary)
    found.encode_special_tokens = True
    return found


@cache
def token_bytes(vocabulary: str) -> list[bytes]:
    """The bytes of each id; those of reserved tokens are their text."""
    of = {c: b for b, c in enumerate(byte_letters())}
    model = json.loads(vocabulary)
    reserved = {t["content"] for t in model["added_tokens"]}
    vocab = model["model"]["vocab"] | {t["content"]: t["id"] for t in model["added_tokens"]}
    out = [b""] * (max(vocab.values()) + 1)
    for t, i in vocab.items():
        out[i] = t.encode() if t in reserved else bytes(of[c] for c in t)
    return out


@cache
def token_lengths(vocabulary: str) -> np.ndarray:
    return np.array([len(b) for b in token_bytes(vocabulary)], np.int32)


@cache
def _apart(vocabulary: str) -> np.ndarray | None:
    """For each two bytes, whether a text may be cut between them; None where texts are split into words first."""
    splitter = json.loads(vocabulary)["pre_tokenizer"]
    if splitter.get("type") != "ByteLevel" or splitter.get("use_regex", True) or splitter.get("add_prefix_space", True):
        return None
    found = np.ones((256, 256), bool)
    for token in token_bytes(vocabulary):
        b = np.frombuffer(token, np.uint8)
        found[b[:-1], b[1:]] = False
    found[:, 0x80:0xC0] = False  # within a letter
    return found


def pieces(text: str, vocabulary: str) -> list[str]:
    """A text cut into parts of PIECE bytes or a little more, wherever its tokens allow it; they are encoded as the whole is."""
    said = text.encode()
    apart = _apart(vocabulary) if len(said) > PIECE else None
    if apart is None:
        return [text]
    out, first = [], 0
    while len(said) - first > PIECE:
        cut, at = -1, first + PIECE
        while cut < 0 and at < len(said):  # looked for a stretch at a time: it is near as a rule
            b = np.frombuffer(said, np.uint8, min(PIECE, len(said) - at) + 1, at - 1)
            places = np.flatnonzero(apart[b[:-1], b[1:]])
            cut, at = (at + int(places[0]) if len(places) else -1), at + PIECE
        if cut < 0:
            break
        out.append(said[first:cut].decode())
        first = cut
    return [*out, said[first:].decode()]


def _ids(texts: Iterable[str], vocabulary: str) -> Iterator[np.ndarray]:
    """The ids of each text. Pieces are encoded AT_ONCE bytes at a time."""
    waiting: list[str] = []
    owners: list[int] = []
    size, done = 0, []

    def flush() -> Iterator[np.ndarray]:
        found = encoder(vocabulary).encode_batch_fast(waiting, add_special_tokens=False)
        for owner, f in zip(owners, found, strict=True):
            if done and owner != done[0][0]:
                yield np.concatenate([x for _, x in done])
                done.clear()
            done.append((owner, np.array(f.ids, np.int32)))
        waiting.clear()
        owners.clear()

    for k, text in enumerate(texts):
        for piece in pieces(text, vocabulary):
            waiting.append(piece)
            owners.append(k)
            size += len(piece)
            if size >= AT_ONCE:
                yield from flush()
                size = 0
    yield from flush()
    if done:
        yield np.concatenate([x for _, x in done])


def _lists(values: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, values)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *values])))


def encoded(text: Column, vocabulary: str) -> Column:
    """The ids of a text's tokens, in order; none for a null text."""

    @F.arrow_udf("array<int>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            held, n = [], 0
            for ids in _ids((x.as_py() or "" for x in texts), vocabulary):
                held.append(ids)
                n += len(ids)
                if n >= LOOKED_UP:
                    yield _lists(held)
                    held, n = [], 0
            yield _lists(held)

    return of(text)


def _looked_up(lists: pa.Array, look: Callable[[pa.Array, np.ndarray], pa.Array]) -> pa.Array:
    """What `look` makes of the ids of some rows and of where each row ends (from 0), LOOKED_UP ids at a time."""
    ends = np.cumsum(np.r_[0, pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)]).astype(np.int64)
    ids, parts, first = lists.flatten(), [], 0
    while first < len(lists):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + LOOKED_UP, "right")) - 1)
        parts.append(look(ids.slice(ends[first], ends[last] - ends[first]), ends[first : last + 1] - ends[first]))
        first = last
    return pa.concat_arrays(parts) if parts else look(ids, ends[:1])


def _bytes_of(ids: pa.Array, ends: np.ndarray, vocabulary: str) -> tuple[pa.Buffer, np.ndarray]:
    """The bytes of all ids, one after the other, and where each row's begin and end in them."""
    size = np.r_[0, np.cumsum(token_lengths(vocabulary)[ids.to_numpy()], dtype=np.int64)]
    data = _known(vocabulary).take(ids).buffers()[2]
    return data if data is not None else pa.py_buffer(b""), size[ends]


@cache
def _known(vocabulary: str) -> pa.Array:
    return pa.array(token_bytes(vocabulary), pa.binary())


def decoded(ids: Column, vocabulary: str) -> Column:
    """The text that ids stand for; bytes that are no UTF-8 become U+FFFD. A null array gives an empty text, an unknown id is an error."""

    def look(rows: pa.Array, ends: np.ndarray) -> pa.Array:
        data, places = _bytes_of(rows, ends, vocabulary)
        said = memoryview(data)
        return pa.array([str(said[a:b], "utf-8", "replace") for a, b in zip(places[:-1].tolist(), places[1:].tolist(), strict=True)], pa.string())

    @F.arrow_udf("string")
    def of(lists: pa.Array) -> pa.Array:
        return _looked_up(lists, look)

    return of(ids)


def lengths(ids: Column, vocabulary: str) -> Column:
    """The bytes of each token."""

    def look(rows: pa.Array, ends: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(token_lengths(vocabulary)[rows.to_numpy()]))

    @F.arrow_udf("array<int>")
    def of(lists: pa.Array) -> pa.Array:
        return _looked_up(lists, look)

    return of(ids)


def joined_bytes(ids: Column, vocabulary: str) -> Column:
    """The bytes that ids stand for."""

    def look(rows: pa.Array, ends: np.ndarray) -> pa.Array:
        data, places = _bytes_of(rows, ends, vocabulary)
        return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(places.astype(np.int32)), data])

    @F.arrow_udf("binary")
    def of(lists: pa.Array) -> pa.Array:
        return _looked_up(lists, look)

    return of(ids)
