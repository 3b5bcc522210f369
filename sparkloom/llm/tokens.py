"""Token ids of whole texts with a public tokenizer file, word by word.

A byte-pair tokenizer never merges across its pre-tokens, so the ids of a text
are the ids of its pieces, one after the other, wherever the text is cut
between pre-tokens. Pieces repeat, so each Python worker encodes a piece once
with the tokenizers library and remembers its ids as little-endian unsigned
32-bit integers. The memory is bounded in bytes (``MEMO_BYTES``, about): pieces
not met for long are forgotten, and a piece of over ``MEMO_CHARS`` characters
is never kept, so texts without blanks are not.

Cuts are made at a single space between two characters that are not blank in
any sense (``str.isspace``). Around any other run of blanks the text is left
in one piece. The tests compare with the library over whole texts.
"""

from __future__ import annotations

import os

MEMO_BYTES = 96 << 20
MEMO_CHARS = 64
#: What a short piece takes: two objects and its place in the table.
PIECE_BYTES = 210
_encoders: dict[tuple[str, bool], PieceEncoder] = {}


def tokenizer_path(name: str) -> str:
    """Where the public vocabulary file called ``name`` lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Memo:
    """Short pieces and their ids in two generations: when the young one is full, the old one is forgotten."""

    def __init__(self):
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def unknown(self, pieces: list[str]) -> list[str]:
        """The distinct pieces in neither generation; those of the old one become young again."""
        if len(self.young) * PIECE_BYTES > MEMO_BYTES // 4:
            self.old, self.young = self.young, {}
        new = []
        for piece in set(pieces).difference(self.young):
            ids = self.old.get(piece)
            if ids is None:
                new.append(piece)
            else:
                self.young[piece] = ids
        return new


class PieceEncoder:
    """``keep_space``: the tokenizer's pieces carry the space before them."""

    def __init__(self, name: str, keep_space: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path(name))
        self.tokenizer.encode_special_tokens = True
        self.prefix = " " if keep_space else ""
        self.first = Memo()
        self.later = self.first if not keep_space else Memo()

    def _ids(self, pieces: list[str]) -> list[bytes]:
        import numpy as np

        found = self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)
        return [np.array(x.ids, dtype="<u4").tobytes() for x in found]

    def _lookup(self, memo: Memo, pieces: list[str], prefix: str) -> list[bytes]:
        new = memo.unknown(pieces)
        if not new:
            return list(map(memo.young.__getitem__, pieces))
        found = dict(zip(new, self._ids([prefix + x for x in new] if prefix else new), strict=True))
        short = {x: ids for x, ids in found.items() if len(x) <= MEMO_CHARS}
        memo.young.update(short)
        if len(short) == len(found):
            return list(map(memo.young.__getitem__, pieces))
        known = memo.young
        return [known[x] if x in known else found[x] for x in pieces]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers; null is empty.

        Texts are cut at every space and their distinct pieces numbered by
        Arrow, so Python handles a piece once a call; texts with a space beside
        another blank go by ``pieces_of``.
        """
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        some = [k for k, text in enumerate(texts) if text]
        out = [b""] * len(texts)
        if not some:
            return out
        lists = pc.split_pattern(pa.array([texts[k] for k in some], pa.large_string()), " ")
        flat, edges = lists.flatten(), np.asarray(lists.offsets)
        is_head = np.zeros(len(flat), dtype=bool)
        is_head[edges[:-1]] = True
        heads, tails = flat.filter(pa.array(is_head)).to_pylist(), flat.filter(pa.array(~is_head)).dictionary_encode()
        distinct, codes = tails.dictionary.to_pylist(), np.asarray(tails.indices)
        odd = np.array([blank_at_an_end(x) for x in distinct], dtype=bool)
        cuts = edges - np.arange(len(edges))  # a text's tails among all tails
        crooked = np.add.reduceat(np.append(odd[codes], False), np.minimum(cuts[:-1], len(codes)), dtype=np.int64) > 0 if len(codes) else np.zeros(len(some), dtype=bool)
        crooked &= np.diff(cuts) > 0
        crooked |= np.array([blank_at_an_end(x) for x in heads])
        plain = [x for x, bad in zip(distinct, odd, strict=True) if not bad]
        ids = [b""] * len(distinct)
        for k, found in zip(np.flatnonzero(~odd).tolist(), self._lookup(self.later, plain, self.prefix), strict=True):
            ids[k] = found
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        first, store = np.cumsum(size) - size, np.frombuffer(b"".join(ids), "<u4")
        length = size[codes]
        ends = np.concatenate([[0], np.cumsum(length)])
        joined = store[np.repeat(first[codes] - ends[:-1], length) + np.arange(ends[-1])].tobytes()
        places = (4 * ends[cuts]).tolist()
        straight = np.flatnonzero(~crooked).tolist()
        for k, found in zip(straight, self._lookup(self.first, [heads[k] for k in straight], ""), strict=True):
            out[some[k]] = found + joined[places[k] : places[k + 1]]
        for k in np.flatnonzero(crooked).tolist():
            head, *rest = pieces_of(texts[some[k]])
            out[some[k]] = self._lookup(self.first, [head], "")[0] + b"".join(self._lookup(self.later, rest, self.prefix))
        return out


def blank_at_an_end(piece: str) -> bool:
    return not piece or piece[0].isspace() or piece[-1].isspace()


def pieces_of(text: str) -> list[str]:
    """Cuts at single spaces between non-blank characters; joined by spaces they are the text."""
    pieces = text.split(" ")
    if "" not in pieces and not any(x[0].isspace() or x[-1].isspace() for x in pieces):
        return pieces
    merged = [pieces[0]]
    for piece in pieces[1:]:
        last = merged[-1]
        if last and piece and not last[-1].isspace() and not piece[0].isspace():
            merged.append(piece)
        else:
            merged[-1] = f"{last} {piece}"
    return merged


def encoder(name: str, keep_space: bool) -> PieceEncoder:
    """This worker's encoder for a vocabulary file, kept between tasks."""
    if (name, keep_space) not in _encoders:
        _encoders[name, keep_space] = PieceEncoder(name, keep_space)
    return _encoders[name, keep_space]


def sliced(batch, text_column: str, limit: int = 1 << 21):
    """Slices of an Arrow batch of about ``limit`` text bytes, one row at least."""
    import numpy as np
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text_column))), 0)
    ends = np.cumsum(sizes.to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop
