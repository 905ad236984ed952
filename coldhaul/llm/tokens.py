"""Token ids of whole texts with a public tokenizer, inside Spark tasks.

Most of the work is in words that come again and again, so a text is cut into pieces
that the tokenizer never joins, and each distinct piece is encoded once per worker.

A vocabulary that keeps white space gives a visible character the space before it, and
any longer run of white space to itself. A text may then be cut before a space that a
visible character follows, and after a line break that a visible character precedes and
no other white space follows. A piece that shows another kind of white space at its ends
sends its text down the slow way, which only cuts at single spaces. A vocabulary that
drops white space allows a cut at every space and line break. A text that holds the
string of a special token is given to the tokenizer whole. The result equals encoding
the whole text.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Collection, Iterator

VISIBLE_GAP = re.compile(r"(?<=\S)(?= \S)")
PLAIN = re.compile(r" ?\S+")
LINE = re.compile(r" ?\S+\n")
WORD = re.compile(r"[^\s\x01]+")
CACHED_PIECES = 1_000_000
TEXTS_AT_ONCE = 128
PIECES_AT_ONCE = 64

_encoders: dict[tuple[str, bool], Callable[[list[str]], list[bytes]]] = {}


class Known(dict[str, bytes | bytearray]):
    """Ids by piece; an unknown piece gets an empty buffer that is filled when it is encoded."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, piece: str) -> bytearray:
        found = self[piece] = bytearray()
        self.new.append(piece)
        return found


def encoder(path: str, spaces_matter: bool) -> Callable[[list[str]], list[bytes]]:
    """A function from texts to little-endian unsigned 32-bit ids, kept for the life of the worker.

    ``spaces_matter`` is false for a vocabulary that drops white space.
    """
    if (path, spaces_matter) not in _encoders:
        _encoders[path, spaces_matter] = _encoder(path, spaces_matter)
    return _encoders[path, spaces_matter]


def unsafe(piece: str) -> bool:
    """Whether white space beyond one space in front or one line break behind decides the cut."""
    if len(piece) < 2:
        return piece.isspace()
    return (
        (piece[0] != " " and piece[0].isspace())
        or (piece[0] == " " and piece[1].isspace())
        or (piece[-1] == "\n" and piece[-2].isspace())
    )


def _encoder(path: str, spaces_matter: bool) -> Callable[[list[str]], list[bytes]]:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import numpy as np
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    between = "\n" if spaces_matter else " \x01 "
    mark = tokenizer.encode(between, add_special_tokens=False).ids
    joinable, mark_ids = len(mark) == 1, np.array(mark, "<u4").tobytes()
    is_plain = (PLAIN if spaces_matter else WORD).fullmatch
    is_line = LINE.fullmatch
    known = Known()

    def ids_of(piece: str) -> bytes:
        return np.array(tokenizer.encode(piece, add_special_tokens=False).ids, "<u4").tobytes()

    def together(pieces: Collection[str]) -> Iterator[tuple[str, bytes]]:
        """Pieces with their ids, many in one call of the tokenizer."""
        waiting = list(pieces)
        for at in range(0, len(waiting), PIECES_AT_ONCE):
            some = waiting[at : at + PIECES_AT_ONCE]
            found = np.array(tokenizer.encode(between.join(some), add_special_tokens=False).ids, "<u4")
            edges = [*np.flatnonzero(found == mark[0]).tolist(), len(found)]
            if len(edges) != len(some):
                raise ValueError("the separator is not a token of its own")
            raw, start = found.tobytes(), 0
            for piece, edge in zip(some, edges):
                yield piece, raw[4 * start : 4 * edge]
                start = edge + 1

    def learn(pieces: list[str]) -> set[str]:
        """Give new pieces their ids; those that decide a cut wrongly are forgotten and returned."""

        def put(piece: str, ids: bytes) -> None:
            known[piece].extend(ids)
            known[piece] = ids

        plain, lines, slow = [], [], set()
        for piece in pieces:
            if joinable and is_plain(piece):
                plain.append(piece)
            elif joinable and is_line(piece):
                lines.append(piece)
            elif spaces_matter and unsafe(piece):
                slow.add(piece)
                del known[piece]
            else:
                put(piece, ids_of(piece))
        for piece, ids in together(plain):
            known[piece].extend(ids)
            known[piece] = ids
        # The line break behind a word is the separator itself, a token of its own.
        known.update(together({body for p in lines if (body := p[:-1]) not in known}))
        for piece in lines:
            put(piece, known[piece[:-1]] + mark_ids)
        return slow

    def cut(text: str) -> list[str]:
        if not spaces_matter:
            return text.replace("\n", " ").split(" ")
        if "\0" in text:
            return VISIBLE_GAP.split(text)
        return text.replace(" ", "\0 ").replace("\n", "\n\0").split("\0")

    def encode(texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for at in range(0, len(texts), TEXTS_AT_ONCE):
            some = texts[at : at + TEXTS_AT_ONCE]
            if len(known) > CACHED_PIECES:
                known.clear()
            found = [None if any(x in t for x in special) else list(map(known.__getitem__, cut(t))) for t in some]
            new, known.new = known.new, []
            slow = learn(new)
            for text, parts in zip(some, found):
                if parts is None:
                    out.append(ids_of(text))
                elif slow and not slow.isdisjoint(cut(text)):
                    out.append(b"".join([ids_of(p) for p in VISIBLE_GAP.split(text)]))
                else:
                    out.append(b"".join(parts))
        return out

    return encode
