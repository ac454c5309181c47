"""Encoding whole texts with the ``tokenizers`` library, one distinct piece at a time."""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np

#: Pieces in one of the two generations that a Python worker keeps: a full one becomes the old one.
CACHED_PIECES = 450_000
#: A run of these after letters is a unit of its own. The apostrophe is not: it joins with some letters.
MARKS = ".,;:!?%*#$&|<>()[]{}\"/\\+=~^@-_"
#: Words of letters that are encoded in one go.
JOINED = 512
#: Stands before a text, so that its first piece is told from those after a blank.
FIRST = "\x1f"
#: Blanks and line feeds, with what follows; for texts that have several in a row.
RUNS = re.compile(r"[ \n]+[^ \n]*|[^ \n]+")


class PieceEncoder:
    """Ids of texts, the same as encoding each whole, with every distinct piece encoded once.

    Blank and line feed always end what comes before them: a word vocabulary drops
    white space, a byte vocabulary starts a new unit at the first blank after a
    non-blank. Of a new piece, letters and the marks after them are looked up
    apart, and new words of letters are encoded many at a time: each is one unit
    of the vocabulary's splitting, so its ids are those of one unit of the joined
    text. Pieces of other shapes are encoded each by itself.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # a special token's string in a text is ordinary text
        # Without a normalizer white space counts, and a piece carries the blanks before it.
        self.blanks_count = self.tokenizer.normalizer is None
        # Where case does not count, texts are folded first: in Latin-1 letter by letter, as the vocabulary's own normalizer does.
        self.folds = "Lowercase" in repr(self.tokenizer.normalizer)
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _pieces(self, text: str) -> list[str]:
        """What blanks part. In a byte vocabulary a piece stands for itself after a blank.

        Those after a line feed begin with it, and the first of a text begins with ``FIRST``,
        as does a piece with several blanks before it.
        """
        if not self.blanks_count:
            return (text.lower() if self.folds and _latin(text) else text).replace("\n", " ").split(" ")
        if FIRST in text or any(x in text for x in ("  ", "\n\n", " \n", "\n ")):
            return [FIRST + x for x in RUNS.findall(text)]
        return (FIRST + text).replace("\n", " \n").split(" ")

    def _text(self, piece: str) -> str:
        """The characters that a piece stands for."""
        if not self.blanks_count or piece[:1] == "\n":
            return piece
        return piece[1:] if piece[:1] == FIRST else " " + piece

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """32-bit id arrays of the texts."""
        out = []
        for at in range(0, len(texts), 64):
            split = [self._pieces(t) for t in texts[at : at + 64]]
            if len(self.known) > CACHED_PIECES:
                self.known, self.old = {}, self.known
            fresh = set().union(*split).difference(self.known)
            seen = {p: self.old[p] for p in fresh if p in self.old}
            self.known.update(seen)
            self._learn(fresh.difference(seen))
            find = self.known.__getitem__
            out += [np.frombuffer(b"".join(map(find, pieces)), np.uint32) for pieces in split]
        return out

    def _learn(self, fresh: set[str]) -> None:
        known = self.known
        composed = {p: parts for p in fresh if len(parts := self._parts(p)) > 1}
        fresh = fresh.difference(composed).union(x for parts in composed.values() for x in parts if x not in known)
        words = [p for p in fresh if p.isalpha()]
        # Words without a blank before them, as after a line feed: between line feeds, every second unit is a word.
        bare = [p for p in fresh if self.blanks_count and p[:1] == FIRST and p[1:].isalpha()]
        others = fresh.difference(words, bare)
        groups = [w[i : i + JOINED] for w in (words, bare) for i in range(0, len(w), JOINED)]
        lead = " " if self.blanks_count else ""
        texts = [lead + " ".join(g) if g[0][:1] != FIRST else "".join(g).replace(FIRST, "\n") for g in groups]
        for group, got in zip(groups, self.tokenizer.encode_batch(texts, add_special_tokens=False)):
            step = 2 if group[0][:1] == FIRST else 1
            unit, ids = np.array(got.word_ids), np.array(got.ids, np.uint32)
            bounds = [0, *(np.flatnonzero(unit[1:] != unit[:-1]) + 1).tolist(), len(ids)]
            if len(bounds) - 1 != step * len(group):
                others.update(group)  # some word is not one unit after all
                continue
            for word, a, b in zip(group, bounds[step - 1 :: step], bounds[step::step]):
                known[word] = ids[a:b].tobytes()
        single = list(others)
        for i in range(0, len(single), 4096):
            some = single[i : i + 4096]
            for piece, got in zip(some, self.tokenizer.encode_batch_fast([self._text(p) for p in some], add_special_tokens=False)):
                known[piece] = np.array(got.ids, np.uint32).tobytes()
        for piece, parts in composed.items():
            known[piece] = b"".join(known[x] for x in parts)

    def _parts(self, piece: str) -> list[str]:
        """A piece as a line feed, letters and closing marks, each a piece, where it has that shape; else whole."""
        letters = piece.rstrip(MARKS)
        marks = piece[len(letters) :]
        lead = []
        bare = FIRST if self.blanks_count else ""  # parts inside a piece have no blank before them
        if letters[:1] == "\n" and self.blanks_count:
            lead, letters = ["\n"], letters[1:]
        # One letter may become a letter and a mark in lower case, and the mark would join the marks after it.
        if not letters.lower().isalpha() or not (marks or lead):
            return [piece]
        return [*lead, (bare if lead else "") + letters, *([bare + marks] if marks else [])]


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


@lru_cache(maxsize=4)
def encoder(path: str) -> PieceEncoder:
    """One encoder per file and Python worker."""
    return PieceEncoder(path)


def slices(batch, size: int = 64):
    """Rows of an Arrow batch in small runs, so that few encoded texts are held at a time."""
    for i in range(0, batch.num_rows, size):
        yield batch.slice(i, size)
