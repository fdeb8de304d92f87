"""The vocabulary of a SentencePiece file, as its library gives it, and the normal form of texts under it."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import sentencepiece

SPACE = "▁"


@dataclass
class Pieces:
    """Ordinary pieces by name, byte pieces by value, and whether unknown characters fall back to bytes."""

    scores: dict[str, float]
    ids: dict[str, int]
    byte_ids: list[int] | None
    unknown: int
    names: list[str | bytes]

    @property
    def least(self) -> float:
        return min(self.scores.values(), default=0.0)


@lru_cache(maxsize=2)
def load(path: str) -> Pieces:
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    scores, ids, bytes_, names = {}, {}, {}, []
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        if sp.is_byte(i):
            bytes_[int(piece[3:5], 16)] = i
            names.append(bytes([int(piece[3:5], 16)]))
        elif sp.is_unknown(i) or sp.is_control(i) or sp.is_unused(i):
            names.append(b"" if sp.is_control(i) else " ⁇ ")
        else:
            scores[piece], ids[piece] = sp.get_score(i), i
            names.append(piece)
    if any(SPACE in p.lstrip(SPACE) for p in scores):
        raise ValueError("pieces span words: texts can't be cut at spaces")
    if len(bytes_) == 256:
        _refuse_other_forms(sp, names)
    return Pieces(scores, ids, [bytes_[b] for b in range(256)] if len(bytes_) == 256 else None, sp.unk_id(), names)


#: Texts whose pieces tell how a model normalises: white space at both ends and inside, compatibility forms, case, controls.
PROBES = (" a  b ", "a", "ﬁ①Ⅷ é e\u0301", "A b\tc\n", "\u3000x\u200b")


def _refuse_other_forms(sp: sentencepiece.SentencePieceProcessor, names: list[str | bytes]) -> None:
    """An error for a model that changes texts, or puts no space before them: it would give other ids than are made here."""
    for probe in PROBES:
        said = b"".join(n.encode() if isinstance(n, str) else n for n in (names[i] for i in sp.encode(probe)))
        if said != (SPACE + probe.replace(" ", SPACE)).encode():
            raise ValueError("the model normalises texts; only models that keep them, with a space before each, are read")


def words(text: str | None) -> list[str]:
    """The text's words as pieces spell them, each less the space mark that starts it.

    A space is put before the text, and U+2581 counts as a space; a word takes the spaces before it, and a run of spaces at the
    end is a word too. No piece spans two words, so each can be encoded alone. Null and empty texts have none.
    """
    if not text:
        return []
    found = text.replace(SPACE, " ").split(" ")
    if "" not in found:
        return found
    out, spaces = [], 0
    for w in found:
        if w:
            out.append(SPACE * spaces + w)
            spaces = 0
        else:
            spaces += 1
    if spaces:
        out.append(SPACE * (spaces - 1))
    return out
