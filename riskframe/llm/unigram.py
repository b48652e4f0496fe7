"""Unigram vocabulary and segmentation shared by the codec and the counter.

The vocabulary is the pieces of a SentencePiece model file; a unigram log score
follows from a piece's rank by Zipf's rule, ``-round(16 ln(rank + 2)) / 16``.
Scores are multiples of 1/16, so sums are exact, ties are real ties, and the
best path of a text is the best paths of its segments put together.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

#: Fixed values of the file format: the whitespace marker and the extra cost of
#: an unknown character below the lowest score.
MARK = "▁"
UNKNOWN_COST = 10.0


@dataclass
class Unigram:
    pieces: list[str]                 # by id
    score: dict[str, float]           # of normal pieces
    ids: dict[str, int]
    byte_id: list[int]                # by byte
    unknown: float = 0.0
    pairs: set[str] = field(default_factory=set)
    segment: re.Pattern | None = None

    def __post_init__(self):
        self.unknown = min(self.score.values()) - UNKNOWN_COST
        multi = [p for p in self.score if len(p) > 1]
        if any(MARK in p.lstrip(MARK) for p in multi):
            raise ValueError("a piece holds the whitespace marker after another character")
        inner = {c for p in multi for c in p} - {MARK}
        # adjacent characters inside some piece; other neighbours never join
        self.pairs = {p[i:i + 2] for p in multi for i in range(len(p) - 1)}
        chars = "".join(map(re.escape, sorted(inner)))
        some = f"[{chars}]" if chars else "(?!)"
        self.segment = re.compile(f"{MARK}+{some}*|{some}+|.", re.DOTALL)

    def segments(self, text: str | None) -> list[str]:
        """Cut a text so that no piece crosses a cut.

        Spaces become markers and one leads the text, as the identity normaliser
        with a dummy prefix does; an empty text has no segment.
        """
        if not text:
            return []
        return self.segment.findall(MARK + text.replace(" ", MARK))

    def split(self, segment: str) -> list[str]:
        """Cut a segment further wherever two neighbours occur in no piece."""
        pairs, out, last = self.pairs, [], 0
        for i in range(1, len(segment)):
            if segment[i - 1:i + 1] not in pairs:
                out.append(segment[last:i])
                last = i
        out.append(segment[last:])
        return out


def zipf_score(rank: float, size: int) -> float:
    return -round(16 * math.log(min(rank, size) + 2)) / 16


def load_unigram(path: str) -> Unigram:
    """Vocabulary of a SentencePiece file: normal pieces scored by rank; control,
    unknown and byte pieces never match text."""
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    pieces = [sp.id_to_piece(i) for i in range(n)]
    normal = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    return Unigram(pieces, {pieces[i]: zipf_score(-sp.get_score(i), n) for i in normal}, {pieces[i]: i for i in normal},
                   [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
