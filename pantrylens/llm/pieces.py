"""Piece vocabularies of public tokenizers, and the chunks that no piece reaches across."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

MARK = "▁"
CHUNK = re.compile(f" *[^ ]+| +")


@dataclass
class Vocabulary:
    pieces: list[str]
    scores: list[float]
    normal: list[bool]  # False for control, unknown and byte pieces
    byte_ids: list[int]  # of the bytes 0 to 255

    @property
    def chunked(self) -> bool:
        """Whether the space mark occurs only at the start of pieces, so that words are independent."""
        return not any(MARK in p.lstrip(MARK) for p, ok in zip(self.pieces, self.normal) if ok)


_loaded: dict[str, Vocabulary] = {}


def load(path: str) -> Vocabulary:
    if path not in _loaded:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = len(model)
        byte_ids = [i for i in range(n) if model.is_byte(i)]
        _loaded[path] = Vocabulary(
            [model.id_to_piece(i) for i in range(n)],
            [model.get_score(i) for i in range(n)],
            [not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) for i in range(n)],
            byte_ids,
        )
    return _loaded[path]


def zipf_scores(vocabulary: Vocabulary) -> list[float]:
    """Scores as natural logarithms of frequencies.

    A merge vocabulary holds ranks (0, -1, -2 ...) in place of log-probabilities; rank r then counts
    as 1 / (r + 1). Pieces outside the ranks (runs of spaces) take the last rank.
    """
    normal = [s for s, ok in zip(vocabulary.scores, vocabulary.normal) if ok and s > -1e8]
    if not normal or any(s != int(s) for s in normal) or max(normal) > 0:
        return list(vocabulary.scores)
    least = min(normal)
    return [-math.log1p(-max(s, least)) if ok else -math.log1p(-least) for s, ok in zip(vocabulary.scores, vocabulary.normal)]
