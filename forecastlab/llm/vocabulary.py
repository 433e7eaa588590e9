"""Piece tables read from a public SentencePiece model file; nothing is trained here."""

from __future__ import annotations

import math
from functools import lru_cache

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
UNKNOWN_SCORE = -40.0


@lru_cache(maxsize=4)
def load_pieces(path: str = MODEL_PATH) -> tuple[tuple[str, ...], int]:
    """Every piece in id order and the id of byte 0, read on the driver; the list's length is the vocabulary size.

    Control, unknown and unused pieces come as empty texts.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    first_byte = next((i for i in range(n) if model.is_byte(i)), -1)
    special = lambda i: model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)
    return tuple("" if special(i) else model.id_to_piece(i) for i in range(n)), first_byte


def piece_scores(pieces: tuple[str, ...]) -> dict[str, tuple[float, int]]:
    """Unigram log probability and id of every piece: Zipf's law over the order of the vocabulary file."""
    named = [(p, i) for i, p in enumerate(pieces) if p]
    norm = math.log(sum(1 / (r + 2.7) for r in range(len(named))) or 1)
    return {p: (-math.log(r + 2.7) - norm, i) for r, (p, i) in enumerate(named)}
