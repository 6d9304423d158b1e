"""SentencePiece vocabularies: segments between which no piece crosses, and their ids remembered by workers."""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from webstrata.llm.memo import Memo

SPACE = "▁"
#: A run of spaces belongs to the text after it: no piece of the vocabularies in use has a space after another character (checked on loading).
SEGMENT = re.compile(f"{SPACE}+[^{SPACE}]*")


class PieceIds:
    """Ids of whole texts through the sentencepiece library, segment by segment."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError("a piece of this vocabulary crosses a space")
        self.is_byte = np.array([self.model.is_byte(i) for i in range(len(pieces))])
        self.blank_bytes = np.array([self.is_byte[i] and p in ("<0x09>", "<0x0A>", "<0x0B>", "<0x0C>", "<0x0D>") for i, p in enumerate(pieces)])
        self.space_id = self.model.piece_to_id(SPACE)
        self.memo = Memo(self.encoded)

    def encoded(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each segment has, and all in a row; a segment is a text's part without its first space."""
        ids = [own if s else [self.space_id] for s, own in zip(segments, self.model.encode(segments, num_threads=1))]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        return sizes, np.fromiter(chain.from_iterable(ids), np.int32, int(sizes.sum()))

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and where each text's start."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        parts = pc.split_pattern(pc.replace_substring(texts, SPACE, " "), " ")
        starts = parts.offsets.to_numpy()
        flat = parts.values.slice(starts[0], starts[-1] - starts[0])
        starts = (starts - starts[0]).astype(np.int64)
        hollow = pc.equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
        if hollow.any():  # runs of spaces, spaces at an end, empty texts: few texts, so written out
            segments: list[str] = []
            starts = np.zeros(len(texts) + 1, np.int64)
            for i, text in enumerate(texts.to_pylist()):
                if text:
                    segments += [s[1:].replace(SPACE, " ") for s in SEGMENT.findall(SPACE + text.replace(" ", SPACE))]
                starts[i + 1] = len(segments)
            flat = pa.array(segments, pa.large_string())
        return self.memo.of(flat, starts)


@lru_cache(maxsize=4)
def piece_ids(path: str) -> PieceIds:
    return PieceIds(path)
