"""SentencePiece encoding and decoding: streaming Viterbi over a lattice of pieces, for byte-pair models with byte fallback.

The models at hand rank merges, so a path through the lattice survives not by a
sum but by its joints: two pieces may follow each other only if merging the
characters of both ends in just these two. Then exactly one path survives at
each position, and it is the model's own encoding of the text so far. A text is
one stream. The encoder keeps the backpointers of a window; a boundary is alive
if what follows it may still become a piece, and once the paths of all living
boundaries run through one, the ids before it are final and leave. The window's
width depends on the longest piece, not the text.

What is left after a commit, the window and the piece before it, is a state. A
worker remembers where a state goes with the next few characters and which ids
that commits, so a stream mostly walks an automaton that the lattice has built.
"""

from __future__ import annotations

import gc
import hashlib
import re
import sys
import zlib
from array import array
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webstrata.llm.common import steps
from webstrata.llm.pieces import SPACE

#: Most characters that the encoder takes at once; longer feeds aren't remembered. Steps and joints that a worker remembers.
FEED, STEPS, JOINTS = 64, 1_000_000, 1_000_000
#: Feeds end after a space or a line break, where paths tend to converge; CUT is written there while a text is cut.
FEEDS, CUT = re.compile(f"[^{SPACE}\n]*[{SPACE}\n]|[^{SPACE}\n]+"), "\x01"


class Vocabulary:
    """Pieces, their ranks and the ids of bytes, of a sentencepiece model file."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces: dict[str, int] = {}
        self.ranks: dict[str, float] = {}
        self.raw: list[bytes] = []
        self.byte_ids = [0] * 256
        for i in range(model.get_piece_size()):
            text = model.id_to_piece(i)
            if model.is_byte(i):
                self.raw.append(bytes([int(text[3:5], 16)]))
                self.byte_ids[int(text[3:5], 16)] = i
            elif model.is_control(i) or model.is_unknown(i):
                self.raw.append(b"")
            else:
                self.raw.append(text.replace(SPACE, " ").encode())
                self.pieces[text], self.ranks[text] = i, model.get_score(i)
        self.longest = max(map(len, self.pieces))
        self.prefixes = {p[:n] for p in self.pieces for n in range(1, len(p))}
        self.inner = {c for p in self.pieces for c in p[1:]}
        if any(SPACE in p.lstrip(SPACE) for p in self.pieces):
            raise ValueError("a piece of this vocabulary crosses a space")
        self.joints: dict[tuple[str, str], bool] = {}
        # pieces that merging their own characters ends in; no other can stand in a path
        self.whole = {p for p in self.pieces if len(p) > 1 and self.merged(p) == [p]}
        # where a piece could start: by its last two characters, the lengths of pieces that end so, longest first
        self.lengths: dict[str, list[int]] = {}
        for end, n in sorted({(p[-2:], len(p)) for p in self.whole}, reverse=True):
            self.lengths.setdefault(end, []).append(n)

    def merged(self, text: str) -> list[str]:
        """The text's pieces by definition: the best-ranked neighbours merge, the leftmost of equals first, until none can."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = self.ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank > best):
                    best, at = rank, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def joint(self, left: str, right: str) -> bool:
        """Whether these two pieces may follow each other."""
        key = (left, right)
        ok = self.joints.get(key)
        if ok is None:
            if len(self.joints) >= JOINTS:
                self.joints.clear()
            ok = self.joints[key] = self.merged(left + right) == [left, right]
        return ok

    def ids_of(self, piece: str) -> list[int]:
        i = self.pieces.get(piece)
        return [self.byte_ids[b] for b in piece.encode("utf-8", "surrogatepass")] if i is None else [i]


class State:
    """What a stream has left: the window since the last commit, and the piece before it if that still matters; where feeds have led from here."""

    __slots__ = ("before", "text", "last", "steps", "older")

    def __init__(self, before: str | None, text: str, last: list[str | None]):
        self.before, self.text, self.last, self.steps, self.older = before, text, last, {}, {}


class Encoder:
    """Encodes one stream of text, of which spaces are already written as in pieces."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.text = ""  # the window
        self.last: list[str | None] = [None]  # the surviving path's last piece, at each boundary of the window
        self.before: str | None = None  # the last piece that has left, if a coming piece might merge with it
        self.commits = 0

    def feed(self, text: str) -> list[int]:
        """Takes more text; gives the ids that became final."""
        out = []
        for s in range(0, len(text), FEED):
            self._extend(text[s : s + FEED])
            out += self._commit()
        return out

    def _extend(self, more: str) -> None:
        """For each new boundary, the one piece that may end there."""
        v, text, last = self.v, self.text + more, self.last
        pieces, lengths, joints, whole, before, none = v.pieces, v.lengths, v.joints, v.whole, self.before, ()
        first = before is None
        for end in range(len(self.text) + 1, len(text) + 1):
            found = None
            for n in lengths.get(text[end - 2 : end], none) if end > 1 else none:
                start = end - n
                if start > 0:
                    left = last[start]
                    if left is None:
                        continue
                    piece = text[start:end]
                    if piece in whole and (joints.get((left, piece)) or v.joint(left, piece)):
                        found = piece
                        break
                elif not start:
                    piece = text[:end]
                    if piece in whole and (first or v.joint(before, piece)):
                        found = piece
                        break
            else:
                # the character itself; one that is no piece stands for its bytes, and nothing merges with it
                c = text[end - 1]
                left = last[end - 1] if end > 1 else before
                if left is None and end == 1 and before is None or left is not None and (c not in pieces or v.joint(left, c)):
                    found = c
            last.append(found)
        self.text = text

    def _commit(self) -> list[int]:
        """Ids before the last boundary that all living paths share; a path lives if what follows its end may become a piece."""
        text, last, n, prefixes, inner = self.text, self.last, len(self.text), self.v.prefixes, self.v.inner
        alive = []
        for e in range(n - 1, max(0, n - self.v.longest + 1) - 1, -1):
            if (last[e] is not None or not e) and text[e:] in prefixes:
                alive.append(e)
            if text[e] not in inner:
                break
        shared, e = {n}, n  # boundaries of the path that ends here
        while e > 0:
            e -= len(last[e])
            shared.add(e)
        at = n
        for e in alive:
            while e not in shared:
                e -= len(last[e])
            at = min(at, e)
        self.commits += at > 0
        return self._leave(at) if at else []

    def _leave(self, at: int) -> list[int]:
        last, known, pieces, e = self.last, self.v.pieces, [], at
        while e > 0:
            pieces.append(last[e])
            e -= len(last[e])
        self.text, self.last = self.text[at:], [None, *last[at + 1 :]]
        # nothing merges across a space, nor with a character that is no piece
        self.before = pieces[0] if pieces[0] in known and not self.text.startswith(SPACE) else None
        out = []
        for p in reversed(pieces):
            i = known.get(p)
            if i is None:
                out += self.v.ids_of(p)
            else:
                out.append(i)
        return out

    def finish(self) -> list[int]:
        """The rest of the ids."""
        return self._leave(len(self.text)) if self.text else []


def packed(ids: list[int]) -> bytes:
    own = array("i", ids)
    if sys.byteorder == "big":
        own.byteswap()
    return own.tobytes()


class Codec:
    """Encodes and decodes whole texts. States and their steps are remembered; past STEPS steps those go that weren't taken since the last time."""

    def __init__(self, path: str):
        self.v = Vocabulary(path)
        self.raw = np.array(self.v.raw, dtype=object)
        self.commits = 0
        self.forget()

    def forget(self) -> None:
        self.states: dict[tuple[str | None, str], State] = {}
        self.remembered = 0
        self.start = self.state(None, "", [None])

    def state(self, before: str | None, text: str, last: list[str | None]) -> State:
        found = self.states.get((before, text))
        if found is None:
            found = self.states[before, text] = State(before, text, last)
        return found

    def step(self, state: State, feed: str) -> tuple[bytes, State]:
        """The ids that a feed commits, and the state it leads to."""
        encoder = Encoder(self.v)
        encoder.before, encoder.text, encoder.last = state.before, state.text, list(state.last)
        ids = packed(encoder.feed(feed))
        self.commits += encoder.commits
        if len(feed) > FEED or len(encoder.text) > FEED:
            return ids, State(encoder.before, encoder.text, encoder.last)
        found = ids, self.state(encoder.before, encoder.text, encoder.last)
        self.remember(state, feed, found)
        return found

    def remember(self, state: State, feed: str, found: tuple[bytes, State]) -> None:
        state.steps[feed] = found
        self.remembered += 1
        if self.remembered > STEPS:
            self.remembered = 0
            for s in self.states.values():
                s.older, s.steps = s.steps, {}
            # states that neither generation has a step from or leads to are few: one for each piece before a cut
            if len(self.states) > STEPS:
                self.states = {(state.before, state.text): state, (None, ""): self.start}

    def learn(self, state: State, feeds: Iterable[str]) -> None:
        """Steps of many feeds from one state. In order, each takes over the lattice of what it shares with the one before."""
        encoder, base, text, last = Encoder(self.v), len(state.text), "", list(state.last)
        for feed in sorted(f for f in feeds if len(f) <= FEED and f not in state.steps and f not in state.older):
            same = 0
            for a, b in zip(text, feed):
                if a != b:
                    break
                same += 1
            encoder.before, encoder.text, encoder.last = state.before, state.text + feed[:same], last[: base + same + 1]
            encoder._extend(feed[same:])
            text, last = feed, encoder.last
            ids = packed(encoder._commit())
            self.remember(state, feed, (ids, self.state(encoder.before, encoder.text, encoder.last)))
        self.commits += encoder.commits

    def rest(self, state: State) -> bytes:
        encoder = Encoder(self.v)
        encoder.before, encoder.text, encoder.last = state.before, state.text, list(state.last)
        return packed(encoder.finish())

    def feeds(self, text: str) -> list[str]:
        if not text:
            return []
        text = SPACE + text.replace(" ", SPACE)
        return FEEDS.findall(text) if CUT in text else text.replace(SPACE, SPACE + CUT).replace("\n", "\n" + CUT).split(CUT)

    def stream(self, feeds: list[str]) -> bytes:
        """The ids of a text's feeds, as little-endian 32-bit numbers."""
        out, state = [], self.start
        for feed in feeds:
            found = state.steps.get(feed)
            if found is None:
                found = state.older.get(feed)
                if found is None:
                    found = self.step(state, feed)
                else:
                    self.remember(state, feed, found)
            ids, state = found
            out.append(ids)
        out.append(self.rest(state))
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """A whole text's ids."""
        return self.stream(self.feeds(text))

    def encode_all(self, texts: Sequence[str]) -> Iterator[bytes]:
        """Each text's ids; most feeds follow a space, so those that are new there are learned together."""
        gc.freeze()  # what is remembered holds no cycles; the collector needn't walk it again and again
        fed = [self.feeds(t) for t in texts]
        self.learn(self.state(None, SPACE, [None, SPACE]), set(chain.from_iterable(fed)))
        return map(self.stream, fed)

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of ids, as UTF-8; the space that encoding put in front goes."""
        raw = b"".join(self.raw[ids].tolist())
        return raw[1:] if raw.startswith(b" ") else raw


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    return Codec(path)


def _encode(path: str, with_ids: bool, out: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in steps(batches):
            rows = []
            raws = [raw or b"" for raw in batch.column("text").cast(pa.binary()).to_pylist()]
            for raw, ids in zip(raws, own.encode_all([raw.decode("utf-8", "replace") for raw in raws])):
                piece = np.frombuffer(ids, "<i4")
                back = own.decode(piece)
                rows.append((len(piece), zlib.crc32(ids), hashlib.sha256(back).hexdigest(), back == raw, piece if with_ids else None))
            columns = dict(zip(out.names[1:], zip(*rows)))
            yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else batch.column(f.name) for f in out], schema=out)

    return run


def encode_pieces(docs: DataFrame, model: str, *, with_ids: bool = False) -> DataFrame:
    """Encodes every whole text into a sentencepiece model's ids, and decodes them again.

    Takes `doc_id` and `text`, ignores other columns; `model` is the path of a byte-pair model with byte fallback.
    Returns doc_id, n_ids, ids_crc32 (little-endian signed 32-bit ids), decoded_sha256, same (whether decoding gives the
    text back) and with_ids the ids. Defined for odd inputs: a null or empty text has no ids; the sign U+2581 is a space to such
    models, so a text with it decodes with spaces (same is false); repeated rows are encoded one by one; doc_id may
    be null. An empty table gives an empty one.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    own = [("n_ids", T.LongType()), ("ids_crc32", T.LongType()), ("decoded_sha256", T.StringType()), ("same", T.BooleanType())] + [("ids", T.ArrayType(T.IntegerType()))] * with_ids
    out = T.StructType([docs.schema["doc_id"], *(T.StructField(c, t) for c, t in own)])
    return docs.mapInArrow(_encode(model, with_ids, to_arrow_schema(out)), out)


def decode_pieces(encoded: DataFrame, model: str) -> DataFrame:
    """(doc_id, text) of rows with doc_id and ids; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for batch in batches:
            texts = [own.decode(np.array(x or [], np.int32)).decode("utf-8", "replace") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    rows = encoded.select("doc_id", "ids")
    return rows.mapInArrow(run, T.StructType([rows.schema["doc_id"], T.StructField("text", T.StringType())]))
