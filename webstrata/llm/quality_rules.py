"""Quality rules: word and line counts, and the fertility of a public tokeniser with rejection bands per script.

Well-formed prose of a script costs a public vocabulary a steady number of
tokens; symbol noise, shouting and repetition move characters per token, the
share of byte-fallback tokens or the entropy of the tokens out of the band.
One pass over the texts, no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webstrata.llm.common import hashes_of, shingle_hashes, steps, words_of
from webstrata.llm.pieces import piece_ids

SYMBOLS = b"#*$%&|<>"
LETTERS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BLANK = b" \t\n\x0b\x0c\r"
#: Prose of alphabets spreads its tokens over the vocabulary at least as evenly as a draw from so many pieces, roughly.
SPREAD = 150
MIN_WORDS, WINDOW, MAX_REPEAT_PERCENT = 10, 5, 20


@dataclass(frozen=True)
class Band:
    """A text inside all limits is kept."""

    min_chars_per_token: float
    max_chars_per_token: float
    max_fallback: float
    min_entropy: float


#: Bands by script. Space-separated alphabets cost a byte-pair vocabulary 1.3 to 8 characters a token; scripts it hardly
#: knows fall back to bytes, up to three or four a character, whose even spread says less.
BANDS: Mapping[str, Band] = {
    "latin": Band(1.3, 8.0, 0.10, 0.875),
    "cyrillic": Band(1.2, 8.0, 0.15, 0.8),
    "greek": Band(0.8, 8.0, 0.30, 0.6),
    "han": Band(0.25, 4.0, 0.95, 0.6),
    "other": Band(0.2, 8.0, 1.0, 0.5),
}
#: Which script a letter is of, by ranges of code points.
SCRIPTS = (("latin", "A-Za-zªºÀ-ɏḀ-ỿ"), ("cyrillic", "Ѐ-ԯ"), ("greek", "Ͱ-Ͽἀ-῿"), ("han", "぀-ヿ㐀-鿿가-힯"))
_SCRIPT_RES = [(name, re.compile(f"[{chars}]")) for name, chars in SCRIPTS]
_OTHER = re.compile(f"[^\\W\\d_{''.join(c for _, c in SCRIPTS)}]")


def script_of(text: str, raw: bytes) -> str:
    """The script of most letters; ties go to the one first listed; without letters latin."""
    if 2 * (len(raw) - len(raw.translate(None, LETTERS))) >= len(text):  # at least half of all characters are its
        return "latin"
    n = {name: len(found.findall(text)) for name, found in _SCRIPT_RES}
    n["other"] = len(_OTHER.findall(text))
    return max(n, key=n.get)


def repeated_words(shingles: np.ndarray, window: int) -> int:
    """How many words lie in a window whose hash occurs twice or more."""
    if len(shingles) < 2:
        return 0
    _, inverse, n = np.unique(shingles, return_inverse=True, return_counts=True)
    if len(n) == len(shingles):
        return 0
    again = n[inverse] > 1
    cover = np.zeros(len(shingles) + window, np.int64)
    cover[:-window] += again
    cover[window:] -= again
    return int((np.cumsum(cover) > 0).sum())


def duplicate_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip(BLANK)]
    return len(lines) - len(set(lines))


def relative_entropy(ids: np.ndarray) -> float:
    """Entropy of the tokens over that of an even draw from a text of that length; 1 for fewer than 2 tokens.

    n tokens can't hold more than log2(n) bits each, so the measure is log2(n * SPREAD / (n + SPREAD)).
    """
    n = len(ids)
    if n < 2:
        return 1.0
    p = np.unique(ids, return_counts=True)[1] / n
    return float(-(p * np.log2(p)).sum() / np.log2(n * SPREAD / (n + SPREAD)))


def in_band(chars_per_token: float, fallback: float, entropy: float, band: Band) -> bool:
    return band.min_chars_per_token <= chars_per_token <= band.max_chars_per_token and fallback <= band.max_fallback and entropy >= band.min_entropy


OWN = T.StructType(
    [T.StructField(c, T.LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType()), T.StructField("script", T.StringType()), T.StructField("n_tokens", T.LongType())]
    + [T.StructField(c, T.DoubleType()) for c in ("chars_per_token", "fallback_share", "token_entropy")]
)


def _judge(path: str, bands: Mapping[str, Band], out: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = piece_ids(path)
        for batch in steps(batches):
            texts = batch.column("text")
            starts, codes, words = words_of(texts)
            n_words = np.diff(starts)
            chars = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)[codes] if len(words) else np.zeros(0, np.int64)
            word_chars = np.diff(np.concatenate([[0], np.cumsum(chars)])[starts])
            hashes = hashes_of(words)[codes] if len(words) else np.zeros(0, np.uint64)
            windows, begins = shingle_hashes(starts, hashes, WINDOW)
            ids, firsts = tokenizer.of(texts)
            fallback = tokenizer.is_byte[ids] & ~tokenizer.blank_bytes[ids]
            rows = []
            for i, raw in enumerate(texts.cast(pa.binary()).to_pylist()):
                raw = raw or b""
                text = raw.decode("utf-8", "replace")
                n, own = int(n_words[i]), ids[firsts[i] : firsts[i + 1]]
                repeat = repeated_words(windows[begins[i] : begins[i + 1]], WINDOW) if n > WINDOW else 0
                failed = n < MIN_WORDS or 100 * repeat > MAX_REPEAT_PERCENT * n
                share = float(fallback[firsts[i] : firsts[i + 1]].mean()) if len(own) else 0.0
                cpt = len(text) / len(own) if len(own) else 0.0
                entropy = relative_entropy(own)
                script = script_of(text, raw)
                kept = not failed and in_band(cpt, share, entropy, bands.get(script, bands["other"]))
                rows.append((n, int(word_chars[i]), len(raw) - len(raw.translate(None, SYMBOLS)), duplicate_lines(raw), repeat, failed, kept, script, len(own), cpt, share, entropy))
            columns = dict(zip(OWN.names, zip(*rows)))
            yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else batch.column(f.name) for f in out], schema=out)

    return run


def quality_rules(docs: DataFrame, tokenizer: str, *, bands: Mapping[str, Band] = BANDS, carry: Sequence[str] = ()) -> DataFrame:
    """Judges every text: counts, tokeniser fertility, base_failed and kept.

    Takes `doc_id` and `text`; other columns are ignored, but those in `carry` come along ("text" may be one).
    `tokenizer` is the path of a sentencepiece model with byte fallback.
    Defined for odd inputs: a null or empty text has no words and fails the base rule. Repeated rows are judged
    one by one; doc_id may be null. An empty table gives an empty one.
    """
    if clash := set(OWN.names) & set(carry):
        raise ValueError(f"carried columns with the operator's own names: {sorted(clash)}")
    from pyspark.sql.pandas.types import to_arrow_schema

    docs = docs.select("doc_id", *(c for c in carry if c != "text"), F.col("text").cast("string").alias("text"))
    out = T.StructType([*(f for f in docs.schema.fields if f.name != "text" or "text" in carry), *OWN.fields])
    return docs.mapInArrow(_judge(tokenizer, bands, to_arrow_schema(out)), out)
