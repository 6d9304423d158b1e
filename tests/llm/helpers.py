"""Rows that every operator has to take: nulls, empty and long texts, ties, repeated rows, clashing columns."""

SCHEMA = "doc_id long, text string, digest string, size string, bucket string, kept string, spans string, n_words string, score string, ids string, root string"


def odd(rows):
    return [(i, t, *"abcdefghi") for i, t in rows]


LONG = "word " * 30_000
