import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from webstrata.llm.merges import Merges
from webstrata.llm.packing import first_fit_decreasing, pack, sequences

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, length string, ids string"


def texts():
    rng = random.Random(3)
    own = [None, "", " \n\t ", "it's l'été 12½ ÉCOLE", "<|endoftext|> a<|startoftext|>b", "ǅ Σς İstanbul é  x\x85y\x1cz", "word " * 5000, "zz" * 3000]
    return own + ["".join(rng.choice("abcABC'st rem\n01²½éßÿ!?中́") for _ in range(rng.randint(0, 300))) for _ in range(60)]


def test_merges_equal_the_library():
    tokenizer = Tokenizer.from_file(PATH)
    merges = Merges(tokenizer)
    assert merges.known
    words = sorted({w for t in texts() if t for w in t.split(" ")})
    sizes, ids = merges.encode(words)
    ends = np.cumsum(sizes)
    assert [ids[b - n : b].tolist() for b, n in zip(ends, sizes)] == merges.library(words)


def test_pieces_cover_every_id_once_and_sequences_are_gapless(spark):
    rows = [(i, t, "x", "y") for i, t in enumerate(texts())] + [(3, "it's l'été 12½ ÉCOLE", "x", "y"), (None, "no id", "x", "y")]
    got = pack(spark.createDataFrame(rows, SCHEMA), PATH, group_docs=20, with_ids=True).collect()
    tokenizer = Tokenizer.from_file(PATH)
    want = sorted(str((i, tokenizer.encode(t or "", add_special_tokens=False).ids + [1])) for i, t, *_ in rows)
    by_doc, by_sequence = {}, {}
    for r in got:
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    found = []
    for doc, pieces in by_doc.items():
        if doc == 3:  # repeated rows
            found += [str((doc, list(p.ids))) for p in pieces]
            continue
        pieces.sort(key=lambda p: p.start)
        assert [p.start for p in pieces] == [0, *np.cumsum([p.length for p in pieces])[:-1]]
        assert sum(p.length for p in pieces) == pieces[0].doc_tokens
        found.append(str((doc, [x for p in pieces for x in p.ids])))
    assert sorted(found) == want
    for pieces in by_sequence.values():
        pieces.sort(key=lambda p: p.offset)
        assert [p.offset for p in pieces] == [0, *np.cumsum([p.length for p in pieces])[:-1]]
        assert sum(p.length for p in pieces) <= 2048


def test_first_fit_decreasing_against_plain_search():
    rng = random.Random(5)
    for n in (0, 1, 7, 300):
        sizes = [rng.randint(1, 100) for _ in range(n)]
        bins, offsets = first_fit_decreasing(sizes, 100)
        room, plain = [], {}
        for i in sorted(range(n), key=lambda i: -sizes[i]):
            b = next((k for k, r in enumerate(room) if r >= sizes[i]), len(room))
            if b == len(room):
                room.append(100)
            plain[i] = (b, 100 - room[b])
            room[b] -= sizes[i]
        assert [(int(a), int(b)) for a, b in zip(bins, offsets)] == [plain[i] for i in range(n)]


def test_sequences_hold_the_pieces_and_empty_tables_work(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "d e")], "doc_id long, text string")
    one = sequences(pack(docs, PATH, with_ids=True)).collect()
    assert len(one) == 1 and sorted(one[0].doc_ids) == [1, 2] and len(one[0].ids) == 7
    assert pack(docs.limit(0), PATH).count() == 0


def test_large_ids_stay_beside_a_null(spark):
    rows = [(2**60 + 1, "a"), (2**60 + 2, "b"), (None, "c")]
    got = pack(spark.createDataFrame(rows, "doc_id long, text string"), PATH).collect()
    assert {r.doc_id for r in got} == {2**60 + 1, 2**60 + 2, None}


def test_copies_of_one_row_are_dealt_over_the_groups(spark):
    got = pack(spark.createDataFrame([(1, "a b c")] * 400, "doc_id long, text string"), PATH, group_docs=20).collect()
    groups = {}
    for r in got:
        groups[r.sequence_id >> 32] = groups.get(r.sequence_id >> 32, 0) + 1
    assert len(groups) == 20 and max(groups.values()) <= 60
