import hashlib
import random
import re
import string
from pathlib import Path

import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from tests.llm.helpers import LONG
from webstrata.llm import secret_scan
from webstrata.llm.common import owner, shared_folder, written
from webstrata.llm.quality_rules import quality_rules

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, gone string"


def test_stages_on_odd_rows(spark):
    prose = "The harbour was quiet that morning, and the fishermen who usually gathered by the old stone wall had gone home early because of the fog over the bay."
    rows = [(1, prose), (2, prose + " Only one boat was left."), (3, None), (4, ""), (5, LONG), (6, prose + " The key is password=abc123def456 and so on."), (None, prose), (1, prose), (7, "token " * 4)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "a", "b") for i, t in rows], SCHEMA)
    for name, stage in pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, ""), "stage")
        assert docs.columns == list(pipeline.COLUMNS), name
        assert docs.where(F.col("n_chars") != F.char_length("text")).count() == 0
    left = {r.doc_id: r.text for r in docs.collect()}
    assert 6 not in left or "abc123" not in left[6]
    assert not {3, 4, 5, 7} & set(left)
    last = pipeline.STAGES[-1][1](spark, docs, "")
    assert {r.doc_id for r in last.collect()} == set(left)


def test_near_duplicates_leave_one_of_each_group(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = [r.text for r in pipeline.drop_near_duplicates(spark, docs, sf_dir).collect()]
    assert len(kept) == len(set(kept))
    words = [re.findall("[^\x20\x09-\x0d]+", t.lower()) for t in kept]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in words]
    assert not any(a and b and len(a & b) * 100 >= 80 * len(a | b) for i, a in enumerate(sets) for b in sets[:i])


def words_of(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def brute_near(rows):
    """Kept (doc_id, text) of (doc_id, text) rows."""
    rows = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, hashlib.md5((r[1] or "").encode()).hexdigest()))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()) for w in (words_of((t or "").lower()) for _, t in rows)]
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b) and group[i] != group[j]:
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    return sorted((r for i, r in enumerate(rows) if group[i] == i), key=str)


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(12)
    texts = [" ".join(f"w{rng.randint(0, 99)}" for _ in range(60)) for _ in range(4)]
    rows = []
    for t in texts:
        for _ in range(6):
            w = t.split()
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(60)] = f"z{rng.randint(0, 9)}"
            rows.append((rng.choice([None, *range(8)]), " ".join(w)))
    rows += rows[:5] + [(1, "one two"), (1, "three four"), (2, "ONE  two"), (3, None), (4, ""), (None, ""), (None, "x y"), (None, "x y"), (3, None), (7, LONG)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, "a", "b") for i, t in rows], SCHEMA)
    got = pipeline.drop_near_duplicates(spark, docs, "").collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == brute_near(rows)


def test_near_duplicates_tell_rows_apart_by_text(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    docs = spark.createDataFrame([(1, a), (1, b), (2, a)], "doc_id long, text string").selectExpr("*", "'en' lang", "'s' source", "1L n_chars")
    assert sorted((r.doc_id, r.text) for r in pipeline.drop_near_duplicates(spark, docs, "").collect()) == [(1, a), (1, b)]


def test_documents_emptied_by_line_dedup_go(spark):
    line = "A line that three documents share and no other does"
    docs = spark.createDataFrame([(1, line), (2, f"{line}\n \n"), (3, line), (4, f"{line}\nown"), (5, ""), (6, None)], "doc_id long, text string").selectExpr("*", "'en' lang", "'s' source", "1L n_chars")
    got = {r.doc_id: (r.text, r.n_chars) for r in pipeline.drop_lines(spark, docs, "").collect()}
    assert got == {4: (f"{line}\nown", len(line) + 4), 5: ("", 0), 6: ("", 0)}


def test_quality_secrets_and_lines_follow_their_operators(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    judged = quality_rules(docs, public_tokenizers.path("piece_bpe_32k.model")).where("kept").collect()
    assert {r.doc_id: r.text for r in pipeline.keep_quality(spark, docs, sf_dir).collect()} == {r.doc_id: texts[r.doc_id] for r in judged}
    masked = {r.doc_id: r.text for r in pipeline.mask_secrets(spark, docs, sf_dir).collect()}
    for i, t in texts.items():
        spans = secret_scan.base_spans(t)
        assert masked[i] == secret_scan.redacted(t, spans + [s for s, _ in secret_scan.learned_spans(t, spans, secret_scan.default_scorer())], "[SECRET]")
    lines = {r.doc_id: r.text for r in pipeline.drop_lines(spark, docs, sf_dir).collect()}
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))
    holders = {}
    for i, t in texts.items():
        for x in t.split("\n"):
            if len(key(x)) >= 20:
                holders.setdefault(key(x), set()).add(i)
    left = {i: "\n".join(x for x in t.split("\n") if len(holders.get(key(x), ())) < 3 or i == max(holders[key(x)])) for i, t in texts.items()}
    assert lines == {i: t for i, t in left.items() if t == texts[i] or words_of(t)}


def test_stages_of_empty_tables(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for name, stage in pipeline.STAGES:
        assert stage(spark, docs, "").count() == 0, name


def test_a_stage_drops_what_the_one_before_left(spark):
    rows = [(i, f"line {i} is long enough to be a key\nand one of {i % 3} that repeats across texts", "en", "s", 1, "a", "b") for i in range(12)]
    before = set(Path(shared_folder(spark).removeprefix("file:")).iterdir())
    with owner(pipeline.OWNER):
        one = written(pipeline.drop_lines(spark, spark.createDataFrame(rows, SCHEMA), ""), "one")
    folder = Path(one.scratch.removeprefix("file:"))
    assert {p.name.split("-")[0] for p in set(folder.parent.iterdir()) - before} == {"gone", "one"}
    pipeline.mask_secrets(spark, one, "").collect()
    assert set(folder.parent.iterdir()) - before == {folder} and one.count() == 12
