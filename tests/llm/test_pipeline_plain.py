"""Every stage of the pipeline, and run(), against plain Python on awkward rows.

Stages 1, 2, 3 and 5 are told again row by row; of the mix, the counts follow from ``mixing.mix``,
which has tests of its own. Rows hold nulls in every column, copies, near copies, repeated rows, a
shared passage, empty and long texts, and columns with names that the operators use themselves.
"""

import collections
import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidepanel.llm import mixing, quality

EXTRA = "row_number string, text_key string, score string, size string, times string"
COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + EXTRA
LABELS = "doc_id bigint, quality int"
STAGE = dict(corpus_pipeline.STAGES)


def prose(rnd, words, stem="w"):
    return " ".join(f"{stem}{rnd.randrange(3000)}" for _ in range(words))


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(11)
    base, shared = prose(rnd, 150).split(), prose(rnd, 80)
    texts = [prose(rnd, rnd.randrange(30, 200)) for _ in range(20)]
    texts += [prose(rnd, 60, "zq#") for _ in range(8)]  # the bad kind
    texts += [" ".join(base)] * 3
    for _ in range(5):
        near = list(base)
        near[rnd.randrange(len(near))] = "Changed"
        texts.append(" ".join(near))
    texts += [prose(rnd, 30) + " " + shared + " äö " + prose(rnd, 30) for _ in range(4)]
    texts += [None, "", " \n\t", "one", "One", prose(rnd, 4000), "la la " * 300, "ü" * 400]
    made = [(i, t, None if i % 5 == 0 else "en", None if i % 7 == 0 else f"src{i % 3}", len(t or ""), *["clash"] * 5)
            for i, t in enumerate(texts)]
    made += [made[2], made[2]]  # repeated rows
    made += [(None, made[4][1], "en", "src1", 0, *[None] * 5)]  # a copy without an id
    made += [(None, only := prose(rnd, 70), None, None, None, *[None] * 5)] * 2  # a text of such rows alone
    assert only
    return made


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{path}/documents.parquet")
    labels = [(i, int("zq#" not in (t or ""))) for i, t, *_ in rows if i is not None and t]
    spark.createDataFrame(labels, LABELS).write.parquet(f"{path}/labels.parquet")
    return path


def scored(rows, model):
    of = quality.margin(model)
    return [r for r in rows if 1 / (1 + math.exp(-(of(r[1]) * model.slope + model.offset))) >= 0.3]


def words_of(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def one_per_group(rows):
    sets = []
    for row in rows:
        words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words_of(row[1])]
        sets.append({tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = {}
    for i, row in enumerate(rows):
        key = group[i] if sets[i] else ("alone", i)
        rank = (row[0] is None, row[0] or 0)
        if key not in least or rank < least[key][0]:
            least[key] = rank, row
    return [row for _, row in least.values()]


def without_long_repeats(rows, length=200):
    data = [(r[1] or "").encode() for r in rows]
    times = collections.Counter(d[i:i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for row, d in zip(rows, data):
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if times[d[i:i + length]] > 1:
                gone[i:i + length] = b"\x01" * length
        if any(gone):
            text = bytes(b for b, g in zip(d, gone) if not g).decode(errors="ignore")
            row = (row[0], text, *row[2:4], len(text), *row[5:])
        out.append(row)
    return out


def as_often(spark, rows):
    """Each row floor(taken / size + 0.5) times; the takings of rows with one doc_id and size are added up."""
    found = mixing.mix(spark.createDataFrame(rows, COLUMNS)).collect()
    taken, size = collections.Counter(), collections.Counter()
    for r in found:
        taken[r.doc_id, r["size"]] += r.taken
        size[r.doc_id, r["size"]] += r["size"]
    out = []
    for row in rows:
        key = row[0], len(words_of(row[1]))
        fixed = row[0] is None or key[1] == 0
        out += [row] * (1 if fixed else math.floor(taken[key] / size[key] + 0.5))
    return out


def tokens(rows):
    import public_tokenizers
    import tokenizers

    library = tokenizers.Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    library.no_truncation()
    library.no_padding()
    out = []
    for row in rows:
        ids = library.encode(row[1] or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        out.append((row[0], len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest(),
                    hashlib.sha256(back.encode()).hexdigest()))
    return out


def bag(rows):
    return collections.Counter(map(tuple, rows))


def test_stages_and_run_equal_plain_python(spark, rows, folder):
    pytest.importorskip("public_tokenizers")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    plain = {
        "quality classifier": lambda held: scored(held, model),
        "minhash near-dedup": one_per_group,
        "suffix-array dedup": without_long_repeats,
        "mixing to target weights": lambda held: as_often(spark, held),
        "bpe encoding and decoding": tokens,
    }
    assert list(plain) == [name for name, _ in corpus_pipeline.STAGES]
    held = rows
    for name, expected in plain.items():
        before = spark.createDataFrame(held, COLUMNS)
        held = expected(held)
        assert bag(STAGE[name](spark, before, folder).collect()) == bag(held), name
        assert 0 < len(held), name
    assert bag(corpus_pipeline.run(spark, folder).collect()) == bag(held)


def test_a_text_with_copies_is_still_there_once_after_the_repeats(spark, rows, folder):
    docs = spark.createDataFrame(rows, COLUMNS)
    left = STAGE["suffix-array dedup"](spark, STAGE["minhash near-dedup"](spark, docs, folder), folder)
    for text in (rows[2][1], rows[4][1], rows[-1][1]):
        assert left.where(F.col("text") == text).count() == 1
