"""Operators against brute force, and on nulls, empty and long texts, ties, repeats and empty tables."""

import base64
import collections
import hashlib
import io
import random
import re
import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepanel.llm import (bpe, chat, components, embeddings, hnsw, license, minhash, mixing, quality, suffix, warc)

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def prose(rnd, words, vocabulary=4000):
    return " ".join(f"w{rnd.randrange(vocabulary)}" for _ in range(words))


@pytest.fixture(scope="module")
def awkward():
    """Texts with copies, near copies, a shared passage, nulls, empty, one-word and very long ones."""
    rnd = random.Random(5)
    base = prose(rnd, 120).split()
    shared = prose(rnd, 80)
    texts = [prose(rnd, rnd.randrange(20, 200)) for _ in range(25)]
    texts += [" ".join(base)] * 3
    for _ in range(12):
        near = list(base)
        near[rnd.randrange(len(near))] = "changed"
        near[rnd.randrange(len(near))] = f"other{rnd.randrange(99)}"
        texts.append(" ".join(near))
    texts += [prose(rnd, 30) + " " + shared + " " + prose(rnd, 30) for _ in range(6)]
    texts += [None, None, "", " \n\t", "one", "One", "äöü ÄÖÜ x", "nul\x00 in text", prose(rnd, 9000), "la la " * 400]
    return texts


@pytest.fixture(scope="module")
def docs(spark, awkward):
    rows = [(i, t, "en", None if i % 7 == 0 else f"src{i % 4}", 0) for i, t in enumerate(awkward)]
    rows.append(rows[3])  # a repeated row
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def clashing(df):
    """The same rows with columns named like those that operators make."""
    for name in ("size", "times", "k", "n", "spans", "node", "score", "predicted", "component_id", "kept", "words", "h"):
        df = df.withColumn(name, F.lit("clash"))
    return df


def shingle_set(text, k):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + k]) for i in range(max(1, len(words) - k + 1)))


def groups(texts, k, percent):
    sets = {i: shingle_set(t, k) for i, t in enumerate(texts)}
    low = {i: i for i in sets}
    changed = True
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            m = min(low[a], low[b])
            if low[a] != m or low[b] != m:
                low[a] = low[b] = m
                changed = True
    return {i: (len(sets[i]), low[i]) for i in sets}


@pytest.mark.parametrize("words", [2, 5])
def test_minhash_finds_the_groups_of_brute_force(docs, awkward, words):
    expected = groups(awkward, words, 80)
    rows = minhash.near_duplicates(clashing(docs), words=words).collect()
    assert len(rows) == len(awkward) + 1
    for r in rows:
        assert (r.n_shingles, r.component_id) == expected[r.doc_id]
        assert r.kept == (r.doc_id == r.component_id)


def test_minhash_tiles_link_components_and_leave_out_pairs_within_one(spark, monkeypatch):
    """A bucket of one large component and a few others: every link between components, few rows."""
    monkeypatch.setattr(minhash, "BLOCK", 4)
    rnd = random.Random(4)
    base = prose(rnd, 60).split()
    far = prose(rnd, 60).split()
    texts = [base[:i % 50] + ["x"] + base[i % 50 + 1:] for i in range(40)] + [far, far[:-1] + ["y"], far[:-2] + ["z", "w"]]
    sets = minhash._sets(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string"), 2)
    roots = [0] * 37 + [37, 37, 39, 40, 41, 42]  # as if 37, 38 and 39 had not been linked with the first ones yet
    named = spark.createDataFrame([(7, i, r, len(texts)) for i, r in enumerate(roots)], "key bigint, node bigint, root bigint, held bigint")
    found = {tuple(r) for r in minhash._tiled(named, sets, 80).collect()}
    assert found == {(a, b) for a, b in [(0, 37), (0, 39), (37, 39), (40, 41), (40, 42), (41, 42)]
                     if any(100 * len(x & y) >= 80 * len(x | y) for x, y in (
                         (shingle_set(" ".join(texts[i]), 2), shingle_set(" ".join(texts[j]), 2))
                         for i in range(43) for j in range(43) if roots[i] == a and roots[j] == b))}
    assert {(0, 37), (0, 39), (37, 39), (40, 41)} <= found


def test_minhash_on_nothing_and_null_ids(spark, nothing):
    assert minhash.near_duplicates(nothing).collect() == []
    rows = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (None, "z"), (9, None)], "doc_id bigint, text string")
    found = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(rows).collect()}
    assert found == {(None, 2, 4, False), (4, 2, 4, True), (None, 1, None, True), (9, 0, 9, True)}


def test_one_of_each_keeps_columns(docs, awkward):
    kept = minhash.one_of_each(clashing(docs), words=5)
    assert kept.columns == clashing(docs).columns
    expected = sorted({v[1] for v in groups(awkward, 5, 80).values()} | {3})
    assert sorted({r.doc_id for r in kept.collect()}) == sorted(set(expected))


def test_one_row_of_each_group_survives_with_its_text(spark):
    rnd = random.Random(8)
    a, b, c, d, e = (prose(rnd, 120) for _ in range(5))
    near_c, near_d = c.rsplit(" ", 1)[0] + " changed", d.rsplit(" ", 1)[0] + " changed"
    rows = [(1, a), (1, a), (1, a),              # a repeated row
            (None, b), (4, b), (None, b),        # null ids beside an id
            (None, c), (None, near_c),           # near copies under null ids only
            (None, d), (9, near_d),              # a null id whose near copy has one
            (7, e), (7, a), (7, d),              # an id of three texts, two of them held elsewhere
            (None, None), (None, None), (5, ""), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    once = minhash.one_of_each(docs)
    found = [(r.doc_id, r.text) for r in once.collect()]
    assert sum(x == (None, c) or x == (None, near_c) for x in found) == 1
    # of d the smallest id stays: 7 before 9 before null
    assert collections.Counter(x for x in found if x[1] not in (c, near_c)) == collections.Counter(
        [(1, a), (4, b), (7, d), (7, e), (None, None), (None, None), (5, ""), (5, "")])
    # the strings of 200 bytes are left alone, as each now stands in one row
    assert collections.Counter(map(tuple, suffix.without_repeats(once).collect())) == collections.Counter(found)


def test_components_of_a_path_a_star_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (None, 3), (205, 201), (201, 205)]
    found = dict(map(tuple, components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()))
    assert found == {i: 0 for i in range(1, 41)} | {100 + i: 100 for i in range(1, 30)} | {205: 201}


def brute_repeats(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = collections.Counter(d[p:p + length] for d in data for p in range(len(d) - length + 1))
    out = []
    for d in data:
        covered = np.zeros(len(d), bool)
        for p in range(len(d) - length + 1):
            if seen[d[p:p + length]] > 1:
                covered[p:p + length] = True
        kept = bytes(np.frombuffer(d, np.uint8)[~covered])
        spans = int((np.diff(np.concatenate([[0], covered.astype(int)])) == 1).sum())
        out.append((len(d), int(covered.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [None, 0, 3000])
def test_suffix_arrays_remove_what_brute_force_removes(docs, awkward, monkeypatch, hot):
    """With no limit, with every group counted in the end, and with groups split by further anchors."""
    if hot is not None:
        monkeypatch.setattr(suffix, "HOT_BYTES", hot)
        monkeypatch.setattr(suffix, "BROADCAST_BYTES", 0)
        monkeypatch.setattr(suffix, "STRIP", 7)
        monkeypatch.setattr(suffix, "OUT_BYTES", 5000)
        monkeypatch.setattr(suffix, "BATCH_BYTES", 1500)
    expected = brute_repeats([*awkward, awkward[3]], 200)
    rows = suffix.repeats(clashing(docs)).collect()
    assert len(rows) == len(expected)
    for r in rows:
        assert tuple(r)[1:] == expected[r.doc_id]


def test_suffix_levels_merge_like_a_binary_counter():
    rnd = np.random.default_rng(3)
    pool = [bytes(rnd.integers(97, 100, 60, np.uint8)) for _ in range(9)]
    family, texts, names = suffix.SuffixLevels(20), [], 0
    for batch in range(11):
        text = pool[batch % 9] + bytes(rnd.integers(97, 123, 30, np.uint8)) + b"\x00" * 3
        places = np.arange(len(text) - 19)
        family.add(np.frombuffer(text, np.uint8), places, places + names)
        texts += [text[p:p + 20] for p in places]
        names += len(places)
        assert [x.units for x in family.levels] == [1 << b for b in reversed(range(5)) if (batch + 1) >> b & 1]
        for level in family.levels:
            strings = [bytes(level.text[p:p + 20]) for p in level.places.tolist()]
            assert strings == sorted(set(strings))
    count = collections.Counter(texts)
    assert set(family.repeated().tolist()) == {i for i, t in enumerate(texts) if count[t] > 1}


def test_suffix_runs_cover_every_window_once():
    data = prose(random.Random(1), 800).encode() + b"a" * 700
    _, first, count = suffix.runs(data)
    assert first[0] == 0 and (first[1:] == first[:-1] + count[:-1]).all() and first[-1] + count[-1] == len(data) - 199


def test_suffix_on_nothing_and_as_a_stage(nothing, docs, awkward):
    assert suffix.repeats(nothing).collect() == []
    out = suffix.without_repeats(clashing(docs))
    assert out.columns == clashing(docs).columns
    expected = brute_repeats([*awkward, awkward[3]], 200)
    for r in out.collect():
        if r.text is None:
            assert awkward[r.doc_id] is None
        else:
            assert len(r.text.encode()) <= expected[r.doc_id][0] - expected[r.doc_id][1]


def test_mixing_meets_targets(docs, awkward, nothing):
    rows = mixing.mix(clashing(docs).drop("source").join(docs.select("doc_id", "source").distinct(), "doc_id"), block_words=16).collect()
    assert len(rows) == len(awkward) + 1
    words = re.compile(r"[^\x20\x09-\x0D]+")
    taken, target, total = collections.Counter(), {}, collections.Counter()
    for r in rows:
        source = None if r.doc_id % 7 == 0 else f"src{r.doc_id % 4}"
        assert r.size == len(words.findall(awkward[r.doc_id] or ""))
        assert 0 <= r.taken <= 3 * r.size
        taken[source] += r.taken
        total[source] += r.size
        target[source] = r.target
        assert r.source_size >= r.size
    assert abs(sum(target.values()) - sum(total.values())) < 1e-6
    for source, goal in target.items():
        assert goal <= 3 * total[source] + 1e-6 and goal - 1 < taken[source] <= goal
    assert mixing.mix(nothing).collect() == []
    again = mixing.mix(docs, block_words=16).collect()
    assert sorted(map(tuple, again), key=str) == sorted(map(tuple, rows), key=str)


def test_mixing_caps_and_reshares(spark):
    sizes = spark.createDataFrame([("a", 100), ("b", 10), ("c", 0), (None, 50)], "source string, total bigint")
    found = {r.source: (r.weight, r.target) for r in mixing.targets(sizes).collect()}
    assert found["b"] == (2, 30.0) and found["c"] == (3, 0.0)
    assert found["a"][0] == 1 and found[None][0] == 1 and abs(found["a"][1] - 65) < 1e-9 and abs(found[None][1] - 65) < 1e-9


def test_mixed_rows_come_as_often_as_taken(docs, nothing):
    source = clashing(docs)
    out = mixing.mixed(source)
    assert out.columns == source.columns and out.count() > 0 and mixing.mixed(nothing).collect() == []


def test_license_blocks_equal_brute_force(spark, nothing):
    rnd = random.Random(2)
    notice = license.TEMPLATES["bsd"].split()
    texts = ["Released under the MIT License. under the mit license", "Apache License, Version 2.0", "CC BY-NC", None, "", "é under",
             prose(rnd, 40) + " " + " ".join(notice) + " " + prose(rnd, 40),
             " ".join(notice[:-6]), " ".join(reversed(notice)), prose(rnd, 300) + " " + " ".join(notice[2:])]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = {r.doc_id: r for r in license.scan(clashing(rows)).collect()}
    assert (found[0].n_base, found[0].first_word, found[0].last_word, found[0].base_labels) == (2, 1, 5, "mit")
    assert found[1].base_labels == "apache-2" and found[2].base_labels == "cc-by-nc" and found[2].n_words == 3
    assert found[3].n_words == 0 and found[3].labels == "" and found[3].score == 0 and found[3].first_word is None
    for i, text in enumerate(texts):
        words = re.findall(license.WORD, (text or "").lower())
        blocks = [set(words[s:s + license.WINDOW]) for s in range(0, max(len(words), 1), license.STEP)]
        more = {label for label, t in license.TEMPLATES.items()
                if any(100 * len(b & set(t.split())) >= license.SHARE * len(set(t.split())) for b in blocks)}
        assert set(filter(None, found[i].labels.split(","))) == more | set(filter(None, found[i].base_labels.split(",")))
    assert license.scan(nothing).collect() == []


def test_license_tells_creative_commons_notices_apart(spark):
    rnd = random.Random(3)

    def notice(name, version="4.0 International"):
        return f"This work is licensed under a Creative Commons Attribution{name} {version} License."

    by, nc = notice(""), notice("-NonCommercial")
    expected = {
        by: "cc-by", nc: "cc-by-nc", notice(" - Non-Commercial"): "cc-by-nc", by + " " + nc: "cc-by,cc-by-nc",
        nc + " Attribution is required.": "cc-by-nc", by + " Not for noncommercial use only.": "cc-by",
        notice("-ShareAlike"): "", notice("-ShareAlike", "3.0 Unported"): "", notice("-Share Alike", "3.0 Unported"): "",
        notice("-NonCommercial-ShareAlike"): "", notice("-NoDerivatives"): "", notice("-NonCommercial-NoDerivs"): "",
        " ".join(reversed(license.TEMPLATES["cc-by"].split())): "cc-by",
        " ".join(reversed(license.TEMPLATES["cc-by-nc"].split())): "cc-by-nc"}
    expected |= {prose(rnd, n) + " " + text + " " + prose(rnd, 70): labels
                 for n in (20, 55, 63, 100) for text, labels in list(expected.items())[:2]}
    rows = spark.createDataFrame(list(enumerate(expected)), "doc_id bigint, text string")
    found = {r.doc_id: (r.labels, r.score) for r in license.scan(rows).collect()}
    for i, (text, labels) in enumerate(expected.items()):
        # "non commercial" in two words lacks one of the template's 14
        score = 0.0 if not labels else 13 / 14 if "Non-Commercial" in text and " - " in text else 1.0
        assert found[i] == (labels, score), text


def test_archives_round_trip(spark):
    pages = [(1, "http://a/\n1", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "u", None), (4, "u", ""), (5, "ü", "é" * 5000),
             (0, "z", "only"), (5, "ü", "é" * 5000), (None, "n", "<p>x</p>")]
    rows = spark.createDataFrame(pages, "page_id bigint, url string, html string").withColumn("digest", F.lit(1))
    found = warc.round_trip(rows.repartition(2)).collect()
    assert len(found) == len(pages)
    first = {}
    for i, _, html in sorted((p for p in pages if p[0] is not None), key=lambda p: p[0]):
        first.setdefault(html or "", i)
    for r, (i, _, html) in zip(sorted(found, key=lambda r: str(r.page_id)), sorted(pages, key=lambda p: str(p[0]))):
        data = (html or "").encode()
        assert r.page_id == (None if i is None else str(i)) and r.payload_bytes == len(data)
        assert r.payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
        same = first[html or ""] == i
        assert (r.record_type, r.refers_to) == (("response", None) if same else ("revisit", str(first[html or ""])))
    assert warc.round_trip(rows.limit(0)).collect() == []


def test_zip_directories_with_zip64_fields():
    """A package whose directory keeps sizes, places and its own place in ZIP64 fields only."""
    whole = io.BytesIO()
    with zipfile.ZipFile(whole, "w") as z:
        z.writestr("one", b"first")
        z.writestr("two", b"second member")
        z.comment = b"PK\x05"
    data = whole.getvalue()

    def reader(raw):
        return lambda offset, length: raw[offset:offset + length]

    plain = warc.directory(reader(data), len(data))
    assert [(m.name, m.size) for m in plain] == [("one", 5), ("two", 13)]
    start = min(data.index(b"PK\x01\x02"), len(data))
    body, entries = data[:start], b""
    for m in plain:
        name = m.name.encode()
        extra = struct.pack("<HHQQQ", 1, 24, m.size, m.size, m.header)
        entries += (b"PK\x01\x02" + struct.pack("<HHHHHHIIIHHHHHII", 45, 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF,
                                                len(name), len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + name + extra)
    end64 = b"PK\x06\x06" + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, 2, 2, len(entries), len(body))
    locator = b"PK\x06\x07" + struct.pack("<IQI", 0, len(body) + len(entries), 1)
    end = b"PK\x05\x06" + struct.pack("<HHHHIIH", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    large = body + entries + end64 + locator + end
    assert warc.directory(reader(large), len(large)) == plain
    at = warc.stored_at(reader(large), plain[1])
    assert large[at:at + plain[1].size] == b"second member"
    with pytest.raises(ValueError):
        warc.directory(reader(b"not a package"), 13)


def vectors(spark):
    rnd = np.random.default_rng(4)
    base = rnd.normal(size=(60, 16))
    near = base[:6].repeat(8, axis=0) + rnd.normal(size=(48, 16)) * 0.12
    rows = [*base.tolist(), *near.tolist(), *([base[0].tolist()] * 20), (base[1] * 7).tolist(), [0.0] * 16, None,
            [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, [1.0, 2.0], [2.0, 4.1], []]
    return rows, spark.createDataFrame(list(enumerate(rows)), "vec_id bigint, embedding array<double>").withColumn("label", F.lit(1))


def cosines(rows):
    usable = [r is not None and len(r) > 0 and None not in r and bool(np.isfinite(r).all()) and any(r) for r in rows]
    out = np.full((len(rows), len(rows)), -9.0)
    for i in range(len(rows)):
        for j in range(len(rows)):
            if i != j and usable[i] and usable[j] and len(rows[i]) == len(rows[j]):
                a, b = np.array(rows[i]), np.array(rows[j])
                out[i, j] = a @ b / np.sqrt((a @ a) * (b @ b))
    return usable, out


@pytest.mark.parametrize("tile", [7, 2048])
def test_embedding_links_equal_brute_force(spark, tile):
    rows, table = vectors(spark)
    _, near = cosines(rows)
    linked = near >= 0.95
    low = np.arange(len(rows))
    for _ in range(len(rows)):
        low = np.array([min([low[i], *low[linked[i]]]) for i in range(len(rows))])
    for r in embeddings.near_duplicates(table, tile=tile).collect():
        assert (r.n_links, r.component_id, r.kept) == (linked[r.vec_id].sum(), low[r.vec_id], low[r.vec_id] == r.vec_id)
    assert embeddings.near_duplicates(table.limit(0)).collect() == []


def test_embedding_tiles_are_written_once(spark, monkeypatch):
    """Tiles reach the comparison as files: nothing is joined or shuffled per pair of tiles but their numbers."""
    rnd = np.random.default_rng(9)
    base = rnd.normal(size=(300, 40))
    rows = np.concatenate([base, base[:40].repeat(6, axis=0) + rnd.normal(size=(240, 40)) * 0.1, base[:9]]).astype(np.float32)
    rows = np.concatenate([rows, rows[-40:, ::-1], (rows[:30, :1] * 0 + 1) + rnd.normal(size=(30, 40)).astype(np.float32) * 0.02])
    table = spark.createDataFrame([(i, r) for i, r in enumerate(rows.tolist())], "vec_id bigint, embedding array<float>")
    plans, keep = {}, embeddings.written

    def seen(df, name):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return keep(df, name)

    monkeypatch.setattr(embeddings, "written", seen)
    monkeypatch.setattr(embeddings, "EDGES", 50)
    monkeypatch.setattr(embeddings, "STRIP", 16)
    found = {r.vec_id: tuple(r)[1:] for r in embeddings.near_duplicates(table, tile=33).collect()}
    assert "Join" not in plans["links"] and "binary" not in plans["links"]
    wide = rows.astype(np.float64)
    wide /= np.linalg.norm(wide, axis=1)[:, None]
    linked = wide @ wide.T >= 0.95
    np.fill_diagonal(linked, False)
    low = np.arange(len(rows))
    for _ in range(len(rows)):
        low = np.minimum(low, np.where(linked, low[None, :], len(rows)).min(axis=1))
    assert linked.sum() > 300
    assert found == {i: (linked[i].sum(), low[i], low[i] == i) for i in range(len(rows))}


def test_nearest_neighbours_recall_and_scores(spark):
    rows, table = vectors(spark)
    usable, near = cosines(rows)
    found = hnsw.nearest(table, F.col("vec_id") % 5 == 0, shard=40).collect()
    hits = wanted = 0
    for q in range(0, len(rows), 5):
        got = sorted((r for r in found if r.query_id == q), key=lambda r: r["rank"])
        candidates = [j for j in range(len(rows)) if near[q, j] > -9]
        assert usable[q] or not got
        assert [r["rank"] for r in got] == list(range(1, min(5, len(candidates)) + 1))
        for r in got:
            assert abs(r.score - near[q, r.vec_id]) < 1e-12
        assert [(-r.score, r.vec_id) for r in got] == sorted((-r.score, r.vec_id) for r in got)
        hits += sum(r.score >= near[q][sorted(candidates, key=lambda j: -near[q, j])[min(5, len(candidates)) - 1]] - 1e-12 for r in got)
        wanted += min(5, len(candidates))
    assert hits >= 0.9 * wanted
    assert hnsw.nearest(table.limit(0), F.lit(True)).collect() == []


def test_nearest_returns_the_best_of_all_shards_of_a_task(spark, monkeypatch):
    """Neither shards nor queries are joined, and a query has no row per shard."""
    rnd = np.random.default_rng(5)
    rows = rnd.normal(size=(400, 12)).astype(np.float32)
    rows[300:330] = rows[:30]
    table = spark.createDataFrame([(i, r) for i, r in enumerate(rows.tolist())], "vec_id bigint, embedding array<float>")
    frames, keep = [], hnsw.search

    def seen(*args, **kind):
        frames.append(keep(*args, **kind))
        return frames[-1]

    monkeypatch.setattr(hnsw, "search", seen)
    monkeypatch.setattr(hnsw, "UNITS", 4, raising=False)
    found = hnsw.nearest(table, F.col("vec_id") % 4 == 0, shard=20).collect()
    assert "Join" not in frames[0]._jdf.queryExecution().optimizedPlan().toString()
    assert frames[0].groupBy("query_id").count().agg(F.max("count")).first()[0] < 7 * 6
    wide = rows.astype(np.float64)
    wide /= np.linalg.norm(wide, axis=1)[:, None]
    for q in range(0, 400, 4):
        score = {i: wide[i] @ wide[q] for i in range(400) if i != q}
        got = sorted((r["rank"], r["vec_id"], r["score"]) for r in found if r["query_id"] == q)
        best = sorted(score, key=lambda i: (-round(score[i], 12), i))[:5]
        assert [g[1] for g in got] == best and np.allclose([g[2] for g in got], [score[i] for i in best], atol=1e-12)


def test_quality_samples_labelled_documents_and_more_blocks(spark):
    rnd = random.Random(7)
    rows = spark.createDataFrame([(i, prose(rnd, 1500) if i % 2 else "BUY $$$ " * 900) for i in range(60)], "doc_id bigint, text string")
    kinds = "doc_id bigint, quality int, toxic int"
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], kinds)
    strays = spark.createDataFrame([(i, i % 2, 0) for i in range(1000, 5000)], kinds)
    alone = quality.fit(rows, labels, sample_rows=40, curve_rows=40)
    assert quality.fit(rows, labels.union(strays), sample_rows=40, curve_rows=40) == alone  # strays use up no sample
    assert alone.good != quality.fit(rows, labels, sample_rows=40, curve_rows=40, sample_blocks=1).good


def test_chat_links_orders_and_checks(spark):
    calls = spark.createDataFrame([
        ("c", "a", "lookup", '{"words": 2, "query": "x"}', []), ("c", "b", "lookup", '{"query": 3, "z": {"b": 1, "a": [2]}}', ["a"]),
        ("c", "d", "measure", "[1]", ["b", "a"]), ("c", "e", "what", "{}", ["gone"]), ("c", "x", "note", None, ["y"]),
        ("c", "y", "note", '{"text": "t"}', ["x"]), ("c", "w", "note", "{", ["y"]), (None, None, "note", "{}", [])],
        "conv_id string, call_id string, name string, arguments string, needs array<string>")
    results = spark.createDataFrame([("c", "a", "r1"), ("c", "a", "r2"), ("c", "q", "lost"), ("z", "b", None)],
                                    "conv_id string, call_id string, content string")
    tools = spark.createDataFrame(chat.TOOLS, "name string, fields map<string,string>, required array<string>")
    rows = chat.linked(calls.withColumn("depth", F.lit(9)), results, tools).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.conv_id, r.call_id].append(r)
    assert sorted(r.content for r in by["c", "a"]) == ["r1", "r2"] and by["c", "a"][0].arguments == '{"query":"x","words":2}'
    assert {k: v[0].depth for k, v in by.items() if k[0] == "c" and k[1] != "q"} == {
        ("c", "a"): 0, ("c", "b"): 1, ("c", "d"): 2, ("c", "e"): 0, ("c", "x"): None, ("c", "y"): None, ("c", "w"): None}
    b = by["c", "b"][0]
    assert (b.status, b.valid, b.errors, b.arguments) == ("no_result", False, "type:query,unknown:z", '{"query":3,"z":{"a":[2],"b":1}}')
    assert by["c", "d"][0].errors == "json" and by["c", "e"][0].errors == "tool" and by["c", "w"][0].errors == "json"
    assert by["c", "y"][0].errors == "missing:turn" and by["c", "q"][0].status == "no_call" and len(rows) == 11
    assert chat.linked(calls.limit(0), results.limit(0), tools).collect() == []


def test_tokens_equal_the_library(spark, docs, awkward):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rnd = random.Random(8)
    letters = [chr(c) for c in [*range(32, 127), *range(0xA0, 0x250), 0x3A3, 0x130, 0x1F600, 0xAC00, 0x1100, 0x558, 0x1C89, 0x0301]]
    texts = [t or "" for t in awkward] + ["ΟΔΟΣ", "<|endoftext|>a<|startoftext|>", "I'LL we're 12½", "\x1c\x85a", "a" * 3000]
    texts += ["".join(rnd.choice(letters) for _ in range(rnd.randrange(60))) for _ in range(400)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for r in bpe.tokenize(clashing(rows), path).collect():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == ids and r.n_tokens == len(ids)
        shown = library.decode(ids, skip_special_tokens=False)
        assert r.decoded == shown and r.decoded_sha256 == hashlib.sha256(shown.encode()).hexdigest()
        assert r.ids_sha256 == hashlib.sha256(bytes(r.ids)).hexdigest()
    empty = bpe.tokenize(docs.where("text is null"), path).collect()
    assert empty and all(r.n_tokens == 0 and r.decoded == "" for r in empty)


def test_quality_separates_and_survives_missing_classes(spark, nothing):
    rnd = random.Random(6)
    texts = [(i, prose(rnd, 60) if i % 3 else "!!! BUY $$$ " * rnd.randrange(5, 30)) for i in range(300)] + [(300, None), (301, "")]
    rows = spark.createDataFrame(texts, "doc_id bigint, text string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(300)] + [(4, None, 0), (5, 0, 0)],
                                   "doc_id bigint, quality int, toxic int")
    model = quality.fit(rows, labels)
    scored = {r.doc_id: r.s for r in rows.select("doc_id", quality.score(F.col("text"), model).alias("s")).collect()}
    right = sum((scored[i] >= 0.5) == (i % 3 > 0) for i in range(300))
    assert right >= 290 and 0 < scored[300] < 1 and scored[300] == scored[301]
    kept = quality.accepted(rows, model)
    assert kept.columns == rows.columns and 195 <= kept.count() <= 210
    one = quality.fit(rows, labels.where("quality = 1 and doc_id <> 5"))
    assert one.bad is None and quality.accepted(rows, one).count() == 302
    none = quality.fit(rows, labels.limit(0))
    assert quality.accepted(rows, none).count() == 302
    assert quality.accepted(nothing, quality.fit(nothing, labels)).collect() == []


def test_license_scan_is_linear_in_a_dense_text(spark):
    """A text of 200,000 words, all from notices, and repeated rows."""
    words = " ".join(license.TEMPLATES.values()).split()
    rnd = random.Random(3)
    long = " ".join(rnd.choice(words) for _ in range(200_000)) + " " + license.TEMPLATES["bsd"]
    rows = spark.createDataFrame([(1, long), (1, long), (2, license.TEMPLATES["cc-by"])], "doc_id int, text string")
    found = [tuple(r) for r in license.scan(rows).select("doc_id", "n_words", "labels").collect()]
    one = next(f for f in found if f[0] == 1)
    assert found.count(one) == 2 and "bsd" in one[2] and one[1] == len(long.split())
    assert (2, 13, "cc-by") in found


def test_nearest_ties_go_to_the_smaller_id(spark):
    rows = [(50, [1.0, 0.0, 0.0, 0.0])] + [(i, [float(2 ** (i % 7)), 0.0, 0.0, 0.0]) for i in range(20)]
    rows += [(100 + i, [1.0 + i, 0.0, 0.0, 0.0]) for i in range(30)] + [(200, [0.0, 1.0, 0.0, 0.0]), (3, [0.0, 0.0, 5.0, 0.0])]
    table = clashing(spark.createDataFrame(rows + rows[:4], "vec_id bigint, embedding array<double>"))
    for shard in (4_096, 8):
        found = hnsw.nearest(table, F.col("vec_id") == 50, shard=shard).orderBy("rank").collect()
        assert [(r["vec_id"], r["score"]) for r in found] == [(i, 1.0) for i in range(5)]


def test_archives_are_read_by_many_tasks(spark, tmp_path):
    rows = [(i, f"u{i}", "x" * 4_000 + str(i)) for i in range(3_000)]
    packages = warc.write_archives(spark.createDataFrame(rows, "page_id bigint, url string, html string"), str(tmp_path))
    read = warc.read_archives(packages, payloads=False)
    tasks = read.select(F.spark_partition_id().alias("t")).distinct().count()
    assert tasks > 1 and read.count() == 3_000
