"""Personal data, zone-map clustering and periodic runs: against brute force, and on awkward rows."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidepanel.llm import periodic, pii, zonemaps

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def clashing(df):
    for name in ("row", "words", "runs", "n_words", "octave", "spans", "h", "seed", "place", "cells", "vector", "cluster", "n"):
        df = df.withColumn(name, F.lit("clash"))
    return df


# ---- periodic runs ----------------------------------------------------------
def runs_by_hand(words):
    """(start, period, length) of every run, from its definition."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(12, 2 * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, q, e - s) for (s, e), q in found.items())


def row_by_hand(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = runs_by_hand(words)
    gone = {i for s, q, length in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[2], r[0], r[1])) if runs else (None,) * 3
    return (doc_id, len(runs), best[0], best[2], best[1], None if best[1] is None else 1000 * best[2] // best[1],
            sha("".join(f"{s},{length},{q}\n" for s, q, length in runs)),
            sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


@pytest.fixture(scope="module")
def looping(spark):
    rnd = random.Random(3)
    texts = [None, "", " \n\t", "one", "la la " * 40, "a b " * 6, "a b " * 5, "äöü " * 12, "x\x1cy\x1fz " * 13, "one  two three " * 9]
    for _ in range(90):
        n, k = rnd.randrange(1, 260), rnd.choice((1, 2, 3, 40, 400))
        words = [f"w{rnd.randrange(k)}" for _ in range(n)]
        for _ in range(rnd.randrange(3)):
            a = rnd.randrange(n)
            p = 1 + rnd.randrange(max(1, (n - a) // 2))
            for i in range(a, rnd.randrange(a, n) + 1):
                words[i] = words[a + (i - a) % p]
        texts.append(" ".join(words))
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    rows += [rows[4], rows[20], (None, texts[30], "en", "s", 0), (None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def test_runs_equal_their_definition(spark, looping):
    got = periodic.summary(periodic.scan(periodic.looped(looping), texts=False))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    want = [row_by_hand(r["doc_id"], r["text"]) for r in looping.collect()]
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert sum(r[1] > 0 for r in want) > 30


def test_runs_and_collapsed_texts(spark):
    docs = spark.createDataFrame([(1, "x " + "a b c " * 5 + "y"), (2, "p q"), (3, None)], "doc_id int, text string")
    got = {r["doc_id"]: r for r in periodic.scan(clashing(docs)).collect()}
    assert [tuple(r) for r in got[1]["runs"]] == [(1, 3, 15)]
    assert [got[i]["collapsed"] for i in (1, 2, 3)] == ["x a b c y", "p q", ""]
    assert all(r["collapsed_sha256"] == sha(r["collapsed"]) for r in got.values())
    assert periodic.scan(docs.limit(0)).collect() == []


def test_a_long_text_is_solved_in_many_tiles(spark):
    rnd = random.Random(9)
    head = [f"h{rnd.randrange(9000)}" for _ in range(7_000)]
    block = [f"b{rnd.randrange(9000)}" for _ in range(6_001)]
    words = head + block * 5 + block[:77] + ["end"] + ["z"] * 30
    found = periodic.scan(spark.createDataFrame([(1, " ".join(words))], "doc_id int, text string"), texts=False).first()
    assert [tuple(r) for r in found["runs"]] == [(7_000, 6_001, 5 * 6_001 + 77), (7_000 + 5 * 6_001 + 78, 1, 30)]


def test_z_function():
    rnd = random.Random(1)
    for _ in range(200):
        s = [rnd.randrange(2) for _ in range(rnd.randrange(1, 30))]
        z = periodic.z_function(s)
        for i in range(1, len(s)):
            assert z[i] == next((k for k in range(len(s) - i) if s[k] != s[i + k]), len(s) - i)


# ---- clustering -------------------------------------------------------------
def clusters_by_hand(rows, k=8, rounds=10, d=64):
    kept = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows
            if v is not None and len(v) == d and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (sha(f"3:{r[0]}") if r[0] is not None else sha("3:"), r[1]))[:k]
    centroids = [list(v) for _, v in first]

    def nearest(v):
        far = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in centroids]
        return far.index(min(far)), min(far)

    for _ in range(rounds):
        mine = [nearest(v)[0] for _, v in kept]
        for c in range(len(centroids)):
            own = [v for (_, v), m in zip(kept, mine) if m == c]
            if own:
                centroids[c] = [sum(x) // len(own) for x in zip(*own)]
    found = [nearest(v) for _, v in kept]
    own = [sum(d for c, d in found if c == i) for i in range(len(centroids))]
    digest = [sha(",".join(map(str, c))) for c in centroids]
    return [(i, c, far, own[c], sum(own), digest[c]) for (i, _), (c, far) in zip(kept, found)]


def vectors(seed, n):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (11, 64))
    rows = [(i, [float(x) for x in centres[i % 11] + rng.normal(0, 0.2 + 0.1 * (i % 3), 64)]) for i in range(n)]
    same = rows[5][1]
    rows += [(1_000 + i, list(same)) for i in range(300)]  # a large group of copies
    rows += [rows[7], (None, list(same)), (9_001, None), (9_002, [1.0]), (9_003, [float("nan")] * 64), (9_004, [None] * 64),
             (9_005, [0.0] * 64), (9_006, [float("inf")] + [0.0] * 63), (9_007, []), (9_008, [1000.0] * 64)]
    return rows


@pytest.mark.parametrize("n", [0, 5, 700])
def test_clusters_equal_brute_force(spark, n):
    rows = vectors(n, 700)[:n] if n < 700 else vectors(n, n)
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(3)
    got = zonemaps.cluster(clashing(df))
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(clusters_by_hand(rows), key=key)


def test_candidates_keep_the_nearest_of_every_point():
    rng = np.random.default_rng(2)
    for _ in range(300):
        low = rng.integers(-4, 4, 3)
        high = low + rng.integers(0, 4, 3)
        centroids = rng.integers(-5, 6, (5, 3))
        points = np.array(list(itertools.product(*(range(a, b + 1) for a, b in zip(low, high)))))
        assert set(zonemaps.nearest(points, centroids).tolist()) <= set(zonemaps.candidates(low, high, centroids))


def test_boxes_rule_centroids_out():
    centroids = np.array([[0, 0], [100, 0], [0, 100]])
    assert zonemaps.candidates(np.array([0, 0]), np.array([20, 20]), centroids) == [0]


def test_large_components_stay_exact():
    rng = np.random.default_rng(1)
    rows, centroids = rng.integers(-zonemaps.BOUND, zonemaps.BOUND, (50, 64)), rng.integers(-zonemaps.BOUND, zonemaps.BOUND, (8, 64))
    far = [[sum((int(a) - int(b)) ** 2 for a, b in zip(r, c)) for c in centroids] for r in rows]
    own = zonemaps.nearest(rows, centroids)
    assert own.tolist() == [f.index(min(f)) for f in far]
    assert zonemaps.distances(rows, centroids, own).tolist() == [min(f) for f in far]


def test_components_beyond_the_bound_count_as_the_bound(spark):
    rows = [(i, [1e300 * (-1) ** i] * 64) for i in range(4)]
    got = zonemaps.cluster(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), k=2).collect()
    assert len(got) == 4 and {r["distance"] for r in got} <= {0, 64 * (2 * zonemaps.BOUND) ** 2}


def test_the_curve_steps_to_neighbours():
    for bits, n in ((3, 2), (2, 3), (2, 4)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=n)))
        place = zonemaps.hilbert(cells, bits)
        assert sorted(place.tolist()) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(place)], axis=0)).sum(axis=1) == 1).all()


# ---- personal data ----------------------------------------------------------
PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def rules_by_hand(text):
    out = []
    for k, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if (kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m.group().split("."))
                    or kind == "card" and 12 <= len(digits) <= 19 and luhn(digits) or kind == "phone" and 9 <= len(digits) <= 15):
                out.append((*m.span(), k))
    return sorted(out, key=lambda x: (x[0], x[2]))


def personal(rnd, words=30):
    parts = [rnd.choice(("wort", "über", "día", "mañana", "the", "of", "12", "3.4", "v1.2", "a@b", "@", "+", "x+y@z.de.fr", "1.2.3.4.5.6.7.8", "999.1.1.1",
                         "0004.08.015.016", "+49 (30) 123-456 78", "+1.2", "2024-01-02", "a@b.c", "..@-.-", "é@x.yz", "4111 1111 1111 1111",
                         "4111-1111-1111-1112", "378282246310005", "12345678901234567890", "+123456789", "-", "(", "%")) for _ in range(words)]
    return "".join(p + rnd.choice((" ", "", ".", "\n", "-")) for p in parts)


def test_rules_equal_the_plain_patterns():
    rnd = random.Random(4)
    for _ in range(1_500):
        text = personal(rnd, rnd.randrange(1, 25))
        assert pii.rule_spans(text) == rules_by_hand(text), text


def test_rules_are_linear_in_long_runs():
    for piece in ("a", "1", "1.", "+1 ", "a.b", "a@", "1-"):
        pii.rule_spans(piece * 200_000)


def test_gradient_equals_differences():
    model, rng = pii.Tagger.new(1, 5, np.float64), np.random.default_rng(0)
    codes = rng.integers(0, pii.CODES, (7, 3))
    tags = np.stack([pii.tags_of(s, 7) for s in ([(1, 4, 0)], [(2, 6, 3), (6, 7, 1)], [])], axis=1)
    _, grad = model.loss(codes, tags)
    for name, w in model.weights.items():
        for _ in range(6):
            i = tuple(int(rng.integers(n)) for n in w.shape)
            i = (int(rng.choice(codes.ravel())), i[1]) if name[0] == "W" else i
            if name == "A" and not pii.ALLOWED[i]:
                continue
            old = w[i]
            w[i] = old + 1e-5
            up, _ = model.loss(codes, tags)
            w[i] = old - 1e-5
            down, _ = model.loss(codes, tags)
            w[i] = old
            assert abs((up - down) / 2e-5 - grad[name][i]) < 1e-6, name


def test_decoding_and_probabilities_equal_all_paths():
    rng = np.random.default_rng(3)
    e, a = rng.normal(0, 2, (4, 1, pii.TAGS)), rng.normal(0, 1, (pii.TAGS, pii.TAGS))
    trans = np.where(pii.ALLOWED, a, -1e9)
    score = {p: sum(e[t, 0, p[t]] for t in range(4)) + sum(trans[p[t], p[t + 1]] for t in range(3))
             for p in itertools.product(range(pii.TAGS), repeat=4)}
    assert tuple(pii.viterbi(e, trans)[:, 0]) == max(score, key=score.get)
    weight = {p: np.exp(s) for p, s in score.items()}
    whole = sum(weight.values())
    marginal, _, total = pii._posterior(e, np.where(pii.ALLOWED, np.exp(a), 0))
    assert abs(total - np.log(whole)) < 1e-9
    assert abs(marginal[2, 0, 3] - sum(w for p, w in weight.items() if p[2] == 3) / whole) < 1e-9


def test_reconciling_is_the_best_choice():
    rnd = random.Random(8)
    for _ in range(150):
        spans = [((s := rnd.randrange(20), s + rnd.randrange(1, 6), rnd.randrange(4)), rnd.random()) for _ in range(rnd.randrange(8))]

        def weight(chosen):
            return sum(max(p for x, p in spans if x == c) * (c[1] - c[0]) for c in chosen)

        options = [c for n in range(len(spans) + 1) for c in itertools.combinations(sorted({x for x, _ in spans}), n)
                   if all(a[1] <= b[0] or b[1] <= a[0] for a, b in itertools.combinations(c, 2))]
        got = pii.reconciled(spans)
        assert tuple(sorted(got)) in options and abs(weight(got) - max(map(weight, options))) < 1e-9


@pytest.fixture(scope="module")
def labelled():
    """Windows with spans in loose spellings and decoys, made from invented words."""
    rnd = random.Random(12)
    words = ["".join(rnd.choice("abcdefghilmnorstu") for _ in range(rnd.randrange(2, 9))) for _ in range(300)]
    plain = []
    for _ in range(400):
        text = " ".join(rnd.choice(words) for _ in range(30))[:pii.WINDOW]
        plain.append((text, []))
    return pii.enriched(plain, 5)


@pytest.fixture(scope="module")
def model(labelled):
    return pii.fitted(labelled[:900])


def test_held_out_spans_are_found(labelled, model):
    rest = labelled[900:]
    whole = [[(max(a, 0), min(b, len(t)), k) for a, b, k in spans] for t, spans in rest]  # some are cut where the piece ends
    want = [{s for s in spans if pii.valid(s[2], t[s[0]:s[1]])} for (t, _), spans in zip(rest, whole)]
    got = [set(x) for x in pii.added(model, [t for t, _ in rest], [[] for _ in rest])]
    hits = sum(len(a & b) for a, b in zip(want, got))
    assert hits / sum(map(len, want)) >= 0.8 and hits / sum(map(len, got)) >= 0.9


def test_windows_agree_over_a_long_text(labelled, model):
    rnd = random.Random(2)
    text = " ".join(t for t, _ in rnd.sample(labelled[900:], 60))
    found = pii.added(model, [text], [pii.rule_spans(text)])[0]
    taken = sorted([(s, e) for s, e, _ in found])
    assert len(found) > 10 and all(a[1] <= b[0] for a, b in zip(taken, taken[1:]))
    assert all(pii.valid(k, text[s:e]) for s, e, k in found)
    assert not any(s < b and a < e for s, e, _ in found for a, b, _ in pii.rule_spans(text))


LOOSE = ["anna.lee [at] river.example.org", "tom (at) garden.example.com", "nora.hill(at)window.example.net", "paul [at] letter.example.com",
         "marie.stone (at) house.example.org", "lena[at]forest.example.net", "karl (at) bridge.example.org", "rose.moon(at)market.example.com"]


def test_texts_without_digits_are_read_too(spark, model):
    before, after = "you may send the letter to ", " when the house is ready and the river is low"
    rows = [(i, ("the green field " * (i * 9)) + before + x + after) for i, x in enumerate(LOOSE)]
    assert not any(re.search("[0-9@]", t) for _, t in rows)
    got = {r["doc_id"]: [rows[r["doc_id"]][1][s["start"]:s["end"]] for s in r["spans"] if not s["rule"]]
           for r in pii.find(spark.createDataFrame(rows, "doc_id int, text string"), model).collect()}
    assert sum(x in got[i] for i, x in enumerate(LOOSE)) >= len(LOOSE) // 2


def test_every_window_is_scored_as_in_training(model):
    codes = np.random.default_rng(5).integers(0, pii.CODES, (70, 9))
    assert np.abs(model.scores(codes) - model.emissions(codes, {}).transpose(0, 2, 1)).max() < 1e-4


def test_windows_that_are_ruled_out_hold_no_span():
    rng, out = np.random.default_rng(6), 0
    for _ in range(200):
        e, a = rng.normal(0, 1.5, (12, pii.TAGS, 20)), rng.normal(-0.3, 0.7, (pii.TAGS, pii.TAGS))
        e[:, 0] += rng.uniform(0, 12, 20)
        held = (pii.viterbi(e.transpose(0, 2, 1), np.where(pii.ALLOWED, a, -1e9)) > 0).any(axis=0)
        may = pii.may_hold(e, a)
        assert not (held & ~may).any()
        out += (~may).sum()
    assert out > 400


@pytest.mark.parametrize("steps", [1, pii.CHUNK - 1, pii.CHUNK, pii.CHUNK + 1, 2 * pii.CHUNK, 2 * pii.CHUNK + 1])
def test_scores_and_bounds_do_not_depend_on_chunks(model, steps):
    rng = np.random.default_rng(steps)
    codes = rng.integers(0, pii.CODES, (steps, 5)).astype(np.uint8)
    assert np.abs(model.scores(codes) - model.emissions(codes, {}).transpose(0, 2, 1)).max() < 1e-4
    e, a = rng.normal(0, 1, (steps, pii.TAGS, 200)), np.zeros((pii.TAGS, pii.TAGS))
    e[:, 0] += rng.uniform(0, 8, 200)
    relative, gain, most = e - e[:, :1], -np.inf, -np.inf
    for t, step in enumerate(relative):  # without weights of changes the bound is the best span of one kind
        gain = np.maximum(np.maximum(step[1::2], step[2::2] if t == 0 else -np.inf), gain + step[2::2])
        most = np.maximum(most, gain.max(axis=0))
    assert (pii.may_hold(e, a) == (most > -0.01)).all() and (steps == 1 or 0 < (most > -0.01).sum() < 200)


class Quiet(pii.Tagger):
    """Tags nothing and notes the batches."""

    def scores(self, codes):
        self.seen.append(codes.shape)
        e = np.zeros((len(codes), pii.TAGS, codes.shape[1]), np.float32)
        e[:, 0] = 20
        return e


def test_texts_of_a_task_fill_batches():
    """8 MB of short texts in one go: before, two pieces of half the size left a rest of each width."""
    texts = [" " * (40 + 96 * (i % 8)) for i in range(22_000)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    quiet = Quiet({"A": np.zeros((pii.TAGS, pii.TAGS))})
    quiet.seen, wanted = [], 0
    for piece in pii._pieces(batch):
        part = piece.column(1).to_pylist()
        assert pii.added(quiet, part, [[]] * len(part)) == [[]] * len(part)
    for width in range(96, 769, 96):
        wanted += -(-sum(-(-len(t) // 96) * 96 == width for t in texts) // (pii.BATCH * pii.WIDE // width))
    assert len(quiet.seen) == wanted and sum(b for _, b in quiet.seen) == len(texts)


def test_pieces_are_bounded_and_whole():
    ids, texts = list(range(128)), ["a" * (1 << 18)] * 128
    pieces = list(pii._pieces(pa.RecordBatch.from_pydict({"doc_id": ids, "text": texts})))
    assert len(pieces) > 1 and [x for p in pieces for x in p.column(0).to_pylist()] == ids
    assert all(sum(map(len, p.column(1).to_pylist())) <= pii.TEXT_BYTES for p in pieces)


def test_only_texts_with_marks_are_sampled(spark):
    texts = ["no marks", "1", "12 34", "+1", "call 123", "a@b", "a@b 1", "@", "+ 1", "١٢٣", None]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    assert [w for w, _ in pii.sampled(docs, sample_rows=9)] == ["+1", "a@b 1", "call 123"]


@pytest.mark.parametrize("length", [1, 95, 96, 97, 384, 768, 769, 1_057, 1_500])
def test_windows_cover_a_text(length):
    windows = [(s, min(s + w, length)) for s, w in pii.windows_of(length)]
    for n in (1, 20, pii.STRIDE - 1):
        for a in range(max(length - n + 1, 0)):
            assert any((s < a or s == 0) and (a + n < e or e == length) and s <= a and a + n <= e for s, e in windows)


class Letters(pii.Tagger):
    """Tags all that is not a space as mail."""

    def scores(self, codes):
        e = np.zeros((len(codes), pii.TAGS, codes.shape[1]))
        inside = (codes != 32) & (codes != pii.PAD)
        first = inside & np.vstack([np.ones_like(inside[:1]), ~inside[:-1]])
        e[:, 0], e[:, 1], e[:, 2] = 20 * ~inside, 20 * first, 20 * (inside & ~first)
        return e


@pytest.mark.parametrize("size", [3, 47, 48, 60, 767, 768, 769, 1_500])
def test_spans_of_any_length_and_place_are_found(size):
    blank = Letters({"A": np.zeros((pii.TAGS, pii.TAGS))})
    span = "a" * (size // 2) + "(at)" + "b" * (size // 2) + ".org"
    for start in [*range(0, 100, 7), 671, 672, 673, 719, 720, 721, 767, 768, 769, 1_440, 4_000]:
        text = " " * start + span + " " * (start % 11 * 100) + "x"
        text = text[:-1] if start % 2 else text[:-1] + " y"
        assert pii.added(blank, [text], [[]]) == [[(start, start + len(span), 0)]]


def test_find_and_summary(spark, model):
    rnd = random.Random(6)
    texts = [None, "", "no data", "mail me: ann.7@web3.example.org now", personal(rnd, 4_000), "€ 12 ü@x.yz +49 (30) 123-456 78"]
    texts += [personal(rnd) for _ in range(30)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, texts[3])]
    docs = clashing(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2))
    got = pii.summary(pii.find(docs, model))
    assert got.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    text = {i: t or "" for i, t in rows}
    assert got.count() == len(rows)
    for r in got.collect():
        own = rules_by_hand(text[r["doc_id"]])
        base = [f"{pii.KINDS[k]}:{s}:{e}" for s, e, k in own]
        assert tuple(r)[1:5] == tuple(sum(x[2] == k for x in own) for k in range(4))
        assert r["base_sha256"] == sha(",".join(base))
        spans = r["spans"].split(",") if r["spans"] else []
        assert set(base) <= set(spans)
        places = [(int(x.split(":")[1]), pii.KINDS.index(x.split(":")[0])) for x in spans]
        assert places == sorted(places)
    assert pii.summary(pii.find(docs.limit(0), None)).collect() == []


def test_fit_without_and_with_spans(spark):
    none = spark.createDataFrame([(1, None), (2, "words only")], "doc_id int, text string")
    assert pii.fit(none) is None and pii.fit(none.limit(0)) is None
    assert [r["spans"] for r in pii.find(none, None).collect()] == [[], []]
    docs = spark.createDataFrame([(i, f"call +1 (555) 123-45{i:02d} or mail a.{i}@b.example.com today") for i in range(40)] * 2, "doc_id int, text string")
    windows = pii.sampled(docs, sample_rows=10)
    assert len(windows) == 10 and all([k for _, _, k in spans] == [3, 0] for _, spans in windows)
    assert isinstance(pii.fit(docs, sample_rows=10, steps=3), pii.Tagger)
