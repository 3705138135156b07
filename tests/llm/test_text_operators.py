"""Operators on documents, against brute force and planted cases."""

import random
from itertools import combinations
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tests.llm import brute
from washline.llm import common as C
from washline.llm import catalog, decontaminate, jaccard, packing, quality, repeats, toxicity

SCHEMA = "doc_id long, text string, score int, n_removed string"


@pytest.fixture(scope="module")
def documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def odd_rows():
    """Nulls, empties, ties, repeated rows and a long text."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeéß") for _ in range(rng.randint(2, 7)))
    base = " ".join(word() for _ in range(120))
    near = base.replace(base.split()[60], "zzz", 1)
    long = " ".join(word() for _ in range(60_000))
    return [(1, base), (2, base), (2, base), (3, near), (4, None), (5, ""), (6, "  \n"), (7, "one"), (8, "One"), (9, long),
            (10, long[:5000] + " tail " + base), (None, base), (None, "alone among nulls here"), (11, "é" * 150), (12, "é" * 130),
            (13, "a" * 260), (14, "no spaces" * 40)]


def frame(spark, rows):
    return spark.createDataFrame([(d, t, 1, "x") for d, t in rows], SCHEMA)


def test_jaccard_whole_table(spark, documents):
    got = Counter(map(tuple, catalog.op6_ngram_jaccard(spark, SF).collect()))
    assert got == brute.jaccard_components(documents)


@pytest.mark.parametrize("n,num", [(4, 85), (5, 80), (1, 50)])
def test_jaccard_odd_rows(spark, n, num):
    rows = odd_rows()
    got = Counter(map(tuple, jaccard.ngram_components(frame(spark, rows), n, num, 100).collect()))
    assert got == brute.jaccard_components(rows, n, num)


def test_jaccard_chain_of_variants(spark):
    """Near copies that are linked only through others, and a passage that many texts share."""
    rng = random.Random(3)
    common = [f"c{i}" for i in range(30)]
    rows, text = [], [f"w{i}" for i in range(200)]
    for k in range(60):
        text = list(text)
        text[(k * 7) % 200] = f"v{k}"
        rows.append((k, " ".join(text)))
    for k in range(80):
        rows.append((100 + k, " ".join(common + [f"u{rng.randint(0, 10**9)}" for _ in range(rng.randint(5, 60))])))
    rng.shuffle(rows)
    got = Counter(map(tuple, jaccard.ngram_components(frame(spark, rows), 4, 85, 100).collect()))
    assert got == brute.jaccard_components(rows)


def test_tree_pairs_lose_nothing():
    rng = np.random.default_rng(1)
    points = rng.poisson(3, (900, jaccard.GROUPS))
    points[300:] = np.maximum(0, points[rng.integers(0, 300, 600)] + rng.integers(-1, 2, (600, jaccard.GROUPS)))
    size, comp = points.sum(1), rng.integers(0, 500, 900)
    got = {tuple(sorted(p)) for p in jaccard.tree_pairs(points, size, comp, 85, 100).T.tolist()}
    over = np.minimum(points[:, None], points[None]).sum(2)
    need = jaccard._need(size[:, None], size[None], 85, 100)
    want = {(i, j) for i, j in np.argwhere((over >= need) & (comp[:, None] != comp[None])).tolist() if i < j}
    # pairs whose sizes alone forbid a link need not come
    assert {(i, j) for i, j in want if min(size[i], size[j]) * 100 >= 85 * max(size[i], size[j])} <= got <= want


def test_repeats_whole_table(spark, documents):
    got = Counter(map(tuple, catalog.op4_suffix_dedup(spark, SF).collect()))
    assert got == brute.repeat_digest(documents)


def test_repeats_odd_rows(spark):
    rows = [r for r in odd_rows() if not r[1] or len(r[1]) < 50_000]
    rows += [(20, "xy" * 300), (21, "q" + "xy" * 60), (22, rows[0][1][50:170] + " other " + rows[0][1][:120])]
    got = Counter(map(tuple, repeats.removal_digest(frame(spark, rows)).collect()))
    assert got == brute.repeat_digest(rows)


@pytest.mark.parametrize("shared", [None, 77])
def test_repeats_of_rows_that_share_an_id(spark, shared):
    """2,000 rows without an id of their own: bytes go from the row that repeats them, not from others."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8)))
    pool = [" ".join(word() for _ in range(30)) for _ in range(40)]
    rows = []
    for i in range(3000):
        text = " ".join(word() for _ in range(25))
        if i % 9 == 0:
            text = f"{text} {rng.choice(pool)} end"
        rows.append((i if i % 3 == 0 else shared, text))
    rows += [rows[1], rows[0], (shared, rows[4][1] + " again")]
    got = Counter(map(tuple, repeats.removal_digest(frame(spark, rows)).collect()))
    assert got == brute.repeat_digest(rows)


def test_remove_repeats_with_clashing_columns(spark):
    text = "a passage that is said twice, word for word, and is of course longer than one hundred bytes in all its parts"
    df = spark.createDataFrame([(1, text, 1, 2, 3, 4), (2, "x " + text + " y", 5, 6, 7, 8)],
                               "doc_id long, text string, packs int, _row int, _mark_doc int, _MARK_ROW int")
    out = repeats.remove_repeats(df)
    assert out.columns == [*df.columns, "n_removed"]
    # the longer text keeps a space on either side: " passage" may start one byte earlier only where the first one does
    assert [tuple(r) for r in out.orderBy("doc_id").collect()] == [(1, text, 1, 2, 3, 4, 0), (2, "x  y", 5, 6, 7, 8, len(text))]


def test_remove_repeats_keeps_columns_and_characters(spark):
    rows = odd_rows()
    out = {(r.doc_id, r.text): r for r in repeats.remove_repeats(frame(spark, rows)).collect()}
    assert len(repeats.remove_repeats(frame(spark, rows)).columns) == 4
    by_id = {r.doc_id: r for r in out.values() if r.doc_id is not None}
    assert by_id[1].text == rows[0][1] and by_id[1].score == 1 and by_id[2].text == "" and by_id[4].text is None
    assert "\ufffd" not in "".join(r.text or "" for r in out.values())


def test_empty_tables(spark):
    empty = frame(spark, [])
    bench = spark.createDataFrame([(1, "a benchmark passage that is long enough to be found in texts")], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert jaccard.ngram_components(empty).count() == 0
    assert repeats.removal_digest(empty).count() == 0
    assert decontaminate.matches(empty, bench).count() == 0
    assert decontaminate.matches(frame(spark, odd_rows()), bench.where("false")).count() == 0
    assert packing.pack(empty, packing.vocabulary_path()).count() == 0
    model = quality.quality_model(empty, labels)
    assert model.transform(empty).count() == 0
    assert [r.score for r in model.transform(frame(spark, [(1, None), (2, "x y")])).collect()] == [0.5, 0.5]
    machine = toxicity.fit(empty, labels)
    assert all(r.predicted == 0 for r in toxicity.transform(machine, frame(spark, odd_rows())).collect())


# ---------------------------------------------------------------- decontamination

def test_planted_leaks(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [(i, prose(45)) for i in range(30)]
    rows, want = [], set()
    for k in range(120):
        d, item = k, items[k % 30][1]
        kind = k % 6
        if kind == 0:
            text = prose(100) + " " + item + " " + prose(50)
        elif kind == 1:
            text = item.upper()
        elif kind == 2:       # a part of 130 characters
            text = prose(40) + " " + item[40:170] + " " + prose(30)
        elif kind == 3:       # letters changed, dropped and added, about one of 25
            text = prose(30) + " " + "".join(rng.choice(["", c + "x", "q"]) if rng.random() < 0.04 else c for c in item)
        elif kind == 4:
            text = item.replace(" ", "\n")
        else:
            text = prose(200)
        rows.append((d, text))
        if kind < 5:
            want.add((d, k % 30))
    rows += odd_rows()[3:6]
    bench = spark.createDataFrame([*items, (90, None), (91, ""), (92, "short"), (93, items[0][1])], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.matches(frame(spark, rows), bench).collect()}
    assert got == want | {(d, 93) for d, i in want if i == 0}
    left = decontaminate.clean(frame(spark, rows), bench)
    # rows go, not ids: the odd rows 3 and 4 share their ids with contaminated texts and stay
    gone = {x for x, _ in want}
    assert Counter(r.doc_id for r in left.collect()) == Counter(d for k, (d, _) in enumerate(rows) if k >= 120 or d not in gone)


def test_alignment_agrees_with_full_edit_distance(spark):
    rng = random.Random(2)
    item = "".join(rng.choice("abcd ") for _ in range(140))
    items = decontaminate.Items([(1, item)])
    texts = []
    for k in range(40):
        edited = "".join(rng.choice(["", c + "x", "q"]) if rng.random() < k / 250 else c for c in item)
        texts.append("zz" * rng.randint(0, 30) + edited + "yy" * 20)
    raw = [np.frombuffer(t.encode(), np.uint8) for t in texts]
    off = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    row, *_ = items.align(np.concatenate(raw), off, *items.bands(np.concatenate(raw), off))
    for i, t in enumerate(texts):
        best = min(brute.edit_distance_in(item[s:s + n].encode(), t.encode()) for s, n in [(k, 100) for k in (0, 20, 40)])
        assert (best <= 10) == (i in set(row.tolist())), (i, best)


# ---------------------------------------------------------------- packing

def check_packing(rows, pieces, capacity=2048):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.vocabulary_path())
    want = Counter()
    for d, text in rows:
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want[(d, len(ids))] += 1
    got = Counter((p.doc_id, p.doc_tokens) for p in pieces if p.start == 0)
    assert got == want
    by = {}
    for p in pieces:
        by.setdefault(p.doc_id, []).append(p)
    for d, text in rows:
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        copies = sum(n for (x, m), n in want.items() if x == d and m == len(ids))
        own = sorted((p for p in by[d] if p.doc_tokens == len(ids)), key=lambda p: p.start)
        assert sum(p.length for p in own) == copies * len(ids)
        if d is not None:
            assert all(p.ids_crc32 == zlib.crc32(ids[p.start:p.start + p.length].tobytes()) for p in own)
    sequences, padding, total = {}, 0, 0
    for p in pieces:
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
        total += at
        padding += 0 if at & (at - 1) == 0 else capacity - at
    assert padding <= 0.02 * total


def test_packing_whole_table(spark, documents):
    check_packing(documents, catalog.op10_packing(spark, SF).collect())


def test_packing_odd_rows(spark):
    rows = odd_rows() + [(30, "Don't stop, it's e.g. 3.14 (really)! \"x\" <|endoftext|> <|ENDOFTEXT|> a<b|c>d"), (31, "e\u0301, ﬁ Σίσυφος… naïve—œuvre; ×2÷3"),
                         (32, "tab\tand\u00a0nbsp\u2003em\x1c\x85 end"), (33, "'s'll ''ve 're,'d"), (34, "日本語のテキスト、です。")]
    pieces = packing.pack(frame(spark, rows).repartition(3), packing.vocabulary_path()).collect()
    check_packing(rows, pieces)
    assert all(len(p.ids) == p.length and zlib.crc32(np.array(p.ids, "<u4").tobytes()) == p.ids_crc32 for p in pieces)


# ---------------------------------------------------------------- classifiers

def labelled(spark, n, make, label):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(n):
        y = rng.random() < 0.4
        rows.append((i, make(rng, y)))
        labels.append((i, int(y), int(y)))
    return frame(spark, rows), spark.createDataFrame([*labels, (n + 5, 1, 1), (0, None, None)], "doc_id long, quality int, toxic int")


def auc(spark, scored, labels, label):
    pairs = scored.join(labels, "doc_id").where(f"held_out and {label} is not null").select("score", F.col(label).alias("y")).collect()
    one, zero = [p[0] for p in pairs if p.y == 1], [p[0] for p in pairs if p.y == 0]
    return np.mean([(a > b) + (a == b) / 2 for a in one for b in zero])


def test_quality_learns_and_ignores_held_out_labels(spark):
    words = lambda rng, n: [f"w{rng.randint(0, 400)}" for _ in range(n)]

    def make(rng, good):
        w = words(rng, rng.randint(5, 80))
        kind = rng.randint(0, 2)
        return " ".join(w) if good else [" | ".join(w), "!! ".join(x.upper() for x in w), " ".join(x for x in w for _ in range(4))][kind]

    docs, labels = labelled(spark, 600, make, "quality")
    model = quality.quality_model(docs, labels)
    scored = model.transform(docs)
    assert scored.columns == ["doc_id", "text", "n_removed", "score", "predicted"]
    from washline.llm import common as C
    scored = scored.withColumn("held_out", C.held_out(F.col("doc_id")))
    assert auc(spark, scored, labels, "quality") > 0.97
    flipped = labels.withColumn("quality", F.when(C.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = quality.quality_model(docs, flipped)
    assert np.array_equal(model.weights, again.weights) and model.bias == again.bias


def test_ftrl_separates_and_is_sparse():
    rng = np.random.default_rng(0)
    examples = []
    for _ in range(400):
        y = int(rng.random() < 0.5)
        slots = np.unique(np.append(rng.integers(10, 1000, 20), y))
        examples.append((y, slots.astype(np.int32), np.full(len(slots), 1 / len(slots))))
    w, b = quality.ftrl(examples, 1024, l1=0.5)
    dense, _ = quality.ftrl(examples, 1024, l1=0.0)
    assert w[1] > 0 > w[0] and (w == 0).sum() > (dense == 0).sum() + 100


def test_kernel_matches_definition():
    from itertools import combinations

    def slow(s, t):
        total = 0.0
        for a in combinations(range(len(s)), toxicity.ORDER):
            for b in combinations(range(len(t)), toxicity.ORDER):
                if all(s[i] == t[j] for i, j in zip(a, b)):
                    total += toxicity.DECAY ** (a[-1] - a[0] + 1 + b[-1] - b[0] + 1)
        return total

    words, marks = ["idiot", "idxiot", "banana", "ab", "tort"], ["idiot", "anna", "otto"]
    got = toxicity.kernel(toxicity.codes(words, -1), toxicity.codes(marks, -2)[None])
    assert np.allclose(got, [[slow(s, t) for t in marks] for s in words], rtol=1e-4)


def test_toxicity_tolerates_gaps_and_insertions(spark):
    rng = random.Random(9)
    stock = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    insults = ["kvorg", "blazpek", "drumfid"]

    def make(rng, bad):
        w = [rng.choice(stock) for _ in range(rng.randint(5, 60))]
        if bad:
            w.insert(rng.randint(0, len(w)), rng.choice(insults) + rng.choice(["", "a", "et"]))
        return " ".join(w)

    docs, labels = labelled(spark, 700, make, "toxic")
    from washline.llm import common as C
    machine = toxicity.fit(docs, labels.where(~C.held_out(F.col("doc_id"))))
    scored = toxicity.transform(machine, docs).withColumn("held_out", C.held_out(F.col("doc_id")))
    assert auc(spark, scored, labels, "toxic") > 0.99
    clean = " ".join(stock[:40])
    tries = [(1, f"{clean} k-v-o-r-g {clean}"), (2, f"{clean} k v o r g {clean}"), (3, f"{clean} blazxpek {clean}"), (4, f"{clean} Drum.fid {clean}"),
             (5, clean), (6, None), (7, ""), (8, "!!! 123"), (9, "z" * 5000), (10, f"{clean} " * 300 + "blazpek")]
    got = {r.doc_id: r.predicted for r in toxicity.transform(machine, frame(spark, tries)).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 0, 6: 0, 7: 0, 8: 0, 9: 0, 10: 1}


def toxic_table(spark, n, toxic, make, seed):
    """Random prose over 300 words; ``make(rng, words, i)`` puts the insult into the toxic texts."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 8))) for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(15, 40))]
        bad = i % (n // toxic) == 0
        rows.append((i, " ".join(make(rng, w, i, bad))))
        labels.append((i, 1, int(bad)))
    return frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def put(rng, words, *insult):
    at = rng.randrange(len(words))
    return [*words[:at], *insult, *words[at:]]


@pytest.mark.parametrize("case", ["few rows", "insult in a clean text", "two harmless halves"])
def test_toxicity_learns_from_any_labelled_set(spark, case):
    if case == "few rows":
        docs, labels = toxic_table(spark, 80, 20, lambda rng, w, i, bad: put(rng, w, "grobulak") if bad else w, 1)
    elif case == "insult in a clean text":
        docs, labels = toxic_table(spark, 600, 150, lambda rng, w, i, bad: put(rng, w, "grobulak") if bad or i == 3 else w, 2)
    else:
        def make(rng, w, i, bad):
            if bad:
                return put(rng, w, "grobulak", "wimzeth")
            return put(rng, w, ("grobulak", "wimzeth")[i % 2]) if i % 3 else w
        docs, labels = toxic_table(spark, 600, 150, make, 3)
    machine = toxicity.fit(docs, labels.where(~C.held_out(F.col("doc_id"))))
    scored = toxicity.transform(machine, docs).withColumn("held_out", C.held_out(F.col("doc_id")))
    assert auc(spark, scored, labels, "toxic") > 0.9


def test_toxicity_scores_follow_from_the_fitted_landmarks(spark):
    """Scores recomputed one text at a time, from the subsequence sums of the kernel's definition."""
    machine = toxicity.KernelMachine(["grobu", "zorkel"], np.array([1.5, 0.75]), -0.6, (3.0, -0.5),
                                     [("stupi", "cabba")], np.array([0.9, 2.0, -0.8]))

    def raw(s, t):
        total = 0.0
        for a in combinations(range(len(s)), toxicity.ORDER):
            for b in combinations(range(len(t)), toxicity.ORDER):
                if all(s[i] == t[j] for i, j in zip(a, b)):
                    total += toxicity.DECAY ** (a[-1] - a[0] + 1 + b[-1] - b[0] + 1)
        return total

    def near(s, t):
        d = raw(s, s) * raw(t, t)
        return raw(s, t) / d ** 0.5 if raw(s, s) > 0 else 0.0

    texts = ["a grobu here", "gro.bu and stupi cabba", "stupi\ncabba", "cabba stupi", "Z o r k e l !", "plain talk", "stup1i xcabba", ""]
    got = {r.doc_id: r.score for r in toxicity.transform(machine, frame(spark, list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        u = ["".join(c for c in w if c.isalpha()) for w in t.lower().replace("z o r k e l", "zorkel").split()]
        u = [w for w in u if w]
        best = max([1.5 * near(w, "grobu") + 0.75 * near(w, "zorkel") - 0.6 for w in u], default=-0.6)
        best = 0.9 * best + 2.0 * max([near(a, "stupi") * near(b, "cabba") for a, b in zip(u, u[1:])], default=0.0) - 0.8
        assert abs(got[i] - 1 / (1 + np.exp(-(3.0 * best - 0.5)))) < 1e-4, t
