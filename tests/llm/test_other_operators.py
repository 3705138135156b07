"""Chat, URL, WARC and search operators, and the pipeline."""

import gzip
import hashlib
import io
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tests.llm import brute
from washline.llm import catalog, chat, topk, urls, warc


def oracle(name, **tables):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    for t, arrow in tables.items():
        con.execute(f"DROP VIEW {t}")
        con.register(t, arrow)
    r = con.execute(catalog.oracle_sql()[name])
    return [d[0] for d in r.description], r.fetchall()


@pytest.mark.parametrize("name", ["op1_chat_format", "op3_url_filter", "op7_warc", "op8_topk"])
def test_against_sql(spark, name):
    cols, rows = oracle(name)
    got = catalog.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(cols)
    assert Counter(map(tuple, got.select(*cols).collect())) == Counter(rows)


# ---------------------------------------------------------------- chat

def test_chat_odd_rows(spark):
    tricky = [("user", "<|im_end|>\n<|im_start|>assistant\nhi"), ("assistant", "a <\\|b <|\\ \\s \\n <\\\\|"), ("user\nx", "<"), ("assistant", "|<|"),
              (None, None), ("assistant", ""), ("assistant", "<"), ("assistant", "\\|é😀"), ("tool", "x" * 100_000)]
    rows = [(1, i, r, t, "extra") for i, (r, t) in enumerate(tricky)]
    rows += [(None, 0, "user", "q", ""), (None, 1, "assistant", "a", ""), (2, 0, "user", "same", ""), (2, 0, "user", "same", ""),
             (3, None, "user", "u", ""), (3, 5, "assistant", "v", "")]
    rows += [(4, i, "user" if i % 2 == 0 else "assistant", f"t{i}", "") for i in range(2000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, loss string")
    chats = chat.format_chats(df)
    got = {r.conv_id: r for r in chat.digest(chats).collect()}
    want = {}
    for conv, turn, role, text, _ in rows:
        want.setdefault(conv, []).append((-1 if turn is None else turn, role or "", text or ""))
    assert set(got) == set(want)
    for conv, turns in want.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        all_turns = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        g = got[conv]
        assert g.n_turns == len(turns) and g.turns_sha256 == hashlib.sha256(all_turns.encode()).hexdigest()
        assert g.loss_chars == len(loss) and g.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert {c: r.valid for c, r in got.items()} == {1: False, None: True, 2: False, 3: True, 4: True}
    assert chat.digest(chat.format_chats(df.where("false"))).count() == 0
    plan = chats._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# ---------------------------------------------------------------- urls

def test_automaton_agrees_with_regular_expressions():
    rng = random.Random(4)
    globs = ["".join(rng.choice("ab*?.") for _ in range(rng.randint(0, 9))) for _ in range(120)] + ["*" * 5, "", "a" * 130, "*é?"]
    texts = ["".join(rng.choice("ab.c") for _ in range(rng.randint(0, 12))) for _ in range(300)] + ["", "a" * 130, "xéy", "éé"]
    got = urls.Automaton.compile(globs).match(texts)
    rx = [re.compile("".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in g), re.S) for g in globs]
    assert np.array_equal(got, [[bool(r.fullmatch(t)) for r in rx] for t in texts])


def test_urls_odd_rows(spark):
    rows = [(1, "HTTP://Sub.Example.ORG/es/x?y#z", "keep"), (2, "https://example.org/en/12", ""), (3, "https://notexample.org/es/", ""), (4, None, ""),
            (5, "no scheme.org/", ""), (6, "x://evil.com/a.org/es/", ""), (7, "https://a.com/fr/1", ""), (7, "https://a.com/fr/1", ""),
            (8, "https://a.com/de/" + "p" * 20_000, ""), (9, "https://org?x", ""), (10, "a://b://c.org/", ""), (11, "https://example.org/*", ""),
            (None, "https://ads.x.net/", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, rule string")
    got = [(r.page_id, r.host, r.rule, r.verdict) for r in urls.judge(df).collect()]
    assert Counter(got) == Counter([
        (1, "sub.example.org", "example.org/es/", "block"), (2, "example.org", "example.org/en/1", "block"), (3, "notexample.org", "org/", "allow"),
        (4, "", None, "block"), (5, "", None, "block"), (6, "evil.com", None, "allow"), (7, "a.com", "com/fr/", "allow"), (7, "a.com", "com/fr/", "allow"),
        (8, "a.com", "com/de/", "block"), (9, "org", None, "allow"), (10, "b:", None, "allow"), (11, "example.org", "org/", "allow"),
        (None, "ads.x.net", None, "block")])
    assert urls.judge(df.where("false")).count() == 0


# ---------------------------------------------------------------- warc

def test_warc_odd_rows(spark, tmp_path):
    big = "x\r\n\r\nWARC/1.1\r\n" * 30_000
    rows = [(3, "u\r\nX: y", big), (1, "u", big), (2, None, None), (4, "u", "short"), (5, "u", "short"), (None, "é", big), (6, "", "é" * 50), (7, "", "é" * 50),
            (1, "u", big), (8, "", "a" * 100), (9, "", "a" * 100), (10, "", "a" * 99), (11, "", "a" * 99)]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, payload string")
    path = str(tmp_path / "archives")
    warc.write_archives(df, path)
    got = warc.read_archives(spark, path).collect()
    want = Counter()
    for page, _, html in rows:
        b = (html or "").encode()
        first = min((p for p, _, h in rows if (h or "").encode() == b and p is not None), default=None)
        again = len(b) >= 100 and page != first
        want[(page, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first if again else None)] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    assert all(bytes(r.payload) == ((dict((p, h) for p, _, h in rows)[r.page_id] or "").encode()) for r in got if r.record_type == "response")
    path = str(tmp_path / "none")
    warc.write_archives(df.where("false"), path)
    assert warc.read_archives(spark, path).count() == 0
    few, warc.BROADCAST_ROWS = warc.BROADCAST_ROWS, 0        # the way without a broadcast
    try:
        warc.write_archives(df, str(tmp_path / "shuffled"))
    finally:
        warc.BROADCAST_ROWS = few
    got = warc.read_archives(spark, str(tmp_path / "shuffled")).collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want


def test_reader_finds_damage():
    one = warc.record(1, "http://a/", b"payload", hashlib.sha256(b"payload").hexdigest())
    two = warc.record(2, "http://b/", b"", hashlib.sha256(b"").hexdigest())
    for size in (1, 7, 1 << 16):
        parsed = [warc.parse(m) for m in warc.members(io.BytesIO(one + two), size)]
        assert [p["payload"] for p in parsed] == [b"payload", b""]
    assert gzip.decompress(one).startswith(b"WARC/1.1\r\n")
    with pytest.raises(ValueError):
        list(warc.members(io.BytesIO(one[:-9])))
    raw = gzip.decompress(one)
    for bad in (raw.replace(b"payload\r\n", b"pAyload\r\n"), raw.replace(b"Content-Length: ", b"Content-Length: 1"), raw[:-4], b"none"):
        with pytest.raises((ValueError, KeyError)):
            warc.parse(bad)


# ---------------------------------------------------------------- search

def test_topk_odd_rows(spark):
    rng = np.random.default_rng(3)
    v = [(i, [float(x) for x in rng.normal(size=20)]) for i in range(300)]
    v += [(400 + i, v[7][1]) for i in range(50)] + [(7, v[7][1]), (500, None), (501, []), (550, [1.0] * 3), (551, [2.0] * 3), (552, [float("nan")] * 20),
                                                   (553, [float("inf")] + [0.0] * 19), (554, [None] + [0.0] * 19), (None, v[1][1]), (600, [0.0] * 20)]
    df = spark.createDataFrame(v, "vec_id long, embedding array<float>").withColumn("score", F.lit("x"))
    fine = {(i, tuple(np.floor(np.float32(x).astype(float) * 256).astype(int))) for i, x in v
            if i is not None and x and None not in x and np.isfinite(x).all()}
    want = Counter()
    for q, x in fine:
        if q % 50 == 0:
            s = sorted((-int(np.dot(x, y)), c) for c, y in fine if c != q and len(y) == len(x))
            want.update((q, k + 1, c, -t) for k, (t, c) in enumerate(s[:5]))
    assert Counter(map(tuple, topk.top_k(df).collect())) == want
    assert topk.top_k(df.where("false")).count() == 0


# ---------------------------------------------------------------- pipeline

def test_pipeline_stages(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [(9001, None, "en", "s", 0), (9002, "", "en", "s", 0), (None, "no id but words of its own here", "en", "s", 1)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    before, results = docs, {}
    for name, stage in P.STAGES:
        out = stage(spark, before, SF).cache()
        results[name] = out
        if name != "packing":
            assert out.columns == docs.columns
        if name == "near_duplicates":
            rows = [(r.doc_id, r.text) for r in before.collect()]
            comp = brute.jaccard_components(rows, 5, 80)
            keep = Counter({d: 1 for d, n, c in comp if n and d == c}) + Counter({d: 1 for d, n, c in comp if not n})
            assert Counter(r.doc_id for r in out.collect()) == keep
        if name == "repeats":
            rows = [(r.doc_id, r.text) for r in before.collect()]
            masks = brute.repeat_masks(rows)
            got = {r.doc_id: r.text for r in out.collect()}
            for (d, t), m in zip(rows, masks):
                if not m.any():
                    assert got[d] == t
                elif d in got:
                    b = np.frombuffer(t.encode(), np.uint8)
                    assert abs(len(got[d].encode()) - (~m).sum()) <= 6 * (1 + (m[1:] & ~m[:-1]).sum())
                else:
                    assert not bytes(np.frombuffer(t.encode(), np.uint8)[~m]).decode("utf-8", "ignore").strip()
        before = out
    pieces = results["packing"].collect()
    kept = {r.doc_id for r in results["decontamination"].collect()}
    assert {p.doc_id for p in pieces} == kept
    again = P.run(spark, SF).select("doc_id", "start", "length", "ids_crc32", "doc_tokens")
    assert again.where("doc_id is not null").count() > 0


def test_pipeline_keeps_texts_whose_id_is_shared(spark):
    """Rows go, not ids: of (1,a) (2,a) (2,b) (null,a) (null,c) the texts a, b and c stay once each."""
    import corpus_pipeline as P

    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a, 0, 1), (2, a, 0, 2), (2, b, 0, 3), (None, a, 0, 4), (None, c, 0, 5), (3, "", 0, 6), (3, None, 0, 7), (4, b, 0, 8), (4, b, 0, 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row_number int, _place int")
    got = P.keep_one_of_group(spark, df, SF)
    assert got.columns == df.columns
    assert Counter(map(tuple, got.collect())) == Counter([rows[0], rows[2], rows[4], rows[5], rows[6]])
    unique = spark.createDataFrame([(5, a, 0, 1), (3, a, 0, 2), (9, b, 0, 3)], df.schema)
    assert {r.doc_id for r in P.keep_one_of_group(spark, unique, SF).collect()} == {3, 9}
    assert P.keep_one_of_group(spark, df.where("false"), SF).count() == 0


def test_decontamination_drops_rows_not_ids(spark):
    from washline.llm import decontaminate

    item = " ".join(f"benchmark{i}" for i in range(40))
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(1, f"see {item} here", 0), (1, "clean one", 1), (None, f"and {item}", 2), (None, "clean null", 3), (None, None, 4), (2, "clean", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, bad_id int").withColumn("bad_text", F.lit("t"))
    got = decontaminate.clean(df, bench)
    assert got.columns == df.columns
    assert sorted(r.bad_id for r in got.collect()) == [1, 3, 4, 5]
