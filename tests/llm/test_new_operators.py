"""Quality rules, run detection and the conversation trie against plain re-statements."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from tests.conftest import SF
from washline.llm import catalog, rules, runs, trie

INK = re.compile(r"[^\x20\x09-\x0d]+")


@pytest.mark.parametrize("name", ["op11_periodic_runs", "op12_prefix_trie", "op13_quality_rules"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    r = con.execute(catalog.oracle_sql()[name])
    cols = [d[0] for d in r.description]
    got = catalog.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(cols)
    assert Counter(map(tuple, got.select(*cols).collect())) == Counter(r.fetchall())


# ---------------------------------------------------------------- quality rules

def plain_measures(text):
    t = text or ""
    words = INK.findall(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if INK.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    count = Counter(windows)
    covered = {j for i, w in enumerate(windows) if count[w] > 1 for j in range(i, i + 5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), dup, len(covered)


def test_rules_odd_rows(spark):
    fox = "the quick brown fox jumps over the lazy dog and runs away"
    texts = [None, "", " \n\t", "one", fox, f"{fox}\n{fox}\nend of it", "a " * 50, "é😀 ü x  y", "x\x0by\x0cz\r\nw\r\n", "#$% <b> & | *\n- a\n- b",
             "a b c d e f a b c d e f a b c d e", "…\nthe end...\n", "word " * 20_000, " ".join(f"w{i % 7000}" for i in range(20_000)), "x" * 300_000,
             "\n".join(["same line of text here now"] * 5)]
    rows = [(i, t, "old", 7) for i, t in enumerate(texts)] + [(4, fox, "old", 7), (None, fox, "old", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string, _measures int")
    out = rules.judge(df)
    assert out.columns[:3] == ["doc_id", "text", "_measures"]
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out.collect())
    want = Counter()
    for d, t, *_ in rows:
        m = plain_measures(t)
        want[(d, *m, m[0] < 10 or 100 * m[4] > 20 * m[0])] += 1
    assert got == want
    assert all(not r.kept for r in out.where("base_failed").collect()) and out.where(f"text = '{fox}' and kept").count() == 3
    assert rules.judge(df.where("false")).count() == 0


def test_rules_table_is_compiled(spark):
    table = (rules.Rule("few", "n_words", at_most=(3, 1), base=True), rules.Rule("long", "word_chars", "n_words", at_least=(5, 2)))
    df = spark.createDataFrame([("aa bb",), ("aaa bbb",), ("aaa bbb ccc ddd",), ("",)], "text string")
    got = [(r.base_failed, r.kept, r.failed_rules) for r in rules.judge(df, table).collect()]
    assert got == [(False, False, "long"), (False, True, ""), (True, False, "few"), (False, True, "")]
    assert [r.kept for r in rules.judge(df, ()).collect()] == [True] * 4


def test_rules_use_no_python(spark):
    plan = catalog.queries()["op13_quality_rules"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan and "Exchange" not in plan


# ---------------------------------------------------------------- runs

def plain_runs(w):
    """(start, length, period) by trying every period at every place."""
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        j = q
        while j < n:
            if w[j] != w[j - q]:
                j += 1
                continue
            s = j - q
            while j < n and w[j] == w[j - q]:
                j += 1
            if j - s >= max(6, 4 * q) and not any(all(w[x] == w[x - p] for x in range(s + p, j)) for p in range(1, q)):
                out.append((s, j - s, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def random_words(rng):
    """Words over small alphabets with periodic stretches put in."""
    k = rng.choice([1, 2, 2, 3, 5, 30])
    w = [rng.randrange(k) for _ in range(rng.choice([0, 1, 5, 6, 7, 20, 60, 200]))]
    for _ in range(rng.randrange(4)):
        q = rng.randrange(1, 25)
        root = [rng.randrange(k) for _ in range(q)]
        at = rng.randrange(len(w) + 1)
        w[at:at] = [root[i % q] for i in range(rng.randrange(0, q * 7))]
    return w


def test_runs_equal_brute_force():
    rng, total = random.Random(3), 0
    for _ in range(300):
        texts = [random_words(rng) for _ in range(rng.randrange(1, 5))]
        got = list(zip(*[x.tolist() for x in runs.runs_of(np.array(sum(texts, []), np.int64), np.array(list(map(len, texts))))]))
        want, at = [], 0
        for t in texts:
            want += [(s + at, n, q) for s, n, q in plain_runs(t)]
            at += len(t)
        assert got == sorted(want, key=lambda r: (r[0], r[2]))
        total += len(want)
    assert total > 500


def plain_collapse(w, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def test_runs_odd_rows(spark):
    rng = random.Random(5)
    texts = [None, "", " \n\t ", "one", "a a a a a", "a a a a a a", " é😀 é😀\té😀\nü ü ü ü ü ü  end ", "x " * 60_000, "y" * 300_000 + " z" * 9, "A a A a A a A a",
             "\x0b".join("abcabcabcabcabc"), "p q\r\n" * 4, "nbsp\u00a0x " * 7]
    texts += [" ".join(f"w{x}" for x in random_words(rng)) for _ in range(200)]
    texts.append(" ".join(f"w{i % 5000}" for i in range(23_000)))
    rows = [(i, t, "old", 1) for i, t in enumerate(texts)] + [(5, texts[5], "old", 1), (None, texts[5], "old", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string, _runs int")
    out = runs.periodic_runs(df)
    assert out.columns == ["doc_id", "text", "_runs", "runs", "collapsed"]
    got = Counter((r.doc_id, tuple(map(tuple, r.runs)), r.collapsed) for r in out.collect())
    want = Counter()
    for d, t, *_ in rows:
        w = INK.findall(t or "")
        if d == 7:
            found = [(0, 60_000, 1)]
        elif len(w) == 23_000:
            found = [(0, 23_000, 5000)]
        else:
            found = plain_runs(w)
        want[(d, tuple(found), plain_collapse(w, found))] += 1
    assert got == want
    assert runs.periodic_runs(df.where("false")).count() == 0


def test_rebuilt_documents(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(f"w{rng.randrange(9)}" for _ in range(rng.choice([0, 1, 2, 9, 50])))) for i in range(400)] + [(None, "a b c"), (3, None)]
    got = runs.rebuild(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for (d, t), r in zip(rows, got):
        w = INK.findall(t or "")
        h = zlib.crc32(b"" if d is None else str(d).encode())
        g, n = h // 10, len(w)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[a + (i - a) % p] if i >= a else x for i, x in enumerate(w)]
        assert r.doc_id == d and INK.findall(r.text or "") == w


# ---------------------------------------------------------------- trie

def plain_conversations(rows):
    out = {}
    for conv, turn, role, text in rows:
        out.setdefault(conv, []).append((float("-inf") if turn is None else turn, role or "", text or ""))
    return {c: [(r, t) for _, r, t in sorted(turns)] for c, turns in out.items()}


def plain_rebuild(convs):
    out = {}
    for c, turns in convs.items():
        h = 0 if c is None else zlib.crc32(str(c).encode()) % 9
        base = None if c is None else c - c % 5 if c >= 0 else c + -c % 5       # % keeps the sign, as in SQL
        out[c] = (convs.get(base, [])[:h] if c is not None else []) + turns[h:]
    return out


def plain_trie(convs):
    """The contract's rows, from all prefixes of all conversations."""
    nodes, parent, depth, size, members, ends = {}, [None], [0], [0], [[]], [[]]
    for c in sorted(convs, key=lambda c: (c is None, c or 0)):
        u = 0
        members[0].append(c)
        for turn in convs[c]:
            if (u, turn) not in nodes:
                nodes[u, turn] = len(parent)
                parent.append(u)
                depth.append(depth[u] + 1)
                size.append(len(turn[1].encode()))
                members.append([])
                ends.append([])
            u = nodes[u, turn]
            members[u].append(c)
        ends[u].append("" if c is None else str(c))
    kids, leaves, saved = Counter(p for p in parent if p is not None), Counter(), Counter()
    for v in range(len(parent)):
        u = v
        while u is not None:
            leaves[u] += not kids[v]
            saved[u] += (len(members[v]) - 1) * size[v]
            u = parent[u]
    least = [min((c for c in m if c is not None), default=None) for m in members]
    return Counter((least[u], depth[u], None if parent[u] is None else least[parent[u]], len(members[u]), kids[u], leaves[u], saved[u],
                    hashlib.sha256(",".join(ends[u]).encode()).hexdigest()) for u in range(len(parent)))


TRIE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def chat_rows():
    rng = random.Random(8)
    rows = []
    for c in range(400):
        kind = c % 4
        if kind == 0:           # a third and more of the rows repeat one conversation
            turns = [("user", "same question"), ("assistant", "same é answer")]
        elif kind == 1:
            turns = [("user", rng.choice(["a", "b"])) for _ in range(rng.randrange(1, 6))]
        elif kind == 2:
            turns = [(rng.choice(["user", "assistant"]), rng.choice(["", "x", "yy"])) for _ in range(rng.randrange(1, 12))]
        else:
            turns = [("user", "q" * c)] * (c % 3 + 1)
        rows += [(c, i, r, t) for i, (r, t) in enumerate(turns)]
    rows += [(None, 1, "user", "lost"), (None, None, "user", "a"), (1000, None, None, None), (1000, 3, "tool", None), (1001, 0, "user", "a"), (1001, 0, "user", "a"),
             (-3, 0, "user", "neg"), (-1, 0, "user", "a"), (2**62, 0, "user", "big"), (1002, 0, "us", "era"), (1003, 0, "use", "ra")]
    rows += [(1005, i, "user", str(i)) for i in range(3000)] + [(1006, i, "user", str(i)) for i in range(3000)]
    rows += [(1010, 0, "user", "long " * 50_000)]
    return rows


@pytest.mark.parametrize("shards, sample, turns, piece", [(1, 20, 1 << 18, 4096), (7, 30, 1 << 18, 3), (25, 40, 1 << 18, 1), (9, 20, 160, 50)])
def test_trie_equals_brute_force(spark, shards, sample, turns, piece):
    rows = chat_rows()
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, path string")
    convs = trie.rebuild(trie.conversations(df))
    got = trie.prefix_trie(convs, shards, sample, turns, piece)
    assert got.columns == TRIE
    assert Counter(map(tuple, got.collect())) == plain_trie(plain_rebuild(plain_conversations(rows)))


def test_trie_splitters_share_hot_paths(spark):
    rows = [(c, 0, "user", "same") for c in range(600)] + [(c, 0, "user", f"t{c}") for c in range(600, 900)]
    convs = trie.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    skeleton = trie.plant(convs, 9, sample=40)
    assert len({p for p, _ in skeleton.splitters}) < len(skeleton.splitters) == 8        # the hot path is cut by conv_id
    shard = Counter(skeleton.shard(bytes(r.path), r.conv_id) for r in convs.collect())
    assert max(shard.values()) < 300 and sum(shard.values()) == 900
    assert Counter(map(tuple, trie.prefix_trie(convs, 9, 40).collect())) == plain_trie(plain_conversations(rows))


def test_trie_of_nothing(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert trie.prefix_trie(trie.rebuild(trie.conversations(df))).count() == 0
