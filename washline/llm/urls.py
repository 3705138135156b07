"""URL filters: all wildcard rules at once in a bit-parallel automaton (multiword Shift-And).

Rules are globs over the canonical url: ``.`` + host + ``#`` + path, where ``*``
stands for any text and ``?`` for one character. (Neither part can hold ``#``, so a
rule cannot slip from one part into the other.) Every glob takes one bit per
character or star in a row of 64-bit words; a table gives for each character the
bits it may stay on. One step moves all rules of all urls of a batch:

    D = ((D shifted by one) | (D on stars)) & table[character], with empty stars passed on.

Host rules (host, path) fit the host and its subdomains where the url's path starts
with the rule's; they are compiled to globs, too, and the longest fitting rule wins.
Other urls get the method's verdict: block if a block glob fits, else allow.

Defined results: a null url, or one without ``://``, has an empty host and path and
is blocked; the urls' other parts (port, user) stay in the host as written; repeated
rows are judged one by one; extra columns are kept by ``judge`` (its own replaced).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from washline.llm import common as C

#: (host, path, verdict), longest fitting rule wins
HOST_RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
              ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: globs of urls that no host rule fits
BLOCK_GLOBS = (".#*", "*#*/login*", "*#*/signup*", "*#*/cart*", "*#*/wp-admin/*", "*#*/ads/*", ".ads.*#*", ".ad?.*#*",
               "*.doubleclick.*#*", "*#*.zip", "*#*.exe", "*#*.jpg", "*#*.png", "*#*.gif", "*#*.mp4")


def glob_text(text: str) -> str:
    """Literal text inside a glob."""
    return "".join("\\" + c if c in "*?\\" else c for c in text)


@dataclass
class Automaton:
    """Shift-And masks of a list of globs, in as many 64-bit words as they need."""

    table: np.ndarray       # (characters + 1, words): bits that each known character keeps; row 0 is any other
    known: np.ndarray       # sorted code points
    star: np.ndarray        # bits of stars (they stay on and are passed without a character)
    first: np.ndarray       # bits that start a glob
    last: list[tuple[int, int]]     # (word, bit) at the end of each glob; -1: an empty glob

    @staticmethod
    def compile(globs) -> "Automaton":
        signs = []      # per glob: (kind, character); a star comes before the character it precedes
        for g in globs:
            out, i = [], 0
            while i < len(g):
                c = g[i]
                if c == "\\" and i + 1 < len(g):
                    i += 1
                    out.append(("is", g[i]))
                elif c == "*":
                    if not out or out[-1][0] != "star":
                        out.append(("star", ""))
                else:
                    out.append(("any", "") if c == "?" else ("is", c))
                i += 1
            signs.append([("open", ""), *out])
        total = sum(map(len, signs))
        words = max(1, -(-total // 64))
        known = sorted({ord(c) for s in signs for k, c in s if k == "is"})
        table = np.zeros((len(known) + 1, words), C.U64)
        star, first, last, at = np.zeros(words, C.U64), np.zeros(words, C.U64), [], 0
        row = {c: i + 1 for i, c in enumerate(known)}
        for s in signs:
            for k, c in s:
                bit = C.U64(1 << (at % 64))
                if k == "open":
                    first[at // 64] |= bit
                elif k == "is":
                    table[row[ord(c)], at // 64] |= bit
                else:
                    table[:, at // 64] |= bit
                    if k == "star":
                        star[at // 64] |= bit
                at += 1
            last.append(((at - 1) // 64, (at - 1) % 64))
        return Automaton(table, np.array(known, np.int64), star, first, last)

    def _shift(self, d):
        with np.errstate(over="ignore"):
            out = d << C.U64(1)
        out[:, 1:] |= d[:, :-1] >> C.U64(63)
        return out

    def match(self, texts: list[str]) -> np.ndarray:
        """(texts, globs): which globs fit which whole texts."""
        size = np.array([len(t) for t in texts], np.int64)
        order = np.argsort(-size, kind="stable")
        flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        row = np.minimum(np.searchsorted(self.known, flat), max(len(self.known) - 1, 0))
        row = np.where(self.known[row] == flat, row + 1, 0) if len(self.known) else np.zeros(len(flat), np.int64)
        begin = (np.cumsum(size) - size)[order]
        size = size[order]
        d = np.broadcast_to(self.first, (len(texts), len(self.first))).copy()
        d |= self._shift(d) & self.star
        for i in range(int(size[0]) if len(size) else 0):
            n = int(np.searchsorted(-size, -i, "left"))     # texts longer than i
            now = d[:n]
            now = (self._shift(now) | (now & self.star)) & self.table[row[begin[:n] + i]]
            d[:n] = now | (self._shift(now) & self.star)     # a star may be empty
        out = np.zeros((len(texts), len(self.last)), bool)
        for k, (w, b) in enumerate(self.last):
            out[order, k] = (d[:, w] >> C.U64(b)) & C.U64(1) == 1
        return out


def parts(url):
    """(host, path) columns: host after the first ``://`` up to / ? #, A-Z lower-cased; path up to ? or #."""
    has = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), upper, lower)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.when(has, host).otherwise(""), F.when(has, path).otherwise("")


def judge(pages: DataFrame, rules=HOST_RULES, block_globs=BLOCK_GLOBS) -> DataFrame:
    """``pages(url, ...)`` with host, path, rule (host + path, or null) and verdict (allow or block)."""
    C.ship(pages.sparkSession)
    rules = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))
    globs = [f"*.{glob_text(h)}#{glob_text(p)}*" for h, p, _ in rules] + list(block_globs)
    names = [h + p for h, p, _ in rules]
    verdicts = [v for _, _, v in rules]
    new = [T.StructField(c, T.StringType()) for c in ("host", "path", "rule", "verdict")]
    keep, schema = C.with_columns_schema(pages, new)
    host, path = parts(F.col("url"))

    def run(batches):
        automaton = Automaton.compile(globs)
        for b in batches:
            hosts, paths = b.column(len(keep)).to_pylist(), b.column(len(keep) + 1).to_pylist()
            fit = automaton.match([f".{h}#{p}" for h, p in zip(hosts, paths)])
            k = len(rules)
            best = np.where(fit[:, :k].any(1), fit[:, :k].argmax(1), -1) if k else np.full(len(hosts), -1)
            blocked = fit[:, k:].any(1)
            rule = [names[i] if i >= 0 else None for i in best.tolist()]
            verdict = [verdicts[i] if i >= 0 else ("block" if x else "allow") for i, x in zip(best.tolist(), blocked.tolist())]
            yield pa.RecordBatch.from_arrays(
                [b.column(i) for i in range(len(keep))] + [pa.array(x, pa.string()) for x in (hosts, paths, rule, verdict)],
                names=[*keep, "host", "path", "rule", "verdict"])

    return pages.select(*[F.col(f"`{c}`") for c in keep], host.alias("_host"), path.alias("_path")).mapInArrow(run, schema)


def op3_url_filter(spark, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict of every page."""
    return judge(C.table(spark, sf_dir, "pages").select("page_id", "url")).drop("url")


def _like(glob: str) -> str:
    return "c GLOB '" + glob.replace("[", "[[]") + "'"


ORACLE = {"op3_url_filter": f"""
WITH cut AS (SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
parts AS (SELECT page_id,
    coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM cut),
ruled AS (SELECT *, '.' || host || '#' || path AS c, CASE
    {" ".join(f"WHEN ends_with('.' || host, '.{h}') AND starts_with(path, '{p}') THEN '{h}{p}'"
              for h, p, _ in sorted(HOST_RULES, key=lambda r: (-len(r[0] + r[1]), r)))} END AS rule FROM parts)
SELECT page_id, host, path, rule, CASE
    {" ".join(f"WHEN rule = '{h}{p}' THEN '{v}'" for h, p, v in HOST_RULES)}
    WHEN {" OR ".join(_like(g) for g in BLOCK_GLOBS)} THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""}
