"""URL filters: glob rules in multiword Shift-And masks, all patterns at once.

A canonical URL is "." + host + separator + path as bytes; the separator is 0xFF, which UTF-8 never holds.
A rule (host, path) becomes the glob "*.host<sep>path*": it fits the host, its subdomains and any path that starts
with the rule's. Every literal of every glob owns one bit; bits are packed into 64-bit words and carried between
words, and a leading or inner "*" is a bit that keeps itself. The state of all rules advances by one byte of all
URLs of a batch at once.

Null url, or no "://": host and path are empty, no rule fits. Longest rule (host and path characters) wins, a tie goes to
the rule listed first. Very long URLs are read whole, one by one. A null page id stays null, one that is no number becomes null. Repeated
rows give repeated rows. An empty table gives an empty table. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEPARATOR = 0xFF
#: Bytes of a URL up to which it is judged with others.
LONG = 1024
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class ShiftAnd:
    """Many globs ("*": any bytes, "?": one byte) as one bit-parallel automaton over bytes."""

    def __init__(self, globs: Sequence[bytes]):
        start: list[int] = []
        end: list[int] = []
        literals: list[int | None] = []
        loops: list[bool] = []
        for glob in globs:
            # state bits: one initial bit, then one for each consumed byte; a "*" makes the bit before it loop
            start.append(len(literals))
            literals.append(None)
            loops.append(False)
            for c in glob:
                if c == ord("*"):
                    loops[-1] = True
                else:
                    literals.append(-1 if c == ord("?") else c)
                    loops.append(False)
            end.append(len(literals) - 1)
        self.words = max(1, -(-len(literals) // 64))
        self.match = np.zeros((256, self.words), np.uint64)
        self.loop = np.zeros(self.words, np.uint64)
        self.first = np.zeros(self.words, np.uint64)
        self.ends = [(e // 64, np.uint64(1 << (e % 64))) for e in end]
        for bit, (literal, loops_here) in enumerate(zip(literals, loops)):
            word, mask = bit // 64, np.uint64(1 << (bit % 64))
            if literal == -1:
                self.match[:, word] |= mask
            elif literal is not None:
                self.match[literal, word] |= mask
            if loops_here:
                self.loop[word] |= mask
        for bit in start:
            self.first[bit // 64] |= np.uint64(1 << (bit % 64))

        # the same masks as whole numbers
        whole = lambda words: sum(int(w) << (64 * k) for k, w in enumerate(words))
        self.long = ([whole(m) for m in self.match], whole(self.loop), whole(self.first), [1 << e for e in end])

    def run(self, texts: list[bytes]) -> np.ndarray:
        """(texts, globs) booleans: which glob fits which whole text.

        Texts of up to LONG bytes advance together, a byte of all at each step; longer ones each for itself, so that one of them doesn't cost
        a step over the batch for each of its bytes.
        """
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        out = np.zeros((len(texts), len(self.ends)), bool)
        short = np.flatnonzero(size <= LONG)
        out[short] = self._together([texts[i] for i in short])
        for i in np.flatnonzero(size > LONG).tolist():
            out[i] = self._alone(texts[i])
        return out

    def _alone(self, text: bytes) -> list[bool]:
        match, loop, state, ends = self.long
        for c in text:
            state = (state << 1) & match[c] | state & loop
        return [bool(state & e) for e in ends]

    def _together(self, texts: list[bytes]) -> np.ndarray:
        n = len(texts)
        sizes = np.fromiter(map(len, texts), np.int64, n)
        order = np.argsort(-sizes, kind="stable")
        state = np.tile(self.first, (n, 1))
        flat = np.frombuffer(b"".join(texts), np.uint8)
        begin = (np.cumsum(sizes) - sizes)[order]
        ordered = sizes[order]
        for t in range(int(ordered[0]) if n else 0):
            live = int(np.searchsorted(-ordered, -t, side="left"))
            d = state[:live]
            moved = d << np.uint64(1)
            moved[:, 1:] |= d[:, :-1] >> np.uint64(63)
            state[:live] = (moved & self.match[flat[begin[:live] + t]]) | (d & self.loop)
        out = np.zeros((n, len(self.ends)), bool)
        for k, (word, mask) in enumerate(self.ends):
            out[order, k] = (state[:, word] & mask) != 0
        return out


def canonical(url: str) -> tuple[F.Column, F.Column]:
    """Host and path of a url column; both empty for null or no "://"."""
    at = F.instr(F.col(url), "://")
    rest = F.when(F.coalesce(at, F.lit(0)) > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def judge_urls(urls: DataFrame, rules: Sequence[tuple[str, str, str]], key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """key, host, path, rule, verdict for every row; rules: (verdict, host, path)."""
    host, path = canonical(url)
    source = urls.select(F.col(key).try_cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    escaped = [h.encode() + bytes([SEPARATOR]) + p.encode() for _, h, p in rules]
    machine = ShiftAnd([b"*." + x + b"*" for x in escaped])
    names = np.array([h + p for _, h, p in rules], object)
    verdicts = np.array([v for v, _, _ in rules], object)
    # longest first, then as listed; argmax finds the first that fits
    ranked = np.array(sorted(range(len(rules)), key=lambda i: (-len(names[i]), i)), np.int64)
    out = pa.schema([("page_id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("verdict", pa.string())])

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 8192):
                b = batch.slice(at, 8192)
                hosts, paths = b.column(1).to_pylist(), b.column(2).to_pylist()
                fits = machine.run([b"." + h.encode() + bytes([SEPARATOR]) + p.encode() for h, p in zip(hosts, paths)])[:, ranked]
                some, best = fits.any(axis=1), ranked[fits.argmax(axis=1)]
                rule = np.where(some, names[best], None)
                verdict = np.where(some, verdicts[best], default)
                yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(1).cast(pa.string()), b.column(2).cast(pa.string()), pa.array(rule, pa.string()), pa.array(verdict, pa.string())], schema=out)

    return source.mapInArrow(judged, "page_id long, host string, path string, rule string, verdict string")


#: The query's rules: verdict, host, start of the path.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
DEFAULT = "allow"


def op6_url_wildcard_automaton(spark, sf_dir):
    """Every page judged by RULES."""
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), RULES, default=DEFAULT)


def _sql() -> str:
    ranked = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    fits = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h + p}'" for _, h, p in ranked)
    says = " ".join(f"WHEN rule = '{h + p}' THEN '{v}'" for v, h, p in ranked)
    return f"""
WITH rests AS (
  SELECT page_id, CASE WHEN url IS NULL OR position('://' IN url) = 0 THEN '' ELSE substr(url, position('://' IN url) + 3) END AS rest
  FROM pages),
split AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rests),
ruled AS (SELECT *, CASE {fits} END AS rule FROM split)
SELECT page_id, host, path, rule, CASE {says} ELSE '{DEFAULT}' END AS verdict FROM ruled"""


QUERIES = {"op6_url_wildcard_automaton": op6_url_wildcard_automaton}
SQL = {"op6_url_wildcard_automaton": _sql()}
