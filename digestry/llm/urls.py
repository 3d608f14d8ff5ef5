"""URL rules by a bit-parallel wildcard automaton (Shift-And).

All globs are packed side by side into 64-bit words, one bit for each symbol of a pattern. One step per character of
the URL moves every pattern of every URL of a batch at once: shift, let bits on at pattern starts, and with the mask of
the character; a bit before `*` stays where it is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BREAK = 256  # symbol between host and path, so that a host's pattern can't match in the path


@dataclass(frozen=True)
class Rule:
    """`pattern` is a host and a path prefix. The host fits itself and its subdomains; `*` stands for any run of
    symbols (of the host or the path), `?` for one byte of their UTF-8 form. In hosts A-Z count as a-z."""

    pattern: str
    verdict: str


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without `://`."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://[^/?#]*([^?#]*)", 1)


class Automaton:
    """rules: ordered so that the first of equals wins; of the rules that fit, the longest pattern does."""

    def __init__(self, rules: list[Rule]) -> None:
        # Ascending by length, the first of equals last: the highest accepting bit is the winner.
        self.order = sorted(range(len(rules)), key=lambda i: (len(rules[i].pattern), -i))
        symbols: list[list[int]] = []
        for i in self.order:
            host, slash, path = rules[i].pattern.partition("/")
            host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
            # Canonical URLs begin with a dot, so a leading `*.` covers the host itself and all subdomains.
            glob: list[int | str] = ["*", ord("."), *self._symbols(host), BREAK, *self._symbols(slash + path), "*"]
            symbols.append(glob)
        size = sum(sum(s != "*" for s in glob) + 1 for glob in symbols)
        self.words = max(1, -(-size // 64))
        self.masks = np.zeros((BREAK + 1, self.words), np.uint64)
        self.stay, self.start = np.zeros(self.words, np.uint64), np.zeros(self.words, np.uint64)
        self.accept = np.zeros(size, np.int64) - 1
        bit = 0
        for k, glob in enumerate(symbols):
            # State bit 0 of a pattern: nothing read yet; bit j: j symbols read.
            self._set(self.start, bit)
            for s in glob:
                if s == "*":
                    self._set(self.stay, bit)
                    continue
                bit += 1
                for c in range(256) if s == "?" else (s,):
                    self._set(self.masks[c], bit)
            self.accept[bit] = k
            bit += 1
        self.finals = np.zeros(self.words, np.uint64)
        for b in np.flatnonzero(self.accept >= 0):
            self._set(self.finals, b)

    @staticmethod
    def _symbols(text: str) -> list[int | str]:
        return [s for c in text for s in ((c,) if c in "*?" else c.encode())]

    @staticmethod
    def _set(words: np.ndarray, bit: int) -> None:
        words[bit // 64] |= np.uint64(1) << np.uint64(bit % 64)

    def winners(self, urls: list[np.ndarray]) -> np.ndarray:
        """Place of the winning rule in the given rules, -1 if none fits. urls: symbols of `.host`, BREAK, path."""
        out = np.full(len(urls), -1, np.int64)
        if not len(urls) or not self.order:
            return out
        lengths = np.array([len(u) for u in urls])
        by_length = np.argsort(-lengths, kind="stable")  # those still running stay in front
        ends, flat = np.cumsum(lengths[by_length]), np.concatenate([urls[i] for i in by_length])
        begins = ends - lengths[by_length]
        state = np.tile(self.start, (len(urls), 1))
        running = np.searchsorted(-lengths[by_length], -np.arange(lengths.max()), "left")
        carry = np.zeros_like(state)
        for at, n in enumerate(running):
            now = state[:n]
            moved = now << np.uint64(1)
            if self.words > 1:
                carry[:n, 1:] = now[:, :-1] >> np.uint64(63)
                moved |= carry[:n]
            state[:n] = moved & self.masks[flat[begins[:n] + at]] | now & self.stay
        done = state & self.finals
        for w in range(self.words):
            left = done[:, w].copy()
            rows = np.flatnonzero(left)
            # The highest bit: fold all lower ones in, then count.
            for shift in (1, 2, 4, 8, 16, 32):
                left |= left >> np.uint64(shift)
            top = 64 * w + np.bitwise_count(left[rows]).astype(np.int64) - 1
            out[by_length[rows]] = np.array(self.order)[self.accept[top]]
        return out


def filter_urls(pages: DataFrame, rules: list[Rule], url: str = "url", default: str = "allow", batch: int = 4096) -> DataFrame:
    """Adds host, path, rule (null if none fits) and verdict (the rule's, else `default`) to each row.

    Rules are configuration sent with the plan. Null URLs and URLs without `://` have empty host and path. Columns
    named like the new ones are replaced, all others stay.
    """
    automaton = Automaton(rules)
    patterns, verdicts = [r.pattern for r in rules], [r.verdict for r in rules]
    found = pages.select(*(c for c in pages.columns if c not in ("host", "path", "rule", "verdict")),
                         host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for all_ in batches:
            for at in range(0, all_.num_rows, batch):
                part = all_.slice(at, batch)
                hosts, paths = (part.column(part.num_columns - i).to_pylist() for i in (2, 1))
                urls = [np.concatenate([np.frombuffer(b"." + h.encode(), np.uint8).astype(np.int64), [BREAK], np.frombuffer(p.encode(), np.uint8)])
                        for h, p in zip(hosts, paths)]
                won = automaton.winners(urls)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([patterns[i] if i >= 0 else None for i in won], pa.string()),
                                                  pa.array([verdicts[i] if i >= 0 else default for i in won], pa.string())],
                                                 names=[*part.schema.names, "rule", "verdict"])

    return found.mapInArrow(judge, StructType([*found.schema.fields]).add("rule", "string").add("verdict", "string"))
