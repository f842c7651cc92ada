"""Secret scans: three base patterns, and probabilistic automata inferred from labelled credentials.

Grammar inference follows ALERGIA: the labelled credentials of a format form a prefix tree with counts; states are
merged, with the latest kept state first, when their outgoing and final frequencies agree within a Hoeffding bound and so do
those of their successors. The result is a probabilistic automaton per format. A candidate is a run of credential
characters; its score is the log-likelihood under the best automaton against a background of ordinary words.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.storage import bounded_batches

from .memory import released

KINDS = ("assign", "access", "hex", "format")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # the runs of [0-9a-f]+ that are long enough
MIN_ASSIGN, MIN_ACCESS = 6, 20
_WORDS_OF_ASSIGN = ("passw", "secret", "token", "api")
#: Runs that may hold a credential of a known format.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{20,}(?![A-Za-z0-9+/_.=-])")
#: Characters at a candidate's start that the automata read as they are; later ones are read by class.
HEAD = 3
SAMPLES, SEED, ALPHA = 100, 20240229, 0.05
#: Least log-likelihood ratio per character (natural log) of a reported candidate.
THRESHOLD = 0.25
#: Least characters of a candidate, and the fall of the ratio (over four unseen moves) that ends a walk inside a run.
LEAST, FALL = 20, 40.0

_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
_ALNUM = _UPPER + _LOWER + _DIGITS
#: Publicly documented credential formats: literal parts and parts of an (alphabet, length), or of lengths (least, most).
FORMATS = {
    "github": ["gh", ("pousr", 1), "_", (_ALNUM, 36)],
    "gitlab": ["glpat-", (_ALNUM + "_-", 20)],
    "slack": ["xox", ("bp", 1), "-", (_DIGITS, 12), "-", (_DIGITS, 12), "-", (_ALNUM, 24)],
    "google": ["AIza", (_ALNUM + "_-", 35)],
    "stripe": ["sk_", "live_", (_ALNUM, 24)],
    "npm": ["npm_", (_ALNUM, 36)],
    "sendgrid": ["SG.", (_ALNUM + "_-", 22), ".", (_ALNUM + "_-", 43)],
    "huggingface": ["hf_", (_UPPER + _LOWER, (34, 37))],
    "pypi": ["pypi-AgEIcHlwaS5vcmc", (_ALNUM + "_-", (70, 150))],
    "google_oauth": ["ya29.", (_ALNUM + "_-", (60, 140))],
    "jwt": ["eyJ", (_ALNUM + "_-", 33), ".", "eyJ", (_ALNUM + "_-", 60), ".", (_ALNUM + "_-", 43)],
}


def labelled(samples: int = SAMPLES, seed: int = SEED) -> dict[str, list[str]]:
    """Credentials by format, drawn from FORMATS with a fixed seed."""
    rng = random.Random(seed)

    def draw(part) -> str:
        if isinstance(part, str):
            return part
        size = part[1] if isinstance(part[1], int) else rng.randint(*part[1])
        return "".join(rng.choice(part[0]) for _ in range(size))

    return {name: ["".join(map(draw, parts)) for _ in range(samples)] for name, parts in FORMATS.items()}


def symbol(c: str, at: int) -> str:
    if at < HEAD:
        return "=" + c
    return "a" if c in _LOWER else "A" if c in _UPPER else "0" if c in _DIGITS else c


#: Characters that a symbol stands for, to spread a class's probability over them.
def width(s: str) -> int:
    return {"a": 26, "A": 26, "0": 10}.get(s, 1)


class Automaton:
    """A probabilistic automaton: per state the arrivals, the ends and the successors by symbol with their counts."""

    def __init__(self, words: list[str], alpha: float = ALPHA):
        self.arrivals, self.ends, self.next = [0], [0], [{}]
        self.counts: list[Counter] = [Counter()]
        for w in words:
            q = 0
            self.arrivals[0] += 1
            for i, c in enumerate(w):
                s = symbol(c, i)
                self.counts[q][s] += 1
                if s not in self.next[q]:
                    self.next[q][s] = len(self.next)
                    for x, new in ((self.arrivals, 0), (self.ends, 0), (self.next, {}), (self.counts, Counter())):
                        x.append(new)
                q = self.next[q][s]
                self.arrivals[q] += 1
            self.ends[q] += 1
        self.alpha = alpha
        self._infer()

    def _differ(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        bound = math.sqrt(0.5 * math.log(2 / self.alpha)) * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))
        return abs(f1 / n1 - f2 / n2) >= bound

    def compatible(self, a: int, b: int) -> bool:
        todo, seen = [(a, b)], set()
        while todo:
            a, b = todo.pop()
            if a == b or (a, b) in seen:
                continue
            seen.add((a, b))
            na, nb = self.arrivals[a], self.arrivals[b]
            if not na or not nb:
                continue
            if self._differ(self.ends[a], na, self.ends[b], nb):
                return False
            for s in self.counts[a].keys() | self.counts[b].keys():
                if self._differ(self.counts[a][s], na, self.counts[b][s], nb):
                    return False
                if s in self.next[a] and s in self.next[b]:
                    todo.append((self.next[a][s], self.next[b][s]))
        return True

    def _fold(self, a: int, b: int) -> None:
        """Add the subtree of b to state a."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.arrivals[a] += self.arrivals[b]
            self.ends[a] += self.ends[b]
            self.counts[a].update(self.counts[b])
            for s, y in self.next[b].items():
                if s in self.next[a]:
                    todo.append((self.next[a][s], y))
                else:
                    self.next[a][s] = y

    def _infer(self) -> None:
        kept = [0]
        while True:
            front = [(q, s, b) for q in kept for s, b in sorted(self.next[q].items()) if b not in kept]
            if not front:
                break
            q, s, b = front[0]
            for a in reversed(kept):
                if self.compatible(a, b):
                    self.next[q][s] = a
                    self._fold(a, b)
                    break
            else:
                kept.append(b)

    def log_likelihood(self, word: str, floor: float = 1e-4) -> float:
        """Log-probability of the word and its end; unseen moves cost the floor and stay in the state."""
        q, total = 0, 0.0
        for i, c in enumerate(word):
            s = symbol(c, i)
            p = self.counts[q][s] / self.arrivals[q] if self.arrivals[q] else 0.0
            total += math.log(max(p, floor) / width(s))
            q = self.next[q].get(s, q)
        return total + math.log(max(self.ends[q] / max(1, self.arrivals[q]), floor))


#: Ordinary writing: probability of a character by class in words, numbers, names of files and hosts.
_BACKGROUND = {"a": 0.86, "A": 0.05, "0": 0.04, ".": 0.02, "-": 0.01, "_": 0.01, "/": 0.006, "=": 0.002, "+": 0.002}


def background(word: str) -> float:
    """Log-probability under first-order repetition of classes: ordinary words seldom change between them."""
    total, before = 0.0, "a"
    for c in word:
        s = symbol(c, HEAD)
        p = 0.5 * _BACKGROUND.get(s, 0.002) + 0.5 * (s == before)
        total += math.log(p / width(s))
        before = s
    return total + math.log(0.1)


_TRAINED: list[dict[str, Automaton]] = []


def automata() -> dict[str, Automaton]:
    """Trained once per process; training is deterministic and takes well under a second."""
    if not _TRAINED:
        _TRAINED.append({k: Automaton(v) for k, v in labelled().items()})
    return _TRAINED[0]


def score(word: str) -> tuple[str, float]:
    """(format, log-likelihood ratio per character) of the likeliest format."""
    best = max(automata().items(), key=lambda x: x[1].log_likelihood(word))
    return best[0], (best[1].log_likelihood(word) - background(word)) / len(word)


_STARTS: list[re.Pattern] = []
_TAIL = re.compile("[A-Za-z0-9_-]*")


def starts() -> re.Pattern:
    """Matches, without using up text, where some automaton has a move for each of the first HEAD characters."""
    if not _STARTS:
        heads = set()
        for a in automata().values():
            ways = [("", 0)]
            for _ in range(HEAD):
                ways = [(w + s[1:], b) for w, q in ways for s, b in a.next[q].items() if s[0] == "=" and len(s) == 2]
            heads |= {w for w, _ in ways}
        _STARTS.append(re.compile("(?=" + "|".join(map(re.escape, sorted(heads))) + ")"))
    return _STARTS[0]


def longest(text: str, start: int, end: int, floor: float = 1e-4) -> int:
    """Length of the likeliest beginning of text[start:end] that reaches THRESHOLD under some automaton, 0 if none does.

    A walk reads no more than it needs: it ends where the ratio has fallen by FALL.
    """
    best, length = 0.0, 0
    for a in automata().values():
        q, before, total, top = 0, "a", 0.0, 0.0
        for i in range(end - start):
            c = text[start + i]
            s = symbol(c, i)
            if i < HEAD and s not in a.next[q]:
                break
            plain = symbol(c, HEAD)
            p = a.counts[q][s] / a.arrivals[q] if a.arrivals[q] else 0.0
            total += math.log(max(p, floor) / width(s)) - math.log((0.5 * _BACKGROUND.get(plain, 0.002) + 0.5 * (plain == before)) / width(plain))
            before, q = plain, a.next[q].get(s, q)
            top = max(top, total)
            if total < top - FALL:
                break
            ratio = total + math.log(max(a.ends[q] / max(1, a.arrivals[q]), floor)) - math.log(0.1)
            if i + 1 >= LEAST and ratio >= THRESHOLD * (i + 1) and ratio > best:
                best, length = ratio, i + 1
    return length


def inside(text: str, start: int, end: int) -> list[tuple[int, int, str]]:
    """Credentials of text[start:end] that begin as some format does, whatever they are glued to, up to the word's end."""
    out, at = [], start
    for m in starts().finditer(text, start, end):
        if m.start() >= at and end - m.start() >= LEAST and (n := longest(text, m.start(), end)):
            at = _TAIL.match(text, m.start() + n, end).end()
            out.append((m.start(), at, "format"))
    return out


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns, leftmost non-overlapping per kind; failing matches are dropped."""
    out = []
    low = text.lower()
    if any(w in low for w in _WORDS_OF_ASSIGN):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= MIN_ACCESS]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=_order)


def _union(spans: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """The disjoint intervals that spans, sorted by start, cover."""
    out: list[tuple[int, int]] = []
    for a, b, _ in spans:
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _order(span: tuple[int, int, str]) -> tuple[int, int, int]:
    return span[0], KINDS.index(span[2]), span[1]


def scan(text: str | None) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base spans, all spans): runs that no base span touches join if they are likely enough as a whole.

    Of other runs, and between the base spans of a run, the credentials inside join.
    """
    if not text:
        return [], []
    base = base_spans(text)
    taken = _union(base)
    more, first = [], 0
    for m in CANDIDATE.finditer(text):
        # runs and taken intervals both ascend: one sweep over the two
        while first < len(taken) and taken[first][1] <= m.start():
            first += 1
        touching, n = [], first
        while n < len(taken) and taken[n][0] < m.end():
            touching.append(taken[n])
            n += 1
        if not touching and score(m[0])[1] >= THRESHOLD:
            more.append((m.start(), m.end(), "format"))
            continue
        at = m.start()
        for a, b in [*touching, (m.end(), m.end())]:
            more += inside(text, at, a)
            at = max(at, b)
    return base, sorted(base + more, key=_order)


def written(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each maximal run of overlapping spans replaced by [kind] of its first."""
    out, at = [], 0
    for a, b, kind in spans:
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


SCHEMA = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, redacted string"


def find_secrets(docs: DataFrame, text: str = "text", redacted: bool = True) -> DataFrame:
    """docs with the counts and digest of base spans, all spans (kind:start:end, code points), and the redacted text.

    A narrow pass over whole texts that holds one batch at a time, linear in a text, however many secrets it has. Null and empty texts have no spans (a null text
    stays null when redacted); repeated rows agree; an empty table gives an empty result; columns of docs with the
    added names are replaced. redacted=False leaves that column null, and unread.
    """
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    rest = [c for c in docs.columns if c not in names]
    bounded_batches(docs.sparkSession)

    @F.pandas_udf(SCHEMA)
    def scanned(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            base, spans = scan(t)
            n = Counter(k for _, _, k in base)
            digest = hashlib.sha256(written(base).encode()).hexdigest()
            rows.append((n["assign"], n["access"], n["hex"], digest, written(spans), redact(t, spans) if redacted and t is not None else None))
        released()
        return pd.DataFrame(rows, columns=names)

    out = docs.select(*rest, scanned(F.col(text)).alias("__found"))
    return out.select(*rest, *(F.col(f"__found.{c}").alias(c) for c in names))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return find_secrets(docs, redacted=False).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")
