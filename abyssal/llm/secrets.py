"""Secrets by fixed formats and by inferred grammars.

Base spans come from three patterns. The credentials in them are labelled by their kind;
other runs of credential characters are ordinary, words or numbers. For each kind and for both
sorts of ordinary runs a probabilistic automaton is inferred: the prefixes of a bounded sample, counted in Spark, are a
prefix tree, whose states are merged where their frequencies of next symbols and ends, and those of
all states after them, agree within Hoeffding bounds. Every run outside base spans is then scored
by how much likelier its format is under the automaton of a kind than under that of its sort.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

# The base patterns in the order of their kinds, and the least lengths of what they find.
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}

KINDS = ("assign", "access", "hex")
#: Ordinary runs with and without letters; each has an automaton, for numbers would be too rare in one of both.
ORDINARY = ("word", "number")
#: Runs that are scored.
RUN = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
SYMBOLS = 68
#: HEX with the least length built in, which finds the same spans: runs of hex digits are whole either way.
_HEX = re.compile(r"[0-9a-f]{24,}")
_LETTER = re.compile(r"[A-Za-z]")


@dataclass(frozen=True)
class Found:
    kind: str
    start: int
    end: int
    credential: str


def base_spans(text: str) -> list[Found]:
    """Spans of the fixed patterns by start, then kind; those below the least length are dropped after matching."""
    out = [Found("assign", m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    out += [Found("access", m.start(), m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    out += [Found("hex", m.start(), m.end(), m[0]) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda f: (f.start, KINDS.index(f.kind)))


def ordinary_runs(text: str, base: list[Found]) -> list[Found]:
    """Runs of credential characters that no base span touches: words, or numbers if they have no letter."""
    starts, reach = [f.start for f in base], [0, *accumulate((f.end for f in base), max)]
    free = (m for m in RUN.finditer(text) if reach[bisect_left(starts, m.end())] <= m.start())
    return [Found("word" if _LETTER.search(m[0]) else "number", m.start(), m.end(), m[0]) for m in free]


class Automaton:
    """A probabilistic automaton: for each state how often it was entered and ended, and how often each symbol led where."""

    def __init__(self, entered: list[int], ended: list[int], ways: list[dict[str, tuple[int, int]]]):
        self.entered, self.ended, self.ways = entered, ended, ways

    def bits(self, word: str) -> float:
        """Minus the binary logarithm of the word's probability. A symbol not seen in a state has a share of one
        observation and leads back to the start."""
        at, total = 0, 0.0
        for c in word:
            n = self.entered[at]
            to, times = self.ways[at].get(c, (0, 0))
            total -= math.log2((times + 1 / SYMBOLS) / (n + 1))
            at = to
        return total - math.log2((self.ended[at] + 1 / SYMBOLS) / (self.entered[at] + 1))


def infer(prefixes: dict[str, tuple[int, int]], alpha: float = 0.05) -> Automaton:
    """Merge compatible states of a prefix tree, given as prefix -> (times entered, times ended) with the empty prefix.

    States are taken in the order of length and text: one that is compatible with a state already kept is folded
    into the first such, else it is kept.
    """
    names = sorted(prefixes, key=lambda p: (len(p), p))
    number = {p: i for i, p in enumerate(names)}
    entered, ended = [prefixes[p][0] for p in names], [prefixes[p][1] for p in names]
    ways: list[dict[str, int]] = [{} for _ in names]
    taken: list[dict[str, int]] = [{} for _ in names]
    for p in names[1:]:
        ways[number[p[:-1]]][p[-1]] = number[p]
        taken[number[p[:-1]]][p[-1]] = prefixes[p][0]
    width = math.sqrt(0.5 * math.log(2 / alpha))

    def differ(a: int, n: int, b: int, m: int) -> bool:
        return n > 0 and m > 0 and abs(a / n - b / m) > width * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def compatible(kept: int, other: int) -> bool:
        pairs = [(kept, other)]
        while pairs:
            r, b = pairs.pop()
            n, m = entered[r], entered[b]
            if differ(ended[r], n, ended[b], m):
                return False
            for c in taken[r].keys() | taken[b].keys():
                if differ(taken[r].get(c, 0), n, taken[b].get(c, 0), m):
                    return False
                if c in ways[r] and c in ways[b]:
                    pairs.append((ways[r][c], ways[b][c]))
        return True

    def fold(kept: int, other: int) -> None:
        pairs = [(kept, other)]
        while pairs:
            r, b = pairs.pop()
            entered[r] += entered[b]
            ended[r] += ended[b]
            for c, to in ways[b].items():
                taken[r][c] = taken[r].get(c, 0) + taken[b][c]
                if c in ways[r]:
                    pairs.append((ways[r][c], to))
                else:
                    ways[r][c] = to

    states = [0]
    kept = {0}
    while True:
        edge = min(((to, r, c) for r in states for c, to in ways[r].items() if to not in kept), default=None)
        if edge is None:
            break
        to, parent, c = edge
        into = next((r for r in states if compatible(r, to)), None)
        if into is None:
            states.append(to)
            kept.add(to)
        else:
            ways[parent][c] = into
            fold(into, to)
    place = {s: i for i, s in enumerate(states)}
    return Automaton([entered[s] for s in states], [ended[s] for s in states], [{c: (place[to], taken[s][c]) for c, to in ways[s].items()} for s in states])


def _scanned(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (doc_id, base, runs): one pass over the texts."""
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("credential", pa.string())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base = [base_spans(t.as_py() or "") for t in batch["text"]]
            runs = [ordinary_runs(t.as_py() or "", b) for t, b in zip(batch["text"], base)]
            lists = [pa.array([[vars(f) for f in row] for row in some], pa.list_(span)) for some in (base, runs)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *lists], names=["doc_id", "base", "runs"])

    kind = "array<struct<kind: string, start: bigint, end: bigint, credential: string>>"
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(scan, f"doc_id bigint, base {kind}, runs {kind}")


def learn(scanned: DataFrame, fit_rows: int = 1000, fit_length: int = 256, least: int = 10, alpha: float = 0.05) -> dict[str, Automaton]:
    """Automata by kind, those of ordinary runs among them.

    About ``fit_rows`` different credentials a kind at most, of at most ``fit_length`` symbols, chosen by hash. A kind with fewer than
    ``least`` has no automaton.
    """
    each = scanned.select(F.explode(F.concat("base", "runs")).alias("f")).select("f.kind", "f.credential").where(F.length("credential") <= fit_length).distinct()
    counts = {r["kind"]: r["n"] for r in each.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    share = F.lit(0.0)
    for kind, n in counts.items():
        share = F.when(F.col("kind") == kind, F.lit(min(1.0, fit_rows / n) if n >= least else 0.0)).otherwise(share)
    some = each.where(F.pmod(F.xxhash64("credential"), F.lit(1 << 20)) < share * (1 << 20))
    steps = some.select("kind", "credential", F.explode(F.sequence(F.lit(0), F.length("credential"))).alias("n"))
    tree = steps.groupBy("kind", F.expr("substring(credential, 1, n)").alias("prefix")).agg(F.count("*").alias("entered"), F.sum((F.col("n") == F.length("credential")).cast("int")).alias("ended"))
    prefixes: dict[str, dict[str, tuple[int, int]]] = {}
    for r in tree.collect():  # at most fit_rows x (fit_length + 1) a kind
        prefixes.setdefault(r["kind"], {})[r["prefix"]] = (r["entered"], r["ended"])
    return {k: infer(p, alpha) for k, p in prefixes.items()}


def likely(credential: str, sort: str, automata: dict[str, Automaton], bits: float) -> bool:
    """Whether some kind's automaton gives an ordinary run ``bits`` bits more likelihood than that of its sort does, or, if the
    sort has none, than equal chances of all symbols."""
    plain = automata[sort].bits(credential) if sort in automata else len(credential) * math.log2(SYMBOLS)
    return any(plain - automata[kind].bits(credential) >= bits for kind in KINDS if kind in automata)


def scan(docs: DataFrame, fit_rows: int = 1000, bits: float = 20.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_assign, n_access, n_hex, base_sha256, spans), one a row of ``docs``.

    The counts and the digest are of the base spans: assignments to a name of a secret, access keys and long runs
    of hex digits, each leftmost and non-overlapping. ``spans`` has them and those that the grammars add (kind ``grammar``: runs
    of 16 characters or more of ``[A-Za-z0-9+/_.=-]`` that no base span touches and whose format is at least ``bits``
    bits likelier as a credential of some kind than as a word or number) as kind:start:end by start, then kind, in code points, ends exclusive, comma-joined.

    Null and empty texts have no spans (an empty string and its digest). Repeated rows and null ids are rows of their own. Texts are
    scanned whole, at any length. Automata are fitted on a bounded sample (``learn``); with too few labelled credentials none is
    fitted and nothing is added. An empty table gives no rows; other columns are not looked at.
    """
    scanned = stored(_scanned(docs, id_col, text_col), "secret-spans")
    shared = docs.sparkSession.sparkContext.broadcast(learn(scanned, fit_rows))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata, order = shared.value, [*KINDS, "grammar"]
        for batch in batches:
            counts, digests, spans = {k: [] for k in KINDS}, [], []
            for base, runs in zip(batch["base"].to_pylist(), batch["runs"].to_pylist()):
                written = [f"{f['kind']}:{f['start']}:{f['end']}" for f in base]
                digests.append(hashlib.sha256(",".join(written).encode()).hexdigest())
                for k in KINDS:
                    counts[k].append(sum(f["kind"] == k for f in base))
                more = [f | {"kind": "grammar"} for f in runs if likely(f["credential"], f["kind"], automata, bits)]
                spans.append(",".join(f"{f['kind']}:{f['start']}:{f['end']}" for f in sorted(base + more, key=lambda f: (f["start"], order.index(f["kind"])))))
            longs = [pa.array(counts[k], pa.int64()) for k in KINDS]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *longs, pa.array(digests, pa.string()), pa.array(spans, pa.string())], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return scanned.mapInArrow(score, "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string")
