"""Secret scans: fixed patterns, and probabilistic automata inferred from labelled credentials that score every candidate.

Credentials found by the fixed patterns are the labelled strings. Their formats (strings over character classes) form a
prefix tree for each kind; states whose outcomes are statistically compatible merge (Hoeffding bounds, red-blue order)
into a probabilistic automaton. Every run of credential characters in a text is then scored: log likelihood of its format
under each automaton less that under a model of ordinary runs. Runs that clear the threshold add spans to the fixed ones.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.llm.common import materialize, small_batches, text_list

# The patterns of the three kinds, in the order in which ties are listed, and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex")
LEAST_ASSIGN, LEAST_ACCESS = 12, 18

_CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{12,}")
_KEYWORD = ("passw", "secret", "token", "api")
_CLASS = {ord(c): k for k, cs in {"h": "abcdef", "l": "ghijklmnopqrstuvwxyz", "H": "ABCDEF", "U": "GHIJKLMNOPQRSTUVWXYZ", "d": "0123456789"}.items() for c in cs}
_END = "$"


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, credential) of the fixed patterns, by start and then kind."""
    out = []
    lower = text.lower()
    if any(k in lower for k in _KEYWORD):
        out += [(m.start(), m.end(), "assign", m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access", m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    out += [(m.start(), m.end(), "hex", m[0]) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def format_of(run: str) -> str:
    return run.translate(_CLASS)


@dataclass
class Automaton:
    """moves[state][symbol] = (next state, log probability); the end of a string is a symbol of its own."""

    moves: list[dict[str, tuple[int, float]]] = field(default_factory=list)
    missing: float = math.log(1e-4)

    def log_likelihood(self, form: str) -> float:
        state, total = 0, 0.0
        for symbol in form + _END:
            to, p = self.moves[state].get(symbol, (None, self.missing)) if state is not None else (None, self.missing)
            total += p
            state = to
        return total


def infer(counts: dict[str, int], alpha: float = 0.05) -> Automaton:
    """Merge the prefix tree of formats (with their counts) into a probabilistic automaton.

    States are taken breadth first; each joins the first kept state whose outgoing frequencies, and those of all the
    successors they share, differ by no more than Hoeffding's bound at `alpha`. No formats: an automaton that rejects all.
    """
    child: list[dict[str, int]] = [{}]
    freq: list[dict[str, int]] = [defaultdict(int)]
    for form, n in sorted(counts.items()):
        at = 0
        for symbol in form:
            freq[at][symbol] += n
            if symbol not in child[at]:
                child[at][symbol] = len(child)
                child.append({})
                freq.append(defaultdict(int))
            at = child[at][symbol]
        freq[at][_END] += n
    bound = math.sqrt(0.5 * math.log(2 / alpha))

    def differ(a: int, b: int) -> bool:
        stack = [(a, b)]
        while stack:
            a, b = stack.pop()
            na, nb = sum(freq[a].values()), sum(freq[b].values())
            if not na or not nb:
                continue
            limit = bound * (1 / math.sqrt(na) + 1 / math.sqrt(nb))
            for s in freq[a].keys() | freq[b].keys():
                if abs(freq[a].get(s, 0) / na - freq[b].get(s, 0) / nb) > limit:
                    return True
                if s in child[a] and s in child[b]:
                    stack.append((child[a][s], child[b][s]))
        return False

    def fold(a: int, b: int) -> None:
        """Add the tree under b to the kept state a."""
        stack = [(a, b)]
        while stack:
            a, b = stack.pop()
            for s, n in freq[b].items():
                freq[a][s] += n
            for s, to in child[b].items():
                if s in child[a]:
                    stack.append((child[a][s], to))
                else:
                    child[a][s] = to

    red = [0]
    while True:
        known = set(red)
        blue = [(r, s, to) for r in red for s, to in sorted(child[r].items()) if to not in known]
        if not blue:
            break
        parent, symbol, state = blue[0]
        for r in red:
            if not differ(r, state):
                child[parent][symbol] = r
                fold(r, state)
                break
        else:
            red.append(state)
    number = {r: i for i, r in enumerate(red)}
    moves = []
    for r in red:
        total = sum(freq[r].values()) + 1e-9
        moves.append({s: (number.get(child[r].get(s), 0), math.log(n / total)) for s, n in freq[r].items()})
    return Automaton(moves or [{}])


@dataclass(frozen=True)
class Scanner:
    automata: dict[str, Automaton]
    ordinary: dict[str, float]
    threshold: float

    def score(self, run: str) -> tuple[float, str]:
        """Best log likelihood ratio over the kinds, and its kind."""
        form = format_of(run)
        plain = sum(self.ordinary.get(a + b, -9.0) for a, b in zip("^" + form, form + _END))
        return max(((a.log_likelihood(form) - plain, kind) for kind, a in self.automata.items()), default=(-math.inf, ""))

    def spans(self, text: str, known: list[tuple[int, int, str, str]], seen: dict[str, tuple[float, str]]) -> list[tuple[int, int, str]]:
        """Fixed spans and the candidates that clear the threshold outside them."""
        out = [(a, b, kind) for a, b, kind, _ in known]
        for m in _CANDIDATE.finditer(text):
            run = m[0]
            if run not in seen:
                if len(seen) > 50_000:
                    seen.clear()
                seen[run] = self.score(run)
            ratio, kind = seen[run]
            if ratio >= self.threshold and not any(a < m.end() and m.start() < b for a, b, _, _ in known):
                out.append((m.start(), m.end(), f"format_{kind}"))
        return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]) if s[2] in KINDS else len(KINDS), s[1], s[2]))


def learn(docs: DataFrame, sample: int = 400, threshold: float = 8.0, alpha: float = 0.05, longest: int = 512) -> Scanner:
    """Gather labelled credentials and the class pairs of ordinary runs from all texts, then infer an automaton a kind.

    Counts cover all rows. An automaton is fitted on at most `sample` distinct credentials of its kind of at most `longest`
    characters, the first by hash; those, and a few hundred pair counts, are all that comes to the driver. A kind without credentials has no automaton.
    """
    small_batches(docs.sparkSession)

    def gather(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[tuple[str, str], int] = defaultdict(int)
            for text in text_list(batch["text"]):
                spans = base_spans(text)
                for _, _, kind, credential in spans:
                    found[kind, credential] += 1
                for m in _CANDIDATE.finditer(text):
                    if not any(a < m.end() and m.start() < b for a, b, _, _ in spans):
                        form = format_of(m[0])
                        for a, b in zip("^" + form, form + _END):
                            found["pair", a + b] += 1
            yield pa.record_batch([pa.array([k for k, _ in found], pa.string()), pa.array([v for _, v in found], pa.string()), pa.array(list(found.values()), pa.int64())], names=["kind", "value", "n"])

    counts = materialize(docs.select("text").mapInArrow(gather, "kind string, value string, n long").groupBy("kind", "value").agg(F.sum("n").alias("n")), "credentials")
    pairs: dict[str, int] = {r["value"]: r["n"] for r in counts.where("kind = 'pair'").collect()}
    totals: dict[str, int] = defaultdict(int)
    for pair, n in pairs.items():
        totals[pair[0]] += n
    ordinary = {pair: math.log(n / totals[pair[0]]) for pair, n in pairs.items()}
    automata = {}
    for kind in KINDS:
        rows = counts.where((F.col("kind") == kind) & (F.length("value") <= longest)).orderBy(F.xxhash64("value"), "value").limit(sample).collect()
        if rows:
            formats: dict[str, int] = defaultdict(int)
            for r in rows:
                formats[format_of(r["value"])] += 1
            automata[kind] = infer(formats, alpha)
    return Scanner(automata, ordinary, threshold)


def scan(docs: DataFrame, scanner: Scanner | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every row; a null or empty text has no spans.

    Spans are kind:start:end in code points, by start, then kind, comma-joined; kinds named format_* are the method's.
    """
    small_batches(docs.sparkSession)
    scanner = scanner or learn(docs)

    def scanned(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, tuple[float, str]] = {}
        for batch in batches:
            counts: list[list[int]] = [[], [], []]
            digests, joined = [], []
            for text in text_list(batch["text"]):
                base = base_spans(text)
                for column, kind in zip(counts, KINDS, strict=True):
                    column.append(sum(s[2] == kind for s in base))
                digests.append(hashlib.sha256(",".join(f"{kind}:{a}:{b}" for a, b, kind, _ in base).encode()).hexdigest())
                joined.append(",".join(f"{kind}:{a}:{b}" for a, b, kind in scanner.spans(text, base, seen)))
            yield pa.record_batch([batch["doc_id"].cast(pa.int64()), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(joined, pa.string())], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.select("doc_id", "text").mapInArrow(scanned, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(text: str, spans: str, mark: str = "[SECRET]") -> str:
    """The text with every span replaced by the mark; spans that overlap become one."""
    out, at = [], 0
    for start, end in sorted((int(a), int(b)) for _, a, b in (s.split(":") for s in spans.split(",") if s)):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact_texts(docs: DataFrame, scanner: Scanner | None = None) -> DataFrame:
    """The columns of documents with every found secret replaced in text and n_chars set anew; all rows stay.

    Rows without secrets, null texts included, come back as they were.
    """
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text", "lang", "source", "n_chars")
    scanner = scanner or learn(docs)

    def redacted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, tuple[float, str]] = {}
        for batch in batches:
            texts, sizes = batch["text"].to_pylist(), batch["n_chars"].to_pylist()
            for i, text in enumerate(texts):
                if text and (found := scanner.spans(text, base_spans(text), seen)):
                    texts[i] = redact(text, ",".join(f"{kind}:{a}:{b}" for a, b, kind in found))
                    sizes[i] = len(texts[i])
            yield pa.record_batch([batch["doc_id"], pa.array(texts, pa.string()), batch["lang"], batch["source"], pa.array(sizes, pa.int64())], names=batch.schema.names)

    return docs.mapInArrow(redacted, docs.schema)
