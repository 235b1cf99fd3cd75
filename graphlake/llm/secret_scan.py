"""Secret scans by one automaton: all rules' regexes in a minimal DFA, one pass over the bytes.

compile_rules() parses each rule, joins their Thompson NFAs behind a loop over every byte, makes the
DFA by subset construction over byte classes and merges equal states by partition refinement; the
result is a transition array and a bit mask of accepting rules for each state. The pass over a text
gives, for each rule, the places where acceptance ends; the rule's reversed DFA, read from there
back to the end of its match before, gives the leftmost start. Hence matches per rule are leftmost,
longest and without overlap, as of a regex search, for rules whose matches end with one run that
accepts from its first character on (all rules here do). A match that is too short is dropped, but
what it covers is not searched again. Reading back stops where nothing can be accepted any more, so
a byte is read again only by rules whose match may hold it.

Base rules and cut keys are found independently of all others. Of the further rules only one runs on at a time:
from the first run of one on (its fixed beginning is over), others don't start inside it, so the sets
of states of the subset construction don't multiply; a credential glued to another may be found in part.

Spans are code points, end exclusive, of the whole match. Empty and null texts have none.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, slices, text_rows


@dataclass(frozen=True)
class Rule:
    """least: characters of the whole match, or of its closing run if tail; apart: found independently of all others, as base rules are."""

    kind: str
    pattern: str
    least: int
    tail: bool = False
    base: bool = False
    apart: bool = False


#: The base rules of the contract and public credential formats.
BASE = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", 6, tail=True, base=True),
    Rule("access", r"AKIA[A-Z0-9]+", 20, base=True),
    Rule("hex", r"[0-9a-f]{8,}", 24, base=True),  # shorter runs can't count, and need no states
)
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("github_fine", r"github_pat_[A-Za-z0-9_]+", 50),
    Rule("gitlab", r"glpat-[A-Za-z0-9_-]+", 26),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 20),
    Rule("slack_hook", r"hooks\.slack\.com/services/[A-Za-z0-9/]+", 60),
    Rule("google_key", r"AIza[A-Za-z0-9_-]+", 39),
    Rule("google_oauth", r"ya29\.[A-Za-z0-9_-]+", 30),
    Rule("stripe", r"[rs]k_(live|test)_[A-Za-z0-9]+", 24),
    Rule("sendgrid", r"SG\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 60),
    Rule("npm", r"npm_[A-Za-z0-9]+", 40),
    Rule("pypi", r"pypi-AgEI[A-Za-z0-9_-]+", 50),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 36),
    Rule("access_temporary", r"ASIA[A-Z0-9]+", 20),
    Rule("storage_key", r"AccountKey=[A-Za-z0-9+/=]+", 60),
    Rule("digitalocean", r"do[opr]_v1_[a-f0-9]+", 71),
    Rule("shopify", r"shp(at|ca|pa|ss)_[a-fA-F0-9]+", 38),
    Rule("model_hub", r"hf_[A-Za-z0-9]+", 37),
    Rule("databricks", r"dapi[a-f0-9]+", 36),
    Rule("vault", r"hvs\.[A-Za-z0-9_-]+", 28),
    Rule("docker", r"dckr_pat_[A-Za-z0-9_-]+", 36),
    Rule("atlassian", r"ATATT3[A-Za-z0-9_=-]+", 60),
    Rule("square", r"sq0(atp|csp)-[A-Za-z0-9_-]+", 29),
    Rule("telegram", r"bot[0-9]+:AA[A-Za-z0-9_-]+", 44),
    Rule("age", r"AGE-SECRET-KEY-1[A-Z0-9]+", 74),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\r\n]+(Proc-Type: 4,ENCRYPTED[\r\n]+DEK-Info: [A-Z0-9,-]+)?[A-Za-z0-9+/=\r\n]+-----END [A-Z ]*PRIVATE KEY-----", 60),
    Rule("pem_cut", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\r\n]*", 27, apart=True),
)
RULES = BASE + MORE


class Nfa:
    def __init__(self):
        self.loops: set[int] = set()
        self.on: list[list[tuple[frozenset[int], int]]] = []
        self.free: list[list[int]] = []

    def state(self) -> int:
        self.on.append([])
        self.free.append([])
        return len(self.on) - 1

    def add(self, tree, start: int, any_case: bool = False, reverse: bool = False) -> int:
        """Adds a parsed pattern after start; gives the state that it ends in."""
        for op, arg in reversed(list(tree)) if reverse else tree:
            name, end = str(op), self.state()
            if name in ("LITERAL", "IN", "ANY", "NOT_LITERAL"):
                self.on[start].append((byte_set(name, arg, any_case), end))
            elif name == "BRANCH":
                for branch in arg[1]:
                    self.free[self.add(branch, self.fork(start), any_case, reverse)].append(end)
            elif name == "SUBPATTERN":
                self.free[self.add(arg[3], start, any_case or bool(arg[1] & re.IGNORECASE), reverse)].append(end)
            elif name == "MAX_REPEAT":
                low, high, body = arg
                at = start
                for _ in range(low):
                    at = self.add(body, self.fork(at), any_case, reverse)
                if str(high) == "MAXREPEAT":
                    loop = self.fork(at)
                    self.free[self.add(body, loop, any_case, reverse)].append(loop)
                    self.loops.add(loop)
                    at = loop
                else:
                    for _ in range(high - low):
                        self.free[at].append(end)
                        at = self.add(body, self.fork(at), any_case, reverse)
                self.free[at].append(end)
            else:
                raise ValueError(f"{name} is not supported in a rule")
            start = end
        return start

    def fork(self, start: int) -> int:
        new = self.state()
        self.free[start].append(new)
        return new

    def closure(self, states: frozenset[int]) -> set[int]:
        seen, todo = set(states), list(states)
        while todo:
            for x in self.free[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return seen


def byte_set(name: str, arg, any_case: bool) -> frozenset[int]:
    if name == "ANY":
        return frozenset(range(256)) - {10}
    if name in ("LITERAL", "NOT_LITERAL"):
        found, negate = {arg}, name == "NOT_LITERAL"
    else:
        found, negate = set(), False
        for op, x in arg:
            if str(op) == "NEGATE":
                negate = True
            elif str(op) == "LITERAL":
                found.add(x)
            elif str(op) == "RANGE":
                found |= set(range(x[0], x[1] + 1))
            else:
                raise ValueError(f"{op} is not supported in a class")
    if any_case:
        found |= {ord(y) for x in found if x < 128 for y in (chr(x).lower(), chr(x).upper())}
    return frozenset(range(256)) - found if negate else frozenset(found)


@dataclass(frozen=True)
class Dfa:
    """classes: class of each byte; moves: next state by state and class; masks: accepting rules of each state.

    States that accept come last, from `accepts` on; state `start` starts.
    """

    classes: np.ndarray
    moves: np.ndarray
    masks: np.ndarray
    start: int
    accepts: int

    def flat(self) -> list[int]:
        """Next state times 256, by state times 256 plus byte; equal numbers are one object."""
        numbers = [s * 256 for s in range(len(self.moves))]
        return [numbers[s] for s in self.moves[:, self.classes].ravel().tolist()]

    def dead(self) -> int:
        """The state (times 256) that nothing leaves and that doesn't accept; -1 if there is none."""
        stays = (self.moves == np.arange(len(self.moves))[:, None]).all(axis=1) & (self.masks == 0)
        return int(np.flatnonzero(stays)[0]) * 256 if stays.any() else -1


def bits(number: int) -> list[int]:
    out = []
    while number:
        low = number & -number
        out.append(low.bit_length() - 1)
        number ^= low
    return out


def determinize(nfa: Nfa, start: int, accepting: dict[int, int], single: dict[int, int] | None = None) -> Dfa:
    """single: for states of which one group runs on at a time, the group; a set in which a group is in a loop keeps the first such one."""
    sets = list({chars for edges in nfa.on for chars, _ in edges})
    signature = [tuple(b in chars for chars in sets) for b in range(256)]
    kinds = {x: i for i, x in enumerate(dict.fromkeys(signature))}
    classes = np.array([kinds[x] for x in signature], np.int64)
    byte_of = [signature.index(x) for x in kinds]
    mask_of = lambda states: sum(1 << s for s in states)  # noqa: E731  sets of states are the bits of a number
    after = [mask_of(nfa.closure(frozenset([s]))) for s in range(len(nfa.on))]
    to = [[functools.reduce(int.__or__, (after[t] for chars, t in edges if b in chars), 0) for b in byte_of] if edges else None for edges in nfa.on]
    groups: dict[int, int] = {}
    for s, g in (single or {}).items():
        groups[g] = groups.get(g, 0) | 1 << s
    every = functools.reduce(int.__or__, groups.values(), 0)
    running = mask_of(s for s in (single or {}) if s in nfa.loops or s in accepting)

    def kept(states: int) -> int:
        if runs := states & running:
            first = next(g for g in sorted(groups) if groups[g] & runs)
            return states & ~every | states & groups[first]
        return states

    states = {kept(after[start]): 0}
    order, moves, held = list(states), [], {}
    for current in order:
        edges = [to[s] for s in bits(current) if to[s]]
        row = []
        for k in range(len(byte_of)):
            found = 0
            for e in edges:
                found |= e[k]
            target = held.get(found)
            if target is None:
                target = held[found] = kept(found)
            if target not in states:
                states[target] = len(order)
                order.append(target)
            row.append(states[target])
        moves.append(row)
    masks = np.array([sum(1 << r for r in {accepting[s] for s in bits(x) if s in accepting}) for x in order], np.int64)
    return minimize(classes, np.array(moves, np.int64), masks)


def minimize(classes: np.ndarray, moves: np.ndarray, masks: np.ndarray) -> Dfa:
    """Partition refinement: blocks split until all states of a block move to the same blocks."""
    _, block = np.unique(masks, return_inverse=True)
    weights = np.random.default_rng(1).integers(1, 2**63, moves.shape[1] + 1, np.uint64) * np.uint64(2) + np.uint64(1)
    while True:
        own = np.random.default_rng(2).integers(0, 2**63, block.max() + 1, np.uint64)[block]  # a row is known by a 64-bit sum
        _, finer = np.unique((own[moves] * weights[1:]).sum(axis=1, dtype=np.uint64) + own * weights[0], return_inverse=True)
        if finer.max() == block.max():
            break
        block = finer
    lead = np.unique(block, return_index=True)[1][block]
    if (block[moves] != block[moves[lead]]).any() or (masks != masks[lead]).any():
        raise ArithmeticError("two rows had the same sum")
    first = np.unique(block, return_index=True)[1]
    rank = np.empty(len(first), np.int64)
    rank[np.argsort(masks[first] != 0, kind="stable")] = np.arange(len(first))
    back = np.argsort(rank)
    return Dfa(classes, rank[block[moves[first]]][back], masks[first][back], int(rank[block[0]]), int((masks[first] == 0).sum()))


@cache
def compile_rules(rules: tuple[Rule, ...]) -> tuple[Dfa, list[Dfa], list[Dfa]]:
    """(all rules behind any bytes, each rule reversed, each rule from its first byte)."""
    from re import _parser

    parsed = [_parser.parse(r.pattern) for r in rules]
    nfa = Nfa()
    start = nfa.state()
    nfa.on[start].append((frozenset(range(256)), start))
    accepting, single = {}, {}
    for i, tree in enumerate(parsed):
        first = nfa.fork(start)
        accepting[nfa.add(tree, first)] = i
        if not (rules[i].base or rules[i].apart):
            single |= dict.fromkeys(range(first + 1, len(nfa.on)), i)
    every = determinize(nfa, start, accepting, single)

    def alone(tree, reverse: bool) -> Dfa:
        one = Nfa()
        first = one.state()
        return determinize(one, first, {one.add(tree, one.fork(first), reverse=reverse): 0})

    return every, [alone(t, True) for t in parsed], [alone(t, False) for t in parsed]


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = RULES, compiled: tuple | None = None):
        every, back, ahead = compiled or compile_rules(rules)
        self.rules, self.moves, self.start, self.accepts = rules, every.flat(), every.start * 256, every.accepts * 256
        self.masks = every.masks.tolist()
        self.back = [(d.flat(), d.start * 256, d.accepts * 256, d.dead()) for d in back]
        self.ahead = [(d.flat(), d.start * 256, d.accepts * 256) for d in ahead]

    def ends(self, data: bytes) -> list[tuple[int, int]]:
        """(rule, end) wherever a rule stops accepting; one pass over the bytes for all rules."""
        moves, accepts, masks, s, found, active = self.moves, self.accepts, self.masks, self.start, [], 0
        steps = enumerate(data)
        for _, b in steps:
            s = moves[s + b]
            if s >= accepts:
                active = masks[s >> 8]
                for i, c in steps:
                    s = moves[s + c]
                    now = masks[s >> 8]
                    if gone := active & ~now:
                        found += [(r, i) for r in range(len(self.rules)) if gone >> r & 1]
                    active = now
                    if not now:
                        break
        return found + [(r, len(data)) for r in range(len(self.rules)) if active >> r & 1]

    def scan(self, text: str) -> list[tuple[int, int, int]]:
        """(start, rule, end) of each kept match, ordered by start and rule."""
        data = text.encode("utf-8", "surrogatepass")
        found, done = [], [0] * len(self.rules)
        for rule, end in self.ends(data):
            moves, s, accepts, dead = self.back[rule]
            start = -1
            for i in range(end - 1, done[rule] - 1, -1):
                s = moves[s + data[i]]
                if s >= accepts:
                    start = i
                elif s == dead:
                    break
            if start < 0:
                continue
            done[rule], size = end, end - start
            if self.rules[rule].tail:
                moves, s, accepts = self.ahead[rule]
                for i in range(start, end):
                    s = moves[s + data[i]]
                    if s >= accepts:
                        size = end - i
                        break
            if size >= self.rules[rule].least:
                found.append((start, rule, end))
        found.sort()
        if len(data) != len(text):  # places in code points: bytes that don't continue a character
            before = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)]) if found else None
            found = [(int(before[a]), r, int(before[b])) for a, r, b in found]
        return found


def spans_text(spans: list[tuple[int, int, int]], rules: tuple[Rule, ...]) -> str:
    return ",".join(f"{rules[r].kind}:{a}:{b}" for a, r, b in spans)


def scan_documents(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, n_<kind> of each base rule, base_sha256, spans)."""
    base = [i for i, r in enumerate(rules) if r.base]
    schema = "doc_id long, " + "".join(f"n_{rules[i].kind} long, " for i in base) + "base_sha256 string, spans string"
    out, compiled = arrow_schema(schema), compile_rules(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules, compiled)
        for batch in batches:
            for rows in slices(batch):
                found = [scanner.scan(t) for t in rows.column("text").to_pylist()]
                counts = [[sum(r == i for _, r, _ in f) for f in found] for i in base]
                own = [hashlib.sha256(spans_text([s for s in f if rules[s[1]].base], rules).encode()).hexdigest() for f in found]
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(own), pa.array([spans_text(f, rules) for f in found])], schema=out)

    return text_rows(docs).mapInArrow(run, schema)


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[SECRET]") -> DataFrame:
    """docs with each span in text (overlapping ones joined) replaced by mark, and n_chars as it is then.

    Null texts stay null; other columns stay as they are.
    """
    schema = docs.schema
    out, compiled = arrow_schema_of(docs), compile_rules(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules, compiled)
        for batch in batches:
            for rows in slices(batch):
                texts = rows.column("text").to_pylist()
                clean = [t if not t else covered(t, scanner.scan(t), mark) for t in texts]
                columns = {n: rows.column(i) for i, n in enumerate(rows.schema.names)} | {"text": pa.array(clean, out.field("text").type)}
                if "n_chars" in columns:
                    old = columns["n_chars"].to_pylist()
                    columns["n_chars"] = pa.array([o if a == b else len(b) for o, a, b in zip(old, texts, clean, strict=True)], out.field("n_chars").type)
                yield pa.RecordBatch.from_arrays([columns[f.name] for f in out], schema=out)

    return docs.mapInArrow(run, schema)


def arrow_schema_of(df: DataFrame) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(df.schema)


def covered(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    parts, at, end = [], 0, -1
    for a, _, b in spans:
        if a >= end:
            if end >= 0:
                at = end
            parts += [text[at:a], mark]
        end = max(end, b)
    return "".join([*parts, text[end:]]) if spans else text


def contains_secret(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id of the documents with a span."""
    return scan_documents(docs, rules).where(F.col("spans") != "").select("doc_id")
