"""Secret scans with one deterministic automaton for all rules."""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parser
from collections.abc import Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docgate.llm.common import flat, fresh, slices


@dataclass(frozen=True)
class Body:
    """What may stand behind a match and belongs to it: all up to the first of `marks`, if that is also one of `last` (with the bytes of
    `rest` behind it), else the longest stretch that `lines` matches, where \\xff stands for the end of the text.

    marks and last are a head and a tail like those of a rule and are followed by the same automaton."""

    marks: tuple[str, str]
    last: tuple[str, str]
    rest: bytes
    lines: str


@dataclass(frozen=True)
class Rule:
    """A secret of a kind: bytes that `head` matches, then the longest run of one or more bytes of the class `tail`.

    Matches are leftmost and don't overlap within a rule. One with a run of fewer than `min_tail` bytes, or of fewer than
    `min_total` bytes in all, is dropped, but its bytes stay used up, as when matches of head+tail are filtered. A `body` behind
    a match belongs to it, too."""

    kind: str
    head: str
    tail: str
    min_tail: int = 1
    min_total: int = 1
    body: Body | None = None


BASE_RULES = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", "[A-Za-z0-9+/_.=-]", min_tail=6),
    Rule("access", "AKIA", "[A-Z0-9]", min_total=20),
    Rule("hex", "[0-9a-f]{23}", "[0-9a-f]"),
)
#: Behind the first line of a private key: all up to its last line, or, if another key or the end of the text comes before,
#: what still looks like one: fields of the head, then lines (or their escaped forms) of which the first is as long as keys have them
#: (64, 70, 76, or all in one).
_LINE = r"(?:[\x20\t>]|\\[rnt]|[\r\n])"
_KEY = "[A-Za-z0-9+/]"
KEY_BODY = Body(
    ("-----(?:BEGIN|END)", r"\x20"),
    (r"-----END\x20[A-Z0-9\x20]*PRIVATE\x20KE", "Y"),
    b" BLOCK-",
    rf"{_LINE}+(?:[A-Z][A-Za-z-]*:\x20[^\r\n\\\xff]*{_LINE}+)*(?:{_KEY}{{120}}{_KEY}*=*|{_KEY}{{76}}|{_KEY}{{70}}|{_KEY}{{64}})"
    rf"(?:\xff|{_LINE}(?:{_LINE}*{_KEY}{{16}}{_KEY}*=*(?:{_LINE}+{_KEY}{{16}}{_KEY}*=*)*)?(?:{_LINE}+{_KEY}*=[A-Za-z0-9+/=]*)*(?:{_LINE}+[A-Za-z0-9+/=]+\xff)?)",
)
RULES = BASE_RULES + (
    Rule("github", "gh[oprsu]_", "[A-Za-z0-9]", min_tail=36),
    Rule("slack", "xox[abprs]-", "[A-Za-z0-9-]", min_tail=10),
    Rule("google", "AIza", "[A-Za-z0-9_-]", min_tail=35),
    Rule("pem", "-----BEGIN (?:RSA |EC |DSA |OPENSSH |ENCRYPTED |PGP )?PRIVATE KEY(?: BLOCK)?----", "-", body=KEY_BODY),
)


def _bytes_of(items, fold: bool) -> frozenset[int]:
    found, negate = set(), False
    for op, arg in items:
        if op is sre.NEGATE:
            negate = True
        elif op is sre.LITERAL:
            found.add(arg)
        elif op is sre.RANGE:
            found.update(range(arg[0], arg[1] + 1))
        else:
            raise ValueError(f"rules can't hold {op}")
    if fold:
        found |= {ord(x) for b in found if b < 128 for x in (chr(b).lower(), chr(b).upper())}
    return frozenset(set(range(256)) - found if negate else found)


class _Nfa:
    """Thompson construction: edges[s] has (bytes, target) and free[s] the targets of empty moves."""

    def __init__(self) -> None:
        self.edges: list[list[tuple[frozenset[int], int]]] = []
        self.free: list[list[int]] = []

    def state(self) -> int:
        self.edges.append([])
        self.free.append([])
        return len(self.edges) - 1

    def add(self, items, at: int, fold: bool = False) -> int:
        """The state after `items`, begun in state `at`."""
        for op, arg in items:
            if op in (sre.LITERAL, sre.NOT_LITERAL, sre.IN):
                chars = arg if op is sre.IN else [(sre.LITERAL, arg)]
                at = self.edge(at, _bytes_of([(sre.NEGATE, None), *chars] if op is sre.NOT_LITERAL else chars, fold))
            elif op is sre.SUBPATTERN:
                at = self.add(arg[3], at, fold or bool(arg[1] & sre.SRE_FLAG_IGNORECASE))
            elif op is sre.BRANCH:
                end = self.state()
                for branch in arg[1]:
                    self.free[self.add(branch, at, fold)].append(end)
                at = end
            elif op is sre.MAX_REPEAT:
                low, high, inner = arg
                for _ in range(low):
                    at = self.add(inner, at, fold)
                if high is sre.MAXREPEAT:
                    loop = self.state()
                    self.free[at].append(loop)
                    self.free[self.add(inner, loop, fold)].append(loop)
                    at = loop
                else:
                    end = self.state()
                    for _ in range(high - low):
                        self.free[at].append(end)
                        at = self.add(inner, at, fold)
                    self.free[at].append(end)
                    at = end
            else:
                raise ValueError(f"rules can't hold {op}")
        return at

    def edge(self, at: int, chars: frozenset[int]) -> int:
        to = self.state()
        self.edges[at].append((chars, to))
        return to

    def closed(self, states) -> frozenset[int]:
        found, todo = set(states), list(states)
        while todo:
            for t in self.free[todo.pop()]:
                if t not in found:
                    found.add(t)
                    todo.append(t)
        return frozenset(found)

    def moved(self, states, byte: int) -> frozenset[int]:
        return self.closed({t for s in states for chars, t in self.edges[s] if byte in chars})


def _minimised(table: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal states merged, by refinement of the partition by marks; state 0 stays the start and marked states come last."""
    part = np.unique(marks, return_inverse=True)[1]
    while True:
        finer = np.unique(np.column_stack([part, part[table]]), axis=0, return_inverse=True)[1].reshape(-1)
        if finer.max() == part.max():
            break
        part = finer
    first = np.unique(part, return_index=True)[1]
    order = np.lexsort((first, marks[first] != 0))  # the start is the first state, and without a mark
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return rank[part[table[first[order]]]], marks[first[order]]


@dataclass(frozen=True)
class Automaton:
    """classes: byte -> class; table: state * width + class -> next state * width; marks: state -> bits of the rules whose
    tail the state is in; from `marked` on states have marks; reset: classes that lead from any state to the start; back: each rule's
    head backwards; bodies: of rules with a body the numbers of its marks and of its last line as rules, and the moves and ends of `lines`."""

    rules: tuple[Rule, ...]
    classes: np.ndarray
    width: int
    table: np.ndarray
    marks: np.ndarray
    marked: int
    reset: np.ndarray
    back: tuple[tuple[np.ndarray, np.ndarray], ...]
    bodies: dict[int, tuple[int, int, np.ndarray, np.ndarray]]


def _explore(start, step, alphabet: Sequence[int]) -> tuple[list, np.ndarray]:
    """Subset construction: the states reached from `start`, and their moves by one byte of each class."""
    found, todo, rows = {start: 0}, [start], []
    while len(rows) < len(todo):
        row = []
        for b in alphabet:
            to = step(todo[len(rows)], b)
            if to not in found:
                found[to] = len(todo)
                todo.append(to)
            row.append(found[to])
        rows.append(row)
    return todo, np.array(rows, np.int64)


def _reversed(items) -> list:
    """The parsed pattern backwards."""
    out = []
    for op, arg in reversed(list(items)):
        if op is sre.SUBPATTERN:
            arg = (*arg[:3], _reversed(arg[3]))
        elif op is sre.BRANCH:
            arg = (arg[0], [_reversed(b) for b in arg[1]])
        elif op is sre.MAX_REPEAT:
            arg = (arg[0], arg[1], _reversed(arg[2]))
        out.append((op, arg))
    return out


def _classes(sets: set[frozenset[int]]) -> tuple[np.ndarray, list[int]]:
    """The class of each byte, where bytes of a class are in the same of the sets, and a byte of each class."""
    kinds: dict[tuple, int] = {}
    classes = np.array([kinds.setdefault(tuple(b in s for s in sets), len(kinds)) for b in range(256)], np.uint8)
    return classes, [int(np.flatnonzero(classes == c)[0]) for c in range(len(kinds))]


def compile_rules(rules: Sequence[Rule] = RULES) -> Automaton:
    return _compiled(tuple(rules))


@lru_cache(4)
def _compiled(rules: tuple[Rule, ...]) -> Automaton:
    """One minimal automaton that follows all rules at once.

    A state holds, for each rule, either that its tail is being read or the positions in its head of all matches that
    may have begun. When a tail ends, that rule begins anew with the byte that ended it."""
    heads, tails, bodies, followed = [], [], {}, list(rules)
    for i, r in enumerate(rules):
        if r.body:
            bodies[i] = (len(followed), len(followed) + 1)
            followed += [Rule("", *r.body.marks), Rule("", *r.body.last)]
    for r in followed:
        nfa = _Nfa()
        start = nfa.state()
        heads.append((nfa, nfa.closed([start]), nfa.add(sre_parser.parse(r.head), start)))
        (op, arg), = sre_parser.parse(r.tail)
        tails.append(_bytes_of(arg if op is sre.IN else [(op, arg)], False))
    classes, alphabet = _classes({chars for nfa, _, _ in heads for edges in nfa.edges for chars, _ in edges} | set(tails))
    in_tail = "tail"

    def step(state, byte):
        out = []
        for (nfa, begin, end), tail, own in zip(heads, tails, state, strict=True):
            if own == in_tail:
                if byte in tail:
                    out.append(in_tail)
                    continue
                own = frozenset()
            own = own | begin
            out.append(in_tail if end in own and byte in tail else nfa.moved(own, byte))
        return tuple(out)

    states, table = _explore(tuple(frozenset() for _ in followed), step, alphabet)
    marks = np.array([sum(1 << i for i, own in enumerate(s) if own == in_tail) for s in states], np.int64)
    table, marks = _minimised(table, marks)
    width = len(alphabet)
    back = []
    for r in followed:
        nfa = _Nfa()
        start = nfa.state()
        end = nfa.add(_reversed(sre_parser.parse(r.head)), start)
        subsets, moves = _explore(nfa.closed([start]), nfa.moved, alphabet)
        back.append((moves, np.array([0 if not s else 2 if end in s else 1 for s in subsets])))
    for i in bodies:
        nfa = _Nfa()
        start = nfa.state()
        end = nfa.add(sre_parser.parse(rules[i].body.lines), start)
        own, some = _classes({chars for edges in nfa.edges for chars, _ in edges})
        subsets, moves = _explore(nfa.closed([start]), nfa.moved, some)
        bodies[i] += (moves[:, own], np.array([0 if not s else 2 if end in s else 1 for s in subsets]))
    return Automaton(
        tuple(rules), classes, width, (table * width).astype(np.int32).reshape(-1), marks.astype(np.int32),
        int(np.argmax(marks != 0)), (table == 0).all(axis=0), tuple(back), bodies,
    )


#: Bytes of text that one lane reads, about; lanes left when fewer than FEW go on are finished byte by byte.
LANE, FEW = 384, 6


def _tails(auto: Automaton, classes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in tails and the rules' bits there. The automaton reads many stretches of the texts side by side, one
    byte of each at a time; a stretch begins with a text or behind a byte after which any state is the start."""
    n = len(classes)
    cuts = np.flatnonzero(auto.reset[classes]) + 1
    grid = np.searchsorted(cuts, np.arange(LANE, n, LANE))
    starts = np.unique(np.concatenate([offsets[:-1], cuts[grid[grid < len(cuts)]]]))
    starts = starts[starts < n]
    sizes = np.diff(np.append(starts, n))
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    going = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), side="right") if len(sizes) else np.zeros(0, int)
    state, table, first = np.zeros(len(starts), np.int32), auto.table, auto.marked * auto.width
    at, found, step = starts.copy(), [], 0
    while step < len(going) and going[step] >= FEW:
        k = going[step]
        now = table[state[:k] + classes[at[:k]]]
        state[:k] = now
        if now.max() >= first:
            hit = np.flatnonzero(now >= first)
            found.append((at[hit], now[hit] // auto.width))
        at[:k] += 1
        step += 1
    if step < len(going):
        moves = table.tolist()
        for lane in range(going[step]):
            s, p, out = int(state[lane]), int(at[lane]), []
            for c in classes[p : starts[lane] + sizes[lane]].tolist():
                s = moves[s + c]
                if s >= first:
                    out.append((p, s // auto.width))
                p += 1
            if out:
                found.append(tuple(np.array(out).T))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    where, states = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(where, kind="stable")
    return where[order], auto.marks[states[order]]


def _begin(auto: Automaton, rule: int, classes: np.ndarray, low: int, at: int) -> int:
    """The leftmost position from `low` on from which the rule's head reaches to `at`."""
    moves, ends = auto.back[rule]
    state, best = 0, at if ends[0] == 2 else -1
    while at > low:
        at -= 1
        state = moves[state, classes[at]]
        if not ends[state]:
            break
        if ends[state] == 2:
            best = at
    return best


def _lines_end(moves: np.ndarray, ends: np.ndarray, data: np.ndarray, at: int, stop: int) -> int:
    """The end of the longest stretch from `at` on that the moves accept, `at` if there is none."""
    state, best = 0, at
    while at < stop:
        state = moves[state, data[at]]
        if not ends[state]:
            return best
        at += 1
        if ends[state] == 2:
            best = at
    return stop if ends[moves[state, 0xFF]] == 2 else best


def _body_end(auto: Automaton, rule: int, classes: np.ndarray, data: np.ndarray, where: np.ndarray, marks: np.ndarray, at: int, stop: int) -> int:
    """The end of what belongs to a match of the rule that ends at `at`, in a text that ends at `stop`."""
    mark, last, moves, ends = auto.bodies[rule]
    later = slice(*np.searchsorted(where, [at, stop]))
    of = lambda r: where[later][(marks[later] >> r & 1).astype(bool)]
    marked = of(mark)
    if len(marked):
        begins = _begin(auto, mark, classes, at, int(marked[0]))
        for end in of(last).tolist():
            if _begin(auto, last, classes, at, end) != begins:
                break
            block, dash = auto.rules[rule].body.rest[:-1], auto.rules[rule].body.rest[-1]
            end += 1
            if data[end : min(end + len(block), stop)].tobytes() == block:
                end += len(block)
            while end < stop and data[end] == dash:
                end += 1
            return end
    return _lines_end(moves, ends, data, at, stop)


def scan(auto: Automaton, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """document, rule, start and end (in code points of its text) of each secret, by document, start and rule."""
    classes = auto.classes[data]
    where, marks = _tails(auto, classes, offsets)
    spans = []
    for r, rule in enumerate(auto.rules):
        p = where[(marks >> r & 1).astype(bool)]
        if not len(p):
            continue
        docs = np.searchsorted(offsets, p, side="right") - 1
        new = np.append(True, (np.diff(p) != 1) | (np.diff(docs) != 0))
        firsts, lasts = np.flatnonzero(new), np.append(np.flatnonzero(new)[1:], len(p)) - 1
        doc, used = -1, 0
        for a, b, d in zip(p[firsts].tolist(), p[lasts].tolist(), docs[firsts].tolist(), strict=True):
            low = max(used, int(offsets[d])) if d == doc else int(offsets[d])
            start, end = _begin(auto, r, classes, low, a), b + 1
            if rule.body:
                end = _body_end(auto, r, classes, data, where, marks, end, int(offsets[d + 1]))
            doc, used = d, end
            if end - a >= rule.min_tail and end - start >= rule.min_total:
                spans.append((d, start, r, end))
    if not spans:
        return (np.zeros(0, np.int64),) * 4
    doc, start, rule, end = np.array(sorted(spans), np.int64).T
    leads = np.cumsum((data & 0xC0) != 0x80)  # code points begun up to each byte
    points = np.concatenate([[0], leads])
    return doc, rule, points[start] - points[offsets[doc]], points[end] - points[offsets[doc]]


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def find_secrets(docs: DataFrame, rules: Sequence[Rule] = RULES, name: str = "secrets") -> DataFrame:
    """The columns of docs and the column `name`, an array of (kind, start, end) by start, then in the rules' order.

    Positions are code points, the end exclusive. A null or empty text has an empty array. A column that is named so already
    is replaced; other columns and repeated rows pass through. No rows give no rows. Each text is read once, in a map
    without a shuffle."""
    auto = compile_rules(rules)
    kinds = pa.array([r.kind for r in auto.rules], pa.string())
    rest = docs.drop(name)
    if "text" not in rest.columns:
        raise ValueError("documents need a column text")
    names = rest.columns

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = flat(part.column("text"))
                doc, rule, start, end = scan(auto, data, offsets)
                values = pa.StructArray.from_arrays([kinds.take(pa.array(rule)), pa.array(start), pa.array(end)], ["kind", "start", "end"])
                bounds = np.searchsorted(doc, np.arange(part.num_rows + 1)).astype(np.int32)
                found = pa.ListArray.from_arrays(pa.array(bounds), values)
                yield pa.RecordBatch.from_arrays([*part.columns, found], [*names, name])

    return rest.mapInArrow(run, T.StructType(rest.schema.fields + [T.StructField(name, SPANS)]))


def said(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def mask_secrets(docs: DataFrame, rules: Sequence[Rule] = RULES, mask: str = "[SECRET]") -> DataFrame:
    """docs with every secret in `text` replaced by `mask`; overlapping spans, of different rules, give one mask.

    Other columns, repeated rows and texts without a secret, null and empty ones included, pass unchanged; no rows give none."""
    names = docs.columns
    spans = fresh(docs, "spans")
    found = find_secrets(docs, rules, spans)
    kind = "struct<done:bigint,out:array<string>>"

    def add(acc: Column, s: Column) -> Column:
        piece = F.substring("text", (acc["done"] + 1).cast("int"), (s["start"] - acc["done"]).cast("int"))
        apart = F.struct(s["end"].alias("done"), F.concat(acc["out"], F.array(piece, F.lit(mask))).alias("out"))
        over = F.struct(F.greatest(acc["done"], s["end"]).alias("done"), acc["out"].alias("out"))
        return F.when((s["start"] >= acc["done"]) | (F.size(acc["out"]) == 0), apart).otherwise(over).cast(kind)

    folded = F.aggregate(spans, F.struct(F.lit(0).cast("bigint").alias("done"), F.array().cast("array<string>").alias("out")).cast(kind), add)
    rest = F.substring("text", (folded["done"] + 1).cast("int"), F.char_length("text"))
    masked = F.when(F.size(spans) > 0, F.concat(F.array_join(folded["out"], ""), rest)).otherwise(F.col("text"))
    return found.withColumn("text", masked).select(*[F.col(f"`{n}`") for n in names])
