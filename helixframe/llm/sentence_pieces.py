"""SentencePiece encoding and decoding as weighted finite-state transduction.

A model file is compiled into transducers: the normaliser (white space to U+2581, a dummy prefix, and optionally fewer
blanks), the pieces (a trie that returns to its root; an arc path costs minus the piece's score) and byte fallback (a
character that no piece holds goes through its bytes at the cost of an unknown piece). A text is composed with them and
takes the shortest path in the tropical semiring: all arcs of the composition lead forward, so its states are relaxed in
the order of their places (least sum of costs; ties: the longer last piece).

For a model of merge type (byte-pair encoding), whose scores are the ranks of its merges, the pieces are also composed
with an acceptor of neighbours: two pieces may follow each other only if merging their joint text, least cost first,
gives just these two. So a state is a place and the piece that ends there. A cut of a word into pieces is the result of
its merges if and only if every two neighbours are such a pair, so one path has a finite cost, and it is the model's own.

As no piece holds U+2581 behind another sign, every path passes the state before such a sign: a text is composed word
by word, and the paths of frequent words are kept.
"""

import re
import struct
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import only, prepare, read, wider

SPACE = "▁"
#: Kept paths and pairs of neighbours of a worker (some 80 and 60 MB); beyond that it begins anew.
KEPT, PAIRS = 300_000, 700_000
#: Characters of texts that are encoded together.
CHUNK = 1 << 20
#: Added to the cost of the worst piece for a character outside of all pieces.
UNKNOWN = 10.0
NORMAL, UNK, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def fields(b: bytes):
    """(field number, value) of a serialised protocol buffer message."""
    i = 0

    def varint():
        nonlocal i
        out = shift = 0
        while True:
            c = b[i]
            i += 1
            out |= (c & 127) << shift
            shift += 7
            if c < 128:
                return out

    while i < len(b):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        n = {1: 8, 5: 4}.get(kind) or varint()
        yield key >> 3, b[i : i + n]
        i += n


def normaliser(prefix: bool, squeeze: bool, escape: bool) -> dict[tuple[int, bool], tuple[int, str, bool]]:
    """Transducer of a text's signs: (state, is a blank) to (state, output, whether the sign itself follows).
    States: 0 before the text, 1 in it, 2 behind blanks that are put out only if another sign comes."""
    blank = SPACE if escape else " "
    lead = blank if prefix else ""
    if squeeze:
        return {(0, True): (0, "", False), (0, False): (1, lead, True), (1, True): (2, "", False), (1, False): (1, "", True), (2, True): (2, "", False), (2, False): (1, blank, True)}
    return {(0, True): (1, lead + blank, False), (0, False): (1, lead, True), (1, True): (1, blank, False), (1, False): (1, "", True)}


class Paths(dict):
    """Paths of words, found when they are first asked for."""

    def __init__(self, path):
        super().__init__()
        self.path = path

    def __missing__(self, word):
        p = self[word] = self.path(word)
        return p


class Transducer:
    """Compiled model: encode(text) and decode(ids)."""

    def __init__(self, model: bytes):
        self.pieces, norm, self.merges = [], {}, False
        for f, v in fields(model):
            if f == 1:
                p = dict(fields(v))
                self.pieces.append((p[1].decode(), struct.unpack("<f", p[2])[0] if 2 in p else 0.0, p.get(3, NORMAL)))
            elif f == 2:
                self.merges = dict(fields(v)).get(3, 1) == 2
            elif f == 3:
                norm = dict(fields(v))
        if norm.get(2):
            raise ValueError("models with a character map in their normaliser are not supported")
        self.prefix, self.squeeze, self.escape = norm.get(3, 1), norm.get(4, 1), norm.get(5, 1)
        self.normaliser = normaliser(self.prefix, self.squeeze, self.escape)
        self.byte = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(self.pieces) if k == BYTE}
        self.unk = next((i for i, (_, _, k) in enumerate(self.pieces) if k == UNK), 0)
        usable = [(p, -s, i) for i, (p, s, k) in enumerate(self.pieces) if k in (NORMAL, USER) and p]
        self.unknown = max((c for _, c, _ in usable), default=0.0) + UNKNOWN
        self.trie: dict = {}
        for p, c, i in usable:
            at = self.trie
            for ch in p:
                at = at.setdefault(ch, {})
            at[""] = (c, i)
        cross = any(SPACE in p.lstrip(SPACE) for p, _, _ in usable)
        self.words = re.compile(r"(?s).+" if cross else f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
        self.out = [bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else p.replace(SPACE, " ").encode() for p, _, k in self.pieces]
        self.start = np.concatenate([[0], np.cumsum([len(x) for x in self.out])])
        self.flat = np.frombuffer(b"".join(self.out), np.uint8)
        self.kept = Paths(self.path)
        self.cost = {p: c for p, c, _ in usable}
        self.ids = {p: i for p, _, i in usable}
        self.longest = max(map(len, self.ids), default=1)
        self.pairs: dict[int, bool] = {}
        self.rim: dict[str, tuple | None] = {}

    def normalise(self, text: str) -> str:
        """The normaliser's output, by substitutions of whole runs; ``transduce`` goes through it sign by sign."""
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        if self.prefix and text:
            text = " " + text
        return text.replace(" ", SPACE) if self.escape else text

    def transduce(self, text: str) -> str:
        state, out = 0, []
        for c in text:
            state, put, same = self.normaliser[state, c == " "]
            out += [put, c] if same else [put]
        return "".join(out)

    def merged(self, text: str) -> list[str]:
        """Pieces of a short text by merges of least cost, the leftmost first among equals (what ``neighbours`` tells of two
        pieces without merging them)."""
        parts, inf = list(text), float("inf")
        while len(parts) > 1:
            costs = [self.cost.get(a + b, inf) for a, b in zip(parts, parts[1:], strict=False)]
            low = min(costs)
            if low == inf:
                break
            i = costs.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def rims(self, p: str):
        """(first parts, their costs, last parts, their costs, regular) while the merges build piece p: the cost of a part
        is that of the merge which takes it in. None if merging does not give p. Regular: costs never fall."""
        got = self.rim.get(p, ())
        if got != ():
            return got
        parts, first, last, lows = list(p), [], [], []
        heads, tails = [p[0]], [p[-1]]
        while len(parts) > 1:
            costs = [self.cost.get(a + b, float("inf")) for a, b in zip(parts, parts[1:], strict=False)]
            low = min(costs)
            if low == float("inf"):
                break
            i = costs.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            lows.append(low)
            if i == 0:
                first.append(low)
                heads.append(parts[0])
            if i == len(parts) - 1:
                last.append(low)
                tails.append(parts[-1])
        inf = [float("inf")]
        got = self.rim[p] = (heads, first + inf, tails, last + inf, lows == sorted(lows)) if len(parts) == 1 else None
        return got

    def neighbours(self, a: str, b: str) -> bool:
        """Whether merging a and b together gives just a and b: no merge over their border may come before the next merge
        of either side; of equal ones the left comes first."""
        x, y = self.rims(a) if a else True, self.rims(b)
        if not x or not y or not a:
            return bool(x and y)
        if not (x[4] and y[4]):
            return self.merged(a + b) == [a, b]
        (_, _, tails, to_a, _), (heads, to_b, _, _, _), inf = x, y, float("inf")
        i = j = 0
        while True:
            over, left, right = self.cost.get(tails[i] + heads[j], inf), to_a[i], to_b[j]
            if over < left and over <= right:
                return False
            if left == right == inf:
                return True
            if left <= right:
                i += 1
            else:
                j += 1

    def arcs(self, word: str, i: int):
        """(end, cost, id) of the pieces that begin at place i; the fallback of its sign (id None) if it is no piece."""
        at, j, lone = self.trie, i, True
        while j < len(word):
            at = at.get(word[j])
            if at is None:
                break
            j += 1
            end = at.get("")
            if end is not None:
                lone = lone and j > i + 1
                yield j, *end
        if lone:
            yield i + 1, self.unknown, None

    def path(self, word: str) -> tuple[int, ...]:
        """Shortest path through the composition with one word."""
        n = len(word)
        before, pieces = self.with_acceptor(word) if self.merges else self.relaxed(word)
        out = []
        while n:
            if pieces[n] is not None:
                out.append(pieces[n])
            else:
                out += [self.byte.get(b, self.unk) for b in reversed(word[before[n] : n].encode())] if self.byte else [self.unk]
            n = before[n]
        return tuple(reversed(out))

    def relaxed(self, word: str):
        """(place before, id) of the best arc into each place."""
        n = len(word)
        best, before, pieces = [0.0] + [float("inf")] * n, [0] * (n + 1), [None] * (n + 1)
        for i in range(n):
            for j, cost, piece in self.arcs(word, i):
                if best[i] + cost < best[j]:
                    best[j], before[j], pieces[j] = best[i] + cost, i, piece
        return before, pieces

    def with_acceptor(self, word: str):
        """The same with the acceptor of neighbours: a state is a place and the last piece. The pieces of a finite path to
        a place are the merges' result for the word up to there, so a place has one state of finite cost at most."""
        n, pairs, trie, size = len(word), self.pairs, self.trie, len(self.pieces)
        before, pieces = [None] * (n + 1), [None] * (n + 1)
        before[0] = 0
        for i in range(n):
            if before[i] is None:
                continue
            # pairs are kept by ids; no piece holds a sign that is none, so all such signs are one neighbour
            a = (size if not i else size + 1 if pieces[i] is None else pieces[i]) * size
            at, j = trie, i
            while j < n:
                at = at.get(word[j])
                if at is None:
                    break
                j += 1
                end = at.get("")
                if end is not None and before[j] is None:
                    ok = pairs.get(a + end[1])
                    if ok is None:
                        if len(pairs) >= PAIRS:
                            pairs.clear()
                        ok = pairs[a + end[1]] = self.neighbours(word[before[i] : i], word[i:j])
                    if ok:
                        before[j], pieces[j] = i, end[1]
            if before[i + 1] is None and word[i] not in self.ids:
                before[i + 1] = i
        return before, pieces

    def encode(self, text: str) -> np.ndarray:
        return self.checked(text)[0]

    def checked(self, text: str) -> tuple[np.ndarray, bool]:
        """Ids of a text, and whether the finished ids decode to its normal form."""
        ids, good = self.checked_all([text])
        return ids[0], good[0]

    def checked_all(self, texts: list[str]) -> tuple[list[np.ndarray], list[bool]]:
        """The same for many texts, whose ids are decoded together."""
        if len(self.kept) >= KEPT:
            self.kept.clear()
        whole = [self.normalise(t) for t in texts]
        ids = [np.fromiter(chain.from_iterable(map(self.kept.__getitem__, self.words.findall(t))), np.int32) for t in whole]
        want = [t.replace(SPACE, " ").encode() for t in whole]
        flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        size = self.start[flat + 1] - self.start[flat]
        end = np.cumsum(size)
        back = self.flat[np.repeat(self.start[flat] - (end - size), size) + np.arange(end[-1] if len(end) else 0)].tobytes()
        at = np.concatenate([[0], end])[np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(int)]
        return ids, [back[a:b] == w for a, b, w in zip(at, at[1:], want, strict=False)]

    def decode(self, ids) -> str:
        """Text of ids. Each U+2581 of a text comes back as a blank; bytes that are no UTF-8 as U+FFFD."""
        s = b"".join(map(self.out.__getitem__, ids)).decode("utf-8", errors="replace")
        return s[1:] if self.prefix and s.startswith(" ") else s


@lru_cache(maxsize=2)
def compiled(path: str) -> Transducer:
    with open(path, "rb") as f:
        return Transducer(f.read())


def model_path() -> str:
    """Place of the installed public model."""
    import public_tokenizers as p

    return p.path("piece_bpe_32k.model")


def encode(docs: DataFrame, text: str = "text", model: str | None = None, verify: bool = False) -> DataFrame:
    """docs with pieces (array of ids), n_pieces and, if asked for, round_trip (decoding gives the normalised text).

    Null texts have null pieces, 0 and true; empty texts no pieces. Repeated rows get equal results, an empty table gives
    no rows, and an input column with the name of a result gives way to it. The model file is read on the worker from the
    path given (installed with the tokenizers).
    """
    prepare(docs.sparkSession)
    docs = docs.drop("pieces", "n_pieces", *(["round_trip"] if verify else []))
    path, at = model or model_path(), docs.columns.index(text)
    more = {"pieces": "array<int>", "n_pieces": "long"} | ({"round_trip": "boolean"} if verify else {})

    def run(batches):
        t = compiled(path)
        for b in batches:
            texts = b.column(at).to_pylist()
            ids, ok = [None] * len(texts), [True] * len(texts)
            some = [i for i, s in enumerate(texts) if s is not None]
            while some:
                size = np.cumsum([len(texts[i]) for i in some])
                n = max(1, int(np.searchsorted(size, CHUNK, side="right")))
                for i, got, good in zip(some[:n], *t.checked_all([texts[i] for i in some[:n]]), strict=True):
                    ids[i], ok[i] = got, good
                some = some[n:]
            n = pa.array([0 if i is None else len(i) for i in ids], pa.int64())
            off = np.concatenate([[0], np.cumsum(n.to_numpy())]).astype(np.int32)
            flat = np.concatenate([i for i in ids if i is not None] or [np.zeros(0, np.int32)])
            mask = pa.array([i is None for i in ids])
            lists = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(flat), mask=mask) if len(ids) else pa.array([], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*b.columns, lists, n, *([pa.array(ok, pa.bool_())] if verify else [])], names=[*b.schema.names, *more])

    return docs.mapInArrow(run, wider(docs, **more))


def decode(rows: DataFrame, pieces: str = "pieces", model: str | None = None, out: str = "text") -> DataFrame:
    """rows with the text of their pieces; null pieces give null."""
    path, at = model or model_path(), rows.columns.index(pieces)

    def run(batches):
        t = compiled(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([None if x is None else t.decode(x) for x in b.column(at).to_pylist()], pa.string())], names=[*b.schema.names, out])

    return rows.mapInArrow(run, wider(rows, **{out: "string"}))


def op9_sentencepiece_wfst(spark, sf_dir: str) -> DataFrame:
    """Pieces of every whole text, and whether they decode to it."""
    docs = only(read(spark, sf_dir, "documents"), "doc_id", "text")
    return encode(docs, verify=True).select("doc_id", "n_pieces", "pieces", "round_trip")
