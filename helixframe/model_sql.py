"""SQL of the hidden Markov model of a chain of bases: one recursion step for each base of a read. Each step works on
lists over the nodes, rescaled to a largest value of 1; the scale is a logarithm."""

P_END = 1e-5
MAX_GAPS = 4


def num(x: float) -> str:
    return f"{x:.17e}"


def nodes(v: list[float]) -> str:
    return "[" + ", ".join(num(x) for x in v) + "]"


class Chain:
    """Forward and backward recursions of the chain ``bases``, with one probability p for mismatches and gaps."""

    def __init__(self, bases: str, p: float):
        self.bases, self.n, self.p, self.stay = bases, len(bases), p, 1 - 2 * p - P_END

    def const(self, x: float) -> str:
        return f"list_resize(CAST([] AS DOUBLE[]), {self.n}, {num(x)})"

    def ahead(self, v: str, k: int = 1) -> str:
        """Values of the nodes k places before."""
        return f"list_concat(list_resize(CAST([] AS DOUBLE[]), {k}, 0e0), {v})[1:{self.n}]"

    def back(self, v: str, k: int = 1) -> str:
        """Values of the nodes k places behind."""
        return f"list_resize({v}[{k + 1}:], {self.n}, 0e0)"

    def emission(self, letter: str) -> str:
        rows = (f"WHEN '{b}' THEN {nodes([1 - self.p if x == b else self.p for x in self.bases])}" for b in "ACGT")
        return f"CASE {letter} {' '.join(rows)} END"

    def gaps(self, move, v: str) -> str:
        """Deletions after v: up to MAX_GAPS more nodes."""
        terms = " + ".join([f"z[{g + 1}] * {num(self.p**g)}" for g in range(MAX_GAPS + 1)])
        return f"list_transform(list_zip({v}, {', '.join(move(v, g) for g in range(1, MAX_GAPS + 1))}), lambda z: {terms})"

    def forward(self, reads: str, last: bool = False) -> str:
        """f: the tables after j bases of each read (``last``: only after the whole read)."""
        p, s = num(self.p), num(self.stay)
        return f"""f(read_id, seq, j, m, i, d, mb, ib, scale){" USING KEY (read_id)" if last else ""} AS (
SELECT read_id, seq, CAST(0 AS BIGINT), {self.const(0)}, {self.const(0)}, {self.const(0)}, 1e0, 0e0, 0e0 FROM {reads}
UNION ALL SELECT read_id, seq, j + 1, list_transform(m2, lambda v: v / top), list_transform(i2, lambda v: v / top), list_transform(d2, lambda v: v / top), 0e0, ib2 / top, scale + ln(top) FROM (
SELECT *, greatest(list_max(m2), list_max(i2), list_max(d2), ib2) AS top FROM (
SELECT *, {self.gaps(self.ahead, "s")} AS d2 FROM (
SELECT *, list_transform({self.ahead("u")}, lambda v: v + {num(self.p / self.n)} * ib2) AS s FROM (
SELECT *, list_transform(list_zip(m2, i2), lambda z: {p} * (z[1] + z[2])) AS u FROM (
SELECT *, list_transform(list_zip(em, {self.ahead("w")}), lambda z: z[1] * (z[2] + {num(1 / self.n)} * {s} * (mb + ib))) AS m2, 0.25e0 * {p} * (mb + ib) AS ib2 FROM (
SELECT *, {self.emission("substr(seq, j + 1, 1)")} AS em, list_transform(list_zip(m, i, d), lambda z: {s} * (z[1] + z[2] + z[3])) AS w, list_transform(list_zip(m, i, d), lambda z: 0.25e0 * {p} * (z[1] + z[2] + z[3])) AS i2 FROM f WHERE j < length(seq))))))))"""

    def backward(self, reads: str, last: bool = False) -> str:
        """b: the tables before the last r bases of each read; the tables of j bases are those of r = length - j."""
        p, s = num(self.p), num(self.stay)
        mean = lambda v: f"list_sum({v}) * {num(1 / self.n)}"
        return f"""b(read_id, seq, r, m, i, d, mb, ib, scale){" USING KEY (read_id)" if last else ""} AS (
SELECT read_id, seq, CAST(0 AS BIGINT), {self.const(P_END)}, {self.const(P_END)}, {self.const(P_END)}, 0e0, 0e0, 0e0 FROM {reads}
UNION ALL SELECT read_id, seq, r + 1, list_transform(m2, lambda v: v / top), list_transform(i2, lambda v: v / top), list_transform(d2, lambda v: v / top), mb2 / top, ib2 / top, scale + ln(top) FROM (
SELECT *, greatest(list_max(m2), list_max(i2), list_max(d2), mb2, ib2) AS top FROM (
SELECT *, list_transform(list_zip(tm, {self.back("d2")}, stay), lambda z: {s} * z[1] + {p} * (z[2] + z[3])) AS m2, list_transform(list_zip(tm, {self.back("d2")}, stay), lambda z: {s} * z[1] + {p} * (z[2] + z[3])) AS i2,
{s} * {mean("em")} + {p} * {mean("d2")} + {p} * 0.25e0 * ib AS mb2, {s} * {mean("em")} + {p} * {mean("d2")} + {p} * 0.25e0 * ib AS ib2 FROM (
SELECT *, {self.gaps(self.back, "s")} AS d2 FROM (
SELECT *, list_transform(list_zip(tm, stay), lambda z: {s} * z[1] + {p} * z[2]) AS s FROM (
SELECT *, {self.back("em")} AS tm, list_transform(i, lambda v: 0.25e0 * v) AS stay FROM (
SELECT *, list_transform(list_zip({self.emission("substr(seq, length(seq) - r, 1)")}, m), lambda z: z[1] * z[2]) AS em FROM b WHERE r < length(seq))))))))"""

    def end(self) -> str:
        """Log probability of a whole read, from its last row of f."""
        return f"ln({num(P_END)} * (list_sum(m) + list_sum(i) + list_sum(d))) + scale"

    def both(self, reads: str) -> str:
        """z: log probabilities; fl, bl: values by read, bases read, node; st: the same, times each other over the whole."""
        split = "unnest(range({n})) AS node, unnest(m) AS m, unnest(i) AS i, unnest(d) AS d".format(n=self.n)
        return f"""{self.forward(reads)}, {self.backward(reads)}, z AS (SELECT read_id, {self.end()} AS z FROM f WHERE j = length(seq)),
fl AS (SELECT read_id, seq, j, mb, ib, scale, {split} FROM f), bl AS (SELECT read_id, length(seq) - r AS j, mb, ib, scale, {split} FROM b),
st AS (SELECT fl.read_id, fl.j - 1 AS pos, fl.node, fl.m * bl.m * exp(fl.scale + bl.scale - z) AS m, fl.i * bl.i * exp(fl.scale + bl.scale - z) AS i, fl.d * bl.d * exp(fl.scale + bl.scale - z) AS d, fl.ib * bl.ib * exp(fl.scale + bl.scale - z) AS ib
FROM fl JOIN bl USING (read_id, j, node) JOIN z USING (read_id) WHERE fl.j > 0)"""

    def uses(self, reads: str) -> str:
        """eu: expected uses (read_id, node, way) of the way from the node to the next one, and of the start at the node."""
        p, s = num(self.p), num(self.stay)
        em = " ".join(f"WHEN substr(fl.seq, fl.j + 1, 1) = '{b}' AND substr('{self.bases}', CAST(y.node + 1 AS BIGINT), 1) = '{b}' THEN {num(1 - self.p)}" for b in "ACGT")
        em = f"CASE {em} ELSE {p} END * y.m * exp(fl.scale + y.scale - z)"
        start = num(1 / self.n)
        return f"""{self.both(reads)}, eu AS (
SELECT fl.read_id, fl.node, 'edge' AS way, ({p} * (fl.m + fl.i + fl.d)) * y.d * exp(fl.scale + y.scale - z) AS x FROM fl JOIN bl y ON y.read_id = fl.read_id AND y.j = fl.j AND y.node = fl.node + 1 JOIN z ON z.read_id = fl.read_id
UNION ALL SELECT fl.read_id, fl.node, 'edge', {s} * (fl.m + fl.i + fl.d) * {em} FROM fl JOIN bl y ON y.read_id = fl.read_id AND y.j = fl.j + 1 AND y.node = fl.node + 1 JOIN z ON z.read_id = fl.read_id
UNION ALL SELECT fl.read_id, fl.node, 'start', {start} * {p} * fl.ib * y.d * exp(fl.scale + y.scale - z) FROM fl JOIN bl y ON y.read_id = fl.read_id AND y.j = fl.j AND y.node = fl.node JOIN z ON z.read_id = fl.read_id
UNION ALL SELECT fl.read_id, fl.node, 'start', {start} * {s} * (fl.mb + fl.ib) * {em} FROM fl JOIN bl y ON y.read_id = fl.read_id AND y.j = fl.j + 1 AND y.node = fl.node JOIN z ON z.read_id = fl.read_id)"""
