"""JSON text scanned inside tasks, for ``envelopes``: which braces and brackets
count, and the elements between them.  Works on Arrow batches with numpy, a few
megabytes at a time."""

from __future__ import annotations

import pickle
import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

# The functions go to the tasks by value, so the workers need no copy of the library.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

OUTSIDE, INSIDE, ESCAPED = 0, 1, 2  # of a string; ESCAPED: inside, behind a backslash
STATES = (OUTSIDE, INSIDE, ESCAPED)
QUOTE, OPEN, CLOSE, BEGIN, END, ESCAPE = range(1, 7)
KINDS = b'"{}[]\\'
SLICE = 4 << 20  # bytes of text looked at at once
KEY = 1024       # bytes before an array in which its key is looked for
SPACE = b" \t\r\n"

BLOCK = "_f string, _p string, _b long"
TOTALS = f"{BLOCK}, _size long, _bytes long, _tail binary, _tracks binary"
STARTS = f"{BLOCK}, _state int, _depth long, _brackets long, _named boolean, _before binary, _sound boolean"
ELEMENTS = f"{BLOCK}, _n int, _opens boolean, _mine boolean, _text binary"


def marks(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and kinds of the characters that can change the state."""
    table = np.zeros(256, np.uint8)
    table[list(KINDS)] = range(1, 7)
    kinds = table[text]
    at = np.flatnonzero(kinds)
    return at, kinds[at]


def outside(size: int, at: np.ndarray, kind: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Places and kinds of the braces and brackets outside strings, and the state at the end of a
    text of ``size`` bytes that begins in state ``start``."""
    back = at[kind == ESCAPE]
    first = np.flatnonzero(np.diff(back, prepend=-2) != 1)
    length = np.diff(np.append(first, back.size))
    run = back[first]
    escaped = (run + length)[(length + ((run == 0) & (start == ESCAPED))) % 2 == 1]
    if start == ESCAPED and not (run.size and run[0] == 0):
        escaped = np.append(0, escaped)
    quote = kind == QUOTE
    if escaped.size:
        quote &= ~np.isin(at, escaped)
    string = (np.cumsum(quote) + (start != OUTSIDE)) % 2
    keep = (string == 0) & (kind != QUOTE) & (kind != ESCAPE)
    end = int(string[-1]) if at.size else int(start != OUTSIDE)
    if end == INSIDE and escaped.size and escaped[-1] == size:
        end = ESCAPED
    return at[keep], kind[keep], end


def levels(kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Depth of braces and of brackets before each mark, relative to the start, and the whole change of both."""
    d = (kind == OPEN).astype(np.int64) - (kind == CLOSE)
    k = (kind == BEGIN).astype(np.int64) - (kind == END)
    return np.cumsum(d) - d, np.cumsum(k) - k, int(d.sum()), int(k.sum())


def key_of(before: bytes) -> bytes | None:
    """The key of an array in the text before its bracket, as it is written; None where it has none."""
    text = before.rstrip(SPACE)
    if text.endswith(b":"):
        text = text[:-1].rstrip(SPACE)
        if text.endswith(b'"'):
            at = len(text) - 1
            while (at := text.rfind(b'"', 0, at)) >= 0:
                if (at - len(text[:at].rstrip(b"\\"))) % 2 == 0:
                    return text[at + 1:-1]
        elif text:
            return None
    elif text:
        return None
    if len(before) >= KEY:
        raise ValueError(f"an array's key is not within {KEY} bytes before it")
    return None


def slices(batches):
    """(block, size, text) of rows _f, _p, _b, _size, _text in their order, a few megabytes at once."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        other = np.zeros(n, bool)
        for c in ("_f", "_p", "_b"):
            col = batch.column(c)
            other[1:] |= pc.not_equal(col[1:], col[:-1]).to_numpy(zero_copy_only=False)
        cuts = [0, *np.flatnonzero(other).tolist(), n]
        text = batch.column("_text")
        wide = np.int64 if pa.types.is_large_binary(text.type) else np.int32
        offsets = np.frombuffer(text.buffers()[1], wide)[text.offset:text.offset + n + 1]
        data = text.buffers()[2]
        data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        for a, b in zip(cuts, cuts[1:]):
            block = tuple(batch.column(c)[a].as_py() for c in ("_f", "_p", "_b"))
            size = batch.column("_size")[a].as_py()
            lo, hi = int(offsets[a]), int(offsets[b])
            for at in range(lo, max(hi, lo + 1), SLICE):
                yield a, batch, block, size, data[at:min(at + SLICE, hi)]


class Totals:
    """What a block does to the state, for each state in which it may begin."""

    def __init__(self, block, size):
        self.block, self.size, self.bytes, self.tail = block, size, 0, b""
        self.tracks = {s: [s, 0, 0, {}] for s in STATES}  # state, depth, brackets, the last array's surroundings by level

    def feed(self, text: np.ndarray) -> None:
        at, kind = marks(text)
        raw = text.tobytes()
        done = {}
        for track in self.tracks.values():
            state, depth, brackets, arrays = track
            if state not in done:
                places, kinds, end = outside(len(raw), at, kind, state)
                d, k, dd, dk = levels(kinds)
                begins = np.flatnonzero(kinds == BEGIN)[::-1]
                _, last = np.unique(np.stack([d[begins], k[begins]]), axis=1, return_index=True) if begins.size else (0, [])
                found = [(int(d[i]), int(k[i]), self.before(raw, int(places[i]))) for i in begins[last]]
                done[state] = end, dd, dk, found
            end, dd, dk, found = done[state]
            arrays.update({(depth + d, brackets + k): before for d, k, before in found})
            track[:] = end, depth + dd, brackets + dk, arrays
        self.bytes += len(raw)
        self.tail = (self.tail + raw[-KEY:])[-KEY:]

    def before(self, raw: bytes, at: int) -> bytes:
        return (self.tail + raw[max(0, at - KEY):at])[-KEY:] if at < KEY else raw[at - KEY:at]

    def row(self) -> list:
        return [*self.block, self.size, self.bytes, self.tail, pickle.dumps(self.tracks)]


def _batch(rows: list, names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


def block_totals(batches):
    """One row a block."""
    names = ["_f", "_p", "_b", "_size", "_bytes", "_tail", "_tracks"]
    types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    now = None
    for _, _, block, size, text in slices(batches):
        if now is None or now.block != block:
            if now:
                yield _batch([now.row()], names, types)
            now = Totals(block, size)
        now.feed(text)
    if now:
        yield _batch([now.row()], names, types)


def composer(member: str | None):
    """The function that puts the blocks of one document's file, or of its parts, one behind the other."""
    base, key = (1, member.encode()) if member else (0, None)

    def compose(table: pa.Table) -> pa.Table:
        state, depth, brackets, named, before, rows = OUTSIDE, 0, 0, False, b"", []
        blocks = sorted(table.to_pylist(), key=lambda r: (len(r["_p"]), r["_p"], r["_b"]))
        for r in blocks:
            rows.append([r["_f"], r["_p"], r["_b"], state, depth, brackets, named, before])
            state, d, k, arrays = pickle.loads(r["_tracks"])[state]
            text = arrays.get((base - depth, -brackets))
            if text is not None and key is not None and (name := key_of((before + text)[-KEY:])) is not None:
                named = name == key
            depth, brackets, before = depth + d, brackets + k, (before + r["_tail"])[-KEY:]
        # A brace was put behind each piece of a file. The last one has none, unless the file ends with one.
        size = blocks[0]["_size"]
        tail = sum(r["_bytes"] for r in blocks) - size if size >= 0 else 0
        sound = state == OUTSIDE and depth + tail == 0 and brackets == 0
        cols = list(zip(*[r + [sound] for r in rows]))
        types = [pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.bool_()]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], [c.split()[0] for c in STARTS.split(", ")])

    return compose


class Elements:
    """The objects that open directly in the member's array, from the state in which a block begins."""

    def __init__(self, block: tuple, start: dict, member: str | None):
        if start["_state"] is None:
            raise ValueError(f"{block[0]} was cut into other blocks than before")
        self.block, self.state, self.depth, self.brackets = block, start["_state"], start["_depth"], start["_brackets"]
        self.named, self.tail = start["_named"], start["_before"]
        self.base, self.key = (1, member.encode()) if member else (0, None)
        self.open = self.depth > self.base  # an element of an earlier block goes on
        self.parts, self.opened, self.mine, self.n = [], False, False, 0

    def feed(self, text: np.ndarray) -> list[tuple]:
        """Rows (_n, _opens, _mine, _text); _n is None for an element that lies in the block as a whole."""
        raw = text.tobytes()
        at, kind, self.state = outside(len(raw), *marks(text), self.state)
        depth, brackets, d, k = levels(kind)
        depth, brackets = depth + self.depth, brackets + self.brackets
        opens = (kind == OPEN) & (depth == self.base)
        start, mine = at[opens], brackets[opens] == 1
        end = at[(kind == CLOSE) & (depth == self.base + 1)] + 1
        if self.key is not None:
            arrays = at[(kind == BEGIN) & (depth == self.base) & (brackets == 0)]
            named = [self.named]
            for a in arrays.tolist():
                name = key_of((self.tail + raw[max(0, a - KEY):a])[-KEY:])
                named.append(named[-1] if name is None else name == self.key)
            mine, self.named = mine & np.array(named)[np.searchsorted(arrays, start)], named[-1]
        rows = []
        if self.open:
            self.parts.append(raw[:end[0]] if end.size else raw)
            if end.size:
                rows, end = self.taken(), end[1:]
        here = mine[:end.size]
        rows += [(None, None, None, raw[a:b]) for a, b in zip(start[:end.size][here].tolist(), end[here].tolist())]
        if start.size > end.size:
            self.parts, self.open, self.opened, self.mine = [raw[start[-1]:]], True, True, bool(mine[-1])
        self.depth, self.brackets = self.depth + d, self.brackets + k
        self.tail = (self.tail + raw[-KEY:])[-KEY:]
        return rows

    def taken(self, last: bool = False) -> list[tuple]:
        """The open element as a row, closed or at the end of the block."""
        text, self.parts, self.open = b"".join(self.parts), [], False
        if self.opened and not last:
            return [(None, None, None, text)] if self.mine else []
        self.n += 1
        return [(self.n, self.opened, self.mine, text)]


def elements(member: str | None):
    """The function that gives the elements of the blocks, and of an element over several blocks its part in each."""
    names = ["_f", "_p", "_b", "_n", "_opens", "_mine", "_text"]
    types = [pa.string(), pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.bool_(), pa.binary()]

    def rows_of(now: Elements, rows: list[tuple]) -> list[pa.RecordBatch]:
        return [_batch([(*now.block, *r) if r[0] else (None, None, None, *r) for r in rows], names, types)] if rows else []

    def run(batches):
        now = None
        for row, batch, block, _, text in slices(batches):
            if now is None or now.block != block:
                if now and now.open:
                    yield from rows_of(now, now.taken(last=True))
                start = {c: batch.column(c)[row].as_py() for c in ("_state", "_depth", "_brackets", "_named", "_before")}
                now = Elements(block, start, member)
            yield from rows_of(now, now.feed(text))
        if now and now.open:
            yield from rows_of(now, now.taken(last=True))

    return run
