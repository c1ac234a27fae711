"""Splitting of fields that pack several values into one string.

`split_scalar` states the grammar, one field at a time. `split_arrow` does the same for a
whole Arrow string array with byte masks, and hands only the fields that masks can't decide
(mixed quote kinds, unpaired quotes, \\u escapes) to `split_scalar`.

Grammar. A field is in one of three notations, told by its first and last non-blank sign:
  [..]  list: values in " or ' quotes (or bare), separated by commas, backslash escapes;
  {..}  braces: values bare or in " quotes, separated by commas, backslash escapes;
  else  plain: values bare or in " quotes with doubled quotes, separated by any of
        , ; | tab CR LF and the wide comma, ideographic comma, wide semicolon, wide bar,
        bullet, or a middle dot next to a blank; backslash escapes.
A quote opens a value only where the value begins; in quotes no sign separates. What is
quoted or escaped belongs to the value. Blanks around a value go; empty values give nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

# Separators of the plain notation and blanks, as code points.
PLAIN_DELIMITERS = ",;|\t\r\n，、；｜•"
SPACED_DELIMITER = "·"
BLANKS = "".join(chr(c) for c in range(0x3001) if chr(c).isspace()) + "\ufeff"

_JSON_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}


def _notation(field: str) -> tuple[str, str]:
    body = field.strip(BLANKS)
    if len(body) >= 2 and (body[0], body[-1]) in (("[", "]"), ("{", "}")):
        return ("list" if body[0] == "[" else "brace"), body[1:-1]
    return "plain", field


def split_scalar(field: str | None) -> list[str]:
    """The values of one field, in order; null and empty fields give none."""
    if not field:
        return []
    kind, s = _notation(field)
    delimiters = "," if kind != "plain" else PLAIN_DELIMITERS
    quotes = "\"'" if kind == "list" else '"'
    out: list[str] = []
    value: list[str] = []
    hard = 0  # so many leading signs of value, and as many as were quoted or escaped since, are kept as they are
    quote = ""

    def end() -> None:
        nonlocal hard
        text = "".join(value).strip(BLANKS)
        if text:
            out.append(text)
        value.clear()
        hard = 0

    i, n = 0, len(s)
    while i < n:
        c = s[i]
        if c == "\\" and i + 1 < n:
            d = s[i + 1]
            if kind == "list" and d == "u" and _is_hex(s[i + 2 : i + 6]):
                unit, i = int(s[i + 2 : i + 6], 16), i + 6
                if 0xD800 <= unit < 0xDC00 and s[i : i + 2] == "\\u" and _is_hex(s[i + 2 : i + 6]):
                    low = int(s[i + 2 : i + 6], 16)
                    if 0xDC00 <= low < 0xE000:
                        unit, i = 0x10000 + ((unit - 0xD800) << 10) + (low - 0xDC00), i + 6
                value.append(chr(unit) if not 0xD800 <= unit < 0xE000 else "�")
                continue
            value.append(_JSON_ESCAPES.get(d, d) if kind == "list" else d)
            i += 2
            continue
        if quote:
            if c == quote:
                if kind == "plain" and s[i + 1 : i + 2] == quote:
                    value.append(c)
                    i += 2
                    continue
                quote = ""
            else:
                value.append(c)
        elif c in quotes and not "".join(value).strip(BLANKS) and _closes(s, i, c):
            value.clear()
            quote = c
        elif c in delimiters or (c == SPACED_DELIMITER and kind == "plain" and (s[i - 1 : i] in tuple(BLANKS) or s[i + 1 : i + 2] in tuple(BLANKS))):
            end()
        else:
            value.append(c)
        i += 1
    end()
    return out


def _is_hex(x: str) -> bool:
    return len(x) == 4 and all(c in "0123456789abcdefABCDEF" for c in x)


def _closes(s: str, i: int, quote: str) -> bool:
    """A quote without a partner is an ordinary sign."""
    j = i + 1
    while j < len(s):
        if s[j] == "\\":
            j += 2
        elif s[j] == quote:
            return True
        else:
            j += 1
    return False


def _mark(b: np.ndarray, signs: str) -> tuple[np.ndarray, np.ndarray]:
    """Masks over UTF-8 bytes: all bytes of the signs, and the first byte of each."""
    every = np.zeros(len(b), bool)
    first = np.zeros(len(b), bool)
    single = np.zeros(256, bool)
    leads = np.flatnonzero(b >= 0xC2)
    for sign in signs:
        code = sign.encode()
        if len(code) == 1:
            single[code[0]] = True
            continue
        at = leads[b[leads] == code[0]]
        at = at[at <= len(b) - len(code)]
        for k in range(1, len(code)):
            at = at[b[at + k] == code[k]]
        first[at] = True
        for k in range(len(code)):
            every[at + k] = True
    ascii_hit = single[b]
    return every | ascii_hit, first | ascii_hit


def _covered(lo: np.ndarray, hi: np.ndarray, n: int) -> np.ndarray:
    """Mask of the bytes in any of the disjoint runs [lo, hi)."""
    return np.cumsum(np.bincount(lo, minlength=n + 1)[:n] - np.bincount(hi, minlength=n + 1)[:n]) > 0


def split_arrow(fields: pa.Array) -> pa.ListArray:
    """The values of each field as a list array with as many rows as `fields`."""
    fields = fields.cast(pa.large_string()).fill_null("")
    rows = len(fields)
    if rows == 0:
        return pa.array([], pa.list_(pa.string()))
    offsets = np.frombuffer(fields.buffers()[1], np.int64)[fields.offset : fields.offset + rows + 1]
    data = fields.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    start, stop = offsets[:-1] - offsets[0], offsets[1:] - offsets[0]
    # a separator byte that no text holds follows each field, so that no mask runs over its end
    size = stop - start
    b = np.zeros(len(raw) + rows, np.uint8)
    start = start + np.arange(rows)
    stop = start + size
    at = np.ones(len(b), bool)
    at[stop] = False
    b[at] = raw
    wall = ~at
    row = np.repeat(np.arange(rows), size + 1)

    # escapes: a backslash counts if an even number of backslashes runs up to it
    slash = b == 92
    index = np.arange(len(b))
    last_other = np.maximum.accumulate(np.where(slash, -1, index))
    run = index - last_other
    escaper = slash & (run % 2 == 1)
    escaper[:-1] &= ~wall[1:]
    escaped = np.zeros(len(b), bool)
    escaped[1:] = escaper[:-1]

    blank, _ = _mark(b, BLANKS)
    solid = np.flatnonzero(~blank & ~wall)  # for the notation, as written
    lo = np.searchsorted(solid, start)
    hi = np.searchsorted(solid, stop)
    some = hi > lo
    first = np.where(some, solid[np.minimum(lo, max(len(solid) - 1, 0))] if len(solid) else 0, start)
    last = np.where(some, solid[np.maximum(hi - 1, 0)] if len(solid) else 0, start)
    pair = some & (last > first)
    listed = pair & (b[first] == 91) & (b[last] == 93)
    braced = pair & (b[first] == 123) & (b[last] == 125)
    boxed = listed | braced

    solid = np.flatnonzero(~blank & ~wall & ~escaper)  # for values, whose escapes go
    # one kind of quote is active in a field; where a list has both, or quotes don't pair, the scalar grammar decides
    double = (b == 34) & ~escaped
    single = (b == 39) & ~escaped
    has_double = np.add.reduceat(double, start) > 0
    has_single = np.add.reduceat(single, start) > 0
    hard = listed & has_double & has_single
    by_single = listed & has_single & ~has_double
    quote = np.where(by_single[row], single, double)
    parity = np.cumsum(quote)
    base = parity[start] - quote[start]
    inside = ((parity - base[row]) % 2).astype(bool)  # true from an opening quote up to before its closing one
    hard |= (parity[stop] - base) % 2 == 1
    hard |= listed & (np.add.reduceat(escaper, start) > 0)
    hard |= boxed & escaped[last]

    box = np.zeros(len(b), bool)
    box[first[boxed]] = True
    box[last[boxed]] = True
    plain_all, plain_first = _mark(b, PLAIN_DELIMITERS)
    dot_all, dot_first = _mark(b, SPACED_DELIMITER)
    near = np.zeros(len(b), bool)
    spots = np.flatnonzero(dot_first)
    near[spots] = blank[spots - 1] & (spots > 0) | blank[np.minimum(spots + 2, len(b) - 1)]
    dot_all = np.zeros(len(b), bool)
    dot_all[np.flatnonzero(near)] = True
    dot_all[np.flatnonzero(near) + 1] = True
    delimiter = np.where(boxed[row], b == 44, plain_all | dot_all) & ~inside & ~escaped
    # the later bytes of an escaped wide delimiter
    wide = np.flatnonzero(escaped & (plain_first | dot_first) & (b > 127))
    for k in (1, 2):
        tail = np.minimum(wide + k, len(b) - 1)
        delimiter[tail[(b[tail] & 0xC0) == 0x80]] = False

    gap = delimiter | wall | box
    # a quote that opens within a bare value is an ordinary sign there
    opening = np.flatnonzero(quote & inside)
    if len(opening):
        k = np.searchsorted(solid, opening) - 1
        before = np.where(k >= 0, solid[np.maximum(k, 0)], -1)
        gaps = np.cumsum(gap)
        mid = (before >= start[row[opening]]) & (gaps[opening] == gaps[np.maximum(before, 0)]) & ~gap[np.maximum(before, 0)] & ~((before == opening - 1) & quote[np.maximum(before, 0)])
        hard[row[opening[mid]]] = True

    # runs between gaps, without the blanks at their ends
    edge = np.flatnonzero(gap)
    seg_lo = np.concatenate(([0], edge[:-1] + 1))
    seg_hi = edge
    live = seg_hi > seg_lo
    seg_lo, seg_hi = seg_lo[live], seg_hi[live]
    a = np.searchsorted(solid, seg_lo)
    z = np.searchsorted(solid, seg_hi)
    live = z > a
    a, z = a[live], z[live]
    seg_lo, seg_hi = (solid[a], solid[z - 1] + 1) if len(solid) else (seg_lo[:0], seg_hi[:0])

    # values in quotes lose them, and the blanks next to them; a quote inside a bare value stays
    quoted = quote[seg_lo] & quote[seg_hi - 1] & (seg_hi - seg_lo >= 2) if len(seg_lo) else np.zeros(0, bool)
    odd = (quote[seg_lo] & ~quoted) if len(seg_lo) else np.zeros(0, bool)
    hard[row[seg_lo[odd]]] = True  # text after a closing quote
    within = _covered(seg_lo[quoted] + 1, seg_hi[quoted] - 1, len(b))
    drop = escaper.copy()
    q = np.flatnonzero(quote & within)
    # of doubled quotes the first goes; any other quote within needs the scalar grammar
    if len(q):
        nth = np.arange(len(q))
        adjacent = np.concatenate((q[1:] == q[:-1] + 1, [False]))
        begins = np.concatenate(([True], ~adjacent[:-1]))
        rank = nth - np.maximum.accumulate(np.where(begins, nth, 0))
        length = np.bincount(np.cumsum(begins) - 1)[np.cumsum(begins) - 1]
        hard[row[q[length % 2 == 1]]] = True
        drop[q[rank % 2 == 0]] = True
        hard[row[q[boxed[row[q]]]]] = True
    seg_lo = seg_lo + quoted
    seg_hi = seg_hi - quoted
    if len(solid):
        a, z = np.searchsorted(solid, seg_lo), np.searchsorted(solid, seg_hi)
        live = z > a
        seg_lo, seg_hi = solid[a[live]], solid[z[live] - 1] + 1

    keep = _covered(seg_lo, seg_hi, len(b)) & ~drop
    upto = np.concatenate(([0], np.cumsum(keep)))
    ends = upto[seg_hi]
    child_offsets = np.concatenate(([0], ends)).astype(np.int32)
    children = pa.StringArray.from_buffers(len(seg_lo), pa.py_buffer(child_offsets.tobytes()), pa.py_buffer(b[keep].tobytes()))
    counts = np.bincount(row[seg_lo], minlength=rows) if len(seg_lo) else np.zeros(rows, int)
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), children)
    if not hard.any():
        return lists
    # rows that the masks can't decide
    which = np.flatnonzero(hard)
    parsed = pa.array([split_scalar(fields[int(i)].as_py()) for i in which], pa.list_(pa.string()))
    both = pa.concat_arrays([lists, parsed])
    take = np.arange(rows)
    take[which] = rows + np.arange(len(which))
    return both.take(pa.array(take))
