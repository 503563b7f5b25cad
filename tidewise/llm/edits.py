"""Edit similarity of many pairs of lines at once.

Lines that may be less than 64 * WORDS edits apart are compared in numpy, a pair in each lane: the differences between neighbouring cells of
a column of the table of distances are the bits of a few words, which move one row down with each column (Hyyrö's bit-parallel
algorithm in a band). The band holds all cells that a path of so few edits can reach, and those are at most one more than the edits in a column. On the
diagonal that ends in the distance values never fall, so a pair is given up where they exceed what is allowed.

Of longer lines the first FEW edits are found by diagonals: for 0, 1, 2, ... edits the furthest place of the left line that is reachable
on each diagonal, for all pairs in step; equal stretches are passed eight characters at a time by their hashes. Pairs that are further
apart go through the same band, held in a Python integer. The results are exact in all ways.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

from .words import mix

#: Characters of the pairs of one pass, and places (diagonals of all pairs, or words of their characters' bits) that it holds.
POINTS, PLACES = 1 << 20, 1 << 20
STRIDE = 8
#: Words of 64 rows that the band of a lane has at most, and edits of longer lines that are found by diagonals.
WORDS, FEW = 4, 24


def allowed(longer: np.ndarray, least: int) -> np.ndarray:
    """Edits that lines may be apart whose longer one has so many characters."""
    return longer * (100 - least) // 100


def alike(left: Sequence[str], right: Sequence[str], least: int) -> np.ndarray:
    """Whether the edit similarity of each pair, 1 - distance / longer length, is at least ``least`` percent."""
    n, m = (np.fromiter(map(len, x), np.int64, len(x)) for x in (left, right))
    out = np.zeros(len(n), bool)
    longer, shorter = np.maximum(n, m), np.minimum(n, m)
    edits = allowed(longer, least)
    todo = np.flatnonzero(longer - shorter <= edits)
    todo = todo[np.argsort(longer[todo], kind="stable")]
    points, at = np.cumsum((n + m + 2 * STRIDE)[todo]), 0
    while at < len(todo):
        before = int(points[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(points, before + POINTS)))
        words = int(edits[todo[at]]) // 64 + 1
        to = max(at + 1, min(to, int(np.searchsorted(edits[todo], 64 * words)) if words <= WORDS else at + PLACES // (2 * FEW + 3)))
        part = todo[at:to]
        # the longer line is the left one
        p, q = ([x[k] if (n[k] >= m[k]) == first else y[k] for k in part.tolist()] for first, x, y in ((True, left, right), (False, left, right)))
        within = _within_words if words <= WORDS else _within
        out[part] = within(p, q, longer[part], shorter[part], edits[part])
        at = to
    return out


def _within_words(left: list[str], right: list[str], n: np.ndarray, m: np.ndarray, edits: np.ndarray) -> np.ndarray:
    """Whether the distance of each pair, the longer line on the left, is at most its ``edits``."""
    p, q = (np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32) for lines in (left, right))
    known = np.zeros(int(max(p.max(initial=0), q.max(initial=0))) + 1, bool)
    known[p] = known[q] = True
    code = np.cumsum(known) - 1
    kinds, most, words = max(1, int(code[-1]) + 1), int(m.max()), int(edits.max()) // 64 + 1
    size = (most + 63) // 64 + words + 1
    lanes = max(1, PLACES // (kinds * size))
    if len(n) > lanes:
        return np.concatenate([_within_words(left[a : a + lanes], right[a : a + lanes], *(x[a : a + lanes] for x in (n, m, edits))) for a in range(0, len(n), lanes)])
    # rows above the first one that the band holds in the first column, and its row on the diagonal that ends in the distance
    above = (edits - (n - m)) // 2
    middle, base = n - m + above, np.arange(len(n)) * kinds
    # for each word of rows, the rows that hold each character of each left line; an end of its own is in all rows
    rows = np.arange(len(p)) + np.repeat(above - np.cumsum(n) + n, n)
    held = np.zeros((size, len(n) * kinds + 1), np.uint64)
    np.add.at(held.reshape(-1), (rows >> 6) * held.shape[1] + np.repeat(base, n) + code[p], np.uint64(1) << (rows & 63).astype(np.uint64))
    every, one = ~np.uint64(0), np.uint64(1)
    held[:, -1] = every
    columns = np.full((most, len(n)), held.shape[1] - 1)
    columns[np.arange(len(q)) - np.repeat(np.cumsum(m) - m, m), np.repeat(np.arange(len(n)), m)] = np.repeat(base, m) + code[q]
    out, alive, over = np.zeros(len(n), bool), np.arange(len(n)), n - m
    # where a row's value is one more than that above, or one less
    up = np.where(above < 64 * np.arange(words)[:, None], every, np.where(above < 64 * np.arange(1, words + 1)[:, None], every << (above & 63).astype(np.uint64), np.uint64(0)))
    down = np.zeros_like(up)
    for low in range(0, max(most, 1), 64):
        here, place, bit = held[low >> 6 : (low >> 6) + words + 1], (middle >> 6) * len(alive) + np.arange(len(alive)), (middle & 63).astype(np.uint64)
        for shift, at in enumerate(columns[low : low + 64, alive]):
            same = here.take(at, 1)
            if shift:
                same, below = same[:-1] >> np.uint64(shift), same[1:] << np.uint64(64 - shift)
                same |= below
            else:
                same = same[:-1]
            # where a cell is equal to the one before it on its diagonal
            level = same & up
            level += up
            if words > 1:
                carry = level < up
                for k in range(1, words):
                    carry[k] |= carry[k - 1] & (level[k] == every)
                    level[k] += carry[k - 1]
            level ^= up
            level |= same
            level |= down
            right_up = level | up
            np.invert(right_up, out=right_up)
            right_up |= down
            right_down = level & up
            over += (~level.take(place) >> bit & one).view(np.int64)
            if words > 1:
                carry = level[1:] << np.uint64(63)
                level >>= one
                level[:-1] |= carry
            else:
                level >>= one
            np.bitwise_or(level, right_up, out=up)
            np.invert(up, out=up)
            up |= right_down
            np.bitwise_and(level, right_up, out=down)
        good, ended = over <= edits[alive], m[alive] <= low + 64
        out[alive[good & ended]] = True
        stay = good & ~ended
        if not stay.all():
            alive, over, middle, up, down = alive[stay], over[stay], middle[stay], np.ascontiguousarray(up[:, stay]), np.ascontiguousarray(down[:, stay])
            if not len(alive):
                break
    return out


def _within_band(left: str, right: str, edits: int) -> bool:
    """The same for one pair of lines of any length."""
    above = (edits - (len(left) - len(right))) // 2
    every, middle = (1 << (len(left) - len(right) + 2 * above + 1)) - 1, 1 << (len(left) - len(right) + above)
    points = np.frombuffer(left.encode("utf-32-le", "surrogatepass"), np.uint32)
    held = {chr(c): int.from_bytes(np.packbits(points == c, bitorder="little").tobytes(), "little") << above for c in np.unique(points).tolist()}
    up, down, over = every >> above << above, 0, len(left) - len(right)
    for k, c in enumerate(right):
        same = held.get(c, 0) >> k & every
        level = ((((same & up) + up) ^ up) | same | down) & every
        if not level & middle:
            over += 1
            if over > edits:
                return False
        right_up, right_down = down | (every ^ (level | up)), level & up
        level >>= 1
        up, down = right_down | (every ^ (level | right_up)), level & right_up
    return True


def _flat(lines: list[str], sizes: np.ndarray, fill: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All code points with STRIDE fillers after each line, the hash of the STRIDE from each place on, where each line starts."""
    start = np.cumsum(sizes + STRIDE) - sizes - STRIDE
    points = np.full(int(sizes.sum()) + STRIDE * (len(lines) + 1), fill, np.uint32)
    raw = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    points[np.arange(len(raw)) + np.repeat(STRIDE * np.arange(len(lines)), sizes)] = raw
    hashed, width = points.astype(np.uint64), 1
    while width < STRIDE:
        hashed[:-width] = mix(hashed[:-width] * np.uint64(0x9E3779B97F4A7C15) + hashed[width:])
        width *= 2
    return points, hashed, start


def _within(left: list[str], right: list[str], n: np.ndarray, m: np.ndarray, edits: np.ndarray) -> np.ndarray:
    """The same for lines that may be more than FEW edits apart."""
    p, p_hash, p_start = _flat(left, n, 0xFFFFFFFE)
    q, q_hash, q_start = _flat(right, m, 0xFFFFFFFF)
    most = FEW
    out, alive = np.zeros(len(n), bool), np.arange(len(n))
    nowhere = -(1 << 40)
    # row most + 1 + c: the furthest place on diagonal c, place in left less place in right
    reach = np.full((2 * most + 3, len(n)), nowhere, np.int64)
    for d in range(most + 1):
        low, high = most + 1 - d, most + 2 + d
        diagonal = np.arange(-d, d + 1)[:, None]
        if d:
            new = np.maximum(np.maximum(reach[low:high], reach[low - 1 : high - 1]) + 1, reach[low + 1 : high + 1])
            np.minimum(new, np.minimum(n[alive], m[alive] + diagonal), out=new)
        else:
            new = np.zeros((1, len(alive)), np.int64)
        goal = n[alive] - m[alive]
        row, col = np.nonzero((new >= np.maximum(diagonal, 0)) & (np.abs(diagonal - goal) <= edits[alive] - d))
        place, pair = new[row, col], alive[col]
        x, y = p_start[pair] + place, q_start[pair] + place - (row - d)
        moved = np.zeros(len(x), np.int64)
        going = np.flatnonzero(p[x] == q[y])
        while len(going):
            same = p_hash[x[going] + moved[going]] == q_hash[y[going] + moved[going]]
            short = going[~same]
            for _ in range(STRIDE - 1):
                short = short[p[x[short] + moved[short]] == q[y[short] + moved[short]]]
                if not len(short):
                    break
                moved[short] += 1
            going = going[same]
            moved[going] += STRIDE
        new[row, col] = place + moved
        reach[low:high] = nowhere
        reach[low + row, col] = new[row, col]
        inside = np.abs(goal) <= d
        done = np.zeros(len(alive), bool)
        done[inside] = reach[most + 1 + goal[inside], np.flatnonzero(inside)] >= n[alive[inside]]
        out[alive[done]] = True
        alive, reach = alive[~done], np.ascontiguousarray(reach[:, ~done])
        if not len(alive):
            break
    for k in alive.tolist():
        out[k] = _within_band(left[k], right[k], int(edits[k]))
    return out
