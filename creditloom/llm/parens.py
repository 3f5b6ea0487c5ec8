"""A tree as balanced parentheses, with block minima and maxima of the excess."""

import numpy as np

BLOCK = 64
#: Positions that are looked up at a time; each needs a block of excesses.
AT_ONCE = 1 << 14


class Parens:
    """``opens``: true for an opening parenthesis, false for a closing one, in preorder.

    The excess at a position is the number of parentheses that are open behind it. It
    moves by one, so a block holds a value if and only if that value lies between the
    block's minimum and maximum. Minima and maxima of pairs of blocks, of pairs of pairs
    and so on make a tree through which a search climbs and descends.
    """

    def __init__(self, opens: np.ndarray):
        self.opens = opens
        self.excess = np.cumsum(np.where(opens, 1, -1)).astype(np.int32)
        blocks = max(1, -(-len(opens) // BLOCK))
        # Behind the end the excess stays above any value that is looked for.
        self._rows = np.full(blocks * BLOCK, np.iinfo(np.int32).max, dtype=np.int32)
        self._rows[: len(opens)] = self.excess
        self._rows = self._rows.reshape(blocks, BLOCK)
        inside = np.where(self._rows == np.iinfo(np.int32).max, -1, self._rows)
        low, high = self._rows.min(axis=1), inside.max(axis=1)
        self._low, self._high = [low], [high]
        while len(low) > 1:
            if len(low) % 2:
                low = np.append(low, np.iinfo(np.int32).max)
                high = np.append(high, np.int32(-1))
            low = np.minimum(low[::2], low[1::2])
            high = np.maximum(high[::2], high[1::2])
            self._low.append(low)
            self._high.append(high)
        leaf = np.zeros(len(opens), dtype=np.int64)
        leaf[:-1] = opens[:-1] & ~opens[1:]
        self._leaves = np.concatenate(([0], np.cumsum(leaf)))

    def leaf_pairs(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Number of ``()`` that begin at the positions ``start`` to ``end - 1``."""
        return self._leaves[end] - self._leaves[start]

    def find_close(self, at: np.ndarray) -> np.ndarray:
        """Position of the parenthesis that closes each opening one."""
        parts = [self._close(at[i : i + AT_ONCE]) for i in range(0, len(at), AT_ONCE)]
        return np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)

    def _holds(self, level: int, node: np.ndarray, value: np.ndarray) -> np.ndarray:
        there = node < len(self._low[level])
        node = np.where(there, node, 0)
        return there & (self._low[level][node] <= value) & (value <= self._high[level][node])

    def _close(self, at: np.ndarray) -> np.ndarray:
        target = self.excess[at] - 1
        block = at // BLOCK
        behind = np.arange(BLOCK)[None, :] > (at % BLOCK)[:, None]
        hit = behind & (self._rows[block] == target[:, None])
        place, found = hit.argmax(axis=1), hit.any(axis=1)
        out = block * BLOCK + place
        far = np.flatnonzero(~found)
        if len(far):
            block = self._next_block(block[far], target[far])
            hit = self._rows[block] == target[far][:, None]
            out[far] = block * BLOCK + hit.argmax(axis=1)
        return out

    def _next_block(self, block: np.ndarray, target: np.ndarray) -> np.ndarray:
        """First block behind each of ``block`` that holds the value ``target``."""
        node, level = block.copy(), np.full(len(block), -1)
        for k in range(len(self._low)):
            up = np.flatnonzero(level < 0)
            right = (node[up] % 2 == 0) & self._holds(k, node[up] + 1, target[up])
            level[up[right]] = k
            node[up[right]] += 1
            node[up[~right]] //= 2
        for k in range(len(self._low) - 1, 0, -1):
            down = np.flatnonzero(level == k)
            left = node[down] * 2
            node[down] = np.where(self._holds(k - 1, left, target[down]), left, left + 1)
            level[down] = k - 1
        return node


def range_min(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Minimum of ``values[start:end]`` for each pair with ``start < end``.

    Minima over 1, 2, 4, ... values are made one after the other, each from the last.
    """
    out = np.empty(len(start), dtype=values.dtype)
    power = np.frexp((end - start).astype(np.float64))[1] - 1
    table, span = values, 1
    for k in range(int(power.max()) + 1 if len(power) else 0):
        rows = np.flatnonzero(power == k)
        out[rows] = np.minimum(table[start[rows]], table[end[rows] - span])
        if len(table) > span:
            table = np.minimum(table[:-span], table[span:])
        span *= 2
    return out
