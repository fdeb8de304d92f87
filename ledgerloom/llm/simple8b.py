"""Simple-8b: unsigned ids packed into 64-bit words, each with a 4-bit selector, in blocks that decode on their own.

A word is selector << 60 | payload. Selectors 1 to 14 pack PACKS[s] = (ids, bits each), the first id lowest. Selector 0 is an
escape: its payload is the place of one id of over 60 bits among the block's exceptions. 15 is reserved.
"""

from __future__ import annotations

import numpy as np

PACKS = ((1, 64), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
COUNTS = np.array([c for c, _ in PACKS] + [0], np.int64)
BLOCK = 1024

_ONE, _SHIFT = np.uint64(1), np.uint64(60)
_MASK = np.uint64((1 << 60) - 1)


def _bits(ids: np.ndarray) -> np.ndarray:
    """Bits that each id needs, at least 1."""
    out, top = np.ones(len(ids), np.uint8), int(ids.max(initial=0))
    narrow = ids.astype(np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)
    for b in range(1, top.bit_length()):
        out += narrow >= narrow.dtype.type(1 << b)
    return out


def encode(ids: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words, exceptions, and the words and exceptions of each block of `block` ids (the last may be shorter).

    All blocks advance together: one step picks, for every block, the selector that packs most of the ids that follow.
    """
    ids = np.ascontiguousarray(ids, np.uint64)
    n = len(ids)
    rows = -(-n // block)
    if not n:
        return (np.empty(0, np.uint64),) * 2 + (np.empty(0, np.int64),) * 2
    bits = _bits(ids)
    wide = np.full((rows, block + 60), 255, np.uint8)  # the pad keeps a word within its block
    body = np.full(rows * block, 255, np.uint8)
    body[:n] = bits
    wide[:, :block] = body.reshape(rows, block)
    pick = np.zeros((rows, block), np.uint8)
    reach, span = wide.copy(), 1
    for s in range(14, 0, -1):  # few wide ids first, so that the last selector that fits packs most
        count, width = PACKS[s]
        while span < count:
            step = min(span, count - span)
            reach[:, :-step] = np.maximum(reach[:, :-step], reach[:, step:])
            span += step
        pick[reach[:, :block] <= width] = s
    pick = pick.ravel()
    at = np.arange(rows, dtype=np.int64) * block
    end = np.minimum(at + block, n)
    starts, owners, live = [], [], np.arange(rows)
    while len(live):
        here = at[live]
        starts.append(here)
        owners.append(live)
        at[live] = here + COUNTS[pick[here]]
        live = live[at[live] < end[live]]
    start, owner = np.concatenate(starts), np.concatenate(owners)
    order = np.argsort(start, kind="stable")
    start, owner = start[order], owner[order]
    chosen = pick[start]
    words = chosen.astype(np.uint64) << _SHIFT
    for s in range(1, 15):
        which = np.flatnonzero(chosen == s)
        count, width = PACKS[s]
        for j in range(count if len(which) else 0):
            words[which] |= ids[start[which] + j] << np.uint64(j * width)
    escaped = chosen == 0
    per_block = np.bincount(owner[escaped], minlength=rows)
    if escaped.any():
        words[escaped] |= (np.arange(escaped.sum()) - np.repeat(np.cumsum(per_block) - per_block, per_block)).astype(np.uint64)
    return words, ids[start[escaped]], np.bincount(owner, minlength=rows), per_block


def decode(words: np.ndarray, exceptions: np.ndarray, n_words: np.ndarray, n_exceptions: np.ndarray) -> np.ndarray:
    """The ids of consecutive blocks."""
    selector = (words >> _SHIFT).astype(np.int64)
    payload = words & _MASK
    counts = COUNTS[selector]
    to = np.cumsum(counts) - counts
    out = np.empty(int(counts.sum()), np.uint64)
    for s in range(1, 15):
        which = np.flatnonzero(selector == s)
        count, width = PACKS[s]
        mask = (_ONE << np.uint64(width)) - _ONE
        for j in range(count if len(which) else 0):
            out[to[which] + j] = payload[which] >> np.uint64(j * width) & mask
    escaped = np.flatnonzero(selector == 0)
    if len(escaped):
        base = np.repeat(np.cumsum(n_exceptions) - n_exceptions, n_words)
        out[to[escaped]] = exceptions[base[escaped] + payload[escaped].astype(np.int64)]
    return out
