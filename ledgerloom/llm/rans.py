"""Static range asymmetric numeral system over blocks of ids, many blocks at once in numpy.

A block holds up to ``BLOCK_IDS`` ids dealt to ``LANES`` interleaved coders. All blocks of a file share one frequency
table and are otherwise independent. The lane states at every ``CHECK_STEPS`` steps are kept as checkpoints, so the
stretches of a block decode in parallel too. Checksums cover the words and the ids of every block.
"""

from __future__ import annotations

import zlib

import numpy as np

LANES, BLOCK_IDS, CHECK_STEPS = 16, 1 << 14, 512
LOW = np.uint64(1 << 31)
_32, _MASK = np.uint64(32), np.uint64(0xFFFFFFFF)


def frequencies(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Symbols that occur, their frequencies scaled to a power of two (1 at least), and its number of bits."""
    counts = np.bincount(ids, minlength=1)
    symbols = np.flatnonzero(counts)
    counts = counts[symbols]
    bits = max(16, int(len(symbols)).bit_length() + 2)
    total = 1 << bits
    scaled = np.maximum(1, counts * total // max(1, int(counts.sum()))).astype(np.int64)
    order = np.argsort(-scaled, kind="stable")
    excess = int(scaled.sum()) - total
    if excess < 0 and len(order):
        scaled[order[0]] -= excess
    for i in order:  # rounding up rare symbols is paid for by the most frequent
        if excess <= 0:
            break
        take = min(excess, int(scaled[i]) - max(1, int(scaled[i]) // 2))
        scaled[i] -= take
        excess -= take
    return symbols.astype(np.uint32), scaled.astype(np.uint32), bits


def encode_blocks(ids: np.ndarray, symbols: np.ndarray, freqs: np.ndarray, bits: int) -> list[dict]:
    """Each block of ``ids`` as words, checkpoints (states and word positions) and checksums."""
    n_blocks = -(-len(ids) // BLOCK_IDS)
    steps = BLOCK_IDS // LANES
    sizes = np.full(n_blocks, BLOCK_IDS)
    if n_blocks:
        sizes[-1] = len(ids) - (n_blocks - 1) * BLOCK_IDS
    code = np.zeros(n_blocks * BLOCK_IDS, np.int64)
    if len(ids):
        of_symbol = np.zeros(int(symbols[-1]) + 1, np.int64)
        of_symbol[symbols] = np.arange(len(symbols))
        code[: len(ids)] = of_symbol[ids]
    code = code.reshape(n_blocks, steps, LANES)
    starts = np.concatenate(([0], np.cumsum(freqs, dtype=np.uint64)))[:-1].astype(np.uint64)
    freqs = freqs.astype(np.uint64)
    shift, room = np.uint64(bits), np.uint64(63 - bits)
    state = np.full((n_blocks, LANES), LOW, np.uint64)
    words = np.zeros((steps, n_blocks, LANES), np.uint32)
    emitted = np.zeros((steps, n_blocks, LANES), bool)
    checks = np.zeros((steps // CHECK_STEPS, n_blocks, LANES), np.uint64)
    lane = np.arange(LANES)
    for t in range(steps - 1, -1, -1):
        live = t * LANES + lane < sizes[:, None]
        f, c = freqs[code[:, t]], starts[code[:, t]]
        full = live & (state >= f << room)
        words[t], emitted[t] = state & _MASK, full
        held = np.where(full, state >> _32, state)
        whole, rest = np.divmod(held, f)
        state = np.where(live, (whole << shift) + rest + c, state)
        if t % CHECK_STEPS == 0:
            checks[t // CHECK_STEPS] = state
    words, emitted = words.transpose(1, 0, 2), emitted.transpose(1, 0, 2)
    done = np.concatenate((np.zeros((n_blocks, 1), np.int64), np.cumsum(emitted.sum(2), axis=1)), axis=1)
    blocks = []
    for b in range(n_blocks):
        own = words[b][emitted[b]].astype("<u4")
        block_ids = ids[b * BLOCK_IDS : b * BLOCK_IDS + sizes[b]].astype("<u4")
        blocks.append({
            "n_ids": int(sizes[b]), "words": own, "positions": done[b, :-1][::CHECK_STEPS].astype("<u4"),
            "states": checks[:, b].astype("<u8"), "words_crc": zlib.crc32(own.tobytes()), "ids_crc": zlib.crc32(block_ids.tobytes()),
        })
    return blocks


def decode_blocks(blocks: list[dict], symbols: np.ndarray, freqs: np.ndarray, bits: int) -> np.ndarray:
    """The ids of the blocks, all their stretches between checkpoints decoded side by side; checksums are verified."""
    for block in blocks:
        if zlib.crc32(block["words"].tobytes()) != block["words_crc"]:
            raise ValueError("a block's words do not match their checksum")
    if not blocks:
        return np.zeros(0, np.uint32)
    per_block = BLOCK_IDS // LANES // CHECK_STEPS
    sizes = np.array([block["n_ids"] for block in blocks])
    first = np.cumsum([0] + [len(block["words"]) for block in blocks])[:-1]
    stream = np.concatenate([block["words"] for block in blocks] + [np.zeros(1, np.uint32)]).astype(np.uint64)
    state = np.concatenate([block["states"] for block in blocks]).astype(np.uint64)
    at = np.concatenate([f + block["positions"].astype(np.int64) for f, block in zip(first, blocks)])
    stretch = CHECK_STEPS * LANES
    left = np.repeat(sizes, per_block) - np.tile(np.arange(per_block) * stretch, len(blocks))
    slots = np.repeat(np.arange(len(freqs)), freqs)
    starts = np.concatenate(([0], np.cumsum(freqs, dtype=np.uint64)))[:-1].astype(np.uint64)
    freqs = freqs.astype(np.uint64)
    shift, mask = np.uint64(bits), np.uint64((1 << bits) - 1)
    out = np.zeros((len(state), CHECK_STEPS, LANES), np.uint32)
    lane = np.arange(LANES)
    for t in range(CHECK_STEPS):
        live = t * LANES + lane < left[:, None]
        slot = state & mask
        code = slots[slot.astype(np.int64)]
        out[:, t] = symbols[code]
        moved = freqs[code] * (state >> shift) + slot - starts[code]
        needs = live & (moved < LOW)
        order = np.cumsum(needs, axis=1)
        words = stream[np.where(needs, at[:, None] + order - 1, len(stream) - 1)]
        state = np.where(live, np.where(needs, (moved << _32) | words, moved), state)
        at = at + order[:, -1]
    ids = out.reshape(len(blocks), BLOCK_IDS)
    parts = [ids[b, : sizes[b]] for b in range(len(blocks))]
    for part, block in zip(parts, blocks):
        if zlib.crc32(np.ascontiguousarray(part, "<u4").tobytes()) != block["ids_crc"]:
            raise ValueError("a block's ids do not match their checksum")
    return np.concatenate(parts)
