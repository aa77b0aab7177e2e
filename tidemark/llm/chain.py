"""Forward-backward over linear chains, many positions at a time."""

from __future__ import annotations

import numpy as np

BLOCK = 64  # positions that are walked one after the other, in all blocks at once


def marginals(
    emission: np.ndarray, starts: np.ndarray, transition: np.ndarray, start: np.ndarray, *, with_pairs: bool = False
) -> tuple[np.ndarray, np.ndarray | None, float]:
    """(probability of each label at each position, expected label pairs, log of the normaliser).

    ``emission`` is positions by labels, ``starts`` tells where a new chain begins, all in log scale.
    The positions are cut into blocks. Products of a block's matrices are taken for all blocks in step,
    then the blocks are passed through once, then all are walked again in step with what enters them.
    """
    n, labels = emission.shape
    blocks = -(-n // BLOCK)
    peak = emission.max(axis=1, initial=-np.inf)
    weight = np.ones((blocks * BLOCK, labels))
    weight[:n] = np.exp(emission - peak[:, None])
    first = np.zeros(blocks * BLOCK, bool)
    first[:n] = starts
    inside = np.zeros(blocks * BLOCK, bool)
    inside[:n] = True
    step, begin = np.exp(transition), np.exp(start)
    # Position-major, so that one position of all blocks is one slice.
    weight, first, inside = (x.reshape(blocks, BLOCK, *x.shape[1:]).swapaxes(0, 1).copy() for x in (weight, first, inside))

    def walk(k: int, arriving: np.ndarray) -> np.ndarray:
        """What leaves position k, of rows (blocks, ..., labels) that arrive there."""
        shape = (blocks,) + (1,) * (arriving.ndim - 2) + (labels,)
        moved = (arriving.reshape(-1, labels) @ step).reshape(arriving.shape)
        fresh = arriving.sum(axis=-1, keepdims=True) * begin
        moved = np.where(first[k].reshape(blocks, *(1,) * (arriving.ndim - 1)), fresh, moved) * weight[k].reshape(shape)
        return np.where(inside[k].reshape(blocks, *(1,) * (arriving.ndim - 1)), moved, arriving)

    product = np.broadcast_to(np.eye(labels), (blocks, labels, labels)).copy()
    for k in range(BLOCK):
        product = walk(k, product)
        product /= product.max(axis=(1, 2), keepdims=True)
    entering, leaving = np.empty((blocks, labels)), np.empty((blocks, labels))
    state = np.full(labels, 1 / labels)
    for number in range(blocks):
        entering[number] = state
        state = state @ product[number]
        state /= state.sum()
    state = np.full(labels, 1.0)
    for number in reversed(range(blocks)):
        leaving[number] = state
        state = product[number] @ state
        state /= state.sum()
    forward, scale = np.empty((BLOCK, blocks, labels)), np.empty((BLOCK, blocks, 1))
    state = entering
    for k in range(BLOCK):
        state = walk(k, state)
        scale[k] = state.sum(axis=-1, keepdims=True)
        state = forward[k] = state / scale[k]
    pairs = np.zeros((labels, labels)) if with_pairs else None
    both, state = np.empty_like(forward), leaving
    for k in reversed(range(BLOCK)):
        both[k] = forward[k] * state
        both[k] /= both[k].sum(axis=-1, keepdims=True)
        ahead = weight[k] * state
        if pairs is not None:
            before = forward[k - 1] if k else entering
            on = inside[k] & ~first[k]
            joint = before[on][:, :, None] * step * ahead[on][:, None, :]
            pairs += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        moved = np.where(first[k][:, None], (ahead * begin).sum(axis=-1, keepdims=True), ahead @ step.T)
        state = np.where(inside[k][:, None], moved, state)
        state = state / state.sum(axis=-1, keepdims=True)
    log_normaliser = float(np.log(scale).sum() + peak.sum()) if n else 0.0
    return both.swapaxes(0, 1).reshape(-1, labels)[:n], pairs, log_normaliser
