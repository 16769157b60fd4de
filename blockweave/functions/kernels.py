"""The feed-forward network on one batch of rows: sigmoid hidden layers, softmax on top.

Weights are one flat vector, layer after layer: an n_out x n_in matrix, column-major, then n_out
biases. These helpers run inside tasks, on the rows Spark hands over.
"""

from __future__ import annotations

import numpy as np


def weight_count(layers: list[int]) -> int:
    return sum(i * o + o for i, o in zip(layers, layers[1:], strict=False))


def unpack(weights: np.ndarray, layers: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per layer an (n_in, n_out) matrix and a bias; views, not copies."""
    parts, at = [], 0
    for n_in, n_out in zip(layers, layers[1:], strict=False):
        end = at + n_in * n_out
        parts.append((weights[at:end].reshape(n_in, n_out), weights[end : end + n_out]))
        at = end + n_out
    return parts


def forward(weights: np.ndarray, layers: list[int], x: np.ndarray) -> list[np.ndarray]:
    """Outputs of the hidden layers, then the raw scores of the top layer."""
    outputs = []
    parts = unpack(weights, layers)
    for level, (matrix, bias) in enumerate(parts):
        x = x @ matrix + bias
        if level < len(parts) - 1:
            with np.errstate(over="ignore"):
                x = 1.0 / (1.0 + np.exp(-x))
        outputs.append(x)
    return outputs


def softmax(scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class probabilities and their logarithms."""
    shifted = scores - scores.max(axis=1, keepdims=True)
    expd = np.exp(shifted)
    total = expd.sum(axis=1, keepdims=True)
    return expd / total, shifted - np.log(total)


def gradient(
    weights: np.ndarray, layers: list[int], x: np.ndarray, target: np.ndarray, share: np.ndarray
) -> tuple[np.ndarray, float]:
    """Flat gradient and cross-entropy loss of a batch; row n counts ``share[n]`` times."""
    outputs = forward(weights, layers, x)
    probability, log_probability = softmax(outputs[-1])
    loss = -float((share[:, None] * np.where(target == 0, 0.0, target * log_probability)).sum())
    delta = (probability - target) * share[:, None]
    parts = unpack(weights, layers)
    flat = np.empty(weights.size)
    slots = unpack(flat, layers)
    for level in range(len(parts) - 1, -1, -1):
        below = outputs[level - 1] if level else x
        np.matmul(below.T, delta, out=slots[level][0])
        np.sum(delta, axis=0, out=slots[level][1])
        if level:
            delta = (delta @ parts[level][0].T) * (1.0 - below) * below
    return flat, loss
