"""A recurrent block labeller in numpy: a bidirectional LSTM over a page's leaf blocks."""

from __future__ import annotations

import re
import zlib
from functools import lru_cache
from pathlib import Path

import numpy as np

from .html_blocks import PATH_CELLS, Block

WORD_CELLS, NUMBERS, DENSE, HIDDEN_UNITS = 64, 13, 32, 24
#: Part of the training pages whose words are hidden, so that paths and context must do.
WORD_DROPOUT = 0.5
WORD, UPPER, DIGITS = re.compile(r"[^\W\d_]+"), re.compile(r"\b[A-Z]"), re.compile(r"\d+")


@lru_cache(maxsize=200_000)
def _cell(word: str) -> int:
    return zlib.crc32(word.encode()) % WORD_CELLS


@lru_cache(maxsize=20_000)
def _path_vector(path: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(path.to_bytes(PATH_CELLS // 8, "little"), np.uint8), bitorder="little")


def vectors(page: list[Block]) -> np.ndarray:
    """One row a block: hashed path, hashed words as shares, and numbers about the block and its place."""
    n = len(page)
    out = np.zeros((n, PATH_CELLS + WORD_CELLS + NUMBERS), np.float32)
    for i, b in enumerate(page):
        out[i, :PATH_CELLS] = _path_vector(b.path)
        found = WORD.findall(b.text.lower())
        if found:
            counts = np.bincount(list(map(_cell, found)), minlength=WORD_CELLS)
            out[i, PATH_CELLS : PATH_CELLS + WORD_CELLS] = counts / len(found)
        size = len(b.text)
        out[i, PATH_CELLS + WORD_CELLS :] = (
            min(len(found), 400) / 400, np.log1p(size) / 10, b.linked / size, sum(map(b.text.count, ".!?")) / (len(found) + 1),
            i / n, (n - i) / n, min(b.depth, 20) / 20, 1.0 if n < 4 else 0.0,
            1.0 if "\xa9" in b.text or "copyright" in b.text.lower() else 0.0, min(sum(map(b.text.count, "|\xb7\xbb\u2022")), 4) / 4,
            len(UPPER.findall(b.text)) / (len(found) + 1), len(DIGITS.findall(b.text)) / (len(found) + 1), 1.0 if b.text[-1] in ".!?\u2026" else 0.0,
        )
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class BlockLabeller:
    """dense tanh layer -> LSTM forwards and backwards -> logistic layer over both and the dense layer."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        d, h = PATH_CELLS + WORD_CELLS + NUMBERS, HIDDEN_UNITS

        def w(*shape: int) -> np.ndarray:
            return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

        self.p = {"wd": w(d, DENSE), "bd": np.zeros(DENSE, np.float32), "wo": w(2 * h + DENSE, 1), "bo": np.zeros(1, np.float32)}
        for s in "fb":
            self.p |= {f"wx{s}": w(DENSE, 4 * h), f"wh{s}": w(h, 4 * h), f"b{s}": np.zeros(4 * h, np.float32)}
            self.p[f"b{s}"][h : 2 * h] = 1.0

    def _lstm(self, x: np.ndarray, mask: np.ndarray, s: str, keep: list | None) -> np.ndarray:
        """States of one direction; x is (pages, steps, DENSE), padding carries states through."""
        n, steps, _ = x.shape
        k = HIDDEN_UNITS
        h = np.zeros((n, k), np.float32)
        c = np.zeros((n, k), np.float32)
        out = np.zeros((n, steps, k), np.float32)
        gates = x @ self.p[f"wx{s}"] + self.p[f"b{s}"]
        for t in range(steps) if s == "f" else range(steps - 1, -1, -1):
            z = gates[:, t] + h @ self.p[f"wh{s}"]
            i, f, o, g = _sigmoid(z[:, :k]), _sigmoid(z[:, k : 2 * k]), _sigmoid(z[:, 2 * k : 3 * k]), np.tanh(z[:, 3 * k :])
            new = f * c + i * g
            m = mask[:, t : t + 1]
            if keep is not None:
                keep.append((t, h, c, i, f, o, g, np.tanh(new), m))
            c = m * new + (1 - m) * c
            h = m * (o * np.tanh(new)) + (1 - m) * h
            out[:, t] = h
        return out

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logits (pages, steps) that a block is of the article."""
        dense = np.tanh(x @ self.p["wd"] + self.p["bd"])
        tapes = {s: [] if keep is not None else None for s in "fb"}
        joined = np.concatenate([self._lstm(dense, mask, "f", tapes["f"]), self._lstm(dense, mask, "b", tapes["b"]), dense], 2)
        if keep is not None:
            keep |= {"dense": dense, "joined": joined, **tapes}
        return (joined @ self.p["wo"] + self.p["bo"])[:, :, 0]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy, by backpropagation through time."""
        keep: dict = {}
        logits = self.forward(x, mask, keep)
        d = ((_sigmoid(logits) - y) * mask / max(1.0, mask.sum()))[:, :, None].astype(np.float32)
        k, dense, joined, g = HIDDEN_UNITS, keep["dense"], keep["joined"], {}
        g["wo"] = np.einsum("ntj,ntk->jk", joined, d)
        g["bo"] = d.sum((0, 1))
        back = d @ self.p["wo"].T
        to_dense = back[:, :, 2 * k :].copy()
        for s, lo in (("f", 0), ("b", k)):
            wh, wx = self.p[f"wh{s}"], self.p[f"wx{s}"]
            g[f"wh{s}"], g[f"wx{s}"], g[f"b{s}"] = np.zeros_like(wh), np.zeros_like(wx), np.zeros(4 * k, np.float32)
            dh = np.zeros((len(x), k), np.float32)
            dc = np.zeros_like(dh)
            for t, h0, c0, i, f, o, u, tc, m in reversed(keep[s]):
                dh = dh + back[:, t, lo : lo + k]
                step = m * dh
                do, dnew = step * tc, step * o * (1 - tc * tc) + m * dc
                dz = np.concatenate([dnew * u * i * (1 - i), dnew * c0 * f * (1 - f), do * o * (1 - o), dnew * i * (1 - u * u)], 1)
                g[f"wh{s}"] += h0.T @ dz
                g[f"wx{s}"] += dense[:, t].T @ dz
                g[f"b{s}"] += dz.sum(0)
                to_dense[:, t] += dz @ wx.T
                dh = dz @ wh.T + (1 - m) * dh
                dc = dnew * f + (1 - m) * dc
        pre = to_dense * (1 - dense * dense)
        g["wd"] = np.einsum("ntj,ntk->jk", x, pre)
        g["bd"] = pre.sum((0, 1))
        return g

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = 10, batch: int = 32, rate: float = 0.01, seed: int = 7) -> None:
        """Adam over batches of pages."""
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for epoch in range(epochs):
            order = rng.permutation(len(pages))
            for lo in range(0, len(order), batch):
                part = [pages[i] for i in order[lo : lo + batch]]
                x, mask = pad([p for p, _ in part])
                x[rng.random(len(x)) < WORD_DROPOUT, :, PATH_CELLS : PATH_CELLS + WORD_CELLS] = 0
                y, _ = pad([v[:, None] for _, v in part])
                step += 1
                for k, d in self.gradients(x, mask, y[:, :, 0]).items():
                    d = np.clip(d, -1, 1)
                    first[k] = 0.9 * first[k] + 0.1 * d
                    second[k] = 0.999 * second[k] + 0.001 * d * d
                    lr = rate * (0.3 if epoch >= epochs * 2 // 3 else 1.0)
                    self.p[k] -= lr * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)

    def label(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """For each page, which of its blocks are of the article. Pages of like length share a batch."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
        at = 0
        while at < len(order):
            steps = len(pages[order[at]])
            n = 1
            while at + n < len(order) and n < 256 and len(pages[order[at + n]]) <= steps + 4 and (n + 1) * (steps + 4) <= 16384:
                n += 1
            part = order[at : at + n]
            x, mask = pad([pages[i] for i in part])
            logits = self.forward(x, mask)
            for row, i in zip(logits, part, strict=True):
                out[i] = row[: len(pages[i])] > 0
            at += n
        return out


def pad(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(len(r) for r in rows)
    out = np.zeros((len(rows), steps, rows[0].shape[1]), np.float32)
    mask = np.zeros((len(rows), steps), np.float32)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
        mask[i, : len(r)] = 1
    return out, mask


#: Fitted weights; html_training writes them.
WEIGHTS = Path(__file__).with_name("html_weights.npz")


@lru_cache(maxsize=1)
def trained() -> BlockLabeller:
    """The labeller with the weights that html_training has fitted: the same for every input."""
    model = BlockLabeller()
    with np.load(WEIGHTS) as held:
        model.p = {k: held[k].astype(np.float32) for k in held.files}
    return model
