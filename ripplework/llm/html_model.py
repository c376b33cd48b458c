"""A bidirectional LSTM in numpy that labels the blocks of a page as main text or not.

A block's input is its tag path (hashed elements and classes), its words (hashed), and a few numbers: length, share of
links, place in the page. The recurrent state carries the whole page past every block, from both sides.
"""

from __future__ import annotations

import math
import random
import zlib
from pathlib import Path

import numpy as np

from .html_blocks import Block, blocks_of

PATH_BINS, WORD_BINS, NUMBERS, HIDDEN = 160, 24, 6, 16
INPUTS = PATH_BINS + WORD_BINS + NUMBERS
WEIGHTS = Path(__file__).with_name("html_weights.npz")


class _Bins(dict):
    def __missing__(self, name: str) -> int:
        out = zlib.crc32(name.encode("utf-8", "surrogatepass"))
        if len(self) < 200_000:
            self[name] = out
        return out


_BINS = _Bins()


def features(blocks: list[Block]) -> np.ndarray:
    out = np.zeros((len(blocks), INPUTS), np.float32)
    for k, b in enumerate(blocks):
        row = out[k]
        for name in b.path:
            row[_BINS[name] % PATH_BINS] = 1.0
        words = b.text.split(" ")
        hashed = np.bincount([_BINS[w.lower()] % WORD_BINS for w in words], minlength=WORD_BINS)
        row[PATH_BINS : PATH_BINS + WORD_BINS] = hashed / len(words)
        n = len(b.text)
        row[-6:] = (math.log1p(n) / 8, math.log1p(len(words)) / 6, b.linked / n, k / len(blocks), 1.0 if b.text[-1] in ".!?\"" else 0.0, len(b.path) / 16)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _run(x: np.ndarray, keep: np.ndarray, w: np.ndarray, u: np.ndarray, b: np.ndarray, learn: bool = False):
    """x: (steps, pages, inputs); keep: (steps, pages, 1), 0 beyond a page's end. Returns states and, to learn, what backward needs."""
    steps, pages, _ = x.shape
    h, c = np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32)
    into, states, trace = x @ w + b, np.empty((steps, pages, HIDDEN), np.float32), []
    for t in range(steps):
        gates = into[t] + h @ u
        i, f, o = (_sigmoid(gates[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
        g = np.tanh(gates[:, 3 * HIDDEN :])
        new_c = f * c + i * g
        tc = np.tanh(new_c)
        if learn:
            trace.append((h, c, i, f, o, g, tc))
        h, c = keep[t] * o * tc, keep[t] * new_c
        states[t] = h
    return states, trace


def _back(x, keep, w, u, d_states, trace):
    dw, du, db = np.zeros_like(w), np.zeros_like(u), np.zeros(4 * HIDDEN, np.float32)
    dh, dc = np.zeros_like(d_states[0]), np.zeros_like(d_states[0])
    for t in range(len(x) - 1, -1, -1):
        h, c, i, f, o, g, tc = trace[t]
        dh = (dh + d_states[t]) * keep[t]
        dc = dc * keep[t] + dh * o * (1 - tc * tc)
        gates = np.concatenate([dc * g * i * (1 - i), dc * c * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], 1)
        dw += x[t].T @ gates
        du += h.T @ gates
        db += gates.sum(0)
        dh, dc = gates @ u.T, dc * f
    return dw, du, db


class Labeller:
    """p: parameters by name; f and b are the two directions."""

    def __init__(self, p: dict[str, np.ndarray] | None = None):
        if p is None:
            with np.load(WEIGHTS) as stored:
                p = {k: stored[k].astype(np.float32) for k in stored.files}
        self.p = p

    @classmethod
    def fresh(cls, seed: int = 0) -> Labeller:
        rng = np.random.default_rng(seed)
        p = {"out": rng.normal(0, 0.2, (2 * HIDDEN, 1)), "bias": np.zeros(1)}
        for d in "fb":
            p |= {f"w{d}": rng.normal(0, 0.15, (INPUTS, 4 * HIDDEN)), f"u{d}": rng.normal(0, 0.15, (HIDDEN, 4 * HIDDEN)), f"c{d}": np.repeat([0.0, 1.0, 0.0, 0.0], HIDDEN)}
        return cls({k: v.astype(np.float32) for k, v in p.items()})

    @staticmethod
    def _pad(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        longest = max(map(len, pages))
        x, keep = np.zeros((longest, len(pages), INPUTS), np.float32), np.zeros((longest, len(pages), 1), np.float32)
        turned = np.zeros((longest, len(pages)), np.int64)  # each page's steps from its end; padding in place
        for k, f in enumerate(pages):
            x[: len(f), k], keep[: len(f), k] = f, 1
            turned[:, k] = np.concatenate([np.arange(len(f))[::-1], np.arange(len(f), longest)])
        return x, keep, turned

    def _forward(self, x, keep, turned, learn=False):
        p, back = self.p, np.take_along_axis(x, turned[:, :, None], 0)
        hf, tf = _run(x, keep, p["wf"], p["uf"], p["cf"], learn)
        hb, tb = _run(back, keep, p["wb"], p["ub"], p["cb"], learn)
        both = np.concatenate([hf, np.take_along_axis(hb, turned[:, :, None], 0)], 2)
        return _sigmoid(both @ p["out"] + p["bias"]), both, back, tf, tb

    def probabilities(self, pages: list[np.ndarray], batch: int = 64) -> list[np.ndarray]:
        """Of main text, for each block of each page. Pages of like lengths run together, at most `batch` at once."""
        out: list[np.ndarray] = [np.zeros(0, np.float32)] * len(pages)
        order = sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: len(pages[k]))
        at = 0
        while at < len(order):
            some = order[at : at + batch]
            while len(some) > 1 and len(pages[some[-1]]) * len(some) > 20_000:
                some.pop()
            at += len(some)
            shown = self._forward(*self._pad([pages[k] for k in some]))[0]
            for j, k in enumerate(some):
                out[k] = shown[: len(pages[k]), j, 0]
        return out

    def fit(self, pages: list[np.ndarray], labels: list[np.ndarray], epochs: int = 6, rate: float = 0.01, batch: int = 32, seed: int = 0) -> list[float]:
        """Adam on the blocks' log loss; returns the mean loss of each epoch."""
        rng, m, v, step, history = random.Random(seed), {k: 0.0 for k in self.p}, {k: 0.0 for k in self.p}, 0, []
        order = list(range(len(pages)))
        for _ in range(epochs):
            rng.shuffle(order)
            total = count = 0.0
            for at in range(0, len(order), batch):
                some = order[at : at + batch]
                x, keep, turned = self._pad([pages[k] for k in some])
                y = np.zeros(keep.shape, np.float32)
                for j, k in enumerate(some):
                    y[: len(labels[k]), j, 0] = labels[k]
                shown, both, back, tf, tb = self._forward(x, keep, turned, learn=True)
                n = keep.sum()
                total -= float((keep * (y * np.log(shown + 1e-7) + (1 - y) * np.log(1 - shown + 1e-7))).sum())
                count += float(n)
                d = keep * (shown - y) / n
                d_both = d @ self.p["out"].T
                grads = {"out": np.einsum("tph,tpo->ho", both, d), "bias": d.sum((0, 1))}
                grads["wf"], grads["uf"], grads["cf"] = _back(x, keep, self.p["wf"], self.p["uf"], d_both[:, :, :HIDDEN], tf)
                grads["wb"], grads["ub"], grads["cb"] = _back(back, keep, self.p["wb"], self.p["ub"], np.take_along_axis(d_both[:, :, HIDDEN:], turned[:, :, None], 0), tb)
                step += 1
                for k, g in grads.items():
                    g = np.clip(g, -1, 1)
                    m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                    self.p[k] = (self.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
            history.append(total / count)
        return history


#: How made-up training pages name their parts.
_MAIN = ("article", "main", "div class=content", "div class=post", "div class=entry-content", "div id=article-body", "section class=story", "div class=main-text")
_PLAIN = ("section", "div", "div class=inner", "div class=col", "div class=row", "div id=x1", "td")
#: What stands inside an article without being of it.
_INSIDE = ("aside", "nav", "form", "div class=comments", "section id=comments", "figure class=ad", "div class=related", "div class=share", "footer", "div class=notice")
_MENU = ("nav", "ul class=menu", "div class=navbar", "div id=navigation", "div class=breadcrumbs", "header", "div class=header")
_ASIDE = ("aside", "div class=sidebar", "div class=ad", "div class=advert", "div class=banner", "div class=promo", "div class=cookie-notice", "div class=notice", "div role=alert", "div class=related", "div class=share", "div class=newsletter", "form", "div class=popup")
_AFTER = ("footer", "div class=footer", "div id=comments", "section class=comments", "ol class=comment-list", "div class=comment", "div class=copyright", "form class=reply")


def made_page(rng: random.Random, prose) -> str:
    """A made-up page; blocks of main text end with the mark U+E000, which labels are read from."""

    def opened(spec: str) -> tuple[str, str]:
        tag, _, rest = spec.partition(" ")
        name, _, value = rest.partition("=")
        return f'<{tag}{f" {name}={chr(34)}{value}{chr(34)}" if rest else ""}>', f"</{tag}>"

    def boiler(spec: str) -> str:
        a, b = opened(spec)
        kind = rng.random()
        if "menu" in spec or "nav" in spec or kind < 0.3:
            return a + "<ul>" + "".join(f'<li><a href="/x">{prose(1, 2)}</a></li>' for _ in range(rng.randint(2, 8))) + "</ul>" + b
        if spec.startswith("form"):
            return a + f"<label>{prose(1, 3)}</label><input name=q><p>{prose(2, 8)}</p>" + b
        if "comment" in spec:
            return a + "".join(f"<{t}>{prose(3, 40)}</{t}>" for t in [rng.choice(["p", "li", "div"])] * rng.randint(1, 5)) + b
        return a + (f"<p>{prose(2, 30)}</p>" if kind < 0.6 else prose(2, 25)) + b

    mark = ""
    body = [f"<h1>{prose(2, 10)}{mark}</h1>"] if rng.random() < 0.85 else []
    for k in range(rng.randint(1, 9)):
        kind = rng.random()
        text = prose(1, 90)
        if kind < 0.65:
            body.append(f"<p>{text}{mark}" + ("</p>" if rng.random() < 0.9 else "<br>"))
        elif kind < 0.72:
            body.append(f"<h2>{prose(1, 6)}{mark}</h2>")
        elif kind < 0.78:
            body.append("<ul>" + "".join(f"<li>{prose(1, 12)}{mark}</li>" for _ in range(rng.randint(1, 4))) + "</ul>")
        elif kind < 0.82:
            body.append(f"<blockquote>{text}{mark}</blockquote>")
        else:
            body.append(boiler(rng.choice(rng.choice((_ASIDE, _INSIDE, _MENU)))))
    if rng.random() < 0.3:  # comments and forms at the end of the article itself
        body.append(boiler(rng.choice(_AFTER)))
    kind = rng.random()
    a, b = opened("article" if kind < 0.35 else rng.choice(_MAIN) if kind < 0.65 else rng.choice(_PLAIN) if kind < 0.85 else f"div class={prose(1, 1).strip('.').lower()}")
    parts = [boiler(rng.choice(_MENU)) for _ in range(rng.randint(0, 2))] + [boiler(rng.choice(_ASIDE)) for _ in range(rng.randint(0, 2))]
    rng.shuffle(parts)
    parts += [a + "".join(body) + b] + [boiler(rng.choice(_ASIDE)) for _ in range(rng.randint(0, 2))] + [boiler(rng.choice(_AFTER)) for _ in range(rng.randint(0, 3))]
    inner = "".join(parts)
    if rng.random() < 0.4:
        a, b = opened(rng.choice(["div class=wrapper", "div id=page", "div class=container"]))
        inner = a + inner + b
    return "<!DOCTYPE html><html><head><title>x</title></head><body>" + inner + "</body></html>"


def training_pages(n: int, seed: int, words: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """n made-up pages as features and labels."""
    rng = random.Random(seed)
    xs, ys = [], []

    def prose(low: int, high: int) -> str:
        text = " ".join(rng.choice(words) for _ in range(rng.randint(low, high)))
        return text[:1].upper() + text[1:] + rng.choice(["", ".", ".", "."])

    while len(xs) < n:
        blocks = blocks_of(made_page(rng, prose))
        if blocks:
            ys.append(np.array([b.text.endswith("") for b in blocks], np.float32))
            for b in blocks:
                b.text = b.text.replace("", "").strip() or "-"
            xs.append(features(blocks))
    return xs, ys


def train(words: list[str], n: int = 9000, seed: int = 1) -> Labeller:
    xs, ys = training_pages(n, seed, words)
    model = Labeller.fresh(seed)
    model.fit(xs, ys, epochs=10)
    return model


def main(documents: str, n_documents: int = 400) -> None:
    """Write the committed weights: `python -m ripplework.llm.html_model /root/testdata/sf0.1/documents.parquet`.

    The words of the made-up pages are those of the first n_documents documents, a bounded sample.
    """
    import pyarrow.parquet as pq

    texts = next(pq.ParquetFile(documents).iter_batches(n_documents, columns=["text"])).column("text").to_pylist()
    np.savez_compressed(WEIGHTS, **train(sorted({w for t in texts for w in (t or "").split()})).p)


if __name__ == "__main__":
    import sys

    main(sys.argv[1])
