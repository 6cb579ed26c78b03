"""A causal self-attention layer over windows of ids, in numpy: forward, gradients, Adam.

Inputs are slots of an embedding, outputs are logits of classes. A row attends to itself and to the rows before it in
its window. The output bias starts from the classes' frequencies, so an untrained model is the unigram model.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Exponents beyond this are cut.
FAR = np.float32(60)


@dataclass(frozen=True)
class Shape:
    slots: int
    classes: int
    width: int = 24
    window: int = 32


def sizes(shape: Shape) -> dict[str, tuple[int, ...]]:
    d = shape.width
    return {"embed": (shape.slots, d), "place": (shape.window, d), "query": (d, d), "key": (d, d), "value": (d, d), "mix": (d, d), "out": (d, shape.classes), "bias": (shape.classes,)}


def untrained(shape: Shape, class_counts: np.ndarray, seed: int = 5) -> dict[str, np.ndarray]:
    random = np.random.default_rng(seed)
    made = {name: random.normal(0, 0.3 if name == "embed" else size[0] ** -0.5, size).astype(np.float32) for name, size in sizes(shape).items()}
    made["out"][:] = 0
    made["place"][:] = 0
    made["bias"] = np.log((class_counts + 1) / (class_counts + 1).sum()).astype(np.float32)
    return made


def flat(weights: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([weights[name].ravel() for name in sorted(weights)])


def unflat(values: np.ndarray, shape: Shape) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, size in sorted(sizes(shape).items()):
        n = int(np.prod(size))
        out[name] = values[at : at + n].reshape(size).astype(np.float32)
        at += n
    return out


def times(x: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """A product with one matrix for all windows and rows at once."""
    return (x.reshape(-1, x.shape[-1]) @ weight).reshape(*x.shape[:-1], weight.shape[1])


def exponentials(values: np.ndarray) -> np.ndarray:
    """In place. Values beyond what single precision holds are cut; logits of a trained model stay far below."""
    np.clip(values, -FAR, FAR, out=values)
    return np.exp(values, out=values)


def keep_memory() -> None:
    """Lets the allocator keep the memory of a step's arrays for the next step: it does so up to the size of the largest block freed."""
    np.empty(31 << 20, np.uint8)


def row_sums(values: np.ndarray) -> np.ndarray:
    """Sums over the last axis, as a product."""
    return values @ np.ones(values.shape[-1], values.dtype)


def joint(w: dict[str, np.ndarray]) -> np.ndarray:
    """The matrices of queries, with their scale, keys and values beside each other, for one product."""
    return np.concatenate((w["query"] * np.float32(len(w["query"]) ** -0.5), w["key"], w["value"]), axis=1)


def attended(w: dict[str, np.ndarray], x: np.ndarray, first: int) -> tuple[np.ndarray, ...]:
    """The layer's output for rows ``first`` and later of each window; the rows before are only attended to."""
    length, width = x.shape[1], x.shape[2]
    q, k, v = np.split(times(x, joint(w)), 3, axis=2)
    seen_by = q[:, first:] @ k.transpose(0, 2, 1)
    exponentials(seen_by)
    seen_by *= np.tri(length, dtype=np.float32)[first:]
    seen_by *= (np.float32(1) / row_sums(seen_by))[..., None]
    rest = seen_by @ v
    rest += x[:, first:]
    hidden = times(rest, w["mix"])
    np.maximum(hidden, 0, out=hidden)
    return rest + hidden, q, k, v, seen_by, hidden, rest


def embedded(w: dict[str, np.ndarray], slots: np.ndarray) -> np.ndarray:
    x = np.take(w["embed"], slots, axis=0)
    x += w["place"][: slots.shape[1]]
    return x


def outputs(w: dict[str, np.ndarray], h: np.ndarray) -> np.ndarray:
    """Logits of all rows."""
    made = h.reshape(-1, h.shape[-1]) @ w["out"]
    made += w["bias"]
    return made


def log_probabilities(w: dict[str, np.ndarray], slots: np.ndarray, targets: np.ndarray, first: int = 0) -> np.ndarray:
    """The natural logarithm of each target class's probability, for rows ``first`` and later of each window."""
    x = embedded(w, slots)
    h = attended(w, x, first)[0]
    logits = outputs(w, h)
    aim = np.take_along_axis(logits, targets[:, first:].reshape(-1, 1), 1)[:, 0]
    return (np.clip(aim, -FAR, FAR) - np.log(row_sums(exponentials(logits)))).reshape(h.shape[:2])


def gradients(w: dict[str, np.ndarray], slots: np.ndarray, targets: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """The mean loss of the targets that aren't negative, and its gradient."""
    batch, length = slots.shape
    x = embedded(w, slots)
    h, q, k, v, seen_by, hidden, rest = attended(w, x, 0)
    d = h.shape[2]
    rows = lambda a: a.reshape(-1, a.shape[-1])
    p = exponentials(outputs(w, h))
    there = targets.ravel() >= 0
    n = max(1, int(there.sum()))
    told = np.flatnonzero(there)
    at = told * p.shape[1] + targets.ravel()[told]  # one number for row and class: pairs are several times slower
    sums = row_sums(p)
    own = p.ravel()[at]
    loss = float(-np.log(np.maximum(own / sums[told], 1e-30)).sum() / n)
    p.ravel()[at] = own - sums[told]
    share = there * (np.float32(1 / n) / sums)  # of rows of ``p``, which is wider than what it is multiplied with
    grad = {"out": (p.T @ (rows(h) * share[:, None])).T, "bias": share @ p}
    dres = p @ w["out"].T
    dres *= share[:, None]
    dres = dres.reshape(batch, length, d)
    du = dres * (hidden > 0)
    grad["mix"] = rows(rest).T @ rows(du)
    dres += times(du, w["mix"].T)
    ds = dres @ v.transpose(0, 2, 1)
    ds -= np.einsum("bij,bij->bi", ds, seen_by)[..., None]
    ds *= seen_by
    own = np.empty((batch, length, 3 * d), dres.dtype)
    for part, (a, b) in enumerate(((ds, k), (ds.transpose(0, 2, 1), q), (seen_by.transpose(0, 2, 1), dres))):
        np.matmul(a, b, out=own[..., part * d : (part + 1) * d])
    grad["query"], grad["key"], grad["value"] = np.split((rows(own).T @ rows(x)).T, 3, axis=1)
    grad["query"] = grad["query"] * np.float32(d**-0.5)
    dres += times(own, joint(w).T)
    grad["place"] = np.zeros_like(w["place"])
    grad["place"][:length] = dres.sum(axis=0)
    places = (slots.reshape(-1, 1) * d + np.arange(d)).ravel()
    grad["embed"] = np.bincount(places, dres.ravel(), w["embed"].size).astype(dres.dtype).reshape(w["embed"].shape)
    return loss, grad


def train(w: dict[str, np.ndarray], slots: np.ndarray, targets: np.ndarray, *, rate: float, batch: int, seed: int) -> dict[str, np.ndarray]:
    """One pass of Adam over all windows, in an order drawn from the seed."""
    keep_memory()
    values = flat(w)
    mean, square, made = np.zeros_like(values), np.zeros_like(values), np.empty_like(values)
    parts = np.split(values, np.cumsum([w[name].size for name in sorted(w)])[:-1])
    w = {name: part.reshape(w[name].shape) for name, part in zip(sorted(w), parts, strict=True)}  # views, changed with ``values``
    order = np.random.default_rng(seed).permutation(len(slots))
    steps = -(-len(order) // batch)
    for step, at in enumerate(range(0, len(order), batch), 1):
        take = order[at : at + batch]
        g = flat(gradients(w, slots[take], targets[take])[1])
        pace = np.float32(rate * (1 - 0.9 * (step - 1) / steps) * np.sqrt(1 - 0.99**step) / (1 - 0.9**step))
        for average, share in ((mean, np.float32(0.1)), (square, np.float32(0.01))):
            np.subtract(g, average, out=made)
            made *= share
            average += made
            if average is mean:
                g *= g
        np.sqrt(square, out=made)
        made += np.float32(1e-8)
        np.divide(mean, made, out=made)
        made *= pace
        values -= made
    return w
