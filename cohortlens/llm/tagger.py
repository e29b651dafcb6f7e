"""A character tagger in numpy: bidirectional LSTM with a CRF over the tags of a window.

Characters are ids, 0 fills a window's end. Training is by mini-batches of equal windows with Adam; `decode` runs the tables in
single precision over many windows at once. Tags are O and, per kind, B and I; transitions that no span has (I after anything but B
or I of its kind) are barred in training and decoding alike.
"""

from __future__ import annotations

import numpy as np

BARRED = -1e4


def barred(kinds: int) -> tuple[np.ndarray, np.ndarray]:
    """Additions to transitions and to the first tag: 0 where allowed."""
    tags = 1 + 2 * kinds
    step, first = np.zeros((tags, tags)), np.zeros(tags)
    for k in range(kinds):
        inside = 2 + 2 * k
        step[:, inside] = BARRED
        step[[inside - 1, inside], inside] = 0
        first[inside] = BARRED
    return step, first


def fresh(chars: int, kinds: int, size: int = 20, hidden: int = 20, seed: int = 5) -> dict[str, np.ndarray]:
    """Untrained parameters."""
    rnd, tags = np.random.default_rng(seed), 1 + 2 * kinds
    p = {"chars": rnd.normal(0, 0.3, (chars, size)), "out": rnd.normal(0, 0.3, (2 * hidden, tags)), "bias": np.zeros(tags),
         "step": rnd.normal(0, 0.05, (tags, tags)), "first": np.zeros(tags)}
    for way in "fb":
        p["in" + way] = rnd.normal(0, size ** -0.5, (size, 4 * hidden))
        p["rec" + way] = rnd.normal(0, 0.5 * hidden ** -0.5, (hidden, 4 * hidden))
        p["gate" + way] = np.concatenate([np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)])  # gates: in, forget, out, new
    return p


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * z) + 0.5


def _run(table: np.ndarray, rec: np.ndarray, ids: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """Hidden states (windows, steps, hidden) of one direction; with `keep` what the way back needs."""
    rows, steps = ids.shape
    n = rec.shape[0]
    h, c = np.zeros((rows, n), rec.dtype), np.zeros((rows, n), rec.dtype)
    out, trace = np.empty((rows, steps, n), rec.dtype), []
    for t in range(steps):
        z = table[ids[:, t]] + h @ rec
        gates = _sigmoid(z[:, :3 * n])
        new, was = np.tanh(z[:, 3 * n:]), c
        c = gates[:, n:2 * n] * was + gates[:, :n] * new
        squashed = np.tanh(c)
        if keep:
            trace.append((gates, new, was, squashed, h))
        h = gates[:, 2 * n:] * squashed
        out[:, t] = h
    return out, trace


def _run_back(grad: np.ndarray, trace: list, rec: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the gates' inputs (windows, steps, 4 hidden) and of the recurrent weights."""
    rows, steps, n = grad.shape
    dz_all, drec = np.empty((rows, steps, 4 * n), rec.dtype), np.zeros_like(rec)
    dh, dc = np.zeros((rows, n), rec.dtype), np.zeros((rows, n), rec.dtype)
    for t in range(steps - 1, -1, -1):
        gates, new, was, squashed, before = trace[t]
        i, f, o = gates[:, :n], gates[:, n:2 * n], gates[:, 2 * n:]
        dh = dh + grad[:, t]
        dc = dc + dh * o * (1 - squashed ** 2)
        dz = dz_all[:, t]
        dz[:, :n] = dc * new * i * (1 - i)
        dz[:, n:2 * n] = dc * was * f * (1 - f)
        dz[:, 2 * n:3 * n] = dh * squashed * o * (1 - o)
        dz[:, 3 * n:] = dc * i * (1 - new ** 2)
        drec += before.T @ dz
        dh, dc = dz @ rec.T, dc * f
    return dz_all, drec


def emissions(p: dict[str, np.ndarray], ids: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple]:
    """Tag scores (windows, steps, tags) from both directions."""
    forth, trace_f = _run(p["chars"] @ p["inf"] + p["gatef"], p["recf"], ids, keep)
    back, trace_b = _run(p["chars"] @ p["inb"] + p["gateb"], p["recb"], ids[:, ::-1], keep)
    both = np.concatenate([forth, back[:, ::-1]], 2)
    return both @ p["out"] + p["bias"], (both, trace_f, trace_b)


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


def crf_loss(scores: np.ndarray, tags: np.ndarray, step: np.ndarray, first: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Mean negative log likelihood of the tags and its gradients by scores, transitions and first tag."""
    rows, steps, n = scores.shape
    ahead, behind = np.empty_like(scores), np.zeros_like(scores)
    ahead[:, 0] = first + scores[:, 0]
    for t in range(1, steps):
        ahead[:, t] = _log_sum(ahead[:, t - 1, :, None] + step, 1) + scores[:, t]
    for t in range(steps - 2, -1, -1):
        behind[:, t] = _log_sum(step + (scores[:, t + 1] + behind[:, t + 1])[:, None, :], 2)
    total = _log_sum(ahead[:, -1], 1)
    dscores = np.exp(ahead + behind - total[:, None, None])
    pairs = np.exp(ahead[:, :-1, :, None] + step + (scores[:, 1:] + behind[:, 1:])[:, :, None, :] - total[:, None, None, None])
    dstep, dfirst = pairs.sum((0, 1)), dscores[:, 0].sum(0)
    r, s = np.arange(rows)[:, None], np.arange(steps)[None]
    gold = first[tags[:, 0]] + scores[r, s, tags].sum(1) + step[tags[:, :-1], tags[:, 1:]].sum(1)
    dscores[r, s, tags] -= 1
    np.add.at(dstep, (tags[:, :-1], tags[:, 1:]), -1)
    np.add.at(dfirst, tags[:, 0], -1)
    return float((total - gold).mean()), dscores / rows, dstep / rows, dfirst / rows


def loss_and_gradients(p: dict[str, np.ndarray], ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    kinds = (p["bias"].shape[0] - 1) // 2
    no_step, no_first = (x.astype(p["step"].dtype) for x in barred(kinds))
    scores, (both, trace_f, trace_b) = emissions(p, ids, True)
    loss, dscores, dstep, dfirst = crf_loss(scores, tags, p["step"] + no_step, p["first"] + no_first)
    n = p["recf"].shape[0]
    g = {"step": dstep, "first": dfirst, "bias": dscores.sum((0, 1)), "out": np.tensordot(both, dscores, ([0, 1], [0, 1]))}
    dboth = dscores @ p["out"].T
    g["chars"] = np.zeros_like(p["chars"])
    for way, grad, trace, order in (("f", dboth[:, :, :n], trace_f, ids), ("b", dboth[:, ::-1, n:], trace_b, ids[:, ::-1])):
        dz, g["rec" + way] = _run_back(grad, trace, p["rec" + way])
        hot = np.zeros((order.size, p["chars"].shape[0]), dz.dtype)
        hot[np.arange(order.size), order.ravel()] = 1
        table = hot.T @ dz.reshape(-1, 4 * n)
        g["in" + way], g["gate" + way] = p["chars"].T @ table, table.sum(0)
        g["chars"] += table @ p["in" + way].T
    return loss, g


def train(ids: np.ndarray, tags: np.ndarray, chars: int, kinds: int, rounds: int = 6, batch: int = 64, rate: float = 0.015, hidden: int = 20,
          seed: int = 5) -> dict[str, np.ndarray]:
    """Parameters after `rounds` passes over the windows, in single precision; equal inputs give equal parameters."""
    p, rnd = {k: v.astype(np.float32) for k, v in fresh(chars, kinds, hidden=hidden, seed=seed).items()}, np.random.default_rng(seed)
    mean, square, at = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    steps = rounds * -(-len(ids) // batch)
    for _ in range(rounds):
        order = rnd.permutation(len(ids))
        for i in range(0, len(order), batch):
            own = order[i:i + batch]
            _, g = loss_and_gradients(p, ids[own], tags[own])
            at += 1
            norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
            now = rate * min(1.0, 2 * (1 - at / (steps + 1)))
            shrink = min(1.0, 5 / (norm + 1e-12))
            for k, x in g.items():
                x = x * np.float32(shrink)
                mean[k] = 0.9 * mean[k] + 0.1 * x
                square[k] = 0.999 * square[k] + 0.001 * x * x
                p[k] = p[k] - now * (mean[k] / (1 - 0.9 ** at)) / (np.sqrt(square[k] / (1 - 0.999 ** at)) + 1e-8)
    return p


def best_tags(scores: np.ndarray, step: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The highest path of every window; the smallest tag where two are equal."""
    rows, steps, n = scores.shape
    best, back = first + scores[:, 0], np.zeros((rows, steps, n), np.int8)
    for t in range(1, steps):
        ways = best[:, :, None] + step
        back[:, t] = ways.argmax(1)
        best = ways.max(1) + scores[:, t]
    tags = np.empty((rows, steps), np.int64)
    tags[:, -1] = best.argmax(1)
    for t in range(steps - 1, 0, -1):
        tags[:, t - 1] = back[np.arange(rows), t, tags[:, t]]
    return tags


def decode(p: dict[str, np.ndarray], ids: np.ndarray) -> list[list[tuple[int, int, int, float]]]:
    """Per window its spans (kind, start, end, score): score is what the best path gains over one that leaves the span out."""
    kinds = (p["bias"].shape[0] - 1) // 2
    no_step, no_first = barred(kinds)
    scores = emissions(p, ids)[0].astype(np.float64)
    step, first = p["step"].astype(np.float64) + no_step, p["first"].astype(np.float64) + no_first
    tags = best_tags(scores, step, first)
    out: list[list[tuple[int, int, int, float]]] = [[] for _ in range(len(ids))]
    for row, start in zip(*np.nonzero((tags % 2 == 1))):
        path, end = tags[row], start + 1
        while end < len(path) and path[end] == path[start] + 1:
            end += 1
        own = path[start:end]
        gain = (scores[row, np.arange(start, end), own] - scores[row, start:end, 0]).sum()
        gain += step[own[:-1], own[1:]].sum() - (end - start - 1) * step[0, 0]
        gain += (step[path[start - 1], own[0]] - step[path[start - 1], 0]) if start else first[own[0]] - first[0]
        if end < len(path):
            follow = path[end]
            gain += step[own[-1], follow] - step[0, follow]
        out[row].append((int((path[start] - 1) // 2), int(start), int(end), float(gain)))
    return out
