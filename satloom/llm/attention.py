"""A small causal self-attention model over ids, trained and run in numpy.

One block: attention with a learned bias for every distance, then a feed-forward layer, then a softmax.
Texts are scored in overlapping windows of ``context + hop`` ids: a window scores its last ``hop`` ids,
each of which sees the ids before it in the window, so every id is scored once and the overlap is its
context.  Windows of many texts form one batch; a mask hides ids to come and the padding.
"""

from __future__ import annotations

import numpy as np


class Attention:
    """Ids 0 .. size - 1; inputs may also be ``size`` (start) and ``size + 1`` (padding)."""

    def __init__(self, size: int, width: int = 16, inner: int = 32, context: int = 16, hop: int = 16, seed: int = 5):
        rng = np.random.default_rng(seed)
        normal = lambda *s: (rng.normal(size=s) / np.sqrt(s[0])).astype(np.float32)
        self.size, self.width, self.context, self.hop = size, width, context, hop
        self.start, self.pad = size, size + 1
        self.p = {
            "E": (rng.normal(size=(size + 2, width)) * 0.5).astype(np.float32), "Q": normal(width, width), "K": normal(width, width), "V": normal(width, width), "O": normal(width, width) * 0.3,
            "R": np.zeros(context + hop, np.float32), "W1": normal(width, inner), "c1": np.zeros(inner, np.float32), "W2": normal(inner, width) * 0.3, "U": normal(width, size) * 0.3, "b": np.zeros(size, np.float32),
        }
        i, j = np.arange(hop)[:, None], np.arange(context + hop)[None, :]
        self.distance = np.clip(context + i - j, 0, context + hop - 1)
        self.causal = j <= context + i

    def windows(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Inputs (n, context + hop), targets (n, hop; -1 beyond a text's end) and the first window of each text."""
        hop, context = self.hop, self.context
        sizes = np.array([len(t) for t in texts], np.int64)
        chunks = -(-sizes // hop)
        spans = context + hop * chunks
        begin = np.append(0, np.cumsum(spans))
        inputs = np.full(begin[-1], self.pad, np.int32)
        targets = np.full(begin[-1], -1, np.int32)
        flat = np.concatenate([*texts, np.zeros(0, np.int32)])
        at = np.arange(len(flat)) + np.repeat(begin[:-1] + context - np.cumsum(sizes) + sizes, sizes)
        targets[at] = flat
        if len(flat):
            before = np.empty(len(flat), np.int32)
            before[1:] = flat[:-1]
            before[(np.cumsum(sizes) - sizes)[sizes > 0]] = self.start
            inputs[at] = before
        first = np.append(0, np.cumsum(chunks))
        at = np.repeat(begin[:-1] - hop * first[:-1], chunks) + hop * np.arange(first[-1])
        return inputs[at[:, None] + np.arange(context + hop)], targets[at[:, None] + np.arange(context, context + hop)], first

    def prepare(self) -> None:
        """Tables for scoring: with one block, queries, keys and values depend on an id alone."""
        p = self.p
        scores = np.clip((p["E"] @ p["Q"]) @ (p["E"] @ p["K"]).T / np.sqrt(self.width), -30, 30)
        self.t_score = np.exp(scores).astype(np.float32)
        self.t_score[:, self.pad] = 0
        self.t_score = np.ascontiguousarray(self.t_score).ravel()
        self.t_value = (p["E"] @ p["V"] @ p["O"]).astype(np.float32)
        self.t_mask = (np.exp(np.clip(p["R"], -30, 30))[self.distance] * self.causal).astype(np.float32)

    def log_probs(self, inputs: np.ndarray, targets: np.ndarray, most: int = 64) -> np.ndarray:
        """Natural log probability of every target; 0 where there is none."""
        if len(inputs) and (inputs[:, : self.context] == self.pad).all():
            # No window has anything to the left: short texts, each in one window.
            return self._log_probs(inputs[:, self.context :], targets, most, self.context)
        return self._log_probs(inputs, targets, most, 0)

    def _log_probs(self, inputs: np.ndarray, targets: np.ndarray, most: int, cut: int) -> np.ndarray:
        """The same without the first ``cut`` keys, which are padding."""
        mask = self.t_mask[:, cut:]
        p, out = self.p, np.zeros(targets.shape, np.float64)
        for a in range(0, len(inputs), most):
            ids, goal = inputs[a : a + most], targets[a : a + most]
            query = ids[:, self.context - cut :]
            w = self.t_score[query[:, :, None] * (self.size + 2) + ids[:, None, :]]
            w *= mask
            mixed = w @ self.t_value[ids]
            mixed /= np.maximum(w.sum(2), 1e-30)[:, :, None]
            real = goal >= 0
            h = (p["E"][query] + mixed)[real]
            y = h + np.maximum(h @ p["W1"] + p["c1"], 0) @ p["W2"]
            logits = y @ p["U"]
            logits += p["b"]
            top = logits.max(1)
            hit = logits[np.arange(len(logits)), goal[real]] - top
            logits -= top[:, None]
            np.exp(logits, out=logits)
            out[a : a + most][real] = hit - np.log(logits.sum(1))
        return out

    def gradients(self, inputs: np.ndarray, targets: np.ndarray, sparse: bool = False) -> tuple[float, dict]:
        """Mean loss of a batch, and its gradients; that of the embeddings as (ids, rows) if ``sparse``.

        Keys and values are used through the products Q K' and V O, so places have embeddings alone: each id of the
        batch is projected once, as a query, and the gradients of its places are summed as one row each.
        """
        p, c, width = self.p, self.context, self.width
        kind = p["E"].dtype.type
        scale = kind(1 / np.sqrt(width))
        n, span = inputs.shape
        hop = span - c
        ids, at = _distinct(inputs, self.size + 2)
        match, value = p["Q"] @ p["K"].T * scale, p["V"] @ p["O"]
        e = p["E"][ids]
        asks = e @ match
        keys, q = e.take(at, 0), asks.take(at[:, c:], 0)
        x = keys[:, c:].reshape(-1, width)
        w = q @ keys.transpose(0, 2, 1)
        _clip(w, _norm(asks) * _norm(e))
        np.exp(w, out=w)
        w *= (np.exp(np.clip(p["R"], -30, 30))[self.distance] * self.causal).astype(kind)
        pad = inputs == self.pad
        if len(some := np.flatnonzero(pad.any(1))):
            w[some] *= ~pad[some][:, None, :]
        w *= 1 / np.maximum(w.reshape(-1, span) @ np.ones(span, kind), kind(1e-30)).reshape(n, hop, 1)
        flat = lambda a: a.reshape(-1, a.shape[-1])
        o = flat(w @ keys)
        one = np.ones(len(x), kind)
        h = o @ value
        h += x
        r = h @ p["W1"]
        r += p["c1"]
        np.maximum(r, 0, out=r)
        y = r @ p["W2"]
        y += h
        loss, dy, grad = self.output(y.reshape(n, hop, width), targets)
        dy = flat(dy)
        grad["W2"] = r.T @ dy
        dg = dy @ p["W2"].T
        dg *= r > 0
        grad["W1"], grad["c1"] = h.T @ dg, one @ dg
        dh = dg @ p["W1"].T
        dh += dy
        of_value = o.T @ dh
        grad["V"], grad["O"] = of_value @ p["O"].T, p["V"].T @ of_value
        do = dh @ value.T
        # The weights of a row sum to 1, so the mean of their gradients is the product of output and its gradient.
        mean = ((do * o) @ np.ones(width, kind)).reshape(n, hop, 1)
        do = do.reshape(n, hop, width)
        ds = do @ keys.transpose(0, 2, 1)
        ds -= mean
        ds *= w
        grad["R"] = np.bincount(self.distance.ravel(), weights=ds.sum(0).ravel(), minlength=len(p["R"])).astype(kind)
        dq = flat(ds @ keys)
        of_match = x.T @ dq
        of_match *= scale
        grad["Q"], grad["K"] = of_match @ p["K"], of_match.T @ p["Q"]
        dh += dq @ match.T
        rows = ds.transpose(0, 2, 1) @ q
        rows += w.transpose(0, 2, 1) @ do
        rows[:, c:] += dh.reshape(n, hop, width)
        rows = _sums(at, len(ids), rows)
        if sparse:
            grad["E"] = ids, rows
        else:
            grad["E"] = np.zeros_like(p["E"])
            grad["E"][ids] = rows
        return loss, grad

    def output(self, y: np.ndarray, targets: np.ndarray) -> tuple[float, np.ndarray, dict[str, np.ndarray]]:
        """Mean loss of the targets, its gradient by ``y``, and those of the output's parameters."""
        p = self.p
        logits = y @ p["U"] + p["b"]
        logits -= logits.max(2, keepdims=True)
        e = np.exp(logits)
        total = e.sum(2, keepdims=True)
        real = targets >= 0
        n = max(1, int(real.sum()))
        goal = np.maximum(targets, 0)[:, :, None]
        loss = float(((np.log(total) - np.take_along_axis(logits, goal, 2))[:, :, 0] * real).sum() / n)
        d = e / total
        np.put_along_axis(d, goal, np.take_along_axis(d, goal, 2) - 1, 2)
        d *= (real / np.float32(n))[:, :, None].astype(np.float32)
        flat = lambda a: a.reshape(-1, a.shape[-1])
        return loss, d @ p["U"].T, {"U": flat(y).T @ flat(d), "b": flat(d).sum(0)}

    def update(self, inputs: np.ndarray, targets: np.ndarray, state: dict, rate: float) -> float:
        """One step of Adam on a batch; ``state`` is kept between steps.  Returns the loss.

        Of the embeddings only the rows of the batch move, by Adagrad with one sum of squares a row.
        """
        t = state["t"] = state.get("t", 0) + 1
        loss, grad = self.gradients(inputs, targets, sparse=True)
        now = rate * min(1, t / 20)
        ids, rows = grad.pop("E")
        sums = state.setdefault("sums", np.full(len(self.p["E"]), 1e-12, np.float32))
        sums[ids] += (rows * rows).mean(1)
        self.p["E"][ids] -= (np.float32(4 * now) / np.sqrt(sums[ids]))[:, None] * rows
        g = np.concatenate([x.ravel() for x in grad.values()])
        m = state["m"] = 0.9 * state.get("m", 0) + 0.1 * g
        v = state["v"] = 0.99 * state.get("v", 0) + 0.01 * g * g
        move = (now / (1 - 0.9**t) * m / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
        at = 0
        for k, x in grad.items():
            self.p[k] -= move[at : at + x.size].reshape(x.shape)
            at += x.size
        return loss

    def packed(self) -> np.ndarray:
        """All parameters in one array."""
        return np.concatenate([self.p[k].ravel() for k in sorted(self.p)])

    def unpack(self, flat: np.ndarray) -> None:
        at = 0
        for k in sorted(self.p):
            self.p[k] = flat[at : at + self.p[k].size].reshape(self.p[k].shape).astype(np.float32)
            at += self.p[k].size


class Levels(Attention):
    """The same over many ids: a softmax over classes of ids by the context, and the share of the id in its class.

    ``counts`` has how often each id occurs; ids of a class are alike in it, and frequent ones stand alone, so that
    the context speaks for each of them.
    """

    def __init__(self, counts: np.ndarray, classes: int = 64, **how):
        size = len(counts)
        super().__init__(size, **how)
        order = np.argsort(-counts, kind="stable")
        mass = np.cumsum(np.sqrt(counts[order] + 0.5))
        _, first, of = np.unique(np.minimum((mass / mass[-1] * classes).astype(int), classes - 1), return_index=True, return_inverse=True)
        self.of, self.log_share = np.empty(size, np.int64), np.empty(size)
        c = counts[order] + 0.5
        self.of[order], self.log_share[order] = of, np.log(c / np.add.reduceat(c, first)[of])
        rng = np.random.default_rng(7)
        self.p["U"] = (rng.normal(size=(self.width, len(first))) * 0.3 / np.sqrt(self.width)).astype(np.float32)
        self.p["b"] = np.log(np.add.reduceat(c, first) / c.sum()).astype(np.float32)

    def prepare(self) -> None:
        p, wide = self.p, lambda a, last: np.concatenate([a, np.full((self.size + 2, 1), last, a.dtype)], 1)
        asks = p["E"] @ (p["Q"] @ p["K"].T / np.float32(np.sqrt(self.width)))
        self.t_most = _norm(asks) * _norm(p["E"])
        # A last column of ones sums the weights of a row; padding has neither value nor weight.
        self.t_query, self.t_place = wide(asks, 0), wide(p["E"], 1)
        self.t_place[self.pad] = 0
        self.t_value = np.concatenate([p["V"] @ p["O"], np.zeros((1, self.width), p["E"].dtype)])
        self.t_mask = (np.exp(np.clip(p["R"], -30, 30))[self.distance] * self.causal).astype(np.float32)

    def _log_probs(self, inputs: np.ndarray, targets: np.ndarray, most: int, cut: int) -> np.ndarray:
        p, out, mask = self.p, np.zeros(targets.shape, np.float64), self.t_mask[:, cut:]
        for a in range(0, len(inputs), most):
            ids, goal = inputs[a : a + most], targets[a : a + most].ravel()
            places = self.t_place.take(ids, 0)
            w = self.t_query.take(ids[:, self.context - cut :], 0) @ places.transpose(0, 2, 1)
            _clip(w, self.t_most)
            np.exp(w, out=w)
            w *= mask
            mixed = (w @ places).reshape(-1, self.width + 1)
            h = mixed @ self.t_value
            h *= (1 / np.maximum(mixed[:, -1], 1e-30))[:, None]
            h += places[:, self.context - cut :, :-1].reshape(h.shape)
            real = goal >= 0
            few = np.count_nonzero(real) < 0.9 * len(goal)
            if few:
                h, goal = h[real], goal[real]
            r = h @ p["W1"]
            r += p["c1"]
            np.maximum(r, 0, out=r)
            h += r @ p["W2"]
            own = np.maximum(goal, 0)
            hit, e, share = _softmax(p["U"], p["b"], h, self.of.take(own))
            logs = hit - np.log(share @ e) + self.log_share.take(own)
            if few:
                out[a : a + most].reshape(-1)[real] = logs
            else:
                logs *= real
                out[a : a + most] = logs.reshape(-1, targets.shape[1])
        return out

    def output(self, y: np.ndarray, targets: np.ndarray) -> tuple[float, np.ndarray, dict[str, np.ndarray]]:
        p, goal, flat = self.p, targets.ravel(), y.reshape(-1, y.shape[-1])
        kind, real = y.dtype.type, goal >= 0
        n = kind(max(1, np.count_nonzero(real)))
        at = self.of.take(np.maximum(goal, 0))
        hit, e, share = _softmax(p["U"], p["b"], flat, at)
        total = share @ e
        loss = ((np.log(total) - hit)[real].sum() - self.log_share.take(goal[real]).sum()) / n
        # Shares of the classes less 1 for the own one, but for the factors ``share`` of a class and ``part`` of a row.
        e[at, np.arange(len(at))] -= total / share.take(at)
        part = real / (total * n)
        dy = e.T @ (p["U"] * share).T
        dy *= part[:, None]
        return float(loss), dy.reshape(y.shape), {"U": (e @ (flat * part[:, None])).T * share, "b": (e @ part) * share}


def _softmax(weights: np.ndarray, bias: np.ndarray, y: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logits at one place a row, all exponentials, a column for each row of ``y``, and a factor for each of a column.

    The largest of a row is taken off only where they may be large; else the factors have the bias.
    """
    logits = weights.T @ y.T
    if _norm(weights.T) * _norm(y) <= 45 and abs(bias).max() <= 15:
        hit, share = logits[at, np.arange(len(at))] + bias.take(at), np.exp(bias)
    else:
        logits += bias[:, None]
        logits -= logits.max(0)
        hit, share = logits[at, np.arange(len(at))], np.ones_like(bias)
    return hit, np.exp(logits, out=logits), share


def _norm(rows: np.ndarray) -> float:
    """The largest norm of a row: products of rows are at most the product of two such."""
    return float(np.sqrt(np.einsum("ij,ij->i", rows, rows).max(initial=0)))


def _clip(scores: np.ndarray, most: float) -> None:
    """Keep scores, known to be at most ``most``, between -30 and 30."""
    if not most <= 30:
        np.clip(scores, -30, 30, out=scores)


def _distinct(inputs: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids that occur, in ascending order, and the place of each input among them."""
    seen = np.zeros(size, bool)
    seen[inputs] = True
    ids = np.flatnonzero(seen)
    place = np.empty(size, np.int64)
    place[ids] = np.arange(len(ids))
    return ids, place.take(inputs)


def _sums(at: np.ndarray, n: int, rows: np.ndarray) -> np.ndarray:
    """Sums of the rows by their places ``at``, all of 0 .. ``n`` - 1."""
    at, rows = at.ravel(), rows.reshape(at.size, -1)
    order = np.argsort(at.astype(np.uint16) if n <= 1 << 16 else at, kind="stable")
    counts = np.bincount(at, minlength=n)
    rows = rows.take(order, 0)
    if rows.shape[1] % 2 == 0:
        # Two numbers are added as one complex number, which takes half the steps.
        rows = rows.view(np.result_type(rows.dtype, np.complex64))
    return np.add.reduceat(rows, np.cumsum(counts) - counts, axis=0).view(rows.real.dtype)
