"""A small causal self-attention model of subword ids, in numpy.

The model predicts the frequency class of the next id from the ids before it; within its class an
id has its smoothed share of the training counts. So a text's probability is a proper
one over all ids, and the softmax stays small. Windows of CONTEXT + SCORED inputs overlap:
the first CONTEXT inputs of a window were scored in the window before and serve as context only.
"""

from __future__ import annotations

import math

import numpy as np

CONTEXT, SCORED = 16, 32
WINDOW = CONTEXT + SCORED
CLASSES = 32
#: Rows of the input table: one for each of the most frequent ids, one for each class for the others, one for a text's start.
FREQUENT = 4096
DIM = 16
#: Logits are bounded by it.
LOGIT = np.float32(30)
#: Where they are made, logits are in bits, as numpy's exp2 is quicker than its exp.
NAT = np.float32(math.log(2))
#: Windows of a training step.
BATCH = 64
#: Windows whose arrays are worked on together: they stay in a processor's cache.
GROUP = 64


class Vocabulary:
    """Classes of ids of about equal mass, and each id's share of its class, from counts over the training texts."""

    def __init__(self, counts: np.ndarray):
        smoothed = counts.astype(np.float64) + 1.0
        order = np.argsort(-smoothed, kind="stable")
        mass = np.cumsum(smoothed[order]) - smoothed[order] / 2
        self.class_of = np.empty(len(counts), np.int32)
        self.class_of[order] = np.minimum(CLASSES - 1, (mass / smoothed.sum() * CLASSES).astype(np.int32))
        in_class = np.bincount(self.class_of, smoothed, CLASSES)
        self.log_share = np.log(smoothed / in_class[self.class_of]).astype(np.float32)
        self.log_class = np.log((in_class + 1) / (in_class.sum() + CLASSES)).astype(np.float32)
        rank = np.empty(len(counts), np.int64)
        rank[order] = np.arange(len(counts))
        self.row_of = np.where(rank < FREQUENT, rank, FREQUENT + self.class_of).astype(np.int32)
        self.start_row = FREQUENT + CLASSES


class Windows:
    """All windows of some texts: input rows, which inputs exist, target ids, which targets exist, and the text of each window."""

    def __init__(self, texts: list[np.ndarray], vocabulary: Vocabulary):
        lengths = np.array([len(t) for t in texts], np.int64)
        ids = np.concatenate([*texts, np.zeros(0, np.uint32)]).astype(np.int64)
        starts = np.cumsum(lengths) - lengths
        per = -(-lengths // SCORED)
        self.text = np.repeat(np.arange(len(texts)), per)
        first = (np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)) * SCORED
        at = first[:, None] + np.arange(-CONTEXT, SCORED)
        self.valid = (at >= 0) & (at < lengths[self.text][:, None])
        place = np.clip(at + starts[self.text][:, None], 0, max(0, len(ids) - 1))
        rows = vocabulary.row_of[ids] if len(ids) else np.zeros(1, np.int32)
        self.rows = np.where(at > 0, rows[np.maximum(place - 1, 0)], vocabulary.start_row)
        self.targets = ids[place[:, CONTEXT:]] if len(ids) else np.zeros((0, SCORED), np.int64)
        self.wanted = self.valid[:, CONTEXT:]


class Room:
    """Arrays by name, used again batch after batch, so that none of this size are made afresh in each."""

    def __init__(self, kind: np.dtype | type = np.float32):
        self.kind, self.arrays = kind, {}

    def __call__(self, name: str, *shape: int, kind: np.dtype | type | None = None) -> np.ndarray:
        if name not in self.arrays or self.arrays[name].shape != shape:
            self.arrays[name] = np.empty(shape, kind or self.kind)
        return self.arrays[name]


class Attention:
    NAMES = ("E", "P", "Q", "K", "V", "O", "b")
    SEEN = (np.arange(WINDOW) <= np.arange(CONTEXT, WINDOW)[:, None]).astype(np.float32)

    def __init__(self, parts: dict[str, np.ndarray]):
        self.parts = parts

    @classmethod
    def fresh(cls, log_class: np.ndarray, seed: int = 1) -> Attention:
        r = np.random.default_rng(seed)
        shapes = {"E": (FREQUENT + CLASSES + 1, DIM), "P": (WINDOW, DIM), "Q": (DIM, DIM), "K": (DIM, DIM), "V": (DIM, DIM), "O": (DIM, CLASSES)}
        parts = {n: (r.standard_normal(s) * (0.1 if n in "EP" else DIM**-0.5)).astype(np.float32) for n, s in shapes.items()}
        return cls(parts | {"b": log_class.astype(np.float32)})

    def pack(self) -> np.ndarray:
        return np.concatenate([self.parts[n].ravel() for n in self.NAMES])

    def unpacked(self, flat: np.ndarray, copy: bool = True) -> Attention:
        """A model of these weights; without copy its parts are views, and change with them."""
        out, lo = {}, 0
        for n in self.NAMES:
            size = self.parts[n].size
            out[n] = flat[lo : lo + size].reshape(self.parts[n].shape).astype(np.float32, copy=copy)
            lo += size
        return Attention(out)

    def _outward(self) -> tuple[np.ndarray, np.ndarray]:
        """Queries and keys as one matrix, and what makes logits of what is attended to, of the own inputs, and of a one; in bits."""
        p = self.parts
        return p["Q"] @ p["K"].T * (np.float32(DIM**-0.5) / NAT), np.concatenate([p["V"] @ p["O"], p["O"], p["b"][None]]) / NAT

    @staticmethod
    def _exp(logits: np.ndarray) -> None:
        """Bounded, so that no maximum has to be found in each row; in place."""
        bound = LOGIT / NAT
        if not (logits.max(initial=0) <= bound and logits.min(initial=0) >= -bound):
            np.clip(logits, -bound, bound, out=logits)
        np.exp2(logits, out=logits)

    def _forward(self, rows: np.ndarray, first: np.ndarray, mix: np.ndarray, outward: np.ndarray, room: Room) -> tuple[np.ndarray, ...]:
        """Inputs, these turned over with a row of ones, queries, attention before it is divided by its sums, these sums, what _outward is multiplied by, and exp of the bounded logits.

        Queries and keys meet in one product of their matrices, as do values and outputs, so that inputs are multiplied
        as they are. What is attended to, the own inputs and a one lie beside each other, as they make the logits together.
        Only a text's first window (first) has context that doesn't exist; what lies behind a text's end is seen by no
        target that is wanted.
        """
        p, n = self.parts, len(rows)
        x = np.take(p["E"], rows, axis=0, out=room("x", n, WINDOW, DIM), mode="clip")
        x += p["P"]
        turned = room("turned", n, DIM + 1, WINDOW)
        turned[:, :DIM] = x.transpose(0, 2, 1)
        turned[:, DIM] = 1
        inner = room("inner", n, SCORED, 2 * DIM + 1)
        own = inner[:, :, DIM : 2 * DIM]
        own[:] = x[:, CONTEXT:]
        inner[:, :, 2 * DIM] = 1
        q = np.matmul(own.reshape(-1, DIM), mix, out=room("q", n * SCORED, DIM)).reshape(n, SCORED, DIM)
        s = np.matmul(q, turned[:, :DIM], out=room("s", n, SCORED, WINDOW))
        self._exp(s)
        s *= self.SEEN
        s[first, :, :CONTEXT] = 0
        sums = (s @ np.ones(WINDOW, s.dtype))[:, :, None]
        np.divide(np.matmul(s, x, out=room("h", n, SCORED, DIM)), sums, out=inner[:, :, :DIM])
        z = np.matmul(inner.reshape(-1, 2 * DIM + 1), outward, out=room("z", n * SCORED, CLASSES))
        self._exp(z)
        return x, turned, q, s, sums, inner, z

    def class_scores(self, w: Windows, classes: np.ndarray) -> np.ndarray:
        """log P(class of each target | inputs before it)."""
        (mix, outward), room = self._outward(), Room(self.parts["E"].dtype)
        out, first = np.empty(w.targets.shape, np.float32), ~w.valid[:, CONTEXT - 1]
        for lo in range(0, len(out), GROUP):
            z = self._forward(w.rows[lo : lo + GROUP], first[lo : lo + GROUP], mix, outward, room)[-1]
            own = classes[lo : lo + GROUP]
            wanted = z[np.arange(len(z)), own.ravel()]
            out[lo : lo + GROUP] = np.log(wanted / (z @ np.ones(CLASSES, z.dtype))).reshape(own.shape)
        return out

    def gradient(self, rows: np.ndarray, valid: np.ndarray, wanted: np.ndarray, classes: np.ndarray, room: Room | None = None) -> tuple[dict[str, np.ndarray], float]:
        """Gradients of the mean cross-entropy of the wanted targets, and that mean.

        The windows are worked on in groups, so that a group's arrays stay in the processor's cache; the groups' gradients
        are added. Gradients of single matrices follow from those of the products in _outward.
        """
        p, n = self.parts, len(rows)
        kind = p["E"].dtype
        room = room or Room(kind)
        mix, outward = self._outward()
        back_own, back_h, back_q = outward[DIM : 2 * DIM].T * NAT, outward[:DIM].T * NAT, mix.T * NAT
        first, share = ~valid[:, CONTEXT - 1], (wanted / max(1, int(wanted.sum()))).astype(kind)
        whole = room("dx", n, WINDOW, DIM)
        both, dmix, loss = np.zeros((2 * DIM + 1, CLASSES), kind), np.zeros((DIM, DIM), kind), 0.0
        for lo in range(0, n, GROUP):
            some = slice(lo, lo + GROUP)
            x, turned, q, s, sums, inner, dz = self._forward(rows[some], first[some], mix, outward, room)
            q *= NAT
            k, part = len(x), share[some].ravel()
            flat, h, own = inner.reshape(-1, 2 * DIM + 1), inner[:, :, :DIM], inner[:, :, DIM : 2 * DIM]
            norms = dz @ np.ones(CLASSES, kind)
            at = np.arange(len(dz)), classes[some].ravel()
            loss -= float(np.log(dz[at] / norms) @ part)
            dz *= (part / norms)[:, None]
            dz[at] -= part
            both += flat.T @ dz
            dh = room("dh", k, SCORED, DIM + 1)  # divided by the sums of attention; beside it what a row of ones takes off
            spare = room("h", k, SCORED, DIM)
            np.matmul(dz, back_h, out=spare.reshape(-1, DIM))
            np.divide(spare, sums, out=dh[:, :, :DIM])
            np.negative(np.einsum("nsd,nsd->ns", dh[:, :, :DIM], h), out=dh[:, :, DIM])
            ds = np.matmul(dh, turned, out=room("ds", k, SCORED, WINDOW))
            ds *= s
            dq = np.matmul(ds, x, out=room("dq", k, SCORED, DIM)).reshape(-1, DIM)
            dmix += own.reshape(-1, DIM).T @ dq
            dx = np.matmul(s.transpose(0, 2, 1), dh[:, :, :DIM], out=whole[some])
            dx += np.matmul(ds.transpose(0, 2, 1), q, out=x)
            np.matmul(dz, back_own, out=spare.reshape(-1, DIM))
            spare += np.matmul(dq, back_q, out=q.reshape(-1, DIM)).reshape(spare.shape)
            dx[:, CONTEXT:] += spare
        carried, own_o = both[:DIM], both[DIM : 2 * DIM]
        g = {"O": own_o + p["V"].T @ carried, "V": carried @ p["O"].T, "b": both[2 * DIM]}
        scale = np.float32(DIM**-0.5)
        g |= {"Q": dmix @ p["K"] * scale, "K": dmix.T @ p["Q"] * scale, "P": whole.sum(0)}
        places = np.add(np.multiply(rows, DIM, dtype=np.intp)[:, :, None], np.arange(DIM), out=room("places", n, WINDOW, DIM, kind=np.intp))
        g["E"] = room("E", *p["E"].shape)
        g["E"][:] = 0
        np.add.at(g["E"].reshape(-1), places.reshape(-1), whole.reshape(-1))
        return g, loss

    def trained(self, windows: list[tuple[np.ndarray, ...]], batch: int = BATCH, rate: float = 0.01, seed: int = 0) -> Attention:
        """This model after one pass of Adam over windows (rows, valid, wanted, classes), in a fixed random order."""
        flat = self.pack()
        model, room = self.unpacked(flat, copy=False), Room(flat.dtype)
        m, v, d = (np.zeros_like(flat) for _ in range(3))
        order, t = np.random.default_rng(seed).permutation(len(windows[0])), 0
        for lo in range(0, len(order), batch):
            some = order[lo : lo + batch]
            g, _ = model.gradient(*(x[some] for x in windows), room)
            np.concatenate([g[name].ravel() for name in self.NAMES], out=d, casting="same_kind")
            t += 1
            # m and v are kept as sums, without Adam's 0.1 and 0.01, which are in the factors of the step
            m *= np.float32(0.9)
            m += d
            v *= np.float32(0.99)
            v += np.multiply(d, d, out=d)
            width = math.sqrt(0.01 / (1 - 0.99**t))
            np.sqrt(v, out=d)
            d += np.float32(1e-6 / width)
            np.divide(m, d, out=d)
            d *= np.float32(rate * 0.1 / (1 - 0.9**t) / width)
            flat -= d
        return model
