"""A causal self-attention model over subword ids, trained and run in numpy.

Text is a stream of ids in blocks of STEP. A window is one block with the block before it: the earlier one is
context only, so windows overlap by half and every token is scored exactly once, with STEP to 2 STEP - 1 tokens
before it. All windows of a batch go through one masked attention.

The softmax over the vocabulary has two levels: the id's group, then the id in its group. The commonest ids stand
in groups of MEMBERS that the model tells apart; the others are grouped by frequency and share their group's
probability as their corpus counts do, smoothed, so every id has some. A group holds either ids that open a word or
ids that go on with one, so the probability that a word ends is a sum over groups.
"""

from __future__ import annotations

import itertools

import numpy as np

STEP, MEMBERS = 16, 32


class Vocabulary:
    """Input rows, groups, places in groups and log shares of the ids, from their corpus counts.

    opens: whether an id begins a word (or ends the document). Groups of openers come first.
    """

    def __init__(self, counts: np.ndarray, opens: np.ndarray, inputs: int = 4096, own: int = 24, shared: int = 8):
        n = len(counts)
        rank = np.empty(n, np.int64)
        rank[np.argsort(-counts, kind="stable")] = np.arange(n)
        self.input_of, self.inputs = np.minimum(rank, inputs - 1).astype(np.int32), inputs
        smooth = counts.astype(np.float64) + 0.5
        self.group_of, self.place_of = np.zeros(n, np.int32), np.zeros(n, np.int32)
        self.log_share = np.zeros(n, np.float32)
        start, tables, masses = 0, [], []
        for side in (True, False):
            ids = np.flatnonzero(opens == side)
            ids = ids[np.argsort(rank[ids], kind="stable")]
            mine, rest = ids[: own * MEMBERS], ids[own * MEMBERS :]
            for a in range(0, len(mine), MEMBERS):
                some = mine[a : a + MEMBERS]
                self.group_of[some], self.place_of[some] = start, np.arange(len(some))
                table = np.full(MEMBERS, -60, np.float32)  # no id stands here
                table[: len(some)] = np.log(smooth[some] / smooth[some].sum())
                tables.append(table)
                masses.append(smooth[some].sum())
                start += 1
            if len(rest):
                mass = np.cumsum(smooth[rest]) - smooth[rest]
                k = np.unique((mass * shared / smooth[rest].sum()).astype(np.int64), return_inverse=True)[1]
                total = np.bincount(k, smooth[rest])
                self.group_of[rest], self.place_of[rest] = start + k, -1
                self.log_share[rest] = np.log(smooth[rest] / total[k])
                tables += [None] * len(total)
                masses += total.tolist()
                start += len(total)
            if side:
                self.opening = start
        self.groups = start
        self.told_apart = np.array([t is not None for t in tables], bool)
        self.slot = np.cumsum(self.told_apart) - 1  # each told-apart group's row in the model's second level
        self.slot_of = np.where(self.told_apart, self.slot, self.told_apart.sum()).astype(np.int16)  # the others' is behind all
        self.first_members = np.array([t for t in tables if t is not None], np.float32).reshape(-1, MEMBERS)
        self.first_groups = np.log(np.array(masses) / np.sum(masses)).astype(np.float32)


def blocks(ids: np.ndarray, lengths: np.ndarray, start: int):
    """Inputs (windows x STEP, the documents' ids shifted by one behind `start`), whether a block begins a
    document, and each token's place in the flat inputs."""
    n = -(-lengths // STEP)
    first = np.cumsum(n) - n
    into = np.repeat(first * STEP - (np.cumsum(lengths) - lengths), lengths) + np.arange(len(ids))
    flat = np.full(int(n.sum()) * STEP, start, ids.dtype)
    opens = np.zeros(int(n.sum()), bool)
    opens[first] = True
    # the token before each token, except at a document's start
    begin = np.cumsum(lengths) - lengths
    inner = np.ones(len(ids), bool)
    inner[begin] = False
    flat[into[inner]] = ids[np.flatnonzero(inner) - 1]
    return flat.reshape(-1, STEP), opens, into


#: Added to the scores: nothing for what came before, much below zero for what comes later.
LATE = np.where(np.arange(2 * STEP)[None, :] > np.arange(STEP)[:, None] + STEP, np.float32(-1e9), np.float32(0))[None]


def previous(x: np.ndarray) -> np.ndarray:
    return np.concatenate([x[:1], x[:-1]])


def extreme(s: np.ndarray) -> float:
    """The largest score without its sign."""
    return max(float(s.max(initial=0)), -float(s.min(initial=0)))


def masked(a: np.ndarray, opens: np.ndarray) -> None:
    """Scores in place: what comes later, and at a document's start the earlier block, goes far below zero."""
    a += LATE.astype(a.dtype, copy=False)
    a[opens, :, :STEP] = -1e9


def spread(m: np.ndarray) -> float:
    """How much a matrix can lengthen a row at most."""
    return float(np.linalg.norm(m, 2))


def exponentials(s: np.ndarray, reach: float):
    """s in place: exp of the scores. Returns the row sums, and what was taken off the rows before: their greatest, but
    only where scores may be as large as `reach` says. (Sums as products with ones: numpy is slow over short rows.)"""
    shift = np.float32(0) if reach <= 75 else s.max(-1, keepdims=True)
    if reach > 75:
        s -= shift
    np.exp(s, out=s)
    return (flat(s) @ np.ones(s.shape[-1], s.dtype)).reshape(*s.shape[:-1], 1), shift


def softmax(s: np.ndarray, reach: float) -> np.ndarray:
    """In place; returns log of what each row was divided by."""
    total, shift = exponentials(s, reach)
    s *= 1 / total  # a product is cheaper than a quotient
    return (np.log(total) + shift)[..., 0]


def chosen_less(s: np.ndarray, chosen: np.ndarray, n) -> float:
    """Sum of the log chances of each row's choice; the scores become the gradient of what is lost, by n."""
    here = np.arange(len(s))
    own = s[here, chosen]
    total, shift = exponentials(s, extreme(s))
    loss = float((own - (np.log(total) + shift)[:, 0]).sum())
    s *= (1 / total) / n  # in this order: a product of the two may be too large
    s[here, chosen] -= 1 / n
    return loss


def flat(m: np.ndarray) -> np.ndarray:
    return m.reshape(-1, m.shape[-1])


class Model:
    """Weights by name in `w`; all float32."""

    def __init__(self, vocabulary: Vocabulary, width: int = 16, seed: int = 5):
        r, d = np.random.default_rng(seed), width
        g = lambda *s, by=0.3: (r.standard_normal(s) * by).astype(np.float32)
        self.v, self.scale = vocabulary, np.float32(1 / np.sqrt(d))
        # the biases start as corpus shares: the untrained model is a count of ids
        self.w = {"E": g(vocabulary.inputs, d), "P": g(2 * STEP, d, by=0.1), "q": g(d, d), "k": g(d, d), "v": g(d, d), "o": g(d, d),
                  "U": g(d, vocabulary.groups, by=0.05), "b": vocabulary.first_groups.copy(),
                  "M": g(len(vocabulary.first_members), d, MEMBERS, by=0.05), "c": vocabulary.first_members.copy()}

    def by_group(self, group: np.ndarray):
        """(slot, rows) of each told-apart group among the target groups."""
        order = np.argsort(group.astype(np.int16), kind="stable")
        first = np.searchsorted(group[order], np.arange(self.v.groups + 1))
        for k in np.flatnonzero(self.v.told_apart & (np.diff(first) > 0)).tolist():
            yield int(self.v.slot[k]), order[first[k] : first[k + 1]]

    def attended(self, ids: np.ndarray, opens: np.ndarray):
        """Everything up to the scores, rows of all windows one after another: x, the queried half of it, scaled q, k and v
        side by side, masked scores by window, how large they may be. Later places are masked, and at a document's start
        the earlier block."""
        w, n, d = self.w, len(ids), self.w["E"].shape[1]
        x = w["E"].take(ids, 0)
        x += w["P"]
        xq = x[:, STEP:].reshape(-1, d)
        q, kv = xq @ (w["q"] * self.scale), flat(x) @ np.concatenate([w["k"], w["v"]], 1)
        a = q.reshape(n, STEP, d) @ kv[:, :d].reshape(n, 2 * STEP, d).transpose(0, 2, 1)
        reach = extreme(a)
        masked(a, opens)
        return flat(x), xq, q, kv, a, reach

    def projected(self) -> tuple[np.ndarray, np.ndarray]:
        """Every input row and every place as itself, k, v and scaled q side by side: a sum of two such rows is what
        `attended` computes for an id at a place."""
        to = np.concatenate([np.eye(len(self.w["q"]), dtype=self.w["q"].dtype), self.w["k"], self.w["v"], self.w["q"] * self.scale], 1)
        return self.w["E"] @ to, self.w["P"] @ to

    def hidden(self, ids: np.ndarray, opens: np.ndarray, reach: float | None, rows: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Of windows that follow each other, given the block before them and theirs, so that a block which is the current
        one of a window and the earlier one of the next is looked up once."""
        n, d = len(ids) - 1, self.w["E"].shape[1]
        of = rows.take(ids, 0)
        kv = np.empty((n, 2 * STEP, 2 * d), of.dtype)
        np.add(of[:-1, :, d : 3 * d], places[:STEP, d : 3 * d], out=kv[:, :STEP])
        np.add(of[1:, :, d : 3 * d], places[STEP:, d : 3 * d], out=kv[:, STEP:])
        q = of[1:, :, 3 * d :] + places[STEP:, 3 * d :]
        a = q @ kv[:, :, :d].transpose(0, 2, 1)
        reach = extreme(a) if reach is None else reach
        masked(a, opens)
        total, _ = exponentials(a, reach)
        o = a @ kv[:, :, d:]
        o /= total
        return flat(of[1:, :, :d] + places[STEP:, :d]) + flat(o) @ self.w["o"]

    def bounds(self) -> tuple[float | None, float]:
        """The largest score that the weights allow (None if that is too large to be of use), and the longest row of
        `hidden`: known once, they need not be looked for in every batch."""
        w = self.w
        x = float(np.sqrt((w["E"] ** 2).sum(1).max())) + float(np.sqrt((w["P"] ** 2).sum(1).max()))
        score = x * x * spread(w["q"]) * spread(w["k"]) * float(self.scale)
        return score if score <= 75 else None, x * (1 + spread(w["v"]) * spread(w["o"]))

    def log_probabilities(self, cur: np.ndarray, opens: np.ndarray, target: np.ndarray, group: int = 8192, inner: int = 128):
        """Natural logs, for each place of the windows: of the target id's probability, and of the probability that
        the target opens a word. A target below 0 is not asked. Attention runs over `inner` windows at a time, which
        stay in the processor's cache, the second level over `group`."""
        out, opening = np.zeros(cur.shape, np.float32), np.zeros(cur.shape, np.float32)
        w, d = self.w, self.w["E"].shape[1]
        # biases as weights of a constant input
        first, second = np.concatenate([w["U"], w["b"][None]]), np.concatenate([w["M"], w["c"][:, None]], 1)
        sizes = [float(np.sqrt((m * m).sum(-2).max())) if m.size else 0.0 for m in (w["U"], w["M"])]
        reach, length = self.bounds()
        table, places = self.projected()
        begins = np.zeros((self.v.groups, 2), np.float32)
        begins[: self.v.opening, 0], begins[:, 1] = 1, 1
        for a in range(0, len(cur), group):
            n = len(cur[a : a + group])
            t = target[a : a + group].ravel()
            kind = self.v.group_of[t]
            z, at, chance = np.ones((n * STEP, d + 1), np.float32), np.empty(n * STEP, np.float32), np.empty(n * STEP, np.float32)
            for i in range(0, n, inner):
                j = min(i + inner, n)
                here, before = slice(i * STEP, j * STEP), cur[max(a + i - 1, 0)][None]
                zi = z[here]
                zi[:, :d] = self.hidden(np.concatenate([before, cur[a + i : a + j]]), opens[a + i : a + j], reach, table, places)
                y = zi @ first
                own = y[np.arange(len(y)), kind[here]]
                _, shift = exponentials(y, length * sizes[0])
                sums = y @ begins
                logs = np.log(sums + np.float32(1e-30))
                at[here] = own - logs[:, 1] - (shift[:, 0] if np.ndim(shift) else shift)
                chance[here] = logs[:, 0] - logs[:, 1]
            at += self.v.log_share[t]
            kind[t < 0] = -1
            for slot, rows in self.by_group(kind):
                y = z.take(rows, 0) @ second[slot]
                own = y[np.arange(len(rows)), self.v.place_of[t[rows]]]
                total, shift = exponentials(y, length * sizes[1])
                at[rows] += own - (np.log(total) + shift)[:, 0]
            asked = t >= 0
            out[a : a + group].ravel()[asked] = at[asked]
            opening[a : a + group].ravel()[asked] = chance[asked]
        return out, opening

    def loss_and_gradients(self, cur, prev, opens, target):
        """Mean cross entropy of the places with a target (not below 0), and the gradient of every weight."""
        w, v, windows, d = self.w, self.v, len(cur), self.w["E"].shape[1]
        ids = np.concatenate([prev, cur], 1)
        x, xq, q, kv, a, reach = self.attended(ids, opens)
        softmax(a, reach)
        by_window = lambda m, rows: m.reshape(windows, rows, -1)
        values = by_window(kv[:, d:], 2 * STEP)
        o = flat(a @ values)
        # rows with a target in order of its group, so that the second level of each group is a slice; those of groups
        # without one come last
        t = target.ravel()
        asked = np.flatnonzero(t >= 0)
        slot = v.slot_of[v.group_of[t[asked]]]
        order = np.argsort(slot, kind="stable")
        edges = np.searchsorted(slot[order], np.arange(len(w["M"]) + 1)).tolist()
        asked = asked[order]
        t, told = t[asked], edges[-1]
        n = x.dtype.type(max(len(asked), 1))
        h = xq + o @ w["o"]
        z = h.take(asked, 0)
        p = z @ w["U"]
        p += w["b"]
        loss = float(v.log_share[t].sum()) + chosen_less(p, v.group_of[t], n)
        g = {"U": z.T @ p, "b": np.ones(len(p), x.dtype) @ p}
        dz = p @ w["U"].T
        # a constant input behind the others carries the biases
        zr, y, dzr = np.ones((told, d + 1), x.dtype), np.empty((told, MEMBERS), x.dtype), np.empty((told, d), x.dtype)
        zr[:, :d] = z[:told]
        second = np.concatenate([w["M"], w["c"][:, None]], 1)
        g2 = np.zeros_like(second)
        slices = [(i, slice(*part)) for i, part in enumerate(itertools.pairwise(edges)) if part[0] < part[1]]
        for i, part in slices:
            np.matmul(zr[part], second[i], out=y[part])
        loss += chosen_less(y, v.place_of[t[:told]], n)
        for i, part in slices:
            np.matmul(zr[part].T, y[part], out=g2[i])
            np.matmul(y[part], w["M"][i].T, out=dzr[part])
        dz[:told] += dzr
        g |= {"M": g2[:, :d], "c": g2[:, d]}
        dh = np.zeros((windows * STEP, d), x.dtype)
        dh[asked] = dz
        g["o"] = o.T @ dh
        do = dh @ w["o"].T
        ds = by_window(do, STEP) @ values.transpose(0, 2, 1)
        ds -= by_window((do * o) @ np.ones(d, x.dtype), STEP)  # the mean of a row by its weights
        ds *= a
        dq = flat(ds @ by_window(kv[:, :d], 2 * STEP))
        dkv = np.empty((windows, 2 * STEP, 2 * d), x.dtype)
        np.matmul(ds.transpose(0, 2, 1), by_window(q, STEP), out=dkv[:, :, :d])
        np.matmul(a.transpose(0, 2, 1), by_window(do, STEP), out=dkv[:, :, d:])
        dkv = flat(dkv)
        g["q"], both = xq.T @ dq * self.scale, x.T @ dkv
        g["k"], g["v"] = both[:, :d], both[:, d:]
        dh += dq @ (w["q"] * self.scale).T
        dx = by_window(dkv @ np.concatenate([w["k"], w["v"]], 1).T, 2 * STEP)
        dx[:, STEP:] += by_window(dh, STEP)
        g["P"] = (np.ones(windows, x.dtype) @ dx.reshape(windows, -1)).reshape(2 * STEP, d)
        rows, columns = ids.ravel().astype(np.intp), np.ascontiguousarray(flat(dx).T)
        g["E"] = np.array([np.bincount(rows, c, len(w["E"])) for c in columns]).T
        return -loss / float(n), g


class Trainer:
    """Adam over the windows it is given, each once, in a shuffled order of batches."""

    def __init__(self, model: Model, batch: int = 256, rate: float = 0.015, warm: int = 20, seed: int = 11):
        self.model, self.batch, self.rate, self.warm = model, batch, rate, warm
        # all weights lie in one array, of which the model's are views: a step is a few passes over it
        self.all = np.concatenate([v.ravel() for v in model.w.values()])
        ends = itertools.accumulate(v.size for v in model.w.values())
        model.w = {k: self.all[e - v.size : e].reshape(v.shape) for (k, v), e in zip(model.w.items(), ends, strict=True)}
        self.m1, self.m2, self.spare = (np.zeros_like(self.all) for _ in range(3))
        self.t, self.r, self.losses = 0, np.random.default_rng(seed), []

    def take(self, cur, prev, opens, target) -> None:
        order = self.r.permutation(len(cur))
        for a in range(0, len(cur), self.batch):
            at = order[a : a + self.batch]
            loss, g = self.model.loss_and_gradients(cur[at], prev[at], opens[at], target[at])
            self.losses.append(loss)
            self.t += 1
            # falls with the root of the steps, whose number nobody knows beforehand
            rate = self.rate * min(1.0, self.t / self.warm) / np.sqrt(1 + self.t / 200)
            x, y = np.concatenate([g[k].ravel() for k in self.model.w]), self.spare
            for m, by in ((self.m1, 0.1), (self.m2, 0.01)):
                np.subtract(x, m, out=y)
                y *= by
                m += y
                np.multiply(x, x, out=x)
            np.multiply(self.m2, 1 / (1 - 0.99**self.t), out=x)
            np.sqrt(x, out=x)
            x += 1e-8
            np.divide(self.m1, x, out=x)
            x *= rate / (1 - 0.9**self.t)
            self.all -= x
